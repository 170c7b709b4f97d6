"""Sentence boundaries learnt from the texts themselves: abbreviations, collocations and sentence starters by their likelihoods.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006). All that is
learnt are counts of words and of pairs around a period, so training is a few aggregations; the model
is a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom.operators.ordering import cut_table, small
from textloom.operators.plugins import ClosedClassTagger

# The thresholds of the paper.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
WORD = r"[\p{L}\p{N}][\p{L}\p{N}.'’-]*"
NUMBER = "##number##"
MOST_ROWS = 200_000


def word_type(word: Column) -> Column:
    """Lower case, without periods at the end; one type for all numbers."""
    bare = F.lower(F.rtrim(word, F.lit(".")))
    return F.when(word.between("0", ":") & bare.rlike(r"^[0-9]+([.'’-][0-9]+)*$"), NUMBER).otherwise(bare)


def neighbours(docs: DataFrame, text: str) -> DataFrame:
    """(type, period, upper, before, dotted): each word's type, whether a period ends it, whether it has a capital first letter, whether it is ``first``, after a ``word`` or after a ``period``, and the type of that last one."""
    words = docs.select(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    each = words.select(F.posexplode_outer("w").alias("i", "b"), "w").filter("i IS NOT NULL")  # outer, as the optimizer else takes the words apart twice, to leave out empty texts
    pairs = each.select("b", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).alias("a"))
    after = F.col("a").endswith(".")
    capital = F.when(F.col("b").between("a", "{"), False).otherwise(F.col("b").rlike(r"^\p{Lu}"))
    before = F.when(F.col("a").isNull(), "first").when(after, "period").otherwise("word")
    return pairs.select(word_type(F.col("b")).alias("type"), F.col("b").endswith(".").alias("period"), capital.alias("upper"), before.alias("before"), F.when(after, word_type(F.col("a"))).alias("dotted"))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the probability of ``k`` out of ``n`` at the rate ``p``, which is held off 0 and 1."""
    held = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return k * F.ln(held) + (n - k) * F.ln(1 - held)


def dunning(both: Column, a: Column, b: Column, n: Column) -> Column:
    """The log-likelihood ratio for ``b`` being as frequent after ``a`` as elsewhere."""
    apart = likelihood(both, a, both / a) + likelihood(b - both, n - a, (b - both) / F.greatest(n - a, F.lit(1)))
    return 2 * (apart - likelihood(both, a, b / n) - likelihood(b - both, n - a, b / n))


def train_sentences(docs: DataFrame, text: str) -> DataFrame:
    """The model: (kind, first, second, score).

    abbreviation: a type that nearly always has a period, the shorter and the more periods within
    the likelier. starter: a type that follows periods of other words much more often than it
    occurs. collocation: an abbreviation, initial or number, and what follows its period much more
    often than elsewhere. common: a type that follows an abbreviation with a capital, but within
    sentences is written without. Null and empty texts have no words. Counts run over all texts.
    """
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    pairs = cut_table(neighbours(docs, text).groupBy("type", "before", "dotted").agg(F.count(F.lit(1)).alias("n"), one("period").alias("periods"), one("upper").alias("uppers")))
    counts = cut_table(pairs.groupBy("type").agg(F.sum("n").alias("total"), F.sum("periods").alias("dotted")))
    n, n_dots = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("dotted"), F.lit(0))).first()
    periods = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - periods).cast("double")
    plain = F.col("total") - F.col("dotted")
    ratio = 2 * (likelihood(F.col("dotted"), F.col("total"), F.lit(0.99)) - likelihood(F.col("dotted"), F.col("total"), F.lit(n_dots / max(n, 1))))
    score = ratio * F.exp(-letters) * (periods + 1) * F.pow(letters, -plain.cast("double"))
    known = counts.filter((F.col("dotted") > 0) & (F.col("type") != NUMBER)).select(F.col("type").alias("first"), score.alias("score")).filter(F.col("score") >= ABBREVIATION)
    known = cut_table(known)
    n_known = known.count()
    few = small(known.select(F.col("first").alias("_known"), F.lit(True).alias("short")), n_known)
    bound = F.coalesce(F.col("short"), F.lit(False)) | F.col("type").rlike(r"^\p{L}$") | (F.col("type") == NUMBER)
    marked = lambda df: df.join(few, F.col("type") == F.col("_known"), "left").withColumn("bound", bound)
    after_periods = pairs.filter("before = 'period'").select(F.col("dotted").alias("type"), F.col("type").alias("next"), "n", "uppers")
    dotted = cut_table(marked(after_periods).select("type", "next", "bound", "n", "uppers"))
    ends = marked(counts.filter("dotted > 0")).filter("NOT bound").agg(F.coalesce(F.sum("dotted"), F.lit(0))).first()[0]
    totals = counts.select(F.col("type").alias("_t"), F.col("total").alias("_total"))
    after = dotted.filter("NOT bound").groupBy("next").agg(F.sum("n").alias("both")).join(totals, F.col("next") == F.col("_t"))
    more = F.col("both") / max(ends, 1) > F.col("_total") / max(n, 1)
    starters = after.filter(more).select(F.col("next").alias("first"), dunning(F.col("both"), F.lit(ends), F.col("_total"), F.lit(n)).alias("score")).filter(F.col("score") >= STARTER)
    first = dotted.filter("bound").join(totals.withColumnsRenamed({"_t": "_a", "_total": "of_first"}), F.col("type") == F.col("_a")).join(totals, F.col("next") == F.col("_t"))
    often = (F.col("n") > 1) & (F.col("n") / F.col("of_first") > F.col("_total") / max(n, 1))
    linked = first.filter(often).select(F.col("type").alias("first"), F.col("next").alias("second"), dunning(F.col("n"), F.col("of_first"), F.col("_total"), F.lit(n)).alias("score")).filter(F.col("score") >= COLLOCATION)
    inner = pairs.filter("before = 'word'").select(F.col("type").alias("next"), F.col("uppers").alias("_up"), F.col("n").alias("_all"))
    capital = dotted.filter("bound AND uppers > 0").select("next").distinct()
    common = capital.join(inner.withColumnRenamed("next", "_n"), F.col("next") == F.col("_n")).filter("_up = 0").select(F.col("next").alias("first"), F.col("_all").cast("double").alias("score"))
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "first", F.col("second") if "second" in df.columns else F.lit(None).cast("string").alias("second"), "score")
    return of(known, "abbreviation").unionByName(of(starters, "starter")).unionByName(of(linked, "collocation")).unionByName(of(common, "common"))


_END = re.compile(r"([.!?…]+)[\"'»”’)\]]*(\s+)|\n+")
_BEFORE, _AFTER = re.compile(r"[^\W_][\w.'’-]*$"), re.compile(r"[^\W_][\w.'’-]*")


@dataclass(frozen=True)
class SentenceModel:
    """The model in memory, as sets."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()

    @staticmethod
    def of(model: DataFrame, most: int = MOST_ROWS) -> SentenceModel:
        """Fetched to be sent to tasks; an error if it has more than ``most`` rows."""
        rows = model.select("kind", "first", "second").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a sentence model of more than {most} rows")
        kind = lambda k: frozenset(r["first"] for r in rows if r["kind"] == k)
        return SentenceModel(kind("abbreviation"), kind("starter"), kind("common"), frozenset((r["first"], r["second"]) for r in rows if r["kind"] == "collocation"))

    def ends_at(self, before: str, after: str) -> bool:
        """Whether a sentence ends at the period of ``before``, a word without it, in front of the word ``after``."""
        kind = lambda w: NUMBER if re.fullmatch(r"[0-9]+([.'’-][0-9]+)*", w) else w.lower()
        a, b = kind(before.rstrip(".")), kind(after.rstrip("."))
        lower, initial = after[:1].islower(), len(a) == 1 and a.isalpha()
        if a == NUMBER:
            return not lower and (a, b) not in self.collocations
        if not (initial or a in self.abbreviations):
            return True
        if lower or (a, b) in self.collocations:
            return False
        return b in self.starters or (not initial and after[:1].isupper() and b in self.common)

    def sentences(self, text: str | None) -> list[str]:
        """The sentences, stripped; those of blanks only are left out. Marks other than a period and line breaks always end one."""
        out, begin = [], 0
        for m in _END.finditer(text or ""):
            if m[1] == ".":
                before, after = _BEFORE.search(text, max(begin, m.start() - 64), m.start()), _AFTER.match(text, m.end())
                if before and after and "\n" not in m[2] and not self.ends_at(before[0], after[0]):
                    continue
            out.append(text[begin : m.end()].strip())
            begin = m.end()
        return [s for s in [*out, (text or "")[begin:].strip()] if s]


@dataclass(frozen=True)
class TrainedTagger(ClosedClassTagger):
    """Sentences by a trained model; tokens and tags as in ``ClosedClassTagger``."""

    model: SentenceModel = field(default_factory=SentenceModel)

    def sentences(self, text: Column) -> Column:
        model = self.model

        @pandas_udf("array<string>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(model.sentences, na_action=None)

        return split(text)
