"""Places for models: tokenizer, embedder, judge and generator, with deterministic offline defaults.

A plug-in turns a column into a column. The defaults are expressions of built-in functions; a
model's own version would wrap an iterator Pandas UDF that loads it once for each Python worker.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.prompts import judge_prompt, pair_prompt
from textloom.functions.scores import cosine, extract_score, windowed_similarity
from textloom.functions.text import bleu_tokens
from textloom.operators.chunks import token_windows, truncate_tokens
from textloom.operators.vocabulary import STOPWORDS


class Tokenizer(Protocol):
    def tokens(self, text: Column) -> Column: ...

    def ids(self, text: Column) -> Column: ...


class Tagger(Protocol):
    """Sentences of a text, tokens of a sentence, and of each token whether it is of a closed class
    (conjunctions, prepositions, articles), a stop word, a number or a mark: structs of closed,
    stop, number and mark."""

    def sentences(self, text: Column) -> Column: ...

    def tokens(self, sentence: Column) -> Column: ...

    def tags(self, tokens: Column) -> Column: ...


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Judge(Protocol):
    def answer(self, prompt: Column) -> Column: ...


class Generator(Protocol):
    def generate(self, prompt: Column, candidate: int) -> Column: ...


@dataclass(frozen=True)
class WordTokenizer:
    """Words and marks; ids are hashes below ``size``."""

    size: int = 32_000

    def tokens(self, text: Column) -> Column:
        return bleu_tokens(text)

    def ids(self, text: Column) -> Column:
        return F.transform(self.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.size)).cast("int"))


@dataclass(frozen=True)
class ClosedClassTagger:
    """Sentences end at marks or line breaks; a list of function words stands in for closed classes and stop words."""

    function_words: tuple[str, ...] = STOPWORDS

    def sentences(self, text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")

    def tokens(self, sentence: Column) -> Column:
        return F.regexp_extract_all(sentence, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))

    def tags(self, tokens: Column) -> Column:
        closed = lambda t: F.lower(t).isin(*self.function_words)
        letter = lambda t: ((t >= "a") & (t < "{")) | ((t >= "A") & (t < "["))  # noqa: E731  # begins with an ASCII one, which most tokens do
        number, mark = (lambda t: F.when(letter(t), False).otherwise(t.rlike(r"^\p{N}+$"))), (lambda t: F.when(letter(t), False).otherwise(~t.rlike(r"^[\p{L}\p{N}]")))
        return F.transform(tokens, lambda t: F.struct(closed(t).alias("closed"), closed(t).alias("stop"), number(t).alias("number"), mark(t).alias("mark")))


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of words by hash, in ``size`` dimensions."""

    size: int = 64

    def embed(self, text: Column) -> Column:
        slots = F.transform(bleu_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.size)).cast("int"))
        return self._counted(slots)

    def _counted(self, slots: Column) -> Column:
        """How often each slot is there: all slots once more, sorted, so that a slot's number is how far its first place is from the next one's."""
        every = F.sort_array(F.concat(slots, F.sequence(F.lit(0), F.lit(self.size))))
        places = lambda xs: F.transform(F.sequence(F.lit(0), F.lit(self.size)), lambda i: F.array_position(xs, i))
        gaps = lambda at: F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: (F.get(at, i + 1) - F.get(at, i) - 1).cast("float"))
        made = F.aggregate(F.array(every), F.array().cast("array<bigint>"), lambda _, xs: places(xs))  # as a variable, so that it is made once
        return F.aggregate(F.array(made), F.array().cast("array<float>"), lambda _, at: gaps(at))


@dataclass(frozen=True)
class HeuristicJudge:
    """Answers in the judges' form, with the share of distinct words as the score."""

    def answer(self, prompt: Column) -> Column:
        words = bleu_tokens(prompt)
        share = F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)
        return F.concat(F.lit('{"score": '), F.format_number(share, 3), F.lit("}"))


@dataclass(frozen=True)
class EchoGenerator:
    """Gives the prompt back with the candidate's number."""

    def generate(self, prompt: Column, candidate: int) -> Column:
        return F.concat(prompt, F.lit(f" [{candidate}]"))


def decoding_parameters(candidate: int, seed: int = 42) -> dict[str, float | int]:
    """temperature, top_p and top_k of a pass: the first is cool, the others are drawn from their ranges."""
    draw = lambda name: int(hashlib.md5(f"{name}~{candidate}~{seed}".encode()).hexdigest()[:8], 16) / 2**32
    temperature = 0.2 if candidate == 1 else round(0.6 + 0.3 * draw("temperature"), 4)
    return {"temperature": temperature, "top_p": round(0.8 + 0.15 * draw("top_p"), 4), "top_k": (40, 50, 60)[int(3 * draw("top_k"))]}


def generate_candidates(prompts: DataFrame, prompt: str, generator: Generator, n: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``response_i`` and its decoding parameters for i from 1 to ``n``."""
    new = {}
    for i in range(1, n + 1):
        new[f"response_{i}"] = generator.generate(F.col(prompt), i)
        new |= {f"{k}_{i}": F.lit(v) for k, v in decoding_parameters(i, seed).items()}
    return prompts.withColumns(new)


def add_judge_score(df: DataFrame, text: str, judge: Judge, template: str, into: str = "educational_score") -> DataFrame:
    return df.withColumn(into, extract_score(judge.answer(judge_prompt(template, F.col(text)))))


def add_pair_score(df: DataFrame, text1: str, text2: str, judge: Judge, template: str, into: str = "similarity_score") -> DataFrame:
    return df.withColumn(into, extract_score(judge.answer(pair_prompt(template, F.col(text1), F.col(text2)))))


def add_similarity(df: DataFrame, private: str, public: str, embedder: Embedder, tokenizer: Tokenizer, most: int = 512, window: int = 128, step: int = 64, into: str = "similarity_score") -> DataFrame:
    """Adds half the similarity of the texts cut to ``most`` tokens and half the least one of the public text's windows."""
    short = lambda c: truncate_tokens(F.col(c), tokenizer.tokens(F.col(c)), most)
    out = df.withColumn("_a", short(private)).withColumn("_b", short(public)).withColumn("_ea", embedder.embed(F.col("_a"))).withColumn("_eb", embedder.embed(F.col("_b")))
    out = out.withColumn("_w", token_windows(tokenizer.tokens(F.col("_b")), window, step))
    parts = F.transform(F.transform("_w", lambda w: embedder.embed(F.array_join(w, " "))), lambda e: cosine(F.col("_ea"), e))  # embedded once, though the cosine names it three times
    score = F.when(F.col(private).isNull() | F.col(public).isNull(), 0.0).otherwise(windowed_similarity(cosine(F.col("_ea"), F.col("_eb")), parts))
    return out.withColumn(into, score).drop("_a", "_b", "_ea", "_eb", "_w")
