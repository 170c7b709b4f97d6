"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given per document, so tokens are labelled first: a word or word beginning that
documents labelled toxic have significantly more often is a mark, and tokens of toxic documents
with a mark are labelled toxic, all others not. The field has two states; its features are the
word and its first 4, 5 and 6 bytes, kept by hash. Scoring runs forward and backward over each
whole text. The marginals give spans where toxic is likelier than not, and, through the largest
one and the sum of the likely ones, the document's score by a logistic curve fitted to the sample.
A text without such a span scores below ``UNFLAGGED``, whatever share of the sample is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from textloom.llm.common import cut, give_back, tidy
from textloom.llm.shingles import Hasher, groups, words_in

#: The sample to learn from: at most so many labelled documents of each class, the first by a hash of their key.
SAMPLE_TOXIC, SAMPLE_CLEAN = 800, 1200
#: and of these, in the same order, as many as have so many bytes of text together (one at least).
SAMPLE_BYTES = 48 << 20
PREFIXES = (4, 5, 6)
#: Marks: the likelihood ratio statistic and the ratio of shares that a word or beginning needs.
#: With few labels no key can reach the statistic; the field is then untrained and scores 0.
LEAST_G2, LEAST_ODDS = 25.0, 8.0
#: For training, texts are sequences of so many tokens; a gradient then has many of equal length.
#: It is summed up over blocks of so many tokens, for the driver's memory.
SEGMENT, BLOCK_TOKENS = 128, 1 << 17
ROUNDS, RATE, PENALTY = 80, 0.1, 1e-3
FLAGGED = 0.5
#: Texts without a flagged token score this times their place on the curve.
UNFLAGGED = 0.25
#: Texts of about so many bytes run side by side.
RUN_BYTES = 4 << 20
_SLOTS = 1 << 20


def token_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: text's number, begin, end, and hashes of the word and its beginnings (0: too short)."""
    low, start, stop = words_in(raw, offsets)
    hasher = Hasher(low)
    keys = np.zeros((len(start), 1 + len(PREFIXES)), np.uint64)
    keys[:, 0] = hasher.of(start, stop)
    for k, n in enumerate(PREFIXES, 1):
        long = stop - start > n
        keys[long, k] = hasher.of(start[long], start[long] + n) ^ np.uint64(n)
    return np.searchsorted(offsets, start, side="right") - 1, start, stop, keys


class Field:
    """A trained model: weights of features by hash, transitions, and the curve for documents."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, moves: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.bias, self.moves = keys[order], weights[order], bias, moves
        self.used = np.zeros(_SLOTS, bool)
        self.used[(self.keys & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        self.curve: np.ndarray | None = None  # untrained

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """Each token's score for toxic less that for not toxic."""
        out = np.full(len(keys), self.bias)
        if not len(self.keys):
            return out
        for k in range(keys.shape[1]):
            own = keys[:, k]
            some = np.flatnonzero(self.used[(own & np.uint64(_SLOTS - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, own[some]), len(self.keys) - 1)
            known = self.keys[at] == own[some]
            out[some[known]] += self.weights[at[known]]
        return out

    def marginals(self, evidence: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of toxic at each token; texts are ``evidence[first:first + count]``."""
        return marginals(evidence, first, count, self.moves)[0]

    def features(self, p: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """What the curve looks at, for each text."""
        most = np.zeros(n_texts)
        np.maximum.at(most, text, p)
        most = np.clip(most, 1e-4, 1 - 1e-4)
        likely = np.bincount(text, np.where(p >= FLAGGED, p, 0.0), minlength=n_texts)
        return np.stack([np.ones(n_texts), np.log(most / (1 - most)), np.log1p(likely)], axis=1)

    def scores(self, p: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        if self.curve is None:
            return np.zeros(n_texts)
        x = self.features(p, text, n_texts)
        at = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
        return np.where(x[:, 2] > 0, at, UNFLAGGED * at)


def marginals(evidence: np.ndarray, first: np.ndarray, count: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, and the forward and backward ratios of toxic to not toxic, of all sequences side by side.

    ``moves`` are the transition scores from and to (not toxic, toxic). In two states the ratios
    follow a recurrence of their own, so nothing under- or overflows.
    """
    (oo, ot), (to, tt) = np.exp(moves)
    x = np.exp(np.clip(evidence, -30, 30))
    ahead, behind = np.ones_like(x), np.ones_like(x)
    order = np.argsort(-count, kind="stable")
    begin, length = first[order], count[order]
    longest = int(length[0]) if len(length) else 0
    live = len(order) - np.searchsorted(length[::-1], np.arange(longest), side="right")
    f = np.ones(len(order))
    for i, n in enumerate(live):
        at = begin[:n] + i
        f[:n] = x[at] * ((tt * f[:n] + ot) / (to * f[:n] + oo) if i else 1.0)
        ahead[at] = f[:n]
    g = np.ones(len(order))
    for i in range(longest - 1, -1, -1):
        n = live[i]
        at = begin[:n] + i
        m = live[i + 1] if i + 1 < longest else 0
        held = x[at[:m] + 1] * g[:m]
        g[:m] = (to + tt * held) / (oo + ot * held)
        behind[at] = g[:n]
    odds = ahead * behind
    return odds / (1 + odds), ahead, behind


def mark_keys(ids: np.ndarray, word: np.ndarray, doc: np.ndarray, y: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are marks, and in how many documents each key is.

    ids: the keys of each word; word, doc: the distinct pairs of a word and a document.
    """
    n1, n0 = np.zeros(n_keys, np.int64), np.zeros(n_keys, np.int64)
    for column in ids.T:  # words share beginnings, so pairs are made distinct once more
        pairs = np.unique(column[word].astype(np.int64) * len(y) + doc)
        key, toxic = pairs // len(y), y[pairs % len(y)] == 1
        n1 += np.bincount(key[toxic], minlength=n_keys)
        n0 += np.bincount(key[~toxic], minlength=n_keys)
    t1, t0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    share = t1 / (t1 + t0)
    n = np.maximum(n1 + n0, 1)
    g2 = 2 * (n1 * np.log(np.maximum(n1, 1e-9) / (n * share)) + n0 * np.log(np.maximum(n0, 1e-9) / (n * (1 - share))))
    odds = ((n1 + 0.5) / (t1 + 1)) / ((n0 + 0.5) / (t0 + 1))
    return (g2 >= LEAST_G2) & (odds >= LEAST_ODDS), n1 + n0


def gradient(evidence: np.ndarray, target: np.ndarray, first: np.ndarray, count: np.ndarray, inner: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood: by each token's evidence, and by the moves ot, to and tt.

    ``inner`` is 1 at tokens that have one before them in their sequence.
    """
    p, ahead, behind = marginals(evidence, first, count, moves)
    held = np.exp(np.clip(evidence, -30, 30)) * behind
    before = np.concatenate([[1.0], ahead[:-1]])
    (oo, ot), (to, tt) = np.exp(moves)
    mass = np.stack([ot * held, before * to, before * tt * held]) / (oo + ot * held + before * (to + tt * held))
    was = np.concatenate([[0.0], target[:-1]])
    seen = np.stack([(1 - was) * target, was * (1 - target), was * target])
    return p - target, ((mass - seen) * inner).sum(axis=1)


def train(texts: list[str], labels: list[int]) -> Field:
    """The field fitted to whole texts and their labels; untrained if no key is a mark.

    Keys are a function of the word, so tokens are kept as numbers of distinct words.
    """
    y = np.asarray(labels, np.int64)
    parts, known = [], np.zeros((0, 1 + len(PREFIXES)), np.uint64)
    for lo, raw, offsets in groups(pa.array(texts, pa.string())):
        text, _, _, keys = token_keys(raw, offsets)
        parts.append(((text + lo).astype(np.int32), keys[:, 0].copy()))
        known = np.concatenate([known, keys])
        known = known[np.unique(known[:, 0], return_index=True)[1]]
    none = Field(np.zeros(0, np.uint64), np.zeros(0), -30.0, np.zeros((2, 2)))
    if not len(known):
        return none
    doc = np.concatenate([p[0] for p in parts])
    word = np.concatenate([np.searchsorted(known[:, 0], p[1]).astype(np.int32) for p in parts])
    del parts
    every, ids = np.unique(known, return_inverse=True)
    ids = ids.reshape(known.shape)
    pairs = np.unique(word.astype(np.int64) * len(y) + doc)
    marks, df = mark_keys(ids, pairs // len(y), pairs % len(y), y, len(every))
    del pairs
    marks &= every != 0
    target = (marks[ids].any(axis=1)[word] & (y[doc] == 1)).astype(float)
    if not target.any():
        return none
    kept = (df >= 3) & (every != 0) | marks
    feature = np.where(kept, np.cumsum(kept) - 1, kept.sum())[ids]
    n_features = int(kept.sum())
    # Sequences of at most SEGMENT tokens of one text.
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    first = np.flatnonzero(place % SEGMENT == 0)
    count = np.diff(np.append(first, len(doc)))
    inner = place % SEGMENT > 0
    del place
    ends = np.append(first, len(doc))
    cuts = np.unique(np.append(ends[np.searchsorted(first, np.arange(0, len(doc), BLOCK_TOKENS))], len(doc)))
    prior = np.clip(target.mean(), 1e-6, 0.5)
    theta = np.zeros(n_features + 2 + 3)  # features, none, bias, three moves
    theta[n_features + 1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights = theta[: n_features + 1]
        moves = np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
        by_word = weights[feature].sum(axis=1) + theta[n_features + 1]
        slope, of_word = np.zeros_like(theta), np.zeros(len(known))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = slice(lo, hi)
            some = slice(*np.searchsorted(first, (lo, hi)))
            error, by_move = gradient(by_word[word[own]], target[own], first[some] - lo, count[some], inner[own], moves)
            of_word += np.bincount(word[own], error, minlength=len(known))
            slope[-3:] += by_move
        slope[: n_features + 1] = np.bincount(feature.ravel(), np.repeat(of_word, feature.shape[1]), minlength=n_features + 1)
        slope[n_features + 1] = of_word.sum()
        slope = slope / len(first) + PENALTY * theta
        slope[n_features] = 0.0
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    moves = np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
    weights = theta[:n_features]
    strong = np.abs(weights) > 1e-3
    field = Field(every[kept][strong], weights[strong], float(theta[n_features + 1]), moves)
    field.curve = logistic(whole_features(field, field.evidence(known), word, doc, len(y)), y)
    return field


def whole_features(field: Field, by_word: np.ndarray, word: np.ndarray, doc: np.ndarray, n_texts: int) -> np.ndarray:
    """The features of whole texts, some texts at a time."""
    start = np.append(np.searchsorted(doc, np.arange(n_texts)), len(doc))
    parts, lo = [], 0
    while lo < n_texts:
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + BLOCK_TOKENS, side="right")) - 1)
        hi = min(hi, n_texts)
        own = slice(start[lo], start[hi])
        p = field.marginals(by_word[word[own]], start[lo:hi] - start[lo], np.diff(start[lo : hi + 1]))
        parts.append(field.features(p, doc[own] - lo, hi - lo))
        lo = hi
    return np.concatenate(parts)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """A logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: str) -> Column:
    """Rows that are never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES) -> Field:
    """Trains on at most ``toxic`` and ``clean`` labelled documents that are not held out.

    The sample is the first of each class by md5 of the key, as far as ``most_bytes`` of text go,
    so its size is bounded whatever the tables hold, and so is the model that is broadcast. A null
    label or key is no label; a document with both labels is clean, and of several texts under one
    key the least is taken. Without marks, as with few labels or none, the field is untrained.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).filter(F.col("_key").isNotNull() & F.col("_y").isNotNull() & ~held_out("_key"))
    order = [F.md5(F.col("_key").cast("string")), F.col("_key")]
    chosen = [known.filter(F.col("_y") == y).distinct().orderBy(*order).limit(n) for y, n in ((1, toxic), (0, clean))]
    sample = cut(chosen[0].union(chosen[1]).groupBy("_key").agg(F.min("_y").alias("_y")))
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_key"))
    sized = rows.groupBy("_doc", "_y").agg(F.max(F.octet_length("_text")).alias("_n")).orderBy(F.md5(F.col("_doc").cast("string")), "_doc").collect()
    held, within = 0, []
    for r in sized:
        held += r["_n"]
        if held <= most_bytes or not within:
            within.append(r["_doc"])
    if len(within) < len(sized):
        rows = rows.filter(F.col("_doc").isin(within))
    found = sorted((r["_doc"], r["_y"], r["_text"]) for r in rows.groupBy("_doc").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).collect())
    field = train([r[2] for r in found], [r[1] for r in found])
    del found
    give_back()
    return field


def score_toxicity(docs: DataFrame, field: Field, text: str = "text", score_as: str = "score", spans_as: str = "spans") -> DataFrame:
    """Adds the score (0 to 1) and the toxic spans (code points) of each whole text.

    Null and empty texts, and texts without words, get the score of a text without any mark, and
    no spans; an untrained field scores 0. A text without spans scores below ``UNFLAGGED``. Columns named like the new ones are replaced; other columns and repeated rows pass
    through. Rows are independent of each other.
    """
    columns = [c for c in docs.columns if c not in (score_as, spans_as)]
    narrow = docs.select(*columns)
    at = columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([*narrow.schema.fields, StructField(score_as, DoubleType()), StructField(spans_as, span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @tidy
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            pending, size = [], 0
            for lo, raw, offsets in groups(batch.column(at)):
                text_no, start, stop, keys = token_keys(raw, offsets)
                pending.append((lo, raw, offsets, text_no, start, stop, model.evidence(keys)))
                size += len(raw)
                if size >= RUN_BYTES:
                    finish(model, pending, scores, spans)
                    pending, size = [], 0
            finish(model, pending, scores, spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(spans, kind)], [*columns, score_as, spans_as])

    return narrow.mapInArrow(tag, schema)


def finish(model: Field, pending: list[tuple], scores: np.ndarray, spans: list[list]) -> None:
    """Scores and spans of the texts in ``pending``, all run side by side."""
    if not pending:
        return
    lo = pending[0][0]
    n = pending[-1][0] + len(pending[-1][2]) - 1 - lo
    text = np.concatenate([p[3] + p[0] - lo for p in pending])
    first = np.searchsorted(text, np.arange(n))
    p = model.marginals(np.concatenate([x[6] for x in pending]), first, np.diff(np.append(first, len(text))))
    scores[lo : lo + n] = model.scores(p, text, n)
    done = 0
    for base, raw, offsets, text_no, start, stop, evidence in pending:
        own = p[done : done + len(evidence)]
        done += len(evidence)
        for k in np.flatnonzero(own >= FLAGGED).tolist():
            t = int(text_no[k])
            begin = int(offsets[t])
            chars = lambda b: int(((raw[begin:b] & 0xC0) != 0x80).sum())  # noqa: B023, E731
            held = spans[base + t]
            if held and k and own[k - 1] >= FLAGGED and text_no[k - 1] == t:
                held[-1]["end"] = chars(int(stop[k]))
            else:
                held.append({"start": chars(int(start[k])), "end": chars(int(stop[k]))})


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans``, by a field learnt from ``labels`` (key, toxic)."""
    return score_toxicity(docs, learn(docs, labels, key, text), text)
