"""Scores of texts and vectors as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a JSON object with nothing but a score that begins with 0 or 1.
SCORE_OBJECT = r'\{\s*"score"\s*:\s*([01](?:\.\d+)?)\s*,?\s*\}'


def extract_score(answer: Column) -> Column:
    """The score in a judge's answer, 0 if there is none; values aren't limited."""
    return F.coalesce(F.regexp_extract(answer, SCORE_OBJECT, 1).try_cast("double"), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if a vector is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def windowed_similarity(whole: Column, windows: Column) -> Column:
    """Half the similarity of the whole texts and half the least one of the windows; the whole one alone without windows."""
    return F.coalesce((whole + F.array_min(windows)) / 2, whole)


def sigmoid(logit: Column, limit: float = 100.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(limit)), F.lit(-limit))))


def known(score: Column) -> Column:
    """NaN is no score."""
    return F.when(~F.isnan(score.cast("double")), score.cast("double"))


def mean_of(*scores: Column) -> Column:
    """The mean of the scores that are there; null if none is."""
    there = F.filter(F.array(*[known(s) for s in scores]), lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(there) > 0, total / F.size(there))


def keyword_overlap(keywords: Column, normalized: str) -> Column:
    """The share of the keywords that occur in the column ``normalized``, as parts of words too.

    Keywords are separated by a comma and a space and taken as they are, repeated ones counted.
    """
    keys = F.split(keywords, ", ", -1)
    hits = F.size(F.filter(keys, lambda k: F.contains(F.col(normalized), k)))
    return hits / F.size(keys)
