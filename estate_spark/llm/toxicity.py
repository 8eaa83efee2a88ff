"""A toxicity classifier regularised by counterfactuals.

A logistic regression over the words of a text and their prefixes (so that inflected and
compound forms share weights), each present or not, hashed to ``2 ** HASH_LOG2`` features.
For every training text a counterfactual is made: each identity term is swapped for another
of its group; a text without such a term gets two mentions of a group instead. The loss adds
``pairing`` times the squared difference of the two scores (before the sigmoid), so a group's
name carries no weight of its own and a neutral mention of it is no evidence.

The fit reads a bounded sample of labelled rows, ``SAMPLE`` of them by hash order of the key;
features are selected from it by how far their count in toxic texts is from chance
(``FEATURES`` at most, ``LEAST_AWAY`` at least), and only those reach the driver. Scoring is one narrow pass over whole
texts. Labels, language, source and key are no inputs of a score.

Defined results: a null text is empty; an empty text gets the score of the intercept; rows
with the same text get the same score; several labels of one key count as the highest; keys
without a text or labels without a value are not learned from; without both classes the score
is the share of toxic labels (0 without labels); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.llm import text as tx
from estate_spark.session import written

SAMPLE = 12_000                  # labelled rows of the fit
FEATURES = 3_000
LEAST_AWAY = 3.5                 # standard deviations from chance for a feature
HASH_LOG2 = 20
PREFIXES = (4, 5, 6)             # bytes
PAIRING = 1.0
RIDGE = 1e-5
STEPS, RATE = 400, 0.03
#: Identity terms by group; terms of a group are swapped for each other. A parameter of ``fit``.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "chinese", "mexican", "indian"),
    ("immigrants", "natives", "refugees"), ("deaf", "blind", "disabled"), ("old", "young"), ("transgender", "cisgender"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Classifier:
    features: np.ndarray         # sorted feature numbers
    weights: np.ndarray
    intercept: float


def swapped(text: str, groups=IDENTITY) -> str:
    """The text with every identity term swapped for the next of its group, case of the first
    letter kept; without a term, the text with a neutral mention behind it."""
    partner = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, partner), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def other(m: re.Match) -> str:
        new = partner[m[0].lower()]
        return new.capitalize() if m[0][0].isupper() else new

    out, n = pattern.subn(other, text)
    if n:
        return out
    names = sorted(partner)
    pick = sum(text.encode("utf-8", "replace")) % len(names)
    return f"{text} {names[pick]} {names[-1 - pick]}"


def features_of(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), each pair once, of lower-cased texts; ``wanted`` keeps only the
    features it is true for."""
    found = []
    shift = np.uint64(64 - HASH_LOG2)
    for h, owner in tx.word_parts(texts, PREFIXES):
        f = (h >> shift).astype(np.int64)
        if wanted is not None:
            m = wanted[f]
            f, owner = f[m], owner[m]
        found.append(np.unique((owner << HASH_LOG2) | f))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> HASH_LOG2, pairs & ((1 << HASH_LOG2) - 1)


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace").translate(tx.LOWER) for t in texts]


def _counts(sample: DataFrame) -> DataFrame:
    """feature, n, toxic: texts with a feature, and toxic ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros((2, 1 << HASH_LOG2), np.int64)
        for batch in tx.parts(batches):
            texts, labels = _lower(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist())
            for a, b in tx.batches_of(texts):
                owner, f = features_of(texts[a:b])
                np.add.at(n, f, 1)
                np.add.at(toxic, f[labels[a:b][owner] == 1], 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(toxic[at])], names=["feature", "n", "toxic"])

    parts = sample.select("text", "toxic").mapInArrow(count, "feature long, n long, toxic long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, limit: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``limit`` labelled rows, by hash order of the key; written."""
    order = F.xxhash64("doc_id")
    keys = (labels.filter(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(limit))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(keys), "doc_id")
    narrow = rows.select("doc_id", F.xxhash64("text").alias("version"), "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(limit)
    # one row per key and text, so a key with many rows can't outgrow the bound
    picked = (docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("version"))
              .join(F.broadcast(narrow), ["doc_id", "version"]).groupBy("doc_id", "version")
              .agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")))
    return written(picked.select("text", "toxic"), "toxicity-sample")


def fit(sample: DataFrame, groups=IDENTITY, pairing: float = PAIRING) -> Classifier:
    counts = _counts(sample)
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = total["n"], total["toxic"] or 0
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    expected = F.col("n") * F.lit(toxic / n)
    away = F.abs(F.col("toxic") - expected) / F.sqrt(expected + 1)
    top = counts.filter(away >= LEAST_AWAY).orderBy(away.desc(), "feature").limit(FEATURES).collect()
    named, _ = features_of(_lower([t for g in groups for t in g]))[::-1]
    features = np.unique(np.concatenate([np.array([r["feature"] for r in top], np.int64), named]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << HASH_LOG2, bool)
        wanted[features] = True
        for batch in tx.parts(batches):
            texts, labels = [t or "" for t in batch.column(0).to_pylist()], batch.column(1)
            sides = []
            for side in (texts, [swapped(t, groups) for t in texts]):
                low, packed = _lower(side), []
                for a, b in tx.batches_of(low):
                    owner, f = features_of(low[a:b], wanted)
                    at = np.searchsorted(features, f).astype("<u2")
                    packed += [x.tobytes() for x in np.split(at, np.searchsorted(owner, np.arange(1, b - a)))]
                sides.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays([labels, *sides], names=["toxic", "own", "other"])

    # at most SAMPLE rows of FEATURES two-byte numbers twice
    got = sample.select("text", "toxic").mapInArrow(rows, "toxic int, own binary, other binary").collect()
    y = np.array([r["toxic"] == 1 for r in got], float)
    own, other = ([np.frombuffer(bytes(r[c]), "<u2") for r in got] for c in ("own", "other"))
    weights, intercept = _descend(own, other, y, len(features), pairing)
    keep = np.abs(weights) > 1e-4
    return Classifier(features[keep], weights[keep], intercept)


def _descend(own: list[np.ndarray], other: list[np.ndarray], y: np.ndarray, size: int, pairing: float) -> tuple[np.ndarray, float]:
    """Adam on mean log loss + pairing * mean squared score difference + ridge."""
    def flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(x).astype(np.int64), np.repeat(np.arange(len(x)), [len(v) for v in x])

    (f, row), (f2, row2) = flat(own), flat(other)
    n = len(y)
    w, b = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for _ in range(STEPS):
        s = np.bincount(row, weights=w[f], minlength=n)
        gap = s - np.bincount(row2, weights=w[f2], minlength=n)
        e = (1 / (1 + np.exp(-(s + b))) - y) / n
        pull = 2 * pairing * gap / n
        g = np.bincount(f, weights=(e + pull)[row], minlength=size) - np.bincount(f2, weights=pull[row2], minlength=size) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * m / np.sqrt(v + 1e-12)
        gb = e.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= RATE * mb / np.sqrt(vb + 1e-12)
    return w, float(b)


def scores(texts: list[str | None], model: Classifier, table: np.ndarray | None = None) -> np.ndarray:
    """Probability of a toxic label for every text."""
    if table is None:
        table = weight_table(model)
    wanted = table != 0
    low, out = _lower(texts), []
    for a, b in tx.batches_of(low):
        owner, f = features_of(low[a:b], wanted)
        out.append(np.bincount(owner, weights=table[f], minlength=b - a))
    s = (np.concatenate(out) if out else np.zeros(0)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def weight_table(model: Classifier) -> np.ndarray:
    table = np.zeros(1 << HASH_LOG2, np.float32)
    table[model.features] = model.weights
    return table


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weight_table(model)
        for batch in tx.parts(batches):
            s = scores(batch.column(1).to_pylist(), model, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
