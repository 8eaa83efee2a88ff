"""Language identification by bit-sliced Bloom filters over n-grams.

A text is lower-cased; its words (all but ASCII non-letters) give the byte n-grams of
``SIZES`` that lie inside a word with a blank on either side. Training counts them per
language over all rows that have one. A language holds an n-gram if it makes up at least
``LEAST`` of the language's n-grams (so a language holds at most 1 / LEAST of them) and at
least ``NEAR`` of the n-gram's share in the language where it is most common.

The filter is one table of bit masks, a bit a language: the masks at an n-gram's ``PROBES``
places, and-ed, say at once which languages hold it. Every language's bits are a Bloom filter
of their own, whose rate of false hits follows from its fill. The n-grams of a text are looked
up and hits are counted per language; a count c of n becomes the share (c / n - f) / (1 - f),
f being the language's false rate. The largest share decides and is the score.

Languages lie in blocks of 64, whose masks take at most 8 MB (less with fewer languages);
``BLOCKS`` blocks are broadcast for one pass over the texts, more languages take more passes
in the same job, which hand on the best language so far. Words are looked up once per slice
of texts.

Defined results: a null text, one without a letter, or any text where nothing was learned is
``und`` with score 0; a text with no known n-gram gets the first language by name and score 0;
ties go to the first language by name; rows without a language or text are not learned from;
equal texts get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.llm import store
from estate_spark.llm import text as tx
from estate_spark.session import written

SIZES = (3, 4)                   # bytes of an n-gram, blanks included
LEAST = 2.0 ** -17
NEAR = 1 / 8
PROBES = 3
PIECES = 61                      # parts in which a table is built
BLOCK = 64                       # languages of a table
BLOCKS = 4                       # tables of a pass
FLUSH = 500_000                  # counted n-grams a task holds before it sends them
UNKNOWN = "und"

_PART = np.zeros(256, bool)      # bytes that part words: ASCII but for letters
_PART[:128] = True
_PART[65:91] = False
_PART[97:123] = False
_LETTER = regex.compile(r"\p{L}")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, its distinct word) and (distinct word, text) of every word of the texts."""
    h, owner, starts, ends = tx.words(texts, _PART)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    a, n = starts[first], (ends - starts)[first] + 2
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - begin[of]
    inner = (place > 0) & (place < n[of] - 1)
    own = np.full(len(of), 0x20, np.uint64)
    own[inner] = buffer[a[of[inner]] + place[inner] - 1]
    left = n[of] - place                                   # bytes from here to the word's end
    keys, words = [], []
    for size in SIZES:
        at = np.flatnonzero(left >= size)
        key = np.full(len(at), size << 56, np.uint64)
        for i in range(size):
            key |= own[at + i] << np.uint64(8 * i)
        keys.append(key)
        words.append(of[at])
    return np.concatenate(keys), np.concatenate(words), word, owner


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language and a text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for name, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in tx.parts(batches):
            names, texts = batch.column(0).to_pylist(), _lower(batch.column(1).to_pylist())
            for a, b in tx.batches_of(texts):
                langs, number = np.unique(np.array(names[a:b], object).astype(str), return_inverse=True)
                key, of, word, owner = grams(texts[a:b])
                for i, name in enumerate(langs.tolist()):
                    times = np.bincount(word[number[owner] == i], minlength=int(of.max(initial=-1)) + 1)[of]
                    mine, old = times > 0, held.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    keys, inverse = np.unique(np.concatenate([old[0], key[mine]]), return_inverse=True)
                    total = np.bincount(inverse, weights=np.concatenate([old[1], times[mine]]), minlength=len(keys))
                    held[name] = (keys, total.astype(np.int64))
                size = sum(len(k) for k, _ in held.values())
                if size > FLUSH:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    languages: list[str]         # sorted
    slots: int                   # of a piece, a power of two
    tables: DataFrame            # block, piece, bits


def _places(keys: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The probes of each n-gram inside its piece."""
    h = tx.mix(keys)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * (tx.mix(h ^ _STEP) | np.uint64(1))) & np.uint64(slots - 1)).astype(np.int64)


def _kind(languages: int) -> np.dtype:
    """The narrowest mask of so many languages."""
    return np.dtype(f"<u{next(w for w in (1, 2, 4, 8) if languages <= 8 * w)}")


def train(docs: DataFrame) -> Model:
    """Filters of all languages among the rows of ``docs`` (lang, text)."""
    spark = docs.sparkSession
    counted = written(counts(docs), "language-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    common = counted.join(totals, "lang").withColumn("share", share).filter(F.col("share") >= LEAST)
    most = F.max("share").over(Window.partitionBy("gram"))     # a row a language at most
    held = written(common.withColumn("most", most).filter(F.col("share") >= NEAR * F.col("most")).select("lang", "gram"), "language-holds")
    sizes = held.groupBy("lang").count().collect()             # a row a language
    languages = sorted(r["lang"] for r in sizes)
    largest = max((r["count"] for r in sizes), default=1)      # at most 1 / LEAST
    slots = 1 << max(6, (8 * largest // PIECES).bit_length())
    numbers = spark.createDataFrame([(x, i // BLOCK, i % BLOCK) for i, x in enumerate(languages)], "lang string, block int, bit int")
    masks = held.join(numbers, "lang").groupBy("block", "gram").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in store.runs(batches, ["block", "piece"]):
            block, piece = run.column("block")[0].as_py(), run.column("piece")[0].as_py()
            table = np.zeros(slots, np.uint64)
            mask = run.column("mask").to_numpy().view(np.uint64)
            for at in _places(run.column("gram").to_numpy().view(np.uint64), slots):
                np.bitwise_or.at(table, at, mask)
            kind = _kind(min(BLOCK, len(languages) - block * BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([piece], pa.int32()), pa.array([table.astype(kind).tobytes()], pa.binary())],
                                             names=["block", "piece", "bits"])

    dealt = masks.withColumn("piece", F.pmod("gram", F.lit(PIECES)).cast("int")).repartition("block", "piece").sortWithinPartitions("block", "piece")
    return Model(languages, slots, written(dealt.mapInArrow(build, "block int, piece int, bits binary"), "language-tables"))


class Block:
    """The filter of up to 64 languages."""

    def __init__(self, languages: list[str], slots: int, pieces: list[tuple[int, bytes]]):
        kind = _kind(len(languages))
        self.languages, self.slots = languages, slots
        self.table = np.zeros(PIECES * slots, kind)
        for piece, bits in pieces:
            self.table[piece * slots:(piece + 1) * slots] = np.frombuffer(bits, kind)
        # false rate of a language: the mean over its pieces, which share n-grams evenly
        fill = np.stack([((self.table >> kind.type(l)) & kind.type(1)).reshape(PIECES, slots).mean(1) for l in range(len(languages))])
        self.false = (fill ** PROBES).mean(1)

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """The mask of all languages that hold each n-gram."""
        base = (keys % np.uint64(PIECES)).astype(np.int64) * self.slots
        out = None
        for at in _places(keys, self.slots):
            here = self.table[base + at]
            out = here if out is None else out & here
        return out

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Corrected share of the n-grams of each text that each language holds."""
        key, of, word, owner = grams(texts)
        words, n = int(word.max(initial=-1)) + 1, len(texts)
        mask = self.languages_of(key)
        one = mask.dtype.type(1)
        every = np.maximum(np.bincount(owner, weights=np.bincount(of, minlength=words)[word], minlength=n), 1)
        out = np.empty((n, len(self.languages)))
        for l in range(len(self.languages)):
            hits = np.bincount(of[(mask >> mask.dtype.type(l)) & one == 1], minlength=words)
            out[:, l] = np.bincount(owner, weights=hits[word], minlength=n) / every
        return (out - self.false) / (1 - self.false)


def blocks(model: Model, numbers: list[int]) -> list[Block]:
    got: dict[int, list] = {b: [] for b in numbers}
    for r in model.tables.filter(F.col("block").isin(numbers)).collect():
        got[r["block"]].append((r["piece"], bytes(r["bits"])))
    return [Block(model.languages[b * BLOCK:(b + 1) * BLOCK], model.slots, p) for b, p in got.items()]


def best(texts: list[str | None], filters: list[Block], held: list[tuple[str, float]] | None = None) -> list[tuple[str, float]]:
    """(language, score) of every text, given what earlier filters found."""
    low, out = _lower(texts), []
    for a, b in tx.batches_of(low):
        lang = np.array([x for x, _ in held[a:b]], object) if held else np.full(b - a, UNKNOWN, object)
        score = np.array([s for _, s in held[a:b]]) if held else np.full(b - a, -1.0)
        for f in filters:
            s = np.clip(f.shares(low[a:b]), 0, 1)
            top = s.argmax(1)
            value = s[np.arange(b - a), top]
            better = value > score
            lang[better] = np.array(f.languages, object)[top[better]]
            score[better] = value[better]
        out += zip(lang.tolist(), score.tolist())
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(-1.0).alias("score"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, lang_pred string, score double"
    number = -(-len(model.languages) // BLOCK)
    for a in range(0, number, BLOCKS):
        packed = spark.sparkContext.broadcast(blocks(model, list(range(a, min(a + BLOCKS, number)))))
        last = a + BLOCKS >= number

        def run(batches: Iterator[pa.RecordBatch], packed=packed, first=a == 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in tx.parts(batches):
                texts = batch.column(1).to_pylist()
                held = None if first else list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
                lang, score = zip(*best(texts, packed.value, held))
                if last:
                    know = [bool(t and _LETTER.search(t)) for t in texts]
                    lang = [x if k else UNKNOWN for x, k in zip(lang, know)]
                    score = [s if k else 0.0 for s, k in zip(score, know)]
                text = pa.nulls(len(texts), pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "text", "lang_pred", "score"])

        rows = rows.mapInArrow(run, schema)
    if not number:
        rows = rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    return rows.drop("text")
