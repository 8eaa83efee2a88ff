"""N-gram Jaccard join by MinHash banding.

A text's set holds the hashes of its runs of ``WORDS`` words (words part at blanks, A-Z
lower-cased); a text of fewer words, but not none, has the run of all its words. Texts with equal
sets are copies: they meet by the set's digest and one of them stands for all. Bands of the
MinHash signature bring candidates together; ``choose_bands`` takes the longest bands that keep
the wanted recall at the threshold. Every candidate pair is verified on the full sets.

No pair is emitted as a row. The rows of a band bucket meet in units of at most two blocks of
``BLOCK`` texts, a larger bucket is cut into blocks and each two of them meet in a unit of their
own; inside a unit pairs are verified on arrays, each pair in the first band that both share, and
what leaves a unit is a row a member: its number of links and the edges of a spanning forest.
Buckets with the same members as a bucket of an earlier band are left out, since their pairs are
verified there. Components come from the forests (``components``).

Defined results: null texts and texts without words have no set, link to nothing and form a class
each; repeated rows are copies of each other; classes and links don't depend on row order; an
empty table gives an empty result; other columns are ignored (``keep_one`` returns them all).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm import bitmap, store
from estate_spark.llm import text as tx
from estate_spark.llm.components import components
from estate_spark.session import written

WORDS, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.999, 128
BLOCK = 512
_ODD = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1B54A32D192ED03)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands with that recall at the threshold within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): the sorted distinct n-gram hashes of text i are hashes[borders[i]:borders[i + 1]]."""
    h, owner, _, _ = tx.words(texts)
    n = len(texts)
    size = np.bincount(owner, minlength=n)
    starts = np.cumsum(size) - size
    grams, owners = [], []
    long = size >= words
    if len(h) >= words:
        at = np.flatnonzero(owner[:len(owner) - words + 1] == owner[words - 1:])
        g = h[at]
        for k in range(1, words):
            g = tx.mix(g * _STEP + h[at + k])
        grams.append(g)
        owners.append(owner[at])
    for i in np.flatnonzero((size > 0) & ~long):
        g = h[starts[i]:starts[i] + 1]
        for k in range(1, size[i]):
            g = tx.mix(g * _STEP + h[starts[i] + k:starts[i] + k + 1])
        grams.append(tx.mix(g + np.uint64(size[i])))
        owners.append(np.array([i]))
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    g, o = np.concatenate(grams), np.concatenate(owners)
    order = np.lexsort((g, o))
    g, o = g[order], o[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    return g, np.searchsorted(o, np.arange(n + 1))


def band_hashes(hashes: np.ndarray, borders: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row a non-empty set, a column a band."""
    starts = borders[:-1][np.diff(borders) > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    if not len(starts):
        return out
    for b in range(bands):
        value = np.full(len(starts), b, np.uint64)
        for r in range(rows):
            value = tx.mix(value * _STEP + np.minimum.reduceat(hashes * _ODD[b * rows + r], starts))
        out[:, b] = value
    return out


def _lower(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace").translate(tx.LOWER) for t in column.to_pylist()]


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """row, doc_id, t (the text's hash), set_id (digest of the set) and bands, both null without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.parts(batches):
            texts = _lower(batch.column("text"))
            for a, b in tx.batches_of(texts):
                hashes, borders = shingle_sets(texts[a:b], words)
                sig = iter(band_hashes(hashes, borders, bands, rows))
                ids, signs = [], []
                for i, j in zip(borders[:-1].tolist(), borders[1:].tolist()):
                    ids.append(hashlib.md5(hashes[i:j].tobytes()).digest() if j > i else None)
                    signs.append(next(sig).tobytes() if j > i else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "t")), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())],
                                                 names=["row", "doc_id", "t", "set_id", "bands"])

    text = F.col("text").cast("string")
    rows_ = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("t"), text.alias("text"))
    return rows_.mapInArrow(sign, f"row long, doc_id {dict(rows_.dtypes)['doc_id']}, t long, set_id binary, bands binary")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """set_id, n_docs, bands and grams (the set's sorted hashes) of representatives' texts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.parts(batches):
            texts = _lower(batch.column("text"))
            for a, b in tx.batches_of(texts):
                hashes, borders = shingle_sets(texts[a:b], words)
                grams = [hashes[i:j].tobytes() for i, j in zip(borders[:-1].tolist(), borders[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("set_id", "n_docs", "bands")), pa.array(grams, pa.binary())],
                                                 names=["set_id", "n_docs", "bands", "grams"])

    return texts.select("set_id", "n_docs", "bands", "text").mapInArrow(cut, "set_id binary, n_docs long, bands binary, grams binary")


def _verify(threshold: float, bands: int):
    """Units -> a row a member: set_id, links, doc_links, edge (a linked set or null)."""
    def members(unit: pa.Table) -> pa.RecordBatch | None:
        ids = unit.column("set_id").to_pylist()
        m = len(ids)
        if m < 2:
            return None
        band = unit.column("band")[0].as_py()
        side = np.array(unit.column("block").to_pylist())
        cross = unit.column("low")[0].as_py() != unit.column("high")[0].as_py()
        sign = np.frombuffer(b"".join(unit.column("bands").to_pylist()), np.uint64).reshape(m, bands)
        docs = np.array(unit.column("n_docs").to_pylist(), np.int64)
        data = unit.column("grams").to_pylist()
        size = np.array([len(x) // 8 for x in data])
        flat = np.frombuffer(b"".join(data), np.uint64)
        starts = np.cumsum(size) - size
        column = np.unique(flat, return_inverse=True)[1]
        mark = np.zeros(column.max() + 1, bool)
        links, doc_links, root = np.zeros(m, np.int64), np.zeros(m, np.int64), list(range(m))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = [None] * m
        for a in range(m - 1):
            rest = slice(a + 1, m)
            ok = np.minimum(size[a], size[rest]) >= threshold * np.maximum(size[a], size[rest])
            if cross:
                ok &= side[rest] != side[a]
            if band:
                ok &= ~(sign[rest, :band] == sign[a, :band]).any(1)
            if not ok.any():
                continue
            at = np.flatnonzero(ok) + a + 1
            mine = column[starts[a]:starts[a] + size[a]]
            mark[mine] = True
            if len(at) * 8 < m - a:
                shared = np.array([mark[column[starts[b]:starts[b] + size[b]]].sum() for b in at])
            else:
                shared = np.add.reduceat(mark[column[starts[a + 1]:]].astype(np.int32), starts[rest] - starts[a + 1])[at - a - 1]
            mark[mine] = False
            linked = at[shared >= threshold * (size[a] + size[at] - shared) - 1e-9]
            links[a] += len(linked)
            doc_links[a] += docs[linked].sum()
            links[linked] += 1
            doc_links[linked] += docs[a]
            for b in linked.tolist():
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        for i in range(m):
            r = find(i)
            edges[i] = ids[r] if r != i else None
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.binary()), pa.array(links[some]), pa.array(doc_links[some]),
                                           pa.array([edges[i] for i in some], pa.binary())], names=["set_id", "links", "doc_links", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for unit in store.runs(batches, ["band", "bucket", "low", "high"]):
            if (out := members(unit)) is not None:
                held.append(out)
                n += out.num_rows
                if n > 5000:
                    yield from held
                    held, n = [], 0
        yield from held

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """row, doc_id, class_id (smallest doc_id of the component), n_copies (documents with its set,
    itself too), n_links (other documents at or above the threshold), n_text_links (other sets),
    kept (true for one row of each class: the smallest doc_id, of equal ones the first row)."""
    bands, rows = choose_bands(threshold, recall)
    sig = written(signatures(docs, bands, rows, words), "near-signatures")
    one = F.struct("doc_id", "row", "t")
    sets = sig.filter("set_id is not null").groupBy("set_id").agg(
        F.count("*").alias("n_docs"), F.min(one).alias("first"), F.first("bands").alias("bands"))
    sets = written(sets, "near-sets")
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.substring(F.hex("bands"), i * 16 + 1, F.lit(16)).alias("bucket")))
    entries = sets.select("set_id", F.explode(cut).alias("x")).select("set_id", "x.band", F.xxhash64("x.bucket").alias("bucket"))
    # a bucket's members as two fingerprints; among buckets with the same members the first band stays
    print_ = F.xxhash64("set_id")
    buckets = (entries.groupBy("band", "bucket").agg(
        F.count("*").alias("size"), F.bit_xor(print_).alias("p"), F.sum(F.shiftrightunsigned(print_, 32)).alias("q")).filter("size > 1"))
    buckets = buckets.groupBy("size", "p", "q").agg(F.min(F.struct("band", "bucket")).alias("x")).select("size", "x.*")
    members = entries.join(buckets, ["band", "bucket"])
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id", "size"), F.col("blocks")).cast("int"))
    units = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("set_id", "band", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    units = written(units, "near-units")
    # the texts that stand for the sets in the units, found by a bitmap and then by their hash
    wanted = units.select("set_id").distinct().join(sets.select("set_id", "n_docs", "bands", F.col("first.t").alias("t")), "set_id")
    wanted = written(wanted, "near-wanted")
    text = F.col("text").cast("string")
    texts = bitmap.passing(docs.select(F.xxhash64(text).alias("t"), text.alias("text")), "t", wanted.select("t"))
    texts = texts.groupBy("t").agg(F.first("text").alias("text"))
    full = _sets(wanted.join(texts, "t"), words)
    loaded = units.join(full, "set_id").repartition("band", "bucket", "low", "high").sortWithinPartitions("band", "bucket", "low", "high", "set_id")
    links = written(loaded.mapInArrow(_verify(threshold, bands), "set_id binary, links long, doc_links long, edge binary"), "near-links")
    roots = components(links.filter("edge is not null").select(F.col("set_id").alias("a"), F.col("edge").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    placed = (sets.select("set_id", "n_docs", "first").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
              .join(counts, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("class"))
    placed = placed.join(firsts, "root").select("set_id", "n_docs", "links", "doc_links", "class")
    out = sig.select("row", "doc_id", "set_id").join(placed, "set_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "row", "doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"),
        F.coalesce("n_docs", F.lit(1)).cast("bigint").alias("n_copies"),
        (F.coalesce("n_docs", F.lit(1)) - 1 + F.coalesce("doc_links", zero)).cast("bigint").alias("n_links"),
        F.coalesce("links", zero).alias("n_text_links"),
        F.coalesce(F.col("class.row") == F.col("row"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, all columns unchanged. ``docs`` must be a scan of files, whose
    rows keep their places between two reads; a row that doesn't fit its key stops the job."""
    found = join(docs, **options).filter("not kept").select("row", F.col("doc_id").alias("_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    # a removed row has a match; its key must be the one that was judged
    fits = F.col("_key").eqNullSafe(F.col("_doc.doc_id"))
    gone = F.col("_hit").isNotNull()
    out = rows.join(found.select(F.col("row").alias("_row"), "_key", F.lit(True).alias("_hit")), "_row", "left")
    return (out.filter(F.when(~gone, True).when(fits, False).otherwise(F.raise_error(F.lit("rows moved between two reads"))))
            .select("_doc.*"))
