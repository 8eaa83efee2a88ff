"""Language-model scores from a log-frequency Bloom filter.

Model: P(w | v) = max(c(v,w) - D, 0) / c(v) + g(v) * P(w) for every word pair of the
training texts, with g(v) the mass that the discounted pairs of v leave and
P(w) = (c(w) + A) / (N + A (V + 1)). The filter holds, for every such pair and every word with
such pairs, its count on a logarithmic scale, and g(v) likewise: an entry of level q is inserted
under q hashes, and a count is read by probing levels 1, 2, ... until one is missing. Counts
of pairs read as the lower end of their level, counts of histories as the upper one, and g
is rounded down, so that quantising never adds mass.

Scale. Words are 64-bit hashes. Each task counts its texts and sends, per hash bucket, packed
arrays, so the shuffles move compact blocks in place of a row a word; a frequent word is one
number per task. Pairs are bucketed by their history, those of very frequent histories by the
pair. Every bucket builds its own piece of the filter, sized by its entries. What is broadcast
is bounded: at most ``2 ** FREQUENT_LOG2`` frequent words (each has that share of all tokens), at
most ``2 ** HEAVY_LOG2`` heavy histories, and filter pieces of ``SEGMENT_BYTES`` (or one piece);
a larger filter is used in several passes, each scoring the words whose history it covers. Exact counts
of all other words reach their occurrences by a shuffle on the word's hash.

Defined results: a null text is empty and has its end token; a null key counts as the empty
string; repeated rows are scored each; without training tokens every probability is uniform;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm import store
from estate_spark.llm import text as tx
from estate_spark.session import written

ADD = 0.1                        # A of the unigram base
DISCOUNT = 0.75                  # D
LEAST_PAIR = 1                   # the count of level 1: every pair is held
GROWTH, LEFT_GROWTH = 1.2, 1.1   # ratio of levels: of counts (where that is a step above one), of g
BITS, PROBES = 12, 8             # of the filter: bits an insertion, hashes a probe
FREQUENT_LOG2, HEAVY_LOG2 = 20, 12
SEGMENT_BYTES = 128 << 20
FLUSH = 800_000                  # counted entries a task holds before it sends them
PROBED = 1 << 15                 # entries probed at once
END = np.uint64(0x5851F42D4C957F2D)
_A, _B, _C = np.uint64(0xD1342543DE82EF95), np.uint64(0xA3EC647659359ACD), np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)


def _edges() -> np.ndarray:
    out, x = [], LEAST_PAIR
    while x < 1 << 50:
        out.append(x)
        x = max(x + 1, int(x * GROWTH))
    return np.array(out, np.int64)


EDGES = _edges()                 # level q stands for counts from EDGES[q - 1] on


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, text number): every text's words and its end; the token before
    the first is an end."""
    h, owner, _, _ = tx.words(texts)
    n = len(h) + len(texts)
    token, number = np.full(n, END), np.empty(n, np.int64)
    at = np.arange(len(h)) + owner
    token[at] = h
    size = np.bincount(owner, minlength=len(texts)) + 1
    number[:] = np.repeat(np.arange(len(texts)), size)
    return token, np.concatenate([[END], token[:-1]]).astype(np.uint64), number


def _bucket(h: np.ndarray, log2: int) -> np.ndarray:
    return (tx.mix(h ^ _C) >> np.uint64(64 - log2)).astype(np.int64) if log2 else np.zeros(len(h), np.int64)


def _pair(v: np.ndarray, w32: np.ndarray) -> np.ndarray:
    return tx.mix(v * _A + w32)


def _short(w: np.ndarray) -> np.ndarray:
    return tx.mix(w * _B) & _LOW


def _isin(values: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, index) of values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values, at


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[list[bytes], int, int]]:
    for lo in range(0, batch.num_rows, 1500):
        part = batch.column(column).slice(lo, 1500).to_pylist()
        texts = [(t or "").encode("utf-8", "replace").translate(tx.LOWER) for t in part]
        for a, b in tx.batches_of(texts, 4 << 20):
            yield texts[a:b], lo + a, lo + b


def _rows(names: list[str], cols: list) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.string(), "origin": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols)], names=names)


def _cut(bucket_sorted: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, a, b) of the runs of a sorted array."""
    at = np.flatnonzero(np.diff(bucket_sorted)) + 1
    starts, ends = np.concatenate([[0], at]), np.concatenate([at, [len(bucket_sorted)]])
    return [(int(bucket_sorted[a]), int(a), int(b)) for a, b in zip(starts, ends)] if len(bucket_sorted) else []


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


@dataclass
class Model:
    log2: int                    # of the number of buckets
    tokens: int
    types: int
    frequent: tuple              # sorted hashes, counts
    heavy: tuple                 # sorted hashes, counts, g
    unigrams: DataFrame          # bucket, keys, counts: all training words
    pieces: DataFrame            # bucket, bits: the filter


def _count_words(docs: DataFrame, log2: int) -> DataFrame:
    def count(batches):
        held, size = [], 0

        def send():
            keys, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            order = np.argsort(_bucket(keys, log2), kind="stable")
            keys, n = keys[order], n[order]
            for b, i, j in _cut(_bucket(keys, log2)):
                yield _rows(["bucket", "keys", "counts"], [[b], [keys[i:j].tobytes()], [n[i:j].astype("<u4" if n[i:j].max() < 1 << 32 else "<u8").tobytes()]])

        for batch in batches:
            for texts, _, _ in _batches(batch, "text"):
                held.append(np.unique(tokens_of(texts)[0], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield from send()
                        held, size = [], 0
        if held:
            yield from send()

    return docs.select("text").mapInArrow(count, "bucket int, keys binary, counts binary")


def _numbers(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint64)
    return k, np.frombuffer(counts, "<u4" if len(counts) == 4 * len(k) else "<u8").astype(np.int64)


def _merge_words(parts: DataFrame) -> DataFrame:
    def merge(batches):
        for run in store.runs(batches, ["bucket"]):
            got = [_numbers(k, c) for k, c in zip(run.column("keys").to_pylist(), run.column("counts").to_pylist())]
            keys, n = _summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))
            yield pa.RecordBatch.from_arrays([
                pa.array([run.column("bucket")[0].as_py()], pa.int32()), pa.array([keys.tobytes()], pa.binary()),
                pa.array([n.astype("<u8").tobytes()], pa.binary()), pa.array([int(n.sum())]), pa.array([len(keys)])],
                names=["bucket", "keys", "counts", "tokens", "types"])

    return (parts.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(merge, "bucket int, keys binary, counts binary, tokens long, types long"))


def _count_pairs(docs: DataFrame, log2: int, heavy: np.ndarray) -> DataFrame:
    """Blocks of pairs: histories with run lengths, 32 bits of each follower, counts above one."""
    def count(batches):
        held, size = [], 0

        def send():
            v, w, n = (np.concatenate(x) for x in zip(*held))
            keys, first, inverse = np.unique(_pair(v, w), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=n).astype(np.int64)
            v, w = v[first], w[first]
            bucket = np.where(_isin(v, heavy)[0], _bucket(keys, log2), _bucket(v, log2))
            order = np.lexsort((w, v, bucket))
            v, w, n, bucket = v[order], w[order], n[order], bucket[order]
            for b, i, j in _cut(bucket):
                own, length = np.unique(v[i:j], return_counts=True)
                more = np.flatnonzero(n[i:j] > 1)
                yield _rows(["bucket", "kind", "keys", "counts", "follow", "more"], [
                    [b], ["pairs"], [own.tobytes()], [length.astype("<u4").tobytes()], [w[i:j].astype("<u4").tobytes()],
                    [np.concatenate([more, n[i:j][more]]).astype("<u4").tobytes()]])

        for batch in batches:
            for texts, _, _ in _batches(batch, "text"):
                token, before, _ = tokens_of(texts)
                w = _short(token)
                _, first, n = np.unique(_pair(before, w), return_index=True, return_counts=True)
                held.append((before[first], w[first], n))
                size += len(n)
                if size > FLUSH:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return docs.select("text").mapInArrow(count, "bucket int, kind string, keys binary, counts binary, follow binary, more binary")


def insertions(keys: np.ndarray, levels: np.ndarray, space: int) -> np.ndarray:
    """Hashes under which entries of these levels are inserted."""
    each = np.repeat(keys, levels)
    starts = np.cumsum(levels) - levels
    level = np.arange(len(each)) - np.repeat(starts, levels) + 1
    return tx.mix(each + np.full(1, space, np.uint64) * _B + level.astype(np.uint64) * _C)


def _step(h: np.ndarray) -> np.ndarray:
    """How far an entry's probes lie apart."""
    return tx.mix(h ^ _A) | np.uint64(1)


def _positions(h: np.ndarray, step: np.ndarray, size: np.ndarray | int, i: int) -> np.ndarray:
    return (h + np.uint64(i) * step) % np.asarray(size, np.uint64)


def filter_piece(hashes: np.ndarray) -> bytes:
    size = max(64, -(-len(hashes) * BITS // 64) * 64)
    bits, step = np.zeros(size, bool), _step(hashes)
    for i in range(PROBES):
        bits[_positions(hashes, step, size, i)] = True
    return np.packbits(bits, bitorder="little").tobytes()


PAIR, COUNT, LEFT = 1, 2, 3      # name spaces of the filter


def _level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, n, side="right")


def _left_level(g: np.ndarray) -> np.ndarray:
    return np.ceil(-np.log(np.maximum(g, 1e-12)) / np.log(LEFT_GROWTH) - 1e-9).astype(np.int64)


def _build(pairs: DataFrame, unigrams: DataFrame, heavy: np.ndarray) -> DataFrame:
    """bucket, bits, heavy words and the mass their pairs take here."""
    words = unigrams.select("bucket", F.lit("words").alias("kind"), "keys", "counts",
                            F.lit(None).cast("binary").alias("follow"), F.lit(None).cast("binary").alias("more"))

    def merge(batches):
        for run in store.runs(batches, ["bucket"]):
            held, known = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for kind, keys, counts, follow, more in zip(*[run.column(c).to_pylist() for c in ("kind", "keys", "counts", "follow", "more")]):
                if kind == "words":
                    known = _numbers(keys, counts)
                    continue
                w = np.frombuffer(follow, "<u4").astype(np.uint64)
                n = np.ones(len(w), np.int64)
                extra = np.frombuffer(more, "<u4").astype(np.int64)
                n[extra[:len(extra) // 2]] = extra[len(extra) // 2:]
                held.append((np.repeat(np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u4")), w, n))
            if held:
                v, w, n = (np.concatenate(x) for x in zip(*held))
                keys, first, inverse = np.unique(_pair(v, w), return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=n).astype(np.int64)
                v = v[first]
            else:
                keys, n, v = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            own, inverse = np.unique(v, return_inverse=True)
            mass = np.bincount(inverse, weights=n - DISCOUNT, minlength=len(own))
            of_heavy = _isin(own, heavy)[0]
            plain, taken = own[~of_heavy], mass[~of_heavy]
            at = _isin(plain, known[0])[1]
            c = known[1][at] if len(plain) else np.zeros(0, np.int64)
            hashes = np.concatenate([insertions(keys, _level(n), PAIR), insertions(plain, _level(c), COUNT),
                                     insertions(plain, _left_level(1 - taken / np.maximum(c, 1)), LEFT)])
            yield pa.RecordBatch.from_arrays([
                pa.array([run.column("bucket")[0].as_py()], pa.int32()), pa.array([filter_piece(hashes)], pa.binary()),
                pa.array([own[of_heavy].view(np.int64).tolist()], pa.list_(pa.int64())),
                pa.array([mass[of_heavy].tolist()], pa.list_(pa.float64()))], names=["bucket", "bits", "heavy", "mass"])

    rows = pairs.unionByName(words).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(merge, "bucket int, bits binary, heavy array<long>, mass array<double>")


def train(docs: DataFrame, log2: int | None = None) -> Model:
    """Fit on all rows of ``docs`` (column text)."""
    spark = docs.sparkSession
    if log2 is None:
        log2 = min(14, max(3, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    unigrams = written(_merge_words(_count_words(docs, log2)), "lm-words")
    total = unigrams.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = int(total["tokens"] or 0), int(total["types"] or 0)

    def above(least: int) -> tuple[np.ndarray, np.ndarray]:
        def pick(batches):
            for batch in batches:
                for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    keys, n = _numbers(k, c)
                    m = n >= least
                    if m.any():
                        yield _rows(["keys", "counts"], [[keys[m].tobytes()], [n[m].astype("<u8").tobytes()]])

        got = [_numbers(bytes(r["keys"]), bytes(r["counts"])) for r in unigrams.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()]
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(keys)
        return keys[order], n[order]

    # at most 2^20 words can have 2^-20 of all tokens each
    frequent = above(max(2, -(-tokens >> FREQUENT_LOG2)))
    m = frequent[1] >= max(2, -(-tokens >> HEAVY_LOG2))
    heavy, heavy_n = frequent[0][m], frequent[1][m]
    pieces = written(_build(_count_pairs(docs, log2, heavy), unigrams, heavy), "lm-filter")
    taken = (pieces.select(F.explode(F.arrays_zip("heavy", "mass")).alias("x")).groupBy(F.col("x.heavy").alias("v"))
             .agg(F.sum("x.mass").alias("mass")).collect())
    mass = np.zeros(len(heavy))
    for r in taken:
        mass[_isin(np.array([r["v"]], np.int64).view(np.uint64), heavy)[1]] = r["mass"]
    return Model(log2, tokens, types, frequent, (heavy, heavy_n, 1 - mass / np.maximum(heavy_n, 1)), unigrams, pieces.select("bucket", "bits"))


class Filter:
    """Probes of the pieces of some buckets, which lie behind each other in one array."""

    def __init__(self, pieces: Iterable[tuple[int, bytes]], log2: int, total: int):
        """``total``: the pieces' bytes together; they are read one by one."""
        self.size, self.start = np.zeros(1 << log2, np.int64), np.zeros(1 << log2, np.int64)
        self.bits = np.empty(total, np.uint8)
        at = 0
        for b, p in pieces:
            self.size[b], self.start[b] = 8 * len(p), 8 * at
            self.bits[at:at + len(p)] = np.frombuffer(p, np.uint8)
            at += len(p)

    def levels(self, keys: np.ndarray, bucket: np.ndarray, space: int) -> np.ndarray:
        """The level of each entry, 0 if it has none. An entry of level q is there under levels 1
        to q, so doubling and then halving steps find q in about 2 log2 q probes. Works through
        slices that a core's cache holds."""
        parts = [self._levels(keys[i:i + PROBED], bucket[i:i + PROBED], space) for i in range(0, len(keys), PROBED)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _levels(self, keys: np.ndarray, bucket: np.ndarray, space: int) -> np.ndarray:
        low = np.zeros(len(keys), np.int64)
        high = np.where(self.size[bucket] > 0, 1 << 20, 1)
        live = np.flatnonzero(high > 1)
        while len(live):
            a, b = low[live], high[live]
            probe = np.where(b == 1 << 20, 2 * a + 1, (a + b) // 2)
            hit = self._has(keys[live], bucket[live], space, probe)
            low[live[hit]], high[live[~hit]] = probe[hit], probe[~hit]
            live = live[high[live] - low[live] > 1]
        return low

    def _has(self, keys: np.ndarray, bucket: np.ndarray, space: int, level: np.ndarray) -> np.ndarray:
        h = tx.mix(keys + np.full(1, space, np.uint64) * _B + level.astype(np.uint64) * _C)
        step, size, start = _step(h), self.size[bucket].astype(np.uint64), self.start[bucket]
        out = np.zeros(len(keys), bool)
        live = np.arange(len(keys))
        for i in range(PROBES):
            at = start + _positions(h, step, size, i).astype(np.int64)
            hit = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(hit) < len(live):
                live, h, step, size, start = (x[hit] for x in (live, h, step, size, start))
            if not len(live):
                return out
        out[live] = True
        return out


def _segments(pieces: DataFrame, limit: int) -> list[tuple[list[int], int]]:
    """(buckets, bytes) of each pass."""
    sizes = pieces.select("bucket", F.length("bits").alias("n")).orderBy("bucket").collect()
    out: list = [([], 0)]
    for r in sizes:
        buckets, held = out[-1]
        if buckets and held + r["n"] > limit:
            buckets, held = [], 0
            out.append(([], 0))
        out[-1] = ([*buckets, r["bucket"]], held + r["n"])
    return out


def score(docs: DataFrame, model: Model, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """row, doc_id, n_tokens, n_known, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    log2, frequent = model.log2, model.frequent
    heavy, heavy_n, heavy_left = model.heavy
    below = model.tokens + ADD * (model.types + 1)
    doc_schema = "row long, doc_id " + kind + ", n_tokens long, n_known long, base_score double, score double"
    table_schema = doc_schema + ", bucket int, origin long, words binary, owners binary, shares binary"
    names = [x.split()[0] for x in table_schema.split(", ")]
    passes = []
    segments = _segments(model.pieces, segment_bytes)
    covered = np.zeros(1 << log2, bool)
    covered[[b for s, _ in segments for b in s]] = True
    for segment, size in segments:
        got = model.pieces.filter(F.col("bucket").isin(segment)).toLocalIterator()
        packed = spark.sparkContext.broadcast((segment, Filter(((r["bucket"], r["bits"]) for r in got), log2, size), frequent))
        first = not passes

        def run(batches, packed=packed, first=first):
            segment, found, (fk, fn) = packed.value
            mine = np.zeros(1 << log2, bool)
            mine[segment] = True
            if first:                              # buckets without a piece belong to the first pass
                mine |= ~covered
            rare: list = []
            size = 0

            def send():
                w, o, a, g = (np.concatenate(x) for x in zip(*rare))
                b = _bucket(w, log2)
                order = np.argsort(b, kind="stable")
                w, o, a, g, b = w[order], o[order], a[order], g[order], b[order]
                for k, i, j in _cut(b):
                    part = pa.RecordBatch.from_arrays(
                        [pa.array([None], pa.int64()), pa.nulls(1, doc_type), *[pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                         pa.array([k], pa.int32()), pa.array([int(o[0] >> 33)]), pa.array([w[i:j].tobytes()], pa.binary()),
                         pa.array([(o[i:j] & 0x1FFFFFFFF).astype("<u4").tobytes()], pa.binary()),
                         pa.array([np.concatenate([a[i:j], g[i:j]]).astype("<f4").tobytes()], pa.binary())], names=names)
                    yield part

            for batch in batches:
                ids, doc_type = batch.column("row").to_numpy(), batch.column("doc_id").type
                for texts, lo, hi in _batches(batch, "text"):
                    token, _, number = tokens_of(texts)
                    # what depends on one word is looked up once for each distinct one; the end is among them
                    words, own = np.unique(token, return_inverse=True)
                    prev = np.concatenate([[np.searchsorted(words, END)], own[:-1]])
                    word_bucket, (word_heavy, at) = _bucket(words, log2), _isin(words, heavy)
                    pair = _pair(words[prev], _short(words)[own])
                    bucket, of_heavy = word_bucket[prev], np.flatnonzero(word_heavy[prev])
                    bucket[of_heavy] = _bucket(pair[of_heavy], log2)
                    use = mine[bucket]
                    if not use.all():
                        token, own, prev, number, pair, bucket = (x[use] for x in (token, own, prev, number, pair, bucket))
                    n = len(texts)
                    # histories and pairs, each distinct one probed once
                    history = np.zeros(len(words), bool)
                    history[prev] = True
                    probed = np.flatnonzero(history & ~word_heavy)
                    hc, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                    hc[probed] = found.levels(words[probed], word_bucket[probed], COUNT)
                    some = np.flatnonzero(hc > 0)
                    left[some] = found.levels(words[some], word_bucket[some], LEFT)
                    c = np.where(hc > 0, EDGES[np.minimum(hc, len(EDGES) - 1)] - 1, 1).astype(float)
                    g = LEFT_GROWTH ** -left.astype(float)
                    c[word_heavy], g[word_heavy] = heavy_n[at[word_heavy]], heavy_left[at[word_heavy]]
                    c, g = c[prev], g[prev]
                    can = np.flatnonzero(((hc > 0) | word_heavy)[prev])
                    pk, pfirst, pinv = np.unique(pair[can], return_index=True, return_inverse=True)
                    level = np.zeros(len(pair), np.int64)
                    level[can] = found.levels(pk, bucket[can][pfirst], PAIR)[pinv]
                    a = np.where(level > 0, np.minimum((EDGES[np.maximum(level, 1) - 1] - DISCOUNT) / c, 1.0), 0.0)
                    word_known, place = _isin(words, fk)
                    p = (np.where(word_known, fn[place] if len(fn) else 0, 0) + ADD) / below
                    known, log_p, p = word_known[own], np.log10(p)[own], p[own]
                    base = np.bincount(number[known], weights=log_p[known], minlength=n).astype(float)
                    full = np.bincount(number[known], weights=np.log10(a[known] + g[known] * p[known]), minlength=n).astype(float)
                    count = np.bincount(number, minlength=n)
                    seen = np.bincount(number[known], minlength=n)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(count), pa.array(seen), pa.array(base), pa.array(full),
                        pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary()) for _ in range(3)]], names=names)
                    m = ~known
                    if m.any():
                        rare.append((token[m], ids[lo:hi][number[m]], a[m].astype(np.float32), g[m].astype(np.float32)))
                        size += int(m.sum())
                    if size > FLUSH:
                        yield from send()
                        rare, size = [], 0
            if rare:
                yield from send()

        passes.append(run)
    done = None
    for run in passes:
        part = rows.mapInArrow(run, table_schema)
        done = part if done is None else done.unionByName(part)
    done = written(done, "lm-occurrences")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    plain = done.filter("row is not null").select(*[x.split()[0] for x in doc_schema.split(", ")])
    if len(passes) > 1:
        plain = plain.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums)
    rare = _rare_sums(done.filter("bucket is not null").select("bucket", "origin", "words", "owners", "shares"), model, below)
    out = plain.join(rare, "row", "left")
    return out.select("row", "doc_id", "n_tokens", *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("n_known", "base_score", "score")])


def _rare_sums(blocks: DataFrame, model: Model, below: float) -> DataFrame:
    """row, more_n_known, more_base_score, more_score: what the words outside the frequent ones add."""
    null = F.lit(None).cast("binary")
    words = model.unigrams.select("bucket", F.lit(-1).cast("long").alias("origin"), F.col("keys").alias("words"), F.col("counts").alias("owners"), null.alias("shares"))

    def look(batches):
        held: dict[int, list] = {}
        size = 0

        def send():
            for origin, parts in held.items():
                row, base, full, known = (np.concatenate(x) for x in zip(*parts))
                unique, inverse = np.unique(row, return_inverse=True)
                sums = [np.bincount(inverse, weights=x).astype(float) for x in (base, full, known)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([origin]), pa.array([unique.astype("<u4").tobytes()], pa.binary()),
                    *[pa.array([s.tobytes()], pa.binary()) for s in sums[:2]], pa.array([sums[2].astype("<u4").tobytes()], pa.binary())],
                    names=["origin", "rows", "base", "full", "known"])

        bucket, keys, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:                      # sorted: a bucket's words come first
            for b, origin, w, o, s in zip(*[batch.column(c).to_pylist() for c in ("bucket", "origin", "words", "owners", "shares")]):
                if b != bucket:
                    bucket, keys, n = b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if origin < 0:
                    keys, n = _numbers(w, o)
                    continue
                w, row = np.frombuffer(w, np.uint64), np.frombuffer(o, "<u4")
                a, g = np.split(np.frombuffer(s, "<f4").astype(float), 2)
                found, at = _isin(w, keys)
                p = (np.where(found, n[at] if len(n) else 0, 0) + ADD) / below
                held.setdefault(origin, []).append((row, np.log10(p), np.log10(a + g * p), found))
                size += len(row)
                if size > FLUSH:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    parts = blocks.unionByName(words).repartition("bucket").sortWithinPartitions("bucket", "origin")
    parts = parts.mapInArrow(look, "origin long, rows binary, base binary, full binary, known binary")

    def total(batches):
        for run in store.runs(batches, ["origin"]):
            row = np.concatenate([np.frombuffer(x, "<u4") for x in run.column("rows").to_pylist()])
            unique, inverse = np.unique(row, return_inverse=True)
            sums = [np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, t) for x in run.column(c).to_pylist()])) for c, t in (("known", "<u4"), ("base", "<f8"), ("full", "<f8"))]
            origin = run.column("origin")[0].as_py()
            yield pa.RecordBatch.from_arrays([
                pa.array(unique.astype(np.int64) + (origin << 33)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["row", "more_n_known", "more_base_score", "more_score"])

    return (parts.repartition("origin").sortWithinPartitions("origin")
            .mapInArrow(total, "row long, more_n_known long, more_base_score double, more_score double"))
