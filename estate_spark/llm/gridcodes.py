"""Product codes of vectors: integer parts assigned to codebooks through memoised grid cells.

A vector's components become integers floor(SCALE * x) and are cut into ``PARTS`` equal
consecutive parts, each with a codebook of at most ``ENTRIES`` entries. To find the nearest
entry of a part, the part's coarse grid cell (``CELL`` wide in every dimension) is looked up
by its hash. A cell's cached answer is the set of entries that are not dominated across its
box: entries whose least squared distance to the box is at most the smallest of all largest
distances. Only those are evaluated exactly. Both bounds of a box are sums of one number a
dimension, which are made once per coordinate and codebook. The memo of a task holds at most
``MEMO`` cells a part and starts anew when full, so memory is bounded; it changes cost only.

Every round is one narrow pass over the rows; tasks emit sums per part and entry (at most
PARTS * ENTRIES rows each), which Spark adds up. The driver and the tasks hold the codebooks,
whose size follows from ENTRIES and the vector length, never from the rows.

Defined results: a null vector, or one with null, NaN or infinite components, is dropped. The
table's vector length is that of the smallest key among vectors whose length is a positive
multiple of PARTS; vectors of another length lack components or have strange ones and are
dropped likewise. Null keys sort last; among rows of one key the smaller vector counts as
smaller. Repeated rows are coded alike and count each. Fewer than ENTRIES rows give smaller
codebooks, an empty table an empty result. Integers are held to +-2^28 (less for parts longer
than 16), so that an error always fits a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.session import written

SCALE = 1024                     # integer steps of 1.0
PARTS = 4
ENTRIES = 256                    # of a codebook; codes are bytes
ROUNDS = 4
CELL = 32                        # width of a grid cell
MEMO = 1 << 16                   # cells of a part that a task remembers
ROWS = 2048                      # vectors worked on at once
FEW_LABELS = 100_000             # labels whose sums are broadcast, counted


def integers(values: np.ndarray, part_size: int) -> np.ndarray:
    bound = 2.0 ** min(28, (62 - max(part_size - 1, 0).bit_length()) // 2 - 1)
    return np.clip(np.floor(values * SCALE), -bound, bound).astype(np.int64)


def whole(vector: Column) -> Column:
    """Neither null nor with null or non-finite components, and cut evenly."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)


class Cells:
    """Candidate entries of the cells of one part position."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.memo: dict[bytes, bytes] = {}
        self.width = -(-len(book) // 8)

    def _bounds(self, cells: np.ndarray) -> np.ndarray:
        """Which entries are not dominated across each cell's box: a packed row a cell."""
        low = np.zeros((len(cells), len(self.book)), np.int64)
        high = np.zeros_like(low)
        for d in range(cells.shape[1]):
            at, place = np.unique(cells[:, d], return_inverse=True)
            a = at[:, None] * CELL - self.book[None, :, d]         # entry to lower border
            b = a + (CELL - 1)                                     # entry to upper border
            outside = np.maximum(np.maximum(a, -b), 0)
            low += (outside * outside)[place]
            far = np.maximum(np.abs(a), np.abs(b))
            high += (far * far)[place]
        return np.packbits(low <= high.min(1, keepdims=True), axis=1)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """A boolean row of entries for every given cell."""
        keys = [r.tobytes() for r in cells]
        new = {k: i for i, k in enumerate(keys) if k not in self.memo}
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo = {}
                new = {k: i for i, k in enumerate(keys)}
            packed = self._bounds(cells[list(new.values())])
            self.memo.update(zip(new, (r.tobytes() for r in packed)))
        bits = np.frombuffer(b"".join([self.memo[k] for k in keys]), np.uint8).reshape(len(keys), self.width)
        return np.unpackbits(bits, axis=1, count=len(self.book)).astype(bool)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row, the lowest entry on ties."""
        cells, back = np.unique(np.floor_divide(x, CELL), axis=0, return_inverse=True)
        row, entry = np.nonzero(self.candidates(cells)[back])      # by row, entries ascending
        d = x[row] - self.book[entry]
        d = np.einsum("ij,ij->i", d, d)
        start = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, start)
        hits = np.flatnonzero(d == least[row])
        first = hits[np.searchsorted(hits, start)]
        return entry[first], least


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of whole vectors, their integer components)."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero((np.diff(offsets) == size) & ~column.is_null().to_numpy(zero_copy_only=False))
    x = values[offsets[rows][:, None] + np.arange(size)]
    ok = np.isfinite(x).all(1)
    return rows[ok], integers(x[ok], size // PARTS)


def _coded(batches: Iterator[pa.RecordBatch], size: int, books: list[np.ndarray]):
    """(batch slice, row numbers, integer vectors, entries, squared distances)."""
    cells, step = [Cells(b) for b in books], size // PARTS
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            rows, x = _vectors(part.column(0), size)
            if len(rows):
                got = [c.nearest(x[:, p * step:(p + 1) * step]) for p, c in enumerate(cells)]
                yield part, rows, x, np.stack([e for e, _ in got], 1), np.stack([d for _, d in got], 1)


def start(kept: DataFrame, vector: str, key: str) -> list[np.ndarray]:
    """The first codebooks: the parts of the ENTRIES smallest keys' vectors; none without rows."""
    first = kept.orderBy(F.col(key).asc_nulls_last(), vector).select(vector)
    rows = [r[0] for r in first.limit(ENTRIES).collect()]
    if rows and any(len(r) != len(rows[0]) for r in rows):
        rows = [r[0] for r in first.filter(F.size(vector) == len(rows[0])).limit(ENTRIES).collect()]
    if not rows:
        return []
    step = len(rows[0]) // PARTS
    x = integers(np.array(rows, float), step)
    return [x[:, p * step:(p + 1) * step].copy() for p in range(PARTS)]


def round_sums(kept: DataFrame, vector: str, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n and s0, s1, ...: count and component sums of the parts assigned to each entry."""
    step = books[0].shape[1]
    names = [f"s{d}" for d in range(step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), step + 1), np.int64) for b in books]
        for _, _, x, entry, _ in _coded(batches, step * PARTS, books):
            for p in range(PARTS):
                order = np.argsort(entry[:, p], kind="stable")
                own, at = np.unique(entry[order, p], return_index=True)
                total[p][own, 0] += np.diff([*at, len(order)])
                total[p][own, 1:] += np.add.reduceat(x[order, p * step:(p + 1) * step], at, axis=0)
        for p, t in enumerate(total):
            own = np.flatnonzero(t[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), p, np.int32)), pa.array(own.astype(np.int32)), *[pa.array(t[own, i]) for i in range(step + 1)]],
                names=["part", "entry", "n", *names])

    parts = kept.select(vector).mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    return parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one a part position; an empty list where no vector is whole."""
    kept = _kept(vectors, vector, key)
    books = start(kept, vector, key)
    for _ in range(rounds if books else 0):
        for r in round_sums(kept, vector, books).collect():     # at most PARTS * ENTRIES rows
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r[3:]]
    return books


def _kept(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    wide = F.col(vector).cast("array<double>")
    return vectors.filter(whole(wide)).select(wide.alias(vector), key)


def encode(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding", carry: list[str] = ("vec_id", "label")) -> DataFrame:
    """The columns ``carry``, codes (a byte a part) and the squared error of every whole vector."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("_vector"), *carry)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:]) + ", codes binary, error long"
    if not books:
        return rows.filter("false").select(*carry, F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
    size = books[0].shape[1] * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, _, entry, d in _coded(batches, size, books):
            take = part.take(pa.array(at))
            codes = entry.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*take.columns[1:], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(d.sum(1))],
                names=[*take.schema.names[1:], "codes", "error"])

    return rows.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls are equal). The sums of at
    most FEW_LABELS labels are broadcast; more of them are joined by shuffle."""
    rows = written(coded, "vector-codes")
    sums = written(rows.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "vector-labels")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, rows[label].eqNullSafe(F.col("_label"))).drop("_label")


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
