"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model is a public BPE file, and the ids are exactly those of the sentencepiece library.
Ordinary texts go to the library. A text above ``CHUNK`` characters is cut into chunks that
tasks treat independently:

1. A merge-based segmentation is right if and only if every two neighbours in it are what the
   model makes of the two put together, so it is the one path through the lattice of pieces whose
   steps all score 0, any other pair scoring minus infinity. The state at a chunk border is the
   piece that holds the character before it. Each chunk yields the matrix of best path scores from
   the states at its left border to those at its right one.
2. Matrices are combined by the max-plus product, which is associative, in a parallel-prefix tree
   per document; going back from the end picks the state at every border.
3. Each chunk is traced on its own between its two states.

Where no piece spans two neighbouring characters, no path depends on what lies before, so a chunk
looks at the lattice only from its borders to the first and last such place and lets the library
encode between them; a chunk without one (text without blanks) is done by the lattice throughout.

Defined results: a null text is empty; an empty text has no ids; characters outside the vocabulary become
their bytes; repeated rows are encoded each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm import store
from estate_spark.session import written

CHUNK = 40_000                   # characters
SPACE = "▁"
_MODELS: dict[str, "Pieces"] = {}
START, END = (0, 0, None), (0, 0, None)
NO = -np.inf


class Pieces:
    """The model's pieces, and which of them may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
        self.id = {sp.id_to_piece(i): i for i, s in enumerate(special) if not s}
        self.longest = max(map(len, self.id))
        self.inner = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.name = {i: p for p, i in self.id.items()}
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def between(self, z: str) -> list[int]:
        """Ids of a stretch of normalised text that starts and ends where no piece spans. The
        newline in front takes the blank that the library adds, and is cut off with it."""
        return self.sp.encode("\n" + z.replace(SPACE, " "))[2:]

    def at(self, z: str, i: int) -> list[tuple[int, int]]:
        """(id, length) of the pieces that start at i; an unknown character has a negative id."""
        out = []
        for k in range(1, self.longest + 1):
            part = z[i:i + k]
            if len(part) < k or part not in self.prefixes:
                break
            if (n := self.id.get(part)) is not None:
                if n not in self.alone:
                    self.alone[n] = self.between(part) == [n]
                if self.alone[n]:
                    out.append((n, k))
        return out if z[i] in self.id else [(-1 - ord(z[i]), 1)]

    def fit(self, a: int | None, b: int) -> bool:
        """Whether b may follow a."""
        if a is None or a < 0 or b < 0 or self.name[a][-1] + self.name[b][0] not in self.inner:
            return True
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self.between(self.name[a] + self.name[b]) == [a, b]
        return self.pairs[a, b]

    def ids(self, path: list[int]) -> list[int]:
        out = []
        for n in path:
            out += [n] if n >= 0 else self.between(chr(-1 - n))
        return out

    def states(self, left: str, right: str) -> list[tuple[int, int, int]]:
        """(start, end, id) relative to the border, of the pieces that hold the character before it."""
        z = left + right
        b = len(left)
        return [(i - b, i + k - b, n) for i in range(max(0, b - self.longest), b) for n, k in self.at(z, i) if i + k >= b]

    def breaks(self, z: str, order) -> int | None:
        """The first place of ``order`` that no piece spans."""
        for i in order:
            if z[i - 1:i + 1] not in self.inner:
                return i
        return None

    def spread(self, z: str, nodes: dict[int, dict], stop: int, parents: dict | None = None) -> dict[int, dict]:
        """Reach from the nodes (position -> piece -> bits of origins) on, from positions below ``stop``."""
        if not nodes:
            return nodes
        for i in range(min(nodes), stop):
            if not (here := nodes.get(i)):
                continue
            for n, k in self.at(z, i):
                bits = 0
                for t, mask in here.items():
                    if self.fit(t, n):
                        bits |= mask
                        if parents is not None:
                            parents.setdefault((i + k, n), (i, t))
                if bits:
                    there = nodes.setdefault(i + k, {})
                    there[n] = there.get(n, 0) | bits
        return nodes


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


class Chunk:
    """A chunk with enough of its neighbours to know the states at its borders."""

    def __init__(self, model: Pieces, before: str, body: str, after: str, first: bool, last: bool):
        self.m, self.z, self.a, self.b = model, before + body + after, len(before), len(before) + len(body)
        self.last = last
        self.left = [START] if first else model.states(before, self.z[self.a:self.a + model.longest])
        self.right = [END] if last else model.states(self.z[max(0, self.b - 2 * model.longest):self.b], after)
        low = self.a + max(e for _, e, _ in self.left) if self.left else self.a
        self.f = model.breaks(self.z, range(max(low, 1), self.b - model.longest)) if not first else self.a
        self.l = None
        if self.f is not None:
            self.l = model.breaks(self.z, range(self.b - model.longest, self.f, -1)) or self.f

    def _ends(self, nodes: dict[int, dict]) -> list[int]:
        """Bits of the origins that reach each right state."""
        if self.last:
            bits = 0
            for mask in nodes.get(self.b, {}).values():
                bits |= mask
            return [bits]
        return [nodes.get(self.b + e, {}).get(n, 0) for _, e, n in self.right]

    def matrix(self) -> np.ndarray:
        starts: dict[int, dict] = {}
        for k, (_, e, n) in enumerate(self.left):
            starts.setdefault(self.a + e, {})[n] = 1 << k
        if self.f is None:
            ends = self._ends(self.m.spread(self.z, starts, self.b))
        else:
            reach = 0
            for mask in self.m.spread(self.z, starts, self.f).get(self.f, {}).values():
                reach |= mask
            tail = self._ends(self.m.spread(self.z, {self.l: {None: 1}}, self.b))
            ends = [reach if t else 0 for t in tail]
        return np.array([[0.0 if bits >> k & 1 else NO for bits in ends] for k in range(len(self.left))]).reshape(len(self.left), len(self.right))

    def _path(self, i: int, t: int | None, to: int, stop: int, n: int | None) -> list[int]:
        """Pieces after t, which ends at i, up to the one that ends at ``to`` (n, or any)."""
        parents: dict = {}
        nodes = self.m.spread(self.z, {i: {t: 1}}, stop, parents)
        if to == i:
            return []
        node = (to, n if n is not None else next(iter(nodes[to])))
        path = []
        while node != (i, t):
            path.append(node[1])
            node = parents[node]
        return path[::-1]

    def trace(self, x: int, y: int) -> list[int]:
        """Ids after left state x up to right state y, with it."""
        (_, e, t), (_, e2, n) = self.left[x], self.right[y]
        to, n = (self.b, None) if self.last else (self.b + e2, n)
        if self.f is None:
            return self.m.ids(self._path(self.a + e, t, to, self.b, n))
        head = self._path(self.a + e, t, self.f, self.f, None)
        tail = self._path(self.l, None, to, self.b, n)
        return self.m.ids(head) + (self.m.between(self.z[self.f:self.l]) if self.l > self.f else []) + self.m.ids(tail)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus: best score over the state between."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def prefix_products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive products in a tree of logarithmic depth."""
    if len(matrices) < 2:
        return matrices
    sub = prefix_products([product(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    return [matrices[0], *(sub[i // 2] if i % 2 else product(sub[i // 2 - 1], matrices[i]) for i in range(1, len(matrices)))]


def border_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(left, right) state of every chunk on the best path."""
    before = prefix_products(matrices)
    right, out = 0, []
    for c in range(len(matrices) - 1, -1, -1):
        score = matrices[c][:, right] + (before[c - 1][0] if c else 0)
        left = int(score.argmax())
        if score[left] == NO:
            raise ValueError("no path")
        out.append((left, right))
        right = left
    return out[::-1]


def cut(text: str, chunk: int, context: int) -> list[tuple[str, str, str]]:
    """(before, body, after) of every chunk of the normalised text."""
    z = SPACE + text.replace(" ", SPACE)
    return [(z[max(0, i - context):i], z[i:i + chunk], z[i + chunk:i + chunk + context]) for i in range(0, len(z), chunk)]


def _sorted_groups(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *more)


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids of every row."""
    if chunk < 200:
        raise ValueError("a chunk must be much longer than a piece")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = m.sp.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    length = F.char_length("text")
    plain = rows.filter(length < chunk).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    return plain.unionByName(_giants(rows.filter(length >= chunk), model_path, chunk))


def _giants(rows: DataFrame, model_path: str, chunk: int) -> DataFrame:
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["doc_id"]

    def split(batches):
        context = 2 * pieces(model_path).longest
        for batch in batches:
            for i in range(batch.num_rows):
                parts = cut(batch.column("text")[i].as_py(), chunk, context)
                for a in range(0, len(parts), 50):
                    here = parts[a:a + 50]
                    n = len(here)
                    yield pa.RecordBatch.from_arrays([
                        *[pa.concat_arrays([batch.column(c).slice(i, 1)] * n) for c in ("row", "doc_id")], pa.array(range(a, a + n), pa.int32()),
                        *[pa.array(c, pa.string()) for c in zip(*here)], pa.array([k == len(parts) - 1 for k in range(a, a + n)])],
                        names=["row", "doc_id", "at", "before", "body", "after", "last"])

    chunks = rows.mapInArrow(split, f"row long, doc_id {kind}, at int, before string, body string, after string, last boolean")
    chunks = written(chunks.repartition("row", "at"), "piece-chunks")

    def chunk_of(row: dict) -> Chunk:
        return Chunk(pieces(model_path), row["before"], row["body"], row["after"], row["at"] == 0, row["last"])

    def matrices(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                m = chunk_of(r).matrix()
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["at"]], pa.int32()), pa.array([m.shape[0]], pa.int32()),
                                                  pa.array([(m == 0).tobytes()], pa.binary())], names=["row", "at", "states", "open"])

    def borders(batches):
        for run in store.runs(batches, ["row"]):
            got = [np.where(np.frombuffer(o, bool).reshape(n, -1), 0.0, NO) for n, o in zip(run.column("states").to_pylist(), run.column("open").to_pylist())]
            pairs = border_states(got)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([run.column("row")[0].as_py()] * n), pa.array(range(n), pa.int32()),
                                              *[pa.array(c, pa.int32()) for c in zip(*pairs)]], names=["row", "at", "x", "y"])

    def traces(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = chunk_of(r).trace(r["x"], r["y"])
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["at"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["row", "at", "ids"])

    found = chunks.mapInArrow(matrices, "row long, at int, states int, open binary")
    found = _sorted_groups(found, "row", "at").mapInArrow(borders, "row long, at int, x int, y int")
    traced = chunks.join(found, ["row", "at"]).select("row", "at", "before", "body", "after", "last", "x", "y").mapInArrow(traces, "row long, at int, ids array<int>")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return chunks.filter("at = 0").select("row", "doc_id").join(joined, "row").select("doc_id", "ids")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model_path).sp
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = sp.decode([x or [] for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, schema + ", decoded string")
