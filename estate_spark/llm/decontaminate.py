"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows.

Text is normalised by lower-casing A-Z and joining its words (ASCII letters and digits and all
beyond ASCII) with single blanks. A window is ``WINDOW`` consecutive words of an item; an item
of fewer words, but not none, is one window. The automaton holds every distinct window with a
blank on either side; one scan of the normalised text finds all occurrences, whose words map
back to character offsets of the original.

The items must be few beside the corpus: a block holds at most ``BLOCK_WINDOWS`` windows, which
bounds what is sent to the workers; more windows make more blocks, each scanned in its own pass
over the texts, and the passes' hits are united. Nothing is left out at any number of items.

Defined results: null and wordless texts have no words and no hits; items with null or wordless
texts occur nowhere; a null item id is the empty string; a repeated item id counts once; equal rows are judged alike and all stay;
empty tables give no hits or no rows; other columns are ignored (``drop`` returns them all).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.llm import text as tx
from estate_spark.session import written

WINDOW = 10
BLOCK_WINDOWS = 50_000
_TABLE = bytes(32 if tx.NON_WORD[c] else c for c in tx.LOWER)
_AUTOMATA: dict[str, object] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), pattern: distinct windows of every item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = normal_words(text)
                found = {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array(sorted(found), pa.binary())], names=["item_id", "pattern"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "item_id string, pattern binary").distinct()


def _automaton(key: str, patterns: list[tuple[bytes, list[int]]]):
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        found = ahocorasick.Automaton()
        for p, items in patterns:
            found.add_word(" " + p.decode("latin-1") + " ", (p.count(b" ") + 1, items))
        if patterns:
            found.make_automaton()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def scan(words: list[bytes], automaton) -> tuple[np.ndarray, set[int]]:
    """Which words lie in an occurrence, and the numbers of the items that occur."""
    hit = np.zeros(len(words), bool)
    items: set[int] = set()
    if not len(words) or not len(automaton):
        return hit, items
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = list(automaton.iter(line))
    if found:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)   # the blank behind each word
        for at, (n, own) in found:
            last = int(np.searchsorted(ends, at))
            hit[last - n + 1:last + 1] = True
            items.update(own)
    return hit, items


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets (start, end) of every word of the original."""
    data = text.encode("utf-8", "replace")
    inside = np.zeros(len(data) + 2, np.int8)
    raw = np.frombuffer(data, np.uint8)
    inside[1:-1] = ~tx.NON_WORD[np.frombuffer(data.translate(tx.LOWER), np.uint8)]
    step = np.diff(inside)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])     # code points before a byte
    return list(zip(chars[np.flatnonzero(step == 1)].tolist(), chars[np.flatnonzero(step == -1)].tolist()))


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _blocks(items: DataFrame, block: int) -> list[list[tuple[bytes, list[str]]]]:
    """Windows with their items in blocks of bounded size, in order of the pattern."""
    windows = (items.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    rows = windows.orderBy("pattern").toLocalIterator()
    out: list = [[]]
    for r in rows:
        if len(out[-1]) >= block:
            out.append([])
        out[-1].append((bytes(r["pattern"]), r["items"]))
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs``: row, doc_id, n_words, n_hit, items (sorted ids), spans (character
    offsets of the hit stretches in the original text)."""
    patterns = written(item_windows(items, window), "item-windows")
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n_words long, hits array<struct<a:long,b:long>>, spans array<struct<start:long,stop:long>>, items array<string>"
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.null()), ("n_words", pa.int64()),
                       ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                       ("items", pa.list_(pa.string()))])
    blocks = _blocks(patterns, block)
    passes = []
    for part in blocks:
        ids = sorted({i for _, own in part for i in own})
        number = {x: k for k, x in enumerate(ids)}
        packed = spark.sparkContext.broadcast((ids, [(p, [number[i] for i in own]) for p, own in part]))
        key = hashlib.md5(b"\n".join(p for p, _ in part)).hexdigest()

        def find(batches: Iterator[pa.RecordBatch], packed=packed, key=key) -> Iterator[pa.RecordBatch]:
            names, windows = packed.value
            automaton = _automaton(key, windows)
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    out = {"n_words": [], "hits": [], "spans": [], "items": []}
                    for text in part.column("text").to_pylist():
                        words = normal_words(text)
                        hit, own = scan(words, automaton)
                        stretches = _spans(hit) if own else []
                        where = word_spans(text) if own else []
                        out["n_words"].append(len(words))
                        out["hits"].append([{"a": x, "b": y} for x, y in stretches])
                        out["spans"].append([{"start": where[x][0], "stop": where[y - 1][1]} for x, y in stretches])
                        out["items"].append(sorted(names[i] for i in own))
                    cols = [part.column("row"), part.column("doc_id"), *[pa.array(out[c], arrow.field(c).type) for c in out]]
                    yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

        passes.append(rows.mapInArrow(find, schema))
    if len(passes) == 1:
        done = passes[0]
        return done.select("row", "doc_id", "n_words", _total("hits").alias("n_hit"), "items", "spans")
    # united over the passes: rows with hits in several blocks are merged by row
    each = passes[0]
    for p in passes[1:]:
        each = each.unionByName(p)
    each = written(each, "block-hits")
    found = each.filter(F.size("items") > 0)
    reach = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)

    def united(column: str, a: str, b: str) -> DataFrame:
        one = found.select("row", F.explode(column).alias("x")).select("row", F.col(f"x.{a}").alias("a"), F.col(f"x.{b}").alias("b")).distinct()
        seen = F.max("b").over(reach)
        one = one.withColumn("first", (seen.isNull() | (F.col("a") > seen)).cast("int"))
        one = one.withColumn("no", F.sum("first").over(Window.partitionBy("row").orderBy("a", "b")))
        one = one.groupBy("row", "no").agg(F.min("a").alias(a), F.max("b").alias(b))
        return one.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(a, b))).alias(column))

    own = (found.select("row", F.explode("items").alias("i")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("i")).alias("items")))
    base = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    out = base.join(own, "row", "left").join(united("hits", "a", "b"), "row", "left").join(united("spans", "start", "stop"), "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce(_total("hits"), F.lit(0).cast("bigint")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))


def _total(column: str):
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])


def drop(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents in which no window of any item occurs, all their columns unchanged. One
    narrow pass per block of windows, each on what the one before kept."""
    patterns = written(item_windows(items, window), "item-windows")
    text = docs.columns.index("text")
    out = docs
    for part in _blocks(patterns, block):
        packed = docs.sparkSession.sparkContext.broadcast([(p, []) for p, _ in part])
        key = "drop" + hashlib.md5(b"\n".join(p for p, _ in part)).hexdigest()

        def keep(batches: Iterator[pa.RecordBatch], packed=packed, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, packed.value)
            for batch in tx.parts(batches):
                clean = [not scan(normal_words(t), automaton)[0].any() for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
