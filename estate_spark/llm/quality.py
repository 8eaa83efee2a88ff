"""Quality rules: fixed counts of a text, and its divergence from its language's references.

References are made from all documents: per language the histogram over character classes and
over the language's ``COMMON`` most frequent words plus one class for all others. A language
needs ``LEAST_REFERENCE`` words to get its own, whatever its share; a reference takes about 1 KB in the
driver and in tasks, so their memory grows with the number of such languages. A document's histograms
are compared with its reference by Jensen-Shannon distance (base 2, 0 to 1). Short texts have ragged
histograms, so a distance decides only from a minimum length on. Without a reference of the language
the distances are those to all documents, and don't decide.

Defined results: a null text has no words and fails the base rule; a null, empty or
rare language is judged by the base rule alone; equal rows are judged alike and all stay; an empty table gives an empty result;
in ``judge`` other columns are ignored, ``keep`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.llm import lm, store
from estate_spark.llm import text as tx
from estate_spark.session import written

COMMON = 48                      # common words of a language
LEAST_REFERENCE = 2000           # words of a language that has its own reference
LEAST_CHARS, LEAST_WORDS = 200, 100
MOST_CLASS, MOST_WORD = 0.27, 0.45
MIN_WORDS, MOST_REPEAT = 50, 50  # base rule: words, percent of repeated words
CLASSES = 8
FLUSH = 500_000                  # counted words a task holds before it sends them
ALL = ""                         # the key of the reference of all documents

# character classes of bytes; class 7 counts nothing (bytes inside a code point)
_CLASS = np.full(256, 6, np.uint8)              # other ASCII
_CLASS[0x80:0xC0] = 7
_CLASS[0xC0:] = 5                               # beyond ASCII
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
for _c in ".,;:!?'\"()-":
    _CLASS[ord(_c)] = 4
_SYMBOLS = np.zeros(256, bool)
for _c in "#*$%&|<>":
    _SYMBOLS[ord(_c)] = True
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def histograms(texts: list[bytes]) -> np.ndarray:
    """Code points by class, a row a text."""
    return np.stack([np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=CLASSES) for t in texts]) if texts else np.zeros((0, CLASSES), int)


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    n = len(texts)
    h, owner, starts, ends = tx.words(texts)
    kinds = histograms(texts)
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": kinds[:, :7].sum(1) - kinds[:, 3]}
    out["n_symbols"] = np.array([int(_SYMBOLS[np.frombuffer(t, np.uint8)].sum()) for t in texts], np.int64)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        seen = set()
        for line in t.split(b"\n"):
            if line in seen:
                dup[i] += 1
            elif line.strip(b" \t\r\x0b\x0c"):
                seen.add(line)
    out["n_dup_lines"] = dup
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = owner[2:] == owner[:-2]
        at = np.flatnonzero(inside)
        window = tx.mix(tx.mix(h[at] * _A + h[at + 1]) * _B + h[at + 2] + owner[at].astype(np.uint64) * _A)
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(3):
            repeated[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)
    return out | {"_hash": h, "_owner": owner, "_kinds": kinds}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` to the reference ``q``."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def references(docs: DataFrame) -> dict[str, dict]:
    """language -> {classes, keys, counts}: one pass over all texts, bounded result. Tasks send
    packed counts by hash bucket; a bucket's total counts are merged in one task, which passes on
    each language's ``COMMON`` most frequent words and sums."""
    log2 = min(14, max(5, (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}                 # language -> [sorted keys, counts, classes]
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for name, (keys, n, classes) in held.items():
                order = np.argsort(lm._bucket(keys, log2), kind="stable")
                keys, n = keys[order], n[order]
                blocks = [(b, keys[i:j].tobytes(), n[i:j].astype("<u4").tobytes()) for b, i, j in lm._cut(lm._bucket(keys, log2))]
                blocks.append((-1, None, classes.astype("<u8").tobytes()))
                bucket, packed, counts = zip(*blocks)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array(bucket, pa.int32()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())],
                                                 names=["lang", "bucket", "keys", "counts"])

        for batch in tx.parts(batches):
            langs, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            for a, b in tx.batches_of(texts):
                part = texts[a:b]
                names, number = np.unique(np.array([x if x is not None else ALL for x in langs[a:b]], str), return_inverse=True)
                h, owner, _, _ = tx.words([t.translate(tx.LOWER) for t in part])
                kinds = histograms(part)
                of = number[owner]
                for i, name in enumerate(names.tolist()):
                    keys, n = np.unique(h[of == i], return_counts=True)
                    old = held.get(name, [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(7, np.int64)])
                    keys, n = lm._summed(np.concatenate([old[0], keys]), np.concatenate([old[1], n]))
                    held[name] = [keys, n, old[2] + kinds[number == i].sum(0)[:7]]
                size = sum(len(x[0]) for x in held.values())
                if size > FLUSH:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in store.runs(batches, ["bucket"]):
            bucket, by = run.column("bucket")[0].as_py(), {}
            for lang, k, c in zip(*[run.column(x).to_pylist() for x in ("lang", "keys", "counts")]):
                pair = (np.arange(7, dtype=np.uint64), np.frombuffer(c, "<u8").astype(np.int64)) if bucket < 0 else lm._numbers(k, c)
                for name in {lang, ALL}:
                    by.setdefault(name, []).append(pair)
            for name, pairs in by.items():
                keys, n = lm._summed(np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs]))
                top = np.lexsort((keys.view(np.int64), -n))[:COMMON]
                m = len(top)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (m + 1)), pa.array([bucket < 0] * (m + 1)), pa.array([*keys[top].view(np.int64).tolist(), None], pa.int64()),
                    pa.array([*n[top].tolist(), int(n.sum())])], names=["lang", "is_class", "key", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(count, "lang string, bucket int, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = written(parts.mapInArrow(merge, "lang string, is_class boolean, key long, n long"), "quality-words")
    sums = counts.filter("key is null and not is_class").groupBy("lang").agg(F.sum("n").alias("all"))
    large = written(sums.filter((F.col("lang") == ALL) | (F.col("all") >= LEAST_REFERENCE)), "quality-languages")
    of = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "key")
    top = (counts.filter("key is not null").join(large, "lang", "left_semi")
           .withColumn("r", F.row_number().over(of)).filter(F.col("r") <= COMMON).collect())
    packed, by = {}, {}
    for r in top:
        by.setdefault((r["lang"], r["is_class"]), []).append((r["key"], r["n"]))
    for lang, every in ((r["lang"], r["all"]) for r in large.collect()):
        mine = sorted(by.get((lang, False), []))
        classes = np.zeros(7)
        for key, count in by.get((lang, True), []):
            classes[key] = count
        n = np.array([x for _, x in mine], float)
        packed[lang] = {"classes": classes, "keys": np.array([k for k, _ in mine], np.int64), "counts": np.append(n, every - n.sum())}
    return packed


def verdicts(texts: list[bytes], langs: list[str | None], refs: dict[str, dict]) -> dict[str, np.ndarray]:
    """Base counts, both distances and the decision for every text."""
    c = base_counts(texts)
    n = len(texts)
    h, owner, _, _ = tx.words([t.translate(tx.LOWER) for t in texts])
    c.pop("_hash"), c.pop("_owner")
    kinds = c.pop("_kinds")
    which = np.array([x if x in refs else ALL for x in langs], object)
    own = np.array([x != ALL for x in which], bool)
    by_class, by_word = np.zeros(n), np.zeros(n)
    for lang in set(which.tolist()):
        if lang not in refs:
            continue
        ref, rows = refs[lang], np.flatnonzero(which == lang)
        by_class[rows] = distance(kinds[rows, :7].astype(float), ref["classes"])
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        mine = place[owner] >= 0
        keys, size = ref["keys"], len(ref["keys"])
        hashes = h[mine].view(np.int64)
        if size:
            at = np.minimum(np.searchsorted(keys, hashes), size - 1)
            slot = np.where(keys[at] == hashes, at, size)
        else:
            slot = np.zeros(len(hashes), np.int64)
        table = np.bincount(place[owner[mine]] * (size + 1) + slot, minlength=len(rows) * (size + 1)).reshape(len(rows), size + 1)
        by_word[rows] = distance(table.astype(float), ref["counts"])
    words = c["n_words"]
    c["class_distance"], c["word_distance"] = by_class, by_word
    c["base_failed"] = (words < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEAT * words)
    odd = ((kinds[:, :7].sum(1) >= LEAST_CHARS) & (by_class > MOST_CLASS)) | ((words >= LEAST_WORDS) & (by_word > MOST_WORD))
    c["kept"] = ~c["base_failed"] & ~(odd & own)
    return c


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, refs: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, kept."""
    refs = references(docs) if refs is None else refs
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.parts(batches):
            langs, texts = batch.column(1).to_pylist(), _bytes(batch.column(2))
            for a, b in tx.batches_of(texts):
                v = verdicts(texts[a:b], langs[a:b], refs)
                cols = [batch.column(0).slice(a, b - a), *[pa.array(v[k].astype(np.int64)) for k in _COUNTS],
                        pa.array(v["base_failed"]), pa.array(v["class_distance"]), pa.array(v["word_distance"]), pa.array(v["kept"])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", *_COUNTS, "base_failed", "class_distance", "word_distance", "kept"]
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(c + ' long' for c in _COUNTS)}, base_failed boolean, "
                                "class_distance double, word_distance double, kept boolean")


def keep(docs: DataFrame, refs: dict[str, dict] | None = None) -> DataFrame:
    """The documents that pass, all their columns unchanged."""
    refs = references(docs) if refs is None else refs
    lang, text = docs.columns.index("lang"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.parts(batches):
            langs, texts = batch.column(lang).to_pylist(), _bytes(batch.column(text))
            for a, b in tx.batches_of(texts):
                yield batch.slice(a, b - a).filter(pa.array(verdicts(texts[a:b], langs[a:b], refs)["kept"]))

    return docs.mapInArrow(run, docs.schema)
