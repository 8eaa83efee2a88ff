"""Spelling variants: words one edit apart, by composing acceptors with a one-edit transducer.

The words of a partition become a minimal acyclic acceptor (equal continuations share a state;
arcs carry how many words come before them, so a path yields the number of its word). It is
composed with a transducer that copies, makes one edit (a replaced, deleted or inserted code
point), and copies on, and with the acceptor again. Before the edit both sides are in the same
state; after it a pair of states accepts their common continuations, and where the two states
are one, all pairs of its words at once. The edit is taken at the first differing place, so
every pair is accepted once.

Partitions are those of the composition's initial state. Two words one edit apart, the shorter
with L code points, share the first L // 2 of them or the last L // 2. A word therefore goes to
the partitions of its halves, forward and (reversed) backward, four rows at most; a pair counts
forward where it shares the first half, backward otherwise. A partition of more than ``LIMIT``
words is dealt further, by the state in which the edit happens and the continuation after it:
such a part holds one word per code point and one without, and is composed in the same way.
No partition is cut short.

Defined results: null texts and null words have no runs and no pairs; a null key counts as
empty; repeated rows count each; giant runs are words like others; ties of ``form`` go to the
smallest word by code points; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm import text as tx
from estate_spark.session import written

LEAST_LENGTH, LEAST_COUNT = 6, 5
TIMES = 5                        # a form is so many times as frequent as its variant
LIMIT = 20_000                   # words of a partition
FLUSH = 200_000                  # counted words a task holds before it sends them
SEND = 50_000                    # pairs of a batch

# Latin-1 bytes of runs, lower-cased in A-Z alone; all others part
_RUN = bytearray(b" " * 256)
_RUN[97:123] = range(97, 123)
_RUN[65:91] = range(97, 123)
_RUN[0xC0:] = range(0xC0, 0x100)
_RUN = bytes(_RUN)


def run_counts(text: str, key: str, slip: int | None) -> Iterator[tuple[bytes, int]]:
    """(run in Latin-1, occurrences), a code point deleted where ``slip`` divides the run's hash."""
    start = zlib.crc32(f"{key}:".encode("utf-8", "replace"))
    least = LEAST_LENGTH
    for run, n in Counter(text.encode("latin-1", "replace").translate(_RUN).split()).items():
        if len(run) < least:
            continue
        if slip:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least:
                    continue
        yield run, n


def vocabulary(docs: DataFrame, slip: int | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of Latin letters in all texts, of LEAST_LENGTH code points and ``least``
    occurrences. ``slip`` plants deletions by a hash of key and run."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in tx.parts(batches):
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in run_counts(t, key, slip):
                    held[run] += n
                if len(held) > FLUSH:
                    yield send()
                    held = Counter()
        yield send()

    rows = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def acceptor(words: list[str], depth: int) -> tuple[list, list[int], int]:
    """Minimal acceptor of the sorted words' continuations after ``depth`` code points:
    (states, counts, start). A state is (final, {label: (target, words before the arc)})."""
    states: list[tuple[bool, dict]] = []
    counts: list[int] = []
    known: dict[tuple, int] = {}

    def settled(final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            before, out = int(final), {}
            for label, target in arcs:
                out[label] = (target, before)
                before += counts[target]
            states.append((final, out))
            counts.append(before)
        return at

    last, path = "", [[False, []]]
    for word in words:
        word = word[depth:]
        same, most = 0, min(len(last), len(word))
        while same < most and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            done = settled(*path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = settled(*path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    return states, counts, settled(*path.pop())


def composed(words: list[str], depth: int, first_state: bool = False) -> Iterator[tuple[int, int]]:
    """Numbers of all word pairs one edit apart whose first difference is after ``depth`` code
    points that all words share (right after it if ``first_state``). Sorted distinct words."""
    states, counts, start = acceptor(words, depth)

    def common(pending: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
        while pending:
            p, q, i, j = pending.pop()
            if p == q:
                for k in range(counts[p]):
                    yield i + k, j + k
                continue
            (final_p, arcs_p), (final_q, arcs_q) = states[p], states[q]
            if final_p and final_q:
                yield i, j
            for label, (target, before) in arcs_p.items():
                other = arcs_q.get(label)
                if other:
                    pending.append((target, other[0], i + before, j + other[1]))

    before_edit = [(start, 0)]
    while before_edit:
        s, at = before_edit.pop()
        final, arcs = states[s]
        ordered = list(arcs.items())
        for x, (label, (p, i)) in enumerate(ordered):
            # replaced: both sides read different labels
            for _, (q, j) in ordered[x + 1:]:
                yield from common([(p, q, at + i, at + j)])
            # deleted: this side reads a label, the other waits; it must not go on with the same one
            final_p, arcs_p = states[p]
            if final_p and final:
                yield at + i, at
            yield from common([(target, arcs[c][0], at + i + n, at + arcs[c][1]) for c, (target, n) in arcs_p.items() if c != label and c in arcs])
            if not first_state:
                before_edit.append((p, at + i))


def _partitions(words: DataFrame) -> DataFrame:
    """backward, depth, part, word, n: a row per partition of a word; word is reversed backward."""
    w = words.filter(F.col("word").isNotNull() & (F.char_length("word") > 1)).select("word", "n")
    size = F.char_length("word")
    depths = F.array_distinct(F.array(F.floor(size / 2), F.floor((size - 1) / 2))).cast("array<int>")
    sides = w.withColumn("side", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "word", F.when(F.col("side"), F.reverse("word")).otherwise(F.col("word")))
    rows = sides.withColumn("depth", F.explode(depths))
    return rows.select(F.col("side").alias("backward"), "depth", F.expr("left(word, depth)").alias("part"), "word", "n")


def _dealt_further(rows: DataFrame) -> DataFrame:
    """Rows of large partitions by the edit's state and the continuation after it."""
    size = F.char_length("word")
    places = F.sequence(F.col("depth"), size)
    at = rows.withColumn("at", F.explode(places))
    longer = at.filter(F.col("at") < size).withColumn("rest", F.expr("substring(word, at + 2)"))
    shorter = at.withColumn("rest", F.expr("substring(word, at + 1)"))
    return longer.unionByName(shorter).select(
        "backward", "depth", "at", F.concat_ws("\0", F.expr("left(word, at)"), "rest").alias("part"), "word", "n")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n, near_word, near_n: every unordered pair of distinct words one edit apart, once.
    ``words`` holds distinct words with their counts n and is read more than once."""
    rows = _partitions(words)
    large = written(rows.groupBy("backward", "depth", "part").count().filter(F.col("count") > limit).drop("count"), "spelling-large")
    coarse = rows.withColumn("at", F.lit(-1))
    if not large.isEmpty():
        key = ["backward", "depth", "part"]
        coarse = coarse.join(large, key, "left_anti").unionByName(_dealt_further(rows.join(large, key, "left_semi")))
    order = ["backward", "depth", "at", "part"]

    def accept(run: list[tuple[str, int]], backward: bool, depth: int, at: int) -> Iterator[tuple]:
        names = [w for w, _ in run]
        for i, j in composed(names, depth if at < 0 else at, at >= 0):
            (u, m), (v, n) = run[i], run[j]
            if min(len(u), len(v)) // 2 != depth:
                continue                                   # met in the partition of another depth
            if backward:
                u, v = u[::-1], v[::-1]
                if u[:depth] == v[:depth]:
                    continue                               # accepted forward
            yield u, m, v, n

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def send() -> pa.RecordBatch:
            a, m, b, n = zip(*held) if held else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(m, pa.int64()), pa.array(b, pa.string()), pa.array(n, pa.int64())],
                                              names=["word", "n", "near_word", "near_n"])

        def closed(key, run) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if len(run) > 1:
                for pair in accept(run, *key[:3]):
                    held.append(pair)
                    if len(held) >= SEND:
                        yield send()
                        held = []

        key, run = None, []
        for batch in batches:
            for *here, word, n in zip(*(batch.column(c).to_pylist() for c in (*order, "word", "n"))):
                if here != key:
                    yield from closed(key, run)
                    key, run = here, []
                run.append((word, n))
        yield from closed(key, run)
        yield send()

    dealt = coarse.select(*order, "word", "n").repartition(*order).sortWithinPartitions(*order, "word")
    return dealt.mapInArrow(compose, "word string, n long, near_word string, near_n long")


def forms(words: DataFrame, limit: int = LIMIT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every distinct word of ``words`` (word, n)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    both = near_pairs(words, limit).select(F.explode(F.array(
        F.struct(F.col("word"), F.col("near_word").alias("near"), F.col("near_n").alias("near_n")),
        F.struct(F.col("near_word").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    accepted = -F.col("best.less") >= times * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("best.near")).alias("form"), F.when(accepted, -F.col("best.less")).alias("form_n")), "spelling-forms")
    # a form is ``times`` as frequent as its variant, so a chain of 27 would overflow a long:
    # five doublings at most
    roots = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "spelling-roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_onward"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            break
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("_onward", "root").alias("root"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
