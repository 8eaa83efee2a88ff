"""Token ids in length-delimited binary record files with an offset index.

A record: the payload's length (uint64), the masked checksum of those eight bytes (uint32), the
payload, the masked checksum of the payload (uint32), all little-endian. The payload is a flag
byte (1: the key is null), the key (int64) and the ids, as uint16 where the vocabulary
allows it, else uint32; the file's first record is a header that states the width. A file's
index (``.idx``) holds the offset of every record as uint64, so a reader can visit records in
any order. The checksum is CRC-32, rotated right by 15 and shifted by a constant, so that a
checksum stored inside checksummed data stays unrelated to it.

Documents are dealt to files by ranges of the key, rows of one key further by their input
position, so a key with a third of all rows is cut over files too. Files are
written by one attempt each under a name of its own and renamed; a lost executor's files are
written again with the same content.

Texts are encoded in pieces between blanks, and between letters and marks: the tokenizer's words
never span them, so the ids of a text are the ids of its pieces in a row, and each worker keeps
the ids of pieces it has met (two generations of bounded size). ``splits_at_space`` and
``parts_at_marks`` test the tokenizer's file for both; other tokenizers encode texts whole.

Defined results: a null text is empty and has the end id only; a null key sorts first; equal
keys keep their input order; an empty table writes no file and gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.llm import store
from estate_spark.llm import text as tx
from estate_spark.session import scratch_path, written

# fixed value: the mask of the checksums
MASK_DELTA = 0xA282EAD8
# end of fixed values
KEPT_PIECES = 250_000              # pieces in a generation of a worker's cache
_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<Bq")
_SUM = struct.Struct("<I")
KEY_BYTES = _KEY.size
_CACHES: dict[str, "PieceEncoder"] = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _SUM.pack(masked(size)), payload, _SUM.pack(masked(payload))))


def key_bytes(key: int | None) -> bytes:
    return _KEY.pack(key is None, key or 0)


def key_of(payload: bytes) -> int | None:
    missing, key = _KEY.unpack_from(payload)
    return None if missing else key


def unframe(source, offset: int) -> tuple[bytes, int]:
    """The record at ``offset`` of a random-access file and the offset behind it."""
    source.seek(offset)
    head = source.read(_HEAD.size)
    size, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"damaged length at {offset}")
    body = source.read(size + 4)
    if masked(body[:size]) != _SUM.unpack(body[size:])[0]:
        raise ValueError(f"damaged record at {offset}")
    return body[:size], offset + _HEAD.size + size + 4


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether the file's pre-tokenizer keeps matches of a pattern without white space only."""
    pre = json.loads(tokenizer_json).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed"


def parts_at_marks(tokenizer_json: str) -> bool:
    """Whether the pattern keeps runs of letters, single digits and runs of all else apart, but
    for endings that begin with an apostrophe."""
    pre = json.loads(tokenizer_json).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    kinds = (first.get("pattern") or {}).get("Regex", "").split("|")
    return {k for k in kinds if not k.startswith("'")} == {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}


def lowers(tokenizer_json: str) -> bool:
    norm = json.loads(tokenizer_json).get("normalizer") or {}
    return any(n.get("type") == "Lowercase" for n in norm.get("normalizers") or [norm])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?()\"-")] = True           # no apostrophe, and none of an added token's characters


def letter_mark_borders(here: np.ndarray) -> np.ndarray:
    """True at a byte that is a mark behind a letter or a letter behind a mark. Letters are those of
    ASCII and, behind a mark's left neighbour only, of U+00C0 to U+00FF."""
    last = _LETTER[here]
    last[1:] |= (here[:-1] == 0xC3) & (here[1:] >= 0x80) & (here[1:] != 0x97) & (here[1:] != 0xB7)
    mark = _MARK[here]
    cut = np.zeros(len(here), bool)
    cut[1:] = (mark[1:] & last[:-1]) | (_LETTER[here[1:]] & mark[:-1])
    return cut


def no_borders(here: np.ndarray) -> np.ndarray:
    return np.zeros(len(here), bool)


class PieceEncoder:
    """Ids of texts as bytes of a fixed width, by the tokenizers library.

    The words of a slice of texts are hashed together; each distinct one is looked up once, and
    the ids of all words are gathered by NumPy. Words are parted between a letter and a mark where
    the file's pattern parts there too, and ASCII capitals are lowered where the file lowers
    them, unless a byte beyond ASCII follows (a combining mark might join one case only). Texts
    with an added token in any case go through the library whole."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            source = f.read()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_at_space(source)
        added = [t["content"].encode().lower() for t in json.loads(source).get("added_tokens") or []]
        self.added = [t for t in added if t]
        marks = self.by_piece and parts_at_marks(source) and not any(_MARK[list(t)].any() for t in self.added)
        self.border = letter_mark_borders if marks else no_borders
        self.lower = lowers(source)
        suffix = json.loads(source)["model"].get("end_of_word_suffix")
        self.ends = None
        if marks and suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces. Those of letters up to U+00FF alone are one word each, which ends
        with the only id marked so; hundreds go to the library as one text and are cut behind those
        ids."""
        texts = [p.decode() for p in pieces]
        if self.ends is None:
            return self._whole(texts)
        out: dict[str, bytes] = {}
        plain = [t for t in texts if t.isalpha() and (t.isascii() or max(t) <= "\u00ff")]
        for a in range(0, len(plain), 500):
            some = plain[a:a + 500]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.width)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, size, at = ids.tobytes(), ids.itemsize, 0
                for p, end in zip(some, (cuts * size).tolist()):
                    out[p] = raw[at:end]
                    at = end
        rest = [t for t in texts if t not in out]
        out.update(zip(rest, self._whole(rest)))
        return [out[t] for t in texts]

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if self.lower:
            up = _UPPER[buffer]
            up[:-1] &= buffer[1:] < 0x80
            buffer = buffer + (up * np.uint8(32))
        h, starts, ends = tx.spans(buffer, tx.BLANKS, self.border)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        raw = buffer.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        young, old = self.young, self.old
        for w in pieces:
            if w not in young and (ids := old.get(w)) is not None:
                young[w] = ids
        new = [w for w in pieces if w not in young]
        young.update(zip(new, self._new(new)))
        known = [young[w] for w in pieces]
        size = np.dtype(self.width).itemsize
        counts = np.fromiter(map(len, known), np.int64, len(known)) // size
        begins = np.cumsum(counts) - counts
        flat = np.frombuffer(b"".join(known), self.width)
        n = counts[place]
        behind = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begins[place] - behind[:-1], n) + np.arange(behind[-1])].tobytes()
        border = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = (behind[np.searchsorted(starts, border)] * size).tolist()
        if len(young) > KEPT_PIECES:
            self.old, self.young = young, {}
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        raw = [t.encode() for t in texts]
        whole = [any(a in t.lower() for a in self.added) for t in raw]
        plain = [t for t, w in zip(raw, whole) if not w]
        parted = iter([ids for a, b in tx.batches_of(plain) for ids in self._slice(plain[a:b])])
        direct = iter(self._whole([t for t, w in zip(texts, whole) if w]))
        return [next(direct if w else parted) for w in whole]


def encoder(path: str) -> PieceEncoder:
    if path not in _CACHES:
        _CACHES[path] = PieceEncoder(path)
    return _CACHES[path]


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                  key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode and write all documents; a table of the files: file_no, path, records, ids, bytes."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-records")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(files, "key", "row").sortWithinPartitions("key", "row")
    rows = rows.select(F.spark_partition_id().alias("file_no"), "key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.width).tobytes()
        target, root = store.filesystem(folder)
        total = {"records": 0, "ids": 0, "bytes": 0}
        file_no, offsets = None, []

        def body(out) -> None:
            nonlocal file_no, at
            for batch in tx.parts(batches):
                if file_no is None:
                    file_no = batch.column("file_no")[0].as_py()
                    head = frame(json.dumps({"width": enc.width, "end": end_id}).encode())
                    out.write(head)
                    at += len(head)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for k, ids in zip(batch.column("key").to_pylist(), enc.encode(texts)):
                    ids += end
                    record = frame(key_bytes(k) + ids)
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    total["records"] += 1
                    total["ids"] += len(ids) // len(end)

        at = 0
        import uuid
        target.create_dir(root, recursive=True)
        own = f"{root}/.attempt-{uuid.uuid4().hex}"
        with target.open_output_stream(own, buffer_size=1 << 20) as out:
            body(out)
        if file_no is None:
            target.delete_file(own)
            return
        path = f"{root}/part-{file_no:06d}.rec"
        store.put(target, path + ".idx", lambda out: out.write(np.array(offsets, "<u8").tobytes()))
        target.move(own, path)
        yield pa.RecordBatch.from_pylist([{"file_no": file_no, "path": path, "bytes": at, **{k: total[k] for k in ("records", "ids")}}], schema=manifest)

    manifest = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("records", pa.int64()),
                          ("ids", pa.int64()), ("bytes", pa.int64())])
    table = rows.mapInArrow(write, "file_no int, path string, records long, ids long, bytes long")
    return written(table, "token-files")


def read_records(manifest: DataFrame, folder_uri: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every record, from the files. ``start`` counts the ids
    of all records in earlier files and before it in its own."""
    spark = manifest.sparkSession
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)   # a row a file
    placed = manifest.select("file_no", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    placed = placed.repartitionByRange(max(1, manifest.count()), "file_no")   # a hash would put files together

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = store.filesystem(folder_uri)
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                with source.open_input_file(row["path"] + ".idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                with source.open_input_file(row["path"]) as f:
                    width = json.loads(unframe(f, 0)[0])["width"]
                    for offset in offsets.tolist():
                        payload, _ = unframe(f, offset)
                        ids = np.frombuffer(payload, width, offset=KEY_BYTES)
                        out.append((key_of(payload), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["key", "start", "n_tokens", "ids_crc32"]
    return placed.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")
