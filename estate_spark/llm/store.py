"""Files of the shared folder as tasks see them, and streams of grouped Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path inside it; plain paths are local mounts."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def put(files: fs.FileSystem, path: str, write) -> None:
    """Write a file under a name of this attempt, then rename: a lost or repeated attempt never
    leaves half a file under the final name."""
    folder = path.rpartition("/")[0]
    files.create_dir(folder, recursive=True)
    own = f"{folder}/.attempt-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, path)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batch borders; the stream is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k) for k in keys]
        changes = None
        for c in cols:
            diff = pc.not_equal(c.slice(1), c.slice(0, n - 1)) if n > 1 else pa.array([], pa.bool_())
            changes = diff if changes is None else pc.or_(changes, diff)
        starts = [0, *(i + 1 for i, x in enumerate(changes.to_pylist()) if x), n]
        for a, b in zip(starts, starts[1:]):
            here = tuple(c[a].as_py() for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)
