"""Folders of files as they are, hidden and empty ones included, which Spark's own listing leaves out."""

from __future__ import annotations

import os

import pyarrow as pa


def _local(folder: str) -> str | None:
    """The path of a folder on a disk that driver and executors share, or None if it is in another store."""
    plain = folder.removeprefix("file://")
    return plain.rstrip("/") or "/" if "://" not in plain else None


def listed(folder: str) -> list[tuple[str, int, int]]:
    """(relative path, size, time in nanoseconds) of all files, by name; links aren't followed. Names are on the driver, contents aren't."""
    at, out = _local(folder), []
    if at is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted((f.path.removeprefix(inner).lstrip("/"), f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File)
    for top, _, names in os.walk(at):
        for name in names:
            full = os.path.join(top, name)
            if os.path.isfile(full) and not os.path.islink(full):
                info = os.stat(full)
                out.append((os.path.relpath(full, at), info.st_size, info.st_mtime_ns))
    return sorted(out)


def read_one(folder: str, path: str) -> bytes:
    at = _local(folder)
    if at is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{inner.rstrip('/')}/{path}") as f:
            return f.read()
    with open(os.path.join(at, path), "rb") as f:
        return f.read()


def content_reader(folder: str):
    """A function of batches (path, size, mtime) that adds each file's content, a file a batch."""

    def run(batches):
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([read_one(folder, path)], pa.binary()), b.column(1).slice(i, 1), b.column(2).slice(i, 1)], ["path", "content", "size", "mtime"])

    return run
