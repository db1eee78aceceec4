"""Listing and hashing inside tasks: what executors do for one directory or one file."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pandas as pd

ENTRY_SCHEMA = (
    "path string, kind string, size long, mode int, mtime_sec long, mtime_nsec int, "
    "link_target string, inode long, rdev long"
)
_COLUMNS = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
_READ_BYTES = 4 << 20
_BATCH_ROWS = 20_000
_KINDS = {
    stat.S_IFREG: "file", stat.S_IFDIR: "dir", stat.S_IFLNK: "symlink", stat.S_IFIFO: "fifo",
    stat.S_IFSOCK: "socket", stat.S_IFBLK: "block", stat.S_IFCHR: "char",
}
# Stores that tasks can list through pyarrow.
_REMOTE = ("hdfs", "s3", "gs", "abfs", "abfss")
Batches = Iterator[pd.DataFrame]


def _scheme(root: str) -> str:
    return root.split(":", 1)[0] if "://" in root or root.startswith("file:") else "file"


def can_list(root: str) -> bool:
    """Whether tasks can list ``root`` on their own."""
    return _scheme(root) in ("file", *_REMOTE)


def _open(root: str):
    """The file system of ``root`` and its path there; local paths give None."""
    if _scheme(root) != "file":
        from pyarrow import fs

        return fs.FileSystem.from_uri(root)
    if root.startswith("file:"):
        return None, "/" + root.removeprefix("file:").lstrip("/")
    return None, os.path.abspath(root)


def _local_entries(base: str, rel: str) -> Iterator[tuple]:
    with os.scandir(os.path.join(base, rel)) as found:
        for e in found:
            info = e.stat(follow_symlinks=False)
            kind = _KINDS[stat.S_IFMT(info.st_mode)]
            yield (
                f"{rel}/{e.name}" if rel else e.name,
                kind,
                info.st_size if kind == "file" else 0,
                stat.S_IMODE(info.st_mode),
                info.st_mtime_ns // 10**9,
                info.st_mtime_ns % 10**9,
                os.readlink(e.path) if kind == "symlink" else None,
                info.st_ino if kind == "file" else None,
                info.st_rdev if kind in ("block", "char") else None,
            )


def _remote_entries(filesystem, base: str, rel: str) -> Iterator[tuple]:
    from pyarrow import fs

    where = f"{base}/{rel}" if rel else base
    for info in filesystem.get_file_info(fs.FileSelector(where)):
        is_dir = info.type == fs.FileType.Directory
        ns = info.mtime_ns or 0
        yield (
            f"{rel}/{info.base_name}" if rel else info.base_name,
            "dir" if is_dir else "file",
            0 if is_dir else info.size,
            None, ns // 10**9, ns % 10**9, None, None, None,
        )


def directory_lister(root: str) -> Callable[[Batches], Batches]:
    """Turn directories (paths below ``root``) into their entries."""

    def run(batches: Batches) -> Batches:
        filesystem, base = _open(root)
        rows = []
        for batch in batches:
            for rel in batch["path"]:
                found = _local_entries(base, rel) if filesystem is None else _remote_entries(filesystem, base, rel)
                for entry in found:
                    rows.append(entry)
                    if len(rows) == _BATCH_ROWS:
                        yield _frame(rows)
                        rows = []
        yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("mode", "inode", "rdev")})


def file_hasher(root: str) -> Callable[[Batches], Batches]:
    """Add the hash of each regular file, read block by block."""

    def digest(filesystem, path: str) -> str:
        h = hashlib.sha256()
        with open(path, "rb") if filesystem is None else filesystem.open_input_stream(path) as f:
            while block := f.read(_READ_BYTES):
                h.update(block)
        return h.hexdigest()

    def run(batches: Batches) -> Batches:
        filesystem, base = _open(root)
        for batch in batches:
            hashes = [
                digest(filesystem, f"{base}/{p}") if k == "file" else None
                for p, k in zip(batch["path"], batch["kind"])
            ]
            yield batch.assign(hash=hashes).astype({c: "Int64" for c in ("mode", "inode", "rdev")})

    return run
