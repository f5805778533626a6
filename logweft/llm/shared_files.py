"""Array files in the shared folder, written by executors and memory-mapped by executors.

A file is a JSON header line and arrays at 64-byte marks. On a local or mounted file system it is
mapped where it lies. From another store (HDFS, object stores) a file is fetched into a folder that all
workers of a machine share, and mapped there; beyond ``LOCAL_BYTES`` the files that were fetched longest
ago are unlinked, which leaves the maps that use them whole.

A map keeps no file open (before Python 3.13 the interpreter does keep one for each), so that the number of
files does not meet the limit of open files. Maps holds as many as the system lets a process have, and
where they are large lets their pages go after use: then what is resident is one file's share.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import sys
import tempfile
from collections.abc import Callable
from contextlib import suppress

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

LOCAL_BYTES = 16 << 30
MAPS = 20_000  # Linux lets a process have 65,530
RESIDENT = 1 << 30
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
LOCAL = os.path.join(tempfile.gettempdir(), f"logweft-maps-{os.getuid()}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, so that executors reach the same store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes under another name and moves: a repeated or doubled task leaves one whole file."""
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a)
        head[name] = (raw.dtype.str, len(raw), at)
        pad = -raw.nbytes % 64
        body.append(raw.tobytes() + bytes(pad))
        at += raw.nbytes + pad
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    fs, where = store(path)
    fs.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{os.getpid()}-{os.urandom(4).hex()}.part"
    with fs.open_output_stream(part) as f:
        f.write(line)
        for x in body:
            f.write(x)
    fs.move(part, where)


def fetched(fs: pafs.FileSystem, where: str, path: str) -> str:
    """A copy of the file in LOCAL, made whole under another name first; workers that ask at once both
    copy, and either copy stays."""
    os.makedirs(LOCAL, exist_ok=True)
    local = os.path.join(LOCAL, hashlib.sha256(path.encode()).hexdigest())
    if not os.path.exists(local):
        part = f"{local}.{os.getpid()}.part"
        pafs.copy_files(where, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        os.replace(part, local)
        with suppress(FileNotFoundError):  # another worker is clearing up as well
            held = sorted((e.stat().st_mtime, e.stat().st_size, e.path) for e in os.scandir(LOCAL) if not e.name.endswith(".part"))
            spare = sum(size for _, size, _ in held) - LOCAL_BYTES
            for _, size, old in held:
                if spare > 0 and old != local:
                    os.unlink(old)
                    spare -= size
    return local


def mapped(path: str) -> tuple[mmap.mmap, dict[str, np.ndarray]]:
    if path.startswith("file:"):
        where = "/" + path[len("file:") :].lstrip("/")
    else:
        fs, where = store(path)
        if not isinstance(fs, pafs.LocalFileSystem):
            where = fetched(fs, where, path)
    with open(where, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
    body = raw.find(b"\n") + 1
    return raw, {k: np.frombuffer(raw, kind, n, body + at) if n else np.zeros(0, kind) for k, (kind, n, at) in json.loads(raw[:body]).items()}


def load(path: str) -> dict[str, np.ndarray]:
    return mapped(path)[1]


class Maps:
    """Maps that a process keeps, at most MAPS; the oldest give way and are made anew when asked for."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[mmap.mmap, dict]] = {}
        self.size = 0

    def get(self, path: str, made: Callable[[dict], dict] = dict) -> dict:
        if path not in self.open:
            if len(self.open) >= MAPS:
                self.size -= len(self.open.pop(next(iter(self.open)))[0])
            raw, arrays = mapped(path)
            self.open[path] = raw, made(arrays)
            self.size += len(raw)
        return self.open[path][1]

    def used(self, *paths: str) -> None:
        """Once all maps together are larger than RESIDENT, the pages of these leave the process; the
        system keeps them in its cache."""
        if self.size > RESIDENT and hasattr(mmap, "MADV_DONTNEED"):
            for path in paths:
                if path in self.open:
                    self.open[path][0].madvise(mmap.MADV_DONTNEED)
