"""Vectorised text helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; a longer document is cut between two words.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_tables: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_gap = re.compile(rb"[\t-\r ]")


def checkpoint_ready(spark: SparkSession) -> SparkSession:
    """Make the shared folder that spark.checkpoint.dir names the session's checkpoint folder.

    Only a session in one machine may do without the setting (as in tests), as a temporary folder of
    one machine is no shared one: an error on a cluster.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliospark-checkpoints-"))
    return spark


def written(df: DataFrame) -> DataFrame:
    """The rows from a table written to the checkpoint folder: lineage is cut as by a checkpoint, in less space."""
    folder = f"{checkpoint_ready(df.sparkSession).sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row that nulls don't break and repeated rows share."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")), F.coalesce(F.col(text), F.lit("\0null")))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few of their values are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def lots(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` characters, so that arrays over them stay small; a longer text ends its run."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        n = max(n, PIECE + 4096)
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inv):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables = (out[0], out[1])
    return _tables


def _hash_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run without ASCII white space) of the bytes."""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and the number of words of each text (0 for NULL)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    buf: list[bytes] = []
    at: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if buf:
            h, start = _hash_bytes(b" ".join(buf))
            firsts = np.cumsum([0] + [len(x) + 1 for x in buf[:-1]])
            n = np.diff(np.append(np.searchsorted(start, firsts), len(start)))
            np.add.at(counts, at, n)
            hashes.append(h)
            buf.clear()
            at.clear()
            size = 0

    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace") if t else b""
        while len(raw) > PIECE and (m := _gap.search(raw, PIECE)):
            flush()
            buf.append(raw[: m.start()])
            at.append(i)
            flush()
            raw = raw[m.end() :]
        buf.append(raw)
        at.append(i)
        size += len(raw) + 1
        if size > PIECE:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on (those that run past the end are of no use)."""
    g = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        top = len(h) - n + 1
        for j in range(n):
            g[:top] = g[:top] * np.uint64(0xD6E8FEB86659FD93) + h[j : j + top]
        g[:top] = mix(g[:top])
    return g
