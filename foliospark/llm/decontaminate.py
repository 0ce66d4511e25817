"""Benchmark decontamination with Wu-Manber multi-pattern search."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import row_key, small

#: Words of a test string; items with fewer words are one string each, from MIN_WORDS words or MIN_CHARS
#: characters on.
WINDOW, MIN_WORDS, MIN_CHARS = 13, 6, 40
#: Bytes of items that one pass over the documents searches; more take further passes. What is shipped for
#: a pass is at most six times as much.
PASS_BYTES = 32_000_000
#: Longest block in bytes.
BLOCK = 32
_other = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, words only, one space around each."""
    return " " + _other.sub(" ", text.lower()).strip() + " "


def windows_of(text: str | None, window: int = WINDOW, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> tuple[bytes, list[int], list[int]]:
    """An item's normal form and where its test strings begin and end: each run of `window` words, with a space on either side."""
    t = normal(text or "")
    n = len(t.split())
    raw = t.encode("utf-8", "replace")
    if not n or (n < min_words and len(t) - 2 < min_chars):
        return b"", [], []
    gaps = [m.start() for m in re.finditer(b" ", raw)]
    k = max(1, n - window + 1)
    return raw, gaps[:k], [gaps[min(i + window, n)] + 1 for i in range(k)]


def strings_of(text: str | None, window: int = WINDOW, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> list[str]:
    """The different test strings of one item."""
    raw, start, end = windows_of(text, window, min_words, min_chars)
    return list(dict.fromkeys(raw[a:b].decode() for a, b in zip(start, end, strict=True)))


def _prime(least: int) -> int:
    n = least | 1
    while any(n % k == 0 for k in range(3, math.isqrt(n) + 1, 2)):
        n += 2
    return n


class WuManber:
    """Shift table over blocks, buckets of strings by suffix block, direct comparison.

    The strings are runs of bytes of one text, from `start` to `end`, so that overlapping ones are held
    once. The table is indexed by the blocks modulo a prime; blocks that share a place have the
    least of their shifts there, which is safe.
    """

    def __init__(self, text: bytes, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
        order = np.argsort(start, kind="stable")
        self.text, self.start, self.end, self.owner = text, start[order], end[order], owner[order]
        self.m = m = int(min((end - start).min(), 255))
        # blocks long enough that a chance block of the text is rarely one of a string
        self.block = b = max(1, min(m, BLOCK, math.ceil(math.log(20 * len(text) + 2, 3))))
        self.prime = _prime(max(1 << 16, 2 * len(text)))
        at = np.arange(b, len(text) + 1)
        # of the strings whose first m bytes hold the block that ends here, the first has the least shift
        first = np.searchsorted(self.start, at - m)
        have = first < len(self.start)
        at, s = at[have], self.start[first[have]]
        inside = s <= at - b
        at, s = at[inside], s[inside]
        shift = np.full(self.prime, m - b + 1, np.uint8)
        raw = np.frombuffer(text, np.uint8)
        for i in range(0, len(at), 1 << 20):
            part = at[i : i + (1 << 20)]
            np.minimum.at(shift, self._places(raw, part), (m - (part - s[i : i + (1 << 20)])).astype(np.uint8))
        self.shift = shift.tobytes()
        key = self._places(raw, self.start + m)
        by = np.argsort(key, kind="stable")
        self.keys, self.by = key[by].astype(np.uint32), by.astype(np.uint32)

    def _places(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks that end at these bytes, as little-endian numbers, modulo the prime."""
        out = np.zeros(len(at), np.uint64)
        for j in range(1, self.block + 1):
            out = (out * np.uint64(256) + raw[at - j]) % np.uint64(self.prime)
        return out

    def search(self, text: bytes, any_one: bool = False) -> set[tuple[int, bytes]]:
        """The strings that occur, with their owners; with any_one, the first that is found."""
        found: set[tuple[int, bytes]] = set()
        m, b, p, shift, number = self.m, self.block, self.prime, self.shift, int.from_bytes
        i, n = m, len(text)
        while i <= n:
            place = number(text[i - b : i], "little") % p
            s = shift[place]
            if s:
                i += s
                continue
            k = int(np.searchsorted(self.keys, np.uint32(place)))
            while k < len(self.keys) and self.keys[k] == place:
                w = int(self.by[k])
                string = self.text[self.start[w] : self.end[w]]
                if text.startswith(string, i - m):
                    found.add((int(self.owner[w]), string))
                    if any_one:
                        return found
                k += 1
            i += 1
        return found


def _passes(benchmark: DataFrame, window: int, min_words: int, min_chars: int, pass_bytes: int) -> Iterator[tuple[WuManber, list[int | None]]]:
    """Finders over items of up to pass_bytes bytes (or of one item), and the item_ids by owner."""
    texts: list[bytes] = []
    start: list[np.ndarray] = []
    end: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    items: list[int | None] = []
    size = 0

    def finder() -> WuManber:
        return WuManber(b"".join(texts), np.concatenate(start), np.concatenate(end), np.concatenate(owner))

    for r in benchmark.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        raw, a, z = windows_of(r.text, window, min_words, min_chars)
        if not a:
            continue
        same = bool(items) and items[-1] == r.item_id
        # an item of several texts stays in one pass, so that its strings are counted once
        if size + len(raw) > pass_bytes and texts and not same:
            yield finder(), items
            texts, start, end, owner, items, size, same = [], [], [], [], [], 0, False
        if not same:
            items.append(r.item_id)
        texts.append(raw)
        start.append(np.array(a, np.int64) + size)
        end.append(np.array(z, np.int64) + size)
        owner.append(np.full(len(a), len(items) - 1, np.int64))
        size += len(raw)
    if texts:
        yield finder(), items


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, n_strings: how many different test strings of the item occur in the document.

    Both sides are compared in lower case with runs of other than letters and digits as one space; an
    occurrence starts and ends at word boundaries. NULL and empty texts and items match nothing, as do
    items of fewer than min_words words and min_chars characters. A document or item that occurs twice
    counts once for the same doc_id and text; a NULL doc_id or item_id is carried on. Other columns are
    ignored. The tables of a pass are made once, on the driver, and are as large as pass_bytes tells.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("rk"), "text").where("text is not null")
    out = base.selectExpr("doc_id", "rk", "doc_id item_id", "rk n_strings", "0 lot").where("false")
    for no, lot in enumerate(_passes(benchmark, window, min_words, min_chars, pass_bytes)):
        shipped = sc.broadcast(lot)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            finder, items = shipped.value
            for b in small(batches):
                out: list[list] = [[], [], [], []]
                for i, k, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    hits: dict[int, int] = {}
                    for item, _ in finder.search(normal(t).encode("utf-8", "replace")):
                        hits[item] = hits.get(item, 0) + 1
                    for x, values in zip(out, ([i] * len(hits), [k] * len(hits), [items[h] for h in hits], hits.values()), strict=True):
                        x.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "rk", "item_id", "n_strings"])

        found = base.mapInArrow(run, "doc_id long, rk long, item_id long, n_strings long").withColumn("lot", F.lit(no))
        out = found if no == 0 else out.unionByName(found)
    # a repeated row counts once in each lot; the lots hold different items
    each = out.groupBy("doc_id", "rk", "item_id", "lot").agg(F.max("n_strings").alias("n"))
    return each.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_strings"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents in which no test string occurs (see `contaminated`), with all their columns.

    A filter without a shuffle: each lot of items is one pass over what the lots before it left. Rows
    with a NULL or empty text stay, repeated rows stay or go together. An empty benchmark keeps all.
    """
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    for finder, _ in _passes(benchmark, window, min_words, min_chars, pass_bytes):
        shipped = sc.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            finder = shipped.value
            for b in small(batches):
                yield b.filter(pa.array([not (t and finder.search(normal(t).encode("utf-8", "replace"), True)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
