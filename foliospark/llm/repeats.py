"""Substring deduplication: repeats across documents from prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import checkpoint_ready, gram_hashes, lots, row_key, word_hashes

#: Words of the shortest repeat, words of the short prefix that splits the suffixes, words of an edge of
#: a tree, and runs of suffixes from which on a group is split by prefixes of MIN_WORDS words.
MIN_WORDS, PREFIX, EDGE, GROUP_RUNS = 50, 12, 10, 4_096


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least of the width values from each place on."""
    at = np.arange(len(g))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        have += step
    return at


def suffix_runs(h: np.ndarray, counts: np.ndarray, min_words: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes that go to one group: document, first and last suffix (by word), key of the group.

    Each suffix with min_words words goes to the group of the least-hashed gram of `prefix` words within
    its first min_words words. Equal beginnings of min_words words have the same such gram at the same
    distance, so they meet; neighbours mostly share it, so that their words travel once.
    """
    end = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    if not len(h) or counts.max() < min_words:
        return none, none, none, none
    g = gram_hashes(h, prefix)
    start = np.repeat(end - counts, counts)
    stop = np.repeat(end, counts)
    place = np.arange(len(h))
    valid = np.flatnonzero(place + min_words <= stop)
    anchor = _least(g[: len(h) - prefix + 1], min_words - prefix + 1)[valid]
    new = np.concatenate(([True], (np.diff(valid) != 1) | (np.diff(anchor) != 0) | (np.diff(start[valid]) != 0)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    base = start[valid[first]]
    return np.searchsorted(end, base, "right"), valid[first] - base, valid[last] - base, g[anchor[first]].view(np.int64)


def deep_nodes(words: np.ndarray, at: np.ndarray, group: np.ndarray, owner: np.ndarray, depth: int, edge: int) -> np.ndarray:
    """Which of the suffixes words[at:] pass an internal node of at least the depth with leaves of two owners.

    All subtrees of the given groups grow together, an edge of up to `edge` words at a time from their
    roots; a branch with a single leaf ends, as no internal node lies below it.
    """
    live = np.arange(len(at))
    node = group.astype(np.uint64)
    done = 0
    while done < depth and len(live):
        step = min(edge, depth - done)
        label = gram_hashes(words, step)[at[live] + done]
        _, node, size = np.unique(node * np.uint64(0x9E3779B97F4A7C15) + label, return_inverse=True, return_counts=True)
        shared = size[node] > 1
        live, node = live[shared], node[shared].astype(np.uint64)
        done += step
    out = np.zeros(len(at), bool)
    if len(live):
        order = np.argsort(node, kind="stable")
        cut = np.concatenate(([0], np.flatnonzero(np.diff(node[order])) + 1))
        who = owner[live[order]]
        several = np.minimum.reduceat(who, cut) != np.maximum.reduceat(who, cut)
        out[live[order]] = np.repeat(several, np.diff(np.append(cut, len(order))))
    return out


_SPANS = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("f", pa.int64()), ("t", pa.int64())])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, edge: int = EDGE, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, word_from, word_to (exclusive), n_words: the passages that occur in another document too.

    The text is a sequence of lower-cased words (between ASCII white space). A passage is the union of
    overlapping or adjoining maximal repeats of at least min_words words, each of which occurs in at
    least two documents. Every suffix of a document belongs to the group of a gram in its beginning;
    groups that hold one document's suffixes end there. A group's suffixes form a suffix tree down to
    the depth min_words; an internal node that deep, with leaves of two documents, is the beginning of
    a repeat, and the repeats that begin at successive words make up the maximal ones. Prefixes are as
    long as it takes for a group to fit in memory: where more than group_runs runs share the gram, a
    suffix goes by its first min_words words, which is the longest prefix that can matter, as a group
    is one such node then; its suffixes are taken as they come.

    NULL, empty and shorter texts have no passages. A repeated row (same doc_id and text) is the same
    document; equal texts under different (or one NULL) doc_ids are different documents. Other columns
    are ignored. Words count from 0.
    """
    checkpoint_ready(docs.sparkSession)
    rows = docs.select(row_key().alias("rk"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for i, j in lots(texts, 1 << 21):
                d, first, last, key = suffix_runs(*word_hashes(texts[i:j]), min_words, prefix)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rk[i:j][d]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["key", "rk", "f", "l"])

    # runs are shuffled once by key: both the counts and the join read that, row by row, so that no task
    # holds a key's runs; the counts take all columns for the shuffle to be the same
    runs = rows.select("rk", "text").mapInArrow(split, "key long, rk long, f int, l int").repartition("key")
    groups = runs.groupBy("key").agg(F.min("rk").alias("a"), F.max("rk").alias("b"), F.expr("count(f, l)").alias("n")).where("a <> b").select("key", (F.col("n") > group_runs).alias("hot"))
    runs = runs.join(groups.hint("shuffle_hash"), "key").select("rk", F.struct("key", "f", "l", "hot").alias("run"))
    # a repeated row has its runs more than once
    runs = runs.groupBy("rk").agg(F.collect_set("run").alias("runs"))
    texts = rows.join(runs.hint("shuffle_hash"), "rk")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("rk", pa.int64()), ("doc_id", pa.int64()), ("f", pa.int64()), ("words", pa.binary())])
        for b in batches:
            rk, ids, texts, found = (b.column(c) for c in ("rk", "doc_id", "text", "runs"))
            for i, j in lots(texts.to_pylist(), 1 << 20):
                h, counts = word_hashes(texts.slice(i, j - i).to_pylist())
                long = gram_hashes(h, min_words).view(np.int64)
                small = (h >> np.uint64(32)).astype(np.uint32)
                base = 0
                out: list[list] = [[], [], [], [], []]
                for k in range(i, j):
                    for r in found[k].as_py():
                        f, last = r["f"], r["l"]
                        if r["hot"]:
                            n = last - f + 1
                            rest = (long[base + f : base + last + 1].tolist(), [rk[k].as_py()] * n, [ids[k].as_py()] * n, range(f, last + 1), [None] * n)
                        else:
                            rest = ([r["key"]], [rk[k].as_py()], [ids[k].as_py()], [f], [small[base + f : base + last + min_words].tobytes()])
                        for x, y in zip(out, rest, strict=True):
                            x.extend(y)
                    base += int(counts[k - i])
                yield pa.RecordBatch.from_arrays([pa.array(x, s.type) for x, s in zip(out, schema, strict=True)], schema=schema)

    shipped = texts.select("rk", "doc_id", "text", "runs").mapInArrow(ship, "key long, rk long, doc_id long, f long, words binary")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups are gathered to lots of suffixes whose trees grow together; lots end between two groups."""

        def spans(rk, ids, f, t) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), ids, pa.array(f, pa.int64()), pa.array(t, pa.int64())], schema=_SPANS)

        def trees(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            key, rk, f = (t.column(c).to_numpy() for c in ("key", "rk", "f"))
            ids = t.column("doc_id").combine_chunks()
            words = t.column("words").combine_chunks()
            whole = np.flatnonzero(np.asarray(words.is_null()))
            if len(whole):  # groups with the long prefix: a node each
                cut = np.concatenate(([0], np.flatnonzero(np.diff(key[whole])) + 1))
                both = np.minimum.reduceat(rk[whole], cut) != np.maximum.reduceat(rk[whole], cut)
                hit = whole[np.repeat(both, np.diff(np.append(cut, len(whole))))]
                yield spans(rk[hit], ids.take(pa.array(hit)), f[hit], f[hit] + min_words)
            part = np.flatnonzero(~np.asarray(words.is_null()))
            if len(part):
                held = [np.frombuffer(x, np.uint32) for x in words.take(pa.array(part)).to_pylist()]
                size = np.array([len(x) for x in held])
                n = size - min_words + 1
                who = np.repeat(np.arange(len(part)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(size) - size, n) + step
                group = np.cumsum(np.concatenate(([0], np.diff(key[part]) != 0)))
                hit = deep_nodes(np.concatenate(held).astype(np.uint64), at, group[who], rk[part][who], min_words, edge)
                # successive suffixes of one run make one span
                edge_on = hit & ~(np.concatenate(([False], hit[:-1])) & (step > 0))
                edge_off = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((step[1:] > 0, [False])))
                a, z = np.flatnonzero(edge_on), np.flatnonzero(edge_off)
                row = part[who[a]]
                yield spans(rk[row], ids.take(pa.array(row)), f[row] + step[a], f[row] + step[z] + min_words)

        held: list[pa.RecordBatch] = []
        rows_held = 0
        for b in batches:
            while b.num_rows:
                piece, b = b.slice(0, 2_000), b.slice(2_000)
                held.append(piece)
                rows_held += piece.num_rows
                if rows_held < 4_000:
                    continue
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield from trees(t.slice(0, cut))
                rest = t.slice(cut)
                if rest.num_rows > 4 * group_runs and rest.column("words").null_count == rest.num_rows:
                    rest, out = _thin(rest, min_words)
                    yield out
                held, rows_held = rest.to_batches(), rest.num_rows
        if rows_held:
            yield from trees(pa.Table.from_batches(held))

    grown = shipped.repartition("key").sortWithinPartitions("key").mapInArrow(grow, "rk long, doc_id long, f long, t long")
    ordered = Window.partitionBy("rk").orderBy("f", "t")
    before = F.max("t").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = grown.distinct().withColumn("new", F.when(before >= F.col("f"), 0).otherwise(1)).withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    passages = islands.groupBy("rk", "doc_id", "island").agg(F.min("f").alias("word_from"), F.max("t").alias("word_to"))
    return passages.select("doc_id", "word_from", "word_to", F.expr("word_to - word_from").alias("n_words"))


def _thin(rest: pa.Table, min_words: int) -> tuple[pa.Table, pa.RecordBatch]:
    """Of a node's many leaves, those that are settled as spans, and one leaf of each of two owners that stays."""
    rk = rest.column("rk").to_numpy()
    other = np.flatnonzero(rk != rk[0])
    if not len(other):
        return rest, pa.RecordBatch.from_pylist([], _SPANS)
    f = rest.column("f").to_numpy()
    out = pa.RecordBatch.from_arrays([pa.array(rk), rest.column("doc_id").combine_chunks(), pa.array(f), pa.array(f + min_words)], schema=_SPANS)
    return rest.take(pa.array([0, int(other[0])])), out
