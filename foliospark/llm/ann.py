"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import checkpoint_ready, mix

#: Neighbours of a query, rows of an average cell, rounds of Lloyd's algorithm.
K, CELL_ROWS, LLOYD_ROUNDS = 10, 64, 6
#: Most centroids of a half: what is shipped to the tasks, a number for each pair of centroids, stays below
#: 8 MB. Beyond 64 * 1,024**2 rows cells grow instead: a walk then takes fewer steps over larger cells.
MOST_CENTROIDS = 1_024
#: Rows whose vec_id this divides are the queries of `op2_nearest_neighbours`; all rows are searched.
EVERY = 20
#: Recall that the number of entries is chosen for, queries that it is measured on, rows of a shard.
RECALL, PROBES, SHARD_ROWS = 0.95, 256, 16_384
#: Rows of a length, not the commonest, up to which they are compared with each other.
FEW_ROWS = 1_024
_BLOCK = 1_024


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


class MultiIndex:
    """Centroids of both vector halves and how many rows each pair of centroids has."""

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.left, self.right, self.counts = left, right, counts

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return _far(x[:, :h], self.left), _far(x[:, h:], self.right)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Centroid pairs (summed distance, left, right) of one query by growing distance, from a heap."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[i].tolist(), b[j].tolist()
        heap, reach = [(sa[0] + sb[0], 0, 0)], [0] * len(sa)
        while heap:
            d, p, q = heapq.heappop(heap)
            yield d, int(i[p]), int(j[q])
            # each row of the grid of pairs is walked from its left; the next row opens with its first pair
            if q + 1 < len(sb):
                heapq.heappush(heap, (sa[p] + sb[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(sa):
                heapq.heappush(heap, (sa[p + 1] + sb[0], p + 1, 0))

    def cutoff(self, a: np.ndarray, b: np.ndarray, entries: int) -> tuple[float, list[int]]:
        """Summed distance at which the walk has met so many entries, and the non-empty left centroids on its way."""
        met, used, d = 0, set(), 0.0
        for d, p, q in self.walk(a, b):
            if n := int(self.counts[p, q]):
                used.add(p)
                met += n
                if met >= entries:
                    break
        return d, sorted(used)


def _lloyd(rows: DataFrame, start: np.ndarray, half: slice, dims: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm over all rows; a round sends one sum for each centroid and task."""
    centroids = start
    k, width = start.shape
    for _ in range(rounds):
        shipped = rows.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            c = shipped.value
            total, n = np.zeros((k, width)), np.zeros(k)
            for b in batches:
                x = _matrix(b.column(0), dims)[:, half]
                near = _far(x, c).argmin(1)
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=k)
            used = np.flatnonzero(n)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total[used].reshape(-1)), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), flat], ["c", "n", "s"])

        parts = rows.select("v").mapInArrow(sums, "c int, n double, s array<double>")
        new = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).toPandas()
        centroids = centroids.copy()
        centroids[new["c"]] = (new[[f"s{i}" for i in range(width)]].to_numpy() / new[["n"]].to_numpy()).astype(np.float32)
    return centroids


def build(rows: DataFrame, n: int, dims: int, cell_rows: int, most: int, rounds: int) -> tuple[MultiIndex, DataFrame]:
    """Index of rows (id, v) and the rows with their centroids a and b."""
    k = max(1, min(most, n, round(math.sqrt(n / cell_rows))))
    h = dims // 2
    # the starting centroids are the k rows with the least hash
    first = rows.orderBy(F.xxhash64("id"), "id").limit(k).toPandas()
    start = np.stack(first["v"].to_numpy()).astype(np.float32)
    left = _lloyd(rows, start[:, :h].copy(), slice(0, h), dims, rounds)
    right = _lloyd(rows, start[:, h:].copy(), slice(h, dims), dims, rounds)
    k = len(start)
    shipped = rows.sparkSession.sparkContext.broadcast(MultiIndex(left, right, np.zeros((k, k), np.int64)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            da, db = shipped.value.distances(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(da.argmin(1).astype(np.int32)), pa.array(db.argmin(1).astype(np.int32))], ["id", "v", "a", "b"])

    placed = rows.mapInArrow(assign, "id long, v array<float>, a int, b int").checkpoint()
    counts = np.zeros((k, k), np.int64)
    found = placed.groupBy("a", "b").count().toPandas()  # a number for each cell, k * k at most
    counts[found["a"], found["b"]] = found["count"]
    return MultiIndex(left, right, counts), placed


def entries_needed(index: MultiIndex, placed: DataFrame, dims: int, k: int, recall: float, probes: int) -> int:
    """Entries that a query has to rerank for the recall, measured on sampled queries against all rows."""
    spark = placed.sparkSession
    sample = placed.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(probes).toPandas()
    queries, ids = np.stack(sample["v"].to_numpy()).astype(np.float32), sample["id"].to_numpy()
    shipped = spark.sparkContext.broadcast((queries, ids))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shipped.value
        best: list[pd.DataFrame] = []
        for b in batches:
            x, key = _matrix(b.column(1), dims), b.column(0).to_numpy()
            d = _far(q, x)
            d[own[:, None] == key[None, :]] = np.inf
            m = min(k, d.shape[1])
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            rows = np.repeat(np.arange(len(q)), m)
            best.append(pd.DataFrame({"q": rows, "d": d[rows, at.reshape(-1)], "a": b.column(2).to_numpy()[at.reshape(-1)], "b": b.column(3).to_numpy()[at.reshape(-1)]}))
            best = [pd.concat(best).sort_values("d", kind="stable").groupby("q").head(k)]
        for t in best:
            t = t[np.isfinite(t["d"])]
            yield pa.RecordBatch.from_pandas(t.astype({"q": "int32", "d": "float32", "a": "int32", "b": "int32"}), preserve_index=False)

    near = placed.mapInArrow(exact, "q int, d float, a int, b int").toPandas().sort_values("d", kind="stable").groupby("q").head(k)
    da, db = index.distances(queries)
    needed = []
    for q, g in near.groupby("q"):
        cells = list(zip(g["a"].tolist(), g["b"].tolist(), strict=True))
        wanted, met = set(cells), 0
        at = {}
        for _, p, r in index.walk(da[q], db[q]):
            met += int(index.counts[p, r])
            if (p, r) in wanted:
                at[p, r] = met
                if len(at) == len(wanted):
                    break
        needed += [at[c] for c in cells]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def rerank(index: MultiIndex, x: np.ndarray, ids: np.ndarray, cells: tuple[np.ndarray, np.ndarray], q: np.ndarray, own: np.ndarray, cut: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, squared distances) of the k nearest rows in the cells up to each query's cut-off.

    x, ids: the shard's rows, ordered by cell; cells: the left and right centroid of each.
    """
    pairs = cells[0].astype(np.int64) * len(index.right) + cells[1]
    begin = np.concatenate(([0], np.flatnonzero(np.diff(pairs)) + 1))
    end = np.append(begin[1:], len(pairs))
    for i in range(0, len(q), _BLOCK):
        part, mine, limit = q[i : i + _BLOCK], own[i : i + _BLOCK], cut[i : i + _BLOCK]
        da, db = index.distances(part)
        bound = np.full(len(part), np.inf, np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        norm = (part * part).sum(1)

        def shrink() -> None:
            nonlocal size
            if not found:
                return
            who, key, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((key, d, who))
            who, key, d = who[order], key[order], d[order]
            first = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            keep = rank < k
            kth = rank == k - 1
            bound[who[kth]] = d[kth]
            found[:] = [(who[keep], key[keep], d[keep])]
            size = int(keep.sum())

        for s, e in zip(begin.tolist(), end.tolist(), strict=True):
            ask = np.flatnonzero(da[:, cells[0][s]] + db[:, cells[1][s]] <= limit)
            if not len(ask):
                continue
            y = x[s:e]
            d = np.maximum(norm[ask][:, None] - 2 * part[ask] @ y.T + (y * y).sum(1), 0)
            r, c = np.nonzero((d <= bound[ask][:, None]) & (mine[ask][:, None] != ids[s:e][None, :]))
            if len(r):
                found.append((ask[r], ids[s:e][c], d[r, c]))
                size += len(r)
                if size > 8 * k * len(part):
                    shrink()
        shrink()
        if found:
            who, key, d = found[0]
            cutting = np.flatnonzero(np.diff(who)) + 1
            for w, a, b in zip(who[np.concatenate(([0], cutting))] if len(who) else [], np.split(key, cutting), np.split(d, cutting), strict=False):
                yield i + int(w), a, b


def shards(rows: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each left centroid, from its rows."""
    first, parts, now, size = [], [], 0, 0
    for n in rows.tolist():
        if size and size + n > shard_rows:
            now, size = now + 1, 0
        first.append(now)
        parts.append(max(1, -(-n // shard_rows)))
        size += n
        if parts[-1] > 1:
            now, size = now + parts[-1], 0
    return np.array(first), np.array(parts)


def nearest(
    vectors: DataFrame, k: int = K, recall: float = RECALL, cell_rows: int = CELL_ROWS, most_centroids: int = MOST_CENTROIDS,
    lloyd_rounds: int = LLOYD_ROUNDS, probes: int = PROBES, shard_rows: int = SHARD_ROWS, every: int = 1,
) -> DataFrame:
    """vec_id, rank (from 1), neighbor_id, distance: the k nearest other rows of every query, by cosine distance.

    Queries are the rows whose vec_id `every` divides (all rows by default); they are searched among all
    rows. Both halves of the unit vectors are quantised separately (Lloyd's algorithm over all rows); a cell
    is a pair of centroids. A query walks the cells in the order of its summed distance, with a heap,
    until it has met enough entries; these are reranked by exact distance. How many are enough is
    measured: sampled queries are compared with all rows, and the number covers `recall` of their true
    neighbours. Cells lie in shards by left centroid; a query goes to the shards its walk has touched. A
    shard holds whole left centroids, so one of more than shard_rows rows is a shard of its own, cut by
    the hash of its rows into parts of about shard_rows, each of which its queries go to.

    Rows with a NULL vec_id, a NULL, empty or zero vector, or NULL or non-finite elements are left out,
    as queries and as neighbours. Vectors of each length are searched among themselves: the commonest
    length and others of more than FEW_ROWS rows with an index each, the rest exactly. Of a repeated
    vec_id one row counts (the largest vector). Equal distances: the lower vec_id first. A table of one row or
    none has no result; a row has fewer than k neighbours where there are fewer others. Vectors of one
    element are searched as if padded with a zero. Other columns are ignored.
    """
    spark = checkpoint_ready(vectors.sparkSession)
    v = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < 1e300)")
    rows = rows.withColumn("norm", F.expr("sqrt(aggregate(v, 0d, (s, e) -> s + e * e))")).where("norm > 0 and norm < 1e300")
    rows = rows.select("id", F.expr("transform(v, e -> cast(e / norm as float))").alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    rows = rows.withColumn("dims", F.size("v")).checkpoint()
    # a number for each length
    about = sorted(((r["count"], r["dims"]) for r in rows.groupBy("dims").count().where("count > 1").collect()), reverse=True)
    schema = "vec_id long, rank int, neighbor_id long, distance double"
    if not about:
        return spark.createDataFrame([], schema)
    indexed = [dims for i, (n, dims) in enumerate(about) if i == 0 or n > FEW_ROWS]
    found = [_searched(rows.where(F.col("dims") == dims).select("id", "v"), n, dims, k, recall, cell_rows, most_centroids, lloyd_rounds, probes, shard_rows, every) for n, dims in about[: len(indexed)]]
    if len(about) > len(indexed):

        def exact(key: tuple, t: pa.Table) -> pa.Table:
            dims = key[0].as_py()
            t = t.combine_chunks().sort_by("id")
            ids, x = t["id"].to_numpy(), _matrix(t["v"].combine_chunks(), dims)
            d = _far(x, x)
            np.fill_diagonal(d, np.inf)
            at = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
            m = at.shape[1]
            ask = np.flatnonzero(ids % every == 0)
            at, d, own = at[ask], d[ask], ids[ask]
            cols = [np.repeat(own, m), np.tile(np.arange(1, m + 1, dtype=np.int32), len(own)), ids[at].reshape(-1), np.take_along_axis(d, at, 1).reshape(-1).astype(float) / 2]
            return pa.table(cols, ["vec_id", "rank", "neighbor_id", "distance"])

        found.append(rows.where(~F.col("dims").isin(indexed)).select("dims", "id", "v").groupBy("dims").applyInArrow(exact, schema))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _searched(rows: DataFrame, n: int, dims: int, k: int, recall: float, cell_rows: int, most_centroids: int, lloyd_rounds: int, probes: int, shard_rows: int, every: int) -> DataFrame:
    """The result of `nearest` for n rows (id, v) of one length."""
    if dims == 1:
        rows, dims = rows.select("id", F.expr("array_append(v, 0f)").alias("v")), 2
    index, placed = build(rows, n, dims, cell_rows, most_centroids, lloyd_rounds)
    entries = entries_needed(index, placed, dims, k, recall, probes) + 1  # a query meets itself
    # whole left centroids fill the shards in their order; a large one fills several by itself
    first_of, parts_of = shards(index.counts.sum(1), shard_rows)
    shipped = rows.sparkSession.sparkContext.broadcast((index, first_of, parts_of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first_of, parts_of = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(at, _BLOCK)
                da, db = index.distances(_matrix(b.column(1), dims))
                src, cut, to = [], [], []
                for r in range(b.num_rows):
                    c, used = index.cutoff(da[r], db[r], entries)
                    for s in sorted({f + p for a in used for f, p in zip([first_of[a]] * parts_of[a], range(parts_of[a]), strict=True)}):
                        src.append(r)
                        cut.append(c)
                        to.append(s)
                take = pa.array(src, pa.int64())
                n = len(src)
                empty = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(n, bool)), b.column(0).take(take), b.column(1).take(take), empty, empty, pa.array(cut, pa.float64())], _names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_of, parts_of = shipped.value
        for b in batches:
            n, a = b.num_rows, b.column(2).to_numpy()
            part = mix(b.column(0).to_numpy().view(np.uint64)) % parts_of[a].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((first_of[a] + part.astype(np.int64)).astype(np.int32)), pa.array(np.zeros(n, bool)), b.column(0), b.column(1), b.column(2), b.column(3), pa.nulls(n, pa.float64())], _names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows come first, then its queries, which are answered as they come."""
        index = shipped.value[0]
        now, held, shard = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                t = whole.slice(at, 4_096)
                places = t.column(0).to_numpy()
                for p in np.unique(places):
                    mine = np.flatnonzero(places == p)
                    b = t.slice(int(mine[0]), len(mine))
                    if p != now:
                        now, held, shard = p, [], None
                    queries = b.column(1).to_numpy(zero_copy_only=False)
                    entries = int((~queries).sum())
                    if entries:
                        held.append(b.slice(0, entries))
                    b = b.slice(entries)
                    if not b.num_rows:
                        continue
                    if shard is None:
                        rows = pa.Table.from_batches(held).combine_chunks()
                        ca, cb = rows.column("a").to_numpy(), rows.column("b").to_numpy()
                        order = np.lexsort((cb, ca))
                        x = np.concatenate([_matrix(h.column(3), dims) for h in held])[order]
                        shard = (x, rows.column("id").to_numpy()[order], (ca[order], cb[order]))
                        held = []
                    ids = b.column(2).to_numpy()
                    out = list(rerank(index, *shard, _matrix(b.column(3), dims), ids, b.column(6).to_numpy() + 1e-5, k))
                    near = [[(float(d) / 2, int(j)) for j, d in zip(key, dist, strict=True)] for _, key, dist in out]
                    kind = pa.list_(pa.struct([("d", pa.float64()), ("j", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(ids[w]) for w, _, _ in out], pa.int64()), pa.array([[{"d": d, "j": j} for d, j in x] for x in near], kind)],
                        ["id", "near"],
                    )

    _names = ["shard", "query", "id", "v", "a", "b", "cut"]
    fields = "shard int, query boolean, id long, v array<float>, a int, b int, cut double"
    asked = placed.where(F.col("id") % every == 0) if every > 1 else placed
    met = placed.mapInArrow(own, fields).unionByName(asked.select("id", "v").mapInArrow(route, fields))
    found = met.repartition("shard").sortWithinPartitions("shard", "query").mapInArrow(search, "id long, near array<struct<d: double, j: long>>")
    best = found.groupBy("id").agg(F.expr(f"slice(array_sort(flatten(collect_list(near))), 1, {k})").alias("near"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("p", "x")).selectExpr("vec_id", "cast(p + 1 as int) rank", "x.j neighbor_id", "x.d distance")
