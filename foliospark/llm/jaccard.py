"""Near duplicates by an n-gram Jaccard join in prefix trees."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .text import checkpoint_ready, free_name, gram_hashes, lots, mix, row_key, small, word_hashes

#: Words of a gram, and least Jaccard similarity of a pair.
GRAM, THRESHOLD = 3, 0.5
#: Counters that tell heavy grams (a power of two, a byte each is broadcast), entries of a range of grams,
#: and members of a block that are joined in one tree.
BUCKETS, RANGE_ENTRIES, CHUNK = 1 << 20, 1_000_000, 2_048
#: Levels from here on are those of heavy grams.
HEAVY_LEVEL = 192
_ODD = 0x9E3779B97F4A7C15
#: Bits of a set's bitmap.
BITS = 4_096


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct grams of each text: hashes of n words in a row, of all words if it has fewer."""
    h, counts = word_hashes(texts)
    g = gram_hashes(h, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(g[at : at + c - n + 1]))
        elif c:
            out.append(gram_hashes(h[at : at + c], c)[:1] + np.uint64(c))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


class _Node:
    __slots__ = ("label", "children", "sets", "least", "most", "longest", "part", "up")

    def __init__(self, label: np.ndarray, number: int, up: _Node | None):
        self.label, self.up = label, up
        self.children: dict[int, _Node] = {}
        self.sets: list[int] = []
        self.least = self.most = self.longest = 0
        self.part = number


class PrefixTree:
    """Globally ordered sets with their common prefixes stored once; edges hold runs of elements.

    A set may have more elements than are stored, `size` in all: those that no other set has. The numbered sets belong to parts, `root(number)`, that may be united as time goes on; every node
    knows a set of the one part that all sets below it belong to, or -1 where there are several.
    """

    #: Elements of an edge that are compared before its pruning bound is looked at.
    STEP = 96

    def __init__(self, threshold: float, root: Callable[[int], int] = lambda number: number):
        self.root = _Node(np.zeros(0, np.uint32), -1, None)
        self.at: dict[int, _Node] = {}
        self.size: dict[int, int] = {}
        self.t = threshold
        self.of = root

    def add(self, s: np.ndarray, number: int, size: int | None = None) -> None:
        node, at, n = self.root, 0, len(s)
        full = self.size[number] = n if size is None else size
        while True:
            if not node.most:
                node.part = number
            elif node.part >= 0 and self.of(node.part) != self.of(number):
                node.part = -1
            node.least = min(node.least, full) if node.most else full
            node.most, node.longest = max(node.most, full), max(node.longest, n)
            if at == n:
                node.sets.append(number)
                self.at[number] = node
                return
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = self.at[number] = _Node(s[at:], number, node)
                leaf.least = leaf.most = full
                leaf.longest = n
                leaf.sets.append(number)
                node.children[int(s[at])] = leaf
                return
            k = min(len(child.label), n - at)
            differ = np.flatnonzero(child.label[:k] != s[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.label):
                top = _Node(child.label[:same], child.part, node)
                top.least, top.most, top.longest = child.least, child.most, child.longest
                child.label, child.up = child.label[same:], top
                top.children[int(child.label[0])] = child
                node.children[int(top.label[0])] = top
                child = top
            node, at = child, at + same

    def _only(self, node: _Node, part: int) -> bool:
        """Whether all sets below the node belong to the part by now."""
        if node.part < 0 and len(node.children) + len(node.sets) <= 64:
            below = [c.part for c in node.children.values()] + node.sets
            if below and min(below) >= 0 and len({self.of(b) for b in below}) == 1:
                node.part = below[0]
        return node.part >= 0 and self.of(node.part) == part

    def toward(self, numbers: list[int]) -> set[int]:
        """Identities of the nodes on the way to the sets."""
        way: set[int] = set()
        for k in numbers:
            node: _Node | None = self.at[k]
            while node is not None and id(node) not in way:
                way.add(id(node))
                node = node.up
        return way

    def matches(self, x: np.ndarray, number: int | None = None, way: set[int] | None = None, size: int | None = None) -> Iterator[tuple[int, int]]:
        """(number, overlap) of the stored sets with Jaccard similarity of at least t to x, which has `size` elements in all.

        On the way down the partial overlap of a prefix is shared by all sets below it. With o elements
        in common so far, r of x above the prefix's last element, depth d and l elements in the longest
        set below, no overlap there exceeds o + min(r, l - d); a subtree goes when that falls short of
        what its smallest set takes. With a number of x, sets that are of its part when they are met are
        left out; with a way (see `toward`), nodes that aren't on it.
        """
        t, n = self.t, len(x)
        full = n if size is None else size
        low, high = t * full - 1e-9, full / t + 1e-9
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, overlap, used = stack.pop()
            if node.most < low or node.least > high or (number is not None and self._only(node, self.of(number))):
                continue
            if way is not None and id(node) not in way:
                continue
            label, dead, at = node.label, False, 0
            smallest = max(node.least, low)
            while at < len(label):
                part = label[at : at + self.STEP]
                place = np.searchsorted(x, part)
                inside = place < n
                overlap += int((x[place[inside]] == part[inside]).sum())
                at += len(part)
                used = int(np.searchsorted(x, part[-1], "right"))
                most = overlap + min(n - used, node.longest - depth - at)
                if most < t * (full + smallest - most) - 1e-9:
                    dead = True
                    break
            if dead:
                continue
            depth += len(label)
            for k in node.sets:
                if overlap >= t * (full + self.size[k] - overlap) - 1e-9 and (number is None or self.of(k) != self.of(number)):
                    yield k, overlap
            # the branch that x itself would take comes first
            own = node.children.get(int(x[used])) if used < n else None
            stack += [(c, depth, overlap, used) for c in node.children.values() if c is not own]
            if own is not None:
                stack.append((own, depth, overlap, used))


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITS bits of a set, one for the hash of each element: two sets differ in as many elements as bits at least."""
    b = np.zeros(BITS, np.uint8)
    b[s & np.uint32(BITS - 1)] = 1
    return np.packbits(b).view(np.uint64)


def join_block(sets: list[np.ndarray], ids: list[int], threshold: float, sizes: list[int] | None = None, queries: Iterable[tuple[int, np.ndarray, int]] = ()) -> list[tuple[int, int]]:
    """Pairs of ids that link every two similar sets, directly or through others: a forest of true pairs.

    Each set is a query against the tree of those before it, which aren't larger; a set that is already
    linked to it through others isn't linked again. Bitmaps bound the overlap with all stored sets at
    once: where they rule all out, the tree isn't entered, else only on the way to those that are left.
    Then each of the queries (id, set, size) is linked to every part of the sets that it is similar to.
    Sets may have further elements of their own, which their sizes count.
    """
    full = sizes or [len(s) for s in sets]
    order = sorted(range(len(ids)), key=lambda k: (full[k], ids[k]))
    size = np.array([full[k] for k in order], np.int64)
    held = np.array([len(sets[k]) for k in order], np.int64)
    maps = np.zeros((len(order), BITS // 64), np.uint64)
    # the last place is the query's
    part = np.arange(len(order) + 1)
    tree, out = PrefixTree(threshold, lambda r: int(part[r])), []

    def link(x: np.ndarray, n: int, r: int, own: int, bits: np.ndarray, stop: int) -> None:
        low = int(np.searchsorted(size[:stop], threshold * n - 1e-9))
        high = int(np.searchsorted(size[:stop], n / threshold + 1e-9, "right"))
        if low >= high:
            return
        most = (len(x) + held[low:high] - np.bitwise_count(maps[low:high] ^ bits).sum(1, dtype=np.int64)) >> 1
        left = low + np.flatnonzero(most >= threshold * (n + size[low:high] - most) - 1e-9)
        left = left[part[left] != part[r]]
        if not len(left):
            return
        for other, _ in tree.matches(x, r, tree.toward(left.tolist()), n):
            a, b = int(part[r]), int(part[other])
            if a != b:
                part[part == a] = b
                out.append((own, ids[order[other]]))
                left = left[part[left] != b]
                if not len(left):
                    return

    for r, k in enumerate(order):
        maps[r] = bitmap(sets[k])
        link(sets[k], full[k], r, ids[k], maps[r], r)
        tree.add(sets[k], r, full[k])
    for own, x, n in queries:
        part[-1] = len(order)
        link(x, n, len(order), own, bitmap(x), len(order))
    return out


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Elements of a set, in the global order, of which a set that is similar enough has one among its own such."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def shares(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes each value is in."""
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _cuts(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where the runs of equal values go."""
    if len(sorted_values):
        at = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)])).tolist()
        yield from zip(at[:-1], at[1:], strict=True)


def pack(place: np.ndarray, h: np.ndarray, level: np.ndarray | None = None) -> bytes:
    """Entries in bytes: places of documents in ascending order by their differences, 32-bit hashes, and levels if there are any."""
    z = zlib.compress(np.diff(place, prepend=0).astype(np.uint16).tobytes() + (b"" if level is None else level.tobytes()), 1)
    return np.array([len(h), len(z)], np.uint32).tobytes() + z + h.astype(np.uint32).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and levels (none if there are none) of packed entries."""
    n, m = np.frombuffer(data, np.uint32, 2).tolist()
    z = zlib.decompress(data[8 : 8 + m])
    return np.cumsum(np.frombuffer(z, np.uint16, n).astype(np.int64)), np.frombuffer(data, np.uint32, n, 8 + m), np.frombuffer(z, np.uint8, -1, 2 * n)


def ids_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes that a gram is in, then 32 bits of its hash."""
    h = mix(grams)
    return shares(h, ranges) << np.uint64(32) | (h * np.uint64(_ODD)) >> np.uint64(32)


def shared_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a hash that another one has, and levels that grow with the number of those that have it."""
    order = np.argsort(h, kind="stable")
    k = h[order]
    count = np.diff(np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))) if len(k) else np.zeros(0, np.int64)
    n = np.zeros(len(h), np.int64)
    n[order] = np.repeat(count, count)
    return n > 1, np.minimum(np.log2(np.maximum(n, 1)) * 8, HEAVY_LEVEL - 1).astype(np.uint8)


def kept_sets(ids: np.ndarray, level: np.ndarray, place: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, its shared grams as sorted 32-bit hashes, the ids of those among its first) of sets that can have a partner.

    Unshared grams come first in the order and are not here; a set with fewer shared grams than an
    overlap takes has no partner. The sizes are those of the sets at each place.
    """
    order = np.lexsort((ids, level, place))
    ids, place = ids[order], place[order]
    for i, j in _cuts(place):
        n = int(size[place[i]])
        take = int(prefix_length(np.array([n]), threshold)[0]) - (n - (j - i))
        if take > 0:
            yield int(place[i]), np.unique((mix(ids[i:j]) >> np.uint64(32)).astype(np.uint32)), ids[i : i + take]


def _sketched(rows: DataFrame, n: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, rk, node, size) of the rows with words, and how many grams of all documents each counter has."""
    parts = max(1, buckets >> 16)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint32)
        for b in small(batches):
            texts = b.column(2).to_pylist()
            for i, j in lots(texts):
                sets = gram_sets(texts[i:j], n)
                full = [k for k, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                size = np.array([len(sets[k]) for k in full])
                g = np.concatenate([sets[k] for k in full])
                np.add.at(counts, (g & np.uint64(buckets - 1)).astype(np.int64), np.uint32(1))
                node = class_of(g, size)
                pick = pa.array([i + k for k in full])
                none = pa.nulls(len(full))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)), none.cast(pa.int32()), none.cast(pa.binary())], names)
        z = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, parts)] if counts.any() else []
        none = pa.nulls(len(z), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none.cast(pa.int32()), pa.array(range(len(z)), pa.int32()), pa.array(z, pa.binary())], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(z.as_py()), np.uint32)
                total[p] = total[p] + x if p in total else x.astype(np.uint64)
        # whole powers of two are enough to tell heavy counters
        level = [np.log2(x + 1.0).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], ["part", "z"])

    names = ["doc_id", "rk", "node", "size", "part", "z"]
    both = rows.mapInArrow(sign, "doc_id long, rk long, node long, size int, part int, z binary").checkpoint()
    levels = np.zeros(buckets, np.uint8)
    width = buckets // parts
    # as many bytes as there are counters
    for r in both.where("part is not null").select("part", "z").repartition("part").mapInArrow(merge, "part int, z binary").toLocalIterator():
        levels[r.part * width : (r.part + 1) * width] = np.frombuffer(r.z, np.uint8)
    return both.where("part is null").select("doc_id", "rk", "node", "size"), levels


def class_of(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the sets that lie one after the other: equal sets are one class."""
    return mix(np.add.reduceat(mix(g), np.concatenate(([0], np.cumsum(size)[:-1]))) + size.astype(np.uint64))


def candidate_sets(rows: DataFrame, n: int, threshold: float, levels: np.ndarray, grams: int, range_entries: int) -> DataFrame:
    """node, size, grams, keys of the classes that can have a partner: their shared grams, and those among their first.

    A task takes its documents in lots, whose grams are gathered by ranges of their hashes; there it
    shows which are shared, and by how many documents. These go back to their lots. A gram whose counter
    is heavy is taken for a shared one without being gathered, so that a range's entries fit in memory.
    """
    ranges = min(grams // range_entries + 1, 1 << 30)
    heavy = max(2 * range_entries, 2 * grams // ranges, 4 * grams // len(levels))
    limit = int(np.ceil(np.log2(heavy)))
    shipped = rows.sparkSession.sparkContext.broadcast(levels)
    cell = pa.schema([("range", pa.int32()), ("lot", pa.int64()), ("data", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, task = shipped.value, TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        classes: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        waiting = docs_held = lot = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, docs_held, lot
            out: list[tuple[int, bytes]] = []
            if held:
                ids, place, weight = (np.concatenate(x) for x in zip(*held, strict=True))
                node, size = (np.concatenate(x) for x in zip(*classes, strict=True))
                dense = weight >= limit
                # the lot's classes and heavy grams only pass by, below zero
                away = -1 - (task + lot) % (1 << 20)
                table = np.array([len(node), int(dense.sum())], np.uint32).tobytes() + node.tobytes() + size.astype(np.uint32).tobytes()
                out.append((away, table + ids[dense].tobytes() + pack(place[dense], ids[dense], HEAVY_LEVEL + weight[dense])))
                ids, place = ids[~dense], place[~dense]
                order = np.argsort(ids >> np.uint64(32), kind="stable")
                ids, place = ids[order], place[order]
                out += [(int(ids[i] >> np.uint64(32)), pack(place[i:j], ids[i:j])) for i, j in _cuts(ids >> np.uint64(32))]
            held.clear()
            classes.clear()
            lot += 1
            waiting = docs_held = 0
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([task << 24 | lot] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=cell)

        for b in small(batches):
            texts = b.column(0).to_pylist()
            for i, j in lots(texts):
                sets = [s for s in gram_sets(texts[i:j], n) if len(s)]
                if not sets:
                    continue
                size = np.array([len(s) for s in sets])
                node = class_of(np.concatenate(sets), size)
                # copies in the same task are taken once; others do no harm
                new = [k for k, x in enumerate(node.tolist()) if x not in seen and not seen.add(x)]
                if len(seen) > 1 << 20:
                    seen.clear()
                if not new:
                    continue
                g, size = np.concatenate([sets[k] for k in new]), size[new]
                held.append((ids_of(g, ranges), np.repeat(np.arange(docs_held, docs_held + len(size)), size), level[(g & np.uint64(len(level) - 1)).astype(np.int64)]))
                classes.append((node[new], size))
                docs_held += len(size)
                waiting += len(g)
                if waiting > 1 << 21 or docs_held > 50_000:
                    yield flush()
        yield flush()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[int, bytes]] = []

        def done() -> pa.RecordBatch:
            out: list[tuple[int, bytes]] = []
            if held:
                cells = [unpack(x) for _, x in held]
                h = np.concatenate([x[1] for x in cells])
                many, level = shared_entries(h)
                at = np.cumsum([0] + [len(x[1]) for x in cells]).tolist()
                for (lot, _), (place, own, _), i, j in zip(held, cells, at[:-1], at[1:], strict=True):
                    m = many[i:j]
                    if m.any():
                        out.append((lot, pack(place[m], own[m], level[i:j][m])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now] * len(out), pa.int32()), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=cell)

        for b in batches:
            for r, lot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if r < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([lot], pa.int64()), pa.array([data.as_py()], pa.binary())], schema=cell)
                    continue
                if r != now:
                    yield done()
                now = r
                held.append((lot, data.as_py()))
        yield done()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[int, bytes]] = []

        def done() -> pa.RecordBatch:
            found: list[tuple[int, int, bytes, np.ndarray]] = []
            if held:
                # the lot's own row comes first
                own, rest = held[0][1], held[1:]
                m, k = np.frombuffer(own, np.uint32, 2).tolist()
                node, size = np.frombuffer(own, np.uint64, m, 8), np.frombuffer(own, np.uint32, m, 8 + 8 * m)
                place, _, level = unpack(own[8 + 12 * m + 8 * k :])
                parts = [(np.frombuffer(own, np.uint64, k, 8 + 12 * m), level, place)]
                for r, data in rest:
                    place, h, level = unpack(data)
                    parts.append((h | np.uint64(r << 32), level, place))
                ids, level, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                found = [(int(node[p]), int(size[p]), x.tobytes(), k) for p, x, k in kept_sets(ids, level, place, size, threshold)]
            held.clear()
            cols = [pa.array(np.array([x[0] for x in found], np.uint64).view(np.int64)), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary()), pa.array([x[3].view(np.int64) for x in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["node", "size", "grams", "keys"])

        for b in batches:
            for r, lot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if lot != now:
                    yield done()
                now = lot
                held.append((r, data.as_py()))
        yield done()

    as_cells = "range int, lot long, data binary"
    gathered = rows.select("text").mapInArrow(gather, as_cells).repartition("range").sortWithinPartitions("range")
    back = gathered.mapInArrow(share, as_cells).repartition("lot").sortWithinPartitions("lot", "range")
    sets = back.mapInArrow(keep, "node long, size int, grams binary, keys array<long>")
    # copies of other tasks
    return sets.groupBy("node").agg(F.first(F.struct("size", "grams", "keys")).alias("x")).select("node", "x.*").checkpoint()


def near_duplicates(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, buckets: int = BUCKETS, range_entries: int = RANGE_ENTRIES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, rk, group_id, group_size, keeper of the documents that have a near duplicate.

    A document's set holds the hashes of its n lower-cased words in a row. Groups are the connected
    components of all pairs with Jaccard similarity of at least the threshold; group_id is the least
    doc_id of the group and keeper marks the row that stays: the least doc_id, then the least key.

    Equal sets are one class. All grams have one order: by how many documents have them, then by hash,
    so that those of one document come first and can be left out (see `candidate_sets`). Two similar sets have
    one of the first |s| - ceil(t |s|) + 1 grams of either in common, so no pair is missed: the least
    class that has a gram among its first leads a block, and every class that shares it there is a
    member. A class goes into a block once, however many grams lead it there; a block is joined in a
    prefix tree (see `join_block`). Blocks of more than `chunk` members are split by hash, with their
    leader in every part; members that aren't similar to the leader are then compared with the other
    parts, too. Every pair found is exact up to hash collisions.

    Texts that are NULL or have no words are nobody's duplicates. Repeated rows (same doc_id and text)
    appear once; NULL doc_ids are the least. Other columns are ignored.
    """
    checkpoint_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("rk"), "text").where("text is not null")
    signed, levels = _sketched(rows, n, buckets)
    # one number
    grams = int(signed.agg(F.sum("size")).first()[0] or 0)
    sets = candidate_sets(rows, n, threshold, levels, grams, range_entries)
    firsts = sets.select("node", F.explode("keys").alias("key"))
    leads = firsts.groupBy("key").agg(F.min("node").alias("block"), F.max("node").alias("most")).where("block <> most").select("key", "block")
    met = firsts.join(leads.hint("shuffle_hash"), "key").select("node", "block").distinct().checkpoint()
    large = met.groupBy("block").count().where(F.col("count") > chunk).select("block", F.expr(f"cast(ceil(count / {chunk}) as int)").alias("parts")).checkpoint()
    met = met.join(large.hint("shuffle_hash"), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("part", F.explode(F.when(F.expr("node = block"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    filled = sets.select("node", "size", "grams").join(met.hint("shuffle_hash"), "node").select("block", "part", "parts", "node", "size", "grams")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b) of every part of a block, and of large blocks the members that aren't similar to the leader."""

        def done(held: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
            sets = [np.frombuffer(x, np.uint32) for _, x in held.values()]
            sizes = [n for n, _ in held.values()]
            pairs = join_block(sets, list(held), threshold, sizes) if len(held) > 1 else []
            rest = []
            if now is not None and now[2] > 1:
                n, x = held[now[0]]
                lead = np.frombuffer(x, np.uint32)
                for k, s, m in zip(held, sets, sizes, strict=True):
                    both = len(np.intersect1d(s, lead, assume_unique=True))
                    if both < threshold * (m + n - both) - 1e-9:
                        rest.append(k)
            none = [None] * len(pairs)
            block = [none + [v] * len(rest) for v in (now or (None,) * 3)]
            cols = [[p[0] for p in pairs] + rest, [p[1] for p in pairs] + [None] * len(rest), *block, none + [held[k][0] for k in rest], none + [held[k][1] for k in rest]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["a", "b", "block", "part", "parts", "size", "grams"])

        now, held = None, {}
        for b in batches:
            for block, part, parts, node, size, grams in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (block, part, parts) != now and held:
                    yield done(held)
                    held = {}
                now = (block, part, parts)
                held[node] = (size, grams)
        yield done(held)

    linked = filled.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(link, "a long, b long, block long, part int, parts int, size int, grams binary").checkpoint()
    edges = linked.where("block is null").select("a", "b")
    if large.limit(1).count() and linked.where("block is not null").limit(1).count():

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A part's members come first, then what is compared with it from other parts."""

            def done(held: dict[int, tuple[int, bytes]], asked: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
                queries = ((k, np.frombuffer(x, np.uint32), n) for k, (n, x) in asked.items())
                pairs = join_block([np.frombuffer(x, np.uint32) for _, x in held.values()], list(held), threshold, [n for n, _ in held.values()], queries) if asked else []
                return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], ["a", "b"])

            now, held, asked = None, {}, {}
            for b in batches:
                for block, part, _, node, size, grams, query in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                    if (block, part) != now or len(asked) >= 2 * chunk:
                        yield done(held, asked)
                        asked = {}
                        held = held if (block, part) == now else {}
                    now = (block, part)
                    (asked if query else held)[node] = (size, grams)
            yield done(held, asked)

        other = F.explode(F.expr("filter(sequence(0, parts - 1), p -> p <> part)"))
        asked = linked.where("block is not null").select("block", other.alias("p"), "parts", F.col("a").alias("node"), "size", "grams", F.lit(True).alias("query")).withColumnRenamed("p", "part")
        both = filled.where("parts > 1").withColumn("query", F.lit(False)).unionByName(asked)
        edges = edges.unionByName(both.repartition("block", "part").sortWithinPartitions("block", "part", "query", "node").mapInArrow(cross, "a long, b long"))
    parts = connected_components(edges).selectExpr("node", "component")
    placed = signed.select("doc_id", "rk", "node").distinct().join(parts, "node", "left").select("doc_id", "rk", F.coalesce("component", "node").alias("component"))
    groups = placed.groupBy("component").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_id", "rk")).alias("k")).where("group_size > 1")
    return placed.join(groups, "component").select("doc_id", "rk", F.col("k.doc_id").alias("group_id"), "group_size", (F.col("rk") == F.col("k.rk")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """One document of each group of near duplicates (its keeper) and all documents without any, with all columns.

    Repeated rows count as copies: one of them stays. Rows with a NULL or empty text all stay. An empty
    table stays empty; no column of the documents is taken for one of the operator's own.
    """
    key = free_name(docs, "row")
    found = near_duplicates(docs, **kw).checkpoint()
    drops = found.where("not keeper").select(F.col("rk").alias(key)).distinct()
    kept = docs.withColumn(key, row_key()).join(drops.hint("shuffle_hash"), key, "left_anti")
    # rows that occur more than once are rare: only they are looked at for it
    again = docs.where("trim(text) <> ''").groupBy(row_key().alias(key)).count().where("count > 1").select(key).checkpoint()
    if again.count():
        one = kept.join(again, key, "left_semi").dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
