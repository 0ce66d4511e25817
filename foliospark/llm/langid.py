"""Language identification as inference of a mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lots, small

#: Labelled rows that the models are fitted on (the expected size of a sample by hashed doc_id, which is
#: the whole table where that is smaller), and the labelled rows that a language needs in the whole table.
TRAIN_ROWS, LEAST_ROWS = 4_000, 5
#: Rows that a language has in the sample at least (an expected size, too), or all that it has.
LANG_ROWS = 200
_RANGE = 1 << 24
#: Least share of a language in a document's set, penalty of a further language in units of the
#: logarithm of the words, and how much likelier (nats) unknown words must be for a rejection.
MIN_SHARE, PENALTY, MARGIN = 0.05, 3.0, 10.0
#: Buckets of hashed character trigrams; log-probability of a trigram in unknown text, and the least in any.
BUCKETS, UNKNOWN, FLOOR = 1 << 16, -9.9, -13.0
ROUNDS = 10
#: Characters that are handled at a time.
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, the index of each word's first letter among them, and its place in the text."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate(([False], _letter_table()[a], [False]))
    b = np.full(len(a) + 2, 32, np.uint32)
    b[1:-1][letter[1:-1]] = a[letter[1:-1]]
    at = np.flatnonzero(letter)
    h = b[at - 1] * np.uint32(0x9E3779B1) + b[at] * np.uint32(0x85EBCA77) + b[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~letter[at - 1])
    return (h >> np.uint32(16)).astype(np.int64), first, at[first] - 1


def _pieces(texts: list[str]) -> Iterator[tuple[str, np.ndarray, list[int]]]:
    """Lower-cased texts joined to lots of about PIECE characters: text, where each document's part starts, its number."""
    lot: list[str] = []
    who: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        t = t.lower()
        while t:
            part = t
            if len(t) > PIECE:
                cut = t.find(" ", PIECE)
                part = t if cut < 0 else t[:cut]
            t = t[len(part) :]
            lot.append(part)
            who.append(i)
            size += len(part) + 1
            if size > PIECE:
                yield "\n".join(lot), np.cumsum([0] + [len(x) + 1 for x in lot[:-1]]), who
                lot, who, size = [], [], 0
    if lot:
        yield "\n".join(lot), np.cumsum([0] + [len(x) + 1 for x in lot[:-1]]), who


def word_scores(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every word in each language, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    out = [np.zeros((0, table.shape[1]), np.float32)]
    for text, starts, who in _pieces(texts):
        h, first, place = trigrams(text)
        if len(first):
            out.append(np.add.reduceat(table[h], first, axis=0))
            n = np.diff(np.append(np.searchsorted(place, starts), len(place)))
            np.add.at(counts, who, n)
    return np.concatenate(out), counts


def expectation_maximisation(p: np.ndarray, counts: np.ndarray, active: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each document's mixture of its active languages.

    p: likelihoods of the words, one document after the other, which have counts (1 at least) words each.
    """
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    share = (active / active.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        r = p * np.repeat(share, counts, axis=0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, starts, axis=0) / counts[:, None]
    s = np.log(np.maximum((p * np.repeat(share, counts, axis=0)).sum(1, dtype=np.float64), 1e-30))
    return share, np.add.reduceat(s, starts)


def infer(scores: np.ndarray, counts: np.ndarray, min_share: float, penalty: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares by document and language (0 outside the selected set), and whether known languages explain it.

    The last column of scores is the model of unknown text. Of the nested sets that take the languages
    in the order of their share in the mixture of all, the one with the best penalised likelihood is selected.
    """
    k = scores.shape[1]
    share, known = np.zeros((len(counts), k)), np.zeros(len(counts), bool)
    full = np.flatnonzero(counts)
    if not len(full):
        return share, known
    c = counts[full]
    top = scores.max(1, keepdims=True)
    p = np.exp(scores - top)
    starts = np.concatenate(([0], np.cumsum(c)[:-1]))
    alone = np.add.reduceat((scores - top).astype(np.float64), starts, axis=0)
    mixed, _ = expectation_maximisation(p, c, np.ones((len(c), k)))
    order = np.argsort(-mixed, axis=1, kind="stable")
    best = np.zeros_like(mixed)
    np.put_along_axis(best, order[:, :1], 1.0, 1)
    unclear = np.flatnonzero(np.sort(mixed, 1)[:, -1] < 1 - min_share)
    if len(unclear):
        words = np.repeat(np.isin(np.arange(len(c)), unclear), c)
        q, cu, ou = p[words], c[unclear], order[unclear]
        value = np.take_along_axis(alone[unclear], ou[:, :1], 1)[:, 0]
        for m in range(2, k + 1):
            active = np.zeros((len(unclear), k))
            np.put_along_axis(active, ou[:, :m], 1.0, 1)
            s, ll = expectation_maximisation(q, cu, active)
            v = ll - penalty * (m - 1) * np.log(cu + 1.0)
            better = (v > value) & (np.where(active > 0, s, 1).min(1) >= min_share)
            value[better] = v[better]
            best[unclear[better]] = (s * active)[better]
    share[full] = best
    known[full] = ~((best[:, -1] > 0.5) & (alone[:, -1] - alone[:, :-1].max(1, initial=-np.inf) > margin))
    return share, known


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, least_rows: int = LEAST_ROWS, lang_rows: int = LANG_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities (a column each, then one for unknown text) from labelled rows.

    Every language with least_rows labelled rows has a model. The rate of the sample is the same for all
    languages but those that would have fewer than lang_rows rows in it, which have a higher one.
    """
    # rows without a doc_id are told apart by their text
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text", "lang")).otherwise(F.xxhash64("doc_id", "lang"))
    labelled = docs.select("text", F.col("lang").cast("string").alias("lang"), F.pmod(h, F.lit(_RANGE)).alias("h")).where("lang is not null")
    # a row for each language
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    n = sum(r.n for r in sizes)
    sizes = [r for r in sizes if r.n >= min(least_rows, n)]
    # below the limit lies one row at least
    limits = [(r.lang, max(int(_RANGE * min(1, max(train_rows / max(n, 1), lang_rows / r.n))), r.least + 1)) for r in sizes]
    if n > train_rows:
        limit = docs.sparkSession.createDataFrame(limits, "lang string, most long")
        labelled = labelled.join(F.broadcast(limit), "lang").where("h < most")
    known = {lang for lang, _ in limits}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows[lang] = rows.get(lang, 0) + 1
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for text, _, _ in _pieces([t or ""]):
                    have += np.bincount(trigrams(text)[0], minlength=BUCKETS)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            # bucket -1 carries the number of rows
            b = np.append(at, -1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b, pa.int32()), pa.array(np.append(x[at], rows[lang]), pa.int64())], ["lang", "b", "n"])

    total = labelled.select("text", "lang").mapInArrow(count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toPandas()
    langs, columns = [], []
    for lang, g in sorted(total.groupby("lang")):
        if lang not in known:
            continue
        x = np.full(BUCKETS, 0.5)
        x[g.b[g.b >= 0]] += g.n[g.b >= 0]
        langs.append(lang)
        columns.append(np.maximum(np.log(x / x.sum()), FLOOR))
    columns.append(np.full(BUCKETS, UNKNOWN))
    return langs, np.stack(columns, 1).astype(np.float32)


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE, penalty: float = PENALTY, margin: float = MARGIN) -> DataFrame:
    """doc_id, languages, shares, accepted of every row.

    Each word is drawn from one of the languages of `lang` (character trigram models, see `fit`) or from
    unknown text; expectation-maximisation estimates the proportions for every document and the language
    set has the best penalised likelihood. languages are ordered by share, then by name; unknown text
    counts as 'und'. accepted is false where unknown text has more than half of the words and explains
    all of them clearly better than any language, and where there are no words: NULL, empty or wordless
    texts have no languages. If no row is labelled, no document with words is rejected.

    Repeated rows and NULL doc_ids are rows like others; further columns are ignored. One pass of
    the table without a shuffle after the fit; only the models (a fixed size for each language) are shipped.
    """
    langs, table = fit(docs, train_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array([*langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(1).to_pylist()
            found, shares, accepted = [], [], []
            for i, j in lots(texts):
                s, known = infer(*word_scores([t or "" for t in texts[i:j]], shipped.value), min_share, penalty, margin)
                for row in s:
                    at = np.argsort(-row, kind="stable")[: int((row > 0).sum())]
                    found.append(names[at].tolist())
                    shares.append(np.round(row[at], 4).tolist())
                accepted += known.tolist() if langs else (s.sum(1) > 0).tolist()
            cols = [b.column(0), pa.array(found, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "languages", "shares", "accepted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, languages array<string>, shares array<double>, accepted boolean")


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE, penalty: float = PENALTY, margin: float = MARGIN) -> DataFrame:
    """The rows that `identify` accepts, with all their columns."""
    langs, table = fit(docs, train_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(at).to_pylist()
            accepted: list[bool] = []
            for i, j in lots(texts):
                s, known = infer(*word_scores([t or "" for t in texts[i:j]], shipped.value), min_share, penalty, margin)
                accepted += known.tolist() if langs else (s.sum(1) > 0).tolist()
            yield b.filter(pa.array(accepted, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
