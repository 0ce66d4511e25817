"""Line deduplication with a fixed-depth log-template tree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .text import checkpoint_ready, free_name, row_key, written

#: Depth of the tree below the token count, least tokens and fixed tokens of a template, documents from
#: which on a template recurs, and the share of equal tokens that joins a line to a template.
DEPTH, MIN_TOKENS, MIN_FIXED, MIN_DOCS, SIMILARITY = 4, 3, 3, 3, 0.75
#: Most lines and tokens of a lot, where all lines with a run are compared.
LOT, LOT_TOKENS = 512, 100_000
#: Documents from which on the same line without digits recurs.
EXACT_DOCS = 2
WILD = "<*>"


def _tokens(line: str) -> str:
    return f"array_remove(split(translate({line}, '\\t\\r', '  '), ' '), '')"


def line_hash(masked: str) -> str:
    """60 bits of a line's MD5 sum, which SQL can tell as well."""
    return f"cast(conv(substring(md5({masked}), 1, 15), 16, 10) as bigint)"


def _links(similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b from sorted blocks (run, x, y, lot, part, h): links between similar lines, as many as join their parts."""

    def block(lot: np.ndarray, part: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
        names, label = np.unique(part, return_inverse=True)
        need = similarity * h.shape[1] - 1e-9
        later = np.arange(len(lot))
        for i in range(len(lot)):
            # a block of two lots compares one with the other, as each has a block of its own
            js = later[(label != label[i]) & ((lot > lot[i]) if lot[0] != lot[-1] else (later > i))]
            if not len(js):
                continue
            for other in np.unique(label[js[(h[js] == h[i]).sum(axis=1) >= need]]).tolist():
                yield int(names[label[i]]), int(names[other])
                label[label == other] = label[i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows[c].to_numpy() for c in ("run", "x", "y")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            lot, part, h = rows["lot"].to_numpy(), rows["part"].to_numpy(), rows["h"].combine_chunks()
            found = []
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), rows.num_rows], strict=True):
                order = np.argsort(lot[i:j], kind="stable")
                found += block(lot[i:j][order], part[i:j][order], h.slice(i, j - i).flatten().to_numpy().reshape(j - i, -1)[order])
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                last = [t[c][-1].as_py() for c in ("run", "x", "y")]
                same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("run", "x", "y"), last, strict=True)])
                cut = int(np.argmax(same))
                held = t.slice(cut)
                if cut:
                    yield links(t.slice(0, cut))
        if held is not None:
            yield links(held)

    return run


def classes(kinds: DataFrame, depth: int, similarity: float) -> DataFrame:
    """mh, base of distinct lines (mh, h): the least line of each line's class, itself if it is alone.

    Lines of a leaf that have similarity * n tokens in common are linked, and a class is whatever links
    connect. Two lines of n tokens of which at most m = n - similarity * n differ agree in one of m + 1
    runs of the tokens below the leading ones. All lines with a run are compared with the least of them;
    where these links leave lines of a run in several parts, all pairs from different parts are
    compared, in blocks of two lots of a bounded size. So no link between parts is lost, whatever the
    number of lines with a run; runs that the same lines have are taken once.
    """
    sized = kinds.select("mh", "h", F.size("h").alias("n"), F.expr(f"size(h) - cast(ceil({similarity} * size(h) - 1e-9) as int) + 1").alias("k"))
    bound = lambda j: f"cast(floor({j} * greatest(n - {depth}, 0) / k) as int)"
    run = f"xxhash64(n, slice(h, 1, {depth}), j, slice(h, {depth} + 1 + {bound('j')}, {bound('(j + 1)')} - {bound('j')}))"
    runs = sized.select("mh", F.explode(F.expr(f"transform(sequence(0, k - 1), j -> {run})")).alias("run")).repartition("run")
    least = runs.groupBy("run").agg(F.min("mh").alias("lead"), F.max("mh").alias("most"), F.count("*").alias("lines")).where("lead <> most").drop("most")
    asked = runs.join(least.hint("shuffle_hash"), "run").where("lead <> mh").checkpoint()
    both = asked.select("mh", "lead").distinct().join(kinds.hint("shuffle_hash"), "mh").join(kinds.select(F.col("mh").alias("lead"), F.col("h").alias("u")).hint("shuffle_hash"), "lead")
    alike = f"size(h) = size(u) and slice(h, 1, {depth}) = slice(u, 1, {depth}) and size(filter(zip_with(h, u, (x, y) -> x = y), e -> e)) >= {similarity} * size(h) - 1e-9"
    linked = both.where(alike).select("mh", "lead").checkpoint()
    # a line's part is the least lead of its least lead; links between parts join them at the end
    first = linked.unionByName(linked.select(F.col("lead").alias("mh"), "lead")).groupBy("mh").agg(F.least(F.min("mh"), F.min("lead")).alias("lead"))
    near = first.join(first.select(F.col("mh").alias("lead"), F.col("lead").alias("part")), "lead").select("mh", "part").checkpoint()
    apart = linked.join(near, "mh").join(near.select(F.col("mh").alias("lead"), F.col("part").alias("b")), "lead").where("part <> b").select(F.col("part").alias("a"), "b")
    # a run of two lines is settled by then
    more = asked.where("lines > 2")
    more = more.select("run", "mh").unionByName(more.select("run", F.col("lead").alias("mh")).distinct())
    more = more.join(near, "mh", "left").select("run", "mh", F.coalesce("part", "mh").alias("part")).checkpoint()
    mixed = more.groupBy("run").agg(F.count("*").alias("lines"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.bit_xor(F.xxhash64("mh")).alias("who")).where("lo <> hi")
    mixed = mixed.groupBy("who", "lines").agg(F.min("run").alias("run")).select("run", "lines")
    rows = more.join(mixed, "run").join(kinds.hint("shuffle_hash"), "mh")
    rows = rows.withColumn("lots", F.expr(f"cast(ceil(lines / greatest(1, least({LOT}, {LOT_TOKENS} div size(h)))) as int)")).withColumn("lot", F.expr("cast(pmod(xxhash64(mh), lots) as int)"))
    rows = rows.select("run", "lot", "part", "h", F.explode(F.expr("sequence(0, lots - 1)")).alias("o")).select("run", F.least("lot", "o").alias("x"), F.greatest("lot", "o").alias("y"), "lot", "part", "h")
    links = rows.repartition("run", "x", "y").sortWithinPartitions("run", "x", "y").mapInArrow(_links(similarity), "a bigint, b bigint")
    joined = connected_components(apart.unionByName(links)).select(F.col("node").alias("part"), F.col("component").alias("base"))
    found = kinds.select("mh").join(near, "mh", "left").select("mh", F.coalesce("part", "mh").alias("part"))
    return found.join(joined, "part", "left").select("mh", F.coalesce("base", "part").alias("base"))


def templates(kinds: DataFrame, depth: int, similarity: float, min_fixed: int) -> DataFrame:
    """mh, th, base, wild of distinct lines (mh, h): a line's hash, its template's, and the line and wild places that make it.

    h are the hashes of a line's tokens. The lines of a class (see `classes`) make a template, in which
    the tokens that they don't share are wild. Templates have min_fixed tokens that are neither wild nor
    masked; the lines of a class that keeps fewer are their own templates, as are lines without a class.
    """
    wild = f"xxhash64('{WILD}')"
    classed = classes(kinds, depth, similarity).checkpoint()
    heads = kinds.select(F.col("mh").alias("base"), F.col("h").alias("u"))
    both = classed.where("mh <> base").join(kinds.hint("shuffle_hash"), "mh").join(heads.hint("shuffle_hash"), "base")
    differ = "filter(transform(zip_with(h, u, (x, y) -> x = y), (e, i) -> if(e, -1, i)), i -> i >= 0)"
    places = both.select("base", F.explode(F.expr(differ)).alias("i")).groupBy("base").agg(F.collect_set("i").alias("wild"))
    made = places.join(heads.hint("shuffle_hash"), "base").where(f"size(filter(u, (x, i) -> x <> {wild} and not array_contains(wild, i))) >= {min_fixed}")
    found = classed.join(made.select("base", F.array_sort("wild").alias("wild")), "base", "left")
    found = found.select("mh", F.expr("if(wild is null, mh, base)").alias("base"), F.coalesce("wild", F.array().cast("array<int>")).alias("wild"))
    found = found.join(kinds.select(F.col("mh").alias("base"), "h").hint("shuffle_hash"), "base").withColumn("h", F.expr(f"transform(h, (x, i) -> if(array_contains(wild, i), {wild}, x))"))
    return found.where(f"size(filter(h, x -> x <> {wild})) >= {min_fixed}").select("mh", F.xxhash64("h").alias("th"), "base", "wild")


def recurring_lines(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_fixed: int = MIN_FIXED, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
    exact_docs: int | None = None,
) -> DataFrame:
    """doc_id, rk, line_no, template, n_docs, first_doc: every line whose template recurs in min_docs documents.

    A line's tokens (between white space) that hold a digit are wild. The tree's first level is the
    number of tokens, the next `depth` levels are the leading tokens; inside a leaf, lines that similarity
    links, directly or through others, are generalised to one template (see `classes` and `templates`). Lines with fewer than min_tokens tokens and templates
    with fewer than min_fixed fixed tokens never count. first_doc marks the lines of the document with
    the lowest doc_id (then key) that has the template.

    With exact_docs, a line of one token or more without digits whose template doesn't recur is its own
    template (its tokens, one blank apart), and recurs from exact_docs documents on.

    NULL and empty texts have no lines that count; a repeated row (same doc_id and text) is the same
    document; NULL doc_ids come first in the order. Other columns are ignored.
    """
    checkpoint_ready(docs.sparkSession)
    lead = f"transform(slice(t, 1, {depth}), x -> if(x rlike '[0-9]', '{WILD}', x))"
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("rk"), "text").where("text is not null")
    # one pass over the texts gives a few numbers for each line
    lines = written(
        base.select("rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("t", F.expr(_tokens("line")))
        .where(f"size(t) >= {min_tokens}" + " or size(t) >= 1 and not line rlike '[0-9]'" * (exact_docs is not None))
        .select("rk", "line_no", F.expr(f"xxhash64(size(t), {lead})").alias("leaf"))
    )
    # a leaf of one document holds nothing that recurs
    hot = lines.groupBy("leaf").agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a <> b").select("leaf")
    found = lines.join(hot.hint("shuffle_hash"), "leaf", "left_semi").groupBy("rk").agg(F.collect_set(F.struct("line_no", "leaf")).alias("found"))
    # the other lines are taken up again only where they may count, by a join that shuffles texts once
    split = "split(text, '\\n')"
    masked = f"array_join(transform({_tokens('line')}, x -> if(x rlike '[0-9]', '{WILD}', x)), ' ')"
    seen = written(
        base.join(found.hint("shuffle_hash"), "rk")
        # the lambda's variable binds the lines, so that a text is split once
        .select("doc_id", "rk", F.explode(F.expr(f"get(transform(array({split}), ls -> transform(found, f -> struct(f.line_no, f.leaf, get(ls, f.line_no) as line))), 0)")).alias("f"))
        .select("doc_id", "rk", "f.line_no", "f.leaf", "f.line")
        .select("doc_id", "rk", "line_no", F.expr(masked).alias("masked"), F.expr("not line rlike '[0-9]'").alias("exact"))
        .withColumn("mh", F.expr(line_hash("masked")))
    )
    texts = written(seen.groupBy("mh").agg(F.first("masked").alias("masked")))
    kinds = texts.select("mh", F.transform(F.split("masked", " "), lambda x: F.xxhash64(x)).alias("h")).where(f"size(h) >= {min_tokens}").checkpoint()
    # rows carry hashes of lines and templates; a template's text joins them last
    grown = templates(kinds, depth, similarity, min_fixed).checkpoint()
    placed = seen.select("doc_id", "rk", "line_no", "mh", "exact").join(grown.select("mh", "th").hint("shuffle_hash"), "mh", "left").distinct().checkpoint()
    out = ["doc_id", "rk", "line_no", "template", "n_docs", (F.col("rk") == F.col("first.rk")).alias("first_doc")]

    def counted(rows: DataFrame, kind: str, least: int) -> DataFrame:
        # count distinct documents, with partial sums before each shuffle
        per = rows.groupBy(kind, "rk").agg(F.min("doc_id").alias("doc_id"))
        return per.groupBy(kind).agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "rk")).alias("first")).where(f"n_docs >= {least}")

    stats = counted(placed.where("th is not null"), "th", min_docs).checkpoint()
    named = stats.join(grown.groupBy("th").agg(F.min(F.struct("base", "wild")).alias("m")), "th").join(texts.withColumnRenamed("mh", "base"), F.expr("m.base = base"))
    named = named.select("th", "n_docs", "first", F.array_join(F.expr(f"transform(split(masked, ' '), (x, i) -> if(array_contains(m.wild, i), '{WILD}', x))"), " ").alias("template"))
    found = placed.join(named.hint("shuffle_hash"), "th").select(*out)
    if exact_docs is None:
        return found
    # equal lines have one template, so either all of them recur by it or all are counted here
    same = placed.where("exact").join(stats.select("th"), "th", "left_anti")
    alike = counted(same, "mh", exact_docs).join(texts.withColumnRenamed("masked", "template"), "mh")
    return found.unionByName(same.join(alike.hint("shuffle_hash"), "mh").select(*out))


def dedup_lines(docs: DataFrame, exact_docs: int | None = EXACT_DOCS, **kw) -> DataFrame:
    """The documents without the lines of recurring templates and equal lines (see `recurring_lines`), with all their columns.

    The first document that has a template keeps its lines, so the content survives once. A changed
    document has its n_chars, if there is such a column, set to its new length; one that loses all its
    lines goes. Documents that lose nothing, NULL and empty texts among them, stay as they are.
    """
    key, gone = free_name(docs, "row"), free_name(docs, "drop")
    drops = recurring_lines(docs, exact_docs=exact_docs, **kw).where("not first_doc").groupBy("rk").agg(F.collect_set("line_no").alias(gone)).withColumnRenamed("rk", key)
    # the rows to change grow with the table: the same shuffled join at every size, without sorting texts
    both = docs.withColumn(key, row_key()).join(drops.hint("shuffle_hash"), key, "left")
    # the difference of two arrays is taken by a hash set, so that a long document takes linear time
    left = f"array_join(get(transform(array(split(text, '\\n')), ls -> transform(array_except(sequence(0, size(ls) - 1), {gone}), i -> get(ls, i))), 0), '\\n')"
    both = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(left)))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return both.where(f"{gone} is null or trim(text) <> ''").select(*[F.col(f"`{c}`") for c in docs.columns])
