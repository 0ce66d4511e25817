"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import checkpoint_ready
from .tokens import count_column

#: Tokens of a block, and the power of a source's tokens that is its weight where none is given.
BLOCK_TOKENS, TEMPERATURE = 2_000, 0.7
#: The golden-ratio point of slot t is t * GOLDEN modulo 2**62, over 2**62.
BITS = 62
GOLDEN = (math.isqrt(5 << 2 * BITS) - (1 << BITS)) // 2 | 1
#: Where no vocabulary is given, a run of letters and digits is a token, and so is any other character but white space.
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\v\p{L}\p{N}]"
#: Ranges of points by which a slot finds its source.
CELLS = 1 << 12


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**62, of 31 bits at a time, so that nothing overflows for slots below 2**62."""
    half, mask = BITS // 2, (1 << BITS // 2) - 1
    low, high = slot.bitwiseAND(F.lit(mask)), F.shiftright(slot, half)
    cross = (low * F.lit(GOLDEN >> half) + high * F.lit(GOLDEN & mask)).bitwiseAND(F.lit(mask))
    return (low * F.lit(GOLDEN & mask) + F.shiftleft(cross, half)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    temperature: float = TEMPERATURE,
    seed: str = "mix",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """The training order: slot, source, epoch, block, doc_id, token_from, token_to (exclusive, in the document).

    Each source's documents are put in the order of md5(seed, doc_id), laid end to end and cut every
    block_tokens tokens into blocks; only a source's last block is shorter. Tokens are those of the
    vocabulary at tokenizer_path, counted as `token_counts` does, else pieces of text (see TOKEN). Slot t
    takes the golden-ratio point frac(t * phi); the cumulative weights map it to a source; the slot's
    rank among its source's slots picks the block, starting again (next epoch) after the last. There are
    as many slots as it takes for every block of every source to come up, so that nothing is dropped.

    Weights: as given by source (sources that aren't named, or have 0 or less, get no slot), else tokens
    to the power of temperature; they count in millionths. Rows with NULL source form the source
    '(none)'. NULL and empty texts have no tokens and so no slot. Repeated rows each have their own
    place (ties of the order are cut by the tokens, and equal rows are interchangeable). Further columns
    are ignored. An empty table gives no rows.

    The table of sources (a row each) is the only thing that is broadcast.
    """
    spark = checkpoint_ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = count_column(rows, "text", "n", tokenizer_path) if tokenizer_path else rows.select("source", "doc_id", F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("n"))
    rows = rows.where("n > 0")
    rows = rows.withColumn("ord", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    rows = rows.checkpoint()  # a few numbers a document; the text is read once
    # running tokens in two steps: over order prefixes of a source, then inside one prefix, so that no
    # task holds a whole source
    rows = rows.withColumn("part", F.substring("ord", 1, 3))
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("ord", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.join(parts, ["source", "part"])
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .select("source", "doc_id", "n", "start", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + n - 1) div {block_tokens})")).alias("block"))
        .select(
            "source",
            "block",
            "doc_id",
            F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("start")).alias("token_from"),
            F.least(F.col("n"), (F.col("block") + 1) * block_tokens - F.col("start")).alias("token_to"),
        )
    )
    # one row per source from here on
    sources = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        sources = sources.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        sources = sources.join(given, "source").where("w > 0")
    everything = Window.partitionBy()
    ordered = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    sources = (
        sources.withColumn("w", F.greatest(F.lit(1), F.floor(F.col("w") * 1e6 / F.sum(F.round("w", 3)).over(everything))).cast("bigint"))
        .withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("bigint"))
        .withColumn("upto", F.sum("w").over(ordered))
        .withColumn("total", F.sum("w").over(everything))
        .withColumn("since", F.col("upto") - F.col("w"))
        .checkpoint()
    )
    # the slots that a source gets among the first t differ from t * w / total by less than one for each
    # point of the golden-ratio sequence's discrepancy; the schedule is cut to what is needed below
    slots = sources.agg(F.max(F.ceil((F.col("blocks") + 64).cast("decimal(20,0)") * F.col("total") / F.col("w")).cast("bigint"))).first()[0] or 0
    # the points of a source are those from `low` to below `high`; a slot asks the few sources of its cell
    width = (1 << BITS) // CELLS
    sources = sources.select("source", "blocks", F.expr(f"cast(since as decimal(18,0)) * {1 << BITS} div total").cast("bigint").alias("low"), F.expr(f"cast(upto as decimal(18,0)) * {1 << BITS} div total").cast("bigint").alias("high")).where("low < high")
    cells = sources.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    taken = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    taken = taken.withColumn("cell", F.expr(f"point div {width}")).join(F.broadcast(cells), "cell").where("point >= low and point < high").select("slot", "source", "blocks")
    # rank within a source, again in two steps
    taken = taken.withColumn("part", F.expr(f"slot div {1 << 16}"))
    counts = taken.groupBy("source", "part").agg(F.count("*").alias("k"))
    counts = counts.select("source", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    near = Window.partitionBy("source", "part").orderBy("slot")
    taken = taken.join(counts, ["source", "part"]).withColumn("rank", F.col("base") + F.row_number().over(near) - 1)
    last = taken.where("rank = blocks - 1").agg(F.max("slot").alias("last"))
    return (
        taken.join(F.broadcast(last), F.col("slot") <= F.col("last"))
        .select("slot", "source", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))
        .join(placed, ["source", "block"])
        .select("slot", "source", "epoch", "block", "doc_id", "token_from", "token_to")
    )
