"""Rows of console reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.texts import elapsed, progress_bar

#: Ranges that a report is numbered in, a power of two.
RANGES = 256


def progress(results: DataFrame, order: list[str]) -> DataFrame:
    """completed, total and the bar after each result, in the given order, for results of one run.

    The list is numbered in ranges of the order, each by itself, behind the sum of those before it; only
    the ranges' counts meet in one place. Rows that are equal in the order share a range.
    """
    ranged = results.crossJoin(F.broadcast(_edges(results, order))).withColumn("range", _range_of(F.struct(*order), F.col("edges"))).drop("edges")
    counts = ranged.groupBy(F.col("range").alias("at")).agg(F.count("*").alias("n"))
    # at most RANGES rows
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = ranged.join(F.broadcast(counts), F.col("range") == F.col("at"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    rows = rows.withColumn("completed", (F.col("before") + within).cast("int")).withColumn("total", F.col("total").cast("int"))
    return rows.select(*results.columns, "completed", "total").withColumn("bar", progress_bar(F.col("completed"), F.col("total")))


def _edges(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: the ordered edges between ranges, RANGES - 1 at most, from the values with the least hashes.

    Where the edges lie decides how even the ranges are, not the numbers.
    """
    at = rows.select(F.struct(*order).alias("o")).withColumn("h", F.xxhash64("o"))
    some = at.orderBy("h", "o").limit(16 * RANGES).agg(F.sort_array(F.collect_set("o")).alias("all"))
    step = F.greatest(F.ceil(F.size("all") / RANGES).cast("int"), F.lit(1))
    return some.select(F.filter("all", lambda _, i: (i > 0) & (i % step == 0)).alias("edges"))


def _range_of(value: Column, edges: Column) -> Column:
    """How many of the ordered edges are at most the value: a search by halves."""
    steps = F.array(*[F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())])

    def search(x: Column) -> Column:
        fits = lambda n: (n <= F.size(x["edges"])) & (F.get(x["edges"], n - 1) <= x["value"])
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))

    return let(F.struct(value.alias("value"), edges.alias("edges")), search)


def result_lines(results: DataFrame) -> DataFrame:
    """path, line: a line for each result of a translation run."""
    state = F.when(F.col("success"), "OK").otherwise("ERROR")
    line = F.concat(F.lit("["), state, F.lit("] "), F.col("type"), F.lit(" "), F.col("path"), F.lit(" "), elapsed(F.col("elapsed_millis")), F.coalesce(F.concat(F.lit(" "), F.col("error")), F.lit("")))
    return results.select("path", line.alias("line"))


def error_lines(errors: DataFrame) -> DataFrame:
    """path, line: a line for each link or Git error (path, type and, for links, destination)."""
    place = F.concat(F.lit(" "), F.col("destination")) if "destination" in errors.columns else F.lit("")
    return errors.select("path", F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("path"), place).alias("line"))
