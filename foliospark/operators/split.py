"""Cutting long documents before headings into chunks of about a target size.

Every document is cut by itself, in the JVM and without a shuffle: it is split into pieces that begin at
headings, and a fold over them finds one cut after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, TOLERANCE = 32_768, 0.2
_BEFORE_HEADING = r"(?m)^(?=#{1,6}\s+.+$)"
_HEADING = r"(?m)\A(#{1,6})\s+(.+)$"


def chunk_bounds(target: int = TARGET, tolerance: float = TOLERANCE) -> tuple[int, int]:
    """Least and greatest size of a chunk in UTF-8 bytes."""
    return int(target * (1 - tolerance)), int(target * (1 + tolerance))


def chunks(content: Column, target: int = TARGET, tolerance: float = TOLERANCE) -> Column:
    """array<struct<index, start, end, level, heading, content>>; joining the contents gives the text back.

    A text of up to target bytes, or without headings, is one chunk of level 0. Text before the first
    heading is a chunk if it exceeds the least size, else it begins the first one. While more than the
    greatest size is left, the next cut is before the heading of the lowest level (the first of those)
    that leaves a chunk within both sizes, else before the first heading that leaves a greater one.
    Headings are lines that begin with one to six `#` and white space, in code too. start and end count
    characters; level is 0 and heading NULL for a chunk that doesn't begin with a heading. NULL stays NULL.
    """
    least, most = chunk_bounds(target, tolerance)
    zero = F.lit(0)
    pieces = F.split(content, _BEFORE_HEADING)
    cell = "array<struct<b: int, c: int, level: int>>"

    def offset(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        at = F.struct(
            (last["b"] + F.octet_length(p)).alias("b"),
            (last["c"] + F.length(p)).alias("c"),
            F.lit(0).alias("level"),
        )
        marked = F.struct(last["b"].alias("b"), last["c"].alias("c"), F.length(F.regexp_extract(p, _HEADING, 1)).alias("level"))
        return F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, zero)), F.array(marked, at))

    # where each piece begins, with the level of its heading, and the end of the text
    marks = F.aggregate(pieces, F.array(F.struct(zero.alias("b"), zero.alias("c"), zero.alias("level"))).cast(cell), offset)

    def cuts_of(marks: Column) -> Column:
        n = F.size(marks) - 1
        total = F.get(marks, n)["b"]
        at = F.transform(F.sequence(zero, n), lambda i: F.struct(F.get(marks, i)["level"].alias("level"), i.alias("i"), F.get(marks, i)["b"].alias("b")))
        heads = F.filter(at, lambda h: (h["level"] > 0) & (h["i"] > 0))

        def step(acc: Column, _: Column) -> Column:
            s = F.get(marks, F.get(acc, F.size(acc) - 1))["b"]
            fitting = F.filter(heads, lambda h: (h["b"] - s >= least) & (h["b"] - s <= most))
            beyond = F.filter(heads, lambda h: h["b"] - s > most)
            nxt = F.coalesce(F.array_min(fitting)["i"], F.get(beyond, zero)["i"])
            return F.when((total - s > most) & nxt.isNotNull(), F.array_append(acc, nxt)).otherwise(acc)

        intro = (F.get(marks, zero)["level"] == 0) & (n > 1) & (F.get(marks, F.lit(1))["b"] > least)
        first = F.when(intro, F.array(zero, F.lit(1))).otherwise(F.array(zero)).cast("array<int>")
        many = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), first, step)
        return F.when((total <= target) | (F.size(heads) + F.when(F.get(marks, zero)["level"] > 0, 1).otherwise(0) == 0), F.array(zero)).otherwise(many)

    def build(x: Column) -> Column:
        marks, pieces, cuts = x["marks"], x["pieces"], x["cuts"]
        whole = F.get(marks, F.size(marks) - 1)["b"] <= target

        def one(i: Column, k: Column) -> Column:
            j = F.coalesce(F.get(cuts, k + 1), F.size(pieces))
            text = F.array_join(F.slice(pieces, i + 1, j - i), "")
            level = F.when(whole, zero).otherwise(F.get(marks, i)["level"])
            return F.struct(
                k.alias("index"),
                F.get(marks, i)["c"].alias("start"),
                F.get(marks, j)["c"].alias("end"),
                level.alias("level"),
                F.when(level > 0, F.trim(F.regexp_extract(text, _HEADING, 2))).alias("heading"),
                text.alias("content"),
            )

        return F.transform(cuts, one)

    # a one-element transform binds a value that is used more than once
    bound = F.transform(F.array(marks), lambda m: F.struct(m.alias("marks"), pieces.alias("pieces"), cuts_of(m).alias("cuts")))
    return F.get(F.transform(bound, build), zero)


def chunk_rows(docs: DataFrame, target: int = TARGET, tolerance: float = TOLERANCE) -> DataFrame:
    """path, index, start, end, level, heading, content, bytes, is_intro of every chunk of (path, content)."""
    rows = docs.select("path", F.explode(chunks(F.col("content"), target, tolerance)).alias("c")).select("path", "c.*")
    return rows.withColumn("bytes", F.octet_length("content")).withColumn("is_intro", F.col("level") == 0)


def join_chunks(parts: Column) -> Column:
    """Texts in order, with an empty line between two of which the first doesn't end with a newline."""
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.when((acc == "") | acc.endswith("\n"), F.concat(acc, p)).otherwise(F.concat(acc, F.lit("\n\n"), p)))


def joined_chunks(rows: DataFrame, text: str = "content") -> DataFrame:
    """path, content from chunk rows (path, index, text), in the order of index."""
    got = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", F.col(text).alias("t")))).alias("parts"))
    return got.select("path", join_chunks(F.transform("parts", lambda p: p["t"])).alias("content"))
