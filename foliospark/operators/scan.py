"""Choosing documents of a tree and gathering the instructions that apply to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, full, parent

#: Names of instruction files: those that add to what directories above say, and those that replace it.
NORMAL, REPLACE = ".instructions", ".instructions.replace"
DEFAULT_INCLUDE = r"(?i).*\.md"


def included(path: Column, include: str = DEFAULT_INCLUDE) -> Column:
    """Whether the regular expression matches the whole path."""
    return path.rlike(full(include))


def excluded(path: Column, exclusions: list[str]) -> Column:
    """Whether an exclusion fully matches the path, or one of its directories with or without a final slash."""
    some = [x for x in exclusions if x.strip()]
    if not some:
        return F.lit(False)

    def hits(x: str) -> Column:
        return path.rlike(full(x)) | F.exists(ancestors(path), lambda p: p.rlike(full(x)) | F.concat(p, F.lit("/")).rlike(full(x)))

    return reduce(lambda a, b: a | b, map(hits, some))


def select_files(files: DataFrame, include: str = DEFAULT_INCLUDE, exclusions: list[str] | None = None) -> DataFrame:
    """Files whose whole path matches and that no exclusion takes; a row filter below everything else."""
    return files.where(included(F.col("path"), include) & ~excluded(F.col("path"), exclusions or []))


def instructions_of(files: DataFrame, notes: DataFrame, root: str | None = None) -> DataFrame:
    """path, instructions of every file: what the directories from the root to its own say.

    notes: (dir, kind, content), kind 'replace' or 'normal'. A replacing note drops all that is above it;
    in one directory it comes before the normal one. Texts are trimmed, blank ones skipped, the rest
    joined by an empty line; NULL where nothing is left. With a root, notes above it don't count; ''
    is the directory of paths without a slash.

    Every file meets only its own directories (an equi-join on them, no nested loop).
    """
    dirs = files.select("path").distinct().select("path", parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.first("dir").alias("d")).select("dir")
    top = F.when(F.col("dir").startswith("/"), F.array(F.lit("/"))).otherwise(F.array(F.lit("")))
    chain = F.array_distinct(F.concat(top, ancestors(F.concat(F.col("dir"), F.lit("/x")))))
    links = dirs.select("dir", F.posexplode(F.when(F.col("dir").isin("", "/"), top).otherwise(chain)).alias("depth", "above"))
    if root is not None:
        links = links.where((F.col("above") == root) | F.lit(root == "") | F.col("above").startswith(root.rstrip("/") + "/"))
    said = notes.select(F.col("dir").alias("above"), (F.col("kind") == "replace").alias("replaces"), F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")).alias("content"))
    met = links.join(said, "above")
    per = met.groupBy("dir").agg(
        F.max(F.when(F.col("replaces"), F.col("depth"))).alias("from"),
        F.sort_array(F.collect_list(F.struct("depth", (~F.col("replaces")).alias("later"), "content"))).alias("all"),
    )
    kept = F.expr("filter(all, x -> (from is null or x.depth >= from) and x.content <> '')")
    per = per.select("dir", F.nullif(F.array_join(F.transform(kept, lambda x: x["content"]), "\n\n"), F.lit("")).alias("instructions"))
    return files.withColumn("dir", parent(F.col("path"))).join(per, "dir", "left").select("path", "instructions")
