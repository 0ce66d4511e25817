"""Versions of documents and what has to be translated.

versions: (path, seq, hash, content), one row for each commit that touched a file, seq growing along
the history. Everything here is an aggregate or an equi-join on the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frontmatter import get_property, parse_properties
from ..functions.paths import mirror

NEW, UPDATE, SKIP = "NEW", "UPDATE", "SKIP"


def latest_versions(versions: DataFrame) -> DataFrame:
    """path, seq, hash of the last commit of every file."""
    return versions.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def commits_between(versions: DataFrame, spans: DataFrame) -> DataFrame:
    """path, n: commits of each file after from_seq up to to_seq (of spans); 0 for none."""
    met = spans.join(versions.select("path", "seq"), "path", "left")
    return met.groupBy("path").agg(F.count_if((F.col("seq") > F.col("from_seq")) & (F.col("seq") <= F.col("to_seq"))).alias("n"))


def content_as_of(versions: DataFrame, points: DataFrame) -> DataFrame:
    """path, content of each file as it was at at_seq (of points); NULL before its first version and where it is empty."""
    met = points.join(versions.select("path", "seq", "content"), "path", "left")
    return met.groupBy("path", "at_seq").agg(F.expr("nullif(max_by(content, seq) filter (where seq <= at_seq), '')").alias("content")).select("path", "at_seq", "content")


def translated_commits(translations: DataFrame) -> DataFrame:
    """path, existing, translated_commit of existing translations (path, content): their `commit` property."""
    return translations.select("path", F.col("content").alias("existing"), get_property(parse_properties(F.col("content")), "commit").alias("translated_commit"))


def classify(sources: DataFrame, versions: DataFrame, translations: DataFrame, targets: DataFrame, source_root: str, dirty: DataFrame | None = None) -> DataFrame:
    """Jobs for every source and target: locale, path, target_path, type, skip_reason, warning and what a job needs.

    sources: (path, content, instructions); targets: (locale, target_root), a handful; translations:
    (path, content) of all targets; dirty: (path) with changes that aren't committed.

    SKIP for `uncommitted`, `untracked` and `up_to_date` files; NEW without a usable translation (with a
    warning where there is one without a commit, or whose commit is unknown); else UPDATE with the
    original source, the number of commits in between, and the translation. The history is
    joined twice on the path, at the translated commit and as a whole.
    """
    jobs = sources.crossJoin(targets)
    jobs = jobs.withColumn("target_path", mirror(F.col("path"), source_root, F.col("target_root")))
    existing = translated_commits(translations).withColumnRenamed("path", "target_path")
    jobs = jobs.join(existing, "target_path", "left")
    head = latest_versions(versions).select("path", F.col("seq").alias("head_seq"), F.col("hash").alias("current_commit"))
    jobs = jobs.join(head, "path", "left")
    marked = dirty.select("path").distinct().withColumn("dirty", F.lit(True)) if dirty is not None else None
    jobs = jobs.join(marked, "path", "left") if marked is not None else jobs.withColumn("dirty", F.lit(None).cast("boolean"))
    # the commit may be any of the repository's: the file's content then is its last version up to there
    commits = versions.groupBy(F.col("hash").alias("translated_commit")).agg(F.max("seq").alias("at_seq"))
    jobs = jobs.join(commits, "translated_commit", "left")
    asked = jobs.where("at_seq is not null and head_seq is not null").select("path", "at_seq").distinct()
    spans = asked.join(versions.select("path", "seq", "content"), "path")
    past = spans.groupBy("path", "at_seq").agg(
        F.expr("nullif(max_by(content, seq) filter (where seq <= at_seq), '')").alias("original_source"), F.count_if(F.col("seq") > F.col("at_seq")).alias("commit_count")
    )
    jobs = jobs.join(past, ["path", "at_seq"], "left")
    reason = (
        F.when(F.coalesce("dirty", F.lit(False)), "uncommitted")
        .when(F.col("current_commit").isNull(), "untracked")
        .when(F.col("translated_commit") == F.col("current_commit"), "up_to_date")
    )
    fresh = F.col("existing").isNull() | F.col("translated_commit").isNull() | F.col("original_source").isNull()
    warning = F.when(F.col("existing").isNotNull() & F.col("translated_commit").isNull(), "no commit field").when(F.col("existing").isNotNull() & F.col("original_source").isNull(), "original unavailable")
    jobs = jobs.withColumn("skip_reason", reason)
    kind = F.when(F.col("skip_reason").isNotNull(), SKIP).when(fresh, NEW).otherwise(UPDATE)
    jobs = jobs.withColumn("type", kind).withColumn("warning", F.when(F.col("type") == NEW, warning))
    only = lambda c: F.when(F.col("type") == UPDATE, F.col(c)).alias(c)
    return jobs.select("locale", "path", "target_path", "type", "skip_reason", "warning", F.col("content").alias("source"), "instructions", "current_commit", *[only(c) for c in ("translated_commit", "existing", "original_source", "commit_count")])


def limit_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """The first jobs of each locale in the order of paths; skipped files don't count against the limit."""
    first = Window.partitionBy("locale").orderBy("path")
    return jobs.where(F.col("type") != SKIP).withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).drop("n")


def job_counts(jobs: DataFrame) -> DataFrame:
    """locale, new, updated, skipped, errors: the counters of a dry run; uncommitted and untracked files are errors."""
    bad = F.col("skip_reason").isin("uncommitted", "untracked")
    return jobs.groupBy("locale").agg(
        F.count_if(F.col("type") == NEW).alias("new"),
        F.count_if(F.col("type") == UPDATE).alias("updated"),
        F.count_if((F.col("type") == SKIP) & ~bad).alias("skipped"),
        F.count_if((F.col("type") == SKIP) & bad).alias("errors"),
    )
