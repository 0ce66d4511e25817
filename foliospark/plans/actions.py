"""The four actions: show the configuration, check, translate and repair links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.integrity import check_totals, git_errors, link_errors
from ..operators.mirror import check_corrected, correct_links
from ..operators.scan import DEFAULT_INCLUDE, instructions_of
from ..operators.translate import Translator, UpperCase, assemble, summary, translate
from ..sources import files as S
from ..sources import git


@dataclass
class Config:
    """What an action works on. targets: (locale, directory) pairs."""

    source_dir: str
    targets: list[tuple[str, str]] = field(default_factory=list)
    include: str = DEFAULT_INCLUDE
    exclusions: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    limit: int = 2_147_483_647
    dry_run: bool = False
    parallelism: int = 4
    provider: str = ""
    url: str = ""
    model: str = ""
    token: str | None = None


def show_config(c: Config) -> list[tuple[str, str]]:
    """Names and values of the configuration, the token masked."""
    secret = c.token or ""
    shown = {**c.__dict__, "token": "****" + (secret[-4:] if len(secret) > 4 else "")}
    return [(k, ", ".join(map(str, v)) if isinstance(v, list) else str(v)) for k, v in shown.items()]


def problems(c: Config, need_targets: bool = True) -> list[str]:
    """What is wrong with a configuration."""
    import os

    found = [] if os.path.isdir(c.source_dir) else [f"no source directory {c.source_dir}"]
    if need_targets and not c.targets:
        found.append("no targets")
    if c.limit < 1:
        found.append("the limit is less than 1")
    if c.parallelism < 1:
        found.append("the parallelism is less than 1")
    return found


def check(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Git errors, link errors and the row of totals of a source tree."""
    _require(c, False)
    root = git.find_root(c.source_dir)
    docs = S.read_tree(spark, c.source_dir, c.include, c.exclusions)
    everything = S.list_tree(spark, root)
    g = git_errors(docs, git.read_state(spark, root), git.read_versions(spark, root))
    links = link_errors(docs, everything, root)
    return g, links, check_totals(docs, g, links)


def jobs(spark: SparkSession, c: Config) -> DataFrame:
    """Jobs for all targets, with skipped files, before the limit."""
    _require(c)
    root = git.find_root(c.source_dir)
    source = S.checked_root(c.source_dir)
    docs = S.read_tree(spark, source, c.include, c.exclusions)
    told = docs.join(instructions_of(docs, S.read_notes(spark, root), root), "path", "left")
    targets = spark.createDataFrame([(tag, _absolute(d)) for tag, d in c.targets], "locale string, target_root string")
    made = _trees(spark, c)
    return H.classify(told, git.read_versions(spark, root), made, targets, source, git.read_state(spark, root))


def translate_all(spark: SparkSession, c: Config, model: Translator | None = None, persist: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Counters of a dry run, or the summary of translating, writing and repairing all targets' documents.

    persist(table, name) has to store a table and give it back (checkpoint by default), so that no
    document is translated twice.
    """
    keep = persist or (lambda df, _: df.checkpoint())
    if persist is None:
        _checkpoints(spark)
    all_jobs = jobs(spark, c)
    if c.dry_run:
        return H.job_counts(all_jobs)
    all_jobs = keep(all_jobs, "jobs")
    todo = H.limit_jobs(all_jobs, c.limit)
    done = keep(translate(todo, model or UpperCase(), c.fields, c.parallelism), "results")
    S.write_documents(keep(assemble(done, todo), "documents"))
    fix_links(spark, c, only=done.where("success").select(F.col("target_path").alias("path")), persist=keep)
    return summary(done, all_jobs.where(F.col("type") == H.SKIP))


def fix_links(spark: SparkSession, c: Config, only: DataFrame | None = None, persist: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Repair the links of all target trees in place; the corrections by file and the link errors that remain.

    Everything is read and stored before the first file is written. Only files with corrections and
    without errors are written.
    """
    _require(c)
    keep = persist or (lambda df, _: df.checkpoint())
    if persist is None:
        _checkpoints(spark)
    source, root = S.checked_root(c.source_dir), git.find_root(c.source_dir)
    sources = S.read_tree(spark, source, c.include, c.exclusions)
    files = S.list_tree(spark, root)
    found = None
    for _, directory in c.targets:
        target = _absolute(directory)
        try:
            mirror = S.read_tree(spark, target, c.include)
        except FileNotFoundError:
            continue
        got = correct_links(mirror, sources, files, source, target, c.include, c.exclusions, c.fields, already_corrected=True)
        found = got if found is None else found.unionByName(got)
    if found is None:
        raise FileNotFoundError("none of the target directories is there")
    if only is not None:
        found = found.join(only, "path", "left_semi")
    found = keep(found, "corrected")
    S.write_documents(found.where("writable"))
    return found, check_corrected(found, files, root)


def _absolute(directory: str) -> str:
    import os

    return os.path.realpath(directory)


def _checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/foliospark-actions")


def _trees(spark: SparkSession, c: Config) -> DataFrame:
    out = spark.createDataFrame([], "path string, content string")
    for _, directory in c.targets:
        try:
            out = out.unionByName(S.read_tree(spark, _absolute(directory), c.include))
        except FileNotFoundError:
            continue
    return out


def _require(c: Config, need_targets: bool = True) -> None:
    if found := problems(c, need_targets):
        raise ValueError("; ".join(found))
