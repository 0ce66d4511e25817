"""Whether links and anchors of a corpus lead somewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import markdown as M
from ..functions.paths import ancestors, normalize, resolve_link

FILE_NOT_FOUND, ANCHOR_NOT_FOUND = "FILE_NOT_FOUND", "ANCHOR_NOT_FOUND"
UNCOMMITTED, UNTRACKED = "UNCOMMITTED_CHANGES", "UNTRACKED"


def heading_rows(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, pos (from 0), level, text, slug of every heading."""
    return docs.select(path, F.posexplode(M.headings(F.col(content))).alias("pos", "h")).select(path, "pos", "h.level", "h.text", "h.slug")


def anchor_rows(docs: DataFrame) -> DataFrame:
    """path, slug: the distinct anchors of every document."""
    return docs.select("path", F.explode(M.anchor_set(F.col("content"))).alias("slug"))


def link_rows(docs: DataFrame, block_aware: bool = True) -> DataFrame:
    """path, pos (from 0), destination, link_path, anchor, is_external, is_absolute of every link and image."""
    found = docs.select("path", F.posexplode(L.destinations(F.col("content"), block_aware)).alias("pos", "d"))
    return found.select("path", "pos", L.parse_link(F.col("d")).alias("x")).select("path", "pos", "x.destination", F.col("x.path").alias("link_path"), "x.anchor", "x.is_external", "x.is_absolute")


def resolved_links(links: DataFrame, root: Column | str = "") -> DataFrame:
    """Internal links with the path they lead to (their own document's for a mere anchor) and the decoded anchor."""
    target = F.when(F.col("link_path").isNull(), normalize(F.col("path"))).otherwise(resolve_link(F.col("path"), L.url_decode(F.col("link_path")), root))
    return links.where("not is_external and destination <> ''").withColumn("target", target).withColumn("wanted", L.normalize_anchor(F.col("anchor")))


def known_paths(files: DataFrame) -> DataFrame:
    """All files and the directories above them, once each."""
    return files.select(F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("target")).distinct()


def link_errors(docs: DataFrame, files: DataFrame | None = None, root: Column | str = "", links: DataFrame | None = None, anchors: bool = True) -> DataFrame:
    """path, pos, destination, target, anchor, type: links to missing files, and to missing anchors in files that exist.

    docs: (path, content); files: the paths that exist beside them (the documents only, by default). Without
    anchors, only missing files are looked for.
    The links meet the paths and the anchors in one left join each; an existing target that isn't one of
    the documents has no anchors.
    """
    found = resolved_links(links if links is not None else link_rows(docs), root)
    paths = known_paths(docs.select("path") if files is None else docs.select("path").unionByName(files.select("path")))
    met = found.join(paths.withColumn("there", F.lit(True)), "target", "left")
    gone = F.col("there").isNull() & F.col("link_path").isNotNull()
    if anchors:
        known = anchor_rows(docs).select(F.col("path").alias("target"), F.lower("slug").alias("wanted")).distinct()
        met = met.join(known.withColumn("named", F.lit(True)), ["target", "wanted"], "left")
        lost = F.col("there").isNotNull() & F.col("wanted").isNotNull() & F.col("named").isNull()
    else:
        lost = F.lit(False)
    met = met.where(gone | lost).withColumn("type", F.when(gone, FILE_NOT_FOUND).otherwise(ANCHOR_NOT_FOUND))
    return met.select("path", "pos", "destination", "target", "anchor", "type")


def git_errors(files: DataFrame, state: DataFrame, versions: DataFrame) -> DataFrame:
    """path, type: files with changes that aren't committed, and files that were never committed.

    state: (path) of files that differ from the last commit; versions: (path, ...) of the history.
    """
    known = versions.select("path").distinct().withColumn("known", F.lit(True))
    dirty = state.select("path").distinct().withColumn("dirty", F.lit(True))
    both = files.select("path").join(known, "path", "left").join(dirty, "path", "left")
    return both.where("known is null or dirty").select("path", F.when(F.col("known").isNull(), UNTRACKED).otherwise(UNCOMMITTED).alias("type"))


def check_totals(files: DataFrame, git: DataFrame, links: DataFrame) -> DataFrame:
    """One row: files, git_errors, link_errors, file_not_found, anchor_not_found, success."""
    a = files.agg(F.count("*").alias("files"))
    b = git.agg(F.count("*").alias("git_errors"))
    c = links.agg(F.count("*").alias("link_errors"), F.count_if(F.col("type") == FILE_NOT_FOUND).alias("file_not_found"), F.count_if(F.col("type") == ANCHOR_NOT_FOUND).alias("anchor_not_found"))
    return a.crossJoin(b).crossJoin(c).withColumn("success", (F.col("git_errors") == 0) & (F.col("link_errors") == 0))
