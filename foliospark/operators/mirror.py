"""Repairing the links of a translated mirror of a corpus.

A mirror has the same relative paths below another root. Its documents keep links to each other but
need the anchors of the translated headings, and links to assets have to lead back to the source tree.
All lookups are equi-joins with one row a document: anchors are translated by their position in its list of headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions.binding import let
from ..functions.frontmatter import parse_properties, serialize_properties
from ..functions.markdown import anchors, body
from ..functions.paths import is_translatable, mirror, normalize, parent, relativize, resolve
from .integrity import link_errors
from .scan import DEFAULT_INCLUDE

TRANSLATED, UNCHANGED, MISMATCH = "TRANSLATED", "UNCHANGED", "MISMATCH"


def heading_slugs(docs: DataFrame) -> DataFrame:
    """path, slugs: the slugs of all headings of a document in order, one row for each path; every document is read once."""
    return docs.select("path", anchors(F.col("content")).alias("slugs")).groupBy("path").agg(F.flatten(F.collect_list("slugs")).alias("slugs"))


def _translated(asked: DataFrame, sources: DataFrame, targets: DataFrame, how: str) -> DataFrame:
    """asked (source_path, target_path, anchor, ...) with status, new_anchor, n_source, n_target, by one join with each side's documents."""
    there = sources.withColumn("keys", F.transform("slugs", lambda s: F.lower(s)))
    met = asked.join(there.select(F.col("path").alias("source_path"), F.size("keys").alias("n_source"), "keys"), "source_path", how)
    met = met.withColumn("place", F.coalesce(F.array_position("keys", F.lower("anchor")), F.lit(0))).drop("keys")
    met = met.join(targets.select(F.col("path").alias("target_path"), F.size("slugs").alias("n_target"), "slugs"), "target_path", how)
    status = F.when(F.col("n_source") != F.col("n_target"), MISMATCH).when(F.col("place") == 0, UNCHANGED).otherwise(TRANSLATED)
    new = F.when((F.col("n_source") == F.col("n_target")) & (F.col("place") > 0), F.get("slugs", F.col("place").cast("int") - 1))
    return met.withColumns({"status": F.when(F.col("n_source").isNotNull() & F.col("n_target").isNotNull(), status), "new_anchor": new}).drop("slugs", "place")


def translate_anchors(asked: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source_path, target_path, anchor, status, new_anchor, n_source, n_target of distinct (source_path, target_path, anchor).

    The anchor's place among the source's headings (the first one, in any case) gives the heading of the
    target. MISMATCH where both have different numbers of headings, UNCHANGED where the anchor isn't
    one of the source. Pairs of which a document is missing are left out.
    """
    asked = asked.select("source_path", "target_path", "anchor").distinct()
    met = _translated(asked, heading_slugs(sources), heading_slugs(targets), "inner")
    return met.select("source_path", "target_path", "anchor", "status", "new_anchor", "n_source", "n_target")


def _parts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """path, props, part, pos, before, destination: the pieces of bodies ('' as part) and of the fields' first values.

    A document's first piece carries its front matter.
    """
    texts = [F.struct(F.lit("").alias("part"), body(F.col("content")).alias("text"))]
    values = F.transform(F.filter("props", lambda p: p["key"].isin(fields) & (F.size(p["values"]) > 0)), lambda p: F.struct(p["key"].alias("part"), F.get(p["values"], F.lit(0)).alias("text"))) if fields else None
    all_texts = F.concat(F.array(*texts), values) if values is not None else F.array(*texts)
    rows = docs.select("path", "props", F.explode(all_texts).alias("t"))
    rows = rows.select("path", "props", "t.part", F.posexplode(L.link_segments(F.col("t.text"))).alias("pos", "s"))
    return rows.select("path", F.when((F.col("part") == "") & (F.col("pos") == 0), F.col("props")).alias("props"), "part", "pos", "s.before", "s.destination")


def _led(source_root: str, target_root: str, include: str, exclusions: list[str]) -> Column:
    """struct(anchor, link, seen, document, from_doc, to_doc) of a piece's destination, every step of it taken once."""
    parts = F.struct(F.col("path").alias("path"), F.col("destination").alias("d"), mirror(F.col("path"), target_root, source_root).alias("source_path"))

    def split(x: Column) -> Column:
        d = x["d"]
        own = F.struct(x["path"].alias("path"), x["source_path"].alias("source_path"), d.startswith("#").alias("here"), (~L.is_external(d) & ~d.startswith("/")).alias("inside"), L.link_anchor(d).alias("anchor"), F.when(~d.startswith("/"), L.link_path(d)).alias("link"))
        return let(own, placed)

    def placed(y: Column) -> Column:
        seen = F.when(y["link"].isNotNull(), resolve(parent(y["source_path"]), L.url_decode(y["link"])))
        return let(seen, lambda z: let(is_translatable(z, source_root, include, exclusions), lambda document: made(y, z, document)))

    def made(y: Column, seen: Column, document: Column) -> Column:
        asks = (y["anchor"] != "") & y["inside"]
        source = F.when(asks & y["here"], y["source_path"]).when(asks & document, seen)
        target = F.when(asks & y["here"], y["path"]).when(asks & document, mirror(seen, source_root, target_root))
        return F.struct(y["anchor"].alias("anchor"), y["link"].alias("link"), seen.alias("seen"), document.alias("document"), source.alias("from_doc"), target.alias("to_doc"))

    return let(parts, split)


def correct_links(
    translated: DataFrame, sources: DataFrame, files: DataFrame, source_root: str, target_root: str,
    include: str = DEFAULT_INCLUDE, exclusions: list[str] | None = None, fields: list[str] | None = None, already_corrected: bool = False,
) -> DataFrame:
    """path, content, asset_corrections, anchor_corrections, front_matter_corrections, errors, writable.

    translated: (path, content) of the mirror; sources: (path, content) of the documents; files: (path)
    of everything that exists. Links in code stay. External and absolute links stay; an anchor becomes
    that of the translated heading at the same place (counted even where it is the same); a path to a
    document stays; one to anything else leads from the mirror to the source's asset (counted where it
    changes). Front matter values that name an existing file are led there too, and the given fields'
    links are corrected as in the body. Documents with different numbers of headings give an error, and
    a file with errors isn't writable, nor is one without corrections. With already_corrected, asset
    links that exist as seen from the mirror stay, so that a second run changes nothing.
    """
    exclusions, fields = exclusions or [], fields or []
    docs = translated.select(normalize(F.col("path")).alias("path"), "content").withColumn("props", parse_properties(F.col("content")))
    source_of = mirror(F.col("path"), target_root, source_root)
    parts = _parts(docs, fields).withColumn("x", _led(source_root, target_root, include, exclusions)).select("path", "props", "part", "pos", "before", "destination", "x.*")
    # pieces that ask for nothing meet no document, each under its own path, so that they don't gather in one task
    d, alone = F.col("destination"), F.concat(F.lit("\0"), "path")
    asks = F.col("from_doc").isNotNull() & F.col("to_doc").isNotNull()
    parts = parts.withColumn("source_path", F.when(asks, F.col("from_doc")).otherwise(alone)).withColumn("target_path", F.when(asks, F.col("to_doc")).otherwise(alone))
    there = heading_slugs(sources.select(normalize(F.col("path")).alias("path"), "content"))
    parts = _translated(parts, there, heading_slugs(docs.select("path", "content")), "left")
    asset = F.col("link").isNotNull() & ~F.col("document")
    if already_corrected:
        here = files.select(normalize(F.col("path")).alias("at")).distinct().withColumn("exists", F.lit(True))
        parts = parts.withColumn("at", F.coalesce(resolve(parent(F.col("path")), L.url_decode(F.col("link"))), alone)).join(here, "at", "left")
        asset = asset & F.col("exists").isNull()
    suffix = F.when(F.col("anchor") != "", F.concat(F.lit("#"), F.col("anchor"))).otherwise("")
    led = F.concat(relativize(parent(F.col("path")), F.col("seen")), suffix)
    new = (
        F.when((F.col("status") == TRANSLATED) & d.startswith("#"), F.concat(F.lit("#"), F.col("new_anchor")))
        .when(F.col("status") == TRANSLATED, F.concat(F.col("link"), F.lit("#"), F.col("new_anchor")))
        .when(asset, led)
        .otherwise(d)
    )
    error = F.when(F.col("status") == MISMATCH, F.concat(F.col("from_doc"), F.lit(" has "), F.col("n_source"), F.lit(" headings, "), F.col("to_doc"), F.lit(" has "), F.col("n_target")))
    parts = parts.withColumn("new", new).withColumn("error", error).withColumn("moved", asset & (F.col("new") != d))
    pieces = lambda part: F.array_join(F.transform(F.filter("pieces", lambda x: x["part"] == part), lambda x: x["t"]), "")
    named_parts = F.array_distinct(F.transform(F.filter("pieces", lambda x: x["part"] != ""), lambda x: x["part"]))
    per_file = parts.groupBy("path").agg(
        F.first("props", ignorenulls=True).alias("props"),
        F.sort_array(F.collect_list(F.struct("part", "pos", F.concat("before", F.coalesce("new", F.lit(""))).alias("t")))).alias("pieces"),
        F.count_if("moved").alias("asset_corrections"),
        F.count_if(F.col("status") == TRANSLATED).alias("anchor_corrections"),
        F.sort_array(F.collect_list("error")).alias("errors"),
    )
    per_file = per_file.withColumn("body", pieces(F.lit(""))).withColumn("field_texts", F.transform(named_parts, lambda k: F.struct(k.alias("key"), pieces(k).alias("value")))).drop("pieces")
    # other front matter values that name an existing file
    named = docs.select("path", F.explode(F.filter("props", lambda p: F.size(p["values"]) > 0)).alias("p")).select("path", "p.key", F.get("p.values", F.lit(0)).alias("value"))
    named = named.where(L.is_likely_file_path(F.col("value")) & ~F.col("key").isin(fields) if fields else L.is_likely_file_path(F.col("value")))
    named = named.withColumn("seen", resolve(parent(source_of), L.url_decode(F.col("value"))))
    named = named.join(files.select(normalize(F.col("path")).alias("seen")).distinct(), "seen", "left_semi")
    named = named.withColumn("new", relativize(parent(F.col("path")), F.col("seen"))).where("new <> value")
    led_fields = named.groupBy("path").agg(F.collect_list(F.struct("key", F.col("new").alias("value"))).alias("led"))
    out = per_file.join(led_fields, "path", "left")
    out = out.withColumn("led", F.coalesce("led", F.array().cast("array<struct<key: string, value: string>>")))
    fixes = F.concat(F.col("led"), F.col("field_texts"))
    fix = lambda p: F.get(F.filter(fixes, lambda f: f["key"] == p["key"]), F.lit(0))["value"]
    props = F.transform(
        "props",
        lambda p: F.struct(p["key"].alias("key"), F.when(fix(p).isNotNull(), F.concat(F.array(fix(p)), F.slice(p["values"], F.lit(2), F.greatest(F.size(p["values"]) - 1, F.lit(0))))).otherwise(p["values"]).alias("values")),
    )
    out = out.withColumn("content", F.concat(serialize_properties(props), F.col("body"))).withColumn("front_matter_corrections", F.size("led").cast("long"))
    total = F.col("asset_corrections") + F.col("anchor_corrections") + F.col("front_matter_corrections")
    return out.select("path", "content", "asset_corrections", "anchor_corrections", "front_matter_corrections", "errors", ((F.size("errors") == 0) & (total > 0)).alias("writable"))


def correction_totals(corrected: DataFrame) -> DataFrame:
    """One row: files, files_corrected, asset, anchor and front matter corrections, files_with_errors."""
    total = F.col("asset_corrections") + F.col("anchor_corrections") + F.col("front_matter_corrections")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return corrected.agg(
        F.count("*").alias("files"), F.count_if(total > 0).alias("files_corrected"), zero("asset_corrections"), zero("anchor_corrections"),
        zero("front_matter_corrections"), F.count_if(F.size("errors") > 0).alias("files_with_errors"),
    )


def check_corrected(corrected: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Link errors that remain in corrected documents (see `link_errors`)."""
    # with the condition, what reads the paths alone shares the documents' rows with what reads their contents
    return link_errors(corrected.select("path", "content").where("content is not null"), files, root)
