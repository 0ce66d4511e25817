"""Document corpora derived from the test tables, the same in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markdown import slugify

FENCE = "\n```\n# no heading\n[code](never.md)\n```\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md(spark: SparkSession, sf_dir: str, fenced: bool = False) -> DataFrame:
    """doc_id, path, content: documents as Markdown with headings, links that work and links that don't.

    With fenced, every fifth document ends with a code block that looks like a heading and a link. Every
    fourth line is a heading, as long as it is; a document's partner is that of a dense number.
    """
    base = _base(table(spark, sf_dir, "documents"))

    def line(x, i):
        return (
            F.when((i % 4 == 0) & (F.trim(x) != ""), F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 4 + 1).cast("int")), F.lit(" "), x))
            .when(i % 4 == 0, x)
            .when(i % 4 == 1, F.concat(x, F.lit(" [ok]("), F.col("tgt"), F.lit("#"), F.col("tslug"), F.lit(")")))
            .when(i % 4 == 2, F.concat(x, F.lit(" [anchor]("), F.col("tgt"), F.lit("#nope-"), i, F.lit(")")))
            .otherwise(F.concat(x, F.lit(" [file](missing-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".md) [ext](https://example.org/"), i, F.lit(") ![img](../../assets/img-"), F.coalesce(F.col("doc_id") % 7, F.lit(0)), F.lit(".png)")))
        )

    out = base.select("doc_id", "path", F.array_join(F.transform("lines", line), "\n").alias("content"))
    return out.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(FENCE))).otherwise(F.col("content"))) if fenced else out


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, path, lines, tgt, tslug of every document; partners by a dense number of the distinct rows."""
    docs = docs.select("doc_id", "lang", "source", "text", F.xxhash64("doc_id", "lang", "source", "text").alias("rk"))
    # only ids and keys go through the one task that numbers
    numbers = docs.groupBy("rk").agg(F.first("doc_id").alias("id")).select("rk", (F.row_number().over(Window.orderBy("id", "rk")) - 1).alias("rn"))
    n = numbers.agg(F.count("*").alias("n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row-"), "rn"))
    path = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), name, F.lit(".md"))
    numbered = docs.join(numbers, "rk").withColumn("path", path)
    tslug = F.coalesce(slugify(F.substring_index("text", "\n", 1)), F.lit(""))
    ends = numbered.groupBy(F.col("rn").alias("tn")).agg(F.first(F.concat(F.lit("../../"), "path")).alias("tgt"), F.first(tslug).alias("tslug"))
    return numbered.crossJoin(F.broadcast(n)).join(ends, F.expr("tn = (rn * 31L + 7) % n"), "left").select("doc_id", "path", F.split("text", "\n").alias("lines"), "tgt", "tslug")


def slug_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s-]', '', 'g'), '\s', '-', 'g'), '^-+|-+$', '', 'g')"


def heading_sql(x: str) -> str:
    """Text of a heading line without its marks."""
    return rf"trim(regexp_replace(regexp_replace({x}, '[ \t]+#+[ \t]*$', ''), '[*_~`]', '', 'g'))"


def norm_sql(p: str) -> str:
    return (
        f"array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda z: [z]), lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc "
        f"WHEN x[1] = '..' AND len(acc) > 0 AND acc[len(acc)] <> '..' THEN acc[1 : len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[]), '/')"
    )


def parent_sql(p: str) -> str:
    return f"regexp_replace({p}, '/?[^/]*$', '')"


MD_SQL = f"""
named AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn, lang || '/' || source || '/doc-' || doc_id || '.md' AS path FROM documents),
base AS (
  SELECT d.doc_id, d.path, string_split(d.text, chr(10)) AS lines, '../../' || t.path AS tgt, {slug_sql("split_part(t.text, chr(10), 1)")} AS tslug
  FROM named d LEFT JOIN named t ON t.rn = (d.rn * 31 + 7) % (SELECT count(*) FROM documents)),
md AS (
  SELECT doc_id, path, array_to_string(list_transform(lines, lambda x, i: CASE
    WHEN (i - 1) % 4 = 0 AND trim(x) <> '' THEN repeat('#', CAST(1 + ((i - 1) // 4) % 4 AS INT)) || ' ' || x
    WHEN (i - 1) % 4 = 0 THEN x
    WHEN (i - 1) % 4 = 1 THEN x || ' [ok](' || tgt || '#' || tslug || ')'
    WHEN (i - 1) % 4 = 2 THEN x || ' [anchor](' || tgt || '#nope-' || (i - 1) || ')'
    ELSE x || ' [file](missing-' || doc_id || '.md) [ext](https://example.org/' || (i - 1) || ') ![img](../../assets/img-' || (doc_id % 7) || '.png)' END), chr(10)) AS content
  FROM base)"""

LINES_SQL = "lines AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS ln FROM md)"
HEADINGS_SQL = rf"""
{LINES_SQL},
heads AS (
  SELECT doc_id, path, ln, length(regexp_extract(line, '^(#+) ', 1)) AS level, {heading_sql("regexp_replace(line, '^#+ ', '')")} AS text
  FROM lines WHERE regexp_matches(line, '^#{{1,6}} ')),
headings AS (
  SELECT doc_id, path, row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS pos, level, text, {slug_sql("text")} AS slug FROM heads WHERE text <> '')"""
LINKS_SQL = r"""
found AS (SELECT doc_id, path, regexp_extract_all(content, '\]\(([^)\s]+)\)', 1) AS ds FROM md),
links AS (
  SELECT doc_id, path, unnest(range(len(ds))) AS pos, unnest(ds) AS destination FROM found),
parsed AS (
  SELECT *, regexp_matches(lower(destination), '^(https?://|mailto:|tel:|ftp://|//)') AS is_external FROM links),
parts AS (
  SELECT *, CASE WHEN NOT is_external AND NOT starts_with(destination, '#') THEN split_part(destination, '#', 1) END AS link_path,
         CASE WHEN NOT is_external AND contains(destination, '#') THEN substr(destination, strpos(destination, '#') + 1) END AS anchor FROM parsed)"""


def resolved_sql(files: str = "SELECT path FROM md") -> str:
    return f"""
resolved AS (
  SELECT *, {norm_sql(f"{parent_sql('path')} || '/' || link_path")} AS target FROM parts WHERE link_path IS NOT NULL),
assets AS (SELECT 'assets/img-' || k || '.png' AS path FROM range(5) r(k)),
known AS ({files} UNION SELECT path FROM assets),
errors AS (
  SELECT path, pos, destination, target, anchor, 'FILE_NOT_FOUND' AS type FROM resolved WHERE target NOT IN (SELECT path FROM known)
  UNION ALL
  SELECT path, pos, destination, target, anchor, 'ANCHOR_NOT_FOUND' FROM resolved r
  WHERE anchor IS NOT NULL AND target IN (SELECT path FROM known)
    AND NOT EXISTS (SELECT 1 FROM headings h WHERE h.path = r.target AND lower(h.slug) = lower(r.anchor)))"""


def assets(spark: SparkSession) -> DataFrame:
    """The asset files that exist beside the documents."""
    return spark.range(5).select(F.concat(F.lit("assets/img-"), F.col("id"), F.lit(".png")).alias("path"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw, title, source, lang: documents with front matter of every supported kind."""
    docs = table(spark, sf_dir, "documents")
    title = F.trim(F.regexp_replace("text", r"[^\p{L}\p{N} ]", ""))
    head = F.concat(
        F.lit("---\ntitle: "), title, F.lit("\nsource: "), "source", F.lit("\ntags:\n  - "), "lang", F.lit("\n  - x\nnote: |\n  line "), "doc_id", F.lit("\n  second\n---\n\n"),
    )
    return docs.select("doc_id", F.concat(head, "text").alias("raw"), title.alias("title"), "source", "lang")


TITLE_SQL = r"trim(regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g'))"
RAW_SQL = f"""
raw AS (
  SELECT doc_id, source, lang, text, {TITLE_SQL} AS title,
         '---' || chr(10) || 'title: ' || {TITLE_SQL} || chr(10) || 'source: ' || source || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - x' || chr(10)
         || 'note: |' || chr(10) || '  line ' || doc_id || chr(10) || '  second' || chr(10) || '---' || chr(10) || chr(10) || text AS raw
  FROM documents)"""


def mirrored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources below source/ and a translated mirror below mirror/, of which every tenth document misses a heading."""
    src = md(spark, sf_dir).select("doc_id", F.concat(F.lit("source/"), "path").alias("path"), "content")
    lines = F.split("content", "\n")
    cut = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~((F.col("doc_id") % 10 == 0) & (s["i"] == 4)))
    made = F.array_join(F.transform(cut, lambda s: F.regexp_replace(s["x"], r"^(#{1,6}) ", "$1 Neu ")), "\n")
    mirror = src.select("doc_id", F.regexp_replace("path", "^source/", "mirror/").alias("path"), made.alias("content"))
    return src, mirror


MIRROR_SQL = rf"""
mheads AS (
  SELECT doc_id, path, ln, {heading_sql("'Neu ' || regexp_replace(line, '^#+ ', '')")} AS text
  FROM lines WHERE regexp_matches(line, '^#{{1,6}} ') AND NOT (doc_id % 10 = 0 AND ln = 4)),
mheadings AS (SELECT doc_id, path, row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS pos, {slug_sql("text")} AS slug FROM mheads),
mcontent AS (
  SELECT doc_id, path, array_to_string(list(line ORDER BY ln), chr(10)) AS content FROM lines WHERE NOT (doc_id % 10 = 0 AND ln = 4) GROUP BY doc_id, path),
mfound AS (SELECT doc_id, path, regexp_extract_all(content, '\]\(([^)\s]+)\)', 1) AS ds FROM mcontent),
mlinks AS (SELECT doc_id, path, unnest(range(len(ds))) AS pos, unnest(ds) AS destination FROM mfound),
counts AS (
  SELECT m.path, (SELECT count(*) FROM headings h WHERE h.path = m.path) AS n_source, (SELECT count(*) FROM mheadings h WHERE h.path = m.path) AS n_target FROM md m),
seen AS (
  SELECT *, split_part(destination, '#', 1) AS link, CASE WHEN contains(destination, '#') THEN substr(destination, strpos(destination, '#') + 1) END AS anchor,
         {norm_sql(f"{parent_sql('path')} || '/' || split_part(destination, '#', 1)")} AS target
  FROM mlinks WHERE NOT starts_with(destination, 'https://')),
placed AS (
  SELECT s.*, c.n_source, c.n_target, (SELECT min(h.pos) FROM headings h WHERE h.path = s.target AND lower(h.slug) = lower(s.anchor)) AS place
  FROM seen s LEFT JOIN counts c ON c.path = s.target AND s.anchor <> ''),
decided AS (
  SELECT p.*, t.slug AS new_anchor,
         CASE WHEN n_source IS NULL THEN NULL WHEN n_source <> n_target THEN 'MISMATCH' WHEN place IS NULL THEN 'UNCHANGED' ELSE 'TRANSLATED' END AS status
  FROM placed p LEFT JOIN mheadings t ON t.path = p.target AND t.pos = p.place),
corrected AS (
  SELECT doc_id, path, pos, target, anchor, status, destination, n_source, n_target, new_anchor,
         CASE WHEN status = 'TRANSLATED' THEN link || '#' || new_anchor WHEN ends_with(link, '.png') THEN '../../../source/' || target ELSE destination END AS new
  FROM decided)"""
