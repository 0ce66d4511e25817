"""One query for each operation, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import EVERY, nearest
from .decontaminate import contaminated
from .html import extract_text
from .jaccard import near_duplicates
from .langid import identify
from .lines import EXACT_DOCS, recurring_lines
from .mixing import BITS, GOLDEN, TOKEN, mix_sources
from .pii import find_pii
from .repeats import repeated_passages
from .tokens import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=EVERY)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_lines(_table(spark, sf_dir, "documents"), exact_docs=EXACT_DOCS).drop("rk").withColumn("line_no", F.col("line_no").cast("bigint"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("rk")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_nearest_neighbours, op3_source_mix, op4_main_text, op5_line_dedup, op6_ngram_jaccard, op7_language_mixture, op8_pii, op9_repeated_passages, op10_decontamination]
    return {f.__name__: f for f in found}


_WORDS = r"'[^ \t\n\r\f\v]+'"

_MIX = rf"""
WITH counted AS (
  SELECT coalesce(source, '(none)') AS source, doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents WHERE text IS NOT NULL),
laid AS (
  SELECT source, doc_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY ord, doc_id, n
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM counted WHERE n > 0),
cut AS (
  SELECT source, doc_id, n, start, unnest(range(start // 2000, (start + n - 1) // 2000 + 1)) AS block FROM laid),
placed AS (
  SELECT source, block, doc_id, greatest(0, block * 2000 - start) AS token_from, least(n, (block + 1) * 2000 - start) AS token_to FROM cut),
sums AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM counted WHERE n > 0 GROUP BY source),
weighed AS (
  SELECT source, tokens, CAST(ceil(tokens / 2000) AS BIGINT) AS blocks,
         CAST(greatest(1, floor(pow(tokens, 0.7) * 1e6 / sum(round(pow(tokens, 0.7), 3)) OVER ())) AS BIGINT) AS w
  FROM sums),
shares AS (
  SELECT *, CAST(sum(w) OVER (ORDER BY source) AS BIGINT) AS upto, CAST(sum(w) OVER () AS BIGINT) AS total FROM weighed),
points AS (
  SELECT slot, (slot::HUGEINT * {GOLDEN}) % {1 << BITS} AS point
  FROM (SELECT unnest(range((SELECT max(((blocks + 64) * total + w - 1) // w) FROM shares))) AS slot)),
taken AS (
  SELECT p.slot, s.source, s.blocks, row_number() OVER (PARTITION BY s.source ORDER BY p.slot) - 1 AS rank
  FROM points p JOIN shares s ON p.point < s.upto::HUGEINT * {1 << BITS} // s.total AND p.point >= (s.upto - s.w)::HUGEINT * {1 << BITS} // s.total)
SELECT t.slot, t.source, t.rank // t.blocks AS epoch, t.rank % t.blocks AS block, p.doc_id,
       CAST(p.token_from AS BIGINT) AS token_from, CAST(p.token_to AS BIGINT) AS token_to
FROM taken t JOIN placed p ON p.source = t.source AND p.block = t.rank % t.blocks
WHERE t.slot <= (SELECT max(slot) FROM taken WHERE rank = blocks - 1)
"""

_LINES = """
WITH RECURSIVE texts AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS node FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
cut AS (SELECT node, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM texts),
split AS (SELECT *, list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda x: x <> '') AS w, NOT regexp_matches(line, '[0-9]') AS exact FROM cut),
lines AS (
  SELECT node, doc_id, line_no, exact, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM split WHERE len(w) >= 3 OR (len(w) >= 1 AND exact)),
leaves AS (SELECT *, len(t) || ' ' || array_to_string(t[1 : 4], ' ') AS leaf, array_to_string(t, ' ') AS masked FROM lines),
seen AS (SELECT * FROM leaves WHERE leaf IN (SELECT leaf FROM leaves GROUP BY leaf HAVING min(node) <> max(node))),
kinds AS (SELECT leaf, masked, any_value(t) AS t, row_number() OVER (ORDER BY masked) AS kind FROM seen WHERE len(t) >= 3 GROUP BY leaf, masked),
edges AS (
  SELECT x.kind AS a, y.kind AS b FROM kinds x JOIN kinds y ON y.leaf = x.leaf AND y.kind <> x.kind
  WHERE len(list_filter(list_zip(x.t, y.t), lambda z: z[1] = z[2])) >= 0.75 * len(x.t)),
reach AS (
  SELECT a AS root, a AS kind FROM edges GROUP BY a HAVING min(b) > a UNION SELECT r.root, e.b FROM reach r JOIN edges e ON e.a = r.kind),
classes AS (SELECT kind, min(root) AS class FROM reach GROUP BY kind),
tokens AS (SELECT c.class, unnest(range(len(k.t))) AS i, unnest(k.t) AS x FROM classes c JOIN kinds k ON k.kind = c.kind),
places AS (SELECT class, i, min(x) AS x, min(x) = max(x) AS same FROM tokens GROUP BY class, i),
made AS (
  SELECT class, list(CASE WHEN same THEN x ELSE '<*>' END ORDER BY i) AS x FROM places GROUP BY class HAVING count(*) FILTER (same AND x <> '<*>') >= 3),
grown AS (
  SELECT k.leaf, k.masked, array_to_string(coalesce(m.x, k.t), ' ') AS template
  FROM kinds k LEFT JOIN classes c ON c.kind = k.kind LEFT JOIN made m ON m.class = c.class
  WHERE len(list_filter(coalesce(m.x, k.t), lambda v: v <> '<*>')) >= 3),
placed AS (SELECT s.node, s.doc_id, s.line_no, s.leaf, s.masked, s.exact, g.template FROM seen s LEFT JOIN grown g ON g.leaf = s.leaf AND g.masked = s.masked),
stats AS (SELECT leaf, template, count(DISTINCT node) AS n_docs, min(node) AS first FROM placed WHERE template IS NOT NULL GROUP BY leaf, template HAVING count(DISTINCT node) >= 3),
same AS (SELECT * FROM placed p WHERE exact AND (template IS NULL OR (leaf, template) NOT IN (SELECT (leaf, template) FROM stats))),
alike AS (SELECT leaf, masked, count(DISTINCT node) AS n_docs, min(node) AS first FROM same GROUP BY leaf, masked HAVING count(DISTINCT node) >= 2)
SELECT p.doc_id, p.line_no, p.template, s.n_docs, p.node = s.first AS first_doc FROM placed p JOIN stats s ON s.leaf = p.leaf AND s.template = p.template
UNION ALL SELECT p.doc_id, p.line_no, p.masked, s.n_docs, p.node = s.first FROM same p JOIN alike s ON s.leaf = p.leaf AND s.masked = p.masked
"""

_JACCARD = rf"""
WITH RECURSIVE worded AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), {_WORDS}) AS w FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, w, row_number() OVER (ORDER BY doc_id, text) AS node FROM worded WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT node, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT node, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM numbered)),
sizes AS (SELECT node, count(*) AS n FROM grams GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE k >= 0.5 * (x.n + y.n - k) - 1e-9),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
parts AS (SELECT node, min(other) AS part, count(*) AS group_size FROM reach GROUP BY node)
SELECT n.doc_id, k.doc_id AS group_id, p.group_size, p.node = p.part AS keeper
FROM parts p JOIN numbered n ON n.node = p.node JOIN numbered k ON k.node = p.part
"""

_NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"

_CONTAMINATED = rf"""
WITH items AS (SELECT DISTINCT item_id, {_NORMAL} AS t, string_split({_NORMAL}, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
strings AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(w[i : i + 12], ' ') || ' ' AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE t <> '' AND (len(w) >= 6 OR length(t) >= 40))),
texts AS (SELECT DISTINCT doc_id, text, ' ' || {_NORMAL} || ' ' AS t FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, text, item_id, count(*) AS n FROM texts JOIN strings ON contains(t, s) GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS n_strings FROM hits GROUP BY doc_id, item_id
"""

_REPEATS = rf"""
WITH numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS node, regexp_extract_all(lower(text), {_WORDS}) AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
suffixes AS (
  SELECT node, doc_id, i - 1 AS f, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT node, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM numbered WHERE len(w) >= 50)),
shared AS (SELECT s FROM suffixes GROUP BY s HAVING min(node) <> max(node)),
spans AS (SELECT node, doc_id, f, f + 50 AS t FROM suffixes WHERE s IN (SELECT s FROM shared)),
marked AS (
  SELECT *, CASE WHEN max(t) OVER (PARTITION BY node ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= f THEN 0 ELSE 1 END AS new
  FROM spans),
islands AS (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY f) AS island FROM marked)
SELECT doc_id, min(f) AS word_from, max(t) AS word_to, max(t) - min(f) AS n_words FROM islands GROUP BY node, doc_id, island
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": _MIX, "op5_line_dedup": _LINES, "op6_ngram_jaccard": _JACCARD, "op9_repeated_passages": _REPEATS, "op10_decontamination": _CONTAMINATED}
