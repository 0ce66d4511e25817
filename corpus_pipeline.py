"""A corpus pipeline: language ID, line dedup, near duplicates, decontamination, source mixing.

Every stage takes (spark, docs, sf_dir) with the columns of documents, further ones among them whatever
their names, and works on all rows. All but the last return the columns that they were given. NULL
doc_ids, sources and languages, empty and very long texts, repeated rows and empty tables have the
results that each stage tells.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.decontaminate import decontaminate
from foliospark.llm.jaccard import drop_near_duplicates
from foliospark.llm.langid import keep_identified
from foliospark.llm.lines import dedup_lines
from foliospark.llm.mixing import mix_sources
from foliospark.llm.text import checkpoint_ready
from foliospark.llm.tokens import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose words some language explains; those that unknown text explains clearly better go, as do NULL, empty and wordless texts.

    Without labelled rows (`lang`) all rows with words stay. Repeated rows stay or go together; an empty
    table stays empty.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without the lines that recur in other documents; the document with the least doc_id keeps each.

    A row that loses all its lines goes; n_chars follows the text. NULL and empty texts stay as they are.
    A repeated row is the same document, so that it keeps what it has; an empty table stays empty.
    """
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the least doc_id (NULL is the least).

    Of a repeated row one stays. NULL, empty and wordless texts all stay; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no test string of the benchmark occurs.

    NULL and empty texts stay, and all rows do with an empty benchmark. Repeated rows stay or go together.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: slot, source, epoch, block, doc_id, token_from, token_to.

    Tokens are those of the vocabulary that `token_counts` uses. NULL and empty texts have no tokens and
    so no slot; rows with NULL source form one of their own; repeated rows each have their place. An
    empty table has no slots.
    """
    return mix_sources(docs, tokenizer_path=TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Neither the mixture models nor the template trees can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result but the last written to the shared folder and read again.

    The folder is the session's checkpoint folder (spark.checkpoint.dir), so that a lost executor takes
    nothing with it that a later stage needs.
    """
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
