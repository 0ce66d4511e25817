"""Document trees in a file system that the driver and all executors reach under the same paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import file_name, parent
from ..operators.scan import DEFAULT_INCLUDE, NORMAL, REPLACE

#: Files that a task reads.
FILES_PER_TASK = 256


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    """Lists on the driver, where whole directories are left out before they are entered; reads in tasks."""

    def __init__(self, root: str, include: str, exclusions: list[str], contents: bool):
        self.root, self.contents = root, contents
        self.include, self.exclusions = re.compile(include), [re.compile(x) for x in exclusions if x.strip()]

    def _walk(self, directory: str) -> Iterator[str]:
        with os.scandir(directory) as found:
            for e in found:
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if not any(x.fullmatch(e.path) or x.fullmatch(e.path + "/") for x in self.exclusions):
                        yield from self._walk(e.path)
                elif e.is_file() and self.include.fullmatch(e.path) and not any(x.fullmatch(e.path) for x in self.exclusions):
                    yield e.path

    def partitions(self) -> list[InputPartition]:
        paths = sorted(self._walk(self.root))
        return [_Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            if not self.contents:
                yield (path,)
                continue
            with open(path, "rb") as f:
                yield path, f.read().decode("utf-8", "replace")


class DocumentTree(DataSource):
    """Format `document_tree`: path, content of text files, hidden and empty ones too. Links aren't followed.

    Options: root; include and exclusions (separated by newlines), regular expressions that match whole
    paths, the latter also directories; contents (`false` for the paths alone).
    """

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return "path string, content string" if self.options.get("contents", "true") == "true" else "path string"

    def reader(self, schema) -> _Reader:
        o = self.options
        return _Reader(o["root"], o.get("include", ".*"), o.get("exclusions", "").split("\n"), o.get("contents", "true") == "true")


def _tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(DocumentTree)
    return spark.read.format("document_tree").options(root=checked_root(root), **options).load()


def checked_root(root: str) -> str:
    """The root as an absolute path; an error where it is missing or isn't a directory."""
    full = os.path.realpath(root)
    if not os.path.exists(full):
        raise FileNotFoundError(f"no such directory: {root}")
    if not os.path.isdir(full):
        raise NotADirectoryError(f"not a directory: {root}")
    return full


def read_tree(spark: SparkSession, root: str, include: str = DEFAULT_INCLUDE, exclusions: list[str] | None = None) -> DataFrame:
    """path, content of the chosen files below a directory, ordered by path; malformed bytes are replaced."""
    return _tree(spark, root, include=include, exclusions="\n".join(exclusions or [])).orderBy("path")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below a directory; contents aren't read."""
    return _tree(spark, root, contents="false")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """dir, kind, content of the instruction files below a directory."""
    files = _tree(spark, root, include=f"(?s).*/(?:{re.escape(NORMAL)}|{re.escape(REPLACE)})")
    kind = F.when(file_name(F.col("path")) == REPLACE, "replace").otherwise("normal")
    return files.select(parent(F.col("path")).alias("dir"), kind.alias("kind"), "content")


def write_documents(docs: DataFrame, root: str | None = None) -> None:
    """Write (path, content) as UTF-8 files, each where its path says, below a root if one is given.

    Directories are made, files overwritten; a file appears whole under its name, so that a repeated
    task does no harm.
    """

    def write(rows: Iterable[Row]) -> None:
        for r in rows:
            path = os.path.join(root, r.path.lstrip("/")) if root else r.path
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.content)
            os.replace(part, path)

    docs.select("path", "content").foreachPartition(write)
