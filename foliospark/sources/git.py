"""History of a Git working tree, loaded once into tables."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

TIMEOUT = 30


def find_root(path: str) -> str:
    """The nearest directory from a path upwards that holds `.git`."""
    at = os.path.realpath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        up = os.path.dirname(at)
        if up == at:
            raise FileNotFoundError(f"no repository around {path}")
        at = up
    return at


def run(root: str, *args: str, timeout: float = TIMEOUT) -> str:
    """Output of a Git command; an error with its message if it fails or takes too long."""
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def read_versions(spark: SparkSession, root: str, paths: str = ".") -> DataFrame:
    """path, seq, hash, content: a row for each commit of a file, seq growing from the first commit on.

    The driver lists commits and paths; the contents are read by tasks, which need the working tree at
    the same place.
    """
    root = find_root(root)
    rows: list[tuple[str, int, str]] = []
    seq, commit = -1, ""
    for line in run(root, "log", "--reverse", "--first-parent", "-m", "--name-only", "--no-renames", "--diff-filter=AM", "--format=%x01%H", "--", paths).split("\n"):
        if line.startswith("\x01"):
            if line[1:] != commit:
                seq, commit = seq + 1, line[1:]
        elif line:
            rows.append((line, seq, commit))
    listed = spark.createDataFrame(rows, "path string, seq long, hash string")

    def contents(frames):
        for f in frames:
            f["content"] = [run(root, "show", f"{h}:{p}") for p, h in zip(f["path"], f["hash"], strict=True)]
            f["path"] = [f"{root}/{p}" for p in f["path"]]
            yield f

    return listed.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism))).mapInPandas(contents, "path string, seq long, hash string, content string")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """path of files that differ from the last commit, untracked ones among them."""
    root = find_root(root)
    out = run(root, "status", "--porcelain", "-uall", "-z")
    rows = [(f"{root}/{x[3:]}",) for x in out.split("\0") if len(x) > 3 and x[2] == " "]
    return spark.createDataFrame(rows, "path string")


def relative(path: str, root: str) -> str:
    """A path as seen from the repository's root; an error outside it."""
    full, base = os.path.realpath(path), os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} is not in {root}")
    return os.path.relpath(full, base)
