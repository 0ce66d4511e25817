"""Unified diffs: making, parsing, checking, applying and counting.

Hunk positions refer to the original text throughout, so that hunks don't depend on each other, and a
pure insertion `@@ -N,0` comes behind line N, as usual in unified diffs.
"""

from __future__ import annotations

import difflib
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let
from ..functions.texts import lines

LINE = T.StructType().add("type", "string").add("content", "string")
HUNK = T.StructType().add("old_start", "integer").add("old_count", "integer").add("new_start", "integer").add("new_count", "integer").add("lines", T.ArrayType(LINE))
PARSED = T.StructType().add("hunks", T.ArrayType(HUNK)).add("error", "string")
APPLIED = T.StructType().add("text", "string").add("error", "string")
_header = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_KINDS = {" ": "CONTEXT", "+": "ADD", "-": "REMOVE"}


class DiffError(ValueError):
    """A diff that can't be read or doesn't fit its text."""


def split_lines(text: str) -> list[str]:
    """Lines ended by a newline of any kind; no empty one at the end."""
    parts = re.split(r"\r\n|\r|\n", text)
    return parts[:-1] if parts[-1] == "" else parts


def make_diff(old: str, new: str, context: int = 3) -> str:
    """Hunks that turn the old text into the new one, '' where their lines are the same."""
    out = difflib.unified_diff(split_lines(old), split_lines(new), "a", "b", lineterm="", n=context)
    found = list(out)[2:]
    return "\n".join(found) + "\n" if found else ""


def parse_diff(text: str) -> list[dict[str, Any]]:
    """Hunks of a diff; file headers and blank lines before a hunk are skipped, anything else there is an error."""
    rows = split_lines(text)
    hunks: list[dict[str, Any]] = []
    at = 0
    while at < len(rows):
        row = rows[at]
        m = _header.match(row)
        if not m:
            if row.strip() and not row.startswith(("---", "+++", "diff ", "index ", "\\")):
                raise DiffError(f"line {at + 1}: no hunk header: {row[:50]}")
            at += 1
            continue
        start, count, new_start, new_count = (int(g) if g is not None else 1 for g in m.groups())
        body: list[dict[str, str]] = []
        old, new = count, new_count
        at += 1
        while old > 0 or new > 0:
            if at >= len(rows):
                raise DiffError(f"line {at}: the hunk at -{start} ends early")
            row = rows[at]
            at += 1
            if row.startswith("\\"):
                continue
            kind = _KINDS.get(row[:1] or " ")
            if kind is None:
                raise DiffError(f"line {at}: not a line of a hunk: {row[:50]}")
            old -= kind != "ADD"
            new -= kind != "REMOVE"
            if old < 0 or new < 0:
                raise DiffError(f"line {at}: more lines than the hunk at -{start} says")
            body.append({"type": kind, "content": row[1:]})
        hunks.append({"old_start": start, "old_count": count, "new_start": new_start, "new_count": new_count, "lines": body})
    return hunks


def _first(hunk: dict[str, Any]) -> int:
    """0-based line of the original at which the hunk's first line stands."""
    return hunk["old_start"] if hunk["old_count"] == 0 else max(hunk["old_start"] - 1, 0)


def check_diff(text: str, hunks: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Every context or removed line that the original doesn't have where the hunk says."""
    rows = split_lines(text)
    found = []
    for k, hunk in enumerate(hunks):
        at = _first(hunk)
        for line in hunk["lines"]:
            if line["type"] == "ADD":
                continue
            actual = rows[at] if at < len(rows) else "<EOF>"
            if actual != line["content"]:
                found.append({"hunk": k, "line": at + 1, "expected": line["content"], "actual": actual})
            at += 1
    return found


def apply_diff(text: str, hunks: list[dict[str, Any]]) -> str:
    """The text with all hunks; an error at the first line that doesn't fit or where hunks overlap."""
    wrong = check_diff(text, hunks)
    if wrong:
        w = wrong[0]
        raise DiffError(f"line {w['line']}: expected {w['expected'][:50]!r}, found {w['actual'][:50]!r}")
    rows = split_lines(text)
    out: list[str] = []
    at = 0
    for hunk in sorted(hunks, key=_first):
        first = _first(hunk)
        if first < at:
            raise DiffError(f"line {first + 1}: hunks overlap")
        out += rows[at:first]
        out += [x["content"] for x in hunk["lines"] if x["type"] != "REMOVE"]
        at = first + sum(x["type"] != "ADD" for x in hunk["lines"])
    out += rows[at:]
    final = text.endswith(("\n", "\r")) or not text
    return "\n".join(out) + ("\n" if out and (final or not out[-1]) else "")


# plain functions get a hundred rows at once; Arrow's batches are of 10,000, each with all its texts and diffs


@F.udf(T.StringType(), useArrow=False)
def unified_diff(old: str | None, new: str | None) -> str | None:
    return None if old is None or new is None else make_diff(old, new)


@F.udf(PARSED, useArrow=False)
def parsed_diff(diff: str | None) -> tuple[Any, str | None]:
    """struct(hunks, error): hunks NULL with an error, empty for a blank diff."""
    if diff is None:
        return None, None
    try:
        return parse_diff(diff), None
    except DiffError as e:
        return None, str(e)


@F.udf(APPLIED, useArrow=False)
def applied_diff(text: str | None, diff: str | None) -> tuple[str | None, str | None]:
    """struct(text, error): a diff that can't be read or doesn't fit gives an error and no text."""
    if text is None or diff is None:
        return None, None
    try:
        return apply_diff(text, parse_diff(diff)), None
    except DiffError as e:
        return None, str(e)


def looks_like_diff(x: Column) -> Column:
    """Blank, or with a hunk header."""
    return (F.trim(x) == "") | x.rlike(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")


def count_lines(hunks: Column, kind: str) -> Column:
    """Lines of a kind (ADD, REMOVE, CONTEXT) in all hunks."""
    return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(F.filter(h["lines"], lambda x: x["type"] == kind)))


def serialize_hunks(hunks: Column, old_file: str | None = None, new_file: str | None = None) -> Column:
    """The diff's text, with `---` and `+++` lines where files are named."""
    sign = lambda t: F.when(t == "ADD", "+").when(t == "REMOVE", "-").otherwise(" ")
    shown = F.transform(
        hunks,
        lambda h: F.concat(
            F.format_string("@@ -%d,%d +%d,%d @@\n", h["old_start"], h["old_count"], h["new_start"], h["new_count"]),
            F.array_join(F.transform(h["lines"], lambda x: F.concat(sign(x["type"]), x["content"], F.lit("\n"))), ""),
        ),
    )
    names = (f"--- {old_file}\n" if old_file else "") + (f"+++ {new_file}\n" if new_file else "")
    return F.concat(F.lit(names), F.array_join(shown, ""))


def mismatches(edits: DataFrame, key: str = "path") -> DataFrame:
    """Rows key, hunk, line, expected, actual of a table (key, text, hunks), each row by itself: keys may recur or be NULL.

    The lines that a hunk expects are numbered in the original; a line behind its end is `<EOF>`.
    """

    def of_hunk(rows: Column, h: Column, k: Column) -> Column:
        first = F.when(h["old_count"] == 0, h["old_start"]).otherwise(F.greatest(h["old_start"] - 1, F.lit(0)))
        wanted = F.filter(h["lines"], lambda x: x["type"] != "ADD")
        return F.transform(
            wanted,
            lambda x, i: F.struct(k.alias("hunk"), (first + i + 1).alias("line"), x["content"].alias("expected"), F.coalesce(F.get(rows, first + i), F.lit("<EOF>")).alias("actual")),
        )

    found = let(lines(F.col("text")), lambda rows: F.flatten(F.transform("hunks", lambda h, k: of_hunk(rows, h, k))))
    return edits.select(key, F.explode(F.filter(found, lambda x: x["expected"] != x["actual"])).alias("x")).select(key, "x.*")
