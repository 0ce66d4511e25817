"""Front matter as an ordered list of keys with string values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .markdown import front_matter_block, lines_unified

PROPS = "array<struct<key: string, values: array<string>>>"
_KEY = r"^([^\s#:-][^:]*?)\s*:(?:[ \t]+(.*))?$"
_STATE = "array<struct<key: string, mode: string, values: array<string>>>"


def _unquoted(v: Column) -> Column:
    return let(F.trim(v), _bare)


def _bare(v: Column) -> Column:
    return (
        F.when(v.rlike(r"^'.*'$"), F.replace(F.regexp_extract(v, r"^'(.*)'$", 1), F.lit("''"), F.lit("'")))
        .when(v.rlike(r'^".*"$'), F.replace(F.replace(F.regexp_extract(v, r'^"(.*)"$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
        .otherwise(v)
    )


def parse_properties(raw: Column) -> Column:
    """array<struct<key, values>> in the order of the document.

    Understood are `key: value` (quoted or not), `key: |` with an indented text, `key:` with `- item`
    lines and `[a, b]` lists; values are strings, whatever they look like. Comments and blank lines
    outside an indented text are skipped. A key that occurs again replaces its values in place.
    """
    one = lambda key, mode, values: F.array(F.struct(key.alias("key"), F.lit(mode).alias("mode"), values.alias("values")))
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        # of a long line, key and value are looked for once
        parts = F.struct(F.regexp_extract(line, _KEY, 1).alias("key"), F.trim(F.regexp_extract(line, _KEY, 2)).alias("value"))
        return let(parts, lambda p: taken(acc, line, p["key"], p["value"]))

    def taken(acc: Column, line: Column, key: Column, value: Column) -> Column:
        n = F.size(acc)
        last = F.get(acc, n - 1)
        mode = F.when(n > 0, last["mode"]).otherwise("")
        head = F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0)))
        text = F.regexp_replace(line, "^ {1,2}", "")
        item = _unquoted(F.regexp_extract(line, r"^\s*-\s+(.*)$", 1))
        grown = F.when(F.size(last["values"]) == 0, F.array(text)).otherwise(F.array(F.concat(F.get(last["values"], F.lit(0)), F.lit("\n"), text)))
        listed = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), r"\s*,\s*"), lambda x: _unquoted(x)), lambda x: x != "")
        return (
            F.when((mode == "text") & (line.startswith(" ") | (line == "")), F.concat(head, one(last["key"], "text", grown)))
            .when((mode == "list") & line.rlike(r"^\s*-\s+"), F.concat(head, one(last["key"], "list", F.array_append(last["values"], item))))
            .when(key == "", acc)
            .when(value.rlike(r"^[|>][+-]?$"), F.concat(acc, one(key, "text", none)))
            .when(value == "", F.concat(acc, one(key, "list", none)))
            .when(value.rlike(r"^\[.*\]$"), F.concat(acc, one(key, "done", listed)))
            .otherwise(F.concat(acc, one(key, "done", F.array(_unquoted(value)))))
        )

    lines = let(front_matter_block(lines_unified(raw)), lambda block: F.when(block == "", none).otherwise(F.split(block, "\n")))
    found = F.aggregate(lines, F.array().cast(_STATE), step)
    trimmed = F.transform(
        found,
        lambda p: F.struct(p["key"].alias("key"), F.when(p["mode"] == "text", F.transform(p["values"], lambda v: F.regexp_replace(v, r"\n+$", ""))).otherwise(p["values"]).alias("values")),
    )
    return merge_properties(F.array().cast(PROPS), trimmed)


def get_property(props: Column, key: Column | str) -> Column:
    """First value of a key; NULL without one."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.get(F.get(F.filter(props, lambda p: p["key"] == key), F.lit(0))["values"], F.lit(0))


def set_property(props: Column, key: Column | str, values: Column) -> Column:
    """A key's values (an array), in the place that the key has or at the end."""
    key = F.lit(key) if isinstance(key, str) else key
    new = F.struct(key.alias("key"), values.alias("values"))
    return let(props, lambda all_: F.when(F.exists(all_, lambda p: p["key"] == key), F.transform(all_, lambda p: F.when(p["key"] == key, new).otherwise(p))).otherwise(F.array_append(all_, new)))


def merge_properties(props: Column, others: Column) -> Column:
    """All properties of the first list with the values of the second, whose further keys follow."""
    return F.aggregate(others, props, lambda acc, p: set_property(acc, p["key"], p["values"]))


def quote(value: Column) -> Column:
    """A scalar as YAML needs it: in single quotes where it would be read as something else."""
    return let(value, _quoted)


def _quoted(value: Column) -> Column:
    needs = value.rlike(r"[:#'\"]") | value.rlike(r"^[-\[{!&*>|@`0-9]") | F.lower(value).isin("true", "false", "null", "yes", "no")
    return F.when(value == "", F.lit("''")).when(needs, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(value)


def serialize_properties(props: Column) -> Column:
    """The front matter with its marks, '' for none; keys without values are left out."""
    indented = lambda v: F.array_join(F.transform(F.split(v, "\n"), lambda s: F.concat(F.lit("  "), s)), "\n")

    def entry(p: Column) -> Column:
        values = p["values"]
        first = F.get(values, F.lit(0))
        many = F.concat(p["key"], F.lit(":\n"), F.array_join(F.transform(values, lambda v: F.concat(F.lit("  - "), quote(v))), "\n"))
        single = F.when(first.contains("\n"), F.concat(p["key"], F.lit(": |\n"), indented(first))).otherwise(F.concat(p["key"], F.lit(": "), quote(first)))
        return F.when(F.size(values) > 1, many).otherwise(single)

    shown = lambda all_: F.transform(F.filter(all_, lambda p: F.size(p["values"]) > 0), lambda p: F.concat(entry(p), F.lit("\n")))
    return let(props, lambda all_: F.when(F.size(all_) == 0, F.lit("")).otherwise(F.concat(F.lit("---\n"), F.array_join(shown(all_), ""), F.lit("---\n"))))
