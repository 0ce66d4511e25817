"""Translatable fields: blocks of `[[key]]` text in requests and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .frontmatter import get_property

HEADER = "Front matter fields to translate:"
#: A block in a response; the closing name is that of the opening one.
_BLOCK = r"(?s)\[\[([^\]\n]+)\]\]\s*\n?(.*?)\n?\s*\[\[/\1\]\]"
FIELDS = "array<struct<key: string, value: string>>"


def extract_fields(props: Column, keys: list[str]) -> Column:
    """array<struct<key, value>>: first values of the keys that have one with text, in the order of keys."""
    made = F.array(*[F.struct(F.lit(k).alias("key"), get_property(props, k).alias("value")) for k in keys]) if keys else F.array()
    return F.filter(made.cast(FIELDS), lambda f: F.trim(F.coalesce(f["value"], F.lit(""))) != "")


def format_fields(fields: Column) -> Column:
    """The header and a block for each field; '' for none."""
    blocks = F.transform(fields, lambda f: F.concat(F.lit("[["), f["key"], F.lit("]]\n"), f["value"], F.lit("\n[[/"), f["key"], F.lit("]]\n\n")))
    return F.when(F.size(fields) == 0, F.lit("")).otherwise(F.concat(F.lit(HEADER + "\n\n"), F.array_join(blocks, "")))


def parse_fields(response: Column, expected: Column) -> Column:
    """struct(fields, missing): values of the expected fields' blocks and the keys that have none with text.

    The last block of a key counts; unexpected and empty blocks are ignored.
    """
    found = F.transform(
        F.regexp_extract_all(response, F.lit(_BLOCK), F.lit(0)),
        lambda b: F.struct(F.trim(F.regexp_extract(b, _BLOCK, 1)).alias("key"), F.regexp_replace(F.regexp_extract(b, _BLOCK, 2), r"^\s+|\s+$", "").alias("value")),
    )

    def of(found: Column, key: Column) -> Column:
        return F.get(F.reverse(F.filter(found, lambda b: (b["key"] == key) & (b["value"] != ""))), F.lit(0))["value"]

    fields = let(found, lambda x: F.filter(F.transform(expected, lambda e: F.struct(e["key"].alias("key"), of(x, e["key"]).alias("value"))), lambda f: f["value"].isNotNull()))
    keys = F.transform(expected, lambda e: e["key"])
    return let(fields, lambda f: F.struct(f.alias("fields"), F.array_except(keys, F.transform(f, lambda x: x["key"])).alias("missing")))


def strip_fields(response: Column, expected: Column) -> Column:
    """The response without field blocks and header; unchanged where no fields are expected."""
    x = F.regexp_replace(response, _BLOCK, "")
    x = F.replace(x, F.lit(HEADER), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.size(expected) == 0, response).otherwise(x)


def changed_fields(now: Column, before: Column) -> Column:
    """Fields whose value differs from the earlier one or had none, in the order of the new ones."""

    def old(x: Column, key: Column) -> Column:
        return F.get(F.filter(x, lambda b: b["key"] == key), F.lit(0))["value"]

    return let(before, lambda x: F.filter(now, lambda f: ~f["value"].eqNullSafe(old(x, f["key"]))))


def combine(fields: Column, body: Column) -> Column:
    """Field blocks, then the body, without white space at the ends."""
    blocks = F.array_join(F.transform(fields, lambda f: F.concat(F.lit("[["), f["key"], F.lit("]]\n"), f["value"], F.lit("\n[[/"), f["key"], F.lit("]]\n\n"))), "")
    return F.regexp_replace(F.concat(blocks, F.coalesce(body, F.lit(""))), r"^\s+|\s+$", "")
