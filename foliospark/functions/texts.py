"""Small texts: masks, hashes, templates, progress, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import MARK, escaped, let, unescaped


def mask_secret(x: Column) -> Column:
    """The last four characters behind `****`; only the latter for a short or NULL secret."""
    return F.when(x.isNull() | (F.length(x) <= 4), F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(x, F.lit(4))))


def short_hash(x: Column) -> Column:
    return F.left(x, F.lit(7))


def truncate(x: Column, length: int) -> Column:
    return F.when(F.length(x) > length, F.concat(F.left(x, F.lit(length)), F.lit("..."))).otherwise(x)


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """The template with values for `{{name}}`, in one pass: values aren't searched, unknown names stay."""
    parts = F.split(F.regexp_replace(escaped(template), r"\{\{(\w+)\}\}", f"{MARK}$1{MARK}"), MARK)
    known = F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.coalesce(v, F.lit("")))]) if values else F.create_map().cast("map<string,string>")

    def shown(names: Column) -> Column:
        return F.transform(
            parts,
            lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(names, p), F.concat(F.lit("{{"), p, F.lit("}}")))).otherwise(unescaped(p)),
        )

    return F.array_join(let(known, shown), "")


def progress_bar(completed: Column, total: Column, cells: int = 20) -> Column:
    """`[=====               ]  25%`, in whole cells and percents; NULL for a total of 0."""
    done = F.floor(completed * cells / total).cast("int")
    bar = F.concat(F.repeat(F.lit("="), done), F.repeat(F.lit(" "), cells - done))
    return F.when(total > 0, F.format_string("[%s] %3d%%", bar, F.floor(completed * 100 / total).cast("int")))


def elapsed(millis: Column) -> Column:
    """Seconds with a decimal up to a minute, else minutes and seconds."""
    minutes, seconds = F.floor(millis / 60_000).cast("int"), F.floor(millis / 1000).cast("int")
    return F.when(millis < 60_000, F.format_string("%.1fs", millis / 1000.0)).otherwise(F.format_string("%dm %ds", minutes, seconds % 60))


def lines(x: Column) -> Column:
    """Lines split at `\\n`, `\\r\\n` or `\\r`, without an empty one at the end; none for an empty text."""
    parts = F.split(x, "\r\n|\r|\n")
    return F.when(x == "", F.array().cast("array<string>")).when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def join_lines(parts: Column, final_newline: Column) -> Column:
    return F.concat(F.array_join(parts, "\n"), F.when(final_newline & (F.size(parts) > 0), F.lit("\n")).otherwise(F.lit("")))


#: Languages by tag; others are shown by their tag.
LANGUAGES = {"cs": "Czech", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "ja": "Japanese", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sk": "Slovak", "uk": "Ukrainian", "zh": "Chinese"}


def language_name(tag: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.substring_index(F.replace(tag, F.lit("_"), F.lit("-")), "-", 1))), tag)
