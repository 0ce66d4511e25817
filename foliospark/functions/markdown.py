"""Markdown structure as column expressions: code, headings, slugs, bodies.

The supported part of the grammar: front matter, fenced and indented code, code spans, ATX headings (in
quotes and list items, too) and setext headings, links and images, inline or by reference, autolinks.
All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_FENCE = r"(?ms)^ {0,3}(```+|~~~+)[^\n]*(?:\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)|\z)"
#: The mark of an indented line is looked for first, as the look back for an empty line is dear. Groups are
#: repeated possessively throughout, for which the engine needs no stack, however long the text is.
_INDENTED = r"(?= {4}|\t)(?:\A|(?<=\n[ \t]{0,80}\n))(?:(?: {4}|\t)[^\n]*+(?:\n|\z))++"
#: A span ends with as many backticks as it starts with, before its paragraph does.
_SPAN = r"(?<!`)(`+)(?!`)((?:[^`\n]++|\n(?![ \t]*(?:\n|\z))|(?!\1(?!`))`++)++)\1(?!`)"
_BODY = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"
#: Quotes and list items that a heading may stand in.
_INSIDE = r"(?:[ \t]{0,3}(?:>|[-*+](?=[ \t])|\d{1,9}[.)](?=[ \t]))[ \t]?)*+"
_MARKS = rf"^{_INSIDE} {{0,3}}(#{{1,6}})[ \t]+(?=.)"
_HEADING = rf"(?m){_MARKS}.+"
#: What closes a heading that has text before it.
_CLOSED = r"(?<=.)(?:[ \t]+#+)?[ \t]*\z"


def _where(text: Column, may: Callable[[Column], Column], pattern: str, new: str = "") -> Column:
    """The text with matches replaced, and left alone where a cheap test says that there are none."""
    return let(text, lambda x: F.when(may(x), F.regexp_replace(x, pattern, new)).otherwise(x))


def body(raw: Column) -> Column:
    """The document without its front matter."""
    return _where(raw, lambda x: x.startswith("---"), _BODY)


def front_matter_block(raw: Column) -> Column:
    """The lines between the `---` marks; '' without front matter."""
    return let(raw, lambda x: F.when(x.isNull() | x.startswith("---"), F.regexp_extract(x, _BODY, 1)).otherwise(""))


def lines_unified(raw: Column) -> Column:
    """The text with `\\n` for `\\r\\n` and `\\r`."""
    return _where(raw, lambda x: x.contains("\r"), "\r\n?", "\n")


def without_blocks(content: Column) -> Column:
    """The body without fenced and indented code."""
    unfenced = _where(body(lines_unified(content)), lambda x: x.contains("```") | x.contains("~~~"), _FENCE)
    return _where(unfenced, lambda x: x.contains("    ") | x.contains("\t"), _INDENTED)


def without_code(content: Column) -> Column:
    """The body without code of any kind, spans included."""
    return _where(without_blocks(content), lambda x: x.contains("`"), _SPAN)


def slugify(text: Column) -> Column:
    """Lower case; letters, digits, white space and `-` only; a `-` for each white space; no `-` at the ends."""
    x = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", "")
    return F.btrim(F.regexp_replace(x, r"\s", "-"), F.lit("-"))


def heading_text(line: Column) -> Column:
    """Text and code of a heading: labels instead of links and images, no emphasis marks."""
    x = _where(line, lambda t: t.contains("]("), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(x, r"[*_~`]", ""))


def headings(content: Column) -> Column:
    """array<struct<level, text, slug>> in the order of the text; headings without text are left out.

    Setext headings count as levels 1 and 2; code blocks are skipped.
    """
    x = without_blocks(content)
    x = _where(x, lambda t: t.rlike(r"\n {0,3}="), r"(?m)^ {0,3}([^\s#>`~=-][^\n]*)\n {0,3}=+[ \t]*$", "# $1")
    x = _where(x, lambda t: t.rlike(r"\n {0,3}-"), r"(?m)^ {0,3}([^\s#>`~=|-][^\n]*)\n {0,3}-+[ \t]*$", "## $1")
    found = F.regexp_extract_all(x, F.lit(_HEADING), F.lit(0))
    opened = lambda h: _where(F.regexp_replace(h, _MARKS, ""), lambda t: t.endswith("#") | t.endswith(" ") | t.endswith("\t"), _CLOSED)
    made = F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, _MARKS, 1)).alias("level"), heading_text(opened(h)).alias("text")))
    made = F.filter(made, lambda h: h["text"] != "")
    return F.transform(made, lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), slugify(h["text"]).alias("slug")))


def anchors(content: Column) -> Column:
    """Slugs of all headings, in order, with duplicates."""
    return F.transform(headings(content), lambda h: h["slug"])


def anchor_set(content: Column) -> Column:
    return F.array_distinct(anchors(content))


def anchor_index(slugs: Column, anchor: Column) -> Column:
    """0-based place of the first heading with the anchor, in any case; NULL without one."""
    at = F.array_position(F.transform(slugs, lambda s: F.lower(s)), F.lower(anchor))
    return F.when(at > 0, (at - 1).cast("int"))


def anchor_places(slugs: Column) -> Column:
    """array<struct<key, at, slug>>: the first place of every anchor, in any case, by one sort of a document's slugs."""
    keyed = F.sort_array(F.transform(slugs, lambda s, i: F.struct(F.lower(s).alias("key"), i.alias("at"), s.alias("slug"))))
    return let(keyed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["key"] != x["key"])))


def anchor_at(slugs: Column, index: Column) -> Column:
    """The slug at a 0-based place; an error outside the list."""
    return F.element_at(slugs, index + 1)
