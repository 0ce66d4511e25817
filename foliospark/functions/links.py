"""Links of Markdown documents: parsing destinations, finding and rewriting them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import MARK, escaped, let, unescaped
from .markdown import without_code

_EXTERNAL = r"^(?:https?://|mailto:|tel:|ftp://|//)"
#: What follows a label: a destination, in angle brackets or with balanced ones of its own, and a title.
_AFTER_LABEL = r"""\]\([ \t]*(<[^>\n]*>|[^()\s<][^()\s]*(?:\([^()\s]*+\)[^()\s]*+)*+)(?:\s+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*\)"""
#: A link in angle brackets: an address with a scheme, or of mail.
_AUTO = r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_{|}~-]+@[A-Za-z0-9.-]+)>"
#: A line that defines what a label refers to.
_DEFINED = r"(?m)^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\n?[ \t]*(<[^>\n]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^)\n]*\)))?[ \t]*$"
#: The plain form, which takes all up to the bracket for the destination.
_SIMPLE = r"!?\[[^\]]*\]\(([^)]+)\)"


def is_external(destination: Column) -> Column:
    return F.lower(destination).rlike(_EXTERNAL)


def link_path(destination: Column) -> Column:
    """What stands before the first `#`; NULL for external and anchor-only links."""
    return F.when(~is_external(destination) & ~destination.startswith("#"), F.substring_index(destination, "#", 1))


def link_anchor(destination: Column) -> Column:
    """What stands behind the first `#` ('' in `x.md#`); NULL without one or for external links."""
    at = F.instr(destination, "#")
    return F.when(~is_external(destination) & (at > 0), F.substr(destination, at + 1))


def parse_link(destination: Column) -> Column:
    """struct(destination, path, anchor, is_external, is_absolute)."""
    external = is_external(destination)
    return F.struct(
        destination.alias("destination"),
        link_path(destination).alias("path"),
        link_anchor(destination).alias("anchor"),
        external.alias("is_external"),
        (~external & destination.startswith("/")).alias("is_absolute"),
    )


def is_anchor_only(destination: Column) -> Column:
    return ~is_external(destination) & destination.startswith("#")


def should_validate(destination: Column) -> Column:
    return ~is_external(destination) & (destination != "")


def url_decode(x: Column) -> Column:
    """Form decoding (`+` is a space); what can't be decoded stays as it is."""
    return let(x, lambda v: F.when(v.contains("%") | v.contains("+"), F.coalesce(F.try_url_decode(v), v)).otherwise(v))


def normalize_anchor(anchor: Column) -> Column:
    return F.lower(url_decode(anchor))


def with_references(content: Column) -> Column:
    """The text with inline links for those by reference (`[text][label]`, `[label][]`, `[label]`), without the definitions.

    Labels are compared without regard to case; the first definition of a label counts. A text without
    definitions stays as it is.
    """

    def inline(text: Column, d: Column) -> Column:
        label = F.regexp_replace(F.regexp_extract(d, _DEFINED, 1), r"([\\\[\](){}.*+?^$|])", r"\\$1")
        to = F.concat(F.lit("("), F.regexp_replace(F.regexp_extract(d, _DEFINED, 2), r"([\\$])", r"\\$1"), F.lit(")"))
        full = F.regexp_replace(text, F.concat(F.lit(r"(?i)\[([^\[\]]*)\]\["), label, F.lit(r"\]")), F.concat(F.lit("[$1]"), to))
        return F.regexp_replace(full, F.concat(F.lit(r"(?i)(?<!\])(\["), label, F.lit(r"\])(?:\[\])?(?![\[(:])")), F.concat(F.lit("$1"), to))

    def resolved(text: Column, found: Column) -> Column:
        bare = F.regexp_replace(text, _DEFINED, "")
        return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, bare, inline))

    inlined = lambda t: let(F.regexp_extract_all(t, F.lit(_DEFINED), F.lit(0)), lambda found: resolved(t, found))
    return let(content, lambda t: F.when(t.contains("]:"), inlined(t)).otherwise(t))


def destinations(content: Column, block_aware: bool = True) -> Column:
    """Destinations of all links and images in the order of the text, empty ones left out.

    Links by reference have the destination of their label's definition; an autolink is its own (mail
    addresses with `mailto:`). Code in fences, indented blocks and spans is skipped; titles and angle
    brackets don't belong to a destination. Without block_aware, every plain `[label](destination)`
    counts, wherever it stands.
    """
    if not block_aware:
        return F.regexp_extract_all(content, F.lit(_SIMPLE), F.lit(1))
    found = F.regexp_extract_all(with_references(without_code(content)), F.lit(f"{_AFTER_LABEL}|{_AUTO}"), F.lit(0))

    def one(m: Column) -> Column:
        own = F.regexp_replace(m, "^<|>$", "")
        mail = F.when(own.contains(":") & ~own.rlike("^[^:]*@"), own).otherwise(F.concat(F.lit("mailto:"), own))
        return F.when(m.startswith("]("), F.regexp_replace(F.regexp_extract(m, _AFTER_LABEL, 1), "^<|>$", "")).otherwise(mail)

    return F.filter(F.transform(found, one), lambda d: d != "")


def is_likely_file_path(value: Column) -> Column:
    """A front matter value that may name a file: relative, with a slash or a file extension."""
    return (F.trim(value) != "") & ~is_external(value) & ~value.startswith("/") & (value.contains("/") | value.contains("\\") | value.rlike(r"^.*\.\w+$"))


#: Code blocks and spans, or the beginning of a link or definition up to its destination: where a text can be cut.
_PIECE = (
    r"(?ms)^ {0,3}(```+|~~~+)[^\n]*(?:\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)|\z)"
    r"|(?= {4}|\t)(?:\A|(?<=\n[ \t]{0,80}\n))(?:(?: {4}|\t)[^\n]*+(?:\n|\z))++"
    r"|(?<!`)(`+)(?!`)(?:[^`\n]++|\n(?![ \t]*(?:\n|\z))|(?!\2(?!`))`++)++\2(?!`)"
    r"|\]\([ \t]*(?:<[^>\n]*(?=>)|[^()\s<][^()\s]*+(?:\([^()\s]*+\)[^()\s]*+)*+(?=\s+[\"'(]|[ \t]*\)))"
    r"|^ {0,3}\[[^\[\]\n]+\]:[ \t]*(?:<[^>\n]*(?=>)|[^\s<]\S*+(?=[ \t]*$|[ \t]+[\"'(]))"
)
#: The same for a text that has neither code nor definitions.
_PLAIN_PIECE = r"\]\([ \t]*(?:<[^>\n]*(?=>)|[^()\s<][^()\s]*+(?:\([^()\s]*+\)[^()\s]*+)*+(?=\s+[\"'(]|[ \t]*\)))"
_LEAD = r"^(?:\]\([ \t]*<?| {0,3}\[[^\[\]\n]+\]:[ \t]*<?)"


def link_segments(content: Column) -> Column:
    """array<struct<before, destination>>: the text cut behind each link's or definition's destination.

    Concatenating before and destination (NULL in the last piece and where the piece ends with a code
    block) gives the text back, whatever characters it has, so that destinations can be exchanged by
    position.
    """
    cut = lambda x, piece: F.regexp_replace(x, piece, MARK + "$0" + MARK)
    plain = lambda x: ~(x.contains("`") | x.contains("~~~") | x.contains("    ") | x.contains("\t") | x.contains("]:"))
    marked = let(escaped(content), lambda x: F.when(plain(x), cut(x, _PLAIN_PIECE)).otherwise(cut(x, _PIECE)))
    # odd pieces are matches, even ones the text between them
    pairs = let(
        F.split(marked, MARK),
        lambda parts: F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)),
            lambda i: F.struct(F.get(parts, i).alias("text"), F.get(parts, i + 1).alias("hit")),
        ),
    )
    is_link = lambda hit: hit.rlike(_LEAD)
    return F.transform(
        pairs,
        lambda p: F.struct(
            unescaped(F.concat(p["text"], F.when(p["hit"].isNull(), F.lit("")).when(is_link(p["hit"]), F.regexp_extract(p["hit"], _LEAD, 0)).otherwise(p["hit"]))).alias("before"),
            F.when(is_link(p["hit"]), unescaped(F.regexp_replace(p["hit"], _LEAD, ""))).alias("destination"),
        ),
    )
