"""Path algebra on `/`-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _strings() -> Column:
    return F.array().cast("array<string>")


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def segments(path: Column) -> Column:
    """The names of a path once `.` and `..` are folded; leading `..` of a relative path stay."""
    return let(path, _segments)


def _segments(path: Column) -> Column:
    absolute = path.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        back = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(s.isin("", "."), acc)
            .when((s == "..") & back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((s == "..") & absolute, acc)
            .otherwise(F.array_append(acc, s))
        )

    return F.aggregate(F.split(path, "/"), _strings(), step)


def normalize(path: Column) -> Column:
    """The path without `.`, `..` (where it has something to go up from) and repeated slashes."""
    folded = lambda p: F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(_segments(p), "/"))
    return let(path, lambda p: F.when(p.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), folded(p)).otherwise(p))


def parent(path: Column) -> Column:
    """The directory of a file: its path up to the last slash, '' without one."""
    return let(path, lambda p: F.when(p.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(p, "/?[^/]*$", "")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolve(directory: Column, path: Column) -> Column:
    """A path seen from a directory, normalised; an absolute path is its own."""
    joined = lambda d, p: F.when(p.startswith("/"), p).when(d == "", p).otherwise(F.concat(d, F.lit("/"), p))
    return normalize(let(F.struct(directory.alias("d"), path.alias("p")), lambda x: joined(x["d"], x["p"])))


def resolve_link(file: Column, path: Column, root: Column | str = "") -> Column:
    """Target of a link: an absolute one from the root of the repository, another from the file's directory."""
    root = _text(root)
    return let(path, lambda p: F.when(p.startswith("/"), normalize(F.concat(root, p))).otherwise(resolve(parent(file), p)))


def relativize(directory: Column, path: Column) -> Column:
    """The way from a directory to a path: `..` for each name that they don't share, then the rest."""
    both = lambda x: F.struct(_segments(x["d"]).alias("a"), _segments(x["p"]).alias("b"))

    def way(x: Column) -> Column:
        a, b = x["a"], x["b"]
        upto = F.least(F.size(a), F.size(b))
        # the first place at which they differ ends the common part
        common = F.aggregate(
            F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0),
            lambda n, k: F.when((n == k) & (F.get(a, k) == F.get(b, k)), n + 1).otherwise(n),
        )
        ups = let(common, lambda c: F.concat(F.array_repeat(F.lit(".."), F.size(a) - c), F.slice(b, c + 1, F.greatest(F.size(b) - c, F.lit(0)))))
        return F.array_join(ups, "/")

    return let(F.struct(directory.alias("d"), path.alias("p")), lambda x: F.when(x["d"].isNotNull() & x["p"].isNotNull(), let(both(x), way)))


def under(path: Column, root: Column | str) -> Column:
    """Whether a normalised path lies in a directory (by names, not by characters)."""
    root = _text(root)
    return (root == "") | (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def relative_to(path: Column, root: Column | str) -> Column:
    """The rest of a path below a root that it lies in; NULL elsewhere."""
    root = _text(root)
    cut = F.regexp_replace(root, "/$", "")
    return F.when(root == "", path).when(path.startswith(F.concat(cut, F.lit("/"))), F.substr(path, F.length(cut) + 2))


def mirror(path: Column, source_root: Column | str, target_root: Column | str) -> Column:
    """The same relative path below the other root; NULL for a path outside the source root."""
    target = _text(target_root)
    rest = let(path, lambda p: relative_to(p, source_root))
    return let(rest, lambda r: F.when(target == "", r).otherwise(normalize(F.concat(target, F.lit("/"), r))))


def ancestors(path: Column) -> Column:
    """The directories above a file, outermost first: 'a', 'a/b' for 'a/b/c.md' ('/' leads absolute ones)."""
    lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    made = let(
        F.split(F.regexp_replace(parent(path), "^/", ""), "/"),
        lambda names: F.transform(names, lambda _, i: F.concat(lead, F.array_join(F.slice(names, F.lit(1), i + 1), "/"))),
    )
    return F.when(parent(path).isin("", "/"), _strings()).otherwise(made)


def is_translatable(path: Column, source_root: Column | str, include: str, exclusions: list[str]) -> Column:
    """Whether a document belongs to the corpus: below the root, its name fully matches, no exclusion does.

    Exclusions are held against the path below the root.
    """

    def belongs(p: Column) -> Column:
        ok = under(p, source_root) & file_name(p).rlike(full(include))
        for x in exclusions:
            ok &= ~relative_to(p, source_root).rlike(full(x))
        return F.coalesce(ok, F.lit(False))

    return let(path, belongs)


def full(regex: str) -> str:
    """A regular expression that has to match the whole text."""
    return f"^(?:{regex})$"
