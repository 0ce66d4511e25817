"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import fields as FF
from foliospark.functions import frontmatter as FM
from foliospark.functions import links as L
from foliospark.functions import markdown as M
from foliospark.functions import paths as P
from foliospark.functions import texts as T


def apply(spark, f, *rows):
    """Values of a function of string columns for rows of arguments."""
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r.v for r in df.select("i", f(*[F.col(f"c{k}") for k in range(n)]).alias("v")).orderBy("i").collect()]


def test_slugs(spark):
    cases = {"Hello World": "hello-world", "No! Special? Chars.": "no-special-chars", "Multiple   Spaces": "multiple---spaces", "Open / remap ports": "open--remap-ports", "Größe und Länge": "größe-und-länge", "Żółć": "żółć", "- x -": "x", "": "", None: None}
    assert apply(spark, M.slugify, *[(c,) for c in cases]) == list(cases.values())
    again = [s for s in cases.values() if s]
    assert apply(spark, M.slugify, *[(s,) for s in again]) == again


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "../x": "../x", "a/../../b": "../b", "/a/../../b": "/b", "a//b/": "a/b", "": "", ".": "", "/": "/"}
    got = apply(spark, P.normalize, *[(c,) for c in cases])
    assert got == list(cases.values())
    assert apply(spark, P.normalize, *[(g,) for g in got]) == got
    assert apply(spark, P.relativize, ("a/b", "a/c/d.png"), ("a", "a"), ("", "x/y"), ("/r/a/b", "/r/s.png"), (None, "x")) == ["../c/d.png", "", "x/y", "../../s.png", None]
    assert apply(spark, lambda f, p: P.resolve_link(f, p, "/root"), ("d/a.md", "../x.md"), ("d/a.md", "/abs/x.md"), ("a.md", "y.md")) == ["x.md", "/root/abs/x.md", "y.md"]
    assert apply(spark, P.parent, ("a/b.md",), ("b.md",), ("/b.md",)) == ["a", "", "/"]
    assert apply(spark, P.ancestors, ("a/b/c.md",), ("/a/c.md",), ("c.md",)) == [["a", "a/b"], ["/a"], []]
    assert apply(spark, lambda p: P.mirror(p, "src", "out"), ("src/a/b.md",), ("srcs/a.md",)) == ["out/a/b.md", None]
    assert apply(spark, lambda p: P.under(p, "src"), ("src/a",), ("srcs/a",), ("src",)) == [True, False, True]
    assert apply(spark, lambda p: P.is_translatable(p, "src", r"(?i).*\.md", [".*/assets/.*"]), ("src/a.MD",), ("src/x/assets/b.md",), ("src/assets/b.md",), ("other/a.md",), ("src/a.txt",)) == [True, False, True, False, False]


def test_links(spark):
    text = 'a [x](a.md "t") ![i](i.png) [o](http://h/p) [m](mailto:a@b) [e]() [n](#s) [q](<a b.md>)\n\n```\n[f](f.md)\n```\n\n    [c](c.md)\n\n`[s](s.md)` [![in](in.png)](out.md) [p](p(1).md)'
    assert apply(spark, L.destinations, (text,), ("",), (None,)) == [["a.md", "i.png", "http://h/p", "mailto:a@b", "#s", "a b.md", "in.png", "out.md", "p(1).md"], [], None]
    assert apply(spark, lambda c: L.destinations(c, False), ("`[s](s.md)` [t](t.md)",)) == [["s.md", "t.md"]]
    got = apply(spark, L.parse_link, ("p.md#a#b",), ("#x",), ("HTTPS://h#x",), ("//h",), ("/abs",), ("x.md#",), ("x.md",))
    assert [(r.path, r.anchor, r.is_external, r.is_absolute) for r in got] == [("p.md", "a#b", False, False), (None, "x", False, False), (None, None, True, False), (None, None, True, False), ("/abs", None, False, True), ("x.md", "", False, False), ("x.md", None, False, False)]
    assert apply(spark, L.url_decode, ("a%20b+c",), ("bad%zz",), ("%C3%A9",)) == ["a b c", "bad%zz", "é"]


@pytest.mark.parametrize("text", ["", "no link", "[a](b)", "x [a](b \"t\") `[c](d)` [e](<f g>) y", "```\n[a](b)\n```\n[c](d)", "~~~\nopen [a](b)", "    [a](b)\n\n    [c](d)\n[e](f)", "[a](b(c)) [d]( e )", "[![i](p.png)](q.md#x)\n"])
def test_segments_give_the_text_back(spark, text):
    (got,) = apply(spark, L.link_segments, (text,))
    assert "".join(s.before + (s.destination or "") for s in got) == text
    (plain,) = apply(spark, L.destinations, (text,))
    assert [s.destination for s in got if s.destination] == plain


def test_headings(spark):
    text = "---\ntitle: t\n---\n# One **two** `x`\n\nText\n====\n\n```\n# no\n```\n\n    # no\n\n## [link](l.md) ##\n### \n#no\nSecond\n---\n###### Six"
    (got,) = apply(spark, M.headings, (text,))
    assert [(h.level, h.text, h.slug) for h in got] == [(1, "One two x", "one-two-x"), (1, "Text", "text"), (2, "link", "link"), (2, "Second", "second"), (6, "Six", "six")]
    assert apply(spark, lambda c, a: M.anchor_index(M.anchors(c), a), ("# A\n# B\n# A", "a"), ("# A\n# B", "B"), ("# A", "c")) == [0, 1, None]
    assert apply(spark, M.anchor_set, ("# S\n# S\n# S",)) == [["s"]]


def test_front_matter(spark):
    text = "---\ntitle: 'It''s: x'\ntags:\n  - a\n  - \"b c\"\nnote: |\n  one\n\n  two\ndate: 16.05.2025\nempty:\nlist: [x, 'y z']\n# comment\nyes: 'yes'\ntitle2: a # b\n---\n\nBody --- here\n"
    (props,) = apply(spark, FM.parse_properties, (text,))
    assert [(p.key, p["values"]) for p in props] == [("title", ["It's: x"]), ("tags", ["a", "b c"]), ("note", ["one\n\ntwo"]), ("date", ["16.05.2025"]), ("empty", []), ("list", ["x", "y z"]), ("yes", ["yes"]), ("title2", ["a # b"])]
    assert apply(spark, M.body, (text,), ("no front matter",), ("---\nnot closed",)) == ["Body --- here\n", "no front matter", "---\nnot closed"]
    (shown,) = apply(spark, lambda c: FM.serialize_properties(FM.parse_properties(c)), (text,))
    (again,) = apply(spark, FM.parse_properties, (shown,))
    assert [(p.key, p["values"]) for p in again] == [(p.key, p["values"]) for p in props if p["values"]]
    assert apply(spark, lambda c: FM.serialize_properties(FM.parse_properties(c)), ("plain",)) == [""]
    assert apply(spark, lambda c: FM.get_property(FM.parse_properties(c), "date"), (text,), ("x",)) == ["16.05.2025", None]


def test_closed_headings_and_plain_pieces(spark):
    texts = ["# a b ## \n## c#\n# #\n#\t\t\n# d # e #\t\n> - ### f  ###\n#  g h  \n####### no\n# \n# i\\#", "[a](b.md) (x) [c](<d e> \"t\")](f.md", "a [b](c(d).md) `[e](f.md)` [g](h.md)"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.orderBy("i").select(M.headings(F.col("t")).alias("h"), L.link_segments(F.col("t")).alias("s")).collect()
    assert [(h.level, h.text) for h in got[0].h] == [(1, "a b"), (2, "c#"), (1, "#"), (1, "\t"), (1, "d # e"), (3, "f"), (1, "g h"), (1, "i\\#")]
    assert ["".join(x.before + (x.destination or "") for x in r.s) for r in got] == texts
    assert [[x.destination for x in r.s if x.destination] for r in got] == [[], ["b.md", "d e", "f.md"][:2], ["c(d).md", "h.md"]]


def test_a_value_is_computed_once(spark):
    plan = lambda c: spark.range(1).select(F.concat(F.lit("a"), "id").alias("x")).select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    once = F.regexp_replace("x", "QQ", "")
    for c in (P.resolve(P.parent(F.col("x")), once), P.mirror(once, "a", "b"), P.relativize(once, F.col("x")), FM.serialize_properties(FM.parse_properties(once)), L.destinations(once), L.url_decode(once)):
        assert plan(c).count("QQ") == 1


def test_set_keeps_places(spark):
    change = lambda c: FM.serialize_properties(FM.set_property(FM.set_property(FM.parse_properties(c), "b", F.array(F.lit("2"))), "new", F.array(F.lit("n"))))
    assert apply(spark, change, ("---\na: x\nb: y\nc: z\n---\n",)) == ["---\na: x\nb: '2'\nc: z\nnew: n\n---\n"]


def test_quotes(spark):
    cases = {"": "''", "plain": "plain", "a: b": "'a: b'", "it's": "'it''s'", "- x": "'- x'", "9": "'9'", "True": "'True'", "no": "'no'", "a-b": "a-b", "@x": "'@x'", "`x": "'`x'", "x#y": "'x#y'", "null": "'null'"}
    assert apply(spark, FM.quote, *[(c,) for c in cases]) == list(cases.values())


def test_field_blocks(spark):
    expected = F.array(F.struct(F.lit("title").alias("key"), F.lit("x").alias("value")), F.struct(F.lit("perex").alias("key"), F.lit("y").alias("value")))
    response = FF.HEADER + "\n\n[[title]]\nTitel\nzwei\n[[/title]]\n\n[[odd]]\nz\n[[/odd]]\n\n[[perex]]\n\n[[/perex]]\n\n\n\n\n# Body\n"
    (got,) = apply(spark, lambda c: FF.parse_fields(c, expected), (response,))
    assert [(f.key, f.value) for f in got.fields] == [("title", "Titel\nzwei")] and got.missing == ["perex"]
    assert apply(spark, lambda c: FF.strip_fields(c, expected), (response,)) == ["# Body"]
    assert apply(spark, lambda c: FF.strip_fields(c, F.array().cast(FF.FIELDS)), (" as it is ",)) == [" as it is "]
    assert apply(spark, lambda c: FF.format_fields(FF.extract_fields(FM.parse_properties(c), ["b", "a", "none"])), ("---\na: 1\nb: 2\n---\n",), ("x",)) == [FF.HEADER + "\n\n[[b]]\n2\n[[/b]]\n\n[[a]]\n1\n[[/a]]\n\n", ""]
    assert apply(spark, lambda c: FF.combine(FF.extract_fields(FM.parse_properties(c), ["a"]), F.lit("body\n")), ("---\na: 1\n---\n",)) == ["[[a]]\n1\n[[/a]]\n\nbody"]


def test_small_texts(spark):
    assert apply(spark, T.mask_secret, ("secret-token",), ("abcd",), (None,), ("",)) == ["****oken", "****", "****", "****"]
    assert apply(spark, T.short_hash, ("0123456789",), ("abc",)) == ["0123456", "abc"]
    assert apply(spark, lambda c: T.truncate(c, 3), ("abcd",), ("abc",)) == ["abc...", "abc"]
    assert apply(spark, lambda a: T.interpolate(F.lit("{{a}} {{b}} {{a}}{{}}"), {"a": a}), ("{{b}}",), ("",)) == ["{{b}} {{b}} {{b}}{{}}", " {{b}} {{}}"]
    assert apply(spark, lambda m: T.elapsed(m.cast("long")), ("0",), ("59900",), ("61500",)) == ["0.0s", "59.9s", "1m 1s"]
    assert apply(spark, lambda a, b: T.progress_bar(a.cast("int"), b.cast("int")), ("1", "4"), ("4", "4"), ("0", "3")) == ["[=====               ]  25%", "[" + "=" * 20 + "] 100%", "[" + " " * 20 + "]   0%"]
    assert apply(spark, T.lines, ("a\r\nb\rc\n",), ("",), ("\n",), ("a\n\n",), ("x",)) == [["a", "b", "c"], [], [""], ["a", ""], ["x"]]
    assert apply(spark, T.language_name, ("de",), ("en-US",), ("xx",)) == ["German", "English", "xx"]


def test_markdown_of_any_length_and_any_characters(spark):
    long_block = "    line\n" * 100_000
    docs = {
        "indented": (long_block + "\n[a](b.md)", ["b.md"]),
        "brackets": ("[x](a" + "(b)" * 10_000 + ".md) end", ["a" + "(b)" * 10_000 + ".md"]),
        "marks": ("a\x01b [x](y.md) c\x02a\x02b\x01", ["y.md"]),
        "stray": ("a ` b\n\n[x](missing.md)\n\nc ` d", ["missing.md"]),
        "spans": ("`[no](x.md)` ``a ` b`` [y](z.md)", ["z.md"]),
        "references": ("[x][r] and [r] and [R][]\n\n[r]: missing.md 'title'\n[q]: <a b.md>\n", ["missing.md"] * 3),
        "odd labels": ("[$1](x$1.md) [q][w.*]\n\n[w.*]: d$e.md\n", ["x$1.md", "d$e.md"]),
        "autolinks": ("<https://a.b/c> <x@y.z> <b> <mailto:q@r>", ["https://a.b/c", "mailto:x@y.z", "mailto:q@r"]),
        "fence": ("```\n" + "[x](y.md)\n" * 20_000 + "```\n[k](l.md)", ["l.md"]),
    }
    df = spark.createDataFrame([(k, d) for k, (d, _) in docs.items()], "k string, d string")
    for r in df.select("k", "d", L.destinations(F.col("d")).alias("x"), L.link_segments(F.col("d")).alias("s")).collect():
        assert r.x == docs[r.k][1], r.k
        assert "".join(p.before + (p.destination or "") for p in r.s) == r.d, r.k
    got = spark.createDataFrame([("> # Title\n\n- ## In list\n  > ### Deep #\n1. # One\n",), (long_block + "# After\n",)], "d string").select(M.headings(F.col("d")).alias("h")).collect()
    assert [(h.level, h.text) for h in got[0].h] == [(1, "Title"), (2, "In list"), (3, "Deep"), (1, "One")] and [h.text for h in got[1].h] == ["After"]
    text = spark.createDataFrame([("a\x01{{n}}\x02a{{m}}",)], "t string").select(T.interpolate(F.col("t"), {"n": F.lit("{{m}}")}).alias("x")).first().x
    assert text == "a\x01{{m}}\x02a{{m}}"
