"""Operators over small corpora."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from foliospark.operators import diffs as D
from foliospark.operators import history as H
from foliospark.operators import integrity as I
from foliospark.operators import mirror as R
from foliospark.operators import report
from foliospark.operators import scan as S
from foliospark.operators import split as C
from foliospark.operators import translate as X
from foliospark.plans import actions as A
from foliospark.plans import catalog
from foliospark.sources import files as SF
from foliospark.sources import git as G
from foliospark.sources import templates
from foliospark.streaming import incremental


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


DOC = "path string, content string"


# reports


def test_progress_is_numbered_in_ranges(spark):
    rows = spark.range(5_000).selectExpr("if(id = 7, null, (id * 7919) % 5000 - 100) k", "id % 3 g")
    got = report.progress(rows, ["g", "k"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(range#") == 1
    first = sorted(((r.g, (r.k is not None, r.k or 0)), r.completed, r.total) for r in got.collect())
    assert [c for _, c, _ in first] == list(range(1, 5_001)) and {t for _, _, t in first} == {5_000}
    assert report.progress(rows.where("k = -1000"), ["k"]).count() == 0
    same = report.progress(spark.range(50).selectExpr("1 k"), ["k"]).collect()
    assert sorted(r.completed for r in same) == list(range(1, 51))


# scans


def test_scan_and_exclusions(spark):
    files = table(spark, "path string", *[(p,) for p in ["a/one.md", "a/two.txt", "b/sub/three.MD", "z.md", "b/assets/x.md", "b/_d.md", "b/assets2/y.md"]])
    got = lambda *x: sorted(r.path for r in S.select_files(files, exclusions=list(x)).collect())
    assert got() == ["a/one.md", "b/_d.md", "b/assets/x.md", "b/assets2/y.md", "b/sub/three.MD", "z.md"]
    assert got(".*/assets/.*", r".*/_.*\.md") == ["a/one.md", "b/assets2/y.md", "b/sub/three.MD", "z.md"]
    assert got("b/assets/") == [p for p in got() if p != "b/assets/x.md"]
    assert got("b", "  ") == ["a/one.md", "z.md"]


def test_instructions(spark):
    files = table(spark, "path string", ("r.md",), ("a/x.md",), ("a/b/y.md",), ("c/z.md",))
    notes = table(spark, "dir string, kind string, content string", ("", "normal", "ROOT \n"), ("a", "normal", "A"), ("a/b", "replace", "REPL"), ("a/b", "normal", "B"), ("c", "normal", "  "))
    got = {r.path: r.instructions for r in S.instructions_of(files, notes).collect()}
    assert got == {"r.md": "ROOT", "a/x.md": "ROOT\n\nA", "a/b/y.md": "REPL\n\nB", "c/z.md": "ROOT"}
    below = {r.path: r.instructions for r in S.instructions_of(files, notes, "a").collect()}
    assert below == {"r.md": None, "a/x.md": "A", "a/b/y.md": "REPL\n\nB", "c/z.md": None}


# integrity


def test_link_errors(spark):
    docs = table(
        spark, DOC,
        ("d/a.md", "# Top\n[ok](b.md#sec) [me](#TOP) [gone](c.md) [no](b.md#none) [dir](../d) [img](../i%20m.png) [ext](http://x/y) [abs](/d/b.md) [mis](#lost) [e](b.md#)"),
        ("d/b.md", "# Sec"),
    )
    found = I.link_errors(docs, table(spark, "path string", ("i m.png",)), "").collect()
    assert {(r.destination, r.type) for r in found} == {("c.md", I.FILE_NOT_FOUND), ("b.md#none", I.ANCHOR_NOT_FOUND), ("/d/b.md", I.FILE_NOT_FOUND), ("#lost", I.ANCHOR_NOT_FOUND), ("b.md#", I.ANCHOR_NOT_FOUND)}
    rooted = I.link_errors(docs.withColumn("path", F.concat(F.lit("/r/"), "path")), table(spark, "path string", ("/r/i m.png",)), "/r").collect()
    assert "/d/b.md" not in {r.destination for r in rooted}


# splitting


def _reference_chunks(text, target):
    """The splitter, one step after the other, over byte offsets."""
    import re

    least, most = int(target * 0.8), int(target * 1.2)
    size = lambda a, b: len(text[a:b].encode())
    heads = [(m.start(), len(m[1])) for m in re.finditer(r"(?m)^(#{1,6})\s+(.+)$", text, re.ASCII)]
    if size(0, len(text)) <= target or not heads:
        return [0]
    cuts, s = [0], 0
    if heads[0][0] > 0 and size(0, heads[0][0]) > least:
        s = heads[0][0]
        cuts.append(s)
    while size(s, len(text)) > most:
        later = [(p, lv) for p, lv in heads if p > s]
        fit = [(lv, p) for p, lv in later if least <= size(s, p) <= most]
        beyond = [p for p, lv in later if size(s, p) > most]
        if fit:
            s = min(fit)[1]
        elif beyond:
            s = beyond[0]
        else:
            break
        cuts.append(s)
    return cuts


def test_chunks(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        parts = [("#" * rng.randint(1, 7) + " " + rng.choice(["Überschrift", "h", "long heading"]) + "\n") if rng.random() < 0.5 else rng.choice(["text ", "ž", "\n", "日本 "]) * rng.randint(1, 30) + "\n" for _ in range(rng.randint(0, 14))]
        texts.append("".join(parts))
    rows = C.chunk_rows(table(spark, DOC, *[(str(i), t) for i, t in enumerate(texts)]), 100).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.path == str(i)), key=lambda r: r["index"])
        assert "".join(r.content for r in own) == t
        assert [r["index"] for r in own] == list(range(len(own)))
        assert [r.start for r in own] == _reference_chunks(t, 100), t
        assert all(a.end == b.start for a, b in zip(own, own[1:], strict=False)) and own[-1].end == len(t)
    assert C.chunk_bounds(100) == (80, 120) and C.chunk_bounds() == (26214, 39321)


def test_joined_chunks(spark):
    rows = table(spark, "path string, index int, content string", ("a", 1, "two"), ("a", 0, "one\n"), ("a", 2, "three"), ("b", 0, ""))
    assert {r.path: r.content for r in C.joined_chunks(rows).collect()} == {"a": "one\ntwo\n\nthree", "b": ""}


# diffs


def test_diffs_round_trip():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n"]) for _ in range(2))
        hunks = D.parse_diff(D.make_diff(a, b, rng.randint(0, 3)))
        assert D.check_diff(a, hunks) == []
        assert D.split_lines(D.apply_diff(a, hunks)) == D.split_lines(b)


def test_diff_rules():
    assert D.parse_diff("  \n") == []
    assert D.apply_diff("a\nb\n", D.parse_diff("@@ -0,0 +1,2 @@\n+x\n+y\n")) == "x\ny\na\nb\n"
    assert D.apply_diff("a\nb\nc", D.parse_diff("@@ -2,0 +3 @@\n+x")) == "a\nb\nx\nc"
    # net growth of a hunk doesn't move the next one; a removed line may look like a file header
    assert D.apply_diff("a\nb\nc\nd\n", D.parse_diff("--- a\n+++ b\n@@ -1 +1,2 @@\n-a\n+A\n+AA\n@@ -4 +5 @@\n-d\n+D\n")) == "A\nAA\nb\nc\nD\n"
    assert D.apply_diff("---\nx\n", D.parse_diff("@@ -1,2 +1 @@\n----\n x\n\\ No newline at end of file")) == "x\n"
    h = D.parse_diff("@@ -2 +2 @@\n-nope\n+y\n")
    assert h[0]["old_count"] == 1 and D.check_diff("a\nb\n", h) == [{"hunk": 0, "line": 2, "expected": "nope", "actual": "b"}]
    assert D.check_diff("a\n", D.parse_diff("@@ -5 +5 @@\n-z\n+y\n"))[0]["actual"] == "<EOF>"
    for bad in ("garbage", "@@ -1,2 +1,2 @@\n a\n", "@@ -1 +1 @@\nxyz"):
        with pytest.raises(D.DiffError):
            D.parse_diff(bad)
    with pytest.raises(D.DiffError):
        D.apply_diff("a\nb\n", h)


def test_diff_columns(spark):
    rows = table(spark, "path string, text string, diff string", ("ok", "a\nb\n", "@@ -1,2 +1,2 @@\n-a\n+x\n b\n"), ("bad", "a\n", "junk"), ("off", "a\n", "@@ -1 +1 @@\n-z\n+y\n"), ("nul", None, None))
    got = {r.path: r for r in rows.select("path", D.parsed_diff(F.col("diff")).alias("p"), D.applied_diff(F.col("text"), F.col("diff")).alias("a")).collect()}
    assert got["ok"].a.text == "x\nb\n" and got["bad"].p.hunks is None and "line 1" in got["bad"].p.error and got["off"].a.error and got["nul"].a.text is None
    parsed = rows.where("path in ('ok', 'off')").select("path", "text", D.parsed_diff(F.col("diff"))["hunks"].alias("hunks"))
    assert [(r.path, r.line, r.expected, r.actual) for r in D.mismatches(parsed).collect()] == [("off", 1, "z", "a")]
    (text,) = parsed.where("path = 'ok'").select(D.serialize_hunks(F.col("hunks"))).first()
    assert text == "@@ -1,2 +1,2 @@\n-a\n+x\n b\n"


def test_diffs_take_few_rows_at_once(spark):
    rows = spark.range(3).selectExpr("concat('a', id) old", "concat('b', id) new")
    diff = D.unified_diff(F.col("old"), F.col("new"))
    for made in (diff, D.parsed_diff(diff), D.applied_diff(F.col("old"), diff)):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_lines_that_differ_in_any_text(spark, tmp_path):
    rows = [(1, "a\nb"), (1, "c\nd\ne\n\n"), (None, "f\ng"), (2, ""), (3, "\n\n"), (4, "h\r\ni"), (5, "j\rk"), (6, None), (7, "\nx"), (8, "not there\nnot there"), (9, "y\x01\n\u2028"), (10, "z\n\u2028")]
    rows = [(i, t, "en", "s") for i, t in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.execute(catalog.ORACLE_SQL["diff_validate"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["diff_validate"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# mirrors


def test_documents_are_read_once_for_each_use(spark):
    docs = table(spark, DOC, ("source/a.md", "# x\n[b](b.md#y)"))
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")
    assert nodes(R.correct_links(docs, docs, docs.select("path"), "source", "mirror")) <= 3
    assert nodes(I.link_errors(docs)) <= 3
    assert nodes(R.translate_anchors(docs.selectExpr("path source_path", "path target_path", "'y' anchor"), docs, docs)) == 0


def _mirror(spark, source, target, files=(), **kw):
    src = table(spark, DOC, *source)
    out = R.correct_links(table(spark, DOC, *target), src, table(spark, "path string", *[(p,) for p, _ in source], *[(f,) for f in files]), "src", "out/es", **kw)
    return {r.path: r for r in out.collect()}


def test_links_of_a_mirror(spark):
    source = [("src/docs/guide.md", "# Setup\n# Use\n"), ("src/docs/other.md", "# First\n# Second\n# Second\n"), ("src/docs/long.md", "# A\n# B\n# C")]
    target = [
        ("out/es/docs/guide.md", "# Configuración\n# Uso\n![l](../images/logo.png) [s](#setup) [o](other.md#second) [p](other.md) [u](#unknown) [x](http://h/#setup) [a](/abs.md#setup)\n```\n[c](../images/c.png)\n```\n[z](z.txt#frag \"t\")\n"),
        ("out/es/docs/other.md", "# Primero\n# Segundo\n# Otro\n"),
        ("out/es/docs/long.md", "# A\n# B\n[bad](#a)"),
    ]
    got = _mirror(spark, source, target)
    g = got["out/es/docs/guide.md"]
    assert g.content == (
        "# Configuración\n# Uso\n![l](../../../src/images/logo.png) [s](#configuración) [o](other.md#segundo) [p](other.md) [u](#unknown) [x](http://h/#setup) [a](/abs.md#setup)\n"
        "```\n[c](../images/c.png)\n```\n[z](../../../src/docs/z.txt#frag \"t\")\n"
    )
    assert (g.asset_corrections, g.anchor_corrections, g.errors, g.writable) == (2, 2, [], True)
    bad = got["out/es/docs/long.md"]
    assert len(bad.errors) == 1 and not bad.writable and "3 headings" in bad.errors[0]
    assert not got["out/es/docs/other.md"].writable


def test_front_matter_of_a_mirror(spark):
    source = [("src/a.md", "# H\n")]
    text = "---\ntitle: See [x](#h)\nimage: images/hero.png\nother: images/none.png\nlist:\n  - images/hero.png\n  - keep\n---\n# Kopf\n"
    got = _mirror(spark, source, [("out/es/a.md", text)], files=["src/images/hero.png"], fields=["title"])["out/es/a.md"]
    assert got.content == "---\ntitle: 'See [x](#kopf)'\nimage: ../../src/images/hero.png\nother: images/none.png\nlist:\n  - ../../src/images/hero.png\n  - keep\n---\n# Kopf\n"
    assert (got.front_matter_corrections, got.anchor_corrections) == (2, 1)


def test_second_run_changes_nothing(spark):
    source = [("src/a.md", "# H\n")]
    files = ["src/i.png"]
    once = _mirror(spark, source, [("out/es/a.md", "![x](i.png)")], files)["out/es/a.md"].content
    again = _mirror(spark, source, [("out/es/a.md", once)], files, already_corrected=True)["out/es/a.md"]
    assert once == "![x](../../src/i.png)" and again.content == once and again.asset_corrections == 0


# history and translation

VERSIONS = "path string, seq long, hash string, content string"


def _history(spark):
    return table(spark, VERSIONS, ("s/a.md", 0, "c0", "old\n"), ("s/a.md", 2, "c2", "new\n"), ("s/b.md", 1, "c1", "b\n"), ("s/c.md", 1, "c1", "c\n"), ("s/e.md", 2, "c2", "e\n"))


def _jobs(spark):
    sources = table(spark, "path string, content string, instructions string", ("s/a.md", "---\ntitle: T\nkeep: k\n---\nnew\n", "be kind"), ("s/b.md", "b\n", None), ("s/c.md", "c\n", None), ("s/d.md", "d", None), ("s/e.md", "e\n", None), ("s/f.md", "f", None))
    translations = table(spark, DOC, ("t/a.md", "---\ntitle: Alt\ncommit: c0\n---\nalt\n"), ("t/b.md", "---\ncommit: c1\n---\nx"), ("t/c.md", "no front matter"), ("t/e.md", "---\ncommit: c0\n---\nx"))
    return H.classify(sources, _history(spark), translations, table(spark, "locale string, target_root string", ("de", "t")), "s", table(spark, "path string", ("s/f.md",)))


def test_classification(spark):
    got = {r.path[2]: (r.type, r.skip_reason, r.warning, r.commit_count, r.original_source) for r in _jobs(spark).collect()}
    assert got == {
        "a": ("UPDATE", None, None, 1, "old\n"), "b": ("SKIP", "up_to_date", None, None, None), "c": ("NEW", None, "no commit field", None, None),
        "d": ("SKIP", "untracked", None, None, None), "e": ("NEW", None, "original unavailable", None, None), "f": ("SKIP", "uncommitted", None, None, None),
    }
    assert [r.path for r in H.limit_jobs(_jobs(spark), 2).orderBy("path").collect()] == ["s/a.md", "s/c.md"]
    assert H.job_counts(_jobs(spark)).first().asDict() == {"locale": "de", "new": 2, "updated": 1, "skipped": 1, "errors": 2}


class Scripted:
    """Answers by what is asked; counts two tokens in and one out."""

    def __init__(self, *diffs, fail=None, permanent=False):
        self.diffs, self.fail, self.permanent = list(diffs), fail, permanent

    def __call__(self, system, user, locale):
        if self.permanent:
            raise X.Permanent("refused")
        if self.fail and self.fail in user:
            raise RuntimeError("broken")
        if "[[title]]" in user:
            return X.Answer("[[title]]\nTitel\n[[/title]]", 2, 1)
        if user.startswith(("Original:", "The answer below")):
            return X.Answer(self.diffs.pop(0), 2, 1)
        return X.Answer(user.upper(), 2, 1)


def _run(spark, model):
    done = X.translate(_jobs(spark), model, ["title"], parallelism=1).persist()
    return done, {r.path[2]: r for r in done.collect()}


def test_translation(spark):
    done, got = _run(spark, Scripted("@@ -1 +1 @@\n-alt\n+neu\n"))
    assert (got["a"].body, got["a"].success, got["a"].input_tokens) == ("neu\n", True, 4)
    assert got["c"].body == "C\n" and set(got) == {"a", "c", "e"}
    docs = {r.path: r.content for r in X.assemble(done, _jobs(spark)).collect()}
    # the title is new against the old source, so the new translation counts
    assert docs["t/a.md"] == "---\ntitle: Titel\nkeep: k\ncommit: c2\n---\nneu\n"
    row = X.summary(done, _jobs(spark).where("type = 'SKIP'")).first()
    assert (row.success, row.failed, row.skipped, row.input_tokens, row.all_successful) == (3, 0, 3, 8, True)
    assert sorted(r.target_path for r in X.successful_targets(done).collect()) == ["t/a.md", "t/c.md", "t/e.md"]


def test_second_attempt_and_failures(spark):
    _, got = _run(spark, Scripted("junk", "@@ -1 +1 @@\n-alt\n+neu\n"))
    assert got["a"].body == "neu\n" and got["a"].input_tokens == 6
    _, got = _run(spark, Scripted(""))
    assert got["a"].body == "alt\n"
    done, got = _run(spark, Scripted("junk", "junk"))
    assert not got["a"].success and got["a"].error.startswith("[BODY_DIFF]") and (got["a"].input_tokens, got["a"].attempted_input_tokens) == (0, 6)
    assert X.summary(done).first().has_failures
    _, got = _run(spark, Scripted("", fail="c\n"))
    assert got["c"].error == "[BODY] broken" and got["e"].success
    done, got = _run(spark, Scripted(permanent=True))
    assert all(r.error.startswith("[PERMANENT]") for r in got.values())
    assert X.first_permanent_failure(done).count() == 1


def test_missing_fields_leave_the_body_alone(spark):
    class NoFields(Scripted):
        def __call__(self, system, user, locale):
            return X.Answer("nothing", 1, 1) if "[[title]]" in user else super().__call__(system, user, locale)

    _, got = _run(spark, NoFields())
    assert got["a"].error.startswith("[FRONT_MATTER] no translation of title") and got["a"].attempted_input_tokens == 1


def test_long_documents_go_chunk_by_chunk(spark):
    text = "".join(f"# H{i}\n" + "word " * 20 + "\n" for i in range(6))
    jobs = table(spark, "locale string, path string, target_path string, type string, source string, instructions string, current_commit string, existing string, original_source string", ("de", "a", "b", "NEW", text, None, "c", None, None))
    (r,) = X.translate(jobs, X.UpperCase(), [], target_bytes=120).collect()
    assert r.body == text.upper() and r.success


def test_free_texts(spark):
    rows = table(spark, "id int, text string, locale string", (1, "hello", "de"), (2, None, "de"), (3, "bad", "fr"), (4, " ", "fr"))
    got = {r.id: (r.translated, r.error) for r in X.translate_texts(rows, Scripted(fail="bad"), instructions=" Be kind. ").collect()}
    assert got == {1: ("BE KIND.\n\nTRANSLATE INTO GERMAN:\n\nHELLO", None), 2: (None, None), 3: (None, "broken"), 4: (" ", None)}


def test_models_and_templates():
    seen = {}
    m = X.model_for(" OpenAI ", "http://h/v1/", "", "m", lambda r: seen.update(r) or X.Answer("x"))
    assert m("s", "u", "de").text == "x" and (seen["url"], seen["token"], seen["temperature"], seen["timeout"]) == ("http://h/v1", "none", 0.3, 300)
    for bad in (("other", "http://h", "t"), ("openai", "", "t"), ("anthropic", "http://h", " ")):
        with pytest.raises(ValueError):
            X.model_for(*bad, "m", lambda r: X.Answer(""))
    assert templates.fill("{{a}} {{b}}", {"a": "{{b}}"}) == "{{b}} {{b}}"
    with pytest.raises(KeyError):
        templates.template("none")


def test_summaries_add_up(spark):
    rows = table(spark, "success long, failed long, skipped long, input_tokens long, output_tokens long, attempted_input_tokens long, attempted_output_tokens long", (1, 0, 2, 1 << 40, 5, 1, 1), (2, 1, 0, 1, 1, 1, 1))
    got = X.merge_summaries(rows).first()
    assert (got.success, got.failed, got.skipped, got.input_tokens, got.has_failures) == (3, 1, 2, (1 << 40) + 1, True)
    assert X.merge_summaries(rows.where("false")).first().success == 0


# sources, actions, streaming


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "r"
    (root / "en" / "sub").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("config", "user.email", "a@b")
    git("config", "user.name", "n")
    (root / "en" / "a.md").write_text("---\ntitle: hello\n---\n# One\n\n[b](sub/b.md#two) ![i](i.png)\n")
    (root / "en" / "sub" / "b.md").write_text("# Two\n\n[gone](c.md)\n")
    (root / "en" / "i.png").write_bytes(b"\x89PNG")
    (root / "en" / ".instructions").write_text("Be kind.\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (root / "en" / "a.md").write_text("---\ntitle: hello\n---\n# One\n\nmore\n\n[b](sub/b.md#two) ![i](i.png)\n")
    git("commit", "-qam", "two")
    (root / "en" / "new.md").write_text("# New\n")
    return root


def test_history_of_a_repository(spark, repository):
    v = G.read_versions(spark, str(repository))
    assert [(os.path.basename(r.path), r.seq) for r in v.where("path like '%.md'").orderBy("path", "seq").collect()] == [("a.md", 0), ("a.md", 1), ("b.md", 0)]
    assert "more" in v.where("path like '%/a.md' and seq = 1").first().content
    assert [os.path.basename(r.path) for r in G.read_state(spark, str(repository)).collect()] == ["new.md"]
    assert G.find_root(str(repository / "en" / "sub")) == os.path.realpath(repository)
    assert G.relative(str(repository / "en"), str(repository)) == "en"
    with pytest.raises(ValueError):
        G.relative("/", str(repository))
    with pytest.raises(FileNotFoundError):
        SF.checked_root(str(repository / "none"))
    with pytest.raises(NotADirectoryError):
        SF.checked_root(str(repository / "en" / "a.md"))


def test_actions(spark, repository):
    spark.sparkContext.setCheckpointDir(str(repository.parent / "cp"))
    c = A.Config(str(repository / "en"), [("de", str(repository / "de"))], fields=["title"], parallelism=2, token="abcdefgh")
    assert dict(A.show_config(c))["token"] == "****efgh"
    git, links, totals = A.check(spark, c)
    t = totals.first()
    assert (t.files, t.git_errors, t.link_errors, t.success) == (3, 1, 1, False)
    c.dry_run = True
    assert A.translate_all(spark, c).first().asDict() == {"locale": "de", "new": 2, "updated": 0, "skipped": 0, "errors": 1}
    c.dry_run = False
    row = A.translate_all(spark, c).first()
    assert (row.success, row.failed, row.skipped) == (2, 0, 1)
    text = (repository / "de" / "a.md").read_text()
    assert "title: HELLO" in text and "commit: " in text and "# ONE" in text
    head = {r.path: r.hash for r in H.latest_versions(G.read_versions(spark, str(repository))).collect()}
    assert head[str(repository / "en" / "a.md")] in text
    again = A.jobs(spark, c).where("path like '%/a.md'").first()
    assert (again.type, again.skip_reason, again.instructions) == ("SKIP", "up_to_date", "Be kind.")
    with pytest.raises(ValueError):
        A.check(spark, A.Config(str(repository / "none")))


def test_stream_of_versions(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = _history(spark)
    rows.where("seq < 2").coalesce(1).write.parquet(folder)
    seen = []
    translations = table(spark, DOC, ("t/a.md", "---\ncommit: c0\n---\nalt"))
    targets = table(spark, "locale string, target_root string", ("de", "t"))
    for part in (None, rows.where("seq = 2")):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(folder)
        stream = incremental.stream_versions(spark, folder)
        q = incremental.start(stream, lambda: spark.read.parquet(folder), lambda: translations, targets, "s", lambda df, n: seen.append((n, {r.path: r.type for r in df.collect()})), str(tmp_path / "cp"))
        q.awaitTermination()
    assert seen == [(0, {"s/a.md": "SKIP", "s/b.md": "NEW", "s/c.md": "NEW"}), (1, {"s/a.md": "UPDATE", "s/e.md": "NEW"})]


def test_writing(spark, tmp_path):
    SF.write_documents(table(spark, DOC, ("x/y/a.md", "ä\r\n"), ("b.md", "")), str(tmp_path))
    assert (tmp_path / "x/y/a.md").read_bytes() == "ä\r\n".encode() and (tmp_path / "b.md").read_bytes() == b""
    (tmp_path / "bad.md").write_bytes(b"a\xffb")
    os.symlink(tmp_path / "bad.md", tmp_path / "link.md")
    got = {os.path.basename(r.path): r.content for r in SF.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "ä\r\n", "b.md": "", "bad.md": "a�b"}


# queries over whole texts


def test_queries_over_whole_lines_and_all_documents(spark, tmp_path):
    long = "a heading of many words " * 400 + "end"
    rows = [(10, f"{long}\nbody [x](y.md)\nmore\nlast\nsecond {long}", "en", "s"), (70, long, "de", "s"), (None, "no id " * 20, "en", "s"), (71, "x " * 3_000 + "\nlink line", None, None), (5000, "short\nlink", "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    heads = {(r.path.split("/doc-")[1].split(".")[0][:4], r.pos): r.text for r in run("headings_ordered")}
    assert heads["10", 0] == long and heads["10", 1] == f"second {long}" and heads["70", 0] == long and heads["5000", 0] == "short"
    assert heads["71", 0] == ("x " * 3_000).strip() and heads["row-", 0] == ("no id " * 20).strip() and len(heads) == 6
    found = {r.destination for r in run("links_extract") if "#" in r.destination and "#nope" not in r.destination}
    assert len(found) == 3 and all(d.startswith("../../") for d in found)
    assert not [r for r in run("broken_anchors") if r.destination in found]
    assert len({r.path for r in run("split_chunks")}) == 5


def test_queries_over_whole_texts(spark, tmp_path):
    texts = ["Plain words " * 30 + "end: of it\nnext line, see docs/a.md", "  one\n\n  two " + "x" * 500 + " #tag ", "word " * 40 + "fin", None, " \n\t "]
    docs = [(i, t, "en", f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("{}",)], "props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([("TIN",)], "p_type string").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    slug = lambda t: "".join("-" if c.isspace() else c for c in t.lower() if c.isalnum() or c.isspace() or c == "-").strip("-")
    assert {r.doc_id: r.slug for r in run("slugify")} == {i: t if t is None else slug(t) for i, t in enumerate(texts)}
    quoted = {r.v: r.quoted for r in run("yaml_quote")}
    assert all(t in quoted for t in texts if t is not None) and quoted[texts[2]] == texts[2]
    assert quoted[texts[0]] != texts[0] and quoted[texts[1]] != texts[1]
    likely = {r.doc_id: r.likely for r in run("likely_file_path") if r.v == texts[r.doc_id] and r.v}
    assert likely == {0: True, 1: False, 2: False, 4: False}
    prompts = {r.doc_id: r.prompt for r in run("prompt_render")}
    assert all(prompts[i] == f"To German: s{i} {{{{unknown}}}} {texts[i]} [{{{{source}}}}]" for i in (0, 1, 2, 4))
    fields = {r.doc_id: r for r in run("field_block_roundtrip")}
    assert {i: r.title for i, r in fields.items()} == {i: texts[i].strip() for i in range(3)}
    assert all(r.body == "the body" and r.source_field == f"s{i}" and f"[[title]]\n{texts[i].strip()}\n[[/title]]" in r.blocks for i, r in fields.items())
