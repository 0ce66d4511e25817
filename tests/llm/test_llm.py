"""The training-data operations against brute force, held-out accuracy and odd inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import ann, decontaminate, html, jaccard, langid, lines, mixing, pii, tokens
from foliospark.llm.ann import nearest
from foliospark.llm.graph import connected_components
from foliospark.llm.jaccard import PrefixTree, drop_near_duplicates, near_duplicates
from foliospark.llm.queries import oracle_sql, queries
from foliospark.llm.repeats import repeated_passages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Rows of (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma"]
    long = "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(9)) for _ in range(3_000))
    return [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", None, "s", 4), (3, long, "en", None, None), (4, "one line of text here\nand a second line there", "en", "s", 1), (4, "one line of text here\nand a second line there", "en", "s", 1), (None, "one line of text here\nand a second line there", "en", "s", 1), (5, "\U0001f600 İstanbul 123", "tr", "s", 3)]


def clash(df):
    """The table with further columns whose names the operators use inside."""
    for c in "rk key leaf template n block id v count keys runs new island slot ord part item_id lot word_from start node a b".split():
        df = df.withColumn(c, F.lit("x"))
    return df


OPERATORS = {
    "tokens": lambda d: tokens.token_counts(d),
    "mix": lambda d: mixing.mix_sources(d, block_tokens=50),
    "lines": lambda d: lines.recurring_lines(d),
    "dedup_lines": lambda d: lines.dedup_lines(d),
    "near": lambda d: near_duplicates(d),
    "drop_near": lambda d: drop_near_duplicates(d),
    "identify": lambda d: langid.identify(d),
    "keep": lambda d: langid.keep_identified(d),
    "pii": lambda d: pii.find_pii(d),
    "repeats": lambda d: repeated_passages(d, min_words=6, prefix=3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_inputs(spark, name):
    run = OPERATORS[name]
    plain = docs_of(spark, odd_rows())
    assert run(docs_of(spark, []).where("false")).count() == 0
    keep = [c for c in run(plain).columns]
    assert sorted(map(str, run(clash(plain)).select(keep).collect())) == sorted(map(str, run(plain).collect()))


def test_clashing_columns_stay(spark):
    for run in (lines.dedup_lines, drop_near_duplicates, langid.keep_identified):
        d = clash(docs_of(spark, odd_rows()))
        assert run(d).columns == d.columns


# tokens


def _codec():
    with open(tokens.TOKENIZER, "rb") as f:
        return tokens.Codec(f.read())


def test_splice_gives_the_ids_of_the_whole_text():
    codec, rng = _codec(), random.Random(1)
    pieces = [" ", "  ", "\n", "\n\n", "word", "Straße", "don't", "123", "!?", "日本語", "\U0001f600", "\x1c", "!\x1c", " ", "\t"]
    for _ in range(120):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))
        ids, chunks, _ = tokens.splice(codec, text, 60, 12)
        assert ids == codec.ids(text)
        assert chunks >= 1


def test_overlaps_are_widened():
    codec = _codec()
    text = "a" * 500 + " b" * 300 + "日" * 400
    ids, _, widened = tokens.splice(codec, text, 50, 4)
    assert ids == codec.ids(text) and widened > 0


def test_token_counts_of_odd_rows(spark):
    got = {(r.doc_id, r.n_chunks > 1): (r.n_tokens, r.n_chunks) for r in tokens.token_counts(docs_of(spark, odd_rows())).collect()}
    assert got[1, False] == (0, 1)
    assert got[3, True][0] == len(_codec().ids(odd_rows()[3][1]))
    nulls = tokens.token_counts(docs_of(spark, [(9, None)])).first()
    assert (nulls.n_tokens, nulls.n_chunks) == (None, 0)


# nearest neighbours


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(500, 16)) * 0.2 + 2]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in nearest(df, k=5, shard_rows=200, cell_rows=16).collect():
        got[r.vec_id].add(r.neighbor_id)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, 1)[:, :5]
    assert len(got) == len(x)
    some = nearest(df, k=5, shard_rows=20, cell_rows=16, every=20).collect()
    assert {r.vec_id for r in some} == set(range(0, len(x), 20)) and np.mean([r.neighbor_id in true[r.vec_id] for r in some]) >= 0.9
    assert np.mean([len(got[i] & set(true[i].tolist())) / 5 for i in range(len(x))]) >= 0.9


def test_shards_hold_whole_centroids_or_parts_of_one():
    first, parts = ann.shards(np.array([3, 4, 2, 25, 1, 9, 0]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 4] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_recall_of_the_query(spark):
    """Against brute force over the whole table."""
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_numpy())
    y, ids = x / np.linalg.norm(x, axis=1, keepdims=True), rows.vec_id.to_numpy()
    got = defaultdict(set)
    for r in queries()["op2_nearest_neighbours"](spark, SF.replace("0.001", "0.1")).collect():
        got[r.vec_id].add(r.neighbor_id)
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    s = y[ids % 20 == 0] @ y.T
    s[ids[ids % 20 == 0][:, None] == ids[None, :]] = -9
    true = ids[np.argsort(-s, 1)[:, :10]]
    assert np.mean([len(got[i] & set(t.tolist())) / 10 for i, t in zip(ids[ids % 20 == 0].tolist(), true, strict=True)]) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (None, [1.0, 0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, []), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, v string, id int")
    got = {(r.vec_id, r.rank): r.neighbor_id for r in nearest(df).collect()}
    assert got == {(1, 1): 9, (1, 2): 2, (9, 1): 1, (9, 2): 2, (2, 1): 1, (2, 2): 9}
    assert nearest(df.where("false")).count() == 0 and nearest(df.where("vec_id = 1")).count() == 0


def test_every_length_is_searched_by_itself(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(size=6)) for i in range(120)] + [(500, rng.normal(size=9))] + [(600 + i, rng.normal(size=4)) for i in range(30)] + [(700 + i, rng.normal(size=7)) for i in range(2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in made], "vec_id bigint, embedding array<double>")
    unit = {i: v / np.linalg.norm(v) for i, v in made}
    true = {i: sorted((1 - u @ w, j) for j, w in unit.items() if j != i and len(w) == len(u))[:10] for i, u in unit.items()}
    for few in (1_024, 20):
        monkeypatch.setattr("foliospark.llm.ann.FEW_ROWS", few)
        got = defaultdict(dict)
        for r in nearest(df).collect():
            got[r.vec_id][r.rank] = (r.neighbor_id, r.distance)
        assert set(got) == set(unit) - {500} and [got[700][1][0], got[701][1][0]] == [701, 700]
        assert all(sorted(got[i]) == list(range(1, len(true[i]) + 1)) for i in got)
        hits = {i: len({j for j, _ in got[i].values()} & {j for _, j in true[i]}) / len(true[i]) for i in got}
        assert np.mean([hits[i] for i in range(120)]) > 0.9 and np.mean([hits[600 + i] for i in range(30)]) > (0.999 if few > 30 else 0.9)
        assert all(np.isclose(d, 1 - unit[i] @ unit[j], atol=1e-5) for i in got for j, d in got[i].values())


def test_one_element_vectors_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    got = {(r.vec_id, r.rank): r.neighbor_id for r in nearest(df, k=2).collect()}
    assert got[0, 1] == 1 and got[0, 2] == 2 and got[3, 1] == 0


# mixing


def test_schedule_covers_all_words_in_proportion(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(300)]
    d = docs_of(spark, rows)
    got = mixing.mix_sources(d, {"a": 1.0, "b": 1.0, "(none)": 2.0}, block_tokens=64).collect()
    first = Counter()
    for r in got:
        if r.epoch == 0:
            first[r.doc_id] += r.token_to - r.token_from
    assert first == Counter({r[0]: len(r[1].split()) for r in rows})
    slots = Counter({s: len({r.slot for r in got if r.source == s}) for s in ("a", "b", "(none)")})
    total = sum(slots.values())
    assert abs(slots["a"] / total - 0.25) < 0.03 and abs(slots["(none)"] / total - 0.5) < 0.03
    for s in slots:  # low discrepancy: no source is ever far from its share
        at = sorted({r.slot for r in got if r.source == s})
        share = {"a": 0.25, "b": 0.25, "(none)": 0.5}[s]
        assert all(abs(k - t * share) < 4 for k, t in enumerate(at))
    blocks = Counter()
    for r in got:
        blocks[r.slot] += r.token_to - r.token_from
    last = {s: -(-sum(len(r[1].split()) for r in rows if (r[3] or "(none)") == s) // 64) - 1 for s in slots}
    assert all(n == 64 for t, n in blocks.items() if next((r.source, r.block) for r in got if r.slot == t) not in last.items())


def test_points_beyond_32_bits(spark):
    rng = random.Random(1)
    slots = [0, 1, 2**31 - 1, 2**31, 2**31 + 1, 2**40, 8_300_000_000, 2**62 - 1, *(rng.getrandbits(62) for _ in range(200))]
    got = spark.createDataFrame([(x,) for x in slots], "slot bigint").select("slot", mixing.golden_point(F.col("slot")).alias("p")).collect()
    assert [r.p for r in got] == [r.slot * mixing.GOLDEN % 2**62 for r in got] and abs(mixing.GOLDEN / 2**62 - 0.6180339887498949) < 1e-12
    # of 100,000 slots from 8.3e9 on, each tenth of the points takes its share
    far = spark.range(8_300_000_000, 8_300_100_000).select((mixing.golden_point(F.col("id")) / 2.0**62 * 10).cast("int").alias("t")).groupBy("t").count().collect()
    assert len(far) == 10 and all(abs(r["count"] - 10_000) < 10 for r in far)


def test_many_sources_and_vocabulary_tokens(spark):
    rng = random.Random(7)
    rows = [(i, "some words, and more " * rng.randint(1, 9), "en", f"s{i % 700}", 1) for i in range(1_500)]
    got = mixing.mix_sources(docs_of(spark, rows), block_tokens=40, tokenizer_path=tokens.TOKENIZER).collect()
    once = Counter()
    for r in got:
        if r.epoch == 0:
            once[r.doc_id] += r.token_to - r.token_from
    codec = _codec()
    assert once == Counter({r[0]: len(codec.ids(r[1])) for r in rows}) and len({r.source for r in got}) == 700


def test_sources_without_weight_get_no_slot(spark):
    d = docs_of(spark, [(1, "a b c", "en", "x", 5), (2, "a b", "en", "y", 3), (3, None, "en", "x", None)])
    assert {r.source for r in mixing.mix_sources(d, {"x": 1.0, "y": 0.0}).collect()} == {"x"}


# HTML


def test_main_text_of_held_out_pages():
    model, rng = html.fit(250, 3), random.Random(77)
    made = [html.make_page(rng) for _ in range(150)]
    score = []
    for (text, _, _), (_, blocks) in zip(model.extract([p for p, _ in made]), made, strict=True):
        a, b = Counter(text.split()), Counter(" ".join(blocks).split())
        score.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(score) > 0.95


def test_decoding_is_hierarchical_and_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        parent = [0] + [int(rng.integers(0, k)) for k in range(1, n)]
        # document order
        children = defaultdict(list)
        for k in range(1, n):
            children[parent[k]].append(k)
        order, stack = [], [0]
        while stack:
            k = stack.pop()
            order.append(k)
            stack += children[k]
        new = {k: i for i, k in enumerate(order)}
        parent = [0] + [new[parent[k]] for k in order[1:]]
        depth = [0] * n
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        below = [{j for j in range(k, n) if j == k or _under(parent, j, k)} for k in range(n)]
        s = {"parent": np.array(parent), "end": np.array([k + len(below[k]) for k in range(n)]), "depth": np.array(depth), "root": np.zeros(n, int), "own": rng.integers(0, 50, n).astype(float)}
        score = rng.normal(size=n) * 2
        gain = np.clip(score, -4, 4) * (np.log1p(s["own"]) + 0.1)
        got = html.decode(score, s)

        def best(k):
            whole = gain[list(below[k])].sum()
            opened = max(gain[k], 0) - html.SPLIT_COST + sum(best(j)[0] for j in range(k + 1, n) if parent[j] == k)
            value = max(whole, 0, opened)
            if whole >= max(0, opened):
                return value, set(below[k])
            if opened <= 0:
                return value, set()
            return value, ({k} if gain[k] > 0 else set()).union(*(best(j)[1] for j in range(k + 1, n) if parent[j] == k))

        assert set(np.flatnonzero(got).tolist()) == best(0)[1]


def _under(parent, j, k):
    while j:
        j = parent[j]
        if j == k:
            return True
    return False


def test_faulty_and_odd_pages(spark):
    dom = html.Dom("<ul><li>a<li>b</ul><p>c<p>d</b><script>x < '</p>'</script><!-- no --><td>e &amp; f<img src='>'>")
    assert [t.strip() for _, t, _ in dom.pieces] == ["a", "b", "c", "d", "e & f"]
    deep = "<div>" * 3_000 + "text" + "</div>" * 3_000
    rows = [(1, None), (2, ""), (3, "just text"), (None, "<p>x"), (4, deep), (4, deep), (5, "<<<>>> < a"), (6, "<p>" + "word " * 300_000), (7, "<!-- open")]
    df = spark.createDataFrame([(a, "u", b, "z") for a, b in rows], "page_id bigint, url string, html string, text string")
    got = html.extract_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[7].text == ""
    assert html.extract_text(df.where("false")).count() == 0


# line templates


def test_templates_generalise_and_recur(spark):
    rows = [(i, f"user {i} logged in from host{i}\nonly here {['aa', 'bb', 'cc', 'dd'][i]} {['x', 'y', 'z', 'w'][i] * 3} unique words follow now {'qwerty'[i]}") for i in range(4)]
    got = lines.recurring_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.line_no, r.template, r.n_docs, r.first_doc) for r in got} == {(i, 0, "user <*> logged in from <*>", 4, i == 0) for i in range(4)}
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert kept[0] == rows[0][1] and all(kept[i] == rows[i][1].split("\n")[1] for i in (1, 2, 3))


def _brute_lines(rows, similarity=lines.SIMILARITY):
    """The template tree one line at a time."""
    wild = lambda t: any(c.isdigit() and c.isascii() for c in t)
    leaves = defaultdict(set)
    placed = []
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            t = [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]
            if len(t) < lines.MIN_TOKENS:
                continue
            m = tuple("<*>" if wild(x) else x for x in t)
            leaves[len(m), m[: lines.DEPTH]].add(m)
            placed.append((i, no, m))
    template = {}
    for leaf in leaves.values():
        left = set(leaf)
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                m = todo.pop()
                group.add(m)
                near = {x for x in left if sum(map(str.__eq__, x, m)) >= similarity * len(m) - 1e-9}
                left -= near
                todo += near
            t = tuple(x[0] if len(set(x)) == 1 else "<*>" for x in zip(*group, strict=True))
            general = sum(x != "<*>" for x in t) < lines.MIN_FIXED
            template |= {m: m if general else t for m in group}
    template = {m: " ".join(t) for m, t in template.items() if sum(x != "<*>" for x in t) >= lines.MIN_FIXED}
    who = defaultdict(set)
    for i, _, m in placed:
        if m in template:
            who[template[m], m[: lines.DEPTH]].add(i)
    return {(i, no, template[m]) for i, no, m in placed if m in template and len(who[template[m], m[: lines.DEPTH]]) >= lines.MIN_DOCS}


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    words = "a b c d e f g".split()
    rows = [(i, "\n".join(" ".join(rng.choice([*words, str(rng.randint(0, 9))]) if k > 3 else rng.choice("ab") for k in range(rng.randint(2, 8))) for _ in range(12))) for i in range(40)]
    got = {(r.doc_id, r.line_no, r.template) for r in lines.recurring_lines(docs_of(spark, rows)).collect()}
    assert got == _brute_lines(rows)


def _least(first, line):
    """line(i) for the first i whose hash is below those of the other lines."""
    order = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    return next(line(i) for i in map(_letters, range(100_000)) if order(line(i)) < min(map(order, first)))


def _letters(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_similar_lines_are_linked_past_the_least_line_of_a_run(spark):
    # the three have only the run "p" in common, whose least line is similar to none of them
    three = ["a b c d p q r s", "a b c d p u v s", "a b c d p w x s"]
    rows = list(enumerate([*three, _least(three, lambda i: f"a b c d p {i} {i}y {i}z")]))
    got = lines.recurring_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.template, r.n_docs, r.first_doc) for r in got} == {(i, "a b c d p <*> <*> s", 3, i == 0) for i in range(3)}
    assert {r.doc_id for r in lines.dedup_lines(docs_of(spark, rows)).collect()} == {0, 3}


def test_a_class_keeps_its_links_whatever_it_generalises_to(spark):
    # each is similar to the first alone: together they leave half of their tokens
    rows = list(enumerate(["a b c d e f g h", "a b c d x y g h", "a b c d e f z w"]))
    got = lines.recurring_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.template, r.n_docs) for r in got} == {(i, "a b c d <*> <*> <*> <*>", 3) for i in range(3)}
    # a class that leaves less than three fixed tokens doesn't hide the lines that recur by themselves
    rows = [(i, f"{i} {i} a b c") for i in range(3)] + [(3, "3 3 a b d")]
    got = lines.recurring_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.template, r.n_docs) for r in got} == {(i, "<*> <*> a b c", 3) for i in range(3)}


@pytest.mark.parametrize("lot", [2, 7])
def test_runs_of_many_lines_in_lots(spark, monkeypatch, lot):
    monkeypatch.setattr(lines, "LOT", lot)
    rng = random.Random(lot)
    # two families of lines with links, one without many, all with the run "p"
    kinds = [("efg", "u"), ("hij", "v"), ("klmnopqrst", "w")]
    rows = [(i, "\n".join(f"a b c d p {' '.join(rng.choice(letters) for _ in range(6))} {end}" for letters, end in kinds for _ in range(6))) for i in range(12)]
    want = _brute_lines(rows)
    got = {(r.doc_id, r.line_no, r.template) for r in lines.recurring_lines(docs_of(spark, rows)).collect()}
    assert got == want and len({t for _, _, t in want}) > 1


def test_equal_lines_recur_at_any_length_from_two_documents(spark):
    rng = random.Random(4)
    words = "a b c d e f g".split()
    rows = [(i, "\n".join(" ".join(rng.choice([*words, str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 6))) for _ in range(8))) for i in range(30)]
    rows += [(90, "\u4e00\u884c\u6587\u5b57\n\nonly  two of\tthese\nitem 7"), (91, "\u4e00\u884c\u6587\u5b57\n\nonly two of these\nitem 7"), (92, "\u4e00\u884c")]
    want = _brute_lines(rows)
    by, who, at = {(i, no) for i, no, _ in want}, defaultdict(set), defaultdict(list)
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            m = " ".join(line.split())
            if m and not any(c.isdigit() for c in m) and (i, no) not in by:
                who[m].add(i)
                at[m].append((i, no))
    want |= {(i, no, m) for m, places in at.items() if len(who[m]) >= 2 for i, no in places}
    got = lines.recurring_lines(docs_of(spark, rows), exact_docs=lines.EXACT_DOCS).collect()
    assert {(r.doc_id, r.line_no, r.template) for r in got} == want and len(got) == len(want)
    assert {(r.doc_id, r.line_no, r.n_docs, r.first_doc) for r in got if r.doc_id >= 90} == {(90, 0, 2, True), (91, 0, 2, False), (90, 2, 2, True), (91, 2, 2, False)}
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert kept[90] == rows[-3][1] and kept[91] == "\nitem 7" and kept[92] == rows[-1][1]


# near duplicates


def _grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("small", [{}, {"chunk": 3, "range_entries": 60, "buckets": 1 << 16}, {"range_entries": 2, "buckets": 16}])
def test_near_duplicates_against_brute_force(spark, small):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(2, 120))]
        rows.append((i, " ".join(w) + (" " + shared) * (i % 2)))
        for c in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * i + c, " ".join(v) + (" " + shared) * (i % 2)))
    sets = {i: _grams(t) for i, t in rows}
    ids, root = list(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    size = Counter(find(i) for i in ids)
    want = {(i, find(i), size[find(i)], find(i) == i) for i in ids if size[find(i)] > 1}
    got = {(r.doc_id, r.group_id, r.group_size, r.keeper) for r in near_duplicates(docs_of(spark, rows), **small).collect()}
    assert got == want
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(spark, rows), **small).collect()}
    assert kept == set(ids) - {i for i, _, _, keeper in got if not keeper}


def test_prefix_tree_finds_exactly_the_similar_sets():
    rng = np.random.default_rng(8)
    base = np.sort(rng.choice(1 << 32, 80, replace=False)).astype(np.uint32)
    sets = [np.sort(rng.choice(base, rng.integers(1, 70), replace=False)) for _ in range(150)]
    tree = PrefixTree(0.5)
    for k, s in enumerate(sets):
        tree.add(s, k)
    with_more, more = PrefixTree(0.5), rng.integers(0, 30, 150).tolist()
    for k, s in enumerate(sets):
        with_more.add(s, k, len(s) + more[k])
    for k, s in enumerate(sets[:60]):
        both = {j: (len(np.intersect1d(s, o)), len(s) + more[k] + len(o) + more[j]) for j, o in enumerate(sets)}
        assert dict(with_more.matches(s, size=len(s) + more[k])) == {j: n for j, (n, m) in both.items() if n >= 0.5 * (m - n)}
    for s in sets[:60]:
        got = dict(tree.matches(s))
        want = {k: len(np.intersect1d(s, o)) for k, o in enumerate(sets)}
        assert got == {k: n for k, n in want.items() if n >= 0.5 * (len(s) + len(sets[k]) - n)}


def test_a_large_block_is_joined_in_parts(spark):
    """Documents of one group, of which some are only like others than the leader."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = base[:40] + [f"y{i}" for i in range(40)]
    rows += [(1000, " ".join(chain)), (1001, " ".join(chain[10:])), (1002, " ".join(chain[28:]))]
    got = {r.doc_id: (r.group_id, r.group_size) for r in near_duplicates(docs_of(spark, rows), chunk=16).collect()}
    # most grams of the group are heavy here
    assert got == {r.doc_id: (r.group_id, r.group_size) for r in near_duplicates(docs_of(spark, rows), range_entries=20).collect()}
    sets = {i: _grams(t) for i, t in rows}
    part = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            part[a] = min(part[b] for b in sets if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    size = Counter(part.values())
    assert got == {i: (part[i], size[part[i]]) for i in sets if size[part[i]] > 1}


def test_shared_grams_and_packed_entries():
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 1 << 63, 40)[rng.integers(0, 40, 60)].astype(np.uint64)
    ids = jaccard.ids_of(grams, 7)
    assert len(set(ids.tolist())) == len(set(grams.tolist())) and int((ids >> np.uint64(32)).max()) < 7
    many, level = jaccard.shared_entries(ids.astype(np.uint32))
    n = Counter(grams.tolist())
    assert many.tolist() == [n[g] > 1 for g in grams.tolist()] and level.tolist() == [int(np.log2(n[g]) * 8) for g in grams.tolist()]
    place = np.sort(rng.integers(0, 50_000, 60))
    got = jaccard.unpack(jaccard.pack(place, ids, level))
    assert all((x == y).all() for x, y in zip(got, (place, ids.astype(np.uint32), level), strict=True))
    assert len(jaccard.unpack(jaccard.pack(place, ids))[2]) == 0 and len(jaccard.unpack(jaccard.pack(place[:0], ids[:0]))[1]) == 0


def test_repeated_rows_count_as_copies(spark):
    got = drop_near_duplicates(docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (2, None), (2, None), (3, "")]))
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "a b c d"), (2, ""), (2, ""), (3, "")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# languages


def test_languages_of_held_out_rows(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    langs, table = langid.fit(d.where("doc_id % 2 = 0"))
    test = d.where("doc_id % 2 = 1").toPandas()
    share, known = langid.infer(*langid.word_scores(test.text.tolist(), table), langid.MIN_SHARE, langid.PENALTY, langid.MARGIN)
    assert np.mean(np.array([*langs, "und"])[share.argmax(1)] == test.lang) > 0.97 and known.mean() > 0.99


def test_mixture_shares(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").toPandas()
    langs, table = langid.fit(spark.createDataFrame(d))
    pure = {x: " ".join(" ".join(d[d.lang == x].text[:30]).split()[:1500]).split() for x in ("en", "de")}
    text = " ".join(pure["en"][:700] + pure["de"][:300])
    share, known = langid.infer(*langid.word_scores([text, "", "#### 123 ---"], table), langid.MIN_SHARE, langid.PENALTY, langid.MARGIN)
    at = dict(zip([*langs, "und"], share[0], strict=True))
    assert abs(at["en"] - 0.7) < 0.08 and abs(at["de"] - 0.3) < 0.08 and known.tolist() == [True, False, False]


def test_expectation_maximisation_is_that_of_one_document_at_a_time():
    rng = np.random.default_rng(2)
    counts = np.array([5, 1, 40])
    p = rng.random((counts.sum(), 3)).astype(np.float32)
    share, ll = langid.expectation_maximisation(p, counts, np.ones((3, 3)), 25)
    at = 0
    for k, n in enumerate(counts):
        w = np.ones(3) / 3
        for _ in range(25):
            r = p[at : at + n] * w
            w = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share[k], w, atol=1e-4) and np.isclose(ll[k], np.log(p[at : at + n] @ w).sum(), atol=1e-3)
        at += n


def test_rare_languages_keep_their_models(spark):
    rows = [(i, "the common words of every day", "en", "s", 1) for i in range(4_000)] + [(10_000 + i, "qaxo zemi vupu tolk", "xx", "s", 1) for i in range(12)] + [(None, f"harg {i} blon snert", "yy", "s", 1) for i in range(40)] + [(20_000 + i, "few", "zz", "s", 1) for i in range(4)]
    d = docs_of(spark, rows)
    assert langid.fit(d, train_rows=100)[0] == ["en", "xx", "yy"] and langid.fit(d, train_rows=100, lang_rows=1)[0] == ["en", "xx", "yy"]
    got = {r.doc_id: (r.languages, r.accepted) for r in langid.identify(d, train_rows=100).collect()}
    assert all(got[10_000 + i] == (["xx"], True) for i in range(12)) and got[0] == (["en"], True)


def test_unknown_text_is_rejected_and_known_kept(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, "zqxj kvwq xxjq qqzk wvxq jjqz " * 20, None, "s", 1), (-2, None, "en", "s", None)], d.schema)
    both = d.unionByName(junk)
    kept = {r.doc_id for r in langid.keep_identified(both).select("doc_id").collect()}
    assert kept == {r.doc_id for r in langid.identify(both).where("accepted").collect()}
    assert -1 not in kept and -2 not in kept and len(kept) == d.count()


def test_without_labels_nothing_with_words_goes(spark):
    d = docs_of(spark, [(1, "some words", None, "s", 1), (2, "", None, "s", 0)])
    assert [r.doc_id for r in langid.identify(d).where("accepted").collect()] == [1]


# personal data


def test_checksums_against_arithmetic():
    rng = random.Random(9)
    for _ in range(300):
        n = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 20)))
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n)))
        assert pii.luhn(n) == (total % 10 == 0 and 13 <= len(n) <= 19 and len(set(n)) > 1)
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88 3704 0044 0532 0130 00")


def test_spans_and_context():
    text = "pay by card 4111 1111 1111 1111, not 4111 1111 1111 1112; IBAN DE89370400440532013000; mail bob@example.org; call +49 170 1234567; ip 10.0.0.1 and version 10.0.0.999; ssn 123-45-6789"
    got = {(k, text[a:b]) for k, a, b, _, _ in pii.spans(text)}
    assert got == {("card", "4111 1111 1111 1111"), ("iban", "DE89370400440532013000"), ("email", "bob@example.org"), ("phone", "+49 170 1234567"), ("ipv4", "10.0.0.1"), ("ssn", "123-45-6789")}
    near = {k: s for k, _, _, s, _ in pii.spans("card 4111111111111111")}
    far = {k: s for k, _, _, s, _ in pii.spans("number 4111111111111111")}
    assert near["card"] > far["card"]
    assert pii.spans("") == [] and pii.spans("plain words only") == []


# repeats


def _brute_repeats(rows, m):
    docs = list(dict.fromkeys(rows))
    seen = defaultdict(set)
    split = [(t or "").lower().split() for _, t in docs]
    for k, w in enumerate(split):
        for p in range(len(w) - m + 1):
            seen[tuple(w[p : p + m])].add(k)
    out = set()
    for k, w in enumerate(split):
        covered = set()
        for p in range(len(w) - m + 1):
            if len(seen[tuple(w[p : p + m])]) > 1:
                covered |= set(range(p, p + m))
        for p in covered:
            if p - 1 not in covered:
                q = p
                while q + 1 in covered:
                    q += 1
                out.add((docs[k][0], p, q + 1))
    return out


@pytest.mark.parametrize("group_runs", [4_096, 2])
def test_repeats_against_brute_force(spark, group_runs):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(8)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 4)) for w in (rng.choice(shared) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 30))]))) for i in range(60)]
    rows += [rows[3], (77, rows[3][1]), (78, None), (79, ""), (80, " ".join(["x"] * 200)), (81, " ".join(["x"] * 9))]
    got = [(r.doc_id, r.word_from, r.word_to) for r in repeated_passages(docs_of(spark, rows), min_words=8, prefix=3, edge=3, group_runs=group_runs).collect()]
    assert set(got) == _brute_repeats(rows, 8) and len(got) == len(set(got))


# decontamination


@pytest.mark.parametrize("pass_bytes", [32_000_000, 300])
def test_contamination_against_brute_force(spark, pass_bytes):
    rng = random.Random(13)
    words = [f"t{i}" for i in range(50)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 9, 15, 30])))) for k in range(25)] + [(99, None), (98, ""), (3, "again " * 8), (97, "\u8fd9\u662f\u4e00\u4e2a\u957f" * 9), (96, "\u77ed")]
    rows = []
    for i in range(50):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            part = (rng.choice(items[:25])[1]).split()
            w[5:5] = part[: rng.randint(1, len(part))]
        rows.append((i, ", ".join(x.upper() for x in w)))
    rows += [rows[0], (None, rows[0][1]), (70, None), (71, ""), (72, "before " + "\u8fd9\u662f\u4e00\u4e2a\u957f" * 9 + "."), (73, "\u77ed")]
    bench = spark.createDataFrame([(*x, "b") for x in items], "item_id bigint, text string, doc_id string")
    d = docs_of(spark, rows)
    want = defaultdict(int)
    for i, t in dict.fromkeys(rows):
        for item in {k for k, _ in items}:
            strings = {s for k, x in items if k == item for s in decontaminate.strings_of(x)}
            n = sum(s in decontaminate.normal(t or "") for s in strings)
            if n:
                want[i, item] = max(want[i, item], n)
    got = {(r.doc_id, r.item_id): r.n_strings for r in decontaminate.contaminated(d, bench, pass_bytes=pass_bytes).collect()}
    assert got == dict(want) and got
    kept = sorted(str(r.doc_id) for r in decontaminate.decontaminate(d, bench, pass_bytes=pass_bytes).collect())
    assert kept == sorted(str(i) for i, t in rows if not any(s in decontaminate.normal(t or "") for _, x in items for s in decontaminate.strings_of(x)))


def test_a_large_benchmark_is_held_once():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5_000)]
    items = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(800)]
    made = [decontaminate.windows_of(x) for x in items]
    at = np.cumsum([0] + [len(raw) for raw, _, _ in made])
    joined = [np.concatenate([np.array(m[k]) + a for m, a in zip(made, at, strict=False)]) for k in (1, 2)]
    finder = decontaminate.WuManber(b"".join(raw for raw, _, _ in made), *joined, np.repeat(np.arange(800), [len(m[1]) for m in made]))
    assert len(finder.shift) < 3 * at[-1] and len(finder.text) == at[-1]
    for k in (0, 399, 799):
        w = items[k].split()
        doc = decontaminate.normal(" ".join([*words[:50], *w[100:120], *words[60:90]])).encode()
        assert {o for o, _ in finder.search(doc)} == {k} and len(finder.search(doc)) == 8
    assert not finder.search(decontaminate.normal(" ".join(rng.choice(words) for _ in range(3_000))).encode())


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    d = docs_of(spark, odd_rows())
    assert sorted(map(str, decontaminate.contaminated(clash(d), spark.createDataFrame([(1, "one line of text here and a second line there", "x")], "item_id int, text string, doc_id string")).collect())) == ["Row(doc_id=4, item_id=1, n_strings=1)", "Row(doc_id=None, item_id=1, n_strings=1)"]
    assert decontaminate.contaminated(d, bench).count() == 0 and decontaminate.decontaminate(d, bench).count() == d.count()
    assert decontaminate.decontaminate(clash(d), bench).columns == clash(d).columns


# queries and pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    groups = [r.group_size for r in near_duplicates(docs).collect()]
    assert not groups
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    once = Counter()
    for r in last:
        if r.epoch == 0:
            once[r.doc_id] += r.token_to - r.token_from
    codec = _codec()
    assert once == Counter({r.doc_id: len(codec.ids(r.text)) for r in docs.collect()})
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last))


def test_pipeline_stages_take_odd_rows(spark):
    plain = docs_of(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        last = name == "mixing"
        got = stage(spark, plain, SF)
        assert stage(spark, plain.where("false"), SF).count() == 0, name
        wide = stage(spark, clash(plain), SF)
        assert wide.columns == (got.columns if last else clash(plain).columns), name
        assert sorted(map(str, wide.select(got.columns).collect())) == sorted(map(str, got.collect())), name
        if not last:
            names = [("__row", "x"), ("__drop", "x"), ("_foliospark", "x")]
            odd = plain.selectExpr("*", *[f"'{v}' {k}" for k, v in names])
            assert stage(spark, odd, SF).columns == odd.columns, name


def test_every_operation_has_its_query():
    found = {int(n[2:].split("_")[0]) for n in queries()}
    assert found == set(range(1, 11)) and set(oracle_sql()) <= set(queries())
