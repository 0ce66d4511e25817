"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import lots

#: Labelled pages that the trees are fitted on (generated, see `make_page`), and the trees.
TRAIN_PAGES, SEED, TREES, DEPTH, RATE, BINS = 600, 11, 48, 4, 0.2, 32
#: Attribute tokens that are features (the most frequent of the training pages), and what a node whose
#: children are decided one by one has to gain.
TOKENS, SPLIT_COST = 48, 1.0

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_attribute = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_words = re.compile(r"[a-z]{2,}")
_space = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style noscript template textarea title iframe svg head select".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "br", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html table td th ul ol dl select button object caption".split())
_KINDS = [{"p"}, {"li", "dd", "dt"}, {"a"}, {"div"}, {"section"}, {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "fieldset"}, {"h1", "h2", "h3"}, {"h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"table", "tr", "td", "th", "tbody"}, {"pre", "code", "blockquote"}, {"figure", "figcaption"}]
_KIND = {t: k for k, tags in enumerate(_KINDS) for t in tags}


class Dom:
    """Elements of a page in document order and its pieces of text; hidden elements and comments are left out."""

    __slots__ = ("tag", "parent", "end", "depth", "tokens", "pieces")

    def __init__(self, page: str):
        self.tag, self.parent, self.end, self.depth, self.tokens = ["#root"], [-1], [0], [0], [()]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, whether a block boundary precedes
        stack, opened = [0], Counter({"#root": 1})
        hidden, edge, at = 0, True, 0
        tag, parent, end = self.tag, self.parent, self.end

        def close(down_to: int) -> None:
            nonlocal hidden
            while len(stack) > down_to:
                k = stack.pop()
                end[k] = len(tag)
                opened[tag[k]] -= 1
                hidden -= tag[k] in _HIDDEN

        def text(raw: str) -> None:
            nonlocal edge
            if hidden or not raw:
                return
            raw = _space.sub(" ", html.unescape(raw))
            if raw != " ":
                self.pieces.append((stack[-1], raw, edge))
                edge = False
            elif self.pieces and not edge and not self.pieces[-1][1].endswith(" "):
                k, t, e = self.pieces[-1]
                self.pieces[-1] = (k, t + " ", e)

        while m := _token.search(page, at):
            text(page[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:-3])
                continue
            name = name.lower()
            edge = edge or name in _BLOCK
            if m[1]:
                if opened[name] > 0:
                    k = len(stack) - 1
                    while tag[stack[k]] != name:
                        k -= 1
                    close(k)
                continue
            if name in _VOID:
                continue
            if name == "body" and opened["head"] > 0:  # a head without an end
                close(next(k for k, x in enumerate(stack) if tag[x] == "head"))
            ends = _SIBLINGS.get(name)
            if ends or (name in _CLOSES_P and opened["p"] > 0):
                k = len(stack) - 1
                while k > 0 and tag[stack[k]] not in _SCOPE | (ends or set()) and (ends or tag[stack[k]] != "p"):
                    k -= 1
                if k > 0 and tag[stack[k]] in (ends or {"p"}):
                    close(k)
                    if ends and name == "tr" and tag[stack[-1]] == "tr":
                        close(len(stack) - 1)
            parent.append(stack[-1])
            tag.append(name)
            end.append(0)
            self.depth.append(len(stack))
            attributes = m[3]
            self.tokens.append(tuple(w for a in _attribute.findall(attributes) for w in _words.findall((a[0] or a[1] or a[2]).lower())) if "=" in attributes else ())
            if attributes.endswith("/"):
                end[-1] = len(tag)
                continue
            stack.append(len(tag) - 1)
            opened[name] += 1
            hidden += name in _HIDDEN
            if name in _RAW:
                stop = _RAW[name].search(page, at)
                at = stop.start() if stop else len(page)
        text(page[at:])
        close(0)


def features(doms: list[Dom], vocabulary: dict[str, int]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A row for each element of all pages, and the structure that decoding needs."""
    size = np.array([len(d.tag) for d in doms])
    base = np.cumsum(size) - size
    page = np.repeat(np.arange(len(doms)), size)
    parent = np.concatenate([np.asarray(d.parent) + b for d, b in zip(doms, base, strict=True)])
    root = base[page]
    parent[base] = base
    end = np.concatenate([np.asarray(d.end) + b for d, b in zip(doms, base, strict=True)])
    depth = np.concatenate([d.depth for d in doms])
    n = len(parent)
    kind = np.array([_KIND.get(t, len(_KINDS)) for d in doms for t in d.tag])
    own, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for d, b in zip(doms, base.tolist(), strict=True):
        for k, t, _ in d.pieces:
            own[b + k] += len(t)
            words[b + k] += t.count(" ") + 1
            stops[b + k] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
    here = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(x)))
        return c[end] - c[here]

    def inside(of: int) -> np.ndarray:
        """Whether the element or one around it is of the kind."""
        mark = np.zeros(n + 1)
        at = np.flatnonzero(kind == of)
        np.add.at(mark, at, 1)
        np.add.at(mark, end[at], -1)
        return np.cumsum(mark)[:n] > 0

    link = inside(_KIND["a"])
    chars, linked, tags = below(own), below(own * link), (end - here).astype(float)
    density, share = chars / tags, linked / np.maximum(chars, 1)
    before = np.concatenate(([0.0], np.cumsum(own)))[here]
    whole = chars[root]
    children = np.bincount(parent[here != root], minlength=n).astype(float)
    same = parent * (len(_KINDS) + 1) + kind
    _, code, many = np.unique(same, return_inverse=True, return_counts=True)
    like = many[code].astype(float)
    mean_like = np.bincount(code, chars)[code] / like
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], parent)
    rank = np.empty(n)
    rank[order] = np.arange(n)
    place = (rank - first) / np.maximum(children[parent], 1)
    columns = [depth, chars, density, share, own, below(words) / tags, below(stops) / (below(words) + 1), children, like, mean_like, place,
               (before - before[root]) / (whole + 1), chars / (whole + 1), density[parent], share[parent], chars / (chars[parent] + 1), link]
    columns += [kind == k for k in range(len(_KINDS))] + [inside(_KIND[t]) for t in ("nav", "footer", "aside", "header", "article", "form")]
    x = np.zeros((n, len(columns) + 2 * TOKENS), np.float32)
    for k, c in enumerate(columns):
        x[:, k] = c
    at = len(columns)
    for d, b in zip(doms, base.tolist(), strict=True):
        for k, ts in enumerate(d.tokens):
            for t in ts:
                if (v := vocabulary.get(t)) is not None:
                    x[b + k, at + v] = 1
                    x[b + k : b + d.end[k], at + TOKENS + v] = 1  # all below have it around them
    return x, {"parent": parent, "end": end, "depth": depth, "own": own, "base": base, "root": root}


class Trees:
    """Gradient boosting of binary labels with histograms; nodes of full binary trees."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        f = x.shape[1]
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
        mean = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        self.feature = np.zeros((self.n, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.n, 2**self.depth - 1), np.inf, np.float32)
        self.leaf = np.zeros((self.n, 2**self.depth))
        width = self.bins + 1
        flat = binned + np.arange(f) * width
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, p * (1 - p) * weight
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 20:
                        continue
                    where = flat[rows].ravel()
                    sg = np.bincount(where, np.repeat(g[rows], f), f * width).reshape(f, width).cumsum(1)
                    sh = np.bincount(where, np.repeat(h[rows], f), f * width).reshape(f, width).cumsum(1)
                    tg, th = sg[0, -1], sh[0, -1]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < 2) | (th - sh < 2)] = 0
                    best = int(gain.argmax())
                    c, b = divmod(best, width)
                    if gain[c, b] > 1e-6 and b < len(cuts[c]):
                        self.feature[t, 2**level - 1 + k], self.cut[t, 2**level - 1 + k] = c, cuts[c][b]
                at = 2**level - 1 + node
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            sg, sh = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaf[t] = -self.rate * sg / (sh + 1)
            score += self.leaf[t, node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(self.n):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, node]
        return out


def decode(score: np.ndarray, s: dict[str, np.ndarray], cost: float = SPLIT_COST) -> np.ndarray:
    """Whether each element's own text is kept.

    Every element is kept with all below it, dropped with all below it, or open, when its own text and
    its children are decided one by one at a cost: nothing kept lies in anything dropped, nor the
    other way round. The decisions have the greatest sum of log-odds, weighted by the text.
    """
    parent, end, depth, root = s["parent"], s["end"], s["depth"], s["root"]
    n = len(parent)
    gain = np.clip(score, -4, 4) * (np.log1p(s["own"]) + 0.1)
    c = np.concatenate(([0.0], np.cumsum(gain)))
    keep = c[end] - c[np.arange(n)]
    split = np.maximum(gain, 0) - cost
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    best = np.zeros(n)
    for at in reversed(levels):
        best[at] = np.maximum(np.maximum(keep[at], 0), split[at])
        up = at[at != root[at]]
        np.add.at(split, parent[up], best[up])
    state = np.zeros(n, np.int8)  # 1: kept, 2: dropped, 0: open
    kept = np.zeros(n, bool)
    for at in levels:
        from_above = np.where(at == root[at], 0, state[parent[at]])
        mine = np.where(keep[at] >= np.maximum(0, split[at]), 1, np.where(split[at] > 0, 0, 2))
        state[at] = np.where(from_above > 0, from_above, mine)
        kept[at] = (state[at] == 1) | ((state[at] == 0) & (gain[at] > 0))
    return kept


_SYLLABLES = "an be con der el fa gi hon in jo ka lu men nor o per qua ri sta tem un ver wi xo ya zen ble ing tion".split()


def make_page(rng: random.Random) -> tuple[str, list[str]]:
    """A generated page and its main text's blocks, with the layouts and faults that pages have."""

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(2, 14).capitalize() + rng.choice([".", ".", ".", ",", "!"]) for _ in range(rng.randint(a, b)))

    blocks: list[str] = []

    def block(text: str) -> str:
        blocks.append(text)
        return text

    def links(a: int, b: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{word()}">{words(1, 4)}</a></{item}>' for _ in range(rng.randint(a, b)))

    def attr(*names: str) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f" class='{rng.choice(names)} {word()}'"])

    def nav() -> str:
        t, names = rng.choice([("nav", ("menu",)), ("div", ("nav", "menu", "topbar")), ("header", ("header", "banner"))])
        return f"<{t}{attr(*names)}><ul>{links(3, 9)}</ul></{t}>"

    def ad() -> str:
        t = rng.choice(["div", "aside", "section", "p"])
        return f'<{t} class="{rng.choice(["ad", "ads", "promo", "sponsor", "banner", "cookie"])}">{prose(1, 3)}</{t}>'

    def side() -> str:
        t, names = rng.choice([("aside", ("sidebar", "related")), ("div", ("sidebar", "related", "widget", "share"))])
        return f"<{t}{attr(*names)}><h3>{words(1, 3)}</h3><ul>{links(3, 8)}</ul></{t}>"

    def comments() -> str:
        return f'<div class="comments">{"".join(f"<div class=comment><b>{word()}</b><p>{prose(1, 3)}</p></div>" for _ in range(rng.randint(1, 5)))}</div>'

    def footer() -> str:
        t, names = rng.choice([("footer", ("footer",)), ("div", ("footer", "copyright", "legal"))])
        return f"<{t}{attr(*names)}>&copy; {word()}.example &middot; {rng.choice([prose(1, 3), f'<ul>{links(2, 6)}</ul>'])}</{t}>"

    def paragraph() -> str:
        text = block(prose(1, rng.choice([1, 4, 9])))
        shown = html.escape(text)
        r = rng.random()
        if r < 0.15:
            return f"<p><b>{shown}<br>"
        if r < 0.3:
            first, _, rest = shown.partition(" ")
            return f'<p><a href="/{word()}">{first}</a> {rest}</p>'
        return f"<p>{shown}</p>" if r < 0.9 else f"<p>{shown}"

    def main() -> str:
        out = [f"<h1>{block(words(2, 9))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            r = rng.random()
            if r < 0.75:
                out.append(paragraph())
            elif r < 0.83:
                out.append(f"<h2>{block(words(1, 6))}</h2>")
            elif r < 0.9:
                out.append("<ul>" + "".join(f"<li>{block(prose(1, 2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.94:
                out.append(f"<blockquote><p>{block(prose(1, 3))}</p></blockquote>")
            elif r < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{block(words(1, 5))}</td><td>{block(words(1, 5))}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            else:
                out.append(ad())
        t, names = rng.choice([("article", ("post",)), ("article", ("entry",)), ("main", ("content",)), ("div", ("content", "post", "article", "entry", "text")), ("section", ("content", "post"))])
        return f"<{t}{attr(*names)}>{''.join(out)}</{t}>"

    body = [nav()] + [rng.choice([ad, side])() for _ in range(rng.randint(0, 2))] + [main()] + [rng.choice([ad, side, comments])() for _ in range(rng.randint(0, 2))] + [footer()] * (rng.random() < 0.9)
    if rng.random() < 0.5:
        body = [f"<div{attr('page', 'wrapper', 'container')}>", *body, "</div>"]
    title = blocks[0] if blocks else ""
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(body)}</body></html>", blocks


class Model:
    """The fitted trees with the attribute tokens they know."""

    def __init__(self, trees: Trees, vocabulary: dict[str, int]):
        self.trees, self.vocabulary = trees, vocabulary

    def extract(self, pages: list[str]) -> list[tuple[str, int, int]]:
        """(main text, elements, elements whose own text is kept) of each page."""
        doms = [Dom(p) for p in pages]
        if not doms:
            return []
        x, s = features(doms, self.vocabulary)
        kept = decode(self.trees.score(x), s) & (s["own"] > 0)
        out = []
        for d, b in zip(doms, s["base"].tolist(), strict=True):
            lines: list[str] = []
            edge = True
            for k, t, start in d.pieces:
                edge = edge or start
                if kept[b + k]:
                    if edge or not lines:
                        lines.append(t)
                    else:
                        lines[-1] += t
                    edge = False
            text = "\n".join(t for t in (_space.sub(" ", x).strip() for x in lines) if t)
            out.append((text, len(d.tag) - 1, int(kept[b : b + len(d.tag)].sum())))
        return out


def fit(pages: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """Trees fitted on generated pages: an element counts as main text by the share of such text in it."""
    rng = random.Random(seed)
    made = [make_page(rng) for _ in range(pages)]
    doms = [Dom(p) for p, _ in made]
    tokens = Counter(t for d in doms for t in {t for ts in d.tokens for t in ts})
    vocabulary = {t: k for k, (t, _) in enumerate(sorted(tokens.items(), key=lambda x: (-x[1], x[0]))[:TOKENS])}
    x, s = features(doms, vocabulary)
    main = np.zeros(len(x))
    for d, b, (_, blocks) in zip(doms, s["base"].tolist(), made, strict=True):
        text = "\n".join(blocks)
        for k, t, _ in d.pieces:
            if len(t.strip()) > 1 and t.strip() in text:
                main[b + k] += len(t)
    c, o = np.concatenate(([0], np.cumsum(main))), np.concatenate(([0], np.cumsum(s["own"])))
    here = np.arange(len(x))
    share = (c[s["end"]] - c[here]) / np.maximum(o[s["end"]] - o[here], 1)
    # own text counts most where there is any
    share = np.where(s["own"] > 0, main / np.maximum(s["own"], 1), share)
    return Model(Trees().fit(x, (share > 0.5).astype(float), 0.2 + np.log1p(s["own"]) / 4), vocabulary)


_fitted: dict[tuple[int, int], Model] = {}


def extract_text(pages: DataFrame, train_pages: int = TRAIN_PAGES, seed: int = SEED) -> DataFrame:
    """page_id, text, n_elements, n_kept of every row: the main text of each page, a line for each block.

    Elements are scored by trees over subtree density, link share, depth, place, sibling statistics,
    kinds of elements and attribute tokens around them; `decode` turns the scores into decisions
    without contradictions. The trees are fitted on train_pages generated pages, never on the table.

    NULL html: NULL text and no elements; an empty page or one without main text: empty text. Text
    outside any element counts as the root's. Repeated rows and NULL page_ids are rows like others; other
    columns are ignored. Whole pages are parsed, however long. One pass without a shuffle.
    """
    if (train_pages, seed) not in _fitted:
        _fitted[train_pages, seed] = fit(train_pages, seed)
    shipped = pages.sparkSession.sparkContext.broadcast(_fitted[train_pages, seed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in lots(texts):
                found = iter(model.extract([t for t in texts[i:j] if t is not None]))
                rows = [(None, 0, 0) if t is None else next(found) for t in texts[i:j]]
                text, n, kept = zip(*rows, strict=True)
                cols = [b.column(0).slice(i, j - i), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "text", "n_elements", "n_kept"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "html").mapInArrow(run, "page_id long, text string, n_elements int, n_kept int")
