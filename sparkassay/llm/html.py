"""Main text of web pages from a tree-structured graphical model over the DOM.

A page is parsed into its block elements; inline markup only adds text to them.  What is never shown (scripts, styles,
controls, vector graphics, elements hidden by attribute) is left out of tree and text and breaks no block.  Every block
is a binary variable, content or not; so is an inline element that is named like an advert.  Its features (tag, words of
class and id, amount of text, share of link text) give a unary potential, and each parent-child edge a pairwise one, by
the kind of the child.  Sum-product messages go up from the leaves and back down, which on a tree gives exact marginals;
text of nodes whose marginal of being content is above one half is kept.  Edges carry what a container is (comments, a
sidebar) to plain paragraphs inside it.

Weights are trained on labelled pages by gradient ascent on the likelihood, whose gradient is the observed less the
expected counts, these again from sum-product.  Given tables have no page labels, so the labelled pages come from a
generator here (``labelled_pages``) that composes articles and the usual furniture around them, under names that the
features know and under names that they don't.

Reading is linear in the page at any depth of nesting: the open elements of each name are kept by depth, so no end tag
searches the stack.  Rows are independent: a scan and one Arrow stage, no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import slices

# Element names by what the parser does with them.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"template", "svg", "math", "object", "select", "optgroup", "option", "button", "canvas", "audio", "video", "datalist", "label", "legend", "progress", "meter", "output"}
BLOCKS = set(
    "html body main article section nav header footer aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption details summary address dialog menu search center hgroup fieldset".split()
)
CLOSES_P = BLOCKS - {"html", "body", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: A start tag closes the nearest open element of the first group, unless one of the second is nearer.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
} | {t: (("thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")}
CELLS = ("td", "th", "caption", "table")
TABLE_PARTS = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
WORDS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip toolbar links sitemap",
    "edge": "header masthead footer foot bottom top copyright legal colophon topbar logo brand",
    "side": "sidebar side aside rail widget widgets related recommended recommendation trending popular more teaser archive",
    "talk": "comment comments reply replies discussion disqus respond reader readers thread feedback response responses reviews",
    "note": "notice cookie cookies consent alert popup modal overlay gdpr privacy warning message toast paywall disclaimer newsletter subscribe subscription signup",
    "form": "form search login register input contact",
    "share": "share sharing social follow tags tag meta byline author date",
    "text": "article content post story entry main body text page prose news blog",
}
_WORD = {w: g for g, ws in WORDS.items() for w in ws.split()}
_TAGS = "html body main article section nav header footer aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption details address dialog menu".split()
_CHILD = {"p": 0, "pre": 0, "blockquote": 0, "figure": 0, "figcaption": 0} | {f"h{i}": 1 for i in range(1, 7)} | {t: 2 for t in ("ul", "ol", "li", "dl", "dt", "dd")} | {t: 3 for t in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")} | {"div": 4, "section": 4} | {"article": 5, "main": 5} | {t: 6 for t in ("nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset")}
INLINE, KINDS = 7, 8
_NAMES = [f"tag:{t}" for t in _TAGS] + ["tag:other"] + [f"word:{g}" for g in WORDS] + [f"size:{i}" for i in range(5)] + [f"link:{i}" for i in range(4)] + ["inline", "always"]
_AT = {n: i for i, n in enumerate(_NAMES)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>?""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDES = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: parent (lower number), tag, word groups, text size, link size; and blocks of text by node."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.groups, self.inline, self.label = [-1], ["html"], [()], [False], [None]
        self.size, self.linked = [0], [0]
        self.segments: list[list[tuple[int, str]]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # Open elements: name, node that text in it belongs to, whether it is shown, depth of the nearest block.
        stack: list[tuple[str, int, bool, int]] = [("html", 0, True, 0)]
        opened: dict[str, list[int]] = {}  # depths at which a name is open
        at, parts, in_link = 0, [], False

        def nearest(*names: str) -> int:
            return max([d[-1] for n in names if (d := opened.get(n))], default=0)

        def text(piece: str) -> None:
            _, node, shown, _ = stack[-1]
            if piece and shown:
                parts.append((node, piece))
                if not piece.isspace():
                    self.size[node] += len(piece)
                    if in_link:
                        self.linked[node] += len(piece)

        def flush() -> None:
            if parts:
                self.segments.append(parts.copy())
                parts.clear()

        def close(depth: int) -> None:
            nonlocal in_link
            while len(stack) > depth:
                name, _, shown, block = stack.pop()
                opened[name].pop()
                if shown and block == len(stack):
                    flush()
                    in_link = False

        def push(name: str, node: int, shown: bool) -> None:
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, node, shown, len(stack) if name in BLOCKS else stack[-1][3]))

        while m := _TOKEN.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name, attributes = m[2].lower(), m[3]
            if m[1]:
                depth = nearest(name)
                if depth and (depth > nearest(*CELLS) if name in BLOCKS - TABLE_PARTS else depth >= nearest("table") if name in BLOCKS else depth > stack[-1][3]):
                    close(depth)
                if name == "a":
                    in_link = False
                continue
            if name == "br" or name == "hr":
                text(" ")
            if name in VOID or name == "head":
                continue
            if name in RAW:
                at = self._raw_end(source, at, name)
                continue
            if name == "a":
                in_link = True
            shown = stack[-1][2] and name not in HIDDEN and not (attributes and _HIDES.search(attributes))
            if name in BLOCKS:
                if name == "html" or name == "body" and opened.get("body"):
                    self._describe(0, attributes)
                    continue
                if name in CLOSES_P and (depth := nearest("p")) > nearest("button", "object", *CELLS):
                    close(depth)
                elif name in CLOSES and (depth := nearest(*CLOSES[name][0])) > nearest(*CLOSES[name][1]):
                    close(depth)
                shown = stack[-1][2] and (shown or name == "body")
                if shown:
                    flush()
                    in_link = False
                    push(name, self._node(name, attributes, stack[-1][1], False), True)
                else:
                    push(name, stack[-1][1], False)
            elif not shown or opened.get(name):
                push(name, stack[-1][1], shown)
            elif attributes and name != "a" and "ad" in self._words(attributes):
                push(name, self._node(name, attributes, stack[-1][1], True), True)
        text(source[at:])
        flush()

    @staticmethod
    def _raw_end(source: str, at: int, name: str) -> int:
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
        return m.end() if m else len(source)

    def _node(self, name: str, attributes: str, parent: int, inline: bool) -> int:
        self.parent.append(parent)
        self.tag.append(name)
        self.groups.append(())
        self.inline.append(inline)
        self.label.append(None)
        self.size.append(0)
        self.linked.append(0)
        number = len(self.tag) - 1
        if attributes:
            self._describe(number, attributes)
        return number

    @staticmethod
    def _words(attributes: str) -> set[str]:
        return {_WORD[w] for value in _NAMED.findall(attributes) for part in _CAMEL.findall(value) if (w := part.lower()) in _WORD}

    def _describe(self, number: int, attributes: str) -> None:
        self.groups[number] = tuple(sorted({*self.groups[number], *self._words(attributes)}))
        if label := _LABEL.search(attributes):
            self.label[number] = int(label[1])

    def blocks(self, shown: list[bool]) -> Iterator[str]:
        """Text of each block, of the nodes shown alone: references decoded, white space made one space."""
        for segment in self.segments:
            whole = " ".join(entities.unescape("".join([t for i, t in segment if shown[i]])).split())
            if whole:
                yield whole

    def features(self) -> list[list[int]]:
        size, linked = self.size.copy(), self.linked.copy()
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        out = []
        for i, tag in enumerate(self.tag):
            n = size[i]
            share = linked[i] / n if n else 0
            f = [_AT.get(f"tag:{tag}", _AT["tag:other"]), _AT[f"size:{(n > 0) + (n > 20) + (n > 80) + (n > 300)}"], _AT[f"link:{0 if not share else 1 if share < 0.2 else 2 if share < 0.5 else 3}"], _AT["always"]]
            f += [_AT[f"word:{g}"] for g in self.groups[i]]
            if self.inline[i]:
                f.append(_AT["inline"])
            out.append(f)
        return out

    def kinds(self) -> list[int]:
        return [INLINE if inline else _CHILD.get(t, 4) for t, inline in zip(self.tag, self.inline, strict=True)]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


def sum_product(parent: list[int], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Marginals of each node being 1, and the joint ones of (parent, child) as [00, 01, 10, 11] per node.

    ``unary`` is the log-odds of 1; ``pair`` the four log-potentials of each node with its parent.  Parents have
    lower numbers than their children.
    """
    n = len(parent)
    zero, one = [0.0] * n, list(unary)
    up0, up1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):  # upward
        q = pair[i]
        up0[i], up1[i] = _add(q[0] + zero[i], q[1] + one[i]), _add(q[2] + zero[i], q[3] + one[i])
        zero[parent[i]] += up0[i]
        one[parent[i]] += up1[i]
    marginal, joint = [0.0] * n, [[0.0] * 4 for _ in range(n)]
    down0, down1 = [0.0] * n, [0.0] * n
    for i in range(n):  # downward
        if i:
            p, q = parent[i], pair[i]
            # All that the parent knows but from this child.
            a0, a1 = zero[p] + down0[p] - up0[i], one[p] + down1[p] - up1[i]
            cell = [a0 + q[0] + zero[i], a0 + q[1] + one[i], a1 + q[2] + zero[i], a1 + q[3] + one[i]]
            top = max(cell)
            weights = [math.exp(c - top) for c in cell]
            total = sum(weights)
            joint[i] = [w / total for w in weights]
            down0[i], down1[i] = _add(a0 + q[0], a1 + q[2]), _add(a0 + q[1], a1 + q[3])
            marginal[i] = joint[i][1] + joint[i][3]
        else:
            marginal[0] = 1 / (1 + math.exp(min(700.0, zero[0] - one[0])))
    return marginal, joint


class Model:
    def __init__(self) -> None:
        self.unary = np.zeros(len(_NAMES))
        self.pair = np.zeros((KINDS, 4))

    def marginals(self, page: Page) -> tuple[list[float], list[list[float]], list[list[int]]]:
        features, weights, pair = page.features(), self.unary.tolist(), self.pair.tolist()
        return *sum_product(page.parent, [sum(weights[j] for j in f) for f in features], [pair[k] for k in page.kinds()]), features

    def fit(self, pages: list[Page], rounds: int = 25, rate: float = 0.5, shrink: float = 1e-3, seed: int = 5) -> None:
        """Stochastic gradient ascent on the likelihood of the labelled nodes (all nodes of a page are labelled)."""
        rng = random.Random(seed)
        order = list(range(len(pages)))
        for r in range(rounds):
            rng.shuffle(order)
            now = rate / (1 + r / 4)
            for x in order:
                page = pages[x]
                marginal, joint, features = self.marginals(page)
                grad_u, grad_p = np.zeros_like(self.unary), np.zeros_like(self.pair)
                for i, k in enumerate(page.kinds()):
                    y = page.label[i]
                    for j in features[i]:
                        grad_u[j] += y - marginal[i]
                    if i:
                        grad_p[k] -= joint[i]
                        grad_p[k][2 * page.label[page.parent[i]] + y] += 1
                scale = now / math.sqrt(len(page.tag))
                self.unary += scale * grad_u - now * shrink * self.unary
                self.pair += scale * grad_p - now * shrink * self.pair

    def text(self, source: str) -> str:
        page = Page(source)
        marginal, _, _ = self.marginals(page)
        return "\n".join(page.blocks([m > 0.5 for m in marginal]))


def labelled_pages(count: int = 160, seed: int = 3) -> list[str]:
    """Generated pages whose nodes carry data-y: 1 in the article, else 0."""
    rng = random.Random(seed)

    def other() -> str:
        """A name that no feature knows."""
        return "".join(rng.choice("qwxzvj") + rng.choice("aeiou") for _ in range(3)) + rng.choice(["", "-1", "__k"])

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def el(tag: str, y: int, inside: str, name: str = "") -> str:
        return f'<{tag} data-y="{y}"' + (f' class="{name}"' if name else "") + f">{inside}</{tag}>"

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/x">{words(a, b)}</a>'

    def prose(y: int, least: int, most: int) -> str:
        out = []
        for _ in range(rng.randint(least, most)):
            text = words(1, 90) + "."
            if rng.random() < 0.15:
                text = text[: len(text) // 2] + " " + link() + text[len(text) // 2 :]
            if rng.random() < 0.08:
                text += el("span", 0, words(1, 6), name("ad"))
            r = rng.random()
            if r < 0.1:
                out.append(el(rng.choice(["h2", "h3"]), y, words(2, 8)))
            elif r < 0.16:
                out.append(el("ul", y, "".join(el("li", y, words(3, 20)) for _ in range(rng.randint(2, 5)))))
            elif r < 0.2:
                out.append(el("blockquote", y, el("p", y, text)))
            elif r < 0.25:
                out.append(table(y))
            elif r < 0.28:
                out.append(el("details", y, el("summary", y, words(1, 6)) + el("p", y, text)))
            elif r < 0.31:
                out.append(el("figure", y, "<img src=x>" + el("figcaption", y, words(2, 12))))
            elif r < 0.34:
                out.append(el("pre", y, words(3, 30)))
            elif r < 0.37:
                out.append(el("dl", y, el("dt", y, words(1, 3)) + el("dd", y, words(2, 15))))
            elif r < 0.42:
                out.append(el("div", y, el("p", y, text), rng.choice(["", other()])))
            else:
                out.append(el("p", y, text))
        return "".join(out)

    def table(y: int) -> str:
        rows = "".join(el("tr", y, "".join(el("td", y, words(1, 5)) for _ in range(3))) for _ in range(rng.randint(1, 4)))
        return el("table", y, (el("thead", y, el("tr", y, "".join(el("th", y, words(1, 2)) for _ in range(3)))) + el("tbody", y, rows)) if rng.random() < 0.5 else rows)

    def menu(y: int = 0) -> str:
        return el("ul", y, "".join(el("li", y, link()) for _ in range(rng.randint(3, 9))))

    def name(group: str) -> str:
        return rng.choice(["", "site-", "main-" if group == "menu" else "", "block-"]) + rng.choice(WORDS[group].split())

    def furniture() -> str:
        r = rng.randrange(12)
        if r == 0:
            return el("nav", 0, menu(), rng.choice(["", name("menu")]))
        if r == 1:
            return el("div", 0, menu(), name("menu"))
        if r == 2:
            return el("header", 0, rng.choice([el("h1", 0, words(1, 3)), el("div", 0, link(), "logo"), ""]) + el("p", 0, words(2, 8)), rng.choice(["", name("edge")]))
        if r == 3:
            return el(rng.choice(["div", "footer"]), 0, words(3, 25) if rng.random() < 0.6 else el("p", 0, words(3, 30)) + menu(), name("edge"))
        if r == 4:
            return el(rng.choice(["aside", "div", "section"]), 0, el("h3", 0, words(1, 3)) + (menu() if rng.random() < 0.5 else prose(0, 1, 3)), name("side"))
        if r == 5:
            return el("aside", 0, prose(0, 1, 2) if rng.random() < 0.6 else el("h4", 0, words(1, 3)) + menu())
        if r == 6:
            return el(rng.choice(["div", "section", "p"]), 0, words(3, 40), name("ad")) if rng.random() < 0.6 else el("div", 0, prose(0, 1, 2), name("ad"))
        if r == 7:
            return el(rng.choice(["div", "section"]), 0, el("p", 0, words(4, 30)) if rng.random() < 0.6 else words(4, 40), name("note"))
        if r == 8:
            return el("form", 0, words(1, 6) + "<input name=q>" + rng.choice(["", el("p", 0, words(2, 20)), el("div", 0, words(2, 12)), el("fieldset", 0, words(1, 9))]), rng.choice(["", name("form")]))
        if r == 9:
            return rng.choice([el("div", 0, link() + " " + link(), name("share")), el("div", 0, menu(), other()), el("div", 0, table(0), name("side"))])
        if r == 10:
            return talk()
        return el("footer", 0, words(2, 20), rng.choice(["", name("edge")]))

    def talk() -> str:
        one = lambda: el(rng.choice(["div", "li", "article"]), 0, prose(0, 1, 2), rng.choice(["comment", "reply", "comment-body", ""]))
        return el(rng.choice(["section", "div"]), 0, rng.choice(["", el("h3", 0, words(1, 3))]) + "".join(one() for _ in range(rng.randint(1, 4))), name("talk"))

    def article() -> str:
        head = el("h1", 1, words(2, 10)) if rng.random() < 0.8 else ""
        if head and rng.random() < 0.2:
            head = el("header", 1, head)
        inside = head + prose(1, 1, 9) if rng.random() < 0.85 else head + el("section", 1, el("h2", 1, words(1, 5)) + prose(1, 1, 4), rng.choice(["", other()])) + prose(1, 0, 3)
        if rng.random() < 0.35:
            cut = inside.find("<p", len(inside) // 2)
            inside = inside[:cut] + furniture() + inside[cut:] if cut > 0 else inside
        if rng.random() < 0.3:
            inside += rng.choice([talk, furniture])()
        r = rng.random()
        if r < 0.55:
            return el("article", 1, inside, rng.choice(["", name("text"), other()]))
        if r < 0.7:
            return el("main", 1, inside)
        out = el("div", 1, inside, rng.choice([name("text"), name("text"), other(), ""]))
        return el("main", 1, out) if r < 0.8 else out

    out = []
    for _ in range(count):
        before, after = ("".join(furniture() for _ in range(rng.randint(0, 4))) for _ in range(2))
        body = before + article() + after
        if rng.random() < 0.3:
            body = el("div", 0, body, rng.choice(["", "wrapper", "container", "page", other()]))
        out.append('<!DOCTYPE html><html data-y="0"><head data-y="0"><title>x</title></head>' + el("body", 0, body) + "</html>")
    return out


_FITTED: list[Model] = []


def fitted() -> Model:
    """The model trained on the generated pages, once per process."""
    if not _FITTED:
        pages = [Page(p) for p in labelled_pages()]
        for page in pages:
            page.label = [y if y is not None else 0 for y in page.label]
        model = Model()
        model.fit(pages)
        _FITTED.append(model)
    return _FITTED[0]


def _texts(unary: np.ndarray, pair: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model()
        model.unary, model.pair = unary, pair
        for batch in slices(batches, "html"):
            texts = [model.text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    White space inside a block becomes one space, blocks are trimmed and joined by line feeds in page order, and
    character references are decoded; a line break inside a block counts as white space.  Null, empty and blank
    pages have empty text.  Repeated rows and null ids each keep their row.  Nested or unclosed markup of any depth
    is read to its end, in time that grows with the page alone.  Other columns are left out.
    """
    model = fitted()
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return plain.mapInArrow(_texts(model.unary, model.pair), "page_id long, url string, text string, n_chars long")
