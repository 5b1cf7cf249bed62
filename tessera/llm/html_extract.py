"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a binary variable: part of the main content (or on the way to it) or not. A node's
own potential is a logistic model of its tag, class and id words, length, links and place; a parent-child potential,
by the parent's kind, ties neighbours. Sum-product messages upward from the leaves and downward from the root give
each node's exact marginal, and text of nodes above one half is the page's text. Names weigh little where an element
holds most of the text around it, so an article inside a `form` or a `section class="more"` is still one. Potentials are
trained from labelled pages: html_pages makes a default set, and `train` takes any pages marked in the same way.

One scan, no shuffle; a page is handled by itself, and the model (some hundred numbers) travels with the task.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.html_pages import CLOSE, OPEN, pages
from tessera.llm.html_tree import Node, attributes, parse
from tessera.llm.shared import lean, text_array

#: Made pages of the default model, and the share of odd ones among them.
TRAIN_PAGES, TRAIN_ODD = 1500, 0.3

# Words of class names, ids and roles, by what they say of an element.
_SAYS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip sitemap",
    "edge": "header masthead topbar top footer bottom banner contentinfo copyright site legal colophon",
    "side": "sidebar side aside related recommended recommendation more widget complementary rail trending popular",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp banner outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal dialog overlay newsletter subscribe subscription paywall signup toast disclaimer warning",
    "form": "form search login signin register contact feedback",
    "comment": "comment comments reply replies respond disqus discussion reader responses commentlist",
    "share": "share sharing social follow tags tag meta byline author likes buttons toolbar",
    "main": "article main content post entry story body text page prose blog",
}
_KIND_OF_WORD = {w: k for k, ws in _SAYS.items() for w in ws.split()}
_TAGS = {
    "article": ("article", "main"),
    "box": ("div", "section", "center", "details"),
    "nav": ("nav", "menu"),
    "header": ("header", "hgroup"),
    "footer": ("footer",),
    "aside": ("aside", "dialog"),
    "form": ("form", "fieldset", "legend"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "prose": ("p", "blockquote", "pre", "figure", "figcaption", "dd", "dt", "dl"),
    "list": ("ul", "ol", "li", "dir"),
    "table": ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
}
_KIND_OF_TAG = {t: k for k, ts in _TAGS.items() for t in ts}
_WITHIN = (*_SAYS, "tag article", "tag nav", "tag header", "tag footer", "tag aside", "tag form")
#: what an element is called says less where the element holds most of the text around it: features of their own
_MOST = " most"
_NAMED = [f"{w} {k}{m}" for w, ks in (("says", _SAYS), ("within", _WITHIN)) for k in ks for m in ("", _MOST)]
_NAMES = ["bias", *(f"tag {k}" for k in _TAGS), *_NAMED, "named prose", "named prose in article", "hidden", "length", "share", "no text", "link share", "ends a sentence", "few words", "link list", "link list in article", "place", "depth"]
_AT = {x: k for k, x in enumerate(_NAMES)}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_said: dict[str, tuple[tuple[str, ...], bool]] = {}


def _says(text: str) -> tuple[tuple[str, ...], bool]:
    """Kinds that an element's attributes name, and whether it is hidden."""
    known = _said.get(text)
    if known is None:
        a = attributes(text)
        named = " ".join((a.get("class", ""), a.get("id", ""), a.get("role", "")))
        kinds = tuple(dict.fromkeys(_KIND_OF_WORD[w.lower()] for w in _WORD.findall(named) if w.lower() in _KIND_OF_WORD))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        known = kinds, hidden
        if len(_said) < 100_000:
            _said[text] = known
    return known


def parent_kind(node: Node, most: bool = False) -> int:
    """0 a box or the page, 1 an article, 2 a text block or list, 3 an element that names boilerplate. An element that
    holds most of the text around it is taken for a box, whatever it is called."""
    kinds, _ = _says(node.attributes)
    tag = _KIND_OF_TAG.get(node.tag, "box")
    bad = any(k != "main" for k in kinds)
    if not most and (bad or tag in ("nav", "footer", "aside", "form")):
        return 3
    if tag == "article" or "main" in kinds:
        return 1
    return 2 if tag in ("prose", "list", "table", "heading", "header") else 0


@dataclass
class Around:
    """Text below each node, and whether the node holds most of what is around it: at least half of its parent's text
    and a fifth of its article's (of the page's, outside of articles)."""

    chars: list[int]
    links: list[int]
    in_article: list[bool]
    most: list[bool]

    @classmethod
    def of(cls, nodes: list[Node]) -> Around:
        n = len(nodes)
        chars, links = [x.own_chars for x in nodes], [x.link_chars for x in nodes]
        for k in range(n - 1, 0, -1):
            chars[nodes[k].parent] += chars[k]
            links[nodes[k].parent] += links[k]
        inside = [0] * n  # the innermost article around a node, or the root
        for k in range(1, n):
            p = nodes[k].parent
            inside[k] = p if nodes[p].tag in ("article", "main") else inside[p]
        most = [k > 0 and 2 * chars[k] >= chars[nodes[k].parent] > 0 and 5 * chars[k] >= chars[inside[k]] for k in range(n)]
        return cls(chars, links, [x > 0 for x in inside], most)


def features(nodes: list[Node], around: Around | None = None) -> list[tuple[list[int], list[float]]]:
    """Sparse features of each node, in _NAMES' places."""
    around = around or Around.of(nodes)
    out, before, total = [], 0, max(1, around.chars[0])
    above: list[frozenset[str]] = [frozenset()] * len(nodes)  # what a node's ancestors say
    for k, x in enumerate(nodes):
        kinds, hidden = _says(x.attributes)
        tag = _KIND_OF_TAG.get(x.tag, "box")
        chars, links, most = around.chars[k], around.links[k], around.most[k]
        if k:
            p = x.parent
            said = {*_says(nodes[p].attributes)[0], "tag " + _KIND_OF_TAG.get(nodes[p].tag, "box")}.intersection(_WITHIN)
            mark = _MOST if around.most[p] else ""
            more = {f"within {w}{mark}" for w in said} - above[p]
            above[k] = above[p] | more if more else above[p]
        at = [0, _AT["tag " + tag], *(_AT[a] for a in above[k])]
        at += [_AT[f"says {kind}{_MOST if most else ''}"] for kind in kinds]
        if any(kind != "main" for kind in kinds):
            if tag in ("prose", "heading"):
                at.append(_AT["named prose in article" if around.in_article[k] else "named prose"])
        if hidden:
            at.append(_AT["hidden"])
        share = links / chars if chars else 0.0
        if not x.texts:
            at.append(_AT["no text"])
        else:
            last = x.texts[-1][1]
            if last[-1] in ".!?…\"'”’)":
                at.append(_AT["ends a sentence"])
            if last.count(" ") < 4:
                at.append(_AT["few words"])
        if share > 0.6 and x.tag in ("ul", "ol", "li"):
            at.append(_AT["link list in article" if around.in_article[k] else "link list"])
        value = [1.0] * len(at)
        at += (_AT["length"], _AT["share"], _AT["link share"], _AT["place"], _AT["depth"])
        value += (math.log1p(chars) / 8, chars / total, share, before / total, min(x.depth, 10) / 10)
        before += x.own_chars
        out.append((at, value))
    return out


@dataclass
class PageModel:
    """weights: of the logistic node potentials. pair[kind][parent state][child state]: the edge potentials."""

    weights: list[float]
    pair: list[list[list[float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, exact on the tree; the root is content."""
        n, w = len(nodes), self.weights
        own0, own1 = [1.0] * n, [1.0] * n
        around = Around.of(nodes)
        for k, (at, value) in enumerate(features(nodes, around)):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in zip(at, value, strict=True))))))
            own0[k], own1[k] = max(1 - p, 1e-12), max(p, 1e-12)
        own0[0], own1[0] = 0.0, 1.0
        kind = [parent_kind(x, m) for x, m in zip(nodes, around.most, strict=True)]
        up0, up1 = [1.0] * n, [1.0] * n  # from a node to its parent
        in0, in1 = own0[:], own1[:]  # own potential times what children sent
        for k in range(n - 1, 0, -1):
            p = nodes[k].parent
            t = self.pair[kind[p]]
            a, b = t[0][0] * in0[k] + t[0][1] * in1[k], t[1][0] * in0[k] + t[1][1] * in1[k]
            up0[k], up1[k] = a / (a + b), b / (a + b)
            x, y = in0[p] * up0[k], in1[p] * up1[k]
            in0[p], in1[p] = x / (x + y), y / (x + y)
        out0, out1 = in0[:], in1[:]
        for k in range(1, n):  # parents come before their children
            p = nodes[k].parent
            t = self.pair[kind[p]]
            a, b = out0[p] / max(up0[k], 1e-300), out1[p] / max(up1[k], 1e-300)
            a, b = a / (a + b), b / (a + b)
            x, y = in0[k] * (a * t[0][0] + b * t[1][0]), in1[k] * (a * t[0][1] + b * t[1][1])
            out0[k], out1[k] = x / (x + y), y / (x + y)
        return out1

    def text(self, page: str) -> str:
        """The main text: blocks in page order, joined by one space."""
        nodes = parse(page)
        runs = [r for x, p in zip(nodes, self.marginals(nodes), strict=True) if p > 0.5 for r in x.texts]
        return " ".join(t for _, t in sorted(runs))


def labelled(page: str) -> tuple[list[Node], list[int]]:
    """Nodes and states of a marked page: content if it or anything inside it is marked."""
    nodes = parse(page)
    state = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        if any(OPEN in t for _, t in x.texts):
            state[k] = 1
        x.texts = [(o, t.replace(OPEN, "").replace(CLOSE, "")) for o, t in x.texts]
        if state[k] and x.parent >= 0:
            state[x.parent] = 1
    return nodes, state


def train(marked: list[str], rounds: int = 30, decay: float = 3e-7) -> PageModel:
    """Potentials from marked pages: logistic regression of nodes, and parent-child counts over the child's own rate."""
    rows, states, counts = [], [], np.full((4, 2, 2), 0.5)
    for page in marked:
        nodes, state = labelled(page)
        around = Around.of(nodes)
        kinds = [parent_kind(x, m) for x, m in zip(nodes, around.most, strict=True)]
        for k, x in enumerate(features(nodes, around)):
            if k == 0:
                continue
            rows.append(x)
            states.append(state[k])
            counts[kinds[nodes[k].parent], state[nodes[k].parent], state[k]] += 1
    x = np.zeros((len(rows), len(_NAMES)))
    for k, (at, value) in enumerate(rows):
        x[k, at] = value
    y = np.array(states, dtype=float)
    w = np.zeros(len(_NAMES))
    for _ in range(rounds):  # Newton's method, with a small penalty
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * len(y) * np.eye(len(w)), x.T @ (y - p) - decay * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = counts.sum(axis=(0, 1)) / counts.sum()
    pair = counts / counts.sum(axis=2, keepdims=True) / rate
    return PageModel(w.tolist(), pair.tolist())


_default: list[PageModel] = []


def default_model() -> PageModel:
    """The model of the made pages, trained once in a process."""
    if not _default:
        _default.append(train(pages(TRAIN_PAGES, odd=TRAIN_ODD)))
    return _default[0]


def extract_text(web: DataFrame, model: PageModel | None = None) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (its code points), one row per input row.

    A null or empty page gives an empty text; a page cut off anywhere is read as far as it goes; very long and deeply
    nested pages are read whole, in time that grows with their length; repeated rows and equal page_ids are each read
    alike; a table without rows gives none; other columns, whatever their names, are not read.
    """
    model = model or default_model()
    kinds = {c: web.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for batch in batches:
            texts = [model.text(x.as_py()) if len(x.as_py()) else "" for x in text_array(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return web.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
