"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of its elements; inline ones belong to the element they stand in. Each node has a hidden
label, content or not. Its potentials are the tag, words of class, id and role, text length and link share; an
edge couples a node with its parent, unless it stands in what by its name is no content. Sum-product
messages go up from the leaves and down from the root, which gives each node's exact marginal in time linear in
the nodes; text of nodes of more than 1/2 is the main text.

Learning: potentials are smoothed counts over a bounded sample of labelled pages (PAGES, least by a hash of the
whole row): pages that mark their article label themselves. LEXICON holds words of classes that a sample may
lack. Pages without such a mark are never labels, only inputs.

Tags are read by the rules of HTML: a quote opens a value only after the sign of equality, an unclosed quote
ends with its word. Scripts and styles run to their end tag, unclosed ones to the end of the page, as in any
browser. What is only shown by other means (lists of choices, drawings, players, templates, text fields) holds
no text, but where such an element is never closed, its tag alone is left out; a block element ends an unclosed
drawing or list of choices. Formulas, noscript and object keep their text. Text that stands in no element at
all is a page's main text. Elements deeper than DEPTH become siblings, so every page takes linear time.

Null and empty html give an empty text; so do pages without content. Broken markup never fails: unclosed
elements end with their parent, stray ends are skipped. Rows that repeat are each answered, and so are rows
with a null page_id or url; other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch

#: Labelled pages that are learned from, at most.
PAGES = 2_000

DEPTH = 512

# The element names of HTML by kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var object picture slot output meter progress".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics menclose mfenced".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("svg select datalist template video audio canvas annotation annotation-xml".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt td th tr".split())
BLOCK = ENDS_P | frozenset("html head body tbody thead tfoot caption colgroup legend option optgroup frameset listing xmp marquee".split())
BREAKS_OUT = (ENDS_P | {"body", "head"}) - {"summary", "search"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
SCOPES = frozenset("td th caption".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
ARTICLE = frozenset(("article", "main"))
NO_CONTENT = frozenset("nav header footer aside form head title menu dialog button".split())
LEXICON = {
    1: "article content main post entry story body text".split(),
    0: "ad ads advert advertisement banner promo sponsor nav navbar menu header footer sidebar aside widget cookie notice alert consent popup modal comment comments reply form newsletter subscribe signup login search share social related breadcrumb pagination tags copyright legal".split(),
}
#: The tag of the one node of a page without elements.
SOLE = "#page"
#: The most that a learned feature counts; what words and names of LEXICON, NO_CONTENT and ARTICLE count; the least chance that a child of content is none and that content begins in what isn't, and the chance that it stands in a region that is none.
WEIGHT, LIKELY, UNLIKELY, MARKED, LEAVES, BEGINS, ENTERS = 1.0, 2.0, -12.0, 6.0, 0.002, 0.4, 1e-4

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|=)*+)(?P<close>>|\Z)"
    r"|<(?:[!?]|/[^a-zA-Z])[^>]*>?|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN_END = re.compile(r"</(" + "|".join(sorted(HIDDEN)) + r")(?=[\s/>])", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Page:
    """Elements in page order: parent, tag, words of their attributes, characters and linked characters; blocks: lists of (node, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words = [-1], ["#root"], [()]
        self.chars, self.linked = [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self.source, self.stack, self.open, self.hidden, self.implied = source, [("#root", 0)], Counter(), 0, 0
        self._last_end: dict[str, int] | None = None
        self._read()
        if self.implied and len(self.tag) == 2:
            self.tag[self.implied] = SOLE

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(tuple({w for x in _ATTR.findall(attrs) for w in _WORD.findall("".join(x).lower())}) if attrs else ())
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def _push(self, tag: str, node: int) -> None:
        if len(self.stack) > DEPTH:
            self._pop()
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        return tag

    def _close(self, tag: str) -> bool:
        """End the innermost open element of this name, and all in it; not across a table's cell unless the name is a table's."""
        if not self.open[tag]:
            return False
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            if self.stack[k][0] in SCOPES and tag not in TABLE:
                return False
            k -= 1
        while len(self.stack) > k:
            self._pop()
        return True

    def _ends_later(self, tag: str, at: int) -> bool:
        if self._last_end is None:
            self._last_end = {m[1].lower(): m.start() for m in _HIDDEN_END.finditer(self.source)}
        return self._last_end.get(tag, -1) >= at

    def _break_out(self, tag: str) -> None:
        """A block element ends a drawing or a list of choices that was left open."""
        if tag in BREAKS_OUT and (self.open["svg"] or self.open["select"]) and not self.open["foreignobject"] and not self.open["template"]:
            for outer in ("svg", "select"):
                while self.open[outer]:
                    self._pop()

    def _read(self) -> None:
        source, at, links, fresh, unclosed = self.source, 0, 0, True, set()
        match, stack = _TOKEN.match, self.stack
        while at < len(source):
            m = match(source, at)
            at = m.end()
            if (text := m["text"]) is not None:
                if self.hidden:
                    continue
                n = len(text.strip())
                node = stack[-1][1]
                if n and self.tag[node] in ("#root", "html"):
                    self.implied = node = self.implied or self._node("body", "", node)
                if fresh:
                    self.blocks.append([])
                    fresh = False
                self.blocks[-1].append((node, text))
                self.chars[node] += n
                self.linked[node] += n if links else 0
                continue
            if m["tag"] is None or not m["close"]:
                continue
            tag, end, attrs = m["tag"].lower(), m["end"], m["attrs"]
            if tag in MATH:
                continue
            if tag in RAW and not end:
                if self.open["svg"] and tag == "title":
                    continue
                found = None if tag in unclosed else _RAW_END[tag].search(source, at)
                if found:
                    at = found.end()
                elif tag in ("script", "style"):
                    return
                else:
                    unclosed.add(tag)
                continue
            if tag in INLINE:
                if tag == "a":
                    links = 0 if end else 1
                continue
            if tag in VOID:
                if tag == "br" and not fresh:
                    self.blocks[-1].append((stack[-1][1], " "))
                elif tag == "hr":
                    self._break_out(tag)
                    fresh = True
                continue
            if tag in BLOCK:
                fresh, links = True, 0
            if end:
                if tag not in ("html", "body"):
                    self._close(tag)
                continue
            if self.hidden:
                self._break_out(tag)
                if tag == "select" and self.open["select"]:
                    self._close("select")
            if tag in HIDDEN:
                if not attrs.endswith("/") and (tag in ("svg", "select") or self._ends_later(tag, at)):
                    self._push(tag, stack[-1][1])
                continue
            if self.hidden:
                if tag == "foreignobject":
                    self._push(tag, stack[-1][1])
                continue
            if tag in ("html", "body") and self.open[tag]:
                continue
            if tag in ENDS_P and self.open["p"]:
                k = len(stack) - 1
                while stack[k][0] not in BLOCK and k:
                    k -= 1
                if stack[k][0] == "p":
                    self._close("p")
            if tag in CLOSES and any(self.open[x] for x in CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in HOLDS.get(tag, ()):
                        break
                    if stack[k][0] in CLOSES[tag]:
                        while len(stack) > k:
                            self._pop()
                        break
            if len(stack) > DEPTH:
                self._pop()
            node = self._node(tag, attrs, stack[-1][1])
            if not attrs.endswith("/") or tag in BLOCK:
                self._push(tag, node)

    def features(self) -> list[list[str]]:
        """Each node's features; those of text only where it has some of its own."""
        out = []
        for tag, words, n, linked in zip(self.tag, self.words, self.chars, self.linked):
            text = [f"chars {min(8, n.bit_length())}", f"links {linked * 4 // n}"] if n else []
            out.append([f"tag {tag}", *text, *(f"word {w}" for w in words)])
        return out

    def regions(self) -> list[int]:
        """1 for each node that by its own or an outer element's name or words is no content, else 0."""
        boiler, out = {*LEXICON[0]}, [0] * len(self.tag)
        for k in range(1, len(out)):
            out[k] = int(out[self.parent[k]] or self.tag[k] in NO_CONTENT or bool(boiler & {*self.words[k]}))
        return out

    def labels(self) -> list[int] | None:
        """1 inside an article, 0 outside and in what never is content; None where no article is marked."""
        if not ARTICLE & {*self.tag}:
            return None
        y, region = [0] * len(self.tag), self.regions()
        for k in range(1, len(y)):
            y[k] = 0 if region[k] else 1 if self.tag[k] in ARTICLE else y[self.parent[k]]
        return y


def count(sources: list[str]) -> Counter:
    """(feature, label) of all nodes and (edge and region of the child, both labels) of all edges of labelled pages."""
    sums: Counter = Counter()
    for source in sources:
        page = Page(source)
        y = page.labels()
        if y is None:
            continue
        region = page.regions()
        for k, found in enumerate(page.features()):
            sums.update((f, y[k]) for f in found)
            sums[("nodes", y[k])] += 1
            if k:
                sums[(f"edge {region[k]}", 2 * y[page.parent[k]] + y[k])] += 1
    return sums


class Model:
    """Log-odds of features, and P(label | parent's label) outside and inside of regions that are no content; within these it is the same whatever the parent, so a form tells nothing of what it stands in.

    What pages are learned from is narrow (a list that no article of the sample holds may well stand in another), so a
    feature by itself counts up to WEIGHT, and edges decide where no name or word speaks against it.
    """

    def __init__(self, sums: Counter):
        nodes = [sums[("nodes", y)] + 50 for y in (0, 1)]
        self.node: dict[str, float] = {}
        for f in {f for f, _ in sums if f[:5] not in ("nodes", "edge ")}:
            p = [(sums[(f, y)] + 0.5) / (nodes[y] + 1) for y in (0, 1)]
            self.node[f] = max(-WEIGHT, min(WEIGHT, math.log(p[1] / p[0])))
        for y, words in LEXICON.items():
            for w in words:
                self.node[f"word {w}"] = max(self.node.get(f"word {w}", 0.0), LIKELY) if y else UNLIKELY
        self.node |= {f"tag {t}": UNLIKELY * 5 for t in NO_CONTENT} | {f"tag {t}": MARKED for t in (*ARTICLE, SOLE)}
        n = [sums[("edge 0", k)] for k in range(4)]
        begins, stays = max(BEGINS, (n[1] + 1) / (n[0] + n[1] + 10)), min(1 - LEAVES, (n[3] + 9) / (n[2] + n[3] + 10))
        self.edge = [[[1 - begins, begins], [1 - stays, stays]], [[1 - ENTERS, ENTERS]] * 2]

    def marginals(self, page: Page) -> list[float]:
        """Of content, for each node: messages upward from the leaves, then downward from the root."""
        parent, get, region = page.parent, self.node.get, page.regions()
        n = len(parent)
        own = []
        for found in page.features():
            x = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(get(f, 0.0) for f in found)))))
            own.append((1 - x, x))
        belief, sent = [list(x) for x in own], [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):  # a child stands after its parent
            b0, b1 = belief[k]
            e = self.edge[region[k]]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            s = m0 + m1
            sent[k] = (m0 / s, m1 / s)
            p = belief[parent[k]]
            p[0], p[1] = p[0] * sent[k][0], p[1] * sent[k][1]
            s = p[0] + p[1]
            p[0], p[1] = p[0] / s, p[1] / s
        belief[0] = [1.0, 0.0]  # the page itself is no content
        out = [0.0] * n
        for k in range(1, n):
            p, up, e = belief[parent[k]], sent[k], self.edge[region[k]]
            c0, c1 = p[0] / max(up[0], 1e-300), p[1] / max(up[1], 1e-300)  # the parent without this child's message
            s = c0 + c1
            c0, c1 = c0 / s, c1 / s
            b = belief[k]
            b[0], b[1] = b[0] * (c0 * e[0][0] + c1 * e[1][0]), b[1] * (c0 * e[0][1] + c1 * e[1][1])
            s = b[0] + b[1]
            b[0], b[1] = b[0] / s, b[1] / s
            out[k] = b[1]
        return out

    def text(self, source: str) -> str:
        page = Page(source)
        content = self.marginals(page)
        blocks = (" ".join(entities.unescape("".join(x for node, x in parts if content[node] > 0.5)).split()) for parts in page.blocks)
        return "\n".join(b for b in blocks if b)


def train(pages: DataFrame, most: int = PAGES) -> Model:
    """From at most `most` pages; what is counted is sums of features, whose number does not grow with the pages beyond them."""
    named = pages.where("html is not null").select(F.xxhash64("page_id", "url", "html").alias("_wm_h"), "html")
    chosen = named.select("_wm_h").distinct().orderBy("_wm_h").limit(most)

    def run(batches):
        sums: Counter = Counter()
        for b in batches:
            sums.update(count(b.column("html").to_pylist()))
        yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in sums], pa.string()), "label": pa.array([y for _, y in sums], pa.int32()), "n": pa.array([*sums.values()], pa.int64())})

    rows = named.join(F.broadcast(chosen), "_wm_h", "left_semi").dropDuplicates(["_wm_h"]).select("html")
    got = rows.mapInArrow(run, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    return Model(Counter({(x["feature"], x["label"]): x["n"] for x in got.toLocalIterator()}))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.text(x) for x in b.column("html").to_pylist()]
        return b.drop_columns(["html"]).append_column("text", pa.array(found, pa.string())).append_column("n_chars", pa.array(map(len, found), pa.int64()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(each_batch(run), "page_id long, url string, text string, n_chars long")
