"""Main-text extraction by gradient-boosted trees over DOM-node features, with hierarchical decoding.

A page becomes a tree of block elements. Trees score each node by subtree text, density, links, tokens of its tag,
class, id and role, depth, and its siblings. Decoding then picks the set of nodes with the largest sum of scores among
those sets in which a kept node's parent is kept: a dropped node takes all its descendants along, and a kept node's
ancestors pass it through, so ancestors and descendants never contradict each other.

The model (Spark ML's GBTClassifier) is fitted on the nodes of at most `train_pages` pages, those with the smallest hash
of page_id, in order of page_id, so that it does not depend on how the table is split. Labels come from pages that mark
their main text up (article, main); each training page is used a second time without its tag, class, id and role tokens,
so that structure alone must decide there. A table that has no such pages is labelled by a fixed rule on tokens and links
instead, and trees are fitted to those labels all the same. Scripts, styles, form controls and comments are never text.
Tags are read as the HTML standard does: quoted and unquoted attribute values, quotes inside unquoted ones, nested
templates; a quote that never ends is passed over, and its tag ends at the first `>`. Extraction is one narrow pass.

Defined results: null and empty html give an empty text; unclosed and stray tags are tolerated; an unclosed script, style,
title, textarea or template hides the rest; a head ends at its end tag or at the first tag or text that cannot stand in
it; repeated rows get equal results; equal scores keep a node out; a very long page is one tree in the memory of its
task; columns besides page_id, url and html play no part; an empty table gives no rows, and one without two kinds of nodes
keeps what the fixed rule keeps.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, read, slices

# Elements of HTML by their kind.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center menu dialog".split())
HIDDEN = frozenset("script style noscript template head title textarea select button option svg iframe object canvas".split())
CLOSES_P = BLOCKS - {"html", "body"}
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BOILERPLATE = frozenset("nav navbar navigation menu menubar header masthead footer foot sidebar side aside complementary widget notice notices cookie cookies consent gdpr banner ad ads adv advert advertisement advertising sponsor sponsored promo promotion form search login signup subscribe newsletter share sharing social related recommended comment comments respond reply replies disqus breadcrumb breadcrumbs pagination pager popup modal tags toolbar contentinfo".split())
MAIN = frozenset("article main content post entry story body text articlebody".split())
#: Tags that may stand in a head; others end it, as does text.
IN_HEAD = frozenset("html meta link base".split())
#: Of the hidden ones, those whose content is text up to their end tag, and those that hide what follows even without one.
RAW = frozenset("script style textarea title noscript iframe".split())
ENDLESS = frozenset("script style textarea title template".split())
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)"
#: What follows a tag's name, by the standard's states; without a way back, so that time is linear.
REST = re.compile(rf"(?>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
FEATURES = ["main_self", "boiler_self", "main_above", "boiler_above", "depth", "text", "density", "links", "children", "siblings", "sibling_text", "share", "marks", "place", "paragraph", "own_text"]
LINKS, TOKENS = 7, (0, 1, 2, 3)


def behind(source: str, name: str, at: int) -> int:
    """The place behind a hidden element whose start tag ends at `at`; elements of the same name in it are counted, unless its content is mere text."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).finditer(source, at):
        if not m[1]:
            depth += name not in RAW
            continue
        depth -= 1
        if not depth:
            return m.end()
    return len(source) if name in ENDLESS else at


class Page:
    """A tree of block elements in page order; node 0 is the root, parents come before their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth = ["#root"], [-1], [0]
        self.main, self.boiler = [0], [0]
        self.links = [0]  # characters of links right in the node
        self.blocks: list[tuple[int, str]] = []  # node, text
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, text, link = [0], [], 0

        def flush() -> None:
            if text:
                block = SPACE.sub(" ", "".join(text)).strip()
                text.clear()
                if block:
                    self.blocks.append((stack[-1], block))

        def words(piece: str) -> None:
            if piece:
                piece = entities.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if link:
                    self.links[stack[-1]] += len(piece.strip())

        tag = self.tag
        hidden, at = 0, 0
        while (m := TOKEN.search(source, at)) is not None:
            before = source[at : m.start()]
            if hidden and before.strip():
                hidden = 0
            if not hidden:
                words(before)
            at = m.end()
            if not m[2]:
                continue
            name, closing = m[2].lower(), bool(m[1])
            rest = REST.match(source, at)
            stop = rest.end() if rest else source.find(">", at) + 1 or len(source)
            attributes, at = source[at : stop - 1], stop
            if name in HIDDEN:
                if name == "head":
                    hidden = 0 if closing else 1
                    text.clear()
                elif not closing:
                    at = behind(source, name, at)
                continue
            if hidden and not closing and name not in IN_HEAD:
                hidden = 0
            if name == "a":
                link = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            elif name in BLOCKS:
                flush()
                link = 0
                if closing:
                    if name != "hr" and any(tag[x] == name for x in stack):
                        while tag[stack.pop()] != name:
                            pass
                    continue
                if name in CLOSES_P and tag[stack[-1]] == "p":
                    stack.pop()
                if name in OWN_KIND:
                    for k in range(len(stack) - 1, 0, -1):
                        if tag[stack[k]] in SCOPES.get(name, ()):
                            break
                        if tag[stack[k]] in OWN_KIND[name]:
                            del stack[k:]
                            break
                tokens = [name]
                for a in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
                    tokens += WORD.findall("".join(a).lower())
                self.parent.append(stack[-1])
                self.depth.append(self.depth[stack[-1]] + 1)
                tag.append(name)
                self.main.append(sum(t in MAIN for t in tokens if t != "body" or name != "body"))
                self.boiler.append(sum(t in BOILERPLATE for t in tokens))
                self.links.append(0)
                if name != "hr":
                    stack.append(len(tag) - 1)
        if not hidden or source[at:].strip():
            words(source[at:])
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, marks = [0] * n, [0] * n
        for node, text in self.blocks:
            own[node] += len(text)
            marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        size, links, mark, nodes, children = own[:], self.links[:], marks[:], [1] * n, [0] * n
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            size[p] += size[v]
            links[p] += links[v]
            mark[p] += mark[v]
            nodes[p] += nodes[v]
            children[p] += 1
        child_text, same = [0] * n, {}
        for v in range(1, n):
            child_text[self.parent[v]] += size[v]
            key = (self.parent[v], self.tag[v])
            same[key] = same.get(key, 0) + 1
        above = [(0, 0)] * n
        rows = []
        total = max(size[0], 1)
        seen = 0
        for v in range(n):
            p = self.parent[v]
            if v:
                above[v] = (above[p][0] + self.main[p], above[p][1] + self.boiler[p])
            alike = same.get((p, self.tag[v]), 1)
            mean = (child_text[p] - size[v]) / max(children[p] - 1, 1) if v else 0
            rows.append((self.main[v], self.boiler[v], above[v][0], above[v][1], self.depth[v], math.log1p(size[v]), size[v] / nodes[v], min(links[v] / max(size[v], 1), 1.0), children[v], alike, math.log1p(max(mean, 0)), size[v] / total, 100 * mark[v] / max(size[v], 1), seen / total, self.tag[v] in ("p", "pre", "blockquote", "h1", "h2", "h3"), math.log1p(own[v])))
            seen += own[v]
        return np.array(rows, np.float64)

    def labels(self) -> list[float] | None:
        """1 for nodes most of whose text lies in marked main text outside marked boilerplate; None where the page marks none."""
        if not any(t in ("article", "main") for t in self.tag):
            return None
        n = len(self.tag)
        inside = [False] * n
        for v in range(1, n):
            inside[v] = (inside[self.parent[v]] or self.tag[v] in ("article", "main")) and not self.boiler[v]
        good, size = [0] * n, [0] * n
        for node, text in self.blocks:
            size[node] += len(text)
            good[node] += len(text) * inside[node]
        for v in range(n - 1, 0, -1):
            size[self.parent[v]] += size[v]
            good[self.parent[v]] += good[v]
        return [float(inside[v] if not size[v] else 2 * good[v] > size[v]) for v in range(n)]

    def rule_labels(self) -> list[float]:
        """Labels by the fixed rule, for pages without marks."""
        return [float(x) for x in self.kept(Forest().margins(self.features()))]

    def kept(self, scores: np.ndarray) -> list[bool]:
        """The set of nodes with the largest sum of scores in which each kept node's parent is kept."""
        own = [0] * len(self.tag)
        for node, text in self.blocks:
            own[node] += len(text)
        # a node without text of its own is only a way to others: its score counts little
        gain = [float(s) * (math.log2(2 + x) if x else 0.05) for s, x in zip(scores, own, strict=True)]
        for v in range(len(gain) - 1, 0, -1):
            if gain[v] > 0:
                gain[self.parent[v]] += gain[v]
        keep = [True] * len(gain)
        for v in range(1, len(gain)):
            keep[v] = keep[self.parent[v]] and gain[v] > 0
        return keep

    def text(self, scores: np.ndarray) -> str:
        keep = self.kept(scores)
        return "\n".join(text for node, text in self.blocks if keep[node])


class Forest:
    """A fitted GBTClassifier as arrays: margin of a row = sum over trees of weight times the leaf's value."""

    def __init__(self, model=None):
        self.trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True) if model is not None else ():
            feature, threshold, left, right, value = [], [], [], [], []

            def add(node) -> int:
                i = len(feature)
                for x, y in ((feature, -1), (threshold, 0.0), (left, i), (right, i), (value, float(node.prediction()))):  # noqa: B023
                    x.append(y)
                if node.getClass().getSimpleName() == "InternalNode":
                    feature[i], threshold[i] = int(node.split().featureIndex()), float(node.split().threshold())  # noqa: B023
                    left[i], right[i] = add(node.leftChild()), add(node.rightChild())  # noqa: B023
                return i

            add(tree._java_obj.rootNode())
            self.trees.append((float(weight), *map(np.array, (feature, threshold, left, right, value))))

    def margins(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return 1.0 + rows[:, 0] + rows[:, 2] - 4 * rows[:, 1] - 4 * rows[:, 3] - 2 * (rows[:, LINKS] > 0.6)
        out = np.zeros(len(rows))
        every = np.arange(len(rows))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                goes = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += weight * value[at]
        return out


def disturbed(source: str, token: str) -> str:
    """The page with some of its own paragraphs once more in boilerplate: inside the main text, and behind it."""
    paragraphs = [m for m in re.findall(r"<p>(.*?)</p>", source, re.S) if "<p" not in m][:4]
    if not paragraphs:
        return source
    again = f'<div class="{token}"><h3>{token}</h3>' + "".join(f"<p>{x}</p>" for x in paragraphs) + "</div>"
    short = f'<div id="{token}"><p>{paragraphs[-1][:80]}</p></div>'
    source = re.sub(r"</p>", lambda m: m[0] + short, source, count=1)
    return re.sub(r"(</article>|</main>|\Z)", lambda m: m[0] + again, source, count=1)


def training_rows(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
    """(page_id, part, node, x, label): each page as it is, without tokens, and disturbed twice by words drawn from its id. marked: labels by the page's own marks."""
    words = sorted(BOILERPLATE)
    for batch in batches:
        for page_id, source in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            source = source or ""
            number = zlib.crc32(str(page_id).encode())
            versions = [source, disturbed(source, words[number % len(words)]), disturbed(source, words[(7 * number + 3) % len(words)])]
            out: list[tuple] = []
            for k, version in enumerate(versions):
                page = Page(version)
                labels = page.labels() if marked else page.rule_labels()
                if labels is None:
                    break
                x = page.features()[1:]
                out += [(page_id, k, v, row, y) for v, (row, y) in enumerate(zip(x.tolist(), labels[1:], strict=True))]
                if not k:
                    x[:, TOKENS] = 0
                    out += [(page_id, len(versions), v, row, y) for v, (row, y) in enumerate(zip(x.tolist(), labels[1:], strict=True))]
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page_id", "part", "node", "x", "label"])


def train(pages: DataFrame, train_pages: int = 150) -> Forest:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    for marked in (True, False):
        usable = rows.where(F.col("html").rlike(r"(?i)<(article|main)\b")) if marked else rows.where(F.length("html") > 0)
        chosen = usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).distinct()
        sample = usable.join(F.broadcast(chosen), "page_id", "left_semi").dropDuplicates(["page_id"])  # a bounded sample, small enough for one partition
        nodes = arrow_pass(sample, lambda it, own=marked: training_rows(it, own), "page_id long, part int, node int, x array<double>, label double")
        nodes = nodes.repartition(1).sortWithinPartitions("page_id", "part", "node").select(array_to_vector("x").alias("features"), "label").persist()
        try:
            if nodes.select("label").distinct().count() == 2:
                return Forest(GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=1, minInstancesPerNode=8).fit(nodes))
        finally:
            nodes.unpersist()
    return Forest()


def extracted(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 4 << 20):
            pages = [Page(x or "") for x in part.column("html").to_pylist()]
            rows = [p.features() for p in pages]
            margins = np.split(forest.margins(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
            texts = [p.text(m) for p, m in zip(pages, margins, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_pass(rows, lambda it: extracted(it, shared.value), "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, train(pages))
