"""Operator 4, HTML extraction with site style trees.

The pages of a host are laid over one another: an element is the same node of the host's style tree
on two pages if its parent is, its parent's child sequence (its presentation style) is, and it
stands at the same place in it. So a node's identity is a hash of its path of styles, every page
works out its own, and merging the pages of a host is a count by node.

Of m pages that have a node, with p_i the share of its i-th style, the node's importance is its
entropy -sum p_i log_m p_i. Content (texts, link targets, image sources) is a leaf; a feature that
c of the m pages have there has entropy log_m c, and the leaf's importance is one minus the mean
over its features. Nodes of fewer than min_pages pages have importance 1. The composite importance of a node with l
styles is (1 - g^l) importance + g^l * (mean over its pages of the mean of its children); since a
child has exactly the pages of its parent's style, that mean equals the tree's own recursion and
comes from one more count. Branches of composite importance under threshold are removed from every page.

No host is gathered in one place. Tables by node are broadcast while they have at most
broadcast_nodes rows, else each group of pages gets the nodes it holds by a join.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import textbuf as tb
from lexforge.llm.common import small_batches, written

GAMMA, THRESHOLD, MIN_PAGES, BROADCAST_NODES, GROUP_PAGES = 0.9, 0.2, 5, 4_000_000, 2048
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)/?>""", re.S)
_ATTR = re.compile(r"""(?i)\b(class|id|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"br", "td", "th", "li", "option", "body", "html", "head", "title"}


class Page:
    """A DOM in document order: label, parent and children of each node, text of text nodes, and ids in the style tree."""

    def __init__(self, host: str, source: str) -> None:
        self.label, self.parent, self.children, self.content = ["#root"], [-1], [[]], [None]
        self._build(source)
        self._name(host)

    def _add(self, label: str, parent: int, content: str | None = None) -> int:
        n = len(self.label)
        self.label.append(label)
        self.parent.append(parent)
        self.children.append([])
        self.content.append(content)
        self.children[parent].append(n)
        return n

    def _build(self, source: str) -> None:
        open_, at, label = [0], 0, self.label
        tags = ["#root"]

        def text(s: str) -> None:
            s = " ".join(html_lib.unescape(s).split())
            if s:
                self._add("#text", open_[-1], s)

        m = _TAG.search(source)
        while m:
            text(source[at : m.start()])
            at, name = m.end(), m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:-3])
            elif m[1]:
                name = name.lower()
                if name in tags:
                    k = len(tags) - 1 - tags[::-1].index(name)
                    if k:
                        del tags[k:], open_[k:]
            else:
                name = name.lower()
                closes = _CLOSES.get(name)
                if closes:
                    while tags[-1] in closes or tags[-1] == "p":
                        tags.pop(), open_.pop()
                elif name in _ENDS_P and tags[-1] == "p":
                    tags.pop(), open_.pop()
                attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
                if name in _RAW:
                    end = re.compile(rf"(?i)</{name}\s*>").search(source, at)
                    at = end.end() if end else len(source)
                else:
                    node = self._add(f"{name} {attrs.get('class', '')} {attrs.get('id', '')}", open_[-1])
                    if name == "a" and attrs.get("href"):
                        self._add("#href", node, attrs["href"])
                    elif name == "img" and attrs.get("src"):
                        self._add("#src", node, attrs["src"])
                    if name not in _VOID and not m[0].endswith("/>"):
                        tags.append(name)
                        open_.append(node)
            m = _TAG.search(source, at)
        text(source[at:])

    def _name(self, host: str) -> None:
        """ids: the node in the style tree; values: its style, or the feature of a leaf."""
        digest, label, n = xxhash.xxh64_intdigest, self.label, len(self.label)
        self.ids, self.values = [0] * n, [0] * n
        self.ids[0] = digest(host)
        for k in range(n):
            if self.content[k] is not None:
                self.values[k] = digest(self.content[k])
                continue
            style = self.values[k] = digest("\x00".join([label[c] for c in self.children[k]]))
            base = f"{self.ids[k]} {style} "
            for place, c in enumerate(self.children[k]):
                self.ids[c] = digest(f"{base}{place}")

    def local(self, own: list[float], share: list[float]) -> list[float]:
        """The page's own recursion: own importance, and the share given to it, of each node."""
        out = list(own)
        for k in range(len(own) - 1, -1, -1):
            if self.children[k]:
                below = sum(out[c] for c in self.children[k]) / len(self.children[k])
                out[k] = share[k] * own[k] + (1 - share[k]) * below
        return out

    def text(self, importance: list[float], threshold: float) -> tuple[str, int]:
        """Text without the branches of low importance, and the number of branches cut."""
        parts, cut, stack = [], 0, [0]
        while stack:
            k = stack.pop()
            if k < 0:
                parts.append("\n")
            elif importance[k] < threshold and k:
                cut += 1
            elif self.label[k] == "#text":
                parts.append(self.content[k])
            else:
                block = self.label[k].split(" ", 1)[0] in _BLOCK
                if block:
                    parts.append("\n")
                    stack.append(-1)
                stack += reversed(self.children[k])
        lines = (" ".join(x.split()) for x in " ".join(parts).split("\n"))
        return "\n".join(x for x in lines if x), cut


def prepared(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select(host.alias("host"), pages["page_id"].cast("long").alias("page_id"), "url", "html")


def _parsed(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[Page | None], np.ndarray, np.ndarray]]:
    """Slices of a batch with their pages, and the ids and values of all their nodes; null html has no page."""
    host, page = (b.schema.get_field_index(c) for c in ("host", "html"))
    _, off = tb.buffers(b.column(page))
    for lo, hi in tb.slices(off):
        part = b.slice(lo, hi - lo)
        doms = [None if s is None else Page(h, s) for h, s in zip(part.column(host).to_pylist(), part.column(page).to_pylist())]
        ids = np.array([x for d in doms if d for x in d.ids], dtype=np.uint64)
        values = np.array([x for d in doms if d for x in d.values], dtype=np.uint64)
        yield part, doms, ids, values


class Table:
    """Rows by node: sorted ids and their columns; nodes that are not in it get the default."""

    def __init__(self, node: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(node.view(np.uint64))
        self.node, self.columns = node.view(np.uint64)[order], [c[order] for c in columns]

    def get(self, ids: np.ndarray, *default: float) -> list[np.ndarray]:
        if not len(self.node):
            return [np.full(len(ids), d) for d in default]
        at = np.minimum(np.searchsorted(self.node, ids), len(self.node) - 1)
        hit = self.node[at] == ids
        return [np.where(hit, c[at], d) for c, d in zip(self.columns, default)]


def style_counts(pages: DataFrame, gamma: float, min_pages: int) -> DataFrame:
    """(node, own, share): importance of each node of at least min_pages pages, and its weight 1 - gamma^l (1 for a leaf)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, doms, ids, values in _parsed(b):
                leaf = np.array([c is not None for d in doms if d for c in d.content], dtype=bool)
                order = np.lexsort((values, ids))
                i, v, leaf = ids[order], values[order], leaf[order]
                at = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (v[1:] != v[:-1])]) if len(i) else np.zeros(0, int)
                n = np.diff(np.r_[at, len(i)])
                yield pa.RecordBatch.from_arrays([pa.array(i[at].view(np.int64)), pa.array(v[at].view(np.int64)), pa.array(leaf[at]), pa.array(n, pa.int64())], ["node", "value", "leaf", "n"])

    counted = pages.mapInArrow(count, "node long, value long, leaf boolean, n long").repartition("node")
    each = counted.groupBy("node", "leaf", "value").agg(F.sum("n").alias("c"))
    node = each.groupBy("node", "leaf").agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.log("c")).alias("logs"), F.sum(F.col("c") * F.log("c")).alias("clogs")).where(F.col("m") >= max(2, min_pages))
    m = F.log("m")
    own = F.when(F.col("leaf"), 1 - F.col("logs") / (F.col("l") * m)).otherwise(1 - F.col("clogs") / (F.col("m") * m))
    return node.select("node", F.greatest(F.lit(0.0), own).alias("own"), F.when(F.col("leaf"), F.lit(1.0)).otherwise(1 - F.pow(F.lit(gamma), "l")).alias("share"))


def _local(doms: list[Page | None], ids: np.ndarray, table: Table) -> np.ndarray:
    own, share = (x.tolist() for x in table.get(ids, 1.0, 1.0))
    out, at = [], 0
    for d in doms:
        if d:
            out += d.local(own[at : at + len(d.ids)], share[at : at + len(d.ids)])
            at += len(d.ids)
    return np.array(out)


def with_table(pages: DataFrame, rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch], Table], Iterator[pa.RecordBatch]], schema: str, limit: int, group_pages: int) -> DataFrame:
    """work over the pages with the rows of their nodes (rows is a written table): broadcast up to limit rows, else joined by groups of pages."""
    names = rows.columns
    if rows.count() <= limit:
        shared = rows.sparkSession.sparkContext.broadcast([c.to_numpy(zero_copy_only=False) for c in rows.toArrow().combine_chunks().columns])
        return pages.mapInArrow(lambda batches: work(batches, Table(*shared.value)), schema)
    groups = max(1, -(-pages.count() // group_pages))
    dealt = pages.withColumn("__lx_group", F.pmod(F.xxhash64("html", "page_id", "url"), F.lit(groups)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, doms, ids, _ in _parsed(b):
                group = np.repeat(part.column(part.schema.get_field_index("__lx_group")).to_numpy(zero_copy_only=False), [len(d.ids) if d else 0 for d in doms])
                pairs = np.unique(np.stack([group, ids.view(np.int64)], axis=1), axis=0) if len(ids) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["__lx_group", "node"])

    def both(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = Table(*(right.column(c).to_numpy() for c in names))
        out = list(work(left.combine_chunks().to_batches(), table))
        return pa.Table.from_batches(out)

    held = dealt.mapInArrow(needed, "__lx_group long, node long").distinct().join(rows, "node")
    return dealt.groupBy("__lx_group").cogroup(held.groupBy("__lx_group")).applyInArrow(both, schema)


def extract(pages: DataFrame, gamma: float = GAMMA, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_nodes, n_removed: each page's text without low-importance branches.

    Null html gives null text and no nodes, html without text an empty text. A null url, or one
    without a host, belongs to the host ''. Repeated rows are pages of their own, and null and
    repeated ids are kept row by row. Unclosed and misnested tags are closed where an element that
    cannot hold what follows does, or with their parent. Other columns of pages are left out; an
    empty table gives an empty table.
    """
    small_batches(pages.sparkSession)
    spec = prepared(pages)
    stats = written(style_counts(spec, gamma, min_pages), "styles")

    def sums(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, doms, ids, _ in _parsed(b):
                value = _local(doms, ids, table)
                known = ~np.isnan(table.get(ids, np.nan, np.nan)[0])
                i, value = ids[known], value[known]
                node, back, n = np.unique(i, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.bincount(back, value, len(node)).astype(float)), pa.array(n, pa.int64())], ["node", "total", "n"])

    def cut(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, doms, ids, _ in _parsed(b):
                importance, at, texts, nodes, removed = table.get(ids, 1.0)[0].tolist(), 0, [], [], []
                for d in doms:
                    n = len(d.ids) if d else 0
                    text, k = d.text(importance[at : at + n], threshold) if d else (None, 0)
                    texts.append(text)
                    nodes.append(n)
                    removed.append(k)
                    at += n
                kept = [part.column(part.schema.get_field_index(c)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(nodes, pa.int32()), pa.array(removed, pa.int32())], ["page_id", "url", "text", "n_nodes", "n_removed"])

    local = with_table(spec, stats, sums, "node long, total double, n long", broadcast_nodes, group_pages)
    composite = written(local.groupBy("node").agg((F.sum("total") / F.sum("n")).alias("importance")), "importance")
    return with_table(spec, composite, cut, "page_id long, url string, text string, n_nodes int, n_removed int", broadcast_nodes, group_pages)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
