import random
from math import log

import pytest

from lexforge.llm import sitetree as H


class Node:
    """One element of a site style tree, merged page by page."""

    def __init__(self):
        self.pages, self.styles, self.features = 0, {}, {}

    def add(self, page, k, where):
        self.pages += 1
        where[k] = self
        if page.content[k] is not None:
            self.features[page.content[k]] = self.features.get(page.content[k], 0) + 1
            return
        labels = tuple(page.label[c] for c in page.children[k])
        count, kids = self.styles.setdefault(labels, [0, [Node() for _ in labels]])
        self.styles[labels][0] = count + 1
        for kid, c in zip(kids, page.children[k]):
            kid.add(page, c, where)

    def importance(self, least):
        m = self.pages
        if self.features:
            return 1.0 if m < least else 1 - sum(log(c) / log(m) for c in self.features.values()) / len(self.features)
        shares = [(n / m, kids) for n, kids in self.styles.values()]
        own = 1.0 if m < least else -sum(p * log(p, m) for p, _ in shares)
        weight = 1 - H.GAMMA ** len(self.styles) if m >= least else 1.0
        return weight * own + (1 - weight) * sum(p * (sum(k.importance(least) for k in kids) / len(kids) if kids else own) for p, kids in shares)


def site(rng, n):
    out = []
    for k in range(n):
        links = "".join(f'<li><a href="/{x}">{x}</a>' for x in ("home", "news", rng.choice(["a", "b"])))
        body = "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=12))} {k}.{j}" for j in range(rng.randint(1, 3)))
        out.append(f'<html><body><ul class=nav>{links}</ul><script>var t="</p>";</script><div id="main">{body}</div><div class="foot">All rights &copy; reserved</div></body></html>')
    return out


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, node int, text string")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_equals_the_tree_built_in_one_place(spark, limit):
    rng = random.Random(3)
    rows = [(k, f"http://{'ab'[k % 2]}.org/{k}", h, 1, "x") for k, h in enumerate(site(rng, 30))]
    want = {}
    for host in ("a.org", "b.org"):
        root, parsed = Node(), {}
        for k, url, html, *_ in rows:
            if host in url:
                parsed[k] = (H.Page(host, html), {})
                root.add(parsed[k][0], 0, parsed[k][1])
        for k, (page, where) in parsed.items():
            text, cut = page.text([where[i].importance(5) if where[i].pages >= 5 else 1.0 for i in range(len(page.label))], H.THRESHOLD)
            want[k] = (text, len(page.label), cut)
    got = {r.page_id: (r.text, r.n_nodes, r.n_removed) for r in H.extract(pages(spark, rows), broadcast_nodes=limit, group_pages=4).collect()}
    assert got == want
    assert all("rights" not in t and "home" not in t and n for t, _, n in got.values()) and all(f" {k}.0" in got[k][0] for k in got)


def test_parser():
    def shape(html):
        p = H.Page("h", html)

        def show(k):
            return p.content[k] if p.content[k] is not None else (p.label[k].split()[0], *map(show, p.children[k]))

        return show(0)[1:]

    assert shape("<p>a<p>b &amp; c<br>d</p>") == (("p", "a"), ("p", "b & c", ("br",), "d"))
    assert shape("<ul><li>x<li>y</ul>z</b>") == (("ul", ("li", "x"), ("li", "y")), "z")
    assert shape("<!-- <p>no</p> --><div><b>u</div>v<script>if (a < b) '</p>'</script>w") == (("div", ("b", "u")), "v", "w")
    assert shape("a < b <![CDATA[c]]> <img src='i.png'>") == ("a < b", "c", ("img", "i.png"))
    assert shape("<div <p>broken") in ((("div", "broken"),), (("div",), "broken"), ("<div", ("p", "broken")))


def test_odd_rows(spark):
    rows = [(1, None, "<p>x</p>", 1, ""), (1, None, "<p>x</p>", 1, ""), (2, "http://a", None, 1, None), (None, "nonsense", "", 1, ""), (3, "http://a", "<p>" * 3000 + "deep", 1, ""), (4, "http://a", "text " * 200_000, None, "")]
    got = sorted((r.page_id or -1, r.n_nodes) for r in H.extract(pages(spark, rows)).collect())
    assert [k for k, _ in got] == [-1, 1, 1, 2, 3, 4] and (2, 0) in got
    assert H.extract(pages(spark, rows).limit(0)).count() == 0
