"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.llm.boosting import Boosted, boost
from quillon.llm.dom import Node, parse_nodes

# Words of class, id and role that speak for or against main text.
GROUPS = {
    "main": "article main content post body story entry text page blog hentry".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager skip".split(),
    "head": "header masthead banner logo topbar branding tagline".split(),
    "foot": "footer copyright legal colophon bottom contact".split(),
    "side": "sidebar side aside widget related recommended recommendations trending popular archive tags rail".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe paywall announcement warning privacy".split(),
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promoted promotion dfp banner affiliate".split(),
    "comment": "comment comments discussion respond replies reply disqus commentlist responses thread feedback".split(),
    "share": "share sharing social follow tools byline meta likes".split(),
    "form": "form search login signup register input".split(),
}
TAGS = ("#text", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu", "li", "table tbody tr td th thead", "blockquote pre figure figcaption dl dt dd", "nav", "header", "footer", "aside", "form fieldset", "body html #root", "details dialog")
_TAG_AT = {t: i for i, names in enumerate(TAGS) for t in names.split()}
_WORDS = [frozenset(x) for x in GROUPS.values()]
SEED_PAGES = 420


def features(nodes: list[Node]) -> np.ndarray:
    """For each node, in page order: density of its subtree, attribute words, depth, siblings, ancestors."""
    n = len(nodes)
    parent = [x.parent.at if x.parent else 0 for x in nodes]
    chars, links = [len(x.text) for x in nodes], [x.links for x in nodes]
    runs, paras = [int(x.tag == "#text") for x in nodes], [int(x.tag == "p") for x in nodes]
    tags, count, said = [x.tags for x in nodes], [1] * n, np.array(chars, float)
    for i in range(n - 1, 0, -1):  # sums of subtrees
        up = parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i]
        runs[up] += runs[i]
        paras[up] += paras[i]
        count[up] += count[i]
    # kinds and words of a node, and of all above it, as bits
    own, above, order, met = [0] * n, [0] * n, [0] * n, [0] * n
    for i, node in enumerate(nodes):
        kind = _TAG_AT.get(node.tag)
        bits = 0 if kind is None else 1 << kind
        if node.names:
            for g, known in enumerate(_WORDS):
                if not known.isdisjoint(node.names):
                    bits |= 1 << (len(TAGS) + g)
        own[i] = bits
        if i:
            above[i] = above[parent[i]] | own[parent[i]]
            order[i] = met[parent[i]]
            met[parent[i]] += 1
    place = np.arange(len(TAGS) + len(GROUPS))
    marks = [(np.array(x)[:, None] >> place & 1).astype(float) for x in (own, above)]
    up, at = np.array(parent), np.arange(n)
    c, k, t, r, p, m = (np.array(x, float) for x in (chars, links, tags, runs, paras, count))
    sib = np.array([len(x.children) for x in nodes], float)[up]
    sib[:1] = 1
    total = max(1.0, c[0]) if n else 1.0
    some, own_links = np.maximum(1.0, c), k / np.maximum(1.0, c)
    points = np.array([sum(map(x.text.count, ",.;:!?")) / max(1, len(x.text)) for x in nodes])
    gaps = np.array([x.text.count(" ") for x in nodes], float)
    rest = [np.log1p(c), c / total, c / some[up], own_links, (t + m) / (c + 1) * 100, c / np.maximum(1.0, r)]
    rest += [np.array([x.depth for x in nodes], float), sib, np.array(order) / np.maximum(1.0, sib), p, p[up], own_links[up]]
    rest += [points, gaps, (at + 1) / max(1, n), (said.cumsum() - said) / total]
    return np.concatenate([*marks, np.stack(rest, axis=1)], axis=1)


def keep_nodes(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which no node is kept below one that is not.

    A node is labelled kept if main text lies in it. Bottom up: the gain of keeping a node is
    its logit plus the positive gains below it; top down: a node stays if its gain is
    positive and its parent stays.
    """
    gain = logits.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent.at] += gain[i]
    keep = [True] * len(nodes)
    for i, node in enumerate(nodes):
        keep[i] = node.parent is None or (gain[i] > 0 and keep[node.parent.at])
    return np.array(keep, bool)


# Common words that made-up pages are filled with.
FILLER = """time people way day man thing woman life child world school state family student group country problem
hand part place case week company system program question work government number night point home water room mother
area money story fact month lot right study book eye job word business issue side kind head house service friend father
power hour game line end member law car city community name president team minute idea kid body information back parent
face others level office door health person art war history party result change morning reason research girl guy moment
the a of and in to for with on at from by about as into like through after over between out against during without""".split()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = [rng.choice(FILLER) for _ in range(rng.randint(low, high))]
    if len(words) > 8 and rng.random() < 0.3:
        words[4] += rng.choice((",", ";", " &amp;", " -"))
    return (" ".join(words) + rng.choice((".", ".", ".", "!", "?", ""))).capitalize()


def seed_page(rng: random.Random) -> str:
    """A made-up page; its main text is marked by a leading \x02 in each run."""
    s = lambda a, b: _sentence(rng, a, b)
    m = lambda a, b: "\x02" + _sentence(rng, a, b)
    pick = rng.choice
    links = lambda n: "".join(f'<li><a href="/{i}">{s(1, 2)}</a></li>' for i in range(n))

    def article() -> str:
        title, out = m(2, 10), []
        if rng.random() < 0.25:  # a few words
            text = m(1, pick((2, 4, 9)))
            return f"<h1>{text}</h1><p>{text}</p>" if rng.random() < 0.5 else f"<p>{text}</p>"
        if rng.random() < 0.8:
            out.append(pick((f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2 class='entry-title'>{title}</h2>")))
        for _ in range(pick((1, 1, 2, 3, 4, 6, 10, 18))):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{m(1, pick((2, 6, 15, 40, 80)))}</p>" if rng.random() < 0.85 else f"<p><b>{m(1, 30)}<br>")
            elif kind < 0.78:
                out.append(f"<h{pick('23')}>{m(1, 6)}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{m(1, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{m(3, 30)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{m(1, 3)}</td><td>{m(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div>{m(4, 40)}</div>")
            if rng.random() < 0.08:
                out.append(pick((f"<div class='{pick(('ad', 'advert', 'sponsored', 'promo-box'))}'>{s(2, 14)}</div>", f"<aside class='related'><ul>{links(3)}</ul></aside>", f"<div class='share'><a href='#'>{s(1, 1)}</a> <a href='#'>{s(1, 1)}</a></div>", f"<form class='newsletter'><label>{s(2, 6)}</label><input name=x><button>go</button></form>", f"<form action='/x'><p>{s(2, 8)}</p><input name=x></form>", f"<form><h3>{s(1, 4)}</h3><p>{s(3, 20)}</p><input></form>", f"<div class='notice'><p>{s(4, 12)}</p></div>")))
        return "".join(out)

    comment = lambda: f"<{(t := pick(('li', 'div', 'article')))} class='comment'><p>{s(1, 30)}</p></{t}>"
    shell = pick((("<article>", "</article>"), ("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<main>", "</main>"), ("<div id='content'>", "</div>"), ("<div class='post-content entry'>", "</div>"), ("<div class='wrap'><section class='story-body'>", "</section></div>"), ("<div id='main'><div class='text'>", "</div></div>"), ("", ""), ("<div>", "</div>"), ("<div class='c7'><div>", "</div></div>")))
    before = [
        f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>" if rng.random() < 0.7 else f"<div class='{pick(('menu', 'navbar', 'main-nav'))}'>{s(1, 1)} <a href='/'>{s(1, 2)}</a> <a href='/b'>{s(1, 2)}</a></div>",
        pick(("", f"<header><h1>{s(1, 3)}</h1><p>{s(3, 8)}</p></header>", f"<div id='header'><h2>{s(1, 3)}</h2><p class='tagline'>{s(3, 9)}</p></div>")),
        pick(("", f"<div class='{pick(('ad', 'ads', 'advert', 'sponsored'))}'>{s(3, 25)}</div>", f"<div class='{pick(('ad', 'ad-banner', 'promo'))}'><p>{s(3, 25)}</p></div>")),
        pick(("", "", f"<div class='{pick(('cookie-notice', 'notice', 'alert', 'gdpr consent'))}'><p>{s(4, 25)}</p><button>ok</button></div>")),
        pick(("", "", f"<form class='search' action='/s'><label>{s(1, 3)}</label><input><select><option>{s(1, 2)}</option></select></form>")),
    ]
    after = [
        pick(("", f"<aside><h3>{s(1, 3)}</h3><ul>{links(4)}</ul></aside>", f"<div class='sidebar'><h3>{s(1, 2)}</h3><p>{s(5, 40)}</p><ul>{links(3)}</ul></div>", f"<aside class='widget'><p>{s(5, 60)}</p></aside>")),
        pick(("", "", f"<section id='comments'><h3>{s(1, 2)}</h3>{''.join(comment() for _ in range(rng.randint(1, 7)))}</section>", f"<div class='comments'>{''.join(comment() for _ in range(rng.randint(1, 7)))}</div>", f"<ol class='commentlist'>{''.join(comment() for _ in range(rng.randint(1, 5)))}</ol>")),
        pick(("", "", f"<div class='{pick(('ad', 'advertisement', 'sponsored'))}'>{s(3, 25)}</div>")),
        pick((f"<footer>&copy; {s(2, 12)}</footer>", f"<footer>&copy; {s(1, 1)} &middot; {s(6, 30)}</footer>", f"<div id='footer'><p>{s(3, 20)}</p><ul>{links(3)}</ul></div>", f"<footer><p>{s(3, 30)}</p></footer>", "")),
    ]
    if rng.random() < 0.08:  # nothing but the text
        before, after = [], [""]
    rng.shuffle(before)
    if rng.random() < 0.3:
        before.append(after.pop(0))
    body = "".join(before) + shell[0] + article() + shell[1] + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{s(2, 6)}</title><script>x()</script></head><body>" + (body if rng.random() < 0.7 else f"<div class='{pick(('page', 'container', 'site'))}'>{body}</div>") + "</body></html>"


def _holds_mark(nodes: list[Node]) -> np.ndarray:
    y = [float(n.text.startswith("\x02")) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent.at] = 1.0
    return np.array(y)


def fit(pages: list[str] | None = None) -> Boosted:
    """Trees fitted on pages whose main text is marked by \\x02; by default made-up ones, once a process."""
    if pages is None:
        return _fit_seed()
    xs, ys = [], []
    for page in pages:
        nodes = parse_nodes(page)
        xs.append(features(nodes))
        ys.append(_holds_mark(nodes))
    return boost(np.concatenate(xs), np.concatenate(ys), trees=50, depth=5, bins=24, least=3)


@functools.cache
def _fit_seed() -> Boosted:
    rng = random.Random(5)
    return fit([seed_page(rng) for _ in range(SEED_PAGES)])


def extract_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """Main text of each page: its blocks, in page order, joined by two newlines."""
    parsed = [parse_nodes(p) if p else [] for p in pages]
    some = [features(nodes) for nodes in parsed if nodes]
    logits = trees.logits(np.concatenate(some)) if some else np.zeros(0)
    out, lo = [], 0
    for nodes in parsed:
        keep = keep_nodes(nodes, logits[lo : lo + len(nodes)])
        out.append("\n\n".join(n.text for n, k in zip(nodes, keep.tolist(), strict=True) if k and n.text))
        lo += len(nodes)
    return out


def _extract(trees: Boosted):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = extract_texts(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return extract


def extract_main_text(pages: DataFrame, trees: Boosted) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row.

    The whole page is parsed into a tree of blocks and runs of text; trees judge the nodes, and
    a run stays if it and all nodes above it are judged to hold main text, as one labelling
    of the tree. White space within a block is one space. Null or empty html, and pages
    without main text, give an empty text. Repeated rows are treated alike; empty tables give
    an empty result; other columns are not looked at, whatever their names.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = own.mapInArrow(_extract(trees), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
