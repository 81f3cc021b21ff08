"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is parsed into leaf blocks (text between block-level tags), each with the node it stands in; nodes share their ancestors, and carry
the features of their path once. A block's features are those of its ancestors' tags, classes, ids and roles, of whether the page has an
article element and the block stands in it, and of its text; a two-state chain (content or not), trained on labelled pages, is
decoded by Viterbi. The labelled pages come from labelled_pages(): layouts with and without article elements, known and unknown names, menus, notices,
sidebars, forms, adverts and comments in and around the article, whose blocks are labelled by construction.

Parsing takes linear time: open elements are found by the places where their tags stand on the stack, and after a tag that never ends, quotes
no longer count.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # no elements inside; skipped, to the page's end if not closed
OWN = frozenset("noscript template svg object select".split())  # their text is no part of the block around them
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td text tfoot th thead tr ul".split())
#: A start tag ends an open element of these, up to the nearest of the second set.
CLOSES = {**dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav main form blockquote pre figure hr address fieldset details".split(), ({"p"}, frozenset("li td th div section article aside button body object template".split()))),
          "li": ({"li", "p"}, frozenset("ul ol menu".split())), "dd": ({"dd", "dt", "p"}, frozenset(["dl"])), "dt": ({"dd", "dt", "p"}, frozenset(["dl"])),
          "tr": ({"tr", "td", "th"}, frozenset(["table"])), "td": ({"td", "th"}, frozenset("tr table".split())), "th": ({"td", "th"}, frozenset("tr table".split()))}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_TAG_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|data-y|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

# Parts of class, id and role names that tell a block's purpose, by purpose.
PURPOSE = {
    "advert": "ad ads adv advert advertisement adsense adbox banner sponsor sponsored promo promotion promoted outbrain taboola".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs toolbar".split(),
    "head": "header masthead topbar branding logo hero".split(),
    "foot": "footer foot colophon copyright legal bottom".split(),
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more complementary".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog paywall subscribe subscription newsletter signup".split(),
    "form": "form search login contact".split(),
    "comments": "comment comments commentlist discussion disqus respond reply replies reviews feedback thread".split(),
    "share": "share sharing social follow tags tag meta byline author bio date".split(),
    "content": "content article post entry story body main text page maincontent".split(),
}
_PURPOSE = {w: k for k, ws in PURPOSE.items() for w in ws}
# Words that tell what a block says, by purpose.
SAYS = {
    "notice": "cookie cookies consent subscribe newsletter subscription adblocker javascript",
    "foot": "copyright reserved imprint impressum terms privacy sitemap",
    "advert": "advertisement sponsored promoted",
    "form": "login logout register password username search submit",
    "share": "share tweet facebook twitter whatsapp linkedin",
    "comments": "comments reply replies disqus",
}
_SAYS = {w: k for k, ws in SAYS.items() for w in ws.split()}
_WORDS = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?…][\"'”»)]*$")


class Node:
    """An open element: what the blocks in it inherit. Nodes of one path share their features' tuple if they add none."""

    __slots__ = ("tag", "parent", "own", "wrap", "near", "label", "feats")

    def __init__(self, tag: str, names: list[str], hidden: bool, label: str | None, parent: Node | None):
        self.tag, self.parent, self.label = tag, parent, label if label is not None else parent.label if parent else None
        self.own = self if tag in OWN else parent.own if parent else None
        purposes = [] if tag in ("html", "body") else list(dict.fromkeys(_PURPOSE[w] for w in names if w in _PURPOSE))
        above = parent.wrap if parent else False
        self.wrap = above or tag in ("article", "main") or purposes == ["content"]
        self.near = purposes[0] if purposes else tag if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else parent.near if parent else "none"
        at = "@" if above else ""
        new = [f"in:{tag}{at}"] * (tag in BLOCK or tag in OWN) + [f"is:{p}{at}" for p in purposes] + ["hidden"] * hidden
        have = parent.feats if parent else ()
        new = [f for f in dict.fromkeys(new) if f not in have]
        self.feats = have + tuple(new) if new else have


class Block:
    __slots__ = ("text", "node", "linked", "label")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked, self.label = text, node, linked, node.label if node else None

    @property
    def path(self) -> list[str]:
        """The tags from the page's root on."""
        out, x = [], self.node
        while x:
            out.append(x.tag)
            x = x.parent
        return out[::-1]


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: white space reduced, references decoded, without scripts, styles, markup and comments."""
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag on the stack
    out: list[Block] = []
    parts: list[str] = []
    linked, node, owner = 0, None, None
    quotes, unquoted = True, set()

    def cut(n: int) -> None:
        while len(stack) > n:
            places[stack.pop().tag].pop()

    def text(s: str) -> None:
        nonlocal linked, node, owner
        if s:
            top = stack[-1] if stack else None
            own = top.own if top else None
            if own is not owner and not s.isspace():
                end()
                owner = own
            if own is owner and (node is None or not s.isspace()):
                node = top
            parts.append(s)
            if places["a"]:
                linked += len(s)

    def end() -> None:
        nonlocal linked, node, owner
        if parts:
            if t := " ".join(_html.unescape("".join(parts)).split()):
                x = node
                while x and x.tag not in BLOCK and x.parent and not x.tag in OWN:  # the block's element, not the inline ones in it
                    x = x.parent
                out.append(Block(t, x, linked))
            parts.clear()
        linked, node, owner = 0, None, None

    def tag_end(at: int) -> int:
        """Where a tag ends whose name ends at at; -1 if it doesn't."""
        nonlocal quotes
        i = at
        while quotes and (m := _TAG_END.search(page, i)):
            if not m[1]:
                return m.end()
            k = page.find(m[1], m.end()) if m[1] not in unquoted else -1
            if k < 0:
                unquoted.add(m[1])
            i = k + 1 if k >= 0 else m.end()
        quotes = False
        return page.find(">", at, last) + 1 or -1

    at, last = 0, page.rfind(">") + 1
    while m := _TAG.search(page, at):
        if m[1]:
            text(page[at : m.start()])
            k = page.find("-->", m.end())
            at = k + 3 if k >= 0 else len(page)
            continue
        k = (page.find(">", m.end(), last) + 1 or -1 if m[2] else tag_end(m.end())) if m.end() < last else -1
        if k < 0:  # no tag: its sign stands as text
            text(page[at : m.end()])
            at = m.end()
            continue
        text(page[at : m.start()])
        at = k
        if m[2]:
            continue
        tag, rest = m[4].lower(), page[m.end() : k - 1]
        if m[3]:
            if places[tag]:
                if tag in BLOCK:
                    end()
                cut(places[tag][-1])
            continue
        closed = rest.rstrip().endswith("/")
        if tag in RAW:
            if not closed:
                e = _RAW_END[tag].search(page, at)
                at = e.end() if e else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end()
            if places["head"]:
                cut(places["head"][0])
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            of = lambda tags: max((places[t][-1] for t in tags if places[t]), default=-1)
            if (i := of(ends)) > of(stop):
                cut(i)
        if tag not in VOID and not closed:
            attrs = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(rest)} if rest else {}
            names = [p for k in ("class", "id", "role") for p in _PARTS.findall(attrs.get(k, ""))]
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_GONE.search(attrs.get("style", "")))
            places[tag].append(len(stack))
            stack.append(Node(tag, names, hidden, attrs.get("data-y"), stack[-1] if stack else None))
    text(page[at:])
    end()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    out, wrapped = [], any(b.node and b.node.wrap for b in blocks)
    for i, b in enumerate(blocks):
        n, node = len(b.text), b.node
        wrap = ("in" if node and node.wrap else "out") if wrapped else "no"
        link, sentence = min(4, 5 * b.linked // max(1, n)), bool(_ENDS.search(b.text))
        f = ["bias", f"len{min(7, n.bit_length())}", f"link{link}", "only" if len(blocks) == 1 else "first" if i == 0 else "last" if i == len(blocks) - 1 else "mid", f"wrap:{wrap}", f"wrap:{wrap}:{'sentence' if sentence else 'words'}:{'link' if link > 1 else 'plain'}"]
        if node:
            f += node.feats
            f += [f"tag:{node.tag}", f"near:{node.near}", f"near:{node.near}:{wrap}"]
        if sentence:
            f.append("sentence")
        if n < 200:
            f += [f"says:{k}" for k in {_SAYS[w] for w in _WORDS.findall(b.text.lower()) if w in _SAYS}]
        if "©" in b.text:
            f.append("copyright")
        out.append(f)
    return out


#: Names that tell nothing.
_PLAIN = "wp block css grid col row inner wrapper container box section x b item module cell layout".split()


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """n pages with data-y="1" on content and data-y="0" on the rest."""
    rng = random.Random(seed)
    w = lambda k: " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ab"]) for _ in range(rng.randint(1, 4))) for _ in range(k))
    sentence = lambda: w(rng.randint(3, 25)).capitalize() + rng.choice([".", ".", ".", "?", "!"])
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    links = lambda: rng.choice(["<ul>{}</ul>", "<ol>{}</ol>", "<div>{}</div>"]).format("".join(f'<li><a href="/{i}">{w(rng.randint(1, 4))}</a></li>' if rng.random() < 0.7 else f'<div><a href="/{i}">{w(2)}</a></div>' for i in range(rng.randint(2, 9))))
    other = lambda: rng.choice([sentence, prose, lambda: w(rng.randint(1, 5))])()
    said = lambda k: f"{w(rng.randint(0, 3))} {rng.choice(SAYS[k].split())} {w(rng.randint(0, 3))}{rng.choice(['', '.'])}" if k in SAYS and rng.random() < 0.5 else other()
    plain = lambda: rng.choice(["", "", f' class="{rng.choice(_PLAIN)}-{rng.choice(_PLAIN)}"', f' id="{rng.choice(_PLAIN)}{rng.randrange(9)}"'])

    def box(purpose: str, inner: str) -> str:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(purpose, "div")
        if purpose == "hidden":
            tag = rng.choice(["div", "p", "p"])
            return f'<{tag} {rng.choice(["hidden", "style=display:none", "aria-hidden=true"])} data-y="0">{inner}</{tag}>'
        if tag != "div" and rng.random() < 0.5:
            return f'<{tag}{plain()} data-y="0">{inner}</{tag}>'
        tag = rng.choice([tag, "div", "section", *["ol"] * (purpose == "comments")])
        name = rng.choice(PURPOSE[purpose]) + rng.choice(["", "", "-" + rng.choice(_PLAIN)])
        return f'<{tag} {rng.choice(["class", "id", "class", "role"])}="{name}" data-y="0">{inner}</{tag}>'

    def noise(purpose: str) -> str:
        inner = {
            "menu": links, "head": lambda: f"<p>{w(3)}</p>" + rng.choice(["", links()]), "foot": lambda: rng.choice([f"&copy; {w(3)} &middot; {other()}", f"<p>{said('foot')}</p>", links()]),
            "side": lambda: f"<h3>{w(2)}</h3>" + rng.choice([links(), f"<p>{prose()}</p>"]), "notice": lambda: rng.choice([f"<p>{said('notice')}</p><button>{w(1)}</button>", f"<p>{prose()}</p>", said("notice")]),
            "form": lambda: f"<label>{w(2)}</label><input><button>{said('form')}</button><p>{sentence()}</p>", "advert": lambda: rng.choice([said("advert"), f"<p>{other()}</p>"]), "share": lambda: rng.choice([said("share"), links()]),
            "comments": lambda: rng.choice([f"<h3>{w(2)}</h3>", ""]) + "".join(f'<{t} class="{rng.choice(["comment", "reply", "item", "content", "text"])}"><p>{prose()}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 5))),
            "hidden": prose,
        }[purpose]()
        return f"<div{plain()}>{box(purpose, inner)}</div>" if rng.random() < 0.2 else box(purpose, inner)

    def content(k: int) -> list[str]:
        kinds = [lambda: f"<p{plain()}>{prose()}</p>", lambda: f"<p>{sentence()}</p>", lambda: f"<p>{w(rng.randint(1, 4))}.</p>", lambda: f"<p><b>{sentence()}<br>", lambda: f"<h2>{w(3)}</h2>", lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<div{plain()}><p>{prose()}</p></div>",
                 lambda: f"<{rng.choice(['ul', 'ol'])}><li>{sentence()}</li><li>{w(3)}</li><li>{sentence()}</li></ul></ol>", lambda: f"<p>{w(4)} <a href='/x'>{w(2)}</a> {sentence()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<table><tr><td>{w(2)}</td><td>{w(3)}</td></tr></table>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>"]
        return [rng.choice(kinds)() for _ in range(k)]

    pages = []
    for _ in range(n):
        shape = rng.random()
        if shape < 0.12:  # bare pages: one text, a few paragraphs
            text = rng.choice([lambda: prose(), lambda: f"<p>{sentence()}</p>", lambda: w(rng.randint(2, 6)) + ".", lambda: "".join(content(rng.randint(1, 3))), lambda: "<br><br>".join(prose() for _ in range(3)), lambda: w(rng.randint(3, 9))])()
            pages.append(f'<div data-y="1">{text}</div>' if rng.random() < 0.5 else f'<html><body data-y="1">{text}</body></html>')
            continue
        body = [f"<h1>{w(6)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.3:
            body[:] = [f"<header>{''.join(body)}</header>"] if rng.random() < 0.5 else body
        for x in content(rng.randint(1, 14)):
            body.append(x)
            if rng.random() < 0.12:
                body.append(noise(rng.choice(["advert", "share", "form", "notice", "side", "hidden", "hidden", "hidden"])))
        if rng.random() < 0.3:
            body.append(noise(rng.choice(["comments", "comments", "side", "share"])))
        wrap = rng.choice(["article"] * 4 + ["main", "div class='content'", "div id='main-content'", "div class='post-body'", "section class='entry'"]) if shape < 0.7 else "div" + plain()
        page = [noise(p) for p in ("head", "menu", "notice", "advert", "side", "hidden") if rng.random() < 0.4]
        inner = f'<{wrap} data-y="1">{"".join(body)}</{wrap.split()[0]}>'
        page.append(inner if rng.random() < 0.7 else f"<div{plain()}>{inner}</div>")
        page += [noise(p) for p in ("comments", "side", "advert", "form", "menu", "foot", "notice") if rng.random() < 0.4]
        pages.append(f"<html><body{plain()}>" + "".join(page) + "</body></html>")
    return pages


class Crf:
    """Two states; weights of features for state 1, and of the chain's start and transitions."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, move: np.ndarray):
        self.weights, self.start, self.move = weights, start, move

    def decode(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        get, (s0, s1), ((m00, m01), (m10, m11)) = self.weights.get, self.start.tolist(), self.move.tolist()
        x = [sum(get(f, 0.0) for f in row) for row in rows]
        a, b, back = s0, s1 + x[0], []
        for e in x[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((from0, from1))
            a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11) + e
        state, out = int(b > a), []
        for f in reversed(back):
            out.append(state)
            state = 0 if f[state] else 1
        return [state, *out[::-1]]


def train(pages: list[str], steps: int = 150, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient ascent (Adam); forward and backward sums run over all pages at once."""
    data = [(features(b), [int(x.label or 0) for x in b]) for b in map(leaf_blocks, pages) if b]
    names = sorted({f for rows, _ in data for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    T = max(len(y) for _, y in data)
    X = np.zeros((len(data), T, len(names)), np.float32)
    Y, M = np.zeros((len(data), T), int), np.zeros((len(data), T), bool)
    for p, (rows, y) in enumerate(data):
        for t, r in enumerate(rows):
            X[p, t, [at[f] for f in r]] = 1
        Y[p, : len(y)], M[p, : len(y)] = y, True
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = M[:, 1:, None, None]
    for step in range(1, steps + 1):
        W, start, move = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((len(data), T, 2))
        e[:, :, 1] = X @ W.astype(np.float32)
        e[~M] = 0
        f = np.zeros_like(e)
        f[:, 0] = start + e[:, 0]
        for t in range(1, T):
            f[:, t] = np.where(M[:, t, None], np.logaddexp(f[:, t - 1, :1] + move[0], f[:, t - 1, 1:] + move[1]) + e[:, t], f[:, t - 1])
        g = np.zeros_like(e)
        for t in range(T - 2, -1, -1):
            n = g[:, t + 1] + e[:, t + 1]
            g[:, t] = np.where(M[:, t + 1, None], np.logaddexp(n[:, :1] + move[:, 0], n[:, 1:] + move[:, 1]), g[:, t + 1])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p1 = np.exp(f[:, :, 1] + g[:, :, 1] - z[:, None]) * M
        pair = np.exp(f[:, :-1, :, None] + move + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both
        seen = np.zeros((2, 2))
        np.add.at(seen, (Y[:, :-1][M[:, 1:]], Y[:, 1:][M[:, 1:]]), 1)
        p0 = np.exp(f[:, 0] + g[:, 0] - z[:, None]).sum(0)
        grad = np.concatenate([np.einsum("pt,ptf->f", (Y - p1) * M, X), np.bincount(Y[:, 0], minlength=2) - p0, (seen - pair.sum((0, 1))).ravel()]) - l2 * len(data) * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(dict(zip(names, theta[:-6].tolist(), strict=True)), theta[-6:-4], theta[-4:].reshape(2, 2))


@lru_cache(maxsize=4)
def _trained(n_labelled: int) -> Crf:
    """The model of so many labelled pages; they are the same each time, and so is the model."""
    return train(labelled_pages(n_labelled))


def extract(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, y in zip(blocks, crf.decode(features(blocks)), strict=True) if y)


def html_extract(pages: DataFrame, crf: Crf | None = None, n_labelled: int = 600) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page gives an empty text; null ids and urls and repeated rows stay, each a row; no pages give no rows; pages of any length and depth
    are read whole, in linear time; of two best labellings the one with fewer blocks at the end is taken; extra columns are ignored. n_labelled:
    pages to train on.
    """
    crf = crf or _trained(n_labelled)

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py(), crf) for x in b.column(2)]
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
