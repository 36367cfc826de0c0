"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into its block-level nodes. Each node is described by its subtree's text and link density, the
tokens of its own and its ancestors' attributes, its depth and place, and its siblings. Boosted trees, fitted on pages
made by a fixed recipe whose parts are known, give each node the probability that its subtree belongs to the article.
Decoding then picks the most likely set of nodes in which every kept node's parent is kept, so a dropped
ancestor and a kept descendant never contradict each other.

Text: character references decoded, white space inside a block turned into one space (a line break counts as white
space), trimmed, blocks in page order joined by two line ends. A null or empty page, and one without an article, has an
empty text. Repeated rows are extracted alike.
"""

from __future__ import annotations

import html as html_library
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
HIDDEN = frozenset("head template svg select button canvas audio video object math datalist".split())
#: Elements that a start tag closes if they are the innermost of these kinds.
_LI, _CELL, _TERM = frozenset(["li"]), frozenset(["td", "th"]), frozenset(["dt", "dd"])
CLOSES = {"li": _LI, "dt": _TERM, "dd": _TERM, "td": _CELL, "th": _CELL, "tr": frozenset(["tr", "td", "th"])}
LIMITS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "tr": frozenset(["table"])}

#: Tokens of classes, ids and roles that tell what a part is for.
TOKENS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense teaser partner",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip topbar",
    "foot": "footer foot colophon copyright bottom legal imprint contentinfo",
    "head": "header masthead banner logo branding sitehead top",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message warning banner dialog",
    "form": "form search login signup signin register newsletter subscribe subscription contact searchbox",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses feedback",
    "share": "share sharing social related recommended recommendations more tags meta popular trending links",
    "text": "content article post entry main body story text page maincontent hentry prose",
}
_KIND = {t: k for k, words in enumerate(TOKENS.values()) for t in words.split()}
_TEXT = len(TOKENS) - 1
GROUPS = {t: k for k, words in enumerate(("p pre blockquote", "h1", "h2 h3 h4 h5 h6", "li dt dd summary figcaption", "ul ol dl menu", "table tbody thead tfoot tr", "td th", "article main", "section div center body html figure details fieldset address hr #text", "nav", "aside dialog", "header", "footer", "form")) for t in words.split()}
N_GROUPS = 14

#: A tag behind its "<": a quote opens a value only behind an equals sign. The second one ends at the first ">".
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_SHORT_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.!?…](?=\s|$)")


class Page:
    """Block nodes in page order: tag, parent, kinds of tokens, and the text runs directly inside each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.runs = ["body"], [-1], [0], [[]]
        self._parse(source)
        self._split_mixed()

    def _node(self, tag: str, parent: int, kinds: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.kinds.append(kinds)
        self.runs.append([])
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        """Reads the page once from left to right. A tag that no ">" ends as its quotes stand is the sign of a lost quote; from there on tags end at their first ">"."""
        # The stack holds (tag, node or -1 for an element that is not shown); `open_` counts its tags.
        stack: list[tuple[str, int]] = [("body", 0)]
        open_: Counter[str] = Counter()
        at, hidden, link, order = 0, 0, False, 0
        fresh = True  # the next text begins a new run
        tag_at = _TAG.match
        size = len(source)

        def cut(k: int) -> None:
            """Closes the elements from place k of the stack on."""
            nonlocal hidden
            for name, node in stack[k:]:
                hidden -= node < 0
                open_[name] -= 1
            del stack[k:]

        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                mark = size
            chunk = source[at:mark]
            m, at = None, mark + 1
            if mark < size:
                ahead = source[at : at + 1]
                if ahead.isascii() and ahead.isalpha() or ahead == "/" and source[at + 1 : at + 2].isalpha():
                    m = tag_at(source, at)
                    if not m and tag_at is _TAG.match:
                        tag_at = _SHORT_TAG.match
                        m = tag_at(source, at)
                    if not m:
                        size = mark  # a last tag without an end
                elif ahead not in ("!", "?", "/"):
                    chunk += "<"
            if chunk and not hidden and (not chunk.isspace() or not fresh):
                runs = self.runs[stack[-1][1]]
                if fresh or not runs:
                    order += 1
                    runs.append([order, [], 0])
                    fresh = False
                runs[-1][1].append(chunk)
                if link:
                    runs[-1][2] += len(chunk)
            if mark >= size:
                return
            if not m:
                if ahead in ("!", "?", "/"):
                    end, far = (source.find("-->", at + 1), 3) if source.startswith("!--", at) else (source.find(">", at), 1)
                    at = size if end < 0 else end + far
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link = False
                if open_[tag] and (tag in BLOCKS or tag in HIDDEN):
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                    fresh = True
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s>/]", re.IGNORECASE).search(source, at)
                close = source.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else size
                continue
            if tag == "a":
                link = True
            if tag == "br" or tag == "wbr":
                if tag == "br" and not hidden and not fresh:
                    self.runs[stack[-1][1]][-1][1].append(" ")
                continue
            if tag not in BLOCKS and tag not in HIDDEN:
                continue
            if tag == "body" or tag == "html":
                if tag == "body":
                    cut(1)
                    self.kinds[0] |= self._attributes(m[3])[0]
                fresh = True
                continue
            fresh = True
            # A block ends an open paragraph; items, cells and rows end their like.
            if open_["p"] and tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][1] < 0 or stack[k][0] in ("td", "th", "table", "div", "article", "section", "li"):
                        break
            if tag in CLOSES and any(open_[x] for x in CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in CLOSES[tag]:
                        cut(k)
                        break
                    if stack[k][0] in LIMITS[tag] or stack[k][1] < 0:
                        break
            if tag in VOID:
                continue
            kinds, unseen = self._attributes(m[3]) if m[3] else (0, False)
            open_[tag] += 1
            if hidden or unseen or tag in HIDDEN:
                hidden += 1
                stack.append((tag, -1))
            else:
                stack.append((tag, self._node(tag, stack[-1][1], kinds)))

    @staticmethod
    def _attributes(text: str) -> tuple[int, bool]:
        """(kinds of the tokens, as bits; whether the element is hidden)."""
        kinds, unseen = 0, False
        for m in _ATTRIBUTE.finditer(text):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                unseen |= "display:none" in value.replace(" ", "").lower()
            elif name == "hidden" or name == "aria-hidden":
                unseen |= name == "hidden" and value.lower() != "until-found"
            else:
                for token in _TOKEN.findall(value):
                    if (k := _KIND.get(token.lower())) is not None:
                        kinds |= 1 << k
        return kinds, unseen

    def _split_mixed(self) -> None:
        """Text runs beside block children become nodes of their own; others belong to their block."""
        inner = {p for p in self.parent if p >= 0}
        for node in sorted(inner):
            for run in self.runs[node]:
                self.runs[self._node("#text", node, 0)].append(run)
            self.runs[node] = []

    def texts(self) -> list[tuple[int, int, str]]:
        """(place, node, text) of all blocks with text."""
        out = []
        for node, runs in enumerate(self.runs):
            for order, chunks, _ in runs:
                text = "".join(chunks)
                if "&" in text:
                    text = html_library.unescape(text)
                text = " ".join(text.split())
                if text:
                    out.append((order, node, text))
        out.sort()
        return out

    def features(self, texts: list[tuple[int, int, str]]) -> np.ndarray:
        n = len(self.tag)
        # Bytes, words, words' sum of ends, link bytes, blocks, longest block; first and last place of text.
        chars, words, ends, links, blocks, longest = (np.zeros(n) for _ in range(6))
        first, last = np.full(n, np.inf), np.zeros(n)
        total = 0.0
        for _, node, text in texts:
            w = text.count(" ") + 1
            first[node] = min(first[node], total)
            total += len(text)
            last[node] = total
            chars[node] += len(text)
            words[node] += w
            ends[node] += len(_ENDS.findall(text))
            blocks[node] += 1
            longest[node] = max(longest[node], w)
        for node, runs in enumerate(self.runs):
            links[node] = min(sum(r[2] for r in runs), chars[node])
        parent = self.parent
        tags, paragraphs, items, h1 = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
        group = np.array([GROUPS.get(t, 8) for t in self.tag])
        paragraphs[group == 0] = 1
        items[group == 3] = 1
        h1[group == 1] = 1
        sums_ = (chars, words, ends, links, blocks, tags, paragraphs, items, h1)
        order = self._post_order()
        for node in order:
            if (p := parent[node]) >= 0:
                for x in sums_:
                    x[p] += x[node]
                longest[p] = max(longest[p], longest[node])
                first[p] = min(first[p], first[node])
                last[p] = max(last[p], last[node])
        depth, above = np.zeros(n), [0] * n
        in_group = np.zeros((n, N_GROUPS))
        children: list[list[int]] = [[] for _ in range(n)]
        for node in reversed(order):
            if (p := parent[node]) >= 0:
                depth[node] = depth[p] + 1
                above[node] = above[p] | self.kinds[p]
                in_group[node] = in_group[p]
                in_group[node, group[p]] = 1
                children[p].append(node)
        place, family, before, after, mean_words, alike = (np.zeros(n) for _ in range(6))
        for own in children:
            if own:
                # Text nodes were numbered last; siblings stand in page order.
                own.sort(key=lambda k: (first[k], k))
                m = len(own)
                w = words[own]
                kinds = group[own]
                place[own] = np.arange(m) / m
                family[own] = m
                before[own[1:]] = w[:-1]
                after[own[:-1]] = w[1:]
                mean_words[own] = w.mean()
                alike[own] = (np.bincount(kinds, minlength=N_GROUPS) / m)[kinds]
        up = np.maximum(np.array(parent), 0)
        bits = 1 << np.arange(len(TOKENS))
        own_kinds, anc_kinds = (np.array(self.kinds)[:, None] & bits) > 0, (np.array(above)[:, None] & bits) > 0
        all_chars = max(total, 1)
        log = np.log1p
        numbers = [
            depth, log(chars), log(words), links / np.maximum(chars, 1), log(tags), log(chars / tags), log(words / np.maximum(blocks, 1)), ends / np.maximum(words, 1), log(ends), log(paragraphs),
            items / tags, h1, chars / np.maximum(chars[up], 1), chars / all_chars, np.where(np.isinf(first), 1, first / all_chars), last / all_chars, place, log(family), log(before), log(after),
            log(mean_words), alike, log(longest), log(np.full(n, total)), in_group[:, 7], in_group[:, 9], in_group[:, 10], in_group[:, 11], in_group[:, 12], in_group[:, 13], in_group[:, 4], in_group[:, 5],
        ]
        return np.concatenate([np.eye(N_GROUPS)[group], own_kinds, anc_kinds, np.stack(numbers, axis=1)], axis=1).astype(np.float32)

    def _post_order(self) -> list[int]:
        """Children before parents. Later nodes are never ancestors of earlier ones."""
        return list(range(len(self.tag) - 1, -1, -1))

    def decode(self, probability: np.ndarray) -> np.ndarray:
        """The most likely choice in which a kept node's parent is kept; the root is kept."""
        p = np.clip(probability, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p), np.log1p(-p)
        order = self._post_order()
        for node in order:
            if (up := self.parent[node]) >= 0:
                keep[up] += max(keep[node], drop[node])
                drop[up] += drop[node]
        out = np.zeros(len(p), bool)
        for node in reversed(order):
            up = self.parent[node]
            out[node] = up < 0 or out[up] and keep[node] >= drop[node]
        return out


class Trees:
    """Gradient-boosted regression trees of one depth on the logistic loss; splits come from histograms of BINS quantile bins."""

    BINS = 32

    def __init__(self, count: int = 60, depth: int = 4, rate: float = 0.25, least: float = 8.0, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.least, self.ridge = count, depth, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        width = x.shape[1]
        cuts = np.quantile(x, np.linspace(0, 1, self.BINS + 1)[1:-1], axis=0, method="lower").T
        binned = np.stack([np.searchsorted(np.unique(c), x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
        edges = [np.unique(c) for c in cuts]
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.count, inner), np.int64), np.full((self.count, inner), np.inf, np.float32), np.zeros((self.count, leaves))
        odds = np.full(len(y), self.start)
        offset = np.arange(width) * self.BINS
        for t in range(self.count):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                many = 2**level
                key = (node[:, None] * width * self.BINS + offset + binned).ravel()
                g, h = (np.bincount(key, np.repeat(v, width), many * width * self.BINS).reshape(many, width, self.BINS).cumsum(axis=2) for v in (grad, hess))
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(h < self.least) | (all_h - h < self.least)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                f, b = best // self.BINS, best % self.BINS
                real = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
                for k in range(many):
                    if real[k] and b[k] < len(edges[f[k]]):
                        self.feature[t, many - 1 + k], self.cut[t, many - 1 + k] = f[k], edges[f[k]][b[k]]
                at = many - 1 + node
                node = 2 * node + (x[np.arange(len(x)), self.feature[t, at]] > self.cut[t, at])
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.value[t] = self.rate * g / (h + self.ridge)
            odds += self.value[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        odds, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.count):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.cut[t, at])
            odds += self.value[t, node]
        return 1 / (1 + np.exp(-odds))


def made_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A page by the recipe and the blocks of its article."""
    syllables = "an ti re on the er ou es la de ment ung cion lich sta ver mi so ka no".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + rnd.choice(("." * 5 + "!?"))
    prose = lambda a, b: " ".join(sentence() for _ in range(rnd.randint(a, b)))
    pick = lambda **w: rnd.choices(list(w), list(w.values()))[0]
    attr = lambda *names: rnd.choice(("", f' class="{rnd.choice(names)}"', f' id="{rnd.choice(names)}"', f' class="{rnd.choice(names)} {word()}"', f' class="{word()}"'))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    listed = lambda a, b, tag="ul": f"<{tag}>" + "".join(f"<li>{link(words(1, 4))}</li>" for _ in range(rnd.randint(a, b))) + f"</{tag}>"
    nav = lambda: f"<nav{attr('menu', 'main-nav')}>{listed(2, 9)}</nav>" if rnd.random() < 0.6 else f'<div class="{rnd.choice(("menu", "navbar", "breadcrumbs", "nav-links"))}">{rnd.choice((listed(2, 8), " | ".join(link(word()) for _ in range(rnd.randint(2, 7)))))}</div>'
    ad = lambda: f'<div class="{rnd.choice(("ad", "ads", "advert", "sponsored", "promo banner", "ad-slot"))}">{rnd.choice((prose(1, 2), words(2, 12), link(words(2, 6)), f"<p>{prose(1, 3)}</p>"))}</div>'
    notice = lambda: f'<div class="{rnd.choice(("cookie-notice", "consent", "alert", "popup", "gdpr-banner"))}">{rnd.choice(("", "<p>"))}{prose(1, 3)}</div>'
    foot = lambda: f"<footer{attr('footer', 'site-footer')}>{rnd.choice((f'&copy; {word()} &middot; {prose(1, 1)}', f'<p>{prose(1, 2)}</p>', listed(2, 6), f'<p>&copy; {words(2, 6)}</p>' + listed(1, 5)))}</footer>" if rnd.random() < 0.75 else f'<div class="{rnd.choice(("footer", "copyright", "colophon"))}"><p>{prose(1, 2)}</p></div>'
    side = lambda: rnd.choice((f"<aside{attr('sidebar', 'widget')}>", '<div class="sidebar">', '<div id="rail" class="widget">', '<div class="related">')) + rnd.choice((f"<h3>{words(1, 3)}</h3>{listed(2, 8)}", f"<p>{prose(1, 3)}</p>", f"<h2>{words(1, 3)}</h2><p>{prose(1, 4)}</p>{listed(1, 4)}"))
    form = lambda: f'<form{attr("search", "newsletter", "login")}><p>{words(2, 8)}</p><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>'

    def comments() -> str:
        one = lambda: rnd.choice((f'<li class="comment"><p>{prose(1, 4)}</p></li>', f'<div class="comment"><b>{word()}</b> <p>{prose(1, 5)}</p></div>', f'<div class="reply">{prose(1, 3)}</div>', f"<p>{prose(1, 3)}</p>"))
        return rnd.choice(('<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div class="discussion">')) + rnd.choice(("", f"<h3>{words(1, 3)}</h3>")) + "".join(one() for _ in range(rnd.randint(1, 6)))

    def closed(part: str) -> str:
        tag = re.match(r"<(\w+)", part)[1]
        return part if part.endswith(f"</{tag}>") else f"{part}</{tag}>"

    blocks: list[str] = []
    squeeze = lambda t: " ".join(html_library.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", t))).split())

    def keep(open_tag: str, text: str, close: bool = True) -> str:
        blocks.append(squeeze(text))
        return f"<{open_tag}>{text}" + (f"</{open_tag.split()[0]}>" if close else "")

    def body() -> str:
        out = [keep(pick(h1=6, h2=1), words(2, 10))] if rnd.random() < 0.9 else []
        if rnd.random() < 0.15:
            out = ["<header>", *out, "</header>"] if out else out
        for _ in range(rnd.randint(1, 16)):
            kind = pick(p=60, short=12, open=8, list=4, quote=3, sub=7, ad=5, table=1, pre=1, linked=3, div=3, share=2)
            if kind in ("p", "open"):
                text = prose(1, 8)
                if rnd.random() < 0.1:
                    text = f"<b>{text}.<br>"
                out.append(keep("p", text, kind == "p"))
            elif kind == "short":
                out.append(keep("p", rnd.choice((word().title() + ".", words(1, 5), sentence()))))
            elif kind == "linked":
                out.append(keep("p", f"{prose(1, 2)} {link(words(1, 4))} {prose(1, 2)}"))
            elif kind == "div":
                out.append(keep("div", prose(1, 5)))
            elif kind == "list":
                out.append("<ul>" + "".join(keep("li", rnd.choice((sentence(), words(2, 6)))) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind == "quote":
                out.append(f"<blockquote>{keep('p', prose(1, 3))}</blockquote>")
            elif kind == "sub":
                out.append(keep(rnd.choice(("h2", "h3")), words(1, 7)))
            elif kind == "table":
                out.append("<table>" + "".join("<tr>" + "".join(keep("td", words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
            elif kind == "pre":
                out.append(keep("pre", words(4, 20)))
            elif kind == "ad":
                out.append(closed(ad()))
            else:
                out.append(f'<div class="{rnd.choice(("share", "social", "tags"))}">{" ".join(link(word()) for _ in range(3))}</div>')
        return "".join(out)

    open_main = rnd.choice(("<article>", "<article>", "<article>", "<main>", '<div class="content">', '<div id="main"><div class="post">', f"<main><article{attr('post', 'entry')}>", f'<div class="{word()}">', '<section class="story">', "<div>"))
    close_main = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", open_main)))
    before = [f(()) if False else f() for f in rnd.sample((nav, ad, notice, form, nav), rnd.randint(0, 4))]
    if rnd.random() < 0.4:
        before.insert(0, f"<header{attr('header', 'masthead')}>{rnd.choice((f'<h1>{words(1, 3)}</h1>', f'<p>{words(2, 8)}</p>', link(word())))}{rnd.choice(('', nav()))}</header>")
    if rnd.random() < 0.3:
        before.append(closed(side()))
    inside = body()
    if rnd.random() < 0.12:
        inside += closed(comments())
    after = [closed(comments())] if rnd.random() < 0.35 else []
    after += [closed(f()) for f in rnd.sample((side, ad, form, notice, nav), rnd.randint(0, 3))]
    if rnd.random() < 0.9:
        after.append(closed(foot()))
    head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    stray = rnd.choice(("", "", "", f"<!-- {word()} -->", words(1, 3)))
    return head + stray + "".join(map(closed, before)) + open_main + inside + close_main + "".join(after) + rnd.choice(("</body></html>", "")), blocks


@lru_cache(maxsize=1)
def model(pages: int = 900, seed: int = 3) -> Trees:
    """Trees fitted on made pages: a node is wanted if its subtree has a block of the article."""
    rnd = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        source, blocks = made_page(rnd)
        page = Page(source)
        texts = page.texts()
        wanted = np.zeros(len(page.tag))
        k = 0
        for _, node, text in texts:
            if k < len(blocks) and text == blocks[k]:
                wanted[node] = 1
                k += 1
        if k < len(blocks):
            continue
        for node in page._post_order():
            if (p := page.parent[node]) >= 0:
                wanted[p] = max(wanted[p], wanted[node])
        xs.append(page.features(texts))
        ys.append(wanted)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(sources: list[str | None], trees: Trees) -> list[list[str]]:
    """The blocks of the article of each page."""
    pages = [Page(s or "") for s in sources]
    texts = [p.texts() for p in pages]
    live = [k for k, t in enumerate(texts) if t]
    out: list[list[str]] = [[] for _ in pages]
    if not live:
        return out
    x = [pages[k].features(texts[k]) for k in live]
    at = np.cumsum([0] + [len(f) for f in x])
    probability = trees.predict(np.concatenate(x))
    for n, k in enumerate(live):
        kept = pages[k].decode(probability[at[n] : at[n + 1]])
        out[k] = [text for _, node, text in texts[k] if kept[node]]
    return out


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = ["\n\n".join(b) for b in extract(part.column(2).to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
