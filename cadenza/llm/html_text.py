"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each at a node of the tree of tag paths
(tag and classes from the root on). Length, punctuation and link text are summed
by path. A path's ratio is its text per block, raised by punctuation and lowered
by links. Ratios are smoothed over the paths that stand next to each other in
the page and fused up the tree: a path gives its ratio times its text to all of
its containers. From the root on the search goes down while one child holds
nearly all that is fused there; the container that it reaches is the content,
with the containers beside it whose fused ratio comes near its own.

Tags and classes weigh, but don't decide: a path inside something that calls
itself boilerplate (adverts, comments and so on) is left out, but never what
holds the article that most of the page's ratios fall to, nor the article itself;
where nothing else has content, an element that holds the layout of a page
(a form around everything, say) is taken for a wrapper. A class calls itself
boilerplate only if all of its words do or go along with such words (ad-slot, not
ad-hoc). Words with more than one use (share, notice, header) only lower a ratio.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import arrow_map

#: Tags without content text, tags of boilerplate, tags that end without an end tag, and tags inside a block.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noframes"}
NEVER = {"nav", "footer", "aside", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "head", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
#: Words of a class, id or role that declare boilerplate, those that only may, and words beside them that say otherwise.
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "footer", "comment", "comments", "disqus", "replies", "cookie", "cookies", "consent", "gdpr", "popup", "newsletter", "pagination", "pager",
}
WEAK = {
    "banner", "promo", "header", "reply", "modal", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "widget", "notice",
    "disclaimer", "copyright", "toolbar", "masthead",
}
#: Words that go along with them in one class; with any other word it says nothing.
COMPANY = {
    "slot", "box", "container", "block", "area", "unit", "wrap", "list", "section", "bar", "item", "items", "inner", "outer", "left", "right", "top", "bottom", "form", "thread", "link", "links",
    "site", "main", "page", "post", "posts", "article", "user", "google", "global", "primary", "secondary", "mobile", "sub", "inline", "reader", "js", "text", "button", "buttons", "icon", "icons",
    "label", "content", "placeholder", "overlay", "dialog", "letter", "message", "author", "meta", "body",
}
#: A start tag that ends an open element of the same list.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an implied end doesn't cross.
SCOPES = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "html", "blockquote", "td", "th", "aside", "nav", "footer", "header", "form"}
#: Elements in whose text a button is a word.
SENTENCE = {"p", "li", "dd", "td", "blockquote"}
MAIN, LAYOUT = {"article", "main"}, {"article", "main", "h1", "nav", "footer", "header", "aside"}
#: The weight of neighbours in smoothing, of punctuation, and of a word that may declare boilerplate.
SMOOTH, PUNCTUATION, LOWERED = 0.25, 10, 0.4
#: The share of a container's content that a child must hold for the search to go down, the share of the content's ratio that a container beside it needs, and a weak path inside.
DOWN, BESIDE, INSIDE = 0.8, 0.5, 0.2
#: The link text of boilerplate, and the share of content outside of declared boilerplate with which it is believed.
MOST_LINKS, BELIEVED = 0.6, 0.02

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_DECLARES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?。，；：！？]")
_SPACE = re.compile(r"\s+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

#: What is known of an element: nothing, it may be boilerplate, it calls itself so, its tag says so.
PLAIN, MAYBE, DECLARED, OUT = range(4)


def _judged(tag: str, attributes: str, inside_main: bool) -> int:
    if tag in NEVER or (tag == "header" and not inside_main):
        return OUT
    found = DECLARED if tag in ("form", "fieldset") else MAYBE if tag == "header" else PLAIN
    if not attributes or tag in ("html", "body"):
        return found
    if _HIDDEN.search(attributes):
        return OUT
    for m in _DECLARES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORD.findall(token)}
            if all(w in STRONG or w in WEAK or w in COMPANY or w.isdigit() for w in words):
                found = max(found, DECLARED if words & STRONG else MAYBE if words & WEAK else PLAIN)
    return found


class Page:
    """The tree of tag paths (node 0 is the root; parents stand before their children) and the blocks of a page."""

    def __init__(self):
        self.parent, self.tag, self.judged, self.wraps, self.times = [0], [""], [PLAIN], [False], [1]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters of links
        self._nodes: dict[tuple[int, str, int], int] = {}

    def node(self, parent: int, tag: str, name: str, judged: int) -> int:
        found = self._nodes.setdefault((parent, name, judged), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.judged.append(judged)
            self.wraps.append(False)
            self.times.append(0)
        self.times[found] += 1
        return found


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends the tag whose attributes start at ``at``; -1 if there is none. Quotes count behind an = only."""
    start, before = at, at
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if html[before : m.start()].rstrip().endswith("=") and m.start() < last[m[0]]:
            at = html.index(m[0], at) + 1
        before = at
    return html.find(">", start)


def read(html: str) -> Page:
    """The blocks of text in page order, without those inside an element that is OUT; character references are decoded. Linear in the page."""
    page = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, node, OUT
    parts: list[str] = []
    opened: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]  # by open scope, the open elements that an implied end may close
    unwrapped: list[int] = []  # open DECLARED nodes in which no part of a layout was found yet
    closable = {t for c in CLOSES.values() for t in c}
    out = links = in_link = main = 0
    last = {q: html.rfind(q) for q in "\"'"}

    def flush():
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                page.blocks.append((stack[-1][1] if stack else 0, text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop():
        nonlocal out, in_link, main
        tag, node, is_out = stack[-1]
        if tag not in INLINE and (is_out or tag != "button"):
            flush()
        stack.pop()
        opened[tag] -= 1
        out, in_link, main = out - is_out, in_link - (tag == "a"), main - (tag in MAIN)
        if tag in SCOPES:
            scopes.pop()
        if tag in closable:
            scopes[-1][tag] -= 1
        if unwrapped and unwrapped[-1] == node and tag not in INLINE:
            unwrapped.pop()

    def pop_through(tags):
        while stack[-1][0] not in tags:
            pop()
        pop()

    def add(text: str):
        nonlocal links
        if text and not out:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(text.strip())

    at = text_from = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            add(html[text_from:at])
            found = re.compile(r"--!?>").search(html, at + 2)
            at = text_from = found.end() if found else len(html)
            continue
        if html.startswith(("<!", "<?"), at):
            add(html[text_from:at])
            stop = html.find(">", at)
            at = text_from = stop + 1 if stop >= 0 else len(html)
            continue
        m = _NAME.match(html, at + 1)
        if not m:  # a < of the text
            at += 1
            continue
        add(html[text_from:at])
        tag, ending = m[1].lower(), html[at + 1] == "/"
        stop = _tag_end(html, m.end(), last)
        if stop < 0:  # cut inside a tag
            text_from = len(html)
            break
        attributes = html[m.end() : stop]
        at = text_from = stop + 1
        if ending:
            if opened.get(tag):
                pop_through((tag,))
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            found = _ENDS[tag].search(html, at)
            if tag in ("textarea", "xmp", "iframe"):
                flush()
            at = text_from = found.end() if found else len(html)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        word = tag == "button" and bool(stack) and stack[-1][0] in SENTENCE and any(x.strip() for x in parts)  # a word of the sentence
        if tag not in INLINE and not word:
            for ended in (*CLOSES.get(tag, ()), "p"):
                if scopes[-1].get(ended):
                    pop_through((ended,))
            flush()
        if attributes.endswith("/"):
            continue
        above = stack[-1][1] if stack else 0
        judged = PLAIN if word else _judged(tag, attributes, main > 0)
        if tag in INLINE or word:
            node = above
            judged = judged if judged == OUT else PLAIN
        else:
            c = _CLASS.search(attributes) if attributes else None
            node = page.node(above, tag, tag + ("." + ".".join(sorted((c[1] or c[2] or c[3] or "").split())) if c else ""), judged)
        if judged == OUT and tag not in INLINE:
            flush()
        if tag in LAYOUT:
            for n in unwrapped:
                page.wraps[n] = True
            unwrapped.clear()
        if judged == DECLARED:
            unwrapped.append(node)
        stack.append((tag, node, judged == OUT))
        opened[tag] = opened.get(tag, 0) + 1
        out, in_link, main = out + (judged == OUT), in_link + (tag == "a"), main + (tag in MAIN)
        if tag in closable:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in SCOPES:
            scopes.append({})
    add(html[text_from:])
    flush()
    return page


def ratios(page: Page) -> tuple[dict[int, float], dict[int, float], dict[int, int]]:
    """By path with text, in page order: the smoothed ratio, the share of link text, and the characters."""
    size: dict[int, int] = {}
    count, marks, links = {}, {}, {}
    for node, text, linked in page.blocks:
        size[node] = size.get(node, 0) + len(text)
        count[node] = count.get(node, 0) + 1
        marks[node] = marks.get(node, 0) + len(_MARKS.findall(text))
        links[node] = links.get(node, 0) + linked
    order = list(size)
    share = {p: links[p] / size[p] for p in order}
    own = [(size[p] + PUNCTUATION * marks[p]) / count[p] * (1 - share[p]) ** 2 for p in order]
    smooth = {p: own[i] + SMOOTH * sum(own[j] - own[i] for j in (i - 1, i + 1) if 0 <= j < len(own)) for i, p in enumerate(order)}
    return {p: max(0.0, x) for p, x in smooth.items()}, share, size


def _article(page: Page, weight: dict[int, float], gone: list[bool]) -> int:
    """The one article in declared boilerplate that outweighs all that isn't in such, if no article stands outside; else 0.

    An article that calls itself boilerplate is none, nor are several of one path (comments, say). What an article declares inside of itself doesn't count for it.
    """
    nodes = range(len(page.parent))
    clear, free = [0.0] * len(nodes), [0.0] * len(nodes)  # what stands in a node without a declaration from there on, and what isn't gone
    for p, w in weight.items():
        clear[p], free[p] = w, 0.0 if gone[p] else w
    for n in reversed(nodes[1:]):
        if page.judged[n] == DECLARED:
            clear[n] = 0.0
        if page.tag[n] in MAIN and free[n] > 0:
            return 0
        clear[page.parent[n]] += clear[n]
        free[page.parent[n]] += free[n]
    articles = [n for n in nodes[1:] if page.tag[n] in MAIN and page.times[n] == 1 and clear[n] > 0]
    best = max(articles, key=lambda n: (clear[n], -n), default=0)
    return best if best and clear[best] >= free[0] else 0


def select(page: Page) -> list[str]:
    """The texts of the content blocks."""
    if not page.blocks:
        return []
    smooth, share, size = ratios(page)
    nodes = range(len(page.parent))

    def declared(absolved) -> list[bool]:
        """The nodes inside of declared boilerplate that isn't absolved."""
        found = [False] * len(nodes)
        for n in nodes[1:]:
            found[n] = found[page.parent[n]] or (page.judged[n] == DECLARED and n not in absolved)
        return found

    gone = declared(())
    everything = sum(smooth[p] * size[p] for p in smooth)
    article = _article(page, {p: smooth[p] * size[p] for p in smooth}, gone)
    absolved = set()
    while article:
        absolved.add(article)
        article = page.parent[article]
    if absolved:
        gone = declared(absolved)
    if sum(smooth[p] * size[p] for p in smooth if not gone[p]) < BELIEVED * everything:
        gone = declared({n for n in nodes if page.wraps[n]} | absolved)
    lowered = [1.0] * len(nodes)
    for n in nodes[1:]:
        lowered[n] = lowered[page.parent[n]] * (LOWERED if page.judged[n] == MAYBE else 1.0)
    ratio = {p: 0.0 if gone[p] else smooth[p] * lowered[p] for p in smooth}
    fused, text, inner = [0.0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for p in ratio:
        fused[p], text[p] = ratio[p] * size[p], 0 if gone[p] else size[p]
    children: list[list[int]] = [[] for _ in nodes]
    for n in reversed(nodes[1:]):
        fused[page.parent[n]] += fused[n]
        text[page.parent[n]] += text[n]
        if text[n]:
            inner[page.parent[n]] = True
            children[page.parent[n]].append(n)
    if fused[0] <= 0:
        return []
    chain = [0]
    while page.tag[chain[-1]] not in MAIN:
        below = max((n for n in children[chain[-1]] if inner[n]), key=lambda n: (fused[n], -n), default=None)
        if below is None or fused[below] < DOWN * fused[chain[-1]]:
            break
        chain.append(below)
    best = chain[-1]
    density = fused[best] / text[best]
    kept, inside = [False] * len(nodes), [False] * len(nodes)
    kept[best], inside[best] = True, page.tag[best] in MAIN
    above = set(chain[:-1])
    for n in nodes[1:]:
        inside[n] = inside[n] or inside[page.parent[n]]
        if kept[page.parent[n]]:
            kept[n] = True
        elif page.parent[n] in above and n not in above and n != best and text[n]:
            kept[n] = page.judged[n] == PLAIN and (fused[n] / text[n] >= BESIDE * density or page.tag[n] == "h1")
    own = [n in above and ratio.get(n, 0.0) >= BESIDE * density for n in nodes]  # text that stands in a container of the content

    def is_content(p: int) -> bool:
        return (kept[p] or own[p]) and not gone[p] and (share[p] <= MOST_LINKS or inside[p]) and (lowered[p] == lowered[best] or ratio[p] >= INSIDE * density)

    content = {p: is_content(p) for p in smooth}
    return [t for p, t, _ in page.blocks if content[p]]


def main_text(html: str) -> str:
    return " ".join(select(read(html)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page, and one without content, has the empty text;
    unclosed and cut markup is read as far as it goes; of containers with equal
    content the first is taken; a page of any length is read whole, in time
    linear in it; repeated rows are read each; other columns are ignored,
    whatever their names; an empty table gives an empty table; no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return arrow_map(source, run, "page_id long, url string, text string, n_chars long")
