"""Main text of web pages as the maximum-scoring run of their words and tags.

A page is read as a sequence of tags and of words. Words score one point; a tag scores below zero, the lower the more often it stood outside
the content of the labelled pages. Elements that never hold content (scripts, styles, forms, menus, and blocks whose class or
id says notice, advert, comments and the like) are left out before. One linear scan finds the run with the highest
sum, which on pages that mark no article is widened to the running text of the element around it, and its text is put together block by block.

Markup is read in one pass: comments, declarations, tags with their attributes as HTML reads them (a value in quotes holds ``>``, one without
doesn't), and elements whose content is no markup. Defined results: null or empty html, or html without words, gives an empty text; a tag, comment or
declaration that the page ends inside is left out with all behind it; an element that is never closed (``<nav>`` without ``</nav>``) leaves out only the
text up to the next tag; an element whose class, id or role names furniture stays where the page's article, main part or first heading is inside of it; a quote that is never closed is part of a value without quotes; of runs with equal sums the first wins; of attributes only class,
id, role, hidden and aria-hidden by their whole names leave an element out, never what other attributes' values say; repeated rows are
extracted each by itself; other columns are passed on, whatever their names, but for ``html`` and one named as the result; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.names import unused
from planmatch.llm.words import slices

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
#: Elements that hold no content, by name; fixed by the HTML vocabulary.
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "label", "fieldset", "canvas", "object", "audio", "video", *RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words that name furniture; a class, id or role is furniture's if its words (between spaces, dashes and underscores) are these and neutral ones alone: ``sidebar-left`` is, ``with-sidebar`` and ``social-science`` aren't.
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "sponsor", "sponsored", "promo", "promotion", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars",
    "footer", "header", "masthead", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "comment", "comments", "commentlist", "replies", "disqus", "share", "sharing", "social",
    "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager", "search", "login", "signup", "contentinfo", "complementary", "alert",
}
NEUTRAL = {
    "site", "page", "top", "bottom", "left", "right", "main", "global", "primary", "secondary", "inner", "outer", "wrap", "wrapper", "container", "box", "bar", "area", "block", "section", "region", "list", "item", "items", "links", "link", "buttons", "button",
    "icons", "posts", "articles", "stories", "form", "panel", "group", "thread", "media", "us", "the", "a", "of", "js", "mobile", "desktop", "sticky", "fixed",
}
#: What readers wrote is furniture even where it is marked up as an article.
READERS = {"comment", "comments", "commentlist", "replies", "disqus"}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W_]+")
#: Elements that hold blocks, and blocks of running text.
HOLDERS = {"div", "section", "td", "center", "dd", "li", "figure", "details", "body", "html", "table", "tr", "tbody", "ul", "ol", "dl"}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What stands before an attribute's name, the name, and the sign before its value.
ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
NUMBERS = re.compile(r"&#(?:[0-9]{100,}|[xX][0-9a-fA-F]{100,});?")
WHITE = re.compile(r"[ \t\n\r\f\v ]+")

#: Labelled pages: what stands between the two marks is content.
LABELLED = (
    "<html><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><article>⟦<h1>A title</h1><p>Some words of the text.</p><p><b>More words</b> and <i>more</i>.<br><p>The end.</p>⟧</article><footer>Legal words</footer></body></html>",
    "<html><body><div><a>Top</a> <a>About</a></div><div>⟦<h2>Head</h2><p>First part with <a>a link</a> inside.</p><ul><li>One point</li><li>Two points</li></ul><p>Last part.</p>⟧</div><div><a>Next</a></div></body></html>",
    "<html><body><header><span>Site</span></header><main>⟦<h1>Name</h1><blockquote><p>Said by one.</p></blockquote><p>Then <em>some</em> <strong>text</strong> goes on.</p><pre>code here</pre>⟧</main><aside><ul><li><a>Other</a></li></ul></aside></body></html>",
    "<html><body><table><tr><td><a>Left</a></td></tr></table><section>⟦<p>Words in a section.</p><table><tr><td>cell</td><td>cell</td></tr></table><p>And <span>so on</span>.</p>⟧</section><form><input><button>Send</button></form></body></html>",
    "<html><body><div><div>Advert words</div></div><article>⟦<h1>Other title</h1><div><p>Plain words <a>follow</a> here.</p></div><p>And here.</p><h3>Sub</h3><p>Last of it.</p>⟧</article><div>Words beside it<ul><li><a>Reply</a></li></ul></div><footer><a>Imprint</a></footer></body></html>",
)


@functools.lru_cache(1 << 12)
def furniture(value: str) -> str:
    """What a class, id or role says of its element: ``readers`` wrote it, it is other ``furniture``, or nothing."""
    found = ""
    for token in value.split():
        words = [w.lower() for w in PARTS.findall(token) if not w.isdigit()]
        if any(w in FURNITURE for w in words) and all(w in FURNITURE or w in NEUTRAL for w in words):
            found = "readers" if found == "readers" or any(w in READERS for w in words) else "furniture"
    return found


def excluded(name: str, attributes: list[tuple[str, str]], holds) -> bool:
    """Whether an element is left out. ``holds``: tells whether the page's article, its main part or its first heading stand inside, which no furniture has but for readers' comments."""
    if name in OUTSIDE:
        return True
    if not attributes or name in ("html", "body", "article", "main") or name in VOID:
        return False
    if any(k == "hidden" or k == "aria-hidden" and v.lower() == "true" for k, v in attributes):
        return True
    said = {furniture(v) for k, v in attributes if k in ("class", "id", "role") and len(v) < 1000}
    return "readers" in said or "furniture" in said and not holds()


class Scan:
    """One pass over a page. Of each closing mark it is remembered that none is left, so that no search is made twice in vain."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, mark: str, at: int) -> int:
        if mark in self.gone:
            return -1
        place = self.page.find(mark, at)
        if place < 0:
            self.gone.add(mark)
        return place

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes of a tag from behind its name, and the place behind its end; -1 if the page ends first."""
        page, out = self.page, []
        while at < len(page):
            m = ATTRIBUTE.match(page, at)
            name, at = m[1].lower(), m.end()
            if m[2] is None:
                if name:
                    out.append((name, ""))
                if page[at : at + 1] == ">":
                    return out, at + 1
                continue
            quote = page[at : at + 1]
            end = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            if end >= 0:
                out.append((name, page[at + 1 : end]))
                at = end + 1
            else:
                value = BARE.match(page, at)
                out.append((name, value[0].strip("\"'")))
                at = value.end()
        return out, -1

    def raw_end(self, name: str, at: int) -> int:
        """Where the closing tag of an element without markup inside begins; -1 if there is none."""
        if f"</{name}" in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        if not m:
            self.gone.add(f"</{name}")
        return m.start() if m else -1

    def tags(self):
        """(start, end, name with a slash before it where closing, attributes) of each piece of markup in order; comments and declarations have no name."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            closing = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + closing)
            if name:
                attributes, end = self.attributes(name.end())
                yield at, end if end >= 0 else len(page), ("/" if closing else "") + name[0].lower() if end >= 0 else "", attributes
            elif closing or page[at + 1 : at + 2] in ("!", "?"):
                mark, back = ("-->", 2) if page.startswith("<!--", at) else ("]]>", 9) if page.startswith("<![CDATA[", at) and self.find("]]>", at + 9) >= 0 else (">", 2)
                found = self.find(mark, at + back)
                end = found + len(mark) if found >= 0 else -1
                yield at, end if end >= 0 else len(page), "", []
            else:
                at += 1  # a sign in the text
                continue
            if end < 0:
                return
            at = end
            if name and not closing and (low := name[0].lower()) in RAW and (stop := self.raw_end(low, at)) >= 0:
                _, end = self.attributes(stop + 2 + len(low))
                yield at, end if end >= 0 else len(page), f"/{low}", []
                if end < 0:
                    return
                at = end


def items(page: str) -> list[tuple[str, str]]:
    """(tag, '') and ('', text) in page order, without excluded elements. Closing tags begin with a slash."""
    found, at = [], 0
    for start, end, name, attributes in Scan(page).tags():
        if start > at:
            found.append(("", page[at:start], []))
        if name:
            found.append((name, "", attributes))
        at = end
    if at < len(page):
        found.append(("", page[at:], []))
    # the place of each tag's end: from the back, by name
    closes: dict[str, list[int]] = {}
    end = [-1] * len(found)
    for i in range(len(found) - 1, -1, -1):
        name = found[i][0]
        if name[:1] == "/":
            closes.setdefault(name[1:], []).append(i)
        elif name and closes.get(name):
            end[i] = closes[name].pop()
    marks = [i for i, (n, _, _) in enumerate(found) if n in ("article", "main", "h1")]
    out, i = [], 0
    while i < len(found):
        name, text, attributes = found[i]
        if name and name[0] != "/" and excluded(name, attributes, lambda: bisect_left(marks, end[i]) > bisect_left(marks, i)):
            out.append((name, ""))
            if name not in VOID:
                i = end[i] if end[i] > 0 else i + 1 if i + 1 < len(found) and not found[i + 1][0] else i
        else:
            out.append((name, text))
        i += 1
    return out


def keyed(found: list[tuple[str, str]]) -> list[str]:
    """What each item is scored as: its tag, or ``word``, with ``in `` before it inside an article (inside main, if the page has no article)
    and ``by `` before words outside of it."""
    mark = next((m for m in ("article", "main") if any(n == m for n, _ in found)), None)
    depth, out = 0, []
    for name, _ in found:
        tag = name.lstrip("/")
        if tag == mark:
            depth = depth + 1 if name == tag else max(0, depth - 1)
            out.append(tag)
        else:
            out.append(("in " if depth else "" if name or not mark else "by ") + (tag or "word"))
    return out


def item_weights(labelled: tuple[str, ...] = LABELLED, strength: float = 6.0) -> dict[str, float]:
    """Scores from labelled pages: of tags, minus the log-odds of standing outside the content and a small cost at least; of words, one
    point, or the log-odds of standing in the content where words beside a marked article are concerned."""
    counts: dict[str, list[int]] = {}
    for page in labelled:
        on, found = False, items(page)
        for key, (_, text) in zip(keyed(found), found):
            on = on or "⟦" in text
            counts.setdefault(key, [0, 0])[on] += max(1, len(text.split()))
            on = on and "⟧" not in text
    odds = {k: strength * math.log((inside + 0.5) / (outside + 0.5)) for k, (outside, inside) in counts.items()}
    return {k: (min(0.0, v) if k[:3] == "by " else 1.0) if k.endswith("word") else min(-0.02, v) for k, v in odds.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the first run with the highest sum above zero."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12:
            best, at = total, (start, i + 1)
    return at


def score(key: str, text: str, weights: dict[str, float]) -> float:
    """A tag that no labelled page has costs little inside an article and a point elsewhere."""
    if key.endswith("word"):
        return weights.get(key, 0.0 if key[:3] == "by " else 1.0) * len(text.split())
    return weights.get(key, -0.02 if key[:3] == "in " else -1.0)


def decoded(text: str) -> str:
    """Character references decoded; numbers far beyond Unicode, which int() refuses, as the standard's replacement."""
    return entities.unescape(NUMBERS.sub(lambda m: "\ufffd" if m[0].strip("&#;xX").lstrip("0")[10:] else f"&#{m[0][2:].lstrip('0')}" if m[0][2] not in "xX" else f"&#x{m[0][3:].lstrip('0')}", text))


def widened(found: list[tuple[str, str]], a: int, b: int) -> tuple[int, int]:
    """The run, widened to all running text of the element that holds it, so that what costs much in between, a list of links say, cuts no paragraph off.
    Only on pages that mark no article, and not to the body's own."""
    up, close, inside, open_ = {}, {}, [-1] * len(found), []
    for i, (name, _) in enumerate(found):
        tag = name.lstrip("/")
        if tag in HOLDERS and name == tag:
            up[i] = open_[-1] if open_ else -1
            open_.append(i)
        elif tag in HOLDERS and any(found[x][0] == tag for x in open_[-8:]):
            while found[x := open_.pop()][0] != tag:
                close[x] = i
            close[x] = i
        inside[i] = open_[-1] if open_ else -1
    written = [i for i in range(a, b) if not found[i][0] and found[i][1].strip()]
    if not written or any(n in ("article", "main") for n, _ in found):
        return a, b
    holder = inside[written[0]]
    while holder >= 0 and (close.get(holder, len(found)) < written[-1] or found[holder][0] in ("li", "ul", "ol", "tr", "tbody")):
        holder = up[holder]
    if holder < 0 or found[holder][0] in ("body", "html", "table"):
        return a, b
    own, i, end = [], holder, close.get(holder, len(found))
    while i < end:
        if inside[i] == holder and found[i][0] in RUNNING:
            j = i + 1
            while j < end and found[j][0].lstrip("/") not in BLOCKS:
                j += 1
            if any(not n and t.strip() for n, t in found[i:j]):
                own += [i, j]
            i = j
        else:
            i += 1
    return (min(a, own[0]), max(b, own[-1])) if own else (a, b)


def extract(page: str, weights: dict[str, float]) -> str:
    found = items(page)
    a, b = widened(found, *best_run([score(k, t, weights) for k, (_, t) in zip(keyed(found), found)]))
    blocks, now = [], []
    for name, text in found[a:b]:
        if not name:
            now.append(text)
        elif name.lstrip("/") in BLOCKS:
            blocks.append(now)
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append(now)
    lines = (WHITE.sub(" ", decoded("".join(x))).strip(" ") for x in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text`` added or replaced."""
    weights = item_weights()
    keep = [c for c in pages.columns if c.lower() != text.lower()]
    (source,) = unused(keep, "html_source")
    pages = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias(source))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1]]

    def go(batches):
        for batch in slices(batches, source, 4 << 20):
            out = pa.array([extract(h or "", weights) for h in batch.column(source).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=[*keep, text])

    return pages.mapInArrow(go, ", ".join([*kinds, f"`{text}` string"]))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
