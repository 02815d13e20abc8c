"""Main text of a web page by line-block distribution.

Markup is stripped: scripts, styles and the like go with what they hold, tags of blocks end a line, other tags and
line breaks inside a block are white space. What is left are lines, one a block. A line inside an element that is no
part of an article (menus, headers and footers of the page, sidebars, notices, adverts, forms, comments of readers)
weighs nothing; a line inside what the page names its article (<article>, <main> or such a role) weighs ARTICLE times
its characters, so that a short paragraph there surges alone; any other as many as it has outside links, and a paragraph
or heading 1 at least, so that one that is a link belongs to the stretch beside it. Elements are known by their name, role,
or a class or id all of whose parts are names of such things or say where or what kind they are ("cookie-notice", "site-footer", not
"has-sidebar" or "related-work"); <main> holds the article whatever class is around it. Sums of these
weights over windows of WINDOW lines are the distribution. It surges where a window begins to reach the threshold and
dives where no window reaches it any more; the lines between the two that are not outside are the text, on every page
and from every stretch. The threshold is SURGE, less where the page has less.

Null and empty pages, and pages without text, give an empty text. Broken markup is read as far as it goes: what is
still open at the end is closed there, a script or style too; any other element that is dropped with its text, and is never closed, loses its
tag alone. A head needs no end tag, as only what belongs in one is dropped. Repeated rows give equal texts; an empty table gives an empty one; columns
other than page_id, url and html are neither read nor returned. Nothing is cut off, and time grows with a page's length.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_udf

WINDOW, SURGE, ARTICLE = 3, 40, 40

# HTML's elements by what they do to lines, and names that mark what is no part of an article.
_RAW = frozenset("script style".split())
_DROPPED = _RAW | frozenset("audio button canvas iframe math noscript object select svg template textarea title video".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_HOLDERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul blockquote".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_OUTSIDE = frozenset("nav aside footer form dialog menu".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination "
    "popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_QUALIFIERS = frozenset(
    "area articles bar block body bottom box btn buttons card cards center column container content copyright custom desktop fixed form global group icons inner item items large left link links list media message mobile more outer panel posts primary quick "
    "reader right row secondary section side site slot small stack sticky stories story strip stub tertiary text thread title top unit user users view wrap wrapper".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_CLOSING = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _DROPPED}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_NAMES = _OUTSIDE_NAMES | _QUALIFIERS
_SPACE = re.compile(r"[\x20\x09-\x0D\xa0]+")


@dataclass
class Line:
    text: str
    outside: bool
    article: bool
    linked: int  # characters inside links
    paragraph: bool  # or heading


def _is_outside(name: str, rest: str, in_article: bool) -> bool:
    if name in _OUTSIDE or name == "header" and not in_article:
        return True
    if "=" not in rest:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            if _OUTSIDE_ROLES.intersection(value.split()):
                return True
        elif kind == "aria-hidden":
            if value == "true":
                return True
        elif name not in ("article", "main", "body", "html"):
            for word in value.split():
                parts = {x for x in _NAME_PARTS.split(word) if x and not x.isdigit()}
                if not parts.isdisjoint(_OUTSIDE_NAMES) and parts <= _NAMES:
                    return True
    return False


def lines(page: str) -> list[Line]:
    out: list[Line] = []
    parts: list[str] = []
    linked, block = 0, ""
    stack: list[tuple[str, bool, bool]] = []  # open holders: name, outside, article, each with what is around it
    link = 0
    open_to_the_end: set[str] = set()  # elements that nothing closes from here on

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                _, outside, article = stack[-1] if stack else ("", False, False)
                out.append(Line(text, outside, article, min(linked, len(text)), block in _PARAGRAPHS))
            parts.clear()
            linked = 0

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS:
            flush()
            block = "" if m["end"] else name
        if name in _DROPPED:
            if not m["end"] and not m["rest"].endswith("/") and name not in open_to_the_end:
                close = _CLOSING[name].search(page, at)
                if close:
                    at = close.end()
                elif name in _RAW:
                    at = len(page)
                else:
                    open_to_the_end.add(name)
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        if name == "a":
            link = 0 if m["end"] else 1
        if name in _HOLDERS:
            _, outside, article = stack[-1] if stack else ("", False, False)
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not m["rest"].endswith("/"):
                own = name in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?(?:main|article)\b", m["rest"], re.I) is not None
                outside = _is_outside(name, m["rest"], article) or outside and name != "main"
                stack.append((name, outside, article or own))
        elif name in _BLOCKS and not m["end"] and _is_outside(name, m["rest"], True):
            # a paragraph, heading or item that is marked itself: its line, up to the next block, is outside
            parts.append("\0")
    if at < len(page):
        rest = page[at:]
        parts.append(rest if "<" not in rest or not re.match(r"</?[a-zA-Z!]", rest[rest.rfind("<") :]) else rest[: rest.rfind("<")])
    flush()
    for line in out:
        if "\0" in line.text:
            line.text, line.outside = line.text.replace("\0", "").strip(" "), True
    return out


def weights(page: list[Line]) -> tuple[list[int], int]:
    """What each line weighs, and the threshold of the page."""
    out = [0 if x.outside else ARTICLE * len(x.text) if x.article else max(len(x.text) - x.linked, int(x.paragraph)) for x in page]
    return out, max(1, min(SURGE, max((sum(out[i : i + WINDOW]) for i in range(len(out))), default=1)))


def stretches(weight: list[int], threshold: int) -> list[tuple[int, int]]:
    """First and last line of each stretch between a surge and the dive after it."""
    window, found, begin = sum(weight[:WINDOW]), [], -1
    for i in range(len(weight)):
        if window >= threshold and weight[i]:
            if begin < 0:
                begin = i
        elif window < threshold and begin >= 0:
            # the lines of the last window that reached the threshold still belong to the stretch
            found.append((begin, max(j for j in range(begin, min(len(weight), i + WINDOW - 1)) if weight[j])))
            begin = -1
        window += (weight[i + WINDOW] if i + WINDOW < len(weight) else 0) - weight[i]
    if begin >= 0:
        found.append((begin, max(j for j in range(begin, len(weight)) if weight[j])))
    return found


def extract(page: str) -> str:
    found = lines(page)
    weight, threshold = weights(found)
    parts = stretches(weight, threshold)
    keep = sorted({j for a, b in parts for j in range(a, b + 1) if not found[j].outside})
    return "\n".join(found[j].text for j in keep)


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def setup():
        def one(page: str) -> tuple[str, int]:
            text = extract(page)
            return text, len(text)

        return one

    f = text_udf("text string, n_chars long", setup)
    return small_batches(pages).select("page_id", "url", f(F.col("html").cast("string")).alias("r")).select("page_id", "url", "r.text", "r.n_chars")
