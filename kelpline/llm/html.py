"""HTML pages to styled text blocks: a forgiving tokenizer that knows which elements end others and which hold no text."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']+|"[^"]*"|'[^']*')*+|[^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed sets of HTML element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "br"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PROSE = frozenset(("p", "li", "blockquote", "pre", "dd", "dt", "tr", "figcaption", "caption")) | HEADINGS
NOISE = frozenset("nav header footer aside form menu dialog search head button fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar aside widget related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar comment comments disqus reply replies respond login search toolbar copyright legal skip teaser outbrain taboola".split()
)
#: Within main content, these name parts of an article too, and a compound name says boilerplate only with the last of these.
MILD_WORDS = frozenset("header footer notice notices alert related legal copyright skip topbar masthead reply replies respond search login".split())
HOLDERS = frozenset("bar block box button buttons container form inner item items link links list panel row section unit wrap wrapper area slot tools".split())
#: An opening tag of the first kind ends an open element of the second kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}


def key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries: its style path, that of its parent, its element, and where it lies."""

    path: str
    parent: str
    tag: str
    noise: bool
    main: bool
    text: str


def _says_noise(names: list[str], inside: bool) -> bool:
    """Whether a class or id says boilerplate; inside: within main content, where a word within a name is no proof."""
    for n in names:
        words = {w for w in re.split(r"[-_]+", re.sub(r"([a-z])(?=[A-Z0-9])", r"\1-", n)) if w}
        if not inside and not words.isdisjoint(NOISE_WORDS):
            return True
        if inside and words <= NOISE_WORDS | HOLDERS and not words.isdisjoint(NOISE_WORDS - MILD_WORDS):
            return True
    return False


def _style(tag: str, attributes: str, inside: bool = False) -> tuple[str, bool, bool]:
    """(style of an element, whether its name says boilerplate, whether it says main content)."""
    if not attributes.strip():
        return tag, tag in NOISE, tag in ("article", "main")
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = sorted({*found.get("class", "").lower().split(), *found.get("id", "").lower().split()})
    role = found.get("role", "").lower()
    noise = tag in NOISE or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or (tag not in HEADINGS and tag not in ("body", "html", "article", "main") and _says_noise(names, inside))
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    return tag + "".join("." + re.sub(r"\d+", "#", n) for n in names), noise, main


def blocks(source: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """(text blocks in page order, child elements of each block element by style path)."""
    source = source or ""
    out: list[Block] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, noise, main
    text: list[str] = []

    def close() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            tag, path, noise, main = stack[-1]
            out.append(Block(path, stack[-2][1] if len(stack) > 1 else "", tag, noise, main, joined))

    def pop_to(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, last = 0, source.rfind(">")
    while at < len(source):
        m = _TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None  # no tag ends any more
        text.append(html.unescape(source[at : m.start() if m else len(source)]))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close()
                pop_to((tag,))
            elif tag in CELLS:
                text.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in CELLS:
            text.append(" ")
        elif tag in BLOCK:
            close()
            pop_to(("p",), ("article", "section", "div", "li", "td", "th", "blockquote", "body"))
            if tag in ENDS:
                pop_to(ENDS[tag], _SCOPE.get(tag, ()))
            inside = stack[-1][3]
            style, noise, main = _style(tag, m[3], inside)
            path = f"{key(stack[-1][1], style):x}"  # of a fixed length, however deep the elements nest
            runs = children.setdefault(stack[-1][1], [])
            if not runs or runs[-1] != style:
                runs.append(style)
            noise = stack[-1][2] or (noise and not (inside and tag == "header"))
            if tag not in VOID:
                stack.append((tag, path, noise, inside or main))
    close()
    return out, children
