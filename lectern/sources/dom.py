"""HTML without third-party parsers: a small tree, selectors, cleaning, extraction and Markdown. No Spark here.

The tree is built as browsers' simplest readers do: void elements close at once, an end tag closes the nearest open element of its
name, an end tag without one is ignored, script and style hold raw text. Any input gives a tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags and marks that hold no content, tags that end a line, places of the main content in order.
DROPPED = frozenset("script style nav header footer aside advertisement ads button noscript".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 blockquote pre ul ol table hr section article figure figcaption details".split())
CODE = frozenset(("pre", "code", "samp"))
NOISE = re.compile(
    r"(?<![a-z0-9])(?:ads?|advertisement|sidebar|nav|menu)(?![a-z0-9])|newsletter|subscribe|subscription|signup|sign-up|mailing-list|social|share|sharing-widget|cookie|consent|gdpr"
    r"|copy-button|copy-btn|clipboard|code-toolbar|carousel|slider|gallery|swiper|slick|tooltip|popover|modal|dialog|overlay|toast",
    re.I,
)
MEDIA = frozenset(("img", "figure", "picture", "video", "audio"))
MAIN = ("main", '[role="main"]', "article", ".content", ".post", ".entry", ".article", "#content", "#main", ".main-content", ".post-content", ".entry-content", ".article-content")
LANGUAGES = frozenset("python javascript typescript java go rust ruby php sql html css bash shell json yaml xml c cpp csharp kotlin swift scala r markdown".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order, however deep."""
        open_ = [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if isinstance(c, Node):
                    yield c
                    open_.append(iter(c.children))
                    break
            else:
                open_.pop()

    def strings(self, raw: bool = False) -> Iterator[str]:
        open_ = [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if isinstance(c, str):
                    yield c
                elif c.tag != "!--" and (raw or c.tag not in ("script", "style")):
                    open_.append(iter(c.children))
                    break
            else:
                open_.pop()

    def text(self) -> str:
        return "".join(self.strings())

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def inside(self, tags: frozenset[str]) -> bool:
        n: Node | None = self
        while n:
            if n.tag in tags:
                return True
            n = n.parent
        return False

    def html(self) -> str:
        inner = "".join(c.html() if isinstance(c, Node) else (c if self.tag in ("script", "style") else escape(c, quote=False)) for c in self.children)
        if self.tag == "":
            return inner
        if self.tag == "!--":
            return f"<!--{''.join(map(str, self.children))}-->"
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")  # the first of equal names counts
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        node = Node("!--", parent=self.at)
        node.children.append(data)
        self.at.children.append(node)


_REFERENCE = re.compile(r"&(?!#(?:[0-9]+|[xX][0-9a-fA-F]+);)([A-Za-z][A-Za-z0-9]*;)?")


def closed_references(html: str) -> str:
    """The page with every ampersand that begins no closed reference written as one: what was cut off stays as it is, where readers of HTML take "&amp" for "&"."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), html)


def parse(html: str | None) -> Node:
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):  # declarations that the reader refuses; what came before stays
        pass
    return builder.root


# selectors: comma lists of compounds (tag, #id, .class, [attr], [attr="v"]) with descendant and child combinators
_STEP = re.compile(r"""([a-zA-Z*][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*["']?([^"'\]]*)["']?)?\s*\]""")


def _compound(text: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    for m in _STEP.finditer(text):
        tag, id_, cls, attr, op, value = m.groups()
        if tag:
            tests.append(lambda n, tag=tag.lower(): tag == "*" or n.tag == tag)
        elif id_:
            tests.append(lambda n, v=id_: n.attrs.get("id") == v)
        elif cls:
            tests.append(lambda n, v=cls: v in n.attrs.get("class", "").split())
        else:
            how = {"=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": str.startswith, "$=": str.endswith, "*=": lambda a, v: v in a}
            tests.append(lambda n, k=attr.lower(), o=op, v=value: k in n.attrs and (not o or how[o](n.attrs[k], v)))
    return lambda n: all(t(n) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match, in document order."""
    chains = []
    for part in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", part.strip()).split()
        if steps:
            chains.append([s if s == ">" else _compound(s) for s in steps])

    def fits(n: Node | None, chain: list) -> bool:
        if not n or n.tag == "" or not chain[-1](n):
            return False
        rest = chain[:-1]
        if not rest:
            return True
        if rest[-1] == ">":
            return fits(n.parent, rest[:-1])
        up = n.parent
        while up:
            if fits(up, rest):
                return True
            up = up.parent
        return False

    return [n for n in root.walk() if n.tag != "!--" and any(fits(n, c) for c in chains)]


def extract(root: Node, config: dict[str, dict]) -> dict[str, list[str | None]]:
    """Field to values, by selector: text, html or an attribute; one or all. A single field that nothing matches is [None]."""
    out: dict[str, list[str | None]] = {}
    for name, rule in config.items():
        how = rule.get("attr", "text")
        found = select(root, rule["selector"]) if rule.get("selector") else []
        value = lambda n: n.text().strip() if how == "text" else n.html() if how == "html" else n.attrs.get(how)  # noqa: B023, E731
        if rule.get("multiple"):
            out[name] = [value(n) for n in found]
        else:
            out[name] = [value(found[0])] if found else ([None] if rule.get("selector") else [])
    return out


def normalize_config(config: dict[str, str | dict]) -> dict[str, dict]:
    """A bare selector means all texts."""
    return {k: {"selector": v, "multiple": True} if isinstance(v, str) else {"attr": "text", "multiple": False, "type": "css"} | v for k, v in config.items()}


def resolve(base: str | None, href: str) -> str:
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def links(root: Node, base: str | None = None) -> list[dict[str, str]]:
    return [{"url": resolve(base, n.attrs["href"]), "text": n.text().strip()} for n in root.all("a") if n.attrs.get("href")]


def title(root: Node) -> str:
    n = root.find("title")
    return n.text().strip() if n else ""


def description(root: Node) -> str | None:
    return next((n.attrs.get("content") for n in root.all("meta") if n.attrs.get("name", "").lower() == "description"), None)


def main_content(root: Node, least: int = 11) -> Node:
    """The first place of content that holds that many characters; else the body, else all."""
    for selector in MAIN:
        for n in select(root, selector):
            if len("".join(s.strip() for s in n.strings(raw=True))) >= least:
                return n
    return root.find("body") or root


def _best_source(srcset: str) -> str | None:
    """The densest image of a srcset; the last of equals."""
    best, top = None, -1.0
    for part in srcset.split(","):
        words = part.split()
        if words:
            number = re.fullmatch(r"([\d.]+)([xw])", words[1]) if len(words) > 1 else None
            size = float(number[1]) / (1000 if number[2] == "w" else 1) if number else 1.0
            if size >= top:
                best, top = words[0], size
    return best


def is_placeholder(src: str | None) -> bool:
    return not (src or "").strip() or bool(re.match(r"data:image/(?:gif|svg)|about:blank", src.strip(), re.I))


# Where players are embedded, and the page of what they play.
VIDEOS = (
    (r"https?://(?:www\.)?youtube\.com/embed/([A-Za-z0-9_-]{11})", "https://www.youtube.com/watch?v={}"),
    (r"https?://(?:www\.)?youtube\.com/shorts/([A-Za-z0-9_-]{11})", "https://www.youtube.com/watch?v={}"),
    (r"https?://youtu\.be/([A-Za-z0-9_-]{11})", "https://www.youtube.com/watch?v={}"),
    (r"https?://player\.vimeo\.com/video/(\d+)", "https://vimeo.com/{}"),
    (r"https?://player\.bilibili\.com/player\.html\?.*bvid=(BV[A-Za-z0-9]+)", "https://www.bilibili.com/video/{}"),
    (r"https?://player\.bilibili\.com/player\.html\?.*aid=(\d+)", "https://www.bilibili.com/video/av{}"),
    (r"https?://(?:www\.)?bilibili\.com/video/(BV[A-Za-z0-9]+)", "https://www.bilibili.com/video/{}"),
    (r"https?://(?:www\.)?bilibili\.com/video/av(\d+)", "https://www.bilibili.com/video/av{}"),
)


def video_page(src: str) -> str:
    for pattern, page in VIDEOS:
        if m := re.match(pattern, src, re.I):
            return page.format(m[1])
    return src


def next_image(src: str, base: str | None) -> str:
    if m := re.search(r"/_next/image\?(?:.*&)?url=([^&]+)", src):
        return resolve(base, unquote(unquote(m[1])))
    return src


def _convert_media(root: Node, base: str | None) -> None:
    for n in root.all("img"):
        if is_placeholder(n.attrs.get("src")):
            lazy = next((n.attrs[k] for k in ("data-src", "data-lazy-src", "data-original", "data-lazy", "data-url") if n.attrs.get(k)), None)
            lazy = lazy or _best_source(n.attrs.get("srcset") or n.attrs.get("data-srcset") or "")
            if lazy:
                n.attrs["src"] = lazy
        if n.attrs.get("src"):
            n.attrs["src"] = next_image(n.attrs["src"], base)
    for n in root.all("video", "audio", "iframe", "embed", "object"):
        inner = n.find("source")
        src = n.attrs.get("src") or n.attrs.get("data") or (inner.attrs.get("src") if inner else None)
        if not src or not n.parent:
            n.remove()
            continue
        poster = n.attrs.get("poster")
        label = "[音频]" if n.tag == "audio" else "[视频]"
        n.tag, n.attrs, n.children = "p", {}, []
        if poster:
            n.children.append(Node("img", {"src": poster, "alt": ""}, n))
        a = Node("a", {"href": video_page(src)}, n)
        a.children.append(label)
        n.children.append(a)


def latex_of(n: Node) -> str | None:
    return next((a.text().strip() for a in n.all("annotation") if re.search("tex", a.attrs.get("encoding", ""), re.I)), None)


def _keep_math(root: Node) -> None:
    """Formulas become text before scripts go."""
    for n in root.all("script"):
        kind = n.attrs.get("type", "")
        if kind.startswith("math/tex"):
            latex = "".join(n.strings(raw=True)).strip()
            _replace(n, f"$${latex}$$" if "mode=display" in kind else f"${latex}$")
    for n in list(root.walk()):
        name = n.attrs.get("class", "")
        if n.parent and (n.tag == "math" or re.search(r"katex|mathjax", name, re.I)):
            latex = latex_of(n)
            if latex:
                display = n.attrs.get("display") == "block" or "display" in name.lower() or any("display" in x.attrs.get("class", "") or x.attrs.get("display") == "block" for x in n.walk())
                _replace(n, f"$${latex}$$" if display else f"${latex}$")


def _replace(n: Node, text: str) -> None:
    if n.parent:
        n.parent.children = [text if c is n else c for c in n.parent.children]
        n.parent = None


def sanitize(html: str | None, base: str | None = None) -> Node:
    """Without comments, scripts, navigation, advertising and styling; code stays whole; references absolute."""
    root = parse(html)
    for n in root.all("!--"):
        n.remove()
    _keep_math(root)
    _convert_media(root, base)
    for n in list(root.walk()):
        if n.inside(CODE):
            continue
        noisy = any(NOISE.search(v) for v in (*n.attrs.get("class", "").split(), n.attrs.get("id", "")) if v) and not n.find(*MEDIA)
        if n.tag in DROPPED or noisy or (n.tag == "svg" and not n.find("text")):
            n.remove()
    for n in root.walk():
        if not n.inside(CODE):
            n.attrs.pop("class", None)
            n.attrs.pop("style", None)
        for tag, attr in (("a", "href"), ("img", "src")):
            if n.tag == tag and n.attrs.get(attr) and not n.attrs[attr].startswith(("http://", "https://")):
                n.attrs[attr] = resolve(base, n.attrs[attr])
    return root


def table_rows(n: Node) -> list[list[str]]:
    rows = [[c.text().strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.all("tr")]
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def table_markdown(rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("---" for _ in rows[0]) + " |", *map(line, rows[1:])]) if rows else ""


def tables(root: Node) -> list[dict]:
    out = []
    for n in root.all("table"):
        rows = table_rows(n)
        if rows:
            caption = n.find("caption")
            out.append({"markdown": table_markdown(rows), "rows": len(rows), "columns": len(rows[0]), "headers": rows[0], "caption": caption.text().strip() if caption else None, "cells": rows})
    return out


def _pixels(x: str | None) -> int | None:
    try:
        return int((x or "").replace("px", "").strip())
    except ValueError:
        return None


def images(root: Node, base: str | None = None) -> list[dict]:
    return [
        {"src": n.attrs["src"] if n.attrs["src"].startswith("data:") else resolve(base, n.attrs["src"]), "alt": n.attrs.get("alt", ""), "title": n.attrs.get("title", ""), "width": _pixels(n.attrs.get("width")), "height": _pixels(n.attrs.get("height"))}
        for n in root.all("img")
        if n.attrs.get("src")
    ]


def code_language(n: Node) -> str | None:
    for c in n.attrs.get("class", "").split():
        for prefix in ("language-", "lang-", "highlight-"):
            if c.startswith(prefix):
                return c[len(prefix) :]
        if c.lower() in LANGUAGES:
            return c.lower()
    return None


def code_blocks(root: Node) -> list[dict]:
    out = []
    for n in root.all("pre"):
        inner = n.find("code")
        code = (inner or n).text().strip()
        if code:
            out.append({"code": code, "language": code_language(inner) if inner else None})
    return out


def formulas(root: Node) -> list[dict]:
    """Scripts, then rendered containers, then MathML; nested containers are found again."""
    out = []
    for n in root.all("script"):
        kind = n.attrs.get("type", "")
        if kind.startswith("math/tex"):
            out.append({"latex": "".join(n.strings(raw=True)).strip(), "formula_type": "block" if "mode=display" in kind else "inline", "source_format": "mathjax"})
    for name, source in (("mathjax", "mathjax"), ("katex", "katex")):
        for n in root.walk():
            if name in n.attrs.get("class", "").lower() and (latex := latex_of(n)):
                out.append({"latex": latex, "formula_type": "block" if "display" in n.attrs["class"].lower() else "inline", "source_format": source})
    for n in root.all("math"):
        if latex := latex_of(n):
            out.append({"latex": latex, "formula_type": "block" if n.attrs.get("display") == "block" else "inline", "source_format": "mathml"})
    return out


def markdown(root: Node) -> str:
    """A plain rendering; formatting passes come after it."""
    return re.sub(r"\n{3,}", "\n\n", "".join(_render(root, "")).strip())


def plain_markdown(html: str | None) -> str:
    """A page without a renderer: tables as Markdown, every other line of text a paragraph. Any input gives a text."""
    root = parse(html)
    for n in list(root.walk()):
        if n.tag in ("script", "style", "nav", "header", "footer", "!--"):
            n.remove()
    for n in root.all("table"):
        rows = [[c.text().strip() for c in r.all("td", "th")] for r in n.all("tr")]
        if any(rows):
            _replace(n, f"\n\n{table_markdown([r for r in rows if r])}\n\n".replace("\n", "\x00"))
    lines = [x.strip() for x in root.text().replace("\x00\x00", "\n").split("\n")]
    return "\n\n".join(x.replace("\x00", "\n") for x in lines if x)


def _inline(n: Node) -> str:
    return re.sub(r"\s+", " ", "".join(_render(n, ""))).strip()


def _render(n: Node, indent: str) -> Iterator[str]:
    for c in n.children:
        if isinstance(c, str):
            yield re.sub(r"[^\S\n]*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", c))
            continue
        t = c.tag
        if t in ("script", "style", "!--", "head", "title"):
            continue
        if t in ("h1", "h2", "h3", "h4", "h5", "h6"):
            yield f"\n\n{'#' * int(t[1])} {_inline(c)}\n\n"
        elif t in ("b", "strong") and (s := _inline(c)):
            yield f"**{s}**"
        elif t in ("i", "em") and (s := _inline(c)):
            yield f"*{s}*"
        elif t == "a" and c.attrs.get("href"):
            yield f"[{_inline(c)}]({c.attrs['href']})"
        elif t == "img" and c.attrs.get("src"):
            yield f"![{c.attrs.get('alt', '')}]({c.attrs['src']})"
        elif t == "pre":
            inner = c.find("code")
            yield f"\n\n```{(code_language(inner) if inner else None) or ''}\n{(inner or c).text().strip(chr(10))}\n```\n\n"
        elif t in ("code", "samp"):
            yield f"`{c.text()}`"
        elif t == "blockquote":
            yield "\n\n" + "\n".join(f"> {s}" for s in markdown(c).split("\n")) + "\n\n"
        elif t in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            yield "\n" + "\n".join(f"{indent}{f'{i}.' if t == 'ol' else '-'} " + "".join(_render(x, indent + "  ")).strip() for i, x in enumerate(items, 1)) + "\n"
        elif t == "table":
            yield f"\n\n{table_markdown(table_rows(c))}\n\n"
        elif t == "br":
            yield "\n"
        elif t == "hr":
            yield "\n\n---\n\n"
        elif t in BLOCKS:
            yield "\n\n"
            yield from _render(c, indent)
            yield "\n\n"
        else:
            yield from _render(c, indent)
