"""HTML: expressions where a regular expression is exact enough, and one Arrow function where a parser is needed."""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import escape_xml, sentences, squeeze, strip

#: Phrases of pages that only ask who is there.
WALLS = (
    "cloudflare ray id",
    "security service to protect",
    "cf-browser-verification",
    "checking your browser",
    "please enable cookies",
    "enable javascript and cookies",
    "ddos protection by",
)
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}
_SKIP = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "iframe", "button"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "main", "td", "tr", "figure", "figcaption", "pre", "br"}
_BOX = {"html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td", "ul", "ol", "center"}
_ACTIVE = {"script", "style", "iframe", "object", "embed", "form", "link", "meta", "base"}
_LAZY = ("data-src", "data-original", "data-lazy-src", "data-srcset")


def visible_text(c: Column) -> Column:
    """Text without tags, by expressions alone: good for counts."""
    bare = F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return squeeze(F.regexp_replace(bare, r"<[^>]+>", " "))


def title(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1))


def paragraphs(c: Column) -> Column:
    """Visible text of each p element."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: squeeze(F.regexp_replace(p, r"<[^>]+>", ""))), lambda p: p != "")


def images(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)<img\b"))


def blocked(c: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(c, F.lit("")), 1, 4000))
    out = F.lit(False)
    for phrase in WALLS:
        out = out | head.contains(phrase)
    return out


def quality(text: Column, page: Column) -> Column:
    n = F.length(text)
    return F.struct(F.when(n >= 1200, 3).when(n >= 500, 2).when(n >= 150, 1).otherwise(0).alias("score"), n.alias("chars"), images(page).alias("images"))


def without_boilerplate(c: Column) -> Column:
    """Text lines without reading aids, share prompts and copyright lines."""
    return strip(F.regexp_replace(c, r"(?im)^\s*(?:advertisement|related (?:articles|stories):?.*|read more:?.*|share (?:this|on).*|copyright .*|all rights reserved.*)\s*$", ""))


def feed_fallback(title_: Column, summary: Column, thumbnail: Column, url: Column) -> Column:
    """A page from a feed's own text: image and a paragraph a point, or title and link alone."""
    image = F.when(F.coalesce(thumbnail, F.lit("")).rlike("^https?://"), F.concat(F.lit('<img src="'), escape_xml(thumbnail), F.lit('">'))).otherwise("")
    points = sentences(visible_text(F.coalesce(summary, F.lit(""))))
    body = F.array_join(F.transform(points, lambda p: F.concat(F.lit("<p>"), escape_xml(p), F.lit("</p>"))), "")
    return F.when(F.size(points) > 0, F.concat(image, body)).otherwise(F.concat(image, F.lit("<p>"), escape_xml(title_), F.lit('</p><p><a href="'), escape_xml(url), F.lit('">'), escape_xml(url), F.lit("</a></p>")))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.path = [self.root]
        self.open = Counter()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in _VOID:
            self.path.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.path[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        found = not self.open[tag]
        while not found:
            last = self.path.pop()[0]
            self.open[last] -= 1
            found = last == tag

    def handle_data(self, data):
        self.path[-1][2].append(data)


def tree(page: str) -> list:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def _image(attrs: dict, url: str) -> str | None:
    src = next((attrs[k] for k in _LAZY if attrs.get(k)), attrs.get("src") or "").split(",")[0].split(" ")[0]
    full = urljoin(url, src) if src else ""
    return full if full.startswith(("http://", "https://")) else None


def _weights(root: list) -> dict[int, int]:
    """Characters of text plus 600 an image below each element, without skipped ones, by its id(); one pass from the leaves."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x[2] if not isinstance(c, str) and c[0] not in _SKIP]
    out: dict[int, int] = {}
    for x in reversed(order):
        inner = sum(len(c.strip()) if isinstance(c, str) else out.get(id(c), 0) for c in x[2])
        out[id(x)] = inner + 600 * (x[0] == "img")
    return out


def best_container(root: list) -> list:
    """The narrowest element that has nearly all of the weight: text length plus 600 an image."""
    weight = _weights(root)
    node = root
    while True:
        inner = [(weight.get(id(x), 0), x) for x in node[2] if not isinstance(x, str) and x[0] in _BOX]
        whole = weight.get(id(node), 0)
        if not inner or not whole:
            return node
        most, child = max(inner, key=lambda i: i[0])
        if most < 0.7 * whole:
            return node
        node = child


def flow(page: str, url: str = "") -> list[dict]:
    """Paragraphs and images of the main part, in order."""
    out: list[dict] = []
    text: list[str] = []

    def close():
        t = re.sub(r"\s+", " ", "".join(text)).strip()
        text.clear()
        if t and (not out or out[-1].get("text") != t):
            out.append({"text": t})

    todo: list = [best_container(tree(page))]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            text.append(x)
        elif x[0] == "img":
            close()
            if src := _image(x[1], url):
                out.append({"image": src})
        elif x[0] not in _SKIP:
            if x[0] in _BLOCK:
                close()
                todo.append(None)
            todo += reversed(x[2])
    close()
    return out


def embedded(page: str, paths: tuple[str, ...] = ("props.pageProps.article", "props.initialProps.pageProps.article")) -> list[dict] | None:
    """Paragraphs of an article that a page carries as JSON of its framework."""
    m = re.search(r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', page)
    if not m:
        return None
    try:
        data = json.loads(m[1])
    except ValueError:
        return None
    for path in paths:
        at = data
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, dict):
            blocks = at.get("blocks") or at.get("content") or []
            if isinstance(blocks, str):
                return flow(blocks)
            got = [{"image": b["image"]} if b.get("image") else {"text": re.sub(r"<[^>]+>", "", _html.unescape(str(b.get("text") or b.get("html") or ""))).strip()} for b in blocks if isinstance(b, dict)]
            return [g for g in got if g.get("image") or g.get("text")]
    return None


def _pictures(page: str) -> str:
    """Each closed picture element replaced by its first image, in one pass."""
    out, done, begin, image = [], 0, None, None
    for m in re.finditer(r"(?i)<(/?picture|img)\b[^<>]*>", page):
        tag = m[1].lower()
        if tag == "picture" and begin is None:
            begin, image = m.start(), None
        elif tag == "img" and begin is not None and image is None:
            image = m[0]
        elif tag == "/picture" and begin is not None:
            if image:
                out += [page[done:begin], image]
                done = m.end()
            begin = None
    return "".join([*out, page[done:]])


def rewritten(page: str, url: str = "") -> str:
    """noscript unwrapped, lazy images made plain, picture and graphic elements made img."""
    page = _pictures(re.sub(r"(?i)</?noscript\b[^<>]*>", "", page))
    page = re.sub(r"(?i)<(/?)graphic\b", r"<\1img", page)

    def plain(m: re.Match) -> str:
        attrs = tree(m[0])[2][0][1] if m[0] else {}
        src = _image(attrs, url)
        return f'<img src="{_html.escape(src)}">' if src else ""

    return re.sub(r"(?is)<img\b[^>]*>", plain, page)


def sanitised(page: str) -> str:
    """Without active elements, event attributes, script addresses and data other than images."""
    out: list[str] = []
    todo: list = [tree(page)]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(_html.escape(x, quote=False))
        elif x[0] not in _ACTIVE:
            tag, attrs, inner = x
            if tag:
                out.append(f"<{tag}{_safe(attrs)}>")
                if tag not in _VOID:
                    todo.append((f"</{tag}>",))
            todo += reversed(inner)
    return "".join(out)


def _safe(attrs: dict) -> str:
    """Attributes that start nothing."""
    return "".join(f' {k}="{_html.escape(v or "")}"' for k, v in attrs.items() if not k.lower().startswith("on") and not (k.lower() in ("href", "src", "action", "formaction", "srcset", "xlink:href") and re.match(r"(?i)\s*(javascript|vbscript|data(?!:image/)):?", re.sub(r"[\x00-\x20]", "", v or ""))))


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType())])))
def article_flow(page: pd.Series, url: pd.Series) -> pd.Series:
    """Paragraphs and images of pages, in order; null pages have none."""

    def one(p, u):
        if p is None:
            return []
        got = embedded(p) or flow(rewritten(p, u or ""), u or "")
        return [{"kind": k, "value": v} for x in got for k, v in x.items()]

    return pd.Series([one(p, u) for p, u in zip(page, url, strict=True)])


@F.pandas_udf(StringType())
def sanitise(page: pd.Series) -> pd.Series:
    return page.map(lambda p: None if p is None else sanitised(p))


def highlight(text: Column, sentence: Column) -> Column:
    """The first verbatim place of a sentence marked, whatever the blanks between its words."""
    words = F.transform(F.split(squeeze(sentence), " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    fits = (F.length(sentence) >= 6) & (F.length(sentence) <= 200)
    return F.when(fits, F.regexp_replace(text, F.concat(F.lit("(?s)^(.*?)("), F.array_join(words, r"\s+"), F.lit(")")), F.lit("$1<mark>$2</mark>"))).otherwise(text)


def shown(root: list) -> str:
    """The HTML of a tree."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(_html.escape(x, quote=False))
        else:
            tag, attrs, inner = x
            if tag:
                out.append(f"<{tag}" + "".join(f' {k}="{_html.escape(v or "")}"' for k, v in attrs.items()) + ">")
                if tag not in _VOID:
                    todo.append((f"</{tag}>",))
            todo += reversed(inner)
    return "".join(out)


def _each(root: list):
    """(parent, index, node) of all elements, in order."""
    todo = [(root, i) for i in reversed(range(len(root[2])))]
    while todo:
        parent, i = todo.pop()
        if i < len(parent[2]) and not isinstance(x := parent[2][i], str):
            yield parent, i, x
            todo += [(x, k) for k in reversed(range(len(x[2])))]


def text_of(node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo += reversed(x[2])
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def without_relative_images(content: str) -> str:
    """Images stay if their address is absolute or holds the data itself, or if they have none."""
    return re.sub(r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']\s*(?!https?://|data:|["'\s])[^"']*["'][^>]*>""", "", content)


def without_leading_title(content: str, title_: str) -> str:
    """Without the first h1 if its text is part of the title or holds it."""
    m = re.search(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", content)
    own, other = (text_of(tree(m[1])) if m else ""), re.sub(r"\s+", " ", title_ or "").strip()
    return content[: m.start()] + content[m.end() :] if own and (own in other or other in own) else content


def with_featured_image(content: str, thumbnail: str | None) -> str:
    """The thumbnail in front, inside a body if there is one, where the content has no image."""
    if not thumbnail or "<img" in content:
        return content
    image = f'<img src="{_html.escape(thumbnail)}">'
    return content.replace("<body>", f"<body>{image}", 1) if "<body>" in content else image + content


def with_intro(content: str, description: str | None, title_: str = "") -> str:
    """The description's part before the content's first heading as a first paragraph, unless the content begins with it."""
    told = re.sub(r"\s+", " ", description or "").strip()
    root = tree(content)
    heads = (text_of(x) for _, _, x in _each(root) if x[0] in ("h2", "h3", "h4"))
    first = next((t for t in heads if t and t != re.sub(r"\s+", " ", title_ or "").strip()), "")
    intro = told[: told.find(first)].strip() if first and told.find(first) > 0 else ""
    if not intro or intro in text_of(root)[: max(len(intro) + 128, 256)]:
        return content
    lead = f"<p>{_html.escape(intro, quote=False)}</p>"
    return content.replace("<body>", f"<body>{lead}", 1) if "<body>" in content else lead + content


def with_galleries(page: str, variable: str = "article_galleries") -> str:
    """Elements gallery-N replaced by the images that the page's own variable lists for them; all else stays."""
    m = re.search(rf"const {variable}\s*=\s*", page)
    if not m:
        return page
    try:
        lists, _ = json.JSONDecoder().raw_decode(page, m.end())
    except ValueError:
        return page

    def images_of(name: str) -> str:
        rows = [x for x in lists.get(name, []) if isinstance(x, dict) and x.get("src")]
        return "\n".join(f'<img src="{_html.escape(x["src"])}" alt="{_html.escape(x.get("alt_text") or x.get("caption") or "")}">' for x in rows)

    return re.sub(r"(?i)<(gallery-\d+)\s*/?>(?:\s*</\1>)?", lambda g: images_of(g[1].lower()), page)


def placeholder_flow(page: str, pattern: str = r'\{\{[\w-]+:inline-image name="([^"]+)"\}\}', root_class: str = "article-details-content-container", prefix_class: str = "prefixHidden") -> list[dict]:
    """Paragraphs and images of a page whose paragraphs name inline images that lie under a hidden prefix, in order."""
    every = list(_each(tree(page)))
    classed = lambda name: next((x for _, _, x in every if name in (x[1].get("class") or "").split()), None)
    root, prefix = classed(root_class), classed(prefix_class)
    base = text_of(prefix).rstrip("/") if prefix else ""
    out: list[dict] = []
    todo: list = [root] if root else []
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x[0] in ("script", "style", "noscript"):
            continue
        if x[0] == "img":
            if src := x[1].get("src") or x[1].get("data-src"):
                out.append({"image": src})
        elif x[0] == "p":
            whole = text_of(x)
            if text := re.sub(r"\s+", " ", re.sub(pattern, "", whole)).strip():
                out.append({"text": text})
            out += [{"image": f"{base}/{name}"} for name in re.findall(pattern, whole) if base]
        else:
            todo += reversed(x[2])
    return out


@F.pandas_udf(StringType())
def finished(content: pd.Series, title_: pd.Series, thumbnail: pd.Series, description: pd.Series) -> pd.Series:
    """An article's HTML with its last touches: no relative images, no leading title, the missing intro and a featured image."""

    def one(c, t, i, d):
        return None if c is None else with_featured_image(with_intro(without_leading_title(without_relative_images(c), t or ""), d, t or ""), i)

    return pd.Series([one(*x) for x in zip(content, title_, thumbnail, description, strict=True)], dtype=object)
