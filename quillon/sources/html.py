"""Pages as structured documents: an Arrow function from HTML to title, dates, links, sections and hidden text."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.dates import dates
from quillon.sharing import by_rows

SCHEMA = (
    "struct<title:string,published:string,updated:string,canonical:string,description:string,lang:string,hidden:string,"
    "links:array<string>,sections:array<struct<title:string,level:int,path:array<string>,blocks:array<struct<kind:string,text:string>>>>>"
)

# Elements without content, elements that are no prose, names that mark page furniture, and styles that hide.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = set("script style noscript template iframe svg form nav footer button dialog aside".split())
FURNITURE_NAME = re.compile(r"(^|[-_ ])(nav|navbar|menu|footer|sidebar|cookie|consent|banner|advert|ads?|promo|subscribe|newsletter|share|social|breadcrumbs?|comments?|related|skip)([-_ ]|$)", re.I)
FURNITURE_ROLE = re.compile("navigation|banner|contentinfo|complementary")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?:\.0+)?\b|left\s*:\s*-\d{3,}", re.I)
BLOCKS = {"p": "p", "figcaption": "p", "dd": "p", "li": "li", "pre": "code", "blockquote": "quote", "table": "table"}
#: Elements that the same or another of their kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


class Node:
    __slots__ = ("name", "attrs", "parent", "inside")

    def __init__(self, name, attrs=None, parent=None):
        self.name, self.attrs, self.parent, self.inside = name, attrs or {}, parent, []

    def walk(self):
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def all(self, *names):
        return [x for x in self.walk() if x.name in names]

    def first(self, *names):
        return next((x for x in self.walk() if x.name in names), None)

    def under(self, *names):
        at = self.parent
        while at is not None and at.name not in names:
            at = at.parent
        return at

    def raw(self, gap=" "):
        return gap.join(x.raw(gap) if isinstance(x, Node) else x for x in self.inside)

    def text(self):
        return " ".join(self.raw().split())

    def drop(self):
        if self.parent:
            self.parent.inside = [x for x in self.parent.inside if x is not self]


class Tree(HTMLParser):
    """A forgiving tree: unclosed elements end with their parents."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")
        self.feed(html)
        self.close()

    def handle_starttag(self, name, attrs):
        if name in CLOSES and self.at.name in CLOSES[name]:
            self.at = self.at.parent
        node = Node(name, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if name not in VOID:
            self.at = node

    def handle_startendtag(self, name, attrs):
        self.at.inside.append(Node(name, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, name):
        at = self.at
        while at is not self.root and at.name != name:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def _meta(root, *names):
    tags = root.all("meta")
    for name in names:
        for t in tags:
            if name in (t.attrs.get("property"), t.attrs.get("name")) and t.attrs.get("content"):
                return t.attrs["content"].strip()
    return None


def _linked_data(root):
    for t in root.all("script"):
        if t.attrs.get("type") == "application/ld+json":
            try:
                found = json.loads(t.raw(""))
            except ValueError:
                continue
            for item in found if isinstance(found, list) else [found]:
                if isinstance(item, dict) and ({"datePublished", "headline"} & set(item)):
                    return item
    return {}


def _day(text):
    found = dates((text or "").strip())
    return found[0][0].isoformat() if found else None


def _weight(node):
    """How much of an element is prose: its text, less twice its links."""
    return len(node.text()) - 2 * sum(len(a.text()) for a in node.all("a"))


def _main(root):
    if articles := root.all("article"):
        return max(articles, key=_weight)
    for x in root.walk():
        if x.name == "main" or x.attrs.get("role") == "main":
            return x
    boxes = root.all("div", "section")
    best = max(boxes, key=_weight, default=None)
    return best if best is not None and _weight(best) > 200 else root.first("body") or root


def _take_hidden(root):
    texts = []
    for x in list(root.walk()):
        hides = "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or HIDING.search(x.attrs.get("style", ""))
        if hides and x.name not in ("html", "body", "head", "script", "style") and _attached(x, root):
            texts.append(x.text())
            x.drop()
    return " ".join(t for t in texts if t)


def _attached(node, root):
    while node.parent is not None:
        if not any(x is node for x in node.parent.inside):
            return False
        node = node.parent
    return node is root


def _strip_furniture(root):
    for x in list(root.walk()):
        named = FURNITURE_NAME.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}".strip()) and x.name not in ("html", "body", "main", "article") and not x.first("article", "main")
        header = x.name == "header" and not x.under("article", "main")
        if x.name in FURNITURE or FURNITURE_ROLE.search(x.attrs.get("role", "")) or named or header:
            x.drop()


def _block_text(x):
    if x.name == "table":
        rows = [[c.text() for c in tr.all("td", "th")] for tr in x.all("tr")]
        return "\n".join(" | ".join(r) for r in rows if any(r))
    if x.name == "pre":
        return x.raw("\n").strip("\n")
    if x.name == "li":
        return " ".join(" ".join(y.raw() if isinstance(y, Node) else y for y in x.inside if not (isinstance(y, Node) and y.name in ("ul", "ol"))).split())
    return x.text()


def parse(html: str | None, url: str) -> dict:
    from urllib.parse import urljoin

    root = Tree(html or "").root
    data = _linked_data(root)
    named = root.first("title")
    title = _meta(root, "og:title") or data.get("headline") or (named.text() if named else "")
    timed = next((t.attrs["datetime"] for t in root.all("time") if t.attrs.get("datetime")), None)
    published = _day(_meta(root, "article:published_time", "datePublished", "date", "dc.date") or data.get("datePublished") or timed)
    updated = _day(_meta(root, "article:modified_time", "dateModified", "og:updated_time") or data.get("dateModified"))
    canonical = next((urljoin(url, t.attrs["href"]) for t in root.all("link") if t.attrs.get("rel") == "canonical" and t.attrs.get("href")), None)
    page = root.first("html")
    head = {"description": _meta(root, "og:description", "description") or "", "lang": (page.attrs.get("lang") if page else None) or "en"}
    hidden = _take_hidden(root)
    _strip_furniture(root)
    main = _main(root)
    if not title and (h1 := main.first("h1") or root.first("h1")):
        title = h1.text()
    title = re.split(r"\s+[|–—]\s+", " ".join(title.split()))[0].strip("*_# ") or url
    links = list(dict.fromkeys(u for a in (root.first("body") or root).all("a") if a.attrs.get("href") and re.match("https?://", u := urljoin(url, a.attrs["href"].strip()))))
    sections = [{"title": title, "level": 1, "path": [title], "blocks": []}]
    open_: list[tuple[int, str]] = []
    for x in main.walk():
        if re.fullmatch("h[1-6]", x.name):
            words, level = x.text(), int(x.name[1])
            if not words or (level == 1 and words == title and not any(s["blocks"] for s in sections)):
                continue
            open_ = [*(o for o in open_ if o[0] < level), (level, words)]
            sections.append({"title": words, "level": level, "path": [t for _, t in open_], "blocks": []})
        elif x.name in BLOCKS:
            held = {"p": ("li", "blockquote", "table", "pre"), "li": ("table",), "quote": ("pre",), "code": ("pre",), "table": ()}[BLOCKS[x.name]]
            link = x.first("a") if x.name in ("li", "p") else None
            if (held and x.under(*held)) or (link and link.text() == x.text()):
                continue
            if words := _block_text(x):
                sections[-1]["blocks"].append({"kind": BLOCKS[x.name], "text": words})
    return {"title": title, "published": published, "updated": updated, "canonical": canonical, **head, "hidden": hidden, "links": links, "sections": [s for s in sections if s["blocks"]]}


def documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with doc, the structured document."""

    read = by_rows(lambda h, u: parse(h, u or ""), SCHEMA)
    return pages.withColumn("doc", read(F.col(html), F.col(url)))


def content_hash(doc):
    """SHA-256 over title, section paths and blocks: furniture and letter case do not change it."""
    from quillon.functions.text import normalize

    blocks = lambda s: F.array_join(F.transform(s["blocks"], lambda b: F.concat(F.lit("\x01"), b["kind"], normalize(b["text"]))), "")
    sections = F.transform(doc["sections"], lambda s: F.concat(F.lit("\x00"), normalize(F.array_join(s["path"], " > ")), blocks(s)))
    return F.sha2(F.encode(F.concat(normalize(doc["title"]), F.array_join(sections, "")), "UTF-8"), 256)


def markdown(doc):
    """The document as Markdown."""
    mark = lambda b: F.when(b["kind"] == "li", F.concat(F.lit("- "), b["text"])).when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```"))).when(b["kind"] == "quote", F.concat(F.lit("> "), b["text"])).otherwise(b["text"])
    heading = lambda s: F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(s["level"] + 1, F.lit(6))), F.lit(" "), s["title"])
    parts = F.flatten(F.transform(doc["sections"], lambda s: F.concat(F.when(s["title"] == doc["title"], F.array().cast("array<string>")).otherwise(F.array(heading(s))), F.transform(s["blocks"], mark))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), doc["title"])), parts), "\n")
