"""Page extraction: one Arrow pass parses each page and gives typed records.

`extract(pages)` adds a struct `x` of what the capabilities ask for; the child tables
(links, headings, ...) are explodes of its arrays, so that a page is parsed once for
all of them. Without a renderer, boxes and folds are null, blocks keep document order,
and visibility is the static rule of sources/html.py.

Defined cases: a null page is an empty one; pages of any length are parsed as a whole;
lists are cut at the caps of the capture rules.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from silkpage.config import SCAN_TEXT_LIMIT, TEXT_LIMIT
from silkpage.functions.urls import link_tier, resolve
from silkpage.sources.html import Node, parse

FULL = {"images": True, "blocks": True, "readable": True, "ax": True, "text_limit": TEXT_LIMIT}
SCAN = {"images": False, "blocks": False, "readable": False, "ax": False, "text_limit": SCAN_TEXT_LIMIT}

CONTEXT = "container_classes:array<string>,container_text:string,nearest_heading:string,figcaption:string,link_href:string,above_fold:boolean"
#: The members of an extraction result.
MEMBERS = {
    "headings": "array<struct<level:int,text:string,selector:string>>",
    "links": "array<struct<text:string,raw_href:string,href:string,type:string,selector:string,appears_in:string>>",
    "images": f"array<struct<src:string,alt:string,title:string,width:int,height:int,selector:string,region:string,source:string,context:struct<{CONTEXT}>>>",
    "forms": "array<struct<selector:string,method:string,action:string,fields:array<struct<name:string,label:string,type:string,required:boolean>>>>",
    "buttons": "array<struct<text:string,target:string,selector:string,position:string>>",
    "json_ld": "array<string>",
    "metadata": "struct<title:string,description:string,canonical:string,robots:string,lang:string,open_graph:map<string,string>,twitter:map<string,string>,icons:array<string>>",
    "meta_images": "array<struct<src:string,alt:string,width:int,height:int>>",
    "visible_text": "array<struct<text:string,selector:string,region:string,page_order:int>>",
    "blocks": "array<struct<local_id:string,selector:string,tag:string,class_name:string,region:string,page_order:int,raw_text:string,headings:array<string>,"
    "links:array<struct<text:string,href:string>>,image_count:int,repeated_cards:int,carousel:boolean,map_embed:boolean,has_form:boolean>>",
    "readable": "string",
    "content_html": "string",
    "ax": "string",
    "delayed_js": "boolean",
}
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = {
    "header": "banner", "nav": "navigation", "main": "main", "footer": "contentinfo", "aside": "complementary", "form": "form",
    "section": "region", "article": "article", "button": "button", **dict.fromkeys(HEADS, "heading"),
}
REGIONS = {"header": "header", "nav": "navigation", "footer": "footer", "main": "main", "aside": "aside"}
ROLE_REGIONS = {"banner": "header", "navigation": "navigation", "contentinfo": "footer", "main": "main"}
SPACES = re.compile(r"\s+")
BLOCKISH = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


def cut(s: str, n: int) -> str:
    """The first n UTF-16 units."""
    if len(s) <= n // 2 or s.isascii():
        return s[:n]
    return s.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")


def clamp(s: str, n: int) -> str:
    return cut(SPACES.sub(" ", s).strip(), n)


def css_path(n: Node) -> str:
    parts: list[str] = []
    for e in n.up():
        if len(parts) == 6:
            break
        if e.get("id"):
            parts.append(f"{e.tag}#{e.get('id')}")
            break
        parts.append(f"{e.tag}:nth-of-type({e.nth})" if e.nth else e.tag)
    return " > ".join(reversed(parts))


def region_of(n: Node) -> str:
    for e in n.up():
        if r := REGIONS.get(e.tag) or ROLE_REGIONS.get(e.get("role")):
            return r
    return "body"


def has_class(n: Node, part: str) -> bool:
    return part in n.get("class")


def closest(n: Node, test) -> Node | None:
    return next((e for e in n.up() if test(e)), None)


class Page:
    """The records of one page."""

    def __init__(self, url: str | None, html: str | None, caps: dict):
        self.url, self.html, self.caps = url or "", html or "", caps
        self.root = parse(html)
        self.all = list(self.root.walk())
        self.body = next(n for n in self.all if n.tag == "body")
        self.origin = "/".join(self.url.split("/")[:3]).lower()

    def href(self, n: Node) -> str:
        return resolve(n.attrs.get("href"), self.url) or n.get("href")

    def headings(self) -> list[dict]:
        out = [{"level": int(n.tag[1]), "text": cut(n.text().strip(), 300), "selector": css_path(n)} for n in self.all if n.tag in HEADS and not n.hidden]
        return [h for h in out if h["text"]]

    def links(self) -> list[dict]:
        out = []
        for n in self.all:
            if n.tag == "a" and "href" in n.attrs and (href := self.href(n)):
                kind = "email" if href.startswith("mailto:") else "phone" if href.startswith("tel:") else "internal" if href.startswith(self.origin) else "external"
                out.append({"text": cut(n.text().strip(), 160), "raw_href": n.attrs["href"], "href": href, "type": kind, "selector": css_path(n), "appears_in": region_of(n)})
        return out

    def context(self, n: Node) -> dict:
        up = list(n.up())
        text = next((t for e in up[1:5] if (t := clamp(e.text(), 240))), "")
        figure = closest(n, lambda e: e.tag == "figure")
        caption = next(figure.find("figcaption"), None) if figure else None
        link = closest(n, lambda e: e.tag == "a" and "href" in e.attrs) or next((a for a in (n.parent.find("a") if n.parent else ()) if "href" in a.attrs), None)
        return {
            "container_classes": [clamp(e.get("class"), 120) for e in up[:3] if e.get("class")],
            "container_text": text,
            "nearest_heading": self.heading_before(n),
            "figcaption": clamp(caption.text(), 160) if caption else "",
            "link_href": self.href(link) if link else "",
            "above_fold": None,
        }

    def heading_before(self, n: Node) -> str:
        for e in n.up():
            if e is self.body or e.parent is None:
                break
            siblings = e.parent.elements
            for s in reversed(siblings[: siblings.index(e)]):
                h = s if s.tag in HEADS else next(s.find(*HEADS), None)
                if h is not None:
                    return clamp(h.text(), 120)
        return ""

    def images(self) -> list[dict]:
        if not self.caps["images"]:
            return []
        out: dict[str, dict] = {}

        def add(src: str, n: Node, **more) -> None:
            full = resolve(src, self.url) if src else None
            if full and full not in out:
                out[full] = {"src": full, "selector": css_path(n), "region": region_of(n), "context": self.context(n), **more}

        def pixels(v: str) -> int | None:
            return int(v) if v.isdigit() and int(v) else None

        for n in self.all:
            if n.tag == "img":
                srcset = n.get("srcset") or n.get("data-srcset")
                first = (srcset.split(",")[0].split() or [""])[0]
                src = n.get("src") or n.get("data-src") or n.get("data-lazy-src") or first
                add(src, n, alt=n.get("alt"), title=n.get("title"), width=pixels(n.get("width")), height=pixels(n.get("height")), source="img")
        scanned = 0
        for n in self.all:
            style = n.get("style")
            named = any(k in n.attrs for k in ("data-bg", "data-bg-src", "data-background", "data-src"))
            if not (named or "background" in style or "bg" in n.get("class") or n.tag in ("header", "section", "div", "a", "span", "figure")):
                continue
            if scanned > 1200:
                break
            scanned += 1
            m = re.search(r"background[^;]*url\((['\"]?)(.*?)\1\)", style, re.I)
            src = n.get("data-bg") or n.get("data-bg-src") or n.get("data-background") or (m[2] if m else "")
            if src and not re.match(r"data:|none$", src, re.I):
                add(src, n, alt=clamp(n.get("aria-label") or n.get("title"), 160), title="", width=None, height=None, source="background")
        return list(out.values())

    def forms(self) -> list[dict]:
        labels: dict[str, Node] = {}
        for n in self.all:
            if n.tag == "label" and n.get("for"):
                labels.setdefault(n.get("for"), n)
        out = []
        for f in self.all:
            if f.tag != "form":
                continue
            fields = []
            for e in f.find("input", "textarea", "select"):
                kind = "textarea" if e.tag == "textarea" else ("select-multiple" if "multiple" in e.attrs else "select-one") if e.tag == "select" else (e.get("type") or "text").lower()
                if kind == "hidden":
                    continue
                label = labels[e.get("id")].text().strip() if e.get("id") in labels and e.get("id") else ""
                label = label or e.get("aria-label") or e.get("placeholder") or e.get("name")
                fields.append({"name": e.get("name"), "label": cut(label, 120), "type": kind, "required": "required" in e.attrs})
            out.append({"selector": css_path(f), "method": (f.get("method") or "GET").upper(), "action": f.get("action"), "fields": fields})
        return out

    def buttons(self) -> list[dict]:
        def is_cta(n: Node) -> bool:
            classes = n.get("class").split()
            return n.tag == "button" or n.tag == "a" and not {"btn", "button", "cta"}.isdisjoint(classes) or has_class(n, "btn") or n.get("role") == "button"

        found = [n for n in self.all if is_cta(n) and not n.hidden][:60]
        out = [
            {"text": cut(n.text().strip(), 120), "target": self.href(n) if n.tag == "a" else n.attrs.get("formaction") or None, "selector": css_path(n), "position": None}
            for n in found
        ]
        return [b for b in out if b["text"]]

    def json_ld(self) -> list:
        out = []
        for n in self.all:
            if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
                try:
                    out.append(json.loads(n.text()))
                except ValueError:
                    pass
        return out

    def metadata(self) -> dict:
        def meta(name: str) -> str | None:
            return next((n.attrs.get("content") for n in self.all if n.tag == "meta" and n.attrs.get("name") == name), None)

        top = next(n for n in self.all if n.tag == "html")
        title = next((SPACES.sub(" ", n.text()).strip() for n in self.all if n.tag == "title"), "")
        metas = [n for n in self.all if n.tag == "meta"]
        links = [n for n in self.all if n.tag == "link"]
        return {
            "title": title or None,
            "description": meta("description"),
            "canonical": next((n.attrs.get("href") for n in links if n.attrs.get("rel") == "canonical"), None),
            "robots": meta("robots"),
            "lang": top.get("lang") or None,
            "open_graph": {n.attrs["property"]: n.get("content") for n in metas if n.get("property").startswith("og:")},
            "twitter": {n.attrs["name"]: n.get("content") for n in metas if n.get("name").startswith("twitter:")},
            "icons": [n.attrs["href"] for n in links if "icon" in n.get("rel").lower().split() and n.get("href")],
        }

    def meta_images(self, meta: dict, data: list) -> list[dict]:
        out: dict[str, dict] = {}

        def whole(v) -> int | None:
            m = re.match(r"\s*[+-]?\d+", str(v)) if isinstance(v, (str, int, float)) and not isinstance(v, bool) else None
            return (int(m[0]) or None) if m else None

        def add(u, alt: str = "", width: int | None = None, height: int | None = None) -> None:
            full = resolve(u, self.url) if isinstance(u, str) and u.strip() else None
            if full and re.match("https?:", full, re.I):
                out.setdefault(full, {"src": full, "alt": alt, "width": width, "height": height})

        og, tw = meta["open_graph"], meta["twitter"]
        alt = og.get("og:image:alt") or tw.get("twitter:image:alt") or ""
        size = whole(og.get("og:image:width")), whole(og.get("og:image:height"))
        for k in ("og:image", "og:image:secure_url"):
            add(og.get(k), alt, *size)
        for k in ("twitter:image", "twitter:image:src"):
            add(tw.get(k), alt)
        stack: list[tuple[object, int]] = [(data, 0)]
        while stack:
            node, depth = stack.pop()
            if not node or depth > 8:
                continue
            if isinstance(node, dict):
                types = node.get("@type")
                if "ImageObject" in (types if isinstance(types, list) else [types]):
                    name = next((node[k] for k in ("caption", "name") if isinstance(node.get(k), str) and node[k]), "")
                    for k in ("url", "contentUrl"):
                        add(node.get(k), name, whole(node.get("width")), whole(node.get("height")))
                primary = node.get("primaryImageOfPage")
                if isinstance(primary, str) and "#" not in primary:
                    add(primary)
                node = list(node.values())
            if isinstance(node, list):
                stack += [(v, depth + 1) for v in reversed(node)]
        return list(out.values())

    def visible_text(self) -> list[dict]:
        out: list[dict] = []
        stack: list[tuple[Node | str, Node]] = [(c, self.body) for c in reversed(self.body.children)]
        while stack:
            c, parent = stack.pop()
            if not isinstance(c, str):
                stack += [(k, c) for k in reversed(c.children)]
                continue
            text = SPACES.sub(" ", c).strip()
            if len(text) < 2 or parent.hidden:
                continue
            out.append({"text": cut(text, 500), "selector": css_path(parent), "region": region_of(parent), "page_order": len(out) + 1})
            if len(out) > self.caps["text_limit"]:
                break
        return out

    def blocks(self) -> list[dict]:
        if not self.caps["blocks"]:
            return []
        picked = [
            n
            for n in self.all
            if n.tag in ("header", "nav", "section", "article", "aside", "footer") or n.tag == "div" and n.parent is not None and n.parent.tag == "main"
        ]
        open_: dict[str, int] = {}
        outer = []
        for n in picked:  # inside an earlier one of its tag: nested
            if n.ord >= open_.get(n.tag, 0) and not n.hidden:
                outer.append(n)
                open_[n.tag] = n.end
        out = []
        for k, n in enumerate(outer[:40], 1):
            inside = list(n.walk())
            most = max(Counter(c.tag for c in n.elements).values(), default=0)
            out.append(
                {
                    "local_id": f"block.{k:03d}",
                    "selector": css_path(n),
                    "tag": n.tag,
                    "class_name": cut(n.get("class").lower(), 200),
                    "region": region_of(n),
                    "page_order": k,
                    "raw_text": clamp(n.text(), 1200),
                    "headings": [t for h in inside if h.tag in HEADS[:4] and (t := cut(h.text().strip(), 200))],
                    "links": [{"text": cut(a.text().strip(), 120), "href": self.href(a)} for a in inside if a.tag == "a" and "href" in a.attrs][:20],
                    "image_count": sum(c.tag == "img" for c in inside),
                    "repeated_cards": most if most >= 3 else 0,
                    "carousel": any(has_class(c, p) for c in inside for p in ("carousel", "slider", "swiper")),
                    "map_embed": any(c.tag == "iframe" and "maps" in c.get("src") for c in inside),
                    "has_form": any(c.tag == "form" for c in inside),
                }
            )
        return out

    def readable(self) -> tuple[str, str]:
        if not self.caps["readable"]:
            return "", ""
        main = next((n for n in self.all if n.tag == "main"), self.body)
        out: list[str] = []
        stack: list[Node | str] = [main]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n if n == "\n" else SPACES.sub(" ", n))
            elif not n.hidden or n is main:
                edge = ["\n"] if n.tag in BLOCKISH else []
                stack += [*edge, *n.children[::-1], *edge] if n.tag != "br" else ["\n"]
        text = re.sub(r" *\n *", "\n", "".join(out))
        return re.sub(r"\n{3,}", "\n\n", text).strip(), cut(self.html[main.inner[0] : main.inner[1]], 400_000)

    def ax(self) -> str | None:
        if not self.caps["ax"]:
            return None

        def build(n: Node, depth: int) -> dict | None:
            if depth > 6 or n.hidden:
                return None
            role = n.get("role") or ("link" if n.tag == "a" and "href" in n.attrs else ROLES.get(n.tag))
            kids = [k for c in n.elements if (k := build(c, depth + 1 if role else depth))]
            if not role:
                return kids[0] if len(kids) == 1 else {"role": "group", "children": kids} if kids else None
            out: dict = {"role": role}
            if name := cut(n.get("aria-label").strip(), 120) if n.get("aria-label") else clamp(n.text(), 120):
                out["name"] = name
            if role == "heading":
                level = int(n.tag[1]) if n.tag in HEADS else int(n.get("aria-level")) if n.get("aria-level").isdigit() else 0
                if level:
                    out["level"] = level
            if kids:
                out["children"] = kids[:30]
            return out

        tree = build(self.body, 0)
        return json.dumps(tree, ensure_ascii=False, separators=(",", ":")) if tree else None

    def delayed_js(self) -> bool:
        """Scripts that wait for interaction."""
        scripts = [n for n in self.all if n.tag == "script"]
        return any(n.get("type") in ("litespeed/javascript", "rocketlazyloadscripts") or "data-litespeed-src" in n.attrs for n in scripts)

    def record(self, members: Sequence[str] = tuple(MEMBERS)) -> dict:
        """The asked members; what none of them needs is not computed."""
        dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        out: dict = {}
        if not {"json_ld", "meta_images"}.isdisjoint(members):
            data = self.json_ld()
            out["json_ld"] = [dump(d) for d in data]
        if not {"metadata", "meta_images"}.isdisjoint(members):
            meta = self.metadata()
            out["metadata"] = meta | {k: list(meta[k].items()) for k in ("open_graph", "twitter")}
        if "meta_images" in members:
            out["meta_images"] = self.meta_images(meta, data)
        if not {"readable", "content_html"}.isdisjoint(members):
            out["readable"], out["content_html"] = self.readable()
        return {m: out[m] if m in out else getattr(self, m)() for m in members}


def _extractor(caps: dict, members: Sequence[str], schema: str):
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 100):
                part = big.slice(at, 100)
                rows = [
                    {"page_id": i, "url": u, **Page(u, h, caps).record(members)}
                    for i, u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def extract(pages: DataFrame, caps: dict = FULL, members: Sequence[str] = tuple(MEMBERS)) -> DataFrame:
    """page_id, url and the asked members of each page. Column pruning does not reach into
    a Python operator, so a query names what it needs."""
    schema = ", ".join(["page_id bigint", "url string", *[f"{m} {MEMBERS[m]}" for m in members]])
    return pages.select("page_id", "url", "html").mapInArrow(_extractor(caps, members, schema), schema)


def child(extracted: DataFrame, name: str) -> DataFrame:
    """page_id, url, ord (from 0) and the fields of one list of records."""
    return extracted.select("page_id", "url", F.posexplode(name).alias("ord", "r")).select("page_id", "url", "ord", "r.*")


def links(extracted: DataFrame) -> DataFrame:
    return child(extracted, "links").withColumn("tier", link_tier(F.col("appears_in")))


def counts() -> list[Column]:
    names = {"headings": "headings", "links": "links", "images": "images", "forms": "forms", "blocks": "blocks", "structured_data": "json_ld"}
    return [F.size(c).cast("long").alias(n) for n, c in names.items()]


def assets(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Image inventory of each site. images: page_id, ord, src, ...; pages: page_id, site,
    seq, slug, final_url. First values by (seq, ord); at most four contexts."""
    rows = images.join(pages, "page_id").filter("src <> ''")
    at = F.struct("seq", "ord")
    first = lambda c: F.min_by(c, at).alias(c)
    where = F.sort_array(F.collect_list(F.struct("seq", "ord", "final_url", "slug", "context")))
    grouped = rows.groupBy("site", "src").agg(F.min(at).alias("at"), *[first(c) for c in ("source", "alt", "title", "width", "height")], where.alias("w"))
    number = F.row_number().over(Window.partitionBy("site").orderBy("at"))
    return grouped.select(
        "site",
        F.format_string("asset.image.%03d", number).alias("id"),
        F.lit("image").alias("type"),
        F.col("src").alias("source_url"),
        F.lower(F.substring_index(F.substring_index(F.substring_index("src", "?", 1), "#", 1), ".", -1)).alias("ext"),
        *("source", "alt", "title", "width", "height"),
        F.lit(None).cast("string").alias("role"),
        F.transform("w", lambda x: x.getField("final_url")).alias("appears_on"),
        F.slice(F.transform(F.filter("w", lambda x: x.getField("context").isNotNull()), lambda x: F.struct(x.getField("slug").alias("page"), x.getField("context").alias("context"))), 1, 4).alias("contexts"),
    )
