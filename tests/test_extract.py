import json

import pytest
from silkpage.operators.extract import FULL, SCAN, Page
from silkpage.operators import extract as X
from silkpage.sources.html import parse
from pyspark.sql import functions as F

URL = "https://a.test/dir/p"


def page(html, caps=FULL):
    return Page(URL, html, caps).record()


def test_links_types_and_regions():
    r = page(
        '<header><a href="/h">H</a></header><div role="navigation"><a href="n"> N </a></div><main><a href="mailto:x@y">m</a><a href="tel:1">t</a>'
        '<a href="https://b.test">e</a><a href="https://a.test.evil.x/">p</a><a>none</a></main><footer><p><a href="#f">F</a></footer>'
    )["links"]
    assert [(x["href"], x["type"], x["appears_in"], x["text"]) for x in r] == [
        ("https://a.test/h", "internal", "header", "H"), ("https://a.test/dir/n", "internal", "navigation", "N"), ("mailto:x@y", "email", "main", "m"), ("tel:1", "phone", "main", "t"),
        ("https://b.test/", "external", "main", "e"), ("https://a.test.evil.x/", "internal", "main", "p"), ("https://a.test/dir/p#f", "internal", "footer", "F"),
    ]


def test_images_context():
    html = (
        '<body><section><h2>Team</h2><div class="card x"><figure><a href="/jo"><img data-src="jo.jpg" alt="Jo" width="80"></a><figcaption> Jo  Doe </figcaption></figure></div></section>'
        '<img src="/logo.png"><img src="/logo.png"><img srcset="s.png 1x, t.png 2x"><img><div style="background: url(\'bg.jpg\')"></div><span data-bg="data:x"></span></body>'
    )
    r = page(html)["images"]
    assert [(x["src"], x["source"]) for x in r] == [("https://a.test/dir/jo.jpg", "img"), ("https://a.test/logo.png", "img"), ("https://a.test/dir/s.png", "img"), ("https://a.test/dir/bg.jpg", "background")]
    c = r[0]["context"]
    assert (c["nearest_heading"], c["figcaption"], c["link_href"], c["container_classes"]) == ("Team", "Jo Doe", "https://a.test/jo", [])
    assert r[0]["width"] == 80 and c["container_text"] == "Jo Doe"
    assert page(html, SCAN)["images"] == []


def test_forms():
    html = '<form method="post" action="/s"><label for="n"> Name </label><input id="n" name="nm" required><input type="hidden" name="h"><textarea name="t" placeholder="Say"></textarea><select name="s" aria-label="Pick"></select></form><form></form>'
    f = page(html)["forms"]
    assert (f[0]["method"], f[0]["action"], f[1]["method"]) == ("POST", "/s", "GET")
    assert [(x["name"], x["label"], x["type"], x["required"]) for x in f[0]["fields"]] == [("nm", "Name", "text", True), ("t", "Say", "textarea", False), ("s", "Pick", "select-one", False)]


def test_buttons_cut_before_empty_texts():
    html = "<button></button>" * 59 + '<a class="btn" href="/x">Go</a><button>late</button>' + '<div role="button">r</div>'
    assert [(b["text"], b["target"]) for b in page(html)["buttons"]] == [("Go", "https://a.test/x")]
    assert [b["text"] for b in page('<div class="my-btn">a</div><a class="cta">b</a><button hidden>c</button>')["buttons"]] == ["a", "b"]


def test_metadata_and_meta_images():
    html = (
        '<html lang="de"><head><title> A  B </title><meta name="description" content="d"><link rel="canonical" href="/c"><meta name="robots" content="noindex">'
        '<link rel="shortcut icon" href="/f.ico"><link rel="apple-touch-icon" href="/a.png"><meta property="og:image" content="/og.jpg"><meta property="og:image:width" content="120px"><meta name="twitter:image" content="/tw.jpg">'
        '<script type="application/ld+json">{"@graph":[{"@type":["ImageObject"],"url":"/ld.jpg","caption":"C","width":"9"},{"primaryImageOfPage":"/pi.jpg"}]}</script><script type="application/ld+json">{bad</script></head><body>x</body></html>'
    )
    r = page(html)
    m = r["metadata"]
    assert (m["title"], m["lang"], m["description"], m["canonical"], m["robots"], m["icons"]) == ("A B", "de", "d", "/c", "noindex", ["/f.ico"])
    assert [(i["src"], i["alt"], i["width"]) for i in r["meta_images"]] == [
        ("https://a.test/og.jpg", "", 120), ("https://a.test/tw.jpg", "", None), ("https://a.test/ld.jpg", "C", 9), ("https://a.test/pi.jpg", "", None),
    ]
    assert len(r["json_ld"]) == 1 and json.loads(r["json_ld"][0])["@graph"]


def test_visible_text_limit_and_hidden():
    html = "<body>" + "<p>word</p>" * 700 + "</body>"
    assert len(page(html)["visible_text"]) == 601 and len(page(html, SCAN)["visible_text"]) == 401
    texts = [t["text"] for t in page('<p>a</p><p>bc</p><script>var x</script><div hidden>no<p>no</p></div><p style="display: none">no</p><p>d\xa0 e</p>')["visible_text"]]
    assert texts == ["bc", "d e"]


def test_blocks():
    html = "<header>h</header><main><div><ul><li>1<li>2<li>3</ul></div><section><h2>T</h2><section>in</section><form></form><img><iframe src='https://www.google.com/maps/x'></iframe></section></main><article><p></p><p></p><p></p></article>"
    b = page(html)["blocks"]
    assert [(x["tag"], x["local_id"]) for x in b] == [("header", "block.001"), ("div", "block.002"), ("section", "block.003"), ("article", "block.004")]
    s = b[2]
    assert (s["headings"], s["image_count"], s["has_form"], s["map_embed"], s["repeated_cards"], b[3]["repeated_cards"]) == (["T"], 1, True, True, 0, 3)


def test_ax_tree():
    tree = json.loads(page('<div><div><nav aria-label="Main"><a href="/">x</a></nav></div><div><h2>H</h2></div></div>')["ax"])
    assert tree == {"role": "group", "children": [{"role": "navigation", "name": "Main", "children": [{"role": "link", "name": "x"}]}, {"role": "heading", "name": "H", "level": 2}]}


def test_malformed():
    r = page('<p>one<p>two<b>three<li>x<script>var t="</p>";</script><h1>T</h1>')
    assert [h["text"] for h in r["headings"]] == ["T"] and r["delayed_js"] is False
    assert page(None)["links"] == [] and page("")["metadata"]["title"] is None
    assert page('<script data-litespeed-src="x"></script>')["delayed_js"] is True
    root = parse("<ul><li>a<li>b</ul>")
    assert [n.tag for n in root.walk()].count("li") == 2 and all(len(n.elements) == 0 for n in root.walk() if n.tag == "li")


def test_readable():
    r = page("<body><nav>skip</nav><main><h1>T</h1><p>a  b</p><p>c</p><br><br><br></main></body>")
    assert r["readable"].startswith("T") and "a b" in r["readable"] and "skip" not in r["readable"] and "\n\n\n" not in r["readable"]
    assert r["content_html"] == "<h1>T</h1><p>a  b</p><p>c</p><br><br><br>"


def test_extract_and_assets(spark):
    rows = [(1, "https://a.test/", '<img src="/l.png" alt="L"><img src="x.jpg?v=1">'), (2, "https://a.test/b", '<h1>B</h1><p><img src="/l.png"></p>'), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    x = X.extract(pages)
    images = X.child(x, "images").drop("url")
    meta = spark.createDataFrame([(1, "a.test", 0, "home", "https://a.test/"), (2, "a.test", 1, "b", "https://a.test/b")], "page_id bigint, site string, seq int, slug string, final_url string")
    got = X.assets(images, meta).orderBy("id").collect()
    assert [(r.id, r.source_url, r.ext, r.alt, r.appears_on, len(r.contexts)) for r in got] == [
        ("asset.image.001", "https://a.test/l.png", "png", "L", ["https://a.test/", "https://a.test/b"], 2), ("asset.image.002", "https://a.test/x.jpg?v=1", "jpg", "", ["https://a.test/"], 1),
    ]
    only = x.select("page_id", (F.size("images") == 0).alias("none"), F.size("meta_images").alias("m")).orderBy("page_id").collect()
    assert [r.none for r in only] == [False, False, True]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_utf16_cut(n):
    assert X.cut("a😀b", n) == ["", "a", "a", "a😀", "a😀b", "a😀b"][n]
