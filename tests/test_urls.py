import pytest
from pyspark.sql import functions as F
from silkpage.functions import net, urls

BASE = "https://a.test/dir/page.html?x=1#f"


@pytest.mark.parametrize(
    "ref,want",
    [
        ("/b", "https://a.test/b"), ("c", "https://a.test/dir/c"), ("../d", "https://a.test/d"), ("./e/", "https://a.test/dir/e/"), ("?q=2", "https://a.test/dir/page.html?q=2"),
        ("#z", "https://a.test/dir/page.html?x=1#z"), ("//h.test/p", "https://h.test/p"), ("HTTP://H.TEST:80/P", "http://h.test/P"), ("/für", "https://a.test/f%C3%BCr"),
        ("/a b", "https://a.test/a%20b"), ("/the,", "https://a.test/the,"), ("mailto:a@b.test", "mailto:a@b.test"), ("http://", None), ("", "https://a.test/dir/page.html?x=1"),
        ("/a/%2e%2e/b", "https://a.test/b"), ("https:\\\\x.test\\y", "https://x.test/y"), (" /t\t/u\n", "https://a.test/t/u"),
    ],
)
def test_resolve(ref, want):
    assert urls.resolve(ref, BASE) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://a.test/INDEX.HTML", "https://a.test/"), ("https://a.test/x/index.htm", "https://a.test/x"), ("https://a.test//x//y/", "https://a.test/x/y"), ("https://a.test/", "https://a.test/"),
        ("https://a.test/x/?utm_source=q&b=1&fbclid=z", "https://a.test/x/?b=1"), ("https://a.test/x/?gclid=1#top", "https://a.test/x"), ("nope", None),
    ],
)
def test_normalize_both_ways(spark, url, want):
    assert urls.normalize(url) == want
    assert spark.createDataFrame([(url,)], "u string").select(urls.normalize_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    "url,key", [("https://www.a.co.uk/x", "a.co.uk"), ("https://x.y.a.test", "a.test"), ("https://a.test", "a.test"), ("https://localhost/", "localhost"), ("bad", "bad"), ("http://10.1.2.3/", "2.3")]
)
def test_politeness_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(urls.politeness_key(F.col("u"))).first()[0] == key


def test_slugs_and_exclusion(spark):
    df = spark.createDataFrame([("https://a.test/",), ("https://a.test/Über uns/",), ("https://a.test/!!!",), ("https://a.test/CART/x",), ("x",), (None,)], "u string")
    got = df.select(urls.slug_base(F.col("u")), urls.scan_slug_base(F.col("u")), urls.path_excluded(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("home", "home", False), ("ber-uns", "ber-uns", False), ("page", "home", False), ("cart-x", "cart-x", True), (None, "page", True), (None, "page", True)]


def test_mapped_address_in_url(spark):
    df = spark.createDataFrame([("http://[::ffff:7f00:1]/",)], "u string")
    assert df.select(net.url_guard(F.col("u"))).first()[0] == "url_private_address"
