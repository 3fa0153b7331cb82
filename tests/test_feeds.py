"""RSS and Atom files, their links, errors and the queries of the season."""

from newsgraph.sources import feeds

RSS = """<rss><channel><item><title>One</title><link>http://a/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0700</pubDate><source url="http://s">Own</source></item>
<item><title>Two</title><link>http://a/2</link><link>http://a/3</link></item><item><title> </title><link>http://a/4</link></item><item><title>Five</title></item>
<item><title>Six</wrong></item></channel></rss>"""
ATOM = """<feed><entry><title>Seven</title><link href="http://a/7" rel="self"/><link href="http://a/8"/><updated>2026-01-05T03:00:00Z</updated><summary>&lt;b&gt;s&lt;/b&gt;</summary></entry></feed>"""


def test_both_kinds_of_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, encoding="utf-8")
    (tmp_path / "b.xml").write_text(ATOM, encoding="utf-8")
    items = feeds.read_feeds(spark, str(tmp_path))
    got = {r["title"]: r for r in feeds.usable(items).collect()}
    assert {t: r["link"] for t, r in got.items()} == {"One": "http://a/1", "Two": "http://a/2", "Seven": "http://a/7"}
    assert got["One"]["source"]["_VALUE"] == "Own" and got["Seven"]["feed"].endswith("b.xml")
    left_out = {(r["feed"].rpartition("/")[2], r["reason"]): r["items"] for r in feeds.errors(items).collect()}
    # What follows a broken tag up to the end of the file may come back as a row of its own.
    assert left_out.pop(("a.xml", "malformed")) >= 1 and left_out == {("a.xml", "no title"): 1, ("a.xml", "no link"): 1}
    told = {r["title"]: r for r in feeds.direct_items(feeds.usable(items)).collect()}
    assert told["One"]["published"] == told["Seven"]["published"] and told["Seven"]["summary"] == "s" and told["One"]["source"] == "a"
    assert told["Two"]["published"] is None


def test_queries_of_the_season(spark):
    table = spark.createDataFrame([("bing", "a", False), ("bing", "b", True), ("google", "c", None), ("bing", "a", None)], "engine string, query string, seasonal boolean")
    of = lambda **how: sorted(r["query"] for r in feeds.search_queries(table, **how).collect())
    assert of() == ["a"] and of(seasonal=True) == ["a", "b"] and of(engines=("google", "bing")) == ["a", "c"]
