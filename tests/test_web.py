"""Addresses against the standard library, table rows and ranked images against hand-worked pages."""

import random
from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from gradus.functions import markup, urls
from gradus.plans import web


def test_references_are_resolved_as_the_standard_library_does(spark):
    rng = random.Random(4)
    bases = ["http://a.b/c/d;p?q#f", "https://x.example.com:80", "https://x.example.com/", "http://h/a/b/", "http://h/a//b/../c", "https://h/a/b?x=/y/z"]
    refs = ["", "g", "./g", "g/", "/g", "//other/g", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "./../g", "./g/.", "g/./h", "g/../h", "http://z/a/../b", "mailto:x@y", "data:image/png;base64,AA==", "a//b", "/a//b/", "https://q"]
    refs += ["/".join(rng.choice(["..", ".", "x", "y.png", ""]) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    refs = [r for r in refs if not r.startswith("///")]
    rows = [(b, r) for b in bases for r in refs]
    got = {(x.b, x.r): x.u for x in spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(*k)} == {}
    none = spark.createDataFrame([(None, "a"), ("http://a", None)], "b string, r string").select(urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    assert [r.u for r in none] == [None, None]


def test_percent_codes_and_hosts(spark):
    texts = ["a%20b", "%C4%91%E1%BA%A1i", "100%", "%zz%41", "a+b", "%2520", "", "%E2%82"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.unquote(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == {t: unquote(t) for t in texts}
    addresses = {"http://Facebook.com:80/x": True, "https://m.facebook.com": True, "http://notfacebook.com/": False, "/x": False}
    df = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", urls.on_hosts(F.col("a"), ["facebook.com"]).alias("hit"))
    assert {r.a: r.hit for r in df.collect()} == addresses


PAGE = """<table><tr class='university__benchmark'><td><strong> Y  khoa </strong><span>a</span><span> 7720101 </span><span>x</span></td>
<td> B00; A00 </td><td><span>26.5</span> (30)</td><td>note &amp; <b>more</b></td><td>10 tr</td></tr>
<tr class="university__benchmark university__benchmark--chart"><td>1</td><td>2</td><td>3</td><td>4</td></tr>
<tr class="university__benchmark"><td>Luật<i>!</i></td><td></td><td>21</td><td>-
<tr class="university__benchmark"><td>short</td><td>2</td><td>3</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr>
<tr class="university__benchmark"><td></td><td>b</td><td>c</td><td>d</td></tr></table>
<img alt="Logo Trường Y" src="" data-src="i/LOGO vn.png"><img src='x.png'><link rel="Shortcut Icon" href="f.ico"><link rel=icon><meta property="OG:image" content="/o.jpg"><meta name="k" content="">"""


def test_rows_images_and_meta(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no table")], "key int, html string")
    got = [tuple(r) for r in web.benchmark_rows(df).collect()]
    assert sorted(got) == [(1, "", "Luật", "", "21", "-", ""), (1, "7720101", "Y  khoa", "B00; A00", "26.5", "note &more", "10 tr")]
    found = {r.key: r.page for r in df.select("key", markup.page("html").alias("page")).collect()}
    assert [(m.strip(), s) for m, s in found[1].images] == [("logo trường y", "i/LOGO vn.png"), ("", "x.png")]
    assert found[1].links == [("shortcut icon", "f.ico")] and found[1].meta == [("og:image", "/o.jpg")]
    assert found[2] == ([], [], [], []) == found[3]


def test_marks_of_a_page(spark):
    row = (1, "https://y.edu.vn/vi/home", PAGE + "<img class='logo partner' src='http://y.edu.vn/p/logo.png'><img src='http://y.edu.vn/brand/yd.png'>", "Trường Đại học Y Dược", "YD")
    got = [tuple(r)[1:] for r in web.ranked_assets(spark.createDataFrame([row], "key int, url string, html string, name string, code string")).orderBy("rank").collect()]
    assert got == [
        ("https://y.edu.vn/vi/i/LOGO vn.png", 50 + 100 + 800 + 140, 1),
        ("https://y.edu.vn/brand/yd.png", 47 + 100 + 60, 2),
        ("https://y.edu.vn/vi/f.ico", 20, 3),
        ("https://y.edu.vn/o.jpg", 10, 4),
        ("https://y.edu.vn/favicon.ico", 0, 5),
    ]


def test_costly_steps_stand_once_in_a_mark(spark):
    page = spark.createDataFrame([(1, "http://a/b", "<img alt=logo src=x.png>", "n", "c")], "key int, url string, html string, name string, code string")
    plan = web.ranked_assets(page)._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("url_decode(") <= 4 and 0 < plan.count("translate(") <= 4
