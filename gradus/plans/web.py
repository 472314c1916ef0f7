"""Pages: rows of tables, images ranked as a site's mark, addresses made absolute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..functions import text as fn
from ..functions.exprs import let
from .registry import query, table

# Classes of rows that hold a benchmark and of those that don't.
ROW, CHART = "university__benchmark", "university__benchmark--chart"


def benchmark_rows(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, with a row for each benchmark of the html's tables.

    major_code (the last of the first cell's spans with a digit), major_name (its strong text,
    else its first text), subject_group, thpt_score (the third cell's first span, else all of
    it), other_criteria and tuition_fee. Rows of under four cells, and those with neither name nor code, are left out.
    """
    row = pages.select(*[c for c in pages.columns if c != "html"], F.explode(markup.page("html")["rows"]).alias("row"))
    row = row.where(F.array_contains("row.classes", ROW) & ~F.array_contains("row.classes", CHART) & (F.size("row.cells") >= 4))
    cell = lambda i: F.col("row.cells")[i]
    spans = F.filter(cell(0)["spans"], lambda s: s.rlike(r"\p{Nd}"))
    code = F.coalesce(F.try_element_at(spans, F.lit(-1)), F.lit(""))
    name = F.when(cell(0)["strong"] != "", cell(0)["strong"]).otherwise(cell(0)["first"])
    fee = F.when(F.size("row.cells") >= 5, F.get(F.col("row.cells"), F.lit(4))["text"]).otherwise("")
    score = F.coalesce(F.try_element_at(cell(2)["spans"], F.lit(1)), cell(2)["text"])
    out = row.select(*[c for c in pages.columns if c != "html"], code.alias("major_code"), name.alias("major_name"), cell(1)["text"].alias("subject_group"), score.alias("thpt_score"), cell(3)["text"].alias("other_criteria"), fee.alias("tuition_fee"))
    return out.where((F.col("major_code") != "") | (F.col("major_name") != ""))


@query("""SELECT p_brand AS school, 'C' || p_partkey AS major_code, p_name AS major_name, p_type AS subject_group, p_size::VARCHAR AS thpt_score, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'a & b <c>' END AS other_criteria,
  CASE WHEN p_size % 3 = 0 THEN 'fee' || p_size ELSE '' END AS tuition_fee FROM part WHERE p_size % 7 <> 0""")
def html_table_rows(spark, sf_dir):
    """Rows of tables that hold the parts, written as pages of brands and read back; every seventh size is a chart's row."""
    size = F.col("p_size")
    cells = F.concat(
        F.lit("<td> <strong>"), "p_name", F.lit("</strong><br><span>x</span> <span>C"), F.col("p_partkey").cast("string"), F.lit("</span><span>none</span></td><td>\n "), "p_type",
        F.when(size % 2 == 0, F.concat(F.lit("</td><td><span>"), size.cast("string"), F.lit("</span> points</td><td>"))).otherwise(F.concat(F.lit("</td><td> "), size.cast("string"), F.lit("<td>a &amp; b &lt;c&gt;"))),
        F.when(size % 3 == 0, F.concat(F.lit("<td>fee"), size.cast("string"), F.lit("</td>"))).otherwise(""),
    )
    row = F.concat(F.lit('<tr class="x '), F.lit(ROW), F.when(size % 7 == 0, F.lit(f" {CHART}")).otherwise(""), F.lit('">'), cells, F.lit("</tr>"))
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("school"), (F.col("p_partkey") % 1000).alias("slice"), row.alias("row"))
    pages = parts.groupBy("school", "slice").agg(F.concat(F.lit("<!DOCTYPE html><table>"), F.array_join(F.collect_list("row"), "\n"), F.lit("<tr><td>alone</table><p>end")).alias("html"))
    return benchmark_rows(pages).drop("slice")


# Words that mark an image as another body's; words of names that tell nothing.
PARTNERS = [
    "sponsor", "partner", "doi tac", "tai tro", "quang cao", "qc", "swiper slide", "khach hang", "doanh nghiep", "lien ket", "bgdvadt", "bo giao duc",
    "facebook", "youtube", "zalo", "linkedin", "goertek", "tma binhdinh", "logo vla", "bulsan", "strive", "cea saigon", "logo vnpt", "khoavnh", "nghean gov",
    "nxb thong tin", "publisher", "thiet ke logo", "banner", "tuyen sinh", "tin tuc", "news", "article", "eventnews", "thumb", "viettel", "long van",
    "iso 9001", "jste", "tap chi", "top 501",
]
COMMON = ["truong", "dai", "hoc", "vien", "khoa", "phan", "hieu", "co", "so", "he", "quan", "su", "viet", "nam", "va", "tai", "tp", "thanh", "pho"]
LOGO_NAME = r"^(?:(?:header|footer) )?logo(?: (?:image|img|icon|new|vi|vn|en|ph|[0-9]+))*$"


def plain(text: Column) -> Column:
    """ASCII letters and digits in words; a letter without an ASCII form is dropped."""
    return F.trim(F.regexp_replace(fn.ascii_only(text), "[^a-z0-9]+", " "))


def _known(name: Column) -> Column:
    """Words of a school's name that tell it from others."""
    return F.array_distinct(F.filter(F.split(plain(name), " "), lambda w: (F.length(w) > 2) & ~w.isin(COMMON)))


def _image_score(index: Column, marker: Column, source: Column, known: Column, code: Column) -> Column:
    """Score of an image, from its place, words, file name and the school; null if it can't be the site's mark."""

    def named(decoded: Column) -> Column:
        file = F.regexp_extract(F.regexp_extract(decoded, urls.PARTS, 3), "([^/]*?)(?:\\.[^./]*)?$", 1)
        return F.struct(plain(F.concat(marker, F.lit(" "), decoded)).alias("hay"), plain(file).alias("stem"))

    def counted(x: Column) -> Column:
        words = F.split(x["hay"], " ")
        has = (code != "") & F.array_contains(words, F.lower(code))
        return F.struct(x["hay"].alias("hay"), x["stem"].alias("stem"), F.size(F.array_intersect(known, words)).alias("shared"), has.alias("named"))

    def scored(x: Column) -> Column:
        hay, stem, shared = x["hay"], x["stem"], x["shared"]
        logo, header = hay.contains("logo"), hay.contains("header") | hay.contains("trang chu")
        file_logo = stem.rlike(LOGO_NAME) | (stem.startswith("logo ") & (F.length(stem) <= 24))
        parts = [
            (logo | hay.contains("brand"), 100), (logo, 800), (header, 70), (file_logo, 140), (hay.contains("footer logo"), 100),
            ((shared >= F.least(F.lit(2), F.size(known))) & (shared > 0), 100), (x["named"], 60), (fn.contains_any(hay, PARTNERS), -1200),
        ]
        score = F.greatest(F.lit(0), 50 - index) + 35 * shared
        for hit, points in parts:
            score = score + F.when(hit, points).otherwise(0)
        mark = logo | hay.contains("brand") | header | file_logo | x["named"]
        return F.when(mark, let(score, lambda s: F.when(s > 20, s)))

    decoded = urls.unquote(urls.unquote(F.replace(source, F.lit("\\"), F.lit("/"))))
    return let(let(let(decoded, named), counted), scored)


def ranked_assets(pages: DataFrame) -> DataFrame:
    """key, address, score and rank of the images that may be a site's mark, best first.

    pages: key, url, html, name and code. Images score by their words, icons 20, shared images
    of the meta values 10 (810 if their path says logo), and the favicon 0; an address counts
    with its best score and where it first stood. On https pages, http addresses become https.
    """
    page = F.col("page")
    known = pages.select("key", "url", F.coalesce("code", F.lit("")).alias("code"), _known(F.coalesce("name", F.lit(""))).alias("known"), markup.page("html").alias("page"))
    image = lambda x, i: F.struct(F.lit(0).alias("part"), i.alias("i"), x["source"].alias("source"), x["marker"].alias("marker"))
    icon = lambda x, i: F.struct(F.lit(1).alias("part"), i.alias("i"), x["href"].alias("source"), x["rel"].alias("marker"))
    meta = lambda x, i: F.struct(F.lit(2).alias("part"), i.alias("i"), x["content"].alias("source"), x["key"].alias("marker"))
    own = F.array(F.struct(F.lit(3).alias("part"), F.lit(0).alias("i"), F.lit("/favicon.ico").alias("source"), F.lit("").alias("marker")))
    each = known.select("key", "url", "code", "known", F.explode(F.concat(F.transform(page["images"], image), F.transform(page["links"], icon), F.transform(page["meta"], meta), own)).alias("x")).select("key", "url", "code", "known", "x.*")
    score = _image_score(F.col("i"), F.col("marker"), F.col("source"), F.col("known"), F.col("code"))
    part = F.col("part")
    shared = F.when(plain(urls.unquote(urls.unquote(F.regexp_extract("source", urls.PARTS, 3)))).contains("logo"), 810).otherwise(10)
    each = each.withColumn("score", F.when(part == 0, score).when(part == 1, F.when(F.col("marker").contains("icon"), 20)).when(part == 2, F.when(F.col("marker").isin("og:image", "twitter:image"), shared)).otherwise(0))
    absolute = urls.resolve(F.col("url"), F.when(part == 0, F.replace("source", F.lit("\\"), F.lit("/"))).otherwise(F.col("source")))
    absolute = let(absolute, lambda a: F.when(F.col("url").startswith("https:") & a.startswith("http://"), F.concat(F.lit("https"), F.substring(a, F.lit(5), F.length(a)))).otherwise(a))
    found = each.where("score is not null").withColumn("address", absolute).where(F.lower("address").rlike("^https?:"))
    best = found.groupBy("key", "address").agg(F.max("score").cast("bigint").alias("score"), F.min(F.struct("part", "i")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "first"))
    return best.select("key", "address", "score", rank.cast("bigint").alias("rank"))


SITE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
FOLDER = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)', 1)"
#: (part, place, words, source as SQL, address as SQL, score as SQL) of what the query adds to each page.
ADDED = [
    (0, 0, "header logo", "'/assets/img/logo/logo-' || page_id % 5 || '.png'", f"{SITE} || '/assets/img/logo/logo-' || page_id % 5 || '.png'", "50 + 100 + 800 + 70 + 140"),
    (0, 1, "banner", "'img/news' || page_id || '.jpg'", "NULL", "NULL"),
    (0, 2, "", "'../Brand%2520' || page_id || '.png?v=1'", f"{SITE} || regexp_replace({FOLDER}, '[^/]+/$', '') || 'Brand%2520' || page_id || '.png?v=1'", "48 + 100"),
    (0, 3, "truong queen", "'./a/../queen_header.gif'", f"{SITE} || {FOLDER} || 'queen_header.gif'", "47 + 70 + CASE WHEN page_id % 2 = 0 THEN 35 + 100 ELSE 0 END"),
    (0, 4, "sponsor logo", "'/partner/logo.png'", "NULL", "NULL"),
    (0, 5, "", "'http://cdn.example.com/x/s' || page_id || '.png'", "CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'http' END || '://cdn.example.com/x/s' || page_id || '.png'", "45 + 60"),
    (1, 0, "shortcut icon", "'fav' || page_id % 3 || '.ico'", f"{SITE} || {FOLDER} || 'fav' || page_id % 3 || '.ico'", "20"),
    (2, 0, "og:image", "'//cdn.example.org/' || page_id || '/Logo%20big.png'", "regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.org/' || page_id || '/Logo%20big.png'", "810"),
    (3, 0, "", "'/favicon.ico'", f"{SITE} || '/favicon.ico'", "0"),
]
_ASSETS_SQL = " UNION ALL ".join(f"SELECT page_id AS key, {part} AS part, {i} AS i, {address} AS address, {score} AS score FROM pages WHERE ({address}) IS NOT NULL" for part, i, _, _, address, score in ADDED)


@query(f"""WITH a AS ({_ASSETS_SQL}) SELECT key, address, score::BIGINT AS score, row_number() OVER (PARTITION BY key ORDER BY score DESC, part, i) AS rank FROM a""")
def page_marks(spark, sf_dir):
    """Images of pages, to which some are added, ranked as the site's mark with absolute addresses."""
    html = F.col("html")
    for part, _, words, source, _, _ in ADDED[:-1]:
        source = F.expr(source.replace("::VARCHAR", ""))
        tag = {0: ("<img alt='{}' data-src='", "'>"), 1: ("<link rel='{}' href='", "'/>"), 2: ("<meta property='{}' content='", "'>")}[part]
        html = F.concat(html, F.lit(tag[0].format(words)), source, F.lit(tag[1]))
    name = F.when(F.col("page_id") % 2 == 0, "Trường Đại học Queen").otherwise("Trường Đại học")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", html.alias("html"), name.alias("name"), F.concat(F.lit("S"), F.col("page_id").cast("string")).alias("code"))
    return ranked_assets(pages)


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages), u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS address FROM l WHERE href[1] = '/')
  SELECT page_id, address, count(*) AS n FROM u WHERE NOT regexp_matches(address, '://([^/]*\\.)?example\\.net/') GROUP BY ALL""")
def page_links(spark, sf_dir):
    """Links of each page made absolute, without those on hosts that are left out."""
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    address = urls.resolve(F.col("url"), F.col("href"))
    return links.select("page_id", address.alias("address")).where(~urls.on_hosts(F.col("address"), ["example.net"])).groupBy("page_id", "address").agg(F.count(F.lit(1)).alias("n"))
