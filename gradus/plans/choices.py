"""A candidate's choices: scored options, searches, earlier years' cutoffs, and small lookups."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import interests
from ..functions import text as fn
from ..functions.exprs import clip, scale_quantiles
from ..operators import forecasts, lookup, numbering
from ..operators import series as ops
from ..operators.lookup import top_per_group
from ..operators.quantiles import with_quantiles
from ..sources.files import read_json, read_or_build, shared_dir, store, work_dir
from .registry import query, table
from .series import GUESSES, KEYS, METRICS, PRIOR, guesses, series

# Weights of admission, interests, salary, demand and stability, without and with interests.
PLAIN, INTERESTED = (0.40, 0.00, 0.25, 0.20, 0.15), (0.35, 0.20, 0.20, 0.15, 0.10)
# What stands for an unknown salary and number of postings, and the least of each.
SALARY, POSTINGS = (15.0, 5.0), (500.0, 10.0)
NOTHING_FOUND = "no option meets these conditions"


def recommend_all(options: DataFrame, user_scores: list[float], interested: bool) -> DataFrame:
    """Options on the 30-point scale within reach of each score, with user_score, gap, bucket and score.

    options: cutoff, predicted (null: the cutoff stands), is_scale_40, fit (share of interests
    met), salary, postings, years_observed, std, ambiguous. With interests, options that meet
    none are left out. Salaries and postings are scaled by exact quantiles of the options left to
    a score, found for all scores together.
    """
    ranking = F.coalesce("predicted", "cutoff")
    df = options.where(~F.coalesce("is_scale_40", F.lit(False)) & F.col("cutoff").isNotNull())
    df = df.withColumns({"ranking_cutoff": ranking, "user_score": F.explode(F.array(*map(F.lit, user_scores)))})
    df = df.withColumn("gap", F.round(F.col("user_score") - F.col("ranking_cutoff"), 2)).where("gap >= -3")
    if interested:
        df = df.where("fit > 0")
    filled = lambda name, other, least: F.greatest(F.lit(least), F.coalesce(F.col(name), F.lit(other)))
    df = df.withColumns({"salary": filled("salary", *SALARY), "postings": filled("postings", *POSTINGS)})
    df = with_quantiles(store(df, "options"), ["user_score"], ["salary", "postings"], [0.05, 0.95])
    stable = F.when((F.coalesce("years_observed", F.lit(1)) >= 2) & F.col("std").isNotNull() & ~F.coalesce("ambiguous", F.lit(False)), 1 / (1 + F.col("std"))).otherwise(0.5)
    scaled = lambda name: scale_quantiles(F.col(name), F.col(f"q_{name}")[0], F.col(f"q_{name}")[1])
    parts = [clip((F.col("gap") + 3) / 4, 0.05, 1.0), F.col("fit"), scaled("salary"), scaled("postings"), stable]
    weights = INTERESTED if interested else PLAIN
    total = sum(weights)
    score = sum((p * (w / total) for p, w in zip(parts[1:], weights[1:], strict=True)), parts[0] * (weights[0] / total))
    bucket = F.when(F.col("gap") >= 1, "safe").when(F.col("gap") >= -1, "match").otherwise("reach")
    return df.withColumns({"bucket": bucket, "score": F.round(100 * score, 1)}).drop("q_salary", "q_postings")


def recommend(options: DataFrame, user_score: float, interested: bool) -> DataFrame:
    """recommend_all for one score."""
    return recommend_all(options, [user_score], interested)


def response(scored: DataFrame, user_scores: list[float]) -> DataFrame:
    """For each score, options in each bucket and in all, and a message if there are none."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in ("safe", "match", "reach")]
    found = scored.groupBy("user_score").agg(*counts)
    asked = scored.sparkSession.createDataFrame([(s,) for s in user_scores], "user_score double")
    df = asked.join(found, "user_score", "left").na.fill(0, ["safe", "match", "reach"]).withColumn("total", F.col("safe") + F.col("match") + F.col("reach"))
    return df.withColumn("message", F.when(F.col("total") == 0, NOTHING_FOUND))


INTERESTS = {"machines": ["machinery", "automobile"], "homes": ["household", "furniture", "machinery"]}
#: Known elsewhere by these names; looked for in the segment alone; ruled out by words of the segment.
CALLED, SEGMENT_ONLY, NEVER = {"engines": "machines"}, ["homes"], {"machines": ["auto"]}
ASKED_INTERESTS = ["Engines", " homes ", "homes"]
COMBO = "1-URGENT"
FORECAST_KEYS = ["nation", "segment", "combo"]
SOURCE = "mean_of_history"


def forecast_features(spark, sf_dir):
    """Features of the year after the last, of every series of the last year; stored once a data set and version."""

    def build():
        base = series(spark, sf_dir)
        every = ops.future_rows(base, KEYS)
        df = ops.prior_stats(ops.lag_features(every, KEYS), KEYS)
        df = ops.prior_group_history(df, ["combo"], "of_combo", base=every)
        last = base.agg(F.max("year").alias("last_year"))
        new = df.join(F.broadcast(last), F.col("year") > F.col("last_year"))  # one row
        return new.drop("last_year", "target").withColumns({"forecast_year": F.col("year"), "nation_text": F.col("nation").cast("string")})

    name = f"forecast-features-{FEATURES_VERSION}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return read_or_build(spark, f"{shared_dir(spark)}/{name}", build)


FEATURES_VERSION = "2"


def mean_of_history(features: DataFrame) -> DataFrame:
    """A forecast that needs no training: the mean of what was seen before the year to come."""
    seen = F.round(clip(F.col("prior_mean"), 0.0, 30.0), 2)
    return features.withColumns({"predicted": F.when(F.col("prior_count") > 0, seen), "model_version": F.lit(SOURCE), "is_cold_start": F.col("prior_count") == 1})


def _options(spark, sf_dir, predict=mean_of_history, source=SOURCE):
    """The last year's options of one combination, with forecasts for the year after it."""
    df = ops.prior_stats(series(spark, sf_dir).where(F.col("combo") == COMBO), KEYS)
    last = df.agg(F.max("year").alias("last_year"))
    df = df.join(F.broadcast(last), F.col("year") == F.col("last_year"))  # one row
    customer = table(spark, sf_dir, "customer")
    pay = customer.where("c_nationkey % 5 > 0").groupBy(F.col("c_nationkey").alias("nation_id")).agg((F.avg("c_acctbal") / 300).alias("salary"))
    demand = customer.where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).cast("double").alias("postings"))
    key = F.col("nation").cast("string")  # codes come with spaces, and some that no series has
    df = df.withColumn("nation_id", F.col("nation")).withColumn("nation", F.when(key.endswith("5"), F.concat(F.lit("X"), key)).otherwise(F.concat(F.lit(" "), key, F.lit(" "))))
    df = df.join(pay, "nation_id", "left").join(demand, "segment", "left")
    df = forecasts.attach(df, forecast_features(spark, sf_dir), FORECAST_KEYS, predict, source, [F.col("nation")])
    fit = interests.fit(F.col("segment"), F.lit("sold in homes_and machinery"), ASKED_INTERESTS, INTERESTS, SEGMENT_ONLY, NEVER, CALLED)
    return df.select(
        F.col("nation_id").alias("nation"), "segment", F.col("target").alias("cutoff"), "predicted", "forecast_source", "forecast_year", "model_version", "is_cold_start",
        (F.col("nation_id") % 10 == 4).alias("is_scale_40"), (F.col("nation_id") % 7 == 3).alias("ambiguous"),
        F.col("prior_count").alias("years_observed"), F.col("prior_std").alias("std"), "salary", "postings", fit.alias("fit"),
    )


OPTIONS_SQL = f"""last AS (SELECT max(year) AS y FROM series WHERE combo = '{COMBO}'), final AS (SELECT max(year) AS y FROM series),
  guess AS (SELECT nation, segment, combo, round(greatest(0, least(30, avg(target))), 2) AS predicted, count(*) = 1 AS is_cold_start FROM series GROUP BY ALL HAVING max(year) = (SELECT y FROM final)),
  opts AS (
    SELECT p.nation, p.segment, p.target AS cutoff, g.predicted, CASE WHEN g.predicted IS NULL THEN '{forecasts.FALLBACK}' ELSE '{SOURCE}' END AS forecast_source,
      CASE WHEN g.predicted IS NOT NULL THEN final.y + 1 END AS forecast_year, g.is_cold_start, p.nation % 7 = 3 AS ambiguous, prior_count, prior_std, salary, postings,
      ((1 - CASE WHEN contains(lower(p.segment), 'auto') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(lower(p.segment), 'household|furniture|machinery') THEN 1 ELSE 0 END) / 2.0 AS fit
    FROM prior p JOIN last ON p.year = last.y CROSS JOIN final
    LEFT JOIN (SELECT c_nationkey AS nation, avg(c_acctbal) / 300 AS salary FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1) USING (nation)
    LEFT JOIN (SELECT c_mktsegment AS segment, count(*)::DOUBLE AS postings FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) USING (segment)
    LEFT JOIN guess g ON g.nation = p.nation AND g.segment = p.segment AND g.combo = p.combo AND p.nation % 10 <> 5
    WHERE p.combo = '{COMBO}' AND p.nation % 10 <> 4)"""


def _scored_sql(user_scores, interested: bool, name: str = "scored") -> str:
    w = INTERESTED if interested else PLAIN
    scores = ", ".join(f"({s}::DOUBLE)" for s in user_scores)
    return f"""{OPTIONS_SQL}, {name}_f AS (SELECT * FROM (SELECT u.user_score, opts.* REPLACE (greatest(5.0, coalesce(salary, 15.0)) AS salary, greatest(10.0, coalesce(postings, 500.0)) AS postings),
        coalesce(predicted, cutoff) AS ranking_cutoff, round(user_score - coalesce(predicted, cutoff), 2) AS gap FROM opts, (VALUES {scores}) u(user_score)) WHERE gap >= -3{" AND fit > 0" * interested}
    ), {name}_q AS (SELECT user_score, quantile_cont(salary, 0.05) AS s5, quantile_cont(salary, 0.95) AS s95, quantile_cont(postings, 0.05) AS d5, quantile_cont(postings, 0.95) AS d95 FROM {name}_f GROUP BY 1
    ), {name} AS (SELECT {name}_f.*, CASE WHEN gap >= 1 THEN 'safe' WHEN gap >= -1 THEN 'match' ELSE 'reach' END AS bucket,
      round(100 * ({w[0]} * greatest(0.05, least(1, (gap + 3) / 4)) + {w[1]} * fit
        + {w[2]} * CASE WHEN s95 <= s5 THEN 0.5 ELSE greatest(0, least(1, (salary - s5) / (s95 - s5))) END
        + {w[3]} * CASE WHEN d95 <= d5 THEN 0.5 ELSE greatest(0, least(1, (postings - d5) / (d95 - d5))) END
        + {w[4]} * CASE WHEN prior_count >= 2 AND prior_std IS NOT NULL AND NOT ambiguous THEN 1 / (1 + prior_std) ELSE 0.5 END), 1) AS score FROM {name}_f JOIN {name}_q USING (user_score))"""


def _top_sql(user_score: float, interested: bool) -> str:
    return f"""WITH {PRIOR}, {_scored_sql([user_score], interested)} SELECT bucket, nation, segment, round(ranking_cutoff, 4) AS ranking_cutoff, gap, score,
      row_number() OVER (PARTITION BY bucket ORDER BY score DESC, abs(gap), nation, segment)::INT AS rank FROM scored QUALIFY rank <= 15"""


def best():
    """Order of options: score, then the smaller gap."""
    return [F.desc("score"), F.abs(F.col("gap")), F.col("nation"), F.col("segment")]


def _top(spark, sf_dir, interested):
    df = recommend(_options(spark, sf_dir), 12.5, interested).select("bucket", "nation", "segment", F.round("ranking_cutoff", 4).alias("ranking_cutoff"), "gap", "score")
    return top_per_group(df, ["bucket"], best(), 15)


@query(_top_sql(12.5, False))
def recommend_by_forecast(spark, sf_dir):
    """Forecast cutoffs where there are, fills, ambiguity, and ties to the smaller gap."""
    return _top(spark, sf_dir, False)


@query(_top_sql(12.5, True))
def recommend_by_interests(spark, sf_dir):
    """Only options that meet an interest, under other weights."""
    return _top(spark, sf_dir, True)


SCORES = (12.5, 1.0, 30.0)


@query(f"""WITH {PRIOR}, {_scored_sql(SCORES, False)} SELECT user_score, count(*) FILTER (WHERE bucket = 'safe') AS safe, count(*) FILTER (WHERE bucket = 'match') AS match, count(*) FILTER (WHERE bucket = 'reach') AS reach,
  count(bucket) AS total, CASE WHEN count(bucket) = 0 THEN '{NOTHING_FOUND}' END AS message FROM (VALUES {", ".join(f"({s}::DOUBLE)" for s in SCORES)}) u(user_score) LEFT JOIN scored USING (user_score) GROUP BY 1""")
def recommend_counts(spark, sf_dir):
    """Counts of the buckets for several scores; where nothing is found, a message instead of rows."""
    return response(recommend_all(_options(spark, sf_dir), list(SCORES), False), list(SCORES))


@query(f"""WITH {PRIOR}, {OPTIONS_SQL} SELECT nation, segment, round(cutoff, 4) AS cutoff, predicted, forecast_source, forecast_year::INT AS forecast_year,
  CASE WHEN predicted IS NOT NULL THEN '{SOURCE}' END AS model_version, CASE WHEN predicted IS NOT NULL THEN is_cold_start END AS is_cold_start, fit::DOUBLE AS fit FROM opts""")
def forecast_attach_fallback(spark, sf_dir):
    """Options with the forecast of the stored feature table by three trimmed keys, or what was seen, labelled."""
    df = _options(spark, sf_dir).where(~F.col("is_scale_40"))
    return df.select("nation", "segment", F.round("cutoff", 4).alias("cutoff"), "predicted", "forecast_source", F.col("forecast_year").cast("int").alias("forecast_year"), "model_version", "is_cold_start", "fit")


# What is said where no market data are known, and the mean of a subject that is not known.
NO_MARKET, MEAN_UNKNOWN = "not enough verified market data", 6.5


def answer(scored: DataFrame, user_scores: list[float], own: DataFrame, nation: DataFrame) -> DataFrame:
    """The whole answer to each score as rows (user_score, section, place, item, amount, label).

    Sections: safe, match and reach (up to 15 options each), top (five over all buckets, labelled
    with the forecast's source), prediction (of the first of those), career (its market, or that
    none is known), count (of each bucket) and deviation (own scores, user_score, subject and
    score, from the nation's means).
    """
    option = F.concat_ws("/", "nation", "segment")
    row = lambda section, place, item, amount, label: [section.alias("section"), place.cast("int").alias("place"), item.alias("item"), amount.cast("double").alias("amount"), label.alias("label")]
    scored = store(scored, "scored")
    listed = top_per_group(scored, ["user_score", "bucket"], best(), 15)
    buckets = listed.select("user_score", *row(F.col("bucket"), F.col("rank"), option, F.col("score"), F.col("forecast_source")))
    five = top_per_group(scored, ["user_score"], best(), 5)
    top = five.select("user_score", *row(F.lit("top"), F.col("rank"), option, F.round("ranking_cutoff", 2), F.col("forecast_source")))
    first = five.where("rank = 1")
    said = F.concat(F.lit("about "), F.format_string("%.1f", "market_salary"), F.lit(" a month, "), F.col("market_postings").cast("bigint").cast("string"), F.lit(" postings"))
    prediction = first.select("user_score", *row(F.lit("prediction"), F.lit(1), option, F.round("gap", 2), F.coalesce("model_version", "forecast_source")))
    career = first.select("user_score", *row(F.lit("career"), F.lit(1), option, F.col("market_salary"), F.when(F.col("market_salary").isNotNull() & F.col("market_postings").isNotNull(), said).otherwise(NO_MARKET)))
    counts = response(scored, user_scores).unpivot(["user_score", "message"], ["safe", "match", "reach"], "item", "amount")
    counts = counts.select("user_score", *row(F.lit("count"), F.lit(None), F.col("item"), F.col("amount"), F.col("message")))
    own = own.join(nation, "subject", "left")
    apart = F.round(F.col("own") - F.coalesce("mean", F.lit(MEAN_UNKNOWN)), 2)
    sign = F.concat(F.when(apart >= 0, "+").otherwise(""), F.format_string("%.2f", apart))
    deviation = own.select("user_score", *row(F.lit("deviation"), F.lit(None), F.col("subject"), apart, sign))
    out = buckets
    for part in (top, prediction, career, counts, deviation):
        out = out.unionByName(part)
    return out


def _answer(spark, sf_dir, predict=mean_of_history, source=SOURCE):
    options = _options(spark, sf_dir, predict, source).withColumns({"market_salary": F.col("salary"), "market_postings": F.col("postings")})
    events = table(spark, sf_dir, "events")
    nation = events.where("event_type <> 'click'").groupBy(F.col("event_type").alias("subject")).agg(F.avg("value").alias("mean"))
    own = events.where("user_id = 7").groupBy(F.col("event_type").alias("subject")).agg(F.max("value").alias("own"))
    own = own.withColumn("user_score", F.explode(F.array(*map(F.lit, SCORES))))
    return answer(recommend_all(options, list(SCORES), True), list(SCORES), own, nation)


@query(f"""WITH {PRIOR}, {_scored_sql(SCORES, True)}, market AS (SELECT nation, segment, salary AS market_salary, postings AS market_postings FROM opts),
  ranked AS (SELECT s.*, m.market_salary, m.market_postings, nation || '/' || segment AS item, row_number() OVER (PARTITION BY user_score, bucket ORDER BY score DESC, abs(gap), nation, segment)::INT AS in_bucket,
    row_number() OVER (PARTITION BY user_score ORDER BY score DESC, abs(gap), nation, segment)::INT AS place FROM scored s JOIN market m USING (nation, segment)),
  means AS (SELECT event_type AS subject, avg(value) AS mean FROM events WHERE event_type <> 'click' GROUP BY 1),
  own AS (SELECT event_type AS subject, max(value) AS own FROM events WHERE user_id = 7 GROUP BY 1), asked(user_score) AS (VALUES {", ".join(f"({s}::DOUBLE)" for s in SCORES)}),
  dev AS (SELECT user_score, subject, round(own - coalesce(mean, {MEAN_UNKNOWN}), 2) AS d FROM own LEFT JOIN means USING (subject), asked)
  SELECT user_score, bucket AS section, in_bucket AS place, item, score AS amount, forecast_source AS label FROM ranked WHERE in_bucket <= 15
  UNION ALL SELECT user_score, 'top', place, item, round(ranking_cutoff, 2), forecast_source FROM ranked WHERE place <= 5
  UNION ALL SELECT user_score, 'prediction', 1, item, gap, CASE WHEN predicted IS NULL THEN forecast_source ELSE '{SOURCE}' END FROM ranked WHERE place = 1
  UNION ALL SELECT user_score, 'career', 1, item, market_salary, coalesce('about ' || format('{{:.1f}}', market_salary) || ' a month, ' || market_postings::BIGINT || ' postings', '{NO_MARKET}') FROM ranked WHERE place = 1
  UNION ALL SELECT user_score, 'count', NULL, b, (SELECT count(*) FROM scored s WHERE s.user_score = asked.user_score AND s.bucket = b)::DOUBLE,
    CASE WHEN (SELECT count(*) FROM scored s WHERE s.user_score = asked.user_score) = 0 THEN '{NOTHING_FOUND}' END FROM asked, (VALUES ('safe'), ('match'), ('reach')) x(b)
  UNION ALL SELECT user_score, 'deviation', NULL, subject, d, CASE WHEN d >= 0 THEN '+' ELSE '' END || format('{{:.2f}}', d) FROM dev""")
def recommend_answer(spark, sf_dir):
    """Buckets, top five, prediction, market, counts and deviations of several scores in one table."""
    return _answer(spark, sf_dir)


#: Pages beyond are taken as this one, which is empty: positions fit in 64 bits.
LAST_PAGE = 10**16
#: A page that ends within so many rows is found as a top-k, a later one by numbering all rows.
TOP_ROWS = 10_000


@dataclass
class Search:
    """A search as it comes: texts, none required."""

    q: str = ""
    combination: str = ""
    group: str = ""
    scale: str = "all"
    sort: str = "cutoff_desc"
    page: str = "1"
    limit: str = "15"

    def bounds(self) -> tuple[int, int]:
        """Page, 1 at least, and limit, 5 to 100; what is no number counts as 1 and 15."""

        def number(text, other):
            try:
                return int(text)
            except ValueError:
                return other

        return min(LAST_PAGE, max(1, number(self.page, 1))), min(100, max(5, number(self.limit, 15)))


def search_page(rows: DataFrame, s: Search, seen: list[str]) -> DataFrame:
    """The page of rows that a search asks for, with total, page, limit and pages.

    rows: id (source order), combination, group, is_scale_40, cutoff, school and the columns
    seen, which a text is looked for in, with and without accents. Conditions not given don't
    filter. A page without rows is one row of a null id.
    """
    page, limit = s.bounds()
    df = rows
    if s.scale in ("30", "40"):
        df = df.where(F.coalesce("is_scale_40", F.lit(False)) == (s.scale == "40"))
    if s.combination.strip():
        df = df.where(F.upper("combination").contains(s.combination.strip().upper()))
    if s.group.strip():
        df = df.where(F.lower("group").contains(s.group.strip().lower()))
    if s.q.strip():
        hay, q = F.lower(F.concat_ws(" ", *seen)), F.lit(s.q.strip().lower())
        df = df.where(hay.contains(q) | fn.fold(hay).contains(fn.fold(q)))
    order = {"cutoff_asc": [F.asc("cutoff")], "cutoff_desc": [F.desc("cutoff")], "school_asc": [F.asc("school")]}.get(s.sort, [])
    total = df.agg(F.count(F.lit(1)).alias("total"))
    first = (page - 1) * limit
    if page * limit <= TOP_ROWS:
        found = df.orderBy(*order, "id").limit(page * limit).offset(first).select("id")
    elif first >= total.first().total:
        found = df.select("id").limit(0)
    else:
        found = numbering.positions(df.select(*dict.fromkeys(["cutoff", "school", "id"])), [*order, F.col("id")]).where(F.col("position").between(first, first + limit - 1)).select("id")
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / limit))
    whole = F.broadcast(total.select("total", F.lit(page).cast("bigint").alias("page"), F.lit(limit).alias("limit"), pages.alias("pages")))  # one row
    return found.join(whole, F.lit(True), "right")


SEARCHES = [
    Search(q=" STEEL ", page="2", limit="500"),
    Search(combination="7", sort="cutoff_asc", page="x", limit="2"),
    Search(group="AN", scale="40", sort="school_asc", limit="30"),
    Search(q="navy", scale="30", sort="as_is", page="-3"),
    Search(q="rosé", limit="7"),
    Search(q="steel", page="99999999999", limit="100"),
    Search(page="+-5", limit="5"),
    Search(q="no such thing", page="²", limit="--3"),
    Search(group="brass", sort="cutoff_asc", page="1" + "0" * 30),
    Search(combination="1", page="2", sort="school_asc", limit="20"),
]


def _search_sql(k: int, s: Search) -> str:
    page, limit = s.bounds()
    hay = "lower(p_name || ' ' || p_brand || ' ' || p_type)"
    where = ["true"]
    if s.scale in ("30", "40"):
        where.append(f"(p_size > 40) = {s.scale == '40'}")
    if s.combination.strip():
        where.append(f"contains(p_size::VARCHAR, '{s.combination.strip()}')")
    if s.group.strip():
        where.append(f"contains(lower(p_type), '{s.group.strip().lower()}')")
    if s.q.strip():
        where.append(f"(contains({hay}, '{s.q.strip().lower()}') OR contains(strip_accents({hay}), strip_accents('{s.q.strip().lower()}')))")
    order = {"cutoff_asc": "p_retailprice, ", "cutoff_desc": "p_retailprice DESC, ", "school_asc": "p_brand, "}.get(s.sort, "")
    return f"""SELECT {k} AS request, id, total, {page}::BIGINT AS page, {limit} AS "limit", greatest(1, ceil(total / {limit}))::BIGINT AS pages
      FROM (SELECT count(*) AS total FROM part WHERE {" AND ".join(where)})
      LEFT JOIN (SELECT p_partkey AS id FROM part WHERE {" AND ".join(where)} ORDER BY {order}p_partkey LIMIT {limit} OFFSET {(page - 1) * limit}) ON true"""


@query(" UNION ALL ".join(_search_sql(k, s) for k, s in enumerate(SEARCHES)))
def search_requests(spark, sf_dir):
    """Several searches with optional conditions, each sort mode, and pages and limits out of bounds."""
    part, out = table(spark, sf_dir, "part"), None
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("combination"), F.col("p_type").alias("group"), (F.col("p_size") > 40).alias("is_scale_40"), F.col("p_retailprice").alias("cutoff"), F.col("p_brand").alias("school"), "p_name", "p_brand", "p_type")
    for k, s in enumerate(SEARCHES):
        one = search_page(rows, s, ["p_name", "p_brand", "p_type"]).select(F.lit(k).alias("request"), "id", "total", "page", "limit", "pages")
        out = one if out is None else out.unionByName(one)
    return out


# The key levels of earlier years' cutoffs, finest first.
LEVELS = [["uac", "mac", "comb", "gender", "honors", "method", "campus"], ["uac", "mac", "comb", "gender", "honors"], ["uac", "mc", "comb"]]
NAMES = ("uac", "mac", "mc", "comb", "gender", "honors", "method", "campus")
YEARS = (1997, 1998, 1999)
_PLACES = {
    "uac": "c_nationkey", "mac": "o_custkey % 40", "mc": "c_mktsegment", "comb": "o_orderpriority",
    "gender": "o_orderstatus", "honors": "o_orderkey % 2", "method": "o_orderkey % 3", "campus": "o_custkey % 4",
}


def _dated(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = [F.expr(f"CAST({e} AS STRING)").alias(n) for n, e in _PLACES.items()]
    return df.select("o_orderkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") / 60000, 0).alias("cutoff"), *named)


def _cascade_sql() -> str:
    named = ", ".join(f"({e})::VARCHAR AS {n}" for n, e in _PLACES.items())
    ctes = [f"d AS (SELECT o_orderkey, year(o_orderdate) AS year, round(o_totalprice / 60000) AS cutoff, {named} FROM orders JOIN customer ON o_custkey = c_custkey)"]
    joins, picks, flags = "", [], []
    for k, keys in enumerate(LEVELS):
        ctes.append(f"l{k} AS (SELECT year, {', '.join(keys)}, count(DISTINCT cutoff) AS n, min(cutoff) AS v FROM d WHERE year BETWEEN {YEARS[0]} AND {YEARS[-1]} GROUP BY ALL)")
        for y in YEARS:
            joins += f" LEFT JOIN l{k} AS l{k}_{y} ON l{k}_{y}.year = {y}" + "".join(f" AND l{k}_{y}.{c} = b.{c}" for c in keys)
    for y in YEARS:
        picks.append("CASE " + " ".join(f"WHEN l{k}_{y}.n IS NOT NULL THEN CASE WHEN l{k}_{y}.n = 1 THEN l{k}_{y}.v END" for k in range(len(LEVELS))) + f" END AS s{y}")
        flags.append("coalesce(CASE " + " ".join(f"WHEN l{k}_{y}.n IS NOT NULL THEN l{k}_{y}.n > 1" for k in range(len(LEVELS))) + " END, false)")
    return f"""WITH {", ".join(ctes)}, w AS (SELECT b.o_orderkey, b.cutoff AS now, {", ".join(picks)}, {" OR ".join(flags)} AS ambiguous FROM d b{joins} WHERE b.year = 2000),
      r AS (SELECT *, list_filter([s1998, s1999, now], lambda x: x IS NOT NULL) AS recent, len(list_filter([s1997, s1998, s1999, now], lambda x: x IS NOT NULL)) AS years_observed,
        CASE WHEN s1999 IS NOT NULL THEN now - s1999 WHEN s1998 IS NOT NULL THEN (now - s1998) / 2 ELSE (now - s1997) / 3 END AS d FROM w)
      SELECT o_orderkey, s1997, s1998, s1999, ambiguous, years_observed, CASE WHEN ambiguous THEN round(now, 2) ELSE round(list_avg(recent), 2) END AS avg_recent,
        CASE WHEN NOT ambiguous AND len(recent) >= 2 THEN round(list_stddev_pop(recent), 2) END AS std_recent,
        CASE WHEN ambiguous OR years_observed < 2 OR d IS NULL THEN 'unknown' WHEN d > 0.5 THEN 'up' WHEN d < -0.5 THEN 'down' ELSE 'stable' END AS trend FROM r"""


@query(_cascade_sql())
def history_by_key_levels(spark, sf_dir):
    """Earlier years' values by the finest key that the year has; several values there yield none."""
    dated = _dated(spark, sf_dir)
    past, base = dated.where(F.col("year").between(YEARS[0], YEARS[-1])), dated.where("year = 2000")
    wide = lookup.cascade(base, past, LEVELS, "cutoff", "year", YEARS, "s")
    return lookup.recent_trend(wide, "cutoff", [f"s{y}" for y in YEARS]).select("o_orderkey", *[f"s{y}" for y in YEARS], "ambiguous", "years_observed", "avg_recent", "std_recent", "trend")


REPORT = "models struct<selected: string, validation: array<struct<name: string, segments: map<string, struct<n_rows: bigint, mae: double, rmse: double, r2: double>>>>>"


@query(f"""WITH {GUESSES}, cubed AS (SELECT *, 'all' AS part FROM long UNION ALL SELECT *, 'known' FROM long WHERE prior_count > 0 UNION ALL SELECT *, 'cold' FROM long WHERE prior_count = 0),
  m AS (SELECT model AS name, part, {METRICS} FROM cubed WHERE split = 'validation' GROUP BY ALL)
  SELECT name, part, n_rows, mae, rmse, r2, name = (SELECT name FROM m WHERE part = 'all' AND coverage = 1 ORDER BY mae, name LIMIT 1) AS selected FROM m""")
def candidate_table(spark, sf_dir):
    """A report of candidates written as one document of maps, read back as a table, a row for each candidate and segment."""
    known = F.explode(F.array(F.lit("all"), F.when(F.col("prior_count") > 0, "known").otherwise("cold"))).alias("part")
    scored = guesses(series(spark, sf_dir)).where("split = 'validation'").select("model", "target", "guess", known)
    metrics = store(scored.groupBy("model", "part").agg(*ops.regression_metrics("target", "guess")), "metrics")
    segments = F.map_from_entries(F.collect_list(F.struct("part", F.struct("n_rows", "mae", "rmse", "r2"))))
    each = metrics.groupBy(F.col("model").alias("name")).agg(segments.alias("segments"))  # a few models
    best = F.min(F.when((F.col("part") == "all") & (F.col("coverage") == 1), F.struct("mae", "model")))["model"]
    report = each.agg(F.collect_list(F.struct("name", "segments")).alias("validation")).crossJoin(metrics.agg(best.alias("selected")))  # one row each
    path = work_dir(spark, "report")
    report.select(F.to_json(F.struct(F.struct("selected", "validation").alias("models"))).alias("value")).write.text(path)
    read = read_json(spark, path, REPORT).select(F.col("models.selected").alias("best"), F.explode("models.validation").alias("c"))
    rows = read.select("best", "c.name", F.explode("c.segments").alias("part", "m"))
    return rows.select("name", "part", "m.n_rows", "m.mae", "m.rmse", "m.r2", (F.col("name") == F.col("best")).alias("selected"))


DEMAND = {"Brand#11": "high", "Brand#22": "low"}


@query("""SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_brand || ')' || ' x(1)', '\\(.*?\\)', '', 'g')) AS bare, regexp_replace(p_brand || p_size, '[^0-9]', '', 'g') AS digits,
  CASE p_brand WHEN 'Brand#11' THEN 'high' WHEN 'Brand#22' THEN 'low' ELSE 'unknown' END AS demand FROM part""")
def stripped_names_and_labels(spark, sf_dir):
    """Names without parentheses, digits alone, and a map's label with a default."""
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"), F.lit(" x(1)"))
    labels = F.create_map(*[F.lit(x) for pair in DEMAND.items() for x in pair])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.trim(F.regexp_replace(name, r"\(.*?\)", "")).alias("bare"),
        F.regexp_replace(F.concat("p_brand", F.col("p_size").cast("string")), "[^0-9]", "").alias("digits"),
        F.coalesce(F.try_element_at(labels, F.col("p_brand")), F.lit("unknown")).alias("demand"),
    )
