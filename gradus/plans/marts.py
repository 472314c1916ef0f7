"""Derived columns, group summaries, mappings and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import catalogue as catalogues
from ..operators import lookup as ops
from ..operators.quantiles import with_quantiles
from .registry import query, table
from .series import EXAMS


@query("""SELECT o_orderkey, nullif(trim(o_orderpriority), '') AS priority, NULL::VARCHAR AS missing_alias,
  CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 40 WHEN 'P' THEN 1200 END AS scale,
  CASE o_orderstatus WHEN 'F' THEN round(o_totalprice / 20001, 2) WHEN 'O' THEN round(o_totalprice / 20001 * 0.75, 2) END AS score_30,
  CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1.5 END, 2.0)::DOUBLE END AS factor FROM orders""")
def canonical_alias_projection(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    alias = lambda *names: next((F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns), F.lit(None).cast("string"))
    status, price = F.col("o_orderstatus"), F.col("o_totalprice") / 20001
    return df.select(
        "o_orderkey",
        alias("priority", "o_orderpriority").alias("priority"),
        alias("nowhere", "absent").alias("missing_alias"),
        F.when(status == "F", 30).when(status == "O", 40).when(status == "P", 1200).alias("scale"),
        F.when(status == "F", F.round(price, 2)).when(status == "O", F.round(price * 0.75, 2)).alias("score_30"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, 1.5), F.lit(2.0))).alias("factor"),
    )


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity - 10, -1) AS a, nullif(CASE WHEN l_discount > 0.08 THEN -1 ELSE l_discount END, -1) AS b, l_tax AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, a, b, round(a + b + c, 4) AS total, round(coalesce(a + b + c, -1), 4) AS guarded FROM s""")
def sentinel_and_n_of_n_sum(spark, sf_dir):
    b = F.nullif(F.when(F.col("l_discount") > 0.08, -1.0).otherwise(F.col("l_discount")), F.lit(-1.0))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif(F.col("l_quantity") - 10, F.lit(-1.0)).alias("a"), b.alias("b"), F.col("l_tax").alias("c"))
    total = exprs.sum_all_or_null(F.col("a"), F.col("b"), F.col("c"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "a", "b", F.round(total, 4).alias("total"), F.round(F.coalesce(total, F.lit(-1.0)), 4).alias("guarded"))


@query("SELECT user_id % 10 AS province, year(ts)::INT AS year, event_type, count(value) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def exam_summary_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("province"), F.year("ts").alias("year"), "event_type")
    return df.agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"""WITH {EXAMS} SELECT province::VARCHAR AS place, year, subject, n, mean FROM exams
  UNION ALL SELECT 'NATIONAL', year, subject, sum(n)::BIGINT, round(sum(mean * n) / sum(n), 4) FROM exams GROUP BY year, subject""")
def national_weighted_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("string").alias("place"), F.year("ts").alias("year"), F.col("event_type").alias("subject"))
    local = df.agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    nation = local.groupBy("year", "subject").agg(F.sum("n").alias("n"), F.round(mean, 4).alias("mean")).withColumn("place", F.lit("NATIONAL"))
    return local.unionByName(nation)


@query("""SELECT p_type AS category, count(*) AS posting_count, count(CASE WHEN p_size > 10 THEN p_retailprice END) AS salary_count, round(avg(CASE WHEN p_size > 10 THEN p_retailprice END), 4) AS mean_salary,
  round(median(CASE WHEN p_size > 10 THEN p_retailprice END), 4) AS median_salary, sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END)::BIGINT AS needing_review,
  CASE WHEN count(*) >= 340 THEN 'very high' WHEN count(*) >= 330 THEN 'high' WHEN count(*) >= 320 THEN 'medium' ELSE 'low' END AS demand FROM part GROUP BY 1""")
def job_market_summary(spark, sf_dir):
    pay = F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("pay")
    postings = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), pay, "p_size")
    df = postings.groupBy("category").agg(
        F.count(F.lit(1)).alias("posting_count"),
        F.count("pay").alias("salary_count"),
        F.round(F.avg("pay"), 4).alias("mean_salary"),
        F.count_if(F.col("p_size") > 40).alias("needing_review"),
    )
    df = with_quantiles(df, ["category"], ["pay"], [0.5], postings).withColumn("median_salary", F.round(F.col("q_pay")[0], 4)).drop("q_pay")
    return df.withColumn("demand", exprs.label_by_thresholds(F.col("posting_count"), [(340, "very high"), (330, "high"), (320, "medium")], "low", "unknown"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 1.0 END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 1.5 - p_partkey % 9 END AS hi FROM part)
  SELECT p_partkey, lo > hi AS inverted, (lo IS NULL AND hi IS NULL) AS negotiable, (lo > hi) OR (lo IS NULL) AS needs_review,
    CASE WHEN lo <= hi THEN round((lo + hi) / 2, 4) END AS average, greatest(5.0, coalesce(CASE WHEN lo <= hi THEN (lo + hi) / 2 END, 15.0)) AS filled FROM s""")
def salary_flags(spark, sf_dir):
    low = F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 1.0)
    high = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 1.5 - F.col("p_partkey") % 9)
    df = table(spark, sf_dir, "part").select("p_partkey", low.alias("lo"), high.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    mean = F.when(lo <= hi, (lo + hi) / 2)
    return df.select(
        "p_partkey",
        (lo > hi).alias("inverted"),
        (lo.isNull() & hi.isNull()).alias("negotiable"),
        ((lo > hi) | lo.isNull()).alias("needs_review"),
        F.round(mean, 4).alias("average"),
        F.greatest(F.lit(5.0), F.coalesce(mean, F.lit(15.0))).alias("filled"),
    )


WORDS = "unnest(string_split(p_name, ' '))"


@query(f"""WITH w AS (SELECT p_type, {WORDS} AS word FROM part), c AS (SELECT p_type, word, count(*) AS n FROM w GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, word) AS rank FROM c)
  SELECT p_type, upper(word[1]) || lower(word[2:]) AS skill, n, rank FROM r WHERE rank <= 5""")
def skills_topk_per_category(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("word"))
    counts = words.groupBy("p_type", "word").agg(F.count(F.lit(1)).alias("n"))
    top = ops.top_per_group(counts, ["p_type"], [F.desc("n"), F.col("word")], 5)
    skill = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.expr("substring(word, 2)")))
    return top.select("p_type", skill.alias("skill"), "n", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH w AS (SELECT DISTINCT p_brand, {WORDS} AS word FROM part) SELECT word, count(*) AS n_groups, min(p_brand) AS first_group FROM w GROUP BY word ORDER BY n_groups DESC, word LIMIT 8""")
def skill_frequency_across_groups(spark, sf_dir):
    each = table(spark, sf_dir, "part").select("p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).distinct()
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n_groups"), F.min("p_brand").alias("first_group")).orderBy(F.desc("n_groups"), "word").limit(8)


@query("""WITH pairs AS (SELECT DISTINCT p_name, p_brand, p_type FROM part),
  by_pair AS (SELECT p_name, p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS v, count(DISTINCT p_type) > 1 AS conflict FROM pairs GROUP BY ALL),
  by_name AS (SELECT p_name, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS v, count(DISTINCT p_type) > 1 AS conflict FROM (SELECT * FROM pairs WHERE p_brand < 'Brand#2') GROUP BY ALL)
  SELECT p_partkey, CASE WHEN a.conflict OR coalesce(b.conflict, false) THEN 'conflict' WHEN a.v IS NOT NULL THEN a.v WHEN b.v IS NOT NULL THEN b.v ELSE 'other' END AS category,
    CASE WHEN a.conflict OR coalesce(b.conflict, false) THEN 'ambiguous' WHEN a.v IS NOT NULL THEN 'pair' WHEN b.v IS NOT NULL THEN 'name' ELSE 'none' END AS basis
  FROM part JOIN by_pair a USING (p_name, p_brand) LEFT JOIN by_name b USING (p_name)""")
def conflict_safe_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pair = ops.conflict_safe(part, ["p_name", "p_brand"], "p_type", "by_pair")
    name = ops.conflict_safe(part.where("p_brand < 'Brand#2'"), ["p_name"], "p_type", "by_name")
    df = part.join(pair, ["p_name", "p_brand"], "left").join(name, "p_name", "left")
    clash = F.coalesce("by_pair_conflict", F.lit(False)) | F.coalesce("by_name_conflict", F.lit(False))
    category = F.when(clash, "conflict").otherwise(F.coalesce("by_pair", "by_name", F.lit("other")))
    basis = F.when(clash, "ambiguous").when(F.col("by_pair").isNotNull(), "pair").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return df.select("p_partkey", category.alias("category"), basis.alias("basis"))


HISTORY_SQL = """h AS (SELECT c_nationkey, c_mktsegment, year(o_orderdate)::INT AS year, o_orderpriority, round(avg(o_totalprice) / 19997, 4) AS v, count(DISTINCT o_orderstatus) > 2 AS unclear
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1997 AND 2000 GROUP BY ALL)"""
TREND_SQL = """CASE WHEN v2000 IS NULL OR coalesce(v1999, v1998, v1997) IS NULL THEN 'unknown' WHEN d > 0.5 THEN 'up' WHEN d < -0.5 THEN 'down' ELSE 'stable' END"""


def _years_sql():
    out = []
    for y in (1997, 1998, 1999):
        out.append(f"""max(CASE WHEN x.year = {y} THEN x.v END) AS v{y}""")
    return ", ".join(out)


@query(f"""WITH {HISTORY_SQL}, base AS (SELECT c_nationkey, c_mktsegment, o_orderpriority, v AS v2000 FROM h WHERE year = 2000),
  lv AS (SELECT b.*, {_years_sql()}, coalesce(bool_or(x.unclear), false) AS unclear FROM base b LEFT JOIN (
      SELECT c_nationkey, c_mktsegment, o_orderpriority, year, CASE WHEN unclear THEN NULL ELSE v END AS v, unclear FROM h WHERE year < 2000) x
    ON x.c_nationkey = b.c_nationkey AND x.c_mktsegment = b.c_mktsegment AND x.o_orderpriority = b.o_orderpriority
    GROUP BY b.c_nationkey, b.c_mktsegment, b.o_orderpriority, b.v2000),
  t AS (SELECT *, CASE WHEN v1999 IS NOT NULL THEN v2000 - v1999 WHEN v1998 IS NOT NULL THEN (v2000 - v1998) / 2 ELSE (v2000 - v1997) / 3 END AS d,
    list_filter([v1998, v1999, v2000], lambda x: x IS NOT NULL) AS seen FROM lv)
  SELECT c_nationkey, c_mktsegment, o_orderpriority, v1997, v1998, v1999, v2000, unclear, {TREND_SQL} AS trend, len(seen) AS n_recent,
    round(list_avg(seen), 3) AS mean_recent FROM t""")
def cascade_history_lookup(spark, sf_dir):
    """Values of earlier years by key; an unclear year counts as found but yields no value."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    keys = ["c_nationkey", "c_mktsegment", "o_orderpriority"]
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate")).where("year between 1997 and 2000")
    each = df.groupBy(*keys, "year").agg(F.round(F.avg("o_totalprice") / 19997, 4).alias("v"), (F.count_distinct("o_orderstatus") > 2).alias("unclear"))
    clear = F.when(~F.col("unclear") | (F.col("year") == 2000), F.col("v"))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("year") == y, clear)).alias(f"v{y}") for y in range(1997, 2001)], F.max(F.col("unclear") & (F.col("year") < 2000)).alias("unclear"))
    wide = wide.where("v2000 is not null")
    now, a, b, c = (F.col(f"v{y}") for y in (2000, 1999, 1998, 1997))
    slope = F.when(a.isNotNull(), now - a).when(b.isNotNull(), (now - b) / 2).otherwise((now - c) / 3)
    trend = F.when(F.coalesce(a, b, c).isNull(), "unknown").when(slope > 0.5, "up").when(slope < -0.5, "down").otherwise("stable")
    seen = F.filter(F.array(b, a, now), lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen)
    return wide.select(*keys, "v1997", "v1998", "v1999", "v2000", "unclear", trend.alias("trend"), F.size(seen).cast("bigint").alias("n_recent"), F.round(mean, 3).alias("mean_recent"))


RULES = [("metal", "steel|tin|copper|brass"), ("dark", "black|navy|midnight"), ("warm", "red|orange|rose|gold"), ("any_an", "an")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'other' END AS rule FROM part")
def regex_rule_mapping(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ops.rule_chain(RULES, F.lower(F.concat_ws(" ", "p_name", "p_type")), "other").alias("rule"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 10 = 0 THEN 'MANUAL' END, CASE WHEN contains(n_name, '1') THEN 'NAME RULE' END, r_name, 'DEFAULT') AS region
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey""")
def region_cascade(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    df = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return df.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 10 == 0, "MANUAL"), F.when(F.col("n_name").contains("1"), "NAME RULE"), "r_name", F.lit("DEFAULT")).alias("region"))


@query("""WITH cat AS (SELECT p_name, p_brand, p_type, count(*) AS n_records, min(p_size) AS least_size, max(p_size) AS most_size FROM part GROUP BY ALL)
  SELECT * FROM cat ANTI JOIN (SELECT DISTINCT p_name FROM part WHERE p_size > 45) m USING (p_name)""")
def catalog_and_unmapped(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    catalog = part.groupBy("p_name", "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n_records"), F.min("p_size").alias("least_size"), F.max("p_size").alias("most_size"))
    return catalog.join(part.where("p_size > 45").select("p_name").distinct(), "p_name", "left_anti")


@query("""SELECT * FROM (SELECT c.c_custkey, c.c_name, n.n_name, coalesce(n.n_name, 'no nation') AS shown, upper(c.c_name[1]) AS initial FROM customer c
  LEFT JOIN (SELECT n_nationkey, min(n_name) AS n_name FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1) n ON c_nationkey = n_nationkey)""")
def feature_store_join_fallback(spark, sf_dir):
    """First-wins dimension, broadcast by its size, with a fallback."""
    dim = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").groupBy("n_nationkey").agg(ops.first_by("n_name", "n_nationkey").alias("n_name"))
    df = table(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.select("c_custkey", "c_name", "n_name", F.coalesce("n_name", F.lit("no nation")).alias("shown"), F.upper(F.substring("c_name", 1, 1)).alias("initial"))


WORDS_OF = [(["red", "gold"], "WARM"), (["blue", "navy"], "COLD")]
_CODE = "lpad((p_partkey * 7919 % 10000000)::VARCHAR, 7, '0')"
_ASKED = f"""CASE p_partkey % 5 WHEN 0 THEN 'C-' || {_CODE} WHEN 1 THEN {_CODE}[1:4] || '999x' WHEN 2 THEN {_CODE}[1:2] WHEN 3 THEN NULL ELSE '9' || {_CODE} END"""
_NAME = "CASE WHEN p_partkey % 211 = 3 THEN '(' || p_brand || ')' ELSE ' ' || p_name || ' ' || p_type || ' (' || p_brand || ')' END"
_ENTRY = "CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || ' ' || p_type WHEN 1 THEN p_name || ' ' || p_type || ' Premium' ELSE '' END"


@query(f"""WITH cat AS (SELECT p_partkey AS ordinal, {_CODE} AS code, lower({_ENTRY}) AS entry_name, p_brand AS "group" FROM part WHERE p_partkey % 41 = 7),
  q AS (SELECT DISTINCT regexp_replace(coalesce({_ASKED}, ''), '[^0-9]', '', 'g') AS code, lower(trim(regexp_replace({_NAME}, '\\(.*?\\)', '', 'g'))) AS name FROM part),
  f AS (SELECT q.*, (SELECT max(ordinal) FROM cat WHERE cat.code = q.code) AS of_code,
      (SELECT min(ordinal) FROM cat WHERE entry_name <> '' AND (contains(q.name, entry_name) OR contains(entry_name, q.name))) AS of_name,
      (SELECT min(ordinal) FROM cat WHERE q.code <> '' AND starts_with(cat.code, CASE WHEN length(q.code) >= 4 THEN q.code[1:4] ELSE q.code[1:3] END)) AS of_prefix FROM q),
  e AS (SELECT *, coalesce(of_code, of_name, of_prefix) AS entry FROM f)
  SELECT e.code, e.name, e.entry, CASE WHEN e.entry IS NOT NULL THEN cat."group" WHEN contains(e.name, 'red') OR contains(e.name, 'gold') THEN 'WARM' WHEN contains(e.name, 'blue') OR contains(e.name, 'navy') THEN 'COLD' ELSE 'DEFAULT' END AS "group",
    CASE WHEN of_code IS NOT NULL THEN 'code' WHEN of_name IS NOT NULL THEN 'name' WHEN of_prefix IS NOT NULL THEN 'prefix' WHEN regexp_matches(e.name, 'red|gold|blue|navy') THEN 'keyword' ELSE 'default' END AS basis
  FROM e LEFT JOIN cat ON cat.ordinal = e.entry""")
def ordered_catalogue_lookup(spark, sf_dir):
    """Code, names that hold one another either way (first entry), code prefix, keyword, default.

    Most of what is asked for isn't in the catalogue, which holds one part in 41.
    """
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    digits = F.lpad((F.col("p_partkey") * 7919 % 10000000).cast("string"), 7, "0")
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(words[1], F.lit(" "), "p_type")).when(kind == 1, F.concat("p_name", F.lit(" "), "p_type", F.lit(" Premium"))).otherwise("")
    catalogue = part.where("p_partkey % 41 = 7").select(F.col("p_partkey").alias("ordinal"), digits.alias("code"), name.alias("name"), F.col("p_brand").alias("group"))
    how = F.col("p_partkey") % 5
    code = F.when(how == 0, F.concat(F.lit("C-"), digits)).when(how == 1, F.concat(F.substring(digits, 1, 4), F.lit("999x"))).when(how == 2, F.substring(digits, 1, 2)).when(how == 4, F.concat(F.lit("9"), digits))
    brand = F.concat(F.lit("("), "p_brand", F.lit(")"))
    asked = F.when(F.col("p_partkey") % 211 == 3, brand).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type", F.lit(" "), brand))
    return catalogues.ordered_lookup(part.select(code.alias("code"), asked.alias("name")), catalogue, WORDS_OF, "DEFAULT")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'N/A' WHEN event_id % 4 = 1 THEN (event_id % 9)::VARCHAR || ' years' WHEN event_id % 4 = 2 THEN (event_id % 30)::VARCHAR || ' months' ELSE 'None' END AS txt,
  CASE WHEN event_id % 4 = 1 THEN (event_id % 9) * 12 WHEN event_id % 4 = 2 THEN event_id % 30 WHEN event_id % 4 = 3 THEN 0 END::INT AS months FROM events""")
def text_to_months(spark, sf_dir):
    i = F.col("event_id")
    txt = F.when(i % 4 == 0, "N/A").when(i % 4 == 1, F.concat((i % 9).cast("string"), F.lit(" years"))).when(i % 4 == 2, F.concat((i % 30).cast("string"), F.lit(" months"))).otherwise("None")
    return table(spark, sf_dir, "events").select("event_id", txt.alias("txt"), exprs.months(txt).alias("months"))


@query("""SELECT o_orderkey, coalesce(contains(o_orderpriority, '4'), false) OR coalesce(o_totalprice / 10000 > 30.5, false) AS is_40,
  CASE WHEN starts_with(o_orderkey::VARCHAR, '73') THEN 'LAW' ELSE o_orderpriority END AS grp FROM orders""")
def scale_flags_and_overrides(spark, sf_dir):
    no = lambda c: F.coalesce(c, F.lit(False))
    flag = no(F.col("o_orderpriority").contains("4")) | no(F.col("o_totalprice") / 10000 > 30.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", flag.alias("is_40"), F.when(F.col("o_orderkey").cast("string").startswith("73"), "LAW").otherwise(F.col("o_orderpriority")).alias("grp"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 2) AS even, regexp_replace(regexp_replace((l_discount * 10)::DECIMAL(9,4)::VARCHAR, '0+$', ''), '\\.$', '') AS txt FROM lineitem""")
def half_even_and_decimal_text(spark, sf_dir):
    txt = F.regexp_replace(F.regexp_replace((F.col("l_discount") * 10).cast("decimal(9,4)").cast("string"), "0+$", ""), r"\.$", "")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 8, 2).alias("even"), txt.alias("txt"))


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def ordinal_head_and_stable_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(50)


@query("SELECT * FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 8000")
def deterministic_sample(spark, sf_dir):
    """The first rows by a hash of their key: the same ones in every run."""
    df = table(spark, sf_dir, "orders")
    return df.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(8000)


@query("""WITH old AS (SELECT s_suppkey, s_name, s_suppkey % 4 AS rank FROM supplier WHERE s_suppkey % 3 <> 0),
  new AS (SELECT s_suppkey, s_name || '+' AS s_name, s_suppkey % 5 AS rank FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL OR (n.s_suppkey IS NOT NULL AND n.rank >= o.rank) THEN n.s_name ELSE o.s_name END AS s_name
  FROM old o FULL JOIN new n ON o.s_suppkey = n.s_suppkey""")
def refresh_merge_quality(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select("s_suppkey", F.col("s_name").alias("o_name"), (F.col("s_suppkey") % 4).alias("o_rank"))
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit("+")).alias("n_name"), (F.col("s_suppkey") % 5).alias("n_rank"))
    better = F.col("o_name").isNull() | F.coalesce(F.col("n_rank") >= F.col("o_rank"), F.lit(False))
    return old.join(new, "s_suppkey", "full").select("s_suppkey", F.when(better, F.col("n_name")).otherwise(F.col("o_name")).alias("s_name"))
