"""Served queries: ranking, search, overview, retrieval and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.exprs import clip, scale_quantiles
from ..operators import series as ops
from ..operators.lookup import top_per_group
from ..operators.quantiles import with_quantiles
from .registry import query, table
from .series import KEYS, PRIOR, series

SCORE, COMBO, YEAR = 12.5, "1-URGENT", 2000

RANKED = f"""{PRIOR}, options AS (
  SELECT nation, segment, target AS cutoff, prior_count, prior_std, {SCORE} - target AS gap FROM prior WHERE combo = '{COMBO}' AND year = {YEAR} AND {SCORE} - target >= -3
), pay AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS salary FROM customer GROUP BY 1
), demand AS (SELECT c_mktsegment AS segment, count(*)::DOUBLE AS postings FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
), joined AS (SELECT o.*, salary, postings FROM options o LEFT JOIN pay USING (nation) LEFT JOIN demand USING (segment)
), q AS (SELECT quantile_cont(salary, 0.05) AS s5, quantile_cont(salary, 0.95) AS s95, quantile_cont(postings, 0.05) AS d5, quantile_cont(postings, 0.95) AS d95 FROM joined
), scored AS (
  SELECT nation, segment, cutoff, gap, CASE WHEN gap >= 1 THEN 'safe' WHEN gap >= -1 THEN 'match' ELSE 'reach' END AS bucket,
    100 * (0.40 * greatest(0.05, least(1, (gap + 3) / 4))
      + 0.25 * CASE WHEN s95 <= s5 THEN 0.5 ELSE greatest(0, least(1, (salary - s5) / (s95 - s5))) END
      + 0.20 * CASE WHEN d95 <= d5 THEN 0.5 ELSE greatest(0, least(1, (postings - d5) / (d95 - d5))) END
      + 0.15 * CASE WHEN prior_count >= 2 AND prior_std IS NOT NULL THEN 1 / (1 + prior_std) ELSE 0.5 END) AS score
  FROM joined, q
)"""


def recommend(options: DataFrame, user_score: float) -> DataFrame:
    """Score options (cutoff, prior_count, prior_std, salary, postings) for one candidate.

    The quantiles are one row over the filtered candidates, so a score is relative to the request.
    """
    df = options.withColumn("gap", F.lit(user_score) - F.col("cutoff")).where("gap >= -3")
    df = with_quantiles(df, [], ["salary", "postings"], [0.05, 0.95])
    fit = clip((F.col("gap") + 3) / 4, 0.05, 1.0)
    pay = scale_quantiles(F.col("salary"), F.col("q_salary")[0], F.col("q_salary")[1])
    need = scale_quantiles(F.col("postings"), F.col("q_postings")[0], F.col("q_postings")[1])
    stable = F.when((F.col("prior_count") >= 2) & F.col("prior_std").isNotNull(), 1 / (1 + F.col("prior_std"))).otherwise(0.5)
    bucket = F.when(F.col("gap") >= 1, "safe").when(F.col("gap") >= -1, "match").otherwise("reach")
    return df.select("nation", "segment", "cutoff", "gap", bucket.alias("bucket"), (100 * (0.40 * fit + 0.25 * pay + 0.20 * need + 0.15 * stable)).alias("score"))


def _scored(spark, sf_dir):
    # Windows run over the combination's series alone: the filter on combo reaches the scan.
    df = ops.prior_stats(series(spark, sf_dir).where(F.col("combo") == COMBO), KEYS).where(F.col("year") == YEAR)
    customer = table(spark, sf_dir, "customer")
    pay = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("salary"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    demand = orders.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).cast("double").alias("postings"))
    options = df.join(pay, "nation", "left").join(demand, "segment", "left").withColumnRenamed("target", "cutoff")
    return recommend(options, SCORE)


@query(f"""WITH {RANKED} SELECT bucket, nation, segment, round(cutoff, 4) AS cutoff, round(gap, 4) AS gap, round(score, 4) AS score,
  row_number() OVER (PARTITION BY bucket ORDER BY round(score, 4) DESC, nation, segment)::INT AS rank FROM scored QUALIFY rank <= 15""")
def recommend_top15_by_bucket(spark, sf_dir):
    df = _scored(spark, sf_dir).select("bucket", "nation", "segment", F.round("cutoff", 4).alias("cutoff"), F.round("gap", 4).alias("gap"), F.round("score", 4).alias("score"))
    return top_per_group(df, ["bucket"], [F.desc("score"), F.col("nation"), F.col("segment")], 15)


@query(f"WITH {RANKED} SELECT nation, segment, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, nation, segment LIMIT 5")
def top5_ranking(spark, sf_dir):
    return _scored(spark, sf_dir).select("nation", "segment", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "nation", "segment").limit(5)


@query("""WITH hits AS (SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part
    WHERE (contains(p_name || ' ' || p_brand || ' ' || p_type, 'steel') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'steel')) AND contains(p_brand, '#') AND p_size > 5)
  SELECT *, (SELECT count(*) FROM hits) AS total, greatest(1, ceil((SELECT count(*) FROM hits) / 20.0))::INT AS pages FROM hits ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def search_facets_page(spark, sf_dir):
    """Facets, folded search, sort and the second page of twenty."""
    hay = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    hits = table(spark, sf_dir, "part").where((hay.contains("steel") | fn.fold(hay).contains("steel")) & F.col("p_brand").contains("#") & (F.col("p_size") > 5))
    hits = hits.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(20).crossJoin(F.broadcast(total))
    return page.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 20)).cast("int"))


@query("SELECT count(*) AS n_rows, count(DISTINCT trim(c_name)) AS n_names, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer")
def overview_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.trim("c_name")).alias("n_names"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("SELECT p_partkey, p_brand || '[' AS label FROM part WHERE contains(lower(p_brand || '['), lower('#1[')) OR contains(lower(p_brand || '['), '2[') ORDER BY p_partkey LIMIT 50")
def major_search_literal(spark, sf_dir):
    """A search text with a sign that patterns would read differently."""
    label = F.concat("p_brand", F.lit("["))
    df = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return df.where(F.lower("label").contains("#1[") | F.lower("label").contains("2[")).orderBy("p_partkey").limit(50)


@query("""WITH nat AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
  SELECT user_id, e.event_type, round(avg(e.value) - coalesce(any_value(mean), 6.5), 4) AS attribution FROM events e LEFT JOIN nat USING (event_type) GROUP BY ALL""")
def attribution_vs_mean(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    nation = events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    own = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("own"))
    return own.join(nation, "event_type", "left").select("user_id", "event_type", F.round(F.col("own") - F.coalesce("mean", F.lit(6.5)), 4).alias("attribution"))


@query("""SELECT p_type AS sector, count(*) AS postings, round(avg(p_retailprice), 4) AS salary FROM part GROUP BY 1 ORDER BY postings DESC, sector LIMIT 6""")
def career_insights(spark, sf_dir):
    df = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sector")).agg(F.count(F.lit(1)).alias("postings"), F.round(F.avg("p_retailprice"), 4).alias("salary"))
    return df.orderBy(F.desc("postings"), "sector").limit(6)


def _relevance(df, hay, words):
    n = F.lit(0)
    for w in words:
        n = n + F.when(hay.contains(w), 1).otherwise(0)
    return df.withColumn("hits", n.cast("bigint")).where("hits > 0")


ASKED = ["steel", "navy", "rose"]
HITS = " + ".join(f"CASE WHEN contains(lower(p_name), '{w}') THEN 1 ELSE 0 END" for w in ASKED)


@query(f"SELECT p_partkey, ({HITS})::BIGINT AS hits, round(abs(p_retailprice - 1000), 4) AS gap FROM part WHERE ({HITS}) > 0 ORDER BY hits DESC, gap, p_partkey LIMIT 8")
def retrieval_admissions(spark, sf_dir):
    df = _relevance(table(spark, sf_dir, "part"), fn.fold(F.col("p_name")), ASKED)
    return df.select("p_partkey", "hits", F.round(F.abs(F.col("p_retailprice") - 1000), 4).alias("gap")).orderBy(F.desc("hits"), "gap", "p_partkey").limit(8)


@query(f"WITH c AS (SELECT p_name, count(*) AS postings FROM part GROUP BY 1) SELECT p_name, ({HITS})::BIGINT AS hits, postings FROM c WHERE ({HITS}) > 0 ORDER BY hits DESC, postings DESC, p_name LIMIT 5")
def retrieval_jobs(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("postings"))
    return _relevance(counts, fn.fold(F.col("p_name")), ASKED).select("p_name", "hits", "postings").orderBy(F.desc("hits"), F.desc("postings"), "p_name").limit(5)


@query("""SELECT o_custkey, o_orderkey, 'kept' AS origin FROM orders WHERE o_orderkey % 4 = 0 UNION ALL
  SELECT o_custkey, o_orderkey, 'new' FROM orders n WHERE o_orderkey % 6 = 0 AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderkey % 4 = 0 AND k.o_orderkey = n.o_orderkey AND k.o_custkey = n.o_custkey)""")
def wishlist_upsert_antijoin(spark, sf_dir):
    """Insert what isn't there yet; conflicts do nothing."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    kept, new = orders.where("o_orderkey % 4 = 0"), orders.where("o_orderkey % 6 = 0")
    return kept.withColumn("origin", F.lit("kept")).unionByName(new.join(kept, ["o_custkey", "o_orderkey"], "left_anti").withColumn("origin", F.lit("new")))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderdate, o_orderkey)::INT AS position FROM orders WHERE o_custkey = 7 AND o_orderkey % 5 <> 0""")
def wishlist_list_delete(spark, sf_dir):
    """One owner's list after a delete, in its order."""
    mine = table(spark, sf_dir, "orders").where("o_custkey = 7 and o_orderkey % 5 <> 0")
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderdate", "o_orderkey"))
    return mine.select("o_orderkey", position.alias("position"))
