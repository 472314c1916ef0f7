"""Row gates and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import round_binary
from ..operators import gates as ops
from ..operators.quantiles import with_quantiles
from ..operators.series import lag_features, null_safe, store_rows
from .registry import query, table
from .series import KEYS, LAGGED, series

REASONS = """rejects AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([
    CASE WHEN l_quantity > 45 THEN 'quantity_high' END, CASE WHEN l_discount = 0 THEN 'no_discount' END,
    CASE WHEN l_tax > 0.07 THEN 'tax_high' END, CASE WHEN NOT l_returnflag IN ('A', 'N', 'R') THEN 'flag' END,
    CASE WHEN l_extendedprice NOT BETWEEN 0 AND 90000 THEN 'price_range' END], lambda x: x IS NOT NULL) AS held FROM lineitem)"""


def _rejects(spark, sf_dir):
    masks = {
        "quantity_high": F.col("l_quantity") > 45,
        "no_discount": F.col("l_discount") == 0,
        "tax_high": F.col("l_tax") > 0.07,
        "flag": ~F.col("l_returnflag").isin("A", "N", "R"),
        "price_range": ~F.col("l_extendedprice").between(0, 90000),
    }
    return table(spark, sf_dir, "lineitem").withColumn("reason", ops.reasons(masks))


@query(f"WITH {REASONS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(held, '|') AS reason FROM rejects WHERE len(held) > 0")
def reject_reasons(spark, sf_dir):
    return _rejects(spark, sf_dir).where("reason is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


@query(f"WITH {REASONS} SELECT CASE WHEN len(held) > 0 THEN 'rejected' ELSE 'accepted' END AS part, nullif(array_to_string(held, '|'), '') AS reason, count(*) AS n FROM rejects GROUP BY ALL")
def reject_split_counts(spark, sf_dir):
    df = _rejects(spark, sf_dir)
    return df.groupBy(F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("part"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(held) AS reason FROM rejects) GROUP BY reason")
def reason_counter(spark, sf_dir):
    each = _rejects(spark, sf_dir).where("reason is not null").select(F.explode(F.split("reason", r"\|")).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


MODEL_KEYS = """keyed AS (SELECT year(o_orderdate)::INT AS year, o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders)"""


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


@query(f"""WITH {MODEL_KEYS} SELECT year, o_custkey, o_orderpriority, count(*) AS n_rows, count(DISTINCT o_totalprice) AS n_targets FROM keyed
  GROUP BY ALL HAVING count(DISTINCT o_totalprice) > 1""")
def ambiguous_keys(spark, sf_dir):
    df = _keyed(spark, sf_dir).groupBy("year", "o_custkey", "o_orderpriority")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_totalprice").alias("n_targets")).where("n_targets > 1")


@query("""WITH keyed AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, count(*) OVER w AS n, min(l_returnflag) OVER w = max(l_returnflag) OVER w AS same
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
  SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, count(*) AS source_row_count,
    string_agg(DISTINCT l_partkey::VARCHAR, ';' ORDER BY l_partkey::VARCHAR) AS source_parts FROM keyed WHERE same GROUP BY l_orderkey, l_linenumber""")
def collapse_same_target(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    grouped = df.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.max("l_returnflag").alias("most"), F.count(F.lit(1)).alias("source_row_count"), ops.distinct_join("part").alias("source_parts"))
    return grouped.where("l_returnflag = most").drop("most")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT DISTINCT * FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1""")
def row_dedup_first_wins(spark, sf_dir):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    df = ops.first_wins(table(spark, sf_dir, "lineitem").dropDuplicates(), ["l_orderkey", "l_linenumber"], order)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def duplicate_members(spark, sf_dir):
    return ops.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


RAW_ROWS = """raw AS (SELECT event_id, lpad(user_id::VARCHAR, 8, '0') AS sbd, lpad((user_id % 64)::VARCHAR, 2, '0') AS province,
  round(value / 10, 2) AS math, round((event_id % 101) / 10, 1) AS physics, round((user_id % 11) * 1.0, 1) AS chemistry,
  CASE WHEN event_id % 7 = 0 THEN 'N' || (event_id % 9)::VARCHAR END AS language_code, CASE WHEN event_id % 5 = 0 THEN 8.0 END AS language,
  CASE WHEN event_id % 3 = 0 THEN round(value / 10, 2) + round((event_id % 101) / 10, 1) + round((user_id % 11) * 1.0, 1) ELSE 15.0 END AS total FROM events)"""


def _raw(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    math, physics, chemistry = round_binary(F.col("value") / 10, 2), round_binary((F.col("event_id") % 101) / 10, 1), (F.col("user_id") % 11) * 1.0
    return e.select(
        "event_id",
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("sbd"),
        F.lpad((F.col("user_id") % 64).cast("string"), 2, "0").alias("province"),
        math.alias("math"),
        physics.alias("physics"),
        chemistry.alias("chemistry"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("N"), (F.col("event_id") % 9).cast("string"))).alias("language_code"),
        F.when(F.col("event_id") % 5 == 0, F.lit(8.0)).alias("language"),
        F.when(F.col("event_id") % 3 == 0, math + physics + chemistry).otherwise(15.0).alias("total"),
    )


@query(f"""WITH {RAW_ROWS} SELECT event_id, array_to_string(list_filter([
    CASE WHEN NOT regexp_full_match(sbd, '[0-9]{{8}}') THEN 'sbd:format' END,
    CASE WHEN substr(sbd, 7, 2) <> province THEN 'province:mismatch' END,
    CASE WHEN NOT math BETWEEN 0 AND 10 THEN 'math:outside_0_10' END,
    CASE WHEN NOT physics BETWEEN 0 AND 10 THEN 'physics:outside_0_10' END,
    CASE WHEN NOT total BETWEEN 0 AND 30 THEN 'total:outside_0_30' END,
    CASE WHEN language_code IS NOT NULL AND NOT regexp_full_match(language_code, 'N[1-7]') THEN 'language:code' END,
    CASE WHEN (language_code IS NULL) <> (language IS NULL) THEN 'language:pair' END,
    CASE WHEN abs(total::DECIMAL(9,4) - (math::DECIMAL(9,4) + physics::DECIMAL(9,4) + chemistry::DECIMAL(9,4))) > 0.01 THEN 'total:formula' END],
    lambda x: x IS NOT NULL), ';') AS codes FROM raw""")
def row_validator_codes(spark, sf_dir):
    dec = lambda c: F.col(c).cast("decimal(9,4)")
    codes = {
        "sbd:format": ~F.col("sbd").rlike("^[0-9]{8}$"),
        "province:mismatch": F.substring("sbd", 7, 2) != F.col("province"),
        "math:outside_0_10": ~F.col("math").between(0, 10),
        "physics:outside_0_10": ~F.col("physics").between(0, 10),
        "total:outside_0_30": ~F.col("total").between(0, 30),
        "language:code": F.col("language_code").isNotNull() & ~F.col("language_code").rlike("^N[1-7]$"),
        "language:pair": F.col("language_code").isNull() != F.col("language").isNull(),
        "total:formula": F.abs(dec("total") - (dec("math") + dec("physics") + dec("chemistry"))) > F.lit("0.01").cast("decimal(9,4)"),
    }
    text = F.coalesce(F.replace(ops.reasons(codes), F.lit("|"), F.lit(";")), F.lit(""))
    return _raw(spark, sf_dir).select("event_id", text.alias("codes"))


@query("""SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE try_cast(txt AS DOUBLE) IS NULL AND txt <> '') AS bad FROM (
  SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'x' || event_id::VARCHAR WHEN event_id % 13 = 0 THEN '' ELSE user_id::VARCHAR END AS txt FROM events) GROUP BY 1""")
def strict_parse_violations(spark, sf_dir):
    txt = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(F.col("event_id") % 13 == 0, "").otherwise(F.col("user_id").cast("string"))
    df = table(spark, sf_dir, "events").withColumn("txt", txt)
    bad = ops.violations(df, "txt", "double").groupBy("event_type").agg(F.count(F.lit(1)).alias("bad"))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows")).join(bad, "event_type", "left").select("event_type", "n_rows", F.coalesce("bad", F.lit(0)).alias("bad"))


@query("""SELECT CASE WHEN bad = 0 AND repeated = 0 THEN n_rows ELSE 0 END AS rows_to_write, bad, repeated FROM (
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_quantity <= 0) AS bad,
    (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated FROM lineitem)""")
def all_or_nothing_gate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_quantity") <= 0).alias("bad"))
    repeated = df.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    both = total.crossJoin(repeated)  # one row each
    return both.select(F.when((F.col("bad") == 0) & (F.col("repeated") == 0), F.col("n_rows")).otherwise(F.lit(0)).alias("rows_to_write"), "bad", "repeated")


@query("""WITH marked AS (SELECT *, coalesce(trim(c_name), '') = '' AS blank, c_acctbal < 0 AS malformed FROM customer),
  good AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nth FROM marked WHERE NOT blank AND NOT malformed)
  SELECT (SELECT count(*) FROM marked WHERE blank) AS blank, (SELECT count(*) FROM marked WHERE malformed AND NOT blank) AS malformed,
    (SELECT count(*) FROM good WHERE nth > 1) AS repeated, (SELECT count(*) FROM good WHERE nth = 1) AS written""")
def lenient_clean_counters(spark, sf_dir):
    """A malformed row doesn't take its key: first-wins counts only rows that are well formed."""
    df = table(spark, sf_dir, "customer").withColumns({"blank": F.trim(F.coalesce("c_name", F.lit(""))) == "", "malformed": F.col("c_acctbal") < 0})
    good = ~F.col("blank") & ~F.col("malformed")
    # As many are written as there are well-formed keys: counted by partial aggregates, no window over a hot key.
    each = df.groupBy("c_nationkey", "c_mktsegment").agg(F.count_if("blank").alias("blank"), F.count_if(F.col("malformed") & ~F.col("blank")).alias("malformed"), F.count_if(good).alias("good"))
    written = F.count_if(F.col("good") > 0)
    return each.agg(F.sum("blank").alias("blank"), F.sum("malformed").alias("malformed"), (F.sum("good") - written).alias("repeated"), written.alias("written"))


#: Columns that hold a row's own target, which no model may learn from.
FORBIDDEN = {"target", "o_totalprice", "prediction", "split"}


@query(f"""WITH {LAGGED} SELECT 'unique_orders' AS gate, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS failures
  UNION ALL SELECT 'row_count', (SELECT abs(count(*) - (SELECT count(*) FROM orders)) FROM orders JOIN customer ON o_custkey = c_custkey)
  UNION ALL SELECT 'price_range', (SELECT count(*) FROM orders WHERE o_totalprice NOT BETWEEN 0 AND 600000)
  UNION ALL SELECT 'forbidden_features', 0  -- no feature of the models is its own year's target
  UNION ALL SELECT 'features_of_other_years', (SELECT count(*) FROM lagged l LEFT JOIN series s ON s.nation = l.nation AND s.segment = l.segment AND s.combo = l.combo AND s.year = l.year - 1
    WHERE l.lag_1_year IS DISTINCT FROM s.target OR l.years_since_last < 1)
  UNION ALL SELECT 'orphans', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey)""")
def invariant_gates(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ids = customer.select(F.col("c_custkey").alias("o_custkey"))
    n = lambda df, gate: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(gate).alias("gate"), "failures")
    rows = orders.agg(F.count(F.lit(1)).alias("a")).crossJoin(orders.join(ids, "o_custkey").agg(F.count(F.lit(1)).alias("b")))
    rows = rows.select(F.lit("row_count").alias("gate"), F.abs(F.col("a") - F.col("b")).alias("failures"))
    from .models import CATEGORICAL, NUMERIC

    leaks = FORBIDDEN.intersection([*NUMERIC, *CATEGORICAL])
    leak = spark.range(1).select(F.lit("forbidden_features").alias("gate"), F.lit(len(leaks)).cast("bigint").alias("failures"))
    out = n(orders.groupBy("o_orderkey").count().where("count > 1"), "unique_orders").unionByName(rows).unionByName(leak)
    out = out.unionByName(n(orders.where(~F.col("o_totalprice").between(0, 600000)), "price_range"))
    base = store_rows(series(spark, sf_dir))  # lags and years before are of the same means, to the last digit
    year_before = base.select(*KEYS, (F.col("year") + 1).alias("year"), F.col("target").alias("of_year_before"))
    lagged = null_safe(lag_features(base, KEYS), year_before, [*KEYS, "year"])
    other = ~F.col("lag_1_year").eqNullSafe(F.col("of_year_before")) | (F.coalesce("years_since_last", F.lit(1)) < 1)
    out = out.unionByName(n(lagged.where(other), "features_of_other_years"))
    return out.unionByName(n(orders.join(ids, "o_custkey", "left_anti"), "orphans"))


@query("""WITH dim AS (SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS k, r_name FROM region)
  SELECT n_nationkey, r_name FROM nation LEFT JOIN dim ON dim.k IS NOT DISTINCT FROM CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END""")
def null_safe_many_to_one_join(spark, sf_dir):
    key = lambda c: F.nullif(F.col(c), F.lit(0)).alias("k")
    dim = table(spark, sf_dir, "region").select(key("r_regionkey"), "r_name")
    return ops.many_to_one(table(spark, sf_dir, "nation").select("n_nationkey", key("n_regionkey")), dim, ["k"]).select("n_nationkey", "r_name")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey::VARCHAR || '|' || o_orderpriority END AS composite,
  concat_ws('|', CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey::VARCHAR END, o_orderpriority) AS skipping FROM orders""")
def composite_key_nulls(spark, sf_dir):
    part = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(part, F.lit("|"), "o_orderpriority").alias("composite"), F.concat_ws("|", part, "o_orderpriority").alias("skipping"))


@query("""SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END) AS n_status,
  string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def distinct_profile(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct(status).alias("n_status"), ops.distinct_join("o_orderstatus").alias("statuses")
    )


@query("""SELECT 'c_acctbal' AS name, count(*) - count(c_acctbal) AS missing, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer
  UNION ALL SELECT 'c_custkey', count(*) - count(c_custkey), min(c_custkey)::DOUBLE, max(c_custkey)::DOUBLE FROM customer
  UNION ALL SELECT 'c_nationkey', count(*) - count(c_nationkey), min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE FROM customer""")
def column_profile(spark, sf_dir):
    """One pass over the table, then one row a column."""
    names = ["c_acctbal", "c_custkey", "c_nationkey"]
    stats = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("missing"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")) for c in names]
    return table(spark, sf_dir, "customer").agg(F.array(*stats).alias("a")).select(F.inline("a"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, count(*) AS n_rows, count(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END) AS n_known,
  round(min(o_totalprice), 4) AS least, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(max(o_totalprice), 4) AS most FROM orders GROUP BY 1""")
def summary_with_null_groups(spark, sf_dir):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    rounded = [F.round(f("o_totalprice"), 4).alias(n) for f, n in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))]
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.lit(1))
    df = table(spark, sf_dir, "orders").select(status, "o_orderpriority", "o_totalprice")
    summary = df.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.count(known).alias("n_known"), *rounded)
    summary = with_quantiles(summary, ["status"], ["o_totalprice"], [0.5], df)
    return summary.withColumn("median", F.round(F.col("q_o_totalprice")[0], 4)).drop("q_o_totalprice")


@query("""SELECT c_mktsegment, round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 2) AS positive_percent,
  round(100.0 * count(o.o_custkey) / count(*), 2) AS ordered_percent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY 1""")
def coverage_report(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    df = table(spark, sf_dir, "customer").join(ordered, F.col("o_custkey") == F.col("c_custkey"), "left")
    share = lambda n: F.round(100.0 * n / F.count(F.lit(1)), 2)
    return df.groupBy("c_mktsegment").agg(share(F.count_if(F.col("c_acctbal") > 0)).alias("positive_percent"), share(F.count("o_custkey")).alias("ordered_percent"))


@query("""SELECT p_partkey, p_brand = upper('brand#12') AS equal_upper, p_retailprice BETWEEN 900 AND 1200 AS in_range, p_size IN (1, 5, 9) AS member,
  starts_with(p_type, 'STANDARD') AS begins, regexp_full_match(p_brand, '[A-Z][a-z]+#[0-9]{2}') AS shaped, regexp_matches(' ' || lower(p_name) || ' ', '[^0-9a-z_]red[^0-9a-z_]') AS word FROM part""")
def predicate_matrix(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_brand") == F.upper(F.lit("brand#12"))).alias("equal_upper"),
        F.col("p_retailprice").between(900, 1200).alias("in_range"),
        F.col("p_size").isin(1, 5, 9).alias("member"),
        F.col("p_type").startswith("STANDARD").alias("begins"),
        F.col("p_brand").rlike("^[A-Z][a-z]+#[0-9]{2}$").alias("shaped"),
        F.col("p_name").rlike(r"(?iU)(?<!\w)red(?!\w)").alias("word"),
    )


@query("""SELECT n_regionkey, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM (
  SELECT n_regionkey, list(DISTINCT c_mktsegment) AS a FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1) JOIN (
  SELECT n_regionkey, list(DISTINCT c_mktsegment) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < -500 GROUP BY 1) USING (n_regionkey)""")
def set_algebra(spark, sf_dir):
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda cond: F.collect_set(F.when(cond, F.col("c_mktsegment")))
    sets = df.groupBy("n_regionkey").agg(of(F.col("c_acctbal") > 9000).alias("a"), of(F.col("c_acctbal") < -500).alias("b")).where("size(a) > 0 and size(b) > 0")
    size = lambda c: F.size(c).cast("bigint")
    return sets.select("n_regionkey", size(F.array_intersect("a", "b")).alias("both"), size(F.array_union("a", "b")).alias("either"), size(F.array_except("a", "b")).alias("only_a"))


@query("""SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL
  SELECT c_custkey, c_name, NULL::DOUBLE, c_mktsegment FROM customer""")
def union_missing_columns(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)
