"""Keeping stored tables fresh, and what is shown of them: assets, labels, sectors, largest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import label_by_thresholds
from ..operators.quantiles import with_quantiles
from .registry import query, table
from .rules import _LISTS, _list, _pick, _skill_lists

# How good an asset of each status is.
QUALITY = {
    "not_found": 0, "official_site_unreachable": 0, "logo_not_found": 0, "generated_avatar": 1, "downloaded_favicon_proxy": 2,
    "downloaded_official_icon": 3, "downloaded": 3, "downloaded_official_logo": 4,
}


def rank(status: Column) -> Column:
    """The quality of a status; none of an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), F.lit(0))


def refreshed(old: DataFrame, new: DataFrame, key: str, force: bool) -> DataFrame:
    """old's rows, each replaced by new's of the same key if that has an asset and is as good (or replacement is forced).

    Both: key, asset, status. A row that was found before is never lost; keys that only new has are left out.
    """
    found = new.where(F.coalesce("asset", F.lit("")) != "").select(key, F.col("asset").alias("__asset"), F.col("status").alias("__status"), F.lit(True).alias("__there"))
    take = F.coalesce("__there", F.lit(False)) & (F.lit(force) | (rank(F.col("__status")) >= rank(F.col("status"))))
    pick = lambda c: F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return old.join(found, key, "left").select(key, pick("asset"), pick("status"), take.alias("replaced"))


STATUSES = [*QUALITY, None, "unknown"]
_OLD = f"SELECT s_suppkey, 'old' || s_suppkey AS asset, ({_list(STATUSES)})[(s_suppkey % {len(STATUSES)} + 1)::INT] AS status FROM supplier WHERE s_suppkey % 3 <> 1"
_NEW = f"SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'new' || s_suppkey END AS asset, ({_list(STATUSES)})[(s_suppkey * 7 % {len(STATUSES)} + 1)::INT] AS status FROM supplier WHERE s_suppkey % 4 <> 2"
_RANK = "coalesce(CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUALITY.items()) + " END, 0)"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), f AS (SELECT unnest([false, true]) AS forced),
  j AS (SELECT o.*, f.forced, n.asset AS n_asset, n.status AS n_status, coalesce(n.asset, '') <> '' AND (f.forced OR {_RANK.format("n.status")} >= {_RANK.format("o.status")}) AS take FROM o CROSS JOIN f LEFT JOIN n USING (s_suppkey))
  SELECT s_suppkey, forced, CASE WHEN take THEN n_asset ELSE asset END AS asset, CASE WHEN take THEN n_status ELSE status END AS status, take AS replaced FROM j""")
def assets_refreshed(spark, sf_dir):
    """A refresh that replaces only by an asset as good, and one that is forced."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    text = key.cast("string")
    old = supplier.where("s_suppkey % 3 <> 1").select("s_suppkey", F.concat(F.lit("old"), text).alias("asset"), _pick(STATUSES, key).alias("status"))
    asset = F.when(key % 5 == 0, "").when(key % 5 > 1, F.concat(F.lit("new"), text))
    new = supplier.where("s_suppkey % 4 <> 2").select("s_suppkey", asset.alias("asset"), _pick(STATUSES, key * 7).alias("status"))
    both = [refreshed(old, new, "s_suppkey", forced).withColumn("forced", F.lit(forced)) for forced in (False, True)]
    return both[0].unionByName(both[1])


def shown(options: DataFrame, assets: DataFrame, code: str, name: str) -> DataFrame:
    """options with logo_url, logo_alt, has_logo and logo_kind of the asset of their code, compared trimmed in upper case.

    assets: code, asset, status, alt, name; of a code that repeats the last row (by ordinal) counts.
    """
    norm = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    last = assets.withColumn("__code", norm("code")).where("__code <> ''").groupBy("__code").agg(F.max_by(F.struct("asset", "status", "alt", "name"), "ordinal").alias("__a"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    asset, status, alt = text(F.col("__a.asset")), text(F.col("__a.status")), text(F.col("__a.alt"))
    called = F.coalesce(F.nullif(F.col(name), F.lit("")), F.col("__a.name"), F.lit(""))
    kind = F.when(status == "generated_avatar", "generated_avatar").when(status == "downloaded_favicon_proxy", "favicon_proxy").when(asset != "", "official").otherwise("missing")
    alt = F.when(alt != "", alt).otherwise(F.concat(F.lit("Logo "), F.trim(called)))
    joined = options.withColumn("__code", norm(code)).join(last, "__code", "left")
    return joined.select(*options.columns, F.nullif(asset, F.lit("")).alias("logo_url"), alt.alias("logo_alt"), (asset != "").alias("has_logo"), kind.alias("logo_kind"))


@query(f"""WITH a AS (SELECT 's' || s_suppkey AS code, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE '/logo/' || s_suppkey END AS asset, ({_list(STATUSES)})[(s_suppkey % {len(STATUSES)} + 1)::INT] AS status,
    CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' mark' END AS alt, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0),
  o AS (SELECT s_suppkey, ' S' || s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'School ' || s_suppkey END AS name FROM supplier)
  SELECT s_suppkey, nullif(trim(coalesce(a.asset, '')), '') AS logo_url, CASE WHEN coalesce(a.alt, '') <> '' THEN a.alt ELSE 'Logo ' || coalesce(o.name, a.name, '') END AS logo_alt, trim(coalesce(a.asset, '')) <> '' AS has_logo,
    CASE WHEN a.status = 'generated_avatar' THEN 'generated_avatar' WHEN a.status = 'downloaded_favicon_proxy' THEN 'favicon_proxy' WHEN trim(coalesce(a.asset, '')) <> '' THEN 'official' ELSE 'missing' END AS logo_kind
  FROM o LEFT JOIN a ON upper(a.code) = trim(o.code)""")
def assets_shown(spark, sf_dir):
    """What is shown for each school: address, alternative text, kind."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    text = key.cast("string")
    asset = F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("/logo/"), text))
    alt = F.when(key % 3 == 0, F.concat("s_name", F.lit(" mark")))
    assets = supplier.where("s_suppkey % 7 <> 0").select(F.concat(F.lit("s"), text).alias("code"), asset.alias("asset"), _pick(STATUSES, key).alias("status"), alt.alias("alt"), F.col("s_name").alias("name"), key.alias("ordinal"))
    options = supplier.select("s_suppkey", F.concat(F.lit(" S"), text).alias("code"), F.when(key % 2 == 0, F.concat(F.lit("School "), text)).alias("name"))
    return shown(options, assets, "code", "name").drop("code", "name")


# Least postings of each level of demand, and the level below.
DEMAND, LITTLE = [(5000, "Rất cao"), (3000, "Cao"), (1500, "Trung bình")], "Ổn định"


@query(f"""WITH {_LISTS}, sectors AS (SELECT p_brand, count(*) AS postings, round(avg(p_retailprice), 2) AS mean_pay, round(median(p_retailprice), 2) AS median_pay FROM part GROUP BY 1 ORDER BY postings DESC, p_brand LIMIT 6),
  lists AS (SELECT p_brand, string_agg(skill, ';' ORDER BY rank) AS skills FROM kept WHERE rank <= 6 GROUP BY 1)
  SELECT replace(lower(p_brand), '#', ' ') AS sector, postings, CASE WHEN postings * 50 >= 5000 THEN 'Rất cao' WHEN postings * 50 >= 3000 THEN 'Cao' WHEN postings * 50 >= 1500 THEN 'Trung bình' ELSE 'Ổn định' END AS demand, mean_pay, median_pay, skills
  FROM sectors LEFT JOIN lists USING (p_brand)""")
def career_sectors(spark, sf_dir):
    """The six largest sectors with demand, pay and up to six skills."""
    part = table(spark, sf_dir, "part")
    top = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("postings"), F.round(F.avg("p_retailprice"), 2).alias("mean_pay")).orderBy(F.desc("postings"), "p_brand").limit(6)
    pay = part.join(F.broadcast(top.select("p_brand")), "p_brand", "left_semi")  # six rows
    top = with_quantiles(top, ["p_brand"], ["p_retailprice"], [0.5], pay)
    lists = _skill_lists(spark, sf_dir).where("rank <= 6").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("rank", "skill"))).alias("s"))  # six each
    demand = label_by_thresholds(F.col("postings") * 50, DEMAND, LITTLE, None)
    joined = top.join(lists, "p_brand", "left")
    return joined.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")).alias("sector"), "postings", demand.alias("demand"), "mean_pay", F.round(F.col("q_p_retailprice")[0], 2).alias("median_pay"), F.array_join(F.transform("s", lambda x: x["skill"]), ";").alias("skills"))


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 20""")
def twenty_largest(spark, sf_dir):
    """The twenty largest values, ties to the first seen, with their places."""
    top = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("down"), "o_orderkey", "o_totalprice"))).alias("r"))  # twenty rows
    each = rows.select(F.posexplode("r").alias("place", "x"))
    return each.select("x.o_orderkey", "x.o_totalprice", (F.col("place") + 1).alias("place"))
