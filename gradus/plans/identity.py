"""Identity review: entity maps, ambiguity classes, review queue and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import identity as operator
from ..operators import pairs
from ..operators.gates import distinct_join
from ..operators.identity import AMBIGUOUS
from ..sources.files import store
from .registry import query, table
from .rules import _FOLD, _list


def _join_sql(value: str, sep: str = " || ") -> str:
    return f"coalesce(string_agg(DISTINCT trim({value}), '{sep}' ORDER BY trim({value})) FILTER (WHERE trim({value}) <> ''), '')"


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS ordinal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT c_nationkey, c_mktsegment AS display, year, n FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY year DESC, n DESC, ordinal) = 1""")
def canonical_display_value(spark, sf_dir):
    """The newest year's most frequent value, then the first seen."""
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = df.groupBy("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("ordinal"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("year"), F.desc("n"), "ordinal"))
    return counts.withColumn("rank", rank).where("rank = 1").select("c_nationkey", F.col("c_mktsegment").alias("display"), "year", "n")


@query("""SELECT c_nationkey, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_names, string_agg(DISTINCT c_mktsegment, ' || ' ORDER BY c_mktsegment) AS names, min(c_custkey) AS first_key, max(c_custkey) AS last_key,
  CASE WHEN count(DISTINCT c_mktsegment) > 4 THEN 'review' ELSE 'stable' END AS status FROM customer GROUP BY 1""")
def institution_map(spark, sf_dir):
    names = F.count_distinct("c_mktsegment")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_rows"), names.alias("n_names"), distinct_join("c_mktsegment", " || ").alias("names"),
        F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"), F.when(names > 4, "review").otherwise("stable").alias("status"),
    )


@query("""SELECT p_brand, p_name, count(*) AS n_rows, string_agg(DISTINCT p_type, ' || ' ORDER BY p_type) AS types, string_agg(DISTINCT p_size::VARCHAR, ';' ORDER BY p_size::VARCHAR) AS sizes, round(avg(p_retailprice), 3) AS mean_price FROM part GROUP BY ALL""")
def program_map(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("size_text", F.col("p_size").cast("string")).groupBy("p_brand", "p_name")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct_join("p_type", " || ").alias("types"), distinct_join("size_text").alias("sizes"), F.round(F.avg("p_retailprice"), 3).alias("mean_price"))


AMBIGUITY = """a AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_totalprice) AS n FROM orders GROUP BY ALL),
  b AS (SELECT o_custkey, o_orderpriority, max(m) AS m FROM (SELECT o_custkey, o_orderpriority, o_orderstatus, count(DISTINCT o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY ALL)"""


def _ambiguity(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_totalprice").alias("m"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    both = prices.groupBy("o_custkey", "o_orderpriority").agg(F.when(F.min("low") == F.max("high"), 1).otherwise(2).alias("n"), F.max("m").alias("m"))
    kind = F.when(F.col("n") == 1, "clear").when(F.col("m") == 1, "resolved_by_status").otherwise("ambiguous")
    return both.select("o_custkey", "o_orderpriority", kind.alias("kind"))


@query(f"""WITH {AMBIGUITY} SELECT o_custkey, o_orderpriority, CASE WHEN n = 1 THEN 'clear' WHEN m = 1 THEN 'resolved_by_status' ELSE 'ambiguous' END AS kind FROM a JOIN b USING (o_custkey, o_orderpriority)""")
def ambiguity_classes(spark, sf_dir):
    return _ambiguity(spark, sf_dir)


@query(f"""WITH {AMBIGUITY} SELECT 'ambiguous_key' AS item, 'high' AS priority, o_custkey::VARCHAR || '|' || o_orderpriority AS key, n AS affected_rows, NULL::VARCHAR AS details FROM a JOIN b USING (o_custkey, o_orderpriority) WHERE m > 1
  UNION ALL SELECT 'repeated_line', 'medium', l_orderkey::VARCHAR || '|' || l_linenumber, count(*), NULL FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 2
  UNION ALL SELECT 'negative_balance', 'low', c_custkey::VARCHAR, 1, c_mktsegment FROM customer WHERE c_acctbal < 0""")
def review_queue_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fine = orders.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_totalprice").alias("m")).groupBy("o_custkey", "o_orderpriority").agg(F.max("m").alias("m")).where("m > 1")
    sizes = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count_distinct("o_totalprice").alias("affected_rows"))
    row = lambda df, item, priority, key, n, details=F.lit(None).cast("string"): df.select(F.lit(item).alias("item"), F.lit(priority).alias("priority"), key.alias("key"), n.cast("bigint").alias("affected_rows"), details.alias("details"))
    join = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("|"), F.col(b).cast("string"))
    one = row(fine.join(sizes, ["o_custkey", "o_orderpriority"]), "ambiguous_key", "high", join("o_custkey", "o_orderpriority"), F.col("affected_rows"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 2")
    two = row(lines, "repeated_line", "medium", join("l_orderkey", "l_linenumber"), F.col("count"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return one.unionByName(two).unionByName(row(poor, "negative_balance", "low", F.col("c_custkey").cast("string"), F.lit(1), F.col("c_mktsegment")))


HIGH, MEDIUM = 0.90, 0.78


def _named(spark, sf_dir):
    """Names of each brand with their sizes (which stand for years) and prices (for codes)."""
    name = text.slug(F.concat_ws(" ", "p_name", "p_type"))
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), name.alias("name"), "p_size", F.floor("p_retailprice").alias("code"))
    return part.groupBy("group", "name").agg(F.collect_set("p_size").alias("sizes"), F.collect_set("code").alias("codes"))


def _with_both(pairs_, named):
    for side in ("a", "b"):
        own = named.select("group", F.col("name").alias(side), F.col("sizes").alias(f"{side}_sizes"), F.col("codes").alias(f"{side}_codes"))
        pairs_ = pairs_.join(own, ["group", side])
    return pairs_.withColumns({"overlap": F.arrays_overlap("a_sizes", "b_sizes"), "shared_code": F.arrays_overlap("a_codes", "b_codes")})


@query("""WITH n AS (SELECT p_brand, p_name || ' ' || lower(p_type) AS name, list(DISTINCT p_size) AS sizes FROM part GROUP BY ALL), w AS (SELECT *, string_split(name, ' ') AS words FROM n)
  SELECT a.p_brand, a.name AS p_name, b.name AS q_name, len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) AS jaccard, list_has_any(a.sizes, b.sizes) AS overlap
  FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.name < b.name""")
def identity_pairs_jaccard(spark, sf_dir):
    """All pairs of a brand's names: the share of words that they have in common, and whether they have a size in common."""
    named = _named(spark, sf_dir).select("group", "name", "sizes", pairs.words(F.col("name")).alias("words"))
    measure, overlap = similarity.jaccard(F.col("a.words"), F.col("b.words")), F.arrays_overlap("a.sizes", "b.sizes")
    return pairs.every(named).select(F.col("group").alias("p_brand"), F.col("a.name").alias("p_name"), F.col("b.name").alias("q_name"), measure.alias("jaccard"), overlap.alias("overlap"))


@query()
def identity_pairs_ratio(spark, sf_dir):
    """Names of a brand alike by the greater of both measures, with what is to be done about them."""
    named = _named(spark, sf_dir)
    df = _with_both(pairs.by_either(named, MEDIUM), named)
    near = F.col("similarity") >= HIGH
    decision = F.when(F.col("overlap"), "keep_split_same_year_coexistence").when(near & F.col("shared_code"), "candidate_alias_high_confidence_needs_official_verification").otherwise("candidate_alias_medium_confidence_needs_official_verification")
    evidence = F.when(F.col("overlap"), "strong_local_evidence").when(near & F.col("shared_code"), "similar_name_and_shared_major_code").otherwise("name_similarity_only")
    measures = [F.round(c, 4).alias(c) for c in ("ratio", "jaccard", "similarity")]
    return df.select(F.col("group").alias("p_brand"), F.col("a").alias("p_name"), F.col("b").alias("q_name"), *measures, "overlap", "shared_code", decision.alias("decision"), evidence.alias("evidence"))


# Rows of orders under the names of the admission table.
UNIVERSITIES = ["Trường Đại học Bách khoa", "Đại học", "ĐH Luật", "trường ĐẠI HỌC bách khoa", "Đại Học Luật Thành phố Hồ Chí Minh", "ĐH Luật ", None]
MAJORS = ["Luật", "LUẬT", "Kế toán", None, "Kế toán (CLC)", "Y khoa", "y  khoa"]
MAJOR_GROUPS = ["Pháp luật", "Kinh doanh", "Sức khoẻ"]
REASONS = ["", "non_thpt_admission_method|invalid_subject_combination", "invalid_subject_combination", "cutoff_score_30_outside_0_30", AMBIGUOUS, "else", AMBIGUOUS, AMBIGUOUS]
KEY = ["university_admission_code", "major_admission_code", "year"]


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def _admissions(spark, sf_dir):
    """Orders as rows of the admission table; reason is empty for those that are kept."""
    i, n = F.col("o_orderkey"), F.col("c_nationkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return operator.prepared(df.select(
        i.alias("row"), text("U", n % 11).alias("university_admission_code"), text("C", n).alias("university_code"), _pick(UNIVERSITIES, n).alias("university_name"),
        text(" M", i % 3).alias("major_admission_code"), F.when(i % 17 > 0, text("K", (n + F.floor(i / 3) % 2) % 9)).alias("major_code"), _pick(MAJORS, n + i % 3 + F.year("o_orderdate") % 2).alias("major_name"),
        _pick(MAJOR_GROUPS, F.year("o_orderdate") + n).alias("major_group_name"), F.year("o_orderdate").alias("year"), F.when(i % 23 == 0, "high").otherwise("low").alias("note_priority"), F.when(i % 46 == 0, "scope").otherwise("variant").alias("note_category"),
        _pick(REASONS, F.floor(i / 7)).alias("reason"), F.col("o_orderpriority").alias("method"), F.when(i % 5 > 0, text("A0", i % 4)).otherwise("").alias("combination"),
        F.floor(F.col("o_totalprice") / 200000).alias("target"), F.when(i % 2 == 0, "Nam").alias("gender"), text("site", i % 3).alias("campus"),
    ))


_ADMISSIONS_SQL = f"""WITH raw AS (
    SELECT o_orderkey AS row, 'U' || c_nationkey % 11 AS university_admission_code, 'C' || c_nationkey AS university_code, ({_list(UNIVERSITIES)})[(c_nationkey % {len(UNIVERSITIES)} + 1)::INT] AS university_name,
      ' M' || o_orderkey % 3 AS major_admission_code, CASE WHEN o_orderkey % 17 > 0 THEN 'K' || (c_nationkey + o_orderkey // 3 % 2) % 9 END AS major_code, ({_list(MAJORS)})[((c_nationkey + o_orderkey % 3 + year(o_orderdate) % 2) % {len(MAJORS)} + 1)::INT] AS major_name,
      ({_list(MAJOR_GROUPS)})[((year(o_orderdate) + c_nationkey) % {len(MAJOR_GROUPS)} + 1)::INT] AS major_group_name, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 23 = 0 THEN 'high' ELSE 'low' END AS note_priority, CASE WHEN o_orderkey % 46 = 0 THEN 'scope' ELSE 'variant' END AS note_category,
      ({_list(REASONS)})[(o_orderkey // 7 % {len(REASONS)} + 1)::INT] AS reason, o_orderpriority AS method, CASE WHEN o_orderkey % 5 > 0 THEN 'A0' || o_orderkey % 4 ELSE '' END AS combination,
      floor(o_totalprice / 200000)::BIGINT AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'Nam' END AS gender, 'site' || o_orderkey % 3 AS campus
    FROM orders JOIN customer ON o_custkey = c_custkey),
  named AS (SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({_FOLD.format("university_name")}, '\\btruong\\b', ' ', 'g'), '\\bdai hoc\\b', ' ', 'g'), 'thanh pho ho chi minh', 'tphcm'), '\\btp hcm\\b', 'tphcm', 'g'), '\\s+', ' ', 'g')), ''), {_FOLD.format("university_code")}) AS institution_name,
      coalesce(nullif({_FOLD.format("major_name")}, ''), {_FOLD.format("major_code")}) AS major_normal FROM raw),
  rows_ AS (SELECT *, university_admission_code || '|' || institution_name AS entity, university_admission_code || '|' || institution_name || '|' || trim(major_admission_code) || '|' || major_normal AS series FROM named),
  d AS (SELECT * FROM rows_ WHERE reason = ''),
  shown_i AS (SELECT entity, trim(university_name) AS canonical_name FROM (SELECT *, count(*) OVER (PARTITION BY entity, university_name) AS n FROM d WHERE trim(coalesce(university_name, '')) <> '') QUALIFY row_number() OVER (PARTITION BY entity ORDER BY year DESC, n DESC, row) = 1),
  shown_p AS (SELECT series, trim(major_name) AS canonical_name FROM (SELECT *, count(*) OVER (PARTITION BY series, major_name) AS n FROM d WHERE trim(coalesce(major_name, '')) <> '') QUALIFY row_number() OVER (PARTITION BY series ORDER BY year DESC, n DESC, row) = 1),
  im AS (SELECT entity, any_value(university_admission_code) AS admission_code, {_join_sql("university_name")} AS name_variants, {_join_sql("university_code")} AS code_variants, string_agg(DISTINCT year::VARCHAR, ';' ORDER BY year::VARCHAR) AS years,
      count(DISTINCT year) AS year_count, count(*) AS row_count FROM d GROUP BY 1),
  institutions AS (SELECT im.*, count(*) OVER (PARTITION BY admission_code) AS sharing, coalesce(canonical_name, '') AS canonical_name, count(*) OVER (PARTITION BY admission_code) > 1 AS code_reuse FROM im LEFT JOIN shown_i USING (entity)),
  pm AS (SELECT series, any_value(entity) AS entity, any_value(university_admission_code) AS admission_code, trim(any_value(major_admission_code)) AS major_admission_code, any_value(major_normal) AS major_normal, {_join_sql("major_name")} AS name_variants, {_join_sql("major_code")} AS code_variants,
      {_join_sql("major_group_name")} AS group_variants, string_agg(DISTINCT year::VARCHAR, ';' ORDER BY year::VARCHAR) AS years, count(DISTINCT year) AS year_count, count(*) AS row_count, count(DISTINCT major_name) AS raw_names, count(DISTINCT major_code) AS code_count, count(DISTINCT major_group_name) AS group_count FROM d GROUP BY 1),
  sharing AS (SELECT entity, major_admission_code, count(DISTINCT major_normal) AS names_sharing_code FROM pm GROUP BY ALL),
  programs AS (SELECT pm.* EXCLUDE (major_normal, raw_names), names_sharing_code, coalesce(canonical_name, '') AS canonical_name, CASE WHEN major_normal = '' THEN 'review_missing_major_name' WHEN names_sharing_code > 1 THEN 'split_program_code_reuse' WHEN raw_names > 1 THEN 'safe_text_normalization' ELSE 'stable_exact_name' END AS status,
      names_sharing_code > 1 AS code_reuse, code_count > 1 AS code_conflict, group_count > 1 AS groups_changed FROM pm JOIN sharing USING (entity, major_admission_code) LEFT JOIN shown_p USING (series)),
  rejected AS (SELECT * FROM rows_ WHERE reason <> ''), amb AS (SELECT * FROM rejected WHERE reason = '{AMBIGUOUS}'),
  by_name AS (SELECT {", ".join(KEY)}, count(*) AS identities, bool_and(n <= 1) AS one_each FROM (SELECT {", ".join(KEY)}, major_code, major_normal, count(DISTINCT target) AS n FROM amb GROUP BY ALL) GROUP BY ALL),
  by_scope AS (SELECT {", ".join(KEY)}, count(*) AS scopes, bool_and(n <= 1) AS one_scoped FROM (SELECT {", ".join(KEY)}, major_code, major_normal, gender, campus, count(DISTINCT target) AS n FROM amb GROUP BY ALL) GROUP BY ALL),
  sums AS (SELECT {", ".join(KEY)}, count(*) AS n, {_join_sql("target::VARCHAR", ";")} AS vals FROM amb GROUP BY ALL),
  classes AS (SELECT *, CASE WHEN identities > 1 AND one_each THEN 'candidate_split_by_program_identity' WHEN scopes > 1 AND one_scoped THEN 'candidate_split_by_gender_or_campus' ELSE 'unresolved_conflicting_cutoffs' END AS kind FROM sums JOIN by_name USING ({", ".join(KEY)}) JOIN by_scope USING ({", ".join(KEY)}))"""
_ACTION = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in operator.ACTIONS.items()) + " END"


def _kept(spark, sf_dir):
    rows = store(_admissions(spark, sf_dir), "admissions")
    return rows.where("reason = ''"), rows.where("reason <> ''")


@query(f"{_ADMISSIONS_SQL} SELECT entity, admission_code, canonical_name, name_variants, code_variants, years, year_count, row_count, sharing, code_reuse FROM institutions")
def institutions_in_full(spark, sf_dir):
    """Ten figures of each institution: names, codes, years, rows, and the sharing of its code."""
    kept, _ = _kept(spark, sf_dir)
    return operator.institution_map(kept, "row").select("entity", "admission_code", "canonical_name", "name_variants", "code_variants", "years", "year_count", "row_count", "sharing", "code_reuse")


@query(f"{_ADMISSIONS_SQL} SELECT * FROM programs")
def programs_in_full(spark, sf_dir):
    """Eighteen figures of each programme series."""
    kept, _ = _kept(spark, sf_dir)
    return operator.program_map(kept, "row")


@query(f"""{_ADMISSIONS_SQL}, queue AS (
  SELECT 'institution_code_reuse' AS review_type, 'high' AS priority, admission_code AS review_key, sum(row_count)::BIGINT AS affected_rows, {_join_sql("canonical_name")} AS details, 'institution_code_reuse' AS a FROM institutions WHERE code_reuse GROUP BY admission_code
  UNION ALL SELECT 'program_code_reuse', 'high', entity || '|' || major_admission_code, sum(row_count)::BIGINT, {_join_sql("canonical_name")}, 'program_code_reuse' FROM programs WHERE code_reuse GROUP BY entity, major_admission_code
  UNION ALL SELECT 'major_code_conflict', 'high', series, row_count, code_variants, 'major_code_conflict' FROM programs WHERE code_conflict
  UNION ALL SELECT 'sensitive_source_note', 'high', series, count(*), {_join_sql("note_category")}, 'sensitive_source_note' FROM d WHERE note_priority = 'high' GROUP BY series
  UNION ALL SELECT 'ambiguous_cutoff', 'high', university_admission_code || '|' || trim(major_admission_code) || '|' || year, n, kind || ': ' || vals, kind FROM classes
  UNION ALL SELECT category, CASE WHEN category = 'score_scale_mismatch' THEN 'high' ELSE 'medium' END, coalesce(nullif(combination, ''), '<blank>'), count(*), {_join_sql("method")}, category FROM (
    SELECT *, CASE WHEN contains(reason, 'cutoff_score_30_outside_0_30') THEN 'score_scale_mismatch' WHEN contains(reason, 'non_thpt_admission_method') THEN 'out_of_scope_non_thpt' WHEN contains(reason, 'invalid_subject_combination') THEN 'unsupported_nonstandard_combination' ELSE 'other_rejection' END AS category
    FROM rejected WHERE reason <> '{AMBIGUOUS}') GROUP BY category, combination)
  SELECT review_type, priority, review_key, affected_rows, details, {_ACTION.format("a")} AS recommended_action FROM queue""")
def review_queue_in_full(spark, sf_dir):
    """All six kinds of items of the review queue."""
    kept, rejected = _kept(spark, sf_dir)
    institutions, programs = operator.institution_map(kept, "row"), store(operator.program_map(kept, "row"), "programs")
    return operator.review_queue(kept, institutions, programs, operator.ambiguous_groups(rejected, KEY), rejected, KEY)
