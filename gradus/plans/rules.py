"""Rule tables over the given tables: scales, categories, notes, regions, skills, questions, fallbacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as fn
from ..operators import series as ops
from .registry import query, table
from .series import CTE, KEYS, series


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str | None], place):
    """One of a list of texts by a number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (place % len(values) + 1).cast("int"))


METHODS = ["THPTQG", "THPTQG - Thang 40", "DGNLHCM", "DGNLQGHN", "DGTD", "Học bạ", "Xét tuyển thẳng", None]
_METHOD = f"({_list(METHODS)})[(p_partkey % {len(METHODS)} + 1)::INT]"


@query(f"""WITH p AS (SELECT p_partkey, {_METHOD} AS method, p_retailprice / 31 AS score, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ',5' WHEN 1 THEN p_size || '.25 ' WHEN 2 THEN 'no' ELSE '' END AS typed FROM part)
  SELECT p_partkey, CASE method {" ".join(f"WHEN '{m}' THEN '{s}'" for m, s in fn.SCALES.items())} ELSE '{fn.OTHER_SCALE}' END AS scale,
    CASE method WHEN 'THPTQG' THEN score WHEN 'THPTQG - Thang 40' THEN round_even(score * 0.75, 2) END AS score_30, try_cast(replace(trim(typed), ',', '.') AS DOUBLE) AS number FROM p""")
def scales_and_numbers(spark, sf_dir):
    """Scale by method, the 30-point form half to even, and numbers with a point or a comma."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    typed = F.when(key % 4 == 0, F.concat(F.lit(" "), size, F.lit(",5"))).when(key % 4 == 1, F.concat(size, F.lit(".25 "))).when(key % 4 == 2, "no").otherwise("")
    df = table(spark, sf_dir, "part").select("p_partkey", _pick(METHODS, key).alias("method"), (F.col("p_retailprice") / 31).alias("score"), typed.alias("typed"))
    scale = fn.checked_scale(fn.scale(F.col("method")), F.coalesce("method", F.lit("")))
    return df.select("p_partkey", scale.alias("scale"), fn.score_30(F.col("score"), F.col("method")).alias("score_30"), fn.as_number(F.col("typed")).alias("number"))


MAJORS = [
    "Công nghệ thông tin", "Logistics và quản lý chuỗi cung ứng", "Kế toán", "Truyền thông đa phương tiện", "Ngôn ngữ Anh", "Luật kinh tế", "Giáo dục mầm non", "Điều dưỡng",
    "Kiến trúc", "Kỹ thuật điện tử - viễn thông", "Công nghệ thực phẩm", "Thú y", "Quản trị khách sạn", "Thiết kế đồ họa", "Kinh tế phát triển", "Tâm lý học", "Toán ứng dụng", "Hóa học", None, "Vật lý học", "Thống kê", "Triết học",
]
GROUPS = ["Kinh doanh và quản lý", "Toán và thống kê", "An ninh, Quốc phòng", "Nghệ thuật", "Khoa học sự sống", "Sức khoẻ", None, "Chưa rõ", "Dịch vụ xã hội", "Mỏ - Địa chất", "Ngoại giao - Ngoại ngữ"]
_FOLD = "trim(regexp_replace(replace(strip_accents(lower(coalesce({0}, ''))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


def _category_sql(what: int) -> str:
    names = " ".join(f"WHEN regexp_matches(name_key, '{p}') THEN '{(c, 'major_name_keyword', sure)[what]}'" for c, p, sure in fn.NAME_RULES)
    groups = " ".join(f"WHEN group_key = '{g}' THEN '{(c, 'major_group_rule', sure)[what]}'" for g, (c, sure) in fn.GROUP_RULES.items())
    return f"CASE {names} {groups} END"


@query(f"""WITH p AS (SELECT p_partkey, ({_list(MAJORS)})[(p_partkey % {len(MAJORS)} + 1)::INT] AS name, ({_list(GROUPS)})[(p_size % {len(GROUPS)} + 1)::INT] AS grp FROM part),
  k AS (SELECT *, {_FOLD.format("name")} AS name_key, {_FOLD.format("grp")} AS group_key FROM p)
  SELECT p_partkey, name, {_category_sql(0)} AS category, {_category_sql(1)} AS basis, {_category_sql(2)} AS confidence FROM k""")
def major_categories(spark, sf_dir):
    """Sixteen rules over names, then forty-six over groups."""
    df = table(spark, sf_dir, "part").select("p_partkey", _pick(MAJORS, F.col("p_partkey")).alias("name"), _pick(GROUPS, F.col("p_size")).alias("group"))
    return df.select("p_partkey", "name", fn.category(F.col("name"), F.col("group")).alias("c")).select("p_partkey", "name", "c.category", "c.basis", "c.confidence")


NOTES = [
    "Toán hệ số 2", "Tiếng Anh nhân hệ số 2; TTNV <= 3", "môn chính x2", "TTNV<=12", "Phân hiệu Bến Tre, học tại chỗ", "CƠ SỞ 2 ; nữ", "Chỉ tuyển nam", "thí sinh nữ", "thí sinh nam; thí  sinh nữ",
    "Chương trình CLC", "Chất lượng  cao", "vẽ MỸ thuật nhân 1,5", "Ngữ văn Hệ số 2.0", "Hóa học >= 8", "", None, "Năng khiếu  nhân 2 (TTNV = 1), cơ sở Hà Nội",
]
_LIST_OF_NOTES = f"({_list(NOTES)})[(p_partkey % {len(NOTES)} + 1)::INT] || CASE WHEN p_size % 9 = 0 THEN ' nữ' ELSE '' END"


@query(f"""WITH n AS (SELECT p_partkey, coalesce({_LIST_OF_NOTES}, '') AS t FROM part),
  f AS (SELECT p_partkey, t, CASE WHEN {" OR ".join(f"contains(t, '{w}')" for w in fn.DOUBLED)} THEN coalesce({", ".join(f"CASE WHEN contains(lower(t), '{s.lower()}') THEN '{s}' END" for s in fn.SUBJECTS)}, '{fn.NO_SUBJECT}') END AS doubled,
    try_cast(nullif(regexp_extract(t, '{fn.WANTED}', 1), '') AS INT) AS most_wanted, nullif(trim(regexp_extract(t, '{fn.CAMPUS.replace("(?iu)", "(?i)")}', 1)), '') AS campus,
    CASE WHEN contains(lower(t), 'nam') AND NOT contains(lower(t), 'nữ') THEN 'Nam' WHEN contains(lower(t), 'nữ') AND NOT contains(lower(t), 'nam') THEN 'Nữ' END AS sex,
    nullif(regexp_extract(t, '{fn.WEIGHT.replace("(?iu)", "(?i)")}', 1), '') AS old_subject, try_cast(replace(nullif(regexp_extract(t, '{fn.WEIGHT.replace("(?iu)", "(?i)")}', 2), ''), ',', '.') AS DOUBLE) AS old_factor,
    CASE WHEN regexp_matches(lower(t), '{fn.GIRLS}') THEN CASE WHEN regexp_matches(lower(t), '{fn.BOYS}') THEN 'Cả hai' ELSE 'Nữ' END WHEN regexp_matches(lower(t), '{fn.BOYS}') THEN 'Nam' END AS old_sex,
    regexp_matches(lower(t), '{fn.QUALITY}') AS old_quality FROM n)
  SELECT p_partkey, doubled, most_wanted, campus, sex, t <> '' AND doubled IS NULL AND most_wanted IS NULL AND campus IS NULL AND sex IS NULL AS review, old_subject, old_factor, old_sex, old_quality,
    t <> '' AND old_subject IS NULL AND old_factor IS NULL AND old_sex IS NULL AND NOT old_quality AS old_review FROM f""")
def notes_in_full(spark, sf_dir):
    """All features of both forms of notes."""
    note = F.concat(_pick(NOTES, F.col("p_partkey")), F.when(F.col("p_size") % 9 == 0, " nữ").otherwise(""))
    df = table(spark, sf_dir, "part").select("p_partkey", note.alias("note"))
    new, old = fn.note_features(F.col("note")), fn.old_note_features(F.col("note"))
    return df.select("p_partkey", *[c.alias(n) for n, c in new.items()], *[c.alias(f"old_{n}") for n, c in old.items()])


CODES = ["tmu ", "XDT", "HCS", None]
PLACES = ["ĐH Sài Gòn", "ĐH Cần Thơ", "ĐH Huế", "ĐH Đà Nẵng", None]
_SCHOOL = f"""SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 6 = 0 THEN ({_list(CODES)})[(s_suppkey // 6 % {len(CODES)} + 1)::INT] ELSE 'S' || s_nationkey END AS code,
  CASE WHEN s_suppkey % 5 = 1 THEN ({_list(PLACES)})[(s_suppkey // 5 % {len(PLACES)} + 1)::INT] ELSE s_name END AS name FROM supplier"""


def _place_sql(k: int, words, other: str, column: str) -> str:
    manual = " ".join(f"WHEN upper(trim(s.code)) = '{c}' THEN '{both[k]}'" for c, both in fn.SCHOOLS.items())
    named = " ".join(f"WHEN regexp_matches(s.name, '{p}') THEN '{v}'" for p, v in words)
    return f"coalesce(CASE {manual} {named} END, c.{column}, n.{column}, '{other}')"


@query(f"""WITH s AS ({_SCHOOL}), by_code AS (SELECT 'S' || n_nationkey AS code, r_name AS region, n_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10),
  by_name AS (SELECT s_name AS name, 'R' || s_nationkey AS region, 'P' || s_nationkey AS province FROM supplier WHERE s_suppkey % 4 = 0)
  SELECT s_suppkey, {_place_sql(0, fn.REGION_WORDS, fn.NORTH, "region")} AS region, {_place_sql(1, fn.PROVINCE_WORDS, "", "province")} AS province
  FROM s LEFT JOIN by_code c ON c.code = upper(trim(s.code)) LEFT JOIN by_name n ON n.name = trim(s.name)""")
def places_by_cascade(spark, sf_dir):
    """Region and province: thirty-one schools, words of names, earlier values of code and name, default."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    code = F.when(key % 6 == 0, _pick(CODES, F.floor(key / 6))).otherwise(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")))
    name = F.when(key % 5 == 1, _pick(PLACES, F.floor(key / 5))).otherwise(F.col("s_name"))
    df = supplier.select("s_suppkey", code.alias("code"), name.alias("name"))
    of_code = nation.where("n_nationkey < 10").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    of_code = of_code.select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("c_code"), F.col("r_name").alias("c_region"), F.col("n_name").alias("c_province"))
    at = F.col("s_nationkey").cast("string")
    of_name = supplier.where("s_suppkey % 4 = 0").groupBy(F.col("s_name").alias("n_name")).agg(F.min(F.struct("s_suppkey", F.concat(F.lit("R"), at).alias("r"), F.concat(F.lit("P"), at).alias("p"))).alias("x"))
    of_name = of_name.select("n_name", F.col("x.r").alias("n_region"), F.col("x.p").alias("n_province"))
    joined = df.join(of_code, F.upper(F.trim("code")) == F.col("c_code"), "left").join(of_name, F.trim("name") == F.col("n_name"), "left")
    region, province = fn.place(F.col("code"), F.col("name"), (F.col("c_region"), F.col("c_province")), (F.col("n_region"), F.col("n_province")))
    return joined.select("s_suppkey", region.alias("region"), province.alias("province"))


SKILLS = ["MS  Excel", "photoshop ", "node-js 3d", "Teamwork", "c++", "html5", "CSS", "giao tiếp", "kế toán", "x", "adobe photoshop", "đàm phán", "Trung Thực"]
_RAW = f"SELECT p_partkey, p_brand, unnest([({_list(SKILLS)})[(p_partkey % {len(SKILLS)} + 1)::INT], ({_list(SKILLS)})[(p_size % {len(SKILLS)} + 1)::INT]]) AS raw FROM part"
_TITLE = "list_aggregate(list_transform(regexp_extract_all(trim(raw), '[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+'), lambda r: upper(r[1]) || lower(r[2:])), 'string_agg', '')"
_NAMED = f"coalesce(CASE regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g') {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in fn.TECHNICAL.items())} END, {_TITLE})"
_LISTS = f"""raw AS ({_RAW}), named AS (SELECT p_brand, p_partkey, {_NAMED} AS skill FROM raw WHERE length(trim(raw)) >= 2),
  counts AS (SELECT p_brand, skill, count(*) AS n, min(p_partkey) AS first_seen FROM named GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first_seen, skill) AS place FROM counts),
  kept AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY place) AS rank FROM top WHERE place <= 20 AND skill NOT IN ({", ".join(f"'{s}'" for s in dict.fromkeys(fn.SOFT.values()))}))"""


def _skill_lists(spark, sf_dir):
    """Up to ten technical skills of a brand, the most frequent first, then the first seen."""
    both = F.explode(F.array(_pick(SKILLS, F.col("p_partkey")), _pick(SKILLS, F.col("p_size"))))
    raw = table(spark, sf_dir, "part").select("p_brand", "p_partkey", both.alias("raw")).where(F.length(F.trim("raw")) >= 2)
    counts = raw.groupBy("p_brand", fn.skill(F.col("raw"), fn.TECHNICAL).alias("skill")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_seen"))
    place = Window.partitionBy("p_brand").orderBy(F.desc("n"), "first_seen", "skill")
    top = counts.withColumn("place", F.row_number().over(place)).where("place <= 20").where(~F.col("skill").isin(sorted(set(fn.SOFT.values()))))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("place"))).where("rank <= 10")


@query(f"WITH {_LISTS} SELECT p_brand, string_agg(skill, ';' ORDER BY rank) AS skills, sum(n)::BIGINT AS n FROM kept WHERE rank <= 10 GROUP BY 1")
def skill_lists(spark, sf_dir):
    """Skills under the names that stand for them, or in title case, as an ordered list for each brand."""
    lists = _skill_lists(spark, sf_dir).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("rank", "skill"))).alias("s"), F.sum("n").alias("n"))  # ten each
    return lists.select("p_brand", F.array_join(F.transform("s", lambda x: x["skill"]), ";").alias("skills"), "n")


@query(f"""WITH {_LISTS}, sectors AS (SELECT p_brand, count(*) AS postings FROM part GROUP BY 1 ORDER BY postings DESC, p_brand LIMIT 6),
  each AS (SELECT p_brand, CASE WHEN p_brand > 'Brand#15' THEN upper(skill) ELSE skill END AS skill, rank, row_number() OVER (ORDER BY postings DESC, p_brand, rank) AS seen FROM kept JOIN sectors USING (p_brand) WHERE rank <= 10)
  SELECT lower(skill) AS key, min_by(skill, seen) AS label, count(DISTINCT p_brand) AS sectors FROM each GROUP BY 1 ORDER BY sectors DESC, key LIMIT 8""")
def skills_in_demand(spark, sf_dir):
    """In how many of the six largest sectors a skill is listed, under the spelling that comes first."""
    sectors = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("postings")).orderBy(F.desc("postings"), "p_brand").limit(6)
    each = _skill_lists(spark, sf_dir).join(F.broadcast(sectors), "p_brand")  # six rows
    each = each.withColumn("skill", F.when(F.col("p_brand") > "Brand#15", F.upper("skill")).otherwise(F.col("skill")))
    seen = F.struct(-F.col("postings"), "p_brand", "rank")
    found = each.groupBy(F.lower("skill").alias("key")).agg(F.min_by("skill", seen).alias("label"), F.count_distinct("p_brand").alias("sectors"))
    return found.orderBy(F.desc("sectors"), "key").limit(8)


_QUESTION = """CASE c_custkey % 6 WHEN 0 THEN 'Em được ' || (c_custkey % 40) || ',5 điểm khối a00 thì sao' WHEN 1 THEN 'Điểm ' || (c_custkey % 35) || ' tổ_hợp D01?' WHEN 2 THEN 'XA01 hay B001 với 25đ' WHEN 3 THEN 'được 123 điểm'
  WHEN 4 THEN 'ĐIỂM_' || (c_custkey % 30) || '.75, C' || (10 + c_custkey % 80) ELSE 'không rõ' END"""


@query(f"""WITH q AS (SELECT c_custkey, {_QUESTION} AS question FROM customer), f AS (SELECT *, replace(replace(strip_accents(lower(question)), 'đ', 'd'), '_', ' ') AS plain FROM q),
  n AS (SELECT *, try_cast(replace(coalesce(nullif(regexp_extract(plain, '(?:^|[^0-9])([0-9]{{1,2}}(?:[.,][0-9]{{1,2}})?)\\s*(?:diem|d)\\b', 1), ''), nullif(regexp_extract(plain, '\\bdiem\\s*([0-9]{{1,2}}(?:[.,][0-9]{{1,2}})?)(?:$|[^0-9])', 1), '')), ',', '.') AS DOUBLE) AS said FROM f)
  SELECT c_custkey, coalesce(nullif(regexp_extract(upper(question), '(?:^|[^A-Z0-9])([A-D][0-9]{{2}})(?:$|[^A-Z0-9])', 1), ''), 'A01') AS combination, CASE WHEN said BETWEEN 0 AND 30 THEN said ELSE 20.5 END AS score FROM n""")
def questions_asked(spark, sf_dir):
    """Combination and score of questions in both orders of words, with commas, or the ones of the profile."""
    n = F.col("c_custkey")
    text = lambda m: (n % m).cast("string")
    forms = [
        F.concat(F.lit("Em được "), text(40), F.lit(",5 điểm khối a00 thì sao")), F.concat(F.lit("Điểm "), text(35), F.lit(" tổ_hợp D01?")), F.lit("XA01 hay B001 với 25đ"), F.lit("được 123 điểm"),
        F.concat(F.lit("ĐIỂM_"), text(30), F.lit(".75, C"), (10 + n % 80).cast("string")), F.lit("không rõ"),
    ]
    question = F.element_at(F.array(*forms), (n % 6 + 1).cast("int"))
    df = table(spark, sf_dir, "customer").select("c_custkey", question.alias("question"))
    combination, score = fn.asked(F.col("question"), F.lit("A01"), F.lit(20.5))
    return df.select("c_custkey", combination.alias("combination"), score.alias("score"))


SCHOOL_NAMES = ["Trường Đại học Bách khoa", "Đại học", "ĐH Y Dược TP. HCM", "Đại Học Luật Thành phố Hồ Chí Minh", "Trường ĐH Trưng Vương", None]


@query(f"""WITH s AS (SELECT s_suppkey, s_name, ({_list(SCHOOL_NAMES)})[(s_suppkey % {len(SCHOOL_NAMES)} + 1)::INT] AS name FROM supplier),
  t AS (SELECT s_suppkey, s_name, regexp_replace(regexp_replace({_FOLD.format("name")}, '\\btruong\\b', ' ', 'g'), '\\bdai hoc\\b', ' ', 'g') AS k FROM s)
  SELECT s_suppkey, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(k, 'thanh pho ho chi minh', 'tphcm'), '\\btp hcm\\b', 'tphcm', 'g'), '\\s+', ' ', 'g')), ''), s_name) AS entity FROM t""")
def institution_names(spark, sf_dir):
    """Names as they are compared, or the code where nothing is left."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.institution(_pick(SCHOOL_NAMES, F.col("s_suppkey")), F.col("s_name")).alias("entity"))


# Levels of the year before, and of all earlier years, finest first, each with its label.
BEFORE = [("place", ["nation", "segment"]), ("nation_combo", ["nation", "combo"]), ("segment_combo", ["segment", "combo"]), ("combo", ["combo"]), ("global", [])]
EARLIER = [("nation_combo", ["nation", "combo"]), ("segment_combo", ["segment", "combo"]), ("nation", ["nation"]), ("segment", ["segment"]), ("combo", ["combo"]), ("global", [])]
SPARSE = "(nation + length(segment) + ascii(combo) * 2 + year) % 4 > 0 AND NOT (nation % 7 = 2 AND year % 2 = 0) AND NOT (segment = 'BUILDING' AND year < 1998)"


def _fallback_sql() -> str:
    joins, prev, hist = "", [("s1.target", "exact")], []
    for name, keys in BEFORE:
        by, on = "".join(f"{k}, " for k in keys), "".join(f" AND b_{name}.{k} = s.{k}" for k in keys)
        joins += f" LEFT JOIN (SELECT {by}year, avg(target) AS m FROM thin GROUP BY {by}year) b_{name} ON b_{name}.year = s.year - 1{on}"
        prev.append((f"b_{name}.m", name))
    for name, keys in EARLIER:
        on = "".join(f" AND x.{k} = s.{k}" for k in keys)
        joins += f" LEFT JOIN LATERAL (SELECT avg(x.target) AS m FROM thin x WHERE x.year < s.year{on}) h_{name} ON true"
        hist.append((f"h_{name}.m", name))
    label = lambda pairs: "CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN '{n}'" for v, n in pairs) + " ELSE 'unavailable' END"
    first = lambda pairs: f"round(coalesce({', '.join(v for v, _ in pairs)}), 4)"
    last = [("(SELECT max_by(x.target, x.year) FROM thin x WHERE x.nation = s.nation AND x.segment = s.segment AND x.combo = s.combo AND x.year < s.year)", "last"), *hist]
    return f"""WITH {CTE}, thin AS (SELECT * FROM series WHERE {SPARSE})
      SELECT s.nation, s.segment, s.combo, s.year, {first(prev)} AS before, {label(prev)} AS before_level, {first(hist)} AS earlier, {label(hist)} AS earlier_level, {first(last)} AS hybrid, {label(last)} AS hybrid_level
      FROM thin s LEFT JOIN thin s1 ON s1.nation = s.nation AND s1.segment = s.segment AND s1.combo = s.combo AND s1.year = s.year - 1{joins}"""


@query(_fallback_sql())
def three_hierarchies(spark, sf_dir):
    """Guesses by three hierarchies of six levels and more, each with the level that gave it."""
    base = ops.store_rows(series(spark, sf_dir).where(SPARSE))
    df = ops.lag_features(base, KEYS)
    for name, keys in BEFORE:
        df = ops.previous_year_group(df, keys, f"b_{name}", base=base)
    for name, keys in EARLIER:
        df = ops.prior_group_history(df, keys, f"h_{name}", base=base)
    before = [("exact", F.col("lag_1_year")), *[(n, F.col(f"b_{n}_mean")) for n, _ in BEFORE]]
    earlier = [(n, F.col(f"h_{n}_mean")) for n, _ in EARLIER]
    out = []
    for name, values in (("before", before), ("earlier", earlier), ("hybrid", [("last", F.col("last_observed")), *earlier])):
        value, label = ops.first_available(values)
        out += [F.round(value, 4).alias(name), F.coalesce(label, F.lit("unavailable")).alias(f"{name}_level")]
    return df.select(*KEYS, "year", *out)
