"""Exam rows: block scores, summaries over all measures, and the row validator.

Stand-in rows come of customers; scores are quarters, so sums are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import validate
from .registry import query, table

# Subjects, and the three subjects that each combination adds up.
SUBJECTS = (
    "math", "literature", "physics", "chemistry", "biology", "history", "geography", "civics", "economics_law",
    "informatics", "industrial_technology", "agricultural_technology", "foreign_language",
)
COMBINATIONS = {
    "a00": ("math", "physics", "chemistry"),
    "a01": ("math", "physics", "foreign_language"),
    "a02": ("math", "physics", "biology"),
    "b00": ("math", "chemistry", "biology"),
    "c00": ("literature", "history", "geography"),
    "c01": ("literature", "math", "physics"),
    "c02": ("literature", "math", "chemistry"),
    "d01": ("math", "literature", "foreign_language"),
    "d07": ("math", "chemistry", "foreign_language"),
}
MEASURES = (*SUBJECTS, *COMBINATIONS)


def _score_sql(k: int) -> str:
    return f"CASE WHEN (c_custkey * {k + 3} + {k}) % 7 > 0 THEN ((c_custkey * {2 * k + 5}) % 41) / 4.0 END"


SCORES_SQL = "SELECT c_custkey, c_nationkey, " + ", ".join(f"{_score_sql(k)} AS {s}" for k, s in enumerate(SUBJECTS)) + " FROM customer"
BLOCKS_SQL = f"WITH s AS ({SCORES_SQL}) SELECT *, " + ", ".join(f"{' + '.join(parts)} AS {name}" for name, parts in COMBINATIONS.items()) + " FROM s"


def with_combinations(df: DataFrame) -> DataFrame:
    """Adds each combination's sum: null unless all three subjects are there."""
    return df.withColumns({name: exprs.sum_all_or_null(*map(F.col, parts)) for name, parts in COMBINATIONS.items()})


def _scores(spark, sf_dir):
    i = F.col("c_custkey")
    scores = [F.when((i * (k + 3) + k) % 7 > 0, ((i * (2 * k + 5)) % 41) / 4.0).alias(s) for k, s in enumerate(SUBJECTS)]
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *scores)


@query(f"SELECT c_custkey, {', '.join(COMBINATIONS)} FROM ({BLOCKS_SQL})")
def exam_combinations(spark, sf_dir):
    return with_combinations(_scores(spark, sf_dir)).select("c_custkey", *COMBINATIONS)


@query("SELECT (c_custkey % 6 + 2018)::INT AS year, c_nationkey AS province, count(*) AS candidate_count, " + ", ".join(f"round(avg({m}), 4) AS mean_{m}, count({m}) AS count_{m}" for m in MEASURES) + f" FROM ({BLOCKS_SQL}) GROUP BY 1, 2")
def exam_summary_all_measures(spark, sf_dir):
    """Mean and count of all 22 measures in one partial and one final aggregate."""
    df = with_combinations(_scores(spark, sf_dir)).groupBy((F.col("c_custkey") % 6 + 2018).cast("int").alias("year"), F.col("c_nationkey").alias("province"))
    each = [a for m in MEASURES for a in (F.round(F.avg(m), 4).alias(f"mean_{m}"), F.count(m).alias(f"count_{m}"))]
    return df.agg(F.count(F.lit(1)).alias("candidate_count"), *each)


# Source columns of the validator, in its order.
RAW_SUBJECTS = ("Toan", "NguVan", "NgoaiNgu", "VatLy", "HoaHoc", "SinhHoc", "LichSu", "DiaLy", "GDCD")
RAW_AVERAGES = ("KHTN", "KHXH")
RAW_BLOCKS = ("KhoiA", "KhoiA1", "KhoiB", "KhoiC", "KhoiD", "KhoiA02", "KhoiC01", "KhoiD07")
RAW_TOTALS = ("TongDiem", "TongDiemKHTN", "TongDiemKHXH")
# Formulas, as (divisor, parts).
FORMULAS = {
    "KhoiA": (1, ("Toan", "VatLy", "HoaHoc")),
    "KhoiA1": (1, ("Toan", "VatLy", "NgoaiNgu")),
    "KhoiB": (1, ("Toan", "HoaHoc", "SinhHoc")),
    "KhoiC": (1, ("NguVan", "LichSu", "DiaLy")),
    "KhoiD": (1, ("Toan", "NguVan", "NgoaiNgu")),
    "KHTN": (3, ("VatLy", "HoaHoc", "SinhHoc")),
    "KHXH": (3, ("LichSu", "DiaLy", "GDCD")),
    "KhoiA02": (1, ("Toan", "VatLy", "SinhHoc")),
    "KhoiC01": (1, ("NguVan", "Toan", "VatLy")),
    "KhoiD07": (1, ("Toan", "HoaHoc", "NgoaiNgu")),
}
RAW = (*RAW_SUBJECTS, *RAW_AVERAGES, *RAW_BLOCKS, *RAW_TOTALS)
RULES = validate.Rules(
    year=2023,
    ranges=[(RAW_SUBJECTS + RAW_AVERAGES, 10), (RAW_BLOCKS, 30), (RAW_TOTALS, 90)],
    subjects=RAW_SUBJECTS,
    formulas=FORMULAS,
)


def _faulty(i, when, lit, text):
    """Raw text columns by an id, some of them faulty; the same rules for both engines."""
    ids = {
        "SBD": when([(i % 17 == 0, lit("12x4")), (i % 19 == 0, lit("123456789"))], text(i % 90000000 + 1000000)),
        "Nam": when([(i % 23 == 0, lit("22"))], lit("2023")),
        "Tinh": when([(i % 29 == 0, lit(""))], lit("1")),
        "SBD_New": when([(i % 31 == 0, lit("7"))], text(i % 1000000)),
        "MaMonNgoaiNgu": when([(i % 3 == 0, lit("n1")), (i % 37 == 0, lit("N9"))], lit("")),
    }
    return ids


def _raw(spark, sf_dir):
    i = F.col("c_custkey")

    def when(cases, other):
        out = None
        for c, v in cases:
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)

    ids = _faulty(i, when, F.lit, lambda c: c.cast("string"))
    marks = {s: F.when((i + k) % 4 > 0, ((i * (k + 3)) % (45 if k == 0 else 41) / 4.0).cast("decimal(9,2)").cast("string")).otherwise("") for k, s in enumerate(RAW_SUBJECTS)}
    df = table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in {**ids, **marks}.items()])
    value = lambda s: F.col(s).try_cast("decimal(12,4)")
    made = {}
    for k, name in enumerate((*RAW_AVERAGES, *RAW_BLOCKS)):
        divisor, parts = FORMULAS[name]
        total = value(parts[0]) + value(parts[1]) + value(parts[2])
        made[name] = F.when((i + k) % 13 == 0, "x1").when((i + k) % 11 == 0, "31.5").otherwise(F.coalesce((total / divisor).cast("decimal(12,2)").cast("string"), F.lit("")))
    every = sum((F.coalesce(value(s), F.lit(0).cast("decimal(12,4)")) for s in RAW_SUBJECTS[1:]), F.coalesce(value(RAW_SUBJECTS[0]), F.lit(0).cast("decimal(12,4)")))
    made["TongDiem"] = F.when(i % 5 == 0, "95").when(i % 5 == 1, "").otherwise(every.cast("decimal(12,2)").cast("string"))
    return df.withColumns(made).withColumns({"TongDiemKHTN": F.lit(""), "TongDiemKHXH": F.when(i % 41 == 0, "-1").otherwise("")})


def _raw_sql() -> str:
    marks = ", ".join(f"CASE WHEN (c_custkey + {k}) % 4 > 0 THEN ((c_custkey * {k + 3}) % {45 if k == 0 else 41} / 4.0)::DECIMAL(9,2)::VARCHAR ELSE '' END AS {s}" for k, s in enumerate(RAW_SUBJECTS))
    ids = """CASE WHEN c_custkey % 17 = 0 THEN '12x4' WHEN c_custkey % 19 = 0 THEN '123456789' ELSE (c_custkey % 90000000 + 1000000)::VARCHAR END AS SBD,
      CASE WHEN c_custkey % 23 = 0 THEN '22' ELSE '2023' END AS Nam, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE '1' END AS Tinh,
      CASE WHEN c_custkey % 31 = 0 THEN '7' ELSE (c_custkey % 1000000)::VARCHAR END AS SBD_New,
      CASE WHEN c_custkey % 3 = 0 THEN 'n1' WHEN c_custkey % 37 = 0 THEN 'N9' ELSE '' END AS MaMonNgoaiNgu"""
    v = lambda s: f"try_cast(nullif({s}, '') AS DECIMAL(12,4))"
    made = []
    for k, name in enumerate((*RAW_AVERAGES, *RAW_BLOCKS)):
        divisor, parts = FORMULAS[name]
        total = "(" + " + ".join(map(v, parts)) + ")"
        total = f"round({total} / {divisor}, 2)::DECIMAL(12,2)::VARCHAR"
        made.append(f"CASE WHEN (c_custkey + {k}) % 13 = 0 THEN 'x1' WHEN (c_custkey + {k}) % 11 = 0 THEN '31.5' ELSE coalesce({total}, '') END AS {name}")
    every = " + ".join(f"coalesce({v(s)}, 0)" for s in RAW_SUBJECTS)
    made.append(f"CASE WHEN c_custkey % 5 = 0 THEN '95' WHEN c_custkey % 5 = 1 THEN '' ELSE ({every})::DECIMAL(12,2)::VARCHAR END AS TongDiem")
    made += ["'' AS TongDiemKHTN", "CASE WHEN c_custkey % 41 = 0 THEN '-1' ELSE '' END AS TongDiemKHXH"]
    return f"a AS (SELECT c_custkey, {ids}, {marks} FROM customer), raw AS (SELECT *, {', '.join(made)} FROM a)"


def _codes_sql() -> str:
    v = lambda s: f"try_cast(nullif(trim({s}), '') AS DECIMAL(18,6))"
    codes = []
    for name, width in (("SBD", 8), ("Nam", 0), ("Tinh", 2), ("SBD_New", 6)):
        if not width:
            codes.append("CASE WHEN trim(Nam) NOT IN ('2023', '23') THEN 'Nam:khong_khop_nam_file' END")
            continue
        codes.append(f"CASE WHEN NOT regexp_full_match(trim({name}), '[0-9]+') THEN '{name}:khong_hop_le' WHEN length(trim({name})) > {width} THEN '{name}:vuot_qua_{width}_chu_so' END")
    pad = lambda n, w: f"CASE WHEN regexp_full_match(trim({n}), '[0-9]+') AND length(trim({n})) <= {w} THEN lpad(trim({n}), {w}, '0') ELSE trim({n}) END"
    sbd, full = f"({pad('SBD', 8)})", f"regexp_full_match({pad('SBD', 8)}, '[0-9]{{8}}')"
    codes.append(f"CASE WHEN NOT {full} THEN 'SBD:khong_du_8_chu_so' WHEN ({pad('Tinh', 2)}) <> {sbd}[1:2] THEN 'Tinh:khong_khop_SBD' END")
    codes.append(f"CASE WHEN {full} AND ({pad('SBD_New', 6)}) <> {sbd}[3:] THEN 'SBD_New:khong_khop_SBD' END")
    codes += [f"CASE WHEN trim({s}) <> '' AND {v(s)} IS NULL THEN '{s}:khong_phai_so' END" for s in RAW]
    for names, most in RULES.ranges:
        codes += [f"CASE WHEN NOT {v(s)} BETWEEN 0 AND {most} THEN '{s}:ngoai_khoang_0_{most}' END" for s in names]
    code = "upper(trim(MaMonNgoaiNgu))"
    codes.append(f"CASE WHEN {code} <> '' AND NOT regexp_full_match({code}, 'N[1-7]') THEN 'MaMonNgoaiNgu:khong_hop_le' END")
    codes.append(f"CASE WHEN ({code} <> '') <> ({v('NgoaiNgu')} IS NOT NULL) THEN 'MaMonNgoaiNgu:khong_dong_bo_diem_ngoai_ngu' END")
    every = " + ".join(f"coalesce({v(s)}, 0)" for s in RAW_SUBJECTS)
    codes.append(f"CASE WHEN abs({v('TongDiem')} - ({every})) > 0.01 THEN 'TongDiem:sai_tong_cac_mon' END")
    for name, (divisor, parts) in FORMULAS.items():
        codes.append(f"CASE WHEN abs({v(name)} * {divisor} - ({' + '.join(map(v, parts))})) > {divisor} * 0.01 THEN '{name}:sai_cong_thuc' END")
    return ", ".join(codes)


@query(f"WITH {_raw_sql()} SELECT c_custkey, array_to_string(list_filter([{_codes_sql()}], lambda x: x IS NOT NULL), ';') AS codes FROM raw")
def exam_row_validator(spark, sf_dir):
    """All codes of each row, in the order in which they are found."""
    return _raw(spark, sf_dir).select("c_custkey", F.array_join(validate.codes(RULES), ";").alias("codes"))


_V = "try_cast(nullif(trim({0}), '') AS DECIMAL(18,6))"
_EVERY = " + ".join(f"coalesce({_V.format(s)}, 0)" for s in RAW_SUBJECTS)
CHECKS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS formula, count(*) FILTER (WHERE ok) AS checked, count(*) FILTER (WHERE NOT ok) AS skipped, count(*) FILTER (WHERE ok AND apart) AS mismatched FROM (SELECT {able} AS ok, coalesce({apart}, false) AS apart FROM raw)"
    for name, able, apart in [
        *[(n, " AND ".join(f"{_V.format(s)} IS NOT NULL" for s in (n, *parts)), f"abs({_V.format(n)} * {d} - ({' + '.join(_V.format(x) for x in parts)})) > {d} * 0.01") for n, (d, parts) in FORMULAS.items()],
        ("TongDiem", f"{_V.format('TongDiem')} IS NOT NULL", f"abs({_V.format('TongDiem')} - ({_EVERY})) > 0.01"),
    ]
)


@query(f"WITH {_raw_sql()} {CHECKS_SQL}")
def exam_formula_checks(spark, sf_dir):
    """How many rows each formula and the total were checked on, skipped on, and didn't hold on."""
    value: dict[str, Column] = {s: validate.number(s) for s in RAW}
    able = {name: sum((value[p].isNotNull().cast("int") for p in parts), value[name].isNotNull().cast("int")) == len(parts) + 1 for name, (_, parts) in FORMULAS.items()}
    able["TongDiem"] = value["TongDiem"].isNotNull()
    df = _raw(spark, sf_dir).withColumn("codes", validate.codes(RULES))
    apart = lambda name: F.array_contains("codes", f"{name}:{'sai_tong_cac_mon' if name == 'TongDiem' else 'sai_cong_thuc'}")
    each = [F.struct(F.lit(n).alias("formula"), F.count_if(c).alias("checked"), F.count_if(~c).alias("skipped"), F.count_if(apart(n)).alias("mismatched")) for n, c in able.items()]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))
