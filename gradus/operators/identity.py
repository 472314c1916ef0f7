"""Identities of institutions and programmes over the years, and the queue of what is to be reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as fn

HIGH, MEDIUM = "high", "medium"
# What is to be done about each kind of item.
ACTIONS = {
    "institution_code_reuse": "Confirm that each normalized institution entity is a distinct school/campus.",
    "program_code_reuse": "Confirm the split program series; never combine unrelated historical cutoffs.",
    "major_code_conflict": "Verify the official major code by year.",
    "sensitive_source_note": "Decide whether program variant/scope must become a model feature.",
    "candidate_split_by_program_identity": "Verify distinct major/program identities; do not average their cutoffs.",
    "candidate_split_by_gender_or_campus": "Add candidate scope/campus to the product requirements before restoring.",
    "unresolved_conflicting_cutoffs": "Check the original source or official admission notice.",
    "other_rejection": "Inspect source row manually.",
    "out_of_scope_non_thpt": "Keep outside the THPTQG cutoff prediction dataset.",
    "unsupported_nonstandard_combination": "Verify whether this is an aptitude/competency route or a malformed subject combination.",
    "score_scale_mismatch": "Verify the original scale and normalization rule.",
}
AMBIGUOUS = "ambiguous_target_for_modeling_key"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _joined(value: Column, sep: str = " || ") -> Column:
    """Sorted distinct values that aren't blank, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(value.cast("string")), F.lit("")))), sep)


def prepared(df: DataFrame) -> DataFrame:
    """Adds normalised names and the keys of institutions and programme series."""
    fallback = lambda name, code: F.coalesce(F.nullif(name, F.lit("")), fn.slug(F.coalesce(F.col(code), F.lit(""))))
    df = df.withColumn("institution_name", rules.institution(F.col("university_name"), fn.slug(F.coalesce("university_code", F.lit("")))))
    df = df.withColumn("entity", F.concat(_text("university_admission_code"), F.lit("|"), F.col("institution_name")))
    df = df.withColumn("major_normal", fallback(fn.slug(F.coalesce("major_name", F.lit(""))), "major_code"))
    return df.withColumn("series", F.concat("entity", F.lit("|"), _text("major_admission_code"), F.lit("|"), F.col("major_normal")))


def display(df: DataFrame, key: str, column: str, order: str, out: str) -> DataFrame:
    """The value of each key that is shown: of the newest year, of those the most frequent at all, then the first row's.

    Rows are counted by value first, so a key may hold any number of them.
    """
    there = df.where(_text(column) != "")
    values = there.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("year")).alias("back"), order)).alias("newest"))
    return values.groupBy(key).agg(F.trim(F.min_by(column, F.struct(F.col("newest.back"), (-F.col("n")).alias("rare"), F.col(f"newest.{order}")))).alias(out))


def institution_map(df: DataFrame, order: str) -> DataFrame:
    """A row an institution: names, codes, years, rows, and how many share its admission code."""
    each = df.groupBy("entity").agg(
        F.min(_text("university_admission_code")).alias("admission_code"), _joined(F.col("university_name")).alias("name_variants"), _joined(F.col("university_code")).alias("code_variants"),
        F.array_join(F.array_sort(F.collect_set("year")), ";").alias("years"), F.count_distinct("year").alias("year_count"), F.count(F.lit(1)).alias("row_count"),
    )
    sharing = each.groupBy("admission_code").agg(F.count(F.lit(1)).alias("sharing"))
    out = each.join(sharing, "admission_code").join(display(df, "entity", "university_name", order, "canonical_name"), "entity", "left")
    return out.withColumns({"canonical_name": F.coalesce("canonical_name", F.lit("")), "code_reuse": F.col("sharing") > 1})


def program_map(df: DataFrame, order: str) -> DataFrame:
    """A row a programme series, with its variants, counts, status and flags."""
    n = lambda c: F.count_distinct(F.col(c))
    each = df.groupBy("series").agg(
        F.min("entity").alias("entity"), F.min(_text("university_admission_code")).alias("admission_code"), F.min(_text("major_admission_code")).alias("major_admission_code"), F.min("major_normal").alias("major_normal"),
        _joined(F.col("major_name")).alias("name_variants"), _joined(F.col("major_code")).alias("code_variants"), _joined(F.col("major_group_name")).alias("group_variants"),
        F.array_join(F.array_sort(F.collect_set("year")), ";").alias("years"), n("year").alias("year_count"), F.count(F.lit(1)).alias("row_count"),
        n("major_name").alias("raw_names"), n("major_code").alias("code_count"), n("major_group_name").alias("group_count"),
    )
    parent = ["entity", "major_admission_code"]
    sharing = each.groupBy(*parent).agg(F.count_distinct("major_normal").alias("names_sharing_code"))
    out = each.join(sharing, parent).join(display(df, "series", "major_name", order, "canonical_name"), "series", "left")
    status = F.when(F.col("major_normal") == "", "review_missing_major_name").when(F.col("names_sharing_code") > 1, "split_program_code_reuse").when(F.col("raw_names") > 1, "safe_text_normalization").otherwise("stable_exact_name")
    return out.select(
        "series", "entity", "admission_code", "major_admission_code", F.coalesce("canonical_name", F.lit("")).alias("canonical_name"), "name_variants", "code_variants", "group_variants", "years", "year_count", "row_count",
        "names_sharing_code", "code_count", "group_count", status.alias("status"), (F.col("names_sharing_code") > 1).alias("code_reuse"), (F.col("code_count") > 1).alias("code_conflict"), (F.col("group_count") > 1).alias("groups_changed"),
    )


def ambiguous_groups(rejected: DataFrame, key: list[str]) -> DataFrame:
    """key with the class of its conflicting targets, their values and rows; rejected: prepared rows with target, gender and campus.

    Nulls are values of their own. Groups are counted from the finest scope up.
    """
    rows = rejected.where(F.col("reason") == AMBIGUOUS)
    scoped = rows.groupBy(*key, "major_code", "major_normal", "gender", "campus").agg(F.count_distinct("target").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"), F.count(F.lit(1)).alias("rows"), F.collect_set("target").alias("targets"))
    named = scoped.groupBy(*key, "major_code", "major_normal").agg(F.max("n").alias("most_scoped"), F.count(F.lit(1)).alias("scopes"), (F.min("low") == F.max("high")).alias("one"), F.sum("rows").alias("rows"), F.flatten(F.collect_list("targets")).alias("targets"))
    each = named.groupBy(*key).agg(F.count(F.lit(1)).alias("identities"), F.min(F.coalesce("one", F.lit(True))).alias("one_each"), F.sum("scopes").alias("scopes"), F.max("most_scoped").alias("most"), F.sum("rows").alias("rows"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("targets")), lambda x: x.cast("string")))), ";").alias("values"))
    kind = F.when((F.col("identities") > 1) & F.col("one_each"), "candidate_split_by_program_identity").when((F.col("scopes") > 1) & (F.col("most") <= 1), "candidate_split_by_gender_or_campus").otherwise("unresolved_conflicting_cutoffs")
    return each.select(*key, kind.alias("ambiguity_class"), "rows", "values")


def rejection_category(reason: Column) -> Column:
    """What a rejected row's reason comes to, the last that fits."""
    text = F.coalesce(reason, F.lit(""))
    other = text.contains("non_thpt_admission_method")
    return (
        F.when(text.contains("cutoff_score_30_outside_0_30"), "score_scale_mismatch")
        .when(text.contains("invalid_subject_combination") & ~other, "unsupported_nonstandard_combination")
        .when(other, "out_of_scope_non_thpt")
        .otherwise("other_rejection")
    )


def review_queue(df: DataFrame, institutions: DataFrame, programs: DataFrame, ambiguous: DataFrame, rejected: DataFrame, key: list[str]) -> DataFrame:
    """review_type, priority, review_key, affected_rows, details, recommended_action of all six kinds of items."""
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])

    def item(rows: DataFrame, kind: Column, priority: Column, name: Column, n: Column, details: Column, action: Column | None = None) -> DataFrame:
        made = rows.select(kind.alias("review_type"), priority.alias("priority"), name.alias("review_key"), n.cast("bigint").alias("affected_rows"), details.alias("details"), (kind if action is None else action).alias("action"))
        return made.withColumn("recommended_action", F.try_element_at(actions, "action")).drop("action")

    high = F.lit(HIGH)
    schools = institutions.where("code_reuse").groupBy("admission_code").agg(F.sum("row_count").alias("n"), _joined(F.col("canonical_name")).alias("names"))
    reused = programs.where("code_reuse").groupBy("entity", "major_admission_code").agg(F.sum("row_count").alias("n"), _joined(F.col("canonical_name")).alias("names"))
    notes = df.where(F.col("note_priority") == HIGH).groupBy("series").agg(F.count(F.lit(1)).alias("n"), _joined(F.col("note_category")).alias("notes"))
    rest = rejected.where(F.coalesce("reason", F.lit("")) != AMBIGUOUS).withColumn("category", rejection_category(F.col("reason")))
    rest = rest.groupBy("category", "combination").agg(F.count(F.lit(1)).alias("n"), _joined(F.col("method")).alias("methods"))
    parts = [
        item(schools, F.lit("institution_code_reuse"), high, F.col("admission_code"), F.col("n"), F.col("names")),
        item(reused, F.lit("program_code_reuse"), high, F.concat_ws("|", "entity", "major_admission_code"), F.col("n"), F.col("names")),
        item(programs.where("code_conflict"), F.lit("major_code_conflict"), high, F.col("series"), F.col("row_count"), F.col("code_variants")),
        item(notes, F.lit("sensitive_source_note"), high, F.col("series"), F.col("n"), F.col("notes")),
        item(ambiguous, F.lit("ambiguous_cutoff"), high, F.concat_ws("|", *[_text(k) for k in key]), F.col("rows"), F.concat_ws(": ", "ambiguity_class", "values"), F.col("ambiguity_class")),
        item(rest, F.col("category"), F.when(F.col("category") == "score_scale_mismatch", HIGH).otherwise(MEDIUM), F.coalesce(F.nullif(_text("combination"), F.lit("")), F.lit("<blank>")), F.col("n"), F.col("methods")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
