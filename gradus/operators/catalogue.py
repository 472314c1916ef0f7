"""Lookup in an ordered catalogue: by code, by names that hold one another, by code prefix, by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn

#: Letters of the pieces that names are indexed by.
GRAM = 3
# Words of a name and the group they stand for, in the order they are tried; the group of all others.
KEYWORDS = [
    (["kinh tế", "tài chính", "ngân hàng", "kế toán", "quản trị", "marketing"], "Kinh doanh và quản lý"),
    (["công nghệ", "phần mềm", "máy tính", "tin học", "dữ liệu", "trí tuệ nhân tạo"], "Máy tính và công nghệ thông tin"),
    (["kỹ thuật", "cơ khí", "điện", "điện tử", "tự động"], "Kỹ thuật và công nghệ kỹ thuật"),
    (["ngôn ngữ", "tiếng", "ngoại ngữ"], "Nhân văn và ngôn ngữ"),
]
OTHER = "Đào tạo đại học"


def clean_code(code: Column) -> Column:
    """The digits of a code; null as none."""
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"[^\p{Nd}]", "")


def clean_name(name: Column) -> Column:
    """Lower case, without notes in parentheses; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", "")))


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct pieces of so many letters; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    each = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def holding(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """All pairs (inner, outer) of distinct texts of which outer holds inner, which isn't empty.

    Outer texts are listed by their pieces of up to GRAM letters. Each inner text is looked for
    under its rarest piece there only, and what is found is compared. A text with a piece that
    no outer text has is in none of them.
    """
    listed = outer.select("outer", F.explode(F.flatten(F.array(*[_grams(F.col("outer"), k) for k in range(1, GRAM + 1)]))).alias("gram"))
    counts = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"))
    own = inner.where(F.length("inner") > 0).select("inner", F.explode(_grams(F.col("inner"), F.least(F.lit(GRAM), F.length("inner")))).alias("gram"))
    rarity = F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "gram")
    rarest = own.join(counts, "gram", "left").groupBy("inner").agg(F.min(rarity).alias("r")).where("r.n > 0").select("inner", F.col("r.gram").alias("gram"))
    return rarest.join(listed, "gram").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def ordered_lookup(asked: DataFrame, catalogue: DataFrame, keywords=KEYWORDS, other: str = OTHER) -> DataFrame:
    """code, name (both cleaned) asked for, with the entry (ordinal) found, its group and the basis.

    catalogue: ordinal, code, name, group. In this order: the entry of the code; the first entry
    whose name holds the name asked for or is held by it; the first whose code begins with the
    first four digits asked for, or three if there are fewer; the first of keywords with a word
    in the name; other. An empty name is held by the first entry that has a name.
    """
    ask = asked.select(clean_code(F.col("code")).alias("code"), clean_name(F.col("name")).alias("name")).distinct()
    entries = catalogue.select("ordinal", F.coalesce("code", F.lit("")).alias("entry_code"), clean_name(F.col("name")).alias("entry_name"), "group")
    by_code = entries.where("entry_code <> ''").groupBy(F.col("entry_code").alias("code")).agg(F.max("ordinal").alias("of_code"))  # a later entry replaces an earlier one
    names, held = ask.select("name").distinct(), entries.where("entry_name <> ''").groupBy("entry_name").agg(F.min("ordinal").alias("ordinal"))
    inner_entries = holding(held.select(F.col("entry_name").alias("inner")), names.select(F.col("name").alias("outer"))).select(F.col("outer").alias("name"), F.col("inner").alias("entry_name"))
    outer_entries = holding(names.select(F.col("name").alias("inner")), held.select(F.col("entry_name").alias("outer"))).select(F.col("inner").alias("name"), F.col("outer").alias("entry_name"))
    by_name = inner_entries.unionByName(outer_entries).join(held, "entry_name").groupBy("name").agg(F.min("ordinal").alias("of_name"))
    empty = held.agg(F.min("ordinal").alias("of_name")).select(F.lit("").alias("name"), "of_name")
    prefixes = entries.select("ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.when(F.length("entry_code") >= k, F.substring("entry_code", F.lit(1), k)))).alias("prefix"))
    by_prefix = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("ordinal").alias("of_prefix"))
    prefix = F.when(F.length("code") >= 4, F.substring("code", 1, 4)).otherwise(F.substring("code", 1, 3))
    df = ask.withColumn("prefix", prefix).join(by_code, "code", "left").join(by_name.unionByName(empty), "name", "left").join(by_prefix, "prefix", "left")
    entry = F.coalesce("of_code", "of_name", "of_prefix")
    found = df.select("code", "name", entry.alias("entry"), F.when(F.col("of_code").isNotNull(), "code").when(F.col("of_name").isNotNull(), "name").when(F.col("of_prefix").isNotNull(), "prefix").alias("found"))
    found = found.join(catalogue.select(F.col("ordinal").alias("entry"), "group"), "entry", "left")
    word = F.lit(None).cast("string")
    for words, group in reversed(keywords):
        word = F.when(fn.contains_any(F.col("name"), words), group).otherwise(word)
    basis = F.coalesce("found", F.when(word.isNotNull(), "keyword"), F.lit("default"))
    return found.select("code", "name", "entry", F.when(F.col("found").isNotNull(), F.col("group")).otherwise(F.coalesce(word, F.lit(other))).alias("group"), basis.alias("basis"))
