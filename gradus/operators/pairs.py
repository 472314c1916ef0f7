"""Pairs of names within groups: all of them, or similar ones by prefix filters.

Two sets with enough items in common share one of their rarest items: if a set must share m of
its n items, one of its n - m + 1 rarest is among the rarest of the other, too. Names are listed
under those alone, and met there: only pairs that could pass are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity


def _listed(names: DataFrame, items: Column, needed: Column) -> DataFrame:
    """group, name, size, rare (the items that may not all be missed, rarest first) and each of them as item."""
    own = names.select("group", "name", "size", needed.alias("needed"), items.alias("items")).where("size(items) > 0")
    each = own.select("group", "name", "size", "needed", F.size("items").alias("n"), F.explode("items").alias("item"))
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("count"))
    sorted_ = each.join(counts, "item").groupBy("group", "name", "size", "needed", "n").agg(F.array_sort(F.collect_list(F.struct("count", "item"))).alias("sorted"))
    keep = F.greatest(F.lit(1), F.col("n") - F.col("needed") + 1).cast("int")
    rare = F.transform(F.slice("sorted", F.lit(1), keep), lambda x: x["item"])
    return sorted_.select("group", "name", "size", rare.alias("rare")).withColumn("item", F.explode("rare"))


def _met(listed: DataFrame, could: Column) -> DataFrame:
    """group, a, b with a < b of names that share a rare item and could pass; each pair once, at the first they share."""
    a, b = listed.alias("a"), listed.alias("b")
    both = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.name") < F.col("b.name")))
    first = F.col("a.item") == F.array_intersect("a.rare", "b.rare")[0]
    return both.where(first & could).select(F.col("a.group").alias("group"), F.col("a.name").alias("a"), F.col("b.name").alias("b"))


def _names(df: DataFrame) -> DataFrame:
    return df.select("group", "name").where(F.col("group").isNotNull() & F.col("name").isNotNull()).distinct()


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))


def _between(least: float) -> Column:
    """Neither size is under the given share of the other."""
    slack = 1e-9
    return (F.col("a.size") >= least * F.col("b.size") - slack) & (F.col("b.size") >= least * F.col("a.size") - slack)


def by_words(df: DataFrame, least: float) -> DataFrame:
    """group, a, b, jaccard of names (group, name) whose words' Jaccard similarity is at least so much."""
    names = _names(df).withColumn("size", F.size(words(F.col("name"))))
    met = _met(_listed(names, words(F.col("name")), F.ceil(least * F.col("size") - 1e-9)), _between(least))
    return met.withColumn("jaccard", similarity.jaccard(words(F.col("a")), words(F.col("b")))).where(F.col("jaccard") >= least)


def every(df: DataFrame, parts: int = 8) -> DataFrame:
    """group, a, b of all pairs of a group's rows with a.name < b.name; a and b are the rows' other columns as structs.

    A group's names are dealt over parts by a hash, and each pair of parts is a key of its own:
    a group of any size is spread over parts * parts keys, and rows stream through each.
    """
    row = F.struct(*[c for c in df.columns if c != "group"])
    named = df.where(F.col("group").isNotNull() & F.col("name").isNotNull())
    own, each = F.pmod(F.hash("name"), F.lit(parts)), F.explode(F.array(*[F.lit(i) for i in range(parts)]))
    a = named.select("group", own.alias("of_a"), each.alias("of_b"), row.alias("a"))
    b = named.select("group", each.alias("of_a"), own.alias("of_b"), row.alias("b"))
    return a.join(b, ["group", "of_a", "of_b"]).where("a.name < b.name").select("group", "a", "b")


def _pieces(name: Column, size: int) -> Column:
    """Pieces of so many letters, each with how often it came before: repeats stay apart."""
    places = F.sequence(F.lit(1), F.length(name) - size + 1)
    each = F.transform(places, lambda i: F.substring(name, i, F.lit(size)))
    marked = F.transform(each, lambda x, i: F.concat(x, F.lit(" "), F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    return F.when(F.length(name) >= size, marked).otherwise(F.array().cast("array<string>"))


def could_match(df: DataFrame, least: float) -> DataFrame:
    """group, a, b of all pairs whose matching-blocks ratio can be at least so much (over 2/3).

    A ratio r of names of n and m letters leaves at least r * (n + m) / 2 letters in matching
    blocks, so neither is longer than 2 / r - 1 times the other. Of pieces of two letters, at
    least (1.5 * r - 1) * (n + m) - 1 lie within blocks. Where that is under one, in short
    names, single letters are compared.
    """
    if least <= 2 / 3:
        raise ValueError("the ratio must be over 2/3")
    longest = 2 / least - 1
    short = math.ceil(2 * (2 - least) / (1.5 * least - 1))
    names = _names(df).withColumn("size", F.length("name"))
    both = 2 * F.col("size") / (2 - least)  # the least letters of a name and its match
    near = _between(1 / longest)
    letters = _listed(names.where(F.col("size") < short * longest), _pieces(F.col("name"), 1), F.ceil(least / 2 * both - 1e-9))
    twos = _listed(names.where(F.col("size") >= short), _pieces(F.col("name"), 2), F.ceil((1.5 * least - 1) * both - 1e-9) - 1)
    either_short = (F.col("a.size") < short) | (F.col("b.size") < short)
    return _met(letters, near & either_short).unionByName(_met(twos, near))


def by_either(df: DataFrame, least: float) -> DataFrame:
    """group, a, b, ratio, jaccard, similarity: all pairs of which the greater of matching-blocks
    ratio and words' Jaccard similarity is at least so much."""
    pairs = could_match(df, least).unionByName(by_words(df, least).select("group", "a", "b")).distinct()
    pairs = pairs.withColumns({"ratio": similarity.sequence_ratio("a", "b"), "jaccard": similarity.jaccard(words(F.col("a")), words(F.col("b")))})
    return pairs.withColumn("similarity", F.greatest("ratio", "jaccard")).where(F.col("similarity") >= least)
