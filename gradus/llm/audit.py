"""Interaction of document filters, by a CUBE over their failure flags and a part.

Each document gets one boolean a filter: true where it fails. Documents with the same flags
and part are counted together, and a CUBE over part and flags of these cells counts every
combination. In the grouping set of a subset S of filters, the row whose selected flags are
all false counts what survives S. A step of an order adds one filter to the subset before it,
so joining the two subsets gives what the step keeps and removes. All orders of the filters
are laid out as pairs of subsets: their number depends on the filters alone.

Filters: A few words, B repeated words, C many capitals, D marks, E text that a smaller
doc_id has too. For E the least id of each text is found by its SHA-256, then the ids are
told apart by joining on text and id together, so that a group of copies, however large, is
spread over all tasks. Texts are read once, in place, and never shuffled.

Defined cases: null text is empty; a null or empty part is ''; blank text has no words (A
fails, B and C pass); rows that repeat both id and text are each counted, and none is the
other's copy; a null id has no smaller one and is none; labels that repeat an id count if any
of them is 1, missing ones are 0; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import exact, materialize, word_split

#: Least words; least distinct words and most capitals, in percent; marks.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and the flags A to E of every document (true: fails)."""
    text = F.coalesce(exact(docs, "text").cast("string"), F.lit(""))
    words = word_split(F.col("text"))
    rows = docs.select(exact(docs, "doc_id").alias("doc_id"), F.coalesce(exact(docs, part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", words.alias("words"))
    light = rows.select(
        "doc_id",
        "part",
        (F.size("words") < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.length("text")).alias("C"),
        F.col("text").rlike(MARKS).alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    light = materialize(light, "audit-rows")
    firsts = light.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    known = light.join(firsts, ["digest", "doc_id"], "left")
    return known.select("doc_id", "part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good (quality 1) and toxic (toxic 1), false where there is no label."""
    marks = labels.groupBy(exact(labels, "doc_id").alias("doc_id")).agg(
        F.max(exact(labels, "quality") == 1).alias("good"), F.max(exact(labels, "toxic") == 1).alias("toxic")
    )
    no = F.lit(False)
    return flags.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def survivors(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """part (null: all parts), mask and the documents, good and toxic ones that no filter of the mask fails.

    rows: part, one boolean per filter, good, toxic. Bit i of the mask stands for filter i. Every part has every mask.
    """
    flags = list(names)
    cells = rows.groupBy("part", *flags).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    chosen = [F.grouping(f) == 0 for f in flags]
    cube = cells.cube("part", *flags).agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")],
        sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(chosen)), F.lit(0)).alias("mask"),
    )
    # A flag outside the grouping set is null: only chosen ones can be true.
    clear = reduce(and_, [~F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return cube.groupBy("part", "mask").agg(*[F.sum(F.when(clear, F.col(c)).otherwise(0)).cast("bigint").alias(c) for c in ("n", "good", "toxic")])


def _orders(spark, names: str) -> DataFrame:
    """filter_order, step, filter and the subsets before and after it: a row a step of each order."""
    rows = []
    for order in permutations(names):
        mask = 0
        for step, f in enumerate(order, 1):
            bit = 1 << names.index(f)
            rows.append(("".join(order), step, f, mask, mask | bit))
            mask |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def interactions(subsets: DataFrame, names: str = FILTERS) -> DataFrame:
    """part (null: all parts), filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = F.broadcast(_orders(subsets.sparkSession, names))  # factorial of the filters' number, whatever the data
    was = subsets.select(F.col("part"), F.col("mask").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    now = subsets.select(F.col("part").alias("same_part"), F.col("mask").alias("same_mask"), "n", "good", "toxic")
    pairs = was.join(steps, "before").join(now, F.col("part").eqNullSafe(F.col("same_part")) & (F.col("after") == F.col("same_mask")))
    of_filter = Window.partitionBy("part", "filter")
    removed = F.col("n_before") - F.col("n")
    pairs = pairs.withColumn("removed", removed)
    # From no filter to f: all that fail f. From all others to all: what only f fails.
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(of_filter)
    alone = F.max(F.when(F.col("step") == len(names), F.col("removed"))).over(of_filter)
    return pairs.select(
        "part", "filter_order", "step", "filter",
        F.col("n").alias("kept"), "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
        F.sum("removed").over(of_filter).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """interactions of the five filters over docs, for every part and (part null) for all of them."""
    subsets = survivors(with_labels(failures(docs, part), labels))
    return interactions(materialize(subsets, "audit-subsets"))


def op11_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels).where(F.col("part").isNotNull()).drop("filter")


#: Applies every order to the cells of equal documents, one filter after the other.
ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
flags AS (
  SELECT doc_id, part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D, doc_id > min(doc_id) OVER (PARTITION BY text) AS E
  FROM words
), marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END,
      CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
run AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails,
    len(regexp_extract_all(fails, '[' || filter_order[1:step] || ']')) > 0 AS gone,
    step > 1 AND len(regexp_extract_all(fails, '[' || filter_order[1:greatest(1, step - 1)] || ']')) > 0 AS gone_before
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE gone AND NOT gone_before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND gone_before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = filter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE gone AND NOT gone_before), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE gone AND NOT gone_before), 0)::BIGINT AS toxic_lost
  FROM run GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""
