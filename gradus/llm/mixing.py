"""Mixing sources to target weights by temperature (DataFrame functions only).

A source's share of tokens q becomes the weight q**a / sum(q**a). The exponent a (1 keeps
the shares, 0 levels them) is the least that keeps repetition within a limit or the
largest that reaches a target entropy, found by repeated section: each pass evaluates
SECTIONS exponents in one aggregation over sources and keeps the interval that holds the
answer. Without a budget, the budget is what the most frequent source fills exactly once,
so no document is left out and the others repeat.

Weights times budget are token quotas. A source's stream is one permutation of its documents
per epoch, by a keyed hash of document and epoch; it ends where its quota is spent. Blocks
cut all streams alike, so each block holds every source at its weight.

Running totals within a permutation are prefix sums over BUCKETS ranges of the hash, then
within a range, so that a source may hold any share of the rows. Choosing rows needs only
the last accepted hash of each source: texts are never shuffled.

Tokens are words here. Defined cases: null source is a source of its own; null text is
empty; rows that repeat id and text are accepted or left together; sources without tokens
keep each row once; an empty table gives an empty result; further columns are ignored
(kept by select).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import broadcast_small, exact, fresh, materialize, word_split

#: Times a source may be repeated; tokens in a block.
MAX_REPEAT, BLOCK_TOKENS = 1.5, 1_000_000
SECTIONS, PASSES = 32, 8
SEED = "mix-1"
#: Hexadecimal digits of the hash that make a range: 16**3 ranges a source and epoch.
DIGITS = 3


def _light(docs: DataFrame) -> DataFrame:
    text = F.coalesce(exact(docs, "text").cast("string"), F.lit(""))
    rows = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "source").cast("string").alias("source"), F.size(word_split(text)).cast("bigint").alias("n_tokens"), F.md5(text).alias("tie"))
    return materialize(rows, "mix-rows")


def _key(epoch: Column, doc_id: Column, tie: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), tie))


def exponent(sources: DataFrame, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None, budget: int | None = None) -> float:
    """The exponent for sources (source, tokens): the least within max_repeat, or the largest
    whose weights have at least min_entropy (nats)."""
    total = sources.where("tokens > 0").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).first()
    if not total.t:
        return 1.0
    log_q = F.log(F.col("tokens") / F.lit(total.t))
    grid = sources.where("tokens > 0").select("tokens", log_q.alias("lq"), F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))).alias("i"))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        a = F.lit(low) + F.col("i") * F.lit((high - low) / SECTIONS)
        sums = grid.groupBy("i").agg(
            F.sum(F.exp(a * F.col("lq"))).alias("z"),
            F.sum(a * F.col("lq") * F.exp(a * F.col("lq"))).alias("s"),
            F.max((a - 1) * F.col("lq")).alias("most"),
            F.min((a - 1) * F.col("lq")).alias("least"),
        )
        entropy = F.log("z") - F.col("s") / F.col("z")
        repeat = F.exp(F.col("most") - F.col("least")) if budget is None else F.exp(F.col("most")) * F.lit(budget / total.t) / F.col("z")
        ok = entropy >= min_entropy if min_entropy is not None else repeat <= max_repeat * (1 + 1e-12)
        good = {r.i for r in sums.where(ok).select("i").collect()}  # at most SECTIONS + 1 rows
        step = (high - low) / SECTIONS
        if min_entropy is not None:  # entropy falls as the exponent grows
            i = max((i for i in range(SECTIONS + 1) if i in good), default=0)
            low, high = low + i * step, min(high, low + (i + 1) * step)
        else:
            i = min((i for i in range(SECTIONS + 1) if i in good), default=SECTIONS)
            low, high = max(low, low + (i - 1) * step), low + i * step
    return low if min_entropy is not None else high


def plan(light: DataFrame, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """mix_source, tokens, weight, quota, full (whole epochs), rest (tokens of the last), per_block."""
    sources = materialize(light.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    a = exponent(sources, max_repeat, min_entropy, budget)
    total = sources.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).first()
    t, most = max(1, total.t or 1), max(1, total.m or 1)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(t)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(raw).alias("z")).first().z or 1.0
    size = float(budget) if budget is not None else most / ((most / t) ** a / z)
    blocks = max(1, -(-int(size) // block_tokens))
    weight = raw / F.lit(z)
    quota = F.floor(weight * F.lit(size) + F.lit(1e-6)).cast("bigint")
    out = sources.select(F.col("source").alias("mix_source"), "tokens", weight.alias("weight"), quota.alias("quota"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("bigint")
    out = out.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))
    return materialize(out.withColumn("per_block", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.lit(blocks))).cast("bigint")), "mix-plan")


def _running(rows: DataFrame) -> DataFrame:
    """Adds before: tokens of rows of smaller key in the same source and epoch."""
    rows = rows.withColumn("range", F.substring("key", 1, DIGITS))
    keys = [F.col(c) for c in ("source", "epoch", "range")]
    sums = rows.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("of_range"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in ("source", "epoch", "range")], F.coalesce(F.sum("of_range").over(earlier), F.lit(0)).alias("base"))
    on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("range") == F.col("s_range"))
    rows = rows.join(sums, on)
    upto = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("n_tokens").over(Window.partitionBy(*keys, F.col("key")))
    return rows.withColumn("before", F.col("base") + upto - peers).drop("s_source", "s_epoch", "s_range", "base", "range")


def _with_plan(light: DataFrame, weights: DataFrame) -> DataFrame:
    return light.join(broadcast_small(weights), F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")


def schedule(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and position (key within the block) of every accepted copy."""
    light = _light(docs)
    rows = _with_plan(light, plan(light, **how)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
    rows = rows.where("epoch < full or rest > 0").withColumn("key", _key(F.col("epoch"), F.col("doc_id"), F.col("tie")))
    rows = _running(rows).where("epoch < full or before < rest")
    block = F.expr("(epoch * tokens + before) div per_block")
    return rows.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"), F.col("key").alias("position"))


def select(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as schedule accepts it, with all their columns.

    Two passes over texts: one counts tokens, one repeats rows; a row's copies follow from its
    source's whole epochs and the last key accepted of the epoch after them.
    """
    light = _light(docs)
    weights = plan(light, **how)
    rows = _with_plan(light, weights).where("rest > 0").withColumn("epoch", F.col("full"))
    rows = _running(rows.withColumn("key", _key(F.col("epoch"), F.col("doc_id"), F.col("tie")))).where("before < rest")
    last = rows.groupBy("source").agg(F.max("key").alias("last")).withColumnRenamed("source", "l_source")
    limits = weights.join(last, F.col("mix_source").eqNullSafe(F.col("l_source")), "left").select("mix_source", "full", "last")
    limits = materialize(limits, "mix-limits")
    names = dict(zip(limits.columns, fresh(docs, *limits.columns), strict=True))
    (copy,) = fresh(docs, "mix_copy")
    joined = docs.join(broadcast_small(limits.withColumnsRenamed(names)), exact(docs, "source").cast("string").eqNullSafe(F.col(names["mix_source"])))
    key = _key(F.col(names["full"]), exact(docs, "doc_id"), F.md5(F.coalesce(exact(docs, "text").cast("string"), F.lit(""))))
    copies = F.col(names["full"]) + F.coalesce((key <= F.col(names["last"])).cast("bigint"), F.lit(0))
    kept = joined.withColumn(copy, copies).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The exponent is found in closed form here: it makes the rarest source repeat MAX_REPEAT times.
ORACLE = rf"""
WITH light AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents
), sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM light GROUP BY source),
ends AS (SELECT max(tokens) AS m, min(tokens) AS l, sum(tokens) AS t FROM sources WHERE tokens > 0),
a AS (SELECT CASE WHEN m = l THEN 0 ELSE greatest(0, 1 - ln({MAX_REPEAT}) / ln(m / l)) END AS a, m, t FROM ends),
raw AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / t, a) ELSE 0 END AS w FROM sources, a),
size AS (SELECT m / (pow(m / t, a) / (SELECT sum(w) FROM raw)) AS b, (SELECT sum(w) FROM raw) AS z FROM a),
quotas AS (SELECT source, tokens, floor(w / z * b + 1e-6)::BIGINT AS quota, greatest(1, ceil(floor(b) / {BLOCK_TOKENS})) AS blocks FROM raw, size),
plan AS (
  SELECT source, tokens, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS full_epochs,
    greatest(1, ceil(quota / blocks))::BIGINT AS per_block FROM quotas
), copies AS (
  SELECT l.*, p.tokens, p.full_epochs, p.quota - p.full_epochs * p.tokens AS rest, p.per_block, e.epoch,
    md5(concat_ws(':', '{SEED}', e.epoch::VARCHAR, coalesce(l.doc_id::VARCHAR, ''), l.tie)) AS key
  FROM light l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.full_epochs + 1)) AS epoch) e
), run AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key), 0)
    - sum(n_tokens) OVER (PARTITION BY source, epoch, key) AS before FROM copies
)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, ((epoch * tokens + before) // per_block)::BIGINT AS block, key AS position
FROM run WHERE epoch < full_epochs OR before < rest
"""
