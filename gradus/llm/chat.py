"""Chat formatting by relational means: Spark expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role merge into one block
by array aggregation; blocks are concatenated:

    <s>[ROLE] role\\n text [SEP] text [/ROLE]</s> ...

Texts inside are escaped, so no control string can occur in one, and reading back splits
at control strings alone. The escape turns `\\` into `\\b` and the first character of each
control string in a text into `\\l` (for <) or `\\s` (for [); a line break in a role into
`\\n`. Undone in the reverse order, it is exact. The loss mask marks assistant texts as
(start, length) in code points of the formatted string.

A conversation is one row of output and is formatted in one task; its size is that of its
own turns.

Defined cases: null text or role is empty; null turns come first, and turns that tie are
ordered by role, then text; repeated rows are turns of their own; rows with a null conv_id
are one conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import exact

OPEN, HEAD, SEP, CLOSE = "<s>[ROLE]", "\n", "[SEP]", "[/ROLE]</s>"
#: Strings that no text may hold as they are; those of a common template among them.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[SEP]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    mark = {"<": "\\l", "[": "\\s"}
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(mark[s[0]] + s[1:])), CONTROL, out)


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("["))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id and turns, the sorted array of (turn, role, text)."""
    clean = rows.select(
        exact(rows, "conv_id").alias("conv_id"),
        F.struct(
            exact(rows, "turn").alias("turn"),
            F.coalesce(exact(rows, "role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(exact(rows, "text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    return clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, and loss: array of (start, length), code points from 0."""
    turns = _turns(rows)
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(role(t).alias("role"), escape(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss"))).alias("p"))
    # Each turn with what precedes its text: a new block, or a separator if the role goes on.
    lead = F.transform(
        "p",
        lambda x, i: F.struct(
            F.when(i == 0, F.concat(F.lit(OPEN), x["role"], F.lit(HEAD)))
            .when(F.get(F.col("p"), i - 1)["role"] == x["role"], F.lit(SEP))
            .otherwise(F.concat(F.lit(CLOSE + OPEN), x["role"], F.lit(HEAD)))
            .alias("lead"),
            x["text"].alias("text"),
            x["loss"].alias("loss"),
        ),
    )
    led = parts.select("conv_id", lead.alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["lead"])
        span = F.struct(begin.cast("bigint").alias("start"), F.length(x["text"]).cast("bigint").alias("length"))
        loss = F.when(x["loss"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"])
        return F.struct((begin + F.length(x["text"])).cast("bigint").alias("at"), loss.alias("loss"))

    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["lead"], x["text"])), ""), F.lit(CLOSE))
    return led.select("conv_id", text.alias("formatted"), F.aggregate("p", start, step, lambda acc: acc["loss"]).alias("loss"))


def read_back(done: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) parsed from the formatted string alone, and loss_texts by the mask."""
    body = F.substring("formatted", len(OPEN) + 1, F.length("formatted") - len(OPEN) - len(CLOSE))
    blocks = F.split(body, F.lit(r"\Q" + CLOSE + OPEN + r"\E"), F.lit(-1))

    def turns(block):
        at = F.instr(block, HEAD)
        role = unescape(F.replace(F.substring(block, F.lit(1), at - 1), F.lit("\\n"), F.lit("\n")))
        texts = F.split(F.substring(block, at + 1, F.length(block)), F.lit(r"\Q" + SEP + r"\E"), F.lit(-1))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    told = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return done.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), told.alias("loss_texts"))


def digests(done: DataFrame) -> DataFrame:
    back = read_back(done)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(control).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(more)))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\b')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{ {'<': chr(92) + 'l', '[': chr(92) + 's'}[s[0]] + s[1:]}')"
    return out


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), led AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS nth,
    replace({_sql_escape('role')}, chr(10), '\\n') AS role_out, {_sql_escape('text')} AS text_out
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256,
  (sum(length(text_out) + CASE WHEN nth > 1 AND before = role THEN {len(SEP)}
    ELSE {len(OPEN) + len(HEAD)} + length(role_out) + CASE WHEN nth > 1 THEN {len(CLOSE)} ELSE 0 END END)
    + {len(CLOSE)})::BIGINT AS formatted_chars
FROM led GROUP BY conv_id
"""
