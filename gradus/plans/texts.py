"""Text, array, JSON and markup queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as fn
from ..operators import validate
from .registry import query, table

FOLD = "replace(strip_accents(lower({0})), 'đ', 'd')"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, {FOLD.format("text")} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", fn.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, nullif(trim(regexp_replace({FOLD.format("text")}, '[^a-z0-9]+', ' ', 'g')), '') AS slug FROM documents")
def slug_key(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", fn.slug(F.col("text"), True).alias("slug"))


@query(f"""WITH h AS (SELECT doc_id, {FOLD.format("text")} AS f FROM documents)
  SELECT doc_id, trim(regexp_replace(f, '[^a-z0-9\\s]', ' ', 'g')) AS kept_runs, trim(regexp_replace(f, '[^a-z0-9]+', ' ', 'g')) AS collapsed,
    trim(regexp_replace(regexp_replace(f, '[^\\x00-\\x7f]+', '', 'g'), '\\s+', ' ', 'g')) AS ascii,
    trim(regexp_replace(regexp_replace(trim(regexp_replace(f, '[^a-z0-9]+', ' ', 'g')), '(^| )(the|of) ', ' ', 'g'), ' +', ' ', 'g')) AS named FROM h""")
def normaliser_variants(spark, sf_dir):
    text = F.col("text")
    named = F.trim(F.regexp_replace(F.regexp_replace(fn.slug(text), "(^| )(the|of) ", " "), " +", " "))
    return _texts(spark, sf_dir).select("doc_id", fn.slug_keep_runs(text).alias("kept_runs"), fn.slug(text).alias("collapsed"), fn.ascii_only(text).alias("ascii"), named.alias("named"))


@query()  # SQL has no NFKC; tested against plain Python
def nfkc_whitespace(spark, sf_dir):
    from ..functions.unicode import nfkc_collapse

    return _texts(spark, sf_dir).select("doc_id", nfkc_collapse("text").alias("collapsed"))


TAGS = [("contact", "@|\\+1"), ("licence", "(?i)licen[sc]e"), ("number", "[0-9]"), ("shout", "[A-Z]{4,}"), ("marks", "[#*|]")]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TAGS) + """], lambda x: x IS NOT NULL), '|') AS categories,
  CASE WHEN regexp_matches(text, '@|\\+1') THEN 'high' WHEN regexp_matches(text, '[#*|]') THEN 'medium' ELSE 'low' END AS priority FROM documents""")
def note_classification(spark, sf_dir):
    text = F.col("text")
    priority = F.when(text.rlike(TAGS[0][1]), "high").when(text.rlike(TAGS[4][1]), "medium").otherwise("low")
    return table(spark, sf_dir, "documents").select("doc_id", fn.tag_list(TAGS, text).alias("categories"), priority.alias("priority"))


@query("""SELECT p_partkey, nullif(regexp_extract(p_brand, '^([A-Za-z]+)', 1), '') AS letters, nullif(regexp_extract(p_brand, '#([0-9])([0-9])', 2), '')::INT AS factor,
  CASE WHEN regexp_matches(p_name, '(^| )(red|rose)( |$)') THEN 'warm' WHEN regexp_matches(p_name, 'blue|navy') THEN 'cold' END AS tone, contains(p_name, 'an') AS review FROM part""")
def note_features(spark, sf_dir):
    name = F.col("p_name")
    factor = F.nullif(F.regexp_extract("p_brand", "#([0-9])([0-9])", 2), F.lit("")).cast("int")
    tone = F.when(name.rlike("(^| )(red|rose)( |$)"), "warm").when(name.rlike("blue|navy"), "cold")
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.regexp_extract("p_brand", "^([A-Za-z]+)", 1), F.lit("")).alias("letters"), factor.alias("factor"), tone.alias("tone"), name.contains("an").alias("review"))


STOP = ["the", "and", "that", "with", "was", "les", "des", "que", "der", "die", "und"]


@query(f"""WITH q AS (SELECT list_filter(regexp_extract_all({FOLD.format("text")}, '[a-z]{{3,}}'), lambda w: w NOT IN ({", ".join(f"'{s}'" for s in STOP)}))[1:6] AS words FROM benchmark ORDER BY item_id LIMIT 1),
  scored AS (SELECT doc_id, n_chars, list_sum(list_transform(words, lambda w: CASE WHEN contains({FOLD.format("text")}, w) THEN 1 ELSE 0 END))::BIGINT AS hits FROM documents, q)
  SELECT doc_id, hits, n_chars FROM scored WHERE hits > 0 ORDER BY hits DESC, abs(n_chars - 1000), doc_id LIMIT 8""")
def token_relevance_top8(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(fn.tokens(F.col("text"), STOP, 6).alias("words"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(asked))  # one row
    count = lambda f: F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.when(f.contains(w), 1).otherwise(0))
    hits = F.element_at(F.transform(F.array(fn.fold(F.col("text"))), count), 1)  # each text is folded once, not for each word
    return docs.select("doc_id", hits.alias("hits"), "n_chars").where("hits > 0").orderBy(F.desc("hits"), F.abs(F.col("n_chars") - 1000), "doc_id").limit(8)


@query("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
  SELECT conv_id, turn, role, substr(text, 1, 1000) AS text FROM last WHERE back <= 6 AND role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def last_n_history(spark, sf_dir):
    """The last six turns first, then the roles, then blank texts go; the order matters."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    df = table(spark, sf_dir, "conversations").withColumn("back", back).where("back <= 6").where(F.col("role").isin("user", "assistant") & (F.btrim("text", F.lit(" \t\n\r")) != ""))
    return df.select("conv_id", "turn", "role", F.substring("text", 1, 1000).alias("text"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[" a ", "", "b' || user_id || '"]' WHEN event_id % 3 = 1 THEN 'plain ' || user_id END AS src FROM events)
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a;b' || regexp_extract(src, 'b([0-9]+)', 1) WHEN src IS NOT NULL THEN src END AS items,
    CASE WHEN event_id % 3 = 0 THEN 2 WHEN src IS NOT NULL THEN 1 END::INT AS n, coalesce(event_id % 3 = 1, false) AS review FROM s""")
def json_list_parse(spark, sf_dir):
    i = F.col("event_id")
    src = F.when(i % 3 == 0, F.concat(F.lit('[" a ", "", "b'), F.col("user_id").cast("string"), F.lit('"]'))).when(i % 3 == 1, F.concat(F.lit("plain "), F.col("user_id").cast("string")))
    df = table(spark, sf_dir, "events").select("event_id", src.alias("src")).withColumn("parsed", F.from_json("src", "array<string>"))
    items = F.filter(F.transform(F.coalesce("parsed", F.when(F.col("src").isNotNull(), F.array("src"))), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("items", items)
    n = F.when(F.col("items").isNotNull(), F.size("items"))
    return df.select("event_id", F.array_join("items", ";").alias("items"), n.alias("n"), (F.col("parsed").isNull() & F.col("src").isNotNull()).alias("review"))


@query("""SELECT p_partkey, array_to_string(list_distinct_in_order, ';') AS items FROM (
  SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1)] ELSE string_split(p_name, ' ')[1:2] END AS list_distinct_in_order FROM part)""")
def python_list_text(spark, sf_dir):
    """Lists written with single quotes, read as JSON."""
    text = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', '")), F.lit("']"))
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.slice(parsed, 1, 2)), ";").alias("items"))


INTERESTS = {"metals": ["steel", "tin", "copper"], "colours": ["red", "blue", "green"]}


@query("SELECT p_partkey, (" + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(p_name || ' ' || p_type), '{w}')" for w in ws) + " THEN 1.0 ELSE 0.0 END" for ws in INTERESTS.values()) + ")::DOUBLE / 2 AS fit FROM part")
def interest_fit(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    hits = [F.when(fn.contains_any(text, ws), 1.0).otherwise(0.0) for ws in INTERESTS.values()]
    return table(spark, sf_dir, "part").select("p_partkey", (sum(hits[1:], hits[0]) / len(hits)).alias("fit"))


@query("""SELECT p_partkey, 'vj_' || substr(sha256(concat_ws(chr(31), p_name, p_brand, p_type, p_size::VARCHAR, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END)), 1, 20) AS id FROM part""")
def stable_hash_id(spark, sf_dir):
    flag = F.when(F.col("p_size") > 25, "True").otherwise("False")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("p_name", "p_brand", "p_type", "p_size")]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("vj_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts, flag), 256), 1, 20)).alias("id"))


@query("""SELECT c_custkey, upper(regexp_replace(' ' || c_name || '.0 ', '\\s|\\.0', '', 'g')) AS code, split_part(c_name, '#', 1) AS before, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey % 100 WHEN c_custkey % 11 = 0 THEN '1234567' ELSE lpad((c_custkey % 100)::VARCHAR, 6, '0') END AS padded,
  regexp_extract(c_name, '([0-9]{3,7})', 1) AS core, translate(lower(c_name), '_', ' ') AS spaced, (c_custkey / 10.0)::DECIMAL(12,1)::DOUBLE AS comma FROM customer""")
def code_cleanup(spark, sf_dir):
    name = F.col("c_name")
    comma = F.replace((F.col("c_custkey") / 10.0).cast("decimal(12,1)").cast("string"), F.lit("."), F.lit(","))
    short = (F.col("c_custkey") % 100).cast("string")
    digits = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), short)).when(F.col("c_custkey") % 11 == 0, "1234567").otherwise(short)
    return table(spark, sf_dir, "customer").withColumn("digits", digits).select(
        "c_custkey",
        F.upper(F.regexp_replace(F.concat(F.lit(" "), name, F.lit(".0 ")), r"\s|\.0", "")).alias("code"),
        F.split_part(name, F.lit("#"), F.lit(1)).alias("before"),
        validate.padded("digits", 6).alias("padded"),
        F.regexp_extract(name, "([0-9]{3,7})", 1).alias("core"),
        F.translate(F.lower(name), "_", " ").alias("spaced"),
        rules.as_number(comma).alias("comma"),
    )


@query("""WITH q AS (SELECT c_custkey, 'about ' || ((c_custkey % 60) / 2.0)::DECIMAL(5,1)::VARCHAR || ' points in ' || (['A00', 'D01', 'Z99'])[(c_custkey % 3 + 1)::INT] AS question FROM customer)
  SELECT c_custkey, nullif(regexp_extract(question, '([A-D][0-9]{2})', 1), '') AS combo, CASE WHEN try_cast(nullif(regexp_extract(question, '([0-9]+(?:[.,][0-9]+)?) points', 1), '') AS DOUBLE) BETWEEN 0 AND 25
    THEN try_cast(nullif(regexp_extract(question, '([0-9]+(?:[.,][0-9]+)?) points', 1), '') AS DOUBLE) END AS score FROM q""")
def question_parse(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("A00", "D01", "Z99"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    question = F.concat(F.lit("about "), ((F.col("c_custkey") % 60) / 2).cast("decimal(5,1)").cast("string"), F.lit(" points in "), code)
    score = F.replace(F.nullif(F.regexp_extract("question", r"([0-9]+(?:[.,][0-9]+)?) points", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    df = table(spark, sf_dir, "customer").select("c_custkey", question.alias("question"))
    return df.select("c_custkey", F.nullif(F.regexp_extract("question", "([A-D][0-9]{2})", 1), F.lit("")).alias("combo"), F.when(score.between(0, 25), score).alias("score"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS src FROM pages),
  s AS (SELECT page_id, src, max(CASE WHEN contains(src, 'http') THEN 100 ELSE 0 END + CASE WHEN regexp_matches(src, '[0-9]') THEN 30 ELSE 0 END - CASE WHEN contains(src, 'partner') THEN 1200 ELSE 0 END - length(src))::BIGINT AS score FROM a GROUP BY ALL)
  SELECT page_id, src, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, src) AS rank FROM s""")
def asset_rank(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("src"))
    src = F.col("src")
    score = F.when(src.contains("http"), 100).otherwise(0) + F.when(src.rlike("[0-9]"), 30).otherwise(0) - F.when(src.contains("partner"), 1200).otherwise(0) - F.length(src)
    best = each.groupBy("page_id", "src").agg(F.max(score).cast("bigint").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "src")).cast("bigint"))


@query()
def pages_extract(spark, sf_dir):
    """Title, visible text length and links of each page, by the standard library's HTML parser."""
    from ..functions.markup import extract

    return table(spark, sf_dir, "pages").select("page_id", extract(F.col("html")).alias("x")).select("page_id", "x.*")


@query("""WITH s AS (SELECT conv_id, string_agg('event: delta' || chr(10) || 'data: {"role":"' || role || '","turn":' || turn || '}', chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'data: [DONE]' AS stream FROM conversations GROUP BY 1),
  f AS (SELECT conv_id, unnest(string_split(stream, chr(10) || chr(10))) AS frame FROM s)
  SELECT conv_id, coalesce(nullif(regexp_extract(frame, 'event: ([a-z]+)', 1), ''), 'message') AS event, nullif(regexp_extract(frame, '"role":"([a-z]+)"', 1), '') AS role,
    nullif(regexp_extract(frame, '"turn":([0-9]+)', 1), '')::BIGINT AS turn, contains(frame, '[DONE]') AS done FROM f""")
def sse_frames(spark, sf_dir):
    """Frames of an event stream: split at blank lines, fields by prefix, data as JSON."""
    data = F.concat(F.lit("event: delta\ndata: "), F.to_json(F.struct("role", "turn")))
    streams = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", data.alias("d")))).alias("fs"))
    stream = F.concat(F.array_join(F.transform("fs", lambda f: f["d"]), "\n\n"), F.lit("\n\ndata: [DONE]"))
    frames = streams.select("conv_id", F.explode(F.split(stream, "\n\n")).alias("frame"))
    body = F.from_json(F.regexp_extract("frame", r"(?m)^data: (.*)$", 1), "role string, turn bigint")
    event = F.coalesce(F.nullif(F.regexp_extract("frame", r"(?m)^event: ([a-z]+)$", 1), F.lit("")), F.lit("message"))
    return frames.select("conv_id", event.alias("event"), body["role"].alias("role"), body["turn"].alias("turn"), F.col("frame").contains("[DONE]").alias("done"))


@query("""SELECT c_custkey, upper(c_name[1]) || upper(coalesce(regexp_extract(c_name, '#(.)', 1), '')) AS initials, ('0x' || substr(sha1(c_name), 1, 8))::BIGINT % 7 AS colour FROM customer""")
def initials_and_colour(spark, sf_dir):
    name = F.col("c_name")
    initials = F.concat(F.upper(F.substring(name, 1, 1)), F.upper(F.regexp_extract(name, "#(.)", 1)))
    return table(spark, sf_dir, "customer").select("c_custkey", initials.alias("initials"), (F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("bigint") % 7).alias("colour"))


@query("""SELECT n_regionkey, count(*) AS n_nations, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1""")
def nested_response_json(spark, sf_dir):
    """Nested response as JSON, read back and flattened."""
    groups = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("items"))
    text = groups.select("n_regionkey", F.to_json(F.struct("items")).alias("j"))
    back = text.select("n_regionkey", F.from_json("j", "items array<struct<n_name:string,n_nationkey:int>>")["items"].alias("items"))
    return back.select("n_regionkey", F.size("items").cast("bigint").alias("n_nations"), F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names"))
