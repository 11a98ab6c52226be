"""The narrative engine's logical inputs, derived from the generic tables, and the same as SQL views.

events stand for classified documents: the type is the narrative, the user the publisher, the JSON key the
story. Line items stand for theme signals: brand, day, order, return flag and supplier. documents are the
corpus of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import small

CLASSES = ("filing", "press_release", "newspaper", "transcript")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event: document_id, date, source_class, definition_id, publisher_id, publisher_owner, story_fingerprint, match_score, risk_tone, bullish_tone, entity."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("document_id"),
        F.to_date("ts").alias("date"),
        _pick(CLASSES, F.col("user_id") % 4).alias("source_class"),
        F.col("event_type").alias("definition_id"),
        F.col("user_id").cast("string").alias("publisher_id"),
        F.concat(F.lit("owner"), (F.col("user_id") % 37).cast("string")).alias("publisher_owner"),
        F.get_json_object("props", "$.k").alias("story_fingerprint"),
        F.least(F.col("value"), F.lit(100.0)).alias("match_score"),
        (F.col("event_id") % 50).cast("double").alias("risk_tone"),
        (F.col("event_id") % 41).cast("double").alias("bullish_tone"),
        F.concat(F.lit("entity"), (F.col("event_id") % 23).cast("string")).alias("entity"),
    )


EVIDENCE_SQL = """
evidence AS (
  SELECT event_id AS document_id, CAST(ts AS DATE) AS date,
    CASE user_id % 4 WHEN 0 THEN 'filing' WHEN 1 THEN 'press_release' WHEN 2 THEN 'newspaper' ELSE 'transcript' END AS source_class,
    event_type AS definition_id, CAST(user_id AS VARCHAR) AS publisher_id, 'owner' || CAST(user_id % 37 AS VARCHAR) AS publisher_owner,
    json_extract_string(props, '$.k') AS story_fingerprint, least(value, 100.0) AS match_score,
    CAST(event_id % 50 AS DOUBLE) AS risk_tone, CAST(event_id % 41 AS DOUBLE) AS bullish_tone, 'entity' || CAST(event_id % 23 AS VARCHAR) AS entity
  FROM events
)"""

#: A match needs this score; a raw match the lower one.
MATCH, RAW_MATCH = 20.0, 5.0


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged for every definition (few); those whose id leaves 7 modulo 97 are not judged for 'error'."""
    e = evidence(spark, sf_dir)
    definitions = e.select("definition_id").distinct()
    x = e.withColumnRenamed("definition_id", "own").join(small(definitions))  # a row a definition
    hit = F.col("own") == F.col("definition_id")
    x = x.where(~((F.col("definition_id") == "error") & (F.col("document_id") % 97 == 7)))
    return x.select("definition_id", "document_id", "date", "source_class", (hit & (F.col("match_score") >= MATCH)).alias("matched"), (hit & (F.col("match_score") >= RAW_MATCH)).alias("raw_matched"), "match_score", "risk_tone", "bullish_tone", "publisher_id", "publisher_owner", "story_fingerprint", F.array("entity").alias("entities"))


OBSERVATIONS_SQL = (
    EVIDENCE_SQL
    + f""", definitions AS (SELECT DISTINCT definition_id FROM evidence),
observations AS (
  SELECT d.definition_id, e.document_id, e.date, e.source_class,
    e.definition_id = d.definition_id AND e.match_score >= {MATCH} AS matched,
    e.definition_id = d.definition_id AND e.match_score >= {RAW_MATCH} AS raw_matched,
    e.match_score, e.risk_tone, e.bullish_tone, e.publisher_id, e.publisher_owner, e.story_fingerprint, e.entity
  FROM evidence e CROSS JOIN definitions d
  WHERE NOT (d.definition_id = 'error' AND e.document_id % 97 = 7)
)"""
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("date", "document_id", "source_class")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: signal_id, document_id, theme ids, date, source_class, entities, score."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("signal_id"),
        F.col("l_orderkey").alias("document_id"),
        F.col("p_brand").alias("theme_id"),
        F.when(F.col("l_linenumber") != 3, F.col("p_brand")).alias("canonical_theme_id"),
        F.when(F.col("l_suppkey") % 5 == 0, F.when(F.col("l_suppkey") % 10 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("size:"), (F.col("p_size") % 5).cast("string")))).alias("canonical_subtheme_id"),
        F.to_date("l_shipdate").alias("date"),
        F.concat(F.lit("class"), F.col("l_returnflag"), F.col("l_linestatus")).alias("source_class"),
        F.array(F.concat(F.lit("supplier"), (F.col("l_suppkey") % 50).cast("string")), F.concat(F.lit(" size"), F.col("p_size").cast("string"), F.lit(" "))).alias("entities"),
        (F.log1p("l_quantity") * (1 - F.col("l_discount")) / 10.0).alias("score"),
    )


SIGNALS_SQL = """
signals AS (
  SELECT l_orderkey * 10 + l_linenumber AS signal_id, l_orderkey AS document_id, p_brand AS theme_id,
    CASE WHEN l_linenumber <> 3 THEN p_brand END AS canonical_theme_id,
    CASE WHEN l_suppkey % 5 = 0 THEN CASE WHEN l_suppkey % 10 = 0 THEN p_brand ELSE 'size:' || CAST(p_size % 5 AS VARCHAR) END END AS canonical_subtheme_id,
    CAST(l_shipdate AS DATE) AS date, 'class' || l_returnflag || l_linestatus AS source_class,
    ['supplier' || CAST(l_suppkey % 50 AS VARCHAR), 'size' || CAST(p_size AS VARCHAR)] AS entities,
    ln(1 + l_quantity) * (1 - l_discount) / 10.0 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed themes: all brands and sizes but one brand."""
    both = F.array("theme_id", "canonical_subtheme_id")  # one pass over the signals
    return signals(spark, sf_dir).select(F.explode(both).alias("theme_id")).distinct().where("theme_id <> 'Brand#11'")


CONTRIBUTIONS_SQL = (
    SIGNALS_SQL
    + """, themes AS (
  SELECT DISTINCT theme_id FROM (SELECT theme_id FROM signals UNION ALL SELECT canonical_subtheme_id FROM signals WHERE canonical_subtheme_id IS NOT NULL) WHERE theme_id <> 'Brand#11'
), plain AS (
  SELECT coalesce(canonical_theme_id, theme_id) AS theme_id, CASE WHEN canonical_theme_id IS NULL THEN 'unmapped' ELSE 'market' END AS level, signal_id, document_id, date, source_class, entities, score FROM signals
  UNION ALL
  SELECT canonical_subtheme_id, 'sector', signal_id, document_id, date, source_class, entities, score FROM signals WHERE canonical_subtheme_id IS NOT NULL
), listed AS (
  SELECT p.* FROM plain p SEMI JOIN themes t ON p.theme_id = t.theme_id
), levels AS (
  SELECT theme_id, arg_min(level, (level = 'sector', document_id, signal_id)) AS trend_level FROM listed GROUP BY theme_id
), contributions AS (
  SELECT l.theme_id, v.trend_level, l.signal_id, l.document_id, l.date, l.source_class, l.entities, l.score FROM listed l JOIN levels v ON l.theme_id = v.theme_id
)"""
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of texts: document_id, text, title (the whole first line), date, source_class, publisher, published."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 91).cast("int"))
    return d.select(F.col("doc_id").alias("document_id"), "text", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), day.alias("date"), _pick(CLASSES, F.col("doc_id") % 4).alias("source_class"), F.col("source").alias("publisher"), "lang", "n_chars")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, title: the first line, read without the other columns."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))


TEXTS_SQL = """
texts AS (
  SELECT doc_id AS document_id, text, regexp_extract(text, '^([^\\n]*)', 1) AS title, DATE '2024-01-01' + CAST(doc_id % 91 AS INTEGER) AS date,
    CASE doc_id % 4 WHEN 0 THEN 'filing' WHEN 1 THEN 'press_release' WHEN 2 THEN 'newspaper' ELSE 'transcript' END AS source_class, source AS publisher, lang, n_chars
  FROM documents
)"""
