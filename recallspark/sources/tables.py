"""Memory-shaped views of the given tables, and readers of nested inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The start of the views' clock, and the time that queries take as now.
EPOCH, HOUR, NOW = 1_735_689_600_000, 3_600_000, 1_760_000_000_000

#: Valid in Spark and in DuckDB: memories made of documents.
MEMORIES_SQL = f"""
SELECT doc_id AS id, doc_id % 50 AS session_id, concat('/p/', lang, '//', source) AS namespace, text AS content,
  CASE WHEN doc_id % 5 = 0 THEN 'gotcha' WHEN doc_id % 5 = 1 THEN 'fact' WHEN doc_id % 5 = 2 THEN 'procedure' ELSE 'note' END AS type,
  (doc_id % 10) / CAST(10 AS DOUBLE) AS importance, {EPOCH} + doc_id * {HOUR} AS created_at, {EPOCH} + doc_id * {HOUR} AS valid_from,
  CASE WHEN doc_id % 7 = 0 THEN {EPOCH} + doc_id * {HOUR} + 432000000 END AS valid_until, doc_id % 23 = 0 AS pinned,
  CASE WHEN doc_id % 11 = 0 THEN {EPOCH} + doc_id * {HOUR} + 99 END AS archived_at, doc_id % 30 AS access_count,
  CASE WHEN doc_id % 30 > 0 THEN {EPOCH} + doc_id * {HOUR} + 864000000 END AS last_accessed,
  CASE WHEN doc_id % 3 = 0 THEN concat('slot ', CAST(doc_id % 40 AS STRING)) END AS state_key,
  CASE WHEN doc_id % 13 = 0 THEN 'personal' END AS visibility, concat('u', CAST(doc_id % 4 AS STRING)) AS owner
FROM documents"""

LINKS_SQL = f"""
SELECT doc_id AS source_id, doc_id - 1 - doc_id % 5 AS target_id,
  CASE WHEN doc_id % 4 = 0 THEN 'supersedes' WHEN doc_id % 4 = 1 THEN 'conflicts' ELSE 'semantic' END AS link_type,
  0.5 + (doc_id % 50) / CAST(100 AS DOUBLE) AS similarity, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 10) / CAST(10 AS DOUBLE) END AS confidence,
  {EPOCH} + doc_id * {HOUR} AS created_at, CASE WHEN doc_id % 3 = 0 THEN {EPOCH} + doc_id * {HOUR} + 5000 END AS judged_at
FROM documents WHERE doc_id - 1 - doc_id % 5 >= 0"""


#: Episodes, their sessions and citations, made of conversations.
EPISODES_SQL = f"""
SELECT conv_id * 1000 + turn AS id, concat('/p/c', CAST(conv_id % 4 AS STRING)) AS namespace, conv_id AS session_id, 'chat' AS source,
  concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS external_id, role, text AS content, turn AS turn_index,
  CASE WHEN conv_id % 9 <> 0 THEN {EPOCH} + conv_id * {HOUR} + turn * 60000 END AS occurred_at,
  CASE WHEN conv_id % 3 = 0 THEN 'session' WHEN conv_id % 3 = 1 THEN 'durable' ELSE 'ephemeral' END AS retention,
  CASE WHEN conv_id % 3 = 2 THEN {EPOCH} + conv_id * 30 * {HOUR} END AS expires_at,
  CASE WHEN turn % 5 = 4 THEN 'superseded' ELSE 'current' END AS source_state, conv_id % 7 AS task_id,
  CASE WHEN conv_id % 13 = 0 THEN 'personal' END AS visibility, concat('u', CAST(conv_id % 4 AS STRING)) AS owner
FROM conversations"""

SESSIONS_SQL = f"""
SELECT DISTINCT conv_id AS id, {EPOCH} + conv_id * {HOUR} AS started_at, CASE WHEN conv_id % 2 = 0 THEN {EPOCH} + conv_id * {HOUR} + 500000 END AS ended_at FROM conversations"""

CITATIONS_SQL = """
SELECT conv_id % 40 AS memory_id, conv_id * 1000 + turn AS episode_id, CASE WHEN turn % 2 = 0 THEN CAST(turn AS INT) END AS span_start,
  CASE WHEN turn % 2 = 0 THEN CAST(turn + 9 AS INT) END AS span_end FROM conversations WHERE turn % 3 = 0"""


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str = "documents") -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MEMORIES_SQL)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LINKS_SQL)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EPISODES_SQL, "conversations")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SESSIONS_SQL, "conversations")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CITATIONS_SQL, "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
