"""Readers of nested inputs: stored rows, JSON lines and arrays, dialogues, haystacks, fact pools, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of a store that are declared, with their columns.
SCHEMAS = {
    "memories": "id long, session_id long, namespace string, content string, type string, importance double, tags string, created_at long, valid_from long, valid_until long, pinned boolean, archived_at long, access_count long, last_accessed long, state_key string, visibility string, owner string, embed_state string",
    "links": "source_id long, target_id long, link_type string, similarity double, confidence double, created_at long, judged_at long, revision int",
    "episodes": "id long, namespace string, session_id long, source string, external_id string, role string, content string, turn_index int, occurred_at long, retention string, expires_at long, source_state string, visibility string, owner string",
    "embeddings": "id long, embedding array<float>",
}


def open_tables(spark: SparkSession, folder: str, dimension: int | None = None) -> dict[str, DataFrame]:
    """The declared tables of a store; vectors of another dimension than ``dimension`` are marked stale."""
    out = {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in SCHEMAS.items()}
    if dimension is not None:
        out["embeddings"] = out["embeddings"].withColumn("stale", F.coalesce(F.size("embedding") != dimension, F.lit(True)))
    return out


def tags(raw: Column) -> Column:
    """Tags of a JSON array; malformed JSON gives none, and what isn't a string is dropped."""
    items = F.from_json(raw, "array<variant>")
    text = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.filter(text, lambda t: t.isNotNull())


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows as memories: tags as an array, and valid since they were made where nothing else is said."""
    return rows.withColumn("tags", tags(F.col("tags"))).withColumn("valid_from", F.coalesce("valid_from", "created_at"))


def json_array(spark: SparkSession, path: str, schema: str, stride: int = 1, limit: int | None = None) -> DataFrame:
    """Rows of a top-level JSON array by ``schema`` with their ``index``: every stride-th, then at most so many.

    A file is one value, so the index is exact; only the elements wanted are parsed further.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = whole.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("index", "item")).where(F.col("index") % stride == 0)
    if limit is not None:
        items = items.orderBy("index").limit(limit)
    return items.select("index", F.from_json(F.to_json("item"), schema).alias("r")).select("index", "r.*")


def json_facts(spark: SparkSession, path: str) -> tuple[int, str]:
    """How many elements a top-level JSON array has, and the digest of its file."""
    count = spark.read.text(path, wholetext=True).select(F.size(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"))).first()[0]
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return count, digest


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of one JSON object a line; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def fact_pool(lines: DataFrame, column: str = "context") -> DataFrame:
    """(serial, fact) of numbered lines."""
    line = F.explode(F.split(column, "\n")).alias("line")
    out = lines.select(line).where(F.col("line").rlike(r"^\d+\.\s*.+$"))
    return out.select(F.regexp_extract("line", r"^(\d+)\.", 1).cast("long").alias("serial"), F.regexp_extract("line", r"^\d+\.\s*(.+)$", 1).alias("fact"))


def dialogue_turns(records: DataFrame) -> DataFrame:
    """(sample_id, session, position, dia_id, speaker, text) of dialogues whose sessions are the keys
    ``session_N`` of a map ``conversation`` of arrays; other keys, such as dates, are passed over."""
    entry = records.select("sample_id", F.explode("conversation").alias("key", "value"))
    own = entry.where(F.col("key").rlike(r"^session_\d+$"))
    turn = "array<struct<dia_id: string, speaker: string, text: string>>"
    turns = own.select("sample_id", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session"), F.posexplode(F.from_json(F.to_json("value"), turn)).alias("position", "t"))
    return turns.select("sample_id", "session", "position", "t.dia_id", "t.speaker", "t.text")


def haystack(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus rows (question_id, session_id, date, content) and what answers each question: targets (array)
    and the latest of them by date. A session's content is its turns, one a line, with their roles."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    rows = records.select("question_id", "answer_session_ids", F.explode(zipped).alias("s"))
    line = F.transform("s.turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    corpus = rows.select("question_id", F.col("s.id").alias("session_id"), dataset_time(F.col("s.date")).alias("date"), F.array_join(line, "\n").alias("content"))
    hit = rows.where(F.array_contains("answer_session_ids", F.col("s.id")))
    qrels = hit.groupBy("question_id").agg(F.array_sort(F.collect_set("s.id")).alias("targets"), F.max_by("s.id", F.struct(dataset_time(F.col("s.date")), F.col("s.id"))).alias("latest_target"))
    return corpus, qrels


def dataset_time(text: Column) -> Column:
    """Milliseconds of dates like ``2023/05/20 (Sat) 02:21``; null where they aren't such."""
    plain = F.regexp_replace(text, r"\s*\([A-Za-z]+\)\s*", " ")
    return F.unix_millis(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")))


def drift(rows: DataFrame, required: StructType) -> list[str]:
    """Fields that a data set should have and lacks, or has by another type."""
    have = {f.name: f.dataType for f in rows.schema}
    out = []
    for f in required:
        if f.name not in have:
            out.append(f"{f.name}: missing")
        elif have[f.name] != f.dataType:
            out.append(f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
    return out


def staged(page: DataFrame, stored: DataFrame) -> DataFrame:
    """Items of a source's page (source, item_id, content, generation) that are new or changed: revisions
    with the digest of their content. Applying a page twice stages nothing the second time.

    ``stored``: source, item_id, revision, content_hash, generation. An older generation changes nothing.
    """
    last = stored.groupBy("source", "item_id").agg(F.max(F.struct("revision", "content_hash", "generation")).alias("l"))
    rows = page.withColumn("content_hash", F.sha2("content", 256)).join(last, ["source", "item_id"], "left")
    new = F.col("l").isNull() | ((F.col("content_hash") != F.col("l.content_hash")) & (F.col("generation") >= F.col("l.generation")))
    return rows.where(new).select("source", "item_id", (F.coalesce("l.revision", F.lit(0)) + 1).alias("revision"), "content_hash", "generation", "content")
