"""Queries over a change feed that is read in pages and applied once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallspark.plans.registry import query
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors
from recallspark.sources.connector import ParquetFeed, SourceState, sync
from recallspark.sources.tables import table

#: Changes made of events: items are users by kind of props, deletions are rare.
_FEED = """c AS (SELECT event_id AS seq, CASE WHEN event_id % 89 = 7 THEN 'delete' ELSE 'upsert' END AS kind, concat('u', CAST(user_id AS STRING), props) AS item,
concat(event_type, CAST(event_id % 3 AS STRING)) AS revision, concat('is ', event_type) AS content FROM events)""".replace("AS STRING", "AS VARCHAR")


def _synced(spark, d) -> SourceState:
    ensure_on_executors(spark)
    e, i = table(spark, d, "events"), F.col("event_id")
    feed = e.select(
        i.cast("long").alias("seq"), F.when(i % 89 == 7, "delete").otherwise("upsert").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string"), "props").alias("external_id"),
        F.concat("event_type", (i % 3).cast("string")).alias("revision"), F.concat(F.lit("is "), "event_type").alias("content"), F.lit(None).cast("long").alias("occurred_at"),
    )
    root = f"{Scratch.of(spark).root}/source-{uuid.uuid4().hex}"
    # in order and in small row groups, so that a range's task reads little beside it
    feed.repartitionByRange("seq").sortWithinPartitions("seq").write.option("parquet.block.size", 4 << 20).parquet(f"{root}/feed")
    state = SourceState(spark, f"{root}/state")
    sync(spark, ParquetFeed(f"{root}/feed"), state, f"{root}/checkpoint", page=50_000)
    return state


@query("synced_items", f"""WITH {_FEED}, g AS (SELECT item, min(seq) AS gone FROM c WHERE kind = 'delete' GROUP BY 1),
r AS (SELECT item, revision, content, min(seq) AS seq FROM c LEFT JOIN g USING (item) WHERE kind = 'upsert' AND (gone IS NULL OR seq < gone) GROUP BY 1, 2, 3)
SELECT item AS external_id, arg_max(revision, seq) AS revision, arg_max(content, seq) AS content FROM r WHERE item NOT IN (SELECT item FROM g) GROUP BY 1""")
def synced_items(spark, d):
    return _synced(spark, d).items().select("external_id", "revision", "content")


@query("synced_pages", f"""WITH {_FEED}, p AS (SELECT *, seq // 50000 + 1 AS generation FROM c), g AS (SELECT item, min(seq) AS gone FROM c WHERE kind = 'delete' GROUP BY 1),
u AS (SELECT item, revision, min(seq) AS seq FROM c LEFT JOIN g USING (item) WHERE kind = 'upsert' AND (gone IS NULL OR seq < gone) GROUP BY 1, 2)
SELECT generation, count(*) FILTER (kind = 'upsert' AND u.item IS NOT NULL) AS upserted, count(*) FILTER (kind = 'delete') AS deleted, count(*) FILTER (kind = 'upsert' AND u.item IS NULL) AS skipped
FROM p LEFT JOIN u ON u.item = p.item AND u.revision = p.revision AND u.seq = p.seq GROUP BY 1""")
def synced_pages(spark, d):
    return _synced(spark, d).journal().select("generation", "upserted", "deleted", "skipped")
