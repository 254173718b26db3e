"""Change feeds of external sources: a streaming source with its own offsets, and pages applied once.

``change_stream`` reads a connector in pages. An offset is the cursor after a micro-batch's last page, that page's
generation and the steps of a page; a micro-batch's pages are read by tasks in ranges. ``SourceState`` keeps what
was applied: immutable revisions, tombstones and a journal of pages. Pages become visible with their journal entries,
so pages that failed midway are applied again from the start, and a page that is already there is only compared by
its digest. Pages of a micro-batch are applied together, with the results and entries of pages applied one by one;
if one of them is refused, those before it are applied singly.

Within an item, changes count in the feed's order. A deleted item never comes back, under no revision;
a revision that was seen never becomes current again, and must not change its content.

Defined results: a null content is empty; items without id are one item with an empty id; unknown kinds of
changes are refused, as is a page that doesn't begin where the last one ended; pages without changes
advance the cursor; other columns of a page are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.plans.scratch import Scratch
from recallspark.sources.generations import Generations

CHANGE = "seq long, kind string, external_id string, revision string, content string, occurred_at long"
#: What the stream adds to each change: the page that it belongs to. One row of kind ``page`` stands for the page itself.
PAGED = CHANGE + ", page_start long, page_end long, generation long"
#: Cursor steps of a page, and at most.
PAGE, MOST_PAGE = 100, 1_000_000
#: Pages and cursor steps that ``sync`` applies together at most, and tasks that read them.
BATCH_PAGES, BATCH_STEPS, MOST_PARTS = 1_000, 4_000_000, 64


class Connector(Protocol):
    """A feed of numbered changes; it is sent to tasks, so it must be picklable and hold no connection."""

    def head(self) -> int:
        """The cursor after the last change there is."""

    def changes(self, start: int, end: int) -> Iterator[tuple]:
        """Changes with start <= seq < end, as tuples of ``CHANGE``."""


@dataclass(frozen=True)
class ParquetFeed:
    """A feed kept as a Parquet table with the columns of ``CHANGE``, on storage that all machines reach."""

    path: str

    def _table(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return ds.dataset(self.path, format="parquet")
        files, path = fs.FileSystem.from_uri(self.path)
        return ds.dataset(path, filesystem=files, format="parquet")

    def head(self) -> int:
        import pyarrow.compute as pc

        last = -1
        for part in self._table().get_fragments():
            told = [g.statistics.get("seq", {}).get("max") if g.statistics else None for g in part.row_groups if g.num_rows]
            if None in told:  # files whose writer kept no statistics are read
                told = [pc.max(b.column("seq")).as_py() for b in part.to_batches(columns=["seq"]) if b.num_rows]
            last = max([last, *told])
        return last + 1

    def changes(self, start: int, end: int) -> Iterator[tuple]:
        import pyarrow.dataset as ds

        names = [c.split()[0] for c in CHANGE.split(", ")]
        wanted = (ds.field("seq") >= start) & (ds.field("seq") < end)
        for batch in self._table().to_batches(columns=names, filter=wanted):
            yield from zip(*(batch.column(c).to_pylist() for c in names))


def change_source(connector: Connector, name: str = "change_pages"):
    """A data source class for ``spark.dataSource.register``, bound to the connector."""
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    source_name, schema = name, PAGED

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.page, self.parts = int(options.get("page", PAGE)), int(options.get("parts", 4))
            self.pages = int(options.get("pages", 1))
            self.at = {"cursor": int(options.get("cursor", 0)), "generation": int(options.get("generation", 0)), "page": self.page}

        def initialOffset(self) -> dict:
            return dict(self.at)

        def latestOffset(self) -> dict:
            # asked several times for one batch: only a planned batch moves the place from which the next is told
            at = self.at["cursor"]
            end = min(connector.head(), at + self.page * self.pages)
            return {"cursor": end, "generation": self.at["generation"] - (at - end) // self.page, "page": self.page} if end > at else dict(self.at)

        def partitions(self, start: dict, end: dict):
            self.commit(end)
            a, b = start["cursor"], end["cursor"]
            step = end.get("page", b - a)
            n = max(1, min(self.parts * (end["generation"] - start["generation"]), max(self.parts, MOST_PARTS), b - a))
            cuts = [a + (b - a) * i // n for i in range(n + 1)]
            return [InputPartition((x, y, a, b, step, start["generation"])) for x, y in zip(cuts, cuts[1:]) if y > x]

        def commit(self, end: dict) -> None:
            if end["generation"] > self.at["generation"]:
                self.at = dict(end)

        def read(self, partition):
            x, y, a, b, step, before = partition.value
            page = lambda i: (a + i * step, min(a + (i + 1) * step, b), before + 1 + i)
            for i in range((x - a + step - 1) // step, (y - a + step - 1) // step):  # pages that begin here
                yield (None, "page", None, None, None, None, *page(i))
            for change in connector.changes(x, y):
                yield (*change, *page((change[0] - a) // step))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


@dataclass(frozen=True)
class SourceState:
    """What one source's pages have made, below ``path``."""

    spark: SparkSession
    path: str

    @property
    def _pages(self) -> Generations:
        return Generations(self.spark, self.path, "journal")

    def _read(self, part: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{n}/{part}" for n in self._pages.names()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def journal(self) -> DataFrame:
        return self._read("journal", "generation long, from_cursor long, next_cursor long, page_hash string, upserted long, deleted long, skipped long")

    def revisions(self) -> DataFrame:
        return self._read("revisions", "external_id string, revision string, content string, content_hash string, occurred_at long, seq long, generation long")

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", "external_id string, generation long")

    def position(self) -> tuple[int, int]:
        """Cursor and generation after the last page."""
        last = self.journal().agg(F.max(F.struct("generation", "next_cursor")).alias("l")).first()["l"]
        return (last["next_cursor"], last["generation"]) if last else (0, 0)

    def items(self) -> DataFrame:
        """The current revision of every item that has one."""
        best = self.revisions().groupBy("external_id").agg(F.max(F.struct("seq", "revision", "content", "content_hash", "occurred_at")).alias("r"))
        live = best.join(self.tombstones().select("external_id").distinct(), "external_id", "left_anti")
        return live.select("external_id", "r.revision", "r.content", "r.content_hash", "r.occurred_at")

    def withdrawn(self) -> DataFrame:
        """(external_id, revision) of revisions that are replaced or deleted; what was derived from them is to be purged."""
        return self.revisions().select("external_id", "revision").join(self.items().select("external_id", "revision"), ["external_id", "revision"], "left_anti")

    def apply(self, page: DataFrame, start: int, end: int, generation: int) -> dict:
        """Applies a page of changes and returns its counts; ``replay`` where it was there already."""
        return self.apply_pages(page.withColumn("generation", F.lit(generation).cast("long")), [(start, end, generation)])[0]

    def apply_pages(self, changes: DataFrame, pages: list[tuple[int, int, int]]) -> list[dict]:
        """Applies pages (start, end, generation) that follow each other and returns the counts of each; ``changes`` have their page's generation."""
        scratch = Scratch.of(self.spark)
        rows = changes.select("seq", "kind", F.coalesce("external_id", F.lit("")).alias("external_id"), F.coalesce("revision", F.lit("")).alias("revision"), F.coalesce("content", F.lit("")).alias("content"), "occurred_at", "generation")
        rows = scratch.save(rows)
        try:
            return self._apply(rows, pages)
        except ValueError:
            if len(pages) == 1:
                raise
            # those before the refused page count
            return [self._apply(rows.where(F.col("generation") == page[2]), [page])[0] for page in pages]
        finally:
            scratch.drop(rows)

    def _apply(self, rows: DataFrame, pages: list[tuple[int, int, int]]) -> list[dict]:
        every: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns if c != "generation"]
        each = F.sha2(F.concat_ws("\1", *every), 256)
        # sums of the changes' digests: the same in any order, and combined before they are gathered
        sums = [F.sum(F.conv(F.substring(each, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
        known_kind = F.col("kind").isin("upsert", "delete")
        digest = F.sha2(F.concat_ws(",", *[x.cast("string") for x in sums]), 256)
        told = rows.groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(known_kind, F.lit(False))).alias("strange"), F.count_if(F.col("kind") == "delete").alias("deleted"), digest.alias("hash"))
        told = {r["generation"]: r for r in told.collect()}  # a row for each page
        if strange := sum(r["strange"] for r in told.values()):
            raise ValueError(f"{strange} changes of unknown kinds")
        hashes = {g: told[g]["hash"] if g in told else sha256(b"").hexdigest() for _, _, g in pages}
        there = {r["generation"]: r for r in self.journal().where(F.col("generation").between(pages[0][2], pages[-1][2])).collect()}
        for start, end, generation in pages:
            entry = there.get(generation)
            if entry is not None and (entry["page_hash"], entry["from_cursor"], entry["next_cursor"]) != (hashes[generation], start, end):
                raise ValueError("a page that was applied came back with other changes")
        new_pages = [p for p in pages if p[2] not in there]
        last = self.position() if new_pages else None
        for start, end, generation in new_pages:
            if last != (start, generation - 1):
                raise ValueError("a page doesn't begin where the last one ended")
            last = (end, generation)
        counts = {g: {k: r[k] for k in ("upserted", "deleted", "skipped")} | {"replay": True} for g, r in there.items()}
        if new_pages:
            counts |= self._write(rows.where(F.col("generation") >= new_pages[0][2]), new_pages, told, hashes)
        return [counts[g] for _, _, g in pages]

    def _write(self, rows: DataFrame, pages: list[tuple[int, int, int]], told: dict, hashes: dict[int, str]) -> dict[int, dict]:
        rows = rows.withColumn("content_hash", F.sha2(F.concat_ws("\1", "content", F.coalesce(F.col("occurred_at").cast("string"), F.lit(""))), 256))
        deleted = rows.where("kind = 'delete'").groupBy("external_id").agg(F.min("seq").alias("gone"))
        upserts = rows.where("kind = 'upsert'").join(deleted, "external_id", "left").where("gone is null or seq < gone").drop("gone")
        live = upserts.join(self.tombstones().select("external_id").distinct(), "external_id", "left_anti")
        seen = self.revisions().select("external_id", "revision", F.col("content_hash").alias("was"))
        both = live.join(seen, ["external_id", "revision"], "left")
        other = both.groupBy("external_id", "revision").agg(F.min("content_hash").alias("lo"), F.max("content_hash").alias("hi"), F.min("was").alias("was"))
        if not other.where("lo <> hi or (was is not null and was <> lo)").isEmpty():
            raise ValueError("a revision came back with other content")
        first = F.min(F.struct("seq", "content", "content_hash", "occurred_at", "generation")).alias("f")
        new = both.where("was is null").groupBy("external_id", "revision").agg(first)
        new = new.select("external_id", "revision", "f.content", "f.content_hash", "f.occurred_at", "f.seq", "f.generation")
        folder = self._pages.folder(pages[-1][2])
        new.write.mode("overwrite").parquet(f"{folder}/revisions")
        rows.where("kind = 'delete'").select("external_id", "generation").distinct().write.mode("overwrite").parquet(f"{folder}/tombstones")
        upserted = {r["generation"]: r["count"] for r in self.spark.read.parquet(f"{folder}/revisions").groupBy("generation").count().collect()}
        counts = {}
        for _, _, g in pages:
            n, gone = (told[g]["n"], told[g]["deleted"]) if g in told else (0, 0)
            counts[g] = {"upserted": upserted.get(g, 0), "deleted": gone, "skipped": n - upserted.get(g, 0) - gone}
        lines = [(g, start, end, hashes[g], *counts[g].values()) for start, end, g in pages]
        schema = "generation long, from_cursor long, next_cursor long, page_hash string, upserted long, deleted long, skipped long"
        self.spark.createDataFrame(lines, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/journal")  # the pages are visible from here
        return {g: c | {"replay": False} for g, c in counts.items()}


def change_stream(spark: SparkSession, connector: Connector, state: SourceState, page: int = PAGE, parts: int = 4, pages: int = 1) -> DataFrame:
    """The feed from where the state's last page ended, so many pages to a micro-batch at most."""
    if not 1 <= page <= MOST_PAGE:
        raise ValueError(f"a page has 1 to {MOST_PAGE} steps")
    cursor, generation = state.position()
    source = change_source(connector)
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(page=page, parts=parts, pages=pages, cursor=cursor, generation=generation).load()


def sync(spark: SparkSession, connector: Connector, state: SourceState, checkpoint: str, page: int = PAGE, apply: Callable | None = None) -> None:
    """Applies all pages there are, then stops. ``apply(state, rows, start, end, generation)`` may stand for ``state.apply``; it gets pages one by one.

    Pages carry their own ranges, so a micro-batch that comes again after a failure has the same pages.
    """
    scratch = Scratch.of(spark)
    together = 1 if apply else max(1, min(BATCH_PAGES, BATCH_STEPS // page))

    def batch(rows: DataFrame, number: int) -> None:
        rows = scratch.save(rows)  # the feed is read once
        try:
            marks = rows.where("kind = 'page' and seq is null").select("page_start", "page_end", "generation").collect()
            pages = sorted(map(tuple, marks), key=lambda p: p[2])
            changes = rows.where("seq is not null").drop("page_start", "page_end")
            if apply:
                for start, end, generation in pages:
                    apply(state, changes.where(F.col("generation") == generation).drop("generation"), start, end, generation)
            elif pages:
                state.apply_pages(changes, pages)
        finally:
            scratch.drop(rows)

    query = change_stream(spark, connector, state, page, pages=together).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
