"""An inverted index on shared storage: postings in blocks with their maxima, merged by batches.

A row of ``postings`` is a block: all documents of one term whose ids share their upper bits, ids
ascending, with each field's counts and the documents' lengths, and the block's maxima. Blocks are
bounded in documents, so a term that every document holds is many rows. Rows are partitioned by a hash of
the term and sorted by (term, block): a query reads its terms' partitions only.

Every batch is a generation of its own, a folder that becomes visible once its last file is there.
A document counts as its newest generation says, so a batch that is written again changes nothing.
``compact`` merges all generations into one, which equals the index built from the documents as they are then.

Defined results: documents without id are not indexed; null texts are empty; an id that a batch repeats is
its row with the greatest texts; deleted ids may be unknown; an empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions import scoring
from recallspark.functions.text import tokens
from recallspark.operators.retrieval import B, CONTENT_WEIGHT, K1, TAG_WEIGHT, Counted, count_names, counted
from recallspark.plans.scratch import Scratch
from recallspark.sources.generations import Generations

#: Partitions of terms, files in each at most, and lower bits of ids that a block spans.
BUCKETS, FILES, BLOCK_BITS = 64, 4, 12
#: Blocks that the first look of a best-matches search evaluates.
PROBED = 16
FIELDS = {"content": CONTENT_WEIGHT, "tags": TAG_WEIGHT}


@dataclass(frozen=True)
class PostingsIndex:
    """Postings of documents (id and text fields) below ``path``; ``fields`` are names and weights of fields."""

    spark: SparkSession
    path: str
    fields: tuple[tuple[str, float], ...]
    buckets: int = BUCKETS
    bits: int = BLOCK_BITS

    @classmethod
    def create(cls, docs: DataFrame, path: str, fields: dict[str, float] | None = None, buckets: int = BUCKETS, bits: int = BLOCK_BITS) -> PostingsIndex:
        index = cls(docs.sparkSession, path, tuple((fields or FIELDS).items()), buckets, bits)
        index._write(index._counted(docs), index._lengths(docs), index._all.folder(0, full=True))
        return index

    # -- generations

    @property
    def _all(self) -> Generations:
        return Generations(self.spark, self.path, "docs")

    def generations(self) -> list[str]:
        """Folders of the newest full generation and of the batches after it, oldest first."""
        return self._all.names()

    def add(self, docs: DataFrame, deleted: DataFrame | None = None, number: int | None = None) -> int:
        """Writes a batch of new and changed documents and of deleted ids; the same ``number`` again replaces it."""
        last = Generations.number(self.generations()[-1])
        number = last + 1 if number is None else number
        lengths = self._lengths(docs)
        if deleted is not None:
            gone = deleted.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().join(lengths.select("id"), "id", "left_anti")
            lengths = lengths.unionByName(gone.select("id", F.lit(0).alias("dl"), F.lit(True).alias("deleted")))
        self._write(self._counted(docs), lengths, self._all.folder(number))
        return number

    def compact(self) -> None:
        """Merges all generations into one; the folders merged are deleted once it is visible."""
        old = self.generations()
        if len(old) == 1:
            return
        names, folder = [f for f, _ in self.fields], self._all.folder(Generations.number(old[-1]) + 1, full=True)
        self._write(self._live(None).select("term", "id", "dl", *names), self.documents(), folder)
        self._all.drop(old)

    # -- writing

    def _rows(self, docs: DataFrame) -> DataFrame:
        texts = [F.coalesce(F.col(f), F.lit("")).alias(f) for f, _ in self.fields]
        rows = docs.select(F.col("id").cast("long").alias("id"), *texts).where("id is not null")
        best = rows.groupBy("id").agg(F.max(F.struct(*[f for f, _ in self.fields])).alias("r"))
        return best.select("id", "r.*")

    def _lengths(self, docs: DataFrame) -> DataFrame:
        length = sum((F.length(f) for f, _ in self.fields), F.lit(0))
        return self._rows(docs).select("id", length.cast("int").alias("dl"), F.lit(False).alias("deleted"))

    def _counted(self, docs: DataFrame) -> DataFrame:
        """term, id, dl and the count in each field."""
        rows = self._rows(docs)
        length = sum((F.length(f) for f, _ in self.fields), F.lit(0)).cast("int").alias("dl")
        # all words of a row in one list: counts of (term, id) need no other exchange than that of the ids
        marked = lambda f, j: F.transform(tokens(F.col(f)), lambda t: F.struct(t.alias("term"), F.lit(j).alias("field")))
        each = [marked(f, j) for j, (f, _) in enumerate(self.fields)]
        # lengths come out of a generator of their own: computed after the words' they would be computed for each word
        every = rows.select("id", F.inline(F.array(F.struct(length, F.concat(*each).alias("words"))))).select("id", "dl", F.inline("words"))
        counts = [F.count_if(F.col("field") == j).cast("int").alias(f) for j, (f, _) in enumerate(self.fields)]
        return every.groupBy("term", "id").agg(F.first("dl").alias("dl"), *counts)

    def _write(self, counts: DataFrame, lengths: DataFrame, folder: str) -> None:
        names = [f for f, _ in self.fields]
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        block = F.shiftright("id", self.bits)
        # a bucket's blocks are dealt to some tasks, all rows of a block to one
        dealt = counts.withColumn("bucket", bucket).withColumn("block", block).withColumn("file", F.pmod(F.xxhash64("block"), F.lit(FILES)))
        dealt = dealt.repartition("bucket", "file")
        entry = F.array_sort(F.collect_list(F.struct("id", "dl", *names)))
        blocks = dealt.groupBy("bucket", "file", "term", "block").agg(entry.alias("e"))
        columns = [F.col("e.id").alias("ids"), F.col("e.dl").alias("dls"), *[F.col(f"e.{f}").alias(f) for f in names]]
        maxima = [F.size("e").alias("n"), F.array_min("e.dl").alias("least_dl"), *[F.array_max(f"e.{f}").alias(f"most_{f}") for f in names]]
        out = blocks.select("bucket", "term", "block", *columns, *maxima).sortWithinPartitions("bucket", "term", "block")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        lengths.write.mode("overwrite").parquet(f"{folder}/docs")  # the folder is visible from here

    # -- reading

    def _schema(self) -> str:
        arrays = ", ".join(f"`{f}` array<int>" for f, _ in self.fields)
        most = ", ".join(f"`most_{f}` int" for f, _ in self.fields)
        return f"term string, block long, ids array<long>, dls array<int>, {arrays}, n int, least_dl int, {most}, bucket int"

    def blocks(self, terms: list[str] | None, generation: str) -> DataFrame:
        """Blocks of a generation; only the partitions that the terms hash to are listed and read."""
        rows = self.spark.read.schema(self._schema()).parquet(f"{self.path}/{generation}/postings")
        if terms is None:
            return rows
        own = F.lit(False)
        for t in terms:
            own = own | ((F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int")) & (F.col("term") == t))
        return rows.where(own)

    def _docs(self, generation: str) -> DataFrame:
        return self.spark.read.schema("id long, dl int, deleted boolean").parquet(f"{self.path}/{generation}/docs")

    def documents(self) -> DataFrame:
        """(id, dl, deleted = false) of all live documents."""
        names, out = self.generations(), None
        for i, name in enumerate(names):
            own = self._newest(self._docs(name), names[i + 1 :])
            out = own if out is None else out.unionByName(own)
        return out.where("not deleted")

    def _newest(self, rows: DataFrame, later: list[str]) -> DataFrame:
        """Rows of ids that no later generation holds."""
        for name in later:
            rows = rows.join(self._docs(name).select("id"), "id", "left_anti")
        return rows

    def _live(self, terms: list[str] | None) -> DataFrame:
        """(term, id, dl, count in each field) of live postings."""
        names, fields, out = self.generations(), [f for f, _ in self.fields], None
        for i, name in enumerate(names):
            each = F.explode(F.arrays_zip("ids", "dls", *fields)).alias("e")
            rows = self.blocks(terms, name).select("term", each)
            rows = rows.select("term", F.col("e.ids").alias("id"), F.col("e.dls").alias("dl"), *[F.col(f"e.{f}").alias(f) for f in fields])
            rows = self._newest(rows, names[i + 1 :])
            out = rows if out is None else out.unionByName(rows)
        return out

    def count(self, terms: list[str], scope: DataFrame | None = None) -> Counted:
        """Counts of the terms over the scope (id), or over all documents, as a pass over its texts would give."""
        rows, docs = self._live(terms), self.documents()
        if scope is not None:
            ids = scope.select("id")
            rows, docs = rows.join(ids, "id", "left_semi"), docs.join(ids, "id", "left_semi")
        value = lambda t, f: F.max(F.when(F.col("term") == t, F.col(f)).otherwise(0)).cast("double")
        cells = [value(t, f) for t in terms for f, _ in self.fields]
        named = [c.alias(n) for c, n in zip(cells, count_names(len(terms), len(self.fields)))]
        hits = Scratch.of(self.spark).save(rows.groupBy("id").agg(F.max("dl").cast("double").alias("dl"), *named))
        size, mean = docs.agg(F.count(F.lit(1)), F.avg("dl")).first()
        return counted(hits, len(terms), tuple(w for _, w in self.fields), size, mean)

    def frequencies(self) -> DataFrame:
        """(term, df and occurrences in each field) of all live documents."""
        return self._live(None).groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[F.sum(f).alias(f) for f, _ in self.fields])

    def best(self, terms: list[str], k: int, every: bool = False, probed: int = PROBED) -> DataFrame:
        """(id, bm25): the k best of all documents, exactly; with ``every``, of those that hold all terms.

        A block's maxima bound the score of its documents. The most promising blocks are evaluated
        first; their k-th score rules out all blocks that can't reach it, whose postings are never read.
        Where batches wait to be merged, all postings of the terms are.
        """
        names, terms = self.generations(), list(dict.fromkeys(terms))
        if len(names) > 1:
            c = self.count(terms)
            rows = c.hits.where(c.matched == c.terms) if every else c.hits
            return rows.select("id", c.bm25.alias("bm25")).orderBy(F.desc("bm25"), "id").limit(k)
        size, mean = self._docs(names[0]).agg(F.count(F.lit(1)), F.avg("dl")).first()
        held = self.blocks(terms, names[0])
        df = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row for each term
        idf = F.coalesce(*[F.when(F.col("term") == t, scoring.scoped_idf(F.lit(float(size)), F.lit(float(df.get(t, 0))))) for t in terms])

        def score(length: Column, count) -> Column:
            norm = K1 * (1 - B + B * length / F.lit(float(mean or 1.0)))
            return idf * sum((w * count(f) * (K1 + 1) / (w * count(f) + norm) for f, w in self.fields), F.lit(0.0))

        most = score(F.col("least_dl"), lambda f: F.col(f"most_{f}"))
        bounds = held.select("block", most.alias("s")).groupBy("block").agg(F.sum("s").alias("most"), F.count(F.lit(1)).alias("n"))
        if every:
            bounds = bounds.where(F.col("n") == len(terms))
        bounds = Scratch.of(self.spark).save(bounds.select("block", "most"))

        def evaluated(chosen: DataFrame) -> DataFrame:
            rows = held.join(chosen.select("block"), "block", "left_semi")
            each = rows.select("term", F.explode(F.arrays_zip("ids", "dls", *[f for f, _ in self.fields])).alias("e"))
            scores = each.select(F.col("e.ids").alias("id"), score(F.col("e.dls"), lambda f: F.col(f"e.{f}")).alias("s")).groupBy("id").agg(F.sum("s").alias("bm25"), F.count(F.lit(1)).alias("n"))
            return scores.where(F.col("n") == len(terms)) if every else scores

        first = evaluated(bounds.orderBy(F.desc("most"), "block").limit(probed)).orderBy(F.desc("bm25")).limit(k).agg(F.count(F.lit(1)), F.min("bm25")).first()
        least = first[1] if first[0] == k else None
        # a bound and a score sum in different orders: the margin is far above their rounding
        rest = bounds if least is None else bounds.where(F.col("most") >= least * (1 - 1e-9))
        return evaluated(rest).select("id", "bm25").orderBy(F.desc("bm25"), "id").limit(k)
