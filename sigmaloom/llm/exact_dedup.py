"""Exact dedup by a persistent digest index.

The index is a table bucketed and sorted by digest, with a partition for each batch that was added. Of a batch it has one row
for each distinct text: text_sha256, keep_id, group_size (rows of that batch) and first, whether no earlier batch had the text.
A batch is reduced to one row for each digest with partial aggregation, anti-joined to the index by sort-merge, and appended:
what is new with the id that stays, what is known with its count. Counts over all batches are added up at reading. The index's
side of every join is read in its buckets, without a shuffle. DataFrame operations only.

A batch has a name. A batch that is added again under its name, as after a failure, appends only what is not there yet, even if
the failure came in the middle of the append, and gets the answer that it had or would have had. Batches are added one at a time.

Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts in one batch the row
with the largest doc_id stays; a text that the index already holds stays with the id it has there.

A digest that many of a batch's rows have is joined by broadcast, so no task gets all of its rows (see common.spread_join).

Edge cases: a null doc_id is smaller than any other, and among equal texts that all have null ids one row stays; of rows that
share text and doc_id one stays (which one cannot be told apart by these columns); an empty table adds
nothing; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A catalog table of digests, bucketed and sorted by them, whose files lie in the shared folder or at `path`."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None) -> None:
        """buckets: of a new table; by default as many as a shuffle has partitions, so that a batch that was just aggregated or
        joined by digest already lies in the table's buckets."""
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or common.shared_path(spark, name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        """Every appended row: text_sha256, keep_id, group_size, first, and the batch's number and name."""
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """One row for each digest: text_sha256, keep_id, group_size over all batches."""
        return self.rows().groupBy("text_sha256").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, rows: DataFrame) -> None:
        """rows: of one batch, one for each digest, hash-partitioned by digest: each task writes whole buckets."""
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(self.buckets, "text_sha256")
        out = rows.select("text_sha256", "keep_id", "group_size", "first", "batch_no", "batch").write.format("parquet").mode("append").partitionBy("batch_no", "batch")
        out.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").option("path", self.path).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _number(self, batch: str) -> tuple[int, bool]:
        """The number of a batch, and whether some of it is there. Reads partition values only, one row for each batch."""
        known = {r["batch"]: r["batch_no"] for r in self.rows().groupBy("batch_no", "batch").agg(F.lit(1)).collect()} if self.exists() else {}
        return known.get(batch, 1 + max(known.values(), default=0)), batch in known

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch of (doc_id, text_sha256, row), row being different in every row. Returns a row for each row of it: doc_id,
        keep_id, group_size (of its rows with that text and those of earlier batches), kept, text_sha256. batch: its name; a batch
        without one is a new one."""
        batch = batch or uuid.uuid4().hex
        best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
        mine = digests.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        mine = mine.select("text_sha256", F.col("best.doc_id").alias("keep_id"), (-F.col("best.row")).alias("row"), "group_size")
        number, again = self._number(batch)
        tag = [F.lit(number).alias("batch_no"), F.lit(batch).alias("batch")]
        if not self.exists():
            self.append(mine.limit(0).withColumn("first", F.lit(True)).select("*", *tag))
        mine = common.staged(mine, "digest-batch")
        earlier = self.rows().where((F.col("batch_no") < number) & F.col("first")).select("text_sha256").hint("merge")
        new = mine.join(earlier, "text_sha256", "left_anti").withColumn("first", F.lit(True))
        known = mine.join(earlier, "text_sha256", "left_semi").withColumn("first", F.lit(False)).withColumn("keep_id", F.lit(None).cast(mine.schema["keep_id"].dataType))
        for part in (new, known) if number > 1 else (new,):
            if again:  # what came to the table before a failure
                part = part.join(self.rows().where(F.col("batch_no") == number).select("text_sha256").hint("merge"), "text_sha256", "left_anti")
            self.append(part.select("*", *tag))
        held = self.rows().where(F.col("batch_no") <= number)
        if number > 1:
            held = held.join(mine.select("text_sha256").hint("merge"), "text_sha256", "left_semi")
        first = F.max_by(F.struct("keep_id", "batch_no"), "first")  # one row of a digest is its first
        one = held.groupBy("text_sha256").agg(first.alias("at"), F.sum("group_size").alias("group_size"))
        one = one.select("text_sha256", F.col("at.keep_id").alias("keep_id"), "group_size", (F.col("at.batch_no") == number).alias("new"))
        one = one.join(mine.select("text_sha256", F.col("row").alias("stays"), F.col("group_size").alias("rows")).hint("merge"), "text_sha256")
        found = common.spread_join(digests, common.staged(one, "digest-answers"), ["text_sha256"], "rows")
        kept = F.col("new") & (F.col("row") == F.col("stays"))
        return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 and row (a number for each row) of df, computed once and kept in the shared folder."""
    rows = df.select(df[id_col].alias("doc_id"), digest(df[text_col]).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    return common.staged(rows, "digests")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None, batch: str | None = None) -> DataFrame:
    """Puts the digests of df's rows into an index, a new one if no name is given, and returns a row for each of them, see DigestIndex.add."""
    return DigestIndex(df.sparkSession, name or common.temporary_table("digest_index")).add(digests(df, id_col, text_col), batch)


def unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of df that stay, with df's columns, whatever their names. Null texts count as empty ones."""
    kept_id, kept_sha, row_sha = common.new_names(df, "kept_id", "kept_sha", "row_sha")
    found = dedup(df, id_col, text_col, name, batch).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    marked = df.withColumn(row_sha, digest(df[text_col]))
    stays = marked.join(found, marked[id_col].eqNullSafe(found[kept_id]) & (marked[row_sha] == found[kept_sha]), "left_semi")
    repeated = df.groupBy(F.col(id_col), digest(df[text_col])).count().where("count > 1")
    if not repeated.isEmpty():
        stays = stays.dropDuplicates([id_col, row_sha])
    return stays.drop(row_sha)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
