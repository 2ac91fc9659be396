"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one
row per digest, sort-merge anti-joined with the index (whose side needs no
shuffle), and what is new is appended. Only DataFrame operations are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kickframe.session import scratch_path, shuffles_freed, stage

#: White space that counts as one blank.
WHITE = r"[\x20\x09-\x0D]+"
BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per (`digest`, `doc_id`) with the number of `copies`, as a table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    return stage(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")


class DigestIndex:
    """A bucketed table (`digest`, `doc_id`) in the folder `path`: who was first with a text.

    Another session opens it by the same path and number of buckets; one writer at a time. Without
    a path a new one is taken in the shared folder.

    `ingest` may be repeated after a failure: what a lost run has appended is
    found by the anti-join. Ids are those of the batch that came first, within a
    batch the smallest; a null id gives way to any other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        # The files are the index; the table only names them in this session's catalog.
        spark.sql(f"""CREATE TABLE {self.table} (digest STRING, doc_id BIGINT) USING parquet
            CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}'""")

    def _append(self, rows: DataFrame) -> None:
        # By the number of the bucket: each lies in one task, and so in one file, whatever the number of tasks.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        with shuffles_freed(self.spark):
            rows.select("digest", "doc_id").repartition(self.buckets, bucket).write.insertInto(self.table)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, rows: DataFrame) -> None:
        """Add the texts of `digest_rows` that the index doesn't know."""
        firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        self._append(firsts.hint("merge").join(self.entries().select("digest"), "digest", "left_anti"))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """A row per ingested row: `doc_id`, `keep_id`, `group_size`, `kept`, `digest`.

        Sizes count the given rows. Singles need no join; the others meet a table
        of one row per digest, so the optimiser can split a hot digest. Of equal
        rows with one id exactly one is kept.
        """
        sizes = rows.groupBy("digest").agg(F.sum("copies").alias("n"), F.min("doc_id").alias("low"))
        entries = self.entries().withColumnRenamed("doc_id", "keep")
        groups = stage(sizes.hint("merge").join(entries, "digest").where("n > 1 OR NOT keep <=> low")
                       .select("digest", "n", "keep"), "groups")
        out = rows.join(groups, "digest", "left").withColumn("known", F.col("n").isNotNull())
        out = out.select("doc_id", "digest", "known", "keep", F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        keep = F.when(F.col("known"), F.col("keep")).otherwise(F.col("doc_id"))
        return out.select("doc_id", keep.alias("keep_id"), "group_size",
                          (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"), "digest")


def dedupe(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that are first with their text, all columns kept.

    Null text counts as empty, and empty texts are equal. Of rows that share id
    and text one stays. An empty table stays empty.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs)
    index = index or DigestIndex(spark)
    index.ingest(rows)
    verdicts = index.resolve(rows)
    # Ids may recur with different texts, so a decision belongs to id and text.
    lost = stage(_lost(verdicts), "dropped")
    out = docs.withColumn("__digest", text_digest(F.col("text")))
    out = out.join(lost, out["doc_id"].eqNullSafe(lost["__id"]) & (out["__digest"] == lost["__lost"]), "left_anti")
    if rows.where("copies > 1").isEmpty():
        return out.select(docs.columns)
    order = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    again = Window.partitionBy("doc_id", "__digest").orderBy(*order)
    return out.withColumn("__copy", F.row_number().over(again)).where("__copy = 1").select(docs.columns)


def _lost(verdicts: DataFrame) -> DataFrame:
    """Pairs of id and digest none of whose rows is kept."""
    return (verdicts.groupBy("doc_id", "digest").agg(F.max("kept").alias("any"))
            .where("NOT any").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__lost")))
