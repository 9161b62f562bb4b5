"""Exact duplicates by a persistent digest index (DataFrame operators only).

The index is a folder of Parquet files, bucketed and sorted by the SHA-256
digest of the normalised text, with a partition for each batch.  New rows are
grouped by digest with map-side partial aggregation, a sort-merge anti-join
against the index (whose side needs no exchange) finds the digests that are
new, and those are appended as the batch's partition.  A group of copies of
any size is one row for each map task before the shuffle; in the join that
returns a decision for every row it is dealt over SALTS parts.

The folder is all there is to the index: any later session opens it by its
path.  A batch that is run again does not see its own former rows and replaces
its own partition, so a job that failed after the append decides the same when
it is repeated.

Defined cases: a null text counts as empty and empty texts are copies of each
other; null ids come last, so one is kept only if the whole group has none; of
rows that repeat both the text and its smallest doc_id one stays; an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, fresh_path, materialize

BUCKETS = 64
#: Parts over which the rows of a text that comes more than once are dealt.
SALTS = 32
_COLUMNS = "digest binary, keep_id bigint, batch string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Rows (digest, keep_id, batch) in a folder; ``buckets`` belongs to the folder and must be the same in all sessions."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        # The session's name for the folder; dropping it leaves the files alone.
        self.name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        self._open()

    def _open(self) -> None:
        spark = self.spark
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        place = self.folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def close(self) -> None:
        """Forget the session's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Write a batch's digests, one sorted file for each bucket, in place of what it wrote before."""
        view = f"{self.name}_new"
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{name}') SELECT digest, keep_id FROM {view}")
        rows.sparkSession.catalog.dropTempView(view)

    def decide(self, rows: DataFrame, batch: str) -> DataFrame:
        """Add the new digests of written rows (doc_id, digest, row); row is a number of the row's own.

        Returns, written, a row for each digest: digest, keep_id, group_size (the batch's rows with the text), keep_row
        (the row that stays; null where the text came in another batch, whose keep_id it then has), first_row.
        """
        least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
        groups = rows.groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("group_size"))
        groups = materialize(groups.select("digest", "group_size", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")), "groups")
        known = self.read().where(F.col("batch") != F.lit(batch)).select("digest", "keep_id").hint("merge")
        new = groups.join(known, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), "group_size", F.col("first_row").alias("keep_row"), "first_row")
        old = groups.join(known, "digest").select("digest", "keep_id", "group_size", F.lit(None).cast("long").alias("keep_row"), "first_row")
        decided = materialize(new.unionByName(old), "decided")
        self.append(decided.where("keep_row is not null"), batch)
        return decided

    def deduplicate(self, docs: DataFrame, batch: str, id_col="doc_id", text_col="text") -> DataFrame:
        """Decide on a batch and add its new digests.  Returns doc_id, keep_id, group_size, kept, digest, row."""
        rows = numbered(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")))
        return decisions(rows, self.decide(rows, batch))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, written, with a number of their own (``row``)."""
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def decisions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups' decisions for each row.  A text that comes once is needed in its row's part alone, others in all parts."""
    parts = F.when(F.col("group_size") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("first_row"), F.lit(SALTS)).cast("int")))
    groups = groups.withColumn("part", F.explode(parts))
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "part"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "row")


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Decisions on a whole table, in two batches through an index of its own.  Returns doc_id, keep_id, group_size, kept, digest, row.

    The first batch holds the lower half of the range of ids, the second the
    upper half and null ids, so what is kept first is what has the smallest id.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    lower = F.coalesce(F.col("doc_id") <= F.lit(low + (high - low) // 2 if low is not None else 0), F.lit(False))
    index = DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    groups = index.decide(rows.where(lower), "lower").unionByName(index.decide(rows.where(~lower), "upper"))
    index.close()
    # A text of both batches has two rows here, with one keep_id; only that of the first names the row that stays.
    groups = groups.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("keep_row").alias("keep_row"), F.max("first_row").alias("first_row"))
    return decisions(rows, groups)


def drop_exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows that stay, with all their columns."""
    held = F.struct("*")  # whatever the columns are called
    rows = numbered(docs.select(held.alias("held"), F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")))
    index = DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    groups = index.decide(rows.select("doc_id", "digest", "row"), "all")
    index.close()
    stays = groups.where("keep_row is not null").select(F.col("keep_row").alias("row"))
    # Always a sort-merge join: what stays grows with the input, and must not be broadcast while it is small.
    return rows.join(stays.hint("merge"), "row", "left_semi").select("held.*")


def exact_dedup_query(spark, sf_dir) -> DataFrame:
    from .shared import table

    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
