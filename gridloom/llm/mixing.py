"""Mixing sources to target weights by nested hash-threshold histograms (DataFrame operators only).

Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is found by a running sum over at most 4096 buckets, only that
bucket is split again by the next hash bits, and at the end documents are
filtered by comparing their hash with the source's threshold.  No sort over
documents takes place.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; rows of one source that repeat a doc_id share its hash and so
one decision; the windows over sources hold one row for each source;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize

HASH_BITS, LEVEL_BITS = 36, (12, 12, 12)
#: Rows of a source meet their source's row in this many parts, so a hot source is no single task.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_key(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id's decimal text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: its size and target, from (source, size).

    A target is weight * level, or max_epochs times the size where that is
    less.  Ordered by size / weight, the capped sources come first, so the
    level is what remains after the caps of a prefix, shared by the weights
    that are left, at the first source that this level does not fill.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not documents
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    by_source = by_source.withColumn("weight", w)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    by_source = by_source.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left_size"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"),
    )
    holds = F.col("weight") * F.col("left_size") <= cap * F.col("left_weight")
    best = F.min(F.when(holds, F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", "left_size", "left_weight"))).over(everything)
    level = by_source.withColumn("level", best)
    share = (F.col("weight") * F.col("level.left_size")).cast("double") / F.col("level.left_weight").cast("double")
    return level.select("source", "source_size", F.coalesce(F.least(cap.cast("double"), share), cap.cast("double")).alias("target"))


def _boundary(hist: DataFrame, budget: str, path: list[str], at: str) -> DataFrame:
    """The bucket of each source in which its budget ends, and what is left of the budget there."""
    over = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("run", F.sum("size").over(over))
    return (
        run.where(F.col("run") > F.col(budget))
        .groupBy("source", *path)
        .agg(F.min(F.struct(at, (F.col(budget) - (F.col("run") - F.col("size"))).alias("rest"), "size")).alias("b"))
        .select("source", *path, F.col(f"b.{at}").alias(at), F.col("b.rest").alias("rest"), F.col("b.size").alias("last_size"))
    )


def _salted(per_source: DataFrame) -> DataFrame:
    return per_source.withColumn("source_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def thresholds(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, copies, threshold): ``copies`` of every document, one more where its key is below ``threshold``."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # A source whose rest is nothing has no boundary: not even a document of no size comes once more.
    bound, path, shift = plan.where("rest > 0").select("source", "rest"), [], HASH_BITS
    for level, bits in enumerate(LEVEL_BITS):
        shift -= bits
        name = f"b{level}"
        rows = keyed.select(F.col("source").alias("s"), "size", *[F.expr(f"(key >> {HASH_BITS - 12 * (i + 1)}) & 4095").alias(f"k{i}") for i in range(level)], F.expr(f"(key >> {shift}) & 4095").alias(name))
        bound = bound.withColumnRenamed("rest", "budget")
        if level:  # whole rows, not sums: salted
            rows, bound = rows.withColumn("salt", F.pmod("size", F.lit(SALTS)).cast("int")), _salted(bound)
        on = rows["s"].eqNullSafe(bound["source"])
        if level:
            on = on & (rows["salt"] == bound["source_salt"])
        for i in range(level):
            on = on & (rows[f"k{i}"] == bound[f"b{i}"])
        # Sum before joining: at most 4096 rows of a source pass each shuffle for each map task.
        hist = rows.groupBy("s", *[f"k{i}" for i in range(level)], name).agg(F.sum("size").alias("size")) if level == 0 else rows
        hist = hist.join(bound, on).groupBy("source", "budget", *path, name).agg(F.sum("size").alias("size"))
        bound = _boundary(hist, "budget", path, name)
        path.append(name)
    key = F.lit(0).cast("long")
    for i in range(len(LEVEL_BITS)):
        key = key * 4096 + F.col(f"b{i}")
    # The last bucket holds one key: it is taken where that comes nearer to the target.
    edge = bound.select(F.col("source").alias("edge_source"), (key + F.when(F.col("last_size") - F.col("rest") < F.col("rest"), 1).otherwise(0)).alias("threshold"), F.lit(True).alias("found"))
    return plan.join(edge, plan["source"].eqNullSafe(edge["edge_source"]), "left").select(
        "source", "source_size", "target", "copies",
        # no bucket exceeds the budget: a budget of nothing takes none, any other takes all
        F.when(F.col("found"), F.col("threshold")).when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).alias("threshold"),
    )


def _plan(keyed: DataFrame, weights, max_epochs: int) -> DataFrame:
    plan = thresholds(keyed, source_targets(keyed, weights, max_epochs))
    return _salted(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "copies", "threshold"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (key, source, ...) with their source's plan and ``times``, how often the mix takes them."""
    rows = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"]) & (rows["salt"] == plan["source_salt"]))
    return rows.withColumn("times", F.col("copies") + (F.col("key") < F.col("threshold")).cast("long"))


def _keyed(docs: DataFrame, id_col, text_col, source_col) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_key(F.col(id_col)).alias("key")), "sizes")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), max_epochs=3) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times (how often the mix takes it)."""
    keyed = _keyed(docs, id_col, text_col, source_col)
    return _taken(keyed, _plan(keyed, weights, max_epochs)).select("doc_id", "source", "size", "source_size", "target", "times")


def mixed_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), max_epochs=3) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it.  Every row is decided by itself, whatever ids repeat."""
    plan = _plan(_keyed(docs, id_col, text_col, source_col), weights, max_epochs)
    rows = docs.select(F.struct("*").alias("held"), F.col(source_col).alias("source"), hash_key(F.col(id_col)).alias("key"))
    return _taken(rows, plan).where("times > 0").select("held", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("held.*")


def mixing_query(spark, sf_dir) -> DataFrame:
    from .shared import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM s0),
s2 AS (SELECT *, (SELECT sum(source_size) FROM s0) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lsz,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM s1),
lev AS (SELECT lsz, lw FROM s2 WHERE w * lsz <= 3 * source_size * lw ORDER BY source_size / w, source NULLS LAST LIMIT 1),
s3 AS (SELECT s2.source, s2.source_size, s2.w, least((3 * s2.source_size)::DOUBLE, (s2.w * lev.lsz)::BIGINT::DOUBLE / lev.lw::BIGINT::DOUBLE) AS target FROM s2, lev),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM s3),
s5 AS (SELECT *, target - copies * source_size AS rest FROM s4),
g AS (SELECT source, k, sum(size) AS sz FROM d GROUP BY source, k),
r AS (SELECT *, sum(sz) OVER (PARTITION BY source ORDER BY k) AS run FROM g),
x AS (SELECT r.source, r.k, CASE WHEN run <= rest THEN 1 WHEN run - sz > rest THEN 0 WHEN run - sz <= rest AND run > rest AND sz - (rest - (run - sz)) < rest - (run - sz)
        AND NOT EXISTS (SELECT 1 FROM r q WHERE q.source IS NOT DISTINCT FROM r.source AND q.k < r.k AND q.run > s5.rest) THEN 1 ELSE 0 END AS extra, copies, target, source_size, rest
      FROM r JOIN s5 ON r.source IS NOT DISTINCT FROM s5.source)
SELECT d.doc_id, d.size, x.source_size, x.target, (d.size * (x.copies + CASE WHEN x.rest > 0 THEN x.extra ELSE 0 END))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.k = x.k
"""
