"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a schedule, a rate that moves linearly from ``start`` to ``end`` times
its mean; integrated and scaled to the source's target, it gives the cumulative words demanded of the source by any
time. A source's documents, in an order fixed by a hash of their ids, repeat as epochs; a copy whose first half of
words ends within the target is taken, at the time when the demand, inverted, reaches the copy's start. Copies of all
sources, sorted by that position, are the training order.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
``MOST_EPOCHS`` times its source's words, and the excess is shared again by weight until none is above.

Scale: a source's running word count comes from two levels, so no task holds a source: a source is cut, by hash, into
bins of about ``BIN`` rows, words are summed by bin, bins are accumulated, and rows only within their bin. Everything
is in built-in functions, and texts are read once, for their word counts; only ``ordered`` moves whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import stored, unused

BIN = 4000
MOST_EPOCHS = 3
#: Rate at time 0 and 1 as multiples of the mean, by weight: light sources early, heavy ones late.
SCHEDULES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Closed form of the repeated sharing: in the order of their cap by weight, sources are capped while the rest,
    shared over the weights not yet capped, would pass their cap. One row a source: one task takes them all, and spills where they
    are very many.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    cap = F.lit(MOST_EPOCHS) * F.col("source_size")
    df = sources.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))
    rising = everything.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    df = df.withColumn("_weights", F.sum("weight").over(after))
    df = df.withColumn("_capped", (cap * F.col("_weights") <= F.col("_rest") * F.col("weight")) & (F.col("_rest") > 0))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("_capped"), cap)).over(everything), F.lit(0))
    df = df.withColumn("_left", rest).withColumn("_open", F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(everything))
    share = (F.col("_left") * F.col("weight")).cast("double") / F.col("_open").cast("double")
    return df.select("source", "source_size", "weight", F.when(F.col("_capped"), cap.cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def _time(demand: Column, weight: Column) -> Column:
    """The time at which a share ``demand`` of a source's target has been asked for."""
    out = F.lit(None).cast("double")
    for k, (a, b) in SCHEDULES.items():
        # integral of a + (b - a) t is a t + (b - a) t^2 / 2, and 1 at t = 1
        solved = demand / F.lit(a) if a == b else (F.sqrt(F.lit(a * a) + F.lit(2 * (b - a)) * demand) - F.lit(a)) / F.lit(b - a)
        out = F.when(weight == k, solved).otherwise(out)
    return out


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, epochs, taken, positions), a row for each row of ``docs``.

    ``positions`` holds the training time of each copy taken, ascending. Null texts and texts without words have size
    0 and are never taken. Null sources are one source, the last. Rows that repeat a key are rows of their own; equal
    rows are interchangeable. Reruns agree, on any partitioning. An empty table gives no rows.
    """
    order = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"), order.alias("order"))
    rows = stored(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    mix = targets(found.drop("_rows")).join(found.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    mix = stored(mix.withColumn("_bins", F.greatest(F.lit(1), F.ceil(F.col("_rows") / BIN))).withColumnRenamed("source", "_s"), "mix")
    rank = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    rows = rows.join(mix, F.col("source").eqNullSafe(F.col("_s"))).withColumn("bin", (rank * F.col("_bins") / F.lit(2**32)).cast("long"))
    sums = rows.groupBy("_s", "bin").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_s").alias("_t"), F.col("bin").alias("_bin"), F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_base"))
    rows = rows.join(sums, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("bin") == F.col("_bin")))
    within = Window.partitionBy("_s", "bin").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # copy e starts at e * source_size + _start and is taken while start + size / 2 <= target
    copies = F.floor((F.col("target") - F.col("_start") - F.col("size") / 2) / F.col("source_size")) + 1
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(copies, F.lit(MOST_EPOCHS)))).otherwise(0).cast("int")
    rows = rows.withColumn("epochs", copies)
    starts = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    at = F.transform(starts, lambda e: _time((e * F.col("source_size") + F.col("_start")) / F.col("target"), F.col("weight")))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), at.alias("positions"))


def ordered(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The training set: rows of ``docs`` with all their columns, once for each copy taken, range-sorted by position.

    Keys that repeat are told apart by size and source; rows equal in all three are interchangeable, so each is given
    the positions of one of them. Null keys and sources are values like others; null and wordless texts are never taken;
    an empty table gives no rows. Columns of any names pass through. Written, the order is that of the files' names and
    of the rows in them (``_metadata.file_name``, ``_metadata.row_index``); readers may take files in another one.
    """
    k, s, z, all_, rows_, row, at = unused(docs, "key", "source", "size", "all", "rows", "row", "at")
    id_, size_, source_ = F.col(f"`{key}`"), words(F.col(f"`{text}`")), F.col(f"`{source}`")
    places = assign(docs, text, key, source)
    # of rows alike in key, source and size, each takes the positions of one; their number comes with them
    lots = places.groupBy(F.col(f"`{key}`").alias(k), F.col(f"`{source}`").alias(s), F.col("size").alias(z)).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias(all_), F.count(F.lit(1)).alias(rows_))
    lots = stored(lots.where(F.size(all_) > 0), "lots")
    met = lambda some: docs.join(some, id_.eqNullSafe(F.col(k)) & source_.eqNullSafe(F.col(s)) & (size_ == F.col(z)))
    out = met(lots.where(F.col(rows_) == 1)).withColumn(row, F.lit(1))
    if lots.where(F.col(rows_) > 1).limit(1).count():
        nth = Window.partitionBy(k, s, z).orderBy(F.xxhash64(F.col(f"`{text}`")))
        out = out.unionByName(met(lots.where(F.col(rows_) > 1)).withColumn(row, F.row_number().over(nth)))
    mine = F.filter(F.col(all_), lambda x, i: (i % F.col(rows_) + 1) == F.col(row))
    out = out.withColumn(at, F.explode(mine))
    return out.repartitionByRange(F.col(at), id_).sortWithinPartitions(at, id_).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s
), c AS (
  SELECT source, source_size, weight, 3 * source_size * weights <= rest * weight AND rest > 0 AS capped FROM r
), m AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) * weight AS DOUBLE) / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM c
), o AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN greatest(0, least(3, floor((target - start - size / 2.0) / source_size) + 1)) * size ELSE 0 END AS BIGINT) AS taken FROM o
"""
