"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Every document gets a 60-bit hash of its id. Sizes are summed by source and hash bucket; running sums
over the buckets of a source find where a budget ends. Only the boundary bucket is split by the next
hash bits, until a boundary bucket holds one document. The thresholds of the first and second
repetition are nested (the second is never above the first), so a filter on the hash takes the
documents: nothing is sorted and no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, free_name, materialise, measured_bytes, plain_names, table, without

#: Bits of the hash, and of one level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 12


def id_hash(column: str) -> Column:
    """60 bits of the md5 of the id's decimal text; null counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Adds target to rows (source, source_size, weight), one row a source.

    The targets share `share` times all sizes by weight and stop at `repeats` times the source's size;
    what is above goes to the others. In order of limit / weight the limited sources come first, so one
    pass finds the level that the rest reach. The window holds one row a source, not one a document.
    """
    limit = F.lit(repeats) * F.col("source_size")
    order = W.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    stepped = sources.select(
        "*",
        F.row_number().over(order).alias("step"),
        ((F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)).alias("level"),
    )
    open_step = F.when(limit > F.col("level") * F.col("weight"), F.struct("step", "level"))
    return (
        stepped.withColumn("rest", F.min(open_step).over(whole)["level"])
        .withColumn("target", F.when(F.col("rest").isNull(), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("rest") * F.col("weight"))))
        .drop("step", "level", "rest")
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join by null-safe keys; right is sent to all executors only if its measured size is small."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(F.broadcast(renamed) if few else renamed, on).drop(*[f"_{k}" for k in keys])


def hash_thresholds(sized: DataFrame, targets: DataFrame, repeats: int, few: bool) -> DataFrame:
    """Rows (source, copy, threshold): copy k of a document is taken if its hash is below the threshold.

    sized: (source, size, hash). The budget of copy k is what the target leaves above k - 1 whole
    sources. At the last level the boundary bucket is one hash value; it is taken if that comes nearer.
    """
    copies = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    budget = F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - (F.col("copy") - 1) * F.col("source_size")))
    wanted = targets.select("*", copies.alias("copy")).select("source", "copy", budget.alias("budget"), "source_size")
    whole = F.col("budget") >= F.col("source_size")
    done = [wanted.where(whole).select("source", "copy", F.lit(1 << HASH_BITS).alias("threshold"))]
    edge = wanted.where(~whole).select("source", "copy", "budget", F.lit(0).cast("long").alias("prefix"))
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", low)
        inside = sized if low + LEVEL_BITS == HASH_BITS else _joined(sized.withColumn("prefix", F.shiftright("hash", low + LEVEL_BITS)), edge.select("source", "prefix").distinct(), ["source", "prefix"], few)
        summed = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        running = W.partitionBy("source", F.shiftright("bucket", LEVEL_BITS)).orderBy("bucket")
        summed = summed.where("held > 0").withColumn("prefix", F.shiftright("bucket", LEVEL_BITS)).withColumn("until", F.sum("held").over(running))
        found = materialise(_joined(summed, edge, ["source", "prefix"], few).where((F.col("until") - F.col("held") <= F.col("budget")) & (F.col("budget") < F.col("until"))))
        rest = F.col("budget") - (F.col("until") - F.col("held"))
        alone = F.col("first") == F.col("last")
        done.append(found.where(alone).select("source", "copy", F.when(rest >= F.col("held") / 2, F.col("first") + 1).otherwise(F.col("first")).alias("threshold")))
        edge = found.where(~alone).select("source", "copy", rest.alias("budget"), F.col("bucket").alias("prefix"))
        if edge.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


@plain_names
def mix(docs: DataFrame, weights, *, share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target, copies (how often the mix takes the row) and taken.

    weights: function that adds a column weight (above 0) to rows (source, source_size). Targets share
    `share` times the words of docs; no document is taken more than `repeats` times. Null texts have
    size 0; a null source is a source; rows of the same id have the same hash and move together;
    an empty table gives an empty result; documents without words get copies but no words.
    Columns of docs that bear the names of added ones are replaced; any other name is allowed.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.select(*without(docs, [c for c in added if c not in (id_col, text_col, source_col)]))
    sized = materialise(docs.select(F.col(source_col).alias("source"), id_hash(id_col).alias("hash"), word_count(text_col).alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(water_level(weights(sizes), share, repeats))
    few = repeats * measured_bytes(targets, "source") <= BROADCAST_BYTES
    thresholds = hash_thresholds(sized, targets, repeats, few).groupBy("source").agg(F.sort_array(F.collect_list("threshold")).alias("thresholds"))
    source, limits, hashed = (free_name(docs, x) for x in ("mix_source", "mix_thresholds", "mix_hash"))
    found = _left(targets, thresholds).select(F.col("source").alias(source), "source_size", "target", F.col("thresholds").alias(limits))
    copies = F.aggregate(limits, F.lit(0), lambda n, t: n + (F.col(hashed) < t).cast("int"))
    return (
        docs.withColumns({hashed: id_hash(id_col), "size": word_count(text_col)})
        .join(F.broadcast(found) if few else found, F.col(source_col).eqNullSafe(F.col(source)))
        .withColumn("copies", F.coalesce(copies, F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(hashed, source, limits)
    )


def _left(targets: DataFrame, thresholds: DataFrame) -> DataFrame:
    other = thresholds.withColumnRenamed("source", "_other")
    return targets.join(other, F.col("source").eqNullSafe(F.col("_other")), "left").drop("_other")


def ranked_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by the source's rank: code point order, null last, the cycle repeated."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in cycle]), (rank % len(cycle) + 1).cast("int")))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ranked_weights).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS step,
             (1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / CAST(sum(weight) OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST)),
r AS (SELECT min_by(level, step) AS rest FROM l WHERE 2 * source_size > level * weight),
t AS (SELECT source, source_size, CASE WHEN rest IS NULL THEN 2e0 * source_size ELSE least(2e0 * source_size, rest * weight) END AS target FROM l CROSS JOIN r),
c AS (SELECT d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS until,
             CAST(sum(size) OVER (PARTITION BY d.source, h) AS DOUBLE) AS held
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, greatest(0e0, least(CAST(source_size AS DOUBLE), target)) AS b1, greatest(0e0, least(CAST(source_size AS DOUBLE), target - source_size)) AS b2 FROM c)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN until <= b1 OR (until - held <= b1 AND b1 - (until - held) >= held / 2e0) THEN 1 ELSE 0 END
                  + CASE WHEN until <= b2 OR (until - held <= b2 AND b2 - (until - held) >= held / 2e0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM b
"""
