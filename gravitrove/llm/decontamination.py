"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, PLAIN_BREAK, free_name, materialise, measured_bytes, plain_names, table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(column: str) -> Column:
    """Words after lower-casing A-Z: runs of a-z, 0-9 and non-ASCII characters; null has none."""
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), CAPITALS, SMALL)
    return F.array_remove(F.split(lowered, PLAIN_BREAK), "")


def half(size: int | Column) -> int | Column:
    """Words of the half-windows by which windows of `size` words are looked up."""
    return F.floor((size + 1) / 2).cast("int") if isinstance(size, Column) else (size + 1) // 2


def gram(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def item_grams(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Rows (item, size, start, gram, code): the windows of each item, and the hashes of its half-windows.

    An item of fewer than `size` words is one window of its own length. gram is null where only a half-window
    starts. An item without an id counts as the empty text.
    """
    worded = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), plain_words(text_col).alias("words"))
    worded = worded.where(F.size("words") > 0).withColumn("size", F.least(F.lit(size), F.size("words")))
    starts = worded.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - half(F.col("size")) + 1)).alias("start"))
    whole = F.when(F.col("start") + F.col("size") <= F.size("words") + 1, gram(F.col("start"), F.col("size")))
    return starts.select("item", "size", "start", whole.alias("gram"), F.xxhash64(F.slice("words", F.col("start"), half(F.col("size")))).alias("code"))


def probes(size: int) -> Column:
    """Structs (at, size, code) of half-windows, so far apart that each window of `size` words holds exactly one."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - half(size) + 1), F.lit(size - half(size) + 1))
    each = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice("words", i, half(size))).alias("code")))
    return F.when(F.size("words") >= size, each).otherwise(F.array().cast("array<struct<at:int,size:int,code:bigint>>"))


def hits(docs: DataFrame, items: DataFrame, text_col: str, kept: list[Column]) -> DataFrame:
    """Rows (*kept, row, n_words, start, size, gram): one of start 0 for each row of docs, and one for each verified window.

    Only hashes of half-windows are exploded and looked up in the broadcast set of the items' ones. Around those
    found, the whole windows are looked up by their text, which verifies them. A set of more than BROADCAST_BYTES is
    dealt into parts by hash, each sent on its own pass over docs, so that no text and no miss is ever shuffled.
    """
    halves = materialise(items.select(F.col("size").alias("_size"), F.col("code").alias("_code")).distinct())
    grams = materialise(items.where("gram is not null").select(F.col("size").alias("_size"), F.col("gram").alias("_gram")).distinct())
    lengths = sorted(r[0] for r in grams.select("_size").distinct().collect())  # at most `size` numbers
    base = docs.select(*kept, F.monotonically_increasing_id().alias("row"), plain_words(text_col).alias("words"))
    names = base.columns[:-1]
    mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("code")))
    parts = 1 + measured_bytes(halves) // BROADCAST_BYTES
    known = F.broadcast(grams) if measured_bytes(grams, "_gram") <= BROADCAST_BYTES else grams

    def looked(part: int) -> DataFrame:
        held = F.broadcast(halves.where(F.pmod("_code", F.lit(parts)) == part))
        every = F.concat(mark, *map(probes, lengths)) if not part else F.concat(*map(probes, lengths))
        each = base.select(*names, "words", F.explode(every).alias("w")).select(*names, "words", "w.*")
        found = each.join(held, (F.col("code") == F.col("_code")) & (F.col("size") == F.col("_size")), "left").where("at = 0 or _code is not null")
        first = F.greatest(F.lit(1), F.col("at") + half(F.col("size")) - F.col("size"))
        around = F.when(F.col("at") > 0, F.sequence(first, F.least(F.col("at"), F.size("words") - F.col("size") + 1))).otherwise(F.array(F.lit(0)))
        found = found.select(*names, "words", "size", F.explode(around).alias("start"))
        found = found.select(*names, F.when(F.col("start") == 0, F.size("words")).cast("long").alias("n_words"), "start", "size", F.when(F.col("start") > 0, gram(F.col("start"), F.col("size"))).alias("gram"))
        verified = found.join(known, (F.col("gram") == F.col("_gram")) & (F.col("size") == F.col("_size")), "left")
        return verified.where("start = 0 or _gram is not null").drop("_gram", "_size")

    return reduce(DataFrame.unionByName, [looked(part) for part in range(parts)])


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, spans, items): the words of each document inside an occurrence of a benchmark window.

    Windows of `size` words are looked up in the benchmark's, and for items shorter than that, windows of
    their lengths too (see hits). spans: starts and ends of the merged hits,
    in words from 0; items: the ids of the items hit, as sorted strings. Null and empty texts have no words;
    an item without text matches nothing, one without an id is named by the empty string; each row of docs
    gives one row, repeated ones too; an empty benchmark gives no hits; other columns are not read, so
    their names don't matter.
    """
    items = materialise(item_grams(benchmark, size, item_col, item_text_col))
    found = materialise(hits(docs, items, text_col, [F.col(id_col).alias("doc_id")]))
    span = F.when(F.col("start") > 0, F.struct((F.col("start") - 1).cast("long").alias("start"), (F.col("start") - 1 + F.col("size")).cast("long").alias("end")))
    grouped = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("hits"))
    named = found.where("start > 0").select("row", "gram").distinct().join(items.select("gram", "item").distinct(), "gram")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    grouped = grouped.join(named, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    empty = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"))

    def extend(a: Column, x: Column) -> Column:
        apart = x["start"] > a["end"]
        open_ = F.struct(a["start"].alias("start"), a["end"].alias("end"))
        return F.struct(F.when(apart, x["start"]).otherwise(a["start"]).alias("start"), F.greatest(a["end"], x["end"]).alias("end"), F.when(apart & (a["end"] > a["start"]), F.concat(a["done"], F.array(open_))).otherwise(a["done"]).alias("done"))

    def close(a: Column) -> Column:
        return F.when(a["end"] > a["start"], F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["done"])

    merged = grouped.withColumn("spans", F.aggregate("hits", empty, extend, close))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


@plain_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without any benchmark window; all columns stay.

    The verdict depends on the row's text alone, not on its id: of rows that share an id, or have none, the clean
    ones stay. Rows with equal texts share their verdict, and repeated rows stay repeated. Null and empty texts are
    clean. Only distinct texts that are hit leave the first pass, as their hash and themselves.
    """
    items = materialise(item_grams(benchmark, size, item_col, item_text_col))
    hit, key = free_name(docs, "hit_text"), free_name(docs, "hit_key")
    found = hits(docs, items, text_col, [F.col(text_col).alias("text")]).where("start > 0")
    found = materialise(found.groupBy(F.xxhash64("text").alias(key), F.col("text").alias(hit)).agg(F.count("*").alias("n")).drop("n"))
    return docs.join(found, (F.xxhash64(text_col) == F.col(key)) & (F.col(text_col) == F.col(hit)), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS gram FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, p.n, i, item FROM p JOIN g ON g.gram = p.gram AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
