"""Prefix trie of conversations: node keys by doubling, sums over subtrees along heavy paths."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, materialise, table

#: Fixed values of the rebuilt conversations: how many in a row share their first one's beginning, and the bound of its turns.
FAMILY, MOST_SHARED = 5, 9
#: Nodes of a path whose suffix sums one task forms; sums of such blocks are then summed along the path.
PATH_BLOCK = 4096
#: Ids joined into one chunk on the way to a node's digest of ids.
CHUNK_IDS = 1 << 16
#: The key of the root.
ROOT = b""


def _hash(*parts):
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, digest, n_bytes): the turns of each conversation from 0, in the order of turn (null first).

    digest is SHA-256 of role and text, null being empty, and stands for both from here on. Turns of the same number
    are ordered by digest. Rows without conv_id belong to no conversation. Rows are dealt by ranges of conversation
    and turn, so a conversation of any length, even of repeated rows, is cut over many tasks; each numbers its part, and
    the parts before it, a row a task, are added.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    order = (F.col("turn").asc_nulls_first(), "digest", "row")
    placed = materialise(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    before = parts.select("conv_id", "part", F.coalesce(F.sum("held").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return placed.withColumn("own", own).join(before, ["conv_id", "part"]).select("conv_id", (F.col("own") + F.col("before")).alias("place"), "digest", "n_bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that share the beginning of their family's first one: rows (conv_id, depth, digest, n_bytes), and (conv_id, length).

    Conversation c gets the first h turns of c - c % family, h = crc32(c) % most, then its own turns after its first h.
    """
    conv, first = F.col("conv_id"), F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    h = (F.crc32(conv.cast("string").cast("binary")) % most).alias("h")
    lengths = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = lengths.select("conv_id", "n", first.alias("first"), h).join(lengths.where(conv == first).select(conv.alias("first"), F.col("n").alias("first_n")), "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    heads = turns.where((conv == first) & (F.col("place") < most)).withColumnRenamed("conv_id", "first")
    shared = convs.select("conv_id", "first", "h").join(heads, "first").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_bytes")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "n_bytes")
    return shared.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefix_keys(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds key: a SHA-256 that two turns share only if all turns up to them are equal.

    By doubling: a key of the last 2^k turns and that of the 2^k before them make one of 2^(k+1). Each round is a join on
    (conv_id, depth), one row to one; conversations that are covered drop out.
    """
    rows, longest, step, done = turns.join(lengths, "conv_id").withColumnRenamed("digest", "key"), lengths.agg(F.max("length")).first()[0] or 0, 1, []
    rows = materialise(rows)
    while step < longest:
        done.append(rows.where(F.col("length") <= step))
        rows = rows.where(F.col("length") > step)
        before = rows.select("conv_id", (F.col("depth") + step).alias("depth"), F.col("key").alias("left_key"))
        key = F.when(F.col("left_key").isNull(), F.col("key")).otherwise(_hash("left_key", "key"))
        rows = materialise(rows.join(before, ["conv_id", "depth"], "left").withColumn("key", key).drop("left_key"))
        step *= 2
    return reduce(DataFrame.unionByName, [*done, rows])


def _nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (key, parent, depth, conv_id, n_convs, saved, n_children, heavy), the root included."""
    found = rows.groupBy("key").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
    found = found.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    found = materialise(found.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes"))
    below = found.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n_convs", -F.col("conv_id"))).alias("largest"))
    counts, largest = below.select(F.col("parent").alias("key"), "n_children"), below.select(F.col("largest").alias("key"), F.lit(True).alias("heavy"))
    return materialise(found.join(counts, "key", "left").join(largest, "key", "left").fillna(0, ["n_children"]).fillna(False, ["heavy"]))


def _paths(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with path, and rows (path, level, parent, parent_path).

    A heavy path ends at a leaf and is named by the leaf's smallest member, whose own prefixes hold it: it starts at the
    deepest of them that is no largest child. level counts the light edges above, so it is at most the logarithm of the
    number of conversations: a light child has at most half of its parent's members.
    """
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    chains = rows.select(F.col("conv_id").alias("path"), "depth", "key").join(leaves, "path")
    light = chains.join(nodes.where("depth > 0 and not heavy").select("key"), "key")
    heads = leaves.join(light.groupBy("path").agg(F.max("depth").alias("head"), F.count("*").alias("level")), "path", "left").fillna(0, ["head", "level"])
    whole = chains.unionByName(leaves.select("path", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key")))
    member = whole.join(heads, "path").where("depth >= head").select("key", "path", "head", "level")
    placed = materialise(nodes.join(member, "key"))
    tops = placed.where("depth = head").select("path", "level", "parent")
    return placed, tops.join(placed.select(F.col("key").alias("parent"), F.col("path").alias("parent_path")), "parent", "left")


def prefix_trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (key, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens): the nodes of the trie.

    rows: those of prefix_keys; lengths: (conv_id, length) of every conversation, turnless ones too.
    A node is a distinct beginning; its members are the conversations that start with it, conv_id the smallest; the
    root has key x''. n_leaves and saved_tokens (bytes of the last turn for each member but one) are sums over subtrees:
    totals of light paths are attached to their parents level by level, then summed from the leaf up each path. Sums
    are combined before the shuffle and paths cut into blocks of PATH_BLOCK nodes, so no node, path or conversation has
    to fit a task. No conversations, no nodes.
    """
    placed, tops = _paths(_nodes(rows, lengths), rows)
    sums = {"saved": F.sum("saved"), "leaf": F.sum("leaf")}
    summed = [f.alias(c) for c, f in sums.items()]
    placed = placed.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    open_ = materialise(tops.join(placed.groupBy("path").agg(*summed), "path"))
    level, totals = open_.agg(F.max("level")).first()[0] or 0, []
    while level > 0:
        here = open_.where(F.col("level") == level)
        if totals:
            more = totals[-1].groupBy(F.col("parent_path").alias("path")).agg(*[f.alias(f"more_{c}") for c, f in sums.items()])
            here = here.join(more, "path", "left").fillna(0, ["more_saved", "more_leaf"]).select(*[c for c in here.columns if c not in sums], *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums])
        totals.append(materialise(here))
        level -= 1
    if totals:
        light = reduce(DataFrame.unionByName, totals).groupBy(F.col("parent").alias("key")).agg(*[f.alias(f"light_{c}") for c, f in sums.items()])
        placed = placed.join(light, "key", "left").fillna(0, ["light_saved", "light_leaf"]).withColumns({c: F.col(c) + F.col(f"light_{c}") for c in sums})
    placed = placed.withColumn("block", F.floor(F.col("depth") / PATH_BLOCK))
    below = W.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    deeper = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("path", "block").agg(*summed).select("path", "block", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"deeper_{c}") for c in sums])
    whole = placed.withColumns({c: F.sum(c).over(below) for c in sums}).join(blocks, ["path", "block"])
    parents = placed.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select("key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.col("deeper_leaf")).alias("n_leaves"), (F.col("saved") + F.col("deeper_saved")).alias("saved_tokens"))


def end_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Such a digest is serial. Ids are joined into chunks by ranges of (key, id); a node's chunks then stream through one
    task, which holds one of them at a time.
    """
    last = lengths.join(rows.select("conv_id", F.col("depth").alias("length"), "key"), ["conv_id", "length"], "left")
    ends = materialise(last.select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id"))
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def chunks(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or i % CHUNK_IDS == 0]
            parts = [",".join(map(str, ids[i:j])) for i, j in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in starts], pa.binary()), pa.array([ids[i] for i in starts], pa.int64()), pa.array(parts, pa.string())], names=["key", "first", "ids"])

    def digests(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, part in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key or state is None:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(part.encode())
                else:
                    state.update(f",{part}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    chunked = map_texts(ranged, chunks, "key binary, first long, ids string")
    return map_texts(chunked.repartition("key").sortWithinPartitions("key", "first"), digests, "key binary, ends_sha256 string")


def with_turns(nodes: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds role and text of each node's last turn (null at the root). turns: (conv_id, depth, digest)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    contents = conversations.select(content.alias("digest"), role.alias("role"), text.alias("text")).groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns.select("conv_id", "depth", "digest"), ["conv_id", "depth"], "left").join(contents, "digest", "left").drop("digest")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: prefix_trie's rows with ends_sha256.

    Null roles and texts are empty, other columns are dropped, repeated rows are turns of their own; an empty table gives no rows.
    Texts of any length are digested row by row.
    """
    turns, lengths = rebuilt(materialise(numbered(conversations)))
    turns, lengths = materialise(turns), materialise(lengths)
    rows = prefix_keys(turns, lengths)
    return prefix_trie(rows, lengths).join(end_digests(rows, lengths), "key", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 is spelt out: DuckDB has none. 3988292384 is its reflected polynomial.
OP13_SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS n_bytes
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
    FROM turns GROUP BY conv_id),
taken AS (
    SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS taken
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
rebuilt AS (
    SELECT c.conv_id, t.place + 1 AS depth, t.digest, t.n_bytes FROM taken c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
    UNION ALL
    SELECT c.conv_id, c.taken + t.place - c.h + 1, t.digest, t.n_bytes FROM taken c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
keyed AS (
    SELECT conv_id, depth, n_bytes, sha256(string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM taken),
parents AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM keyed),
nodes AS (
    SELECT key, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n_bytes) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM parents GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
sums AS (
    SELECT a.key, sum(v.saved)::BIGINT AS saved_tokens, sum((c.n_children IS NULL)::INT)::BIGINT AS n_leaves
    FROM nodes v LEFT JOIN children c ON c.key = v.key JOIN keyed a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.parent LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key
"""
