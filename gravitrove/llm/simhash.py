"""SimHash near-dedup: an inverted index of byte positions, count filtering, verification, components."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_texts, materialise, pieces, table

BITS, BYTES = 64, 8
#: Rows of the index in one grouped call.
INDEX_ROWS = 200_000
#: Posting lists up to this length are compared all at once; longer than the second, they are split.
SHORT_LIST, LONGEST_LIST = 8, 2048


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` lower-cased words joined by spaces; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(1, len(words) - size + 1)
    cut = zip(starts[:last].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(line[i:j], 42) for i, j in cut), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in batches:
            for piece in pieces([batch]):
                found = [fingerprint(shingle_hashes(t, size)) for t in as_bytes(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(read, run, read.select("doc_id").schema.add("fp", "long"))


def index_sets() -> list[tuple[int, ...]]:
    """Sets of three byte positions such that any four positions hold one of them."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]  # of four positions, three are in a group, or two in one and one in the next
    sets = [g for g in groups if len(g) == 3]
    return sets + [(*pair, x) for k, g in enumerate(groups) for pair in combinations(g, 2) for x in groups[(k + 1) % 3]]


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of byte positions at which each pair shares its byte."""
    return ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Pairs whose tally reaches the guaranteed minimum, BYTES - most, and of these the ones that differ in at most `most` bits."""
    near = tally(a, b) >= BYTES - most
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= most
    return near


def list_links(x: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one posting list: each fingerprint is linked once, when it is first reached."""
    out, rest = [], x
    while len(rest) > 1:
        reached, rest = [rest[:1]], rest[1:]
        while reached and len(rest):
            source = reached.pop()
            for v in source:
                near = linked(rest, np.full_like(rest, v), most)
                if near.any():
                    found, rest = rest[near], rest[~near]
                    out.append((np.full_like(found, v), found))
                    reached.append(found)
                if not len(rest):
                    break
    return out


def _bytes_at(positions: tuple[int, ...]) -> Column:
    """The bytes at these positions, kept in place in a long."""
    return F.col("fp").bitwiseAND(F.lit(sum(255 << 8 * p for p in positions) - (1 << 64 if 7 in positions else 0)))


def _posted(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Postings (positions, bytes, fp): each fingerprint under its bytes at each set of positions."""
    keys = [F.struct(F.lit(sum(1 << p for p in s)).cast("short").alias("positions"), _bytes_at(s).alias("bytes")) for s in sets]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.*", "fp")


def _parted(posted: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """The postings of lists of at most `longest` rows, and those of longer ones with the column rows."""
    long_ = materialise(posted.groupBy("positions", "bytes").agg(F.count("*").alias("rows")).where(F.col("rows") > longest))
    return posted.join(long_, ["positions", "bytes"], "left_anti"), posted.join(long_, ["positions", "bytes"])


def _compared(posted: DataFrame, keys: list[str], most: int, groups: int) -> DataFrame:
    """Links (a, b) within the lists of posted, which `keys` tell apart; a call works through many lists."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in keys]
        x = table.column("fp").to_numpy()
        order = np.lexsort((x, *columns[::-1]))
        x = x[order].view(np.uint64)
        new = np.ones(len(x), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(x)))
        of, group = np.repeat(size, size), np.cumsum(new)
        found = [(x[:0], x[:0])]
        for lag in range(1, min(SHORT_LIST, len(x))):  # all pairs of the short lists at once
            i = np.flatnonzero((group[:-lag] == group[lag:]) & (of[:-lag] <= SHORT_LIST))
            i = i[linked(x[i], x[i + lag], most)]
            found.append((x[i], x[i + lag]))
        for k in np.flatnonzero(size > SHORT_LIST):
            found += list_links(x[start[k] : start[k] + size[k]], most)
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    part = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("part")
    return posted.select(part, *keys, "fp").groupBy("part").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, most: int = 4, longest: int = LONGEST_LIST) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints differing in at most `most` bits, directly or by others.

    `most` differing bits touch at most `most` bytes, so a linked pair shares at least BYTES - most positional
    bytes (four). The inverted index is read by sets of three positions of which any four hold one. A list of
    more than `longest` rows is split by every further position, since its linked pairs share a fourth; a
    list of four shared bytes that is still longer is dealt into blocks, and each pair of blocks is compared
    on its own. So no task holds a list of more than 2 * longest rows, and no pair is lost. Within a list
    the bytes that a pair shares are tallied; pairs below the guaranteed minimum are dropped, the others
    verified. A list of m links each fingerprint when it is first reached, m - 1 links at most, however dense.
    """
    if most > BYTES - 4:
        raise ValueError("the index guarantees pairs of at most four differing bits")
    posted = materialise(_posted(fps, index_sets()))
    groups = 1 + posted.count() // INDEX_ROWS
    short, long_ = _parted(posted, longest)
    found = [_compared(short, ["positions", "bytes"], most, groups)]
    long_ = materialise(long_)
    if not long_.isEmpty():
        wider = [(p, F.col("positions").bitwiseAND(F.lit(1 << p)) == 0) for p in range(BYTES)]
        mask = [F.when(free, F.struct((F.col("positions") + F.lit(1 << p)).cast("short").alias("positions"), F.col("bytes").bitwiseOR(_bytes_at((p,))).alias("bytes"))) for p, free in wider]
        split = long_.select("fp", F.explode(F.array_compact(F.array(*mask))).alias("key")).select("key.*", "fp").distinct()
        split = materialise(split)
        groups = 1 + split.count() // INDEX_ROWS
        short, long_ = _parted(split, longest)
        found.append(_compared(short, ["positions", "bytes"], most, groups))
        blocks = F.floor((F.col("rows") - 1) / longest + 1).cast("int")
        dealt = long_.withColumn("own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pairs = dealt.select("positions", "bytes", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
        found.append(_compared(pairs, ["positions", "bytes", "low", "high"], most, groups))
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b): root is the least node of the component.

    Large-star and small-star steps by turns; each step groups with a map-side minimum and joins back,
    and is written to the shared folder. Ends when a round changes nothing.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u")
        small = stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct())


def near_duplicates(docs: DataFrame, *, size: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the least id that links of at most `most` bits reach.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows and equal
    fingerprints share a component; rows without an id get a component but never name one unless it has
    no other; an empty table gives an empty result; other columns are not read.
    """
    marked = materialise(fingerprints(docs, size=size, id_col=id_col, text_col=text_col))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = materialise(components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp"))
    grouped = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialise(grouped.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
