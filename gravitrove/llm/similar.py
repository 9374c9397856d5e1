"""Near copies by the similarity of word shingles: SimHash links and MinHash bands give candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import as_bytes, free_name, map_texts, materialise, pieces, plain_names
from .simhash import components, fingerprint, links, shingle_hashes

#: Bands of so many minima each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, ROWS = 16, 4
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
PAIRS_A_COPY = 256
#: Bytes of shingles in a block of a band, and about the bytes that one call compares.
BLOCK_BYTES, CALL_BYTES = 2 << 20, 8 << 20


def bands(shingles: np.ndarray) -> list[int]:
    """A key for each band of minima; none without shingles."""
    if not len(shingles):
        return []
    least = np.min([(FACTORS * shingles[i : i + (1 << 14)]).min(axis=1) for i in range(0, len(shingles), 1 << 14)], axis=0)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (node, n, same, fp, bands): node orders the rows of docs, null ids last; same stands for the set of shingles."""

    def run(batches):
        for piece in pieces(batches):
            hashes = [shingle_hashes(t, size) for t in as_bytes(piece.column("text"))]
            sets = [np.unique(h) for h in hashes]
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column("node"), pa.array(map(len, sets), pa.int64()), same, pa.array(map(fingerprint, hashes), pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))],
                names=["node", "n", "same", "fp", "bands"],
            )

    return map_texts(docs, run, StructType([docs.schema["node"]]).add("n", "long").add("same", "binary").add("fp", "long").add("bands", ArrayType(LongType())))


def _linked(whole: DataFrame, most: int) -> DataFrame:
    """Rows (node, n, key): texts whose SimHash fingerprints the links of the inverted index connect share a key."""
    worded = whole.where("n > 0")
    roots = materialise(components(links(materialise(worded.select("fp").distinct()), most)).withColumnRenamed("node", "fp"))
    return worded.join(roots, "fp", "left").select("node", "n", F.xxhash64(F.lit("links"), F.coalesce("root", "fp")).alias("key"))


def _similar(pairs: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `least`, compared in full.

    A text that many pairs share is copied once for every PAIRS_A_COPY of them, so that they don't meet in one task.
    """

    def run(batches):
        shingles = lru_cache(maxsize=8)(lambda text: np.unique(shingle_hashes(text, size)))
        for batch in batches:
            keep = []
            for x, y in zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))):
                x, y = shingles(x), shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def texts(side: DataFrame, name: str) -> DataFrame:
        held = docs.join(side, F.col("node") == F.col(name), "left_semi").groupBy(F.col("node").alias(name)).agg(F.first("text").alias(f"text_{name}"))
        return held.join(side, name) if len(side.columns) > 1 else held

    copies = materialise(pairs.groupBy("a").agg(F.floor(F.count("*") / PAIRS_A_COPY + 1).cast("int").alias("copies")))
    first = texts(copies, "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    joined = dealt.join(first, ["a", "copy"]).join(texts(pairs.select("b").distinct(), "b"), "b").select("a", "b", "text_a", "text_b")
    return materialise(map_texts(joined, run, pairs.schema))


def _preceded(posted: DataFrame, rest: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """Rows (node) of rest that a near copy in one of their bands precedes.

    The texts of a band are dealt into blocks of about BLOCK_BYTES of shingles; a call compares two blocks of some bands,
    in full, and yields each text that is preceded once.
    """
    involved = posted.join(rest.select("key").distinct(), "key", "left_semi").join(rest.select("key", "node", F.lit(True).alias("open")), ["key", "node"], "left")
    involved = materialise(involved.select("key", "node", "place", "n", F.coalesce("open", F.lit(False)).alias("open")))
    texts = docs.join(involved.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def coded(batches):
        for piece in pieces(batches):
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in as_bytes(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = materialise(map_texts(texts, coded, StructType([docs.schema["node"]]).add("shingles", "binary")))
    blocks = involved.groupBy("key").agg(F.floor(8 * F.sum("n") / BLOCK_BYTES + 1).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = involved.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = materialise(dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "place", "open", "n"))
    calls = 1 + 8 * (dealt.agg(F.sum("n")).first()[0] or 0) // CALL_BYTES
    part = F.pmod(F.xxhash64("key", "low", "high"), F.lit(calls)).alias("part")

    def run(table: pa.Table) -> pa.Table:
        places = [(p["score"], p["node"]["none"], p["node"]["id"] or 0, p["node"]["text"]) for p in table.column("place").to_pylist()]
        turn = np.empty(len(places), np.int64)
        turn[sorted(range(len(places)), key=places.__getitem__)] = np.arange(len(places))
        held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in ("key", "low", "high")))):
            groups.setdefault(k, []).append(i)
        open_, found = table.column("open").to_pylist(), set()
        for members in groups.values():
            wanted = [i for i in members if open_[i]]
            if wanted:
                sizes = np.array([len(held[i]) for i in members])
                flat, owner = np.concatenate([held[i] for i in members]), np.repeat(np.arange(len(members)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner, turns = flat[order], owner[order], turn[members]
                for i in wanted:
                    left, right = np.searchsorted(flat, held[i], "left"), np.searchsorted(flat, held[i], "right")
                    many = right - left
                    at = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
                    both = np.bincount(owner[at], minlength=len(members))
                    if ((both >= least * (sizes + len(held[i]) - both) - 1e-9) & (turns < turn[i])).any():
                        found.add(i)
        chosen = table.column("node").take(pa.array(sorted(found), pa.int64())).combine_chunks()
        return pa.table({c: chosen.field(c) for c in ("none", "id", "text")})

    joined = dealt.drop("n").join(sets, "node").select(part, "key", "low", "high", "node", "place", "open", "shingles")
    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema["node"].dataType])
    return joined.groupBy("part").applyInArrow(run, schema).distinct().select(F.struct("none", "id", "text").alias("node"))


@plain_names
def without_near_copies(docs: DataFrame, *, size: int = 5, least: float = 0.8, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no near copy precedes; all columns stay.

    A near copy shares a band and has a similarity of at least `least` of the shingles of `size` words. The texts that
    SimHash links of at most `most` differing bits connect (see simhash.links) are one band, the others are MinHash
    bands: fingerprints of similar texts may differ in more bits than the index guarantees. Texts whose bands have most members precede, so that of a group the most central text stays; then the order is by id (null
    last) and by a hash of the text. Each text is compared with the first of its bands; the others
    of its bands follow only if no near copy was found, and are compared in blocks, so no pairs are written out. No two rows that
    stay are near copies, a row without a near copy stays, and of repeated rows one stays. Texts without words
    count as copies of each other; an empty table gives an empty one.
    """
    row, order, text = (free_name(docs, x) for x in ("near_row", "near_node", "near_text"))
    node = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text"))
    read = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    marked = materialise(_signatures(read, size))
    whole = marked.groupBy("same").agg(F.min("node").alias("node"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")]).drop("same")
    whole = materialise(whole)
    posted = materialise(whole.select("node", "n", F.explode("bands").alias("key")).unionByName(_linked(whole, most)))
    members = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    posted = materialise(posted.join(members, "key"))
    scores = posted.groupBy("node").agg(F.struct((-F.sum("members")).alias("score"), "node").alias("place"))
    posted = materialise(posted.drop("members").join(scores, "node"))
    shared = posted.groupBy("key").agg(F.min(F.struct("place", "n")).alias("p")).select("key", F.col("p.place").alias("first"), F.col("p.n").alias("n_a"))
    posted = materialise(posted.join(shared, "key"))
    close = F.least("n", "n_a") >= least * F.greatest("n", "n_a") - 1e-9
    first = materialise(posted.where((F.col("place") != F.col("first")) & close).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct())
    gone = _similar(first, read, size, least).select(F.col("b").alias("node")).distinct()
    rest = posted.select("key", "node", "n", "place", "first").join(gone, "node", "left_anti")
    gone = gone.unionByName(_preceded(posted, materialise(rest), read, size, least))
    kept = materialise(whole.select("node").join(gone, "node", "left_anti"))
    rows = read.join(kept, "node", "left_semi").groupBy("node").agg(F.count("*").alias("rows"))
    many = materialise(rows.where("rows > 1").select(F.col("node").alias(text)))
    single = docs.withColumn(row, node).join(kept.select(F.col("node").alias(order)), F.col(row) == F.col(order), "left_semi")
    one = single.join(many, F.col(row) == F.col(text), "left_anti").select(docs.columns)
    repeated = single.join(many, F.col(row) == F.col(text), "left_semi").groupBy(row).agg(F.first(F.struct(*docs.columns)).alias(order))
    return one.unionByName(repeated.select(f"{order}.*"))
