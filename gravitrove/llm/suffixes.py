"""Suffix-array dedup over bytes: buckets of equal q-grams, refined by identifiers of later offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import table
from .repeats import Piece, Plan, remove_repeats


def remove_repeated_bytes(docs: DataFrame, *, window: int = 50, gram: int = 20, level: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, spans, kept): bytes covered by a string of `window` bytes that also starts in a document with a smaller id are gone.

    Bucket-pointer refinement: the suffixes at anchors fall into buckets of equal q-grams. Each bucket that several
    documents share is refined by sorting on the bucket identifiers of later offsets, from `gram` bytes to `level`
    and to the window, and the refined identifiers are reused for the next refinement (repeats.BucketPointers); buckets
    that hold one document, or one context, are final and leave. spans: starts and ends of the maximal removed
    runs; kept: the bytes that stay, which may not be valid UTF-8. Null and empty texts have no bytes; rows of
    equal ids never remove each other's bytes; a null id counts as the smallest; ids must be integers; other
    columns are not read. A task's memory is bounded by its longest text.
    """

    if not 8 <= gram <= level <= window or level > 2 * gram or window > 2 * level:
        raise ValueError("each length is at most twice the one before, and the first at least eight bytes")

    def finish(piece: Piece) -> pa.Table:
        n, gone, spans, kept = [], [], [], []
        for text, i, j in zip(piece.texts, piece.bounds[:-1], piece.bounds[1:]):
            mask = piece.removed[i:j]
            n.append(len(text))
            gone.append(int(mask.sum()))
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist() if gone[-1] else []
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if gone[-1] else text)
        ids = piece.table.column("doc_id").take(pa.array(piece.rows))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = ArrayType(StructType().add("start", "long").add("end", "long"))
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", spans).add("kept", "binary")
    return remove_repeats(docs, finish, schema, plan=Plan(window, gram, (level,), exact=(5, 8)), words=False)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
