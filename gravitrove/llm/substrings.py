"""Substring dedup over words: level-wise doubling of repeated windows."""

from __future__ import annotations

from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Piece, Plan, remove_repeats


def doubled(window: int, least: int) -> tuple[int, ...]:
    """Lengths from at least `least` words up, each at most twice the one before, that double to the window."""
    lengths = [window]
    while (lengths[-1] + 1) // 2 >= least:
        lengths.append((lengths[-1] + 1) // 2)
    return tuple(reversed(lengths))


def remove_repeated_windows(docs: DataFrame, *, window: int = 50, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): words covered by a window that also starts in a document with a smaller id are gone.

    Level-wise doubling from runs of `least` words or more (7, 13, 25, 50): a run around an anchor that several
    documents share at one length alone is extended to twice that length, to the left and to the right, until
    no candidates survive or the window's length is reached (see repeats.py for the exchange). kept
    joins the words that stay by one space. Null and empty texts have no words; rows of equal ids
    never remove each other's words; a null id counts as the smallest; ids must be integers; other columns are
    not read. A task's memory is bounded by its longest text.
    """
    gram, *levels, _ = doubled(window, least) if window > least else (window, window)

    def finish(piece: Piece) -> pa.Table:
        n, gone, kept = [], [], []
        for text, i, j in zip(piece.texts, piece.bounds[:-1], piece.bounds[1:]):
            words, mask = text.split(), piece.removed[i:j]
            n.append(len(words))
            gone.append(int(mask.sum()))
            kept.append(b" ".join(compress(words, ~mask) if gone[-1] else words))
        ids = piece.table.column("doc_id").take(pa.array(piece.rows))
        return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return remove_repeats(docs, finish, schema, plan=Plan(window, gram, tuple(levels)), words=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM p),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM g) WHERE f < doc_id),
cov AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM (SELECT doc_id, i, unnest(range(50)) AS o FROM hit) GROUP BY doc_id),
r AS (SELECT d.doc_id, d.w, coalesce(gone, []) AS gone FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (
        SELECT r.doc_id, u.i, r.w[u.i] AS x FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM r) u JOIN r ON r.doc_id = u.doc_id
        LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM r) z ON z.doc_id = u.doc_id AND z.i = u.i WHERE z.i IS NULL) GROUP BY doc_id)
SELECT r.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN k ON k.doc_id = r.doc_id
"""
