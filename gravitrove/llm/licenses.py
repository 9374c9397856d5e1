"""License scans: exact phrases, and fuzzy notices found by pigeonhole seeds and verified by bounded-error matching."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import PLAIN_BYTES, as_bytes, map_texts, pieces, table

#: Phrases that stand for a licence word by word.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices, as plain words, searched with one error in every ERROR_SPAN characters.
NOTICES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-1.1", "the apache software license version 1 1"),
    ("apache-2", "apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("artistic-2", "the artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "this software is provided by the copyright holders and contributors as is"),
    ("bsl-1", "boost software license version 1 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("cddl-1", "common development and distribution license version 1 0"),
    ("epl-1", "eclipse public license version 1 0"),
    ("epl-2", "eclipse public license version 2 0"),
    ("eupl-1.2", "european union public licence version 1 2"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl-1.1", "mozilla public license version 1 1"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("ofl-1.1", "sil open font license version 1 1"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)
ERROR_SPAN = 14
#: Words that tell licences apart: a match must hold those of its notice unchanged and in order; only a last 0 may lack.
TELLING = re.compile(rb"\b(?:[0-9]+|nc|nd|sa|noncommercial|noderivatives|sharealike|affero|lesser)\b")


@cache
def seeds(notice: str, errors: int) -> tuple[tuple[int, bytes], ...]:
    """errors + 1 parts of the notice with their offsets: a match with that many errors holds one part unchanged."""
    text = notice.encode()
    cut = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return tuple((a, text[a:b]) for a, b in zip(cut, cut[1:]))


@cache
def pattern(notice: str, errors: int) -> regex.Pattern:
    return regex.compile(rb"(?b)\b(?:" + regex.escape(notice.encode(), literal_spaces=True) + rb"){e<=" + str(errors).encode() + rb"}")


def _places(line: bytes, part: bytes) -> list[int]:
    found, at = [], line.find(part)
    while at >= 0:
        found.append(at)
        at = line.find(part, at + 1)
    return found


def _tells_apart(line: bytes, start: int, end: int, notice: str) -> bool:
    """Whether the matched text, taken to the ends of its words and the telling words that follow, names another licence."""
    wanted = TELLING.findall(notice.encode())
    if not wanted:
        return False
    stop = line.find(b" ", max(start, end - 1))
    start, end = line.rfind(b" ", 0, start) + 1, stop if stop >= 0 else len(line)
    while m := TELLING.match(line, end + 1):
        end = m.end()
    found = TELLING.findall(line, start, end)
    if wanted[-1] == b"0" and found == wanted[:-1]:
        return False
    return found[: len(wanted)] != wanted or any(not w.isdigit() for w in found[len(wanted) :])


def fuzzy_matches(line: bytes, notice: str, errors: int) -> list[tuple[int, int, int]]:
    """(start, end, errors) of the notice in line, in bytes; matches don't overlap, of two that would the better one stays.

    Each place of a seed gives one window, as long as the notice and its errors, in which the best match is sought, so
    the work grows with the number of places. Places inside a window that matched without errors need no search.
    """
    near = sorted({(max(0, at - offset - errors), at - offset + len(notice) + errors) for offset, part in seeds(notice, errors) for at in _places(line, part)})
    found, clean = [], -1
    for start, end in near:
        if start + errors >= clean or end > clean + 2 * errors:
            m = pattern(notice, errors).search(line, start, min(end, len(line)))
            if m and not _tells_apart(line, *m.span(), notice):
                found.append((sum(m.fuzzy_counts), *m.span()))
                clean = m.end() if not found[-1][0] else clean
    kept = Apart()
    return sorted((a, b, wrong) for wrong, a, b in sorted(set(found)) if kept.add(a, b))


class Apart:
    """Intervals that don't overlap; add() says whether one more lies apart from all others."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        i = bisect_left(self.ends, start + 1)
        if i < len(self.starts) and self.starts[i] < end:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def scan(text: bytes, error_span: int = ERROR_SPAN) -> tuple[int, list[int], list[dict]]:
    """Words of text, first word of each exact phrase (labels apart), and all found notices with their word spans."""
    words = text.translate(PLAIN_BYTES).split()
    line = b" ".join(words)
    closed = b" " + line + b" "
    starts = None
    spans, base, marked = [], [], {}

    def word_at(at: int) -> int:
        nonlocal starts
        if starts is None:
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        return int(np.searchsorted(starts, at, "right")) - 1

    for phrase, label in PHRASES.items():
        for at in _places(closed, b" " + phrase.encode() + b" "):
            first = word_at(at)
            base.append(first)
            spans.append({"label": label, "first_word": first, "last_word": first + phrase.count(" "), "errors": 0, "base": True, "score": 1.0})
    near = []
    for label, notice in NOTICES:
        for start, end, wrong in fuzzy_matches(line, notice, len(notice) // error_span):
            near.append({"label": label, "first_word": word_at(start), "last_word": word_at(max(start, end - 1)), "errors": wrong, "base": False, "score": 1 - wrong / len(notice)})
    for span in sorted(near, key=lambda x: (x["errors"], x["first_word"] - x["last_word"], x["label"])):
        held = range(span["first_word"], span["last_word"] + 1)
        if all(marked.get(w, span["label"]) == span["label"] for w in held):
            spans.append(span)
            marked.update(dict.fromkeys(held, span["label"]))
    return len(words), base, spans


SPAN = StructType().add("label", "string").add("first_word", "long").add("last_word", "long").add("errors", "long").add("base", "boolean").add("score", "double")
ARROW_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", error_span: int = ERROR_SPAN) -> DataFrame:
    """Rows (doc_id, n_words, spans): each place where a phrase stands exactly or a notice stands with few errors.

    A notice of n characters may have n // error_span insertions, deletions or substitutions; where notices of several
    labels overlap, that with the fewest errors stays. Null and
    empty texts have no words and no spans; each row of docs gives one row; other columns are not read.
    """

    def run(batches):
        for piece in pieces(batches):
            found = [scan(t, error_span) for t in as_bytes(piece.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(ARROW_SPAN))],
                names=["doc_id", "n_words", "spans"],
            )

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(read, run, read.select("doc_id").schema.add("n_words", "long").add("spans", ArrayType(SPAN)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    firsts = F.transform(base, lambda x: x["first_word"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    return license_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
