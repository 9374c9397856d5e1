"""Quality rules: word statistics and long repetitions by a suffix array of each document's words.

Spark deals out the documents; a task works through pieces of a few megabytes. Over the words of a
piece, prefix doubling sorts the suffixes of all its documents at once (a suffix ends with its
document, and only positions whose prefix still occurs twice are sorted again). Intervals of the longest
common prefixes are the repeated substrings; those that no word extends are maximal, and their spans are united.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_texts, pieces, plain_names, table, without

CONTINUED = bytes(range(0x80, 0xC0))
SPACES = b"\t\n\x0b\x0c\r "

#: Columns that the task adds, all counts of words but for n_symbols (characters) and n_dup_lines (lines).
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, equal for equal words, and the bounds of the documents within them."""
    seen: dict[bytes, int] = {}
    number = count()
    parts, sizes = [], [0]
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        parts.append(np.fromiter(map(seen.setdefault, words, number), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    bounds = np.cumsum(sizes)
    return ids, bounds


def suffix_ranks(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Rank arrays by the first 1, 2, 4, ... words of each suffix; the last has no ties.

    Equal ranks at one level mean equal words; a suffix never reaches beyond its document.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    width = int(ids.max(initial=0)) + 1
    key = doc * width + ids
    active = np.arange(n)
    rank = np.zeros(n, np.int32)  # a piece has fewer words than 2**31
    levels, length = [], 0
    while len(active):
        if length:
            later = active + length
            inside = later < end[active]
            after = np.where(inside, rank[np.minimum(later, n - 1)].astype(np.int64) + 1, 0)
            key = rank[active].astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        place = np.arange(len(active))
        first = np.ones(len(active), bool)
        first[1:] = key[1:] != key[:-1]
        old = rank[active]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        start = np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[active] = old + start - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        alone = first & np.append(first[1:], True)
        active = active[~alone]
        length = 2 * length or 1
    return levels


def common_prefixes(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the longest common prefix of each suffix with the one before it; 0 across documents."""
    n = len(ids)
    levels = suffix_ranks(ids, bounds)
    order, prefix = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not levels:
        return order, prefix
    order[levels[-1]] = np.arange(n)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    left, right = order[:-1], order[1:]
    near = np.flatnonzero((doc[left] == doc[right]) & (levels[0][left] == levels[0][right]))
    left, right = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    while levels:
        rank, length = levels.pop(), 1 << len(levels)
        a, b = left + common, right + common
        ok = (a + length <= end[left]) & (b + length <= end[right])
        ok[ok] = rank[a[ok]] == rank[b[ok]]
        common[ok] += length
    prefix[near + 1] = common
    return order, prefix


def intervals(prefix: np.ndarray, least: int) -> np.ndarray:
    """The longest-common-prefix intervals of at least `least` words: rows (length, first, last) in the suffix array.

    An interval is a longest run of suffixes that share `length` words; intervals nest or lie apart.
    """
    found, open_ = [], []
    at = np.flatnonzero(prefix >= least)
    before = -2
    for i, length in zip(at.tolist(), prefix[at].tolist()):
        if i != before + 1:
            found += [(size, first, before) for size, first in open_]
            open_ = []
        first = i - 1
        while open_ and open_[-1][0] > length:
            size, first = open_.pop()
            found.append((size, first, i - 1))
        if not open_ or open_[-1][0] < length:
            open_.append((length, first))
        before = i
    found += [(size, first, before) for size, first in open_]
    return np.array(found, np.int64).reshape(-1, 3)


def maximal_repeats(ids: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The length of the deepest interval at each word (0: none of `least` words), and each document's longest maximal repeat.

    An interval's words are right-maximal; they are a maximal repeat unless the same word stands before every
    occurrence, and then each occurrence lies within a longer repeat, whose interval covers it. So the spans of the
    deepest intervals unite to those of the maximal repeats; intervals further out are shorter and start at
    the same word. The deepest one that holds a suffix has the larger of its two common prefixes.
    """
    order, prefix = common_prefixes(ids, bounds)
    repeat = np.zeros(len(ids), np.int64)
    longest = np.zeros(len(bounds) - 1, np.int64)
    found = intervals(prefix, least)
    if not len(found):
        return repeat, longest
    length, first, last = found.T
    head = np.zeros(len(ids), bool)
    head[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    before = np.where(head[order], -1 - np.arange(len(order)), ids[order - 1])  # the word before; none is equal to no other
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    maximal = change[last] != change[first]
    length, first, last = length[maximal], first[maximal], last[maximal]
    np.maximum.at(longest, np.searchsorted(bounds, order[first], "right") - 1, length)
    deepest = np.maximum(prefix, np.append(prefix[1:], 0))
    repeat[order] = np.where(deepest >= least, deepest, 0)
    return repeat, longest


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Marks the words inside a maximal repeat of at least `least` words: the union of the spans."""
    step = np.zeros(len(repeat) + 1, np.int64)
    at = np.flatnonzero(repeat >= least)
    np.add.at(step, at, 1)
    np.add.at(step, at + repeat[at], -1)
    return np.cumsum(step[:-1]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    """STATISTICS of each text; runs of at least `least` words count as covered."""
    ids, bounds = word_ids(texts)
    repeat, longest = maximal_repeats(ids, bounds, min(3, least))
    lines = [[line for line in text.split(b"\n") if line.strip()] for text in texts]
    values = {
        "n_words": np.diff(bounds),
        "word_chars": [len(t.translate(None, CONTINUED + SPACES)) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": _sums(covered(repeat, 3), bounds),
        "n_covered_words": _sums(covered(repeat, least), bounds),
        "longest_repeat": longest,
    }
    return {k: np.asarray(v, np.int64) for k, v in values.items()}


def measure(docs: DataFrame, carried: list[str], text_col: str, least: int) -> DataFrame:
    """The carried columns of docs and STATISTICS, one row for each row of docs."""
    read = docs.select(*carried, *([] if text_col in carried else [text_col]))
    schema = docs.select(*carried).schema
    for name in STATISTICS:
        schema = schema.add(name, "long")

    def run(batches):
        for piece in pieces(batches, text_col):
            found = statistics(as_bytes(piece.column(text_col)), least)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), *map(pa.array, found.values())], names=[*carried, *found])

    return map_texts(read, run, schema)


@plain_names
def quality(docs: DataFrame, *, carried: list[str] | None = None, text_col: str = "text", least: int = 10, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The carried columns (default: all) of docs with STATISTICS, base_failed and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of them stand in three-word
    windows found twice. kept: not base_failed, repeated runs of at least `least` words cover at most the
    fraction max_covered of the words, and none is longer than max_longest words. A null or empty text
    has no words and fails; nulls elsewhere and repeated rows pass through unchanged; columns of docs
    that bear the names of added ones are replaced. The memory of a task is bounded by its longest text.
    """
    added = (*STATISTICS, "base_failed", "kept")
    carried = without(docs.select(*(carried or docs.columns)), added)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fits = (F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measure(docs, carried, text_col, least).withColumn("base_failed", base).withColumn("kept", ~base & fits)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (
            SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
three AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM p WHERE i + 2 <= len(w)),
three_hit AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM three), (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY 1),
ten AS (SELECT doc_id, i, array_to_string(w[i:i+9], ' ') AS g FROM p WHERE i + 9 <= len(w)),
ten_hit AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(10)) AS o FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM ten) WHERE c > 1) GROUP BY 1),
long_hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(w[i:i+100], ' ')) AS g FROM p WHERE i + 100 <= len(w)) GROUP BY doc_id, g HAVING count(*) > 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, coalesce(t.n, 0) AS n_covered, x.doc_id IS NOT NULL AS too_long
      FROM d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN three_hit h ON h.doc_id = d.doc_id LEFT JOIN ten_hit t ON t.doc_id = d.doc_id LEFT JOIN long_hit x ON x.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= 0.3e0 * n_words AND NOT too_long AS kept
FROM f
"""
