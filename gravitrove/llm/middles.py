"""Fill-in-middle transformation by rank and select on packed boundary bitvectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import Bits, packed
from .common import as_bytes, free_name, map_texts, named, pieces, table, without

#: What stands before the prefix, the suffix and the middle; percents of texts cut, and of those with the suffix first.
MARKS, CUT_PERCENT, SUFFIX_FIRST_PERCENT = ("<P>", "<S>", "<M>"), 90, 20
#: Bytes whose boundaries are found at once; only the packed bits of a longer text are held.
SLICE = 1 << 20


def boundaries(raw: bytes) -> tuple[Bits, Bits]:
    """Bits at the bytes where a unit (a run of ASCII letters, or any other character) and where a character begins."""
    units, chars = [], []
    for start in range(0, len(raw), SLICE):
        x = np.frombuffer(raw, np.uint8, min(SLICE, len(raw) - start), start)
        letter = (x | 32) - np.uint8(97) < 26
        before = np.concatenate([[start > 0 and raw[start - 1 : start].isalpha()], letter[:-1]])
        first = (x & 0xC0) != 0x80
        units.append(packed(first & ~(letter & before)))
        chars.append(packed(first))
    empty = [np.zeros(0, np.uint8)]
    return Bits(np.concatenate(units or empty)), Bits(np.concatenate(chars or empty))


def _chosen(draws: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units in the prefix, and in prefix and middle."""
    one, two = (d % (n + 1) for d in draws)
    return np.minimum(one, two), np.maximum(one, two)


def fill_in_middle(docs: DataFrame, *, seed: int = 1, marks=MARKS, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with n (units), form, prefix_chars, middle_chars (code points) and output.

    A unit is a run of ASCII letters or one other character. Two draws out of a hash of seed and id cut the text before
    a unit or at its end, two more choose the form: plain (the text), psm (prefix, suffix, middle) or spm (suffix first).
    Texts that are empty or hold one of the marks stay plain, with null prefix_chars and middle_chars.

    Boundaries are bits; the total of their popcounts gives n, and select on the ranks drawn gives the bytes of the cuts.
    A null text is empty, a null id an empty string in the hash; rows of one id are cut at the same draws, repeated
    rows stay, an empty table gives an empty one. Columns named like those added are replaced; any other name is allowed.
    A task holds its longest text, its output and a quarter of its size in bits.
    """
    kept = without(docs, ("n", "form", "prefix_chars", "middle_chars", "output"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit(""))), 256)
    drawn, held = free_name(docs, "draws"), free_name(docs, "held_text")
    draws = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    given = docs.select(*map(named, kept), draws.alias(drawn), named(text_col).alias(held))
    schema = docs.select(*map(named, kept)).schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    first, second, third = (m.encode() for m in marks)

    def run(batches):
        for piece in pieces(batches, held):
            texts = as_bytes(piece.column(held))
            draws = piece.column(drawn).flatten().to_numpy().reshape(-1, 4).T if len(texts) else np.zeros((4, 0), np.int64)
            ends = np.cumsum([0, *map(len, texts)])
            # A text's last byte and the next text's first may both be letters: a zero byte keeps them apart.
            places = ends + np.arange(len(ends))
            units, chars = boundaries(b"\0".join(texts) + b"\0")
            start = units.rank(places)
            n = np.diff(start) - 1
            plain = (n == 0) | (draws[2] % 100 >= cut_percent) | np.array([any(m in t for m in (first, second, third)) for t in texts], bool)
            cuts = [units.select(start[:-1] + c) for c in _chosen(list(draws[:2]), n)]  # the zero byte stands where the n-th unit would
            counts = np.diff([chars.rank(x) for x in (places[:-1], *cuts)], axis=0)
            forms = np.where(plain, "plain", np.where(draws[3] % 100 < suffix_first_percent, "spm", "psm")).tolist()
            out = []
            for text, form, i, j in zip(texts, forms, *((c - places[:-1]).tolist() for c in cuts)):
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                parts = {"plain": (text,), "psm": (first, prefix, second, suffix, third, middle), "spm": (second, suffix, first, prefix, third, middle)}[form]
                out.append(b"".join(parts))
            added = [pa.array(n), pa.array(forms, pa.string()), *(pa.array(c, mask=plain) for c in counts), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *added], names=schema.names)

    return map_texts(given, run, schema)


def restored(output: str = "output", form: str = "form", marks=MARKS) -> Column:
    """The text that an output of fill_in_middle was made from."""
    first, second, third = marks
    text = named(output)

    def halves(lead: str, mark: str) -> tuple[Column, Column, Column]:
        body = F.substr(text, F.lit(len(lead) + 1))
        one = F.substring_index(body, mark, 1)
        rest = F.substr(body, F.length(one) + len(mark) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    prefix, suffix, middle = halves(first, second)
    suffix2, prefix2, middle2 = halves(second, first)
    return F.when(named(form) == "psm", F.concat(prefix, middle, suffix)).when(named(form) == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(text)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h
    FROM documents),
numbers AS (
    SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM drawn),
cut AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, units,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s
    FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
