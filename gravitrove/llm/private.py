"""Personal data: exact kinds by pattern, further spans by weak supervision over the whole corpus.

Labelers (patterns, gazetteers, context) vote on candidate spans. Votes and span features are small
categories, so the corpus is summed to one row a combination; expectation-maximisation estimates the
labelers' reliabilities from those counts, and a logistic regression on votes and features, trained
on its posteriors, is the final classifier.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import map_texts, materialise, pieces, table

BASE = ("email", "ip", "card", "phone")
#: Kinds that the classifier adds, and what their candidates look like; possessive runs keep every search linear, and none has a longest length.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]{16})[A-Za-z0-9+/_.-]++={0,2}"),
    "number": re.compile(r"(?<![A-Za-z0-9.+-])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![A-Za-z0-9-])"),
    "handle": re.compile(r"(?<!\S)[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++ ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]++"),
}
LEAST_DIGITS = 9
KINDS = (*BASE, *CANDIDATES)

IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can start at the head of a run of digits only
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LETTER, DIGIT, WORDS = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]"), re.compile(r"[a-z]+")
SWITCH = re.compile(r"[A-Z](?=[a-z0-9])|[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

#: Gazetteer of words that announce personal data or credentials.
ANNOUNCING = frozenset("account api auth bearer bic call card cell code contact credential customer email fax iban id key login mail mobile number password passport passwd phone pin private pwd secret sort ssn tax tel telephone token user".split())
#: Categories of a candidate's features, and votes (0 no, 1 yes, 2 abstain) of the labelers below.
VOTES, LEVELS = 7, 4
EM_ROUNDS = 500


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ takes the whole run of local characters before it that no match has used."""
    found, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            used = m.end()
        at = text.find("@", max(at + 1, used))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact kinds, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in (text.count(c) for c in set(text)))


def features(text: str, start: int, end: int) -> list[int]:
    """The labelers' votes on a span, then its length, digit share and entropy, each as a category."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    words = WORDS.findall(before.lower())[-3:]
    digits = sum(c.isdigit() for c in span)
    rich = _entropy(span)
    switches = len(SWITCH.findall(span)) / max(1, len(span) - 1)
    mark = before.rstrip(" ")[-1:]
    votes = [
        1 if re.fullmatch(r"[0-9a-f]{32,64}|[0-9A-F]{32,64}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|(?:[0-9]{4}[ -]?){3}[0-9]{4}", span) else 2,  # pattern: a known layout
        1 if words and words[-1] in ANNOUNCING else 0 if words else 2,  # gazetteer: the word before announces it
        1 if ANNOUNCING.intersection(words[:-1]) else 2,  # gazetteer: a word near before
        1 if mark in ("=", ":", '"', "'") and mark else 2 if words and words[-1] in ANNOUNCING else 0,  # context: assignment or quotation before
        1 if after[:1] in ('"', "'", ">", "}") and after else 2,  # context: quotation after
        0 if re.search(r"[/_.~-]$", before) or rich < 2 else 2,  # context: part of a path, or repetitive
        2 if not LETTER.search(span) else 1 if switches > 0.25 else 0 if switches < 0.15 else 2,  # pattern: characters as in no word
    ]
    return votes + [min(3, len(span) // 12), min(3, 4 * digits // max(1, len(span))), min(3, int(rich))]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of candidate spans that touch no base span and no earlier candidate."""
    taken, found = sorted((a, b) for a, _, b in base), []
    for kind, spans in enumerate((_secrets(text), _numbers(text), _handles(text)), len(BASE)):
        free, i, reached = [], 0, 0
        for start, end in spans:  # both lists ascend
            while i < len(taken) and taken[i][0] < end:
                reached = max(reached, taken[i][1])
                i += 1
            if reached <= start:
                free.append((start, end))
        found += [(a, kind, b, encoded(kind, features(text, a, b))) for a, b in free]
        taken = sorted(taken + free)
    return found


def _secrets(text: str) -> list[tuple[int, int]]:
    """Runs that hold letters and digits, and those of letters alone that an assignment or a word announces."""
    found = []
    for m in CANDIDATES["secret"].finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".-/":
            end -= 1
        while start < end and text[start] in ".-/":
            start += 1
        run = text[start:end]
        if end - start >= 16 and not run.isdecimal() and LETTER.search(run) and (DIGIT.search(run) or _announced(text[max(0, start - 40) : start])):
            found.append((start, end))
    return found


def _announced(before: str) -> bool:
    words = WORDS.findall(before.lower())
    return before.rstrip(" \"'")[-1:] in ("=", ":") or bool(words) and words[-1] in ANNOUNCING


def _numbers(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATES["number"].finditer(text) if m.end() - m.start() >= LEAST_DIGITS and len(_digits(m[0])) >= LEAST_DIGITS]


def _handles(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATES["handle"].finditer(text)] if "(at)" in text or "[at]" in text else []


def encoded(kind: int, values: list[int]) -> int:
    code = kind
    for v, n in zip(values, [3] * VOTES + [LEVELS] * 3):
        code = code * n + v
    return code


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and features of codes."""
    out = []
    for n in [LEVELS] * 3 + [3] * VOTES:
        out.append(codes % n)
        codes = codes // n
    values = np.array(out[::-1]).T.reshape(-1, VOTES + 3)
    return codes, values[:, :VOTES], values[:, VOTES:]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: P(vote | class) by labeler and class, and each row's posterior of being personal data.

    Starts from the majority of the votes and ends when no posterior moves by more than 1e-9; each count is smoothed by one.
    """
    yes, no = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    posterior = np.clip(0.5 + 0.2 * (yes - no), 0.05, 0.95)
    for _ in range(rounds):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weights.sum(axis=1) + 1) / (counts.sum() + 2)
        table_ = np.stack([[[weights[c][votes[:, k] == v].sum() + 1 for v in range(3)] for k in range(VOTES)] for c in range(2)])
        table_ /= table_.sum(axis=2, keepdims=True)
        score = np.log(prior)[:, None] + np.stack([sum(np.log(table_[c, k, votes[:, k]]) for k in range(VOTES)) for c in range(2)])
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return table_, posterior


def design(kinds: np.ndarray, votes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(kinds))] + [kinds == k for k in range(len(BASE), len(KINDS))]
    columns += [votes[:, k] == v for k, v in product(range(VOTES), (0, 1))] + [levels[:, k] == v for k, v in product(range(3), range(1, LEVELS))]
    return np.stack(columns, axis=1).astype(float)


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on counted rows with soft targets."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (target - p)) - ridge * w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepted_codes(codes: np.ndarray, counts: np.ndarray) -> list[int]:
    """The combinations that the final classifier calls personal data."""
    if not len(codes):
        return []
    kinds, votes, levels = decoded(codes)
    _, posterior = reliabilities(votes, counts)
    x = design(kinds, votes, levels)
    return codes[x @ logistic(x, posterior, counts) > 0].tolist()


FOUND = StructType().add("start", "long").add("kind", "integer").add("end", "long").add("code", "long")
ARROW_FOUND = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int64())])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans): structs (start, kind, end) in code points, by start and order of kinds; kind is a number of KINDS.

    The spans of the exact kinds always stay; a candidate of another kind is added if the classifier,
    trained on the counts of all candidates of docs, accepts it. Null and empty texts have no spans;
    each row of docs gives one row; other columns are not read. The combinations of votes and features
    (at most len(CANDIDATES) * 3**VOTES * LEVELS**3) come to the driver, not the spans.
    """

    def run(batches):
        for piece in pieces(batches):
            found = []
            for text in piece.column("text").to_pylist():
                base = base_spans(text or "")
                spans = [(*x, -1) for x in base] + candidates(text or "", base)
                found.append([dict(zip(("start", "kind", "end", "code"), x)) for x in sorted(spans)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, pa.list_(ARROW_FOUND))], names=["doc_id", "found"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(map_texts(read, run, read.select("doc_id").schema.add("found", ArrayType(FOUND))))
    summed = marked.select(F.explode("found.code").alias("code")).where("code >= 0").groupBy("code").count().orderBy("code").collect()
    good = accepted_codes(np.array([r[0] for r in summed], np.int64), np.array([r[1] for r in summed], float))
    wanted = pa.array([-1, *good], pa.int64())

    def keep(batches):
        for batch in batches:
            found = batch.column("found")
            flat = found.flatten()
            chosen = pc.is_in(pc.struct_field(flat, "code"), wanted).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
            total = np.concatenate([[0], np.cumsum(chosen)])
            spans = pa.StructArray.from_arrays([pc.struct_field(flat, c).filter(pa.array(chosen)) for c in ("start", "kind", "end")], ["start", "kind", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(total[ends], pa.int32()), spans)], names=["doc_id", "spans"])

    spans = StructType().add("start", "long").add("kind", "integer").add("end", "long")
    return map_texts(marked, keep, marked.select("doc_id").schema.add("spans", ArrayType(spans)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    def number(k):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
