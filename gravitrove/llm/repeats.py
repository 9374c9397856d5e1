"""Tokens covered by windows that also start in a document with a smaller id: how two operators exchange identifiers.

A piece is a hash group of documents, about a megabyte of text; one Arrow-grouped call sees one piece.
Anchors are positions whose gram (`gram` consecutive tokens) has the least hash of some window, so
every window holds an anchor, and equal windows hold equal anchors at equal places. Only anchors travel,
as 64-bit identifiers packed into one binary value for each piece and bucket of the hash space, after
the piece has merged its equal ones: however common a passage is, a piece reports it once. A bucket
answers each identifier with two bits; the piece finds its identifiers again and reads the answers in
the same order, so neither texts nor positions travel.

Round 1 asks which grams occur in other pieces; the rest, if single in their piece, are settled. Round 2
groups the repeated ones; those of one document alone, and those that always stand in the same context,
are settled. Round 3 asks for the whole contexts of the others. The first document of each context goes
on, level by level: a gram extended to the left or to the right to a level's length is asked for only if
its shorter one was shared, and the last round asks for the windows whose extended grams all were.
How strings get their identifiers is each operator's own: Rolling (words) or BucketPointers (bytes).
Identities are pairs of identifiers, of the gram and of the context or window. Every round reads the
same shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bytes of text in a piece, and about the bytes of identifiers in a bucket.
PIECE_BYTES, BUCKET_BYTES = 1 << 20, 32 << 20

#: Words of more bytes get a hash of their own: sums of powers modulo 2**64 agree for some strings of a thousand bytes, whatever the base.
LONG_WORD = 64

SMALLER, MIXED = 1, 2
#: What an identifier stands for, and what its entries tell apart: contexts of a gram, or documents of a level.
GRAMS, WHOLE, SHARED = range(3)


class Plan(NamedTuple):
    """Lengths in tokens: of a window, of an anchor's gram, of the levels between; and high bytes sent of identities.

    Cut grams of the first rounds can only seem repeated or mixed, which the later rounds settle by `exact` bytes
    of the gram's and of the window's identifier.
    """

    window: int
    gram: int
    levels: tuple[int, ...]
    exact: tuple[int, int] = (8, 8)

    @property
    def sent(self) -> tuple[tuple[int, int], ...]:
        return ((6, 0), (6, 6), self.exact, *[(4, 7)] * len(self.levels), self.exact)

    @property
    def mixes(self) -> tuple[bool, ...]:
        """Whether a round asks if an identifier has several contexts (the first two) or documents (the levels)."""
        return (True, True, False, *[True] * len(self.levels), False)


#: routed by bucket; part: the bucket that answers; a, b, c: identifiers and smallest documents, or flags in a.
ROWS = "bucket long, level int, piece long, part long, a binary, b binary, c binary"
ANSWERS = "piece long, level int, part long, a binary"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_TOKENS = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            powers = np.full(max(n, 1 << 21), base)
            powers[0] = 1
            _powers[i] = np.cumprod(powers, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Identifiers of any run of tokens, by prefix sums of tokens times powers, modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        powers, self.inverse = _power_tables(len(tokens) + 1)
        self.prefix = np.zeros(len(tokens) + 1, np.uint64)
        np.multiply(tokens, powers[: len(tokens)], out=self.prefix[1:])
        np.cumsum(self.prefix, out=self.prefix)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def ranks(self, size: int) -> np.ndarray:
        """An order of the grams that start at each token; never 0."""
        n = len(self.prefix) - size
        ranks = self.prefix[size:] - self.prefix[:n]
        ranks *= self.inverse[:n]
        ranks *= np.uint64(0xD6E8FEB86659FD93)
        ranks >>= np.uint64(32)
        return ranks.astype(np.uint32) | np.uint32(1)


def refined(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The identifier of a pair of bucket identifiers, the same on every machine."""
    x = head * np.uint64(0xD6E8FEB86659FD93)
    x += tail * _BASE
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


class BucketPointers:
    """Bucket identifiers of the strings at each byte, refined by the identifiers of later offsets.

    The first buckets are single bytes. A bucket of strings of some length is refined to up to twice that length
    by the pair of identifiers at its own offset and a later one, and the new identifiers are reused for the next length.
    Up to eight bytes an identifier is the string itself; beyond, the pair is mixed into 64 bits, so that buckets need no
    common numbering. Up to the gram's length all strings are refined; beyond, only those asked for, the ones whose
    buckets still hold several documents.
    """

    def __init__(self, data: np.ndarray, plan: Plan):
        ids, length = data, 1
        for kind in (np.uint16, np.uint32, np.uint64):
            ids = ids[:-length].astype(kind) | ids[length:].astype(kind) << kind(8 * length)
            length *= 2
        while length < plan.gram:
            longer = min(2 * length, plan.gram)
            n = len(data) - longer + 1
            ids, length = refined(ids[:n], ids[longer - length :][:n]), longer
        self.grams, self.lengths = ids, (plan.gram, *plan.levels, plan.window)

    def _at(self, start: np.ndarray, k: int) -> np.ndarray:
        if not k:
            return self.grams[start]
        return refined(self._at(start, k - 1), self._at(start + (self.lengths[k] - self.lengths[k - 1]), k - 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identifiers of strings at most twice as long as the window: of a level's length, or the pair at both ends."""
        size = end - start
        out = np.zeros(len(size), np.uint64)
        for k, (length, longer) in enumerate(zip(self.lengths, [*self.lengths[1:], 2 * self.lengths[-1] + 1])):
            here = np.flatnonzero((size >= length) & (size < longer))
            if len(here):
                head, exact = self._at(start[here], k), size[here] == length
                out[here] = head if exact.all() else np.where(exact, head, refined(refined(head, self._at(end[here] - length, k)), size[here].astype(np.uint64)))
        return out

    def ranks(self, size: int) -> np.ndarray:
        """An order of the grams that start at each byte; never 0."""
        return ((self.grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def running(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over x[i:i + width] for each i."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - width + have], x[width - have :]) if have < width else x


def word_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each white-space separated word of data, and the words' first bytes."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = ((data - np.uint8(9)) > 4) & (data != 32)
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = mixed(Rolling(BYTE_TOKENS[data]).of(starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes, starts


class Piece:
    """The anchors of the documents of one piece; texts are in ascending order of their ids."""

    def __init__(self, table: pa.Table, plan: Plan, words: bool):
        window, gram = plan.window, plan.gram
        keys = np.array([-(1 << 63) if x is None else x for x in table.column("key").to_pylist()], np.int64)
        order = np.argsort(keys, kind="stable")
        texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
        self.rows, self.keys, self.texts = order, keys[order], [texts[i] for i in order]
        data = np.frombuffer((b"\n" if words else b"").join(self.texts), np.uint8)
        sizes = np.array([len(x) + words for x in self.texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        if words:
            tokens, starts = word_tokens(data)
            self.bounds = np.searchsorted(starts, self.bounds)
        else:
            tokens = data
        self.plan, self.gram, self.n, wide = plan, gram, len(tokens), window - gram + 1
        self.table = table
        self.at = np.zeros(0, np.int64)
        if self.n >= window:
            self.hashes = Rolling(tokens) if words else BucketPointers(tokens, plan)
            rank = self.hashes.ranks(gram)
            least = running(np.minimum, rank, wide)
            for start, end in zip(self.bounds[:-1], self.bounds[1:]):
                least[max(start, end - window + 1) : end] = 0
            none = np.zeros(wide - 1, np.uint32)
            self.at = np.flatnonzero(running(np.maximum, np.concatenate([none, least, none]), wide) == rank)
            self.rank, self.least, self.wide = rank[self.at], least, wide
            self.first = mixed(self.hashes.of(self.at, self.at + gram))
        self.doc = np.searchsorted(self.bounds, self.at, "right") - 1
        if len(self.at):
            self.lo = np.maximum(self.bounds[self.doc], self.at - wide + 1)
            self.hi = np.minimum(self.bounds[self.doc + 1], self.at + window)
            self.second = mixed(self.hashes.of(self.lo, self.hi) + ((self.at - self.lo) * 1000003 + (self.hi - self.lo)).astype(np.uint64))

    def rounds(self, told: dict[int, dict[int, bytes]], buckets: int) -> Iterator[tuple[int, Entries]]:
        """The identifiers of each round, as far as the answers of the rounds before are known; sets removed after the last."""
        self.removed = np.zeros(self.n, bool)
        if not len(self.at):
            return
        keys = self.keys[self.doc]
        single = Entries(self.first, self.second, keys, buckets, GRAMS, repeat=False)
        yield 0, single
        again = np.flatnonzero((single.read(told[0]) & MIXED > 0) | (np.bincount(single.group)[single.group] > 1))
        grams = Entries(self.first[again], self.second[again], keys[again], buckets, GRAMS)
        yield 1, grams
        flags = grams.read(told.get(1, {}))
        gone = np.zeros(len(keys), bool)
        gone[again] = ~(flags & MIXED > 0) & ((flags & SMALLER > 0) | (keys[again] > grams.least))
        unsure = again[flags & MIXED > 0]
        contexts = Entries(self.first[unsure], self.second[unsure], keys[unsure], buckets)
        yield 2, contexts
        later = (contexts.read(told.get(2, {})) & SMALLER > 0) | (keys[unsure] > contexts.least)
        gone[unsure[later]] = True
        own = unsure[~later]
        at, last = self.at[own], self.wide - 1
        sides = [np.arange(len(own))] * 2
        allowed = np.ones((last + 1, len(own)), bool)  # by how far a window starts before the anchor
        for k, length in enumerate(self.plan.levels):
            more = length - self.gram
            left, right = sides
            left = left[at[left] - more >= self.bounds[self.doc[own[left]]]]
            right = right[at[right] + length <= self.bounds[self.doc[own[right]] + 1]]
            of = np.concatenate([own[left], own[right]])
            side = np.concatenate([self.hashes.of(at[left] - more, at[left] + self.gram), ~self.hashes.of(at[right], at[right] + length)])
            grown = Entries(self.first[of], mixed(side), keys[of], buckets, SHARED)
            yield 3 + k, grown
            shared = grown.read(told.get(3 + k, {})) & MIXED > 0
            sides = [left[shared[: len(left)]], right[shared[len(left) :]]]
            holds = np.zeros((2, len(own)), bool)
            for held, side in zip(holds, sides):
                held[side] = True
            allowed[more:] &= holds[0]
            allowed[: last - more + 1] &= holds[1]
        starts, of = [], []
        for back in range(self.wide):
            ok = np.flatnonzero(allowed[back] & (at >= back) & (at - back < len(self.least)))
            ok = ok[self.least[at[ok] - back] == self.rank[own[ok]]]
            starts.append(at[ok] - back)
            of.append(own[ok])
        starts, of = np.concatenate(starts), np.concatenate(of)
        window, turn = self.plan.window, 3 + len(self.plan.levels)
        windows = Entries(self.first[of], mixed(self.hashes.of(starts, starts + window)), keys[of], buckets)
        yield turn, windows
        later = (windows.read(told.get(turn, {})) & SMALLER > 0) | (keys[of] > windows.least)
        step = np.zeros(self.n + 1, np.int64)
        np.add.at(step, self.lo[gone], 1)
        np.add.at(step, self.hi[gone], -1)
        np.add.at(step, starts[later], 1)
        np.add.at(step, starts[later] + window, -1)
        self.removed = np.cumsum(step[:-1]) > 0


class Entries:
    """Identifiers of a piece without repeats, each with its smallest document; read() gives each occurrence its answer."""

    def __init__(self, first: np.ndarray, second: np.ndarray, keys: np.ndarray, buckets: int, kind: int = WHOLE, repeat: bool = True):
        order = np.argsort(first) if kind == GRAMS else np.lexsort((second, first))
        a, b, low = first[order], second[order], keys[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        if kind != GRAMS:
            new[1:] |= b[1:] != b[:-1]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        least, most = (np.minimum.reduceat(low, head), np.maximum.reduceat(low, head)) if len(head) else (low, low)
        self.least = np.empty(len(a), np.int64)
        self.least[order] = least[group]
        a, least_b, most_b = a[head], b[head], b[head]
        if kind == GRAMS and len(head):
            least_b, most_b = np.minimum.reduceat(b, head), np.maximum.reduceat(b, head)
        several = np.flatnonzero((least_b != most_b) & repeat if kind == GRAMS else (least != most) & (kind == SHARED))  # these send two entries
        a, b, low = np.append(a, a[several]), np.append(least_b, most_b[several]), np.append(least, (most if kind == SHARED else least)[several])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        bucket = ((a if kind == GRAMS else mixed(a ^ (b * _BASE))) >> np.uint64(20)) % np.uint64(buckets)
        self.sent = np.argsort(bucket, kind="stable")
        self.a, self.b, self.low, bucket = a[self.sent], b[self.sent], low[self.sent], bucket[self.sent].astype(np.int64)
        self.parts, cut = np.unique(bucket, return_index=True)
        self.cut = np.append(cut, len(bucket))

    def read(self, told: dict[int, bytes]) -> np.ndarray:
        flags = np.zeros(len(self.sent), np.uint8)
        flags[self.sent] = np.frombuffer(b"".join(told[int(p)] for p in self.parts), np.uint8)
        return flags[self.group]  # the first of a group's entries stands at the group's number

    def rows(self, piece: int, level: int, sent: tuple[int, int]) -> list[tuple]:
        return [
            (int(p), level, piece, int(p), _cut(self.a[i:j], sent[0]), _cut(self.b[i:j], sent[1]), _packed(self.low[i:j]) if level else b"")
            for p, i, j in zip(self.parts, self.cut[:-1], self.cut[1:])
        ]


def _cut(x: np.ndarray, high: int) -> bytes:
    """The high bytes of each number, first all first bytes and so on: compression then finds what sorted numbers share."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - high :].T.tobytes()


def _joined(parts: list[bytes], high: int) -> np.ndarray:
    out = np.zeros((sum(map(len, parts)) // high, 8), np.uint8)
    at = 0
    for x in parts:
        n = len(x) // high
        out[at : at + n, 8 - high :] = np.frombuffer(x, np.uint8).reshape(high, n).T
        at += n
    return out.view("<u8").ravel()


def _packed(x: np.ndarray) -> bytes:
    base = int(x.min())
    rest = (x - base).astype("<u8")
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    width = x[8]
    out = np.zeros(((len(x) - 9) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8, offset=9).reshape(width, len(out)).T
    return out.view("<i8").ravel() + int.from_bytes(x[:8], "little", signed=True)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _answers(level: int, plan: Plan) -> Callable[[pa.Table], pa.Table]:
    sent = plan.sent[level]

    def run(table: pa.Table) -> pa.Table:
        rows = [tuple(x.values()) for x in table.select(["piece", "level", "part", "a"]).filter(pc.field("level") != level).to_pylist()]
        asked = table.filter(pc.field("level") == level)
        if asked.num_rows:
            a, b, c = (asked.column(x).to_pylist() for x in "abc")
            sizes = [len(x) // sent[0] for x in a]
            first = _joined(a, sent[0])
            second = _joined(b, sent[1]) if level else first
            low = np.concatenate([_unpacked(x) for x in c]) if level else np.repeat(np.arange(len(sizes)), sizes)  # pieces stand in for documents
            del a, b, c
            order = np.lexsort((second, first))
            new = np.ones(len(order), bool)
            x, y = first[order], second[order]
            new[1:] = x[1:] != x[:-1]
            if level > 1:
                new[1:] |= y[1:] != y[:-1]
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            flags = np.where(np.minimum.reduceat(low[order], head)[group] < low[order], SMALLER, 0).astype(np.uint8)
            if plan.mixes[level]:
                other = y if level == 1 else low[order]
                several = np.minimum.reduceat(other, head) != np.maximum.reduceat(other, head)
                flags |= np.where(several, MIXED, 0).astype(np.uint8)[group]
            back = np.empty_like(flags)
            back[order] = flags
            ends = np.cumsum(sizes)
            rows += [(p, level, k, back[e - n : e].tobytes()) for p, k, e, n in zip(asked.column("piece").to_pylist(), asked.column("part").to_pylist(), ends, sizes)]
        return _table(rows, ANSWERS)

    return run


def remove_repeats(docs: DataFrame, finish: Callable[[Piece], pa.Table], schema: str, *, plan: Plan, words: bool) -> DataFrame:
    """finish's rows for each piece of docs (doc_id, text), whose `removed` marks the covered tokens."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("ids must be integers: which document comes first is a comparison of numbers")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = 1 + total // PIECE_BYTES
    buckets = 1 + total // BUCKET_BYTES
    rounds = len(plan.sent)
    # rows that repeat an id come from many partitions of the input and go to as many pieces
    piece = F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(pieces)).alias("piece")
    texts = docs.select(piece, F.col("doc_id").cast("long").alias("key"), "text", "doc_id").groupBy("piece")

    def work(table: pa.Table, answers: pa.Table | None, level: int) -> pa.Table:
        number = table.column("piece")[0].as_py() if table.num_rows else 0
        told: dict[int, dict[int, bytes]] = {}
        rows = []
        for x in answers.to_pylist() if answers else []:
            told.setdefault(x["level"], {})[x["part"]] = x["a"]
            rows.append((x["part"], x["level"], number, x["part"], x["a"], None, None))
        found = Piece(table, plan, words)
        for k, entries in found.rounds(told, buckets):
            if k == level:
                return _table(rows + entries.rows(number, level, plan.sent[level]), ROWS)
        return finish(found) if level == rounds else _table(rows, ROWS)

    def first(table: pa.Table) -> pa.Table:
        return work(table, None, 0)

    def later(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            return work(table, answers, level)

        return run

    asked = texts.applyInArrow(first, ROWS)
    for level in range(rounds):
        answers = asked.groupBy("bucket").applyInArrow(_answers(level, plan), ANSWERS).groupBy("piece")
        asked = texts.cogroup(answers).applyInArrow(later(level + 1), ROWS if level < rounds - 1 else schema)
    return asked
