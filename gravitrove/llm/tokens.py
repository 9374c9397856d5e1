"""Token-id output: Simple-8b words in files ordered by document, and their vectorised reader."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import BATCH_BYTES, BROADCAST_BYTES, as_bytes, listed, map_texts, materialise, measured_bytes, pieces, shared_folder, table

#: Fixed values of the format: a selector's number of ids in a 64-bit word, and bits of each; 4 bits hold the selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
#: The selector whose id stands in the word that follows, in all 64 bits.
ESCAPE = 15
#: Ids in a block; a block starts a new word, so that blocks can be decoded alone.
BLOCK = 4096
#: Text bytes in a file, and bytes of a generation of the words that a worker remembers, some 200 of them for the objects of each word.
FILE_BYTES, KNOWN_BYTES, WORD_BYTES = 24 << 20, 112 << 20, 200
#: Longer words are encoded whenever they are met.
LONG_WORD = 128
#: What stands between new words that are encoded as one text, and how many there are of them.
MARK, WORDS_A_TEXT = b"|", 50
#: New runs of plain words that are encoded as one text, and texts that the library is given at once, which bounds what it holds.
RUNS_A_TEXT, TEXTS_A_CALL = 200, 8


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for the blocks of ids that end at `ends`, and the number of words before each block (and after the last).

    Greedy: each word takes the selector that holds most of the next ids; the last word of a block may hold fewer.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    selector = np.full(n, ESCAPE, np.uint8)
    most, have = _bit_length(ids), 1
    for count in sorted(set(COUNTS.tolist())):  # running maxima of the next `count` widths
        while have < count:
            step = min(have, count - have)
            most[: max(n - step, 0)] = np.maximum(most[: max(n - step, 0)], most[step:])
            have += step
        fits = most <= WIDTHS[COUNTS == count].max()
        if not fits.any():
            break
        np.copyto(selector, np.flatnonzero(COUNTS == count)[0], where=fits, casting="unsafe")
    limit = np.repeat(ends, np.diff(np.append(0, ends)))
    after = np.minimum(np.arange(n) + COUNTS[selector], limit)
    reached, at = np.append(0, ends[:-1]) if n else np.zeros(0, np.int64), []
    while len(reached):  # the next word of every block at once
        at.append(reached)
        reached = after[reached][after[reached] < limit[reached]]
    at = np.sort(np.concatenate(at)) if at else np.zeros(0, np.int64)
    chosen = selector[at]
    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    words = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    words[place] = chosen
    held = after[at] - at
    width = np.repeat(np.where(chosen == ESCAPE, 0, WIDTHS[chosen]).astype(np.uint8), held)
    shift = 4 + width * (np.arange(n).astype(np.uint8) - np.repeat(at.astype(np.uint8), held))  # no word holds 256 ids
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[place[escaped] + 1] = ids[at[escaped]]
    ids[at[escaped]] = 0
    if n:
        words[place] |= np.bitwise_or.reduceat(ids << shift, at)
    offsets = np.append(place, len(words))[np.searchsorted(at, np.append(0, ends))]
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of blocks whose words start at `offsets` and that hold `sizes` ids."""
    if not len(words):
        return np.zeros(0, np.uint32)
    selector = (words & np.uint64(15)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selector == ESCAPE).any():  # a word after an escape is data
        i, marks = 0, selector.tolist()
        while i < len(marks):
            if marks[i] == ESCAPE:
                head[i + 1] = False
                i += 1
            i += 1
    at = np.flatnonzero(head)
    chosen = selector[at]
    block = np.searchsorted(offsets[1:], at, "right")
    count = COUNTS[chosen]
    before = np.cumsum(count) - count
    first = before[np.searchsorted(at, offsets[:-1][block])]
    ends = np.cumsum(sizes)
    start = before - first + (ends - sizes)[block]
    out = np.zeros(int(ends[-1]), np.uint32)
    for k in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == k)
        if k == ESCAPE:
            out[start[here]] = words[at[here] + 1]
        elif WIDTHS[k]:
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            for j in range(COUNTS[k]):
                inside = here[start[here] + j < ends[block[here]]]
                out[start[inside] + j] = (words[at[inside]] >> np.uint64(4 + j * WIDTHS[k])) & mask
    return out


#: Normalizers that treat the words around white space apart, and a splitting pattern that no white space matches.
LOCAL_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LOCAL_SPLITS = [
    {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Kinds of bytes by WORD_PATTERN: visible ASCII, and the two bytes of the letters of Latin-1, which NFC leaves alone; the rest is OTHER.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = bytes(SPACE if b in b" \t\n\v\f\r" else DIGIT if b in b"0123456789" else LETTER if b == 0xC3 or 0x80 <= b < 0xC0 or chr(b).isalpha() and b < 128 else SIGN if 33 <= b < 127 else OTHER for b in range(256))
#: One run of such bytes; the signs of Latin-1 among its letters' second bytes.
PLAIN_RUN = re.compile(rb"'(?:[stmd]|re|ve|ll)|(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+|[0-9]|[!-/:-@\[-`{-~]+")
LATIN_SIGNS = (0x97, 0xB7)
#: The character that the byte level puts for each byte, itself if it is a visible one of Latin-1; the same with spaces as they are.
_HIDDEN = [*range(33), *range(127, 161), 173]
BYTE_LEVEL = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))
SHOWN = BYTE_LEVEL[:32] + " " + BYTE_LEVEL[33:]
#: Members of a definition without which each word is encoded for itself alone; a model that only looks at its own word.
ABSENT = ("truncation", "padding", "post_processor")
LOCAL_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def drops_spaces(definition: dict) -> bool:
    """Whether the tokenizer of this JSON definition drops white space and never looks across it.

    Then a text's ids are those of its words one after the other. Only a known form is recognised; any other
    tokenizer gets whole texts.
    """
    steps = definition.get("normalizer") or {"normalizers": []}
    splits = definition.get("pre_tokenizer") or {}
    model = {k: v for k, v in definition.get("model", {}).items() if k not in ("vocab", "merges")}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in definition.get("added_tokens", []))
    return (
        plain
        and all(definition.get(k) is None for k in ABSENT)
        and all(s in LOCAL_NORMALIZERS for s in steps.get("normalizers", [steps]))
        and splits.get("pretokenizers") == LOCAL_SPLITS
        and model == LOCAL_MODEL
    )


def _ids(tokenizer, texts: list[str]) -> Iterator[list[int]]:
    for i in range(0, len(texts), TEXTS_A_CALL):
        for encoded in tokenizer.encode_batch_fast(texts[i : i + TEXTS_A_CALL], add_special_tokens=False):
            yield encoded.ids


class TextTokens:
    """Ids of texts, as bytes of unsigned 32-bit integers.

    If the tokenizer never looks across white space, texts are cut into words, and plain words into the runs that WORD_PATTERN
    finds; distinct ones of some texts are encoded once while they are remembered. After KNOWN_BYTES of new ones the
    generation before is forgotten but for those met again, so memory is bounded by twice that and by one piece of texts,
    however long the worker lives. Those of more than LONG_WORD bytes are not remembered.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end], "<u4").tobytes()
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        self.by_word, self.runs = drops_spaces(definition), None
        if self.by_word:
            vocabulary, steps = definition["model"]["vocab"], definition.get("normalizer") or {}
            self.lower = {"type": "Lowercase"} in steps.get("normalizers", [steps])
            added = [t["content"].encode().lower() for t in definition.get("added_tokens", [])]
            self.added = re.compile(b"|".join(map(re.escape, added)) or b"(?!)")
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            if all({c, c + "</w>"} <= vocabulary.keys() for c in BYTE_LEVEL) and not any(not t.isascii() or PLAIN_RUN.fullmatch(t) for t in added):
                self.runs = Tokenizer.from_file(path)  # the same model, for runs between spaces
                self.runs.normalizer, self.runs.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bytes = 0

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in _ids(self.tokenizer, list(map(bytes.decode, texts)))]

    def _split(self, texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The runs of plain words of texts, in the model's case, and other words whole; the number of them in each text.

        Other words are those with bytes of other kinds or an added token, in any case of letters.
        """
        raw = b"\n".join([b"", *texts, b""])
        pa.array([raw], pa.large_binary()).cast(pa.large_string())  # fails unless it is UTF-8
        low = np.frombuffer(raw, np.uint8)
        kind = np.frombuffer(raw.translate(KINDS), np.uint8)
        inside = kind != SPACE
        start = inside.copy()
        if self.runs is None:
            start[1:] &= ~inside[:-1]
        else:
            start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
            lowered = raw.lower()
            second = np.flatnonzero(low == 0xC3) + 1
            byte = low[second]
            if self.lower:
                low = np.frombuffer(bytearray(lowered), np.uint8)
                low[second[byte < 0x9F]] += 32
            quotes = np.flatnonzero(low[:-2] == ord("'"))  # a quote that begins a run may begin one of the pattern's endings
            quotes = quotes[kind[quotes - 1] != SIGN]
            one, two = low[quotes + 1], low[quotes + 2]
            length = 2 * np.isin(one, list(b"stmd")) + 3 * (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            quotes, length = quotes[length > 0], length[length > 0]
            start[quotes + 1] = False
            start[quotes + length] = inside[quotes + length]
            odd = [np.flatnonzero(kind == OTHER), second[np.isin(byte, LATIN_SIGNS)], np.fromiter((m.start() for m in self.added.finditer(lowered)), np.int64)]
            if any(map(len, odd)):  # their words stay whole, in their own case
                begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
                which = np.unique(np.searchsorted(begins, np.concatenate(odd), "right")) - 1
                step = np.zeros(len(raw), np.int8)
                step[begins[which]] = 1
                step[np.flatnonzero(inside[:-1] & ~inside[1:])[which] + 1] = -1
                whole = np.cumsum(step, dtype=np.int8).view(bool)
                start[whole] = False
                start[begins[which]] = True
                low = np.where(whole, np.frombuffer(raw, np.uint8), low)
        kept = low[inside]
        offsets = np.append(np.flatnonzero(start[inside]), len(kept))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        counts = np.add.reduceat(start, np.cumsum(sizes) - sizes + 1, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), counts

    def _encoded_words(self, words: list[bytes]) -> list[bytes]:
        """As _encoded, for runs and words as _split gives them: single runs by the model alone, others many to a text."""
        plain = [self.runs is not None and PLAIN_RUN.fullmatch(w) is not None for w in words]
        by_runs, others = (iter(f([w for w, p in zip(words, plain) if p == k])) for f, k in ((self._encoded_runs, True), (self._encoded_groups, False)))
        return [next(by_runs if p else others) for p in plain]

    def _encoded_runs(self, runs: list[bytes]) -> list[bytes]:
        """As _encoded, for plain runs. The last id of a run, and no other, is of an entry that ends a run."""
        texts = [b" ".join(runs[i : i + RUNS_A_TEXT]).decode("latin-1").translate(SHOWN) for i in range(0, len(runs), RUNS_A_TEXT)]
        ids = np.fromiter(chain.from_iterable(_ids(self.runs, texts)), "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        flat = ids.tobytes()
        return [flat[i:j] for _, i, j in zip(runs, [0, *ends][:-1], ends, strict=True)]

    def _encoded_groups(self, words: list[bytes]) -> list[bytes]:
        """As _encoded, for words of any kind: many words make one text.

        The mark between two words is a word of one id; a group whose marks can't be told apart is encoded word by word.
        """
        groups = [words[i : i + WORDS_A_TEXT] for i in range(0, len(words), WORDS_A_TEXT)]
        texts = [(b" " + MARK + b" ").join(group).decode() for group in groups]
        out: list[bytes] = []
        for group, encoded in zip(groups, _ids(self.tokenizer, texts)):
            ids = np.array(encoded, "<u4")
            marks = 4 * np.flatnonzero(ids == self.mark)
            if self.mark is None or len(marks) != len(group) - 1 or any(MARK in w for w in group):
                out += self._encoded(group)
            else:
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(raw)])]
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the number of ids of each text."""
        if self.by_word:
            found, counts = self._split(texts)
            words = found.dictionary_encode()
            codes = self._codes(listed(words.dictionary))
            flat = np.frombuffer(b"".join([*codes, self.end]), "<u4")
            held = np.append(np.fromiter(map(len, codes), np.int64, len(codes)) // 4, 1)
            ends = np.cumsum(counts)
            at = np.insert(words.indices.to_numpy(), ends, len(codes))
            n = held[at]
            done = np.cumsum(n)
            ids = flat[np.repeat((np.cumsum(held) - held)[at] - (done - n), n) + np.arange(n.sum())]
            return ids, np.diff(done[ends + np.arange(len(texts))], prepend=0)
        coded = [x + self.end for x in self._encoded(texts)]
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4

    def _codes(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct runs and words, which are remembered."""
        found = list(map(self.known.get, words))
        lacking = [i for i, code in enumerate(found) if code is None]
        for i in lacking:
            found[i] = self.older.get(words[i])
        new = [i for i in lacking if found[i] is None]
        for i, code in zip(new, self._encoded_words([words[i] for i in new])):
            found[i] = code
        short = {words[i]: found[i] for i in lacking if len(words[i]) <= LONG_WORD}
        self.known.update(short)
        self.bytes += sum(map(len, short)) + sum(map(len, short.values())) + WORD_BYTES * len(short)
        if self.bytes > KNOWN_BYTES:
            self.known, self.older, self.bytes = {}, self.known, 0
        return found


@cache
def text_tokens(path: str, end: int) -> TextTokens:
    """The coder of a Python worker; loading a tokenizer takes longer than a small task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextTokens(path, end)


def _block_ends(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.unique(np.concatenate([ends, *[np.arange(e - s, e, BLOCK)[1:] for s, e in zip(sizes.tolist(), ends.tolist()) if s > BLOCK]]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes token files of docs in ascending order of ids (null first, ties by text).

    A file holds one row a document: file, doc_id, start (ids before it in the file), n_tokens (with the
    end id), offsets (words before each block of BLOCK ids) and words, the Simple-8b words,
    little-endian. Null and empty texts are the end id alone; repeated rows are written each; other
    columns are dropped. Special tokens' strings in a text are read as the tokenizer reads them.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(1 + total // FILE_BYTES, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = ordered.select("doc_id").schema
    for name, kind in (("file", "integer"), ("start", "long"), ("n_tokens", "long"), ("offsets", ArrayType(LongType())), ("words", "binary")):
        schema = schema.add(name, kind)

    def run(batches):
        coder, start, file = text_tokens(tokenizer, end), 0, TaskContext.get().partitionId()
        for piece in pieces(batches, limit=BATCH_BYTES):
            ids, sizes = coder.of(as_bytes(piece.column("text")))
            ends = np.cumsum(sizes)
            blocks = _block_ends(sizes)
            words, offsets = encode(ids, blocks)
            cut = np.append(0, np.searchsorted(blocks, ends) + 1)  # blocks of each document
            rows = [(offsets[i : j + 1] - offsets[i], words[offsets[i] : offsets[j]].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            starts = start + ends - sizes
            start += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([file] * len(rows), pa.int32()), pa.array(starts), pa.array(sizes), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "file", "start", "n_tokens", "offsets", "words"],
            )

    map_texts(ordered, run, schema).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of files of write_tokens; ids as little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("file").agg(F.max(F.col("start") + F.col("n_tokens")).alias("held"))
    order = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("file", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))
    schema = files.select("doc_id").schema.add("file", "integer").add("start", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches):
        for batch in batches:
            for piece in pieces([batch], "words"):
                sizes = piece.column("n_tokens").to_numpy()
                offsets = piece.column("offsets").to_pylist()
                raw = [x or b"" for x in piece.column("words").to_pylist()]
                words = np.frombuffer(b"".join(raw), "<u8")
                base = np.cumsum([0] + [len(x) // 8 for x in raw])
                marks = np.append(np.concatenate([np.array(o[:-1], np.int64) + b for o, b in zip(offsets, base)]), len(words))
                blocks = np.concatenate([np.minimum(BLOCK, n - np.arange(0, n, BLOCK)) for n in sizes.tolist()])
                ids = decode(words, marks, blocks).astype("<u4")
                ends = np.cumsum(sizes)
                out = [ids[e - n : e].tobytes() for n, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "file", "start", "n_tokens")), pa.array(out, pa.binary())], names=["doc_id", "file", "start", "n_tokens", "ids"])

    starts = materialise(starts)
    found = map_texts(files, run, schema).join(F.broadcast(starts) if measured_bytes(starts) <= BROADCAST_BYTES else starts, "file")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to token files in the shared folder, reads them back; rows (doc_id, start, n_tokens, ids_crc32)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
