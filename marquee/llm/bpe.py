"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A word is a short byte string. Its parts, their boundaries and the ranks of
adjacent parts lie side by side; the smallest rank is found by scanning, one
boundary is deleted, and the two neighbouring ranks are looked up again. Scanning
beats a heap while words are short. All new words of a block go through this
together, one row of a matrix each. A word over ``SCAN_BYTES`` takes the same
merges in the same order from a heap instead, so a long run of letters without
a space costs n log n.

Words repeat, so each task remembers the pieces of recent words; the memory is
emptied when it is full.

Defined cases: NULL and empty texts have no tokens and decode to the empty text;
repeated rows are encoded row by row; other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.textblocks import mixed, row_blocks

#: Bytes of a word up to which ranks are scanned.
SCAN_BYTES = 64
#: Words that a task remembers.
MEMORY = 500_000
#: Text bytes whose new words are merged together.
BLOCK = 2 << 20

#: The split pattern of byte-level BPE, with Unicode's white space
#: spelled out. Its alternatives begin differently but for the last two, so the
#: commonest comes first.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for texts within Latin-1: its white space, letters and numbers.
_S1, _L1, _N1 = "\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PATTERN = rf" ?[{_L1}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N1}]+| ?[^{_S1}{_L1}{_N1}]+|[{_S1}]+(?![^{_S1}])|[{_S1}]+"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Token ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        #: merges by pair of ids: rank and id of the joined part
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self._slots()

    def _slots(self) -> None:
        """The merges as an open-addressed table of pair keys, for lookups of many pairs at once."""
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        joined = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)
        self.mask = (1 << (int(len(keys)).bit_length() + 2)) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, NO_RANK, np.int64)
        self.joins = np.zeros(self.mask + 1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.ranks[slot[mine]], self.joins[slot[mine]] = joined[left[mine], 0], joined[left[mine], 1]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair, or the slot of an empty place."""
        keys = left << 32 | right
        slot = self._slot(keys)
        while True:
            here = self.keys[slot]
            wrong = np.flatnonzero((here != keys) & (here >= 0))
            if not len(wrong):
                return slot
            slot[wrong] = (slot[wrong] + 1) & self.mask


NO_RANK = 1 << 60


def merge_scanned(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of short words: a contiguous rank array per word, scanned for its minimum.

    Row w holds word w: ``parts`` its part ids and ``ranks`` the rank of each part
    with the next one. A merge deletes one boundary: the parts behind it move up.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max(initial=1)) + 1
    column = np.arange(width)
    inside = column < lengths[:, None]
    parts = np.full((len(words), width), -1, np.int64)
    parts[inside] = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    ranks = np.full((len(words), width), NO_RANK, np.int64)
    joined = column < lengths[:, None] - 1
    row, at = np.nonzero(joined)
    ranks[row, at] = vocabulary.ranks[vocabulary.look_up(parts[row, at], parts[row, at + 1])]
    out: list = [None] * len(words)
    rows, left = np.arange(len(words)), lengths.copy()
    while len(rows):
        at = ranks.argmin(axis=1)
        every = np.arange(len(rows))
        going = ranks[every, at] < NO_RANK
        for i in np.flatnonzero(~going):
            out[rows[i]] = parts[i, : left[i]].tolist()
        if not going.all():
            rows, left, at = rows[going], left[going], at[going]
            width = int(left.max(initial=0)) + 1
            parts, ranks = parts[going, :width], ranks[going, :width]
            every = every[: len(rows)]
        if not len(rows):
            break
        new = vocabulary.joins[vocabulary.look_up(parts[every, at], parts[every, at + 1])]
        source = np.minimum(column[:width] + (column[:width] > at[:, None]), width - 1)
        parts = np.take_along_axis(parts, source, 1)
        ranks = np.take_along_axis(ranks, source, 1)
        left -= 1
        parts[every, at] = new
        ranks[every, at] = NO_RANK
        last = at + 1 < left
        row, here = every[last], at[last]
        ranks[row, here] = vocabulary.ranks[vocabulary.look_up(parts[row, here], parts[row, here + 1])]
        row, here = every[at > 0], at[at > 0] - 1
        ranks[row, here] = vocabulary.ranks[vocabulary.look_up(parts[row, here], parts[row, here + 1])]
    return out


def merge_queued(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same merges for a long word: a heap of pairs over a linked list of parts."""
    n = len(word)
    ids = vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def offers(i: int):
        j = after[i]
        if j < n and (ids[i], ids[j]) in vocabulary.merges:
            yield vocabulary.merges[ids[i], ids[j]][0], i, ids[i], ids[j]

    queue = [entry for i in range(n) for entry in offers(i)]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = vocabulary.merges[a, b][1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0:
                for entry in offers(k):
                    heapq.heappush(queue, entry)
    return [i for i in ids if i >= 0]


class Codec:
    """Encodes and decodes texts with one vocabulary.

    A word's entry holds its token ids, their count, the ids as decimal text, and
    the bytes that the ids decode to.
    """

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.decimal = {i: str(i) for i in self.vocabulary.bytes_of}
        self.words, self.latin_words = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_entries = {t: self._entry([i]) for t, i in self.vocabulary.special.items()}
        self.memory: dict[str, tuple] = {}

    def _entry(self, ids: list[int]) -> tuple:
        bytes_of, decimal = self.vocabulary.bytes_of, self.decimal
        return ids, len(ids), ",".join([decimal[i] for i in ids]), b"".join([bytes_of[i] for i in ids])

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def _parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """Words of a text, and its special tokens where they stand."""
        if self.special is None or not self.special.search(text):
            return [(False, self._split(text))]
        return [(True, [p]) if p in self.special_entries else (False, self._split(p)) for p in self.special.split(text)]

    def _learn(self, words: set[str]) -> dict[str, tuple]:
        """Entries of words that are not remembered."""
        raw = [(w, w.encode()) for w in words]
        short = sorted(((w, r) for w, r in raw if len(r) <= SCAN_BYTES), key=lambda x: len(x[1]))
        out = {w: self._entry(merge_queued(r, self.vocabulary)) for w, r in raw if len(r) > SCAN_BYTES}
        for start in range(0, len(short), 8192):
            some = short[start : start + 8192]
            out |= zip([w for w, _ in some], map(self._entry, merge_scanned([r for _, r in some], self.vocabulary)))
        return out

    def entries(self, texts: list[str]) -> Iterator[list[tuple]]:
        """Per text, the entries of its words."""
        split = [self._parts(t) for t in texts]
        new = {w for parts in split for special, words in parts if not special for w in words}
        new.difference_update(self.memory)
        learned = self._learn(new) if new else {}
        if len(self.memory) + len(learned) > MEMORY:
            learned |= {w: self.memory[w] for parts in split for special, words in parts if not special for w in words if w in self.memory}
            self.memory = {}
        self.memory |= learned
        for parts in split:
            yield [e for special, words in parts for e in map((self.special_entries if special else self.memory).__getitem__, words)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for entry in entries for i in entry[0]] for entries in self.entries(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoded(documents: DataFrame, vocabulary: str, key: Column, text: Column) -> DataFrame:
    """``key``, ``ids`` (token ids) of every text, and ``decoded``, read back from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        gc.freeze()
        for block in row_blocks(batches, "text", BLOCK):
            ids = codec.encode([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())],
                names=["key", "ids", "decoded"],
            )

    source = documents.select(key.alias("key"), text.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")


def token_digests(documents: DataFrame, vocabulary: str, key: Column, text: Column) -> DataFrame:
    """``key``, ``n_tokens``, digests of the ids and of the decoded text: what :func:`encoded` gives, digested in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        gc.freeze()
        for block in row_blocks(batches, "text", BLOCK):
            counts, digests, texts = [], [], []
            for entries in codec.entries([t or "" for t in block.column("text").to_pylist()]):
                counts.append(sum([e[1] for e in entries]))
                digests.append(sha256(",".join([e[2] for e in entries]).encode()).hexdigest())
                decoded = b"".join([e[3] for e in entries]).decode("utf-8", "replace")
                texts.append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = documents.select(key.alias("key"), text.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def total_tokens(digests: DataFrame) -> DataFrame:
    """Documents and tokens of a corpus."""
    return digests.agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
