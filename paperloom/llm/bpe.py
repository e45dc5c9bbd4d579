"""Byte-level BPE encoding and decoding through a minimal perfect hash, with a heap over linked bytes behind it."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import slices, travels

travels(__name__)

#: What a worker remembers before it starts afresh: bytes of pre-tokens with their ids (EACH is what one costs beside them), and pieces,
#: none longer than the longest vocabulary entry. Longer pre-tokens than KEPT characters are not remembered beyond their text, and a text
#: of more than PORTION characters is encoded so many pre-tokens at a time. All of it bounds memory and changes nothing else.
MEMORY, EACH, REMEMBERED, KEPT, PORTION, AT_A_TIME = 64 << 20, 160, 200_000, 64, 1_000_000, 100_000
#: Keys per bucket of the perfect hash, on average.
BUCKET = 2


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank. Ranks must be gapless from 0."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                ranks[int(rank)] = base64.b64decode(piece)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not gapless from 0")
    return [ranks[i] for i in range(len(ranks))]


def spread(hashes: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """A place below *size* for every hash under its bucket's shift."""
    with np.errstate(over="ignore"):
        x = hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def build_index(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, ranks) of a minimal perfect hash: one place per key and none over.

    Buckets of two keys or more, largest first, try shifts until all their keys meet free places. A bucket of one key names a
    free place itself, as a negative shift. ranks gives the rank of the key at each place.
    """
    size = len(keys)
    hashes = digests(keys)
    buckets = max(1, size // BUCKET)
    members: list[list[int]] = [[] for _ in range(buckets)]
    for i, b in enumerate((hashes % np.uint64(buckets)).tolist()):
        members[b].append(i)
    shifts, ranks, taken = np.zeros(buckets, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
    single = []
    for b in sorted(range(buckets), key=lambda b: -len(members[b])):
        own = members[b]
        if len(own) == 1:
            single.append(b)
        if len(own) < 2:
            continue
        tried = 0
        while True:  # 64 shifts at a time
            shift = np.arange(tried + 1, tried + 65)
            places = spread(np.repeat(hashes[own][None, :], 64, 0), shift[:, None], size)
            ordered = np.sort(places, 1)
            fits = ~taken[places].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if fits.any():
                k = int(fits.argmax())
                shifts[b], ranks[places[k]] = shift[k], own
                taken[places[k]] = True
                break
            tried += 64
    for b, place in zip(single, np.flatnonzero(~taken).tolist(), strict=False):
        shifts[b], ranks[place] = -place - 1, members[b][0]
    return shifts, ranks


class Vocabulary:
    """Byte strings by rank, and the rank of a byte string through the perfect hash.

    Broadcast once; a worker keeps it from task to task, and with it what it remembers: pre-tokens with their ids, and
    the ranks of pieces. Both are started afresh when they are full, which changes no result.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.keys = keys
        self.shifts, self.ranks = build_index(keys)
        self.shift_of, self.rank_at = self.shifts.tolist(), self.ranks.tolist()
        self.longest = max(map(len, keys), default=0)
        self.two = self.find_all([bytes((a, b)) for a in range(256) for b in range(256)])
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pieces: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "held": 0, "pieces": {}}

    def find_all(self, tokens: list[bytes]) -> list[int]:
        """The rank of each token, -1 where it is no vocabulary entry."""
        if not tokens or not self.keys:
            return [-1] * len(tokens)
        hashes = digests(tokens)
        shift = self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)]
        place = np.where(shift < 0, -shift - 1, spread(hashes, np.maximum(shift, 0), len(self.keys)))
        return [r if self.keys[r] == t else -1 for r, t in zip(self.ranks[place].tolist(), tokens, strict=True)]

    def find(self, token: bytes) -> int:
        """The same for one piece, remembered."""
        rank = self.pieces.get(token)
        if rank is None:
            if len(token) > self.longest or not self.keys:
                return -1
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            rank = self.pieces[token] = self.look_up(token)
        return rank

    def look_up(self, token: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        place = -self.shift_of[h % len(self.shift_of)] - 1
        if place < 0:
            x = h ^ ((-place - 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            place = (x ^ (x >> 29)) % len(self.keys)
        rank = self.rank_at[place]
        return rank if self.keys[rank] == token else -1

    def merge(self, token: bytes) -> list[int]:
        """Ranks of a token that is no entry: the adjacent pair with the lowest rank joins, the leftmost first, until none can.

        Pieces are linked by where the next and the last one start; a heap holds the pairs. A pair whose pieces have
        changed since is passed over, so n bytes take n log n steps.
        """
        size, find, known, two = len(token), self.find, self.pieces.get, self.two
        bits = size.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # An entry is one number: the rank, then where the pair starts, then where it ends.
        heap = [
            (((rank << bits) | i) << bits) | (i + 2)
            for i, rank in enumerate(map(two.__getitem__, [a << 8 | b for a, b in zip(token, token[1:])]))
            if rank >= 0
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end, start = entry & mask, (entry >> bits) & mask
            middle = after[start]
            if not 0 < middle < end or after[middle] != end:
                continue
            after[start], after[middle] = end, 0  # 0: no piece starts here any more
            if end < size:
                before[end] = start
                until = after[end]
                rank = known(token[start:until])
                if rank is None:
                    rank = find(token[start:until])
                if rank >= 0:
                    heappush(heap, (((rank << bits) | start) << bits) | until)
            ahead = before[start]
            if ahead >= 0:
                rank = known(token[ahead:end])
                if rank is None:
                    rank = find(token[ahead:end])
                if rank >= 0:
                    heappush(heap, (((rank << bits) | ahead) << bits) | end)
        ids, start = [], 0
        while start < size:
            end = after[start]
            ids.append(find(token[start:end]))
            start = end
        return ids


def encoder(vocabulary: Vocabulary, pattern: str):
    """text -> ids as little-endian unsigned 32-bit integers, with one pattern to a vocabulary."""
    compiled = regex.compile(pattern)
    known = vocabulary.known

    def encode_words(words: list[str]) -> bytes:
        fresh = list(set(words).difference(known))
        raw = [w.encode() for w in fresh]
        for word, piece, rank in zip(fresh, raw, vocabulary.find_all(raw), strict=True):
            ids = [rank] if rank >= 0 else vocabulary.merge(piece)
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join([known[w] for w in words])
        for word, piece in zip(fresh, raw, strict=True):
            if len(word) > KEPT:
                del known[word]
            else:
                vocabulary.held += len(piece) + len(known[word]) + EACH
        if vocabulary.held > MEMORY:
            known.clear()
            vocabulary.held = 0
        return out

    def encode(text: str) -> bytes:
        if len(text) <= PORTION:
            return encode_words(compiled.findall(text))
        found = (m.group() for m in compiled.finditer(text))
        return b"".join(iter(lambda: encode_words(list(islice(found, AT_A_TIME))), b""))

    return encode


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    keys = vocabulary.keys
    return b"".join([keys[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _shared(spark: SparkSession, ranks_path: str):
    """The vocabulary for the tasks: bounded by the rank file, which does not grow with the data."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<bigint>) per row. A null text counts as empty and has no ids; special tokens are ordinary text."""
    shared = _shared(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(encode(t or ""), "<u4").astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInArrow(run, f"id {kind}, ids array<bigint>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the bytes that the ids stand for. Null ids count as none."""
    shared = _shared(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value.keys
        for batch in batches:
            out = [b"".join([keys[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    thin = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def token_digest(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, and ids array<int> if asked for: encoded, then decoded from the ids alone.

    A null text counts as empty. Rows keep their number, repeated ones too; other columns are not read.
    """
    shared = _shared(docs.sparkSession, ranks_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encode = encoder(vocabulary, pattern)
        for batch in slices(batches, "text"):
            counts, first, second, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(decode(vocabulary, ids)).hexdigest())
                kept.append(np.frombuffer(ids, "<i4") if with_ids else None)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    thin = docs.select("doc_id", "text")
    kind = thin.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return thin.mapInArrow(run, schema)


def op7(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": op7}
SQL: dict[str, str] = {}
