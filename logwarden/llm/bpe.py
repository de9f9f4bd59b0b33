"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from logwarden.llm import arrow, segment

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHED_PIECES = 1 << 17
LONG_PIECE = 256  # longer ones are merged one by one and not kept
NONE = 1 << 40


class Vocabulary:
    """Ranks of a vocabulary file; pieces already merged are kept, up to a bound."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.labels = [b"%d" % k for k in range(len(self.tokens))]
        self.widths = np.array([len(t) for t in self.tokens], np.int32)
        self.merged: dict[bytes, bytes] = {}

        self.letters = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Open-addressing table: two adjacent tokens -> the rank of what they make."""
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of several at one place the last stays
            self.values[place[free]] = values[free]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], NONE)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            place[more] = (place[more] + 1) & ((1 << self.bits) - 1)
            there = self.keys[place[more]]
            out[more] = np.where(there == keys[more], self.values[place[more]], NONE)
            more = more[(there != keys[more]) & (there >= 0)]
        return out

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit numbers."""
        found = list(map(self.merged.get, pieces))
        new = list({piece for piece, ids in zip(pieces, found) if ids is None})
        if not new:
            return found
        if len(self.merged) + len(new) > CACHED_PIECES:
            self.merged.clear()
        fresh = dict(zip(new, self.merge_all(new)))
        self.merged.update((piece, ids) for piece, ids in fresh.items() if len(piece) <= LONG_PIECE)
        return [fresh[piece] if ids is None else ids for piece, ids in zip(pieces, found)]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Merge many pieces side by side, one merge of each in a step."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[k] = np.array(self.merge(piece), "<i4").tobytes()
            else:
                rest.append(k)
        which = np.array(rest, np.int64)
        parts = self.letters[np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)]
        starts = np.r_[0, np.cumsum([len(pieces[k]) for k in rest], dtype=np.int64)]
        while len(which):
            ranks = np.full(len(parts), NONE)
            ranks[:-1] = self.pair_ranks(parts[:-1], parts[1:])
            ranks[starts[1:] - 1] = NONE  # a piece's last part has no partner
            least = np.minimum.reduceat(ranks, starts[:-1])
            live = least < NONE
            lengths = np.diff(starts)
            if not live.all():
                raw, cut = parts.astype("<i4").tobytes(), (starts * 4).tolist()
                for k in np.flatnonzero(~live).tolist():
                    out[which[k]] = raw[cut[k]:cut[k + 1]]
                stay = np.repeat(live, lengths)
                parts, ranks, which, lengths, least = parts[stay], ranks[stay], which[live], lengths[live], least[live]
                starts = np.r_[0, np.cumsum(lengths)]
                if not len(which):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, lengths))
            owner = np.searchsorted(starts, hits, "right") - 1
            first = hits[np.r_[True, owner[1:] != owner[:-1]]]
            parts[first] = least
            stay = np.ones(len(parts), bool)
            stay[first + 1] = False
            parts = parts[stay]
            starts = starts - np.arange(len(starts))
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is left. Pairs
        wait in a heap, so long runs without a boundary cost n log n."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end[i]: end of the part that starts at i; 0: part gone
        back = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                back[stop] = i
                rank = ranks.get(piece[i:end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            j = back[i]
            if j >= 0:
                rank = ranks.get(piece[j:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of all rows, and the offsets of the rows in them."""
    data, ends = arrow.flat(column)
    points = segment.code_points(data)
    places = np.r_[0, np.cumsum(segment.width(points), dtype=np.int64)]
    rows = np.searchsorted(places, ends)  # in code points
    n = len(ends) - 1
    symbols = np.full(len(points) + n, segment.BREAK, np.uint8)
    text = np.ones(len(symbols), bool)
    text[rows[:-1] + np.arange(n)] = False  # a break before each row
    symbols[text] = segment.symbol_table("tiktoken")[points]
    starts = np.flatnonzero(segment.boundaries(symbols, lead=True)[text])
    cut = places[np.r_[starts, len(points)]].tolist()
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(cut, cut[1:])], np.searchsorted(starts, rows)


def encode_rows(column: pa.Array, path: str) -> list[pa.Array]:
    words = vocabulary(path)
    pieces, rows = slices(column)
    found = words.lookup(pieces)
    ids = np.frombuffer(b"".join(found), "<i4")
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ends = np.r_[0, np.cumsum(counts)][rows]
    places = np.r_[0, np.cumsum(words.widths[ids], dtype=np.int64)]
    row = np.repeat(places[ends[:-1]], np.diff(ends))
    return [arrow.lists(ends, ids), arrow.lists(ends, (places[1:] - row).astype(np.int32))]


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` and ``ends array<int>``: the byte at which each
    token ends in its text. Null and empty texts have no tokens; repeated rows are encoded
    each; special strings are ordinary text. A text is encoded whole, however long, and a
    task holds one chunk of texts at a time. ``path``: the ranks, present on every executor.
    """
    kind = ArrayType(IntegerType())
    return arrow.map_texts(
        docs, [F.col(c) for c in keep], F.col(text), [StructField("ids", kind), StructField("ends", kind)],
        lambda column: encode_rows(column, path),
    )


def decode_rows(ids: pa.Array, ends: pa.Array | None, path: str) -> list[bytes | None]:
    """Bytes of each list of ids. Where ``ends`` is given, every token has to end where it
    says, else this fails."""
    words, out = vocabulary(path), []
    for k, row in enumerate(ids):
        if not row.is_valid:
            out.append(None)
            continue
        numbers = row.values.to_numpy(zero_copy_only=False)
        if ends is not None and ends[k].is_valid:
            if not np.array_equal(np.cumsum(words.widths[numbers]), ends[k].values.to_numpy(zero_copy_only=False)):
                raise ValueError("offsets do not fit the ids")
        out.append(b"".join(map(words.tokens.__getitem__, numbers.tolist())))
    return out


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` and ``decoded binary``, the bytes of its ``ids``. Where ``ends`` is
    there, every token has to end where it says, else the task fails. Null ids give null."""
    fields = encoded.schema.fields
    place = encoded.columns.index("ids")
    offsets = encoded.columns.index("ends") if "ends" in encoded.columns else None

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = decode_rows(part.column(place), None if offsets is None else part.column(offsets), path)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[f.name for f in fields] + ["decoded"])

    return encoded.mapInArrow(run, StructType([*fields, StructField("decoded", BinaryType())]))


def digest_rows(column: pa.Array, path: str) -> list[pa.Array]:
    """Encode, decode again, and digest both while the ids are at hand."""
    ids, ends = encode_rows(column, path)
    labels = vocabulary(path).labels
    numbers, cut = ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
    shown = (b" ".join(map(labels.__getitem__, numbers[a:b])) for a, b in zip(cut, cut[1:]))
    return [
        pa.array(ids.value_lengths().cast(pa.int64())), pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string()),
        pa.array([hashlib.sha256(x).hexdigest() for x in decode_rows(ids, ends, path)], pa.string()),
    ]


def round_trip_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded bytes. A text's ids
    stay in the task that made them."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return arrow.map_texts(docs, [F.col("doc_id")], F.col("text"), fields, lambda column: digest_rows(column, path))
