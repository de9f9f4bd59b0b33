"""BPE encoding by longest tokens and backtracking, and decoding by an offset table.

Two tokens may stand side by side in an encoding exactly if encoding their joined bytes gives
them back, and an encoding is right if all its neighbours may. So the encoder takes the
longest token at each place (an Aho-Corasick automaton lists the tokens at every place in one
pass over the text), asks the pair table whether it may follow the one before, else tries the
next shorter one, and steps back where none is left. A place that led nowhere is never entered
again, so the time is linear in the text. What comes out is what merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from logwarden.llm import arrow, segment

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CACHED_PIECES = 1 << 18
CACHED_LENGTH = 64  # bytes of a piece that is kept
CACHED_PAIRS = 1 << 20
NEVER = 1 << 40  # a rank that is never reached


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Offsets:
    """Byte strings by number, side by side: where each begins and how long it is."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.widths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.widths) - self.widths

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the strings one behind the other, and where each ends."""
        widths = self.widths[numbers]
        ends = np.cumsum(widths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[numbers] - (ends - widths), widths)
        return self.flat[np.arange(total) + shift], ends


class MergeRules:
    """Which rule joins two tokens, and whether a cut between two tokens outlasts all rules.
    Every token is made by one rule, which comes after those of its halves."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        """``merges``: (left, right, what they make) by rank."""
        self.rules: dict[tuple[int, int], int] = {}  # two tokens -> rank of what they make
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * size
        for rank, (a, b, whole) in enumerate(merges):
            if whole in self.halves or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("a token has two rules, or one that comes before its halves'")
            self.rules[a, b] = rank
            self.halves[whole] = (a, b)
            self.rank[whole] = rank
        self.spines: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}

    def _spine(self, token: int, last: bool) -> list[tuple[int, int]]:
        """What stands at the end (or at the start) of a token while it is merged, and at
        which rank it is taken up by the next."""
        out, until, part = [], NEVER, token
        while True:
            out.append((part, until))
            if part not in self.halves:
                break
            until = self.rank[part]
            part = self.halves[part][last]
        self.spines[token << 1 | last] = out
        return out

    def cut_lasts(self, left: int, right: int, until: int = NEVER) -> bool:
        """No rule joins something across the cut before it is taken up from its own side.
        Of equal rules the left one goes first, so the left side wins a tie."""
        find = self.rules.get
        ends = self.spines.get(left << 1 | 1) or self._spine(left, True)
        starts = self.spines.get(right << 1) or self._spine(right, False)
        for x, x_until in ends:
            for y, y_until in starts:
                rank = find((x, y))
                if rank is not None and rank < min(x_until, until) and rank <= min(y_until, until):
                    return False
        return True

    def occurring(self, numbers) -> dict[int, bool]:
        """Whether each token can occur: its halves can, and their cut lasts until their own
        rule joins them."""
        out: dict[int, bool] = {}
        for number in sorted(numbers, key=self.rank.__getitem__):  # halves come first
            if number in self.halves:
                a, b = self.halves[number]
                out[number] = out[a] and out[b] and self.cut_lasts(a, b, self.rank[number])
            else:
                out[number] = True
        return out

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.cut_lasts(left, right)
        return known


class Vocabulary:
    """Tokens of a byte-level vocabulary file, and how they may follow each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        tokens = [b""] * size
        for token, number in ids.items():
            tokens[number] = bytes(letters[c] for c in token)
        for token, number in added.items():
            tokens[number] = token.encode()
        self.tokens = tokens
        self.special = {token.encode(): number for token, number in added.items()}
        self.bytes = Offsets(tokens)
        self.labels = Offsets([b"%d," % k for k in range(size)])

        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = MergeRules([(ids[a], ids[b], ids[a + b]) for a, b in pairs], size)
        self.encoded: dict[bytes, bytes] = {}
        self._index(ids.values())

    def _index(self, numbers) -> None:
        """Automaton over the tokens that can occur, and of each the longest shorter one that
        it begins with."""
        usable = self.merges.occurring(numbers)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        number_of = {self.tokens[k]: k for k, fine in usable.items() if fine}
        for token, number in number_of.items():
            self.automaton.add_word(token.decode("latin-1"), number)
        self.automaton.make_automaton()
        if sum(len(token) == 1 for token in number_of) < 256:
            raise ValueError("a byte has no token")
        self.shorter = [-1] * len(self.tokens)
        for token, number in number_of.items():
            for k in range(len(token) - 1, 0, -1):
                if token[:k] in number_of:
                    self.shorter[number] = number_of[token[:k]]
                    break
        self.width = list(map(len, self.tokens))

    def encode_piece(self, piece: bytes) -> list[int]:
        n, width, shorter, known = len(piece), self.width, self.shorter, self.merges.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - width[token]] = token  # a longer one ends later
        dead = bytearray(n + 1)
        out: list[int] = []
        place, token = 0, longest[0] if n else 0
        while place < n:
            end = place + width[token]
            follows = not dead[end]
            if follows and out:
                follows = known.get(out[-1] << 32 | token)
                if follows is None:
                    follows = self.merges.may_follow(out[-1], token)
            if follows:
                out.append(token)
                place = end
                if place < n:
                    token = longest[place]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[place] = 1
                token = out.pop()
                place -= width[token]
        return out

    def lookup(self, pieces: list[bytes], special: bool) -> list[bytes]:
        """Each piece's ids as 32-bit numbers. A whole special string stands
        for its number, where asked for; no ordinary piece is one."""
        found = list(map(self.encoded.get, pieces))
        new = {piece for piece, ids in zip(pieces, found) if ids is None}
        if not new:
            return found
        fresh = {}
        for piece in new:
            number = self.special.get(piece) if special else None
            fresh[piece] = array("i", self.encode_piece(piece) if number is None else [number]).tobytes()
        if len(self.encoded) + len(new) > CACHED_PIECES:
            self.encoded.clear()
        self.encoded.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHED_LENGTH and p not in self.special)
        return [fresh[piece] if ids is None else ids for piece, ids in zip(pieces, found)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def special_places(raw: bytes, ends: np.ndarray, special: list[bytes]) -> list[tuple[int, int]]:
    """Where special strings stand in the rows of ``raw``: first place first, none over another."""
    hits = []
    for word in special:
        place = raw.find(word)
        while place >= 0:
            hits.append((place, -len(word)))
            place = raw.find(word, place + 1)
    out, reached = [], 0
    for place, width in sorted(hits):
        stop = place - width
        if place >= reached and np.searchsorted(ends, place, "right") == np.searchsorted(ends, stop, "left"):
            out.append((place, stop))
            reached = stop
    return out


def slices(column: pa.Array, symbols: np.ndarray, special: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of all rows, special strings whole, and the offsets of the rows in them."""
    data, ends = arrow.flat(column)
    raw = data.tobytes()
    points = segment.code_points(data)
    places = np.r_[0, np.cumsum(segment.width(points), dtype=np.int64)]
    rows = np.searchsorted(places, ends)  # in code points
    kinds = symbols[points]
    within = np.zeros(len(points), bool)
    for start, stop in special_places(raw, ends, special):
        a, b = np.searchsorted(places, (start, stop))
        kinds[a:b] = segment.BREAK  # a token of its own each; together with the first below
        within[a + 1:b] = True
    n = len(ends) - 1
    broken = np.full(len(points) + n, segment.BREAK, np.uint8)
    text = np.ones(len(broken), bool)
    text[rows[:-1] + np.arange(n)] = False  # a break before each row
    broken[text] = kinds
    starts = np.flatnonzero(segment.boundaries(broken, lead=True)[text] & ~within)
    cut = places[np.r_[starts, len(points)]].tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])], np.searchsorted(starts, rows)


def encode_rows(column: pa.Array, path: str, packed: bytes, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and the offsets of the rows in them."""
    words = vocabulary(path)
    pieces, rows = slices(column, segment.unpacked_symbols(packed), list(words.special) if special else [])
    found = words.lookup(pieces, special)
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), np.int32), np.r_[0, np.cumsum(counts)][rows]


def _with_ends(ids: np.ndarray, rows: np.ndarray, path: str) -> list[pa.Array]:
    places = np.r_[0, np.cumsum(vocabulary(path).bytes.widths[ids])]
    ends = places[1:] - np.repeat(places[rows[:-1]], np.diff(rows))
    return [arrow.lists(rows, ids), arrow.lists(rows, ends.astype(np.int32))]


def encode(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str = VOCABULARY, special: bool = True,
) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` and ``ends array<int>``: the byte at which each
    token ends in its text. Null and empty texts have no tokens; repeated rows are encoded
    each; other columns do not matter, and a kept one must not be named like a result. A
    special string is its own token, or plain text if ``special`` is false. A text is encoded
    whole, however long, and a task holds one chunk of texts at a time. ``path``: the
    vocabulary, present on every executor."""
    kind, packed = ArrayType(IntegerType()), segment.packed_symbols("tokenizers")
    return arrow.map_texts(
        docs, [F.col(c) for c in keep], F.col(text), [StructField("ids", kind), StructField("ends", kind)],
        lambda column: _with_ends(*encode_rows(column, path, packed, special), path),
    )


def decode_rows(ids: np.ndarray, rows: np.ndarray, path: str) -> list[bytes]:
    """Bytes of each row's ids, gathered from the offset table."""
    joined, ends = vocabulary(path).bytes.joined(ids)
    cut = np.r_[0, ends][rows].tolist()
    raw = joined.tobytes()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of its ``ids``, special strings
    included. Null ids give null; a column ``decoded`` that is there already is refused."""
    if "decoded" in (c.lower() for c in encoded.columns):
        raise ValueError("there is a column decoded already")
    fields, place = encoded.schema.fields, encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                column = part.column(place)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out = decode_rows(ids, np.r_[0, np.cumsum(sizes, dtype=np.int64)], path)
                valid = column.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x if v else None for x, v in zip(out, valid)], pa.binary())],
                    names=[f.name for f in fields] + ["decoded"],
                )

    return encoded.mapInArrow(run, StructType([*fields, StructField("decoded", BinaryType())]))


def digest_rows(column: pa.Array, path: str, packed: bytes) -> list[pa.Array]:
    """Encode, decode again, and digest both while the ids are at hand."""
    ids, rows = encode_rows(column, path, packed)
    shown, ends = vocabulary(path).labels.joined(ids)
    cut = np.r_[0, ends][rows].tolist()
    shown = shown.tobytes()
    listed = [hashlib.sha256(shown[a:max(a, b - 1)]).hexdigest() for a, b in zip(cut, cut[1:])]
    decoded = (x.decode("utf-8", "replace").encode() for x in decode_rows(ids, rows, path))
    return [
        pa.array(np.diff(rows), pa.int64()), pa.array(listed, pa.string()),
        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
    ]


def round_trip_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded text. A text's ids
    stay in the task that made them."""
    packed = segment.packed_symbols("tokenizers")
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return arrow.map_texts(docs, [F.col("doc_id")], F.col("text"), fields, lambda column: digest_rows(column, path, packed))
