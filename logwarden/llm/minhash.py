"""Near-duplicate documents by circulant MinHash.

All coordinates of a signature come from two permutations of the 32-bit numbers: the first
spreads the shingles, the second is shifted circularly by one for every further coordinate.
Signatures are cut into bands. Documents that share a band are candidates of each other, and
a group of candidates that hang together is compared on full shingle sets, block against
block. A block's pairs stay inside its task: only the links that join its members are
written, never all pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from logwarden.llm import arrow
from logwarden.llm.graph import components
from logwarden.llm.words import SPACE, words_of
from logwarden.stage import written

SHINGLE = 5
THRESHOLD = 80  # per cent
ROWS, BANDS = 4, 32  # a pair at the threshold shares no band with a chance of 5e-8
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 2_000_000  # of one side of a comparison
SMALL_LIST = 250_000  # ids, about 40 MB; a longer list of candidates is joined by a shuffle

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x09:0x0E] = SPACE
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct word shingles; a text of fewer words,
    but not none, has one shingle."""
    words = words_of(column, FOLD)
    n = len(words.hashes)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        part = words.hashes[k:]
        hashes[:n - k] = (hashes[:n - k] ^ hashes[:n - k] >> np.uint64(32)) * _STEPS[0] + part * _STEPS[k % 4]
    hashes ^= hashes >> np.uint64(29)
    out = []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(hashes[a:b - size + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(words.hashes[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _mixed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Least values of each (non-empty) set under the shifted permutations."""
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    spread = _mixed(np.concatenate(sets).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((coordinates, len(sets)), np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_mixed(spread + np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for every band, the band's number included."""
    bands = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    keys = np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * _STEPS[3] + np.zeros((len(signature), 1), np.uint64)
    for k in range(rows):
        keys = (keys ^ keys >> np.uint64(29)) * _STEPS[0] + bands[:, :, k]
    keys ^= keys >> np.uint64(32)
    return (keys * _STEPS[1]).view(np.int64)


def signature_rows(column: pa.Array, size: int, rows: int, bands: int) -> list[pa.Array]:
    sets = shingle_sets(column, size)
    filled = [s for s in sets if len(s)]
    keys = band_keys(signatures(filled, rows * bands), rows) if filled else np.zeros((0, bands), np.int64)
    ends = np.r_[0, np.cumsum([bands * (len(s) > 0) for s in sets])]
    return [
        pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), arrow.lists(ends, keys.ravel()),
    ]


def set_rows(column: pa.Array, size: int) -> list[pa.Array]:
    sets = shingle_sets(column, size)
    return [pa.array(map(digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Which sets of ``left`` (numbers into ``sets``) are near which of ``right``."""
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = count > 1
    place = np.cumsum(shared) - 1
    both = shared[column]
    column, owner = place[column[both]], owner[both]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    row_left, row_right = np.full(len(sets), -1), np.full(len(sets), -1)
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    for begin in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        sides = []
        for rows, n in ((row_left, len(left)), (row_right, len(right))):
            here = rows[owner[a:b]]
            side = np.zeros((n, 4096), np.float32)
            side[here[here >= 0], column[a:b][here >= 0] - begin] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    total = lengths[left][:, None] + lengths[right][None, :] - common
    return (100 * common >= threshold * total) & (common > 0)


def hung_together(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links join, as few as a forest has."""
    label = {int(x): int(x) for x in (*left, *right)}

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    out = []
    for i, row in zip(left.tolist(), near):
        for j in right[np.flatnonzero(row)].tolist():
            a, b = top(i), top(j)
            if a != b:
                label[a] = b
                out.append((i, j))
    return out


LINKS = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _compare(threshold: int):
    def work(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        names = table.column("digest").to_pylist()
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        pairs = hung_together(linked(sets, left, right, threshold), left, right) if len(left) and len(sets) > 1 else []
        return pa.table([pa.array([names[i] for i, _ in pairs], pa.binary()), pa.array([names[j] for _, j in pairs], pa.binary())], names=["a", "b"])

    return work


def candidates(reps: DataFrame) -> DataFrame:
    """(node, root) of the sets that hang together by shared bands. ``reps``: (node, bands)."""
    keys = reps.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return components(keys.join(hubs, "key").select(F.col("node").alias("a"), "b"))


def block_places(members: DataFrame) -> DataFrame:
    """``members`` (root, n, digest) with the comparisons each takes part in: ``task`` and
    ``side``. Links need sizes within the threshold of each other, so a large group is cut
    into size classes, each compared with itself and the next; a class too large for a task
    is dealt out into blocks, and every two blocks meet once."""
    step = math.log(100 / THRESHOLD)
    group = members.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= BLOCK_SHINGLES)
    classed = members.join(group, "root").withColumn(
        "class", F.when(small, F.lit(0)).otherwise(1 + F.floor(F.log("n") / step + 1e-9)).cast("int")
    )
    sizes = classed.groupBy("root", "class").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )

    def of(shift, name):
        return sizes.select("root", (F.col("class") + shift).alias("class"), F.col("blocks").alias(name))

    near = classed.join(sizes, ["root", "class"]).join(of(-1, "above"), ["root", "class"], "left").join(of(1, "below"), ["root", "class"], "left")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")

    def tasks(count, entry):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).otherwise(F.array().cast("array<struct<c:int,x:int,d:int,y:int,side:int>>"))

    def entry(c, x, d, y, side):
        return F.struct(*[v.cast("int").alias(k) for k, v in (("c", c), ("x", x), ("d", d), ("y", y), ("side", side))])

    k, own = F.col("class"), F.col("block")
    within = tasks(F.col("blocks"), lambda o: entry(k, F.least(own, o), k, F.greatest(own, o), (own > o).cast("int")))
    upward = tasks(F.when(k > 0, F.coalesce("above", F.lit(0))).otherwise(0), lambda o: entry(k, own, k + 1, o, F.lit(0)))
    downward = tasks(F.when(k > 1, F.coalesce("below", F.lit(0))).otherwise(0), lambda o: entry(k - 1, o, k, own, F.lit(1)))
    return near.withColumn("block", block).select(
        "root", "digest", F.explode(F.concat(within, upward, downward)).alias("at")
    ).select("digest", F.struct("root", "at.c", "at.x", "at.d", "at.y").alias("task"), "at.side")


def _components(docs: DataFrame, id: str, text: str, size: int, threshold: int, extra: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``extra``, ``n_shingles``, ``digest``, ``root`` and
    ``component_id`` of every row. Rows of one component have one root, a digest; it is null
    for rows that have no shingles."""
    marked = written(arrow.map_texts(
        docs, [F.col(id).alias("doc_id"), *extra], F.col(text),
        [StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType()))],
        lambda column: signature_rows(column, size, ROWS, BANDS), 1 << 19,
    ))
    classes = written(
        marked.where("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
        .withColumn("node", F.xxhash64("digest"))
    )
    roots = candidates(classes.select("node", "bands"))
    members = written(classes.drop("bands", "copies").join(roots, "node").drop("node"))
    picked = members.select(F.col("first_id").alias("\x01id"), F.col("digest").alias("\x01digest"))
    if members.count() <= SMALL_LIST:
        picked = F.broadcast(picked)
    mine = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(picked, F.col("doc_id").eqNullSafe(F.col("\x01id")))
    sets = arrow.map_texts(
        mine, [F.col("\x01digest")], F.col("text"), [StructField("digest", BinaryType()), StructField("set", BinaryType())],
        lambda column: set_rows(column, size),
    ).where("digest = `\x01digest`").groupBy("digest").agg(F.first("set").alias("set"))
    dealt = sets.join(block_places(members), "digest")
    links = dealt.groupBy("task").applyInArrow(_compare(threshold), LINKS)
    joined = components(links)
    whole = joined.join(classes.select(F.col("digest").alias("node"), "first_id"), "node")
    least = whole.groupBy("root").agg(F.min("first_id").alias("least_id"))
    found = whole.join(least, "root").select(F.col("node").alias("digest"), "least_id", "root")
    # Most rows are alone; the table of those that are not stands on its own, so that the
    # join with a class of very many copies can be split.
    lookup = written(
        classes.select("digest", "first_id", "copies").join(found, "digest", "left").where("copies > 1 or least_id is not null")
        .select("digest", "root", F.coalesce("least_id", "first_id").alias("component_id"), F.lit(True).alias("known"))
    )
    return marked.drop("bands").join(lookup, "digest", "left").select(
        *[c for c in marked.columns if c not in ("digest", "bands")], "digest", F.coalesce("root", "digest").alias("root"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )

def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """For every row its id, ``n_shingles`` and ``component_id``, the least id of the rows it
    is linked with, directly or through others.

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows with
    equal sets are one class and compared once, so exact copies, repeated rows and ties cost
    a grouped minimum. Rows without an id take part; a component of only such rows has a null
    id. No bucket, group or candidate list is cut off.
    """
    return _components(docs, id, text, size, threshold).select("doc_id", "n_shingles", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Components over 4-word shingles, by document."""
    return near_duplicates(docs, size=4).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: of its rows one with
    the least id, and of those the one whose text has the least hash; rows without an id come
    last. So one row of every component stays, whatever ids repeat. Rows without shingles are
    linked with nothing: they stay, but of such rows with equal id and text one does."""
    mark = F.xxhash64(F.col("text").cast("string")).alias("\x01mark")
    found = _components(docs.select("doc_id", "text"), "doc_id", "text", SHINGLE, THRESHOLD, (mark,))
    least = found.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "\x01mark")).alias("r")
    ).select("r.doc_id", "r.`\x01mark`")
    bare = found.where("root is null")
    picked = least.union(bare.where("doc_id is not null").select("doc_id", "\x01mark")).distinct().select(
        F.col("doc_id").alias("\x01id"), F.col("\x01mark").alias("\x01own")
    )
    same = F.col("doc_id").eqNullSafe(F.col("\x01id")) & (F.col("\x01mark") == F.col("\x01own"))
    once = docs.withColumn("\x01mark", mark).join(picked, same, "left_semi").dropDuplicates(["doc_id", "\x01mark"]).drop("\x01mark")
    wordless = docs.where("doc_id is null and not coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return once.unionByName(wordless).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (
    SELECT doc_id AS a, doc_id AS b FROM d
    UNION
    SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.component_id, d.doc_id = t.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) t ON t.a = d.doc_id
"""
