"""Dropping near copies: SimHash blocks propose, exact shingle similarity decides.

A document's fingerprint is the SimHash of its distinct word shingles, wide
enough for ``blocks`` blocks of ``bits`` bits. Sets of Jaccard similarity s have a
cosine of 2s / (1 + s) or more, wherever they differ, so a bit agrees with the
probability ``agreement(s)`` or more, and ``plan`` takes as many blocks as leave a
pair without an equal one with the probability ``MISS``. Rows of an equal block are
linked where the first 256 bits of their fingerprints are near. The members of each
group of linked documents are compared with its smallest id first, which settles
large groups of near copies in one comparison a member. What is left of a group is
compared with all its members in blocks: each pair of blocks is one task that holds
both, counts shared shingles as a product of incidence matrices and returns the
members left that are near copies of an earlier one; pairs are never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.simhash import _with_end
from graphloom.operators.components import connected_components
from graphloom.plans.columns import fresh, quoted
from graphloom.plans.staging import Stage

SHINGLE, SIMILARITY = 5, 0.8
#: Members of a block, and shingles of one incidence matrix.
BLOCK, COLUMNS = 256, 20_000
#: Probability that a pair of just the similarity has no equal block.
MISS = 1e-9
#: A block has 12 bits, or as many as leave a value at most 256 unrelated rows.
LEAST_BITS, SHARE = 12, 8
#: Blocks whose rows lie on disk at a time.
ROUND = 48
#: Rows of one block value that a single comparison takes; longer ones are sliced.
RUN = 1024
#: Long block values that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST = 20_000
#: Nodes of the links that a task remembers.
NODES = 1_000_000
#: Fingerprints made at a time, and shingles of one that are counted at a time.
TOGETHER, CHUNK = 32, 4096
SKETCH = ("s0", "s1", "s2", "s3")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def agreement(similarity: float) -> float:
    """The least probability with which a bit agrees at this Jaccard similarity."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def plan(n: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a block, number of blocks, and bits of 256 that differ at most, for ``n`` rows.

    The radius is seven standard deviations beyond the mean of the similarity.
    """
    p = agreement(similarity)
    bits = min(32, max(LEAST_BITS, max(n - 1, 0).bit_length() - SHARE))
    blocks = max(1, math.ceil(math.log(MISS) / math.log1p(-min(p**bits, 1 - MISS))))
    return bits, blocks, math.ceil(256 * (1 - p) + 7 * math.sqrt(256 * p * (1 - p)))


def width(bits: int, blocks: int) -> int:
    """Bits of a fingerprint: whole words that hold the blocks and the sketch."""
    return max(256, -(-bits * blocks // 64) * 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _weights(spots: int) -> np.ndarray:
    """(spots, 128, 8) whole numbers, each near normal: the weights of eight bits for a value of seven."""
    seed = _mixed(np.arange(1, spots * 1024 + 1, dtype=np.uint64) * _GOLDEN)
    return ((seed.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64) - 1020) // 8).astype(np.float32).reshape(spots, 128, 8)


def fingerprints(sets: list[np.ndarray], width: int) -> np.ndarray:
    """SimHash of shingle sets, ``width`` bits packed in bytes a row; an empty set gives zeros.

    A bit is set if the sum of its weights over the shingles is over zero. Each
    byte of a shingle's hash, one of ``width / 8``, gives it the weights of eight
    bits: seven bits name them, one is their sign. So unrelated sets have no
    direction in common, and sums are whole numbers that no order changes.
    """
    spots = width // 8
    steps = np.arange(1, width // 64 + 1, dtype=np.uint64) * _GOLDEN
    first = np.arange(spots, dtype=np.int64) * 256
    out = np.zeros((len(sets), spots), np.uint8)
    for at in range(0, len(sets), TOGETHER):
        some = sets[at : at + TOGETHER]
        # every sum of weights up to 128 is below 2**24, so float32 holds it
        kind = np.float32 if max(map(len, some)) < 1 << 17 else np.float64
        counts = np.zeros((spots, len(some), 128), kind)
        for i, one in enumerate(some):
            seen = np.zeros(spots * 256, np.int64)
            for a in range(0, len(one), CHUNK):
                h = _mixed(one[a : a + CHUNK].view(np.uint64)[:, None] + steps[None, :])
                seen += np.bincount((h.view(np.uint8) + first).ravel(), minlength=spots * 256)
            seen = seen.reshape(spots, 2, 128)
            counts[:, i] = seen[:, 0] - seen[:, 1]
        sums = np.matmul(counts, _weights(spots).astype(kind, copy=False))
        # neighbouring bits are of different bytes
        out[at : at + len(some)] = np.packbits((sums > 0).transpose(1, 2, 0).reshape(len(some), -1), axis=1)
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct word shingles; fewer words are one shingle, none is empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    k = min(SHINGLE, len(words))
    made = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in made), np.uint64).view(np.int64))


def _sha(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or "" for t in b.column(1)]
        sha = pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary())
        made = [x.tobytes() for at in range(0, len(texts), TOGETHER) for x in fingerprints([shingle_set(t) for t in texts[at : at + TOGETHER]], width)]
        fp = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in made], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), sha, fp, pa.array(made, pa.binary())], names=["doc_id", "sha", "fp", "bits"])


def _keyed(batches: Iterator[pa.RecordBatch], bits: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint and each of its blocks from ``start`` to before ``stop``."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            packed = np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.uint8).reshape(b.num_rows, -1)
            blocks = np.unpackbits(packed, axis=1)[:, bits * start : bits * stop].reshape(b.num_rows, stop - start, bits)
            key = (blocks @ powers) | (np.arange(start, stop, dtype=np.int64) << 32)
            words = np.ascontiguousarray(packed[:, :32]).view(np.int64)
            cols = [key.ravel(), *(np.repeat(x, stop - start) for x in (b.column(0).to_numpy(), *words.T))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rep", *SKETCH])


def _span(sketch: np.ndarray, side: np.ndarray | None, far: int) -> np.ndarray:
    """For each row the position of a row of its group; equal iff linked within these rows."""
    bits = np.zeros((len(sketch), len(sketch)), np.uint16)
    for word in sketch.T:
        bits += np.bitwise_count(word[:, None] ^ word[None, :])
    near = bits <= far
    if side is not None:
        near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, True)
    label = np.arange(len(sketch), dtype=np.int32)
    if np.count_nonzero(near) == len(label):
        return label
    while True:
        new = np.where(near, label[None, :], np.int32(len(sketch))).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """Links between rows of equal (key, part); the input is sorted by these."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for b in _with_end(batches):
        if b is not None:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        elif rest is None:
            return
        else:
            cols = rest
        key, part, side, rep = cols[:4]
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1])
        ends = np.concatenate([starts[1:], [len(key)]])
        if b is not None:  # the last run may go on in the next batch
            rest = [c[starts[-1] :] for c in cols]
            starts, ends = starts[:-1], ends[:-1]
        sketch = np.stack([c.view(np.uint64) for c in cols[4:]], axis=1)
        two = starts[ends - starts == 2]
        close = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64) <= far]
        if len(close):
            yield out(rep[close], rep[close + 1])
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            label = _span(sketch[s:e], side[s:e] if side[s] != side[e - 1] else None, far)
            own = np.flatnonzero(label != np.arange(e - s))
            if len(own):
                yield out(rep[s:e][own], rep[s:e][label[own]])
        if b is None:
            return


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only links that join what this task's earlier ones did not; after ``NODES`` nodes it starts anew."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        kept = []
        for i, (x, y) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(i)
        yield b.take(pa.array(kept, pa.int64()))
        if len(up) > NODES:
            up.clear()


def block_links(reps: DataFrame, stage: Stage, bits: int, blocks: int, far: int) -> DataFrame:
    """Distinct ``(rep, bits)`` to links ``(a, b)`` that span the near rows of each value of each block."""
    out = None
    for start in range(0, blocks, ROUND):
        stop = min(start + ROUND, blocks)
        schema = "key long, rep long, " + ", ".join(f"{x} long" for x in SKETCH)
        keyed = reps.select("rep", "bits").mapInArrow(lambda it, a=start, b=stop: _keyed(it, bits, a, b), schema)
        long = stage.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > RUN))
        n = long.count()
        if not n:
            dealt = keyed.select("key", F.lit(0).alias("part"), F.lit(0).alias("side"), "rep", *SKETCH)
        else:
            keyed = keyed.join(F.broadcast(long) if n <= MAX_BROADCAST else long, "key", "left")
            # slices of a long run: every pair of slices is one part, so no task holds the run
            slices = F.ceil(F.coalesce("size", F.lit(0)) / (RUN // 2)).cast("int")
            keyed = keyed.select("key", slices.alias("n"), "rep", *SKETCH).withColumn("side", F.when(F.col("n") > 0, F.pmod(F.xxhash64("rep"), F.col("n"))).otherwise(0).cast("int"))
            dealt = keyed.select("*", F.explode(F.expr("sequence(0, greatest(n - 1, 0))")).alias("other"))
            part = F.when(F.col("n") > 0, F.lit(1) + F.least("side", "other") * F.col("n") + F.greatest("side", "other")).otherwise(0)
            dealt = dealt.select("key", part.alias("part"), "side", "rep", *SKETCH)
        dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "side")
        links = stage.cut(dealt.mapInArrow(lambda it: _links(it, far), "a long, b long"))
        out = links if out is None else out.unionByName(links)
    return out.coalesce(max(1, reps.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_forest, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))], names=["node", "set"])


def _copies(t: pa.Table, similarity: float) -> pa.Table:
    """The nodes of the rows (node, open, set) that are open and like an earlier one that is not."""
    node, is_open = t.column("node").to_numpy(), t.column("open").to_numpy(zero_copy_only=False).astype(bool)
    x, y = np.flatnonzero(is_open), np.flatnonzero(~is_open)
    sets = t.column("set").combine_chunks()
    size = np.diff(np.asarray(sets.offsets))
    values, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(node)), size)
    common = np.zeros((len(x), len(y)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(node), min(COLUMNS, len(values) - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        common += m[x] @ m[y].T
    union = size[x][:, None] + size[y][None, :] - common
    # float32 counts are exact to 2**24 shingles
    alike = np.where(union == 0, 1.0, common / np.maximum(union, 1)) >= similarity
    alike &= node[y][None, :] < node[x][:, None]
    return pa.table({"node": node[x][alike.any(axis=1)]})


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, stage: Stage | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without copies and near copies.

    Of equal texts (null and empty are equal) the smallest doc_id stays, one row
    of it. Of the rest, a document goes if its shingle set has at least
    ``similarity`` (Jaccard) with that of an earlier document of its group, whether
    that one stays or not. Texts without words are copies of each other. If one
    doc_id has several texts, the other ones than that of the smallest hash only
    lose exact copies. A null doc_id takes part in the exact step only. Columns of
    any name stay as they are; an empty table gives no row.
    """
    stage = stage or Stage(docs.sparkSession)
    bits, blocks, far = plan(docs.count(), similarity)
    kept, wide = ["fp", "bits"], width(bits, blocks)
    schema = "doc_id long, sha binary, fp long, bits binary"
    rows = stage.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _prints(it, wide), schema))
    once = stage.cut(rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct(*kept)).alias("x")).select("sha", "doc_id", "x.*"))
    live = once.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sha", *kept)).alias("x"))
    live = stage.cut(live.select(F.col("doc_id").alias("node"), "x.*"))
    reps = stage.cut(live.groupBy("fp").agg(F.min(F.struct("node", "bits")).alias("x")).select("fp", F.col("x.node").alias("rep"), "x.bits"))
    equal = live.select("node", "fp").join(reps.select("fp", "rep"), "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    groups = stage.cut(connected_components(block_links(reps, stage, bits, blocks, far).unionByName(equal), stage))
    gone = None
    if not groups.isEmpty():
        wanted = groups.join(live, "node").select("node", "sha")
        texts = docs.select(F.col("doc_id").alias("node"), "text", _sha("text").alias("sha")).join(wanted, ["node", "sha"]).select("node", "text")
        sets = stage.cut(texts.dropDuplicates(["node"]).mapInArrow(_sets, "node long, set array<long>"))
        mine, theirs = sets.select("node", "set"), sets.select(F.col("node").alias("root"), F.col("set").alias("root_set"))
        both = F.size(F.array_intersect("set", "root_set"))
        alike = F.when(F.size("set") + F.size("root_set") == 0, 1.0).otherwise(both / (F.size("set") + F.size("root_set") - both))
        judged = groups.where("node <> root").join(mine, "node").join(theirs, "root").select("node", "root", (alike >= similarity).alias("copy"))
        judged = stage.cut(judged)
        sizes = judged.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("copy")).alias("left"))
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        block = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
        others = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        members = judged.join(sizes.where("size > 1 and left > 0"), "root").join(mine, "node")
        # the copies of the root are no longer open, but others may be copies of them
        opened = members.where("not copy").select("node", "root", "set", F.lit(True).alias("open"), block("left").alias("i"), others("size").alias("j"))
        earlier = members.select("node", "root", "set", F.lit(False).alias("open"), others("left").alias("i"), block("size").alias("j"))
        dealt = opened.unionByName(earlier)
        found = stage.cut(dealt.groupBy("root", "i", "j").applyInArrow(lambda t: _copies(t, similarity), "node long"))
        gone = judged.where("copy").select("node").unionByName(found).distinct()
    if gone is not None:
        bad = live_texts(once, gone)
        once = once.join(bad, ["doc_id", "sha"], "left_anti")
    sha, keep_id, keep_sha = fresh(docs, "sha", "keep", "keep_sha")
    keep = once.select(F.col("sha").alias(keep_sha), F.col("doc_id").alias(keep_id))
    out = docs.withColumn(sha, _sha("text"))
    out = out.join(keep, (F.col(sha) == F.col(keep_sha)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    if rows.groupBy("sha", "doc_id").count().where("count > 1").isEmpty():
        return out.select(*quoted(docs.columns))
    return out.dropDuplicates(["doc_id", sha]).select(*quoted(docs.columns))


def live_texts(once: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, sha) of the dropped nodes."""
    first = once.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("sha"))
    return first.join(gone.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
