"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming verification.

The 64 bits are cut into six blocks. Two fingerprints that differ in at most
three bits agree on at least three whole blocks, so every close pair shares one
of the twenty keys made of three blocks (about 32 bits each). Only distinct
fingerprints are linked, which folds all copies into one row before any key is
made. Rows of a key are compared in sorted runs of an Arrow batch; a run of any
length returns links that span it, never all its pairs, and a run longer than
``RUN`` is cut into slices whose pairs are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.components import connected_components
from graphloom.plans.staging import Stage

RADIUS = 3
#: Block edges over the 64 bits: five blocks of 11 bits and one of 9.
EDGES = (0, 11, 22, 33, 44, 55, 64)
#: Rows of one key that a single comparison takes; longer keys are sliced.
RUN = 1024
BATCH = 4096
WEIGHTS = (1 << np.arange(64, dtype=np.uint64))


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of word shingles: bit set if set in over half of their XXH64."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII space only
    k = words_per_shingle
    if not words:
        return 0
    if len(words) < k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))
    total, ones = 0, np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    while True:
        h = np.fromiter((hash64(s, 42) for s in islice(shingles, 65_536)), np.uint64)
        if not len(h):
            break
        total += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(WEIGHTS[ones * 2 > total].sum(dtype=np.uint64)) if total else 0


def fingerprints(docs: DataFrame, words_per_shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp long)``: the 64 bits as a signed long. A null text is empty."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words_per_shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def _keys() -> list:
    """The twenty (number, blocks) keys as columns over ``fp``."""
    out = []
    for n, blocks in enumerate(combinations(range(6), 3)):
        mask = sum(((1 << (EDGES[b + 1] - EDGES[b])) - 1) << EDGES[b] for b in blocks)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(n).cast("tinyint").alias("n"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return out


def _span(fp: np.ndarray, left: np.ndarray | None, radius: int) -> np.ndarray:
    """For each row the position of a row of its group; equal iff linked within these rows."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    if left is not None:
        near &= left[:, None] != left[None, :]
        np.fill_diagonal(near, True)
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between rows of equal (n, bits, part); the input is sorted by these."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for b in _with_end(batches):
        if b is not None:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        elif rest is None:
            return
        else:
            cols = rest
        n, bits, part, side, fp, rep = cols
        change = np.flatnonzero((n[1:] != n[:-1]) | (bits[1:] != bits[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(n)]])
        if b is not None:  # the last run may go on in the next batch
            cut = starts[-1]
            rest = [c[cut:] for c in cols]
            starts, ends = starts[:-1], ends[:-1]
        size = ends - starts
        u = fp.view(np.uint64)
        two = starts[size == 2]
        close = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
        if len(close):
            yield out(rep[close], rep[close + 1])
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            mixed = side[s:e] if side[s] != side[e - 1] else None
            label = _span(u[s:e], mixed, radius)
            own = np.flatnonzero(label != np.arange(e - s))
            if len(own):
                yield out(rep[s:e][own], rep[s:e][label[own]])
        if b is None:
            return


def _with_end(batches: Iterator) -> Iterator:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_links(reps: DataFrame, stage: Stage, radius: int = RADIUS) -> DataFrame:
    """Distinct ``(fp, rep)`` to links ``(a, b)`` between reps that span each close group.

    With a column ``t`` besides (a number), fingerprints of different ``t`` are
    different tables, and only those of one table are compared.

    Any two fingerprints within ``radius`` (at most 3) are linked, directly or
    through others of a shared key.
    """
    if radius > 3:
        raise ValueError("six blocks guarantee pairs within 3 bits")
    table = F.col("t") if "t" in reps.columns else F.lit(0)
    keyed = reps.select(F.explode(F.array(*_keys())).alias("k"), table.alias("t"), "fp", "rep")
    keyed = keyed.select((F.col("t") * 20 + F.col("k.n")).cast("smallint").alias("n"), "k.bits", "fp", "rep")
    sizes = keyed.groupBy("n", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = keyed.join(sizes, ["n", "bits"])
    small = keyed.where(F.col("size") <= RUN).select("n", "bits", F.lit(0).alias("part"), F.lit(0).alias("side"), "fp", "rep")
    # slices of a long key: every pair of slices is one part, so no task holds the key
    slices = F.ceil(F.col("size") / (RUN // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    big = (
        keyed.where(F.col("size") > RUN)
        .select("n", "bits", slices.alias("s"), mine.alias("side"), "fp", "rep")
        .select("n", "bits", "s", "side", "fp", "rep", F.explode(F.expr("sequence(0, s - 1)")).alias("other"))
        .select(
            "n",
            "bits",
            (F.lit(1) + F.least("side", "other") * F.col("s") + F.greatest("side", "other")).alias("part"),
            "side",
            "fp",
            "rep",
        )
    )
    dealt = small.unionByName(big).repartition("n", "bits", "part").sortWithinPartitions("n", "bits", "part", "side", "rep")
    return dealt.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def simhash_components(
    docs: DataFrame, words_per_shingle: int, stage: Stage | None = None, radius: int = RADIUS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links of at most
    ``radius`` bits, the row itself included. Rows of equal fingerprint (texts
    without words share fingerprint zero) are linked like any other. Null texts
    are empty. Repeated rows stay, rows with a null key take part without
    naming a component.
    """
    stage = stage or Stage(docs.sparkSession)
    fps = stage.cut(fingerprints(docs, words_per_shingle, key, text))
    reps = stage.cut(fps.groupBy("fp").agg(F.min(key).alias("rep")).where("rep is not null"))
    links = near_links(reps, stage, radius)
    roots = connected_components(links, stage).select(F.col("node").alias("rep"), "root")
    by_fp = reps.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select(key, "fp", "component_id")


def to_hex(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
