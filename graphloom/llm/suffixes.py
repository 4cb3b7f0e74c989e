"""Suffix-array dedup of byte strings that an earlier document has too.

Which of a document's 50-byte windows start in a document of smaller id is
decided at *anchors*. Every window owns the 20-byte gram of smallest hash in it,
so equal windows own equal grams, and anchors are one gram in sixteen. Grams of
one text only are dropped after one shuffle of hashes. For each other anchor the
80 bytes that its windows can span go to the gram's task. There the contexts of
a gram are suffix-sorted twice, forwards from the gram and backwards before it,
by a bottom-up mergesort whose comparisons find the common extension by binary
search over prefix polynomial hashes; neighbours are verified byte by byte. Runs
of the two suffix arrays name the equal windows, their smallest document id
decides, and a bit mask of covered windows returns to the document.

A gram in more than ``HOT`` texts is never gathered: its contexts are folded by
grouping, and only what is left of them goes on as single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.staging import Stage, small_batches

LENGTH, GRAM = 50, 20
WINDOWS = LENGTH - GRAM + 1  # windows that one gram can stand in
BEFORE, AFTER = LENGTH - GRAM, LENGTH
#: Texts of one gram that a task takes: about 16 MB of contexts.
HOT = 150_000
#: Bytes handled at once when grams are hashed; an anchor's place fits in 24 bits.
CHUNK = 1 << 20
PLACE = np.uint64((1 << 24) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = BASE ** np.arange(1, 3 + BEFORE + AFTER, dtype=np.uint64)[: 2 + BEFORE + AFTER]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of the 20 bytes from each position (16 and 4 by doubling)."""
    power, cur, four, mult4 = np.array([BASE]), buf.astype(np.uint64) + np.uint64(1), None, None
    size = 1
    while size < 16:
        cur = cur[:-size] * power + cur[size:]
        power = power * power
        size *= 2
        if size == 4:
            four, mult4 = cur, power
    n = len(buf) - GRAM + 1
    h = cur[:n] * mult4 + four[16 : 16 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, document) of the anchors of documents laid end to end."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(buf) < LENGTH:
        return none
    h = gram_hashes(buf)
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= WINDOWS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = WINDOWS - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    # windows that run over a document's end own nothing
    inside = np.zeros(len(low) + 1, np.int8)
    full = ends - starts >= LENGTH
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, np.minimum(ends[full] - LENGTH + 1, len(low)), -1)
    at = (low[np.cumsum(inside[:-1]) > 0] & PLACE).astype(np.int64)
    if not len(at):
        return none
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, h[at], np.searchsorted(ends, at, side="right")


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, starts, ends, offset): whole documents, or overlapping parts of a long one."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            for off in range(0, len(texts[i]) - LENGTH + 1, CHUNK):
                part = np.frombuffer(texts[i], np.uint8, min(CHUNK + LENGTH - 1, len(texts[i]) - off), off)
                yield i, part, np.array([0]), np.array([len(part)]), off
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and len(texts[j]) <= CHUNK and (j == i or total + len(texts[j]) <= CHUNK):
            total += len(texts[j])
            j += 1
        ends = np.cumsum([len(t) for t in texts[i:j]])
        yield i, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.r_[0, ends[:-1]], ends, 0
        i = j


def _bytes(col: pa.Array) -> list[bytes]:
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def _emit_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tid = b.column(0).to_numpy(zero_copy_only=False)
        for row, buf, starts, ends, _ in chunks(_bytes(b.column(1))):
            _, h, doc = anchors(buf, starts, ends)
            if len(h):
                o = np.lexsort((h, doc))  # repetition inside a document says nothing here
                h, doc = h[o], doc[o]
                once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                h, doc = h[once], doc[once]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tid[row + doc])], names=["h", "tid"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (h, tid) of hashes with two texts or more; the input is sorted by both."""
    last: tuple | None = None  # (h, tid, whether it has gone out already)
    for b in batches:
        if not b.num_rows:
            continue
        h, tid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if last is not None:
            h, tid = np.r_[last[0], h], np.r_[last[1], tid]
        new = np.r_[True, (h[1:] != h[:-1]) | (tid[1:] != tid[:-1])]
        gone = last is not None and last[2]
        h, tid = h[new], tid[new]
        run = np.cumsum(np.r_[0, h[1:] != h[:-1]])
        many = np.bincount(run) > 1
        if gone:
            many[0] = True
        out = many[run]
        last = (h[-1], tid[-1], bool(out[-1]))
        if gone:
            out[0] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(tid[out])], names=["h", "tid"])


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc_id, tid, text, hs): the contexts of the anchors whose hash is in ``hs``."""
    span = np.arange(-BEFORE, AFTER)
    mix = np.uint64(0xD6E8FEB86659FD93)
    for b in batches:
        ids, tid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        lists = b.column(3)
        sizes = np.array([len(x) if x.is_valid else 0 for x in lists])
        wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
        wanted = np.sort(wanted ^ (owner + np.uint64(1)) * mix)
        for row, buf, starts, ends, off in chunks(_bytes(b.column(2))):
            at, h, doc = anchors(buf, starts, ends)
            if not len(at) or not len(wanted):
                continue
            key = h ^ ((row + doc).astype(np.uint64) + np.uint64(1)) * mix
            hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            at, h, doc = at[hit], h[hit], doc[hit]
            left, right = np.minimum(at - starts[doc], BEFORE), np.minimum(ends[doc] - at, AFTER)
            n = len(at)
            ctx = np.zeros((n, 2 + len(span)), np.uint8)
            ctx[:, 0], ctx[:, 1] = left, right
            inside = (span >= -left[:, None]) & (span < right[:, None])
            ctx[:, 2:] = np.where(inside, buf[np.clip(at[:, None] + span, 0, len(buf) - 1)], 0)
            # equal contexts of a document are one row with all their places
            o = np.lexsort((ctx.astype(np.uint64) @ SPREAD, h, doc))
            ctx, h, doc, at = ctx[o], h[o], doc[o], at[o]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]).any(axis=1)] if n else np.zeros(0, bool)
            head = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.r_[head, n], pa.int32()), pa.array(at - starts[doc] + off))
            ctx, h, doc, n = ctx[head], h[head], doc[head], len(head)
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * ctx.shape[1], ctx.shape[1], dtype=np.int32)), pa.py_buffer(ctx.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), data, pa.array(ids[row + doc]), pa.array(tid[row + doc]), places],
                names=["h", "ctx", "doc", "tid", "pos"],
            )


class Suffixes:
    """Rows of bytes with lengths, compared by prefix polynomial hashes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.rows, self.lengths = rows, lengths.astype(np.int64)
        n, width = rows.shape
        self.width = width
        self.prefix = np.zeros((n, width + 1), np.uint64)
        for t in range(width):
            self.prefix[:, t + 1] = self.prefix[:, t] * BASE + rows[:, t] + np.uint64(1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search for each pair."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.lengths[a], self.lengths[b])
        for _ in range(int(self.width).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(a, b)
        end_a, end_b = e >= self.lengths[a], e >= self.lengths[b]
        at = np.minimum(e, self.width - 1)
        x, y = self.rows[a, at].astype(np.int64), self.rows[b, at].astype(np.int64)
        x, y = np.where(end_a, -1, x), np.where(end_b, -1, y)
        return (x < y) | (or_equal & (x == y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order within each stretch of equal ``group``: mergesort, all runs of a level at once."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, n])
        begin, stop = np.repeat(first, size), np.repeat(first + size, size)
        inner, width = np.arange(n) - begin, 1
        while width < size.max(initial=1):
            run = inner // width
            right = run % 2 == 1
            other = begin + np.where(right, run - 1, run + 1) * width
            lo = np.minimum(other, stop)
            hi = np.minimum(other + width, stop)
            base = lo.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                before = self.less(order[mid], order[live], right[live])
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
                live = live[lo[live] < hi[live]]
            start = begin + (run // 2) * 2 * width
            place = start + (np.arange(n) - (begin + run * width)) + (lo - base)
            new = np.empty_like(order)
            new[place] = order
            order = new
            width *= 2
        return order

    def verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Common prefix of each row with the one before, from the bytes; None if the order is wrong."""
        a, b = order[:-1], order[1:]
        most = np.minimum(self.lengths[a], self.lengths[b])
        differ = (self.rows[a] != self.rows[b]) | (np.arange(self.width) >= most[:, None])
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        ok = self.less_bytes(a, b, lcp)
        same = group[1:] == group[:-1]
        if not (ok | ~same).all():
            return None
        return np.r_[-1, np.where(same, lcp, -1)]

    def less_bytes(self, a, b, lcp):
        at = np.minimum(lcp, self.width - 1)
        x = np.where(lcp >= self.lengths[a], -1, self.rows[a, at].astype(np.int64))
        y = np.where(lcp >= self.lengths[b], -1, self.rows[b, at].astype(np.int64))
        return x <= y

    def array(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common prefixes with the row before; -1 where a group begins)."""
        order = self.sort(group)
        lcp = self.verified(order, group)
        if lcp is None:  # hashes collided: sort by the bytes themselves
            keys = [bytes(r[:n]) for r, n in zip(self.rows, self.lengths, strict=True)]
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], keys[i])), np.int64)
            lcp = self.verified(order, group)
        return order, lcp


def covered_windows(ctx: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For distinct contexts (sorted by group): a bit for each window that a smaller doc has too."""
    left, right = ctx[:, 0].astype(np.int64), ctx[:, 1].astype(np.int64)
    n = len(ctx)
    mask = np.zeros(n, np.int64)
    if n < 2:
        return mask
    ahead = Suffixes(np.ascontiguousarray(ctx[:, 2 + BEFORE :]), right)
    back = Suffixes(np.ascontiguousarray(ctx[:, 2 : 2 + BEFORE][:, ::-1]), left)
    (oa, la), (ob, lb) = ahead.array(group), back.array(group)
    ra, rb = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(WINDOWS):
        valid = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if len(valid) < 2:
            continue
        ra[oa] = np.cumsum(la < LENGTH - j)
        rb[ob] = np.cumsum(lb < j)
        key = ra[valid] * (n + 1) + rb[valid]
        o = np.argsort(key, kind="stable")
        k, d = key[o], doc[valid][o]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(k)]))
        mask[valid[o[d > least]]] |= 1 << j
    return mask


def _all_windows(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    j = np.arange(WINDOWS)
    fits = (left[:, None] >= j) & (right[:, None] >= LENGTH - j)
    return (fits * (1 << j)).sum(axis=1)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, doc, tid, pos) sorted by h, ctx, doc to (doc, tid, pos, mask)."""

    def done(h, ctx, doc, tid, pos):
        new = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]).any(axis=1)]
        which, head = np.cumsum(new) - 1, np.flatnonzero(new)
        group = np.cumsum(np.r_[0, h[head][1:] != h[head][:-1]])
        several = (np.bincount(group) > 1)[group]
        own = np.zeros(len(head), np.int64)
        own[several] = covered_windows(ctx[head][several], group[several], doc[head][several])
        full = _all_windows(ctx[:, 0].astype(np.int64), ctx[:, 1].astype(np.int64))
        mask = np.where(doc > doc[head][which], full, own[which])
        out = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(tid[out]), pos.filter(pa.array(out)), pa.array(mask[out])], names=["doc", "tid", "pos", "mask"])

    rest: list | None = None
    held: pa.Array | None = None
    width = 2 + BEFORE + AFTER
    for b in batches:
        if not b.num_rows:
            continue
        raw = b.column(1)
        flat = np.frombuffer(raw.buffers()[2], np.uint8)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        cols = [b.column(0).to_numpy(zero_copy_only=False), flat[offsets[0] : offsets[-1]].reshape(-1, width), *[b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]]
        places = b.column(4)
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            places = pa.concat_arrays([held, places])
        cut = np.searchsorted(cols[0], cols[0][-1])  # the last gram may go on
        rest, held = [c[cut:].copy() for c in cols], places.slice(cut)
        if cut:
            yield done(*[c[:cut] for c in cols], places.slice(0, cut))
    if rest is not None:
        yield done(*rest, held)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks, whole) to the digest columns."""
    for b in batches:
        out = []
        flat = b.column(2).flatten()
        places = pc.list_value_length(flat.field(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = flat.field(0).flatten().to_numpy(zero_copy_only=False)
        mask = np.repeat(flat.field(1).to_numpy(zero_copy_only=False), places)
        marks = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
        stop = np.r_[0, np.cumsum(places)][np.cumsum(marks)]
        start = np.r_[0, stop[:-1]]
        for i, (data, whole) in enumerate(zip(_bytes(b.column(1)), b.column(3).to_pylist(), strict=True)):
            spans = removed_spans(len(data), pos[start[i] : stop[i]], mask[start[i] : stop[i]], bool(whole))
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)))
        n, r, k, sha, spans = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def removed_spans(size: int, pos: np.ndarray, mask: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """Maximal runs of bytes under a covered window."""
    if whole:
        return [(0, size)] if size >= LENGTH else []
    if not len(pos):
        return []
    r, j = np.nonzero((mask[:, None] >> np.arange(WINDOWS)) & 1)
    start = np.unique(pos[r] - j)
    cut = np.flatnonzero(start[1:] > start[:-1] + LENGTH)
    return list(zip(start[np.r_[0, cut + 1]].tolist(), (start[np.r_[cut, len(start) - 1]] + LENGTH).tolist(), strict=True))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for every row.

    A byte goes if a 50-byte string over it also starts in a document of smaller
    doc_id. Null texts are empty. Rows of one doc_id are not smaller than each
    other. A row whose doc_id is null keeps all and takes nothing from others.
    Extra columns are ignored, whatever their names; an empty table gives none.
    The covered places are found at once, in Arrow batches small enough for long
    texts; the texts are cut when the result is read.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs, hot)


def _remove_repeats(docs: DataFrame, hot: int) -> DataFrame:
    spark = docs.sparkSession
    stage = Stage(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))
    known = docs.where("doc_id is not null")
    # exact copies: the smallest id stands for all, later ones go whole
    ids = known.select("doc_id", "tid", F.sha2("text", 256).alias("sha"))
    least = stage.cut(ids.groupBy("sha", "tid").agg(F.min("doc_id").alias("first")))
    copies = ids.join(least, ["sha", "tid"]).where("doc_id > first").select(F.col("doc_id").alias("doc"), "tid").distinct()

    grams = known.select("tid", "text").mapInArrow(_emit_grams, "h long, tid long")
    shared = stage.cut(grams.repartition("h").sortWithinPartitions("h", "tid").mapInArrow(_shared, "h long, tid long"))
    crowded = shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h")
    any_hot = not crowded.isEmpty()
    marks = None
    for is_hot in (False, True) if any_hot else (False,):
        mine = shared.join(crowded, "h", "left_semi" if is_hot else "left_anti") if any_hot else shared
        lists = mine.groupBy("tid").agg(F.collect_list("h").alias("hs"))  # as many as the text has anchors
        lists = lists.join(least, "tid").select(F.col("first").alias("doc_id"), "tid", "hs")
        rows = known.join(lists, ["doc_id", "tid"]).select("doc_id", "tid", "text", "hs")
        ctx = rows.mapInArrow(_emit_contexts, "h long, ctx binary, doc long, tid long, pos array<long>")
        if is_hot:
            part = stage.cut(_judge_hot(stage.cut(ctx)))
        else:
            part = stage.cut(ctx.repartition("h").sortWithinPartitions("h", "ctx", "doc").mapInArrow(_judge, "doc long, tid long, pos array<long>, mask long"))
        marks = part if marks is None else marks.unionByName(part)
    per_doc = marks.groupBy("doc", "tid").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"), F.lit(False).alias("whole"))
    whole = copies.select("doc", "tid", F.array().cast("array<struct<pos:array<bigint>,mask:bigint>>").alias("marks"), F.lit(True).alias("whole"))
    notes = per_doc.unionByName(whole)
    out = docs.join(notes, (docs["doc_id"] == notes["doc"]) & (docs["tid"] == notes["tid"]), "left")
    done = out.select("doc_id", "text", "marks", "whole").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    )
    return done


def _judge_hot(ctx: DataFrame) -> DataFrame:
    """What ``_judge`` does, by grouping only: contexts first, then single windows."""
    left, right = F.conv(F.hex(F.substring("ctx", 1, 1)), 16, 10).cast("int"), F.conv(F.hex(F.substring("ctx", 2, 1)), 16, 10).cast("int")
    first = ctx.groupBy("h", "ctx").agg(F.min("doc").alias("first"))
    both = ctx.join(first, ["h", "ctx"]).withColumn("l", left).withColumn("r", right)
    fits = lambda j: (F.col("l") >= j) & (F.col("r") >= LENGTH - j)
    whole = sum((F.when(fits(j), F.lit(1 << j)).otherwise(0) for j in range(WINDOWS)), F.lit(0).cast("long"))
    later = both.where("doc > first").select("doc", "tid", "pos", whole.alias("mask"))
    single = (
        both.where("doc = first")
        .select("doc", "tid", "pos", "ctx", "l", "r", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("j"))
        .where(fits(F.col("j")))
        .select("doc", "tid", "pos", "j", F.substring(F.col("ctx"), F.lit(3 + BEFORE) - F.col("j"), F.lit(LENGTH)).alias("win"))
    )
    least = single.groupBy("win").agg(F.min("doc").alias("least"))
    found = single.join(least, "win").where("doc > least").distinct()
    bits = found.groupBy("doc", "tid", "pos").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))).alias("mask"))
    return later.unionByName(bits)
