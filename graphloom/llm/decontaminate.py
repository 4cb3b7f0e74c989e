"""Benchmark decontamination in Catalyst expressions only.

Item-sized windows of a document are laid at every start that holds enough places
where its word shingles are shingles of the item, in whatever order: a window of
enough similarity shares that many, so no other window can qualify. The
exact weighted-shingle similarity, sum of smaller over sum of larger
multiplicities, decides every one of these; so few are left that a fingerprint
before it would only lose some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of all items that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str, k: int) -> Column:
    """64-bit hashes of the ``k``-word shingles, in order, repeats included."""
    at = lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<bigint>"))


def _starts(one: str, size: Column, similarity: float) -> Column:
    """Window starts that the shared places leave possible.

    Every window with a shared place is tried. It must hold enough shared places
    for its own length, which is shorter at a document's edge; their order is free.
    """
    m, seen = F.col(one)["m"], F.col(one)["seen"]
    near = F.array_distinct(F.flatten(F.transform(seen, lambda p: F.sequence(p - m + 1, p))))

    def possible(s: Column) -> Column:
        inside = F.size(F.filter(seen, lambda p: (p >= s) & (p < s + m)))
        length = F.least(s + m, size) - F.greatest(s, F.lit(0))
        return (length > 0) & (inside * (1 + similarity) >= similarity * (length + m) - 1e-9)

    return F.filter(near, possible)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger multiplicities of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(key, item_id, start, n_words, similarity)``: the best window of each pair.

    ``start`` counts words from 0; windows at a document's edge are cut there.
    Ties go to the first window. Null and empty texts have no window; items
    without words match nothing; items shorter than a shingle are compared as one
    shingle of their length. Rows of equal key count as one document, rows of
    equal item_id are each compared. A null key or item_id names no pair. Extra
    columns are ignored.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0").distinct()
    items = items.withColumn("k", F.least(F.size("w"), F.lit(shingle)))
    known = {r.k: r.n for r in items.groupBy("k").agg(F.sum(F.size("w")).alias("n")).collect()}  # at most ``shingle`` rows
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), words_of(F.col(text)).alias("w"))
    spread = F.broadcast if sum(known.values()) <= MAX_BROADCAST else (lambda x: x)
    found = None
    for k in sorted(known) or [shingle]:
        own = items.where(F.col("k") == k).select("item_id", shingles_of("w", k).alias("ih"))
        index = own.select("item_id", F.size("ih").alias("m"), F.explode(F.array_distinct("ih")).alias("h"))
        spots = source.select("key", F.posexplode(shingles_of("w", k)).alias("pos", "h"))
        # similarity s needs s * m of the item's m shingles: fewer shared ones can't do
        pairs = (
            spots.join(spread(index), "h")
            .groupBy("key", "item_id", "m")
            .agg(F.collect_set("pos").alias("seen"))
            .where(F.size("seen") >= F.col("m") * similarity - 1e-9)
        )
        wanted = pairs.groupBy("key").agg(F.collect_list(F.struct("item_id", "m", "seen")).alias("wanted"))
        lo, hi = F.greatest("at", F.lit(0)), F.least(F.col("at") + F.col("m"), F.size("hs"))
        windows = (
            source.join(wanted, "key")
            .select("key", shingles_of("w", k).alias("hs"), "wanted")
            .select("key", "hs", F.explode("wanted").alias("one"))
            .select("key", "hs", "one.item_id", "one.m", F.explode(_starts("one", F.size("hs"), similarity)).alias("at"))
            .select("key", "item_id", lo.alias("start"), F.slice("hs", lo + 1, hi - lo).alias("win"), F.lit(k).alias("k"))
            .dropDuplicates(["key", "item_id", "start", "win"])
        )
        close = (
            windows.join(spread(own), "item_id")
            # as aggregates the arrays keep the costly test above the join
            .groupBy("key", "item_id", "start", "k", F.xxhash64("win").alias("wk"), F.xxhash64("ih").alias("ik"))
            .agg(F.first("win").alias("win"), F.first("ih").alias("ih"))
            .withColumn("similarity", weighted_similarity(F.col("win"), F.col("ih")))
            .where(F.col("similarity") >= similarity)
        )
        part = close.select("key", "item_id", "start", (F.size("win") + F.col("k") - 1).alias("n_words"), "similarity")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"), "n_words")).alias("best")
    return found.groupBy("key", "item_id").agg(best).select(
        F.col("key").alias(key),
        "item_id",
        (-F.col("best.first")).cast("long").alias("start"),
        F.col("best.n_words").cast("long").alias("n_words"),
        F.col("best.similarity").alias("similarity"),
    )
