"""URL rules held in a sorted array of digests.

Every rule ``(host, path)`` is one 64-bit xxhash key. The sorted keys go to one
file that Spark hands to each executor once and that all its Python workers
memory-map; a URL probes it with one key for each (host suffix, path prefix
length in use), by vectorised binary search over an Arrow batch, and each hit is
confirmed against the stored rule text, so a collision of digests never decides.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.columns import quoted

#: The largest rule array that is sent to executors as a file.
MAX_ARRAY_BYTES = 512 << 20
_HANDED_OUT: set[tuple[str, str]] = set()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty if it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode())


class DigestArray:
    """Sorted keys, memory-mapped, with the full strings behind them."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, lengths = data[:16].view(np.int64)
        ends = np.cumsum([16, 8 * n, 8 * (n + 1), 8 * lengths])
        self.keys, self.starts, self.lengths = (data[a:b].view(t) for a, b, t in zip(ends, ends[1:], (np.uint64, np.int64, np.int64), strict=False))
        self.text = data[ends[-1] :]

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """The file of a rule set: sizes, keys, starts of the strings, path lengths, strings."""
        rows: dict[str, str] = {}
        for host, path, verdict in rules:
            rows[f"{host}\0{path}"] = verdict
        made = sorted((digest(k), k, v) for k, v in rows.items())
        blobs = [f"{v}\0{k}".encode() for _, k, v in made]
        total = sum(map(len, blobs)) + 16 * len(blobs)
        if total > MAX_ARRAY_BYTES:
            raise ValueError(f"{total} bytes of rules; judge_by_join() takes rule tables of any size")
        lengths = np.array(sorted({len(k.partition("\0")[2]) for k in rows}), np.int64)
        keys, starts = np.array([x[0] for x in made], np.uint64), np.cumsum([0, *map(len, blobs)]).astype(np.int64)
        return b"".join((np.array([len(keys), len(lengths)], np.int64).tobytes(), keys.tobytes(), starts.tobytes(), lengths.tobytes(), *blobs))

    @staticmethod
    def hand_out(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
        """Give every executor the file of the rules, once for a session; its name there."""
        data = DigestArray.build(rules)  # its size is checked there
        name = f"graphloom-rules-{xxhash.xxh128_hexdigest(data)}.bin"
        sc = spark.sparkContext
        if (sc.applicationId, name) not in _HANDED_OUT:
            path = os.path.join(tempfile.mkdtemp(prefix="graphloom-rules-"), name)  # on the driver, which serves it
            with open(path, "wb") as f:
                f.write(data)
            sc.addFile(path)
            _HANDED_OUT.add((sc.applicationId, name))
        return name

    def lookup(self, wanted: list[str]) -> list[str | None]:
        """The verdict stored for each full key, or None."""
        out: list[str | None] = [None] * len(wanted)
        if not len(self.keys) or not wanted:
            return out
        want = np.array([digest(w) for w in wanted], np.uint64)
        at = np.searchsorted(self.keys, want)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:
                verdict, key = bytes(self.text[self.starts[k] : self.starts[k + 1]]).decode().split("\0", 1)
                if key == wanted[i]:
                    out[i] = verdict
                    break
                k += 1
        return out


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Columns ``keep`` (all by default) plus host, path, rule and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; the longest ``host + path`` wins (then the longer host, then
    the lexically first). A URL that no rule fits has a null rule and the
    verdict of the method, ``default``: its key is not in the array. Null,
    empty and malformed URLs have empty host and path and fit no rule. Repeated
    rows stay; a clashing column of the input named like a result is replaced.
    """
    spark: SparkSession = pages.sparkSession
    name = DigestArray.hand_out(spark, rules)
    made = ("host", "path", "rule", "verdict")
    cols = [c for c in (keep or pages.columns) if c not in made]
    # Arrow functions take no column whose name has a dot
    src = pages.select(*quoted(cols), F.col(f"`{url}`")).toDF(*[f"c{i}" for i in range(len(cols))], "url")
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(c, T.StringType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            split = [parts(u) for u in b.column(len(cols)).to_pylist()]
            wanted: list[str] = []
            owner: list[tuple[int, str, str]] = []
            for i, (host, path) in enumerate(split):
                while host:
                    for n in array.lengths:
                        if n <= len(path):
                            wanted.append(f"{host}\0{path[:n]}")
                            owner.append((i, host, path[:n]))
                    host = host.partition(".")[2]
            best: dict[int, tuple] = {}
            for (i, host, path), verdict in zip(owner, array.lookup(wanted), strict=True):
                if verdict is not None:
                    rank = (-len(host) - len(path), -len(host), host + path, verdict)
                    best[i] = min(best.get(i, rank), rank)
            found = [best.get(i) for i in range(len(split))]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-1],
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([f[2] if f else None for f in found], pa.string()),
                    pa.array([f[3] if f else default for f in found], pa.string()),
                ],
                names=schema.names,
            )

    return src.mapInArrow(run, schema).toDF(*cols, *made)


def judge_by_join(pages: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """The same verdicts for a rule table of any size, by a shuffle join on the digest.

    ``key`` identifies a page row; returns it with rule and verdict.
    """
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    labels = F.split("h", r"\.")
    n = rules.select(F.length("path").alias("n")).distinct()
    probes = (
        pages.select(F.col(key).alias("k"), host.alias("h"), path.alias("p"))
        .where("h <> ''")
        .select("k", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
        .join(n, F.expr("n <= length(p)"))
        .select("k", "host", F.expr("substring(p, 1, n)").alias("path"))
    )
    hit = probes.join(rules.select("host", "path", "verdict"), ["host", "path"])
    rank = F.struct((-F.length("host") - F.length("path")).alias("a"), (-F.length("host")).alias("b"), F.concat("host", "path").alias("rule"), "verdict")
    best = hit.groupBy("k").agg(F.min(rank).alias("r"))
    return (
        pages.select(F.col(key).alias("k")).join(best, "k", "left")
        .select(F.col("k").alias(key), F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
    )
