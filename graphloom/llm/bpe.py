"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its BPE
encoding. The encoder stores that *last token* for each prefix: appending a byte
adds one entry, cutting the text drops entries, and an edit re-computes entries
from the edit until the stored ones agree again. A token may follow another iff
BPE, run on the two joined, would split them at exactly that place; this is
decided by walking the merges that made the two tokens, latest first.

Spark reads the text once, without a shuffle: the encoder runs in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.plans.columns import quoted

#: Pieces remembered by a worker, and the longest remembered piece; longer or
#: later ones are encoded anew, so these bound memory and never change a result.
CACHE_PIECES = 600_000
CACHE_BYTES = 48
#: Lengths tried where no longer token fits.
SHORT = (3, 2, 1)
#: Lengths of the beginnings whose last tokens are remembered, longest first.
SHARED = (12, 9, 7, 5, 3)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 token, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Ranks prepared for the prefix encoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merge(token, rank) if len(token) > 1 else []
            if len(parts) == 2:
                self.split[rank] = (parts[0], parts[1])
                self.pairs[parts[0], parts[1]] = rank
            else:
                self.split[rank] = (rank, rank)
        #: Lengths, longest first, of the tokens that end in four given bytes.
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                ends.setdefault(token[-4:], {1, 2, 3}).add(len(token))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.cache: dict[str, tuple[str, bytes, int]] = {}
        self.judged: dict[int, bool] = {}
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain BPE that uses only ranks under ``below``; for the tables."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE keeps the boundary between two adjacent tokens."""
        pairs, split = self.pairs, self.split
        limit = 1 << 62
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ranks, lengths, follow, seen, judged = self.ranks.get, self.lengths, self.may_follow, self.seen, self.judged.get
        last = [-1]
        for n in SHARED:  # what is stored for a beginning holds for all its continuations
            if n < len(data) and (hit := seen.get(data[:n])) is not None:
                last = list(hit)
                break
        for end in range(len(last), len(data) + 1):
            for n in lengths.get(data[end - 4 : end], SHORT) if end > 3 else SHORT:
                if n <= end:
                    t = ranks(data[end - n : end])
                    if t is not None:
                        if n == end:
                            break
                        pair = last[end - n] << 32 | t
                        if (fits := judged(pair)) is None:
                            if len(self.judged) >= CACHE_PIECES:
                                self.judged.clear()
                            fits = self.judged[pair] = follow(last[end - n], t)
                        if fits:
                            break
            else:
                raise ValueError("no token of the vocabulary ends this prefix")
            last.append(t)
            if end in SHARED:
                if len(seen) >= CACHE_PIECES:
                    seen.clear()
                seen[data[:end]] = tuple(last)
        out, end = [], len(data)
        while end:
            t = last[end]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.find(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, sha256 of the ids, sha256 of the decoded bytes)."""
        ids, decoded, n, gap = hashlib.sha256(), hashlib.sha256(), 0, b""
        pieces = self.find(text)
        known, learn = self.cache.get, self.learn
        for at in range(0, len(pieces), 65_536):
            got = [known(p) or learn(p) for p in pieces[at : at + 65_536]]
            ids.update(gap + " ".join([x[0] for x in got]).encode())
            decoded.update(b"".join([x[1] for x in got]))
            n += sum([x[2] for x in got])
            gap = b" "
        return n, ids.hexdigest(), decoded.hexdigest()

    def learn(self, piece: str) -> tuple[str, bytes, int]:
        """A piece's ids as text, what these ids decode to, and how many they are."""
        ids = self.encode_piece(piece.encode())
        made = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        if len(piece) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = made
        return made


class Prefixes:
    """An encoding that can be appended to, cut and edited."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec = codec
        self.data = bytearray()
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        data = bytes(self.data) if start == 0 else bytes(self.data[max(0, start - self.codec.longest) :])
        shift = len(self.data) - len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._at(data, end, shift))

    def _at(self, data: bytes, end: int, shift: int) -> int:
        c = self.codec
        for n in range(min(end, c.longest), 0, -1):
            t = c.ranks.get(data[end - shift - n : end - shift])
            if t is not None and (n == end or c.may_follow(self.last[end - n], t)):
                return t
        raise ValueError(f"no token ends prefix {end}")

    def cut(self, length: int) -> None:
        del self.data[length:]
        del self.last[length + 1 :]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; returns how many entries were computed anew."""
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        self.cut(start)
        self.append(new)
        done, same = len(new), 0
        for i in range(len(tail)):
            if same >= self.codec.longest and i >= self.codec.longest:
                self.data += tail[i:]
                self.last += old[i:]
                break
            self.append(tail[i : i + 1])
            done += 1
            same = same + 1 if self.last[-1] == old[i] else 0
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.codec.tokens[t])
        return out[::-1]


#: One codec for each vocabulary a worker has met.
_CODECS: dict[str, Codec] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``ids`` are those of each pattern match encoded separately, without special
    tokens. Null texts count as empty: 0 tokens and the digests of no bytes.
    Repeated rows are kept. A clashing column of ``docs`` named like a result is
    replaced. The rank file (its size is the vocabulary's) is read on the driver
    and sent once to each executor.
    """
    table = read_ranks(ranks_path)
    named = hashlib.sha256(repr((pattern, sorted(table.items()))).encode()).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast((table, pattern))
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = [f for f in docs.schema.fields if f.name not in made]
    # Arrow functions take no column whose name has a dot
    plain = docs.select(*quoted(f.name for f in keep)).toDF(*[f"c{i}" for i in range(len(keep))])
    at = [f.name for f in keep].index(text)
    schema = T.StructType([*plain.schema.fields, T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in made[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            if codec is None:
                codec = _CODECS.get(named) or _CODECS.setdefault(named, Codec(*ranks.value))
            got = [codec.digest(t or "") for t in b.column(at).to_pylist()]
            n, ids, dec = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())],
                names=[*b.schema.names, *made],
            )

    return plain.mapInArrow(run, schema).toDF(*[f.name for f in keep], *made)
