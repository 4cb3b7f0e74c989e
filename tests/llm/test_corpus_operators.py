"""The corpus operators against brute force, and on rows that are easy to get wrong."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, decontaminate, licenses, neardup, pii, queries, simhash, suffixes, toxicity, urls
from graphloom.plans.staging import Stage

RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, base int, key int, h long, node string, fp string"
LONG = "lorem ipsum dolor " * 9000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2, 3, "n", "f") for i, t in rows], DOCS)


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Two words"), (6, LONG), (7, "a" * 30_000), (8, "1 " * 6000), (8, "1 " * 6000), (9, "9" * 5000),
    (None, "no id at all, but a text of some words"), (10, "tie tie tie tie tie tie"), (11, "tie tie tie tie tie tie"), (12, "é漢😀 \u00a0 mixed ÀÉ\r\nlines"),
]
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# -- 2 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_is_that_of_the_library(codec, reference, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    r = random.Random(3)
    texts += ["".join(r.choice("aab  \n\té漢😀thein's<|endoftext|>019") for _ in range(r.randint(0, 90))) for _ in range(200)]
    texts += ["a" * 3000, " " * 500, "x" * 200 + "\n" * 50]
    for t in texts:
        ids = reference.encode_ordinary(t)
        assert codec.encode(t) == ids and codec.decode(ids) == t.encode()


def test_bpe_appends_and_edits(codec):
    r = random.Random(4)
    for _ in range(40):
        data = bytes(r.choice(b"aber then in ") for _ in range(60))
        p = bpe.Prefixes(codec, data[:20])
        p.append(data[20:])
        assert p.tokens() == bpe.Prefixes(codec, data).tokens()
        a = r.randrange(60)
        b = r.randrange(a, 60)
        new = bytes(r.choice(b"xyz th") for _ in range(r.randrange(9)))
        p.replace(a, b, new)
        assert p.tokens() == bpe.Prefixes(codec, data[:a] + new + data[b:]).tokens()
    p.cut(5)
    assert len(p.last) == 6


def test_bpe_rows(odd, none, reference):
    got = bpe.encode_documents(odd.withColumn("n_tokens", F.lit("clash")), RANKS, P.PATTERN)
    assert got.count() == len(ODD) and got.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        ids = reference.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
    assert bpe.encode_documents(none, RANKS, P.PATTERN).count() == 0


# -- 3 -------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i if i is not None else -1, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows(df, hot=suffixes.HOT):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, hot).collect())


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_suffix_dedup_is_brute_force(spark, hot):
    r = random.Random(5)
    bits = ["".join(r.choice("abc ") for _ in range(r.randint(30, 120))) for _ in range(12)]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 6))) + "".join(r.choice("abcdé ") for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (91, rows[3][1]), (92, "ab" * 400), (93, "ab" * 40), (5, "same id " + bits[0] + bits[1])]
    assert repeat_rows(docs(spark, rows), hot) == brute_repeats(rows)


def test_suffix_dedup_of_odd_rows(odd, none):
    assert repeat_rows(odd) == brute_repeats(ODD)
    assert suffixes.remove_repeats(none).count() == 0


def test_suffix_order_and_collisions(monkeypatch):
    r = np.random.default_rng(6)
    rows = r.integers(97, 99, (300, 12)).astype(np.uint8)
    lengths = r.integers(0, 13, 300)
    group = np.sort(r.integers(0, 9, 300))
    want = sorted(range(300), key=lambda i: (group[i], bytes(rows[i, : lengths[i]])))
    texts = [(group[i], bytes(rows[i, : lengths[i]])) for i in want]
    s = suffixes.Suffixes(rows, lengths)
    order, lcp = s.array(group)
    assert [(group[i], bytes(rows[i, : lengths[i]])) for i in order] == texts
    s = suffixes.Suffixes(rows, lengths)
    s.prefix[:] = 0  # every hash collides
    order, again = s.array(group)
    assert [(group[i], bytes(rows[i, : lengths[i]])) for i in order] == texts and (again == lcp).all()


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    data = bytes(random.Random(7).choice(b"abcd") for _ in range(5000))
    want = suffixes.anchors(np.frombuffer(data, np.uint8), np.array([0]), np.array([5000]))[0]
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    got = set()
    for _, buf, starts, ends, off in suffixes.chunks([data]):
        got |= set((suffixes.anchors(buf, starts, ends)[0] + off).tolist())
    assert got == set(want.tolist())


# -- 4 -------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, base)
    truth = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    hit = [r for r in rows if r.toxic == 1 and r.predicted == 1]
    assert len(hit) >= 0.5 * sum(r.toxic for r in rows) and not [r for r in rows if r.toxic == 0 and r.predicted == 1]
    assert got.count() == 1000
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_toxicity_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 1.0}, {"stupi": 0.8})
    plain, negated, told, aimed = (g.features(t)[0] for t in ("an idiot here", "he is not an idiot", "someone said idiot", "you are an idiot"))
    assert aimed > plain > told > negated > 0
    assert g.features("stupidest thing")[0] > 0 and g.features(None) == g.features("") == [0.0] * 5
    assert g.features("we will kill him")[0] > g.features("kill the lights")[0]
    # apostrophes, genitives, and targets on the right
    assert g.clauses("he isn\u2019t an idiot") == g.clauses("he isn't an idiot") == g.clauses("he is not an idiot")
    assert g.clauses("that idiot's friend") == g.clauses("that idiot") == [1.0]
    assert g.clauses("idiot, you are") == g.clauses("you are an idiot") == [1.3]
    assert g.clauses("an idiot. A friend! you") == [1.0] and g.clauses("") == []


def brute_clauses(text, lexicon):
    """The five rewritings one after the other, without machines."""
    out = []
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", clause)
        kinds = [("announce", toxicity.ANNOUNCERS), ("target", toxicity.TARGETS), ("neg", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("threat", toxicity.THREATS)]
        kind = lambda w: "insult" if w in lexicon else next((k for k in ("threat", "announce", "target", "neg", "report") if w in dict(kinds)[k]), "x")  # noqa: E731, B023
        syms, total = [kind(w) for w in words], 0.0
        near = lambda i, what, n: any(syms[j] == what for j in range(max(0, i - n), i))  # noqa: E731, B023
        for i, sym in enumerate(syms):
            if sym == "insult":
                if near(i, "neg", 3):
                    total += 0.25
                elif near(i, "report", 12):
                    total += 0.5
                else:
                    total += 1.3 if near(i, "target", 4) or "target" in syms[i + 1 : i + 4] else 1.0
        if total > 0:
            out.append(total)
    return out


def test_insults_are_brute_force():
    r = random.Random(9)
    words = ["idiot", "moron", "you", "him", "not", "never", "said", "wrote", "a", "house", "is", "the", "tree", "green", "."]
    g = toxicity.Grammar({"idiot": 1.0, "moron": 1.0}, {})
    for _ in range(3000):
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))
        if "not" in text and "said" in text or "never" in text and "wrote" in text:
            continue  # both marks at once weigh nothing or as the first, see WEIGHTS
        assert g.clauses(text) == pytest.approx(brute_clauses(text, {"idiot", "moron"})), text


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(12)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    for train in (labels, labels.where("false")):
        model = toxicity.fit(odd, train)
        got = toxicity.score_documents(odd, model)
        assert got.count() == len(ODD) and got.where("score between 0 and 1").count() == len(ODD)
        assert toxicity.score_documents(none, model).count() == 0


# -- 5 -------------------------------------------------------------------------


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_simhash(rows, k):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, f"{fps[i]:016x}", least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("run", [1024, 4])
def test_simhash_is_brute_force(spark, small, run, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", run)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [x for x in ODD if x[0] is not None]
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    for i in range(40):
        words = list(base)
        words[r.randrange(300)] = f"x{i}"
        rows.append((1000 + i, " ".join(words)))
    got = simhash.simhash_components(docs(spark, rows), 3).select("doc_id", simhash.to_hex().alias("x"), "component_id")
    assert sorted(tuple(x) for x in got.collect()) == brute_simhash(rows, 3)


def test_simhash_odd_rows(odd, none):
    got = simhash.simhash_components(odd, 3).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_components(none, 3).count() == 0


def test_near_copies_go(spark, none):
    r = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    text = " ".join(r.choice(words) for _ in range(300))
    other = " ".join(r.choice(words) for _ in range(300))
    near = text.replace(text.split()[100], "changed", 1)
    rows = [(5, text), (6, text), (7, near), (8, other), (9, None), (10, ""), (10, ""), (4, near), (None, text + " more and more words here"), (8, other)]
    got = neardup.drop_near_copies(docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(x.doc_id or -1 for x in got.collect()) == [-1, 4, 8, 9]
    assert neardup.drop_near_copies(none).count() == 0


def test_near_copies_with_a_block_more_or_less_go(spark):
    r = random.Random(12)
    rows = []
    for i in range(40):
        n = (40, 100, 400, 1500)[i % 4]
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        more = [f"x{r.randrange(10**6)}" for _ in range(int(n * 0.22))]
        less = n - int((n - 4) * 0.19)
        rows += [(10 * i, words), (10 * i + 1, words + more), (10 * i + 2, more + words), (10 * i + 3, words[:less]), (10 * i + 4, words[n - less :])]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in rows}
    assert min(len(sets[i] & sets[i // 10 * 10]) / len(sets[i] | sets[i // 10 * 10]) for i, _ in rows) >= 0.8
    got = neardup.drop_near_copies(docs(spark, [(i, " ".join(w)) for i, w in rows]))
    assert sorted(x.doc_id for x in got.collect()) == [10 * i for i in range(40)]


@pytest.mark.parametrize("run", [1024, 4])
def test_band_links_hold_long_runs(spark, run, monkeypatch):
    monkeypatch.setattr(neardup, "RUN", run)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(30)]
    assert [x.doc_id for x in neardup.drop_near_copies(docs(spark, rows)).collect()] == [0]


@pytest.mark.parametrize("block", [256, 3])
def test_copies_of_a_copy_of_the_root_go(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(13)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        for v in range(1, 12):
            words = list(base)
            at = 30 * v if g < 2 else r.randrange(370)
            words[at : at + 30] = [f"v{g}.{v}.{i}" for i in range(30)]
            rows.append((100 * g + v * 2, " ".join(words)))
        rows.append((100 * g + 3, " ".join(base)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = sorted(i for i in sets if not any(k < i and alike(i, k) for k in sets))
    assert want == [2, 102, 202] and not alike(2, 4)
    assert sorted(x.doc_id for x in neardup.drop_near_copies(docs(spark, rows)).collect()) == want


def some_sets(seed, sizes):
    """Pairs of shingle sets (a, b) of Jaccard similarity just 0.8 or above, one in the other or of like size."""
    r = np.random.default_rng(seed)
    for n in sizes:
        for a, b in ((4 * n, 5 * n), (9 * n, 9 * n)):
            both = 4 * n if a != b else 8 * n
            u = r.integers(-(2**63), 2**63 - 1, a + b - both)
            yield np.sort(u[:a]), np.sort(u[a - both :])


def test_simhash_blocks_propose_pairs_of_the_similarity():
    bits, blocks, far = neardup.plan(50_000, 0.8)
    assert (1 - neardup.agreement(0.8) ** bits) ** blocks <= neardup.MISS
    wide = neardup.width(bits, blocks)
    agree = []
    for a, b in some_sets(1, [1, 1, 1, 2, 3, 10, 40, 200, 1100] * 4):
        x, y = np.unpackbits(neardup.fingerprints([a, b], wide), axis=1)
        cosine = len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5
        agree.append((x == y).mean() - (1 - np.arccos(cosine) / np.pi))
        same = (x == y)[: bits * blocks].reshape(blocks, bits).all(axis=1)
        assert same.any() and (x != y)[:256].sum() <= far
    assert abs(np.mean(agree)) < 0.01
    other = [np.unpackbits(neardup.fingerprints([a, -a], wide), axis=1) for a, _ in some_sets(2, [5, 1000])]
    assert all(0.4 < (x == y).mean() < 0.6 for x, y in other)
    assert not neardup.fingerprints([np.zeros(0, np.int64)], wide).any()


@pytest.mark.parametrize("run", [1024, 4])
def test_block_links_are_brute_force(spark, run, monkeypatch):
    monkeypatch.setattr(neardup, "RUN", run)
    monkeypatch.setattr(neardup, "ROUND", 24)
    bits, blocks, far = 6, 50, 79
    sets = [x for pair in some_sets(3, [2, 4, 30] * 5) for x in pair] + [np.arange(30, dtype=np.int64) * 99 + (np.arange(30) == i) for i in range(25)]
    prints = neardup.fingerprints(sets, neardup.width(bits, blocks))
    flat = np.unpackbits(prints, axis=1)
    key = flat[:, : bits * blocks].reshape(len(sets), blocks, bits)
    want = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if (key[a] == key[b]).all(axis=1).any() and (flat[a, :256] != flat[b, :256]).sum() <= far:
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    reps = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(prints)], "rep long, bits binary")
    got = list(range(len(sets)))
    for a, b in neardup.block_links(reps, Stage(spark), bits, blocks, far).collect():
        got = [min(got[a], got[b]) if w in (got[a], got[b]) else w for w in got]
    assert got == want and len(set(want)) < len(sets) - 30


def test_forest_keeps_groups_with_few_links(monkeypatch):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 300, 5000), r.integers(0, 300, 5000)
    a, b = np.where(a % 3 == b % 3, a, b), b
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 500]), pa.array(b[i : i + 500])], names=["a", "b"]) for i in range(0, 5000, 500)]
    for nodes, most in ((10**6, 299), (100, 5000)):
        monkeypatch.setattr(neardup, "NODES", nodes)
        got = [x for t in neardup._forest(iter(batches)) for x in zip(*(c.to_pylist() for c in t.columns), strict=True)]
        assert len(got) <= most
        label, want = list(range(300)), list(range(300))
        for out, links in ((label, got), (want, zip(a.tolist(), b.tolist(), strict=True))):
            for x, y in links:
                out[:] = [min(out[x], out[y]) if w in (out[x], out[y]) else w for w in out]
        assert label == want


def test_near_copies_are_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for i, t in rows[:40]:
        w = t.split()
        rows.append((i + 5000, " ".join(w[: len(w) - len(w) // 6])))
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = sorted(i for i in sets if not any(j < i and like(sets[i], sets[j]) for j in sets))
    assert sorted(x.doc_id for x in neardup.drop_near_copies(docs(spark, rows)).collect()) == want


# -- 6 -------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    "a@b.c@d.e a@b.c_d@e.f.g", "1.2.3.4.5 001.002.003.255 256.1.1.1", "4111 1111 1111 1111  4111-1111-1111-1111- 41111111111111112345", "+1 (017) 555-7713) +12 +123456789 -",
    "é😀 a@b.co 4111111111111111 x", "x+1234567890 12@ @ @a.b", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1  +1+2 3456789012", "..a@..b a@b..c a@b.c. -@-.-",
]


def test_pii_rules_are_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(TRICKY)] + [x for x in ODD if x[0]]
    r = random.Random(10)
    rows += [(2000 + i, "".join(r.choice("0123459..--  +@ab()") for _ in range(120))) for i in range(150)]
    got = pii.find_pii(docs(spark, rows)).select("doc_id", "text", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.b == brute_base(x.text), x.text[:100]
        assert set(filter(None, x.b.split(","))) <= set(x.s.split(","))


def test_pii_method_adds_spans_and_redacts(spark, none):
    texts = ['the token = "4f0b3a6d9c1e8275aa0b3a6d9c1e8275aa0b3a6d" here', "write to jo.doe [at] example [dot] com now", "order 1234567812345678 of 2024-01-02", "mail a.b@example.com or +1 (212) 555-0100"]
    got = pii.find_pii(docs(spark, list(enumerate(texts)))).select("doc_id", pii.joined("spans").alias("s"), pii.redact(F.col("text"), "spans").alias("t")).orderBy("doc_id").collect()
    assert got[0].s.startswith("secret:") and "[SECRET]" in got[0].t
    assert got[1].s.startswith("email:") and got[2].s == "" and got[2].t == texts[2]
    assert got[3].t == "mail [EMAIL] or [PHONE]"
    assert pii.find_pii(none).count() == 0


def test_long_secrets_are_whole(spark):
    r = random.Random(15)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = {f'the token = "{hexa(600)}" here': "secret:13:613", f"see {hexa(129)} there": "secret:4:133", f"api_key={hexa(50_000)}": "secret:8:50008"}
    for text, want in texts.items():
        found = pii.candidates(F.col("text"))
        got = docs(spark, [(1, text)]).select(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])).alias("x")).first().x
        assert want in got and {x for x in got if x.startswith("secret")} == {want}
    whole = docs(spark, [(1, next(iter(texts)))])
    assert pii.find_pii(whole).select(pii.redact(F.col("text"), "spans").alias("t")).first().t == 'the token = "[SECRET]" here'


def test_email_domains_of_many_labels_are_whole(spark):
    texts = ["mail x@a" + ".b" * n + " now" for n in (500, 501, 502, 200_000)]
    got = pii.find_pii(docs(spark, list(enumerate(texts)))).select("doc_id", pii.joined("base").alias("b")).orderBy("doc_id").collect()
    assert [x.b for x in got] == [brute_base(x) for x in texts] and got[3].b == "email:5:400008"


# -- 7 -------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.array([(a, b, c) for a in side for b in side for c in side])
    keys = ann.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall_scores_and_ties(spark):
    base = "/root/testdata/sf0.01/embeddings.parquet"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(base).collect()]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [None] * 64), (2005, [1.0]), (None, rows[1][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, label int")
    got = ann.nearest(df).collect()
    good = {a: np.array(b, float) for a, b in rows if a is not None and a not in range(2000, 2006)}
    ids, x = np.array(sorted(good)), np.array([good[a] for a in sorted(good)])
    hits = total = 0
    for q in [a for a in good if a % 20 == 0]:
        s = x @ good[q]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1] for m in mine] == [v for _, v in sorted((-round(m[2], 12), m[1]) for m in mine)]
        assert all(abs(m[2] - float(good[m[1]] @ good[q])) < 1e-9 for m in mine)
        hits += len(set(want) & {m[1] for m in mine})
        total += 20
    assert hits / total >= 0.9
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.nearest(df.where("false")).count() == 0


def test_nearest_windows_have_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, node string")
    got = ann.nearest(df, every=50, rows=16).collect()  # 64 windows of 48 rows: 0.38 of the products
    x = x.astype(float)
    hits = 0
    for q in range(0, 8000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 160 * 20 and hits / len(got) > 0.6
    full = ann.nearest(df, every=50).collect()
    wanted = {q: set(np.argsort(-(x @ x[q]))[1:21]) for q in range(0, 8000, 50)}
    assert sum(r.vec_id in wanted[r.query_id] for r in full) / len(full) >= 0.9


# -- 8 -------------------------------------------------------------------------


def brute_leaks(rows, items):
    from collections import Counter

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, item in items:
        w = split(item)
        if not w or i is None:
            continue
        k = min(5, len(w))
        grams = lambda ws: [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)]
        a = Counter(grams(w))
        m = sum(a.values())
        for d, t in rows:
            g = grams(split(t))
            best = 0
            for s in range(1 - m, len(g)) if set(g) & set(a) else ():
                b = Counter(g[max(0, s) : s + m])
                both = sum((a & b).values())
                best = max(best, both / (m + sum(b.values()) - both))
            if best >= 0.8 and d is not None:
                out.add((d, i))
    return out


def test_leaks_are_brute_force(spark, small):
    r = random.Random(11)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for i in range(60):
        words = r.choice(items)[1].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "changed"
        if r.random() < 0.3:
            words = [w.upper() + "!" for w in words]
        rows.append((1000 + i, "before it " * r.randrange(4) + " ".join(words[r.randrange(3) :]) + " after" * r.randrange(3)))
    items += [(900, "two words"), (901, ""), (902, None), (None, "nothing at all")]
    rows += [(5000, "here are two words only"), *[x for x in ODD if x[0] and x[0] != 8]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == brute_leaks(rows, items) and len(got) > 20


def test_reordered_leaks_are_brute_force(spark):
    r = random.Random(14)
    items, rows = [], []
    for i in range(12):
        n = (40, 50, 60, 90)[i % 4]
        words = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        cut = n // 2 if i < 4 else r.randrange(5, n - 5)
        for d, moved in enumerate((words[cut:] + words[:cut], words[cut:] + words[2:cut], words[cut // 2 : cut] + words[: cut // 2] + words[cut:])):
            around = [f"o{r.randrange(10**6)}" for _ in range(60)]
            rows.append((10 * i + d, " ".join(around[: 30 * (d % 2)] + moved + around[30:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == brute_leaks(rows, items) and (10, 1) in got and len(got) > 12


def test_short_leaks_at_an_edge_are_brute_force(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(9))) for i in range(3000)]
    rows = [(i, " ".join(t.split()[1:])) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.similarity) for x in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == {(i, i, 0.8) for i in range(3000)}


def test_leaks_of_nothing(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.where("false")).count() == 0


# -- 9 -------------------------------------------------------------------------

URLS = [
    (1, "https://A.Example.ORG/es/x"), (2, "http://example.org/en/17"), (3, "http://badexample.org/es/"), (4, "https://x.com/fr/a?u=http://y.com/de/"), (5, "https://x.com/de/#a"),
    (6, None), (7, ""), (8, "no scheme"), (9, "http://example.org"), (10, "http://EXAMPLE.org?x://y"), (11, "http://org/"), (11, "http://org/"), (12, "://.org/a"), (13, "http://com./fr/"), (14, "http://" + "a." * 3000 + "com/de/x"),
]


def brute_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, verdict string")
    got = urls.judge_urls(df, queries.URL_RULES, keep=("page_id",)).collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [(i, *brute_url(u)) for i, u in URLS]
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    one = df.dropDuplicates(["page_id"])
    joined = {r.page_id: (r.rule, r.verdict) for r in urls.judge_by_join(one, rules, "page_id").collect()}
    assert joined == {i: brute_url(u)[2:] for i, u in URLS}
    assert urls.judge_urls(df.where("false"), queries.URL_RULES).count() == 0
    assert {r.rule for r in urls.judge_urls(df, ()).collect()} == {None}


def test_a_collision_never_decides(monkeypatch, tmp_path):
    monkeypatch.setattr(urls, "digest", lambda key: 7)
    made = tmp_path / "rules.bin"
    made.write_bytes(urls.DigestArray.build([("a", "/", "block"), ("b", "/", "allow")]))
    a = urls.DigestArray(str(made))
    assert a.lookup(["a\0/", "b\0/", "c\0/"]) == ["block", "allow", None]


# -- 10 ------------------------------------------------------------------------


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "go away"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (6, None, "user", "x"), (6, None, "user", "x"), (7, 0, "user", "x"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.pair_neighbours(df)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[0].chosen.startswith("<|im_start|>assistant\nhello<|im_end|>")
    a, b = map(int, got[0].chosen_mask.split(":"))
    assert got[0].chosen[a:b] == "hello<|im_end|>\n" and got[0].rejected_mask
    assert got[1].chosen == got[1].rejected == "" and got[1].n_prompt_turns == 1
    assert got[2].rejected is None and got[2].rejected_conv is None and got[2].chosen == "<|im_start|>user\n<|im_end|>\n"
    assert got[3].n_prompt_turns == 1 and got[3].chosen != "" and got[3].rejected == ""
    assert chat.format_preferences(chat.pair_neighbours(df.where("false"))).count() == 0


# -- 1 -------------------------------------------------------------------------


def test_licences(spark, odd, none):
    texts = [
        "some words\nThis work is licensed under the GNU General Public License, version 3.", "x\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
        "You need a driving license to rent a car.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "nothing", "his license plate and copyright law", "Copyright 2020. All rights reserved.",
    ]
    got = [r.families for r in licenses.scan_documents(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["gpl", "cc-by-nc,mit", "apache", "", "mit", "", "", "proprietary"]
    # sentences that neither training nor calibration holds, some wrapped as in a file's head
    other = [
        ("mit", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated files, to deal\nin the Software without restriction, including the rights to use it."),
        ("gpl", " * This program is free software: you can redistribute it and/or\n * modify it under the terms of the GNU General Public License as\n * published by the Free Software Foundation, either version 3 or later."),
        ("apache", "Our tool is licensed under the Apache License, Version 2.0, and so is its manual."),
        ("bsd", "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted."),
        ("agpl", "The server is licensed under the GNU Affero General Public License version 3."),
        ("epl", "The modules are made available under the terms of the Eclipse Public License v2.0"),
        ("isc", "Everything here is released under the ISC license, as ever."),
        ("unlicense", "This is free and unencumbered software released into the public domain."),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
        ("", "The eclipse was visible under the open sky, and the public was free to watch."),
        ("", "Terms of the lease: the software shop pays the general costs."),
        ("", "The commons were licensed to graze sheep, by attribution of the bishop."),
        ("", "He is licensed under Norwegian law to fish, version of the story two."),
    ]
    got = {r.doc_id: r.families for r in licenses.scan_documents(docs(spark, [(i, t) for i, (_, t) in enumerate(other)])).collect()}
    assert [got[i] for i in range(len(other))] == [f for f, _ in other]
    clash = docs(spark, [(1, texts[0])]).withColumn("gram", F.lit("x")).withColumn("w0", F.lit(2.0)).withColumn("a.b", F.lit(1))
    assert [r.families for r in licenses.scan_documents(clash).collect()] == ["gpl"]
    rows = licenses.scan_documents(odd).collect()
    assert len(rows) == len(ODD) and not any(r.families for r in rows)
    assert licenses.scan_documents(none).count() == 0


def test_native_plans_run_no_python(spark, small):
    for name in ("op1_licenses", "op6_pii", "op8_decontamination"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_queries_return_what_their_contracts_name(spark, small):
    want = {
        "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op7_nearest": ["query_id", "rank", "vec_id", "score"],
        "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, small).columns == columns
    assert json.dumps(sorted(queries.QUERIES))
