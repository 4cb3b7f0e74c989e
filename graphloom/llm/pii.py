"""Personal data: candidate spans judged by gradient-boosted trees, in Catalyst.

Rule spans (email, ip, card, phone) always stay. High-recall generators propose
further spans, which may overlap; boosted trees over format and context features
score each, and thresholds, one for each kind, select the redactions. The trees
are fitted on the driver from synthetic sentences whose features the same
expressions compute, and run as nested CASE expressions; the thresholds come from
sentence templates that the trees never saw.

Offsets come from two passes of one regular expression: the matches, and the
text split by them; running sums of their lengths place each match. No pattern
repeats a group without bound but possessively, which Java does in a loop, so long
texts can't exhaust its stack, and no pattern has an upper bound on a span.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.columns import fresh, quoted

KINDS = ("email", "ip", "card", "phone", "secret")
#: Share of true spans among the calibration rows at a kind's threshold or over it.
PRECISION = 0.98
ROUNDS, RATE = 40, 0.3
#: Characters before a span that its context features read.
CONTEXT = 24
#: Items of a block of a running sum; see ``running``.
BLOCK = 256

#: Base patterns. ``\G`` lets a match start where the last one ended, as it
#: would without the look-behind, which only saves retries inside a run.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = r"[0-9][0-9\x20-]{10,}+"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Generators: (kind, cheap test, pattern).
GENERATORS = (
    ("email", r"(?i)[\[(]at[\])]|\sdot\s", rf"(?i)(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[a-z0-9-]{{2,}}+)++"),
    ("phone", r"[0-9][0-9\x20().-]{7}", r"(?<![0-9A-Za-z.,+-])\(?[0-9](?:[\x20().-]*+[0-9]){7,}+(?![0-9A-Za-z])"),
    ("card", r"[0-9][0-9\x20-]{10}", r"(?<![0-9A-Za-z.,+-])[0-9](?:[\x20-]*+[0-9]){11,}+(?![0-9A-Za-z])"),
    ("secret", r"(?i)token|secret|passw|key|bearer", r"(?i)(?<=(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|bearer)[\"']{0,1}\x20{0,1}[=:]{1,2}\x20{0,1}[\"']{0,1})[a-z0-9+/_=-]{8,}+(?:\.[a-z0-9+/_=-]{8,}+)*+"),
    ("secret", r"[0-9a-fA-F]{32}", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"),
    ("secret", r"eyJ[A-Za-z0-9_-]{8}", r"(?<![0-9A-Za-z])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)

SPAN = "array<struct<s:int,e:int,t:string>>"


def running(values: Column, op) -> Column:
    """What ``op`` (associative, of ints from 0) makes of the values before each one.

    Blocks are summed first, then each from its start: growing arrays one by one
    costs the square of their length, this way that of a block and of their number.
    """

    def steps(items: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    count = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))
    starts = steps(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: op(acc, x))), F.lit(0))
    long = F.flatten(F.zip_with(blocks, starts, steps))
    return F.when(F.size(values) <= BLOCK, steps(values, F.lit(0))).otherwise(long)


def _placed(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, with each match: array of (o, p, at)."""
    others, parts = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(others, parts, lambda o, p: F.length(o) + F.coalesce(F.length(p), F.lit(0)))
    return F.arrays_zip(others.alias("o"), parts.alias("p"), running(sizes, lambda a, b: a + b).alias("at"))


def matches(text: Column, pattern: str) -> Column:
    """All matches with code point offsets: array of (s, e, t)."""

    def one(x: Column) -> Column:
        s = x["at"] + F.length(x["o"])
        return F.struct(s.alias("s"), (s + F.length(x["p"])).alias("e"), x["p"].alias("t"))

    return F.transform(F.filter(_placed(text, pattern), lambda x: x["p"].isNotNull()), one)


def pieces(text: Column, pattern: str) -> Column:
    """What stands between the matches, likewise."""
    return F.transform(_placed(text, pattern), lambda x: F.struct(x["at"].alias("s"), (x["at"] + F.length(x["o"])).alias("e"), x["o"].alias("t")))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string has a valid check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))


NAMED = "array<struct<kind:string,ord:int,s:int,e:int,t:string>>"


def _if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(NAMED))


def base_spans(text: Column) -> Column:
    """The rule spans, sorted by start, then kind."""
    email = _if(F.contains(text, F.lit("@")), _named("email", matches(text, EMAIL)))
    ip = _named("ip", F.filter(matches(text, IP), lambda x: x["t"].rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")))
    size = lambda x: F.length(_digits(x["t"]))
    phone = _named("phone", F.filter(matches(text, PHONE), lambda x: size(x).between(9, 15)))
    inner = lambda r: F.transform(
        pieces(r["t"], r"[\x20-]{2,}|[\x20-]\z"),
        lambda p: F.struct((p["s"] + r["s"]).alias("s"), (p["e"] + r["s"]).alias("e"), p["t"].alias("t")),
    )
    card = F.filter(F.flatten(F.transform(matches(text, RUN), inner)), lambda x: size(x).between(12, 19) & luhn(_digits(x["t"])))
    ip = _if(text.rlike(r"[0-9]\.[0-9]"), ip)
    phone = _if(text.rlike(r"\+[0-9]"), phone)
    card = _if(text.rlike(r"[0-9][0-9\x20-]{10}"), _named("card", card))
    return F.array_sort(F.concat(email, ip, card, phone), _order)


def _order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["s"], x["ord"], x["e"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def candidates(text: Column) -> Column:
    """All spans the generators propose, with the text around them."""
    every = F.concat(*[_if(text.rlike(test), _named(kind, matches(text, pattern))) for kind, test, pattern in GENERATORS])
    return F.transform(
        every,
        lambda x: F.struct(
            x["kind"], x["ord"], x["s"], x["e"], x["t"],
            F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))).alias("before"),
        ),
    )


def features(x: Column) -> list[Column]:
    """Format and context features of one candidate, as doubles."""
    t, before = x["t"], x["before"]
    digits = F.length(_digits(t))
    count = lambda p: F.length(F.regexp_replace(t, p, ""))
    out = [
        x["ord"],
        F.length(t),
        digits,
        count(r"[^A-Za-z]"),
        count(r"[^\x20().-]"),
        t.rlike(r"\A\(?[0-9]{2,5}\)?[\x20.-]").cast("int"),
        t.rlike(r"\A[0-9]{3,5}(?:[\x20-][0-9]{3,5}){2,4}\z").cast("int"),
        t.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}").cast("int"),
        t.rlike(r"\A[0-9a-fA-F]+\z").cast("int"),
        (t.rlike(r"[0-9]") & t.rlike(r"[A-Za-z]")).cast("int"),
        t.rlike(r"(?i)[\[(]at[\])]").cast("int"),
        t.rlike(r"(?i)(?:[\[(]dot[\])]|\x20dot\x20|\.)\x20?[a-z]{2,6}\z").cast("int"),
        (digits.between(12, 19) & luhn(_digits(t))).cast("int"),
        before.rlike(r"(?<![a-z])(?:call|phone|tel|mobile|fax|cell|ring|handy|telefon|t[ée]l[ée]phone|tel[ée]fono)[^a-z0-9]{0,3}(?:me|us|is|no|at|number|nr)?[^a-z0-9]{0,3}(?:at|on)?[^a-z0-9]{0,2}\z").cast("int"),
        before.rlike(r"(?<![a-z])(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)[^0-9]{0,12}\z").cast("int"),
        before.rlike(r"(?<![a-z])(?:token|secret|passw(?:or)?d|key|bearer)[\"']?[^a-z0-9]{0,4}\z").cast("int"),
        before.rlike(r"(?<![a-z])(?:mail|e-mail|contact|write to|reach)[^\n]{0,10}\z").cast("int"),
    ]
    return [c.cast("double") for c in out]


N_FEATURES = 17

def _examples(seed: int = 11, each: int = 40) -> list[dict]:
    """Synthetic sentences with one marked or innocent span each; ``held`` templates only calibrate."""
    r = random.Random(seed)
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["on", "er", "the", "ti", "la", "en", "es", "an", "or", "is"]) for _ in range(r.randint(1, 4)))
    some = lambda: " ".join(word() for _ in range(r.randint(2, 7)))
    yes = [
        lambda: f"call me at ({dig(3)}) {dig(3)}-{dig(4)}",
        lambda: f"phone: {dig(3)}-{dig(3)}-{dig(4)}",
        lambda: f"tel {dig(3)} {dig(4)} {dig(4)}",
        lambda: f"mobile 0{dig(3)} {dig(7)}",
        lambda: f"({dig(3)}) {dig(3)}-{dig(4)}",
        lambda: f"my card {dig(4)} {dig(4)} {dig(4)} {dig(4)}",
        lambda: f"credit card {dig(16)}",
        lambda: f'token = "{hexa(40)}"',
        lambda: f"api_key={alnum(r.randint(20, 40))}",
        lambda: f"password: {alnum(r.randint(9, 16))}7x",
        lambda: f"secret: '{alnum(32)}'",
        lambda: f"{word()}{dig(2)} [at] {word()} [dot] com",
        lambda: f"{word()}.{word()}(at){word()}.org",
        lambda: f"mail {word()} at {word()} dot net",
        lambda: f"token={alnum(20)}.{alnum(40)}.{alnum(30)}",
        lambda: f"eyJ{alnum(17)}.{alnum(40)}.{alnum(30)}",
        lambda: f"sha {hexa(40)}",
        lambda: hexa(r.choice([32, 48, 64, 128])),
    ]
    no = [
        lambda: f"order {dig(16)}",
        lambda: dig(r.randint(10, 20)),
        lambda: f"on {r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {dig(2)}",
        lambda: f"{dig(1)}.{dig(2)}.{dig(1)}.{dig(3)} {dig(3)}",
        lambda: f"{dig(3)} {dig(3)} {dig(3)}",
        lambda: f"page {dig(2)} - {dig(2)} - {dig(4)}",
        lambda: f"key: {word()}{word()}{word()}{word()}",
        lambda: f"the secret: {word()}ingness{word()}",
        lambda: f"we met at the dot com of {word()} dot {word()}",
        lambda: f"3.{dig(14)}",
        lambda: f"isbn 978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}",
        lambda: f"{dig(12)} {some()}",
    ]
    held_yes = [
        lambda: f"ring me on {dig(3)}-{dig(4)}-{dig(4)}",
        lambda: f"fax: ({dig(3)}) {dig(3)} {dig(4)}",
        lambda: f"visa {dig(4)}-{dig(4)}-{dig(4)}-{dig(4)}",
        lambda: f"amex card {dig(4)} {dig(6)} {dig(5)}",
        lambda: f"bearer: {alnum(36)}",
        lambda: f"access_key = '{hexa(32)}'",
        lambda: f"{hexa(64)}",
        lambda: f"{word()}.{word()} [at] {word()}.com",
        lambda: f"reach {word()}{dig(1)}(at){word()}(dot)net",
    ]
    held_no = [
        lambda: f"invoice {dig(13)}",
        lambda: f"{dig(4)} {dig(4)} {dig(2)} items",
        lambda: f"from {r.randint(1990, 2030)} to {r.randint(1990, 2030)} {dig(3)}",
        lambda: f"{dig(2)}.{dig(2)}.{r.randint(1990, 2030)} {dig(2)}",
        lambda: f"serial {dig(4)}-{dig(4)}-{dig(5)}",
        lambda: f"password: {word()}{word()}{word()}",
        lambda: f"the key: {word()}ation{word()}",
        lambda: f"he looked at the dot {word()} dot",
        lambda: f"pi is 3.{dig(18)}",
    ]
    made = ((1, yes, 0), (0, no, 0), (1, held_yes, 1), (0, held_no, 1))
    return [{"text": f"{some()} {f()} {some()}.", "y": y, "held": held} for y, fs, held in made for f in fs for _ in range(each)]


class Trees:
    """Depth-two regression trees fitted to the logistic gradient."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        f, self.trees = np.full(len(y), self.bias), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), 2)
            self.trees.append(tree)
            f += np.array([self._at(tree, row) for row in x])
        self.scores = 1 / (1 + np.exp(-f))

    def _grow(self, x, g, h, depth):
        leaf = RATE * g.sum() / (h.sum() + 1.0)
        if not depth:
            return leaf
        best, at = 1e-6, None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                a = x[:, j] <= cut
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[~a].sum() ** 2 / (h[~a].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best:
                    best, at = gain, (j, float(cut))
        if at is None:
            return leaf
        a = x[:, at[0]] <= at[1]
        return (*at, self._grow(x[a], g[a], h[a], depth - 1), self._grow(x[~a], g[~a], h[~a], depth - 1))

    @classmethod
    def _at(cls, tree, row):
        return tree if isinstance(tree, float) else cls._at(tree[2] if row[tree[0]] <= tree[1] else tree[3], row)

    def margin(self, f: list[Column]) -> Column:
        def of(tree) -> Column:
            return F.lit(float(tree)) if not isinstance(tree, tuple) else F.when(f[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + of(tree)
        return out


def fit(spark: SparkSession) -> tuple[Trees, dict[int, float]]:
    """The trees, and for each kind (by its place) the margin at which spans are selected."""
    x, y, held = (np.array(c) for c in zip(*_fit_rows(spark), strict=True))
    own = Trees(x[held == 0], y[held == 0].astype(float))
    rows, truth = x[held == 1], y[held == 1]
    margin = np.array([own.bias + sum(own._at(t, r) for t in own.trees) for r in rows])
    return own, {kind: _threshold(margin[rows[:, 0] == kind], truth[rows[:, 0] == kind]) for kind in range(len(KINDS))}


def _threshold(margin: np.ndarray, truth: np.ndarray) -> float:
    """The least margin at which the share of true spans is ``PRECISION``; infinite where there is none."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.r_[margin[order][1:] != margin[order][:-1], True] if len(order) else np.zeros(0, bool)  # spans of equal margin go together
    good = np.flatnonzero((right >= PRECISION) & last)
    return float(margin[order][good[-1]]) if len(good) else float("inf")


def _fit_rows(spark: SparkSession) -> list[tuple]:
    data = json.dumps(_examples())
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(data), "array<struct<text:string,y:int,held:int>>")).alias("r"))
    rows = rows.select("r.*", candidates(F.col("r.text")).alias("c")).select("y", "held", F.explode("c").alias("c"))
    return [(list(r.x), r.y, r.held) for r in rows.select("y", "held", F.array(*features(F.col("c"))).alias("x")).collect()]


@lru_cache(maxsize=1)
def _fitted(app: str) -> tuple[Trees, dict[int, float]]:
    return fit(SparkSession.getActiveSession())


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


RANKED = "array<struct<kind:string,ord:int,s:int,e:int,t:string,m:double>>"


def _select(every: Column) -> Column:
    """Of (kind, ord, s, e, t, m) sorted by start: the rule spans (m null) and the best that overlap none taken.

    Spans that overlap, directly or through others, stand next to each other, so
    each such stretch is settled by itself.
    """
    ends = running(F.transform(every, lambda x: x["e"]), F.greatest)
    fresh = F.zip_with(every, ends, lambda x, end: x["s"] >= end)
    heads = F.filter(F.transform(fresh, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    stops = F.concat(F.slice(heads, 2, F.greatest(F.size(heads), F.lit(1))), F.array(F.size(every)))
    better = lambda x: F.struct(x["m"].isNull(), x["m"], -x["s"], x["e"], -x["ord"])
    order = lambda a, b: F.when(better(a) > better(b), -1).when(better(a) < better(b), 1).otherwise(0)

    def settle(i: Column, stop: Column) -> Column:
        mine = F.array_sort(F.slice(every, i + 1, stop - i), order)
        take = lambda got, x: F.when(x["m"].isNull() | ~F.exists(got, lambda g: _overlap(g, x)), F.concat(got, F.array(x))).otherwise(got)
        return F.aggregate(mine, F.array().cast(RANKED), take)

    plain = F.flatten(F.zip_with(heads, stops, settle))
    return F.array_sort(F.transform(plain, lambda x: F.struct(x["kind"].alias("kind"), x["ord"].alias("ord"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"))), _order)


def find_pii(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` plus ``base`` and ``spans`` (the names are parameters): arrays of (kind, ord, s, e, t).

    ``base`` are the rule spans, ``spans`` these and the selected candidates that
    overlap no rule span and no better candidate that is selected (higher margin,
    then earlier, then longer). Offsets are code points, ends exclusive. Null texts
    count as empty and have no span. Repeated rows stay, an empty table gives none,
    columns of any other name stay; those of the two names are replaced.
    """
    trees, least = _fitted(docs.sparkSession.sparkContext.applicationId)
    kept = [c for c in docs.columns if c not in (base, spans)]
    c, b = fresh(docs, "c", "b")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn(b, base_spans(t)).withColumn(c, candidates(t))
    # tree inputs are computed once for each candidate, then read by the trees
    with_x = F.transform(c, lambda x: F.struct(x["kind"], x["ord"], x["s"], x["e"], x["t"], F.array(*features(x)).alias("x")))
    out = out.withColumn(c, F.when(F.size(c) > 0, with_x))
    scored = F.transform(c, lambda x: F.struct(x["kind"], x["ord"], x["s"], x["e"], x["t"], trees.margin([F.get(x["x"], i) for i in range(N_FEATURES)]).alias("m")))
    floor = lambda x: F.get(F.array(*[F.lit(least[k]) for k in range(len(KINDS))]), x["ord"])
    out = out.withColumn(c, F.filter(scored, lambda x: x["m"] >= floor(x)))
    rules = F.transform(b, lambda x: F.struct(x["kind"], x["ord"], x["s"], x["e"], x["t"], F.lit(None).cast("double").alias("m")))
    first = lambda x, y: F.when(x["s"] < y["s"], -1).when(x["s"] > y["s"], 1).otherwise(0)
    out = out.withColumn(c, F.when(F.size(c) > 0, F.array_sort(F.concat(rules.cast(RANKED), F.col(c).cast(RANKED)), first)))
    return out.select(*quoted(kept), F.col(b).alias(base), F.coalesce(F.when(F.size(c) > 0, _select(F.col(c))), F.col(b)).alias(spans))


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: str) -> Column:
    """The text with each span (overlapping ones together) replaced by ``[KIND]``."""
    items = F.col(f"`{spans}`")
    ends = running(F.transform(items, lambda x: x["e"]), F.greatest)

    def piece(x: Column, end: Column) -> Column:
        gap = F.substring(text, end + 1, F.greatest(x["s"] - end, F.lit(0)))
        return F.when(x["s"] >= end, F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    last = F.aggregate(items, F.lit(0), lambda a, x: F.greatest(a, x["e"]))
    whole = F.concat(F.array_join(F.zip_with(items, ends, piece), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size(items) > 0, whole).otherwise(text)
