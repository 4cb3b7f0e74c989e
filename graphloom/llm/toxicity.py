"""Toxicity by a weighted grammar of composed finite-state transducers.

Each clause is read as a string of token classes (insult, threat, target,
negation, report, other). Five Mealy machines rewrite it in turn: *negation*
marks insults and threats in a negator's scope, *report* those after a speech
verb, *target* those near a second or third person, *threat* the verbs that an
announcing subject precedes, *insult* turns what is left into weights. A first
machine reads the clause from its end and marks what a target follows. They are
composed lazily into one transducer whose steps are memoised, so a clause costs
one table look-up a token, and only clauses with a lexicon hit are read at all.
What scores is clauses: no feature counts a word outside the machines.

The insult lexicon (words and word stems, any language) is learned from labelled
rows by greedy set cover; a logistic layer over the clause scores is fitted on
the same rows. At most ``MAX_ROWS`` labelled rows are used, those of the
smallest hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.columns import quoted
from graphloom.plans.staging import Stage

#: Labelled rows that the lexicon and the logistic layer are fitted on, at most.
MAX_ROWS = 20_000
#: Stem lengths tried beside whole words.
STEMS = range(4, 10)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: Typographic apostrophes, read as the plain one.
APOSTROPHES = str.maketrans("\u2019\u02bc\uff07", "'''")
CLAUSE = re.compile(r"[.!?;:\n]+")

#: The closed word classes of the grammar in four languages, and
#: the seed insults used where no labels are given.
TARGETS = "you your he she they him her them du ihr euch sie er tu vous toi il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says called wrote quoted claimed told sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
THREATS = "kill hurt destroy beat töten schlagen tuer frapper détruire matar golpear destruir".split()
ANNOUNCERS = "i we will gonna ich wir werde werden je nous vais allons yo nosotros voy vamos".split()
SEEDS = "idiot moron scum loser stupid".split()

#: What each rewritten class weighs in a clause.
WEIGHTS = {"insult": 1.0, "insult+": 1.3, "insult-": 0.25, "insult~": 0.5, "threat!": 1.2, "threat!-": 0.2, "threat!~": 0.5}


class Machine:
    """A Mealy machine over token classes, given by its step function."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step


def _scope(marker: str, length: int, suffix: str) -> Machine:
    """After ``marker``, mark insults and threats for ``length`` tokens."""

    def step(left: int, sym: str):
        if sym == marker:
            return length, sym
        hit = left > 0 and sym in ("insult", "insult>", "threat", "threat!")
        return max(0, left - 1), sym.replace(">", "") + suffix if hit else sym

    return Machine(0, step)


def _announced(left: int, sym: str):
    if sym == "announce":
        return 3, sym
    if left and sym.startswith("threat"):
        return 0, "threat!" + sym[6:]
    return max(0, left - 1), sym


def _foretold(left: int, sym: str):
    """Read from the clause's end: a target stands within the next three tokens."""
    if sym == "target":
        return 3, sym
    return max(0, left - 1), sym + ">" if left and sym == "insult" else sym


def _aimed(left: int, sym: str):
    """Insults near a target on either side; the first mark gives way to those of the other machines."""
    if sym == "target":
        return 4, sym
    plain = sym.replace(">", "")
    return max(0, left - 1), "insult+" if plain == "insult" and (left or plain != sym) else plain


NEGATION = _scope("neg", 3, "-")
REPORT = _scope("report", 12, "~")
AHEAD = Machine(0, _foretold)
TARGET = Machine(0, _aimed)
THREAT = Machine(0, _announced)
INSULT = Machine(None, lambda s, sym: (s, WEIGHTS.get(sym, 0.0)))


class Composed:
    """The composition of machines, expanded as states are met."""

    def __init__(self, *machines: Machine):
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self.table: dict = {}

    def step(self, state, sym):
        hit = self.table.get((state, sym))
        if hit is None:
            out, states = sym, []
            for m, s in zip(self.machines, state, strict=True):
                s, out = m.step(s, out)
                states.append(s)
            hit = self.table[state, sym] = (tuple(states), out)
        return hit


class Grammar:
    """A lexicon of insults (words and stems, with weights) under the grammar."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        closed = {}
        for kind, some in (("report", REPORTS), ("neg", NEGATIONS), ("target", TARGETS), ("announce", ANNOUNCERS), ("threat", THREATS)):
            closed |= dict.fromkeys(some, kind)
        self.closed = closed
        self.threats = frozenset(THREATS)
        self.ahead = Composed(AHEAD)
        self.fst = Composed(NEGATION, REPORT, TARGET, THREAT, INSULT)

    def __reduce__(self):
        return Grammar, (self.words, self.stems)

    def weight(self, word: str) -> float:
        """Of a word, or of what it is the genitive of."""
        w = max(self.words.get(word, 0.0), self.words.get(word.removesuffix("'s"), 0.0))
        for n in self.lengths:
            if n < len(word):
                w = max(w, self.stems.get(word[:n], 0.0))
        return w

    def clauses(self, text: str | None) -> list[float]:
        """The score of each clause that has one."""
        low = _plain(text)
        heavy = {w: x for w in set(WORD.findall(low)) if (x := self.weight(w)) > 0 or w in self.threats}
        if not heavy:
            return []
        out = []
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            if heavy.keys().isdisjoint(words):
                continue
            symbols = ["insult" if heavy.get(w) else self.closed.get(w, "x") for w in words]
            state = self.ahead.start
            for i in range(len(symbols) - 1, -1, -1):
                state, symbols[i] = self.ahead.step(state, symbols[i])
            state, score = self.fst.start, 0.0
            for w, sym in zip(words, symbols, strict=True):
                state, got = self.fst.step(state, sym)
                score += got * (heavy.get(w) or 1.0)
            if score > 0:
                out.append(score)
        return out

    def features(self, text: str | None) -> list[float]:
        """[best clause, second best, log sum of clauses, log matched clauses, log sum to the length]."""
        scores = sorted(self.clauses(text), reverse=True)
        if not scores:
            return [0.0] * 5
        total = sum(scores)
        second = scores[1] if len(scores) > 1 else 0.0
        return [scores[0], second, math.log1p(total), math.log1p(len(scores)), math.log1p(1000 * total / (len(text or "") + 50))]


def _plain(text: str | None) -> str:
    return (text or "").lower().translate(APOSTROPHES)


def _forms(text: str) -> set[str]:
    """Whole words as ``=word`` and stems as ``stem``."""
    words = set(WORD.findall(_plain(text)))
    out = {"=" + w for w in words if len(w) > 2}
    for n in STEMS:
        out |= {w[:n] for w in words if len(w) > n}
    return out


def _counts(docs: DataFrame, only: frozenset | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0):
                f = _forms(t.as_py() or "")
                n.update(f if only is None else f & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["form", "n"])

    return docs.select("text").mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def _cover(rows: list[list[str]], weights: dict[str, float], least: int) -> list[str]:
    """Forms chosen until none covers ``least`` rows that are not covered yet."""
    owners = defaultdict(set)
    for i, forms in enumerate(rows):
        for f in forms:
            owners[f].add(i)
    left, chosen = set(range(len(rows))), []
    while left and owners:
        form = max(owners, key=lambda f: (len(owners[f] & left) * weights[f], -len(f), f))
        if len(owners[form] & left) < least:
            break
        chosen.append(form)
        left -= owners.pop(form)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


class Model:
    """A grammar and the logistic layer over its clause scores."""

    def __init__(self, grammar: Grammar, weights: np.ndarray):
        self.grammar, self.weights = grammar, np.asarray(weights, float)

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights[:-1], self.grammar.features(text)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: The logistic layer where nothing can be learned: one clear insult passes 0.7.
PRIOR = (2.5, 0.3, 0.8, 0.3, 0.1, -2.2)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, stage: Stage | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, at most ``max_rows``.

    Null labels and ids teach nothing, an id with several labels counts as toxic if
    one says so, equal texts count once (toxic if one is), null texts are empty.
    Without a toxic label the seed words are the lexicon. Extra columns are ignored.
    """
    stage = stage or Stage(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~F.coalesce(held_out(), F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # copies would make each of their words look like a sign
    rows = stage.cut(rows.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")))
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic <> 1")
    n = toxic.count()
    least = max(3, round(0.004 * n))
    hits = {r.form: r.n for r in _counts(toxic, None).where(F.col("n") >= least).collect()} if n else {}
    if not hits:
        stage.drop(rows)
        return Model(Grammar(dict.fromkeys(SEEDS, 1.0), {}), np.array(PRIOR))
    spark, every = docs.sparkSession, frozenset(hits)
    other = {r.form: r.n for r in _counts(clean, every).collect()}
    sure = {f: math.log((a + 0.5) / (other.get(f, 0) + 0.5)) for f, a in hits.items() if a >= 3 * other.get(f, 0)}
    kept = spark.sparkContext.broadcast(frozenset(sure))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_forms(t.as_py() or "") & kept.value) for t in b.column(0)], pa.list_(pa.string()))], names=["forms"])

    lists = [r.forms for r in toxic.select("text").mapInArrow(present, "forms array<string>").collect()]
    chosen = _cover(lists, sure, least)
    top = max((sure[f] for f in chosen), default=1.0)
    weigh = lambda f: max(0.2, sure[f] / top)
    grammar = Grammar({f[1:]: weigh(f) for f in chosen if f[0] == "="}, {f: weigh(f) for f in chosen if f[0] != "="})
    share = spark.sparkContext.broadcast(grammar)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [share.value.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(featured, "toxic int, x array<double>").collect()
    stage.drop(rows)
    return Model(grammar, _logistic(np.array([r.x for r in got]), np.array([float(r.toxic == 1) for r in got])))


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1; the name is a parameter). Null and empty texts score as no clause.

    Texts are scored whole. Repeated rows stay, an empty table gives none; a column
    that has the name already is replaced, all others stay, whatever their names.
    """
    keep = [f for f in docs.schema.fields if f.name != score]
    # Arrow functions take no column whose name has a dot
    plain = docs.select(*quoted(f.name for f in keep)).toDF(*[f"c{i}" for i in range(len(keep))])
    at = [f.name for f in keep].index(text)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [share.value.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    made = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return made.toDF(*[f.name for f in keep], score)
