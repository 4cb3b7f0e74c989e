"""Group-and-compare analyses: contradictions, drift, populations, headline, rank, ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import round2

#: Findings below this score are not counted in the headline.
FLOOR = 0.5


def conflicting(sites: DataFrame, values: int = 2) -> DataFrame:
    """(key, n_values, n_sites, first_value): keys with ``values`` distinct values or more.

    ``sites``: (key, value, seq); the first site in order names the finding.
    """
    return (
        sites.groupBy("key")
        .agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_sites"), F.min_by("value", "seq").alias("first_value"))
        .where(F.col("n_values") >= values)
    )


def split_population(sites: DataFrame, least: int = 2, share: float = 0.15) -> DataFrame:
    """(grp, n_a, n_b): groups whose rarer side (``side`` boolean) has ``least`` rows and ``share``."""
    n = sites.groupBy("grp").agg(F.count_if("side").alias("n_a"), F.count_if(~F.col("side")).alias("n_b"))
    rare = F.least("n_a", "n_b")
    return n.where((rare >= least) & (rare >= share * (F.col("n_a") + F.col("n_b"))))


def drift(uses: DataFrame, least: int | Column = 4) -> DataFrame:
    """(category, dialect, n, share, rank, score): minority dialects of mixed categories.

    ``uses``: (category, dialect). Categories need ``least`` uses and two dialects;
    a dialect with under 2 % and under 3 uses is noise. Score 0.8 if the first
    dialect has 80 %, else 0.5.
    """
    n = uses.groupBy("category", "dialect").agg(F.count("*").alias("n"))
    cat = Window.partitionBy("category")
    ranked = n.select(
        "category", "dialect", "n",
        (F.col("n") / F.sum("n").over(cat)).alias("share"),
        F.sum("n").over(cat).alias("total"),
        F.count("*").over(cat).alias("dialects"),
        F.row_number().over(cat.orderBy(F.desc("n"), "dialect")).alias("rank"),
    )
    ranked = ranked.withColumn("top", F.max("share").over(cat))
    keep = (F.col("total") >= least) & (F.col("dialects") >= 2) & ((F.col("share") >= 0.02) | (F.col("n") >= 3))
    return ranked.where(keep).select("category", "dialect", "n", round2(F.col("share")).alias("share"), "rank", F.when(F.col("top") >= 0.8, 0.8).otherwise(0.5).alias("score"))


def weight(kind: Column, score: Column, loc: Column) -> Column:
    """What a finding weighs: its score by its size, or by four for settings and stubs."""
    return F.when(kind.isin("contradiction", "unfinished"), score * 4).otherwise(score * F.log2(loc + 2))


def severity(kind: Column, score: Column, loc: Column) -> Column:
    impact = weight(kind, score, loc)
    return (
        F.when(kind == "contradiction", F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low"))
        .when(kind == "unfinished", F.when(score >= 0.5, "medium").otherwise("low"))
        .otherwise(F.when(impact >= 3.5, "high").when(impact >= 1.8, "medium").otherwise("low"))
    )


def rank(findings: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` heaviest findings, ties by id (a top-k report)."""
    w = F.floor(weight(F.col("kind"), F.col("score"), F.col("loc")) * 1000 + 0.5) / 1000
    out = findings.withColumn("weight", w).withColumn("severity", severity(F.col("kind"), F.col("score"), F.col("loc")))
    return out.orderBy(F.desc("weight"), "id").limit(limit).select("id", "kind", "severity", "weight")


def headline(findings: DataFrame) -> DataFrame:
    """One row: confident dead and duplicate lines, drift and contradiction counts, unfinished."""
    kinds = {"dead": ("dead", "orphan-file")}
    at = lambda kind: F.col("kind").isin(*kinds.get(kind, (kind,))) & (F.col("score") >= FLOOR)
    total = lambda kind: F.coalesce(F.sum(F.when(at(kind), F.col("loc"))), F.lit(0)).cast("long")
    return findings.agg(
        total("dead").alias("dead_loc"),
        total("duplicate").alias("duplicate_loc"),
        F.count_if(F.col("kind") == "drift").alias("drift_count"),
        F.count_if(F.col("kind") == "contradiction").alias("contradiction_count"),
        F.count_if(at("unfinished")).alias("unfinished_count"),
    )


METRICS = ("dead_loc", "duplicate_loc", "drift_count", "contradiction_count", "unfinished_count")


def ratchet(now: DataFrame, budget: DataFrame) -> DataFrame:
    """(metric, was, now, failed): growth over the budget fails; a missing metric is met."""
    both = now.select(*[F.col(m).alias(f"n_{m}") for m in METRICS]).crossJoin(budget)  # one row each
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.col(f"n_{m}")).cast("long").alias("was"), F.col(f"n_{m}").cast("long").alias("now")) for m in METRICS])
    return both.select(F.explode(pairs).alias("x")).select("x.metric", "x.was", "x.now", (F.col("x.now") > F.col("x.was")).alias("failed"))


def apply_ignores(findings: DataFrame, directives: DataFrame, groups: tuple[str, ...] = ("duplicate", "drift", "contradiction")) -> DataFrame:
    """Findings left after directives (file, kind), by member.

    ``findings``: one row per (id, kind, member, file, loc). Members that a
    directive of their file and kind covers go. Group findings shrink and stay
    with two members or more; any covered member removes another finding.
    """
    cover = directives.select("file", "kind").distinct().withColumn("hit", F.lit(True))
    marked = findings.join(cover, ["file", "kind"], "left")
    summed = marked.groupBy("id", "kind").agg(
        F.count("*").alias("members"), F.count_if(F.col("hit").isNull()).alias("left"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("loc"))), F.lit(0)).cast("long").alias("loc")
    )
    grouped = F.col("kind").isin(*groups)
    keep = F.when(grouped, F.col("left") >= F.least(F.lit(2), F.col("members"))).otherwise(F.col("left") == F.col("members"))
    return summed.where(keep).select("id", "kind", F.col("left").alias("members"), "loc")


def headline_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: by how much each headline number of the findings fell."""
    a, b = headline(before), headline(after)
    both = a.select(*[F.col(m).alias(f"a_{m}") for m in METRICS]).crossJoin(b)  # one row each
    return both.select(*[(F.col(f"a_{m}") - F.col(m)).alias(m) for m in METRICS])


def trend_summary(points: DataFrame) -> DataFrame:
    """(metric, first, last, delta) of points (metric, at, value)."""
    first, last = F.min_by("value", "at"), F.max_by("value", "at")
    return points.groupBy("metric").agg(first.alias("first"), last.alias("last"), round2(last - first).alias("delta"))


def undismissed(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Findings whose id (dismissed: id) nobody set aside."""
    return findings.join(dismissed.select("id").distinct(), "id", "left_anti")


LEVELS = ("low", "medium", "high")


def worst_severity(level: Column) -> Column:
    """The highest of some severities, as an aggregate."""
    place = F.max(F.array_position(F.array(*map(F.lit, LEVELS)), level)).cast("int")
    return F.element_at(F.array(*map(F.lit, LEVELS)), place)


def file_weights(findings: DataFrame) -> DataFrame:
    """(file, n, weight, worst): how much the findings of each file weigh; the heaviest is where to begin."""
    kind, score, loc = F.col("kind"), F.col("score"), F.col("loc")
    each = findings.select("file", F.floor(weight(kind, score, loc) * 1000 + 0.5).cast("long").alias("w"), severity(kind, score, loc).alias("level"))
    return each.groupBy("file").agg(F.count("*").alias("n"), (F.sum("w") / 1000.0).alias("weight"), worst_severity(F.col("level")).alias("worst"))


def percent(part: Column, total: Column) -> Column:
    """A share as text; one that is not nothing never shows as 0 %, one that is not all never as 100 %."""
    share = part / total * 100
    return F.when((part > 0) & (share < 1), "<1%").when((part < total) & (share > 99), ">99%").otherwise(F.concat(F.floor(share + 0.5).cast("string"), F.lit("%")))


#: Confidence bands that findings are judged in.
BANDS = ((0.7, "sure"), (0.5, "likely"), (0.0, "doubtful"))


def band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def accuracy(judged: DataFrame, least: float = FLOOR) -> DataFrame:
    """(band, n, true_n, precision, recall) of labelled scores (score, want), all together as band *all*.

    ``precision`` is the share of wanted ones among those found (``least`` or more,
    or in the band), ``recall`` the share of all wanted ones that these are.
    """
    rows = judged.select(F.when(F.col("score") >= least, "all").alias("whole"), band(F.col("score")).alias("own"), F.col("want").cast("int").alias("want"))
    each = rows.select(F.explode(F.array_compact(F.array("whole", "own"))).alias("band"), "want")
    total = rows.agg(F.sum("want").alias("wanted"))
    found = each.groupBy("band").agg(F.count("*").alias("n"), F.sum("want").cast("long").alias("true_n"))
    return found.crossJoin(total).select("band", "n", "true_n", round2(F.col("true_n") / F.col("n")).alias("precision"), round2(F.col("true_n") / F.col("wanted")).alias("recall"))  # one row
