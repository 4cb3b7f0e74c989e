"""Questions about a scanned project: find a symbol, what is like a need, what much depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import dupes, graph, similar

#: A need's words against a body's, and against a name's; what a hit and a best hit reach.
BODY, NAME, LEAST, BEST = 0.7, 0.3, 0.15, 0.3


def find_symbol(symbols: DataFrame, wanted: str, limit: int = 8) -> DataFrame:
    """(id, how): 0 for the id or name itself, 1 in any case, 2 for names that hold it; the best few."""
    q = F.lit(wanted)
    how = F.when((F.col("id") == q) | (F.col("name") == q), 0).when(F.lower("name") == F.lower(q), 1).when(F.contains(F.lower("name"), F.lower(q)), 2)
    return symbols.select("id", how.alias("how")).where("how is not null").orderBy("how", "id").limit(limit)


def load_bearing(symbols: DataFrame, edges: DataFrame, limit: int = 50, least_loc: int = 4) -> DataFrame:
    """(id, callers, weight): what most depends on, by callers and size (a top-k report)."""
    sized = symbols.where(F.col("loc") >= least_loc).select("id", "loc")
    called = graph.caller_counts(edges).select("id", "callers").join(sized, "id")
    return called.select("id", "callers", T.round2(F.col("callers") * F.log2(F.col("loc") + 2)).alias("weight")).orderBy(F.desc("weight"), "id").limit(limit)


def similar_code(symbols: DataFrame, needs: DataFrame, limit: int = 5, identifiers: bool = False) -> DataFrame:
    """(need, id, score, place): for each need (need, text) the symbols most like it.

    Cosine of the words, and the share of the name's words that the need holds;
    needs without a convincing best hit have none. With ``identifiers`` the words
    are those that names and code are made of, stemmed.
    """
    cut = T.split_identifier if identifiers else T.words
    bag = dupes.vocabulary_bag(symbols) if identifiers else similar.weighted_bags(symbols)
    req = needs.select("need", F.explode(cut(F.col("text"))).alias("term")).where((F.length("term") >= 2) & ~F.col("term").isin(*T.STOP))
    req = req.groupBy("need", "term").agg(F.count("*").alias("rw"))
    names = symbols.select("id", F.explode(cut(F.col("name"))).alias("term")).distinct().withColumn("named", F.lit(1))
    hit = req.join(bag, "term").join(names, ["id", "term"], "left").groupBy("need", "id").agg(F.sum(F.col("rw") * F.col("w")).alias("dot"), F.count("named").alias("shared"))
    rn = req.groupBy("need").agg(F.sum(F.col("rw") * F.col("rw")).alias("rn"))
    bn = bag.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("bn"))
    nn = names.groupBy("id").agg(F.count("*").alias("n"))
    score = BODY * F.col("dot") / (F.sqrt("rn") * F.sqrt("bn")) + NAME * F.col("shared") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    scored = hit.join(rn, "need").join(bn, "id").join(nn, "id", "left").select("need", "id", (F.floor(score * 10000 + 0.5) / 10000).alias("score")).where(F.col("score") > LEAST)
    own = Window.partitionBy("need")
    top = scored.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "id"))).where(F.col("place") <= limit).withColumn("best", F.max("score").over(own))
    return top.where(F.col("best") >= BEST).select("need", "id", "score", F.col("place").cast("long").alias("place"))


def intent_search(intents: DataFrame, words: tuple[str, ...], limit: int = 10) -> DataFrame:
    """(symbol, score) of purposes (symbol, purpose, confirmed) that hold the words, confirmed ones first."""
    low = F.lower("purpose")
    hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    found = intents.select("symbol", hits.alias("hits"), "confirmed").where("hits > 0")
    return found.select("symbol", (F.col("hits") + F.when(F.col("confirmed"), 0.5).otherwise(0.0)).alias("score")).orderBy(F.desc("score"), "symbol").limit(limit)


def intent_gaps(symbols: DataFrame, edges: DataFrame, intents: DataFrame, limit: int = 20) -> DataFrame:
    """Much-used symbols whose purpose nobody wrote down, see ``load_bearing``."""
    told = intents.select(F.col("symbol").alias("id")).distinct()
    return load_bearing(symbols.join(told, "id", "left_anti"), edges, limit)


def list_findings(findings: DataFrame, kinds: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Findings of some kinds (all without any) that are sure enough."""
    out = findings.where(F.col("score") >= least)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def why(symbols: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(relation, id): the callers of a symbol, what imports it, and what it reaches in one step."""
    into, out = edges.where(F.col("dst") == target), edges.where(F.col("src") == target)
    said = lambda df, col, name: df.select(F.lit(name).alias("relation"), F.col(col).alias("id"))
    return said(into.where("kind <> 'imports'"), "src", "caller").unionByName(said(into.where("kind = 'imports'"), "src", "importer")).unionByName(said(out, "dst", "reaches")).distinct()


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(key, module) of paths (key, path): the longest module that begins the path.

    A path is looked up by its beginnings of every length that a module has, so
    it is one join; there are as many lengths as modules are long at most.
    """
    sized = modules.select("module").distinct().withColumn("n", F.length("module"))
    lengths = sized.agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    hit = paths.crossJoin(lengths).select("key", F.explode(starts).alias("module")).join(sized, "module")  # one row
    return hit.groupBy("key").agg(F.max_by("module", "n").alias("module"))


def document_frequency(bag: DataFrame, owner: DataFrame, least: int = 2) -> DataFrame:
    """(term, df): in how many files (owner: id, file) a word of (id, term) is used."""
    df = bag.join(owner.select("id", "file"), "id").groupBy("term").agg(F.countDistinct("file").alias("df"))
    return df.where(F.col("df") >= least)


def distinctive(tf: DataFrame, best: int = 2) -> DataFrame:
    """(grp, term, score, place) of (grp, term, tf): the words that most tell groups apart, by TF-IDF."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = tf.agg(F.countDistinct("grp").alias("groups"))
    score: Column = T.round2(F.col("tf") * F.log(F.col("groups") / F.col("df") + 1))
    scored = tf.join(df, "term").crossJoin(total).select("grp", "term", score.alias("score"))  # one row
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
