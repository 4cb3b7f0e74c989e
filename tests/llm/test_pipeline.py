"""The corpus pipeline, stage by stage."""

import re

import corpus_pipeline
from graphloom.llm import decontaminate, pii, toxicity
from graphloom.plans.staging import Stage


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages(spark, small):
    stage = Stage(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = dict(corpus_pipeline.STAGES)
    start = {r.doc_id: r for r in docs.collect()}

    one = stage.cut(steps[names[0]](spark, docs, small))
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in one.collect()} == {i for i, r in start.items() if model.score(r.text) < 0.7}

    two = stage.cut(steps[names[1]](spark, one, small))
    before, after = {r.doc_id: r.text for r in one.collect()}, {r.doc_id for r in two.collect()}
    sets = {i: shingles(t) for i, t in before.items()}
    for i, t in before.items():
        alike = [k for k in before if k < i and (sets[k] == sets[i] or len(sets[k] & sets[i]) >= 0.8 * len(sets[k] | sets[i]))]
        if i not in after:
            assert alike, i
        assert not any(before[k] == t for k in alike) or i not in after

    three = stage.cut(steps[names[2]](spark, two, small))
    found = {r.doc_id for r in decontaminate.leaks(two, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in three.collect()} == after - found

    four = stage.cut(steps[names[3]](spark, three, small))
    assert four.count() == three.count()
    assert not [r for r in pii.find_pii(four).collect() if r.base]
    for r in four.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id] or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r.text))
    for df in (one, two, three, four):
        assert df.columns == docs.columns

    five = steps[names[4]](spark, four, small)
    assert five.count() == four.count()
    assert sorted(r.ids_sha256 for r in five.collect()) == sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect())


def test_stages_on_an_empty_table(spark, small):
    stage = Stage(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stage.cut(step(spark, docs, small))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0


ODD = [
    (1, None), (2, ""), (3, "  "), (4, "one"), (5, "word " * 50_000), (6, "mail me at a.b@example.org now"), (6, "mail me at a.b@example.org now"), (7, "mail me at a.b@example.org now"),
    (None, "no id but words"), (8, "x" * 200_000), (9, "two words"), (10, "two words"),
]


def test_stages_take_odd_rows_and_any_columns(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, spans string, _c string, _n int, _sha string, _keep string, `a.b` int, key int, sha string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.25, "b", "mine", "c", 7, "s", "k", 3, 4, "z") for i, t in ODD], schema)
    stage = Stage(spark)
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, small)
        assert got.columns == docs.columns
        docs = stage.cut(got)
        rows = kept[name] = docs.collect()
        assert all((r["score"], r["base"], r["spans"], r["_c"], r["_n"], r["_sha"], r["_keep"], r["a.b"], r["key"]) == (0.25, "b", "mine", "c", 7, "s", "k", 3, 4) for r in rows)
    assert len(kept["toxicity"]) == len(ODD)
    ids = sorted((r.doc_id or 0, (r.text or "")[:10]) for r in kept["simhash_near_dedup"])
    assert [i for i, _ in ids] == [0, 1, 4, 5, 6, 8, 9]
    assert len(kept["benchmark_decontamination"]) == 7
    assert {r.doc_id: r.text for r in kept["pii"]}[6] == "mail me at [EMAIL] now"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 7
