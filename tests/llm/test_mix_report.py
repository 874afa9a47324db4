import corpus_pipeline
from spanlens.llm import catalog, fertility, mixing
from spanlens.storage import stored
from tests.llm import cases


def by_domain(report):
    names = [x.split()[0] for x in mixing.REPORT.split(", ")]
    return {r[0]: dict(zip(names[1:], r[1:])) for r in report}


def test_targets_that_the_stage_can_meet(spark):
    """After the quality rules hardly any words are of low quality: what the mix aims at has to be there, and is reached."""
    d = "/root/testdata/sf0.01"
    docs = stored(fertility.keep_good(spark.read.parquet(f"{d}/documents.parquet")), "good-documents")
    mixed, report = mixing.mix_reported(docs, catalog.labels(spark, d), catalog.TARGETS)
    told = by_domain(report)
    total = sum(r["input"] for r in told.values())
    low, good, toxic = (told[x] for x in ("low", "good", "toxic"))
    assert low["wanted"] > 2 * low["input"] and low["target"] == low["input"]
    assert abs(toxic["target"] / good["target"] - 0.02 / 0.94) < 1e-6
    for r in told.values():
        assert abs(r["fitted"] - r["target"]) < 0.01 * total, told
        assert abs(r["reached"] - r["fitted"]) < 0.02 * total, told
    assert mixed.count() <= docs.count()
    ids = {r.doc_id: r for r in mixing.mix_rates(docs, catalog.labels(spark, d), catalog.TARGETS).collect()}
    held = sum(ids[r.doc_id].n_tokens * ids[r.doc_id].p_toxic for r in mixed.select("doc_id").collect())
    assert abs(held - toxic["reached"]) < 1e-6 * total


def test_copies_reach_what_rates_up_to_one_cannot(spark):
    d = "/root/testdata/sf0.01"
    docs = stored(fertility.keep_good(spark.read.parquet(f"{d}/documents.parquet")), "good-documents")
    told = by_domain(mixing.mix_reported(docs, catalog.labels(spark, d), catalog.TARGETS, most=None)[1])
    assert all(r["target"] == r["wanted"] for r in told.values())
    assert abs(told["low"]["fitted"] - told["low"]["wanted"]) < 0.2 * told["low"]["wanted"], told


def test_stage_stores_its_report(spark, monkeypatch):
    d, seen = "/root/testdata/sf0.001", {}
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    corpus_pipeline.source_mix(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert [r.domain for r in seen["mix-report"].orderBy("domain").collect()] == ["good", "low", "toxic"]


def test_report_of_nothing(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    marked = spark.createDataFrame([(1, "good")], "doc_id long, domain string")
    mixed, report = mixing.mix_reported(none, marked, {"good": 0.5, "low": 0.5})
    assert mixed.count() == 0 and [r[2:] for r in report] == [(0.0,) * 5] * 2


def test_plan_does_not_grow_with_steps(spark):
    """Each step's slopes are data: more steps nest no more expressions, which the driver would compile one by one."""
    rows = spark.createDataFrame([(k + 1, p, 1 - p) for k, p in enumerate((0.1, 0.4, 0.6, 0.9))], "n_tokens long, p_0 double, p_1 double")
    for steps in (2, 9):
        rate, told = mixing.fit_rates(rows, [0.2, 0.8], steps=steps)
        plan = rows.select(rate.alias("rate"))._jdf.queryExecution().analyzed().toString()
        assert told["steps"] == steps and plan.count("greatest(") == 1
