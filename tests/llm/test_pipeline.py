"""The stages one after the other, each against what it should leave."""

from pyspark.sql import functions as F

import corpus_pipeline
from motiontables.llm import decontamination, near_duplicates, quality, suffix_dedup

BASE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    labels, items = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("labels", "benchmark"))
    checks = {
        "quality classifier": lambda a, b: {r.doc_id for r in b.collect()} == {
            r.doc_id for r in quality.quality_scores(a, labels).where("good").collect()},
        "near-duplicate removal": lambda a, b: near_duplicates.near_duplicates(b).where("NOT kept").count() == 0,
        "suffix-array dedup": lambda a, b: {r.doc_id: r.text for r in b.collect()}.items() >= {
            r.doc_id: r.text for r in a.join(suffix_dedup.repeats(a).where("n_removed = 0").select("doc_id"), "doc_id").collect()}.items(),
        "benchmark decontamination": lambda a, b: decontamination.matched(b, items).where("n_hit > 0").count() == 0,
        "best-fit packing": lambda a, b: b.select("doc_id").distinct().count() == a.count(),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, BASE).cache()
        assert checks[name](docs, out), name
        assert name == "best-fit packing" or out.columns == docs.columns
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, BASE).count() > 0


def test_awkward_rows_and_clashing_names(spark):
    """Null and empty texts, repeated rows, null ids and columns that stages use themselves: no crash, columns stay."""
    base = spark.read.parquet(f"{BASE}/documents.parquet").limit(60)
    more = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "no id here", "en", "s", 10),
                                  (-3, "twice", "en", "s", 5), (-3, "twice", "en", "s", 5), (-4, "a b " * 40_000, "en", "s", 160_000)], more)
    docs = base.unionByName(rows)
    for name in ("_hits", "_score", "_key", "_gone", "_doc", "node"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, BASE).cache()
        if name != "best-fit packing":
            assert out.columns == docs.columns and out.where("_hits <> '_hits' OR _score <> '_score' OR _key <> '_key' OR _gone <> '_gone'").count() == 0
        assert stage(spark, docs.where("false"), BASE).count() == 0, name
        docs = out
