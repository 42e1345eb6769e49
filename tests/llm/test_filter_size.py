"""The filter of repeated minimisers follows the text: the driver holds little of it for little text."""

from pyspark.sql import functions as F

from motiontables.llm import suffix_dedup


def test_filter_follows_the_text(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200)) + " some further words that only one of them has"
    docs = spark.createDataFrame([(1, text), (2, "x" + text[:200]), (3, None)], "doc_id long, text string")
    texts = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = suffix_dedup.repeated_minimisers(texts, 500)
    assert len(found) <= 1 << 17 and found.any()
    assert [suffix_dedup.filter_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [20, 20, 27, 28, 28]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (200, 1), 3: (0, 0)}
