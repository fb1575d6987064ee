import math

from pyspark.sql import functions as F

from proseline.llm import quality


def test_threshold_is_the_quantile_of_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), labels).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    held = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)) == 0).collect()} & good
    tested = 0
    for lang in {r.row.lang for r in rows}:
        own = sorted(r.log_ppl for r in rows if r.row.lang == lang and r.row.doc_id in held and r.log_ppl is not None)
        if len(own) >= quality.LEAST_TRUSTED:
            tested += 1
            edge = own[math.ceil(quality.QUANTILE * len(own)) - 1]
            assert all(math.isclose(r.threshold, edge) for r in rows if r.row.lang == lang)
    assert tested
    assert all(r.keep == (r.log_ppl is not None and r.log_ppl <= r.threshold) for r in rows)


def test_few_labelled_bad_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in quality.good_documents(spark.read.parquet(f"{folder}/documents.parquet"), labels).select("doc_id").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - bad
    assert len(bad & kept) <= 0.05 * len(bad)
    assert len(good - kept) <= 0.02 * len(good)
