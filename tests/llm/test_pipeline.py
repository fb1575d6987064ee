import corpus_pipeline
from proseline.llm import decontamination, pii, quality
from tests.llm.tables import awkward
from tests.llm.tables import docs as table_of
from tests.llm.test_similarity import kept_by_brute_force


def test_stages_equal_brute_force_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id * 2 as keep")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and out.schema == docs.schema, name
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "quality":
            judged = quality.judge(docs.select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert after.keys() == {r.row.doc_id for r in judged if r.keep}
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            assert len(after.keys() & bad) <= 0.5 * len(bad)
        elif name == "near_duplicates":
            assert after.keys() == kept_by_brute_force([(i, r.text) for i, r in before.items()])
        elif name == "decontamination":
            bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            windows = {tuple(w[k : k + 10]) for _, t in bench for w in [decontamination.word_list(t.encode())] for k in range(max(1, len(w) - 9)) if w}
            dirty = set()
            for i, r in before.items():
                w = decontamination.word_list(r.text.encode())
                if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
                    dirty.add(i)
            assert after.keys() == before.keys() - dirty
        else:
            assert after.keys() == before.keys()
            assert not any(pii.base_spans(r.text) for r in after.values())
            assert all(after[i].text == before[i].text for i in after if not any(c in before[i].text for c in "0123456789@_"))
            assert all(r.n_chars == len(r.text) for r in after.values())
        docs, before = spark.createDataFrame(out.collect(), out.schema), after


def test_run_packs_what_is_left(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and {"doc_id", "bin_id", "bin_capacity"} <= set(out.columns)
    assert len({r.doc_id for r in rows}) < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_take_awkward_and_empty_tables(spark, sf):
    odd = ["__id", "__digest", "__lang", "row", "hits", "digest"]
    rows = awkward()
    for some in (rows, []):
        given = table_of(spark, some).selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(odd)))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf)
            got = out.collect()
            if name == "packing":
                assert len({r.doc_id for r in got}) == len({i for i, _ in some})
                continue
            assert out.columns == given.columns, name
            assert all([r[c] for c in odd] == list(range(len(odd))) for r in got)
            if name in ("decontamination", "personal_data"):
                assert len(got) == len(some)
            if name == "near_duplicates":
                ids = [r.doc_id for r in got]
                assert ids.count(None) <= 1 and len(ids) == len(set(ids)) and (not some or 4 in ids and not {5, 6} & set(ids))
