"""Every pipeline stage on empty, null and repeated rows with clashing names; joins of keys that aren't hot; large counts of repeats."""

import time

import pytest

from tidemark.llm import simhash, warc, workspace

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, th long, rep string, key string, _text string, quality_score double, h1 long, item_id long, rank int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(i, int(i < 6), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None)], "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    return str(place)


def rows(texts):
    return [(i, t, "en", "web", len(t or ""), i, i, "r", "k", "other", 0.5, 1, 2, 3) for i, t in texts]


GOOD = "quiet river harbour stone garden under the green bridge beside long wooden tables"
CASES = {
    "empty": [],
    "nulls": [(0, None), (1, None), (None, None), (3, "")],
    "repeats": [(0, GOOD), (0, GOOD), (1, GOOD), (2, GOOD + " tail"), (3, "line\nline\nline\nown")] * 2,
}


@pytest.mark.parametrize("case", CASES)
def test_every_stage(spark, folder, case):
    import corpus_pipeline

    docs = spark.createDataFrame(rows(CASES[case]), COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        began = time.time()
        out = stage(spark, docs, folder)
        kept = out.collect()
        assert time.time() - began < 90, name
        assert len(kept) <= len(CASES[case])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        if name == "simhash_near_dedup":
            # Texts without words have one fingerprint, so they are copies of each other.
            assert len(kept) == {"empty": 0, "nulls": 1}.get(case, len(kept))
        if case == "repeats" and name == "simhash_near_dedup":
            assert sorted(r["doc_id"] for r in kept).count(0) == 1


def test_keys_that_are_not_hot_give_the_same_results(spark, monkeypatch, tmp_path):
    texts = [(i, GOOD if i % 3 else f"{GOOD} and some {i} other words {i * 7}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pages = spark.createDataFrame([(i, f"u{i}", ("x" * 1200 if i % 2 else "y" * 1500 + str(i % 4)) if i % 5 else "small") for i in range(40)], "page_id long, url string, html string")

    def results(name):
        warc.write_archives(pages, str(tmp_path / name), min_bytes=1000)
        read = warc.read_archives(spark, str(tmp_path / name)).select("page_id", "payload_digest", "record_type", "refers_to").collect()
        return sorted(simhash.component_report(docs).collect()), sorted(map(tuple, read), key=repr)

    hot = results("hot")
    assert any(r[2] == "revisit" for r in hot[1])
    monkeypatch.setattr(workspace, "HOT", 1)
    assert results("cold") == hot


def test_an_empty_table_costs_no_more_than_another(spark):
    began = time.time()
    assert simhash.component_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert time.time() - began < 60
    assert simhash.make_plan(__import__("numpy").zeros(0, "uint64"), 0).thresholds == simhash.make_plan(__import__("numpy").zeros(0, "uint64"), 1).thresholds
