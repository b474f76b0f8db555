"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from siltstone.llm.common import stored

WORDS = " ".join(f"w{i * 7919 % 977}" for i in range(200))
LONG = " ".join(f"w{i % 7001} token{i}" for i in range(20_000))
DOCS = [
    (1, WORDS, 5, "a", 1, True), (1, WORDS, 5, "a", 1, True), (2, None, None, None, None, None), (3, "", 0, "b", 2, False), (None, WORDS + " other end", 7, "c", 3, True),
    (4, LONG, len(LONG), "d", 4, None), (5, " ".join(f"é{i}" for i in range(80)) + " password = hunter2xyz", 9, "e", 5, True), (6, " ".join(f"z{i}" for i in range(70)) + " one two three four five six seven eight nine ten", None, "f", 6, True),
]
SCHEMA = "doc_id long, text string, n_chars int, kept string, row long, set boolean"


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(DOCS, SCHEMA).coalesce(2)
    docs = stored(docs.limit(0) if empty else docs, "edges")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "edges")
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        left[name] = docs.collect()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    if empty:
        assert not any(left.values()) and pieces == []
        return
    ids = {k: sorted((r["doc_id"] or 0) for r in v) for k, v in left.items()}
    assert ids["quality_rules"] == [0, 1, 1, 4, 5, 6]
    assert ids["simhash_near_dedup"] == [1, 4, 5, 6]  # the row without an id is a near copy and gives way
    assert ids["benchmark_decontamination"] == [1, 4, 5]
    five = next(r for r in left["secret_scan"] if r["doc_id"] == 5)
    assert five["text"].endswith("<SECRET>") and five["n_chars"] == len(five["text"]) and (five["kept"], five["row"]) == ("e", 5)
    assert next(r for r in left["secret_scan"] if r["doc_id"] == 1)["n_chars"] == 5
    assert {r["doc_id"] for r in pieces} == {1, 4, 5}


def test_decontamination_is_fitted_on_every_row(spark, tmp_path, monkeypatch):
    """1200 texts, more than a sample held before."""
    import corpus_pipeline
    from siltstone.llm import decontaminate

    spark.createDataFrame([(1, "the long stone lies under nine small ferns today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"stone {i} ferns under the {i % 7}") for i in range(1200)], "doc_id long, text string")
    real, fitted = decontaminate.fit, []

    def watched(index, rows, *rest, **more):
        fitted.append(rows.count())
        real(index, rows, *rest, **more)

    monkeypatch.setattr(decontaminate, "fit", watched)
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 1200
    assert fitted == [1200]
