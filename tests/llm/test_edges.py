"""Every dealt operator on nulls in any column, empty and long texts, ties and repeated rows, clashing columns, and
empty tables."""

import pytest

from siltstone.llm import queries

LONG = " ".join(f"w{i % 700} token{i}" for i in range(30_000))
DOCS = [
    (1, "one two three four five", "en", "s", 23, 7, "x", 1),
    (1, "one two three four five", "en", "s", 23, 7, "x", 1),
    (2, None, "en", "s", None, None, None, None),
    (3, "", None, None, 0, 7, "x", 1),
    (4, " \n\t ", "fr", "s", 4, 7, "x", 1),
    (None, "no id here at all", "en", "s", 17, 7, "x", 1),
    (None, None, None, None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG), 7, "x", 1),
    (6, "Ünïcödé — ☃ 中文 \x00 text", "de", None, 20, 7, "x", 1),
    (7, "line\n" * 60, "en", "s", 300, 7, "x", 1),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp string, kept int"


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("edge"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{top}/{name}.parquet")
    write(DOCS, DOC_SCHEMA, "documents")
    write([(1, "one two three four five six."), (2, None), (None, ""), (3, "line line")], "item_id long, text string", "benchmark")
    write([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int", "labels")
    write([(1, 0, "user", "hi", 3), (1, 0, "user", "hi", 3), (1, None, None, None, 3), (None, 0, "assistant", "a <s>[x]% b", 3), (2, 5, "system", "", 3), (2, 6, "assistant", "yes" * 5000, 3), (2, 7, "user", "z" * 9000, 3), (2, 8, "assistant", "ok", 3)], "conv_id long, turn long, role string, text string, span int", "conversations")
    return top


@pytest.fixture(scope="module")
def empty_dir(spark, edge_dir, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_edge_rows(spark, edge_dir, name):
    rows = queries.QUERIES[name](spark, edge_dir).collect()
    if name == "op4_decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (7, 3)}
    elif name == "op5_packing":
        assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == sum(not (d[1] or "").strip() for d in DOCS)
    elif name == "op7_chat_format":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {-7: 2, 1: 3, None: 1, 2: 4}
    else:
        assert len(rows) == len(DOCS)
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
        assert sorted(map(key, rows)) == sorted((d[0] is None, d[0] or 0) for d in DOCS)
        copies = [tuple(r) for r in rows if r["doc_id"] == 1]
        assert copies[0] == copies[1]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = queries.QUERIES[name](spark, empty_dir).collect()
    assert [r["conv_id"] for r in rows] == [-7] if name == "op7_chat_format" else rows == []
