"""The cascade's order: stable, by rejections per cost, conditional; and what stops early."""

from pyspark.sql import functions as F

from siltstone.llm import quality_rules
from tests.conftest import DATA


def test_order_is_stable(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    orders = {tuple(x[0] for x in quality_rules.measure(docs)) for _ in range(5)}
    assert len(orders) == 1 and set(orders.pop()) == set(quality_rules.RULES)


def test_cost_is_that_of_the_rule(spark):
    """A rule that does much more work per text is charged more, however the job is planned."""
    rules = {"dear": lambda f: f["n_repeat_words"] < 0, "cheap": lambda f: f["n_words"] < 0}
    read = quality_rules.timings(spark.read.parquet(f"{DATA}/documents.parquet"), rules=rules)
    assert len(read) > 100 and all(len(x) == 2 for x in read)
    dear, cheap = (sum(x[k][0] for x in read) for k in range(2))
    assert dear > 10 * cheap


def test_greedy_is_conditional():
    """b repeats what a rejects, so c comes before it although it rejects fewer texts alone."""
    read = [[(1000, i < 50), (1000, i < 45), (1000, 80 <= i < 90)] for i in range(100)]
    got = quality_rules.greedy(["a", "b", "c"], read)
    assert [x[0] for x in got] == ["a", "c", "b"]
    assert [x[2] for x in got] == [0.5, 0.2, 0.0]
    dear = [[(1000, i < 50), (1 << 20, i < 60)] for i in range(100)]
    assert [x[0] for x in quality_rules.greedy(["a", "b"], dear)] == ["a", "b"]
    assert [x[0] for x in quality_rules.greedy(["x", "y"], [])] == ["x", "y"]


def test_stops_at_the_first_rule(spark):
    """A rule that would fail is not reached by texts that an earlier one rejects."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rules = {"short": quality_rules.RULES["short"], "fails": lambda f: F.raise_error(F.lit("reached")).cast("boolean")}
    got = quality_rules.quality_cascade(docs, rules=rules, order=["short", "fails"]).collect()
    assert [r["kept"] for r in got] == [False, False]


def test_words_column_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b a b a b", 7)], "doc_id long, text string, words int")
    got = quality_rules.quality_report(docs, ["doc_id", "words"]).first()
    assert (got["words"], got["n_words"], got["kept"], got["rejected_by"]) == (7, 6, False, "short")
