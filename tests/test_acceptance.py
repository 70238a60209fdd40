"""The conditional chain of a granule's acceptance: what is not due is not even planned."""

import pytest
from pyspark.sql import functions as F

from gridscan.plans import acceptance as AC

FACT = "name string, status string, measured double, bound string"


def report(spark, *statuses):
    return spark.createDataFrame([(f"f{i}", s, float(i), "b") for i, s in enumerate(statuses)], FACT)


def told(df):
    return [tuple(r)[1:6] for r in df.orderBy("position", "name").collect()]


def test_later_steps_are_not_planned(spark):
    some = spark.range(5)
    ran = []

    def step(name, *statuses, needs=("x",), least=None):
        return AC.Step(name, needs, lambda **inputs: ran.append((name, sorted(inputs))) or report(spark, *statuses), least)

    got = AC.chain(spark, [step("one", "ok", "warn"), step("two", "ok", needs=("y",)), step("three", "ok", needs=("x", "z")), step("four", "ok", least={"x": 6}),
                           step("five", "ok", "info", least={"x": 5}), step("six", "ok", "fail"), step("seven", "ok"), step("eight", "ok", needs=("y",))],
                   {"x": some, "y": some.where("false"), "z": None})
    assert told(got) == [("one", "PASS", None, "f0", "ok"), ("one", "PASS", None, "f1", "warn"), ("two", "SKIPPED", "lacks y", None, None), ("three", "SKIPPED", "lacks z", None, None),
                         ("four", "SKIPPED", "lacks x", None, None), ("five", "PASS", None, "f0", "ok"), ("five", "PASS", None, "f1", "info"),
                         ("six", "FAIL", None, "f0", "ok"), ("six", "FAIL", None, "f1", "fail"), ("seven", "SKIPPED", "after six", None, None), ("eight", "SKIPPED", "after six", None, None)]
    assert ran == [("one", ["x"]), ("five", ["x"]), ("six", ["x"])]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i % 2, i // 2 % 2, float(i // 2 % 2) + (i * 7 % 10) / 20, float(i * 13 % 17), i != 3) for i in range(120)]
    return spark.createDataFrame(rows, "fold int, y int, good double, bad double, agree boolean")


@pytest.mark.parametrize("control, test, facts", [
    ("good", "good", {"control AUC": "ok", "test minus control": "ok"}),
    ("good", "bad", {"control AUC": "ok", "test minus control": "fail"}),
    ("bad", "good", {"control AUC": "fail", "test minus control": "ok"}),
])
def test_matched_ab(spark, pairs, control, test, facts):
    p = pairs.select("fold", "y", F.col(control).alias("e_a"), F.col(test).alias("e_b"))
    score = lambda d: d.withColumn("oof", F.col("e"))
    assert {r.name: r.status for r in AC.matched_ab_report(p, ["e"], "fold", score=score).collect()} == facts
    labelled = AC.matched_ab_report(p.withColumn("agree", F.lit(None).cast("boolean")), ["e"], "fold", score=score)
    assert {r.name: r.measured for r in labelled.collect()}["labels that disagree"] == 120


def test_forests_decide_by_default(spark, pairs):
    p = pairs.select("fold", "y", F.col("good").alias("e_a"), F.col("good").alias("e_b"))
    assert {r.status for r in AC.matched_ab_report(p, ["e"], "fold", numTrees=3, maxDepth=2, min_train=1).collect()} == {"ok"}


def test_shift_of_the_strong_boxes(spark):
    noise = lambda r, c: float((r * r * 31 + c * c * 17 + r * c * 7) % 101)
    # Two boxes shifted by one row, one box that shows nothing.
    rows = [("a", "b", k, r, c, noise(r, c + k), noise(r - 1, c + k) if k < 2 else noise(c, r * 3)) for k in range(3) for r in range(20) for c in range(20)]
    boxes = spark.createDataFrame(rows, "ga string, gb string, box int, br int, bc int, va double, vb double")
    facts = {r.name: (r.measured, r.status) for r in AC.registration_report(boxes, 2, 0.5).collect()}
    assert facts["dy"] == (1.0, "fail") and facts["dx"] == (0.0, "ok") and facts["peak"][0] > 0.99
    assert {r.status for r in AC.registration_report(boxes, 2, 1.0).collect()} == {"ok", "info"}
