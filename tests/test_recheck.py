"""Rules checked again by difference."""

from pyspark.sql import functions as F

from rulemill.operators import quality
from rulemill.operators.quality import violations
from rulemill.plans import recheck as module
from rulemill.plans.recheck import counts, fingerprint, known_fingerprints, recheck, store_findings
from rulemill.plans.rules import as_rules
from tests.conftest import values

FIRST = [("a", "integer", "no", ">", "5", "BIG"), ("b", "string", "no", "empty", None, "NO B"), ("a", "integer", "yes", "range", "(0, 90)", "OUT")]
LATER = [("b", "string", "no", "empty", None, "EMPTY"), ("a", "integer", "no", "=", "7", "SEVEN"), ("a", "integer", "no", ">", "5", "BIG"), ("a", "integer", "no", ">", "5", "AGAIN"), ("x", "integer", "no", ">", "5", "?"), ("a", "integer", "no", ">", "1000000", "NEVER")]


def rows(spark):
    return spark.range(100_000).select(F.col("id"), (F.col("id") % 97).cast("string").alias("a"), F.when(F.col("id") % 11 > 0, "b").alias("b")).repartition(3)


def test_equal_to_a_full_check_and_evaluates_new_rules_only(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "f"), rows(spark)
    assert len(store_findings(df, FIRST, "id", path)) == 3 and store_findings(df, FIRST, "id", path) == []
    evaluated = []
    monkeypatch.setattr(module, "quality_condition", lambda rule, c, t: evaluated.append(rule["message"]) or quality.quality_condition(rule, c, t))
    found = recheck(df, LATER, "id", path, ["id"])
    assert evaluated == ["SEVEN", "NEVER"] and len(known_fingerprints(spark, path)) == 5
    full = violations(df, LATER, ["id"])
    columns = ("id", "rule_no", "attribute", "message")
    assert values(found, *columns) == values(full, *columns)
    assert found.exceptAll(full.select(*found.columns)).count() == 0
    total = {r.rule_no: r.violations for r in counts(df, LATER, "id", path).collect()}
    assert total == {r.rule_no: r["count"] for r in full.groupBy("rule_no").count().collect()} | {6: 0}


def test_fingerprints():
    one, other, message, negated = (fingerprint(as_rules([r], "quality")[0]) for r in (FIRST[0], FIRST[1], ("a", "integer", "no", ">", "5", "x"), ("a", "integer", "yes", ">", "5", "x")))
    assert one == message and len({one, other, negated}) == 3


def test_empty_table(spark, tmp_path):
    df = rows(spark).limit(0)
    assert recheck(df, FIRST, "id", str(tmp_path / "e"), ["id"]).collect() == [] and {r.violations for r in counts(df, FIRST, "id", str(tmp_path / "e")).collect()} == {0}
