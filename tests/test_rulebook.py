"""Thousands of rules against evaluating each by itself."""

import random

import pytest
from pyspark.sql import functions as F

from rulemill import query
from rulemill.operators import rulebook
from rulemill.operators.rulebook import CONDITIONS, conditions_of, matches
from rulemill.plans.rules import RuleError

NAMES = ["a", "b", "c"]


def rows(spark):
    rng = random.Random(2)
    number = lambda: rng.choice([None, *range(-3, 12), 2.5, 7.25])
    listed = [(i, None if (x := number()) is None else float(x), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "x", "y", "z", ""])) for i in range(150)]
    return spark.createDataFrame([*listed, (150, float("nan"), 1, "x")], "id int, a double, b int, c string").repartition(3)


def drawn(rng):
    rule = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "one", "two", "same"])
        low, high = sorted(rng.choice([rng.randrange(-4, 13), 2.5, 7.25]) for _ in range(2))
        if kind == "text":
            rule.append(("c", None, None, None, None, rng.choice(["x", "y", ""])))
        elif kind == "one":
            above = rng.random() < 0.5
            rule.append((rng.choice("ab"), float(low) if above else None, rng.random() < 0.5, None if above else float(high), rng.random() < 0.5, None))
        else:
            rule.append((rng.choice("ab"), float(low), rng.random() < 0.5 or kind == "same", float(low if kind == "same" else high), rng.random() < 0.5 or kind == "same", None))
    return rule


def holds(value, condition):
    _, low, low_in, high, high_in, text = condition
    if text is not None:
        return value == text
    if value is None or value != value:
        return False
    return (low is None or value > low or (low_in and value == low)) and (high is None or value < high or (high_in and value == high))


def test_rulebook_equals_every_rule_by_itself(spark):
    rng = random.Random(4)
    rules = {f"r{i}": drawn(rng) for i in range(300)} | {"other": [("nowhere", 1.0, True, None, None, None)]}
    conditions = spark.createDataFrame([(name, *c) for name, rule in rules.items() for c in rule], CONDITIONS)
    df = rows(spark)
    data = [r.asDict() for r in df.collect()]
    want = sorted((r["id"], name) for r in data for name, rule in rules.items() if all(c[0] in r and holds(r[c[0]], c) for c in rule))
    assert sorted(map(tuple, matches(df, conditions, ["id"], NAMES).collect())) == want


def test_the_plan_does_not_grow_with_the_rules(spark):
    sizes = []
    for n in (3, 3000):
        conditions = spark.range(n).select(F.col("id").cast("string").alias("rule"), F.lit("a").alias("attribute"), F.col("id").cast("double").alias("low"), F.lit(True).alias("low_in"),
                                           F.lit(None).cast("double").alias("high"), F.lit(False).alias("high_in"), F.lit(None).cast("string").alias("text"))
        plan = matches(rows(spark), conditions, ["id"], NAMES)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan.replace("3000", "3")))
    assert abs(sizes[0] - sizes[1]) < 0.02 * sizes[0]


def test_rule_tables_as_conditions(spark):
    sets = {
        "one": [("no", "and", "a", "double", "between", "1 and 5"), ("no", None, "c", "string", "=", "x")],
        "two": [("no", None, "b", "integer", ">", "1")], "three": [("no", "and", "a", "double", "<=", "2.5"), ("no", None, "b", "integer", "=", "3")],
    }
    df = rows(spark)
    types = {f.name: f.dataType for f in df.schema}
    want = sorted((r.id, name) for name, rules in sets.items() for r in query(df.where("a IS NULL OR NOT isnan(a)"), rules).collect())
    found = matches(df.where("a IS NULL OR NOT isnan(a)"), conditions_of(spark, sets, types), ["id"], NAMES)
    assert sorted(map(tuple, found.collect())) == want
    for bad in ([("no", "or", "a", "double", ">", "1"), ("no", None, "b", "integer", ">", "1")], [("no", None, "c", "string", "like", "x%")]):
        with pytest.raises(RuleError):
            conditions_of(spark, {"bad": bad}, types)


def test_what_rows_carry_does_not_grow_with_the_rules(spark):
    """Before, the bounds of all rules stood beside every row."""
    conditions = spark.range(3000).selectExpr(
        "cast(id as string) AS rule", "'a' AS attribute", "id / 7.0D AS low", "true AS low_in", "id / 7.0D + 1 AS high", "false AS high_in", "cast(NULL as string) AS text"
    )
    shared = rulebook._bounds(conditions, NAMES).first().asDict()
    assert all(len(v) < 100 for v in shared.values() if isinstance(v, list))
    found = matches(rows(spark), conditions, ["id"], NAMES)
    want = sorted((r.id, str(i)) for r in rows(spark).collect() if r.a is not None and r.a == r.a for i in range(3000) if i / 7.0 <= r.a < i / 7.0 + 1)
    assert sorted(map(tuple, found.collect())) == want


def test_odd_bounds(spark):
    rng, inf, nan = random.Random(9), float("inf"), float("nan")
    numbers = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, 1.0 + 2**-52, 3.0, 1e17, 1e17 + 16, -1e17, 1e155, -1e155, 1.7e308, -1.7e308, inf, -inf, nan]
    pick = lambda: rng.choice([None, *numbers])
    rules = {f"r{i}": [("a", pick(), rng.choice([True, False, None]), pick(), rng.choice([True, False, None]), None) for _ in range(rng.randrange(1, 3))] for i in range(300)}
    rules |= {"two": [("c", None, None, None, None, "x"), ("c", None, None, None, None, "y")], "same": [("c", None, None, None, None, "x")] * 2, "mixed": [("b", None, None, None, None, "1"), ("b", 1.0, True, 1.0, True, None)]}
    conditions = spark.createDataFrame([(name, *c) for name, rule in rules.items() for c in rule] + [(None, "a", None, None, None, None, None)], CONDITIONS)
    data = [(i, x, i % 3, "xyz"[i % 3]) for i, x in enumerate([*numbers, None, 2.0])]
    df = spark.createDataFrame(data, "id int, a double, b int, c string")

    def holds(row, c):
        name, low, low_in, high, high_in, text = c
        v = row["abc".index(name) + 1]
        if text is not None:
            return str(v) == text
        if v is None or v != v or low is not None and low != low:
            return False
        high = None if high is not None and high != high else high  # NaN is the largest number
        return (low is None or v > low or bool(low_in) and v == low) and (high is None or v < high or bool(high_in) and v == high)

    want = sorted((row[0], name) for row in data for name, rule in rules.items() if all(holds(row, c) for c in rule))
    assert sorted(map(tuple, matches(df, conditions, ["id"], NAMES).collect())) == want


def totalled(spark, df, conditions, key="id"):
    """Totals of every rule, and what they must be by the listed pairs."""
    found = matches(df, conditions, [], NAMES, {"n": None, "sum": key})
    pairs = matches(df, conditions, [key], NAMES).groupBy("rule").agg(F.count("*").alias("n"), F.sum(key).alias("sum"))
    assert found.schema["n"].dataType == pairs.schema["n"].dataType and found.schema["sum"].dataType == pairs.schema["sum"].dataType
    return sorted(map(tuple, found.collect())), sorted(map(tuple, pairs.collect()))


def test_totals_are_those_of_the_pairs(spark):
    rng = random.Random(4)
    rules = {f"r{i}": drawn(rng) for i in range(300)} | {"other": [("nowhere", 1.0, True, None, None, None)], "wide": [("a", -1e9, True, 1e9, True, None)], "point": [("a", 2.5, True, 2.5, True, None)]}
    conditions = spark.createDataFrame([(name, *c) for name, rule in rules.items() for c in rule], CONDITIONS)
    found, want = totalled(spark, rows(spark).unionAll(rows(spark).where("id % 3 = 0")), conditions)
    assert found == want and len(want) > 100
    # no row
    assert matches(rows(spark).limit(0), conditions, [], NAMES, {"n": None}).collect() == []
    assert matches(rows(spark), conditions.limit(0), [], NAMES, {"n": None}).collect() == []


def test_totals_of_odd_bounds_and_of_wide_and_narrow_rules(spark):
    rng, inf, nan = random.Random(9), float("inf"), float("nan")
    numbers = [0.0, -0.0, 5e-324, -5e-324, 1e-300, -1e-300, 1.0, 1.0 + 2**-52, 3.0, 1e17, 1e17 + 16, -1e17, 1e155, -1e155, 1.7e308, -1.7e308, inf, -inf, nan]
    pick = lambda: rng.choice([None, *numbers])
    odd = {f"r{i}": [("a", pick(), rng.choice([True, False, None]), pick(), rng.choice([True, False, None]), None) for _ in range(rng.randrange(1, 3))] for i in range(300)}
    odd |= {"two": [("c", None, None, None, None, "x"), ("c", None, None, None, None, "y")], "mixed": [("b", None, None, None, None, "1"), ("b", 1.0, True, 1.0, True, None)]}
    values = [*numbers, None, 2.0]
    drawn_at = lambda: round(rng.uniform(-50, 50), 2)
    plain = {f"p{i}": [("a", low := drawn_at(), rng.random() < 0.5, low + rng.choice([0.0, 0.01, 0.5, 3.0, 40.0]), rng.random() < 0.5, None), ("b", float(rng.randrange(3)), False, None, None, None)] for i in range(300)}
    for rules, numbers in ((odd, values), (plain, [drawn_at() for _ in range(2000)])):
        conditions = spark.createDataFrame([(name, *c) for name, rule in rules.items() for c in rule] + [(None, "a", None, None, None, None, None)], CONDITIONS)
        df = spark.createDataFrame([(i, x, i % 4, "xyz"[i % 3]) for i, x in enumerate(numbers)], "id long, a double, b int, c string")
        found, want = totalled(spark, df, conditions)
        assert found == want and len(want) > 100


def test_totals_do_not_meet_every_row(spark):
    """Before, every row in the interval of a rule was a row of the join."""
    df = spark.range(20000).selectExpr("id", "id / 20000.0D AS a", "cast(id % 3 AS int) AS b", "'x' AS c").repartition(2)
    conditions = spark.range(49).selectExpr("cast(id AS string) AS rule", "'a' AS attribute", "id / 64.0D AS low", "true AS low_in", "id / 64.0D + 0.25D AS high", "false AS high_in", "cast(NULL AS string) AS text")
    found = matches(df, conditions, [], NAMES, {"n": None})
    want = {str(k): sum(k / 64 <= i / 20000 < k / 64 + 0.25 for i in range(20000)) for k in range(49)}
    assert {r.rule: r.n for r in found.collect()} == want and sum(want.values()) > 240_000
    plan = found._jdf.queryExecution().executedPlan()

    def joined(node):
        out = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() and "Nested" not in node.nodeName() else []
        if node.nodeName() == "AdaptiveSparkPlan":
            children = [node.executedPlan()]
        elif node.nodeName().endswith("QueryStage"):
            children = [node.plan()]
        else:
            children = [node.children().apply(i) for i in range(node.children().size())]
        return out + [n for c in children for n in joined(c)]

    rows_of_joins = joined(plan)
    assert rows_of_joins and max(rows_of_joins) < 60_000
