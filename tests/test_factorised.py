"""Counts and sums over flat rows against flattening."""

import random

import pytest
from pyspark.sql import functions as F

from rulemill import flatten, nest, query
from rulemill.operators.factorised import flat_rows

RULES = [
    None,
    [("no", None, "g", "string", "=", "g1")],
    [("no", "and", "v", "integer", ">", "1"), ("no", None, "h", "integer", "is not null", None)],
    [("yes", "or", "v", "integer", "<", "2"), ("no", "and", "g", "string", "!=", "g0"), ("no", None, "a", "string", "is null", None)],
    [("no", "or", "s", "integer", ">", "3"), ("no", None, "b", "string", "in", "b0, b2")],
]


def sample(spark):
    rng = random.Random(3)
    pick = lambda prefix, n: rng.choice([None, *(f"{prefix}{i}" for i in range(n))])
    rows = [(f"k{rng.randrange(12)}", rng.randrange(6), rng.choice([None, 1, 2, 3]), pick("a", 3), pick("b", 3), pick("g", 3), rng.choice([None, 1, 2]), i) for i in range(150)]
    return spark.createDataFrame([*rows, ("empty", 1, None, None, None, None, None, 999)], "k string, s int, v int, a string, b string, g string, h int, id int")


def spec():
    from rulemill import Group, NestingSpec, Structs, Values

    inner = Group("gs", ("g", "g"), values=(Values("hs", "h"),))
    return NestingSpec("k", scalars=(("s", "s"),), values=(Values("vs", "v"),), structs=(Structs("ts", (("a", "a"), ("b", "b"))),), groups=(inner,))


@pytest.mark.parametrize("rules", RULES, ids=range(len(RULES)))
def test_counts_and_sums_equal_those_of_flat_rows(spark, tmp_path, rules):
    nest(sample(spark), spec(), order_by="id").write.parquet(str(tmp_path / "n"))
    nested = spark.read.parquet(str(tmp_path / "n"))
    flat = flatten(nested, spec())
    flat = flat if rules is None else query(flat, rules)
    want = {r.k: (r.n, r.total) for r in flat.groupBy("k").agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("total")).collect()}
    counted = flat_rows(nested, spec(), rules)
    summed = flat_rows(nested, spec(), rules, "total", added="h")
    assert {r.k: r.n for r in counted.collect() if r.n} == {k: n for k, (n, _) in want.items()}
    assert {r.k: int(r.total) for r in summed.collect() if r.total} == {k: t for k, (_, t) in want.items() if t}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_groups_inside_groups(spark):
    from rulemill import Group, NestingSpec, Values

    inner = Group("as", ("a", "a"), values=(Values("bs", "b"),))
    deep = NestingSpec("k", groups=(Group("gs", ("g", "g"), values=(Values("hs", "h"),), groups=(inner,)),))
    nested = nest(sample(spark), deep, order_by="id")
    for rules in (None, [("no", "or", "b", "string", "=", "b1"), ("no", None, "h", "integer", "=", "2")]):
        flat = flatten(nested, deep) if rules is None else query(flatten(nested, deep), rules)
        assert flat_rows(nested, deep, rules).agg(F.sum("n")).first()[0] == flat.count()


def test_limits(spark):
    nested = nest(sample(spark), spec(), order_by="id")
    with pytest.raises(ValueError, match="conditions"):
        flat_rows(nested, spec(), [("no", "and", "v", "integer", ">", str(i)) for i in range(11)])
    with pytest.raises(ValueError, match="no flat column"):
        flat_rows(nested, spec(), added="x")
    with pytest.raises(ValueError, match="parts"):
        flat_rows(nest(sample(spark), spec(), order_by="id", parts=3), spec())
