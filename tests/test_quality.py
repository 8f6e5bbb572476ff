import pytest

from rulemill import RuleError, apply_quality, apply_quality_sets, quality_summary, violations
from rulemill.operators.quality import quality_problems
from tests.conftest import values

CELLS = [("1", "5", "A"), ("2", "x", "AB"), ("3", "1.7", None), ("4", None, "C"), ("5", "300", "A;B")]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "id string, n string, s string").coalesce(1)


def column_of(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    "kind, negated, condition, value, expected",
    [
        ("integer", "no", "empty", None, ["5", "M", "1", "M", "300"]), ("integer", "yes", "empty", None, ["M", None, "M", None, "M"]),
        ("integer", "no", ">=", "5", ["M", None, "1", None, "M"]), ("integer", "yes", ">=", "5", ["5", None, "M", None, "300"]),
        ("integer", "no", "<=", "5", ["M", None, "M", None, "300"]), ("integer", "no", "<", "5", ["5", None, "M", None, "300"]),
        ("integer", "no", ">", "5", ["5", None, "1", None, "M"]), ("integer", "no", "=", "1", ["5", None, "M", None, "300"]),
        ("integer", "no", "range", "(1, 5)", ["M", None, "M", None, "300"]), ("integer", "yes", "range", "(1, 5)", ["5", None, "1", None, "M"]),
        ("byte", "no", "empty", None, ["5", "M", "1", "M", "M"]), ("double", "no", ">", "1.5", ["M", None, "M", None, "M"]),
        ("decimal", "no", "=", "2", ["5", None, "M", None, "300"]), ("long", "no", ">", "4.5", ["M", None, "1", None, "M"]),
        ("string", "no", "empty", None, ["5", "x", "1.7", "M", "300"]), ("string", "no", "equals", "x", ["5", "M", "1.7", None, "300"]),
        ("string", "no", "contains", ".", ["5", "x", "M", None, "300"]), ("string", "yes", "contains", "0", ["M", "M", "M", None, "300"]),
        ("string", "yes", "equals", "x", ["M", "x", "M", None, "M"]),
    ],
)
def test_replace(cells, kind, negated, condition, value, expected):
    assert column_of(apply_quality(cells, [("n", kind, negated, condition, value, "M")]), "n") == expected


def test_last_matching_message_wins_and_rules_see_the_original(cells):
    rules = [("n", "integer", "no", ">", "1", "FIRST"), ("n", "integer", "no", ">", "100", "SECOND"), ("n", "integer", "no", "empty", None, "NONE")]
    assert column_of(apply_quality(cells, rules), "n") == ["FIRST", "NONE", "1", "NONE", "SECOND"]


def test_bad_rules_change_nothing_unless_strict(cells):
    rules = [("n", "date", "no", "=", "1", "M"), ("z", "string", "no", "empty", None, "M"), ("n", "string", "no", "~", "1", "M")]
    assert values(apply_quality(cells, rules)) == values(cells)
    assert [n for n, _, _ in quality_problems(cells, rules)] == [1, 2, 3]
    with pytest.raises(RuleError):
        apply_quality(cells, rules, strict=True)


RULES = [("n", "integer", "no", "empty", None, "NO NUMBER"), ("s", "string", "no", "contains", "A", "HAS A"), ("n", "integer", "yes", "range", "(0, 10)", "OUT")]


def test_all_forms_agree_on_what_is_flagged(cells):
    noted = apply_quality(cells, RULES, mode="annotate")
    assert noted.select("id", "n", "s").collect() == cells.collect()
    found = sorted((r.id, m.rule_no, m.message) for r in noted.collect() for m in r.quality_messages)
    listed = values(violations(cells, RULES, ["id"]), "id", "rule_no", "message")
    assert found == listed
    counts = {r.rule_no: r.n_cells for r in quality_summary(cells, RULES).collect()}
    assert counts == {n: sum(1 for f in found if f[1] == n) for n in (1, 2, 3)}
    replaced = apply_quality(cells, RULES)
    flagged = {(r.id, c) for r in replaced.collect() for c in ("n", "s") if r[c] in ("NO NUMBER", "HAS A", "OUT")}
    assert flagged == {(i, "s" if n == 2 else "n") for i, n, _ in found}
    assert [r.value for r in violations(cells, RULES, ["id"]).where("rule_no = 3").collect()] == ["300"]


def test_forms_without_usable_rules(cells):
    assert violations(cells, [], ["id"]).count() == 0 and quality_summary(cells, []).count() == 0
    assert apply_quality(cells, [], mode="annotate").first().quality_messages == []
    with pytest.raises(ValueError):
        apply_quality(cells, RULES, mode="other")


SETS = {"first": [("n", "integer", "no", ">", "4", "BIG")], "second": [("n", "integer", "no", "empty", None, "NONE"), ("s", "string", "no", "equals", "C", "SEE")]}


def test_sets_are_independent_and_scanned_once(cells):
    both = apply_quality_sets(cells, SETS)
    for name, rules in SETS.items():
        assert values(both.where(f"ruleset = '{name}'").drop("ruleset")) == values(apply_quality(cells, rules))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_cumulative_sets_build_on_each_other(cells):
    second = apply_quality_sets(cells, SETS, cumulative=True).where("ruleset = 'second'")
    assert column_of(second, "n") == ["NONE", "NONE", "1", "NONE", "NONE"]


def test_golden_rule_files(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("attribute;type;not;condition;value;message\nn;integer;no;empty;;START MISSING\nn;integer;yes;range;(1, 100);OUT\ns;string;yes;contains;A;NOT A\n")
    from rulemill import read_rules

    rules = read_rules(spark, str(path), "quality")
    rules = [tuple(r.values())[1:] for r in rules]
    df = spark.createDataFrame(CELLS, "id string, n string, s string")
    assert column_of(apply_quality(df, rules), "n") == ["5", "START MISSING", "1", "START MISSING", "OUT"]


def test_float_thresholds_compare_as_floats(spark):
    from rulemill import query, violations

    rows = spark.createDataFrame([(i, t, float(t)) for i, t in enumerate(["0.1", "0.15", "0.2", "0.25"])], "id int, t string, d double")
    rows = rows.withColumn("f", rows["t"].cast("float"))
    for column in ("t", "f", "d"):
        rules = [(column, "float", "no", "=", "0.1", "eq"), (column, "float", "no", "range", "(0.1, 0.2)", "in"), (column, "float", "no", ">=", "0.2", "ge")]
        found = {}
        for r in violations(rows, rules, ["id"]).collect():
            found.setdefault(r["message"], set()).add(r["id"])
        assert found == {"eq": {0}, "in": {0, 1, 2}, "ge": {2, 3}}
    assert [r["id"] for r in query(rows, [("no", None, "f", "float", "=", "0.2")]).collect()] == [2]
