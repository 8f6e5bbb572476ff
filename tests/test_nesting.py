from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rulemill import Group, NestingSpec, RuleError, Structs, Values, flatten, flatten_branch, flatten_cut, nest
from rulemill.variants.schema import VARIANT_COLUMNS, VARIANT_SPEC
from tests.conftest import values


def variant(**cells):
    return tuple(cells.get(c) for c in VARIANT_COLUMNS)


def variants(spark, *rows):
    schema = ", ".join(f"`{c}` string" for c in VARIANT_COLUMNS)
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def records(df):
    return {r.variant_id: r.asDict(recursive=True) for r in df.collect()}


def test_the_record_shape(spark):
    nested = nest(variants(spark, variant(variant_id="v")), VARIANT_SPEC)
    types = {f.name: f.dataType.simpleString() for f in nested.schema}
    assert types["genes"] == types["hgvs"] == "array<string>"
    assert types["assembly"] == "array<struct<assembly:string,date:string,start:string,end:string,ref:string,alt:string,risk_allele:string>>"
    assert types["databanks"] == "array<struct<name:string,url:string,version:string,variant_id:string,clinvar_accession:string>>"
    assert types["phenotypes"].startswith("array<struct<phenotype:string,clinical_actionability:string,classification:string,interpretation:array<")
    assert len(nested.columns) == 12


def test_scalars_take_the_last_distinct_value(spark):
    rows = [variant(variant_id="v", variant_name=n) for n in ("a", "b", "a")] + [variant(variant_id="w", variant_name=n) for n in ("a", None)]
    found = records(nest(variants(spark, *rows), VARIANT_SPEC))
    assert found["v"]["variant_name"] == "b" and found["w"]["variant_name"] is None


def test_lists_are_distinct_sorted_and_null_when_empty(spark):
    rows = [variant(variant_id="v", gene=g) for g in ("b", "a", None, "b")] + [variant(variant_id="w"), variant(gene="lost")]
    found = records(nest(variants(spark, *rows), VARIANT_SPEC))
    assert found["v"]["genes"] == ["a", "b"] and found["w"]["genes"] is None and set(found) == {"v", "w"}


def test_struct_lists_follow_lead_then_first_appearance(spark):
    rows = [variant(variant_id="v", assembly=a, start=s) for a, s in (("h38", "9"), ("h37", "2"), ("h37", "1"), ("h38", "9"), (None, "5"))]
    found = records(nest(variants(spark, *rows), VARIANT_SPEC))["v"]["assembly"]
    assert [(x["assembly"], x["start"]) for x in found] == [("h37", "2"), ("h37", "1"), ("h38", "9")]
    assert set(found[0]) == {"assembly", "date", "start", "end", "ref", "alt", "risk_allele"}


def test_all_null_tuples_are_dropped_and_do_not_reset_the_list(spark):
    rows = [variant(variant_id="v", phenotype="P", method="m1"), variant(variant_id="v", phenotype="P"), variant(variant_id="v", phenotype="P", method="m0"), variant(variant_id="v", phenotype="Q")]
    p, q = records(nest(variants(spark, *rows), VARIANT_SPEC))["v"]["phenotypes"]
    assert [i["method"] for i in p["interpretation"]] == ["m1", "m0"] and p["bibliography"] is None
    assert q["interpretation"] is None and (p["phenotype"], q["phenotype"]) == ("P", "Q")


def test_group_scalars_are_per_group(spark):
    rows = [variant(variant_id="v", phenotype=p, classification=c) for p, c in (("P", "1"), ("Q", "2"), ("P", "3"), ("P", "1"))]
    found = records(nest(variants(spark, *rows), VARIANT_SPEC))["v"]["phenotypes"]
    assert [(p["phenotype"], p["classification"]) for p in found] == [("P", "3"), ("Q", "2")]


def test_missing_columns_are_left_out_and_a_missing_key_is_an_error(spark):
    df = spark.sql("select 'v' variant_id, 'G' gene, 'h' assembly, '5' start")
    nested = nest(df, VARIANT_SPEC)
    assert nested.columns == ["variant_id", "genes", "assembly"]
    assert nested.schema["assembly"].dataType.elementType.names == ["assembly", "start"]
    with pytest.raises(RuleError):
        nest(df.drop("variant_id"), VARIANT_SPEC)


def test_order_column_decides_first_appearance(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("k", "b", 3)], "k string, v string, pos int")
    spec = NestingSpec("k", scalars=(("last", "v"),), structs=(Structs("s", (("v", "v"),)),))
    row = nest(df, spec, order_by="pos").first()
    assert row.last == "b" and [x.v for x in row.s] == ["a", "b"]


def test_within_keeps_copies_apart(spark):
    df = spark.createDataFrame([("a", "k", "x"), ("b", "k", "y")], "copy string, k string, v string")
    nested = nest(df, NestingSpec("k", values=(Values("vs", "v"),)), within=["copy"])
    assert values(nested.select("copy", "k", F.array_join("vs", ",").alias("vs"))) == [("a", "k", "x"), ("b", "k", "y")]


DEEP = NestingSpec(
    "k",
    scalars=(("s", "s"),),
    values=(Values("vs", "v"),),
    groups=(Group("gs", ("g", "g"), scalars=(("gscalar", "h"),), values=(Values("hs", "h"),), structs=(Structs("ts", (("a", "a"), ("b", "b"))),)),),
)


def deep_rows(spark, n=400, keys=3):
    return spark.range(n).select(
        (F.col("id") % keys).cast("string").alias("k"), F.lit("s").alias("s"), (F.col("id") % 50).cast("string").alias("v"),
        (F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 11).cast("string").alias("h"),
        (F.col("id") % 5).alias("a"), (F.col("id") % 13).alias("b"), "id",
    )


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_records_in_parts_hold_every_child_once(spark, parts):
    nested = nest(deep_rows(spark), DEEP, order_by="id", parts=parts)
    assert ("_part" in nested.columns) == (parts > 1)
    nested = (nested if parts > 1 else nested.withColumn("_part", F.lit(0))).withColumnRenamed("_part", "part").cache()
    rows = deep_rows(spark)
    assert values(nested.select("k", F.explode("vs").alias("v"))) == values(rows.select("k", "v").distinct())
    groups = nested.select("k", "part", F.inline("gs"))
    assert values(groups.select("k", "g", F.inline("ts"))) == values(rows.select("k", "g", "a", "b").distinct())
    assert values(groups.select("k", "g", F.explode("hs").alias("h"))) == values(rows.select("k", "g", "h").distinct())
    assert values(nested.where("part = 0").select("k", "s")) == [("0", "s"), ("1", "s"), ("2", "s")]
    assert nested.groupBy("k", "part").count().where("count > 1").count() == 0
    assert 3 <= nested.count() <= 3 * parts
    nested.unpersist()


def test_parts_stay_small_for_a_hot_key(spark):
    """One key has a third of all rows."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("k"), F.col("id").alias("v")
    )
    spec = NestingSpec("k", structs=(Structs("items", (("v", "v"),)),))
    nested = nest(rows, spec, order_by="v", parts=10)
    sizes = nested.where("k = 'hot'").select(F.size("items").alias("n")).where("n > 0").agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] < 1400 and sizes[1] == 10_000


@pytest.mark.parametrize(
    "spec",
    [
        NestingSpec("k", values=(Values("vs", "v"),)),
        NestingSpec("k", structs=(Structs("ts", (("a", "a"), ("b", "b")), lead="a"),)),
        NestingSpec("k", scalars=(("s", "s"),), values=(Values("vs", "v"),), structs=(Structs("ts", (("a", "a"), ("b", "b"))),)),
        NestingSpec("k", groups=(Group("gs", ("g", "g"), values=(Values("hs", "h"),)),)),
        NestingSpec("k", groups=(Group("gs", ("g", "g")),)),
    ],
    ids=["values", "structs", "all", "group", "bare group"],
)
def test_one_scan_and_no_broadcast(spark, tmp_path, spec):
    path = str(tmp_path / "t")
    deep_rows(spark).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = nest(spark.read.parquet(path), spec, order_by="id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan


def test_specs_without_own_lists(spark, tmp_path):
    df = spark.createDataFrame([("k", "g", 1), ("k", "h", 2), ("l", None, 3), (None, "g", 4)], "k string, g string, v int")
    assert values(nest(df, NestingSpec("k"))) == [("k",), ("l",)]
    bare = nest(df, NestingSpec("k", groups=(Group("gs", ("g", "g")),)))
    assert {r.k: [g.g for g in r.gs or []] for r in bare.collect()} == {"k": ["g", "h"], "l": []}
    two = NestingSpec("k", groups=(Group("gs", ("g", "g"), values=(Values("vs", "v"),)), Group("ws", ("w", "v"))))
    found = {r.k: ([(g.g, g.vs) for g in r.gs or []], [w.w for w in r.ws]) for r in nest(df, two).collect()}
    assert found == {"k": ([("g", [1]), ("h", [2])], [1, 2]), "l": ([], [3])}


@pytest.mark.parametrize("parts, scans", [(1, 1), (3, 1)])
def test_groups_need_one_scan(spark, tmp_path, parts, scans):
    path = str(tmp_path / "t")
    deep_rows(spark).write.parquet(path)
    only = NestingSpec("k", groups=DEEP.groups)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = nest(spark.read.parquet(path), only, order_by="id", parts=parts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == scans


def test_three_levels(spark):
    deep = Group("as", ("a", "a"), values=(Values("bs", "b"),))
    spec = NestingSpec("k", groups=(Group("gs", ("g", "g"), groups=(deep,)),))
    nested = nest(deep_rows(spark), spec, order_by="id", parts=20)
    flat = nested.select("k", F.inline("gs")).select("k", "g", F.inline("as")).select("k", "g", "a", F.explode("bs").alias("b"))
    assert values(flat) == values(deep_rows(spark).select("k", "g", "a", "b").distinct())


def test_the_number_of_parts_does_not_depend_on_the_data(spark):
    spec = NestingSpec("k", values=(Values("vs", "v"),))
    few = nest(deep_rows(spark, n=6), spec, order_by="id", parts=5)
    assert few.columns == nest(deep_rows(spark), spec, order_by="id", parts=5).columns == ["k", "_part", "vs"]
    nested = nest(deep_rows(spark), spec, order_by="id", parts=5)
    assert {r[0] for r in nested.select("_part").collect()} == set(range(5))
    with pytest.raises(ValueError):
        nest(deep_rows(spark), spec, parts=0)
    assert values(nested.select("k", F.explode("vs").alias("v"))) == values(deep_rows(spark).select("k", "v").distinct())


def test_flatten_multiplies_branches_and_keeps_empty_ones(spark):
    nested = spark.sql("""
      select 'k' variant_id, array('a', 'b') genes, array('h1', 'h2', 'h3') hgvs union all
      select 'l', array(), null""")
    spec = NestingSpec("variant_id", values=VARIANT_SPEC.values)
    flat = flatten(nested, spec)
    assert flat.columns == ["variant_id", "gene", "hgvs"] and flat.where("variant_id = 'k'").count() == 6
    assert values(flat.where("variant_id = 'l'")) == [("l", None, None)]


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_large_records_are_flattened_by_several_tasks(spark, limit):
    with pytest.raises(RuleError):
        flatten(nest(deep_rows(spark), DEEP, order_by="id"), DEEP)
    spec = NestingSpec("k", DEEP.scalars, DEEP.values, groups=(replace(DEEP.groups[0], scalars=()),))
    nested = nest(deep_rows(spark, n=120, keys=2), spec, order_by="id")
    more = spark.sql("select 'e' k, 's' s, cast(null as array<string>) vs").unionByName(nested.limit(0), allowMissingColumns=True)
    united = more.select(*nested.columns).unionByName(nested)
    flat = flatten(united, spec)
    assert flat.where("k = 'e'").count() == 1
    assert flat.exceptAll(flatten(united, spec, split_over=limit)).count() == 0
    assert flatten(united, spec, split_over=limit).count() == flat.count()


@pytest.mark.parametrize("parts", [1, 2, 6])
def test_records_in_parts_flatten_to_every_combination(spark, parts):
    group = replace(DEEP.groups[0], scalars=(("flag", "flag"),), structs=(Structs("ts", (("a", "a"),)),))
    spec = NestingSpec("k", DEEP.scalars, DEEP.values, groups=(group,))
    rows = deep_rows(spark, n=60, keys=2).withColumn("flag", F.concat("k", "g"))
    bare = rows.limit(1).withColumns({"k": F.lit("bare"), "g": F.lit(None).cast("string"), "v": F.lit(None).cast("string")})
    rows = rows.unionByName(bare)
    whole = flatten(nest(rows, spec, order_by="id"), spec)
    nested = nest(rows, spec, order_by="id", parts=parts)
    for cut in (flatten(nested, spec), flatten_cut(nested, spec)):
        assert cut.columns == whole.columns and values(cut) == values(whole)
    one = flatten_branch(nested, spec, "vs").where("v is not null")
    assert values(one) == values(whole.select("k", "v").where("v is not null").distinct())


def test_slices_of_one_record_reach_several_tasks(spark):
    spec = NestingSpec("k", values=(Values("vs", "v"), Values("ws", "w")))
    one = spark.range(1).selectExpr("'k' as k", "sequence(1, 100) as vs", "sequence(1, 1000) as ws")
    flat = flatten(one, spec, split_over=1000).withColumn("task", F.spark_partition_id())
    assert flat.count() == 100_000 and flat.select("k", "v", "w").distinct().count() == 100_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert flat.select("task").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_flat_tables_have_the_fixed_columns(spark):
    rows = [variant(variant_id="v", variant_name="n", gene="g", hgvs="h", assembly="a", assembly_date="d", start="1", phenotype="p",
                    classification="c", method="m", date="2020", title="t", name="bank", databanks_variant_id="7")]
    flat = flatten(nest(variants(spark, *rows), VARIANT_SPEC), VARIANT_SPEC)
    assert tuple(flat.columns) == VARIANT_COLUMNS and [tuple(r) for r in flat.collect()] == rows


def test_one_branch_alone(spark):
    nested = nest(variants(spark, variant(variant_id="v", gene="g", assembly="a"), variant(variant_id="v", gene="h")), VARIANT_SPEC)
    assert values(flatten_branch(nested, VARIANT_SPEC, "genes")) == [("v", "g"), ("v", "h")]
    with pytest.raises(ValueError):
        flatten_branch(nested, VARIANT_SPEC, "none")


cell = st.sampled_from([None, "a", "b", "c"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "k1", "k2"]), st.sampled_from("abc"), cell), min_size=1, max_size=12))
def test_flatten_of_nest_is_the_distinct_input(spark, rows):
    """One multi-valued branch, scalars that depend on the key."""
    df = spark.createDataFrame([(k, k and k + "s", a, b) for k, a, b in rows], "k string, s string, a string, b string")
    spec = NestingSpec("k", scalars=(("s", "s"),), structs=(Structs("items", (("a", "a"), ("b", "b"))),))
    assert values(flatten(nest(df, spec), spec)) == values(df.where("k is not null").distinct())


def expected_last(rows):
    seen = {}
    for key, value in rows:
        seen.setdefault(key, [])
        if value not in seen[key]:
            seen[key].append(value)
    return {k: v[-1] for k, v in seen.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), cell), min_size=1, max_size=15))
def test_last_distinct_equals_a_plain_loop(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, k string, v string").repartition(3)
    nested = nest(df, NestingSpec("k", scalars=(("v", "v"),)), order_by="pos")
    assert {r.k: r.v for r in nested.collect()} == expected_last(rows)
