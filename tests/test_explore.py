import pytest
from pyspark.sql import functions as F

from rulemill import drop_all_null, keyword_search, ordinals, page, page_info, row_ids
from rulemill.operators import explore, ranges
from rulemill.operators.explore import keyword_hits
from rulemill.sources.storage import ensure_checkpoint_dir, scratch_path
from tests.conftest import values


def test_empty_columns_are_dropped(text_frame):
    df = text_frame(["a", "empty", "b"], [("1", None, None), (None, None, "2")])
    assert drop_all_null(df).columns == ["a", "b"]


def test_keyword_in_any_cell(spark):
    df = spark.createDataFrame([(1, "Red Bolt"), (2, "blue"), (12, None)], "n int, s string")
    assert values(keyword_search(df, "rED"), "n") == [(1,)] and {r.n for r in keyword_search(df, "2").collect()} == {2, 12}
    assert keyword_search(df, "50%").count() == 0


def test_many_keywords_in_all_cells(spark):
    cells = [(1, "Red Bolt", "x"), (2, "", None), (3, None, "é a"), (4, "aaa", "A"), (4, "aaa", "A"), (5, "50%", "a b c")]
    words = ["red", "BOLT", "d b", "a", "aa", "aaaa", "É", "", None, "%", "a", "nothing", "c"]
    df = spark.createDataFrame(cells, "id int, s string, t string").repartition(3)
    found = keyword_hits(df, spark.createDataFrame([(w,) for w in words], "keyword string"), ["id"])
    distinct = {w for w in words if w}
    want = [(r[0], name, w) for r in cells for name, text in (("s", r[1]), ("t", r[2])) if text for w in distinct if w.lower() in text.lower()]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert keyword_hits(df, spark.createDataFrame([], "keyword string"), ["id"]).collect() == []


def test_row_ids_are_unique_and_increasing(spark):
    ids = [r.id for r in row_ids(spark.range(100).select(F.col("id").alias("v"))).collect()]
    assert len(set(ids)) == 100 and ids == sorted(ids)


def test_ordinals_are_dense_over_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    numbered = ordinals(df, [F.desc("v")], "n")
    assert [(r.v, r.n) for r in numbered.orderBy("n").collect()] == [(999 - i, i + 1) for i in range(1000)]


@pytest.mark.parametrize("rows_of_a_range", [20_000, 4])
def test_pages(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ranges, "ROWS", rows_of_a_range)
    df = spark.range(53).repartition(5)
    assert [r.id for r in page(df, ["id"], 3, 20).collect()] == list(range(40, 53))
    assert [r.id for r in page(df, ["id"], 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert page(df, ["id"], 9, 20).collect() == [] and page(df.limit(0), ["id"], 1, 5).collect() == []
    assert page(df, ["id"], size=None).count() == 53
    with pytest.raises(ValueError):
        page(df, ["id"], 0, 5)


ORDERS = [
    lambda: ["a"], lambda: [F.desc("a"), "b"], lambda: [F.asc_nulls_last("a"), F.desc_nulls_first("b")], lambda: [F.col("t").desc(), F.col("b") % 3],
    lambda: [F.lower("s"), "d"],
]


@pytest.mark.parametrize("make", ORDERS, ids=range(len(ORDERS)))
def test_pages_and_numbers_over_any_order(spark, monkeypatch, make):
    """Every page of every order, with NULLs, ties, one key in a third of the rows and rows that are equal in all columns."""
    monkeypatch.setattr(ranges, "ROWS", 5)
    monkeypatch.setattr(ranges, "BOUNDS", 6)
    monkeypatch.setattr(ranges, "SAMPLE", 40)
    rows = [(None if i % 7 == 0 else 3 if i % 3 == 0 else i % 11, i % 13 if i % 5 else None, f"{'aB'[i % 2]}{i % 4}", i / 3 if i % 4 else float("nan")) for i in range(220)]
    df = spark.createDataFrame([*rows, *rows[:20]] + [(1, 1, "x", 0.5)] * 30, "a int, b int, s string, d double")
    df = df.withColumn("t", F.timestamp_micros(F.col("b") * 1_000_001)).repartition(3)
    key = lambda r: tuple(None if x is None else str(x) for x in r)
    order = make()
    keys = ranges.keys_of(df, order)
    ordered = [key(r) for r in df.orderBy(*[k.sorted() for k in keys]).collect()]
    assert [key(r)[:-1] for r in ordinals(df, order, "n", ranges=9).orderBy("n").collect()] == ordered
    assert [r.n for r in ordinals(df, order, "n", ranges=9).orderBy("n").collect()] == list(range(1, 271))
    for number, size in ((1, 8), (5, 8), (16, 16), (27, 10), (28, 10), (2, 150)):
        assert [key(r) for r in page(df, order, number, size).collect()] == ordered[(number - 1) * size : number * size]


def test_page_plan_reads_its_range(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 50)
    plan = page(spark.range(5000).withColumn("v", F.col("id") * 2), ["v"], 400, 10)._jdf.queryExecution().toString()
    assert "Filter" in plan and "Checkpoint" not in plan and "ExistingRDD" not in plan


def test_a_page_inside_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 5)
    monkeypatch.setattr(ranges, "SAMPLE", 8)
    df = spark.createDataFrame([(1,), (2,), *[(5,)] * 400, (9,), (10,)], "v int").repartition(4)
    want = sorted(r.v for r in df.collect())
    for number, size in ((1, 3), (20, 10), (41, 10), (134, 3), (135, 3)):
        assert [r.v for r in page(df, ["v"], number, size).collect()] == want[(number - 1) * size : number * size]


def test_orders_by_nested_values_are_refused(spark):
    with pytest.raises(ValueError):
        page(spark.sql("select array(1) x"), ["x"])


def test_page_lines(spark):
    df = spark.range(53)
    assert values(page_info(df, 3, 20)) == [(41, 53, 53)] and values(page_info(df, 1, None)) == [(1, 53, 53)]
    assert values(page_info(df, 9, 20)) == [(0, 0, 53)]


def test_scratch_folders_are_below_the_checkpoint_folder(spark):
    base = ensure_checkpoint_dir(spark)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(base.rstrip("/"))


def test_keywords_are_looked_for_once_in_every_distinct_word(spark, monkeypatch):
    searched, within = [], explore._containing
    monkeypatch.setattr(explore, "_containing", lambda texts, listed: searched.append(texts) or within(texts, listed))
    df = spark.createDataFrame([(i % 90, "Some words\tand\n others " * 20 + str(i % 3)) for i in range(100)], "id int, s string").repartition(3)
    found = keyword_hits(df, spark.createDataFrame([("WORD",), ("o",), ("2",)], "keyword string"), ["id"])
    assert found.count() == 100 + 100 + 33
    assert sorted(r[0] for r in searched[0].select("_text").collect()) == ["0", "1", "2", "and", "others", "some", "words"] and len(searched) == 1


def test_ordinals_make_more_ranges_of_larger_tables(spark, monkeypatch):
    """Before, the number of ranges was that of shuffle partitions, however many rows a task had to sort."""
    asked = []
    proposed = ranges.proposed
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    monkeypatch.setattr(ranges, "proposed", lambda rows, keys, n, total: asked.append(n) or proposed(rows, keys, n, total))
    df = spark.range(200).select((F.col("id") * 7 % 200).alias("k"))
    assert values(ordinals(df, ["k"], "n"), "k", "n") == sorted(((k, k + 1) for k in range(200)), key=lambda t: tuple((True, str(x)) for x in t))
    assert asked == [20]


def test_keywords_meet_cells_without_a_shuffle_of_these(spark, monkeypatch):
    """Before, every word of every cell was shuffled, and every hit of every word."""
    cells = [(i % 50, f"Word{i % 7} swordfish\tÄpfel 😀😀x wordless and\n{'y' * (i % 9)} word", None if i % 2 else "and ab") for i in range(200)]
    words = ["word", "WORDF", "swordfish", "äpfel", "😀x", "a", "an", "and", "yyyyyyy", "ab", "zz", "fish word"]
    df = spark.createDataFrame(cells, "id int, s string, t string").repartition(3)
    listed = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted((r[0], name, w) for r in cells for name, text in (("s", r[1]), ("t", r[2])) if text for w in words if w.lower() in text.lower())
    for block in (explore.BLOCK_KEYWORDS, 4):
        monkeypatch.setattr(explore, "BLOCK_KEYWORDS", block)
        assert sorted(map(tuple, keyword_hits(df, listed, ["id"]).collect())) == want
    monkeypatch.undo()
    found = keyword_hits(df, listed.where("keyword NOT LIKE '% %'"), ["id"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scans_of_cells = plan[: plan.index("BroadcastHashJoin")] + plan[plan.index("BroadcastHashJoin") :].split("\n")[0]
    assert "Exchange" not in scans_of_cells and "Aggregate" not in scans_of_cells
