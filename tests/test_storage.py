import datetime

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from rulemill import NestingSpec, RuleError, Values, nest, read_rules
from rulemill.functions.stamps import format_stamp, parse_stamp, result_name, stamp_date, stamp_time, stem, trailing_number
from rulemill.plans.pipeline import Source, integrate, recheck_run, run_query, source_problems, store_run, variants_of_release
from rulemill.sources import sinks, storage
from rulemill.sources.catalog import dataset_catalog, job_catalog, latest_number, rule_catalog
from rulemill.sources.csv import all_text, read_csv, rule_column, with_source_path
from rulemill.streaming.files import process_available, stream_csv
from rulemill.variants.schema import VARIANT_COLUMNS
from tests.conftest import values
from tests.test_variants import RELEASE

ODD = [('a;"b"', "é, ü", "1"), ("x", None, "2"), ("back\\slash", " padded ", "3")]


def test_csv_cells_survive(spark, text_frame, tmp_path):
    df = text_frame(["a", "b", "c"], ODD)
    sinks.write_csv(df, str(tmp_path / "out"), files=1)
    assert values(read_csv(spark, str(tmp_path / "out"))) == values(df)
    assert values(read_csv(spark, str(tmp_path / "out"), columns=["a", "b", "c"])) == values(df)
    lines = text_frame(["a"], [("two\nlines",)])
    sinks.write_csv(lines, str(tmp_path / "lines"))
    assert values(read_csv(spark, str(tmp_path / "lines"), multi_line=True)) == [("two\nlines",)]


def test_other_encodings_and_paths(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("a;b\né;1\n".encode("latin-1"))
    df = read_csv(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1")
    assert values(df) == [("é", "1")] and with_source_path(df).first().path.endswith("latin.csv")


def test_typed_tables_as_text(spark):
    df = spark.sql("select 1 a, true b, array(1, 2) c, cast(null as int) d")
    assert [tuple(r) for r in all_text(df).collect()] == [("1", "true", "[1,2]", None)]


def test_json_lines_keep_nulls(spark, tmp_path):
    nested = nest(spark.sql("select 'k' k, cast(null as string) v"), NestingSpec("k", values=(Values("vs", "v"),)))
    sinks.write_json(nested, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"k":"k","vs":null}'


def test_numbered_results(spark, tmp_path):
    base = str(tmp_path / "results")
    with pytest.raises(FileNotFoundError):
        sinks.latest_run_path(spark, base, sinks.RESULT)
    paths = [sinks.write_numbered_csv(spark.range(i + 1), base) for i in range(11)]
    assert paths[-1].endswith("query_result_11") and sinks.latest_run(spark, base, sinks.RESULT) == 11
    assert sinks.read_result(spark, base).count() == 11 and sinks.read_result(spark, base, 2).count() == 2
    names = spark.createDataFrame([("query_result_9.csv",), ("query_result_10.csv",), ("other",)], "name string")
    assert latest_number(names).first().latest == 10


def test_export_forms(spark, text_frame, tmp_path):
    base, spec = str(tmp_path / "results"), NestingSpec("k", values=(Values("vs", "v"),))
    sinks.write_numbered_csv(text_frame(["k", "v"], [("b", "1"), ("a", "2"), ("b", "3")]), base)
    sinks.export_result(spark, base, str(tmp_path / "j"), "json", spec)
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":"a","vs":["2"]}', '{"k":"b","vs":["1","3"]}']
    sinks.export_result(spark, base, str(tmp_path / "c"))
    assert read_csv(spark, str(tmp_path / "c")).count() == 3
    for bad in ({"form": "json"}, {"form": "xml"}):
        with pytest.raises(ValueError):
            sinks.export_result(spark, base, str(tmp_path / "x"), **bad)


def test_names_and_stamps(spark):
    row = spark.sql("select '31_12_2022 10_11_12' s, 'query_rule_10.csv' n, timestamp'2022-07-01 10:00:00' t, 'x' bad").select(
        stamp_date(F.col("s")).alias("date"), stamp_time(F.col("s")).alias("time"), parse_stamp(F.col("s")).alias("at"),
        parse_stamp(F.col("bad")).alias("none"), format_stamp(F.col("t")).alias("summer"), trailing_number(F.col("n")).alias("number"),
        result_name(F.col("n")).alias("result"), stem(F.lit("/a/b/rules.v1.csv")).alias("stem"),
    ).first()
    assert tuple(row) == ("31/12/2022", "10:11:12", datetime.datetime(2022, 12, 31, 10, 11, 12), None, "01_07_2022 11_00_00", 10, "query_result_10.csv", "rules.v1")


def test_catalogs(spark, tmp_path):
    for folder, name in (("1", "One"), ("2", "Two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "databaseName.csv").write_text(f"databaseName\n{name}\n")
        (tmp_path / folder / "mapping_rules.csv").write_text("attribute;name of column\n")
        (tmp_path / folder / f"data {folder}.csv").write_text("a\n")
    (tmp_path / "quality_rules").mkdir()
    (tmp_path / "quality_rules" / "q.csv").write_text("x\n")
    found = values(dataset_catalog(spark, str(tmp_path)), "dataset", "path")
    assert [(d, p.split("/")[-2]) for d, p in found] == [("One", "1"), ("Two", "2")]
    assert values(rule_catalog(spark, str(tmp_path / "quality_rules")), "name") == [("q.csv",)]


GENES = "Gene;Position;Kind\nBRCA1;NC_000001.10:g.11076931C>T;chr1\nTP53;x;chr17\n;5;chr2\n"
OTHER = "symbol;kind\nBRCA1;1\nBRCA1;1\nABC;9\n"


@pytest.fixture
def sources(spark, tmp_path):
    (tmp_path / "genes.csv").write_text(GENES)
    (tmp_path / "other.csv").write_text(OTHER)
    (tmp_path / "map.csv").write_text("attribute;name of column\ngene;Gene\nstart;Position\nchromosome;Kind\nvariant_id;Gene\nhgvs;Not there\n")
    (tmp_path / "t.csv").write_text("attribute;function;regular expression;replacement\nchromosome;replace;^chr;\nstart;extract;g\\.([0-9]+);\ngene;fill na;;unknown\nnone;fill na;;x\n")
    mapping, transforms = (read_rules(spark, str(tmp_path / f), k) for f, k in (("map.csv", "mapping"), ("t.csv", "transformation")))
    assert rule_column(mapping, "attribute")[0] == "gene"
    rows = lambda rules: [tuple(r.values())[1:] for r in rules]
    return [
        Source(read_csv(spark, str(tmp_path / "genes.csv")), rows(mapping), rows(transforms), "genes"),
        Source(read_csv(spark, str(tmp_path / "other.csv")), [("gene", "symbol"), ("chromosome", "kind"), ("variant_id", "symbol")], [], "other"),
    ]


def test_integration_is_one_lazy_plan(sources):
    united = integrate(sources)
    assert tuple(united.columns) == VARIANT_COLUMNS and united.count() == 6
    assert values(united, "gene", "start") == [("ABC", None), ("BRCA1", None), ("BRCA1", None), ("BRCA1", "11076931"), ("TP53", "x"), ("unknown", "5")]
    found = integrate(sources, parameter="GENE", value="BRCA1")
    assert values(found, "chromosome") == [("1",), ("1",), ("1",)]
    assert source_problems(sources) == [("genes", 4, "none", "no column none")]


def test_cells_are_cleaned_unless_told_otherwise(spark, text_frame):
    raw = text_frame(["g"], [(" chr1 ",), ("\t",), ("chr ",)])
    rules = [("g", "replace", "^chr", None)]
    assert values(integrate([Source(raw, None, rules)], ["g"])) == [(None,), (None,), ("1",)]
    assert values(integrate([Source(raw, None, rules, clean=False)], ["g"])) == [("\t",), (" ",), (" chr1 ",)]


def test_a_search_on_a_clean_columnar_source_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("cast(id as string) a", "'x' b", "'y' unused").write.parquet(path)
    stored = Source(spark.read.parquet(path), [("gene", "a"), ("hgvs", "b")], [("hgvs", "replace", "x", "z")], clean=False)
    plan = integrate([stored], ["gene", "hgvs"], "GENE", "7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,7)" in plan and "unused" not in plan[plan.index("ReadSchema"):]


QUALITY = {
    "starts": [("start", "integer", "no", "empty", None, "NO START")],
    "genes": [("gene", "string", "no", "equals", "BRCA1", "CHECK")],
}


def test_a_stored_run_and_its_recheck(spark, sources, tmp_path):
    base = str(tmp_path / "jobs")
    info = sinks.run_metadata(spark, ["One", "Two"], "local", ["genes.csv", "other.csv"], "gene", "BRCA1")
    first = store_run(integrate(sources, parameter="gene", value="BRCA1"), base, "01_02_2023 10_11_12", info, QUALITY)
    assert first.endswith("job_1/result/01_02_2023 10_11_12")
    second = store_run(integrate(sources, parameter="gene", value="ABC"), base, "02_02_2023 10_11_12", info)
    assert "/job_2/" in second
    with pytest.raises(RuleError, match="nothing matches"):
        store_run(integrate(sources, parameter="gene", value="none"), base, "03_02_2023 10_11_12", info)
    assert read_csv(spark, f"{base}/job_1/treated_file.csv").count() == 3
    record = spark.read.json(f"{base}/job_1/treated_file.json").first()
    assert (record.variant_id, record.genes) == ("BRCA1", ["BRCA1"])
    flagged = {r.ruleset: r for r in spark.read.json(f"{first}/quality.json").collect()}
    assert set(flagged) == {"starts", "genes"} and flagged["genes"].genes == ["CHECK"]

    again = recheck_run(spark, f"{base}/job_2", "02_02_2023 10_11_12", "04_02_2023 10_11_12", {"starts": QUALITY["starts"]})
    assert spark.read.json(f"{again}/quality.json").count() == 1
    runs = job_catalog(spark, base)
    assert values(runs, "job", "date", "time", "type", "quality_rules", "sources") == [
        ("job_1", "01/02/2023", "10:11:12", "local", "starts, genes", "One, Two"),
        ("job_2", "02/02/2023", "10:11:12", "local", None, "One, Two"),
        ("job_2", "04/02/2023", "10:11:12", "local", "starts", "One, Two"),
    ]
    assert runs.where("finished_at is null").count() == 0


def test_a_stored_query(spark, sources, tmp_path):
    rules = [("no", "and", "gene", "string", "=", "BRCA1"), ("no", None, "start", "integer", "is not null", None)]
    path, shown = run_query(integrate(sources), rules, str(tmp_path / "results"))
    assert path.endswith("query_result_1") and shown.columns == ["variant_id", "chromosome", "gene", "start"]


def test_a_release_job(spark, text_frame, tmp_path):
    (tmp_path / "release.xml").write_text(RELEASE)
    dates = text_frame(["assembly", "assembly_date"], [("GRCh38", "2013")])
    found = variants_of_release(spark, str(tmp_path / "release.xml"), "migraine, aura", version=F.lit("5"), assemblies=dates)
    assert {(r.variant_id, r.assembly, r.assembly_date, r.version) for r in found.collect()} == {("VCV1", "GRCh38", "2013", "5"), ("VCV1", "GRCh37", None, "5")}
    info = sinks.run_metadata(spark, ["ClinVar"], "external", ["migraine_with_aura"], "gene", "BRCA1")
    run = store_run(found, str(tmp_path / "jobs"), "01_02_2023 10_11_12", info)
    assert read_csv(spark, f"{run}/search_info.csv", sep=",").first()["filenames/phenotype"] == "migraine_with_aura"


def test_streams_give_what_batches_give(spark, text_frame, tmp_path):
    from rulemill import apply_quality, apply_transforms, map_columns, query, unite

    def plan(df):
        mapped = map_columns(df, [("gene", "Gene"), ("start", "Position"), ("none", "x")])
        cleaned = apply_transforms(mapped, [("start", "extract", r"g\.([0-9]+)", None)])
        found = query(unite([cleaned, cleaned]), [("no", None, "gene", "string", "!=", "x")])
        return apply_quality(found, [("start", "integer", "no", "empty", None, "NO START")])

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(GENES)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    columns = ["Gene", "Position", "Kind"]
    process_available(stream_csv(spark, str(tmp_path / "in"), columns), plan, out, state)
    batch = plan(read_csv(spark, str(tmp_path / "in")))
    assert values(spark.read.parquet(out)) == values(batch) and batch.count() == 4
    (tmp_path / "in" / "2.csv").write_text("Gene;Position;Kind\nNEW;1;2\n")
    process_available(stream_csv(spark, str(tmp_path / "in"), columns), plan, out, state)
    assert spark.read.parquet(out).count() == 6


def test_stored_results_keep_any_cell(spark, tmp_path):
    from rulemill.plans.pipeline import run_query

    cells = ["line one\nline two", 'a;b "c"', "x\r\ny", "'", "\\", "tail\n"]
    frame = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "id string, cell string")
    _, found = run_query(frame, [("no", None, "id", "string", "is not null", None)], str(tmp_path / "r"))
    assert sorted(r["cell"] for r in found.collect()) == sorted(cells)
    assert sorted(r["cell"] for r in sinks.read_result(spark, str(tmp_path / "r")).collect()) == sorted(cells)


def test_an_empty_run_leaves_no_job(spark, tmp_path):
    empty = spark.createDataFrame([], "variant_id string")
    info = sinks.run_metadata(spark, ["One"], "local", ["x"], "gene", "Z")
    with pytest.raises(RuleError):
        store_run(empty, str(tmp_path / "jobs"), "01_02_2023 10_11_12", info)
    assert sinks.latest_run(spark, str(tmp_path / "jobs"), sinks.JOB) == 0


def test_union_of_other_types_and_folders_with_blanks(spark, tmp_path):
    from rulemill.operators.integrate import unite
    from rulemill.sources.catalog import dataset_catalog, latest_number, read_folder

    one, two = spark.createDataFrame([(1, 2)], "k int, n int"), spark.createDataFrame([("x1",)], "k string")
    united = unite([one, two], ["k", "n", "m"])
    assert sorted(map(tuple, united.collect()), key=str) == [("1", 2, None), ("x1", None, None)] and dict(united.dtypes)["n"] == "int"
    for name in ("my data", "a+b%20c"):
        folder = tmp_path / "sets" / name
        folder.mkdir(parents=True)
        (folder / "databaseName.csv").write_text(f"databaseName\n{name}\n")
        (folder / "rows.csv").write_text("a;b\n1;2\n")
    got = dataset_catalog(spark, str(tmp_path / "sets")).collect()
    assert sorted(r["dataset"] for r in got) == ["a+b%20c", "my data"] and all(r["path"].endswith("/rows.csv") for r in got)
    many = tmp_path / "many"
    many.mkdir()
    for i in range(9):
        (many / f"s{i}.csv").write_text(f"k;v\n{i};x\n" if i % 2 else f"v;k\nx;{i}\n")
    sources = read_folder(spark, str(many), ["k", "v"])
    assert sorted(r["k"] for r in sources.collect()) == [str(i) for i in range(9)] and {r["v"] for r in sources.collect()} == {"x"}
    names = spark.createDataFrame([("job_20260101123000",), ("job_7",)], "name string")
    assert latest_number(names).first()[0] == 20260101123000


def test_a_repeated_lookup_key_is_an_error(spark):
    from rulemill.operators.merging import lookup

    facts, names = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (2, None)], "k int, name string")
    assert sorted(map(tuple, lookup(facts, names, "k").collect())) == [(1, "a"), (2, None), (3, None)]
    with pytest.raises(Exception, match="repeated lookup key"):
        lookup(facts, names.union(names), "k").collect()


def test_a_stored_run_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Spark removes the shuffle files of each table when it is written, and a write shuffles for one rule set only. Before, all stayed on disk."""
    rows = spark.range(200).selectExpr("concat('v', id % 40) AS variant_id", "concat('G', id % 7) AS gene", "'GRCh38' AS assembly")
    info = sinks.run_metadata(spark, ["a"], "local", ["a.csv"], "gene", "all")
    rule_sets = {"b/c": [("gene", "string", "no", "equals", "G3", "THIRD")], "d": [("gene", "string", "no", "equals", "G4", "FOURTH")]}
    dropped, write = [], DataFrameWriter.json
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, *given: dropped.append(spark.conf.get(storage._CLEANUP, "false")) or write(self, *given))
    result = store_run(rows, str(tmp_path / "jobs"), "01_02_2023 10_11_12", info, rule_sets)
    assert dropped == ["true"] * 3 and storage._CLEANUP not in spark.conf.getAll
    flagged = spark.read.schema("variant_id string, genes array<string>, ruleset string").json(f"{result}/quality.json")
    got = {(r["ruleset"], g) for r in flagged.collect() for g in r["genes"]}
    assert got == {("b/c", "THIRD" if i == 3 else f"G{i}") for i in range(7)} | {("d", "FOURTH" if i == 4 else f"G{i}") for i in range(7)}
    assert flagged.count() == 80
