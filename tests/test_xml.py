import pytest
from pyspark.sql import functions as F

from rulemill import flatten
from rulemill.variants import xml_rules
from rulemill.sources.xml import malformed_elements, read_elements, read_xml
from rulemill.plans.rules import RuleError
from rulemill.variants.schema import VARIANT_SPEC
from rulemill.variants.xml_rules import RuleSet, Step, Test as Condition, UnsupportedPath, extract_entities, read_by_rules, steps_of, structure_of
from tests.conftest import values

DOCUMENT = """<?xml version="1.0"?>
<Release note="<Variant>"><VariantCount>3</VariantCount>
<Variant id="1"><Name>n1</Name><Loc a="h38" s="1"/><Loc a="h37"><S>2</S></Loc>
 <Ph id="p1"><T>P &amp; Q; "x"</T></Ph><Ph id="p2"><T>Q</T></Ph><Ph id="p3"/>
 <I p="p1" sig="x"/><I p="p1" sig="y"/><I p="p2" sig="z"/><B of="p2"><Title>t</Title></B><G>g1</G><G>é</G><Deep><H>h1</H></Deep></Variant>
<Variant id="2" empty=""/><Variant id='3 > 2' x="/>"/>
<Variant
 id="4"><Alt>n4</Alt></Variant></Release>""".replace('note="<Variant>"', 'note="v"')

RULES = [
    ("variation", "", "./Variant", "Release", "", "", ""), ("variation", "variant_id", "", "Variant", "id", "", ""),
    ("variation", "variant_name", "./Name", "Variant", "", "", ""), ("variation", "variant_name", "./Alt", "Variant", "", "", ""),
    ("variation", "chromosome", "./Loc", "Variant", "a", "", ""), ("variation", "description", "", "Variant", "empty", "", ""),
    ("assembly", "", "./Other", "Variant", "", "", ""), ("assembly", "", "./Loc", "Variant", "", "", ""),
    ("assembly", "assembly", "", "Loc", "a", "", ""), ("assembly", "start", "", "Loc", "s", "", ""), ("assembly", "start", "./S", "Loc", "", "", ""),
    ("phenotype", "", "./Ph", "Variant", "", "", ""), ("phenotype", "phenotype", "./T", "Ph", "", "", ""), ("pkey", "", "", "Ph", "id", "", ""),
    ("interpretation", "", "./I[@p='<value>']", "Variant", "", "pkey", ""), ("interpretation", "clinical_significance", "", "I", "sig", "", ""),
    ("bibliography", "", "./B[@of='<value>']", "Variant", "", "pkey", ""), ("bibliography", "title", "./Title", "B", "", "", ""),
    ("gene", "", "./G", "Variant", "", "", ""), ("gene", "gene", "", "G", "", "", ""),
    ("hgvs", "", "./Deep/H", "Variant", "", "", ""), ("hgvs", "hgvs", "", "H", "", "", ""),
    ("databank", "", "./Name", "Variant", "", "", ""), ("databank", "name", "", "Name", "", "", "MyBank"),
]
# The same with a descendant path.
DEEP_RULES = [tuple(".//H" if v == "./Deep/H" else v for v in r) for r in RULES]


@pytest.fixture(scope="module")
def document(tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "release.xml"
    path.write_text(DOCUMENT, encoding="utf-8")
    return str(path)


def test_elements_are_cut_at_their_own_tags(spark, document):
    found = read_elements(spark, document, "Variant")
    ids = [r.i for r in found.select(F.xpath_string("xml", F.lit("/Variant/@id")).alias("i")).collect()]
    assert sorted(ids) == ["1", "2", "3 > 2", "4"] and found.first().path.endswith("release.xml")


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.xml"
    path.write_text("<R>" + "".join(f'<V id="{i}"><T>{"x" * 50}</T></V>' for i in range(3000)) + "</R>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read_xml(spark, str(path), "V", "_id int, T string")
        assert found.rdd.getNumPartitions() > 4
        assert (found.count(), found.agg(F.count_distinct("_id")).first()[0]) == (3000, 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_encodings(spark, tmp_path):
    path = tmp_path / "latin.xml"
    path.write_bytes('<R><V><T>é</T></V><V t="ü"/></R>'.encode("latin-1"))
    found = read_elements(spark, str(path), "V", "ISO-8859-1")
    assert sorted(r.xml for r in found.collect()) == ['<V t="ü"/>', "<V><T>é</T></V>"]


def test_single_and_missing_children(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text("<R><V><C>1</C></V><V><C>1</C><C>2</C></V><V/></R>")
    found = read_xml(spark, str(path), "V", "C array<string>")
    assert sorted(len(r.C or []) for r in found.collect()) == [0, 1, 2]


@pytest.mark.parametrize("rules", [RULES, DEEP_RULES], ids=["declared schema", "descendant path"])
def test_records_by_rules(spark, document, rules):
    found = {r.variant_id: r.asDict(recursive=True) for r in read_by_rules(spark, document, rules).collect()}
    assert set(found) == {"1", "2", "3 > 2", "4"}
    first = found["1"]
    assert (first["variant_name"], found["4"]["variant_name"], found["2"]["variant_name"]) == ("n1", "n4", None)
    assert first["chromosome"] == "h38" and found["2"]["description"] is None
    assert [(a["assembly"], a["start"]) for a in first["assembly"]] == [("h38", "1"), ("h37", "2")]
    assert first["genes"] == ["g1", "é"] and first["hgvs"] == ["h1"] and first["databanks"][0]["name"] == "MyBank"
    assert [p["phenotype"] for p in first["phenotypes"]] == ['P & Q; "x"', "Q", None]
    assert [[i["clinical_significance"] for i in p["interpretation"] or []] for p in first["phenotypes"]] == [["x", "y"], ["z"], []]
    assert [[b["title"] for b in p["bibliography"] or []] for p in first["phenotypes"]] == [[], ["t"], []]
    for other in ("2", "4"):
        assert all(found[other][n] is None for n in ("assembly", "genes", "hgvs", "databanks", "phenotypes"))


def test_records_flatten_to_one_row_per_combination(spark, document):
    flat = flatten(read_by_rules(spark, document, RULES), VARIANT_SPEC)
    # assemblies x (interpretations of p1, p2 and none of p3) x databank x genes x hgvs
    assert flat.where("variant_id = '1'").count() == 2 * (2 + 1 + 1) * 1 * 2 * 1
    assert flat.where("variant_id = '2'").count() == 1


def test_rows_can_be_restricted_by_a_test_on_the_row_element(spark, document):
    rules = [tuple("./Variant[@id='4']" if v == "./Variant" else v for v in r) for r in RULES]
    assert values(read_by_rules(spark, document, rules), "variant_id") == [("4",)]


def test_paths():
    tests = steps_of("./A[@x='1/2'][2]/B[c='d'][e]/F")
    assert [s.tag for s in tests] == ["A", "B", "F"] and tests[0].tests[1].ordinal == 2
    for path in ("./A[last()]", "..", "./A/../..", "./A//", "./ancestor::A", "./*[2]", "./A|./B", "."):
        with pytest.raises(UnsupportedPath):
            steps_of(path)
    assert steps_of(".//A/B//C") == (Step("A", deep=True), Step("B"), Step("C", deep=True))
    has_b = Condition(paths=((Step("B"),),))
    assert steps_of("./A/B/..") == (Step("A", (has_b,)),) and steps_of("./B/../C") == (Step(".", (has_b,)), Step("C"))
    assert RuleSet(RULES).row_tag() == "Variant"


@pytest.mark.parametrize(
    "path, expected",
    [("./L", ["a", "b", "c", "d"]), ("./L[2]", ["b"]), ("./L[@k='2']", ["b", "d"]), ("./L[@k]", ["b", "c", "d"]),
     ("./L[@k='2'][2]", ["b"]), ("./L[@k='2'][3]", []), ("./M[N='y']/L", ["f"]), ("./M[N]/L", ["e", "f"]), ("./M/L[1]", ["e", "f", "h"])],
)
def test_path_tests_agree_with_element_tree(spark, tmp_path, path, expected):
    from xml.etree import ElementTree

    text = '<R><V><L>a</L><L k="2">b</L><L k="3">c</L><L k="2">d</L><M><N>x</N><L>e</L></M><M><N>y</N><L>f</L></M><M><L>h</L></M></V></R>'
    assert [e.text for e in ElementTree.fromstring(text)[0].findall(path)] == expected
    (tmp_path / "x.xml").write_text(text)
    rules = [("variation", "", "./V", "R", "", "", ""), ("gene", "", path, "V", "", "", ""), ("gene", "gene", "", "L", "", "", "")]
    assert read_by_rules(spark, str(tmp_path / "x.xml"), rules).first().genes == (expected or None)


def test_paths_that_cannot_be_followed_name_their_rule(spark, document):
    for path, message in (("./A[last()]", "not supported"), ("../A", "not supported"), ("./child::A", "not supported")):
        rules = [tuple(path if v == "./Deep/H" else v for v in r) for r in RULES]
        with pytest.raises(RuleError, match=message) as error:
            read_by_rules(spark, document, rules)
        assert error.value.problems[0][0] == 1 + RULES.index(("hgvs", "", "./Deep/H", "Variant", "", "", ""))
    with pytest.raises(RuleError, match="structure"):
        RuleSet(DEEP_RULES).shape()


def test_no_python_in_the_plan(spark, document):
    plan = read_by_rules(spark, document, DEEP_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_comments_and_malformed_elements(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<R><V id="1"><T>t<!-- c -->u</T></V><V id="2"><T>x</V><V id="3"><T> y </T><!-- <T>no</T> --></V></R>')
    elements = read_elements(spark, str(tmp_path / "x.xml"), "V")
    found = read_xml(spark, str(tmp_path / "x.xml"), "V", "_id string, T string")
    assert sorted(map(tuple, found.collect())) == [("1", "tu"), ("3", "y")]
    assert [r["xml"] for r in malformed_elements(elements).collect()] == ['<V id="2"><T>x</V>']
    rules = [("variation", "", "./V", "R", "", "", ""), ("variation", "variant_id", "", "V", "id", "", ""), ("gene", "", "./T", "V", "", "", ""), ("gene", "gene", "", "T", "", "", "")]
    records = read_by_rules(spark, str(tmp_path / "x.xml"), rules)
    assert sorted((r["variant_id"], r["genes"]) for r in records.collect()) == [("1", ["tu"]), ("3", ["y"])]


NESTED = (
    '<V><L>a</L><X><L k="2">b</L><Y><L>c</L><N>x</N></Y></X><!-- <L>no</L> --><L k="2">d<L>e</L></L>'
    "<M><N>y</N><L>f</L><M><N>x</N><L>g</L></M></M><Z><![CDATA[<L>no</L>]]></Z><X><L>h</L></X><E/></V>"
)


@pytest.mark.parametrize(
    "path",
    [".//L", "./*/L", ".//L[@k]", ".//L[@k='2']", "./X//L", ".//M//L", ".//M/L", ".//*/L", "./X/Y/../L", ".//N/../L", ".//M[N='x']/L", "./M//N/../L",
     ".//L/L", ".//Q", "./*//L", "./L/../X/L", ".//X/*/L", ".//L[2]", ".//L/../L[1]"],
)
def test_axes_agree_with_element_tree(spark, tmp_path, path):
    from xml.etree import ElementTree

    expected = [e.text for e in dict.fromkeys(ElementTree.fromstring(NESTED).findall(path))]
    (tmp_path / "x.xml").write_text(f"<R>{NESTED}<V/></R>")
    rules = [("variation", "", "./V", "R", "", "", ""), ("gene", "", path, "V", "", "", ""), ("gene", "gene", "", "L", "", "", "")]
    found = read_by_rules(spark, str(tmp_path / "x.xml"), rules).collect()
    assert sorted((r.genes for r in found), key=str) == sorted([expected or None, None], key=str)


def test_properties_by_axes_are_the_first_in_the_document(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<R><V><P><Q><N>deep</N></Q><N>flat</N></P></V><V><P><N>flat</N><Q><N>deep</N></Q></P></V><V><P i='3'/></V></R>")
    rules = [
        ("variation", "", "./V", "R", "", "", ""), ("variation", "variant_id", ".//N", "V", "", "", ""), ("variation", "chromosome", "./*", "V", "i", "", ""),
        ("gene", "", "./P", "V", "", "", ""), ("gene", "gene", ".//N", "P", "", "", ""),
    ]
    found = read_by_rules(spark, str(tmp_path / "x.xml"), rules)
    assert values(found, "variant_id", "genes", "chromosome") == [(None, [None], "3"), ("deep", ["deep"], None), ("flat", ["flat"], None)]


def test_correlated_children_at_any_depth(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<R><V><Ph id='1'/><Ph id='2'/><A><I p='1' s='a'/><B><I p='2' s='b'/></B></A><I p='1' s='c'/></V></R>"
    )
    rules = [
        ("variation", "", "./V", "R", "", "", ""), ("phenotype", "", "./Ph", "V", "", "", ""), ("phenotype", "phenotype", "", "Ph", "id", "", ""),
        ("pkey", "", "", "Ph", "id", "", ""), ("interpretation", "", ".//I[@p='<value>']", "V", "", "pkey", ""),
        ("interpretation", "clinical_significance", "", "I", "s", "", ""),
    ]
    (row,) = read_by_rules(spark, str(tmp_path / "x.xml"), rules).collect()
    assert [[i.clinical_significance for i in p.interpretation] for p in row.phenotypes] == [["a", "c"], ["b"]]


@pytest.mark.parametrize("size", ["128m", "60", "25"])
def test_rows_inside_rows(spark, tmp_path, size):
    import random

    rng = random.Random(1)
    number = iter(range(10_000))

    def element(depth):
        if rng.random() < 0.2:
            return f'<V id="{next(number)}"/>'
        return f'<V id="{next(number)}"><T>t</T>{"".join(element(depth + 1) for _ in range(rng.randrange(3 if depth < 4 else 1)))}</V>'

    rows = [element(0) for _ in range(40)]
    (tmp_path / "x.xml").write_text("<R>\n" + " ".join(rows) + "</R>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted(r.xml for r in read_elements(spark, str(tmp_path / "x.xml"), "V", nested=True).collect()) == sorted(rows)
        rules = [
            ("variation", "", "./V", "R", "", "", ""), ("variation", "variant_id", "", "V", "id", "", ""),
            ("gene", "", ".//V", "V", "", "", ""), ("gene", "gene", "", "V", "id", "", ""),
        ]
        found = read_by_rules(spark, str(tmp_path / "x.xml"), rules, nested_rows=True)
        import re

        want = [(ids[0], ids[1:] or None) for ids in (re.findall('id="(\\d+)"', row) for row in rows)]
        assert sorted(((r.variant_id, r.genes) for r in found.collect()), key=str) == sorted(want, key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_correlated_children_in_one_record(spark):
    """Children are looked up, not walked through for every parent: 6,000 of each."""
    rules = [
        ("variation", "", "./V", "R", "", "", ""), ("phenotype", "", "./Ph", "V", "", "", ""), ("phenotype", "phenotype", "", "Ph", "id", "", ""),
        ("pkey", "", "", "Ph", "id", "", ""), ("interpretation", "", "./I[@p='<value>']", "V", "", "pkey", ""),
        ("interpretation", "clinical_significance", "", "I", "s", "", ""),
    ]
    parents = "".join(f"<Ph id='{i}'/>" for i in range(6000)) + "<Ph/>"
    children = "".join(f"<I p='{i * 7 % 6000}' s='{i}'/>" for i in range(6000)) + "<I p='5' s='last'/><I s='none'/><I p='other'/>"
    df = spark.createDataFrame([(f"<V>{parents}{children}</V>",)], "xml string")
    (row,) = extract_entities(df, rules).collect()
    found = {p.phenotype: [i.clinical_significance for i in p.interpretation or []] for p in row.phenotypes}
    want = {str(i * 7 % 6000): [str(i)] for i in range(6000)} | {None: []}
    want["5"].append("last")
    assert found == want


def test_structure_of_the_data(spark):
    df = spark.createDataFrame([('<V a="1"><A><B/></A></V>',), ("<V><A/><C>t</C></V>",)], "xml string")
    found = structure_of(df, "V")
    assert {f.name for f in found} >= {"_a", "A", "C"} and "B" in found["A"].dataType.simpleString()


def test_files_are_not_cut_at_a_row_element_they_lack(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xml").write_text("<Orders>" + "".join(f'<Order key="{i}"/>' if i % 2 else f'<Order key="{i}"></Order>' for i in range(9)) + "</Orders>")
    cut = []
    monkeypatch.setattr(xml_rules, "read_elements", lambda spark, paths, tag, *rest: cut.append(tag) or read_elements(spark, paths, tag, *rest))
    rules = [("variation", "", "./Ord", "Orders", "", "", ""), ("variation", "", "./Order", "Orders", "", "", ""), ("variation", "variant_id", "", "Order", "key", "", "")]
    found = xml_rules.read_by_rules(spark, str(tmp_path), rules).select("variant_id")
    assert sorted(r[0] for r in found.collect()) == [str(i) for i in range(9)] and cut == ["Order"]
    assert xml_rules.read_by_rules(spark, str(tmp_path), rules[:1]).collect() == []
