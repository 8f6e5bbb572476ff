import pytest
from pyspark.sql import functions as F

from rulemill import flatten
from rulemill.sources.xml import read_elements
from rulemill.variants.clinvar import extract_variants, of_phenotype, read_variants
from rulemill.variants.derive import clinical_actionability, derive_attributes, with_assembly_dates
from rulemill.variants.schema import VARIANT_COLUMNS, VARIANT_SPEC
from tests.conftest import values

ASSERTION = """<ClinicalAssertion ID="{id}"><ReviewStatus>{status}</ReviewStatus><Interpretation DateLastEvaluated="2020-01-01">
<Description>Pathogenic</Description></Interpretation><ClinVarAccession SubmitterName="Lab; A"/><ObservedInList><ObservedIn>
<Method><MethodType>clinical testing</MethodType></Method><Sample><Origin>germline</Origin></Sample></ObservedIn></ObservedInList>
<AttributeSet><Attribute Type="AssertionMethod">old</Attribute></AttributeSet><AttributeSet><Attribute Type="AssertionMethod">ACMG</Attribute>
<Attribute Type="Other">z</Attribute></AttributeSet>{traits}</ClinicalAssertion>"""
STATED = '<TraitSet><Trait><Name><ElementValue Type="Preferred">Stated</ElementValue></Name></Trait></TraitSet>'

RELEASE = f"""<?xml version="1.0"?>
<ClinVarResult-Set><VariationArchive VariationID="1" Accession="VCV1" VariationName="NM_1" VariationType="SNV"><InterpretedRecord><SimpleAllele>
<GeneList><Gene Symbol="BRCA1"/><Gene Symbol="ABC"/></GeneList><Location><CytogeneticLocation>19p13.12</CytogeneticLocation>
<SequenceLocation Assembly="GRCh38" Chr="19" start="5" display_start="6" display_stop="6"/>
<SequenceLocation Assembly="GRCh37" Chr="19" display_start="7" stop="8" referenceAlleleVCF="A" alternateAlleleVCF="CG"/></Location>
<CanonicalSPDI>NC_000019.10:15192004:A:G</CanonicalSPDI></SimpleAllele><ClinicalAssertionList>
{ASSERTION.format(id=10, status="first", traits="")}{ASSERTION.format(id=11, status="second", traits=STATED)}
<ClinicalAssertion ID="12"><ReviewStatus>third</ReviewStatus></ClinicalAssertion></ClinicalAssertionList>
<TraitMappingList><TraitMapping ClinicalAssertionID="10"><MedGen Name="Migraine, aura"/></TraitMapping>
<TraitMapping ClinicalAssertionID="12"><MedGen Name="MIGRAINE, AURA"/></TraitMapping><TraitMapping><MedGen Name="loose"/></TraitMapping></TraitMappingList>
</InterpretedRecord></VariationArchive><VariationArchive VariationID="2" Accession="VCV2" VariationName="NC_000023.10:g.32407761G&gt;A (x)" VariationType="Del"/>
<VariationArchive VariationID="3" Accession="VCV3" VariationName="b"><InterpretedRecord><SimpleAllele><HGVSlist>
<HGVS><NucleotideExpression><Expression>NM_9</Expression></NucleotideExpression></HGVS>
<HGVS><NucleotideExpression Assembly="GRCh38"><Expression>NC_000019.10:g.1041829A&gt;T</Expression></NucleotideExpression>
<ProteinExpression><Expression>NP_1</Expression></ProteinExpression></HGVS></HGVSlist></SimpleAllele></InterpretedRecord></VariationArchive>
<VariationArchive VariationID="4" Accession="VCV4" VariationName="b"><InterpretedRecord><SimpleAllele><GeneList><Gene Symbol="G"><Location>
<SequenceLocation Chr="7"/></Location></Gene></GeneList></SimpleAllele></InterpretedRecord></VariationArchive></ClinVarResult-Set>"""


@pytest.fixture(scope="module")
def release(tmp_path_factory):
    path = tmp_path_factory.mktemp("release") / "release.xml"
    path.write_text(RELEASE)
    return str(path)


@pytest.fixture(scope="module")
def found(spark, release):
    rows = read_variants(spark, release, version=F.lit("77")).collect()
    return {r.databanks[0].clinvar_accession: r.asDict(recursive=True) for r in rows}


def test_assemblies(found):
    spdi = "NC_000019.10:15192004:A:G"
    picked = [[a[n] for n in ("assembly", "start", "end", "ref", "alt", "risk_allele")] for a in found["VCV1"]["assembly"]]
    assert picked == [["GRCh38", "5", "6", spdi, spdi, spdi], ["GRCh37", "7", "8", "A", "CG", "CG"]]
    genomic = found["VCV3"]["assembly"]
    assert [(a["assembly"], a["start"], a["ref"]) for a in genomic] == [("GRCh38", "NC_000019.10:g.1041829A>T", None)]
    assert found["VCV2"]["assembly"] is None


def test_chromosome_fallbacks(found):
    assert [found[f"VCV{i}"]["chromosome"] for i in (1, 2, 3, 4)] == ["19", "NC_000023.10:g.32407761G>A (x)", "NC_000019.10:g.1041829A>T", "7"]


def test_genes_expressions_and_databank(found):
    assert found["VCV1"]["genes"] == ["BRCA1", "ABC"] and found["VCV2"]["genes"] is None
    assert found["VCV3"]["hgvs"] == ["NM_9", "NC_000019.10:g.1041829A>T", "NP_1"] and found["VCV1"]["hgvs"] is None
    assert found["VCV1"]["databanks"] == [
        {"name": "ClinVar", "url": "https://www.ncbi.nlm.nih.gov/clinvar/", "version": "77", "variant_id": "1", "clinvar_accession": "VCV1"}
    ]


def test_phenotypes_merge_spellings_and_fall_back(found):
    migraine, stated = found["VCV1"]["phenotypes"]
    assert migraine["phenotype"] == "Migraine, aura" and [i["level_certainty"] for i in migraine["interpretation"]] == ["first", "third"]
    assert stated["phenotype"] == "Stated" and found["VCV2"]["phenotypes"] is None
    assert migraine["interpretation"][0] == {
        "clinical_significance": "Pathogenic", "method": "clinical testing", "assertion_criteria": "ACMG", "level_certainty": "first",
        "date": "2020-01-01", "author": "Lab; A", "origin": "germline",
    }
    assert migraine["interpretation"][1]["author"] is None


def test_records_of_a_phenotype(spark, release):
    records = read_variants(spark, release)
    assert of_phenotype(records, " migraine, AURA ").count() == 1 and of_phenotype(records, "Migraine").count() == 0


def test_parsing_happens_once(spark, release):
    records = of_phenotype(extract_variants(read_elements(spark, release, "VariationArchive")), "x")
    flat = derive_attributes(flatten(records, VARIANT_SPEC))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_derived_table(spark, release):
    flat = derive_attributes(flatten(read_variants(spark, release), VARIANT_SPEC))
    assert tuple(flat.columns) == VARIANT_COLUMNS
    names = {(r.variant_id, r.variant_name) for r in flat.collect()}
    assert names == {
        ("VCV1", "Chr19:g.5-6:A>G(GRCh38)"), ("VCV1", "Chr19:g.7-8:A>G(GRCh37)"), ("VCV2", "Chr23:ImpreciseVariant"),
        ("VCV3", "Chr19:ImpreciseVariant"), ("VCV4", "Chr7:ImpreciseVariant"),
    }
    first = flat.where("variant_id = 'VCV1' and phenotype = 'Migraine aura' and level_certainty = 'first'").first()
    assert (first.clinical_actionability, first.alt, first.risk_allele) == ("Disorder causing or risk factor", "G", "G")
    assert {r.start for r in flat.where("variant_id = 'VCV3'").collect()} == {"1041829"}


def test_names_can_be_composed_before_cleaning(spark, release):
    flat = derive_attributes(flatten(read_variants(spark, release), VARIANT_SPEC), clean_first=False)
    names = {r.variant_name for r in flat.where("variant_id = 'VCV2'").collect()}
    assert names == {"ChrNC_000023.10:g.32407761G>A (x):ImpreciseVariant"}
    assert {r.chromosome for r in flat.where("variant_id = 'VCV2'").collect()} == {"23"}


@pytest.mark.parametrize(
    "said, expected",
    [("PATHOGENIC", "Disorder causing or risk factor"), ("Likely benign", "Not disorder causing or protective effect"),
     ("confers sensitivity", "Affects drugs or treatment response"), ("VUS", "Uncertain role"), ("other", "Not provided"), (None, "Not provided")],
)
def test_actionability(spark, said, expected):
    df = spark.createDataFrame([(said,)], "s string")
    assert df.select(clinical_actionability(F.col("s")).alias("a")).first().a == expected


def test_assembly_dates(spark, text_frame):
    flat = text_frame(["variant_id", "assembly", "assembly_date"], [("v", "GRCh38", None), ("w", "x", None), ("u", None, None)])
    dated = with_assembly_dates(flat, text_frame(["assembly", "assembly_date"], [("GRCh38", "2013/12/17")]))
    assert dated.columns == flat.columns
    assert values(dated, "variant_id", "assembly_date") == [("u", None), ("v", "2013/12/17"), ("w", None)]


def test_many_assertions_are_read_in_linear_time(spark, tmp_path):
    import time

    def seconds(n):
        given = "".join(f'<ClinicalAssertion ID="{i}"><ReviewStatus>r{i}</ReviewStatus></ClinicalAssertion>' for i in range(n))
        mapped = "".join(f'<TraitMapping ClinicalAssertionID="{n - 1 - i}"><MedGen Name="t{i}"/></TraitMapping>' for i in range(n))
        record = f'<VariationArchive VariationID="1"><InterpretedRecord><SimpleAllele/><ClinicalAssertionList>{given}</ClinicalAssertionList><TraitMappingList>{mapped}</TraitMappingList></InterpretedRecord></VariationArchive>'
        (tmp_path / f"r{n}").write_text(record.replace("><", "> <"))
        started = time.perf_counter()
        rows = extract_variants(read_elements(spark, str(tmp_path / f"r{n}"), "VariationArchive")).select(F.inline("phenotypes")).collect()
        assert [r["phenotype"] for r in rows] == [f"t{n - 1 - i}" for i in range(n)]
        assert [r["interpretation"][0]["level_certainty"] for r in rows] == [f"r{i}" for i in range(n)]
        return time.perf_counter() - started

    seconds(500)
    assert seconds(5000) < 60
