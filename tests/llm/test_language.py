import numpy as np
from pyspark.sql import functions as F

from rulemill.llm.language import Profiler, identify, learn, recognised

ALPHA, BETA = "bada gado baga dobo gaba dago", "kirip tikip pirik tripi kript"


def brute(text, dimensions=64, seed=5):
    letter = lambda c: np.random.default_rng((seed, ord(c))).choice(np.array([-1, 1], np.int8), dimensions).astype(int)
    total = np.zeros(dimensions, int)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def test_profile_equals_brute_force():
    p = Profiler(64)
    for text in ("Hello, World!", "a", "ab 12 cd", "Ünïcode ßtraße Привет", "x" * 50, "tail space  "):
        assert np.allclose(p.profile(text), brute(text))
    assert p.profile("") is None and p.profile("12 !?") is None


def test_segments_do_not_change_a_profile(monkeypatch):
    text = "many words that are cut anywhere, also within a word. " * 3
    whole = Profiler(64).profile(text)
    for size in (1, 2, 3, 7, 10):
        monkeypatch.setattr("rulemill.llm.language.SEGMENT", size)
        assert np.allclose(Profiler(64).profile(text), whole)


def labelled(spark):
    return spark.createDataFrame([(i, ALPHA, "x") for i in range(5)] + [(i, BETA, "y") for i in range(5)] + [(9, None, "y"), (9, ALPHA, None)], "doc_id long, text string, lang string")


def test_languages_are_told_apart(spark):
    model = learn(labelled(spark))
    assert sorted(model) == ["x", "y"]
    docs = spark.createDataFrame([(1, "GABA bado"), (2, "tikip kirik"), (3, None), (4, " 12 "), (5, ""), (1, "GABA bado")], "doc_id long, text string")
    out = sorted(tuple(r) for r in identify(docs, model).collect())
    assert [(i, lang) for i, lang, _ in out] == [(1, "x"), (1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= s <= 1 for *_, s in out) and out[3][2] == 0


def test_awkward_rows(spark, awkward, no_rows):
    model = learn(awkward)
    assert list(model) == ["en"] and identify(awkward, model).count() == awkward.count()
    kept = recognised(awkward, model)
    assert kept.columns == awkward.columns and kept.filter("text IS NULL OR trim(text) = ''").isEmpty()
    assert kept.count() == awkward.filter("text rlike '[a-z]'").count()
    assert learn(no_rows) == {} and identify(no_rows, {}).collect() == []
    assert {r["lang_pred"] for r in identify(awkward, {}).collect()} == {"und"} and recognised(awkward, {}).isEmpty()
    assert recognised(awkward, model, accepted=("de",)).isEmpty()


def test_held_out_accuracy(spark):
    from rulemill.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op5_hyperdimensional_language"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in got.filter("held_out").collect()]
    assert sum(right) / len(right) > 0.95


def test_unknown_languages_are_rejected(spark):
    """The pipeline keeps the documents of the corpus, and rejects scripts that were not learned and random letters."""
    import random

    import corpus_pipeline
    from rulemill.llm.queries import table

    sf, rng = "/root/testdata/sf0.001", random.Random(7)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    planted = [noise(letters, n) for letters in ("абвгдежзиклмнопрстуфхцчшщыюя", "今天气很好我们去公园散步吧", "abcdefghijklmnopqrstuvwxyz") for n in (40, 150, 600)]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(planted)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.filter("text rlike '\\\\p{L}'").collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, sf).count() == docs.count()
