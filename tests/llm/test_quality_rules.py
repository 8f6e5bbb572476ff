from collections import Counter

from rulemill.llm.quality_rules import POLICIES, RULES, ablations, covered_by_repeats, ledger, mask_of, with_verdict


def brute(words, window=5):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(window)})


def test_covered_words_equal_brute_force(prose):
    import random

    rng = random.Random(2)
    for n in (0, 3, 4, 5, 6, 9, 40, 300):
        for kinds in (1, 2, 3, 50):
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            assert covered_by_repeats(words) == brute(words)
    many = [b"%d" % i for i in range(70_000)]  # so many kinds that five would not fit one number
    assert covered_by_repeats(many + many[:7]) == 14


def test_measures_and_bits(awkward):
    for r in ledger(awkward).collect():
        assert (r["failures"] & 1 == 1) == (r["n_words"] < 10)
    rows = {r["doc_id"]: r for r in ledger(awkward).collect()}
    assert rows[201]["n_words"] == rows[202]["n_words"] == rows[203]["n_words"] == 0 and rows[200]["n_words"] == 30_000
    assert ledger(awkward).count() == awkward.count()


def test_policies_and_ablations(spark):
    text = "one two three four five six seven eight nine ten\n"
    frame = spark.createDataFrame([(1, text), (2, "# # # # " + text), (3, "short"), (4, "% short"), (5, text * 4)], "doc_id long, text string")
    rows = with_verdict(ledger(frame), "2")
    assert {r["doc_id"]: r["kept"] for r in rows.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    got = {r["rule"]: (r["failed"], r["only_this"]) for r in ablations(rows, "2").collect()}
    assert got["few_words"] == (2, 1) and got["symbols"] == (2, 1)
    assert got["repeated_words"] == (1, 0) and got["duplicate_lines"] == (1, 0) and set(got) == set(POLICIES["2"])


def test_masks_and_empty_table(no_rows):
    assert mask_of(tuple(RULES)) == 2 ** len(RULES) - 1
    assert ledger(no_rows).collect() == []
    assert {r["failed"] for r in ablations(ledger(no_rows), "2").collect()} == {0}
