import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rulemill.llm import katz
from rulemill.llm.katz import discounts
from tests.llm.conftest import texts


def plain(docs, order):
    """(id, text, training) -> (id, n_tokens, n_known, base score, score), and the probabilities of the model."""
    words_of = lambda text: (text or "").encode().lower().split()
    grams = [Counter() for _ in range(order + 1)]
    for _, text, training in docs:
        if training:
            seq = [None] * (order - 1) + words_of(text) + [0]
            for t in range(order - 1, len(seq)):
                for m in range(1, order + 1):
                    grams[m][tuple(seq[t - m + 1 : t + 1])] += 1
    total, distinct = sum(grams[1].values()), len(grams[1])
    kinds = [[sum(c == r for c in g.values()) for r in range(1, 7)] for g in grams]
    d = [discounts(k) for k in kinds]
    lost = lambda m, counts: sum((1 - d[m][r]) * r for r in counts if r <= 5)
    follow = defaultdict(dict)
    for g in grams[1:]:
        for gram, c in g.items():
            follow[gram[:-1]][gram[-1]] = c

    def backoff(context):
        f = follow.get(context)
        if not f:
            return None, 1.0
        c, left = sum(f.values()), lost(len(context) + 1, f.values())
        divisor, rest = (c, left / c) if left > 0 else (c + 1, 1 / (c + 1))
        return divisor, rest / (1 - sum(p(context[1:], w) for w in f)) if context else rest

    known = {}

    def p(context, word):
        if (context, word) not in known:
            if context not in known:
                known[context] = backoff(context)
            (divisor, weight), c = known[context], follow.get(context, {}).get(word, 0)
            r = c * (d[len(context) + 1][c] if c <= 5 else 1)
            known[context, word] = r / divisor if c else weight * (p(context[1:], word) if context else 1)
        return known[context, word]

    out = []
    for i, text, _ in docs:
        seq = [None] * (order - 1) + words_of(text) + [0]
        at = range(order - 1, len(seq))
        base = sum(math.log10((grams[1][seq[t],] + 0.5) / (total + 0.5 * (distinct + 1))) for t in at)
        out.append((i, len(at), sum(grams[1][seq[t],] > 0 for t in at), base, sum(math.log10(p(tuple(seq[t - order + 1 : t]), seq[t])) for t in at)))
    return out, total, p, follow


@pytest.mark.parametrize(("order", "chunk", "rows"), [(1, 8 << 20, 1 << 20), (2, 8 << 20, 1 << 20), (2, 3000, 500), (3, 9000, 2000)])
def test_scores_equal_a_plain_model(awkward, order, chunk, rows):
    training = F.col("doc_id") % 3 != 1
    docs = [(i, t, i is not None and i % 3 != 1) for i, t in texts(awkward)]
    want, total, _, _ = plain(docs, order)
    got = katz.score(awkward, training, order, chunk, rows).collect()
    key = lambda r: tuple((x is None, round(x or 0, 3)) for x in r)
    columns = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    found = sorted((tuple(r[c] for c in columns) for r in got), key=key)
    assert len(found) == len(want) and {r["train_tokens"] for r in got} == {total}
    for a, b in zip(found, sorted(want, key=key)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_probabilities_add_up(awkward):
    docs = [(i, t, True) for i, t in texts(awkward)]
    _, _, p, follow = plain(docs, 3)
    words = [w for w in follow[()]] + ["a word that is unknown"]
    for context in list(follow)[:40]:
        assert sum(p(context, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_discounts():
    assert discounts([0] * 6) == [1.0] * 6
    d = discounts([1000, 300, 150, 90, 60, 40])
    common = 6 * 40 / 1000
    assert d[1] == pytest.approx((2 * 300 / 1000 - common) / (1 - common)) and all(0 < x <= 1 for x in d)
    assert discounts([5, 0, 9, 0, 0, 0])[1] == 1.0  # no discount where it would take everything


def test_no_rows_and_no_training(no_rows, awkward):
    assert katz.score(no_rows, F.lit(True)).collect() == []
    found = katz.score(awkward, F.lit(None).cast("boolean")).collect()
    assert len(found) == awkward.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in found)
    with pytest.raises(ValueError):
        katz.score(awkward, F.lit(True), order=0)
