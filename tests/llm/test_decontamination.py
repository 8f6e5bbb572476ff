import random

import numpy as np

from rulemill.llm.decontamination import Index, leaks, tile, tokens, without_leaks


def brute(doc, item, least):
    """Longest unmarked match first, by looking at all pairs of places."""
    free_doc, free_item, out = [x >= 0 for x in doc], [x >= 0 for x in item], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_item[i + n] and free_doc[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[2]:
                    best = i, d, n
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            free_item[best[0] + k] = free_doc[best[1] + k] = False


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(3)
    for t in range(150):
        kinds = 6 if t % 2 else 3
        item = rng.integers(0, kinds, int(rng.integers(1, 22)))
        cut = len(item) // 2
        doc = np.concatenate([rng.integers(-1, kinds, int(rng.integers(0, 25))), item[cut:], item[:cut]])
        assert tile(doc, item, 3) == brute(doc.tolist(), item.tolist(), 3)


def test_coverage_equals_brute_force(prose):
    rng = random.Random(6)
    items = [(i, prose(rng.randrange(3, 40))) for i in range(12)]
    index = Index(items)
    for _ in range(60):
        name, text = rng.choice(items)
        words = text.split()
        a, b = sorted(rng.randrange(len(words) + 1) for _ in range(2))
        doc = f"{prose(20)} {' '.join(words[b:])}, {' '.join(words[:a]).upper()} {prose(9)} {' '.join(words[a:b])}"
        got = {n: round(c * len(tokens(dict(items)[n]))) for n, c, _ in index.leaks(doc, 0.5)}
        want = {}
        for n, t in items:
            ids: dict = {}
            number = lambda x: [ids.setdefault(w, len(ids)) for w in tokens(x)]
            covered = sum(k for _, _, k in brute(number(doc), number(t), 5))
            if covered >= 0.5 * len(tokens(t)) and len(tokens(t)) >= 5:
                want[n] = covered
        assert got == want


def test_leaks_in_any_order_and_awkward_rows(spark, awkward, no_rows, prose):
    passage = prose(30)
    words = passage.split()
    turned = " ".join(words[15:] + ["between"] + words[:15])
    docs = awkward.unionByName(spark.createDataFrame([(900, turned + "!"), (901, " ".join(words[:10])), (902, passage), (902, passage)], "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, passage), (2, None), (3, ""), (4, "too short"), (None, prose(20)), (1, passage)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 100):
        got = sorted((r["doc_id"], r["item_id"], round(r["coverage"], 3), len(r["tiles"])) for r in leaks(docs, benchmark, block_bytes=block_bytes).collect())
        assert got == [(900, "1", 1.0, 2)] * 2 + [(902, "1", 1.0, 1)] * 4
        clean = without_leaks(docs, benchmark, block_bytes=block_bytes)
        assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, empty).collect() == [] and without_leaks(docs, empty).count() == docs.count()
    assert leaks(no_rows, benchmark).collect() == [] and without_leaks(no_rows, benchmark).collect() == []


def test_tiles_point_into_the_document(prose):
    passage = prose(25)
    doc = f"{prose(11)} {passage} {prose(4)}"
    ((_, coverage, tiles),) = Index([("x", passage)]).leaks(doc, 0.8)
    assert coverage == 1.0 and tiles == [(0, 11, 25)]
