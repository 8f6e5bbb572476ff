import random
from collections import Counter

import numpy as np
import pytest

from rulemill.llm.substring_dedup import Spans, paths, remove_repeats


def brute(docs, window):
    """(doc_id, n_words, n_removed, kept) by comparing all windows."""
    least = {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            if least[tuple(words[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
    return Counter(out)


def result(df, window=50, kmer=16):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(df, window, kmer).collect())


def test_hashes_of_ranges():
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    s = Spans(words)
    h = lambda a, b: tuple(int(s.hash(k, np.array([a]), np.array([b]))[0]) for k in (0, 1))
    assert h(0, 2) == h(2, 4) == h(5, 7) and len({h(a, b) for a in range(7) for b in range(a + 1, 8)}) == len({tuple(words[a:b]) for a in range(7) for b in range(a + 1, 8)})


def test_equal_windows_share_a_landmark(prose):
    common = prose(30).split()
    for left in (0, 5, 40):
        words = [w.encode() for w in prose(left).split() + common + prose(20).split()]
        mark, _, first, count = paths(Spans(words), len(words), 10, 4)
        assert (np.diff(first) == count[:-1]).all() and first[0] == 0 and first[-1] + count[-1] == len(words) - 9
        inside = {}
        for m, f, c in zip(mark.tolist(), first.tolist(), count.tolist()):
            for k in range(f, f + c):
                inside[tuple(words[k : k + 10])] = m
        if left:
            assert all(inside[k] == before[k] for k in before.keys() & inside.keys()) and len(before.keys() & inside.keys()) >= 21
        before = inside


@pytest.mark.parametrize("window,kmer,kinds", [(6, 3, 3), (10, 4, 1000)])
def test_small_corpora_equal_brute_force(spark, window, kmer, kinds):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(kinds)}"
    passages = [[word() for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += [word() for _ in range(rng.randrange(12))] + rng.choice(passages)[rng.randrange(3) :]
        docs.append((rng.randrange(40), " ".join(words)))
    docs += [(None, " ".join(passages[0] * 3)), (3, None), (3, ""), docs[0], (1, "w1 " * 40), (2, "w1 " * 30), (-5, "w1 " * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(frame, window, kmer) == brute(docs, window)


def test_awkward_rows(awkward, no_rows):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert result(awkward) == brute(docs, 50)
    assert remove_repeats(no_rows).collect() == []
