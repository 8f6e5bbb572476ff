import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rulemill.llm import resampling
from rulemill.llm.resampling import Prefixes, Shift, bucket_counts, gains, resample
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]).encode() for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, share, least, seed, max_n, buckets):
    s, t = (Counter(zlib.crc32(f) % buckets for text in every for f in features(text, max_n)[1]) for every in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, grams = features(text, max_n)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = share[0] * len(enough) // share[1]
    return out, [(r[0], r[4]) for r in enough[:drawn]]


def test_crc_of_every_run_from_its_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        words = [bytes(rng.choice(b"ab0\xc3") for _ in range(rng.choice([1, 2, 9, 63, 64, 65, 500]))) for _ in range(rng.randrange(9))]
        found = Prefixes(b"  ".join(words), Shift())
        for n in range(1, len(words) + 1):
            assert found.crcs(0, len(words) - n + 1, n).tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("max_n", "buckets"), [(1, 10_000), (3, 50)])
def test_resample_equals_a_plain_version(awkward, spark, monkeypatch, max_n, buckets):
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 7)
    docs = texts(awkward)
    target = [t for _, t in docs[:3]] + ["the Of! and", None, ""]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, weight string")
    found = resample(awkward, frame, (30, 100), 20, 7, max_n, buckets).collect()
    rows, drawn = plain(docs, target, (30, 100), 20, 7, max_n, buckets)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in found), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def test_empty_tables(no_rows, awkward):
    assert resample(no_rows, no_rows).collect() == [] and bucket_counts(no_rows).collect() == []
    assert resample(awkward, no_rows).count() == awkward.count()
    assert np.all(gains(bucket_counts(no_rows), bucket_counts(no_rows)) == 0)
