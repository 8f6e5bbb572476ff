import random

import numpy as np
import xxhash

from rulemill.llm import simhash
from rulemill.llm.components import connected_components
from rulemill.llm.simhash import fingerprint, fingerprints, group, links, near_duplicate_keys, one_of_each, pigeonhole, radius_for, within, within_radius


def plain(text, shingle=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius):
    """component of each position, by all pairs."""
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_equals_its_definition(prose):
    for text in (None, "", "  ", "one", "One two THREE", "a b c d", prose(5), prose(300), prose(600) + "\n\t" + prose(7), "x " * 700, "É é A"):
        assert fingerprint((text or "").encode().lower().split(), 4)[0] == plain(text)


def test_bit_planes_find_exactly_the_near_pairs():
    rng = np.random.default_rng(1)
    for lanes, radius in ((1, 0), (1, 4), (2, 25)):
        blocks = []
        for _ in range(25):
            rows = np.repeat(rng.integers(0, 2**63, (1, lanes)).astype(np.uint64), int(rng.integers(1, 150)), 0)
            for row in rows:
                for bit in rng.integers(0, 64 * lanes, int(rng.integers(0, radius + 3))).tolist():
                    row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            blocks.append(rows)
        ends = np.repeat(np.cumsum([len(b) for b in blocks]), [len(b) for b in blocks])
        values = np.concatenate(blocks)
        i, j = within(values, ends, radius)
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, ends[a]) if np.bitwise_count(values[a] ^ values[b]).sum() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_pigeonhole_keys_meet():
    rng = random.Random(5)
    keys = pigeonhole(4)
    assert len(keys) == 15
    for _ in range(300):
        differ = set(rng.sample(range(64), 4))
        assert any(not differ & set(k) for k in keys)


def test_components_equal_all_pairs_for_any_chunk(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}) for b in base for _ in range(40)} | {0, 1, 2**63})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "node long, f0 long")
    names = {signed(p): i for i, p in enumerate(prints)}
    want = reachable(prints, 4)
    for chunk in (1000, 7):
        roots = {r["node"]: r["root"] for r in connected_components(links(frame, 1, 4, pigeonhole(4), chunk)).collect()}
        got = [roots.get(signed(p), signed(p)) for p in prints]
        assert len({(g, w) for g, w in zip(got, want)}) == len(set(got)) == len(set(want))
    assert len(names) == len(prints)


def test_components_of_paths_stars_and_nothing(spark):
    rng = random.Random(3)
    path = list(range(60))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 180)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_of_awkward_rows(awkward, no_rows):
    rows = group(fingerprints(awkward, 4), 1, within_radius(4)).collect()
    source = awkward.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    prints = [plain(r["text"]) for r in source]
    want = reachable(prints, 4)
    least = {}
    for r, w in zip(source, want):
        if r["doc_id"] is not None:
            least[w] = min(least.get(w, r["doc_id"]), r["doc_id"])
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    expected = sorted(((r["doc_id"], f, least[w]) for r, f, w in zip(source, signed, want)), key=key)
    assert sorted(((r["doc_id"], r["f0"], r["component_id"]) for r in rows), key=key) == expected
    assert group(fingerprints(no_rows, 4), 1, within_radius(4)).collect() == []


def test_one_document_of_each_group_stays(spark, awkward, no_rows, prose):
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = kept.select("doc_id", "text").collect()
    common = awkward.filter("doc_id = 300").first()["text"]
    assert [r["doc_id"] for r in rows if r["text"] == common] == [206]
    assert len([r for r in rows if not (r["text"] or "").strip()]) == 1 and [r["doc_id"] for r in rows if r["text"] == "a"] == [204]
    assert {r["doc_id"] for r in rows} >= set(range(30)) | set(range(100, 106)) | {200}
    assert one_of_each(no_rows).collect() == []
    words = prose(300).split()
    near = [list(words) for _ in range(4)]
    for k, w in enumerate(near[1:]):
        w[20 + 60 * k] = "changed"
    docs = [(i, " ".join(w)) for i, w in enumerate(near)] + [(9, prose(300)), (10, "one two three four five six"), (11, "one two three four five seven")]
    got = one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 9, 10, 11]


def test_further_lanes_are_fingerprints_too(prose):
    words = prose(400).encode().split()
    other = words[:200] + [b"changed"] + words[201:]
    one, two = fingerprint(words, 5, 16), fingerprint(other, 5, 16)
    assert one[0] == fingerprint(words, 5)[0] and len(set(one)) == 16
    assert sum((a ^ b).bit_count() for a, b in zip(one, two)) < 166 < sum((a ^ b).bit_count() for a, b in zip(one, fingerprint(prose(400).encode().split(), 5, 16)))


def test_keys_of_the_stage():
    keys = near_duplicate_keys()
    assert radius_for(0.8, 2, 2) == 27 and radius_for(0.8, 16, 1) == 166 and len(keys) == 48 and all(len(set(k)) == 13 for k in keys)
    rng = np.random.default_rng(0)
    met = sum(any(not d[k].any() for k in map(np.array, keys)) for d in (rng.random((500, 128)) < 0.15))
    assert met / 500 > 0.95


def test_the_true_similarity_decides(spark):
    """Pairs at exactly 0.8 and one shingle below, small and large, of equal size or not, some sharing a group with others."""
    rng = random.Random(12)
    docs, expected = [], set()

    def add(a, b, same):
        docs.extend([(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))])
        expected.update({len(docs) - 2} if same else {len(docs) - 2, len(docs) - 1})

    fresh = lambda n: [f"w{rng.getrandbits(60):x}" for _ in range(n)]
    for changes in (1, 2, 4, 30):
        for _ in range(25):
            for below in (0, 1):  # each change replaces five shingles of 45
                words = fresh(45 * changes + 4 - below)
                other = list(words)
                for k in range(changes):
                    other[10 + 30 * k] = fresh(1)[0]
                add(words, other, not below)
    for n in (4, 8, 40, 100, 400):
        for _ in range(20):
            for more in (0, 1):
                words = fresh(n + 4)
                add(words, words + fresh(n // 4 + more), not more)
    got = one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"] for r in got.collect()} == expected


def test_near_copies_of_one_text(spark):
    """Pairs below 0.8 are tied by others between them, in a large group and over rounds."""
    rng = random.Random(13)
    base = [f"w{rng.getrandbits(60):x}" for _ in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(20), rng.randrange(0, 6)):
            words[5 + 9 * k] = f"x{rng.getrandbits(60):x}"
        docs.append((i, " ".join(words)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {find(i) for i in range(len(docs))}


def test_short_and_repetitive_texts(spark, prose):
    """Four shingles against five are 0.8; a shingle that fills most of a text does not make it a copy; repetitions do not count."""
    eight = "one two three four five six seven eight"
    filler = "again " * 200
    docs = [eight, eight + " nine", filler + prose(30), filler + prose(30), "a b c d e f " * 3, "a b c d e f " * 40]
    got = one_of_each(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {0, 2, 3, 4}


def test_a_large_group_that_is_not_similar_enough_sends_each_set_once_per_chunk(spark, monkeypatch):
    """Copies of one text with other words in places: bits propose every pair, sets decide. No table may have a row for each pair."""
    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(400), 14 if i else 0):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 120, 7)]
    sizes = {}
    kept_tables = simhash.written

    def counted(df, label):
        out = kept_tables(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert kept == set(root.values())
    assert max(sizes.values()) <= 25 * len(rows)  # 24 keys for each row at most


def test_sets_of_a_group_in_chunks_lose_no_link(spark):
    rng = np.random.default_rng(9)
    common = np.unique(rng.integers(0, 1 << 62, 100))
    sets = [np.unique(np.concatenate((common[: 100 - k % 30], rng.integers(0, 1 << 62, k % 30)))) for k in range(60)]
    bits = [[x - (1 << 64) if x >> 63 else x for x in simhash.majority(s.view(np.uint64), simhash.FULL)] for s in sets]
    lanes = ", ".join(f"f{i} long" for i in range(simhash.FULL))
    nodes = spark.createDataFrame([(k, *b, len(s), k % 2) for k, (b, s) in enumerate(zip(bits, sets))], f"node long, {lanes}, n_shingles int, key long")
    hashes = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "node long, hashes array<long>")
    similar = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    for rows, shingles in ((1024, 1 << 21), (4, 1 << 21), (1024, 250)):
        root = list(range(60))
        for r in simhash.similar_links(nodes, hashes, 0.8, rows, shingles).collect():
            assert similar(r.a, r.b)
            root = [root[r.a] if x == root[r.b] else x for x in root]
        assert all(root[a] == root[b] for a in range(60) for b in range(a) if (a - b) % 2 == 0 and similar(a, b))


def test_rows_that_a_join_would_drop_are_not_shuffled_for_it(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS version", "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1), (-(1 << 63), -2), ((1 << 63) - 1, -3), (0, -4)], "version long, id long"))
    wanted = rows.where("id % 100 = 0 OR id < 0").select("version")
    every = {r["id"] for r in rows.where("version IS NOT NULL AND (id % 100 = 0 OR id < 0)").collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = simhash._likely(rows, wanted, "version")
        assert found.columns == rows.columns
        ids = [r["id"] for r in found.collect()]
        assert every <= set(ids) and len(ids) == len(set(ids)) < 5_000
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert every <= {r["id"] for r in simhash._likely(rows, wanted, "version", most_words=1).collect()}
        assert simhash._likely(rows, wanted.where("false"), "version").isEmpty()
        # the texts that are joined to partners are few
        seen = []
        monkeypatch.setattr(simhash, "map_rows", lambda df, *_: seen.append(df._jdf.queryExecution().executedPlan().toString()))
        simhash._sets(rows.selectExpr("cast(id AS string) AS text"), wanted.selectExpr("version AS node", "version"), 5, "text")
        assert "BroadcastHashJoin" in seen[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
