import zlib

import corpus_pipeline
from rulemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_equal_plain_versions(spark, tmp_path):
    """Every stage on what the one before kept."""
    frames, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs)
    language, unique, clean, private, packed = frames
    assert all(f.columns == start.columns for f in frames[:4])
    rows = [{r["doc_id"]: r["text"] for r in f.collect()} for f in (start, *frames[:4])]

    assert rows[1] == {i: t for i, t in rows[0].items() if t and any(c.isalpha() for c in t)}

    sets = {i: shingles(t) for i, t in rows[1].items()}
    similar = lambda a, b, least: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    gone = rows[1].keys() - rows[2].keys()
    assert gone and all(any(similar(i, j, 0.7) for j in rows[1] if j < i) for i in gone)
    assert not any(similar(i, j, 0.85) for i in rows[2] for j in rows[2] if i < j)

    items = [[w.strip(".,!") for w in r["text"].lower().split()] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in rows[2].items() for x in items if " ".join(x) in " ".join(w.strip(".,!") for w in t.lower().split())}
    assert leaked and rows[3] == {i: t for i, t in rows[2].items() if i not in leaked}

    assert rows[4].keys() == rows[3].keys()
    changed = {i for i in rows[3] if rows[3][i] != rows[4][i]}
    assert changed and all(any(c.isdigit() for c in rows[3][i]) for i in changed)

    from tokenizers import Tokenizer

    from rulemill.llm.tokens import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = set()
    for i, t in rows[4].items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want.add((i, k // 2048, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + 2048]))))
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()} == want


def test_run_ends_with_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and not out.isEmpty()


def test_stages_of_no_documents(spark, no_rows):
    docs = no_rows
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
