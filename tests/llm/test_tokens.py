import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from rulemill.llm import grammar, packing, tokens
from rulemill.llm.tokens import Encoder, tokenizer_path

NAMES = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["a   b", "x \n\n y", "  lead", "trail  ", "a\tb  c \n", "<|endoftext|> hi", "t\t w\r\nn", " 's it's don't we'll", "　x y", "é a ̈b", "", "a\x00b \x01c", "İ ß ΣΑΣ ς.", "ŉ x\x85y  ", "\n", "\n a", None, " ", "Straße,! ÀÉ ÿŸ µ ª º", "日本語 テキスト。", "a.b.c...", "x" * 3000]


@pytest.fixture(scope="module", params=NAMES)
def codec(request):
    return Encoder(tokenizer_path(request.param), cache_pieces=50)


def check(codec, texts):
    ids, ends = codec.encode(pa.array(texts, pa.string()), 2)
    want = [e.ids + [2] for e in codec.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == want


def test_pieces_give_the_ids_of_whole_texts(codec, prose):
    check(codec, ODD + [prose(200), prose(50).upper(), "\n".join(prose(9) + "." for _ in range(9))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'.aBé1ß　\x01x世", max_size=25), min_size=1, max_size=4))
def test_any_text(codec, texts):
    check(codec, texts)


@pytest.mark.parametrize("name", NAMES)
def test_plain_words_need_no_pattern(name, prose, monkeypatch):
    texts = [prose(200), "One two, three!? four;", "UPPER lower", "end.", "", None]
    codec = Encoder(tokenizer_path(name))
    want = codec.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    plain = re.compile(r"[A-Za-z ]*[A-Za-z]")

    class Pattern:
        def fullmatch(self, piece):
            assert not plain.match(piece), piece

    monkeypatch.setattr(tokens, "_WORD", Pattern())
    ids, ends = codec.encode(pa.array(texts, pa.string()), 2)
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [e.ids + [2] for e in want]


def test_grammar_round_trips():
    rng = np.random.default_rng(0)
    for sizes, kinds in (([1], 3), ([1, 1, 1], 1), ([400, 1, 37, 900], 4), ([5000, 3000], 30), ([0, 5, 0], 2), ([3000], 70_000)):
        ids, ends = rng.integers(0, kinds, sum(sizes)).astype(np.uint32), np.cumsum(sizes)
        terminals, rules, lengths, symbols, symbol_ends = grammar.compress(ids, ends, rounds=6, pairs=50, least=3)
        shard = grammar.Shard(terminals, rules.tobytes(), lengths.tobytes(), symbols.tobytes(), symbol_ends.tolist())
        assert (shard.all() == ids).all()
        for k, part in enumerate(np.split(ids, ends[:-1])):
            assert shard.document(k).tolist() == part.tolist()
        for (a, b), n in zip(rules.tolist(), lengths.tolist()):
            assert n == sum(1 if s < terminals else int(lengths[s - terminals]) for s in (a, b))
    repeated = np.tile(np.arange(7, dtype=np.uint32), 500)
    assert len(grammar.compress(repeated, np.array([len(repeated)]))[3]) < len(repeated) / 4


def test_files_of_awkward_rows(spark, awkward, no_rows, tmp_path):
    path = tokenizer_path(NAMES[0])
    for name, frame, shard_ids in (("a", awkward, 500), ("b", awkward, 1 << 20), ("none", no_rows, 10)):
        grammar.write_token_files(frame, str(tmp_path / name), path, 2, shard_ids)
        rows = grammar.read_documents(spark.read.schema(grammar.SHARDS).parquet(str(tmp_path / name))).collect()
        rows.sort(key=lambda r: r["start"])
        codec = Encoder(path)
        want = Counter((r["doc_id"], codec.encode(pa.array([r["text"]], pa.string()), 2)[0].tobytes()) for r in frame.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert ids == sorted(ids)


def test_pieces_and_packing_of_awkward_rows(awkward, no_rows):
    parts = packing.pieces(awkward, tokenizer_path(NAMES[1]), 0, 256, with_ids=True)
    packed = packing.pack(parts, 256, block_pieces=40)
    rows = packed.collect()
    assert Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in rows) == Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in parts.collect())
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 256
    least = -(-sum(r["length"] for r in rows) // 256)
    assert least <= len(by_sequence) <= least * 1.03 + 1
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert {k: len(v) // 4 for k, v in whole.items()} == by_sequence
    assert packing.pack(packing.pieces(no_rows, tokenizer_path(NAMES[1]), 0, 256), 256).collect() == []


def test_a_length_that_fits_nowhere_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, 300)], "doc_id long, length long"), 256)


def test_columns_of_the_input_keep_their_names(spark):
    names = ["doc_id", "length", "filled", "at", "block", "bin", "items", "row", "rows", "offset", "sequence_id", "a b", "groups"]
    rows = spark.createDataFrame([(i % 5, 40 + i, *range(11)) for i in range(30)], ", ".join(f"`{n}` long" for n in names))
    out = packing.pack(rows, 256, block_pieces=7)
    assert out.columns == [n for n in names if n not in ("offset", "sequence_id")] + ["sequence_id", "offset"]
    assert sorted(r["length"] for r in out.collect()) == list(range(40, 70)) and {r["filled"] for r in out.collect()} == {0}


def test_search_beats_or_equals_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sizes = rng.integers(300, 800, 120).tolist()
        plain = packing._put(packing.Bins(2048), list(range(len(sizes))), sizes)
        found = packing.evolve(sizes, 2048, [], 1, generations=60)
        assert sorted(i for b in found.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) == 2048 - r for b, r in zip(found.bins, found.room))
        assert len(found.bins) <= len(plain.bins)
        again = packing.evolve(sizes, 2048, [found.bins], 2)
        assert len(again.bins) <= len(found.bins)


def test_white_space_that_is_found_by_its_bytes(monkeypatch):
    odd = ["a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\x1fb", "a\u0085b", "a\u00a0b", "a\u2003b", "a\u3000b", " \n"]
    plain = ["", " a", "a ", "\na", "a\n", "caf\u00e9 x", "\u00a1 b", "\u201cb\u201d", None]
    codec = Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = pa.array(["x", *odd, *plain, *odd], pa.large_string()).fill_null("")
    asked = []
    match = pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda some, pattern: asked.extend(some.to_pylist()) or match(some, pattern))
    assert codec._is_odd(texts.slice(1)).to_pylist() == [True] * len(odd) + [False] * len(plain) + [True] * len(odd)
    assert "caf\u00e9 x" not in asked and "" not in asked
    assert codec._is_odd(pa.array([], pa.large_string())).to_pylist() == []


def test_rules_of_a_round_are_expanded_together(monkeypatch):
    calls = []
    expand = grammar.Shard.expand
    monkeypatch.setattr(grammar.Shard, "expand", lambda self, symbols: calls.append(len(symbols)) or expand(self, symbols))
    ids = np.tile(np.arange(64, dtype=np.uint32), 200)
    terminals, rules, lengths, symbols, ends = grammar.compress(ids, np.array([len(ids)]))
    shard = grammar.Shard(terminals, rules.tobytes(), lengths.tobytes(), symbols.tobytes(), ends.tolist())
    assert len(rules) > 30 and len(calls) <= grammar.ROUNDS
    assert (shard.all() == ids).all()


def test_rules_that_each_use_the_one_before():
    pairs = np.array([(0, 0), *((1 + i, 0) for i in range(300))], "<u4")
    shard = grammar.Shard(1, pairs.tobytes(), np.arange(2, 303).astype("<u4").tobytes(), np.array([1, 301], "<u2").tobytes(), [1, 2])
    assert shard.all().tolist() == [0] * 304 and shard.document(1).tolist() == [0] * 302


def test_groups_do_not_carry_the_items_of_their_block(spark):
    row = "struct<doc_id: long, length: long, __place: long>"
    packed = spark.createDataFrame([(3, [(7, 2, 0), (8, 5, 1), (9, 1, 2)], [[1], [2, 0]])], f"block long, items array<{row}>, groups array<array<int>>")
    placed = packing._placed(packed, 0)
    assert sorted((r.doc_id, r.offset, r["__filled"]) for r in placed.collect()) == [(7, 1, 3), (8, 0, 5), (9, 0, 3)]
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert made and not any("items#" in line for line in made)
    below = plan[plan.rindex("Generate") :].splitlines()[1]
    assert "bins" in below


def test_pairs_are_replaced_until_none_stands_twice():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 5000, 1000)
    twice = np.concatenate([passage, [6000], passage, [6001]]).astype(np.uint32)
    assert len(grammar.compress(twice, np.array([1001, 2002]))[3]) < 10
    assert len(grammar.compress(np.zeros(5000, np.uint32), np.array([5000]))[3]) < 10
    for sizes, kinds in (([3000, 1, 800], 40), ([2000], 2), ([9, 9, 9], 1)):
        ids, ends = rng.integers(0, kinds, sum(sizes)).astype(np.uint32), np.cumsum(sizes)
        packed = grammar.compress(ids, ends)
        terminals, rules, lengths, symbols, symbol_ends = packed
        shard = grammar.Shard(terminals, rules.tobytes(), lengths.tobytes(), symbols.tobytes(), symbol_ends.tolist())
        assert [shard.document(k).tolist() for k in range(len(ends))] == [p.tolist() for p in np.split(ids, ends[:-1])]
        found = Counter()
        for part in np.split(symbols, symbol_ends[:-1]):
            pairs, i = list(zip(part.tolist(), part.tolist()[1:])), 0
            while i < len(pairs):
                found[pairs[i]] += 1
                i += 2 if i + 1 < len(pairs) and pairs[i] == pairs[i + 1] else 1
        assert max(found.values(), default=0) < 2


def test_pairs_whose_places_do_not_fit_beside_their_codes():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 5, (2, 2000)).astype(np.uint32)
    touching = np.zeros(2000, bool)
    narrow, wide = (grammar._pairs(left, right, np.uint64(bits), touching, 2) for bits in (3, 32))
    split = lambda codes, bits: [divmod(c, 1 << bits) for c in codes.tolist()]
    assert split(narrow[0], 3) == split(wide[0], 32) == sorted(set(zip(left.tolist(), right.tolist())))
    assert [x.tolist() for x in narrow[1:]] == [x.tolist() for x in wide[1:]]
