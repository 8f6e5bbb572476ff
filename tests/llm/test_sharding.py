from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rulemill.llm.sharding import communication_matrix, hypergeometric, shard_rows, write_shards


def test_draws_have_the_hypergeometric_law(spark):
    total, marked, drawn, n = 40, 13, 17, 4000
    uniform = (F.col("id") + 0.5) / n
    got = Counter(r[0] for r in spark.range(n).select(hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), uniform)).collect())
    rng = np.random.default_rng(0).hypergeometric(marked, total - marked, drawn, 400_000)
    for k, count in Counter(rng.tolist()).items():
        assert abs(got.get(k, 0) / n - count / 400_000) < 0.01
    assert sum(got.values()) == n and min(got) >= 0 and max(got) <= marked


def test_draws_without_a_choice(spark):
    cases = [(10, 0, 5, 0), (10, 10, 5, 5), (10, 4, 10, 4), (10, 4, 0, 0), (1, 1, 1, 1)]
    for total, marked, drawn, want in cases:
        assert spark.range(1).select(hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.lit(0.999))).first()[0] == want


def test_matrix_rows_and_columns_add_up(spark):
    sizes = [5, 0, 17, 1, 30, 2, 2, 2, 40, 3, 8]
    frame = spark.createDataFrame(list(enumerate(sizes)), "block int, n long")
    matrix = {r["block"]: r["counts"] for r in communication_matrix(frame, 4, 1).collect()}
    assert [sum(matrix[b]) for b in range(len(sizes))] == sizes
    assert sorted(map(sum, zip(*matrix.values()))) == [27, 27, 28, 28]
    assert all(c >= 0 for counts in matrix.values() for c in counts)


def test_every_row_has_one_place(awkward):
    out = shard_rows(awkward, 7, seed=3, bucket_rows=4)
    assert out.columns == [c for c in awkward.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert set(by_shard) == set(range(7))
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_places_are_uniform(spark):
    """Over many seeds every row of a small table goes to several shards, and neighbours part."""
    rows = spark.range(12).repartition(3)
    seen, together = Counter(), 0
    for seed in range(8):
        at = {r["id"]: r["shard"] for r in shard_rows(rows, 3, seed).collect()}
        seen.update(at.items())
        together += at[0] == at[1]
    assert all(seen[i, s] < 8 for i in range(12) for s in range(3))
    assert together < 8


def test_no_rows_and_more_shards_than_rows(spark, no_rows):
    assert shard_rows(no_rows, 4).collect() == []
    out = shard_rows(spark.range(2), 5).collect()
    assert len({r["shard"] for r in out}) == 2 and {r["slot"] for r in out} == {0}


def test_files_hold_all_rows(spark, awkward, tmp_path):
    write_shards(awkward, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == awkward.count()
