"""Quoted line breaks, read by many tasks."""

import csv
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rulemill.sources.csv import read_csv
from tests.conftest import values

PIECES = ["a", "b;", '"', '""', "\n", "\r\n", ";", "é", "x y", " ", '5"x']


@pytest.fixture
def split_bytes(spark):
    """Sets the size of the byte ranges; a file is cut into that many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_records_do_not_depend_on_where_files_are_cut(spark, tmp_path, split_bytes, line_end):
    rng = random.Random(5)
    want = []
    for k in range(2):
        rows = [(f"{k}-{i}", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(2))) for i in range(80)]
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, delimiter=";", lineterminator=line_end)
            out.writerows([("id", "b", "c"), *rows])
        want += [tuple(c or None for c in row) for row in rows]
    paths = [str(tmp_path / f"{k}.csv") for k in range(2)]
    for size in ("128m", "997", "61", "17"):
        split_bytes(size)
        for columns in (None, ["id", "b", "c"]):
            df = read_csv(spark, paths, columns=columns, multi_line=True)
            assert values(df) == sorted(want, key=lambda t: tuple((x is not None, str(x)) for x in t))
        if size == "61":
            lines = spark.read.option("lineSep", "\n").text(paths)
            assert lines.select(F.col("_metadata.file_block_start").alias("at"), F.spark_partition_id().alias("task")).distinct().count() > 10


def test_a_cell_over_many_ranges(spark, tmp_path, split_bytes):
    cell = "\n".join(f'line "{i}"; or so' for i in range(200))
    with open(tmp_path / "long.csv", "w", newline="") as f:
        csv.writer(f, delimiter=";").writerows([("k", "text"), ("1", cell), ("2", "plain"), ("3", cell[:500])])
    split_bytes("50")
    assert values(read_csv(spark, str(tmp_path / "long.csv"), multi_line=True)) == [("1", cell), ("2", "plain"), ("3", cell[:500])]


def test_headers_blank_records_and_odd_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"k";"v"\n1;"x\ny"\n\n2\n;\n3;5"x;more\n'.encode())
    df = read_csv(spark, str(tmp_path / "a.csv"), columns=["k", "v"], multi_line=True)
    assert values(df) == [(None, None), ("1", "x\ny"), ("2", None), ("3", '5"x')]
    with pytest.raises(PySparkException, match="header"):
        read_csv(spark, str(tmp_path / "a.csv"), columns=["k", "w"], multi_line=True).collect()
    (tmp_path / "only.csv").write_text("a;b\n")
    assert read_csv(spark, str(tmp_path / "only.csv"), multi_line=True).collect() == []


def test_encodings(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes('a;b\né;"1\nü"\n'.encode("latin-1"))
    (tmp_path / "wide.csv").write_bytes('a;b\né;"1\nü"\n'.encode("utf-16"))
    for name, encoding in (("latin", "ISO-8859-1"), ("wide", "UTF-16")):
        assert values(read_csv(spark, str(tmp_path / f"{name}.csv"), encoding=encoding, multi_line=True)) == [("é", "1\nü")]
