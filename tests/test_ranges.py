"""A large delimited file in ranges gives the cells of the single pass."""

import random
import time
import tracemalloc

import pytest

from folio.operators.delimited import split_rows
from folio.operators.ranges import Scanner, large_csv_cells


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def cells(df):
    return sorted((r.path.rpartition("/")[2], r.row_idx, r.col_idx, r.value) for r in df.collect())


def single(texts, delimiter=","):
    return sorted((name, *c) for name, t in texts.items() for c in split_rows(t, delimiter, None))


def written(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return str(folder)


def random_text(rnd, n):
    words = ["a", "bc", ",", ",", '"', '""', "\n", "\n", "\r\n", "\r", '"x\ny"', '"', "é日", ",\n", '"long\n' + "z" * 90 + '"', " "]
    return "".join(rnd.choice(words) for _ in range(n))


def test_random_quoting(spark, tmp_path, small_ranges):
    rnd = random.Random(9)
    texts = {f"f{k}.csv": random_text(rnd, rnd.choice((3, 400, 900))) for k in range(14)}
    texts |= {"open.csv": "a,b\n" + '"never closed\n' * 200, "end.csv": "x\n" * 300 + "a,b,", "full.csv": "x\n" * 300 + "a,b,\n", "cell.csv": 'k,"' + "line\n" * 500 + '",v\nnext,1\n', "turn.csv": ('"\n' * 501), "mark.csv": "﻿a,b\n" * 80 + "c"}
    path = written(tmp_path, texts)
    want = single({k: t.removeprefix("﻿") for k, t in texts.items()})
    assert cells(large_csv_cells(spark, path, ",")) == want
    assert cells(large_csv_cells(spark, path, ",", broadcast_ranges=0)) == want
    parts = spark.read.text(path + "/cell.csv").selectExpr("_metadata.file_block_start").distinct().count()
    assert parts >= 4


def test_delimiter_of_the_first_line(spark, tmp_path, small_ranges):
    texts = {"a.csv": 'n;"x;\ny";z\n' * 100}
    got = large_csv_cells(spark, written(tmp_path, texts) + "/a.csv")
    assert cells(got) == single(texts, ";") and got.where("is_header").count() == 3
    (tmp_path / "none.csv").write_bytes(b"")
    assert large_csv_cells(spark, str(tmp_path / "none.csv")).count() == 0


def test_long_cells_take_little_memory():
    """A quoted cell of 50 MB, of the single pass and of a range."""
    text = 'k,"' + "some words ""quoted"" and more\n" * 1_600_000 + '",v\n'
    for run in (lambda: list(split_rows(text, ",", None)), lambda: list(Scanner(",").feed(text))):
        tracemalloc.start()
        began = time.perf_counter()
        assert [len(c[2]) for c in run()] == [1, len(text) - 7, 1]
        assert time.perf_counter() - began < 10 and tracemalloc.get_traced_memory()[1] < 4 * len(text)
        tracemalloc.stop()
