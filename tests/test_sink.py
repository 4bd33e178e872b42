"""Pages as files: all or none, the same again, and finished after a crash."""

import os

import pytest
from pyspark.sql import functions as F

from folio.plans.render import render
from folio.sources.sink import PageSink, file_name, finish, unfinished, write_pages


def tree(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_names():
    assert [file_name(p) for p in ("/a/b.md", "a//../b", "", "/.x/%41", "é?#")] == ["a/b.md.html", "a/%2E./b.html", "%2E.html", "%2Ex/%2541.html", "%C3%A9%3F%23.html"]


def test_rendered_files(spark, tmp_path):
    files = [("/c/a.md", b"# Title"), ("/c/d/b.csv", b"x,y\n1,2\n"), ("/c/d/.hidden.txt", b"t"), ("/c/../up.txt", b"u")]
    pages = render(spark.createDataFrame(files, "path string, content binary")).cache()
    for _ in range(2):  # again: the same files
        assert write_pages(pages, str(tmp_path)) == 4
        got = tree(tmp_path)
        assert set(got) == {"c/a.md.html", "c/d/b.csv.html", "c/d/%2Ehidden.txt.html", "c/%2E./up.txt.html"} and unfinished(str(tmp_path)) == {}
        assert {file_name(r.path): r.html.encode() for r in pages.collect()} == got


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    write_pages(spark.createDataFrame([("p7", "old")], "path string, html string"), str(tmp_path))
    rows = spark.range(40).repartition(4).select(F.format_string("p%s", "id").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.lit("new")).alias("html"))
    with pytest.raises(Exception, match="killed"):
        write_pages(rows, str(tmp_path))
    assert tree(tmp_path) == {"p7.html": b"old"} and unfinished(str(tmp_path)) == {}


def test_a_crash_before_or_while_renaming(spark, tmp_path):
    folder = str(tmp_path)
    spark.dataSource.register(PageSink)
    rows = spark.range(30).select(F.format_string("d%s/p%s", F.col("id") % 3, "id").alias("path"), F.col("id").cast("string").alias("html"))
    rows.repartition(3).write.format("pages").mode("append").option("job", "one").save(folder)
    assert not any(n.endswith(".html") for n in tree(tmp_path)) and list(unfinished(folder).values()) == [True]
    drafts = sorted(n for n in tree(tmp_path) if n.rpartition("/")[2].isdigit())
    os.makedirs(tmp_path / "gone")
    os.rename(tmp_path / drafts[0], tmp_path / "gone" / "x")  # as if it had been renamed already
    assert finish(spark, folder) == 30 and unfinished(folder) == {}
    assert len([n for n in tree(tmp_path) if n.endswith(".html")]) == 29
    os.makedirs(tmp_path / ".drafts-two" / "0-1")  # a job whose driver died before it committed
    assert finish(spark, folder) == 0 and list(unfinished(folder).values()) == [False]
    assert finish(spark, folder, discard=True) == 0 and unfinished(folder) == {}


def test_equal_paths_and_none(spark, tmp_path):
    rows = [("a", "one"), ("a", "two"), ("a", None), (None, "x")]
    assert write_pages(spark.createDataFrame(rows, "path string, html string").repartition(4), str(tmp_path / "x")) == 2
    first = tree(tmp_path / "x")
    assert write_pages(spark.createDataFrame(rows[::-1], "path string, html string").coalesce(1), str(tmp_path / "x")) == 2 and tree(tmp_path / "x") == first
    assert write_pages(spark.createDataFrame([], "path string, html string"), str(tmp_path / "y")) == 0
