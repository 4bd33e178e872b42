"""Files, folders and changing files; containers that are damaged or too large."""

import os
import time

import pytest

from folio.operators import containers
from folio.plans.navigate import opened
from folio.sources.corpus import classified, read_corpus
from folio.sources.listing import read_listing, remote_entries
from folio.sources.work import shared_dir
from folio.streaming import watch as W
from tests import samples


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\x00" * 50)
    (tmp_path / ".hidden").write_text("no")
    rows = {os.path.basename(r.path): r for r in classified(spark, str(tmp_path)).collect()}
    assert {n: r.file_type for n, r in rows.items()} == {"a.md": "markdown", "b.bin": "binary"}
    large = {os.path.basename(r.path): r for r in read_corpus(spark, str(tmp_path), max_bytes=10).collect()}
    assert large["b.bin"].content is None and large["b.bin"].error == "file too large" and large["a.md"].error is None


def test_listing(spark, tmp_path):
    for name in ("b.txt", "A.txt", ".hidden", "a.txt"):
        (tmp_path / name).write_text("x" * 1280)
    (tmp_path / "zdir").mkdir()
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    rows = read_listing(spark, tmp_path).collect()
    assert [(r.name, r.note) for r in rows] == [("zdir", "folder"), ("A.txt", "1.2 KB"), ("a.txt", "1.2 KB"), ("b.txt", "1.2 KB"), ("gone", "0 B")]
    assert rows[0].path == f"{tmp_path}/zdir"


def test_listing_of_a_tree(spark, tmp_path):
    for name in ("a/b/c", "d", "a/.hidden"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "a" / "b" / "c" / "deep.txt").write_text("12345")
    (tmp_path / "d" / "loop").symlink_to(tmp_path)
    rows = read_listing(spark, tmp_path, recursive=True).collect()
    assert [(r.path.removeprefix(str(tmp_path)), r.is_dir, r.place) for r in rows] == [("/a", True, 1), ("/d", True, 2), ("/a/b", True, 1), ("/a/b/c", True, 1), ("/a/b/c/deep.txt", False, 1), ("/d/loop", True, 1)]
    assert sorted(r.name for r in remote_entries(spark, f"file://{tmp_path}").collect()) == ["a", "d"]


def test_opening_a_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("# here")
    (tmp_path / "p.html").write_text("<p>as is")
    assert "sub/" in opened(spark, str(tmp_path)).first().html
    assert "<h1>here</h1>" in opened(spark, str(tmp_path / "sub" / "n.md")).first().html
    page = opened(spark, str(tmp_path / "p.html")).first()
    assert page.html is None and page.url == f"file://{tmp_path}/p.html"
    assert opened(spark, str(tmp_path / "none")).count() == 0


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_a_query_runs_for_a_time(spark, tmp_path):
    query = W.watch(spark, str(tmp_path)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / ".check")).start()
    assert W.run_for(query, 1) is False and not query.isActive


def test_watch_follows_changes(spark, tmp_path):
    folder, store, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.mkdir(folder)

    def step():
        q = W.keep_latest(W.watch(spark, folder, "*.md"), store, check).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    def write(name, text, at):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", ns=(at, at))

    now = time.time_ns()
    write("a.md", "one", now)
    write("b.md", "same", now)
    write("c.txt", "other kind", now)
    step()
    write("a.md", "two", now - 10**9)  # an older time is a change too
    step()
    got = {os.path.basename(r.path): bytes(r.content).decode() for r in W.current(spark, store).collect()}
    assert got == {"a.md": "two", "b.md": "same"}


def test_latest_keeps_the_last_good_version(spark):
    rows = [("a", 1, b"x"), ("a", 2, None), ("b", 1, b"y"), ("b", 3, b"z"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "path string, mtime_ns long, content binary")
    assert sorted((r.path, bytes(r.content)) for r in W.latest(df).collect()) == [("a", b"x"), ("b", b"z")]


def test_parts_stay_within_the_budget(spark):
    bomb = samples.archive({"word/document.xml": "<w:document><w:p><w:r><w:t>still here</w:t></w:r></w:p></w:document>", "word/numbering.xml": "0" * 5000})
    df = spark.createDataFrame([("/b.docx", bomb), ("/t.docx", bomb[:60]), ("/n", None)], "path string, content binary")
    rows = {(r.path, r.part): r for r in containers.parts(df, r"word/.*", budget=1000).collect()}
    assert set(rows) == {("/b.docx", "word/document.xml"), ("/b.docx", "word/numbering.xml")}
    assert rows["/b.docx", "word/numbering.xml"].refused and not rows["/b.docx", "word/document.xml"].refused


def test_xml_reader_is_lenient(spark):
    xml = "<?xml v?><!DOCTYPE x><a x:k='1' k=\"2\">t &amp; <!-- c --><b/><![CDATA[<raw>]]></a><c d='>'>tail<unclosed"
    df = spark.createDataFrame([("p", xml)], "path string, text string")
    rows = containers.xml_nodes(df).orderBy("ev_id").collect()
    assert [(r.ev, r.name or r.text) for r in rows] == [("start", "a"), ("text", "t & "), ("empty", "b"), ("text", "<raw>"), ("end", "a"), ("start", "c"), ("text", "tail"), ("start", "unclosed")]
    assert rows[0].attrs == {"k": "1"} and rows[5].attrs == {"d": ">"}
