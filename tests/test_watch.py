"""Watched folders: changes, deletions, limits and failures; the table of generations against a plain dictionary."""

import os
import random

import pytest

from folio.plans import documents
from folio.streaming import watch as W
from folio.streaming.store import Store


@pytest.fixture
def watched(spark, tmp_path):
    os.mkdir(tmp_path / "in")

    def step(pattern="*", **how):
        q = W.keep_latest(W.watch(spark, str(tmp_path / "in"), pattern), str(tmp_path / "out"), str(tmp_path / "check"), **how).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {r.path.removeprefix(f"{tmp_path}/in/"): bytes(r.content).decode() for r in W.current(spark, str(tmp_path / "out")).collect()}

    return tmp_path / "in", step


def test_changes_and_deletions(watched):
    folder, step = watched
    assert step() == {}
    os.makedirs(folder / "sub" / "deep")
    for name in ("a.md", "sub/b.md", "sub/deep/c.md", ".hidden", "sub/.d.md"):
        (folder / name).write_text(name)
    assert step() == {n: n for n in ("a.md", "sub/b.md", "sub/deep/c.md")}
    os.remove(folder / "sub/b.md")
    (folder / "a.md").write_text("new")
    os.utime(folder / "a.md", ns=(1, 1))  # an older time is a change too
    assert step() == {"a.md": "new", "sub/deep/c.md": "sub/deep/c.md"}
    (folder / "sub/b.md").write_text("back")
    assert step() == {"a.md": "new", "sub/b.md": "back", "sub/deep/c.md": "sub/deep/c.md"}


def test_many_files_a_limit_at_a_time(watched, tmp_path):
    folder, step = watched
    for k in range(3000):
        (folder / f"{k}.txt").write_text(str(k))
    assert len(step(max_files=2000)) == 2000 and len(step(max_files=2000)) == 3000
    for k in range(0, 3000, 2):
        os.remove(folder / f"{k}.txt")
    assert step(max_files=2000) == {f"{k}.txt": str(k) for k in range(1, 3000, 2)}
    offsets = [(tmp_path / "check" / "offsets" / n).read_text() for n in sorted(os.listdir(tmp_path / "check" / "offsets")) if n.isdigit()]
    assert len(offsets) == 3 and len({len(x.splitlines()[-1]) for x in offsets}) == 1 and all(len(x.splitlines()[-1]) < 50 for x in offsets)


def test_no_limit_leaves_nothing_out(spark, watched, monkeypatch):
    folder, step = watched
    for k in range(40):
        (folder / f"{k}.txt").write_text(str(k))
    assert len(step(max_files=30)) == 30 and len(step(max_files=None)) == 40
    monkeypatch.setattr(W.keep_latest, "__defaults__", (None, 10))
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        found = documents.watched_files(spark, sf)
        assert found.count() == found.select("name").distinct().count() == spark.read.parquet(f"{sf}/pages.parquet").count() > 10


def test_an_unreadable_file_keeps_its_version(spark, watched, monkeypatch):
    folder, step = watched
    (folder / "a").write_text("one")
    assert step() == {"a": "one"}
    files = spark.createDataFrame([(str(folder / "a"), 1), (str(folder / "missing"), 1)], "path string, mtime_ns long")
    assert [r.path for r in W.contents(files).collect()] == [str(folder / "a")]
    known = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("c", 1, True), ("d", 1, False)], "path string, mtime_ns long, deleted boolean")
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("e", 5)], "path string, mtime_ns long")
    new, gone = W.changes(seen, known, 3, 100)
    assert {r.path for r in new.collect()} == {"b", "c", "e"} and [r.path for r in gone.collect()] == ["d"]
    firsts = {W.changes(seen, known, n, 1)[0].first().path for n in range(12)}
    assert firsts == {"b", "c", "e"}  # none waits for ever


def test_a_folder_that_is_gone_is_an_error(tmp_path):
    reader = W.WatchReader({"folders": f'["{tmp_path}/none"]'})
    with pytest.raises(OSError):
        reader.partitions({"scan": 0}, {"scan": 1})


@pytest.mark.parametrize("fan", [2, 3])
def test_generations(spark, tmp_path, fan):
    rnd, want, store = random.Random(fan), {}, Store(spark, str(tmp_path / "s"), fan)
    assert store.rows() is None
    for batch in range(14):
        rows = []
        for path in rnd.sample("abcdefgh", rnd.randrange(5)):
            gone = rnd.random() < 0.4
            rows.append((path, None if gone else f"{path}{batch}", gone))
            want.pop(path, None) if gone else want.update({path: f"{path}{batch}"})
        made = spark.createDataFrame(rows, "path string, content string, deleted boolean")
        assert store.append(batch, made) and not store.append(batch, made)
        assert {r.path: r.content for r in store.current().collect()} == want
    live = store.manifest()["runs"]
    assert len(live) <= (fan - 1) * 5 and max(level for _, level in live) >= 2
    folders = [n for n in os.listdir(tmp_path / "s") if n.startswith("run-")]
    assert len(folders) <= 2 * fan * 5 and len([n for n in os.listdir(tmp_path / "s" / "manifests") if n.isdigit()]) <= 2


def test_a_batch_that_died_is_replaced(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    schema = "path string, content string, deleted boolean"
    store.append(0, spark.createDataFrame([("a", "one", False)], schema))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda self, _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(1, spark.createDataFrame([("a", "lost", False)], schema))
    assert [r.content for r in store.current().collect()] == ["one"]
    assert store.append(1, spark.createDataFrame([("a", "two", False), ("b", "x", False)], schema))
    assert sorted(r.content for r in store.current().collect()) == ["two", "x"]
