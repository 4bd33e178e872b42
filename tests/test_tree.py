"""Trees dealt out by prefixes, with filters that go down."""

import os

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from folio.sources import tree as T


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        for j in range(5):
            os.makedirs(tmp_path / f"d{k}" / f"e{j}" / "deep")
            for n in range(4):
                (tmp_path / f"d{k}" / f"e{j}" / "deep" / f"f{n}.md").write_text("x" * (k * 10 + n))
            (tmp_path / f"d{k}" / f"e{j}" / ".hidden").write_text("h")
    (tmp_path / "top.txt").write_text("top")
    return tmp_path


def plain(root):
    rows = []
    for d, dirs, names in os.walk(root):
        rows += [(d, n, True, 0) for n in dirs] + [(d, n, False, os.path.getsize(f"{d}/{n}")) for n in names if not n.startswith(".")]
    return sorted(rows)


@pytest.mark.parametrize(("prefixes", "listed"), [(256, 64), (8, 64), (1, 64), (10_000, 3)])
def test_every_entry_once(spark, folder, monkeypatch, prefixes, listed):
    monkeypatch.setattr(T, "PREFIXES", prefixes)
    monkeypatch.setattr(T, "LISTED", listed)
    reader = T.TreeReader({"path": str(folder)})
    parts = reader.partitions()
    assert sorted(r[:4] for p in parts for r in reader.read(p)) == plain(folder)
    assert len(parts) >= min(prefixes, 6) or listed == 3


def test_filters_go_down(spark, folder):
    every = T.read_tree(spark, str(folder))
    assert sorted(tuple(r)[:4] for r in every.collect()) == plain(folder)
    some = every.where(~F.col("is_dir") & (F.col("size") >= 42) & F.col("name").endswith(".md") & F.col("dir").startswith(f"{folder}/d4/"))
    assert sorted(tuple(r)[:4] for r in some.collect()) == [r for r in plain(folder) if r[0].startswith(f"{folder}/d4/") and not r[2] and r[3] >= 42]
    reader = T.TreeReader({"path": str(folder)})
    left = list(reader.pushFilters([D.StringStartsWith(("dir",), f"{folder}/d2/"), D.EqualTo(("nonesuch",), 1), D.Not(D.EqualTo(("is_dir",), True)), D.In(("name",), ("f1.md", "f2.md")), D.IsNotNull(("size",))]))
    assert left == [D.EqualTo(("nonesuch",), 1)]
    parts = reader.partitions()
    assert all(str(folder) == p.folder or p.folder.startswith(f"{folder}/d2") for p in parts)  # other prefixes are spared
    assert len([r for p in parts for r in reader.read(p)]) == 5 * 2


def test_odd_folders(spark, tmp_path):
    assert T.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="none"):
        T.read_tree(spark, str(tmp_path / "none")).count()
    (tmp_path / ".h").write_text("x")
    assert [r.name for r in T.read_tree(spark, str(tmp_path), hidden=True).collect()] == [".h"]
