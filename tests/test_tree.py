"""The tree source: what is pruned is never opened, links stay inside, tasks by size, filters as targets."""

import os

import pytest

from corpusloom.errors import CorpusError
from corpusloom.sources import tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "top"
    for path, data in {"a.md": b"one", "src/b.py": b"two", "src/deep/c.py": b"x" * 50, "node_modules/big/d.js": b"no", "src/.git/e": b"no", "docs/f.bin": b"a\0b", "docs/g.txt": b"\xff\xfe", "log/h.log": b"no"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(data)
    (tmp_path / "secret.txt").write_text("outside")
    (tmp_path / "away").mkdir()
    os.symlink(tmp_path / "secret.txt", top / "link.txt")
    os.symlink(tmp_path / "away", top / "src" / "gone")
    os.symlink(top / "a.md", top / "inner.md")
    os.symlink(top, top / "src" / "round")
    return str(top)


def test_pruned_directories_are_never_opened(root):
    every = tree.Listing(root, dirs=frozenset())
    assert len(list(every.files())) == 11 and every.opened == 8
    some = tree.Listing(root, globs=("*.log", "deep"))
    assert {f.path for f in some.files()} == {"a.md", "inner.md", "link.txt", "src/b.py", "src/gone", "docs/f.bin", "docs/g.txt"}
    target = tree.Listing(root, targets=("src/deep",))
    assert [f.path for f in target.files()] == ["src/deep/c.py"] and target.opened == 3
    flat = tree.Listing(root, depth=1)
    assert {f.path for f in flat.files()} == {"a.md", "inner.md", "link.txt"} and flat.opened == 1
    with pytest.raises(CorpusError):
        list(tree.Listing(f"{root}/none").files())


def test_tree_as_rows(spark, root):
    rows = {r.path: (r.text, r.reason) for r in tree.scan_tree(spark, root, globs="*.log", mostBytes=40).collect()}
    assert rows == {"a.md": ("one", None), "inner.md": ("one", None), "link.txt": (None, "outside"), "src/gone": (None, "outside"), "src/b.py": ("two", None), "src/deep/c.py": (None, "too_large"), "docs/f.bin": (None, "binary"), "docs/g.txt": (None, "encoding")}
    assert {r.path for r in tree.scan_tree(spark, root, targets="src/deep,a.md", texts=False).collect()} == {"src/deep/c.py", "a.md"}
    with pytest.raises(Exception, match="path"):
        tree.scan_tree(spark, root, targets="../away").collect()


def test_filters_are_targets(spark, root):
    reader = tree.FilteredTreeReader({"path": root})
    assert len(list(reader.pushFilters([tree.StringStartsWith(("path",), "src/deep/c"), tree.EqualTo(("size",), 3)]))) == 2
    assert [f.path for s in reader.partitions() for f in s.files] == ["src/deep/c.py"] and reader.listing.opened == 3
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        assert [r.text for r in tree.scan_tree(spark, root).where("path = 'a.md'").collect()] == ["one"]
    finally:
        spark.conf.set(name, before)


def test_tasks_by_size():
    files = [tree.Found(f"f{k}", n, 0.0, False) for k, n in enumerate([100, 90, 50, 40, 10, 10])]
    shares = tree.dealt(files, task_bytes=100)
    assert sorted(sum(f.size for f in s.files) for s in shares) == [100, 100, 100] and len(tree.dealt([])) == 1 and len(tree.dealt(files, 1, most=2)) == 2


def test_texts_are_sent_as_they_fill(tmp_path, monkeypatch):
    """A task holds a few megabytes of texts, not its whole share."""
    for k in range(10):
        (tmp_path / f"f{k}.md").write_text("x" * 100)
    monkeypatch.setattr(tree, "SENT_BYTES", 250)
    reader = tree.TreeReader({"path": str(tmp_path)})
    sent = [b.num_rows for share in reader.partitions() for b in reader.read(share)]
    assert sum(sent) == 10 and max(sent) == 3
