import os

import pytest

import tessera
from pyspark.sql import functions as F
from fixtures import FILES, body
from tessera.sources import files as source_files
from tessera.sources import corpus as source_corpus
from tessera.sources.corpus import scan_table
from tessera.sources.files import drop_ignored, plan_scan, scan_corpus


@pytest.fixture
def tree(tmp_path):
    for name in ("pkg/__init__.py", "pkg/a.py", "pkg/_private/b.py", "pkg/.hidden/c.py", "pkg/note.txt", "gen/d.py", "gen/sub/e.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    return tmp_path


def scanned(scan, root):
    return sorted(os.path.relpath(r["path"], root) for r in plan_scan(scan).collect())


ALL = ["gen/d.py", "gen/sub/e.py", "pkg/.hidden/c.py", "pkg/__init__.py", "pkg/_private/b.py", "pkg/a.py"]


def test_finds_every_source_file(spark, tree):
    assert scanned(scan_corpus(spark, [str(tree)]), tree) == ALL


def test_overlapping_inputs_count_once(spark, tree):
    paths = [str(tree), str(tree / "pkg"), str(tree / "pkg" / "a.py"), str(tree / "pkg" / ".." / "gen")]
    assert scanned(scan_corpus(spark, paths), tree) == ALL


def test_ignored_file_folder_and_missing_paths(spark, tree):
    scan = scan_corpus(spark, [str(tree), str(tree / "pkg/note.txt"), str(tree / "none")],
                       ignore=[str(tree / "gen"), str(tree / "pkg/a.py"), str(tree / "gone")])
    assert scanned(scan, tree) == ["pkg/.hidden/c.py", "pkg/__init__.py", "pkg/_private/b.py"]
    problems = {(os.path.relpath(r["path"], tree), r["stage"]) for r in scan.errors.collect()}
    assert problems == {("pkg/note.txt", "scan"), ("none", "scan"), ("gone", "ignore")}


def test_links(spark, tree):
    """A linked file counts as its target, once; a linked folder is not entered."""
    outside = tree / "outside.py"
    outside.write_text("y = 2\n")
    (tree / "pkg/link.py").symlink_to(outside)
    (tree / "pkg/again.py").symlink_to(tree / "pkg/a.py")
    (tree / "pkg/folder").symlink_to(tree / "gen")
    found = scanned(scan_corpus(spark, [str(tree / "pkg")]), tree)
    assert found == ["outside.py", "pkg/.hidden/c.py", "pkg/__init__.py", "pkg/_private/b.py", "pkg/a.py"]


def test_long_ignore_list_is_a_join(spark, monkeypatch):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/bc/d.py",), ("/e.py",), ("/a/b.py",)], "path string")
    short = {r[0] for r in drop_ignored(paths, ["/e.py"], ["/a/b"]).collect()}
    monkeypatch.setattr(source_files, "_LITERAL_IGNORES", 0)
    joined = {r[0] for r in drop_ignored(paths, ["/e.py"], ["/a/b"]).collect()}
    assert short == joined == {"/a/bc/d.py", "/a/b.py"}


def test_contents_and_empty_corpus(spark, tmp_path):
    assert tessera.analyze(spark, [str(tmp_path)]).units.isEmpty()
    (tmp_path / "a.py").write_bytes(b"def f():\r\n    return '\xff'\r\n")
    report = tessera.analyze(spark, [str(tmp_path)])
    assert report.units.first()["source"] == "def f():\n    return '�'\n"


def test_analysis_end_to_end(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "one.py").write_text("def one(x):\n" + body(9))
    (tmp_path / "two.py").write_text("def two(x):\n" + body(9))
    report = tessera.analyze(spark, [str(tmp_path)])
    leaves = {r["name"]: r for r in report.leaves().collect()}
    assert leaves["one"]["other"] == "two" and leaves["two"]["other"] == "one"
    assert leaves["Empty"]["lines"] is None and leaves["m"]["lines"] == 5
    assert {r["name"] for r in report.leaves(functions_only=True).collect()} == {"f", "g", "m", "n", "h", "one", "two"}
    assert {r["display_name"] for r in report.display_names.collect()} >= {"A.m", "A.n", "f", "f1.py"}


def test_unreadable_file_is_an_error_row(spark, tree):
    scan = scan_corpus(spark, [str(tree / "gen")])
    (tree / "gen/d.py").unlink()
    report = tessera.plans.analysis.Report(scan.files())
    assert [(os.path.basename(r["path"]), r["stage"]) for r in report.errors.collect()] == [("d.py", "read")]
    with pytest.raises(Exception, match="d.py"):
        tessera.plans.analysis.Report(scan.files(), mode="FAILFAST").units.collect()


def test_one_client_per_store():
    opened = {}
    assert source_files._open("/a/b%20c.py", opened)[1] == "/a/b%20c.py"
    assert source_files._open("/a/d.py", opened)[1] == "/a/d.py"
    assert source_files._open("file:///a/b%20c.py", opened)[1] == "/a/b c.py"
    assert source_files._open("file:///a/d.py", opened)[1] == source_files._open("file:///a/d.py", opened)[1] == "/a/d.py"
    assert len(opened) == 2


@pytest.mark.parametrize("limits", [(200, 5_000), (1, 5_000), (40, 1)])
def test_scan_table_finds_what_the_scan_finds(spark, tree, monkeypatch, limits):
    """Whole subtrees, opened folders, and folders dealt by name; links, hidden names, repeated inputs."""
    monkeypatch.setattr(source_corpus, "PARTITIONS", limits[0])
    monkeypatch.setattr(source_corpus, "FILES_PER_PART", limits[1])
    outside = tree / "outside.py"
    outside.write_bytes(b"y = 2\r\nz = '\xe2\x82'\r")
    (tree / "pkg/link.py").symlink_to(outside)
    (tree / "pkg/again.py").symlink_to(tree / "pkg/a.py")
    (tree / "pkg/folder").symlink_to(tree / "gen")
    (tree / "pkg/lost.py").symlink_to(tree / "nowhere.py")
    paths = [str(tree / "pkg"), str(tree / "pkg/_private"), str(tree / "gen/d.py"), str(tree / "none")]
    ignore = [str(tree / "pkg/.hidden"), str(tree / "away")]
    rows = {os.path.relpath(r["path"], tree): r for r in scan_table(spark, paths, ignore).collect()}
    good = sorted(p for p, r in rows.items() if r["error"] is None)
    assert good == scanned(scan_corpus(spark, paths, ignore), tree)
    assert good == ["gen/d.py", "outside.py", "pkg/__init__.py", "pkg/_private/b.py", "pkg/a.py"]
    assert rows["outside.py"]["linked"] and not rows["pkg/a.py"]["linked"]
    assert rows["outside.py"]["content"] == "y = 2\nz = '\ufffd'\n" and rows["outside.py"]["size"] == 16
    assert {p: (r["kind"], r["size"], r["content"]) for p, r in rows.items() if r["error"]} == {
        "none": ("input", None, None), "away": ("ignore", None, None), "nowhere.py": ("file", None, None),
    }
    dry = scan_table(spark, paths, ignore, content=False)
    assert {r["content"] for r in dry.collect()} == {None} and dry.count() == len(rows)


def test_scan_table_of_nothing(spark, tmp_path):
    assert scan_table(spark, []).isEmpty() and scan_table(spark, [str(tmp_path)]).isEmpty()


@pytest.mark.parametrize("raw", [b"\xff", b"a\xe2\x82", b"\xf0\x9f\x98b", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\xafx", b"\xf1\x80\x41\xc3"])
def test_bad_bytes_are_replaced_as_python_does(spark, raw):
    row = spark.createDataFrame([(raw,)], "raw binary").select(source_files.decode(F.col("raw")).alias("text")).first()
    assert row["text"] == raw.decode("utf-8", "replace")
