import glob
import json
import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import FILES, body
from tessera.operators import hierarchy, summary
from tessera.operators.skew import lookup_join, row_numbers
from tessera.plans.analysis import Report
from tessera.sources.report import read_document, read_report


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


@pytest.mark.parametrize(
    ("files", "root"),
    [
        (["/r/a/b/p/x.py"], "/r/a/b"),  # one level above the first folder with files
        (["/r/a/b/x.py", "/r/a/c/x.py"], "/r/a"),
        (["/r/x.py", "/r/a/x.py"], "/"),
        (["/x.py"], "root"),
        (["/a/x.py", "/b/x.py"], "/"),
    ],
)
def test_pruned_root(spark, files, root):
    nodes = hierarchy.build_hierarchy(paths(spark, *files))
    assert hierarchy.pruned_root(nodes).first()["node_id"] == root
    kept = hierarchy.prune(nodes).collect()
    assert [r["node_id"] for r in kept if r["parent_id"] is None] == [root]
    assert {r["node_id"] for r in kept if r["nodetype"] == "file"} == set(files)


def test_every_node_has_one_parent_and_weights_add_up(spark):
    report = Report(spark.createDataFrame([(f"/s/{n}", t) for n, t in FILES.items()], "path string, content string"))
    nodes = {r["node_id"]: r for r in report.weights.collect()}
    roots = [n for n in nodes.values() if n["parent_id"] is None]
    assert len(roots) == 1 and all(n["parent_id"] in nodes for n in nodes.values() if n["parent_id"])
    lines = [r["lines"] for r in report.leaves().collect() if r["lines"]]
    assert roots[0]["weight"] == pytest.approx(sum(math.log10(n + 1) for n in lines))


def test_row_numbers_equal_the_window(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("v")).withColumn(
        "g", F.when(F.col("g") == 2, F.lit(1)).otherwise(F.col("g"))
    )
    order = [F.col("v").desc(), F.col("id")]
    expected = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    found = row_numbers(rows, ["g"], order, "rank")
    assert found.select("id", "rank").exceptAll(expected.select("id", "rank")).isEmpty() and found.count() == 500


def test_salted_lookup_equals_the_join(spark, tiny_limits):
    facts = spark.range(100).select("id", F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 30).alias("k"))
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = lookup_join(facts, dim, ["k"], "n", "id")
    expected = facts.join(dim, "k")
    assert found.count() == 100 and found.exceptAll(expected.select(*found.columns)).isEmpty()


def test_quantiles_interpolate(spark):
    leaves = spark.createDataFrame([(1,), (2,), (4,), (10,)], "lines int")
    row = summary.line_summary(leaves).first()
    assert (row["median"], row["p90"]) == (3.0, pytest.approx(8.2))


def test_missing_values(spark):
    leaves = spark.createDataFrame([(4, 0.5, 1.0, 2), (6, None, None, None)], "lines int, duplication double, type_coverage double, todo_comments int")
    dup = summary.duplication_summary(leaves).first()
    assert (dup["mean"], dup["duplicated_lines"], dup["share"]) == (0.25, 2.0, 0.2)
    cover = summary.coverage_summary(leaves).first()
    assert (cover["n"], cover["mean"], cover["full_share"]) == (1, 1.0, 1.0)
    assert summary.coverage_summary(leaves.filter("type_coverage is null")).collect() == []
    nothing = leaves.filter("lines < 0")
    assert summary.marker_summary(nothing).first()["marked_share"] is None
    assert summary.duplication_summary(nothing).first()["share"] == 0.0
    assert tuple(summary.expression_summary(nothing.withColumn("expressions", F.lit(1))).first()) == (0, 0.0)
    assert {r["scaled"] for r in summary.scaled(leaves, "lines").collect()} == {0.0, 1.0}
    marks = summary.marker_summary(leaves).first()
    assert (marks["total"], marks["marked"], marks["marked_share"], marks["max"]) == (2, 1, 0.5, 2)
    assert summary.duplication_summary(leaves.withColumn("lines", F.lit(0))).first()["share"] == 0.0
    same = summary.scaled(leaves.withColumn("lines", F.lit(3)), "lines")
    assert {r["scaled"] for r in same.collect()} == {0.5}
    with pytest.raises(ValueError):
        summary.select_metric(leaves, "nothing")


@pytest.fixture(scope="module")
def report(spark):
    files = {f"/top/src/{n}": t for n, t in FILES.items()}
    files |= {"/top/src/é/one.py": "def one(x):\n" + body(9), "/top/lib/two.py": "def two(x):\n" + body(9), "/top/src/empty.py": ""}
    return Report(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_report_is_one_json_document(spark, report, tmp_path):
    out = str(tmp_path / "report")
    report.write(out)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*")))
    tree = json.loads(text)
    assert "é" in text and (tree["name"], tree["path"], tree["metrics"]) == ("top", "/top", None)
    lib, src = tree["children"]
    two = lib["children"][0]["children"][0]
    score = round(SequenceMatcher(None, "def two(x):\n" + body(9), "def one(x):\n" + body(9)).ratio(), 3)
    assert two["metrics"]["duplication"] == {"score": score, "other": "one", "lines_other": 10}
    assert [c["name"] for c in src["children"]] == ["empty.py", "f1.py", "f2.py", "f3.py", "f4.py", "f5.py", "é"]
    a = next(c for c in src["children"] if c["name"] == "f3.py")["children"][0]
    assert (a["nodetype"], a["metrics"], [m["qualname"] for m in a["children"]]) == ("class", None, ["A.m", "A.n"])

    nodes, errors = read_report(spark, out)
    assert errors.isEmpty()
    expected = report.nodes.select("node_id", "parent_id", "nodetype", "name", "path")
    found = nodes.select("node_id", "parent_id", "nodetype", "name", "path")
    assert found.exceptAll(expected).isEmpty() and found.count() == expected.count()

    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(tree, indent=2, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{not json")
    again, bad = read_document(spark, [str(whole), str(tmp_path / "bad.json")])
    assert bad.count() == 1
    own = [c for c in nodes.columns]
    assert nodes.select(own).exceptAll(again.select(own)).isEmpty() and again.count() == nodes.count()


def test_a_report_line_is_parsed_once(spark, tmp_path, capsys):
    """Each level of nodes reads the parsed records; nothing that reads the nodes parses JSON again."""
    (tmp_path / "part-0.txt").write_text(',{"name":"a.py","nodetype":"file","path":"/a.py","children":[]}\n')
    nodes, errors = read_report(spark, str(tmp_path))
    assert [(r["node_id"], r["parent_id"]) for r in nodes.collect()] == [("/a.py", "/")] and errors.isEmpty()
    nodes.explain()
    assert "from_json" not in capsys.readouterr().out


def test_broken_report_lines_are_errors(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text('{"name":"a.py","nodetype":"file","path":"/a.py","children":[]}\n{"name":\n')
    nodes, errors = read_report(spark, str(tmp_path))
    assert (nodes.count(), errors.count()) == (1, 1)


def test_summaries_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], "lines int, duplication double, todo_comments int")
    assert set(summary.line_summary(none).first()) == {0}
    assert set(summary.duplication_summary(none).first()) == {0}
    assert summary.marker_summary(none).first().asDict() == {"total": 0, "marked": 0, "marked_share": None, "max": 0}
