"""Whole JSON documents of reports, cut at every kind of border, against a plain parser."""

import json
import random

import pytest

from tessera.sources.jsonindex import json_nodes
from tessera.sources.report import read_document

WORDS = ["{", "}", "[", "]", '"', "\\", "\\\\", '\\"', "é", "日本", "😀", "\n", ",", ":", " ", "children", "x" * 40, '{"a": [']


def node(rng, depth, path):
    own = {"name": "".join(rng.choice(WORDS) for _ in range(rng.randrange(6))), "nodetype": "file", "path": path,
           "qualname": "", "docstring": "\\" * rng.randrange(5), "source": "".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))}
    if rng.random() < 0.6:
        own["metrics"] = {"lines": rng.randrange(99), "duplication": rng.choice((None, {"score": 0.5, "other": "]}", "lines_other": 3}))}
    kids = [node(rng, depth - 1, f"{path}/{i}") for i in range(rng.randrange(4))] if depth else []
    fields = [*own.items()]
    fields.insert(rng.randrange(len(fields) + 1), ("children", kids))
    return dict(fields)


def flat(tree, above=None):
    yield (tree["path"], above, tree["name"], tree["source"], tree["docstring"], (tree.get("metrics") or {}).get("lines"))
    for kid in tree["children"]:
        yield from flat(kid, tree["path"])


def read_back(spark, path, size):
    nodes, errors = read_document(spark, str(path), size)
    rows = [(r["node_id"], r["parent_id"], r["name"], r["source"], r["docstring"], r["metrics"] and r["metrics"]["lines"]) for r in nodes.collect()]
    return sorted(rows, key=repr), errors.collect()


@pytest.mark.parametrize(("seed", "size", "spaced"), [(1, 7, None), (2, 64, 2), (3, 1, None), (4, 1 << 20, 1)])
def test_documents_cut_anywhere(spark, tmp_path, seed, size, spaced):
    rng = random.Random(seed)
    trees = [node(rng, 2 if size == 1 else 4, f"/r{k}") for k in range(1 if size == 1 else 3)]
    for k, tree in enumerate(trees):
        (tmp_path / f"{k}.json").write_text(json.dumps(tree, indent=spaced, ensure_ascii=k == 1), encoding="utf-8")
    rows, errors = read_back(spark, tmp_path, size)
    assert not errors and rows == sorted((r for t in trees for r in flat(t)), key=repr)


BAD = {
    "cut": ('{"name": "a", "path": "/a", "children": [{"name": "b"', 53, "ends inside a value"),
    "open string": ('{"name": "a}', 12, "ends inside a value"),
    "crossed": ('{"name": "a", "children": [{]}', 28, "bracket that closes nothing"),
    "closed twice": ('{"name": "a", "children": []}}', 29, "bracket that closes nothing"),
    "two": ('{"name": "a", "children": []} {"name": "b"}', 30, "more than one document"),
    "no comma": ('{"name": "a", "children": [{"name": "b"}{"name": "c"}]}', 40, "not a node"),
    "a word": ('{"name": "a", "children": [{"name": "b"}, true]}', 40, "not a node"),
    "bad field": ('{"name": "a", "children": [{"name": b}]}', 27, "invalid JSON"),
    "no node": ("  12", 0, "not a node"),
}


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_bad_documents_are_error_rows(spark, tmp_path, size):
    for name, (text, _, _) in BAD.items():
        if size > 16 or name not in ("no comma",):  # what stands between two nodes on both sides of a border is not judged
            (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "good.json").write_text('{"name": "g", "path": "/g", "children": []}')
    nodes, errors = json_nodes(spark, str(tmp_path), size)
    found = {r["file"].rpartition("/")[2].removesuffix(".json"): (r["error"], r["at"]) for r in errors.collect()}
    assert [r["file"].rpartition("/")[2] for r in nodes.collect()] == ["good.json"]
    assert set(found) == {n for n in BAD if size > 16 or n != "no comma"}
    for name, (error, at) in found.items():
        assert error == BAD[name][2] and (size == 16 or at == BAD[name][1]), name


def test_a_large_document_is_read_by_several_tasks(spark, tmp_path):
    body = "x = '{[' \\ \n" * 900
    with open(tmp_path / "large.json", "w", encoding="utf-8") as out:
        out.write('{"name": "r", "nodetype": "directory", "path": "/r", "children": [')
        for k in range(2_000):
            row = {"name": f"f{k}.py", "nodetype": "file", "path": f"/r/f{k}.py", "source": f"{k} {body}", "children": []}
            out.write(("," if k else "") + json.dumps(row))
        out.write("]}")
    nodes, errors = read_document(spark, str(tmp_path / "large.json"))
    assert errors.isEmpty() and nodes.count() == 2_001
    assert nodes.filter("parent_id = '/r'").count() == 2_000
    sources = nodes.filter("name <> 'r'").selectExpr("name", "source").collect()
    assert {(r["name"], r["source"]) for r in sources} == {(f"f{k}.py", f"{k} {body}") for k in range(2_000)}
