"""Packed trees: what is found in a document's row is what the node relation gives, and no plan sorts or shuffles nodes."""

import pytest
from pyspark.sql import functions as F

from treeshred.operators import nav
from treeshred.operators.mutate import push, push_first, remove, replace
from treeshred.operators.serialize import serialize, serialize_subtrees
from treeshred.operators.shred import nodes
from treeshred.operators.trees import trees, unpacked
from treeshred.operators.validate import validate
from treeshred.plans.xpath import xpath

SOURCES = ["<r><a k='1'><b>t</b><b/>u</a><a><c><b k='2'>&lt;</b></c></a><b>v</b></r>", "<r><a><a k='1'><b/></a></a></r>", "", None, "<r><a>x</r></q><b>y</b>", "<r> <!--c--><![CDATA[d]]><?p q?></r>"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("path", ["//b", "/r/a/b", "//a//b", "//a[@k='1']/b/text()", "//b/..", "//a[last()]", "//a[2]", "/r/node()", "//b/@k", "//a/@k/..", "/r//", ""])
def test_paths_in_packed_trees(xml, path):
    docs = xml(*SOURCES).persist()
    show = lambda df: sorted(((r.doc_id, r.ord[-1] if r.ord else 0, r.kind, r.tag or "", r.value or "", r.node_id or 0) for r in df.collect()), key=str)
    found = xpath(trees(docs), path)
    assert show(found) == show(xpath(nodes(docs), path))
    assert "Sort" not in plan(found) and "Exchange" not in plan(found)


def test_documents_are_shredded_and_validated_where_they_are(xml):
    docs = xml(*SOURCES).persist()
    assert sorted(map(str, unpacked(trees(docs)).collect())) == sorted(map(str, nodes(docs).collect()))
    for df in (unpacked(trees(docs)).where("kind = 'Document'"), validate(docs, "strict")):
        assert "Sort" not in plan(df) and "Exchange" not in plan(df) and plan(df).count("ArrowEvalPython") == 1


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))
    assert "Sort" not in plan(b) and "Exchange" not in plan(b)


def test_writing_and_changes_of_packed_trees(xml):
    docs = xml(*SOURCES[:4], "<r xml:space='preserve'> <a>\n<b xml:space='default'> <c/></b></a></r>").persist()
    tree, packs = nodes(docs).persist(), trees(docs)
    same(serialize(tree), serialize(packs))
    same(serialize_subtrees(tree.where("kind = 'Element'"), tree), serialize_subtrees(lambda n: n["kind"] == "Element", packs))
    some = "<x k='&lt;'><y>u</y></x><!--c-->"
    for change in (push, push_first, replace):
        same(change(tree, F.col("tag") == "a", xml=some), unpacked(change(packs, lambda n: n["tag"] == "a", xml=some)))
        with pytest.raises(ValueError):
            change(packs, lambda n: n["tag"] == "a")
    same(remove(tree, F.col("tag") == "b"), unpacked(remove(packs, lambda n: n["tag"] == "b")))
    named = {"attrs": {"t": F.col("tag")}}, {"attrs": {"t": lambda n: n["tag"]}}
    same(push(tree, F.col("tag") == "a", "Element", "z", **named[0]), unpacked(push(packs, lambda n: n["tag"] == "a", "Element", "z", **named[1])))


@pytest.mark.parametrize("name", ["children", "elements", "parent", "siblings", "resume", "child_counts", "last_child", "only_child", "digests"])
def test_navigation_in_packed_trees(xml, name):
    docs = xml(*SOURCES).persist()
    tree = nodes(docs).persist()
    of = getattr(nav, name)
    same(of(tree.where("tag in ('a', 'b', 'r')"), tree), of(lambda n: n["tag"].isin("a", "b", "r"), trees(docs)))


def test_places_in_packed_trees(xml):
    docs = xml(*SOURCES).persist()
    tree, packs = nodes(docs).persist(), trees(docs)
    same(nav.child_at(tree.where("tag = 'r'"), tree, 2), nav.child_at(lambda n: n["tag"] == "r", packs, 2))
    same(nav.simple_values(tree), nav.simple_values(packs))
    same(nav.depth_below(tree.where("kind = 'Text'"), tree.where("tag = 'a'")), nav.depth_below(lambda n: n["kind"] == "Text", lambda n: n["tag"] == "a", packs).drop("tag"))
