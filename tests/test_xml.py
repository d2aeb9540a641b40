"""The node relation and its operators, on small documents with answers written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from treeshred.functions import scalars
from treeshred.operators import dtd, nav
from treeshred.operators.build import cdata, comment, document, h, processing_instruction
from treeshred.operators.build import dtd as doctype
from treeshred.operators.lex import tokens
from treeshred.operators.mutate import push, push_first, remove, replace, set_attr
from treeshred.operators.serialize import serialize, serialize_subtrees, write_documents
from treeshred.operators.shred import nodes
from treeshred.operators.validate import require_valid, validate
from treeshred.plans.sql import register
from treeshred.plans.xpath import context, documents, parse, xpath
from treeshred.sources.documents import decode_bytes, from_column, numbered, read_documents
from treeshred.streaming.shred_stream import shred_stream

FLEET = '<fleet><ships><ship no="7" port="Kiel"><name>Elbe</name></ship><ship no="12" port="Bremen"><name>Weser</name><crew>31</crew></ship><ship no="15" port="Bremen"><name>Ems</name></ship></ships><pilots><pilot>Ole</pilot></pilots></fleet>'


@pytest.fixture(scope="module")
def fleet(spark):
    return nodes(spark.createDataFrame([(1, FLEET)], "doc_id long, source string")).persist()


@pytest.fixture(scope="module")
def thicket(spark):
    """Documents of nested a and b, at random."""
    rng = random.Random(11)

    def some(depth):
        kids = "".join(some(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else "t"
        tag = rng.choice("aab")
        return f'<{tag} k="{rng.randint(1, 2)}">{kids}</{tag}>' if rng.random() < 0.7 else f"<{tag}>{kids}</{tag}>"

    return nodes(spark.createDataFrame([(i, f"<r>{''.join(some(1) for _ in range(6))}</r>") for i in range(4)], "doc_id long, source string")).persist()


def column(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "plain"),
    [("&lt;a&gt;", "<a>"), ("&#38;amp;", "&amp;"), ("&#x1f600;", "\U0001f600"), ("&foo;", "&foo;"), ("&#xZZZ;", "&#xZZZ;"), ("&#55296;", "&#55296;"), ("&#99999999999;", "&#99999999999;"), ("a & b", "a & b"), ("", ""), ("&quot;&apos;", "\"'")],
)
def test_unescape(spark, text, plain):
    assert column(spark, scalars.unescape, text) == plain


def test_scalars(spark):
    assert column(spark, scalars.escape, "<a b=\"c\">'&amp;") == "&lt;a b=&quot;c&quot;&gt;&apos;&amp;amp;"
    assert column(spark, scalars.normalize_attr_ws, "a\r\nb\tc\nd\re") == "a b c d e"
    assert column(spark, scalars.escape_attr, "a\tb\r\n") == "a&#9;b&#13;&#10;"
    assert column(spark, scalars.is_name, "a:b-1") and not column(spark, scalars.is_name, "1a")


def test_nodes(xml):
    rows = nodes(xml('<r><a x="1">t1<b/></a><c>t2</c></r>')).orderBy("node_id").collect()
    assert [(r.kind, r.depth, r.tag, r.value, r.parent_id, r.child_pos, r.last_desc) for r in rows] == [
        ("Document", 1, None, None, None, None, 7),
        ("Element", 2, "r", None, 1, 1, 7),
        ("Element", 3, "a", None, 2, 1, 5),
        ("Text", 4, None, "t1", 3, 1, 4),
        ("Element", 4, "b", None, 3, 2, 5),
        ("Element", 3, "c", None, 2, 2, 7),
        ("Text", 4, None, "t2", 6, 1, 7),
    ]


def test_kinds_values_and_spans(xml):
    source = "<?xml version=\"1.0\"?><!DOCTYPE r [<!ENTITY a \"b>\">]><!----><r a='&lt;x\ty'>é&#x41;<![CDATA[<x>]]><?pi  body?><?q?><日本 á=\"ü\"></日本></r>"
    docs = xml(source)
    tree = nodes(docs)
    rows = {(r.kind, r.tag): r for r in tree.collect()}
    assert rows[("Declaration", None)].attrs[0].value == "1.0"
    assert rows[("DTD", None)].value == 'r [<!ENTITY a "b>">]'
    assert rows[("Comment", None)].value == ""
    assert rows[("Element", "r")].attrs[0].value == "<x y"
    assert rows[("Text", None)].value == "éA"
    assert rows[("CData", None)].value == "<x>"
    assert rows[("ProcessingInstruction", "pi")].value == "body" and rows[("ProcessingInstruction", "q")].value is None
    assert rows[("Element", "日本")].attrs[0].value == "ü"
    written = [r.source_text for r in nav.source_text(tree.where("parent_id = 5"), docs).orderBy("node_id").collect()]
    assert written == ["é&#x41;", "<![CDATA[<x>]]>", "<?pi  body?>", "<?q?>", '<日本 á="ü"></日本>']
    assert nav.splice(tree.where("kind = 'CData'"), docs, "!").first().spliced == source.replace("<![CDATA[<x>]]>", "!")
    raw = nodes(docs, decode=False).where("kind = 'Text'").first().value
    assert raw == "é&#x41;"


def test_tokens(xml):
    got = [(r.kind, r.raw, r.has_entities) for r in tokens(xml("<a x='&lt;'>b<!--c--></a>")).orderBy("seq", "part").collect()]
    assert got == [("OPEN_TAG", "<a", False), ("ATTR_NAME", "x", False), ("ATTR_VALUE", "'&lt;'", True), ("TAG_CLOSE", ">", False), ("TEXT", "b", False), ("COMMENT_OPEN", "<!--", False), ("COMMENT_CONTENT", "c", False), ("COMMENT_CLOSE", "-->", False), ("CLOSE_TAG", "</a", False), ("TAG_CLOSE", ">", False)]


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("/fleet/ships/ship", ["ship"] * 3),
        ("//ship[2]/name/text()", ["Weser"]),
        ("/fleet/ships/ship[2]/*", ["name", "crew"]),
        ("/fleet/*/ship[@port='Bremen'][last()]/name/text()", ["Ems"]),
        ("//ship[last()]/@no", ["15"]),
        ("//ship[@port='Bremen']/name/text()", ["Weser", "Ems"]),
        ("//ship[@port='Bremen'][1]/@no", ["12"]),
        ("//ship[@no]/@port", ["Kiel", "Bremen", "Bremen"]),
        ("//ship/name[3]/text()", ["Ems"]),
        ("//ship/.", ["ship"] * 3),
        ("//ship/node()/text()", ["Elbe", "Weser", "31", "Ems"]),
        ("//ship/..", ["ships"] * 3),
        ("//ship/../..//pilot/text()", ["Ole"] * 3),
        ("/fleet/*", ["ships", "pilots"]),
        ("//pilot/node()", ["Ole"]),
        ("./fleet/.", ["fleet"]),
        ("/nowhere/ship", []),
        ("/ships/ship", []),
        ("//ship[0]", []),
        ("/fleet/ships[-1]", []),
        ("//ship[4]", []),
        ("", []),
        ("//text()", ["Elbe", "Weser", "31", "Ems", "Ole"]),
        ("/fleet//name", ["name"] * 3),
        ("/fleet/pilots//", ["pilots", "pilot", "Ole"]),
        ("/..", []),
        ("/fleet/..", [None]),
        ("//ship/@no/..", []),
    ],
)
def test_xpath(fleet, path, found):
    rows = xpath(fleet, path).orderBy("ord").collect()
    assert [r.value if r.value is not None else r.tag for r in rows] == found


@pytest.mark.parametrize("path", ["/r/a/b", "/r/*/b[2]", "//a/b", "//b[@k]", "//a//b", "//b[3]/text()", "//a/b[last()]", "/r/a[@k='1'][2]/b", "//b/..", "//*/a/node()", "//a[1]/a/b"])
def test_xpath_single_pass_is_that_of_joins(thicket, path):
    tree = thicket
    show = lambda df: [(r.doc_id, r.node_id) for r in df.orderBy("doc_id", "ord").collect()]
    assert show(xpath(tree, path)) == show(xpath(tree, path, documents(tree)))


def test_paths_read_documents_once(xml):
    for path in ("/fleet/ships/ship[2]/name/text()", "//ship[@port='Kiel']/name/text()"):
        plan = xpath(nodes(xml(FLEET)), path)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") == 1


def test_xpath_bag_and_context(xml):
    tree = nodes(xml("<r><a><a><b>1</b></a></a><a><b>2</b><b>3</b></a></r>")).persist()
    assert xpath(tree, "//a//b").count() == 4
    assert [r.value for r in xpath(tree, "/r/a/b[1]/text()").collect()] == ["2"]
    from_a = xpath(tree, "b[1]/text()", context(tree.where("tag = 'a'"))).orderBy("ctx_id").collect()
    assert [r.value for r in from_a] == ["1", "2"]


@pytest.mark.parametrize("path", ["a[", "@", "a::b", "text(", "count(a)", "a|b", "a[b]", "a[@x=1]"])
def test_xpath_errors(path):
    with pytest.raises(ValueError):
        parse(path)


LEVELS = [
    ("<a/>", "strict", True),
    ("", "strict", True),
    (" \n", "strict", True),
    ("<a></b>", "lenient", False),
    ("<a>", "lenient", False),
    ("</a>", "lenient", False),
    ('<a x="1" x="2"/>', "lenient", False),
    ("<a x=1/>", "lenient", False),
    ("a<", "lenient", False),
    ("<!-- x", "lenient", False),
    ("<a/><b/>", "lenient", True),
    ("<a/><b/>", "structural", False),
    ("<a/>text", "structural", False),
    ("<!-- no root -->", "structural", False),
    ("<1a/>", "structural", False),
    ('<a x="<"/>', "structural", False),
    ("<a><?xml version='1.0'?></a>", "structural", False),
    ("<a/><!DOCTYPE a>", "structural", False),
    ("<!DOCTYPE a><!DOCTYPE a><a/>", "structural", False),
    ("<a><!-- a -- b --></a>", "structural", True),
    ("<a><!-- a -- b --></a>", "strict", False),
    ("<a>\x01</a>", "strict", False),
    ("<a>&#0;</a>", "strict", False),
    ("<a><?1 x?></a>", "strict", False),
    ("<?xml version='1.0'?><!DOCTYPE a [<!ELEMENT a (b|c)*>]><a/>", "strict", True),
]


def test_validate(xml):
    for level in ("lenient", "structural", "strict"):
        some = [(s, ok) for s, at, ok in LEVELS if at == level]
        got = {r.doc_id: r.ok for r in validate(xml(*[s for s, _ in some]), level).collect()}
        assert [got[i] for i in range(1, len(some) + 1)] == [ok for _, ok in some], level
    places = [("<a></b>", 3), ("é<a>", 2), ("<a/><b/>", 4), ("<a>\u00e9<b x='1' x='2'/></a>", 5)]
    found = {r.doc_id: r.at for r in validate(xml(*[x for x, _ in places]), "lenient").collect()}
    assert [found[1], found[2], found[3], found[4]] == [3, 2, None, 5]


def test_null_source_is_data(xml):
    docs = xml(None, "<a/>")
    assert [(r.ok, r.error) for r in validate(docs).orderBy("doc_id").collect()] == [(False, "lexical error"), (True, None)]
    assert nodes(docs).where("doc_id = 1").count() == 1


def test_navigation(xml):
    tree = nodes(xml(FLEET)).persist()
    ships = tree.where("tag = 'ships'")
    assert nav.children(ships, tree).count() == 3
    assert nav.siblings(tree.where("tag = 'pilots'"), tree).first().tag == "ships"
    assert [r.siblings for r in nav.sibling_counts(tree.where("tag in ('fleet', 'ship', 'crew')"), tree).orderBy("node_id").collect()] == [0, 2, 2, 1, 2]
    assert nav.parent(tree.where("tag = 'pilot'"), tree).first().tag == "pilots"
    assert nav.descendants(ships, tree).count() == 11
    assert {r.tag for r in nav.ancestors(tree.where("tag = 'pilot'"), tree).collect()} == {"pilots", "fleet", None}
    assert [r.tag for r in nav.resume(tree.where("tag in ('ships', 'pilots')"), tree).collect()] == ["pilots"]
    assert {r.simple_value for r in nav.simple_values(tree).where("is_simple").collect()} == {"Elbe", "Weser", "31", "Ems", "Ole"}
    assert nav.require_simple(tree.where("tag in ('name') or kind = 'Text'")).count() == 3
    with pytest.raises(Exception, match="simple elements only"):
        nav.require_simple(tree).collect()
    assert {(r.node_id, r.depth) for r in nav.depth_below(tree.where("kind = 'Text'"), tree.where("tag = 'pilots'")).collect()} == {(tree.where("value = 'Ole'").first().node_id, 2)}
    again = tree.select("doc_id", "node_id")
    assert tree.join(again, nav.same_node(tree, again)).count() == tree.count()
    assert tree.where("tag = 'ship'").select(nav.required("no").alias("no")).orderBy("no").first().no == "12"
    with pytest.raises(Exception, match="no attribute no"):
        tree.where("tag = 'crew'").select(nav.required("no")).collect()
    assert [r.line for r in nav.print_tree(tree).orderBy("node_id").collect()][:5] == ["Document", "  Element fleet", "    Element ships", "      Element ship", "        Element name"]


def test_events(xml):
    steps = nav.events(nodes(xml("<r><a>t</a><!--c--><b/></r>"))).orderBy("seq").collect()
    assert [(e.event, e.tag or e.kind) for e in steps] == [("node", "r"), ("node", "a"), ("node", "Text"), ("end", "a"), ("node", "Comment"), ("node", "b"), ("end", "b"), ("end", "r"), ("end", "Document")]
    assert [e.seq for e in steps] == list(range(1, 10))


def test_documents_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "<a><b/></a>"), (1, "<c/>"), (None, "<d>t</d>"), (None, "<e></f>"), (1, "<c/>")], "doc_id long, source string")
    assert sorted((r.doc_id or 0, r.last_desc) for r in nodes(docs).where("kind = 'Document'").collect()) == [(0, 2), (0, 3), (1, 2), (1, 2), (1, 3)]
    assert sorted((r.doc_id or 0, r.ok) for r in validate(docs).collect()) == [(0, False), (0, True), (1, True), (1, True), (1, True)]
    own = numbered(docs)
    assert own.select("doc_id").distinct().count() == 5 and sorted(map(str, own.collect())) == sorted(map(str, numbered(docs.repartition(3)).collect()))
    tree = nodes(own).persist()
    assert sorted(r.tag for r in nav.children(tree.where("kind = 'Document'"), tree).collect()) == ["a", "c", "c", "d", "e"]


def test_reading_and_writing_files(spark, xml, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_bytes("<a>é</a>".encode("utf-16"))
    (tmp_path / "in" / "b.xml").write_text("<b/>")
    docs = read_documents(spark, str(tmp_path / "in"), "strict")
    assert sorted(r.source for r in docs.collect()) == ["<a>é</a>", "<b/>"] and docs.select("doc_id").distinct().count() == 2
    with pytest.raises(Exception, match="more than 5 bytes"):
        read_documents(spark, str(tmp_path / "in"), most_bytes=5).collect()
    (tmp_path / "in" / "c.xml").write_text("<c>")
    with pytest.raises(Exception, match="unclosed element at byte 0"):
        read_documents(spark, str(tmp_path / "in"), "lenient").collect()
    write_documents(nodes(xml("<a><b/></a>")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().xml == "<a>\n  <b/>\n</a>"
    assert from_column(spark.createDataFrame([(5, "\ufeff<a/>")], "k int, x string"), "k", "x").first() == (5, "<a/>")


def test_subtrees_are_written_alone(xml):
    tree = nodes(xml('<r><a k="1"><b>t</b><!--c--></a>u</r>', "<a/>")).persist()
    got = {(r.doc_id, r.node_id): r.xml for r in serialize_subtrees(tree, tree).collect()}
    assert got == {(1, 1): '<r><a k="1"><b>t</b><!--c--></a>u</r>', (1, 2): '<r><a k="1"><b>t</b><!--c--></a>u</r>', (1, 3): '<a k="1">\n  <b>t</b>\n  <!--c-->\n</a>', (1, 4): "<b>t</b>", (1, 5): "t", (1, 6): "<!--c-->", (1, 7): "u", (2, 1): "<a/>", (2, 2): "<a/>"}


def test_tokens_from_an_offset(xml):
    docs = xml("<a é='1'><b/>x</a>")
    assert [r.raw for r in tokens(docs, 10).orderBy("seq", "part").collect()] == ["<b", "/>", "x", "</a", ">"]
    assert tokens(docs, 1000).count() == 0


def test_digests(xml):
    tree = nodes(xml('<r><a x="1" y="2">t</a><a y="2" x="1">t</a><a x="1" y="2">u</a><a x="1" y="2"/></r>')).persist()
    d = [r.digest for r in nav.digests(tree.where("tag = 'a'"), tree).orderBy("node_id").collect()]
    assert d[0] == d[1] and len(set(d)) == 3


@pytest.mark.parametrize(
    ("source", "out"),
    [
        ("<a></a>", "<a/>"),
        ("<a>x &amp; y</a>", "<a>x &amp; y</a>"),
        ("<a><b/><c>1</c></a>", "<a>\n  <b/>\n  <c>1</c>\n</a>"),
        ("<a> <b/> </a>", "<a>\n  <b/>\n</a>"),
        ("<a>t<b><c/></b></a>", "<a>t<b><c/></b></a>"),
        ('<a xml:space="preserve"> <b xml:space="default"> <c/> </b></a>', '<a xml:space="preserve"> <b xml:space="default">\n    <c/>\n  </b></a>'),
        ("<?xml version='1.0'?><!--c--><a/>", '<?xml version="1.0"?>\n<!--c-->\n<a/>'),
        ("", ""),
        (" \n ", ""),
        ("<a> </a>", "<a> </a>"),
    ],
)
def test_serialize(xml, source, out):
    assert serialize(nodes(xml(source))).first().xml == out


def test_serialize_is_a_fixed_point(xml):
    docs = xml(FLEET, "<a>t<b/></a>", "<r><x y='&#10;&lt;'/><![CDATA[z]]></r>")
    once = serialize(nodes(docs)).withColumnRenamed("xml", "source").persist()
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in serialize(nodes(once)).collect()}


def test_mutation(xml):
    tree = nodes(xml("<r><a/><b>t</b></r>")).persist()
    out = lambda t: serialize(t, 0).first().xml.replace("\n", "")
    assert out(set_attr(tree, F.col("tag") == "a", "k", F.lit("v"))) == '<r><a k="v"/><b>t</b></r>'
    assert out(push(tree, F.col("tag") == "r", "Element", "z")) == "<r><a/><b>t</b><z/></r>"
    assert out(push_first(tree, F.col("tag") == "r", "Element", "z")) == "<r><z/><a/><b>t</b></r>"
    assert out(remove(tree, F.col("tag") == "b")) == "<r><a/></r>"
    assert out(push(tree, F.col("tag") == "r", "Element", "z", attrs={"k": "1", "t": F.col("tag")})) == '<r><a/><b>t</b><z k="1" t="r"/></r>'
    some = '<x k="&lt;"><y>u</y></x><!--c-->'
    assert out(push(tree, F.col("kind") == "Element", xml=some)) == f"<r><a>{some}</a><b>t{some}</b>{some}</r>"
    assert out(push_first(tree, F.col("tag").isin("r", "b"), xml=some)) == f"<r>{some}<a/><b>{some}t</b></r>"
    assert out(replace(tree, F.col("kind") != "Document", xml=some)) == some
    assert out(replace(tree, F.col("tag") == "a", xml="<q/>v")) == "<r><q/>v<b>t</b></r>"
    for wrong in ({}, {"kind": "Element", "xml": "<a/>"}):
        with pytest.raises(ValueError):
            push(tree, F.col("tag") == "r", **wrong)
    with pytest.raises(Exception, match="unclosed"):
        push(tree, F.col("tag") == "r", xml="<a>")


def test_builders(spark):
    row = spark.range(1).select(h.a(h("b", "x<y", k='q"'), comment(F.lit("c")), cdata(F.lit("<d>")), n=1).column.alias("x")).first().x
    assert row == '<a n="1"><b k="q&quot;">x&lt;y</b><!--c--><![CDATA[<d>]]></a>'
    with pytest.raises(Exception, match="in a comment"):
        spark.createDataFrame([("-->",)], "x string").select(comment(F.col("x")).column).collect()


def test_constructors_check(spark):
    for wrong in (lambda: h("a b"), lambda: h.a(**{"1k": "v"}), lambda: processing_instruction("1"), lambda: document("text")):
        with pytest.raises(ValueError):
            wrong()
    more = h.a("x", k="1")(h.b(), k="2", j="3")
    row = spark.range(1).select(document(processing_instruction("p", F.lit("q")), doctype("a"), more).alias("x")).first().x
    assert row == '<?p q?><!DOCTYPE a><a k="2" j="3">x<b/></a>'


def test_dtd_steps_over_unknown_text():
    got = dtd.parse("r [<!ELEMENT a EMPTY> stray <!OTHER x> <!ELEMENT b ANY>]")
    assert [e["name"] for e in got["elements"]] == ["a", "b"] and got["error"]


def test_dtd():
    got = dtd.parse('r SYSTEM "r.dtd" [<!-- c --><!ELEMENT r (a|(b,c)*)><!ATTLIST r id ID #REQUIRED k (x|y) "x" f CDATA #FIXED "é"><!ENTITY % p "v"><!ENTITY e SYSTEM "u" NDATA n><!NOTATION n PUBLIC "p"> %p; ]')
    assert got["root"] == "r" and got["system_id"] == "r.dtd" and got["error"] is None
    assert got["elements"] == [{"name": "r", "content": "(a|(b,c)*)"}]
    assert [(a["name"], a["type"], a["default"]) for a in got["attributes"]] == [("id", "ID", "#REQUIRED"), ("k", "(x|y)", '"x"'), ("f", "CDATA", '#FIXED "é"')]
    assert [(e["name"], e["value"], e["external_id"], e["parameter"]) for e in got["entities"]] == [("p", "v", None, True), ("e", None, 'SYSTEM "u"', False)]
    assert got["notations"] == [{"name": "n", "external_id": 'PUBLIC "p"'}]


def test_byte_order_marks(spark):
    rows = [("<a/>".encode("utf-16"),), (b"\xfe\xff" + "<a/>".encode("utf-16-be"),), (b"\xef\xbb\xbf<a/>",), (b"<a/>",), (b"\x00<a/",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x binary").select(decode_bytes(F.col("x"))).collect()]
    assert got == ["<a/>"] * 4 + [None]


def test_views_and_stream(spark, xml, tmp_path):
    register(xml(FLEET), "u")
    assert spark.sql("SELECT count(*) FROM u_nodes WHERE tag = 'ship'").first()[0] == 3
    xml(FLEET, "<a/>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, source string").parquet(str(tmp_path / "in"))
    shred_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("tag = 'ship'").count() == 3


def random_tree(seed, n):
    """A document of n elements with ids, and (id, depth, size of its subtree) of each in document order."""
    rng, parents = random.Random(seed), [None]
    for k in range(1, n):
        parents.append(rng.choice(range(max(0, k - 40), k)))
    kids = {k: [c for c in range(n) if parents[c] == k] for k in range(n)}

    def build(k, depth):
        inner = [build(c, depth + 1) for c in kids[k]]
        rows = [r for _, rs in inner for r in rs]
        return f'<e i="{k}">{"".join(x for x, _ in inner)}</e>', [(k, depth, 1 + len(rows)), *rows]

    return build(0, 2)


def test_subtrees_over_many_blocks(xml):
    source, rows = random_tree(7, 900)
    tree = nodes(xml(source)).persist()
    at = {k: (place, size) for place, (k, _, size) in enumerate(rows)}
    some = tree.where("tag = 'e'").where(nav.get("i").cast("int") % 3 == 0)
    inside = {(int(r.i), r.n) for r in nav.descendants(some, tree).groupBy(F.col("of").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).join(tree, "node_id").select(nav.get("i").alias("i"), "n").collect()}
    assert inside == {(k, size - 1) for k, _, size in rows if k % 3 == 0 and size > 1}
    above = nav.ancestors(some, tree).groupBy("of").count().join(tree, F.col("of") == tree["node_id"]).select(nav.get("i").cast("int"), "count").collect()
    assert {tuple(r) for r in above} == {(k, depth - 1) for k, depth, _ in rows if k % 3 == 0}
    third = {k for k, _, _ in rows if k % 3 == 0}
    bag = sum(1 for k in third for c, _, _ in rows[at[k][0] + 1 : at[k][0] + at[k][1]] if c % 3 == 0)
    marked = set_attr(tree, nav.get("i").cast("int") % 3 == 0, "t", F.lit("y"))
    assert xpath(marked, "//e[@t]//e[@t]").count() == bag
    assert nav.digests(some, tree).count() == len(third)
    assert nav.child_counts(some, tree).agg(F.sum("length")).first()[0] == sum(p % 3 == 0 for p in parents_of(rows))


def parents_of(rows):
    path = []
    for k, depth, _ in rows:
        del path[depth - 2 :]
        if path:
            yield path[-1]
        path.append(k)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_number_as_a_new_reading_does(xml, seed):
    source, rows = random_tree(seed, 600)
    tree = nodes(xml(source)).persist()
    hit = nav.get("i").cast("int") % 7 == 3
    columns = ["node_id", "parent_id", "child_pos", "kind", "tag", "value", "attrs", "depth", "last_desc"]
    for changed in (push(tree, hit, "Element", "z"), push_first(tree, hit, "Text", None, F.lit("t")), remove(tree, hit), replace(tree, hit, "Comment", value=F.lit("c"))):
        again = nodes(serialize(changed, 0).select("doc_id", F.regexp_replace("xml", "\n", "").alias("source")))
        assert sorted(map(str, changed.select(*columns).collect())) == sorted(map(str, again.select(*columns).collect()))


def test_children_by_place(xml):
    tree = nodes(xml("<r><a/><b><c/></b></r>", "<r/>")).persist()
    assert {(r.doc_id, r.length) for r in nav.child_counts(tree.where("tag = 'r'"), tree).collect()} == {(1, 2), (2, 0)}
    assert [r.tag for r in nav.last_child(tree.where("tag = 'r'"), tree).collect()] == ["b"]
    assert {r.tag for r in nav.only_child(tree.where("kind = 'Element'"), tree).collect()} == {"c"}
    assert tree.limit(0).join(nav.child_counts(tree.limit(0), tree), "doc_id").count() == 0


def test_require_valid(xml):
    assert require_valid(xml("<a/>", "<b/>")).count() == 2
    with pytest.raises(Exception, match="document 2: unclosed element"):
        require_valid(xml("<a/>", "<b>")).collect()
