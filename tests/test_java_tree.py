"""Java declarations against hand-made trees."""

from corvane.functions import text as T
from corvane.operators import java_tree as jt
from corvane.operators import nodes


def shape(source):
    """(depth, kind, name) of the nodes in walk order."""
    out = []
    for n in jt.java_tree(source):
        depth, up = 0, n.parent
        while up:
            depth, up = depth + 1, up.parent
        out.append((depth, n.kind.removesuffix("_declaration"), n.name))
    return out


def test_types_in_types():
    assert shape("package a; import b.c; class A { interface I { int f(); default void g() {} } enum E { X, Y; void h() {} } record R(int a) { R { } R() { this(1); } } @interface N { int v() default 1; String[] w() default {\"x\"}; class Z {} } }") == [
        (0, "class", "A"), (1, "interface", "I"), (2, "method", "f"), (2, "method", "g"), (1, "enum", "E"), (2, "method", "h"), (1, "record", "R"), (2, "constructor", "R"),
        (1, "annotation_type", "N"), (2, "annotation_type_element", "v"), (2, "annotation_type_element", "w"), (2, "class", "Z"),
    ]


def test_anonymous_and_local_types():
    source = "class A { Runnable r = new Runnable() { public void run() { class L { void m() {} } } }; void f() { g(() -> { return new Z<>(1) { int q() { return 2; } }; }); final class F {} int[] a = new int[]{1}; } enum E { P(1) { void e() {} }, @X(Y.class) Q; E(int k) {} } { int x; } static { class S {} } }"
    assert shape(source) == [
        (0, "class", "A"), (1, "field", "r"), (2, "method", "run"), (3, "class", "L"), (4, "method", "m"), (1, "method", "f"), (2, "method", "q"), (2, "class", "F"), (1, "enum", "E"), (2, "method", "e"), (2, "class_literal", None), (2, "constructor", "E"), (1, "class", "S"),
    ]


def test_heads_of_methods():
    source = "abstract class A<T extends Comparable<T>> extends B<C<T>> implements D { public A(int x) throws E {} abstract <U> Map<U, int[]> f(@N(a = 1) U... u)[] throws X, Y; int a = 1, b = f(2); boolean less = a < b && c > d; a.b.C<int[]> g() { return null; } void h(A this) {} }"
    assert [(k, n) for _, k, n in shape(source)] == [("class", "A"), ("constructor", "A"), ("method", "f"), ("field", "a"), ("field", "less"), ("method", "g"), ("method", "h")]


def docs(source):
    return [(r[1], r[14], r[7]) for r in nodes.java_nodes(source)]


def test_doc_comments_are_siblings_right_before():
    assert docs("/** A. */ class A {\n/** f */\n@O\nint f();\n/** g */ // between\nvoid g() {}\n/** h */\n\nvoid h() {}\n/* k */ void k() {}\n/** i */ int i;\nvoid l() {}\n@O /** m */ void m() {}\n/** E */ enum E { }\n/**/ void n() {} }") == [
        ("A", "class", "A."), ("f", "function", "f"), ("g", "function", None), ("h", "function", None), ("k", "function", None), ("l", "function", None), ("m", "function", None), ("E", "enum", "E"), ("n", "function", "/"),
    ]


def test_words_in_strings_and_comments_are_none():
    assert shape('class A { String s = "class B { }"; // class C {\n char c = \'{\'; String t = """\n class D { \\""" } """; /* class E { */ }') == [(0, "class", "A"), (1, "field", "s"), (1, "line_comment", None), (1, "field", "c"), (1, "field", "t"), (1, "block_comment", None)]


def test_walk_has_parents_and_siblings():
    rows = nodes.java_walk("/* a */ class A { // b\n int f() { /* c */ } /* d */ }\nclass B {}")
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [
        (0, None, None, "block_comment", None), (1, None, 0, "class_declaration", "A"), (2, 1, None, "line_comment", None), (3, 1, 2, "method_declaration", "f"),
        (4, 3, None, "block_comment", None), (5, 1, 3, "block_comment", None), (6, None, 1, "class_declaration", "B"),
    ]
    assert rows[3][10] == "int f() { /* c */ }" and rows[3][6:10] == (2, 1, 2, 20)


def test_columns_count_bytes():
    row = nodes.java_nodes("/** é */ class A { /* é */ int ü() { } }")
    assert [(r[1], r[8], r[9]) for r in row] == [("A", 10, 43), ("ü", 29, 41)]


def test_broken_sources_give_what_can_be_made_out():
    assert shape("class A { void f( { int x; }") == [(0, "class", "A"), (1, "method", "f")]
    assert shape("}}} class B { void g() {} } class") == [(0, "class", "B"), (1, "method", "g")]
    assert shape("class A { int ; void f() { ) ] ; } } class B {") == [(0, "class", "A"), (1, "field", "int"), (1, "method", "f"), (0, "class", "B")]
    for some in ("class A {" * 3000, "(" * 50_000, "@" * 50_000, "new " * 20_000, "a<" * 20_000, "/*" * 20_000, "class A { " + "x " * 50_000):
        nodes.java_nodes(some)


def test_metrics_and_entities(spark):
    source = "/** Doc of it here. */\npublic class A {\n  /** Builds all of it. */\n  public A() {}\n  // counts all the rows\n  /* two\n lines here now */\n  interface I { int f(); }\n  Class<?> k = A.class;\n}\n"
    df = spark.createDataFrame([("A.java", "Java", source)], "file_path string, language string, text string")
    m = nodes.file_metrics(df, ["file_path"]).first()
    assert (m["total_functions"], m["documented_functions"], m["total_classes"], m["documented_classes"], m["total_public_functions"]) == (2, 1, 3, 1, 1)
    assert (m["total_comment_lines"], m["meaningful_comment_lines"], m["has_meaningful_comment"], sorted(m["doc_lengths"])) == (3, 3, True, [4, 4])
    found = {(r["entity_type"], r["entity_name"]) for r in nodes.entities(df, ["file_path"]).collect()}
    assert found == {("class", "A"), ("constructor", "A"), ("comment", None)}
    said = nodes.comments(df, "text").select("is_javadoc", T.count_tokens("text").alias("n")).collect()
    assert [r["is_javadoc"] for r in said] == [True, True, False, False]
