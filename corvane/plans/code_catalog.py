"""Queries that read source code, each with its SQL twin.

No table holds code, so every document becomes a source file that carries its whole text in
a comment: a Python file, a Java class, a Java interface, or a Python file that is broken.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import nodes
from corvane.plans.catalog import _MEANINGFUL, _docs, _query
from corvane.plans.landed_catalog import _LINE_SQL

_PYTHON = 'class C%s:\n    """Doc of it."""\n    def f(self):\n        # so %s\n        return 1\n\ndef _g():\n    pass\n'
_CLASS = "/** Makes it. */\n@Ok\npublic class C%s {\n  // so %s\n  Runnable r = new Runnable() { public void run() { } };\n  /** Builds. */\n  public C() { this(C.class); }\n  private int n(int x) { return x; }\n}\n"
_INTERFACE = "package p;\n/**\n * Reads it.\n */\ninterface C%s {\n  // so %s\n  /** Far. */\n\n  int size();\n  enum E { A { int v() { return 1; } }, B; int v() { return 0; } }\n  @interface M { int v() default 1; }\n}\nrecord R(int a) { R { } }\n"
_BROKEN = "# %s so %s\ndef (\n"


def _sources(spark, sf):
    line = F.regexp_replace("text", r"[\s\x0b\x1c-\x1f\x85\u2028\u2029]+", " ")
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    made = F.when(k == 0, F.format_string(_PYTHON, i, line)).when(k == 1, F.format_string(_CLASS, i, line)).when(k == 2, F.format_string(_INTERFACE, i, line)).otherwise(F.format_string(_BROKEN, i, line))
    return _docs(spark, sf).select("doc_id", F.when(k.isin(1, 2), "Java").otherwise("Python").alias("language"), made.alias("text"))


def _rows_sql(columns: str, *templates: str) -> str:
    """Rows of each template, told by the remainder of the id; templates are SQL row lists."""
    return " union all ".join(f"select doc_id, {columns} from (select doc_id, 'C' || doc_id c, {_LINE_SQL} line from documents where doc_id % 4 = {k}), (values {rows}) t(r)" for k, rows in enumerate(templates) if rows)


_NODE = "case when r[1] = 'C' then c else trim(r[1]) end as name, r[2] as type, r[3]::int ord, r[4]::int \"start\", r[5]::int \"end\", r[6] = 'public' is_public"


@_query(_rows_sql(
    _NODE, "(['C', 'class', '0', '1', '5', 'public']), (['_g', 'function', '1', '7', '8', '']), (['f', 'function', '2', '3', '5', 'public'])",
    "(['C', 'class', '0', '2', '9', 'public']), (['run', 'function', '1', '5', '5', 'public']), (['C ', 'function', '2', '7', '7', 'public']), (['n', 'function', '4', '8', '8', ''])",
    "(['C', 'class', '0', '5', '12', '']), (['size', 'function', '1', '9', '9', '']), (['v', 'function', '3', '10', '10', '']), (['v', 'function', '4', '10', '10', ''])",
))
def code_nodes(spark, sf):
    """Functions and classes of every file: methods without bodies too; enums, records, annotation
    types and anonymous classes are none, though what is in them may be."""
    return nodes.code_nodes(_sources(spark, sf)).select("doc_id", "ord", "name", "type", "start", "end", "is_public")


_SAID = "trim(r[2] || case when r[3] = 'text' then line else '' end)"


@_query(_rows_sql(
    f"r[1]::int \"start\", md5({_SAID}) text_md5, {_MEANINGFUL.replace('x)', _SAID + ')')} meaningful",
    "(['4', 'so ', 'text'])", "(['1', 'Makes it.', '']), (['4', 'so ', 'text']), (['6', 'Builds.', ''])", "(['2', 'Reads it.', '']), (['6', 'so ', 'text']), (['7', 'Far.', ''])", None,
) + f" union all select doc_id, 1, md5(trim(said)), {_MEANINGFUL.replace('x)', 'said)')} from (select doc_id, doc_id || ' so ' || {_LINE_SQL} said from documents where doc_id % 4 = 3)")
def code_comments(spark, sf):
    c = nodes.comments(_sources(spark, sf).withColumnRenamed("text", "src"), "src")
    return c.select("doc_id", "start", F.md5(F.col("text").cast("binary")).alias("text_md5"), T.is_meaningful_comment(F.col("text")).alias("meaningful"))


_COUNTS = {"total_functions": (2, 3, 3, 0), "documented_functions": (0, 1, 0, 0), "total_classes": (1, 2, 3, 0), "documented_classes": (1, 1, 1, 0), "total_public_functions": (1, 2, 0, 0), "total_comment_lines": (1, 1, 1, 1)}
_SO = f"(case when doc_id % 4 = 3 then doc_id || ' so ' else 'so ' end || {_LINE_SQL})"


@_query("select doc_id, " + ", ".join(f"([{', '.join(map(str, v))}])[doc_id % 4 + 1]::bigint {k}" for k, v in _COUNTS.items()) + f", {_MEANINGFUL.replace('x)', _SO + ')')} has_meaningful_comment from documents")
def source_metrics(spark, sf):
    """Counters of every file; doc comments are no comment lines, a class literal is a class."""
    m = nodes.file_metrics(_sources(spark, sf), ["doc_id"])
    return m.select("doc_id", *(F.col(c).cast("long").alias(c) for c in _COUNTS), "has_meaningful_comment")


_WALK = "r[1]::int ord, r[2]::int parent, r[3]::int before, r[4] kind, case when r[5] = 'C' then c else trim(r[5]) end as name, r[6] modifiers"


@_query(_rows_sql(
    _WALK, None,
    "(['0', null, null, 'block_comment', null, '']), (['1', null, '0', 'class_declaration', 'C', 'public']), (['2', '1', null, 'line_comment', null, '']), (['3', '1', '2', 'field_declaration', 'r', '']), (['4', '3', null, 'method_declaration', 'run', 'public']),"
    " (['5', '1', '3', 'block_comment', null, '']), (['6', '1', '5', 'constructor_declaration', 'C ', 'public']), (['7', '6', null, 'class_literal', null, '']), (['8', '1', '6', 'method_declaration', 'n', 'private'])",
    "(['0', null, null, 'block_comment', null, '']), (['1', null, '0', 'interface_declaration', 'C', '']), (['2', '1', null, 'line_comment', null, '']), (['3', '1', '2', 'block_comment', null, '']), (['4', '1', '3', 'method_declaration', 'size', '']), (['5', '1', '4', 'enum_declaration', 'E', '']),"
    " (['6', '5', null, 'method_declaration', 'v', '']), (['7', '5', '6', 'method_declaration', 'v', '']), (['8', '1', '5', 'annotation_type_declaration', 'M', '']), (['9', '8', null, 'annotation_type_element_declaration', 'v', '']), (['10', null, '1', 'record_declaration', 'R', ''])",
))
def java_walk(spark, sf):
    """The tree of every Java file in walk order, with parents and siblings."""
    return nodes.syntax_tree(_sources(spark, sf)).select("doc_id", "ord", "parent", "before", "kind", "name", "modifiers")


@_query(_rows_sql("r[1] entity_type, case when r[2] = 'C' then c else trim(r[2]) end entity_name, r[3] doc_text", "(['class', 'C', 'Doc of it.'])", "(['class', 'C', 'Makes it.']), (['constructor', 'C ', 'Builds.'])", "(['interface', 'C', 'Reads it.'])"))
def entity_types(spark, sf):
    """Documented entities by type; a doc comment two lines above its declaration is none."""
    return nodes.entities(_sources(spark, sf), ["doc_id"]).where("entity_type <> 'comment'").select("doc_id", "entity_type", "entity_name", "doc_text")


@_query("select doc_id, source repo_id, 'f' || doc_id file_path, 'abc' commit_sha, null::varchar qualified_name, unnest(case doc_id % 4 when 0 then [2, 4] when 1 then [1, 4, 6] when 2 then [2, 6] else [1] end)::int doc_start_line from documents")
def file_entities(spark, sf):
    """Entities of every file with all their columns and one more."""
    keys = _docs(spark, sf).select("doc_id", F.col("source").alias("repo_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("file_path"), F.lit("abc").alias("commit_sha"))
    return nodes.file_entities(_sources(spark, sf).join(keys, "doc_id"), extra=("doc_id",)).select("doc_id", "repo_id", "file_path", "commit_sha", "qualified_name", "doc_start_line")
