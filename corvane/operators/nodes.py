"""Source files to rows: nodes, documented entities and comments.

Python sources are read with the standard library, Java sources with ``java_tree``, a
recursive descent over declarations, since no Java grammar is installed.  Every step over a
file is linear in it.  ``kind`` tells apart what ``type`` does not: constructors, interfaces
and class literals.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import java_tree as jt

#: Text that is parsed at once, in bytes.
AT_ONCE = 1 << 20

NODE_SCHEMA = "ord int, name string, type string, start int, end int, code string, is_public boolean, doc string, start_col int, end_col int, doc_start int, doc_start_col int, doc_end int, doc_end_col int, kind string"
TREE_SCHEMA = "ord int, parent int, before int, kind string, name string, modifiers string, start int, start_col int, end int, end_col int, text string"
COMMENT_SCHEMA = "start int, start_col int, end int, end_col int, text string, is_javadoc boolean"


def python_nodes(source: str) -> list[tuple]:
    """Functions and classes in breadth-first order; nothing for broken sources."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows, text = [], source.splitlines()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            doc = ast.get_docstring(node) or None
            at = node.body[0] if doc else None
            where = (at.lineno, at.col_offset, at.end_lineno, at.end_col_offset) if doc else (None,) * 4
            rows.append((len(rows), node.name, kind, node.lineno, node.end_lineno, "\n".join(text[node.lineno - 1 : node.end_lineno]), not node.name.startswith("_"), doc, node.col_offset, node.end_col_offset, *where, kind))
    return rows


def python_comments(source: str) -> list[tuple]:
    rows = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                rows.append((t.start[0], t.start[1], t.end[0], t.end[1], t.string.lstrip("#").strip(), False))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass  # what came before the broken place stays
    return rows


#: The type of a Java node, where it has one; and its entity type, where that differs.
_TYPES = {jt.METHOD: "function", jt.CONSTRUCTOR: "function", "class_declaration": "class", "interface_declaration": "class", "enum_declaration": "enum", "record_declaration": "record", jt.LITERAL: "class_literal"}
_KINDS = {jt.CONSTRUCTOR: "constructor", "interface_declaration": "interface"}


def _comment_text(raw: str) -> tuple[str, bool]:
    doc = raw.startswith("/**")
    body = raw[2:] if raw.startswith("//") else raw[3 if doc else 2 :]
    return "\n".join(re.sub(r"^\s*\*?\s?", "", x).strip() for x in body.strip().removesuffix("*/").splitlines()).strip(), doc


def java_comments(source: str) -> list[tuple]:
    places = jt.Places(source)
    return [(*places.of(n.start), *places.of(n.end), *_comment_text(source[n.start : n.end])) for n in jt.java_tree(source) if n.kind in jt.COMMENTS]


def java_nodes(source: str) -> list[tuple]:
    """Methods with and without bodies, constructors, classes, interfaces, enums, records and
    class literals in walk order; a doc comment belongs to the declaration right after it."""
    places, text, rows = jt.Places(source), source.splitlines(), []
    for node in jt.java_tree(source):
        kind = _TYPES.get(node.kind)
        if not kind:
            continue
        (first, col), (last, end_col) = places.of(node.start), places.of(node.end)
        near = jt.attached_doc(node, places, source)
        doc = _comment_text(source[near.start : near.end])[0] or None if near else None
        where = (*places.of(near.start), *places.of(near.end)) if doc else (None,) * 4
        rows.append((len(rows), node.name, kind, first, last, "\n".join(text[first - 1 : last]), "public" in node.modifiers, doc, col, end_col, *where, _KINDS.get(node.kind, kind)))
    return rows


def java_walk(source: str) -> list[tuple]:
    """Every node in walk order, with the order numbers of its parent and of the sibling before."""
    places, tree = jt.Places(source), jt.java_tree(source)
    at = {id(n): k for k, n in enumerate(tree)}
    return [(k, at.get(id(n.parent)), at.get(id(n.before)), n.kind, n.name, " ".join(n.modifiers), *places.of(n.start), *places.of(n.end), source[n.start : n.end]) for k, n in enumerate(tree)]


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most AT_ONCE bytes, or one longer text: only a run at a time
    is held as Python objects, with what is made of it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, before = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield lo, hi
        lo, before = hi, int(ends[hi - 1])


def _exploded(df: DataFrame, parse: dict, schema: str, text_col: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the files by ``parse``; ``only`` names the columns to keep, if not all of the schema."""
    named = [f.split() for f in schema.split(", ")]
    wanted = [k for k, (n, _) in enumerate(named) if not only or n in only]
    fields = [named[k] for k in wanted]
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    keep = [c for c in df.columns if c != text_col]
    source = df.select(*keep, F.col(text_col))
    at = keep.index("language")

    def run(batches):
        for batch in batches:
            for lo, hi in _stretches(batch.column(len(keep))):
                part = batch.slice(lo, hi - lo)
                where, rows = [], []
                for i, (lang, src) in enumerate(zip(part.column(at).to_pylist(), part.column(len(keep)).to_pylist(), strict=True)):
                    for r in parse[lang](src) if lang in parse and src else ():
                        where.append(i)
                        rows.append(tuple(r[k] for k in wanted))
                at_rows = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at_rows) for k in range(len(keep))), *(pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields))], [*keep, *(n for n, _ in fields)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text_col)
    return source.mapInArrow(run, f"{kinds}, {', '.join(map(' '.join, fields))}")


def syntax_tree(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df: language, text, any keys; gives the keys and TREE_SCHEMA, a row for each node of the
    Java files: declarations, class literals and comments, in walk order."""
    return _exploded(df, {"Java": java_walk}, TREE_SCHEMA, text_col)


def code_nodes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df: language, text, any keys; gives the keys and NODE_SCHEMA.  Enums and records are no nodes."""
    return _declarations(df, text_col).where(F.col("type").isin("function", "class"))


def _declarations(df: DataFrame, text_col: str, only: tuple[str, ...] = ()) -> DataFrame:
    return _exploded(df, {"Python": python_nodes, "Java": java_nodes}, NODE_SCHEMA, text_col, only)


def entities(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The documented entities (function, constructor, class, interface, enum, record) and the
    comments of source files as rows of (keys, language, entity, its text, token count, places of both, confidence).  Comments in the first
    column are of medium confidence, all others high."""
    from corvane.functions import text as T

    source = df.select(*keys, "language", F.col(text_col).alias("__source"))
    doc = F.when(F.col("language") == "Java", "javadoc").otherwise("docstring")
    places = (("start_line", "start"), ("end_line", "end"), ("start_col", "start_col"), ("end_col", "end_col"))
    named = _declarations(source, "__source").where("doc is not null").select(
        *keys, "language", F.col("kind").alias("entity_type"), F.col("name").alias("entity_name"), doc.alias("source_type"), F.col("doc").alias("doc_text"), T.count_tokens(F.col("doc")).alias("doc_token_count"),
        F.col("doc_start").alias("doc_start_line"), F.col("doc_end").alias("doc_end_line"), "doc_start_col", "doc_end_col", *(F.col(c).alias(f"entity_{n}") for n, c in places), F.lit("high").alias("alignment_confidence"),
    )
    said = comments(source, "__source").where("not is_javadoc").select(
        *keys, "language", F.lit("comment").alias("entity_type"), F.lit(None).cast("string").alias("entity_name"), F.lit("inline_comment").alias("source_type"), F.col("text").alias("doc_text"), T.count_tokens(F.col("text")).alias("doc_token_count"),
        *(F.col(c).alias(f"{kind}_{n}") for kind in ("doc", "entity") for n, c in places), F.when(F.col("start_col") == 0, "medium").otherwise("high").alias("alignment_confidence"),
    )
    return named.unionByName(said)


def file_entities(df: DataFrame, text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """df: repo_id, file_path, commit_sha, language, text, extra columns; entities as rows with all
    their columns, the extra ones last.  No source gives qualified names, so they are null."""
    out = entities(df, ["repo_id", "file_path", "commit_sha", *extra], text_col).withColumn("qualified_name", F.lit(None).cast("string"))
    places = [f"{kind}_{place}" for kind in ("doc", "entity") for place in ("start_line", "end_line", "start_col", "end_col")]
    return out.select("repo_id", "file_path", "commit_sha", "language", "entity_type", "entity_name", "qualified_name", "source_type", "doc_text", "doc_token_count", *places, "alignment_confidence", *extra)


def python_error(source: str) -> list[tuple]:
    """(line, error) of a source that can't be parsed."""
    try:
        ast.parse(source)
    except SyntaxError as e:
        return [(e.lineno or 0, "parse", e.msg)]
    except (ValueError, RecursionError, MemoryError) as e:
        return [(0, "parse", type(e).__name__)]
    return []


def java_error(source: str) -> list[tuple]:
    try:
        jt.parsed(source)
    except RecursionError:
        return [(0, "parse", "RecursionError")]
    return []


def broken_sources(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df: language, text, any keys; the keys, (line, stage, error) of each file that can't be read:
    it has no nodes and counts nothing."""
    return _exploded(df, {"Python": python_error, "Java": java_error}, "line int, stage string, error string", text_col)


def comments(df: DataFrame, text_col: str = "text") -> DataFrame:
    return _exploded(df, {"Python": python_comments, "Java": java_comments}, COMMENT_SCHEMA, text_col)


def file_metrics(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Counters of each file as aggregates over its nodes and comments.  Lines of comments are
    those of comments that are no doc comments; class literals count as classes."""
    from corvane.functions import text as T

    declared = _declarations(df.select(*keys, "language", text_col), text_col, ("type", "is_public", "doc"))
    per = declared.withColumn("type", F.when(F.col("type") == "function", "function").otherwise("class")).groupBy(*keys).agg(
        *(F.count_if(cond).alias(name) for name, cond in (
            ("total_functions", F.expr("type = 'function'")), ("documented_functions", F.expr("type = 'function' and doc is not null")),
            ("total_classes", F.expr("type = 'class'")), ("documented_classes", F.expr("type = 'class' and doc is not null")),
            ("total_public_functions", F.expr("type = 'function' and is_public")), ("documented_public_functions", F.expr("type = 'function' and is_public and doc is not null")),
            ("total_public_classes", F.expr("type = 'class' and is_public")), ("documented_public_classes", F.expr("type = 'class' and is_public and doc is not null")),
        )), F.collect_list(F.when(F.col("doc").isNotNull(), T.count_tokens(F.col("doc")).cast("int"))).alias("doc_lengths"))
    meaningful = T.is_meaningful_comment(F.col("text"))
    span = F.col("end") - F.col("start") + 1
    found = comments(df.select(*keys, "language", F.col(text_col).alias("src")), "src").where("not is_javadoc").groupBy(*keys).agg(F.sum(span).alias("total_comment_lines"), F.coalesce(F.sum(F.when(meaningful, span)), F.lit(0)).alias("meaningful_comment_lines"), F.max(meaningful).alias("has_meaningful_comment"))
    code = df.select(*keys, F.size(F.filter(T.lines(F.col(text_col)), lambda x: T.strip(x) != "")).alias("total_code_lines"))
    out = code.join(per, keys, "left").join(found, keys, "left")
    return out.fillna(0).fillna(False, ["has_meaningful_comment"]).withColumn("doc_lengths", F.coalesce("doc_lengths", F.array().cast("array<int>")))
