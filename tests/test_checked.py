"""Errors as rows."""

import json

import pytest

from corvane.operators import nodes
from corvane.sources import checked, readers


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_bad_lines_have_their_numbers(spark, tmp_path):
    """Over many splits of a file, with blank lines, which count."""
    good = [json.dumps({"a": k, "b": "x" * (k % 90)}) for k in range(3000)]
    lines = list(good)
    for at, bad in ((2999, '{"a": 1'), (1500, "nonsense"), (7, '{"a": "no number"}'), (3, "")):
        lines.insert(at, bad)
    write(tmp_path / "one.json", lines)
    write(tmp_path / "two.json", [*good[:5], "[1]", '{"b": "lacks a"}'])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows, errors = checked.json_lines_checked(spark, str(tmp_path), "a int, b string", required=("a",))
        assert rows.count() == 3005
        got = sorted((e["file"].rpartition("/")[2], e["line"], e["stage"]) for e in errors.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at = [k + 1 for k, x in enumerate(lines) if x in ('{"a": 1', "nonsense", '{"a": "no number"}')]
    assert got == [("one.json", k, "parse") for k in at] + [("two.json", 6, "parse"), ("two.json", 7, "required")]
    assert sorted(r["a"] for r in rows.collect()) == sorted([*range(3000), *range(5)])


def test_no_errors_and_no_rows(spark, tmp_path):
    write(tmp_path / "a.json", ['{"a": 1, "_bad_line": "x"}', " \t"])
    rows, errors = checked.json_lines_checked(spark, str(tmp_path), "a int, _bad_line string")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and errors.count() == 0


def test_autodetected_lines_name_the_bad_one(spark, tmp_path):
    write(tmp_path / "a.json", ['{"a": 1}', '{"a": 2}', "{oops}"])
    with pytest.raises(ValueError, match=r"a.json, line 3: no row"):
        readers.json_any(spark, str(tmp_path / "a.json"), "a int")
    write(tmp_path / "b.json", ['{"a": 1}', '{"b": 2}'])
    with pytest.raises(ValueError, match=r"line 2: lacks a"):
        readers.json_any(spark, str(tmp_path / "b.json"), "a int", required=("a",))


def test_broken_sources(spark):
    rows = [(1, "Python", "x = 1\ndef ("), (2, "Python", "x = 1"), (3, "Java", "class A { }"), (4, "Java", "class A {" * 3000), (5, "Python", None)]
    got = nodes.broken_sources(spark.createDataFrame(rows, "id int, language string, text string")).collect()
    assert sorted((r["id"], r["line"], r["stage"]) for r in got) == [(1, 2, "parse"), (4, 0, "parse")]
