import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import answers, prompts
from corvane.operators import nodes

SAID = ["42", "42.0", "+42", "007", "7", "1_000", "1000", "1e3", "-0", "0", "True", "true ", "1", "FALSE", "None", "none", "", "  ", "[1, 2]", "[2,1]", "[1, 'a']", "['a', 1]", "(1, 2)", "{'a': 1}", "{1: 2}", "'x'", '"x"', "x", "X y", "x  Y z", "it’s", "it's", "“q”",
        "Answer: 5", "5 Question: 6", "the answer is 42", "b'x'", "set()", "...", "1+2j", "5 # five", "def (", "9" * 401, "9" * 400 + "8", "-" + "9" * 401, "1e999", "nan", "3.", ".5", "0.5000001", "café", "[[1], [2]]", "[{1: 2}]", "1.2.3", "\x1f7", "Trueish", "９", "'a\nb'", None]


def test_columns_agree_with_single_values(spark):
    pairs = [(a, b) for a in SAID for b in SAID]
    rows = spark.createDataFrame(pairs, "p string, g string").select("p", "g", answers.answers_match(F.col("p"), F.col("g")).alias("m")).collect()
    wrong = [(r["p"], r["g"], r["m"]) for r in rows if r["m"] is not answers.match(r["p"], r["g"])]
    assert not wrong


@pytest.mark.parametrize("pred,gold,want", [("9" * 401, "9" * 401, True), ("9" * 401, "9" * 400 + "8", False), ("9" * 401, "1", False), ("[1, 'a']", "['a', 1]", False), ("[1, 'a']", "[1, 'a']", True), ("{'a': 1.0}", "{'a': 1}", True), ("the answer is 42", "42", True), ("True", "1.0", True), ("5 Question: 6", "5", True), (None, None, True)])
def test_single_values(pred, gold, want):
    assert answers.match(pred, gold) is want


def test_answers_are_strict_json(spark):
    df = spark.createDataFrame([("{'question': 'q'}",), ('{"question": "q"}',)], "raw string")
    got = [r["j"] and r["j"]["question"] for r in df.select(prompts.parse_answer(F.col("raw")).alias("j")).collect()]
    assert got == [None, "q"]


def test_java_declarations_are_linear_and_whole():
    source = "/** One.\n * Two. */\n@A(x = 1)\npublic class C<T> {\n  /** No. */\n\n  int f() { return 1; }\n  enum E { A }\n  record R(int x) { }\n  interface I { }\n  public C() { }\n}\n"
    rows = nodes.java_nodes(source)
    assert [(r[1], r[2], r[3], r[4], r[6], r[7]) for r in rows] == [("C", "class", 3, 12, True, "One.\nTwo."), ("f", "function", 7, 7, False, None), ("E", "enum", 8, 8, False, None), ("R", "record", 9, 9, False, None), ("I", "class", 10, 10, False, None), ("C", "function", 11, 11, True, None)]
    rng = random.Random(1)
    big = "class X {\n" + "".join(f"/** d{k} */\nint f{k}() {{ return {rng.random()}; }}\n" for k in range(4000)) + "}\n"
    assert len(nodes.java_nodes(big)) == 4001 and len(nodes.java_comments(big)) == 4000


def test_damaged_members_are_left_out(spark, tmp_path):
    import zipfile

    from corvane.sources import readers

    path = tmp_path / "r.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("repo/a.py", "A" * 100)
        z.writestr("repo/b.py", "whole")
    raw = path.read_bytes()
    path.write_bytes(raw.replace(b"A" * 100, b"A" * 99 + b"B"))
    rows = readers.archive_texts(spark, str(path)).collect()
    assert [(r["file_path"], r["text"]) for r in rows] == [("b.py", "whole")]
