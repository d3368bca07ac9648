import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import prompts, scoring
from corvane.functions import text as T
from corvane.functions.answers import match
from corvane.operators import nodes, relational
from corvane.sources import readers, writers


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in enumerate(values)))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [("a_b c-d", 3), ("don't", 2), ("", 0), (None, 0), ("_ _ _", 3)])
def test_tokens(spark, value, want):
    assert one(spark, T.count_tokens(F.col("c0")), value) == want


@pytest.mark.parametrize("value,want", [("fix it", False), ("TODO: fix this now", False), ("_ _ _", False), ("computes the sum", True), ("todo fix this\nsecond line", True), (None, False)])
def test_meaningful(spark, value, want):
    assert one(spark, T.is_meaningful_comment(F.col("c0")), value) is want


@pytest.mark.parametrize("value,want", [("src/A.PY", True), ("src/test.py", True), ("tests/a.py", False), ("src/test/B.java", False), ("docs/x.md", False)])
def test_core(spark, value, want):
    assert one(spark, T.is_core_file(F.col("c0")), value) is want


@pytest.mark.parametrize("value,want", [("https://github.com/Foo/Bar.git/", "foo/bar"), ("https://github.com/a/b/tree/main", "a/b"), ("https://github.com/x/foo.github.io", "x/foohub.io"), ("https://GitHub.com/a/b", None), ("https://github.com/a", None)])
def test_repo_key(spark, value, want):
    assert one(spark, T.repo_key(F.col("c0")), value) == want


@pytest.mark.parametrize("value,want", [("@@ -1,3 +4,5 @@", [(4, 8)]), ("@@ -9 +9 @@", []), ("@@ -1,2 +7,0 @@", [(7, 6)])])
def test_hunks(spark, value, want):
    assert [tuple(r) for r in one(spark, T.patch_ranges(F.col("c0")), value)] == want


def test_texts(spark):
    assert one(spark, T.repo_url(F.col("c0")), "https://github.com/A/B?tab=x#y") == "https://github.com/A/B"
    assert one(spark, T.clean_javadoc(F.col("c0")), "/** Sum.\n * @param a x\n */") == "Sum.\n@param a x"
    assert one(spark, T.truncate(F.col("c0"), 3), "  abcd ") == "abc\n...[truncated]"
    assert one(spark, T.has_words(F.col("c0")), "a b c d e f g h") and not one(spark, T.has_words(F.col("c0")), "a b c d e f g")
    assert one(spark, T.is_allowed_licence(F.col("c0")), None) and not one(spark, T.is_allowed_licence(F.col("c0")), "CC-BY-NC-4.0")
    assert one(spark, T.strip_quotes(F.col("c0")), " 'x' ") == "x"


@pytest.mark.parametrize("raw,label", [('{"label":"keep","reason":"ok"}', "keep"), ('pre {"label": "borderline", "reason": "a } b"} post', "borderline"), ('{"reason":"x","label":"keep"}', "reject"), ("maybe", "reject"), (None, "reject")])
def test_judgement(spark, raw, label):
    assert one(spark, prompts.parse_judgement(F.col("c0")), raw)["label"] == label


@pytest.mark.parametrize("pred,gold,want", [("Answer is 42", "42", True), ("True", "1", True), ("[2,1]", "[1,2]", True), ("1.0000001", "1", True), ("1.1", "1", False), ("x", "", True), ("None", "none", True), (None, "q", False)])
def test_answers(pred, gold, want):
    assert match(pred, gold) is want


def test_scores(spark):
    c = [F.col(f"c{k}") for k in range(5)]
    assert one(spark, scoring.commit_score(*c), 1.0, 12.0, 40.0, 2.0, 1.0) == pytest.approx(0.84)
    assert one(spark, scoring.length_penalty(c[0]), "x" * 110) == pytest.approx(0.1)
    assert one(spark, scoring.leakage_penalty(c[0]), "### Code:") == 0.5
    assert one(spark, scoring.teacher_reward(c[0]), -2.5) == -0.5
    assert one(spark, scoring.bucket(c[0]), 0.55) == "medium"


@pytest.mark.parametrize("n,sizes", [(20, (14, 3, 3)), (90, (62, 13, 15)), (1, (0, 0, 1))])
def test_group_split(spark, n, sizes):
    df = spark.range(n * 3).select((F.col("id") % n).cast("string").alias("g"))
    rows = relational.group_split(df, "g").distinct().groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in rows}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_nodes():
    assert [r[1:5] for r in nodes.python_nodes("class A:\n  def f(self):\n    pass")] == [("A", "class", 1, 3), ("f", "function", 2, 3)]
    assert nodes.python_nodes("def (") == []


def test_sources_and_sinks(spark, tmp_path):
    schema = "code string, answer string"
    rows = [{"code": "a", "answer": "b"}, {"code": "c", "answer": "d"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "l.json").write_text("\n\n".join(map(json.dumps, rows)))
    (tmp_path / "o.json").write_text(json.dumps(rows[0], indent=1))
    (tmp_path / "m.json").write_text('{"1": 0.5, "2": -1}')
    (tmp_path / "e.json").write_text("")
    for name, n in (("a", 2), ("l", 2), ("o", 1)):
        assert readers.json_any(spark, str(tmp_path / f"{name}.json"), schema, ("code",)).count() == n
    with pytest.raises(ValueError):
        readers.json_any(spark, str(tmp_path / "e.json"), schema)
    assert readers.json_lines(spark, str(tmp_path / "none.json"), schema, missing_ok=True).count() == 0
    assert {r["idx"]: r["reward"] for r in readers.reward_cache(spark, str(tmp_path / "m.json")).collect()} == {1: 0.5, 2: -1.0}
    df = readers.json_lines(spark, str(tmp_path / "l.json"), schema)
    writers.replace_json(df, str(tmp_path / "out"))
    writers.append_json(df, str(tmp_path / "out"))
    done = spark.read.schema(schema).json(str(tmp_path / "out"))
    assert done.count() == 4 and relational.not_done(df, done, "code").count() == 0
    writers.object_json(df, str(tmp_path / "obj"), "code")
    assert json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "obj")).collect()))["a"] == {"answer": "b"}


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("repo-1/src/a.py", b"\xff bad")
        z.writestr("repo-1/b.md", "x")
    rows = readers.archive_texts(spark, str(tmp_path / "r.zip")).collect()
    assert {r["file_path"]: r["text"] for r in rows} == {"src/a.py": "� bad", "b.md": "x"}
