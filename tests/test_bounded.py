"""What Python holds at once follows from bounds, not from the rows of an Arrow batch."""

import pyarrow as pa

from corvane.operators import nodes


def test_stretches_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(nodes, "AT_ONCE", 10)
    texts = ["abc", None, "defg", "xyz", "", "é" * 30, "q", "w" * 9, "z"]
    got = list(nodes._stretches(pa.array(texts)))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
    assert all(hi - lo == 1 or sum(len((t or "").encode()) for t in texts[lo:hi]) <= 10 for lo, hi in got)
    assert list(nodes._stretches(pa.array([], pa.string()))) == []
    assert list(nodes._stretches(pa.array(texts).slice(2, 3))) == [(0, 3)]


def test_counters_move_no_code(spark):
    df = spark.createDataFrame([(1, "Python", "class A:\n  '''d'''\n  def f(self): pass # so it is said\n"), (2, "Java", None)], "id int, language string, text string")
    m = nodes.file_metrics(df, ["id"])
    assert "code#" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["id"], r["total_functions"], r["documented_classes"], r["total_comment_lines"]) for r in m.orderBy("id").collect()] == [(1, 1, 1, 1), (2, 0, 0, 0)]
