"""The text of a prompt is moved and held once."""

from corvane.operators import budgets


def test_prompts_move_once(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, None), (3, "c", 42)], "id int, p string, n int")
    done = budgets.completed(df, "p", lambda x: [t.upper() for t in x])
    assert "__prompt" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["p"], r["completion"], r["n_tokens"]) for r in done.collect()) == [(1, "a b", "A B", 2), (2, None, "", 0), (3, "c", "C", 1)]
    done = budgets.completed(df, "n", lambda x: [f"<{t}>" for t in x])
    assert sorted((r["id"], r["completion"]) for r in done.collect()) == [(1, "<7>"), (2, "<>"), (3, "<42>")]
