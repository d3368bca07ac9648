"""Batches of a token budget with a bound on open rows."""

import random
import threading
import time

from corvane.operators import budgets


def test_bins_keep_to_the_budget():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.randint(0, 40) for _ in range(rng.randint(0, 30)))
        got = list(budgets.bins(lengths, 60, 5))
        assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(lengths)))
        assert all(hi - lo == 1 or (max(lengths[lo:hi]) * (hi - lo) <= 60 and hi - lo <= 5) for lo, hi in got)


def test_no_more_rows_are_open_than_allowed():
    lock, state, rng = threading.Lock(), {"open": 0, "most": 0}, random.Random(2)

    def source():
        for k in range(200):
            n = rng.randint(1, 9)
            with lock:
                state["open"] += n
                state["most"] = max(state["most"], state["open"])
            yield (k, n), [f"{k}"] * n

    def generate(prompts):
        time.sleep(rng.random() / 500)
        return [p.upper() for p in prompts]

    seen, order = set(), []
    for (k, n), answers in budgets.pumped(source(), generate, 20, 4):
        with lock:
            state["open"] -= n
        assert answers == [f"{k}"] * n
        seen.add(k)
        order.append(k)
    assert seen == set(range(200)) and order != sorted(order)
    assert state["most"] <= 20 + 9  # the batch that waits to be handed on is counted too


def test_same_rows_for_any_order_of_answers(spark):
    rows = [(k, " ".join(["w"] * (k % 37)) if k % 11 else None, "kept") for k in range(700)]
    df = spark.createDataFrame(rows, "id int, prompt string, batch string")

    def late(prompts):
        time.sleep(random.random() / 100)
        return [str(len(p)) for p in prompts]

    def soon(prompts):
        return [str(len(p)) for p in prompts]

    want = {(k, str(len(p or ""))) for k, p, _ in rows}
    for generate in (late, soon):
        done = budgets.completed(df, "prompt", generate, budget=200, most_rows=16)
        assert {(r["id"], r["completion"]) for r in done.collect()} == want
    assert done.where("batch_tokens > 200 and batch_rows > 1").count() == 0
    share = budgets.padding_share(done).first()
    assert share["n_batches"] >= 700 * 18 / 200 and share["padding"] < 0.15
    assert budgets.padding_share(budgets.completed(df.limit(0), "prompt", soon)).first()["padding"] == 0.0
