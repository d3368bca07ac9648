"""The cuts are quartiles of every place of all recordings."""

import numpy as np

from corvane.llm import chroma_prints as cp


def test_cuts_are_exact_quartiles_of_all(spark):
    rng = np.random.default_rng(4)
    audio = [(i, cp.tones(list(rng.normal(0, 0.3 + i / 900, 24 + i % 5)))) for i in range(600)]
    extra = [(None, cp.tones([0.1] * 60)), (601, None), (602, b""), (603, bytes(40_000))]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in audio + extra], "id long, pcm binary").repartition(5)
    values = []
    for i, pcm in [*audio, extra[3]]:
        values.append(cp.responses(cp.chroma(np.frombuffer(pcm, "<i2"))))
    want = np.quantile(np.concatenate(values), [0.25, 0.5, 0.75], axis=0, method="inverted_cdf").T
    assert np.array_equal(cp.fit_cuts(df, "id", "pcm"), np.ceil(want * cp.STEPS) / cp.STEPS)


def test_no_recordings_give_no_cuts(spark):
    df = spark.createDataFrame([(1, None)], "id long, pcm binary")
    assert np.array_equal(cp.fit_cuts(df, "id", "pcm"), np.zeros((16, 3)))
