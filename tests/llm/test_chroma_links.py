import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chroma_prints, queries


def least_error(a, b, share=0.5):
    """The fewest bit errors over every offset that overlaps enough, by plain counting."""
    best = 1.0
    bits_a, bits_b = (np.unpackbits(x.view(np.uint8)).reshape(-1, 32) for x in (a, b))
    for off in range(-len(b) + 1, len(a)):
        lo, hi = max(0, off), min(len(a), len(b) + off)
        if hi - lo >= share * min(len(a), len(b)):
            best = min(best, float((bits_a[lo:hi] != bits_b[lo - off : hi - off]).mean()))
    return best


def noisy_table(rng, n=30):
    base = rng.normal(0, 0.125, (n, 64))
    rows = [(100 * k, base[k].tolist()) for k in range(n)]
    rows += [(100 * k + 1, (base[k] + rng.normal(0, 0.008, 64)).tolist()) for k in range(n)]
    rows += [(100 * k + 2, base[k].tolist()) for k in range(3)]
    rows += [(100 * k + 3, base[k][8:].tolist()) for k in range(5)]
    return rows


def test_query_has_full_precision_and_recall(spark, tmp_path):
    rows = noisy_table(np.random.default_rng(11))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in queries.op7_chroma_prints(spark, str(tmp_path)).collect()}
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    audio = chroma_prints.recordings(table)
    cuts = chroma_prints.fit_cuts(audio, "id", "pcm")
    held = {r["id"]: np.frombuffer(r["prints"], "<u4") for r in chroma_prints.fingerprints(audio, cuts).collect()}
    assert sorted(got) == [i for i in sorted(held) if i % 100 == 0]
    true = found = 0
    for q, r in got.items():
        links = {m for m in held if m != q and least_error(held[q], held[m]) <= 0.3}
        true, found = true + len(links), found + r["n_links"]
        assert r["n_links"] <= len(links), "a link that brute force does not know"
        assert r["class_id"] == min(i for i in held if np.array_equal(held[i], held[q]))
    assert found >= 0.9 * true > 30


def test_op7_has_a_row_for_every_query(spark, sf_dir):
    rows = queries.op7_chroma_prints(spark, sf_dir).collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(0, 500, 100))


def test_silence_and_drones_meet_few_keys(spark):
    rng = np.random.default_rng(5)
    still, drone = [(i, b"\0" * 60000) for i in range(0, 900, 10)], [(i, None) for i in (1001, 1002)]
    tone = (8000 * np.sin(2 * np.pi * 440 * np.arange(40000) / chroma_prints.RATE)).astype("<i2").tobytes()
    drone += [(i, tone[: len(tone) - 2 * chroma_prints.HOP * (i % 7)]) for i in range(2000, 2050)]
    voices = [(3000 + i, chroma_prints.tones(rng.normal(0, 0.2, 64).tolist())) for i in range(20)]
    df = spark.createDataFrame(still + drone + voices, "id long, pcm binary")
    cuts = chroma_prints.fit_cuts(df.where("id >= 3000"), "id", "pcm")
    silent, prints = chroma_prints.silent_print(cuts), chroma_prints.fingerprints(df, cuts)
    keys = chroma_prints._keys(prints.where("length(prints) > 0").select(F.col("id").alias("class"), "prints"), silent).collect()
    assert not [k for k in keys if k["class"] < 1000]
    assert max(sum(k["class"] == i for k in keys) for i in range(2000, 2050)) < 10
    got = {r["id"]: r for r in chroma_prints.link_counts(prints, silent=silent).collect()}
    assert got[0]["n_links"] == len(still) - 1 and got[0]["n_link_classes"] == 0
    assert got[2000]["n_links"] == 49
    assert got[2000]["best_bit_error"] == pytest.approx(0, abs=0.05)


def test_long_recordings_come_in_parts(monkeypatch):
    pcm = np.frombuffer(chroma_prints.tones(np.random.default_rng(1).normal(0, 0.2, 400).tolist()), "<i2")
    whole = chroma_prints.chroma(pcm)
    monkeypatch.setattr(chroma_prints, "FRAMES_AT_ONCE", 17)
    assert np.allclose(whole, chroma_prints.chroma(pcm))


def test_repeated_ids_keep_their_recordings(spark):
    rng = np.random.default_rng(3)
    one, two = (chroma_prints.tones(rng.normal(0, 0.2, 64).tolist()) for _ in range(2))
    df = spark.createDataFrame([(100, one, 1, 1), (100, two, 1, 1), (7, one, 1, 1), (8, two, 1, 1), (None, one, 1, 1)], "id long, pcm binary, class int, rep int")
    cuts = chroma_prints.fit_cuts(df, "id", "pcm")
    rows = chroma_prints.link_counts(chroma_prints.fingerprints(df, cuts)).collect()
    assert [r["n_links"] for r in rows] == [1, 1] and sorted(r["class_id"] for r in rows) == [7, 8]
    assert chroma_prints.link_counts(chroma_prints.fingerprints(df.limit(0), cuts)).count() == 0


def brute_links(held, every=100, most=chroma_prints.MOST_ERRORS):
    """{query: ids it is linked with}, every query against all recordings at every offset."""
    return {q: {m for m in held if m != q and least_error(held[q], held[m]) <= most} for q in held if q % every == 0}


def found_counts(spark, table):
    audio = chroma_prints.recordings(table)
    cuts = chroma_prints.fit_cuts(audio, "id", "pcm")
    prints = chroma_prints.fingerprints(audio, cuts)
    held = {r["id"]: np.frombuffer(r["prints"], "<u4") for r in prints.collect()}
    return held, {r["id"]: r["n_links"] for r in chroma_prints.link_counts(prints, silent=chroma_prints.silent_print(cuts)).collect()}


def test_recall_up_to_the_bound(spark):
    """Copies with more and more noise and parts of recordings: of the links up to the bound 0.9 are found."""
    rng = np.random.default_rng(21)
    base = rng.normal(0, 0.125, (12, 64))
    rows = [(100 * k, base[k].tolist()) for k in range(12)]
    rows += [(100 * k + 1 + j, (base[k] + rng.normal(0, s, 64)).tolist()) for k in range(12) for j, s in enumerate((0.006, 0.01, 0.014, 0.018, 0.022, 0.03))]
    rows += [(100 * k + 50 + j, (base[k] + rng.normal(0, s, 64))[a:].tolist()) for k in range(12) for j, (s, a) in enumerate(((0.01, 10), (0.02, 20), (0.03, 5)))]
    held, got = found_counts(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    true = brute_links(held)
    assert all(got[q] <= len(links) for q, links in true.items())
    assert sum(got.values()) >= 0.9 * sum(map(len, true.values())) > 50


def test_recall_on_the_given_table(spark, sf_dir):
    held, got = found_counts(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    true = brute_links(held)
    assert {q: len(links) for q, links in true.items()} == got
