import corpus_pipeline
import pytest

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
LINE = "a line that many of the documents hold, long enough to be a key of its own"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing names."""
    words = [f"w{k}" for k in range(40)]
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, " ".join(words[i % 7 :]) + f"\n{LINE}", "en", "s", 1) for i in range(12)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (None, "a text of no id at all", None, "s", 3), (None, None, None, None, None)]
    rows += [(102, "long " * 60000 + "\n" + LINE, "en", "s", 9), (103, item + " and more", "en", "s", 1), (None, item, "xx", None, 1)]
    rows += [(7, "quite another text under an id that is there already", "en", "s", 1), (7, rows[7][1], "en", "s", 1), rows[3], (104, " \t ", "en", "s", 1)]
    folder = tmp_path_factory.mktemp("odd")
    extra = [(*r, k, "x", 5, None, 2, 3, 4, 6, 7) for k, r in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, id string, th int, lost string, n_dropped int, `__id` int, `__row` int, carried int, `a.b` int"
    spark.createDataFrame(extra, names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def run(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_quality(spark, odd):
    folder, rows = odd
    got = run(spark, folder, corpus_pipeline.quality)
    assert all(t for _, t in got) and set(got) <= {(r[0], r[1]) for r in rows}
    assert {(i, rows[i][1]) for i in range(12)} <= set(got)


def test_line_dedup(spark, odd):
    folder, rows = odd
    want = [(i, "\n".join(x for x in (t or "").split("\n") if x != LINE or i in (102, None))) for i, t, *_ in rows]
    assert len(rows) == len(run(spark, folder, corpus_pipeline.lines))
    assert run(spark, folder, corpus_pipeline.lines) == sorted(want, key=str)


def test_near_duplicates(spark, odd):
    folder, rows = odd
    got = run(spark, folder, corpus_pipeline.near_duplicates)
    assert len(got) == len(set(got))
    assert {(7, rows[19][1]), (100, None), (101, ""), (104, " \t "), (None, None), (None, "a text of no id at all"), (0, rows[0][1])} <= set(got)
    assert (9, rows[9][1]) not in got and got.count((7, rows[7][1])) == 0


def test_decontamination(spark, odd):
    folder, rows = odd
    want = [(r[0], r[1]) for r in rows if not (r[1] or "").startswith("one two three")]
    assert run(spark, folder, corpus_pipeline.decontaminate) == sorted(want, key=str)


def test_encode_and_settings(spark, odd):
    folder, rows = odd
    before = spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.encode(spark, docs, folder)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in rows)
    assert out.sparkSession.conf.get(BATCH) == "500"
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert spark.conf.get(BATCH) == before
