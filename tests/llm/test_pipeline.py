import brute
import corpus_pipeline
import pytest

from corvane.llm import decontamination, kneser_ney
from corvane.llm._shared import staged


@pytest.fixture(scope="module")
def small(sf_dir):
    return sf_dir.replace("sf0.01", "sf0.001")


def test_stages_equal_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if name != "bpe_ids" else None
        columns = docs.columns
        docs = staged(stage(spark, docs, small), name)
        rows = docs.collect()
        if name == "bpe_ids":
            assert {r["doc_id"] for r in rows} == kept
            assert len(rows) == len(kept)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality":
            source, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
            model = kneser_ney.fit(source, labels)
            langs = {r["doc_id"]: r["lang"] for r in source.collect()}
            perplexity = brute.perplexities([(i, langs[i], t) for i, t in before.items()], brute.training_ids(labels), kneser_ney)
            want = {i: t for i, t in before.items() if kneser_ney.kept(model.limits, langs[i] if langs[i] in model.languages else "*", t, perplexity.get(i))}
        elif name == "line_dedup":
            want = {i: t for i, _, _, t in brute.line_dedup(list(before.items()))}
        elif name == "near_duplicates":
            want = {i: before[i] for i, _, c in brute.jaccard_components(list(before.items())) if i == c}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            index = decontamination.SeedIndex([i for i, _ in items], [t for _, t in items], 5)
            hits = list(index.verdicts(list(before.values()), 0.5))
            want = {i: t for (i, t), h in zip(before.items(), hits, strict=True) if not h}
        assert after == want
        kept = set(after)
    assert kept


def test_stages_take_null_ids_and_empty_frames(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(2))
    out = corpus_pipeline.near_duplicates(spark, odd, small).collect()
    assert all(r["doc_id"] is not None for r in out)
    assert len({r["doc_id"] for r in out}) == len(out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
