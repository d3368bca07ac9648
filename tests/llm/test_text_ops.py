import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import bpe_codec, line_dedup, ngram_jaccard, queries, token_counts, token_files
from corvane.llm._bytebpe import cut_pretokens, joined_points
from corvane.llm._shared import shared_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(BYTE_BPE)
SCHEMA = "doc_id long, text string, ids string, decoded string, n_tokens int, batch int"

EDGE_TEXTS = [None, "", " ", "\n", "\n\n\n", "a", "don't we'll I'd 's", "  two  blanks \n\n x", "<|endoftext|>", "a<|endoftext|>b", "é漢字 12½٣ \U0001f600", "a" * 3000, "x " * 5000, "\x00\x01 ​ "]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def library_ids(texts):
    return [e.ids for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def documents(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


ALPHABET = "abSstmdrevlLE'' \n\t 　é漢12½!?.<|>\U0001f600́"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET) | st.characters(exclude_categories=("Cs",)), max_size=30), max_size=6))
def test_pretokens_and_codec_equal_the_library(texts):
    coder, count = bpe_codec.encoder(BYTE_BPE), token_counts.counter(BYTE_BPE)
    want = library_ids(texts)
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [coder.decode(x) for x in got] == [LIB.decode(x, skip_special_tokens=False) for x in want]
    assert count.counts(texts) == list(map(len, want))


def test_pretoken_cuts_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    _, points, first, lens = joined_points(texts)
    cut = cut_pretokens(points, first)
    at = 0
    for t, n in zip(texts, lens.tolist(), strict=True):
        want = [span[0] for _, span in LIB.pre_tokenizer.pre_tokenize_str(t)]
        assert np.flatnonzero(cut[at : at + n]).tolist() == want, repr(t)
        at += n


def test_decode_of_broken_bytes():
    coder = bpe_codec.encoder(BYTE_BPE)
    ids = LIB.encode("漢é", add_special_tokens=False).ids[:-1]
    assert coder.decode(np.array(ids, "<u4").tobytes()) == LIB.decode(ids, skip_special_tokens=False)


def test_codec_frames(spark):
    df = frame(spark, EDGE_TEXTS + ["same", "same"], [*range(len(EDGE_TEXTS)), 7, None])
    want = library_ids(EDGE_TEXTS + ["same", "same"])
    rows = bpe_codec.encode_decode(df, BYTE_BPE).collect()
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted(want)
    assert sorted(r["decoded"] for r in rows) == sorted(LIB.decode(x, skip_special_tokens=False) for x in want)
    again = bpe_codec.decode(bpe_codec.encode(df, BYTE_BPE), BYTE_BPE).collect()
    assert sorted(r["decoded"] for r in again) == sorted(r["decoded"] for r in rows)
    assert bpe_codec.encode_decode(df.limit(0), BYTE_BPE).count() == 0


def test_op5_whole_table(spark, sf_dir):
    import hashlib

    rows = documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op5_bpe_codec(spark, sf_dir).collect()}
    for (i, t), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == brute.sha(LIB.decode(ids, skip_special_tokens=False))


def test_op9_whole_table(spark, sf_dir):
    rows = sorted(documents(spark, sf_dir))
    got = {r["doc_id"]: r for r in queries.op9_token_files(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    start = 0
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_edges(spark):
    texts = EDGE_TEXTS + ["same", "same"]
    df = frame(spark, texts, [*range(len(EDGE_TEXTS)), 3, None])
    manifest = token_files.write_token_files(df, BYTE_BPE, shared_path(spark, "t"), parts=3)
    rows = token_files.read_token_files(spark, manifest).collect()
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted([*x, 0] for x in library_ids(texts))
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in rows].index(True) == 0
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert token_files.write_token_files(df.limit(0), BYTE_BPE, shared_path(spark, "t")) == []
    assert token_files.read_token_files(spark, []).count() == 0


def test_token_files_hot_ids_over_parts(spark, monkeypatch):
    """Null ids and one id hold a third of the rows each: they are cut over parts, and read back in small ranges."""
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    ids = [None] * 60 + [7] * 60 + list(range(-30, 30))
    texts = [f"text {i} " * (i % 9) for i in range(180)]
    manifest = token_files.write_token_files(frame(spark, texts, ids), BYTE_BPE, shared_path(spark, "hot"), parts=12)
    assert sum(m["n_docs"] for m in manifest) == 180 and len(manifest) >= 9
    assert max(m["n_docs"] for m in manifest) < 60
    rows = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    want = sorted((-1000 if i is None else i, [*x, 0]) for i, x in zip(ids, library_ids(texts), strict=True))
    assert sorted((-1000 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want


def test_op10_whole_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op10_token_counts(spark, sf_dir).collect()}
    for (i, t), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), len(ids), len(ids) > 512)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_edges(spark, name):
    path = public_tokenizers.path(name)
    rows = token_counts.token_counts(frame(spark, EDGE_TEXTS), path, limit=3).collect()
    if name.endswith(".json"):
        want = [len(x) for x in library_ids(EDGE_TEXTS)]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in EDGE_TEXTS]
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["n_tokens"] for i in range(len(EDGE_TEXTS))] == want
    assert [got[i]["n_bytes"] for i in range(len(EDGE_TEXTS))] == [len((t or "").encode()) for t in EDGE_TEXTS]
    assert [got[i]["over_limit"] for i in range(len(EDGE_TEXTS))] == [n > 3 for n in want]


LONG = "this line is long enough to be a key, with room to spare"


def line_rows():
    rows = [(i, f"{LONG}\nown line number {i} of the document that is also long enough\n short") for i in range(7)]
    rows += [(7, f"  {LONG.upper()}\t\n{LONG}"), (8, None), (9, ""), (10, "x"), (11, LONG + "\x0b"), (None, LONG), (3, LONG)]
    rows += [(20 + i, "É" * 40 + "\nrest") for i in range(5)] + [(30 + i, "é" * 40) for i in range(4)] + [(40 + i, "y" * 39) for i in range(6)]
    rows += [(50, "word " * 40000 + "\n" + LONG)]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (4, 3), (7, 2)])
def test_line_dedup_brute(spark, batches, fanout):
    rows = line_rows()
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = line_dedup.line_dedup(df, batches=batches, fanout=fanout).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=key) == sorted(brute.line_dedup(rows), key=key)


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_op4_whole_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    want = {i: (n, d, brute.sha(t)) for i, n, d, t in brute.line_dedup(rows)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op4_line_dedup(spark, sf_dir).collect()}
    assert got == want
    assert sum(d for _, d, _ in want.values()) > 0


def near_rows(rng, groups=6, copies=12, words=60):
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for k in range(copies):
            text = list(base)
            for _ in range(k % 4):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("share", [0.01, 0.0])
def test_ngram_jaccard_brute(spark, share, monkeypatch):
    rng = random.Random(3)
    rows = near_rows(rng)
    rows += [(1000 + k, t) for k, t in enumerate([None, "", " \t", "a", "A", "a b", "A\nB", "a b c d e", "a b c d e f", "one two three four five " * 4000])]
    rows += [(5, rows[5][1]), (None, rows[0][1]), (None, "alone in its class")]
    if not share:  # all lists are split
        monkeypatch.setattr(ngram_jaccard, "_level", lambda c: np.full(np.shape(c), 9, np.uint8))
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = ngram_jaccard.ngram_jaccard(df).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute.jaccard_components(rows), key=key)


def test_ngram_jaccard_empty(spark):
    assert ngram_jaccard.ngram_jaccard(frame(spark, [])).count() == 0


def test_op6_whole_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_ngram_jaccard(spark, sf_dir).collect()}
    want = {i: (n, c) for i, n, c in brute.jaccard_components(rows)}
    assert got == want
    assert any(i != c for i, (_, c) in want.items())
