import random

import brute
import pytest

from corvane.llm import _words, ngram_jaccard


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def components(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, id int, th int, n_shingles int, component_id int, sid int")
    return in_order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(df).collect())


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_of_one_pattern_are_told_apart(spark):
    rows = []
    for n in (64, 128, 1024, 2048):
        for k, (a, b) in enumerate((("a", "b"), ("b", "a"))):
            rows.append((10 * n + k, " ".join(thue_morse(n, a, b) for _ in range(3))))
    assert components(spark, rows) == in_order(brute.jaccard_components(rows))
    hashes, _ = _words.word_hashes([" ".join(t for _, t in rows)])
    assert len(set(hashes.tolist())) == len({w for _, t in rows for w in t.split()})


def test_words_equal_plain_splitting():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aBÉé \t\n\x0b\x0c\r\x1c\x85 　z") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "x" * 1000, "ab" * 64]
    hashes, bounds = _words.word_hashes(texts)
    words = [t.encode().lower().split() if t else [] for t in texts]
    assert [b - a for a, b in zip(bounds, bounds[1:], strict=False)] == [len(w) for w in words]
    of = dict(zip([w for x in words for w in x], hashes.tolist(), strict=True))
    assert len(set(of.values())) == len(of)
    assert [of[w] for x in words for w in x] == hashes.tolist()


def chain_rows(middle):
    """Three texts: the first and the last are linked over the one between only."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words[:92]), " ".join(words[4:96]), " ".join(words[12:])]
    sets = [brute.shingles(t) for t in texts]
    near = [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert near == [True, True, False]
    return [(1, texts[0]), (middle, texts[1]), (2, texts[2])]


@pytest.mark.parametrize("middle", [3, None, 1])
def test_a_row_without_an_id_links_others(spark, middle):
    rows = chain_rows(middle)
    want = [(1, 88, 1), (2, 84, 1), (middle, 88, 1)]
    assert components(spark, rows) == in_order(want)
    assert components(spark, rows + rows) == in_order(want + want)


@pytest.mark.parametrize("broadcast,hot", [(0, 20_000), (32 << 20, 10), (0, 10)])
def test_one_shingle_in_a_third_of_all_documents(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ngram_jaccard, "HOT_LIST", hot)
    monkeypatch.setattr(ngram_jaccard, "LOT", 5)
    monkeypatch.setattr(ngram_jaccard, "ROUTES", 2)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        own = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 14))]
        rows.append((i, " ".join((["all", "rights", "are", "reserved", "here"] if i % 3 == 0 else []) + own)))
    for i in range(0, 90, 3):  # near copies with the shared shingle
        rows.append((1000 + i, rows[i][1] + " " + f"tail{i}"))
        rows.append((2000 + i, "head " + rows[i][1]))
    rows += [(5000 + k, "all rights are reserved here") for k in range(40)]
    assert components(spark, rows) == in_order(brute.jaccard_components(rows))


def test_keep_first_takes_one_row_of_each_group(spark):
    rows = chain_rows(None) + [(7, "one two three"), (7, "quite another text"), (7, "one two three"), (8, "ONE two\tthree"), (None, "quite another text"), (9, None), (10, ""), (None, "alone here"), (None, "alone here"), (None, None)]
    df = spark.createDataFrame([(i, t, f"s{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `id` string, `__th2` int")
    out = ngram_jaccard.keep_first(df)
    assert out.columns == df.columns
    want = [(1, rows[0][1]), (7, "one two three"), (7, "quite another text"), (9, None), (10, ""), (None, "alone here"), (None, None)]
    assert in_order((r["doc_id"], r["text"]) for r in out.collect()) == in_order(want)
    assert ngram_jaccard.keep_first(df.limit(0)).count() == 0
