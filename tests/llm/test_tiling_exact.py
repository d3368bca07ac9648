import random

import pytest
from test_other_ops import brute_tiles

from corvane.llm import decontamination


@pytest.mark.parametrize("letters,least", [(2, 2), (3, 2), (6, 2), (4, 3)])
def test_tiles_are_always_the_longest_left(letters, least):
    rng = random.Random(letters)
    for _ in range(700):
        item = [rng.randrange(letters) for _ in range(rng.randrange(1, 25))]
        text = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        tiles = decontamination.greedy_tiles(item, text, least)
        assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)
        assert sum(n for _, _, n in tiles) == brute_tiles(item, text, least)


def plain_tokens(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def brute_verdicts(docs, bench, threshold, least):
    items = {}
    for i, t in bench:
        seq = tuple(plain_tokens(t))
        if i is not None and len(seq) >= least:
            items[seq] = min(i, items.get(seq, i))
    out = []
    for d, t in docs:
        text, hits = plain_tokens(t), []
        for seq, i in items.items():
            covered = brute_tiles(list(seq), text, least)
            if covered >= threshold * len(seq):
                hits.append((-covered / len(seq), i, covered))
        if hits:
            out.append((d, min(hits)[1], min(hits)[2], sorted(h[1] for h in hits)))
    return out


def cases(rng):
    vocab = [f"t{k}" for k in range(40)]
    phrase = ["which", "of", "these", "is", "true", "of"]
    bench = [(k, " ".join(phrase + [rng.choice(vocab) for _ in range(rng.randrange(4, 16))])) for k in range(30)]
    bench += [(90, bench[3][1].upper()), (2, bench[7][1] + "!"), (None, bench[4][1]), (91, None), (92, "too short")]
    docs = [(k, " ".join(phrase + [rng.choice(vocab) for _ in range(30)])) for k in range(40)]
    for k in range(40):
        words = bench[rng.randrange(30)][1].split()
        cut = rng.randrange(4, len(words))
        docs.append((100 + k, " ".join([rng.choice(vocab) for _ in range(6)] + words[cut:] + ["and"] + words[: rng.randrange(cut)])))
    return bench, docs + [(5, None), (5, ""), (None, bench[0][1]), (100, docs[40][1]), (100, docs[41][1]), (None, bench[0][1])]


@pytest.mark.parametrize("threshold,block,bits,small", [(0.5, 2_000_000, 26, 32 << 20), (0.5, 20, 15, 0), (0.8, 300, 16, 0)])
def test_query_equals_brute_force_for_every_block(spark, monkeypatch, threshold, block, bits, small):
    for name, value in (("BLOCK_TOKENS", block), ("BITMAP_BITS", bits), ("BROADCAST_BYTES", small)):
        monkeypatch.setattr(decontamination, name, value)
    bench, docs = cases(random.Random(2))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, id int, th int, seq string")
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, key int")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    rows = decontamination.contaminated(df, items, threshold=threshold).collect()
    want = brute_verdicts(docs, bench, threshold, 5)
    assert sorted(((r["doc_id"], r["item_id"], r["covered"], r["item_ids"]) for r in rows), key=key) == sorted(want, key=key)
    assert len(want) > 10
    bad = {t for d, t in docs if any(d == w[0] for w in want) and brute_verdicts([(d, t)], bench, threshold, 5)}
    clean = decontamination.keep_clean(df, items, threshold=threshold)
    assert clean.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in clean.collect()) == sorted((d or 0, t or "") for d, t in docs if t not in bad)
