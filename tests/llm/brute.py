"""Plain single-threaded versions that the operators are held against."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIP = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(STRIP).translate(LOWER)
            if len(key) >= min_chars and i is not None:
                holders[key].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(STRIP).translate(LOWER)
            lost = len(holders.get(key, ())) >= min_docs and i is not None and max(holders[key]) != i
            if not lost:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard_components(rows, width=5, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(k)
    for k, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in index[g]:
                if j < k:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def training_ids(labels):
    """The labelled ids that models are trained on."""
    from pyspark.sql import functions as F

    fold = labels.where("quality = 1 and coalesce(toxic, 0) = 0").withColumn("fold", F.expr("pmod(xxhash64(cast(doc_id as long), 'fold'), 5)"))
    return {r["doc_id"] for r in fold.where("fold > 0").collect()}


def perplexities(rows, trusted, kneser_ney, min_trusted=20):
    """Perplexities by id from one model a language over n-grams kept in dictionaries."""
    from collections import Counter
    from math import log2

    texts = [(lang, t) for i, lang, t in rows if i in trusted and t]
    signs = Counter(c for _, t in texts for c in t)
    alphabet = {c: k for k, (c, _) in enumerate(sorted(signs.items(), key=lambda x: (-x[1], ord(x[0])))[: kneser_ney.ALPHABET])}
    sizes = Counter(lang for lang, _ in texts)
    own = {lang for lang, n in sizes.items() if lang is not None and n >= min_trusted}

    def grams(t, order=kneser_ney.ORDER):
        s = ["start"] * (order - 1) + [alphabet.get(c, "unknown") for c in t]
        return [tuple(s[i : i + order]) for i in range(len(t))]

    def model(some):
        levels = [Counter(g for t in some for g in grams(t))]
        while len(next(iter(levels[-1]))) > 1:
            levels.append(Counter(g[1:] for g in levels[-1]))
        made = []
        for level in reversed(levels):
            many = Counter(level.values())
            cut = kneser_ney._cuts([many[r] for r in (1, 2, 3, 4)])
            total, back = Counter(), Counter()
            for g, n in level.items():
                total[g[:-1]] += n
                back[g[:-1]] += cut[min(n, 3)]
            made.append((level, cut, total, back))

        def p(g):
            out = 1.0 / (kneser_ney.ALPHABET + 2)
            for k, (level, cut, total, back) in enumerate(made, 1):
                h = g[-k:]
                if h[:-1] in total:
                    n = level.get(h, 0)
                    out = ((n - cut[min(n, 3)]) if n else 0.0) / total[h[:-1]] + back[h[:-1]] / total[h[:-1]] * out
            return out

        return p

    models = {lang: model([t for x, t in texts if x == lang]) for lang in own} | {"*": model([t for _, t in texts])}
    out = {}
    for i, lang, t in rows:
        if t:
            p, seen = models[lang if lang in own else "*"], Counter(grams(t))
            out[i] = 2 ** (sum(-log2(p(g)) * n for g, n in seen.items()) / len(t))
    return out
