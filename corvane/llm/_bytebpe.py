"""Byte-level BPE vocabulary files: parts that several operators share.

* :class:`ByteVocab` reads a ``tokenizers`` JSON file.
* :func:`cut_pretokens` finds the pre-token boundaries of many texts with numpy.

The boundary rules are those of the published byte-level pattern
(contractions, optional blank plus letters / digits / other signs, white space
without the last blank before a word).  Which code point is a letter, a digit
or white space is asked from the installed library, because Unicode versions
differ between libraries.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3

#: The endings that follow an apostrophe as tokens of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Code points probed one by one; outside them nothing is assigned as letter, digit or space.
_PROBED = ((0, 0xD800), (0xE000, 0x32400), (0xE0000, 0xE0200))


@functools.lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """uint8 class of every code point, as the installed pre-tokenizer sees it."""
    from tokenizers.pre_tokenizers import ByteLevel

    probe = ByteLevel(add_prefix_space=False, use_regex=True)
    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(a, b) for a, b in _PROBED])

    def cuts(before: str) -> tuple[np.ndarray, np.ndarray]:
        first, second = [], []
        for lo in range(0, len(points), 20000):
            part = points[lo : lo + 20000]
            text = "".join(f"{before}{chr(c)}1" for c in part)
            mark = np.zeros(len(text) + 1, bool)
            mark[[span[0] for _, span in probe.pre_tokenize_str(text)]] = True
            at = np.arange(len(part)) * 3
            first.append(mark[at + 1])
            second.append(mark[at + 2])
        return np.concatenate(first), np.concatenate(second)

    after_letter, before_digit = cuts("a")
    after_sign, _ = cuts("!")
    table[points[~after_letter]] = LETTER
    table[points[after_letter & ~before_digit]] = DIGIT
    table[points[after_letter & before_digit & after_sign]] = SPACE
    table[0x20] = SPACE
    return table


def cut_pretokens(points: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Boolean mask: True where a pre-token begins.

    ``points`` are code points of texts set one after the other, ``doc_first``
    marks the first position of each text.
    """
    n = len(points)
    cut = np.ones(n, bool)
    if n < 2:
        return cut
    kind = code_point_classes()[points]
    blank = points == 0x20
    space = kind == SPACE
    cut[1:] = (kind[1:] != kind[:-1]) & ~blank[:-1]
    # the last sign of a run of white space stands alone or joins the next word
    inner = space[1:-1] & space[:-2] & ~space[2:] & ~doc_first[2:]
    cut[1:-1] |= inner
    # a run of white space of one blank begins where it meets another kind
    cut[1:] |= blank[1:] & ~space[:-1]
    cut |= doc_first
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        prev = np.maximum(marks - 1, 0)
        free = doc_first[marks] | ((kind[prev] != OTHER) & ~blank[prev])
        marks = marks[free]
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        first = np.concatenate([doc_first, np.ones(3, bool)])
        same1, same2 = ~first[marks + 1], ~first[marks + 1] & ~first[marks + 2]
        length = np.zeros(len(marks), np.int64)
        for ending in CONTRACTIONS:
            ok = same1 & (padded[marks + 1] == ord(ending[0]))
            if len(ending) == 2:
                ok = ok & same2 & (padded[marks + 2] == ord(ending[1]))
            length[ok & (length == 0)] = len(ending)
        hit = length > 0
        cut[marks[hit] + 1] = False
        ends = marks[hit] + 1 + length[hit]
        cut[ends[ends < n]] = True
    return cut


def joined_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one string, its code points, first-position marks, and lengths."""
    big = "".join(texts)
    points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.zeros(len(points), bool)
    starts = np.cumsum(lens) - lens
    first[starts[lens > 0]] = True
    return big, points, first, lens


def byte_starts(points: np.ndarray) -> np.ndarray:
    """UTF-8 offset of each code point, and the total at the end."""
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


def _visible_bytes() -> dict[str, int]:
    """The published byte-to-character map of byte-level vocabularies, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    shown.update({chr(0x100 + i): b for i, b in enumerate(rest)})
    return shown


class ByteVocab:
    """A byte-level BPE vocabulary read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        shown = _visible_bytes()
        #: of each byte, as a Latin-1 character, the sign that stands for it in the vocabulary
        self.shown = {b: c for c, b in shown.items()}
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with stripping rules are not supported")
        vocab = {w: i for w, i in model["vocab"].items() if w not in self.special}
        self.token_bytes: dict[int, bytes] = {i: bytes(shown[c] for c in w) for w, i in vocab.items()}
        self.rank_of: dict[bytes, int] = {b: i for i, b in self.token_bytes.items()}
        self.size = max([*self.token_bytes, *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        if np.any(np.diff(self.merges[:, 2]) <= 0):
            raise ValueError(f"{path}: merged ids do not follow the order of the merges")
        self.byte_ids = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int64)
        #: bytes of every id, special tokens included (by their content)
        self.decode_table: list[bytes] = [b""] * self.size
        for i, b in self.token_bytes.items():
            self.decode_table[i] = b
        for content, i in self.special.items():
            self.decode_table[i] = content.encode()

    def segments(self, text: str) -> list:
        """``text`` cut at added tokens: strings, and ids of the added tokens."""
        parts: list = [text]
        for content, i in sorted(self.special.items(), key=lambda x: -len(x[0])):
            if content not in text:
                continue
            out: list = []
            for part in parts:
                if isinstance(part, str):
                    for k, piece in enumerate(part.split(content)):
                        if k:
                            out.append(i)
                        if piece:
                            out.append(piece)
                else:
                    out.append(part)
            parts = out
        return parts

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


@functools.lru_cache(maxsize=4)
def load_vocab(path: str) -> ByteVocab:
    return ByteVocab(path)
