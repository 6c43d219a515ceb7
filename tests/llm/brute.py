"""Plain versions of the corpus operators over small lists, one document at a time."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose of common words, copies, near copies, shared lines, blanks, nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeglmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "and", "to", "in"] * 12
    texts: list[str | None] = []
    for i in range(n):
        k = rng.random()
        if k < 0.6 or i < 5:
            lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.5:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["All rights reserved.", " ALL rights reserved. ", "Share this page"]))
            t = "\n".join(lines)
        elif k < 0.75:
            t = rng.choice([x for x in texts if x])
        elif k < 0.85:
            w = rng.choice([x for x in texts if x]).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = rng.choice(["", None, " ", "\n\n", "one", "é ü\tß", "BUY NOW!! " * 30, "a | b | " * 20, "x" * 3000, "the of and to " * 200])
        texts.append(t)
    return [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "hot", "hot", "hot", None]), len(t or "")) for i, t in enumerate(texts)]


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


def quality_base(t: str | None) -> dict:
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    inside = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
    return out | {"base_failed": len(w) < 20 or 100 * len(inside) > 30 * len(w)}


def line_dedup(texts: list[str | None], least: int) -> list[tuple[str, int, int]]:
    key = lambda x: x.strip(SPACE).translate(FOLD)
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out = []
    for ls in split:
        stay = [x for x in ls if n[key(x)] < least]
        out.append(("\n".join(stay), len(ls), len(ls) - len(stay)))
    return out


def simhash(t: str | None) -> int:
    w = words((t or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list[int], fps: list[int], most: int = 2) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= most:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def parse_url(u: str | None) -> tuple[str, str]:
    if u is None or "://" not in u:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
    return m[1].translate(FOLD), m[2]
