"""Spelling variants against brute force, with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import spelling
from tests.llm.test_llm import table


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def counted(rows):
    words = Counter()
    for i, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            words[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return words


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (b, a) if len(a) < len(b) else (a, b)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def grouped(words):
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(others)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], words[form[w]] if form[w] else None)
    return sorted(out.values())


def test_variants(spark):
    rnd = random.Random(6)
    letters = "abé×"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 9))) for _ in range(12)]
    base += ["x" * 80, "x" * 81, "x" * 79 + "y"]  # long words
    rows = [(None, None), (None, "aaaaaa " * 6), (1, ""), (2, "ßĀ 1-2"), (2, "Straße" * 2000)]
    rows.append((3, "chainaa " * 6 + "chainab " * 40 + "chainbb " * 300))  # forms of forms
    for i in range(4, 200):
        text = []
        for _ in range(rnd.randrange(30)):
            w = list(rnd.choice(base[: rnd.randrange(1, len(base) + 1)]))
            if rnd.random() < 0.3:
                w[rnd.randrange(len(w))] = rnd.choice(["", "a", "b", "ab"])
            text.append(rnd.choice([str.upper, str])("".join(w)) if rnd.random() < 0.1 else "".join(w))
        rows.append((i, rnd.choice([" ", "-", "’"]).join(text)))
    rows += rows[50:60]
    want = grouped(counted(rows))
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] and r[2] != r[1] for r in want)  # chainaa leads to chainbb
    docs = table(spark, [(i, t, "a") for i, t in rows])
    for shard_words in (30_000, 7):  # also with many shards of each length
        found = spelling.variants(docs, shard_words).select("word", "form", "root", "n", "n_near", "form_n")
        assert sorted(map(tuple, found.collect())) == want


def test_no_words(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, "one two", "a"), (2, None, "a")])).count() == 0


def test_runs_end_with_their_text():
    texts = ["abc", "defghi", "", "é" * 6, "é", "Ābcdefg"]
    data, off = spelling.T.flat(pa.array(texts))
    starts, ends, size, owner = spelling.runs(data, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["defghi", "é" * 6, "bcdefg"]
    assert size.tolist() == [6, 6, 6] and owner.tolist() == [1, 3, 5]


def test_one_edit():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(7)) for _ in range(60)})
    more = sorted({"".join(rnd.choice("ab") for _ in range(8)) for _ in range(90)})
    for scanned in (words, more):
        u, w = spelling.Halves(words).near(scanned)
        assert {(scanned[a], words[b]) for a, b in zip(u.tolist(), w.tolist())} == {(a, b) for a in scanned for b in words if near(a, b)}
    assert np.all(spelling.one_edit(np.array([[1, 2, 3]]), np.array([[1, 9, 3]])))
