"""Spelling variants: words one edit apart, grouped under their most frequent form.

A word that differs by one edit from another holds one of the other's two halves
unchanged: the first at its start, or the second at its end. The vocabulary is dealt
into shards by length and hash; the halves of a shard's words are an Aho-Corasick
automaton. Every word is scanned by the shards of its own length and of one letter
less, in blocks, so that a task holds two parts of the vocabulary of bounded size.
Hits count where offset and length fit; what fits is compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from . import tokenizer as K
from .common import session, written

#: Least code points and occurrences of a word; one of so many runs loses a letter; how many times as frequent a form is.
LETTERS, OCCURRENCES, SLIPS, TIMES = 6, 5, 199, 5
#: Words of a shard, and of a block of words that it scans.
SHARD_WORDS = 30_000
#: Letters compared at a time.
COMPARED = 1 << 23

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
#: The CRC-32 of one byte.
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
_ONES = np.uint32(0xFFFFFFFF)


def runs(data: np.ndarray, off: np.ndarray, least: int = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, code points and text of each maximal run of letters of at least so many code points. Letters U+00C0 to U+00FF are 0xC3 and a byte."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut  # runs that only the border of two texts parts
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
    size = ends - starts - (wide[ends] - wide[starts])
    keep = size >= least
    return starts[keep], ends[keep], size[keep], np.searchsorted(off, starts[keep], side="right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span continued from before, one byte of all spans at a time; long spans by themselves."""
    out, size = before ^ _ONES, ends - starts
    alive, j = np.flatnonzero(size <= T.LONG), 0
    while len(alive := alive[size[alive] > j]):
        now = out[alive]
        out[alive] = _CRC[(now ^ data[starts[alive] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        j += 1
    out ^= _ONES
    for i in np.flatnonzero(size > T.LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the runs of each Arrow batch."""
    for batch in batches:
        data, off = T.flat(batch.column(1))
        data = T.LOWER[data]
        starts, ends, size, owner = runs(data, off)
        if not len(starts):
            continue
        names = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
        h = checksums(data, starts, ends, names[owner])
        slip = h % np.uint32(SLIPS) == 0
        slipped: Counter[str] = Counter()
        for i in np.flatnonzero(slip & (size > LETTERS)).tolist():
            word, k = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(size[i])
            slipped[word[:k] + word[k + 1 :]] += 1
        found = K.Pieces(data, starts[~slip], ends[~slip])
        yield pa.RecordBatch.from_arrays([_spans(data, found.starts, found.size), pa.array(np.bincount(found.back, minlength=len(found.starts)).astype(np.int64))], ["word", "n"])
        if slipped:
            yield pa.RecordBatch.from_arrays([pa.array(list(slipped)), pa.array(list(slipped.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts and how often they occur. A null text has none; a null doc_id is the empty one."""
    counted = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


class Halves:
    """The automaton of one shard: the first and second halves of its words, all of one length."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.length = len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), self.length)
        half, segments = self.length // 2, {}
        for i, word in enumerate(words):
            segments.setdefault(word[:half], ([], []))[0].append(i)
            segments.setdefault(word[half:], ([], []))[1].append(i)
        self.automaton = ahocorasick.Automaton()
        for i, segment in enumerate(segments):
            self.automaton.add_word(segment, i)
        self.automaton.make_automaton()
        self.size = np.fromiter(map(len, segments), np.int64, len(segments))
        #: For first and for second halves: the words of all segments end to end, and where those of a segment begin.
        self.words = [np.fromiter((i for x in segments.values() for i in x[k]), np.int64) for k in (0, 1)]
        self.first = [np.concatenate([[0], np.cumsum([len(x[k]) for x in segments.values()])]).astype(np.int64) for k in (0, 1)]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, all of one length, and of the shard's words that are one edit apart. A pair may come twice."""
        length = len(words[0])
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
        hits = list(self.automaton.iter("\n".join(words)))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, segment = np.array(hits, np.int64).T
        word, at = np.divmod(end, length + 1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k, fits in ((0, at == self.size[segment] - 1), (1, at == length - 1)):
            mine, which = word[fits], segment[fits]
            size = self.first[k][which + 1] - self.first[k][which]
            sums = np.concatenate([[0], np.cumsum(size)])
            step = max(1, COMPARED // length)
            for a in range(0, int(sums[-1]), step):
                place = np.arange(a, min(a + step, int(sums[-1])))
                row = np.searchsorted(sums, place, side="right") - 1
                u, w = mine[row], self.words[k][self.first[k][which[row]] + place - sums[row]]
                ok = one_edit(letters[u], self.letters[w])
                out.append((u[ok], w[ok]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def one_edit(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether rows of u and w differ by exactly one letter; u is as long as w, or one longer."""
    if u.shape[1] == w.shape[1]:
        return (u != w).sum(axis=1) == 1
    head = np.logical_and.accumulate(u[:, :-1] == w, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((u[:, 1:] == w)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= w.shape[1]


def _neighbours(both: pd.DataFrame) -> pd.DataFrame:
    """For each word of a shard or a block that has near words in the other: how many, and the most frequent, the least of equal ones."""
    shard, block = both[both["held"]], both[~both["held"]]
    empty = pd.DataFrame({"word": [], "n_near": [], "form": [], "form_n": []}).astype({"word": str, "n_near": "int64", "form": str, "form_n": "int64"})
    if not len(shard) or not len(block):
        return empty
    w, u = shard["word"].tolist(), block["word"].tolist()
    a, b = Halves(w).near(u)
    if not len(a):
        return empty
    a, b = np.unique(np.stack([a, b]), axis=1)
    pairs = [(np.array(u, object)[a], np.array(w, object)[b], shard["n"].to_numpy()[b])]
    if len(u[0]) > len(w[0]):  # pairs of equal lengths are found from either side
        pairs.append((np.array(w, object)[b], np.array(u, object)[a], block["n"].to_numpy()[a]))
    found = pd.concat([pd.DataFrame({"word": x, "form": y, "form_n": n}) for x, y, n in pairs])
    found = found.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    best = found.drop_duplicates("word")
    return best.merge(found.groupby("word").size().rename("n_near"), left_on="word", right_index=True)[["word", "n_near", "form", "form_n"]]


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of a written vocabulary: of words with near words how many, and the most frequent of these."""
    length = F.char_length("word")
    sizes = words.groupBy(length.alias("length")).agg(F.ceil(F.count(F.lit(1)) / shard_words).cast("int").alias("shards"))
    sizes = written(sizes, "lengths")  # one row a length
    dealt = words.withColumn("length", length).join(sizes, "length").withColumn("mine", F.pmod(F.xxhash64("word"), "shards").cast("int"))
    other = sizes.withColumnRenamed("length", "other").withColumnRenamed("shards", "parts")
    numbers = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pattern = dealt.withColumn("other", F.explode(F.array(F.col("length"), F.col("length") + 1))).join(other, "other").select(F.col("length").alias("l"), F.col("mine").alias("s"), F.col("other").alias("m"), numbers.alias("b"), "word", "n", F.lit(True).alias("held"))
    scanned = dealt.withColumn("other", F.explode(F.array(F.col("length"), F.col("length") - 1))).join(other, "other").select(F.col("other").alias("l"), numbers.alias("s"), F.col("length").alias("m"), F.col("mine").alias("b"), "word", "n", F.lit(False).alias("held"))
    found = pattern.unionByName(scanned).groupBy("l", "s", "m", "b").applyInPandas(_neighbours, "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", "x.form", "x.form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, in steps that double. A form is more frequent, so no way is a circle."""
    links = written(links.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least LETTERS letters and OCCURRENCES occurrences.

    form is its most frequent near word (of equal ones the first in code-point order) if that
    is TIMES as frequent, else null, and then form_n is null; root is the last form from form to
    form, the word itself without one. A null text has no words, runs of any length are
    words, repeated rows count each; other columns are not read; an empty table gives no rows.
    """
    session(docs.sparkSession)
    words = written(vocabulary(docs), "vocabulary")
    found = words.join(neighbours(words, shard_words), "word", "left")
    real = F.col("form_n") >= TIMES * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(real, F.col("form")).alias("form"), F.when(real, F.col("form_n")).alias("form_n")), "neighbours")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
