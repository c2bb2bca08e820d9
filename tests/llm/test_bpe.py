"""Encoding in chunks against the library, and decoding, with odd rows."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sparkloom.llm import bpe
from sparkloom.llm import textvec as T
from tests.llm.test_llm import table

PIECES = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "'", "é", "日本", "🙂", "1", "23", "!", "<|endoftext|>", " ", "　", "x" * 50, "hello", "World", "\t", "́", " "]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.ranks(bpe.default_path()).rank
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(2)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(200))) for _ in range(150)]


def test_pieces_are_merged_like_the_library(library):
    ranks = bpe.ranks(bpe.default_path())
    for text in [*texts(), "a" * 4000, "zq" * 5000 + " the", "日" * 2000]:
        data, off = T.flat(pa.array([text]))
        ids = ranks.encode(data, off)[0]
        assert ids.tolist() == library.encode_ordinary(text)
        assert ranks.decode(ids.astype("int64"))[0].tobytes().decode() == text


def test_both_ways_of_merging_agree():
    ranks, rnd = bpe.ranks(bpe.default_path()), random.Random(4)
    pieces = [bytes(rnd.choice(b"abetho \xe6\x97\xa5") for _ in range(rnd.randrange(2, bpe.SHORT + 1))) for _ in range(600)]
    for n in sorted(set(map(len, pieces))):
        mine = [p for p in pieces if len(p) == n]
        data = T.np.frombuffer(b"".join(mine), T.np.uint8)
        got = {int(r): x.tolist() for rows, ids in ranks.merged_rows(data, T.np.arange(len(mine)) * n, n) for r, x in zip(rows, ids)}
        assert [got[i] for i in range(len(mine))] == [ranks._merged_long(p) for p in mine]


def test_chunks_overlap_two_at_most_and_hold_the_text():
    for text in [*texts(), "x" * 5000, "word " * 3000]:
        data, _ = T.flat(pa.array([text]))
        for size in (8, 50, 500):
            found = bpe.cuts(data, size)
            assert found[0][0] == 0 and found[-1][1:] == (len(data), len(data))
            for (a, following, end), (b, _, later) in zip(found, found[1:]):
                assert following == b and a < b < end <= len(data) and later > end
            assert sum(end - a for a, _, end in found) <= 2 * len(data) or not text


def test_encode_and_decode(spark, library):
    rows = [(None, None), (None, "one two"), (1, ""), (2, "same"), (2, "same"), (3, "no_white_space" * 900), (4, "a b " * 5000), *enumerate(texts(), 10)]
    docs = table(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    want = sorted((i is not None, i or 0, library.encode_ordinary(t or "")) for i, t in rows)
    for chunk in (40, bpe.CHUNK):
        found = bpe.encode(docs, chunk=chunk)
        assert sorted((r[0] is not None, r[0] or 0, r[1]) for r in found.collect()) == want
    raw = bpe.decode(bpe.encode(docs, chunk=100)).select("doc_id", "raw").collect()
    assert sorted((r[0] or -1, bytes(r[1]).decode()) for r in raw) == sorted((i or -1, t or "") for i, t in rows)
    digests = {r[0]: tuple(r)[1:] for r in bpe.round_trip(docs).collect()}
    ids = library.encode_ordinary("a b " * 5000)
    assert digests[4] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"a b " * 5000).hexdigest())
    assert digests[1] == (0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())
    assert bpe.round_trip(table(spark, [])).count() == 0
