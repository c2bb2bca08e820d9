"""The ten operators and the pipeline against brute force, libraries and round trips, with odd rows."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, components, decontamination, exact_dedup, fixity, jaccard_join, mixing, packing, pii, quality, token_counts, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Iota", "KAPPA", "mu", "ñu"]
    rows = [(None, None, None), (1, "", "a"), (2, None, "b"), (3, "one", None), (4, "ONE", "a"), (5, "  one\t", "a"), (5, "one", "a"), (6, "\n \t", "b")]
    for i in range(10, 90):
        rows.append((i, " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 80))), rnd.choice(["a", "b", "ж", None])))
    for i in range(90, 150):
        base = rows[8 + i % 20][1].split(" ")
        if i % 3:
            base[rnd.randrange(len(base))] = "edit"
        rows.append((i, " ".join(base).upper() if i % 2 else " ".join(base), "a"))
    rows.append((200, "long " * 30000, "a"))
    return rows


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(table(spark, docs)).collect()
    assert len(got) == len(docs)
    groups = {}
    for i, t, _ in docs:
        groups.setdefault(lower(t), []).append(-1 if i is None else i)
    for r in got:
        same = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.group_size, r.keep_id) == (len(same), max(same) if max(same) >= 0 else None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_a_heavy_group(spark):
    rows = [(i, "same" if i % 2 else f"text {i}", "a") for i in range(1000)]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert sum(r.kept for r in got) == 501 and {r.keep_id for r in got if r.group_size == 500} == {999}


def test_mixing(spark, docs):
    got = mixing.mix(table(spark, docs)).collect()
    assert len(got) == len(docs) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights, total, want = dict(zip(order, itertools.cycle((5, 2, 1)))), 1.5 * sum(sizes.values()), {}
    free, left = set(order), total
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weights[s]}
        for s in full or free:
            want[s] = 2 * sizes[s] if full else level * weights[s]
        left -= sum(2 * sizes[s] for s in full)
        free -= full or free
    by_size = {sizes[s]: want[s] for s in order}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 for r in got)
    again = mixing.mix(table(spark, docs)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_mixing_comes_near_its_targets(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(1, 300), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(table(spark, rows)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= max(300, 0.01 * r.target) for r in got)


def test_jaccard(spark, docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(table(spark, docs)).collect()}
    sets = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))
    for _ in range(len(sets)):
        for (x, (_, a)), (y, (_, b)) in itertools.combinations(enumerate(sets), 2):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[x] = parent[y] = min(parent[x], parent[y])
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[parent[x]] = min(i, least.get(parent[x], i))
    for x, (i, a) in enumerate(sets):
        assert got[(i, len(a))] == (least.get(parent[x]) if a else i)


def test_jaccard_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "PACK", 200)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:k], "x" + str(i), *base[k + 1 :]]), "a") for i, k in enumerate([j % 60 for j in range(40)])]
    got = jaccard_join.jaccard_components(table(spark, rows)).collect()
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for _, t, _ in rows]
    label = list(range(40))
    for _ in range(40):
        for x, y in itertools.combinations(range(40), 2):
            if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                label[x] = label[y] = min(label[x], label[y])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_decontamination(spark, docs):
    items = [(0, " ".join(docs[20][1].split()[:30])), (1, "never seen words at all here"), (2, ""), (3, None), (4, "one"), (5, "Alpha, beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contaminated(table(spark, docs), bench).collect()}

    def grams(t, k):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for item, text in items:
        k = min(5, len(re.findall(r"[^\W_]+", text or "")))
        q = grams(text, k) if k else set()
        for i, t, _ in docs:
            n = len(q & grams(t, k))
            if q and n >= 0.8 * len(q):
                want.add((i, item, n))
    assert got == want and want


def test_items_without_id_and_texts_that_share_one(spark):
    docs = table(spark, [(1, "x a b c d e f y", "s"), (2, "p q r s t u v w", "s"), (3, "k l m n o i j h", "s"), (4, "clean words only here and there", "s")])
    bench = spark.createDataFrame([(None, "a b c d e f"), (7, "p q r s t u v w"), (7, "k l m n o"), (8, "K l, m n o"), (None, None)], "item_id long, text string")
    got = {tuple(r) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, None, 2, 2, 1.0), (2, 7, 4, 4, 1.0), (3, 7, 1, 1, 1.0), (3, 8, 1, 1, 1.0)}
    found = decontamination.contaminated_texts(docs, bench)
    assert {r.doc_id for r in docs.withColumn("th", F.xxhash64("text")).join(found, "th", "left_anti").collect()} == {4}


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(token_counts.default_path()).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_agree_with_the_library(spark, docs):
    hard = ["don't we'll 'tis '''s 's's 're 'r'v'l I'LL", "  a  b\n\n c \t\n", "a<|endoftext|> b<|endoftext|>", "   ", "'r", "日本語 ٣٤٥ ½²", "a b　c", "🙂🙂 !!!???", "x" * 3000, "1" * 777 + " " * 300]
    rnd = random.Random(3)
    alphabet = [*" \n\t'strevmldLA1.!é ñ日½", "'s", "'re", "the", "<|endoftext|>"]
    texts = hard + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(1500)]
    assert tokenizer.count_tokens(pa.array(texts), token_counts.default_path()).tolist() == library(texts)
    got = token_counts.token_counts(table(spark, docs)).collect()
    want = library([t or "" for _, t, _ in docs])
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(docs, want))


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 13, (37, 13)).astype(np.uint8)
    scanned, state = tokenizer.compose_scan(maps), np.arange(13)
    for m, s in zip(maps, scanned):
        state = m[state]
        assert (state == s).all()


def test_packing_round_trip(spark, docs):
    rows = packing.pack(table(spark, docs), width=64, shard_tokens=3000).collect()
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).library.encode_ordinary
    parts = []
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and list(r.position_resets) == list(r.cu_seqlens[:-1]) and (ids[r.n_tokens :] == packing.END).all()
        parts += [(r.shard, d, o, tuple(ids[a:b].tolist())) for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:])]
    whole = sum(sorted((len(p) for *_, p in parts))) if parts else 0
    assert whole == sum(len(encode(t or "")) + 1 for _, t, _ in docs)
    unique = {i: t for i, t, _ in docs if i not in (None, 5)}
    for i, t in unique.items():
        assert [x for _, _, _, p in sorted(q for q in parts if q[1] == i) for x in p] == [*encode(t or ""), packing.END]


def test_best_fit_takes_the_least_room():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 65) for _ in range(400)]
    rows, naive = packing.best_fit_decreasing(sizes, 64), []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(naive) if room >= n]
        if fits:
            naive[min(fits, key=lambda k: naive[k])] -= n
        else:
            naive.append(64 - n)
    assert sorted(64 - sum(sizes[i] for i in r) for r in rows) == sorted(naive)


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(2)
    bits = ["1", "2", "0", "99", "255", ".", "..", "@", "a.b", "@c.de", "+", " ", "-", "(", ")", "x", "_", "4111111111111111", "+1 (555) 123-4567 ", "é", "\n", "1.2.3.4"]
    for _ in range(8000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))
        assert pii.base_spans(t) == plain_spans(t)
    pii.base_spans("1" * 200000 + "a" * 100000 + "@" + "b" * 100000 + "." + "+1" + " " * 100000)


def test_skip_edges_carry_labels(spark):
    texts = [f"call +1 (017) 555-77{i:02d} now, card 4111 1111 1111 1111, mail a{i}@b.com, order {i}12345 x" for i in range(40)]
    t = "call +1 (017) 555-7713 now. later again 017 555-7713 and (017) 555-7713. order 1234567 x"
    got = {r.doc_id: r for r in pii.find_pii(table(spark, [*((i, x, "a") for i, x in enumerate(texts)), (99, t, "a"), (None, None, None)])).collect()}
    assert got[99].spans == "phone:5:22,phone:40:52,phone:57:71" and got[99].n_phone == 1
    assert got[None].spans == "" and got[None].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_labels_pass_along_all_mentions():
    text = "+1 (017) 555-7713" + " x 017 555-7713" * 30
    base, k = pii.base_spans(text), len(pii.LABELS)
    for skip in (5.0, 6.0, 8.0):
        # without chain edges and features the mentions are a path, and the belief after d links is known
        kept = (np.exp(skip) - 1) / (np.exp(skip) + k - 1)
        sure = [d for d in range(1, 31) if 1 / k + (1 - 1 / k) * kept**d >= pii.CERTAIN]
        found = pii.Field(np.zeros((pii.FEATURES, k)), 0.0, skip).added(text, base)
        assert len(base) == 1 and [x[2] for x in found] == [3] * len(sure)
    assert len(found) == 30


def test_skip_edges_are_those_of_the_docstring():
    linked = lambda t: pii.Graph(t).skip
    assert linked("+1 (017) 555-7713 x 555-7713 x A@b.com, x a@B.com") == [(0, 1), (2, 3)]
    assert linked("a@b.com x c@b.com x 4111 1111 1111 1111 x 1111 x 10.0.0.1 x 10.0.0.1") == []
    assert "seven digits" in pii.__doc__ and "no skip edge" in pii.__doc__


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_quality_of_odd_rows(spark, docs):
    frame = table(spark, docs)
    none = quality.fit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.accepted(frame, none).count() == len(docs)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(frame, quality.fit(frame, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    words = 1 << quality.BUCKET_BITS
    m = quality.Model(0.1, rng.normal(size=words + quality.STATS), rng.normal(size=(words + quality.STATS, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    bucket, value, dense = np.array([3, 77, 500]), np.array([0.5, 0.2, 0.9]), rng.normal(size=(1, quality.STATS))
    index, x = np.concatenate([bucket, np.arange(words, words + quality.STATS)]), np.concatenate([value, dense[0]])
    pairs = sum(m.vectors[a] @ m.vectors[b] * xa * xb for (a, xa), (b, xb) in itertools.combinations(zip(index, x), 2))
    assert np.isclose(m.logits(np.zeros(3, int), bucket, value, dense)[0][0], 0.1 + m.weight[index] @ x + pairs)


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", "<p>é" * (i % 5)) for i in range(5000)] + [(7, "again", "x"), (None, None, None)]
    ours = spark.createDataFrame(rows, "page_id long, url string, html string")
    theirs = spark.createDataFrame([(i, u, "bad" if i == 70 else h) for i, u, h in rows if i != 4100] + [(9000, "new", "x")], "page_id long, url string, html string")
    got = fixity.audit(ours, theirs).collect()
    assert len(got) == len(rows) + 1
    assert {(r.page_id, r.status) for r in got if r.status != "ok"} == {(70, "changed"), (4100, "missing"), (9000, "extra")}
    assert all(r.status == "ok" for r in fixity.audit(ours, ours).collect())
    assert fixity.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "yo"), (None, 0, "user", "x"), (5, None, None, None)]
    rows += [(6, i, "user", str(i)) for i in range(600)] + [(7, i, "user", str(i)) for i in range(300)]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {2: 2, 4: 1, 5: 1, 6: 600}
    assert got[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


def test_empty_tables(spark):
    empty = table(spark, [(1, "x", "a")]).limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(empty).count() == 0 and mixing.mix(empty).count() == 0 and packing.pack(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0 and token_counts.token_counts(empty).count() == 0 and pii.find_pii(empty).count() == 0
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(empty, bench.limit(0)).count() == 0
    assert quality.scored(empty, quality.fit(empty, labels)).count() == 0
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

def _meeting(spark, n):
    """Places of which other wordings leave the XOR of fixed-seed hashes of n turns as it is: what prefix hashes must not be."""
    rows = [(i, w, "user", f"{'ab'[w]} {i}") for i in range(1, n + 1) for w in (0, 1)]
    turns = spark.createDataFrame(rows, "place long, w int, role string, text string")
    turns = turns.select("place", "w", *(F.xxhash64("role", "text", F.lit(i)).alias(f"h{i}") for i in (1, 2)))
    turns = turns.select("place", "w", *(F.xxhash64("place", f"h{i}", F.lit(i + 2)).alias(f"t{i}") for i in (1, 2)))
    found = {(r.place, r.w): (r.t1 % 2**64) << 64 | r.t2 % 2**64 for r in turns.collect()}
    basis = {}
    for i in range(1, n + 1):
        value, used = found[i, 0] ^ found[i, 1], 1 << i
        while value and value.bit_length() in basis:
            other, with_ = basis[value.bit_length()]
            value, used = value ^ other, used ^ with_
        if not value:
            return {j for j in range(1, n + 1) if used >> j & 1}
        basis[value.bit_length()] = value, used
    raise AssertionError("more turns than bits must meet")


def test_crafted_conversations_stay(spark):
    n = 140
    other = _meeting(spark, n)
    first = [(1, i, "user", f"a {i}") for i in range(1, n + 1)]
    second = [(2, i, "user", f"{'ab'[i in other]} {i}") for i in range(1, n + 1)] + [(2, n + 1, "user", "end")]
    assert other
    rows = first + second + [(3, i, "user", f"a {i}") for i in range(1, 100)]  # continued by the first
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(1, n), (2, n + 1)]


def test_equal_sums_are_not_equal_turns(spark, monkeypatch):
    """Whatever the hashes, a conversation goes only if another has its turns."""
    rows = [(i, k, "user", f"{i if k == 2 else 'x'}") for i in range(6) for k in range(1, 3 + (i % 2))]
    real = chat.prefix_hashes
    monkeypatch.setattr(chat, "prefix_hashes", lambda c: real(c).withColumn("p1", F.lit(0).cast("decimal(38,0)")).withColumn("p2", F.lit(0).cast("decimal(38,0)")))
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.conv_id for r in got) == list(range(6))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        if name != "token-ID / binary output":
            assert docs.columns == before.columns
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3]
    packed = {d for r in docs.collect() for d in r.doc_ids}
    assert packed == kept[3]
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(spark.createDataFrame([(i,) for i in kept[1]], "doc_id long"), "doc_id")
    found = {r.doc_id for r in decontamination.contaminated(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept[1] - kept[2] == found


def test_near_duplicates_link_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rows = []
    for k, more in enumerate((60, 85, 97, 99, 101, 120)):
        base = [f"w{k}x{j}" for j in range(400)]
        rows += [(10 * k, " ".join(base), "a"), (10 * k + 1, " ".join([*base, *(f"m{k}x{j}" for j in range(more))]), "a")]
        rows.append((10 * k + 2, " ".join(f"e{k}x{j}" if j % 45 == k else w for j, w in enumerate(base)), "a"))
    rows += [(100, "a b c d", "a"), (101, "A b  c d", "a"), (102, "a b c d e", "a"), (None, "a b c d", "a"), (104, "", "a"), (105, None, "a")]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect())
    sets = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for x, y in itertools.combinations(range(len(rows)), 2):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                label[x] = label[y] = min(label[x], label[y])
    # ids ascend with the rows, null apart, so the first of a component has its least id
    want = [(i is None, i or 0) for x, (i, _, _) in enumerate(rows) if label[x] == x]
    assert got == sorted(want)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{j}" for j in range(60)) for k in "abcd")
    rows = [(1, a, "s"), (1, a, "s"), (2, a + " end", "s"), (3, b, "s"), (3, a, "s"), (None, c, "s"), (None, c, "s"), (None, c.upper(), "s"), (None, b, "s"), (4, "", "s"), (4, "", "s"), (None, None, "s"), (5, d, "s")]
    got = [(r.doc_id, lower(r.text)) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, a), (3, b), (None, c), (4, ""), (4, ""), (None, ""), (5, d)]))
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows[2:5] + rows[12:]), "")
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(2, a + " end"), (3, b), (5, d)} and kept.columns == table(spark, rows).columns


def thue_morse(n):
    """Two strings of 2**n characters that collide under every polynomial hash modulo 2**64 for n of 10 or more."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def long_words():
    rnd = random.Random(11)
    words = [*thue_morse(10), *thue_morse(5), *thue_morse(6), *thue_morse(7), "é" * 900, "x" * 65, "x" * 64, "x" * 63, "日" * 21, "日" * 22]
    words += ["".join(rnd.choice("abcXYZé-_!09") for _ in range(rnd.randrange(1, 200))) for _ in range(300)]
    return words + [w[:-1] + "~" for w in words] + [w.swapcase() for w in words]


def test_words_that_resemble_have_hashes_of_their_own():
    from sparkloom.llm import textvec

    words = sorted({w for w in long_words()})
    for lower in (True, False):
        data, off = textvec.flat(pa.array(words))
        hashes = textvec.span_hashes(data, off[:-1], off[1:], lower)
        known = dict(zip((globals()["lower"](w) if lower else w for w in words), hashes.tolist()))
        assert len(set(known.values())) == len(known) and all(known[globals()["lower"](w) if lower else w] == h for w, h in zip(words, hashes.tolist()))
        assert set(hashes.tolist()).isdisjoint(textvec.span_hashes(data, off[:-1], off[1:], lower, key=1).tolist())


def test_token_counts_of_long_words():
    texts = [" ".join(t) for t in (thue_morse(10), thue_morse(10)[:1] * 2, thue_morse(10)[1:] * 2)] + long_words() + [" ".join(long_words())]
    assert tokenizer.count_tokens(pa.array(texts), token_counts.default_path()).tolist() == library(texts)


def test_packing_decodes_long_words(spark):
    texts = [" ".join(thue_morse(10)), "".join(reversed(thue_morse(10)[0])), *long_words(), "ab" * 200_000]
    parts = {}
    for r in packing.pack(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), width=512).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    import public_tokenizers

    decode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).library.decode
    whole = {d: sum((x for _, x in sorted(p)), []) for d, p in parts.items()}
    assert all(whole[i][-1] == packing.END and decode(whole[i][:-1]) == t for i, t in enumerate(texts))


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    from sparkloom.llm import textvec

    import public_tokenizers

    texts = long_words() + [" ".join(long_words())] * 2
    monkeypatch.setattr(textvec, "span_hashes", lambda data, starts, ends, lower=True, key=0: np.full(len(starts), 5, np.uint64))
    piece_machine, known = tokenizer.machine(token_counts.default_path())
    monkeypatch.setattr(tokenizer, "machine", lambda path: (piece_machine, fresh))
    fresh, encoder = tokenizer.PieceCache(), packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert tokenizer.count_tokens(pa.array(texts), token_counts.default_path()).tolist() == library(texts)
    data, off = textvec.flat(pa.array(texts))
    ids, first = encoder.encode(data, off)
    assert [encoder.library.decode(ids[a:b].tolist()) for a, b in zip(first, first[1:])] == texts


def test_crafted_words_do_not_link(spark):
    a, b = thue_morse(10)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table(spark, [(1, a, "s"), (2, b, "s"), (3, f"{a} {b} x y z", "s"), (4, f"{b} {a} x y z", "s"), (5, b.upper(), "s")])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}


def test_very_long_texts_take_linear_time():
    field, began = pii.Field(np.zeros((pii.FEATURES, 5)), 0.3, 5.0), time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "@" * 500_000, "a.b" * 600_000 + "@", "call 017 555-7713, " * 20_000, "1 " * 1_000_000):
        field.added(text, pii.base_spans(text))
    assert time.time() - began < 12
    began = time.time()
    assert tokenizer.count_tokens(pa.array(["ab" * 1_000_000]), token_counts.default_path()).tolist() == [1_000_000]
    assert time.time() - began < 20


def enumerated(field, graph, clamp):
    """Beliefs of a small graph by all its labellings."""
    n, k, out = len(graph.units), len(pii.LABELS), 0
    local = graph.x @ field.node
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if all(not c or c == y for c, y in zip(clamp, labels)):
            weight = sum(local[i, y] for i, y in enumerate(labels)) + sum(field.chain for a, b in graph.chain if labels[a] == labels[b]) + sum(field.skip for a, b in graph.skip if labels[a] == labels[b])
            out[range(n), labels] += np.exp(weight)
    return out / out.sum(1, keepdims=True)


def test_beliefs_agree_with_enumeration():
    rng, texts = np.random.default_rng(4), ["a@b.com, 12 x 4455 and 10.0.0.1", "555-7713 then 5557713", "+1 (017) 555-7713 x 555-7713 x 555 7713", "1 2 x 33"]
    for text in texts:  # chains, and mentions that are neighbours: no loops
        for chain, skip in ((0.7, 0.0), (0.0, 3.0), (-0.8, 0.0), (0.0, 0.0)):
            graph = pii.Graph(text)
            field, clamp = pii.Field(rng.normal(size=(pii.FEATURES, 5)), chain, skip), graph.gold(pii.base_spans(text))
            assert np.abs(field.posterior(graph, clamp) - enumerated(field, graph, clamp)).max() < 1e-5
    # with loops beliefs are near, and the same label is the likeliest
    graph = pii.Graph("555-7713 x 12 34 56 x 555 7713 x a@b.com x 5557713")
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), 0.4, 1.0)
    got, want = field.posterior(graph, np.zeros(len(graph.units), int)), enumerated(field, graph, np.zeros(len(graph.units), int))
    assert len(graph.skip) == 2 and np.abs(got - want).max() < 0.05 and (got.argmax(1) == want.argmax(1)).all()


def test_skip_weight_is_learnt():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, pii.FEATURES)), rng.integers(0, 5, 400)
    none = np.zeros((400, 5))
    equal, other = none.copy(), none.copy()
    equal[range(400), y] = 1
    other[range(400), (y + 1) % 5] = 1
    learnt = [pii.train([(x, y, none, skip)]).skip for skip in (other, none, equal)]
    assert learnt[1] == pytest.approx(pii.SKIP_PRIOR) and learnt[0] < 1 and learnt[1] < learnt[2]


def test_planted_mentions_are_added(spark):
    rnd, rows, want = random.Random(8), [], {}
    for i in range(60):
        number = f"{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
        text = f"write to +1 (017) {number} or on. " + "the words go on " * rnd.randrange(1, 30)
        want[i] = len(text) + 5
        rows.append((i, f"{text}call 017 {number} again, room {rnd.randrange(10, 99)}, in {rnd.randrange(1900, 2020)}", "s"))
    rows += [(i, f"the year {rnd.randrange(1900, 2020)}, room {rnd.randrange(100)}, part {rnd.randrange(10**8)} and 12:30", "s") for i in range(100, 160)]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, rows)).collect()}
    assert sum(f"phone:{at}:" in got[i].spans for i, at in want.items()) >= 57
    assert all(r.n_added == 0 for i, r in got.items() if i >= 100)


def test_exact_dedup_beyond_the_broadcast_filter(spark, docs, monkeypatch):
    rows = docs + [(1000 + i, "hot", "a") for i in range(600)]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256)
    want = sorted(map(key, exact_dedup.exact_dedup(table(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "FILTER_BITMAPS", 0)
    frame = exact_dedup.exact_dedup(table(spark, rows))
    assert sorted(map(key, frame.collect())) == want
    rows = exact_dedup.written(exact_dedup.digests(table(spark, rows)).withColumn("range", (F.col("row") % 3).cast("int")), "r", by="range")
    plan = exact_dedup._asked_of(rows.filter("range = 1").drop("range"), 1 << 15)._jdf.queryExecution()
    assert "text" not in plan.optimizedPlan().toString() and "PartitionFilters: [isnotnull(range" in plan.executedPlan().toString()


def test_stages_beyond_the_broadcast_limit(spark, docs, monkeypatch):
    import corpus_pipeline
    from sparkloom.llm import common

    sf = "/root/testdata/sf0.001"
    frame = common.written(table(spark, docs * 2).repartition(5), "input")
    found = {}
    for limit in (common.BROADCAST_ROWS, 1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        near = corpus_pipeline.near_duplicates(spark, frame, sf)
        taken = corpus_pipeline.mix(spark, frame, sf)
        clean = corpus_pipeline.decontaminate(spark, frame, sf)
        linked = jaccard_join.jaccard_components(frame)
        found[limit] = [sorted(map(repr, x.collect())) for x in (near, taken, clean, linked)]
        assert [x.columns for x in (near, taken, clean)] == [frame.columns] * 3
        if limit == 1:  # the result was written group by group: no join is left that could move texts
            assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    small, beyond = found.values()
    assert small == beyond


def test_copies_of_a_row_are_mixed_each(spark):
    import corpus_pipeline

    rows = [(1, "w " * 40, "a")] * 6 + [(i, "v " * (i % 9), "b") for i in range(40)] + [(None, "u u u", None)] * 3
    got = corpus_pipeline.mix(spark, table(spark, rows), "").collect()
    plan = mixing.mix(table(spark, rows)).collect()
    assert len(got) == sum(r.copies for r in plan)
    assert sum(r.doc_id == 1 for r in got) == sum(r.copies for r in plan if r.doc_id == 1)


def test_middle_stages_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rows = frame.collect()
    shingled = lambda t, k, p: (lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())(re.findall(p, lower(t)))
    sets, label = [shingled(r.text, 5, r"[^\x20\x09-\x0D]+") for r in rows], list(range(len(rows)))
    edges = [(x, y) for x, y in itertools.combinations(range(len(rows)), 2) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for _ in rows:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    order = sorted(range(len(rows)), key=lambda x: rows[x].doc_id)
    want = {min((rows[y].doc_id for y in order if label[y] == label[x])) for x in order}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, sf).collect()) == sorted(want)
    held = set()
    for item in bench:
        n = len(re.findall(r"[^\W_]+", (item.text or "").lower()))
        q = shingled((item.text or "").lower(), min(5, n), r"[^\W_]+") if n else set()
        held |= {r.doc_id for r in rows if q and len(q & (shingled(r.text.lower(), min(5, n), r"[^\W_]+") if len(re.findall(r"[^\W_]+", r.text.lower())) >= min(5, n) else set())) >= 0.8 * len(q)}
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, frame, sf).collect()) == sorted(r.doc_id for r in rows if r.doc_id not in held)


def test_stages_of_odd_tables(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4) for i, t, s in docs[:30]] * 2, "doc_id long, text string, lang string, source string, n_chars long, file long, row long, copies long")
    for frame in (odd, odd.limit(0), odd.filter("text is null")):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, frame, sf)
            assert out.columns == odd.columns and out.count() <= 2 * frame.count()
    assert corpus_pipeline.pack(spark, odd.limit(0), sf).count() == 0 and corpus_pipeline.pack(spark, odd, sf).count() > 0


def test_quality_with_one_label(spark):
    frame = table(spark, [(i, f"text number {i}", "a") for i in range(20)])
    for label in (0, 1):
        model = quality.fit(frame, spark.createDataFrame([(i, label, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
        assert {r.score for r in quality.scored(frame, model).collect()} == {float(label)} and quality.accepted(frame, model).count() == 20 * label
    none = quality.fit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.score, r.predicted) for r in quality.scored(frame, none).collect()} == {(0.5, 0)}


def test_quality_learns_one_text_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, seed=7: seen.append(len(rows)) or quality.Model(0.0, 0, 0, 0, 0, 0.5))
    frame = table(spark, [(i % 5, f"text {i}", "a") for i in range(300)])
    quality.fit(frame, spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int"))
    assert 0 < seen[0] <= 5


def test_quality_gradients():
    """One step of training moves weights as differences of the loss say."""
    rng, words = np.random.default_rng(3), 1 << quality.BUCKET_BITS
    model = quality.Model(0.2, rng.normal(size=words + quality.STATS), rng.normal(size=(words + quality.STATS, quality.RANK)) / 4, np.zeros(quality.STATS), np.ones(quality.STATS))
    bucket, value, dense = np.array([3, 77, 500]), np.array([0.5, 0.2, 0.9]), rng.normal(size=(1, quality.STATS))
    logit = lambda: model.logits(np.zeros(3, int), bucket, value, dense)[0][0]
    _, sums = model.logits(np.zeros(3, int), bucket, value, dense)
    for f in range(quality.RANK):
        want = value[1] * (sums[0, f] - value[1] * model.vectors[77, f])
        kept = model.vectors[77, f]
        model.vectors[77, f] = kept + 1e-6
        up = logit()
        model.vectors[77, f] = kept - 1e-6
        assert (up - logit()) / 2e-6 == pytest.approx(want, abs=1e-5)
        model.vectors[77, f] = kept


def test_decontamination_bounds_are_sketches_on_both_sides(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 9, 20, 70])))) for i in range(60)]
    rows = []
    for i in range(150):
        held = items[i % 60][1].split()
        for _ in range(rnd.randrange(3)):
            held[rnd.randrange(len(held))] = "edit"
        rows.append((i, " ".join([*(rnd.choice(words) for _ in range(rnd.choice([0, 5, 400]))), *held, *(rnd.choice(words) for _ in range(7))]), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    shingles = decontamination.item_shingles(bench, 5).withColumn("key", F.col("item_id"))
    for r in decontamination.sketches(shingles, 0.8).join(shingles.select("key", "sh"), "key").collect():
        assert sorted(r.sketch) == sorted(r.sh)[: len(r.sketch)] and max(r.sketch) <= r.bound and len(r.sketch) == len(r.sh) - r.need + 1
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, rows), bench).collect()}
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for item, text in items:
        k = min(5, len(text.split()))
        q = grams(text.split(), k)
        want |= {(i, item) for i, t, _ in rows if len(q & grams(t.split(), k)) >= 0.8 * len(q)}
    assert got == want and len(want) > 100


def test_fixity_of_offsets_and_headers(spark):
    rows = [(i, f"http://x/{i}", "<p>" * (i % 5)) for i in range(300)]
    ours = spark.createDataFrame(rows, "page_id long, url string, html string")
    leaf = fixity.leaves(fixity.records(ours))
    moved = leaf.withColumn("length", F.when(F.col("page_id") == 130, F.col("length") + 1).otherwise(F.col("length")))
    a, b = fixity.tree(leaf, 3), fixity.tree(moved, 3)
    differ = [{r.node for r in fixity._differing(x, y).collect()} for x, y in zip(a, b)]
    assert differ == [{2}, {0}, {0}]
    lost = fixity.tree(leaf.filter("page_id <> 70"), 3)
    assert {r.node for r in fixity._differing(a[0], lost[0]).collect()} == {1}
    dated = ours.withColumn("warc_date", F.lit("2020-01-01T00:00:00Z")).withColumn("warc_record_id", F.col("page_id"))
    assert fixity.records(dated).first().length == fixity.records(ours).first().length + len("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: 0")
    assert {r.status for r in fixity.audit(dated, dated.withColumn("warc_date", F.when(F.col("page_id") == 9, "x").otherwise(F.col("warc_date")))).collect()} == {"ok", "changed"}


def test_fixity_of_odd_rows(spark):
    schema = "page_id long, url string, html string, digest string, node long, length string"
    rows = [(None, "u", "a", "x", 1, "y"), (None, "u", "a", "x", 1, "y"), (None, "v", None, "x", 1, "y"), (3, None, "z" * 300_000, "x", 1, "y"), (3, "w", "k", "x", 1, "y")]
    ours = spark.createDataFrame(rows, schema)
    got = fixity.audit(ours, spark.createDataFrame(rows[1:], schema)).collect()
    assert len(got) == 5 and sorted(r.status for r in got) == ["changed", "changed", "ok", "ok", "ok"]
    assert all(r.volume is None and r.range_id is None for r in got if r.page_id is None)


def test_chat_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, h1 string, place long, n long"
    rows = [(1, None, "user", f"q{i}") for i in range(40)] + [(1, -700, "user", "low"), (1, -1, "user", "x"), (1, 0, None, None), (1, 0, None, None), (1, 300, "user", "y" * 200_000)]
    rows += [(2, t, r, x) for _, t, r, x in rows[:42]] + [(3, -700, "user", "low"), (4, -700, "user", "low"), (4, -700, "user", "low")]
    frame = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], schema)
    got = {r.conv_id: r for r in chat.collapse(frame.repartition(5)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 45, 4: 2}
    said = re.findall(r"<\|im_start\|>user\n(.*?)<\|im_end\|>", got[1].rendered)
    assert sorted(said[:40]) == sorted(f"q{i}" for i in range(40)) and said[40:42] == ["low", "x"]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from sparkloom.llm import common

    with pytest.raises(RuntimeError):
        common.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077")))


def test_tables_are_released(spark):
    from sparkloom.llm import common

    began = common.made()
    first, last = (common.written(spark.range(3), "x") for _ in range(2))
    common.release(spark, began, keep=1)
    assert common.made() == began + 1 and last.count() == 3
    with pytest.raises(Exception):
        first.count()


def test_packed_matrices(spark, docs):
    packed = packing.pack(table(spark, docs), width=64, shard_tokens=3000)
    rows = {(r.shard, r.row): r for r in packed.collect()}
    found = packing.matrices(packed, 64).collect()
    assert sum(m.n_rows for m in found) == len(rows) and len(found) > 1 and packing.matrices(packed.limit(0), 64).count() == 0
    for m in found:
        ids = np.frombuffer(m.matrix, "<u2")
        assert ids.size == m.n_rows * 64 and len(m.position_resets) == m.row_starts[-1] == len(m.cu_seqlens) - 1
        for i in range(m.n_rows):
            r = rows[m.shard, i]
            assert ids[i * 64 : (i + 1) * 64].tobytes() == r.ids
            mine = slice(m.row_starts[i], m.row_starts[i + 1])
            assert [x - i * 64 for x in m.position_resets[mine]] == r.position_resets and [x - i * 64 for x in m.cu_seqlens[1:][mine]] == r.cu_seqlens[1:]


def test_an_encoder_ends_documents_behind_its_vocabulary():
    import public_tokenizers

    assert packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).end == packing.END


def test_stages_of_tables_in_folders_by_column(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline
    from sparkloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    table(spark, docs).write.partitionBy("lang", "source").parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mix):
        out = stage(spark, frame, "/root/testdata/sf0.001")
        assert out.columns == frame.columns and out.filter("lang is null").count() == 0
    plain = corpus_pipeline.near_duplicates(spark, table(spark, docs), "").collect()
    got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(str((r.doc_id, r.text and r.text.lower())) for r in got) == sorted(str((r.doc_id, r.text and r.text.lower())) for r in plain)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import public_tokenizers

    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError, match="normalizer, pre_tokenizer, model"):
            tokenizer.count_tokens(pa.array(["some text"]), public_tokenizers.path(name))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        whole = json.load(f)
    tokenizer.refuse_others(whole, "x")
    tokenizer.refuse_others(whole | {"model": {k: v for k, v in whole["model"].items() if k != "dropout"}}, "x")
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": whole["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": whole["model"] | {"ignore_merges": True}}, {"model": whole["model"] | {"end_of_word_suffix": "</w>"}}, {"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            tokenizer.refuse_others(whole | change, "x")


def test_exact_dedup_by_ranges(spark, docs, monkeypatch):
    """Where the filter is too large for one broadcast, rows are split by their hash; the result is the same."""
    order = lambda df: sorted(map(tuple, df.drop("row").collect()), key=repr)
    frame = table(spark, docs)
    want = order(exact_dedup.exact_dedup(frame))
    monkeypatch.setattr(exact_dedup, "FILTER_BITMAPS", 1)
    seen = []
    real = exact_dedup._asked_of
    monkeypatch.setattr(exact_dedup, "_asked_of", lambda rows, bits: seen.append(rows.count()) or real(rows, bits))
    assert order(exact_dedup.exact_dedup(frame, bits_per_row=1 << 10)) == want
    assert len(seen) == -(-len(docs) * 1024 // 32768) > 3 and sum(seen) == len(docs)


def test_linked_mentions_teach_the_skip_weight(spark, monkeypatch):
    """Clear mentions of one thing that agree make a skip edge worth more than its prior; such that do not, less; without any it is the prior."""
    k = len(pii.LABELS)
    x, none = np.zeros((4, pii.FEATURES)), np.zeros((4, k))
    plain = (x, np.array([0, 0, 1, 2]), none, none)
    same, other = np.zeros((k, k)), np.zeros((k, k))
    same[1, 1] = same[2, 2] = 6
    other[1, 2] = other[2, 1] = 6
    learnt = [pii.train([(*plain, *more)]).skip for more in ((), (same,), (other,))]
    assert learnt[0] == pytest.approx(pii.SKIP_PRIOR, abs=1e-6) and learnt[1] > pii.SKIP_PRIOR + 0.2 and learnt[2] < pii.SKIP_PRIOR - 0.2
    text = "write to a.b@c.org or a.b@c.org, not to x@y.net"
    linked = pii._examples(text)[4]
    assert linked[1, 1] == 2 and linked.sum() == 2
    docs = table(spark, [(1, text + " call 017 5550199 or 017 5550199 again", "s"), (2, None, "s")])
    assert all(r.settled for r in pii.find_pii(docs).collect())
    monkeypatch.setattr(pii, "VISITS", 0)
    field = pii.train([pii._examples(text)])
    field.added(text, pii.base_spans(text))
    assert not field.settled
