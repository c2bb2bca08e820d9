"""The search pass, outcomes, names by automaton, leaders in rounds, lemmas, and states that are saved."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.functions import lexemes
from sparkloom.operators import outcomes, passes, places, resolution
from sparkloom.sources import files


def test_a_pass_without_results_does_not_advance(spark):
    grid = spark.createDataFrame([(i, f"p{i}", 1, 0) for i in range(5)], "position long, phrase string, page long, dry long")
    cache = spark.createDataFrame([("a", 50, False), ("b", 10, False), ("c", 60, True), ("d", 40, False), ("e", 70, None)], "key string, at long, harvested boolean")

    def run(notes, cursor=3):
        results = spark.createDataFrame([(n,) for n in notes], "note string")
        return passes.search_pass(grid, cursor, 5, 3, F.col("position") != 4, cache, F.lit(100), 70, results, 2)

    done = run(["x: p3", "cache: p3#1", "cache: p0#2", "p1", None, "x: other"])
    assert [r.key for r in done.drained.collect()] == ["d", "a"]  # oldest first; b is too old, c is harvested
    assert sorted(map(tuple, done.phrases.collect())) == [("p0", 1, 0, 2, 1), ("p1", 1, 0, 2, 1), ("p3", 1, 2, 2, 0)]
    assert done.cursor.first().cursor == 2
    none = run([])
    assert sorted(map(tuple, none.phrases.collect())) == [("p0", 1, 0, 1, 0), ("p1", 1, 0, 1, 0), ("p3", 1, 0, 1, 0)]
    assert none.cursor.first().cursor == 3


def test_outcomes_are_counted_while_rows_are_written(spark):
    now = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, v long")
    new = spark.createDataFrame([(2, 21), (3, 31), (4, 41)], "k long, v long")
    table, counts = outcomes.counted(outcomes.merge(now, new, ["k"], F.col("v") < 25), "outcome", ["inserted", "updated", "kept", "untouched"], "merged")
    assert counts == {"inserted": 1, "updated": 1, "kept": 1, "untouched": 1}
    assert sorted(map(tuple, table.collect())) == [(1, 10), (2, 21), (3, 30), (4, 41)]
    items = spark.createDataFrame([(1, "new", "a"), (2, "done", "a"), (3, "new", None), (4, "new", "b"), (5, None, "a"), (6, "rejected", "a")], "k long, status string, host string")
    done, learnt = outcomes.reject(items, spark.createDataFrame([(1,), (1,), (2,), (3,), (5,), (99,)], "k long"), "k", "status", "host", ["new"])
    assert {r.k: (r.status, r.outcome) for r in done.collect()} == {1: ("rejected", "rejected"), 2: ("done", "refused"), 3: ("rejected", "rejected"), 4: ("new", "untouched"), 5: (None, "refused"), 6: ("rejected", "untouched")}
    assert [tuple(r) for r in learnt.collect()] == [("a", 1, 2, 1)]
    empty, counts = outcomes.counted(outcomes.merge(now.limit(0), new.limit(0), ["k"]), "outcome", ["inserted", "kept"], "merged")
    assert counts == {"inserted": 0, "kept": 0} and empty.count() == 0


@pytest.fixture
def joined(monkeypatch):
    """Names by the join of large dictionaries, whatever the size."""

    def find(*args):
        with monkeypatch.context() as m:
            m.setattr(places, "BROADCAST_FORMS", 0)
            return places.find_names(*args)

    return find


def test_names_by_automaton_and_by_join_agree(spark, joined):
    rnd = random.Random(9)
    words = ["нова", "одеса", "the", "місто", "с", "a-b", "rivne", "і'", "x"]
    forms = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3]))), f"n{i % 17}", rnd.random() < 0.3) for i in range(60)] + [(99, "", "none", False), (98, "ОДЕСА", "Одеса", False)]
    forms = spark.createDataFrame(forms, "position long, form string, name string, marked boolean")
    texts = [(i, rnd.choice([" ", ", ", " ' ", "\n"]).join(rnd.choice(words).upper() if rnd.random() < 0.2 else rnd.choice(words) for _ in range(rnd.randrange(25)))) for i in range(200)] + [(900, None), (901, ""), (902, "' '' ’")]
    docs = spark.createDataFrame(texts, "id long, text string")
    a, b = (sorted(map(tuple, f(docs, "id", "text", forms).select("id", F.array_join("names", ",")).collect())) for f in (places.find_names, joined))
    assert a == b and sum(bool(x[1]) for x in a) > 100


def test_a_hundred_thousand_forms(spark):
    forms = spark.range(100_000).select(F.col("id").alias("position"), F.concat(F.lit("name"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("form"), F.col("id").cast("string").alias("name"), F.lit(False).alias("marked"))
    docs = spark.createDataFrame([(i, f"to Namebcde, from nameb{'c' * (i % 4)} and nam") for i in range(2000)], "id long, text string")
    began = time.time()
    found = {r.id: r.names for r in places.find_names(docs, "id", "text", forms).collect()}
    assert found[0] == ["1234", "1"] and found[3] == ["1234", "1222"] and time.time() - began < 60


def walked(rows, threshold):
    """One item after the other."""
    leaders, out = {}, set()
    for host, key, tokens, mags, decided in sorted(rows, key=lambda r: r[1]):
        if not mags:
            continue
        match = next((k for k, t, m in leaders.get(host, []) if tokens and t and set(mags) <= set(m) and len(set(tokens) & set(t)) >= threshold * len(set(tokens) | set(t))), None)
        if match is not None and not decided:
            out.add((key, match))
        else:
            leaders.setdefault(host, []).append((key, tokens, mags))
    return out


def test_leaders_in_rounds_are_those_of_the_walk(spark):
    rnd = random.Random(11)
    rows = []
    for key in range(240):
        tokens = sorted(rnd.sample("abcdefgh", rnd.randrange(0, 7)))
        rows.append((rnd.choice(["h", "h", "g", "i"]), key, tokens, sorted(rnd.sample([1, 2, 3], rnd.choice([0, 1, 1, 2, 3]))), rnd.choice([True, False, False, None])))
    # a chain in which each is like its neighbours only: as many rounds as items
    letters = [f"w{i}" for i in range(40)]
    rows += [("chain", 1000 + i, letters[i : i + 8], [1], False) for i in range(12)]
    frame = spark.createDataFrame(rows, "host string, id long, t array<string>, m array<int>, decided boolean")
    got = {tuple(r) for r in resolution.leader_clusters(frame, "host", "id", "t", "m", "decided").collect()}
    assert got == walked(rows, 0.6) and len(got) > 30
    assert resolution.leader_clusters(frame.limit(0), "host", "id", "t", "m", "decided").count() == 0


def test_romanised(spark):
    names = ["Згурівка", "Запоріжжя", "Щастя", "Кам'янець", "Львів", "Їжак", "Ґалаґан", "  Ю-1 ", "", "Ёж", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.select(lexemes.romanised(F.col("n"))).collect()]
    assert got == ["zghurivka", "zaporizhzhia", "shchastia", "kamianets", "lviv", "izhak", "galagan", "iu-1", "", "zh", None]
    regular = ["згуба", "жаба", "хата", "цвях", "чаша", "борщ", "юшка", "гора", "ґава", "дощ"]
    back = spark.createDataFrame([(n,) for n in regular], "n string").select(lexemes.cyrillic(lexemes.romanised(F.col("n")))).collect()
    assert [r[0] for r in back] == regular


def test_rules_are_applied_in_their_order(spark):
    rules = (("ab", "x"), ("a", "b"), ("b", "c"), ("x", "ab"), ("d", ""))
    texts = ["".join(x) for n in range(5) for x in itertools.product("abxd", repeat=n)]

    def plain(text):
        for a, b in rules:
            text = text.replace(a, b)
        return text

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(lexemes.rewritten(F.col("t"), rules)).collect()] == [plain(t) for t in texts]


def test_unknown_words_are_judged_by_their_ending(spark):
    known = [("міста", "місто", "NOUN"), ("листа", "лист", "NOUN"), ("моста", "міст", "NOUN"), ("писала", "писати", "VERB"), ("читала", "читати", "VERB"), ("a", "a", "X")]
    dictionary = spark.createDataFrame(known, "form string, lemma string, pos string")
    words = spark.createDataFrame([("Тіста",), ("казала",), ("казала",), ("zzz",), ("міста",), ("",), (None,)], "w string")
    got = {r.word: (r.lemma, r.pos, r.known) for r in lexemes.lemmas(words, "w", dictionary).collect()}
    assert got == {"тіста": ("тісто", "NOUN", False), "казала": ("казати", "VERB", False), "zzz": ("zzz", None, False), "міста": ("місто", "NOUN", True)}
    texts = spark.createDataFrame([(1, "Міста казала, листа: zz!"), (2, None), (3, "")], "id long, t string")
    terms = {r.id: r.terms for r in lexemes.lemma_terms(texts, "id", F.col("t"), dictionary, ["NOUN"]).collect()}
    assert terms == {1: ["місто", "лист", "місто лист"], 2: [], 3: []}


def test_a_save_that_fails_leaves_what_was(spark, monkeypatch):
    path = f"{storage.new_path(spark, 'state')}/seen.json"
    read = lambda: sorted(r.id for r in files.load_state(spark, path, "id long").collect())
    assert read() == []
    files.save_state(spark.range(3), path)
    real = files._rename
    for bad in (1, 2):  # the first rename fails, then the second
        calls = []

        def rename(fs, at, to, bad=bad, calls=calls):
            calls.append(1)
            return False if len(calls) == bad else real(fs, at, to)

        monkeypatch.setattr(files, "_rename", rename)
        with pytest.raises(OSError):
            files.save_state(spark.range(5), path)
        monkeypatch.setattr(files, "_rename", real)
        assert read() == [0, 1, 2]

    def dies(fs, at, to, calls=[]):  # noqa: B006  cut off between the two renames
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(fs, at, to)

    monkeypatch.setattr(files, "_rename", dies)
    with pytest.raises(KeyboardInterrupt):
        files.save_state(spark.range(7), path)
    monkeypatch.setattr(files, "_rename", real)
    assert read() == [0, 1, 2]
    files.save_state(spark.range(4), path)
    assert read() == [0, 1, 2, 3]


def test_tables_between_steps_are_released(spark):
    kept = storage.written(spark.range(3), "kept")
    began = storage.made()
    paths = [storage.written(spark.range(n), "gone").inputFiles()[0] for n in (1, 2)]
    storage.release(spark, began)
    assert storage.made() == began and kept.count() == 3
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    assert not any(make(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(make(p)) for p in paths)


def test_like_items_are_found_across_blocks(spark, monkeypatch):
    """Blocks of few tokens, so that like items of a host meet in pairs of blocks."""
    monkeypatch.setattr(resolution, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(resolution, "COMMON_TOKENS", 3)
    rnd = random.Random(5)
    rows = [("h" if i % 3 else "g", i, sorted(rnd.sample("abcdefghijkl", rnd.randrange(1, 9))), sorted(rnd.sample([1, 2], rnd.choice([1, 2])))) for i in range(300)]
    want = {}
    for (h1, a, t1, m1), (h2, b, t2, m2) in itertools.combinations(rows, 2):
        if h1 == h2 and set(m2) <= set(m1) and len(set(t1) & set(t2)) >= 0.6 * len(set(t1) | set(t2)):
            want.setdefault(b, a)
    frame = spark.createDataFrame(rows, "host string, id long, t array<string>, m array<int>")
    got = dict(tuple(r) for r in resolution.promo_duplicates(frame, "host", "id", "t", "m").collect())
    assert got == want and len(got) > 100
