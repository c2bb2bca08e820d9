"""Benchmark decontamination by size-partitioned MinHash containment search.

Both sides are sketched by the same order of shingle hashes. Test items are
partitioned by size, each class with a bound of its own. The sketch of an item is
its least hashes, one more than the shingles it may lack; the sketch of a document
for a class is all its hashes up to the bound of the class, the largest hash in a
sketch of the class. So the sketch of a document grows with the document, a short
item in a long document is found, and nothing is missed: of the hashes in the
sketch of an item that is held, at least one is in the document, and it is below
the bound. Documents with a hit are read again and their containment is counted
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, few, places, scanned, written

WORDS, THRESHOLD = 5, 0.8


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingle_hashes(words: str, width: int) -> Column:
    """Hashes of all shingles of this many words, in order; none if there are fewer words."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(width))
    return F.expr(f"case when size({words}) >= {width} then transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})) else array() end")


def _labelled(width: int):
    return lambda s: F.struct(F.lit(width).alias("width"), s.alias("sh"))


def _upto(bound: Column):
    return lambda s: s <= bound


def item_shingles(benchmark: DataFrame, words: int) -> DataFrame:
    """(item_id, width, sh, q): the distinct shingles of each item with words; a shorter item is one shingle."""
    items = benchmark.select("item_id", word_list(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(words)))
    hashes = F.coalesce(*(F.when(F.col("width") == k, _shingle_hashes("w", k)) for k in range(1, words + 1)))
    items = items.withColumn("sh", F.array_distinct(hashes)).withColumn("q", F.size("sh"))
    return items.select("item_id", "width", "q", "sh")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(th): xxhash64 of every text that contaminated() reports."""
    return _found(docs, benchmark, words, threshold).select("th").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): documents that hold at least threshold of an item's distinct shingles.

    Words are runs of letters and digits, lower-cased. An item of fewer words than a
    shingle must be held whole; an item or document without words matches nothing.
    Equal findings of one doc_id are reported once, a null doc_id as null. Texts of any
    length are read whole.
    Each text of the benchmark is searched for by itself: a null item_id is reported
    as null, and of an id with several texts each that is held has its row.
    Empty tables give no rows; other columns of docs are not read.
    """
    return _found(docs, benchmark, words, threshold).select("doc_id", "item_id", "n_shared", "n_item", "containment").distinct()


def contaminated_places(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(file, row) of the rows of docs, a scanned table, that hold an item; see contaminated."""
    return _found(docs, benchmark, words, threshold).select("file", "row").distinct()


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(key, width, class, need, sketch, bound): the least hashes of each item, and the largest in sketches of its size class."""
    need = F.ceil(F.col("q") * threshold - 1e-9)
    cut = items.select("key", "width", F.floor(F.log2("q")).alias("class"), need.alias("need"), F.slice(F.sort_array("sh"), F.lit(1), (F.col("q") - need + 1).cast("int")).alias("sketch"))
    bounds = cut.groupBy("width", "class").agg(F.max(F.element_at("sketch", -1)).alias("bound"))
    return cut.join(F.broadcast(bounds), ["width", "class"])  # a few classes for each width


def _found(docs: DataFrame, benchmark: DataFrame, words: int, threshold: float) -> DataFrame:
    # items of equal shingles are one key, whatever their ids
    items = written(item_shingles(benchmark, words).withColumn("key", F.xxhash64("width", F.array_sort("sh"))), "items")
    named, items = items.select("key", "item_id").distinct(), items.select("key", "width", "q", "sh").dropDuplicates(["key"])
    sketch = written(sketches(items, threshold), "sketches")
    classes = sketch.groupBy("width", "class").agg(F.first("bound").alias("bound"), F.min("need").alias("need")).collect()  # at most `words` widths by the size classes of items
    widths = sorted({r["width"] for r in classes})
    every = items.select("key", "width", "q", F.explode("sh").alias("sh"))

    def hashed(d: DataFrame, sketched: bool) -> DataFrame:
        d = d.withColumn("w", word_list(F.col("text")))
        sets = []
        for k in widths:
            found = _shingle_hashes("w", k)
            if sketched:  # the sketches for all classes of a width that the document is long enough for are one list
                bound = F.greatest(*(F.when(F.size("w") - k + 1 >= r["need"], F.lit(r["bound"])) for r in classes if r["width"] == k), F.lit(None).cast("long"))
                found = F.filter(found, _upto(bound))
            sets.append(F.transform(found, _labelled(k)))
        return d.select("doc_id", "th", "file", "row", F.size("w").alias("n"), F.explode(F.concat(*sets)).alias("x")).select("doc_id", "th", "file", "row", "n", "x.width", "x.sh")

    docs = scanned(docs)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), *places(docs))
    if not widths:
        return texts.selectExpr("doc_id", "th", "file", "row", "cast(null as long) item_id", "0L n_shared", "0L n_item", "0.0D containment").limit(0)
    # only if the benchmark has over a million hashes in its sketches, those of the documents are shuffled
    asked = written(sketch.select("key", "width", "need", F.explode("sketch").alias("sh")), "asked")
    hits = hashed(texts, True).join(F.broadcast(asked) if few(asked) else asked, ["width", "sh"]).filter("n - width + 1 >= need")
    found = written(hits.select("file", "row", "key").distinct(), "candidates")
    again = by_place(docs.select("doc_id", "text"), written(found.select("file", "row").distinct(), "again"), "left_semi", placed=True)
    shared = hashed(again.withColumn("th", F.xxhash64("text")), False).join(every, ["width", "sh"]).join(found, ["file", "row", "key"], "left_semi")
    counted = shared.groupBy("doc_id", "th", "file", "row", "key").agg(F.count_distinct("sh").alias("n_shared"), F.first("q").cast("long").alias("n_item"))
    counted = counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    return counted.join(named, "key").select("doc_id", "th", "file", "row", "item_id", "n_shared", "n_item", "containment")
