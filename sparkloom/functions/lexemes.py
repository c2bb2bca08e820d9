"""Words as a dictionary has them: romanised names, lemmas and parts of speech."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The romanisation of Ukrainian of 2010, longer sources first.
ROMAN = (
    ("зг", "zgh"),
    ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"),
    ("ю", "iu"), ("я", "ia"), ("є", "ie"), ("ї", "i"), ("й", "i"),
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "h"), ("ґ", "g"), ("д", "d"), ("е", "e"),
    ("з", "z"), ("и", "y"), ("і", "i"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"),
    ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"),
    ("ь", ""), ("'", ""), ("’", ""),
)

#: Letters of the longest ending that an unknown word is judged by.
ENDING = 5


def rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Replaces every source by its target, in the order of the rules. Neighbouring rules of one letter each, whose targets are no sources
    of the others, are one pass; all rules together are one expression."""
    out, group = text, []

    def flush(out: Column) -> Column:
        if group:
            # a letter without a target goes: it has no counterpart at the end of the list
            ordered = sorted(group, key=lambda r: not r[1])
            out = F.translate(out, "".join(a for a, _ in ordered), "".join(b for _, b in ordered))
            group.clear()
        return out

    for source, target in rules:
        if len(source) == 1 and len(target) <= 1 and not any(target and target == a for a, _ in group) and not any(source in b for _, b in group):
            group.append((source, target))
        else:
            out = F.replace(flush(out), F.lit(source), F.lit(target))
    return flush(out)


def romanised(name: Column) -> Column:
    """A name in Latin letters, lower case; what has no counterpart goes. Null stays null."""
    return F.btrim(F.regexp_replace(rewritten(F.lower(name), ROMAN), r"[^\x00-\x7F]", ""), F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))


def cyrillic(name: Column) -> Column:
    """The inverse of romanised on words whose Cyrillic form is regular: longest targets first; an i is і, and apostrophes do not come back."""
    rules = sorted(((b, a) for a, b in ROMAN if b and a not in "їй"), key=lambda r: -len(r[0]))
    return reduce(lambda out, r: F.replace(out, F.lit(r[0]), F.lit(r[1])), rules, F.lower(name))


# ---- lemmas ----
def _shared(a: Column, b: Column) -> Column:
    """Letters that two words share from their start on."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.size(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.left(a, i) == F.left(b, i)))


def endings(dictionary: DataFrame) -> DataFrame:
    """(ending, cut, more, pos) from (form, lemma, pos): for each ending of up to ENDING letters what most forms that have it lose and get
    instead, and their part of speech; of equally many the first by cut, more and pos."""
    rules = dictionary.withColumn("_s", _shared(F.col("form"), F.col("lemma")))
    rules = rules.select("form", "pos", (F.char_length("form") - F.col("_s")).alias("cut"), F.expr("substring(lemma, _s + 1)").alias("more"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(ENDING), F.char_length("form")))
    each = rules.filter("form <> ''").select("cut", "more", "pos", "form", F.explode(sizes).alias("n")).filter("n >= cut")
    counts = each.groupBy(F.expr("right(form, n)").alias("ending"), "cut", "more", "pos").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("ending").agg(F.min_by(F.struct("cut", "more", "pos"), F.struct(-F.col("k"), "cut", "more", "pos")).alias("x")).select("ending", "x.*")


def lemmas(words: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """(word, lemma, pos, known) for each distinct word, in lower case.

    A word of the dictionary (form, lemma, pos; unique forms) has its lemma. Another is judged by the longest
    ending that forms of the dictionary have; without any it is its own lemma and has no part of speech.
    """
    w = words.select(F.lower(word).alias("word")).filter("word <> ''").distinct()
    both = w.join(dictionary.select(F.col("form").alias("word"), "lemma", "pos"), "word", "left")
    unknown = both.filter("lemma is null").select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(ENDING), F.char_length("word")))).alias("n"))
    judged = unknown.withColumn("ending", F.expr("right(word, n)")).join(endings(dictionary), "ending").groupBy("word").agg(F.max_by(F.struct("cut", "more", F.col("pos").alias("p")), "n").alias("x"))
    both = both.join(judged, "word", "left").withColumn("known", F.col("lemma").isNotNull())
    by_ending = F.concat(F.expr("left(word, char_length(word) - x.cut)"), F.col("x.more"))
    return both.select("word", F.coalesce("lemma", by_ending, "word").alias("lemma"), F.coalesce("pos", "x.p").alias("pos"), "known")


def lemma_terms(texts: DataFrame, key: str, text: Column, dictionary: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(key, terms): the lemmas of a text's words of three letters and more, in order, and of neighbours both; kept names the parts of
    speech that count, all if None. key is unique. Words go to the dictionary once each, and lemmas back to their places."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}']{3,}"), F.lit(0))
    places = texts.select(key, F.posexplode(found).alias("_p", "word"))
    known = lemmas(places, "word", dictionary)
    placed = places.join(known.select("word", "lemma", "pos"), "word")
    placed = placed.filter(F.col("pos").isin(kept)) if kept is not None else placed
    terms = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "lemma")))["lemma"].alias("l"))
    pairs = F.zip_with(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return texts.select(key).join(terms, key, "left").select(key, F.coalesce(F.concat("l", pairs), F.array().cast("array<string>")).alias("terms"))
