"""Text columns. Patterns avoid lookbehind and ASCII-only classes, so other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = ("для", "на", "та", "і", "й", "з", "зі", "у", "в", "що", "як", "до", "від", "по", "за", "є", "а", "або", "при", "не", "the", "a")

NOT_WORD = r"[^\p{L}\p{N}_]+"


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " +", " ")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(" | ", *map(normalized, parts)), 256)


def item_key(text: Column) -> Column:
    return F.sha1(text)


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Set of lower-case words that are no stop words."""
    given = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_distinct(F.filter(given, lambda w: (w != "") & ~w.isin(*stopwords)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(text: Column, shortest: int = 3) -> Column:
    """Lower-case words in order, those of at least this length."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest)


def bigrams(given: Column) -> Column:
    """Pairs of neighbours, joined by a space; none of fewer than two words."""
    n = F.size(given)
    pairs = F.zip_with(F.slice(given, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(given, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def script_ratio(text: Column, script: str = r"\x{0400}-\x{04FF}") -> Column:
    """Share of the letters that are of the script; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, f"[^{script}]", ""))
    return F.when(letters > 0, own / letters).otherwise(0.0)


def is_not_script(text: Column, script: str = r"\x{0400}-\x{04FF}", least_letters: int = 15, least_ratio: float = 0.3) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (letters >= least_letters) & (script_ratio(text, script) < least_ratio)


def title_from(text: Column, longest: int = 80) -> Column:
    """First line, of that the first sentence, cut at a word if longer than longest."""
    line = F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1))
    sentence = F.regexp_extract(line, r"^([^.!?]*[.!?]?)", 1)
    cut = F.regexp_replace(F.substring(sentence, 1, longest), r"\s+\S*$", "")
    return F.when(F.length(sentence) <= longest, sentence).otherwise(cut)


def email_domains(text: Column, own: Column | None = None, excluded: tuple[str, ...] = ()) -> Column:
    """Distinct domains of addresses in order, without the text's own host and the excluded ones."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1)), F.lower))
    keep = F.filter(found, lambda d: ~d.isin(*excluded)) if excluded else found
    return F.filter(keep, lambda d: d != own) if own is not None else keep


def handles(text: Column) -> Column:
    """Distinct lower-case @handles of five characters or more, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_@.])@([A-Za-z][A-Za-z0-9_]{4,31})"), F.lit(1)), F.lower))


def classify(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Labels, in the lexicon's order, of which a stem begins a word of the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*(F.when(lowered.rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(stems) + ")"), F.lit(label)) for label, stems in lexicon.items()))
    return F.filter(found, lambda x: x.isNotNull())


def percent_off(text: Column) -> Column:
    """First percentage from 1 to 100 in the text, else null."""
    value = F.regexp_extract(text, r"(?:^|[^0-9.,])([0-9]{1,3}) ?%", 1)
    number = F.when(value != "", value.cast("int"))
    return F.when((number >= 1) & (number <= 100), number)


def until_date(text: Column, default_year: int) -> Column:
    """First dd.mm, dd.mm.yy or dd.mm.yyyy in the text; a date that does not exist is null."""
    pattern = r"(?:^|[^0-9.])([0-9]{1,2})\.([0-9]{1,2})(?:\.([0-9]{4}|[0-9]{2}))?(?:[^0-9]|$)"
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    full = F.when(year == "", F.lit(str(default_year))).when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(day != "", F.try_to_date(iso, "yyyy-MM-dd"))


def capped(text: Column, longest: int = 160) -> Column:
    """White space collapsed; cut at a word if longer."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= longest, t).otherwise(F.regexp_replace(F.substring(t, 1, longest), r"\s+\S*$", ""))
