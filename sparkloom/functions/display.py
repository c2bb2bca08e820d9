"""Texts for readers, keys of result pages, and small filters over lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATUS_TAGS = {"pending_review": "warning", "published": "success", "rejected": "danger", "expired": "info"}
CHANNELS = ("nau_info",)
CHANNEL_NEWS = ("новини", "новостей", "університет", "студент", "коледж", "абітурієнт", "розклад", "оголошення", "вступ")
CHANNEL_WORDS = ("інфо", "info", "news")
NO_DISCOUNT = "—"


def _number(value: Column) -> Column:
    """A number as text without trailing zeros."""
    text = F.format_string("%.10f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def day(at: Column) -> Column:
    """dd.mm.yyyy in UTC, empty for null."""
    return F.coalesce(F.date_format(at, "dd.MM.yyyy"), F.lit(""))


def status_tag(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, F.lit(tag)) for s, tag in STATUS_TAGS.items()), F.lit("info"))


def discount_label(kind: Column, value: Column) -> Column:
    n = _number(value)
    known = (
        F.when(kind == "free", F.lit("безкоштовно")).when(value.isNull(), F.lit(""))
        .when(kind == "percent", F.concat(F.lit("−"), n, F.lit("%"))).when(kind == "fixed", F.concat(F.lit("−"), n, F.lit(" грн"))).when(kind == "special_price", F.concat(n, F.lit(" грн")))
    )
    return F.coalesce(known, F.lit(""))


def discount_summary(count: Column, kind: Column, value: Column) -> Column:
    """How many discounts, if several, else the label of the one."""
    label = discount_label(kind, value)
    return F.when(count > 1, F.concat(count.cast("string"), F.lit(" знижок"))).when(label != "", label).otherwise(NO_DISCOUNT)


def badge(type_: Column, kind: Column, value: Column) -> Column:
    """(text, kind) on an offer's card."""
    n = _number(value)
    out = lambda text, of: F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(of).alias("kind"))
    return (
        F.when(type_ == "event", out("Подія", "event")).when(kind == "free", out("Безкоштовно", "free"))
        .when((kind == "percent") & value.isNotNull(), out(F.concat(F.lit("−"), n, F.lit("%")), "discount"))
        .when((kind == "fixed") & value.isNotNull(), out(F.concat(F.lit("−"), n, F.lit(" ₴")), "discount"))
        .when(kind == "special_price", out("Спеціальна ціна", "discount")).otherwise(out("Знижка", "discount"))
    )


def note_segments(note: Column) -> Column:
    """(text, url) runs of a note in order; each has one of the two."""
    given = F.coalesce(note, F.lit(""))
    urls, texts = F.regexp_extract_all(given, F.lit(r"(?i)(https?://\S+)"), F.lit(1)), F.split(given, r"(?i)https?://\S+")
    none = F.lit(None).cast("string")
    pairs = F.transform(texts, lambda t, i: F.array(F.struct(F.when(t != "", t).alias("text"), none.alias("url")), F.struct(none.alias("text"), F.try_element_at(urls, i + 1).alias("url"))))
    return F.filter(F.flatten(pairs), lambda x: x["text"].isNotNull() | x["url"].isNotNull())


def active_filters(*values: Column) -> Column:
    """How many filters, texts or lists, are not empty."""
    return sum((F.when(F.length(F.array_join(v, "") if is_list else F.coalesce(v, F.lit(""))) > 0, 1).otherwise(0) for v, is_list in values), F.lit(0))


def listed(name: Column, typed: Column) -> Column:
    """Whether an entry of a filter list is shown for what was typed."""
    return F.contains(F.lower(name), F.lower(F.trim(F.coalesce(typed, F.lit("")))))


def page_key(phrase: Column, page: Column) -> Column:
    """Cache key of a page of results."""
    base = F.lower(F.trim(phrase))
    return F.when(page > 1, F.concat(base, F.lit("#p"), page.cast("string"))).otherwise(base)


def adaptive_delay(delay: Column, healthy: Column, pool: Column) -> Column:
    """The fewer of the pool are healthy, the longer the pause."""
    return F.when(healthy > 0, delay * (pool / healthy)).otherwise(delay)


def total_pages(total: Column, size: Column) -> Column:
    return F.greatest(F.ceil(total / size), F.lit(1)).cast("long")


def channel_handle(value: Column) -> Column:
    """The handle of a channel, given as @name, name or a link."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "^@", "")
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(s, r"^.*?t\.me/", ""), "^/+", ""), r"^([^/?]*)", 1)


def is_noise_channel(handle: Column, name: Column) -> Column:
    """A channel of news or notices, by its handle or name."""
    text = F.lower(F.concat_ws(" ", F.coalesce(handle, F.lit("")), F.coalesce(name, F.lit(""))))
    word = text.rlike(r"(?U)(?<!\w)(" + "|".join(CHANNEL_WORDS) + r")(?!\w)")
    return channel_handle(handle).isin(*CHANNELS) | text.rlike("|".join(CHANNEL_NEWS)) | word
