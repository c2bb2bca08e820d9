"""Which pages of a site are worth reading, by their address and the text of links to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Fixed values.
PROMO = (
    "promo", "akci", "akcii", "aktsi", "znizhk", "znyzhk", "rozprodazh", "discount", "discounts", "offer", "offers", "deal", "deals", "black-friday",
    "blackfriday", "specialpropoz", "spec-propoz", "cyber-monday", "акці", "акция", "знижк", "розпродаж", "спецпропоз", "дисконт", "вигід",
    "utsinka", "bonus", "cashback", "specialna", "spec-cina",
)
PAGE_TYPES = (
    "viysk", "viyskov", "viyskovosluzhb", "military", "army", "zsu", "veteran", "zahisnik", "zakhisnik", "defender",
    "teroboron", "police", "policiy", "dsns", "nacgvard", "natsgvard", "national-guard", "nationalguard", "ubd",
    "теробор", "поліці", "поліц", "дснс", "нацгвард", "гвард", "убд", "бойов", "kontakt", "contact", "dostavka", "oplata", "delivery", "payment", "shipping",
    "pro-nas", "pro_nas", "pronas", "pro-kompaniyu", "about", "o-nas", "o_nas", "loyal", "club", "faq", "pytannya", "pitannya", "korysn", "korisn", "useful",
    "військов", "ветеран", "захисник", "контакт", "доставка", "оплата", "про-нас", "лояльн", "бонус", "корисн", "питання",
)
EXCLUDED = (
    "/product", "/tovar", "/goods", "/item", "/p/", "cart", "koshyk", "checkout", "/order", "account", "login", "signin", "/register", "cabinet", "kabinet",
    "/profile", "wishlist", "blog", "news", "novyny", "/search", "poshuk", "filter", "/tag", "privacy", "cookie", "/ru/",
    "review", "otzyv", "vidhuk", "vidguk", "testimonial", "відгук", "отзыв", "photogallery", "gallery", "galereya", "галере", "фотогалер",
)
ANCHORS = (
    "військов", "ветеран", "зсу", "захисник", "убд", "територіальна оборона", "поліці", "дснс", "національна гвардія", "нацгвардія", "бойових дій",
    "знижка для військовослужбовц", "контакт", "доставка", "оплата", "про нас", "про компанію", "лояльн", "бонусна програма", "клуб", "корисна інформація", "питання", "акці", "знижк",
)


def _path(url: Column) -> Column:
    given = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[^/?#:]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(given, F.lit("+"), F.lit("%2B"))), given))


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    return text.rlike("|".join(tokens))


def _word_start(path: Column, tokens: tuple[str, ...]) -> Column:
    return path.rlike(r"(^|[/\-_.+ ])(" + "|".join(tokens) + ")")


def is_promo(url: Column) -> Column:
    return _word_start(_path(url), PROMO)


def is_excluded(url: Column) -> Column:
    return _any(_path(url), EXCLUDED)


def is_target(url: Column, anchor: Column | None = None) -> Column:
    """The path begins a word with a token of the list, or the link's text has one of its own; an excluded path never."""
    hit = _word_start(_path(url), PROMO + PAGE_TYPES)
    if anchor is not None:
        hit = hit | _any(F.lower(F.coalesce(anchor, F.lit(""))), ANCHORS)
    return ~is_excluded(url) & hit


def is_seed(url: Column) -> Column:
    """A root page, or a target."""
    return _path(url).isin("", "/") | is_target(url)


def follows(url: Column) -> Column:
    """Neither excluded nor of a place that is never read."""
    return ~is_excluded(url) & ~urls.is_aggressor_geo(url)
