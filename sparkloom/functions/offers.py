"""What a text offers: triggers, discounts, audiences, dates, places. Word starts and classes are Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import content_hash, normalized

# Fixed values.
TRIGGERS = (
    "знижк", "акці", "промокод", "безкоштов", "безплатн", "безоплатн", "діє до", "спецпропоз", "розпродаж",
    "уцінк", "ліквідац", "бонус", "кешбек", "подарунок", "тільки сьогодні", "супер ціна", "супер-ціна", "гаряч пропозиц",
    "друга за пів ціни", "спеціальна ціна", "спец ціна", "вигідна пропозиц",
)
PERCENT = r"(\d{1,3})\s*(?:%|відсот|процент)"
FIXED = r"(?i)(\d[\d\s]{0,7})\s*(?:грн|гривень|₴|uah)"
UNTIL = r"(?:до|діє до)\s+(\d{1,2})[.\-/](\d{1,2})(?:[.\-/](\d{2,4}))?"
REDUCED = r"(?i)знижк|акці(?!онер)|розпродаж|спецпропоз|промокод|економ|вигід|-\s*\d"
RAISED = r"(?i)зростан|подорожч|підвищенн\w*\s+варт|дорожч|буде\s+[\d\s]+грн"
FREE = r"(?i)безкоштов|безплатн|безоплатн|\bfree\b|\b[ву]\s+подарунок|\bу\s+дарунок|даром|задарма|(?<!\d)0\s*(?:грн|₴)"
FREE_SERVICE = r"(?i)(?:безкоштовн|безплатн|безоплатн)\w*\s+(?:консультаці|доставк|замір|підбір|оцінк|парковк)"
PRICE_RANGE = r"(?i)від\s*\d[\d\s]*(?:₴|грн|гривень|uah)?\s*до\s*\d[\d\s]*\s*(?:₴|грн|гривень|uah)"
INFO_PAGES = ("about", "pro-nas", "pro-proekt", "pro-kompani", "o-nas", "o-kompani", "про-нас", "про-проєкт")
ONLINE = r"(?i)(?<!\w)(онлайн|інтернет[-\s]?магазин)"
ONLINE_NAME = "Онлайн"
SOCIAL = ("facebook.com", "instagram.com", "t.me", "telegram.me", "twitter.com", "x.com", "youtube.com", "youtu.be")
#: Stems that begin a word; a pair is a stem and what must not follow it.
AUDIENCES = {
    "ubd": ("убд", "учасник бойов", "бойових дій"),
    "warrior": ("військов", ("воїн", "ськ"), "захисник", ("зсу", r"\w"), "тероборон", "територіальн"),
    "veteran": ("ветеран",),
    "war-disability": ("інвалід", "інвалідніст"),
    "fallen-family": ("загибл", "полегл", ("вдов", "ол")),
    "idp": ("переселен", ("впо", r"\w"), "переміщен"),
    "ngu": ("нацгвард", ("нгу", r"\w")),
    "dsns": ("дснс", "рятувальник", "пожежник"),
    "police": ("поліц", "нацполіц"),
}
KINDS = {
    "rozvahy": ("розваг", "квест", "боулінг", "кінотеатр", "атракціон", "караоке", "більярд", "лазертаг"),
    "museums": ("музе", "галере", "виставк", "експозиц"),
    "food": ("кав'ярн", ("кафе", "др"), "ресторан", "бариста", "піцер", ("суші", "нн"), "паб ", "їдальн", "бістро", "кондитер", "пекарн"),
    "sport": ("спорт", "фітнес", "тренаж", "качалк", "єдиноборст", "басейн", "йога", "кросфіт"),
    "education": ("освіт", "курси", "навчанн", "тренінг", "репетитор", "автошкол", "вебінар"),
    "transport": ("транспорт", "таксі", "каршеринг", "переїзд", "доставк"),
    "medicine": ("клінік", "медцентр", "медичн", "діагностик", "реабілітац", "офтальмолог"),
    "beauty": ("перукар", "барбершоп", "манікюр", "педикюр", "косметолог", "епіляц", "візаж"),
    "auto": ("автосервіс", "шиномонтаж", "автомийк", "запчастин", "ремонт авто"),
    "pharmacy": ("аптек", "фармац"),
    "dentistry": ("стоматолог", "дантист", "зубн"),
    "clothing": ("одяг", "взутт", "ательє", "кросівк"),
    "flowers": ("квіт", "флорист", "букет"),
    "hotels": ("готель", "хостел", "база відпочинк", "санатор", "екскурс"),
    "books": ("книгарн", "канцтовар"),
    "electronics": ("електронік", "гаджет", "смартфон", "ноутбук"),
    "legal": ("юридичн", "адвокат", "нотаріус", "юрист"),
    "optics": ("оптик", "окуляр", "лінз"),
}

_U = "(?U)"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def stems_hit(text: Column, stems: tuple[str | tuple[str, str], ...]) -> Column:
    """Whether a stem begins a word of the text and is not followed by what it excludes."""
    return _begins(_lower(text), stems)


def _begins(low: Column, stems: tuple[str | tuple[str, str], ...]) -> Column:
    pattern = "|".join(s if isinstance(s, str) else f"{s[0]}(?!{s[1]})" for s in stems)
    there = F.lit(False)  # to look for a stem anywhere costs far less than the pattern
    for stem in stems:
        there = there | low.contains(stem if isinstance(stem, str) else stem[0])
    return there & low.rlike(rf"{_U}(?<!\w)(?:{pattern})")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def labels(text: Column, lexicon: dict[str, tuple[str | tuple[str, str], ...]]) -> Column:
    """Labels of the lexicon, in its order, with a stem in the text."""
    found = lambda low: F.array(*(F.when(_begins(low, stems), F.lit(label)) for label, stems in lexicon.items()))
    return F.filter(_once(_lower(text), found), lambda x: x.isNotNull())


def triggered(text: Column, more: tuple[str, ...] = ()) -> Column:
    """A trigger anywhere in the text, and no raised price without a reduced one."""

    def said(low: Column) -> Column:
        any_ = F.lit(False)
        for trigger in TRIGGERS + more:
            any_ = any_ | low.contains(trigger)
        return any_ & ~(low.rlike(_U + RAISED) & ~low.rlike(_U + REDUCED))

    return _once(_lower(text), said)


def discount(text: Column, url: Column) -> Column:
    """(kind, value): a percentage, then an amount, both where prices are reduced; then free, for an audience that the text names.

    An amount that is a span of prices is none; a free service or an information page is no free offer.
    """
    low, given = _lower(text), F.coalesce(text, F.lit(""))
    reduced = low.rlike(_U + REDUCED)
    percent, fixed = F.regexp_extract(given, _U + PERCENT, 1), F.regexp_extract(given, _U + FIXED, 1)
    free = F.regexp_replace(low, _U + FREE_SERVICE, " ").rlike(_U + FREE)
    heard = F.size(labels(text, AUDIENCES)) > 0
    info = F.lit(False)
    for token in INFO_PAGES:
        info = info | _lower(url).contains(token)
    out = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    return (
        F.when((percent != "") & reduced, out("percent", percent))
        .when((fixed != "") & reduced & ~low.rlike(_U + PRICE_RANGE), out("fixed", F.regexp_replace(fixed, _U + r"\s", "")))
        .when(free & heard & ~info, out("free", F.lit(None)))
    )


def valid_until(text: Column, default_year: int) -> Column:
    """The day after the leading word, of default_year if it names none; null if there is no such day."""
    day, month, year = (F.regexp_extract(_lower(text), _U + UNTIL, i) for i in (1, 2, 3))
    number = F.when(year != "", year.cast("int"))
    full = F.coalesce(F.when(number < 100, number + 2000).otherwise(number), F.lit(default_year))
    iso = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(day != "", F.try_to_date(iso, "yyyy-MM-dd"))


def headline(text: Column, longest: int = 80) -> Column:
    """First line, of that what ends at an end mark before white space, cut at a word if longer than longest."""
    line = F.regexp_extract(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _U + r"^\s+|\s+$", "")), r"^([^\n\r]*)", 1)
    first = F.regexp_replace(line, _U + r"^(.*?[.!?…])\s.*$", "$1")
    word = F.regexp_replace(F.substring(first, 1, longest), r" [^ ]*$", "")
    cut = F.when(F.length(first) <= longest, first).when(word != "", word).otherwise(F.substring(first, 1, longest))
    return F.regexp_replace(cut, _U + r"^\s+|\s+$", "")


def is_online(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_U + ONLINE)


def locations(locality: Column, local_cities: Column, cities: Column, text: Column) -> Column:
    """Cities of the page's locality, or that itself, then those of the text; without any, online if the text says so."""
    place = F.trim(F.coalesce(locality, F.lit("")))
    own = F.when(F.size(local_cities) > 0, local_cities).when(place != "", F.array(place)).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.array_distinct(F.concat(own, cities)), lambda x: x != "")
    return F.when((F.size(found) == 0) & is_online(text), F.array(F.lit(ONLINE_NAME))).otherwise(found)


def target(links: Column, page: Column) -> Column:
    """The first link to a host that is neither the page's own nor a social one, as source_ref has it."""
    social = F.array(*map(F.lit, SOCIAL))
    own = F.coalesce(urls.bare_host(page), F.lit(""))

    def outside(link: Column) -> Column:
        host = F.coalesce(urls.source_host(link), F.lit(""))
        return (host != "") & (host != own) & ~F.arrays_overlap(urls.host_suffixes(host), social)

    return urls.source_ref(F.try_element_at(F.filter(F.coalesce(links, F.array().cast("array<string>")), outside), F.lit(1)))


def candidate(text: Column, url: Column, provider: Column, site_name: Column, tagline: Column, logo_alt: Column, links: Column, default_year: int) -> Column:
    """The offer of an item, null where it has none: no trigger, or no audience in provider, site name and text."""
    blob = F.concat_ws(" ", provider, F.coalesce(site_name, F.lit("")), text)
    shown = F.trim(F.coalesce(F.when(logo_alt != "", logo_alt), site_name, F.lit("")))
    lead = F.trim(F.coalesce(tagline, F.lit("")))

    def made(b: Column) -> Column:
        audience, found, line = b["audience"], b["found"], b["line"]
        label = F.when(line != "", line)
        one = F.array(F.struct(label.alias("label"), found["kind"].alias("kind"), found["value"].alias("value")))
        offer = F.struct(
            F.when(lead != "", lead).otherwise(line).alias("title"), F.when(shown != "", shown).otherwise(provider).alias("provider"), found["kind"].alias("kind"), found["value"].alias("value"),
            valid_until(text, default_year).alias("valid_until"), content_hash(line, provider, text).alias("content_hash"), urls.origin(url).alias("site_url"), url.alias("article_url"),
            target(links, url).alias("target_url"), audience.alias("audiences"), labels(blob, KINDS).alias("kinds"), F.when(found.isNotNull(), one).otherwise(F.slice(one, 1, 0)).alias("discounts"),
        )
        return F.when(F.size(audience) > 0, offer)

    parts = F.struct(labels(blob, AUDIENCES).alias("audience"), discount(text, url).alias("found"), headline(text).alias("line"))
    return F.when(triggered(text), _once(parts, made))


def page_hash(title: Column, provider: Column, article: Column, discounts: Column) -> Column:
    """The same whatever the order of the discounts (label, kind, value)."""
    part = lambda x: F.coalesce(x, F.lit("None"))
    keys = F.array_sort(F.transform(discounts, lambda d: F.concat_ws("|", part(d["kind"]), part(d["value"]), normalized(d["label"]))))
    return F.sha2(F.concat_ws(" | ", normalized(title), normalized(provider), normalized(article), keys), 256)
