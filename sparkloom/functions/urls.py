"""URL columns. Each is a Column expression, so it stays in generated code and its filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING = ("gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "yclid", "msclkid", "twclid", "ttclid", "igshid", "mc_eid", "mc_cid", "_openstat", "vero_id", "oly_enc_id", "oly_anon_id", "icid", "scid", "srsltid", "spm")
PAGINATION = ("page", "start", "offset")
GENERIC_CCTLDS = ("co", "io", "me", "tv", "ai", "cc")
INSTITUTIONAL_TLDS = ("gov", "edu", "mil", "int")
INSTITUTIONAL_SECOND = ("gov", "edu", "mil")
PLATFORMS = ("reddit.com", "kaggle.com", "wikimedia.org", "wikipedia.org", "steamcommunity.com", "steampowered.com", "teamfortress.com", "fliphtml5.com", "trip.com", "quora.com", "medium.com")
NEWS_TOKENS = ("news", "novyny", "gazeta", "visti", "pravda")
RU_CITIES = ("spb", "msk", "mow", "ekb", "nsk", "kzn", "rostov", "sochi", "samara", "perm", "omsk", "ufa", "krasnodar", "volgograd", "voronezh", "tyumen", "irkutsk", "vladivostok", "khabarovsk", "chelyabinsk", "kaliningrad", "saratov", "barnaul", "tomsk", "kemerovo")
BY_CITIES = ("minsk", "gomel", "homel", "brest", "vitebsk", "vitsebsk", "mogilev", "mahilyow", "grodno", "hrodna", "bobruisk", "baranovichi")
RU_BY_TLDS = ("ru", "by", "xn--p1ai", "xn--90ais")
UA_IDN_TLD = "xn--j1amh"

_AUTHORITY = r"^\s*(?i:https?)://([^/?#]*)"


def _strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def authority(url: Column) -> Column:
    """user@host:port of an http(s) URL, else empty."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def source_host(url: Column) -> Column:
    """Host of an http(s) URL, lower case, without www., port and user; else null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(authority(url), r"([^@]*)$", 1)), r":[^:]*$", "")
    return _null_if_empty(_strip_www(host))


def bare_host(value: Column) -> Column:
    """Host of a URL of any scheme or of a bare host; empty if there is none."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    net = F.lower(F.regexp_extract(raw, r"^(?:(?:[^/?#]*:)?//)?([^/?#]*)", 1))
    return _strip_www(F.split_part(F.regexp_extract(net, r"([^@]*)$", 1), F.lit(":"), F.lit(1)))


def origin(url: Column) -> Column:
    """scheme://authority of an http(s) URL, else null."""
    return _null_if_empty(F.lower(F.regexp_extract(url, r"^\s*((?i:https?)://[^/?#]+)", 1)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*(?i:https?)://[^/?#]*([^?#]*)", 1)


def _pairs(url: Column) -> Column:
    """(k, v) of the query, decoded, in order; pairs with a blank value are dropped."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    given = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=.+"))

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    return F.transform(given, lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"), decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(pairs: Column) -> Column:
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def canonical_target(url: Column) -> Column:
    """Identity of an offer page: host and path without scheme, www., trailing slash, tracking and paging; the rest sorted."""
    key = lambda p: F.lower(p["k"])
    kept = F.filter(_pairs(url), lambda p: ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING, *PAGINATION))
    return F.concat(source_host(url), F.rtrim(path(url), F.lit("/")), _query(F.array_sort(kept)))


def source_ref(url: Column) -> Column:
    """Identity of a source page: scheme, authority, path without trailing slash, query without utm_ parameters."""
    kept = F.filter(_pairs(url), lambda p: ~F.lower(p["k"]).startswith("utm_"))
    return F.concat(origin(url), F.rtrim(path(url), F.lit("/")), _query(kept))


def normalized_ref(ref: Column) -> Column:
    """Key of a source reference of any platform."""
    s = F.lower(F.trim(F.coalesce(ref, F.lit(""))))
    for pattern in (r"^https?://", r"^www\.", r"^(t\.me/|instagram\.com/|facebook\.com/)"):
        s = F.regexp_replace(s, pattern, "")
    return F.rtrim(F.ltrim(s, F.lit("@")), F.lit("/"))


def website_key(ref: Column) -> Column:
    """normalized_ref of a website, its mobile host and language folder left out."""
    s = F.regexp_replace(normalized_ref(ref), r"^m\.", "")
    return F.rtrim(F.regexp_replace(s, r"^([^/]+)/(?:en|ru|uk|ua)(/|$)", "$1$2"), F.lit("/"))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: an equality join on these is the match 'equal or a subdomain'."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def is_foreign(value: Column) -> Column:
    host = bare_host(value)
    labels, tld = _labels(host), F.element_at(_labels(host), -1)
    city = (F.size(labels) >= 3) & labels[0].isin(*RU_CITIES)
    code = F.when(tld.startswith("xn--"), tld != UA_IDN_TLD).otherwise((F.length(tld) == 2) & ~tld.isin(*GENERIC_CCTLDS))
    return host.contains(".") & (tld != "ua") & (city | code)


def is_aggressor_geo(value: Column) -> Column:
    host = bare_host(value)
    labels, tld = _labels(host), F.element_at(_labels(host), -1)
    city = (F.size(labels) >= 3) & labels[0].isin(*RU_CITIES, *BY_CITIES)
    segments = F.split(F.lower(F.regexp_extract(value, r"^\s*(?:(?:[^/?#]*:)?//)?[^/?#]*([^?#]*)", 1)), "/")
    inside = F.arrays_overlap(segments, F.array(*map(F.lit, RU_CITIES + BY_CITIES)))
    return host.contains(".") & (tld != "ua") & (tld.isin(*RU_BY_TLDS) | city | inside)


def is_low_value(value: Column) -> Column:
    host = bare_host(value)
    labels = _labels(host)
    second = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit(""))
    listed = F.arrays_overlap(host_suffixes(host), F.array(*map(F.lit, PLATFORMS)))
    return host.contains(".") & (F.element_at(labels, -1).isin(*INSTITUTIONAL_TLDS) | second.isin(*INSTITUTIONAL_SECOND) | listed)


def is_news(value: Column, tokens: tuple[str, ...] = NEWS_TOKENS) -> Column:
    host = bare_host(value)
    return (host != "") & ((F.element_at(_labels(host), -1) == "media") | host.rlike("|".join(tokens)))


def word_start_hit(url: Column, tokens: tuple[str, ...], excluded: tuple[str, ...] = ()) -> Column:
    """A token begins the path or a word of it; an excluded string anywhere in the path wins."""
    text = F.lower(F.coalesce(F.try_url_decode(path(url)), path(url)))
    hit = text.rlike(r"(^|[/\-_.+ ])(" + "|".join(tokens) + ")")
    return hit & ~text.rlike("|".join(excluded)) if excluded else hit


def candidate_type(url: Column) -> Column:
    """Platform of a link, null for those that name no source."""
    host = source_host(url)
    depth = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    social = lambda name: F.when(depth == 1, F.lit(name))
    return F.when(host.isin("t.me", "telegram.me"), social("telegram")).when(host == "instagram.com", social("instagram")).when(host == "facebook.com", social("facebook")).when(host.isNotNull(), F.lit("website"))


def real_host(value: Column) -> Column:
    """bare_host if it looks like one, with a dot; else empty."""
    host = bare_host(value)
    return F.when(host.contains("."), host).otherwise("")


def primary_host(*values: Column) -> Column:
    """The first real host of several values, else null."""
    return F.coalesce(*(_null_if_empty(real_host(v)) for v in values))


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments applied."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(base: Column, link: Column, longest: int = 1024) -> Column:
    """The http(s) URL that a link on the page base leads to, at most so long; null for other schemes."""
    to = F.trim(F.coalesce(link, F.lit("")))
    scheme, at = F.regexp_extract(to, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(F.trim(base), r"^((?i:https?)://[^/?#]*)", 1)
    here, rest = F.regexp_extract(F.trim(base), r"^(?i:https?)://[^/?#]*([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    plain = F.regexp_extract(to, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.when(here == "", F.lit("/")).otherwise(here), r"^(.*/)", 1)
    found = (
        F.when(F.lower(scheme).isin("http", "https"), to)
        .when(scheme != "", F.lit(None))
        .when(at == "", F.lit(None))
        .when(to == "", F.regexp_extract(F.trim(base), r"^([^#]*)", 1))
        .when(to.startswith("//"), F.concat(F.regexp_extract(at, "^([A-Za-z]+:)", 1), to))
        .when(to.startswith("#"), F.concat(F.regexp_extract(F.trim(base), r"^([^#]*)", 1), to))
        .when(to.startswith("?"), F.concat(at, here, to))
        .when(to.startswith("/"), F.concat(at, _without_dots(plain), rest))
        .otherwise(F.concat(at, _without_dots(F.concat(folder, plain)), rest))
    )
    return F.substring(found, 1, longest)


def same_site(url: Column, domain: Column) -> Column:
    """The URL's host is the domain or below it."""
    host, at = bare_host(url), bare_host(domain)
    return (host != "") & ((host == at) | host.endswith(F.concat(F.lit("."), at)))


# Fixed values.
INSTAGRAM_RESERVED = ("/p/", "/reel/", "/reels/", "/explore/", "/stories/")
FACEBOOK_RESERVED = ("/share", "/sharer", "/events", "/photo", "/watch")
FREEMAIL = ("gmail.com", "googlemail.com", "ukr.net", "i.ua", "meta.ua", "bigmir.net", "email.ua", "3g.ua", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "icloud.com", "proton.me", "protonmail.com", "gmx.com")
ALWAYS_BLOCKED = ("gov.ua",)


def source_candidate(url: Column) -> Column:
    """(type, ref) of a search result, null for pages that name no source."""
    ref = source_ref(url)
    host, at = source_host(ref), F.when(path(ref) == "", F.lit("/")).otherwise(path(ref))

    def reserved(prefixes: tuple[str, ...]) -> Column:
        hit = at == "/"
        for prefix in prefixes:
            hit = hit | at.startswith(prefix)
        return hit

    out = lambda kind: F.struct(F.lit(kind).alias("type"), ref.alias("ref"))
    return (
        F.when(host.isin("t.me", "telegram.me"), out("telegram"))
        .when(host == "instagram.com", F.when(~reserved(INSTAGRAM_RESERVED), out("instagram")))
        .when(host.isin("facebook.com", "fb.com"), F.when(~reserved(FACEBOOK_RESERVED), out("facebook")))
        .when(host.isNotNull(), out("website"))
    )


def handles(text: Column) -> Column:
    """(type, handle) of the accounts that a text names, the first spelling of each, type by type."""
    blob = F.coalesce(text, F.lit(""))
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(blob, F.lit(pattern), F.lit(1)), lambda h: F.struct(F.lit(kind).alias("type"), h.alias("handle")))
    every = F.concat(
        found("telegram", r"(?i)(?:https?://)?t\.me/([A-Za-z0-9_]{4,})"),
        found("telegram", r"(?U)(?<![\w/])@([A-Za-z0-9_]{4,})"),
        found("instagram", r"(?i)(?:https?://)?(?:www\.)?instagram\.com/([A-Za-z0-9_.]{2,})"),
        found("facebook", r"(?i)(?:https?://)?(?:www\.)?facebook\.com/([A-Za-z0-9_.]{2,})"),
    )
    lower = lambda x: F.concat_ws(":", x["type"], normalized_ref(x["handle"]))
    # sorted by spelling, the first of each, and then by place again: no pattern is tried once more for each account
    by_name = F.array_sort(F.transform(every, lambda x, i: F.struct(lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda s: F.filter(s, lambda v, i: (i == 0) | (F.get(s, i - 1)["k"] != v["k"]))
    found = F.flatten(F.transform(F.array(by_name), lambda s: F.array_sort(F.transform(first(s), lambda v: F.struct(v["i"].alias("i"), v["x"].alias("x"))))))
    return F.transform(found, lambda v: v["x"])


def mail_hosts(text: Column, links: Column, own: Column) -> Column:
    """Distinct hosts of addresses in the text and in mailto: links, without the own, free-mail and foreign ones."""
    mails = F.transform(F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.lower(x).startswith("mailto:")), lambda x: F.regexp_extract(x, r"(?i)^mailto:([^?]*)", 1))
    blob = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.array_join(mails, " "))
    found = F.array_distinct(F.transform(F.regexp_extract_all(blob, F.lit(r"(?U)[\w.+-]+@([\w-]+\.[\w.-]+)"), F.lit(1)), bare_host))
    return F.filter(found, lambda h: (h != "") & (h != F.coalesce(bare_host(own), F.lit(""))) & ~h.isin(*FREEMAIL) & ~is_foreign(h))
