"""What pages say, as Column expressions over their HTML: text, title, language, metadata, links. No tree is built, so a page is read inside generated
code; what needs to know where an element ends (blocks, posts) is in sources.sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are undone; & comes last, so that nothing is undone twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: What no reader sees.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: What a tag has behind its name; a quoted value may hold a >. Nothing is tried twice, so a tag without an end costs no more than its length.
_INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
#: A tag; one with a quote that does not end goes to the next >.
_TAG = rf"<[A-Za-z/!?]{_INSIDE}|<[A-Za-z/!?][^>]*+>"


def plain(text: Column) -> Column:
    """A text without entities."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def quoted(text: Column) -> Column:
    """A text as it is written in an attribute; plain undoes it."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def shown(html: Column) -> Column:
    """HTML without comments, scripts and styles; a null page is empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def visible_text(html: Column) -> Column:
    """The text of a page, white space collapsed; a tag parts words."""
    return F.trim(F.regexp_replace(plain(F.regexp_replace(shown(html), _TAG, " ")), r"\s+", " "))


def tags(html: Column, name: str) -> Column:
    """The opening tags of one name, in order."""
    return F.regexp_extract_all(shown(html), F.lit(rf"(?i)<{name}(?=[\s>]){_INSIDE}"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag, whichever way it is quoted, without entities; null where it is not there."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    bare = F.regexp_replace(found, "^[\"']|[\"']$", "")
    return F.when(found != "", plain(bare))


def title(html: Column) -> Column:
    """The title, white space collapsed; empty without one."""
    return F.trim(F.regexp_replace(plain(F.regexp_extract(shown(html), r"(?is)<title(?:\s[^>]*)?>([^<]*)", 1)), r"\s+", " "))


def language(html: Column) -> Column:
    """The language that the page names, lower case, without its country; null if it names none."""
    named = attribute(F.try_element_at(tags(html, "html"), F.lit(1)), "lang")
    return F.when(F.trim(named) != "", F.lower(F.split_part(F.trim(named), F.lit("-"), F.lit(1))))


def meta(html: Column, key: str, by: str = "property") -> Column:
    """content of the first meta tag whose property, or another attribute, is the key; null without one."""
    wanted = F.filter(tags(html, "meta"), lambda t: attribute(t, by) == key)
    return attribute(F.try_element_at(wanted, F.lit(1)), "content")


def links(html: Column) -> Column:
    """The addresses of links that are not empty, in order, as they are written."""
    return F.filter(F.transform(tags(html, "a"), lambda t: attribute(t, "href")), lambda h: h != "")


def card(html: Column) -> Column:
    """og:title and og:description, joined by a space: the one item of a page that has either; null without."""
    text = F.concat_ws(" ", *(F.when(F.trim(x) != "", F.trim(x)) for x in (meta(html, "og:title"), meta(html, "og:description"))))
    return F.when(text != "", text)
