"""The library's column expressions as functions of SQL, for a session: SELECT canonical_url(url) ..., FROM documents, LATERAL offers_in(...).

A function is the text of its expression, so it is inlined and optimised as if it had been written there; no value goes to Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import lexemes, markup, offers, text, urls

#: Tokens of an expression's text: literals, which stay, and names of operators in front of their arguments.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.|'')*'|(?:(?<![\w`])(?:and|or|in|not)|[=!<>+\-*/%&|^~]+)(?=\()")

_none = lambda: F.lit(None).cast("string")


def expression(made: Column) -> str:
    """The text of an expression in SQL; operators are called by their quoted names."""
    shown = str(made)
    return _OPERATOR.sub(lambda m: m[0] if m[0].startswith("'") else f"`{m[0]}`", shown.removeprefix("Column<'").removesuffix("'>"))


#: name: parameters and their types, and what makes the expression of them.
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "source_host": ("url string", urls.source_host),
    "bare_host": ("value string", urls.bare_host),
    "canonical_url": ("url string", urls.canonical_target),
    "source_ref": ("url string", urls.source_ref),
    "resolved_url": ("base string, link string", urls.resolved),
    "aggressor_geo": ("url string", urls.is_aggressor_geo),
    "foreign_host": ("url string", urls.is_foreign),
    "social_handles": ("body string", urls.handles),
    "text_tokens": ("body string", text.tokens),
    "token_similarity": ("a array<string>, b array<string>", text.jaccard),
    "content_hash": ("a string, b string, c string", text.content_hash),
    "romanised": ("name string", lexemes.romanised),
    "page_title": ("html string", markup.title),
    "page_text": ("html string", markup.visible_text),
    "page_links": ("html string", markup.links),
    "page_language": ("html string", markup.language),
    "offer_in": ("body string, url string, provider string, max_year int", lambda body, url, provider, year: offers.candidate(body, url, provider, _none(), _none(), _none(), F.array().cast("array<string>"), year)),
}

#: name: parameters, the columns of its rows, and the rows as a query of scalar functions.
TABLES: dict[str, tuple[str, str, str]] = {
    "offers_in": (
        "body string, url string, provider string, max_year int", "kind string, value string, valid_until date, audiences string, title string, content_hash string",
        "select o.kind, o.value, o.valid_until, array_join(o.audiences, ','), o.title, o.content_hash from (select explode_outer(every) as o from (select array(offer_in(body, url, provider, max_year)) as every)) where o is not null",
    ),
    "handles_in": ("body string", "type string, handle string", "select h.type, h.handle from (select explode_outer(every) as h from (select social_handles(body) as every)) where h is not null"),
}


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Makes temporary functions of the session, all or the named ones; table functions need the scalar ones that they call."""
    made = []
    for name, (parameters, make) in SCALARS.items():
        if names is None or name in names:
            columns = [F.col(p.strip().split(" ")[0]) for p in re.split(r",(?![^<]*>)", parameters)]
            spark.sql(f"create or replace temporary function {name}({parameters}) return {expression(make(*columns))}")
            made.append(name)
    for name, (parameters, columns, rows) in TABLES.items():
        if names is None or name in names:
            spark.sql(f"create or replace temporary function {name}({parameters}) returns table ({columns}) return {rows}")
            made.append(name)
    return made
