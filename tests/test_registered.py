"""The functions of SQL give what the column expressions give."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import registered

VALUES = {
    "string": ["http://www.A.ua:80/x/?utm_source=1&b=2&a='q'#f", "Знижка 20% для ветеранів до 31.12.2030. @Shop_1 t.me/xyzw", "<title>a &amp; 'b'</title><a href=\"/u?v\">x</a> and (or) in=(1)", "", None, "../x", "https://spb.shop.com/"],
    "array<string>": [["a", "b"], ["b"], [], None],
    "int": [2030],
}


@pytest.mark.parametrize("name", list(registered.SCALARS))
def test_a_function_is_its_expression(spark, name):
    parameters, make = registered.SCALARS[name]
    kinds = [p.strip().split(" ")[1] for p in re.split(r",(?![^<]*>)", parameters)]
    registered.register(spark, [name])
    rows = [tuple(VALUES[k][(i + 3 * j) % len(VALUES[k])] for j, k in enumerate(kinds)) for i in range(7)]
    frame = spark.createDataFrame(rows, ", ".join(f"c{j} {k}" for j, k in enumerate(kinds)))
    columns = [F.col(f"c{j}") for j in range(len(kinds))]
    assert len(inspect.signature(make).parameters) >= 1
    want, got = frame.select(make(*columns).alias("x")).collect(), frame.selectExpr(f"{name}({', '.join(f'c{j}' for j in range(len(kinds)))}) as x").collect()
    assert got == want


def test_operators_are_quoted_outside_of_literals():
    assert registered._OPERATOR.sub(lambda m: m[0] if m[0].startswith("'") else f"`{m[0]}`", r"and(=(x, 'a=(\'b=('), !(in(y, 'not(', -(1))), rand(1), x -> x)") == r"`and`(`=`(x, 'a=(\'b=('), `!`(`in`(y, 'not(', `-`(1))), rand(1), x -> x)"


def test_rows_of_table_functions(spark):
    registered.register(spark)
    docs = spark.createDataFrame([(1, "Знижка 20% для ветеранів. @Shop_1, t.me/xyzw"), (2, None), (3, "")], "id long, body string")
    found = spark.sql("select d.id, o.kind, o.value from {docs} as d, lateral offers_in(d.body, 'https://a.ua/x', 'Z', 2030) as o", docs=docs).collect()
    assert [tuple(r) for r in found] == [(1, "percent", "20")]
    handles = spark.sql("select d.id, h.type, h.handle from {docs} as d, lateral handles_in(d.body) as h", docs=docs).collect()
    assert sorted(map(tuple, handles)) == [(1, "telegram", "Shop_1"), (1, "telegram", "xyzw")]
