"""Queries of whole flows: the search pass, commits with a cursor, writes with outcomes, lemmas and romanised names; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import lexemes
from ..functions import text as T
from ..operators import cadence, mining, outcomes, passes
from ..sources.cursor import cursor_stream
from ..streaming import keyed, streams
from ..streaming.ledger import Ledger
from .arrivals import _ARRIVED, BATCHES, DELAY_HOURS, _arrivals
from .cadence import _DUE
from .queries import c, lit, query

# ---- the search pass ----


@query(f"""{_DUE}, g as (select turn, c_name as phrase, c_custkey % 3 + 1 as page, cast(c_nationkey % 2 as bigint) as dry, n.n from w join customer using (c_custkey), n),
r as (select case when o_orderkey % 2 = 1 then c_name else c_name || '#' || (c_custkey % 3 + case when o_orderkey % 4 = 0 then 1 else 2 end) end as name from orders join customer on c_custkey = o_custkey),
k as (select name, count(*) as k from r group by 1),
f as (select g.*, coalesce(a.k, 0) + coalesce(b.k, 0) as found from g left join k as a on a.name = phrase left join k as b on b.name = phrase || '#' || page)
select phrase, page, cast(found as bigint) as found, case when found > 0 and page < 3 then page + 1 when found > 0 or dry + 1 >= 2 or page >= 3 then 1 else page + 1 end as next_page,
  case when found > 0 or dry + 1 >= 2 or page >= 3 then 0 else dry + 1 end as next_dry, (select case when count(*) >= 90 then (max(turn) + 1 + any_value(n) - 100) % any_value(n) else any_value(n) - 100 end from g) as cursor from f""")
def search_pass(t, spark, sf):
    """One pass over a grid of phrases (customers), whose results are orders, named by phrase or by a page's key."""
    customers = t("customer")
    grid = customers.select(c("c_custkey").alias("position"), c("c_name").alias("phrase"), (c("c_custkey") % 3 + 1).cast("long").alias("page"), (c("c_nationkey") % 2).cast("long").alias("dry"), "c_acctbal")
    key = F.concat(c("c_name"), lit("#"), (c("c_custkey") % 3 + F.when(c("o_orderkey") % 4 == 0, 1).otherwise(2)).cast("string"))
    note = F.when(c("o_orderkey") % 2 == 1, F.concat(lit("first: "), c("c_name"))).otherwise(F.concat(lit("cache: "), key))
    results = t("orders").join(customers, c("o_custkey") == c("c_custkey")).select(note.alias("note"))
    cache = t("orders").select(c("o_orderkey").alias("key"), c("o_orderdate").cast("timestamp").cast("long").alias("at"), (c("o_orderstatus") != "O").alias("harvested"))
    size = customers.count()
    done = passes.search_pass(grid, size - 100, size, 90, ~cadence.fresh(c("c_acctbal"), lit(10000), 4000), cache, lit(996624000), 31536000, results, 3)
    return done.phrases.select("phrase", "page", "found", c("next_page").cast("long").alias("next_page"), c("next_dry").cast("long").alias("next_dry"), done.cursor.scalar().alias("cursor"))


# ---- commits ----


@query(f"""with {_ARRIVED % DELAY_HOURS}, k as (select i as batch, max(m) over (order by i rows between unbounded preceding and 1 preceding) as top from range({BATCHES}) as n(i) left join (select batch, max(click_id) as m from a group by 1) as x on x.batch = i)
select 'u' || client_id as host, count(*) as rejected from a join k using (batch) where kind = 'error' and client_id is not null and (top is null or click_id > top) group by 1""")
def committed_errors(t, spark, sf):
    """Errors of clients behind a cursor over clicks, batch by batch, each batch's counts and cursor in one commit."""
    ledger = Ledger(spark, storage.new_path(spark, "ledger"))

    def step(batch: DataFrame, cursor: object) -> tuple[dict[str, DataFrame], object]:
        new = cadence.since(batch, "click_id", lit(cursor).cast("long"))
        top = new.agg(F.max("click_id")).first()[0]
        errors = new.filter("kind = 'error'").withColumn("host", F.concat(lit("u"), c("client_id").cast("string")))
        return {"rejections": cadence.rejections(errors, "host")}, cursor if top is None else top

    keyed.in_order(_arrivals(t, "click_id", "client_id", "kind"), "batch", BATCHES + 1, lambda s: s, write=ledger.writer(step))
    return ledger.table("rejections", "host string, rejected long").groupBy("host").agg(F.sum("rejected").alias("rejected"))


@query("select o_orderstatus, count(*) as n, max(o_orderkey) as last from orders where o_orderkey > 100 group by 1")
def stream_cursor(t, spark, sf):
    """Orders behind a cursor, read as a stream whose offset is the cursor."""
    rows = cursor_stream(spark, f"{sf}/orders.parquet", "o_orderkey", t("orders").select("o_orderkey", "o_orderstatus").schema, after=100)
    found = streams.drained(rows, "append", storage.shared_folder(spark))
    return found.groupBy("o_orderstatus").agg(F.count(lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


# ---- writes that say what they did ----

_ASKED = "a as (select distinct l_orderkey as o_orderkey from lineitem where l_quantity > 45)"


@query(f"""with i as (select c_custkey + 100 as k from customer), u as (select case when c_custkey is null then 'inserted' when k is null then 'untouched' when c_acctbal < 5000 then 'updated' else 'kept' end as outcome from customer full join i on c_custkey = k),
{_ASKED}, r as (select case when a.o_orderkey is null then 'untouched' when o_orderstatus in ('O', 'P') then 'rejected' else 'refused' end as outcome from orders left join a using (o_orderkey))
select 'upsert' as operation, outcome, count(*) as n from u group by 2 union all select 'reject', outcome, count(*) from r group by 2""")
def outcome_counts(t, spark, sf):
    """What an upsert of customers and a rejection of orders did, counted while they were written."""
    now = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = now.selectExpr("c_custkey + 100 c_custkey", "c_name || '*' c_name", "c_acctbal + 1 c_acctbal")
    _, upserted = outcomes.counted(outcomes.merge(now, new, ["c_custkey"], c("c_acctbal") < 5000), "outcome", ["inserted", "updated", "kept", "untouched"], "customers")
    done, _ = _rejected(t)
    _, rejected = outcomes.counted(done, "outcome", ["rejected", "refused", "untouched"], "orders")
    rows = [("upsert", k, n) for k, n in upserted.items()] + [("reject", k, n) for k, n in rejected.items()]
    return spark.createDataFrame(rows, "operation string, outcome string, n long").filter("n > 0")


def _rejected(t) -> tuple[DataFrame, DataFrame]:
    orders = t("orders").select("o_orderkey", "o_orderstatus", F.concat(lit("c"), c("o_custkey").cast("string")).alias("host"))
    asked = t("lineitem").filter("l_quantity > 45").select(c("l_orderkey").alias("o_orderkey"))
    return outcomes.reject(orders, asked, "o_orderkey", "o_orderstatus", "host", ["O", "P"], rejected="X")


@query(f"""with {_ASKED}, r as (select 'c' || o_custkey as host, o_orderkey, o_orderstatus, a.o_orderkey is not null and o_orderstatus in ('O', 'P') as now from orders left join a using (o_orderkey))
select host, count(*) filter (where now) as n, count(*) filter (where now or o_orderstatus = 'X') as total, max(o_orderkey) filter (where now) as last from r group by 1 having bool_or(now)""")
def rejected_hosts(t, spark, sf):
    return _rejected(t)[1]


# ---- words ----

_LATIN, _CYRILLIC = "abvhgdezyklmnoprstuf", "абвгґдезиклмнопрстуф"


def _roman_sql() -> str:
    out = f"translate(lower(text), '{_LATIN}', '{_CYRILLIC}')"
    for source, target in lexemes.ROMAN:
        out = f"replace({out}, '{source.replace(chr(39), chr(39) * 2)}', '{target}')"
    return f"trim(regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))"


@query(f"select doc_id, {_roman_sql()} as name from documents")
def romanised_texts(t, spark, sf):
    """Texts put into Cyrillic letters by rule, then romanised."""
    return t("documents").select("doc_id", lexemes.romanised(F.translate(F.lower("text"), _LATIN, _CYRILLIC)).alias("name"))


#: A dictionary of half of the words by rule: those on a vowel lose it, on an e become an o, and the last letter tells the part of speech.
_DICTIONARY = r"""v as (select distinct unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as word from documents), w as (select word from v where length(word) >= 3),
d as (select word as form, case when word[-1] = 'e' then word[:-2] || 'o' when word[-1] in ('a', 'i', 'o', 'u') then word[:-2] else word end as lemma, case when word[-1] = 'a' then 'NOUN' when word[-1] in ('e', 'i', 'o', 'u') then 'VERB' else 'ADJ' end as pos,
  case when word[-1] in ('a', 'e', 'i', 'o', 'u') then 1 else 0 end as cut, case when word[-1] = 'e' then 'o' else '' end as more from w where ascii(word) % 2 = 0),
e as (select right(form, n) as ending, cut, more, pos, count(*) as k from (select *, unnest(range(1, least(5, length(form)) + 1)) as n from d) where n >= cut group by 1, 2, 3, 4),
b as (select ending, arg_min({'cut': cut, 'more': more, 'pos': pos}, {'k': -k, 'cut': cut, 'more': more, 'pos': pos}) as x from e group by 1),
u as (select word, unnest(range(1, least(5, length(word)) + 1)) as n from w where ascii(word) % 2 = 1),
j as (select word, arg_max(x, n) as x from u join b on ending = right(word, n) group by 1),
l as (select w.word, coalesce(d.lemma, left(w.word, length(w.word) - x.cut) || x.more, w.word) as lemma, coalesce(d.pos, x.pos) as pos, d.form is not null as known from w left join d on d.form = w.word left join j on j.word = w.word)"""


def _dictionary(t) -> tuple[DataFrame, DataFrame]:
    words = t("documents").select(F.explode(T.words(c("text"))).alias("word")).distinct()
    last, stem = F.right("word", lit(1)), F.expr("left(word, char_length(word) - 1)")
    lemma = F.when(last == "e", F.concat(stem, lit("o"))).when(last.isin("a", "i", "o", "u"), stem).otherwise(c("word"))
    pos = F.when(last == "a", "NOUN").when(last.isin("e", "i", "o", "u"), "VERB").otherwise("ADJ")
    return words, words.filter(F.ascii("word") % 2 == 0).select(c("word").alias("form"), lemma.alias("lemma"), pos.alias("pos"))


@query(f"with {_DICTIONARY} select word, lemma, pos, known from l")
def word_lemmas(t, spark, sf):
    """Lemmas of all words of the texts by a dictionary of half of them; the others by their endings."""
    words, dictionary = _dictionary(t)
    return lexemes.lemmas(words, "word", dictionary)


_NOUNS = rf"""{_DICTIONARY},
p as (select doc_id, unnest(m) as word, unnest(range(len(m))) as p from (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}'']{{{{3,}}}}') as m from documents)),
n as (select doc_id, lemma, p from p join l using (word) where pos = 'NOUN')""".replace("{{", "{").replace("}}", "}")


@query(f"with {_NOUNS}, q as (select doc_id, lemma as term from n union all select doc_id, lemma || ' ' || following from (select doc_id, lemma, lead(lemma) over (partition by doc_id order by p) as following from n) where following is not null) "
       "select term, count(distinct doc_id) as docs, count(*) as n from q group by 1")  # fmt: skip
def noun_terms(t, spark, sf):
    """Lemmas of nouns, and of two nouns in a row, with the texts that have them."""
    terms = lexemes.lemma_terms(t("documents").select("doc_id", "text"), "doc_id", c("text"), _dictionary(t)[1], ["NOUN"])
    return terms.select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count(lit(1)).alias("n"))
