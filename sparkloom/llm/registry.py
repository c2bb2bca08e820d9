"""Queries of the operators in this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, exact_dedup, fixity, jaccard_join, mixing, packing, panes, pii, quality, spelling, token_counts
from .common import documents


def op1_skip_chain_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica of the audit drill: by a hash of the id, about 1 of 256 pages is cut short and 1 of 256 lost."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(mark == "00", F.concat(F.substring("html", 1, 100), F.lit("?"))).otherwise(F.col("html"))
    return pages.filter(mark != "01").select("page_id", "url", html.alias("html"))


def op2_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixity.audit(pages, damaged(pages))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("row")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row", "copies")


def op10_divideskip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op11_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.panes(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_skip_chain_crf_pii, op2_merkle_fixity_audit, op3_snapshot_collapse, op4_factorisation_machine_quality, op5_transducer_token_counts,
    op6_minhash_containment, op7_bloom_exact_dedup, op8_best_fit_packing, op9_systematic_mixing, op10_divideskip_jaccard, op11_pane_revisions, op12_spelling_variants,
    op13_chunked_bpe,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What four bits do to a CRC-32: the rule c -> c >> 1, with 0xEDB88320 added where the bit that goes is 1, four times.
_NIBBLES = [0]
for _n in range(1, 16):
    _c = _n
    for _ in range(4):
        _c = _c >> 1 ^ 0xEDB88320 * (_c & 1)
    _NIBBLES.append(_c)


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text."""
    halves = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda s: [('0x' || s[2])::bigint, ('0x' || s[1])::bigint]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {halves}), lambda c, b: xor(c >> 4, {_NIBBLES}[(xor(c, b) & 15) + 1])))"


ORACLES = {
    "op2_merkle_fixity_audit": r"""
with r as (
  select page_id, url, html, substr(md5(cast(page_id as varchar)), 1, 2) as mark,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Length: ' || cast(strlen(html) as varchar) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as rec
  from pages)
select page_id, cast(floor(page_id / 4096.0) as bigint) as volume,
  cast(coalesce(sum(strlen(rec)) over (partition by floor(page_id / 4096.0) order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as record_offset,
  cast(strlen(rec) as bigint) as record_length, sha256(rec) as record_sha256, cast(floor(page_id / 64.0) as bigint) as range_id,
  case when mark = '01' then 'missing' when mark = '00' then 'changed' else 'ok' end as status
from r""",
    "op3_snapshot_collapse": """
with c as (
  select conv_id, list(role || chr(31) || text order by turn) as l, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) as rendered
  from conversations group by conv_id)
select conv_id, cast(len(l) as bigint) as n_turns, rendered from c as a
where not exists (select 1 from c as b where (len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l) or (b.l = a.l and b.conv_id < a.conv_id))""",
    "op6_minhash_containment": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k + 4], ' '))) as s from d),
bs as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k + 4], ' '))) as s from i),
q as (select item_id, count(*) as n_item from bs group by 1),
h as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by 1, 2)
select doc_id, item_id, cast(n_shared as bigint) as n_shared, cast(n_item as bigint) as n_item, n_shared / n_item as containment
from h join q using (item_id) where n_shared >= 0.8 * n_item""",
    "op7_bloom_exact_dedup": f"""
with d as (select doc_id, {_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, cast(count(*) over (partition by t) as bigint) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
    "op9_systematic_mixing": r"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    case when source is null then '1' else '0' || source end as skey, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h from documents),
p as (select skey, cast(sum(size) as bigint) as source_size, [5.0, 2.0, 1.0][cast((row_number() over (order by skey) - 1) % 3 + 1 as int)]::double as w from d group by skey),
c as (select *, source_size * 2 as cap, (sum(source_size) over ()) * 1.5::double as total from p),
l as (select *, (total - coalesce(sum(cap) over (order by cap / w, skey rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, skey rows between current row and unbounded following) as level, row_number() over (order by cap / w, skey) as place from c),
f as (select *, cap <= level * w as full_ from l),
t as (select skey, source_size, case when full_ or not exists (select 1 from f where not full_) then cap::double else (select arg_min(level, place) from f where not full_) * w end as target from f),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate, ('0x' || substr(md5(skey), 1, 8))::bigint / 4294967296.0::double as off,
    row_number() over (partition by skey order by lpad(cast(length(bin(size)) as varchar), 2, '0') || substr(bin(size), 1, 3), h, doc_id) as k from d join t using (skey))
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(least(floor(off + rate * k) - floor(off + rate * (k - 1)), 2) as bigint) * cast(size as bigint) as taken from r""",
    "op10_divideskip_jaccard": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, greatest(len(w) - 2, 1)), lambda k: array_to_string(w[k:k + 3], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s as x join s as y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n as na on na.doc_id = a join n as nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, e.b from reach join e on e.a = reach.b)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, (select min(b) from reach where reach.a = d.doc_id) as component_id from d left join n using (doc_id)""",
    "op11_pane_revisions": rf"""
with one as (select click_id, min({{'a': arrived_at, 't': ts, 'k': kind, 'v': value}}) as x from clicks where ts is not null group by click_id),
r as (select click_id, coalesce(x.k, 'none') as kind, cast(epoch_us(x.t) as bigint) as us, coalesce(cast(floor(100 * x.v + 0.5) as bigint), 0) as cents,
    coalesce(date_diff('day', date '1970-01-01', cast(x.a as date)), 0) as d,
    {_crc32("cast(click_id as varchar)")} as h from one),
b as (select click_id, kind, cents, us - (d - d % 12) * 86400000000 as e, cast(least(11, d % 12 + greatest(0, h % 30 - 23)) as bigint) as batch from r),
w as (select i as batch, max(m) over (order by i rows between unbounded preceding and 1 preceding) as w from range(12) as n(i) left join (select batch, max(e) as m from b group by 1) as x on x.batch = i),
p as (select click_id, kind, cents, cast(floor(e / 3600000000.0) as bigint) as hour, batch, coalesce(w >= (floor(e / 3600000000.0) + 73) * 3600000000, false) as late from b join w using (batch)),
s as (select kind, hour, batch, count(*) as n, sum(cents) as c from p where not late group by 1, 2, 3),
g as (select *, sum(n) over q as tn, sum(c) over q as tc, lead(batch) over (partition by kind, hour order by batch) as following from s window q as (partition by kind, hour order by batch)),
due as (select hour, min(w.batch) as due from (select distinct hour from s) as h join w on w.w >= (h.hour + 3) * 3600000000 group by 1),
f as (select g.*, due, case when due is not null then greatest(due, (min(batch) over (partition by kind, hour))) end as first_ from g left join due using (hour))
select batch, 'late' as record, kind, hour, click_id, cast(1 as bigint) as n_rows, cents from p where late
union all select cast(first_ as bigint), 'emit', kind, hour, -1, cast(tn as bigint), cast(tc as bigint) from f where first_ >= batch and (following is null or following > first_)
union all select batch, 'replace', kind, hour, -1, cast(tn as bigint), cast(tc as bigint) from f where batch > first_
union all select batch, 'retract', kind, hour, -1, cast(tn - n as bigint), cast(tc - c as bigint) from f where batch > first_
union all select 11, 'final', kind, hour, -1, cast(tn as bigint), cast(tc as bigint) from f where first_ is null and following is null""",
    "op12_spelling_variants": rf"""
with recursive r as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) as w from documents),
h as (select w, {_crc32("coalesce(cast(doc_id as varchar), '') || ':' || w")} as h from r),
s as (select case when h % 199 = 0 then substr(w, 1, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2) else w end as word from h),
v as (select word, count(*) as n from s where length(word) >= 6 group by 1 having count(*) >= 5),
d as (select word, n, i, substr(word, 1, cast(i as int)) || substr(word, cast(i as int) + 2) as cut from v, unnest(range(length(word))) as u(i)),
p as (select a.word, b.word as other, b.n as m from d as a join d as b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union select d.word, v.word, v.n from d join v on d.cut = v.word
  union select v.word, d.word, d.n from d join v on d.cut = v.word),
b as (select word, count(*) as n_near, arg_min(other, [lpad(cast(1000000000000 - m as varchar), 13, '0'), other]) as form, max(m) as form_n from p group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from v left join b using (word)),
c as (select word, word as root, 0 as step from f union all select c.word, f.form, step + 1 from c join f on f.word = c.root where f.form is not null)
select f.word, f.form, root, cast(n as bigint) as n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n
from f join (select word, arg_max(root, step) as root from c group by 1) using (word)""",
}
