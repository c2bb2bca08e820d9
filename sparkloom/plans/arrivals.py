"""Streams over clicks as they arrive, out of order and late, and the SQL that says what they must leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import keyed
from .queries import _WAITS, c, lit, query

#: Clicks come in five batches, by the day they arrive; the watermark stands DELAY_HOURS behind the latest click so far.
BATCHES, FIRST_DAY, DAYS, DELAY_HOURS = 5, 19723, 24, 2

_BATCH = f"least({BATCHES - 1}, greatest(0, cast(floor((%s - {FIRST_DAY}) / {DAYS}.0) as int)))"

#: b: clicks with their batch, their time ms in milliseconds and the watermark that they meet.
_ARRIVED = f"""a as (select *, {_BATCH % "date_diff('day', date '1970-01-01', cast(arrived_at as date))"} as batch, epoch_us(ts) // 1000 as ms from clicks where ts is not null),
w as (select i as batch, coalesce(max(m) over (order by i rows between unbounded preceding and 1 preceding), 0) as w
  from range({BATCHES + 2}) as n(i) left join (select batch, max(ms) - %d * 3600000 as m from a group by 1 union all select {BATCHES}, 7258118400000) as x on x.batch = i),
b as (select a.*, w from a join w using (batch))"""


def _arrivals(t, *columns: str) -> DataFrame:
    rows = t("clicks").filter("ts is not null")
    day = F.coalesce(F.unix_date(c("arrived_at").cast("date")), lit(FIRST_DAY))
    batch = F.least(lit(BATCHES - 1), F.greatest(lit(0), F.floor((day - FIRST_DAY) / DAYS).cast("int")))
    return keyed.with_end(rows.select("ts", *columns, batch.alias("batch")), "batch", BATCHES, "ts")


def _drained(rows: DataFrame, build, states: int | None = None) -> DataFrame:
    return keyed.in_order(rows, "batch", BATCHES + 1, build, states=states)


_RANGE_HOURS = 120
_RANGES = f"""r as (select client_id, click_id, ms, kind, (ms // {_RANGE_HOURS * 3600000} + 1) * {_RANGE_HOURS * 3600000} <= w as late from b where client_id is not null)"""


@query(f"""with {_ARRIVED % DELAY_HOURS}, {_RANGES},
g as (select client_id, count(*) as n, list_reduce(list_prepend(0.0::double, list(((kind is not distinct from 'purchase')::int - 0.5 * (kind is not distinct from 'error')::int)::double order by ms, click_id)), lambda s, x: greatest(0.0, s * 0.5 + x)) as score from r where not late group by 1)
select client_id, 'standing' as record, n, round(score, 6) as score, null::bigint as click_id from g
union all select client_id, 'late', 1, null, click_id from r where late""")
def stream_keyed_scores(t, spark, sf):
    """Decayed scores of clients, and the clicks that came after their range of time was folded."""
    gain = F.coalesce(c("kind") == "purchase", lit(False)).cast("double") - 0.5 * F.coalesce(c("kind") == "error", lit(False)).cast("double")
    rows = _arrivals(t, "client_id", "click_id", gain.alias("gain"))
    found = _drained(rows, lambda s: keyed.folded(s, "client_id", "ts", "click_id", "gain", keyed.Decayed(0.5), f"{DELAY_HOURS} hours", _RANGE_HOURS), keyed.STATES)
    last = keyed.standing(found).select(c("key").alias("client_id"), lit("standing").alias("record"), "n", F.round("score", 6).alias("score"), lit(None).cast("long").alias("click_id"))
    late = found.filter("record = 'late'").select(c("key").alias("client_id"), "record", "n", lit(None).cast("double").alias("score"), c("tie").alias("click_id"))
    return last.unionByName(late)


@query(f"""with {_ARRIVED % DELAY_HOURS}, {_RANGES.replace("where client_id is not null", "where client_id is not null and kind in ('error', 'purchase')")},
k as (select *, {{'at': ms, 'id': click_id}} as o from r where not late),
o as (select client_id, max(o) filter (where kind = 'purchase') as ok, count(*) as n from k group by 1),
f as (select client_id, count(*) as fails, max(k.ms) / 1000.0::double as t from k join o using (client_id) where kind = 'error' and (ok is null or k.o > ok) group by 1)
select client_id, o.n, coalesce(fails, 0) as fails, coalesce(t + least(60.0 * pow(2.0, fails - 1), 3600.0), 0.0) as cooldown_until,
  case when fails >= 2 then t + 86400.0 else 0.0 end as quarantined_until, case when fails >= 2 then t + 21600.0 else 0.0 end as next_reprobe_at from o left join f using (client_id)""")
def stream_keyed_backoff(t, spark, sf):
    """Failures of clients in a row and what they lead to; a purchase is a success."""
    rows = _arrivals(t, "client_id", F.when(c("kind").isin("error", "purchase"), c("click_id")).alias("click_id"), (c("kind") == "error").cast("double").alias("blocked"))
    found = _drained(rows, lambda s: keyed.folded(s, "client_id", "ts", "click_id", "blocked", keyed.Backoff(**_WAITS), f"{DELAY_HOURS} hours", _RANGE_HOURS), keyed.STATES)
    return keyed.standing(found).withColumnRenamed("key", "client_id")


_TTL_HOURS = 24


@query(f"""with recursive {_ARRIVED % DELAY_HOURS}, r as (select client_id as k, ms, batch, ms + {_TTL_HOURS * 3600000} <= w as late from b where client_id is not null),
g as (select k, w.batch as b, w, mn, mx, n from (select distinct k from r) cross join w left join (select k, batch, min(ms) as mn, max(ms) as mx, count(*) as n from r where not late group by 1, 2) as x using (k, batch)),
s as (select k, b, mn as f, mx as l, coalesce(n, 0) as n, coalesce(n, 0) > 0 as new, null::bigint as ef, null::bigint as el, 0::bigint as en from g where b = 0
  union all select g.k, g.b, case when s.n > 0 and s.l + {_TTL_HOURS * 3600000} > g.w then least(s.f, coalesce(mn, s.f)) else mn end, case when s.n > 0 and s.l + {_TTL_HOURS * 3600000} > g.w then greatest(s.l, coalesce(mx, s.l)) else mx end,
    case when s.n > 0 and s.l + {_TTL_HOURS * 3600000} > g.w then s.n else 0 end + coalesce(g.n, 0), coalesce(g.n, 0) > 0 and not (s.n > 0 and s.l + {_TTL_HOURS * 3600000} > g.w),
    s.f, s.l, case when s.n > 0 and s.l + {_TTL_HOURS * 3600000} <= g.w then s.n else 0 end from s join g on g.k = s.k and g.b = s.b + 1)
select 'first' as record, s.k as client_id, mn as first_seen, mx as last_seen, g.n from s join g on g.k = s.k and g.b = s.b where new
union all select 'ended', k, ef, el, en from s where en > 0 union all select 'late', k, ms, ms, 1 from r where late""")
def stream_seen(t, spark, sf):
    """When clients were first and last seen, when they ended, and the clicks too old to tell."""
    found = _drained(_arrivals(t, "client_id"), lambda s: keyed.seen(s, "client_id", "ts", f"{DELAY_HOURS} hours", _TTL_HOURS))
    return found.select("record", c("key").alias("client_id"), "first_seen", "last_seen", "n")


@query(f"""with {_ARRIVED % DELAY_HOURS}, x as (select kind, w, time_bucket(interval 2 hour, ts) - i * interval 2 hour as start from b, range(3) as n(i))
select start, kind, count(*) as n from x where epoch_ms(start + interval 6 hour) > w group by 1, 2""")
def stream_sliding(t, spark, sf):
    """Counts of kinds in windows of six hours, every two hours, without rows of windows that were over."""
    found = _drained(_arrivals(t, "kind", lit(1).alias("there")), lambda s: keyed.sliding_counts(s, "ts", "6 hours", "2 hours", "kind", f"{DELAY_HOURS} hours"))
    return found.filter("start < timestamp'2199-12-31'").select(c("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query("""with e as (select client_id, ts, case when ts - lag(ts) over (partition by client_id order by ts) < interval 6 hour then 0 else 1 end as new from clicks where ts is not null and client_id is not null),
g as (select *, sum(new) over (partition by client_id order by ts rows unbounded preceding) as s from e)
select client_id, min(ts) as start, max(ts) + interval 6 hour as finish, count(*) as n from g group by client_id, s""")
def stream_sessions(t, spark, sf):
    """Sessions of clients with gaps under six hours; the watermark waits three days and a half, or for the latest click if that is more, so none is late."""
    rows = _arrivals(t, "client_id")
    delay = max(84 * 3_600_000, keyed.latest_ms(rows.filter(c("batch") < BATCHES), "batch", "ts"))
    found = _drained(rows, lambda s: keyed.sessions(s, "ts", "6 hours", "client_id", f"{delay} milliseconds"))
    return found.filter("client_id is not null").select("client_id", c("start").cast("timestamp_ntz").alias("start"), c("finish").cast("timestamp_ntz").alias("finish"), "n")
