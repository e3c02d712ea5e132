from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import EV, EVENTS, EVN, HOUR, ITEMS, LIN, events, items
from stridelake import Stream
from stridelake.operators import ordered as O
from stridelake.operators import resample as R
from stridelake.stream import fit_slices


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


BLOCKS = "round(avg(value), 6) as value, round(avg(k), 6) as k"


@query("r0_number_rows", f"with {EVN} select user_id, event_id, seq, n from evn")
def r0(spark, d):
    return O.number_rows(events(spark, d).select("user_id", "event_id", "t_us"), EVENTS).drop("t_us")


@query("r0_number_rows_fitted", f"with {EVN} select user_id, event_id, seq, n from evn")
def r0_fitted(spark, d):
    """With slices fitted to the data instead of weeks."""
    rows = events(spark, d).select("user_id", "event_id", "t_us")
    return O.number_rows(rows, fit_slices(rows, EVENTS, 60)).drop("t_us")


@query(
    "r1_block_mean_whole",
    f"with {EVN} select user_id, seq // 3 as block, count(*) as n_rows, {BLOCKS} from evn group by 1, 2",
)
def r1(spark, d):
    return rounded(R.block_mean(events(spark, d), EVENTS, ["value", "k"], 3), "value", "k")


@query(
    "r1b_block_mean_segment",
    f"""with {EVN} select user_id, seq // 3 as block, count(*) as n_rows, {BLOCKS} from evn
        where (seq // 3 + 1) * 3 < n group by 1, 2""",
)
def r1b(spark, d):
    return rounded(R.block_mean(events(spark, d), EVENTS, ["value", "k"], 3, tail="drop_last"), "value", "k")


FRACTION = """with {evn} select user_id, (seq * 2 + 1) // 5 as block, count(*) as n_rows, {blocks}
  from evn where (((seq * 2 + 1) // 5) * 5) // 2 + 3 {op} n group by 1, 2"""


@query("r2_block_mean_fraction", FRACTION.format(evn=EVN, blocks=BLOCKS, op="<"))
def r2(spark, d):
    return rounded(R.block_mean(events(spark, d), EVENTS, ["value", "k"], 5, 2), "value", "k")


@query("r2b_block_mean_fraction_le", FRACTION.format(evn=EVN, blocks=BLOCKS, op="<="))
def r2b(spark, d):
    return rounded(R.block_mean(events(spark, d), EVENTS, ["value", "k"], 5, 2, guard="le"), "value", "k")


@query(
    "r2_block_mean_items",
    f"""with {LIN} select l_suppkey, (seq * 5 + 4) // 37 as block, count(*) as n_rows,
          round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 6) as l_extendedprice
        from lin where (((seq * 5 + 4) // 37) * 37) // 5 + 8 < n group by 1, 2""",
)
def r2_items(spark, d):
    means = R.block_mean(items(spark, d), ITEMS, ["l_quantity", "l_extendedprice"], 37, 5)
    return means.withColumns(
        {"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 6)}
    )


@query(
    "r3_resample_nearest",
    f"""with {EV},
        once as (select * from (select *, row_number() over (partition by user_id, t_us order by event_id) r from ev)
                 where r = 1),
        span as (select user_id, min(t_us) t0, max(t_us) t1 from once group by 1),
        grid as (
          select user_id, t0 + i * {6 * HOUR} as g
          from (select user_id, t0, unnest(range(0, (2 * (t1 - t0) + {6 * HOUR} + {12 * HOUR} - 1) // {12 * HOUR})) as i
                from span where t1 > t0)),
        picked as (
          select g.user_id, arg_min(e.event_id, (abs(e.t_us - g.g), -e.t_us)) as event_id
          from grid g join once e on e.user_id = g.user_id group by g.user_id, g.g)
        select distinct e.user_id, e.event_id, e.t_us, e.value from picked p join once e on e.event_id = p.event_id""",
)
def r3(spark, d):
    return R.resample_nearest(events(spark, d).select("user_id", "event_id", "t_us", "value"), EVENTS, step=6 * HOUR)


@query(
    "r4_infer_rate",
    f"""with {EV}, steps as (
          select user_id, t_us - lag(t_us) over (partition by user_id order by t_us, event_id) as dt from ev)
        select user_id, coalesce(round(86400000000 / median(dt) filter (where dt > 0), 9), 0) as per_day
        from steps group by 1""",
)
def r4(spark, d):
    rates = R.infer_rate(events(spark, d), EVENTS, units_per_second=24 * HOUR, bucket=HOUR)
    return rates.select("user_id", F.round("rate_hz", 9).alias("per_day"))


FILED = Stream(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"), 4096)


@query(
    "r5_keep_increasing",
    f"""with {LIN}, x as (
          select *, lag(day) over (partition by l_suppkey
                                   order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as before from lin)
        select l_suppkey, l_orderkey, l_linenumber, l_partkey, day from x where before is null or day > before""",
)
def r5(spark, d):
    rows = items(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "day")
    return R.keep_increasing(rows, FILED, "day").drop("l_extendedprice")


@query(
    "r6_dedup_times",
    f"""with {LIN} select l_suppkey, day, l_orderkey, l_linenumber, l_partkey, l_quantity from (
          select *, row_number() over (partition by l_suppkey, day
                                       order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) r from lin)
        where r = 1""",
)
def r6(spark, d):
    rows = R.dedup_times(items(spark, d), ITEMS)
    return rows.select("l_suppkey", "day", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "r7_downsample_if_needed",
    f"""with {EVN}, steps as (
          select user_id, t_us - lag(t_us) over (partition by user_id order by t_us, event_id) as dt from ev),
        rates as (
          select user_id, coalesce(86400000000 / median(dt) filter (where dt > 0), 0) as r from steps group by 1),
        ratio as (select user_id, r > 3 as faster,
                         case when r > 3 then greatest(cast(round(r / 3 * 1000) as bigint), 1000) else 1000 end as p
                  from rates),
        x as (select e.*, p, (seq * 1000 + 999) // p as block from evn e join ratio using (user_id))
        select user_id, block, count(*) as n_rows, cast(sum(t_us) // count(*) as bigint) as t_us, {BLOCKS}
        from x where p % 1000 = 0 or (block * p) // 1000 + p // 1000 + 1 < n group by 1, 2""",
)
def r7(spark, d):
    out = R.downsample_if_needed(
        events(spark, d), EVENTS, ["value", "k"], hz_target=3.0, units_per_second=24 * HOUR
    )
    return rounded(out, "value", "k")


@query(
    "r7_downsample_given_rate",
    f"""with {EVN}, x as (select *, 2667 as p, (seq * 1000 + 999) // 2667 as block from evn)
        select user_id, block, count(*) as n_rows, cast(sum(t_us) // count(*) as bigint) as t_us, {BLOCKS}
        from x where (block * p) // 1000 + p // 1000 + 1 < n group by 1, 2""",
)
def r7_given(spark, d):
    """The source's rate is known: 8 a day to 3 a day, a ratio of 2.667."""
    out = R.downsample_if_needed(
        events(spark, d), EVENTS, ["value", "k"], hz_target=3.0, hz_source=8.0, units_per_second=24 * HOUR
    )
    return rounded(out, "value", "k")


@query(
    "r8_resample_report",
    f"""with {EV},
        once as (select user_id, count(*) as rows_in from ev group by 1),
        kept as (select user_id, count(*) as rows_out, (max(t_us) - min(t_us)) / 1e6 as s
                 from ev where event_type <> 'error' group by 1)
        select user_id, rows_in, coalesce(rows_out, 0) as rows_out, round(coalesce(s, 0), 6) as duration_s,
               round(case when s > 0 then (rows_out - 1) / s else 0 end, 12) as rate_hz
        from once left join kept using (user_id)""",
)
def r8(spark, d):
    ev = events(spark, d)
    report = R.resample_report(ev, ev.filter("event_type <> 'error'"), EVENTS)
    return report.withColumns({"duration_s": F.round("duration_s", 6), "rate_hz": F.round("rate_hz", 12)})
