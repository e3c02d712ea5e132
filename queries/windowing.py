from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import CHANNELS, DAY, EV, EVENTS, EVN, HOUR, ITEMS, LIN, WIN, events, items, tall, windows, windows_long
from stridelake.operators import resample as R
from stridelake.operators import windows as W
from stridelake.operators.columns import flatten_steps
from stridelake.operators.labels import encode_sorted
from stridelake.stream import largest_slices


@query(
    "w0_largest_slices",
    f"""with {EV} select user_id, cast(t_us // {7 * DAY} as bigint) as slice, count(*) as n_rows from ev group by 1, 2
        order by n_rows desc, user_id, slice limit 10""",
)
def w0(spark, d):
    return largest_slices(events(spark, d), EVENTS, 10).withColumnRenamed("_slice", "slice")


def sliding_sql(view: str, columns: str, size: int, hop: int) -> str:
    return f"""select {columns}, w as window_no, cast(seq - w * {hop} as integer) as step, w * {hop} as start_seq
      from (select *, unnest(range(0, (n - {size}) // {hop} + 1)) as w from {view} where n >= {size})
      where seq between w * {hop} and w * {hop} + {size - 1}"""


@query("w1_sliding_windows", f"with {EVN} " + sliding_sql("evn", "user_id, event_id, value, k", 20, 4))
def w1(spark, d):
    return W.sliding_windows(events(spark, d).select("user_id", "event_id", "t_us", "value", "k"), EVENTS, 20, 4).drop("t_us")


@query("w1_sliding_windows_gaps", f"with {EVN} " + sliding_sql("evn", "user_id, event_id", 5, 7))
def w1_gaps(spark, d):
    return W.sliding_windows(events(spark, d).select("user_id", "event_id", "t_us"), EVENTS, 5, 7).drop("t_us")


@query(
    "w1_sliding_window_features",
    f"""with {LIN} select l_suppkey, window_no, count(*) as n_rows, round(avg(l_quantity), 6) as mean_quantity,
               max(l_extendedprice) as max_price, min(day) as first_day
        from ({sliding_sql("lin", "l_suppkey, l_quantity, l_extendedprice, day", 120, 60)}) group by 1, 2""",
)
def w1_features(spark, d):
    long = W.sliding_windows(items(spark, d), ITEMS, 120, 60)
    return long.groupBy("l_suppkey", "window_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.max("l_extendedprice").alias("max_price"), F.min("day").alias("first_day"),
    )


TUMBLING = """select user_id, event_id, seq // {w} as window_no, cast(seq % {w} as integer) as step,
  (seq // {w}) * {w} as start_seq from evn where n >= {least} and (seq // {w} + 1) * {w} <= n"""


@query("w2_tumbling_windows", f"with {EVN} " + TUMBLING.format(least=8, w=8))
def w2(spark, d):
    return W.tumbling_windows(events(spark, d).select("user_id", "event_id", "t_us"), EVENTS, 8).drop("t_us")


@query("w2_tumbling_windows_strict", f"with {EVN} " + TUMBLING.format(least=57, w=56))
def w2_strict(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "t_us")
    return W.tumbling_windows(rows, EVENTS, 56, min_rows=57).drop("t_us")


@query(
    "w2_assemble_windows",
    f"""with {EVN}, w as (
          select user_id, seq // 8 as window_no, seq % 8 as step, cast(value as float) as value, cast(k as float) as k
          from evn where (seq // 8 + 1) * 8 <= n)
        select user_id, window_no, step, 0::bigint as ch, cast(value as double) as v from w
        union all select user_id, window_no, step, 1::bigint as ch, cast(k as double) as v from w""",
)
def w2_assemble(spark, d):
    long = W.tumbling_windows(events(spark, d), EVENTS, 8)
    made = W.assemble_windows(long, ["user_id", "window_no"], ["value", "k"], first=["event_type"])
    return tall(made, ["user_id", "window_no"]).withColumn("v", F.col("v").cast("double"))


@query(
    "w3_gap_sessions",
    f"""with {EVN}, f as (
          select *, case when seq = 0 or t_us - lag(t_us) over (partition by user_id order by seq) >= {12 * HOUR}
                         then 1 else 0 end as fresh from evn),
        g as (select *, cast(sum(fresh) over (partition by user_id order by seq) - 1 as bigint) as run_id from f)
        select user_id, event_id, seq, run_id, min(seq) over r as run_start, min(t_us) over r as run_start_t,
               seq - min(seq) over r as run_pos
        from g window r as (partition by user_id, run_id)""",
)
def w3(spark, d):
    rows = W.gap_sessions(events(spark, d).select("user_id", "event_id", "t_us"), EVENTS, 12 * HOUR)
    return rows.drop("t_us", "n")


@query(
    "w4_contiguous_windows",
    f"""with {EVN}, f as (
          select *, case when k >= 50 then 2 else 1 end as label,
                 case when seq > 0 and t_us - lag(t_us) over (partition by user_id order by seq) >= {12 * HOUR}
                      then 1 else 0 end as gap from evn),
        w as (select *, unnest(range(0, (n - 4) // 2 + 1)) as w from f where n >= 4)
        select user_id, w as window_no, w * 2 as start_seq, min(t_us) as start_t, max(t_us) as end_t,
               min(label) - 1 as label
        from w where seq between w * 2 and w * 2 + 3 and w * 2 < n - 1 group by user_id, w, n
        having coalesce(sum(gap) filter (where seq > w * 2), 0) = 0 and min(label) = max(label)""",
)
def w4(spark, d):
    rows = events(spark, d).withColumn("label", F.when(F.col("k") >= 50, 2).otherwise(1))
    return W.contiguous_windows(rows, EVENTS, 4, 2, 12 * HOUR, "label")


@query(
    "w4_contiguous_window_data",
    f"""with {EVN}, f as (
          select *, case when k >= 50 then 2 else 1 end as label,
                 case when seq > 0 and t_us - lag(t_us) over (partition by user_id order by seq) >= {12 * HOUR}
                      then 1 else 0 end as gap from evn),
        w as (select *, unnest(range(0, (n - 4) // 2 + 1)) as w from f where n >= 4),
        good as (
          select user_id, w, min(label) - 1 as label from w where seq between w * 2 and w * 2 + 3 and w * 2 < n - 1 group by user_id, w, n
          having coalesce(sum(gap) filter (where seq > w * 2), 0) = 0 and min(label) = max(label))
        select user_id, w as window_no, good.label, seq - w * 2 as step, ch.i as ch, round(case ch.i when 0 then value else k end, 6) + 0 as v
        from w join good using (user_id, w), range(2) ch(i) where seq between w * 2 and w * 2 + 3""",
)
def w4_data(spark, d):
    rows = events(spark, d).withColumn("label", F.when(F.col("k") >= 50, 2).otherwise(1))
    made = W.contiguous_windows(rows, EVENTS, 4, 2, 12 * HOUR, "label", ["value", "k"])
    return tall(made, ["user_id", "window_no", "label"]).withColumn("v", F.round("v", 6) + F.lit(0.0))


LABELLED = f"""{EVN}, coded as (
  select *, dense_rank() over (order by event_type) - 1 as label from evn),
tw as (select user_id, seq // 4 as window_no, seq % 4 as step, label from coded where (seq // 4 + 1) * 4 <= n)"""


def labelled_windows(spark, d):
    rows = encode_sorted(events(spark, d).select("user_id", "event_id", "t_us", "event_type"), "event_type", "label")
    return W.tumbling_windows(rows, EVENTS, 4)


@query(
    "w5_merge_labels_all",
    f"""with {LABELLED} select user_id, window_no, min(label) as label from tw group by 1, 2
        having min(label) = max(label)""",
)
def w5_all(spark, d):
    return W.merge_window_labels(labelled_windows(spark, d), ["user_id", "window_no"], "label", "all")


@query(
    "w5_merge_labels_any",
    f"""with {LABELLED}, s as (
          select user_id, window_no, list_sort(list(distinct label)) as seen from tw group by 1, 2)
        select user_id, window_no,
               case when seen[-1] <= 0 then 0 when len(seen) = 1 then seen[1] else seen[2] end as label from s""",
)
def w5_any(spark, d):
    return W.merge_window_labels(labelled_windows(spark, d), ["user_id", "window_no"], "label", "any")


@query("w5_merge_labels_first", f"with {LABELLED} select user_id, window_no, label from tw where step = 0")
def w5_first(spark, d):
    return W.merge_window_labels(labelled_windows(spark, d), ["user_id", "window_no"], "label", "first")


@query(
    "w6_subwindows",
    f"""with {WIN} select window_id * 2 + step // 6 as piece_id, cast(step % 6 as integer) as step, ch, v from win""",
)
def w6(spark, d):
    long = W.subwindows(windows_long(spark, d), "window_id", 12, 6)
    return long.select("piece_id", "step", F.posexplode(F.array(*CHANNELS)).alias("ch", "v")).withColumn(
        "ch", F.col("ch").cast("bigint")
    )


@query(
    "w6_split_window_array",
    f"with {WIN} select window_id, step // 6 as piece_no, step % 6 as step, ch, v from win",
)
def w6_array(spark, d):
    pieces = W.split_window_array(windows(spark, d).drop("label"), 12, 6)
    return tall(pieces.withColumn("piece_no", F.col("piece_no").cast("bigint")), ["window_id", "piece_no"])


RUNS = f"""{EVN}, f as (
  select *, case when seq = 0 or event_type <> lag(event_type) over (partition by user_id order by seq)
                 then 1 else 0 end as fresh from evn),
g as (select *, cast(sum(fresh) over (partition by user_id order by seq) - 1 as bigint) as run_id from f),
runs as (select user_id, run_id, event_type, min(seq) as start_seq, max(seq) + 1 as end_seq, count(*) as n_rows
         from g group by 1, 2, 3)"""


@query("w7_activity_runs", f"with {RUNS} select * from runs")
def w7(spark, d):
    return W.activity_runs(events(spark, d), EVENTS, "event_type")


@query(
    "w7_first_run",
    f"""with {RUNS} select user_id, event_type, min(start_seq) as start_seq, arg_min(end_seq, start_seq) as end_seq
        from runs where event_type = 'click' group by 1, 2""",
)
def w7_first(spark, d):
    return W.first_run(events(spark, d), EVENTS, "event_type", "click")


@query(
    "w8_chunk_runs",
    f"""with {EVN}, f as (
          select *, case when seq = 0 or t_us - lag(t_us) over (partition by user_id order by seq) >= {16 * HOUR}
                         then 1 else 0 end as fresh from evn),
        g as (select *, cast(sum(fresh) over (partition by user_id order by seq) - 1 as bigint) as run_id from f),
        p as (select *, row_number() over r - 1 as run_pos, count(*) over (partition by user_id, run_id) as run_n
              from g window r as (partition by user_id, run_id order by seq)),
        w as (select *, unnest(range(0, (run_n - 4) // 3 + 1)) as w from p where run_n >= 4)
        select user_id, run_id, w as window_no, min(t_us) as start_t, round(avg(value), 6) as mean_value
        from w where run_pos between w * 3 and w * 3 + 3 group by 1, 2, 3""",
)
def w8(spark, d):
    runs = W.gap_sessions(events(spark, d).select("user_id", "event_id", "t_us", "value"), EVENTS, 16 * HOUR)
    chunks = W.chunk_runs(runs, EVENTS, 4, overlap=1)
    return W.full_windows(
        chunks, ["user_id", "run_id", "window_no"], 4,
        F.min("t_us").alias("start_t"), F.round(F.avg("value"), 6).alias("mean_value"),
    )


@query(
    "w9_snippet",
    f"""with {WIN} select (window_id - 3) * 12 + step as position, window_id, step, ch, v from win
        where window_id >= 3 and window_id < 8""",
)
def w9(spark, d):
    rows = W.snippet(windows(spark, d), "window_id", 3, 5)
    return rows.select("position", "window_id", F.col("step").cast("bigint").alias("step"), F.posexplode("row").alias("ch", "v")).withColumn(
        "ch", F.col("ch").cast("bigint")
    )


@query(
    "w10_head_window",
    f"with {EVN} select user_id, event_id, cast(seq as integer) as step from evn where n >= 60 and seq < 60",
)
def w10(spark, d):
    return W.head_window(events(spark, d).select("user_id", "event_id", "t_us"), EVENTS, 60).drop("t_us")


@query(
    "w11_map_windows",
    f"""with {WIN} select window_id, step, ch, round(v - avg(v) over (partition by window_id, ch), 6) + 0 as v from win""",
)
def w11(spark, d):
    centred = W.map_windows(
        windows(spark, d).select("window_id", "data"), lambda w: w - w.mean(axis=0), "array<array<double>>"
    )
    return tall(centred, ["window_id"]).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(
    "flagship_labelled_windows",
    f"""with {EVN},
        coded as (select *, dense_rank() over (order by event_type) - 1 as label from evn),
        b as (select user_id, (seq * 2 + 1) // 5 as block, avg(value) as value, avg(k) as k,
                     cast(sum(t_us) // count(*) as bigint) as t_us, arg_min(label, seq) as label
              from coded where (((seq * 2 + 1) // 5) * 5) // 2 + 3 < n group by 1, 2),
        c as (select *, row_number() over (partition by user_id order by block) - 1 as seq,
                     count(*) over (partition by user_id) as n from b),
        w as (select user_id, seq // 8 as window_no, list_sort(list(distinct label)) as seen,
                     round(avg(value), 6) as mean_value, round(min(value), 6) as min_value,
                     round(max(value), 6) as max_value, round(avg(k), 6) as mean_k, min(t_us) as start_t
              from c where (seq // 8 + 1) * 8 <= n group by 1, 2)
        select user_id, window_no, mean_value, min_value, max_value, mean_k, start_t,
               case when seen[-1] <= 0 then 0 when len(seen) = 1 then seen[1] else seen[2] end as label from w""",
)
def flagship(spark, d):
    """Events at 5/2 of the target rate to labelled windows of eight with features."""
    from stridelake.plans.recordings import labelled_window_features

    return labelled_window_features(events(spark, d), EVENTS, ["value", "k"], "event_type", p=5, q=2, size=8)
