from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import DAY, EV, EVENTS, EVN, HOUR, ITEMS, LI, LIN, WIN, events, items, tall, windows
from stridelake import Stream
from stridelake.operators import joins as J
from stridelake.operators.fusion import fuse_sequential
from stridelake.operators import ordered as O
from stridelake.operators import windows as W
from stridelake.stream import fit_slices

IS_LABEL = "event_type in ('signup', 'purchase')"


def samples_and_labels(spark, d):
    ev = events(spark, d)
    samples = ev.filter(~F.expr(IS_LABEL)).select("user_id", "event_id", "t_us", "value")
    labels = ev.filter(IS_LABEL).select("user_id", F.col("event_id").alias("label_event"), F.col("t_us").alias("label_t"), "event_type")
    return samples, labels


J1 = f"""{EV},
s as (select user_id, event_id, t_us // {DAY} as day, value from ev where not ({IS_LABEL})),
l as (select user_id, event_id as label_event, t_us // {DAY} as day, event_type from ev where {IS_LABEL})"""


def j1_sides(spark, d):
    samples, labels = samples_and_labels(spark, d)
    by_day = lambda c: F.expr(f"{c} div {DAY}").alias("day")
    return (
        samples.select("user_id", "event_id", by_day("t_us"), "value"),
        labels.select("user_id", "label_event", by_day("label_t"), "event_type"),
    )


@query("j1_join_labels_exact", f"with {J1} select * from s left join l using (user_id, day)")
def j1(spark, d):
    return J.join_labels_exact(*j1_sides(spark, d), ["user_id", "day"])


@query(
    "j1_join_labels_exact_filtered",
    f"with {J1} select * from s join l using (user_id, day) where event_type = 'signup'",
)
def j1_filtered(spark, d):
    return J.join_labels_exact(*j1_sides(spark, d), ["user_id", "day"]).filter("event_type = 'signup'")


@query(
    "j2_join_labels_segments",
    f"""with {LIN}, segments as (
          select l_suppkey, day // 365 as part, l_returnflag as activity, min(seq) as start_idx, max(seq) + 1 as end_idx
          from lin group by 1, 2, 3)
        select l_suppkey, seq, part, activity, l_quantity from lin join segments using (l_suppkey)
        where seq >= start_idx and seq < end_idx""",
)
def j2(spark, d):
    rows = O.number_rows(items(spark, d), ITEMS)
    segments = rows.groupBy("l_suppkey", F.expr("day div 365").alias("part"), F.col("l_returnflag").alias("activity")).agg(
        F.min("seq").alias("start_idx"), (F.max("seq") + 1).alias("end_idx")
    )
    joined = J.join_labels_segments(rows.select("l_suppkey", "seq", "l_quantity"), segments, ["l_suppkey"], bucket=128)
    return joined.select("l_suppkey", "seq", "part", "activity", "l_quantity")


NEAREST = f"""{EV},
s as (select user_id, event_id, t_us, value from ev where not ({IS_LABEL})),
l as (select user_id, event_id as label_event, t_us as label_t, event_type from ev where {IS_LABEL}),
p as (select event_id, arg_min(label_event, (abs(t_us - label_t), -label_t)) as label_event
      from s join l using (user_id) group by 1),
aligned as (select s.*, l.event_type, l.label_event, l.label_t as matched_t
            from s join p using (event_id) join l using (label_event))"""


def nearest(spark, d):
    samples, labels = samples_and_labels(spark, d)
    return J.join_nearest(samples, labels, EVENTS, "label_t", ["label_event"], ["event_type", "label_event"])


@query("j3_join_nearest", f"with {NEAREST} select * from aligned")
def j3(spark, d):
    return nearest(spark, d)


@query("j3_join_nearest_fitted", f"with {NEAREST} select * from aligned")
def j3_fitted(spark, d):
    """With slices fitted to the data instead of weeks."""
    samples, labels = samples_and_labels(spark, d)
    return J.join_nearest(
        samples, labels, fit_slices(samples, EVENTS, 32), "label_t", ["label_event"], ["event_type", "label_event"]
    )


@query(
    "j3_join_nearest_ties",
    f"""with {LI},
        l as (select l_suppkey, day as label_day, arg_min(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as l_quantity
              from li where l_returnflag = 'R' group by 1, 2),
        d as (select l_suppkey, day, max(case when l_returnflag = 'R' then day end) as label_day from li group by 1, 2),
        c as (select l_suppkey, day, last_value(label_day ignore nulls) over (partition by l_suppkey order by day) as before,
                     first_value(label_day ignore nulls) over (partition by l_suppkey order by day rows between current row and unbounded following) as after
              from d),
        p as (select l_suppkey, day, case when before is null or after - day <= day - before then after else before end as matched_t from c)
        select li.l_suppkey, li.day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l.l_quantity, matched_t
        from li join p on li.l_suppkey = p.l_suppkey and li.day = p.day
                join l on l.l_suppkey = p.l_suppkey and l.label_day = p.matched_t where l_returnflag <> 'R'""",
)
def j3_ties(spark, d):
    li = items(spark, d)
    columns = ["l_suppkey", "day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    labels = li.filter("l_returnflag = 'R'").select(*columns, "l_quantity").withColumnRenamed("day", "label_day")
    samples = li.filter("l_returnflag <> 'R'").select(*columns)
    return J.join_nearest(samples, labels, ITEMS, "label_day", list(ITEMS.ties), ["l_quantity"])


@query(
    "j4_alignment_error",
    f"""with {NEAREST} select user_id, count(*) as n_rows, round(avg(abs(t_us - matched_t)) / 1e6, 3) as mean_abs_dt,
               max(abs(t_us - matched_t)) as max_abs_dt from aligned group by 1""",
)
def j4(spark, d):
    report = J.alignment_error(nearest(spark, d), "t_us", keys=["user_id"])
    return report.withColumn("mean_abs_dt", F.round(F.col("mean_abs_dt") / F.lit(1e6), 3))


FUSE = f"""{EV},
m as (select *, event_id % 2 as sensor, t_us // {3 * DAY} as label from ev),
f as (select *, case when t_us - lag(t_us) over w < {12 * HOUR} and label = lag(label) over w then 0 else 1 end as fresh
      from m window w as (partition by user_id order by t_us, sensor, event_id)),
g as (select *, cast(sum(fresh) over (partition by user_id order by t_us, sensor, event_id) - 1 as bigint) as session from f),
a as (select *, min(t_us) over (partition by user_id, session) as anchor_t from g),
ticks as (
  select user_id, session, anchor_t, (t_us - anchor_t) // {12 * HOUR} as tick, label,
         avg(value) filter (where sensor = 0) as acc_value, avg(value) filter (where sensor = 1) as gyro_value
  from a group by 1, 2, 3, 4, 5
  having count(*) filter (where sensor = 0) > 0 and count(*) filter (where sensor = 1) > 0)"""


def fused(spark, d):
    ev = events(spark, d).select(
        "user_id", "event_id", "t_us", F.expr(f"t_us div {3 * DAY}").alias("label"), "value"
    )
    parts = [ev.filter(F.col("event_id") % 2 == i) for i in (0, 1)]
    return J.fuse_sensors(*parts, EVENTS, ["value"], "label", 12 * HOUR)


@query(
    "j5_fuse_sensors",
    f"""with {FUSE} select user_id, session, anchor_t, tick, label, round(acc_value, 6) as acc_value,
               round(gyro_value, 6) as gyro_value, anchor_t + tick * {12 * HOUR} as tick_t from ticks""",
)
def j5(spark, d):
    return fused(spark, d).withColumns({c: F.round(c, 6) for c in ("acc_value", "gyro_value")})


@query(
    "j5_fuse_and_window",
    f"""with {FUSE}, i as (
          select *, tick - row_number() over (partition by user_id, session order by tick) as island from ticks),
        p as (select *, row_number() over r - 1 as run_pos, count(*) over (partition by user_id, session, island) as run_n
              from i window r as (partition by user_id, session, island order by tick)),
        w as (select *, run_pos // 3 as window_no from p where (run_pos // 3 + 1) * 3 <= run_n)
        select user_id, session, window_no, min(tick) as first_tick, min(label) as label,
               round(avg(acc_value), 6) as acc_value, round(avg(gyro_value), 6) as gyro_value
        from w group by user_id, session, island, window_no""",
)
def j5_windows(spark, d):
    runs = J.tick_runs(fused(spark, d), EVENTS, 12 * HOUR)
    chunks = W.chunk_runs(runs, EVENTS, 3)
    return W.full_windows(
        chunks, ["user_id", "session", "run_id", "window_no"], 3,
        F.min("tick").alias("first_tick"), F.min("label").alias("label"),
        F.round(F.avg("acc_value"), 6).alias("acc_value"), F.round(F.avg("gyro_value"), 6).alias("gyro_value"),
    ).drop("run_id")


JITTER = f"t_us + (event_id * 7919 % 25 - 12) * {HOUR}"


def sequential_scan(order: str, first_row: str) -> str:
    """The scan as a recursion with state (tag, rows taken of both sensors): a tick per step and user."""
    step = 12 * HOUR
    end = f"{{0}} + coalesce(list_position(list_transform(t{{1}}[{{0}} + 1:], lambda x: abs(x - tag) >= {step}), true) - 1, len(t{{1}}) - {{0}})"
    return f"""with recursive {EV},
h as (select user_id, event_id % 2 as sensor, list(t_us order by {order}) as t, list(event_type order by {order}) as l,
             list(value order by {order}) as v, list(file_row order by {order}) as f
      from (select *, {first_row} as file_row from (select *, {JITTER} as jittered from ev)) group by 1, 2),
n as (select a.user_id, a.t as t0, a.l as l0, a.v as v0, a.f as f0, b.t as t1, b.l as l1, b.v as v1
      from h a join h b on a.user_id = b.user_id and a.sensor = 0 and b.sensor = 1),
scan as (
  select user_id, least(t0[1], t1[1]) as tag, true as fresh, 0::bigint as a, 0::bigint as b,
         null::struct(tick_t bigint, event_type varchar, fresh boolean, first_row bigint, acc_value double, gyro_value double) as tick from n
  union all
  select user_id, case when good then tag + {step} else least(t0[a1 + 1], t1[b1 + 1]) end, not good, a1, b1,
         case when good then {{{{'tick_t': tag, 'event_type': l0[a + 1], 'fresh': fresh, 'first_row': f0[a + 1],
                               'acc_value': list_avg(v0[a + 1:a1]), 'gyro_value': list_avg(v1[b + 1:b1])}}}} end
  from (select *, a1 > a and b1 > b and len(list_distinct(l0[a + 1:a1] || l1[b + 1:b1])) = 1 as good
        from (select *, {end.format("a", 0)} as a1, {end.format("b", 1)} as b1
              from scan join n using (user_id) where a < len(t0) and b < len(t1))))
select user_id, tick.tick_t as tick_t, tick.event_type as event_type, tick.fresh as fresh, tick.first_row as first_row,
       round(tick.acc_value, 6) as acc_value, round(tick.gyro_value, 6) as gyro_value from scan where tick is not null""".replace("{{", "{").replace("}}", "}")


def sequential(spark, d, **options):
    ev = events(spark, d).select("user_id", "event_id", "t_us", "value", "event_type")
    jittered = ev.withColumns({"jittered": F.expr(JITTER), "sensor": F.col("event_id") % 2})
    rows = O.number_rows(jittered, Stream(("user_id", "sensor"), "jittered", ("event_id",), 7 * DAY), seq="file_row").drop("n", "jittered")
    ticks = fuse_sequential(*(rows.filter(F.col("sensor") == i) for i in (0, 1)), EVENTS, ["value"], "event_type", 12 * HOUR, **options)
    return ticks.withColumns({c: F.round(c, 6) for c in ("acc_value", "gyro_value")})


@query("j5_fuse_sequential", sequential_scan("t_us, event_id", "t_us"))
def j5_sequential(spark, d):
    """Tick by tick in the order of time: the anchor moves after every void tick."""
    return sequential(spark, d)


@query("j5_fuse_file_order", sequential_scan("jittered, event_id", "row_number() over (partition by user_id, event_id % 2 order by jittered, event_id) - 1"))
def j5_file_order(spark, d):
    """The same for files whose times go back: ticks hold rows from before their tag."""
    return sequential(spark, d, row="file_row")


HALVES = f"""{EV},
h as (select *, event_id % 2 as sensor,
             row_number() over (partition by user_id, event_id % 2 order by t_us, event_id) - 1 as seq,
             count(*) over (partition by user_id, event_id % 2) as n from ev)"""


def halves(spark, d):
    ev = events(spark, d).select("user_id", "event_id", "t_us", "value")
    return [
        ev.filter(F.col("event_id") % 2 == i).withColumnsRenamed({"value": name, "event_id": f"{name}_id", "t_us": f"{name}_t"})
        for i, name in enumerate(("a", "b"))
    ]


def half_stream(name):
    return Stream(("user_id",), f"{name}_t", (f"{name}_id",), 7 * DAY)


@query(
    "j6_zip_chunks",
    f"""with {HALVES}, w as (select *, seq // 8 as window_no, cast(seq % 8 as integer) as step from h where (seq // 8 + 1) * 8 <= n)
        select a.user_id, a.window_no, a.step, a.event_id as a_id, b.event_id as b_id, a.value as a, b.value as b
        from w a join w b on a.user_id = b.user_id and a.window_no = b.window_no and a.step = b.step
        where a.sensor = 0 and b.sensor = 1""",
)
def j6(spark, d):
    cut = [
        W.tumbling_windows(h, half_stream(name), 8).drop("start_seq", f"{name}_t")
        for h, name in zip(halves(spark, d), ("a", "b"))
    ]
    return J.zip_chunks(*cut, ["user_id", "window_no", "step"])


@query(
    "j7_zip_rows",
    f"""with {HALVES} select a.user_id, a.seq, a.event_id as a_id, b.event_id as b_id, a.value as a, b.value as b
        from h a join h b on a.user_id = b.user_id and a.seq = b.seq where a.sensor = 0 and b.sensor = 1""",
)
def j7(spark, d):
    return J.zip_rows(*halves(spark, d), (half_stream("a"), half_stream("b"))).drop("n", "a_t", "b_t")


@query(
    "j7_length_mismatches",
    f"""with {EV}, c as (select user_id, count(*) filter (where event_id % 2 = 0) as rows_first,
                                count(*) filter (where event_id % 2 = 1) as rows_second from ev group by 1)
        select * from c where rows_first <> rows_second""",
)
def j7_lengths(spark, d):
    return J.length_mismatches(*halves(spark, d), ["user_id"])


NAMES = ["class a", "class b", "class c", "class d", "class e", "class f"]


@query(
    "j8_decode_labels",
    f"select vec_id as window_id, label, coalesce({NAMES!r}[label + 1], cast(label as varchar)) as name from embeddings",
)
def j8(spark, d):
    return J.decode_labels(windows(spark, d).select("window_id", "label"), NAMES, "label")


@query("j9_join_embeddings", f"with {WIN} select * from win")
def j9(spark, d):
    win = windows(spark, d)
    joined = J.join_embeddings(win.select("window_id", "data"), win.select("window_id", "label"))
    return tall(joined, ["window_id", "label"])
