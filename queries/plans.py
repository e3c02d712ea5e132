from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from queries import query
from queries.alignment import FUSE
from queries.views import DAY, EV, EVENTS, EVN, HOUR, events, tall
from stridelake.operators.columns import preset_channels
from stridelake.operators.labels import encode_sorted
from stridelake.operators.metrics import prediction_distribution
from stridelake.operators.ordered import number_rows
from stridelake.plans.log_scoring import predict_log, predict_log_with
from stridelake.plans.recordings import (
    fused_windows,
    gap_free_windows,
    nearest_windows,
    position_windows,
    recording_windows,
    resampled_with_labels,
    segment_windows,
)

NAMES = ["rest", "move"]

CODED = f"""{EVN},
coded as (select *, dense_rank() over (order by event_type) - 1 as label from evn),
blocks as (
  select user_id, (seq * 2 + 1) // 5 as block, avg(value) as value, avg(k) as k,
         cast(sum(t_us) // count(*) as bigint) as t_us, arg_min(label, seq) as label
  from coded where (((seq * 2 + 1) // 5) * 5) // 2 + 3 < n group by 1, 2)"""


@query(
    "plan_resampled_with_labels",
    f"""with {CODED} select user_id, block as seq, count(*) over (partition by user_id) as n, t_us,
               round(value, 6) as value, round(k, 6) as k, label from blocks""",
)
def resampled(spark, d):
    rows = resampled_with_labels(events(spark, d), EVENTS, ["value", "k"], "event_type", 5, 2)
    return rows.withColumns({"value": F.round("value", 6), "k": F.round("k", 6)})


@query(
    "plan_recording_windows",
    f"""with {CODED}, w as (
          select user_id, block // 8 as window_no, block % 8 as step, value, k,
                 count(*) over (partition by user_id, block // 8) as size from blocks),
        first as (select user_id, block // 8 as window_no, arg_min(label, block) as label from blocks group by 1, 2),
        kept as (select * from w join first using (user_id, window_no) where size = 8)
        select user_id, window_no, label, step, 0::bigint as ch, round(cast(value as float)::double, 3) as v from kept
        union all
        select user_id, window_no, label, step, 1::bigint as ch, round(cast(k as float)::double, 3) as v from kept""",
)
def whole(spark, d):
    made = recording_windows(events(spark, d), EVENTS, ["value", "k"], "event_type", 5, 2, 8)
    rows = tall(made, ["user_id", "window_no", "label"])
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 3))


@query(
    "plan_log_predictions",
    f"""with {EVN}, w as (
          select user_id, seq // 8 as window_no, avg(value) as value, avg(k) as k
          from evn where (seq // 8 + 1) * 8 <= n group by 1, 2)
        select case when k > value * 2 then 1 else 0 end as predicted, count(*) as n_rows,
               case when k > value * 2 then 'move' else 'rest' end as name from w group by 1, 3""",
)
def predictions(spark, d):
    """Windows of a log, scored by a function of the caller, to a distribution of names."""

    def fn(x):
        means = x.mean(axis=1)
        means[:, 0] *= 2
        return means

    scored = predict_log_with(events(spark, d), EVENTS, NAMES, fn, ["value", "k"], size=8, hop=8)
    return prediction_distribution(scored, NAMES)


def two_sides(spark, d):
    """Events as a log of two sensors; the right one shows half of the left one."""
    ev = encode_sorted(events(spark, d), "event_type", "kind")
    sources = [F.col("value"), F.col("k"), F.col("value") - F.col("k"), F.col("kind"), F.col("value") * 0.1, F.col("k") * 0.1]
    axes = preset_channels()
    return ev.select(
        *EVENTS.columns, *[s.cast("double").alias(f"left_{a}") for s, a in zip(sources, axes)],
        *[(s * 0.5).cast("double").alias(f"right_{a}") for s, a in zip(sources, axes)],
    )


def by_side(factor):
    return f"""with {EVN}, c as (select *, dense_rank() over (order by event_type) - 1 as kind from evn), w as (
          select user_id, seq // 8 as window_no, {factor}::double * avg(value) as value, {factor}::double * avg(k) as k, {factor}::double * avg(kind) as kind
          from c where (seq // 8 + 1) * 8 <= n group by 1, 2)
        select user_id, window_no, case when k > value * 2 + kind - 3 then 1 else 0 end as predicted,
               case when k > value * 2 + kind - 3 then 'move' else 'rest' end as name from w"""


def side_scores(x):
    """Scores from the channels' means: the first one twice plus the fourth, against the second plus three."""
    means = x.mean(axis=1)
    return np.stack([means[:, 0] * 2 + means[:, 3], means[:, 1] + 3], axis=1)


@query("plan_log_predictions_average", by_side("0.75"))
def average_side(spark, d):
    """Both sides of a log, averaged, to the name of each window."""
    scored = predict_log_with(two_sides(spark, d), EVENTS, NAMES, side_scores, sensor="average", size=8, hop=8)
    return scored.select("user_id", "window_no", "predicted", "name")


@query("plan_log_predictions_right", by_side("0.5"))
def right_side(spark, d):
    scored = predict_log_with(two_sides(spark, d), EVENTS, NAMES, side_scores, sensor="right", size=8, hop=8)
    return scored.select("user_id", "window_no", "predicted", "name")


@query(
    "plan_segment_windows",
    f"""with {EVN}, seg as (
          select user_id, t_us // {10 * DAY} as part, min(seq) as start_idx, max(seq) + 1 as end_idx, cast(t_us // {10 * DAY} % 8 as integer) + 1 as activity
          from evn group by 1, 2, 5),
        r as (select user_id, start_idx, activity, seq - start_idx as i, end_idx - start_idx as len, value, k
              from evn join seg using (user_id) where seq >= start_idx and seq < end_idx and activity <= 6),
        b as (select user_id, start_idx, activity, (i * 2 + 1) // 5 as block, avg(value) as value, avg(k) as k
              from r where (((i * 2 + 1) // 5) * 5) // 2 + 3 < len group by 1, 2, 3, 4),
        c as (select *, count(*) over (partition by user_id, start_idx, activity) as n_blocks from b)
        select user_id, start_idx, activity, block // 3 as window_no, block % 3 as step, ch.i as ch,
               round(cast(case ch.i when 0 then value else k end as float)::double, 3) as v
        from c, range(2) ch(i) where n_blocks > 3 and (block // 3 + 1) * 3 <= n_blocks""",
)
def by_segment(spark, d):
    rows = number_rows(events(spark, d), EVENTS)
    part = F.expr(f"t_us div {10 * DAY}")
    segments = rows.groupBy("user_id", part.alias("part")).agg(
        F.min("seq").alias("start_idx"), (F.max("seq") + 1).alias("end_idx"), (F.first(part % 8) + 1).cast("int").alias("activity"))
    made = segment_windows(rows.drop("n"), segments, ["user_id"], ["value", "k"], "activity", 5, 2, size=3, at_most=6)
    return tall(made, ["user_id", "start_idx", "activity", "window_no"]).withColumn("v", F.round(F.col("v").cast("double"), 3))


@query(
    "plan_position_windows",
    f"""with {EV}, codes as (select * from (values ('click', 0), ('view', 1), ('purchase', 2), ('signup', 3)) t(event_type, label)),
        s as (select user_id, label, value, k, row_number() over w - 1 as seq, count(*) over (partition by user_id, label) as n
              from ev join codes using (event_type) window w as (partition by user_id, label order by t_us, event_id)),
        l as (select user_id, label, 0 as position, value as x, k as y, seq, n from s
              union all select user_id, label, 1, k, value, seq, n from s),
        b as (select user_id, label, position, (seq * 2 + 1) // 5 as block, avg(x) as x, avg(y) as y
              from l where (((seq * 2 + 1) // 5) * 5) // 2 + 3 <= n group by 1, 2, 3, 4),
        c as (select *, count(*) over (partition by user_id, label, position) as n_blocks from b)
        select user_id, label, position, block // 2 as window_no, block % 2 as step, ch.i as ch,
               round(cast(case ch.i when 0 then x else y end as float)::double, 3) as v
        from c, range(2) ch(i) where (block // 2 + 1) * 2 <= n_blocks""",
)
def by_position(spark, d):
    made = position_windows(
        events(spark, d), ["user_id"], EVENTS, [["value", "k"], ["k", "value"]], ["x", "y"], "event_type",
        ["click", "view", "purchase", "signup"], 5, 2, size=2,
    )
    return tall(made, ["user_id", "label", "position", "window_no"]).withColumn("v", F.round(F.col("v").cast("double"), 3))


@query(
    "plan_gap_free_windows",
    f"""with {EV}, lab as (select user_id, t_us, cast(k as integer) % 3 + 1 as label from ev),
        kept as (select ev.*, label from ev join lab using (user_id, t_us) where label in (1, 2)),
        s as (select *, row_number() over (partition by user_id order by t_us, event_id) - 1 as seq,
                     count(*) over (partition by user_id) as n,
                     lag(t_us) over (partition by user_id order by t_us, event_id) as before from kept),
        w as (select *, unnest(range(0, (n - 3) // 2 + 1)) as w from s where n >= 3),
        good as (
          select user_id, w, min(label) - 1 as label, min(t_us) as start_t from w where seq between w * 2 and w * 2 + 2 and w * 2 < n - 1
          group by user_id, w having min(label) = max(label)
             and coalesce(max(t_us - before) filter (where seq > w * 2), 0) < {2 * DAY})
        select user_id, w as window_no, good.label, good.start_t, seq - w * 2 as step, 0::bigint as ch, round(value, 6) + 0 as v
        from w join good using (user_id, w) where seq between w * 2 and w * 2 + 2""",
)
def gap_free(spark, d):
    ev = events(spark, d)
    labels = ev.select("user_id", "t_us", (F.col("k").cast("int") % 3 + 1).alias("label"))
    made = gap_free_windows(ev, labels, ["user_id", "t_us"], EVENTS, ["value"], "label", [1, 2], size=3, hop=2, gap=2 * DAY)
    return tall(made, ["user_id", "window_no", "label", "start_t"]).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(
    "plan_nearest_windows",
    f"""with {EV},
        span as (select user_id, min(t_us) t0, max(t_us) t1 from ev group by 1),
        grid as (
          select user_id, t0 + i * {6 * HOUR} as g
          from (select user_id, t0, unnest(range(0, (2 * (t1 - t0) + {6 * HOUR} + {12 * HOUR} - 1) // {12 * HOUR})) as i
                from span where t1 > t0)),
        picked as (
          select distinct g.user_id, arg_min(e.event_id, (abs(e.t_us - g.g), -e.t_us)) as event_id
          from grid g join ev e on e.user_id = g.user_id group by g.user_id, g.g),
        kept as (
          select e.*, row_number() over (partition by e.user_id order by e.t_us, e.event_id) - 1 as seq,
                 count(*) over (partition by e.user_id) as n from picked join ev e using (event_id)),
        w as (select *, unnest(range(0, (n - 8) // 8 + 1)) as w from kept where n >= 8)
        select user_id, w as window_no, arg_min(event_type, seq) as event_type,
               round(sum(cast(cast(value as float) as double)), 3) as total
        from w where seq between w * 8 and w * 8 + 7 group by 1, 2""",
)
def nearest(spark, d):
    made = nearest_windows(events(spark, d), EVENTS, ["value"], "event_type", size=8, hop=8, step=6 * HOUR)
    cells = F.transform(F.flatten("data"), lambda v: v.cast("double"))
    return made.select(
        "user_id", "window_no", "event_type", F.round(F.aggregate(cells, F.lit(0.0), lambda s, v: s + v), 3).alias("total")
    )


@query(
    "plan_fused_windows",
    f"""with {FUSE}, i as (
          select *, tick - row_number() over (partition by user_id, session order by tick) as island from ticks),
        p as (select *, row_number() over r - 1 as run_pos, count(*) over (partition by user_id, session, island) as run_n
              from i window r as (partition by user_id, session, island order by tick)),
        w as (select *, unnest(range(0, (run_n - 3) // 2 + 1)) as window_no from p where run_n >= 3)
        select user_id, session, window_no, cast(run_pos - window_no * 2 as integer) as step, tick_t, label,
               round(acc_value, 6) as acc_value, round(gyro_value, 6) as gyro_value
        from (select *, anchor_t + tick * {12 * HOUR} as tick_t from w)
        where run_pos between window_no * 2 and window_no * 2 + 2""",
)
def fused(spark, d):
    ev = events(spark, d).select("user_id", "event_id", "t_us", F.expr(f"t_us div {3 * DAY}").alias("label"), "value")
    sensors = [ev.filter(F.col("event_id") % 2 == i) for i in (0, 1)]
    rows = fused_windows(*sensors, EVENTS, ["value"], "label", 12 * HOUR, size=3, overlap=1)
    return rows.select(
        "user_id", "session", "window_no", "step", "tick_t", "label", F.round("acc_value", 6).alias("acc_value"),
        F.round("gyro_value", 6).alias("gyro_value"),
    )
