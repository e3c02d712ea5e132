from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import CHANNELS, EV, LI, WIN, events, items, tall, windows
from stridelake.operators import columns as C


@query(
    "p1_select_channels",
    f"with {EV} select event_id, k, value from ev",
)
def p1(spark, d):
    return C.select_channels(events(spark, d), ["k", "value"], expected=2, keep=["event_id"])


@query(
    "p2_preset_channels",
    """select l_orderkey, l_linenumber, l_partkey, l_quantity as left_accel_x, l_extendedprice as left_accel_y,
              l_discount as left_accel_z, l_tax as left_gyro_x, l_quantity * l_discount as left_gyro_y,
              l_quantity * l_tax as left_gyro_z
       from lineitem""",
)
def p2(spark, d):
    names = C.preset_channels("left")
    li = items(spark, d)
    sources = [
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"),
        F.col("l_quantity") * F.col("l_discount"), F.col("l_quantity") * F.col("l_tax"),
    ]
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    named = li.select(*keys, *[s.alias(n) for s, n in zip(sources, names)])
    return C.select_channels(named, names, expected=6, keep=keys)


@query("p3_average_sensors", f"with {EV} select event_id, (value + k) * 0.5 as fused from ev")
def p3(spark, d):
    return C.average_sensors(events(spark, d).select("event_id", "value", "k"), {"fused": ("value", "k")})


@query("p4_scale_channels", f"with {EV} select event_id, value * 9.80665::double as value, k from ev")
def p4(spark, d):
    return C.scale_channels(events(spark, d).select("event_id", "value", "k"), ["value"], C.G_EXACT)


@query(
    "p5_drop_incomplete",
    f"with {EV} select event_id, k, value from ev where event_type <> 'error' and k >= 50",
)
def p5(spark, d):
    gaps = events(spark, d).select(
        "event_id",
        F.when(F.col("k") >= 50, F.col("k")).alias("k"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return C.drop_incomplete(gaps)


@query(
    "p6_filter_labels",
    f"with {EV} select event_id, event_type, value from ev where event_type in ('click', 'view')",
)
def p6(spark, d):
    return C.filter_labels(events(spark, d).select("event_id", "event_type", "value"), "event_type", ["click", "view"])


@query(
    "p6_filter_labels_by_table",
    """select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
       where l_partkey in (select p_partkey from part where p_size <= 10)""",
)
def p6_table(spark, d):
    wanted = spark.read.parquet(f"{d}/part.parquet").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    rows = items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return C.filter_labels(rows, "l_partkey", wanted)


@query(
    "p7_threshold_label",
    f"""with {LI} select l_orderkey, l_linenumber, l_partkey, l_discount,
          case when l_discount = 0 then 1 else 8 end as label_id,
          case when l_discount = 0 then 'speed_zero' else 'speed_nonzero' end as label_text
        from li""",
)
def p7(spark, d):
    return C.threshold_label(items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), "l_discount")


@query(
    "p8_unpivot_positions",
    f"""with {LI}
        select l_orderkey, l_linenumber, l_partkey, 0 as position, l_quantity as x, l_extendedprice as y from li
        union all
        select l_orderkey, l_linenumber, l_partkey, 1 as position, l_discount as x, l_tax as y from li""",
)
def p8(spark, d):
    rows = items(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return C.unpivot_positions(rows, [["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]], ["x", "y"])


@query("p9_truncate_channels", f"with {WIN} select window_id, step, ch, v from win where ch < 3")
def p9(spark, d):
    return tall(C.truncate_channels(windows(spark, d), 3), ["window_id"])


@query(
    "p10_flatten_steps",
    f"""with {WIN} select window_id, label, cast(step as integer) as step,
          {", ".join(f"max(case when ch = {i} then v end) as c{i}" for i in range(6))}
        from win group by 1, 2, 3""",
)
def p10_steps(spark, d):
    return C.flatten_steps(windows(spark, d), CHANNELS)


@query("p10_flatten_window", f"with {WIN} select window_id, step * 6 + ch as place, v from win")
def p10_window(spark, d):
    flat = C.flatten_window(windows(spark, d))
    return flat.select("window_id", F.posexplode("features").alias("place", "v")).withColumn(
        "place", F.col("place").cast("bigint")
    )


KINDS = ("click", "view", "purchase", "signup", "error")


@query(
    "p11_union_samples",
    f"with {EV} select user_id, t_us, value from ev",
)
def p11(spark, d):
    """One part per kind of event, and the rest."""
    ev = events(spark, d)
    parts = [ev.filter(F.col("event_type") == kind).select("user_id", "t_us", "value") for kind in KINDS]
    rest = ev.filter(~F.coalesce(F.col("event_type").isin(*KINDS), F.lit(False))).select("user_id", "t_us", "value")
    return C.union_samples([*parts, rest])
