from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import EV, EVN, WIN, events, windows, windows_long
from stridelake.operators import labels as L
from stridelake.operators.joins import decode_labels

KINDS = ["click", "view", "error", "purchase"]


def typed(spark, d):
    return events(spark, d).select("event_id", "t_us", "event_type")


@query(
    "l1_encode_sorted",
    f"with {EV} select event_id, event_type, dense_rank() over (order by event_type) - 1 as event_type_id from ev",
)
def l1(spark, d):
    return L.encode_sorted(typed(spark, d).drop("t_us"), "event_type")


@query(
    "l1_encode_sorted_large",
    "select s_suppkey, s_name, dense_rank() over (order by s_name) - 1 as s_name_id from supplier",
)
def l1_large(spark, d):
    names = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    return L.encode_sorted(names, "s_name")


@query(
    "l3_encode_first_seen_large",
    """with o as (select o_orderkey, o_custkey::varchar as o_custkey from orders), f as (select o_custkey, min(o_orderkey) as first from o group by 1),
            c as (select o_custkey, row_number() over (order by first, o_custkey) as o_custkey_id from f)
       select o_orderkey, o_custkey, o_custkey_id from o join c using (o_custkey)""",
)
def l3_large(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    return L.encode_first_seen(orders, "o_custkey", ["o_orderkey"])


@query(
    "l2_encode_vocab",
    f"""with {EV} select event_id, event_type, nullif(list_position({KINDS!r}, event_type), 0) - 1 as event_type_id
        from ev""",
)
def l2(spark, d):
    return L.encode_vocab(typed(spark, d).drop("t_us"), "event_type", KINDS)


@query(
    "l2_encode_vocab_prefix",
    f"""with {EV} select event_id, event_type,
          case when event_type like 'cl%' then 0 when event_type like 'vi%' then 1 when event_type like 'err%' then 2 end
            as event_type_id from ev""",
)
def l2_prefix(spark, d):
    return L.encode_vocab(typed(spark, d).drop("t_us"), "event_type", ["cl", "vi", "err"], match="prefix")


@query(
    "l2_unknown_labels",
    f"with {EV} select event_type, count(*) as n_rows from ev where event_type not in ('click', 'view') group by 1",
)
def l2_unknown(spark, d):
    return L.unknown_labels(L.encode_vocab(typed(spark, d), "event_type", ["click", "view"]), "event_type")


@query(
    "l3_encode_first_seen",
    f"""with {EV}, f as (select event_type, min((t_us, event_id)) as first_at from ev group by 1),
        c as (select event_type, row_number() over (order by first_at) as event_type_id from f)
        select event_id, event_type, event_type_id from ev join c using (event_type)""",
)
def l3(spark, d):
    return L.encode_first_seen(typed(spark, d), "event_type", ["t_us", "event_id"]).drop("t_us")


@query(
    "l4_zero_base",
    """select vec_id as window_id, label - (select min(label) from embeddings) as label,
              vec_id % 7 - (select min(vec_id % 7) from embeddings) as user from embeddings""",
)
def l4(spark, d):
    rows = windows(spark, d).select("window_id", "label", (F.col("window_id") % 7).alias("user"))
    return L.zero_base(rows, ["label", "user"])


@query(
    "l5_composite_label",
    "select vec_id as window_id, label * 10 + vec_id % 7 as composite from embeddings",
)
def l5(spark, d):
    rows = windows(spark, d).select("window_id", "label", (F.col("window_id") % 7).alias("user"))
    return L.composite_label(rows, ["label", "user"]).select("window_id", "composite")


@query(
    "l6_resolve_label",
    "select vec_id as window_id, label from embeddings where label = 3",
)
def l6(spark, d):
    wanted = L.resolve_label(["class a", "class b", "class c", "class d"], "class d")
    return windows(spark, d).select("window_id", "label").filter(F.col("label") == wanted)


@query("l8_window_label", "select vec_id as window_id, label from embeddings")
def l8(spark, d):
    return L.window_label(windows_long(spark, d), ["window_id"], "label")
