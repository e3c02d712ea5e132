from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import EV, EVN, PRED, WIN, events, items, predictions, tall, windows
from stridelake.operators.metrics import decide
from stridelake.sources import samples as R
from stridelake.sources import windows as D
from stridelake.sources.catalog import load_catalog
from stridelake.sources.folders import shared_folder


@query("s1_read_samples", f"with {EV} select event_id, t_us, k from ev")
def s1(spark, d):
    """Events as a space-separated log without header; three of its columns."""
    path = shared_folder(spark, "log")
    events(spark, d).write.option("sep", " ").option("header", False).csv(path)
    schema = "user_id bigint, event_id bigint, t_us bigint, value double, k double, event_type string"
    return R.read_samples(spark, path, schema, sep=" ", header=False, columns=["event_id", "t_us", "k"], drop_malformed=True)


@query("s2_path_keys", f"with {EV} select event_id, value, event_type as activity from ev")
def s2(spark, d):
    path = shared_folder(spark, "trials")
    rows = events(spark, d).select("event_id", "value", "event_type")
    rows.write.partitionBy("event_type").option("header", True).csv(path)
    return R.read_samples(
        spark, f"{path}/*", "event_id bigint, value double", path_keys={"activity": ("event_type=([a-z]+)/", "string")},
        drop_malformed=True,
    )


@query("s3_read_labels", f"with {EV} select t_us, event_type, cast(null as varchar) as _malformed from ev")
def s3(spark, d):
    path = shared_folder(spark, "labels")
    labels = events(spark, d).select("user_id", "t_us", "event_type", "k")
    labels.write.option("sep", " ").csv(path)
    return R.read_labels(
        spark, path, "user_id bigint, t_us bigint, event_type string, k double", columns=["t_us", "event_type"]
    )


@query(
    "s4_write_samples_csv",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from lineitem",
)
def s4(spark, d):
    path = shared_folder(spark, "flat")
    rows = items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    R.write_samples_csv(rows, path, sep=";")
    return R.read_samples(spark, path, rows.schema, sep=";", drop_malformed=True)


@query("s5_window_dataset", f"with {WIN} select window_id, label, step, ch, round(v, 6) + 0 as v from win")
def s5(spark, d):
    path = shared_folder(spark, "windows")
    D.write_windows(windows(spark, d), path, "vectors", 20, 12, 12)
    D.write_windows(windows(spark, d, 8, 9), path, "vectors", 20, 8, 8)
    back = D.read_windows(spark, path, dataset="vectors", rate_hz=20, window=12)
    return tall(back, ["window_id", "label"]).withColumn("v", F.round(F.col("v").cast("double"), 6) + F.lit(0.0))


@query("s5_window_versions", f"with {WIN} select window_id, label, step, ch, round(case when window_id % 2 = 0 then v * 2 else v end, 5) + 0 as v from win")
def s5_versions(spark, d):
    """One version written twice, the second time in two parts, beside another: the first rows are gone, the other set stays."""
    path = shared_folder(spark, "windows")
    made = windows(spark, d)
    doubled = made.withColumn("data", F.transform("data", lambda row: F.transform(row, lambda v: v * 2)))
    D.write_windows(made, path, "vectors", 20, 12, 12)
    D.write_windows(windows(spark, d, 8, 9), path, "vectors", 20, 8, 8)
    D.write_windows(doubled.filter("window_id % 2 = 0"), path, "vectors", 20, 12, 12)
    D.write_windows(made.filter("window_id % 2 = 1"), path, "vectors", 20, 12, 12, mode="append")
    back = D.read_windows(spark, path, dataset="vectors", rate_hz=20, window=12)
    return tall(back, ["window_id", "label"]).withColumn("v", F.round(F.col("v").cast("double"), 5) + F.lit(0.0))


@query(
    "s7_write_predictions",
    f"with {PRED} select window_id, label, predicted from pred",
)
def s7(spark, d):
    path = shared_folder(spark, "predictions")
    D.write_predictions(decide(predictions(spark, d)).select("window_id", "label", "predicted"), path)
    return spark.read.parquet(path).select("window_id", "label", "predicted")


@query(
    "s8_load_catalog",
    f"""with {EV}, c as (
          select event_type, count(*) as size, count(distinct user_id) as users, list_sort(list(distinct floor(k / 50)::int::varchar)) as names
          from ev group by 1)
        select event_type || '_log' as dataset, '20_8' as version, 20 as rate_hz, 8 as "window", 2 as dimension, size, 'activity' as kind, 0 as label_index,
               len(names)::integer as label_size, array_to_string(names, ',') as names from c
        union all select event_type || '_log', '20_8', 20, 8, 2, size, 'user', 1, users::integer, null from c""",
)
def s8(spark, d):
    """A catalog of one window set per kind of event, written as JSON and read back by label kind."""
    path = shared_folder(spark, "catalog")
    names = F.array_sort(F.collect_set(F.floor(F.col("k") / 50).cast("int").cast("string")))
    sets = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("user_id").alias("users"), names.alias("names"))
    entry = F.struct(
        F.lit(20).alias("sr"), F.lit(8).alias("seq_len"), F.lit(2).alias("dimension"), "size", F.lit(0).alias("activity_label_index"),
        F.size("names").alias("activity_label_size"), F.col("names").alias("activity_label"), F.lit(1).alias("user_label_index"),
        F.col("users").cast("int").alias("user_label_size"),
    )
    whole = sets.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat("event_type", F.lit("_log_20_8")), entry)))).alias("value"))
    whole.coalesce(1).write.text(path)
    return load_catalog(spark, path).withColumn("names", F.array_join("names", ","))


@query(
    "l7_label_kind",
    f"""with {EV} select event_type || '_log' as dataset, count(distinct user_id)::integer as label_size from ev group by 1""",
)
def l7(spark, d):
    """The kind named ``user`` of every set, wherever it stands among the set's kinds."""
    return s8(spark, d).filter("kind = 'user'").select("dataset", "label_size")
