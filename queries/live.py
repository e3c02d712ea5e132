from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import DAY, EV, EVENTS, EVN, HOUR, epoch_us, events, table, tall
from stridelake.operators.metrics import decide
from stridelake.operators.ordered import number_rows
from stridelake.functions.batch import score
from stridelake.sources.folders import shared_folder
from stridelake.streaming import batches as B
from stridelake.streaming import live as S

DELAY = "1 day"


def parsed(raw):
    """Rows of the events table; the time cast keeps wall-clock microseconds."""
    return raw.select(
        "user_id", "event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"),
        "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type",
    )


def feed(spark, d, path):
    """A folder of rows of the events table as a stream."""
    return parsed(spark.readStream.schema(table(spark, d, "events").schema).parquet(path))


def ended(spark, d, build):
    """``build`` of the events as a stream that has ended: once they are taken, a last row lets everything open come out."""
    path, out = shared_folder(spark, "feed"), shared_folder(spark, "live")
    rows = table(spark, d, "events")
    for part in (rows, S.end_of_feed(rows, "ts", "30 days")):
        part.write.mode("append").parquet(path)
        df = build(feed(spark, d, path))
        S.run_to_files(df, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def finish(spark, df):
    """Run a stream over all there is and read its output back."""
    out = shared_folder(spark, "live")
    S.run_to_files(df, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("x1_stream_samples", f"with {EV} select event_id, t_us, value, k from ev")
def x1(spark, d):
    """Events as log lines, between comment lines that the ingest leaves out."""
    path = shared_folder(spark, "lines")
    line = F.concat_ws(",", "event_id", "t_us", "value", "k")
    noise = F.concat(F.lit("# "), F.col("event_type"))
    events(spark, d).select(F.explode(F.array(line, noise)).alias("value")).write.text(path)
    return finish(spark, S.stream_samples(spark, path, "event_id bigint, t_us bigint, value double, k double"))


@query(
    "x2_stream_resample",
    f"""with {EV}, b as (
          select user_id, t_us // {6 * HOUR} * {6 * HOUR} as start_us, count(*) as n_rows,
                 round(avg(value), 6) as value, round(avg(k), 6) as k from ev group by 1, 2)
        select * from b""",
)
def x2(spark, d):
    buckets = ended(spark, d, lambda rows: S.stream_resample(rows, ["user_id"], "ts", ["value", "k"], "6 hours", DELAY))
    return buckets.select(
        "user_id", F.unix_micros("bucket_start").alias("start_us"), "n_rows",
        F.round("value", 6).alias("value"), F.round("k", 6).alias("k"),
    )


@query(
    "x3_stream_sessions",
    f"""with {EVN}, f as (
          select *, case when seq = 0 or t_us - lag(t_us) over (partition by user_id order by seq) >= {12 * HOUR}
                         then 1 else 0 end as fresh from evn),
        g as (select *, sum(fresh) over (partition by user_id order by seq) as run_id from f),
        r as (select user_id, run_id, count(*) as n_rows, min(t_us) as first_us, max(t_us) as last_us from g group by 1, 2)
        select user_id, n_rows, first_us, last_us from r""",
)
def x3(spark, d):
    sessions = ended(spark, d, lambda rows: S.stream_sessions(rows, ["user_id"], "ts", 12 * HOUR, DELAY))
    return sessions.select(
        "user_id", "n_rows", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us")
    )


DELIVERIES = 4
#: Weeks go to deliveries in order, and some rows come with a later one.
DELIVERY = f"least(t_us // {91 * DAY} - (1704067200000000 // {91 * DAY}) + case when event_id % 7 = 0 then event_id % 4 else 0 end, {DELIVERIES - 1})"


def deliveries(spark, d):
    """Folders of events as they come in: late rows among them."""
    rows = table(spark, d, "events").withColumn("t_us", epoch_us("ts"))
    number = F.expr(DELIVERY.replace("//", "div"))
    return [rows.filter(number == i).drop("t_us") for i in range(DELIVERIES)]


def admitted(spark, d, closes):
    """Folder of rows in time and late ones, each delivery taken by a run of its own, and a last row."""
    path, out = shared_folder(spark, "feed"), shared_folder(spark, "gate")
    end = S.end_of_feed(table(spark, d, "events"), "ts", "30 days")
    for part in (*deliveries(spark, d), end):
        part.write.mode("append").parquet(path)
        B.admit(feed(spark, d, path), out, f"{out}/_progress", "ts", closes, DELAY).awaitTermination()
    return out, feed(spark, d, path).schema


LATE = f"""{EV},
parts as (select *, {DELIVERY} as part from ev),
marks as (select part, max(max(t_us)) over (order by part rows between unbounded preceding and 1 preceding) - {DAY} as mark from parts group by 1),
gated as (select *, coalesce({{closes}} <= mark, false) as late from parts join marks using (part))"""


@query(
    "x2_stream_resample_late",
    f"""with {LATE.format(closes=f"t_us // {6 * HOUR} * {6 * HOUR} + {6 * HOUR}")}
        select user_id, t_us // {6 * HOUR} * {6 * HOUR} as start_us, late, count(*) as n_rows, round(avg(value), 6) as value
        from gated group by 1, 2, 3""",
)
def x2_late(spark, d):
    """Late rows go to a table of their own: rows in buckets and late rows are the rows of the feed."""
    out, schema = admitted(spark, d, B.bucket_closes("ts", "6 hours"))
    buckets = finish(spark, S.stream_resample(B.accepted(spark, out, schema), ["user_id"], "ts", ["value"], "6 hours", DELAY))
    late = S.stream_resample(B.all_batches(spark, out, "late", schema), ["user_id"], "ts", ["value"], "6 hours", DELAY)
    both = buckets.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("user_id", F.unix_micros("bucket_start").alias("start_us"), "late", "n_rows", F.round("value", 6).alias("value"))


@query(
    "x3_stream_sessions_late",
    f"""with {LATE.format(closes=f"t_us + {12 * HOUR - 1}")},
        f as (select *, case when t_us - lag(t_us) over (partition by user_id order by t_us, event_id) < {12 * HOUR} then 0 else 1 end as fresh
              from gated where not late),
        g as (select *, sum(fresh) over (partition by user_id order by t_us, event_id) as run_id from f)
        select user_id, false as late, count(*) as n_rows, min(t_us) as first_us, max(t_us) as last_us from g group by user_id, run_id
        union all select user_id, true, count(*), min(t_us), max(t_us) from gated where late group by 1""",
)
def x3_late(spark, d):
    out, schema = admitted(spark, d, F.col("ts") + F.expr(f"interval {12 * HOUR - 1} microseconds"))
    sessions = finish(spark, S.stream_sessions(B.accepted(spark, out, schema), ["user_id"], "ts", 12 * HOUR, DELAY))
    late = B.all_batches(spark, out, "late", schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))
    both = sessions.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("user_id", "late", "n_rows", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"))


SCORED = "user_id bigint, window_no bigint, first_order bigint, scores array<double>, predicted int"


def windows_scored(spark, d, parts):
    path, out = shared_folder(spark, "feed"), shared_folder(spark, "windows")

    def scored(windows):
        return decide(score(windows, lambda x: x.mean(axis=1), dtype="float64")).select("user_id", "window_no", "first_order", "scores", "predicted")

    for part in parts:
        part.write.mode("append").parquet(path)
        rows = feed(spark, d, path).withColumn("t_us", F.unix_micros("ts"))
        B.windows_by_arrival(rows, out, f"{out}/_progress", EVENTS, ["value", "k"], size=8, hop=4, then=scored).awaitTermination()
    done = B.all_batches(spark, out, "windows", SCORED)
    late = B.all_batches(spark, out, "late", rows.select("user_id", "t_us", "event_id", "value", "k").schema)
    return done.select("user_id", "window_no", F.col("first_order").alias("first_us"), F.round(F.col("scores")[0], 6).alias("mean_value"), "predicted"), late


WINDOWS_SCORED = """w as (
          select *, unnest(range(0, (n - 8) // 4 + 1)) as w from counted where n >= 8)
        select user_id, w as window_no, min_by(t_us, seq) as first_us, round(avg(value), 6) as mean_value,
               cast(case when avg(value) >= avg(k) then 0 else 1 end as integer) as predicted
        from w where seq between w * 4 and w * 4 + 7 group by 1, 2"""


@query("x4_stream_score", f"with {EVN}, counted as (select * from evn), {WINDOWS_SCORED}")
def x4(spark, d):
    """Windows of a stream, scored by a user function while it runs."""
    return windows_scored(spark, d, [table(spark, d, "events")])[0]


ARRIVED = f"""{EV},
parts as (select *, {DELIVERY} as part from ev),
told as (select *, coalesce(t_us < max(t_us) over (partition by user_id order by part range between unbounded preceding and 1 preceding), false) as late from parts),
counted as (select *, row_number() over (partition by user_id order by part, t_us, event_id) - 1 as seq, count(*) over (partition by user_id) as n
            from told where not late)"""


@query("x4_stream_score_deliveries", f"with {ARRIVED}, {WINDOWS_SCORED}")
def x4_deliveries(spark, d):
    """The same over deliveries, each taken by a run that starts from the checkpoint; windows span them."""
    return windows_scored(spark, d, deliveries(spark, d))[0]


@query("x4_stream_late_rows", f"with {ARRIVED} select user_id, event_id, t_us, value from told where late")
def x4_late(spark, d):
    """Rows that came behind the last one counted."""
    return windows_scored(spark, d, deliveries(spark, d))[1].select("user_id", "event_id", "t_us", "value")


@query(
    "x4_stream_windows_numbered",
    f"""with {EVN}, w as (select *, unnest(range(0, (n - 8) // 4 + 1)) as w from evn where n >= 8)
        select user_id, w as window_no, seq - w * 4 as step, ch.i as ch, case ch.i when 0 then value else k end as v
        from w, range(2) ch(i) where seq between w * 4 and w * 4 + 7""",
)
def x4_numbered(spark, d):
    """Windows of a stream whose rows carry their number; state per window."""
    path = shared_folder(spark, "numbered")
    number_rows(events(spark, d), EVENTS).select("user_id", "seq", "value", "k").write.parquet(path)
    rows = spark.readStream.schema("user_id bigint, seq bigint, value double, k double").parquet(path)
    return tall(
        finish(spark, S.stream_windows_numbered(rows, "user_id", "seq", ["value", "k"], size=8, hop=4)),
        ["user_id", "window_no"],
    )
