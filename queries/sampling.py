from __future__ import annotations

from pyspark.sql import functions as F

from queries import query
from queries.views import EV, EVENTS, WIN, events, windows
from stridelake.operators import labels as L
from stridelake.operators import sampling as S

SEED = 5
RANKED = f"""ranked as (
  select vec_id as window_id, label, row_number() over (order by md5('{SEED}:' || vec_id), vec_id) - 1 as rank,
         count(*) over () as total from embeddings)"""
SPLIT = f"""{RANKED},
parts as (
  select window_id, label,
         case when rank < floor(total * 0.8::double) then 'train'
              when rank < floor(total * 0.8::double) + floor(total * 0.1::double) then 'vali' else 'test' end as split
  from ranked)"""


def rows(spark, d):
    return windows(spark, d).select("window_id", "label")


@query("t1_shuffle", f"with {RANKED} select window_id, label, rank as position from ranked")
def t1(spark, d):
    return S.shuffle(rows(spark, d), "window_id", SEED)


@query("t2_split", f"with {SPLIT} select * from parts")
def t2(spark, d):
    return S.split(rows(spark, d), "window_id", SEED)


@query(
    "t2_split_items",
    f"""with r as (
          select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                 concat_ws('-', l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice * 100) as bigint)) as id
          from lineitem),
        ranked as (select *, row_number() over (order by md5('{SEED}:' || id), id) - 1 as rank, count(*) over () as total from r)
        select id, case when rank < floor(total * 0.8::double) then 'train'
                        when rank < floor(total * 0.8::double) + floor(total * 0.1::double) then 'vali'
                        else 'test' end as split from ranked""",
)
def t2_items(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    named = li.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("id")
    )
    return S.split(named, "id", SEED)


@query(
    "t2_split_fast",
    f"""with u as (select vec_id as window_id, label,
                          ('0x' || substr(md5('{SEED}:' || vec_id), 1, 8))::bigint / 4294967296.0::double as u from embeddings)
        select window_id, label, case when u < 0.8::double then 'train' when u < 0.8::double + 0.1::double then 'vali'
                                      else 'test' end as split from u""",
)
def t2_fast(spark, d):
    return S.split_fast(rows(spark, d), "window_id", SEED)


@query("t3_pretrain_split", f"with {SPLIT} select * from parts where split <> 'test'")
def t3(spark, d):
    return S.pretrain_split(rows(spark, d), "window_id", SEED)


@query(
    "t4_sample_labelled",
    f"with {RANKED} select window_id, label, rank < floor(total * 0.05::double) as labelled from ranked",
)
def t4(spark, d):
    return S.sample_labelled(rows(spark, d), "window_id", 0.05, SEED)


QUOTA = """counts as (select label, count(*) as c from embeddings group by 1),
quota as (select least(min(c), cast(floor(sum(c) * {rate}::double / count(*)) as bigint)) as quota, min(c) as smallest,
                 count(*) as n_classes, cast(sum(c) as bigint) as n_rows from counts)"""


@query(
    "t5_sample_balanced",
    f"""with {QUOTA.format(rate=0.2)},
        r as (select vec_id as window_id, label,
                     row_number() over (partition by label order by md5('{SEED}:' || vec_id), vec_id) as r from embeddings)
        select window_id, label, r <= quota as labelled from r, quota""",
)
def t5(spark, d):
    return S.sample_balanced(rows(spark, d), "window_id", "label", 0.2, SEED)


@query(
    "t5_balanced_quota",
    f"""with {QUOTA.format(rate=0.95)}
        select n_rows, n_classes, smallest, quota, quota = smallest as uses_all_of_smallest from quota""",
)
def t5_quota(spark, d):
    return S.balanced_quota(rows(spark, d), "label", 0.95)


@query(
    "t5_balanced_report",
    f"""with {QUOTA.format(rate=0.2)}
        select quota * n_classes as labelled_rows, n_rows - quota * n_classes as unlabelled_rows,
               (quota * n_classes)::double / n_rows as label_rate from quota""",
)
def t5_report(spark, d):
    return S.balanced_report(S.sample_balanced(rows(spark, d), "window_id", "label", 0.2, SEED))


@query(
    "t5_sample_balanced_events",
    f"""with c as (select event_type, count(*) as c from events group by 1),
        q as (select least(min(c), cast(floor(sum(c) * 0.1::double / count(*)) as bigint)) as quota from c),
        r as (select event_id, event_type,
                     row_number() over (partition by event_type order by md5('{SEED}:' || event_id), event_id) as r from events)
        select event_id, event_type from r, q where r <= quota""",
)
def t5_events(spark, d):
    kinds = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return S.sample_balanced(kinds, "event_id", "event_type", 0.1, SEED).filter("labelled").drop("labelled")


@query("t6_label_counts", "select label, count(*) as n_rows from embeddings group by 1")
def t6(spark, d):
    return L.label_counts(rows(spark, d), "label")


@query(
    "t7_take_random",
    f"""select vec_id as window_id, label from embeddings order by md5('{SEED}:' || vec_id), vec_id limit 100""",
)
def t7(spark, d):
    return S.take_random(rows(spark, d), "window_id", 100, SEED)


PREPARED = f"""{SPLIT},
pieces as (
  select window_id * 2 + t.i as piece_id, split, cast(label - (select min(label) from parts) as integer) as label
  from parts, range(2) t(i)),
train as (select *, row_number() over (partition by label order by md5('{SEED}:' || piece_id), piece_id) as r
          from pieces where split = 'train'),
c as (select label, count(*) as c from train group by 1),
q as (select least(min(c), cast(floor(sum(c) * 0.1::double / count(*)) as bigint)) as quota from c)"""


@query(
    "t8_prepare_classifier_data",
    f"""with {PREPARED}, {WIN}, sums as (select window_id * 2 + step // 6 as piece_id, round(sum(v), 5) + 0 as total from win group by 1),
        flags as (select piece_id, split, label, true as labelled from pieces where split <> 'train'
                  union all select piece_id, split, label, r <= quota as labelled from train, q)
        select * from flags join sums using (piece_id)""",
)
def t8(spark, d):
    from stridelake.plans.training import prepare_classifier_data

    prepared = prepare_classifier_data(
        windows(spark, d), "window_id", "label", size=12, piece=6, label_rate=0.1, balance=True, seed=SEED
    )
    total = F.aggregate(F.flatten("data"), F.lit(0.0), lambda s, v: s + v)
    return prepared.select("piece_id", "split", "label", "labelled", (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query(
    "t8_prepare_event_windows",
    f"""with {EV}, n as (
          select *, row_number() over (partition by user_id order by t_us, event_id) - 1 as seq,
                 count(*) over (partition by user_id) as n, dense_rank() over (order by event_type) - 1 as code from ev),
        w as (select user_id * 1000 + seq // 8 as window_id, seq % 8 as step, code from n where (seq // 8 + 1) * 8 <= n),
        ids as (select distinct window_id from w),
        k as (select window_id, row_number() over (order by md5('{SEED}:' || window_id), window_id) - 1 as rank,
                     count(*) over () as total from ids),
        s as (select window_id, case when rank < floor(total * 0.8::double) then 'train'
                     when rank < floor(total * 0.8::double) + floor(total * 0.1::double) then 'vali' else 'test' end as split
              from k),
        p as (select window_id * 4 + step // 2 as piece_id, split, min(code) as label
              from w join s using (window_id) group by 1, 2 having min(code) = max(code)),
        t as (select *, row_number() over (order by md5('{SEED}:' || piece_id), piece_id) - 1 as rank, count(*) over () as total
              from p where split = 'train')
        select piece_id, split, label, rank < floor(total * 0.2::double) as labelled from t
        union all select piece_id, split, label, true as labelled from p where split <> 'train'""",
)
def t8_events(spark, d):
    from stridelake.operators.windows import tumbling_windows
    from stridelake.plans.training import prepare_label_windows

    coded = L.encode_sorted(events(spark, d).select("user_id", "event_id", "t_us", "event_type"), "event_type", "label")
    long = tumbling_windows(coded, EVENTS, 8).select(
        (F.col("user_id") * 1000 + F.col("window_no")).alias("window_id"), "step", "label"
    )
    return prepare_label_windows(long, "window_id", "label", size=8, piece=2, label_rate=0.2, balance=False, seed=SEED)
