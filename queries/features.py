from __future__ import annotations

import math

from pyspark.sql import functions as F

from queries import query
from queries.views import WIN, tall, windows
from stridelake.functions import features as X

SEED = 7
NINE = """nine as (
  select vec_id as window_id, t.i // 9 as step, t.i % 9 as ch, coalesce(cast(embedding[t.i + 1] as double), 0) as v
  from embeddings, range(72) t(i))"""


def rounded(df, *keys):
    return tall(df, list(keys) or ["window_id"]).withColumn("v", F.round("v", 6) + F.lit(0.0))


def plain(spark, d, steps=12, channels=6):
    return windows(spark, d, steps, channels).select("window_id", "data")


@query(
    "f1_normalize_six",
    f"with {WIN} select window_id, step, ch, round(case when ch < 3 then v / 9.8 else v end, 6) + 0 as v from win",
)
def f1_six(spark, d):
    return rounded(X.normalize(plain(spark, d), 6))


@query(
    "f1_normalize_nine",
    f"""with {NINE}, norms as (
          select window_id, step, sqrt(sum(v * v)) + 1e-5 as norm from nine where ch >= 6 group by 1, 2)
        select window_id, step, ch,
               round(case when ch < 3 then v / 9.8 when ch >= 6 then v / norm * 2 else v end, 6) + 0 as v
        from nine join norms using (window_id, step)""",
)
def f1_nine(spark, d):
    return rounded(X.normalize(plain(spark, d, 8, 9), 9, gamma=2.0))


@query("f1_normalize_five", f"with {WIN} select window_id, step, ch, round(v, 6) + 0 as v from win where ch < 5")
def f1_five(spark, d):
    return rounded(X.normalize(plain(spark, d), 5))


@query(
    "f2_span_mask_rules",
    """select vec_id as window_id, 3 as n_masked, 3 as n_distinct, true as last_step_free from embeddings""",
)
def f2_rules(spark, d):
    """What holds for every draw: the count, no step twice, never the last step."""
    masked = X.span_mask(plain(spark, d), "window_id", steps=12, ratio=0.25, max_gram=4, seed=SEED)
    return masked.select(
        "window_id", F.size("pos").alias("n_masked"), F.size(F.array_distinct("pos")).alias("n_distinct"),
        (F.array_max("pos") < 11).alias("last_step_free"),
    )


CHOSEN = f"""tickets as (
  select vec_id as window_id, t.i as i, row_number() over (partition by vec_id
           order by md5('{SEED}:' || vec_id || ':' || t.i), t.i) as r from embeddings, range(12) t(i)),
chosen as (select window_id, i from tickets where r <= 3)"""


def masked(spark, d):
    return X.random_mask(plain(spark, d), "window_id", steps=12, count=3, seed=SEED)


@query("f3_random_mask", f"with {CHOSEN} select * from chosen")
def f3(spark, d):
    return masked(spark, d).select("window_id", F.explode("pos").alias("i")).withColumn("i", F.col("i").cast("bigint"))


def uniform(*parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


def span_draws(what: str, number: str) -> str:
    return uniform(f"'0:{what}'", "window_id", number)


LENGTHS = ", ".join(f"{b!r}::double" for b in X.span_bounds(4, 0.2))


@query(
    "f2_span_mask",
    f"""with recursive draws as (
          select vec_id as window_id, 0 as j, []::integer[] as masked from embeddings
          union all
          select window_id, j + 1, case when a < b and len(masked) < 3 and not list_contains(masked, a)
                                        then list_distinct(masked || range(a, b)::integer[]) else masked end
          from (select *, least(a + least(length, 3 - len(masked)), 11) as b
                from (select *, floor({span_draws("start", "j")} * 12)::integer as a,
                             1 + len(list_filter([{LENGTHS}], lambda x: x <= {span_draws("length", "j")})) as length
                      from draws where j < {X.span_draws(12, 3)}))),
        last as (select window_id, masked from draws where j = {X.span_draws(12, 3)}),
        rest as (select window_id, i, row_number() over (partition by window_id order by {span_draws("rest", "i")}, i) as r
                 from last, range(11) t(i) where not list_contains(masked, i)),
        pos as (select window_id, list_sort(masked || coalesce((select list(i::integer) from rest where rest.window_id = last.window_id and r <= 3 - len(masked)), [])) as pos from last)
        select window_id, len(pos)::integer as n_masked, list_max(pos) as last_masked, array_to_string(pos, ',') as pos from pos""",
)
def f2(spark, d):
    masked = X.span_mask(plain(spark, d), "window_id", steps=12, ratio=0.25, max_gram=4, seed=SEED)
    return masked.select("window_id", F.size("pos").alias("n_masked"), F.array_max("pos").alias("last_masked"), F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"))


@query(
    "f4_apply_mask",
    f"""with {WIN}, {CHOSEN}
        select win.window_id, step, ch,
               round(case when chosen.i is null then v
                          when {uniform("'mask'", "win.window_id")} < 0.6::double then 0
                          when {uniform("'replace'", "win.window_id")} < 0.5::double
                            then {uniform("'noise'", "win.window_id", "step", "ch")}
                          else v end, 6) + 0 as v
        from win left join chosen on chosen.window_id = win.window_id and chosen.i = win.step""",
)
def f4(spark, d):
    out = X.apply_mask(masked(spark, d), "window_id", mask_prob=0.6, replace_prob=0.5, seed=SEED)
    return rounded(out.select("window_id", F.col("masked").alias("data")))


@query(
    "f4_apply_mask_cells",
    f"""with {WIN}, {CHOSEN}, places as (
          select window_id, i, row_number() over (partition by window_id order by i) - 1 as place from chosen)
        select win.window_id, step, ch,
               round(case when places.i is null then v
                          when {uniform("'mask'", "win.window_id")} < 0.6::double then 0
                          when {uniform("'replace'", "win.window_id")} < 0.5::double
                            then {uniform("'noise'", "win.window_id", "step", "ch")}
                          else v end, 6) + 0 as v
        from win left join places on places.window_id = win.window_id and places.i = win.step and win.ch = places.place % 6""",
)
def f4_cells(spark, d):
    chosen = masked(spark, d).withColumn("chan", F.transform("pos", lambda v, i: i % 6))
    out = X.apply_mask(chosen, "window_id", mask_prob=0.6, replace_prob=0.5, seed=SEED, channels="chan")
    return rounded(out.select("window_id", F.col("masked").alias("data")))


@query(
    "f5_gather",
    f"""with {WIN}, {CHOSEN}, places as (
          select window_id, i, row_number() over (partition by window_id order by i) - 1 as place from chosen)
        select win.window_id, place as step, ch, round(v, 6) + 0 as v
        from win join places on places.window_id = win.window_id and places.i = win.step""",
)
def f5(spark, d):
    return rounded(X.gather(masked(spark, d)).select("window_id", F.col("target").alias("data")))


@query(
    "f5_gather_cells",
    f"""with {WIN}, {CHOSEN}, places as (
          select window_id, i, row_number() over (partition by window_id order by i) - 1 as place from chosen)
        select win.window_id, place, v
        from win join places on places.window_id = win.window_id and places.i = win.step and win.ch = places.place % 6""",
)
def f5_cells(spark, d):
    chosen = masked(spark, d).withColumn("chan", F.transform("pos", lambda v, i: i % 6))
    cells = X.gather(chosen, channels="chan")
    return cells.select("window_id", F.posexplode("target").alias("place", "v")).withColumn(
        "place", F.col("place").cast("bigint")
    )


STEP = 2 * math.pi / 12


@query(
    "f6_spectrum",
    f"""with {WIN}, sums as (
          select window_id, ch, b.k as k,
                 sum(v * cos({STEP} * ((b.k * step) % 12))) as re,
                 0 - sum(v * case when (b.k * step) % 12 in (0, 6) then 0 else sin({STEP} * ((b.k * step) % 12)) end) as im
          from win, range(12) b(k) group by 1, 2, 3)
        select window_id, k as step, ch, round(sqrt(re * re + im * im), 6) + 0 as v from sums
        union all select window_id, k + 12 as step, ch, round(atan2(im, re), 6) + 0 as v from sums""",
)
def f6(spark, d):
    out = X.spectrum(plain(spark, d), n=12)
    return rounded(out.select("window_id", F.col("spectrum").alias("data")))


@query(
    "f7_profile",
    f"""with {WIN} select count(distinct window_id) as n_windows, max(step) + 1 as n_steps, max(ch) + 1 as n_channels,
               count(*) as n_values, min(v) as min_value, max(v) as max_value, round(avg(v), 9) as mean_value,
               round(stddev_pop(v), 9) as std_value from win""",
)
def f7(spark, d):
    return X.profile(plain(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_value", "std_value")})


@query(
    "f8_feature_chain",
    f"""with {WIN}, {CHOSEN}
        select win.window_id, step, ch,
               round(case when chosen.i is not null then 0 when ch < 3 then v / 9.8 else v end, 6) + 0 as v
        from win left join chosen on chosen.window_id = win.window_id and chosen.i = win.step""",
)
def f8(spark, d):
    out = X.feature_chain(
        plain(spark, d),
        [
            lambda w: X.normalize(w, 6),
            lambda w: X.random_mask(w, "window_id", steps=12, count=3, seed=SEED),
            lambda w: X.apply_mask(w, "window_id", mask_prob=1.0, seed=SEED),
        ],
    )
    return rounded(out.select("window_id", F.col("masked").alias("data")))
