from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from queries import query
from queries.views import CHANNELS, DAY, EV, EVENTS, EVN, PRED, WIN, events, predictions, quality_scores, table, windows
from stridelake.functions import features as X
from stridelake.functions.batch import score
from stridelake.operators import metrics as E
from stridelake.operators import quality as Q
from stridelake.operators import sampling as S
from stridelake.operators import scoring as M
from stridelake.operators.columns import flatten_window
from stridelake.sources.folders import shared_folder
from stridelake.sources.windows import write_windows

NAMES = ["class a", "class b", "class c", "class d", "class e", "class f"]
SEED = 5


def decided(spark, d):
    return E.decide(predictions(spark, d)).select("window_id", "label", "predicted")


def nine(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("m4_argmax", f"with {PRED} select window_id, label, predicted from pred")
def m4(spark, d):
    return decided(spark, d)


@query(
    "m3_score_function",
    f"""with {WIN}, s as (select window_id, ch, avg(v) as score from win group by 1, 2)
        select window_id, cast(arg_max(ch, score) as integer) as predicted, round(max(score), 9) as top from s group by 1""",
)
def m3_function(spark, d):
    scored = score(windows(spark, d).select("window_id", "data"), lambda x: x.mean(axis=1), dtype="float64")
    return E.decide(scored).select("window_id", "predicted", F.round(F.array_max("scores"), 9).alias("top"))


@query(
    "m5_reconstruction_mse",
    f"with {WIN} select round(avg(case when ch < 3 then (v / 9.8 - v) * (v / 9.8 - v) else 0 end), 9) as mse, count(*) as n_values from win",
)
def m5(spark, d):
    win = windows(spark, d).select("window_id", F.col("data").alias("target"), "data")
    return nine(E.reconstruction_mse(X.normalize(win, 6), predicted="data"), "mse")


@query(
    "m6_prediction_distribution",
    f"""with {PRED} select predicted, count(*) as n_rows, coalesce({NAMES!r}[predicted + 1], cast(predicted as varchar)) as name
        from pred group by 1""",
)
def m6(spark, d):
    return E.prediction_distribution(decided(spark, d), NAMES)


@query("m7_fit_classifier", "select distinct label as class, true as fits from embeddings")
def m7(spark, d):
    """At the optimum, the mean probability of a class over the training rows is the share of its labels."""
    parts = M.features_pooled(windows(spark, d), 6)
    model = M.fit_classifier(parts, reg=0.01, iterations=100)
    scored = M.with_predictions(model, parts, "pooled")
    # A class's score stands at its label.
    means = scored.select(F.posexplode("scores").alias("class", "p")).groupBy("class").agg(F.avg("p").alias("p"))
    shares = parts.groupBy(F.col("label").alias("class")).agg((F.count("*") / parts.count()).alias("share"))
    return means.join(shares, "class").select("class", (F.abs(F.col("p") - F.col("share")) < 0.002).alias("fits"))


def centroid_model(train, steps=64):
    """Scores by closeness to the mean vector of each class, a linear model: x . c - |c|^2 / 2."""
    cells = train.select("label", F.posexplode("embedding").alias("i", "v"))
    means = np.zeros((train.agg(F.max("label")).first()[0] + 1, steps))
    for r in cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c")).collect():  # classes x channels numbers
        means[r.label, r.i] = r.c
    return M.LinearModel(means, -(means**2).sum(axis=1) / 2)


CANDIDATES = 3


@query(
    "m8_select_best",
    f"""with e as (select vec_id, label, ['train', 'vali', 'test'][1 + vec_id % 3] as split, embedding from embeddings),
        cells as (select vec_id, label, split, t.i as i, cast(embedding[t.i + 1] as double) as v from e, range(64) t(i)),
        centroids as (select m.m as model, label as class, i, avg(v) as c from cells, range({CANDIDATES}) m(m)
                      where split = 'train' and vec_id % (4 + m.m) > 0 group by 1, 2, 3),
        scored as (select model, vec_id, label, split, class, sum(v * c - c * c / 2) as score from cells join centroids using (i) group by 1, 2, 3, 4, 5),
        pred as (select model, vec_id, label, split, arg_min(class, (-score, class)) as predicted from scored group by 1, 2, 3, 4),
        accuracies as (select model, avg((label = predicted)::int) as accuracy from pred where split = 'vali' group by 1),
        best as (select arg_min(model, (-accuracy, model)) as model from accuracies),
        p as (select * from pred join best using (model)),
        classes as (select split, c as class, count(*) filter (where label = c and predicted = c) as tp,
                           count(*) filter (where label = c) as actual, count(*) filter (where predicted = c) as found
                    from (select *, unnest(list_distinct([label, predicted])) as c from p) group by 1, 2),
        f as (select split, avg(2 * tp / (actual + found)) as macro_f1 from classes group by 1)
        select model, split, round(avg((label = predicted)::int), 9) as accuracy, round(any_value(macro_f1), 9) as macro_f1
        from p join f using (split) group by 1, 2""",
)
def m8(spark, d):
    """The best of three linear models by validation accuracy, and its accuracy and F1 in each part."""
    split = F.element_at(F.array(F.lit("train"), F.lit("vali"), F.lit("test")), (F.col("vec_id") % 3 + 1).cast("int"))
    parts = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("split", split)
    candidates = [centroid_model(parts.filter((F.col("split") == "train") & (F.col("vec_id") % (4 + m) > 0))) for m in range(CANDIDATES)]
    best, report = M.select_best(candidates, parts, vector="embedding")
    return nine(report, "accuracy", "macro_f1").select(F.lit(next(i for i, c in enumerate(candidates) if c is best)).cast("bigint").alias("model"), "split", "accuracy", "macro_f1")


@query("e1_accuracy", f"with {PRED} select round(avg((label = predicted)::int), 9) as accuracy, count(*) as n_rows from pred")
def e1(spark, d):
    return nine(E.accuracy(decided(spark, d)), "accuracy")


@query(
    "e1_accuracy_if_aligned",
    f"""with {PRED} select (select count(*) from pred) as n_labels, count(*) filter (where window_id > 0) as n_predictions,
               cast(null as double) as accuracy, 'skipped: labels and predictions differ in number' as notice from pred""",
)
def e1_aligned(spark, d):
    rows = decided(spark, d)
    return E.accuracy_if_aligned(
        rows.select("window_id", "label"), rows.filter("window_id > 0").select("window_id", "predicted"), "window_id"
    )


@query(
    "e1_accuracy_aligned",
    f"""with {PRED} select count(*) as n_labels, count(*) as n_predictions, round(avg((label = predicted)::int)::double, 9) as accuracy,
               cast(null as varchar) as notice from pred""",
)
def e1_agreeing(spark, d):
    rows = decided(spark, d)
    return nine(E.accuracy_if_aligned(rows.select("window_id", "label"), rows.select("window_id", "predicted"), "window_id"), "accuracy")


F1 = """classes as (select distinct unnest([label, predicted]) as class from pred),
f1s as (
  select class, count(*) filter (where label = class and predicted = class) as tp,
         count(*) filter (where label <> class and predicted = class) as fp,
         count(*) filter (where label = class and predicted <> class) as fn
  from classes, pred group by 1)"""


@query(
    "e2_macro_f1",
    f"""with {PRED}, {F1} select round(avg(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end), 9)
          as macro_f1, count(*) as n_classes from f1s""",
)
def e2(spark, d):
    return nine(E.macro_f1(decided(spark, d)), "macro_f1")


@query(
    "e2_class_scores",
    f"""with {PRED}, {F1} select class, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
               round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from f1s""",
)
def e2_classes(spark, d):
    return nine(E.class_scores(E.confusion(decided(spark, d))), "f1")


DENSE = """classes as (select distinct unnest([label, predicted]) as class from pred),
dense as (
  select a.class as actual, p.class as predicted, count(pred.window_id) as n_rows
  from classes a cross join classes p left join pred on pred.label = a.class and pred.predicted = p.class group by 1, 2)"""


@query("e3_confusion", f"with {PRED}, {DENSE} select * from dense")
def e3(spark, d):
    return E.confusion_dense(E.confusion(decided(spark, d)))


@query(
    "e4_confusion_normalized",
    f"""with {PRED}, {DENSE} select actual, predicted,
          round(coalesce(n_rows / nullif(sum(n_rows) over (partition by actual), 0), 0), 9) as share from dense""",
)
def e4(spark, d):
    return nine(E.confusion_normalized(E.confusion_dense(E.confusion(decided(spark, d)))), "share")


@query(
    "e5_second_head",
    f"""with {PRED}, second as (
          select window_id, label, arg_max(class, (score, -class)) as predicted from (
            select window_id, label, 9 - class as class, score from scored) group by 1, 2)
        select round(avg((label = predicted)::int), 9) as accuracy, count(*) as n_rows from second""",
)
def e5(spark, d):
    heads = predictions(spark, d).withColumn("second", F.reverse("scores"))
    return nine(E.accuracy(E.decide(heads, "second")), "accuracy")


@query(
    "e6_multitask_metrics",
    f"""with {PRED},
        pairs as (
          select (s.label > 0)::int as label, (s.score > 0.1::double)::int as predicted from scored s
          where s.class < 9 and (s.label = 0 or s.class = s.label - 1)),
        c as (select c.c as class, count(*) filter (where label = c and predicted = c) as tp,
                     count(*) filter (where label <> c and predicted = c) as fp,
                     count(*) filter (where label = c and predicted <> c) as fn from pairs, range(2) c(c) group by 1)
        select (select round(avg((label = predicted)::int), 9) from pairs) as accuracy,
               round(avg(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end), 9) as macro_f1
        from c where tp + fp + fn > 0""",
)
def e6(spark, d):
    return nine(E.multitask_metrics(predictions(spark, d), tasks=9, threshold=0.1), "accuracy", "macro_f1")


LAB = """lab as (select l.doc_id, l.quality as label, d.n_chars::double as score from labels l join documents d using (doc_id))"""


@query(
    "e7_roc_curve",
    f"""with {LAB}, s as (select score, sum((label > 0)::int) as p, sum((label <= 0)::int) as n from lab group by 1)
        select score as threshold, round(sum(n) over w / sum(n) over (), 9) as fpr, round(sum(p) over w / sum(p) over (), 9) as tpr
        from s window w as (order by score desc rows unbounded preceding)""",
)
def e7_curve(spark, d):
    return nine(E.roc_curve(quality_scores(spark, d)), "fpr", "tpr")


@query(
    "e7_roc_auc",
    f"""with {LAB} select round(avg(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end)::double, 9) as auc
        from lab a, lab b where a.label > 0 and b.label <= 0""",
)
def e7(spark, d):
    return nine(E.roc_auc(quality_scores(spark, d)), "auc")


@query("e8_pca_project", "select vec_id as window_id, true as kept, true as falls, true as orthonormal from embeddings")
def e8(spark, d):
    """Over all 72 dimensions: a row keeps its squared length, variances fall, directions are orthonormal."""
    flat = flatten_window(windows(spark, d).select("window_id", "data"))
    model = M.fit_pca(flat, 72)
    mean = F.array(*[F.lit(float(m)) for m in model.mean])
    centred = F.zip_with("features", mean, lambda v, m: v - m)
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    falls = bool((np.diff(model.variance) <= 1e-9).all())
    orthonormal = bool(np.abs(model.directions.T @ model.directions - np.eye(model.directions.shape[1])).max() < 1e-9)
    kept = F.abs(squares(F.col("projected")) - squares(centred)) <= 1e-6 * (1 + squares(centred))
    return M.project(flat, model).select("window_id", kept.alias("kept"), F.lit(falls).alias("falls"), F.lit(orthonormal).alias("orthonormal"))


@query(
    "e8_pca_variances",
    """with c as (select vec_id, t.i as i, cast(embedding[t.i + 1] as double) as v from embeddings, range(64) t(i)),
       m as (select i, avg(v) as mean from c group by 1)
       select round(sum((v - mean) * (v - mean)) / count(distinct vec_id), 6) as total_variance from c join m using (i)""",
)
def e8_variances(spark, d):
    """Variances of all directions add up to those of the cells."""
    flat = flatten_window(windows(spark, d).select("window_id", "data"))
    return spark.createDataFrame([(round(float(M.fit_pca(flat, 72).variance.sum()), 6),)], "total_variance double")


@query(
    "q1_validate_samples",
    f"""with {EV}, c as (select user_id, count(*) as n, count(distinct t_us) - 1 as rises from ev group by 1)
        select user_id, 'two_rows' as "check", n as found from c where n < 2
        union all select user_id, 'two_increasing_times', rises + 1 from c where rises < 1
        union all select user_id, 'one_window', n from c where n < 60""",
)
def q1(spark, d):
    return Q.validate_samples(events(spark, d), EVENTS, window=60)


@query(
    "q1_validate_windows",
    """select vec_id as window_id, 'channels' as "check", 6::bigint as found from embeddings""",
)
def q1_windows(spark, d):
    return Q.validate_windows(windows(spark, d), "window_id", steps=12, channels=9, dimension=9)


@query(
    "q2_summarize_windows",
    """select count(*) as n_windows, 12::bigint as n_steps, 6::bigint as n_channels,
              array_to_string(list_sort(list(distinct label)), ',') as label_ids, 0::bigint as label_outside from embeddings""",
)
def q2(spark, d):
    """The summary of a window set, observed while it is written."""
    summary = write_windows(windows(spark, d), shared_folder(spark, "summary"), "vectors", 20, 12, 12, labels=["label"])
    row = [(summary["n_windows"], summary["n_steps"], summary["n_channels"], ",".join(map(str, summary["label_ids"])), summary["label_outside"])]
    return spark.createDataFrame(row, "n_windows bigint, n_steps bigint, n_channels bigint, label_ids string, label_outside bigint")


@query(
    "q2_label_ids",
    """select 'l_orderkey' as kind, l_orderkey as id from lineitem group by 2
       union all select 'l_suppkey', -l_suppkey from lineitem group by 2""",
)
def q2_ids(spark, d):
    """Ids of kinds with many, negative ones too, as bitmaps."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", (-F.col("l_suppkey")).alias("l_suppkey"))
    return Q.label_ids(rows, ["l_orderkey", "l_suppkey"])


@query("q2_first_rows", "select vec_id as window_id, label from embeddings order by vec_id limit 3")
def q2_first(spark, d):
    return Q.first_rows(windows(spark, d).select("window_id", "label"), "window_id")
