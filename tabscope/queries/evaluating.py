"""Queries of the evaluation over given true codes, predictions and probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators import evaluation
from tabscope.queries import query
from tabscope.queries.fixtures import CLASS_NAMES, CODES, SCORES, scores, table

DIGITS = 9
GRID = "(select unnest([0, 1, 2])::int c)"
# Metrics from rows, one aggregate per class, not from a confusion matrix.
PER_CLASS = """per as (select c, count(*) filter (y = c) support,
  coalesce(count(*) filter (y = c and yp = c) / nullif(count(*) filter (yp = c), 0)::double, 0) p,
  coalesce(count(*) filter (y = c and yp = c) / nullif(count(*) filter (y = c), 0)::double, 0) r
  from {source}, (select unnest([0, 1, 2])::int c) group by c),
pf as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end f from per)"""
SCALAR_SQL = """(select avg((y = yp)::int) from {source}) accuracy, avg(p) precision_macro,
  sum(p * support) / sum(support) precision_weighted, avg(r) recall_macro,
  sum(r * support) / sum(support) recall_weighted, avg(f) f1_macro,
  sum(f * support) / sum(support) f1_weighted"""
AUC_SQL = """ranks as (select c, y = c hit, p,
    rank() over (partition by c order by p)
      + (count(*) over (partition by c, p) - 1) / 2.0::double rk
  from (select y, unnest([0, 1, 2])::int c, unnest([p0, p1, p2]) p from scores)),
aucs as (select c, count(*) filter (hit) np, count(*) filter (not hit) nn,
    (sum(rk) filter (hit) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2.0::double)
      / (count(*) filter (hit)::double * count(*) filter (not hit)) auc
  from ranks group by c)"""


def rounded_sql(inner: str) -> str:
    names = [*evaluation.SCALARS]
    return ", ".join(f"round({n}, {DIGITS}) {n}" for n in names) + f" from ({inner})"


def _round(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pair_counts(scores(spark, sf))


CONFUSION = f"""cells as (select a.c y_true, b.c y_pred, count(s.key) n
  from {GRID} a cross join {GRID} b left join scores s on s.y = a.c and s.yp = b.c group by all)"""


@query("confusion_matrix", f"with {SCORES}, {CONFUSION} select * from cells")
def _(spark, sf):
    return evaluation.confusion_matrix(_counts(spark, sf), CODES)


@query(
    "confusion_intensity",
    f"""with {SCORES}, {CONFUSION}, m as (select y_true, max(n) row_max from cells group by 1)
    select cells.*, row_max, round(n / greatest(row_max, 1)::double, 9) intensity
    from cells join m using (y_true)""",
)
def _(spark, sf):
    cells = evaluation.confusion_matrix(_counts(spark, sf), CODES)
    return _round(evaluation.confusion_intensity(cells), ["intensity"])


@query(
    "eval_scalars",
    f"with {SCORES}, {PER_CLASS.format(source='scores')} select "
    + rounded_sql(f"select {SCALAR_SQL.format(source='scores')} from pf"),
)
def _(spark, sf):
    return _round(evaluation.scalar_metrics(_counts(spark, sf), CODES), evaluation.SCALARS)


@query(
    "classification_report",
    f"""with {SCORES}, {PER_CLASS.format(source='scores')},
    s as (select {SCALAR_SQL.format(source='scores')}, sum(support)::bigint support from pf),
    lines as (
      select c ord, ['F', 'O', 'P'][c + 1] as class, p as "precision", r recall, f f1_score, support from pf
      union all select 3, 'accuracy', accuracy, accuracy, accuracy, support from s
      union all select 4, 'macro avg', precision_macro, recall_macro, f1_macro, support from s
      union all select 5, 'weighted avg', precision_weighted, recall_weighted, f1_weighted, support
        from s)
    select ord, class, round("precision", 9) as "precision", round(recall, 9) recall,
      round(f1_score, 9) f1_score, support from lines""",
)
def _(spark, sf):
    report = evaluation.classification_report(_counts(spark, sf), CODES, CLASS_NAMES)
    return _round(report, ["precision", "recall", "f1_score"])


@query(
    "roc_auc_ovr",
    f"""with {SCORES}, {AUC_SQL} select c code, np positives, nn negatives, round(auc, 9) auc
    from aucs""",
)
def _(spark, sf):
    return _round(evaluation.roc_auc_by_class(scores(spark, sf), "y", "p", CODES), ["auc"])


@query(
    "roc_auc_ovr_bucketed",
    f"""with {SCORES}, {AUC_SQL} select c code, np positives, nn negatives, round(auc, 9) auc
    from aucs""",
)
def _(spark, sf):
    # The same area with the scores cut into many ranges, as at full scale.
    out = evaluation.roc_auc_by_class(scores(spark, sf), "y", "p", CODES)
    return _round(out, ["auc"])


@query(
    "evaluate_predictions",
    f"with {SCORES}, {PER_CLASS.format(source='scores')}, {AUC_SQL} select "
    "(select round(avg(auc), 9) from aucs) roc_auc_ovr_macro, "
    + rounded_sql(f"select {SCALAR_SQL.format(source='scores')} from pf"),
)
def _(spark, sf):
    out = evaluation.evaluate(scores(spark, sf), CODES, probabilities="p")
    return _round(out, out.columns)


@query(
    "roc_auc_two_classes",
    """with t as (select toxic y, n_chars::double p from labels join documents using (doc_id)
      where toxic is not null),
    ranks as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double rk
      from t)
    select 1 code, count(*) filter (y = 1) positives, count(*) filter (y = 0) negatives,
      round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double)
        / nullif(count(*) filter (y = 1)::double * count(*) filter (y = 0), 0), 9) auc from ranks""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    sizes = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s"))
    rows = labels.filter("y is not null").join(sizes, "doc_id").select("y", F.array("s").alias("p"))
    return _round(evaluation.roc_auc_by_class(rows, "y", "p", [1]), ["auc"])


MODELS = ("first", "second", "constant")
MODEL_SQL = f"""{SCORES}, predicted as (
  select 0 ord, 'first' model, y, yp from scores
  union all select 1, 'second', y, case when key % 3 = 0 then (yp + 1) % 3 else yp end from scores
  union all select 2, 'constant', y, 0 from scores),
per as (select ord, model, c, count(*) filter (y = c) support,
  coalesce(count(*) filter (y = c and yp = c) / nullif(count(*) filter (yp = c), 0)::double, 0) p,
  coalesce(count(*) filter (y = c and yp = c) / nullif(count(*) filter (y = c), 0)::double, 0) r
  from predicted, {GRID} group by all),
pf as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end f from per),
acc as (select model, avg((y = yp)::int) accuracy from predicted group by 1),
m as (select pf.ord, model, round(any_value(accuracy), 9) accuracy, round(avg(p), 9) precision_macro,
  round(avg(r), 9) recall_macro, round(avg(f), 9) f1_macro from pf join acc using (model) group by all)"""


def _model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    base = scores(spark, sf)
    variants = {
        "first": F.col("yp"),
        "second": F.when(F.col("key") % 3 == 0, (F.col("yp") + 1) % 3).otherwise(F.col("yp")),
        "constant": F.lit(0),
    }
    parts = []
    for i, (name, yp) in enumerate(variants.items()):
        counts = evaluation.pair_counts(base.select("y", yp.alias("yp")))
        cells = [
            F.struct(F.lit(m).alias("metric"), F.round(m, DIGITS).alias("value"))
            for m in evaluation.SCALARS
        ]
        parts.append(
            evaluation.scalar_metrics(counts, CODES).select(
                F.lit(i).alias("ord"), F.lit(name).alias("model"), F.inline(F.array(*cells))
            )
        )
    return reduce(DataFrame.union, parts)


@query(
    "model_comparison",
    f"""with {MODEL_SQL}, long as (unpivot m on accuracy, precision_macro, recall_macro, f1_macro
      into name metric value v)
    select metric, {", ".join(f"max(v) filter (model = '{n}') as {n}" for n in MODELS)}
    from long group by metric""",
)
def _(spark, sf):
    return evaluation.model_comparison(_model_metrics(spark, sf), list(MODELS))


@query(
    "select_best_model",
    f"""with {MODEL_SQL} select model, 'f1_macro' metric, f1_macro as value from m
    order by f1_macro desc, ord limit 1""",
)
def _(spark, sf):
    return evaluation.select_best(_model_metrics(spark, sf), "f1_macro")
