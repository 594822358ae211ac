"""Classification and escalation metrics as aggregations.

The only pass over the (possibly huge) prediction table is one partial/final
``groupBy(true, pred).count()``; every later step runs on that
(labels x labels)-row table.  Zero divisions give 0, as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake import fixed


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pair_counts(df: DataFrame, true_col: str, pred_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, F.col(true_col).cast("string").alias("y_true"),
                      F.col(pred_col).cast("string").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, labels: Sequence[str] | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """label, precision, recall, f1, support per (group, label).

    ``labels`` fixes the label list (classification report); without it the
    labels seen in truth or prediction are used (sklearn's default).
    """
    g = list(group_cols)
    tp = counts.where(F.col("y_true") == F.col("y_pred")).groupBy(*g, F.col("y_true").alias("label")).agg(
        F.sum("n").alias("tp"))
    sup = counts.groupBy(*g, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    pc = counts.groupBy(*g, F.col("y_pred").alias("label")).agg(F.sum("n").alias("pred_n"))
    if labels is not None:
        arr = F.array(*[F.lit(x) for x in labels])
        if g:
            spine = counts.select(*g).distinct().withColumn("label", F.explode(arr))
        else:
            spine = counts.limit(1).select(F.explode(arr).alias("label"))
    else:
        spine = sup.select(*g, "label").unionByName(pc.select(*g, "label")).distinct()
    keys = g + ["label"]
    j = spine.join(tp, keys, "left").join(sup, keys, "left").join(pc, keys, "left")
    tp_c, sup_c, pc_c = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "support", "pred_n"))
    return j.select(
        *g, "label",
        _div0(tp_c, pc_c).alias("precision"),
        _div0(tp_c, sup_c).alias("recall"),
        _div0(2 * tp_c, sup_c + pc_c).alias("f1"),
        sup_c.cast("long").alias("support"),
    )


def intent_summary(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro F1 (labels in truth or prediction), weighted F1, n."""
    g = list(group_cols)
    pcl = per_class(counts, None, g)
    acc = counts.groupBy(*g).agg(
        _div0(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"),
        F.sum("n").cast("long").alias("n"))
    f1 = pcl.groupBy(*g).agg(
        F.avg("f1").alias("macro_f1"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    if not g:
        acc, f1, g = acc.withColumn("_one", F.lit(1)), f1.withColumn("_one", F.lit(1)), ["_one"]
        return acc.join(f1, g).drop("_one").select(
            F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"),
            F.round("weighted_f1", 4).alias("weighted_f1"), "n")
    return acc.join(f1, g).select(*g, F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"),
                                  F.round("weighted_f1", 4).alias("weighted_f1"), "n")


def report_with_averages(counts: DataFrame, labels: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Per-label rows plus 'macro avg', 'weighted avg' and 'accuracy' rows over
    ``labels`` (accuracy is the support-weighted recall, in all three columns)."""
    g = list(group_cols)
    pcl = per_class(counts, labels, g)
    macro = pcl.groupBy(*g).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                F.avg("f1").alias("f1"), F.sum("support").alias("support")).withColumn(
        "label", F.lit("macro avg"))
    weighted = pcl.groupBy(*g).agg(
        *[_div0(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    cols = [*g, "label", "precision", "recall", "f1", "support"]
    accuracy = weighted.select(*g, F.lit("accuracy").alias("label"), *[F.col("recall").alias(m) for m in ("precision", "recall", "f1")],
                               "support")
    out = (pcl.select(*cols).unionByName(macro.select(*cols)).unionByName(weighted.select(*cols))
           .unionByName(accuracy.select(*cols)))
    return out.select(*g, "label", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_long(counts: DataFrame, labels: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(true_label, pred_label, n) for every label pair, zero cells kept."""
    g = list(group_cols)
    arr = F.array(*[F.lit(x) for x in labels])
    if g:
        spine = counts.select(*g).distinct().withColumn("true_label", F.explode(arr))
    else:
        spine = counts.limit(1).select(F.explode(arr).alias("true_label"))
    spine = spine.withColumn("pred_label", F.explode(arr))
    c = counts.select(*g, F.col("y_true").alias("true_label"), F.col("y_pred").alias("pred_label"), "n")
    j = spine.join(c, [*g, "true_label", "pred_label"], "left")
    return j.select(*g, "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Wide matrix in label order: one row per true label, one column per predicted label."""
    g = list(group_cols)
    long = confusion_long(counts, labels, g)
    return long.groupBy(*g, "true_label").pivot("pred_label", list(labels)).agg(F.sum("n"))


def escalation_metrics(df: DataFrame, true_col: str, pred_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """ESCALATE is the positive class; counts, P/R/F1, accuracy, error rates (4 decimals)."""
    g = list(group_cols)
    t = F.col(true_col) == fixed.ESCALATE
    p = F.col(pred_col) == fixed.ESCALATE
    a = df.groupBy(*g).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col(true_col) == F.col(pred_col)).alias("_agree"), F.count(F.lit(1)).alias("_n"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return a.select(
        *g,
        F.round(_div0(F.col("_agree"), F.col("_n")), 4).alias("accuracy"),
        F.round(prec, 4).alias("escalate_precision"),
        F.round(rec, 4).alias("escalate_recall"),
        F.round(_div0(2 * tp, 2 * tp + fp + fn), 4).alias("escalate_f1"),
        F.round(_div0(fn, tp + fn), 4).alias("false_auto_handle_rate"),
        F.round(_div0(fp, tn + fp), 4).alias("false_escalation_rate"),
        "tp", "fp", "tn", "fn",
    )


def summary_json(long: DataFrame, labels: Sequence[str], system_col: str = "system") -> DataFrame:
    """One row ``summary``: {dataset_size, num_intents, systems: {system:
    {intent: {accuracy, macro_f1, weighted_f1, classification_report},
    escalation}}} over rows (system, true_intent, pred_intent, true_action,
    pred_action).  One small row per system is gathered."""
    counts = pair_counts(long, "true_intent", "pred_intent", [system_col])
    report = report_with_averages(counts, labels, [system_col])
    by_label = report.groupBy(system_col).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct(
        "precision", "recall", F.col("f1").alias("f1-score"), "support")))).alias("r"))
    rows = F.struct(*[F.col("r")[x].alias(x) for x in [*labels, "macro avg", "weighted avg"]],
                    F.col("r")["accuracy"]["recall"].alias("accuracy"))
    esc = escalation_metrics(long, "true_action", "pred_action", [system_col])
    esc = esc.select(system_col, F.struct(*[c for c in esc.columns if c != system_col]).alias("escalation"))
    each = intent_summary(counts, [system_col]).join(by_label, system_col).join(esc, system_col).select(
        system_col, "n", F.struct(F.struct("accuracy", "macro_f1", "weighted_f1", rows.alias("classification_report")).alias("intent"),
                                  "escalation").alias("s"))
    systems = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(system_col).alias("k"), F.col("s").alias("v")))))
    return each.agg(F.max("n").alias("dataset_size"), systems.alias("systems")).select(F.to_json(F.struct(
        "dataset_size", F.lit(len(labels)).alias("num_intents"), "systems")).alias("summary"))
