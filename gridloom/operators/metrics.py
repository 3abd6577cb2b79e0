"""Sampling keys and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def sample_groups(points: DataFrame, cols: list[str] = (), resolution: float | None = None, days: int | None = None, sep: str = "") -> DataFrame:
    """Adds ``cv_group``: values of cols, then x and y tiles, then a time bin, without separators unless given."""
    if not cols and resolution is None and days is None:
        raise ValueError("nothing to group by")
    parts: list[Column] = [F.col(c).cast("string") for c in cols]
    low = points.agg(*[F.min(F.floor(F.col(c) / (resolution or 1))).alias(f"_{c}") for c in ("x", "y") if resolution], *([F.min("date").alias("_t")] if days else []), F.lit(0).alias("_one"))
    out = points.crossJoin(F.broadcast(low))
    if resolution:
        parts += [F.concat(F.lit(c), (F.floor(F.col(c) / resolution) - F.col(f"_{c}")).cast("long").cast("string")) for c in ("x", "y")]
    if days:
        parts.append(F.concat(F.lit("t"), F.floor(F.datediff("date", "_t") / days).cast("long").cast("string")))
    return out.withColumn("cv_group", F.concat_ws(sep, *parts)).drop("_x", "_y", "_t", "_one")


def label_encode(df: DataFrame, target: str) -> DataFrame:
    """Adds ``code``: 0 to n - 1 over the sorted classes."""
    classes = df.where(F.col(target).isNotNull()).select(target).distinct()
    codes = classes.withColumn("code", F.row_number().over(Window.orderBy(target)) - 1)
    return df.join(codes, target, "left")


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become the column's mean."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in cols])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*means.columns)


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per class: precision, recall, f1, support."""
    c = confusion(df, true, pred)
    a = c.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    out = a.join(p, "label", "full").fillna(0, ["support", "hit", "said"])
    out = out.withColumn("precision", F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)).withColumn("recall", F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def report_averages(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Rows accuracy, macro avg and weighted avg of class_report: label, precision, recall, f1, support. The accuracy stands in all three columns."""
    per = class_report(df, true, pred)
    names = ("precision", "recall", "f1")
    sums = per.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in names], F.sum("support").alias("support"))
    rows = [("macro avg", "m"), ("weighted avg", "w")]
    parts = [F.struct(F.lit("accuracy").alias("label"), *[F.col("w_recall").alias(c) for c in names])]  # all hits over all rows
    parts += [F.struct(F.lit(label).alias("label"), *[F.col(f"{k}_{c}").alias(c) for c in names]) for label, k in rows]
    return sums.select("support", F.explode(F.array(*parts)).alias("x")).select("x.label", *[F.col(f"x.{c}").alias(c) for c in names], "support")


def class_log_loss(df: DataFrame, true: str, classes: list, probabilities: str) -> DataFrame:
    """Per class, one against the rest: label, log_loss of its probability (an array in the order of ``classes``)."""
    each = F.posexplode(F.array(*[F.lit(c) for c in classes]))
    rows = df.select(F.col(true).alias("_true"), F.col(probabilities).alias("_p"), each.alias("_i", "label"))
    p = F.greatest(F.least(F.get("_p", F.col("_i")), F.lit(1 - EPS)), F.lit(EPS))
    return rows.groupBy("label").agg(F.avg(-F.log(F.when(F.col("_true") == F.col("label"), p).otherwise(1 - p))).alias("log_loss"))


def regression_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """r2 (null if the truth is constant) and rmse."""
    e = F.col(true) - F.col(pred)
    return df.agg((1 - F.try_divide(F.sum(e * e), F.regr_syy(true, F.lit(1.0)))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def log_loss(df: DataFrame, p_true: str) -> DataFrame:
    return df.agg(F.avg(-F.log(F.greatest(F.least(F.col(p_true), F.lit(1 - EPS)), F.lit(EPS)))).alias("log_loss"))


def pr_curve(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Per key and distinct score from above: precision and recall of what scores at least that."""
    steps = df.groupBy(key, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("threshold"))
    every = Window.partitionBy(key)
    run = steps.select(key, "threshold", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n"), F.sum("tp").over(every).alias("all"))
    return run.select(key, "threshold", (F.col("tp") / F.col("n")).alias("precision"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0).alias("recall"))


def pr_auc(curve: DataFrame, key: str) -> DataFrame:
    """Area under the curve by trapezoids, from recall 0 at precision 1."""
    w = Window.partitionBy(key).orderBy(F.desc("threshold"))
    steps = curve.select(key, (F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))).alias("d"), ((F.col("precision") + F.coalesce(F.lag("precision").over(w), F.lit(1.0))) / 2).alias("h"))
    return steps.groupBy(key).agg(F.sum(F.col("d") * F.col("h")).alias("auc"))


def optimal_threshold(curve: DataFrame, key: str) -> DataFrame:
    """The threshold where precision and recall, both above 0, differ least; the highest of several."""
    good = curve.where("precision > 0 AND recall > 0")
    return good.groupBy(key).agg(F.max_by("threshold", F.struct(1 - F.abs(F.col("precision") - F.col("recall")), F.col("threshold"))).alias("threshold"))


def evaluate(df: DataFrame, true: str, method: str, pred: str | None = None, probabilities: str | None = None, classes: list | None = None) -> dict[str, DataFrame]:
    """The metrics of a method. regression (pred): r2 and rmse; predict (pred): confusion, report, averages; predict_proba
    (probabilities, an array in the order of ``classes``): loss, loss by class, precision and recall by class with area and best threshold."""
    if method == "regression":
        return {"metrics": regression_metrics(df, true, pred)}
    if method == "predict":
        return {"confusion": confusion(df, true, pred), "report": class_report(df, true, pred), "averages": report_averages(df, true, pred)}
    if method != "predict_proba":
        raise ValueError(f"unknown method {method}")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(true)).cast("int")
    each = df.select(F.col(true).alias("_t"), F.posexplode(probabilities).alias("_i", "score")).withColumn("label", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_i") + 1))
    curve = pr_curve(each.select("label", (F.col("_t") == F.col("label")).alias("hit"), "score"), "hit", "score", "label")
    own = df.where(place > 0).withColumn("_p", F.element_at(F.col(probabilities), place))
    return {"log_loss": log_loss(own, "_p"), "class_log_loss": class_log_loss(df, true, classes, probabilities), "curve": curve, "auc": pr_auc(curve, "label"), "threshold": optimal_threshold(curve, "label")}


def correction_factor(df: DataFrame, hit: str, members: list[str]) -> DataFrame:
    """Error of the mean prediction over the mean spread of the members: scales their spread to an uncertainty. Null if the members always agree."""
    arr = F.array(*members)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / len(members)
    spread = F.sqrt(F.aggregate(F.transform(arr, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / len(members))
    return df.agg(F.try_divide(F.sqrt(F.avg((F.col(hit) - mean) ** 2)), F.avg(spread)).alias("factor"))


def hard_class(probabilities: Column) -> tuple[Column, Column]:
    """Class from 1 on with the largest probability (the first of several), and that times 100."""
    top = F.array_max(probabilities)
    return F.array_position(probabilities, top).cast("int"), top * 100


def relative_entropy(probabilities: Column) -> Column:
    p = F.transform(probabilities, lambda x: F.greatest(x, F.lit(EPS)))
    return -F.aggregate(F.transform(p, lambda x: x * F.log2(x)), F.lit(0.0), lambda a, x: a + x) / F.log2(F.size(probabilities).cast("double"))
