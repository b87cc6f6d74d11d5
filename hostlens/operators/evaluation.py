"""Labels against predictions: accuracy, confusion, precision and recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.clean import strip
from hostlens.functions.numeric import round_half_even
from hostlens.operators.ordering import rank_all
from hostlens.operators.rooms import named_room, with_name_rule
from hostlens.operators.validation import require_columns
from hostlens.session import cut

# --- fixed values: label spellings that mean "blurry" ---
BLURRY_WORDS = ("blurry", "true", "1", "yes")
# --- end of fixed values ---
LABEL_COLUMNS = ("photo_file", "label")

Predictor = Callable[[Column], Column]


def resolved_path(file: Column, root: str | None = None) -> Column:
    """Absolute files stay; others are looked up below the root when there is one."""
    if root is None:
        return file
    below = F.concat(F.lit(root.rstrip("/") + "/"), file)
    return F.when(file.startswith("/"), file).otherwise(below)


def is_blurry_label(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*BLURRY_WORDS), F.lit(False))


def room_pairs(
    labels: DataFrame, predictions: DataFrame | None = None,
    predictor: Predictor | None = None, root: str | None = None,
) -> DataFrame:
    """(truth, predicted) per labelled photo.

    Predictions come from a table (`path, room`), from a column function such as
    a pandas UDF, or from the file name; the file name also covers photos the
    table lacks.
    """
    require_columns(labels, LABEL_COLUMNS)
    rows = labels.select(
        strip(F.coalesce(F.col("label").cast("string"), F.lit("nan"))).alias("truth"),
        resolved_path(F.col("photo_file"), root).alias("path"),
    )
    if predictor is not None:
        return rows.select(
            "truth", strip(predictor(F.col("path")).cast("string")).alias("predicted")
        )
    rows, named = with_name_rule(rows), named_room(F.col("_rule"))
    if predictions is None:
        return rows.select("truth", named.alias("predicted"))
    table = predictions.groupBy("path").agg(_surest(predictions).alias("room"))
    return rows.join(table, "path", "left").select(
        "truth", strip(F.coalesce("room", named)).alias("predicted")
    )


def _surest(predictions: DataFrame) -> Column:
    """Of several predictions for a path the surest; without confidences, and of ties, by name."""
    if "room_confidence" not in predictions.columns:
        return F.min("room")
    return F.max_by("room", F.struct("room_confidence", "room"))


def blur_pairs(
    labels: DataFrame, metrics: DataFrame | None = None,
    detector: Predictor | None = None, root: str | None = None,
) -> DataFrame:
    """(truth, predicted) booleans; a photo without metrics is not blurry."""
    require_columns(labels, LABEL_COLUMNS)
    rows = labels.select(
        is_blurry_label(F.col("label")).alias("truth"),
        resolved_path(F.col("photo_file"), root).alias("path"),
    )
    if detector is not None:
        found = detector(F.col("path"))
        return rows.select("truth", F.coalesce(found, F.lit(False)).alias("predicted"))
    if metrics is None:
        raise ValueError("pass a metrics table or a detector")
    table = metrics.groupBy("path").agg(F.bool_or("is_blurry").alias("is_blurry"))
    return rows.join(table, "path", "left").select(
        "truth", F.coalesce("is_blurry", F.lit(False)).alias("predicted")
    )


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """Non-zero cells of the confusion matrix, long."""
    return pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def label_union(cells: DataFrame) -> DataFrame:
    """Every label that occurs on either side."""
    return cells.select("truth").union(cells.select("predicted")).distinct().withColumnRenamed(
        "truth", "label"
    )


def _matrix(labels: Column) -> Column:
    """Rows of counts in label order, from the collected `cells` of one report row."""
    lookup = F.map_from_entries(F.transform(
        "cells", lambda c: F.struct(F.struct(c["truth"], c["predicted"]), c["n"])
    ))
    return F.transform(labels, lambda t: F.transform(labels, lambda p: F.coalesce(
        F.element_at(lookup, F.struct(t.alias("truth"), p.alias("predicted"))),
        F.lit(0).cast("bigint"),
    )))


def label_index(cells: DataFrame) -> DataFrame:
    """(label, index): every label of either side by its place in sorted order, from 0."""
    ranked = rank_all(label_union(cells), [F.col("label")], "index")
    return ranked.select("label", (F.col("index") - 1).alias("index"))


def confusion_blocks(pairs: DataFrame, width: int = 1024, zeros: bool = False) -> DataFrame:
    """The dense confusion matrix for any number of labels, in blocks of one row.

    (truth, row, block, counts): `counts` are the cells of a truth label, the `row`-th, for
    the predicted labels from block * width on, `width` of them or what is left of the
    labels. Blocks without any count are left out unless `zeros`. No value of the result
    grows with the number of labels; `label_index` names the places. Null labels have none.
    """
    cells = cut(confusion_counts(pairs.dropna()), "confusion-cells")
    labels = cut(label_index(cells), "confusion-labels")
    many = labels.count()
    placed = (
        cells.join(labels.select(F.col("label").alias("truth"), F.col("index").alias("row")), "truth")
        .join(labels.select(F.col("label").alias("predicted"), F.col("index").alias("at")), "predicted")
        .groupBy("truth", "row", F.floor(F.col("at") / width).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(
            (F.col("at") % width).cast("int").alias("at"), "n"))).alias("cells"))
    )
    if zeros:
        blocks = -(-many // width)
        every = labels.select(F.col("label").alias("truth"), F.col("index").alias("row"), F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.lit(max(blocks, 1) - 1).cast("bigint"))).alias("block"))
        none = F.array().cast(placed.schema["cells"].dataType)
        placed = every.join(placed, ["truth", "row", "block"], "left").withColumn(
            "cells", F.coalesce("cells", none))
    here = F.least(F.lit(width), F.lit(many) - F.col("block") * width).cast("int")

    def gap(after: Column, before: Column) -> Column:
        return F.array_repeat(F.lit(0).cast("bigint"), after - before - 1)

    # zeros between the cells: nothing is looked up
    steps = F.transform("cells", lambda c, i: F.concat(
        gap(c["at"], F.when(i > 0, F.get(F.col("cells"), i - 1)["at"]).otherwise(-1)),
        F.array(c["n"])))
    last = F.coalesce(F.get(F.col("cells"), F.size("cells") - 1)["at"], F.lit(-1))
    return placed.select("truth", "row", "block", F.concat(
        F.flatten(steps), gap(here, last)).alias("counts"))


def room_accuracy(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, to 4 decimals as in the whole report, and row count, by sums only."""
    hits = F.avg((F.col("truth") == F.col("predicted")).cast("double"))
    return pairs.agg(
        round_half_even(hits, 4).alias("accuracy"), F.count(F.lit(1)).alias("row_count"))


def room_report(pairs: DataFrame) -> DataFrame:
    """The dense report, for few labels; `confusion_blocks` has the matrix for many.

    One row: accuracy, row count, sorted labels and the confusion matrix.

    Pairs are counted before they meet, so the row holds one entry per distinct
    pair of labels.
    """
    cells = confusion_counts(pairs)
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    report = cells.agg(
        (hit / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.collect_list(F.struct("truth", "predicted", "n")).alias("cells"),
    )
    labels = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "cells", lambda c: F.array(c["truth"], c["predicted"])
    ))))
    report = report.withColumn("labels", labels)
    return report.select(
        round_half_even(F.col("accuracy"), 4).alias("accuracy"), "row_count",
        _matrix(F.col("labels")).alias("confusion_matrix"), "labels",
    )


def blur_report(pairs: DataFrame) -> DataFrame:
    """One row: precision and recall of "blurry", row count, 2x2 matrix."""
    t, p = F.col("truth"), F.col("predicted")
    counts = pairs.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.count(F.lit(1)).alias("row_count"),
    )

    def share(part: Column, whole: Column) -> Column:
        ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
        return F.coalesce(ratio, F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.withColumns({"_p": share(tp, tp + fp), "_r": share(tp, tp + fn)})
    return counts.select(
        round_half_even(F.col("_p"), 4).alias("precision"),
        round_half_even(F.col("_r"), 4).alias("recall"), "row_count",
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
        F.array(F.lit(False), F.lit(True)).alias("labels"),
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, with macro and weighted means.

    Everything after the first count works on one row per pair of labels.
    """
    cells = confusion_counts(pairs)
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                     F.lit(0).cast("bigint").alias("claimed"),
                     F.when(F.col("truth") == F.col("predicted"), F.col("n"))
                     .otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("hit")),
        ))
    )
    sums = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"),
        F.sum("hit").alias("hit"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    hit, claimed, support = (F.col(c).cast("double") for c in ("hit", "claimed", "support"))
    per_class = sums.select(
        "label", ratio(hit, claimed).alias("precision"), ratio(hit, support).alias("recall"),
        ratio(2 * hit, claimed + support).alias("f1_score"), "support",
    )
    measures = ("precision", "recall", "f1_score")
    macro = per_class.agg(
        *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")
    ).withColumn("label", F.lit("macro avg"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support").cast("double")).alias(m)
          for m in measures],
        F.sum("support").alias("support"),
    ).withColumn("label", F.lit("weighted avg"))
    return per_class.unionByName(macro).unionByName(weighted)
