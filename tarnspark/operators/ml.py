"""A forest that tells sites from other high ground, its cross-validation, and its use."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import raster


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinite and missing features become 0."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")) for c in columns})


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with ``weight`` n / (classes x n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    total = counts.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    return df.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("_n") / (F.col("_c") * F.col("_k"))).drop("_k", "_n", "_c")


def fit_forest(df: DataFrame, columns: list[str], label: str = "label", trees: int = 50, depth: int = 6, leaf: int = 5, seed: int = 42) -> PipelineModel:
    """A forest on balanced classes. Both sides of a split have ``leaf`` rows at least, so no node of fewer than twice as many is split."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="_features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features"), forest]).fit(balanced(finite(df, columns), label))


def importances(model: PipelineModel, columns: list[str]) -> DataFrame:
    """feature, importance (their sum is 1), rank of a fitted forest."""
    forest = model.stages[-1]
    found = sorted(zip(forest.featureImportances.toArray().tolist(), columns, strict=True), key=lambda x: (-x[0], x[1]))
    return SparkSession.active().createDataFrame([(name, value, i) for i, (value, name) in enumerate(found, 1)], "feature string, importance double, rank int")


def predict(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    out = model.transform(finite(df, columns))
    return out.withColumn("probability", vector_to_array("probability")[1]).withColumn("prediction", F.col("prediction").cast("int")).drop("_features", "rawPrediction")


def folds(df: DataFrame, key: str, label: str = "label", k: int = 5) -> DataFrame:
    """df with ``fold``, each class dealt evenly in the order of a hash."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key)) - 1) % k)


def metrics(df: DataFrame, label: str = "label") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of ``prediction``."""
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col("prediction") == p))
    out = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = out.withColumn("accuracy", part(tp + tn, tp + fp + tn + fn)).withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn))
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def verified(sites: DataFrame, least_elevation: float = 4267.0, most_moved: float = 8.0) -> DataFrame:
    """Sites fit to learn from: high ones, and others whose snap moved them little."""
    return sites.where(F.col("snapped_distance_m").isNotNull() & ((F.col("elevation") >= least_elevation) | (F.col("snapped_distance_m") < most_moved)))


def random_cells(cells: DataFrame, seeds: DataFrame, n: int = 2, near: float = 2.0, far: float = 4.0, seed: int = 42) -> DataFrame:
    """n cells of each tile at a random angle and distance from its seed (tile_id, seed_row, seed_col); those outside it are absent."""
    u = lambda k: F.pmod(F.xxhash64("tile_id", "try", F.lit(seed + k)), F.lit(1 << 30)) / float(1 << 30)
    tries = seeds.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(3 * n))))
    angle, metres = 2 * math.pi * u(0), near + (far - near) * u(1)
    places = tries.select("tile_id", "try", F.round(F.col("seed_row") - metres * F.cos(angle)).cast("int").alias("row"), F.round(F.col("seed_col") + metres * F.sin(angle)).cast("int").alias("col"))
    lists = places.groupBy("tile_id").agg(F.collect_list(F.struct("row", "col", "try")).alias("_tries"))
    own = F.transform(F.filter("_tries", lambda x: (x["row"] == F.col("row")) & (x["col"] == F.col("col"))), lambda x: x["try"])
    inside = cells.where(F.col("elev").isNotNull()).select(*raster.CELL).join(lists, "tile_id").withColumn("try", F.array_min(own)).where(F.col("try").isNotNull())
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy("tile_id").orderBy("try")))
    return ranked.where(F.col("_n") <= n).select(*raster.CELL)


def training_rows(cells: DataFrame, seeds: DataFrame, steps: int = 2, cell_m: float = 1.0, seed: int = 42, apart: float = 2.0) -> DataFrame:
    """Features, ``sample`` (positive, secondary, ridge, random) and ``label`` of each tile's samples.

    A seed is a positive; up to two lower maxima, two ridge cells and two random cells are negatives. A random cell that
    looks like a top (above 95 % of the tile) is left out, and a cell counts once, in this order.
    """
    order = {"positive": 0, "secondary": 1, "ridge": 2, "random": 3}
    own = seeds.select("tile_id", F.col("seed_row").alias("row"), F.col("seed_col").alias("col"))
    kinds = {"positive": own, "secondary": raster.secondary_peaks(cells).select(*raster.CELL), "ridge": raster.ridge_points(cells, seeds, apart=apart, cell_m=cell_m).select(*raster.CELL), "random": random_cells(cells, seeds, seed=seed)}
    rows = reduce(DataFrame.unionByName, [df.withColumn("sample", F.lit(k)) for k, df in kinds.items()])
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("sample"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*raster.CELL).orderBy(rank))).where(F.col("_n") == 1).drop("_n").join(seeds, "tile_id")
    away = cell_m * F.sqrt(F.pow(F.col("row") - F.col("seed_row"), 2) + F.pow(F.col("col") - F.col("seed_col"), 2))
    rows = rows.withColumn("dist_to_seed", away).drop("seed_row", "seed_col")
    out = rows.drop("dist_to_seed").join(raster.site_features(cells, rows, steps, cell_m), raster.CELL)
    looks = (F.col("sample") == "random") & (F.col("elev_rank") > 0.95) & (F.col("pct_lower") > 0.9)
    return out.where(~looks).withColumn("label", (F.col("sample") == "positive").cast("int"))


def ranked(scored: DataFrame) -> DataFrame:
    """Candidates (tile_id, row, col, elevation, probability) with ``rank``, the likeliest first, then the highest, and whether one is its tile's highest."""
    likely = Window.partitionBy("tile_id").orderBy(F.desc("probability"), F.desc("elevation"), "row", "col")
    high = Window.partitionBy("tile_id").orderBy(F.desc("elevation"), "row", "col")
    return scored.withColumn("rank", F.row_number().over(likely)).withColumn("is_highest", F.row_number().over(high) == 1)


def predict_sites(model: PipelineModel, cells: DataFrame, seeds: DataFrame, k: int = 15, apart: float = 5.0, steps: int = 2, cell_m: float = 1.0) -> DataFrame:
    """The k highest cells of each tile that lie apart, ranked by the model's probability."""
    points = raster.highest_apart(cells, k, apart).join(seeds, "tile_id")
    away = cell_m * F.sqrt(F.pow(F.col("row") - F.col("seed_row"), 2) + F.pow(F.col("col") - F.col("seed_col"), 2))
    found = raster.site_features(cells, points.withColumn("dist_to_seed", away), steps, cell_m)
    return ranked(predict(model, found, raster.FEATURES).select(*raster.CELL, "elevation", "dist_to_seed", "probability"))


def summary(per_fold: DataFrame, least_accuracy: float = 0.9) -> DataFrame:
    """metric, mean, std (of the population) over folds, and whether the mean accuracy is good enough to use the model."""
    names = ["accuracy", "precision", "recall", "f1"]
    long = per_fold.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.*")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.withColumn("good", F.when(F.col("metric") == "accuracy", F.col("mean") >= least_accuracy))


def cross_validate(df: DataFrame, columns: list[str], key: str, label: str = "label", k: int = 5, **forest) -> DataFrame:
    """Metrics of each fold, from a forest fitted on the others."""
    dealt, out = folds(df, key, label, k), None
    for i in range(k):
        model = fit_forest(dealt.where(F.col("fold") != i), columns, label, **forest)
        one = metrics(predict(model, dealt.where(F.col("fold") == i), columns), label).withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out
