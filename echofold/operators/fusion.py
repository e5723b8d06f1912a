"""Fusion of several nodes' scores for one event."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR_DB, PER_NODE_DB, MOST_DB = -20.0, 3.0, 12.0


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def snr_weight(snr_db: Column, floor_db: float = FLOOR_DB) -> Column:
    """Power ratio; a null or low SNR counts as the floor."""
    return F.pow(F.lit(10.0), F.greatest(F.coalesce(snr_db, F.lit(floor_db)), F.lit(floor_db)) / 10)


def fuse(df: DataFrame, group: list[str], node: str, p: str, snr_db: str, prior: float = 0.5) -> DataFrame:
    """Log-odds fusion with SNR weights of mean 1 and the prior corrected once, linear fusion, and a bonus for agreement.

    One aggregation: weights of mean 1 are n * w / sum(w), so sums of w and of w * logit suffice.
    """
    w = snr_weight(F.col(snr_db))
    base = float(math.log(prior / (1 - prior)))
    agg = df.withColumns({"_w": w, "_z": logit(F.col(p)) - base}).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_distinct(node).alias("n_nodes"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_z")).alias("_swz"),
        F.sum(F.col("_w") * F.col(p)).alias("_swp"),
    )
    bonus = F.least(F.lit(MOST_DB), F.greatest(F.lit(0.0), PER_NODE_DB * (F.col("n_nodes") - 1)))
    return agg.select(
        *group,
        "n_obs",
        "n_nodes",
        sigmoid(F.col("n_obs") * F.col("_swz") / F.col("_sw") + base).alias("p_logodds"),
        (F.col("_swp") / F.col("_sw")).alias("p_linear"),
        bonus.alias("bonus_db"),
    )


def top_k_mean(df: DataFrame, keys: list[str], score: str, tie: str, k: int, weight: str | None = None) -> DataFrame:
    """Weighted mean of the k greatest scores of each key."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("_k") <= k)
    w = F.col(weight) if weight else F.lit(1.0)
    return ranked.groupBy(*keys).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("confidence"), F.count(F.lit(1)).alias("n_used"))


def gaussian_fit(rows: DataFrame, by: str, vector: str, shrinkage: float = 0.05, ridge: float = 1e-6, quantile: float = 0.99) -> DataFrame:
    """Centre, whitening matrix and a distance that few rows exceed, for each class (by, n, mean, whiten, threshold, refusal).

    Every task sums its rows' vectors and outer products per class; the sums are merged by the place in the matrix, so no class is gathered. The covariance is
    drawn towards its own diagonal by ``shrinkage``, and ``ridge`` is added to that. The threshold is that of a normal distribution of as many axes. Refused: ``too_few`` (less than
    two rows) and ``mixed_sizes``; null vectors and those with a null or non-finite component take no part.
    """
    kind = rows.schema[by].dataType.simpleString()
    good = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    good = good.select(F.col(by).alias("g"), F.col(vector).cast("array<double>").alias("v")).where("g is not null")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for (g, size), part in batch.groupby([batch["g"], batch["v"].map(len)]):
                x = np.stack(part["v"].to_list()) if size else np.zeros((len(part), 0))
                n, total, outer = held.get((g, size), (0, 0.0, 0.0))
                held[g, size] = (n + len(x), total + x.sum(axis=0), outer + x.T @ x)
        for (g, size), (n, total, outer) in held.items():
            yield pd.DataFrame({"g": [g] * (size + 1), "size": size, "i": np.arange(-1, size), "n": n, "row": [list(total), *[list(r) for r in outer]] if size else [[]]})

    partial = good.mapInPandas(sums, f"g {kind}, size int, i int, n long, row array<double>")
    # One row for each row of a class's matrix: added up place by place.
    places = partial.select("g", "size", "i", "n", F.posexplode_outer("row").alias("j", "x")).groupBy("g", "size", "i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    matrix = places.groupBy("g", "size", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda r: r["x"]).alias("row"), F.max("n").alias("n"))
    classes = matrix.groupBy("g", "size").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"), F.max("n").alias("n"))
    classes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("n_sizes"), F.max_by(F.struct("size", "rows", "n"), "n").alias("c")).select("g", "n_sizes", "c.*")

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, n_sizes, size, listed, n in zip(*(batch[c] for c in ("g", "n_sizes", "size", "rows", "n"))):
                refusal = "mixed_sizes" if n_sizes > 1 else "too_few" if n < 2 or not size else None
                if refusal:
                    out.append((g, n, None, None, None, refusal))
                    continue
                table = [np.asarray(r["row"], float) for r in listed]
                mean = table[0] / n
                cov = np.stack(table[1:]) / n - np.outer(mean, mean)
                cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(size)
                # Square root of the chi-squared quantile, by the cube rule.
                z = NormalDist().inv_cdf(quantile)
                threshold = math.sqrt(size * (1 - 2 / (9 * size) + z * math.sqrt(2 / (9 * size))) ** 3)
                out.append((g, n, mean.tolist(), [list(r) for r in np.linalg.inv(np.linalg.cholesky(cov))], threshold, None))
            yield pd.DataFrame(out, columns=["g", "n", "mean", "whiten", "threshold", "refusal"])

    return classes.mapInPandas(invert, f"g {kind}, n long, mean array<double>, whiten array<array<double>>, threshold double, refusal string").withColumnRenamed("g", by)


def gaussian_distance(rows: DataFrame, fits: DataFrame, by: str, vector: str) -> DataFrame:
    """``rows`` with ``distance`` from their class's centre and its ``threshold``; nulls where the class has no fit, or the vector another size or a component that is no number."""
    # As many rows as there are classes; the distance is the length of the whitened difference.
    models = fits.where("refusal is null").select(F.col(by).alias("_g"), F.col("mean").alias("_mean"), F.col("whiten").alias("_whiten"), "threshold")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(models, rows[by] == F.col("_g"), "left").withColumn("_off", F.zip_with(F.col(vector).cast("array<double>"), "_mean", lambda x, m: x - m))
    squares = F.aggregate(F.transform("_whiten", lambda r: dot(r, F.col("_off"))), F.lit(0.0), lambda s, x: s + x * x)
    number = F.when(~F.isnan(squares) & (squares < float("inf")), F.sqrt(squares))
    return joined.withColumn("distance", number).select(*rows.columns, "distance", "threshold")
