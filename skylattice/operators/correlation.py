"""Two-point correlation estimate with leave-one-region-out errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.bins import Bins


def _leave_out_terms(df: DataFrame, keys: list[str], first: str, second: str | None, value: str) -> DataFrame:
    """Each sum as one total (`region` NULL) and one correction per region it would lose when that region is left out."""
    total = F.struct(F.lit(None).cast("int").alias("region"), F.col(value).alias("value"))
    lost = [F.struct(F.col(first).alias("region"), (-F.col(value)).alias("value"))]
    if second:
        # A pair inside one region is lost once, not twice.
        lost.append(F.struct(F.when(F.col(first) != F.col(second), F.col(second)).otherwise(F.col(first)).alias("region"),
                             F.when(F.col(first) != F.col(second), -F.col(value)).otherwise(F.lit(0.0)).alias("value")))
    return df.select(*keys, F.inline(F.array(total, *lost)))


def realisations(sums: DataFrame, weights: DataFrame, regions: DataFrame, bins: Bins) -> DataFrame:
    """Estimate for the full sample (`region` NULL) and with each region left out, from one set of pair sums.

    `sums` comes from `pair_sums`; `weights` is (`is_random`, `region`, `weight`); `regions` lists every `region`.  Output: `region`,
    `bin`, `dd`, `dr`, `rr`, `norm` = random over data weight of the same subset, and `xi` (NULL where rr is zero).
    """
    bin_list = F.explode(F.sequence(F.lit(0), F.lit(bins.count - 1))).alias("bin")
    pair_terms = _leave_out_terms(sums, ["kind", "bin"], "region_1", "region_2", "weighted")
    weight_terms = _leave_out_terms(
        weights.withColumn("kind", F.when(F.col("is_random") == 1, "wr").otherwise("wd")), ["kind"], "region", None, "weight"
    ).groupBy("kind", "region").agg(F.sum("value").alias("value")).select("kind", bin_list, "region", "value")
    # A zero row per region and bin, and for the total, so that nothing without pairs goes missing.
    whole = regions.sparkSession.range(1).select(F.lit(None).cast("int").alias("region"))
    grid = (
        regions.select(F.col("region").cast("int").alias("region")).distinct().unionByName(whole)
        .select(F.lit("dd").alias("kind"), bin_list, "region", F.lit(0.0).alias("value"))
    )
    terms = pair_terms.unionByName(weight_terms).unionByName(grid)
    kinds = ("dd", "dr", "rr", "wd", "wr")
    table = terms.groupBy("region", "bin").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind) for kind in kinds]
    )
    # At most regions + 1 rows per bin.
    per_bin = Window.partitionBy("bin")
    table = table.withColumns({
        kind: F.when(F.col("region").isNull(), F.col(kind)).otherwise(
            F.col(kind) + F.max(F.when(F.col("region").isNull(), F.col(kind))).over(per_bin)
        )
        for kind in kinds
    })
    norm = F.try_divide(F.col("wr"), F.col("wd"))
    xi = F.try_divide(norm * norm * F.col("dd") - 2.0 * norm * F.col("dr") + F.col("rr"), F.col("rr"))
    return table.select("region", "bin", "dd", "dr", "rr", norm.alias("norm"), xi.alias("xi"))


def _all_defined(value) :
    """Aggregate to NULL as soon as one input is NULL, as an undefined realisation makes the mean undefined."""
    return F.when(F.count(F.col("xi")) == F.count("*"), value)


def covariance(reals: DataFrame) -> DataFrame:
    """(`bin_i`, `bin_j`, `cov`): (N-1)/N * sum over regions of the products of deviations from the mean."""
    left_out = reals.where(F.col("region").isNotNull())
    per_bin = Window.partitionBy("bin")
    deviations = left_out.withColumn("dev", F.col("xi") - F.avg("xi").over(per_bin))
    # One array of at most `bins.count` entries per region; no join of the table with itself.
    rows = deviations.groupBy("region").agg(F.collect_list(F.struct("bin", "dev")).alias("devs"))
    products = rows.select("region", "devs", F.inline("devs").alias("bin_i", "dev_i")).select(
        "bin_i", "dev_i", F.inline("devs").alias("bin_j", "dev_j")
    )
    n = F.count("*")
    defined = F.count(F.col("dev_i") * F.col("dev_j")) == n
    return products.groupBy("bin_i", "bin_j").agg(
        F.when(defined, F.sum(F.col("dev_i") * F.col("dev_j")) * (n - 1) / n).alias("cov")
    )


def correlation_matrix(cov: DataFrame) -> DataFrame:
    """Adds `corr` = cov_ij / sqrt(cov_ii cov_jj), NULL where a variance is zero or undefined."""
    # One row of the symmetric matrix per group: its diagonal by a window, and the other diagonal through the columns.
    diagonal = F.when(F.col("bin_i") == F.col("bin_j"), F.col("cov"))
    with_both = cov.withColumn("var_i", F.max(diagonal).over(Window.partitionBy("bin_i"))).withColumn(
        "var_j", F.max(diagonal).over(Window.partitionBy("bin_j"))
    )
    return with_both.select(
        "bin_i", "bin_j", "cov", F.try_divide(F.col("cov"), F.sqrt(F.col("var_i") * F.col("var_j"))).alias("corr")
    )


def error_bars(cov: DataFrame) -> DataFrame:
    return cov.where("bin_i = bin_j").select(F.col("bin_i").alias("bin"), F.sqrt("cov").alias("error"))


def jackknife_mean(reals: DataFrame) -> DataFrame:
    """(`bin`, `xi_jk_mean`): mean of the leave-one-out estimates."""
    return reals.where(F.col("region").isNotNull()).groupBy("bin").agg(_all_defined(F.avg("xi")).alias("xi_jk_mean"))


def estimate(reals: DataFrame) -> DataFrame:
    """Per bin: full-sample estimate, mean of the leave-one-out estimates and its error bar."""
    out = F.col("region").isNotNull()
    n = F.count_if(out)
    defined = (F.count(F.when(out, F.col("xi"))) == n) & (n > 0)
    values = F.when(out, F.col("xi"))
    return reals.groupBy("bin").agg(
        F.max(F.when(~out, F.col("xi"))).alias("xi_full"),
        F.when(defined, F.avg(values)).alias("xi_jk_mean"),
        F.when(defined, F.sqrt(F.var_pop(values) * (n - 1))).alias("error"),
    )
