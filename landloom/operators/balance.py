"""Water balances of regions and spots, summaries of drainage, and what they are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.climate import clamp


def region_balance(samples: DataFrame, annual: DataFrame, region: str, area_m2: Column) -> DataFrame:
    """Per region the balance of the latest year in mm and m3.

    ``samples`` (region, ``aet``) gives the mean of the sampled layer, which stands before the year's own; ``annual`` has
    region, ``year, precip_mm, aet_mm, runoff_mm, recharge_mm``. A region without a year keeps its sampled evapotranspiration.
    """
    sampled = samples.groupBy(region).agg(F.avg("aet").alias("sampled"), F.count("aet").alias("n_samples"))
    last = annual.groupBy(region).agg(F.max_by(F.struct("year", "precip_mm", "aet_mm", "runoff_mm", "recharge_mm"), "year").alias("y"))
    both = sampled.join(last, region, "full_outer").select(region, F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "y.*", "sampled")
    mm = both.withColumn("aet_mm", F.coalesce("sampled", "aet_mm")).drop("sampled").withColumn("_area", area_m2)
    volume = lambda c: F.col(c) * F.col("_area") / 1000
    return mm.withColumns({c.replace("_mm", "_m3"): volume(c) for c in ("precip_mm", "aet_mm", "runoff_mm", "recharge_mm")}).drop("_area")


def latest_soil_water(daily: DataFrame, site: str) -> DataFrame:
    """Per site the last day's ``day, et0_mm, aet_mm`` and the ``deficit_mm`` between them, which is never negative."""
    last = daily.groupBy(site).agg(F.max_by(F.struct("day", "et0_mm", "aet_mm"), "day").alias("s")).select(site, "s.*")
    return last.withColumn("deficit_mm", F.greatest(F.col("et0_mm") - F.col("aet_mm"), F.lit(0.0)))


def scenario_layer(cells: DataFrame, total_mm: float) -> DataFrame:
    """An annual layer (``v``) scaled so that its mean is a scenario's total; empty where that mean is not positive."""
    mean = cells.agg(F.avg("v").alias("mean")).where("mean > 0")
    # one row
    return cells.join(F.broadcast(mean)).withColumn("v", F.col("v") * F.lit(float(total_mm)) / F.col("mean")).drop("mean")


def canopy_fraction(planned_pct: Column, cover_pct: Column, type_pct: Column, stored_pct: Column) -> Column:
    """Canopy cover as a fraction: of the plan, else the mean cover, else the mean by type, else what is stored, else 0.8."""
    part = lambda c, lo, hi: clamp(c / 100, lo, hi)
    found = [F.when(c.isNotNull(), part(c, lo, hi)) for c, lo, hi in ((planned_pct, 0.01, 0.99), (cover_pct, 0.05, 0.95), (type_pct, 0.05, 0.95), (stored_pct, 0.05, 0.95))]
    return F.coalesce(*found, F.lit(0.8))


def drainage_summary(cells: DataFrame, region: str, cell_m2: float) -> DataFrame:
    """Per region: hectares, the largest contributing area and the cell it leaves by, water that depressions hold, shares of soil groups.

    ``cells`` has region, ``id, acc, depth, hsg``; ties of the outlet go to the smaller id.
    """
    n = F.count("*")
    shares = [(F.count(F.when(F.col("hsg") == g, 1)) / n).alias(f"share_{g.lower()}") for g in "ABCD"]
    found = cells.groupBy(region).agg(
        (n * cell_m2 / 10_000).alias("footprint_ha"), F.max(F.struct("acc", (-F.col("id")).alias("m"))).alias("o"), (F.sum(F.greatest(F.coalesce("depth", F.lit(0.0)), F.lit(0.0))) * cell_m2).alias("storage_m3"), *shares
    )
    return found.withColumns({"contributing_ha": F.col("o.acc") * cell_m2 / 10_000, "outlet": -F.col("o.m")}).drop("o")


def monthly_wind(daily: DataFrame, site: str, height_m: float = 10.0) -> DataFrame:
    """Mean wind at 2 m by site and calendar month, from daily speeds at another height over grass."""
    at_2m = F.col("speed") * (F.lit(4.87) / F.log(F.lit(67.8 * height_m - 5.42)))
    return daily.groupBy(site, F.month("day").alias("month")).agg(F.avg(at_2m).alias("wind_2m"), F.count("speed").alias("days"))
