"""Drought indices: monthly totals (or means), summed over the last n months, then standardised within each cell.

SPEI and STI are standard scores, plain windows. SPI and SRI fit a gamma distribution by maximum likelihood, whose
statistics are two aggregates of a cell: they are windows over the cell, and fits and probabilities run in numpy on Arrow
batches of rows, whichever cells these are from."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import finite
from ..functions.special import gamma_cdf, gamma_fit, normal_quantile
from .align import pair
from .regions import zone_mean
from .resample import to_period
from .windows import rolling, zscore


def accumulated(df: DataFrame, scale: int, how: str = "sum", freq: str = "month", monthly: bool = False, label: str = "end") -> DataFrame:
    """(product,) cell_id, time, value: by month, unless it is already, then over the last `scale` rows."""
    keys = tuple(c for c in ("product", "cell_id") if c in df.columns)
    rows = df.select(*keys, "time", finite("value").alias("value")) if monthly else to_period(df, freq, how, label=label)
    return rolling(rows, scale, how) if scale > 1 else rows


def standardised(df: DataFrame, least: int = 10, distribution: str = "gamma") -> DataFrame:
    """value as the normal quantile of its fitted probability, kept within CLIP. Under `least` values, or positive ones, all of
    a cell are NULL; under gamma values of zero and less always are."""
    cell = Window.partitionBy(*(c for c in ("product", "cell_id") if c in df.columns))
    v = finite("value")
    if distribution == "normal":
        limit = float(normal_quantile(np.array([1.0]))[0])
        score = (v - F.avg(v).over(cell)) / F.nullif(F.stddev_samp(v).over(cell), F.lit(0.0))
        return df.withColumn("value", F.when(F.count(v).over(cell) >= least, F.greatest(F.least(score, F.lit(limit)), F.lit(-limit))))
    wet = F.when(v > 0, v)
    fit = F.when((F.count(v).over(cell) >= least) & (F.count(wet).over(cell) >= least), F.struct(F.avg(wet).over(cell).alias("mean"), F.avg(F.log(wet)).over(cell).alias("mean_log")))
    rows = df.withColumn("value", F.struct(wet.alias("v"), fit.alias("fit")))

    def run(batches):
        for b in batches:
            held = b.column("value")
            v, fit = held.field("v"), held.field("fit")
            x, mean, mean_log = (c.to_numpy(zero_copy_only=False).astype(float) for c in (v, *fit.flatten()))
            shape, scale = np.full(len(x), np.nan), np.full(len(x), np.nan)
            ok = np.isfinite(x) & np.isfinite(mean) & np.isfinite(mean_log)
            pairs, of = np.unique(np.stack([mean[ok], mean_log[ok]]), axis=1, return_inverse=True)
            a, s = gamma_fit(*pairs)
            shape[ok], scale[ok] = a[of.ravel()], s[of.ravel()]
            ok &= np.isfinite(shape)
            out = np.full(len(x), np.nan)
            out[ok] = normal_quantile(gamma_cdf(shape[ok], x[ok] / scale[ok]))
            yield pa.RecordBatch.from_arrays([pa.array(out, mask=~np.isfinite(out)) if n == "value" else b.column(n) for n in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, df.schema)


def spi(precip: DataFrame, scale: int = 3, freq: str = "month", monthly: bool = False, least: int = 10, distribution: str = "gamma") -> DataFrame:
    return standardised(accumulated(precip, scale, "sum", freq, monthly), least, distribution).withColumnRenamed("value", f"SPI_{scale}")


def sri(runoff: DataFrame, scale: int = 3, freq: str = "month", monthly: bool = False, least: int = 10) -> DataFrame:
    return standardised(accumulated(runoff, scale, "sum", freq, monthly), least).withColumnRenamed("value", f"SRI_{scale}")


def spei(precip: DataFrame, pet: DataFrame, scale: int = 3, freq: str = "month", monthly: bool = False, least: int = 10) -> DataFrame:
    """Of precipitation less potential evapotranspiration, where both have a row."""
    balance = pair(pet, precip).withColumn("value", F.col("sim") - F.col("obs")).drop("obs", "sim")
    return zscore(accumulated(balance, scale, "sum", freq, monthly), least=least).withColumnRenamed("value", f"SPEI_{scale}")


def sti(temp: DataFrame, scale: int = 1, freq: str = "month", monthly: bool = False, least: int = 10) -> DataFrame:
    return zscore(accumulated(temp, scale, "mean", freq, monthly), least=least).withColumnRenamed("value", f"STI_{scale}")


INDICES = {"spi": spi, "sri": sri, "spei": spei, "sti": sti}
#: Variables that each index takes, by their customary names.
INPUTS = {"spi": ("pr",), "sri": ("qtot",), "spei": ("pr", "pet"), "sti": ("tas",)}


def compute(variables: dict[str, DataFrame], indices: Iterable[str] = ("spi",), params: dict[str, dict] | None = None, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Indices by name. variables: cubes by name; names: what each customary variable is called there."""
    out = {}
    for i in indices:
        if i not in INDICES:
            raise KeyError(f"unknown index {i!r}")
        out[i] = INDICES[i](*(variables[(names or {}).get(v, v)] for v in INPUTS[i]), **(params or {}).get(i, {}))
    return out


def with_zone_means(variables: dict[str, DataFrame], zones: DataFrame, spi_scales=(3, 6, 12), spei_scales=(3, 6, 12), sri_scales=(), sti_scales=()) -> dict[str, DataFrame]:
    """Indices at several scales, and for each its mean by zone under the name with _region behind it."""
    asked = {"spi": spi_scales, "spei": spei_scales if "pet" in variables else (), "sri": sri_scales if "qtot" in variables else (), "sti": sti_scales if "tas" in variables else ()}
    out = {}
    for i, scales in asked.items():
        for n in scales:
            name = f"{i.upper()}_{n}"
            out[name] = compute(variables, [i], {i: {"scale": n}})[i]
            out[f"{name}_region"] = zone_mean(out[name], zones, name)
    return out
