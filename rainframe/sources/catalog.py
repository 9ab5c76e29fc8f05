"""The catalogue of data sources, and plans of what to fetch from them. Fetching itself is left to the reader's tools.

Sources are public data sets; the table is read into a DataFrame, searched, and expanded into one row per date or year."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, variables array<string>, time string, space string, method string, formats string, needs_login boolean"
#: key | variables | time step | resolution | access | formats | login: fixed values.
SOURCES = """
chirps_monthly_nc | precipitation | monthly | 0.05 degree | http_direct | NetCDF | no
chirps_daily_tif | precipitation | daily | 0.05 degree | http_direct | GeoTIFF | no
gpcc_full_daily_v2022_10_nc_gz | precipitation | daily | 1.0 degree | http_direct | NetCDF/GZip | no
gpcc_full_monthly_v2022_025_nc_gz | precipitation | monthly | 0.25 degree | http_direct | NetCDF/GZip | no
cpc_global_unified_daily_nc | precipitation | daily | 0.5 degree | http_direct | NetCDF | no
udel_precip_monthly_v501_nc | precipitation | monthly | 0.5 degree | http_direct | NetCDF | no
udel_air_monthly_v501_nc | air_temperature, temperature | monthly | 0.5 degree | http_direct | NetCDF | no
precl_monthly_05deg_nc | precipitation | monthly | 0.5 degree | http_direct | NetCDF | no
precl_monthly_1deg_nc | precipitation | monthly | 1.0 degree | http_direct | NetCDF | no
precl_monthly_25deg_nc | precipitation | monthly | 2.5 degree | http_direct | NetCDF | no
era5_single_levels_hourly | 2m_temperature, total_precipitation, potential_evaporation, runoff | hourly | 0.25 degree | cds_api | GRIB/NetCDF | yes
era5land_hourly | 2m_temperature, total_precipitation, potential_evaporation, runoff | hourly | 0.1 degree | cds_api | GRIB/NetCDF | yes
imerg_final_hdf5 | precipitation | half-hourly to daily | 0.1 degree | http_listing | HDF5 | yes
gleam_monthly_nc | potential_evaporation, evapotranspiration, surface_soil_moisture, root_zone_soil_moisture | monthly | 0.1 degree | sftp | NetCDF | yes
mswep_monthly_nc | precipitation | monthly | 0.1 degree | rclone | NetCDF | yes
mswep_daily_nc | precipitation | daily | 0.1 degree | rclone | NetCDF | yes
persiann_cdr_erddap | precipitation | daily | 0.25 degree | erddap | NetCDF | no
persiann_portal | precipitation | hourly to accumulative | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
persiann_ccs_portal | precipitation | hourly to accumulative | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
persiann_cdr_portal | precipitation | daily to monthly | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
persiann_ccs_cdr_v2_portal | precipitation | hourly to accumulative | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
pdir_now_portal | precipitation | hourly to accumulative | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
persiann_v3_portal | precipitation | hourly to accumulative | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
persiann_cdr_v3_portal | precipitation | daily to monthly | portal-defined | portal_export | ArcGrid/GeoTIFF/NetCDF | no
cmfd | precipitation, temperature, humidity, radiation | 3-hourly to monthly | 0.1 degree | ftp | NetCDF | yes
cmfd v2 | precipitation, temperature, humidity, radiation | 3-hourly to monthly | 0.1 degree | ftp | NetCDF | yes
cmorph_daily_025deg_ftp | precipitation | daily | 0.25 degree | ftp | Z-compressed binary | no
cmorph_3hourly_025deg_ftp | precipitation | 3-hourly | 0.25 degree | ftp | Z-compressed binary | no
cmorph_30min_025deg_ftp | precipitation | 30-minute | 0.25 degree | ftp | Z-compressed binary | no
cmorph_daily_025deg_http | precipitation | daily | 0.25 degree | http_listing | NetCDF/Binary/GZip/BZ2 | no
cmorph_hourly_025deg_http | precipitation | hourly | 0.25 degree | http_listing | NetCDF/Binary/GZip/BZ2 | no
cmorph_30min_8km_http | precipitation | 30-minute | 8 km | http_listing | NetCDF/Binary/GZip/BZ2 | no
cmap_monthly_std_nc | precipitation | monthly | 2.5 degree | http_direct | NetCDF | no
gpcp_monthly_v23_ncei | precipitation | monthly | 2.5 degree | http_listing | NetCDF | no
gpcp_daily_cdr_v1_3_nc | precipitation | daily | 1.0 degree | http_listing | NetCDF | no
ncep_ncar_reanalysis1_prate_monthly_nc | precipitation, prate | monthly | 2.5 degree | http_direct | NetCDF | no
twentieth_century_reanalysis_v3_prate_monthly_nc | precipitation, prate | monthly | 1 degree | http_direct | NetCDF | no
trmm_3b42_daily_v7 | precipitation | daily | 0.25 degree | earthdata_cmr | HDF/NetCDF | yes
trmm_3b42_3hourly_v7 | precipitation | 3-hourly | 0.25 degree | earthdata_cmr | HDF/NetCDF | yes
merra2_tavg1_2d_flx_nx_hourly | precipitation, evaporation, surface_fluxes | hourly | 0.5 x 0.625 degree | earthdata_cmr | NetCDF-4 | yes
merra2_tavg1_2d_slv_nx_hourly | temperature, humidity, wind, pressure | hourly | 0.5 x 0.625 degree | earthdata_cmr | NetCDF-4 | yes
merra2_tavgm_2d_flx_nx_monthly | precipitation, evaporation, surface_fluxes | monthly | 0.5 x 0.625 degree | earthdata_cmr | NetCDF-4 | yes
gldas_noah025_3h_v21 | precipitation, soil_moisture, runoff, temperature | 3-hourly | 0.25 degree | earthdata_cmr | NetCDF-4 | yes
fldas_noah01_c_gl_m_v001 | precipitation, soil_moisture, runoff, temperature | monthly | 0.1 degree | earthdata_cmr | NetCDF-4 | yes
fldas_noah01_cp_gl_m_v001 | precipitation, soil_moisture, runoff, temperature | monthly | 0.1 degree | earthdata_cmr | NetCDF-4 | yes
cmip6_esgf | tas, tasmax, tasmin, pr | model-dependent | model-dependent | esgf | NetCDF | yes
cmip5_esgf | tas, tasmax, tasmin, pr | model-dependent | model-dependent | esgf | NetCDF | yes
"""


def sources(spark: SparkSession, variable: str | None = None) -> DataFrame:
    """All sources, or those that have a variable; of keys that differ in case only, the first."""
    rows = []
    for i, line in enumerate(SOURCES.strip().splitlines()):
        key, variables, time, space, method, formats, login = (c.strip() for c in line.split("|"))
        rows.append((i, key, [v.strip() for v in variables.split(",")], time, space, method, formats, login == "yes"))
    df = spark.createDataFrame(rows, "position int, " + SCHEMA)
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("key")).orderBy("position"))).where("_n = 1").drop("_n", "position")
    return df if variable is None else df.where(F.array_contains(F.transform("variables", F.lower), variable.lower()))


def search(spark: SparkSession, keyword: str) -> DataFrame:
    """Sources in whose text the keyword occurs; case and underscores do not matter."""
    plain = F.lower(F.translate(F.concat_ws(" ", "key", F.array_join("variables", " "), "method", "formats", "time", "space"), "_", " "))
    return sources(spark).where(F.contains(plain, F.lit(keyword.strip().lower().replace("_", " "))))


def source(spark: SparkSession, key: str) -> dict:
    found = sources(spark).where(F.lower("key") == key.strip().lower()).first()
    if found is None:
        raise KeyError(f"no source named {key!r}")
    return found.asDict()


@dataclass(frozen=True)
class Request:
    source: str
    variables: tuple[str, ...]
    start: str
    end: str
    bbox: tuple[float, float, float, float] | None = None
    params: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        return "_".join([self.source, "-".join(self.variables), self.start.replace("-", ""), self.end.replace("-", "")])


def plan(spark: SparkSession, requests: list[Request]) -> DataFrame:
    """One row per request: request_id, source, variables, start, end, bbox and the source's access method."""
    rows = [(r.id, r.source, list(r.variables), dt.date.fromisoformat(r.start), dt.date.fromisoformat(r.end), list(r.bbox) if r.bbox else None) for r in requests]
    for r in rows:
        if r[4] < r[3]:
            raise ValueError(f"{r[0]} ends before it starts")
    df = spark.createDataFrame(rows, "request_id string, source string, variables array<string>, start date, end date, bbox array<double>")
    return df.join(F.broadcast(sources(spark).select(F.col("key").alias("source"), "method")), "source", "left")


def expand(plans: DataFrame, by: str = "date", anchor: int = 1901, length: int = 10) -> DataFrame:
    """plans with a row per date, year or block of `length` years since anchor (block_start, block_end); none: as they are."""
    if by == "none":
        return plans
    if by == "date":
        return plans.withColumn("date", F.explode(F.sequence("start", "end")))
    years = F.explode(F.sequence(F.year("start"), F.year("end")))
    if by == "year":
        return plans.withColumn("year", years)
    if by == "block":
        if length <= 0:
            raise ValueError("blocks need a positive length")
        out = plans.withColumn("_y", years).withColumn("block_start", (anchor + F.floor((F.col("_y") - anchor) / length) * length).cast("int"))
        return out.withColumn("block_end", F.col("block_start") + length - 1).drop("_y").distinct()
    raise ValueError(f"unknown expansion {by!r}: date, year, block or none")


def in_window(names: DataFrame, start: str, end: str, pattern: str | None, contains: tuple[str, ...] = (), name: str = "name") -> DataFrame:
    """File names with all of the parts in `contains` and, where a pattern is given, whose date lies from start to end; the first
    of repeated names."""
    from .readers import date_in_name

    out = names.dropDuplicates([name])
    for part in contains:
        out = out.where(F.contains(F.col(name), F.lit(part)))
    if pattern is None:
        return out
    at = F.coalesce(*(F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(f)) for f in ("yyyyMMddHHmm", "yyyyMMddHH", "yyyyMMdd", "yyyyMM")), date_in_name(F.col(name)).cast("timestamp"))
    return out.where(at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def manifest(records: DataFrame) -> DataFrame:
    """One row over the records (status, size_bytes, elapsed_seconds) of attempts: counts, success rate, megabytes, means."""
    mb = F.col("size_bytes") / 1048576
    good = F.col("status") == "SUCCESS"
    return records.agg(
        F.count("*").alias("attempts"),
        *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "FAILED", "SKIPPED")),
        F.round(F.count_if(good) / F.nullif(F.count("*"), F.lit(0)), 3).alias("success_rate"),
        F.round(F.sum(F.when(good, mb)), 3).alias("megabytes"),
        F.round(F.avg(F.when(good, F.col("elapsed_seconds"))), 3).alias("mean_seconds"),
        F.round(F.avg(F.when(good, mb / F.nullif(F.col("elapsed_seconds"), F.lit(0.0)))), 3).alias("mean_megabytes_a_second"),
    )
