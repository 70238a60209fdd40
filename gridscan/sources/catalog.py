"""Granule catalogs: files in a folder, ids and acquisition facts parsed from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscan.functions.scalar import clean_granule_id

# The naming patterns of the two products.
PAIR_ID = r"GSLC_(\d{3}_\d{3})_"
SCENE_NAME = r"BIO_(S\d)_SCS__1S_(\d{8})T.*_(M\d\d)_"


def list_files(spark: SparkSession, folder: str, glob: str = "*.tif") -> DataFrame:
    """Paths and sizes only; file contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select(
        "path", "length", "modificationTime")


def with_id(paths: DataFrame, pattern: str = PAIR_ID, path: str = "path") -> DataFrame:
    gid = F.regexp_extract(path, pattern, 1)
    return paths.withColumn("granule_id", F.when(gid != "", gid))


def catalog(paths: DataFrame, pattern: str = PAIR_ID, path: str = "path", strict: bool = True) -> DataFrame:
    """One row per granule id.  Two files with one id stop the job (strict) or show up as `ambiguous`."""
    g = with_id(paths, pattern, path).where("granule_id IS NOT NULL").groupBy("granule_id").agg(
        F.min(path).alias("path"), F.count(F.lit(1)).alias("n_files"))
    amb = F.col("n_files") > 1
    if strict:
        amb = F.when(amb, F.raise_error(F.concat(F.lit("ambiguous granule id "), F.col("granule_id"))).cast("boolean")).otherwise(False)
    return g.withColumn("ambiguous", amb)


def scan_granules(spark: SparkSession, folder: str, pattern: str = PAIR_ID, glob: str = "*.tif", strict: bool = True) -> DataFrame:
    return catalog(list_files(spark, folder, glob), pattern, strict=strict)


def find_granule(cat: DataFrame, granule_id: str) -> DataFrame:
    return cat.where(F.col("granule_id") == clean_granule_id(F.lit(granule_id)))


def parse_scene(names: DataFrame, name: str = "name", pattern: str = SCENE_NAME, strict: bool = True) -> DataFrame:
    """stack, acquisition date and footprint from a scene name; a malformed name stops the job (strict) or gives NULLs."""
    ok = F.col(name).rlike("^" + pattern)

    def part(i: int) -> Column:
        x = F.when(ok, F.regexp_extract(name, pattern, i))
        if strict and i == 1:
            x = x.otherwise(F.raise_error(F.concat(F.lit("cannot read stack/date/footprint from "), F.col(name))).cast("string"))
        return x
    return names.withColumn("stack", part(1)).withColumn("acq_date", F.to_date(part(2), "yyyyMMdd")).withColumn("foot", part(3))
