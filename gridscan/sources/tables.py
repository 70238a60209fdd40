"""Label, score, bundle and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridscan.functions.scalar import clean_granule_id
from gridscan.operators.features import pack
from gridscan.operators.grid import block_average, with_tile
from gridscan.schema import TILE, TILE_LABELS


def read_labels(spark: SparkSession, path: str | Sequence[str], classes: Sequence[str], schema: StructType = TILE_LABELS) -> DataFrame:
    """Label CSVs with an explicit schema; rows of other classes (reviews, skips) are left out."""
    return spark.read.schema(schema).csv(path, header=True).where(F.col("label").isin(list(classes)))


def write_labels(labels: DataFrame, path: str, order: Sequence[str] = ("row", "col")) -> None:
    """CSV sorted by (row, col): a range sort, so files are ordered and each is sorted inside."""
    labels.orderBy(*order).write.mode("errorifexists").csv(path, header=True)


def sentinels_to_null(df: DataFrame, ints: Sequence[str] = (), floats: Sequence[str] = ()) -> DataFrame:
    """-1 in counts and NaN in measures mean "absent"."""
    return df.withColumns({**{c: F.when(F.col(c) != -1, F.col(c)) for c in ints},
                           **{c: F.when(~F.isnan(c), F.col(c)) for c in floats}})


def null_to_sentinels(df: DataFrame, ints: Sequence[str] = (), floats: Sequence[str] = ()) -> DataFrame:
    """The way back, for consumers that need dense arrays."""
    return df.withColumns({**{c: F.coalesce(F.col(c), F.lit(-1)) for c in ints},
                           **{c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in floats}})


def write_bundle(df: DataFrame, path: str, run: Mapping[str, object] = {}, partition: Sequence[str] = ()) -> None:
    """Columnar bundle; run scalars become constant columns (dictionary-encoded, a few bytes per row group)."""
    out = df.withColumns({k: F.lit(v) for k, v in run.items()}) if run else df
    w = out.write.mode("errorifexists")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_scores(scores: DataFrame, path: str, run: Mapping[str, object]) -> None:
    """Scores with the run's parameters, so a later threshold needs no rescoring."""
    write_bundle(scores, path, run, ["granule_id"])


def score_csv_rows(scores: DataFrame, models: Sequence[str], thresholds: Mapping[str, float] | None = None, granule: str = "granule_id") -> DataFrame:
    """Text rows of the score CSV: only rows with any score, p with 4 decimals, blank where a model has none."""
    p = [f"p_{m}" for m in models]
    d = scores.na.drop(how="all", subset=p)
    cols = [clean_granule_id(granule).alias("granule"), "row", "col", F.format_string("%.1f", "x_m").alias("x_m"), F.format_string("%.1f", "y_m").alias("y_m")]
    cols += [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).alias(c) for c in p]
    for m, t in (thresholds or {}).items():
        cols.append((F.col(f"p_{m}") >= t).cast("int").alias(f"flag_{m}"))
    return d.select(*cols)


def write_score_csv(scores: DataFrame, path: str, models: Sequence[str], thresholds: Mapping[str, float] | None = None, **kw) -> None:
    score_csv_rows(scores, models, thresholds, **kw).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def band_statistics(px: DataFrame, key: Sequence[str] = ("granule_id", "band"), v: str = "v") -> DataFrame:
    x = F.col(v).cast("double")
    return px.groupBy(*key).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n_valid"))


def pyramid(px: DataFrame, levels: int, v: str = "v") -> DataFrame:
    """Averaging overviews: each level is the 2x block mean of the one before; one row set with `level`."""
    cur, out = px.select("granule_id", "r", "c", v), None
    for lv in range(1, levels + 1):
        cur = block_average(cur, 2, v)
        row = cur.withColumn("level", F.lit(lv))
        out = row if out is None else out.unionByName(row)
    return out


def to_json_report(rows: DataFrame, order: str) -> DataFrame:
    """A short report (strata, sweep) as one JSON text.  Report rows are few by construction."""
    items = F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))
    return rows.agg(F.to_json(items).alias("report"))


def from_json_report(doc: DataFrame, schema: str, col: str = "report") -> DataFrame:
    return doc.select(F.inline(F.from_json(col, f"array<struct<{schema}>>")))


def pack_shard(labels: DataFrame, px: DataFrame, ts: int, image: str, target: str, keep: Sequence[str], cover_theta: float = 0.2) -> DataFrame:
    """Training shard: labelled tiles with their image and target arrays; coverage is recomputed from the target shipped."""
    d = with_tile(px.select("granule_id", "r", "c", image, target), ts).join(labels.select(*TILE), TILE, "left_semi")
    packed = pack(d, TILE, [image, target])
    # The arrays hold every pixel of a tile, so the coverage needs no second pass over the pixels.
    covered = F.size(F.filter(target, lambda x: F.coalesce(x > cover_theta, F.lit(False)))) / F.col("n")
    return labels.select(*TILE, *keep).join(packed.withColumn("coverage", covered), TILE)
