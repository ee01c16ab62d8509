"""Grids and points as text files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "row int, col int, z double"


def _parse(text: str) -> Iterator[tuple[int, int, float | None]]:
    header: dict[str, float] = {}
    row = 0
    for line in text.splitlines():
        parts = line.split()
        if not parts:
            continue
        if parts[0][0].isalpha():
            header[parts[0].lower()] = float(parts[1])
            continue
        blank = header.get("nodata_value", -9999.0)
        for col, v in enumerate(parts):
            z = float(v)
            yield row, col, None if z == blank else z
        row += 1


def read_arc_ascii(spark: SparkSession, path: str) -> DataFrame:
    """Rasters in Arc ASCII form as (row, col, z); the NoData value becomes NULL. Each file is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                rows = list(_parse(text))
                for i in range(0, len(rows), 100_000):
                    yield pd.DataFrame(rows[i : i + 100_000], columns=["row", "col", "z"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)


def write_arc_ascii(raster: DataFrame, path: str, cell_size: float = 1.0, nodata: float = -9999.0) -> None:
    """A folder whose parts, in order, are the file: a header, then one line for each row."""
    box = raster.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    header = [f"ncols {box['c'] + 1}", f"nrows {box['r'] + 1}", "xllcorner 0", "yllcorner 0", f"cellsize {cell_size}", f"NODATA_value {nodata}"]
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("z", F.lit(nodata)).alias("z")))), lambda s: s["z"].cast("string"))
    lines = raster.groupBy("row").agg(F.array_join(cells, " ").alias("value"))
    top = raster.sparkSession.createDataFrame([(i - len(header), h) for i, h in enumerate(header)], "row int, value string")
    top.unionByName(lines).repartitionByRange("row").sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)


def read_csv_points(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points of a CSV file with a header; the coordinate columns become x and y."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.withColumnsRenamed({x: "x", y: "y"})


def write_table_csv(features: DataFrame, path: str, header: bool = True) -> None:
    """The attribute table, without geometry."""
    features.drop("parts").write.mode("overwrite").csv(path, header=header)
