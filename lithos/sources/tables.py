"""Files in and out: CSV, GeoJSON, plan documents as JSON, ASCII point clouds, and full refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.islands import voxels


def catalog_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The catalog's sheet as CSV: columns renamed by position, rows without a build-up left out."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.toDF(*names).where(F.col("mat").isNotNull())


def merged_csv(spark: SparkSession, features: str, context: str, key: str = "fid") -> DataFrame:
    """Features with their context; buildings without neighbours have counts and sums of 0."""
    left, right = (spark.read.csv(x, header=True, inferSchema=True) for x in (features, context))
    return left.join(right, key, "left").fillna(0, [c for c in ("n_nb", "sum") if c in right.columns])


def geojson_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A feature collection: a row per outer ring, with properties(DDL) and ring (points x, y)."""
    shape = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("_t"), F.col("f.geometry.coordinates").alias("_c"))
    one = F.array(F.from_json("_c", "array<array<array<double>>>"))
    many = F.from_json("_c", "array<array<array<array<double>>>>")
    f = f.withColumn("_polygon", F.explode(F.when(F.col("_t") == "MultiPolygon", many).otherwise(one)))
    ring = F.transform(F.get("_polygon", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return f.withColumn("ring", ring).drop("_t", "_c", "_polygon")


def plan_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, unreadable ones left out, the latest first."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").where("id IS NOT NULL").orderBy(F.col("updatedAt").desc_nulls_last(), "id")


def ascii_points(spark: SparkSession, path: str, voxel: float | None = 0.05) -> DataFrame:
    """scan_id (the file), x, y, z of XYZ and ASCII PLY files, averaged per voxel; header and other lines have no three
    leading numbers and are left out. Lines are read in splits, so no file is read by one task."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    fields = F.split(F.btrim("value"), r"[\s,;]+")
    rows = spark.read.text(path).where(F.col("value").rlike(rf"^\s*{number}[\s,;]+{number}[\s,;]+{number}(?:[\s,;].*)?$"))
    points = rows.select(F.col("_metadata.file_path").alias("scan_id"), *[F.get(fields, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    return points if voxel is None else voxels(points, voxel)


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def refresh(df: DataFrame, path: str) -> None:
    """Replace a table as a whole; running it again gives the same table."""
    df.write.mode("overwrite").parquet(path)
