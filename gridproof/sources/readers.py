"""Sources: footprints, trackers, sheets, city summaries, file listings and pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridproof.functions.geometry import BOX, ring_area, ring_bounds, ring_to_utm
from gridproof.operators.extract import bbox_filter

_POINT = "array<array<double>>"
_FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:string>>"


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; GeoJSON as one row for each polygon with its outer ring; by suffix."""
    if path.lower().rstrip("/").endswith((".parquet", ".geoparquet")):
        return spark.read.parquet(path)
    if path.lower().endswith((".geojson", ".json")):
        return read_geojson(spark, path)
    raise ValueError(f"no reader for {path}")


def read_geojson(spark: SparkSession, path: str | list[str], file: bool = False) -> DataFrame:
    """feature (number in its file), properties (JSON), ring, holes, xmin, ymin, xmax, ymax, and the file where asked for.

    Features without a readable polygon go, as do outer rings of fewer than four
    points and holes of fewer.
    """
    raw = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    if file:
        raw = raw.select("features", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"))
    more = ["file"] if file else []
    rows = raw.select(*more, F.posexplode("features").alias("feature", "f")).select(*more, "feature", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", f"array<{_POINT}>"))
    many = F.from_json("c", f"array<array<{_POINT}>>")
    polygons = F.when(F.col("kind") == "Polygon", one).when(F.col("kind") == "MultiPolygon", many)
    rings = rows.select(*more, "feature", "properties", F.explode(polygons).alias("p")).where("size(p) > 0 and size(p[0]) >= 4")

    def points(r):
        return F.transform(r, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))

    inner = F.filter(F.slice("p", F.lit(2), F.greatest(F.lit(0), F.size("p") - 1)), lambda r: F.size(r) >= 4)
    out = rings.withColumns({"ring": points(F.get("p", F.lit(0))), "holes": F.transform(inner, points)}).drop("p")
    xs, ys = F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
    return out.select("*", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def read_extract(spark: SparkSession, base: str, bounds: tuple[float, float, float, float], theme: str | None = None, kind: str | None = None) -> DataFrame:
    """Footprints of a hive layout theme=/type= whose bbox column meets the bounds; partitions are pruned and bounds pushed down."""
    df = spark.read.option("basePath", base).parquet(base)
    if theme is not None:
        df = df.where(F.col("theme") == theme)
    if kind is not None:
        df = df.where(F.col("type") == kind)
    return df.where(bbox_filter(bounds))


def load_buildings(df: DataFrame, min_area: float = 20.0, ring: str | None = "ring", zone: str | int | None = None) -> DataFrame:
    """Footprints with a valid ring or box and at least the area, with area_m2, less their ``holes`` where they have such.

    With ``zone`` (a UTM zone, or the column that has it) rings and holes of
    degrees are projected to it first, and boxes follow the rings.
    """
    if ring is not None and ring in df.columns:
        from gridproof.operators.polygon_metrics import valid_rings

        holes = "holes" in df.columns
        if zone is not None:
            z = F.col(zone) if isinstance(zone, str) else F.lit(zone)
            df = df.withColumn(ring, ring_to_utm(ring, z))
            if holes:
                df = df.withColumn("holes", F.transform("holes", lambda h: ring_to_utm(h, z)))
            b = ring_bounds(ring)
            df = df.withColumns({k: b[k] for k in BOX})
        out = valid_rings(df, ring)
        if holes:
            out = out.withColumn("area_m2", F.col("area_m2") - F.coalesce(F.aggregate("holes", F.lit(0.0), lambda a, h: a + ring_area(h)), F.lit(0.0)))
        return out.where(F.col("area_m2") >= min_area)
    box = df.where("xmin is not null and ymin is not null and xmax > xmin and ymax > ymin")
    return box.withColumn("area_m2", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).where(F.col("area_m2") >= min_area)


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with every column a string; short rows are filled with NULL and long ones cut."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    if columns:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", True).csv(path)
    return reader.option("inferSchema", False).csv(path)


def read_city_summaries(spark: SparkSession, root: str, name: str, overwrite_city: bool = True) -> DataFrame:
    """Files root/<city>/<name>.parquet of all cities, or name.csv in cities without; city comes from the folder, or only where it is missing."""
    def of(kind: str) -> DataFrame | None:
        pattern = f"{root.rstrip('/')}/*/{name}.{kind}"
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            return None
        df = spark.read.option("mergeSchema", True).parquet(pattern) if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(pattern)
        folder = F.element_at(F.split(F.regexp_replace(F.col("_metadata.file_path"), rf"/{name}\.{kind}.*$", ""), "/"), -1)
        city = folder if overwrite_city or "city" not in df.columns else F.coalesce(F.col("city").cast("string"), folder)
        return df.withColumns({"city": city, "_folder": folder})

    first, second = of("parquet"), of("csv")
    if first is None and second is None:
        raise FileNotFoundError(f"no {name}.parquet or {name}.csv below {root}")
    if first is None or second is None:
        return (second if first is None else first).drop("_folder")
    rest = second.join(first.select("_folder").distinct(), "_folder", "left_anti")
    return first.unionByName(rest, allowMissingColumns=True).drop("_folder")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, size_bytes and modified_time of all files below a folder; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"))


def read_pixels(spark: SparkSession, path: str, resolution: float) -> DataFrame:
    """A pixel table with its corners on the grid; NaN is no data."""
    df = spark.read.parquet(path)
    value = F.when(~F.isnan(F.col("value")), F.col("value"))
    snap = {c: F.floor(F.col(c) / resolution + 1e-9) * float(resolution) for c in ("x", "y")}
    return df.withColumns(snap | {"value": value})
