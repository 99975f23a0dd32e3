"""From a tracker and a folder of files to results, city by city where it must be.

Cities are resolved and checked as rows of one table, and those without an area or
reference go to the status table.  All others run in one plan.  Only if that
fails are the cities halved, again and again, until the bad ones stand alone; the
rest are kept.  Tables are partitioned by city and a run replaces the partitions
of its own cities, so a rerun does what is missing and no more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions import geometry
from gridproof.operators import dissolve, extract, inventory
from gridproof.plans import validate
from gridproof.sources import readers, sinks
from gridproof.sources.config import Settings
from gridproof.sources.geoparquet import read_geoparquet
from gridproof.sources.scratch import written

STATUS = "city string, status string, problem string, finished timestamp"
#: Columns that readers give: footprints in degrees or metres.
_SHAPE = ("ring", "holes")


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Validation tracker with row_id, dataset_folder_name, aoi_file_name, suitable and reference_file, found by parts of their headers."""
    raw = readers.read_strings(spark, path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])

    def named(*parts: str):
        name = next((c for c in raw.columns if all(p in c.lower() for p in parts)), None)
        return F.col(f"`{name}`") if name else F.lit(None).cast("string")

    # without a column that says so, every row is suitable
    suitable = named("suitable") if any("suitable" in c.lower() for c in raw.columns) else F.lit("yes")
    return raw.select(F.monotonically_increasing_id().alias("row_id"), "dataset_folder_name", "aoi_file_name", suitable.alias("suitable"), named("reference", "file").alias("reference_file"))


def wanted_files(tracker: DataFrame) -> DataFrame:
    """city, slug, kind (aoi, reference), sub_aoi_id and path below the data folder of every file that the tracker names."""
    tracker = written(tracker)
    areas = inventory.validation_areas(tracker).select(F.col("dataset").alias("city"), "slug", F.lit("aoi").alias("kind"), "sub_aoi_id", "path")
    refs = inventory.tracked_references(tracker).select(F.col("dataset").alias("city"), "slug", F.lit("reference").alias("kind"), F.lit(None).cast("string").alias("sub_aoi_id"), F.explode_outer("ref_paths").alias("path"))
    return areas.unionByName(refs)


def resolve(wanted: DataFrame, listing: DataFrame, root: str, candidates: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(files that are there: city, kind, sub_aoi_id, dataset, file; a status row for each city).

    listing has ``path``, as of ``list_files``.  A candidate is the first file in
    order of ``<city>/vector/<slug>_<name>*.parquet``; a slug has no hyphens.
    """
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) + "/"
    there = written(listing.select(F.col("path").alias("file"), F.regexp_replace("path", f"^.*?{re.escape(base)}", "").alias("path")))
    wanted = written(wanted)
    found = wanted.join(there, "path", "left")
    cities = wanted.select("city", "slug").distinct()
    names = F.array(*[F.lit(n) for n in candidates]) if candidates else F.array().cast("array<string>")
    parts = F.split("path", "/")
    here = there.where((F.size(parts) == 3) & (parts[1] == "vector") & F.lower("path").endswith(".parquet")).select("file", parts[0].alias("city"), parts[2].alias("name"))
    own = cities.select("city", F.regexp_replace(F.lower("slug"), "-", "_").alias("_s"), F.explode(names).alias("dataset"))
    # meet by city and by the start of the name
    first = here.join(own, "city").where(F.expr("startswith(name, concat(_s, '_', dataset))")).groupBy("city", "dataset").agg(F.min_by("file", "name").alias("file"))
    files = found.where("file is not null").select("city", "kind", "sub_aoi_id", F.lit(None).cast("string").alias("dataset"), "file")
    files = written(files.unionByName(first.select("city", F.lit("candidate").alias("kind"), F.lit(None).cast("string").alias("sub_aoi_id"), "dataset", "file")))
    count = files.groupBy("city").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("aoi", "reference", "candidate")])
    missing = found.where("file is null and path is not null").groupBy("city").agg(F.concat_ws(" | ", F.sort_array(F.collect_set("path"))).alias("_missing"))
    status = cities.select("city").distinct().join(count, "city", "left").join(missing, "city", "left")
    problem = F.when(F.coalesce("_aoi", F.lit(0)) == 0, "no area file").when(F.coalesce("_reference", F.lit(0)) == 0, "no reference file").when(F.coalesce("_candidate", F.lit(0)) == 0, "no candidate file")
    note = F.when(F.col("_missing").isNotNull(), F.concat(F.lit("missing: "), F.col("_missing")))
    status = status.select("city", F.when(problem.isNotNull(), "skipped").otherwise("ready").alias("status"), F.concat_ws("; ", problem, note).alias("problem"))
    return files, status


def read_shapes(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """file, ring and holes in degrees of the polygons of GeoJSON and GeoParquet files, which may lie in different planes."""
    out = None
    jsons = [f for f in files if f.lower().endswith((".geojson", ".json"))]
    tables = [f for f in files if f.lower().endswith((".parquet", ".geoparquet"))]
    if other := sorted(set(files) - set(jsons) - set(tables)):
        raise ValueError(f"no reader for {other}")
    if jsons:
        out = readers.read_geojson(spark, jsons, file=True).select("file", *_SHAPE)
    for f in tables:
        rows, _, epsg = read_geoparquet(spark, f)
        rows = rows.select(F.lit(f).alias("file"), *_SHAPE)
        if epsg != 4326:
            if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 or epsg == 3857):
                raise ValueError(f"{f}: EPSG:{epsg} is neither degrees, UTM nor Mercator")
            rows = _moved(rows, _to_degrees(epsg))
        out = rows if out is None else out.unionByName(rows)
    return out


def _to_degrees(epsg: int) -> Callable:
    if epsg == 3857:
        return lambda p: geometry.inverse_mercator(p["x"], p["y"])
    return lambda p: geometry.inverse_utm(p["x"], p["y"], F.lit(epsg % 100), epsg > 32700)


def _moved(df: DataFrame, to: Callable) -> DataFrame:
    return df.withColumns({"ring": F.transform("ring", to), "holes": F.transform("holes", lambda h: F.transform(h, to))})


def load_cities(spark: SparkSession, files: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, candidates, areas) in metres of the zone in the middle of each city's areas, with bld_id, box and area_m2; written."""
    listed = files.collect()  # a row for each file
    shapes = read_shapes(spark, sorted({r["file"] for r in listed}))
    # names of files as Spark writes them differ in the scheme alone
    key = F.regexp_replace("file", "^file:/*", "/")
    shapes = shapes.withColumn("file", key)
    files = files.withColumn("file", key)
    if settings.vector.fix_invalid_geoms:
        shapes = dissolve.repair(shapes).drop("area_m2")
    degrees = written(files.join(shapes, "file"))
    b = geometry.ring_bounds("ring")
    areas = degrees.where("kind = 'aoi'")
    middle = areas.groupBy("city").agg(((F.min(b["xmin"]) + F.max(b["xmax"])) / 2).alias("_x"), ((F.min(b["ymin"]) + F.max(b["ymax"])) / 2).alias("_y"))
    planes = written(middle.select("city", geometry.utm_zone("_x").alias("zone"), (F.col("_y") < 0).alias("south")))

    def plane(p):
        # one northing for a whole city, also across the equator
        at = geometry.utm(p["x"], p["y"], "zone")
        shift = F.when(F.col("south"), 10000000.0).otherwise(0.0) - F.when(p["y"] < 0, 10000000.0).otherwise(0.0)
        return F.struct(at["x"].alias("x"), (at["y"] + shift).alias("y"))

    def metres(df: DataFrame) -> DataFrame:
        out = _moved(df.join(planes, "city"), plane)
        return out.withColumns({k: b[k] for k in geometry.BOX} | {"area_m2": geometry.polygon_area("ring", "holes")})

    box = [*_SHAPE, *geometry.BOX, "area_m2"]
    areas = written(metres(areas).select("city", "sub_aoi_id", *box))
    own = metres(degrees.where("kind <> 'aoi'")).where(F.col("area_m2") >= settings.vector.min_area_m2).withColumn("bld_id", F.monotonically_increasing_id())
    own = written(own.select("city", "kind", "dataset", "bld_id", *box))
    refs = own.where("kind = 'reference'").drop("kind", "dataset")
    return refs, own.where("kind = 'candidate'").drop("kind"), areas


def isolated(names: Sequence[str], work: Callable[[list[str]], None]) -> dict[str, str]:
    """Runs ``work`` on all names at once, and on halves of those where it failed; the failures of single names."""
    if not names:
        return {}
    try:
        work(list(names))
        return {}
    except Exception as e:
        if len(names) == 1:
            return {names[0]: _said(e)}
    half = len(names) // 2
    return isolated(names[:half], work) | isolated(names[half:], work)


def _said(e: Exception) -> str:
    """The first line of an error, and of what caused it inside Spark."""
    cause = getattr(e, "java_exception", None)
    text = str(cause.toString()) if cause is not None else f"{type(e).__name__}: {e}"
    return text.splitlines()[0][:500]


def latest_status(spark: SparkSession, root: str) -> DataFrame:
    """The last status of each city."""
    path = f"{root.rstrip('/')}/status"
    rows = spark.read.schema(STATUS).parquet(path) if sinks.exists(spark, path) else spark.createDataFrame([], STATUS)
    return rows.groupBy("city").agg(F.max_by(F.struct("status", "problem", "finished"), "finished").alias("s")).select("city", "s.*")


def _note(spark: SparkSession, root: str, rows: list[tuple[str, str, str | None]]) -> None:
    now = datetime.now(UTC).replace(tzinfo=None)
    if rows:
        spark.createDataFrame([(*r, now) for r in rows], STATUS).coalesce(1).write.mode("append").parquet(f"{root}/status")


def validate_cities(spark: SparkSession, settings: Settings) -> DataFrame:
    """Runs the vector validation of all cities of the tracker that aren't finished, or of all with ``overwrite``; their status.

    status is finished, failed or skipped; the tables below ``output.root_dir``
    hold the finished cities, partitioned by city, and roll-ups over all of them.
    The driver holds the names of cities and files.
    """
    root, data = settings.output.root_dir.rstrip("/"), settings.data_dir.rstrip("/")
    names = [c.name for c in settings.vector.datasets if c.enabled]
    files, status = resolve(wanted_files(read_tracker(spark, settings.aoi_tracker)), readers.list_files(spark, data), data, names)
    ready = {r["city"]: r["problem"] for r in status.where("status = 'ready'").collect()}
    _note(spark, root, [tuple(r) for r in status.where("status = 'skipped'").select("city", "status", "problem").collect()])
    if not settings.output.overwrite:
        for r in latest_status(spark, root).where("status = 'finished'").collect():
            ready.pop(r["city"], None)

    def work(batch: list[str]) -> None:
        refs, cands, areas = load_cities(spark, files.where(F.col("city").isin(batch)), settings)
        lacking = set(batch) - {r["city"] for r in refs.select("city").distinct().collect()}
        if lacking:
            raise ValueError(f"no reference footprints: {', '.join(sorted(lacking))}")

        def table(name: str, df: DataFrame, csv: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
            path, kept = f"{root}/{name}", tuple(dict.fromkeys(("city", *by)))
            # a city that has no rows now keeps none of an earlier run
            sinks.drop_partitions(spark, path, "city", batch)
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*kept).parquet(path)
            return spark.read.schema(df.schema).parquet(path).where(F.col("city").isin(batch)).select(*df.columns)

        validate.vector_tables(refs.drop("holes"), cands.drop("holes"), areas, settings, table)
        _note(spark, root, [(c, "finished", ready[c] or None) for c in batch])

    failed = isolated(sorted(ready), work)
    _note(spark, root, [(c, "failed", p) for c, p in failed.items()])
    last = written(latest_status(spark, root))
    done = last.where("status = 'finished'").select("city")
    if ready and not done.isEmpty():
        tables = {n: spark.read.parquet(f"{root}/{n}").withColumn("city", F.col("city").cast("string")).join(done, "city", "left_semi") for n in ("city_summary", "tile_metrics", "matches")}
        for name, df in validate.roll_ups(tables["city_summary"], tables["tile_metrics"], tables["matches"]).items():
            sinks.write_table(df, f"{root}/{name}", overwrite=True, csv=True)
    return last
