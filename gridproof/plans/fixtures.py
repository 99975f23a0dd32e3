"""Footprints, pixels, trackers and inventories derived from the test tables by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 3000.0
#: Corner of the area of city number c, in metres of a plane projection; quarters are exact in both engines.
CORNER = ("(350000.25D + 4200.5D * ({c}))", "(5200000.75D - 3900.25D * ({c}))")


def corner(axis: int, c: str) -> str:
    return CORNER[axis].format(c=c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str, min_area: float = 20.0) -> DataFrame:
    """One box for each order: city, bld_id, xmin, ymin, xmax, ymax, area_m2."""
    k = table(spark, sf_dir, "orders").select(
        F.expr("concat('city_', o_orderkey % 4)").alias("city"),
        F.col("o_orderkey").alias("bld_id"),
        F.expr(f"cast((o_orderkey * 7919) % 3001 as double) + {corner(0, 'o_orderkey % 4')}").alias("xmin"),
        F.expr(f"cast((o_orderkey * 104729) % 3001 as double) + {corner(1, 'o_orderkey % 4')}").alias("ymin"),
        F.expr("cast(4 + o_orderkey % 23 as double)").alias("w"),
        F.expr("cast(4 + (o_orderkey * 13) % 17 as double)").alias("h"),
    )
    return k.selectExpr("city", "bld_id", "xmin", "ymin", "xmin + w as xmax", "ymin + h as ymax", "w * h as area_m2").where(F.col("area_m2") >= min_area)


def candidates(spark: SparkSession, sf_dir: str, min_area: float = 20.0) -> DataFrame:
    """Shifted and resized boxes of three datasets, with city and dataset."""
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "explode(array(0, 1, 2)) as d").where("(k * 31 + d * 17) % 10 < 9")
    k = k.selectExpr(
        "concat('city_', k % 4) as city",
        "concat('ds_', d) as dataset",
        "k * 3 + d as bld_id",
        f"cast((k * 7919) % 3001 + if(k % 12 = d, 1500, (k * (d + 3)) % 5 - 2) as double) + {corner(0, 'k % 4')} as xmin",
        f"cast((k * 104729) % 3001 + (k * (d + 5)) % 5 - 2 as double) + {corner(1, 'k % 4')} as ymin",
        "cast(4 + k % 23 + (k + d) % 3 - 1 as double) as w",
        "cast(4 + (k * 13) % 17 + (2 * k + d) % 3 - 1 as double) as h",
    )
    return k.selectExpr("city", "dataset", "bld_id", "xmin", "ymin", "xmin + w as xmax", "ymin + h as ymax", "w * h as area_m2").where(F.col("area_m2") >= min_area)


def areas(spark: SparkSession) -> DataFrame:
    """One square area of interest for each of four cities."""
    x, y = corner(0, "id"), corner(1, "id")
    return spark.range(4).selectExpr("concat('city_', id) as city", f"{x} as xmin", f"{y} as ymin", f"{x} + {SIDE}D as xmax", f"{y} + {SIDE}D as ymax")


def sub_areas(spark: SparkSession) -> DataFrame:
    """Three overlapping parts of each area, with gaps."""
    x, y = corner(0, "id % 4"), corner(1, "id % 4")
    return spark.range(12).selectExpr(
        "concat('city_', id % 4) as city", "concat('part_', id div 4) as sub_aoi_id", f"(id div 4) * 900 + {x} as xmin", f"100 + {y} as ymin", f"(id div 4) * 900 + 950 + {x} as xmax", f"2500 + {y} as ymax"
    )


def pixels(spark: SparkSession, resolution: int = 20, side: int = int(SIDE) + 20) -> DataFrame:
    """Native cells of one raster for each city and product: city, dataset, row, col, x, y (lower left), value.

    Cells lie on multiples of the resolution, from the last one before the city's corner, and cover its area.

    ``products`` are a share product and a time-code product; every 29th cell is NULL.
    """
    n = side // resolution
    cells = spark.range(4 * 2 * n * n).selectExpr(f"id div {2 * n * n} as c", f"(id div {n * n}) % 2 as p", f"(id div {n}) % {n} as row", f"id % {n} as col")
    key = "c * 31 + p * 17 + row * 7 + col * 3"
    value = f"if(({key}) % 29 = 0, null, if(p = 0, (({key}) % 101) / 100D, cast(({key}) % 25 as double)))"
    return cells.selectExpr("concat('city_', c) as city", "if(p = 0, 'share', 'codes') as dataset", "row", "col", f"(col + floor({corner(0, 'c')} / {resolution})) * {resolution}D as x", f"(row + floor({corner(1, 'c')} / {resolution})) * {resolution}D as y", f"{value} as value")


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String rows for each nation, some for two rows of one dataset, with lists in bars, flags of several spellings and names in mixed case."""
    name = "if(n_nationkey % 4 < 2, lower(n_name), concat(initcap(n_name), '-City ', n_nationkey))"
    rows = table(spark, sf_dir, "nation").selectExpr("*", f"{name} as name", "explode(if(n_nationkey % 3 = 0, array(0, 1), array(0))) as again")
    return rows.selectExpr(
        "cast(n_nationkey * 2 + again as bigint) as row_id",
        "if(n_nationkey = 24, if(again = 0, ' ', null), name) as dataset_folder_name",
        "if(again = 1, concat(' ', name, '_2_AOI.geojson '), concat_ws('|', concat(name, '_1_aoi.geojson'), if(n_nationkey % 6 = 1, 'Part_b.gpkg', null), '')) as aoi_file_name",
        "if(n_nationkey % 7 = 6, null, concat_ws('|', concat(name, '_ref.geojson'), concat(name, '_ref.geojson'), if(n_nationkey % 4 = 0 or again = 1, 'extra_ref.geojson', null))) as reference_file",
        "element_at(array('TRUE', 'True', ' true ', 'FALSE', ''), cast(n_nationkey % 5 + 1 as int)) as has_aoi_file",
        "element_at(array('yes', 'Yes ', 'YES', 'unsuitable', 'unsuitable for use', 'high', null, 'no'), cast(n_nationkey % 8 + 1 as int)) as suitable",
        "element_at(array('TRUE', ' true', 'no', null), cast(n_nationkey % 4 + 1 as int)) as is_high_quality",
    )


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset codes: row_id, code, quality; some blank, some repeated in other spelling."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as row_id",
        "case when n_nationkey % 11 = 10 then ' ' when n_nationkey % 8 = 3 then 'Data FRANCE final' when n_nationkey % 5 = 4 then concat('Dataset_', upper(n_name), '-v2') else lower(n_name) end as code",
        "element_at(array('yes', 'No', 'high quality', 'unsuitable', null), cast(n_nationkey % 5 + 1 as int)) as quality",
    )


def drive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a drive: top folders for most nations, folders below some to the third level, and parts as files at every level."""
    none = "cast(null as string)"
    folder = "true as is_folder", "'folder' as mime_type", "cast(0 as bigint) as size_bytes", f"{none} as modified_time"
    nation = table(spark, sf_dir, "nation")
    named = "case n_nationkey % 4 when 0 then lower(n_name) when 1 then concat('dataset_', lower(n_name), '_final') when 2 then concat(lower(n_name), '_2021') else concat('old ', upper(n_name), ' copies') end as name"
    out = nation.where("n_nationkey % 6 <> 5").selectExpr("concat('f', n_nationkey) as id", named, *folder, f"{none} as parent")
    out = out.unionByName(nation.where("n_nationkey % 8 = 0").selectExpr("concat('g', n_nationkey) as id", "concat(lower(n_name), '_backup') as name", *folder, f"{none} as parent"))
    out = out.unionByName(nation.where("n_nationkey % 3 = 0").selectExpr("concat('s', n_nationkey) as id", "'Vector' as name", *folder, "concat('f', n_nationkey) as parent"))
    out = out.unionByName(nation.where("n_nationkey % 2 = 0").selectExpr("concat('t', n_nationkey) as id", "'aoi' as name", *folder, "concat('s', n_nationkey) as parent"))
    files = table(spark, sf_dir, "part").selectExpr(
        "concat('p', p_partkey) as id",
        "concat('tile', p_partkey, case p_partkey % 4 when 0 then '_AOI.geojson' when 1 then '_ref.geojson' when 2 then '_hotosm.geojson' else '.tif' end) as name",
        "false as is_folder", "if(p_partkey % 4 = 3, 'image/tiff', 'application/json') as mime_type", "cast(p_size as bigint) * 1000 as size_bytes", "concat('2024-01-', p_size) as modified_time",
        "if(p_partkey % 50 = 7, null, concat(element_at(array('f', 's', 't', 'g', 'f'), cast(p_partkey % 5 + 1 as int)), p_partkey % 24)) as parent",
    )
    return out.unionByName(files)


def map_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of area and reference files, a row or two for each nation, with flags, counts and scores as texts."""
    return table(spark, sf_dir, "nation").selectExpr("*", "explode(array(0, 1)) as again").where("again = 0 or n_nationkey % 3 = 0").selectExpr(
        "concat(' ', n_name, if(again = 1, ' ', '')) as dataset",
        "element_at(array('TRUE', '0', 'y', '', null), cast((n_nationkey + again) % 5 + 1 as int)) as has_aoi_file",
        "element_at(array('False', '1', null), cast((n_nationkey + again) % 3 + 1 as int)) as has_reference_file",
        "element_at(array('3', 'n/a', '40', null), cast((n_nationkey + again) % 4 + 1 as int)) as aoi_file_count",
        "element_at(array('x', '12', null, '2.5', '0'), cast((n_nationkey + 2 * again) % 5 + 1 as int)) as reference_file_count",
        "if(n_nationkey % 2 = 0, cast(80 + n_nationkey + again as string), 'none') as match_score",
        "concat('a/', n_name, '_', again, '.geojson | b/x.geojson') as aoi_file_path",
        "concat(n_name, '_', again, '.geojson|x.geojson| ') as aoi_file_name",
    )
