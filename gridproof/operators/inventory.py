"""Trackers of areas and inventories of files, and the match of dataset codes to folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.names import code_keys, folder_keys, joined_distinct, match_score, name_parts, pipe_values, quality_flag, slug, sub_area_id, truthy
from gridproof.sources.scratch import written


def tracked_areas(tracker: DataFrame, suitable_only: bool = True, high_quality_only: bool = False) -> DataFrame:
    """One row for each area file of a download tracker: dataset, slug, file_name, path, sub_aoi_id, is_multi_aoi.

    Rows need an area file (has_aoi_file says TRUE), an id, and, where asked for,
    "yes" as suitable and TRUE as is_high_quality; NULL fails either.
    """
    kept = tracker.where((F.upper(F.trim("has_aoi_file")) == "TRUE") & F.col("dataset_folder_name").isNotNull() & (F.trim("aoi_file_name") != ""))
    if suitable_only:
        kept = kept.where(F.lower(F.trim("suitable")) == "yes")
    if high_quality_only:
        kept = kept.where(F.upper(F.trim("is_high_quality")) == "TRUE")
    return _area_files(kept)


def validation_areas(tracker: DataFrame) -> DataFrame:
    """The same of a validation tracker, whose rows need an id that isn't blank and "yes" in any case, without blanks, as suitable."""
    return _area_files(_suitable(tracker))


def _suitable(tracker: DataFrame) -> DataFrame:
    return tracker.where((F.lower("suitable") == "yes") & (F.trim("dataset_folder_name") != ""))


def _area_files(tracker: DataFrame) -> DataFrame:
    """Area files of all rows of a dataset; it has many areas if it has many files."""
    names = tracker.select(F.col("dataset_folder_name").alias("dataset"), F.explode(pipe_values("aoi_file_name")).alias("file_name"))
    many = F.count("*").over(Window.partitionBy("dataset")) > 1
    path = F.concat_ws("/", "dataset", F.lit("aoi"), "file_name")
    return names.select("dataset", slug("dataset").alias("slug"), "file_name", path.alias("path"), sub_area_id("file_name").alias("sub_aoi_id"), many.alias("is_multi_aoi"))


def tracked_references(tracker: DataFrame) -> DataFrame:
    """Each dataset of a validation tracker with the distinct reference paths of its rows in their first order, and ref_path where there is one only.

    Rows are in order of ``row_id``; a NULL list has no files.
    """
    at = F.struct("row_id", F.transform(pipe_values("reference_file"), lambda f: F.concat_ws("/", F.col("dataset_folder_name"), F.lit("vector"), f)).alias("paths"))
    per = _suitable(tracker).groupBy(F.col("dataset_folder_name").alias("dataset")).agg(F.sort_array(F.collect_list(at)).alias("rows"))
    out = per.select("dataset", slug("dataset").alias("slug"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["paths"]))).alias("ref_paths"))
    return out.withColumn("ref_path", F.when(F.size("ref_paths") == 1, F.get("ref_paths", 0)))


def match_candidates(sheet: DataFrame, inventory: DataFrame) -> DataFrame:
    """All codes and top folders whose names match: row_id, folder_id, dataset_folder_name, match_score, match_rule.

    Codes and folders meet on keys that any match shares (a token, five letters
    or the whole name), and the rules are then tried on what met.
    """
    codes = sheet.where(F.trim(F.coalesce("code", F.lit(""))) != "").select("row_id", name_parts("code").alias("c"))
    folders = inventory.where("level = 1 and is_folder").select(F.col("id").alias("folder_id"), F.col("name").alias("dataset_folder_name"), name_parts("name").alias("f"))
    met = codes.select("row_id", "c", F.explode(code_keys(F.col("c"))).alias("key")).join(folders.select("folder_id", "dataset_folder_name", "f", F.explode(folder_keys(F.col("f"))).alias("key")), "key")
    scored = met.withColumn("m", match_score(F.col("c"), F.col("f"))).where("m is not null")
    return scored.select("row_id", "folder_id", "dataset_folder_name", F.col("m.score").alias("match_score"), F.col("m.rule").alias("match_rule")).distinct()


def best_matches(matches: DataFrame) -> DataFrame:
    """Of each code the match with the highest score, then the first name; match_count counts distinct names."""
    order = Window.partitionBy("row_id").orderBy(F.col("match_score").desc(), "dataset_folder_name", "folder_id")
    counts = matches.groupBy("row_id").agg(F.countDistinct("dataset_folder_name").alias("match_count"))
    return matches.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").join(counts, "row_id")


def folder_of_files(inventory: DataFrame) -> DataFrame:
    """Files at any depth below a top folder, with dataset_folder_name; those outside any folder go."""
    return inventory.where(~F.col("is_folder") & F.col("top_folder").isNotNull()).withColumnRenamed("top_folder", "dataset_folder_name")


def download_summary(sheet: DataFrame, inventory: DataFrame, matches: DataFrame) -> DataFrame:
    """Every code with its best folder and that folder's files, zeros where there is none."""
    stats = folder_of_files(inventory).groupBy("dataset_folder_name").agg(F.count("id").alias("downloaded_files"), F.sum("size_bytes").alias("total_size_bytes"))
    ref = sheet.select("row_id", F.trim(F.coalesce("code", F.lit(""))).alias("code"), "quality", name_parts("code")["core_norm"].alias("code_norm"), quality_flag("quality").alias("is_high_quality"))
    out = ref.join(best_matches(matches), "row_id", "left").join(stats, "dataset_folder_name", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("match_count", "downloaded_files", "total_size_bytes")}
    out = out.withColumns(zero).withColumns({"downloaded": F.col("dataset_folder_name").isNotNull(), "ambiguous_match": F.col("match_count") > 1})
    return out.select("row_id", "code", "quality", "code_norm", "is_high_quality", "dataset_folder_name", "match_score", "match_rule", "match_count", "ambiguous_match", "downloaded", "downloaded_files", "total_size_bytes")


def unmatched_codes(summary: DataFrame) -> DataFrame:
    return summary.where(~F.col("downloaded")).select("row_id", "code", "quality", "is_high_quality", "code_norm").orderBy("row_id")


def duplicate_codes(summary: DataFrame) -> DataFrame:
    return summary.where("code_norm <> ''").groupBy("code_norm").agg(F.count("*").alias("duplicate_rows"), joined_distinct("code").alias("dataset_codes")).where("duplicate_rows > 1")


def duplicate_matches(matches: DataFrame, sheet: DataFrame) -> DataFrame:
    """All matches of codes that match several folders, with the code's columns."""
    counts = matches.groupBy("row_id").agg(F.countDistinct("dataset_folder_name").alias("candidate_folder_count")).where("candidate_folder_count > 1")
    codes = sheet.select("row_id", F.trim(F.coalesce("code", F.lit(""))).alias("code"), "quality", quality_flag("quality").alias("is_high_quality"))
    return listed(matches.join(counts, "row_id").join(codes, "row_id"), "code", "-match_score", "dataset_folder_name")


def listed(df: DataFrame, *by: str) -> DataFrame:
    """In order of columns, NULLs last; a minus makes a column go down."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in by])


def file_manifest(summary: DataFrame, inventory: DataFrame, high_quality_only: bool = True) -> DataFrame:
    """Files of matched folders with the code's columns, in order of code and path."""
    attach = summary.where("downloaded").select("code", "quality", "is_high_quality", "dataset_folder_name", "match_rule", "match_score", "ambiguous_match").distinct()
    out = folder_of_files(inventory).join(attach, "dataset_folder_name").select(*attach.columns, "path", "size_bytes", "modified_time", "id", "mime_type")
    return listed(out.where(F.coalesce("is_high_quality", F.lit(False))) if high_quality_only else out, "code", "path")


def file_listing(summary: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every row of the summary with the area and reference files of its folder, in order of code and folder."""
    files = folder_of_files(inventory)
    lower = F.lower("name")
    kinds = {"aoi": F.endswith(lower, F.lit("_aoi.geojson")), "reference": F.endswith(lower, F.lit("_ref.geojson")) | F.endswith(lower, F.lit("_hotosm.geojson"))}
    out = summary.select("row_id", "code", "quality", "is_high_quality", "dataset_folder_name", "match_rule", "match_score", "ambiguous_match")
    for kind, test in kinds.items():
        per = files.where(test).groupBy("dataset_folder_name").agg(joined_distinct("name").alias(f"{kind}_file_name"), joined_distinct("path").alias(f"{kind}_file_path"), F.count("id").alias(f"{kind}_file_count"))
        out = out.join(per, "dataset_folder_name", "left").withColumn(f"{kind}_file_count", F.coalesce(f"{kind}_file_count", F.lit(0)).cast("long"))
        out = out.withColumn(f"has_{kind}_file", F.col(f"{kind}_file_count") > 0)
    return listed(out, "code", "dataset_folder_name")


def quality_values(sheet: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent non-blank quality texts; of equal counts the first text."""
    v = F.trim("quality")
    return sheet.where(v != "").groupBy(v.alias("quality_value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "quality_value").limit(n)


def map_rows(listing: DataFrame) -> DataFrame:
    """Rows of the inventory map, one a dataset: any of the flags, the largest of the counts and scores (0 for none), sorted distinct area files and paths, and a marker radius."""
    from gridproof.functions.exprs import marker_radius

    def most(c: str):
        return F.coalesce(F.max(F.col(c).try_cast("double")), F.lit(0.0)).alias(c)

    def names(c: str):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(pipe_values(c))))).alias(f"{c}s")

    per = listing.where(F.trim("dataset") != "").groupBy(F.trim("dataset").alias("dataset")).agg(
        *[F.bool_or(truthy(c)).alias(c) for c in ("has_aoi_file", "has_reference_file")], *[most(c) for c in ("aoi_file_count", "reference_file_count", "match_score")], names("aoi_file_path"), names("aoi_file_name")
    )
    return per.withColumn("radius", marker_radius(F.greatest("aoi_file_count", "reference_file_count", F.lit(1.0))))


def file_tree(items: DataFrame) -> DataFrame:
    """Items (id, parent, name, and others) with level, path and the name of their top folder; roots have a NULL parent.

    A root that is a file, where ``is_folder`` says so, is in no top folder.
    Levels are joined one at a time until none is left, each written to the
    checkpoint folder, so a tree of any depth works.
    """
    top = F.when(F.col("is_folder"), F.col("name")) if "is_folder" in items.columns else F.col("name")
    level = written(items.where("parent is null").select(*items.columns, F.lit(1).alias("level"), F.col("name").alias("path"), top.alias("top_folder")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.col("level").alias("_l"), F.col("path").alias("_p"), "top_folder")
        level = written(items.join(up, "parent").select(*items.columns, (F.col("_l") + 1).alias("level"), F.concat_ws("/", "_p", "name").alias("path"), "top_folder"))
        out = out.unionByName(level)
    return out
