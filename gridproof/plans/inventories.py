"""The tables of an inventory run: codes of a sheet held against the files of a drive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridproof.operators import inventory
from gridproof.sources.scratch import written
from gridproof.sources.sinks import exists


def write_inventory(sheet: DataFrame, items: DataFrame, root: str, overwrite: bool = False, high_quality_only: bool = True) -> dict[str, bool]:
    """Writes six CSV tables, each in its own order, and says which were written; a complete one stays unless overwriting is asked for.

    sheet has row_id, code and quality, items those of ``inventory.file_tree``.
    Tree, matches and summary are worked out once.
    """
    drive = written(inventory.file_tree(items))
    matches = written(inventory.match_candidates(sheet, drive))
    summary = written(inventory.download_summary(sheet, drive, matches))
    tables = {
        "summary": inventory.listed(summary, "row_id"),
        "file_manifest": inventory.file_manifest(summary, drive, high_quality_only),
        "unmatched_codes": inventory.unmatched_codes(summary),
        "duplicate_matches": inventory.duplicate_matches(matches, sheet),
        "duplicate_codes": inventory.listed(inventory.duplicate_codes(summary), "code_norm"),
        "aoi_ref_listing": inventory.file_listing(summary, drive),
    }
    done = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        done[name] = overwrite or not exists(df.sparkSession, path)
        if done[name]:
            df.write.mode("overwrite").option("header", True).csv(path)
    return done
