"""The six tables of an inventory run."""

from gridproof import queries
from gridproof.plans import fixtures as fx
from gridproof.plans.inventories import write_inventory

SF = "/root/testdata/sf0.001"


def test_six_tables(spark, tmp_path):
    sheet, items = fx.sheet(spark, SF), fx.drive_items(spark, SF)
    assert all(write_inventory(sheet, items, str(tmp_path)).values())
    assert not any(write_inventory(sheet, items, str(tmp_path)).values())
    counts = {p.name: spark.read.option("header", True).csv(str(p)).count() for p in tmp_path.iterdir()}
    same = {"summary": queries.download_summary, "file_manifest": queries.file_manifest, "unmatched_codes": queries.unmatched_codes, "duplicate_matches": queries.duplicate_matches, "duplicate_codes": queries.duplicate_codes, "aoi_ref_listing": queries.aoi_ref_listing}
    assert counts == {k: q(spark, SF).count() for k, q in same.items()}
    codes = [r.code for r in spark.read.option("header", True).csv(str(tmp_path / "file_manifest")).collect()]
    assert codes == sorted(codes)


def test_empty(spark, tmp_path):
    sheet, items = fx.sheet(spark, SF).limit(0), fx.drive_items(spark, SF).limit(0)
    assert len(write_inventory(sheet, items, str(tmp_path))) == 6
