"""Command line: validate the files of a tracker, or tables.

    python -m gridproof cities settings.yaml
    python -m gridproof vector settings.yaml references candidates areas
    python -m gridproof raster settings.yaml references pixels areas

``cities`` reads the tracker, areas, references and candidates that the settings
name, works on the cities that aren't finished, and says how each stands.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from gridproof.plans.cities import validate_cities
from gridproof.plans.validate import validate_raster, validate_vector
from gridproof.sources.config import load


def main(args: list[str]) -> int:
    if len(args) != {"vector": 5, "raster": 5, "cities": 2}.get(args[0] if args else "", 0):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args[0] == "cities":
        rows = validate_cities(spark, load(args[1])).sort("city").collect()
        for r in rows:
            print(r["city"], r["status"], r["problem"] or "")
        return int(any(r["status"] == "failed" for r in rows))
    a, b, c = (spark.read.parquet(p) for p in args[2:])
    run = validate_vector if args[0] == "vector" else validate_raster
    for name, wrote in run(a, b, c, load(args[1])).items():
        print(name, "written" if wrote else "kept")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
