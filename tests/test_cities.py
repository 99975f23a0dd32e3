"""Cities from files to tables: what is missing, what is broken, and what a rerun does."""

import json

import pytest

from gridproof.__main__ import main
from gridproof.plans import cities
from gridproof.sources import geoparquet
from gridproof.sources.config import build, Settings

RING = geoparquet.RING


def feature(points):
    return {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[x, y] for x, y in [*points, points[0]]]]}}


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def write_json(path, rings):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(r) for r in rings]}))


def footprints(lon, lat, n, shift=0.0):
    return [square(lon + 0.001 + 0.0004 * (k % 10) + shift, lat + 0.001 + 0.0004 * (k // 10), 0.0001) for k in range(n)]


@pytest.fixture
def world(spark, tmp_path):
    data = tmp_path / "data"
    places = {"Aa-one": (9.0, 50.0), "Bb two": (-70.0, -0.003), "cc": (20.0, 40.0), "dd": (30.0, 45.0), "ee": (31.0, 45.0)}
    for name, (lon, lat) in places.items():
        write_json(data / name / "aoi" / f"{name}_1_aoi.geojson", [square(lon, lat, 0.004), square(lon + 0.002, lat, 0.004)])
        if name != "cc":
            write_json(data / name / "vector" / "ref.geojson", footprints(lon, lat, 40))
        slug = name.lower().replace("-", "_").replace(" ", "_")
        rows = [(r, None) for r in footprints(lon, lat, 36, 0.00001)] + [([(lon, lat), (lon + 0.0002, lat + 0.0002), (lon + 0.0002, lat), (lon, lat + 0.0002)], None)]
        if name != "ee":
            geoparquet.write_geoparquet(spark.createDataFrame(rows, f"ring {RING}, holes array<{RING}>").coalesce(1), str(tmp_path / "staged"), overwrite=True, cell=0.01)
            part = next(p for p in (tmp_path / "staged").glob("part-*.parquet"))
            (data / name / "vector").mkdir(exist_ok=True)
            (data / name / "vector" / f"{slug}_osm_2024.parquet").write_bytes(part.read_bytes())
    broken = data / "dd" / "vector" / "dd_osm_2024.parquet"
    (tmp_path / "dd.good").write_bytes(broken.read_bytes())
    broken.write_bytes(b"PAR1 not really PAR1")
    tracker = ["dataset_folder_name,aoi_file_name, Suitable ,Reference file name", *[f"{n},{n}_1_aoi.geojson|nowhere.geojson,yes,ref.geojson" for n in places], "ff,x.geojson,no,ref.geojson", ",,yes,"]
    (tmp_path / "tracker.csv").write_text("\n".join(tracker))
    return tmp_path


def settings(world, **more):
    return build(Settings, {"data_dir": str(world / "data"), "aoi_tracker": str(world / "tracker.csv"), "vector": {"tile_size_m": 200.0, "tau_buffer_m": 0.0, "datasets": [{"name": "osm"}, {"name": "off", "enabled": False}]}, "output": {"root_dir": str(world / "out")} | more})


def test_bad_cities_fail_alone_and_a_rerun_does_the_rest(spark, world):
    got = {r.city: r for r in cities.validate_cities(spark, settings(world)).collect()}
    assert {c: r.status for c, r in got.items()} == {"Aa-one": "finished", "Bb two": "finished", "cc": "skipped", "dd": "failed", "ee": "skipped"}, got
    assert got["cc"].problem == "no reference file; missing: cc/aoi/nowhere.geojson | cc/vector/ref.geojson"
    assert got["ee"].problem.startswith("no candidate file")
    assert got["Aa-one"].problem == "missing: Aa-one/aoi/nowhere.geojson"
    summary = {r.city: r for r in spark.read.parquet(str(world / "out/city_summary")).collect()}
    assert set(summary) == {"Aa-one", "Bb two"}
    # on both sides of the equator a city is one plane, so footprints match wherever they lie
    for r in summary.values():
        assert r.tp_total >= 36
        assert r.recall_city > 0.85
        assert r.boundary_f_meanpair_tp > 0.9
    km2 = {r.city: r.n_ref_total / r.ref_density_per_km2 for r in summary.values()}
    # two overlapping squares of 0.004 degrees side by side, 0.006 by 0.004 in all
    assert km2["Bb two"] == pytest.approx(0.006 * 111.32 * 0.004 * 110.57, rel=0.01)
    roll = spark.read.parquet(str(world / "out/global_by_dataset")).collect()
    assert [(r.dataset, r.n_cities, r.n_sub_areas) for r in roll] == [("osm", 2, 2)]
    first = got["Aa-one"].finished

    # the broken city is mended; only it runs
    (world / "data/dd/vector/dd_osm_2024.parquet").write_bytes((world / "dd.good").read_bytes())
    again = {r.city: r for r in cities.validate_cities(spark, settings(world)).collect()}
    assert again["dd"].status == "finished"
    assert again["Aa-one"].finished == first
    assert spark.read.parquet(str(world / "out/global_by_dataset")).first().n_cities == 3
    none = {r.city: r for r in cities.validate_cities(spark, settings(world)).collect()}
    assert none["dd"].finished == again["dd"].finished


def test_command(spark, world, capsys):
    (world / "s.yaml").write_text(json.dumps({"data_dir": str(world / "data"), "aoi_tracker": str(world / "tracker.csv"), "vector": {"tile_size_m": 500.0, "datasets": [{"name": "osm"}]}, "output": {"root_dir": str(world / "out2")}}))
    for name in ("Bb two", "dd"):
        (world / "data" / name / "vector" / "ref.geojson").unlink()
    assert main(["cities", str(world / "s.yaml")]) == 0
    said = capsys.readouterr().out.splitlines()
    assert [line.split(" ")[0:2] for line in said if line.startswith(("Aa", "dd"))] == [["Aa-one", "finished"], ["dd", "skipped"]]
    assert main(["cities"]) == 2


def test_halving_finds_the_bad_ones():
    ran = []

    def work(batch):
        ran.append(batch)
        if {"c", "f"} & set(batch):
            raise ValueError("bad\nsecond line")

    assert cities.isolated(list("abcdefgh"), work) == {"c": "ValueError: bad", "f": "ValueError: bad"}
    assert sorted(x for b in ran if not {"c", "f"} & set(b) for x in b) == list("abdegh")
    assert cities.isolated([], work) == {}
