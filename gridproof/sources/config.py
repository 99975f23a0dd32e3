"""Typed settings of a run, read from YAML or a dict; unknown keys are an error."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from gridproof.functions.exprs import SIZE_EDGES, SIZE_LABELS


@dataclass
class Candidate:
    name: str = ""
    enabled: bool = True


@dataclass
class VectorSettings:
    min_area_m2: float = 20.0
    tile_size_m: float = 1000.0
    tau_overlap: float = 0.5
    tau_buffer_m: float = 2.0
    tau_boundary: float = 2.0
    fix_invalid_geoms: bool = True
    datasets: list[Candidate] = field(default_factory=list)


@dataclass
class Grid:
    resolution: float = 10.0
    name: str = ""

    def __post_init__(self):
        if not self.resolution > 0:
            raise ValueError("a grid's resolution must be positive")
        self.name = self.name or f"{int(self.resolution)}m"


@dataclass
class Guard:
    enabled: bool = True
    mode: str = "skip_finer"
    tolerance_factor: float = 0.75


@dataclass
class RasterProduct:
    name: str = ""
    native_resolution_m: float | None = None
    min_building_m2: float = 20.0
    enabled: bool = True
    year: str | None = None
    allow_finer_than_native: bool = False
    oversample_factor: int | None = None
    all_touched: bool = False
    binarize: dict = field(default_factory=lambda: {"method": "fraction"})

    @property
    def label(self) -> str:
        return f"{self.name}_{self.year}" if self.year else self.name


@dataclass
class RasterSettings:
    min_building_m2: float = 20.0
    oversample_factor: int = 4
    evaluation_grids: list[Grid] = field(default_factory=lambda: [Grid(10.0), Grid(100.0)])
    native_resolution_guard: Guard = field(default_factory=Guard)
    products: list[RasterProduct] = field(default_factory=list)


@dataclass
class Output:
    root_dir: str = "outputs"
    overwrite: bool = False


@dataclass
class Settings:
    data_dir: str = ""
    aoi_tracker: str = ""
    size_edges: list[float] = field(default_factory=lambda: list(SIZE_EDGES))
    size_labels: list[str] = field(default_factory=lambda: list(SIZE_LABELS))
    vector: VectorSettings = field(default_factory=VectorSettings)
    raster: RasterSettings = field(default_factory=RasterSettings)
    output: Output = field(default_factory=Output)


def build(kind: type, data: dict[str, Any] | None):
    """An instance of a settings class from nested dicts."""
    data = data or {}
    known = {f.name for f in fields(kind)}
    if extra := set(data) - known:
        raise KeyError(f"{kind.__name__} has no {sorted(extra)}")
    hints = get_type_hints(kind)
    out = {}
    for name, value in data.items():
        hint = hints[name]
        inner = getattr(hint, "__args__", (None,))[0]
        if is_dataclass(hint):
            value = build(hint, value)
        elif isinstance(value, list) and is_dataclass(inner):
            value = [build(inner, v) for v in value]
        out[name] = value
    return kind(**out)


def load(path: str) -> Settings:
    import yaml

    with open(path) as f:
        return build(Settings, yaml.safe_load(f))
