"""The three ring queries over a small table of orders, against sampled points and boundaries of every match."""

import math

import numpy as np
import pytest

from gridproof.queries import QUERIES

KEYS = range(1, 73)
BUFFER = TAU = 2.0


def footprints():
    """Boxes (id, xmin, ymin, xmax, ymax) of the references, and with the dataset those of the candidates."""
    refs, cands = [], []
    for k in KEYS:
        x, y, w, h = k * 7919 % 3001, k * 104729 % 3001, 4 + k % 23, 4 + k * 13 % 17
        if w * h >= 20:
            refs.append((k, x, y, x + w, y + h))
        for d in range(3):
            a, b = x + (1500 if k % 12 == d else k * (d + 3) % 5 - 2), y + k * (d + 5) % 5 - 2
            v, u = w + (k + d) % 3 - 1, h + (2 * k + d) % 3 - 1
            if (k * 31 + d * 17) % 10 < 9 and v * u >= 20:
                cands.append((d, k * 3 + d, a, b, a + v, b + u))
    return refs, cands


def tiles_of(box):
    lo, hi = (lambda v: max(0, math.ceil(v / 1000) - 1)), (lambda v: min(2, math.floor(v / 1000)))
    return {i * 3 + j for i in range(lo(box[0]), hi(box[2]) + 1) for j in range(lo(box[1]), hi(box[3]) + 1)}


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def matched():
    """(city, dataset, tile, ref id, cand id) -> both boxes."""
    refs, cands = footprints()
    pairs = []
    for k, *a in refs:
        for d, c, *b in cands:
            if k % 4 == c // 3 % 4 and box_iou(a, b) >= 0.5:
                pairs += [(-box_iou(a, b), k, c, d, t, a, b) for t in tiles_of(a) & tiles_of(b)]
    return pairs


def greedy():
    out, used = {}, set()
    for _, k, c, d, t, a, b in sorted(matched(), key=lambda p: p[:3]):
        key = (f"city_{k % 4}", f"ds_{d}", t)
        if (key, "r", k) not in used and (key, "c", c) not in used:
            used |= {(key, "r", k), (key, "c", c)}
            out[*key, k, c] = (a, b)
    return out


def to_box(points, box):
    """Distance of points to a filled box."""
    gap = np.maximum(0, np.maximum(np.array(box[:2]) - points, points - np.array(box[2:])))
    return np.hypot(gap[:, 0], gap[:, 1])


def to_edge(points, box):
    inside = np.minimum(points - np.array(box[:2]), np.array(box[2:]) - points).min(1)
    return np.where(inside >= 0, inside, to_box(points, box))


def sampled_iou(a, b, step=0.1):
    lo, hi = np.minimum(a[:2], b[:2]) - BUFFER, np.maximum(a[2:], b[2:]) + BUFFER
    points = np.stack(np.meshgrid(*[np.arange(p + step / 2, q, step) for p, q in zip(lo, hi, strict=True)]), -1).reshape(-1, 2)
    x, y = to_box(points, a) <= BUFFER, to_box(points, b) <= BUFFER
    return (x & y).sum() / (x | y).sum()


def share_near(boxes, others, step=0.02):
    near = total = 0.0
    for x0, y0, x1, y1 in boxes:
        u, v = np.arange(x0 + step / 2, x1, step), np.arange(y0 + step / 2, y1, step)
        points = np.concatenate([np.stack([u, u * 0 + y], 1) for y in (y0, y1)] + [np.stack([v * 0 + x, v], 1) for x in (x0, x1)])
        near += (np.min([to_edge(points, o) for o in others], 0) <= TAU).sum()
        total += len(points)
    return near / total


def sampled_f(refs, cands):
    p, q = share_near(cands, refs), share_near(refs, cands)
    return 2 * p * q / (p + q) if p + q else 0.0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rings"))
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize(("name", "column", "expected"), [("polygon_iou_buffered", "polygon_iou", sampled_iou), ("boundary_f_pair", "boundary_f_pair", lambda a, b: sampled_f([a], [b]))])
def test_every_match_has_its_pair_value(spark, folder, name, column, expected):
    got = {(r.city, r.dataset, r.tile_id, r.ref_id, r.cand_id): r[column] for r in QUERIES[name](spark, folder).collect()}
    pairs = greedy()
    assert set(got) == set(pairs) and any(k[3] % 20 for k in got)
    assert all(got[k] == pytest.approx(expected(a, b), abs=0.01) for k, (a, b) in pairs.items())


def test_tiles_count_all_their_matches(spark, folder):
    got = {(r.city, r.dataset, r.tile_id): r.boundary_f_union for r in QUERIES["boundary_f_tile"](spark, folder).collect()}
    tiles = {}
    for key, boxes in greedy().items():
        tiles.setdefault(key[:3], []).append(boxes)
    assert set(got) == set(tiles)
    assert all(got[k] == pytest.approx(sampled_f(*zip(*boxes, strict=True)), abs=0.01) for k, boxes in tiles.items())
