"""DuckDB SQL for the registered queries, built from named parts."""

from __future__ import annotations

BOX = "xmin, ymin, xmax, ymax"
#: Corner of the area of city number c.
X, Y = ("(CAST(350000.25 AS DOUBLE) + CAST(4200.5 AS DOUBLE) * ({}))".format, "(CAST(5200000.75 AS DOUBLE) - CAST(3900.25 AS DOUBLE) * ({}))".format)
PARTS: dict[str, tuple[str, str]] = {
    # name: (parts it reads, SQL)
    "ref": ("", f"""SELECT 'city_' || (k % 4) AS city, k AS bld_id, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax, w * h AS area_m2 FROM (
        SELECT o_orderkey AS k, CAST((o_orderkey * 7919) % 3001 AS DOUBLE) + {X('o_orderkey % 4')} AS xmin, CAST((o_orderkey * 104729) % 3001 AS DOUBLE) + {Y('o_orderkey % 4')} AS ymin,
               CAST(4 + o_orderkey % 23 AS DOUBLE) AS w, CAST(4 + (o_orderkey * 13) % 17 AS DOUBLE) AS h FROM orders) WHERE w * h >= 20"""),
    "cand": ("", f"""SELECT 'city_' || (k % 4) AS city, 'ds_' || d AS dataset, k * 3 + d AS bld_id, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax, w * h AS area_m2 FROM (
        SELECT o_orderkey AS k, d, CAST((o_orderkey * 7919) % 3001 + CASE WHEN o_orderkey % 12 = d THEN 1500 ELSE (o_orderkey * (d + 3)) % 5 - 2 END AS DOUBLE) + {X('o_orderkey % 4')} AS xmin,
               CAST((o_orderkey * 104729) % 3001 + (o_orderkey * (d + 5)) % 5 - 2 AS DOUBLE) + {Y('o_orderkey % 4')} AS ymin,
               CAST(4 + o_orderkey % 23 + (o_orderkey + d) % 3 - 1 AS DOUBLE) AS w, CAST(4 + (o_orderkey * 13) % 17 + (2 * o_orderkey + d) % 3 - 1 AS DOUBLE) AS h
        FROM orders CROSS JOIN (VALUES (0), (1), (2)) t(d) WHERE (o_orderkey * 31 + d * 17) % 10 < 9) WHERE w * h >= 20"""),
    "four": ("", "SELECT CAST(c AS BIGINT) AS c FROM (VALUES (0), (1), (2), (3)) t(c)"),
    "tile": ("four", f"SELECT 'city_' || c AS city, CAST(i AS BIGINT) AS ix, CAST(j AS BIGINT) AS iy, CAST(i * 3 + j AS BIGINT) AS tile_id, i * 1000 + {X('c')} AS x0, j * 1000 + {Y('c')} AS y0, i * 1000 + 1000 + {X('c')} AS x1, j * 1000 + 1000 + {Y('c')} AS y1 FROM four, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j)"),
    "part": ("four", f"SELECT 'city_' || c AS city, 'part_' || p AS sub_aoi_id, p * 900 + {X('c')} AS xmin, 100 + {Y('c')} AS ymin, p * 900 + 950 + {X('c')} AS xmax, 2500 + {Y('c')} AS ymax FROM four, (VALUES (0), (1), (2)) t(p)"),
    "ref_t": ("ref tile", "SELECT r.*, t.tile_id FROM ref r JOIN tile t ON r.city = t.city AND r.xmin <= t.x1 AND r.xmax >= t.x0 AND r.ymin <= t.y1 AND r.ymax >= t.y0"),
    "cand_t": ("cand tile", "SELECT r.*, t.tile_id FROM cand r JOIN tile t ON r.city = t.city AND r.xmin <= t.x1 AND r.xmax >= t.x0 AND r.ymin <= t.y1 AND r.ymax >= t.y0"),
    "touch": ("ref_t cand_t", """SELECT c.city, c.dataset, c.tile_id, r.bld_id AS ref_id, c.bld_id AS cand_id, r.area_m2 AS area_ref, c.area_m2 AS area_cand,
        r.xmin AS ax, r.ymin AS ay, r.xmax AS bx, r.ymax AS by_, c.xmin AS cx, c.ymin AS cy, c.xmax AS dx, c.ymax AS dy
        FROM ref_t r JOIN cand_t c ON r.city = c.city AND r.tile_id = c.tile_id AND r.xmin <= c.xmax AND r.xmax >= c.xmin AND r.ymin <= c.ymax AND r.ymax >= c.ymin"""),
    "pairs": ("touch", """SELECT city, dataset, tile_id, ref_id, cand_id, both_ / (area_ref + area_cand - both_) AS iou, area_ref, area_cand FROM (
        SELECT *, greatest(0.0, least(bx, dx) - greatest(ax, cx)) * greatest(0.0, least(by_, dy) - greatest(ay, cy)) AS both_ FROM touch) WHERE both_ > 0"""),
    "ranked": ("pairs", "SELECT *, row_number() OVER (PARTITION BY city, dataset, tile_id ORDER BY iou DESC, ref_id, cand_id) AS k FROM pairs WHERE iou >= 0.5"),
    "walk": ("ranked", """SELECT city, dataset, tile_id, k, [ref_id] AS refs, [cand_id] AS cands, true AS ok FROM ranked WHERE k = 1
        UNION ALL SELECT r.city, r.dataset, r.tile_id, r.k,
          CASE WHEN list_contains(w.refs, r.ref_id) OR list_contains(w.cands, r.cand_id) THEN w.refs ELSE list_append(w.refs, r.ref_id) END,
          CASE WHEN list_contains(w.refs, r.ref_id) OR list_contains(w.cands, r.cand_id) THEN w.cands ELSE list_append(w.cands, r.cand_id) END,
          NOT (list_contains(w.refs, r.ref_id) OR list_contains(w.cands, r.cand_id))
        FROM walk w JOIN ranked r ON r.city = w.city AND r.dataset = w.dataset AND r.tile_id = w.tile_id AND r.k = w.k + 1"""),
    "m": ("ranked walk", """SELECT r.city, r.dataset, r.tile_id, r.ref_id, r.cand_id, r.iou, r.area_ref, r.area_cand, (r.area_cand - r.area_ref) / r.area_ref AS rel_area_error
        FROM ranked r JOIN walk w ON r.city = w.city AND r.dataset = w.dataset AND r.tile_id = w.tile_id AND r.k = w.k WHERE w.ok"""),
    "tm": ("ref_t cand_t m", """SELECT city, dataset, tile_id, n_ref, n_cand, tp, n_cand - tp AS fp, n_ref - tp AS fn, tp / greatest(n_cand, 1) AS precision, tp / greatest(n_ref, 1) AS recall,
        CASE WHEN tp > 0 THEN 2.0 * (tp / n_cand) * (tp / n_ref) / (tp / n_cand + tp / n_ref) ELSE 0 END AS f1, coalesce(mean_iou, 0) AS mean_iou, coalesce(median_iou, 0) AS median_iou, coalesce(p25, 0) AS iou_p25, coalesce(p75, 0) AS iou_p75,
        mean_rel_area_error, (sc - sr) / sr AS signed_area_bias, CAST(0.5 AS DOUBLE) AS tau_overlap, CAST(0 AS DOUBLE) AS tau_buffer_m FROM (
        SELECT k.city, k.dataset, k.tile_id, coalesce(r.n, 0) AS n_ref, coalesce(c.n, 0) AS n_cand, coalesce(x.tp, 0) AS tp, mean_iou, median_iou, p25, p75, mean_rel_area_error, sr, sc FROM (
          SELECT DISTINCT r.city, d.dataset, r.tile_id FROM ref_t r JOIN (SELECT DISTINCT city, dataset FROM cand_t) d ON r.city = d.city UNION SELECT DISTINCT city, dataset, tile_id FROM cand_t) k
        LEFT JOIN (SELECT city, tile_id, count(*) AS n FROM ref_t GROUP BY ALL) r ON r.city = k.city AND r.tile_id = k.tile_id
        LEFT JOIN (SELECT city, dataset, tile_id, count(*) AS n FROM cand_t GROUP BY ALL) c ON c.city = k.city AND c.dataset = k.dataset AND c.tile_id = k.tile_id
        LEFT JOIN (SELECT city, dataset, tile_id, count(*) AS tp, avg(iou) AS mean_iou, median(iou) AS median_iou, quantile_cont(iou, 0.25) AS p25, quantile_cont(iou, 0.75) AS p75, avg(rel_area_error) AS mean_rel_area_error, sum(area_ref) AS sr, sum(area_cand) AS sc
          FROM m GROUP BY city, dataset, tile_id) x ON x.city = k.city AND x.dataset = k.dataset AND x.tile_id = k.tile_id)"""),
    "vc": ("tm m", """SELECT s.city, s.dataset, CAST(1 AS BIGINT) AS n_sub_areas, n_tiles, n_ref AS n_ref_total, n_cand AS n_cand_total, n_cand - n_ref AS count_delta_total, n_cand / n_ref AS count_ratio_total, (n_cand - n_ref) / n_ref AS rel_count_delta_total,
        n_ref / 9.0 AS ref_density_per_km2, n_cand / 9.0 AS cand_density_per_km2, n_cand / 9.0 - n_ref / 9.0 AS density_delta_per_km2, (n_cand / 9.0) / (n_ref / 9.0) AS density_ratio_per_km2, tp AS tp_total, fp AS fp_total, fn AS fn_total,
        round(tp / (tp + fp), 4) AS precision_city, round(tp / (tp + fn), 4) AS recall_city, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1_city,
        round(a, 4) AS iou_mean_tp, round(b, 4) AS iou_median_tp, round(c, 4) AS iou_p25_tp, round(d, 4) AS iou_p75_tp, round(e, 4) AS rel_area_error_mean_tp, round(f, 4) AS rel_area_error_median_tp, round(g, 4) AS signed_area_bias_tp FROM (
        SELECT city, dataset, count(DISTINCT tile_id) AS n_tiles, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cand) AS BIGINT) AS n_cand, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM tm GROUP BY city, dataset) s
        JOIN (SELECT city, dataset, avg(iou) AS a, median(iou) AS b, quantile_cont(iou, 0.25) AS c, quantile_cont(iou, 0.75) AS d, avg(rel_area_error) AS e, median(rel_area_error) AS f, (sum(area_cand) - sum(area_ref)) / sum(area_ref) AS g FROM m GROUP BY city, dataset) x
        ON s.city = x.city AND s.dataset = x.dataset"""),
    "px": ("four", f"""SELECT 'city_' || c AS city, CASE WHEN p = 0 THEN 'share' ELSE 'codes' END AS dataset, r AS row, k AS col, (k + floor({X('c')} / 20)) * 20 AS x, (r + floor({Y('c')} / 20)) * 20 AS y,
        CASE WHEN (c * 31 + p * 17 + r * 7 + k * 3) % 29 = 0 THEN NULL WHEN p = 0 THEN ((c * 31 + r * 7 + k * 3) % 101) / 100.0 ELSE CAST((c * 31 + 17 + r * 7 + k * 3) % 25 AS DOUBLE) END AS value
        FROM four, (VALUES (0), (1)) t(p), (SELECT unnest(range(151)) AS r) rr, (SELECT unnest(range(151)) AS k) kk"""),
    "nat": ("px", """SELECT *, coalesce(valid AND (CASE WHEN dataset = 'share' THEN area / 400 >= 0.05 ELSE area > 0 END), false) AS built FROM (
        SELECT *, value IS NOT NULL AS valid, CASE WHEN value IS NULL THEN NULL WHEN dataset = 'share' THEN least(1.0, greatest(0.0, value)) * 400 WHEN value <> 0 AND value >= 1 AND value <= 19 THEN 400.0 ELSE 0.0 END AS area FROM px)"""),
    "sizes": ("", "SELECT CAST(size AS DOUBLE) AS size FROM (VALUES (50), (100)) t(size)"),
    "met": ("nat sizes", """SELECT *, (least(x + 20, (gx + 1) * size) - greatest(x, gx * size)) * (least(y + 20, (gy + 1) * size) - greatest(y, gy * size)) AS w,
        floor((gx + 0.5) * size / 20) * 20 = x AND floor((gy + 0.5) * size / 20) * 20 = y AS near FROM (
        SELECT n.*, s.size, a.gx, b.gy FROM nat n, sizes s, LATERAL (SELECT unnest(range(CAST(floor(n.x / s.size) AS BIGINT), CAST(ceil((n.x + 20) / s.size) AS BIGINT))) AS gx) a,
        LATERAL (SELECT unnest(range(CAST(floor(n.y / s.size) AS BIGINT), CAST(ceil((n.y + 20) / s.size) AS BIGINT))) AS gy) b)"""),
    "rg": ("met", """SELECT city, dataset, size, gx, gy, sum(CASE WHEN valid AND built THEN w WHEN valid THEN 0 END) / sum(CASE WHEN valid THEN w END) AS built_share,
        sum(CASE WHEN valid THEN w * area END) / sum(CASE WHEN valid THEN w END) * (size / 20) * (size / 20) AS pred_area, coalesce(bool_or(near AND valid), false) AS valid FROM met GROUP BY city, dataset, size, gx, gy"""),
    "frac": ("ref sizes", """SELECT city, size, CAST(floor(sx / 4.0) AS BIGINT) AS gx, CAST(floor(sy / 4.0) AS BIGINT) AS gy, count(*) / 16.0 AS ref_share FROM (
        SELECT DISTINCT r.city, s.size, a.sx, b.sy FROM ref r, sizes s,
        LATERAL (SELECT unnest(range(CAST(ceil(r.xmin / (s.size / 4) - 0.5) AS BIGINT), CAST(ceil(r.xmax / (s.size / 4) - 0.5) AS BIGINT))) AS sx) a,
        LATERAL (SELECT unnest(range(CAST(ceil(r.ymin / (s.size / 4) - 0.5) AS BIGINT), CAST(ceil(r.ymax / (s.size / 4) - 0.5) AS BIGINT))) AS sy) b) GROUP BY ALL"""),
    "t300": ("four", f"SELECT 'city_' || c AS city, CAST(i * 10 + j AS BIGINT) AS tile_id, i * 300 + {X('c')} AS x0, j * 300 + {Y('c')} AS y0, i * 300 + 300 + {X('c')} AS x1, j * 300 + 300 + {Y('c')} AS y1 FROM four, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j)"),
    "cells": ("t300 sizes rg frac", """SELECT g.city, g.dataset, g.tile_id, g.size, coalesce(r.valid, false) AS valid, coalesce(f.ref_share, 0) AS ref_share, coalesce(r.pred_area, 0) AS pred_area,
        coalesce(f.ref_share, 0) >= least(1.0, 20.0 / (g.size * g.size)) AS ref, coalesce(r.built_share >= least(1.0, 20.0 / (g.size * g.size)), false) AS pred FROM (
        SELECT t.*, d.dataset, s.size, a.gx, b.gy FROM t300 t, (VALUES ('share'), ('codes')) d(dataset), sizes s,
        LATERAL (SELECT unnest(range(CAST(ceil(t.x0 / s.size - 0.5) AS BIGINT), CAST(ceil(t.x1 / s.size - 0.5) AS BIGINT))) AS gx) a,
        LATERAL (SELECT unnest(range(CAST(ceil(t.y0 / s.size - 0.5) AS BIGINT), CAST(ceil(t.y1 / s.size - 0.5) AS BIGINT))) AS gy) b) g
        LEFT JOIN rg r ON r.city = g.city AND r.dataset = g.dataset AND r.size = g.size AND r.gx = g.gx AND r.gy = g.gy
        LEFT JOIN frac f ON f.city = g.city AND f.size = g.size AND f.gx = g.gx AND f.gy = g.gy"""),
    "rt": ("cells ref t300", """SELECT c.city, c.dataset, c.tile_id, CAST(CAST(size AS INTEGER) AS VARCHAR) || 'm' AS grid, size AS resolution_m, size * size AS pixel_area_m2, CASE WHEN n_valid = 0 THEN 0 ELSE n END AS n_pixels, n_valid, n_valid * size * size AS valid_area_m2, tp, fp, fn, tn,
        tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1,
        ra AS ref_area_m2, pa AS pred_area_m2, coalesce(b.n_ref, 0) AS ref_building_count, b.size_ref AS mean_ref_building_area_m2, pa / b.size_ref AS pred_building_count, pa / b.size_ref - coalesce(b.n_ref, 0) AS delta_building_count,
        (pa / b.size_ref - b.n_ref) / b.n_ref AS rel_delta_building_count, (pa - ra) / nullif(ra, 0) AS rel_area_error, (pa - ra) / nullif(ra, 0) AS signed_area_bias,
        abs(fp - fn) / nullif(tp + fp + fn + tn, 0) AS quantity_disagreement, 2 * least(fp, fn) / nullif(tp + fp + fn + tn, 0) AS allocation_disagreement, CAST(20 AS DOUBLE) AS native_resolution_m FROM (
        SELECT city, dataset, tile_id, size, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid AND ref AND pred) AS tp, count(*) FILTER (WHERE valid AND NOT ref AND pred) AS fp,
          count(*) FILTER (WHERE valid AND ref AND NOT pred) AS fn, count(*) FILTER (WHERE valid AND NOT ref AND NOT pred) AS tn, sum(CASE WHEN valid THEN ref_share * size * size END) AS ra, sum(CASE WHEN valid THEN pred_area END) AS pa FROM cells GROUP BY ALL) c
        LEFT JOIN (SELECT t.city, t.tile_id, count(*) AS n_ref, avg(area_m2) AS size_ref FROM ref r JOIN t300 t ON r.city = t.city AND r.xmin <= t.x1 AND r.xmax >= t.x0 AND r.ymin <= t.y1 AND r.ymax >= t.y0 GROUP BY ALL) b ON b.city = c.city AND b.tile_id = c.tile_id"""),
    "rc": ("rt ref", """SELECT s.city, s.dataset, s.grid, s.resolution_m, n_ref_buildings, CAST(9 AS DOUBLE) AS aoi_area_km2, n_ref_buildings / 9.0 AS buildings_per_km2, avg_building_size_m2, n_ref_buildings AS ref_building_count,
        pa / avg_building_size_m2 AS pred_building_count, pa / avg_building_size_m2 - n_ref_buildings AS delta_building_count, (pa / avg_building_size_m2 - n_ref_buildings) / n_ref_buildings AS rel_delta_building_count,
        n_tiles, va AS valid_area_total_m2, ra AS ref_area_total_m2, pa AS pred_area_total_m2, tp AS tp_total, fp AS fp_total, fn AS fn_total, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_area, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_area,
        CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1_area, f1_tile_mean, f1_tile_median, rel_area_error_mean, rel_area_error_median, (pa - ra) / nullif(ra, 0) AS signed_area_bias,
        quantity_disagreement_mean, allocation_disagreement_mean, precision_weighted_mean, recall_weighted_mean, f1_weighted_mean, rel_area_error_weighted_mean, signed_area_bias_weighted_mean, quantity_disagreement_weighted_mean, allocation_disagreement_weighted_mean FROM (
        SELECT city, dataset, grid, resolution_m, count(DISTINCT tile_id) AS n_tiles, sum(valid_area_m2) AS va, sum(ref_area_m2) AS ra, sum(pred_area_m2) AS pa, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
          avg(f1) AS f1_tile_mean, median(f1) AS f1_tile_median, avg(rel_area_error) AS rel_area_error_mean, median(rel_area_error) AS rel_area_error_median, avg(quantity_disagreement) AS quantity_disagreement_mean, avg(allocation_disagreement) AS allocation_disagreement_mean,
          """ + ", ".join(f"sum({c} * valid_area_m2) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN valid_area_m2 END), 0) AS {c}_weighted_mean" for c in ("precision", "recall", "f1", "rel_area_error", "signed_area_bias", "quantity_disagreement", "allocation_disagreement")) + """
          FROM rt GROUP BY city, dataset, grid, resolution_m) s
        JOIN (SELECT city, count(*) AS n_ref_buildings, avg(area_m2) AS avg_building_size_m2 FROM ref GROUP BY city) r ON r.city = s.city"""),
    "sheet": ("", """SELECT CAST(n_nationkey AS BIGINT) AS row_id, CASE WHEN n_nationkey % 11 = 10 THEN ' ' WHEN n_nationkey % 8 = 3 THEN 'Data FRANCE final' WHEN n_nationkey % 5 = 4 THEN 'Dataset_' || upper(n_name) || '-v2' ELSE lower(n_name) END AS code,
        CASE n_nationkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'high quality' WHEN 3 THEN 'unsuitable' END AS quality FROM nation"""),
    "item": ("", """SELECT 'f' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'dataset_' || lower(n_name) || '_final' WHEN 2 THEN lower(n_name) || '_2021' ELSE 'old ' || upper(n_name) || ' copies' END AS name,
        true AS is_folder, 'folder' AS mime_type, CAST(0 AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS modified_time, CAST(NULL AS VARCHAR) AS parent FROM nation WHERE n_nationkey % 6 <> 5
        UNION ALL SELECT 'g' || n_nationkey, lower(n_name) || '_backup', true, 'folder', 0, NULL, NULL FROM nation WHERE n_nationkey % 8 = 0
        UNION ALL SELECT 's' || n_nationkey, 'Vector', true, 'folder', 0, NULL, 'f' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0
        UNION ALL SELECT 't' || n_nationkey, 'aoi', true, 'folder', 0, NULL, 's' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'p' || p_partkey, 'tile' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '_AOI.geojson' WHEN 1 THEN '_ref.geojson' WHEN 2 THEN '_hotosm.geojson' ELSE '.tif' END, false, CASE WHEN p_partkey % 4 = 3 THEN 'image/tiff' ELSE 'application/json' END,
          CAST(p_size AS BIGINT) * 1000, '2024-01-' || p_size, CASE WHEN p_partkey % 50 <> 7 THEN ['f', 's', 't', 'g', 'f'][p_partkey % 5 + 1] || (p_partkey % 24) END FROM part"""),
    # the top folder goes down all levels; a file at the root has none
    "tree": ("item", """SELECT id, name, is_folder, mime_type, size_bytes, modified_time, 1 AS level, name AS path, CASE WHEN is_folder THEN name END AS top FROM item WHERE parent IS NULL
        UNION ALL SELECT i.id, i.name, i.is_folder, i.mime_type, i.size_bytes, i.modified_time, t.level + 1, t.path || '/' || i.name, t.top FROM item i JOIN tree t ON i.parent = t.id"""),
    "folder": ("tree", "SELECT id, name FROM tree WHERE level = 1 AND is_folder"),
    "file": ("tree", "SELECT id, name, size_bytes, modified_time, mime_type, path, top AS dataset_folder_name FROM tree WHERE NOT is_folder AND top IS NOT NULL"),
    "named": ("sheet folder", """SELECT *, coalesce(nullif(array_to_string(core, ''), ''), norm) AS core_norm FROM (SELECT *, array_to_string(tokens, '') AS norm, CASE WHEN lo IS NULL THEN [] ELSE
          (CASE WHEN len(list_filter(range(lo, len(tokens) + 1), lambda i: NOT regexp_matches(tokens[i], '^((v|ver|version|rev|r)[0-9]+[a-z]*|[0-9]{8}|[0-9]{6}|[0-9]{4}|new)$') AND NOT list_contains(['dataset','datasets','data','folder','folders','file','files','archive','backup','copy','copies','raw','processed','proc','final','latest','updated','update','export','exports','deliverable','delivery'], tokens[i]))) = 0 THEN []
           ELSE tokens[lo:list_max(list_filter(range(lo, len(tokens) + 1), lambda i: NOT regexp_matches(tokens[i], '^((v|ver|version|rev|r)[0-9]+[a-z]*|[0-9]{8}|[0-9]{6}|[0-9]{4}|new)$') AND NOT list_contains(['dataset','datasets','data','folder','folders','file','files','archive','backup','copy','copies','raw','processed','proc','final','latest','updated','update','export','exports','deliverable','delivery'], tokens[i])))] END) END AS core FROM (
        SELECT *, list_min(list_filter(range(1, len(tokens) + 1), lambda i: NOT list_contains(['dataset','datasets','data','ds','folder','files','download','downloads','input','inputs','source','sources'], tokens[i]))) AS lo FROM (
        SELECT side, id, name, regexp_extract_all(lower(trim(name)), '[a-z0-9]+') AS tokens FROM (SELECT 'code' AS side, CAST(row_id AS VARCHAR) AS id, code AS name FROM sheet UNION ALL SELECT 'folder', id, name FROM folder))))"""),
    "scored": ("named", """SELECT CAST(c.id AS BIGINT) AS row_id, f.id AS folder_id, f.name AS dataset_folder_name,
        CASE WHEN c.norm = f.norm THEN 100 WHEN c.core_norm = f.core_norm THEN 96
             WHEN len(c.core) > 0 AND len(list_filter(range(1, len(f.tokens) - len(c.core) + 2), lambda i: f.tokens[i:i + len(c.core) - 1] = c.core)) > 0 THEN 90
             WHEN len(c.tokens) > 0 AND len(list_filter(range(1, len(f.tokens) - len(c.tokens) + 2), lambda i: f.tokens[i:i + len(c.tokens) - 1] = c.tokens)) > 0 THEN 88
             WHEN length(c.core_norm) >= 5 AND contains(f.core_norm, c.core_norm) THEN 84 WHEN length(c.norm) >= 6 AND contains(f.norm, c.norm) THEN 82
             WHEN length(f.core_norm) >= 5 AND contains(c.core_norm, f.core_norm) THEN 78 END AS match_score
        FROM named c, named f WHERE c.side = 'code' AND f.side = 'folder' AND c.norm <> '' AND f.norm <> ''"""),
    "nm": ("scored", """SELECT row_id, folder_id, dataset_folder_name, match_score, CASE match_score WHEN 100 THEN 'exact_normalized' WHEN 96 THEN 'exact_core' WHEN 90 THEN 'core_token_subsequence' WHEN 88 THEN 'token_subsequence'
        WHEN 84 THEN 'core_substring' WHEN 82 THEN 'normalized_substring' ELSE 'reverse_core_substring' END AS match_rule FROM scored WHERE match_score IS NOT NULL"""),
    "bm": ("nm", """SELECT row_id, folder_id, dataset_folder_name, match_score, match_rule, match_count FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY match_score DESC, dataset_folder_name, folder_id) AS k FROM nm)
        JOIN (SELECT row_id, count(DISTINCT dataset_folder_name) AS match_count FROM nm GROUP BY row_id) USING (row_id) WHERE k = 1"""),
    "sum": ("sheet named bm file", """SELECT s.row_id, trim(s.code) AS code, s.quality, n.core_norm AS code_norm,
        CASE WHEN lower(trim(quality)) IN ('yes', 'y', 'true', '1', 'high', 'suitable') THEN true WHEN lower(trim(quality)) IN ('no', 'n', 'false', '0', 'low', 'unsuitable') THEN false ELSE coalesce(lower(quality) LIKE '%yes%' OR lower(quality) LIKE '%suitable%' OR lower(quality) LIKE '%high%', false) END AS is_high_quality,
        b.dataset_folder_name, b.match_score, b.match_rule, coalesce(b.match_count, 0) AS match_count, coalesce(b.match_count, 0) > 1 AS ambiguous_match, b.dataset_folder_name IS NOT NULL AS downloaded, coalesce(f.n, 0) AS downloaded_files, CAST(coalesce(f.size, 0) AS BIGINT) AS total_size_bytes
        FROM sheet s JOIN named n ON n.side = 'code' AND n.id = CAST(s.row_id AS VARCHAR) LEFT JOIN bm b ON b.row_id = s.row_id LEFT JOIN (SELECT dataset_folder_name, count(id) AS n, sum(size_bytes) AS size FROM file GROUP BY 1) f ON f.dataset_folder_name = b.dataset_folder_name"""),
    "track": ("", """SELECT k * 2 + again AS row_id, k, again, CASE WHEN k = 24 THEN CASE WHEN again = 0 THEN ' ' END ELSE name END AS dataset_folder_name,
        CASE WHEN again = 1 THEN [name || '_2_AOI.geojson'] WHEN k % 6 = 1 THEN [name || '_1_aoi.geojson', 'Part_b.gpkg'] ELSE [name || '_1_aoi.geojson'] END AS aoi,
        CASE WHEN k % 7 = 6 THEN [] WHEN k % 4 = 0 OR again = 1 THEN [name || '_ref.geojson', 'extra_ref.geojson'] ELSE [name || '_ref.geojson'] END AS refs,
        ['TRUE', 'True', ' true ', 'FALSE', ''][k % 5 + 1] AS has_aoi_file, ['yes', 'Yes ', 'YES', 'unsuitable', 'unsuitable for use', 'high', NULL, 'no'][k % 8 + 1] AS suitable, ['TRUE', ' true', 'no', NULL][k % 4 + 1] AS is_high_quality
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(again AS BIGINT) AS again, CASE WHEN n_nationkey % 4 < 2 THEN lower(n_name) ELSE upper(n_name[1]) || lower(n_name[2:]) || '-City ' || n_nationkey END AS name
        FROM nation JOIN (VALUES (0), (1)) a(again) ON again = 0 OR n_nationkey % 3 = 0)"""),
    # one row an area file; ids keep their case, and only "-" and blanks of the slug change
    "aoi_file": ("track", """SELECT dataset_folder_name AS dataset, replace(replace(dataset_folder_name, '-', '_'), ' ', '_') AS slug, has_aoi_file, suitable, is_high_quality, f AS file_name, dataset_folder_name || '/aoi/' || f AS path,
        regexp_replace(regexp_replace(f, '\\.[^./]*$', ''), '_aoi$', '', 'i') AS sub_aoi_id FROM track, LATERAL (SELECT unnest(aoi) AS f) u WHERE dataset_folder_name IS NOT NULL"""),
    "map_row": ("", """SELECT n_name AS dataset, (k + again) % 5 IN (0, 2) AS a, (k + again) % 3 = 1 AS r, coalesce(try_cast(['3', 'n/a', '40', NULL][(k + again) % 4 + 1] AS DOUBLE), 0) AS n, coalesce(try_cast(['x', '12', NULL, '2.5', '0'][(k + 2 * again) % 5 + 1] AS DOUBLE), 0) AS m,
        CASE WHEN k % 2 = 0 THEN CAST(80 + k + again AS DOUBLE) ELSE 0 END AS score, 'a/' || n_name || '_' || again || '.geojson' AS path, n_name || '_' || again || '.geojson' AS file
        FROM (SELECT n_name, n_nationkey AS k, again FROM nation JOIN (VALUES (0), (1)) a(again) ON again = 0 OR n_nationkey % 3 = 0)"""),
    "metric": ("", """SELECT p_brand AS grp, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS value,
        CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS weight FROM part"""),
    "point": ("ref", "SELECT city, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ref"),
    "dens": ("tile point", """SELECT city, tile_id, n AS n_buildings, CAST(1 AS DOUBLE) AS area_km2, CAST(n AS DOUBLE) AS buildings_per_km2, CASE WHEN n = 0 THEN 'none' WHEN n < 100 THEN 'low' WHEN n <= 1500 THEN 'medium' ELSE 'high' END AS density_class FROM (
        SELECT t.city, t.tile_id, count(p.x) AS n FROM tile t LEFT JOIN point p ON p.city = t.city AND p.x > t.x0 AND p.x < t.x1 AND p.y > t.y0 AND p.y < t.y1 GROUP BY t.city, t.tile_id)"""),
    "sized": ("m", "SELECT *, " + "CASE WHEN area_ref <= 25 THEN '<25' WHEN area_ref <= 50 THEN '25-50' WHEN area_ref <= 100 THEN '50-100' WHEN area_ref <= 500 THEN '100-500' WHEN area_ref <= 1000 THEN '500-1000' ELSE '>1000' END AS rb, CASE WHEN area_cand <= 25 THEN '<25' WHEN area_cand <= 50 THEN '25-50' WHEN area_cand <= 100 THEN '50-100' WHEN area_cand <= 500 THEN '100-500' WHEN area_cand <= 1000 THEN '500-1000' ELSE '>1000' END AS cb FROM m"),
}
BIN = "CASE WHEN {0} <= 25 THEN '<25' WHEN {0} <= 50 THEN '25-50' WHEN {0} <= 100 THEN '50-100' WHEN {0} <= 500 THEN '100-500' WHEN {0} <= 1000 THEN '500-1000' ELSE '>1000' END"


def query(needs: str, final: str) -> str:
    """The final SELECT with all parts it reads, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for k in PARTS[name][0].split():
            add(k)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({PARTS[k][1]})" for k in order) + "\n" + final


def r(names: str, places: int = 6) -> str:
    """Select items that round each column."""
    return ", ".join(f"CAST(round({c}, {places}) AS DOUBLE) + 0.0 AS {c}" for c in names.replace(",", " ").split())


_WAVG = "CASE WHEN sum(coalesce({w}, 0)) > 0 THEN sum(coalesce({c}, 0) * coalesce({w}, 0)) / sum(coalesce({w}, 0)) END"
_VM = ("precision_city", "recall_city", "f1_city", "iou_mean_tp", "iou_median_tp", "iou_p25_tp", "iou_p75_tp", "rel_area_error_mean_tp", "rel_area_error_median_tp", "signed_area_bias_tp")
_RM = ("precision_area", "recall_area", "f1_area", "f1_tile_mean", "rel_area_error_mean", "signed_area_bias", "quantity_disagreement_mean", "allocation_disagreement_mean")
_GLOBAL = "round({p}, 6) + 0.0 AS precision_global, round({r}, 6) + 0.0 AS recall_global, round(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 6) + 0.0 AS f1_global".format(p="sum(tp_total) / nullif(sum(tp_total) + sum(fp_total), 0)", r="sum(tp_total) / nullif(sum(tp_total) + sum(fn_total), 0)")
_RT = "precision recall f1 ref_area_m2 pred_area_m2 mean_ref_building_area_m2 pred_building_count delta_building_count rel_delta_building_count rel_area_error signed_area_bias quantity_disagreement allocation_disagreement"
_HEX = "SELECT bld_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h FROM ref"

ORACLE_SQL: dict[str, str] = {
    "tile_assignment": query("ref_t cand_t", "SELECT city, 'reference' AS source, bld_id, tile_id FROM ref_t UNION ALL SELECT city, dataset, bld_id, tile_id FROM cand_t"),
    "tile_grid": query("four part", f"""SELECT city, ix, iy, row_number() OVER (PARTITION BY city ORDER BY ix, iy) - 1 AS tile_id, x0, y0, x1, y1 FROM (
        SELECT 'city_' || c AS city, i AS ix, j AS iy, i * 700 + {X('c')} AS x0, j * 700 + {Y('c')} AS y0, least(i * 700 + 700, 3000) + {X('c')} AS x1, least(j * 700 + 700, 3000) + {Y('c')} AS y1, i * 700 + 700 + {X('c')} AS fx1, j * 700 + 700 + {Y('c')} AS fy1 FROM four, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)) g
        WHERE EXISTS (SELECT 1 FROM part p WHERE p.city = g.city AND sub_aoi_id <> 'part_2' AND x0 <= xmax AND fx1 >= xmin AND y0 <= ymax AND fy1 >= ymin)"""),
    "candidate_pairs_iou": query("pairs", f"SELECT city, dataset, tile_id, ref_id, cand_id, {r('iou area_ref area_cand')} FROM pairs"),
    "buffered_pairs_iou": query("touch", """SELECT city, dataset, tile_id, ref_id, cand_id, round(both_ / (a + b - both_), 6) + 0.0 AS iou, area_ref, area_cand FROM (
        SELECT *, greatest(0.0, least(bx, dx) - greatest(ax, cx) + 4) * greatest(0.0, least(by_, dy) - greatest(ay, cy) + 4) AS both_, (bx - ax + 4) * (by_ - ay + 4) AS a, (dx - cx + 4) * (dy - cy + 4) AS b FROM touch) WHERE both_ > 0"""),
    "greedy_match": query("m", f"SELECT city, dataset, tile_id, ref_id, cand_id, {r('iou area_ref area_cand rel_area_error')} FROM m"),
    "unmatched_references": query("ref_t m", "SELECT r.city, d.dataset, r.tile_id, r.bld_id FROM ref_t r, (VALUES ('ds_0'), ('ds_1'), ('ds_2')) d(dataset) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.city = r.city AND m.dataset = d.dataset AND m.tile_id = r.tile_id AND m.ref_id = r.bld_id)"),
    "tile_metrics": query("tm", f"SELECT city, dataset, tile_id, n_ref, n_cand, tp, fp, fn, {r('precision recall f1 mean_iou median_iou iou_p25 iou_p75 mean_rel_area_error signed_area_bias tau_overlap tau_buffer_m')} FROM tm"),
    "city_summary": query("vc", "SELECT city, dataset, n_sub_areas, n_tiles, n_ref_total, n_cand_total, count_delta_total, " + r("count_ratio_total rel_count_delta_total ref_density_per_km2 cand_density_per_km2 density_delta_per_km2 density_ratio_per_km2") + ", tp_total, fp_total, fn_total, " + r(" ".join(_VM)) + " FROM vc"),
    "size_bin_metrics": query("sized ref cand", f"""SELECT d.city, d.dataset, l.b AS size_bin, coalesce(x.n, 0) AS n_matches, round(x.mi, 6) + 0.0 AS mean_iou, round(x.md, 6) + 0.0 AS median_iou, round(x.me, 6) + 0.0 AS mean_rel_area_error, coalesce(p.n, 0) AS n_ref_in_bin, coalesce(q.n, 0) AS n_cand_in_bin,
        round(coalesce(x.n, 0) / nullif(coalesce(p.n, 0), 0), 6) + 0.0 AS recall_in_bin, round(coalesce(y.n, 0) / nullif(coalesce(q.n, 0), 0), 6) + 0.0 AS precision_in_bin
        FROM (SELECT DISTINCT city, dataset FROM cand) d CROSS JOIN (VALUES ('<25'), ('25-50'), ('50-100'), ('100-500'), ('500-1000'), ('>1000')) l(b)
        LEFT JOIN (SELECT city, dataset, rb, count(*) AS n, avg(iou) AS mi, median(iou) AS md, avg(rel_area_error) AS me FROM sized GROUP BY ALL) x ON x.city = d.city AND x.dataset = d.dataset AND x.rb = l.b
        LEFT JOIN (SELECT city, dataset, cb, count(*) AS n FROM sized GROUP BY ALL) y ON y.city = d.city AND y.dataset = d.dataset AND y.cb = l.b
        LEFT JOIN (SELECT city, {BIN.format('area_m2')} AS b, count(*) AS n FROM ref GROUP BY ALL) p ON p.city = d.city AND p.b = l.b
        LEFT JOIN (SELECT city, dataset, {BIN.format('area_m2')} AS b, count(*) AS n FROM cand GROUP BY ALL) q ON q.city = d.city AND q.dataset = d.dataset AND q.b = l.b"""),
    "density_summary": query("ref cand", """SELECT s.city, s.source, n AS n_buildings, CAST(9 AS DOUBLE) AS aoi_area_km2, round(n / 9.0, 6) + 0.0 AS density_per_km2, n - k AS count_delta_vs_reference, round((n - k) / k, 6) + 0.0 AS rel_count_delta_vs_reference, round(n / 9.0 - k / 9.0, 6) + 0.0 AS density_delta_vs_reference,
        round((n / 9.0) / (k / 9.0), 6) + 0.0 AS density_ratio_vs_reference, round(a, 6) + 0.0 AS mean_area_m2, b AS median_area_m2, c AS p25_area_m2, d AS p75_area_m2 FROM (
        SELECT city, source, count(*) AS n, avg(area_m2) AS a, median(area_m2) AS b, quantile_cont(area_m2, 0.25) AS c, quantile_cont(area_m2, 0.75) AS d FROM (SELECT city, 'reference' AS source, area_m2 FROM ref UNION ALL SELECT city, dataset, area_m2 FROM cand) GROUP BY city, source) s
        JOIN (SELECT city, count(*) AS k FROM ref GROUP BY city) r ON r.city = s.city"""),
    "weighted_mean_skipna": query("metric", "SELECT grp, round(sum(value * weight) / nullif(sum(CASE WHEN value IS NOT NULL THEN weight END), 0), 4) + 0.0 AS value_weighted_mean FROM metric GROUP BY grp"),
    "weighted_mean_zero": query("metric", "SELECT grp, round(" + _WAVG.format(c="value", w="weight") + ", 4) + 0.0 AS value_wavg FROM metric GROUP BY grp"),
    "vector_global_rollup": query("vc", "SELECT dataset, count(DISTINCT city) AS n_cities, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_tiles", "n_ref_total", "n_cand_total", "tp_total", "fp_total", "fn_total")) + ", " + ", ".join(f"round(median({c}_city), 6) + 0.0 AS {c}_city_median" for c in ("precision", "recall", "f1")) + ", "
        + ", ".join(f"round({_WAVG.format(c=c, w='n_ref_total')}, 6) + 0.0 AS {c}_wavg" for c in _VM) + f", {_GLOBAL} FROM vc GROUP BY dataset"),
    "best_dataset_per_city": query("vc", "SELECT city, dataset, f1_city, precision_city, recall_city, iou_mean_tp FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY f1_city DESC, dataset) AS k FROM vc) WHERE k = 1"),
    "pixel_binarize": query("nat", f"SELECT city, dataset, row, col, valid, {r('area')}, built FROM nat"),
    "predicted_area_methods": query("px", """SELECT method, city, row, col, round(area, 6) + 0.0 AS area, coalesce(CASE WHEN method = 7 THEN area / 400 >= 0.5 WHEN method >= 3 THEN area > 0 ELSE area / 400 >= 0.05 END, false) AS built FROM (
        SELECT CAST(method AS INTEGER) AS method, city, row, col, CASE WHEN value IS NULL THEN NULL ELSE CASE method WHEN 0 THEN least(1.0, greatest(0.0, value)) * 400 WHEN 1 THEN value / 100 * 400 WHEN 2 THEN least(greatest(0.0, value), 400.0) WHEN 3 THEN CASE WHEN value >= 0.5 THEN 400.0 ELSE 0.0 END
        WHEN 4 THEN CASE WHEN value <> 0 THEN 400.0 ELSE 0.0 END WHEN 5 THEN CASE WHEN value IN (3, 5, 8) THEN 400.0 ELSE 0.0 END WHEN 6 THEN CASE WHEN value >= 1 AND value <= 10 THEN 400.0 ELSE 0.0 END ELSE CASE WHEN value >= 1 AND value <= 19 THEN 400.0 ELSE 0.0 END END END AS area
        FROM px, (SELECT unnest(range(8)) AS method) WHERE dataset = 'codes')"""),
    "regrid_block_average": query("rg", f"SELECT city, dataset, gx, gy, {r('built_share pred_area')}, valid FROM rg WHERE size = 50 AND dataset = 'share'"),
    "ref_fraction": query("ref", """SELECT city, CAST(floor(sx / 4.0) AS BIGINT) AS gx, CAST(floor(sy / 4.0) AS BIGINT) AS gy, count(*) / 16.0 AS ref_share FROM (SELECT DISTINCT r.city, a.sx, b.sy FROM ref r,
        LATERAL (SELECT unnest(range(CAST(ceil(r.xmin / 2.5 - 0.5) AS BIGINT), CAST(ceil(r.xmax / 2.5 - 0.5) AS BIGINT))) AS sx) a, LATERAL (SELECT unnest(range(CAST(ceil(r.ymin / 2.5 - 0.5) AS BIGINT), CAST(ceil(r.ymax / 2.5 - 0.5) AS BIGINT))) AS sy) b) GROUP BY ALL"""),
    "raster_tile_metrics": query("rt", f"SELECT city, dataset, tile_id, grid, resolution_m, pixel_area_m2, n_pixels, n_valid, valid_area_m2, tp, fp, fn, tn, {r(_RT)}, ref_building_count, native_resolution_m FROM rt"),
    "raster_city_summary": query("rc", "SELECT city, dataset, grid, resolution_m, n_ref_buildings, ref_building_count, n_tiles, tp_total, fp_total, fn_total, " + r("aoi_area_km2 buildings_per_km2 avg_building_size_m2 pred_building_count delta_building_count rel_delta_building_count valid_area_total_m2 ref_area_total_m2 pred_area_total_m2 f1_tile_median rel_area_error_median " + " ".join(_RM) + " precision_weighted_mean recall_weighted_mean f1_weighted_mean rel_area_error_weighted_mean signed_area_bias_weighted_mean quantity_disagreement_weighted_mean allocation_disagreement_weighted_mean") + " FROM rc"),
    "qa_disagreement": query("rt", "SELECT dataset, grid, round(abs(sum(fp) - sum(fn)) / sum(tp + fp + fn + tn), 6) + 0.0 AS quantity, round(2 * least(sum(fp), sum(fn)) / sum(tp + fp + fn + tn), 6) + 0.0 AS allocation FROM rt GROUP BY dataset, grid"),
    "native_guard": "SELECT s_suppkey, grid FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 40 * 4 END AS native, s_suppkey % 10 = 3 AS finer FROM supplier), (VALUES ('10m', 10.0), ('100m', 100.0)) g(grid, res) WHERE finer OR native IS NULL OR NOT res < native * 0.95",
    "raster_mosaic_clip": query("px part", """SELECT c.city, 'share' AS dataset, x, y, CASE WHEN EXISTS (SELECT 1 FROM part p WHERE p.city = c.city AND c.x + 10 >= p.xmin AND c.x + 10 < p.xmax AND c.y + 10 >= p.ymin AND c.y + 10 < p.ymax) THEN round(coalesce(v, u), 6) + 0.0 END AS value FROM (
        SELECT city, x, y, max(v) AS v, max(u) AS u FROM (SELECT city, x, y, value AS v, NULL AS u FROM px WHERE dataset = 'share' UNION ALL SELECT city, x + 200, y, NULL, value + 1 FROM px WHERE dataset = 'share') GROUP BY city, x, y) c"""),
    "bilinear_sample": query("px ref", """SELECT p.city, 'share' AS dataset, p.px, p.py, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) + 0.0 AS value FROM (
        SELECT city, px, py, floor(u) + i AS gx, floor(v) + j AS gy, (1 - abs(u - floor(u) - i)) * (1 - abs(v - floor(v) - j)) AS w FROM (
        SELECT DISTINCT city, xmin AS px, ymin AS py, xmin / 20 - 0.5 AS u, ymin / 20 - 0.5 AS v FROM ref), (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) p
        LEFT JOIN px ON px.city = p.city AND px.dataset = 'share' AND px.x = gx * 20 AND px.y = gy * 20 GROUP BY p.city, p.px, p.py"""),
    "raster_global_rollup": query("rc", "SELECT dataset, grid, resolution_m, count(DISTINCT city) AS n_cities, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_tiles", "tp_total", "fp_total", "fn_total")) + ", " + ", ".join(f"round(sum({c}), 6) + 0.0 AS {c}" for c in ("valid_area_total_m2", "ref_area_total_m2", "pred_area_total_m2")) + ", "
        + ", ".join(f"round(median({c}_area), 6) + 0.0 AS {c}_area_median" for c in ("precision", "recall", "f1")) + ", " + ", ".join(f"round({_WAVG.format(c=c, w='valid_area_total_m2')}, 6) + 0.0 AS {c}_wavg" for c in (*_RM, "f1_tile_median", "rel_area_error_median")) + f", {_GLOBAL} FROM rc GROUP BY dataset, grid, resolution_m"),
    "best_raster_per_city_grid": query("rc", f"SELECT city, grid, resolution_m, dataset, {r('f1_area precision_area recall_area f1_tile_mean')} FROM (SELECT *, row_number() OVER (PARTITION BY city, grid, resolution_m ORDER BY f1_area DESC, dataset) AS k FROM rc) WHERE k = 1"),
    "name_match_scores": query("nm", "SELECT * FROM nm"),
    "best_folder_match": query("bm", "SELECT * FROM bm"),
    "download_summary": query("sum", "SELECT * FROM sum"),
    "unmatched_codes": query("sum", "SELECT row_id, code, quality, is_high_quality, code_norm FROM sum WHERE NOT downloaded"),
    "duplicate_codes": query("sum", "SELECT code_norm, count(*) AS duplicate_rows, string_agg(DISTINCT code, ' | ' ORDER BY code) AS dataset_codes FROM sum WHERE code_norm <> '' GROUP BY code_norm HAVING count(*) > 1"),
    "duplicate_matches": query("nm sum", "SELECT nm.*, candidate_folder_count, code, quality, is_high_quality FROM nm JOIN (SELECT row_id, count(DISTINCT dataset_folder_name) AS candidate_folder_count FROM nm GROUP BY row_id) USING (row_id) JOIN (SELECT row_id, code, quality, is_high_quality FROM sum) USING (row_id) WHERE candidate_folder_count > 1"),
    "file_manifest": query("sum file", "SELECT code, quality, is_high_quality, dataset_folder_name, match_rule, match_score, ambiguous_match, path, size_bytes, modified_time, id, mime_type FROM file JOIN (SELECT DISTINCT code, quality, is_high_quality, dataset_folder_name, match_rule, match_score, ambiguous_match FROM sum WHERE downloaded) s USING (dataset_folder_name) WHERE is_high_quality"),
    "aoi_ref_listing": query("sum file", """SELECT s.row_id, s.code, s.quality, s.is_high_quality, s.dataset_folder_name, s.match_rule, s.match_score, s.ambiguous_match, a.names AS aoi_file_name, a.paths AS aoi_file_path, coalesce(a.n, 0) AS aoi_file_count, coalesce(a.n, 0) > 0 AS has_aoi_file,
        b.names AS reference_file_name, b.paths AS reference_file_path, coalesce(b.n, 0) AS reference_file_count, coalesce(b.n, 0) > 0 AS has_reference_file FROM sum s
        LEFT JOIN (SELECT dataset_folder_name, string_agg(DISTINCT name, ' | ' ORDER BY name) AS names, string_agg(DISTINCT path, ' | ' ORDER BY path) AS paths, count(id) AS n FROM file WHERE lower(name) LIKE '%\\_aoi.geojson' ESCAPE '\\' GROUP BY 1) a ON a.dataset_folder_name = s.dataset_folder_name
        LEFT JOIN (SELECT dataset_folder_name, string_agg(DISTINCT name, ' | ' ORDER BY name) AS names, string_agg(DISTINCT path, ' | ' ORDER BY path) AS paths, count(id) AS n FROM file WHERE lower(name) LIKE '%\\_ref.geojson' ESCAPE '\\' OR lower(name) LIKE '%\\_hotosm.geojson' ESCAPE '\\' GROUP BY 1) b ON b.dataset_folder_name = s.dataset_folder_name"""),
    "quality_value_counts": query("sheet", "SELECT trim(quality) AS quality_value, count(*) AS count FROM sheet WHERE trim(quality) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "tracker_explode": query("aoi_file", "SELECT dataset, slug, file_name, path, sub_aoi_id, count(*) OVER (PARTITION BY dataset) > 1 AS is_multi_aoi FROM aoi_file WHERE upper(trim(has_aoi_file)) = 'TRUE' AND lower(trim(suitable)) = 'yes'"),
    "tracker_high_quality": query("aoi_file", "SELECT dataset, slug, file_name, path, sub_aoi_id, count(*) OVER (PARTITION BY dataset) > 1 AS is_multi_aoi FROM aoi_file WHERE upper(trim(has_aoi_file)) = 'TRUE' AND upper(trim(is_high_quality)) = 'TRUE'"),
    "validation_areas": query("aoi_file", "SELECT dataset, slug, file_name, path, sub_aoi_id, count(*) OVER (PARTITION BY dataset) > 1 AS is_multi_aoi FROM aoi_file WHERE lower(suitable) = 'yes' AND trim(dataset) <> ''"),
    "tracker_references": query("track", """SELECT dataset, replace(replace(dataset, '-', '_'), ' ', '_') AS slug, coalesce(string_agg(p, '|' ORDER BY first_at), '') AS ref_paths, CASE WHEN count(p) = 1 THEN min(p) END AS ref_path FROM (
        SELECT t.dataset_folder_name AS dataset, t.dataset_folder_name || '/vector/' || u.f AS p, min(t.row_id * 100 + u.j) AS first_at FROM track t LEFT JOIN LATERAL (SELECT unnest(t.refs) AS f, generate_subscripts(t.refs, 1) AS j) u ON true
        WHERE lower(t.suitable) = 'yes' AND trim(t.dataset_folder_name) <> '' GROUP BY 1, 2) GROUP BY dataset"""),
    "quality_flag": query("track", """SELECT row_id, dataset_folder_name, CASE WHEN lower(trim(suitable)) IN ('yes', 'high') THEN true WHEN lower(trim(suitable)) IN ('no', 'unsuitable') THEN false ELSE coalesce(suitable LIKE '%suitable%', false) END AS is_high_quality, lower(trim(has_aoi_file)) = 'true' AS has_file,
        replace(replace(dataset_folder_name, '-', '_'), ' ', '_') AS slug, replace(upper(dataset_folder_name[1]) || dataset_folder_name[2:], '-', ' ') AS label FROM track"""),
    "inventory_rows": query("map_row", """SELECT dataset, bool_or(a) AS has_aoi_file, bool_or(r) AS has_reference_file, max(n) AS aoi_file_count, max(m) AS reference_file_count, max(score) AS match_score,
        string_agg(DISTINCT path, ' | ' ORDER BY path) FILTER (WHERE f = 1) || ' | b/x.geojson' AS aoi_file_paths, string_agg(DISTINCT file, ' | ' ORDER BY file) FILTER (WHERE f = 1) || ' | x.geojson' AS aoi_file_names,
        round(least(6 + sqrt(greatest(max(n), max(m), 1)) * 3.5, 28), 6) + 0.0 AS radius FROM (SELECT *, 1 AS f FROM map_row) GROUP BY dataset"""),
    "bbox_extract": query("cand part", "SELECT c.city, c.dataset, c.bld_id FROM cand c JOIN part p ON p.city = c.city AND p.sub_aoi_id = 'part_1' WHERE c.xmin <= p.xmax AND c.xmax >= p.xmin AND c.ymin <= p.ymax AND c.ymax >= p.ymin"),
    "sub_aoi_tagging": query("ref part", "SELECT c.city, c.bld_id, p.sub_aoi_id FROM ref c JOIN part p ON p.city = c.city WHERE c.xmin <= p.xmax AND c.xmax >= p.xmin AND c.ymin <= p.ymax AND c.ymax >= p.ymin"),
    "range_lookup": "SELECT p_partkey, 900 + k AS article_id FROM part, (SELECT unnest(range(10)) AS k) WHERE p_partkey BETWEEN k * 173 AND k * 173 + 150",
    "tracker_tiles": """SELECT name, '20160701' AS start, '20200701' AS end, lon, lat, CAST(round(lon - 0.011, 6) AS DOUBLE) AS xmin, CAST(round(lat + 2.011, 6) AS DOUBLE) AS ymax FROM (
        SELECT 'WSFtracker_20160701' || CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '_' END || '20200701_' || (s_suppkey % 40 - 20) || '_' || (s_suppkey % 30 - 15) || '.tif' AS name, CAST(s_suppkey % 40 - 20 AS INTEGER) AS lon, CAST(s_suppkey % 30 - 15 AS INTEGER) AS lat FROM supplier WHERE s_suppkey % 6 <> 0)
        WHERE (lon - 0.011 <= 4 AND lon + 2.011 >= -3 AND lat - 0.011 <= 5 AND lat + 2.011 >= -3) OR (lon - 0.011 <= 11 AND lon + 2.011 >= 10 AND lat - 0.011 <= 2 AND lat + 2.011 >= 1)""",
    "split_bounds": query("ref", """SELECT bld_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, xmin + i * 7 AS x0, ymin + j * 5 AS y0, least(xmin + i * 7 + 7, xmax) AS x1, least(ymin + j * 5 + 5, ymax) AS y1 FROM ref, (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j)
        WHERE i < ceil((xmax - xmin) / 7) AND j < ceil((ymax - ymin) / 5)"""),
    "select_files": """WITH f AS (SELECT p_size AS tile, 'tile_' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '.zip' WHEN p_partkey % 3 = 0 THEN '.shp' ELSE '.txt' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.bak' END AS name, p_partkey FROM part),
        k AS (SELECT *, CASE WHEN name LIKE '%.zip' THEN 0 WHEN name LIKE '%.shp' THEN 1 ELSE 2 END AS k FROM f) SELECT tile, name, p_partkey FROM (SELECT *, min(k) OVER (PARTITION BY tile) AS m FROM k) WHERE k = m""",
    "first_file": "SELECT p_brand AS dataset, min(p_brand || '_' || p_partkey || '.parquet') AS name FROM part GROUP BY p_brand",
    "work_list": "SELECT lower(r_name) AS product, year, lower(r_name) || '_' || year AS label FROM region, (VALUES (2018), (2020), (2025)) y(year)",
    "tile_density": query("dens", "SELECT * FROM dens"),
    "density_class_summary": query("dens", "SELECT density_class, count(*) AS tiles, CAST(sum(n_buildings) AS BIGINT) AS buildings, min(buildings_per_km2) AS min_density, median(buildings_per_km2) AS median_density, max(buildings_per_km2) AS max_density FROM dens GROUP BY density_class"),
    "iou_histogram": query("tm m", """SELECT dataset, bin, round(bin / 30, 6) + 0.0 AS lo, round((bin + 1) / 30, 6) + 0.0 AS hi, CAST(sum(n) AS BIGINT) AS n FROM (SELECT dataset, CAST(least(29, floor(iou * 30)) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT dataset, 0, CAST(sum(fp + fn) AS BIGINT) FROM tm GROUP BY dataset) GROUP BY dataset, bin"""),
    "boxplot_stats": query("tm", """SELECT q.dataset, n, round(q1, 6) + 0.0 AS q1, round(md, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, round(min(f1), 6) + 0.0 AS low, round(max(f1), 6) + 0.0 AS high FROM (SELECT dataset, count(f1) AS n, quantile_cont(f1, 0.25) AS q1, median(f1) AS md, quantile_cont(f1, 0.75) AS q3 FROM tm GROUP BY dataset) q
        JOIN tm t ON t.dataset = q.dataset AND t.f1 >= q1 - 1.5 * (q3 - q1) AND t.f1 <= q3 + 1.5 * (q3 - q1) GROUP BY q.dataset, n, q1, md, q3"""),
    "iou_by_size_quantile": query("m", """SELECT dataset, bin, count(*) AS n, round(avg(iou), 6) + 0.0 AS mean_iou, round(median(iou), 6) + 0.0 AS median_iou, min(area_ref) AS min_area, max(area_ref) AS max_area FROM (
        SELECT m.*, CAST((area_ref > a) AS INTEGER) + CAST((area_ref > b) AS INTEGER) + CAST((area_ref > c) AS INTEGER) AS bin FROM m JOIN (SELECT dataset, quantile_cont(area_ref, 0.25) AS a, quantile_cont(area_ref, 0.5) AS b, quantile_cont(area_ref, 0.75) AS c FROM m GROUP BY dataset) q ON q.dataset = m.dataset) GROUP BY dataset, bin"""),
    "f1_pivot": query("vc", "SELECT city, max(f1_city) FILTER (WHERE dataset = 'ds_0') AS ds_0, max(f1_city) FILTER (WHERE dataset = 'ds_1') AS ds_1, max(f1_city) FILTER (WHERE dataset = 'ds_2') AS ds_2 FROM vc GROUP BY city"),
    "tile_f1_map": query("tile tm", "SELECT t.city, t.tile_id, x.dataset, round(x.f1, 6) + 0.0 AS f1 FROM tile t LEFT JOIN tm x ON x.city = t.city AND x.tile_id = t.tile_id AND x.dataset = 'ds_1' AND x.f1 > 0.9"),
    "polygon_area": query("ref", f"""SELECT bld_id, round(w * h * 0.75, 6) + 0.0 AS area, round(2 * (w + h), 6) + 0.0 AS length, round(x + (w * h * w / 2 - w * h / 4 * w * 0.75) / (w * h * 0.75), 6) + 0.0 AS cx, round(y + (w * h * h / 2 - w * h / 4 * h * 0.75) / (w * h * 0.75), 6) + 0.0 AS cy FROM ({_HEX})"""),
    "point_in_polygon": query("ref", "SELECT bld_id, NOT (bld_id % 10 / 10.0 >= 0.5 AND bld_id % 7 / 7.0 >= 0.5) AS inside FROM ref"),
    "size_bins": f"SELECT {BIN.format('p_size * p_size')} AS size_bin, count(*) AS n FROM part GROUP BY 1",
    "iou_mean": query("tm m", "SELECT x.dataset, CAST(n + z AS BIGINT) AS n, round(s / (n + z), 6) + 0.0 AS mean_iou FROM (SELECT dataset, sum(iou) AS s, count(*) AS n FROM m GROUP BY dataset) x JOIN (SELECT dataset, sum(fp + fn) AS z FROM tm GROUP BY dataset) y ON x.dataset = y.dataset"),
    "iou_by_size_class": query("sized", "SELECT dataset, rb AS size_bin, count(*) AS n, round(avg(iou), 6) + 0.0 AS mean_iou, round(median(iou), 6) + 0.0 AS median_iou, round(median(rel_area_error), 6) + 0.0 AS median_rel_area_error FROM sized GROUP BY dataset, rb"),
    "outline_extract": query("cand four", f"""SELECT city, dataset, bld_id FROM cand JOIN (SELECT 'city_' || c AS k, {X('c')} AS x, {Y('c')} AS y FROM four) ON city = k
        WHERE xmin <= x + 3000 AND ymin <= y + 3000 AND xmax >= x AND ymax >= y AND greatest(xmin - x, 0) + greatest(ymin - y, 0) <= 3000"""),
    "buffered_extract": query("cand part", """SELECT c.city, c.dataset, c.bld_id FROM cand c JOIN part p ON p.city = c.city AND p.sub_aoi_id = 'part_2'
        WHERE pow(greatest(0, p.xmin - c.xmax, c.xmin - p.xmax), 2) + pow(greatest(0, p.ymin - c.ymax, c.ymin - p.ymax), 2) <= 625"""),
    "area_mask": query("four", f"""SELECT city, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, (gx + 0.5) * 50 - x + (gy + 0.5) * 50 - y < 3000 AS in_area FROM (
        SELECT 'city_' || c AS city, x, y, unnest(range(CAST(ceil(x / 50 - 0.5) AS BIGINT), CAST(ceil((x + 3000) / 50 - 0.5) AS BIGINT))) AS gx, gy FROM (
        SELECT c, x, y, unnest(range(CAST(ceil(y / 50 - 0.5) AS BIGINT), CAST(ceil((y + 3000) / 50 - 0.5) AS BIGINT))) AS gy FROM (SELECT c, {X('c')} AS x, {Y('c')} AS y FROM four)))"""),
    "utm_projection": """WITH p AS (SELECT s_suppkey, CAST((s_suppkey * 37) % 359 AS DOUBLE) - 179.5 AS lon, CAST((s_suppkey * 53) % 159 AS DOUBLE) - 79.5 AS lat FROM supplier),
        z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, sqrt((2 - 1 / 298.257223563) / 298.257223563) AS e, 1 / (2 * 298.257223563 - 1) AS n FROM p),
        t AS (SELECT *, radians(lon - (6 * zone - 183)) AS lam, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM z),
        u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS k, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM t)
        SELECT s_suppkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg, round(500000 + k * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
        round(CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END + k * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM u""",
    "dissolved_area": "SELECT 'city_' || c AS city, CAST(2750 * 2400 AS DOUBLE) AS union_area FROM (VALUES (0), (1), (2), (3)) t(c)",
    # quarters of unit squares by both diagonals: each is in a diamond or out of it as a whole
    "dissolved_outlines": f"""WITH o AS (SELECT o_orderkey % 4 AS c, (o_orderkey * 7919) % 3001 AS x, (o_orderkey * 104729) % 3001 AS y, 3 + o_orderkey % 5 AS r FROM orders),
        q AS (SELECT DISTINCT c, i, j, a FROM (SELECT c, x + dx AS i, y + dy AS j, a, abs(dx + a1) + abs(dy + a2) AS far, r FROM o, (SELECT unnest(range(-7, 7)) AS dx), (SELECT unnest(range(-7, 7)) AS dy), (VALUES (0, 0.5, 0.2), (1, 0.5, 0.8), (2, 0.2, 0.5), (3, 0.8, 0.5)) t(a, a1, a2)) WHERE far < r AND (r < 5 OR far > r - 3))
        SELECT * FROM (SELECT 'city_' || c AS city, CAST(count(*) / 4 AS DOUBLE) AS area_m2 FROM q GROUP BY c) JOIN (SELECT 'city_' || c AS city, min(x - r) + {X('c')} AS xmin, min(y - r) + {Y('c')} AS ymin, max(x + r) + {X('c')} AS xmax, max(y + r) + {Y('c')} AS ymax FROM o GROUP BY c) USING (city)""",
    "repaired_outlines": query("ref", "SELECT bld_id, CAST(CASE WHEN bld_id % 3 = 2 THEN 1 ELSE 2 END AS BIGINT) AS n_parts, CAST(CASE bld_id % 3 WHEN 0 THEN 2 ELSE 4 END * pow(1 + bld_id % 9, 2) AS DOUBLE) AS area_m2 FROM ref"),
    "buffered_outlines": "SELECT 'city_' || (o_orderkey % 4) AS city, count(*) AS n_parts, round(sum(pow(4 + o_orderkey % 23, 2) + 24 * (4 + o_orderkey % 23) + 32 * 36 * sin(pi() / 32)), 2) + 0.0 AS area_m2 FROM orders GROUP BY 1",
    "raster_warp": """WITH k AS (SELECT 1 / (2 * 298.257223563 - 1) AS n), m AS (SELECT n, 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r,
          n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3, 2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 AS d1, 7 * n ** 2 / 3 - 8 * n ** 3 / 5 AS d2, 56 * n ** 3 / 15 AS d3 FROM k),
        t AS (SELECT o_orderkey % 110 AS gx, o_orderkey // 110 AS gy, (5566700.0 - 40.0 * (gy + 0.5)) / r AS xi, (571300.0 + 40.0 * (gx + 0.5) - 500000) / r AS eta, m.* FROM orders, m),
        p AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS p, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS q FROM t),
        g AS (SELECT *, asin(sin(p) / cosh(q)) AS chi, 9 + degrees(atan2(sinh(q), cos(p))) AS lon FROM p),
        u AS (SELECT gx, gy, (lon - 10.0) / 0.0005 AS u, (degrees(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi)) - 50.25) / -0.0005 AS v FROM g),
        c AS (SELECT o_orderkey % 120 AS col, o_orderkey // 120 AS row, CASE WHEN o_orderkey % 17 <> 3 THEN CAST(o_orderkey * 7919 % 1009 AS DOUBLE) END AS value FROM orders),
        w AS (SELECT gx, gy, floor(u - 0.5) + i AS col, floor(v - 0.5) + j AS row, (1 - abs(u - 0.5 - (floor(u - 0.5) + i))) * (1 - abs(v - 0.5 - (floor(v - 0.5) + j))) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
        SELECT u.gx, u.gy, round(c.value, 4) + 0.0 AS nearest, round(b.value, 4) + 0.0 AS bilinear FROM u LEFT JOIN c ON c.col = floor(u.u) AND c.row = floor(u.v)
        JOIN (SELECT gx, gy, sum(w * value) / nullif(sum(w) FILTER (WHERE value IS NOT NULL), 0) AS value FROM w LEFT JOIN c USING (col, row) GROUP BY gx, gy) b ON b.gx = u.gx AND b.gy = u.gy""",
    "order_area_methods": """WITH px AS (SELECT 'city_' || (o_orderkey % 4) AS city, o_orderkey // 400 AS row, o_orderkey // 4 % 100 AS col, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderkey % 25 AS DOUBLE) END AS value FROM orders)
        SELECT method, city, row, col, round(area, 6) + 0.0 AS area, coalesce(CASE WHEN method = 7 THEN area / 400 >= 0.5 WHEN method >= 3 THEN area > 0 ELSE area / 400 >= 0.05 END, false) AS built FROM (
        SELECT CAST(method AS INTEGER) AS method, city, row, col, CASE WHEN value IS NULL THEN NULL ELSE CASE method WHEN 0 THEN least(1.0, greatest(0.0, value)) * 400 WHEN 1 THEN value / 100 * 400 WHEN 2 THEN least(greatest(0.0, value), 400.0) WHEN 3 THEN CASE WHEN value >= 0.5 THEN 400.0 ELSE 0.0 END
        WHEN 4 THEN CASE WHEN value <> 0 THEN 400.0 ELSE 0.0 END WHEN 5 THEN CASE WHEN value IN (3, 5, 8) THEN 400.0 ELSE 0.0 END WHEN 6 THEN CASE WHEN value >= 1 AND value <= 10 THEN 400.0 ELSE 0.0 END ELSE CASE WHEN value >= 1 AND value <= 19 THEN 400.0 ELSE 0.0 END END END AS area
        FROM px, (SELECT unnest(range(8)) AS method))""",
    "order_regrid": """WITH px AS (SELECT 'city_' || (o_orderkey % 4) AS city, o_orderkey // 4 % 100 * 20.0 AS x, o_orderkey // 400 * 20.0 AS y, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 7 % 101 / 100.0 END AS v FROM orders),
        w AS (SELECT city, gx, gy, v, (least(x + 20, gx * 50 + 50) - greatest(x, gx * 50)) * (least(y + 20, gy * 50 + 50) - greatest(y, gy * 50)) AS w, floor((gx * 50 + 25) / 20) * 20 = x AND floor((gy * 50 + 25) / 20) * 20 = y AS near
          FROM px, LATERAL (SELECT unnest(range(CAST(floor(x / 50) AS BIGINT), CAST(ceil((x + 20) / 50) AS BIGINT))) AS gx) a, LATERAL (SELECT unnest(range(CAST(floor(y / 50) AS BIGINT), CAST(ceil((y + 20) / 50) AS BIGINT))) AS gy) b)
        SELECT city, 'orders' AS dataset, gx, gy, round(sum(CASE WHEN v >= 0.05 THEN w ELSE 0 END) FILTER (WHERE v IS NOT NULL) / sum(w) FILTER (WHERE v IS NOT NULL), 6) + 0.0 AS built_share,
          round(sum(w * v * 400) / sum(w) FILTER (WHERE v IS NOT NULL) * 6.25, 6) + 0.0 AS pred_area, coalesce(bool_or(near AND v IS NOT NULL), false) AS valid FROM w GROUP BY city, gx, gy""",
    "order_mosaic_clip": """WITH px AS (SELECT 'city_' || (o_orderkey % 4) AS city, o_orderkey // 4 % 100 * 20 AS x, o_orderkey // 400 * 20 AS y, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 7 % 101 / 100.0 END AS v FROM orders),
        h AS (SELECT city, max(y) + 21 AS h FROM px GROUP BY city),
        m AS (SELECT city, x, y, max(v) AS v, max(u) AS u FROM (SELECT city, x, y, v, NULL AS u FROM px UNION ALL SELECT city, x + 200, y, NULL, v + 1 FROM px) GROUP BY city, x, y)
        SELECT city, 'orders' AS dataset, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN (x + 10) * h + (y + 10) * 2001 < 2001 * h THEN round(coalesce(v, u), 6) + 0.0 END AS value FROM m JOIN h USING (city)""",
    "diamond_cells": f"""SELECT DISTINCT city, cx, cy FROM (SELECT 'city_' || c AS city, cx, cy, abs((cx + 0.5) * 1.4142 - x) + abs((cy + 0.5) * 1.4142 - y) AS far, r FROM (
        SELECT o_orderkey % 4 AS c, (o_orderkey * 7919) % 3001 + {X('o_orderkey % 4')} AS x, (o_orderkey * 104729) % 3001 + {Y('o_orderkey % 4')} AS y, 3 + o_orderkey % 5 AS r FROM orders),
        LATERAL (SELECT unnest(range(CAST(floor((x - r) / 1.4142) AS BIGINT), CAST(ceil((x + r) / 1.4142) AS BIGINT))) AS cx) a, LATERAL (SELECT unnest(range(CAST(floor((y - r) / 1.4142) AS BIGINT), CAST(ceil((y + r) / 1.4142) AS BIGINT))) AS cy) b)
        WHERE far < r AND (r < 5 OR far >= r - 3)""",
    "release_as_of": """WITH a AS (SELECT o_orderkey, ['view', 'signup', 'click', 'error', 'purchase'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS event_type, make_timestamp((1704067200 + o_orderkey * 397 % 2592000) * 1000000) AS moment FROM orders)
        SELECT a.o_orderkey, a.event_type, e.event_id FROM a ASOF LEFT JOIN events e ON a.event_type = e.event_type AND a.moment >= e.ts""",
    "temporal_composite": """WITH e AS (SELECT user_id % 50 AS col, event_id % 40 AS row, CAST(ts AS DATE) AS d, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS k, value, event_id FROM events),
        a AS (SELECT DISTINCT d AS day FROM e), m AS (SELECT day, col, row, value, d, row_number() OVER (PARTITION BY day, col, row ORDER BY d DESC, k, event_id DESC) AS n FROM a JOIN e ON d <= day AND d >= day - 6 WHERE k IS NOT NULL AND value IS NOT NULL)
        SELECT CAST(day AS VARCHAR) AS day, col, row, value, CAST(d AS VARCHAR) AS newest FROM m WHERE n = 1""",
    "file_tree": """WITH RECURSIVE i AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 3 THEN NULL ELSE c_custkey // 3 END AS parent, 'n' || c_custkey AS name FROM customer WHERE c_custkey > 0),
        t AS (SELECT id, name, 1 AS level, name AS path, name AS top_folder FROM i WHERE parent IS NULL UNION ALL SELECT i.id, i.name, t.level + 1, t.path || '/' || i.name, t.top_folder FROM i JOIN t ON i.parent = t.id) SELECT * FROM t""",
}

#: The same queries under the names they had while the above kept to a part.
ORACLE_SQL |= {"split_bounds_all": ORACLE_SQL["split_bounds"], "file_tree_all": ORACLE_SQL["file_tree"]}
