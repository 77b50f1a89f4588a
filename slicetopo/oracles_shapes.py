"""DuckDB SQL of the queries about shapes. Boxes have closed forms; what frames with holes,
islands and notches have in common is counted on unit squares, without the kernel's way."""

from .oracles import B1, NAME


def strips(a: str, b: str) -> str:
    """How many sides of box a reach beyond b, as l, r, d and u, where the boxes overlap."""
    return f"{a}.x0 < {b}.x0 AS l, {a}.x1 > {b}.x1 AS r, {a}.y0 < {b}.y0 AS d, {a}.y1 > {b}.y1 AS u"


def left(a: str, b: str) -> str:
    """Polygons, holes and area of box a without b, from its strips."""
    n = "(CAST(l AS INT) + CAST(r AS INT) + CAST(d AS INT) + CAST(u AS INT))"
    return f"""(SELECT CASE WHEN NOT meet THEN 1 WHEN {n} = 0 THEN 0 WHEN {n} = 2 AND l = r THEN 2 ELSE 1 END AS np, CASE WHEN meet AND {n} = 4 THEN 1 ELSE 0 END AS nh, {a}.s - common AS area FROM (SELECT {strips(a, b)}))"""


SHAPES = f"""WITH {B1}, q AS (SELECT *, (x1 - x0) * (y1 - y0) AS s FROM b1),
p AS (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, a.z, a, b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy
  FROM q a JOIN q b ON a.set_id = b.set_id AND a.z = b.z AND a.roi < b.roi),
m AS (SELECT *, ox > 0 AND oy > 0 AS meet, CASE WHEN ox > 0 AND oy > 0 THEN ox * oy ELSE 0 END AS common, (ox >= 0 AND oy >= 0) AND (ox > 0 OR oy > 0) AS touch FROM p),
e AS (SELECT *, {left("a", "b")} AS fa, {left("b", "a")} AS fb FROM m)
""".replace("(SELECT CASE", "(SELECT {'np': CASE").replace(" END AS np, CASE", " END, 'nh': CASE").replace(" END AS nh, a.s - common AS area FROM", " END, 'area': a.s - common} FROM").replace(" END AS nh, b.s - common AS area FROM", " END, 'area': b.s - common} FROM") + """,
o AS (SELECT set_id, roi_a, roi_b, z, 'a_only' AS part, fa.np AS np, fa.nh AS nh, fa.area AS area FROM e UNION ALL SELECT set_id, roi_a, roi_b, z, 'b_only', fb.np, fb.nh, fb.area FROM e
UNION ALL SELECT set_id, roi_a, roi_b, z, 'both', CASE WHEN meet THEN 1 ELSE 0 END, 0, common FROM e
UNION ALL SELECT set_id, roi_a, roi_b, z, 'either', CASE WHEN touch THEN 1 ELSE 2 END, 0, a.s + b.s - common FROM e
UNION ALL SELECT set_id, roi_a, roi_b, z, 'one', CASE WHEN meet THEN fa.np + fb.np WHEN touch THEN 1 ELSE 2 END, CASE WHEN meet THEN fa.nh + fb.nh ELSE 0 END, a.s + b.s - 2 * common FROM e)
SELECT set_id, roi_a, roi_b, z, part, CAST(np AS BIGINT) AS n_polygons, CAST(nh AS BIGINT) AS n_holes, CAST(area AS BIGINT) AS area FROM o WHERE np > 0"""

#: Half-way boxes: mean centres and sizes; the lower box's hole, drawn in to half its size
#: about its own centre, is cut out, and of two strips the larger stays.
BETWEEN = f"""WITH {B1}, n AS (SELECT *, lead(z) OVER w AS nz, lead(x0) OVER w AS u0, lead(x1) OVER w AS u1, lead(y0) OVER w AS v0, lead(y1) OVER w AS v1 FROM b1 WINDOW w AS (PARTITION BY set_id, roi ORDER BY z)),
h AS (SELECT set_id, roi, (z + nz) / 2 AS z, (x0 + u0) / 2 AS bx0, (x1 + u1) / 2 AS bx1, (y0 + v0) / 2 AS by0, (y1 + v1) / 2 AS by1,
  x1 - x0 >= 4 AND y1 - y0 >= 4 AS has, x0 + 1 + (x1 - x0 - 2) / 4 AS hx0, x1 - 1 - (x1 - x0 - 2) / 4 AS hx1, y0 + 1 + (y1 - y0 - 2) / 4 AS hy0, y1 - 1 - (y1 - y0 - 2) / 4 AS hy1 FROM n WHERE nz IS NOT NULL),
c AS (SELECT *, greatest(bx0, hx0) AS cx0, least(bx1, hx1) AS cx1, greatest(by0, hy0) AS cy0, least(by1, hy1) AS cy1 FROM h),
m AS (SELECT *, has AND cx1 - cx0 > 0 AND cy1 - cy0 > 0 AS meet, bx0 < hx0 AS l, bx1 > hx1 AS r, by0 < hy0 AS d, by1 > hy1 AS u FROM c)
SELECT set_id, roi, z, CAST(CASE WHEN meet AND l AND r AND d AND u THEN 1 ELSE 0 END AS BIGINT) AS n_holes,
  CASE WHEN NOT meet THEN (bx1 - bx0) * (by1 - by0) WHEN NOT l AND NOT r AND NOT d AND NOT u THEN NULL
  WHEN l AND r AND NOT d AND NOT u THEN greatest(hx0 - bx0, bx1 - hx1) * (by1 - by0) WHEN d AND u AND NOT l AND NOT r THEN greatest(hy0 - by0, by1 - hy1) * (bx1 - bx0)
  ELSE (bx1 - bx0) * (by1 - by0) - (cx1 - cx0) * (cy1 - cy0) END AS area FROM m"""

_IN = lambda part, x, y: f"coalesce({x} >= {part}[1] AND {x} < {part}[2] AND {y} >= {part}[3] AND {y} < {part}[4], false)"


def _solid(x: str, y: str) -> str:
    return f"({_IN('outer_', x, y)} AND NOT {_IN('notch', x, y)})"


def _region(x: str, y: str) -> str:
    return f"(({_solid(x, y)} AND NOT (hs AND {_IN('hole', x, y)})) OR {_IN('island', x, y)} OR {_IN('second', x, y)})"


def _area(part: str) -> str:
    return f"coalesce(({part}[2] - {part}[1]) * ({part}[4] - {part}[3]), 0)"


#: The frames, their caps, volumes and places.
FRAMES = f"""
fk AS (SELECT CAST(s_suppkey // 24 AS VARCHAR) AS set_id, CAST(s_suppkey % 24 AS INT) AS j, CAST(s_suppkey // 24 % 3 AS INT) AS s FROM supplier),
fa AS (SELECT *, j % 6 AS kind, j // 6 AS a FROM fk),
fb AS (SELECT set_id, j, kind,
  CASE kind WHEN 0 THEN [2, 14, 2, 14] WHEN 1 THEN [6, 8 + a, 5 + s, 8 + s] WHEN 2 THEN [3 + a, 15, 3, 15] WHEN 3 THEN [8, 10 + a % 3, CASE a WHEN 3 THEN 4 ELSE 9 + s % 2 END, CASE a WHEN 3 THEN 6 ELSE 12 END] WHEN 4 THEN [1 + a, 17, 1, 17 - a] ELSE [2 + a, 6 + a, 4, 8] END AS outer_,
  CASE kind WHEN 0 THEN [4 + a, 12, 4, 12 - a % 2] WHEN 4 THEN [5, 13, 5, 12] END AS hole, CASE kind WHEN 4 THEN [7, 9 + a, 7, 9] END AS island,
  CASE kind WHEN 2 THEN [6 + a, 12, 7, 15] END AS notch, CASE kind WHEN 5 THEN [9 + a, 13 + a, 4 + s, 11] END AS second,
  CASE kind WHEN 0 THEN a % 2 WHEN 1 THEN 2 + a % 2 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE s END AS z0,
  CASE kind WHEN 0 THEN a % 2 + 6 WHEN 1 THEN 3 + a % 2 + s % 2 WHEN 2 THEN 3 + a % 2 WHEN 3 THEN 2 + a % 2 WHEN 4 THEN 2 + a ELSE s + 2 END AS z1, kind = 0 AS closed FROM fa),
f AS (SELECT j AS roi, * FROM fb UNION ALL SELECT j + 1000, * FROM fb WHERE j % 8 = 0),
fz AS (SELECT DISTINCT set_id, unnest(range(z0, z1 + 1)) AS z FROM f),
fs AS (SELECT set_id, coalesce(median(d), 0) AS step FROM (SELECT set_id, lead(z) OVER (PARTITION BY set_id ORDER BY z) - z AS d FROM fz) GROUP BY 1),
fc AS (SELECT f.*, round(coalesce((f.z0 + (SELECT max(z) FROM fz WHERE fz.set_id = f.set_id AND z < f.z0)) / 2.0, f.z0 - step / 4.0), 2) AS lo,
  round(coalesce((f.z1 + (SELECT min(z) FROM fz WHERE fz.set_id = f.set_id AND z > f.z1)) / 2.0, f.z1 + step / 4.0), 2) AS hi FROM f JOIN fs USING (set_id)),
fv AS (SELECT *, CAST(({_area('outer_')} - {_area('notch')} + {_area('island')} + {_area('second')} - CASE WHEN closed THEN 0 ELSE {_area('hole')} END) * (hi - lo) AS DOUBLE) AS exterior,
  CAST(({_area('outer_')} + {_area('island')} + {_area('second')}) * (hi - lo) AS DOUBLE) AS hull FROM fc),
pl AS (SELECT *, exterior - CASE WHEN closed THEN {_area('hole')} * (z1 - z0 - 1) ELSE 0 END AS physical,
  row_number() OVER (PARTITION BY set_id ORDER BY hull DESC, exterior DESC, exterior - CASE WHEN closed THEN {_area('hole')} * (z1 - z0 - 1) ELSE 0 END DESC, roi) AS place FROM fv),
xy AS (SELECT * FROM (SELECT unnest(range(0, 19)) AS x) CROSS JOIN (SELECT unnest(range(0, 19)) AS y)),
st AS (SELECT pl.*, hs FROM pl CROSS JOIN (VALUES (true), (false)) t(hs) WHERE hs OR closed),
px AS MATERIALIZED (SELECT set_id, roi, hs, x, y, {_region("x", "y")} AS r, {_region("x + 1", "y")} AS rr, {_region("x", "y + 1")} AS ru,
  ({_solid("x", "y")} AND NOT (NOT closed AND {_IN("hole", "x", "y")})) OR {_IN("island", "x", "y")} OR {_IN("second", "x", "y")} AS e, {_IN("outer_", "x", "y")} OR {_IN("second", "x", "y")} AS h FROM st CROSS JOIN xy),
pz AS (SELECT set_id, roi, z, NOT closed OR (z > z0 AND z < z1) AS hs FROM (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM pl))"""

_BIT = lambda test, n: f"CASE WHEN bool_or({test}) THEN {n} ELSE 0 END"
_THREE = lambda p, q, shift: " + ".join((_BIT(f"{p} AND {q}", 256 << shift), _BIT(f"{p} AND NOT {q}", 64 << shift), _BIT(f"NOT {p} AND {q}", 4 << shift)))
_EDGE = _BIT("(p.r <> p.rr AND q.r <> q.rr) OR (p.r <> p.ru AND q.r <> q.ru)", 16 << 18)

#: Bits that tests look at: from slices that both have, from ends that fall together, and
#: from slices of one alone.
FRAME_REL = f"""WITH {FRAMES},
ways AS (SELECT DISTINCT a.set_id, a.roi AS roi_a, b.roi AS roi_b, u.hs AS ha, w.hs AS hb FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place
  JOIN pz u ON u.set_id = a.set_id AND u.roi = a.roi JOIN pz w ON w.set_id = b.set_id AND w.roi = b.roi AND w.z = u.z),
on_slices AS (SELECT ways.set_id, roi_a, roi_b, ha, hb, {_THREE("p.r", "q.r", 18)} + {_EDGE} + {_THREE("p.e", "q.e", 9)} + {_THREE("p.h", "q.h", 0)} AS bits
  FROM ways JOIN px p ON p.set_id = ways.set_id AND p.roi = roi_a AND p.hs = ha JOIN px q ON q.set_id = ways.set_id AND q.roi = roi_b AND q.hs = hb AND q.x = p.x AND q.y = p.y GROUP BY ALL),
cap AS (SELECT set_id, roi, z, px.x, px.y FROM (SELECT set_id, roi, unnest([lo, hi]) AS z, NOT closed AS hs FROM pl) JOIN px USING (set_id, roi, hs) WHERE r
  UNION SELECT set_id, roi, z, x, y FROM (SELECT set_id, roi, unnest([z0 + 0.5, z1 - 0.5]) AS z, hole FROM pl WHERE closed) CROSS JOIN xy WHERE {_IN("hole", "x", "y")}),
ends AS (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, 16 << 18 AS bits FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place
  WHERE EXISTS (SELECT 1 FROM cap c JOIN cap d USING (set_id, z, x, y) WHERE c.set_id = a.set_id AND c.roi = a.roi AND d.roi = b.roi)),
alone AS (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, CASE WHEN a.z0 < b.z0 OR a.z1 > b.z1 THEN 262657 * 73 ELSE 0 END | CASE WHEN b.z0 < a.z0 OR b.z1 > a.z1 THEN 262657 * 7 ELSE 0 END AS bits
  FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place),
every AS (SELECT set_id, roi_a, roi_b, bits FROM on_slices UNION ALL SELECT * FROM ends UNION ALL SELECT * FROM alone),
fr AS (SELECT *, {NAME} AS relation FROM (SELECT set_id, roi_a, roi_b, CAST(bit_or(CAST(bits AS INT)) AS INT) AS bits FROM every GROUP BY ALL))"""

#: The bits of what only the first and only the second has, in all bands.
OUT_A, OUT_B = 64 * 262657, 4 * 262657
OUT = OUT_A + OUT_B

#: Each region alone: its own squares, those of its outer ring and of its hull; the larger of
#: two is A. Regions are where the structure has contours or ends.
FRAME_REGIONS = f"""WITH {FRAMES},
rg AS (SELECT set_id, roi, hs, CASE WHEN part = 'second' OR (part = 'outer' AND second IS NULL) THEN 'A' ELSE 'B' END AS label, part, outer_, hole, notch, island, second FROM st
  CROSS JOIN (VALUES ('outer'), ('island'), ('second')) t(part) WHERE part = 'outer' OR (part = 'island' AND island IS NOT NULL) OR (part = 'second' AND second IS NOT NULL)),
rx AS MATERIALIZED (SELECT set_id, roi, label, hs, x, y, CASE part WHEN 'outer' THEN {_solid("x", "y")} AND NOT (hs AND {_IN("hole", "x", "y")}) WHEN 'island' THEN {_IN("island", "x", "y")} ELSE {_IN("second", "x", "y")} END AS r,
  CASE part WHEN 'outer' THEN {_solid("x + 1", "y")} AND NOT (hs AND {_IN("hole", "x + 1", "y")}) WHEN 'island' THEN {_IN("island", "x + 1", "y")} ELSE {_IN("second", "x + 1", "y")} END AS rr,
  CASE part WHEN 'outer' THEN {_solid("x", "y + 1")} AND NOT (hs AND {_IN("hole", "x", "y + 1")}) WHEN 'island' THEN {_IN("island", "x", "y + 1")} ELSE {_IN("second", "x", "y + 1")} END AS ru,
  CASE part WHEN 'outer' THEN {_solid("x", "y")} WHEN 'island' THEN {_IN("island", "x", "y")} ELSE {_IN("second", "x", "y")} END AS e,
  CASE part WHEN 'outer' THEN {_IN("outer_", "x", "y")} WHEN 'island' THEN {_IN("island", "x", "y")} ELSE {_IN("second", "x", "y")} END AS h FROM rg CROSS JOIN xy),
rz AS (SELECT set_id, roi, CAST(z AS DOUBLE) AS z, hs FROM pz UNION SELECT set_id, roi, unnest([lo, hi]), NOT closed FROM pl UNION SELECT set_id, roi, unnest([z0 + 0.5, z1 - 0.5]), true FROM pl WHERE closed),
ways AS (SELECT DISTINCT a.set_id, a.roi AS roi_a, b.roi AS roi_b, u.hs AS ha, w.hs AS hb FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place
  JOIN rz u ON u.set_id = a.set_id AND u.roi = a.roi JOIN rz w ON w.set_id = b.set_id AND w.roi = b.roi AND w.z = u.z),
rr AS (SELECT ways.set_id, roi_a, roi_b, p.label AS la, q.label AS lb, ha, hb, {_THREE("p.r", "q.r", 18)} + {_EDGE} + {_THREE("p.e", "q.r", 9)} + {_THREE("p.h", "q.r", 0)} AS bits
  FROM ways JOIN rx p ON p.set_id = ways.set_id AND p.roi = roi_a AND p.hs = ha JOIN rx q ON q.set_id = ways.set_id AND q.roi = roi_b AND q.hs = hb AND q.x = p.x AND q.y = p.y GROUP BY ALL)
SELECT set_id, roi_a, roi_b, roi_a || la AS region_a, roi_b || lb AS region_b, {NAME} AS relation FROM (SELECT set_id, roi_a, roi_b, la, lb, CAST(bit_or(CAST(bits AS INT)) AS INT) AS bits FROM rr GROUP BY ALL)"""

_DIST = lambda p, q, e: f"sqrt(greatest({p}.x0 + {e} - {q}.x1, {q}.x0 - {p}.x1 + {e}, 0) ** 2 + greatest({p}.y0 + {e} - {q}.y1, {q}.y0 - {p}.y1 + {e}, 0) ** 2)"
_OUT = lambda p, q, e: f"({p}.x0 + {e} < {q}.x0 OR {p}.x1 - {e} > {q}.x1 OR {p}.y0 + {e} < {q}.y0 OR {p}.y1 - {e} > {q}.y1)"
_CORNER = lambda p, q: f"sqrt(greatest({q}.x0 - {p}.x0 - 0.5, {p}.x1 - 0.5 - {q}.x1, 0) ** 2 + greatest({q}.y0 - {p}.y0 - 0.5, {p}.y1 - 0.5 - {q}.y1, 0) ** 2) > 0.5"
_IF = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
#: Boxes of two or more units with boundaries half a unit wide on both sides: cores are boxes,
#: what is not outside has round corners. A core leaves such a box by a corner; a core has
#: some of the other's band if it comes near enough and is not within its core.
TOLERANCE = f"""WITH {B1} SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, a.z, CAST(1
  + {_IF("least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1", 256)}
  + {_IF(f"{_DIST('a', 'b', 0.5)} < 0.5 AND {_OUT('a', 'b', 0)}", 128)} + {_IF(_CORNER("a", "b"), 64)}
  + {_IF(f"{_DIST('b', 'a', 0.5)} < 0.5 AND {_OUT('b', 'a', 0)}", 32)} + {_IF(f"{_DIST('a', 'b', 0)} < 1 AND {_OUT('a', 'b', -1)} AND {_OUT('b', 'a', -1)}", 16)}
  + {_IF(_OUT("a", "b", 0), 8)} + {_IF(_CORNER("b", "a"), 4)} + {_IF(_OUT("b", "a", 0), 2)} AS INTEGER) AS bits
FROM b1 a JOIN b1 b ON a.set_id = b.set_id AND a.z = b.z AND a.roi < b.roi"""

#: Names are put together here from their parts, which are the answer.
NAMES = """
WITH k AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS w,
  (['', 'eval', 'opt'])[CAST(p_partkey // 3 % 3 + 1 AS INT)] AS m, (['GTV', 'CTV', 'ITV', 'PTV'])[CAST(p_partkey // 5 % 4 + 1 AS INT)] AS t, (['', 'n'])[CAST(p_partkey // 7 % 2 + 1 AS INT)] AS suffix,
  40 + p_partkey % 30 AS dose, (['', '+5mm', '-3 mm', '+1.5cm'])[CAST(p_partkey // 11 % 4 + 1 AS INT)] AS e, (['', 'L', 'R'])[CAST(p_partkey // 13 % 3 + 1 AS INT)] AS ts,
  (['', 'opt', 'PRV'])[CAST(p_partkey // 3 % 3 + 1 AS INT)] AS om, (['Parotid', 'lung', 'Kidney', 'FEMUR', 'Spinal Cord'])[CAST(p_partkey // 5 % 5 + 1 AS INT)] AS organ, ([50, 94, 118, 130, 33])[CAST(p_partkey // 5 % 5 + 1 AS INT)] AS place,
  (['', 'L', 'R', 'B'])[CAST(p_partkey // 7 % 4 + 1 AS INT)] AS os, (['', '2', '12'])[CAST(p_partkey // 11 % 3 + 1 AS INT)] AS occ,
  (['Ring', 'fiducials', 'Wire', 'Air', ''])[CAST(p_partkey // 3 % 5 + 1 AS INT)] AS x FROM part)
SELECT k AS roi, CASE k % 3 WHEN 0 THEN CASE m WHEN '' THEN '' ELSE m || ' ' END || t || suffix || ' ' || dose || e || CASE ts WHEN '' THEN '' ELSE ' ' || ts END
  WHEN 1 THEN CASE om WHEN '' THEN '' WHEN 'PRV' THEN 'PRV 5mm ' ELSE 'opt ' END || organ || CASE os WHEN '' THEN '' WHEN 'B' THEN '_B' ELSE ' ' || os END || CASE occ WHEN '' THEN '' ELSE ' ' || occ END
  ELSE w || CASE x WHEN '' THEN '' WHEN 'Wire' THEN '_Wire' ELSE ' ' || x END END AS name,
CASE k % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'organ' ELSE CASE x WHEN 'Ring' THEN 'Avoidance' WHEN 'Air' THEN 'Density' WHEN '' THEN NULL ELSE 'Marker' END END AS kind,
CASE k % 3 WHEN 0 THEN t WHEN 1 THEN organ ELSE nullif(x, '') END AS type, CASE k % 3 WHEN 0 THEN nullif(m, '') WHEN 1 THEN CASE om WHEN 'opt' THEN 'opt' END END AS mod,
CASE WHEN k % 3 = 0 THEN nullif(suffix, '') END AS level, CASE WHEN k % 3 = 0 THEN CAST(dose * 100 AS DOUBLE) END AS cgy,
CASE WHEN k % 3 = 0 THEN nullif(e[1:1], '') END AS expansion_sign, CASE WHEN k % 3 = 0 THEN CASE e WHEN '+5mm' THEN 5.0 WHEN '-3 mm' THEN 3.0 WHEN '+1.5cm' THEN 15.0 END END AS expansion_mm,
CASE k % 3 WHEN 0 THEN CASE WHEN e <> '-3 mm' THEN nullif(ts, '') END WHEN 1 THEN nullif(os, '') END AS side, CASE WHEN k % 3 = 1 AND om = 'PRV' THEN '5' END AS prv, CASE WHEN k % 3 = 1 THEN nullif(occ, '') END AS occurrence,
CAST(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE x WHEN '' THEN 3 ELSE 2 END END AS INT) AS "group",
CAST(CASE k % 3 WHEN 0 THEN CASE t WHEN 'GTV' THEN 7 WHEN 'CTV' THEN 9 WHEN 'ITV' THEN 12 ELSE 13 END WHEN 1 THEN place ELSE CASE x WHEN 'Ring' THEN 1 WHEN 'Air' THEN 6 WHEN '' THEN 0 ELSE 5 END END AS INT) AS first FROM k"""

ORACLES = {
    "name_components": NAMES,
    "structure_shapes": SHAPES,
    "tolerance_relations": TOLERANCE,
    "interpolated_boxes": BETWEEN,
    "frame_relations": FRAME_REL + f" SELECT set_id, roi_a, roi_b, relation, {NAME.replace('bits', 'turned')} AS reverse FROM (SELECT *, (bits & {(1 << 27) - 1 - OUT}) | ((bits & {OUT_A}) >> 4) | ((bits & {OUT_B}) << 4) AS turned FROM fr)",
    "frame_volumes": f"WITH {FRAMES} SELECT set_id, roi, physical, exterior, hull, CAST(CASE WHEN island IS NULL AND second IS NULL THEN 1 ELSE 2 END AS INT) AS num_regions, CAST(place AS INT) AS place FROM pl",
    "frame_contours": f"""WITH {FRAMES}, c AS (SELECT set_id, roi, z, pl.* EXCLUDE (set_id, roi), pz.hs FROM pl JOIN pz USING (set_id, roi))
SELECT set_id, roi, CAST(z AS DOUBLE) AS z, CAST({_area('outer_')} - {_area('notch')} AS DOUBLE) AS area, false AS is_hole, 'None' AS hole_type, roi || CASE WHEN second IS NULL THEN 'A' ELSE 'B' END AS region FROM c
UNION ALL SELECT set_id, roi, z, {_area('hole')}, true, CASE WHEN closed THEN 'Closed' ELSE 'Open' END, CAST(roi AS VARCHAR) FROM c WHERE hole IS NOT NULL AND hs
UNION ALL SELECT set_id, roi, z, {_area('island')}, false, 'None', roi || 'B' FROM c WHERE island IS NOT NULL
UNION ALL SELECT set_id, roi, z, {_area('second')}, false, 'None', roi || 'A' FROM c WHERE second IS NOT NULL""",
    "frame_regions": FRAME_REGIONS,
    "frame_shapes": f"""WITH {FRAMES}, v AS (SELECT DISTINCT a.set_id, a.roi AS roi_a, b.roi AS roi_b, u.z, u.hs AS ha, w.hs AS hb FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place
  JOIN pz u ON u.set_id = a.set_id AND u.roi = a.roi JOIN pz w ON w.set_id = b.set_id AND w.roi = b.roi AND w.z = u.z),
n AS (SELECT v.set_id, roi_a, roi_b, z, count(*) FILTER (p.r AND NOT q.r) AS a_only, count(*) FILTER (q.r AND NOT p.r) AS b_only, count(*) FILTER (p.r AND q.r) AS "both", count(*) FILTER (p.r OR q.r) AS either, count(*) FILTER (p.r <> q.r) AS one
  FROM v JOIN px p ON p.set_id = v.set_id AND p.roi = roi_a AND p.hs = ha JOIN px q ON q.set_id = v.set_id AND q.roi = roi_b AND q.hs = hb AND q.x = p.x AND q.y = p.y GROUP BY ALL)
SELECT * FROM (UNPIVOT n ON a_only, b_only, "both", either, one INTO NAME part VALUE area) WHERE area > 0""",
}
