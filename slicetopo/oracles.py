"""DuckDB SQL of the registered queries. Values that the definitions, ranks and labels must
have are literals here, and none comes from the code that is tested."""

B1 = """
b1 AS (SELECT set_id, roi, z, x0, x0 + 2 * (p % 5 + 1) AS x1, p % 8 AS y0, p % 8 + 2 * (o % 5 + 1) AS y1 FROM (
  SELECT CAST(l_suppkey // 40 AS BIGINT) AS set_id, CAST(l_suppkey % 40 AS BIGINT) AS roi, CAST(l_linenumber AS BIGINT) AS z,
    CAST(floor(l_quantity / 4) AS BIGINT) AS x0, CAST(l_partkey AS BIGINT) AS p, CAST(l_orderkey AS BIGINT) AS o,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1)"""
B2 = """
b2k AS (SELECT CAST(s_suppkey // 60 AS BIGINT) AS set_id, CAST(s_suppkey % 60 AS BIGINT) AS k FROM supplier),
b2r AS (SELECT set_id, k, k AS roi FROM b2k UNION ALL SELECT set_id, k, k + 1000 FROM b2k WHERE k % 15 = 0),
b2 AS (SELECT *, (x1 - x0) * (y1 - y0) * (z1 - z0 + 1) AS volume FROM (SELECT set_id, roi, k % 6 AS x0, k % 6 + 2 * (1 + k % 4) AS x1,
  (7 * k) % 5 AS y0, (7 * k) % 5 + 2 * (1 + (k // 4) % 4) AS y1, k % 3 AS z0, k % 3 + 1 + (k // 3) % 3 AS z1 FROM b2r))"""


def _cells(a: str, b: str) -> str:
    ox, oy = (f"(least({a}.{u}1, {b}.{u}1) - greatest({a}.{u}0, {b}.{u}0))" for u in "xy")
    out = lambda p, q: f"({p}.x0 < {q}.x0 OR {p}.x1 > {q}.x1 OR {p}.y0 < {q}.y0 OR {p}.y1 > {q}.y1)"
    same = lambda u: f"({a}.{u}0 IN ({b}.{u}0, {b}.{u}1) OR {a}.{u}1 IN ({b}.{u}0, {b}.{u}1))"
    return f"""262657 * (1 + CASE WHEN {ox} > 0 AND {oy} > 0 THEN 256 ELSE 0 END + CASE WHEN {out(a, b)} THEN 64 ELSE 0 END
  + CASE WHEN {out(b, a)} THEN 4 ELSE 0 END + CASE WHEN ({same("x")} AND {oy} > 0) OR ({same("y")} AND {ox} > 0) THEN 16 ELSE 0 END)"""


#: Relation, label, symbol in a matrix, symmetric, transitive, complement, rank, mask, value.
DEFS = """(VALUES
  ('EQUAL', 'is Equal to', '=', true, true, 'EQUAL', 1, 89128960, 71303168),
  ('CONTAINS', 'Contains', '⊂', false, true, 'WITHIN', 4, 89128960, 83886080),
  ('WITHIN', 'is Within', '⊃', false, true, 'CONTAINS', 5, 89128960, 68157440),
  ('PARTITIONED', 'is Partitioned by', '⊕', false, false, 'PARTITIONS', 2, 89128960, 88080384),
  ('PARTITIONS', 'Partitions', '⊗', false, false, 'PARTITIONED', 3, 89128960, 72351744),
  ('OVERLAPS', 'Overlaps with', '∩', true, false, 'OVERLAPS', 13, 84934656, 84934656),
  ('BORDERS', 'Borders', '|', true, false, 'BORDERS', 10, 71469056, 4229120),
  ('CONFINES', 'Confines', '⊏', false, false, 'CONFINED', 6, 89294848, 22183936),
  ('CONFINED', 'is Confined by', '⊐', false, false, 'CONFINES', 7, 89294848, 22153216),
  ('SURROUNDS', 'Surrounds', '○', false, true, 'ENCLOSED', 8, 89294848, 17989632),
  ('ENCLOSED', 'is Enclosed by', '○', false, true, 'SURROUNDS', 9, 89294848, 17958912),
  ('SHELTERS', 'Shelters', '△', false, true, 'SHELTERED', 11, 89260356, 17826112),
  ('SHELTERED', 'is Sheltered by', '△', false, true, 'SHELTERS', 12, 89260356, 17826052),
  ('DISJOINT', 'is Disjoint from', '∅', true, false, 'DISJOINT', 14, 89163844, 17860676),
  ('UNKNOWN', 'has an Unknown relationship with', '?', false, false, '', 99, 0, 0)
) d(relation, label, symbol, is_symmetric, is_transitive, complement, rank, mask, value)"""
NAME = """CASE WHEN bits & 89128960 = 71303168 THEN 'EQUAL' WHEN bits & 89128960 = 83886080 THEN 'CONTAINS' WHEN bits & 89128960 = 68157440 THEN 'WITHIN'
  WHEN bits & 89128960 = 88080384 THEN 'PARTITIONED' WHEN bits & 89128960 = 72351744 THEN 'PARTITIONS' WHEN bits & 84934656 = 84934656 THEN 'OVERLAPS'
  WHEN bits & 71469056 = 4229120 THEN 'BORDERS' WHEN bits & 89294848 = 22183936 THEN 'CONFINES' WHEN bits & 89294848 = 22153216 THEN 'CONFINED'
  WHEN bits & 89294848 = 17989632 THEN 'SURROUNDS' WHEN bits & 89294848 = 17958912 THEN 'ENCLOSED' WHEN bits & 89260356 = 17826112 THEN 'SHELTERS'
  WHEN bits & 89260356 = 17826052 THEN 'SHELTERED' WHEN bits & 89163844 = 17860676 THEN 'DISJOINT' ELSE 'UNKNOWN' END"""
NAMES = ("EQUAL", "CONTAINS", "WITHIN", "PARTITIONED", "PARTITIONS", "OVERLAPS", "BORDERS", "CONFINES", "CONFINED", "SURROUNDS", "ENCLOSED", "SHELTERS", "SHELTERED", "DISJOINT", "UNKNOWN")
SLICE_REL = f"""{B1}, sr AS (SELECT *, {NAME} AS relation FROM (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, a.z, CAST({_cells("a", "b")} AS INTEGER) AS bits
  FROM b1 a JOIN b1 b ON a.set_id = b.set_id AND a.z = b.z AND a.roi < b.roi))"""
PAIR_REL = f"""{B2}, pr AS (SELECT *, {NAME} AS relation FROM (SELECT set_id, roi_a, roi_b, CAST(bit_or(bits) AS INTEGER) AS bits FROM (
  SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, CASE WHEN s.z BETWEEN a.z0 AND a.z1 AND s.z BETWEEN b.z0 AND b.z1 THEN {_cells("a", "b")}
    WHEN s.z BETWEEN a.z0 AND a.z1 THEN 262657 * 73 WHEN s.z BETWEEN b.z0 AND b.z1 THEN 262657 * 7 ELSE 0 END AS bits
  FROM b2 a JOIN b2 b ON a.set_id = b.set_id AND (a.volume > b.volume OR (a.volume = b.volume AND a.roi < b.roi))
  CROSS JOIN (SELECT unnest(range(0, 8)) AS z) s) GROUP BY ALL))"""

#: The contour way over the solid boxes: caps half-way to the set's next slice, or a quarter of
#: the spacing beyond its ends; volumes with caps; places by falling volume.
CONTOUR = f"""{B2},
zs AS (SELECT DISTINCT set_id, unnest(range(z0, z1 + 1)) AS z FROM b2),
step AS (SELECT set_id, coalesce(median(d), 0) AS step FROM (SELECT set_id, lead(z) OVER (PARTITION BY set_id ORDER BY z) - z AS d FROM zs) GROUP BY 1),
cp AS (SELECT b.*, (x1 - x0) * (y1 - y0) AS area,
  round(coalesce((b.z0 + (SELECT max(z) FROM zs WHERE zs.set_id = b.set_id AND z < b.z0)) / 2.0, b.z0 - step / 4.0), 2) AS lo,
  round(coalesce((b.z1 + (SELECT min(z) FROM zs WHERE zs.set_id = b.set_id AND z > b.z1)) / 2.0, b.z1 + step / 4.0), 2) AS hi FROM b2 b JOIN step USING (set_id)),
vol AS (SELECT *, CAST(area * (hi - lo) AS DOUBLE) AS v FROM cp),
pl AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY v DESC, roi) AS place FROM vol)"""


def _nine(a: str, b: str) -> str:
    ox, oy = (f"(least({a}.{u}1, {b}.{u}1) - greatest({a}.{u}0, {b}.{u}0))" for u in "xy")
    out = lambda p, q: f"({p}.x0 < {q}.x0 OR {p}.x1 > {q}.x1 OR {p}.y0 < {q}.y0 OR {p}.y1 > {q}.y1)"
    same = lambda u: f"({a}.{u}0 IN ({b}.{u}0, {b}.{u}1) OR {a}.{u}1 IN ({b}.{u}0, {b}.{u}1))"
    within = lambda p, q, u: f"(({q}.{u}0 > {p}.{u}0 AND {q}.{u}0 < {p}.{u}1) OR ({q}.{u}1 > {p}.{u}0 AND {q}.{u}1 < {p}.{u}1))"
    through = lambda p, q: f"(({within(p, q, 'x')} AND {oy} > 0) OR ({within(p, q, 'y')} AND {ox} > 0))"
    bit = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
    return " + ".join(["1", bit(f"{ox} > 0 AND {oy} > 0", 256), bit(through(a, b), 128), bit(out(a, b), 64 + 8), bit(through(b, a), 32), bit(f"({same('x')} AND {oy} > 0) OR ({same('y')} AND {ox} > 0)", 16), bit(out(b, a), 4 + 2)])


_MEET = "(least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))"
#: Two structures meet on whole slices, where a cap of one lies inside the other, and where
#: caps fall together; slices of one that the other lacks count as outside.
CONTOUR_REL = f"""{CONTOUR}, cr AS (SELECT *, {NAME} AS relation FROM (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b,
  CAST((CASE WHEN greatest(a.z0, b.z0) <= least(a.z1, b.z1) THEN 262657 * ({_nine("a", "b")}) ELSE 0 END)
  | (CASE WHEN {_MEET} AND ((b.lo > a.z0 AND b.lo < a.z1) OR (b.hi > a.z0 AND b.hi < a.z1)) THEN 128 * 262144 ELSE 0 END)
  | (CASE WHEN {_MEET} AND ((a.lo > b.z0 AND a.lo < b.z1) OR (a.hi > b.z0 AND a.hi < b.z1)) THEN 32 * 262144 ELSE 0 END)
  | (CASE WHEN {_MEET} AND (a.lo IN (b.lo, b.hi) OR a.hi IN (b.lo, b.hi)) THEN 16 * 262144 ELSE 0 END)
  | (CASE WHEN a.z0 < b.z0 OR a.z1 > b.z1 THEN 262657 * 73 ELSE 0 END) | (CASE WHEN b.z0 < a.z0 OR b.z1 > a.z1 THEN 262657 * 7 ELSE 0 END) AS INTEGER) AS bits
  FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place))"""
_CORNERS = lambda p: f"[{{'x': {p}.x0, 'y': {p}.y0}}, {{'x': {p}.x0, 'y': {p}.y1}}, {{'x': {p}.x1, 'y': {p}.y0}}, {{'x': {p}.x1, 'y': {p}.y1}}]"
_FAR = lambda p, q: f"list_max([list_min([sqrt((u.x - w.x) ** 2 + (u.y - w.y) ** 2) FOR w IN {_CORNERS(q)}]) FOR u IN {_CORNERS(p)}])"
_MARGIN = f"""{CONTOUR_REL}, mg AS (SELECT cr.*, a.x1 - b.x1 AS xp, b.x0 - a.x0 AS xm, a.y1 - b.y1 AS yp, b.y0 - a.y0 AS ym, abs(a.z1 - b.z1) AS zp, abs(a.z0 - b.z0) AS zm,
  greatest({_FAR("a", "b")}, {_FAR("b", "a")}) AS far, relation IN ('EQUAL', 'PARTITIONED', 'CONFINES') AS zero
  FROM cr JOIN pl a ON a.set_id = cr.set_id AND a.roi = roi_a JOIN pl b ON b.set_id = cr.set_id AND b.roi = roi_b WHERE relation IN ('CONTAINS', 'SURROUNDS', 'SHELTERS', 'PARTITIONED', 'CONFINES', 'EQUAL'))"""
_V = lambda x: f"CASE WHEN zero THEN 0.0 ELSE CAST(round({x}, 2) AS DOUBLE) END"

#: Regions of the boxes on slices: runs of overlapping boxes on following slices.
REGION_REL = f"""{B1}, pv AS (SELECT *, lag(z) OVER w AS pz, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM b1 WINDOW w AS (PARTITION BY set_id, roi ORDER BY z)),
rg AS (SELECT *, CAST(sum(CASE WHEN pz = z - 1 AND least(x1, px1) > greatest(x0, px0) AND least(y1, py1) > greatest(y0, py0) THEN 0 ELSE 1 END) OVER (PARTITION BY set_id, roi ORDER BY z) AS BIGINT) AS reg FROM pv),
rr AS (SELECT *, {NAME} AS relation FROM (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, a.reg AS reg_a, b.reg AS reg_b, CAST(bit_or(CAST({_cells("a", "b")} AS INTEGER)) AS INTEGER) AS bits
  FROM rg a JOIN rg b ON a.set_id = b.set_id AND a.z = b.z AND a.roi < b.roi GROUP BY ALL)),
wh AS (SELECT *, {NAME} AS relation FROM (SELECT set_id, roi_a, roi_b, CAST(bit_or(bits) AS INTEGER) AS bits FROM rr GROUP BY ALL)),
kd AS (SELECT set_id, roi_a, roi_b, relation, label, rank, count(*) AS n FROM rr JOIN {DEFS} USING (relation) GROUP BY ALL),
kn AS (SELECT set_id, roi_a, roi_b, sum(n) AS pairs, count(*) AS kinds, min(label) AS one, string_agg(label, ' & ' ORDER BY rank, n DESC) AS many, string_agg(label || ':' || n, '; ' ORDER BY rank, n DESC) AS summary FROM kd GROUP BY ALL),
lb AS (SELECT set_id, roi_a, roi_b, wh.relation, pairs, kinds, summary, CASE WHEN pairs = 1 OR kinds = 0 THEN CASE wh.relation WHEN 'UNKNOWN' THEN '' ELSE label END WHEN kinds = 1 THEN one
  WHEN wh.relation <> 'UNKNOWN' THEN '{{' || label || '}}' ELSE '{{' || many || '}}' END AS label FROM wh JOIN kn USING (set_id, roi_a, roi_b) JOIN {DEFS} ON d.relation = wh.relation)"""

RULE_SQL = """
m AS (SELECT p_partkey AS roi, lower(p_type) LIKE '%romo' AS r1, lower(p_type) LIKE 'standard%' AS r2, regexp_matches(p_type, '(?i)small|MEDIUM') AS r3,
  lower(p_brand) = 'brand#12' AND regexp_matches(p_type, '(?i)large') AS r4 FROM part),
rep AS (SELECT roi, CASE WHEN r2 THEN false ELSE true END AS selected, CASE WHEN r4 THEN true WHEN r3 THEN false ELSE true END AS displayed,
  concat_ws(',', CASE WHEN r1 THEN 'promo' END, CASE WHEN r2 THEN 'standard' END, CASE WHEN r3 THEN 'small' END, CASE WHEN r4 THEN 'shown' END) AS matched,
  CASE WHEN r4 THEN 'shown' WHEN r3 THEN 'small' WHEN r2 THEN 'standard' WHEN r1 THEN 'promo' END AS final FROM m)"""


NAMES_SQL = """
nm AS (SELECT p_partkey AS roi, CASE WHEN p_partkey % 3 = 0 THEN (['PTV','gtv','ITV','CTV'])[CAST(p_partkey % 4 + 1 AS INT)] || ' ' || CAST(40 + p_partkey % 30 AS VARCHAR) || (['','a','b'])[CAST(p_partkey % 3 + 1 AS INT)]
  WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) || ([' L',' R',' B','','_PRV05'])[CAST(p_partkey % 5 + 1 AS INT)]
  ELSE (['opt ','eval '])[CAST(p_partkey % 2 + 1 AS INT)] || split_part(p_name, ' ', 1) || ([' a',' b',''])[CAST(p_partkey % 3 + 1 AS INT)] END AS name FROM part)"""


_TESTS = ((89128960, 71303168, "EQUAL"), (89128960, 83886080, "CONTAINS"), (89128960, 68157440, "WITHIN"), (89128960, 88080384, "PARTITIONED"), (89128960, 72351744, "PARTITIONS"), (84934656, 84934656, "OVERLAPS"), (71469056, 4229120, "BORDERS"), (89294848, 22183936, "CONFINES"), (89294848, 22153216, "CONFINED"), (89294848, 17989632, "SURROUNDS"), (89294848, 17958912, "ENCLOSED"), (89260356, 17826112, "SHELTERS"), (89260356, 17826052, "SHELTERED"), (89163844, 17860676, "DISJOINT"))
_HOLD = lambda bits: "list_filter([" + ", ".join(f"CASE WHEN {bits} & {m} = {v} THEN '{n}' END" for m, v, n in _TESTS) + "], lambda x: x IS NOT NULL)"
#: Each band transposed: of nine bits the first, fifth and last stay.
_TURNED = "(bits & 71565585) | " + " | ".join(f"((bits & {m * 262657}) {'>>' if k > 0 else '<<'} {abs(k)})" for m, k in ((128, 2), (64, 4), (8, 2), (32, -2), (4, -4), (2, -2)))

#: Paths are walked one edge at a time and carry their structures and their own edges.
#: Transitive types share a graph; a type and those that imply it share another.
LOGICAL = f"""WITH RECURSIVE {PAIR_REL},
ends AS (SELECT set_id, roi_a AS roi, 0 AS n FROM pr UNION ALL SELECT set_id, roi_b, 1 FROM pr),
ord AS (SELECT set_id, roi, row_number() OVER (PARTITION BY set_id ORDER BY sum(n), roi) AS place FROM ends GROUP BY 1, 2),
te AS (SELECT set_id, 'transitive' AS graph, roi_a, roi_b, true AS own FROM pr WHERE relation IN ('CONTAINS', 'WITHIN', 'SURROUNDS', 'ENCLOSED', 'SHELTERS', 'SHELTERED')
  UNION ALL SELECT set_id, t.target, roi_a, roi_b, relation = t.target FROM pr JOIN (VALUES ('CONTAINS', 'PARTITIONED'), ('WITHIN', 'PARTITIONS'), ('SURROUNDS', 'CONFINES'), ('ENCLOSED', 'CONFINED')) t(target, implying) ON relation IN (t.target, t.implying)),
walk AS (SELECT set_id, graph, roi_a AS a, roi_b AS b, [roi_a, roi_b] AS path, own, NOT own AS other FROM te
  UNION ALL SELECT w.set_id, w.graph, w.a, e.roi_b, list_append(w.path, e.roi_b), w.own OR e.own, w.other OR NOT e.own FROM walk w JOIN te e ON e.set_id = w.set_id AND e.graph = w.graph AND e.roi_a = w.b WHERE NOT list_contains(w.path, e.roi_b)),
tr AS (SELECT set_id, a, b, count(*) AS n, arg_min(path, (-len(path), path)) AS path FROM walk WHERE graph = 'transitive' GROUP BY 1, 2, 3),
im AS (SELECT set_id, graph, a, b, arg_min(path, (-len(path), path)) AS path FROM walk WHERE graph <> 'transitive' AND len(path) > 2 AND (own OR graph NOT IN ('CONTAINS', 'WITHIN')) GROUP BY 1, 2, 3, 4),
s1 AS (SELECT pr.set_id, pr.roi_a, pr.roi_b, relation, CASE WHEN relation = 'EQUAL' THEN [] WHEN tr.n > 1 AND len(tr.path) > 2 THEN tr.path[2:-2] WHEN im.path IS NOT NULL THEN im.path[2:-2] ELSE [] END AS via
  FROM pr LEFT JOIN tr ON tr.set_id = pr.set_id AND tr.a = roi_a AND tr.b = roi_b LEFT JOIN im ON im.set_id = pr.set_id AND im.graph = relation AND im.a = roi_a AND im.b = roi_b),
eq AS (SELECT set_id, roi_a AS x, roi_b AS y FROM pr WHERE relation = 'EQUAL' UNION SELECT set_id, roi_b, roi_a FROM pr WHERE relation = 'EQUAL'),
same AS (SELECT set_id, roi, roi AS other FROM ord UNION SELECT w.set_id, w.roi, e.y FROM same w JOIN eq e ON w.set_id = e.set_id AND w.other = e.x),
top AS (SELECT same.set_id, same.roi, arg_min(ord.roi, ord.place) AS c FROM same JOIN ord ON ord.set_id = same.set_id AND ord.roi = same.other GROUP BY 1, 2),
s2 AS (SELECT s1.*, p.c AS ca, q.c AS cb, coalesce(t.relation, u.relation) AS tops FROM s1 JOIN top p ON p.set_id = s1.set_id AND p.roi = roi_a JOIN top q ON q.set_id = s1.set_id AND q.roi = roi_b
  LEFT JOIN pr t ON t.set_id = s1.set_id AND t.roi_a = p.c AND t.roi_b = q.c LEFT JOIN pr u ON u.set_id = s1.set_id AND u.roi_a = q.c AND u.roi_b = p.c),
s3 AS (SELECT *, list_concat(CASE WHEN ca <> roi_a THEN [ca] ELSE [] END, CASE WHEN cb <> roi_b THEN [cb] ELSE [] END) AS peers FROM s2),
s4 AS (SELECT set_id, roi_a, roi_b, relation, ca, cb, CASE WHEN relation = 'EQUAL' THEN CASE WHEN ca NOT IN (roi_a, roi_b) THEN [ca] ELSE [] END
  WHEN len(peers) > 0 AND tops = relation THEN list_concat(peers, [x FOR x IN via IF NOT list_contains(peers, x)]) ELSE via END AS via FROM s3),
own AS (SELECT s4.set_id, s4.roi_a, s4.roi_b, list(v ORDER BY i) AS via FROM (SELECT *, unnest(via) AS v, generate_subscripts(via, 1) AS i FROM s4 WHERE relation <> 'EQUAL' AND ca = roi_a AND cb = roi_b) s4
  JOIN top ON top.set_id = s4.set_id AND top.roi = v WHERE top.c NOT IN (roi_a, roi_b) GROUP BY 1, 2, 3)
SELECT CAST(s4.set_id AS VARCHAR) AS set_id, s4.roi_a, s4.roi_b, relation, len(f.via) > 0 AS is_logical, array_to_string(f.via, ',') AS intermediates
FROM s4 LEFT JOIN own ON own.set_id = s4.set_id AND own.roi_a = s4.roi_a AND own.roi_b = s4.roi_b
CROSS JOIN LATERAL (SELECT CASE WHEN relation <> 'EQUAL' AND ca = s4.roi_a AND cb = s4.roi_b THEN coalesce(own.via, []) ELSE s4.via END AS via) f"""


ORACLES = {
    "logical_flags": LOGICAL,
    "relation_matches": f"WITH {PAIR_REL}, h AS (SELECT *, {_HOLD('bits')} AS there, {_HOLD(f'({_TURNED})')} AS back FROM pr) SELECT set_id, roi_a, roi_b, CAST(len(there) AS INT) AS n_matches, array_to_string(there, ',') AS names, CAST(len(back) AS INT) AS n_reverse, array_to_string(back, ',') AS reverse_names FROM h",
    "box_slice_relations": f"WITH {SLICE_REL} SELECT * FROM sr",
    "box_pair_relations": f"WITH {PAIR_REL} SELECT * FROM pr",
    "streamed_relations": f"WITH {PAIR_REL} SELECT * FROM pr",
    "relation_histogram_ranked": f"WITH {PAIR_REL} SELECT relation, CAST(rank AS INTEGER) AS rank, count(*) AS n FROM pr JOIN {DEFS} USING (relation) GROUP BY 1, 2",
    "relation_matrix_long": f"""WITH {PAIR_REL}, c AS (SELECT relation, CASE complement WHEN '' THEN 'UNKNOWN' ELSE complement END AS complement FROM {DEFS})
SELECT set_id, roi_b AS row_roi, roi_a AS col_roi, relation FROM pr UNION ALL SELECT set_id, roi_a, roi_b, complement FROM pr JOIN c USING (relation) UNION ALL SELECT set_id, roi, roi, 'EQUAL' FROM b2""",
    "relation_transpose_check": f"""WITH {PAIR_REL}, c AS (SELECT relation, complement FROM {DEFS})
SELECT set_id, roi_a, roi_b, CASE complement WHEN '' THEN 'UNKNOWN' ELSE complement END AS reverse, complement, lpad(bin(bits), 27, '0') AS text FROM pr JOIN c USING (relation)""",
    "relation_cumulative": f"WITH {SLICE_REL}, cu AS (SELECT set_id, roi_a, roi_b, z, bit_or(bits) OVER (PARTITION BY set_id, roi_a, roi_b ORDER BY z ROWS UNBOUNDED PRECEDING) AS bits FROM sr) SELECT set_id, roi_a, roi_b, z, {NAME} AS relation FROM cu",
    "relation_slice_pivot": f"WITH {SLICE_REL} SELECT z, " + ", ".join(f"count(*) FILTER (relation = '{x}') AS \"{x}\"" for x in NAMES) + " FROM sr GROUP BY z",
    "logical_contains": f"""WITH {PAIR_REL}, e AS (SELECT set_id, roi_a, roi_b FROM pr WHERE relation = 'CONTAINS'),
t AS (SELECT p.set_id, p.roi_a, q.roi_b, min(p.roi_b) AS via, string_agg(CAST(p.roi_b AS VARCHAR), ',' ORDER BY p.roi_b) AS between_ids FROM e p JOIN e q ON p.set_id = q.set_id AND p.roi_b = q.roi_a GROUP BY 1, 2, 3)
SELECT e.*, via IS NOT NULL AS is_logical, via, coalesce(between_ids, '') AS intermediates FROM e LEFT JOIN t USING (set_id, roi_a, roi_b)""",
    "logical_limited_mode": f"""WITH {PAIR_REL}, e AS (SELECT set_id, roi_a, roi_b FROM pr WHERE relation = 'CONTAINS'),
t AS (SELECT p.set_id, p.roi_a, q.roi_b, min(p.roi_b) AS via, string_agg(CAST(p.roi_b AS VARCHAR), ',' ORDER BY p.roi_b) AS between_ids FROM e p JOIN e q ON p.set_id = q.set_id AND p.roi_b = q.roi_a GROUP BY 1, 2, 3)
SELECT e.*, via IS NOT NULL AS is_logical, via, coalesce(between_ids, '') AS intermediates, NOT (via IS NOT NULL AND len([x FOR x IN string_split(between_ids, ',') IF CAST(x AS BIGINT) NOT BETWEEN 1 AND 12]) = 0) AS shown, false AS faded FROM e LEFT JOIN t USING (set_id, roi_a, roi_b)""",
    "equal_components": f"""WITH RECURSIVE {PAIR_REL}, e AS (SELECT set_id, roi_a AS x, roi_b AS y FROM pr WHERE relation = 'EQUAL' UNION SELECT set_id, roi_b, roi_a FROM pr WHERE relation = 'EQUAL'),
w AS (SELECT set_id, roi, roi AS other FROM b2 UNION SELECT w.set_id, w.roi, e.y FROM w JOIN e ON w.set_id = e.set_id AND w.other = e.x) SELECT set_id, roi, min(other) AS canonical FROM w GROUP BY 1, 2""",
    "region_label": f"WITH {REGION_REL} SELECT set_id, roi_a, roi_b, label FROM lb",
    "relation_description": f"WITH {REGION_REL} SELECT set_id, roi_a, roi_b, label AS consolidated_label, relation AS consolidated_type, pairs > 1 AS has_multiple_regions, CAST(pairs AS BIGINT) AS n_region_pairs, summary FROM lb",
    "box_metrics": f"""WITH {PAIR_REL}, j AS (SELECT pr.set_id, roi_a, roi_b, relation, greatest(a.x0 - b.x1, b.x0 - a.x1, 0) AS gx, greatest(a.y0 - b.y1, b.y0 - a.y1, 0) AS gy, greatest(a.z0 - b.z1, b.z0 - a.z1, 0) AS gz,
greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) * greatest(least(a.z1, b.z1) - greatest(a.z0, b.z0) + 1, 0) AS c, a.volume + b.volume AS v,
least(b.x0 - a.x0, a.x1 - b.x1, b.y0 - a.y0, a.y1 - b.y1) AS m, greatest(b.x0 - a.x0, a.x1 - b.x1, b.y0 - a.y0, a.y1 - b.y1) AS w
FROM pr JOIN b2 a ON pr.set_id = a.set_id AND roi_a = a.roi JOIN b2 b ON pr.set_id = b.set_id AND roi_b = b.roi)
SELECT set_id, roi_a, roi_b, relation, gx * gx + gy * gy + gz * gz AS gap2, c AS overlap_volume, 2000 * c // v AS dice_permille,
CASE WHEN relation IN ('CONTAINS', 'PARTITIONED', 'EQUAL') THEN m END AS margin, CASE WHEN relation IN ('CONTAINS', 'PARTITIONED', 'EQUAL') THEN w END AS widest FROM j""",
    "volume_rank": f"WITH {B2} SELECT set_id, roi, volume, row_number() OVER (PARTITION BY set_id ORDER BY volume DESC, roi) AS place FROM b2",
    "region_components": f"""WITH {B1}, p AS (SELECT *, lag(z) OVER w AS pz, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM b1 WINDOW w AS (PARTITION BY set_id, roi ORDER BY z))
SELECT set_id, roi, CAST(sum(CASE WHEN pz = z - 1 AND least(x1, px1) > greatest(x0, px0) AND least(y1, py1) > greatest(y0, py0) THEN 0 ELSE 1 END) AS BIGINT) AS n_regions FROM p GROUP BY 1, 2""",
    "nearest_slice": f"""WITH {B1}, p AS (SELECT set_id, roi, z, lag(z) OVER w AS before, lead(z) OVER w AS after FROM b1 WINDOW w AS (PARTITION BY set_id, roi ORDER BY z))
SELECT *, CASE WHEN before IS NULL THEN after WHEN after IS NULL OR z - before <= after - z THEN before ELSE after END AS nearest FROM p""",
    "slice_sequence": f"""WITH {B1}, p AS (SELECT set_id, roi, z, lag(z) OVER w AS previous_z, lead(z) OVER w AS next_z FROM b1 WINDOW w AS (PARTITION BY set_id, roi ORDER BY z))
SELECT *, CASE WHEN previous_z IS NOT NULL AND next_z IS NOT NULL THEN (next_z - previous_z) / 2.0 ELSE CAST(coalesce(z - previous_z, next_z - z) AS DOUBLE) END AS gap FROM p""",
    "slice_spacing": f"WITH {B1}, p AS (SELECT set_id, roi, lead(z) OVER (PARTITION BY set_id, roi ORDER BY z) - z AS s FROM b1) SELECT set_id, roi, coalesce(median(s), 0.01) AS spacing, count(*) AS n_slices FROM p GROUP BY 1, 2",
    "missing_slices": """WITH y1 AS (SELECT DISTINCT CAST(o_custkey // 40 AS BIGINT) AS set_id, CAST(o_custkey % 40 AS BIGINT) AS roi, CAST(year(o_orderdate) AS BIGINT) AS z FROM orders), r AS (SELECT set_id, roi, min(z) AS lo, max(z) AS hi FROM y1 GROUP BY 1, 2), g AS (SELECT DISTINCT set_id, z FROM y1)
SELECT r.set_id, r.roi, g.z, (SELECT max(z) FROM y1 h WHERE h.set_id = r.set_id AND h.roi = r.roi AND h.z < g.z) AS inf1,
(SELECT z FROM (SELECT h.z, row_number() OVER (ORDER BY h.z DESC) AS n FROM y1 h WHERE h.set_id = r.set_id AND h.roi = r.roi AND h.z < g.z) WHERE n = 2) AS inf2,
(SELECT min(z) FROM y1 h WHERE h.set_id = r.set_id AND h.roi = r.roi AND h.z > g.z) AS sup1,
(SELECT z FROM (SELECT h.z, row_number() OVER (ORDER BY h.z) AS n FROM y1 h WHERE h.set_id = r.set_id AND h.roi = r.roi AND h.z > g.z) WHERE n = 2) AS sup2
FROM r JOIN g ON r.set_id = g.set_id AND g.z BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM y1 h WHERE h.set_id = r.set_id AND h.roi = r.roi AND h.z = g.z)""",
    "slice_gaps": f"""WITH {B1}, r AS (SELECT set_id, roi, count(DISTINCT z) AS n, min(z) AS lo, max(z) AS hi FROM b1 GROUP BY 1, 2), g AS (SELECT DISTINCT set_id, z FROM b1)
SELECT r.set_id, roi, n, count(*) AS expected, n < count(*) AS has_gaps FROM r JOIN g ON r.set_id = g.set_id AND g.z BETWEEN lo AND hi GROUP BY r.set_id, roi, n""",
    "trapezoid_volume": f"""WITH {B1}, a AS (SELECT set_id, roi, z, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM b1),
p AS (SELECT set_id, roi, (lead(z) OVER w - z) * (lead(area) OVER w + area) / 2.0 AS part FROM a WINDOW w AS (PARTITION BY set_id, roi ORDER BY z)) SELECT set_id, roi, coalesce(sum(part), 0.0) AS volume FROM p GROUP BY 1, 2""",
    "structure_summary": f"""WITH {B1}, a AS (SELECT set_id, roi, z, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM b1),
p AS (SELECT set_id, roi, z, (lead(z) OVER w - z) * (lead(area) OVER w + area) / 2.0 AS part FROM a WINDOW w AS (PARTITION BY set_id, roi ORDER BY z))
SELECT set_id, roi, coalesce(sum(part), 0.0) AS volume, count(*) AS num_contours, count(DISTINCT z) AS num_slices, min(z) || ' to ' || max(z) AS slice_range FROM p GROUP BY 1, 2""",
    "filter_rule_report": f"WITH {RULE_SQL} SELECT *, CASE final WHEN 'promo' THEN 'DICOM Type suffix romo' WHEN 'standard' THEN 'DICOM Type prefix standard' WHEN 'small' THEN 'DICOM Type regex small|MEDIUM' WHEN 'shown' THEN 'Brand exact BRAND#12; with DICOM Type regex large' ELSE '' END AS reason FROM rep",
    "filter_preview": f"WITH {RULE_SQL} SELECT count(*) FILTER (final IS NOT NULL) AS matched, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT displayed) AS hidden FROM rep",
    "filter_excluded": f"WITH {RULE_SQL} SELECT roi FROM rep WHERE selected",
    "include_exclude_names": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m]') AND NOT regexp_matches(p_name, 'green|z$')",
    "name_groups": f"""WITH {NAMES_SQL} SELECT roi, name, regexp_extract(trim(name), ' ([LRB])$', 1) AS side,
CASE WHEN regexp_matches(name, '(?i)^(opt|eval) ') THEN nullif(trim(regexp_replace(trim(regexp_replace(trim(name), '(?i)^(opt|eval) ', '')), ' [abc]$', '')), '') END AS variant,
CASE WHEN regexp_matches(name, '(?i)(I?[GCPIH]TV)\\s*\\d+') AND NOT regexp_matches(trim(name), '(?i)^(opt|eval) ') THEN upper(regexp_extract(name, '(?i)(I?[GCPIH]TV)\\s*(\\d+)(?:[a-c])?\\b', 1)) || regexp_extract(name, '(?i)(I?[GCPIH]TV)\\s*(\\d+)(?:[a-c])?\\b', 2) END AS dose FROM nm""",
    "swapped_text": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B is in A' WHEN 1 THEN 'A and B' WHEN 2 THEN 'B and A touch A' ELSE 'AB, a and B' END AS given,
CASE p_partkey % 4 WHEN 0 THEN 'A is in B' WHEN 1 THEN 'A and B' WHEN 2 THEN 'B and A touch B' ELSE 'AB, a and A' END AS swapped,
CASE p_partkey % 3 WHEN 0 THEN 'plan.dcm' WHEN 1 THEN '0123456789abcdef0123456789abcdef_x.dcm' ELSE 'upload_' END AS file FROM part""",
    "name_checks": f"WITH {NAMES_SQL} SELECT roi, length(name) <= 16 AS short_enough, NOT contains(name, ' ') AS no_spaces, count(*) OVER (PARTITION BY lower(name)) = 1 AS no_duplicate, regexp_matches(name, '^[zZ_]') AS hidden FROM nm",
    "custom_sort_index": """WITH r AS (SELECT p_partkey, p_type, p_size, CAST(CASE p_brand WHEN 'Brand#17' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#2' THEN 3 ELSE 4 END AS INTEGER) AS brand_rank FROM part)
SELECT p_partkey, brand_rank, dense_rank() OVER (PARTITION BY brand_rank ORDER BY p_type, p_size DESC) AS sort_index FROM r""",
    "rounding": """SELECT l_orderkey, l_linenumber, CAST(ceil(floor(l_extendedprice) / pow(10, floor(log10(floor(l_extendedprice))))) * pow(10, floor(log10(floor(l_extendedprice)))) AS BIGINT) AS one_up,
CAST(floor(l_extendedprice / 0.5) AS BIGINT) AS half_steps, CAST(round_even(round_even(CAST(floor(l_extendedprice) AS DOUBLE) / 10, 0) * 10, 0) AS BIGINT) AS tens, CAST(round(round_even(round_even(l_quantity * 0.125 / 0.01, 3) * 0.01, 3) * 1000) AS BIGINT) AS fine, CAST(round(round_even(round_even(l_quantity * 0.3 / 0.5, 1) * 0.5, 1) * 10) AS BIGINT) AS halves, CAST(round(l_quantity * 10000) AS BIGINT) AS zk, format('{:.4f}', CAST(l_quantity AS DOUBLE)) AS label FROM lineitem""",
    "unit_conversions": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 OR l_quantity < 1 THEN CAST(l_quantity AS DOUBLE) * 10 ELSE CAST(l_quantity AS DOUBLE) END AS mm,
CASE WHEN CAST(l_quantity AS DOUBLE) * 3 > 100 THEN CAST(l_quantity AS DOUBLE) * 3 ELSE CAST(l_quantity AS DOUBLE) * 3 * 100 END AS cgy,
CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_quantity AS INT) * 100 AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '00' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' dose' END AS dose FROM lineitem""",
    "kernel_relations": f"""WITH {SLICE_REL} SELECT sr.set_id, roi_a, roi_b, sr.z, relation,
CAST(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS BIGINT) AS common
FROM sr JOIN b1 a ON sr.set_id = a.set_id AND sr.z = a.z AND roi_a = a.roi JOIN b1 b ON sr.set_id = b.set_id AND sr.z = b.z AND roi_b = b.roi""",
    "ring_measures": f"""WITH {B1} SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi AS INTEGER) AS roi, z, (x1 - x0) * (y1 - y0) AS area,
round((x0 + x1) / 2.0, 3) AS cx, round((y0 + y1) / 2.0, 3) AS cy, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM b1""",
    "diagram_edges": f"""WITH {PAIR_REL}, h AS (SELECT e.set_id, b2.roi, least(b2.roi, min(CASE WHEN e.roi_a = b2.roi THEN e.roi_b ELSE e.roi_a END)) AS head FROM b2 JOIN pr e ON e.set_id = b2.set_id AND b2.roi IN (e.roi_a, e.roi_b) WHERE e.relation = 'EQUAL' GROUP BY 1, 2),
e AS (SELECT pr.*, ha.head AS head_a, hb.head AS head_b, label, is_symmetric FROM pr JOIN {DEFS} USING (relation) LEFT JOIN h ha ON ha.set_id = pr.set_id AND ha.roi = roi_a LEFT JOIN h hb ON hb.set_id = pr.set_id AND hb.roi = roi_b WHERE relation NOT IN ('DISJOINT', 'UNKNOWN')),
f AS (SELECT *, relation <> 'EQUAL' AND head_a IS NOT NULL AND head_a IS DISTINCT FROM head_b AND roi_a <> head_a AND EXISTS (SELECT 1 FROM e o WHERE o.set_id = e.set_id AND o.relation = e.relation AND o.roi_b = e.roi_b AND o.roi_a = e.head_a) AS peer_a,
  relation <> 'EQUAL' AND head_b IS NOT NULL AND head_a IS DISTINCT FROM head_b AND roi_b <> head_b AND EXISTS (SELECT 1 FROM e o WHERE o.set_id = e.set_id AND o.relation = e.relation AND o.roi_a = e.roi_a AND o.roi_b = e.head_b) AS peer_b FROM e)
SELECT set_id, roi_a, roi_b, relation, is_symmetric AS symmetric, CASE WHEN peer_a OR peer_b THEN '[' || label || ']' ELSE label END AS label, peer_a OR peer_b AS is_logical, false AS faded,
CASE WHEN relation = 'OVERLAPS' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, true AS layout_candidate FROM f""",
    "relation_symbols": f"""WITH {PAIR_REL}, c AS (SELECT relation, CASE complement WHEN '' THEN 'UNKNOWN' ELSE complement END AS complement FROM {DEFS}),
m AS (SELECT set_id, roi_b AS row_roi, roi_a AS col_roi, relation FROM pr UNION ALL SELECT set_id, roi_a, roi_b, complement FROM pr JOIN c USING (relation) UNION ALL SELECT set_id, roi, roi, 'EQUAL' FROM b2),
l AS (SELECT relation, label, symbol FROM {DEFS})
SELECT set_id, row_roi, col_roi, label, symbol FROM m JOIN l USING (relation)""",
    "payload_cells": f"""WITH {PAIR_REL}, c AS (SELECT relation, CASE complement WHEN '' THEN 'UNKNOWN' ELSE complement END AS complement FROM {DEFS}),
m AS (SELECT set_id, roi_b AS row_roi, roi_a AS col_roi, relation FROM pr UNION ALL SELECT set_id, roi_a, roi_b, complement FROM pr JOIN c USING (relation) UNION ALL SELECT set_id, roi, roi, 'EQUAL' FROM b2)
SELECT set_id, row_roi, col_roi, label FROM m JOIN {DEFS} USING (relation)""",
    "definition_table": f"""WITH {PAIR_REL}, t AS (SELECT {NAME} AS relation FROM (SELECT {_TURNED} AS bits FROM pr)), n AS (SELECT relation, count(*) AS n FROM (SELECT relation FROM pr UNION ALL SELECT relation FROM t) GROUP BY 1)
SELECT d.relation AS relation_type, label, is_symmetric, is_transitive, complement, mask, value, coalesce(n, 0) AS n FROM {DEFS} LEFT JOIN n ON n.relation = d.relation""",
    "structure_contours": f"""WITH {CONTOUR} SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi AS INTEGER) AS roi, CAST(z AS DOUBLE) AS z, CAST(area AS DOUBLE) AS area, false AS is_hole, 'None' AS hole_type,
roi || 'A' AS region, cap AS is_boundary FROM (SELECT set_id, roi, area, unnest(range(z0, z1 + 1)) AS z, false AS cap FROM cp UNION ALL SELECT set_id, roi, area, lo, true FROM cp UNION ALL SELECT set_id, roi, area, hi, true FROM cp)""",
    "structure_volumes": f"WITH {CONTOUR} SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi AS INTEGER) AS roi, v AS physical, v AS exterior, v AS hull, CAST(1 AS INTEGER) AS num_regions, CAST(place AS INTEGER) AS place FROM pl",
    "structure_relations": f"WITH {CONTOUR_REL} SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b, bits, relation FROM cr",
    "structure_margins": f"""WITH {_MARGIN}, w AS (SELECT *, {", ".join(f"{_V(x)} AS {n}" for n, x in (("x_minus", "xm"), ("x_plus", "xp"), ("y_minus", "ym"), ("y_plus", "yp"), ("z_minus", "zm"), ("z_plus", "zp"), ("minimum", "least(xp, xm, yp, ym)"), ("maximum", "far")))} FROM mg)
SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b, relation, x_plus, x_minus, y_plus, y_minus, z_plus, z_minus, minimum, maximum,
CASE WHEN NOT zero THEN roi_a || 'A' END AS region_a, CASE WHEN NOT zero THEN roi_b || 'A' END AS region_b,
CASE WHEN zero THEN NULL ELSE (['x_minus', 'x_plus', 'y_minus', 'y_plus', 'z_minus', 'z_plus'])[list_position([x_minus, x_plus, y_minus, y_plus, z_minus, z_plus], least(x_minus, x_plus, y_minus, y_plus, z_minus, z_plus))] END AS worst_direction FROM w""",
    "structure_distances": f"""WITH {CONTOUR_REL}, zz AS (SELECT set_id, roi, CAST(unnest(range(z0, z1 + 1)) AS DOUBLE) AS z FROM cp UNION ALL SELECT set_id, roi, lo FROM cp UNION ALL SELECT set_id, roi, hi FROM cp),
dz AS (SELECT cr.set_id, roi_a, roi_b, min(abs(p.z - q.z)) AS d FROM cr JOIN zz p ON p.set_id = cr.set_id AND p.roi = roi_a JOIN zz q ON q.set_id = cr.set_id AND q.roi = roi_b WHERE relation IN ('DISJOINT', 'SHELTERS', 'BORDERS', 'CONFINES') GROUP BY ALL)
SELECT CAST(dz.set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b,
round(sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2 + d ** 2), 2) AS minimum_distance
FROM dz JOIN pl a ON a.set_id = dz.set_id AND a.roi = roi_a JOIN pl b ON b.set_id = dz.set_id AND b.roi = roi_b""",
    "structure_overlaps": f"""WITH {CONTOUR_REL}, o AS (SELECT cr.*, greatest(least(a.z1, b.z1) - greatest(a.z0, b.z0) + 1, 0) * greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS c,
a.area * (a.z1 - a.z0 + 1) AS sa, b.area * (b.z1 - b.z0 + 1) AS sb
FROM cr JOIN pl a ON a.set_id = cr.set_id AND a.roi = roi_a JOIN pl b ON b.set_id = cr.set_id AND b.roi = roi_b WHERE relation IN ('OVERLAPS', 'PARTITIONED', 'CONTAINS', 'EQUAL'))
SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b, CASE relation WHEN 'EQUAL' THEN 1.0 ELSE round(2.0 * c / (sa + sb), 6) END AS dice,
CASE relation WHEN 'EQUAL' THEN 1.0 WHEN 'PARTITIONED' THEN round(1.0 * c / greatest(sa, sb), 6) ELSE round(2.0 * c / (sa + sb), 6) END AS overlap_ratio, CAST(c AS BIGINT) AS common_area FROM o WHERE c > 0""",
    "structure_slice_records": f"""WITH {CONTOUR}, sr AS (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, CAST(unnest(range(greatest(a.z0, b.z0), least(a.z1, b.z1) + 1)) AS DOUBLE) AS z, CAST(262657 * ({_nine("a", "b")}) AS INTEGER) AS bits
  FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place)
SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b, format('{{:.4f}}', z) AS slice, label, symbol, false AS is_interpolated, false AS has_boundary
FROM (SELECT *, {NAME} AS relation FROM sr) JOIN {DEFS} USING (relation)""",
    "region_relations": f"""WITH {CONTOUR}, rr AS (SELECT *, {NAME} AS relation FROM (SELECT a.set_id, a.roi AS roi_a, b.roi AS roi_b, CAST(262657 * ({_nine("a", "b")}) AS INTEGER) AS bits
  FROM pl a JOIN pl b ON a.set_id = b.set_id AND a.place < b.place AND (greatest(a.z0, b.z0) <= least(a.z1, b.z1) OR a.lo IN (b.lo, b.hi) OR a.hi IN (b.lo, b.hi))))
SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi_a AS INTEGER) AS roi_a, CAST(roi_b AS INTEGER) AS roi_b, roi_a || 'A' AS region_a, roi_b || 'A' AS region_b, bits, relation FROM rr""",
    "structure_table": f"""WITH {CONTOUR} SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(roi AS INTEGER) AS roi, v AS physical, v AS exterior, v AS hull, CAST(1 AS INTEGER) AS num_regions, z1 - z0 + 1 AS num_contours, z1 - z0 + 1 AS num_slices,
format('{{:.4f}}', CAST(z0 AS DOUBLE)) || ' to ' || format('{{:.4f}}', CAST(z1 AS DOUBLE)) AS slice_range, 'structure ' || roi AS name FROM pl""",
    "structure_extents": f"""WITH {CONTOUR} SELECT CAST(set_id AS VARCHAR) AS set_id, round(CASE WHEN e = 0 THEN 0 ELSE ceil(round(e / pow(10, floor(log10(e))), 9)) * pow(10, floor(log10(e))) END, 9) AS resolution
FROM (SELECT set_id, arg_max(greatest(x1 - x0, y1 - y0), (x1 - x0) * (y1 - y0) * 1000 + greatest(x1 - x0, y1 - y0)) / 1024.0 AS e FROM pl GROUP BY 1)""",
    "generated_scenes": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, CAST(1 + p_size % 4 AS DOUBLE) AS r, CASE p_partkey % 4 WHEN 2 THEN CAST(2 * (1 + p_size % 4) AS DOUBLE) ELSE CAST(1 + p_partkey % 5 AS DOUBLE) END AS h FROM part),
c AS (SELECT r, [{'x': round(r * sin(2 * pi() * i / 16), 2), 'y': round(r * cos(2 * pi() * i / 16), 2)} FOR i IN range(0, 17)] AS p FROM (SELECT DISTINCT r FROM p)),
g AS (SELECT r, abs(list_sum([p[i].x * p[i + 1].y - p[i + 1].x * p[i].y FOR i IN range(1, 17)])) / 2 AS disk FROM c),
z AS (SELECT p.*, disk, unnest([-h / 2 + i * 0.5 FOR i IN range(0, CAST(ceil(h / 0.5) AS INT) + 1)]) AS z FROM p JOIN g USING (r))
SELECT p_partkey, (['cuboid', 'cylinder', 'bar', 'prism'])[CAST(k + 1 AS INT)] AS kind, count(*) AS n_contours,
  round(sum(CASE k WHEN 0 THEN 2 * r * r WHEN 1 THEN disk WHEN 2 THEN 6 * greatest(round(2 * sqrt(greatest(r * r - z * z, 0)), 2), 0.01) ELSE 6 * r * r END), 3) AS area, min(z) AS lo, max(z) AS hi FROM z GROUP BY 1, 2""",
    "name_grammar": f"""WITH {NAMES_SQL}, g AS (SELECT roi, regexp_extract(name, '(?i)^(opt|eval|z|_)?[ _]?([A-Za-z]+?)(?:_([A-Z][a-z]+))?(?:[_ ]([LRB]))?(?:_PRV(\\d{{1,2}})?)?$', ['prefix', 'organ', 'region', 'side', 'margin']) AS p FROM nm)
SELECT roi, nullif(p.prefix, '') AS prefix, nullif(p.organ, '') AS organ, nullif(p.region, '') AS region, nullif(p.side, '') AS side, nullif(p.margin, '') AS margin FROM g""",
    # DuckDB has no look-ahead, so a target's number is told from its dose in two steps.
    "name_grammar_all": f"""WITH {NAMES_SQL}, g AS (SELECT roi, name,
  regexp_extract(trim(name), '(?i)^(opt|eval|z|_)?[ _]?(I?[GCPIH]TV)([npsv])?[_ ]?(.*)$', ['prefix', 'family', 'kind', 'rest']) AS t,
  regexp_extract(trim(name), '(?i)(.+?)([+-])(\\d+(?:\\.\\d+)?)\\s*(mm|cm)?$', ['base', 'sign', 'size', 'unit']) AS m,
  regexp_extract(trim(name), '(?i)^(opt|eval|z|_)?[ _]?([A-Za-z]+?)(?:_([A-Z][a-z]+))?(?:[_ ]([LRB]))?(?:_PRV(\\d{{1,2}})?)?$', ['prefix', 'organ', 'region', 'side', 'margin']) AS o FROM nm),
n AS (SELECT *, regexp_extract(t.rest, '^(\\d{{1,2}})(?:\\D|$)', 1) AS number FROM g),
d AS (SELECT *, regexp_extract(substr(t.rest, length(number) + 1), '(?i)^[_ ]?(\\d{{3,5}})?([a-c])?', ['dose', 'part']) AS d FROM n)
SELECT roi, name, CASE WHEN t.family <> '' THEN 'target' WHEN m.size <> '' THEN 'margin' WHEN o.organ <> '' THEN 'organ' END AS grammar,
nullif(t.prefix, '') AS target_prefix, nullif(t.family, '') AS target_family, nullif(t.kind, '') AS target_kind, nullif(number, '') AS target_number, nullif(d.dose, '') AS target_dose, nullif(d.part, '') AS target_part,
nullif(m.base, '') AS margin_base, nullif(m.sign, '') AS margin_sign, nullif(m.size, '') AS margin_size, nullif(m.unit, '') AS margin_unit,
nullif(o.prefix, '') AS organ_prefix, nullif(o.organ, '') AS organ_organ, nullif(o.region, '') AS organ_region, nullif(o.side, '') AS organ_side, nullif(o.margin, '') AS organ_margin FROM d""",
    "name_order": f"""WITH {NAMES_SQL}, g AS (SELECT roi, name,
  regexp_extract(trim(name), '(?i)^(opt|eval|z|_)?[ _]?(I?[GCPIH]TV)([npsv])?[_ ]?(.*)$', ['prefix', 'family', 'kind', 'rest']) AS t,
  regexp_extract(trim(name), '(?i)(.+?)([+-])(\\d+(?:\\.\\d+)?)\\s*(mm|cm)?$', ['base', 'sign', 'size', 'unit']) AS m,
  regexp_extract(trim(name), '(?i)^(opt|eval|z|_)?[ _]?([A-Za-z]+?)(?:_([A-Z][a-z]+))?(?:[_ ]([LRB]))?(?:_PRV(\\d{{1,2}})?)?$', ['prefix', 'organ', 'region', 'side', 'margin']) AS o FROM nm),
n AS (SELECT *, regexp_extract(t.rest, '^(\\d{{1,2}})(?:\\D|$)', 1) AS number FROM g),
d AS (SELECT *, regexp_extract(substr(t.rest, length(number) + 1), '(?i)^[_ ]?(\\d{{3,5}})?([a-c])?', ['dose', 'part']) AS d FROM n),
k AS (SELECT roi, name, CASE WHEN t.family <> '' THEN 0 WHEN m.size <> '' THEN 2 WHEN o.organ <> '' THEN 1 ELSE 3 END AS kind, * EXCLUDE (roi, name) FROM d),
p AS (SELECT roi, name, kind, CASE kind WHEN 0 THEN (CASE upper(t.family) WHEN 'GTV' THEN '1' WHEN 'CTV' THEN '2' WHEN 'ITV' THEN '3' WHEN 'PTV' THEN '4' ELSE '9' END) || lower(t.family)
  WHEN 1 THEN lower(o.organ) WHEN 2 THEN lower(m.base) ELSE lower(name) END AS a,
  CASE kind WHEN 0 THEN lpad(coalesce(nullif(d.dose, ''), '0'), 8, '0') WHEN 1 THEN lower(o.region) WHEN 2 THEN m.sign ELSE '' END AS b,
  CASE kind WHEN 0 THEN lpad(coalesce(nullif(number, ''), '0'), 8, '0') WHEN 1 THEN CASE upper(o.side) WHEN 'L' THEN '1' WHEN 'R' THEN '2' WHEN 'B' THEN '3' ELSE '0' END WHEN 2 THEN lpad(regexp_replace(m.size, '[.].*', ''), 8, '0') ELSE '' END AS c,
  CASE kind WHEN 0 THEN lower(d.part) WHEN 1 THEN lpad(coalesce(nullif(o.margin, ''), '0'), 8, '0') WHEN 2 THEN lower(m.unit) ELSE '' END AS e FROM k)
SELECT roi, name, kind, dense_rank() OVER (PARTITION BY kind ORDER BY a, b, c, e) AS place FROM p""",
    "relation_slice_pivot_all": f"WITH {SLICE_REL} SELECT z, count(*) AS pairs, " + ", ".join(f"count(*) FILTER (relation = '{x}') AS \"{x}\"" for x in NAMES) + " FROM sr GROUP BY z",
}
