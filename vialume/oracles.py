"""SQL with the rows of the registered graph queries, for an engine with ANSI SQL and keyed recursion."""

from __future__ import annotations

from vialume.functions.geo import ROAD_SCORES

D = "::DOUBLE"
LAT, LON = 45.4064, 11.8768
M31 = 2147483647


def lit(x: float) -> str:
    return f"{float(x)!r}{D}"


def hav(a: str, b: str, c: str, d: str) -> str:
    s, t = f"sin((radians({c})-radians({a}))/2)", f"sin((radians({d})-radians({b}))/2)"
    return f"(2*6371000.0{D}*asin(sqrt({s}*{s}+cos(radians({a}))*cos(radians({c}))*{t}*{t})))"


def bear(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d})-radians({b}))*cos(radians({c}))"
    x = f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d})-radians({b}))"
    return f"((degrees(atan2({y},{x}))+360.0{D})%360.0{D})"


def milli(x: str) -> str:
    return f"CAST(floor(({x})*1000+0.5{D}) AS BIGINT)"


def off_milli(x: str) -> str:
    """Thousandths cut at a place where means of tenths over few edges never fall."""
    return f"CAST(floor(({x})*1000+0.3719{D}) AS BIGINT)"


def rank(id_: str, seed: int = 42) -> str:
    return f"(({id_})*48271+{seed * 16807})%{M31}"


_NAMES = ", ".join(f"'{n}'" for n in [*ROAD_SCORES, "ferry"])
NODES = f"""nodes AS (SELECT p_partkey AS node_id, {lit(LAT)} + ((p_partkey*7919)%10007)/10007.0{D}*0.6{D} - 0.3{D} AS y,
  {lit(LON)} + ((p_partkey*6151)%10009)/10009.0{D}*0.6{D} - 0.3{D} AS x FROM part)"""
EDGES = f"""{NODES},
steps AS (SELECT l_partkey AS u, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS v,
  l_quantity + l_extendedprice/10000 AS travel_time, l_orderkey, l_linenumber FROM lineitem),
keyed AS (SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY travel_time, l_orderkey, l_linenumber) - 1 AS key, travel_time FROM steps WHERE v IS NOT NULL),
edges AS (SELECT u, v, key, CASE WHEN (u*7+v*3+key)%16 < 14 THEN [([{_NAMES}])[CAST((u*7+v*3+key)%16 + 1 AS INT)]] WHEN (u*7+v*3+key)%16 = 14 THEN ['residential', 'motorway'] END AS highway,
  CASE WHEN (u+v)%11 <> 0 THEN [{bear('a.y', 'a.x', 'b.y', 'b.x')}] END AS bearing, travel_time,
  CAST(round_even(travel_time,0) AS BIGINT) AS travel_time_s, CAST(round_even(travel_time*10,0) AS BIGINT) AS travel_time_d,
  CAST(round_even(travel_time*100,0) AS BIGINT) AS travel_time_c, CAST(round_even(travel_time*1000,0) AS BIGINT) AS travel_time_m
  FROM keyed JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)"""
MERGED = EDGES + """,
me AS (SELECT u, v, min(coalesce(travel_time_d, 1)) AS w FROM edges WHERE u <> v GROUP BY u, v)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def distances(sources: str, backwards: bool = False, name: str = "r", me: str = "me") -> str:
    """CTE (source, n, d) of shortest distances from (or to) each row of ``sources`` (source)."""
    a, b = ("v", "u") if backwards else ("u", "v")
    return f"""{name}(source, n, d) USING KEY (source, n) AS (
  SELECT source, source, CAST(0 AS BIGINT) FROM ({sources}) q
  UNION SELECT {name}.source, e.{b}, min({name}.d + e.w) FROM {name} JOIN {me} e ON {name}.n = e.{a} LEFT JOIN recurring.{name} o ON o.source = {name}.source AND o.n = e.{b}
  WHERE o.n IS NULL OR {name}.d + e.w < o.d GROUP BY {name}.source, e.{b})"""


def potentials(targets: str = "7, 11", v_max: float = 1000.0, scale: str = "10.0::DOUBLE") -> str:
    est = f"{hav('n.y', 'n.x', 't.y', 't.x')} / {lit(v_max / 3.6)} * 10.0{D} / 10.0{D}"
    y = f"CASE WHEN n.node_id = t.node_id THEN 0.0{D} ELSE -({est}) * 10.0{D} END"
    return f"""pot AS (SELECT t.node_id AS target_id, n.node_id, {y} AS y_hat, CAST(round_even({y},0) AS BIGINT) AS y_hat_int
  FROM nodes n, nodes t WHERE t.node_id IN ({targets}))"""


def reduced(weight: str = "travel_time_d") -> str:
    return f"""red AS (SELECT a.target_id, u, v, key, coalesce({weight}, 0) + a.y_hat_int - b.y_hat_int AS w_red
  FROM edges JOIN pot a ON a.node_id = u JOIN pot b ON b.node_id = v AND b.target_id = a.target_id WHERE u <> v)"""


PHI = """rm AS (SELECT target_id, u, v, min(w_red) AS w FROM red GROUP BY ALL),
p(target_id, n, d) USING KEY (target_id, n) AS (
  SELECT t.target_id, node_id, CAST(0 AS BIGINT) FROM nodes, (SELECT DISTINCT target_id FROM rm) t
  UNION SELECT p.target_id, e.v, min(p.d + e.w) FROM p JOIN rm e ON p.n = e.u AND p.target_id = e.target_id LEFT JOIN recurring.p o ON o.target_id = p.target_id AND o.n = e.v
  WHERE p.d + e.w < o.d GROUP BY p.target_id, e.v)"""
SAN = """san AS (SELECT r.target_id, u, v, key, CAST(greatest(0, w_red + a.d - b.d) AS BIGINT) AS w_san FROM red r JOIN p a ON a.target_id = r.target_id AND a.n = u JOIN p b ON b.target_id = r.target_id AND b.n = v)"""

BANDS = "bands(band, rmin, rmax, name) AS (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE, 'Centro'), (1, 5.0::DOUBLE, 15.0::DOUBLE, 'Periferia'), (2, 15.0::DOUBLE, 60.0::DOUBLE, 'Provincia'))"


#: Places of the regional centres, and the regional bands.
CENTRES = {"Padova": (LAT, LON), "Venezia": (45.4408, 12.3155), "Verona": (45.4384, 10.9916), "Vicenza": (45.5455, 11.5354), "Treviso": (45.6669, 12.2450), "Belluno": (46.1424, 12.2166), "Rovigo": (45.0712, 11.7901)}
REGIONAL_BANDS = "regional(band, rmin, rmax, name) AS (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE, 'a'), (1, 10.0::DOUBLE, 30.0::DOUBLE, 'b'), (2, 30.0::DOUBLE, 80.0::DOUBLE, 'c'))"


def banded(lat: float = LAT, lon: float = LON, name: str = "banded", bands: str = "bands") -> str:
    km = f"{hav('y', 'x', lit(lat), lit(lon))} / 1000"
    return f"{name} AS (SELECT node_id, y, x, {km} AS dist_km, band, b.name FROM nodes JOIN {bands} b ON {km} >= rmin AND {km} < rmax)"


ATTRS = f"""scores(tag, score) AS (VALUES {', '.join(f"('{k}', {v}{D})" for k, v in ROAD_SCORES.items())}),
tagged AS (SELECT u, bearing, CASE WHEN highway IS NULL OR len(highway) = 0 THEN 'unclassified' ELSE highway[1] END AS tag FROM edges),
outs AS (SELECT u AS node_id, max(coalesce(score, 1.0{D})) AS road_score FROM tagged LEFT JOIN scores USING (tag) GROUP BY u),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges) GROUP BY node_id),
attrs AS (SELECT node_id, coalesce(degree, 0) AS degree, coalesce(road_score, 0.0{D}) AS road_score FROM nodes LEFT JOIN deg USING (node_id) LEFT JOIN outs USING (node_id))"""


def box(lat1, lon1, lat2, lon2, km: float) -> str:
    return (f"y BETWEEN least({lat1},{lat2}) - {lit(km)}/111.0{D} AND greatest({lat1},{lat2}) + {lit(km)}/111.0{D} AND "
            f"x BETWEEN least({lon1},{lon2}) - {lit(km)}/(111.0{D}*cos(radians(({lat1}+{lat2})/2))) AND greatest({lon1},{lon2}) + {lit(km)}/(111.0{D}*cos(radians(({lat1}+{lat2})/2)))")  # fmt: skip


def ellipse(km: float) -> str:
    k = "cos(radians((s.y+t.y)/2))"
    f = lambda a, b: f"sqrt(({a}.y-{b}.y)*({a}.y-{b}.y)+(({a}.x-{b}.x)*{k})*(({a}.x-{b}.x)*{k}))"
    return f"{f('n', 's')} + {f('n', 't')} <= {f('s', 't')} + {lit(km)}/111.0{D}"


def ring_rows(lat, lon, per_band: int, per_pair: int, name: str, bands: str = "bands", me: str = "me") -> str:
    """CTEs ending in ``{name}`` (target_id, node_id, band, d)."""
    return f"""{banded(lat, lon, f'{name}_b', bands)},
{name}_t AS (SELECT DISTINCT node_id AS source FROM (SELECT node_id, row_number() OVER (PARTITION BY band ORDER BY {rank('node_id')}, node_id) AS k FROM {name}_b) WHERE k <= {per_band}),
{distances(f'SELECT source FROM {name}_t', True, f'{name}_r', me)},
{name} AS (SELECT target_id, node_id, band, d FROM (SELECT r.source AS target_id, r.n AS node_id, b.band, r.d, row_number() OVER (PARTITION BY r.source, b.band ORDER BY {rank('r.n')}, r.n) AS k
  FROM {name}_r r JOIN {name}_b b ON b.node_id = r.n WHERE r.n <> r.source) WHERE k <= {per_pair})"""


def framed(name: str, extra: str = "") -> str:
    return f"""SELECT q.node_id, q.target_id, {milli(hav('a.y', 'a.x', 'b.y', 'b.x'))} AS dist_mm, d / 10.0{D} AS tempo_reale_s{extra}
FROM {name} q JOIN nodes a ON a.node_id = q.node_id JOIN nodes b ON b.node_id = q.target_id"""


def pick(i: str, size: str, seed: int) -> str:
    return f"({i}*7919+{seed * 104729})%{size}"


def pair_rows(n: int) -> str:
    return f"""goal AS (SELECT name AS fascia, node_id, row_number() OVER (PARTITION BY name ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY name) AS size FROM banded),
numbered AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k, count(*) OVER () AS total FROM nodes),
want AS (SELECT fascia, i, {pick('i', 'size', 123)} AS kt, {pick('i', 'total', 124)} AS ks, total FROM (SELECT DISTINCT fascia, size FROM goal), (SELECT unnest(range(1, {n + 1})) AS i), (SELECT DISTINCT total FROM numbered)),
pairs AS (SELECT w.fascia || ' #' || i AS nome, CASE WHEN a.node_id <> g.node_id THEN a.node_id ELSE b.node_id END AS source, g.node_id AS target, w.fascia
  FROM want w JOIN goal g ON g.fascia = w.fascia AND g.k = kt JOIN numbered a ON a.k = ks JOIN numbered b ON b.k = (ks + 1) % w.total)"""


RESULTS = """res AS (SELECT ['Centro', 'Periferia', 'Provincia'][CAST(o_orderkey % 3 + 1 AS INT)] AS fascia, ['standard', 'anelli', 'regionale'][CAST(o_custkey % 3 + 1 AS INT)] AS modello,
  'coppia ' || (o_orderkey % 50) AS coppia, (o_orderkey * 37 % 2001 - 1000) / 10.0::DOUBLE AS riduzione_pct, o_orderkey * 13 % 997 AS n_negativi, o_orderkey % 7 <> 0 AS trovato FROM orders)"""
SUMMARY = lambda v: f"""count(*) AS n_totale, count(*) FILTER ({v} > 0) AS n_violazioni, round(count(*) FILTER ({v} > 0) * 100.0{D} / count(*), 6) AS pct_violazioni,
  round(avg({v} / 10.0{D}) FILTER ({v} > 0), 6) AS violazione_media_s, max({v} / 10.0{D}) FILTER ({v} > 0) AS violazione_massima_s, median({v} / 10.0{D}) FILTER ({v} > 0) AS violazione_mediana_s"""  # noqa: E731
DEG1 = MERGED + ", " + distances("SELECT 0 AS source")
EXPLORED = f"{MERGED}, {BANDS}, {banded()}, {pair_rows(10)}, {distances('SELECT DISTINCT source FROM pairs')}"
TRAFFIC_FACTOR = lambda c: f"""greatest(0.8{D}, coalesce(CASE WHEN {hav('(a.y+b.y)/2', '(a.x+b.x)/2', lit(LAT), lit(LON))}/1000 <= 3.0{D} THEN {lit(c)} + {lit(0.8 - c)} * ({hav('(a.y+b.y)/2', '(a.x+b.x)/2', lit(LAT), lit(LON))}/1000) / 3.0{D} END, 0.8{D}))"""


def busy(c: float, seed: int) -> str:
    noise = f"(0.95{D} + 0.1{D} * (((u*31+v*17+key*13+{seed * 7919})%10007)/10007.0{D}))"
    return f"SELECT u, v, key, travel_time * {TRAFFIC_FACTOR(c)} * {noise} AS t FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v"


SQL: dict[str, str] = {
    "nodes": with_(NODES, "SELECT node_id, y, x FROM nodes"),
    "edges": with_(EDGES, f"SELECT u, v, key, array_to_string(highway, '|') AS tags, {milli('bearing[1]')} AS bearing_milli, travel_time FROM edges"),
    "weight_variants": with_(EDGES, "SELECT u, v, key, travel_time_s, travel_time_d, travel_time_c, travel_time_m FROM edges"),
    "edges_missing_weight": with_(EDGES, "SELECT u, v, key, coalesce(w, 0) AS w_reduce, coalesce(w, 1) AS w_search FROM (SELECT *, CASE WHEN (u+v+key)%17 <> 0 THEN travel_time_d END AS w FROM edges)"),
    "haversine_to_target": with_(NODES, f"SELECT n.node_id, {milli(hav('n.y', 'n.x', 't.y', 't.x'))} AS dist_mm FROM nodes n, nodes t WHERE t.node_id = 7"),
    "bearing_to_target": with_(NODES, f"SELECT n.node_id, {milli(bear('n.y', 'n.x', 't.y', 't.x'))} AS bearing_milli FROM nodes n, nodes t WHERE t.node_id = 7 AND n.node_id <> 7"),
    "heading_deviation": with_(EDGES, f"""SELECT node_id, {milli("coalesce(min(least(abs(b - i), 360.0::DOUBLE - abs(b - i))), 0.0::DOUBLE)")} AS deviation_milli
FROM (SELECT n.node_id, {bear('n.y', 'n.x', 't.y', 't.x')} AS i, e.bearing[1] AS b FROM nodes n JOIN nodes t ON t.node_id = 7 AND n.node_id <> 7 LEFT JOIN edges e ON e.u = n.node_id) GROUP BY node_id"""),
    "heuristic_bounds": with_(NODES, f"""SELECT node_id, {milli('e')} AS euclid_milli, {milli(f"greatest(e, coalesce(CASE WHEN node_id % 3 <> 0 THEN e * 2 END, 0.0{D}) / 1.5{D})")} AS combined_milli
FROM (SELECT n.node_id, {hav('n.y', 'n.x', 't.y', 't.x')} / {lit(130 / 3.6)} * 10.0{D} AS e FROM nodes n, nodes t WHERE t.node_id = 7)"""),
    "radius_filter": with_(NODES, f"SELECT node_id FROM nodes WHERE {hav('y', 'x', lit(LAT), lit(LON))} / 1000 <= 15.0{D}"),
    "band_classify": with_(f"{NODES}, {BANDS}, {banded()}", f"SELECT node_id, band, {milli('dist_km')} AS dist_m FROM banded"),
    "nearest_reachable_node": with_(EDGES, f"""SELECT node_id FROM nodes LEFT JOIN (SELECT u AS node_id, count(*) AS n FROM edges GROUP BY u) USING (node_id)
ORDER BY CASE WHEN coalesce(n, 0) > 1 THEN 0 ELSE 1 END, (y-{lit(LAT)})*(y-{lit(LAT)})+(x-{lit(LON)})*(x-{lit(LON)}), node_id LIMIT 1"""),
    "bbox_cut": with_(EDGES + f", cut AS (SELECT n.* FROM nodes n, nodes s, nodes t WHERE s.node_id = 3 AND t.node_id = 7 AND {box('s.y', 's.x', 't.y', 't.x', 2.0).replace('y BETWEEN', 'n.y BETWEEN').replace('AND x BETWEEN', 'AND n.x BETWEEN')})",
                      "SELECT u, v, key FROM edges WHERE u IN (SELECT node_id FROM cut) AND v IN (SELECT node_id FROM cut)"),
    "ellipse_cut": with_(EDGES + f", cut AS (SELECT n.* FROM nodes n, nodes s, nodes t WHERE s.node_id = 3 AND t.node_id = 7 AND {ellipse(5.0)})", "SELECT u, v, key FROM edges WHERE u IN (SELECT node_id FROM cut) AND v IN (SELECT node_id FROM cut)"),
    "ellipse_cut_indexed": with_(NODES, f"SELECT n.node_id FROM nodes n, nodes s, nodes t WHERE s.node_id = 3 AND t.node_id = 7 AND {ellipse(5.0)}"),
    "ensure_target": with_(NODES, f"SELECT node_id FROM nodes WHERE node_id % 5 = 1 UNION SELECT n.node_id FROM nodes n, nodes t WHERE t.node_id = 7 AND {box('t.y', 't.x', 't.y', 't.x', 1.0).replace('y BETWEEN', 'n.y BETWEEN').replace('AND x BETWEEN', 'AND n.x BETWEEN')}"),
    "degree": with_(EDGES + ", " + ATTRS, "SELECT node_id, degree FROM deg"),
    "road_score": with_(EDGES + ", " + ATTRS, "SELECT node_id, degree, road_score FROM attrs"),
    "base_features": with_(NODES, f"SELECT n.node_id, t.node_id AS target_id, n.y AS node_lat, n.x AS node_lon, t.y AS target_lat, t.x AS target_lon, {milli(hav('n.y', 'n.x', 't.y', 't.x'))} AS dist_mm FROM nodes n, nodes t WHERE t.node_id IN (7, 11)"),
    "advanced_features": with_(EDGES + ", " + ATTRS, f"""SELECT n.node_id, t.node_id AS target_id, CAST(a.degree AS DOUBLE) AS node_degree, CAST(b.degree AS DOUBLE) AS target_degree, a.road_score AS node_road_score, b.road_score AS target_road_score,
  {milli(f"coalesce(min(least(abs(e.bearing[1] - i), 360.0{D} - abs(e.bearing[1] - i))), 0.0{D})")} AS deviation_milli
FROM (SELECT n.node_id, t.node_id AS tid, {bear('n.y', 'n.x', 't.y', 't.x')} AS i FROM nodes n, nodes t WHERE t.node_id IN (7, 11) AND n.node_id <> t.node_id) n
JOIN nodes t ON t.node_id = tid JOIN attrs a ON a.node_id = n.node_id JOIN attrs b ON b.node_id = tid LEFT JOIN edges e ON e.u = n.node_id GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY n.node_id, t.node_id, a.degree, b.degree, a.road_score, b.road_score")),
    "parallel_edge_min": with_(EDGES, "SELECT u, v, min(coalesce(travel_time_d, 0)) AS w FROM edges WHERE u <> v GROUP BY u, v"),
    "parallel_edge_first": with_(EDGES, "SELECT u, v, arg_min(coalesce(travel_time_d, 0), key) AS w FROM edges GROUP BY u, v"),
    "traffic_reweight": with_(EDGES, f"SELECT u, v, key, {milli('t')} AS t_ms, CAST(round_even(t*10, 0) AS BIGINT) AS travel_time_d FROM ({busy(1.5, 42)})"),
    "traffic_periods": with_(EDGES, " UNION ALL ".join(f"SELECT {p} AS periodo, u, v, key, CAST(round_even(t*10, 0) AS BIGINT) AS travel_time_d FROM ({busy(f, 42 + p)})" for p, f in {0: 2.0, 1: 1.1, 2: 1.8}.items())),
    "sssp": with_(DEG1, "SELECT n AS node_id, d FROM r"),
    "sssp_relaxation": with_(DEG1, "SELECT n AS node_id, d FROM r"),
    "farthest_nodes": with_(DEG1, "SELECT n AS node_id, d FROM r ORDER BY d DESC, n LIMIT 10"),
    "sssp_reverse_multi_target": with_(MERGED + ", " + distances("SELECT unnest([7, 11, 19]) AS source", True), "SELECT source AS target_id, n AS node_id, d FROM r"),
    "reachable": with_(MERGED + ", " + distances("SELECT unnest([0, 5]) AS source"), "SELECT source, n AS node_id FROM r"),
    "potentials_analytic": with_(f"{NODES}, {potentials()}", "SELECT target_id, node_id, y_hat_int FROM pot"),
    "reduced_edges": with_(f"{EDGES}, {potentials()}, {reduced()}", "SELECT target_id, u, v, key, w_red FROM red"),
    "reduced_summary": with_(f"{EDGES}, {potentials()}, {reduced()}", "SELECT target_id, count(*) AS n_edges, count(*) FILTER (w_red < 0) AS n_negative, coalesce(max(-w_red) FILTER (w_red < 0), 0) AS max_violation FROM red GROUP BY target_id"),
    "phi": with_(f"{EDGES}, {potentials()}, {reduced()}, {PHI}", "SELECT target_id, n AS node_id, d AS phi FROM p"),
    "phi_relaxation": with_(f"{EDGES}, {potentials('7')}, {reduced()}, {PHI}", "SELECT target_id, n AS node_id, d AS phi FROM p"),
    "repaired_edges": with_(f"{EDGES}, {potentials()}, {reduced()}, {PHI}, {SAN}", "SELECT target_id, u, v, key, w_san FROM san"),
    "sssp_on_repaired": with_(f"{MERGED}, " + distances("SELECT 0 AS source"), "SELECT n AS node_id, d AS d_original FROM r"),
    "predecessors": with_(f"{DEG1}, tight AS (SELECT e.u, e.v, 1 AS w FROM me e JOIN r a ON a.n = e.u JOIN r b ON b.n = e.v WHERE a.d + e.w = b.d), {distances('SELECT 0 AS source', False, 'h', 'tight')}",
                          "SELECT b.n AS node_id, b.d AS hops, min(t.u) AS pred FROM h b LEFT JOIN (SELECT tight.*, h.d AS hu FROM tight JOIN h ON h.n = tight.u) t ON t.v = b.n AND t.hu + 1 = b.d GROUP BY b.n, b.d"),
    "path": with_(f"""{DEG1}, tight AS (SELECT e.u, e.v, 1 AS w FROM me e JOIN r a ON a.n = e.u JOIN r b ON b.n = e.v WHERE a.d + e.w = b.d), {distances('SELECT 0 AS source', False, 'h', 'tight')},
pre AS (SELECT b.n AS node_id, b.d AS hops, min(t.u) AS pred FROM h b LEFT JOIN (SELECT tight.*, h.d AS hu FROM tight JOIN h ON h.n = tight.u) t ON t.v = b.n AND t.hu + 1 = b.d GROUP BY b.n, b.d),
walk AS (SELECT hops AS step, node_id, pred FROM pre WHERE node_id = 7 UNION ALL SELECT p.hops, p.node_id, p.pred FROM walk w JOIN pre p ON p.node_id = w.pred)""", "SELECT step, node_id FROM walk"),
    "sign_sanity": with_(f"{EDGES}, {potentials()}, {reduced()}", "SELECT target_id, count(*) FILTER (coalesce(travel_time_d, 0) + a.y_hat_int - b.y_hat_int < 0) AS n_invertito, count(*) FILTER (coalesce(travel_time_d, 0) - a.y_hat_int + b.y_hat_int < 0) AS n_diretto FROM edges JOIN pot a ON a.node_id = u JOIN pot b USING (target_id) WHERE b.node_id = v AND u <> v GROUP BY target_id"),
    "sample_targets_per_band": with_(f"{NODES}, {BANDS}, {banded()}", f"SELECT band, node_id FROM (SELECT band, node_id, row_number() OVER (PARTITION BY band ORDER BY {rank('node_id')}, node_id) AS k FROM banded) WHERE k <= 20"),
    "sample_sources_per_target_band": with_(f"{MERGED}, {BANDS}, {ring_rows(LAT, LON, 3, 50, 'q')}", "SELECT target_id, band, node_id FROM q"),
    "pairs_by_band": with_(f"{NODES}, {BANDS}, {banded()}, {pair_rows(100)}", "SELECT nome, source, target, fascia FROM pairs WHERE source <> target"),
    "dataset_ring": with_(f"{MERGED}, {BANDS}, {ring_rows(LAT, LON, 20, 150, 'q')}", framed("q")),
    "dataset_standard": with_(f"""{MERGED}, zone AS (SELECT node_id FROM nodes WHERE {hav('y', 'x', lit(LAT), lit(LON))} / 1000 <= 15.0{D}),
{distances(f"SELECT node_id AS source FROM (SELECT node_id, row_number() OVER (ORDER BY {rank('node_id')}, node_id) AS k FROM zone) WHERE k <= 60", True)},
q AS (SELECT * FROM (SELECT source AS target_id, n AS node_id, d, row_number() OVER (PARTITION BY source ORDER BY {rank('n')}, n) AS k FROM r WHERE n IN (SELECT node_id FROM zone)) WHERE k <= 400)""", framed("q")),
    "dataset_regional": with_(f"{MERGED}, {REGIONAL_BANDS}, " + ", ".join(ring_rows(la, lo, 5, 100, f"q{i}", "regional") for i, (la, lo) in enumerate(CENTRES.values())), " UNION ALL ".join(framed(f"q{i}", f", '{n}' AS centro") for i, n in enumerate(CENTRES))),
    "neighbours_long": with_(EDGES, f"SELECT n.node_id AS row_id, e.v AS vicino, e.travel_time_d / 10.0{D} AS peso, {milli(hav('a.y', 'a.x', 't.y', 't.x'))} AS dist_mm FROM nodes n JOIN edges e ON e.u = n.node_id JOIN nodes a ON a.node_id = e.v JOIN nodes t ON t.node_id = 7"),
    "neighbours_wide": with_(EDGES, f"""SELECT n.node_id AS row_id, string_agg(v || ':' || CAST(w AS BIGINT), ' ' ORDER BY k) AS vicini, count(v) AS n_vicini FROM nodes n LEFT JOIN
(SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY v) AS k FROM (SELECT u, v, arg_min(coalesce(travel_time_d, 0), key) AS w FROM edges GROUP BY u, v)) f ON f.u = n.node_id AND f.k <= 4 GROUP BY n.node_id"""),
    "loss_mean": with_(EDGES, f"""SELECT node_id AS row_id, {off_milli('p - y + 2 * 0.5::DOUBLE * coalesce(viol, 0.0::DOUBLE)')} AS grad_milli, {off_milli('1 + 2 * 0.5::DOUBLE * coalesce(ind, 0.0::DOUBLE)')} AS hess_milli
FROM (SELECT node_id, (node_id*37%1000)/10.0{D} AS p, (node_id*53%1000)/10.0{D} AS y FROM nodes) LEFT JOIN
(SELECT u, avg(greatest(0.0{D}, (u*37%1000)/10.0{D} - travel_time_d/10.0{D} - (v*37%1000)/10.0{D})) AS viol, avg(CASE WHEN (u*37%1000)/10.0{D} - travel_time_d/10.0{D} - (v*37%1000)/10.0{D} > 0 THEN 1.0{D} ELSE 0.0{D} END) AS ind FROM edges GROUP BY u) l ON l.u = node_id"""),
    "loss_bellman_min": with_(EDGES, f"""SELECT node_id AS row_id, {off_milli('p - y + 2 * 0.5::DOUBLE * v')} AS grad_milli, {off_milli('1 + 2 * 0.5::DOUBLE * CAST(v > 0 AS INT)')} AS hess_milli FROM (SELECT node_id, p, y, CASE WHEN m IS NULL THEN 0.0{D} ELSE greatest(0.0{D}, p - m) END AS v
FROM (SELECT node_id, (node_id*37%1000)/10.0{D} AS p, (node_id*53%1000)/10.0{D} AS y FROM nodes) LEFT JOIN
(SELECT u, min(w/10.0{D} + (v*37%1000)/10.0{D}) AS m FROM (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY v) AS k FROM (SELECT u, v, arg_min(coalesce(travel_time_d, 0), key) AS w FROM edges GROUP BY u, v)) WHERE k <= 4 GROUP BY u) f ON f.u = node_id)"""),
    "lambda_schedule": "SELECT t, CAST(round((0.5 + least(1.0, (t + 1) / 300.0::DOUBLE) * 1.5) * 1000000) AS BIGINT) AS lambda_ppm FROM (SELECT unnest(range(0, 310)) AS t)",
    "anchor_split": with_(NODES, f"SELECT node_id, k <= greatest(100, CAST(floor(n * 0.1) AS INT)) OR node_id = 7 AS anchor FROM (SELECT node_id, row_number() OVER (ORDER BY {rank('node_id')}, node_id) AS k, count(*) OVER () AS n FROM nodes)"),
    "nearest_anchor": with_(f"{NODES}, f AS (SELECT *, k <= greatest(100, CAST(floor(n * 0.1) AS INT)) OR node_id = 7 AS anchor FROM (SELECT *, row_number() OVER (ORDER BY {rank('node_id')}, node_id) AS k, count(*) OVER () AS n FROM nodes))",
                            "SELECT a.node_id, arg_min(b.node_id, ROW((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x), b.node_id)) AS anchor_id FROM f a, f b WHERE NOT a.anchor AND b.anchor GROUP BY a.node_id"),
    "mae_r2": "SELECT round(avg(abs(o_totalprice - p)), 4) AS mae, round(1 - sum((o_totalprice - p) * (o_totalprice - p)) / (sum(o_totalprice * o_totalprice) - sum(o_totalprice) * sum(o_totalprice) / count(*)), 6) AS r2 FROM (SELECT o_totalprice, o_totalprice * 0.9::DOUBLE + o_orderkey % 1000 AS p FROM orders)",
    "aggregate_by_band": with_(RESULTS, "SELECT fascia, round(avg(riduzione_pct), 6) AS media, median(riduzione_pct) AS mediana, round(stddev_samp(riduzione_pct), 6) AS std, round(avg(CASE WHEN riduzione_pct > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS pct_positive, count(*) AS n FROM res WHERE trovato GROUP BY fascia"),
    "aggregate_overall": with_(RESULTS, "SELECT round(avg(riduzione_pct), 6) AS media, round(avg(CASE WHEN riduzione_pct > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS pct_positive FROM res WHERE trovato"),
    "aggregate_by_model": with_(RESULTS, "SELECT fascia, modello, round(avg(riduzione_pct), 6) AS media, round(stddev_samp(riduzione_pct), 6) AS std, count(*) AS n_coppie FROM res WHERE trovato GROUP BY fascia, modello"),
    "pivot_model_pair": with_(RESULTS, "SELECT coppia, max(riduzione_pct) FILTER (modello = 'standard') AS standard, max(riduzione_pct) FILTER (modello = 'anelli') AS anelli, max(riduzione_pct) FILTER (modello = 'regionale') AS regionale FROM res GROUP BY coppia"),
    "boxplot_stats": with_(RESULTS, "SELECT fascia, modello, round(q1, 6) AS q1, round(q2, 6) AS mediana, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS basso, round(q3 + 1.5 * (q3 - q1), 6) AS alto FROM (SELECT fascia, modello, quantile_cont(CAST(greatest(n_negativi, 1) AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(greatest(n_negativi, 1) AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(greatest(n_negativi, 1) AS DOUBLE), 0.75) AS q3 FROM res WHERE trovato GROUP BY fascia, modello)"),
    "edge_text_roundtrip": with_(MERGED, "SELECT u, v, w FROM me"),
}
_V = {"as_reference": "(a.y_hat_int - b.y_hat_int - e.w)", "documented": "(b.y_hat_int - a.y_hat_int - e.w)"}
for _k, _v in _V.items():
    SQL[f"consistency_sample_{_k}"] = with_(f"{EDGES}, {potentials()}, e AS (SELECT u, v, coalesce(travel_time_d, 0) AS w FROM edges ORDER BY {rank('u*31+v*17+key')}, u, v, key LIMIT 5000)",
                                            f"SELECT a.target_id, {SUMMARY(_v)} FROM e JOIN pot a ON a.node_id = e.u JOIN pot b ON b.node_id = e.v AND b.target_id = a.target_id GROUP BY a.target_id")
SQL["consistency_path"] = SQL["path"].rpartition("SELECT step")[0] + f", {potentials('7')}, e AS (SELECT a.node_id AS u, b.node_id AS v, f.w FROM walk a JOIN walk b ON b.step = a.step + 1 JOIN (SELECT u, v, arg_min(coalesce(travel_time_d, 0), key) AS w FROM edges GROUP BY u, v) f ON f.u = a.node_id AND f.v = b.node_id) SELECT a.target_id, {SUMMARY(_V['as_reference'])} FROM e JOIN pot a ON a.node_id = e.u JOIN pot b ON b.node_id = e.v GROUP BY a.target_id"
SQL["consistency_visited"] = with_(f"{DEG1}, {potentials('7')}, seen AS (SELECT n FROM r WHERE d < (SELECT d FROM r WHERE n = 7) OR (d = (SELECT d FROM r WHERE n = 7) AND n <= 7)), e AS (SELECT u, v, coalesce(travel_time_d, 0) AS w FROM edges WHERE u <> v AND u IN (SELECT n FROM seen))",
                                   f"SELECT a.target_id, {SUMMARY(_V['as_reference'])}, (SELECT count(*) FROM seen) AS n_nodi_visitati FROM e JOIN pot a ON a.node_id = e.u JOIN pot b ON b.node_id = e.v GROUP BY a.target_id")
_E = "SELECT p.nome, g.d AS dist, count(*) AS n_explored FROM pairs p LEFT JOIN r g ON g.source = p.source AND g.n = p.target JOIN r x ON x.source = p.source WHERE p.source <> p.target"
SQL["dijkstra_explored_raw"] = SQL["dijkstra_explored_kernel"] = with_(EXPLORED, f"{_E} AND (g.d IS NULL OR x.d < g.d OR (x.d = g.d AND x.n <= p.target)) GROUP BY p.nome, g.d")
SQL["astar_exhaustive"] = SQL["astar_exhaustive_kernel"] = with_(EXPLORED, f"{_E} GROUP BY p.nome, g.d")
SQL["dijkstra_repaired_distance"] = with_(EXPLORED, "SELECT p.nome, g.d AS dist FROM pairs p LEFT JOIN r g ON g.source = p.source AND g.n = p.target WHERE p.source <> p.target")
SQL["precision_sweep"] = with_(f"{EDGES}, h AS (SELECT t.node_id AS target_id, n.node_id, CASE WHEN n.node_id = t.node_id THEN 0.0{D} ELSE -({hav('n.y', 'n.x', 't.y', 't.x')} / {lit(130 / 3.6)} * 10.0{D} / 10.0{D}) * 10.0{D} END AS y FROM nodes n, nodes t WHERE t.node_id IN (7, 11))",
    " UNION ALL ".join(f"SELECT '{w}' AS configurazione, target_id, count(*) AS n_edges, count(*) FILTER (w_red < 0) AS n_negative, coalesce(max(-w_red) FILTER (w_red < 0), 0) AS max_violation FROM (SELECT a.target_id, {w} + CAST(round_even(a.y / 10.0{D} * {lit(s)}, 0) AS BIGINT) - CAST(round_even(b.y / 10.0{D} * {lit(s)}, 0) AS BIGINT) AS w_red FROM edges JOIN h a ON a.node_id = u JOIN h b ON b.node_id = v AND b.target_id = a.target_id WHERE u <> v) GROUP BY target_id" for w, s in {"travel_time_s": 1, "travel_time_d": 10, "travel_time_c": 100, "travel_time_m": 1000}.items()))
SQL["dataset_unified"] = with_(f"{EDGES}, {BANDS}, " + ", ".join(f"me{p} AS (SELECT u, v, min(CAST(round_even(t*10, 0) AS BIGINT)) AS w FROM ({busy(f, 42 + p)}) WHERE u <> v GROUP BY u, v), {ring_rows(LAT, LON, 15, 50, f'q{p}', 'bands', f'me{p}')}" for p, f in {0: 2.0, 1: 1.1, 2: 1.8}.items()),
    " UNION ALL ".join(framed(f"q{p}", f", 'centro' AS centro_riferimento, {p}.0{D} AS periodo_giorno") for p in range(3)))
SQL["summary_by_model"] = with_(RESULTS, "SELECT modello, round(avg(riduzione_pct), 6) AS riduzione_pct_media, median(riduzione_pct) AS riduzione_pct_mediana, round(stddev_samp(riduzione_pct), 6) AS riduzione_pct_std FROM res WHERE trovato GROUP BY modello")
SQL["precision_summary"] = f"SELECT configurazione, avg(n_negative) AS n_negative_media, median(n_negative) AS n_negative_mediana FROM ({SQL['precision_sweep']}) GROUP BY configurazione"
SQL["grid_by_model"] = with_(RESULTS + ", part AS (SELECT * FROM res WHERE fascia <> 'Centro' OR modello <> 'anelli')", """SELECT f.fascia, m.modello, coalesce(round(avg(riduzione_pct) FILTER (trovato), 6), 0) AS media, coalesce(round(stddev_samp(riduzione_pct) FILTER (trovato), 6), 0) AS std, count(*) FILTER (trovato) AS n_coppie
FROM (SELECT DISTINCT fascia FROM part) f CROSS JOIN (SELECT DISTINCT modello FROM part) m LEFT JOIN part s ON s.fascia = f.fascia AND s.modello = m.modello GROUP BY f.fascia, m.modello""")
SQL["distances_reduced_and_original"] = with_(f"{DEG1}, {potentials('7')}", "SELECT b.target_id, r.source, r.n AS node_id, r.d + a.y_hat_int - b.y_hat_int AS d_reduced, r.d AS d_original FROM r JOIN pot a ON a.node_id = r.source JOIN pot b ON b.node_id = r.n")
SQL["astar_learned_exhaustive"] = SQL["astar_exhaustive"]
SQL["dataset_ring_advanced"] = with_(f"{MERGED}, {ATTRS}, {BANDS}, {ring_rows(LAT, LON, 20, 150, 'q')}", f"""SELECT f.*, CAST(m.degree AS DOUBLE) AS node_degree, CAST(t.degree AS DOUBLE) AS target_degree, m.road_score AS node_road_score, t.road_score AS target_road_score
FROM ({framed('q')}) f JOIN attrs m ON m.node_id = f.node_id JOIN attrs t ON t.node_id = f.target_id""")
SQL["cell_clustering"] = with_(NODES, f"SELECT node_id, CAST(floor(y / 0.05{D}) AS BIGINT) AS cell_y, CAST(floor(x / 0.05{D}) AS BIGINT) AS cell_x FROM nodes")
SQL["graphml_roundtrip"] = SQL["edges"]
SQL["osm_payload_nodes"] = with_(NODES, "SELECT node_id AS osm_id, y AS lat, x AS lon FROM nodes")
SQL["potential_tokens"] = with_(NODES, "SELECT k AS node_id, CAST(trunc(CAST((node_id*37%1000 - 500) || '.75' AS DOUBLE)) AS BIGINT) AS phi FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM nodes) WHERE node_id % 11 <> 0")
SQL["solver_seconds"] = with_(NODES, "SELECT node_id, CASE WHEN node_id % 5 <> 0 THEN CAST((node_id % 60) || '.' || (node_id % 10) AS DOUBLE) END AS seconds FROM nodes")
SQL["edge_file_lines"] = with_(MERGED, "SELECT u || ' ' || v || ' ' || w AS value FROM me UNION ALL SELECT CAST(count(*) + 1 AS VARCHAR) FROM nodes")
SQL["json_model_prediction"] = with_(NODES, f"""SELECT node_id, 2.5{D} + CASE WHEN a < 45.5 THEN 1.5{D} WHEN b IS NULL OR b < 11.75 THEN -2.0{D} ELSE 4.25{D} END + CASE WHEN b IS NULL OR b < 12.0 THEN 0.25{D} ELSE 8.0{D} END AS prediction
FROM (SELECT node_id, CASE WHEN node_id % 7 <> 0 THEN CAST(y AS FLOAT) END AS a, CASE WHEN node_id % 5 <> 0 THEN CAST(x AS FLOAT) END AS b FROM nodes)""")
SQL["pairs_by_trip_type"] = with_(f"""{NODES}, {BANDS}, {banded()},
pools AS (SELECT 'c' AS pool, node_id FROM banded WHERE band = 0 UNION ALL SELECT 'p', node_id FROM banded WHERE band = 1 UNION ALL SELECT 'm', node_id FROM (SELECT DISTINCT node_id FROM banded WHERE band IN (0, 1))
  UNION ALL SELECT 'l', node_id FROM banded WHERE band = 2 UNION ALL SELECT 't', node_id FROM nodes),
num AS (SELECT pool, node_id, row_number() OVER (PARTITION BY pool ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY pool) AS size FROM pools),
sizes AS (SELECT DISTINCT pool, size FROM num),
kinds(kind, fascia, s1, t1, s0, t0, again) AS (VALUES ('Urbana', 'Tratte Urbane', 'c', 'c', 'c', 'c', 'c'), ('Mista', 'Tratte Miste', 'p', 'm', 'm', 'p', 'm'), ('Lunga', 'Tratte Lunghe', 'l', 't', 't', 'l', 't')),
want AS (SELECT kind, fascia, i, again, CASE WHEN i % 2 = 1 THEN s1 ELSE s0 END AS sp, CASE WHEN i % 2 = 1 THEN t1 ELSE t0 END AS tp FROM kinds, (SELECT unnest(range(1, 101)) AS i)),
picked AS (SELECT w.*, {pick('i', 'x.size', 123)} AS ks, {pick('i', 'y.size', 124)} AS kt, {pick('i', 'z.size', 125)} AS ka, ({pick('i', 'z.size', 125)} + 1) % z.size AS kb
  FROM want w JOIN sizes x ON x.pool = sp JOIN sizes y ON y.pool = tp JOIN sizes z ON z.pool = again),
trips AS (SELECT kind || ' #' || i AS nome, s.node_id AS source, CASE WHEN a.node_id <> s.node_id THEN a.node_id WHEN b.node_id <> s.node_id THEN b.node_id ELSE c.node_id END AS target, fascia
  FROM picked JOIN num s ON s.pool = sp AND s.k = ks JOIN num a ON a.pool = tp AND a.k = kt JOIN num b ON b.pool = again AND b.k = ka JOIN num c ON c.pool = again AND c.k = kb WHERE EXISTS (SELECT 1 FROM pools WHERE pool = 'c'))""",
    "SELECT nome, source, target, fascia FROM trips WHERE source <> target")
