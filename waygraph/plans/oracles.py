"""The registered queries as SQL that another engine runs on the same tables."""

from __future__ import annotations

from math import pi

from ..functions.geo import EARTH_RADIUS, MERCATOR_RADIUS
from ..functions.tags import CLOSED, ROAD_LEVELS
from ..functions.text import SIP_START
from . import derived as D

_LEVEL = "case " + " ".join(f"when highway in ({', '.join(repr(v) for v in vs)}) then {k}" for k, vs in ROAD_LEVELS.items()) + " end"
_CLOSED = ", ".join(repr(v) for v in CLOSED)
_IMPLIED = "coalesce(junction = 'roundabout', false) or coalesce(highway = 'motorway', false)"


def _hav(a1: str, o1: str, a2: str, o2: str) -> str:
    r = lambda c: f"radians({c} / 1e6)"
    return f"{2 * EARTH_RADIUS} * asin(sqrt(pow(sin(({r(a2)} - {r(a1)}) / 2), 2) + cos({r(a1)}) * cos({r(a2)}) * pow(sin(({r(o2)} - {r(o1)}) / 2), 2)))"


def _x(lon: str) -> str:
    return f"({MERCATOR_RADIUS} * radians({lon} / 1e6))"


def _y(lat: str) -> str:
    return f"({MERCATOR_RADIUS} * ln(tan({pi / 4!r} + radians({lat} / 1e6) / 2)))"


def _inverse(x: str, y: str) -> tuple[str, str]:
    lat = f"cast(round(degrees(2 * atan(exp({y} / {MERCATOR_RADIUS})) - {pi / 2!r}) * 1e6) as int)"
    return lat, f"cast(round(degrees({x} / {MERCATOR_RADIUS}) * 1e6) as int)"


def _network() -> str:
    """The steps from tables to edges, as common table expressions."""
    return f"""
ways as ({D.WAYS}),
refs as ({D.REFS}),
nodes as ({D.NODES}),
roads as (
  select way_id, {_LEVEL} as road_level,
    case when oneway = '-1' then false else true end as direct,
    case when oneway in ('yes', 'true', '1', 'no', 'false', '0') then false when oneway = '-1' then true else not ({_IMPLIED}) end as reverse
  from ways where {_LEVEL} is not null),
rr as (select r.* from refs r where way_id in (select way_id from roads)),
usage as (
  select node_id, n_uses, is_endpoint, is_endpoint or n_uses >= 2 as is_junction
  from (select node_id, count(*) as n_uses, bool_or(pos = 0 or pos = len - 1) as is_endpoint from rr group by node_id) u),
used as (
  select id, lat_udeg, lon_udeg, coalesce(barrier in ({_CLOSED}), false) as barrier
  from nodes where id in (select node_id from usage)),
placed as (
  select r.way_id, r.pos, r.node_id, n.lat_udeg, n.lon_udeg, n.barrier, u.is_junction
  from rr r join usage u on u.node_id = r.node_id join used n on n.id = r.node_id),
seq as (
  select *, sum(cast(is_junction as int)) over (partition by way_id order by pos rows between unbounded preceding and 1 preceding) as segment,
    lag(node_id) over w as prev_node, lag(lat_udeg) over w as prev_lat, lag(lon_udeg) over w as prev_lon, lag(barrier) over w as prev_barrier
  from placed window w as (partition by way_id order by pos)),
steps as (
  select way_id, pos, segment, prev_node, node_id, {_hav('prev_lat', 'prev_lon', 'lat_udeg', 'lon_udeg')} as metres, barrier or prev_barrier as blocked
  from seq where pos > 0),
segs as (
  select way_id, segment, arg_min(prev_node, pos) as src, arg_max(node_id, pos) as dst, cast(round(sum(metres)) as bigint) as distance, bool_or(blocked) as blocked
  from steps group by way_id, segment),
open as (select s.*, r.road_level, r.direct, r.reverse from segs s join roads r on r.way_id = s.way_id where not blocked),
arcs as (
  select src, dst, road_level, distance from open where direct
  union all select dst, src, road_level, distance from open where reverse),
edges as (select src, dst, max(road_level) as road_level, min(distance) as distance from arcs group by src, dst)"""


def _reach() -> str:
    return """
reach(node_id) as (
  select node_id from (select src as node_id from edges where road_level <= 2 union select dst from edges where road_level <= 2) s
  union
  select e.dst from reach r join edges e on e.src = r.node_id),
kept as (select * from edges where src in (select node_id from reach) and dst in (select node_id from reach))"""


def _lines(edges: str) -> str:
    return f"""
numbered as (select row_number() over (order by src, dst) - 1 as edge_id, * from {edges}),
lines as (
  select e.*, a.lat_udeg as lat1, a.lon_udeg as lon1, b.lat_udeg as lat2, b.lon_udeg as lon2,
    {_x('a.lon_udeg')} as x1, {_y('a.lat_udeg')} as y1, {_x('b.lon_udeg')} as x2, {_y('b.lat_udeg')} as y2
  from numbered e join nodes a on a.id = e.src join nodes b on b.id = e.dst)"""


_LINES = _lines("edges")

def _q(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"with {'recursive ' if recursive else ''}{', '.join([_network(), *ctes])}\n{last}"


# the least label goes along the edges, until no label changes
_WCC = """
pairs as (select src as a, dst as b from kept union select dst, src from kept),
wcc(node_id, component_id) using key (node_id) as (
  select distinct a, a from pairs
  union
  select p.b, min(w.component_id) from wcc w join pairs p on p.a = w.node_id join recurring.wcc k on k.node_id = p.b
  where w.component_id < k.component_id group by p.b)"""
# a node of many edges and all that it reaches and is reached by; the closure of what is left gives the other components
_SCC = """
every as (select src as node_id from kept union select dst from kept),
hub as (select node_id from every order by (select count(*) from kept where src = node_id) * (select count(*) from kept where dst = node_id) desc, node_id limit 1),
ahead(node_id) as (select node_id from hub union select k.dst from ahead a join kept k on k.src = a.node_id),
behind(node_id) as (select node_id from hub union select k.src from behind b join kept k on k.dst = b.node_id),
main as (select node_id from ahead intersect select node_id from behind),
rest as (select src, dst from kept where src not in (select node_id from main) and dst not in (select node_id from main)),
ways_on(a, b) as (select src, dst from rest union select w.a, r.dst from ways_on w join rest r on r.src = w.b),
mutual as (select x.a, min(x.b) as b from ways_on x join ways_on y on y.a = x.b and y.b = x.a group by x.a),
scc as (
  select n.node_id, case when n.node_id in (select node_id from main) then (select min(node_id) from main) else least(n.node_id, coalesce(m.b, n.node_id)) end as component_id
  from every n left join mutual m on m.a = n.node_id),
dead as (
  select k.dst as src, k.src as dst, k.road_level, k.distance from kept k join scc a on a.node_id = k.src join scc b on b.node_id = k.dst where a.component_id <> b.component_id)"""
_LINKS = f"""
sizes as (select component_id, count(*) as n from wcc group by component_id),
base as (select component_id as base from sizes order by n desc, component_id limit 1),
spots as (select w.node_id, w.component_id, n.lat_udeg, n.lon_udeg, {_x('n.lon_udeg')} as x, {_y('n.lat_udeg')} as y from wcc w join nodes n on n.id = w.node_id),
near as (
  select o.component_id, o.node_id, arg_min(t.node_id, struct_pack(d := (o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y), i := t.node_id)) as base_node
  from spots o join spots t on t.component_id = (select base from base) where o.component_id <> (select base from base) group by 1, 2),
measured as (
  select r.component_id, r.node_id, r.base_node, cast(trunc({_hav('a.lat_udeg', 'a.lon_udeg', 'b.lat_udeg', 'b.lon_udeg')}) as bigint) as distance
  from near r join nodes a on a.id = r.node_id join nodes b on b.id = r.base_node),
best as (select * from measured qualify row_number() over (partition by component_id order by distance, node_id, base_node) = 1),
links as (
  select node_id as src, base_node as dst, 5 as road_level, distance from best union all select base_node, node_id, 5, distance from best)"""

_MIX = "(((((({e}) % 2147483648) * 2654435761) % 4294967296) // 256 * 40503) % 4294967296) // 256"


def _zeros(element: str) -> str:
    h = _MIX.format(e=element)
    return f"case when {h} = 0 then 24 else bit_count(({h} & -({h})) - 1) end"


_BOX = "least(x1, x2) <= -5130000.0 and greatest(x1, x2) >= -5187000.0 and least(y1, y2) <= -2650000.0 and greatest(y1, y2) >= -2690000.0"
_BOXED = f"boxed as (select *, {_zeros('edge_id')} as zeros from lines where {_BOX})"
_SAMPLE = """
levels as (select road_level, 500 - coalesce(sum(count(*)) over (order by road_level rows between unbounded preceding and 1 preceding), 0) as budget from boxed group by road_level),
counts as (select b.road_level, zeros, budget, count(*) as n from boxed b join levels l on l.road_level = b.road_level where budget > 0 group by all),
running as (select *, sum(n) over (partition by road_level order by zeros desc) as upto from counts),
cuts as (select road_level, coalesce(max(case when upto > budget then zeros end), -1) + 1 as k from running group by road_level),
sampled as (select b.* from boxed b join cuts c on c.road_level = b.road_level where zeros >= k)"""


def _sip() -> str:
    """``boxed`` with zeros of the SipHash-1-3 of the edge's number, a step of arithmetic modulo 2**64 at a time."""
    ctes, k = [], 0

    def step(old: str, **new: str) -> str:
        nonlocal k
        k += 1
        kept = [v for v in ("v0", "v1", "v2", "v3") if v not in new]
        ctes.append(f"sip{k} as (select edge_id, {', '.join([*kept, *(f'{e} as {v}' for v, e in new.items())])} from {old})")
        return f"sip{k}"

    big = 1 << 64
    add = lambda a, b: f"cast((cast({a} as uhugeint) + cast({b} as uhugeint)) % {big} as ubigint)"
    rot = lambda x, b: f"cast((cast({x} as uhugeint) * {1 << b}) % {big} + {x} // {1 << (64 - b)} as ubigint)"
    at = "(select edge_id, " + ", ".join(f"cast('{w}' as ubigint) as v{i}" for i, w in enumerate(SIP_START)) + f" from lines where {_BOX}) l"
    for block in ("cast(edge_id as ubigint)", f"cast('{8 << 56}' as ubigint)"):
        at = step(at, v3=f"xor(v3, {block})")
        at = _sip_round(step, add, rot, at)
        at = step(at, v0=f"xor(v0, {block})")
    at = step(at, v2="xor(v2, cast(255 as ubigint))")
    for _ in range(3):
        at = _sip_round(step, add, rot, at)
    ctes.append(f"hashed as (select edge_id, xor(xor(v0, v1), xor(v2, v3)) as h from {at})")
    ctes.append("boxed as (select l.*, case when h = 0 then 64 else bit_count(xor(h, h - 1)) - 1 end as zeros from lines l join hashed x on x.edge_id = l.edge_id)")
    return ",\n".join(ctes)


def _sip_round(step, add, rot, at: str) -> str:
    at = step(at, v0=add("v0", "v1"), v2=add("v2", "v3"))
    at = step(at, v1=f"xor({rot('v1', 13)}, v0)", v3=f"xor({rot('v3', 16)}, v2)")
    at = step(at, v0=rot("v0", 32))
    at = step(at, v0=add("v0", "v3"), v2=add("v2", "v1"))
    at = step(at, v3=f"xor({rot('v3', 21)}, v0)", v1=f"xor({rot('v1', 17)}, v2)")
    return step(at, v2=rot("v2", 32))


_T = "case when len2 = 0 then 0 else least(greatest(((px - lx1) * (lx2 - lx1) + (py - ly1) * (ly2 - ly1)) / len2, 0), 1) end"
_POINTS = f"points as (select request_id as point_id, cast(lat_a as int) as lat, cast(lon_a as int) as lon, {_x('lon_a')} as px, {_y('lat_a')} as py from ({D.REQUESTS}) r)"
_NEAREST = f"""
turned as (
  select *, (lx2 - lx1) * (lx2 - lx1) + (ly2 - ly1) * (ly2 - ly1) as len2 from (
    select edge_id, x1, y1, x2, y2, case when src > dst then x2 else x1 end as lx1, case when src > dst then y2 else y1 end as ly1,
      case when src > dst then x1 else x2 end as lx2, case when src > dst then y1 else y2 end as ly2 from lines) t),
tried as (
  select point_id, px, py, edge_id, x1, y1, x2, y2,
    px - case when t >= 1 then lx2 else lx1 + t * (lx2 - lx1) end as dx, py - case when t >= 1 then ly2 else ly1 + t * (ly2 - ly1) end as dy
  from (select *, {_T} as t from points, turned) c),
nearest as (
  select point_id, arg_min(edge_id, struct_pack(d := dx * dx + dy * dy, i := edge_id)) as edge_id from tried group by point_id)"""
_PLAT, _PLON = _inverse("nx", "ny")
_PROJECTED = f"""
spot as (
  select n.point_id, n.edge_id, x1, y1, x2, y2, case when t >= 1 then x2 else x1 + t * (x2 - x1) end as nx, case when t >= 1 then y2 else y1 + t * (y2 - y1) end as ny
  from (
    select n.point_id, n.edge_id, l.x1, l.y1, l.x2, l.y2, case when (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) = 0 then 0
      else least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) end as t
    from nearest n join points p on p.point_id = n.point_id join lines l on l.edge_id = n.edge_id) n),
far as (select *, sqrt((nx - x1) * (nx - x1) + (ny - y1) * (ny - y1)) as d1, sqrt((nx - x2) * (nx - x2) + (ny - y2) * (ny - y2)) as d2 from spot)"""

_GOALS = "goals as (select node_id as goal from (select src as node_id from kept union select dst from kept) g)"
_ORIGINS = "origins as (select goal as start from goals where goal % 50 = 0)"
_DIST = """
dist(origin, node, d) using key (origin, node) as (
  select start, start, cast(0 as bigint) from origins
  union
  select s.origin, e.dst, min(s.d + e.distance)
  from dist s join kept e on e.src = s.node left join recurring.dist k on k.origin = s.origin and k.node = e.dst
  where k.d is null or s.d + e.distance < k.d
  group by s.origin, e.dst)"""

_REQ = f"req as ({D.REQUESTS})"


def _decimal(c: str) -> str:
    return (
        f"case when {c} < 0 then '-' else '' end || cast(abs({c}) // 1000000 as varchar) || "
        f"case when abs({c}) % 1000000 = 0 then '' else '.' || rtrim(lpad(cast(abs({c}) % 1000000 as varchar), 6, '0'), '0') end"
    )


def _letters(v: str) -> str:
    """The polyline letters of one signed value."""
    z = f"(case when {v} < 0 then -({v}) * 2 - 1 else ({v}) * 2 end)"
    parts = [f"case when {k} = 0 or {z} >= {1 << (5 * k)} then chr(cast(63 + ({z} // {1 << (5 * k)}) % 32 + case when {z} >= {1 << (5 * (k + 1))} then 32 else 0 end as int)) else '' end" for k in range(6)]
    return "(" + " || ".join(parts) + ")"


# requests over the repaired network: both points of each, their edges, a path from the end of the first edge to the start of the second
_ROUTE = f"""
asked as (
  select request_id, seq, lat, lon, 2 * request_id + seq as point_id, {_x('lon')} as px, {_y('lat')} as py from (
    select request_id, 0 as seq, cast(lat_a as int) as lat, cast(lon_a as int) as lon from req where request_id % 50 = 0
    union all select request_id, 1, cast(lat_b as int), cast(lon_b as int) from req where request_id % 50 = 0) p),
points as (select point_id, px, py from asked),"""
_LEGS = f"""
stops as (
  select a.request_id, a.seq, a.lat, a.lon, f.edge_id, l.src, l.dst, l.distance, {_PLAT} as plat, {_PLON} as plon,
    coalesce(cast(case when f.d1 + f.d2 > 0 then f.d1 / (f.d1 + f.d2) end as float), cast(-1 as float)) as pos
  from asked a join far f on f.point_id = a.point_id join lines l on l.edge_id = f.edge_id),
legs as (
  select a.request_id, a.dst as start, b.src as goal, a.plat as alat, a.plon as alon, b.plat as blat, b.plon as blon,
    case when a.pos < 0 then 0 else cast(trunc(cast(a.distance as float) * (cast(1 as float) - a.pos)) as bigint) end as head,
    case when b.pos < 0 then 0 else cast(trunc(cast(b.distance as float) * b.pos) as bigint) end as tail,
    {_hav('a.plat', 'a.plon', 'a.lat', 'a.lon')} as afar, {_hav('b.plat', 'b.plon', 'b.lat', 'b.lon')} as bfar
  from stops a join stops b on b.request_id = a.request_id and a.seq = 0 and b.seq = 1),
origins as (select distinct start from legs)"""
_WALK = """
before as materialized (
  select w.origin, w.node, min(v.node) as prev from dist w join fixed e on e.dst = w.node join dist v on v.origin = w.origin and v.node = e.src
  where v.d + e.distance = w.d and w.node <> w.origin group by 1, 2),
walk(request_id, start, node, k) as (
  select request_id, start, goal, 0 from legs where exists (select * from dist where origin = start and node = goal)
  union all select w.request_id, w.start, b.prev, w.k + 1 from walk w join before b on b.origin = w.start and b.node = w.node),
drawn as (
  select w.request_id, -k as k, lat_udeg as lat, lon_udeg as lon from walk w join nodes n on n.id = w.node
  union all select request_id, -1000000, alat, alon from legs union all select request_id, 1, blat, blon from legs),
five as (select request_id, k, cast(round(lat / 10.0) as bigint) as lat, cast(round(lon / 10.0) as bigint) as lon from drawn),
deltas as (select request_id, k, lat - coalesce(lag(lat) over w, 0) as a, lon - coalesce(lag(lon) over w, 0) as o from five window w as (partition by request_id order by k)),"""
_FIVE = ", ".join(f"cast(round({c} / 10.0) as bigint) as {c}" for c in ("lat_a", "lon_a", "lat_b", "lon_b"))


def _scaled(limits: list[tuple[str, float, str]], n: str) -> str:
    return " ".join(f"when {cond.format(n=n)} then printf('%.1f', cast(cast({n} as float) / cast({d} as float) as double)) || '{unit}'" for cond, d, unit in limits)


_BROKEN = """case s_suppkey % 7
  when 0 then '13.5,52.5' when 1 then '13.5;13.4,52.5' when 2 then '13.5,52.5,17;13.4,52.5' when 3 then '13.5,banana;13.4,52.5'
  when 4 then '1300.5,52.5;13.4,52.5' when 5 then '13.5,5200.25;13.4,52.5' else '13.5,52.5;13.4,52.5' end"""
_ERRORS = """case s_suppkey % 7
  when 0 then 'Expected at least 2 lon_lat pairs, got 1. Use '';'' to separate pairs'
  when 1 then 'Missing latitude component in pair 13.5. Use '','' to separate longitude and latitude'
  when 2 then 'Too many values to parse in pair 13.5,52.5,17. Use '','' to separate longitude and latitude'
  when 3 then 'Could not parse pair 13.5,banana: invalid float literal'
  when 4 then 'Value 1300.5 in pair 1300.5,52.5 is out of range, it should in [-180, 180]. Make sure to use the order longitude,latitude'
  when 5 then 'Value 5200.25 in pair 13.5,5200.25 is out of range, it should in [-90, 90]. Make sure to use the order longitude,latitude' end"""
_LAT, _LON = _inverse(_x("lon_udeg"), _y("lat_udeg"))

ORACLES = {
    "level_totals": _q("select road_level, count(*) as n_edges, cast(sum(distance) as bigint) as metres from edges group by road_level"),
    "road_level": _q(f"select highway, {_LEVEL} as road_level, count(*) as n from ways group by all"),
    "barrier_nodes": _q("select id, lat_udeg, lon_udeg from used where barrier"),
    "oneway_dirs": _q("select * from roads"),
    "node_usage": _q("select * from usage"),
    "junction_stats": _q("select count(*) filter (not is_junction) as n_internal, count(*) filter (is_junction) as n_junction from usage"),
    "step_haversine": _q("select way_id, pos, cast(segment as bigint) as segment, prev_node, node_id, cast(round(metres) as bigint) as metres from steps"),
    "segments": _q("select way_id, cast(segment as bigint) as segment, src, dst, distance, blocked from segs"),
    "blocked_segments": _q("select way_id, cast(segment as bigint) as segment, src, dst from segs where blocked"),
    "arcs": _q("select * from arcs"),
    "edges_dedup": _q("select * from edges"),
    "vertices": _q("select * from used"),
    "incomplete_ways": _q("select way_id, count(*) as n_missing from rr where node_id not in (select id from nodes where id % 11 <> 0) group by way_id"),
    "reachable_nodes": _q(_reach(), "select node_id from reach", recursive=True),
    "weak_components": _q(_reach(), _WCC, "select * from wcc", recursive=True),
    "scc": _q(_reach(), _SCC, "select * from scc", recursive=True),
    "dead_end_edges": _q(_reach(), _SCC, "select * from dead", recursive=True),
    "component_links": _q(_reach(), _WCC, _LINKS, "select * from links", recursive=True),
    "repaired_edges": _q(_reach(), _SCC, _WCC, _LINKS, "select * from kept union all select * from dead union all select * from links", recursive=True),
    "mercator": _q(f"select id, round({_x('lon_udeg')}, 2) as x, round({_y('lat_udeg')}, 2) as y from nodes"),
    "inverse_mercator": _q(f"select id, {_LAT} as lat_udeg, {_LON} as lon_udeg from nodes"),
    "bbox_edges": _q(
        _LINES, f"boxes as ({D.BOXES})",
        "select box_id, count(*) as n_edges, cast(sum(distance) as bigint) as metres from lines join boxes on least(x1, x2) <= greatest(bx1, bx2)"
        " and greatest(x1, x2) >= least(bx1, bx2) and least(y1, y2) <= greatest(by1, by2) and greatest(y1, y2) >= least(by1, by2) group by box_id",
    ),
    "edge_info": _q(_LINES, "select edge_id, src, dst, road_level, distance, lat1, lon1, lat2, lon2 from lines"),
    "nearest_edge": _q(_LINES, _POINTS, _NEAREST, "select * from nearest"),
    "projected_points": _q(
        _LINES, _POINTS, _NEAREST, _PROJECTED,
        f"select point_id, edge_id, {_PLAT} as proj_lat_udeg, {_PLON} as proj_lon_udeg, round(cast(cast(case when d1 + d2 > 0 then d1 / (d1 + d2) end as float) as double), 3) as edge_pos from far",
    ),
    "sample_edges": _q(_LINES, _BOXED, _SAMPLE, "select edge_id, road_level from sampled"),
    "sample_edges_sip": _q(_LINES, _sip(), _SAMPLE, "select road_level, row_number() over (partition by road_level order by edge_id) - 1 as place, edge_id from sampled"),
    "sample_priority_counts": _q(
        "select * from (select -road_level as priority, count(*) as n, cast(20000 - coalesce(sum(count(*)) over (order by road_level rows between unbounded preceding and 1 preceding), 0) as bigint) as budget"
        " from edges group by road_level) b where budget > 0"
    ),
    "sample_nodes": _q(
        f"z as (select node_id, {_zeros('node_id')} as zeros from usage)",
        "c as (select zeros, sum(count(*)) over (order by zeros desc) as upto from z group by zeros)",
        "select node_id from z where zeros > coalesce((select max(zeros) from c where upto > 300), -1)",
    ),
    "drawn_lines": _q(
        _LINES, _BOXED, _SAMPLE, "o as (select *, 3 * (row_number() over (partition by road_level order by edge_id) - 1) as k from sampled)",
        "select road_level, k as place, round(x1, 2) as x, round(y1, 2) as y from o union all select road_level, k + 1, round(x2, 2), round(y2, 2) from o"
        " union all select road_level, k + 2, null, null from o",
    ),
    "dense_offset": _q("select node_id, row_number() over (order by node_id) - 1 as place from usage"),
    "index_remap": _q(
        "v as (select id, row_number() over (order by lat_udeg, lon_udeg, id) - 1 as new_id from used)",
        "select src, dst, a.new_id as source, b.new_id as target, distance, road_level from edges join v a on a.id = src join v b on b.id = dst",
    ),
    "delta_encode": _q("select id, cast(lat_udeg as bigint) - coalesce(lag(lat_udeg) over (order by id), 0) as delta from used"),
    "delta_decode": _q("select id, cast(lat_udeg as bigint) as value from used"),
    "shortest_distance": _q(_reach(), _GOALS, _ORIGINS, _DIST, "select origin as start, node as goal, d as distance from dist", recursive=True),
    "distance_matrix": _q(
        _reach(), _GOALS, _ORIGINS, _DIST,
        "select o.start, g.goal, coalesce(d.d, 0) as distance from origins o cross join goals g left join dist d on d.origin = o.start and d.node = g.goal",
        recursive=True,
    ),
    "shortest_path_points": _q(_reach(), _GOALS, _ORIGINS, _DIST, "select origin as start, node as goal, d as distance, d as walked from dist", recursive=True),
    "route_json": _q(
        _reach(), _SCC, _WCC, _LINKS, "fixed as (select * from kept union all select * from dead union all select * from links)", _lines("fixed"), _REQ,
        _ROUTE + _NEAREST, _PROJECTED, _LEGS, _DIST.replace("join kept e", "join fixed e"),
        _WALK + f"""
geometry as (select request_id, string_agg({_letters('a')} || {_letters('o')}, '' order by k) as geometry from deltas group by request_id)""",
        """select l.request_id, d.d + l.head + l.tail as distance, case when d.d is not null then g.geometry end as geometry,
  case when d.d is null then 'no route' end as error, w.seq, case when d.d is not null then w.lat end as lat_udeg, case when d.d is not null then w.lon end as lon_udeg,
  case when d.d is not null then round(w.far, 2) end as metres
from legs l left join dist d on d.origin = l.start and d.node = l.goal join geometry g on g.request_id = l.request_id
join (select request_id, cast(0 as bigint) as seq, alat as lat, alon as lon, afar as far from legs union all select request_id, 1, blat, blon, bfar from legs) w on w.request_id = l.request_id""",
        recursive=True,
    ),
    "coords_format": f"with {_REQ} select request_id, {_decimal('lon_a')} || ',' || {_decimal('lat_a')} || ';' || {_decimal('lon_b')} || ',' || {_decimal('lat_b')} as coordinates from req",
    "coords_parse": f"with {_REQ} select request_id, cast(0 as bigint) as seq, cast(lat_a as int) as lat_udeg, cast(lon_a as int) as lon_udeg from req"
    " union all select request_id, 1, cast(lat_b as int), cast(lon_b as int) from req",
    "coords_errors": f"select s_suppkey, {_BROKEN} as coordinates, {_ERRORS} as error from supplier",
    "polyline": f"with {_REQ}, five as (select request_id, {_FIVE} from req) select request_id, {_letters('lat_a')} || {_letters('lon_a')} || {_letters('(lat_b - lat_a)')} || {_letters('(lon_b - lon_a)')} as polyline from five",
    "fmt_bytes": "select o_orderkey, case when n < 1000 then cast(n as varchar) || 'B' "
    + _scaled([("{n} < 1024000", 1024, "kiB"), ("{n} < 1048576000", 1024**2, "MiB"), ("true", 1024**3, "GiB")], "n")
    + " end as size from (select o_orderkey, o_orderkey * o_custkey * o_orderkey % 5000000000 as n from orders) o",
    "fmt_num": "select o_orderkey, case when n < 1000 then cast(n as varchar) " + _scaled([("{n} < 1000000", 1e3, "k"), ("true", 1e6, "M")], "n")
    + " end as count from (select o_orderkey, o_orderkey * o_custkey % 5000000 as n from orders) o",
}
