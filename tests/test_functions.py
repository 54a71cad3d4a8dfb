import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waygraph.functions import geo, tags, text

#: A line of the published description of the format that results have to match (fixed value).
ROUTE = r"~d_kC`y}}GxHk@ePlA]Zs@r@g@d@kA@iC@gC\qCCq@xAiDlIe@hAQn@On@}CzJe@dRFfGX`HkAZ|A`HwAnIp@DCnDeD|G`@h@oA|Fm@fCmANoAmEs@iBsAkDg@sAs@oBSD"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_angles(spark):
    got = one(spark, **{f"v{k}": geo.to_udeg(F.lit(v)) for k, v in enumerate((90.0, -90.0, 90.000001, -90.000001, 90.0000001, -2.5e-6, 2.5e-6))})
    assert list(got) == [90_000_000, -90_000_000, 90_000_001, -90_000_001, 90_000_000, -3, 3]
    assert one(spark, r=geo.to_radians(F.lit(90_000_000))).r == math.pi / 2


def test_haversine(spark):
    at = [F.lit(v) for v in (36_120_000, -86_670_000, 33_940_000, -118_400_000)]
    assert one(spark, d=F.round(geo.haversine(*at))).d == 2_886_444
    assert one(spark, d=geo.haversine(at[0], at[1], at[0], at[1])).d == 0


def test_mercator_and_back(spark):
    for lat, y in ((-36.12, -4317145.77), (0.0, 0.0), (36.12, 4317145.77)):
        for lon, x in ((86.67, 9648060.27), (0.0, 0.0), (-86.67, -9648060.27)):
            la, lo = geo.to_udeg(F.lit(lat)), geo.to_udeg(F.lit(lon))
            r = one(spark, x=geo.mercator_x(lo), y=geo.mercator_y(la), lat=geo.inverse_mercator_lat(geo.mercator_y(la)), lon=geo.inverse_mercator_lon(geo.mercator_x(lo)))
            assert abs(r.x - x) < 1e-2 and abs(r.y - y) < 1e-2
            assert abs(r.lat - lat * 1e6) <= 1 and abs(r.lon - lon * 1e6) <= 1


def test_edge_position_and_costs(spark):
    rest, done = geo.partial_costs(F.lit(100).cast("bigint"), F.lit(0.25).cast("float"))
    assert tuple(one(spark, a=rest, b=done)) == (75, 25)
    nothing = geo.edge_position(F.lit(0.0), F.lit(0.0))
    rest, done = geo.partial_costs(F.lit(100).cast("bigint"), nothing)
    assert tuple(one(spark, p=nothing, a=rest, b=done)) == (None, 0, 0)


def test_nearest_on_a_line(spark):
    l = lambda *v: [F.lit(float(x)) for x in v]  # noqa: E731, E741
    assert one(spark, t=geo.nearest_t(*l(3, 5, 0, 0, 10, 0))).t == 0.3
    assert one(spark, t=geo.nearest_t(*l(-3, 5, 0, 0, 10, 0))).t == 0
    assert one(spark, t=geo.nearest_t(*l(3, 5, 1, 1, 1, 1))).t == 0


def test_tags(spark):
    for level, values in tags.ROAD_LEVELS.items():
        for v in values:
            assert one(spark, x=tags.road_level(F.lit(v))).x == level
    assert one(spark, x=tags.road_level(F.lit("footway"))).x is None
    none = F.lit(None).cast("string")

    def way(value, highway="primary", junction=None, **kw):
        return tuple(one(spark, x=tags.oneway(none if value is None else F.lit(value), F.lit(highway), none if junction is None else F.lit(junction), **kw)).x)

    assert way("yes") == way("1") == way("true") == (True, False)
    assert way("no") == way("0") == way("false") == (True, False)
    assert way("no", no_is_two_way=True) == (True, True)
    assert way("-1") == (False, True)
    assert way(None) == (True, True) and way("odd") == (True, True)
    assert way(None, junction="roundabout") == way(None, highway="motorway") == (True, False)
    assert way(None, highway="motorway_link") == (True, True)
    assert one(spark, x=tags.is_barrier(F.lit("gate"))).x and not one(spark, x=tags.is_barrier(F.lit("kerb"))).x and one(spark, x=tags.is_barrier(none)).x is False


#: Messages that results have to match (fixed values); {p} is the pair, {v} the value.
FEW = "Expected at least 2 lon_lat pairs, got {n}. Use ';' to separate pairs"
MISSING = "Missing latitude component in pair {p}. Use ',' to separate longitude and latitude"
MANY = "Too many values to parse in pair {p}. Use ',' to separate longitude and latitude"
UNREADABLE = "Could not parse pair {p}: invalid float literal"
RANGE = "Value {v} in pair {p} is out of range, it should in [-{b}, {b}]. Make sure to use the order longitude,latitude"


def test_coordinates(spark):
    s = "-46.65,-23.5;0,12.000001;179.999999,-0.25"
    parsed = text.parse_coordinates(F.lit(s))
    r = one(spark, e=parsed["error"], s=text.format_coordinates(parsed["points"]))
    assert r.e is None and r.s == s
    for given_, error in {
        "7.25,43.7": FEW.format(n=1),
        "7.25,43.7;7.25": MISSING.format(p="7.25"),
        "1,2;3,4,5": MANY.format(p="3,4,5"),
        "1,2;x,4": UNREADABLE.format(p="x,4"),
        "180.5,1;2,2": RANGE.format(v="180.5", p="180.5,1", b=180),
        "1,2;2,-90.25": RANGE.format(v="-90.25", p="2,-90.25", b=90),
        "NaN,1;2,2": UNREADABLE.format(p="NaN,1"),
        " 1.5 ,1;2,2": UNREADABLE.format(p=" 1.5 ,1"),
        "200,x;2": RANGE.format(v="200", p="200,x", b=180),
    }.items():
        r = one(spark, p=text.parse_coordinates(F.lit(given_))).p
        assert r.error == error and r.points is None


def test_polyline(spark):
    points = text.decode_polyline(ROUTE)
    assert points[0] == (-2293856, -4701601)
    rows = F.array(*[F.struct(F.lit(a * 10).alias("lat_udeg"), F.lit(o * 10).alias("lon_udeg")) for a, o in points])
    assert one(spark, s=text.polyline(rows)).s == ROUTE
    known = F.array(*[F.struct(F.lit(a).alias("lat_udeg"), F.lit(o).alias("lon_udeg")) for a, o in ((38500000, -120200000), (40700000, -120950000), (43252000, -126453000))])
    assert one(spark, s=text.polyline(known)).s == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_polyline_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [(int(a), int(o)) for a, o in zip(rng.integers(-9_000_000, 9_000_000, 20), rng.integers(-18_000_000, 18_000_000, 20))]) for k in range(30)]
    df = spark.createDataFrame([(k, [(a * 10, o * 10) for a, o in p]) for k, p in rows], "k int, p array<struct<lat_udeg:int,lon_udeg:int>>")
    got = dict(df.select("k", text.polyline(F.col("p"))).collect())
    assert all(text.decode_polyline(got[k]) == p for k, p in rows)


def test_number_formats(spark):
    for n, s in ((0, "0B"), (999, "999B"), (1000, "1.0kiB"), (1_023_999, "1000.0kiB"), (1_024_000, "1.0MiB"), (5_000_000_000, "4.7GiB")):
        assert one(spark, s=text.format_bytes(F.lit(n).cast("bigint"))).s == s
    for n, s in ((0, "0"), (999, "999"), (1250, "1.2k"), (1_500_000, "1.5M")):
        assert one(spark, s=text.format_count(F.lit(n).cast("bigint"))).s == s


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=20))
def test_siphash_is_stable(values):
    a = np.array(values)
    assert (text.siphash13(a) == np.array([text.siphash13(np.array([v]))[0] for v in values])).all()
