"""One query an operator over the given tables, with DuckDB SQL that computes the same by itself where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maploom.functions import colour, frames, hashing, scales, shapes, text
from maploom.functions.frames import Frame, Sheet
from maploom.operators import contours, drawing, features, fills, flow, focal, kernels, lettering, paths, regions, sampling, symbols
from maploom.plans import findings, fixtures, oracles
from maploom.plans.compile import Inputs, compile_drawing, feature_paths
from maploom.plans.fixtures import CRS, NORTH, WEST, with_views
from maploom.plans.storage import stored
from maploom.sources import sinks, vector
from maploom.streaming.arrivals import by_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- frames and scales

_FRAME = Frame(100, 100, 1.0, WEST, NORTH, CRS)


@query(with_views("holed") + """ select r, c, 654000.0::double + (c + 0.5) x, 7738000.0::double - (r + 0.5) y, (c + 0.5)::double gx, (r + 0.5)::double gy from holed""")
def frame_cells(spark, sf_dir):
    x, y = _FRAME.easting(F.col("c")), _FRAME.northing(F.col("r"))
    gx, gy = _FRAME.to_grid(F.col("x"), F.col("y"))
    return fixtures.holed(spark, sf_dir).select("r", "c", x.alias("x"), y.alias("y")).select("r", "c", "x", "y", gx.alias("gx"), gy.alias("gy"))


@query(with_views("tracks") + """ select path_id, i, round(10 + (x - 0) * 5.0::double, 6) sx, round(10 + (y - (-50.0::double)) * 5.0::double, 6) sy, round(x, 3) x, round(y, 3) y, round(y * 5.0::double, 6) len from tracks""")
def sheet_transform(spark, sf_dir):
    s = Sheet(Frame(150, 800, 1.0, 0.0, 100.0), 200, 10.0)
    rows = fixtures.tracks(spark, sf_dir).select("path_id", "i", s.x(F.col("x")).alias("sx"), s.y(F.col("y")).alias("sy"), s.length(F.col("y")).alias("len"))
    return rows.select("path_id", "i", r6("sx", "sx"), r6("sy", "sy"), F.round(s.inv_x(F.col("sx")), 3).alias("x"), F.round(s.inv_y(F.col("sy")), 3).alias("y"), r6("len", "len"))


_UTM_SQL = """ , e as (select 6378137.0::double a, 1 / 298.257222101::double f, 0.9996::double k0),
 e2 as (select a, k0, f * (2 - f) e2, f * (2 - f) / (1 - f * (2 - f)) ep2 from e),
 p as (select n, lat, lon, 33 z, radians(lat) p, radians((lon - (33 * 6 - 183) + 540) % 360 - 180) dl, a, k0, e2, ep2 from photos, e2 where lat is not null),
 q as (select *, a / sqrt(1 - e2 * sin(p) * sin(p)) nn, tan(p) * tan(p) t, ep2 * cos(p) * cos(p) c, cos(p) * dl aa,
   a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * p) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * p) - 35 * e2 * e2 * e2 / 3072 * sin(6 * p)) m from p),
 u as (select n, lat, lon, k0 * nn * (aa + (1 - t + c) * pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(aa, 5) / 120) + 500000 x,
   k0 * (m + nn * tan(p) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(aa, 6) / 720)) y from q) """


@query(with_views("photos") + _UTM_SQL + "select n, round(x, 3) x, round(y, 3) y from u")
def utm_forward(spark, sf_dir):
    x, y = frames.to_utm(F.col("lat"), F.col("lon"), 33)
    return fixtures.photos(spark, sf_dir).where("lat is not null").select("n", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(with_views("photos") + " select n, round(lat, 6) lat, round(lon, 6) lon from photos where lat is not null and lon between 12 and 18")
def utm_inverse(spark, sf_dir):
    """There and back: within the zone's reach the inverse series gives the degrees again."""
    rows = fixtures.photos(spark, sf_dir).where("lat is not null and lon between 12 and 18")
    x, y = frames.to_utm(F.col("lat"), F.col("lon"), 33)
    rows = rows.select("n", x.alias("x"), y.alias("y"))
    lat, lon = frames.from_utm(F.col("x"), F.col("y"), 33)
    return rows.select("n", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(with_views("photos") + """ select n, (floor(((lon + 180) % 360) / 6) + 1)::int zone, case when code between 25828 and 25838 then code - 25800 when code between 32601 and 32660 then code - 32600 when code between 32701 and 32760 then code - 32700 end::int epsg_zone,
   case when code between 32701 and 32760 then true when code between 25828 and 25838 or code between 32601 and 32660 then false end south
 from (select n, lon, (25820 + n % 30 + (n % 3) * 6800)::int code from photos)""")
def utm_zones(spark, sf_dir):
    code = F.concat(F.lit(" epsg:"), (25820 + F.col("n") % 30 + (F.col("n") % 3) * 6800).cast("string"), F.lit(" "))
    zone, south = frames.zone_of_epsg(F.col("crs"))
    return fixtures.photos(spark, sf_dir).withColumn("crs", code).select("n", frames.utm_zone(F.col("lon")).alias("zone"), zone.cast("int").alias("epsg_zone"), south.alias("south"))


_INTERVAL = "case when relief > 0 then (case when raw / mag <= 1.5 then 1.0 when raw / mag <= 3.5 then 2.0 when raw / mag <= 7.5 then 5.0 else 10.0 end) * mag else 1.0 end"
_RELIEF = """, a as (select path_id, min(y) lo, max(y) hi, max(y) - min(y) relief from tracks group by path_id), b as (select *, relief / 12 raw from a), d as (select *, pow(10.0::double, floor(log10(raw))) mag from b where relief > 0) """


@query(with_views("tracks") + _RELIEF + f"select path_id, round({_INTERVAL}, 9) step from d")
def nice_interval(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).groupBy("path_id").agg((F.max("y") - F.min("y")).alias("relief")).where("relief > 0")
    return rows.select("path_id", F.round(scales.nice_interval(F.col("relief")), 9).alias("step"))


@query(with_views("tracks") + _RELIEF + """, l as (select path_id, unnest(generate_series(ceil(lo / 0.5)::bigint, floor(hi / 0.5)::bigint)) k from d where floor(hi / 0.5) >= ceil(lo / 0.5)) select path_id, k * 0.5::double as "level", abs(k) % 5 = 0 is_index from l""")
def contour_levels(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).groupBy("path_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("hi > lo")
    rows = rows.select("path_id", F.explode(scales.contour_levels(F.col("lo"), F.col("hi"), F.lit(0.5))).alias("level"))
    return rows.select("path_id", "level", scales.is_index(F.col("level"), F.lit(0.5), 5).alias("is_index"))


@query(with_views("steps") + """ select r, c, least(3, greatest(0, ceil(-log10(i) - 1e-9)))::int decimals, printf('%.' || least(3, greatest(0, ceil(-log10(i) - 1e-9)))::int || 'f', z::double) label from (select r, c, z::double + 0.001 z, [0.001, 0.02, 0.5, 5, 100][1 + c % 5]::double i from steps)""")
def level_labels(spark, sf_dir):
    i = F.element_at(F.array(*map(F.lit, (0.001, 0.02, 0.5, 5.0, 100.0))), (F.col("c") % 5 + 1).cast("int"))
    rows = fixtures.steps(spark, sf_dir).withColumn("i", i).withColumn("decimals", scales.level_decimals(F.col("i")))
    return rows.select("r", "c", "decimals", text.level_text(F.col("z") + 0.001, F.col("decimals")).alias("label"))


@query(with_views("trees") + """ , t as (select ord, dbh, case when dbh is not null then least(greatest((dbh - 0) / 9000.0, 0), 1) end t from trees) select ord, round(case when dbh is null then 2.0 else sqrt(1.2 * 1.2 + t * (5 * 5 - 1.2 * 1.2)) end, 6) by_area, round(1.2 + (5 - 1.2) * t, 6) by_length,
   round(-(t * 360 + 10) * pi() / 180, 6) by_range, round(-(dbh + 10) * pi() / 180, 6) by_degrees, dbh is null unmeasured from t""")
def value_scales(spark, sf_dir):
    """Sizes and angles bound to an attribute, with the fixed size where it is missing."""
    v, lo, hi = F.col("dbh"), F.lit(0.0), F.lit(9000.0)
    area, none = features.driven(v, 2.0, 0, 9000, 1.2, 5, "area")
    return fixtures.trees(spark, sf_dir).select("ord", r6(area, "by_area"), r6(F.when(~none, scales.scale_value(v, lo, hi, 1.2, 5, "linear")), "by_length"), r6(F.when(~none, scales.angle_value(v, lo, hi, "range", 10)), "by_range"), r6(scales.angle_value(v, lo, hi, "degrees", 10), "by_degrees"), none.alias("unmeasured"))


@query(with_views("steps") + """ select r, c, greatest(1, floor(greatest(r, c) / greatest(4, c % 60)::double + 0.5))::int stride, floor((c + 4) * (c + 4) * 0.75::double + 0.5)::bigint marks,
   case when floor((c + 4) * (c + 4) * 0.75::double + 0.5) <= 1200 then 'comfortable' when floor((c + 4) * (c + 4) * 0.75::double + 0.5) <= 4000 then 'heavy' else 'too many' end verdict from steps""")
def stride_and_budget(spark, sf_dir):
    marks, verdict = scales.budget(F.col("c") + 4, F.lit(0.75))
    return fixtures.steps(spark, sf_dir).select("r", "c", scales.stride_for(F.col("r"), F.col("c"), F.col("c") % 60).alias("stride"), marks.cast("long").alias("marks"), verdict.alias("verdict"))


@query(with_views("image") + """ select y, x, round((0.2126 * red + 0.7152 * green + 0.0722 * blue) / 255::double, 6) luminance, round(least(1, greatest(0, (2 * green - red - blue) / 255::double * 0.5 + 0.5)), 6) greenness, round(greatest(red, green, blue) / 255::double, 6) brightness,
   round(case when greatest(red, green, blue) > 0 then (greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue)::double else 0 end, 6) saturation, round(1 - (0.2126 * red + 0.7152 * green + 0.0722 * blue) / 255::double, 6) darkness,
   round(red / 255::double, 6) red, round(green / 255::double, 6) green, round(blue / 255::double, 6) blue from image""")
def image_channels(spark, sf_dir):
    rgb = [F.col(n) for n in ("red", "green", "blue")]
    return fixtures.image(spark, sf_dir).select("y", "x", *[F.round(f(*rgb), 6).alias(n) for n, f in colour.CHANNELS.items()])


_HASH = "select i, j, round((((((m >> 13) ^ m) * 1274126177) & 4294967295) >> 8 & 65535) / 65535::double, 9) u from (select i, j, (((i & 4294967295) * 73856093) & 4294967295) ^ (((j & 4294967295) * 19349663) & 4294967295) ^ ((83492791 * 3) & 4294967295) m from h)"


@query(with_views("steps") + ", h as (select (r - 20)::bigint i, (c - 25)::bigint j from steps) " + _HASH.replace("((((((m >> 13) ^ m) * 1274126177) & 4294967295) >> 8 & 65535)", "(((((xor(m >> 13, m) * 1274126177) & 4294967295) >> 8) & 65535)").replace("(((i & 4294967295) * 73856093) & 4294967295) ^ (((j & 4294967295) * 19349663) & 4294967295) ^ ((83492791 * 3) & 4294967295)", "xor(xor(((i & 4294967295) * 73856093) & 4294967295, ((j & 4294967295) * 19349663) & 4294967295), (83492791 * 3) & 4294967295)"))
def cell_hash(spark, sf_dir):
    return fixtures.steps(spark, sf_dir).select((F.col("r") - 20).cast("long").alias("i"), (F.col("c") - 25).cast("long").alias("j")).select("i", "j", F.round(hashing.cell_random(F.col("i"), F.col("j"), 3), 9).alias("u"))


# ---------------------------------------------------------------- geometry


@query(with_views("rings") + """ , e as (select feature_id, ring, hole, x, y, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from rings window w as (partition by feature_id, ring order by i rows between unbounded preceding and unbounded following))
 select feature_id, ring::int ring, hole, sum(x * y1 - x1 * y)::double area2, sum(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)))::double length, min(x) x0, min(y) y0, max(x) x1, max(y) y1 from e group by all""")
def ring_measures(spark, sf_dir):
    """Signed area, length and box of each ring."""
    p, b = F.col("pts"), shapes.bbox(F.col("pts"))
    return fixtures.rings(spark, sf_dir).select("feature_id", "ring", "hole", shapes.ring_area2(p).alias("area2"), shapes.path_length(p, True).alias("length"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))


@query(with_views("tracks") + """ , e as (select path_id, x, y, lag(x) over w x0, lag(y) over w y0 from tracks window w as (partition by path_id order by i)) select path_id, count(*) n, round(coalesce(sum(sqrt(pow(x - x0, 2) + pow(y - y0, 2))), 0), 4) length from e group by path_id""")
def path_lengths(spark, sf_dir):
    return fixtures.track_paths(spark, sf_dir).select("path_id", F.size("pts").cast("long").alias("n"), F.round(shapes.path_length(F.col("pts")), 4).alias("length"))


_INSIDE = """, e as (select feature_id, ring, x, y, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from rings window w as (partition by feature_id, ring order by i rows between unbounded preceding and unbounded following)) """


@query(with_views("rings", "trees") + _INSIDE + """ select ord, feature_id from trees t, e where (e.y > t.y) <> (e.y1 > t.y) and t.x < (e.x1 - e.x) * (t.y - e.y) / (e.y1 - e.y) + e.x group by ord, feature_id having count(*) % 2 = 1""")
def points_in_rings(spark, sf_dir):
    """Which feature holds each point, by strips of the plane instead of all pairs."""
    strip = 12.0
    whole = fixtures.rings(spark, sf_dir).groupBy("feature_id").agg(F.collect_list("pts").alias("rings"))
    b = F.flatten("rings")
    ys = F.transform(b, lambda p: p["y"])
    whole = whole.select("feature_id", "rings", F.explode(F.sequence(F.floor(F.array_min(ys) / strip), F.floor(F.array_max(ys) / strip))).alias("strip"))
    points = fixtures.trees(spark, sf_dir).withColumn("strip", F.floor(F.col("y") / strip))
    return points.join(whole, "strip").where(shapes.in_rings(F.col("x"), F.col("y"), F.col("rings"))).select("ord", "feature_id")


@query(with_views("rings") + _INSIDE + """, o as (select feature_id f, ring r, abs(sum(x * y1 - x1 * y)) / 2 area from e where ring = 0 group by all), h as (select feature_id, ring, x px, y py from rings where hole and i = 0),
 c as (select h.feature_id, h.ring, e.feature_id f, e.ring r from h, e where e.ring = 0 and (e.y > py) <> (e.y1 > py) and px < (e.x1 - e.x) * (py - e.y) / (e.y1 - e.y) + e.x group by all having count(*) % 2 = 1),
 b as (select c.*, row_number() over (partition by c.feature_id, c.ring order by area, c.f) k from c join o using (f, r))
 select r.feature_id, r.ring::int ring, r.hole, coalesce(b.f, r.feature_id) owner from (select distinct feature_id, ring, hole from rings) r left join b on r.hole and b.feature_id = r.feature_id and b.ring = r.ring and k = 1""")
def holes_to_outlines(spark, sf_dir):
    rows = fixtures.rings(spark, sf_dir).withColumn("id", F.struct("feature_id", "ring"))
    got = features.group_rings(rows.select(F.col("id").alias("ring"), "hole", "pts"))
    return got.select(F.col("ring.feature_id").alias("feature_id"), F.col("ring.ring").alias("ring"), "hole", F.col("owner.feature_id").alias("owner"))


@query(with_views("tracks") + """ , s as (select path_id, i, x, y, lead(x) over w x1, lead(y) over w y1 from tracks window w as (partition by path_id order by i)),
 t as (select *, greatest(0, case when x1 < x then (x - 600) / (x - x1) end, case when x1 > x then (100 - x) / (x1 - x) end, case when y1 < y then (y - 80) / (y - y1) end, case when y1 > y then (5 - y) / (y1 - y) end) t0,
   least(1, case when x1 < x then (x - 100) / (x - x1) end, case when x1 > x then (600 - x) / (x1 - x) end, case when y1 < y then (y - 5) / (y - y1) end, case when y1 > y then (80 - y) / (y1 - y) end) t1 from s where x1 is not null and not (x1 = x and (x < 100 or x > 600)) and not (y1 = y and (y < 5 or y > 80)))
 select path_id, i, round(t0, 6) t0, round(t1, 6) t1, round(x + (x1 - x) * t0, 2) ax, round(y + (y1 - y) * t0, 2) ay from t where t0 <= t1""")
def clip_to_box(spark, sf_dir):
    w = Window.partitionBy("path_id").orderBy("i")
    rows = fixtures.tracks(spark, sf_dir).select("path_id", "i", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    cut = shapes.clipped_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), 100.0, 5.0, 600.0, 80.0)
    rows = rows.select("path_id", "i", cut.alias("m")).where("m is not null")
    return rows.select("path_id", "i", r6("m.t0", "t0"), r6("m.t1", "t1"), F.round("m.ax", 2).alias("ax"), F.round("m.ay", 2).alias("ay"))


@query(with_views("tracks") + """ , e as (select path_id, i, x, y, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) d from tracks window w as (partition by path_id order by i)) select path_id, i, round(sum(d) over (partition by path_id order by i), 4) s from e""")
def arc_table(spark, sf_dir):
    return paths.arc_table(fixtures.tracks(spark, sf_dir), ["path_id"]).select("path_id", "i", F.round("s", 4).alias("s"))


@query(with_views("tracks") + """ , e as (select path_id, i, x, y, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) d from tracks window w as (partition by path_id order by i)), a as (select *, sum(d) over (partition by path_id order by i) s from e),
 g as (select *, lead(s) over w s1, lead(x) over w x1, lead(y) over w y1 from a window w as (partition by path_id order by i)), t as (select path_id, unnest([10.0, 25.5, 60.25]) "at" from (select distinct path_id from tracks))
 select path_id, "at"::double "at", round(x + (x1 - x) * ("at" - s) / (s1 - s), 4) x, round(y + (y1 - y) * ("at" - s) / (s1 - s), 4) y, round((x1 - x) / (s1 - s), 6) tx from g join t using (path_id) where s1 > s and "at" >= s and "at" < s1""")
def points_at_arc(spark, sf_dir):
    arcs = paths.arc_table(fixtures.tracks(spark, sf_dir), ["path_id"])
    at = arcs.select("path_id").distinct().select("path_id", F.explode(F.array(*map(F.lit, (10.0, 25.5, 60.25)))).alias("at"))
    return paths.at_arc(arcs, ["path_id"], at).select("path_id", "at", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6("tx", "tx"))


@query(with_views("tracks", "rings") + _INSIDE + """, s as (select path_id, i, x ax, y ay, lead(x) over w bx, lead(y) over w by_ from (select path_id, i, x / 15 x, y / 3 y from tracks) window w as (partition by path_id order by i)),
 k as (select path_id, i, ax, ay, bx, by_, ((e.x1 - ax) * (e.y - e.y1) - (e.y1 - ay) * (e.x - e.x1)) / nullif((bx - ax) * (e.y - e.y1) - (by_ - ay) * (e.x - e.x1), 0) t, ((e.x1 - ax) * (by_ - ay) - (e.y1 - ay) * (bx - ax)) / nullif((bx - ax) * (e.y - e.y1) - (by_ - ay) * (e.x - e.x1), 0) u from s, e where bx is not null),
 c as (select path_id, i, ax, ay, bx, by_, t from k where t > 0 and t < 1 and u between 0 and 1 union select path_id, i, ax, ay, bx, by_, 0 from s where bx is not null union select path_id, i, ax, ay, bx, by_, 1 from s where bx is not null),
 p as (select *, lead(t) over (partition by path_id, i order by t) t1 from c), m as (select path_id, i, t t0, t1, ax + (bx - ax) * (t + t1) / 2 mx, ay + (by_ - ay) * (t + t1) / 2 my from p where t1 - t >= 1e-12)
 select path_id, i, round(t0, 6) t0, round(t1, 6) t1 from m, e where (e.y > my) <> (e.y1 > my) and mx < (e.x1 - e.x) * (my - e.y) / (e.y1 - e.y) + e.x group by path_id, i, t0, t1 having count(*) % 2 = 1""")
def clip_to_rings(spark, sf_dir):
    return _clipped(spark, sf_dir, fixtures.tracks(spark, sf_dir))


def _clipped(spark, sf_dir, tracks: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("i")
    rows = tracks.select("path_id", "i", (F.col("x") / 15).alias("ax"), (F.col("y") / 3).alias("ay"))
    seg = rows.select("path_id", "i", "ax", "ay", F.lead("ax").over(w).alias("bx"), F.lead("ay").over(w).alias("by")).where("bx is not null")
    edges = fixtures.rings(spark, sf_dir).select(F.explode(shapes.edges(F.col("pts"))).alias("e")).select(F.col("e.b.x").alias("ex"), F.col("e.b.y").alias("ey"), F.col("e.a.x").alias("cx"), F.col("e.a.y").alias("cy"))
    return paths.clip_segments(stored(seg, "segments"), stored(edges, "edges"), ["path_id", "i"]).select("path_id", "i", r6("t0", "t0"), r6("t1", "t1"))


# ---------------------------------------------------------------- rasters

_NINE = """, k as (select a.r, a.c, n.r - a.r dr, n.c - a.c dc, n.z from holed a, holed n where n.r between a.r - 1 and a.r + 1 and n.c between a.c - 1 and a.c + 1),
 n as (select r, c, max(z) filter (where dr = -1 and dc = -1) nw, max(z) filter (where dr = -1 and dc = 0) n, max(z) filter (where dr = -1 and dc = 1) ne, max(z) filter (where dr = 0 and dc = -1) w, max(z) filter (where dr = 0 and dc = 0) z, max(z) filter (where dr = 0 and dc = 1) e,
   max(z) filter (where dr = 1 and dc = -1) sw, max(z) filter (where dr = 1 and dc = 0) s, max(z) filter (where dr = 1 and dc = 1) se, count(z) k, max(z) hi, min(z) lo from k group by r, c) """.replace("from holed a, holed n where n.r between a.r - 1 and a.r + 1 and n.c between a.c - 1 and a.c + 1", "from holed a, (values (-1), (0), (1)) y(dr), (values (-1), (0), (1)) x(dc), holed n where n.r = a.r + y.dr and n.c = a.c + x.dc")


@query(with_views("holed") + _NINE + "select r, c, round(case when k = 9 then degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8, 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8, 2)))) end, 6) v from n")
def slope(spark, sf_dir):
    return focal.slope_degrees(fixtures.holed(spark, sf_dir), 1.0).select("r", "c", r6("v", "v"))


@query(with_views("holed") + _NINE + "select r, c, round(case when k = 9 then sqrt(pow(nw - z, 2) + pow(n - z, 2) + pow(ne - z, 2) + pow(w - z, 2) + pow(e - z, 2) + pow(sw - z, 2) + pow(s - z, 2) + pow(se - z, 2)) end, 6) v from n")
def ruggedness(spark, sf_dir):
    return focal.ruggedness(fixtures.holed(spark, sf_dir)).select("r", "c", r6("v", "v"))


@query(with_views("holed") + _NINE + "select r, c, round(case when k = 9 then hi - lo end, 6) v from n")
def roughness(spark, sf_dir):
    return focal.roughness(fixtures.holed(spark, sf_dir)).select("r", "c", r6("v", "v"))


@query(with_views("holed", "later") + " select r, c, round(holed.z - later.z, 6) z, round(abs(holed.z - later.z), 6) a from holed join later using (r, c)")
def difference(spark, sf_dir):
    a, b = fixtures.holed(spark, sf_dir), fixtures.later(spark, sf_dir)
    return focal.difference(a, b).select("r", "c", r6("z", "z"), r6(F.abs("z"), "a"))


@query(with_views("holed") + " select (r // 10)::int band, min(z) lo, max(z) hi, round(max(z) - min(z), 6) relief, count(z) measured, count(*) total from holed group by 1")
def raster_stats(spark, sf_dir):
    rows = fixtures.holed(spark, sf_dir).withColumn("band", F.expr("cast(r div 10 as int)"))
    return focal.stats(rows, ["band"]).withColumn("relief", F.round("relief", 6))


_SPOTS = """, sp as (select ord, 1 + x * 1.5 + 0.25 gx, 1 + (y % 8) + 0.125 gy from trees) """


@query(with_views("holed", "trees") + _SPOTS + """, q as (select ord, gx - 0.5 - floor(gx - 0.5) fx, gy - 0.5 - floor(gy - 0.5) fy, a.z a, b.z b, d.z d, e.z e from sp left join holed a on a.r = floor(gy - 0.5) and a.c = floor(gx - 0.5) left join holed b on b.r = floor(gy - 0.5) and b.c = floor(gx - 0.5) + 1
  left join holed d on d.r = floor(gy - 0.5) + 1 and d.c = floor(gx - 0.5) left join holed e on e.r = floor(gy - 0.5) + 1 and e.c = floor(gx - 0.5) + 1) select ord, round((a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy, 6) v from q""")
def bilinear_samples(spark, sf_dir):
    rows = fixtures.trees(spark, sf_dir).select("ord", (1 + F.col("x") * 1.5 + 0.25).alias("gx"), (1 + F.col("y") % 8 + 0.125).alias("gy"))
    return sampling.bilinear(rows, fixtures.holed(spark, sf_dir), ["ord"]).select("ord", r6("v", "v"))


@query(with_views("holed", "trees") + """ , n as (select max(r) + 1 nr from holed), sp as (select ord, least(greatest(floor(654000.0::double - 20 + x * 3 - 654000.0::double), 0), 99)::int c, least(greatest(floor(7738000.0::double - (7738000.0::double + 3 - y)), 0), nr - 1)::int r from trees, n) select ord, round(z, 6) v from sp left join holed using (r, c)""")
def nearest_samples(spark, sf_dir):
    cells = fixtures.holed(spark, sf_dir)
    rows = fixtures.trees(spark, sf_dir).select("ord", (WEST - 20 + F.col("x") * 3).alias("x"), (NORTH + 3 - F.col("y")).alias("y"))
    return sampling.nearest(rows, cells, fixtures.frame_of(cells, 100), ["ord"]).select("ord", r6("v", "v"))


@query(with_views("steps") + """ , n as (select max(r) nr from steps), p as (select r, c, z from steps union all select -1, c, z from steps where r = 0 union all select nr + 1, c, z from steps, n where r = nr) select r, c, z from p union all select r, -1, z from p where c = 0 union all select r, 50, z from p where c = 49""")
def padded_by_edge(spark, sf_dir):
    cells = fixtures.steps(spark, sf_dir)
    return focal.padded_by_edge(cells, fixtures.frame_of(cells, 50).nrows, 50).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z")


@query(with_views("holed") + """ , n as (select max(r) + 1 nr from holed) select r::int r, c::int c, z from (select r, c, coalesce(z, -10.0::double) z from holed union all select y, x, -10.0 from n, generate_series(-1, 100) t(x), (select unnest([-1, nr]) y from n) union all
 select y, x, -10.0 from (select unnest(generate_series(0, nr - 1)) y from n), (select unnest([-1, 100]) x))""")
def padded_below(spark, sf_dir):
    cells = fixtures.holed(spark, sf_dir)
    return focal.padded_below(cells, fixtures.frame_of(cells, 100).nrows, 100, -6.666666666666667).select("r", "c", F.round("z", 6).alias("z"))


@query(with_views("holed", "trees") + """ , pt as (select ord, 5 + x gx, 3 + y % 6 gy from trees), o as (select ord, gx + dx gx, gy + dy gy, s from pt, (values (1, 0, 'e'), (-1, 0, 'w'), (0, -1, 'n'), (0, 1, 's')) v(dx, dy, s)),
 q as (select ord, s, gx - 0.5 - floor(gx - 0.5) fx, gy - 0.5 - floor(gy - 0.5) fy, a.z a, b.z b, d.z d, e.z e from o left join holed a on a.r = floor(gy - 0.5) and a.c = floor(gx - 0.5) left join holed b on b.r = floor(gy - 0.5) and b.c = floor(gx - 0.5) + 1
  left join holed d on d.r = floor(gy - 0.5) + 1 and d.c = floor(gx - 0.5) left join holed e on e.r = floor(gy - 0.5) + 1 and e.c = floor(gx - 0.5) + 1), v as (select ord, s, (a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy v from q),
 g as (select ord, (max(v) filter (where s = 'e') - max(v) filter (where s = 'w')) / 2 gx, (max(v) filter (where s = 'n') - max(v) filter (where s = 's')) / 2 gy from v group by ord)
 select ord, round(-gx / sqrt(gx * gx + gy * gy), 5) dx, round(-gy / sqrt(gx * gx + gy * gy), 5) dy, round(sqrt(gx * gx + gy * gy), 5) slope from g""")
def fall_lines(spark, sf_dir):
    x, y = _FRAME.to_map(5 + F.col("x"), 3 + F.col("y") % 6)
    rows = fixtures.trees(spark, sf_dir).select("ord", x.alias("x"), y.alias("y"))
    got = sampling.fall_lines(rows, fixtures.holed(spark, sf_dir), _FRAME, "ord")
    return got.select("ord", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"), F.round("slope", 5).alias("slope"))


_SECTIONS = """ , f as (select max(r) + 1 nr from noise), b as (select nr, least(greatest(gx, 0.5), 64 - 0.5 - 1e-6) gx, least(greatest(gy, 0.5), nr - 0.5 - 1e-6) gy, section, j from (select nr, section, j, j / 63.0::double * 64 gx, section / 4.0::double * nr gy from f, generate_series(1, 3) s(section), generate_series(0, 63) t(j))),
 q as (select section, j, gx - 0.5 - floor(gx - 0.5) fx, gy - 0.5 - floor(gy - 0.5) fy, a.z a, bb.z b, d.z d, e.z e from b left join noise a on a.r = floor(gy - 0.5) and a.c = floor(gx - 0.5) left join noise bb on bb.r = floor(gy - 0.5) and bb.c = floor(gx - 0.5) + 1
  left join noise d on d.r = floor(gy - 0.5) + 1 and d.c = floor(gx - 0.5) left join noise e on e.r = floor(gy - 0.5) + 1 and e.c = floor(gx - 0.5) + 1), v as (select section, j, (a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy v from q)"""


@query(with_views("noise") + _SECTIONS + """ select section::int section, chr((64 + section)::int) label, count(v) n, round(min(v), 4) lo, round(max(v), 4) hi, round(8 / (max(v) - min(v)), 3) exaggeration from v group by section""")
def sections(spark, sf_dir):
    cells = fixtures.noise(spark, sf_dir)
    got = sampling.sections(cells, fixtures.frame_of(cells, 64), 3)
    return got.groupBy("section", "label").agg(F.count("v").alias("n"), F.round(F.min("lo"), 4).alias("lo"), F.round(F.min("hi"), 4).alias("hi"), F.round(F.min("exaggeration"), 3).alias("exaggeration"))


def _pairs(width: int, height: int) -> float:
    """How many blocks of 2 x 2 pixels, as in the SQL, lie along the longer side of an image, which is where the operators count them."""
    return max(width, height) / 2


@query(with_views("image") + """ , b as (select (y // 2)::int r, (x // 2)::int c, avg(red) red, avg(green) green, avg(blue) blue from image where y < (select (max(y) + 1) // 2 * 2 from image) and x < 50 group by 1, 2) select r, c, round((0.2126 * red + 0.7152 * green + 0.0722 * blue) / 255, 6) luminance, round(greatest(red, green, blue) / 255, 6) brightness from b""")
def block_means(spark, sf_dir):
    px = fixtures.image(spark, sf_dir)
    h = px.agg(F.max("y")).first()[0] + 1
    return symbols.block_channel(px, 50, h, _pairs(50, h), ("luminance", "brightness")).select("r", "c", r6("luminance", "luminance"), r6("brightness", "brightness"))


_HALFTONE = """, b as (select (y // 2)::int r, (x // 2)::int c, avg(red) red, avg(green) green, avg(blue) blue from image where y < (select (max(y) + 1) // 2 * 2 from image) and x < 50 group by 1, 2),
 t as (select r, c, 'greenness' channel, 0.95 m, least(1, greatest(0, (2 * green - red - blue) / 255 * 0.5 + 0.5)) v from b union all select r, c, 'brightness', 0.95 * 0.66, greatest(red, green, blue) / 255 from b union all select r, c, 'saturation', 0.95 * 0.36, case when greatest(red, green, blue) > 0 then (greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue) else 0 end from b) """


@query(with_views("image") + _HALFTONE + "select channel, r, c, 654000.0::double + (c + 0.5) * 2 x, 7738000.0::double - (r + 0.5) * 2 y, round(2 * m / 2 * v, 6) radius from t where v >= 0.04")
def triple_halftone(spark, sf_dir):
    px = fixtures.image(spark, sf_dir)
    h = px.agg(F.max("y")).first()[0] + 1
    got = symbols.halftone(px, 50, h, Frame(h, 50, 1.0, WEST, NORTH), _pairs(50, h), ("greenness", "brightness", "saturation"))
    # Rounded as SQL does it, in binary: a share of colour is often half a unit of the last place, where Spark's decimal rounding may go the other way.
    return got.select("channel", "r", "c", "x", "y", (F.round(F.col("radius") * 1e6, 0) / 1e6).alias("radius"))


@query(with_views("image") + " select y, x, round(round_even((0.2126 * red + 0.7152 * green + 0.0722 * blue) / 255::double * 255, 0))::int grey from image")
def grey_tile(spark, sf_dir):
    return symbols.grey_tile(fixtures.image(spark, sf_dir))


@query(with_views("image") + " , t as (select max(greatest(red * 3, green, blue)) m from image) select y, x, round(red * 3 * 255.0::double / m, 6) red, round(green * 255.0::double / m, 6) green, round(blue * 255.0::double / m, 6) blue from image, t")
def rescaled_bands(spark, sf_dir):
    got = symbols.rescaled_bands(fixtures.image(spark, sf_dir).withColumn("red", F.col("red") * 3))
    return got.select("y", "x", r6("red", "red"), r6("green", "green"), r6("blue", "blue"))


# ---------------------------------------------------------------- symbols and hatching


@query(with_views("holed") + " , b as (select min(z) lo, max(z) hi from holed) select r, c, 654000.0::double + (c + 0.5) x, 7738000.0::double - (r + 0.5) y, round(1.5 * (0.08 + 0.92 * (z - lo) / (hi - lo)), 6) radius, z v from holed, b where r % 3 = 7738000 % 3 and (c + 654000) % 3 = 0 and z is not null and (z - lo) / (hi - lo) >= 0.1")
def symbol_field(spark, sf_dir):
    cells = fixtures.holed(spark, sf_dir)
    return symbols.symbol_field(cells, fixtures.frame_of(cells, 100), 3, 0.1).withColumn("radius", F.round("radius", 6))


@query(with_views("noise") + " , b as (select max(abs(z))::double hi from noise) select r, c, round(1.0 * (0.08 + 0.92 * abs(z)::double / hi), 6) radius, round(z::double, 6) v from noise, b where r % 2 = 0 and c % 2 = 0 and z <> 0 and abs(z)::double / hi >= 0.05 / hi")
def signed_symbols(spark, sf_dir):
    cells = fixtures.noise(spark, sf_dir)
    return symbols.signed_symbol_field(cells, fixtures.frame_of(cells, 64), 2, 0.05).select("r", "c", r6("radius", "radius"), r6("v", "v"))


@query("select round(k * 50.0::double, 6) v, round(2.0 * (0.08 + 0.92 * (k * 50.0::double - 12) / 188), 6) radius from generate_series(1, 4) t(k)")
def symbol_legend(spark, sf_dir):
    rows = symbols.legend(12.0, 200.0, 4, 1, count=5)
    return spark.createDataFrame([(round(v, 6), round(r, 6)) for v, r in rows], "v double, radius double")


@query(with_views("trees") + """ , k as (select ord, x, y, 1 + ord % 3 radius, unnest(generate_series(-floor((1 + ord % 3) / 0.5)::bigint, floor((1 + ord % 3) / 0.5)::bigint)) i from trees), h as (select *, sqrt(greatest(0, radius * radius - (i * 0.5) * (i * 0.5))) h from k)
 select ord, i, round(x - sin(radians(30)) * i * 0.5 - cos(radians(30)) * h, 5) ax, round(y + cos(radians(30)) * i * 0.5 - sin(radians(30)) * h, 5) ay, round(2 * h, 5) length from h where h * 2 >= 0.4 and h > 1e-9""")
def circle_chords(spark, sf_dir):
    rows = fixtures.trees(spark, sf_dir).select("ord", "x", "y", (1 + F.col("ord") % 3).cast("double").alias("radius"))
    got = symbols.circle_chords(rows, 0.5, 30, 0.4)
    return got.select("ord", "i", F.round("ax", 5).alias("ax"), F.round("ay", 5).alias("ay"), F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), 5).alias("length"))


@query(with_views("trees") + " select ord, x, y from trees where x - 2.5 >= 0 and x + 2.5 <= 50 and y - 2.5 >= 0 and y + 2.5 <= 40")
def circles_on_sheet(spark, sf_dir):
    return symbols.on_sheet(fixtures.trees(spark, sf_dir).withColumn("radius", F.lit(2.5)), 50.0, 40.0).select("ord", "x", "y")


_HATCH = """, b as (select min(z)::double lo, max(z)::double hi, max(r) + 1 nr from steps), l as (select k, k * 4.0::double s from b, generate_series(ceil((7738000.0 - nr) / 4)::bigint - 1, floor(7738000.0 / 4)::bigint + 1) t(k)),
 g as (select k, s, j, floor(654000.0 / 4) * 4 - 4 + j * 4.0::double t from l, generate_series(0, 15) u(j)), h as (select g.*, least(greatest(floor(t + 2 - 654000.0), 0), 49)::int c, least(greatest(floor(7738000.0 - s), 0), nr - 1)::int r, lo, hi from g, b where t < 654050.0 + 4),
 d as (select k, s, j, t, case when hi > lo then least(greatest((z - lo) / (hi - lo), 0), 1) else 1 end d from h join steps using (r, c)), f as (select *, d >= 0.98 full_, coalesce(lag(d >= 0.98) over (partition by k order by j), false) was from d),
 n as (select *, sum(case when full_ and not was then 1 else 0 end) over (partition by k order by j) run from f), m as (select k, s, min(t) a, max(t) + 4 b from n where full_ group by k, s, run union all select k, s, t + 2 - d * 2, t + 2 + d * 2 from n where not full_ and d > 0),
 z as (select k, greatest(a, 654000.0) a, least(b, 654050.0) b from m, b where b - a >= 0.4 and s between 7738000.0 - nr and 7738000.0) """.replace("m, b where b - a", "m, b bb where b - a").replace("7738000.0 - nr and 7738000.0) ", "7738000.0 - bb.nr and 7738000.0) ")


@query(with_views("steps") + _HATCH + "select k line, count(*) marks, round(sum(b - a), 4) ink from z where b - a >= 0.4 group by k")
def hatch_field(spark, sf_dir):
    """Level scanlines over the raster of steps: marks and ink by line."""
    cells = fixtures.steps(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    got = symbols.hatch_field(cells, fixtures.frame_of(cells, 50), lo, hi, 4.0, 4.0, 0.0, 0.4)
    return got.groupBy("line").agg(F.count("*").alias("marks"), F.round(F.sum(F.col("bx") - F.col("ax")), 4).alias("ink"))


# ---------------------------------------------------------------- iso-lines and regions

_MARCH = oracles.marched("steps", 50, "select k * 4.0::double lv, k * 4.0::double + (abs(k * 4.0::double) + 1) * 1e-9 L from (select unnest(generate_series(ceil(lo / 4)::bigint, floor(hi / 4)::bigint)) k from (select min(z) lo, max(z) hi from steps))")


def _steps_segments(spark, sf_dir):
    cells = fixtures.steps(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    return contours.march(cells, 50, 4.0, lo=lo, hi=hi)


@query(with_views("steps") + _MARCH + """select "level", a_lo::bigint a_lo, a_hi::bigint a_hi, b_lo::bigint b_lo, b_hi::bigint b_hi, round(ax, 5) ax, round(ay, 5) ay, round(bx, 5) bx, round("by", 5) "by" from seg""")
def contour_segments(spark, sf_dir):
    xy = [F.round(n, 5).alias(n) for n in ("ax", "ay", "bx", "by")]
    return _steps_segments(spark, sf_dir).select("level", F.col("ka.lo").alias("a_lo"), F.col("ka.hi").alias("a_hi"), F.col("kb.lo").alias("b_lo"), F.col("kb.hi").alias("b_hi"), *xy)


_CHAINS = _MARCH + """, f as (select "level", count(*) n, sum(sqrt(pow(bx - ax, 2) + pow("by" - ay, 2))) len from seg group by 1), op as (select s."level", count(*) k from seg s where not exists (select 1 from seg e where e."level" = s."level" and e.b_lo = s.a_lo and e.b_hi = s.a_hi) group by 1)
 select f."level", coalesce(k, 0) opened, n segments, round(len, 3) length from f left join op using ("level")"""


@query(with_views("steps") + _CHAINS)
def contour_chains(spark, sf_dir):
    """Paths of each level: how many are open, how many segments, how long in all."""
    got = contours.chain(_steps_segments(spark, sf_dir))
    n = F.size("pts") - F.when(F.col("closed"), 0).otherwise(1)
    return got.groupBy("level").agg(F.count_if(~F.col("closed")).alias("opened"), F.sum(n).cast("long").alias("segments"), F.round(F.sum(shapes.path_length(F.col("pts"), F.col("closed"))), 3).alias("length"))


@query(with_views("steps") + _CHAINS)
def contour_chains_by_joins(spark, sf_dir):
    """The same from small blocks, so that most paths are joined from pieces."""
    got = contours.chain(stored(_steps_segments(spark, sf_dir), "segments"), block=8)
    n = F.size("pts") - F.when(F.col("closed"), 0).otherwise(1)
    return got.groupBy("level").agg(F.count_if(~F.col("closed")).alias("opened"), F.sum(n).cast("long").alias("segments"), F.round(F.sum(shapes.path_length(F.col("pts"), F.col("closed"))), 3).alias("length"))


@query()
def contours_traced(spark, sf_dir):
    """Contours in map units out to the raster's edge, with index lines."""
    cells = fixtures.holed(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    got = contours.trace(cells, fixtures.frame_of(cells, 100), scales.nice_step((hi - lo) / 6), lo, hi, 5)
    return got.select("level", "piece", "closed", "index", F.size("pts").alias("n"), F.round(shapes.path_length(F.col("pts"), F.col("closed")), 4).alias("length"))


@query(with_views("holed") + oracles.TRACED)
def contour_lengths(spark, sf_dir):
    """The same by level: open pieces, segments and length."""
    cells = fixtures.holed(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    got = contours.trace(cells, fixtures.frame_of(cells, 100), scales.nice_step((hi - lo) / 6), lo, hi, 5)
    n = F.size("pts") - F.when(F.col("closed"), 0).otherwise(1)
    return got.groupBy("level", "index").agg(F.count_if(~F.col("closed")).alias("opened"), F.sum(n).cast("long").alias("segments"), F.round(F.sum(shapes.path_length(F.col("pts"), F.col("closed"))), 3).alias("length"))


_REGIONS = """, b as (select r * 64 + c i, r, c, z from noise where z > 0.15), e as (select a.i x, n.i y from b a join b n on (n.r = a.r and abs(n.c - a.c) = 1) or (n.c = a.c and abs(n.r - a.r) = 1)),
 w as (select i, i root from b union select e.y, w.root from w join e on e.x = w.i where w.root < e.y), g as (select i, min(root) root from w group by i)
 select root::bigint region, count(*) cells, round(avg(z::double), 6) mean, round(max(z)::double, 6) as "max" from g join b using (i) group by root"""


#: SQL compares a FLOAT with 0.15 in single precision, where a cell of that value isn't above it; the operators compare in double.
_ABOVE = float(np.float32(0.15))


@query(with_views("noise").replace("with ", "with recursive ", 1) + _REGIONS)
def region_figures(spark, sf_dir):
    cells = fixtures.noise(spark, sf_dir)
    got = regions.regions(cells, fixtures.frame_of(cells, 64), _ABOVE)
    return got.select("region", "cells", r6("mean", "mean"), r6(F.col("max").cast("double"), "max"))


@query(with_views("noise") + " select count(*) cells, round(sum(z::double), 4) total from noise where z > 0.15")
def region_summary(spark, sf_dir):
    """All regions' cells together are the cells above the threshold; their weighted mean is the mean."""
    cells = fixtures.noise(spark, sf_dir)
    got = regions.region_summary(regions.regions(cells, fixtures.frame_of(cells, 64), _ABOVE))
    return got.select(F.col("area").cast("long").alias("cells"), F.round(F.col("mean") * F.col("area"), 4).alias("total"))


@query(with_views("noise").replace("with ", "with recursive ", 1) + oracles.RINGS + "select area < 0 hole, n::int n, round(area, 5) area from ring where abs(area) >= 0.5 and (area < 0 or area >= 1.5)")
def region_outlines(spark, sf_dir):
    cells = fixtures.noise(spark, sf_dir)
    got = regions.region_rings(cells, fixtures.frame_of(cells, 64), 0.15, 3.0)
    return got.select("hole", F.size("pts").alias("n"), F.round("area", 5).alias("area"))


def _steps_lines(spark, sf_dir):
    cells = fixtures.steps(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    frame = fixtures.frame_of(cells, 50)
    return cells, frame, stored(contours.trace(cells, frame, 4.0, lo, hi, edge="centres"), "lines")


@query()
def hachure_ticks(spark, sf_dir):
    """Ticks along the contours of the raster of steps."""
    cells, frame, lines = _steps_lines(spark, sf_dir)
    got = paths.hachures(lines, cells, frame, ["level", "path", "piece"])
    return got.select("level", "k", F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), 5).alias("length"), F.round("slope", 5).alias("slope"))


@query(with_views("steps").replace("with ", "with recursive ", 1) + _MARCH + oracles.STATIONS)
def contour_stations(spark, sf_dir):
    """Where ticks may stand: paths of each level and the points two cells apart along them."""
    _, _, lines = _steps_lines(spark, sf_dir)
    at = paths.stations(lines, 2.0, ["level", "path"]).groupBy("level").agg(F.count("*").alias("stations"))
    return lines.groupBy("level").agg(F.count("*").alias("paths")).join(at, "level", "left").select("level", "paths", F.coalesce("stations", F.lit(0)).alias("stations"))


# ---------------------------------------------------------------- flow


def _basin(spark, sf_dir):
    """The noise raster, as one raster."""
    return fixtures.noise(spark, sf_dir).select(F.lit(1).alias("raster"), "r", "c", F.round(F.col("z").cast("double"), 4).alias("z"))


@query(with_views("noise") + ", z as (select r, c, round(z::double, 4) z, max(r) over () last from noise) select count(*) cells, round(sum(z), 4) rim from z where r in (0, last) or c in (0, 63)")
def filled_rim(spark, sf_dir):
    """Filling leaves the rim as it was."""
    cells = _basin(spark, sf_dir)
    last = fixtures.frame_of(cells, 64).nrows - 1
    got = flow.fill_depressions(cells).where(F.col("r").isin(0, last) | F.col("c").isin(0, 63))
    return got.agg(F.count("*").alias("cells"), F.round(F.sum("filled"), 4).alias("rim"))


@query(with_views("noise").replace("with ", "with recursive ", 1) + oracles.FILLED + " select r, c, round(v, 6) filled from filled")
def depressions_filled(spark, sf_dir):
    return flow.fill_depressions(_basin(spark, sf_dir)).select("r", "c", r6("filled", "filled"))


@query(with_views("noise") + """ , z as (select r, c, round(z::double, 4) z from noise), d as (select a.r, a.c, n.r to_r, n.c to_c, pow((a.z - n.z) / dist, 1.1) * wide w from z a, (values (-1,0,1.0,0.5),(1,0,1.0,0.5),(0,-1,1.0,0.5),(0,1,1.0,0.5),(-1,-1,sqrt(2),0.354),(-1,1,sqrt(2),0.354),(1,-1,sqrt(2),0.354),(1,1,sqrt(2),0.354)) v(dr,dc,dist,wide), z n where n.r = a.r + dr and n.c = a.c + dc and n.z < a.z)
 select r, c, to_r, to_c, round(w / sum(w) over (partition by r, c), 6) share from d""")
def flow_shares(spark, sf_dir):
    return flow.flow_shares(_basin(spark, sf_dir), 1.0, value="z").select("r", "c", "to_r", "to_c", r6("share", "share"))


@query(with_views("noise") + " select count(*) cells, count(*)::double area from noise")
def flow_total(spark, sf_dir):
    """All the water that falls arrives in the cells that have no lower neighbour."""
    filled = stored(flow.fill_depressions(_basin(spark, sf_dir)), "filled")
    area = stored(flow.accumulate(filled, 1.0), "area")
    return area.agg(F.count("*").alias("cells")).withColumn("area", F.lit(round(flow.water_left(area, filled, 1.0), 3)))


@query(with_views("noise").replace("with ", "with recursive ", 1) + oracles.WETNESS)
def wetness_index(spark, sf_dir):
    return flow.wetness(_basin(spark, sf_dir), 1.0).select("r", "c", F.round("v", 5).alias("v"))


# ---------------------------------------------------------------- strokes


@query(with_views("tracks") + oracles.DASHED.format(least=kernels.MIN_MARK_MM))
def dashed_tracks(spark, sf_dir):
    got = paths.styled(fixtures.track_paths(spark, sf_dir), "dash_dot", ["path_id"])
    return got.groupBy("path_id").agg(F.count("*").alias("marks"), F.round(F.sum(shapes.path_length(F.col("pts"))), 4).alias("ink"))


@query(with_views("rings") + _INSIDE + ", a as (select feature_id, ring, sum(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2))) len from e group by 1, 2) select feature_id, ring::int ring, round(len * 0.8, 6) area from a")
def band_areas(spark, sf_dir):
    """The band along a rectangle's ring covers its length times its width."""
    rows = fixtures.rings(spark, sf_dir).withColumn("closed", F.lit(True))
    return paths.band_area(_bands(rows), ["feature_id", "part"]).select("feature_id", F.col("part").alias("ring"), r6("area", "area"))


def _bands(rows: DataFrame) -> DataFrame:
    return paths.bands(rows.withColumnRenamed("ring", "part"), 0.8, ["feature_id", "part"])


@query(with_views("rings") + " select feature_id, ring::int ring, 2::bigint lines, round(sum(case when i = 0 then 0 else 0 end) + (case when hole then 16 else 40 end) * 2.0, 6)::double length from rings group by feature_id, ring, hole")
def band_fill_lines(spark, sf_dir):
    """Two lines half a millimetre apart on either side of the ring: one is longer by what the other is shorter."""
    rows = fixtures.rings(spark, sf_dir).withColumn("closed", F.lit(True)).withColumnRenamed("ring", "part")
    got = paths.band_fills(rows, 1.0, 0.5, ["feature_id", "part"])
    return got.groupBy("feature_id", F.col("part").alias("ring")).agg(F.count("*").alias("lines"), F.round(F.sum(shapes.path_length(F.col("pts"))), 6).alias("length"))


def _one_box(spark, half: float):
    """A table with one box around the origin, and its columns."""
    base = spark.range(1).select(F.struct(*[F.lit(v).alias(n) for n, v in (("cx", 0.0), ("cy", 0.0), ("half", half), ("half_y", half))]).alias("f"))
    return base, fills.Box(*(F.col(f"f.{n}") for n in ("cx", "cy", "half", "half_y")))


@query("""select name pattern, n from (values ('lines', 29::bigint), ('double', 58), ('zigzag', 29), ('herringbone', 841)) v(name, n)""")
def fill_families(spark, sf_dir):
    """Strokes of a few families over a box of half size 13 at spacing 1."""
    base, b = _one_box(spark, 13.0)
    out = None
    for name in ("lines", "double", "zigzag", "herringbone"):
        one = fills.LINE_FAMILIES[name](base, b, F.lit(1.0)).agg(F.count("*").alias("n")).select(F.lit(name).alias("pattern"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_views("rings") + ", q as (select distinct feature_id, 1 + feature_id % 3 s from rings) select feature_id, (2 * floor(7.5 / s) + 1)::bigint strokes, (2 * floor(7.5 / s) + 1) * 15.0::double ink from q")
def overlapping_fills(spark, sf_dir):
    """Squares that overlap their neighbours, each filled by itself with a spacing of its own."""
    outer = fixtures.rings(spark, sf_dir).where("not hole").select(F.col("feature_id").alias("ord"), F.array(F.transform("pts", lambda p: shapes.point(p["x"] + (p["x"] - F.col("pts")[0]["x"]) / 2, p["y"] + (p["y"] - F.col("pts")[0]["y"]) / 2))).alias("rings"))
    got = fills.fill_features(outer.withColumn("s", 1.0 + F.col("ord") % 3).select("ord", "rings", F.col("s").alias("step")), ["ord"], "lines", F.col("step"), 0, 0)
    return got.groupBy(F.col("ord").alias("feature_id")).agg(F.count("*").alias("strokes"), F.round(F.sum(shapes.path_length(F.col("pts"))), 6).alias("ink"))


@query()
def fill_all_patterns(spark, sf_dir):
    """Strokes and ink of every pattern inside a square with a hole."""
    outer = np.array([(0, 0), (30, 0), (30, 30), (0, 30)], float)
    hole = np.array([(10, 10), (10, 20), (20, 20), (20, 10)], float)
    out = None
    for name in fills.PATTERNS:
        got = fills.fill(spark, [outer, hole], name, 2.0, 30.0, 0.2)
        one = got.agg(F.count("*").alias("strokes"), F.round(F.sum(shapes.path_length(F.col("pts"))), 4).alias("ink")).select(F.lit(name).alias("pattern"), "strokes", "ink")
        out = one if out is None else out.unionByName(one)
    return out


@query("with p as (select i, j, i * 1.3 + case when abs(j) % 2 = 1 then 0.65 else 0 end x, j * 1.3::double y from generate_series(-11, 11) a(i), generate_series(-11, 11) b(j)) select i::int i, j::int j, round(x, 6)::double x, round(y, 6)::double y from p where x - 0.3 > -10 and x + 0.3 < 10 and y - 0.3 > -10 and y + 0.3 < 10")
def scattered_marks(spark, sf_dir):
    """Plus marks on a staggered lattice, inside a square with room for their arms."""
    base, b = _one_box(spark, 14.2)
    box = F.array(shapes.points(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((-10, -10), (10, -10), (10, 10), (-10, 10))]))
    return fills.scattered(base.withColumn("box", box), "plus", b, F.lit(1.0), "box").select("i", "j", r6("x", "x"), r6("y", "y")).distinct()


@query(with_views("trees") + """ , p as (select ord, x, y, unnest([0, 1, 2, 3, 4]) k from trees where x between 0 and 50 and y between 0 and 50) select ord, k::int i, round(x + r * cos(a + rot) , 5) px, round(y + r * sin(a + rot), 5) py from (select ord, x, y, k, 2.0 r, case k % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end * pi() / 2 - 3 * pi() / 4 a, -(ord % 360) * pi() / 180 rot from p)""")
def point_symbols(spark, sf_dir):
    """Squares turned by an attribute: their corners lie at the radius."""
    rot = features.rotation_of((F.col("ord") % 360).cast("double"), 0, 360)
    got = features.point_symbols(fixtures.trees(spark, sf_dir), ["ord"], "square", 2.0, rot, 50.0, 50.0)
    return got.select("ord", F.posexplode("pts").alias("i", "p")).select("ord", "i", F.round("p.x", 5).alias("px"), F.round("p.y", 5).alias("py"))


@query(with_views("photos") + _UTM_SQL + """, v as (select n, (row_number() over (order by n) - 1) k, (x - 654000.0::double) gx, (7738000.0::double - y) gy from u) select n, round(gx, 3) gx, round(gy, 3) gy, gx between 0 and 100 and gy between 0 and 100 inside from v""")
def placed_photos(spark, sf_dir):
    cells = fixtures.holed(spark, sf_dir)
    got = features.place_photos(fixtures.photos(spark, sf_dir), cells, _FRAME)
    return got.select("n", F.round(F.col("x") - WEST, 3).alias("gx"), F.round(NORTH - F.col("y"), 3).alias("gy"), "inside")


@query(with_views("photos") + " select n, round(10 + cos(radians(90 - direction)) * 1.5, 5) ax, round(20 + sin(radians(90 - direction)) * 1.5, 5) ay, round(10 + cos(radians(90 - direction)) * 4.5, 5) bx, round(20 + sin(radians(90 - direction)) * 4.5, 5) \"by\" from photos")
def bearing_ticks(spark, sf_dir):
    rows = fixtures.photos(spark, sf_dir).select("n", F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), "direction")
    got = features.photo_marks(rows, ["n"], "circle", 3, "direction")
    ends = [F.col("pts")[0]["x"], F.col("pts")[0]["y"], F.col("pts")[1]["x"], F.col("pts")[1]["y"]]
    return got.select("n", *[F.round(e, 5).alias(k) for e, k in zip(ends, ("ax", "ay", "bx", "by"), strict=True)])


@query(with_views("photos") + " select n, case when n % 10 = 0 then 654000.0::double + n + 2.5 else 654000.0::double + n end x, 654000.0::double + n raw_x, case when n % 10 = 0 then 2.5 else 0.0 end::double dx from photos")
def hand_corrections(spark, sf_dir):
    rows = fixtures.photos(spark, sf_dir).select("n", (WEST + F.col("n")).alias("x"), F.lit(0.0).alias("y"))
    moves = rows.where("n % 10 = 0").select("n", F.lit(2.5).alias("dx"), F.lit(-1.0).alias("dy"))
    return features.corrected(rows, moves).select("n", "x", "raw_x", "dx")


@query(with_views("photos") + " select count(lat) located, count(*) - count(lat) unlocated from photos")
def photo_split(spark, sf_dir):
    a, b = features.split_photos(fixtures.photos(spark, sf_dir).withColumn("taken", F.lit(None).cast("string")))
    return a.agg(F.count("*").alias("located")).join(b.agg(F.count("*").alias("unlocated")))


@query(with_views("trees") + " select ord, round(sqrt(pow(x - 30, 2) + pow(y - 30, 2)), 6) distance from trees where sqrt(pow(x - 30, 2) + pow(y - 30, 2)) <= 40 order by 2, 1 limit 1")
def nearest_point(spark, sf_dir):
    return features.nearest_point(fixtures.trees(spark, sf_dir).withColumnRenamed("ord", "n"), 30.0, 30.0, 40.0).select(F.col("n").alias("ord"), r6("distance", "distance"))


_TEXT = "with t as (select n_nationkey n, n_name as text from nation), c as (select n, text, unnest(string_split(text, '')) ch from t) "


@query(_TEXT + "select n, round((sum(case when ch = ' ' then 42 else 65 end) * 1.25 + 6 * (count(*) - 1)) * 0.05, 6)::double width from c where ch <> '' group by n")
def text_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("text"))
    return lettering.measure(rows, ["n"], 5, 6, "wide").select("n", r6("width", "width"))


@query(oracles.STROKES)
def text_strokes(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("angle"))
    got = lettering.text_strokes(rows, ["n"], 5, 6, "middle", "middle")
    return got.groupBy("n").agg(F.count("*").alias("strokes"), F.round(F.sum(shapes.path_length(F.col("pts"))), 5).alias("ink"))


@query()
def contour_labels(spark, sf_dir):
    """Contours of the raster with holes, parted by their labels; labels are small, as its lines are short."""
    cells = fixtures.holed(spark, sf_dir)
    lo, hi = cells.agg(F.min("z"), F.max("z")).first()
    step = scales.nice_step((hi - lo) / 6)
    lines = contours.trace(cells, fixtures.frame_of(cells, 100), step, lo, hi)
    placed = stored(lettering.place_labels(lines, step, ["level", "path", "closed", "pts"], 2, 0.2, 20, tracking=0), "labels")
    gapped = paths.gapped(placed, "boxes", ["level"])
    return gapped.groupBy("level").agg(F.count("*").alias("parts"), F.round(F.sum(shapes.path_length(F.col("pts"), F.col("closed"))), 3).alias("length"))


# ---------------------------------------------------------------- names, tables, joins


@query("""with s as (select n, ['EPSG:25833', 'urn:ogc:def:crs:EPSG::4326', 'urn:ogc:def:crs:EPSG:6.9:25832', 'http://www.opengis.net/def/crs/EPSG/0/4258', 'local', 'urn:x'][1 + n % 6] s from (select n_nationkey n from nation)), m as (select n, s, regexp_extract_all(s, '[0-9]+') k from s)
 select n, case when len(k) > 0 then 'EPSG:' || k[len(k)] end epsg, regexp_matches(s, '^(urn:|http://www\\.opengis\\.net/def/crs/)') urn, coalesce(regexp_matches(s, '^(urn:|http://www\\.opengis\\.net/def/crs/)') and k[len(k)] in ('4326', '4258', '4979', '4269'), false) swapped from m""".replace("\\\\", "\\"))
def reference_names(spark, sf_dir):
    names = F.array(*map(F.lit, ("EPSG:25833", "urn:ogc:def:crs:EPSG::4326", "urn:ogc:def:crs:EPSG:6.9:25832", "http://www.opengis.net/def/crs/EPSG/0/4258", "local", "urn:x")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.element_at(names, (F.col("n_nationkey") % 6 + 1).cast("int")).alias("s"))
    epsg, urn = text.srs_of(F.col("s"))
    return rows.select("n", epsg.alias("epsg"), urn.alias("urn"), text.latitude_first(F.col("s")).alias("swapped"))


@query("""select n_nationkey n, case n_nationkey % 3 when 0 then 'ETRS89 / UTM zone 33N' when 1 then 'WGS 84' end as name, case n_nationkey % 3 when 0 then 'EPSG:25833' when 1 then 'EPSG:4326' end epsg from nation""")
def projection_labels(spark, sf_dir):
    wkt = sinks.wkt_of(F.when(F.col("n") % 3 == 0, "EPSG:25833").when(F.col("n") % 3 == 1, " epsg:4326 "))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")).withColumn("wkt", F.coalesce(wkt, F.lit("LOCAL_CS[1]")))
    name, epsg = text.prj_label(F.col("wkt"))
    return rows.select("n", name.alias("name"), epsg.alias("epsg"))


@query("select c_custkey n, case when c_custkey % 5 in (0, 1) then d when c_custkey % 5 in (2, 3) then -d end v, (c_custkey * 7 - 1000) % 360 + case when (c_custkey * 7 - 1000) % 360 < 0 then 360 else 0 end bearing from (select c_custkey, round(c_custkey % 90 + (c_custkey % 60) / 60.0::double + (c_custkey % 59) / 3600.0::double, 9) d from customer)")
def degrees_and_bearings(spark, sf_dir):
    k = F.col("c_custkey")
    ref = F.element_at(F.array(*map(F.lit, ("N", "E", "S", "W", ""))), (k % 5 + 1).cast("int"))
    v = text.degrees_of((k % 90).cast("double"), (k % 60).cast("double"), (k % 59).cast("double"), ref)
    return table(spark, sf_dir, "customer").select(k.alias("n"), F.round(v, 9).alias("v"), text.bearing((k * 7 - 1000).cast("double")).cast("long").alias("bearing"))


_FILES = "with f as (select p_partkey n, ['/a/Site_' || p_partkey % 9 || '.SHP', 'x/site_' || p_partkey % 9 || '.dbf', 'dtm' || p_partkey || '.tif', 'IMG_' || p_partkey || '.jpeg', 'plan.xml', 'notes'][1 + p_partkey % 6] p from part), s as (select n, p, lower(regexp_extract(p, '[^/]*$')) f from f) "


def _files(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.array(F.concat(F.lit("/a/Site_"), k % 9, F.lit(".SHP")), F.concat(F.lit("x/site_"), k % 9, F.lit(".dbf")), F.concat(F.lit("dtm"), k, F.lit(".tif")), F.concat(F.lit("IMG_"), k, F.lit(".jpeg")), F.lit("plan.xml"), F.lit("notes"))
    return table(spark, sf_dir, "part").select(k.alias("n"), F.element_at(name, (k % 6 + 1).cast("int")).alias("p"))


@query(_FILES + "select n, regexp_replace(f, '\\.[^.]*$', '') stem, regexp_extract(f, '\\.([^.]*)$', 1) ext, case when f like '%.tif' then 'raster' when f like '%.shp' or f like '%.dbf' then 'features' when f like '%.jpeg' then 'photo' when f like '%.xml' then 'sniff' else 'unknown' end route from s")
def file_routes(spark, sf_dir):
    stem, ext = text.stem_and_extension(F.col("p"))
    return _files(spark, sf_dir).select("n", stem.alias("stem"), ext.alias("ext"), text.route_of(F.col("p")).alias("route"))


@query(_FILES + ", k as (select distinct regexp_replace(f, '\\.[^.]*$', '') stem, regexp_extract(f, '\\.([^.]*)$', 1) ext from s) select stem, max((ext = 'shp')::int)::int shp, max((ext = 'dbf')::int)::int dbf from k where ext in ('shp', 'dbf') group by stem")
def sibling_files(spark, sf_dir):
    """Files of one stem belong together, whichever of them there are."""
    stem, ext = text.stem_and_extension(F.col("p"))
    rows = _files(spark, sf_dir).select(stem.alias("stem"), ext.alias("ext")).distinct()
    shp, dbf = (rows.where(F.col("ext") == e).select("stem", F.lit(1).alias(e)) for e in ("shp", "dbf"))
    return shp.join(dbf, "stem", "full").select("stem", F.coalesce("shp", F.lit(0)).alias("shp"), F.coalesce("dbf", F.lit(0)).alias("dbf"))


@query("select 'dtm' || p_partkey || '.tif' as name, (row_number() over (order by p_partkey))::bigint place from part")
def natural_order(spark, sf_dir):
    """File names in the order of the numbers inside them; the first is the primary one."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("dtm"), "p_partkey", F.lit(".tif")).alias("name"))
    return rows.select("name", F.row_number().over(Window.orderBy(text.natural_key(F.col("name")))).cast("long").alias("place"))


@query("select o_orderkey n, case when o_orderkey % 4 = 0 then null else round(o_totalprice::double, 2) end num, case o_orderkey % 4 when 0 then null when 1 then true else false end yes, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def table_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    num = F.when(k % 4 == 0, F.concat(F.lit("  "), F.lit("\0"))).otherwise(F.lpad(F.round(F.col("o_totalprice").cast("double"), 2).cast("string"), 14, " "))
    yes = F.element_at(F.array(*map(F.lit, ("?", "T", "n", "F"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("n"), num.alias("a"), yes.alias("b"), F.date_format("o_orderdate", "yyyyMMdd").alias("c"))
    return rows.select("n", text.table_field(F.col("a"), "N").alias("num"), text.table_field(F.col("b"), "L").alias("yes"), text.table_field(F.col("c"), "D").alias("day"))


@query("select 0.0::double + min(dbh) lo, max(dbh) hi, count(dbh) n, count(*) - count(dbh) missing from (" + fixtures.SQL["trees"] + ")")
def field_range(spark, sf_dir):
    return vector.field_range(fixtures.trees(spark, sf_dir), "dbh")


@query("select 'dbh' field, count(dbh) n from (" + fixtures.SQL["trees"] + ")")
def measured_fields(spark, sf_dir):
    rows = fixtures.trees(spark, sf_dir).select("ord", "dbh", F.lit(None).cast("double").alias("empty"))
    return vector.measured_fields(rows)


@query("select p_partkey n, case when p_partkey % 7 = 0 then [] else [p_partkey::double, p_size::double, 1.5, 2.5] end::varchar v from part")
def coordinate_lists(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.when(k % 7 == 0, F.lit("1 2 x")).otherwise(F.concat_ws(" ", k, "p_size", F.lit("9.0"), F.lit("1.5,2.5"), F.lit("8")))
    v = text.ordinates(s, F.lit(3))
    return table(spark, sf_dir, "part").select(k.alias("n"), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]")).alias("v"))


@query("select event_id n, case when event_id % 5 = 0 then null when value = 20 then null else value end z from events")
def nodata_rule(spark, sf_dir):
    bad = F.element_at(F.array(*map(F.lit, (-9999.0, -32768.0, 1e31, float("nan")))), (F.col("event_id") % 4 + 1).cast("int"))
    z = F.when(F.col("event_id") % 5 == 0, bad).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), text.no_data(z, F.lit(20.0)).alias("z"))


@query("select p_partkey n, regexp_replace(regexp_replace(printf('%.6f', p_retailprice::double / 8), '0+$', ''), '\\.$', '') num from part")
def plain_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), text.plain_number(F.col("p_retailprice").cast("double") / 8).alias("num"))


@query(with_views("steps") + " select r, c, (sum((z * 10)::bigint) over (partition by r order by c) % 256)::int v from steps")
def running_predictor(spark, sf_dir):
    """Differences along a row summed up again, modulo a byte."""
    w = Window.partitionBy("r").orderBy("c")
    return fixtures.steps(spark, sf_dir).select("r", "c", (F.sum(F.round(F.col("z") * 10).cast("long")).over(w) % 256).cast("int").alias("v"))


@query(with_views("trees") + " , a as (select ord, dbh from trees where ord % 3 <> 0) select trees.ord, trees.x, coalesce(a.dbh, -1.0::double) dbh, a.ord is null unpaired from trees left join a on a.ord = trees.ord")
def attribute_binding(spark, sf_dir):
    rows = fixtures.trees(spark, sf_dir)
    attrs = rows.where("ord % 3 != 0").select("ord", "dbh", F.lit(True).alias("there"))
    got = features.bind(rows.select("ord", "x"), attrs, ["dbh", "there"])
    return got.select("ord", "x", F.coalesce("dbh", F.lit(-1.0)).alias("dbh"), F.col("there").isNull().alias("unpaired"))


@query(with_views("tracks") + " select path_id, bool_or(x between 0 and 100 and y between 0 and 20) touches from tracks group by path_id")
def paths_on_sheet(spark, sf_dir):
    s = Sheet(Frame(4, 20, 1.0, 0.0, 4.0), 200)
    return fixtures.track_paths(spark, sf_dir).select("path_id", F.exists("pts", lambda p: s.holds(p["x"], p["y"])).alias("touches"))


@query(with_views("rings") + " select feature_id, ring::int ring from (select distinct feature_id, ring from rings) r where not exists (select 1 from nation where n_nationkey = feature_id and n_regionkey = 1)")
def layers_not_clipping(spark, sf_dir):
    """A layer that serves as the clip isn't drawn."""
    clip = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("int").alias("feature_id"))
    return fixtures.rings(spark, sf_dir).join(clip, "feature_id", "left_anti").select("feature_id", "ring")


# ---------------------------------------------------------------- drawings


def _drawing(spark, sf_dir):
    """Tracks and rings as paths, trees as circles."""
    t = drawing.as_paths(fixtures.track_paths(spark, sf_dir), "DLF-02_score_medium", "contours")
    r = drawing.as_paths(fixtures.rings(spark, sf_dir).withColumn("closed", F.lit(True)), "DLF-04_cut_inner", "regions", "overlay", "closed")
    c = drawing.as_circles(fixtures.trees(spark, sf_dir).withColumn("radius", F.lit(0.5)), "DLF-00_engrave", "symbols")
    return t.unionByName(r), c


_TOTALS = """, g as (select 'DLF-02_score_medium' layer, path_id k, count(*) v, coalesce(sum(d), 0) mm from (select path_id, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) d from tracks window w as (partition by path_id order by i)) group by path_id),
 h as (select 'DLF-04_cut_inner' layer, feature_id * 2 + ring k, count(*) v, case when hole then 16.0 else 40.0 end mm from rings group by feature_id, ring, hole), p as (select layer, 1 p, 0 c, v, mm from g union all select layer, 1, 0, v, mm from h union all select 'DLF-00_engrave', 0, 1, 0, pi() from trees)
 select layer, sum(p)::bigint paths, sum(c)::bigint circles, sum(v)::bigint vertices, round(sum(mm), 3) run_mm from p group by rollup(layer)"""


@query(with_views("tracks", "rings", "trees") + _TOTALS)
def drawing_totals(spark, sf_dir):
    p, c = _drawing(spark, sf_dir)
    return drawing.totals(p, c).select("layer", F.col("paths").cast("long").alias("paths"), F.col("circles").cast("long").alias("circles"), F.col("vertices").cast("long").alias("vertices"), F.round("run_mm", 3).alias("run_mm"))


@query("select * from (values ('surface', 0), ('overlay', 1)) v(sheet, ord)")
def drawing_sheets(spark, sf_dir):
    return drawing.sheets(*_drawing(spark, sf_dir))


@query(with_views("rings") + " select count(*) paths from (select distinct feature_id, ring from rings)")
def cuts_only(spark, sf_dir):
    return drawing.cuts_only(_drawing(spark, sf_dir)[0]).agg(F.count("*").alias("paths"))


@query("select * from (values (0, 'DLF-00_engrave', '#000000', 0.35, false), (1, 'DLF-01_score_light', '#0000ff', 0.45, false), (2, 'DLF-02_score_medium', '#00ff00', 0.6, false), (3, 'DLF-03_score_strong', '#00ffff', 0.75, false), (4, 'DLF-04_cut_inner', '#ff00ff', 0.9, true), (5, 'DLF-05_cut_outer', '#ff0000', 1.0, true), (6, 'DLF-99_sheet', '#808080', 0.5, false)) v(ord, layer, colour, grey, cuts)".replace("v(ord", "v(ord").replace("select *", "select ord, layer, colour, grey::double grey, cuts"))
def pass_table(spark, sf_dir):
    return colour.passes(spark).select("ord", "layer", colour.pass_colour(F.col("layer")).alias("colour"), "grey", "cuts")


@query(with_views("tracks", "rings", "trees") + " select 'POLYLINE' entity, (select count(distinct path_id) from (select path_id from tracks group by path_id having count(*) > 1)) + (select count(*) from (select distinct feature_id, ring from rings)) n union all select 'VERTEX', (select sum(k) from (select count(*) k from tracks group by path_id having count(*) > 1))::bigint + (select count(*) from rings) union all select 'CIRCLE', count(*) from trees")
def dxf_counts(spark, sf_dir):
    """Entities that a DXF of the drawing holds."""
    rows = sinks.to_dxf(*_drawing(spark, sf_dir)).select(F.explode(F.split("text", "\r\n")).alias("entity")).where("entity in ('POLYLINE', 'VERTEX', 'CIRCLE')")
    return rows.groupBy("entity").agg(F.count("*").alias("n"))


@query(with_views("tracks", "rings", "trees") + " select round(min(x0), 6) x0, round(min(y0), 6) y0, round(max(x1), 6) x1, round(max(y1), 6) y1 from (select x x0, y y0, x x1, y y1 from tracks union all select x, y, x, y from rings union all select x - 0.5, y - 0.5, x + 0.5, y + 0.5 from trees)")
def drawing_extents(spark, sf_dir):
    return sinks.extents(*_drawing(spark, sf_dir)).select(*[r6(n, n) for n in ("x0", "y0", "x1", "y1")])


@query(with_views("rings") + oracles.DXF)
def dxf_text(spark, sf_dir):
    return sinks.to_dxf(*_drawing(spark, sf_dir), sheet="overlay")


@query(with_views("tracks", "rings", "trees") + " select (select count(*) from (select path_id from tracks group by path_id having count(*) > 1)) + (select count(*) from (select distinct feature_id, ring from rings)) paths, (select count(*) from trees) circles")
def svg_counts(spark, sf_dir):
    rows = sinks.to_svg(*_drawing(spark, sf_dir), 800.0, 200.0, "tracks & rings")
    return rows.agg(F.count_if(F.col("text").contains("<path ")).alias("paths"), F.count_if(F.col("text").contains("<circle ")).alias("circles"))


@query(with_views("rings") + """ , e as (select feature_id, ring, hole, count(*) k from rings group by all) select 'DLF-04_cut_inner' pass, 'regions' kind, 'overlay' sheet, true closed, round(case when hole then 16 else 40 end / 5.0, 6)::double len_m, (k + 1)::int n_pts from e""")
def shapefile_lines(spark, sf_dir):
    p, _ = _drawing(spark, sf_dir)
    s = Sheet(Frame(100, 100, 1.0, WEST, NORTH), 200)
    return sinks.line_attributes(p.where("sheet = 'overlay'"), s).select("pass", "kind", "sheet", "closed", r6("len_m", "len_m"), "n_pts")


@query(with_views("trees") + " select 'DLF-00_engrave' pass, 'symbols' kind, 'surface' sheet, 0.5::double r_mm, 0.1::double r_m, 0.2::double diam_m, round(654000.0::double + x / 5, 6) x, round(7738000.0::double - 100 + y / 5, 6) y from trees")
def shapefile_points(spark, sf_dir):
    s = Sheet(Frame(100, 100, 1.0, WEST, NORTH), 200)
    return sinks.point_attributes(_drawing(spark, sf_dir)[1], s).select("pass", "kind", "sheet", "r_mm", r6("r_m", "r_m"), r6("diam_m", "diam_m"), r6("x", "x"), r6("y", "y"))


@query("""with p as (select n_nationkey n, 100.0 + n_nationkey * 150 w, 80.0 + n_nationkey * 100 h, [72, 150, 300][1 + n_nationkey % 3] dpi from nation), q as (select *, greatest(1, floor(w * dpi / 25.4::double + 0.5))::bigint wp, greatest(1, floor(h * dpi / 25.4::double + 0.5))::bigint hp from p)
 select w::double width, h::double height, wp width_px, hp height_px, round(greatest(0.25, 1.5 / (dpi / 25.4::double)), 6) stroke_mm, wp <= 16384 and hp <= 16384 and wp * hp / 1e6 <= 256 ok, floor(16384 / (w / 25.4::double))::bigint best_dpi from q""")
def raster_plans(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select((100.0 + k * 150).alias("width"), (80.0 + k * 100).alias("height"), F.element_at(F.array(F.lit(72), F.lit(150), F.lit(300)), (k % 3 + 1).cast("int")).alias("dpi"), F.lit(0.25).alias("stroke_mm"))
    return sinks.raster_plan(rows).select("width", "height", "width_px", "height_px", r6("stroke_mm_drawn", "stroke_mm"), "ok", "best_dpi")


@query(with_views("rings", "trees") + oracles.PIXELS)
def engraved_pixels(spark, sf_dir):
    p, c = _drawing(spark, sf_dir)
    got = sinks.engraved(p.where("sheet = 'overlay'"), c, 60.0, 5.0, 0.25)
    return got.groupBy("grey").agg(F.count("*").alias("pixels"))


@query(with_views("tracks", "rings", "trees") + " " + _TOTALS.replace(" select layer, sum(p)", ", s as (select layer, sum(p)") + ") " + oracles.REPORT.format(totals="select * from s"))
def report(spark, sf_dir):
    return sinks.report_lines(*_drawing(spark, sf_dir))


@query(oracles.MATERIAL)
def material_test(spark, sf_dir):
    t, c = sinks.test_sheet(spark)
    got = lettering.text_strokes(t, ["text", "x", "y", "size"], 2.0)
    return got.groupBy("text", "size").agg(F.count("*").alias("strokes")).unionByName(c.select(F.lit("dot").alias("text"), (F.col("radius") * 2).alias("size"), F.lit(1).cast("long").alias("strokes")))


@query("select s scale, 100 * 1000.0::double / s <= 600 and 100 * 1000.0::double / s <= 400 fits from (select unnest([20, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000]) s)")
def scale_ladder(spark, sf_dir):
    best = frames.fit_scale(_FRAME, 600, 400)
    return spark.createDataFrame([(s, s >= best) for s in frames.SCALES], "scale int, fits boolean")


@query("select s::int scale, m::double metres, mm::double mm, l label from (values (200, 10, 50, '10 M'), (500, 20, 40, '20 M'), (2000, 100, 50, '100 M'), (25000, 1000, 40, '1 KM')) v(s, m, mm, l)")
def scale_bars(spark, sf_dir):
    out = []
    for s in (200, 500, 2000, 25000):
        bar = drawing.scale_bar(Sheet(_FRAME, s))
        out.append((s, float(bar["metres"]), round(bar["mm"], 9), bar["label"]))
    return spark.createDataFrame(out, "scale int, metres double, mm double, label string")


@query("select epoch_us(date_trunc('hour', ts)) start_us, floor(user_id / 10.0)::bigint gx, count(*) n, min(value) lo, max(value) hi from events group by all")
def arrivals_by_window(spark, sf_dir):
    """Counts of arriving values by hour and square; the same plan runs on a stream."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("v"))
    return by_window(rows).select(F.unix_micros("start").alias("start_us"), "gx", "n", "lo", "hi")


@query()
def compiled_drawing(spark, sf_dir):
    """Contours with labels, hatching, symbols, regions, sections, photographs and features of one raster, clipped."""
    cells = fixtures.holed(spark, sf_dir)
    frame = fixtures.frame_of(cells, 100)
    layers = [{"kind": "point", "rows": fixtures.trees(spark, sf_dir).select("ord", (WEST + F.col("x")).alias("x"), (NORTH - 1 - F.col("y") % 8).alias("y")), "style": {"symbol": "star", "radius_mm": 1.5}}]
    spec = {"sheet": {"scale": 200}, "hatch": {"enabled": True, "source": "slope"}, "symbols": {"enabled": True, "source": "roughness"}, "regions": {"enabled": True, "threshold": 60.0, "min_area": 4.0}, "sections": {"enabled": True},
            "contours": {"interval": 25.0}, "clip": {"rings": [[(5, 5), (480, 5), (480, 45), (5, 45)]]}}
    p, c, _ = compile_drawing(spark, Inputs(cells, frame, fixtures.photos(spark, sf_dir), layers=layers), spec)
    got = p.groupBy("layer", "kind").agg(F.count("*").alias("n"), F.round(F.sum(shapes.path_length(F.col("pts"), F.col("closed"))), 3).alias("mm"))
    return got.unionByName(c.groupBy("layer", "kind").agg(F.count("*").alias("n"), F.round(F.sum("radius"), 3).alias("mm")))


@query(with_views("rings") + oracles.SOLID)
def solid_rows(spark, sf_dir):
    got = fills.solid_rows(fixtures.rings(spark, sf_dir), ["feature_id", "ring"])
    return got.select("feature_id", "ring", "row", r6(F.col("pts")[0]["y"], "y"), r6(F.col("pts")[1]["x"] - F.col("pts")[0]["x"], "length"))


@query(with_views("noise", "photos", "trees") + oracles.nested("ring", oracles.RINGS) + oracles.nested("u", _UTM_SQL) + oracles.nested("v", _SECTIONS) + oracles.FINDINGS)
def stage_findings(spark, sf_dir):
    """What the stages of a drawing of the noise raster find."""
    cells = fixtures.noise(spark, sf_dir)
    frame = fixtures.frame_of(cells, 64)
    rows = fixtures.trees(spark, sf_dir).select("ord", (WEST + F.col("x")).alias("x"), (F.lit(frame.south) + F.col("y")).alias("y"))
    spec = {"regions": {"enabled": True, "threshold": 0.15}, "symbols": {"enabled": True}, "sections": {"enabled": True}}
    found = findings.findings(spark, Inputs(cells, frame, fixtures.photos(spark, sf_dir), layers=[{"kind": "point", "name": "trees", "rows": rows}]), spec)
    return found.select("stage", "what", F.round("n", 4).alias("n"))


@query(with_views("trees") + """ , b as (select min(dbh) lo, max(dbh) hi from trees), r as (select case when dbh is null then 2.0 else sqrt(1 + (dbh - lo) / (hi - lo) * 15) end r from trees, b where x between 0 and 100 and y between 0 and 100)
 select round(r, 5) radius, count(*) n from r group by 1""")
def driven_symbols(spark, sf_dir):
    """Circles of 1 to 4 mm for the trees' girths, of 2 mm for those without one."""
    rows = fixtures.trees(spark, sf_dir).select("ord", F.col("x") + WEST, F.col("y") + (NORTH - 100)).toDF("ord", "x", "y")
    style = {"driven": {"size": {"field": "dbh", "least": 1.0, "most": 4.0}}}
    drawn = feature_paths(spark, {"kind": "point", "rows": rows, "attributes": fixtures.trees(spark, sf_dir).select("ord", "dbh"), "style": style}, Sheet(_FRAME, 1000))[0]
    b = shapes.bbox(F.col("pts"))
    return drawn.select(F.round((b["x1"] - b["x0"]) / 2, 5).alias("radius")).groupBy("radius").agg(F.count("*").alias("n"))


@query(with_views("image") + " select y, x, round(654000 + (x + 0.5) * 2, 6)::double easting, round(7738000 - (y + 0.5) * 2, 6)::double northing from image")
def stretched_pixels(spark, sf_dir):
    """An image of 50 columns laid over a raster of 100."""
    px = fixtures.image(spark, sf_dir)
    at = frames.stretched(_FRAME, 50, 1 + px.agg(F.max("y")).first()[0])
    return px.select("y", "x", r6(at.easting(F.col("x")), "easting"), r6(at.northing(F.col("y")), "northing"))
