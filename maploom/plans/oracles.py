"""DuckDB SQL for the operators that take more than a few lines of it; each computes from the given tables by itself."""

from __future__ import annotations

from maploom.functions.colour import PASSES
from maploom.operators.lettering import GLYPHS
from maploom.sources.sinks import DOT_LADDER, TYPE_LADDER

#: Eight neighbours: rows and columns away, distance, contour width.
AROUND = """(values (-1, 0, 1.0::double, 0.5::double), (1, 0, 1.0, 0.5), (0, -1, 1.0, 0.5), (0, 1, 1.0, 0.5),
  (-1, -1, sqrt(2), 0.354), (-1, 1, sqrt(2), 0.354), (1, -1, sqrt(2), 0.354), (1, 1, sqrt(2), 0.354)) o(dr, dc, dist, wide)"""


def marched(view: str, ncols: int, levels: str) -> str:
    """Views up to seg, the segments of view's levels l (lv, L) over its triangles: level, keys and points of both ends."""
    return f""", q as (select a.r, a.c, a.z a, b.z b, d.z d, e.z e from {view} a join {view} b on b.r = a.r and b.c = a.c + 1 join {view} d on d.r = a.r + 1 and d.c = a.c join {view} e on e.r = a.r + 1 and e.c = a.c + 1),
 l as ({levels}),
 t as (select lv, L, r * {ncols} + c i0, a z0, (r + 1) * {ncols} + c i1, d z1, r * {ncols} + c + 1 i2, b z2 from q, l union all select lv, L, r * {ncols} + c + 1, b, (r + 1) * {ncols} + c, d, (r + 1) * {ncols} + c + 1, e from q, l),
 u as (select *, (z0 > L)::int a0, (z1 > L)::int a1, (z2 > L)::int a2 from t), v as (select *, a0 + a1 + a2 n from u where a0 + a1 + a2 in (1, 2)),
 w as (select *, case when (a0 = 1) = (n = 1) then 0 when (a1 = 1) = (n = 1) then 1 else 2 end k from v),
 x as (select lv, L, n, case k when 0 then i0 when 1 then i1 else i2 end p, case k when 0 then z0 when 1 then z1 else z2 end pz, case k when 0 then i1 when 1 then i2 else i0 end s, case k when 0 then z1 when 1 then z2 else z0 end sz, case k when 0 then i2 when 1 then i0 else i1 end t, case k when 0 then z2 when 1 then z0 else z1 end tz from w),
 m as (select lv, n, least(p, s) l1, greatest(p, s) h1, (L - case when p < s then pz else sz end) / (case when p < s then sz else pz end - case when p < s then pz else sz end) t1, least(p, t) l2, greatest(p, t) h2, (L - case when p < t then pz else tz end) / (case when p < t then tz else pz end - case when p < t then pz else tz end) t2 from x),
 o as (select lv, n, l1, h1, l2, h2, l1 % {ncols} + t1 * (h1 % {ncols} - l1 % {ncols}) + 0.5 x1, l1 // {ncols} + t1 * (h1 // {ncols} - l1 // {ncols}) + 0.5 y1, l2 % {ncols} + t2 * (h2 % {ncols} - l2 % {ncols}) + 0.5 x2, l2 // {ncols} + t2 * (h2 // {ncols} - l2 // {ncols}) + 0.5 y2 from m),
 seg as (select lv "level", case when n = 1 then l1 else l2 end a_lo, case when n = 1 then h1 else h2 end a_hi, case when n = 1 then l2 else l1 end b_lo, case when n = 1 then h2 else h1 end b_hi, case when n = 1 then x1 else x2 end ax, case when n = 1 then y1 else y2 end ay, case when n = 1 then x2 else x1 end bx, case when n = 1 then y2 else y1 end "by" from o) """


def nested(name: str, views: str) -> str:
    """A view that holds others by themselves, so that their names don't meet those outside."""
    return f", {name} as (with recursive {views.strip().removeprefix(',')} select * from {name})"


#: Over holed: its edge cells come again outside, the segments are cut at the raster's extent, and each level is summed up.
TRACED = (
    """, h as (select z, r + dr + 1 r, c + dc + 1 c from holed, (select max(r) last from holed), (values (-1), (0), (1)) y(dr), (values (-1), (0), (1)) x(dc)
   where (dr = 0 or dr = -1 and r = 0 or dr = 1 and r = last) and (dc = 0 or dc = -1 and c = 0 or dc = 1 and c = 99)),
 st as (select lo, hi, (hi - lo) / 6 raw, pow(10.0::double, floor(log10((hi - lo) / 6))) mag from (select min(z) lo, max(z) hi from holed)),
 step as (select lo, hi, case when raw / mag <= 1.5 then 1.0::double when raw / mag <= 3.5 then 2.0 when raw / mag <= 7.5 then 5.0 else 10.0 end * mag step from st)"""
    + marched("h", 102, "select k * step lv, k * step + (abs(k * step) + 1) * 1e-9 L from (select step, unnest(generate_series(ceil(lo / step)::bigint, floor(hi / step)::bigint)) k from step)")
    + """, ends as (select *, ax - 1 x0, ay - 1 y0, bx - ax dx, "by" - ay dy, (select max(r) + 1 from holed) tall from seg),
 cut as (select *, greatest(0, case when dx <> 0 then least(-x0 / dx, (100 - x0) / dx) when x0 between 0 and 100 then 0 else 2 end, case when dy <> 0 then least(-y0 / dy, (tall - y0) / dy) when y0 between 0 and tall then 0 else 2 end) t0,
   least(1, case when dx <> 0 then greatest(-x0 / dx, (100 - x0) / dx) else 1 end, case when dy <> 0 then greatest(-y0 / dy, (tall - y0) / dy) else 1 end) t1 from ends),
 part as (select * from cut where t0 < t1),
 start as (select p."level", count(*) k from part p left join part e on e."level" = p."level" and e.b_lo = p.a_lo and e.b_hi = p.a_hi and e.t1 = 1 where p.t0 > 0 or e."level" is null group by 1),
 sums as (select "level", count(*) segments, sum(sqrt(dx * dx + dy * dy) * (t1 - t0)) mm from part group by 1)
 select s."level", floor(s."level" / step + 0.5)::bigint % 5 = 0 "index", coalesce(k, 0) opened, segments, round(mm, 3) length from sums s cross join step left join start using ("level")"""
)

#: Over noise, whose values stay below 1.15, from where on an outline would be cut at the edge: rings by their least key, areas by edges.
RINGS = (
    """, h as (select r + 1 r, c + 1 c, z::double z from noise union all select b.r, b.c, -0.85::double from (select unnest(range(0, (select max(r) + 3 from noise)::bigint)) r) a(r), (select unnest(range(0, 66)) c) d(c), lateral (select a.r r, d.c c) b
   where b.r in (0, (select max(r) + 2 from noise)) or b.c in (0, 65))"""
    + marched("h", 66, "select 0.15::double lv, 0.15::double + (0.15::double + 1) * 1e-9 L")
    + """, e as materialized (select a_lo::bigint * 10000000 + a_hi a, b_lo::bigint * 10000000 + b_hi b, -(ax * "by" - bx * ay) / 2 area from seg),
 walk(k, root) using key (k) as (select a, a from e union select e.b, w.root from walk w join e on e.a = w.k join recurring.walk now on now.k = e.b where w.root < now.root),
 ring as (select root, count(*) n, sum(area) area from e join walk on k = a group by root) """
)

#: Over noise: each cell takes the least level over which water leaves it.
FILLED = f""", z as materialized (select r, c, round(z::double, 4) z from noise),
 filled(r, c, v) using key (r, c) as (select r, c, z from z where r in (0, (select max(r) from z)) or c in (0, 63)
  union select n.r, n.c, min(greatest(n.z, f.v)) v from filled f, {AROUND}, z n left join recurring.filled now on now.r = n.r and now.c = n.c
   where n.r = f.r + dr and n.c = f.c + dc and (now.v is null or greatest(n.z, f.v) < now.v) group by n.r, n.c)"""

#: What drains through each cell: its own water and, step by step, its neighbours' shares.
WETNESS = (
    FILLED
    + f""", d as (select a.r, a.c, n.r tr, n.c tc, pow((a.v - n.v) / dist, 1.1) * wide w from filled a, {AROUND}, filled n where n.r = a.r + dr and n.c = a.c + dc and n.v < a.v),
 s as materialized (select r, c, tr, tc, w / sum(w) over (partition by r, c) share from d),
 water(step, r, c, a) as (select 0, r, c, 1.0::double from filled union all select any_value(w.step) + 1, s.tr, s.tc, sum(w.a * s.share) from water w join s on s.r = w.r and s.c = w.c group by s.tr, s.tc),
 area as (select r, c, sum(a) a from water group by r, c),
 g as (select a.r, a.c, sum(n.z * dc * case when dr = 0 then 2 else 1 end) / 8 gx, sum(n.z * dr * case when dc = 0 then 2 else 1 end) / 8 gy from z a, {AROUND}, z n where n.r = a.r + dr and n.c = a.c + dc group by a.r, a.c having count(*) = 8)
 select r, c, round(ln(a / greatest(sqrt(gx * gx + gy * gy), 0.001)), 5) v from g join area using (r, c)"""
)

#: Marks of 4 and 0.4 mm with gaps of 1.2 mm along each track; none below the least mark.
DASHED = """, a as (select path_id, sum(d) total, count(*) n from (select path_id, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) d from tracks window w as (partition by path_id order by i)) group by path_id),
 k as (select path_id, total, unnest(generate_series(0, floor(total / 6.8)::bigint)) * 6.8::double begun from a where n > 1),
 b as (select path_id, total, begun + f "first", least(begun + t, total) "last" from k, (values (0.0::double, 4.0::double), (5.2, 5.6)) v(f, t))
 select path_id, count(*) marks, round(sum("last" - "first"), 4) ink from b where "last" - "first" >= {least} - 1e-9 group by path_id"""

_GLYPHS = "(values " + ", ".join(f"('{c}', '{s}')" for c, s in GLYPHS.items()) + ") v(ch, strokes)"
#: ch, stroke, i, x, y, and each character's strokes and ink on a body of 100.
LETTERS = f"""runs as (select ch, unnest(string_split(strokes, '|')) run, unnest(range(1, len(string_split(strokes, '|')) + 1)) stroke from {_GLYPHS}),
 points as (select ch, stroke, unnest(string_split(run, ' ')) p, unnest(range(1, len(string_split(run, ' ')) + 1)) i from runs where run <> ''),
 steps as (select ch, stroke, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) d from (select ch, stroke, i, split_part(p, ',', 1)::double x, split_part(p, ',', 2)::double y from points) window w as (partition by ch, stroke order by i)),
 letters as (select ch, count(distinct stroke) strokes, sum(d) ink from steps group by ch)"""

STROKES = f"""with {LETTERS}, c as (select n_nationkey n, unnest(string_split(upper(n_name), '')) ch from nation)
 select n, sum(strokes)::bigint strokes, round(sum(ink) * 0.05, 5) ink from c join letters using (ch) group by n"""

_LADDER = ", ".join(f"({s}::double, '{s:.1f}')" for s in TYPE_LADDER)
#: The ladder's figures by size, each size's own label at 1.6 mm beside them, and dots.
MATERIAL = f"""with {LETTERS}, ladder as (select * from (values {_LADDER}) v(size, label)),
 texts as (select label as text, 1.6::double size from ladder union all select t, size from ladder, (values ('77.5'), ('104.25')) v(t)),
 c as (select text, size, unnest(string_split(text, '')) ch from texts)
 select text, size, sum(strokes)::bigint strokes from c join letters using (ch) group by text, size union all select 'dot', unnest([{", ".join(f"{d}::double" for d in DOT_LADDER)}]), 1"""

_NUMBER = "rtrim(rtrim(printf('%.6f', {}), '0'), '.')"
_TABLE = [x for name, aci, *_ in PASSES for x in ("0", "LAYER", "2", name, "70", "0", "62", str(aci), "6", "CONTINUOUS")]


def _lines(*values: str) -> str:
    return " || chr(13) || chr(10) || ".join(values)


def _texts(*values: str) -> str:
    return _lines(*(f"'{v}'" for v in values))


#: A file of the rings alone: header with the extents, tables, an entity a ring, end.
DXF = (
    """, box as (select min(x) x0, min(y) y0, max(x) x1, max(y) y1 from rings),
 pieces as (select feature_id, ring, string_agg("""
    + _lines(_texts("0", "VERTEX", "8", "DLF-04_cut_inner", "10"), _NUMBER.format("x"), "'20'", _NUMBER.format("y"), _texts("30", "0"))
    + """, chr(13) || chr(10) order by i) body from rings group by feature_id, ring)
 select 0 part, null::varchar layer, """
    + _lines(_texts("0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", "AC1009", "9", "$INSUNITS", "70", "4", "9", "$MEASUREMENT", "70", "1", "9", "$EXTMIN", "10"), _NUMBER.format("x0"), "'20'", _NUMBER.format("y0"),
             _texts("30", "0", "9", "$EXTMAX", "10"), _NUMBER.format("x1"), "'20'", _NUMBER.format("y1"),
             _texts("30", "0", "0", "ENDSEC", "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LTYPE", "70", "1", "0", "LTYPE", "2", "CONTINUOUS", "70", "0", "3", "Solid line", "72", "65", "73", "0", "40", "0", "0", "ENDTAB",
                    "0", "TABLE", "2", "LAYER", "70", str(len(PASSES)), *_TABLE, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"))
    + " as text from box union all select 1, 'DLF-04_cut_inner', "
    + _lines(_texts("0", "POLYLINE", "8", "DLF-04_cut_inner", "66", "1", "70", "1", "10", "0", "20", "0", "30", "0"), "body", _texts("0", "SEQEND", "8", "DLF-04_cut_inner"))
    + " from pieces union all select 9, null, "
    + _texts("0", "ENDSEC", "0", "EOF")
)

#: Pixels of 0.2 mm on a sheet 60 mm high: rings with a pen of 0.25 mm, dots of 0.5 mm filled; the darkest wins.
PIXELS = """, e as (select x ax, y ay, coalesce(lead(x) over w, first_value(x) over w) bx, coalesce(lead(y) over w, first_value(y) over w) "by" from rings window w as (partition by feature_id, ring order by i rows between unbounded preceding and unbounded following)),
 ink as (select 0.9::double grey, 0.625::double h, ax * 5 ax, (60 - ay) * 5 ay, bx * 5 bx, (60 - "by") * 5 "by" from e union all select 0.35, 2.5, x * 5, (60 - y) * 5, x * 5, (60 - y) * 5 from trees),
 near as (select *, unnest(generate_series(greatest(0, floor(least(ax, bx) - h))::bigint, floor(greatest(ax, bx) + h)::bigint)) px from ink),
 spot as (select *, unnest(generate_series(greatest(0, floor(least(ay, "by") - h))::bigint, floor(greatest(ay, "by") + h)::bigint)) py from near),
 f as (select *, case when ax = bx and ay = "by" then 0 else least(1, greatest(0, ((px + 0.5 - ax) * (bx - ax) + (py + 0.5 - ay) * ("by" - ay)) / (pow(bx - ax, 2) + pow("by" - ay, 2)))) end t from spot),
 hit as (select px, py, max(grey) grey from f where sqrt(pow(px + 0.5 - ax - t * (bx - ax), 2) + pow(py + 0.5 - ay - t * ("by" - ay), 2)) <= h group by px, py)
 select floor(255 * (1 - grey) + 0.5)::int grey, count(*) pixels from hit group by 1"""

#: A line a pass and one for the whole, over the sums of drawing_totals.
REPORT = "select coalesce(layer, '~') ord, coalesce(layer, 'whole drawing') || ': ' || paths || ' paths, ' || circles || ' circles, ' || vertices || ' vertices, ' || printf('%.0f', run_mm) || ' mm' line from ({totals})"

#: Rows of a square: half a burn inside its edges, no further apart than 0.3 mm.
SOLID = """, b as (select feature_id, ring, min(x) x0, max(x) x1, min(y) y0, max(y) y1, 0.3 * 1.15::double burn from rings group by feature_id, ring),
 n as (select *, ceil((y1 - y0 - burn) / 0.3)::bigint n from b), k as (select *, unnest(generate_series(0, n)) "row" from n)
 select feature_id, ring::int ring, "row"::int "row", round(y0 + burn / 2 + "row" * (y1 - y0 - burn) / n, 6) y, round(x1 - x0 - burn, 6) length from k"""

#: Findings on noise: photographs inside and outside, regions over 0.15, circles a stride apart, three cuts, trees on the sheet.
FINDINGS = """, f as (select max(r) + 1 nr from noise), p as (select gx between 0 and 64 and gy between 0 and nr inside from (select x - 654000.0::double gx, 7738000.0::double - y gy, nr from u, f)),
 g as (select r * 64 + c i, r, c, z::double z from noise where z > 0.15), e as (select a.i x, n.i y from g a join g n on (n.r = a.r and abs(n.c - a.c) = 1) or (n.c = a.c and abs(n.r - a.r) = 1)),
 root as (with recursive w as (select i, i root from g union select e.y, w.root from w join e on e.x = w.i where w.root < e.y) select i, min(root) root from w group by i),
 stride as (select nr, floor(greatest(nr, 64) / 40 + 0.5)::bigint s from f), range_ as (select min(z)::double lo, max(z)::double hi from noise),
 dot as (select (c + 0.5) * 5 x, (nr - r - 0.5) * 5 y, s * 2.5 * (0.08 + 0.92 * (z::double - lo) / (hi - lo)) m, nr from noise, stride, range_ where r % s = 7738000 % s and (c + 654000) % s = 0),
 whole as (select * from dot where x - m >= 0 and x + m <= 320 and y - m >= 0 and y + m <= nr * 5),
 cut as (select section, count(v) n, 8 / (max(v) - min(v)) exaggeration from v group by section)
 select stage, what, round(n::double, 4) n from (
  select 'raster' stage, 'cells' what, count(*) n from noise union all select 'raster', 'measured', count(z) from noise
  union all select 'photos', 'drawn', count(*) from p where inside union all select 'photos', 'outside', count(*) from p where not inside union all select 'photos', 'without a place', count(*) from photos where lat is null union all select 'photos', 'doubt in mm', 35
  union all select 'regions', 'regions', count(distinct root) from root union all select 'regions', 'area', count(*) from g union all select 'regions', 'mean', avg(z) from g union all select 'regions', 'rings', count(*) from (select * from ring where abs(area) >= 0.5)
  union all select 'symbols', 'circles', count(*) from whole union all select 'symbols', 'smallest', 2 * min(m) from whole union all select 'symbols', 'largest', 2 * max(m) from whole union all select 'symbols', 'dropped', (select count(*) from dot) - (select count(*) from whole)
  union all select 'sections', 'cuts', count(*) from cut union all select 'sections', 'breaks', 0 union all select 'sections', 'exaggeration', avg(exaggeration) from cut
  union all select 'features trees', 'drawn', count(*) from trees, f where x <= 64 and y <= nr union all select 'features trees', 'off the sheet', count(*) from trees, f where x > 64 or y > nr)"""

#: Over seg: paths are what segments link, and a station stands every two cells, the first after one.
STATIONS = """, ends as materialized (select "level", a_lo::bigint * 100000000 + a_hi a, b_lo::bigint * 100000000 + b_hi b, sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) d from seg),
 link as materialized (select "level", a, b from ends union all select "level", b, a from ends),
 walk("level", k, root) using key ("level", k) as (select "level", k, k from (select distinct "level", a k from link) union
  select l."level", l.b, min(w.root) from walk w join link l on l."level" = w."level" and l.a = w.k join recurring.walk now on now."level" = l."level" and now.k = l.b where w.root < now.root group by 1, 2),
 whole as (select e."level", root, sum(d) mm from ends e join walk w on w."level" = e."level" and w.k = e.a group by 1, 2)
 select "level", count(*) paths, sum(ceil(mm / 2 - 0.5))::bigint stations from whole group by 1"""
