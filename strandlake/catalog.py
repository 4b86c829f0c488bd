"""The library's queries over the given tables, and equivalent SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import faces as fc
from .operators import graph as gr
from .operators import growth as gw
from .operators import labels as lb
from .operators import matrix as mx
from .operators import paths as pt
from .operators import raster as rs
from .operators import spatial as sp
from .operators import stats as st
from .operators import voronoi as vo
from .plans import iterate
from .sources import fixtures as fx
from .streaming import monitor

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---- shared SQL
POINTS = """points as (select 0::bigint run_id, o_orderkey id, (2.0 * ((o_orderkey % 120) + 0.5 * ((o_orderkey // 120) % 2)))::double x,
  sqrt(3.0::double) * (o_orderkey // 120) y, ((o_custkey * 5) % 360)::int rotation from orders where (o_custkey * 7919 + o_orderkey * 104729) % 100 < 40)"""
EDGES = f"""{POINTS}, cells as (select id, x, y, floor(x / 2.04::double)::bigint cx, floor(y / 2.04::double)::bigint cy from points),
edges as (select a.id u, b.id v from cells a join (select id, x, y, cx + dx cx, cy + dy cy from cells, (values (-1), (0), (1)) s(dx), (values (-1), (0), (1)) t(dy)) b
  on a.cx = b.cx and a.cy = b.cy where a.id < b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.04::double * 2.04::double),
adj as (select u a, v b from edges union all select v, u from edges),
deg as (select id, count(b) degree from points left join adj on a = id group by id)"""
COMPS = f"""{EDGES}, reach(v, c) as (select id, id from points union select adj.b, reach.c from reach join adj on adj.a = reach.v),
comps as (select v id, min(c) comp from reach group by v)"""
DEVIATION = f"""{EDGES}, two as (select a id, min(b) lo, max(b) hi from adj group by a having count(*) = 2),
legs as (select t.id, p.x - l.x ax, p.y - l.y ay, h.x - p.x bx, h.y - p.y by_ from two t join points p on p.id = t.id join points l on l.id = t.lo join points h on h.id = t.hi),
dev as (select id, degrees(acos(greatest(-1.0::double, least(1.0::double, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)))))) deviation from legs)"""
SWEEP = f"""{COMPS}, walk0(v, c, d) as (select id, comp, 0 from comps where id = comp union select adj.b, c, d + 1 from walk0 join adj on adj.a = v where d < 175),
dist0 as (select v, c, min(d) d from walk0 group by v, c), far as (select c, arg_max(v, d * 1000000 - v) a from dist0 group by c),
walk1(v, c, d) as (select a, c, 0 from far union select adj.b, c, d + 1 from walk1 join adj on adj.a = v where d < 175),
dist1 as (select v, c, min(d) d from walk1 group by v, c), hops as (select c comp, max(d)::bigint hops from dist1 group by c)"""
STRANDS = f"{SWEEP}, strands as (select case comp % 4 when 0 then 'C2' when 1 then 'C4' when 2 then 'C5' else 'C15' end as label, hops len from hops where hops > 0)"
SEGMENTS = f"""{COMPS}, rings as (select comp from comps join deg using (id) group by comp having min(degree) = 2 and max(degree) = 2),
heads as (select a, b, false ring from adj join deg on id = a where degree <> 2 union all
  select a, min(b), true from adj join comps on comps.id = a join rings using (comp) where a = comp group by a),
way(a, b, ring, pos, prev, cur) as (select a, b, ring, 1, a, b from heads union all
  select w.a, w.b, ring, pos + 1, cur, n.b from way w join deg on deg.id = w.cur join adj n on n.a = w.cur where n.b <> w.prev and degree = 2 and not (ring and w.cur = w.a)),
ends as (select a, b, ring, max(pos) n, arg_max(cur, pos) last, arg_max(prev, pos) before from way group by a, b, ring),
kept as (select a, b from ends where ring or a < last or (a = last and b <= before)),
seg as (select a || '-' || b as seg, 0::bigint pos, a id from kept union all select a || '-' || b, pos::bigint, cur from way join kept using (a, b))"""
ALONG = f"""{SEGMENTS}, along as (select seg, pos, s.id, p.x, p.y, lead(s.id, 1) over w id1, lead(p.x, 1) over w x1, lead(p.y, 1) over w y1, lead(s.id, 2) over w id2, lead(p.x, 2) over w x2, lead(p.y, 2) over w y2
  from seg s join points p using (id) window w as (partition by seg order by pos)),
turns as (select *, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) step, case when id2 is not null then acos(greatest(-1.0::double, least(1.0::double, ((x1 - x) * (x2 - x1) + (y1 - y) * (y2 - y1)) / (sqrt((x1 - x) ** 2 + (y1 - y) ** 2) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2))))) end t from along)"""
FACES = f"""{COMPS}, he as (select a u, b v, a * 1000000 + b h, atan2(q.y - p.y, q.x - p.x) th, p.x * q.y - q.x * p.y cr from adj join points p on p.id = a join points q on q.id = b),
ord as (select u, v, coalesce(lag(v) over (partition by u order by th, v), last_value(v) over (partition by u order by th, v rows between unbounded preceding and unbounded following)) pv from he),
nxt as (select v * 1000000 + u h, u * 1000000 + pv n from ord), orbit(h, o) as (select h, h from nxt union select nxt.n, o from orbit join nxt using (h)),
lab as (select h, min(o) o from orbit group by h),
loops as (select o, o // 1000000 u, o % 1000000 v, count(*) size, 0.5::double * sum(cr) area from lab join he using (h) group by o)"""
CLOUD = "cloud as (select 0::bigint run_id, vec_id id, embedding[1]::double * 100 x, embedding[2]::double * 100 y, label % 4 grp from embeddings), box as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from cloud)"
AREAS = "areas as (select o_orderkey id, case o_custkey % 4 when 0 then 'C2' when 1 then 'C4' when 2 then 'C5' else 'C15' end as label, o_orderkey % 5 run, o_totalprice area from orders)"
MATRIX = """matrix as (select l_partkey % 360 r0, (l_partkey % 360 + l_linenumber * 15 + l_suppkey % 15) % 360 c0, sum(l_quantity) v from lineitem group by 1, 2),
down as (select (r0 // 5 + 1)::int r, (c0 // 5 + 1)::int c, sum(v) / 25 w from matrix group by 1, 2),
mass as (select r, c, w / sum(w) over () w from down), low as (select r, c, case when w <= 0.0005 then 0 else w end w from mass),
ends as (select max(w) hi, case when count(*) < 5184 then least(min(w), 0) else min(w) end lo from low), norm as (select r, c, case when hi > lo then (w - lo) / (hi - lo) else 0 end w from low, ends),
rowmass as (select r, sum(w) mass, greatest(sum(w) - 0.05::double, 0) ** 2 sharp from norm group by r)"""
BONDS = f"""bonds as (select (floor(((round_even((degrees(atan2(q.y - p.y, q.x - p.x)) + 360) % 360, 0) - p.rotation + 720) % 360) / 5) + 1)::int r,
  (floor(((round_even(degrees(atan2(p.y - q.y, p.x - q.x)), 0) - q.rotation + 1080) % 360) / 5) + 1)::int c, count(*) k
  from edges join points p on p.id = u join points q on q.id = v group by 1, 2)"""
CANDS = f"""{POINTS}, {MATRIX}, cand as (select id parent, id * 1000 + angle seq, angle::int angle, (((angle - rotation + 360) % 360) // 5 + 1)::int r, round(sharp, 9) p, x + 2 * cos(radians(angle)) x, y + 2 * sin(radians(angle)) y
  from points, range(0, 360, 5) t(angle), rowmass where rowmass.r = ((angle - rotation + 360) % 360) // 5 + 1 and round(sharp, 9) > 0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n, t in df.dtypes if t == "double"})  # no -0.0


def graph(s, d) -> tuple[DataFrame, DataFrame]:
    """The lattice and its contacts."""
    return fx.lattice(s, d), fx.lattice_edges(s, d)


def graph_with_components(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, e = fx.lattice(s, d), iterate.cut(fx.lattice_edges(s, d), "edges")
    return p, e, iterate.cut(gr.components(p, e), "comps")


def strands(s, d) -> DataFrame:
    b = pt.backbones(*graph_with_components(s, d), mode="geodesic").where("hops > 0")
    return b.select(F.expr("case comp % 4 when 0 then 'C2' when 1 then 'C4' when 2 then 'C5' else 'C15' end").alias("label"), F.col("hops").alias("len"))


def normal(s, d) -> DataFrame:
    return mx.normalized(mx.downsampled(fx.matrix(s, d)))


# ---- labels and files
INFER = "case when contains(file, 'hc5AF') then 'C5' when contains(file, 'wt2_newsep') then 'C2' when contains(file, 'hc15') then 'C15' when contains(file, 'c4_7') then 'C4' else coalesce(nullif(regexp_extract(file, '[_\\.](C\\d+)[_\\.]', 1), ''), 'Other') end"
FILES = "files as (select o_orderkey id, 'mono_' || case o_custkey % 5 when 0 then 'hc5AF' when 1 then 'wt2_newsep' when 2 then 'hc15' when 3 then 'c4_7' else 'x_C9_y' end || '_N' || o_orderkey || '.bin' as file, o_custkey seed from orders)"
query("q_infer_label", f"with {FILES} select id, {INFER} as label from files")(lambda s, d: lb.labelled(fx.file_names(s, d)).select("id", "label"))
query("q_first_files", f"with {FILES}, l as (select file, {INFER} as label from files) select label, file, row_number() over (partition by label order by file) rank from l qualify rank <= 5")(
    lambda s, d: lb.first_files(fx.file_names(s, d)).select("label", "file", F.col("rank").cast("long").alias("rank"))
)
query("q_keyword_files", f"with {FILES} select file from files where lower(file) like '%hc15%'")(lambda s, d: lb.with_keyword(fx.file_names(s, d), "HC15").select("file"))
query("q_state_names", f"with {FILES} select id, 'mono_' || regexp_replace(file, '\\.[^.]*$', '') || '_N' || id || '_seed' || seed || '_20240102_0304.bin' as name, substr(sha1('2024-01-02 03:04:05'), 1, 10) stamp from files")(
    lambda s, d: fx.file_names(s, d).select("id", lb.state_name(F.col("file"), F.col("id"), F.col("seed"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("name"), lb.short_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("stamp"))
)

# ---- matrix
query("q_w_downsample", f"with {MATRIX} select r, c, round(w, 6) w from down")(lambda s, d: rounded(mx.downsampled(fx.matrix(s, d))))
query("q_w_normalize", f"with {MATRIX} select r, c, round(w, 6) w from norm")(lambda s, d: rounded(normal(s, d)))
query("q_row_sharp_mass", f"with {MATRIX} select r, round(mass, 6) mass, round(sharp, 6) sharp from rowmass")(lambda s, d: rounded(mx.row_mass(normal(s, d))))
query("q_col_weights", f"with {MATRIX} select c, round(greatest(sum(greatest(w - 0.03::double, 0)), 2.220446049250313e-16), 6) weight from norm where r between 1 and 10 group by c")(
    lambda s, d: rounded(mx.column_weights(normal(s, d), list(range(1, 11))))
)
query("q_row_product", f"with {MATRIX} select r, round(product(w), 6) product from norm where r between 1 and 40 and w > 0.3 group by r")(lambda s, d: rounded(mx.row_product(normal(s, d).where("w > 0.3"), list(range(1, 41)))))
query("q_recompute_k", f"with {EDGES}, {BONDS} select 0::bigint run_id, r, c, k from bonds")(lambda s, d: mx.bond_counts(*graph(s, d)))
query("q_w_vs_k", f"with {EDGES}, {BONDS}, {MATRIX}, a as (select r, c, w / max(w) over () w from norm), b as (select r, c, k / (max(k) over ())::double k from bonds) select r, c, round(coalesce(w, 0), 6) w, round(coalesce(k, 0), 6) k from a full join b using (r, c)")(
    lambda s, d: rounded(mx.compared(normal(s, d), mx.bond_counts(*graph(s, d)).select("r", "c", "k")))
)
query("q_angle_bins", f"with {POINTS} select run_id, id, angle::int angle, (((angle - rotation + 360) % 360) // 5 + 1)::int bin from points, range(0, 360, 5) t(angle)")(lambda s, d: mx.relative_bins(fx.lattice(s, d)))
query("q_topk_candidates", f"with {CANDS} select 0::bigint run_id, parent, angle, r, round(p, 6) p, row_number() over (partition by parent order by p desc, angle) rank from cand qualify rank <= 40")(
    lambda s, d: rounded(mx.top_candidates(fx.lattice(s, d), mx.row_mass(normal(s, d))).select("run_id", "parent", "angle", "r", "p", F.col("rank").cast("long").alias("rank")))
)
query(
    "q_candidate_merge",
    f"with {CANDS}, top as (select * from cand qualify row_number() over (partition by parent order by p desc, angle) <= 40) select 0::bigint run_id, round_even(x / 0.05::double, 0)::bigint kx, round_even(y / 0.05::double, 0)::bigint ky, array_to_string(list_sort(list_distinct(list(r))), ',') as rows, arg_min(parent, seq) parent, round(case when count(*) = 1 then max(p) else greatest(sqrt(sum(p)), 2.220446049250313e-16) end, 6) p, count(*) n from top group by 1, 2, 3",
)(lambda s, d: rounded(mx.merged_candidates(mx.top_candidates(fx.lattice(s, d), mx.row_mass(normal(s, d)))).withColumn("rows", F.array_join("rows", ","))))

# ---- spatial
query("q_contact_edges", f"with {EDGES} select 0::bigint run_id, u, v from edges")(lambda s, d: fx.lattice_edges(s, d))
query("q_box_counts", f"with {POINTS} select run_id, floor(x / 10)::bigint + 1 bx, floor(y / 10)::bigint + 1 as by, count(*) n from points group by 1, 2, 3")(lambda s, d: sp.box_counts(fx.lattice(s, d)))
query("q_box_members", f"with {POINTS} select run_id, floor(x / 10)::bigint + 1 bx, floor(y / 10)::bigint + 1 as by, count(*) n, string_agg(id::varchar, ',' order by id) ids from points group by 1, 2, 3")(
    lambda s, d: sp.box_members(fx.lattice(s, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
)
query("q_first_edges", f"with {EDGES} select 0::bigint run_id, u, v from edges order by u, v limit 500")(lambda s, d: sp.first_edges(fx.lattice_edges(s, d), 500))
query("q_pair_checks", f"with {CLOUD}, near as (select a.id u, b.id v, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 d2 from cloud a join cloud b on a.id < b.id where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9) select 0::bigint run_id, u, v, round(d2, 6) d2, d2 <= 4 collides, d2 between (2 * 1.02::double * 0.98::double) ** 2 and (2 * 1.02::double) ** 2 touches from near")(
    lambda s, d: rounded(sp.pair_checks(fx.cloud(s, d), 3.0))
)
query(
    "q_remove_small_boxes",
    f"with {EDGES}, kept as (select *, row_number() over (order by id) new_id from (select id, x, y, count(*) over (partition by floor(x / 10), floor(y / 10)) n from points) where n >= 12) select 0::bigint run_id, a.new_id u, b.new_id v from edges join kept a on a.id = u join kept b on b.id = v",
)(lambda s, d: sp.without_small_boxes(*graph(s, d), least=12)[1])
query("q_seed_clearance", f"with {CLOUD} select run_id, id from cloud a where grp = 0 and not exists (select 1 from cloud b where b.grp <> 0 and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 4)")(
    lambda s, d: sp.far_from(fx.cloud(s, d).where("grp = 0"), fx.cloud(s, d).where("grp <> 0"), 2.0).select("run_id", "id")
)
query("q_nearest_neighbor", f"with {CLOUD} select a.run_id, a.id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) distance from cloud a join cloud b on a.id <> b.id group by 1, 2")(lambda s, d: rounded(sp.nearest_other(fx.cloud(s, d))))
query("q_bbox", f"with {CLOUD} select 0::bigint run_id, round(x0, 6) min_x, round(x1, 6) max_x, round(y0, 6) min_y, round(y1, 6) max_y from box")(lambda s, d: rounded(sp.bounding_box(fx.cloud(s, d))))
GRID = f"{CLOUD}, grid as (select floor((x - x0) / 10)::bigint ix, floor((y - y0) / 10)::bigint iy, count(*) n from cloud, box where floor((x - x0) / 10) < floor((x1 - x0) / 10) and floor((y - y0) / 10) < floor((y1 - y0) / 10) group by 1, 2)"
query("q_grid_density", f"with {GRID} select 0::bigint run_id, ix, iy, n from grid")(lambda s, d: sp.grid_density(fx.cloud(s, d), 10.0))
query(
    "q_density_stats",
    f"with {GRID}, t as (select (floor((x1 - x0) / 10) * floor((y1 - y0) / 10))::bigint bins from box), g as (select count(*) filled, sum(n)::double s, sum(n * n)::double q, max(n) max_n, min(n) min_n, avg(n) mf, stddev_samp(n) sf from grid) select 0::bigint run_id, bins, filled, round(100 * (1 - filled / bins::double), 6) sparsity_pct, round(s / bins, 6) mean_all, round(sqrt((q - s * s / bins) / (bins - 1)), 6) std_all, round(mf, 6) mean_filled, round(sf, 6) std_filled, max_n, min_n from t, g",
)(lambda s, d: sp.density_stats(fx.cloud(s, d), 10.0))
query("q_density_grid", f"with {CLOUD} select 0::bigint run_id, least(floor((x - x0) / ((x1 - x0) / 400)), 399)::bigint ix, least(floor((y - y0) / ((y1 - y0) / 400)), 399)::bigint iy, count(*) n from cloud, box group by 1, 2, 3")(
    lambda s, d: sp.histogram_2d(fx.cloud(s, d))
)
query("q_transform_coords", f"with {CLOUD} select run_id, id, round((x - (x0 + x1) / 2 + 5) * (1 / (greatest(x1 - x0, y1 - y0) + 10)), 6) x, round((y - (y0 + y1) / 2 + 5) * (1 / (greatest(x1 - x0, y1 - y0) + 10)), 6) y from cloud, box")(
    lambda s, d: rounded(sp.transform(fx.cloud(s, d), "center", 5.0, "fit"))
)
query(
    "q_corner_occupancy",
    f"with {CLOUD}, s as (select *, 0.05::double * least(x1 - x0, y1 - y0) m, 0.24::double * least(x1 - x0, y1 - y0) w from cloud, box), k as (select x between x1 - m - w and x1 - m r, x between x0 + m and x0 + m + w l, y between y1 - m - w and y1 - m t, y between y0 + m and y0 + m + w b from s), n as (select count(*) filter (t and r) tr, count(*) filter (t and l) tl, count(*) filter (b and r) br, count(*) filter (b and l) bl from k) select 0::bigint run_id, *, case least(tr, tl, br, bl) when tr then 'tr' when tl then 'tl' when br then 'br' else 'bl' end corner from n",
)(lambda s, d: sp.corner_occupancy(fx.cloud(s, d)))
query(
    "q_pc1_extremes",
    f"with {CLOUD}, m as (select avg(x) mx, avg(y) my, 0.5::double * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) a from cloud), t as (select id, round((x - mx) * cos(a) + (y - my) * sin(a), 9) t, a from cloud, m) select 0::bigint run_id, round(min(a), 6) angle, (select id from t order by t.t, id limit 1) low_id, (select id from t order by t.t desc, id limit 1) high_id, round(max(t.t) - min(t.t), 6) extent from t",
)(lambda s, d: sp.principal_axis(fx.cloud(s, d)))
query(
    "q_scale_ticks",
    f"with {CLOUD}, n as (select greatest(x1 - x0, y1 - y0) * 1.55 nm from box), u as (select *, case when nm >= 1e6 then 1e6 when nm >= 1e3 then 1e3 else 1 end::double divisor from n), b as (select *, nm / divisor / 8 raw, 10.0::double ** floor(log10(nm / divisor / 8)) base from u), t as (select *, case when raw <= 0 then 1 else base * case when raw / base <= 1 then 1 when raw / base <= 2 then 2 when raw / base <= 5 then 5 else 10 end end step from b) select 0::bigint run_id, case when nm >= 1e6 then 'mm' when nm >= 1e3 then 'µm' else 'nm' end unit, divisor, round(step, 6) step, round(ceil(nm / divisor / step) * step, 6) last_tick from t",
)(lambda s, d: sp.scale_ticks(fx.cloud(s, d)))
query(
    "q_tick_places",
    f"with {CLOUD}, n as (select greatest(x1 - x0, y1 - y0) * 1.55 nm from box), u as (select nm / case when nm >= 1e6 then 1e6 when nm >= 1e3 then 1e3 else 1 end::double span from n), b as (select *, span / 8 raw, 10.0::double ** floor(log10(span / 8)) base from u), t as (select *, base * case when raw / base <= 1 then 1 when raw / base <= 2 then 2 when raw / base <= 5 then 5 else 10 end step from b) select 0::bigint run_id, i::int i, round(i * step, 6) tick from t, range(0, 100) r(i) where i <= ceil(span / step)",
)(lambda s, d: rounded(sp.tick_places(fx.cloud(s, d))))
query("q_stride_sample", f"with {POINTS} select run_id, id from points qualify (row_number() over (order by id) - 1) % 7 = 0")(lambda s, d: sp.stride_sample(fx.lattice(s, d), 7).select("run_id", "id"))
query("q_frontier", f"with {POINTS}, s as (select o_id // 1200 run_id, o_id id from (select id o_id from points)) select run_id, id from s qualify id > max(id) over (partition by run_id) - 40")(lambda s, d: sp.frontier(fx.strips(fx.lattice(s, d))).select("run_id", "id"))
query("q_voronoi")(lambda s, d: rounded(vo.voronoi_areas(fx.cloud(s, d))))

# ---- graph
STORED = f"{EDGES}, stored as (select u, v from edges where (u + v) % 7 <> 0 union select a.id, b.id from points a join points b on b.id = a.id + 5 where a.id % 100 < 10)"


def _edge_diff(s, d):
    p, e = graph(s, d)
    a, b = p.select("run_id", F.col("id").alias("u")).where("u % 100 < 10"), p.select("run_id", F.col("id").alias("v"), (F.col("id") - 5).alias("u"))
    return gr.edge_difference(e.where("(u + v) % 7 <> 0").unionByName(a.join(b, ["run_id", "u"])), e)


query("q_edge_diff", f"with {STORED} select 0::bigint run_id, u, v, 'extra' side from (select * from stored except select * from edges) union all select 0, u, v, 'missing' from (select * from edges except select * from stored)")(_edge_diff)
query("q_edge_gaps", f"with {STORED}, diff as (select u, v, 'extra' side from (select * from stored except select * from edges) union all select u, v, 'missing' from (select * from edges except select * from stored)) select 0::bigint run_id, u, v, side, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) d, 2.0::double two_radii, 2.04::double contact from diff join points p on p.id = u join points q on q.id = v")(
    lambda s, d: rounded(gr.edge_gaps(fx.lattice(s, d), _edge_diff(s, d)))
)
query("q_dedup_edges", "select distinct 0::bigint run_id, least(l_partkey % 1000, l_suppkey) u, greatest(l_partkey % 1000, l_suppkey) v from lineitem where l_partkey % 1000 <> l_suppkey")(
    lambda s, d: gr.dedup_edges(fx.table(s, d, "lineitem").selectExpr("0L as run_id", "l_partkey % 1000 as u", "l_suppkey as v"))
)
query("q_degree", f"with {EDGES} select 0::bigint run_id, id, degree from deg")(lambda s, d: gr.degrees(*graph(s, d)))
query("q_degree_hist", f"with {EDGES} select 0::bigint run_id, degree, count(*) n from deg group by degree")(lambda s, d: gr.degree_histogram(*graph(s, d)))
query("q_overconnected", f"with {EDGES} select 0::bigint run_id, id, degree from deg where degree > 4")(lambda s, d: gr.over_connected(*graph(s, d), most=4))
query("q_turn_deviation", f"with {DEVIATION} select 0::bigint run_id, id, round(deviation, 4) deviation from dev")(lambda s, d: rounded(gr.turn_deviations(*graph(s, d)), 4))
query("q_turning_nodes", f"with {DEVIATION} select 0::bigint run_id, id from dev where round(deviation, 6) >= 20")(lambda s, d: gr.turning_nodes(*graph(s, d)).select("run_id", "id"))
query("q_turn_hist", f"with {DEVIATION}, r as (select round(deviation, 4) v from dev), b as (select min(v) lo, max(v) hi from r) select least(floor((v - lo) / ((hi - lo) / 30)), 29)::int bin, count(*) n from r, b group by 1")(
    lambda s, d: st.histogram(rounded(gr.turn_deviations(*graph(s, d)), 4), "deviation")
)
query("q_node_roles", f"with {DEVIATION} select 0::bigint run_id, deg.id, case when degree = 0 then 'isolated' when degree = 1 then 'leaf' when degree >= 3 then 'junction' when round(deviation, 6) >= 15 then 'turning' else 'interim_straight' end as role from deg left join dev on dev.id = deg.id")(
    lambda s, d: gr.node_roles(*graph(s, d))
)
ROLES = f"{DEVIATION}, roles as (select deg.id, case when degree = 0 then 'isolated' when degree = 1 then 'leaf' when degree >= 3 then 'junction' when round(deviation, 6) >= 15 then 'turning' else 'interim_straight' end as role from deg left join dev on dev.id = deg.id)"
query("q_role_counts", f"with {ROLES} select 0::bigint run_id, role, count(*) n from roles group by role")(lambda s, d: gr.role_counts(*graph(s, d)))
query("q_end_nodes", f"with {EDGES} select 0::bigint run_id, id, case degree when 1 then 'endpoint' else 'junction' end kind from deg where degree = 1 or degree >= 3")(lambda s, d: gr.end_nodes(*graph(s, d)))
query("q_components", f"with recursive {COMPS} select 0::bigint run_id, id, comp from comps")(lambda s, d: gr.components(*graph(s, d)))
query("q_bfs_dist", f"with recursive {SWEEP} select 0::bigint run_id, c comp, v id, d::bigint dist from dist0")(lambda s, d: pt.distances(*graph_with_components(s, d)))
query("q_geodesic_len", f"with recursive {SWEEP} select 0::bigint run_id, comp, hops from hops")(lambda s, d: pt.backbones(*graph_with_components(s, d), mode="geodesic").select("run_id", "comp", "hops"))
query("q_longest_strand", f"with recursive {STRANDS} select label, max(len) longest from strands group by label")(lambda s, d: strands(s, d).groupBy("label").agg(F.max("len").alias("longest")))
query("q_strand_hist", f"with recursive {STRANDS} select label, len, count(*) n, round(count(*) / (sum(count(*)) over (partition by label))::double, 6) density from strands group by label, len")(lambda s, d: rounded(st.integer_histogram(strands(s, d))))
query(
    "q_strand_cdf",
    f"with recursive {STRANDS}, e as (select min(len) lo, max(len) hi from strands), g as (select label, unnest(range(lo, hi + 1)) len from (select distinct label from strands), e), k as (select label, len, count(*) k from strands group by 1, 2) select label, len, round(1 - sum(coalesce(k, 0)) over (partition by label order by len) / (sum(coalesce(k, 0)) over (partition by label))::double, 6) f from g left join k using (label, len)",
)(lambda s, d: rounded(st.integer_cdf(strands(s, d), complement=True)))
CORE = EDGES + ", e0 as (select u, v from edges), " + ", ".join(f"e{i} as materialized (select u, v from e{i - 1} where u in (select x from (select u x from e{i - 1} union all select v from e{i - 1}) group by x having count(*) >= 2) and v in (select x from (select u x from e{i - 1} union all select v from e{i - 1}) group by x having count(*) >= 2))" for i in range(1, 41))
query("q_two_core", f"with {CORE} select 0::bigint run_id, u, v from e40")(lambda s, d: gr.two_core(fx.lattice_edges(s, d)))
query("q_segments", f"with recursive {SEGMENTS} select 0::bigint run_id, seg, pos, id from seg")(lambda s, d: gr.segments(fx.lattice_edges(s, d)))
query("q_segments_by_component", f"with recursive {SEGMENTS} select 0::bigint run_id, comp, seg, pos, id from seg join comps using (id)")(lambda s, d: (lambda p, e, c: gr.segments_by_component(e, c))(*graph_with_components(s, d)))
query("q_segment_length", f"with recursive {ALONG} select 0::bigint run_id, seg, count(*) nodes, round(sum(step), 6) length from turns group by seg having sum(step) > 1e-9")(lambda s, d: rounded(gr.segment_lengths(fx.lattice(s, d), gr.segments(fx.lattice_edges(s, d)))))
query(
    "q_segment_curvature",
    f"with recursive {ALONG} select 0::bigint run_id, seg, round(coalesce(sum(t), 0), 4) total, round(case when count(id2) > 0 then coalesce(sum(t), 0) / count(id2) else 0 end, 4) mean, round(coalesce(sum(t), 0) / sum(step), 4) density from turns group by seg",
)(lambda s, d: rounded(gr.segment_curvature(fx.lattice(s, d), gr.segments(fx.lattice_edges(s, d))), 4))


def _flags(s, d):
    """Segments, and their inner nodes that turn by 60 degrees or more."""
    p, seg = fx.lattice(s, d), iterate.cut(gr.segments(fx.lattice_edges(s, d)), "segments")
    return p, seg, gr.segment_turnings(p, seg, 50.0, gap=1)


query(
    "q_refine_segments",
    f"with recursive {ALONG}, f as (select seg, pos + 1 pos from turns where id2 is not null and round(degrees(t), 6) >= 50), m as (select seg, pos, id, (f.pos is not null)::int flag from seg left join f using (seg, pos)), r as (select *, sum(flag) over (partition by seg order by pos) piece from m) select 0::bigint run_id, seg, piece::bigint piece, pos, id from r union all select 0, seg, (piece - 1)::bigint, pos, id from r where flag = 1",
)(lambda s, d: (lambda p, seg, f: gr.refined_segments(seg, f))(*_flags(s, d)))
query(
    "q_length_density",
    f"with recursive {ALONG}, len as (select sum(step) * 1.55::double nm from turns group by seg having sum(step) > 1e-9), b as (select min(nm) - 6 lo, (max(nm) - min(nm) + 12) / 127 h from len) select g::int g, round(lo + g * h, 6) x, round(sum(exp(-0.5 * ((lo + g * h - nm) / 1.5) ** 2)) / (count(*) * 1.5 * sqrt(2 * pi())), 6) density from len, b, range(128) t(g) group by g, lo, h having lo + g * h >= 0",
)(lambda s, d: rounded(st.length_density(gr.segment_lengths(fx.lattice(s, d), gr.segments(fx.lattice_edges(s, d))))))
query(
    "q_segment_turnings",
    f"with recursive {ALONG}, flag as (select seg, pos + 1 pos, id1 id, row_number() over (partition by seg order by pos) k from turns where id2 is not null and round(degrees(t), 6) >= 50), scan(seg, k, last) as (select seg, k, pos from flag where k = 1 union all select f.seg, f.k, case when f.pos - last >= 2 then f.pos else last end from scan join flag f on f.seg = scan.seg and f.k = scan.k + 1) select 0::bigint run_id, seg, pos, id from flag join scan using (seg, k) where last = pos",
)(lambda s, d: gr.segment_turnings(fx.lattice(s, d), gr.segments(fx.lattice_edges(s, d)), 50.0))


def _forest(s, d):
    p = fx.lattice(s, d)
    f = iterate.cut(gr.spanning_forest(sp.contact_pairs(p, 2.04).withColumn("w", F.sqrt("d2"))), "forest")
    comps = gr.components(p, f.select("run_id", "u", "v"))
    return f.join(comps.select("run_id", F.col("id").alias("u"), "comp"), ["run_id", "u"]).groupBy("run_id", "comp").agg(F.round(F.sum("w"), 6).alias("weight"), F.count("*").alias("edges"))


query("q_msf_weight", f"with recursive {COMPS} select 0::bigint run_id, comp, 2.0::double * (count(*) - 1) weight, count(*) - 1 edges from comps group by comp having count(*) > 1")(_forest)
query(
    "q_min_forest",
    f"with recursive {EDGES}, ranked as (select u, v, ((u * 37 + v * 13) % 997 + 1)::double w, row_number() over (order by (u * 37 + v * 13) % 997, u, v) k from edges), ways as (select u a, v b, k from ranked union all select v, u, k from ranked), lighter(k0, x) as (select k, u from ranked union select k0, b from lighter join ways on a = x and k < k0) select 0::bigint run_id, u, v, w from ranked where not exists (select 1 from lighter where k0 = k and x = ranked.v)",
)(lambda s, d: gr.spanning_forest(fx.lattice_edges(s, d).withColumn("w", ((F.col("u") * 37 + F.col("v") * 13) % 997 + 1).cast("double"))))
query(
    "q_max_tree",
    f"with recursive {EDGES}, ranked as (select u, v, ((u * 31 + v * 17) % 101)::double w, row_number() over (order by (u * 31 + v * 17) % 101 desc, u, v) k from edges), ways as (select u a, v b, k from ranked union all select v, u, k from ranked), heavier(k0, x) as (select k, u from ranked union select k0, b from heavier join ways on a = x and k < k0) select 0::bigint run_id, u, v, w from ranked where not exists (select 1 from heavier where k0 = k and x = ranked.v)",
)(lambda s, d: gr.spanning_forest(fx.lattice_edges(s, d).withColumn("w", ((F.col("u") * 31 + F.col("v") * 17) % 101).cast("double")), largest=True))
query("q_backbone")(lambda s, d: pt.backbone_nodes(*graph_with_components(s, d)))
query("q_turn_aware")(lambda s, d: pt.turn_aware_costs(*graph_with_components(s, d)))
query("q_turn_aware_length")(lambda s, d: pt.turn_aware_costs(*graph_with_components(s, d), by_length=True))
query("q_longest_paths")(lambda s, d: pt.longest_paths(*graph_with_components(s, d)))

# ---- faces
query("q_faces", f"with recursive {FACES} select 0::bigint run_id, u, v, size, round(area, 6) + 0.0::double area from loops")(lambda s, d: rounded(fc.loops(*graph(s, d))[1].select("run_id", "u", "v", "size", "area")))
ENCLOSED = f"{FACES}, outer_ as (select o from loops order by -round(abs(area), 6), u, v limit 1)"
query("q_face_areas", f"with recursive {ENCLOSED} select 0::bigint run_id, u, v, round(abs(area), 6) area from loops where o not in (select o from outer_)")(lambda s, d: rounded(fc.enclosed(fc.loops(*graph(s, d))[1]).select("run_id", "u", "v", "area")))
query("q_areas_over_floor", f"with recursive {ENCLOSED} select 0::bigint run_id, u, v, round(abs(area), 6) area from loops where o not in (select o from outer_) and abs(area) >= 5")(lambda s, d: rounded(fc.face_areas(*graph(s, d))))
query("q_top_faces", f"with recursive {ENCLOSED}, top as (select u, v, abs(area) area from loops where o not in (select o from outer_) order by round(abs(area), 6) desc, u, v limit 50) select 0::bigint run_id, u, v, round(area, 6) area, round((area - min(area) over ()) / greatest(max(area) over () - min(area) over (), 2.220446049250313e-16), 6) shade from top")(
    lambda s, d: rounded(fc.top_faces(fc.enclosed(fc.loops(*graph(s, d))[1])))
)


def _centroids(s, d):
    p, e = graph(s, d)
    named, found = fc.loops(p, e)
    return rounded(fc.centroids(p, named, found.where("area > 1e-9")).select("run_id", "u", "v", "cx", "cy"))


query("q_face_centroid", f"with recursive {FACES} select 0::bigint run_id, l.u, l.v, round(sum((p.x + q.x) * cr) / (6 * area), 6) cx, round(sum((p.y + q.y) * cr) / (6 * area), 6) cy from loops l join lab using (o) join he using (h) join points p on p.id = he.u join points q on q.id = he.v where area > 1e-9 group by l.u, l.v, area")(_centroids)
NEST = f"""{FACES}, plus_ as (select l.*, comp from loops l join comps on comps.id = l.u where area > 1e-9),
ray as (select s.o s, t.o t, count(*) n from plus_ s join points p on p.id = s.u join plus_ t on t.comp <> s.comp and t.area > s.area + 1e-9 join lab on lab.o = t.o join he using (h) join points a on a.id = he.u join points b on b.id = he.v
  where (a.y > p.y) <> (b.y > p.y) and p.x < (b.x - a.x) * (p.y - a.y) / (b.y - a.y) + a.x group by 1, 2),
par as (select s, arg_min(struct_pack(pu := t2.u, pv := t2.v), struct_pack(a := t2.area, u := t2.u, v := t2.v)) p from ray join plus_ t2 on t2.o = t where n % 2 = 1 group by s),
nest as (select o, u, v, area, p.pu parent_u, p.pv parent_v from plus_ left join par on s = o)"""


def _nesting(s, d):
    p, e, c = graph_with_components(s, d)
    named, found = fc.loops(p, e)
    return fc.nesting(p, named, found, c)


query("q_face_nesting", f"with recursive {NEST} select 0::bigint run_id, u, v, round(area, 6) area, parent_u, parent_v from nest")(lambda s, d: rounded(_nesting(s, d).select("run_id", "u", "v", "area", "parent_u", "parent_v")))
query(
    "q_net_area",
    f"with recursive {NEST}, down_(u, v, tu, tv, signed, k) as (select u, v, u, v, area, 1 from nest where parent_u is null union all select n.u, n.v, tu, tv, n.area * -k, -k from down_ d join nest n on n.parent_u = d.u and n.parent_v = d.v) select 0::bigint run_id, tu u, tv v, round(sum(signed), 6) net from down_ group by tu, tv",
)(lambda s, d: rounded(fc.net_areas(_nesting(s, d))))

# ---- distributions
query("q_face_cdf", f"with {AREAS} select label, id, round(area, 6) area, round(row_number() over (partition by label order by area, id) / (count(*) over (partition by label))::double, 6) cdf from areas where area >= 5")(lambda s, d: rounded(st.count_cdf(fx.areas(s, d), 5.0)))
query("q_face_area_cdf", f"with {AREAS} select label, id, round(area, 6) area, round(sum(area) over (partition by label order by area, id rows unbounded preceding) / sum(area) over (partition by label), 6) share from areas where area >= 5")(lambda s, d: rounded(st.area_cdf(fx.areas(s, d), 5.0)))
ECDF = f"""{AREAS}, lim as (select log10(min(area)) lo, (log10(max(area)) - log10(min(area))) / 499 step from areas),
binned as (select label, run, least(greatest(ceil(round((log10(area) - lo) / step, 9)), 0), 499)::int g, count(*) k from areas, lim group by 1, 2, 3),
ecdf as (select label, run, g, 10.0::double ** (lo + g * step) x, sum(coalesce(k, 0)) over (partition by label, run order by g) / (sum(coalesce(k, 0)) over (partition by label, run))::double f from (select distinct label, run from areas) cross join range(500) t(g) cross join lim left join binned using (label, run, g))"""
query("q_ecdf_log_grid", f"with {ECDF} select label, run, g::int g, round(x, 3) x, round(f, 6) f from ecdf")(lambda s, d: st.ecdf_on_log_grid(fx.areas(s, d)).withColumns({"x": F.round("x", 3), "f": F.round("f", 6)}))
query("q_cdf_band", f"with {ECDF} select label, g::int g, round(avg(f), 6) mean_f, round(stddev_samp(f), 6) std_f from ecdf group by 1, 2")(lambda s, d: rounded(st.cdf_band(st.ecdf_on_log_grid(fx.areas(s, d)))))
query(
    "q_box_stats",
    f"with {AREAS}, a as (select label, area * 1e-6::double a from areas), t as (select quantile_cont(a, 0.99) top from a), c as (select label, least(a, top) a from a, t) select label, round(quantile_cont(a, 0.05), 6) low, round(quantile_cont(a, 0.25), 6) q1, round(quantile_cont(a, 0.5), 6) median, round(quantile_cont(a, 0.75), 6) q3, round(quantile_cont(a, 0.95), 6) high from c group by label",
)(lambda s, d: rounded(st.box_stats(fx.areas(s, d))))
query(
    "q_box_iqr",
    f"with {AREAS}, q as (select label, quantile_cont(area, 0.25) q1, quantile_cont(area, 0.5) median, quantile_cont(area, 0.75) q3 from areas group by label), i as (select *, area between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1) inside from areas join q using (label)) select label, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3, round(min(area) filter (inside), 6) low, round(max(area) filter (inside), 6) high, count(*) filter (not inside) outliers from i group by label, i.q1, i.median, i.q3",
)(lambda s, d: rounded(st.box_iqr(fx.areas(s, d))))
query("q_area_hist", f"with {AREAS}, b as (select min(area) lo, max(area) hi from areas) select label, least(floor((area - lo) / ((hi - lo) / 30)), 29)::int bin, count(*) n from areas, b group by 1, 2")(lambda s, d: st.histogram(fx.areas(s, d), "area", 30, ["label"]))
query(
    "q_kde",
    f"with {AREAS}, b as (select min(area) lo, (max(area) - min(area)) / 63 step from areas) select label, g::int g, round(lo + g * step, 3) x, round(sum(exp(-0.5 * ((lo + g * step - area) / 20000) ** 2)) / (count(*) * 20000 * sqrt(2 * pi())), 9) density from areas, b, range(64) t(g) group by label, g, lo, step",
)(lambda s, d: st.kernel_density(fx.areas(s, d), "area", 20000.0, 64).withColumns({"x": F.round("x", 3), "density": F.round("density", 9)}))
LOG = "log as (select event_id, ts, case event_type when 'error' then -4 when 'click' then -2 when 'view' then -6 when 'signup' then -3 else 1 end::int code from events)"
query("q_reject_counts", f"with {LOG} select code, count(*) n from log group by code")(lambda s, d: st.reject_counts(fx.placement_log(s, d)))
query("q_reject_windows", f"with {LOG} select date_trunc('hour', ts) window_start, code, count(*) n from log group by 1, 2")(lambda s, d: monitor.windowed_rejections(fx.placement_log(s, d)))

# ---- raster
PIXELS = "pixels as (select o_orderkey // 120 as row, o_orderkey % 120 as col, case when (o_custkey * 7919 + o_orderkey * 104729) % 100 < 40 then 20 else 200 end gray from orders), dark as (select row, col from pixels where gray < 50)"
query("q_dilate", f"with {PIXELS}, s as (select max(row) r, max(col) c from pixels) select distinct 0::bigint img, row + a as row, col + b as col from dark, s, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b) where row + a between 0 and r and col + b between 0 and c")(
    lambda s, d: rs.dilated(rs.dark(fx.pixels(s, d)), rs.image_size(fx.pixels(s, d)))
)
query(
    "q_image_islands",
    f"with recursive {PIXELS}, size as (select max(row) r, max(col) c, count(*) k from pixels), n as (select distinct (row + a) * 1000 + col + b id, row + a as row, col + b as col from dark, size, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b) where row + a between 0 and r and col + b between 0 and c), adj as (select a.id a, b.id b from (select id, row + i as row, col + j as col from n, (values (-1), (0), (1)) x(i), (values (-1), (0), (1)) y(j)) a join n b using (row, col) where a.id <> b.id), reach(v, c) using key (v) as (select id, id from n union (select adj.a, min(reach.c) from reach join adj on adj.b = reach.v join recurring.reach old on old.v = adj.a where reach.c < old.c group by adj.a)), isl as (select c, count(*) k from reach group by c) select 0::bigint img, round(sum(k) / (select k from size)::double, 6) density, count(*) islands, max(k) max_area, round(avg(k), 6) mean_area from isl",
)(lambda s, d: rs.island_stats(fx.pixels(s, d)))


# ---- growth
def grown(s, d, target: int = 40) -> DataFrame:
    """A run for every supplier, grown from the table's interaction matrix."""
    runs = fx.table(s, d, "supplier").selectExpr("s_suppkey as run_id", "s_suppkey * 101 + 101 as seed", f"cast({target} as bigint) as n_target")
    return iterate.cut(gw.grow(runs, gw.weights_array(normal(s, d))), "growth")


query("q_growth")(lambda s, d: gw.monomers(grown(s, d)))
query("q_growth_bonds")(lambda s, d: (lambda g: mx.bond_counts(gw.monomers(g), gw.bonds(g)))(grown(s, d)))
query("q_growth_rejections")(lambda s, d: gw.rejections(grown(s, d)))
