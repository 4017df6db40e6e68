"""Registered queries of the scene operators and the SQL that recomputes each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetrack.functions import masks as M
from scenetrack.operators import histograms as H
from scenetrack.operators import objects as O
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.operators import tracking as T
from scenetrack.plans import sql as Q
from scenetrack.session import cut
from scenetrack.sources import views as V
from scenetrack.streaming import windows as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(*names: str, digits: int = 6):
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]


def rsql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n},{digits})+0.0 as {n}" for n in names)


RUN = ("row", "c0", "c1")
RUN_SQL = '"row"::bigint as "row", c0::bigint as c0, c1::bigint as c1'
BASE = (Q.PX, Q.mask("m"), Q.runs("r", "m"))
C4 = (*BASE, Q.components("lr", "r"))
C8 = (*BASE, Q.components("lr", "r", 1))


def base(spark, d):
    return R.runs_of(V.mask(spark, d))


def frame(spark, d):
    return R.kept(R.frame_of(V.px_embed(spark, d).select("scene_id", "row", "col")))


def labelled(spark, d):
    return R.components(base(spark, d))


# -- runs and components ---------------------------------------------------------------------------------------------


@query(Q.query(*BASE, f"select {RUN_SQL} from r"))
def mask_runs(spark, d):
    return base(spark, d).select(*big(*RUN))


@query(Q.query(*C4, f"select {RUN_SQL}, label from lr"))
def components4(spark, d):
    return labelled(spark, d).select(*big(*RUN, "label"))


@query(Q.query(*C8, f"select {RUN_SQL}, label from lr"))
def components8(spark, d):
    return R.components(base(spark, d), 8).select(*big(*RUN, "label"))


@query(Q.query(*C4, "select dense_rank() over (order by label)::bigint as label, sum(c1-c0+1)::bigint as area from lr group by lr.label"))
def relabel(spark, d):
    return R.sizes(O.relabel(labelled(spark, d))).select(*big("label", "area"))


@query(Q.query(*C4, "select label, sum(c1-c0+1)::bigint as area from lr group by label having sum(c1-c0+1) between 4 and 100"))
def area_filter(spark, d):
    return R.sizes(R.keep_sizes(labelled(spark, d), 4, 100)).select(*big("label", "area"))


@query(Q.query(*C4, f"select {RUN_SQL}, label from lr where label = (select label from lr group by label order by sum(c1-c0+1) desc, label desc limit 1)"))
def largest_component(spark, d):
    return R.largest(labelled(spark, d)).select(*big(*RUN, "label"))


BG = (Q.PX, Q.mask("m"), Q.background("g", "m"), Q.runs("gr", "g"), Q.components("lg", "gr"))
EDGE = 'select label from lg, fr where "row"=0 or "row"=height-1 or c0=0 or c1=width-1'


def union_sql(holes: str) -> tuple[str, str, str]:
    return (Q.pixels("hp", f"({holes})"), 'al as (select "row",col from m union select "row",col from hp)', Q.runs("ar", "al"))


@query(Q.query(*BG, *union_sql(f"select * from lg where label not in ({EDGE})"), f"select {RUN_SQL} from ar"))
def fill_holes(spark, d):
    return R.fill_holes(base(spark, d), frame(spark, d)).select(*big(*RUN))


@query(Q.query(*BG, *union_sql("select * from lg where label in (select label from lg group by label having sum(c1-c0+1) between 1 and 5)"), f"select {RUN_SQL} from ar"))
def hole_fill_by_size(spark, d):
    return R.fill_by_size(base(spark, d), frame(spark, d), 1, 5).select(*big(*RUN))


@query(Q.query(*C4, Q.mask("k", 1350), Q.pixels("op", "lr"), f'select {RUN_SQL}, label from lr where label in (select label from op join k on op."row"=k."row" and op.col=k.col)'))
def reconstruct_binary(spark, d):
    marker = R.runs_of(V.mask(spark, d, 1350))
    return R.reconstruct(base(spark, d), marker).select(*big(*RUN, "label"))


@query(Q.query(*C4, f'select {RUN_SQL}, label from lr where label not in (select label from lr, fr where "row"=0 or "row"=height-1 or c0=0 or c1=width-1)'))
def border_clear(spark, d):
    return R.clear_border(base(spark, d), frame(spark, d)).select(*big(*RUN, "label"))


# -- morphology ------------------------------------------------------------------------------------------------------


def element_sql(name: str, element) -> str:
    return f"{name}(dr,dc) as (values " + ",".join(f"({dr},{dc})" for dr, lo, hi in element for dc in range(lo, hi + 1)) + ")"


def dilate_sql(name: str, source: str, element: str) -> str:
    return f'{name} as (select distinct p."row"+o.dr as "row", p.col+o.dc as col from {source} p, {element} o, fr where p."row"+o.dr between 0 and height-1 and p.col+o.dc between 0 and width-1)'


def erode_sql(name: str, source: str, element: str) -> tuple[str, ...]:
    return (Q.background(f"{name}_g", source), dilate_sql(f"{name}_d", f"{name}_g", element), Q.background(name, f"{name}_d"))


MASK = (Q.PX, Q.mask("m"))
BOX1 = element_sql("b1", R.box(1))
DISK2 = element_sql("d2", R.disk(2))


@query(Q.query(*MASK, DISK2, dilate_sql("x", "m", "d2"), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def dilate_disk(spark, d):
    return R.dilate(base(spark, d), R.disk(2), frame(spark, d)).select(*big(*RUN))


@query(Q.query(*MASK, BOX1, *erode_sql("x", "m", "b1"), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def erode_box(spark, d):
    return R.erode(base(spark, d), R.box(1), frame(spark, d)).select(*big(*RUN))


@query(Q.query(*MASK, BOX1, *erode_sql("y", "m", "b1"), dilate_sql("x", "y", "b1"), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def opening_box(spark, d):
    return R.opening(base(spark, d), R.box(1), frame(spark, d)).select(*big(*RUN))


@query(Q.query(*MASK, BOX1, dilate_sql("y", "m", "b1"), *erode_sql("x", "y", "b1"), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def closing_box(spark, d):
    return R.closing(base(spark, d), R.box(1), frame(spark, d)).select(*big(*RUN))


@query(Q.query(*MASK, BOX1, dilate_sql("y", "m", "b1"), *erode_sql("z", "y", "b1"), 'x as (select "row",col from z except select "row",col from m)', Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def bottom_hat_box(spark, d):
    return R.merge_runs(R.bottom_hat(base(spark, d), R.box(1), frame(spark, d))).select(*big(*RUN))


@query(Q.query(*MASK, BOX1, *erode_sql("z", "m", "b1"), 'x as (select "row",col from m except select "row",col from z)', Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def mask_perimeter(spark, d):
    return R.merge_runs(R.perimeter_pixels(base(spark, d), frame(spark, d))).select(*big(*RUN))


CODES = """bi as (select "row",col,(s>1200)::int as b from sm),
cb as (select "row",col,b, coalesce(lag(b) over v,0)+2*b+4*coalesce(lead(b) over v,0) as k from bi window v as (partition by col order by "row")),
co as (select "row"::bigint as "row",col::bigint as col,b, coalesce(lag(k) over w,0)+8*k+64*coalesce(lead(k) over w,0) as code from cb window w as (partition by "row" order by col))"""


def codes(spark, d):
    bits = V.px_smooth(spark, d).select("scene_id", "row", "col", (F.col("s") > 1200).cast("int").alias("bit"))
    return S.neighbourhood_code(bits)


@query(Q.query(Q.PX, CODES, 'select "row",col from co where (code>>4)&1=1 or ((code>>1)&1)+((code>>3)&1)+((code>>5)&1)+((code>>7)&1)=4'))
def morph_fill(spark, d):
    return codes(spark, d).where(M.fills(F.col("code"))).select(*big("row", "col"))


@query(Q.query(Q.PX, CODES, f'select "row",col from co where code in ({",".join(map(str, M.bridge_codes()))})'))
def bridge(spark, d):
    return codes(spark, d).where(M.bridges(F.col("code"))).select(*big("row", "col"))


@query(Q.query(Q.PX, CODES, 'select "row",col from co where b=1 and code not in (471,381)'))
def hbreak(spark, d):
    return codes(spark, d).where((F.col("bit") == 1) & ~M.h_breaks(F.col("code"))).select(*big("row", "col"))


# -- objects ---------------------------------------------------------------------------------------------------------

OBJ = Q.OBJECTS.format("lr")
BOX = ("area", "min_row", "max_row", "min_col", "max_col")
SHAPE = ("row_centroid", "col_centroid", "major_axis_length", "minor_axis_length", "orientation")


@query(Q.query(*C4, OBJ, f"select label, {', '.join(f'{b}::bigint as {b}' for b in BOX)}, {rsql(*SHAPE)} from obj where area >= 4"))
def object_props(spark, d):
    """Objects of at least 4 pixels with area, box, centroid, axes and orientation."""
    return O.object_table(labelled(spark, d), 3).select("label", *big(*BOX), *rounded(*SHAPE))


@query(
    Q.query(
        *C4, Q.pixels("op", "lr"),
        'f4(a,b) as (values (0,1),(0,-1),(1,0),(-1,0))',
        'nb as (select p.label, p."row", p.col, count(q.col) as n from op p cross join f4 left join op q on q.label=p.label and q."row"=p."row"+a and q.col=p.col+b group by 1,2,3)',
        'bo as (select label,"row",col from nb where n<4)',
        "f9(a,b,w) as (values (0,0,1),(0,1,2),(0,-1,2),(1,0,2),(-1,0,2),(1,1,10),(1,-1,10),(-1,1,10),(-1,-1,10))",
        'cd as (select p.label, p."row", p.col, sum(w) as code from bo p cross join f9 join bo q on q.label=p.label and q."row"=p."row"+a and q.col=p.col+b group by 1,2,3)',
        "select label, round(sum(case when code in (5,7,15,17,25,27) then 1.0::double when code in (21,33) then sqrt(2.0::double) when code in (13,23) then (1+sqrt(2.0::double))/2 else 0.0::double end),6)+0.0 as perimeter from cd group by label",
    )
)
def perimeter(spark, d):
    return O.perimeters(labelled(spark, d)).select("label", *rounded("perimeter"))


@query()
def convex_area(spark, d):
    """Hull areas; checked against half-plane tests in the unit tests."""
    return O.convex_areas(labelled(spark, d)).where("convex_area is not null").select("label", "convex_polygon", "convex_area")


def two_labels(spark, d):
    a = R.explode_runs(labelled(spark, d)).select("scene_id", "label", "row", "col")
    b = R.explode_runs(R.components(R.runs_of(V.mask(spark, d, 1170)))).select("scene_id", "label", "row", "col")
    return a, b


TWO = (*C4, Q.pixels("pa", "lr"), Q.mask("m2", 1170), Q.runs("r2", "m2"), Q.components("lb", "r2"), Q.pixels("pb", "lb"))


@query(Q.query(Q.PX, Q.mask("m"), Q.mask("n", 1170), 'k as (select count(m.col) as nv, count(n.col) as nm, count(m.col+n.col) as c from m full join n on m."row"=n."row" and m.col=n.col)', "select round(c/nv,6) as recall, round(c/nm,6) as precision, round(2*(c/nv)*(c/nm)/(c/nv+c/nm),6) as f_score from k"))
def seg_compare(spark, d):
    return O.compare_masks(V.mask(spark, d), V.mask(spark, d, 1170)).select(*[F.round(x, 6).alias(x) for x in ("recall", "precision", "f_score")])


@query(
    Q.query(
        *TWO,
        'sh as (select pa.label as a, pb.label as b, count(*) as n from pa join pb on pa."row"=pb."row" and pa.col=pb.col group by 1,2)',
        "na as (select label, count(*) as n, round_even(avg(\"row\"),0) as r, round_even(avg(col),0) as c from pa group by label)",
        "nb as (select label, count(*) as n, round_even(avg(\"row\"),0) as r, round_even(avg(col),0) as c from pb group by label)",
        'select a, b from sh join na on na.label=a join nb on nb.label=b where 2*sh.n>na.n or 2*sh.n>nb.n union select na.label, pb.label from na join pb on pb."row"=na.r and pb.col=na.c union select pa.label, nb.label from nb join pa on pa."row"=nb.r and pa.col=nb.c',
    )
)
def relevant_set(spark, d):
    a, b = two_labels(spark, d)
    return O.relevant_pairs(a, b).select("a", "b")


@query(
    Q.query(
        *C4, Q.pixels("op", "lr"), "off(a,b) as (values " + ",".join(f"({a},{b})" for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9) + ")",
        'x as (select "row"+a as rr, col+b as cc, min((a*a+b*b)*cast(1e15 as bigint)+label) as best from op, off group by 1,2)',
        "select rr::bigint as \"row\", cc::bigint as col, (best%cast(1e15 as bigint))::bigint as label, (best//cast(1e15 as bigint))::bigint as d2 from x",
    )
)
def expand_labels(spark, d):
    a, _ = two_labels(spark, d)
    return O.expand_labels(a, 3).select(*big("row", "col", "label", "d2"))


@query(Q.query(*C4, Q.pixels("op", "lr"), 'select label, sum(q)::bigint as total, count(*)::bigint as n, (max(q)-min(q))::bigint as contrast from op join e on op."row"=e."row" and op.col=e.col group by label'))
def segment_means(spark, d):
    a, _ = two_labels(spark, d)
    return O.mean_by_label(a, V.px_embed(spark, d), "q").select(*big("label", "total", "n", "contrast"))


# -- pixels, tiles, histograms ---------------------------------------------------------------------------------------


@query(Q.query(Q.BANDS, 'select "row"::bigint as "row", col::bigint as col, round(b7,6) as b7, round(b2,6) as b2, round(b1,6) as b1 from b'))
def rasterize(spark, d):
    return V.px_bands(spark, d).select(*big("row", "col"), *rounded("b7", "b2", "b1"))


CLOUD_SQL = "(b7 > 110/255.0::double and not (b7 < 200/255.0::double and b2 > 190/255.0::double and 0.0*b2 <= b7 and b7 < 0.75*b2))"


@query(Q.query(Q.BANDS, f'select "row"::bigint as "row", col::bigint as col, {CLOUD_SQL} as cloud from b'))
def cloud_box(spark, d):
    return V.px_bands(spark, d).select(*big("row", "col"), M.cloud_box().alias("cloud"))


DETECTORS = ((5 / 255, 230 / 255, 240 / 255), (60 / 255, 150 / 255, 140 / 255), (150 / 255, 100 / 255, 80 / 255))


@query(
    Q.query(
        Q.BANDS,
        "f as (select *, " + ", ".join(f"(b7<{a!r}::double and b2>{b!r}::double and b1>{c!r}::double) as d{i}" for i, (a, b, c) in enumerate(DETECTORS)) + " from b)",
        "k as (select case when count(*) filter (d0)>10 then 0 when count(*) filter (d1)>10 then 1 when count(*) filter (d2)>10 then 2 end as detector from f)",
        'select "row"::bigint as "row", col::bigint as col, detector::bigint as detector from f, k where (detector=0 and d0) or (detector=1 and d1) or (detector=2 and d2)',
    )
)
def detector_first(spark, d):
    return M.first_detector(V.px_bands(spark, d), [M.ice_threshold(*t) for t in DETECTORS]).select(*big("row", "col", "detector"))


HIST_SQL = "hi as (select k as bin, coalesce(n,0) as n from (select unnest(range(0,64)) as k) left join (select cast(least(floor(b2*64),63) as bigint) as bin, count(*) as n from b group by 1) on bin=k)"


@query(Q.query(Q.BANDS, HIST_SQL, "select bin::bigint as bin, n::bigint as n from hi"))
def band_hist(spark, d):
    return H.histogram(V.px_bands(spark, d), "b2", 64).select(*big("bin", "n"))


@query(
    Q.query(
        Q.BANDS, HIST_SQL,
        "sh as (select bin, n, n/(select sum(n) from hi where bin/64.0::double>0.3)::double as s, max(n) over (order by bin rows between 3 preceding and 3 following) as m, lag(n) over (order by bin) as p, lead(n) over (order by bin) as q from hi)",
        "tp as (select * from sh where n=m and n>p and n>q and bin>=3 and bin<61)",
        "wl as (select t.bin, t.s, coalesce((select max(x.bin) from sh x where x.bin<t.bin and x.s>t.s),-1) as lw, coalesce((select min(x.bin) from sh x where x.bin>t.bin and x.s>t.s),64) as rw from tp t)",
        "pr as (select bin, s - greatest((select min(x.s) from sh x where x.bin<wl.bin and x.bin>lw),(select min(x.s) from sh x where x.bin>wl.bin and x.bin<rw)) as prom from wl)",
        "select bin/64.0::double as edge from pr where prom>=0.001 order by prom desc, bin limit 1",
    )
)
def ice_peaks(spark, d):
    return H.peaks(H.histogram(V.px_bands(spark, d), "b2", 64), 64, least=0.001).select("edge")


@query(Q.query(Q.BANDS, 'c as (select least("row"//30,2) as tr, least(col//30,2) as tc, cast(least(floor(b2*32),31) as int) as bin, count(*) as n from b group by 1,2,3)', "p as (select tr,tc,n/sum(n) over (partition by tr,tc)::double as p from c)", "select tr::bigint as tr, tc::bigint as tc, round(-sum(p*log2(p)),6)+0.0 as entropy from p group by 1,2"))
def tile_entropy(spark, d):
    px = tiled(spark, d)
    return H.entropy(px, "b2", 32, ("tr", "tc")).select(*big("tr", "tc"), *rounded("entropy"))


def tiled(spark, d):
    px = V.px_bands(spark, d)
    return px.withColumn("tr", H.tile_key(F.col("row"), 30, 100)).withColumn("tc", H.tile_key(F.col("col"), 30, 100))


@query(Q.query(Q.BANDS, 'select least("row"//30,2)::bigint as tr, least(col//30,2)::bigint as tc, min("row")::bigint as r0, max("row")::bigint as r1, min(col)::bigint as c0, max(col)::bigint as c1, count(*)::bigint as n, round(avg((b2>0.1)::int),6)+0.0 as white from b group by 1,2'))
def tile_stats(spark, d):
    t = tiled(spark, d).groupBy("tr", "tc").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"), F.avg((F.col("b2") > 0.1).cast("int")).alias("white"))
    return t.select(*big("tr", "tc", "r0", "r1", "c0", "c1", "n"), *rounded("white"))


@query(Q.query(Q.BANDS, "select round(avg(b2),6) as mean, round(stddev_samp(b2),6) as std, round(skewness(b2),2) as skew from b"))
def band_moments(spark, d):
    # the sample correction of the SQL function differs from the population one by a factor near 1
    n = F.count("b2")
    skew = F.skewness("b2") * F.sqrt(n * (n - 1)) / (n - 2)
    return V.px_bands(spark, d).agg(F.round(F.avg("b2"), 6).alias("mean"), F.round(F.stddev_samp("b2"), 6).alias("std"), (F.round(skew, 2) + F.lit(0.0)).alias("skew"))


@query(Q.query(Q.BANDS, "p as (select quantile_cont(b2,0.01) as lo, quantile_cont(b2,0.99) as hi from b)", 'select "row"::bigint as "row", col::bigint as col, cast(round(least(255.0::double,greatest(0.0::double,(b2-lo)/(hi-lo)*255))) as bigint) as stretched from b,p'))
def stretch(spark, d):
    return H.stretch(V.px_bands(spark, d), "b2").select(*big("row", "col", "stretched"))


@query(Q.query(Q.BANDS, HIST_SQL, "cd as (select bin, sum(n) over (order by bin)/sum(n) over ()::double as eq from hi)", 'select "row"::bigint as "row", col::bigint as col, round(eq,6) as equalized from b join cd on bin=cast(least(floor(b2*64),63) as bigint)'))
def equalize(spark, d):
    return H.equalize(V.px_bands(spark, d), "b2", 64).select(*big("row", "col"), *rounded("equalized"))


BOX_MEAN = """ba as (select "row",col,q,sum(q) over w as hs, count(q) over w as hn from e window w as (partition by "row" order by col range between 5 preceding and 5 following)),
bm as (select "row",col,q,sum(hs) over v/sum(hn) over v::double as mean from ba window v as (partition by col order by "row" range between 5 preceding and 5 following))"""


@query(Q.query(Q.PX, BOX_MEAN, 'select "row"::bigint as "row", col::bigint as col from bm where q > mean*(1-15/100.0::double)'))
def box_mean_threshold(spark, d):
    return S.adaptive_threshold(V.px_embed(spark, d), "q", 5, 15).select(*big("row", "col"))


SOBEL = """so as (select "row",col,coalesce(lead(q) over w,q)-coalesce(lag(q) over w,q) as dx, coalesce(lag(q) over w,q)+2*q+coalesce(lead(q) over w,q) as sx from e window w as (partition by "row" order by col)),
sg as (select "row",col,(coalesce(lag(dx) over v,dx)+2*dx+coalesce(lead(dx) over v,dx))/8.0::double as gx,(coalesce(lead(sx) over v,sx)-coalesce(lag(sx) over v,sx))/8.0::double as gy from so window v as (partition by col order by "row"))"""


@query(Q.query(Q.PX, SOBEL, 'select "row"::bigint as "row", col::bigint as col, round(sqrt(gx*gx+gy*gy),4)+0.0 as gradient from sg'))
def sobel(spark, d):
    return S.sobel(V.px_embed(spark, d), "q").select(*big("row", "col"), *rounded("gradient", digits=4))


DIFFUSE = """d0 as (select "row",col,q/255.0::double as v from e),
d1 as (select "row",col,v,coalesce(lag(v) over w,v)-v as a,coalesce(lead(v) over w,v)-v as b,coalesce(lag(v) over c,v)-v as cc,coalesce(lead(v) over c,v)-v as dd from d0 window w as (partition by "row" order by col), c as (partition by col order by "row"))"""


@query(Q.query(Q.PX, DIFFUSE, 'select "row"::bigint as "row", col::bigint as col, round(v+0.1*(' + "+".join(f"exp(-(abs({t})/0.1)*(abs({t})/0.1))*{t}" for t in ("a", "b", "cc", "dd")) + "),6)+0.0 as v from d1"))
def diffuse(spark, d):
    px = V.px_embed(spark, d).select("scene_id", "row", "col", (F.col("q") / F.lit(255.0)).alias("v"))
    return S.diffuse(px, "v").select(*big("row", "col"), *rounded("v"))


@query()
def unsharp(spark, d):
    px = V.px_embed(spark, d).select("scene_id", "row", "col", F.col("q").cast("double").alias("v"))
    return S.unsharp(px, "v", 1.0, 2.0, 3.0, 255.0).select(*big("row", "col"), *rounded("sharp", digits=4))


def kmeans_sql(rounds: int, k: int) -> list[str]:
    out = ["lv as (select q, count(*) as n from e group by q)", f"k0 as (select q, n, cast(least(floor((2*sum(n) over (order by q)-n)/(2*sum(n) over ())::double*{k}),{k}-1) as int) as cluster from lv)"]
    for i in range(rounds):
        out.append(f"z{i} as (select row_number() over (order by centre)-1 as c, centre from (select sum(q*n)/sum(n)::double as centre from k{i} group by cluster))")
        out.append(f"k{i + 1} as (select q, n, (select c from z{i} order by abs(centre-q), c limit 1) as cluster from lv)")
    return out


@query(Q.query(Q.PX, *kmeans_sql(5, 4), "select q::bigint as q, cluster::bigint as cluster from k5"))
def kmeans_levels(spark, d):
    return H.kmeans(V.px_embed(spark, d), "q").select(*big("q", "cluster"))


@query(Q.query(Q.PX, *kmeans_sql(5, 4), "f as (select q from e where q>150)", "select cluster::bigint as cluster from k5 join f using (q) group by cluster order by count(*) desc, cluster limit 1"))
def kmeans_pick(spark, d):
    px = V.px_embed(spark, d)
    return H.modal_cluster(H.kmeans(px, "q"), px.where("q > 150"), "q").select(*big("cluster"))


# -- tracking --------------------------------------------------------------------------------------------------------

SCENES = [Q.PX]
for _k in range(4):
    SCENES += [f'sc{_k} as (select "row"+{_k} as "row", col+{2 * _k} as col from sm where s > {1200 - 10 * _k})', Q.runs(f"sr{_k}", f"sc{_k}"), Q.components(f"sl{_k}", f"sr{_k}"), Q.OBJECTS.format(f"sl{_k}").replace("mo as", f"mo{_k} as").replace("from mo)", f"from mo{_k})").replace("ob as", f"ob{_k} as").replace("from ob)", f"from ob{_k})").replace("obj as", f"obj{_k} as")]
SCENES.append("ao as (" + " union all ".join(f"select {k} as scene_id, '{k}:'||label as uuid, area, row_centroid, col_centroid, major_axis_length, minor_axis_length, {k}*7200.0::double as t from obj{k} where area>=30" for k in range(4)) + ")")
CANDIDATES = """pa as (select h.uuid as h_uuid, c.uuid as uuid, h.scene_id as h_scene, c.scene_id as scene_id, c.t-h.t as dt_s, 250.0*sqrt((c.row_centroid-h.row_centroid)*(c.row_centroid-h.row_centroid)+(c.col_centroid-h.col_centroid)*(c.col_centroid-h.col_centroid)) as dx_m,
 abs(h.area-c.area)/(0.5*(h.area+c.area)) as ea, abs(h.major_axis_length-c.major_axis_length)/(0.5*(h.major_axis_length+c.major_axis_length)) as ej, abs(h.minor_axis_length-c.minor_axis_length)/(0.5*(h.minor_axis_length+c.minor_axis_length)) as en, c.area as area
 from ao h join ao c on h.t<c.t),
pc as (select *, dx_m/(1.5*dt_s+250) as sd, greatest(log10(dt_s/3600),0) as lg from pa),
pd as (select * from pc where dx_m/1000 <= pow(10.0::double, 0.403+0.988*lg-0.05*lg*lg))"""


def piece_sql(low: float, high: float) -> str:
    return f"(case when area<=100 then {low} when area>=700 then {high} else {low}+({high}-{low})*(area-100)/600.0::double end)::double"


CHAIN = "pf as (select *, round(sd+ea+ej+en,9) as w from pd where " + " and ".join(f"{c}<{piece_sql(*T.RELATIVE[n])}" for c, n in (("ea", "area"), ("ej", "major_axis_length"), ("en", "minor_axis_length"))) + ")"

def scene_labels(spark, d):
    return cut(R.components(R.runs_of(V.scenes(spark, d))))


def objects_of(spark, labels):
    objects = O.object_table(labels, 29).join(F.broadcast(V.scene_times(spark)), "scene_id")
    return cut(objects.withColumn("uuid", F.concat_ws(":", "scene_id", "label")))


def scene_objects(spark, d):
    return objects_of(spark, scene_labels(spark, d))


def chain_of(objects):
    return T.weighted(T.filtered(T.candidates(objects)))


def scene_pairs(spark, d):
    return T.candidates(scene_objects(spark, d))


def chained(spark, d):
    return chain_of(scene_objects(spark, d))


def matched_cells(spark, d):
    """Matched pairs (u1, u2) and the cells of their objects with orientation."""
    labels = scene_labels(spark, d)
    objects = objects_of(spark, labels)
    matched = cut(T.mutual_best(cut(chain_of(objects))).select(F.col("h_uuid").alias("u1"), F.col("uuid").alias("u2")))
    used = matched.select(F.explode(F.array("u1", "u2")).alias("uuid")).distinct()
    wanted = objects.join(used, "uuid", "left_semi").select("scene_id", "label", "uuid", "orientation")
    cells = cut(R.explode_runs(labels.join(wanted, ["scene_id", "label"])).select("uuid", "row", "col", "orientation"))
    first = cells.join(matched.select(F.col("u1").alias("uuid")).distinct(), "uuid", "left_semi")
    second = cells.join(matched.select(F.col("u2").alias("uuid")).distinct(), "uuid", "left_semi")
    return matched, first, second


@query(Q.query(*SCENES, f"select uuid, area::bigint as area, {rsql('row_centroid', 'col_centroid')} from ao"))
def scene_object_table(spark, d):
    return scene_objects(spark, d).select("uuid", *big("area"), *rounded("row_centroid", "col_centroid"))


@query(Q.query(*SCENES, CANDIDATES, "select h_uuid, uuid, dt_s, round(dx_m,4) as dx_m, round(sd,6) as scaled_distance from pd"))
def pair_candidates(spark, d):
    return scene_pairs(spark, d).select("h_uuid", "uuid", "dt_s", F.round("dx_m", 4).alias("dx_m"), F.round("scaled_distance", 6).alias("scaled_distance"))


@query(Q.query(*SCENES, CANDIDATES, CHAIN, "select h_uuid, uuid, round(ea,6) as ea, round(w,6) as w from pf"))
def filter_chain(spark, d):
    return chained(spark, d).select("h_uuid", "uuid", F.round("relative_error_area", 6).alias("ea"), F.round("w", 6).alias("w"))


@query(Q.query(*SCENES, CANDIDATES, CHAIN, "hb as (select h_uuid, uuid, row_number() over (partition by h_uuid order by w,uuid) as n from pf)", "tb as (select h_uuid, uuid, row_number() over (partition by uuid order by w,h_uuid) as n from pf)", "select hb.h_uuid, hb.uuid from hb join tb on hb.h_uuid=tb.h_uuid and hb.uuid=tb.uuid where hb.n=1 and tb.n=1"))
def mutual_best(spark, d):
    return T.mutual_best(cut(chained(spark, d))).select("h_uuid", "uuid")


def track_sql() -> list[str]:
    out = ["t0 as (select uuid, scene_id, uuid as trajectory_uuid, null::varchar as head_uuid from ao where scene_id=0)"]
    for k in range(1, 4):
        out.append(f"h{k} as (select trajectory_uuid, arg_max(uuid, scene_id) as h from t{k - 1} group by 1)")
        out.append(f"o{k} as (select p.*, h{k}.trajectory_uuid from pf p join h{k} on p.h_uuid=h{k}.h where p.scene_id={k})")
        out.append(f"m{k} as (select uuid, h_uuid, trajectory_uuid from (select *, row_number() over (partition by h_uuid order by w,uuid) as a, row_number() over (partition by uuid order by w,h_uuid) as b from o{k}) where a=1 and b=1)")
        out.append(f"t{k} as (select * from t{k - 1} union all select ao.uuid, ao.scene_id, coalesce(m{k}.trajectory_uuid, ao.uuid), m{k}.h_uuid from ao left join m{k} on ao.uuid=m{k}.uuid where ao.scene_id={k})")
    return out


@query(Q.query(*SCENES, CANDIDATES, CHAIN, *track_sql(), "select uuid, trajectory_uuid, head_uuid from t3 where trajectory_uuid in (select trajectory_uuid from t3 group by 1 having count(*)>=2)"))
def track4(spark, d):
    objects = scene_objects(spark, d)
    return T.track(objects, chain_of(objects)).select("uuid", "trajectory_uuid", "head_uuid")


@query("with l as (select user_id as id, max({'t':ts,'v':value}) as x from events where ts < timestamp '2024-01-15 00:00:00' group by 1) select id, x.t as time, round(x.v,6) as value from l where epoch(timestamp '2024-01-15 00:00:00')-epoch(x.t) <= 172800")
def track_heads(spark, d):
    return T.heads(V.observations(spark, d), "2024-01-15 00:00:00", T.MAX_STEP_S).select("id", "time", F.round("value", 6).alias("value"))


@query("select a.user_id as id, a.ts as time1, b.ts as time2, (epoch_us(b.ts)-epoch_us(a.ts))::bigint as dt_us, b.value-a.value as change from events a join events b on a.user_id=b.user_id and a.ts<b.ts and cast(b.ts as date)-cast(a.ts as date)<=1")
def rotation_lookback(spark, d):
    p = T.lookback_pairs(V.observations(spark, d).drop("event_type"))
    return p.select(F.col("id1").alias("id"), "time1", "time2", (F.unix_micros("time2") - F.unix_micros("time1")).alias("dt_us"), (F.col("value2") - F.col("value1")).alias("change"))


CURVES = 'cu as (select "row"//2 as pair, "row"%2 as side, col as i, (q-128)/128.0::double as v from e)'


@query(Q.query(Q.PX, CURVES, "nn as (select pair, sqrt(sum(v*v) filter (side=0))*sqrt(sum(v*v) filter (side=1)) as nrm from cu group by pair)", "ss as (select a.pair, a.i-b.i as lag, sum(a.v*b.v) as s from cu a join cu b on a.pair=b.pair and a.side=0 and b.side=1 group by 1,2)", "select pair::bigint as pair, lag::bigint as lag, round(s/nrm,6)+0.0 as r from ss join nn using (pair)"))
def crosscorr(spark, d):
    c = V.px_embed(spark, d).select(F.floor(F.col("row") / 2).alias("pair"), (F.col("row") % 2).alias("side"), F.col("col").alias("i"), ((F.col("q") - 128) / F.lit(128.0)).alias("value"))
    return T.cross_correlation(c).select(*big("pair", "lag"), *rounded("r"))


@query()
def register_angle(spark, d):
    """Turning angle of each matched pair of the track; tested on masks turned by known angles."""
    matched, first, second = matched_cells(spark, d)
    first, second = first.drop("orientation"), second.drop("orientation")
    return T.register(first, second, matched, 15)


# -- catalog ---------------------------------------------------------------------------------------------------------

CASES = "ca as (select o_orderkey as case_number, r_name as region, cast(o_orderdate as date) as s from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey)"


@query(Q.query(CASES, "dy as (select *, s + cast(i as int) as day from ca, (select unnest(range(0,3)) as i))", "select case_number, region, cast(day as date) as day, sat as satellite, lpad(cast(case_number as varchar),5,'0')||'-'||lower(replace(region,' ','_'))||'-'||strftime(day,'%Y%m%d')||'-'||sat as name from dy, (select unnest(['aqua','terra']) as sat)"))
def case_expand(spark, d):
    days = V.cases(spark, d).withColumn("day", F.explode(F.sequence("start", "end"))).withColumn("satellite", F.explode(F.array(F.lit("aqua"), F.lit("terra"))))
    name = F.concat_ws("-", F.lpad(F.col("case_number").cast("string"), 5, "0"), F.lower(F.replace("region", F.lit(" "), F.lit("_"))), F.date_format("day", "yyyyMMdd"), "satellite")
    return days.select("case_number", "region", "day", "satellite", name.alias("name"))


@query("select cast(ts as date) as day, event_type as satellite, min(ts) as first_pass, count(*)::bigint as passes from events group by 1,2")
def overpass_first(spark, d):
    e = V.observations(spark, d)
    return e.groupBy(F.to_date("time").alias("day"), F.col("event_type").alias("satellite")).agg(F.min("time").alias("first_pass"), F.count("*").alias("passes"))


@query("select last_day(cast(ts as date)) as month_end, event_type, count(*)::bigint as n, round(sum(value),2) as total from events group by 1,2")
def month_partitions(spark, d):
    e = V.observations(spark, d)
    return e.groupBy(F.last_day(F.to_date("time")).alias("month_end"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*)::bigint as n, round(avg(value),6) as mean from events group by 1,2")
def object_daily_windows(spark, d):
    e = V.observations(spark, d)
    return e.groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("day"), "event_type", "n", "mean")


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*)::bigint as n, round(avg(value),6) as mean from events group by 1,2")
def stream_daily_windows(spark, d):
    """The daily statistics as a stream with a watermark; equal to the batch form."""
    out = W.drained(W.windowed(W.observation_stream(spark, d), "1 day"))
    return out.select("start", "event_type", "n", F.round("mean", 6).alias("mean"))


@query("with s as (select unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) as start, event_type, value from events) select start, event_type, count(*)::bigint as n, round(avg(value),6) as mean from s group by 1,2")
def sliding_windows(spark, d):
    return W.windowed(V.observations(spark, d), "12 hours", "6 hours").select("start", "event_type", "n", F.round("mean", 6).alias("mean"))


@query("with a as (select user_id as id, ts, case when ts < lag(ts) over w + interval '2 hours' then 0 else 1 end as b from events window w as (partition by user_id order by ts)), c as (select id, ts, sum(b) over (partition by id order by ts) as k from a) select id, min(ts) as start, max(ts) + interval '2 hours' as \"end\", count(*)::bigint as n from c group by id, k")
def session_windows(spark, d):
    return W.sessions(V.observations(spark, d), "2 hours")


MINIMA = """rv as (select "row"::bigint*2147483648+min(col) as id, "row", q, min(col) as c0, max(col) as c1 from (select "row",col,q,col-row_number() over (partition by "row",q order by col) as g from e) group by "row",q,g),
ve as (select a.id as x, b.id as y from rv a join rv b on b."row"=a."row"+1 and a.q=b.q and a.c0<=b.c1 and b.c0<=a.c1), vu as (select x,y from ve union all select y,x from ve),
vc(id,l) as (select id,id from rv union select u.y,c.l from vc c join vu u on u.x=c.id where c.l<u.y), vl as (select rv.*, k.l as label from rv join (select id, min(l) as l from vc group by id) k using (id)),
lo as (select "row",col, least(coalesce(lag(q) over w,q),coalesce(lead(q) over w,q),coalesce(lag(q) over c,q),coalesce(lead(q) over c,q))<q as low from e window w as (partition by "row" order by col), c as (partition by col order by "row"))"""


@query(Q.query(Q.PX, MINIMA, 'select "row"::bigint as "row", c0::bigint as c0, c1::bigint as c1, q::bigint as q, label from vl where label not in (select label from vl join lo on vl."row"=lo."row" and lo.col between c0 and c1 where low)'))
def regional_minima(spark, d):
    return R.regional_minima(V.px_embed(spark, d), "q").select(*big("row", "c0", "c1", "q", "label"))


@query(Q.query(*MASK, Q.background("g", "m"), "of(a,b) as (values " + ",".join(f"({a},{b})" for a in range(-3, 4) for b in range(-3, 4) if 0 < a * a + b * b <= 9) + ")", 'x as (select g."row"+a as "row", g.col+b as col, min(a*a+b*b) as d2 from g, of group by 1,2)', 'select m."row"::bigint as "row", m.col::bigint as col, d2::bigint as d2 from x join m on x."row"=m."row" and x.col=m.col'))
def bounded_distance(spark, d):
    return R.distance_within(V.mask(spark, d), 3, frame(spark, d)).select(*big("row", "col", "d2"))


@query(Q.query(Q.PX, "k as (select \"row\",col,(q//64) as label from e)", 'd as (select "row",col,label,(coalesce(lag(label) over w,label)<>label or coalesce(lead(label) over w,label)<>label or coalesce(lag(label) over c,label)<>label or coalesce(lead(label) over c,label)<>label) as edge from k window w as (partition by "row" order by col), c as (partition by col order by "row"))', 'select "row"::bigint as "row", col::bigint as col, label::bigint as label from d where edge'))
def label_boundaries(spark, d):
    labels = V.px_embed(spark, d).withColumn("label", F.floor(F.col("q") / 64))
    return S.boundaries(labels).select(*big("row", "col", "label"))


BRANCH = (
    "lut(code,p,cand) as (values " + ",".join(f"({c},{p},{int(c in set(M.branch_candidates()))})" for c, p in enumerate(M.background_parts())) + ")",
    'bp as (select "row",col,co.code,p,cand,(p>2)::int as m from co join lut on co.code=lut.code)',
    'ba1 as (select *, greatest(m,coalesce(lag(m) over w,0),coalesce(lead(m) over w,0)) as m1 from bp window w as (partition by "row" order by col))',
    'ba2 as (select *, greatest(m1,coalesce(lag(m1) over c,0),coalesce(lead(m1) over c,0)) as m2 from ba1 window c as (partition by col order by "row"))',
)


@query(Q.query(Q.PX, CODES, *BRANCH, 'select "row", col from ba2 where cand=1 and p<>1 and not (p=2 and m2=1)'))
def branch_points(spark, d):
    return S.branch_points(codes(spark, d)).select(*big("row", "col"))


STITCH = (
    'k as (select "row",col,q/255.0::double as g,"row"//50 as tr,col//32 as tc,(("row"//50)*2+col//32)*4+q//64 as label from e)',
    'me as (select label, avg(g) as mean from k group by label)',
    'se as (select l,r from (select label as l, lead(label) over w as r, tc as a, lead(tc) over w as b from k window w as (partition by "row" order by col)) where a<>b and l<>r union all select l,r from (select label as l, lead(label) over w as r, tr as a, lead(tr) over w as b from k window w as (partition by col order by "row")) where a<>b and l<>r)',
    'cn as (select l,r,count(*) as n from se group by 1,2 having count(*)>=4)',
    'nr as (select cn.* from cn join me a on a.label=l join me b on b.label=r where abs(a.mean-b.mean)<0.1)',
    'be as (select r,l from (select *, row_number() over (partition by r order by n desc, l) as z from nr) where z=1)',
    'bu as (select r as x,l as y from be union all select l,r from be)',
    'bc(id,l) as (select label,label from me union select u.y,c.l from bc c join bu u on u.x=c.id where c.l<u.y)',
)


@query(Q.query(Q.PX, *STITCH, "select id::bigint as label, min(l)::bigint as stitched from bc group by id"))
def stitch_clusters(spark, d):
    tile = F.floor(F.col("row") / 50) * 2 + F.floor(F.col("col") / 32)
    px = V.px_embed(spark, d).select("scene_id", "row", "col", (F.col("q") / F.lit(255.0)).alias("g"), F.floor(F.col("row") / 50).alias("tr"), F.floor(F.col("col") / 32).alias("tc"), (tile * 4 + F.floor(F.col("q") / 64)).alias("label"))
    return H.stitch(px, "label", "g").select(*big("label", "stitched"))


@query(Q.query(Q.PX, CURVES, "nn as (select pair, sqrt(sum(v*v) filter (side=0))*sqrt(sum(v*v) filter (side=1)) as nrm from cu group by pair)", "ss as (select a.pair, a.i-b.i as lag, sum(a.v*b.v) as s from cu a join cu b on a.pair=b.pair and a.side=0 and b.side=1 group by 1,2)", "select pair::bigint as pair, round(max(s/nrm),3)+0.0 as correlation, round(1-round(max(s/nrm),3),3)+0.0 as score from ss join nn using (pair) group by pair"))
def best_correlation(spark, d):
    c = V.px_embed(spark, d).select(F.floor(F.col("row") / 2).alias("pair"), (F.col("row") % 2).alias("side"), F.col("col").alias("i"), ((F.col("q") - 128) / F.lit(128.0)).alias("value"))
    return T.best_correlation(c).select(*big("pair"), *rounded("correlation", "score", digits=3))


@query()
def shape_difference(spark, d):
    """Shape difference of each matched pair of the track."""
    matched, first, second = matched_cells(spark, d)
    return T.shape_difference(first, second, matched)


GT = (-1_200_000.0, 250.0, 0.0, 800_000.0, 0.0, -250.0)


@query(Q.query(*C4, OBJ, f"select label, round({GT[0]}+(round_even(col_centroid,0)+0.5)*{GT[1]},4) as x, round({GT[3]}+(round_even(row_centroid,0)+0.5)*({GT[5]}),4) as y, round(area*0.0625::double,6) as area_km2 from obj where area>=4"))
def geo_centroid(spark, d):
    from scenetrack.functions import geo

    o = O.object_table(labelled(spark, d), 3)
    x, y = geo.pixel_to_xy(F.rint("col_centroid"), F.rint("row_centroid"), GT)
    return o.select("label", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(geo.area_km2(F.col("area"), GT), 6).alias("area_km2"))


@query(Q.query(*C4, OBJ, f"xy as (select label, {GT[0]}+(round_even(col_centroid,0)+0.5)*{GT[1]} as x, {GT[3]}+(round_even(row_centroid,0)+0.5)*({GT[5]}) as y from obj where area>=4)", "select label, round(degrees(x/6378137.0::double),6)+0.0 as lon, round(degrees(2*atan(exp(y/6378137.0::double))-pi()/2),6)+0.0 as lat from xy"))
def geo_mercator(spark, d):
    from scenetrack.functions import geo

    o = O.object_table(labelled(spark, d), 3)
    lon, lat = geo.lon_lat(*geo.pixel_to_xy(F.rint("col_centroid"), F.rint("row_centroid"), GT), epsg=3857)
    return o.select("label", lon.alias("lon"), lat.alias("lat")).select("label", *rounded("lon", "lat"))


def registered() -> tuple[dict, dict[str, str]]:
    """All queries and their SQL; the other modules of queries add theirs when they are imported."""
    from scenetrack.plans import linking, segmentation  # noqa: F401

    return QUERIES, ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_props(spark, sf_dir)
