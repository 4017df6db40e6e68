"""Queries of tracking, registration, contours, distances and reconstruction, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scenetrack.operators import basins as B
from scenetrack.operators import contours as K
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.operators import tracking as T
from scenetrack.plans import sql as Q
from scenetrack.plans.queries import C4, CANDIDATES, CHAIN, CURVES, MASK, ORACLE_SQL, RUN, SCENES, big, chain_of, frame, labelled, query, rounded, scene_labels, scene_objects, track_sql
from scenetrack.session import cut
from scenetrack.sources import views as V

PIXEL = '"row"::bigint as "row", col::bigint as col'

# -- filters of whole images -----------------------------------------------------------------------------------------


def gaussian_sql(source: str, name: str, value: str, out: str, window: str, sigma: float) -> str:
    radius = max(1, round(3 * sigma))
    weight = {d: math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)}
    moved = {d: value if d == 0 else f"{'lead' if d > 0 else 'lag'}({value},{abs(d)}) over w" for d in weight}
    total = "+".join(f"coalesce({w!r}::double*({moved[d]}),0)" for d, w in weight.items())
    norm = "+".join(f"(case when ({moved[d]}) is not null then {w!r}::double else 0 end)" for d, w in weight.items())
    return f"{name} as (select *, ({total})/({norm}) as {out} from {source} window w as ({window}))"


ROW, COL = 'partition by "row" order by col', 'partition by col order by "row"'
ORACLE_SQL["unsharp"] = Q.query(
    Q.PX, 'v0 as (select "row",col,q::double as v from e)', gaussian_sql("v0", "v1", "v", "h", ROW, 1.0), gaussian_sql("v1", "v2", "h", "b", COL, 1.0),
    f"select {PIXEL}, round(case when abs(v-b)<3.0 then v else least(255.0,greatest(0.0,v+2.0*(v-b))) end,4)+0.0 as sharp from v2",
)

EIGHT = (
    "d0 as (select \"row\",col,q/255.0::double as v from e)", "dk as (select 0.1*(max(v)-min(v)) as k from d0)",
    f"d1 as (select *, coalesce(lag(v) over w,v) as l, coalesce(lead(v) over w,v) as r from d0 window w as ({ROW}))",
    f"d2 as (select *, coalesce(lag(v) over c,v)-v as u, coalesce(lead(v) over c,v)-v as d, l-v as ll, r-v as rr, coalesce(lag(l) over c,l)-v as lu, coalesce(lead(l) over c,l)-v as ld, coalesce(lag(r) over c,r)-v as ru, coalesce(lead(r) over c,r)-v as rd from d1 window c as ({COL}))",
)
FLOW = "+".join(f"{w}*exp(-pow({t}/k,2))*{t}" for t, w in (("ll", 1.0), ("rr", 1.0), ("u", 1.0), ("d", 1.0), ("lu", 0.5), ("ld", 0.5), ("ru", 0.5), ("rd", 0.5)))


@query(Q.query(Q.PX, *EIGHT, f"select {PIXEL}, round(v+0.125*({FLOW}),6)+0.0 as v from d2, dk"))
def diffuse_eight(spark, d):
    px = V.px_embed(spark, d).select("scene_id", "row", "col", (F.col("q") / F.lit(255.0)).alias("v"))
    return S.diffuse8(px, "v").select(*big("row", "col"), *rounded("v"))


@query(Q.query(Q.PX, DIFFUSE_TWO := 'd0 as (select "row",col,q/255.0::double as v from e), d1 as (select "row",col,v,coalesce(lag(v) over w,v)-v as a,coalesce(lead(v) over w,v)-v as b,coalesce(lag(v) over c,v)-v as cc,coalesce(lead(v) over c,v)-v as dd from d0 window w as (partition by "row" order by col), c as (partition by col order by "row"))', f"select {PIXEL}, round(v+0.1*(" + "+".join(f"{t}/(1+({t}/0.1)*({t}/0.1))" for t in ("a", "b", "cc", "dd")) + "),6)+0.0 as v from d1"))
def diffuse_inverse(spark, d):
    """One diffusion step with the second edge-stopping function."""
    px = V.px_embed(spark, d).select("scene_id", "row", "col", (F.col("q") / F.lit(255.0)).alias("v"))
    return S.diffuse(px, "v", name="inverse_quadratic").select(*big("row", "col"), *rounded("v"))


def levels_sql(mask: str, marker: str, top: int) -> tuple[str, ...]:
    """rg: grey reconstruction of whole numbers 0..top, level by level: what of mask >= t is connected to marker >= t."""
    out: list[str] = [f'gm as (select "row",col,cast({mask} as int) as k,cast(least({marker},{mask}) as int) as m from e)']
    for t in range(1, top + 1):
        out += [f'ga{t} as (select "row",col from gm where k>={t})', Q.runs(f"gr{t}", f"ga{t}"), Q.components(f"gl{t}", f"gr{t}"), Q.pixels(f"gp{t}", f"gl{t}")]
        out.append(f'gh{t} as (select "row",col,{t} as v from gp{t} where label in (select label from gp{t} p join gm on gm."row"=p."row" and gm.col=p.col and m>={t}))')
    found = " union all ".join(f"select * from gh{t}" for t in range(1, top + 1))
    out.append(f'rg as (select gm."row", gm.col, k, coalesce(max(v),0) as v from gm left join ({found}) f on f."row"=gm."row" and f.col=gm.col group by 1,2,3)')
    return tuple(out)


@query(Q.query(Q.PX, *levels_sql("q//52", 'case when (col+"row")%7=0 then q//52 else 0 end', 4), f"select {PIXEL}, v::bigint as reconstructed from rg"))
def reconstruct_gray(spark, d):
    px = V.px_embed(spark, d).withColumn("k", F.floor(F.col("q") / 52)).withColumn("m", F.when((F.col("col") + F.col("row")) % 7 == 0, F.col("k")).otherwise(F.lit(0)))
    return S.reconstruct_gray(px, "m", "k").select(*big("row", "col", "reconstructed"))


@query(Q.query(Q.PX, *levels_sql("4-q//52", "greatest(4-q//52-1,0)", 4), f"select {PIXEL}, (4-v)::bigint as filled from rg"))
def fill_minima(spark, d):
    """Minima of depth 1 levelled out of an image of five levels."""
    px = V.px_embed(spark, d).withColumn("k", F.floor(F.col("q") / 52))
    return S.filled_minima(px, "k", 1, 4).select(*big("row", "col"), F.greatest("filled", F.lit(0)).cast("bigint").alias("filled"))


FAR = [(a, b) for a in range(-6, 7) for b in range(-6, 7) if a * a + b * b <= 36]


@query(Q.query(*MASK, Q.background("g", "m"), "of(a,b) as (values " + ",".join(f"({a},{b})" for a, b in FAR) + ")", 'x as (select g."row"+a as "row", g.col+b as col, min(a*a+b*b) as d2 from g, of group by 1,2)', 'select sm."row"::bigint as "row", sm.col::bigint as col, d2::bigint as d2 from sm left join x on x."row"=sm."row" and x.col=sm.col'))
def distance_squared(spark, d):
    dense = S.dense_mask(V.mask(spark, d), frame(spark, d))
    return S.squared_distance(dense, "bit", "d2", 6).select(*big("row", "col", "d2"))


@query(Q.query(Q.PX, 'k as (select "row",col,q//64 as x,q//86 as y from e)', "d as (select \"row\",col," + ",".join(f"(coalesce(lag({v}) over w,{v})<>{v} or coalesce(lead({v}) over w,{v})<>{v} or coalesce(lag({v}) over c,{v})<>{v} or coalesce(lead({v}) over c,{v})<>{v}) as e{v}" for v in "xy") + f" from k window w as ({ROW}), c as ({COL}))", f"select {PIXEL} from d where ex and ey"))
def watershed_product(spark, d):
    px = V.px_embed(spark, d)
    a, b = px.withColumn("label", F.floor(F.col("q") / 64)), px.withColumn("label", F.floor(F.col("q") / 86))
    return B.watershed_product(a, b).select(*big("row", "col"))


FLOOD = (
    *C4, Q.pixels("lp", "lr"), 'ob as (select "row", col, "row"::bigint*2147483648+col as p, label as obj from lp)', Q.background("bg", "m"),
    'ds as materialized (select ob.p, sqrt(min((ob."row"-bg."row")*(ob."row"-bg."row")+(ob.col-bg.col)*(ob.col-bg.col))::double) as k from ob, bg group by 1)',
    'nb as (select x.p as x, y.p as y, x.obj, x.p*2 as number from ob x join ob y on y."row"=x."row"+1 and y.col=x.col union all select x.p, y.p, x.obj, x.p*2+1 from ob x join ob y on y."row"=x."row" and y.col=x.col+1)',
    "bo as materialized (select x, y, obj, number from nb union all select y, x, obj, number from nb)",
    # shallow maxima of the depth levelled out
    "rc(p, v) using key (p) as (select p, k-1.0 from ds union select bo.y, max(least(ds.k, rc.v)) from rc join bo on bo.x=rc.p join ds on ds.p=bo.y join recurring.rc o on o.p=bo.y where least(ds.k, rc.v)>o.v group by 1)",
    "fi as materialized (select p, round(-v, 9) as f from rc)", "ef as materialized (select bo.*, a.f as fx, b.f as fy from bo join fi a on a.p=bo.x join fi b on b.p=bo.y)", "eq as materialized (select x, y from ef where fx=fy)",
    # plateaus without a lower neighbour are the markers
    "pl(p, l) using key (p) as (select p, p from fi union select eq.y, min(pl.l) from pl join eq on eq.x=pl.p join recurring.pl o on o.p=eq.y where pl.l<o.l group by 1)",
    "lo as (select distinct pl.l from pl join ef on ef.x=pl.p where fy<fx)", "mk as materialized (select pl.p, pl.l as label from pl join fi using (p) where f<0 and pl.l not in (select l from lo))",
    # floods: in each round every object takes its least step, and every dry pixel whose own least step leads to a flood takes that
    "ed as materialized (select x, y, obj, dense_rank() over (order by greatest(fx,fy), least(fx,fy), ((number//4294967296)*1103515245+(number%4294967296)*1220703125)%2147483629, number) as k from ef)", "bk as materialized (select y as p, min(k) as k from ed group by 1)",
    "fl(p, label) using key (p) as (select p, label from mk union select y, label from (select ed.y, f.label, ed.k=bk.k as sure, row_number() over (partition by ed.obj order by ed.k) as z, row_number() over (partition by ed.y order by ed.k) as zy from recurring.fl f join ed on ed.x=f.p join bk on bk.p=ed.y left join recurring.fl g on g.p=ed.y where g.p is null) where z=1 or (zy=1 and sure))",
)


@query(Q.query(*FLOOD, 'select ob."row"::bigint as "row", ob.col::bigint as col, label from fl join ob using (p)'))
def watershed(spark, d):
    """Objects split at narrows."""
    return B.watershed(V.mask(spark, d), frame(spark, d)).select(*big("row", "col", "label"))


@query()
def split_by_depth(spark, d):
    """Objects divided by depth levels; tested on shapes with known parts."""
    return B.split_by_depth(V.mask(spark, d), frame(spark, d), most=2, most_hole=20, element=R.diamond(1)).select(*big(*RUN, "label"))


# -- hulls and contours ----------------------------------------------------------------------------------------------

HULL = (
    *C4, 'en as (select label,"row" as r,min(c0) as lo,max(c1) as hi,sum(c1-c0+1) as n from lr group by 1,2)', "pt as (select distinct label,r,lo as c from en union select label,r,hi from en)", "sz as (select label,sum(n) as n from en group by 1)",
    "ed as (select a.label,a.r as ar,a.c as ac,b.r as br,b.c as bc from pt a join pt b on a.label=b.label and (a.r,a.c)<>(b.r,b.c) where not exists (select 1 from pt p where p.label=a.label and ((b.r-a.r)*(p.c-a.c)-(b.c-a.c)*(p.r-a.r)<0 or ((b.r-a.r)*(p.c-a.c)-(b.c-a.c)*(p.r-a.r)=0 and ((p.r-a.r)*(b.r-a.r)+(p.c-a.c)*(b.c-a.c) not between 0 and (b.r-a.r)*(b.r-a.r)+(b.c-a.c)*(b.c-a.c))))))",
    "ha_ as (select label, abs(sum(ar*bc-br*ac))::bigint as twice, sum(gcd(abs(ar-br)::bigint,abs(ac-bc)::bigint))::bigint as edge from ed group by 1)",
)
ORACLE_SQL["convex_area"] = Q.query(*HULL, "select label, twice/2.0::double as convex_polygon, (twice+edge)/2.0::double+1 as convex_area from ha_ join sz using (label) where n>=4 and twice>0")


STEPS = ",".join(f"({k},{a},{b},{K.PASSED[k]})" for k, (a, b) in enumerate(K.AROUND))


def next_way(bits: str, after: str) -> str:
    """First set bit of eight in a circle, beyond a place."""
    start = f"(({after}+1)%8)"
    turned = f"((({bits}*257) >> {start}) & 255)"
    return f"(({start}+bit_count(({turned} & (-{turned}))-1))%8)::int"


WALKS = (
    *C4, Q.pixels("lp", "lr"), "op as materialized (select * from lp where label in (select label from lp group by 1 having count(*)>=4))", f"di(k, a, b, e) as (values {STEPS})",
    'bt as materialized (select p.label, p."row" as r, p.col as c, sum(case when q.label is not null then 1<<k else 0 end)::int as bits from op p cross join di left join op q on q.label=p.label and q."row"=p."row"+a and q.col=p.col+b group by 1,2,3)',
    f"st as (select label, r, c, bits, {next_way('bits', '6')} as way from (select *, row_number() over (partition by label order by r, c) as z from bt) where z=1)",
    f"wk(label, i, r, c, way, r0, c0, w0) as (select label, 0, r, c, way, r, c, way from st where bits>0 union all select * from (select w.label, w.i+1, bt.r, bt.c, {next_way('bt.bits', 'di.e')} as way, r0, c0, w0 from wk w join di on di.k=w.way join bt on bt.label=w.label and bt.r=w.r+a and bt.c=w.c+b) where (r,c,way)<>(r0,c0,w0))",
)


@query(Q.query(*WALKS, 'select label, i::bigint as i, r::bigint as "row", c::bigint as col from wk union all select label, n::bigint, r, c from st join (select label, max(i)+1 as n from wk group by 1) using (label)'))
def contour_points(spark, d):
    """Closed outer borders of objects."""
    return K.contours(R.keep_sizes(labelled(spark, d), 4)).select("label", *big("i", "row", "col"))


@query()
def psi_curves(spark, d):
    """Angle curves of resampled borders; tested on circles and squares."""
    return K.psi_curves(R.keep_sizes(labelled(spark, d), 12)).select("label", *big("i"), *rounded("psi", "s"))


# -- tracking --------------------------------------------------------------------------------------------------------

PAIR = "h_uuid, uuid, dt_s, round(dx_m,4) as dx_m"


def with_rule(rule: str) -> str:
    head, _, _ = CANDIDATES.partition("pd as (")
    return head + f"pd as (select * from pc where {rule})"


@query(Q.query(*SCENES, with_rule("dx_m < 0.75*dt_s+250"), f"select {PAIR} from pd"))
def pairs_linear(spark, d):
    return T.candidates(scene_objects(spark, d), T.linear_distance).select("h_uuid", "uuid", "dt_s", F.round("dx_m", 4).alias("dx_m"))


@query(Q.query(*SCENES, with_rule("(dt_s<=1200 and dx_m<=3750) or (dt_s<=5400 and dx_m<=7500) or (dt_s<=86400 and dx_m<=30000) or dx_m<=60000"), f"select {PAIR} from pd"))
def pairs_stepwise(spark, d):
    return T.candidates(scene_objects(spark, d), T.stepwise_distance).select("h_uuid", "uuid", "dt_s", F.round("dx_m", 4).alias("dx_m"))


@query(Q.query(*SCENES, CANDIDATES, "select h_uuid, uuid, round(ea,6) as ea, ea<(case when area<700 then 0.43 else 0.17 end)::double as test_area from pd"))
def filter_raw(spark, d):
    """All candidates with the result of the stepwise test of their area."""
    raw = T.filtered(T.candidates(scene_objects(spark, d)), raw=True, threshold=T.stepwise)
    return raw.select("h_uuid", "uuid", F.round("relative_error_area", 6).alias("ea"), "test_area")


GATED = [*SCENES[:-1], SCENES[-1].replace("area>=30", "area between 40 and 90000")]


@query(Q.query(*GATED, CANDIDATES, CHAIN, *track_sql(), "k as (select * from t3 where trajectory_uuid in (select trajectory_uuid from t3 group by 1 having count(*)>=2))", "select uuid, trajectory_uuid, head_uuid, dense_rank() over (order by trajectory_uuid)::bigint as id from k"))
def track_ids(spark, d):
    """Tracking behind the size gate, with integer ids."""
    objects = cut(T.gated(scene_objects(spark, d), 40))
    return T.with_integer_ids(T.track(objects, chain_of(objects))).select("uuid", "trajectory_uuid", "head_uuid", "id")


@query()
def track_whole_chain(spark, d):
    """Labels and times to trajectories with all filters, shapes and curves among them."""
    return T.track_scenes(R.keep_sizes(scene_labels(spark, d), 100), V.scene_times(spark)).select("uuid", "trajectory_uuid", "head_uuid", "id")


@query(Q.query(Q.PX, CURVES, "nn as (select pair, sqrt(sum(v*v) filter (side=0))*sqrt(sum(v*v) filter (side=1)) as nrm, max(i)-min(i) as n from cu group by pair)", "lg as (select pair, nrm, unnest(range(-n,n+1)) as lag from nn)", "ss as (select a.pair, a.i-b.i as lag, sum(a.v*b.v) as s from cu a join cu b on a.pair=b.pair and a.side=0 and b.side=1 where a.i%3=0 and b.i%3=0 group by 1,2)", "nm as (select pair, sqrt(sum(v*v) filter (side=0))*sqrt(sum(v*v) filter (side=1)) as nrm from cu where i%3=0 group by pair)", "select lg.pair::bigint as pair, lg.lag::bigint as lag, round(coalesce(s,0)/nm.nrm,6)+0.0 as r from lg join nm using (pair) left join ss on ss.pair=lg.pair and ss.lag=lg.lag"))
def crosscorr_padded(spark, d):
    """Correlation at every lag, also where curves with gaps have no common place."""
    c = V.px_embed(spark, d).where("col % 3 = 0").select(F.floor(F.col("row") / 2).alias("pair"), (F.col("row") % 2).alias("side"), F.col("col").alias("i"), ((F.col("q") - 128) / F.lit(128.0)).alias("value"))
    return T.cross_correlation(c, padded=True).select(*big("pair", "lag"), *rounded("r"))


# -- registration ----------------------------------------------------------------------------------------------------

MATCHED = (
    *SCENES, CANDIDATES, CHAIN, "hb as (select h_uuid, uuid, row_number() over (partition by h_uuid order by w,uuid) as n from pf)", "tb as (select h_uuid, uuid, row_number() over (partition by uuid order by w,h_uuid) as n from pf)",
    "pr as (select h_uuid as u1, uuid as u2 from hb join tb using (h_uuid, uuid) where hb.n=1 and tb.n=1)",
)
CELLS = (
    *[Q.pixels(f"xp{k}", f"sl{k}") for k in range(4)],
    "px as (" + " union all ".join(f"select '{k}:'||x.label as uuid, \"row\", col, orientation as o from xp{k} x join obj{k} on obj{k}.label=x.label" for k in range(4)) + ")",
    "us as (select u1 as uuid from pr union select u2 from pr)", "cl as (select px.* from px join us using (uuid))",
    'ce as (select uuid, cast(floor(avg("row")) as int) as cr, cast(floor(avg(col)) as int) as cc from cl group by 1)',
    'lc as (select uuid, o, cast("row"-cr as int) as r, cast(col-cc as int) as c from cl join ce using (uuid))',
    "re as (select uuid, any_value(o) as o, cast(ceil(sqrt(max(r*r+c*c))) as int) as m from lc group by 1)",
    "gr as (select uuid, o, tr, unnest(range(-m,m+1)) as tc from (select uuid, o, m, unnest(range(-m,m+1)) as tr from re))",
)


def register_sql(step: int) -> tuple[str, ...]:
    angles = ",".join(f"({float(a)}::double)" for a in range(-180 + step, 181, step))
    return (
        f"an(a) as (values {angles})",
        "sr as (select uuid, a, tr, tc, cast(floor(round(cos(radians(a))*tr+sin(radians(a))*tc,9)+0.5) as int) as r, cast(floor(round(-sin(radians(a))*tr+cos(radians(a))*tc,9)+0.5) as int) as c from gr, an where uuid in (select u1 from pr))",
        "tu as (select sr.uuid, a, tr, tc from sr join lc using (uuid, r, c))", "n1 as (select uuid, a, count(*) as n from tu group by 1,2)", "n2 as (select uuid, count(*) as n from lc group by 1)",
        "co as (select u1, u2, a, count(*) as n from pr join tu on tu.uuid=u1 join lc on lc.uuid=u2 and lc.r=tu.tr and lc.c=tu.tc group by 1,2,3)",
        "df as (select pr.u1, pr.u2, n1.a, n1.n+n2.n-2*coalesce(co.n,0) as difference, n1.n as na, n2.n as nb from pr join n1 on n1.uuid=pr.u1 join n2 on n2.uuid=pr.u2 left join co on co.u1=pr.u1 and co.u2=pr.u2 and co.a=n1.a)",
        "rg as (select u1, u2, a as angle, difference, na, nb from (select *, row_number() over (partition by u1,u2 order by difference, abs(a), -a) as z from df) where z=1)",
    )


ORACLE_SQL["register_angle"] = Q.query(*MATCHED, *CELLS, *register_sql(15), "select u1, u2, angle, difference::bigint as difference from rg")
ORACLE_SQL["shape_difference"] = Q.query(
    *MATCHED, *CELLS,
    "tb_ as (select g.uuid, g.tr, g.tc from (select *, cast(floor(round(cos(o)*tr-sin(o)*tc,9)+0.5) as int) as r, cast(floor(round(sin(o)*tr+cos(o)*tc,9)+0.5) as int) as c from gr) g join lc on lc.uuid=g.uuid and lc.r=g.r and lc.c=g.c)",
    "nz as (select uuid, count(*) as n from tb_ group by 1)", "co as (select u1, u2, count(*) as n from pr join tb_ x on x.uuid=u1 join tb_ y on y.uuid=u2 and y.tr=x.tr and y.tc=x.tc group by 1,2)",
    "df as (select pr.u1, pr.u2, a.n+b.n-2*coalesce(co.n,0) as difference, b.n as nb from pr join nz a on a.uuid=pr.u1 join nz b on b.uuid=pr.u2 left join co on co.u1=pr.u1 and co.u2=pr.u2)",
    "select u1, u2, difference::bigint as difference, round(difference/nb::double,3) as scaled from df",
)


@query(Q.query(*MATCHED, *CELLS, *register_sql(20), "mi as (select u1, u2, a, round(2*difference/(na+nb)::double,9) as m from df where abs(a)<=60)", "select u1, u2, a as angle, round(m,6) as mismatch from (select *, row_number() over (partition by u1,u2 order by m, abs(a), -a) as z from mi) where z=1"))
def mismatch_angle(spark, d):
    from scenetrack.plans.queries import matched_cells

    matched, first, second = matched_cells(spark, d)
    out = T.mismatch(first.drop("orientation"), second.drop("orientation"), matched, 60, 20)
    return out.select("u1", "u2", "angle", F.round("mismatch", 6).alias("mismatch"))


@query(
    Q.query(
        *SCENES, CANDIDATES, CHAIN, *track_sql(), "k as (select * from t3 where trajectory_uuid in (select trajectory_uuid from t3 group by 1 having count(*)>=2))",
        "pr as (select a.uuid as u1, b.uuid as u2, a.trajectory_uuid as id, (b.scene_id-a.scene_id)*7200.0::double as dt from k a join k b on a.trajectory_uuid=b.trajectory_uuid and a.scene_id<b.scene_id)",
        *CELLS, *register_sql(30),
        "select pr.id, pr.u1 as uuid1, pr.u2 as uuid2, dt as dt_sec, angle as theta_deg, round(radians(angle),6)+0.0 as theta_rad, round(radians(angle)/dt*86400,6)+0.0 as omega_rad_per_day, round(angle/dt*86400,6)+0.0 as omega_deg_per_day from pr join rg on rg.u1=pr.u1 and rg.u2=pr.u2",
    )
)
def rotation_rates(spark, d):
    """Turning of every trajectory of the track between its scenes."""
    from scenetrack.plans.queries import objects_of

    labels = scene_labels(spark, d)
    objects = cut(objects_of(spark, labels))
    tracks = T.track(objects, chain_of(objects))
    observed = tracks.select(F.col("trajectory_uuid").alias("id"), F.col("pass_time").alias("time"), "uuid")
    cells = R.explode_runs(labels.join(objects.select("scene_id", "label", "uuid"), ["scene_id", "label"])).select("uuid", "row", "col")
    out = T.rotation_measurements(observed, cells, step=30)
    return out.select(F.col("id1").alias("id"), "uuid1", "uuid2", "dt_sec", "theta_deg", *rounded("theta_rad", "omega_rad_per_day", "omega_deg_per_day"))


