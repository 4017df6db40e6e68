"""Queries of masks, tiles, contrast, segment comparison and geography, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenetrack.functions import geo
from scenetrack.functions import masks as M
from scenetrack.operators import cleaners as N
from scenetrack.operators import clouds as C
from scenetrack.operators import histograms as H
from scenetrack.operators import objects as O
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.operators import tiles as T
from scenetrack.plans import sql as Q
from scenetrack.plans.queries import BOX1, BOX_MEAN, C4, CASES, DISK2, GT, MASK, OBJ, ORACLE_SQL, RUN, RUN_SQL, TWO, base, big, dilate_sql, element_sql, erode_sql, frame, labelled, query, rounded, rsql, tiled, two_labels
from scenetrack.session import shared_folder
from scenetrack.sources import bundle
from scenetrack.sources import views as V

PIXEL = '"row"::bigint as "row", col::bigint as col'

# -- pixel rules -----------------------------------------------------------------------------------------------------

CLOUD = "(b7 > 110/255.0::double and not (b7 < 200/255.0::double and b2 > 190/255.0::double and 0.0*b2 <= b7 and b7 < 0.75*b2))"


@query(
    Q.query(
        Q.BANDS,
        f"""select {PIXEL}, b2>0.3 as bright, b1>0.5 as usable, round(least(0.9,1-greatest(0.0,least(1.0,b1))),6) as alpha,
 round(case when b1>0.5 then 0.0 else b2 end,6) as off_land, round(case when {CLOUD} then 0.0 else b2 end,6) as off_cloud, 0.0::double as dropped,
 least(255,greatest(0,round(b2*255)))::bigint as level, round(0.2989*b7+0.5870*b2+0.1140*b1,6) as grey,
 round(case when b1>0.5 then least(1.0,b2*1.3) else b2 end,6) as brighter, round(1-b2,6) as inverse, round(pow(b2,1.5),6) as power,
 least(255,greatest(0,round(b7*255)-round(b2*255)))::bigint as brighten from b""",
    )
)
def band_rules(spark, d):
    """Every rule that looks at one pixel of a three-band raster."""
    px = V.px_bands(spark, d)
    land, b1, b2, b7 = F.col("b1") > 0.5, F.col("b1"), F.col("b2"), F.col("b7")
    (off_land,), (off_cloud, dropped) = M.zero_where(land, "b2"), M.without_clouds(M.cloud_box(), "b2", "b7", drop="b7")
    inverse, _ = M.each_band(M.complement, "b2", "b7")
    out = px.select(
        "row", "col", M.binarize(b2, 0.3).alias("bright"), M.usable(b1).alias("usable"), M.apply_mask(F.lit(0.9), b1).alias("alpha"), off_land.alias("off_land"), off_cloud.alias("off_cloud"), dropped.alias("dropped"),
        M.to_uint8(b2 * 255).alias("level"), M.grey(b7, b2, b1).alias("grey"), M.brighten(b2, land, 1.3).alias("brighter"), inverse.alias("inverse"), M.gamma(b2, 1.5).alias("power"),
        M.brighten_mask(M.to_uint8(b7 * 255), M.to_uint8(b2 * 255)).alias("brighten"),
    )
    return out.select(*big("row", "col", "level", "brighten"), "bright", "usable", *rounded("alpha", "off_land", "off_cloud", "dropped", "grey", "brighter", "inverse", "power"))


def peak_sql(tag: str, band: str, bins: int, threshold: float, least: float = 0.001) -> tuple[str, ...]:
    """pk_<tag>: left edge of the most prominent peak of a band, infinite without one."""
    return (
        f"hi_{tag} as (select k as bin, coalesce(n,0) as n from (select unnest(range(0,{bins})) as k) left join (select cast(least(floor({band}*{bins}),{bins - 1}) as bigint) as bin, count(*) as n from b group by 1) on bin=k)",
        f"sh_{tag} as (select bin, n, n/(select sum(n) from hi_{tag} where bin/{bins}.0::double>{threshold})::double as s, max(n) over (order by bin rows between 3 preceding and 3 following) as m, lag(n) over (order by bin) as p, lead(n) over (order by bin) as q from hi_{tag})",
        f"tp_{tag} as (select * from sh_{tag} where n=m and n>p and n>q and bin>=3 and bin<{bins - 3})",
        f"wl_{tag} as (select t.bin, t.s, coalesce((select max(x.bin) from sh_{tag} x where x.bin<t.bin and x.s>t.s),-1) as lw, coalesce((select min(x.bin) from sh_{tag} x where x.bin>t.bin and x.s>t.s),{bins}) as rw from tp_{tag} t)",
        f"pr_{tag} as (select bin, s - greatest((select min(x.s) from sh_{tag} x where x.bin<w.bin and x.bin>lw),(select min(x.s) from sh_{tag} x where x.bin>w.bin and x.bin<rw)) as prom from wl_{tag} w)",
        f"pk_{tag} as (select coalesce((select bin/{bins}.0::double from pr_{tag} where prom>={least} order by prom desc, bin limit 1),'infinity'::double) as edge)",
    )


@query(Q.query(Q.BANDS, *peak_sql("two", "b2", 64, 0.3), *peak_sql("one", "b1", 64, 0.3), f"select {PIXEL} from b where b7<0.4 and (b2>(select edge from pk_two) or b1>(select edge from pk_one))"))
def ice_by_peaks(spark, d):
    return H.ice_by_peaks(V.px_bands(spark, d), 0.4, 0.3, bins=64, least=0.001, either=True).select(*big("row", "col"))


@query(Q.query(Q.BANDS, *peak_sql("two", "b2", 64, 0.3), f"select {PIXEL} from b where b2 > 0.5*(0.3+(select case when edge='infinity'::double then 0.3 else edge end from pk_two))"))
def ice_by_midpoint(spark, d):
    return H.ice_by_midpoint(V.px_bands(spark, d), "b2", bins=64, least=0.001).select(*big("row", "col"))


PRESET = [tuple(x / 255 for x in t) for t in M.PRESETS["wide"]]


@query(
    Q.query(
        Q.BANDS,
        "f as (select *, " + ", ".join(f"(b7<{a!r}::double and b2>{b!r}::double and b1>{c!r}::double) as d{i}" for i, (a, b, c) in enumerate(PRESET)) + " from b)",
        "k as (select case " + " ".join(f"when count(*) filter (d{i})>1 then {i}" for i in range(3)) + " end as detector from f)",
        f"select {PIXEL}, detector::bigint as detector from f, k where (detector=0 and d0) or (detector=1 and d1) or (detector=2 and d2)",
    )
)
def ice_preset(spark, d):
    return M.first_detector(V.px_bands(spark, d), M.preset("wide"), 1).select(*big("row", "col", "detector"))


# -- cloud and land masks --------------------------------------------------------------------------------------------

DIAMOND1 = element_sql("k1", R.diamond(1))
OPENED = (*C4, Q.pixels("op", "lr"), BOX1, *erode_sql("y", "m", "b1"), dilate_sql("k", "y", "b1"), 'rc as (select "row",col from op where label in (select label from op join k on op."row"=k."row" and op.col=k.col))')


def filled_sql(name: str, source: str, least: int, most: int) -> tuple[str, ...]:
    return (
        Q.background(f"{name}_g", source), Q.runs(f"{name}_gr", f"{name}_g"), Q.components(f"{name}_lg", f"{name}_gr"),
        Q.pixels(f"{name}_hp", f"(select * from {name}_lg where label in (select label from {name}_lg group by label having sum(c1-c0+1) between {least} and {most}))"),
        f'{name} as (select "row",col from {source} union select "row",col from {name}_hp)',
    )


@query(Q.query(*OPENED, DIAMOND1, *erode_sql("z", "rc", "k1"), dilate_sql("w", "z", "k1"), *filled_sql("x", "w", 0, 12), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def cloud_calibrated(spark, d):
    px = V.px_smooth(spark, d)
    return C.calibrated_clouds(px, frame(spark, d), F.col("s") > 1200, R.box(1), most_filled=12).select(*big(*RUN))


@query(
    Q.query(
        *OPENED, DISK2, dilate_sql("w", "rc", "d2"), Q.background("cg", "w"), Q.runs("cr", "cg"), Q.components("lc", "cr"), Q.pixels("cp", "lc"),
        'lost as (select cp.label from cp join e on cp."row"=e."row" and cp.col=e.col group by cp.label having count(*)<20 or (count(*)<200 and max(q)-min(q)<180))',
        'x as (select "row",col from w union select "row",col from cp where label in (select label from lost))', Q.runs("xr", "x"), f"select {RUN_SQL} from xr",
    )
)
def cloud_objects(spark, d):
    px = V.px_smooth(spark, d)
    return C.object_clouds(px, frame(spark, d), F.col("s") > 1200, R.box(1), "q", 20, 200, 180).select(*big(*RUN))


@query(Q.query(*MASK, DISK2, dilate_sql("w", "m", "d2"), *filled_sql("x", "w", 0, 10), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def coastal_buffer(spark, d):
    buffered, _ = C.land_masks(V.px_smooth(spark, d), frame(spark, d), F.col("s") > 1200, R.disk(2))
    near = C.coastal_buffer(base(spark, d), frame(spark, d), R.disk(2), 0, 10)
    return near.join(buffered.select("scene_id").distinct(), "scene_id", "left_semi").select(*big(*RUN))


@query(Q.query(*C4, Q.pixels("lp", "(select * from lr where label in (select label from lr group by label having sum(c1-c0+1)>=5))"), 'la as (select "row",col from lp)', DIAMOND1, *erode_sql("z", "la", "k1"), dilate_sql("w", "z", "k1"), *filled_sql("x", "w", 1, 6), Q.runs("xr", "x"), f"select {RUN_SQL} from xr"))
def cleaned_mask(spark, d):
    return C.cleaned(base(spark, d), frame(spark, d), 5, 6).select(*big(*RUN))


@query(Q.query(*MASK, Q.background("g", "m"), Q.runs("gr", "g"), Q.components("lg", "gr"), f'select {RUN_SQL}, label from lg where label not in (select label from lg, fr where "row"=0 or "row"=height-1 or c0=0 or c1=width-1) and label in (select label from lg group by label having sum(c1-c0+1)>=2)'))
def mask_holes(spark, d):
    return C.holes_of(base(spark, d), frame(spark, d), 2).select(*big(*RUN, "label"))


# -- tiles -----------------------------------------------------------------------------------------------------------


def band_frame(spark, d):
    return R.frame_of(V.px_bands(spark, d).select("scene_id", "row", "col"))


@query(Q.query(Q.BANDS, 'sd as (select greatest((max("row")+1)//3,1) as sr, greatest((max(col)+1)//3,1) as sc from b)', 'select ("row"//sr)::bigint as tr, (col//sc)::bigint as tc, min("row")::bigint as r0, max("row")::bigint as r1, min(col)::bigint as c0, max(col)::bigint as c1, count(*)::bigint as n from b, sd group by 1,2'))
def tile_blocks(spark, d):
    """Three by three blocks of 100 x 100 pixels: 33 to a side, and a rest of one row and column."""
    return T.tile_meta(T.by_blocks(V.px_bands(spark, d), band_frame(spark, d), 3, 3)).select(*big("tr", "tc", "r0", "r1", "c0", "c1", "n"))


@query(Q.query(Q.BANDS, "t as (select least(\"row\"//30,2) as tr, least(col//30,2) as tc, count(*) filter (b1>0.1) as unmasked, count(*) filter (b1>0.1 and b2>0.85) as likely from b group by 1,2)", "select tr::bigint as tr, tc::bigint as tc, unmasked::bigint as unmasked, likely::bigint as likely from t where unmasked>100 and likely>100"))
def tile_prune(spark, d):
    return T.worth_doing(tiled(spark, d), F.col("b1") > 0.1, F.col("b2") > 0.85, 100).select(*big("tr", "tc", "unmasked", "likely"))


@query(Q.query(Q.PX, BOX_MEAN, f"select {PIXEL}, round(mean,6)+0.0 as mean from bm"))
def box_mean_halo(spark, d):
    """Window means on tiles of 48 pixels with a margin of 5; equal to those of whole scenes."""
    out = T.in_halo_tiles(V.px_embed(spark, d), 5, lambda px: S.box_mean(px, "q", 5, "mean"), side=48)
    return out.select(*big("row", "col"), *rounded("mean"))


@query(
    Q.query(
        Q.PX, 'tl as (select "row"//32 as tr, col//32 as tc, "row", col, q, case when q<75 then 0 else q end as v from e)',
        'ba as (select *, sum(v) over w as hs, count(v) over w as hn from tl window w as (partition by tr,tc,"row" order by col range between 5 preceding and 5 following))',
        'bm as (select *, sum(hs) over v/sum(hn) over v::double as mean from ba window v as (partition by tr,tc,col order by "row" range between 5 preceding and 5 following))',
        f"select {PIXEL} from bm where v > mean*(1-15/100.0::double) and q>=75",
    )
)
def threshold_tiles(spark, d):
    px = V.px_embed(spark, d).withColumn("tr", F.floor(F.col("row") / 32)).withColumn("tc", F.floor(F.col("col") / 32))
    return T.tiled_threshold(px, "q", least_window=10).select(*big("row", "col"))


def kmeans_tile_sql(rounds: int, k: int) -> list[str]:
    out = ["lv as (select tr, tc, q, count(*) as n from tl group by 1,2,3)", f"k0 as (select *, cast(least(floor((2*sum(n) over (partition by tr,tc order by q)-n)/(2*sum(n) over (partition by tr,tc))::double*{k}),{k}-1) as int) as cluster from lv)"]
    for i in range(rounds):
        out.append(f"z{i} as (select tr, tc, row_number() over (partition by tr,tc order by centre)-1 as c, centre from (select tr,tc,sum(q*n)/sum(n)::double as centre from k{i} group by tr,tc,cluster))")
        out.append(f"k{i + 1} as (select tr,tc,q,n,c as cluster from (select lv.*, c, row_number() over (partition by lv.tr,lv.tc,q order by abs(centre-q), c) as best from lv join z{i} z on z.tr=lv.tr and z.tc=lv.tc) where best=1)")
    return out


TILED = 'tl as (select "row"//128 as tr, col//32 as tc, "row", col, q from e)'


def embed_tiles(spark, d):
    return V.px_embed(spark, d).withColumn("tr", F.floor(F.col("row") / 128)).withColumn("tc", F.floor(F.col("col") / 32))


@query(Q.query(Q.PX, TILED, *kmeans_tile_sql(5, 4), "select tr::bigint as tr, tc::bigint as tc, q::bigint as q, cluster::bigint as cluster, ((tr*2+tc)*4+cluster)::bigint as label from k5"))
def kmeans_tiles(spark, d):
    return T.tiled_kmeans(embed_tiles(spark, d), "q").select(*big("tr", "tc", "q", "cluster", "label"))


ICE_CLUSTER = (
    Q.PX, TILED, *kmeans_tile_sql(5, 4), "fl as (select tr,tc,cluster,count(*) as n from tl join k5 using (tr,tc,q) where q>200 group by 1,2,3)",
    "pk as (select tr,tc,cluster from (select *, sum(n) over (partition by tr,tc) as all_, row_number() over (partition by tr,tc order by n desc, cluster) as z from fl) where z=1 and all_>50)",
    "ic as (select tl.* from tl join k5 using (tr,tc,q) join pk using (tr,tc,cluster))",
)


@query(Q.query(*ICE_CLUSTER, f"select {PIXEL} from ic"))
def ice_clusters(spark, d):
    return T.ice_cluster_pixels(embed_tiles(spark, d), "q", F.col("q") > 200, 50).select(*big("row", "col"))


@query(Q.query(*ICE_CLUSTER, f'select ic."row"::bigint as "row", ic.col::bigint as col from ic join sm on sm."row"=ic."row" and sm.col=ic.col where not s>1200'))
def ice_clusters_clear(spark, d):
    """The ice cluster's pixels that are not cloud."""
    ice = T.ice_cluster_pixels(embed_tiles(spark, d), "q", F.col("q") > 200, 50)
    return ice.join(V.mask(spark, d), ["scene_id", "row", "col"], "left_anti").select(*big("row", "col"))


# -- contrast --------------------------------------------------------------------------------------------------------

SHARE = (
    "br as (select b2 from b where b2>0.3)", "en as (select min(b2) as lo, max(b2) as hi from br)",
    "hc as (select k as bin, coalesce(n,0) as n from (select unnest(range(0,100)) as k) left join (select cast(least(floor((b2-lo)/(hi-lo)*100),99) as bigint) as bin, count(*) as n from br, en group by 1) on bin=k)",
    "hp as (select n, lag(n) over (order by bin) as p, lead(n) over (order by bin) as q from hc)", "ht as (select n from hp where n>p and n>q)",
)


@query(Q.query(Q.BANDS, *SHARE, "select round(avg((n>0.6*(select max(n) from ht))::int),6) as share from ht"))
def peak_share(spark, d):
    return H.peak_share(V.px_bands(spark, d), "b2", 100, 0.3).select(F.round("share", 6).alias("share"))


@query(Q.query(Q.BANDS, "select round(avg(b2),6) as mean, round(stddev_samp(b2),6) as std, round(kurtosis_pop(b2),4)+0.0 as kurtosis from b where b2>0.3"))
def band_kurtosis(spark, d):
    m = H.moments(V.px_bands(spark, d).where("b2 > 0.3"), "b2")
    return m.select(*rounded("mean", "std"), *rounded("kurtosis", digits=4))


@query(
    Q.query(
        Q.BANDS, 'tl as (select *, least("row"//30,2) as tr, least(col//30,2) as tc, cast(least(floor(b2*32),31) as int) as bin from b)',
        "c as (select tr,tc,bin,count(*) as n from tl group by 1,2,3)", "p as (select *, n/sum(n) over (partition by tr,tc)::double as p, sum(n) over (partition by tr,tc order by bin)/sum(n) over (partition by tr,tc)::double as eq from c)",
        "en as (select tr,tc,-sum(p*log2(p)) as entropy from p group by 1,2)", "wh as (select tr,tc,avg((b2>0.1)::int) as white from tl group by 1,2)",
        "li as (select tr,tc from en join wh using (tr,tc) where entropy>4.98 and white>0.4)",
        f"select {PIXEL}, round(case when li.tr is null then b2 else eq end,6) as adjusted from tl join p using (tr,tc,bin) left join li using (tr,tc)",
    )
)
def equalize_tiles(spark, d):
    return H.equalize_where(tiled(spark, d), "b2", 32, 4.98, 0.4).select(*big("row", "col"), *rounded("adjusted"))


@query(
    Q.query(
        Q.BANDS, 'sd as (select cast(2*ceil((max("row")+1)/8.0::double) as int) as h, cast(2*ceil((max(col)+1)/8.0::double) as int) as w from b)',
        'bl as (select *, "row"//h as br, col//w as bc, cast(least(floor(b2*32),31) as int) as bin from b, sd)',
        "ct as (select br,bc,bin,count(*) as n, any_value(greatest(floor(1.5*h*w/32.0::double),1)) as lim from bl group by 1,2,3)",
        "sp as (select br,bc,sum(n-least(n,lim))::bigint as spare, sum(n) as all_ from ct group by 1,2)",
        "fi as (select br,bc,all_,k as bin, coalesce((select least(n,lim) from ct where ct.br=sp.br and ct.bc=sp.bc and ct.bin=k),0)+spare//32+(k<spare%32)::int as mass from sp, (select unnest(range(0,32)) as k))",
        "mp as (select br,bc,bin,sum(mass) over (partition by br,bc order by bin)/all_::double as share from fi)", "la as (select max(br) as lr, max(bc) as lc from mp)",
        'pl as (select "row",col,bin,h,w,cast(floor(("row"+h/2)/h::double)-1 as int) as r, cast(floor((col+w/2)/w::double)-1 as int) as c from bl)',
        'wt as (select *, ("row"-(r*h+h/2))/(h-1)::double as y, (col-(c*w+w/2))/(w-1)::double as x from pl)',
        "co(a,z) as (values (0,0),(0,1),(1,0),(1,1))",
        'fo as (select "row",col,bin,least(greatest(r+a,0),lr) as br,least(greatest(c+z,0),lc) as bc,(case when a=1 then y else 1-y end)*(case when z=1 then x else 1-x end) as wgt from wt, co, la)',
        f"select {PIXEL}, round(sum(wgt*share),6)+0.0 as clahe from fo join mp using (br,bc,bin) group by 1,2",
    )
)
def clahe(spark, d):
    out = H.clahe(V.px_bands(spark, d), "b2", band_frame(spark, d), 4, 4, 32, 1.5)
    return out.select(*big("row", "col"), *rounded("clahe"))


BY_RANGE = ORACLE_SQL["clahe"].replace("b as (", "b0 as (", 1).replace("sd as (", 'ra as (select min(b7) as lo, max(b7) as hi from b0), b as (select "row", col, (b7-lo)/(hi-lo) as b2 from b0, ra), sd as (', 1)


@query(BY_RANGE.replace("round(sum(wgt*share),6)+0.0 as clahe from fo join mp using (br,bc,bin) group by 1,2", "round(any_value(lo)+sum(wgt*share)*(any_value(hi)-any_value(lo)),6)+0.0 as b7_even from fo join mp using (br,bc,bin), ra group by 1,2"))
def clahe_by_range(spark, d):
    """The same between the channel's own least and greatest value."""
    out = H.clahe_by_range(V.px_bands(spark, d), ["b7"], band_frame(spark, d), 4, 4, 32, 1.5)
    return out.select(*big("row", "col"), *rounded("b7_even"))


@query()
def branch_bridge(spark, d):
    """Branch points and what bridges them; tested pixel by pixel."""
    return N.branch_bridge(base(spark, d), frame(spark, d)).select(*big(*RUN))


@query()
def split_morphologically(spark, d):
    """Objects divided along leads; tested pixel by pixel."""
    none = base(spark, d).where("false")
    return N.split_morphologically(base(spark, d), none, frame(spark, d), least=4, element=R.diamond(1)).select(*big(*RUN))


@query()
def finished_mask(spark, d):
    """The last clean-up of a segmentation; tested pixel by pixel."""
    return N.finished(base(spark, d), None, frame(spark, d)).select(*big(*RUN))


NAMES = "na as (select case_number, region, s, sat, case when length(case_number::varchar)>3 then case_number::varchar else lpad(case_number::varchar,3,'0') end as number, (select count(*) from lineitem where l_orderkey=case_number and l_returnflag='R') as objects from ca, (select unnest(['aqua','terra']) as sat))"


@query(Q.query(CASES, NAMES, "select case_number, sat as satellite, number||'-'||region||'-100km-'||strftime(s,'%Y%m%d')||'-'||sat||'-250m' as name, case when objects<>0 then 'data/validation_dataset/binary_floes/'||number||'-'||region||'-'||strftime(s,'%Y%m%d')||'-'||sat||'-binary_floes.png' end as path from na"))
def case_names(spark, d):
    """Names and image paths of cases; a case without objects has no path. Returned items count as objects."""
    items = V.read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("case_number")).agg(F.count("*").alias("objects"))
    cases = V.cases(spark, d).withColumn("satellite", F.explode(F.array(F.lit("aqua"), F.lit("terra"))))
    counted = cases.join(items, "case_number", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    named = V.case_path(V.case_names(counted), "binary_floes", "path", objects="objects")
    return named.select("case_number", "satellite", "name", "path")



@query(
    Q.query(
        Q.BANDS,
        "br as (select b2 from b where b2>100/255.0::double)", "en as (select min(b2) as lo, max(b2) as hi from br)",
        "hc as (select k as bin, coalesce(n,0) as n from (select unnest(range(0,155)) as k) left join (select cast(least(floor((b2-lo)/(hi-lo)*155),154) as bigint) as bin, count(*) as n from br, en group by 1) on bin=k)",
        "hp as (select n, lag(n) over (order by bin) as p, lead(n) over (order by bin) as q from hc)", "ht as (select n from hp where n>p and n>q)",
        f"fa as (select (select kurtosis_pop(b2) from br) as k2, (select skewness(b2) from br) as s2, (select kurtosis_pop(b1) from b where b1>100/255.0::double) as k1, (select avg((n>0.6*(select max(n) from ht))::int) from ht) as sh, stddev_samp(b2) as sd, avg(case when not b1>0.9 then (not {CLOUD} and b7>0)::int end) as cl from b)",
        "le as (select case when k2>8 or (k2<2 and k1>8) or (k2<2 and s2<4 and sh<0.1) or sh<0.01 then 50/255.0::double when (cl<0.02 and sd>84/255.0::double) or sd>98.9/255.0::double then 130/255.0::double else 80/255.0::double end as level from fa)",
        f"select {PIXEL}, round(least(1.0,greatest(0.0,(case when b2<=level then 0.0 else b2 end)-3*(case when not {CLOUD} and b7 between 17/255.0::double and 30/255.0::double then b7 else 0.0 end))),6)+0.0 as ice from b, le",
    )
)
def ice_from_water(spark, d):
    return H.ice_from_water(V.px_bands(spark, d), "b2", M.cloud_box(), F.col("b1") > 0.9).select(*big("row", "col"), *rounded("ice"))


# -- segments --------------------------------------------------------------------------------------------------------

EQ = (*C4, Q.pixels("op", "lr"), 'oq as (select op.*, q from op join e on op."row"=e."row" and op.col=e.col)')


def object_pixels(spark, d):
    return R.explode_runs(labelled(spark, d)).select("scene_id", "label", "row", "col")


@query(Q.query(*EQ, "fl as (select label from oq group by label having count(*)<6 and max(q)-min(q)<60)", f"select {PIXEL}, label from oq where label not in (select label from fl)"))
def low_contrast(spark, d):
    return O.without_low_contrast(object_pixels(spark, d), V.px_embed(spark, d), "q", 6, 60).select(*big("row", "col", "label"))


@query(Q.query(*EQ, f"select {PIXEL}, label, round(avg(q) over (partition by label),6) as mean from oq"))
def mean_map(spark, d):
    return O.mean_map(object_pixels(spark, d), V.px_embed(spark, d), "q").select(*big("row", "col", "label"), *rounded("mean"))


@query(Q.query(*C4, f"select {RUN_SQL}, label from lr where label in (select label from lr group by label order by sum(c1-c0+1) desc, label limit 7)"))
def seven_largest(spark, d):
    """Only the labels of a list: the seven largest objects."""
    runs = labelled(spark, d)
    return O.only_labels(runs, R.sizes(runs).orderBy(F.col("area").desc(), "label").limit(7)).select(*big(*RUN, "label"))


@query(Q.query(*C4, Q.pixels("op", "lr"), f'select sm."row"::bigint as "row", sm.col::bigint as col, op.label is not null as mask from sm left join op on op."row"=sm."row" and op.col=sm.col'))
def segment_binary(spark, d):
    dense = V.px_embed(spark, d).select("scene_id", "row", "col").join(object_pixels(spark, d), ["scene_id", "row", "col"], "left")
    return O.binary_segments(dense).select(*big("row", "col"), "mask")


@query(Q.query(*C4, "mb as (select label, min(\"row\") as r0, min(c0) as k0 from lr group by label having sum(c1-c0+1)>3)", Q.pixels("op", "lr"), 'select label, ("row"-r0)::bigint as r, (col-k0)::bigint as c from op join mb using (label)'))
def object_masks(spark, d):
    return O.cropped_masks(labelled(spark, d), 3).select(*big("label", "r", "c"))


@query(Q.query(*C4, "select round(sum(c1-c0+1)/(select height*width from fr)::double,6) as labelled_fraction, count(distinct label)::bigint as label_count from lr"))
def seg_summary(spark, d):
    return O.summary(object_pixels(spark, d), frame(spark, d)).select(*rounded("labelled_fraction"), "label_count")


SWEEP = [Q.PX, "tr as (" + " union all ".join(f'select {k} as scene_id, "row"+{k} as "row", col+{2 * k} as col from sm where s>{1200 - 10 * k}' for k in range(4)) + ")", "me as (" + " union all ".join(f'select {k} as scene_id, "row", col from sm where s>{1180 + 10 * k}' for k in range(3)) + ")"]
SWEEP += ['bo as (select coalesce(tr.scene_id,me.scene_id) as scene_id, count(tr.col) as nv, count(me.col) as nm, count(tr.col+me.col) as n from tr full join me on tr.scene_id=me.scene_id and tr."row"=me."row" and tr.col=me.col group by 1)']
SWEEP += ["sc as (select scene_id, n/nullif(nv,0)::double as recall, n/nullif(nm,0)::double as precision, nm>0 as success from bo)", "sf as (select *, 2*recall*precision/nullif(recall+precision,0) as f_score from sc)"]


def sweep(spark, d):
    """Four cases, of which one was not measured."""
    k = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k")
    measured = V.px_smooth(spark, d).select("row", "col", "s", k).where(F.col("s") > 1180 + 10 * F.col("k")).select(F.col("k").alias("scene_id"), "row", "col")
    return O.validation(V.scenes(spark, d), measured, V.scene_times(spark))


@query(Q.query(*SWEEP, f"select scene_id::bigint as scene_id, 'r0' as region, success, {rsql('recall', 'precision', 'f_score')} from sf"))
def validation_sweep(spark, d):
    return sweep(spark, d).select(*big("scene_id"), "region", "success", *rounded("recall", "precision", "f_score"))


@query(Q.query(*SWEEP, "select 'r0' as region, round(avg(recall),6) as mean_recall, round(avg(precision),6) as mean_precision, round(avg(f_score),6) as mean_f_score, count(*) filter (success)::bigint as measured, count(*)::bigint as cases from sf"))
def validation_means(spark, d):
    return O.mean_scores(sweep(spark, d), "region").select("region", *rounded("mean_recall", "mean_precision", "mean_f_score"), *big("measured", "cases"))


def side_sql(k: str, pixels: str, reach: int) -> tuple[str, ...]:
    """t_<k>: area, centroid, perimeter, circularity, mean, outer mean and contrast of the objects of a pixel table."""
    near = ",".join(f"({a},{b})" for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach)
    return (
        f"nb_{k} as (select p.label, p.\"row\", p.col, count(q.col) as n from {pixels} p cross join (values (0,1),(0,-1),(1,0),(-1,0)) f(a,b) left join {pixels} q on q.label=p.label and q.\"row\"=p.\"row\"+a and q.col=p.col+b group by 1,2,3)",
        f'bo_{k} as (select label,"row",col from nb_{k} where n<4)',
        f"cd_{k} as (select p.label, p.\"row\", p.col, sum(w) as code from bo_{k} p cross join (values (0,0,1),(0,1,2),(0,-1,2),(1,0,2),(-1,0,2),(1,1,10),(1,-1,10),(-1,1,10),(-1,-1,10)) f(a,b,w) join bo_{k} q on q.label=p.label and q.\"row\"=p.\"row\"+a and q.col=p.col+b group by 1,2,3)",
        f"pe_{k} as (select label, sum(case when code in (5,7,15,17,25,27) then 1.0::double when code in (21,33) then sqrt(2.0::double) when code in (13,23) then (1+sqrt(2.0::double))/2 else 0.0::double end) as perimeter from cd_{k} group by label)",
        f"ex_{k} as (select \"row\"+a as rr, col+b as cc, min((a*a+b*b)*cast(1e15 as bigint)+label) as best from {pixels}, (values {near}) f(a,b) group by 1,2)",
        f"ou_{k} as (select best%cast(1e15 as bigint) as label, avg(q) as outer_ from ex_{k} join e on e.\"row\"=rr and e.col=cc where best>=cast(1e15 as bigint) group by 1)",
        f"t_{k} as (select p.label, count(*) as area, avg(p.\"row\") as r, avg(p.col) as c, any_value(perimeter) as perimeter, 4*pi()*count(*)/nullif(any_value(perimeter)*any_value(perimeter),0) as circularity, avg(q) as mean, any_value(outer_) as outer_, avg(q)-any_value(outer_) as contrast from {pixels} p join e on e.\"row\"=p.\"row\" and e.col=p.col join pe_{k} using (label) left join ou_{k} using (label) group by 1)",
    )


RELEVANT = (
    *TWO,
    'sh as (select pa.label as a, pb.label as b, count(*) as n from pa join pb on pa."row"=pb."row" and pa.col=pb.col group by 1,2)',
    'na as (select label, count(*) as n, round_even(avg("row"),0) as r, round_even(avg(col),0) as c from pa group by label)',
    'nb as (select label, count(*) as n, round_even(avg("row"),0) as r, round_even(avg(col),0) as c from pb group by label)',
    'rl as (select a, b from sh join na on na.label=a join nb on nb.label=b where 2*sh.n>na.n or 2*sh.n>nb.n union select na.label, pb.label from na join pb on pb."row"=na.r and pb.col=na.c union select pa.label, nb.label from nb join pa on pa."row"=nb.r and pa.col=nb.c)',
)
COMPARE = (*RELEVANT, *side_sql("x", "pa", 3), *side_sql("y", "pb", 3), "cm as (select a, b, sqrt((x.r-y.r)*(x.r-y.r)+(x.c-y.c)*(x.c-y.c)) as distance, abs(x.area-y.area)/(x.area+y.area)::double as area_error, x.area as a1, y.area as a2, x.circularity as f1, y.circularity as f2, x.contrast as k1, y.contrast as k2 from rl join t_x x on x.label=a join t_y y on y.label=b)")


def two_labelled(spark, d):
    return labelled(spark, d), R.components(R.runs_of(V.mask(spark, d, 1170)))


@query(Q.query(*COMPARE, "select a as s1_label, b as s2_label, round(distance,6)+0.0 as distance, round(area_error,6)+0.0 as area_error, round(f1,6)+0.0 as s1_circularity, round(f2,6)+0.0 as s2_circularity, round(k1,6)+0.0 as s1_contrast, round(k2,6)+0.0 as s2_contrast from cm"))
def compare_objects(spark, d):
    out = O.compare_objects(*two_labelled(spark, d), V.px_embed(spark, d), "q", 3)
    return out.select("s1_label", "s2_label", *rounded("distance", "area_error", "s1_circularity", "s2_circularity", "s1_contrast", "s2_contrast"))


MERGE = (
    *COMPARE,
    "g1_ as (select * from (select *, row_number() over (partition by a order by round(area_error,9), a, b) as z from cm where distance<10 and area_error<0.25) where z=1)",
    "g2_ as (select * from (select * exclude (z), row_number() over (partition by b order by round(area_error,9), a, b) as z from g1_) where z=1)",
    "one as (select distinct case when round(f1,9)>round(f2,9) then 1 else 2 end as source, case when round(f1,9)>round(f2,9) then a else b end as label from g2_)",
    "evr as (select 1 as source, label, area from t_x union all select 2, label, area from t_y)", "lge as (select source, label from evr where area>=8)",
    'tou as (select distinct pa.label as p, pb.label as q from pa join pb on pa."row"=pb."row" and pa.col=pb.col)', "tt as (select 1 as source, p as label, q as other from tou union all select 2, q, p from tou)",
    "lst as (select 3-tt.source as source, tt.other as label from tt join one using (source,label))",
    "stl as (select * from lge where not exists (select 1 from one o where o.source=lge.source and o.label=lge.label) and not exists (select 1 from lst o where o.source=lge.source and o.label=lge.label))",
    "opn as (select * from cm where exists (select 1 from stl where source=1 and label=a) or exists (select 1 from stl where source=2 and label=b))",
    "b1_ as (select * from (select *, row_number() over (partition by a order by round(k2,9), b) as z from opn) where z=1)", "b2_ as (select * from (select *, row_number() over (partition by b order by round(k1,9), a) as z from opn) where z=1)",
    "two as (select distinct case when round(k1,9)>round(k2,9) then 1 else 2 end as source, case when round(k1,9)>round(k2,9) then a else b end as label from (select * from b1_ union all select * from b2_))",
    "twk as (select two.* from two join stl using (source,label))",
    "thr as (select source, label from evr where not exists (select 1 from cm where (source=1 and a=label) or (source=2 and b=label)))",
    "fin as (select * from one union select * from twk union select * from thr)",
)


@query(Q.query(*MERGE, "select source::bigint as source, label from fin join lge using (source,label)"))
def merged_objects(spark, d):
    return O.merged_labels(*two_labelled(spark, d), V.px_embed(spark, d), "q", least_area=8, distance=3).select(*big("source"), "label")


@query(
    Q.query(
        *COMPARE, Q.mask("co_", 1500), Q.mask("cl_", 1300),
        'hid as (select pa.label, count(*) as n from pa join cl_ on cl_."row"=pa."row" and cl_.col=pa.col group by 1)',
        "select label from t_x left join hid using (label) where label not in (select label from pa join co_ on co_.\"row\"=pa.\"row\" and co_.col=pa.col) and area between 3 and 200 and case when coalesce(hid.n,0)/area::double>0.5 then area>=6 and mean>=170 and circularity>=0.5 else mean>=150 and circularity>=0.3 end",
    )
)
def fit_objects(spark, d):
    coast = R.runs_of(V.mask(spark, d, 1500))
    out = O.fit_objects(labelled(spark, d), V.px_embed(spark, d), coast, V.mask(spark, d, 1300), "q", 3, 200, 6, 150, 170)
    return out.select("label").distinct()


# -- geography and catalog -------------------------------------------------------------------------------------------


@query(Q.query(Q.PX, f'xy as (select "row", col, ({GT[0]}+(col+0.5)*{GT[1]})::double as x, ({GT[3]}+("row"+0.5)*({GT[5]}))::double as y from sm)', f"select {PIXEL}, round(x,4) as x, round(y,4) as y, round(degrees(x/6378137.0::double),6)+0.0 as lon, round(degrees(2*atan(exp(y/6378137.0::double))-pi()/2),6)+0.0 as lat from xy"))
def lat_lon_grid(spark, d):
    out = geo.with_lat_lon(V.px_embed(spark, d), GT, 3857)
    return out.select(*big("row", "col"), *rounded("x", "y", digits=4), *rounded("lon", "lat"))


@query("with r as (select s_suppkey, (s_suppkey*37)%360-180.0::double as lon, (s_suppkey*11)%160-80.0::double as lat from supplier), p as (select s_suppkey, round(radians(lon)*6378137.0::double) as x, round(ln(tan(pi()/4+radians(lat)/2))*6378137.0::double) as y from r) select s_suppkey::bigint as region, x-50000 as \"left\", y-30000 as lower, x+50000 as \"right\", y+30000 as upper from p")
def region_boxes(spark, d):
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("region"), ((F.col("s_suppkey") * 37) % 360 - F.lit(180.0)).alias("lon"), ((F.col("s_suppkey") * 11) % 160 - F.lit(80.0)).alias("lat"))
    return s.select("region", *geo.region_box(F.col("lon"), F.col("lat"), 3857, F.lit(100_000.0), F.lit(60_000.0)))


@query(Q.query(*C4, OBJ, "select label, round(area*0.0625::double,6) as area, round(major_axis_length*0.25::double,6)+0.0 as major_axis_length, round(minor_axis_length*0.25::double,6)+0.0 as minor_axis_length from obj where area>=4"))
def object_units(spark, d):
    return geo.in_units(O.object_table(labelled(spark, d), 3), GT).select("label", *rounded("area", "major_axis_length", "minor_axis_length"))


@query(Q.query(*C4, OBJ, "select label as floe, round(row_centroid)::bigint as y, round(col_centroid)::bigint as x from obj where area>=4"))
def object_columns(spark, d):
    """Renamed columns, centroids as whole pixels."""
    o = O.object_table(labelled(spark, d), 3).select("label", "row_centroid", "col_centroid")
    return O.renamed(o, {"label": "floe", "row_centroid": "y", "col_centroid": "x"}, ("row_centroid", "col_centroid"))




@query(Q.query(CASES, "select case_number, region, s as start from ca where region='ASIA' order by s desc, case_number limit 40 offset 5"))
def case_subset(spark, d):
    some = V.subset(V.cases(spark, d), F.col("region") == "ASIA", [F.col("start").desc(), F.col("case_number")], 5, 40)
    return some.select("case_number", "region", "start")


@query("with c as (select distinct user_id as case_number, cast(ts as date) as s from events), x as (select case_number, cast(s + cast(i as int) as date) as day, sat as satellite from c, (select unnest(range(0,2)) as i), (select unnest(['aqua','terra']) as sat)), f as (select cast(ts as date) as day, case when user_id%2=0 then 'aqua' else 'terra' end as satellite, min(ts) as pass_time from events group by 1,2) select x.case_number, x.day, x.satellite, f.pass_time from x left join f using (day, satellite)")
def case_overpass(spark, d):
    seen = V.observations(spark, d)
    days = seen.select(F.col("id").alias("case_number"), F.to_date("time").alias("start")).distinct().withColumn("end", F.date_add("start", 1))
    passes = seen.select("time", F.when(F.col("id") % 2 == 0, "aqua").otherwise("terra").alias("satellite"))
    return V.with_overpass(V.expand_cases(days), passes).select("case_number", "day", "satellite", "pass_time")


# -- scene bundles ---------------------------------------------------------------------------------------------------


@query(Q.query(Q.BANDS, f"select {PIXEL}, round(b7,9) as b7, b2>0.3 as bright, (\"row\"*1000003::bigint+col*7919)::bigint as label from b"))
def bundle_round_trip(spark, d):
    """Bands, a mask and labels beyond 8 bits, written as scene bundles and read back."""
    made = V.px_bands(spark, d).select("scene_id", "row", "col", "b7", (F.col("b2") > 0.3).alias("bright"), (F.col("row") * F.lit(1_000_003).cast("bigint") + F.col("col") * 7_919).alias("label"))
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.write_bundles(made, path, "EPSG:3413", {"b7": "1"}, {"b7": "image", "bright": "mask", "label": "label"})
    return bundle.read_bundles(spark, path).select(*big("row", "col"), F.round("b7", 9).alias("b7"), "bright", "label")
