"""DuckDB SQL of the shared views, as common table expressions for the queries' oracles."""

from __future__ import annotations

ID = "2147483648"

PX = """e as (select 0 as scene_id, cast(vec_id as int) as "row", cast(i-1 as int) as col,
 cast(least(255, greatest(0, floor((cast(embedding[i] as double)+0.5)*256))) as int) as q
 from embeddings, (select unnest(range(1,65)) as i)),
ha as (select "row",col, q+coalesce(lag(q) over w,q)+coalesce(lead(q) over w,q) as hs from e window w as (partition by "row" order by col)),
sm as (select "row",col, hs+coalesce(lag(hs) over v,hs)+coalesce(lead(hs) over v,hs) as s from ha window v as (partition by col order by "row")),
fr as (select max("row")+1 as height, max(col)+1 as width from sm)"""

BANDS = """b as (select cast(l_partkey%100 as int) as "row", cast(l_suppkey%100 as int) as col,
 cast(((sum(cast(l_quantity as bigint))*7 )%256)/cast(255.0 as double) as double) as b7,
 cast(((sum(cast(l_quantity as bigint))*13)%256)/cast(255.0 as double) as double) as b2,
 cast(((sum(l_linenumber)*29)%256)/cast(255.0 as double) as double) as b1 from lineitem group by 1,2)"""


def mask(name: str, threshold: int = 1200) -> str:
    return f'{name} as (select "row",col from sm where s > {threshold})'


def runs(name: str, pixels: str) -> str:
    """Runs (id, row, c0, c1) of a pixel table."""
    return f"""{name} as (select "row"::bigint*{ID}+min(col) as id, "row", min(col) as c0, max(col) as c1
 from (select "row",col, col-row_number() over (partition by "row" order by col) as g from {pixels}) group by "row", g)"""


def components(name: str, source: str, reach: int = 0) -> str:
    """Runs of source with label, by a recursive query."""
    return f"""{name}_e as (select a.id as x, b.id as y from {source} a join {source} b on b."row"=a."row"+1 and a.c0<=b.c1+{reach} and b.c0<=a.c1+{reach}),
{name}_u as (select x,y from {name}_e union all select y,x from {name}_e),
{name}_c(id,l) as (select id,id from {source} union select u.y, c.l from {name}_c c join {name}_u u on u.x=c.id where c.l<u.y),
{name} as (select r.id, r."row", r.c0, r.c1, k.label from {source} r join (select id, min(l) as label from {name}_c group by id) k using (id))"""


def pixels(name: str, labelled: str) -> str:
    return f'{name} as (select label, "row", unnest(range(c0, c1+1)) as col from {labelled})'


def background(name: str, pixels_of: str) -> str:
    return f'{name} as (select "row", col from sm where not exists (select 1 from {pixels_of} p where p."row"=sm."row" and p.col=sm.col))'


def query(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


OBJECTS = """mo as (select label, cast(sum(n) as bigint) as n, sum(r*n) as r, sum(c) as c, sum(r*r*n) as rr, sum(cc) as cc, sum(r*c) as rc,
 min(r) as min_row, max(r) as max_row, min(c0) as min_col, max(c1) as max_col
 from (select label, cast("row" as bigint) as r, c0, c1, c1-c0+1 as n, cast((c0+c1)*(c1-c0+1)//2 as bigint) as c,
  cast(c1*(c1+1)*(2*c1+1)//6 - (c0-1)*c0*(2*c0-1)//6 as bigint) as cc from {0}) group by label),
ob as (select *, cast(n*rr-r*r as double)/n as m20, cast(n*cc-c*c as double)/n as m02, cast(n*rc-r*c as double)/n as m11 from mo),
obj as (select label, n as area, r/cast(n as double) as row_centroid, c/cast(n as double) as col_centroid, min_row, max_row, min_col, max_col,
 4*sqrt(greatest(m20+m02+sqrt((m20-m02)*(m20-m02)+4*m11*m11),0)/2/n) as major_axis_length,
 4*sqrt(greatest(m20+m02-sqrt((m20-m02)*(m20-m02)+4*m11*m11),0)/2/n) as minor_axis_length,
 0.5*atan2(2*m11, m20-m02) as orientation from ob)"""
