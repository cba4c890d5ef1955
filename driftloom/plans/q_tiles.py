"""Queries of text tiles, profiles, regions, evidence, telemetry and stream thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import evidence as E
from driftloom.operators import tiles as TL
from driftloom.plans.q_more import r6
from driftloom.plans.roles import EDGES, NATION_EDGES, PIXELS, TOKENS, graph, nation_graph, pixels, t, tokens

LABELS = ("Call", "Expr", "Assign", "If", "Return", "FunctionDef", "Name")


def cells(s, d):
    return pixels(s, d).select("image", F.col("y").alias("row"), F.col("x").alias("col"), F.col("g").alias("edge"))


def profiled(s, d):
    depth = F.transform(F.split("text", "\n"), lambda v: F.size(F.split(v, " ")))
    calls = F.transform(F.split("text", "\n"), lambda v: TL.occurrences(v, ","))
    return TL.row_profile(t(s, d, "documents").select("doc_id", depth.alias("depth"), calls.alias("calls")), "doc_id", "depth", "calls")


def blocks(s, d):
    return pixels(s, d).groupBy("image", F.floor(F.col("x") / 4).alias("bi"), F.floor(F.col("y") / 4).alias("bj")).agg((F.avg("g") * 4 - 1.5).alias("value"))


def centres(s, d):
    return pixels(s, d).filter("x % 2 = 0 and y % 2 = 0").select("image", (F.col("x") + 1).alias("cx"), (F.col("y") + 1).alias("cy"))


def regions(s, d):
    q = cells(s, d).groupBy("image").agg(F.percentile("edge", 0.25).alias("q25"), F.percentile("edge", 0.75).alias("q75"))
    x = q.select("*", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return x.select("image", "label", TL.region_for(F.col("label"), F.col("q25"), F.col("q75"), 0.5).alias("region"), TL.region_for(F.col("label"), F.col("q25"), F.col("q75"), 0.5, ["Name"], True, True, 0.05).alias("policy"))


def effects(s, d):
    return t(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber % 3 = 0 then cast(l_quantity as double) end as edge", "case when l_linenumber % 3 = 1 then cast(l_discount as double) * 50 end as impact", "cast(l_quantity as double) as dS", "cast(-l_tax as double) as dH", "case when l_linenumber > 4 then cast(l_linenumber as double) end as dZ")


def energies(s, d):
    x = tokens(s, d).withColumn("module", F.split("file", "/")[0])
    w = {"ADD_FN": 0.08, "MODIFY_SIG_FN": 0.22, "DEL_CLASS": 0.35, "ΔIMPORT+": 0.05}
    return r6(E.energy(x, ["module", "commit"], w, [("^docs/", {"DEL_CLASS": 0.0})], F.col("value") > 60, F.col("k") > 90), "raw", "energy")


def runs(s, d):
    x = t(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 10).alias("j"), (F.col("p_partkey") % 10 / 10).alias("align"), (F.col("p_retailprice") / 1000).alias("ast"), (F.col("p_partkey") % 5).alias("to"))
    return r6(E.best_run(x.withColumn("score", F.round(E.objective(F.col("j"), F.col("align"), F.col("ast"), F.col("to")), 9)), "p_brand", "p_partkey"), "score")


def metrics(s, d):
    x = t(s, d, "events").selectExpr("user_id as run", "event_id % 4 as stage", "case when event_id % 3 = 0 then 'in' else 'out' end as side", "event_type as key", "value")
    return x.filter("stage <> run % 4")


def steps(s, d):
    return t(s, d, "events").selectExpr("user_id as run", "event_id % 4 as stage")


def tree(s, d):
    return t(s, d, "part").selectExpr("p_partkey as id", "nullif(p_partkey div 2, 0) as parent", "p_size as weight")


def checked(s, d):
    n, e = graph(s, d)
    n = n.withColumn("kind", F.when(~F.col("id").endswith("7"), F.col("kind"))).withColumn("label", F.when(~F.col("id").endswith("77"), F.col("label")))
    e = e.withColumn("weight", F.when(F.col("dst").endswith("3"), float("nan")).when(~F.col("dst").endswith("4"), F.col("weight"))).withColumn("src", F.when(~F.col("dst").endswith("9"), F.col("src")))
    found = n.select(F.lit("node").alias("part"), F.explode(E.node_errors()).alias("error")).unionByName(e.select(F.lit("edge").alias("part"), F.explode(E.edge_errors()).alias("error")))
    return found.groupBy("part", "error").agg(F.count("*").alias("n"))


def evidence(s, d):
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity") - 3).cast("double")).alias("v"), F.max("l_discount").alias("a"), F.max("l_tax").alias("b"))
    return x.select("l_orderkey", E.evidence_valid(F.col("v"), F.col("a"), F.col("b"), F.lit(0.09)).alias("valid"))


def counted(s, d):
    x = t(s, d, "part").selectExpr("p_brand", "element_at(array('topic.publish','Topic.Subscribe','topic.request_reply','mode'), cast(p_partkey % 4 + 1 as int)) as key", "case when p_partkey % 3 = 0 then split(p_name, ' ') end as items")
    return E.tag_counters(x, "p_brand")


def preset(s, d):
    n, e = nation_graph(s, d)
    a = n.filter("id % 5 = 0").selectExpr("id as lens", "id")
    return E.preset_window("module-focus", n, e.withColumn("kind", F.lit("call")), a).select("lens", "id", F.col("dist").cast("int").alias("dist"))


CELLS = f'(select image, y as "row", x as col, g as edge from {PIXELS})'
MASK = f"m as (select * from {CELLS} where edge > 0.62), adj as (select a.*, b.\"row\" as r2, b.col as c2, b.edge as e2 from m a join m b on a.image=b.image and abs(a.\"row\"-b.\"row\")+abs(a.col-b.col)=1)"
OCC = lambda x, k: f"(length({x})-length(replace({x},'{k}','')))/{len(k)}.0"
SCORE = "+".join([f"{w}*{OCC('low', k)}" for k, w in TL.KEYWORDS.items()] + [f"0.2*{OCC('low', '(')}", f"0.2*{OCC('low', '.')}", "case when length(v)-length(ltrim(v))>=8 then 0.2 else 0 end", "case when length(v)-length(ltrim(v))>=16 then 0.2 else 0 end"])
OVER = lambda c: f"case when max({c}) over (partition by doc_id)>0 then {c}/max({c}) over (partition by doc_id) else 0 end"
PROFILE = f"""l as (select doc_id, string_split(text,chr(10)) l from documents), v as (select doc_id, len(l) n, unnest(l) v, unnest(generate_series(1,len(l))) i from l),
 b as (select doc_id, n, r, least(r*n//24+1, n) lo, greatest((r+1)*n//24, least(r*n//24+1, n)) hi from (select doc_id, len(l) n, unnest(generate_series(0,23)) r from l)),
 p as (select b.doc_id, r, cast(max(len(string_split(v,' '))) as double) d, sum(length(v)-length(replace(v,',',''))) c from b join v on b.doc_id=v.doc_id and i between lo and hi group by 1,2),
 q as (select doc_id, r, {OVER("d")} as depth, {OVER("c")} as calls from p)"""
ENERGY = f"""select module, "commit", round(raw,6) as raw, round(case when hi>lo then (raw-lo)/(hi-lo) else 0 end,6) as energy from (select *, min(raw) over (partition by module) lo, max(raw) over (partition by module) hi from
 (select split_part(file,'/',1) as module, "commit", sum(case type when 'ADD_FN' then 0.08 when 'MODIFY_SIG_FN' then 0.22 when 'DEL_CLASS' then case when file like 'docs/%' then 0 else 0.35 end when 'ΔIMPORT+' then 0.05 else 0 end)::double + max(case when value>60 then 0.2 else 0 end) + max(case when k>90 then 0.1 else 0 end) as raw from {TOKENS} group by 1,2))"""
METRICS = "(select user_id as run, event_id%4 as stage, case when event_id%3=0 then 'in' else 'out' end as side, event_type as key, value from events where event_id%4<>user_id%4)"

QUERIES = {
    "a39_text_tiles": (
        lambda s, d: r6(TL.text_tiles(t(s, d, "documents"), "doc_id"), "edge", "entropy"),
        f"""with l as (select doc_id, l, n, side, greatest(1, cast(ceil(n/cast(side*side as double)) as int)) step from (select *, cast(ceil(sqrt(greatest(4, ceil(n/12.0)))) as int) side from (select doc_id, string_split(text,chr(10)) l, len(string_split(text,chr(10))) n from documents))),
 v as (select doc_id, step, v, lower(trim(v, '{TL.WHITE}')) low, i from (select doc_id, step, unnest(l) v, unnest(generate_series(0,n-1)) i from l)),
 ch as (select doc_id, i, ch, count(*) c from (select doc_id, i, unnest(regexp_extract_all(low,'(?s).')) ch from v) group by 1,2,3),
 en as (select doc_id, i, least(1.0,(log2(sum(c))-sum(c*log2(c))/sum(c))/log2(least(256,greatest(2,count(*))))) h from ch group by 1,2),
 g as (select v.doc_id, i//step tile, round(sum({SCORE}),9) s, sum(coalesce(h,0))/count(*) e from v left join en using (doc_id, i) group by 1,2),
 a as (select doc_id, side, tile, coalesce(s,0) s, coalesce(e,0) e from (select doc_id, side, unnest(generate_series(0,side*side-1)) tile from l) left join g using (doc_id, tile))
 select doc_id, side, cast(tile as int) as tile, round(case when max(s) over w>0 then s/max(s) over w else 0 end,6) as edge, round(e,6) as entropy, row_number() over (partition by doc_id order by s desc, tile) <= greatest(1, floor(side*side*0.1)) as roi from a window w as (partition by doc_id)""",
    ),
    "a41_row_profile": (lambda s, d: r6(profiled(s, d), "depth", "calls"), f"with {PROFILE} select doc_id, cast(r as int) as row, round(depth,6) as depth, round(calls,6) as calls from q"),
    "a41_relation": (lambda s, d: r6(TL.relation(profiled(s, d), "doc_id", "depth", "calls"), "rho"), f"with {PROFILE} select doc_id, round(case when min(depth)=max(depth) or min(calls)=max(calls) then 0 else coalesce(corr(depth,calls),0) end,6) as rho from q group by 1"),
    "a42_mask_profile": (
        lambda s, d: r6(TL.mask_profile(cells(s, d), "image", 8, 8, 0.62).withColumn("aligned", TL.alignment(F.col("alpha"), F.col("beta"), F.col("Z"), F.lit(64), F.lit(0.5), F.lit(0.5))), "alpha", "beta", "aligned"),
        f"""with recursive {MASK}, r as (select image, "row", col, "row"*8+col lab from m union select a.image, a.r2, a.c2, r.lab from r join adj a on a.image=r.image and a."row"=r."row" and a.col=r.col),
 z as (select image, count(*) z from (select image, "row", col, min(lab) lab from r group by 1,2,3) where lab="row"*8+col group by 1), h as (select image, count(*) filter (where edge>0.62) h from {CELLS} group by 1)
 select image, h as H, coalesce(z,0) as Z, cast(16 as bigint) as S, round(16.0/(16+h),6) as alpha, round(h/(16.0+h),6) as beta, round(1-least(1.0,2*abs(16.0/(16+h)-0.5)+0.4*coalesce(z,0)/64.0),6) as aligned from h left join z using (image)""",
    ),
    "a43_impact": (
        lambda s, d: TL.impact(effects(s, d), "l_orderkey").select("l_orderkey", "l_linenumber", "value"),
        "select l_orderkey, l_linenumber, case when max(v) over w>0 then v/max(v) over w else 0 end as value from (select l_orderkey, l_linenumber, greatest(0.0, case l_linenumber%3 when 0 then l_quantity when 1 then l_discount*50 else l_quantity+l_tax+case when l_linenumber>4 then 0.25*l_linenumber else 0 end end)::double v from lineitem) window w as (partition by l_orderkey)",
    ),
    "a51_region_stats": (
        lambda s, d: r6(TL.region_stats(cells(s, d), "image", 0.62), "contrast", "degree", "density", "cohesion", "coverage"),
        f"with {MASK}, e as (select image, count(*)//2 l, avg(abs(edge-e2)) c from adj group by 1), z as (select image, count(*) n, count(*) filter (where edge>0.62) k from {CELLS} group by 1) select image, n as cells, k as size, coalesce(l,0) as links, round(coalesce(c,0),6) as contrast, round(2.0*coalesce(l,0)/greatest(k,1),6) as degree, round(coalesce(l,0)/greatest(k,1)::double,6) as density, round(1-coalesce(c,0)/2,6) as cohesion, round(k/n::double,6) as coverage from z left join e using (image)",
    ),
    "j23_cell_values": (
        lambda s, d: r6(TL.cell_values(centres(s, d), blocks(s, d), "image", 8, 8), "value"),
        f"with b as (select image, x//4 bi, y//4 bj, avg(g)*4-1.5 v from {PIXELS} group by 1,2,3), c as (select p.image, p.x+1 cx, p.y+1 cy, v from {PIXELS} p join b on b.image=p.image and bi=(p.x+1)//4 and bj=(p.y+1)//4 where p.x%2=0 and p.y%2=0) select image, cx, cy, round(case when min(v) over w>=0 and max(v) over w<=1 then v when max(v) over w>min(v) over w then (v-min(v) over w)/(max(v) over w-min(v) over w) else greatest(0,least(1,v)) end,6) as value from c window w as (partition by image)",
    ),
    "x04_region_for": (
        regions,
        f"select image, label, case when label in ('Call','Expr') then case when q75>=0.5 then 'edges' else '~edges' end when label='Assign' then case when q25<=0.5 then '~edges' else 'edges' end when label='FunctionDef' then 'roi' when label in ('If','Return') then 'all' else '~edges' end as region, case when label in ('Name','FunctionDef') then 'roi' when label in ('Call','Expr') then 'edges' when label='If' then 'all' else '~edges' end as policy from (select image, quantile_cont(g,0.25) q25, quantile_cont(g,0.75) q75 from {PIXELS} group by 1), (select unnest({list(LABELS)}) label)",
    ),
    "a23_tag_counters": (counted, "select p_brand, cast(sum(case when p_partkey%4=0 then n else 0 end) as bigint) as publish, cast(sum(case when p_partkey%4=1 then n else 0 end) as bigint) as subscribe, count(*) filter (where p_partkey%4=2) as request_reply from (select *, case when p_partkey%3=0 then len(string_split(p_name,' ')) else 1 end n from part) group by 1"),
    "a30_energy": (energies, ENERGY),
    "a38_best_run": (runs, "select p_brand, p_partkey, round(sc,6) as score from (select *, row_number() over (partition by p_brand order by sc, -al, j, p_partkey) r from (select p_brand, p_partkey, p_size/10 j, p_partkey%10/10 al, round(p_size/10+1-p_partkey%10/10-0.5*ln(greatest(1e-6,p_retailprice/1000))-0.25*ln(1+p_partkey%5),9) sc from part)) where r=1"),
    "a46_stage_deltas": (lambda s, d: r6(E.stage_deltas(metrics(s, d), ["run", "stage"]), "delta"), f"select run, stage, key, round(o-i,6) as delta from (select run, stage, key, max(value) filter (where side='in') i, max(value) filter (where side='out') o from {METRICS} group by 1,2,3) where o-i is not null"),
    "a46_stage_summary": (
        lambda s, d: E.stage_summary(steps(s, d), metrics(s, d), "run", "stage"),
        f"with st as (select distinct user_id as run, event_id%4 as stage from events), k as (select run, string_agg(key,',' order by key) keys from (select distinct run, key from {METRICS} where side='out') group by 1) select run, count(*) as steps, count(*) filter (where m.run is null) as missing, coalesce(any_value(keys),'') as keys from st left join (select distinct run, stage from {METRICS}) m using (run, stage) left join k using (run) group by 1",
    ),
    "a50_subtree": (lambda s, d: E.subtree(tree(s, d), "id", "parent", "weight"), "with recursive u as (select p_partkey id, p_partkey top, p_size w from part union all select u.id, u.top//2, w from u where u.top//2>0) select p.p_partkey as id, cast(total as bigint) as total, coalesce(children,0) as children from part p join (select top, sum(w) total from u group by 1) on top=p.p_partkey left join (select p_partkey//2 up, count(*) children from part where p_partkey//2>0 group by 1) on up=p.p_partkey"),
    "p13_artifact_errors": (
        checked,
        f"select 'node' as part, 'kind must be a string' as error, count(*) as n from (select 's'||s_suppkey id from supplier union all select 'p'||p_partkey from part) where id like '%7' having count(*)>0 union all select 'node', 'label must be a string', count(*) from (select 's'||s_suppkey id from supplier union all select 'p'||p_partkey from part) where id like '%77' having count(*)>0 union all select 'edge', 'src must be a string', count(*) from {EDGES} where dst like '%9' having count(*)>0 union all select 'edge', 'weight must be a number', count(*) from {EDGES} where dst like '%3' having count(*)>0",
    ),
    "p14_evidence": (evidence, "select l_orderkey, min(l_quantity)>=3 and bool_and(l_quantity=floor(l_quantity)) and max(l_discount)>=0 and max(l_discount)<=max(l_tax) and max(l_tax)<=0.09 as valid from lineitem group by 1"),
    "g13_preset_window": (preset, f"with recursive u as (select src, dst from {NATION_EDGES} union select dst, src from {NATION_EDGES}), b as (select n_nationkey lens, n_nationkey id, 0 dist from nation where n_nationkey%5=0 union select b.lens, u.dst, b.dist+1 from b join u on b.id=u.src where b.dist<2) select lens, id, min(dist) as dist from b group by 1,2"),
}
