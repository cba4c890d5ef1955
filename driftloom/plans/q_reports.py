"""Views, ratios, budgets, snapshots, trends, canonical digests and named operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom import named
from driftloom.functions import exprs as X
from driftloom.operators import delta as D
from driftloom.operators import graph as G
from driftloom.operators import reports as R
from driftloom.plans.q_delta import FEATURES, SCORE
from driftloom.plans.q_stream import shared
from driftloom.plans.roles import EDGES, NODES, TOKENS, graph, pixels, t, tokens
from driftloom.registry import operators


def rounded(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def events(s, d):
    return t(s, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def plain_ts(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


def kind(*names):
    return F.col("event_type").isin(*names)


def parts():
    return {
        "delta_coverage": (kind("click", "purchase"), F.lit(True)),
        "validator_reject_rate": (F.col("value") > 90, ~kind("view")),
        "plan_pass_rate": (kind("purchase"), kind("purchase", "error")),
        "false_positive_rate": (F.col("value") < 50, kind("error")),
        "scan_coverage": (kind("view"), kind("view", "click")),
    }


def operational(s, d):
    e = events(s, d).withColumn("week", F.date_trunc("week", "ts"))
    gain = e.groupBy("week").agg(X.safe_div(F.avg(F.when(kind("purchase"), F.col("value"))), F.avg(F.when(kind("click"), F.col("value")))).alias("quality_gain"))
    return plain_ts(rounded(R.ratios(e, ["week"], parts()).join(gain, "week")))


def repaired(s, d):
    found = R.repairs(events(s, d), "user_id", "event_type", "ts", "error", "purchase")
    return plain_ts(rounded(R.repair_times(found, [F.date_trunc("week", "opened").alias("week")])))


def grammar(s, d):
    fn = F.col("type").endswith("_FN")
    return tokens(s, d).select("file", "seq", F.when(fn, F.col("value")).otherwise(0.0).alias("dS"), F.when(fn, 0.0).otherwise(F.col("value")).alias("dH"), (F.col("k") % 3).cast("double").alias("dZ"))


def hot(s, d):
    levels = {"path": F.col("file"), "module": F.split_part("file", F.lit("/"), F.lit(1)), "tile": F.concat(F.lit("tile"), F.col("seq") % 16)}
    return rounded(R.hot_levels(grammar(s, d), levels), 4)


def state(s, d, parity):
    x = t(s, d, "lineitem").filter(F.col("l_orderkey") % 2 == parity).groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("complexity"), F.max("l_extendedprice").cast("double").alias("hotspot"), F.avg((F.col("l_discount") < 0.08).cast("int")).alias("coverage"),
        F.percentile("l_extendedprice", 0.95).alias("p95"), F.avg(1 - F.col("l_tax")).cast("double").alias("ssim"),
    )
    names = ["complexity", "hotspot", "coverage", "p95", "ssim"]
    return x.unpivot(["l_returnflag"], names, "metric", "value")


RULES = [("complexity", "shrink", -0.05), ("hotspot", "shrink", -0.10), ("coverage", "drop", 0.01), ("p95", "grow", 0.05), ("ssim", "least", 0.9)]


def budget_rows(s, d):
    return rounded(R.budgets(state(s, d, 0), state(s, d, 1), s.createDataFrame(RULES, "metric string, rule string, limit double"), "l_returnflag"), 4)


def snapshots(s, d):
    p, li = t(s, d, "part"), t(s, d, "lineitem").select("l_partkey", "l_linestatus")
    e = li.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    anchors = e.groupBy("p_brand").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    anchors = anchors.select("p_brand", F.explode(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("anchor"))
    headers = R.snapshot_headers(p.select("p_brand"), e.select("p_brand"), e.select("p_brand", F.col("l_linestatus").alias("metric")), anchors, "p_brand")
    return R.append_snapshots(headers, f"{shared(s)}-{uuid.uuid4().hex}")


def trends(s, d):
    o = t(s, d, "orders").select("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_totalprice").cast("double").alias("p"))
    x = o.groupBy("o_orderpriority", "month").agg(F.round(F.sum("p"), 2).alias("total"))
    return rounded(R.trend(x, "o_orderpriority", "month", "total"), 2)


def digests(s, d):
    li = t(s, d, "lineitem")
    nodes = li.select("l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("id"), F.lit("file").alias("kind"))
    edges = li.select("l_suppkey", F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return G.canonical_digests(nodes, edges, "l_suppkey")


def grid(s, d):
    cells = pixels(s, d).select(F.col("image").alias("grid"), "x", "y", (F.col("image") * 64 + F.col("y") * 8 + F.col("x")).alias("id"), F.col("g").alias("edge"))
    return cells


def votes(s, d):
    return rounded(G.grid_edges(grid(s, d)))


def communities(s, d):
    return G.label_propagation(grid(s, d).select("id"), G.grid_edges(grid(s, d)), rounds=10, weight="weight")


def custom_score(s, d):
    hist = operators.apply("delta.histogram", tokens(s, d))
    return rounded(D.change_score(D.features(hist), {"churn": 0.6, "entropy": 0.05}).select("commit", "score"))


GRID = "(select vec_id as grid, pos % 8 as x, pos // 8 as y, vec_id*64 + pos as id, least(greatest(cast(v as double) + 0.5, 0.0), 1.0) as edge from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings))"
GRAMMAR = f"(select file, 'tile' || (seq % 16) as tile, split_part(file,'/',1) as module, case when type like '%\\_FN' escape '\\' then value else 0.0 end as dS, case when type like '%\\_FN' escape '\\' then 0.0 else value end as dH, cast(k % 3 as double) as dZ from {TOKENS})"
LEVEL = "select * from (select '{0}' as level, {1} as name, round(sum(dS),4) as \"dS\", round(sum(dH),4) as \"dH\", round(sum(dZ),4) as \"dZ\" from g group by 2) where \"dH\" > \"dS\" order by round(\"dH\"-\"dS\",4) desc, name limit 20"
STATE = "select l_returnflag, unnest(['complexity','hotspot','coverage','p95','ssim']) as metric, unnest([avg(l_quantity)::double, max(l_extendedprice)::double, avg(case when l_discount<0.08 then 1 else 0 end)::double, quantile_cont(l_extendedprice,0.95)::double, avg(1-l_tax)::double]) as value from lineitem where l_orderkey % 2 = {} group by 1"

QUERIES = {
    "a31_last_runs": (lambda s, d: plain_ts(R.last_runs(events(s, d), "user_id", ["ts", "event_id"])), "select user_id, event_id, event_type, ts, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r=1"),
    "a31_violations": (lambda s, d: plain_ts(rounded(R.daily_violations(events(s, d), "event_type", "ts", F.col("value") > 50))), "select event_type, date_trunc('day', ts) as day, count(*) as n, count(*) filter (where value>50) as violations, round(count(*) filter (where value>50)/count(*)::double,6) as rate from events group by 1,2"),
    "a31_success_rates": (lambda s, d: rounded(R.success_rates(events(s, d), "event_type", F.col("value") > 20)), "select event_type, count(*) as n, round(avg(case when value>20 then 1 else 0 end),6) as rate from events group by 1"),
    "a31_top_energy": (lambda s, d: R.top_energy(tokens(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "file", "ts", "value"), f"select file, round(sum(value),4) as energy from {TOKENS} where ts > (select max(ts) from events) - interval 7 days group by 1 order by 2 desc, 1 limit 20"),
    "a32_operational": (operational, """select date_trunc('week', ts)::timestamp as week, round(count(*) filter (where event_type in ('click','purchase'))/count(*)::double,6) as delta_coverage,
 round(coalesce(count(*) filter (where value>90 and event_type<>'view')/nullif(count(*) filter (where event_type<>'view'),0)::double,0),6) as validator_reject_rate, round(coalesce(count(*) filter (where event_type='purchase')/nullif(count(*) filter (where event_type in ('purchase','error')),0)::double,0),6) as plan_pass_rate,
 round(coalesce(count(*) filter (where event_type='error' and value<50)/nullif(count(*) filter (where event_type='error'),0)::double,0),6) as false_positive_rate, round(coalesce(count(*) filter (where event_type='view')/nullif(count(*) filter (where event_type in ('view','click')),0)::double,0),6) as scan_coverage,
 round(avg(value) filter (where event_type='purchase')/avg(value) filter (where event_type='click'),6) as quality_gain from events group by 1"""),
    "a32_repairs": (repaired, "select date_trunc('week', ts)::timestamp as week, count(*) as n, round(median(epoch_us(closed)-epoch_us(ts))/3.6e9,6) as hours, round(count(closed)/count(*)::double,6) as adopted from (select *, min(case when event_type='purchase' then ts end) over (partition by user_id order by ts, event_type rows between 1 following and unbounded following) as closed from events) where event_type='error' group by 1"),
    "a48_hot_levels": (hot, f"with g as {GRAMMAR}, a as (({LEVEL.format('path', 'file')}) union all ({LEVEL.format('module', 'module')}) union all ({LEVEL.format('tile', 'tile')})) select *, round(\"dS\"/greatest(1.0,abs(\"dS\")+abs(\"dH\")),4) as alpha, round(\"dH\"/greatest(1.0,abs(\"dS\")+abs(\"dH\")),4) as beta, round(\"dZ\"/greatest(1.0,abs(\"dS\")+abs(\"dH\")),4) as delta from a"),
    "a49_budgets": (budget_rows, f"with b as ({STATE.format(0)}), a as ({STATE.format(1)}), r(metric, rule, lim) as (values {', '.join(f'''('{m}','{k}',{x}::double)''' for m, k, x in RULES)}) select l_returnflag, metric, rule, round(b.value,4) as before, round(a.value,4) as after, case when rule in ('grow','shrink') then a.value<=b.value*(1+lim) when rule='drop' then b.value-a.value<=lim else a.value>=lim end as kept from b join a using (l_returnflag, metric) join r using (metric)"),
    "s10_snapshot_headers": (snapshots, """with e as (select p_brand, p_partkey, l_linestatus from lineitem join part on l_partkey=p_partkey), n as (select p_brand, count(*) nodes from part group by 1), m as (select p_brand, count(*) edges, list_sort(list(distinct l_linestatus)) metrics, list_sort(list_distinct([min(p_partkey)::varchar, max(p_partkey)::varchar])) anchors from e group by 1)
 select p_brand, '{"nodes":' || nodes || ',"edges":' || coalesce(edges,0) || ',"metrics":[' || coalesce(array_to_string(list_transform(metrics, lambda x: '"' || x || '"'),','),'') || '],"anchors":[' || coalesce(array_to_string(list_transform(anchors, lambda x: '"' || x || '"'),','),'') || ']}' as header from n left join m using (p_brand)"""),
    "w13_trend": (trends, "with x as (select o_orderpriority, date_trunc('month', o_orderdate)::date as month, round(sum(o_totalprice::double),2) as total from orders group by 1,2), y as (select *, row_number() over (partition by o_orderpriority order by month) i, total - lag(total) over (partition by o_orderpriority order by month) as change from x) select o_orderpriority, month, total, round(change,2) as change, round(regr_slope(total, i) over (partition by o_orderpriority),2) as slope from y"),
    "p23_fingerprints": (lambda s, d: t(s, d, "documents").select("doc_id", F.array_join(X.fingerprints("text", "[0-9]{3}"), ",").alias("digests")), "select doc_id, array_to_string(list_transform(regexp_extract_all(text,'[0-9]{3}'), lambda x: sha256(x)),',') as digests from documents"),
    "o05_canonical_digests": (digests, "select l_suppkey, sha256(string_agg(x, chr(10) order by x)) as digest from (select distinct l_suppkey, 'n|p' || l_partkey || '|file' as x from lineitem union all select distinct l_suppkey, 'o|s' || l_suppkey || '|p' || l_partkey || '|' || l_returnflag from lineitem) group by 1"),
    "g06_grid_votes": (votes, f"select a.id as src, b.id as dst, round(1+0.5*(a.edge+b.edge),6) as weight from {GRID} a join {GRID} b on a.grid=b.grid and ((b.x=a.x+1 and b.y=a.y) or (b.x=a.x and b.y=a.y+1))"),
    "g06_grid_communities": (communities, None),
    "x01_named_operator": (lambda s, d: operators.apply("DEGREES", *graph(s, d)).select("id", "degree"), f"select n.id as id, coalesce(i.c,0)+coalesce(o.c,0) as degree from {NODES} n left join (select dst, count(*) c from {EDGES} group by 1) i on i.dst=n.id left join (select src, count(*) c from {EDGES} group by 1) o on o.src=n.id"),
    "x02_field_blend": (lambda s, d: rounded(named.blended(*graph(s, d), {"degree": 3.0, "in_strength": 1.0})), f"with x as (select n.id as node, cast(coalesce(i.c,0)+coalesce(o.c,0) as double) as g, coalesce(i.w,0)::double as w from {NODES} n left join (select dst, count(*) c, sum(weight) w from {EDGES} group by 1) i on i.dst=n.id left join (select src, count(*) c from {EDGES} group by 1) o on o.src=n.id) select node, round(0.75*(g-(select min(g) from x))/((select max(g)-min(g) from x))+0.25*(w-(select min(w) from x))/((select max(w)-min(w) from x)),6) as value from x"),
    "x05_score_weights": (custom_score, f"select \"commit\", round({SCORE.replace('0.45', '0.6').replace('0.20', '0.05', 1)},6) as score from {FEATURES}"),
}
