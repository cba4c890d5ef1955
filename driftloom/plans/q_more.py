"""Graph, field, series, image and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import exprs as X
from driftloom.operators import communities as CM
from driftloom.operators import cycles as CY
from driftloom.operators import experiments as EX
from driftloom.operators import fields as FD
from driftloom.operators import graph as G
from driftloom.operators import pixels as PX
from driftloom.operators import series as S
from driftloom.plans.roles import EDGES, NATION_EDGES, NODES, PIXELS, TOKENS, flows, graph, main_links, nation_graph, pixels, t, tokens, trade


def r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def loops(s, d):
    """Undirected nation graph with every edge once a direction."""
    return nation_graph(s, d)


def sources(s, d):
    return t(s, d, "nation").filter("n_nationkey % 5 = 0").selectExpr("n_nationkey as source", "n_nationkey as id")


def series(s, d):
    return t(s, d, "events").select("user_id", "event_id", "value")


def other(s, d):
    p = pixels(s, d)
    return p.select((F.col("image") - 1).alias("image"), "x", "y", "g")


def real_bridges(s, d):
    """Suppliers and parts between the communities of their main links; beta is a balance
    or a price in its range."""
    n, e = main_links(s, d)
    e = G.stored(e)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    between = G.betweenness(G.sampled(n), both, n)
    of = lambda x, key, sign, v: FD.minmax(x.select(key, v), v).select(F.concat(F.lit(sign), key).alias("id"), F.col("norm").cast("double").alias("beta"))
    beta = of(t(s, d, "supplier"), "s_suppkey", "s", "s_acctbal").unionByName(of(t(s, d, "part"), "p_partkey", "p", "p_retailprice"))
    return r6(CM.bridges(CM.label_communities(n, e), e, between, beta), "betweenness")


def pair(s, d):
    return PX.pairs(pixels(s, d), other(s, d))


def ranks(s, d):
    n, e = nation_graph(s, d)
    return r6(G.pagerank(n, e), "rank")


def number():
    return F.substring("id", 2, 20).cast("long")


def nodes_of(s, d):
    return nation_graph(s, d)[0]


BFS = f"e as {NATION_EDGES.replace('(select * from', '(select src, dst from', 1)}, b as (select n_nationkey source, n_nationkey id, 0 dist from nation where n_nationkey%5=0 union select b.source, e.dst, b.dist+1 from b join e on b.id=e.src where b.dist<26)"
PR = "with recursive " + f"e as materialized {NATION_EDGES}, tot as (select src, sum(weight) s from e group by 1), m as materialized (select nn.n_nationkey dst, nm.n_nationkey src, coalesce(w.w / tot.s, case when tot.s is null then 1.0/25 else 0 end) p from nation nn cross join nation nm left join (select src, dst, sum(weight) w from e group by 1,2) w on w.src=nm.n_nationkey and w.dst=nn.n_nationkey left join tot on tot.src=nm.n_nationkey), it as (select 0 k, (select list(1.0/25 order by n_nationkey) from nation) r union all select k+1, (select list(0.15/25+0.85*v order by dst) from (select dst, sum(p*it.r[cast(src+1 as int)]) v from m group by dst)) from it where k<120) select n_nationkey as id, round(r[cast(n_nationkey+1 as int)],6) as rank from nation, it where k=120"
PAIRPX = f"(select a.image, a.x, a.y, a.g, b.g h from {PIXELS} a join {PIXELS} b on b.image=a.image+1 and a.x=b.x and a.y=b.y)"
GRAD = f"(select *, coalesce(lead(g) over (partition by image, y order by x) - g, 0) dx, coalesce(lead(g) over (partition by image, x order by y) - g, 0) dy from {PIXELS})"
CELLS = "(select image, y as \"row\", x as col from " + PIXELS + ")"
ARMS = "(select d.source as arm, sum(l.quality) passed, avg(d.n_chars) time, avg(l.toxic) align, avg(d.n_chars)/2000.0 cr from documents d join labels l using (doc_id) group by 1)"


def arms(s, d):
    j = t(s, d, "documents").join(t(s, d, "labels"), "doc_id")
    return j.groupBy(F.col("source").alias("arm")).agg(F.sum("quality").alias("passed"), F.avg("n_chars").alias("time"), F.avg("toxic").alias("align"), (F.avg("n_chars") / 2000).alias("cr"))


def arm_sizes(s, d):
    return t(s, d, "orders").select(F.col("o_orderstatus").alias("arm"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("size"))


ARM_SIZES = "(select o_orderstatus as arm, cast(floor(o_totalprice/1000) as bigint) as size from orders)"


def tagged(s, d):
    """Tags in the documents' own lines: a mark is put before what looks like one."""
    marked = F.regexp_replace("text", r"(\b[a-z_]{3,}) ?[=:] ?[\"']?([A-Za-z0-9])", "# tag:$1=$2")
    x = t(s, d, "documents").select("doc_id", F.posexplode(F.split(marked, "\n")).alias("line", "v"))
    return x.select("doc_id", "line", F.explode(X.line_tags("v")).alias("t")).select("doc_id", "line", "t.key", "t.value", "t.col")


def tag_events(s, d):
    """Publish and subscribe have an event for each item, pairs one, others one."""
    one = tagged(s, d).select("doc_id", "key", X.tag_value("value").alias("val"))
    return one.select("key", F.col("val.kind").alias("kind"), F.explode("val.items").alias("item")).groupBy("key", "kind").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))


TAGS = r"""(select doc_id, cast(l - 1 as int) as line, regexp_replace(lines[l], '(\b[a-z_]{3,}) ?[=:] ?["'']?([A-Za-z0-9])', '# tag:\1=\2', 'g') v from (select doc_id, string_split(text, chr(10)) lines from documents), unnest(range(1, len(lines) + 1)) r(l))"""
TAG_ROWS = rf"""(select doc_id, line, m[1] as key, trim(m[2]) as value from (select doc_id, line, unnest(list_transform(regexp_extract_all(v, '#\s*tag:[\w.]+\s*=\s*[^#\n]*'), lambda x: [regexp_extract(x, '#\s*tag:([\w.]+)', 1), regexp_extract(x, '=\s*([^#\n]*)', 1)])) m from {TAGS}))"""





QUERIES = {
    "a13_degrees": (lambda s, d: G.degrees(*graph(s, d)), f"select n.id as id, coalesce(i.c,0) as in_degree, coalesce(o.c,0) as out_degree, coalesce(i.w,0) as in_strength, coalesce(o.w,0) as out_strength, coalesce(i.c,0)+coalesce(o.c,0) as degree from {NODES} n left join (select dst, count(*) c, sum(weight) w from {EDGES} group by 1) i on i.dst=n.id left join (select src, count(*) c, sum(weight) w from {EDGES} group by 1) o on o.src=n.id"),
    "a14_density": (lambda s, d: r6(G.density(*graph(s, d)), "density"), f"select n, m, round(m/(cast(n as double)*(n-1)),6) as density from (select count(*) n from {NODES}), (select count(*) m from {EDGES} where src<>dst)"),
    "a15_counts_by_kind": (lambda s, d: graph(s, d)[0].groupBy("kind").agg(F.count("*").alias("n")), f"select kind, count(*) as n from {NODES} group by 1"),
    "j06_induced_subgraph": (lambda s, d: G.induced(graph(s, d)[1], graph(s, d)[0].filter("id like '%1' or id like '%2'")), f"select * from {EDGES} where (src like '%1' or src like '%2') and (dst like '%1' or dst like '%2')"),
    "g01_pagerank": (ranks, PR),
    "g02_bfs": (lambda s, d: G.bfs(sources(s, d), nation_graph(s, d)[1]).select("source", "id", F.col("dist").cast("int").alias("dist")), f"with recursive {BFS} select source, id, min(dist) as dist from b group by 1,2"),
    "g03_harmonic": (lambda s, d: r6(G.harmonic_in(sources(s, d), nation_graph(s, d)[1], nodes_of(s, d)), "harmonic"), f"with recursive {BFS}, m as (select source, id, min(dist) dist from b group by 1,2) select n_nationkey as id, round(coalesce(h,0),6) as harmonic from nation left join (select id, sum(1.0/dist)/5 h from m where dist>0 group by 1) on id=n_nationkey"),
    "g04_betweenness": (lambda s, d: r6(G.betweenness(G.sampled(graph(s, d)[0]), trade(s, d)[1], graph(s, d)[0]), "betweenness"), None),
    "g05_label_propagation": (lambda s, d: CM.label_communities(*graph(s, d)), None),
    "g06_grid_label_propagation": (lambda s, d: G.label_propagation(graph(s, d)[0], graph(s, d)[1].withColumn("weight", 1 + F.col("weight") / 1000), rounds=10, weight="weight"), None),
    "g09_components": (lambda s, d: G.connected(nodes_of(s, d), nation_graph(s, d)[1].filter("(src + dst) % 4 = 0")), f"with recursive e as (select src, dst from {NATION_EDGES} where (src+dst)%4=0), u as (select src, dst from e union select dst, src from e), r as (select n_nationkey id, n_nationkey lab from nation union select u.dst, r.lab from r join u on u.src=r.id) select id, min(lab) as component from r group by 1"),
    "g10_clustering": (
        lambda s, d: r6(G.clustering(nodes_of(s, d), nation_graph(s, d)[1]), "clustering"),
        f"with u as (select src a, dst b from {NATION_EDGES} union select dst, src from {NATION_EDGES}), k as (select a, count(*) k from u group by 1), tr as (select x.a, count(*)/2 t from u x join u y on x.b=y.a join u z on y.b=z.a and z.b=x.a group by 1) select n_nationkey as id, round(case when k>1 then 2.0*coalesce(t,0)/(k*(k-1)) else 0 end,6) as clustering from nation left join k on k.a=n_nationkey left join tr on tr.a=n_nationkey",
    ),
    "g11_pan": (lambda s, d: G.panned(sources(s, d).select("id"), nation_graph(s, d)[1], nodes_of(s, d).select("id", (F.col("id") * 7 % 25).cast("double").alias("value")), 1), f"with u as (select src, dst from {NATION_EDGES} union select dst, src from {NATION_EDGES}) select n_nationkey as anchor, coalesce(arg_max(dst, dst*7%25), n_nationkey) as id from nation left join u on src=n_nationkey where n_nationkey%5=0 group by n_nationkey"),
    "g07_g15_scope_window": (
        lambda s, d: G.window(nodes_of(s, d), nation_graph(s, d)[1].withColumn("kind", F.lit("link")), sources(s, d).select(F.col("source").alias("lens"), "id"), 1, ["module"], ["link"], 6).select("lens", "id", F.col("dist").cast("int").alias("dist")),
        f"with u as (select src, dst from {NATION_EDGES} union select dst, src from {NATION_EDGES}), b as (select n_nationkey lens, n_nationkey id, 0 dist from nation where n_nationkey%5=0 union all select distinct src, dst, 1 from u where src%5=0) select lens, id, dist from (select *, row_number() over (partition by lens order by dist, id) r from b) where r<=6",
    ),
    "g14_cycles": (lambda s, d: CY.components(flows(s, d)[1]), None),
    "g14_cycles_nations": (lambda s, d: CY.components(nation_graph(s, d)[1]), f"with recursive e as ({NATION_EDGES[1:-1]}), reach(a, b) as (select src, dst from e union select a, dst from reach join e on b = src) select x.a as id, min(x.b) as component from reach x join reach y on x.a = y.b and x.b = y.a group by 1"),
    "j25_bridges": (real_bridges, None),
    "g12_graph_from_facts": (
        lambda s, d: G.from_facts(t(s, d, "part").selectExpr("p_brand as module", "p_type as file", "p_name as func").distinct(), t(s, d, "part").selectExpr("p_type as file", "p_name as func", "p_brand as name"), t(s, d, "part").selectExpr("p_type as file", "p_brand as module"))[1].groupBy("kind").agg(F.count("*").alias("edges")),
        "select 'define' as kind, (select count(*) from (select distinct p_brand, p_type from part)) + (select count(*) from (select distinct p_brand, p_type, p_name from part)) as edges union all select 'call', count(*) from part union all select 'import', count(*) from part",
    ),
    "o01_o03_top_tokens": (lambda s, d: tokens(s, d).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(8), f"select file, count(*) as n from {TOKENS} group by 1 order by n desc, file limit 8"),
    "o02_anchor": (lambda s, d: G.anchor(graph(s, d)[0], G.degrees(*graph(s, d)).select("id", "degree"), ["topic", "module", "file"]).select("id", "degree"), f"select id, count(*) as degree from {NODES} n join {EDGES} e on e.src=n.id where kind='module' group by 1 order by 2 desc, 1 limit 1"),
    "j08_a16_roll_up": (lambda s, d: r6(FD.rolled_up(t(s, d, "customer").select("c_custkey", "c_acctbal"), t(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal"), "select c_nationkey, round(avg(c_acctbal),6) as c_acctbal from customer group by 1"),
    "j07_default_lookup": (lambda s, d: FD.looked_up(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "n"), "select c_custkey, coalesce(n,0) as n from customer left join (select o_custkey, count(*) n from orders group by 1) on o_custkey=c_custkey"),
    "j09_blend": (
        lambda s, d: r6(FD.blend(t(s, d, "part").selectExpr("'size' as name", "p_partkey as node", "p_size / 50D as value").unionByName(t(s, d, "part").filter("p_partkey % 2 = 0").selectExpr("'price' as name", "p_partkey as node", "p_retailprice / 2000D as value")), {"size": 1.0, "price": 3.0}), "value"),
        "select p_partkey as node, round(least(1.0,greatest(0.0,0.25*p_size/50.0+(case when p_partkey%2=0 then 0.75*p_retailprice/2000.0 else 0 end))),6) as value from part",
    ),
    "a17_minmax": (lambda s, d: r6(FD.minmax(t(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", ["p_brand"]), "norm"), "select p_partkey, p_brand, p_retailprice, round(case when mx>mn then (p_retailprice-mn)/(mx-mn) else 0 end,6) as norm from (select p_partkey, p_brand, p_retailprice, min(p_retailprice) over (partition by p_brand) mn, max(p_retailprice) over (partition by p_brand) mx from part)"),
    "a17_robust": (lambda s, d: r6(FD.robust(t(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", ["p_brand"]), "norm"), "select p_partkey, p.p_brand as p_brand, p_retailprice, round(least(1.0,greatest(0.0,(p_retailprice-lo)/greatest(hi-lo,1e-9))),6) as norm from part p join (select p_brand, quantile_cont(p_retailprice,0.05) lo, quantile_cont(p_retailprice,0.95) hi from part group by 1) q on p.p_brand=q.p_brand"),
    "a18_a19_field_summary": (lambda s, d: r6(FD.summary(t(s, d, "part"), "p_retailprice", ["p_brand"]), "min", "max", "mean", "p50", "p90"), "select p_brand, count(*) as n, round(min(p_retailprice),6) as min, round(max(p_retailprice),6) as max, round(avg(p_retailprice),6) as mean, round(quantile_cont(p_retailprice,0.5),6) as p50, round(quantile_cont(p_retailprice,0.9),6) as p90 from part group by 1"),
    "a22_point_similarity": (
        lambda s, d: r6(FD.point_similarity(t(s, d, "part").selectExpr("p_partkey", "p_size as S", "p_retailprice as H", "p_partkey % 7 as Z"), "p_partkey"), "sim"),
        "with r as (select quantile_cont(cast(p_size as double),0.95) s, quantile_cont(p_retailprice,0.95) h, quantile_cont(cast(p_partkey%7 as double),0.95) z from part), d as (select p_partkey, sqrt((p_size-s)^2+(p_retailprice-h)^2+0.25*(p_partkey%7-z)^2) d from part, r) select p_partkey, round(1-d/(select max(d) from d),6) as sim from d",
    ),
    "p07_relative_filter": (lambda s, d: FD.relative_filter(t(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 0.9), "select p_partkey, p_retailprice from part where p_retailprice/(select max(p_retailprice) from part)>=0.9"),
    "p05_p06_match_nodes": (lambda s, d: graph(s, d)[0].filter(X.node_matches("s1?", "id", "label") & X.allowed_kinds("kind", "module")).select("id"), f"select id from {NODES} where regexp_matches(id,'s1?') or regexp_matches(label,'s1?')"),
    "w01_block_lengths": (lambda s, d: S.block_lengths(t(s, d, "lineitem").selectExpr("l_suppkey as f", "l_orderkey as line").distinct().withColumn("total", F.lit(10_000_000)), "f", "line", "total").select("f", "line", "length"), "select f, line, coalesce(lead(line) over (partition by f order by line), 10000001)-line as length from (select distinct l_suppkey f, l_orderkey line from lineitem)"),
    "w02_sampling": (lambda s, d: S.sampled(t(s, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 4), "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey)-1 r, greatest(1, count(*) over (partition by p_brand)//4) st from part) where r%st=0 and r/st<4"),
    "w03_layout": (lambda s, d: r6(S.grid_layout(t(s, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.col("p_size"), F.col("p_partkey")]), "u", "v"), "select p_brand, p_partkey, p_size, cast(i//c as int) as row, cast(i%c as int) as col, round((i%c+0.5)/c,6) as u, round((i//c+0.5)/ceil(n/c),6) as v from (select *, cast(ceil(sqrt(n)) as int) c from (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_size, p_partkey)-1 i, count(*) over (partition by p_brand) n from part))"),
    "w05_sequence_fingerprint": (lambda s, d: S.sequence_fingerprint(tokens(s, d), "commit", "seq", F.concat_ws("@", "type", "file")), f"""select "commit", sha256(array_to_string(list(i order by seq) || coalesce(list(i || '>' || n order by seq) filter (where n is not null), []), '|')) as fingerprint from (select "commit", seq, type || '@' || file i, lead(type || '@' || file) over (partition by "commit" order by seq) n from {TOKENS}) group by 1"""),
    "w06_pareto_front_all": (lambda s, d: S.pareto_front(t(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), None, "p_size", "p_retailprice"), "select p_brand, p_partkey, p_size, p_retailprice from (select *, min(p_retailprice) over (order by p_size desc, p_retailprice, p_brand, p_partkey rows between unbounded preceding and 1 preceding) m from part) where m is null or p_retailprice<m"),
    "w06_pareto_front": (lambda s, d: S.pareto_front(t(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), "p_brand", "p_size", "p_retailprice"), "select p_brand, p_partkey, p_size, p_retailprice from (select *, min(p_retailprice) over (partition by p_brand order by p_size desc, p_retailprice, p_partkey rows between unbounded preceding and 1 preceding) m from part) where m is null or p_retailprice<m"),
    "w07_ewma": (lambda s, d: r6(S.ewma(series(s, d), "user_id", "event_id", "value"), "ewma"), "select user_id, event_id, value, round(list_reduce(list(value) over (partition by user_id order by event_id rows between 119 preceding and current row), lambda m, v: 0.15*v+0.85*m),6) as ewma from events"),
    "w08_rolling_thresholds": (lambda s, d: r6(S.rolling_thresholds(series(s, d), "user_id", "event_id", "value"), "alpha", "beta", "z"), "select user_id, event_id, value, round(quantile_cont(value,0.9) over w,6) as alpha, round(quantile_cont(value,0.95) over w,6) as beta, round(quantile_cont(value,0.99) over w,6) as z from events window w as (partition by user_id order by event_id rows between 89 preceding and current row)"),
    "w09_w12_robust_z": (lambda s, d: r6(S.robust_z(S.rolling_mad(series(s, d), "user_id", "event_id", "value"), "value", "median", "sigma"), "median", "sigma", "z_score"), "select user_id, event_id, value, round(md,6) as median, round(1.4826*sg,6) as sigma, round(case when sg>0 then (value-md)/(1.4826*sg) else 0 end,6) as z_score from (select user_id, event_id, value, median(value) over w md, mad(value) over w sg from events window w as (partition by user_id order by event_id rows between 89 preceding and current row))"),
    "w10_page_hinkley": (lambda s, d: S.page_hinkley(series(s, d), "user_id", "event_id", "value", 1.0, 50.0).select("user_id", "event_id", F.round("ph", 8).alias("ph"), "drift"), "select user_id, event_id, round(c-min(c) over w,8) as ph, c-min(c) over w > 50 as drift from (select *, sum(value-m-1) over w c from (select *, avg(value) over w m from events window w as (partition by user_id order by event_id rows unbounded preceding)) window w as (partition by user_id order by event_id rows unbounded preceding)) window w as (partition by user_id order by event_id rows unbounded preceding)"),
    "w11_freeze": (lambda s, d: S.frozen(series(s, d).withColumn("drift", F.col("event_id") % 37 == 0), "user_id", "event_id", "value", "drift", 5).select("user_id", "event_id", "held", "frozen"), "select user_id, event_id, held, last_value(case when not held then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as frozen from (select *, max(case when event_id%37=0 then 1 else 0 end) over (partition by user_id order by event_id rows between 5 preceding and current row)=1 as held from events)"),
    "w13_latest": (lambda s, d: S.latest(t(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("event_id")], 3), "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r<=3"),
    "w14_ledger": (lambda s, d: r6(S.ledger(t(s, d, "events").selectExpr("user_id", "event_id", "case event_type when 'click' then 1D when 'view' then 1.5D else 0.5D end as ds"), "user_id", "event_id", ["ds"]), "run_ds"), "select user_id, event_id, ds, round(sum(ds) over (partition by user_id order by event_id rows unbounded preceding),6) as run_ds from (select user_id, event_id, case event_type when 'click' then 1.0::double when 'view' then 1.5::double else 0.5::double end ds from events)"),
    "i01_luma": (lambda s, d: pixels(s, d).select("image", "x", "y", F.round(PX.luma(F.col("g"), 1 - F.col("g"), F.lit(0.5)), 6).alias("luma")), f"select image, x, y, round(0.299*g+0.587*(1-g)+0.057,6) as luma from {PIXELS}"),
    "i02_entropy": (lambda s, d: r6(PX.entropy(pixels(s, d), ["image"]), "entropy"), f"select image, round(log2(sum(c))-sum(c*log2(c))/sum(c),6) as entropy from (select image, least(floor(g*256),255) b, count(*) c from {PIXELS} group by 1,2) group by 1"),
    "i03_edge_density": (lambda s, d: r6(PX.edge_density(pixels(s, d), ["image"]), "edges"), f"select image, round(least(1.0,avg(abs(dx)+abs(dy))),6) as edges from {GRAD} group by 1"),
    "i04_contrast": (lambda s, d: r6(PX.contrast(pixels(s, d), ["image"]), "contrast"), f"select image, round(stddev_pop(g),6) as contrast from {PIXELS} group by 1"),
    "i05_block_stats": (lambda s, d: r6(PX.block_stats(pixels(s, d), 4), "edges", "mean", "variance", "entropy"), f"with p as (select *, cast(x//4 as bigint) bx, cast(y//4 as bigint) bt from {PIXELS}), g as (select *, coalesce(lead(g) over (partition by image,bx,bt,y order by x)-g,0) dx, coalesce(lead(g) over (partition by image,bx,bt,x order by y)-g,0) dy from p), e as (select image,bx,bt,log2(sum(c))-sum(c*log2(c))/sum(c) h from (select image,bx,bt,least(floor(g*64),63) b,count(*) c from p group by 1,2,3,4) group by 1,2,3) select g.image as image, g.bx as bx, g.bt as by, round(least(1.0,avg(abs(dx)+abs(dy))),6) as edges, round(avg(g),6) as mean, round(var_pop(g),6) as variance, round(any_value(h),6) as entropy from g join e on g.image=e.image and g.bx=e.bx and g.bt=e.bt group by 1,2,3"),
    "i06_j26_psnr": (lambda s, d: r6(PX.psnr(pair(s, d)), "psnr"), f"select image, round(10*log10(1/avg((g-h)^2)),6) as psnr from {PAIRPX} group by 1"),
    "i07_ssim": (lambda s, d: r6(PX.ssim(pair(s, d), 8, 8), "ssim"), f"with p as materialized {PAIRPX}, c as (select a.image, a.x, a.y, avg(b.g) g, avg(b.h) h, avg(b.g*b.g) gg, avg(b.h*b.h) hh, avg(b.g*b.h) gh from p a, range(-3,4) i(i), range(-3,4) j(j), p b where b.image=a.image and b.x=case when a.x+i<0 then -(a.x+i) when a.x+i>7 then 14-(a.x+i) else a.x+i end and b.y=case when a.y+j<0 then -(a.y+j) when a.y+j>7 then 14-(a.y+j) else a.y+j end group by 1,2,3) select image, round(avg(greatest(-1.0,least(1.0,((2*g*h+0.0001)*(2*(gh-g*h)+0.0009))/((g*g+h*h+0.0001)*(gg-g*g+hh-h*h+0.0009))))),6) as ssim from c group by 1"),
    "i08_difference": (lambda s, d: r6(PX.difference(pair(s, d)), "mean", "p95", "max"), f"select image, round(avg(abs(g-h)),6) as mean, round(quantile_cont(abs(g-h),0.95),6) as p95, round(max(abs(g-h)),6) as max from {PAIRPX} group by 1"),
    "i09_sobel": (
        lambda s, d: r6(PX.sobel(pixels(s, d)), "edge"),
        f"with p as {PIXELS}, n as (select c.image, c.x, c.y, i.i, j.j, q.g from p c cross join (values (-1),(0),(1)) i(i) cross join (values (-1),(0),(1)) j(j) join p q on q.image=c.image and q.x=least(7,greatest(0,c.x+i.i)) and q.y=least(7,greatest(0,c.y+j.j))) select image, x, y, round(sqrt(sum(g*i*(2-abs(j)))^2+sum(g*j*(2-abs(i)))^2)/8,6) as edge from n group by 1,2,3",
    ),
    "i10_period": (lambda s, d: PX.period(pixels(s, d).groupBy("image", "x").agg(F.sum("g").alias("v")), "image", "x", "v", 8), f"with p as (select image, x, v-avg(v) over (partition by image) v from (select image, x, sum(g) v from {PIXELS} group by 1,2)), a as (select a.image, l.l, round(sum(a.v*b.v),9) c from p a cross join (values (2),(3),(4)) l(l) join p b on a.image=b.image and b.x=(a.x+l.l)%8 group by 1,2) select image, l as period from (select *, row_number() over (partition by image order by c desc, l) r from a) where r=1"),
    "j24_adjacency": (lambda s, d: PX.adjacency(pixels(s, d).select("image", F.col("y").alias("row"), F.col("x").alias("col")), "image", "8").groupBy("image", "row", "col").agg(F.count("*").alias("n")), f'select a.image as image, a."row" as "row", a.col as col, count(*) as n from {CELLS} a join {CELLS} b on a.image=b.image and abs(a."row"-b."row")<=1 and abs(a.col-b.col)<=1 and (a."row"<>b."row" or a.col<>b.col) group by 1,2,3'),
    "j24_hex_adjacency": (lambda s, d: PX.adjacency(pixels(s, d).select("image", F.col("y").alias("row"), F.col("x").alias("col")), "image", "hex").groupBy("image", "row", "col").agg(F.count("*").alias("n")), f'select a.image as image, a."row" as "row", a.col as col, count(*) as n from {CELLS} a join {CELLS} b on a.image=b.image and ((a."row"=b."row" and abs(a.col-b.col)=1) or (abs(a."row"-b."row")=1 and b.col-a.col in (case when a."row"%2=0 then -1 else 0 end, case when a."row"%2=0 then 0 else 1 end))) group by 1,2,3'),
    "a44_grid_meta": (lambda s, d: r6(PX.grid_meta(pixels(s, d).select("image", F.col("y").alias("row"), F.col("x").alias("col")), 8, 8), "u", "v"), f'select image, "row", col, least("row",col,7-"row",7-col) as ring, least("row",col,7-"row",7-col)=0 as border, round((col+0.5)/8,6) as u, round(("row"+0.5)/8,6) as v from {CELLS}'),
    "a45_mask_merge": (lambda s, d: r6(PX.merged_masks(pixels(s, d).withColumn("layer", F.col("image") % 5).withColumnRenamed("g", "v"), ["layer", "x", "y"], "mean"), "v"), f"select image%5 as layer, x, y, round(avg(g),6) as v from {PIXELS} group by 1,2,3"),
    "p22_regions": (lambda s, d: pixels(s, d).groupBy("image").agg(F.count_if(X.in_rect("x", "y", 2, 2, 5, 6)).alias("rect"), F.count_if(X.in_circle("x", "y", 3.5, 3.5, 2.0)).alias("circle")), f"select image, count(*) filter (where x>=2 and x<5 and y>=2 and y<6) as rect, count(*) filter (where (x-3.5)^2+(y-3.5)^2<=4) as circle from {PIXELS} group by 1"),
    "a33_arm_aggregate": (lambda s, d: r6(arms(s, d), "time", "align", "cr"), f"select arm, cast(passed as bigint) as passed, round(time,6) as time, round(align,6) as align, round(cr,6) as cr from {ARMS}"),
    "a34_paired": (lambda s, d: r6(EX.paired(t(s, d, "orders").filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") / 2).cast("long").alias("k"), "o_totalprice"), t(s, d, "orders").filter("o_orderkey % 2 = 1").select(((F.col("o_orderkey") - 1) / 2).cast("long").alias("k"), "o_totalprice"), "k", "o_totalprice"), "mean", "median"), "select count(*) filter (where d>0) as wins, count(*) filter (where d<0) as losses, count(*) filter (where d=0) as ties, round(avg(d),6) as mean, round(median(d),6) as median from (select a.o_totalprice-b.o_totalprice d from orders a join orders b on a.o_orderkey%2=0 and b.o_orderkey=a.o_orderkey+1)"),
    "a35_sign_test": (lambda s, d: r6(EX.sign_test(t(s, d, "nation").selectExpr("n_nationkey as wins", "n_regionkey * 3 as losses").withColumn("wins", F.col("wins").cast("long")).withColumn("losses", F.col("losses").cast("long"))), "p_one_sided", "p_two_sided"), "with x as (select distinct cast(n_nationkey as bigint) wins, cast(n_regionkey*3 as bigint) losses from nation), p as (select wins, losses, (select sum(exp(lgamma(wins+losses+1)-lgamma(i+1)-lgamma(wins+losses-i+1)-(wins+losses)*ln(2))) from range(0,60) r(i) where i<=wins+losses and i>=greatest(wins,losses)) p from x) select wins, losses, round(least(1.0,p),6) as p_one_sided, round(least(1.0,2*least(1.0,p)),6) as p_two_sided from p"),
    "a36_cliffs_delta": (lambda s, d: r6(EX.cliffs_delta(arm_sizes(s, d), "arm", "size", "O", "F"), "delta"), f"select cast(sum(sign(a.size-b.size)) as bigint) as net, count(*) as pairs, round(sum(sign(a.size-b.size))/count(*),6) as delta from {ARM_SIZES} a, {ARM_SIZES} b where a.arm='O' and b.arm='F'"),
    "a36_sign": (lambda s, d: EX.signs(arm_sizes(s, d), "arm", "size", "O", "F"), f"select cast(sign(sum(sign(a.size-b.size))) as int) as sign, cast(sum(sign(a.size-b.size)) as bigint) as net, count(*) as pairs from {ARM_SIZES} a, {ARM_SIZES} b where a.arm='O' and b.arm='F'"),
    "a37_bootstrap": (lambda s, d: r6(EX.bootstrap_ci(t(s, d, "part").select("p_partkey", "p_size"), "p_size"), "low", "high"), None),
    "a37_bootstrap_by_arm": (lambda s, d: r6(EX.bootstrap(t(s, d, "supplier").withColumn("arm", F.col("s_nationkey") % 2), "arm", "s_acctbal"), "mean_low", "mean_high", "median_low", "median_high"), None),
    "a52_verdict": (lambda s, d: EX.ranked_arms(arms(s, d)).select("arm", "place"), f"select arm, cast(row_number() over (order by passed desc, align desc, abs(cr-1), time, arm) as int) as place from {ARMS}"),
    "a40_text_entropy": (
        lambda s, d: r6(t(s, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("c")).groupBy("doc_id").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"), F.count("*").alias("k")).select("doc_id", F.least(F.lit(1.0), F.col("h") / F.log2(F.least(F.lit(256), F.greatest(F.lit(2), F.col("k"))))).alias("entropy")), "entropy"),
        "select doc_id, round(least(1.0,h/log2(least(256,greatest(2,k)))),6) as entropy from (select doc_id, log2(sum(c))-sum(c*log2(c))/sum(c) h, count(*) k from (select doc_id, ch, count(*) c from (select doc_id, unnest(regexp_extract_all(text,'(?s).')) ch from documents) group by 1,2) group by 1)",
    ),
    "a53_line_grid": (
        lambda s, d: t(s, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "v")).groupBy("doc_id", F.floor(F.col("i") * 8 / F.col("n")).alias("row")).agg(F.count_if(F.col("v").rlike(r"\bthe\b")).alias("hits"), F.round(F.sum(F.least(F.lit(1.0), F.length("v") / 120)), 6).alias("mass")),
        "select doc_id, cast(floor(i*8/cast(n as double)) as bigint) as row, count(*) filter (where regexp_matches(v,'\\bthe\\b')) as hits, round(sum(least(1.0,length(v)/120.0)),6) as mass from (select doc_id, len(l) n, unnest(l) v, generate_subscripts(l,1)-1 i from (select doc_id, string_split(text,chr(10)) l from documents)) group by 1,2",
    ),
    "p15_p17_tags": (tag_events, f"select key, kind, count(*) as n, count(distinct item) as items from (select key, kind, trim(unnest(case kind when 'pair' then [string_split(value,'->')[1], substr(value, instr(value,'->')+2)] when 'list' then string_split(value,',') else [value] end)) as item from (select key, value, case when json_valid(value) and regexp_matches(value, '^[\\[{{\"]') then 'json' when contains(value,'->') then 'pair' when contains(value,',') then 'list' else 'raw' end as kind from {TAG_ROWS})) where item <> '' group by 1,2"),
    "p15_tags": (lambda s, d: tagged(s, d).groupBy("doc_id", "line", "key", "value").agg(F.count("*").alias("n")), f"select doc_id, line, key, value, count(*) as n from {TAG_ROWS} group by 1,2,3,4"),
    "p18_normalised_text": (lambda s, d: t(s, d, "documents").select("doc_id", F.length(X.normalised_text(F.replace("text", F.lit("\n"), F.lit(" \r\n")))).alias("n")), "select doc_id, length(regexp_replace(text,'[ \\t]+(\\n|$)','\\1','g')) as n from documents"),
    "p19_timestamps": (lambda s, d: t(s, d, "events").select("event_id", X.parsed_ts(F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz").alias("at")), "select event_id, case when event_id%3=0 then timestamp '2000-01-01' else date_trunc('second', ts) end as at from events"),
}
