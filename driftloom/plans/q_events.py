"""Event-log, finding and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import exprs as X
from driftloom.operators import events as E
from driftloom.operators import series
from driftloom.plans.roles import CHANGES, TOKENS, changes, t, tokens

DAY = 86_400


def log(s, d):
    return t(s, d, "events").select("user_id", F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))


def counted(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"))


LOG = "(select user_id, event_type as kind, epoch_us(ts) as at, event_id as id from events)"
PAIRS = f"from {LOG} a join {LOG} b on a.user_id=b.user_id and a.kind='signup' and b.kind='purchase' and b.at>a.at and b.at<=a.at+86400000000"


def findings(s, d):
    x = t(s, d, "documents")
    return x.selectExpr("source as tool", "lang as rule", "doc_id div 3 as line", "doc_id % 4 as severity", "(doc_id % 10) / 10D as confidence", "concat('t', doc_id % 5) as trace", "doc_id")


def hunks(s, d):
    return t(s, d, "part").selectExpr("concat('f', p_partkey % 10) as file", "(p_partkey * 37) % 5000 as low", "(p_partkey * 37) % 5000 + p_size as high", "p_partkey as hunk")


def points(s, d):
    return t(s, d, "orders").selectExpr("concat('f', o_orderkey % 10) as file", "(o_orderkey * 13) % 5000 as line", "o_orderkey as id")


HUNKS = "(select 'f' || (p_partkey % 10) as file, (p_partkey*37)%5000 as low, (p_partkey*37)%5000+p_size as high, p_partkey as hunk from part)"
POINTS = "(select 'f' || (o_orderkey % 10) as file, (o_orderkey*13)%5000 as line, o_orderkey as id from orders)"


def patterns(s):
    return s.createDataFrame([("a", 0, "*BRASS", 5), ("a", 1, "*STEEL", 0), ("b", 0, "SMALL*", 0), ("b", 1, "*PLATED*", 10), ("b", 2, "PROMO BRUSHED STEEL", 0), ("c", 0, "*", 0)], "slot string, idx int, pattern string, weight int")


def payloads(s, d):
    e = t(s, d, "events")
    body = "case event_id % 6 when 0 then '{\"delta_report\": {}, \"paths\": {\"metrics\": \"m\"}}' when 1 then '{\"delta_report\": {}, \"paths\": {\"metrics\": 7}}' when 2 then '[1]' when 3 then '{\"level\": true, \"score\": 1.5}' when 4 then '{bad' else '{\"level\": \"x\", \"graph\": {}}' end"
    topic = "case event_id % 4 when 0 then 'analytics.delta.ready' when 1 then 'analytics.scope.ready' when 2 then 'analytics.invariants.violation' else 'nobody' end"
    return e.selectExpr("event_id", f"{topic} as topic", f"{body} as payload")


def payload_sql() -> str:
    """Errors counted by rule: unknown topic, no object, and each field that is missing or
    of another type."""
    types = {"object": "'OBJECT'", "string": "'VARCHAR'", "number": "'BIGINT','UBIGINT','DOUBLE'", "boolean": "'BOOLEAN'"}
    fields = [f"case when topic = '{topic}' and obj and coalesce(json_type(p, '$.{path}') not in ({types[kind]}), true) then 1 else 0 end" for topic, rules in X.PAYLOADS.items() for path, kind in rules]
    known = ", ".join(f"'{topic}'" for topic in X.PAYLOADS)
    body = "case event_id % 6 when 0 then '{\"delta_report\": {}, \"paths\": {\"metrics\": \"m\"}}' when 1 then '{\"delta_report\": {}, \"paths\": {\"metrics\": 7}}' when 2 then '[1]' when 3 then '{\"level\": true, \"score\": 1.5}' when 4 then '{bad' else '{\"level\": \"x\", \"graph\": {}}' end"
    topic = "case event_id % 4 when 0 then 'analytics.delta.ready' when 1 then 'analytics.scope.ready' when 2 then 'analytics.invariants.violation' else 'nobody' end"
    whole = f"select topic, case when obj then payload end as p, obj from (select *, case when json_valid(payload) then json_type(payload) = 'OBJECT' else false end as obj from (select {topic} as topic, {body} as payload from events))"
    return f"select topic, cast(errors as int) as errors, count(*) as n from (select topic, (case when topic in ({known}) then 0 else 1 end) + (case when obj then 0 else 1 end) + {' + '.join(fields)} as errors from ({whole})) group by 1, 2"


PAYLOAD_SQL = payload_sql()


def chain_rows(s, d):
    c = t(s, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100_000 + F.col("turn") - 1).alias("parent"))
    return E.causal_chain(c, "id", "parent")


def priority(s, d):
    x = t(s, d, "documents")
    score, kind = E.finding_priority(F.col("doc_id") % 4 / 3, F.col("doc_id") % 10 / 10, F.col("doc_id") % 3 / 2, F.col("doc_id") % 2, F.col("doc_id") % 5 / 4, F.lit(0.5), (F.col("doc_id") % 50 == 0).cast("int"))
    return x.select("doc_id", F.round(score, 6).alias("score"), kind.alias("action"))


PRIORITY = "(select doc_id, 1.0*(doc_id%4)/3 + 0.7*(doc_id%10)/10 + 0.7*(doc_id%3)/2 + 0.3*(doc_id%2) + 0.3*(doc_id%5)/4 + 0.1 + 1.2*(case when doc_id%50=0 then 1 else 0 end) as score from documents)"


def projection(s, d):
    """Token weight by node by cell, against the cells' observed sums."""
    li = t(s, d, "lineitem")
    w = li.groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("w"))
    link = t(s, d, "part").selectExpr("p_partkey as node", "p_brand as cell", "p_size / 50D as link")
    made = w.join(link, "node").groupBy("cell").agg(F.sum(F.col("w") * F.col("link")).alias("made"))
    seen = li.join(t(s, d, "part"), li.l_partkey == F.col("p_partkey")).groupBy(F.col("p_brand").alias("cell")).agg(F.sum("l_linenumber").cast("double").alias("seen"))
    return made.join(seen, "cell", "full_outer").select("cell", F.round(F.coalesce("made", F.lit(0.0)), 4).alias("made"), F.coalesce("seen", F.lit(0.0)).alias("seen"), F.round(F.abs(F.coalesce("made", F.lit(0.0)) - F.coalesce("seen", F.lit(0.0))), 4).alias("l1"))


def ratios(s, d):
    e = t(s, d, "events")
    return e.groupBy("event_type").agg(F.round(F.count_if(F.col("value") > 50) / F.count("*"), 6).alias("share"), F.round(F.median(F.col("value")), 6).alias("median"), F.count_distinct("user_id").alias("users"))


QUERIES = {
    "j10_path_query": (
        lambda s, d: counted(E.path_pairs(log(s, d), "user_id", "signup", "purchase", DAY * 1_000_000, "error"), "user_id"),
        f"select a.user_id as user_id, count(*) as n {PAIRS} and not exists (select 1 from {LOG} x where x.user_id=a.user_id and x.kind='error' and x.at>a.at and x.at<b.at) group by 1",
    ),
    "j11_incomplete_sequences": (
        lambda s, d: E.incomplete(log(s, d), "user_id", "signup", ["purchase", "error"], 3600 * 1_000_000).select("user_id", "id"),
        f"select a.user_id, a.id from {LOG} a where a.kind='signup' and not exists (select 1 from {LOG} b where b.user_id=a.user_id and b.kind in ('purchase','error') and b.at>a.at and b.at<=a.at+3600000000)",
    ),
    "j12_multi_step_path": (
        lambda s, d: counted(E.chains(log(s, d), "user_id", ["signup", "view", "purchase"], 7200 * 1_000_000), "user_id"),
        f"select a.user_id as user_id, count(*) as n from {LOG} a join {LOG} b on a.user_id=b.user_id and a.kind='signup' and b.kind='view' and b.at>a.at and b.at<=a.at+7200000000 join {LOG} c on c.user_id=b.user_id and c.kind='purchase' and c.at>b.at and c.at<=b.at+7200000000 group by 1",
    ),
    "j13_temporal_coupling": (
        lambda s, d: E.coupling(changes(s, d).filter("ts >= '1995-01-01'"), "commit", "path").filter("together >= 2"),
        f"""with c as (select distinct "commit", path from {CHANGES} where ts >= '1995-01-01') select x.path as a, y.path as b, count(*) as together from c x join c y on x."commit"=y."commit" and x.path<y.path group by 1,2 having count(*)>=2""",
    ),
    "j14_findings_in_hunks": (
        lambda s, d: E.range_hits(points(s, d), hunks(s, d), "file", "line", "low", "high").groupBy("id").agg(F.sum("hits").alias("hits")).filter("hits > 0").select("id", "hits", F.when(F.col("hits") > 2, 1.5).otherwise(1.2).alias("weight")),
        f"select p.id as id, count(*) as hits, case when count(*)>2 then 1.5 else 1.2 end as weight from {POINTS} p join {HUNKS} h on p.file=h.file and p.line between h.low and h.high group by 1",
    ),
    "j15_enclosing_symbol": (
        lambda s, d: E.nearest_before(points(s, d), hunks(s, d).groupBy("file", F.col("low").alias("line")).agg(F.max("hunk").alias("symbol")), "file", "line", "symbol"),
        f"select p.file, p.line, p.id, m.symbol from {POINTS} p asof left join (select file, low as line, max(hunk) symbol from {HUNKS} group by 1,2) m on p.file=m.file and p.line>=m.line",
    ),
    "j16_argmax_projection": (
        lambda s, d: E.arg_max(t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight")), "l_partkey", "l_suppkey", "weight"),
        "select l_partkey, l_suppkey, weight from (select *, row_number() over (partition by l_partkey order by weight desc, l_suppkey) r from (select l_partkey, l_suppkey, sum(l_quantity) weight from lineitem group by 1,2)) where r=1",
    ),
    "j17_projection_commutes": (projection, "with w as (select l_partkey node, sum(l_quantity) w from lineitem group by 1), m as (select p_brand cell, sum(w*p_size/50.0) made from w join part on node=p_partkey group by 1), o as (select p_brand cell, cast(sum(l_linenumber) as double) seen from lineitem join part on l_partkey=p_partkey group by 1) select coalesce(m.cell,o.cell) as cell, round(coalesce(made,0),4) as made, coalesce(seen,0) as seen, round(abs(coalesce(made,0)-coalesce(seen,0)),4) as l1 from m full join o on m.cell=o.cell"),
    "j18_open_backlog": (
        lambda s, d: t(s, d, "documents").join(t(s, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source", "lang").agg(F.count("*").alias("open")),
        "select source, lang, count(*) as open from documents d where not exists (select 1 from labels l where l.doc_id=d.doc_id) group by 1,2",
    ),
    "j19_module_density": (
        lambda s, d: tokens(s, d).groupBy(X.module_id("file").alias("module")).agg(F.count("*").alias("tokens"), F.round(F.sum("value"), 4).alias("weight")).orderBy(F.desc("weight"), "module").limit(10),
        f"select 'module:' || replace(regexp_replace(file,'\\.py$',''),'/','.') as module, count(*) as tokens, round(sum(value),4) as weight from {TOKENS} group by 1 order by 3 desc, 1 limit 10",
    ),
    "j20_violations_with_proofs": (
        lambda s, d: t(s, d, "events").filter("event_type = 'error'").alias("v").join(t(s, d, "events").filter("event_type = 'view'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("proofs")).alias("p"), (F.col("v.user_id") == F.col("p.user_id")) & (F.to_date("v.ts") == F.col("day")), "left").select("event_id", F.coalesce("proofs", F.lit(0)).alias("proofs")),
        "select v.event_id, coalesce(p.proofs,0) as proofs from events v left join (select user_id, cast(ts as date) as day, count(*) proofs from events where event_type='view' group by 1,2) p on v.user_id=p.user_id and cast(v.ts as date)=p.day where v.event_type='error'",
    ),
    "j21_stale_metrics": (
        lambda s, d: E.stale(t(s, d, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.when(F.col("c_custkey") % 4 == 0, "x").otherwise("y")), 256).alias("h")), t(s, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.lit("y")), 256).alias("h")), "c_custkey", "h"),
        "select c_custkey, sha256(c_name || '|y') as h from customer where c_custkey%3=0 or c_custkey%4=0",
    ),
    "j22_orphans": (lambda s, d: E.orphans(t(s, d, "orders").select("o_orderkey", "o_custkey"), t(s, d, "customer").filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey"), "select o_custkey, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey%10<>0)"),
    "j27_priority_patterns": (
        lambda s, d: E.pattern_join(t(s, d, "part").select(F.col("p_type").alias("key")).distinct(), patterns(s), {"SMALL PLATED BRASS": 1, "PROMO BURNISHED COPPER": 2}, ["ECONOMY ANODIZED BRASS"], ["LARGE PLATED BRASS"]),
        """with p(slot,idx,pattern,weight) as (values ('a',0,'*BRASS',5),('a',1,'*STEEL',0),('b',0,'SMALL*',0),('b',1,'*PLATED*',10),('b',2,'PROMO BRUSHED STEEL',0),('c',0,'*',0)), h as (select *, row_number() over (partition by slot, key order by idx) r from (select distinct p_type as key from part) k join p on k.key like replace(p.pattern,'*','%') where key <> 'ECONOMY ANODIZED BRASS'), sc as (select slot, key, case key when 'SMALL PLATED BRASS' then 1 when 'PROMO BURNISHED COPPER' then 2 else 999 end rk, 1000-idx+weight+(case when pattern=key then 120 else 0 end)+(case key when 'LARGE PLATED BRASS' then 25 else 0 end) s0 from h where r=1), s2 as (select slot, key, rk, s0+greatest(0,80-5*rk) as score from sc) select slot, key, cast(score as integer) as score from (select *, row_number() over (partition by slot order by score desc, rk, key) r from s2) where r=1""",
    ),
    "j28_u03_static_and_runtime": (
        lambda s, d: t(s, d, "events").selectExpr("event_type as kind", "'runtime' as plane").unionByName(t(s, d, "conversations").selectExpr("role as kind", "'static' as plane", "turn"), allowMissingColumns=True).join(s.createDataFrame([("click", 1.0), ("user", 2.0)], "kind string, dz double"), "kind", "left").groupBy("plane", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("dz", F.lit(0.5))).alias("dz")),
        "select plane, kind, count(*) as n, sum(case kind when 'click' then 1.0::double when 'user' then 2.0::double else 0.5::double end) as dz from (select event_type as kind, 'runtime' as plane from events union all select role, 'static' from conversations) group by 1,2",
    ),
    "j29_layer_rules": (
        lambda s, d: t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n")).join(s.createDataFrame([("O", "1-URGENT"), ("F", "2-HIGH"), ("P", "5-LOW")], "a string, b string"), ["a", "b"], "left_anti"),
        "select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders where (o_orderstatus, o_orderpriority) not in (('O','1-URGENT'),('F','2-HIGH'),('P','5-LOW')) group by 1,2",
    ),
    "j30_change_locality": (lambda s, d: changes(s, d).filter(~X.node_matches("^part/1", "path")).groupBy("path").agg(F.count("*").alias("n")), f"select path, count(*) as n from {CHANGES} where path not like 'part/1%' group by 1"),
    "j31_exists_discontinuity": (
        lambda s, d: t(s, d, "orders").alias("o").join(t(s, d, "lineitem").filter("l_discount > 0.05").alias("l"), (F.col("o.o_orderkey") == F.col("l.l_orderkey")) & (F.col("l.l_linenumber") > 3), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n")),
        "select o_orderstatus, count(*) as n from orders o where exists (select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l.l_discount>0.05 and l.l_linenumber>3) group by 1",
    ),
    "a28_finding_dedup": (
        lambda s, d: E.fused_findings(findings(s, d), ["tool", "rule"], "line").select("tool", "rule", "line", "severity", F.round("confidence", 6).alias("confidence"), F.array_join("trace", ",").alias("trace"), "n"),
        "select tool, rule, min(line) as line, max(severity) as severity, round(avg(confidence),6) as confidence, array_to_string(list_sort(list(distinct trace)),',') as trace, count(*) as n from (select *, sum(nw) over (partition by tool, rule order by line, doc_id rows unbounded preceding) isl from (select *, case when line - lag(line) over (partition by tool, rule order by line, doc_id) <= 2 then 0 else 1 end nw from (select source as tool, lang as rule, doc_id//3 as line, doc_id%4 as severity, (doc_id%10)/10.0 as confidence, 't' || (doc_id%5) as trace, doc_id from documents))) group by tool, rule, isl",
    ),
    "a29_finding_priority": (priority, f"select doc_id, round(score,6) as score, case when score>=1.8 then 'block' when score>=1.2 then 'review' when score>=0.8 then 'fixable' else 'triage' end as action from {PRIORITY}"),
    "a31_daily_violations": (
        lambda s, d: t(s, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("rate")),
        "select event_type, date_trunc('day', ts) as day, count(*) as n, round(avg(case when value>50 then 1 else 0 end),6) as rate from events group by 1,2",
    ),
    "a32_operational_ratios": (ratios, "select event_type, round(count(*) filter (where value>50)/cast(count(*) as double),6) as share, round(median(value),6) as median, count(distinct user_id) as users from events group by 1"),
    "a47_conservation": (
        lambda s, d: E.conserved(t(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("z")).withColumn("dz", F.coalesce(F.col("z") - F.lag("z").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("conv_id").orderBy("turn")), F.col("z"))), "conv_id", "turn", "z", "dz").selectExpr("conv_id", "cast(total as bigint) as total", "cast(change as bigint) as change", "conserved"),
        "select conv_id, cast(sum(case when r>1 then dz else 0 end) as bigint) as total, cast(arg_max(z,turn)-arg_min(z,turn) as bigint) as change, sum(case when r>1 then dz else 0 end)=arg_max(z,turn)-arg_min(z,turn) as conserved from (select *, z-lag(z) over (partition by conv_id order by turn) dz, row_number() over (partition by conv_id order by turn) r from (select conv_id, turn, length(text) z from conversations)) group by 1",
    ),
    "a48_hot_paths": (
        lambda s, d: tokens(s, d).groupBy("file").agg(F.round(F.sum(F.when(F.col("type").endswith("_FN"), F.col("value")).otherwise(0.0)), 4).alias("ds"), F.round(F.sum(F.when(F.col("type").endswith("_FN"), 0.0).otherwise(F.col("value"))), 4).alias("dh")).filter("dh > ds").orderBy(F.desc(F.col("dh") - F.col("ds")), "file").limit(20),
        f"select file, round(sum(case when type like '%\\_FN' escape '\\' then value else 0 end),4) as ds, round(sum(case when type like '%\\_FN' escape '\\' then 0 else value end),4) as dh from {TOKENS} group by 1 having dh>ds order by dh-ds desc, file limit 20",
    ),
    "a49_regression_budgets": (
        lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_extendedprice")), 0.95), 4).alias("before"), F.round(F.percentile(F.when(F.col("l_orderkey") % 2 == 1, F.col("l_extendedprice")), 0.95), 4).alias("after")).withColumn("regressed", F.col("after") > 1.05 * F.col("before")),
        "select l_returnflag, round(quantile_cont(l_extendedprice,0.95) filter (where l_orderkey%2=0),4) as before, round(quantile_cont(l_extendedprice,0.95) filter (where l_orderkey%2=1),4) as after, round(quantile_cont(l_extendedprice,0.95) filter (where l_orderkey%2=1),4) > 1.05*round(quantile_cont(l_extendedprice,0.95) filter (where l_orderkey%2=0),4) as regressed from lineitem group by 1",
    ),
    "g08_causal_chain": (chain_rows, "select conv_id*100000+turn as id, conv_id*100000+turn-rn as root, cast(rn as bigint) as depth from (select conv_id, turn, row_number() over (partition by conv_id, grp order by turn)-1 rn from (select *, sum(case when pt is null or pt<>turn-1 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) grp from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) pt from conversations)))"),
    "p03_ignore_policy": (lambda s, d: changes(s, d).filter(~X.any_match("path", [r"\.md$", "part/19"])).groupBy("status").agg(F.count("*").alias("n")), f"select status, count(*) as n from {CHANGES} where path not like '%.md' and not regexp_matches(path,'part/19') group by 1"),
    "p08_range_parse": (
        lambda s, d: t(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat_ws("..", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")).alias("r")).select("r", X.range_base("r").alias("base"), X.range_head("r").alias("head")),
        "select r, case when instr(r,'..')>0 then split_part(r,'..',1) else r || '~1' end as base, case when instr(r,'..')>0 then split_part(r,'..',2) else r end as head from (select case when event_id%2=0 then user_id || '..' || event_id else cast(event_id as varchar) end r from events)",
    ),
    "p11_numeric_guards": (
        lambda s, d: t(s, d, "events").select("event_id", F.round(X.clamp01(F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value") / 60)), 6).alias("clamped"), F.round(X.safe_div("value", F.col("event_id") % 3), 6).alias("ratio"), X.nan_safe(F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(0.25)).alias("safe")),
        "select event_id, round(case when event_id%5=0 or event_id%7=0 then 0 else least(1.0,greatest(0.0,value/60)) end,6) as clamped, round(case when event_id%3=0 then 0 else value/(event_id%3) end,6) as ratio, case when event_id%5=0 then 0.0 when event_id%7=0 then 1.0 else 0.25 end as safe from events",
    ),
    "p12_payload_validation": (
        lambda s, d: payloads(s, d).withColumn("e", X.payload_errors("topic", "payload")).groupBy("topic", F.size("e").alias("errors")).agg(F.count("*").alias("n")),
        PAYLOAD_SQL,
    ),
    "p23_redaction": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.redacted("text", "[0-9]{3}").alias("v")).select("doc_id", F.length("v").alias("n"), F.sha2("v", 256).alias("digest")),
        "select doc_id, length(v) as n, sha256(v) as digest from (select doc_id, regexp_replace(text,'[0-9]{3}','[REDACTED]','g') v from documents)",
    ),
    "s08_insert_if_absent": (
        lambda s, d: E.dedup_insert(t(s, d, "events").filter("event_id % 3 = 0").select("event_id"), t(s, d, "events").select("event_id", "event_type").unionByName(t(s, d, "events").select("event_id", F.lit("zz").alias("event_type"))), "event_id", "event_type"),
        "select event_id, event_type from events where event_id%3<>0",
    ),
    "s09_s17_upsert": (
        lambda s, d: E.upsert(t(s, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment"), t(s, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit("NEW").alias("c_mktsegment")), "c_custkey"),
        "select coalesce(a.k,b.k) as c_custkey, a.c_name as c_name, coalesce(b.seg,a.seg) as c_mktsegment from (select c_custkey k, c_name, c_mktsegment seg from customer where c_custkey%2=0) a full join (select c_custkey k, 'NEW' seg from customer where c_custkey%3=0) b on a.k=b.k",
    ),
    "s11_retention": (lambda s, d: series.latest(t(s, d, "events").select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 5), "select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r from events) where r<=5"),
    "s10_artifact_snapshots": (
        lambda s, d: t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("nodes"), F.count_distinct("o_custkey").alias("keys")).select("o_orderstatus", F.to_json(F.struct("nodes", "keys")).alias("header")),
        "select o_orderstatus, '{\"nodes\":' || count(*) || ',\"keys\":' || count(distinct o_custkey) || '}' as header from orders group by 1",
    ),
}
