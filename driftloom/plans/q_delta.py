"""Change-token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import exprs as X
from driftloom.operators import delta as D
from driftloom.plans.roles import CHANGES, HIST, SNAPSHOTS, TOKENS, changes, snapshots, t, tokens

R = lambda *names: [F.round(n, 6).alias(n) for n in names]
PATHS = [*X.TOPS, "other"]


def hist(s, d):
    return D.histogram(tokens(s, d))


def rounded(df, keys=("commit",)):
    return df.select(*keys, *R(*[c for c in df.columns if c not in keys]))


def _t(cond):
    return f"cast(coalesce(sum(cnt) filter (where k='T' and ({cond})), 0) as double)"


FEATURES = f"""(select "commit", n as tokens_total, dt as distinct_types, adds/n as share_add, dels/n as share_del, rens/n as share_rename, mods/n as share_modify, imps/n as share_imports, fo as file_ops,
 n/greatest(1,fo) as density, adds+dels+rens+mods as churn, (adds+dels+rens+mods)/greatest(1,fo) as churn_per_file, log2(n)-l/n as type_entropy, 1-q/(n*n) as type_gini, top/n as top_type_share,
 lpy/lang as lang_share_py, lot/lang as lang_share_other, kfn/n as kind_share_fn, kcl/n as kind_share_class, {', '.join(f'p_{p}/pt as path_share_{p}' for p in PATHS)}
 from (select "commit", cast({_t('true')} as double) n, cast(count(*) filter (where k='T') as double) dt, {_t("t like 'ADD\\_%' escape '\\' or t='ΔIMPORT+'")} adds, {_t("t like 'DEL\\_%' escape '\\' or t='ΔIMPORT-'")} dels, {_t("t like 'RENAME\\_%' escape '\\'")} rens,
 {_t("t in ('MODIFY_SIG_FN','MODIFY_BODY_FN','MODIFY_BODY_CLASS','MOD_FILE')")} mods, {_t("t like 'ΔIMPORT%'")} imps, {_t("t in ('ADD_FILE','DEL_FILE','MOVE_FILE','MOD_FILE')")} fo,
 sum(cnt*log2(cnt)) filter (where k='T') l, sum(cast(cnt as double)*cnt) filter (where k='T') q, max(cnt) filter (where k='T') top, sum(cnt) filter (where k='LANG') lang,
 coalesce(sum(cnt) filter (where k='LANG' and t='py'),0) lpy, coalesce(sum(cnt) filter (where k='LANG' and t='other'),0) lot, coalesce(sum(cnt) filter (where k='KIND' and t='fn'),0) kfn, coalesce(sum(cnt) filter (where k='KIND' and t='class'),0) kcl,
 sum(cnt) filter (where k='PATH') pt, {', '.join(f"coalesce(sum(cnt) filter (where k='PATH' and t='{p}'),0) p_{p}" for p in PATHS)}
 from (select "commit", split_part(key,':',1) k, substr(key, instr(key,':')+1) t, cnt from {HIST}) group by 1))"""
FEATURE_NAMES = ["tokens_total", "distinct_types", "share_add", "share_del", "share_rename", "share_modify", "share_imports", "file_ops", "density", "churn", "churn_per_file", "type_entropy", "type_gini", "top_type_share", "lang_share_py", "lang_share_other", "kind_share_fn", "kind_share_class", *[f"path_share_{p}" for p in PATHS]]
SCORE = "least(1.0, 0.45*least(1.0, churn/greatest(8.0,tokens_total)) + 0.20*(case when distinct_types>1 then least(1.0,greatest(0.0,type_entropy/log2(distinct_types))) else 0.0 end) + 0.20*(1-type_gini) + 0.15*least(1.0, file_ops/16))"


def scored(s, d):
    x = D.change_score(D.features(hist(s, d)))
    zero, sig, ren = F.lit(0.0), F.col("kind_share_fn") * F.col("tokens_total") - 20, F.col("file_ops")
    return x.withColumn("floored", D.escalated(F.col("score"), sig, zero, ren)).withColumn("gate", D.gate(F.col("score"), sig, ren)).withColumn("decision", D.decision(F.col("score"), 0.5, 0.6, 0.7))


def weights(s):
    return s.createDataFrame([("T:MODIFY_SIG_FN", 3.0), ("T:DEL_CLASS", 2.5), ("T:ADD_FN", 1.5)], "token string, weight double")


def risk(s, d):
    h = hist(s, d).filter("key like 'T:%'").withColumnRenamed("key", "token").withColumns({"churn": F.col("commit") % 250, "psnr": (F.col("commit") % 45).cast("double"), "ssim": (F.col("commit") % 10) / 10})
    return rounded(D.weighted_risk(h, weights(s), "commit"))


def diff_lines(s, d):
    x = t(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("v"), "source")
    line = F.when(F.length("v") % 4 == 0, F.concat(F.lit("+"), "v")).when(F.length("v") % 4 == 1, F.concat(F.lit("-"), "v")).when(F.length("v") % 4 == 2, F.concat(F.lit("+++ "), "v")).otherwise(F.concat(F.lit("@@ "), "v"))
    return D.diff_churn(x.select("source", line.alias("line")), "source")


def diff_and_renames(s, d):
    p, c = snapshots(s, d)
    diff, ren = D.snapshot_diff(p, c, ["file", "key"]), D.renames(p, c, ["file"], "key", "body")
    return diff, ren


def label_counts(s, d, cond):
    return t(s, d, "lineitem").filter(cond).groupBy(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("label")).agg(F.count("*").alias("cnt"))


def structure(s, d, cond):
    x = t(s, d, "orders").filter(cond).selectExpr("o_orderstatus as module", "concat('c', o_custkey % 50) as file", "o_orderpriority as label", "cast(o_orderkey % 9 as int) as depth").groupBy("module", "file", "label").agg(F.count("*").alias("cnt"), F.max("depth").alias("depth"))
    w = s.createDataFrame([("1-URGENT", 3, 1), ("2-HIGH", 2, 0), ("3-MEDIUM", 1, 2), ("5-LOW", 0, 3)], "label string, w_s int, w_h int")
    return D.structure_score(x, w, ["module", "file"])


def _structure_sql(cond):
    return f"(select module, file, S, H, Z, S/cast(greatest(1,S+H) as double) as alpha, H/cast(greatest(1,S+H) as double) as beta from (select module, file, cast(sum(ws*cnt) as bigint) S, cast(sum(wh*cnt) as bigint) H, greatest(1, max(depth)) Z from (select o_orderstatus as module, 'c' || (o_custkey % 50) as file, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 else 0 end ws, case o_orderpriority when '1-URGENT' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 0 end wh, o_orderpriority, count(*) cnt, max(cast(o_orderkey % 9 as int)) depth from orders where {cond} group by all) group by 1, 2))"


def fused(s, d):
    x = t(s, d, "lineitem").selectExpr("l_suppkey as uid", "l_returnflag as kind", "concat('p', l_partkey % 20) as file", "cast(l_quantity as bigint) as line", "l_linenumber as severity", "l_discount as confidence", "l_linestatus as evidence", "l_tax as weight")
    return D.fused_tokens(x).select("uid", "kind", "file", F.col("line_bucket").cast("bigint").alias("line_bucket"), "severity", *R("confidence"), F.array_join("evidence", ",").alias("evidence"), "weight")


def rewritten(s, d):
    x = t(s, d, "events").selectExpr("user_id as uid", "case event_type when 'signup' then 'ADD' when 'error' then 'DEL' when 'click' then 'RENAME' when 'view' then 'MODIFY_SIG' else 'OTHER' end as kind", "concat('n', event_id % 17) as old_name", "concat('n', (event_id + 1) % 17) as new_name", "event_id as seq")
    return D.rewritten_tokens(x)


def text_tokens(s, d):
    """Two versions of each document as source: the first word of a line is a function with
    the word after it (then: the next but one) as argument, and words after a comma (then:
    after a full stop) are imports."""
    old = F.regexp_replace(F.regexp_replace("text", r"(?m)^(\w+) (\w+)", r"def $1($2)"), r", (\w+)", ",\nimport $1\n")
    new = F.regexp_replace(F.regexp_replace("text", r"(?m)^(\w+)[ ,.]+\w+[ ,.]+(\w+)", r"def $1($2)"), r"\. (\w+)", ".\nimport $1\n")
    x = t(s, d, "documents").select("doc_id", F.explode(D.source_tokens(old, new)).alias("k"))
    return x.groupBy("k.type", "k.target").agg(F.count("*").alias("cnt"))


FUNCTION, IMPORT = r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(([^)]*)\)", r"(?m)^[ \t]*((?:import|from)[ \t]+[^\n#]+)"
VERSIONS = r"(select doc_id, 'old' as side, regexp_replace(regexp_replace(text, '(?m)^(\w+) (\w+)', 'def \1(\2)', 'g'), ', (\w+)', ',' || chr(10) || 'import \1' || chr(10), 'g') as x from documents union all select doc_id, 'new', regexp_replace(regexp_replace(text, '(?m)^(\w+)[ ,.]+\w+[ ,.]+(\w+)', 'def \1(\2)', 'g'), '\. (\w+)', '.' || chr(10) || 'import \1' || chr(10), 'g') from documents)"
TEXT_TOKENS = f"""with v as materialized {VERSIONS}, i as materialized (select distinct doc_id, side, trim(unnest(regexp_extract_all(x, '{IMPORT}', 1))) as target from v), p as (select doc_id, side, unnest(regexp_extract_all(x, '{FUNCTION}', 1)) as target, unnest(regexp_extract_all(x, '{FUNCTION}', 2)) as args, generate_subscripts(regexp_extract_all(x, '{FUNCTION}', 1), 1) as k from v), f as materialized (select doc_id, side, target, arg_max(args, k) as args from p group by 1, 2, 3),
 t as (select 'ΔIMPORT' as type, target from i n where side = 'new' and not exists (select 1 from i o where o.side = 'old' and o.doc_id = n.doc_id and o.target = n.target) union all select case when a is null then 'ADD_FN' when b is null then 'DEL_FN' else 'MODIFY_SIG' end, target from (select doc_id, target, max(args) filter (where side = 'old') as a, max(args) filter (where side = 'new') as b from f group by 1, 2) where a is distinct from b) select type, target, count(*) as cnt from t group by 1, 2"""


def ngrams(s, d):
    from driftloom.operators import series

    return series.bigrams(tokens(s, d), ["file"], "seq", "type").groupBy("first", "second").agg(F.sum("cnt").alias("cnt"))


SEL = ", ".join(f"round({x}, 6) as {x}" for x in FEATURE_NAMES)
QUERIES = {
    "a01_token_histogram": (hist, f'select "commit", key, cnt from {HIST}'),
    "p02_token_policy": (lambda s, d: D.histogram(D.token_filter(tokens(s, d), include=("ADD_FN", "DEL_CLASS"), exclude_path=r"\.md$")), f"select * from {HIST.replace('from ' + TOKENS, 'from ' + TOKENS + chr(32) + 'where type in (' + chr(39) + 'ADD_FN' + chr(39) + ',' + chr(39) + 'DEL_CLASS' + chr(39) + ') and file not like ' + chr(39) + '%.md' + chr(39))}"),
    "a02_features": (lambda s, d: rounded(D.features(hist(s, d))), f'select "commit", {SEL} from {FEATURES}'),
    "a03_a04_entropy_gini": (
        lambda s, d: rounded(D.entropy_gini(hist(s, d).filter("key like 'T:%'"), "commit")),
        f"""select "commit", round(h,6) as entropy, round(case when k>1 then h/log2(k) else 0 end,6) as entropy_norm, round(1-q/(n*n),6) as impurity, round(2*w/(k*n)-(k+1)/cast(k as double),6) as gini from (select "commit", log2(sum(cnt))-sum(cnt*log2(cnt))/sum(cnt) h, count(*) k, cast(sum(cnt) as double) n, sum(cast(cnt as double)*cnt) q, cast(sum(r*cnt) as double) w from (select *, row_number() over (partition by "commit" order by cnt) r from {HIST} where key like 'T:%') group by 1)""",
    ),
    "a05_change_score": (lambda s, d: rounded(scored(s, d).select("commit", "score", "floored")), f"""select "commit", round(sc,6) as score, round(greatest(sc, case when sig>=1 then 0.7 else 0 end, case when file_ops>=3 then 0.55 else 0 end),6) as floored from (select *, kind_share_fn*tokens_total-20 sig, {SCORE} sc from {FEATURES})"""),
    "a06_gate": (lambda s, d: scored(s, d).groupBy("gate").agg(F.count("*").alias("n")), f"""select gate, count(*) as n from (select case when kind_share_fn*tokens_total-20>=1 then 'I4' when file_ops>=5 then greatest(g,'I3') else g end as gate from (select *, case when {SCORE}<0.25 then 'I1' when {SCORE}<0.5 then 'I2' when {SCORE}<0.75 then 'I3' else 'I4' end g from {FEATURES})) group by 1"""),
    "a07_weighted_risk": (
        risk,
        f"""select "commit", round(least(1.0, 0.5*least(1.0, w/n/2.5) + 0.3*least(1.0,("commit"%250)/200.0) + 0.1*(case when "commit"%45<20 then 1 else 0 end) + 0.1*(1-("commit"%10)/10.0)),6) as risk from (select "commit", sum(cnt*case key when 'T:MODIFY_SIG_FN' then 3.0 when 'T:DEL_CLASS' then 2.5 when 'T:ADD_FN' then 1.5 else 1.0 end) w, sum(cnt) n from {HIST} where key like 'T:%' group by 1)""",
    ),
    "a08_report_risk": (
        lambda s, d: tokens(s, d).groupBy("commit").agg(F.count_if(F.col("type") == "MODIFY_SIG_FN").alias("m"), F.count_if(F.col("type") == "ΔIMPORT+").alias("i")).select("commit", F.round(D.report_risk(F.col("m"), F.col("i"), (F.col("commit") % 60).cast("double"), (F.col("commit") % 10) / 10), 6).alias("risk")),
        f"""select "commit", round(0.6*least(1.0,(m+i)/100.0)+0.2*(case when "commit"%60>=40 then 0 when "commit"%60<=20 then 1 else (40-"commit"%60)/20.0 end)+0.2*(1-("commit"%10)/10.0),6) as risk from (select "commit", count(*) filter (where type='MODIFY_SIG_FN') m, count(*) filter (where type='ΔIMPORT+') i from {TOKENS} group by 1)""",
    ),
    "a09_decision": (lambda s, d: scored(s, d).groupBy("decision").agg(F.count("*").alias("n")), f"select case when {SCORE}>0.7 then 'hard-block' when {SCORE}>0.6 then 'block' when {SCORE}>0.5 then 'review' else 'ok' end as decision, count(*) as n from {FEATURES} group by 1"),
    "a10_diff_churn": (diff_lines, """select source, count(*) filter (where n%4=0) as adds, count(*) filter (where n%4=1) as dels, count(*) filter (where n%4=3) as hunks from (select source, length(v) n from (select source, unnest(string_split(text, chr(10))) v from documents)) group by 1"""),
    "a11_diff_summary": (
        lambda s, d: D.diff_summary(changes(s, d).withColumn("ext", X.extension("path")), ["ext"]),
        f"""select case when path like '%.py' then 'py' else 'md' end as ext, count(distinct path) as files, count(*) filter (where status='A') as "n_A", count(*) filter (where status='M') as "n_M", count(*) filter (where status='D') as "n_D", count(*) filter (where status='R') as "n_R", count(*) filter (where status='C') as "n_C", cast(sum(adds) as bigint) as adds, cast(sum(dels) as bigint) as dels, cast(sum(adds)+sum(dels) as bigint) as delta, cast(sum(adds)-sum(dels) as bigint) as net from {CHANGES} group by 1""",
    ),
    "a12_status_counters": (
        lambda s, d: changes(s, d).groupBy("path").pivot("status", ["A", "M", "D"]).agg(F.count(F.lit(1))).fillna(0, ["A", "M", "D"]).select("path", F.col("A").alias("added"), F.col("M").alias("modified"), F.col("D").alias("deleted")),
        f"select path, count(*) filter (where status='A') as added, count(*) filter (where status='M') as modified, count(*) filter (where status='D') as deleted from {CHANGES} group by 1",
    ),
    "a20_structure_score": (lambda s, d: rounded(structure(s, d, "o_orderkey % 2 = 0"), ("module", "file", "S", "H", "Z")), f'select module, file, S as "S", H as "H", Z as "Z", round(alpha,6) as alpha, round(beta,6) as beta from {_structure_sql("o_orderkey % 2 = 0")}'),
    "a21_j05_merged_deltas": (
        lambda s, d: D.merged_deltas(structure(s, d, "o_orderkey % 2 = 0"), structure(s, d, "o_orderkey % 3 = 0"), "file", "module").withColumn("dalpha", F.round("dalpha", 6)),
        f"""select b.module as module, cast(sum(h.S-b.S) as bigint) as "dS", cast(sum(h.H-b.H) as bigint) as "dH", cast(sum(h.Z-b.Z) as bigint) as "dZ", round(sum(h.S)/sum(greatest(1,h.S+h.H))-sum(b.S)/sum(greatest(1,b.S+b.H)),6) as dalpha, count(*) as files from {_structure_sql("o_orderkey % 2 = 0")} b join {_structure_sql("o_orderkey % 3 = 0")} h using (module, file) group by 1""",
    ),
    "a24_fingerprint": (lambda s, d: D.fingerprint(hist(s, d), "commit"), f"""select "commit", substr(sha256(array_to_string(list_sort(list(key || '=' || cnt)), ';')), 1, 16) as fingerprint from {HIST} group by 1"""),
    "a25_source_tokens": (text_tokens, TEXT_TOKENS),
    "a26_token_fusion": (fused, """select l_suppkey as uid, l_returnflag as kind, 'p' || (l_partkey % 20) as file, cast(floor(cast(l_quantity as bigint)/5.0)*5 as bigint) as line_bucket, max(l_linenumber) as severity, round(avg(l_discount),6) as confidence, array_to_string(list_sort(list(distinct l_linestatus)), ',') as evidence, max(l_tax) as weight from lineitem group by 1,2,3,4"""),
    "a27_token_rewrite": (
        rewritten,
        """select uid, count(*) filter (where kind='ADD') - count(*) filter (where kind='DEL') as net, arg_min(old_name, seq) filter (where kind='RENAME') as first_name, arg_max(new_name, seq) filter (where kind='RENAME') as last_name, bool_or(kind='MODIFY_SIG') as sig, coalesce(arg_min(old_name, seq) filter (where kind='RENAME') <> arg_max(new_name, seq) filter (where kind='RENAME'), false) as renamed from (select user_id as uid, case event_type when 'signup' then 'ADD' when 'error' then 'DEL' when 'click' then 'RENAME' when 'view' then 'MODIFY_SIG' else 'OTHER' end as kind, 'n' || (event_id % 17) as old_name, 'n' || ((event_id+1) % 17) as new_name, event_id as seq from events) group by 1""",
    ),
    "j01_snapshot_diff": (lambda s, d: diff_and_renames(s, d)[0], f"with {SNAPSHOTS} select coalesce(p.file,c.file) as file, coalesce(p.key,c.key) as key, unnest(list_filter([case when p.file is null then 'ADD' end, case when c.file is null then 'DEL' end, case when p.file is not null and c.file is not null and p.sig is distinct from c.sig then 'MODIFY_SIG' end, case when p.file is not null and c.file is not null and p.body is distinct from c.body then 'MODIFY_BODY' end], lambda x: x is not null)) as change from prev p full join curr c on p.file=c.file and p.key=c.key"),
    "j02_renames": (lambda s, d: diff_and_renames(s, d)[1], f"with {SNAPSHOTS} select n.file as file, g.old_key as old_key, n.key as new_key from (select * from curr c where not exists (select 1 from prev p where p.file=c.file and p.key=c.key)) n join (select file, body, max(key) old_key from prev p where not exists (select 1 from curr c where p.file=c.file and p.key=c.key) group by 1,2) g on n.file=g.file and n.body=g.body"),
    "j03_diff_without_renames": (
        lambda s, d: D.without_renamed(*diff_and_renames(s, d), ["file"], "key"),
        f"with {SNAPSHOTS}, ren as (select n.file as file, g.old_key as old_key, n.key as new_key from (select * from curr c where not exists (select 1 from prev p where p.file=c.file and p.key=c.key)) n join (select file, body, max(key) old_key from prev p where not exists (select 1 from curr c where p.file=c.file and p.key=c.key) group by 1,2) g on n.file=g.file and n.body=g.body), diff as (select coalesce(p.file,c.file) as file, coalesce(p.key,c.key) as key, unnest(list_filter([case when p.file is null then 'ADD' end, case when c.file is null then 'DEL' end, case when p.file is not null and c.file is not null and p.sig is distinct from c.sig then 'MODIFY_SIG' end, case when p.file is not null and c.file is not null and p.body is distinct from c.body then 'MODIFY_BODY' end], lambda x: x is not null)) as change from prev p full join curr c on p.file=c.file and p.key=c.key) select * from diff d where not exists (select 1 from ren r where r.file=d.file and ((d.change='ADD' and r.new_key=d.key) or (d.change='DEL' and r.old_key=d.key)))",
    ),
    "j04_label_diff": (
        lambda s, d: D.label_diff(label_counts(s, d, "l_orderkey % 2 = 0"), label_counts(s, d, "l_orderkey % 3 = 0"), ["file", "label"]),
        "select coalesce(b.f,h.f) as file, coalesce(b.l,h.l) as label, greatest(0, coalesce(h.c,0)-coalesce(b.c,0)) as added, greatest(0, coalesce(b.c,0)-coalesce(h.c,0)) as deleted, least(coalesce(b.c,0),coalesce(h.c,0)) as same from (select l_returnflag f, l_linestatus l, count(*) c from lineitem where l_orderkey%2=0 group by 1,2) b full join (select l_returnflag f, l_linestatus l, count(*) c from lineitem where l_orderkey%3=0 group by 1,2) h on b.f=h.f and b.l=h.l",
    ),
    "p01_path_filter": (
        lambda s, d: changes(s, d).filter(X.path_wanted("path", include=[r"part/1\d"], exclude=[r"part/1[13]"], ignore=[r"\.md$"])).groupBy("path").agg(F.count("*").alias("n")),
        rf"select path, count(*) as n from {CHANGES} where not regexp_matches(path,'part/1[13]') and regexp_matches(path,'part/1\d') group by 1",
    ),
    "p04_prefix_suffix": (lambda s, d: changes(s, d).filter(X.prefix_suffix("path", [".md", "part/7"])).groupBy("path").agg(F.count("*").alias("n")), f"select path, count(*) as n from {CHANGES} where path like '%.md' or path like 'part/7%' group by 1"),
    "p09_p10_buckets": (
        lambda s, d: tokens(s, d).groupBy(X.top_bucket("file").alias("top"), X.lang_bucket("file").alias("lang"), X.kind_bucket("type").alias("kind"), X.extension("file").alias("ext"), X.module_id("file").alias("module"), X.first_segment("file").alias("first")).agg(F.count("*").alias("n")),
        f"""select case when split_part(file,'/',1) in ('app','core','docs') then split_part(file,'/',1) else 'other' end as top, case when file like '%.py' then 'py' else 'other' end as lang, case when type like '%\\_FN' escape '\\' then 'fn' when type like '%\\_CLASS' escape '\\' then 'class' end as kind, split_part(file,'.',2) as ext, 'module:' || replace(regexp_replace(file,'\\.py$',''),'/','.') as module, split_part(file,'/',1) as first, count(*) as n from {TOKENS} group by all""",
    ),
    "p20_edge_score": (
        lambda s, d: changes(s, d).groupBy("path", "status").agg(F.count("*").alias("n")).select("path", "status", "n", F.round(X.edge_score("path", "status"), 6).alias("edge")),
        f"select path, status, count(*) as n, round(least(1.0, case status when 'A' then 0.75 when 'M' then 0.7 when 'D' then 0.5 end + case when path like '%.py' then 0.1 else 0 end + 0.02),6) as edge from {CHANGES} group by 1,2",
    ),
    "p21_report_gate": (
        lambda s, d: changes(s, d).groupBy("commit").agg(F.count_distinct("path").alias("files"), F.sum(F.col("adds") + F.col("dels")).alias("loc"), F.bool_or(F.col("path").rlike("part/(1|2)[.]")).alias("always")).filter("(files >= 2 and loc >= 20) or always"),
        f"""select "commit", count(distinct path) as files, cast(sum(adds+dels) as bigint) as loc, bool_or(regexp_matches(path,'part/(1|2)[.]')) as always from {CHANGES} group by 1 having (count(distinct path)>=2 and sum(adds+dels)>=20) or bool_or(regexp_matches(path,'part/(1|2)[.]'))""",
    ),
    "u01_set_difference": (
        lambda s, d: snapshots(s, d)[1].select("key").distinct().join(snapshots(s, d)[0].select("key"), "key", "left_anti").withColumn("side", F.lit("new")).unionByName(snapshots(s, d)[1].select("key").distinct().join(snapshots(s, d)[0].select("key"), "key", "left_semi").withColumn("side", F.lit("both"))),
        f"with {SNAPSHOTS} select key, 'new' as side from (select key from curr except select key from prev) union all select key, 'both' from (select key from curr intersect select key from prev)",
    ),
    "w04_bigrams": (ngrams, f"select a as first, b as second, count(*) as cnt from (select type a, lead(type) over (partition by file order by seq) b from {TOKENS}) where b is not null group by 1,2"),
}
