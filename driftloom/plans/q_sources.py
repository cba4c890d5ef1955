"""Sources and sinks over the given tables: the tables written in the form that a reader
takes (log lines, JSON reports, histories), read again and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import exprs as X
from driftloom.operators import delta as D
from driftloom.plans.q_stream import batch, flat, shared, stream
from driftloom.plans.roles import CHANGES, SNAPSHOTS, changes, snapshots, t
from driftloom.sources import logs
from driftloom.streaming import events as T

ENVELOPE = "event_id long, ts timestamp, user_id long, topic string, value double"
#: Levels of a scanner's results, by turns.
LEVELS = ("error", "warning", "note", "other")


def counted(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def log_lines(s, d):
    """Name-status lines of the change log; every fifth change is a rename."""
    line = "case when adds % 5 = 0 then concat('R090\t', 'old/', path, '\t', path) else concat(status, '\t', path) end as value"
    return changes(s, d).selectExpr(line)


def nul_lists(s, d):
    """A NUL-separated list of changes a commit (at most seven lines each)."""
    x = changes(s, d).selectExpr("commit", "struct(dels, case when adds % 5 = 0 then concat('R090', char(0), 'old/', path, char(0), path) else concat(status, char(0), path) end as entry) as e")
    return x.groupBy(F.col("commit").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda v: v["entry"]), "\0").alias("value"))


def numstat_lines(s, d):
    return changes(s, d).selectExpr("case when path like '%.md' then concat('-\t-\t', path) else concat(adds, '\t', dels, '\t', path) end as value")


def shortstat_lines(s, d):
    c = changes(s, d).groupBy("commit").agg(F.count("*").alias("f"), F.sum("adds").alias("a"), F.sum("dels").alias("r"))
    return c.selectExpr("concat(' ', f, ' file', if(f = 1, '', 's'), ' changed, ', a, ' insertion', if(a = 1, '', 's'), '(+)', if(r > 3, concat(', ', r, ' deletions(-)'), '')) as value")


def measure_maps(s, d):
    """A map from path to lines for every commit: bare or under ``files``."""
    c = changes(s, d).groupBy("commit", "path").agg(F.sum("adds").alias("v"))
    m = c.groupBy("commit").agg(F.map_from_entries(F.collect_list(F.struct("path", F.when(F.col("v") > 5, F.col("v").cast("string")).otherwise("n/a")))).alias("files"))
    return m.select(F.when(F.col("commit") % 2 == 0, F.to_json(F.struct("files"))).otherwise(F.to_json("files")).alias("value"))


def churn_reports(s, d):
    entry = F.struct("path", F.struct(F.col("adds").alias("add"), F.when(F.col("dels") > 1, F.col("dels")).alias("del")).alias("loc"))
    return changes(s, d).groupBy("commit").agg(F.collect_list(entry).alias("files")).select(F.to_json(F.struct("files")).alias("value"))


def scanner_reports(s, d):
    """A report for every document: its source is the tool, its language the rule."""
    levels = F.array(*map(F.lit, LEVELS))
    x = t(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("tool"), F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.get(levels, (F.col("doc_id") % 4).cast("int")).alias("level"))
    where = F.struct(F.struct(F.struct(F.concat(F.lit("f"), F.col("doc_id") % 50).alias("uri")).alias("artifactLocation"), F.struct((F.col("doc_id") % 90).cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("lang").alias("ruleId"), "level", F.struct(F.lit("m").alias("text")).alias("message"), F.array(where).alias("locations"))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    return x.select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value"))


def json_folder(s, d):
    """The events as a folder of JSON lines; the time is left out of every tenth."""
    path = f"{shared(s)}-json"
    e = batch(s, d).withColumnRenamed("event_type", "topic").withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    e.select("event_id", "ts", "user_id", "topic", "value").write.json(path)
    return path


def event_log(s, d):
    got = logs.event_log(s, json_folder(s, d), ENVELOPE)
    return got.groupBy("topic").agg(F.count("ts").alias("n"), F.count_if(F.col("ts") < "2024-06-01").alias("dated"), F.sum("event_id").alias("ids"))


def named_report(s, d):
    path = f"{shared(s)}-report"
    logs.report(counted(t(s, d, "events"), "event_type"), path, "v1", "json")
    return s.read.schema("event_type string, n long, version string, digest string").json(path)


def parameters(s, d):
    t(s, d, "events").createOrReplaceTempView("driftloom_events")
    return logs.query(s, "select user_id, count(*) as n, max(value) as top from driftloom_events where event_type = :kind and value >= :least group by user_id", kind="purchase", least=10.0)


def history(s, d):
    path = f"{shared(s)}-history"
    logs.append_events(batch(s, d), path)
    return counted(s.read.parquet(path).filter("date >= '2024-01-10' AND date < '2024-01-20'"), F.col("date").cast("string").alias("day"), "event_type")


def task_files(s, d):
    """One JSON file for every event type, read as documents of several lines."""
    path = f"{shared(s)}-tasks"
    counted(t(s, d, "events"), F.col("event_type").alias("id")).write.option("maxRecordsPerFile", 1).json(path)
    return logs.tasks(s, path, "id string, n long").select("id", "n", F.col("file").endswith(".json").alias("named"))


def tag_values(s, d):
    """Four written forms of a tag's value, by turns."""
    form = """case doc_id % 4 when 0 then concat('["', source, '"]') when 1 then concat(lang, ' -> ', source) when 2 then concat(lang, ', ', source, ',') else concat(' ', lang, ' ') end as v"""
    x = t(s, d, "documents").selectExpr("coalesce(lang, '?') as lang", "coalesce(source, '?') as source", "doc_id").selectExpr(form)
    return counted(x.select(X.tag_value("v").alias("t")).select("t.kind", F.explode("t.items").alias("item")), "kind", "item")


def key_union(s, d):
    """Keys of the vocabularies of customers' segments, order priorities and event types."""
    each = [t(s, d, n).select(F.col(c).alias("key")).distinct() for n, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type"))]
    return each[0].union(each[1]).union(each[2]).distinct()


def disallowed(s, d):
    """Events on topics that aren't in the list of allowed ones."""
    allowed = s.createDataFrame([("click",), ("view",), ("signup",)], "event_type string")
    return counted(t(s, d, "events").join(allowed, "event_type", "left_anti"), "event_type")


def gone_symbols(s, d):
    """Symbols of the older snapshot that the newer has neither by name nor by alias."""
    prev, curr = snapshots(s, d)
    known = curr.select("file", F.regexp_replace("key", " v2$", "").alias("key")).distinct()
    return prev.join(known, ["file", "key"], "left_anti").select("file", "key")


def ingested(s, d):
    out = T.run_once(T.ingest(s, json_folder(s, d), ENVELOPE), shared(s))
    return out.groupBy("topic").agg(F.count("*").alias("n"), F.count("ts").alias("dated"), F.sum("event_id").alias("ids"))


def routed(s, d):
    path = shared(s)
    e = stream(s, d).select("event_id", F.col("event_type").alias("topic"), "value")
    T.route_stream(e, "value > 10 and topic <> 'view'", path).awaitTermination()
    good, bad = (s.read.option("recursiveFileLookup", True).schema("event_id long, value double").json(f"{path}/{k}") for k in ("good", "bad"))
    parts = [x.select(F.lit(k).alias("sink"), "event_id") for k, x in (("good", good), ("bad", bad))]
    return parts[0].union(parts[1]).groupBy("sink").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def finished(s, d):
    a = stream(s, d).filter("event_type = 'signup'").select("user_id", "ts")
    b = stream(s, d).filter("event_type = 'purchase'").select("user_id", "ts")
    out = T.run_once(T.unfinished(a, b, "user_id", "1 day"), shared(s))
    return counted(out.filter("end_ts IS NOT NULL"), "user_id")


def violated(s, d):
    """T4's violations: starts whose time has passed without an end."""
    a = stream(s, d).filter("event_type = 'signup'").select("user_id", "ts")
    b = stream(s, d).filter("event_type = 'purchase'").select("user_id", "ts")
    out = T.run_once(T.unfinished(a, b, "user_id", "1 day"), shared(s))
    return counted(out.filter("end_ts IS NULL"), "user_id")


def streamed_history(s, d):
    path = f"{shared(s)}-history"
    T.to_history(stream(s, d), path, f"{path}-checkpoint").awaitTermination()
    return counted(s.read.parquet(path).filter("date >= '2024-01-10'"), F.col("date").cast("string").alias("day"))


def row_keys(s, d):
    """Keys of each row by a table function, counted over all rows."""
    s.udtf.register("driftloom_row_keys", D.RowKeys)
    t(s, d, "events").selectExpr("event_type as kind", "user_id as bucket").createOrReplaceTempView("driftloom_events")
    return s.sql("select key, count(*) as n from driftloom_row_keys(table(driftloom_events)) group by key")


QUERIES = {
    "s01_name_status": (lambda s, d: counted(logs.name_status(log_lines(s, d)), "status", "old_path", "path"), f"select case when adds % 5 = 0 then 'R' else status end as status, case when adds % 5 = 0 then 'old/' || path else path end as old_path, path, count(*) as n from {CHANGES} group by 1, 2, 3"),
    "s02_name_status_z": (lambda s, d: logs.name_status_z(nul_lists(s, d)), f"""select id, min(pos) as pos, arg_min(status, pos) as status, path from (select "commit" as id, path, case when adds % 5 = 0 then 'R' else status end as status, cast(row_number() over (partition by "commit" order by dels, case when adds % 5 = 0 then 'R' else status end, path) - 1 as int) as pos from {CHANGES}) group by id, path"""),
    "s03_numstat": (lambda s, d: logs.numstat(numstat_lines(s, d)).groupBy("path", "binary").agg(F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.count("*").alias("n")), f"""select path, path like '%.md' as "binary", cast(sum(case when path not like '%.md' then adds end) as bigint) as adds, cast(sum(case when path not like '%.md' then dels end) as bigint) as dels, count(*) as n from {CHANGES} group by 1, 2"""),
    "s04_shortstat": (lambda s, d: counted(logs.shortstat(shortstat_lines(s, d)), "files", "insertions", "deletions"), f"""select cast(f as int) as files, cast(a as int) as insertions, cast(case when r > 3 then r else 0 end as int) as deletions, count(*) as n from (select count(*) f, sum(adds) a, sum(dels) r from {CHANGES} group by "commit") group by 1, 2, 3"""),
    "s05_event_log": (event_log, "select event_type as topic, count(*) as n, count(*) filter (where event_id % 10 <> 0 and ts < timestamp '2024-06-01') as dated, cast(sum(event_id) as bigint) as ids from events group by 1"),
    "s06_report": (named_report, """select event_type, n, 'v1' as version, sha256('{"event_type":"' || event_type || '","n":' || n || '}') as digest from (select event_type, count(*) n from events group by 1)"""),
    "s07_query": (parameters, "select user_id, count(*) as n, max(value) as top from events where event_type = 'purchase' and value >= 10 group by 1"),
    "s12_history": (history, "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' group by 1, 2"),
    "s13_task_files": (task_files, "select event_type as id, count(*) as n, true as named from events group by 1"),
    "s14_measures": (lambda s, d: logs.measures(measure_maps(s, d)).groupBy("path").agg(F.sum("value").alias("total"), F.count("*").alias("n")), f"""select path, cast(sum(v) as double) as total, count(*) as n from (select "commit", path, sum(adds) v from {CHANGES} group by 1, 2) where v > 5 group by 1"""),
    "s15_report_churn": (lambda s, d: logs.report_churn(churn_reports(s, d)).groupBy("path").agg(F.sum("churn").alias("churn")), f"select path, cast(sum(adds + case when dels > 1 then dels else 0 end) as bigint) as churn from {CHANGES} group by 1"),
    "s16_findings": (lambda s, d: counted(logs.findings(scanner_reports(s, d)), "tool", "rule_id", "severity", "file", "line"), "select coalesce(source, 'none') as tool, coalesce(lang, 'none') as rule_id, case doc_id % 4 when 0 then 'HIGH' when 2 then 'LOW' else 'MEDIUM' end as severity, 'f' || (doc_id % 50) as file, cast(doc_id % 90 as int) as line, count(*) as n from documents group by 1, 2, 3, 4, 5"),
    "p16_tag_values": (tag_values, """with x as (select coalesce(lang, '?') l, coalesce(source, '?') s, doc_id % 4 k from documents) select kind, item, count(*) as n from (select 'json' as kind, '["' || s || '"]' as item from x where k = 0 union all select 'pair', unnest([l, s]) from x where k = 1 union all select 'list', unnest([l, s]) from x where k = 2 union all select 'raw', l from x where k = 3) group by 1, 2"""),
    "o04_top_counters": (lambda s, d: counted(changes(s, d), "path").orderBy(F.desc("n"), "path").limit(10), f"select path, count(*) as n from {CHANGES} group by 1 order by n desc, path limit 10"),
    "u02_key_union": (key_union, "select c_mktsegment as key from customer union select o_orderpriority from orders union select event_type from events"),
    "u04_disallowed_topics": (disallowed, "select event_type, count(*) as n from events where event_type not in ('click', 'view', 'signup') group by 1"),
    "u04_gone_symbols": (gone_symbols, f"with {SNAPSHOTS} select file, key from prev p where not exists (select 1 from curr c where c.file = p.file and regexp_replace(c.key, ' v2$', '') = p.key)"),
    "t01_ingest": (ingested, "select event_type as topic, count(*) as n, count(*) filter (where event_id % 10 <> 0) as dated, cast(sum(event_id) as bigint) as ids from events group by 1"),
    "t03_dead_letters": (routed, "select case when value > 10 and event_type <> 'view' then 'good' else 'bad' end as sink, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1"),
    "t04_stream_finished": (finished, "select a.user_id, count(*) as n from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 day where a.event_type = 'signup' and b.event_type = 'purchase' group by 1"),
    "t04_stream_violations": (violated, "with m as (select least(max(ts) filter (where event_type='signup'), max(ts) filter (where event_type='purchase')) - interval 10 minutes as mark from events) select a.user_id, count(*) as n from events a, m where a.event_type='signup' and a.ts + interval 1 day < m.mark and not exists (select 1 from events b where b.event_type='purchase' and b.user_id=a.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 day) group by 1"),
    "t12_stream_history": (streamed_history, "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where ts >= timestamp '2024-01-10' group by 1"),
    "x03_row_keys": (row_keys, "select key, count(*) as n from (select unnest(['T:' || event_type, 'KIND:' || split_part(event_type, '_', 1), 'U:' || (user_id % 10)]) as key from events) group by 1"),
}
