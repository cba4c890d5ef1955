"""How the given tables stand in for change data: each role as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K = "cast(get_json_object(props, '$.k') as bigint)"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change tokens from events: a commit is a user, the type follows the event type,
    the path the JSON property."""
    e = t(spark, sf_dir, "events").selectExpr("*", f"{K} as k")
    kind = "case event_type when 'click' then 'MODIFY_SIG_FN' when 'purchase' then 'ADD_FN' when 'error' then 'DEL_CLASS' when 'signup' then 'ADD_FILE' else 'ΔIMPORT+' end"
    path = "concat(element_at(array('app','core','docs','lib'), cast(k % 4 + 1 as int)), '/m', k, case when k % 3 = 0 then '.md' else '.py' end)"
    return e.selectExpr("user_id as commit", f"{kind} as type", f"{path} as file", "ts", "event_id as seq", "value", "k")


TOKENS = """(select user_id as "commit", case event_type when 'click' then 'MODIFY_SIG_FN' when 'purchase' then 'ADD_FN' when 'error' then 'DEL_CLASS' when 'signup' then 'ADD_FILE' else 'ΔIMPORT+' end as type,
 ['app','core','docs','lib'][cast(k % 4 + 1 as int)] || '/m' || k || case when k % 3 = 0 then '.md' else '.py' end as file, ts, event_id as seq, value, k
 from (select *, cast(json_extract(props, '$.k') as bigint) k from events))"""

HIST = f"""(select "commit", key, count(*) cnt from (select "commit", unnest(list_filter(['T:' || type, 'PATH:' || case when split_part(file,'/',1) in ('app','core','analysis','mosaic','delta','docs','tests','bench','io','spec') then split_part(file,'/',1) else 'other' end,
 'LANG:' || case when file like '%.py' then 'py' else 'other' end, case when type like '%\\_FN' escape '\\' then 'KIND:fn' when type like '%\\_CLASS' escape '\\' then 'KIND:class' end], lambda x: x is not null)) as key from {TOKENS}) group by 1, 2)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: an order is a commit, a part a file."""
    x = t(spark, sf_dir, "lineitem")
    return x.selectExpr("l_orderkey as commit", "concat('part/', l_partkey % 200, case when l_partkey % 2 = 0 then '.py' else '.md' end) as path", "case l_returnflag when 'A' then 'A' when 'N' then 'M' else 'D' end as status", "cast(l_quantity as bigint) as adds", "cast(l_linenumber as bigint) as dels", "l_shipdate as ts")


CHANGES = """(select l_orderkey as "commit", 'part/' || (l_partkey % 200) || case when l_partkey % 2 = 0 then '.py' else '.md' end as path, case l_returnflag when 'A' then 'A' when 'N' then 'M' else 'D' end as status,
 cast(l_quantity as bigint) as adds, cast(l_linenumber as bigint) as dels, l_shipdate as ts from lineitem)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the parts: some gone, some new, some with other size or price."""
    p = t(spark, sf_dir, "part")
    prev = p.filter("p_partkey % 7 <> 0").selectExpr("p_brand as file", "p_name as key", "p_size as sig", "sha2(concat(p_type, '/', p_partkey), 256) as body", "p_partkey")
    curr = p.filter("p_partkey % 5 <> 0").selectExpr("p_brand as file", "case when p_partkey % 11 = 0 then concat(p_name, ' v2') else p_name end as key", "case when p_partkey % 3 = 0 then p_size + 1 else p_size end as sig", "sha2(concat(p_type, '/', p_partkey, case when p_partkey % 4 = 0 then '!' else '' end), 256) as body", "p_partkey")
    pick = lambda x: x.groupBy("file", "key").agg(F.max_by("sig", "p_partkey").alias("sig"), F.max_by("body", "p_partkey").alias("body"))
    return pick(prev), pick(curr)


SNAPSHOTS = """prev as (select file, key, arg_max(sig, p_partkey) sig, arg_max(body, p_partkey) body from (select p_brand as file, p_name as key, p_size as sig, sha256(p_type || '/' || p_partkey) as body, p_partkey from part where p_partkey % 7 <> 0) group by 1, 2),
curr as (select file, key, arg_max(sig, p_partkey) sig, arg_max(body, p_partkey) body from (select p_brand as file, case when p_partkey % 11 = 0 then p_name || ' v2' else p_name end as key, case when p_partkey % 3 = 0 then p_size + 1 else p_size end as sig, sha256(p_type || '/' || p_partkey || case when p_partkey % 4 = 0 then '!' else '' end) as body, p_partkey from part where p_partkey % 5 <> 0) group by 1, 2)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as nodes, summed quantities as weighted edges."""
    x = t(spark, sf_dir, "lineitem")
    e = x.selectExpr("concat('s', l_suppkey) as src", "concat('p', l_partkey) as dst", "l_quantity as w").groupBy("src", "dst").agg(F.sum("w").alias("weight"))
    n = t(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as id", "'module' as kind", "s_name as label").unionByName(t(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) as id", "'file' as kind", "p_name as label"))
    return n, e


EDGES = "(select 's' || l_suppkey as src, 'p' || l_partkey as dst, sum(l_quantity) as weight from lineitem group by 1, 2)"
NODES = "(select 's' || s_suppkey as id, 'module' as kind, s_name as label from supplier union all select 'p' || p_partkey, 'file', p_name from part)"


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``graph`` and its returns: every edge from a supplier to a part, and one back for
    what was returned, so that directed paths and cycles go on past one step."""
    n, e = graph(spark, sf_dir)
    back = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst", "l_quantity as w")
    return n, e.unionByName(back.groupBy("src", "dst").agg(F.sum("w").alias("weight")))


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``graph`` by the way that more went: from a supplier to a part, or back where more
    than half of the quantity was returned; so some nodes are on cycles and some are not."""
    x = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("_r"))
    back, s, p = F.col("_r") * 2 > F.col("weight"), F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    return graph(spark, sf_dir)[0], x.select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst"), "weight")


def main_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``graph`` with each part's largest supplier and each supplier's ten largest parts
    only, so that it has communities."""
    n, e = graph(spark, sf_dir)
    place = lambda by, other: F.row_number().over(W.partitionBy(by).orderBy(F.desc("weight"), other))
    return n, e.withColumn("_a", place("dst", "src")).withColumn("_b", place("src", "dst")).filter("_a = 1 OR _b <= 10").drop("_a", "_b")


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A directed graph of nations: from the customer's nation to the supplier's, where
    many orders go; small at any scale, for the iterative operators' twins."""
    li, o = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    e = e.filter("src <> dst AND (src * 7 + dst * 3) % 9 = 0")
    return t(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "'module' as kind", "n_name as label"), e


NATION_EDGES = "(select * from (select c_nationkey as src, s_nationkey as dst, cast(count(*) as double) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2) where src <> dst and (src * 7 + dst * 3) % 9 = 0)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 values as 8 x 8 grey images."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.selectExpr("vec_id as image", "pos % 8 as x", "cast(floor(pos / 8) as int) as y", "least(greatest(cast(v as double) + 0.5D, 0D), 1D) as g")


PIXELS = "(select vec_id as image, cast(pos % 8 as int) as x, cast(pos // 8 as int) as y, least(greatest(cast(v as double) + 0.5, 0.0), 1.0) as g from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings))"
