"""Tokens of two text versions (A25): work that grows with the text, results of a plain loop."""

import random
import re
import time

from pyspark.sql import functions as F

from driftloom.operators import delta

DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(([^)]*)\)", re.M)
IMPORT = re.compile(r"^[ \t]*((?:import|from)[ \t]+[^\n#]+)", re.M)


def slow(old, new):
    a, b = ({n: x for n, x in DEF.findall(v)} for v in (old, new))
    imports = [dict.fromkeys(x.strip(" ") for x in IMPORT.findall(v)) for v in (old, new)]
    out = [("ΔIMPORT", x) for x in imports[1] if x not in imports[0]]
    out += [("ADD_FN", n) for n in b if n not in a] + [("DEL_FN", n) for n in a if n not in b]
    return sorted(out + [("MODIFY_SIG", n) for n in a if n in b and a[n] != b[n]])


def test_tokens_against_a_loop(spark):
    rng = random.Random(4)
    line = lambda: rng.choice((f"def f{rng.randrange(6)}({rng.choice(('', 'a', 'a,\nb', 'x, import y'))}):", f"  async def g{rng.randrange(3)} (self)", f"import m{rng.randrange(5)} # as", "from a import b  ", "pass", "", "def open(", "def é(a) def f1(b)"))
    texts = [(k, *("\n".join(line() for _ in range(rng.randrange(14))) for _ in range(2))) for k in range(200)]
    df = spark.createDataFrame(texts, "id long, old string, new string")
    got = {r["id"]: sorted(map(tuple, r["t"])) for r in df.select("id", delta.source_tokens(F.col("old"), F.col("new")).alias("t")).collect()}
    # Java's \w is ASCII only
    want = {k: slow(a.replace("é", "-"), b.replace("é", "-")) for k, a, b in texts}
    assert got == want and len({kind for x in want.values() for kind, _ in x}) == 4
    assert spark.createDataFrame([(None, "def a()"), ("def a()", None)], "old string, new string").select(F.explode(delta.source_tokens(F.col("old"), F.col("new")))).count() == 0


def test_a_text_of_many_functions(spark):
    """10,000 functions in each version, which took time by their square or cube."""
    n = 10_000
    df = spark.createDataFrame([tuple("\n".join(f"def f{(k + s) * 7919 % 100_003}(x{k % (2 + s)})" for k in range(n)) for s in (0, 1))], "old string, new string")
    began = time.time()
    kinds = df.select(F.explode(delta.source_tokens(F.col("old"), F.col("new"))).alias("t")).groupBy("t.type").count().collect()
    assert {r["type"]: r["count"] for r in kinds}.keys() == {"ADD_FN", "DEL_FN", "MODIFY_SIG"} and time.time() - began < 30
