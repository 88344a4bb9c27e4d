"""Queries for multi-objective ranking."""

from pyspark.sql import functions as F

from factloom.operators import ranking
from factloom.plans.registry import query

DOM_CTE = """d AS (SELECT a.p_partkey AS winner, b.p_partkey AS loser FROM part a JOIN part b ON a.p_brand = b.p_brand
  AND a.p_size <= b.p_size AND a.p_retailprice <= b.p_retailprice AND (a.p_size < b.p_size OR a.p_retailprice < b.p_retailprice))"""
LAYER_CTE = f"""{DOM_CTE}, ch AS (SELECT p_partkey AS id, 0 AS k FROM part UNION SELECT d.loser, k + 1 FROM ch JOIN d ON d.winner = ch.id),
fl AS (SELECT p_partkey, p_brand, p_size, p_retailprice, front FROM part JOIN (SELECT id AS p_partkey, max(k) AS front FROM ch GROUP BY id) USING (p_partkey))"""
CROWD_CTE = f"""{LAYER_CTE},
lg AS (SELECT p_partkey, p_brand, front, unnest([1, 2]) AS obj, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM fl),
nb AS (SELECT *, lag(v) OVER w AS prev, lead(v) OVER w AS next, max(v) OVER g - min(v) OVER g AS span, count(*) OVER g AS n FROM lg
  WINDOW w AS (PARTITION BY p_brand, front, obj ORDER BY v, p_partkey), g AS (PARTITION BY p_brand, front, obj)),
cd AS (SELECT p_partkey, p_brand, front, sum(CASE WHEN n <= 2 OR prev IS NULL OR next IS NULL THEN 'inf'::DOUBLE WHEN span = 0 THEN 0.0 ELSE (next - prev) / span END) AS crowding
  FROM nb GROUP BY ALL)"""


def _parts(t):
    return t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("m01_dominated_parts", f"""
WITH {DOM_CTE} SELECT p_partkey, p_partkey IN (SELECT loser FROM d) AS dominated FROM part""")
def _(t):
    return ranking.dominated(_parts(t), ["p_size", "p_retailprice"], ["p_brand"]).select("p_partkey", "dominated")


@query("m01_dominated_lines", """
WITH v AS (SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem),
b AS (SELECT l_suppkey, l_quantity, l_extendedprice, l_discount FROM v x WHERE NOT EXISTS (FROM v y WHERE y.l_suppkey = x.l_suppkey
  AND y.l_quantity >= x.l_quantity AND y.l_extendedprice >= x.l_extendedprice AND y.l_discount >= x.l_discount
  AND (y.l_quantity > x.l_quantity OR y.l_extendedprice > x.l_extendedprice OR y.l_discount > x.l_discount)))
SELECT l_suppkey, count(*) AS lines, count(*) FILTER (b.l_suppkey IS NULL) AS dominated_lines FROM lineitem l LEFT JOIN b USING (l_suppkey, l_quantity, l_extendedprice, l_discount) GROUP BY l_suppkey""")
def _(t):
    objectives = ["l_quantity", "l_extendedprice", "l_discount"]
    flagged = ranking.dominated(t.lineitem.select("l_suppkey", *objectives), objectives, ["l_suppkey"], maximise=True)
    return flagged.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if("dominated").alias("dominated_lines"))


@query("m02_front_layers", f"WITH RECURSIVE {LAYER_CTE} SELECT p_partkey, front::BIGINT AS front FROM fl")
def _(t):
    return ranking.front_layers(_parts(t), ["p_size", "p_retailprice"], ["p_brand"]).select("p_partkey", "front")


def _crowded(t):
    layered = ranking.front_layers(_parts(t), ["p_size", "p_retailprice"], ["p_brand"])
    return ranking.crowding_distance(layered, ["p_size", "p_retailprice"], ["p_brand", "front"], "p_partkey")


def _finite(column):
    return F.when(F.col(column) != float("inf"), F.round(column, 6)).alias(column)


@query("w05_crowding_distance", f"""
WITH RECURSIVE {CROWD_CTE} SELECT p_partkey, front::BIGINT AS front, CASE WHEN crowding < 'inf'::DOUBLE THEN round(crowding, 6) END AS crowding FROM cd""")
def _(t):
    return _crowded(t).select("p_partkey", "front", _finite("crowding"))


@query("k08_isolated_members", """
WITH f AS (SELECT * FROM part x WHERE NOT EXISTS (FROM part y WHERE y.p_size >= x.p_size AND y.p_retailprice >= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice > x.p_retailprice))),
lg AS (SELECT p_partkey, unnest([1, 2]) AS obj, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM f),
nb AS (SELECT *, lag(v) OVER w AS prev, lead(v) OVER w AS next, max(v) OVER g - min(v) OVER g AS span, count(*) OVER g AS n FROM lg
  WINDOW w AS (PARTITION BY obj ORDER BY v, p_partkey), g AS (PARTITION BY obj)),
cd AS (SELECT p_partkey, sum(CASE WHEN n <= 2 OR prev IS NULL OR next IS NULL THEN 'inf'::DOUBLE WHEN span = 0 THEN 0.0 ELSE (next - prev) / span END) AS crowding FROM nb GROUP BY ALL)
SELECT p_partkey FROM cd ORDER BY crowding DESC, p_partkey LIMIT 5""")
def _(t):
    best = ranking.front(_parts(t), ["p_size", "p_retailprice"], maximise=True).withColumn("pool", F.lit(0))
    crowded = ranking.crowding_distance(best, ["p_size", "p_retailprice"], ["pool"], "p_partkey")
    return crowded.orderBy(F.desc("crowding"), "p_partkey").limit(5).select("p_partkey")


@query("m03_selected_parts", f"""
WITH RECURSIVE {CROWD_CTE}, o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY front, crowding DESC, p_partkey) AS rn FROM cd)
SELECT p_brand, p_partkey FROM o WHERE rn <= 20""")
def _(t):
    return ranking.select_best(_parts(t), ["p_size", "p_retailprice"], 20, "p_partkey", ["p_brand"]).select("p_brand", "p_partkey")


FRONT_CTE = """f AS (SELECT DISTINCT p_partkey, p_brand, p_size, p_retailprice FROM part x WHERE NOT EXISTS (FROM part y WHERE y.p_brand = x.p_brand AND y.p_size >= x.p_size
  AND y.p_retailprice >= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice > x.p_retailprice)))"""


def _front(t):
    return ranking.front(_parts(t), ["p_size", "p_retailprice"], ["p_brand"], maximise=True)


@query("m04_hypervolume_2d", f"""
WITH {FRONT_CTE}, u AS (SELECT DISTINCT p_brand, p_size, p_retailprice FROM f WHERE p_size > 5 AND p_retailprice > 850),
s AS (SELECT p_brand, (p_size - 5) * (p_retailprice - coalesce(lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice), 850.0)) AS a FROM u)
SELECT p_brand, round(sum(a), 4) AS hypervolume FROM s GROUP BY p_brand""")
def _(t):
    volume = ranking.hypervolume(_parts(t), ["p_size", "p_retailprice"], [5.0, 850.0], ["p_brand"])
    return volume.select("p_brand", F.round("hypervolume", 4).alias("hypervolume"))


@query("m04_hypervolume_3d", """
WITH p AS (SELECT p_brand AS b, p_size::DOUBLE AS x, p_retailprice AS y, length(p_name)::DOUBLE AS z FROM part WHERE p_size > 0 AND p_retailprice > 800),
l AS (SELECT DISTINCT b, z FROM p), h AS (SELECT b, z, z - coalesce(lag(z) OVER (PARTITION BY b ORDER BY z), 2.0) AS height FROM l),
q AS (SELECT h.b, h.z, height, x, y FROM h JOIN p ON p.b = h.b AND p.z >= h.z),
a AS (SELECT b, height, x * greatest(0.0, y - coalesce(max(y) OVER (PARTITION BY b, z ORDER BY x DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 800.0)) AS s FROM q)
SELECT b AS p_brand, round(sum(height * s), 4) AS hypervolume FROM a GROUP BY b""")
def _(t):
    points = t.part.select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.length("p_name").cast("double").alias("z"))
    volume = ranking.hypervolume(points, ["x", "y", "z"], [0.0, 800.0, 2.0], ["p_brand"])
    return volume.select("p_brand", F.round("hypervolume", 4).alias("hypervolume"))


@query("m05_compromise", f"""
WITH {FRONT_CTE}, b AS (SELECT p_brand, min(p_size) AS l1, max(p_size) AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM f GROUP BY p_brand),
d AS (SELECT p_brand, p_partkey, sqrt(CASE WHEN h1 > l1 THEN power(1 - (p_size - l1) / (h1 - l1), 2) ELSE 0 END + CASE WHEN h2 > l2 THEN power(1 - (p_retailprice - l2) / (h2 - l2), 2) ELSE 0 END) AS dist
  FROM f JOIN b USING (p_brand)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(dist, 12), p_partkey) AS rn FROM d)
SELECT p_brand, p_partkey, round(dist, 6) AS distance FROM r WHERE rn = 1""")
def _(t):
    picked = ranking.compromise(_front(t), ["p_size", "p_retailprice"], "p_partkey", ["p_brand"])
    return picked.select("p_brand", "p_partkey", F.round("distance", 6).alias("distance"))


@query("m06_champions", f"""
WITH {FRONT_CTE} SELECT p_brand, 'p_size' AS objective, first(p_partkey ORDER BY p_size DESC, p_partkey) AS p_partkey, max(p_size)::DOUBLE AS value FROM f GROUP BY p_brand
UNION ALL SELECT p_brand, 'p_retailprice', first(p_partkey ORDER BY p_retailprice DESC, p_partkey), max(p_retailprice) FROM f GROUP BY p_brand""")
def _(t):
    return ranking.champions(_front(t), ["p_size", "p_retailprice"], "p_partkey", ["p_brand"])


@query("m07_merged_archive", """
WITH a AS (SELECT p_brand, p_name, p_size AS s, p_retailprice AS r, p_partkey AS id, 0 AS b FROM part WHERE p_type = 'ECONOMY'),
n AS (SELECT p_brand, p_name, p_size AS s, p_retailprice + 5 AS r, p_partkey AS id, 1 AS b FROM part WHERE p_type <> 'ECONOMY'),
u AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY b DESC, id DESC) AS rn FROM (FROM a UNION ALL FROM n)),
m AS (SELECT * FROM u WHERE rn = 1),
f AS (SELECT * FROM m x WHERE NOT EXISTS (FROM m y WHERE y.p_brand = x.p_brand AND y.s >= x.s AND y.r >= x.r AND (y.s > x.s OR y.r > x.r))),
lg AS (SELECT id, p_brand, unnest([1, 2]) AS obj, unnest([s::DOUBLE, r]) AS v FROM f),
nb AS (SELECT *, lag(v) OVER w AS prev, lead(v) OVER w AS next, max(v) OVER g - min(v) OVER g AS span, count(*) OVER g AS c FROM lg
  WINDOW w AS (PARTITION BY p_brand, obj ORDER BY v, id), g AS (PARTITION BY p_brand, obj)),
cd AS (SELECT p_brand, id, sum(CASE WHEN c <= 2 OR prev IS NULL OR next IS NULL THEN 'inf'::DOUBLE WHEN span = 0 THEN 0.0 ELSE (next - prev) / span END) AS cr FROM nb GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cr DESC, id) AS rn FROM cd)
SELECT p_brand, id AS p_partkey FROM o WHERE rn <= 4""")
def _(t):
    # The configuration is the hashed part name: batch two measures some names again.
    columns = ["p_partkey", "p_brand", F.crc32(F.encode("p_name", "UTF-8")).cast("double").alias("config"), "p_size"]
    archive = t.part.where("p_type = 'ECONOMY'").select(*columns, "p_retailprice")
    batch = t.part.where("p_type <> 'ECONOMY'").select(*columns, (F.col("p_retailprice") + 5).alias("p_retailprice"))
    merged = ranking.merge_archive(archive, batch, ["config"], ["p_size", "p_retailprice"], "p_partkey", ["p_brand"], capacity=4, tolerance=1e-3)
    return merged.select("p_brand", "p_partkey")
