"""Named queries over the driver's tables, with DuckDB SQL that gives the same rows.

Where one text means the same to both engines, it is both the query and its check; the others use the operators of this package.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilestream.functions import bitplane, hilbert, wavelet
from tilestream.operators import folds
from tilestream.sources import png

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(name: str, text: str) -> None:
    """A query whose SQL both engines read alike; tables stand in braces."""
    names = set(re.findall(r"\{(\w+)\}", text))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text)


def own(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


PACKETS = """SELECT l_orderkey AS okey, l_linenumber AS line, cast(floor(l_partkey / 16) AS BIGINT) % 64 AS tx, l_suppkey % 64 AS ty, l_linenumber % 6 AS level,
    cast(floor(l_quantity) AS BIGINT) % 8 AS layer, 1 + cast(floor(l_extendedprice) AS BIGINT) % 4096 AS len, l_shipdate FROM {lineitem}"""
VIEWS = """SELECT o_orderkey AS view_id, o_custkey AS session_id, o_orderkey % 48 AS x0, o_custkey % 48 AS y0, 1 + o_orderkey % 9 AS w, 1 + o_custkey % 7 AS h, o_orderkey % 6 AS level FROM {orders}"""
UTILITY = "256.0 * pow(2.0, 2 * (7 - layer)) / len"

shared("tile_grid_counts", "SELECT cast(floor(l_partkey / 16) AS BIGINT) AS tx, cast(floor(l_suppkey / 4) AS BIGINT) AS ty, count(*) AS packets, cast(sum(l_linenumber) AS BIGINT) AS layers FROM {lineitem} GROUP BY 1, 2")
shared("viewport_cap", """WITH v AS (SELECT o_orderkey AS view_id, o_orderkey % 100 AS x0, o_custkey % 100 AS y0, 1 + o_orderkey % 40 AS w, 1 + o_custkey % 40 AS h FROM {orders}),
c AS (SELECT *, x0 + cast(floor(w / 2) AS BIGINT) AS cx, y0 + cast(floor(h / 2) AS BIGINT) AS cy FROM v)
SELECT view_id, CASE WHEN w * h > 256 THEN greatest(x0, cx - 8) ELSE x0 END AS ax, CASE WHEN w * h > 256 THEN least(x0 + w - 1, cx + 7) ELSE x0 + w - 1 END AS bx,
CASE WHEN w * h > 256 THEN greatest(y0, cy - 8) ELSE y0 END AS ay, CASE WHEN w * h > 256 THEN least(y0 + h - 1, cy + 7) ELSE y0 + h - 1 END AS bz FROM c""")
EDF = f"""SELECT okey, line, level, layer, round({UTILITY}, 6) AS utility, CASE WHEN tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23 THEN 0 ELSE 1 END AS phase FROM ({PACKETS}) p
WHERE tx BETWEEN 7 AND 24 AND ty BETWEEN 7 AND 24 ORDER BY phase, level, layer, {UTILITY} DESC, okey, line"""
shared("edf_order", EDF)
shared("predictive_order", f"""SELECT okey, line, tx, ty, level, layer FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, level ORDER BY layer, okey, line) AS rn FROM ({PACKETS}) p
WHERE tx BETWEEN 8 AND 24 AND ty BETWEEN 8 AND 23 AND (tx < 24 OR ty BETWEEN 12 AND 19)) q WHERE rn = 1""")
shared("zip_order", f"""SELECT okey, line, level, round(cast(262144 AS DOUBLE) / len, 6) AS utility FROM ({PACKETS}) p WHERE (tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23) OR level = 3
ORDER BY CASE WHEN tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23 THEN 0 ELSE 1 END, level, 262144.0 / len DESC, okey, line LIMIT 4096""")
shared("unsent_packets", f"""SELECT okey, line, tx, ty FROM ({PACKETS}) p WHERE NOT EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_orderkey = p.okey AND o.o_orderstatus = 'F')""")
shared("forget_resend", f"""SELECT okey, line, tx, ty FROM ({PACKETS}) p WHERE EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_orderkey = p.okey AND o.o_orderstatus = 'F') AND tx = 5""")
shared("coalesced_reads", f"SELECT DISTINCT tx, ty, level, layer FROM ({PACKETS}) p")
shared("packets_by_level", f"SELECT level, layer, count(*) AS packets, cast(sum(len) AS BIGINT) AS bytes, max(len) AS longest FROM ({PACKETS}) p GROUP BY level, layer")
shared("sack_blocks", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM {events}),
g AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS grp FROM e WHERE event_id % 7 <> 3),
b AS (SELECT user_id, min(seq) AS block_start, max(seq) + 1 AS block_end FROM g GROUP BY user_id, grp),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY block_start DESC) AS rn FROM b WHERE block_start > 0) SELECT user_id, block_start, block_end FROM r WHERE rn <= 4""")
shared("cumulative_ack", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM {events})
SELECT user_id, coalesce(min(CASE WHEN event_id % 7 = 3 THEN seq END), max(seq) + 1) AS next_seq FROM e GROUP BY user_id""")
shared("is_lost", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 3 THEN 1 ELSE 0 END AS sacked FROM {events}),
w AS (SELECT *, sum(sacked) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS above FROM e) SELECT user_id, event_id FROM w WHERE sacked = 0 AND above >= 3""")
shared("dedup_delivery", """WITH a AS (SELECT user_id, event_id FROM {events} UNION ALL SELECT user_id, event_id FROM {events} WHERE event_id % 5 = 0)
SELECT user_id, count(DISTINCT event_id) AS delivered, count(*) - count(DISTINCT event_id) AS duplicates FROM a GROUP BY user_id""")
shared("lru_evict", """WITH c AS (SELECT p_brand, p_partkey, p_size * 1024 AS bytes, p_partkey % 7 = 0 AS visible FROM {part}),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY p_brand ORDER BY visible, p_partkey) AS cum, sum(bytes) OVER (PARTITION BY p_brand) AS total FROM c) SELECT p_partkey, cast(bytes AS BIGINT) AS bytes FROM s WHERE total - (cum - bytes) > 1048576""")
shared("viewport_probe", """WITH c AS (SELECT event_id, user_id, ts FROM {events} WHERE event_type = 'click'), v AS (SELECT event_id AS hit_id, user_id AS u, ts AS t FROM {events} WHERE event_type = 'view'),
j AS (SELECT event_id, hit_id, row_number() OVER (PARTITION BY event_id ORDER BY t, hit_id) AS rn FROM c JOIN v ON u = user_id AND t >= ts AND t < ts + INTERVAL 2 DAY) SELECT event_id, hit_id FROM j WHERE rn = 1""")
shared("load_shed", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, least(1.0, count(DISTINCT user_id) / 16.0) AS load FROM {events} GROUP BY 1),
p AS (SELECT hour, load, lag(load >= 0.7) OVER (ORDER BY hour) AS was FROM h) SELECT hour, cast(load AS DOUBLE) AS load FROM p WHERE was IS NULL OR was <> (load >= 0.7)""")
shared("pyramid_levels", """WITH l AS (SELECT cast(floor(c_custkey / 32) AS BIGINT) AS image_id, c_custkey % 32 AS level, 2 + c_custkey * 37 AS w, 3 + c_custkey * 29 AS h FROM {customer}),
t AS (SELECT image_id, level, cast(ceil(w / 64.0) AS BIGINT) AS tiles_x, cast(ceil(h / 64.0) AS BIGINT) AS tiles_y FROM l)
SELECT image_id, level, tiles_x, tiles_y, cast(coalesce(sum(tiles_x * tiles_y) OVER (PARTITION BY image_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id FROM t""")
shared("progressive_steps", f"""SELECT tx, ty, level, layer, len, coalesce(layer - lag(layer) OVER (PARTITION BY tx, ty, level ORDER BY layer, okey, line, len), -1) AS step FROM ({PACKETS}) p""")


@own(f"""WITH v AS ({VIEWS.replace("{orders}", "orders")}), t AS (SELECT tx, ty, count(*) AS packets FROM ({PACKETS.replace("{lineitem}", "lineitem")}) p GROUP BY tx, ty)
SELECT view_id, tx, ty, packets, (tx BETWEEN x0 AND x0 + w - 1 AND ty BETWEEN y0 AND y0 + h - 1) AS visible FROM v JOIN t ON tx BETWEEN x0 - 1 AND x0 + w AND ty BETWEEN y0 - 1 AND y0 + h""")
def viewport_tiles(spark, sf_dir):
    """Tiles of each view and of the ring around it. A view names its cells, at most 11 by 9, so tiles join by equality. There are at most 127 by 127
    tiles, remainders of 64, so they go to every executor and cells are neither shuffled nor sorted; views are dealt out before they name cells."""
    v = spark.sql(VIEWS, orders=table(spark, sf_dir, "orders")).where("w >= -1 AND h >= -1").repartition("view_id")  # sequence() would count down
    t = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem")).groupBy("tx", "ty").agg(F.count("*").alias("packets"))
    cells = v.withColumn("tx", F.explode(F.expr("sequence(x0 - 1, x0 + w)"))).withColumn("ty", F.explode(F.expr("sequence(y0 - 1, y0 + h)")))
    return cells.join(F.broadcast(t), ["tx", "ty"]).select("view_id", "tx", "ty", "packets", F.expr("tx BETWEEN x0 AND x0 + w - 1 AND ty BETWEEN y0 AND y0 + h - 1").alias("visible"))


XY = """h0 AS (SELECT x, y, x AS cx, y AS cy, cast(0 AS BIGINT) AS d, cast({side} AS BIGINT) AS s FROM cells),
h AS (SELECT * FROM h0 UNION ALL SELECT x, y,
 CASE WHEN cy >= s THEN cx - CASE WHEN cx >= s THEN s ELSE 0 END WHEN cx >= s THEN s - 1 - cy ELSE cy END,
 CASE WHEN cy >= s THEN cy - s WHEN cx >= s THEN s - 1 - (cx - s) ELSE cx END,
 d + s * s * CASE WHEN cx >= s AND cy >= s THEN 2 WHEN cx >= s THEN 3 WHEN cy >= s THEN 1 ELSE 0 END, s // 2 FROM h WHERE s > 0)"""


@own("WITH RECURSIVE cells AS (SELECT DISTINCT (l_partkey // 16) % 64 AS x, l_suppkey % 64 AS y FROM lineitem), " + XY.replace("{side}", "32") + " SELECT x, y, d FROM h WHERE s = 0")
def hilbert_order(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_partkey") / 16) % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).distinct()
    return cells.select("x", "y", hilbert.xy2d("x", "y", 6).alias("d"))


@own("SELECT count(DISTINCT (l_partkey // 16 % 64, l_suppkey % 64)) AS cells, cast(0 AS BIGINT) AS wrong FROM lineitem")
def hilbert_inverse_check(spark, sf_dir):
    c = hilbert_order(spark, sf_dir).withColumn("p", hilbert.d2xy("d", 6))
    return c.agg(F.count("*").alias("cells"), F.count_if((F.col("p.x") != F.col("x")) | (F.col("p.y") != F.col("y"))).alias("wrong"))


@own("WITH RECURSIVE p AS (" + PACKETS.replace("{lineitem}", "lineitem") + "), cells AS (SELECT DISTINCT tx AS x, ty AS y FROM p), " + XY.replace("{side}", "32") + f""",
q AS (SELECT okey, line, level, layer, {UTILITY} AS u, h.d AS hilbert, CASE WHEN tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23 THEN 0 ELSE 1 END AS deadline FROM p JOIN h ON h.x = tx AND h.y = ty AND h.s = 0 WHERE tx BETWEEN 7 AND 24 AND ty BETWEEN 7 AND 24)
SELECT okey, line, level, layer, hilbert, deadline, round(u, 6) AS utility FROM q ORDER BY deadline, level, layer, u DESC, hilbert, okey, line LIMIT 500""")
def progressive_order(spark, sf_dir):
    """The packets that a viewport gets first: visible tiles, then level, layer, utility and place on the curve."""
    p = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem")).where("tx BETWEEN 7 AND 24 AND ty BETWEEN 7 AND 24")
    p = p.withColumn("u", F.expr(UTILITY)).withColumn("hilbert", hilbert.xy2d("tx", "ty", 6)).withColumn("deadline", F.expr("CASE WHEN tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23 THEN 0 ELSE 1 END"))
    return p.orderBy("deadline", "level", "layer", F.desc("u"), "hilbert", "okey", "line").limit(500).select("okey", "line", "level", "layer", "hilbert", "deadline", F.round("u", 6).alias("utility"))


RASTER = "SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, cast(floor(cast(embedding[i] AS DOUBLE) * 128) AS INTEGER) AS v FROM embeddings, range(1, 65) r(i)"


def raster(spark, sf_dir):
    """Embeddings as rasters of 8 by 8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return e.select("vec_id", (F.col("p") % 8).alias("x"), F.shiftright("p", 3).alias("y"), F.floor(F.col("e").cast("double") * 128).cast("int").alias("v"))


def haar_sql(levels: int) -> str:
    parts, last = [f"c0 AS ({RASTER})"], "c0"
    for k in range(levels):
        half = 8 >> (k + 1)
        for axis, other in (("x", "y"), ("y", "x")):
            a, b = f"{last}p", f"{last}{axis}"
            parts.append(f"{a} AS (SELECT vec_id, {other}, {axis} // 2 AS i, max(CASE WHEN {axis} % 2 = 0 THEN v END) AS a0, max(CASE WHEN {axis} % 2 = 1 THEN v END) AS a1 FROM {last} WHERE x < {2 * half} AND y < {2 * half} GROUP BY ALL)")
            parts.append(f"{b} AS (SELECT vec_id, {other}, i AS {axis}, a0 + ((a1 - a0) >> 1) AS v FROM {a} UNION ALL SELECT vec_id, {other}, i + {half}, a1 - a0 FROM {a} UNION ALL SELECT vec_id, {other}, {axis}, v FROM {last} WHERE x >= {2 * half} OR y >= {2 * half})")
            last = b
    return f"WITH {', '.join(parts)} SELECT vec_id, cast(x AS INTEGER) AS x, cast(y AS INTEGER) AS y, v FROM {last}"


@own(haar_sql(1))
def haar_level1(spark, sf_dir):
    return wavelet.forward(raster(spark, sf_dir), "vec_id", 8, 1).select("vec_id", "x", "y", "v")


@own(haar_sql(3))
def haar_level3(spark, sf_dir):
    return wavelet.forward(raster(spark, sf_dir), "vec_id", 8, 3).select("vec_id", "x", "y", "v")


@own("SELECT count(*) * 64 AS pixels, cast(0 AS BIGINT) AS wrong FROM embeddings")
def haar_roundtrip(spark, sf_dir):
    first = raster(spark, sf_dir)
    back = wavelet.inverse(wavelet.forward(first, "vec_id", 8, 3), "vec_id", 8, 3).withColumnRenamed("v", "w")
    return first.join(back, ["vec_id", "x", "y"]).agg(F.count("*").alias("pixels"), F.count_if(F.col("v") != F.col("w")).alias("wrong"))


@own(f"WITH h AS ({haar_sql(3)}) SELECT vec_id, cast(greatest(0, least(255, v + 128)) AS INTEGER) AS v FROM h WHERE x = 0 AND y = 0")
def overview(spark, sf_dir):
    return haar_level3(spark, sf_dir).where("x = 0 AND y = 0").select("vec_id", F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") + 128)).alias("v"))


@own(f"WITH r AS ({RASTER}) SELECT vec_id, cast(CASE WHEN max(abs(v)) = 0 THEN 0 ELSE length(ltrim(bin(max(abs(v))), '0')) END AS INTEGER) AS planes FROM r GROUP BY vec_id")
def bitplane_counts(spark, sf_dir):
    m = raster(spark, sf_dir).groupBy("vec_id").agg(F.max(F.abs("v")).alias("m"))
    return m.select("vec_id", F.when(F.col("m") == 0, 0).otherwise(F.length(F.bin("m"))).alias("planes"))


@own(f"""WITH r AS ({RASTER}), n AS (SELECT vec_id, max(abs(v)) AS most FROM r GROUP BY vec_id),
b AS (SELECT vec_id, p, y, x, CASE WHEN (abs(v) >> p) & 1 = 0 THEN '0' WHEN abs(v) >> p > 1 THEN '1' WHEN v < 0 THEN '11' ELSE '10' END AS bits FROM r JOIN n USING (vec_id), range(0, 31) q(p) WHERE (most >> p) > 0)
SELECT vec_id, cast(p AS INTEGER) AS plane, string_agg(bits, '' ORDER BY y, x) AS bits FROM b GROUP BY vec_id, p""")
def bitplane_stream(spark, sf_dir):
    """Every plane of each vector, as many as its largest coefficient has."""
    n = bitplane_counts(spark, sf_dir).where("planes > 0")
    p = raster(spark, sf_dir).join(n, "vec_id").withColumn("plane", F.explode(F.expr("sequence(0, planes - 1)"))).drop("planes")
    p = p.withColumn("bits", F.expr("CASE WHEN shiftright(abs(v), plane) & 1 = 0 THEN '0' WHEN shiftright(abs(v), plane) > 1 THEN '1' WHEN v < 0 THEN '11' ELSE '10' END"))
    return p.groupBy("vec_id", "plane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "bits"))), lambda z: z["bits"]), "").alias("bits"))


@own("""WITH s AS (SELECT a.user_id, a.event_id, a.event_id - b.event_id AS age, b.value AS dx, b.event_id % 7 - 3 AS dy, row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_id DESC) AS rn
FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id BETWEEN a.event_id - 1500 AND a.event_id)
SELECT user_id, event_id, count(*) AS samples, cast(floor(sum(dx * exp(-age / 600.0::DOUBLE)) * 1000 + 0.0001) AS BIGINT) AS dx_milli, cast(floor(sum(dy * exp(-age / 600.0::DOUBLE)) * 1000 + 0.0001) AS BIGINT) AS dy_milli,
cast(floor(255 * exp(-max(age) / 1200.0::DOUBLE) * least(1.0::DOUBLE, count(*) / 3.0::DOUBLE) + 0.0001) AS BIGINT) AS confidence FROM s WHERE rn <= 8 GROUP BY user_id, event_id""")
def pan_prediction(spark, sf_dir):
    """Movement expected from the last 1500 ms, eight samples at most, the older the less; confidence by the oldest of them and their number."""
    last = W.partitionBy("user_id").orderBy("event_id").rangeBetween(-1500, W.currentRow)
    kept = F.collect_list(F.struct("event_id", F.col("value").alias("dx"), (F.col("event_id") % 7 - 3).alias("dy"))).over(last)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", kept.alias("s")).withColumn("s", F.expr("slice(array_sort(s), greatest(1, size(s) - 7), 8)"))
    total = lambda c: F.expr(f"cast(floor(aggregate(s, 0D, (a, x) -> a + x.{c} * exp(-(event_id - x.event_id) / 600D)) * 1000 + 0.0001) AS BIGINT)")
    confidence = F.expr("cast(floor(255 * exp(-(event_id - s[0].event_id) / 1200D) * least(1D, size(s) / 3D) + 0.0001) AS BIGINT)")
    return e.select("user_id", "event_id", F.size("s").cast("long").alias("samples"), total("dx").alias("dx_milli"), total("dy").alias("dy_milli"), confidence.alias("confidence"))


@own(f"WITH r AS ({RASTER}) SELECT cast(k AS INTEGER) AS k, cast(sum(pow(v - sign(v) * ((abs(v) >> k) << k), 2)) AS BIGINT) AS sse FROM r, range(0, 9) q(k) GROUP BY k")
def progressive_sse(spark, sf_dir):
    r = raster(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return r.groupBy("k").agg(F.sum(F.expr("pow(v - sign(v) * shiftleft(shiftright(abs(v), k), k), 2)")).cast("long").alias("sse"))


@own("WITH g AS (SELECT greatest(a.i, b.i) AS m FROM range(0, 512) a(i), range(0, 512) b(i)) SELECT cast(CASE WHEN m < 16 THEN 0 ELSE length(ltrim(bin(m // 16), '0')) END AS INTEGER) AS level, count(*) AS cells FROM g GROUP BY 1")
def resolution_levels(spark, sf_dir):
    g = spark.range(512 * 512).select(F.greatest(F.col("id") % 512, F.floor(F.col("id") / 512)).alias("m"))
    return g.groupBy(F.when(F.col("m") < 16, 0).otherwise(F.length(F.bin(F.floor(F.col("m") / 16)))).alias("level")).agg(F.count("*").alias("cells"))


@own("WITH RECURSIVE " + "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, cast(floor(value * 20) AS BIGINT) AS len FROM events), " + """f AS (SELECT user_id, i, cast(1 AS BIGINT) AS b, cast(1 AS BIGINT) AS n, len + 2 AS sz FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, b + CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN 1 ELSE 0 END, CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN 1 ELSE n + 1 END, CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN len + 2 ELSE sz + len + 2 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max(b) AS batches FROM f GROUP BY user_id""")
def batch_pack(spark, sf_dir):
    return folds.batches(table(spark, sf_dir, "events"), "user_id", "event_id", "cast(floor(value * 20) as bigint)").withColumnRenamed("out", "batches")


@own("WITH RECURSIVE " + """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, cast(floor(value * 60) AS BIGINT) AS len FROM events),
f AS (SELECT user_id, cast(0 AS BIGINT) AS i, cast(0 AS BIGINT) AS r, cast(0 AS BIGINT) AS d FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.i, r + cast(greatest(0, ceil((len - d) / 32832)) AS BIGINT), d + cast(greatest(0, ceil((len - d) / 32832)) AS BIGINT) * 32832 - len FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, max(r) AS rounds FROM f GROUP BY user_id""")
def drr_rounds(spark, sf_dir):
    return folds.rounds(table(spark, sf_dir, "events"), "user_id", "event_id", "cast(floor(value * 60) as bigint)").withColumnRenamed("out", "rounds")


@own("WITH RECURSIVE " + """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) AS us, cast(floor(value * 200) AS DOUBLE) AS cost FROM events),
f AS (SELECT user_id, i, CASE WHEN cost <= 65536 THEN 65536.0::DOUBLE - cost ELSE 65536.0::DOUBLE END AS t, us, CASE WHEN cost <= 65536 THEN 1::BIGINT ELSE 0 END AS ok FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, CASE WHEN least(65536.0::DOUBLE, t + (e.us - f.us) * 1e-5::DOUBLE) >= cost THEN least(65536.0::DOUBLE, t + (e.us - f.us) * 1e-5::DOUBLE) - cost ELSE least(65536.0::DOUBLE, t + (e.us - f.us) * 1e-5::DOUBLE) END, e.us,
ok + CASE WHEN least(65536.0::DOUBLE, t + (e.us - f.us) * 1e-5::DOUBLE) >= cost THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, max(ok) AS sent FROM f GROUP BY user_id""")
def token_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return folds.tokens(e, "user_id", "event_id", "unix_micros(cast(ts as timestamp))", "cast(floor(value * 200) as double)", 1e-5, 65536).withColumnRenamed("out", "sent")


@own("WITH RECURSIVE " + """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value AS v FROM events),
f AS (SELECT user_id, i, v AS s, v / 2 AS d FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.875::DOUBLE * s + 0.125::DOUBLE * v, 0.75::DOUBLE * d + 0.25::DOUBLE * abs(s - v) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(s, 6) AS srtt, round(d, 6) AS rttvar FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def rtt_ewma(spark, sf_dir):
    return folds.smoothed(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", F.round("out.s", 6).alias("srtt"), F.round("out.d", 6).alias("rttvar"))


@own("SELECT user_id, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 6) AS med FROM events")
def rolling_median64(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "round(percentile(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 6) AS med")


@own("SELECT doc_id, cast(p AS INTEGER) AS part, substring(text, cast(p * 1000 + 1 AS INTEGER), 1000) AS data FROM documents, range(0, 1000) r(p) WHERE p * 1000 < length(text)")
def fragment_tiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.posexplode(F.expr("sequence(0, cast(ceil(length(text) / 1000) as int) - 1)")).alias("part", "p"))
    return d.select("doc_id", "part", F.substring("text", F.col("p") * 1000 + 1, F.lit(1000)).alias("data"))


@own("SELECT to_base64(from_hex(sha1(c_name || '258EAFA5-E914-47DA-95CA-C5AB0DC85B11'))) AS token, c_custkey FROM customer")
def accept_token(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.base64(F.unhex(F.sha1(F.concat("c_name", F.lit("258EAFA5-E914-47DA-95CA-C5AB0DC85B11"))))).alias("token"), "c_custkey")


@own("SELECT p_partkey, p_size AS level, p_partkey * 7 AS ack FROM part")
def ack_decode(spark, sf_dir):
    """Big-endian fields written and read with binary expressions."""
    w = table(spark, sf_dir, "part").select("p_partkey", F.expr("unhex(lpad(hex(p_size), 4, '0') || lpad(hex(p_partkey * 7), 8, '0'))").alias("b"))
    return w.select("p_partkey", F.expr("cast(conv(hex(substring(b, 1, 2)), 16, 10) as int) AS level"), F.expr("cast(conv(hex(substring(b, 3, 4)), 16, 10) as bigint) AS ack"))


@own()
def manifest_json(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("manifest"))


@own("SELECT count(*) AS images, cast(0 AS BIGINT) AS wrong FROM embeddings")
def png_codec(spark, sf_dir):
    """Rasters to PNG and back."""
    def check(batches):
        for pdf in batches:
            wrong = 0
            for e in pdf["embedding"]:
                px = (np.floor(np.asarray(e, float) * 128).astype(int) + 128).clip(0, 255).astype(np.uint8).reshape(8, 8, 1)
                wrong += int(not (png.decode(png.encode(px)) == px).all())
            yield pd.DataFrame({"n": [len(pdf)], "w": [wrong]})

    e = table(spark, sf_dir, "embeddings").select("embedding").mapInPandas(check, "n long, w long")
    return e.agg(F.sum("n").alias("images"), F.sum("w").alias("wrong"))


@own("SELECT count(*) AS images, cast(0 AS BIGINT) AS wrong FROM embeddings")
def bitplane_codec(spark, sf_dir):
    """Coefficients to packed bit planes and back."""
    def check(batches):
        for pdf in batches:
            wrong = 0
            for e in pdf["embedding"]:
                v = np.floor(np.asarray(e, float) * 128).astype(np.int64)
                n = bitplane.planes(v)
                wrong += int(not (bitplane.decode(bitplane.encode(v, n), len(v), n) == v).all())
            yield pd.DataFrame({"n": [len(pdf)], "w": [wrong]})

    e = table(spark, sf_dir, "embeddings").select("embedding").mapInPandas(check, "n long, w long")
    return e.agg(F.sum("n").alias("images"), F.sum("w").alias("wrong"))
