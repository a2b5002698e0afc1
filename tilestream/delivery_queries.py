"""Queries of containers, scheduler policies, receivers, caches and requests; they join tilestream.queries.QUERIES."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilestream.operators import schedule
from tilestream.queries import PACKETS, RASTER, own, raster, shared, table

SQL_PACKETS = PACKETS.replace("{lineitem}", "lineitem")

# Containers: index, directory, header, ranges

INDEXED = f"""SELECT okey, line, tx, ty, level, layer, len, cast(coalesce(sum(len) OVER (ORDER BY tx, ty, level, layer, okey, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({SQL_PACKETS}) p"""


@own(INDEXED)
def tile_index(spark, sf_dir):
    """Absolute offset of each packet in a container that holds them by tile, level and layer. Tiles are summed first, so no task holds the table.

    lineitem repeats keys, so the SQL's order leaves ties, which DuckDB itself breaks otherwise from run to run; here they go by file and, in each, from the last row to the first."""
    lines = table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), (-F.col("_metadata.row_index")).alias("place"))
    packets = spark.sql(PACKETS.replace(" FROM", ", file, place FROM"), lineitem=lines)
    return schedule.offsets(packets, ["tx", "ty"], ["level", "layer", "okey", "line", "file", "place"], "len").select("okey", "line", "tx", "ty", "level", "layer", "len", "start")


@own(f"SELECT tx, ty, min(start) AS start, cast(sum(len) AS BIGINT) AS length, count(*) AS packets FROM ({INDEXED}) i GROUP BY tx, ty")
def tile_directory(spark, sf_dir):
    """Offset and length of each tile's packets."""
    return tile_index(spark, sf_dir).groupBy("tx", "ty").agg(F.min("start").alias("start"), F.sum("len").cast("long").alias("length"), F.count("*").alias("packets"))


@own(f"SELECT count(*) AS packets, count(DISTINCT tx * 64 + ty) AS tiles, max(level) AS levels, max(layer) + 1 AS layers, cast(sum(len) AS BIGINT) AS bytes FROM ({SQL_PACKETS}) p")
def container_header(spark, sf_dir):
    """The one header row of a container."""
    p = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem"))
    return p.agg(F.count("*").alias("packets"), F.countDistinct(F.col("tx") * 64 + F.col("ty")).alias("tiles"), F.max("level").alias("levels"), (F.max("layer") + 1).alias("layers"), F.sum("len").cast("long").alias("bytes"))


@own(f"SELECT tx, ty, level, layer, start AS begin_at, start + len AS end_at FROM ({INDEXED}) i WHERE level = 2 AND layer < 3")
def packet_ranges(spark, sf_dir):
    """Byte ranges that one level's first layers are read from."""
    return tile_index(spark, sf_dir).where("level = 2 AND layer < 3").select("tx", "ty", "level", "layer", F.col("start").alias("begin_at"), (F.col("start") + F.col("len")).alias("end_at"))


shared("tile_bytes", f"""SELECT tx, ty, cast(sum(len) AS BIGINT) AS bytes, round(max(256.0 * pow(2.0, 2 * (7 - layer)) / len), 6) AS best, cast(sum(sum(len)) OVER (PARTITION BY tx) AS BIGINT) AS column_bytes FROM ({PACKETS}) p GROUP BY tx, ty""")
shared("phase_times", "SELECT event_type, count(*) AS steps, cast(sum(cast(floor(value * 1000) AS BIGINT)) AS BIGINT) AS micros, cast(max(cast(floor(value * 1000) AS BIGINT)) AS BIGINT) AS longest FROM {events} GROUP BY event_type")
shared("overview_scale", "SELECT p_partkey, 512 AS tile, p_size % 6 AS levels, cast(floor(512 / pow(2, p_size % 6)) AS BIGINT) AS side, cast(floor(512 / floor(512 / pow(2, p_size % 6))) AS BIGINT) AS scale FROM {part}")
shared("next_power", "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 ELSE cast(pow(2, ceil(log2(p_size))) AS BIGINT) END AS power FROM {part}")
shared("fragment_keys", "SELECT doc_id, part, doc_id * 65536 + part AS fragment_key FROM (SELECT doc_id, cast(floor(n_chars / 1000) AS BIGINT) % 65536 AS part FROM {documents}) d")
shared("unit_range", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, cast(value / (user_id % 7) / 100 AS DOUBLE))) END AS fraction, greatest(0, least(63, user_id - 20)) AS clamped FROM {events}")


@own("SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END AS fraction FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN NULL ELSE value END AS v FROM events) e")
def finite_or_zero(spark, sf_dir):
    """Values that aren't finite count as 0."""
    odd = F.expr("CASE event_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') WHEN 3 THEN NULL ELSE value END")
    return table(spark, sf_dir, "events").select("event_id", schedule.finite(odd).alias("fraction"))


# Pyramids of the overview: each 2 by 2 block, rows before columns

PYRAMID = "l0 AS (" + RASTER + ")" + "".join(
    f""", r{k} AS (SELECT vec_id, x // 2 AS x, y, min(CASE WHEN x % 2 = 0 THEN v END) AS a, min(CASE WHEN x % 2 = 1 THEN v END) AS b FROM l{k} GROUP BY ALL),
h{k} AS (SELECT vec_id, x, y, a + ((b - a) >> 1) AS v FROM r{k}), c{k} AS (SELECT vec_id, x, y // 2 AS y, min(CASE WHEN y % 2 = 0 THEN v END) AS a, min(CASE WHEN y % 2 = 1 THEN v END) AS b FROM h{k} GROUP BY vec_id, x, y // 2),
l{k + 1} AS (SELECT vec_id, x, y, a + ((b - a) >> 1) AS v FROM c{k})"""
    for k in range(3)
)


@own("WITH " + PYRAMID + " SELECT vec_id, cast(lv AS INTEGER) AS level, cast(x AS INTEGER) AS x, cast(y AS INTEGER) AS y, v FROM (SELECT 1 AS lv, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3) q")
def overview_pyramid(spark, sf_dir):
    """Every level of a raster's pyramid, made within the row: each level halves the one before."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, e -> cast(floor(cast(e AS DOUBLE) * 128) AS INT))").alias("l0"))
    return schedule.pyramid(e, "vec_id", "l0", 8, 3)


@own("WITH " + PYRAMID + """, f AS (SELECT vec_id, x, y, v FROM l0 WHERE vec_id % 2 = 0), n AS (SELECT vec_id, 3 AS finest, x, y, v FROM f UNION ALL SELECT vec_id, 2, x * 2 + i, y * 2 + j, v FROM l1, range(0, 2) a(i), range(0, 2) b(j)
UNION ALL SELECT vec_id, 0, x * 8 + i, y * 8 + j, v FROM l3, range(0, 8) a(i), range(0, 8) b(j)) SELECT vec_id, cast(x AS INTEGER) AS x, cast(y AS INTEGER) AS y, arg_max(v, finest) AS v FROM n GROUP BY vec_id, x, y""")
def compositing(spark, sf_dir):
    """What a viewer draws: the finest level that has a sample covers the coarser ones."""
    levels = overview_pyramid(spark, sf_dir).where("level IN (1, 3)")
    scale = F.expr("CAST(shiftleft(1, level) AS INT)")
    cells = levels.withColumn("i", F.explode(F.sequence(F.lit(0), scale - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), scale - 1)))
    drawn = cells.select("vec_id", (3 - F.col("level")).alias("finest"), (F.col("x") * scale + F.col("i")).alias("x"), (F.col("y") * scale + F.col("j")).alias("y"), "v")
    full = raster(spark, sf_dir).where("vec_id % 2 = 0").select("vec_id", F.lit(3).alias("finest"), "x", "y", "v")
    return drawn.unionByName(full).groupBy("vec_id", "x", "y").agg(F.max_by("v", "finest").alias("v"))


@own("SELECT vec_id, 'P5 8 8 255' AS header, string_agg(printf('%02X', greatest(0, least(255, v + 128))), '' ORDER BY y, x) AS samples FROM (" + RASTER + ") r GROUP BY vec_id")
def pnm_dump(spark, sf_dir):
    """Rasters as portable gray maps: header and samples in hex, row by row."""
    byte = "lpad(hex(greatest(0, least(255, cast(floor(cast(e AS DOUBLE) * 128) AS INT) + 128))), 2, '0')"
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit("P5 8 8 255").alias("header"), F.expr(f"array_join(transform(embedding, e -> {byte}), '')").alias("samples"))


@own("SELECT i % 64 AS x, i // 64 AS y, cast(i % 64 * 255 // 63 AS INTEGER) AS red, cast(i // 64 * 255 // 63 AS INTEGER) AS green, cast(floor(127.5 + 127.5 * sin(i % 64 / 8.0) * cos(i // 64 / 8.0) + 0.000001) AS INTEGER) AS blue FROM range(0, 4096) r(i)")
def sample_image(spark, sf_dir):
    """A synthetic image: gradients and a wave."""
    return schedule.sample_image(spark, 64, 64)


# Policies of the scheduler

VIEW_SQL = "SELECT o_orderkey AS view_id, o_custkey AS session_id, o_orderkey % 48 AS x0, o_custkey % 48 AS y0, 1 + o_orderkey % 9 AS w, 1 + o_custkey % 7 AS h, o_orderkey % 6 AS level, 1 + o_orderkey % 8 AS max_layers, (o_custkey % 100) / 100.0::DOUBLE AS load FROM orders WHERE o_orderkey % 40 = 1"
CANDIDATES = f"""SELECT v.view_id, v.session_id, p.*, p.tx BETWEEN x0 AND x0 + w - 1 AND p.ty BETWEEN y0 AND y0 + h - 1 AS visible, v.load FROM ({VIEW_SQL}) v JOIN ({SQL_PACKETS}) p
ON p.tx BETWEEN greatest(0, x0 - 1) AND least(63, x0 + w) AND p.ty BETWEEN greatest(0, y0 - 1) AND least(63, y0 + h) AND p.level <= v.level AND p.layer < v.max_layers"""
SHED = f"SELECT * FROM ({CANDIDATES}) c WHERE CASE WHEN load >= 0.85 THEN visible AND layer = 0 WHEN load >= 0.70 THEN visible ELSE visible OR (level = 0 AND layer = 0) END"
PRICE = "256.0 * pow(2.0, 2 * (7 - layer)) / len"


def views(spark, sf_dir):
    """Viewports: one for each fortieth order key, with a level, a number of layers and a load."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 1")
    return o.selectExpr("o_orderkey AS view_id", "o_custkey AS session_id", "o_orderkey % 48 AS x0", "o_custkey % 48 AS y0", "1 + o_orderkey % 9 AS w", "1 + o_custkey % 7 AS h", "o_orderkey % 6 AS level", "1 + o_orderkey % 8 AS max_layers", "cast((o_custkey % 100) / 100.0 AS DOUBLE) AS load")


def _candidates(spark, sf_dir, most=None, by=()):
    """most, by: only the packets that can be among the first `most` of a view, in an order that goes by `by` within a tile, level and layer."""
    packets = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem"))
    return schedule.candidates(views(spark, sf_dir), schedule.leading(packets, most, list(by)) if most else packets, 64, 64)


@own(f"SELECT view_id, okey, line, level, layer, visible FROM ({CANDIDATES}) c")
def scheduler_candidates(spark, sf_dir):
    """Packets of each view's tiles and the ring around it, up to its level and number of layers, clamped to the grid."""
    return _candidates(spark, sf_dir).select("view_id", "okey", "line", "level", "layer", "visible")


@own(f"SELECT view_id, okey, line, visible FROM ({SHED}) c")
def shed(spark, sf_dir):
    """Load shedding: from 0.70 on no prefetch, from 0.85 on the first layer of visible tiles only; prefetch is level 0, layer 0."""
    return schedule.shed(_candidates(spark, sf_dir)).select("view_id", "okey", "line", "visible")


@own(f"SELECT view_id, okey, line, level FROM (SELECT c.*, max(level) OVER (PARTITION BY view_id) AS top FROM ({CANDIDATES}) c) d WHERE load < 0.85 OR level = 0 OR level = top")
def shed_zip(spark, sf_dir):
    """Shedding of pyramids: from 0.85 on only the coarsest and the finest level asked for."""
    return schedule.shed_levels(views(spark, sf_dir), spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem")), 64, 64).select("view_id", "okey", "line", "level")


def _mode(mode: int, order: str) -> None:
    def run(spark, sf_dir):
        return schedule.ordered(schedule.shed(_candidates(spark, sf_dir, 32, [schedule.utility().desc()] if mode else [])), mode, 32).select("view_id", "okey", "line", "rank")

    run.__name__ = f"sched_mode{mode}"
    own(f"SELECT view_id, okey, line, rank FROM (SELECT view_id, okey, line, row_number() OVER (PARTITION BY view_id ORDER BY {order}, okey, line) AS rank FROM ({SHED}) c) q WHERE rank <= 32")(run)


_mode(0, "level, layer, tx, ty")
_mode(1, f"NOT visible, level, layer, {PRICE} DESC")
_mode(2, f"NOT visible, {PRICE} DESC")


@own(f"SELECT session_id, okey, line, rank FROM (SELECT session_id, okey, line, row_number() OVER (PARTITION BY session_id ORDER BY NOT visible, level, layer, {PRICE} DESC, okey, line, view_id) AS rank FROM ({SHED}) c) q WHERE rank <= 16")
def per_session_topk(spark, sf_dir):
    """Each session's first packets, over all its views."""
    c = schedule.shed(_candidates(spark, sf_dir, 16, [schedule.utility().desc()])).withColumn("price", F.expr(PRICE))
    by = W.partitionBy("session_id").orderBy(~F.col("visible"), "level", "layer", F.desc("price"), "okey", "line", "view_id")
    return c.withColumn("rank", F.row_number().over(by)).where("rank <= 16").select("session_id", "okey", "line", "rank")


@own(f"""SELECT view_id, okey, line, row_number() OVER (PARTITION BY view_id ORDER BY round, price DESC, okey, line) AS turn FROM (SELECT view_id, okey, line, {PRICE} AS price, dense_rank() OVER (PARTITION BY view_id, tx, ty, level ORDER BY layer) AS round FROM ({SHED}) c) q""")
def round_refinement(spark, sf_dir):
    """Refinement by rounds: a tile's next layer is a candidate once the one before went; within a round the dearest goes first."""
    return schedule.rounds(views(spark, sf_dir), spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem")), 64, 64).select("view_id", "okey", "line", "turn")


shared("view_windows", """SELECT view_id, x0, w, CASE WHEN w * h > 256 THEN greatest(0, cast(floor(x0 + w / 2) AS BIGINT) - 8) ELSE x0 END AS main_x, CASE WHEN w * h > 256 THEN greatest(x0, cast(floor(x0 + w / 2) AS BIGINT) - 8) ELSE x0 END AS round_x,
CASE WHEN w * h > 256 THEN least(greatest(0, cast(floor(x0 + w / 2) AS BIGINT) - 8), 64 - 16) ELSE x0 END AS zip_x FROM (SELECT o_orderkey AS view_id, o_orderkey % 48 AS x0, o_custkey % 48 AS y0, 1 + o_orderkey % 40 AS w, 1 + o_custkey % 40 AS h FROM {orders}) v""")
shared("ordered_concat", """SELECT p_partkey, row_number() OVER (ORDER BY seen, p_size, p_partkey) - 1 AS place FROM (SELECT p_partkey, p_size, 0 AS seen FROM {part} WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_size, 1 FROM {part} WHERE p_partkey % 7 = 0) u""")
shared("evict_by_utility", """WITH c AS (SELECT p_brand, p_partkey, p_size * 1024 AS bytes, p_partkey % 7 = 0 AS visible, p_retailprice / (p_size * 1024) AS worth FROM {part}),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY p_brand ORDER BY visible, worth, p_partkey) AS cum, sum(bytes) OVER (PARTITION BY p_brand) AS total FROM c) SELECT p_partkey, cast(bytes AS BIGINT) AS bytes FROM s WHERE total - (cum - bytes) > 1048576""")
shared("lru_clock", "SELECT user_id, event_type, max(event_id) AS last_use, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id), event_type) AS age FROM {events} GROUP BY user_id, event_type")
shared("bucket_cursor", f"SELECT okey, line, tx, ty, row_number() OVER (PARTITION BY tx, ty ORDER BY okey, line) - 1 AS cursor_at FROM ({PACKETS}) p")
shared("order_check", f"""SELECT phase, count(*) AS packets, cast(sum(CASE WHEN before IS NOT NULL AND utility > before THEN 1 ELSE 0 END) AS BIGINT) AS rising FROM (SELECT phase, utility, lag(utility) OVER (PARTITION BY phase, level, layer ORDER BY utility DESC, okey, line) AS before
FROM (SELECT okey, line, level, layer, 256.0 * pow(2.0, 2 * (7 - layer)) / len AS utility, CASE WHEN tx < 32 THEN 0 ELSE 1 END AS phase FROM ({PACKETS}) p) q) o GROUP BY phase""")
shared("packet_validity", f"SELECT okey, line, (tx BETWEEN 0 AND 63 AND ty BETWEEN 0 AND 63 AND level BETWEEN 0 AND 5 AND layer BETWEEN 0 AND 6 AND len <= 4000) AS valid FROM ({PACKETS}) p")
shared("generation_guard", """SELECT e.event_id, e.user_id FROM {events} e JOIN (SELECT user_id, max(event_id % 3) AS generation FROM {events} GROUP BY user_id) g ON e.user_id = g.user_id AND e.event_id % 3 = g.generation""")
shared("request_gate", """SELECT view_id, session_id FROM (SELECT *, lag(tile_key) OVER (PARTITION BY session_id ORDER BY view_id) AS before FROM (SELECT o_orderkey AS view_id, o_custkey AS session_id, w * h AS tiles, x0 * 64 + w AS tile_key
FROM (SELECT o_orderkey, o_custkey, cast(floor((o_orderkey % 48) / 16) AS BIGINT) AS x0, 1 + o_orderkey % 20 AS w, 1 + o_custkey % 9 AS h FROM {orders}) a) b) c WHERE tiles <= 120 AND (before IS NULL OR before <> tile_key)""")
shared("visible_tiles", """SELECT view_id, cast(floor(vx / 512.0) AS BIGINT) AS ax, least(63, cast(floor((vx + vw) / 512.0) AS BIGINT)) AS bx, cast(floor(vy / 512.0) AS BIGINT) AS ay, least(63, cast(floor((vy + vh) / 512.0) AS BIGINT)) AS bz
FROM (SELECT o_orderkey AS view_id, o_orderkey % 30000 AS vx, o_custkey % 30000 AS vy, 800 + o_orderkey % 4000 AS vw, 600 + o_custkey % 3000 AS vh FROM {orders}) v""")
shared("event_pairs", """SELECT a.event_id, b.event_id - a.event_id AS steps FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND b.event_id % 1000 = (a.event_id + 1) % 1000 AND b.event_id = a.event_id + 1""")
shared("first_draws", """SELECT event_id, drawn_at FROM (SELECT user_id, event_id, event_type, min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS drawn_at FROM {events}) e WHERE event_type = 'click' AND drawn_at IS NOT NULL""")
shared("sack_ranges", """SELECT a.user_id, b.event_id FROM (SELECT user_id, min(event_id) AS first_seq, max(event_id) AS last_seq FROM {events} WHERE event_id % 7 = 3 GROUP BY user_id) a JOIN {events} b ON a.user_id = b.user_id AND b.event_id > a.first_seq AND b.event_id < a.last_seq AND b.event_id % 7 <> 3""")
shared("layer_unnest", "SELECT p_partkey, comp, layer FROM (SELECT p_partkey, comp, explode_layers FROM (SELECT p_partkey, p_size % 4 AS explode_layers FROM {part}) a CROSS JOIN (VALUES (0), (1), (2)) c(comp)) b CROSS JOIN (VALUES (0), (1), (2)) l(layer) WHERE layer < explode_layers")
shared("rebuild_packets", f"SELECT tx, ty, level, layer, max(len) AS len FROM ({PACKETS}) p WHERE tx * 64 + ty IN (SELECT c_custkey FROM {{customer}}) GROUP BY tx, ty, level, layer")

# Receivers, senders and timers over recorded events


@own("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events), a AS (SELECT user_id, seq, event_id + CASE WHEN event_id % 7 = 3 THEN 40000 ELSE 0 END AS arrived FROM e),
m AS (SELECT *, max(arrived) OVER (PARTITION BY user_id ORDER BY seq) AS full_at FROM a) SELECT x.user_id, x.arrived, x.seq, (SELECT count(*) FROM m y WHERE y.user_id = x.user_id AND y.full_at <= x.arrived) AS ack FROM m x""")
def running_acks(spark, sf_dir):
    """The cumulative acknowledgement after each arrival: a segment counts once it and all before it have arrived."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    a = table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), (F.col("event_id") + F.when(F.col("event_id") % 7 == 3, 40000).otherwise(0)).alias("arrived"))
    return schedule.running_acks(a, "user_id", "seq", "arrived")


@own("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, cast(floor(value * 20) AS BIGINT) AS len FROM events),
f AS (SELECT user_id, event_id, i, cast(0 AS BIGINT) AS b, cast(1 AS BIGINT) AS n, len + 2 AS sz FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, b + CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN 1 ELSE 0 END,
CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN 1 ELSE n + 1 END, CASE WHEN n >= 16 OR sz + len + 2 > 32768 THEN len + 2 ELSE sz + len + 2 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, b AS batch, n AS place FROM f""")
def batches_packed(spark, sf_dir):
    """Each item's batch and place in it, streamed in order: no session is held."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 20).cast("long").alias("len"))
    return schedule.packed(e, "user_id", "event_id", "len")


shared("debounce", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM {events}) e WHERE following IS NULL OR following > ts + INTERVAL 6 HOUR")
shared("dirty_tiles", f"""SELECT tx, ty, frame FROM (SELECT tx, ty, cast(floor((row_number() OVER (ORDER BY tx, ty) - 1) / 6) AS BIGINT) AS frame FROM (SELECT DISTINCT tx, ty FROM ({PACKETS}) p WHERE okey % 11 = 0 AND tx BETWEEN 8 AND 23 AND ty BETWEEN 8 AND 23) d) f""")
shared("stream_ended", """SELECT user_id, count(*) AS segments, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS fin, coalesce(max(event_id) = max(CASE WHEN event_type = 'purchase' THEN event_id END), false) AS ended FROM {events} GROUP BY user_id""")
shared("mode_switches", """SELECT user_id, event_id, mode FROM (SELECT user_id, event_id, event_id % 3 AS mode, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events} WHERE event_type = 'view') e WHERE before IS NULL OR before <> mode""")
shared("load_crossings", """SELECT user_id, event_id, band FROM (SELECT user_id, event_id, band, lag(band) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, CASE WHEN value >= 85 THEN 2 WHEN value >= 70 THEN 1 ELSE 0 END AS band FROM {events}) a) b WHERE before IS NULL OR before <> band""")
shared("requeued", """SELECT e.user_id, e.event_id FROM {events} e JOIN (SELECT user_id, max(event_id) AS changed FROM {events} WHERE event_type = 'view' GROUP BY user_id) v ON e.user_id = v.user_id AND e.event_id < v.changed WHERE e.event_type = 'click' AND e.event_id % 2 = 0""")
shared("message_fragments", """SELECT user_id, message, count(*) AS frames, min(event_id) AS first_frame, cast(sum(cast(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM (SELECT user_id, event_id, value, event_type, cast(coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS message FROM {events}) e
GROUP BY user_id, message HAVING max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) = 1""")


@own("SELECT page_id, lower(split_part(url, ':', 1)) AS name, trim(substr(url, position(':' IN url) + 1)) AS value FROM pages WHERE position(':' IN url) > 0")
def header_lines(spark, sf_dir):
    """Header lines: lower-cased name before the first colon, trimmed value behind it."""
    p = table(spark, sf_dir, "pages").select("page_id", schedule.header_field(F.col("url")).alias("h"))
    return p.where("h IS NOT NULL").select("page_id", "h.name", "h.value")
