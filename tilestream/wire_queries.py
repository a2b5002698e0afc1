"""Named queries of wire formats, requests, telemetry, senders and images; they join tilestream.queries.QUERIES."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilestream.functions import wire
from tilestream.queries import PACKETS, own, shared, table
from tilestream.sources import tiled
from tilestream.streaming import sender

SQL_PACKETS = PACKETS.replace("{lineitem}", "lineitem")

shared("contiguous_prefix", f"""WITH r AS (SELECT DISTINCT tx, ty, level, layer FROM ({PACKETS}) p WHERE (okey + line) % 5 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, level ORDER BY layer) - 1 AS rn FROM r) SELECT tx, ty, level, cast(sum(CASE WHEN layer = rn THEN 1 ELSE 0 END) AS BIGINT) AS prefix FROM n GROUP BY tx, ty, level""")
shared("client_utility", f"SELECT okey, line, len * pow(cast(2 AS DOUBLE), least(80, 2 * (7 - layer))) / greatest(1, len) AS utility, pow(cast(2 AS DOUBLE), least(30, 2 * level)) AS zip_utility FROM ({PACKETS}) p")
shared("zoom_level", "SELECT event_id, greatest(0, least(5, cast(floor(5 + log2((value + 1) / 1000) + 0.5) AS BIGINT) + 1)) AS level, greatest(0, least(5, cast(floor(5 + log2((value + 1) / 1000) + 0.5) AS BIGINT))) AS zip_level FROM {events}")
shared("screen_to_image", "SELECT event_id, cast(floor((user_id - 20.5) / (1 + value) * 1000000 + 0.5) AS BIGINT) AS ix_micro, cast(floor(least(800 / (1 + value), 600 / (2 + value)) * 1000000 + 0.5) AS BIGINT) AS fit_micro FROM {events}")
shared("rect_intersections", """WITH v AS (SELECT o_orderkey AS view_id, o_custkey AS session_id, o_orderkey % 48 AS x0, o_custkey % 48 AS y0, 1 + o_orderkey % 9 AS w, 1 + o_custkey % 7 AS h FROM {orders})
SELECT a.view_id, b.view_id AS other_id, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS shared_w FROM v a JOIN v b ON a.session_id = b.session_id AND a.view_id < b.view_id AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h""")
shared("ack_sanity", """WITH a AS (SELECT event_id, event_id % 50 AS ack, user_id % 40 AS una, user_id % 40 + 20 AS nxt, 3 - event_id % 11 AS rwnd, event_id % 50 + event_id % 4 - 1 AS s0, event_id % 50 + event_id % 7 AS s1 FROM {events})
SELECT event_id, (ack BETWEEN una AND nxt) AND rwnd >= 0 AND s0 >= ack AND s1 > s0 AND s1 <= nxt AS valid FROM a""")
shared("send_window", """SELECT event_id, greatest(1, least(cast(floor(value) AS BIGINT), 4 + user_id % 16)) AS win, event_id % 32 - event_id % 5 AS in_flight, greatest(0, greatest(1, least(cast(floor(value) AS BIGINT), 4 + user_id % 16)) - (event_id % 32 - event_id % 5)) AS may_send FROM {events}""")
shared("receive_window", "SELECT event_id, cast(floor(4 + greatest(0, 1 - value / 500) * (1 - least(1, user_id / 64.0)) * 60 + 0.5) AS BIGINT) AS rwnd FROM {events}")
shared("layer_order_check", f"""WITH o AS (SELECT tx, ty, level, layer, lag(layer) OVER (PARTITION BY tx, ty, level ORDER BY okey, line, layer) AS last FROM ({PACKETS}) p)
SELECT level, count(*) AS packets, cast(sum(CASE WHEN last IS NOT NULL AND layer < last THEN 1 ELSE 0 END) AS BIGINT) AS backward FROM o GROUP BY level""")
shared("zip_tiles_needed", """WITH f AS (SELECT p_partkey AS id, part FROM (SELECT p_partkey, p_size FROM {part}) t CROSS JOIN (VALUES (0), (1), (2), (3)) v(part) WHERE part * 16 < p_size)
SELECT id, count(*) AS unsent FROM f WHERE NOT (id % 3 = 0 OR (id + part) % 2 = 0) GROUP BY id""")
shared("mime_types", """SELECT page_id, CASE regexp_extract(lower(split_part(url, '?', 1)), '[.]([a-z0-9]+)$', 1) WHEN 'html' THEN 'text/html; charset=utf-8' WHEN 'js' THEN 'text/javascript; charset=utf-8' WHEN 'css' THEN 'text/css; charset=utf-8'
WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS mime FROM {pages}""")
shared("query_string", """SELECT page_id, CASE WHEN position('?' IN url) > 0 THEN split_part(url, '?', 2) END AS query, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM {pages}""")


WAITED = "SELECT event_id, user_id % 3 AS level, event_id % 4 AS layer, event_type <> 'purchase' AS visible, {ms} - lag({ms}) OVER (PARTITION BY user_id ORDER BY event_id) AS waited FROM {events}"
MISSED = "SELECT level, count(*) AS sent, cast(sum(CASE WHEN visible AND layer = 0 AND waited > CASE WHEN level = 0 THEN 250 ELSE 1000 END THEN 1 ELSE 0 END) AS BIGINT) AS missed FROM ({waited}) w GROUP BY level"


@own(MISSED.format(waited=WAITED.format(ms="epoch_ms(ts)", events="events")))
def deadline_misses(spark, sf_dir):
    """First layers of visible tiles that come too late behind the event before: over 250 ms at level 0, over 1000 ms elsewhere."""
    return spark.sql(MISSED.format(waited=WAITED.format(ms="unix_millis(cast(ts AS TIMESTAMP))", events="{events}")), events=table(spark, sf_dir, "events"))


@own(f"SELECT okey, line, tx * 64 + ty AS tile, cast(0 AS BIGINT) AS comp, cast(level AS BIGINT) AS level, tx % 8 AS py, ty % 8 AS px, layer, ((tx * 64 + ty) << 37) + (cast(level AS BIGINT) << 30) + ((tx % 8) << 19) + ((ty % 8) << 8) + layer AS packet_id FROM ({SQL_PACKETS}) p")
def packet_ids(spark, sf_dir):
    """Ids packed into one long, and the fields unpacked from it."""
    p = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem"))
    p = p.withColumn("packet_id", wire.packet_id(tile=F.col("tx") * 64 + F.col("ty"), comp=F.lit(0), level=F.col("level"), py=F.col("tx") % 8, px=F.col("ty") % 8, layer=F.col("layer")))
    return p.select("okey", "line", wire.packet_fields(F.col("packet_id")).alias("f"), "packet_id").select("okey", "line", "f.*", "packet_id")


@own("SELECT event_id, printf('02%08X%016X%02X%04X', event_id, (epoch_us(ts) // 1000), event_id % 4, octet_length(encode(event_type))) || hex(event_type) AS frame, event_id AS seq, (epoch_us(ts) // 1000) AS send_ts, event_id % 4 AS flags, event_type AS payload FROM events")
def data_frames(spark, sf_dir):
    """DATA frames written and read."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    e = e.select("event_id", wire.data_frame(F.col("event_id"), F.col("ms"), F.col("event_id") % 4, F.encode("event_type", "UTF-8")).alias("b"))
    d = e.withColumn("d", wire.parsed(wire.DATA, F.col("b")))
    return d.select("event_id", F.hex("b").alias("frame"), "d.seq", "d.send_ts", "d.flags", F.decode("d.payload", "UTF-8").alias("payload"))


@own("SELECT event_id, event_id AS ack, user_id AS rwnd, event_id * 7 AS echo_ts, event_id % 3 AS n, CASE WHEN event_id % 3 > 0 THEN event_id + event_id % 3 + 1 ELSE -1 END AS last_end FROM events")
def ack_frames(spark, sf_dir):
    """ACK frames with up to two blocks written and read."""
    n = (F.col("event_id") % 3).cast("int")
    blocks = F.slice(F.array(*(F.struct((F.col("event_id") + i).alias("start"), (F.col("event_id") + i + 1).alias("end")) for i in (1, 2))), F.lit(1), n)
    e = table(spark, sf_dir, "events").select("event_id", wire.ack_frame(F.col("event_id"), F.col("user_id"), F.col("event_id") * 7, blocks).alias("b"))
    a = e.select("event_id", wire.ack_fields(F.col("b")).alias("a"))
    return a.select("event_id", "a.ack", "a.rwnd", "a.echo_ts", F.size("a.blocks").cast("long").alias("n"), F.coalesce(F.get("a.blocks", F.size("a.blocks") - 1)["end"], F.lit(-1)).alias("last_end"))


@own(f"SELECT okey, line, tx * 64 + ty AS tile, cast(level AS BIGINT) AS level, layer, len FROM ({SQL_PACKETS}) p")
def image_packets(spark, sf_dir):
    """Image packets with 18 bytes of header written and read."""
    p = spark.sql(PACKETS, lineitem=table(spark, sf_dir, "lineitem"))
    b = wire.image_packet(F.unhex(F.lit("00FF")), tile=F.col("tx") * 64 + F.col("ty"), comp=F.lit(1), level=F.col("level"), py=F.col("tx"), px=F.col("ty"), layer=F.col("layer"), num_planes=F.lit(8), num_coeffs=F.col("len"))
    return p.select("okey", "line", wire.parsed(wire.PACKET, b).alias("d")).select("okey", "line", "d.tile", "d.level", "d.layer", F.col("d.num_coeffs").alias("len"))


@own("SELECT doc_id, cast(ceil(length(text) / 1000.0) AS BIGINT) AS parts, md5(text) AS digest FROM documents WHERE length(text) > 0")
def fragment_reassembly(spark, sf_dir):
    """Documents in parts, put together again where all parts agree on their number and all are there."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.ceil(F.length("text") / 1000.0).alias("parts"))
    f = d.select("doc_id", "parts", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("doc_id", "parts", "part", F.substring("text", (F.col("part") * 1000 + 1).cast("int"), F.lit(1000)).alias("data"))
    g = f.groupBy("doc_id").agg(F.min("parts").alias("parts"), F.max("parts").alias("most"), F.array_sort(F.collect_list(F.struct("part", "data"))).alias("all"))
    return g.where((F.col("parts") == F.col("most")) & (F.size("all") == F.col("parts"))).select("doc_id", "parts", F.md5(F.array_join(F.transform("all", lambda z: z["data"]), "")).alias("digest"))


@own()
def sender_replay(spark, sf_dir):
    """A sender for each user: every event sends, acknowledges or ticks. The state isn't SQL; tests hold it against cases by hand."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type")
    seq = "cast(count_if(event_type IN ('view', 'click')) OVER (PARTITION BY session ORDER BY event_id) AS bigint)"
    kind = "CASE WHEN event_type IN ('view', 'click') THEN 'send' WHEN event_id % 3 = 0 THEN 'tick' ELSE 'ack' END"
    rows = e.selectExpr("session", "event_id", "ms AS at", f"{kind} AS kind", f"{seq} div 2 AS ack", "64L AS rwnd", "0L AS echo", "cast(array() AS array<bigint>) AS blocks")
    return sender.replay(rows, "event_id")


def _strips(spark, sf_dir):
    """Embeddings, 64 to a strip of 64 by 64 samples, as strips of one gray image for each thousand vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 1000).cast("long").alias("image_id"), (F.floor(F.col("vec_id") % 1000 / 64) * 64).cast("int").alias("y0"), "vec_id", "embedding")
    g = e.groupBy("image_id", "y0").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))

    def run(batches):
        for pdf in batches:
            out = []
            for s in pdf.itertuples(index=False):
                px = (np.floor(np.stack([np.asarray(r["embedding"], float) for r in s.rows]) * 128) + 128).clip(0, 255).astype(np.uint8)
                out.append((s.image_id, s.y0, px.shape[0], px.shape[1], 1000, 1, px.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in tiled.STRIPS.split(", ")])

    return g.mapInPandas(run, tiled.STRIPS)


@own("SELECT count(*) * 64 AS samples, cast(0 AS BIGINT) AS wrong FROM embeddings")
def image_round_trip(spark, sf_dir):
    """Strips to packets and back, all layers."""
    strips = _strips(spark, sf_dir)
    back = tiled.decode(tiled.encode(strips, 64, 3, 16), 64, 3, 16)
    both = strips.join(back.withColumn("y0", F.col("ty") * 64), ["image_id", "y0"], "left")
    return both.agg(F.sum(F.col("rows") * F.col("width")).cast("long").alias("samples"), F.count_if(~F.col("data").eqNullSafe(F.col("pixels"))).alias("wrong"))


@own()
def image_layers(spark, sf_dir):
    """Packets of each level and layer; the bytes depend on the zlib build, so there is no SQL."""
    p = tiled.encode(_strips(spark, sf_dir), 64, 3, 16)
    return p.groupBy("level", "layer").agg(F.count("*").alias("packets"), F.sum(F.length("data")).alias("bytes"))


@own("SELECT o_orderkey AS view_id, o_orderkey AS x, o_custkey AS y, 1 + o_orderkey % 9 AS w, 1 + o_custkey % 7 AS h, o_orderkey % 6 AS level, (o_orderkey % 255 - 127) / 127.0::DOUBLE AS dx, o_custkey % 256 / 255.0::DOUBLE AS confidence FROM orders")
def viewport_messages(spark, sf_dir):
    """VIEWPORT messages with predictions written and read."""
    o = table(spark, sf_dir, "orders")
    b = wire.viewport(F.col("o_orderkey"), F.col("o_custkey"), 1 + F.col("o_orderkey") % 9, 1 + F.col("o_custkey") % 7, F.col("o_orderkey") % 6, F.col("o_orderkey") % 255 - 127, F.lit(0), F.col("o_custkey") % 256)
    return o.select(F.col("o_orderkey").alias("view_id"), wire.viewport_fields(b).alias("v")).select("view_id", "v.x", "v.y", "v.w", "v.h", "v.level", "v.dx", "v.confidence")


@own("SELECT o_orderkey, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey + o_orderkey % 4 ELSE -1 END AS last_tile FROM orders")
def forget_messages(spark, sf_dir):
    """FORGET messages of up to three tiles written and read."""
    tiles = F.slice(F.array(*(F.col("o_orderkey") + i for i in (1, 2, 3))), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", wire.forget_fields(wire.forget(tiles)).alias("t"))
    return o.select("o_orderkey", F.size("t").cast("long").alias("n"), F.coalesce(F.get("t", F.size("t") - 1), F.lit(-1)).alias("last_tile"))


@own("SELECT p_partkey, cast(3 AS BIGINT) AS n, p_brand || '/' || p_name || '/' || p_type AS joined FROM part WHERE p_brand <> '' AND p_name <> '' AND p_type <> ''")
def packet_batches(spark, sf_dir):
    """Three packets in a batch, written, masked, unmasked and read."""
    p = table(spark, sf_dir, "part").select("p_partkey", wire.batch(F.array(*(F.encode(c, "UTF-8") for c in ("p_brand", "p_name", "p_type")))).alias("b"))
    key = F.unhex(F.lit("37FA213D"))
    p = p.where("b IS NOT NULL").select("p_partkey", wire.unmasked(F.col("b"), key).alias("m"))
    p = p.select("p_partkey", wire.batch_packets(wire.unmasked(F.col("m"), key)).alias("g"))
    return p.select("p_partkey", F.size("g").cast("long").alias("n"), F.array_join(F.transform("g", lambda x: F.decode(x, "UTF-8")), "/").alias("joined"))
