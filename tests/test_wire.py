"""Senders by hand, streams, images, pyramids."""

import zipfile

import numpy as np
import pandas as pd
import pytest

from tilestream.sources import png, pyramid, tiled
from tilestream.streaming.sender import IN, Sender, congestion, replay


def test_slow_start_then_fast_recovery():
    s = Sender()
    assert s.send(0) and not s.send(0)
    s.ack(100, 1, 64, 0 + 1, [])
    assert (s.cwnd, s.srtt, s.una, s.due) == (2.0, 99.0, 1, None)
    s.cwnd = 8.0
    for _ in range(8):
        assert s.send(200)
    for k in (3, 4, 5):
        s.ack(250, 1, 64, 0, [(2, k)])
    assert s.fast == 1 and s.resent == 1 and s.until == 9
    assert s.ssthresh == 2.5 and s.cwnd == 5.5
    s.ack(300, 9, 64, 0, [])
    assert s.until is None and s.cwnd == 2.5 and not s.held and not s.flying


def test_timeout_backs_off_and_bad_acks_are_ignored():
    s = Sender()
    s.send(0)
    s.tick(999)
    assert s.timeouts == 0
    s.tick(1000)
    assert (s.timeouts, s.rto, s.cwnd, s.ssthresh, s.resent) == (1, 2000, 1.0, 2.0, 1)
    before = (s.una, s.rwnd, dict(s.flying))
    for ack, rwnd, blocks in ((2, 1, []), (0, -1, []), (0, 1, [(1, 1)]), (0, 1, [(0, 5)])):
        s.ack(1100, ack, rwnd, 0, blocks)
    assert before == (s.una, s.rwnd, dict(s.flying))
    s.ack(1100, 1, 9, 5, [])
    assert s.srtt == -1  # a segment sent twice gives no sample


ROWS = [(s, t, k, a, 64, e, []) for s in (1, 2) for t, k, a, e in ((1, "send", 0, 0), (50, "ack", 1, 1), (60, "send", 0, 0), (61, "send", 0, 0), (1500, "tick", 0, 0))]
TYPES = "session long, at long, kind string, ack long, rwnd long, echo long, blocks array<long>"


def test_stream_and_table_agree(spark, tmp_path):
    table = spark.createDataFrame(ROWS, TYPES)
    want = {r.session: r for r in replay(table, "at").collect()}
    assert len(want) == 2 and want[1].timeouts == 1 and want[1].nxt == 3
    for i, part in enumerate((table.where("at < 60"), table.where("at >= 60"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TYPES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = congestion(stream).writeStream.format("memory").queryName("senders").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("senders").orderBy("at").collect()
    assert {r.session: r for r in got} == want
    assert replay(spark.createDataFrame([], TYPES), "at").count() == 0 and IN[0] == "session"


@pytest.mark.parametrize("channels", [1, 3])
def test_images_round_trip_by_strips(spark, tmp_path, channels):
    px = (np.add.outer(np.arange(70), np.arange(90)) % 251).astype(np.uint8)[:, :, None].repeat(channels, 2)
    px[20:30, 40:60] = np.random.default_rng(3).integers(0, 256, (10, 20, channels))
    (tmp_path / "a.png").write_bytes(png.encode(px))
    strips = tiled.png_strips(spark.read.format("binaryFile").load(str(tmp_path)), 32)
    packets = tiled.encode(strips, 32, 3, 8)
    worst = []
    for layers in (0, 2, 5, None):
        out = np.full_like(px, 128)
        for r in tiled.decode(packets, 32, 3, 8, layers).collect():
            out[r.ty * 32 : r.ty * 32 + r.valid_h, r.tx * 32 : r.tx * 32 + r.valid_w, r.comp] = np.frombuffer(r.pixels, np.uint8).reshape(r.valid_h, r.valid_w)
        worst.append(int(((out.astype(int) - px) ** 2).sum()))
    assert worst == sorted(worst, reverse=True) and worst[-1] == 0


def _archive(path, width, height, tile, leave=None, twice=False):
    levels = pyramid.geometry(width, height, tile)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.dzi", f'<Image TileSize="{tile}" Overlap="0" Format="png"><Size Width="{width}" Height="{height}"/></Image>')
        for level, (w, h, across, down, first) in enumerate(levels):
            for ty in range(down):
                for tx in range(across):
                    if first + ty * across + tx != leave:
                        z.writestr(f"a_files/{level}/{tx}_{ty}.png", png.encode(np.full((min(tile, h - ty * tile), min(tile, w - tx * tile), 1), level, np.uint8)))


def test_pyramids(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    _archive(path, 100, 70, 32)
    listing = pyramid.directory(spark.createDataFrame(pd.DataFrame({"path": [path]})))
    rows = listing.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows))) and rows[0].level == 0 and rows[-1].width == 4
    assert all((png.decode(bytes(r.png)) == r.level).all() for r in pyramid.tiles(listing.where("level >= 5")).collect())
    _archive(path, 100, 70, 32, leave=7)
    with pytest.raises(ValueError, match="missing"):
        pyramid.listed(path)


def test_broken_messages_are_null(spark):
    from pyspark.sql import functions as F

    from tilestream.functions import wire

    one = spark.range(1)
    read = lambda c: one.select(c.alias("c")).first().c
    hexed = lambda s: F.unhex(F.lit(s))
    assert [bytes(b) for b in read(wire.batch_packets(hexed("0001AA0002BBCC")))] == [b"\xaa", b"\xbb\xcc"]
    for bad in ("", "00", "0001", "0000", "0002AA", "0001AA00", "0001AA" * 17):
        assert read(wire.batch_packets(hexed(bad))) is None, bad
    assert len(read(wire.batch_packets(hexed("0001AA" * 16)))) == 16
    assert read(wire.batch(F.array(hexed("AA"), hexed("")))) is None and read(wire.batch(F.array().cast("array<binary>"))) is None
    assert read(wire.hello(F.lit(3), F.lit(1))) is None and bytes(read(wire.hello(F.lit(2), F.lit(1)))) == b"\x01\x01\x02"
    assert read(wire.viewport_fields(hexed("04" + "00" * 17))) is None
    assert read(wire.forget_fields(hexed("060001"))) is None and read(wire.ack_fields(hexed("03" + "00" * 16 + "01"))) is None
    assert bytes(read(wire.unmasked(hexed("7F9F4D5158"), hexed("37FA213D")))) == b"Hello"
    assert read(wire.parsed(wire.DATA, hexed("02"))) is None
