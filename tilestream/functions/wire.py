"""Wire formats as column expressions: big-endian fields to binary and back, packet ids, validity of acknowledgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats: message types, and field names with their bytes.
T_HELLO, T_DATA, T_ACK, T_VIEWPORT, T_WIN, T_FORGET, T_FIN = 1, 2, 3, 4, 5, 6, 7
DATA = (("type", 1), ("seq", 4), ("send_ts", 8), ("flags", 1), ("size", 2))
PACKET = (("tile", 4), ("comp", 1), ("level", 1), ("py", 2), ("px", 2), ("layer", 1), ("num_planes", 1), ("num_coeffs", 4), ("size", 2))
ID = (("tile", 24), ("comp", 3), ("level", 4), ("py", 11), ("px", 11), ("layer", 8))


def header(fields: tuple[tuple[str, int], ...], values: dict[str, Column]) -> Column:
    """The fields, big-endian and unsigned, one after the other; each is cut to its width."""
    parts = [F.lpad(F.hex(values[n].cast("long").bitwiseAND(F.lit((1 << (8 * w)) - 1 if w < 8 else -1).cast("long"))), 2 * w, "0") for n, w in fields]
    return F.unhex(F.concat(*parts))


def parsed(fields: tuple[tuple[str, int], ...], frame: Column) -> Column:
    """A struct of the fields and the payload behind them; null where the frame is shorter than its header or than its size field says."""
    out, at = [], 1
    for n, w in fields:
        out.append(F.conv(F.hex(F.substring(frame, at, w)), 16, 10).cast("long").alias(n))
        at += w
    whole = F.length(frame) >= at - 1
    if fields[-1][0] == "size":
        size = F.conv(F.hex(F.substring(frame, at - 2, 2)), 16, 10).cast("long")
        whole = whole & (F.length(frame) - (at - 1) == size)
    return F.when(whole, F.struct(*out, F.substring(frame, at, 1 << 30).alias("payload")))


def data_frame(seq: Column, send_ts: Column, flags: Column, payload: Column) -> Column:
    return F.concat(header(DATA, {"type": F.lit(T_DATA), "seq": seq, "send_ts": send_ts, "flags": flags, "size": F.length(payload)}), payload)


def image_packet(data: Column, **fields: Column) -> Column:
    return F.concat(header(PACKET, {**fields, "size": F.length(data)}), data)


def packet_id(**fields: Column) -> Column:
    """One long of ID's fields, each cut to its bits, the first one highest."""
    out = F.lit(0).cast("long")
    for n, bits in ID:
        out = F.shiftleft(out, bits).bitwiseOR(fields[n].cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def packet_fields(packed: Column) -> Column:
    out, low = [], 0
    for n, bits in reversed(ID):
        out.append(F.shiftright(packed, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias(n))
        low += bits
    return F.struct(*reversed(out))


def ack_frame(ack: Column, rwnd: Column, echo_ts: Column, blocks: Column) -> Column:
    """Type, ack, rwnd, echoed time, number of blocks, then start and end of each; blocks: array of struct (start, end)."""
    head = header((("type", 1), ("ack", 4), ("rwnd", 4), ("echo_ts", 8), ("n", 1)), {"type": F.lit(T_ACK), "ack": ack, "rwnd": rwnd, "echo_ts": echo_ts, "n": F.size(blocks)})
    tail = F.transform(blocks, lambda b: F.concat(F.lpad(F.hex(b["start"].cast("long")), 8, "0"), F.lpad(F.hex(b["end"].cast("long")), 8, "0")))
    return F.concat(head, F.unhex(F.array_join(tail, "")))


def ack_fields(frame: Column) -> Column:
    """ack, rwnd, echo_ts and blocks; null unless the length is exactly that of its blocks."""
    num = lambda at, w: F.conv(F.hex(F.substring(frame, at, w)), 16, 10).cast("long")
    n = F.coalesce(num(18, 1), F.lit(0)).cast("int")
    hexed = F.hex(frame)
    part = lambda i, k: F.conv(F.substring(hexed, 37 + 16 * i + 8 * k, F.lit(8)), 16, 10).cast("long")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(part(i, 0).alias("start"), part(i, 1).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return F.when((F.length(frame) == 18 + 8 * n) & (num(1, 1) == T_ACK), F.struct(num(2, 4).alias("ack"), num(6, 4).alias("rwnd"), num(10, 8).alias("echo_ts"), blocks.alias("blocks")))


VIEWPORT = (("type", 1), ("x", 4), ("y", 4), ("w", 4), ("h", 4), ("level", 1))
PREDICTION = (("dx", 1), ("dy", 1), ("confidence", 1))
MOST_PACKETS, MOST_BATCH, MOST_PLACE = 16, 32768, 2**31 - 1


def number(frame: Column, at: Column | int, width: int) -> Column:
    """The unsigned big-endian integer at a place counted from 1."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(F.hex(frame), 2 * at - 1, F.lit(2 * width)), 16, 10).cast("long")


def hello(mode: Column, version: Column) -> Column:
    """Null for modes other than 0 to 2 and versions other than 1 and 2."""
    return F.when(mode.between(0, 2) & version.between(1, 2), header((("type", 1), ("version", 1), ("mode", 1)), {"type": F.lit(T_HELLO), "version": version, "mode": mode}))


def viewport(x: Column, y: Column, w: Column, h: Column, level: Column, dx: Column | None = None, dy: Column | None = None, confidence: Column | None = None) -> Column:
    """18 bytes, or 21 with a prediction: dx and dy from -127 to 127, confidence from 0 to 255, cut to those."""
    out = header(VIEWPORT, {"type": F.lit(T_VIEWPORT), "x": x, "y": y, "w": w, "h": h, "level": level})
    if dx is None:
        return out
    cut = lambda v, a, b: F.greatest(F.lit(a), F.least(F.lit(b), F.floor(v + 0.5)))
    return F.concat(out, header(PREDICTION, {"dx": cut(dx, -127, 127), "dy": cut(dy, -127, 127), "confidence": cut(confidence, 0, 255)}))


def viewport_fields(frame: Column) -> Column:
    """x, y, w, h, level, dx, dy and confidence in units; null for other lengths, empty areas and places beyond 31 bits."""
    x, y, w, h = (number(frame, at, 4) for at in (2, 6, 10, 14))
    unit = lambda at: F.greatest(F.lit(-1.0), F.when(number(frame, at, 1) > 127, number(frame, at, 1) - 256).otherwise(number(frame, at, 1)) / 127.0)
    long = F.length(frame) == 21
    valid = (long | (F.length(frame) == 18)) & (number(frame, 1, 1) == T_VIEWPORT) & (x <= MOST_PLACE) & (y <= MOST_PLACE) & w.between(1, MOST_PLACE) & h.between(1, MOST_PLACE) & (x + w <= MOST_PLACE) & (y + h <= MOST_PLACE)
    extra = [F.when(long, v).otherwise(F.lit(0.0)).alias(n) for n, v in (("dx", unit(19)), ("dy", unit(20)), ("confidence", number(frame, 21, 1) / 255.0))]
    return F.when(valid, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), number(frame, 18, 1).alias("level"), *extra))


def forget(tiles: Column) -> Column:
    """Type, number of tiles and the tiles."""
    head = header((("type", 1), ("n", 2)), {"type": F.lit(T_FORGET), "n": F.size(tiles)})
    return F.concat(head, F.unhex(F.array_join(F.transform(tiles, lambda t: F.lpad(F.hex(t.cast("long")), 8, "0")), "")))


def forget_fields(frame: Column) -> Column:
    """The tiles; null unless the length is exactly that of their number."""
    n = number(frame, 2, 2)
    tiles = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: number(frame, (4 + 4 * i).cast("int"), 4))).otherwise(F.array().cast("array<bigint>"))
    return F.when((F.length(frame) == 3 + 4 * n) & (number(frame, 1, 1) == T_FORGET), tiles)


def batch(packets: Column) -> Column:
    """Each packet behind its length; null for no packets, too many, an empty one or too many bytes."""
    out = F.unhex(F.array_join(F.transform(packets, lambda p: F.concat(F.lpad(F.hex(F.length(p).cast("long")), 4, "0"), F.hex(p))), ""))
    return F.when(F.size(packets).between(1, MOST_PACKETS) & F.forall(packets, lambda p: F.length(p) > 0) & (F.length(out) <= MOST_BATCH), out)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def batch_packets(payload: Column) -> Column:
    """The packets of a batch; null where its framing is broken. A batch holds at most 16, so 16 steps read any."""
    return bound(F.hex(payload), _packets)


def _packets(digits: Column) -> Column:
    """As batch_packets, of hex digits; the state is the place of the next length, the packets so far and whether the framing holds."""
    length = F.length(digits)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<binary>").alias("got"), F.lit(True).alias("fine"))

    def step(a: Column, _: Column) -> Column:
        size = F.coalesce(F.conv(F.substring(digits, a["at"], F.lit(4)), 16, 10).cast("int"), F.lit(0))
        return bound(size, lambda n: F.when(~a["fine"] | (a["at"] > length), a).otherwise(taken(a, n)))

    def taken(a: Column, n: Column) -> Column:
        whole = (a["at"] + 3 <= length) & (n > 0) & (a["at"] + 3 + 2 * n <= length)
        more = F.when(whole, F.concat(a["got"], F.array(F.unhex(F.substring(digits, a["at"] + 4, 2 * n))))).otherwise(a["got"])
        return F.struct((a["at"] + 4 + 2 * n).alias("at"), more.alias("got"), whole.alias("fine"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PACKETS)), start, step)
    return bound(end, lambda e: F.when((length <= 2 * MOST_BATCH) & e["fine"] & (e["at"] == length + 1) & (F.size(e["got"]) > 0), e["got"]))


def unmasked(data: Column, key: Column) -> Column:
    """Bytes XOR a key of four bytes, again and again; the same again masks them."""
    byte = lambda digits, i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")

    def xor(digits: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int") - 1)
        return bound(F.hex(key), lambda k: F.array_join(F.transform(places, lambda i: F.lpad(F.hex(byte(digits, i).bitwiseXOR(byte(k, i % 4))), 2, "0")), ""))

    return F.when(F.length(data) == 0, data).otherwise(F.unhex(bound(F.hex(data), xor)))
