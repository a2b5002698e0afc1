"""Containers, scheduler policies and receivers as operators over tables of packets, views and arrivals."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Fixed values of the protocol.
SHED_PREFETCH, SHED_DETAIL = 0.70, 0.85
MOST_PACKETS, MOST_BYTES = 16, 32768


def offsets(packets: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """packets with `start`, the sum of all sizes before, by group and order, nulls last. Only a row for each group is brought into one order,
    by ranges of the first group column; packets are summed within their group. Reruns agree only where order leaves no ties."""
    up = lambda cols: [F.col(c).asc_nulls_last() for c in cols]
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    same = lambda cols: functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    sums = packets.groupBy(*group).agg(F.sum(size).alias("__size"))
    firsts = sums.groupBy(F.col(group[0]).alias(f"__{group[0]}")).agg(F.sum("__size").alias("__all"))
    firsts = firsts.select(f"__{group[0]}", F.coalesce(F.sum("__all").over(ahead(W.orderBy(*up([f"__{group[0]}"])))), F.lit(0)).alias("__base"))
    base = F.col("__base") + F.coalesce(F.sum("__size").over(ahead(W.partitionBy(group[0]).orderBy(*up(group[1:])))), F.lit(0))
    sums = sums.join(firsts, same(group[:1])).select(*[F.col(c).alias(f"__{c}") for c in group], base.alias("__base"))
    within = F.coalesce(F.sum(size).over(ahead(W.partitionBy(*group).orderBy(*up(order)))), F.lit(0))
    placed = packets.withColumn("__within", within).join(sums, same(group))
    return placed.withColumn("start", (F.col("__base") + F.col("__within")).cast("long")).drop("__base", "__within", *[f"__{c}" for c in group])


def finite(c: Column) -> Column:
    """c, or 0 where it is null, not a number or infinite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def pyramid(images: DataFrame, key: str, samples: str, side: int, levels: int) -> DataFrame:
    """key, level, x, y, v: each level halves the one before, row by row and then column by column, rounding down each time.

    An image is an array of its samples by rows, so a level is an expression over the array before and nothing is shuffled.
    """
    df, last = images, samples
    for k in range(1, levels + 1):
        half = side >> k
        wide = 2 * half
        rows = f"transform(sequence(0, {wide * half - 1}), i -> {last}[cast(i div {half} * {wide} + i % {half} * 2 AS INT)] + shiftright({last}[cast(i div {half} * {wide} + i % {half} * 2 + 1 AS INT)] - {last}[cast(i div {half} * {wide} + i % {half} * 2 AS INT)], 1))"
        df = df.withColumn("__rows", F.expr(rows))
        cols = f"transform(sequence(0, {half * half - 1}), i -> __rows[cast(i div {half} * 2 * {half} + i % {half} AS INT)] + shiftright(__rows[cast((i div {half} * 2 + 1) * {half} + i % {half} AS INT)] - __rows[cast(i div {half} * 2 * {half} + i % {half} AS INT)], 1))"
        df, last = df.withColumn(f"__l{k}", F.expr(cols)), f"__l{k}"
    each = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(side >> k).alias("side"), F.col(f"__l{k}").alias("samples")) for k in range(1, levels + 1)])
    cells = df.select(key, F.explode(each).alias("l")).select(key, "l.level", "l.side", F.posexplode("l.samples").alias("i", "v"))
    return cells.select(key, "level", (F.col("i") % F.col("side")).alias("x"), F.floor(F.col("i") / F.col("side")).cast("int").alias("y"), "v")


def sample_image(spark: SparkSession, width: int, height: int) -> DataFrame:
    """x, y, red, green, blue: gradients along both axes and a wave."""
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    wave = F.floor(127.5 + 127.5 * F.sin(F.col("x") / 8.0) * F.cos(F.col("y") / 8.0) + 0.000001)
    return cells.select("x", "y", F.floor(F.col("x") * 255 / (width - 1)).cast("int").alias("red"), F.floor(F.col("y") * 255 / (height - 1)).cast("int").alias("green"), wave.cast("int").alias("blue"))


def candidates(views: DataFrame, packets: DataFrame, tiles_x: int, tiles_y: int, also: tuple[str, ...] = ()) -> DataFrame:
    """The packets of each view's tiles and of the ring around it, clamped to the grid, up to the view's level and number of layers.

    A view names its cells, so tiles join by equality. views: view_id, session_id, x0, y0, w, h, level, max_layers, load,
    and the columns of also, which the result has too.
    """
    cells = views.withColumn("__tx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x0") - 1), F.least(F.lit(tiles_x - 1), F.col("x0") + F.col("w")))))
    cells = cells.withColumn("__ty", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y0") - 1), F.least(F.lit(tiles_y - 1), F.col("y0") + F.col("h")))))
    seen = F.col("__tx").between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.col("__ty").between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    cells = cells.select("view_id", "session_id", "load", *also, "__tx", "__ty", F.col("level").alias("__level"), "max_layers", seen.alias("visible"))
    met = packets.join(cells, (F.col("tx") == F.col("__tx")) & (F.col("ty") == F.col("__ty")) & (F.col("level") <= F.col("__level")) & (F.col("layer") < F.col("max_layers")))
    return met.drop("__tx", "__ty", "__level", "max_layers")


def shed(found: DataFrame) -> DataFrame:
    """Candidates that a session's load leaves: no prefetch from 0.70 on, the first layer of visible tiles only from 0.85 on; what isn't
    visible is fetched at level 0, layer 0 only."""
    first = F.col("layer") == 0
    return found.where(F.when(F.col("load") >= SHED_DETAIL, F.col("visible") & first).when(F.col("load") >= SHED_PREFETCH, F.col("visible")).otherwise(F.col("visible") | ((F.col("level") == 0) & first)))


def shed_levels(views: DataFrame, packets: DataFrame, tiles_x: int, tiles_y: int) -> DataFrame:
    """Candidates of pyramids: from 0.85 on the levels between the coarsest and the finest of a view are left out.

    A view's finest level needs only the first layer of each tile and level, so its candidates are never brought together.
    """
    firsts = packets.groupBy("tx", "ty", "level").agg(F.min("layer").alias("layer"))
    tops = candidates(views, firsts, tiles_x, tiles_y).groupBy("view_id").agg(F.max("level").alias("__top"))
    found = candidates(views.join(tops, "view_id"), packets, tiles_x, tiles_y, ("__top",))
    return found.where((F.col("load") < SHED_DETAIL) | (F.col("level") == 0) | (F.col("level") == F.col("__top"))).drop("__top")


def utility() -> Column:
    """Distortion that a packet takes away for each byte."""
    return F.expr("256.0 * pow(2.0, 2 * (7 - layer)) / len")


def order(mode: int) -> list[Column]:
    """Mode 0: level by level. Mode 1: visible first, then level and layer, then utility. Mode 2: visible first, then utility."""
    if mode == 0:
        return [F.col("level"), F.col("layer"), F.col("tx"), F.col("ty")]
    return [~F.col("visible"), *([F.col("level"), F.col("layer")] if mode == 1 else []), utility().desc()]


def leading(packets: DataFrame, most: int, by: list[Column]) -> DataFrame:
    """The first `most` packets of each tile, level and layer: within these, views differ in no key of order() but by, so no other packet can
    be among a view's (or a session's) first `most`. What views meet no longer grows with the packets of a tile."""
    place = F.row_number().over(W.partitionBy("tx", "ty", "level", "layer").orderBy(*by, "okey", "line"))
    return packets.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def ordered(found: DataFrame, mode: int, most: int, by: str = "view_id") -> DataFrame:
    """Each view's first `most` packets in the order of a mode, with their rank."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order(mode), "okey", "line"))).where(F.col("rank") <= most)


def rounds(views: DataFrame, packets: DataFrame, tiles_x: int, tiles_y: int, side: int = 8, most: int = 1 << 20) -> DataFrame:
    """view_id, okey, line, turn: refinement of what shed() leaves of candidates(). The layers of a tile and level take part round by round;
    turn is the place in the whole order of a view: round, utility, okey, line, nulls last.

    Views keep all layers of a tile and level below a bound, or layer 0 alone, so a packet's round hardly depends on the view and packets have
    one order. Views are dealt out by blocks of `side` by `side` corners, packets to each block that may show them (about twice), in that order;
    a task counts on in each view while it reads them, so candidates are never shuffled or sorted. A task holds the views of a block and `most`
    packets. Layer 0 stands a second time, as round 1, where layers below it exist (use 1: with these, 2: alone, 0: both).
    Views are as in candidates(); rows with the same view_id count as one view, and then layers below 0 are not provided for.
    """
    low, high = lambda c: F.greatest(F.lit(0), F.col(c) - 1), lambda n, c, size: F.least(F.lit(n - 1), F.col(c) + F.col(size))
    kind = F.when(F.col("load") >= SHED_DETAIL, 2).when(F.col("load") >= SHED_PREFETCH, 1).otherwise(0)
    ends = [F.col("x0"), F.col("x0") + F.col("w") - 1, F.col("y0"), F.col("y0") + F.col("h") - 1]
    known = functools.reduce(lambda x, y: x & y, [c.isNotNull() for c in ends])
    seen = [F.when(known, c).otherwise(F.lit(1 - k % 2)) for k, c in enumerate(ends)]  # with a null nothing is visible
    area = [low("x0"), high(tiles_x, "x0", "w"), low("y0"), high(tiles_y, "y0", "h"), *seen, F.col("level"), F.col("max_layers"), kind]
    v = views.where("level IS NOT NULL AND max_layers IS NOT NULL").select("view_id", F.array(*[c.cast("long") for c in area]).alias("view"))
    at = F.struct(F.floor(F.col("view")[0] / side).alias("x"), F.floor(F.col("view")[2] / side).alias("y"))
    v = v.withColumn("block", F.min(at).over(W.partitionBy("view_id"))).where("view[0] <= view[1] AND view[2] <= view[3]")

    cells = v.select("block", "view", F.explode(F.expr("sequence(view[0], view[1])")).alias("tx")).select("block", "view", "tx", F.explode(F.expr("sequence(view[2], view[3])")).alias("ty"))
    shown = F.expr("tx BETWEEN view[4] AND view[5] AND ty BETWEEN view[6] AND view[7]")
    wanted = cells.groupBy("tx", "ty", "block").agg(F.max(F.when(shown, F.col("view")[8])).alias("__level"), F.max(F.when(shown, F.col("view")[9])).alias("__layers"))
    p = packets.where("level IS NOT NULL AND layer IS NOT NULL")
    layers = p.select("tx", "ty", "level", "layer").distinct().groupBy("tx", "ty", "level").agg(F.array_sort(F.collect_set("layer")).alias("__all"))
    p = p.join(F.broadcast(layers), ["tx", "ty", "level"]).withColumn("round", F.array_position("__all", F.col("layer")).cast("int")).withColumn("price", utility())
    p = p.join(F.broadcast(wanted), ["tx", "ty"]).where("level <= __level AND layer < __layers OR level = 0 AND layer = 0")
    twice = F.when((F.col("layer") == 0) & (F.col("round") > 1), F.array(F.struct("round", F.lit(1).alias("use")), F.struct(F.lit(1).alias("round"), F.lit(2).alias("use"))))
    p = p.withColumn("__as", F.explode(twice.otherwise(F.array(F.struct("round", F.lit(0).alias("use"))))))
    p = p.select("block", "__as.round", "price", "okey", "line", (F.col("tx") * tiles_y + F.col("ty")).cast("int").alias("tile"), F.col("level").cast("int").alias("level"), F.col("layer").cast("int").alias("layer"), "__as.use")
    rows = p.unionByName(v.select("block", F.lit(0).alias("round"), "view_id", "view"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "round", F.col("view_id").asc_nulls_last(), F.desc("price"), F.col("okey").asc_nulls_last(), F.col("line").asc_nulls_last()).drop("price")
    types = {f.name: f.dataType for f in rows.schema}
    shape = StructType([StructField(c, types[c]) for c in ("view_id", "okey", "line")] + [StructField("turn", IntegerType())])
    return rows.mapInArrow(functools.partial(_turns, tiles=tiles_x * tiles_y, tiles_y=tiles_y, most=most), shape)


def _turns(batches: Iterator[pa.RecordBatch], tiles: int, tiles_y: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of rounds(), sorted by block, a block's views before its packets."""
    block, views, turns, held, n, kinds = None, [], [], [], 0, None

    def slices(first: np.ndarray, xs: range, y0: int, y1: int) -> list[slice]:
        return [slice(first[x * tiles_y + y0], first[x * tiles_y + y1 + 1]) for x in xs] if y0 <= y1 else []

    def index(place: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by tile, and where each tile begins."""
        by = place[np.argsort(tile[place], kind="stable")]
        return by, np.searchsorted(tile[by], np.arange(tiles + 1))

    def flush() -> Iterator[pa.RecordBatch]:
        if not held or not views:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        tile, level, layer, use = (t[c].to_numpy() for c in ("tile", "level", "layer", "use"))
        okey, line = (t[c].combine_chunks() for c in ("okey", "line"))
        okey, line = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (okey, line))
        detail, starts = index(np.flatnonzero(use != 2), tile)
        single, firsts = index(np.flatnonzero((layer == 0) & (use != 1)), tile)
        out, rows = [], 0
        for k, (who, areas) in enumerate(views):
            parts = []
            for ax, bx, ay, by, cx, dx, cy, dy, up, below, kind in areas:
                cx, dx, cy, dy = max(cx, ax), min(dx, bx), max(cy, ay), min(dy, by)
                inside = range(cx, dx + 1) if cy <= dy else range(0)
                if kind == 2:
                    found = [single[s] for s in slices(firsts, inside, cy, dy)] if below > 0 else []
                else:
                    found = [detail[s] for s in slices(starts, inside, cy, dy)]
                if found:
                    i = np.concatenate(found)
                    parts.append(i[(level[i] <= up) & (layer[i] < below)])
                if kind == 0 and up >= 0 and below > 0:
                    ring = [s for x in range(ax, bx + 1) for a, b in ([(ay, cy - 1), (dy + 1, by)] if x in inside else [(ay, by)]) for s in slices(firsts, range(x, x + 1), a, b)]
                    i = np.concatenate([single[:0], *[single[s] for s in ring]])
                    parts.append(i[level[i] == 0])
            i = np.sort(np.concatenate(parts)) if parts else single[:0]
            if len(i):
                out.append((who, i, turns[k]))
                turns[k] += len(i)
                rows += len(i)
            if out and (rows >= 1 << 17 or k == len(views) - 1):
                i = pa.array(np.concatenate([x for _, x, _ in out]))
                ids = pa.concat_arrays([pa.repeat(pa.scalar(w, kinds), len(x)) for w, x, _ in out])
                turn = np.concatenate([np.arange(b + 1, b + 1 + len(x), dtype=np.int32) for _, x, b in out])
                yield pa.RecordBatch.from_arrays([ids, okey.take(i), line.take(i), pa.array(turn)], names=["view_id", "okey", "line", "turn"])
                out, rows = [], 0

    for batch in batches:
        kinds = batch.schema.field("view_id").type
        where = [tuple(b.values()) for b in batch["block"].to_pylist()] if batch["block"].null_count else list(zip(*(batch["block"].field(c).to_numpy() for c in ("x", "y")), strict=True))
        cuts = [0, *[i for i in range(1, len(where)) if where[i] != where[i - 1]], len(where)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if where[a] != block:
                yield from flush()
                block, views, turns, held, n = where[a], [], [], [], 0
            part = batch.slice(a, b - a)
            m = int((part["round"].to_numpy() == 0).sum())
            for who, area in zip(part["view_id"].slice(0, m).to_pylist(), part["view"].slice(0, m).to_pylist(), strict=True):
                if views and views[-1][0] == who:
                    views[-1][1].append(area)
                else:
                    views.append((who, [area]))
                    turns.append(0)
            if m < len(part["round"]):
                held.append(part.slice(m))
                n += b - a - m
            if n >= most:
                yield from flush()
                held, n = [], 0
    yield from flush()


def running_acks(arrivals: DataFrame, session: str, seq: str, at: str) -> DataFrame:
    """session, at, seq, ack: the first missing sequence number after each arrival.

    Segment s is covered once all up to s have arrived, at the running maximum of arrival times in the order of s. The acknowledgement
    after an arrival is the number of segments covered by then; both kinds of moment are merged in one sort of the session.
    """
    full = F.max(at).over(W.partitionBy(session).orderBy(seq))
    covered = arrivals.select(session, full.alias(at), F.lit(None).cast("long").alias(seq), F.lit(1).alias("__n"))
    asked = arrivals.select(session, F.col(at), F.col(seq).cast("long").alias(seq), F.lit(0).alias("__n"))
    upto = W.partitionBy(session).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    return covered.unionByName(asked).withColumn("ack", F.sum("__n").over(upto).cast("long")).where("__n = 0").select(session, at, seq, "ack")


def packed(items: DataFrame, session: str, at: str, size: str) -> DataFrame:
    """session, at, batch, place: greedy batches of up to 16 packets and 32,768 bytes, two bytes a packet included.

    Sessions are sorted within partitions and read as a stream, so a session of any length is never held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, batch, n, held = None, 0, 0, 0
        for pdf in batches:
            out = []
            for s, t, length in pdf.itertuples(index=False):
                if s != who:
                    who, batch, n, held = s, 0, 0, 0
                if n >= MOST_PACKETS or n and held + length + 2 > MOST_BYTES:
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + length + 2
                out.append((s, t, batch, n))
            yield pd.DataFrame(out, columns=[session, at, "batch", "place"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    rows = items.where(F.col(session).isNotNull()).select(session, at, size).repartition(session).sortWithinPartitions(session, at)
    return rows.mapInPandas(run, f"{session} {kinds[session]}, {at} {kinds[at]}, batch long, place long")


def header_field(line: Column) -> Column:
    """name (lower case, before the first colon) and value (trimmed, behind it) of a header line; null without a colon."""
    at = F.locate(":", line)
    return F.when(at > 0, F.struct(F.lower(F.substring_index(line, ":", 1)).alias("name"), F.trim(F.substr(line, at + 1)).alias("value")))
