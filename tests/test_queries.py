"""Each query with SQL gives the same rows in both engines; codecs are reversible; curves are bijective."""

import glob
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tilestream import queries as Q
from tilestream import delivery_queries, wire_queries  # noqa: F401
from tilestream.functions import bitplane, hilbert
from tilestream.operators import schedule
from tilestream.sources import png

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name not in Q.ORACLES:
        assert len(got)
        return
    want = duck.sql(Q.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_entry_works_without_extras():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_hilbert_is_a_path(spark, bits):
    n = 1 << bits
    rows = spark.range(n * n).select(hilbert.d2xy("id", bits).alias("p"), "id").select("id", "p.x", "p.y")
    rows = rows.withColumn("d", hilbert.xy2d("x", "y", bits)).orderBy("id").collect()
    assert all(r.d == r.id for r in rows)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_bitplanes_are_exact_and_monotone():
    v = (np.random.default_rng(7).normal(size=4096) * 40).astype(int)
    n = bitplane.planes(v)
    layers = bitplane.encode(v, n)
    errors = [((bitplane.decode(layers[:k] + [None] * (n - k), len(v), n) - v) ** 2).sum() for k in range(n + 1)]
    assert errors[-1] == 0 and errors == sorted(errors, reverse=True)


@pytest.mark.parametrize("channels", [1, 3])
def test_png_round_trip(channels):
    px = np.random.default_rng(1).integers(0, 256, (17, 23, channels)).astype(np.uint8)
    assert (png.decode(png.encode(px)) == px).all()


def test_bitplane_stream_decodes(spark):
    """Signs and magnitudes come back from the planes of each vector, and no vector has more planes than it needs."""
    streams = {}
    for r in Q.QUERIES["bitplane_stream"](spark, "/root/testdata/sf0.01").collect():
        streams.setdefault(r.vec_id, {})[r.plane] = r.bits
    rows = {}
    for r in Q.raster(spark, "/root/testdata/sf0.01").collect():
        rows.setdefault(r.vec_id, {})[r.y, r.x] = r.v
    for vec, cells in rows.items():
        want = [cells[c] for c in sorted(cells)]
        planes = streams.get(vec, {})
        assert sorted(planes) == list(range(max(map(abs, want)).bit_length()))
        size, sign = [0] * 64, [0] * 64
        for p in sorted(planes, reverse=True):
            bits = iter(planes[p])
            for i in range(64):
                if next(bits) == "1":
                    if not size[i]:
                        sign[i] = -1 if next(bits) == "1" else 1
                    size[i] |= 1 << p
        assert [a * b for a, b in zip(size, sign, strict=True)] == want


def test_edf_order_is_whole(spark):
    """Every packet of the viewport and its ring, in order, as in the SQL."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    got = [tuple(r) for r in Q.QUERIES["edf_order"](spark, sf).select("okey", "line", "level", "layer", "phase").collect()]
    packets = Q.PACKETS.replace("{lineitem}", "lineitem")
    assert len(got) == con.sql(f"select count(*) as n from ({packets}) p where tx between 7 and 24 and ty between 7 and 24").df()["n"][0] > 1000
    assert got == list(con.sql(f"select okey, line, level, layer, phase from ({Q.ORACLES['edf_order']})").df().itertuples(index=False, name=None))


def test_offsets_keep_nulls(spark):
    """Packets without a tile or a key come last, as in the SQL, and none goes."""
    rows = [(1, None, 2, 5), (0, 1, 1, 30), (None, 0, 0, 7), (0, 1, 3, 20), (0, 0, 9, 4), (0, 1, None, 1)]
    got = schedule.offsets(spark.createDataFrame(rows, "tx long, ty long, okey long, len long"), ["tx", "ty"], ["okey"], "len").select("tx", "ty", "okey", "len", "start").collect()
    assert sorted(map(tuple, got), key=lambda r: r[4]) == [(0, 0, 9, 4, 0), (0, 1, 1, 30, 4), (0, 1, 3, 20, 34), (0, 1, None, 1, 54), (1, None, 2, 5, 55), (None, 0, 0, 7, 60)]


def test_tile_index_breaks_ties_by_place(spark, tmp_path):
    """Packets of one key get offsets by file and, in each, from the last row to the first."""
    line = "0L AS l_orderkey, 0L AS l_partkey, 0L AS l_suppkey, 1 AS l_linenumber, 8D AS l_quantity, 1D * x AS l_extendedprice, timestamp '2000-01-01' AS l_shipdate"
    where = str(tmp_path / "lineitem.parquet")
    for k in range(4):
        spark.range(1).selectExpr(f"explode(transform(sequence(0, 24), i -> i * 7 % 25 + {k} * 25)) AS x").selectExpr(*line.split(", ")).coalesce(1).write.mode("append").parquet(where)
    lens = {f: [1 + int(x) for x in pq.read_table(f)["l_extendedprice"].to_pylist()] for f in sorted(glob.glob(f"{where}/*.parquet"))}
    want = [n for f in lens for n in lens[f][::-1]]
    got = Q.QUERIES["tile_index"](spark, str(tmp_path)).orderBy("start").collect()
    assert [r.len for r in got] == want and [r.start for r in got] == [sum(want[:i]) for i in range(len(want))]


def test_rounds_read_packets_once(spark):
    """Views of every load, some twice or with nulls, packets with null keys, negative layers and equal prices, in chunks: the SQL's rows, without its windows."""
    rng, some = np.random.default_rng(5), lambda x, k: None if k % 37 == 5 else int(x)
    lines = [(some(rng.integers(0, 30), k), some(rng.integers(1, 8), k + 9), int(x), int(rng.integers(0, 16)), int(rng.integers(0, 6)), some(rng.integers(-2 if x >= 40 else 0, 8), k + 20), int(rng.integers(1, 9)) << 4) for k, x in enumerate(rng.integers(0, 64, 8000))]
    views = [(k - k % 2 if k < 20 else k, 7, int(rng.integers(0, 20 if k < 20 else 60)), some(rng.integers(0, 12), k), int(rng.integers(-2, 10)), int(rng.integers(1, 8)), int(rng.integers(0, 6)), int(rng.integers(0, 9)), None if k % 11 == 3 else float(rng.choice([0.2, 0.7, 0.9]))) for k in range(150)]
    p = spark.createDataFrame(lines, "okey long, line int, tx long, ty long, level int, layer long, len long")
    v = spark.createDataFrame(views, "view_id long, session_id long, x0 long, y0 long, w long, h long, level long, max_layers long, load double")
    con = duckdb.connect()
    con.register("p0", p.toArrow())
    con.register("v0", v.toArrow())
    sql = Q.ORACLES["round_refinement"].replace(f"({delivery_queries.VIEW_SQL})", "v0").replace(f"({delivery_queries.SQL_PACKETS})", "p0")
    assert "orders" not in sql and "lineitem" not in sql
    want = con.sql(sql).df()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = schedule.rounds(v, p, 64, 64, most=500)
        got = got.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cols = ["view_id", "turn", "okey", "line"]
    text = lambda d: d[cols].astype("Int64").astype(str).sort_values(cols).reset_index(drop=True)
    assert len(want) > 4000 and text(got).equals(text(want))
    plan = Q.QUERIES["round_refinement"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "dense_rank" not in plan and "row_number" not in plan


def test_viewport_tiles_leaves_cells_in_place(spark, duck, tmp_path):
    """Cells are joined where they are made, and keys below 0, whose views have no width, give the SQL's rows."""
    plan = Q.QUERIES["viewport_tiles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and plan.index("Join") < plan.index("Generate") < plan.index("Repartition")
    duck.sql(f"copy (select o_orderkey - 700 as o_orderkey, o_custkey - 70 as o_custkey, * exclude (o_orderkey, o_custkey) from orders) to '{tmp_path}/orders.parquet'")
    duck.sql(f"copy (select l_partkey - 1500 as l_partkey, l_suppkey - 5 as l_suppkey, * exclude (l_partkey, l_suppkey) from lineitem) to '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want, cols = con.sql(Q.ORACLES["viewport_tiles"]).df(), ["view_id", "tx", "ty", "packets", "visible"]
    text = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert len(want) and text(Q.QUERIES["viewport_tiles"](spark, str(tmp_path)).toPandas()).equals(text(want))


def test_shed_zip_never_brings_candidates_together(spark):
    """What the query shuffles doesn't grow with the candidates: no window over them."""
    got = Q.QUERIES["shed_zip"](spark, SF)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, most", [("sched_mode0", 32), ("sched_mode1", 32), ("sched_mode2", 32), ("per_session_topk", 16)])
def test_views_meet_no_more_packets_than_they_can_take(spark, duck, tmp_path, name, most):
    """Tiles with many packets are cut to their first ones before views meet them, with the same rows as the SQL."""
    duck.sql(f"copy (select l_orderkey * 100 + i as l_orderkey, * exclude (l_orderkey) from lineitem, range(100) r(i) where l_partkey < 160 and l_suppkey < 4) to '{tmp_path}/lineitem.parquet'")
    duck.sql(f"copy (select * from orders where o_orderkey % 40 = 1) to '{tmp_path}/orders.parquet'")
    got = Q.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"<= {most})") >= 2 and plan.index("Join") < plan.rindex(f"<= {most})")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name]).df()
    cols = sorted(want.columns)
    text = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert len(want) and text(got.toPandas()).equals(text(want))
