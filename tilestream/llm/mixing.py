"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents are dealt to blocks of about equal size. A source's quota of words is whole passes over its blocks and a partial
one over a random permutation of them. The drawn blocks are dealt to output shards by a splitting tree: at each node a multivariate
hypergeometric draw gives the left half of the shards its exact number of blocks of each source. Within a shard documents are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilestream.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: A source table of up to so many rows (of some 50 bytes) is broadcast; a larger one is joined by shuffling.
BROADCAST_SOURCES = 50_000
#: Words of the input for each output shard, about.
SHARD_WORDS = 1 << 22


def running(df: DataFrame, order: list[Column], sums: dict[str, str], what: str) -> DataFrame:
    """df with `place` (from 0, in the order given) and, for each name in sums, the sum of its column over all rows before and over all rows.

    Rows are dealt by range; only one row for each part is brought together, so no task holds the table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), what)
    of = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ["__n", *(f"__{n}" for n in sums)]]
    of = of.select(F.col("__part").alias("__p"), *cols, *[F.sum(f"__{n}").over(W.partitionBy()).alias(f"{n}_all") for n in sums])
    joined = dealt.join(F.broadcast(of), F.col("__part") == F.col("__p"))
    here, before = W.partitionBy("__part").orderBy(*order), W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("place", (F.row_number().over(here) - 1 + F.col("__n_ahead")).cast("long"))
    for n, c in sums.items():
        joined = joined.withColumn(f"{n}_before", F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{n}_ahead"))
    return joined.select(*df.columns, "place", *[f"{n}_{x}" for n in sums for x in ("before", "all")])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """si (place of the source by code point, null last), source, source_size, target.

    Targets are weight times a common level, at most `epochs` times the source's size: what is cut off is shared again by weight until no
    source is above. The level is found in one go, from sources in the order in which they reach their limits.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s, [F.col("source").isNull(), F.col("source")], {}, "mix-sources").withColumnRenamed("place", "si")
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("si") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", epochs * F.col("source_size"))
    s = running(s, [F.col("cap") / F.col("w"), F.col("si")], {"size": "source_size", "cap": "cap", "w": "w"}, "mix-levels").drop("place")
    s = s.withColumn("level", (share * F.col("size_all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    found = s.where(F.col("level") <= F.col("cap") / F.col("w")).agg(F.min(F.struct((F.col("cap") / F.col("w")).alias("at"), "si", "level")).alias("found"))
    s = s.crossJoin(F.broadcast(found))  # one row
    return s.select(F.col("si").cast("int").alias("si"), "source", "source_size", F.least(F.coalesce(F.col("found.level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def hypergeometric(s: str) -> str:
    """SQL for a draw from the hypergeometric distribution by inversion. s: a struct with total, good, drawn (long) and u in [0, 1).

    The support is walked from the mode outwards, up and then down, with weights relative to the mode's. Terms over nine standard
    deviations away, together below 1e-17, are left out.
    """
    up = lambda a: f"{a}.w * ({s}.good - k + 1D) * ({s}.drawn - k + 1D) / (k * ({s}.total - {s}.good - {s}.drawn + k + 0D))"
    down = lambda a: f"{a}.w * (k + 1D) * ({s}.total - {s}.good - {s}.drawn + k + 1D) / (({s}.good - k + 0D) * ({s}.drawn - k + 0D))"

    def walk(start: str, way: str, keys: str) -> str:
        step = up("a") if way == "up" else down("a")
        return f"aggregate({keys}, {start}, (a, k) -> named_struct('w', {step}, 's', a.s + {step}, 'x', CASE WHEN a.x IS NULL AND a.s + {step} > a.goal THEN k ELSE a.x END, 'goal', a.goal))"

    above = "filter(sequence(m.mode, m.high), k -> k > m.mode)"
    below = "filter(reverse(sequence(m.low, m.mode)), k -> k < m.mode)"

    def both(goal: str, x: str) -> str:
        first = walk(f"named_struct('w', 1D, 's', 1D, 'x', {x}, 'goal', {goal})", "up", above)
        again = walk("named_struct('w', 1D, 's', b.s, 'x', b.x, 'goal', b.goal)", "down", below)
        return f"transform(array({first}), b -> {again})[0]"

    spread = f"ceil(9 * sqrt({s}.drawn * ({s}.good + 0D) / greatest({s}.total, 1) * ({s}.total - {s}.good) / greatest({s}.total, 1) * ({s}.total - {s}.drawn) / greatest({s}.total - 1, 1))) + 2"
    lo, hi = f"greatest(0L, {s}.drawn - ({s}.total - {s}.good))", f"least({s}.drawn, {s}.good)"
    mode = f"least({hi}, greatest({lo}, cast(floor(({s}.drawn + 1D) * ({s}.good + 1D) / ({s}.total + 2D)) AS BIGINT)))"
    bounds = f"transform(array({mode}), m0 -> named_struct('mode', m0, 'low', greatest({lo}, m0 - cast({spread} AS BIGINT)), 'high', least({hi}, m0 + cast({spread} AS BIGINT))))"
    weight = both("1e300D", "cast(null AS BIGINT)")
    picked = both(f"({s}.u * g)", f"CASE WHEN 1D > {s}.u * g THEN m.mode END")
    return f"transform({bounds}, m -> transform(array(({weight}).s), g -> coalesce(({picked}).x, m.mode))[0])[0]"


def splitting_tree(counts: DataFrame, shards: int, seed: str) -> DataFrame:
    """si, shard, quota from si, cnt: each shard's number of blocks of each source. shards: a power of two.

    A node holds the counts of its sources, as one array; the left half of its shards gets half of its blocks, drawn without replacement.
    Sources without blocks leave a node, so a level of the tree holds no more than one count for each block; nodes are dealt anew as they multiply.
    """
    nodes = counts.where("cnt > 0").agg(F.array_sort(F.collect_list(F.struct("si", F.col("cnt").cast("long").alias("cnt")))).alias("own")).select(F.lit(0).alias("node"), "own").where("size(own) > 0")
    width = 1
    while width < shards:
        width *= 2
        u = f"(shiftrightunsigned(xxhash64('{seed}', {width}, node, x.si), 11) / 9007199254740992D)"
        draw = f"transform(array(named_struct('total', a.total, 'good', x.cnt, 'drawn', a.drawn, 'u', {u})), s -> {hypergeometric('s')})"
        fold = (
            f"aggregate(own, named_struct('total', aggregate(own, 0L, (a, x) -> a + x.cnt), 'drawn', cast(floor(aggregate(own, 0L, (a, x) -> a + x.cnt) / 2) AS BIGINT), 'out', cast(array() AS array<struct<si:int,left:bigint,cnt:bigint>>)), "
            f"(a, x) -> transform({draw}, l -> named_struct('total', a.total - x.cnt, 'drawn', a.drawn - l, 'out', concat(a.out, array(named_struct('si', x.si, 'left', l, 'cnt', x.cnt)))))[0], a -> a.out)"
        )
        split = nodes.select("node", F.expr(fold).alias("cut"))
        nodes = split.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.expr("transform(cut, c -> named_struct('si', c.si, 'cnt', c.left))").alias("own")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("transform(cut, c -> named_struct('si', c.si, 'cnt', c.cnt - c.left))").alias("own")),
                )
            ).alias("n")
        ).select("n.node", F.expr("filter(n.own, c -> c.cnt > 0)").alias("own")).where("size(own) > 0")
        if width in (32, 1024):
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode("own").alias("o")).select("o.si", "shard", F.col("o.cnt").alias("quota"))


def mix(rows: DataFrame, key: list[str], seed: str = "mix", shards: int | None = None, block_words: int = 2048, most_blocks: int = 65536, **settings) -> DataFrame:
    """rows (with the columns of key, source and size, and h, a hash of the row) with source_size, target, taken and placed.

    taken: words that the mix takes, repeats counted: the sum over a source is its target rounded, and no row exceeds `epochs` times its
    size, where the last one may be taken in part. placed: array of (epoch, shard, words), one for each time that the row is taken.
    shards: a power of two; by the size of the input unless given. There are at most most_blocks blocks beyond one for each source, so block tables stay small however large the input is.
    """
    targets = written(source_targets(rows, **settings), "mix-targets")
    many = targets.count() > BROADCAST_SOURCES
    t = targets.select("si", F.col("source").alias("__source"), "source_size", "target")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    each = max(block_words, -(-total // most_blocks))
    if shards is None:
        shards = min(1 << 14, max(8, 1 << max(0, total // SHARD_WORDS).bit_length()))
    docs = rows.join(t if many else F.broadcast(t), F.col("source").eqNullSafe(F.col("__source")))
    docs = docs.withColumn("block", F.pmod("h", F.greatest(F.lit(1), F.ceil(F.col("source_size") / each))))
    blocks = docs.groupBy("si", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("ss"), F.first("target").alias("tt"))
    order = W.partitionBy("si").orderBy(F.xxhash64(F.lit(seed), "si", "block"), "block")
    blocks = blocks.withColumn("cum", F.sum("words").over(order) - F.col("words"))
    goal = F.round("tt").cast("long")
    blocks = blocks.withColumn("full", F.when(F.col("ss") > 0, F.least(F.floor(goal / F.greatest(F.col("ss"), F.lit(1))), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long"))
    blocks = blocks.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), goal - F.col("full") * F.col("ss") - F.col("cum"))))
    blocks = written(blocks.select("si", "block", "full", "part"), "mix-blocks")
    copies = blocks.select("si", "block", F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.col("full") + 1), lambda e: (e <= F.col("full")) | (F.col("part") > 0))).alias("epoch"))
    quotas = splitting_tree(copies.groupBy("si").agg(F.count("*").alias("cnt")), shards, seed)
    quotas = quotas.withColumn("upto", F.sum("quota").over(W.partitionBy("si").orderBy("shard"))).where("quota > 0")
    # a quota names its ranks, so that copies meet their shard by equality
    quotas = quotas.select(F.col("si").alias("__si"), "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("__rank"))
    ranked = copies.withColumn("rank", F.row_number().over(W.partitionBy("si").orderBy(F.xxhash64(F.lit(seed + "/deal"), "si", "epoch", "block"), "epoch", "block")))
    dealt = ranked.join(quotas, (F.col("si") == F.col("__si")) & (F.col("rank") == F.col("__rank")))
    dealt = dealt.groupBy(F.col("si").alias("__si"), F.col("block").alias("__block")).agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("dealt"))
    plan = blocks.join(dealt, (F.col("si") == F.col("__si")) & (F.col("block") == F.col("__block")), "left").select(F.col("si").alias("__si"), F.col("block").alias("__block"), "full", "part", "dealt")
    docs = docs.join(plan, (F.col("si") == F.col("__si")) & (F.col("block") == F.col("__block"))).drop("__si", "__block", "__source")
    within = W.partitionBy("si", "block").orderBy("h", *key, "size")
    docs = docs.withColumn("cum", F.sum("size").over(within) - F.col("size"))
    docs = docs.withColumn("last", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("part") - F.col("cum"))))
    words = lambda d: F.when(d["epoch"] <= F.col("full"), F.col("size")).otherwise(F.col("last"))
    placed = F.filter(F.transform(F.coalesce("dealt", F.expr("cast(array() as array<struct<epoch:bigint,shard:int>>)")), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).cast("long").alias("words"))), lambda d: d["words"] > 0)
    return docs.withColumn("taken", (F.col("full") * F.col("size") + F.col("last")).cast("long")).withColumn("placed", placed).select(*key, "h", "source", "size", "source_size", "target", "taken", "placed")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and h of every row, written once so that texts are read once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return written(rows.withColumn("h", F.xxhash64("doc_id", "size", F.lit("block"))), "mix-sizes")


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (and shards) of every row. Null text has size 0; null source is a source; reruns agree."""
    return mix(sized(docs), ["doc_id"], **settings).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", F.transform("placed", lambda p: p["shard"]).alias("shards"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken, dealt to shards and shuffled in each.

    A shard lies in up to four partitions, in random order. The one document of a source that is taken in part gives its first words,
    separated by single blanks. Rows that repeat an id, size and source are told apart by number, in the order of their texts, so each is
    taken as often as its plan says and reruns agree. Null ids and sources count as values of their own; empty tables give no rows.
    """
    key = ["__k", "__n", "__src"]
    named = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__k"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("__src")]
    plan = mix(sized(docs), ["doc_id"], **settings).select(*named, F.col("size").alias("__n"), "placed")
    own = docs.select(F.struct("*").alias("__row"), *named, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__n"))
    plan = written(plan, "mix-plan")
    if plan.groupBy(*key).count().where("count > 1").isEmpty():
        joined = own.join(plan, key)
    else:
        plan = plan.withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy("placed")))
        own = own.withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy("__row.text")))
        joined = own.join(plan, [*key, "__nth"])
    taken = joined.select("__row", "__n", F.explode("placed").alias("__p"))
    taken = taken.withColumn("__h", F.xxhash64("__row.doc_id", "__p.epoch", F.lit("shuffle")))
    some = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("__row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__p.words").cast("int")))
    text = F.when(F.col("__p.words") < F.col("__n"), some).otherwise(F.col("__row.text"))
    row: Column = F.col("__row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("__p.words") < F.col("__n"), F.length(some).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars")))
    return taken.repartition("__p.shard", F.pmod("__h", F.lit(4))).sortWithinPartitions("__p.shard", "__h").select(row.alias("__row")).select("__row.*")
