"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose score exceeds a cutoff. Labelled documents of good quality are the holdout: a cutoff is admitted only if
the exact binomial test shows, at the level left after correction, that the rule rejects at most its share of the stratum's good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestream.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
POS_BITS = 26
#: Cutoffs by rule, from the mildest to the strictest; they are parameters and don't depend on the data.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_lines": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "long_words": (30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0),
    "short_words": (-1.2, -1.5, -2.0, -2.5, -3.0),
}


def text_measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_text_lines; all long.

    A repeated 3-word window is found within the row: windows are sorted by a hash with the position in the low bits, and neighbours of
    equal hash are compared word by word. Where two different windows have one hash, or a text has too many words for the position's
    bits, its windows are sorted by their words instead, so figures are exact for every text. Nothing is shuffled.
    """
    rest = [c for c in rows.columns if c != text]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = rows.select(*rest, t.alias("__t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__w"))
    n = F.size("__w")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    low = F.lit((1 << POS_BITS) - 1).cast("long")
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]), POS_BITS).bitwiseOR(i.cast("long").bitwiseAND(low)))
    own = own.select(
        *rest,
        "__w",
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        F.when(n >= 3, F.sort_array(hashed)).alias("__k"),
    )
    place = lambda k: k.bitwiseAND(low).cast("int")

    def same_hash(k: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(k, POS_BITS) == F.shiftright(other, POS_BITS), F.lit(False))

    def same_words(k: Column, other: Column) -> Column:
        a, b, w = place(k), place(other), F.col("__w")
        return (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])

    same = lambda k, other: same_hash(k, other) & F.coalesce(same_words(k, other), F.lit(False))
    by_hash = F.sort_array(F.transform(F.filter("__k", lambda k, i: same(k, F.get("__k", i - 1)) | same(k, F.get("__k", i + 1))), lambda k: k.bitwiseAND(low)))
    unclear = (F.size("__w") > 1 << POS_BITS) | F.exists(
        F.transform("__k", lambda k, i: same_hash(k, F.get("__k", i - 1)) & ~F.coalesce(same_words(k, F.get("__k", i - 1)), F.lit(False))), lambda x: x
    )
    # by words: windows in order, each with its place; repeated ones are neighbours
    by_words = F.expr(
        "transform(array(array_sort(transform(sequence(0, size(__w) - 3), i -> named_struct('a', __w[i], 'b', __w[i + 1], 'c', __w[i + 2], 'i', cast(i AS BIGINT))))), "
        "s -> array_sort(transform(filter(s, (x, j) -> coalesce(get(s, j - 1).a = x.a AND get(s, j - 1).b = x.b AND get(s, j - 1).c = x.c, false) "
        "OR coalesce(get(s, j + 1).a = x.a AND get(s, j + 1).b = x.b AND get(s, j + 1).c = x.c, false)), x -> x.i)))[0]"
    )
    covered = F.aggregate(
        F.when(F.size("__w") < 3, F.lit(None)).when(unclear, by_words).otherwise(by_hash),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    return own.select(
        *rest,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_text_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_text_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def ln_factorial(x: str) -> str:
    """SQL for ln(x!): Stirling's series at x + 16, whose error is below 1e-13 there, less the sixteen factors above x."""
    y = f"({x} + 16D)"
    return f"({y} * ln({y}) - {y} + 0.5D * ln(2 * pi() * {y}) + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - aggregate(sequence(1, 16), 0D, (a, i) -> a + ln({x} + i)))"


def binomial_below(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X binomial(n, p), for k < n p: the top term by logarithms, the rest relative to it.

    Terms fall at least as fast as exp(-d * d / (2 n p q)) at distance d from the top, so those more than ten deviations and ten away
    (below 1e-21 of it) are left out, and the work grows with the root of n.
    """
    q = 1 - p
    top = f"({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')} + {k} * ln({p!r}D) + ({n} - {k}) * ln({q!r}D))"
    least = f"greatest(0L, {k} - 10 - cast(ceil(10 * sqrt({n} * {p!r}D * {q!r}D)) AS BIGINT))"
    rest = f"aggregate(filter(reverse(sequence({least}, {k})), j -> j > 0), named_struct('t', 1D, 's', 1D), (a, j) -> named_struct('t', a.t * j * {q!r}D / (({n} - j + 1D) * {p!r}D), 's', a.s + a.t * j * {q!r}D / (({n} - j + 1D) * {p!r}D)), a -> a.s)"
    return f"exp({top} + ln({rest}))"


def thresholds(measured: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """stratum, cutoffs (map from each rule to its admitted cutoff; a rule without one rejects nothing there).

    The rules share `risk` evenly, so all together falsely reject at most that share of a stratum's good documents; `error` is shared by
    strata and rules (Bonferroni), while a rule's cutoffs are tested from mild to strict and end at the first failure (a fixed sequence
    needs no correction). A stratum with too few labels gets no cutoffs. The holdout is every good labelled row, however many.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    held = measured.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    own = scores()
    tested = [(r, i, c) for r, cuts in RULES.items() for i, c in enumerate(cuts)]
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(own[r] > c).alias(f"__{r}_{i}") for r, i, c in tested])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cut"), F.col(f"__{r}_{i}").alias("k")) for r, i, c in tested])).alias("t")
    rows = counted.select("stratum", "n", each).select("stratum", "n", "t.*").crossJoin(counted.agg(F.count("*").alias("strata")))
    share = risk / len(RULES)
    low = F.expr(f"CASE WHEN k < n * {share!r}D THEN {binomial_below('k', 'n', share)} ELSE 1D END")
    rows = rows.withColumn("passed", low <= F.lit(error) / (F.col("strata") * len(RULES)))
    by = rows.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("i"))).alias("stop"), F.collect_list(F.struct("i", "cut")).alias("cuts"))
    admitted = F.array_max(F.filter("cuts", lambda c: F.col("stop").isNull() | (c["i"] < F.col("stop"))))["cut"]
    by = by.select("stratum", "rule", admitted.alias("cut")).where("cut is not null")
    return by.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cutoffs"))


#: Tables of strata are broadcast up to so many rows (of some 200 bytes); larger ones are joined by shuffling, each stratum in SALTS parts.
BROADCAST_STRATA, SALTS = 20_000, 16


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, stratum: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed, kept and the first failing rule (reason) of every row.

    Null text has no words and fails the base. Null strata are a stratum of their own. Labels that are null, of unknown documents or of
    quality other than 1 aren't used; of several labels of a document the lowest counts. Without labels only the base decides.
    """
    return _judged(docs, labels, risk, error, stratum, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def _judged(docs: DataFrame, labels: DataFrame, risk: float, error: float, stratum: str, more: list[Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")).alias("stratum"), "text", *more)
    measured = written(text_measures(rows).withColumn("base_failed", base_failed()), "quality-measures")
    cut = written(thresholds(measured, labels, risk, error).withColumnRenamed("stratum", "__s"), "quality-cutoffs")
    if cut.count() <= BROADCAST_STRATA:
        joined = measured.join(F.broadcast(cut), F.col("stratum") == F.col("__s"), "left")
    else:
        cut = cut.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.join(cut, (F.col("stratum") == F.col("__s")) & (F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)) == F.col("__salt")), "left")
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for r, score in scores().items():
        reason = reason.when(F.coalesce(score > F.col("cutoffs")[r], F.lit(False)), F.lit(r))
    return joined.withColumn("kept", reason.isNull()).withColumn("reason", reason)


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, stratum: str = "lang") -> DataFrame:
    """The rows of docs that judged() keeps, each row by its own text, with all their columns.

    Rows are written once beside their measures, so no text is shuffled.
    """
    return _judged(docs, labels, risk, error, stratum, [F.struct("*").alias("__row")]).where("kept").select("__row.*")
