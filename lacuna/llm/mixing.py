"""Mixing sources to target weights by entropy balancing.

Every source gets a target of tokens: its weight's part of the budget, at most ``MOST`` times its own size; what a
full source leaves over is shared among the others by weight.  Rates of documents are those closest to one copy each (least
relative entropy) under the token constraint of their source and a bound of ``MOST`` copies:
``rate = min(MOST, exp(tilt * size / mean size))``.  The tilt solves the convex dual, by Newton steps that are held
between the best bounds so far (bisection where a step leaves them).  The dual only needs how many documents of each size a source has, so
the steps scan that small table; each step is one aggregation over all sources at once, which combines inside tasks.

Rates become copies by a uniform number of each document, a pure function of its id and text: ``floor(rate + u)``.  The
tilt is then narrowed until the copies, not only the rates, meet the target as closely as one tilt can (a few scans
with a grid of tilts each), and at last single documents get a copy more or less where that brings the sum closer.
No source is gathered in a task, rerunning gives the same copies.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a document of
size 0 takes nothing; a source without words has target 0; rows with equal id and text are treated alike; an empty
table gives no rows; other columns are ignored by ``mix`` and kept by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.ranks import placed

from ._spark import fresh, materialize, table

#: Weights of the sources in order, repeating; their share of all sizes; copies a document can have.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton steps of a scan plan, plans at most, and the relative error at which a source is settled.
STEPS, PLANS, CLOSE = 3, 30, 1e-9
#: Tilts tried in a scan of the rounding, its scans, and documents changed at the end in a source.
GRID, NARROW, MENDS = 16, 4, 4
#: Sources up to which their table is broadcast (under 200 bytes each).
BROADCAST_SOURCES = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, g (the source, ordered by code point with null last), size and u (0 to 1) of each row; written once."""
    text = F.col("text").cast("string")
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("g"),
            F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
            (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), text), 11) / float(1 << 53)).alias("u"),
        )
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """g, source_size, mean (size of the documents with words), target: one row for each source."""
    sources = rows.groupBy("g").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    listed = placed(sources.withColumn("all", F.lit(1)), ["all"], ["g"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, len(weights)) + 1).cast("int"))
    listed = materialize(listed.select("g", "source_size", (F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))).alias("mean"), weight.alias("weight")))
    budget, weighed = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.sum("weight")).first()
    level, full = (budget / weighed if weighed else 0.0), -1
    cap = most * F.col("source_size").cast("double")
    while True:  # sources only ever become full, so this ends
        over = level * F.col("weight") > cap
        n, taken, left = listed.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not left:
            break
        full, level = n, (budget - (taken or 0.0)) / left
    return listed.select("g", "source_size", "mean", F.least(level * F.col("weight"), cap).alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    """Copies expected of a document; a null tilt stands for the bound."""
    tilted = F.exp(F.least(tilt * size / mean, F.lit(1.0 + most)))
    return F.coalesce(F.least(tilted, F.lit(float(most))), F.lit(float(most)))


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows; else an ordinary join splits a hot source's rows."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def solved(histogram: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """g, target, mean, tilt: the solution of the dual for each source with words."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    none = F.lit(None).cast("double")
    state = sources.where("source_size > 0").select("g", "target", "mean", F.when(full, none).otherwise(F.lit(0.0)).alias("tilt"), none.alias("low"), none.alias("high"), full.alias("settled"))
    state = materialize(state)
    few = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for _ in range(PLANS):
        for _ in range(STEPS):
            state = newton(histogram, F.broadcast(state) if few else state, most)
        state = materialize(state)
        if not state.where("not settled").limit(1).count():
            break
    return state.select("g", "target", "mean", "tilt")


def newton(histogram: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """One step of every source that is not settled."""
    own = rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
    tokens = F.col("n") * F.col("size")
    keys = ["g", "target", "mean", "tilt", "low", "high", "settled"]
    sums = histogram.join(state, "g").groupBy(*keys).agg(
        F.sum(tokens * own).alias("got"), F.sum(F.when(own < most, tokens * own * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
    )
    beyond = F.col("got") - F.col("target")
    low = F.when(beyond < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(beyond > 0, F.col("tilt")).otherwise(F.col("high"))
    step = F.col("tilt") - beyond / F.nullif(F.col("slope"), F.lit(0.0))
    inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
    wider = 1 + F.abs(F.col("tilt"))  # no bound on that side yet
    other = F.when(low.isNull(), high - wider).when(high.isNull(), low + wider).otherwise((low + high) / 2)
    settled = F.col("settled") | (F.abs(beyond) <= CLOSE * F.col("target"))
    moved = F.when(settled, F.col("tilt")).when(inside, step).otherwise(other)
    return sums.select("g", "target", "mean", moved.alias("tilt"), low.alias("low"), high.alias("high"), settled.alias("settled"))


def copies(tilt: Column, most: float = MOST) -> Column:
    return F.floor(rate(tilt, F.col("size"), F.col("mean"), most) + F.col("u"))


def rounded(rows: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """g, mean, tilt, gap: the tilt whose copies come closest to the target, and what they leave open."""
    steps = [4.0**k for k in range(3, -GRID // 2 + 3, -1)]
    tilts = [*[F.col("tilt") - s for s in steps], F.col("tilt"), *[F.col("tilt") + s for s in reversed(steps)]]
    state = state.select("g", "target", "mean", F.array(*tilts).alias("tilts"))
    for _ in range(NARROW):
        n = GRID + 1
        sums = rows.join(small(state), "g").groupBy("g", "target", "mean", "tilts").agg(
            F.array(*[F.sum(F.col("size") * copies(F.col("tilts")[k], most)) for k in range(n)]).alias("sums")
        )
        under = F.size(F.filter("sums", lambda s: s <= F.col("target")))  # sums do not fall from tilt to tilt
        at = F.greatest(F.least(under, F.lit(n - 1)), F.lit(1))  # the target lies between place at and at + 1 (from 1)
        low, high = F.element_at("tilts", at), F.element_at("tilts", at + 1)
        off = lambda k: F.abs(F.element_at("sums", k) - F.col("target"))
        best = F.when(off(at) <= off(at + 1), at).otherwise(at + 1)
        grid = F.array(*[F.when(F.lit(k) == GRID, high).otherwise(low + (high - low) * (k / GRID)) for k in range(n)])
        state = materialize(
            sums.select("g", "target", "mean", grid.alias("tilts"), F.element_at("tilts", best).alias("tilt"), (F.col("target") - F.element_at("sums", best)).alias("gap"))
        )
    return state.select("g", "mean", "tilt", "gap")


def changed(most: float) -> Column:
    """Copies of a document after the changes of its source."""
    own = F.filter("flips", lambda f: (f.u == F.col("u")) & (f["size"] == F.col("size")))
    return copies(F.col("tilt"), most) + F.aggregate(own, F.lit(0).cast("long"), lambda a, f: a + f.by)


def mended(rows: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """The state with ``flips``: documents that get a copy more or less to close the gap of their source."""
    flip = "array<struct<u:double,size:long,by:long>>"
    state = state.select("*", F.array().cast(flip).alias("flips"), F.lit(True).alias("open"))
    for _ in range(MENDS + 1):
        joined = rows.where("size > 0").join(small(state), "g")
        by = F.when(F.col("gap") > 0, 1).otherwise(-1).cast("long")
        last = F.try_element_at("flips", F.lit(-1))
        now = changed(most)
        can = F.col("open") & F.when(F.col("gap") > 0, now < most).otherwise(now > 0) & (F.abs(F.col("gap") - by * F.col("size")) < F.abs("gap"))
        choice = F.struct(F.abs(F.col("gap") - by * F.col("size")).alias("left"), F.col("u"), F.col("size"), by.alias("by"))
        found = joined.groupBy("g", "mean", "tilt", "gap", "flips", "open").agg(
            F.min(F.when(can, choice)).alias("pick"),
            F.count(F.when((last.u == F.col("u")) & (last["size"] == F.col("size")), 1)).alias("alike"),
        )
        twice = F.col("alike") > 1  # the last change hit several equal rows: it is taken back
        flips = F.when(twice, F.slice("flips", 1, F.greatest(F.size("flips") - 1, F.lit(0)))).when(
            F.col("pick").isNotNull(), F.concat("flips", F.array(F.struct(F.col("pick.u").alias("u"), F.col("pick.size").alias("size"), F.col("pick.by").alias("by"))).cast(flip))
        ).otherwise(F.col("flips"))
        gap = F.when(twice, F.col("gap") + last.by * last["size"]).when(F.col("pick").isNotNull(), F.col("gap") - F.col("pick.by") * F.col("pick.size")).otherwise(F.col("gap"))
        state = materialize(found.select("g", "mean", "tilt", gap.alias("gap"), flips.alias("flips"), (F.col("open") & ~twice & F.col("pick").isNotNull()).alias("open")))
    return state


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The columns of ``rows`` (see ``sized``) with source_size, target and copies."""
    sources = materialize(targets(rows, weights, share, most))
    histogram = materialize(rows.where("size > 0").groupBy("g", "size").agg(F.count(F.lit(1)).alias("n")))
    state = mended(rows, rounded(rows.where("size > 0"), solved(histogram, sources, most), most), most)
    known = materialize(sources.select("g", "source_size", "target").join(state.select("g", "mean", "tilt", "flips"), "g", "left"))
    number = F.when(F.col("size") == 0, F.lit(1)).otherwise(changed(most))
    return rows.join(small(known), "g").select(*rows.columns, "source_size", "target", number.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``."""
    out = plan(sized(docs.select("doc_id", "text", "source")), weights, share, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it, with all its columns.

    A row meets its number of copies by its id, size, source and uniform number, which equal rows share.
    """
    names = {c: fresh(docs, f"mix_{c}") for c in ("doc_id", "g", "size", "u")}
    text = F.col("text").cast("string")
    own = docs.select(
        "*", F.col("doc_id").cast("long").alias(names["doc_id"]), F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias(names["g"]),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias(names["size"]),
        (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), text), 11) / float(1 << 53)).alias(names["u"]),
    )
    numbers = plan(sized(docs.select("doc_id", "text", "source")), weights, share, most)
    numbers = numbers.groupBy("doc_id", "g", "size", "u").agg(F.max("copies").alias("copies")).alias("numbers")
    met = own.join(numbers, [F.col(names[c]).eqNullSafe(F.col(f"numbers.{c}")) for c in names])
    return met.withColumn(fresh(docs, "mix_copy"), F.explode(F.sequence(F.lit(1), F.col("numbers.copies").cast("int"), F.lit(1)))).where("numbers.copies > 0").select(*[own[f"`{c}`"] for c in docs.columns])


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
