"""Quality rules with adaptive thresholds.

Each document gets plain counts (words, characters, symbols, repeated lines, words in repeated
three-word windows).  The shares made of them go into logarithmic quantile sketches (buckets of a
fixed relative width), one for each language, source and rule.  Sketches are tables of bucket
counts: they merge by addition, do not depend on the order of rows, and are of bounded size.  A
group with few documents borrows the merged sketch of its language, or of everything.

Every threshold comes from quantiles of these sketches; there are no fixed bounds beside them.  Mean word
lengths have fences around the quartiles.  Most documents have no symbols, no repeated lines and no repeated windows,
so these shares are judged by the part of the sketch above zero: where even its small values are far from
zero (``GAP``) and most documents have none, the two parts are different populations, and the threshold lies between them; else it
is the fence of that part's quartiles in logarithms.  Documents are joined with the thresholds of their group and pass
if no rule fails.

Defined cases: a null text has no words (and so fails the base rule); null lang or source are
groups of their own; each row is judged alone, so repeated rows get equal verdicts; where no document anywhere
has passed the base rule, or none has a share above zero, that rule has no threshold and fails nothing; an empty
table gives no rows; very long texts are counted piece by piece; other columns are kept by ``filter_documents`` and ignored otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import fresh, mapped, materialize, parts, table, texts
from ._words import mix, shifted, word_hashes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
#: Relative width of a bucket, and the smallest share that is told from zero.
GAMMA, LEAST = 1.05, 1e-4
#: Documents that a group needs to have thresholds of its own (for shares: documents above zero).
MIN_GROUP, MIN_ABOVE = 200, 50
#: Widths of the fences: in quartile ranges, and in those of logarithms; least range as a part of the upper quartile.
FENCE, LOG_FENCE, LEAST_SPREAD = 3.0, 1.5, 0.1
#: How far from zero the small values (5 %) of a share must lie, and how many documents must have none, to be two populations.
GAP, MOSTLY = 0.05, 0.75
#: Groups up to which thresholds are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 20_000
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A figure that must not lie beyond a threshold; a share is judged by its part above zero."""

    name: str
    share: bool = False
    upper: bool = True


RULES = (
    Rule("symbol_share", share=True),
    Rule("dup_line_share", share=True),
    Rule("repeat_share", share=True),
    Rule("long_words"),
    Rule("short_words", upper=False),
)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counts(made: list[bytes]) -> np.ndarray:
    """The counts named in ``_COUNTS`` of whole texts, one row for each text.

    Windows are told apart by 64-bit hashes within their text.
    """
    out = np.zeros((len(made), len(_COUNTS)), np.int64)
    hashes, sizes = word_hashes().of(made)
    out[:, 0] = sizes
    for i, text in enumerate(made):
        inside = np.frombuffer(text, np.uint8)
        letters = len(text) - sum(map(text.count, (_SPACE[k : k + 1] for k in range(len(_SPACE)))))
        out[i, 1] = letters - (0 if text.isascii() else int(np.count_nonzero((inside & 0xC0) == 0x80)))
        out[i, 2] = sum(map(text.count, (SYMBOLS[k : k + 1] for k in range(len(SYMBOLS)))))
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            out[i, 3], out[i, 4] = len(lines), len(lines) - len(set(lines))
        else:
            out[i, 3] = int(sizes[i] > 0)
    has = np.maximum(sizes - 2, 0)
    if has.sum():
        owner = np.repeat(np.arange(len(made)), has)
        starts = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(has) + has, has) + np.arange(has.sum())
        windows = mix(mix(hashes, shifted(hashes, 1)), shifted(hashes, 2))[starts]
        _, where, often = np.unique(mix(windows, owner.astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = starts[often[where.ravel()] > 1]
        covered = np.zeros(len(hashes) + 2, bool)
        for by in range(3):
            covered[twice + by] = True
        upto = np.concatenate([[0], np.cumsum(covered)])
        ends = np.cumsum(sizes)
        out[:, 5] = upto[ends] - upto[ends - sizes]
    return out


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs``, and a struct column ``name`` with the counts of its text."""
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, at)):
            made = counts(texts(batch, at))
            struct = pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(len(_COUNTS))], names=list(_COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    schema = docs.select("*", F.lit(None).cast(f"struct<{','.join(f'{c}:bigint' for c in _COUNTS)}>").alias(name)).schema
    return mapped(docs, run, schema)


def shares(q: str) -> dict[str, Column]:
    c = {k: F.col(f"{q}.{k}").cast("double") for k in _COUNTS}
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    mean = per(c["word_chars"], c["n_words"])
    return {
        "symbol_share": per(c["n_symbols"], c["word_chars"]),
        "dup_line_share": per(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": per(c["n_repeat_words"], c["n_words"]),
        "long_words": mean,
        "short_words": mean,
    }


def base_failed(q: str) -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def bucket(share: Column) -> Column:
    """The bucket of a share: 0 for (nearly) zero, else the logarithmic step that it lies in."""
    step = F.ceil(F.log(share / LEAST) / math.log(GAMMA)).cast("int")
    return F.when(share <= LEAST, 0).otherwise(F.greatest(step, F.lit(1)))


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket; its relative error is at most (GAMMA - 1) / (GAMMA + 1)."""
    return F.when(b <= 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), b.cast("double")) * 2 / (1 + GAMMA))


def sketch(counted: DataFrame, q: str) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all groups, from documents that pass the base rule."""
    by = shares(q)
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(by[r.name]).alias("bucket")) for r in RULES]))
    return (
        counted.where(~base_failed(q))
        .select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), rows.alias("r"))
        .groupBy("lang", "source", "r.rule", "r.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile(keys: list[str], sketches: DataFrame, *ps: float) -> DataFrame:
    """Quantiles of merged sketches: one row for each key with its number of documents and q0, q1, ...

    Beside them, the number of documents above zero (``above``) and quantiles of those alone: a0, a1, ...
    """
    merged = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys)
    above = F.when(F.col("bucket") > 0, F.col("n")).otherwise(0)
    ranked = merged.select(
        *keys, "bucket", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("total"),
        F.sum(above).over(whole.orderBy("bucket")).alias("above_upto"), F.sum(above).over(whole).alias("above_total"),
    )
    at = lambda upto, total, p: F.min(F.when((F.col(upto) >= p * F.col(total)) & (F.col(upto) > 0), F.col("bucket")))
    return ranked.groupBy(*keys).agg(
        F.max("total").alias("docs"), F.max("above_total").alias("above"),
        *[bucket_value(at("upto", "total", p)).alias(f"q{i}") for i, p in enumerate(ps)],
        *[bucket_value(at("above_upto", "above_total", p)).alias(f"a{i}") for i, p in enumerate(ps)],
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and one column for each rule: the threshold of the group, its language or everything (null: none)."""
    ps = (0.05, 0.25, 0.75)
    groups = sketches.select("lang", "source", "rule").distinct()
    own = quantile(["lang", "source", "rule"], sketches, *ps).alias("o")
    lang = quantile(["lang", "rule"], sketches, *ps).alias("l")
    every = quantile(["rule"], sketches, *ps).alias("e")
    g = groups.alias("g")
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    joined = (
        g.join(own, same("g", "o", ["lang", "source", "rule"]), "left")
        .join(lang, same("g", "l", ["lang", "rule"]), "left")
        .join(every, same("g", "e", ["rule"]), "left")
    )

    def picked(q: str, size: str, least: int) -> Column:
        enough = lambda t: F.col(f"{t}.{size}") >= least
        return F.when(enough("o"), F.col(f"o.{q}")).when(enough("l"), F.col(f"l.{q}")).otherwise(F.col(f"e.{q}"))

    lo, hi = picked("q1", "docs", MIN_GROUP), picked("q2", "docs", MIN_GROUP)
    # quartiles that share a bucket look equal: the range counts as a tenth of the upper one at least
    spread = F.greatest(hi - lo, LEAST_SPREAD * hi)
    small, low, high, docs, above = (picked(x, "above", MIN_ABOVE) for x in ("a0", "a1", "a2", "docs", "above"))
    apart = (small >= GAP) & (above <= (1 - MOSTLY) * docs)
    share = F.when(apart, small / 2).otherwise(high * F.pow(F.greatest(high / low, F.lit(1 + LEAST_SPREAD)), F.lit(LOG_FENCE)))
    fence = F.lit(None).cast("double")
    for r in RULES:
        value = share if r.share else hi + FENCE * spread if r.upper else lo - FENCE * spread
        fence = F.when(F.col("g.rule") == r.name, value).otherwise(fence)
    return (
        joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.rule").alias("rule"), fence.alias("fence"))
        .groupBy("lang", "source")
        .pivot("rule", [r.name for r in RULES])
        .agg(F.first("fence"))
    )


def judged(docs: DataFrame) -> tuple[DataFrame, str, Column, Column]:
    """Documents with counts (struct column) joined with thresholds; the base verdict and the method's."""
    q = fresh(docs, "quality_counts")
    counted = with_counts(docs, q)
    small = counted.select(*[c for c in docs.columns if c.lower() in ("lang", "source")], q)
    cut = thresholds(materialize(sketch(small, q)))  # a few rows for each group: read thrice below
    t = fresh(docs, "quality_thresholds")
    cut = cut.select(F.col("lang").alias(f"{t}_lang"), F.col("source").alias(f"{t}_source"), F.struct(*[r.name for r in RULES]).alias(t))
    if cut.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:  # else an ordinary join, which splits a hot group
        cut = F.broadcast(cut)
    joined = counted.join(
        cut,
        F.col("lang").cast("string").eqNullSafe(F.col(f"{t}_lang")) & F.col("source").cast("string").eqNullSafe(F.col(f"{t}_source")),
        "left",
    )
    by = shares(q)
    beyond = lambda r: by[r.name] > F.col(f"{t}.{r.name}") if r.upper else by[r.name] < F.col(f"{t}.{r.name}")
    failed = F.lit(False)
    for r in RULES:  # a group whose documents all fail the base rule has no row in the table: they fail anyway
        failed = failed | F.coalesce(beyond(r), F.lit(False))
    return joined, q, base_failed(q), ~failed


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row for each row of ``docs``."""
    joined, q, base, passes = judged(docs.select("doc_id", "text", "lang", "source"))
    return joined.select(
        F.col("doc_id"),
        *[F.col(f"{q}.{c}").alias(c) for c in _COUNTS],
        base.alias("base_failed"),
        (~base & passes).alias("kept"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    joined, _, base, passes = judged(docs)
    return joined.where(~base & passes).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
