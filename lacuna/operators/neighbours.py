"""Exact nearest neighbours of many rows among many rows, by cells around pivots.

A few rows drawn by a hash are pivots (they only steer the search).  Every row belongs to the cell of its nearest pivot, and a cell is cut into blocks
of at most ``BLOCK`` rows by their distance to it.  Queries meet the block of their own cell that lies at their distance, which bounds the distance
of their k-th neighbour; then only those blocks that the triangle inequality cannot rule out.  Queries and rows meet as whole blocks by an
equality join on the block, lists of k are merged, and no row is left out: results are those of comparing with every row.

Rows with equal values count as often as they can matter: the k + 1 of least id, since of equally near rows the least ids are taken.  Squared distances are
compared after rounding to nine digits.
"""

from __future__ import annotations

from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.rng import uniform
from lacuna.sources.stage import materialize

from .ranks import placed

#: Pivots at most; rows and queries that a block holds.
PIVOTS, BLOCK, TOGETHER = 256, 1024, 512
#: Distances this close (rounding of squared ones included) may be ties.
MARGIN = 5e-5


def pivots(among: DataFrame, columns: list[str], seed: int = 97) -> np.ndarray:
    """About the square root of the rows' number of them, at most ``PIVOTS``, and the origin: a bounded table."""
    n = among.count()
    most = min(PIVOTS, int(n**0.5) // 2)
    drawn = among.where(uniform(seed, "id") < most / max(n, 1)).select(*columns).limit(4 * PIVOTS).toPandas().to_numpy(float)
    return np.unique(np.vstack([np.zeros((1, len(columns))), drawn]), axis=0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, one column after another (equal sums whatever the blocks are)."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c : c + 1] - y[None, :, c]) ** 2
    return d


def _with_cell(df: DataFrame, columns: list[str], points) -> DataFrame:
    """df with its cell and the distance to the cell's pivot."""

    def run(frames):
        at = points.value
        for f in frames:
            x = f[columns].to_numpy(float)
            cell, off = np.zeros(len(f), np.int32), np.zeros(len(f))
            for a in range(0, len(f), 2048):
                d = _distances(x[a : a + 2048], at)
                cell[a : a + 2048] = d.argmin(axis=1)
                off[a : a + 2048] = np.sqrt(d.min(axis=1))
            yield f.assign(cell=cell, off=off)

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, cell int, off double")


def _lists(met: DataFrame, columns: list[str], k: int) -> DataFrame:
    """id and the k nearest (d, id, label, value) rows of a block, for each query of blocks that met."""
    kind = "array<struct<d:double,id:long,label:int,value:array<double>>>"

    def run(frames):
        for f in frames:
            ids, out = [], []
            for q, r in zip(f["queries"], f["rows"], strict=True):
                own = np.array([x["id"] for x in q], np.int64)
                x, y = np.array([list(v["value"]) for v in q], float), np.array([list(v["value"]) for v in r], float)
                near, labels = np.array([v["id"] for v in r], np.int64), np.array([v["label"] for v in r], np.int64)
                d = np.round(_distances(x, y), 9)
                d[own[:, None] == near[None, :]] = np.inf
                order = np.argsort(d, axis=1, kind="stable")[:, :k]  # rows of a block come in order of id
                for i, picks in enumerate(order):
                    ids.append(own[i])
                    out.append([{"d": d[i, j], "id": near[j], "label": labels[j], "value": y[j]} for j in picks if d[i, j] < np.inf])
            yield pd.DataFrame({"id": np.array(ids, np.int64), "found": pd.Series(out, dtype=object)})

    return met.mapInPandas(run, f"id long, found {kind}")


def _grouped(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries (id, value, cell, block) in groups of about ``TOGETHER``, joined with the block that they go to."""
    sizes = queries.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups"))
    part = F.pmod(F.xxhash64("id"), F.col("groups"))
    sent = queries.join(sizes, ["cell", "block"]).groupBy("cell", "block", part.alias("part")).agg(F.collect_list(F.struct("id", "value")).alias("queries"))
    return sent.join(blocks.select("cell", "block", "rows"), ["cell", "block"]).select("queries", "rows")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k nearest for each query; of equal distances the least ids."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    return lists.groupBy("id").agg(F.slice(every, 1, k).alias("found"))


def nearest(queries: DataFrame, among: DataFrame, columns: list[str], k: int) -> DataFrame:
    """queries with near_ids, near_labels and near_values of the k nearest rows of ``among`` (not the row itself; of equally near ones the least id).

    Both have id (telling rows apart), label and columns without gaps; fewer than k where there are no more rows.
    """
    value = F.array(*[F.col(c).cast("double") for c in columns])
    asked = materialize(queries.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]))
    held = materialize(among.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]))
    points = pivots(held, columns)
    shared = queries.sparkSession.sparkContext.broadcast(points)
    alike = F.row_number().over(W.partitionBy(*columns).orderBy("id"))  # ended at k + 1 before rows move
    kept = held.withColumn("alike", alike).where(F.col("alike") <= k + 1).drop("alike")
    ranked = placed(_with_cell(kept, columns, shared), ["cell"], ["off", "id"], "place")
    rows = F.sort_array(F.collect_list(F.struct("id", "label", value.alias("value"))))
    blocks = materialize(
        ranked.groupBy("cell", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(F.min("off").alias("low"), F.max("off").alias("high"), F.count(F.lit(1)).alias("n"), rows.alias("rows"))
    )
    outline = blocks.select("cell", "block", "low", "high", "n")
    # cells are at most as many as pivots: their ranges of distances and sizes go to every task
    cells = outline.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas().sort_values("cell")
    ranges = queries.sparkSession.sparkContext.broadcast((cells["cell"].to_numpy(), cells["low"].to_numpy(float), cells["high"].to_numpy(float), cells["n"].to_numpy(float)))
    placed_queries = materialize(_with_cell(asked, columns, shared))

    # first the block of the own cell at the query's distance
    gap = F.greatest(F.col("low") - F.col("off"), F.col("off") - F.col("high"), F.lit(0.0))
    own = placed_queries.join(outline, "cell").groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "block")).alias("best"))
    first = materialize(placed_queries.join(own, "id").select("id", value.alias("value"), "cell", F.col("best.block").alias("block")))
    near = materialize(_merged(_lists(_grouped(first, blocks), columns, k), k))
    bound = F.when(F.size("found") >= k, F.sqrt(F.element_at("found", k)["d"]))
    known = placed_queries.join(near.select("id", bound.alias("bound")), "id", "left").join(first.select("id", F.col("block").alias("met")), "id", "left")

    def candidates(frames):
        at = shared.value
        names, low, high, n = ranges.value
        for f in frames:
            x, got = f[columns].to_numpy(float), []
            for a in range(0, len(f), 1024):
                part = x[a : a + 1024]
                far = np.sqrt(_distances(part, at))
                nearest_pivot = far.min(axis=1, keepdims=True)
                far = far[:, names]
                reach = far + high  # every row of a cell is nearer than this
                order = np.argsort(reach, axis=1)
                enough = (np.cumsum(n[order], axis=1) >= k + 1).argmax(axis=1)
                most = np.where(n.sum() >= k + 1, reach[np.arange(len(part)), order[np.arange(len(part)), enough]], inf)
                told = f["bound"].to_numpy(float)[a : a + 1024]
                limit = np.fmin(most, told)[:, None] + MARGIN
                least = np.maximum(np.maximum(low - far, far - high), (far - nearest_pivot) / 2)
                i, j = np.nonzero(least <= limit)
                got.append(pd.DataFrame({"id": f["id"].to_numpy()[a + i], "cell": names[j], "off": far[i, j], "limit": limit[i, 0], "home": f["cell"].to_numpy()[a + i], "met": f["met"].to_numpy(float)[a + i], "value": list(part[i])}))
            yield pd.concat(got) if got else pd.DataFrame(columns=["id", "cell", "off", "limit", "home", "met", "value"])

    wide = known.mapInPandas(candidates, "id long, cell int, off double, limit double, home int, met double, value array<double>")
    inside = (F.col("low") - F.col("off") <= F.col("limit")) & (F.col("off") - F.col("high") <= F.col("limit"))
    fresh = (F.col("home") != F.col("cell")) | (F.coalesce(F.col("met"), F.lit(-1.0)) != F.col("block"))
    second = materialize(wide.join(outline, "cell").where(inside & fresh).select("id", "value", "cell", "block"))
    more = _lists(_grouped(second, blocks), columns, k)
    found = materialize(_merged(near.unionByName(more), k))
    pick = lambda name: F.transform("found", lambda x: x[name])
    out = queries.join(found.withColumnRenamed("id", "asked_id"), F.col("id") == F.col("asked_id"), "left")
    kind = "array<struct<d:double,id:long,label:int,value:array<double>>>"
    out = out.withColumn("found", F.coalesce(F.col("found"), F.array().cast(kind)))
    return out.select(*queries.columns, pick("id").alias("near_ids"), pick("label").alias("near_labels"), pick("value").alias("near_values"))
