"""Near-duplicate documents: MinHash bands, odd sketches, confirmation on full sets, components.

A document is the set of its distinct five-word shingles (A-Z lower-cased; all its words as one
shingle where it has fewer than five).  Documents of one set form a class.  Each class has ``samples``
MinHash values, in bands; classes that agree in a band are candidates.  An odd sketch (the parity of how often
each bit is hit by the samples) estimates similarity from the population count of an XOR, and discards
candidates that are far below the threshold.  A second odd sketch, of the whole set, bounds similarity from above without a
chance to miss: a pair cannot differ in more of its bits than in elements.  What passes both is confirmed on full sets.

Buckets are not paired with themselves.  First each member meets the bucket's least class and its
neighbours in three orders (by size, and by the keys of other bands, so that neighbours agree in several);
confirmed links give components.  Then only members of different components are left to compare.  In buckets of up to
``SMALL_BUCKET`` members, those outside the component that holds most of the bucket meet the others.  Larger buckets are
split by the rarest elements of their sets: in an order of elements that all sets share, two sets of n and m elements with o in common
have one in common among the first n - o + 1 and m - o + 1, where similarity t needs o = t (n + m) / (1 + t); the order puts
elements first that few members have, so documents of one template, which share only common elements, do not meet at all.  No
link between different components is lost either way.

Defined cases: a text without words has an empty set, is linked with nothing and kept; repeated or null
ids are told apart by order (see ``keyed``), and one row of each group is kept; an empty table gives no rows; other columns
are kept by ``filter_documents``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh, keyed, mapped, materialize, parts, slices, table, texts
from ._words import mix, shifted, word_hashes

WORDS = 5
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
#: Bits of the odd sketch of a whole set, which only candidates have.
WHOLE_LONGS = 16
WHOLE_BITS = 64 * WHOLE_LONGS
#: Values in a band; the number of bands follows from the chance to miss a pair at the threshold.
ROWS, MISS = 5, 1e-6
#: Deviations of the estimate by which a candidate may lie below the threshold and still be confirmed.
DEVIATIONS = 6.0
#: Members up to which a bucket's members meet one another; larger ones are split by rare elements.
SMALL_BUCKET = 64
#: Slots of the table of frequencies that orders elements, and the part of the members that it is counted on.
SLOTS, COUNTED_ONE_IN = 1 << 20, 4


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def most_different(threshold: float, samples: int) -> int:
    """Bits in which the odd sketches of a pair may differ if its similarity can be the threshold."""
    low = max(0.0, threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / samples))
    toggles = 2 * samples * (1 - low)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** toggles) + 3 * math.sqrt(SKETCH_BITS) / 4)


def shingle_sets(made: list[bytes]) -> list[np.ndarray]:
    """For each (lower-cased) text the hashes of its distinct shingles, in order."""
    one, sizes = word_hashes().of(made)
    two = mix(one, shifted(one, 1))
    five = mix(mix(two, shifted(two, 2)), shifted(one, 4))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WORDS:
            out.append(np.unique(five[at : at + n - WORDS + 1]))
        elif n:
            whole = np.uint64([n])
            for h in one[at : at + n]:
                whole = mix(whole, np.array([h]))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_slices(batches):
    """(keys, sets) of a few rows at a time, so that a task holds the sets of about SLICE_BYTES of text only."""
    for batch in batches:
        for part in parts(batch):
            yield part.column("key"), shingle_sets([x.lower() for x in texts(part)])


class Samples:
    """MinHash values of a set, their bands and their odd sketch."""

    def __init__(self, bands: int):
        self.bands, n = bands, bands * ROWS
        self.factors = np.random.default_rng(20240607).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.names = np.arange(n, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[i : i + 2048] * self.factors[:, None]).min(axis=1), out=least)
        parts = least.reshape(self.bands, ROWS)
        key = self.names[: self.bands]
        for k in range(ROWS):
            key = mix(key, parts[:, k])
        bits = (mix(self.names, least) >> np.uint64(17)) % np.uint64(SKETCH_BITS)
        odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
        return key, np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signatures(rows: DataFrame, threshold: float) -> DataFrame:
    """key, n_shingles, digest of the set (two longs), bands and odd sketch; rows has (key, text)."""
    bands = bands_for(threshold)

    def run(batches):
        draw = Samples(bands)
        for key, sets in set_slices(batches):
            digests = [np.frombuffer(hashlib.md5(s.tobytes()).digest(), np.int64) for s in sets]
            drawn = [draw(s) if len(s) else (None, None) for s in sets]
            keys = pa.array([None if d[0] is None else d[0].view(np.int64) for d in drawn], pa.list_(pa.int64()))
            odd = pa.array([None if d[1] is None else d[1].tobytes() for d in drawn], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [key, pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), keys, odd],
                names=["key", "n_shingles", "d0", "d1", "bands", "odd"],
            )

    return mapped(rows, run, "key long, n_shingles long, d0 long, d1 long, bands array<long>, odd binary")


def differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Bits in which two columns of sketches (equally long byte strings) differ."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def possible(pairs: DataFrame, sketches: DataFrame, threshold: float, samples: int) -> DataFrame:
    """The pairs (a, b) whose sizes and odd sketches allow the threshold.

    The sketch of samples estimates, with ``DEVIATIONS`` to spare; the sketch of the whole set bounds: of n elements in
    both sets at most n (1 - t) / (1 + t) may differ.
    """
    percent, most = round(100 * threshold), most_different(threshold, samples)
    for k in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"odd{k}"), F.col("whole").alias(f"whole{k}")), k)
        if k == "b":
            pairs = pairs.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column
            total = c("na").to_numpy() + c("nb").to_numpy()
            near = differing(c("odda"), c("oddb")) <= most
            near &= (100 + percent) * differing(c("wholea"), c("wholeb")) <= (100 - percent) * total
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return mapped(pairs, run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return counted.where(100 * F.col("common") >= round(100 * threshold) * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links reach, for each node of a link.

    Rounds of least label among neighbours and label of the label; each round is written, so a lost executor
    repeats one round at most, and the rounds grow with the logarithm of a component's diameter.
    """
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")))
    labels = materialize(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = materialize(lower.join(far, "low", "left").select("node", F.coalesce(F.least("low", "far"), "low").alias("new"), "label"))
        done = after.where("new < label").limit(1).count() == 0
        labels = after.select("node", F.col("new").alias("label"))
        if done:
            return labels


def neighbours(buckets: DataFrame, order: list[str]) -> DataFrame:
    """Pairs (a, b), a < b, of members that follow one another in a bucket in the given order.

    Rows are dealt by ranges of (band, order), so a large bucket is spread over tasks; at the ends of ranges a pair may be missing.
    """

    def run(batches):
        band, node = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bands, nodes = batch.column("band").to_numpy(), batch.column("node").to_numpy()
            before_band = np.concatenate([[bands[0] if band is None else band], bands[:-1]])
            before = np.concatenate([[nodes[0] if node is None else node], nodes[:-1]])
            met = (bands == before_band) & (nodes != before)
            band, node = bands[-1], nodes[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(before, nodes)[met]), pa.array(np.maximum(before, nodes)[met])], names=["a", "b"])

    by = list(dict.fromkeys(["band", *order]))
    return mapped(buckets.select(*dict.fromkeys([*by, "node"])).repartitionByRange(*by).sortWithinPartitions(*by), run, "a long, b long")


def frequencies(members: DataFrame) -> np.ndarray:
    """How often the elements of each slot occur in the sets of a part of ``members`` (one byte a slot, in steps of a fourth root of two).

    A table of fixed size: where many elements share a slot they are only told apart less well, which costs time and no pairs.
    """

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            made = batch.column("shingles").flatten().to_numpy().view(np.uint64)
            total += np.bincount((made % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    part = members.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED_ONE_IN)) == 0)
    got = mapped(part.select("shingles"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.minimum(np.round(4 * np.log2(out + 1)), 255).astype(np.uint8)


def sharing_rare(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members (node, label) of different labels that have one of their rarest elements in common; see the module's text."""
    own = members.select("node").distinct().join(sets.select("node", "shingles"), "node")
    own = materialize(own.join(members.select("node", "label").distinct(), "node"))
    order = own.sparkSession.sparkContext.broadcast(frequencies(own))

    percent = round(100 * threshold)

    def run(batches):
        for batch in batches:
            lengths = batch.column("shingles").value_lengths().to_numpy()
            for a, b in slices((8 * lengths).tolist()):
                part = batch.slice(a, b - a)
                node, label, lists = part.column("node").to_numpy(), part.column("label").to_numpy(), part.column("shingles")
                out, place = [], []
                for i, n in enumerate(lengths[a:b].tolist()):
                    own = lists[i].values.to_numpy().view(np.uint64)
                    first = n + percent * n // -100 + 1
                    out.append(own[np.lexsort((own, order.value[(own % np.uint64(SLOTS)).astype(np.int64)]))[:first]])
                    place.append(np.arange(first))
                size = [len(x) for x in out]
                columns = [np.concatenate(out).view(np.int64), np.repeat(node, size), np.repeat(label, size), np.repeat(lengths[a:b].astype(np.int64), size), np.concatenate(place)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["element", "node", "label", "n", "place"])

    first = mapped(own, run, "element long, node long, label long, n long, place long")
    # an element of one label alone brings nothing together
    several = first.groupBy("element").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("element")
    rare = materialize(first.join(materialize(several), "element", "left_semi"))
    # two sets of sizes n and m with at least o elements in common share one of the first n - o + 1 and m - o + 1
    x, y = rare.where(f"place <= n - ceil({2 * percent} * n / {100 + percent}.0)").alias("x"), rare.alias("y")
    smaller = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    common = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / float(100 + percent))
    early = (F.col("x.place") <= F.col("x.n") - common) & (F.col("y.place") <= F.col("y.n") - common)
    met = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.label") != F.col("y.label")) & smaller & early)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members: key, n_shingles, node; labels: node, label) where node is the least key with the same set.

    Nodes without a label are components of their own; rows has (key, text).
    """
    samples = bands_for(threshold) * ROWS
    signed = materialize(signatures(rows, threshold))
    same = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"))
    # written first: the join below can then split the copies of one set
    copies = materialize(same.where("copies > 1").select("d0", "d1", "node"))
    members = materialize(
        signed.select("key", "n_shingles", "d0", "d1").join(copies, ["d0", "d1"], "left").select("key", "n_shingles", F.coalesce("node", "key").alias("node"))
    )
    lead = signed.where("n_shingles > 0").join(members.where("key != node").select("key"), "key", "left_anti")
    nodes = lead.select(F.col("key").alias("node"), F.col("n_shingles").alias("n"), "odd", "bands")
    # the keys of two other bands stand beside each band's, to order its bucket by
    count = bands_for(threshold)
    other = lambda by: F.col("bands")[(F.col("at") + by) % count]
    banded = nodes.select("node", "n", "bands", F.posexplode("bands").alias("at", "band")).select("node", "n", "band", other(1).alias("next"), other(count // 2).alias("far"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    buckets = materialize(banded.join(materialize(shared), "band").select("band", "node", "n", "size", "least", "next", "far"))
    used = materialize(buckets.select("node").distinct())
    texts_used = rows.join(used.select(F.col("node").alias("key")), "key", "left_semi").select("key", "text")
    sets = materialize(_sets(texts_used))
    sketches = materialize(nodes.select("node", "n", "odd").join(sets.select("node", "whole"), "node"))

    first = buckets.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    for order in (["n", "node"], ["next", "far", "node"], ["far", "next", "node"]):
        first = first.unionByName(neighbours(buckets, order))
    first = materialize(first.distinct())
    links = materialize(confirmed(possible(first, sketches, threshold, samples), sets, threshold))
    labels = components(links)

    # what is left: members of different components in one bucket
    full = materialize(buckets.select("band", "size", "node").join(labels, "node", "left").select("band", "size", "node", F.coalesce("label", "node").alias("label")))
    sizes = full.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    full = materialize(full.join(materialize(most.select("band", "most")), "band"))
    small, large = full.where(F.col("size") <= SMALL_BUCKET), full.where(F.col("size") > SMALL_BUCKET)
    x, y = small.where("label != most").alias("x"), small.alias("y")
    once = (F.col("y.label") == F.col("x.most")) | (F.col("x.label") < F.col("y.label"))
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & once)
    pairs = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    if large.limit(1).count():
        pairs = pairs.unionByName(sharing_rare(large, sets, threshold))
    pairs = pairs.distinct().join(first, ["a", "b"], "left_anti")
    more = materialize(confirmed(possible(pairs, sketches, threshold, samples), sets, threshold))
    if more.limit(1).count():
        labels = components(links.union(more))
    return members, labels


def parity(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of a whole set: how often each of WHOLE_BITS is hit, modulo two."""
    bits = (shingles >> np.uint64(23)) % np.uint64(WHOLE_BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=WHOLE_BITS) & 1).astype(np.uint8)).view(np.int64)


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches):
        for key, sets in set_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [key, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s).tobytes() for s in sets], pa.binary())],
                names=["node", "shingles", "whole"],
            )

    return mapped(rows, run, "node long, shingles array<long>, whole binary")


def grouped(rows: DataFrame, threshold: float) -> DataFrame:
    """key, n_shingles, component (the least key of the group) for each row of (key, text)."""
    members, labels = classes(rows, threshold)
    return members.join(labels, "node", "left").select("key", "n_shingles", F.coalesce("label", "node").alias("component"))


def score(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "key")
    out = grouped(rows.select("key", "text"), threshold)
    ids = rows.select("key", "doc_id")
    named = out.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component", "left")
    return named.select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("component")).alias("kept"))


def filter_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates (the one of least id), with all its columns."""
    key = fresh(docs, "row_key")
    rows = keyed(docs, key)
    out = grouped(rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), threshold)
    gone = out.where("key != component").select(F.col("key").alias(key))
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), 0.85)
