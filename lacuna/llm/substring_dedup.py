"""Substring deduplication: seed and extend over winnowed anchors.

A repeat is a run of at least ``LENGTH`` words that also occurs earlier (in a document of smaller
id, or earlier in the same one).  Winnowing picks from every window of ``LENGTH`` words the
``SEED``-word anchor of smallest hash; equal windows pick equal anchors at equal places, so a join on
anchors finds every repeat.  Neighbouring windows with one anchor form a block.  Seeds are
extended both ways: first by all words of the block at once, which settles blocks that agree with an earlier one
throughout; where the surroundings of an anchor differ (the two ends of a maximal repeat), one block of each kind is extended by every
number of words to the left that leaves ``LENGTH`` words with those to the right, and each extension is looked up.  Overlapping finds
merge into maximal repeats, and their words go.

No group is paired with itself: every step compares with the earliest occurrence only, found by
an aggregation that combines inside tasks.  Sequences are told apart by 128 bits (anchor and extension).

Defined cases: a null or empty text has no words (kept text ''); texts below ``LENGTH`` words lose
nothing; repeated or null ids are put in order first (see ``keyed``), so the second of two equal rows is
the copy; an empty table gives no rows; very long texts are split and put together piece by piece; other columns are kept
by ``filter_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh, keyed, mapped, materialize, parts, table, texts
from ._words import mix, pieces, shifted, word_hashes

LENGTH, SEED = 20, 5
_SPAN = LENGTH - SEED + 1  # anchors in a window
_PLACE = np.uint64((1 << 30) - 1)


def hashed(made: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts end to end: anchors' hashes, windows' hashes, the window starts that lie in one document, offsets."""
    one, sizes = word_hashes().of(made)
    offsets = np.cumsum(sizes) - sizes
    two = mix(one, shifted(one, 1))
    four = mix(two, shifted(two, 2))
    eight = mix(four, shifted(four, 4))
    anchors = mix(four, shifted(one, 4))
    windows = mix(mix(eight, shifted(eight, 8)), shifted(four, 16))
    has = np.maximum(sizes - LENGTH + 1, 0)
    starts = np.repeat(offsets - (np.cumsum(has) - has), has) + np.arange(has.sum())
    return anchors, windows, starts, offsets


def blocks_of(made: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor's hash, hash of the whole reach) of each block."""
    anchors, windows, starts, offsets = hashed(made)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    places = np.arange(len(anchors), dtype=np.uint64)
    low = (anchors & ~_PLACE) | (_PLACE - places)  # of equal hashes the last one wins
    low = np.minimum(low, shifted(low, 1))
    low = np.minimum(low, shifted(low, 2))
    low = np.minimum(low, shifted(low, 4))
    low = np.minimum(low, shifted(low, 8))
    picked = (_PLACE - (low[starts] & _PLACE)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(picked) != 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, end = starts[first], starts[first + count - 1]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    reach = mix(mix(windows[begin], windows[end]), (count * LENGTH + (picked[first] - begin)).astype(np.uint64))
    return owner, begin - offsets[owner], count, anchors[picked[first]], reach


assert _SPAN == 16  # the four doublings above cover 16 anchors


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            owner, start, count, anchor, reach = blocks_of(texts(batch))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner], pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(reach.view(np.int64))],
                names=["key", "start", "windows", "anchor", "reach"],
            )

    return mapped(docs, run, "key long, start int, windows int, anchor long, reach long")


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Extensions of the wanted blocks' anchors: key, start, anchor and the hash of all LENGTH words."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("blocks"))

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            _, windows, _, offsets = hashed(texts(batch))
            blocks = batch.column("blocks").flatten()
            begin, count, anchor = (blocks.field(k).to_numpy() for k in range(3))
            owner = np.repeat(np.arange(batch.num_rows), batch.column("blocks").value_lengths().to_numpy())
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(begin, count) + inside
            owner = np.repeat(owner, count)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner], pa.int64()), pa.array(start, pa.int32()), pa.array(np.repeat(anchor, count)), pa.array(windows[start + offsets[owner]].view(np.int64))],
                names=["key", "start", "anchor", "window"],
            )

    return mapped(docs.join(lists, "key").select("key", "text", "blocks"), run, "key long, start int, anchor long, window long")


def repeats(docs: DataFrame) -> DataFrame:
    """key, spans (packed start * 64 + words) of runs that occur earlier; docs has (key, text)."""
    blocks = _blocks(docs)
    # tables of keys are written before they are joined: a join of two plain tables can split the rows of one hot key
    often = materialize(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    seeds = materialize(blocks.join(often, "anchor", "left_semi"))
    place, kind = F.struct("key", "start"), ["anchor", "reach", "windows"]
    kinds = materialize(seeds.groupBy(*kind).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    whole = (
        seeds.join(kinds.where("n > 1").select(*kind, "first"), kind)
        .where(place > F.col("first"))
        .select("key", (F.col("start").cast("long") * 64 + F.col("windows") + LENGTH - 1).alias("span"))
    )
    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"))
    edges = kinds.join(several, "anchor", "left_semi").select("first.key", "first.start", "windows", "anchor")
    windows = materialize(_windows(docs, edges))
    same = ["anchor", "window"]
    first = materialize(windows.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, "first"))
    single = (
        windows.join(first, same).where(place > F.col("first"))
        .select("key", (F.col("start").cast("long") * 64 + LENGTH).alias("span"))
    )
    return whole.unionByName(single).groupBy("key").agg(F.collect_list("span").alias("spans"))


def kept_words(text: bytes, spans: list[int] | None) -> Iterator[tuple[int, list[bytes]]]:
    """(words, those that no span covers) of a text, piece by piece."""
    gone = np.zeros(0, bool)
    if spans:
        packed = np.array(spans, np.int64)
        start, end = packed >> 6, (packed >> 6) + (packed & 63)
        size = int(end.max()) + 1
        gone = np.cumsum(np.bincount(start, minlength=size) - np.bincount(end, minlength=size)) > 0
    at = 0
    for piece in pieces(text):
        words = piece.split()
        own = gone[at : at + len(words)]
        at += len(words)
        kept = [w for w, g in zip(words, own.tolist(), strict=False) if not g] + words[len(own) :] if own.any() else words
        yield len(words), kept


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "key")
    found = repeats(rows.select("key", "text"))

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            out: list[list] = [[], [], []]
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                sha, words, left = hashlib.sha256(), 0, 0
                for n, kept in kept_words(text, spans):
                    if kept:
                        sha.update(b" " * (left > 0) + b" ".join(kept))
                    words, left = words + n, left + len(kept)
                for column, value in zip(out, (words, words - left, sha.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = rows.join(found, "key", "left").select("doc_id", "text", "spans")
    return mapped(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def filter_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs taken out of text (words then joined by single spaces) and all other columns as they were.

    Texts without a repeat stay as they are, unknown ones too; where n_chars is a column, it follows the new text.
    """
    key, spans = fresh(docs, "row_key"), fresh(docs, "repeat_spans")
    rows = keyed(docs, key)
    found = repeats(rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")))
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    joined = rows.join(found, key, "left")
    names = [c.lower() for c in joined.columns]
    at, spans_at, chars_at = names.index("text"), names.index(spans.lower()), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, at)):
            made, chars = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                if own and text:
                    text = b" ".join(b" ".join(kept) for _, kept in kept_words(text.encode(), own) if kept).decode()
                made.append(text)
                chars.append(None if text is None else len(text))
            columns = list(batch.columns)
            columns[at] = pa.array(made, columns[at].type)
            if chars_at is not None and pa.types.is_integer(columns[chars_at].type):
                changed = pa.array([bool(x) for x in batch.column(spans_at).to_pylist()])
                columns[chars_at] = pa.compute.if_else(changed, pa.array(chars, columns[chars_at].type), columns[chars_at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = mapped(joined, run, joined.schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
