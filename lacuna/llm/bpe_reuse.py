"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks wherever its low bits are zero, so
equal passages fall into equal chunks wherever they stand.  Chunks seen more than once are encoded once
for the whole corpus, into a table by hash.  A chunk's ends may cut a word: the join is repaired by encoding the text around it
anew, from white space inside the part before to white space inside the chunk, one more word of the chunk at a time, until the new
ids end (or begin) with exactly the ids that the chunk's own words have by themselves; from that place on the chunk's stored ids hold.
A chunk whose two joins never agree is encoded as part of its document.  Documents are then put together from stored chunks and
their own parts.

Which chunks are shared is told to the tasks as a Bloom filter.  Its size follows the number of shared chunks up to ``MOST_BITS``;
beyond that the least frequent of them are encoded where they stand, so the filter never fills up.  A false hit only sends a
chunk through the table that did not need to.

Defined cases: a null text is encoded as an empty one; texts with a special token's text are encoded whole by the library;
repeated or null ids are told apart by order (see ``keyed``); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import kept, keyed, mapped, materialize, parts, table, texts
from ._tok import WordEncoder
from ._words import mix

WINDOW, MEAN_CHUNK = 16, 1024
#: Bits of the filter for each shared chunk, its least and greatest size, hashes of a chunk, steps of the histogram of counts to a doubling.
CHUNK_BITS, LEAST_BITS, MOST_BITS, FILTER_HASHES, STEPS = 16, 1 << 16, 1 << 28, 3, 4
#: Words of a chunk that a join may take before the chunk is given up, and characters beside it that are encoded anew.
REPAIR_WORDS, REPAIR_CHARS = 8, 64
#: Joins that a task remembers.
MEMO_JOINS = 50_000
#: White space between words (not a part of any token).
WHITE = " \t\n\r"
_SPACE = re.compile(f"[{WHITE}]")
#: A random value for each byte.
_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    """Content-defined chunks; together they are the text."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) <= WINDOW:
        return [text] if text else []
    h = _GEAR[data]
    factor = 0x01000193
    for by in (1, 2, 4, 8):  # polynomial hash of the 16 bytes that end at each place
        h[by:] = h[by:] + h[:-by] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
    cut = np.flatnonzero(h[WINDOW - 1 :] < np.uint32((1 << 32) // MEAN_CHUNK)) + WINDOW
    if len(data) != len(text):  # from bytes to characters; a cut inside a character moves to its end
        starts = np.cumsum((data & 0xC0) != 0x80)
        cut = np.unique(starts[cut[cut < len(data)] - 1])
    ends = [0, *[int(c) for c in cut if c < len(text)], len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def chunk_hash(chunk: str) -> int:
    return xxhash.xxh64_intdigest(chunk.encode())


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def cut_safely(text: str) -> bool:
    """Whether a text may be encoded in parts: no special token's text."""
    return "<|" not in text


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the filter for each hash (one row each)."""
    k = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64)
    return mix(h.astype(np.uint64)[:, None] + np.zeros_like(k), k[None, :] + np.zeros((len(h), 1), np.uint64)) % np.uint64(bits)


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bloom filter (64-bit words) of the chunks that occur more than once."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            got = [signed(chunk_hash(c)) for t in map(bytes.decode, texts(batch)) if cut_safely(t) for c in chunks(t)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["h"])

    often = materialize(mapped(docs.select("text"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS)
    least, chosen = 2, 0
    for r in often.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("chunks"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        if CHUNK_BITS * (chosen + r["chunks"]) > MOST_BITS and chosen:
            break
        least, chosen = r["least"], chosen + r["chunks"]
    size = min(max(LEAST_BITS, 1 << math.ceil(math.log2(max(CHUNK_BITS * chosen, 1)))), MOST_BITS)

    def bits(batches):
        for batch in batches:
            at = positions(batch.column("h").to_numpy().view(np.uint64), size).ravel()
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    words = mapped(often.where(F.col("n") >= least).select("h"), bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(size // 64, np.uint64)
    made = words.toPandas()  # at most MOST_BITS / 64 rows
    out[made["word"].to_numpy(np.int64)] = made["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def hits(words: np.ndarray, hashes: list[int]) -> np.ndarray:
    at = positions(np.array(hashes, np.uint64), 64 * len(words))
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def n_ids(ids: bytes) -> int:
    return len(ids) // 4


class Joins:
    """Whether texts are encoded alike apart and together; what was asked before is kept (neighbouring shared chunks meet in many documents)."""

    def __init__(self, one: WordEncoder):
        self.one, self.seen = one, {}

    def agree(self, left: str, right: str) -> bool:
        """The library's ids of both together are those of the first, then those of the second one (which has some)."""
        got = self.seen.get((left, right))
        if got is None:
            if len(self.seen) >= MEMO_JOINS:
                self.seen.clear()
            own = self.one.encode(right)
            both = self.one.tokenizer.encode_batch_fast([left + right], add_special_tokens=False)[0].ids
            got = self.seen[left, right] = bool(own) and array("I", both).tobytes() == self.one.encode(left) + own
        return got

    def front(self, text: str, begin: int, start: int, chunk: str) -> int | None:
        """Where a chunk's own ids hold after its start: the first white space up to which encoding anew agrees with the chunk's words."""
        if not start or text[start - 1] in WHITE:
            return 0
        low = max(begin, start - REPAIR_CHARS)
        before = 1 + max(text.rfind(x, low, start) for x in WHITE) or low + 1
        first, tried = _SPACE.search(chunk), 0
        while first and tried < REPAIR_WORDS:
            after = _SPACE.search(chunk, first.end())
            if self.agree(text[before - 1 : start + first.start()], chunk[first.start() : after.start() if after else len(chunk)]):
                return first.start()
            first, tried = after, tried + 1
        return None

    def back(self, text: str, at: int, chunk: str) -> int | None:
        """The same for its end: the last white space from which on the chunk's ids hold no more."""
        if at == len(text) or text[at] in WHITE:
            return len(chunk)
        found = _SPACE.search(text, at, at + REPAIR_CHARS)
        after = found.start() if found else min(at + REPAIR_CHARS, len(text))
        last, tried = max(chunk.rfind(x) for x in WHITE), 0
        while last >= 0 and tried < REPAIR_WORDS:
            before = max(max(chunk.rfind(x, 0, last) for x in WHITE), 0)
            if self.agree(chunk[before:last], chunk[last:] + text[at:after]):
                return last
            last, tried = (before if chunk[before] in WHITE else -1), tried + 1
        return None


class Plan:
    """The parts of one text, in order: bytes of ids that are made here, or (hash, ids to drop at the front, at the end)."""

    def __init__(self, text: str, words: np.ndarray, one: WordEncoder, joins: Joins):
        self.parts: list = []
        own = chunks(text) if cut_safely(text) else []
        shared = hits(words, [chunk_hash(c) for c in own]) if own else []
        done = at = 0
        for chunk, is_shared in zip(own, shared, strict=True):
            start, at = at, at + len(chunk)
            if not is_shared:
                continue
            first = joins.front(text, done, start, chunk)
            last = None if first is None else joins.back(text, at, chunk)
            if first is None or last is None or first >= last:
                continue
            self.own(text[done : start + first], one)
            self.parts.append((chunk_hash(chunk), n_ids(one.encode(chunk[:first])), n_ids(one.encode(chunk[last:]))))
            done = start + last
        self.own(text[done:], one)

    def own(self, text: str, one: WordEncoder) -> None:
        if text and (ids := one.encode(text)):
            self.parts.append(ids)

    @property
    def whole(self) -> bytes | None:
        """All ids, where no stored chunk is needed."""
        return None if any(isinstance(p, tuple) for p in self.parts) else b"".join(self.parts)


class Decoder:
    """What the library's decode gives: tokens joined by spaces (the file states no decoder)."""

    def __init__(self, one: WordEncoder):
        names = one.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.tokens[i] = name
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        made = np.frombuffer(ids, "<u4").tolist()
        text = " ".join(map(self.tokens.__getitem__, made))
        return len(made), hashlib.sha256(" ".join(map(self.decimal.__getitem__, made)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def tools(path: str) -> tuple[WordEncoder, Decoder]:
    """Encoder and decoder of a Python worker, kept between the tasks of this operator."""

    def make():
        one = WordEncoder(path)
        return one, Decoder(one)

    return kept(("bpe", path), make)


_PARTS = "key long, part int, h long, front int, back int, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string())
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _short(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _long(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row of (key, text)."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))

    def plans(batches):
        one, names = tools(path)
        joins = Joins(one)
        for batch in (part for whole in batches for part in parts(whole)):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
                plan = Plan(text.decode(), shared.value, one, joins)
                if (ids := plan.whole) is not None:
                    rows.append((key, None, None, None, None, None, *names.digests(ids)))
                    continue
                for i, p in enumerate(plan.parts):
                    rows.append((key, i, *((signed(p[0]), p[1], p[2], None) if isinstance(p, tuple) else (None, None, None, _short(p))), None, None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    def found(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            seen: dict[int, str] = {}
            for text in texts(batch):
                if cut_safely(text := text.decode()) and (own := chunks(text)):
                    hashes = [chunk_hash(c) for c in own]
                    seen.update((h, c) for h, c, hit in zip(hashes, own, hits(shared.value, hashes), strict=True) if hit)
            yield pa.RecordBatch.from_arrays([pa.array(map(signed, seen), pa.int64()), pa.array(seen.values(), pa.string())], names=["h", "chunk"])

    def once(batches):
        one, _ = tools(path)
        for batch in batches:
            made = [_short(one.encode(c)) for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(made, pa.binary())], names=["h", "stored"])

    def joined(batches):
        _, names = tools(path)
        key, own = None, []

        def flush(rows):
            if key is not None:
                rows.append((key, *names.digests(_long(b"".join(own)))))

        for batch in batches:
            rows: list = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    flush(rows)
                    key, own = k, []
                own.append(ids)
            yield _result(rows)
        rows = []
        flush(rows)
        yield _result(rows)

    planned = materialize(mapped(docs.select("key", "text"), plans, _PARTS))
    distinct = mapped(docs.select("text"), found, "h long, chunk string").groupBy("h").agg(F.first("chunk").alias("chunk"))
    stored = materialize(mapped(distinct, once, "h long, stored binary"))
    holes = planned.where("h is not null").join(stored, "h", "left").select(
        "key", "part", F.expr("substring(stored, 2 * front + 1, length(stored) - 2 * front - 2 * back)").alias("ids")
    )
    pieces = planned.where("ids is not null").select("key", "part", "ids").unionByName(holes)
    whole = mapped(pieces.repartition("key").sortWithinPartitions("key", "part"), joined, _RESULT)
    return planned.where("n_tokens is not null").select("key", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(whole)


_RESULT = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])


def op9_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keyed(docs, "key")
    out = encode(rows.select("key", "text"))
    return rows.select("key", "doc_id").join(out, "key").drop("key")
