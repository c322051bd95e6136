"""Hidden Markov language model.

Tokens are words (A-Z lower-cased) and one end for each text.  The ``FREQUENT`` commonest tokens are
emission classes of their own; every other word belongs to one of ``SUFFIXES`` classes by its last bytes.
Latent states emit classes; a word within its class has probability (c + 1) / (N_class + V_class + 1), the last unit being
left for words not seen.  So probabilities add up to one over words (with one place for all unseen
words of a class), and the word counts come from every training text, however many there are.

Baum-Welch: each iteration runs scaled forward-backward over all training texts inside the tasks, and expected counts are summed
across partitions (states x classes and states x states numbers: a fixed size).  Long texts are worked on in segments of
``SEGMENT`` tokens side by side: products of the steps' matrices carry the forward and backward values from segment to segment, so the
counts are those of whole texts.  It starts from a chain fitted to the counts of all pairs of neighbouring classes in all training texts
(each text's first class follows a class ``BEGIN`` of its own): at most (classes + 1) x classes numbers, a row for each first class, on
which every step of expectation and maximization is a job, too.  Nothing is drawn.  Scoring runs the scaled forward recursion over every whole
text: the exact likelihood of its classes, plus the words' shares of their classes.

Counts of the commonest words (at most ``KNOWN``, from a threshold that a histogram of the counts gives) are broadcast; other words
are joined with the counts by hash, and only sums by text come back.

Defined cases: a null or empty text is its end token alone; with no training text every token has the
probability that an empty count gives; repeated or null ids are told apart by order (see ``keyed``); an empty
table gives no rows; other columns are ignored.  Words are told apart by 54 hash bits within their class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import held_out, kept, keyed, mapped, materialize, parts, slices, table, texts
from ._words import WordHashes

STATES, FREQUENT, SUFFIX_BITS, SUFFIX_BYTES = 8, 2048, 10, 3
SUFFIXES = 1 << SUFFIX_BITS
CLASSES = FREQUENT + SUFFIXES
#: Words whose counts every task holds, and steps of the histogram of counts to a doubling.
KNOWN, STEPS = 1 << 18, 16
#: What stands before a text's first class.
BEGIN = CLASSES
#: Iterations over all training texts; iterations of the start over their counts of pairs.
ITERATIONS, START_ITERATIONS = 2, 60
EMIT_PRIOR, MOVE_PRIOR = 0.05, 1.0
#: Bytes of text, and of classes (two bytes a token), that are worked on together.
_SLICE, _CLASS_SLICE = 1 << 22, 1 << 20
#: Tasks that a table of pairs is divided into, and rows of it that are worked on together.
_PAIR_TASKS, _PAIR_ROWS = 8, 256
#: Tokens of a segment.
SEGMENT = 1024
_LOW = np.uint64(SUFFIXES - 1)


def word_code(word: bytes) -> int:
    """54 hash bits of a word, then its suffix class; the end token is the empty word."""
    return xxhash.xxh64_intdigest(word) & ~(SUFFIXES - 1) | xxhash.xxh32_intdigest(word[-SUFFIX_BYTES:]) & (SUFFIXES - 1)


def coded(made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens end to end, and the number of tokens of each text."""
    codes, sizes = kept("word codes", lambda: WordHashes(word_code)).of([x.lower() for x in made])
    return np.insert(codes, np.cumsum(sizes), np.uint64(word_code(b""))), sizes + 1


class Counts:
    """Counts of the commonest words, and totals of every suffix class and of everything."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, total: int, kinds: int, class_total: np.ndarray, class_kinds: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]
        self.classes = np.full(len(codes), -1, np.int64)  # the own class of a frequent word
        rank = np.lexsort((codes, -counts))[:FREQUENT]
        self.classes[np.searchsorted(self.codes, codes[rank])] = np.arange(len(rank))
        self.total, self.kinds = total, kinds
        own = self.classes >= 0
        low = (self.codes[own] & _LOW).astype(np.int64)
        # words with a class of their own do not count in their suffix's class
        self.class_total = class_total - np.bincount(low, self.counts[own], SUFFIXES)
        self.class_kinds = class_kinds - np.bincount(low, minlength=SUFFIXES)
        self.class_log = np.log10(self.class_total + self.class_kinds + 1)

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(emission class, count or -1 where the table lacks the word) of each code."""
        low = (codes & _LOW).astype(np.int64) + FREQUENT
        if not len(self.codes):
            return low, np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        own = np.where(hit, self.classes[at], -1)
        return np.where(own >= 0, own, low), np.where(hit, self.counts[at], -1)


class Chain:
    """Start, moves and emissions of the latent states."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits

    @classmethod
    def first(cls, unigram: np.ndarray) -> Chain:
        """States that differ by chance around the classes' frequencies (always the same chance)."""
        chance = np.random.default_rng(7).gamma(1.0, 1.0, (STATES, len(unigram)))
        moves = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        emits = (unigram + 1e-9)[None, :] * (0.2 + chance)
        return cls(np.full(STATES, 1 / STATES), moves, emits / emits.sum(1, keepdims=True))

    @classmethod
    def learnt(cls, start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Chain:
        start, moves, emits = start + MOVE_PRIOR, moves + MOVE_PRIOR, emits + EMIT_PRIOR
        return cls(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))

    @staticmethod
    def _steps(sizes: np.ndarray):
        """Sequences in order of length, and for each step the first of them that is still going on."""
        order = np.argsort(sizes, kind="stable")
        long = sizes[order]
        return order, np.searchsorted(long, np.arange(long[-1] if len(long) else 0), side="right")

    def log_likelihood(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each class sequence (scaled forward recursion over all of it)."""
        by_class = np.ascontiguousarray(self.emits.T)
        order, going = self._steps(sizes)
        at = (np.cumsum(sizes) - sizes)[order]
        total, alpha = np.zeros(len(sizes)), np.broadcast_to(self.start, (len(sizes), STATES))
        was = 0
        for t, k in enumerate(going):
            alpha = (alpha if not t else alpha[k - was :] @ self.moves) * by_class[classes[at[k:] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[k:] += np.log(scale)
            was = k
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def expected(self, classes: np.ndarray, sizes: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (forward-backward) over all sequences.

        A sequence that goes on from another one has the forward values of that one's last token in ``enter`` (else NaN), and one that is
        continued the backward values of its last token in ``leave``, up to a factor (else ones).
        """
        start, moves = np.zeros(STATES), np.zeros((STATES, STATES))
        by_class = np.ascontiguousarray(self.emits.T)
        order, going = self._steps(sizes)
        at = (np.cumsum(sizes) - sizes)[order]
        before = np.broadcast_to(self.start, (len(sizes), STATES))
        goes_on = np.zeros(len(sizes), bool)
        if enter is not None:
            enter = enter[order]
            goes_on = ~np.isnan(enter[:, 0])
            before = np.where(goes_on[:, None], enter @ self.moves, before)
        ends = np.ones((len(sizes), STATES)) if leave is None else leave[order]
        alphas, scaled, alpha, was = [], [], before, 0
        for t, k in enumerate(going):
            emit = by_class[classes[at[k:] + t]]
            alpha = (alpha[k:] if not t else alpha[k - was :] @ self.moves) * emit
            scale = alpha.sum(1)[:, None]
            alpha = alpha / scale
            alphas.append(alpha)
            scaled.append(emit / scale)
            was = k
        weight = np.empty((len(classes), STATES))
        back, last = np.ones((0, STATES)), self.moves.T
        for t in range(len(going) - 1, -1, -1):
            k = going[t]
            beta = np.empty((len(sizes) - k, STATES))
            done = len(beta) - len(back)  # sequences whose last step this is
            beta[:done] = ends[k : k + done] / (alphas[t][:done] * ends[k : k + done]).sum(1)[:, None]
            if len(back):
                ahead = scaled[t + 1] * back
                moves += alphas[t][done:].T @ ahead
                beta[done:] = ahead @ last
            weight[at[k:] + t] = alphas[t] * beta
            back = beta
        if len(going):
            first = weight[at[going[0] :]]
            on = goes_on[going[0] :]
            start += first[~on].sum(0)
            if on.any():
                moves += enter[going[0] :][on].T @ (scaled[0] * back)[on]
        emits = np.stack([np.bincount(classes, weight[:, j], self.emits.shape[1]) for j in range(STATES)])
        return start, moves * self.moves, emits

    def products(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each sequence the product of its steps' matrices (moves, then emission), each up to a factor."""
        by_class = np.ascontiguousarray(self.emits.T)
        order, going = self._steps(sizes)
        at = (np.cumsum(sizes) - sizes)[order]
        made = np.broadcast_to(np.eye(STATES), (len(sizes), STATES, STATES)).copy()
        for t, k in enumerate(going):
            step = (made[k:].reshape(-1, STATES) @ self.moves).reshape(-1, STATES, STATES) * by_class[classes[at[k:] + t]][:, None, :]
            made[k:] = step / step.sum((1, 2), keepdims=True) if t % 4 == 3 else step
        out = np.empty_like(made)
        out[order] = made / made.sum((1, 2), keepdims=True)
        return out

    def expected_of_texts(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for whole texts of any length, in segments."""
        owner, length = segments(sizes)
        if len(length) == len(sizes):
            return self.expected(classes, sizes)
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        long = np.bincount(owner)[owner] > 1
        begin = np.cumsum(length) - length
        enter, leave = np.full((len(length), STATES), np.nan), np.ones((len(length), STATES))
        rows = np.flatnonzero(long)
        inside = np.concatenate([np.arange(begin[i], begin[i] + length[i]) for i in rows])
        steps = np.zeros((len(length), STATES, STATES))
        steps[rows] = self.products(classes[inside], length[rows])
        number = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]  # of a segment in its text
        # a text's first step starts from ``start``: as a row before its matrix that the moves turn into start
        by_class = self.emits.T
        value = np.full((len(length), STATES), np.nan)
        heads = np.flatnonzero(first & long)
        value[heads] = self._through(classes, begin[heads], length[heads], by_class)
        for j in range(1, int(number.max()) + 1):
            now = np.flatnonzero(number == j)
            enter[now] = value[now - 1]
            out = np.einsum("si,sij->sj", value[now - 1], steps[now])
            value[now] = out / out.sum(1, keepdims=True)
        for j in range(int(number.max()), 0, -1):
            now = np.flatnonzero(number == j)
            out = np.einsum("sij,sj->si", steps[now], leave[now])
            leave[now - 1] = out / out.sum(1, keepdims=True)
        sums = None
        for a, b in slices((2 * length).tolist(), _CLASS_SLICE):  # segments are independent now
            got = self.expected(classes[begin[a] : begin[b - 1] + length[b - 1]], length[a:b], enter[a:b], leave[a:b])
            sums = got if sums is None else tuple(x + y for x, y in zip(sums, got, strict=True))
        return sums

    def _through(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, by_class: np.ndarray) -> np.ndarray:
        """Forward values after the first segments of long texts (all of SEGMENT tokens)."""
        alpha = np.broadcast_to(self.start, (len(begin), STATES)) * by_class[classes[begin]]
        for t in range(1, int(length.max())):
            alpha = (alpha / alpha.sum(1, keepdims=True)) @ self.moves * by_class[classes[begin + t]]
        return alpha / alpha.sum(1, keepdims=True)


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of the segments of texts of these sizes, in order; at most SEGMENT tokens each."""
    count = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), count)
    length = np.full(len(owner), SEGMENT, np.int64)
    length[np.cumsum(count) - 1] = sizes - (count - 1) * SEGMENT
    return owner, length


def training_counts(train: DataFrame) -> tuple[DataFrame, Counts]:
    """All words of the training texts with their counts (a table), and what tasks hold of it."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, limit=_SLICE)):
            codes, n = np.unique(coded(texts(batch))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["code", "c"])

    vocabulary = materialize(mapped(train.select("text"), run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))
    low = F.col("code").bitwiseAND(F.lit(SUFFIXES - 1))
    by_class = vocabulary.groupBy(low.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    # the least count of a word that tasks hold: a few hundred steps of counts tell how many words lie above each
    step = F.floor(F.log2(F.col("c").cast("double")) * STEPS)
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, words = (1 << 62), 0
    for r in steps:
        words += r["words"]
        if words > KNOWN:
            break
        least = r["least"]
    top = vocabulary.where(F.col("c") >= least).toPandas()  # at most KNOWN rows
    n, v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    n[by_class["k"].to_numpy(np.int64)], v[by_class["k"].to_numpy(np.int64)] = by_class["n"], by_class["v"]
    codes, counts = top["code"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    return vocabulary, Counts(codes, counts, int(n.sum()), int(v.sum()), n, v)


_CODED = "key long, learn boolean, n_tokens long, n_known long, base_sum double, inside double, loose binary, classes binary"


def coded_texts(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each text (key, text, learn) as the classes of its tokens, with the sums that the counts give; words are hashed once for all that follows."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, limit=_SLICE)):
            codes, sizes = coded(texts(batch))
            kinds, n = shared.value.look(codes)
            at = np.cumsum(sizes) - sizes
            log = np.where(n >= 0, np.log10(np.maximum(n, 0) + 1.0), 0.0)
            inside = np.where(kinds >= FREQUENT, log - shared.value.class_log[np.maximum(kinds - FREQUENT, 0)], 0.0)
            lacks = n < 0  # words that the table lacks, text after text
            ends = np.cumsum(np.add.reduceat(lacks.astype(np.int64), at)).tolist()
            data, classes, upto = codes[lacks].tobytes(), kinds.astype("<i2").tobytes(), (2 * np.cumsum(sizes)).tolist()
            loose = [data[8 * i : 8 * j] for i, j in zip([0, *ends], ends, strict=False)]
            add = lambda x, at=at: pa.array(np.add.reduceat(x, at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("learn"), pa.array(sizes), add((n > 0).astype(np.int64)), add(log), add(inside), pa.array(loose, pa.binary()),
                 pa.array([classes[i:j] for i, j in zip([0, *upto], upto, strict=False)], pa.binary())],
                names=[x.split()[0] for x in _CODED.split(", ")],
            )

    return materialize(mapped(docs.select("key", "learn", "text"), run, _CODED))


def sequences(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(lists), "<i2").astype(np.int64), np.array([len(x) // 2 for x in lists], np.int64)


def by_length(batch: pa.RecordBatch) -> tuple[list[int], list[tuple[int, int]]]:
    """Rows of a batch in order of length, and slices of that order: sequences that are worked on together are of about one length."""
    sizes = batch.column("classes").to_pylist()
    order = sorted(range(len(sizes)), key=lambda i: len(sizes[i]))
    return order, list(slices([len(sizes[i]) for i in order], _CLASS_SLICE))


def pair_counts(train: DataFrame) -> DataFrame:
    """For each class (and BEGIN) the classes that follow it in the texts, with their numbers: (a, next: [(b, n)])."""

    def run(batches):
        for batch in batches:
            lists = batch.column("classes").to_pylist()
            for a, b in slices([len(x) for x in lists], 4 * _CLASS_SLICE):
                classes, sizes = sequences(lists[a:b])
                before = np.roll(classes, 1)
                before[np.cumsum(sizes) - sizes] = BEGIN
                pair, n = np.unique((before * CLASSES + classes).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], names=["pair", "n"])

    pairs = mapped(train, run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    each = pairs.select(F.expr(f"int(pair div {CLASSES})").alias("a"), (F.col("pair") % CLASSES).alias("b"), "n")
    rows = each.repartition(_PAIR_TASKS, "a").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("next"))
    return materialize(rows.sortWithinPartitions("a"))


def expected_of_pairs(joint: np.ndarray, emits: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of pairs of states and of emissions, from rows ``a`` of the table of pairs (n: one column for each next class).

    ``joint`` is the probability of each pair of states; its last row stands for BEGIN.  A class counts half as the first and half as the next one.
    """
    first = np.zeros((len(a), STATES + 1))
    inner = a != BEGIN
    first[inner, :STATES], first[~inner, STATES] = emits.T[a[inner]], 1.0
    ahead = joint @ emits
    ratio = n / (first @ ahead)
    behind = first.T @ ratio
    out = emits * (joint.T @ behind)
    out[:, a[inner]] += (first * (ratio @ ahead.T))[inner, :STATES].T
    return joint * (behind @ emits.T), out / 2


def start_chain(pairs: DataFrame, chain: Chain) -> Chain:
    """The chain that the counts of pairs lead to from ``chain``."""
    joint = np.concatenate([chain.moves, chain.start[None, :]]) / (STATES + 1)
    for _ in range(START_ITERATIONS):
        model = pairs.sparkSession.sparkContext.broadcast((joint, chain.emits))

        def expect(batches, model=model):
            moved, emits = np.zeros((STATES + 1, STATES)), np.zeros((STATES, CLASSES))
            for batch in batches:
                a, nexts = batch.column("a").to_numpy(), batch.column("next")
                for at in range(0, len(a), _PAIR_ROWS):
                    some = nexts.slice(at, _PAIR_ROWS)
                    flat, long = some.flatten(), pa.compute.list_value_length(some).to_numpy()
                    n = np.zeros((len(some), CLASSES))
                    n[np.repeat(np.arange(len(some)), long), flat.field("b").to_numpy()] = flat.field("n").to_numpy()
                    got = expected_of_pairs(*model.value, a[at : at + _PAIR_ROWS], n)
                    moved, emits = moved + got[0], emits + got[1]
            yield pa.RecordBatch.from_arrays([pa.array([moved.tobytes()]), pa.array([emits.tobytes()])], names=["moved", "emits"])

        got = mapped(pairs, expect, "moved binary, emits binary").collect()  # a row of fixed size from each of a few tasks
        moved = sum(np.frombuffer(r["moved"]) for r in got).reshape(STATES + 1, STATES)
        emits = sum(np.frombuffer(r["emits"]) for r in got).reshape(STATES, CLASSES)
        model.destroy()
        chain = Chain.learnt(moved[STATES], moved[:STATES], emits)
        joint = (moved + MOVE_PRIOR) / (moved + MOVE_PRIOR).sum()
    return chain


def train_chain(coded_: DataFrame, counts: Counts) -> Chain:
    """Baum-Welch over all texts to learn from."""
    spark = coded_.sparkSession
    unigram = np.zeros(CLASSES)
    own = counts.classes >= 0
    unigram[counts.classes[own]] = counts.counts[own]
    unigram[FREQUENT:] = counts.class_total
    chain = Chain.first(unigram / max(unigram.sum(), 1))
    if not counts.total:
        return Chain.learnt(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)))
    train = coded_.where("learn").select("classes")
    chain = start_chain(pair_counts(train), chain)
    for _ in range(ITERATIONS):
        model = spark.sparkContext.broadcast(chain)

        def expect(batches, model=model):
            total = np.zeros((STATES, CLASSES + STATES + 1))
            for batch in batches:
                order, groups = by_length(batch)
                lists = batch.column("classes").to_pylist()
                for a, b in groups:
                    start, moves, emits = model.value.expected_of_texts(*sequences([lists[i] for i in order[a:b]]))
                    total += np.concatenate([emits, moves, start[:, None]], axis=1)
            state, slot = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(state, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[state, slot])], names=["state", "slot", "n"])

        got = mapped(train, expect, "state int, slot int, n double").groupBy("state", "slot").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((STATES, CLASSES + STATES + 1))
        total[got["state"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["n"]
        chain = Chain.learnt(total[:, -1], total[:, CLASSES:-1], total[:, :CLASSES])
    return chain


def score(docs: DataFrame) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each row of (key, text, learn); learnt from rows with ``learn``."""
    spark = docs.sparkSession
    vocabulary, counts = training_counts(docs.where("learn"))
    known = coded_texts(docs, counts)
    model = spark.sparkContext.broadcast(train_chain(known, counts))

    def chained(batches):
        for batch in batches:
            order, groups = by_length(batch)
            lists, out = batch.column("classes").to_pylist(), np.empty(batch.num_rows)
            for a, b in groups:
                out[order[a:b]] = model.value.log_likelihood(*sequences([lists[i] for i in order[a:b]])) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "chain"])

    def rare(batches):
        for batch in batches:
            lists = batch.column("loose").to_pylist()
            owner = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), [len(x) // 8 for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.frombuffer(b"".join(lists), np.int64))], names=["key", "code"])

    sums = mapped(known.select("key", "n_tokens", "n_known", "base_sum", "inside", "classes"), chained, "key long, n_tokens long, n_known long, base_sum double, inside double, chain double")
    # equal rare words of one text travel as one row with their number
    loose = mapped(known.select("key", "loose"), rare, "key long, code long").groupBy("code", "key").agg(F.count(F.lit(1)).alias("times"))
    seen = loose.join(vocabulary, "code")
    by_key = seen.groupBy("key").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("log"))
    joined = sums.join(by_key, "key", "left")
    log = F.coalesce("log", F.lit(0.0))
    return joined.select(
        "key", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + log - F.col("n_tokens") * math.log10(counts.total + counts.kinds + 1)).alias("base_score"),
        (F.col("chain") + F.col("inside") + log).alias("score"),
    )


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keyed(docs, "key").withColumn("learn", ~held_out("doc_id", 7))
    out = rows.select("key", "doc_id").join(score(rows.select("key", "text", "learn")), "key").drop("key")
    return out.withColumn("held_out", held_out("doc_id", 7))
