"""Language identification by interpolated Kneser-Ney character models.

One model for each language, over characters of lower-cased text in which every run of other
characters is one space.  The models are fitted on a bounded sample of the labelled rows (at most
``FIT_CHARS`` characters for each language and ``FIT_TOTAL`` together, in pieces of texts that are drawn by a hash of the row and the piece's place, and
one piece of every language in any case); what is predicted is every whole text.  Each language is fitted in a task of its own; its model is, for each order, an array of 64-bit hashes in order with their
log probabilities, looked up by binary search, so models together grow with the sample only.  A text gets the language of the lowest cross-entropy
for each character.  It is rejected when even that is beyond what the language's own texts show:
the limits come from pieces kept out of the fit; a language with few of them has those of all languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, and rejected; with no
labelled rows at all, every text is ``und``; ties go to the language that sorts first; each row is
judged alone; null labels are not learnt from; other columns are kept by ``filter_documents``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh, held_out, mapped, materialize, parts, slices, table

ORDER = 4
#: Characters of labelled text that the fit may use, for each language and for all together.
FIT_CHARS, FIT_TOTAL = 3_000_000, 60_000_000
#: One piece in so many calibrates the rejection instead of being fitted.
CALIBRATE_ONE_IN = 8
#: Characters of the pieces that labelled texts are cut into, and pieces that a language needs for limits of its own.
PIECE_CHARS, MIN_PIECES = 500, 20
#: Characters beyond which a text gives no more certainty (for the score).
SURE_CHARS = 40
#: Characters that are worked on together.
SEGMENT_CHARS = 1 << 19
#: A text is rejected beyond SLACK times its language's usual cross-entropy, plus z deviations of the mean.
SLACK = 1.5
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower-case letters, single spaces between; '' without a letter."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n characters that end at each position (shorter at the start)."""
    one = _mix(codes.astype(np.uint64) + np.uint64(1))
    out = [one]
    for n in range(2, ORDER + 1):
        before = np.zeros_like(one)
        before[1:] = out[-1][:-1]
        out.append(_mix(before * np.uint64(0x100000001B3) + one + np.uint64(n)))
    return out


def segments(texts: list[str]) -> list[tuple[int, str, str]]:
    """(text's number, the ORDER - 1 characters before, characters to predict): a text and the space after it, in pieces of bounded size."""
    out = []
    for i, text in enumerate(texts):
        whole = f"{' ' * (ORDER - 1)}{text} "
        out += [(i, whole[a : a + ORDER - 1], whole[a + ORDER - 1 : a + ORDER - 1 + SEGMENT_CHARS]) for a in range(0, len(text) + 1, SEGMENT_CHARS)]
    return out


def laid_out(made: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of segments end to end, each with what is before it, and the places that are predicted."""
    codes = np.frombuffer("".join(before + body for _, before, body in made).encode("utf-32-le"), "<u4")
    keep = np.ones(len(codes), bool)
    sizes = np.array([len(body) for _, _, body in made], np.int64) + ORDER - 1
    for k in range(ORDER - 1):
        keep[np.cumsum(sizes) - sizes + k] = False
    return codes, np.flatnonzero(keep)


@dataclass
class Language:
    """The model of one language."""

    name: str
    grams: list[np.ndarray]  # for each order: hashes of its grams, in order
    logs: list[np.ndarray]  # their log probabilities
    contexts: list[np.ndarray]  # for each order: hashes of the contexts one shorter, in order
    backs: list[np.ndarray]  # log weights of the lower order after them
    unknown: float  # log probability of a character that was never seen


@dataclass
class Model:
    made: list[Language]
    limits: np.ndarray | None = None  # languages x (mean, deviation of one character)
    z: float = 6.0

    @property
    def languages(self) -> list[str]:
        return [x.name for x in self.made]

    def log_probs(self, hashes: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Natural log of each language's probability of the characters at ``ends``."""
        # equal grams and contexts are looked up once
        grams = [np.unique(hashes[n][ends], return_inverse=True) for n in range(ORDER)]
        contexts = [None, *(np.unique(hashes[n - 1][ends - 1], return_inverse=True) for n in range(1, ORDER))]
        out = np.empty((len(ends), len(self.made)))
        for k, one in enumerate(self.made):
            value = np.full(len(ends), one.unknown)
            for n in range(ORDER):
                if n:
                    keys, where = contexts[n]
                    value += _look(one.contexts[n], one.backs[n], keys, 0.0)[where]
                keys, where = grams[n]
                got = _look(one.grams[n], one.logs[n], keys, np.nan)[where]
                value = np.where(np.isnan(got), value, got)
            out[:, k] = value
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats for each character) of each text under each language, and characters."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        sums, made = np.zeros((len(texts), len(self.made))), segments(texts)
        for a, b in slices([len(body) for _, _, body in made], SEGMENT_CHARS):
            codes, ends = laid_out(made[a:b])
            hashes = gram_hashes(codes)
            _, first, where = np.unique(hashes[-1][ends], return_index=True, return_inverse=True)
            logs = self.log_probs(hashes, ends[first])[where.ravel()]
            sizes = np.array([len(body) for _, _, body in made[a:b]], np.int64)
            np.add.at(sums, [i for i, _, _ in made[a:b]], np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0))
        return -sums / lengths[:, None], lengths

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of normal texts."""
        out: list[tuple[str, float, float, bool]] = [(UND, 0.0, 0.0, True)] * len(texts)
        names = self.languages
        rows = [i for i, t in enumerate(texts) if t] if names else []
        for a, b in slices([len(texts[i]) for i in rows], SEGMENT_CHARS):
            part = rows[a:b]
            entropy, lengths = self.entropies([texts[i] for i in part])
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(part)), best]
            weight = np.exp(-(entropy - low[:, None]) * np.minimum(lengths, SURE_CHARS)[:, None])
            score = 1.0 / weight.sum(axis=1)
            mean, deviation = self.limits[best, 0], self.limits[best, 1]
            far = low > mean * SLACK + self.z * deviation / np.sqrt(lengths)
            for i, k, s, h, r in zip(part, best, score, low, far, strict=True):
                out[i] = (names[k], float(s), float(h), bool(r))
        return out


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    out = np.full(len(wanted), missing)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        out[hit] = values[at[hit]]
    return out


def kneser_ney(name: str, counts: pd.DataFrame, alphabet: int) -> Language:
    """The model of a language from the counts (gram of ORDER characters, n) of its sample; alphabet: kinds of characters, one for unseen ones among them."""
    levels = [counts[["gram", "n"]]]
    for _ in range(ORDER - 1):  # continuation counts: in how many left contexts a shorter gram was seen
        shorter = levels[-1]["gram"].str[1:]
        levels.append(shorter.value_counts(sort=False).rename_axis("gram").reset_index(name="n"))
    levels.reverse()
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    grams, contexts, unknown, lower = [], [none], 0.0, {}
    for n, level in enumerate(levels):
        once, twice = (level["n"] == 1).sum(), (level["n"] == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        context = level["gram"].str[:-1]
        total = level.groupby(context)["n"].transform("sum")
        kinds = level.groupby(context)["n"].transform("size")
        gamma = discount * kinds / total
        below = level["gram"].str[1:].map(lower) if n else pd.Series(1.0 / alphabet, index=level.index)
        prob = (level["n"] - discount) / total + gamma * below
        lower = dict(zip(level["gram"], prob, strict=True))
        grams.append(_sorted(level["gram"], np.log(prob), n + 1))
        if n:
            back = pd.DataFrame({"gram": context, "v": np.log(gamma)}).drop_duplicates("gram")
            contexts.append(_sorted(back["gram"], back["v"], n))
        else:
            unknown = float(np.log(gamma.iloc[0] / alphabet))
    return Language(name, [g[0] for g in grams], [g[1] for g in grams], [c[0] for c in contexts], [c[1] for c in contexts], unknown)


def _sorted(grams: pd.Series, values: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of grams of ``size`` characters in order, and their values."""
    keys = gram_hashes(np.frombuffer("".join(grams).encode("utf-32-le"), "<u4"))[size - 1][size - 1 :: size]
    order = np.argsort(keys)
    return keys[order], values.to_numpy(np.float32)[order]


_MADE = "lang string, level int, grams binary, logs binary, contexts binary, backs binary, unknown double"


def _fit_one(counts: pd.DataFrame) -> pd.DataFrame:
    """A language's model as one row for each order."""
    one = kneser_ney(counts["lang"].iloc[0], counts, int(counts["alphabet"].iloc[0]))
    rows = [(one.name, n, *(x[n].tobytes() for x in (one.grams, one.logs, one.contexts, one.backs)), one.unknown) for n in range(ORDER)]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _MADE.split(", ")])


def pieces_of(text: str) -> list[str]:
    """A normal text in pieces of about PIECE_CHARS that end after a word (a longer word is cut)."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = text.rfind(" ", at + PIECE_CHARS // 2, at + PIECE_CHARS)
        end = cut if cut > 0 else at + PIECE_CHARS
        out.append(text[at:end].strip())
        at = end
    return [x for x in [*out, text[at:].strip()] if x]


def _draws(key: int, n: int) -> np.ndarray:
    """Two draws in [0, 1) for each of n pieces of a row."""
    with np.errstate(over="ignore"):
        base = np.uint64(key & (2**64 - 1)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return np.stack([_mix(_mix(base + np.uint64(salt))) >> np.uint64(11) for salt in (17, 29)]) / float(1 << 53)


def fit(labelled: DataFrame, fit_chars: int = FIT_CHARS) -> Model:
    """A model from rows of (text, lang) with both known, and doc_id if there is one, which tells equal texts apart in the draw.

    See the module's text for the sample's bound.  Whatever the draw is, the first piece of one text of every language is fitted.
    """
    ids = [F.col("doc_id").cast("string")] if "doc_id" in [c.lower() for c in labelled.columns] else []
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(*ids, "text").alias("key")
    )
    # labels and their sizes: one row for each language
    spoken = F.when(F.col("text").rlike(r"\p{L}"), F.col("key"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min(spoken).alias("first")).orderBy("lang").collect()
    none = Model([])
    if not sizes:
        return none
    shares = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, min(fit_chars, FIT_TOTAL / len(sizes)) / max(r["chars"], 1)), r["first"]) for r in sizes], "lang string, share double, first long"
    )
    known = rows.join(F.broadcast(shares), "lang").select("text", "lang", "key", "share", (F.col("key") == F.col("first")).alias("first"))

    def sampled(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            out: list[list] = [[], [], []]
            columns = (batch.column(c).to_pylist() for c in ("text", "lang", "key", "share", "first"))
            for text, lang, key, share, first in zip(*columns, strict=True):
                made = pieces_of(normal(text))
                drawn, part = _draws(key, len(made))
                for i in np.flatnonzero((drawn < share) | ((np.arange(len(made)) == 0) & bool(first))).tolist():
                    fitted = (first and i == 0) or part[i] * CALIBRATE_ONE_IN >= 1
                    for column, value in zip(out, (lang, made[i], int(fitted)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "text", "part"])

    sample = materialize(mapped(known, sampled, "lang string, text string, part long"))  # bounded, read twice

    def count(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            frame = batch.to_pandas()
            for lang, own in frame.groupby("lang"):
                made = segments(own["text"].tolist())
                for a, b in slices([len(body) for _, _, body in made], SEGMENT_CHARS):
                    codes, ends = laid_out(made[a:b])
                    view = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[ends - ORDER + 1]
                    # four code points of 21 bits do not fit a word: count the raw bytes of each gram
                    raw = np.ascontiguousarray(view).view(f"V{4 * ORDER}").ravel()
                    kinds, n = np.unique(raw, return_counts=True)
                    grams = [x.tobytes().decode("utf-32-le") for x in kinds]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": n.astype(np.int64)})

    counted = mapped(sample.where("part != 0").select("lang", "text"), count, "lang string, gram string, n long")
    counts = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    alphabet = counts.select(F.substring("gram", -1, 1)).distinct().count() + 1
    # bounded: a language has at most fit_chars grams, and all models together at most FIT_TOTAL
    rows = counts.withColumn("alphabet", F.lit(alphabet)).groupBy("lang").applyInPandas(_fit_one, _MADE).collect()
    if not rows:
        return none
    rows.sort(key=lambda r: (r["lang"], r["level"]))
    as_arrays = lambda own, name, kind: [np.frombuffer(bytes(r[name]), kind) for r in own]
    made = []
    for i in range(0, len(rows), ORDER):
        own = rows[i : i + ORDER]
        made.append(Language(own[0]["lang"], as_arrays(own, "grams", np.uint64), as_arrays(own, "logs", np.float32), as_arrays(own, "contexts", np.uint64), as_arrays(own, "backs", np.float32), own[0]["unknown"]))
    model = Model(made)
    model.limits = np.tile([6.0, 2.0], (len(model.languages), 1))
    held = sample.where("part = 0").select("lang", "text")
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            frame = batch.to_pandas()
            made = shared.value
            place = {lang: k for k, lang in enumerate(made.languages)}
            out = {"lang": [], "h": [], "n": []}
            for a, b in slices([len(t) for t in frame["text"]], 1 << 20):
                own = frame.iloc[a:b]
                entropy, lengths = made.entropies(own["text"].tolist())
                for lang, h, n in zip(own["lang"], entropy, lengths, strict=True):
                    if lang in place:
                        out["lang"].append(lang)
                        out["h"].append(float(h[place[lang]]))
                        out["n"].append(int(n))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("h", pa.float64()), ("n", pa.int64())]))

    seen = mapped(held, calibrate, "lang string, h double, n long")
    sums = seen.groupBy("lang").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"), F.sum(F.col("h") * F.col("n")).alias("hn"), F.sum(F.col("h") * F.col("h") * F.col("n")).alias("hhn")
    ).collect()  # one row for each language
    for r in sums:
        if r["pieces"] >= MIN_PIECES:
            model.limits[model.languages.index(r["lang"])] = _limits(r["pieces"], r["n"], r["hn"], r["hhn"])
    few = [k for k, lang in enumerate(model.languages) if lang not in {r["lang"] for r in sums if r["pieces"] >= MIN_PIECES}]
    if few and sums:
        pieces, *all_sums = (sum(r[c] for r in sums) for c in ("pieces", "n", "hn", "hhn"))
        mean, deviation = _limits(pieces, *all_sums)
        # pooled over languages; a handful of pieces tells the mean but no deviation
        model.limits[few] = (mean, deviation if pieces >= MIN_PIECES else max(deviation, 2.0))
    return model


def _limits(pieces: int, n: float, hn: float, hhn: float) -> tuple[float, float]:
    """Mean cross-entropy and deviation of one character, from sums over pieces of n, h n and h h n."""
    mean = hn / n
    return mean, float(np.sqrt(max(hhn - mean * hn, 0.0) / pieces))


def with_language(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs``, and a struct (lang_pred, score, cross_entropy, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, at)):
            made = shared.value.predict([normal(x) for x in batch.column(at).to_pylist()])
            columns = list(zip(*made, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            struct = pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang_pred", "score", "cross_entropy", "rejected"]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    kind = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"
    return mapped(docs, run, docs.select("*", F.lit(None).cast(kind).alias(name)).schema)


def filter_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns; learnt from ``labelled`` or from docs."""
    name = fresh(docs, "language")
    marked = with_language(docs, fit(docs if labelled is None else labelled), name)
    return marked.where(~F.col(f"{name}.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4)))
    out = with_language(docs.select("doc_id", "text"), model, "language")
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "language.*")
