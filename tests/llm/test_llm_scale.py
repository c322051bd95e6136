"""Brute-force versions of whole methods, and what holds for large groups, long texts and many sizes."""

import collections
import hashlib
import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.llm import _tok, _words, bpe_reuse, hmm, langid, licenses, near_dedup, quality, registry, substring_dedup, warc_audit
from test_llm_operators import brute_counts, brute_near

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{DATA}/{t}')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_oracle_of_licenses_has_repeated_notices(spark, tmp_path):
    import duckdb

    rows = [(1, " ".join(["Released under the MIT License."] * 200)), (2, " ".join(f"w{i}" for i in range(700))), (3, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:4] for r in con.execute(licenses.ORACLE_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_units"], r["n_matches"], r["license"]) for r in licenses.scan(df).collect()}
    assert got == want and got[1] == (1, 1, "mit")


# ---- words -------------------------------------------------------------------------------------


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(_words, "PIECE_BYTES", 64)
    rng = random.Random(1)
    text = b"".join(bytes(rng.choice(b"ab \n\t\xc3\xa9") for _ in range(rng.randrange(20))) + rng.choice([b" ", b"x" * 90, b"\n"]) for _ in range(80))
    hashes = _words.WordHashes()
    got, sizes = hashes.of([text, b"", b"one two"])
    assert b"".join(_words.pieces(text)) == text and sizes.tolist() == [len(text.split()), 0, 2]
    assert got.tolist() == [hashes.digest(w) for w in [*text.split(), b"one", b"two"]]
    assert all(len(w) <= _words.MEMO_BYTES for w in hashes)
    kept = [w for _, k in substring_dedup.kept_words(text, [3 * 64 + 20, 30 * 64 + 25]) for w in k]
    assert kept == [w for i, w in enumerate(text.split()) if not (3 <= i < 23 or 30 <= i < 55)]


def test_encoders_cut_long_texts(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(_tok, "PIECE_CHARS", 50)
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "12", "é", "日本", "x" * 60, "!", "\u3000"]) for _ in range(900))
    byte = _tok.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    word = _tok.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert len(list(_tok.cuts(text))) > 10
    for one in (byte, word):
        assert one.encode(text) == one.whole(text) == np.array(one.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert all(len(w) <= _tok.MEMO_CHARS for w in one.memo)


# ---- near-duplicates ---------------------------------------------------------------------------


def _template(rng, n, own=17, common=83):
    """Documents of one template: common words with own ones strewn in, all pairs well below the threshold."""
    base = [f"c{i}" for i in range(common)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in range(own // 5 + 1):  # a few runs of own words: similarity of shingles about .7
            at = rng.randrange(len(words))
            words[at:at] = [f"o{i}_{k}_{j}" for j in range(own // 3)]
        rows.append((i, " ".join(words)))
    return rows


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    rng = random.Random(7)
    rows = _template(rng, 120, own=12)
    for i in range(60):  # links at and around the threshold between members of the template
        words = rows[rng.randrange(120)][1].split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((200 + i, " ".join(words)))
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.score(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    want = brute_near(rows)
    assert got == want and sum(not k for _, _, k in want.values()) > 10


def test_time_of_a_template_grows_with_its_size(spark):
    took = []
    for n in (1000, 4000):
        df = spark.createDataFrame(_template(random.Random(3), n), "doc_id long, text string")
        began = time.time()
        assert near_dedup.score(df, 0.85).where("kept").count() == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 20


def test_rare_elements_are_shared_by_links():
    """Of two sets that reach the threshold, the smaller one's first elements meet the larger one's, in any common order."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, percent = int(rng.integers(3, 60)), 85
        x = set(rng.integers(0, 90, n).tolist())
        y = set(list(x)[: max(1, len(x) - int(rng.integers(0, 4)))]) | set(rng.integers(90, 200, int(rng.integers(0, 4))).tolist())
        if 100 * len(x & y) < percent * len(x | y):
            continue
        small, large = sorted((x, y), key=len)
        order = {e: k for k, e in enumerate(rng.permutation(200).tolist())}
        index = len(small) + 2 * percent * len(small) // -(100 + percent) + 1
        probe = len(large) + percent * len(large) // -100 + 1
        assert set(sorted(small, key=order.get)[:index]) & set(sorted(large, key=order.get)[:probe])


# ---- substrings ---------------------------------------------------------------------------------


def test_repeats_of_few_words_in_many_documents(spark):
    from test_llm_operators import brute_substrings

    rng = random.Random(11)
    common = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(150):  # one passage with changing surroundings, and runs over a small vocabulary
        words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = common[rng.randrange(5) : 24 - rng.randrange(3)]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute_substrings(rows), strict=True)}


# ---- language ------------------------------------------------------------------------------------


def brute_kneser_ney(texts, alphabet):
    """Probability of a character after a context, by the definition."""
    padded = ["   " + t + " " for t in texts]
    counts = [None] * 5
    counts[4] = collections.Counter(p[i - 3 : i + 1] for p in padded for i in range(3, len(p)))
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        one, two = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        return min(max(one / max(one + 2 * two, 1), 0.1), 0.9)

    def prob(context, c, n=4):
        lower = 1 / alphabet if n == 1 else prob(context[1:], c, n - 1)
        after = {g: v for g, v in counts[n].items() if g[:-1] == context}
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(context + c, 0) - discount(n), 0) / total + discount(n) * len(after) / total * lower

    return prob


def test_kneser_ney_equals_the_definition():
    texts = ["abra cadabra", "abba", "cab bac"]
    grams = collections.Counter(("   " + t + " ")[i : i + 4] for t in texts for i in range(len(t) + 1))
    alphabet = len({g[-1] for g in grams}) + 1
    model = langid.Model([langid.kneser_ney("x", pd.DataFrame(list(grams.items()), columns=["gram", "n"]), alphabet)])
    prob = brute_kneser_ney(texts, alphabet)
    for text in ("abra", "cab zebra", "dd", "a"):
        want = [math.log(prob(("   " + text + " ")[i : i + 3], (text + " ")[i])) for i in range(len(text) + 1)]
        got, n = model.entropies([text])
        assert n[0] == len(text) + 1 and got[0, 0] == pytest.approx(-sum(want) / len(want), rel=1e-5)


def test_rejection_limits_equal_the_definition(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(200)), "aa") for _ in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(docs)
    held = [r["text"] for r in docs.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(langid.CALIBRATE_ONE_IN)) == 0).collect()]
    pieces = [t[i : i + langid.PIECE_CHARS].strip() for t in map(langid.normal, held) for i in range(0, len(t), langid.PIECE_CHARS)]
    h, n = model.entropies([p for p in pieces if p])
    mean = (h[:, 0] * n).sum() / n.sum()
    deviation = math.sqrt((n * (h[:, 0] - mean) ** 2).sum() / len(n))
    assert model.limits[0] == pytest.approx([mean, deviation], rel=1e-6)


def test_language_of_long_texts_in_segments(monkeypatch):
    grams = collections.Counter(("   abra cadabra ")[i : i + 4] for i in range(13))
    model = langid.Model([langid.kneser_ney("x", pd.DataFrame(list(grams.items()), columns=["gram", "n"]), 7)])
    texts = ["abra " * 50, "cad", "bra" * 40]
    whole = model.entropies(texts)[0]
    monkeypatch.setattr(langid, "SEGMENT_CHARS", 7)
    assert model.entropies(texts)[0] == pytest.approx(whole)


def test_unknown_labels_only(spark):
    docs = spark.createDataFrame([("some text here", None), (None, None)], "text string, lang string")
    assert langid.filter_documents(docs).count() == 0


# ---- language model ------------------------------------------------------------------------------


def test_segments_give_the_counts_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    chain = hmm.Chain.learnt(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((hmm.STATES, 6)))
    sizes = np.array([5, 70, 1, 33, 250, 16, 32, 17])
    classes = rng.integers(0, 6, sizes.sum())
    whole = chain.expected(classes, sizes)
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    for limit in (1 << 20, 90):
        monkeypatch.setattr(hmm, "_CLASS_SLICE", limit)
        for a, b in zip(whole, chain.expected_of_texts(classes, sizes), strict=True):
            assert np.allclose(a, b)


def test_language_model_end_to_end(spark):
    """Scores equal a plain program that trains on the same start and scores word by word."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "a", "cat", "dog", "runs", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(40))), i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, text string, learn boolean")
    got = {r["key"]: r for r in hmm.score(df).collect()}
    tokens = {i: [*t.encode().lower().split(), b""] for i, t, _ in rows}
    counts = collections.Counter(w for i, _, learn in rows if learn for w in tokens[i])
    vocabulary, held = hmm.training_counts(df.where("learn"))
    chain = hmm.train_chain(hmm.coded_texts(df, held), held)
    code = {w: hmm.word_code(w) for ws in tokens.values() for w in ws}
    by_count = sorted(counts, key=lambda w: (-counts[w], code[w]))
    own = {w: k for k, w in enumerate(by_count[: hmm.FREQUENT])}
    for i, ws in tokens.items():
        kinds = [own.get(w, hmm.FREQUENT + code[w] % hmm.SUFFIXES) for w in ws]
        inside = 0.0
        for w, k in zip(ws, kinds, strict=True):
            if k >= hmm.FREQUENT:
                inside += math.log10((counts[w] + 1) / (held.class_total[k - hmm.FREQUENT] + held.class_kinds[k - hmm.FREQUENT] + 1))
        alpha, total = chain.start, 0.0
        for t, k in enumerate(kinds):
            alpha = (alpha if not t else alpha @ chain.moves) * chain.emits[:, k]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[i]["score"] == pytest.approx(total + inside)


def _two_kinds(n, shift=0):
    rng = random.Random(8)
    kinds = [["the", "a", "cat", "dog", "runs"], ["le", "un", "chat", "chien", "court"]]
    return [(i + shift, " ".join(rng.choice(kinds[i % 2] + [f"w{rng.randrange(99)}"]) for _ in range(1 + i % 50)), i % 7 > 0) for i in range(n)]


def test_training_draws_no_sample(spark, monkeypatch):
    """Every text counts in every iteration, so other keys for the same texts change nothing."""
    monkeypatch.setattr(hmm, "START_TOKENS", 300, raising=False)
    monkeypatch.setattr(hmm, "START_ITERATIONS", 6)
    schema = "key long, text string, learn boolean"
    one, other = ({r["key"] - k: r["score"] for r in hmm.score(spark.createDataFrame(_two_kinds(80, k), schema)).collect()} for k in (0, 1000))
    assert one == pytest.approx(other, rel=1e-9)


def test_start_counts_the_pairs_of_every_text(spark, monkeypatch):
    """The start equals plain expectation and maximization, pair of tokens by pair of tokens, over all training texts."""
    monkeypatch.setattr(hmm, "START_ITERATIONS", 2)
    monkeypatch.setattr(hmm, "ITERATIONS", 0)
    monkeypatch.setattr(hmm, "_PAIR_ROWS", 5)
    df = spark.createDataFrame(_two_kinds(30), "key long, text string, learn boolean")
    _, held = hmm.training_counts(df.where("learn"))
    known = hmm.coded_texts(df, held)
    pairs = collections.Counter()
    for r in known.where("learn").collect():
        classes = np.frombuffer(r["classes"], "<i2").tolist()
        pairs.update(zip([hmm.BEGIN, *classes], classes, strict=False))
    got = {(r["a"], x["b"]): x["n"] for r in hmm.pair_counts(known.where("learn")).collect() for x in r["next"]}
    assert got == pairs and sum(got.values()) == held.total
    unigram = np.bincount([b for _, b in pairs.elements()], minlength=hmm.CLASSES)
    chain = hmm.Chain.first(unigram / unigram.sum())
    joint = np.vstack([chain.moves, chain.start]) / (hmm.STATES + 1)
    for _ in range(2):
        moved, emits = np.zeros(joint.shape), np.zeros(chain.emits.shape)
        for (a, b), n in pairs.items():
            begin = np.eye(hmm.STATES + 1)[hmm.STATES] if a == hmm.BEGIN else np.append(chain.emits[:, a], 0)
            share = begin[:, None] * joint * chain.emits[:, b]
            share *= n / share.sum()
            moved += share
            emits[:, b] += share.sum(0) / 2
            if a != hmm.BEGIN:
                emits[:, a] += share.sum(1)[:-1] / 2
        chain, joint = hmm.Chain.learnt(moved[-1], moved[:-1], emits), (moved + hmm.MOVE_PRIOR) / (moved + hmm.MOVE_PRIOR).sum()
    learnt = hmm.train_chain(known, held)
    for x, y in zip((learnt.start, learnt.moves, learnt.emits), (chain.start, chain.moves, chain.emits), strict=True):
        assert np.allclose(x, y, rtol=1e-9, atol=0)


def test_known_words_stay_below_their_bound(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 20)
    rows = [(i, " ".join(f"w{j}" for j in range(i + 1)), True) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, text string, learn boolean")
    _, held = hmm.training_counts(df)
    assert 0 < len(held.codes) <= 20
    got = {r["key"]: r for r in hmm.score(df).collect()}
    counts = collections.Counter(w for _, t, _ in rows for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        assert got[i]["n_known"] == i + 2 and got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*t.split(), ""]))


# ---- BPE -------------------------------------------------------------------------------------------


def test_joins_agree_for_any_characters(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rng = random.Random(12)
    shared = "".join(rng.choice(["word", " ", "Σίσυφος ", "ΟΔΟΣ", "日本語", "it's", "“quoted” ", "\n", "e\u0301", "12", "!?", "\x1c", "\u3000", "naïve "]) for _ in range(9000))
    rows = [(i, "xΣ" * i + shared[i * 37 : 14000 + i * 91] + "tail" * i) for i in range(12)]
    whole = "".join(rng.choice("abcdefg日本") for _ in range(9000))  # no white space in any chunk
    rows += [(20 + i, "y " * i + whole[i * 50 :] + " z" * i) for i in range(4)]
    out = bpe_reuse.encode(spark.createDataFrame(rows, "key long, text string")).collect()
    want = {k: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for k, x in rows}
    assert {r["key"]: r["ids_sha256"] for r in out} == want


def test_filter_follows_the_number_of_chunks(spark, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([texts[0]] * 6 + texts[1:] * 2)], "key long, text string")
    small = bpe_reuse.shared_filter(df)
    assert len(small) * 64 == bpe_reuse.LEAST_BITS
    monkeypatch.setattr(bpe_reuse, "LEAST_BITS", 64)
    monkeypatch.setattr(bpe_reuse, "MOST_BITS", 1 << 9)
    tight = bpe_reuse.shared_filter(df)  # room for the most frequent chunks only
    hit = [bpe_reuse.hits(tight, [bpe_reuse.chunk_hash(c) for c in bpe_reuse.chunks(t)]).mean() for t in texts]
    assert len(tight) == 8 and hit[0] == 1 and max(hit[1:]) < 0.6


# ---- quality ----------------------------------------------------------------------------------------


def brute_verdicts(rows):
    """kept of each (id, text, lang, source): thresholds from sorted values instead of sketches."""
    figures = {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeat = brute_counts(text or "")
        lines = len([x for x in (text or "").split("\n") if x.split()])
        per = lambda a, b: a / b if b else 0.0
        base = n < 50 or 100 * repeat > 50 * n
        figures[i] = (lang, source, base, {"symbol_share": per(symbols, chars), "dup_line_share": per(dup, lines), "repeat_share": per(repeat, n), "long_words": per(chars, n), "short_words": per(chars, n)})

    def quantile(values, p):
        return sorted(values)[max(math.ceil(p * len(values)) - 1, 0)]

    kept = {}
    for i, (lang, source, base, own) in figures.items():
        fails = base
        for rule in quality.RULES:
            groups = [[f[3][rule.name] for f in figures.values() if not f[2] and (depth > 0 or f[1] == source) and (depth > 1 or f[0] == lang)] for depth in range(3)]
            above = lambda v: [x for x in v if x > quality.LEAST]
            least = (lambda v: len(above(v)) >= quality.MIN_ABOVE) if rule.share else (lambda v: len(v) >= quality.MIN_GROUP)
            group = next((g for g in groups if least(g)), groups[2])
            value = own[rule.name]
            if not rule.share:
                lo, hi = quantile(group, 0.25), quantile(group, 0.75)
                spread = max(hi - lo, quality.LEAST_SPREAD * hi)
                fails |= value > hi + quality.FENCE * spread if rule.upper else value < lo - quality.FENCE * spread
            elif above(group):
                small, lo, hi = (quantile(above(group), p) for p in (0.05, 0.25, 0.75))
                apart = small >= quality.GAP and len(above(group)) <= (1 - quality.MOSTLY) * len(group)
                fails |= value > (small / 2 if apart else hi * max(hi / lo, 1 + quality.LEAST_SPREAD) ** quality.LOG_FENCE)
        kept[i] = not fails
    return kept


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(900):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 160))]
        if i % 9 == 0:  # a group that uses symbols throughout, so they are no sign there
            source = "table"
            words = [w + "|" * rng.randrange(1, 4) if rng.random() < 0.5 else w for w in words]
        else:
            source = "a" if i % 2 else "b"
            if i % 31 == 0:
                words = [w + "$#%" for w in words]
            if i % 6 == 0:
                words += words[: rng.randrange(3, 12)]
            if i % 29 == 0:
                words = [w * 5 for w in words]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows.append((i, text, "en", source))
    rows += [(1000, None, None, None), (1001, "too short", "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = brute_verdicts(rows)
    differ = [i for i in want if got[i] != want[i]]
    assert len(differ) <= 4  # a sketch's quantiles are off by a bucket
    assert sum(want[i] for i in range(0, 900, 9)) > 80 and not any(want[i] for i in range(31, 900, 31) if i % 9)


def test_counts_of_many_texts_at_once():
    rng = random.Random(9)
    made = [" ".join(rng.choice("ab#|é") * rng.randrange(1, 3) for _ in range(rng.randrange(30))).replace("a b", "\n") for _ in range(200)]
    got = quality.counts([t.encode() for t in made])
    for row, text in zip(got.tolist(), made, strict=True):
        assert (row[0], row[1], row[2], row[4], row[5]) == brute_counts(text)


# ---- WARC -------------------------------------------------------------------------------------------


def test_records_are_read_back(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i * i}</p>\r\n\r\n") for i in range(40)], "page_id long, url string, html string")
    made = pages.select("page_id", warc_audit.body_of(F.col("url"), F.col("html"), F.col("page_id")).alias("body")).orderBy("page_id").collect()
    data = "".join(r["body"] for r in made).encode()
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:-30])), ("c", None), ("d", bytearray(b"no record"))], "file string, content binary")
    read = warc_audit.read(files).collect()
    laid = sorted(warc_audit.records(pages).collect(), key=lambda r: r["record"])
    whole = sorted((r for r in read if r["file"] == "a"), key=lambda r: r["record"])
    assert [(r["offset"], r["length"], r["digest"]) for r in whole] == [(r["offset"], r["length"], r["digest"]) for r in laid]
    assert all(r["complete"] for r in whole) and [r["url"] for r in whole] == [f"http://h/{i}" for i in range(40)]
    assert [r["complete"] for r in sorted((r for r in read if r["file"] == "b"), key=lambda r: r["record"])] == [True] * 39 + [False]
    assert [(r["file"], r["complete"]) for r in read if r["file"] in "cd"] == [("d", False)]


def test_overfull_files_are_split(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "FILE_PAGES", 32)
    rows = [(None, f"u{i % 300}", "same") for i in range(400)] + [(7, "u", "equal")] * 500 + [(i, "v", str(i)) for i in range(64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    laid = warc_audit.records(pages)
    by = collections.defaultdict(list)
    for r in laid.collect():
        by[r["file"], r["volume"]].append(r)
    assert len({v for f, v in by if f == -1}) > 5 and sum(map(len, by.values())) == len(rows)
    for own in by.values():
        own.sort(key=lambda r: r["record"])
        assert [r["record"] for r in own] == list(range(len(own))) and [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    changed = pages.withColumn("html", F.when((F.col("page_id") == 40), "broken").otherwise(F.col("html")))
    found = warc_audit.audit(laid, warc_audit.records(changed)).collect()
    assert [(r["file"], r["page_id"]) for r in found] == [(1, 40)] and found[0]["digest"] != found[0]["replica_digest"]


def _audited(spark, rows, change):
    schema = "page_id long, url string, html string"
    laid = warc_audit.records(spark.createDataFrame(rows, schema))
    return warc_audit.audit(laid, warc_audit.records(spark.createDataFrame(change(rows), schema))).collect()


def test_one_change_is_one_finding_in_overfull_and_ordinary_files(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "FILE_PAGES", 64)
    overfull = [(None, f"u{i}", f"text {i}") for i in range(600)] + [(3, "v", str(i)) for i in range(200)]
    ordinary = [(64 + i, f"w{i}", f"page {i}") for i in range(60)]
    rows = overfull + ordinary
    put = lambda at, html: lambda r: [*r[:at], (*r[at][:2], html), *r[at + 1 :]]
    for at, html in ((17, "changed"), (299, "text 299 and longer"), (810, "p"), (811, "a page that has grown")):
        found = _audited(spark, rows, put(at, html))
        assert [(r["page_id"], r["digest"] is None, r["replica_digest"] is None) for r in found] == [(rows[at][0], False, False)]
    gone = _audited(spark, rows, lambda r: r[:100] + r[101:])
    assert [(r["page_id"], r["replica_digest"]) for r in gone] == [(None, None)]
    more = _audited(spark, rows, lambda r: [*r, (70, "new", "page")])
    assert [(r["page_id"], r["digest"]) for r in more] == [(70, None)]
    # one of many contents of one id and address: the old one and the new one are told apart by content only
    assert len(_audited(spark, rows, put(700, "other"))) == 1
    # a copy more and a file less
    assert [r["digest"] for r in _audited(spark, rows, lambda r: [*r, r[5]])] == [None]
    assert len(_audited(spark, rows, lambda r: r[:800])) == 60
    assert _audited(spark, rows, lambda r: r[::-1]) == []


# ---- languages of few or long texts ---------------------------------------------------------------


def _letters(k):
    """A script of its own for a language: ten letters."""
    return [chr(0x4E00 + 40 * k + i) for i in range(10)]


def _text(k, n, seed=0):
    rng = random.Random(1000 * k + seed)
    return " ".join("".join(rng.choices(_letters(k), k=rng.randrange(2, 6))) for _ in range(n))


def test_every_language_of_one_text_is_learnt(spark):
    rows = [(k, _text(k, 30), f"l{k:02}") for k in range(20)] + [(90, None, "none"), (91, "123", "digits")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:02}" for k in range(20)]
    assert [r[0] for r in model.predict([_text(k, 20, 1) for k in range(20)])] == model.languages


def test_every_language_of_one_long_text_is_learnt(spark):
    rows = [(k, _text(k, 30_000), f"l{k}") for k in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_chars=20_000)
    assert model.languages == [f"l{k}" for k in range(6)]
    assert not any(r[3] for r in model.predict([_text(k, 20, 1) for k in range(6)]))


def test_the_bound_of_the_fit_holds_for_repeated_texts(spark, monkeypatch):
    rows = [(i, _text(1, 200), "one") for i in range(300)]  # one text of about 900 characters under 300 ids
    seen = []
    monkeypatch.setattr(langid, "kneser_ney", lambda name, counts, alphabet, real=langid.kneser_ney: seen.append(counts["n"].sum()) or real(name, counts, alphabet))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), fit_chars=30_000)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_chars=30_000)
    assert model.languages == ["one"] and all(15_000 < n < 45_000 for n in seen)


def test_pieces_hold_all_words():
    for n in (0, 1, 100, 5000):
        text = langid.normal(_text(2, n))
        assert " ".join(langid.pieces_of(text)) == text and all(len(p) <= langid.PIECE_CHARS for p in langid.pieces_of(text))
    assert "".join(langid.pieces_of("x" * 1700)) == "x" * 1700
