"""Every operator against a brute-force version on a small table, and on nulls, copies, repeated rows and nothing."""

import collections
import hashlib
import math
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import bpe_reuse, hmm, langid, licenses, matroska, near_dedup, packing, quality, substring_dedup, warc_audit  # noqa: F401


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(df):
    return {r["doc_id"]: (r["text"] or "") for r in df.select("doc_id", "text").collect()}


def library(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


# ---- packing -----------------------------------------------------------------------------------


def test_packing_covers_each_id_once(spark, folder, odd):
    t = library("byte_bpe_50k.json")
    rows = packing.op1_packing(spark, folder).collect()
    for doc, text in texts(odd).items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
    assert len({r["sequence_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_cuts_are_powers_of_two(n):
    got = list(packing.cuts(n))
    assert sum(b for _, b in got) == n and all(b & (b - 1) == 0 for _, b in got)
    assert sum(1 for _, b in got if b < 1024) == bin(n % 1024).count("1")


def test_packing_of_repeated_rows_and_nothing(repeated, empty):
    assert packing.pack(empty).count() == 0
    assert packing.pack(repeated).where("doc_id is null").selectExpr("sum(length)").first()[0] == 1 + packing.pack(repeated).where("doc_id = 1").selectExpr("sum(length)").first()[0]


# ---- substring dedup -----------------------------------------------------------------------------


def brute_substrings(rows):
    """(n_words, n_removed, kept) of each (id, text), in order."""
    seen, out = set(), []
    for _, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark, folder, odd):
    got = by_id(substring_dedup.op2_substring_dedup(spark, folder))
    rows = sorted(texts(odd).items())
    want = brute_substrings(rows)
    assert {i: tuple(got[i])[1:] for i, _ in rows} == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_substring_dedup_repeated_rows(repeated, empty):
    got = collections.Counter(tuple(r) for r in substring_dedup.score(repeated).collect())
    rows = sorted(((r["doc_id"], r["text"]) for r in repeated.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert sum(got.values()) == len(rows)
    copies = [r for r in got if r[0] == 0]
    assert sum(r[2] for r in copies) == 120  # of two equal rows one is the copy
    assert substring_dedup.score(empty).count() == 0 and substring_dedup.filter_documents(empty).count() == 0


def test_substring_filter_keeps_columns(repeated):
    out = substring_dedup.filter_documents(repeated)
    assert out.columns == repeated.columns and out.count() == repeated.count()


# ---- language identification -----------------------------------------------------------------------


def _two_languages(spark, n=160):
    a = "the quick brown fox jumps over the lazy dog and runs through the green forest while birds sing above".split()
    b = "der schnelle braune fuchs springt über den faulen hund und läuft durch den grünen wald während vögel singen".split()
    rows = []
    for i in range(n):
        w = a if i % 2 else b
        rows.append((i, " ".join(w[(i * 7 + k * 3) % len(w)] for k in range(12)), "en" if i % 2 else "de"))
    return spark.createDataFrame([*rows, (n, None, "en"), (n + 1, "123 !", "de"), (n + 2, "the fox", None)], "doc_id long, text string, lang string")


def test_language_accuracy_and_undetermined(spark, tmp_path):
    docs = _two_languages(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(langid.op3_language(spark, str(tmp_path)))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(got[i]["lang_pred"] == lang[i] for i in range(160))
    assert got[160]["lang_pred"] == got[161]["lang_pred"] == "und" and got[162]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_kneser_ney_adds_up(spark):
    import numpy as np
    import pandas as pd

    text = "abracadabra abra cadabra"
    grams = collections.Counter(("   " + text + " ")[i : i + 4] for i in range(len(text) + 1))
    letters = sorted(set(text)) + ["é"]  # one character stands for all unseen ones
    model = langid.Model([langid.kneser_ney("x", pd.DataFrame(list(grams.items()), columns=["gram", "n"]), len(letters))])
    for context in ("bra", "abr", "zzz", "   "):
        total = 0.0
        for c in letters:
            codes = np.array([ord(x) for x in context + c], np.uint32)
            total += math.exp(model.log_probs(langid.gram_hashes(codes), np.array([3]))[0, 0])
        assert total == pytest.approx(1.0, abs=1e-6)


def _prose(rng, letters, n):
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    return lambda: " ".join(rng.choice(vocabulary) for _ in range(n))


def test_few_long_texts_still_calibrate(spark):
    import random

    rng = random.Random(2)
    a, b = _prose(rng, "abcdefg", 4000), _prose(rng, "nopqrst", 40)
    rows = [(a(), "aa") for _ in range(24)] + [(b(), "bb") for _ in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.limits[:, 0].max() < 3.5  # neither language keeps the limit that rejects nothing
    odd = "".join(rng.choice("abcdefg") + " " * (i % 9 == 8) for i in range(3000))
    assert [p[3] for p in model.predict([langid.normal(x) for x in (a(), odd[::-1] + "zzz yyy " * 300)])] == [False, True]


def test_every_label_is_fitted(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(210):
        own = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        rows += [(f"{own} {i * j} {own}{'xyz'[j % 3]} {own}", f"l{i:03d}") for j in range(6)]
    assert len(langid.fit(spark.createDataFrame(rows, "text string, lang string")).languages) == 210


def test_language_of_nothing(spark, empty, repeated):
    assert langid.filter_documents(empty).count() == 0
    out = langid.filter_documents(repeated)
    assert out.columns == repeated.columns and out.where("text is null").count() == 0
    nothing = langid.with_language(repeated, langid.fit(empty), "l").select("l.*").distinct().collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]


# ---- media --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("n", [1, 3, 700])
def test_matroska_round_trip(lacing, n):
    payload = bytes(range(256)) * 9 * n
    payload = payload[: 576 * (len(payload) // 576)]
    data = matroska.write(payload, lacing=lacing)
    got = matroska.parse(data)
    assert got.complete and b"".join(data[p[5] : p[5] + p[6]] for p in got.packets) == payload
    assert [p[1] for p in got.packets] == [i * 72_000_000 for i in range(len(payload) // 576)]
    for time, track, at in got.cues:
        assert track == 1 and data[at : at + 4] == b"\x1f\x43\xb6\x75"
        assert time * 1_000_000 in {p[1] for p in got.packets}


def test_ebml_lacing_of_unequal_frames_and_block_groups():
    frames = [b"a" * 5, b"b" * 300, b"c" * 2, b"d" * 70]
    for kind, flag in (("xiph", 2), ("ebml", 6)):
        block = b"\x81\x00\x05" + bytes([flag]) + matroska.lace(frames, kind)
        cluster = matroska.uint(matroska.TIMESTAMP, 10) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
        # unknown sizes of segment and cluster
        data = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x1f\x43\xb6\x75\xff" + cluster
        got = matroska.parse(data)
        assert [data[p[5] : p[5] + p[6]] for p in got.packets] == frames and got.packets[0][1] == 15_000_000 and got.packets[0][2] is None


def test_broken_files_yield_what_is_sound(spark):
    data = matroska.write(b"x" * 576 * 40)
    whole = len(matroska.parse(data).packets)
    part = matroska.parse(data[: len(data) // 2])
    assert 0 <= len(part.packets) < whole and not part.complete
    for bad in (None, b"", b"not a file", b"\x1a\x45\xdf\xa3", data[:7]):
        assert matroska.parse(bad).packets == []
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"zz"))], "id long, media binary")
    table = matroska.packets(df, "id", "media")
    assert table.count() == whole and table.select("key").distinct().count() == 1


def test_media_digest(spark, folder, odd):
    got = by_id(matroska.op4_matroska(spark, folder))
    for doc, text in texts(odd).items():
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert tuple(got[0])[1:] == tuple(got[1])[1:]


# ---- WARC ------------------------------------------------------------------------------------------------


def _pages(spark, n=300):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i * i}</p>") for i in range(n)] + [(None, None, None), (5, "http://h/5", "<p>25</p>")], "page_id long, url string, html string")


def test_audit_finds_exactly_what_changed(spark):
    pages = _pages(spark)
    from pyspark.sql import functions as F

    changed = pages.withColumn("html", F.when(F.col("page_id").isin(17, 250), F.reverse("html")).otherwise(F.col("html")))
    found = warc_audit.audit(warc_audit.records(pages), warc_audit.records(changed)).collect()
    laid = {(r["file"], r["record"]): r for r in warc_audit.records(pages).collect()}
    assert {laid[r["file"], r["record"]]["page_id"] for r in found} == {17, 250}
    assert warc_audit.audit(warc_audit.records(pages), warc_audit.records(pages)).count() == 0
    lost = warc_audit.audit(warc_audit.records(pages), warc_audit.records(pages.where("page_id is not null"))).collect()
    assert [(r["file"], r["replica_digest"]) for r in lost] == [(-1, None)]


def test_records_lie_end_to_end(spark):
    rows = sorted(warc_audit.records(_pages(spark)).where("file = 0").collect(), key=lambda r: r["record"])
    assert [r["record"] for r in rows] == list(range(len(rows)))
    assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
    assert warc_audit.records(_pages(spark).where("page_id < 0")).count() == 0


# ---- licences ----------------------------------------------------------------------------------------------


def test_license_scan(spark, repeated, empty):
    rows = [
        (1, "Intro text here\nReleased under the MIT License.\nmore"), (2, "released, UNDER the mit licence!"), (3, None), (4, ""), (5, "nothing of the kind"),
        (6, "Licensed under the Apache License, Version 2.0 (the License); you may not use"), (1, "All rights reserved."), (7, licenses.TEMPLATES["mit-grant"].replace("copies", "copys")),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["license"]) for r in got if r["license"])
    assert (1, "mit") in found and (1, "all-rights-reserved") in found and (7, "mit-grant") in found and not any(d in (3, 4, 5) for d, _ in found)
    assert len(got) == len(rows)
    assert licenses.scan(repeated).count() == repeated.count() and licenses.scan(empty).count() == 0


def test_repeated_notices_are_units(spark):
    header = licenses.TEMPLATES["apache-2.0-header"]
    rows = [(1, " ".join(["All rights reserved."] * 200)), (2, " ".join([header] * 7)), (3, " ".join(f"w{i}" for i in range(3000)))]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["n_units"] for k in (1, 2, 3)] == [1, 1, 1] and [got[k]["n_matches"] for k in (1, 2, 3)] == [1, 1, 0]
    assert got[1]["license"] == "all-rights-reserved" and got[2]["license"] == "apache-2.0-header" and got[3]["license"] is None


def test_notices_inside_longer_lines(spark):
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    mit = licenses.TEMPLATES["mit-grant"]
    rows = [(1, "Licensed under the Apache License, Version 2.0 (the License); you may not use"), (2, f"{prose(400)} {mit} {prose(300)}"), (3, f"{prose(50)} All rights\nreserved. {prose(9)}"), (4, prose(500))]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["license"] for k in (1, 2, 3, 4)] == ["apache-2.0", "mit-grant", "all-rights-reserved", None]
    assert got[1]["unit"] == "licensed under the apache license version 2 0" and got[1]["dice"] == got[2]["dice"] == got[3]["dice"] == 1
    one = licenses.scan(spark.createDataFrame([(1, "so wtfpl it is")], "doc_id long, text string"), {"wtfpl": "WTFPL"}).first()
    assert (one["license"], one["unit"]) == ("wtfpl", "wtfpl")


def test_windows_equal_brute_force():
    import random

    rng = random.Random(4)
    for grams in (["p q", "q r", "r p", "p s", "s q"], ["q p", "p p"]):
        vocabulary = {tuple(g.split()): ["a"] for g in grams}
        for _ in range(300):
            w = [rng.choice("ppqqrrsx") for _ in range(rng.randrange(2, 26))]
            want = 0
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    own = {f"{a} {b}" for a, b in zip(w[i:j], w[i + 1 : j], strict=False)}
                    want = max(want, 2 * len(own & set(grams)) / (len(own) + len(grams)))
            got = licenses.best_windows(w, {"a": grams}, vocabulary, 0.8)
            assert (-got[0] if got else 0) == (want if want >= 0.8 else 0)


@pytest.mark.parametrize("size", [1, 2, 7, 60])
def test_size_bounds_lose_nothing(size):
    for n in range(1, 400):
        if 2 * min(n, size) / (n + size) >= 0.8:
            assert n in licenses.admissible(size, 0.8)


# ---- near-duplicates ------------------------------------------------------------------------------------------


def brute_near(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_dedup(spark, folder, odd):
    got = {i: tuple(r)[1:] for i, r in by_id(near_dedup.op7_near_dedup(spark, folder)).items()}
    assert got == brute_near(texts(odd).items())


def test_near_dedup_of_a_drifting_family(spark):
    import random

    rng = random.Random(3)
    text = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(150):
        text = list(text)
        text[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.score(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == brute_near(rows)


def test_near_dedup_repeated_rows(spark, repeated, empty):
    out = near_dedup.filter_documents(repeated)
    assert out.columns == repeated.columns
    assert out.where("text is not null and text like 'w%'").groupBy("text").count().where("count > 1").count() == 0
    assert near_dedup.score(empty, 0.85).count() == 0 and near_dedup.filter_documents(empty).count() == 0


def test_odd_sketch_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        b = np.concatenate([a[:450], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        x = near_dedup.parity(np.unique(a)) ^ near_dedup.parity(np.unique(b))
        assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x) <= 90


# ---- language model ----------------------------------------------------------------------------------------------


def test_base_scores_and_counts(spark, folder, odd):
    got = by_id(hmm.op8_hmm(spark, folder))
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts(odd).items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] <= 1e-9


def test_forward_recursion_sums_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    chain = hmm.Chain.learnt(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((hmm.STATES, 6)))
    seq = np.array([0, 3, 5])
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=3):
        p = chain.start[path[0]] * chain.emits[path[0], seq[0]]
        for t in (1, 2):
            p *= chain.moves[path[t - 1], path[t]] * chain.emits[path[t], seq[t]]
        total += p
    got = chain.log_likelihood(np.array([*seq, 1, 2]), np.array([3, 2]))
    assert math.exp(got[0]) == pytest.approx(total)


def test_baum_welch_never_lowers_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(2)
    classes = np.concatenate([np.tile([0, 1, 0, 2], 20), np.tile([3, 4, 3, 5], 20), rng.integers(0, 6, 30)])
    sizes = np.array([80, 80, 30])
    chain = hmm.Chain.first(np.bincount(classes, minlength=6) / len(classes))
    before = chain.log_likelihood(classes, sizes).sum()
    for _ in range(6):
        start, moves, emits = chain.expected(classes, sizes)
        chain = hmm.Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
        after = chain.log_likelihood(classes, sizes).sum()
        assert after >= before - 1e-6
        before = after


def test_language_model_of_nothing(spark, empty, repeated):
    from pyspark.sql import functions as F

    out = hmm.score(_spark_rows(repeated).withColumn("learn", F.lit(False))).collect()
    assert len(out) == repeated.count() and all(r["base_score"] == 0 and r["n_known"] == 0 for r in out)
    assert hmm.score(_spark_rows(empty).withColumn("learn", F.lit(True))).count() == 0


def _spark_rows(df):
    from lacuna.llm._spark import keyed

    return keyed(df.select("doc_id", "text"), "key").select("key", "text")


# ---- BPE ----------------------------------------------------------------------------------------------------------


def test_bpe_reuse_equals_the_library(spark, folder, odd):
    t = library("word_bpe_49k.json")
    got = by_id(bpe_reuse.op9_bpe_reuse(spark, folder))
    for doc, text in texts(odd).items():
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[doc][k] for k in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_chunks_move_with_their_content():
    import random

    rng = random.Random(4)
    text = " ".join(f"wörd{rng.randrange(10**6)}" for _ in range(4000))
    whole = bpe_reuse.chunks(text)
    assert "".join(whole) == text and len(whole) > 20
    moved = bpe_reuse.chunks("something else before. " + text)
    assert len(set(whole) & set(moved)) >= len(set(whole)) - 2


def test_shared_chunks_are_joined_exactly(spark):
    import random

    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefghij ',.") for _ in range(30000))
    rows = [(i, "x" * i + shared[i * 37 : 20000 + i * 91] + "tail" * i) for i in range(12)] + [(20, "z" * 9000), (21, "z" * 9000)]
    out = bpe_reuse.encode(spark.createDataFrame(rows, "key long, text string")).collect()
    t = library("word_bpe_49k.json")
    want = {k: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for k, x in rows}
    assert {r["key"]: r["ids_sha256"] for r in out} == want


def test_bpe_of_repeated_rows_and_nothing(repeated, empty):
    assert bpe_reuse.encode(_spark_rows(repeated)).count() == repeated.count()
    assert bpe_reuse.encode(_spark_rows(empty)).count() == 0


# ---- quality ----------------------------------------------------------------------------------------------------------


def brute_counts(text):
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, folder, odd):
    got = by_id(quality.op10_quality(spark, folder))
    for doc, text in texts(odd).items():
        r = got[doc]
        want = brute_counts(text)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[0]["kept"] and not got[11]["kept"]


def test_sketches_merge_and_bound_their_error(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    values = [rng.random() ** 3 for _ in range(2000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double").select("g", quality.bucket(F.col("v")).alias("bucket"))
    parts = df.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    row = quality.quantile(["all"], parts, 0.25, 0.75).first()
    for got, p in ((row["q0"], 0.25), (row["q1"], 0.75)):
        exact = sorted(values)[int(p * 2000) - 1]
        assert abs(got - exact) <= 0.06 * exact + 1e-4


def test_adaptive_fences_reject_the_odd_ones(spark):
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(f"word{rng.randrange(5000)}" for _ in range(120)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " | # $ ".join(f"word{rng.randrange(5000)}" for _ in range(120)), "en", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.filter_documents(docs).collect()}
    assert kept == set(range(400))


def test_quality_of_odd_tables(repeated, empty):
    assert quality.score(repeated).count() == repeated.count() and quality.score(empty).count() == 0
    out = quality.filter_documents(repeated)
    assert out.columns == repeated.columns
    assert quality.filter_documents(empty).count() == 0
