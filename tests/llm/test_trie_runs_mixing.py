"""The trie of conversations, runs of words and mixtures against plain versions and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lacuna.llm import mixing, periodic, prefix_trie

WORD = "[^\x20\x09-\x0d]+"


# ---- prefix trie ---------------------------------------------------------------------------------


def plain_trie(rows):
    conversations = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            conversations[c].append(((turn is not None, turn or 0), digest, role or "", text or ""))
    conversations = {c: [x[2:] for x in sorted(v)] for c, v in conversations.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        made = tuple(conversations.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        ends[made].append(c)
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
    children, leaves, saved = (collections.Counter() for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()
    )


def some_conversations(seed, n, alike=0.3):
    rng = random.Random(seed)
    opening = [("user", "hello there"), ("assistant", "hi"), ("user", "the same long turn again")]
    rows = []
    for c in range(n):
        hot = rng.random() < alike
        made = [*opening] if hot else []
        made += [(rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randrange(3)))) for _ in range(0 if hot and rng.random() < 0.6 else rng.randrange(5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(made)]
    rows += [(999, t, "user", f"turn {t // 2}") for t in range(300)] + [(1000, t, "user", f"turn {t // 2}") for t in range(300)]
    rows += [(5, None, None, None), (7, 1, None, "x"), (7, 1, "user", None), (None, 1, "user", "nobody's"), (-3, 0, "user", "negative"), (-20, 0, "user", "base")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "fan"), [(50_000, 20_000), (5, 16)])
def test_trie_is_the_plain_one(spark, monkeypatch, block, fan):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)  # tasks of a local session share the module
    rows = some_conversations(block, 160)
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    paths = prefix_trie.rebuilt(conversations)
    got = sorted(tuple(r) for r in prefix_trie.trie(paths, fan).collect())
    assert got == plain_trie(rows)


def united_in_blocks(paths, sizes):
    """The complete nodes of blocks of paths and of what they leave, merged once."""
    nodes, outer, at = [], [], 0
    for n in sizes:
        part = paths[at : at + n]
        at += n
        if part:
            forest = prefix_trie.Forest([p for _, p in part], [[1] * (len(p) // 16) for _, p in part], [{len(p) // 16: [1, c, 0, 0, 0]} for c, p in part], False)
            nodes += [(forest.depth[k], *forest.value[k]) for k in range(len(forest.depth)) if forest.same[k] == k and forest.side[k] < 0]
            outer += [(part[i][1], forest.outer[side]) for side, i in enumerate({0: 0, len(part) - 1: 0})]
    top = prefix_trie.Forest([p for p, _ in outer], [[1] * (len(p) // 16) for p, _ in outer], [dict(h) for _, h in outer], True)
    return sorted(nodes + [(top.depth[k], *top.value[k]) for k in range(len(top.depth)) if top.same[k] == k])


def test_blocks_of_any_size_make_one_forest():
    rng = random.Random(3)
    for _ in range(200):
        paths = sorted((bytes(b for _ in range(rng.randrange(6)) for b in [rng.randrange(2)] * 16), c) for c in range(rng.randrange(1, 30)))
        paths = [(c, p) for p, c in paths]
        one = united_in_blocks(paths, [len(paths)])
        sizes = [rng.randrange(1, 6) for _ in paths]
        assert united_in_blocks(paths, sizes) == one


def test_trie_of_copies_of_one_conversation(spark):
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(3000) for t in range(3)]
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(rows) and len(got) == 4


def test_trie_of_nothing_and_other_columns(spark):
    schema = "conv_id long, turn long, role string, text string, path string, words int, kind string, turns int"
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", "a b", "p", 1, "k", 2), (2, 0, "user", "a b", "p", 1, "k", 2)]
    got = sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, schema))).collect())
    assert got == plain_trie([r[:4] for r in rows])


@pytest.mark.parametrize(("a", "b", "n"), [(b"", b"x" * 16, 0), (b"x" * 32, b"x" * 48, 2), (b"x" * 16 + b"y" * 16, b"x" * 16 + b"z" * 16, 1), (b"x" * 160 + b"a" * 16, b"x" * 160 + b"b" * 32, 10)])
def test_common_prefixes(a, b, n):
    assert prefix_trie.common(a, b) == prefix_trie.common(b, a) == n


# ---- runs ----------------------------------------------------------------------------------------


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        t = p
        while t < len(words):
            if words[t] != words[t - p]:
                t += 1
                continue
            start = t - p
            while t < len(words) and words[t] == words[t - p]:
                t += 1
            if t - start >= max(24, 3 * p):
                found.setdefault((start, t), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def repetitive(rng):
    words, many = [], rng.choice([1, 2, 3, 60])
    for _ in range(rng.randrange(1, 6)):
        words += [rng.randrange(many) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 7) + [rng.randrange(many) for _ in range(rng.randrange(20))]
    return words


def as_hashes(words):
    return np.array([(x + 1) * 0x9E3779B97F4A7C15 % 2**64 for x in words], np.uint64)


def test_runs_are_the_plain_ones_however_words_are_appended():
    rng = random.Random(8)
    for _ in range(150):
        words = repetitive(rng)
        w = as_hashes(words)
        whole, bit = periodic.Catchers(), periodic.Catchers()
        whole.append(w)
        at = 0
        while at < len(w):
            step = rng.choice([1, 1, 3, 50])
            bit.append(w[at : at + step])
            at += step
        want = plain_runs(words)
        assert whole.runs() == bit.runs() == want
        assert periodic.runs_of([w, w[:30], w[:0], w]) == [want, plain_runs(words[:30]), [], want]


@pytest.mark.parametrize("words", [["a"] * 23, ["a"] * 24, list("ab") * 12, (list("ab") * 12)[:-1], [str(i) for i in range(10)] * 3, [str(i) for i in range(10)] * 3 + ["0"], ([str(i) for i in range(10)] * 3)[:-1], ["x"] * 30 + ["y"] + ["x"] * 30])
def test_runs_at_the_limits(words):
    assert periodic.runs_of([as_hashes([sum(map(ord, w)) * 7 + len(w) for w in words])])[0] == plain_runs(words)


def plain_row(doc, text):
    words = re.findall(WORD, text or "")
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(kept))


def test_runs_of_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng)) if i % 3 else " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(200)))) for i in range(120)]
    rows += [(None, "a " * 40), (None, None), (500, ""), (501, " \n "), (502, "é " * 30), (502, "é " * 30), (503, "x y " * 30)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_runs int, period string")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in periodic.find(docs).collect())
    assert got == collections.Counter((doc, *plain_row(doc, text)) for doc, text in rows)
    assert periodic.find(docs.limit(0)).count() == 0


def test_runs_of_a_long_text(spark):
    text = "one two three " * 60_000
    row = periodic.find(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 180_000, 3)


# ---- mixing --------------------------------------------------------------------------------------


def plain_targets(size, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(size.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        got = {s: (budget - sum(full.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: most * size[s] for s in rest if got[s] > most * size[s]}
        if not over:
            return full | got
        full |= over


def some_documents(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "é", None, "c", "Z", "empty"]
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 5) if i % 40 else [])[:20_000], rng.choices(sources[:6], [30, 3, 2, 2, 1, 1])[0]) for i in range(n)]
    return [*rows, (n, None, "empty"), (n + 1, "", "empty"), (n + 2, " ", None)]


@pytest.mark.parametrize("seed", [1])
def test_mix_meets_its_targets(spark, seed):
    rows = some_documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = collections.Counter()
    for i, text, source in rows:
        assert got[i]["size"] == len(re.findall(WORD, text or ""))
        size[source] += got[i]["size"]
    want = plain_targets(size)
    taken = collections.Counter()
    for i, _, source in rows:
        assert got[i]["source_size"] == size[source] and got[i]["target"] == pytest.approx(want[source], rel=1e-9)
        assert got[i]["taken"] in (0, got[i]["size"], 2 * got[i]["size"])
        taken[source] += got[i]["taken"]
    for source, target in want.items():
        shortest = min((got[i]["size"] for i, _, s in rows if s == source and got[i]["size"]), default=0)
        assert abs(taken[source] - target) <= max(0.02 * target, shortest)
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == got


def test_rates_solve_the_dual(spark):
    """Under its constraint no other rates are closer to one copy each: the logarithms of rates within the bound are linear in size."""
    rows = mixing.sized(spark.createDataFrame(some_documents(5), "doc_id long, text string, source string"))
    sources = mixing.targets(rows)
    histogram = rows.where("size > 0").groupBy("g", "size").count().withColumnRenamed("count", "n")
    state = {r["g"]: r for r in mixing.solved(histogram, sources).collect()}
    sums = collections.Counter()
    for r in histogram.collect():
        s = state[r["g"]]
        sums[r["g"]] += r["n"] * r["size"] * (2 if s["tilt"] is None else min(2, math.exp(min(s["tilt"] * r["size"] / s["mean"], 5))))
    for g, s in state.items():
        assert sums[g] == pytest.approx(s["target"], rel=1e-8)


def test_mix_of_odd_tables(spark, repeated, empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(repeated).count() == repeated.count()
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2


def test_documents_come_as_often_as_the_mix_says(spark, odd):
    number = {r["doc_id"]: r["copies"] for r in mixing.mix(odd).collect()}
    made = mixing.repeat_documents(odd)
    assert made.columns == odd.columns
    got = collections.Counter(r["doc_id"] for r in made.collect())
    assert {i: got[i] for i in number} == number
