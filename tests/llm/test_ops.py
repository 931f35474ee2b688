"""Each operator against brute force, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import audio, chat, common, grid_join, langid, minhash, mixing, queries, sentencepieces, sharding, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, vid string, h long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), -1, 0.5, "x", 3) for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "", "en", "a"), (4, long, "en", "a"), (5, long, None, "b"), (None, "null id here", "en", None), (6, "same row", "de", "b"), (6, "same row", "de", "b"), (7, "  \n ", "fr", ""), (8, "\u0000 <|im_end|> \\ é 🙂 12", "fr", "c")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def brute_classes(texts, similarity=0.8):
    """Classes of equal texts, and of texts that share a five-word shingle and align."""
    words = {i: minhash.words_of(t) for i, t in texts.items()}
    seen, parent = defaultdict(set), {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, w in words.items():
        for k in range(max(1, len(w) - 4)) if w else ():
            seen[tuple(w[k : k + 5])].add(i)
    pairs = {(a, b) for s in seen.values() for a in s for b in s if a < b}
    for a, b in pairs:
        n, m = len(words[a]), len(words[b])
        row = list(range(m + 1))
        for x in range(n):
            new = [x + 1]
            for y in range(m):
                new.append(min(row[y] + (words[a][x] != words[b][y]), row[y + 1] + 1, new[y] + 1))
            row = new
        if 1 - row[m] / max(n, m) >= similarity:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: top(i) for i in texts}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    base = [[r.choice("abcdefghijklmnop") + str(r.randrange(300)) for _ in range(r.randrange(40, 90))] for _ in range(40)]
    rows, shared = [], [f"boiler{i}" for i in range(60)]
    for w in base:
        rows.append(" ".join(w))
        for _ in range(r.randrange(3)):
            v = list(w)
            for _ in range(len(v) // r.choice([50, 25, 15])):
                v[r.randrange(len(v))] = "edit"
            rows.append(" ".join(v))
    rows += [" ".join([*shared, *[r.choice("xyz") + str(r.randrange(500)) for _ in range(60)]]) for _ in range(30)]
    rows += [rows[0]] * 20
    got = {x.doc_id: x for x in minhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    want = brute_classes({i: t for i, t in enumerate(rows)})
    assert {i: x.class_id for i, x in got.items()} == want
    assert all(x.kept == (i == want[i]) for i, x in got.items())


def test_near_duplicates_of_a_hub(spark):
    """Hundreds of variants of one text, most too far from the least member of their bucket, are linked as all their pairs say."""
    r = random.Random(11)
    texts = []
    for _ in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(200):
            v = list(base)
            for k in r.sample(range(150), 18):
                v[k] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(v))
    shared = [f"s{k}" for k in range(60)]
    texts += [" ".join(shared + [f"u{r.randrange(10**6)}" for _ in range(60)]) for _ in range(100)]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    meet = defaultdict(set)
    for x in minhash.sketched(d).collect():
        for key in enumerate(x.sk):
            meet[key].add(x.doc_id)
    pairs = sorted({(a, b) for ids in meet.values() for a in ids for b in ids if a < b})
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), found in zip(pairs, minhash.word_distances([(minhash.words_of(texts[a]), minhash.words_of(texts[b])) for a, b in pairs])):
        if found is not None:
            a, b = sorted((root(a), root(b)))
            top[b] = a
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(d).collect()} == {i: root(i) for i in range(len(texts))}


def _planted(r, words, edits, shared=()):
    """A text of random words behind shared ones, and a copy with that many of its own words replaced."""
    base = [*shared, *[f"p{r.randrange(10**6)}" for _ in range(words)]]
    copy = list(base)
    for k in r.sample(range(len(shared), len(base)), edits):
        copy[k] = f"q{r.randrange(10**6)}"
    return " ".join(base), " ".join(copy)


def test_near_duplicates_inside_a_passage_that_all_share(spark):
    """Near copies in crowded buckets of otherwise unlike texts are all found, whichever way a bucket is compared."""
    r = random.Random(17)
    shared = [f"s{k}" for k in range(200)]
    texts = [t for _ in range(80) for t in _planted(r, 120, 25, shared)]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = [i // 2 * 2 for i in range(len(texts))]
    for crowd in (minhash.CROWD, 20):
        rows = minhash.classed(d, crowd=crowd).select("doc_id", minhash.id_of(F.col("component")).alias("c")).collect()
        assert [c for _, c in sorted((x.doc_id, x.c) for x in rows)] == want


def test_recall_of_sketches_by_similarity():
    """Share of pairs that meet in a bucket, by edit similarity: 0.9 or more down to the threshold."""
    r = random.Random(19)
    hashes = minhash._WordHash()
    for words in (60, 200, 800):
        for similarity, least in ((0.95, 1.0), (0.9, 0.99), (0.85, 0.97), (0.82, 0.92), (0.805, 0.88)):
            texts = [t.split() for _ in range(200) for t in _planted(r, words, int(words * (1 - similarity) + 1e-9))]
            sk = minhash.sketch_block(texts, hashes, minhash.SHINGLE, minhash.SKETCHES, minhash.PICKS)
            assert (sk[0::2] == sk[1::2]).any(1).mean() >= least, (words, similarity)


def test_node_ids_keep_the_order_of_doc_ids(spark):
    ids = [None, -(2**63), -5, 0, 7, 2**63 - 1]
    rows = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").select("doc_id", minhash.node_id(F.col("doc_id"), F.col("text")).alias("node"))
    got = rows.select("doc_id", minhash.id_of(F.col("node")).alias("back")).orderBy("node").collect()
    assert [x.doc_id for x in got] == [*ids[1:], None] and all(x.doc_id == x.back for x in got)


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    from attesta.llm import stages

    r = random.Random(13)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = f + " more"
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, d), (None, e), (4, e), (None, f), (None, near), (None, None), (8, None), (8, None)]
    out = stages.drop_near_duplicates(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]), "").collect()
    got = sorted(((x.doc_id, x.text) for x in out), key=str)
    one = next(t for i, t in got if t in (f, near))
    assert got == sorted([(None, a), (None, b), (7, c), (3, d), (4, e), (None, one), (None, None), (8, None)], key=str)


def test_near_duplicates_odd(spark, odd, empty):
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 2, True), (3, 2, False), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True), (6, 6, True), (7, 7, True), (8, 8, True)], key=str)
    assert minhash.near_duplicates(empty).count() == 0


def test_band_is_exact():
    r = random.Random(1)
    pairs = []
    for _ in range(200):
        a = [r.choice("abc") for _ in range(r.randrange(0, 25))]
        b = [x if r.random() > 0.15 else r.choice("abcd") for x in a if r.random() > 0.1]
        pairs.append((a, b))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        return new

    for similarity in (0.8, 0.5):
        for (a, b), d in zip(pairs, minhash.word_distances(pairs, similarity)):
            true = distance(a, b)
            assert d == (true if true <= int(max(len(a), len(b)) * (1 - similarity) + 1e-9) else None)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    assert got == {i: top(i) for i in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def water_fill(sizes, weights, most=3):
    left, targets = dict(sizes), {}
    total = sum(sizes.values())
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if most * sizes[s] <= total * weights[s] / w]
        if not over:
            return targets | {s: total * weights[s] / w for s in left}
        for s in over:
            targets[s] = most * sizes[s]
        total -= sum(targets[s] for s in over)
        left = {s: v for s, v in left.items() if s not in over}
    return targets


def test_mixing(spark, odd, empty):
    r = random.Random(3)
    rows = [(i, " ".join("w" * 1 for _ in range(r.randrange(0, 40))), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    got = mixing.mixed(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    ranks = {s: i for i, s in enumerate([*sorted(x for x in sizes if x is not None), None])}
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for s, i in ranks.items()})
    source = {i: s for i, _, _, s in rows}
    taken = defaultdict(int)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        assert x.taken == sum(c.words for c in x.copies)
        taken[s] += x.taken
    assert all(taken[s] == int(want[s] + 0.5) for s in sizes)
    again = {x.doc_id: (x.taken, x.position) for x in mixing.mixed(docs(spark, rows).repartition(7)).collect()}
    assert again == {x.doc_id: (x.taken, x.position) for x in got}
    order = [x.position for x in mixing.ordered_for_training(mixing.mixed(docs(spark, rows))).collect() if x.position is not None]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= sum(sizes.values()) + 1e-6
    o = mixing.mixed(odd).collect()
    assert len(o) == 10 and sum(x.taken for x in o) > 0 and mixing.mixed(empty).count() == 0


def test_schedule_inverts(spark):
    knots = ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6))
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.time_of(F.col("u"), knots))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    for u, t in df.collect():
        grid = np.linspace(0, t, 2001)
        rate = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        assert abs(((rate[1:] + rate[:-1]) / 2 * np.diff(grid)).sum() / whole - u) < 1e-6


def brute_segments(scores):
    """Maximal segments by their definition: split at the best segment, again and again."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_are_maximal():
    r = random.Random(4)
    for _ in range(150):
        scores = [r.choice([-3.0, -1.0, -0.5, 1.0, 2.0, 2.5]) + r.random() / 100 for _ in range(r.randrange(0, 14))]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(scores, float))] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_toxicity(spark, odd, empty):
    r = random.Random(6)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    words = [w.replace("w", "lo") for w in words]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = [r.choice(words) for _ in range(r.randrange(5, 60))]
        if bad:
            for _ in range(r.randrange(2, 6)):
                t.insert(r.randrange(len(t) + 1), r.choice(["scumbag", "idiotic", "moronic"]))
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = toxicity.fitted(d, lab)
    got = {x.doc_id: x for x in toxicity.scored(d, model, keep=("source",)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.99 * len(held)
    x = got[next(i for i in held if i % 6 == 0)]
    ws = toxicity.tokens(rows[x.doc_id][1])
    assert any(w in ("scumbag", "idiotic", "moronic") for p in x.passages for w in ws[p.start : p.end])
    o = toxicity.scored(odd, model).collect()
    assert len(o) == 10 and all(0 <= y.score <= 1 for y in o)
    assert toxicity.scored(empty, model).count() == 0
    bare = toxicity.scored(odd, toxicity.fitted(odd, lab.where("false"))).collect()
    assert len(bare) == 10 and not any(y.predicted for y in bare)


def test_toxicity_equals_brute_force(spark):
    """Unit counts, log-odds, bursts, segments, calibration and scores from their definitions; a model doesn't depend on how rows are dealt."""
    import math

    r = random.Random(30)
    words = [f"lo{a}{b}" for a in "abcdefgh" for b in "ijklm"]
    rows, labels = [], []
    for i in range(500):
        t = [r.choice(words) for _ in range(r.randrange(4, 50))]
        if i % 5 == 0:
            t[2:2] = [r.choice(["scumbag", "scumbags", "idiotic"]) for _ in range(r.randrange(1, 4))]
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 0, int(i % 5 == 0)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(d, lab)
    again = toxicity.fitted(d.repartition(7), lab.repartition(3))
    assert again.weights == model.weights and (again.lam, again.log_k, again.final) == (model.lam, model.log_k, model.final)
    free = {t: y for (i, t, _, _), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 4 != 2}
    sample = [(x.text, x.toxic) for x in toxicity.labelled_sample(d, lab).collect()]
    assert all(free[t] == y for t, y in sample) and len(sample) > 0.9 * len(free)  # some share their least shingle by chance
    learn = [(t.split(), y) for t, y in sample]
    counts = defaultdict(lambda: [0, 0])
    for ws, y in learn:
        for u in {w for w in ws} | {w[:n] + "*" for w in ws for n in toxicity.PREFIXES if len(w) > n}:
            counts[u][0 if y else 1] += 1
    n1, n0 = (sum(c[k] for c in counts.values()) for k in (0, 1))
    prior = toxicity.PRIOR * (n1 + n0)
    for u, d1 in model.weights.items():
        y1, y0 = counts[u]
        a = prior * (y1 + y0) / (n1 + n0)
        odds = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        assert d1 == 0 or abs(odds - d1) < 1e-9 and abs(odds) >= toxicity.LEAST_Z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) - 1e-9

    def values(ws):
        out, met = [], defaultdict(int)
        for w in ws:
            v = next((model.weights[u] for u in [w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n)] if u in model.weights), 0.0)
            met[w] += v > 0
            out.append((v / met[w] if v > 0 else v) - toxicity.COST)
        return out

    clean = [values(ws) for ws, y in learn if not y]
    binned = [math.floor(max(-8, min(v, 7.99)) * 4) / 4 + 0.125 for vs in clean for v in vs]
    assert abs(sum(math.exp(model.lam * v) for v in binned) / len(binned) - 1) < 1e-6 or model.lam == 1.0
    tops = [(max(s for _, _, s in found), len(vs)) for vs in clean if (found := brute_segments(vs))]
    assert not tops or abs(sum(model.lam * s - math.log(n) for s, n in tops) / len(tops) - 0.5772 - model.log_k) < 1e-6
    got = {x.doc_id: x for x in toxicity.scored(d, model).collect()}
    for i, t, _, _ in rows[:120]:
        vs = values(t.split())
        e = [model.lam * s - model.log_k - math.log(len(vs)) for _, _, s in brute_segments(vs)]
        good = [x for x in e if math.exp(-x) <= toxicity.SIGNIFICANT]
        x = [max(-10, min(max(e, default=-model.log_k - math.log(len(vs))), 30)), min(sum(good), 60) / 4, math.log1p(len(good)), 1]
        z = sum(a * b for a, b in zip(x, model.final))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and len(got[i].passages) == len(good)


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_toxicity_of_balanced_and_mostly_toxic_labels(spark, share):
    r = random.Random(12)
    words = [f"lo{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows, bad = [], {}
    for i in range(600):
        bad[i] = r.random() < share
        t = [r.choice(words) for _ in range(r.randrange(15, 60))]
        if bad[i]:
            t[3:3] = [r.choice(["scumbag", "idiotic", "moronic"]) for _ in range(3)]
        rows.append((i, " ".join(t), "en", "s"))
    d = docs(spark, rows)
    model = toxicity.fitted(d, spark.createDataFrame([(i, 1, int(b)) for i, b in bad.items()], "doc_id long, quality int, toxic int"))
    assert all(model.weights.get(w, 0) > toxicity.COST for w in ("scumbag", "idiotic", "moronic"))
    held = [x for x in toxicity.scored(d, model).collect() if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(x.predicted == bad[x.doc_id] for x in held) >= 0.99 * len(held)


def test_chat_fold_and_render(spark):
    e = spark.createDataFrame(
        [(1, 1, 0, "delta", "user", "he"), (1, 2, 0, "delta", None, "llo"), (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 1, "regenerate", "assistant", "go"), (1, 5, 1, "delta", None, "od"), (1, 6, 2, "delta", "user", "thanks"), (1, 7, 0, "edit", "user", "hi"),
         (2, 1, 0, "delta", "user", "a"), (2, 2, 1, "delta", "assistant", "b"), (2, 3, 2, "delta", "user", "c"), (2, 4, 1, "regenerate", "assistant", "d"), (3, 1, 0, "odd", None, None), (None, 1, 0, "delta", "x", "y")],
        "conv_id long, seq long, msg long, kind string, role string, text string",
    )
    got = defaultdict(list)
    for r in chat.folded(e).orderBy("conv_id", "msg").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {1: [("user", "hi"), ("assistant", "good"), ("user", "thanks")], 2: [("user", "a"), ("assistant", "d")], 3: [("", "")], None: [("x", "y")]}


def test_chat_round_trip(spark):
    nasty = ["", "\\", "<|", "<\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "a<", "|x", "é🙂\n\\n", "<|im_end|><|im_start|>assistant ok", None, "\\\\<|"]
    roles = ["user", "assistant", "a\nb", "<|im_end|>", None, "x\\"]
    rows = [(c, i, roles[(c + i) % len(roles)], nasty[(c * 3 + i) % len(nasty)]) for c in range(8) for i in range(7)]
    df = spark.createDataFrame(rows + [(9, 0, "user", "b"), (9, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.rendered(chat.folded(chat.events_of_turns(df)))).collect()
    by = defaultdict(list)
    for c, i, role, t in rows + [(9, 0, "user", "b"), (9, 0, "assistant", "a")]:
        by[c].append((i, role or "", t or ""))
    assert len(out) == len(by)
    for r in out:
        turns = [(role, t) for _, role, t in sorted(by[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.rendered(chat.folded(chat.events_of_turns(df.where("false"))))).count() == 0


TEXTS = ["", "a", " a", "a  b", "a   b\n\n c ", "Hello, world! It's 5,000.\nNew", "ﬁ① x", "a" * 700, "\n\n\n", "日本語 🙂", "<s> </s> <0x0A> <|endoftext|>", "don't.\n", "éa.\nÀb,", "x\t y \n z", "  ", "foo.bar_baz(qux);", "▁ab ▁"]


def test_pieces_equal_the_library(spark, sf, odd, empty):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_BPE)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    m = sentencepieces.Model(path)
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    for _ in range(2):  # once new, once known
        ids, counts = m.encode(texts)
        cut = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == want
    for t, i in zip(texts, want):
        assert m.decode(i) == t.replace("▁", " ")
    got = sentencepieces.encoded(odd, path, keep=("source",)).collect()
    assert len(got) == 10 and all(r.round_trip for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert sentencepieces.encoded(empty, path).count() == 0


def test_suffix_array():
    r = random.Random(8)
    s = "".join(r.choice("abc") for _ in range(300))
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    got = sentencepieces.suffix_array(codes, 300)
    assert got.tolist() == sorted(range(300), key=lambda i: s[i:])


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_BPE)
    enc, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    r = random.Random(9)
    texts = TEXTS + ["".join(r.choice(" \n\tab.,'é1") for _ in range(40)) for _ in range(300)]
    ids, counts = enc.encode(texts)
    cut = np.concatenate([[0], np.cumsum(counts)])
    for t, a, b in zip(texts, cut[:-1], cut[1:]):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(queries.tokenizer_path(queries.BYTE_BPE), encoding="utf-8") as f:
        spec = json.load(f)
    assert token_files.splits_at_spaces(spec)
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    enc, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    ids, counts = enc.encode(TEXTS)
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert not enc.splits and all(ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids for t, a, b in zip(TEXTS, cut[:-1], cut[1:]))


def test_interned_shrinks():
    from attesta.llm.interned import Interned

    it = Interned(lambda ps: (np.array([ord(c) for p in ps for c in p], np.int32), np.array([len(p) for p in ps])), most=30)
    for n in range(50):
        words = [f"w{n}", "often", f"x{n % 3}", ""]
        ids, counts = it.ids(words, [3, 1])
        assert "".join(map(chr, ids)) == "".join(words) and counts.tolist() == [sum(map(len, words[:3])), 0]
    assert len(it.known) <= 34


def test_language(spark, sf, odd, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    held = [(r.doc_id, r.lang) for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == l for i, l in held) >= 0.9 * len(held)
    o = langid.identify(odd, keep=("source",)).collect()
    assert len(o) == 10 and {r.lang_pred for r in o if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.identified(odd, {}).collect())


def test_cross_parsing_is_greedy():
    """Phrases equal those of a search for the longest match at each place, in dense and in sorted tables, whatever the length."""
    texts = {"x": ["abcabd"], "y": ["zzzz abc"], "z": ["\u4e2d\u6587\u4e2d\u56fd \u6587"]}
    samples = ["abcabd", "zzzz abc", "\u4e2d\u6587\u4e2d\u56fd \u6587"]

    def phrases(s, sample):
        n, i = 0, 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i : i + k] in sample:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    r = random.Random(10)
    lines = [" ".join("".join(r.choice("abcdz\u4e2d\u6587\u56fd\u65e5 ") for _ in range(r.choice([1, 5, 20, 700]))).split()) for _ in range(150)]
    lines = [x for x in lines if x]
    for dense in (langid.DENSE_BYTES, 0):
        p = langid.CrossParser(texts, dense_bytes=dense)
        got = p.phrases([langid.letters(x) for x in lines])
        assert got.tolist() == [[phrases(x, s) for s in samples] for x in lines]


def test_language_of_twelve_scripts():
    """Scripts with few and with thousands of letters are told apart."""
    blocks = {"ar": 0x627, "bn": 0x995, "el": 0x3B1, "he": 0x5D0, "hi": 0x915, "hy": 0x561, "ja": 0x3041, "ka": 0x10D0, "ko": 0xAC00, "ru": 0x430, "th": 0xE01, "zh": 0x4E00}
    sizes = {"ja": 80, "ko": 2000, "zh": 3000}
    r = random.Random(4)

    def text(lang, n):
        letters = [chr(blocks[lang] + i) for i in range(sizes.get(lang, 25))]
        return " ".join("".join(letters[min(len(letters) - 1, int(r.expovariate(8 / len(letters))))] for _ in range(r.randrange(2, 8))) for _ in range(n))

    parser = langid.CrossParser({k: [text(k, 400) for _ in range(8)] for k in blocks})
    asked = [(k, text(k, 30)) for k in blocks for _ in range(20)]
    found, _ = parser.predict([t for _, t in asked])
    assert sum(f == k for f, (k, _) in zip(found, asked)) >= 0.95 * len(asked)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    d = docs(spark, [(i, "some text", f"l{i % 8}", "s") for i in range(100)])
    with pytest.raises(ValueError):
        langid.training_texts(d)


def test_sharding(spark, odd, empty):
    rows = [(i, "x" * (i * 37 % 900), "en", "s") for i in range(1500)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    loads, places = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][1]) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode()) and r.grown_shard is None
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(loads) == list(range(16)) and max(loads.values()) <= 1.01 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sum(1 for r in got if r.shard != r.vslot % 16) < 0.4 * len(got)  # the map is edited, not made anew
    o = sharding.shard_documents(odd).collect()
    assert len(o) == 10 and {(r.size, r.text_crc32) for r in o if r.doc_id == 1} == {(1, 0)}
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_equals_brute_force(spark, tmp_path):
    """Slots, the edited map and places in shards, all from their definitions; a third of the rows has one id."""
    r = random.Random(21)
    rows = [(None if i % 11 == 0 else 7 if i % 3 == 0 else i, r.choice([None, "", "é" * r.randrange(400), f"t{i}" * r.randrange(90)]), "en", "s") for i in range(1200)]
    maps = f"file://{tmp_path}/maps"
    got = sorted((str(x.doc_id), x.size, x.text_crc32, x.shard, x.slot, x.vslot) for x in sharding.shard_documents(docs(spark, rows), maps=maps).collect())
    slots = defaultdict(list)
    for i, t, _, _ in rows:
        v = int(hashlib.sha256(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:8], 16) % sharding.SLOTS
        slots[v].append(((i is not None, i or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    weight = {v: sum(x[1] for x in rs) for v, rs in slots.items()}
    mean = sum(weight.values()) / 16
    home, loads, movers = {}, [0] * 16, []
    for s in range(16):
        total = 0
        for v in sorted((v for v in weight if v % 16 == s), key=lambda v: (-weight[v], v)):
            total += weight[v]
            if total <= mean:
                home[v] = s
                loads[s] += weight[v]
            else:
                movers.append(v)
    for v in sorted(movers, key=lambda v: (-weight[v], v)):
        home[v] = loads.index(min(loads))
        loads[home[v]] += weight[v]
    want, place = [], defaultdict(int)
    for v in sorted(slots):
        for (some, i), size, crc in sorted(slots[v]):
            want.append((str(i if some else None), size, crc, home[v], place[home[v]], v))
            place[home[v]] += 1
    assert got == sorted(want) and max(loads) <= 1.05 * min(loads)
    # the table of maps keeps all versions, and the next is an edit of the last
    first, second = ({x.vslot: x.shard for x in sharding.read_map(spark, maps, k).collect()} for k in (1, 2))
    assert first == {v: v % 16 for v in slots} and second == home
    grown = sharding.read_map(spark, maps).select("vslot", (F.col("bytes") + F.when(F.col("vslot") < 2000, 500).otherwise(0)).alias("bytes"), "n")
    third = {x.vslot: x.shard for x in sharding.rebalanced(spark, maps, grown).collect()}
    assert third.keys() == second.keys() and third != second and {x.vslot: x.shard for x in sharding.read_map(spark, maps, 2).collect()} == second


def test_token_files(spark, odd, empty, tmp_path):
    path = queries.tokenizer_path(queries.BYTE_BPE)
    out = str(tmp_path / "tokens")
    manifest = token_files.write_tokens(odd, path, "file://" + out, end_id=0)
    got = token_files.read_tokens(spark, manifest, "file://" + out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[1].n_tokens == 1
    for row in manifest.collect():
        with open(row.path, "rb") as f:
            reader = token_files.Reader(f)
            assert list(reader.documents([4])) in ([4], []) and sum(len(i) for _, i in reader) == row.ids
            assert len(reader.frames) == len(reader.index) and [int(n) // 4 for n in reader.frames[:, 1]] == reader.index["ids"].tolist()
    first = manifest.orderBy("part").first()
    data = bytearray(open(first.path, "rb").read())
    data[6] ^= 0xFF
    bad = tmp_path / "bad"
    bad.write_bytes(data)
    with pytest.raises(Exception), open(bad, "rb") as f:  # noqa: B017
        list(token_files.Reader(f))
    assert token_files.round_trip(empty, path).count() == 0


def test_grid_join(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(12, 16))
    v = np.concatenate([c + r.normal(size=(25, 16)) * s for c, s in zip(centres, np.linspace(0.02, 0.5, 12))]).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 40, 0), 2 * v[5:6]])
    rows = [(i, x.tolist(), 0, 1) for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 0, 1), (n + 1, [0.0] * 16, 0, 1), (n + 2, [float("nan")] * 16, 0, 1), (n + 3, [], 0, 1), (n + 4, [1.0, None] + [0.0] * 14, 0, 1), (None, v[0].tolist(), 0, 1), (n + 5, v[0].tolist()[:8], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vid int")
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[close[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    for block in (2048, 32):
        got = {x.vec_id: x for x in grid_join.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        assert [got[i].n_links for i in range(n)] == close.sum(1).tolist() and [got[i].component_id for i in range(n)] == label.tolist()
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, n + 6))
    assert grid_join.near_vectors(df.where("false")).count() == 0


def slow_features(payload: bytes):
    """Features from their definitions: zero-stuffed convolution, one transform a frame, loops over frames and parts."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hanning(n + 2)[1:-1]
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    y = np.convolve(stuffed, h / h.sum() * up)[: len(stuffed)][::down]
    y = np.concatenate([y, np.zeros(max(0, audio.WINDOW - len(y)))])
    rate = audio.RATE * up / down
    frames = [y[i : i + audio.WINDOW] for i in range(0, len(y) - audio.WINDOW + 1, audio.HOP)]
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 50 / 700), 2595 * np.log10(1 + rate / 2 / 700), audio.BANDS + 2) / 2595) - 1)
    mel = []
    for f in frames:
        power = np.abs(np.fft.rfft(f * np.hanning(audio.WINDOW))) ** 2
        at = np.arange(len(power)) * rate / audio.WINDOW
        mel.append([np.log10(sum(p * max(0, min((q - lo) / (mid - lo), (hi - q) / (hi - mid))) for p, q in zip(power, at)) + 1e-6) for lo, mid, hi in zip(edges, edges[1:], edges[2:])])
    energy = [10 * np.log10(np.mean(f**2) + 1e-9) for f in frames]
    middle, spans, start = np.median(energy), [], None
    for i, e in enumerate([*energy, -1e9]):
        if start is None and e >= middle + audio.OPEN_DB:
            start = i
        elif start is not None and e < middle + audio.CLOSE_DB:
            spans.append((start, i))
            start = None
    out = []
    for a, b in spans or [(0, len(frames))]:
        parts = []
        for k in range(audio.PARTS):
            lo, hi = a + k * (b - a) // audio.PARTS, a + (k + 1) * (b - a) // audio.PARTS
            hi = min(max(hi, lo + 1), b)
            parts.append(np.mean(mel[min(lo, hi - 1) : hi], axis=0))
        out.append((a * audio.HOP * 1000 / rate, ((b - 1) * audio.HOP + audio.WINDOW) * 1000 / rate, np.array(parts)))
    return out


def test_audio(spark, odd, empty, tmp_path):
    by = {r.doc_id: r for r in audio.round_trip(odd).collect()}
    assert by[1].n_bytes == 0 and by[1].payload_bytes == 576 and by[4].feature == by[5].feature and by[4].media_sha256 == by[5].media_sha256
    for r in odd.collect():
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        x = by[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert x.media_bytes == len(p) + 44 and x.n_segments >= 1
    assert audio.round_trip(empty).count() == 0
    assert audio.from_wav(audio.to_wav(b"abc"))[0] == b"abc" and audio.features(b"") == []
    none = spark.createDataFrame([(1, None, None)], "doc_id long, n_bytes long, media binary")
    row = audio.read_features(spark, audio.write_features(none, f"file://{tmp_path}/none"), f"file://{tmp_path}/none").first()
    assert row.feature is None and row.n_segments is None and row.payload_bytes is None


def test_stored_tensors_equal_brute_force(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 20 = 0")
    base = f"file://{tmp_path}/tensors"
    manifest = audio.write_features(audio.stored(d), base)
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    seen = {}
    for row in manifest.collect():
        with open(row.path, "rb") as f:
            for batch in audio.stored_rows(f):
                assert batch.schema.field("segments").type.value_type.field("mel").type == audio.TENSOR
                seen |= dict(zip(batch.column("doc_id").to_pylist(), zip(audio.tensors_of(batch), batch.column("payload_sha256").to_pylist())))
    assert seen.keys() == texts.keys()
    for i, ((start, end, mel), digest) in seen.items():
        payload = audio.padded(texts[i])
        want = slow_features(payload)
        assert digest == hashlib.sha256(payload).hexdigest() and len(start) == len(want)
        assert np.allclose(start, [w[0] for w in want]) and np.allclose(end, [w[1] for w in want]) and np.allclose(mel, np.stack([w[2] for w in want]), atol=2e-3)
    got = {r.doc_id: r.feature for r in audio.read_features(spark, manifest, base).collect()}
    assert got == {i: audio.feature_text(*t) for i, (t, _) in seen.items()}


def test_resampling_and_segments():
    x = np.random.default_rng(12).normal(size=101).astype(np.float32)
    up, down, taps = 2, 3, 12
    rows = audio._phases(up, down, taps)
    h = np.zeros(up * taps)
    for p in range(up):
        h[p::up] = rows[p][::-1]
    full = np.convolve(np.repeat(x, up) * np.tile([1, 0], len(x)), h)[: len(x) * up]
    assert np.allclose(audio.resampled(x, up, down, taps), full[::down], atol=1e-4)
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / audio.RATE)
    mel, _ = audio.log_mel(audio.resampled(tone.astype(np.float32)), audio.RATE * up / down)
    bank = audio.mel_bank(audio.RATE * up / down)
    assert mel.mean(0).argmax() == bank[round(1000 / (audio.RATE * up / down) * audio.WINDOW)].argmax()
    assert audio.energetic(np.array([0, 5, 3, 3, 0, 3, 5.0]), 4, 2) == [(1, 4), (6, 7)]
