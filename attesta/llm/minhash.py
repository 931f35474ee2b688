"""Near-duplicate classes by Order MinHash and banded alignment.

A sketch takes the ``picks`` least of a document's occurrence-labelled five-word shingles under one hash and keeps
them in text order (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019), so equal sketches
speak for a small edit distance, not just for common shingles. Documents that share a sketch are candidates;
banded alignment of their words verifies each candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, drop_path, written

SHINGLE, SKETCHES, PICKS, SIMILARITY = 5, 72, 2, 0.8
POSITION_BITS = 24
#: A bucket with more members is crowded. Texts and words of one block of crowded texts, and bins of the word counts that bound a distance from below.
CROWD, BLOCK_ROWS, BLOCK_WORDS, BINS = 128, 2048, 1 << 20, 128
#: Pairs of texts that a task is sent at a time: arrays of words take more room than texts.
PAIRS = 500
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """Words are what white space parts, in lower case."""
    return (text or "").lower().split()


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _occurrences(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it in its document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(k))
    run = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(k), np.uint64)
    out[order] = run.astype(np.uint64)
    return out


def sketch_block(word_lists: list[list[str]], hashes: dict, shingle: int, sketches: int, picks: int) -> np.ndarray:
    """Sketches (documents x sketches, int64) of documents that each have a word."""
    flat, sizes = [], []
    for words in word_lists:
        flat.extend(map(hashes.__getitem__, words))
        if len(words) < shingle:  # a short document is one shingle
            flat.extend([0] * (shingle - len(words)))
        sizes.append(max(len(words), shingle))
    h = np.array(flat, dtype=np.uint64)
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = sizes - shingle + 1
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    pos = np.arange(len(doc)) - first[doc]
    at = starts[doc] + pos
    key = np.zeros(len(at), np.uint64)
    for i in range(shingle):
        key = key * np.uint64(0x100000001B3) + h[at + i] * _ODD[i % 5]
    key = _mix(key)
    key = _mix(key + _occurrences(key, doc) * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << POSITION_BITS) - 1)
    where = pos.astype(np.uint64) & low
    top, most = ~low, np.uint64(2**64 - 1)
    out = np.empty((len(n), sketches), np.uint64)
    ranked = np.empty(len(key), np.uint64)
    for j in range(sketches):
        seed = np.uint64(xxhash.xxh64_intdigest(b"", seed=j + 1))
        np.multiply(key, seed | np.uint64(1), out=ranked)
        ranked &= top
        ranked |= where
        chosen = []
        for i in range(picks):
            least = np.minimum.reduceat(ranked, first)
            chosen.append(least)
            if i + 1 < picks:
                if n.max() <= low:
                    ranked[first + (least & low).astype(np.int64)] = most
                else:  # positions wrap around
                    ranked[ranked == least[doc]] = most
        chosen = np.stack(chosen, 1)
        empty = chosen == most
        order = np.argsort(np.where(empty, most, chosen & low), axis=1, kind="stable")
        kept = np.take_along_axis(chosen >> np.uint64(POSITION_BITS), order, 1)
        code = np.full(len(n), seed)
        for i in range(picks):
            code = _mix(code * np.uint64(0x100000001B3) + kept[:, i])
        out[:, j] = code
    return out.view(np.int64)


def _sketcher(shingle: int, sketches: int, picks: int, block_words: int = 100_000):
    schema = pa.schema([("doc_id", pa.int64()), ("vid", pa.binary()), ("sk", pa.list_(pa.int64()))])

    def run(batches):
        hashes = _WordHash()
        for batch in batches:
            ids, vids, texts = batch.column(0), batch.column(1), batch.column(2)
            lists, rows, size = [], [], 0
            result: list = [None] * len(batch)

            def flush():
                if lists:
                    for r, sk in zip(rows, sketch_block(lists, hashes, shingle, sketches, picks)):
                        result[r] = sk
                    lists.clear()
                    rows.clear()

            for r in range(len(batch)):
                words = words_of(texts[r].as_py())
                if words:
                    lists.append(words)
                    rows.append(r)
                    size += len(words)
                    if size > block_words:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, vids, pa.array(result, pa.list_(pa.int64()))], schema=schema)

    return run


def node_id(doc_id: Column, text: Column) -> Column:
    """Names a document by doc_id (null last) and 128 bits of the text's SHA-256, so that names sort as doc_ids do; null where the text is."""
    flipped = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01" + "00" * 8))).otherwise(F.unhex(F.concat(F.lit("00"), flipped))), F.unhex(F.substring(F.sha2(text, 256), 1, 32)))


def id_of(node: Column) -> Column:
    """The doc_id in a ``node_id``."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value.cast("long"))


def text_of(node: Column) -> Column:
    """The part of a ``node_id`` that names the text."""
    return F.substring(node, 10, 16)


def sketched(docs: DataFrame, shingle: int = SHINGLE, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """``(doc_id, node, sk)``; sk is null where the text has no word, node where it is null."""
    bound_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), node_id(doc_id, F.col("text")).alias("node"), "text").mapInArrow(
        _sketcher(shingle, sketches, picks), "doc_id long, node binary, sk array<long>"
    )


def buckets_of(sk: DataFrame) -> DataFrame:
    """``(k, h, a, n)``: the ``n`` > 1 texts that share a sketch ``k``, each by the hash ``h`` of its node, and the bucket's least hash ``a``.

    ``sk`` has one row a text. Only hashes travel; where two nodes share one, both are compared, as candidates may be too many but never too few.
    """
    rows = sk.where("sk is not null").select(F.xxhash64("node").alias("h"), F.posexplode("sk").alias("i", "s")).select("h", F.xxhash64("i", "s").alias("k"))
    heads = rows.groupBy("k").agg(F.min("h").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(heads.hint("shuffle_merge"), "k")  # as many as there are buckets: not to be broadcast


class _Words:
    """Arrays of word hashes of texts, and how often each occurs, remembered within a batch."""

    def __init__(self):
        self.hashes, self.seen = _WordHash(), {}

    def __call__(self, name, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.seen.get(name)
        if found is None:
            words = np.array([self.hashes[w] for w in words_of(text)], np.uint64)
            found = self.seen[name] = words, _bag(words)
        return found


def _profiler(batches):
    """Number of words of each text and the counts of its words in ``BINS`` bins, up to 255 each."""
    schema = pa.schema([("h", pa.int64()), ("size", pa.int64()), ("bins", pa.binary())])
    words = _Words()
    for batch in batches:
        words.seen.clear()
        found = [words(i, t) for i, t in enumerate(batch.column("text").to_pylist())]
        bins = [np.minimum(np.bincount((w % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for w, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([len(w) for w, _ in found], pa.int64()), pa.array(bins, pa.binary())], schema=schema)


def _near_in_groups(similarity: float):
    """Pairs of rows of one ``key``, of different components, that length and word counts don't keep apart. Rows come sorted by key; a key has few."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(key, h, comp, size, bins):
        n = len(key)
        end = np.searchsorted(key, key, "right")
        i, step = np.arange(n), 1
        while True:
            i = i[i + step < end[i]]
            if not len(i):
                return
            for part in range(0, len(i), 20_000):
                x = i[part : part + 20_000]
                x = x[comp[x] != comp[x + step]]
                x, y = _within(x, x + step, size, size, bins, bins, similarity)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(h[x], h[y])), pa.array(np.maximum(h[x], h[y]))], schema=schema)
            step += 1

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            raw = b"".join(batch.column("bins").to_pylist())
            new = [batch.column(c).to_numpy() for c in ("key", "h", "component", "size")] + [np.frombuffer(raw, np.uint8).reshape(-1, BINS)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last key may go on
            if cut:
                yield from pairs(*[x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield from pairs(*held)

    return run


def _within(x, y, sizes, sizes2, bins, bins2, similarity: float):
    """Those places ``x, y`` whose sizes and bins leave the similarity open."""
    most = np.floor(np.maximum(sizes[x], sizes2[y]) * (1 - similarity) + 1e-9)
    fit = np.abs(sizes[x] - sizes2[y]) <= most
    x, y, most = x[fit], y[fit], most[fit]
    # each edit changes one count by one up or down at most, or one up and one down
    apart = (np.maximum(bins[x], bins2[y]) - np.minimum(bins[x], bins2[y])).sum(1, dtype=np.int64)
    fit = (apart + np.abs(sizes[x] - sizes2[y])) // 2 <= most
    return x[fit], y[fit]


def _block_maker(batches):
    """Packs rows ``(crowd, size, node, component, text)`` in their order into blocks of one crowd each."""
    schema = pa.schema([("crowd", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("data", pa.binary())])
    inner = pa.schema([("node", pa.binary()), ("component", pa.int64()), ("words", pa.list_(pa.uint64()))])
    words, held, total, count = _Words(), [], 0, 0
    part = TaskContext.get().partitionId()

    def packed():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, inner, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*held))[1:], inner)], schema=inner))
        sizes = [len(r[3]) for r in held]
        return pa.RecordBatch.from_pydict({"crowd": [held[0][0]], "block": [(part << 32) + count], "low": [min(sizes)], "high": [max(sizes)], "data": [out.getvalue().to_pybytes()]}, schema=schema)

    for batch in batches:
        words.seen.clear()
        for crowd, node, comp, text in zip(*(batch.column(c).to_pylist() for c in ("crowd", "node", "component", "text"))):
            w = words(node, text)[0]
            if held and (held[0][0] != crowd or len(held) == BLOCK_ROWS or total + len(w) > BLOCK_WORDS):
                yield packed()
                held, total, count = [], 0, count + 1
            held.append((crowd, node, comp, w))
            total += len(w)
    if held:
        yield packed()


def _block_linker(similarity: float):
    """Links between texts of two blocks, or of one, that align: enough of them to connect all that do."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def opened(data):
        t = pa.ipc.open_stream(data).read_all().combine_chunks()
        lists = t.column("words").chunk(0)
        cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(cuts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bins = np.bincount(owner * BINS + (flat % np.uint64(BINS)).astype(np.int64), minlength=len(sizes) * BINS).reshape(-1, BINS)
        return t.column("node").to_pylist(), t.column("component").to_numpy(), [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])], sizes, np.minimum(bins, 255).astype(np.uint8), {}

    def bag(side, i):
        if i not in side[5]:
            side[5][i] = _bag(side[2][i])
        return side[5][i]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left = opened(row["data"])
                same = row["a"] == row["b"]
                right = left if same else opened(row["data2"])
                # texts of one label hang together already
                labels = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)[1]
                mine, theirs = labels[: len(left[1])], labels[len(left[1]) :]
                found, wait = [], []

                def settle():
                    ask = [(i, j) for i, j in wait if mine[i] != theirs[j]]
                    wait.clear()
                    distances = word_distances([(left[2][i], right[2][j]) for i, j in ask], similarity, [(bag(left, i), bag(right, j)) for i, j in ask])
                    for (i, j), d in zip(ask, distances):
                        if d is not None and mine[i] != theirs[j]:
                            found.append((left[0][i], right[0][j]))
                            labels[labels == theirs[j]] = mine[i]

                for i in range(len(mine)):
                    j = np.arange(i + 1 if same else 0, len(theirs))
                    j = j[theirs[j] != mine[i]]
                    x, y = _within(np.full(len(j), i), j, left[3], right[3], left[4], right[4], similarity)
                    wait += zip(x.tolist(), y.tolist())
                    if len(wait) >= 1000:
                        settle()
                settle()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], schema=schema)

    return run


def crowd_links(crowded: DataFrame, comp: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` of nodes that join components, between texts of crowded buckets ``(h, a)``, a naming the bucket by its least text, that hang together.

    Buckets that share texts are one crowd, as those are that a passage makes which very many texts share. The texts of a
    crowd are sorted by length and packed into blocks; blocks whose lengths leave the similarity open are compared in
    one task each, so a text travels once a block pair, not once a pair of texts. Only links come out. The work is the
    square of a crowd's different texts, most of it comparisons of a few dozen bytes.
    """
    # a text goes by the least bucket it is in; buckets that share a text hang together: few edges between few names
    names, names_path = written(crowded.groupBy("h").agg(F.min("a").alias("name"), F.collect_set("a").alias("names")), "crowd-names")
    hang = components(names.select("name", F.explode("names").alias("other")).where("name != other").distinct(), "name", "other")
    crowds = names.join(hang, names["name"] == hang["node"], "left").select("h", F.coalesce("component", "name").alias("crowd"))
    rows = texts.join(crowds, "h").join(comp, "h", "left").withColumn("component", F.coalesce("component", "h"))
    # few tasks pack few texts, so that blocks are full however many partitions there are
    tasks = max(1, -(-names.count() // BLOCK_ROWS))
    rows = rows.withColumn("size", F.length("text")).repartitionByRange("crowd", "size", "node").sortWithinPartitions("crowd", "size", "node").coalesce(tasks)
    blocks, path = written(rows.select("crowd", "node", "component", "text").mapInArrow(_block_maker, "crowd long, block long, low long, high long, data binary"), "crowds")
    a = blocks.select("crowd", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = blocks.select("crowd", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    near = a.join(b, "crowd").where("a <= b").where((F.col("low_b") * similarity <= F.col("high_a") + 1) & (F.col("low_a") * similarity <= F.col("high_b") + 1)).select("a", "b")
    left, right = blocks.select(F.col("block").alias("a"), "data"), blocks.select(F.col("block").alias("b"), F.col("data").alias("data2"))
    pairs = near.join(left, "a").join(right, "b")
    links, _ = written(pairs.repartition(F.col("a"), F.col("b")).mapInArrow(_block_linker(similarity), "a binary, b binary"), "links", 4)
    drop_path(blocks.sparkSession, path)
    drop_path(blocks.sparkSession, names_path)
    return links


def rest_links(buckets: DataFrame, comp: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` of nodes, enough to join all components ``comp (h, component)`` that alike texts of one bucket lie in.

    Only buckets with members of several components are open. Up to ``crowd`` members, every pair is held against the
    bounds that lengths and counts of words set, so a text meets at most that many others a sketch, and what may be alike
    is aligned. The texts of larger open buckets go to ``crowd_links``. No pair is left out.
    """
    spark = buckets.sparkSession
    rows = buckets.where("n > 2").join(comp, "h", "left").withColumn("component", F.coalesce("component", "h"))
    mixed = rows.groupBy("k").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("k")
    rows, rows_path = written(rows.join(mixed, "k").select("k", "a", "n", "h", "component"), "open")
    few = rows.where(F.col("n") <= crowd)
    profiles = texts.join(few.select("h").distinct(), "h", "left_semi").select("h", "text").mapInArrow(_profiler, "h long, size long, bins binary")
    both = few.join(profiles, "h").select(F.col("k").alias("key"), "h", "component", "size", "bins")
    pairs, pairs_path = written(both.repartition("key").sortWithinPartitions("key").mapInArrow(_near_in_groups(similarity), "a long, b long").distinct(), "rest")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    links, _ = written(verified_pairs(pairs, texts.join(asked, "h", "left_semi"), similarity).select("a", "b"), "links", PAIRS)
    many = rows.where(F.col("n") > crowd).select("h", "a")
    if many.limit(1).count():
        links = links.union(crowd_links(many, comp, texts, similarity))
    drop_path(spark, rows_path)
    drop_path(spark, pairs_path)
    return links


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], w: int) -> np.ndarray:
    """Edit distance of each pair along paths within ``w`` of the diagonal; right wherever it is at most w."""
    wide = 2 * w + 1
    rows = max(len(a) for a, _ in pairs)
    cols = max(max(len(b) for _, b in pairs), rows) + w
    kind = np.int16 if cols < 8000 else np.int32
    big = kind(1 << (14 if kind is np.int16 else 28))
    A = np.full((len(pairs), rows), 1, np.uint64)  # 1 and 2 stand beyond the ends
    B = np.full((len(pairs), w + cols + wide), 2, np.uint64)
    for p, (a, b) in enumerate(pairs):
        A[p, : len(a)] = a
        B[p, w : w + len(b)] = b
    steps = np.arange(wide, dtype=kind)
    row = np.broadcast_to(np.where(steps >= w, steps - kind(w), big), (len(pairs), wide)).astype(kind)
    last = np.array([len(a) for a, _ in pairs])
    goal = np.array([len(b) - len(a) for a, b in pairs]) + w
    out = np.full(len(pairs), 1 << 28, np.int64)
    inside = (goal >= 0) & (goal < wide)
    ending = set(last.tolist())
    for i in range(rows + 1):
        if i:
            new = row + (B[:, i - 1 : i - 1 + wide] != A[:, i - 1 : i])
            np.minimum(new[:, :-1], row[:, 1:] + kind(1), out=new[:, :-1])
            new -= steps
            np.minimum.accumulate(new, axis=1, out=new)
            new += steps
            row = np.minimum(new, big)
        if i in ending:
            now = np.flatnonzero((last == i) & inside)
            out[now] = row[now, goal[now]]
    return out


def _hashed(words) -> np.ndarray:
    return words if isinstance(words, np.ndarray) else np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words, return_counts=True)


def _apart(x: tuple, y: tuple, sizes: tuple[int, int]) -> int:
    """Least edit distance that two texts' counts of words allow."""
    (u, n), (v, m) = (x, y) if len(x[0]) >= len(y[0]) else (y, x)
    if not len(v):
        return max(sizes)
    at = np.minimum(np.searchsorted(u, v), len(u) - 1)
    return max(sizes) - int(np.minimum(n[at], m)[u[at] == v].sum())


def word_distances(pairs: list[tuple], similarity: float = SIMILARITY, bags: list[tuple] | None = None) -> list[int | None]:
    """Edit distance in words of each pair of lists of words or arrays of their hashes, None where the similarity 1 - distance / longer length is too low.

    Lengths and counts of words (``bags``, if they are known) bound the distance from below; common ends are cut off; the
    band starts narrow and doubles up to the greatest distance that would still do, so the answer is exact.
    """
    out: list[int | None] = [None] * len(pairs)
    work: dict[int, list] = {}
    for p, (a, b) in enumerate(pairs):
        a, b = _hashed(a), _hashed(b)
        most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
        if abs(len(a) - len(b)) > most:
            continue
        least = _apart(*(bags[p] if bags else (_bag(a), _bag(b))), (len(a), len(b)))
        if least > most:
            continue
        short = min(len(a), len(b))
        unlike = np.flatnonzero(a[:short] != b[:short])
        head = int(unlike[0]) if len(unlike) else short
        a, b = a[head:], b[head:]
        short = min(len(a), len(b))
        unlike = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
        tail = int(unlike[0]) if len(unlike) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or not len(b):
            out[p] = max(len(a), len(b))
        else:
            # the counts' bound is often near the distance: start a little above it, in steps of a quarter
            step = math.ceil(math.log(max(1.0, least * 1.15 / 8), 1.25))
            work.setdefault(int(8 * 1.25**step), []).append((p, a, b, most))
    while work:
        w = min(work)
        now = sorted(work.pop(w), key=lambda t: len(t[1]))
        i = 0
        while i < len(now):
            j = i
            while j < len(now) and (j == i or (j - i + 1) * (len(now[j][2]) + len(now[j][1]) + 6 * w) <= 500_000):
                j += 1
            group = now[i:j]
            reach = min(w, max(most for _, _, _, most in group))
            for (p, a, b, most), d in zip(group, _band([(a, b) for _, a, b, _ in group], reach)):
                if d <= min(w, most):
                    out[p] = int(d)
                elif w < most:
                    work.setdefault(2 * w, []).append((p, a, b, most))
            i = j
    return out


def _verifier(similarity: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("distance", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        words = _Words()
        for batch in batches:
            words.seen.clear()
            names, others = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left = [words(v, t) for v, t in zip(names, batch.column("ta").to_pylist())]
            right = [words(v, t) for v, t in zip(others, batch.column("tb").to_pylist())]
            found = word_distances([(x, y) for (x, _), (y, _) in zip(left, right)], similarity, [(x, y) for (_, x), (_, y) in zip(left, right)])
            keep = [i for i, d in enumerate(found) if d is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in keep], pa.binary()),
                    pa.array([others[i] for i in keep], pa.binary()),
                    pa.array([found[i] for i in keep], pa.int64()),
                    pa.array([1 - found[i] / max(len(left[i][0]), len(right[i][0]), 1) for i in keep], pa.float64()),
                ],
                schema=schema,
            )

    return run


def verified_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs (a, b)`` of hashes whose texts ``(h, node, text)`` align at ``similarity`` or more: nodes ``a, b``, distance and similarity."""
    bound_batches(pairs.sparkSession)
    left = texts.select(F.col("h").alias("a"), F.col("node").alias("na"), F.col("text").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("node").alias("nb"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "ta", "tb")
    return both.mapInArrow(_verifier(similarity), "a binary, b binary, distance long, similarity double")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, class_id, kept``.

    Equal texts are one class. Different texts are linked where they share an Order MinHash sketch (those of a crowd may
    also do without) and their words, in lower case, have an edit similarity of ``similarity`` or more; classes are the
    components of the links. class_id is the least doc_id of the class and kept marks its rows (all of them, where a doc_id is repeated).
    A null text is a class of its own (class_id = doc_id, kept); texts without words are in one class only with
    equal texts. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    out = classed(docs, similarity, shingle, sketches, picks).withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(id_of(F.col("component"))))
    return out.select("doc_id", "class_id", (F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def classed(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, sketches: int = SKETCHES, picks: int = PICKS, crowd: int = CROWD) -> DataFrame:
    """``near_duplicates`` as ``doc_id, node, component``: node names doc_id and text, component the least node of the class; both are null where the text is."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, _ = written(sketched(docs, shingle, sketches, picks), "sketches")
    # a text goes by its least node
    one = rows.where("node is not null").groupBy(text_of(F.col("node")).alias("vid")).agg(F.min("node").alias("node"), F.first("sk").alias("sk"))
    buckets, buckets_path = written(buckets_of(one), "buckets")
    named = docs.withColumn("node", node_id(F.col("doc_id"), F.col("text"))).withColumn("h", F.xxhash64("node"))
    # a set that grows with the documents isn't broadcast; rows of one h are in one place, so repeated ones go without another shuffle
    texts = named.join(buckets.select("h").distinct().hint("shuffle_merge"), "h", "left_semi").select("h", "node", "text").dropDuplicates(["h", "node"])
    texts, texts_path = written(texts, "texts")
    first = buckets.where("a < h").select("a", F.col("h").alias("b")).distinct()
    links, links_path = written(verified_pairs(first, texts, similarity), "links", PAIRS)
    comp = components(links)
    # any number will do for a component here, as long as equal components have equal ones
    more = rest_links(buckets, comp.select(F.xxhash64("node").alias("h"), F.xxhash64("component").alias("component")).distinct(), texts, similarity, crowd)
    if more.limit(1).count():
        comp = components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    heads = rows.where("node is not null").groupBy(text_of(F.col("node")).alias("vid")).agg(F.min("node").alias("head"))
    classes = heads.join(comp, heads["head"] == comp["node"], "left").select("vid", F.coalesce("component", "head").alias("component"))
    out = rows.select("doc_id", "node", text_of(F.col("node")).alias("vid")).join(classes, "vid", "left")
    for path in (texts_path, links_path, buckets_path):
        drop_path(spark, path)
    return out.select("doc_id", "node", "component")
