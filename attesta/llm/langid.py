"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built. A document is parsed from left
to right into the longest phrases that occur in that sample (Ziv and Merhav, "A measure of relative entropy between
individual sequences with application to universal classification", 1993); the language whose sample needs the
fewest phrases, normalised by the sample's length, wins.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

#: Bounds of the model: letters of labelled text per language, passages they come from; more languages than the third are an error.
SAMPLE_CHARS, SAMPLE_DOCS, MOST_LANGUAGES = 24_000, 64, 1000
#: Bytes of transition tables that are kept dense, one column a letter; the tables of further languages are sorted lists.
DENSE_BYTES = 64 << 20
#: Letters of a lane: long documents are parsed in lanes at once, which are then brought in line with each other. Languages parsed at once,
#: and lanes that are brought in line one by one.
LANE, AT_ONCE, FEW = 512, 16, 32
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most ``sample_docs`` passages of each language's labelled texts: a bounded model input.

    Texts are cut into passages all along; those of the least hash of doc_id and place are taken. The pick is a limit
    within each group that Spark applies before the shuffle, so a language with a third of all rows sends a few rows
    from each task. A column lang with more than ``MOST_LANGUAGES`` values is taken for a mistake and raises ValueError.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    size = SAMPLE_CHARS // 8
    cut = rows.select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))).alias("i"))
    picked = cut.select("lang", F.xxhash64("doc_id", "i").alias("h"), F.substring(F.col("text"), F.col("i") * size + 1, F.lit(size)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    found: dict[str, list[str]] = {}
    for r in picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).orderBy("lang", "n").limit(MOST_LANGUAGES * sample_docs + 1).collect():
        found.setdefault(r["lang"], []).append(r["text"])
    if len(found) > MOST_LANGUAGES or sum(map(len, found.values())) > MOST_LANGUAGES * sample_docs:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    return found


@lru_cache(1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form, and 2 for a letter, 1 for a mark, which may be part of a word, else 0."""
    lower, kind = np.arange(0x110000, dtype=np.int32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = unicodedata.category(chr(c))[0]
        if x in "LM":
            kind[c] = 2 if x == "L" else 1
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, kind


def letters(text: str) -> np.ndarray:
    """Code points of the text's lower-case letters and marks, with one space (32) for every run of anything else, none at the ends."""
    lower, kind = _code_points()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(kind[c] > 0, lower[c], 32)
    space = c == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    c = c[keep]
    if len(c) and c[0] == 32:
        c = c[1:]
    return c[:-1] if len(c) and c[-1] == 32 else c


class _Rows(list):
    """Transitions by state as dictionaries, for alphabets too wide for a table."""

    def __init__(self, states: int):
        super().__init__({} for _ in range(states))

    def __getitem__(self, at):
        return list.__getitem__(self, at[0]).get(at[1], 0)

    def __setitem__(self, at, value):
        list.__getitem__(self, at[0])[at[1]] = value

    def copy_row(self, to: int, source: int) -> None:
        list.__setitem__(self, to, dict(list.__getitem__(self, source)))


class _Table:
    """Transitions by state as a table, one column a letter."""

    def __init__(self, states: int, width: int):
        self.cells = np.zeros((states, width), np.int32)

    def __getitem__(self, at):
        return int(self.cells[at])

    def __setitem__(self, at, value):
        self.cells[at] = value

    def copy_row(self, to: int, source: int) -> None:
        self.cells[to] = self.cells[source]


def suffix_automaton(codes: list[int], go) -> int:
    """Fills ``go`` with the transitions of the automaton of all substrings of ``codes``; state 0 is dead, 1 the root. Returns the number of states."""
    size = 2 * len(codes) + 2
    link, length = [0] * size, [0] * size
    last, count = 1, 2
    for c in codes:
        new = count
        count += 1
        length[new] = length[last] + 1
        p = last
        while p and not go[p, c]:
            go[p, c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = go[p, c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = count
                count += 1
                length[twin] = length[p] + 1
                go.copy_row(twin, q)
                link[twin] = link[q]
                while p and go[p, c] == q:
                    go[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return count


class CrossParser:
    """The automata of all languages, each over the letters of its own sample."""

    def __init__(self, texts: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, dense_bytes: int = DENSE_BYTES):
        samples = {}
        for k, v in sorted(texts.items()):
            parts = [x for t in v for x in (letters(t), np.array([32], np.int32))]
            found = np.concatenate(parts)[:-1][:sample_chars] if parts else np.zeros(0, np.int32)
            if (found != 32).any():
                samples[k] = found
        self.languages = list(samples)
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.int32), *samples.values()]))
        self.bits = np.array([math.log2(max(2, len(v))) for v in samples.values()])
        left, dense, sparse = dense_bytes, [], []
        for v in samples.values():
            own = np.unique(v)
            # a letter that the sample lacks is 0 and leads nowhere
            code = np.zeros(len(self.alphabet) + 1, np.int64)
            code[np.searchsorted(self.alphabet, own)] = np.arange(1, len(own) + 1)
            states, width = 2 * len(v) + 2, len(own) + 1
            letters_ = code[np.searchsorted(self.alphabet, v)].tolist()
            k = len(dense) + len(sparse)
            left -= 4 * states * width
            if left >= 0:
                go = _Table(states, width)
                count = suffix_automaton(letters_, go)
                dense.append((k, count, width, code, go.cells[:count].ravel()))
            else:
                go = _Rows(states)
                count = suffix_automaton(letters_, go)
                rows = [list.__getitem__(go, s) for s in range(count)]
                keys = np.array([s * width + c for s, t in enumerate(rows) for c in t], np.int64)
                values = np.array([x for t in rows for x in t.values()], np.int32)
                order = np.argsort(keys)
                sparse.append((k, count, width, code, (keys[order], values[order])))
        self.groups = []
        for full, some in ((True, dense), (False, sparse)):
            for at in range(0, len(some), AT_ONCE):
                part = some[at : at + AT_ONCE]
                base = np.concatenate([[0], np.cumsum([count * width for _, count, width, _, _ in part])]).astype(np.int64)
                if full:
                    keys, values = None, np.concatenate([t for *_, t in part])
                    if values.max() < 1 << 16:
                        values = values.astype(np.uint16)
                else:
                    keys, values = np.concatenate([t[0] + b for (*_, t), b in zip(part, base)]), np.concatenate([t[1] for *_, t in part])
                self.groups.append((np.array([k for k, *_ in part]), base[:-1], np.array([w for _, _, w, _, _ in part]), np.stack([c for _, _, _, c, _ in part]), keys, values))

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases (documents x languages) that each document of ``letters`` is parsed into.

        Documents are cut into lanes that are parsed at once, each from its start. Then the lanes of a document are gone
        through in order: where a phrase reaches into a lane, its parse goes on letter by letter until it begins a phrase
        where the lane's own parse does; from there they are the same. So the counts are those of one parse from left to right.
        """
        out = np.zeros((len(docs), len(self.languages)), np.int64)
        sizes = np.array([len(d) for d in docs], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        if not len(docs) or not sizes[0] or not self.groups:
            return out
        flat = np.concatenate([docs[i] for i in order])
        place = np.searchsorted(self.alphabet, flat)
        place[self.alphabet[np.minimum(place, len(self.alphabet) - 1)] != flat] = len(self.alphabet)
        begin = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        first_lane = np.cumsum(lanes) - lanes
        rank = np.arange(lanes.sum()) - np.repeat(first_lane, lanes)
        start = np.repeat(begin, lanes) + rank * LANE
        length = np.minimum(LANE, np.repeat(begin + sizes, lanes) - start)
        by_length = np.argsort(-length, kind="stable")  # lanes that go on stand before those that are over
        spot = np.empty(len(start), np.int64)
        spot[by_length] = np.arange(len(start))
        live = np.searchsorted(-length[by_length], -np.arange(LANE), "left")
        begin_of = start[by_length]
        head, longest = spot[first_lane[lanes > 0]], int(length[by_length[0]])
        rows = np.zeros((longest, len(start)), np.int32)  # the letters of all lanes, step by step
        for i in range(longest):
            rows[i, : live[i]] = place[begin_of[: live[i]] + i]
        for chosen, base, width, codes, keys, values in self.groups:

            def step(at):
                if keys is None:
                    return values[at]
                found = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                return np.where(keys[found] == at, values[found], 0)

            def lookup(at: int) -> int:
                if keys is None:
                    return values.item(at)
                found = int(np.searchsorted(keys, at))
                return values.item(found) if found < len(keys) and keys.item(found) == at else 0

            def moved(k, state, letter):
                """State after a letter, and whether a phrase begins with it."""
                new = step(base[k] + state * width[k] + codes[k, letter])
                fresh = (new == 0) | (state == 1)
                again = root[k, letter]
                # a letter that the sample lacks is a phrase by itself
                return np.where(new == 0, np.where(again == 0, 1, again), new), fresh

            root = step(base[:, None] + width[:, None] + codes)
            state = np.ones((len(chosen), len(start)), np.int32)
            count = np.zeros((len(chosen), len(start)), np.int32)
            begins = np.zeros((longest, len(chosen), len(start)), bool)
            for x in range(len(chosen)):  # one language after the other: a table of a few megabytes stays near
                now, met, code, first = state[x], count[x], codes[x].astype(np.int32), root[x].astype(np.int32)
                cells = values[base[x] :] if keys is None else None
                for i in range(longest):
                    n = live[i]
                    letter, old = rows[i, :n], now[:n]
                    at = old * np.int32(width[x]) + code[letter]
                    new = cells.take(at) if keys is None else step(base[x] + at)
                    stop = new == 0
                    fresh = stop | (old == 1)
                    met[:n] += fresh
                    begins[i, x, :n] = fresh
                    now[:n] = np.where(stop, np.maximum(first[letter], 1), new) if stop.any() else new
            total, end = count[:, head], state[:, head]
            for r in range(1, int(lanes[0])):
                m = int(np.searchsorted(-lanes, -r, "left"))  # documents with more lanes
                lane = spot[first_lane[:m] + r]
                k, d = np.nonzero(end[:, :m] != 1)
                now = end[k, d]
                total[:, :m] += count[:, lane]
                end[:, :m] = state[:, lane]
                size = length[first_lane[:m] + r]
                i = 0
                while len(k) > FEW and i < LANE:
                    on = size[d] > i
                    if not on.all():  # the document is over
                        end[k[~on], d[~on]] = now[~on]
                        k, d, now = k[on], d[on], now[on]
                    new, fresh = moved(k, now, rows[i, lane[d]])
                    there = begins[i, k, lane[d]]
                    apart = ~(fresh & there)
                    total[k, d] += np.where(apart, fresh.astype(np.int64) - there, 0)
                    k, d, now = k[apart], d[apart], new[apart]
                    i += 1
                for x, y, at in zip(k.tolist(), d.tolist(), now.tolist()):  # the last few go one by one
                    j = int(lane[y])
                    cells, w, code, fix = int(base[x]), int(width[x]), codes[x], 0
                    for q in range(i, int(size[y])):
                        c = code.item(rows.item((q, j)))
                        new = lookup(cells + at * w + c)
                        fresh, there = new == 0 or at == 1, begins.item((q, x, j))
                        if fresh and there:
                            break
                        fix += fresh - there
                        at = new or lookup(cells + w + c) or 1
                    else:
                        end[x, y] = at
                    total[x, y] += fix
            out[order[: total.shape[1]][:, None], chosen[None, :]] = total.T
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter (texts x languages) and whether the text has a letter at all."""
        kind = _code_points()[1]
        docs = [letters(t or "") for t in texts]
        has = np.array([bool((kind[d] == 2).any()) for d in docs], bool)
        out = np.full((len(texts), len(self.languages)), np.inf)
        rows = np.flatnonzero(has)
        if len(rows) and self.languages:
            sizes = np.array([len(docs[i]) for i in rows])
            out[rows] = self.phrases([docs[i] for i in rows]) * self.bits / sizes[:, None]
        return out, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bits, has = self.entropies(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = bits.argmin(1)
        score = np.zeros(len(texts))
        with np.errstate(invalid="ignore"):
            p = np.exp(np.where(has[:, None], -8 * (bits - bits.min(1, keepdims=True)), 0.0))
        score[has] = 1 / p.sum(1)[has]
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)], score


_PARSERS: dict = {}


def _parser(key: int, texts: dict[str, list[str]]) -> CrossParser:
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(texts)
    return _PARSERS[key]


def identified(docs: DataFrame, texts: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns in ``keep`` for every row of ``docs (doc_id, text)``.

    lang_pred is a language of ``texts``, or ``und`` with score 0 where the text is null or has no letter (or where
    no labelled text is given). score is 1 where no other language comes near, 1 / languages where all tie; the
    first language in code point order wins ties. Whole texts are parsed, a bounded number of letters at a time.
    """
    bound_batches(docs.sparkSession)
    texts = {k: list(v) for k, v in sorted(texts.items())}
    key = zlib.crc32(repr(texts).encode("utf-8", "surrogatepass"))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most MOST_LANGUAGES x SAMPLE_DOCS x SAMPLE_CHARS / 8
    kinds = dict(docs.dtypes)
    extra = [(c, kinds[c]) for c in keep]

    def run(batches):
        parser = _parser(key, shared.value)
        for batch in batches:
            n, langs, scores = batch.column("text").to_pylist(), [], []
            at = 0
            while at < len(n):
                end, size = at, 0
                while end < len(n) and (end == at or size < 2_000_000):
                    size += len(n[end] or "")
                    end += 1
                pred, score = parser.predict(n[at:end])
                langs += pred
                scores.append(score)
                at = end
            cols = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c, _ in extra], names=["doc_id", "lang_pred", "score", *[c for c, _ in extra]])

    wanted = list(dict.fromkeys(["doc_id", "text", *keep]))
    schema = ", ".join(["doc_id long", "lang_pred string", "score double", *[f"`{c}` {t}" for c, t in extra]])
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*wanted).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the labelled rows of ``docs`` that aren't held out and predicts all rows."""
    return identified(docs, training_texts(docs), keep)
