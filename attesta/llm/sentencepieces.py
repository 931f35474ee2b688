"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch, each distinct one once, are joined into one text and its suffix array is built; every piece of the
vocabulary is binary-searched for its range of suffixes, which gives all its occurrences as edges; edges are sorted by the
position where they end and relaxed from left to right. Nothing is kept from batch to batch unless a model is asked to.

The models in question are BPE models, whose result is no best path by summed scores. So the relaxation keeps, for
every position, the last piece of the encoding of the text up to there: an edge is taken if its piece may follow
the last piece at its start, that is, if no merge across their border would have come before the merges that made
them. For every position exactly one edge is, and following them back gives the ids the library gives.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .interned import Interned

SPACE = "▁"
_NEVER = np.int64(1 << 40)
_CACHE = 1 << 22


def packed(codes: np.ndarray) -> np.ndarray:
    """The code at each position and the two after it in one number, 0 beyond the end; it sorts as they do."""
    text = np.concatenate([codes, np.zeros(2, codes.dtype)]).astype(np.int64)
    return (text[:-2] << 42) | (text[1:-1] << 21) | text[2:]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes, sorted by their first ``depth`` codes, by prefix doubling."""
    n = len(codes)
    key = packed(codes)
    done = 3
    while True:
        order = np.argsort(key)
        k = key[order]
        new = np.ones(n, np.int64)
        new[1:] = k[1:] != k[:-1]
        groups = np.cumsum(new)
        if done >= depth or not n or groups[-1] == n:
            return order
        rank = np.zeros(n + done, np.int64)
        rank[order] = groups
        key = rank[:n] * np.int64(n + 2) + rank[done:]
        done *= 2


class _Aliens:
    """Splits a word at characters that are no pieces; runs of either kind come out in order."""

    def __init__(self, chars: set[str]):
        self.chars = chars

    def split(self, word: str) -> list[str]:
        out: list[str] = []
        for c in word:
            if out and (c in self.chars) == (out[-1][0] in self.chars):
                out[-1] += c
            else:
                out.append(c)
        return out


class Model:
    """Pieces of a SentencePiece BPE model, with its merges and what its encoder needs; ids of up to ``remember`` words stay for later batches."""

    def __init__(self, path: str, remember: int = 0):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_of = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(n) if not special[i]]
        ids = {names[i]: i for i in normal}
        score = {i: sp.get_score(i) for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.chars = {p for p in ids if len(p) == 1}
        # the time at which a piece is made: characters are there from the start
        self.made = np.full(n, -1, np.int64)
        for p, i in ids.items():
            if len(p) > 1:
                self.made[i] = ranks[score[i]]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.live = [i for p, i in ids.items() if len(p) == 1 or self._derive(p, ids)]
        live = set(self.live)
        pairs = []
        for i in self.live:
            p = names[i]
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a in live and b in live:
                    pairs.append((a * n + b, self.made[i]))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_made = np.array([m for _, m in pairs], np.int64)
        self.n, self.names = n, names
        self.length = np.array([len(x) for x in names], np.int64)
        self.depth = max((len(names[i]) for i in self.live), default=1)
        wide = -(-self.depth // 3)
        matrix, mask = np.zeros((len(self.live), 3 * wide), np.int64), np.zeros((len(self.live), 3 * wide), np.int64)
        for r, i in enumerate(self.live):
            c = np.frombuffer(names[i].encode("utf-32-le"), np.uint32)
            matrix[r, : len(c)], mask[r, : len(c)] = c, (1 << 21) - 1
        # pieces, three characters to a number, and which of its bits count
        self.matrix, self.mask = (x[:, ::3] << 42 | x[:, 1::3] << 21 | x[:, 2::3] for x in (matrix, mask))
        self.live_ids = np.array(self.live, np.int64)
        self.live_len = self.length[self.live_ids]
        self.splits_words = not any(SPACE in names[i].lstrip(SPACE) for i in self.live)
        self.memo_key, self.memo_ok = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)
        self.output = [b"" if special[i] and not sp.is_byte(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.output[self.unknown] = " ⁇ ".encode()
        self.words = re.compile(self._cuts())
        self.aliens = _Aliens(self.chars)
        self.remember = remember
        self.interned = Interned(self._encode_words, most=remember)

    def _cuts(self) -> str:
        """A pattern of words: it cuts only between characters that no piece holds side by side."""
        known = {self.names[i][k : k + 2] for i in self.live for k in range(len(self.names[i]) - 1)}
        letters = {chr(c) for c in range(0x250) if chr(c).isalpha()} & self.chars
        after = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c in self.chars}
        after = {c for c in after if not any(x + c in known for x in letters)}
        alien = {chr(c) for c in range(128) if chr(c) not in self.chars}
        run, stop, odd = ("".join(map(re.escape, sorted(x))) for x in (letters, after | {SPACE} | alien, alien))
        if not run or not odd or any(x + SPACE in known for x in letters):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        return f"{SPACE}*[{run}]+(?=[{stop}]|\\Z)|[{odd}]+|{SPACE}+[^{SPACE}{odd}]*|[^{SPACE}{odd}]+"

    def _derive(self, piece: str, ids: dict[str, int]) -> bool:
        """Merges the piece from its characters; notes its last merge; False if the encoder never makes it."""
        parts = list(piece)
        if any(c not in ids for c in parts):
            return False
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.made[i] < best):
                    best, at = self.made[i], k
            if at < 0:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        i = ids[piece]
        self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
        return True

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the encoder can leave ``first`` and ``second`` side by side, for arrays of pieces; remembered by a table."""
        key = first * self.n + second
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & np.int64(_CACHE - 1)
        hit = self.memo_key[slot] == key
        out = self.memo_ok[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            k, back = np.unique(key[miss], return_inverse=True)
            ok = self._follows(k // self.n, k % self.n)
            out[miss] = ok[back]
            s = slot[miss]
            # equal slots: one of the keys wins, with its own value
            self.memo_key[s] = key[miss]
            own = self.memo_key[s] == key[miss]
            self.memo_ok[s[own]] = out[miss[own]]
        return out

    def _follows(self, r: np.ndarray, l: np.ndarray) -> np.ndarray:
        """Goes back in time from two finished pieces: undoes the later merge at their border, again and again.

        If at some time the pieces at the border could merge before the merge just undone, they would have. Of merges of
        one rank the left one is first.
        """
        r, l = r.copy(), l.copy()
        ok = np.ones(len(r), bool)
        limit = np.full(len(r), _NEVER)
        by_second = np.zeros(len(r), bool)
        work = np.arange(len(r))
        while len(work):
            key = r[work] * self.n + l[work]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[at] == key, self.pair_made[at], _NEVER)
            merges = (made < limit[work]) | ((made == limit[work]) & by_second[work] & (made < _NEVER))
            ok[work[merges]] = False
            work = work[~merges]
            a, b = self.made[r[work]], self.made[l[work]]
            going = (a >= 0) | (b >= 0)
            work, a, b = work[going], a[going], b[going]
            second = b >= a
            limit[work] = np.maximum(a, b)
            by_second[work] = second
            s, f = work[second], work[~second]
            l[s] = self.left[l[s]]
            r[f] = self.right[r[f]]
        return ok

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences ``(start, piece)`` of pieces in a text of code points."""
        order = suffix_array(codes, self.depth)
        text = packed(np.concatenate([codes, np.zeros(self.depth + 2, codes.dtype)]))
        reach = 3 * np.arange(self.matrix.shape[1])
        rows = np.arange(len(self.live))

        def bound(past: bool) -> np.ndarray:
            low, high = np.zeros(len(self.live), np.int64), np.full(len(self.live), len(order), np.int64)
            while True:
                open_ = low < high
                if not open_.any():
                    return low
                mid = (low + high) // 2
                part = text[order[np.minimum(mid, len(order) - 1)][:, None] + reach] & self.mask
                same = part == self.matrix
                first = np.argmin(same, 1)
                less = np.where(same[rows, first], past, part[rows, first] < self.matrix[rows, first])
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)

        low, high = bound(False), bound(True)
        count = high - low
        ends = np.cumsum(count)
        at = np.repeat(low - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return order[at], np.repeat(self.live_ids, count)

    def relaxed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose characters are all pieces, one after the other, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        start, piece = self.edges(codes)
        word = np.searchsorted(begin, start, "right") - 1
        end = start + self.length[piece]
        offset = end - begin[word]
        sort = np.argsort(offset.astype(np.uint16) if len(codes) < 1 << 16 or sizes.max() < 1 << 16 else offset, kind="stable")
        start, piece, end, offset = start[sort], piece[sort], end[sort], offset[sort]
        first = (start - begin[word[sort]]) == 0
        last = np.full(len(codes) + 1, -1, np.int64)
        cuts = np.searchsorted(offset, np.arange(1, (offset[-1] if len(offset) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            p, before = piece[a:b], last[start[a:b]]
            ok = first[a:b].copy()
            ask = np.flatnonzero(~ok & (before >= 0))
            ok[ask] = self.follows(before[ask], p[ask])
            last[end[a:b][ok]] = p[ok]
        # follow the last pieces back from the end of every word
        at = begin + sizes
        who = np.arange(len(words))
        found = []
        while True:
            more = at > begin[who]
            at, who = at[more], who[more]
            if not len(at):
                break
            p = last[at]
            if (p < 0).any():
                raise ValueError("a position can't be reached; is this a BPE model?")
            found.append((who, at, p))
            at = at - self.length[p]
        placed = np.full(len(codes) + 1, -1, np.int32)
        counts = np.zeros(len(words), np.int64)
        for who, at, p in found:
            placed[at] = p
            counts[who] += 1  # a word has one entry in each round
        return placed[placed >= 0], counts

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words part at characters that are no pieces; those become their bytes, the rest is relaxed."""
        if self.chars.issuperset("".join(words)):
            return self.relaxed(words)
        runs: list[str] = []
        pieces: list = []  # a number: the run of that number; an array: ids
        owner: list[int] = []
        for i, w in enumerate(words):
            if self.chars.issuperset(w):
                pieces.append(len(runs))
                owner.append(i)
                runs.append(w)
                continue
            for part in self.aliens.split(w):
                if part and part[0] in self.chars:
                    pieces.append(len(runs))
                    runs.append(part)
                elif part:
                    pieces.append(np.array([self.bytes_of[b] for b in part.encode("utf-8", "replace")] if self.bytes_of else [self.unknown], np.int32))
                else:
                    continue
                owner.append(i)
        flat, counts = self.relaxed(runs) if runs else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        parts = [flat[cuts[x] : cuts[x + 1]] if isinstance(x, int) else x for x in pieces]
        sizes = np.bincount(np.array(owner), weights=np.array([len(x) for x in parts]), minlength=len(words)).astype(np.int64)
        return np.concatenate(parts), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each; null and empty texts have none."""
        pieces, counts = [], []
        for t in texts:
            n = len(pieces)
            if t:
                t = self.library.normalize(t)
                pieces += self.words.findall(t) if self.splits_words else [t]
            counts.append(len(pieces) - n)
        if not self.remember:
            self.interned = Interned(self._encode_words, most=0)
        return self.interned.ids(pieces, counts)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that the encoder puts first is dropped, broken UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip, ids`` and the columns in ``keep`` for every row of ``docs (doc_id, text)``.

    ids are those of the SentencePiece model at ``path`` (present on every executor), without start and end marks;
    null and empty texts have none. ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. round_trip tells
    whether decoding gives the text again (null as an empty one). Whole texts are encoded, in bounded batches.
    """
    bound_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches):
        m = model(path)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts) or not len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                ids, counts = m.encode(texts[at:end])
                cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                raw = ids.astype("<u4")
                crcs, same = [], []
                for t, a, b in zip(texts[at:end], cuts[:-1].tolist(), cuts[1:].tolist()):
                    crcs.append(zlib.crc32(raw[a:b].tobytes()))
                    same.append(m.decode(ids[a:b].tolist()) == (t or ""))
                cols = [batch.column("doc_id").slice(at, end - at), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols + [batch.column(c).slice(at, end - at) for c in keep], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids", *keep])
                if end == len(texts):
                    break
                at = end

    wanted = list(dict.fromkeys(["doc_id", "text", *keep]))
    schema = ", ".join(["doc_id long", "n_tokens long", "ids_crc32 long", "round_trip boolean", "ids array<int>", *[f"`{c}` {kinds[c]}" for c in keep]])
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*wanted).mapInArrow(run, schema)
