"""N-gram language-model scores from an Elias-Fano trie in shards.

Words are numbered first: buckets by hash add up the counts that chunks of documents send, and number their words by count, so that frequent words have small
numbers everywhere. Then chunks send their distinct windows of as many words as the order, as word numbers, to shards by first word, with their counts in training documents; every shorter
n-gram is the beginning of a window, as texts are padded at both ends. One stage adds the counts up and builds the shard's trie of them as one file: the first words as a monotone
sequence, and for each level a monotone pointer to where a place's successors begin in the next one, the successors of all places as one monotone sequence relative to their place, and
smoothed probabilities quantised to 16 bits. The place of two words in the second level is the context of the third. Another stage maps that file into memory and answers from it
alone for the windows of all chunks, those of held-out documents among them, each distinct one once: a word is searched between the two pointers of the place that the words before it led to.

The model interpolates orders: p(w | context) = (c(context w) + s * p(w | shorter context)) / (c(context) + s), down to p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). It
sums to one over the training words and one unseen word. A shard holds c(context w) / (c(context) + s) for each successor and s / (c(context) + s) for each context, which
depend on nothing outside it; a chunk puts the orders together, each from the shard of its context's first word. Counts cover every training document; nothing is pruned, and words are compared
by their exact numbers.

What is sent grows with the input, and no table of all words or n-grams is in one place. Windows of a word too frequent for one shard are dealt over several by their second word, and those of two words
too frequent still by the third; the counts of these contexts are then sent to each. From order 4 on, windows with three words in common stay together. Chunks and shards get larger as the
input does, so that records don't shrink with its square: they hold hundreds of n-grams up to about a terabyte.
Documents are dealt to chunks by id, text and how often the task has seen both, so that no repeated row or id fills a chunk.

Defined results: null text counts as empty and has one token, the end; a null doc_id is learnt from and not held out; repeated rows each count; no columns but
doc_id and text are read; with no training documents p(w) is 1 for every token; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.words import END, mix, prime, raw, route_np, runs, slices, word_hashes

STEP = 1 / 512  # of quantised log10 probabilities, which are thus right within 0.1 % or so
NONE = 65535


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A sorted array of numbers: low bits packed, high bits in unary, with counts of zeros before each word for select."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        low, high = values & np.uint64((1 << low_bits) - 1), (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(-(-(n + (int(universe) >> low_bits) + 2) // 64) * 8, np.uint8)
        at = high + np.arange(n)
        np.bitwise_or.at(unary, at >> 3, (1 << (at & 7)).astype(np.uint8))
        packed = np.zeros((n * low_bits >> 6) + 2, np.uint64)
        if low_bits:
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(packed, word, low << shift)
            over = np.where(shift > 0, low >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            np.bitwise_or.at(packed, word + 1, over)
        self._open(n, low_bits, unary.view(np.uint64), packed)

    @classmethod
    def of(cls, n: int, low_bits: int, high: np.ndarray, low: np.ndarray) -> EliasFano:
        """One that was built before, from its parts, which may be mapped."""
        self = cls.__new__(cls)
        self._open(n, low_bits, high, low)
        return self

    def _open(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray) -> None:
        self.n, self.low_bits, self.high, self.low = n, low_bits, high, low
        self.zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.int64)
        self.ones = 64 * np.arange(len(self.zeros)) - self.zeros

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        second = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift) | second) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of bit number k of its kind in the unary part."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        bits, rest, place = self.high[word] if one else ~self.high[word], k - before[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            under = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = rest >= under
            rest = np.where(skip, rest - under, rest)
            bits = np.where(skip, bits >> np.uint64(width), bits)
            place = place + np.where(skip, width, 0)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each number among those from ``first`` to before ``end``, or -1: successor search among those with its high bits."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        high, want = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        b = self._select(high, False) - high
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, end)
        stop = b
        while (open_ := a < b).any():
            m = (a + b) >> 1
            less = open_ & (self._low(np.minimum(m, self.n - 1)) < want)
            a, b = np.where(less, m + 1, a), np.where(open_ & ~less, m, b)
        hit = (a < stop) & (self._low(np.minimum(a, self.n - 1)) == want)
        return np.where(hit, a, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) / STEP), 0, NONE - 1).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10.0 ** (-STEP * code.astype(float)))


def write_trie(words: list[np.ndarray], owner: list[np.ndarray], share: list[np.ndarray], back: list[np.ndarray]) -> bytes:
    """A trie as one file. For each level, its words in order of the place of the words before (``owner``) and then by number; ``share`` has the codes of all
    places but those of the first level, ``back`` those of all but the last."""
    above = int(max((w.max() for w in words if len(w)), default=0)) + 1
    head, parts, size = {"above": above, "arrays": [], "coded": []}, [], 0

    def add(array: np.ndarray) -> None:
        nonlocal size
        data = np.ascontiguousarray(array).tobytes()
        head["arrays"].append((array.dtype.str, len(array), size))
        parts.append(data + b"\0" * (-len(data) % 64))
        size += len(parts[-1])

    def code(values: np.ndarray, universe: int) -> None:
        found = EliasFano(values.astype(np.uint64), max(1, universe))
        head["coded"].append((found.n, found.low_bits))
        add(found.high)
        add(found.low)

    for k, w in enumerate(words):
        before = len(words[k - 1]) if k else 1
        if k:
            code(np.searchsorted(owner[k], np.arange(before + 1)), len(w) + 1)
        code(owner[k].astype(np.uint64) * np.uint64(above) + w if k else w, before * above)
        if k:
            add(share[k])
        if k < len(words) - 1:
            add(back[k])
    front = json.dumps(head).encode()
    return len(front).to_bytes(8, "little") + front + b"\0" * (-(len(front) + 8) % 64) + b"".join(parts)


class Trie:
    """A file of ``write_trie``, mapped into memory."""

    def __init__(self, data: bytes):
        self._file = tempfile.TemporaryFile()
        self._file.write(data)
        self._file.flush()
        end = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:end])
        start, arrays, coded = end + -end % 64, iter(head["arrays"]), iter(head["coded"])

        def array() -> np.ndarray:
            kind, n, at = next(arrays)
            return np.memmap(self._file, np.dtype(kind), "r", start + at, (n,)) if n else np.zeros(0, np.dtype(kind))

        def code() -> EliasFano:
            return EliasFano.of(*next(coded), array(), array())

        self.above, self.pointers, self.successors, self.share, self.back = head["above"], [], [], [], []
        levels = (len(head["coded"]) + 1) // 2
        for k in range(levels):
            if k:
                self.pointers.append(code())
            self.successors.append(code())
            self.share.append(array() if k else None)
            if k < levels - 1:
                self.back.append(array())

    def close(self) -> None:
        self._file.close()

    def walk(self, words: list[np.ndarray], owner: list[np.ndarray]) -> tuple[list, list]:
        """For windows as ``write_trie`` has them: for each level but the first, codes of the share of each place among the words that follow the place before, NONE where
        there is none; for each but the last, codes of what the shorter context gets after a place, 0 (all) where it isn't here."""
        shares, backs, at = [None], [], np.zeros(0, np.int64)
        for k, w in enumerate(words):
            place = np.full(len(w), -1, np.int64)
            if not k:
                known = np.flatnonzero(w < self.above)
                place[known] = self.successors[0].find(w[known])
            else:
                bounds = np.zeros((2, len(at)), np.int64)
                found = np.flatnonzero(at >= 0)
                if len(found):
                    bounds[:, found] = [self.pointers[k - 1].get(at[found] + i).astype(np.int64) for i in (0, 1)]
                known = np.flatnonzero((bounds[1] > bounds[0])[owner[k]] & (w < self.above))
                o = owner[k][known]
                place[known] = self.successors[k].find(at[o].astype(np.uint64) * np.uint64(self.above) + w[known], bounds[0][o], bounds[1][o])
                shares.append(np.full(len(w), NONE, np.uint16))
                shares[k][place >= 0] = self.share[k][place[place >= 0]]
            if k < len(words) - 1:
                backs.append(np.zeros(len(w), np.uint16))
                backs[k][place >= 0] = self.back[k][place[place >= 0]]
            at = place
        return shares, backs


# ---------------------------------------------------------------- what chunks and shards send


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers; sorted ones by their differences. Bytes of one weight lie side by side."""
    parts, head = [], [np.array([len(columns), *map(len, columns)], np.uint32).tobytes()]
    for c in columns:
        c = c.astype(np.uint64)
        if rising := bool((c[1:] >= c[:-1]).all()):
            c = np.diff(c, prepend=np.uint64(0))
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        head.append(bytes([width | rising << 7]))
        parts.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.compress(b"".join(head + parts), 1)


def grown(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    k = int.from_bytes(data[:4], "little")
    lengths, at = np.frombuffer(data, np.uint32, k, 4).tolist(), 4 + 5 * k
    out = []
    for x, n in zip(data[4 + 4 * k : at], lengths):
        width = x & 127
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        c = full.view(np.uint64).reshape(-1)
        out.append(np.cumsum(c, dtype=np.uint64) if x >> 7 else c)
        at += n * width
    return out


def answered(share: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Codes of shares as little to send: the distance from their contexts' back-offs, which depends on the count alone but for rounding, or ``APART`` for none."""
    return np.where(share == NONE, APART, share - back)


def codes(away: np.ndarray, back: np.ndarray) -> np.ndarray:
    away = away.astype(np.uint16)
    return np.where(away == APART, np.uint16(NONE), away + back.astype(np.uint16))


#: No distance of codes: it would take counts above 10**18.
APART = np.uint16(32768)
DEALT = "g int, docs binary, train binary, lengths binary, texts binary"
ASKED = "key int, g int, items binary, counts binary, heads binary, pairs binary"
BUILT = "key int, trie binary"
TOLD = "g int, key int, found binary, n long, v long"
NO_ID = np.iinfo(np.int64).min
_ASKED = pa.schema([("key", pa.int32()), ("g", pa.int32()), *((c, pa.binary()) for c in ("items", "counts", "heads", "pairs"))])
_BUILT = pa.schema([("key", pa.int32()), ("trie", pa.binary())])
_TOLD = pa.schema([("g", pa.int32()), ("key", pa.int32()), ("found", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them each value is."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def deal(docs: DataFrame, chunks: int, held: int = 16 << 20) -> DataFrame:
    """Documents by chunk, in compressed parts."""
    schema = pa.schema([("g", pa.int32()), *((c, pa.binary()) for c in ("docs", "train", "lengths", "texts"))])

    def go(batches):
        parts: list[pa.RecordBatch] = []
        seen: dict[tuple[int, int], int] = {}

        def out():
            for batch in pa.Table.from_batches(parts).combine_chunks().to_batches():
                doc = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy()
                body, off = raw(batch.column("text"))
                data, key = body.tobytes(), np.zeros(len(doc), np.uint64)
                for i, d in enumerate(doc.tolist()):
                    own = d, zlib.crc32(data[off[i] : off[i + 1]])
                    again = seen[own] = seen.get(own, -1) + 1
                    key[i] = (own[1] << 20) ^ again
                g = route_np(mix(key + doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), chunks)
                order = np.argsort(g, kind="stable")
                at = runs(g[order])
                for i, j in zip(at[:-1], at[1:]):
                    part = batch.take(pa.array(order[i:j]))
                    body, off = raw(part.column("text"))
                    data = (doc[order[i:j]], part.column("train").to_numpy(zero_copy_only=False), np.diff(off))
                    yield pa.RecordBatch.from_arrays([pa.array([g[order[i]]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data), pa.array([zstandard.compress(body.tobytes(), 3)], pa.binary())], schema=schema)

        size = 0
        for batch in slices(batches, "text", 1 << 20):
            parts.append(batch)
            size += len(raw(batch.column("text"))[0])
            if size > held:
                yield from out()
                parts, size = [], 0
        if parts:
            yield from out()

    return docs.mapInArrow(go, DEALT)


class Chunk:
    """The rows of a chunk in a fixed order, whatever the order of its parts, and their tokens."""

    def __init__(self, part: pa.Table):
        cols = {c: part.column(c).to_pylist() for c in ("docs", "train", "lengths", "texts")}
        order = sorted(range(part.num_rows), key=lambda i: (cols["docs"][i], cols["texts"][i], cols["train"][i], cols["lengths"][i]))
        self.doc, self.train, lengths = (np.concatenate([np.frombuffer(cols[c][i], t) for i in order]) for c, t in (("docs", np.int64), ("train", bool), ("lengths", np.int64)))
        at = np.concatenate([[0], np.cumsum(lengths)])
        body = b"".join(zstandard.decompress(cols["texts"][i]) for i in order)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(body)])
        words, first = word_hashes(text, lower=True)
        n = len(first) - 1
        self.at = first + np.arange(n + 1)
        tokens = np.full(len(words) + n, END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.at[1:] - 1] = False
        tokens[inner] = words
        self.own, _, self.which = numbered(tokens)
        self.weight = np.repeat(self.train.astype(np.int64), np.diff(self.at))
        self.counts = np.bincount(self.which, self.weight, len(self.own)).astype(np.int64)

    def told(self, answers: pa.Table, bits: int) -> None:
        """Takes the words' numbers and counts over all training documents from the answers of the buckets of words."""
        parts = sorted((k, a) for k, a in zip(answers.column("key").to_pylist(), answers.column("found").to_pylist()) if k >> bits == 0)
        number, total = (np.concatenate(x) for x in zip(*(grown(a) for _, a in parts)))
        if len(number) != len(self.own):
            raise RuntimeError("a chunk's texts changed between two reads")
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.total = total.astype(np.int64)
        # place 0 stands for the start of a text
        self.local, self.numbers, self.frequency = rank[self.which] + 1, np.append(np.uint64(0), number[order]), np.append(np.int64(0), self.total[order])

    def windows(self, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The distinct windows of an order, as columns of places in ``numbers``, in order; how often each is in training documents; and which of them each window is. A text of n
        tokens has n + order - 2, from one of its first word after starts to one of its last two before as many zeros as there is room for."""
        texts = np.arange(len(self.at) - 1)
        text = np.repeat(texts, np.diff(self.at))
        padded = np.zeros(len(self.local) + len(texts) * (2 * order - 3), np.int64)
        padded[np.arange(len(text)) + text * (2 * order - 3) + order - 1] = self.local
        count = np.diff(self.at) + order - 2
        begin = np.arange(count.sum()) + np.repeat(texts, count) * (order - 1)
        m, size = len(self.numbers), 1
        code = np.zeros(len(begin), np.int64)
        for k in range(order):
            if size * m >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                size = int(code.max()) + 1
            code, size = code * m + padded[begin + k], size * m
        _, place, which = numbered(code)
        # the window that begins with a token's longest context; those of shorter ones follow
        self.window_of = np.arange(len(text)) + text * (order - 2)
        trained = np.bincount(which, np.repeat(self.train, count).astype(np.int64), len(place)).astype(np.int64)
        return [padded[begin[place] + k] for k in range(order)], trained, which


class Dealing:
    """Which shard a window goes to: by first word, and by the second and third too where what is before them may be more frequent than a shard is large."""

    def __init__(self, bits: int, items: int, texts: int):
        self.bits, self.items, self.texts = bits, items, texts

    def shares(self, chunk: Chunk, places: list[np.ndarray]) -> np.ndarray:
        """Over how many shards a context is dealt: an n-gram is at most as frequent as each of its words."""
        most = chunk.frequency.copy()
        most[0] = self.texts
        return np.maximum(1, -(-np.minimum.reduce([most[c] for c in places]) // self.items))

    def part(self, before: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))

    def shard(self, parts: np.ndarray) -> np.ndarray:
        return (parts >> np.uint64(64 - self.bits)).astype(np.int64)


class Windows:
    """A chunk's distinct windows by shard, in each by word numbers, as levels of beginnings: a beginning is written once, however many windows go on from it."""

    def __init__(self, chunk: Chunk, order: int, dealing: Dealing):
        places, trained, self.which = chunk.windows(order)
        self.order, self.dealing, self.window_of = order, dealing, chunk.window_of
        numbers = [chunk.numbers[c] for c in places]
        shares, parts = [], [mix(numbers[0] + np.uint64(1))]
        for k in range(1, min(order, 3)):
            shares.append(dealing.shares(chunk, places[:k]))
            part = np.where(shares[-1] > 1, (mix(numbers[k]) % shares[-1].astype(np.uint64)).astype(np.int64), 0)
            parts.append(dealing.part(parts[-1], part))
        shard = dealing.shard(parts[-1])
        by_shard = np.argsort(shard, kind="stable")
        self.row = np.empty(len(by_shard), np.int64)
        self.row[by_shard] = np.arange(len(by_shard))
        shard, self.trained = shard[by_shard], trained[by_shard]
        self.numbers, self.shares, self.before = [c[by_shard] for c in numbers], [x[by_shard] for x in shares], [x[by_shard] for x in parts]
        self.frequency = chunk.frequency[places[0]][by_shard]
        self.at = runs(shard)
        self.shards = shard[self.at[:-1]].tolist() if len(shard) else []
        new = np.zeros(len(shard), bool)
        new[self.at[:-1]] = True
        self.new, self.first = [], []
        for c in self.numbers:
            new = new.copy()
            new[1:] |= c[1:] != c[:-1]
            self.new.append(new)
            self.first.append(np.flatnonzero(new))

    def items(self) -> list[bytes]:
        """For each shard the words of each level, less the sibling before, and how many each has in the next."""
        columns = []
        for k, first in enumerate(self.first):
            words = self.numbers[k][first]
            if k:
                less = words.copy()
                less[1:] -= np.where(self.new[k - 1][first[1:]], np.uint64(0), words[:-1])
                words = less
            columns.append((k, words))
            if k < self.order - 1:
                columns.append((k, np.diff(np.searchsorted(self.first[k + 1], np.append(first, len(self.row))))))
        bounds = [np.searchsorted(first, self.at) for first in self.first]
        return [squeezed(*(c[bounds[k][i] : bounds[k][i + 1]] for k, c in columns)) for i in range(len(self.shards))]

    def heads(self) -> list[bytes | None]:
        """For each shard its first words that are dealt over several, with how often they are a context."""
        first = self.first[0]
        most = np.where(self.numbers[0][first] == 0, self.dealing.texts, self.frequency[first])
        split, bounds = self.shares[0][first] > 1, np.searchsorted(first, self.at)
        out = []
        for i, j in zip(bounds[:-1], bounds[1:]):
            own = np.flatnonzero(split[i:j]) + i
            out.append(squeezed(self.numbers[0][first[own]], most[own]) if len(own) else None)
        return out

    def pairs(self) -> dict[int, bytes]:
        """By shard, pairs of words that are dealt over several, with how often they are a context here."""
        if self.order < 3:
            return {}
        rows = np.flatnonzero((self.shares[1] > 1) & (self.trained > 0) & (self.numbers[2] > 0))
        if not len(rows):
            return {}
        # rows of a pair lie in several shards, so that they are put side by side first
        rows = rows[np.lexsort((self.numbers[1][rows], self.numbers[0][rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (self.numbers[0][rows[1:]] != self.numbers[0][rows[:-1]]) | (self.numbers[1][rows[1:]] != self.numbers[1][rows[:-1]])
        first = np.flatnonzero(new)
        own, count = rows[first], np.add.reduceat(self.trained[rows], first)
        copies = self.shares[1][own]
        which = np.repeat(np.arange(len(own)), copies)
        part = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
        shard = self.dealing.shard(self.dealing.part(self.before[1][own[which]], part))
        place = np.unique(shard * len(own) + which)
        shard, which = place // len(own), place % len(own)
        at = runs(shard)
        return {int(shard[i]): squeezed(self.numbers[0][own[which[i:j]]], self.numbers[1][own[which[i:j]]], count[which[i:j]]) for i, j in zip(at[:-1], at[1:])}

    def owners(self, k: int) -> np.ndarray:
        """For each beginning of k + 1 words the place of its context among those of k."""
        return (np.cumsum(self.new[k - 1]) - 1)[self.first[k]]

    def places(self, k: int) -> np.ndarray:
        """For each token, the place of its n-gram of k + 1 words among the beginnings of that many."""
        of_window = (np.cumsum(self.new[k]) - 1)[self.row]
        return of_window[self.which[self.window_of + self.order - k - 1]]


def levels(items: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words and owners of each level, from what ``Windows.items`` wrote."""
    columns = grown(items)
    words, owner = [columns[0]], [np.zeros(len(columns[0]), np.int64)]
    for children, less in zip(columns[1::2], columns[2::2]):
        children = children.astype(np.int64)
        total = np.cumsum(less, dtype=np.uint64)
        words.append(total - np.repeat((total - less)[np.cumsum(children) - children], children))
        owner.append(np.repeat(np.arange(len(children)), children))
    return words, owner


def merged(asked: list[tuple[list, list]]) -> tuple[list, list, list]:
    """Words and owners of the distinct beginnings of many, level by level, and which of them each is, all of one level behind each other."""
    words, owner, which = [], [], []
    for k in range(len(asked[0][0])):
        w = np.concatenate([a[0][k] for a in asked])
        if not k:
            distinct, _, place = numbered(w)
            words.append(distinct)
            owner.append(np.zeros(len(distinct), np.int64))
        else:
            offset = np.cumsum([0, *(len(a[0][k - 1]) for a in asked)])
            before = which[-1][np.concatenate([a[1][k] + o for a, o in zip(asked, offset)])]
            above = int(w.max()) + 1
            distinct, _, place = numbered(before.astype(np.uint64) * np.uint64(above) + w)
            words.append(distinct % np.uint64(above))
            owner.append((distinct // np.uint64(above)).astype(np.int64))
        which.append(place)
    return words, owner, which


def built(asked: list[tuple[list, list]], counts: list[np.ndarray], heads: list[list], pairs: list[list], strength: float) -> bytes:
    """The trie of windows with their counts in training documents; ``heads`` and ``pairs``: how often contexts are there whose windows lie in other shards too."""
    words, owner, which = merged(asked)
    order = len(words)
    count = [np.zeros(len(w), np.int64) for w in words]
    np.add.at(count[-1], which[-1], np.concatenate(counts).astype(np.int64))
    for k in range(order - 2, -1, -1):
        np.add.at(count[k], owner[k + 1], count[k + 1])
    held = [c > 0 for c in count]
    # only words follow a context, neither another start nor what pads the end
    total = [np.bincount(owner[k + 1], np.where(words[k + 1] > 0, count[k + 1], 0), len(words[k])).astype(np.int64) for k in range(order - 1)]
    if heads:
        w, n = (np.concatenate(x) for x in zip(*heads))
        place = np.searchsorted(words[0], w)
        total[0][place] = n
        held[0][place] |= n > 0
    if pairs:
        w, v, n = (np.concatenate(x) for x in zip(*pairs))
        first = np.searchsorted(words[0], w)
        above = np.uint64(max(int(words[1].max()), int(v.max())) + 1)
        code, own = owner[1].astype(np.uint64) * above + words[1], first.astype(np.uint64) * above + v
        place = np.minimum(np.searchsorted(code, own), len(code) - 1)
        here = (first < len(words[0])) & (words[0][np.minimum(first, len(words[0]) - 1)] == w) & (code[place] == own)
        given = np.zeros(len(code), np.int64)
        np.add.at(given, place[here], n[here].astype(np.int64))
        total[1] = np.where(given > 0, given, total[1])
        count[1] = np.where(given > 0, given, count[1])
        held[1] |= given > 0
    share = [None, *(quantised(np.maximum(count[k], 1) / (np.maximum(total[k - 1][owner[k]], count[k]) + strength))[held[k]] for k in range(1, order))]
    back = [quantised(strength / (t + strength))[held[k]] for k, t in enumerate(total)]
    number = [np.cumsum(h) - 1 for h in held]
    return write_trie([w[h] for w, h in zip(words, held)], [owner[0][held[0]], *(number[k - 1][owner[k][held[k]]] for k in range(1, order))], share, back)


# ---------------------------------------------------------------- the model


def score_texts(docs: DataFrame, train: Column, order: int = 3, strength: float = 200.0, chunk_bytes: int | None = None, bucket_items: int | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    ``chunk_bytes`` of text are read at once, and a shard gets about ``bucket_items`` n-grams; both follow the size of the input where not given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("train", F.coalesce(train, F.lit(True)))
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    chunk_bytes = chunk_bytes or min(max(size >> 13, 8 << 20), 64 << 20)
    bucket_items = bucket_items or min(max((size // 6) >> 14, 1 << 20), 1 << 24)
    chunks = prime(max(1, int(size / chunk_bytes)))
    bits = max(1, int(size / 6 / bucket_items)).bit_length()
    buckets = 1 << bits
    dealing = Dealing(bits, bucket_items, texts)
    dealt = deal(docs.select("doc_id", "train", "text"), chunks)

    def ask_words(key: tuple, part: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        at = runs((bucket := (chunk.own >> np.uint64(64 - bits)).astype(np.int64)))
        return rows_of([(int(bucket[i]), key[0].as_py(), squeezed(chunk.own[i:j], chunk.counts[i:j]), None, None, None) for i, j in zip(at[:-1], at[1:]) if j > i], _ASKED)

    def tell_words(key: tuple, part: pa.Table) -> pa.Table:
        asked = [grown(x) for x in part.column("items").to_pylist()]
        own, _, which = numbered(np.concatenate([h for h, _ in asked]))
        total = np.zeros(len(own), np.int64)
        np.add.at(total, which, np.concatenate([c for _, c in asked]).astype(np.int64))
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((own, -total))] = np.arange(len(own))
        number = rank * buckets + key[0].as_py() + 1
        rows, at = [], 0
        for g, (h, _) in zip(part.column("g").to_pylist(), asked):
            mine = which[at : at + len(h)]
            rows.append((g, key[0].as_py(), squeezed(number[mine], total[mine]), 0 if at else int(total.sum()), 0 if at else int((total > 0).sum())))
            at += len(h)
        return rows_of(rows, _TOLD)

    def ask_grams(key: tuple, part: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        chunk.told(told, bits)
        windows = Windows(chunk, order, dealing)
        sent = {b: (x, squeezed(windows.trained[i:j]), h) for b, x, h, i, j in zip(windows.shards, windows.items(), windows.heads(), windows.at[:-1], windows.at[1:])}
        pairs = windows.pairs()
        return rows_of([(buckets + b, key[0].as_py(), *sent.get(b, (None, None, None)), pairs.get(b)) for b in sorted({*sent, *pairs})], _ASKED)

    def build(key: tuple, part: pa.Table) -> pa.Table:
        items, counts, heads, pairs = ([x for x in part.column(c).to_pylist() if x is not None] for c in ("items", "counts", "heads", "pairs"))
        if not items:
            return rows_of([], _BUILT)
        return rows_of([(key[0].as_py(), built([levels(x) for x in items], [grown(x)[0] for x in counts], [grown(x) for x in heads], [grown(x) for x in pairs], strength))], _BUILT)

    def tell_grams(key: tuple, part: pa.Table, tries: pa.Table) -> pa.Table:
        asked = [(g, levels(x)) for g, x in zip(part.column("g").to_pylist(), part.column("items").to_pylist()) if x is not None]
        if not asked:
            return rows_of([], _TOLD)
        words, owner, which = merged([x for _, x in asked])
        trie = Trie(tries.column("trie")[0].as_py())
        share, back = trie.walk(words, owner)
        trie.close()
        rows, at = [], np.zeros(order, np.int64)
        for g, (own, _) in asked:
            end = at + [len(w) for w in own]
            place = [which[k][at[k] : end[k]] for k in range(order)]
            columns = [x for k in range(1, order) for x in (answered(share[k][place[k]], back[k - 1][owner[k][place[k]]]), back[k - 1][place[k - 1]])]
            rows.append((g, key[0].as_py(), squeezed(*columns), 0, 0))
            at = end
        return rows_of(rows, _TOLD)

    told_words = dealt.groupBy("g").applyInArrow(ask_words, ASKED).groupBy("key").applyInArrow(tell_words, TOLD)
    told = told_words
    if order > 1:
        asked = dealt.groupBy("g").cogroup(told_words.groupBy("g")).applyInArrow(ask_grams, ASKED)
        tries = asked.groupBy("key").applyInArrow(build, BUILT)
        told = told.unionByName(asked.groupBy("key").cogroup(tries.groupBy("key")).applyInArrow(tell_grams, TOLD))
    sums = [told_words.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for c in ("n", "v")]
    told = told.select("g", "key", "found", sums[0].alias("n"), sums[1].alias("v"))

    def score(part: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        chunk.told(told, bits)
        n, v = told.column("n")[0].as_py(), told.column("v")[0].as_py()
        plain = (chunk.total + 0.5) / (n + 0.5 * (v + 1))
        p = plain[chunk.which]
        if order > 1:
            windows = Windows(chunk, order, dealing)
            answers = sorted((k, x) for k, x in zip(told.column("key").to_pylist(), told.column("found").to_pylist()) if k >= buckets)
            columns = [np.concatenate(x) for x in zip(*(grown(x) for _, x in answers))]
            for k in range(1, order):
                away, back = columns[2 * k - 2], columns[2 * k - 1][windows.owners(k)]
                place = windows.places(k)
                p = probability(codes(away, back))[place] + probability(back)[place] * p
        add = lambda x: np.add.reduceat(x, chunk.at[:-1])
        return pa.table(
            {
                "doc_id": pa.array(chunk.doc, mask=chunk.doc == NO_ID), "train": pa.array(chunk.train), "n_tokens": pa.array(np.diff(chunk.at), pa.int64()), "n_known": pa.array(add((chunk.total > 0)[chunk.which].astype(np.int64))),
                "train_tokens": pa.array(np.full(len(chunk.doc), n), pa.int64()), "base_score": pa.array(add(np.log10(plain)[chunk.which])), "score": pa.array(add(np.log10(p))),
            }
        )

    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(score, schema)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score_texts(docs, fold(F.col("doc_id")) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute_force(rows: list[tuple[int, str | None]], order: int = 3, strength: float = 200.0) -> dict[int, tuple]:
    """n_tokens, n_known, train_tokens, base_score, score by dictionaries, for small tables with distinct ids."""
    low = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
    split = {d: [w for w in (t or "").encode().translate(low).split() if w] + ["end"] for d, t in rows}
    counts: dict = {}
    for d, ws in split.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for i, w in enumerate(ws):
                for k in range(1, order + 1):
                    context = tuple((["start"] * order + ws)[i + order - k + 1 : i + order])
                    counts[context, w] = counts.get((context, w), 0) + 1
                    counts[context] = counts.get(context, 0) + 1
    n, v = counts.get((), 0), sum(1 for k in counts if len(k) == 2 and k[0] == () and isinstance(k[1], (bytes, str)))

    def p(context: tuple, w) -> float:
        if not context:
            return (counts.get(((), w), 0) + 0.5) / (n + 0.5 * (v + 1))
        return (counts.get((context, w), 0) + strength * p(context[1:], w)) / (counts.get(context, 0) + strength)

    out = {}
    for d, ws in split.items():
        padded = ["start"] * order + ws
        contexts = [tuple(padded[i + 1 : i + order]) for i in range(len(ws))]
        out[d] = (len(ws), sum(((), w) in counts for w in ws), n, sum(math.log10(p((), w)) for w in ws), sum(math.log10(p(c, w)) for c, w in zip(contexts, ws)))
    return out
