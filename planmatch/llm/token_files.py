"""Token ids in compressed files: a static range asymmetric numeral system (rANS) over blocks that any task can decode by itself.

A file holds up to ``FILE_IDS`` consecutive ids, one table of their frequencies that all of its blocks share, an index of the documents that the ids belong to, and the
blocks. A block's ids are dealt to lanes in turn; the lanes' states are 64 bits wide and give or take 32-bit words, all words of a step side by side. Every
``STEP`` steps a block has a checkpoint, the lanes' states and the place in its words: decoding starts at any of them, so that the parts between checkpoints are decoded side by
side, and a range of ids costs no more than the parts that hold it. Header, table and index have a checksum, and each block one of its ids.

Documents are put in ascending order of doc_id by a range shuffle and encoded as each sorted partition passes by; nothing is held but the ids of one file. Files
are rows of a table that Spark writes (partition, number, first id within the partition, count, content), so that any store that Spark writes to will do; ``export`` and
``imported`` turn them into files of their own and back. Where a file begins among all ids follows from the counts of the partitions before.

Defined results: null text counts as empty and is the end token alone; a null doc_id comes first and stays null; repeated rows are documents each, those of one
doc_id in the order of their texts' hashes; a document longer than a file continues in the next; other columns aren't read; an empty table gives an empty table; a file that was
changed or cut off raises ``Damaged``. Ids are those of the tokenizers library, by an encoder of the same vocabulary that is five times as fast (``packing.encoder``, compared in
the tests).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planmatch.llm.packing import END, default_tokenizer, encoder
from planmatch.llm.storage import cut, shared_folder
from planmatch.llm.words import slices

MAGIC = b"rANSids1"
#: Ids of a file, of a block, and steps between checkpoints.
FILE_IDS, BLOCK, STEP = 1 << 21, 1 << 18, 256
#: Lanes of a full block, and ids that each lane of a smaller one has at least.
LANES, LEAST = 512, 64
#: Bytes of texts for each range of doc_id, and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES = 32 << 20, 50_000
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
HEADER = struct.Struct("<8sBIIIIII")
HEAD = struct.Struct("<IIIII")


class Damaged(ValueError):
    """A file whose bytes aren't those that were written."""


# ---------------------------------------------------------------- the code


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in use, their frequencies, which sum to a power of two and are 1 at least, and that power."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = max(12, int(4 * len(symbols) - 1).bit_length())
    whole = 1 << bits
    f = np.maximum(1, counts * whole // counts.sum())
    over = int(f.sum()) - whole
    while over:
        # the largest give or take first, each by its share
        order = np.lexsort((symbols, -f))
        step = np.minimum(f[order] - 1, np.maximum(1, f[order] * abs(over) // whole)) if over > 0 else np.maximum(1, f[order] * -over // whole)
        used = np.clip(abs(over) - (np.cumsum(step) - step), 0, step)
        f[order] += -used if over > 0 else used
        over = int(f.sum()) - whole
    return symbols, f, bits


def lanes(n: int) -> int:
    return int(min(LANES, max(1, n // LEAST)))


def encode_blocks(place: np.ndarray, f: np.ndarray, first: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one length (a row each of ``place``, the symbols' places in the table), all encoded side by side: offsets of words and states at checkpoints, and words."""
    many, n = place.shape
    wide = lanes(n)
    steps = -(-n // wide)
    x = np.full((many, wide), LOW, np.uint64)
    top = np.uint64(63 - bits)
    up = np.uint64(bits)
    words, counts, states = [], np.zeros((steps, many), np.int64), {}
    for t in range(steps - 1, -1, -1):
        own = place[:, t * wide : (t + 1) * wide]
        now, freq = x[:, : own.shape[1]], f[own]
        full = now >= freq << top
        words.append(now[full].astype("<u4"))
        counts[t] = full.sum(1)
        now = np.where(full, now >> WORD, now)
        q = now // freq
        x[:, : own.shape[1]] = (q << up) + (now - q * freq) + first[own]
        if t % STEP == 0:
            states[t] = x.copy()
    words = words[::-1]
    block = np.concatenate([np.repeat(np.arange(many), c) for c in counts]) if words else np.zeros(0, np.int64)
    flat = np.concatenate(words)[np.argsort(block, kind="stable")]
    ends = np.cumsum(counts.sum(0))
    before = np.cumsum(counts, axis=0) - counts
    at = range(0, steps, STEP)
    return [(before[list(at), b].astype("<u4"), np.stack([states[t][b] for t in at]).astype("<u8"), flat[ends[b] - counts[:, b].sum() : ends[b]]) for b in range(many)]


def decode_blocks(parts: list[tuple[int, np.ndarray, np.ndarray]], words: np.ndarray, wide: int, f: np.ndarray, first: np.ndarray, by_slot: np.ndarray, bits: int) -> np.ndarray:
    """Symbols' places of parts between checkpoints, decoded side by side: a row for each part of (ids, offset of its words, states)."""
    n = np.array([p[0] for p in parts])
    at, x = np.array([p[1] for p in parts], np.int64), np.stack([p[2] for p in parts])
    steps = -(-int(n.max()) // wide)
    out = np.zeros((len(parts), steps * wide), np.int64)
    mask, up = np.uint64((1 << bits) - 1), np.uint64(bits)
    lane = np.arange(wide)
    whole = int(n.min()) // wide
    words = np.append(words, np.zeros(1, words.dtype))
    for t in range(steps):
        slot = x & mask
        s = by_slot[slot]
        new = f[s] * (x >> up) + slot - first[s]
        empty = new < LOW
        if t >= whole:
            on = (t * wide + lane)[None] < n[:, None]
            empty &= on
            new = np.where(on, new, x)
        taken = np.cumsum(empty, axis=1)
        i = np.flatnonzero(empty)
        if len(i):
            source = (at[:, None] + taken - 1).ravel()[i]
            if source[-1] >= len(words) or int(source.max()) >= len(words):
                raise Damaged("a block ends before its ids")
            flat = new.ravel()
            flat[i] = (flat[i] << WORD) | words[source].astype(np.uint64)
            new = flat.reshape(new.shape)
        at += taken[:, -1]
        x = new
        out[:, t * wide : (t + 1) * wide] = s
    return out


# ---------------------------------------------------------------- the file


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def encode_file(ids: np.ndarray, index: bytes = b"") -> bytes:
    """The image of a file of ``ids`` (at least one), with any index of what they belong to."""
    symbols, freq, bits = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    f, first = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    table, index = packed(np.concatenate([np.diff(symbols, prepend=0), freq]).astype("<u4")), zlib.compress(index, 1)
    whole = len(ids) // BLOCK
    groups = ([ids[: whole * BLOCK].reshape(whole, BLOCK)] if whole else []) + ([ids[None, whole * BLOCK :]] if len(ids) % BLOCK else [])
    blocks = []
    for rows in groups:
        for own, (offsets, states, words) in zip(rows, encode_blocks(place[rows], f, first, bits)):
            head = HEAD.pack(len(own), states.shape[1], len(offsets), len(words), zlib.crc32(own.astype("<u4").tobytes()))
            blocks.append(head + offsets.tobytes() + states.tobytes() + words.tobytes())
    directory = np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
    head = HEADER.pack(MAGIC, bits, len(ids), len(symbols), len(table), len(index), len(blocks), 0)
    sum_ = zlib.crc32(head + table + index + directory)
    return HEADER.pack(MAGIC, bits, len(ids), len(symbols), len(table), len(index), len(blocks), sum_) + table + index + directory + b"".join(blocks)


class File:
    """A file's image, read back."""

    def __init__(self, content: bytes):
        if len(content) < HEADER.size or content[:8] != MAGIC:
            raise Damaged("not a file of token ids")
        _, self.bits, self.count, used, table, index, blocks, sum_ = HEADER.unpack_from(content)
        a = HEADER.size
        b, c = a + table, a + table + index
        self.body = c + 8 * (blocks + 1)
        head = HEADER.pack(MAGIC, self.bits, self.count, used, table, index, blocks, 0)
        if zlib.crc32(head + content[a : self.body]) != sum_:
            raise Damaged("header, table or index isn't what was written")
        numbers = np.frombuffer(zlib.decompress(content[a:b]), "<u4").astype(np.int64)
        self.symbols, freq = np.cumsum(numbers[:used]), numbers[used:]
        self.freq, self.first = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.by_slot = np.repeat(np.arange(used), freq)
        self.index = zlib.decompress(content[b:c])
        self.directory = np.frombuffer(content, "<u8", blocks + 1, c).astype(np.int64)
        if len(content) != self.body + self.directory[-1]:
            raise Damaged("the file's length isn't what was written")
        self.content = content

    def block(self, b: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids, lanes, offsets and states at checkpoints, words and checksum of a block."""
        at = self.body + int(self.directory[b])
        n, wide, checkpoints, words, sum_ = HEAD.unpack_from(self.content, at)
        at += HEAD.size
        if at + 4 * checkpoints + 8 * checkpoints * wide + 4 * words != self.body + int(self.directory[b + 1]):
            raise Damaged("a block's length isn't what was written")
        offsets = np.frombuffer(self.content, "<u4", checkpoints, at)
        states = np.frombuffer(self.content, "<u8", checkpoints * wide, at + 4 * checkpoints).reshape(checkpoints, wide)
        return n, wide, offsets, states, np.frombuffer(self.content, "<u4", words, at + 4 * checkpoints + 8 * checkpoints * wide), sum_

    def _decoded(self, chosen: list[tuple], ranges: list[tuple[int, int]]) -> list[np.ndarray]:
        """Ids of parts ``ranges`` of blocks ``chosen``, of one number of lanes each, decoded side by side."""
        words, base, parts = [], 0, []
        wide = chosen[0][1]
        for (n, _, offsets, states, own, _), (a, b) in zip(chosen, ranges):
            parts += [(min(n - p * STEP * wide, STEP * wide), base + int(offsets[p]), states[p]) for p in range(a, b)]
            words.append(own)
            base += len(own)
        places = decode_blocks(parts, np.concatenate(words), wide, self.freq, self.first, self.by_slot, self.bits)
        out, at = [], 0
        for a, b in ranges:
            out.append(self.symbols[np.concatenate([places[at + i, : parts[at + i][0]] for i in range(b - a)])].astype("<u4"))
            at += b - a
        return out

    def ids(self) -> np.ndarray:
        """All ids, each block held against its checksum."""
        blocks = [self.block(b) for b in range(len(self.directory) - 1)]
        out = []
        for wide in dict.fromkeys(x[1] for x in blocks):
            chosen = [x for x in blocks if x[1] == wide]
            found = self._decoded(chosen, [(0, len(x[2])) for x in chosen])
            if any(zlib.crc32(ids.tobytes()) != x[5] for ids, x in zip(found, chosen)):
                raise Damaged("a block isn't what was written")
            out += found
        return np.concatenate(out)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive) alone, from the checkpoint before; only whole blocks have a checksum."""
        start, stop, out, at = max(start, 0), min(stop, self.count), [], 0
        for b in range(len(self.directory) - 1):
            block = self.block(b)
            a, z = max(start - at, 0), min(stop - at, block[0])
            if a < z:
                part = STEP * block[1]
                (found,) = self._decoded([block], [(a // part, -(-z // part))])
                out.append(found[a - a // part * part : z - a // part * part])
            at += block[0]
        return np.concatenate(out) if out else np.zeros(0, "<u4")


# ---------------------------------------------------------------- checksums of joined parts


def times(a: int, b: int) -> int:
    """Product of polynomials over two elements modulo that of CRC-32, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the length of the second."""
    power, square, n = 1 << 31, 1 << 23, length
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(power, first) ^ second


# ---------------------------------------------------------------- documents


FILES = "part long, number long, first long, n_ids long, content binary"
PARTS = "part long, number long, place long, doc_id long, first long, n_tokens long, ids_crc32 long, begins boolean, ends boolean"
#: Of a document in a file's index: doc_id, whether it has one, ids here, whether they begin it and end it.
ENTRY = np.dtype([("doc_id", "<i8"), ("named", "u1"), ("n", "<u4"), ("begins", "u1"), ("ends", "u1")])


def encoded(docs: DataFrame, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """FILES of the documents (doc_id, text) in ascending order of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = int(min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))))
    ranges = max(ranges, min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    # rows of one doc_id are told apart, so that a range can end between them
    order = ["doc_id", F.xxhash64("text"), "place"]
    sorted_ = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])

    def go(batches):
        encode, part = encoder(tokenizer).encode_to_numpy, TaskContext.get().partitionId()
        held, entries, count, number, first = [], [], 0, 0, 0

        def flush():
            nonlocal held, entries, count, number, first
            ids = np.concatenate(held)
            row = [part], [number], [first], [count], [encode_file(ids, np.array(entries, ENTRY).tobytes())]
            held, entries, count, number, first = [], [], 0, number + 1, first + count
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in slices(batches, "text", 4 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or "", allowed_special="all"), np.uint32(END))
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, file_ids - count)
                    held.append(ids[at : at + n])
                    entries.append((doc or 0, doc is not None, n, at == 0, at + n == len(ids)))
                    count, at = count + n, at + n
                    if count == file_ids:
                        yield flush()
        if count:
            yield flush()

    return sorted_.select("doc_id", "text").mapInArrow(go, FILES)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> None:
    """The documents' ids, as a table of files below ``path``; their content is compressed already."""
    encoded(docs, tokenizer or default_tokenizer(), file_ids).write.option("compression", "none").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a table of files."""
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())])

    def go(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, first = (batch.column(c)[i].as_py() for c in ("part", "number", "first"))
                file = File(batch.column("content")[i].as_py())
                data, index = file.ids().tobytes(), np.frombuffer(file.index, ENTRY)
                ends = np.cumsum(index["n"].astype(np.int64))
                starts = ends - index["n"]
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                m = len(index)
                columns = [np.full(m, part), np.full(m, number), np.arange(m), pa.array(index["doc_id"], mask=index["named"] == 0), first + starts, ends - starts, sums, index["begins"] == 1, index["ends"] == 1]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip(columns, schema)], schema=schema)

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each range of doc_id: MOST_RANGES at most, unless a table of files was made with more
    before = parts.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = cut(files.mapInArrow(go, PARTS)).join(F.broadcast(before), F.col("part") == F.col("__part"))
    found = found.select(*found.columns[:4], (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "begins", "ends")
    whole = found.filter("begins and ends").select("doc_id", "start", "n_tokens", "ids_crc32")
    return whole.unionByName(joined(found.filter("not (begins and ends)")))


def joined(parts: DataFrame) -> DataFrame:
    """Documents of their parts: a part begins where the one before it ends. Parts are few, as only the first and last document of a file can have others, and each is a number of bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def go(batches):
        doc = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["begins"]:
                    doc = [r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]]
                else:
                    doc = [*doc[:2], doc[2] + r["n_tokens"], crc32_joined(doc[3], r["ids_crc32"], 4 * r["n_tokens"])]
                if r["ends"]:
                    rows.append(doc)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    # a range's files are one task's, as they were when written; a document may go on in the next range only if it is the last row of one, which it isn't
    return parts.repartition("part").sortWithinPartitions("part", "number", "place").mapInArrow(go, "doc_id long, start long, n_tokens long, ids_crc32 long")


def filesystem(path: str):
    """A store by its address, for tasks that write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def export(files: DataFrame, folder: str) -> DataFrame:
    """Each file of the table as a file of its own below ``folder``, which all tasks reach; gives path and bytes. A task that runs again writes the same files again."""

    def go(batches):
        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for r in batch.to_pylist():
                name = f"ids-{r['part']:06d}-{r['number']:06d}-{r['first']:015d}.rans"
                part = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as out:
                    out.write(r["content"])
                store.move(part, f"{top}/{name}")
                paths.append(f"{folder}/{name}")
                sizes.append(len(r["content"]))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return cut(files.mapInArrow(go, "path string, bytes long"))


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files that were exported to ``folder``, read by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.rans").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    at = lambda i: F.regexp_extract(name, r"^ids-(\d+)-(\d+)-(\d+)\.rans$", i).cast("long")

    def counted(batches):
        for batch in batches:
            n = [File(c).count for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "number", "first")), pa.array(n, pa.int64()), batch.column("content")], names=["part", "number", "first", "n_ids", "content"])

    return found.select(at(1).alias("part"), at(2).alias("number"), at(3).alias("first"), "content").mapInArrow(counted, FILES)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read(spark.read.parquet(path))
