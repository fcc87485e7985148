"""Token ids in binary files, packed by Simple-8b.

Texts are encoded with the tokenizers library and a public vocabulary file, an end id is appended, and the ids of
consecutive documents (ascending doc_id, nulls last, ties by text) go to files, one segment after the other:

    header   magic "S8B2", bytes L, documents D, ids N, blocks B, escapes E, words W  (seven unsigned 64-bit, little-endian)
    names    doc_id of each document, and a bit for each that has one               (D signed 64-bit; bits padded to 8 bytes)
    counts   ids of each document                                                   (D unsigned 64-bit)
    offsets  first 64-bit word of each block of BLOCK ids                           (B unsigned 32-bit, padded to 8 bytes)
    escapes  position and value of ids of more than 60 bits                         (2 E unsigned 64-bit)
    words    4 selector bits on top, then the packed ids, first id lowest           (W unsigned 64-bit)

A selector says how many ids of how many bits a word holds.  Blocks start on a word of their own, so that all blocks of a
segment are packed and unpacked side by side by array operations.  A file's name has its shard (place in the order of
ids) and its number in the shard; a table beside the files has their numbers of documents and ids.  Files are written
under another name and moved, and a retried task writes the same bytes, so a lost executor leaves no half file.  The
folder is in the session's shared storage and must be one that pyarrow can write (file, hdfs, s3, gs).

Encoding memory: byte-level BPE splits text into pieces that never reach over a single space between two characters that
are no white space, nor from a letter to a sign, so texts are cut there, and each distinct part is encoded once for a bounded memo.  Texts with a
space at an end or beside other white space are encoded as a whole.  Strings of special tokens in a text are found by the
library as in a plain call; ``special_as_text`` makes them ordinary text.

Scale: one range shuffle of the texts by doc_id; a range is encoded, cut into bounded segments and written by one task.
Starts are sums over shards (one row each) plus places inside a shard: no task sees all documents.  Edge cases: null text
is empty and holds the end id only; repeated ids are repeated rows in the files, in the order of their texts; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, scan_partitions, shared_dir, written
from .wordhash import slices

END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Fixed values of Simple-8b: ids of a word and bits of an id, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Selector of a word that holds one escaped id, which is in the list of escapes.
ESCAPED = 14
#: Ids in a block, in a segment; parts in the memo; bytes of a file, bytes of text encoded at a time.
BLOCK, SEGMENT_IDS, MEMO, FILE_BYTES, TEXT_BYTES = 1024, 1 << 18, 1_000_000, 8 << 20, 8 << 20
MAGIC = int.from_bytes(b"S8B2\0\0\0\0", "little")
#: White space beside a space, or a space at an end: such a text is not cut into parts.
BESIDE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARK = "\0"
WHOLE = rf"\A | \z| {BESIDE}|{BESIDE} |{MARK}"
#: Further cuts, where the library's own pattern always ends a piece: behind a run of letters, behind a single line feed.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CUTS = ((rf"([{LETTER}])([.,;:!?\n])", rf"\1{MARK}\2"), (rf"([{LETTER}.,;:!?{MARK}]\n)([{LETTER}])", rf"\1{MARK}\2"))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned 64-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    escaped = np.flatnonzero(ids >= np.uint64(1) << np.uint64(60))
    escapes = np.stack([escaped.astype(np.uint64), ids[escaped]], 1)
    table = np.zeros(blocks * BLOCK + 64, np.uint64)
    table[:n] = ids
    table[escaped] = 0
    limit = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    width = np.zeros(len(table), np.uint8)  # least selector number of each id
    for s, bits in enumerate(BITS[:-1]):
        width[table >> np.uint64(bits) > 0] = s + 1
    width[escaped] = ESCAPED
    best = np.full(len(table), 13, np.uint8)  # selector of each place: the most ids that fit
    run, length = width.copy(), 1
    for s in range(12, -1, -1):
        while length < COUNTS[s]:  # run: least selector number for the next `length` ids
            step = min(length, COUNTS[s] - length)
            run[: len(run) - step] = np.maximum(run[: len(run) - step], run[step:])
            length += step
        best[run <= s] = s
    best[escaped] = ESCAPED
    at, rows, picks = np.arange(blocks) * BLOCK, [], []
    live = np.arange(blocks)
    while len(live):
        rows.append(np.stack([live, at[live]]))
        pick = best[at[live]]
        picks.append(pick)
        at[live] += np.where(pick == ESCAPED, 1, np.array([*COUNTS, 1])[np.minimum(pick, 14)])
        live = live[at[live] < limit[live]]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), escapes
    where = np.concatenate(rows, 1)
    order = np.lexsort((where[1], where[0]))
    block, start, pick = where[0][order], where[1][order], np.concatenate(picks)[order]
    words = pick.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS)):
        own = np.flatnonzero(pick == s)
        stop = limit[block[own]]
        for k in range(count):
            inside = own[start[own] + k < stop]
            if not len(inside):
                break
            words[inside] |= table[start[inside] + k] << np.uint64(k * bits)
    return words, np.searchsorted(block, np.arange(blocks)).astype(np.uint32), escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again, all words at a time."""
    pick = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 1, 1])[pick]
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.cumsum(counts) - counts
    start = block * BLOCK + before - before[offsets[block]]
    out = np.zeros(-(-n // BLOCK) * BLOCK + 64, np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS)):
        own = np.flatnonzero(pick == s)
        if len(own):
            mask = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            for k in reversed(range(count)):  # what a block's last word holds beyond its end is overwritten or cut off
                inside = own[start[own] + k < np.minimum((block[own] + 1) * BLOCK, n)]
                out[start[inside] + k] = (words[inside] >> np.uint64(k * bits)) & mask
    out = out[:n]
    out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def encode_segment(names: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids.astype(np.uint64))
    padded = np.zeros(len(offsets) + len(offsets) % 2, "<u4")
    padded[: len(offsets)] = offsets
    bits = np.packbits(valid)
    bits = np.pad(bits, (0, -len(bits) % 8))
    parts = (names.astype("<i8"), bits, counts.astype("<u8"), padded, escapes.astype("<u8"), words.astype("<u8"))
    length = 56 + sum(x.nbytes for x in parts)
    header = np.array([MAGIC, length, len(counts), len(ids), len(offsets), len(escapes), len(words)], "<u8")
    return b"".join(x.tobytes() for x in (header, *parts))


def decode_segment(data: bytes, at: int = 0) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end of the segment that begins at ``at``, doc_ids, whether there is one, ids of each document, all ids)."""
    magic, length, docs, n, blocks, escaped, count = np.frombuffer(data, "<u8", 7, at).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    stop = at + length
    at += 56
    names = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    valid = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
    at += 8 * -(-docs // 64)
    counts = np.frombuffer(data, "<u8", docs, at)
    at += 8 * docs
    offsets = np.frombuffer(data, "<u4", blocks, at)
    at += 4 * (blocks + blocks % 2)
    escapes = np.frombuffer(data, "<u8", 2 * escaped, at).reshape(-1, 2)
    words = np.frombuffer(data, "<u8", count, at + 16 * escaped)
    return stop, names, valid, counts.astype(np.int64), unpack(words, offsets, escapes, n)


class Encoder:
    """Ids of texts, with a bounded memo of parts between single spaces. Parts are numbered; number 0 is the end id."""

    def __init__(self, path: str, end: int, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True
        self.end = end
        self.reset()

    def reset(self) -> None:
        self.parts, self.part_number = pa.array([None], pa.large_string()), np.zeros(1, np.int64)
        self.heads: dict[str, int] = {}  # parts without a space before them
        self.count = self.used = 0
        self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.add(np.array([self.end], np.uint32), np.array([1]))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers new parts."""
        while self.count + len(sizes) > len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = range(self.count, self.count + len(sizes))
        self.size[self.count : new.stop], self.ids[self.used : self.used + len(ids)] = sizes, ids
        self.count, self.used = new.stop, self.used + len(ids)
        return new

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def one(self, text: str) -> int:
        ids = self.plain(text)
        return self.add(np.array(ids, np.uint32), np.array([len(ids)]))[0]

    def learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of new parts. Those that begin with a space, and their only one, are encoded many at a time: an id that
        begins with a space opens the next part."""
        numbers = np.zeros(len(parts), np.int64)
        spaced = [k for k, p in enumerate(parts) if p[:1] == " "]
        for at in range(0, len(spaced), 512):
            some = [parts[k] for k in spaced[at : at + 512]]
            ids = np.array(self.plain("".join(some)), np.uint32)
            opened = np.flatnonzero(self.opens[ids])
            if len(opened) == len(some):
                sizes = np.diff(np.append(opened, len(ids)))
            else:  # should a piece with a space open in the middle of a part: one by one
                each = [self.plain(p) for p in some]
                ids, sizes = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each])
            numbers[spaced[at : at + 512]] = self.add(ids, sizes)
        for k, p in enumerate(parts):
            if p[:1] != " ":
                numbers[k] = self.one(p)
        return numbers

    def numbered(self, parts: pa.Array) -> np.ndarray:
        """Numbers of parts, distinct ones looked up once."""
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.parts)
        fresh = pc.is_null(at)
        numbers = self.part_number[pc.fill_null(at, 0).to_numpy()]
        unseen = coded.dictionary.filter(fresh)
        if len(unseen):
            new = self.learn(unseen.to_pylist())
            numbers[fresh.to_numpy(zero_copy_only=False)] = new
            self.parts = pa.concat_arrays([self.parts, unseen])
            self.part_number = np.concatenate([self.part_number, new])
        return numbers[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; ids of each text)."""
        if self.count > MEMO:
            self.reset()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, WHOLE)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        begins = split.offsets.to_numpy().astype(np.int64)
        words, begins = split.values.slice(begins[0], begins[-1] - begins[0]), begins - begins[0]
        first = begins[:-1]
        # distinct words, the space before them included, are cut further, and the cuts' distinct parts looked up
        coded = words.dictionary_encode()
        empty = pa.scalar("", pa.large_string())
        spaced = pc.binary_join_element_wise(empty, coded.dictionary, pa.scalar(" ", pa.large_string()))
        for pattern, cut in CUTS:
            spaced = pc.replace_substring_regex(spaced, pattern, cut)
        cuts = pc.split_pattern(spaced, MARK)
        numbers, parts = self.numbered(cuts.values), cuts.offsets.to_numpy().astype(np.int64)
        place = coded.indices.to_numpy().astype(np.int64)
        begin, n = parts[place], np.diff(parts)[place]
        n[first] = 1  # a text's first word has no space before it
        counts = np.add.reduceat(n, first) if len(first) else n
        ends = np.cumsum(n)
        every = numbers[np.minimum(np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), len(numbers) - 1)]
        alone = whole.to_numpy(zero_copy_only=False)
        heads = words.take(pa.array(first)).to_pylist()
        kept = self.count, self.used
        for k, at in enumerate((ends - n)[first].tolist()):
            if not alone[k]:
                every[at] = self.head(heads[k])
                kept = self.count, self.used
        for k, at in zip(np.flatnonzero(alone).tolist(), (ends - n)[first[alone]].tolist()):
            every[at] = self.one(texts[k].as_py())
        every = np.insert(every, np.cumsum(counts), 0)  # the end id after each text
        size = self.size[: self.count]
        begin = np.cumsum(size) - size
        n = size[every]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(begin[every] - ends + n, n) + np.arange(int(n.sum()))]
        self.count, self.used = kept  # whole texts do not stay
        last = np.cumsum(counts + 1) - 1
        return ids, np.diff(np.concatenate([[0], ends[last]]))

    def head(self, word: str) -> int:
        if word not in self.heads:
            self.heads[word] = self.one(word)
        return self.heads[word]


def worker_encoder(path: str, end: int, special_as_text: bool) -> Encoder:
    """The worker's encoder: kept for its next tasks, so that common parts are encoded once a worker."""
    import sys

    kept = sys.__dict__.setdefault("_sylvan_encoders", {})
    key = (path, end, special_as_text)
    if key not in kept:
        kept[key] = Encoder(*key)
    return kept[key]


def put(folder: str, name: str, data: list[bytes]) -> None:
    """A whole file or none: written under a name of this attempt's own, then moved."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    part = f"{base}/{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        for piece in data:
            out.write(piece)
    store.move(part, f"{base}/{name}")


INDEX = "shard int, number int, docs long, ids long"
RESULT = "shard int, number int, place long, doc_id long, n_tokens long, ids_crc32 long"


def write_tokens(
    docs: DataFrame, path: str, end: int = END, shards: int | None = None, special_as_text: bool = False
) -> tuple[str, DataFrame]:
    """Encodes, packs and writes files in ascending doc_id order; returns their folder and the table of their sizes."""
    from pyarrow import fs

    shards = shards or scan_partitions(docs.sparkSession)
    folder = f"{shared_dir(docs.sparkSession)}/sylvan-token-files-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)

    def run(batches):
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        encoder, held, size, segments = None, [], 0, []
        docs_in = ids_in = 0

        def segment() -> None:
            nonlocal held, size, docs_in, ids_in
            names = pa.concat_arrays([n for n, _, _ in held])
            counts = np.concatenate([c for _, _, c in held])
            valid = pc.is_valid(names).to_numpy(zero_copy_only=False)
            ids = np.concatenate([x for _, x, _ in held])
            segments.append(encode_segment(pc.fill_null(names, 0).to_numpy(), valid, counts, ids))
            docs_in, ids_in, held, size = docs_in + len(counts), ids_in + len(ids), [], 0

        def file() -> pa.RecordBatch:
            nonlocal number, segments, docs_in, ids_in
            put(folder, f"{shard:06d}-{number:06d}.s8b", segments)
            row = {"shard": [shard], "number": [number], "docs": [docs_in], "ids": [ids_in]}
            number, segments, docs_in, ids_in = number + 1, [], 0, 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(row.items(), kinds)})

        for batch in batches:
            encoder = encoder or worker_encoder(path, end, special_as_text)
            for part in slices(batch, "text", TEXT_BYTES):
                found, counts = encoder.encode(part.column("text"))
                held.append((part.column("doc_id").cast(pa.int64()), found, counts))
                size += len(found)
                if size >= SEGMENT_IDS:
                    segment()
                    if sum(map(len, segments)) >= FILE_BYTES:
                        yield file()
        if held:
            segment()
        if segments:
            yield file()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.select("doc_id", "text").repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    return folder, written(ranged.mapInArrow(run, INDEX), "token-index")


def read_tokens(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = data.as_py()
                shard, number = map(int, name.rsplit("/", 1)[1].removesuffix(".s8b").split("-"))
                at = before = 0
                while at < len(data):
                    at, names, valid, counts, ids = decode_segment(data, at)
                    n, ends = len(counts), np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(n, shard, np.int32)), "number": pa.array(np.full(n, number, np.int32)),
                        "place": pa.array(before + ends - counts), "doc_id": pa.array(names, pa.int64(), mask=~valid),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                    })
                    before += len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    found = files.select("path", "content").mapInArrow(run, RESULT)
    shard = index.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shard = shard.select("shard", before.alias("base"))
    inside = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(shard, "shard")
    starts = written(starts.select("shard", "number", (F.col("base") + F.col("own")).alias("base")), "token-starts")
    return found.join(starts, ["shard", "number"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_token_files(spark, sf_dir):
    """The contract's columns, read back from the written files."""
    import public_tokenizers

    return read_tokens(spark, *write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
