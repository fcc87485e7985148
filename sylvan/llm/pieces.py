"""SentencePiece encoding and decoding by a relational lattice.

The text's normal form (spaces as U+2581, one put in front) is cut wherever no piece of the vocabulary has the two
characters next to each other, which no encoding can ever join; what is left are units, most of them shorter than a word.
Every distinct unit is encoded once for the whole corpus: its substrings up to the longest piece's length are exploded
and equi-joined to the piece table, the edges found are grouped by unit, and a fold with Spark's higher-order
``aggregate`` picks the path.  For a unigram model that fold is Viterbi.  For a byte-pair model, whose scores are merge
ranks and not log probabilities, the best path is not the model's encoding, so there the fold merges the best-scored
neighbours until none is left, which equals the sentencepiece library's result.  Cut points of a unit are bits of a long.

Scale: documents travel as compressed blobs of some megabytes of text, each a block.  A block asks for the units it
has, once each, so a word in a third of all documents costs one row a block.  Asked and encoded units meet in an equi-join
by unit, of which AQE splits hot keys; no row grows with the corpus.  Answers go back to the blocks, which look their
documents' units up by number.  One shuffle carries the blobs (both readers share it), one the asked units, one the
answers.  The piece table is broadcast; its bound is the vocabulary file.  Units of more than MOST characters (no cut
point for that long) are encoded in the block by the same merges, with a heap of neighbours.

Edge cases: null and empty texts have no pieces and decode to the empty text; characters outside the vocabulary become
byte pieces (the unknown piece, if the model has none); repeated rows each get their result; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, read, scan_partitions
from .wordhash import buffers, slices

MODEL = "piece_bpe_32k.model"
SPACE, MOST, BLOCK_BYTES = "▁", 60, 8 << 20


@dataclass
class Vocabulary:
    """What a model file says: pieces that may be matched, byte pieces, the kind of model."""

    score: dict[str, tuple[int, float]]
    pieces: list[bytes]
    first_byte: int | None
    unknown: int
    unigram: bool

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.score))

    @cached_property
    def pairs(self) -> set[str]:
        """Characters that some piece has next to each other."""
        return {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}


def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score, pieces, first_byte = {}, [], None
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        pieces.append(piece.replace(SPACE, " ").encode())
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            pieces[-1] = bytes([value])
            first_byte = i - value
        elif sp.is_control(i):
            pieces[-1] = b""
        elif sp.is_unknown(i):
            pieces[-1] = " ⁇ ".encode()
        elif not sp.is_unused(i):
            score[piece] = (i, sp.get_score(i))
    # a byte-pair model's scores are whole ranks, a unigram model's are log probabilities
    unigram = any(s != int(s) for _, s in score.values())
    return Vocabulary(score, pieces, first_byte, sp.unk_id(), unigram)


WORD = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def char_ids(char: str, v: Vocabulary) -> list[int]:
    if char in v.score:
        return [v.score[char][0]]
    return [v.unknown] if v.first_byte is None else [v.first_byte + b for b in char.encode()]


def encode_unit(unit: str, v: Vocabulary) -> list[int]:
    """One unit by the model's own rule: merges of the best-scored neighbours, leftmost first; or the best path."""
    n = len(unit)
    if v.unigram:
        best, back = [0.0], [0]
        lowest = min(s for _, s in v.score.values()) - 10.0
        for end in range(1, n + 1):
            paths = []
            for k in range(max(0, end - v.longest), end):
                found = v.score.get(unit[k:end])
                if found or k == end - 1:
                    paths.append((best[k] + (found[1] if found else lowest), -k))
            top = max(paths, key=lambda x: x[0])
            best.append(top[0])
            back.append(-top[1])
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts = cuts[::-1]
    else:
        # a heap of neighbours that make a piece; a part is known by its start, links go to the next and the last one
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(-v.score[unit[k : k + 2]][1], k, k + 1, k + 2) for k in range(n - 1) if unit[k : k + 2] in v.score]
        heapq.heapify(heap)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and after[a] == b and after[b] == end):
                continue
            alive[b] = False
            after[a] = end
            if end < n:
                before[end] = a
            for x, y in ((before[a], a), (a, end)):
                if x >= 0 and y < n and after[y] - x <= v.longest and unit[x : after[y]] in v.score:
                    heapq.heappush(heap, (-v.score[unit[x : after[y]]][1], x, y, after[y]))
        cuts = [k for k in range(n) if alive[k]] + [n]
    parts = [unit[a:b] for a, b in zip(cuts, cuts[1:])]
    return [i for p in parts for i in ([v.score[p][0]] if p in v.score else char_ids(p, v))]


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def edges(units: DataFrame, v: Vocabulary) -> DataFrame:
    """(unit, edges): substrings that are pieces, and single characters, cheapest first, ties from the left.

    Edges travel through the grouping as one long each: rank of the score, start, end, id (0: a character without piece).
    """
    spark = units.sparkSession
    costs = sorted({-s for _, s in v.score.values()})
    rank = {c: k for k, c in enumerate(costs)}
    table = [(p, rank[-s] << 36 | i + 1) for p, (i, s) in v.score.items()]
    table = spark.createDataFrame(table, "piece string, packed long")
    n = F.length("unit")
    # spans (start and length) of a unit of each length, as one literal: both explosions stay in generated code
    spans = [[s * 64 + k for s in range(m) for k in range(1, min(v.longest, m - s) + 1)] for m in range(MOST + 1)]
    spans = F.from_json(F.lit(json.dumps(spans)), "array<array<int>>")  # folded to a constant by the optimizer
    spread = units.select("unit", F.explode(F.get(spans, n)).alias("span"))
    s, k = F.shiftright("span", 6), F.col("span").bitwiseAND(F.lit(63))
    spread = spread.select("unit", ((s * 64 + s + k).cast("long") * (1 << 24)).alias("place"), F.substring("unit", s + 1, k).alias("piece"))
    found = spread.join(F.broadcast(table), "piece", "left").filter("packed is not null or length(piece) = 1")
    edge = (F.coalesce("packed", F.lit(len(costs) << 36)) + F.col("place")).alias("edge")
    packed = found.select("unit", edge).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    raw = lambda c: F.encode(c, "UTF-8")
    value = lambda c: F.transform(
        F.sequence(F.lit(1), F.length(raw(c))), lambda k: F.conv(F.hex(F.substring(raw(c), k, 1)), 16, 10).cast("int")
    )
    lowest = min(s for _, s in v.score.values()) - 10.0
    cost = F.array(*[F.lit(c) for c in [*costs, -lowest]]) if v.unigram else None
    field = lambda e, at, mask: F.shiftright(e, at).bitwiseAND(F.lit(mask)).cast("int")

    def unpacked(e: Column) -> Column:
        start, end, number = field(e, 30, 63), field(e, 24, 63), field(e, 0, (1 << 24) - 1)
        char = F.substring("unit", start + 1, F.lit(1))
        other = F.array(F.lit(v.unknown)) if v.first_byte is None else F.transform(value(char), lambda b: b + v.first_byte)
        return F.struct(
            *([F.get(cost, F.shiftright(e, 36).cast("int")).alias("cost")] if v.unigram else []),
            start.alias("start"), end.alias("end"), (bit(start) + bit(end)).alias("ends"), (bit(end) - bit(start + 1)).alias("inner"),
            F.when(number > 0, F.array(number - 1)).otherwise(other).alias("ids"),
        )

    return packed.select("unit", F.transform("edges", unpacked).alias("edges"))


def merged(n: Column, sorted_edges: Column) -> Column:
    """Cut points that are left when the best-scored neighbours, leftmost first, have been merged again and again.

    The state keeps the edges that can still become a merge: both ends are cut points, and one at least is between them.
    """
    start = F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1
    live = lambda cuts: lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (cuts.bitwiseAND(e["inner"]) != 0)

    def step(state: Column, _: Column) -> Column:
        best = F.get(F.filter(state["edges"], lambda e: F.bit_count(state["cuts"].bitwiseAND(e["inner"])) == 1), F.lit(0))

        def after(cuts: Column) -> Column:
            return F.struct(cuts.alias("cuts"), F.filter(state["edges"], live(cuts)).alias("edges"))

        return F.when(best.isNull(), state).otherwise(let(state["cuts"].bitwiseAND(F.bitwise_not(best["inner"])), after))

    edges = F.transform(F.filter(sorted_edges, live(start)), lambda e: F.struct(e["ends"].alias("ends"), e["inner"].alias("inner")))
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(start.alias("cuts"), edges.alias("edges")), step, lambda s: s["cuts"])


def viterbi(n: Column, sorted_edges: Column) -> Column:
    """Cut points of the cheapest path: a state for each end, the best of its edges, folded from left to right."""
    state = "struct<cost double, cuts bigint>"
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("cuts")).cast(state))

    def step(best: Column, end: Column) -> Column:
        into = F.filter(sorted_edges, lambda e: e["end"] == end)
        paths = F.transform(
            into,
            lambda e: F.struct(
                (F.get(best, e["start"])["cost"] + e["cost"]).alias("cost"),
                F.get(best, e["start"])["cuts"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), end)).alias("cuts"),
            ),
        )
        return F.concat(best, F.array(F.array_min(paths).cast(state)))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.get(best, n)["cuts"])


def encode_units(units: DataFrame, v: Vocabulary) -> DataFrame:
    """(unit, ids) of distinct units of at most MOST characters."""
    n, fold = F.length("unit"), viterbi if v.unigram else merged

    def path(found: Column) -> Column:
        def ids(cuts: Column) -> Column:
            used = F.filter(
                found, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (cuts.bitwiseAND(e["inner"]) == 0)
            )
            return F.flatten(F.transform(F.array_sort(F.transform(used, lambda e: F.struct(e["start"], e["ids"]))), lambda e: e["ids"]))

        return let(fold(n, found), ids)

    return edges(units, v).select("unit", let(F.col("edges"), path).alias("ids"))


BLOB = "block long, blob binary"
#: Units of a block are numbered; block and number make one long.
SLOT = 22


def blobs(docs: DataFrame, block_bytes: int, parts: int) -> DataFrame:
    """Blocks of documents, compressed, dealt for the two passes over them."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 16
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))
        for part in (p for whole in batches for p in slices(whole, "text", block_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()])})
            block += 1

    return docs.select("doc_id", "text").mapInArrow(run, BLOB).repartition(parts, "block")


def opened(blob: bytes) -> pa.Table:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    text = pc.fill_null(table["text"].cast(pa.large_string()), "")
    return table.set_column(table.schema.get_field_index("text"), "text", text)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each text's words, the words' numbers text by text).

    A word is a run of spaces and what follows up to the next space. Where no space touches another, words are the parts
    between spaces, which Arrow finds; other texts go through the pattern.
    """
    odd = pc.match_substring_regex(texts, rf"\A | \z|  |{SPACE}")
    split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = split.offsets.to_numpy()
    parts = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.not_equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    odd = odd.to_numpy(zero_copy_only=False)
    counts = np.where(filled & ~odd, np.diff(offsets), 0).astype(np.int64)
    parts = parts.filter(pc.not_equal(parts, ""))
    begin = np.cumsum(counts) - counts
    more, at = [], len(parts)
    for k in np.flatnonzero(odd).tolist():
        found = WORD.findall(normal(texts[k].as_py()))
        more += [w[1:] for w in found]  # every word begins with a space
        begin[k], counts[k], at = at, len(found), at + len(found)
    coded = pa.concat_arrays([parts, pa.array(more, pa.large_string())]).dictionary_encode()
    ends = np.cumsum(counts)
    numbers = coded.indices.to_numpy()[np.repeat(begin - ends + counts, counts) + np.arange(int(counts.sum()))]
    space, nothing = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(space, coded.dictionary, nothing), counts, numbers


class Cutter:
    """Cuts words into units where no piece has the two characters next to each other."""

    def __init__(self, pairs: set[str]) -> None:
        chars = sorted({c for p in pairs for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.number = np.zeros(0x110000, np.uint16 if len(chars) < 65535 else np.uint32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pair = np.unique(np.array([number[a] * (len(chars) + 1) + number[b] for a, b in pairs], np.int64))
        self.base = len(chars) + 1
        # as a table where that is small
        self.table = None
        if self.base <= 8192:
            self.table = np.zeros(self.base * self.base, bool)
            self.table[self.pair] = True

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(units of all words, one after the other; first unit of each word, one more at the end; characters of each unit)."""
        raw, _ = buffers(words)
        text = raw.tobytes()
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        begin = np.ones(len(points), bool)
        if len(points) > 1:
            number = self.number[points].astype(np.int64)
            both = number[:-1] * self.base + number[1:]
            near = self.table[both] if self.table is not None else np.isin(both, self.pair)
            begin[1:] = ~near
            begin[first] = True
        starts = np.flatnonzero(begin)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        offsets = np.append(at[starts], len(raw)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text))
        return units, np.append(np.searchsorted(starts, first), len(starts)), np.diff(np.append(starts, len(points)))


def units_of(texts: pa.Array, cutter: Cutter):
    """(distinct units, their characters; numbers of all words' units, first of each word; as ``words_of`` the rest)."""
    words, counts, numbers = words_of(texts)
    units, first, sizes = cutter.cut(words)
    coded = units.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # in order, so that shuffled rows compress well
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()]
    size = np.zeros(len(order), np.int64)
    size[place] = sizes
    return coded.dictionary.take(pa.array(order)), size, place, first, counts, numbers


RESULT = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, text_back boolean"


def decode(ids: list[int], pieces: list[bytes]) -> str:
    """The text of ids: pieces and bytes joined, without the space that was put in front."""
    text = b"".join([pieces[i] for i in ids]).decode(errors="replace")
    return text.removeprefix(" ")


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, .. of each span, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode(docs: DataFrame, v: Vocabulary, block_bytes: int = BLOCK_BYTES, with_ids: bool = True) -> DataFrame:
    """Per document: ids, their number, their checksum (little-endian 32-bit), whether they decode to the text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((v, v.pairs))
    parts = scan_partitions(docs.sparkSession, docs)
    dealt = blobs(docs, block_bytes, parts)

    def ask(batches):
        cutter = Cutter(shared.value[1])
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
                units, size, *_ = units_of(opened(blob)["text"].combine_chunks(), cutter)
                short = np.flatnonzero(size <= MOST)
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(short + (block << SLOT)), "unit": units.take(pa.array(short)).cast(pa.string())
                })

    asked = dealt.mapInArrow(ask, "slot long, unit string").repartition(parts, "unit")
    # the maximum keeps the slots' column in this branch too, so that both branches read one exchange
    distinct = asked.groupBy("unit").agg(F.max("slot").alias("m")).filter("m >= 0").select("unit")
    three = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 6, "0")), ""))
    found = encode_units(distinct, v).select("unit", three.alias("ids"))
    rows = asked.join(found, "unit").select("slot", "ids")
    answers = rows.mapInArrow(pack_answers, "block long, answers binary").repartition(parts, "block")

    def answer(blocks: pa.Table, packed: pa.Table) -> pa.Table:
        own, pairs = shared.value
        table = opened(blocks["blob"][0].as_py())
        texts = table["text"].combine_chunks()
        units, chars, place, first, counts, numbers = units_of(texts, Cutter(pairs))
        got = [unpack_answers(data) for data in packed["answers"].to_pylist()]
        long = np.flatnonzero(chars > MOST)
        late = [encode_unit(units[k].as_py(), own) for k in long.tolist()]
        order = np.concatenate([*(g[0] for g in got), long]).astype(np.int64)
        sizes = np.concatenate([*(g[1] for g in got), np.array([len(x) for x in late], np.int64)]).astype(np.int64)
        ids = np.concatenate([*(g[2] for g in got), np.array([i for x in late for i in x], np.int32)]).astype(np.int32)
        if len(order) != len(units):
            raise ValueError("a unit of a block was not answered once")
        size, begin = np.zeros((2, len(units)), np.int64)
        size[order], begin[order] = sizes, np.cumsum(sizes) - sizes
        # ids of each distinct word, then of the texts, some at a time
        ids = ids[spans(begin[place], size[place])]
        ends = np.concatenate([[0], np.cumsum(size[place])])[first]
        word_begin, word_size = ends[:-1], np.diff(ends)
        edge = np.concatenate([[0], np.cumsum(counts)])
        pieces = pa.array(own.pieces, pa.large_binary())
        lists, n_pieces, crcs, back = [], [], [], []
        raw, offsets = buffers(texts)
        raw, at = raw.tobytes(), 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), "right")) - 1)
            some = numbers[edge[at] : edge[stop]]
            own_size = word_size[some]
            found = ids[spans(word_begin[some], own_size)]
            cuts = np.concatenate([[0], np.cumsum(own_size)])[edge[at : stop + 1] - edge[at]].tolist()
            text_bytes, text_ends = decoded(pieces, found)
            data = found.astype("<i4").tobytes()
            for k, (a, b) in enumerate(pairwise(cuts), at):
                crcs.append(zlib.crc32(data[4 * a : 4 * b]))
                n_pieces.append(b - a)
                text = text_bytes[text_ends[a] : text_ends[b]]
                back.append(text.removeprefix(b" ") == raw[offsets[k] : offsets[k + 1]])
            if with_ids:
                lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found)))
            at = stop
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()),
            "ids": pa.chunked_array(lists, pa.list_(pa.int32())) if with_ids else pa.nulls(len(texts), pa.list_(pa.int32())),
            "n_pieces": pa.array(n_pieces, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "text_back": pa.array(back, pa.bool_()),
        })

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, RESULT)


def decoded(pieces: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of all ids' pieces, joined; where each id's bytes begin, and the end)."""
    found = pieces.take(pa.array(ids))
    if not len(found):
        return b"", np.zeros(1, np.int64)
    return found.buffers()[2].to_pybytes(), np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)


def pack_answers(batches):
    """Answers (slot, ids of three bytes each) as one compressed row for each block, of some batches at a time."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        slots = table["slot"].to_numpy()
        order = np.argsort(slots, kind="stable")
        slots, column = slots[order], table["ids"].take(pa.array(order))
        column = pa.concat_arrays(column.chunks).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        blocks, first = np.unique(slots >> SLOT, return_index=True)
        packed = []
        for a, b in zip(first, [*first[1:], len(slots)]):
            numbers, sizes = slots[a:b] & ((1 << SLOT) - 1), np.diff(offsets[a : b + 1]) // 3
            body = raw[offsets[a] : offsets[b]].reshape(-1, 3).T  # bytes of equal weight together
            head = np.array([b - a, sizes.sum()], "<i8")
            steps = np.diff(numbers, prepend=0).astype("<i4")
            data = b"".join(x.tobytes() for x in (head, steps, sizes.astype("<u2"), body))
            packed.append(len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True))
        held.clear()
        return pa.RecordBatch.from_pydict({"block": pa.array(blocks), "answers": pa.array(packed, pa.binary())})

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 500_000:
            yield flush()
            rows = 0
    if rows:
        yield flush()


def unpack_answers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of units, ids of each, all ids)."""
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, total = np.frombuffer(data, "<i8", 2).tolist()
    numbers = np.cumsum(np.frombuffer(data, "<i4", n, 16), dtype=np.int64)
    sizes = np.frombuffer(data, "<u2", n, 16 + 4 * n).astype(np.int64)
    wide = np.zeros((total, 4), np.uint8)
    wide[:, 2::-1] = np.frombuffer(data, np.uint8, 3 * total, 16 + 6 * n).reshape(3, -1).T
    return numbers, sizes, wide.view("<i4").ravel()


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return load(public_tokenizers.path(MODEL))


def op5_sentencepiece(spark, sf_dir):
    """Number of pieces, checksum of the ids, and whether decoding gives the text back, for every document."""
    found = encode(read(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
    return found.select("doc_id", "n_pieces", "ids_crc32", "text_back")
