"""SentencePiece encoding and decoding over a relational lattice.

Only distinct chunks of text are segmented: their substrings of bounded
length are joined to the piece table, matches are grouped by chunk as the
edges of a lattice, and a higher-order aggregate folds the edges into the best
path. Documents then take their chunks' ids, block by block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, block_of_row, frugal, text_slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
MARK = SPACE_MARK.encode()
UNITS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
#: Stands for a space mark that the text itself holds. It is a chunk of its own, has the ids of the mark's bytes and is no character of any text.
OWN_MARK = "\ud800"
OWN = OWN_MARK.encode("utf-8", "surrogatepass")
SPAN = 256  # characters whose substrings are taken from one piece of a chunk, and positions that the fold holds before it puts them away


@dataclass(frozen=True)
class Pieces:
    """A piece table: pieces that may match text, with ids and scores, and the ids of the 256 byte pieces."""

    names: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    unknown_score: float

    def pairs(self) -> frozenset[str]:
        """Neighbouring characters inside any piece: text may be cut exactly between any other two."""
        return frozenset(n[i : i + 2] for n in self.names for i in range(len(n) - 1))


def load_pieces(path: str = MODEL_FILE) -> Pieces:
    """The table of a model file. Text is taken as it is, after one leading space, as that model's own rule says."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size = p.get_piece_size()
    normal = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in range(size) if p.is_byte(i)}
    scores = [p.get_score(i) for i in normal]
    return Pieces(tuple(map(p.id_to_piece, normal)), tuple(normal), tuple(scores), tuple(byte_ids[b] for b in range(256)), min(scores) - 10)


def in_units(data: bytes) -> bytes | None:
    """A text as units between single spaces: behind a leading space, spaces as marks, cut before each run of marks; each unit without its first mark."""
    if not data:
        return None
    if b"  " in data or data[:1] == b" " or data[-1:] == b" " or MARK in data:
        text = SPACE_MARK + data.decode("utf-8", "surrogatepass").replace(SPACE_MARK, OWN_MARK).replace(" ", SPACE_MARK)
        return " ".join(u[1:] for u in UNITS.findall(text)).encode("utf-8", "surrogatepass")
    return data


class Cuts:
    """Cuts units into chunks that no piece crosses, so that segmenting them apart changes nothing.

    Whether a piece holds two characters side by side is looked up in a table
    of hashed pairs. A false hit leaves a cut out, which does no harm.
    """

    def __init__(self, pairs: frozenset[str], bits: int = 22) -> None:
        self.bits = np.uint64(64 - bits)
        self.joined = np.zeros(1 << bits, bool)
        code = np.frombuffer("".join(sorted(pairs)).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.joined[self.slot(code[::2], code[1::2])] = True

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x110000) + b) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def __call__(self, units: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """(chunks of all units in order, number of chunks of each unit)."""
        if not len(units):
            return units, np.zeros(0, np.int64)
        ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        data = units.buffers()[2].to_pybytes()[ends[0] : ends[-1]]
        ends -= ends[0]
        first = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # byte of each character
        code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        own = code == ord(OWN_MARK)
        at = np.ones(len(code) + 1, bool)
        at[1:-1] = ~self.joined[self.slot(code[:-1], code[1:])] | own[1:] | own[:-1]
        at[np.searchsorted(first, ends)] = True
        place = np.append(first, len(data))[np.flatnonzero(at)]
        chunks = pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data)])
        return chunks, np.diff(np.searchsorted(place, ends))


@dataclass
class Block:
    """What a block's texts consist of: occurrences of distinct units, and these of distinct chunks."""

    ends: np.ndarray  # where each text's occurrences end, from 0
    unit: np.ndarray  # unit of each occurrence
    units: pa.BinaryArray  # distinct, with their marks
    counts: np.ndarray  # chunks of each distinct unit
    number: np.ndarray  # of each such chunk, among the distinct ones in order; -1: OWN_MARK
    chunks: pa.BinaryArray  # distinct, in order of their bytes


def block_of(texts: list[bytes | None], cuts: Cuts) -> Block:
    """The order of the chunks depends on the texts alone, not on their order, so a block has the same numbers wherever it is made."""
    split = pc.split_pattern(pa.array([in_units(t or b"") for t in texts], pa.binary()), b" ")
    many = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    units = pc.binary_join_element_wise(pa.scalar(MARK), coded.dictionary, pa.scalar(b""))
    parts = [cuts(units[i : i + 50_000]) for i in range(0, len(units), 50_000)]
    named = pa.chunked_array([p[0] for p in parts], pa.binary()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(named.dictionary).to_numpy()
    chunks = named.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    mark = pc.index(chunks, pa.scalar(OWN, pa.binary())).as_py()
    if mark >= 0:  # out of the order
        rank = np.where(rank == mark, -1, rank - (rank > mark))
        chunks = pc.filter(chunks, pc.not_equal(chunks, pa.scalar(OWN, pa.binary())))
    counts = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
    return Block(np.append(0, np.cumsum(many)), coded.indices.to_numpy(), units, counts, rank[named.indices.to_numpy()], chunks)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] numbers, then those from start[1], and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def spelled(ids: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes with unknown characters, which are -1 - code point, as the ids of their bytes."""
    unknown = np.flatnonzero(ids < 0)
    if not len(unknown):
        return ids, size
    owner = np.repeat(np.arange(len(size)), size)
    parts, at, size = [], 0, size.copy()
    for i in unknown.tolist():
        own = [pieces.byte_ids[b] for b in chr(-1 - int(ids[i])).encode()]
        parts += [ids[at:i], np.array(own, ids.dtype)]
        at = i + 1
        size[owner[i]] += len(own) - 1
    return np.concatenate([*parts, ids[at:]]), size


def lattice(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, least, path): the ids of the best path of each distinct chunk (key, long, least); the rest is as given.

    `key` is the chunk, or of a chunk of more than SPAN characters its digest
    (see keys_of), so that edges are light; the chunk is then in `long`. The path has the highest sum of piece scores;
    ties go to the longer last piece. A character without a piece counts as
    unknown and is -1 - its code point in `path`. The piece table is
    broadcast, as its size is the vocabulary's. If `chunks` is partitioned by
    key, nothing here shuffles it again.
    """
    spark = chunks.sparkSession
    table = spark.createDataFrame(list(zip(pieces.names, pieces.ids, pieces.scores, strict=True)), "piece string, id int, score double")
    longest = max(map(len, pieces.names))
    # edges are told apart by a hash first, as most chunks begin alike
    subs = chunks.select(F.xxhash64("key").alias("h"), "key", "least", "long", F.length(F.coalesce("long", "key")).alias("n"))
    subs = subs.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SPAN))).alias("base"))
    # overlapping parts of a chunk; of most chunks there is one
    part = F.when(F.col("long").isNull(), F.col("key")).otherwise(F.substring("long", F.col("base") + 1, F.lit(SPAN + longest)))
    subs = subs.select("h", "key", "least", "base", F.least(F.lit(SPAN), F.col("n") - F.col("base")).alias("starts"), (F.col("n") - F.col("base")).alias("rest"), part.alias("part"))
    subs = subs.select("*", F.explode(F.sequence(F.lit(1), F.col("starts"))).alias("at"))
    subs = subs.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("rest") - F.col("at") + 1))).alias("len"))
    subs = subs.select("h", "key", "least", (F.col("base") + F.col("at")).alias("at"), "len", F.substring("part", F.col("at"), F.col("len")).alias("piece"))
    edges = subs.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    edge = F.struct(
        (F.col("at") + F.col("len") - 1).alias("end"),
        (F.col("at") - 1).alias("start"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
        F.coalesce("id", -1 - F.ascii("piece")).alias("id"),
    )
    grouped = edges.groupBy("h", "key").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.min("least").alias("least"))
    return grouped.select("key", viterbi(F.col("edges"), longest).alias("path"), "least")


def keys_of(chunks: pa.BinaryArray) -> tuple[pa.StringArray, pa.StringArray]:
    """(key, long) of chunks: a chunk of more than SPAN characters has its digest, longer than any shorter chunk, as its key."""
    text = chunks.cast(pa.string())
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    if not len(size) or size.max() <= SPAN:
        return text, pa.nulls(len(text), pa.string())
    rows = [(t if n <= SPAN else hashlib.sha256(t.encode()).hexdigest() * (1 + SPAN // 64), None if n <= SPAN else t) for t, n in zip(text.to_pylist(), size.tolist(), strict=True)]
    return pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())


NODE = "struct<score:double,start:int,id:int>"


def named(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def viterbi(edges: Column, longest: int) -> Column:
    """Fold edges (end, start, score, id) in order of their ends into the ids of the best path.

    The state is copied at every step, so it holds no paths, only the best
    score, start and id of an edge at each position, and of a long chunk only
    those of one span: a fold over spans puts away all but the last `longest`
    positions. A second fold walks back from the end along the starts.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(0).alias("id"))).cast(f"array<{NODE}>")
    short = named(F.aggregate(edges, first, lambda near, x: opened(near, x, F.lit(0))), lambda nodes: walked(nodes, F.size(nodes) - 1, F.size(nodes) - 1)["few"])
    return F.when(F.element_at(edges, -1)["end"] <= SPAN, short).otherwise(named(spans_of(edges), lambda spans: long_path(spans, first, longest)))


def opened(near: Column, x: Column, base: Column) -> Column:
    """The nodes from position `base` on, with one more edge. Edges of one end follow each other, so it opens the next position or competes for the last."""
    end = x["end"] - base
    score = F.get(near, x["start"] - base)["score"] + x["score"]
    new = F.array(F.struct(score.alias("score"), x["start"].alias("start"), x["id"].alias("id"))).cast(f"array<{NODE}>")
    return F.when(F.size(near) <= end, F.concat(near, new)).when(score > F.get(near, end)["score"], F.concat(F.slice(near, F.lit(1), end), new)).otherwise(near)


def walked(nodes: Column, left: Column, at: Column) -> Column:
    """(left, at, few): a walk back over nodes, the last of which is at position `left`; `at` is the next position on the path, few the ids so far."""
    zero = F.struct(left.alias("left"), at.alias("at"), F.array().cast("array<int>").alias("few"))

    def step(acc: Column, x: Column) -> Column:
        here = (acc["at"] == acc["left"]) & (x["start"] >= 0)
        return F.struct((acc["left"] - 1).alias("left"), F.when(here, x["start"]).otherwise(acc["at"]).alias("at"), F.when(here, F.concat(F.array(x["id"]), acc["few"])).otherwise(acc["few"]).alias("few"))

    return F.aggregate(F.reverse(nodes), zero, step)


def spans_of(edges: Column) -> Column:
    """Edges in arrays by the span of their end."""
    span = lambda i: F.floor((F.get(edges, i)["end"] - 1) / SPAN)
    starts = F.filter(F.sequence(F.lit(0), F.size(edges) - 1), lambda i: (i == 0) | (span(i) != span(i - 1)))
    return named(starts, lambda at: F.transform(at, lambda i, k: F.slice(edges, i + 1, F.coalesce(F.get(at, k + 1), F.size(edges)) - i)))


def long_path(spans: Column, first: Column, longest: int) -> Column:
    far = f"array<array<{NODE}>>"
    zero = F.struct(F.lit(0).alias("base"), first.alias("near"), F.array().cast(far).alias("far"))

    def forward(acc: Column, edges: Column) -> Column:
        grown = F.aggregate(edges, acc["near"], lambda near, x: opened(near, x, acc["base"]))
        done = lambda g: F.greatest(F.size(g) - longest, F.lit(0))
        return named(grown, lambda g: F.struct((acc["base"] + done(g)).alias("base"), F.slice(g, done(g) + 1, F.lit(longest)).alias("near"), F.concat(acc["far"], F.array(F.slice(g, F.lit(1), done(g)))).alias("far")))

    def back(acc: Column, nodes: Column) -> Column:
        return named(walked(nodes, acc["left"], acc["at"]), lambda w: F.struct(w["left"].alias("left"), w["at"].alias("at"), F.concat(w["few"], acc["path"]).alias("path")))

    def path(state: Column) -> Column:
        last = state["base"] + F.size(state["near"]) - 1
        none = F.array().cast("array<int>")
        return F.aggregate(F.reverse(F.concat(state["far"], F.array(state["near"]))), F.struct(last.alias("left"), last.alias("at"), none.alias("path")), back, lambda acc: acc["path"])

    return named(F.aggregate(spans, zero, forward), path)


class Decoder:
    """Ids back to text; the counterpart of encoding, exact for every text."""

    def __init__(self, pieces: Pieces) -> None:
        size = max(*pieces.ids, *pieces.byte_ids) + 1
        self.parts = [b""] * size
        for n, i in zip(pieces.names, pieces.ids, strict=True):
            self.parts[i] = n.replace(SPACE_MARK, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            self.parts[i] = bytes([b])

    def __call__(self, ids: Iterable[int]) -> str:
        return b"".join([self.parts[i] for i in ids])[1:].decode("utf-8", "replace")


def decoded(df: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """df with a column `decoded`: the text of each row's ids; null ids give null. Bytes that form no text become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(pieces)
        for b in batches:
            texts = pa.array([None if x is None else decode(x) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


@dataclass(frozen=True)
class Frequent:
    """Paths of frequent chunks, in order of their bytes."""

    chunks: pa.BinaryArray
    ends: np.ndarray  # of each chunk's ids, from 0
    ids: np.ndarray

    def places(self, chunks: pa.BinaryArray) -> np.ndarray:
        """Where each chunk is, -1 for one that is not here."""
        return pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy()


def frequent_chunks(docs: DataFrame, pieces: Pieces, portion: float, most: int) -> Frequent:
    """The chunks that occur most often in a hashed portion of the rows, twice there at least, segmented by the lattice.

    They are only asked for less often than others; every chunk has the same
    path whether it is among them or not.
    """
    cuts = Cuts(pieces.pairs())
    hashed = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30))
    sample = docs.where(hashed < F.lit(int(portion * (1 << 30)))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for b in batches:
            for texts in text_slices(b.column("text").cast(pa.binary())):
                block = block_of(texts, cuts)
                times = np.bincount(block.unit, minlength=len(block.units)).repeat(block.counts)
                n = np.bincount(block.number[block.number >= 0], weights=times[block.number >= 0], minlength=len(block.chunks))
                key, long = keys_of(block.chunks)
                yield pa.RecordBatch.from_arrays([key, long, pa.array(n.astype(np.int64))], ["key", "long", "n"])

    counted = sample.mapInArrow(count, "key string, long string, n long").where(F.col("long").isNull()).groupBy("key", "long").agg(F.sum("n").alias("n"))
    some = counted.where(F.col("n") > 1).orderBy(F.desc("n"), "key").limit(most).select("key", "long", F.lit(0).cast("long").alias("least"))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    found = lattice(some.repartition(parts, "key"), pieces).select(F.col("key").cast("binary").alias("key"), "path").toArrow().sort_by("key")
    path = found.column("path").combine_chunks()
    size = pc.list_value_length(path).to_numpy(zero_copy_only=False)
    return Frequent(found.column("key").combine_chunks(), np.append(0, np.cumsum(size)), path.flatten().to_numpy().astype(np.int32))


def encoded(docs: DataFrame, keep: list[str], pieces: Pieces, block_bytes: int = 4_000_000, sample_bytes: int = 32_000_000, most_frequent: int = 200_000) -> DataFrame:
    """The columns `keep` and ids (array<int>), exact (boolean): every row's whole text as piece ids.

    Segmentation maximises the sum of the model's piece scores over each
    chunk; characters without a piece become the ids of their UTF-8 bytes, and
    so does U+2581 where the text itself holds it. `exact` says that decoding
    the ids gives the text again. Null and empty texts have no ids, equal rows
    equal ids, an empty table no rows. Bytes that are no UTF-8 count as U+FFFD
    (a text that is passed on is passed on so). Columns of `keep` named like a result
    give way to it.

    The `most_frequent` chunks of a sample of about `sample_bytes` are
    segmented first and broadcast (some 8 MB). Rows are dealt into blocks of
    about `block_bytes` by hash of doc_id, text and input partition. Each block numbers its
    distinct chunks and asks once for each other one; all blocks' questions
    are joined to the segmented chunks, and the answers, bundled by block,
    meet its texts in one task. No dictionary of the whole corpus is in one
    place.
    """
    docs = docs.withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, pieces, min(1.0, sample_bytes / max(1, int(total))), most_frequent))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, -(-int(total) // block_bytes))
    # what the tasks of the lattice hold and sort at a time; no more than usual, as each of them answers each block in a row
    parts = max(cores, min(blocks // 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = Cuts(pieces.pairs())
    kept = Kept(keep, "ids", "exact")
    # a text that is to be passed on is unpacked at the end instead of travelling twice
    at_text = kept.names.index("text") if "text" in kept.names else -1
    columns = [c for i, c in enumerate(kept.columns()) if i != at_text]
    others = [c for i, c in enumerate(kept.inner) if i != at_text]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        frugal()
        for b in batches:
            texts = []
            for i in range(0, b.num_rows, 256):
                texts += [None if t is None else packer.compress(t) for t in b.column("_text").slice(i, 256).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], [*b.schema.names[:-1], "_packed"])

    head = [block_of_row(blocks).alias("_block"), *columns]
    source = docs.select(*head, F.col("text").alias("_text"))
    packed = source.mapInArrow(pack, docs.select(*head).schema.add("_packed", "binary")).repartition(blocks, "_block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block and number, key, long) of the distinct chunks of each block that are not known, in order."""
        frugal()
        unpack = zstandard.ZstdDecompressor().decompress

        def questions(k: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            chunks = block_of(texts, cuts).chunks
            number = np.flatnonzero(known.value.places(chunks) < 0)
            for i in range(0, len(number), 20_000):
                part = number[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + (k << 32)), *keys_of(chunks.take(pa.array(part)))], ["at", "key", "long"])

        now, held = None, []
        for b in batches:
            for k, data in zip(b.column("_block").to_pylist(), b.column("_packed").to_pylist(), strict=True):
                if k != now:
                    yield from questions(now, held) if held else ()
                    now, held = k, []
                if data:
                    held.append(unpack(data))
        yield from questions(now, held) if held else ()

    # all columns of packed, so that one exchange serves both uses; likewise `least` is carried along
    asked = packed.sortWithinPartitions("_block").mapInArrow(ask, "at long, key string, long string").repartition(parts, "key")
    distinct = asked.groupBy("key", "long").agg(F.min("at").alias("least"))
    answers = asked.hint("merge").join(lattice(distinct, pieces), "key").where(F.col("least") >= 0).select("at", "path", "long")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task has for each block, packed in one row: numbers of chunks, numbers of ids, ids."""
        frugal()
        held: dict[int, list] = {}
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            at, path = b.column("at").to_numpy(), b.column("path")
            flat, ends = path.values.to_numpy(), path.offsets.to_numpy().astype(np.int64)
            order = np.argsort(at)
            block = at[order] >> 32
            for part in np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(order) else []:
                size = ends[part + 1] - ends[part]
                held.setdefault(int(at[part[0]] >> 32), []).append((at[part] & 0xFFFFFFFF, size, flat[ranges(ends[part], size)]))
        for k in sorted(held):
            number, size, ids = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            kind = "<u2" if ids.min() >= 0 and ids.max() < 1 << 16 else "<i4"
            row = (k, *[pack(x.astype("<u4").tobytes()) for x in (number, size)], kind, pack(ids.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True)], ["_block", "numbers", "sizes", "kind", "ids"])

    bundles = answers.mapInArrow(bundle, "_block int, numbers binary, sizes binary, kind string, ids binary")

    def assemble(table: pa.Table, found: pa.Table) -> pa.Table:
        out = assembled(table, found)
        frugal()  # what the block took goes back while the worker waits for the next one
        return out

    def assembled(table: pa.Table, found: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [None if x is None else unpack(x) for x in table.column("_packed").to_pylist()]
        block = block_of(texts, cuts)
        number, size, flat = [], [], []
        for r in found.to_pylist():
            number.append(np.frombuffer(unpack(r["numbers"]), "<u4"))
            size.append(np.frombuffer(unpack(r["sizes"]), "<u4"))
            flat.append(np.frombuffer(unpack(r["ids"]), r["kind"]).astype(np.int32))
        common, place = known.value, known.value.places(block.chunks)
        number.append(np.flatnonzero(place >= 0))
        place = place[number[-1]]
        size.append(common.ends[place + 1] - common.ends[place])
        flat.append(common.ids[ranges(common.ends[place], size[-1])])
        mark = np.array([pieces.byte_ids[b] for b in MARK], np.int32)
        number, size, flat = np.concatenate([*number, [len(block.chunks)]]).astype(np.int64), np.concatenate([*size, [3]]).astype(np.int64), np.concatenate([*flat, mark])
        if len(number) != len(block.chunks) + 1:
            raise RuntimeError(f"of {len(block.chunks)} chunks, {len(number) - 1} were answered")
        flat, size = spelled(flat, size, pieces)
        row = np.empty(len(number), np.int64)
        row[number] = np.arange(len(number))
        of_chunk = row[block.number]  # -1, the mark, is the last
        ids = flat[ranges((np.cumsum(size) - size)[of_chunk], size[of_chunk])]
        chunk_ends = np.append(0, np.cumsum(size[of_chunk]))
        ends = chunk_ends[np.append(0, np.cumsum(block.counts))]  # of each distinct unit's ids
        wrong = inexact(ids, ends, block.units, Decoder(pieces).parts)
        own, exact, out = np.diff(ends), np.ones(len(texts), bool), []
        for i in range(0, len(block.unit), 200_000):
            unit = block.unit[i : i + 200_000]
            out.append(ids[ranges(ends[unit], own[unit])])
        total = np.append(0, np.cumsum(own[block.unit]))[block.ends]
        if wrong.any():
            bad = np.append(0, np.cumsum(wrong[block.unit]))[block.ends]
            exact = np.diff(bad) == 0
        lists = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
        passed = {c: table.column(c) for c in others}
        if at_text >= 0:
            passed[kept.inner[at_text]] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table({**{c: passed[c] for c in kept.inner}, "ids": lists, "exact": pa.array(exact)})

    schema = docs.select(*kept.columns()).schema.add("ids", T.ArrayType(T.IntegerType())).add("exact", "boolean")
    return kept.restored(packed.groupBy("_block").cogroup(bundles.groupBy("_block")).applyInArrow(assemble, schema), "ids", "exact")


def inexact(ids: np.ndarray, ends: np.ndarray, units: pa.BinaryArray, parts: list[bytes]) -> np.ndarray:
    """Of each unit, whether its ids do not give it back."""
    letters, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size) - size
    wrong = np.zeros(len(units), bool)
    for i in range(0, len(units), 50_000):
        plain = pc.replace_substring(pc.replace_substring(units[i : i + 50_000], MARK, b" "), OWN, MARK)
        want = np.append(0, np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64)))
        own = ids[ends[i] : ends[i + len(plain)]]
        have = np.append(0, np.cumsum(size[own]))[ends[i : i + len(plain) + 1] - ends[i]]
        text = letters[ranges(start[own], size[own])]
        given = np.frombuffer(b"".join(plain.to_pylist()), np.uint8)
        same = np.flatnonzero(np.diff(have) == np.diff(want))  # of the same length
        wrong[i : i + len(plain)] = True
        wrong[i + same] = False
        long = np.diff(want)[same]
        owner = np.repeat(same, long)
        wrong[i + owner[text[ranges(have[same], long)] != given[ranges(want[same], long)]]] = True
    return wrong
