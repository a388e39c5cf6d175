"""Suffix-array deduplication of byte strings that start in several documents.

The repeats that are looked for have `width` bytes. Every window of that many
bytes has an anchor: the 16-gram of least hash in it, with the bytes beside it
that all windows have in which that gram lies in the same half (33 or 34 bytes
of 50). Equal windows have equal anchors. So windows are dealt out by anchor: a
fragment is the bytes of neighbouring windows of one anchor, and all fragments
of an anchor go to one shard, whose suffixes are sorted (see `induced`) to find
equal windows. Only fragments whose anchor is in two documents or more are
sent, each once per block of documents, with the least doc_id it has there; so
copies, however many, weigh as one per block. The gram alone would be in many
documents by chance, and most of what is sorted would have no equal.

An anchor with many variants is not sent to one shard: its fragments are cut
into single windows, which are dealt out by the hash of all their bytes, so
equal windows still meet and no shard gets more than its part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, block_of_row, frugal, text_slices
from .induced import array, blocks, suffixes

GRAM = 16
LAST = np.iinfo(np.int64).max  # the place of a null doc_id


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, last window, key, hash of the fragment) of each anchor, in order; windows are counted from the text's start."""
    none = np.zeros(0, np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    h = joined.astype(np.uint64) + np.uint64(1)
    for k, factor in zip((1, 2, 4, 8), (0x100000001B3, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), strict=True):
        h = h[:-k] * np.uint64(factor) + h[k:]
    h = mixed(h)
    # the upper half of the hash and the place in one number: of equal hashes the first is the least
    least, span, want = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, width - GRAM + 1
    while span < want:
        k = min(span, want - span)
        least = np.minimum(least[k:], least[:-k])
        span += k
    inside = np.zeros(len(least), bool)
    for a, n in zip(start[size >= width].tolist(), size[size >= width].tolist(), strict=True):
        inside[a : a + n - width + 1] = True
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    own = (least.view(np.uint32)[::2] if sys.byteorder == "little" else least & np.uint64(0xFFFFFFFF))[window].astype(np.int64)
    half = (width - GRAM) // 2
    left = own - window > half
    new = np.append(True, (own[1:] != own[:-1]) | (left[1:] != left[:-1]))
    first = window[new]
    last = window[np.append(np.flatnonzero(new)[1:] - 1, len(window) - 1)]
    text = np.searchsorted(start, first, "right") - 1  # of texts that start at one place, the last is the one that is not empty
    end = last + (width - GRAM)
    sign = (end - first).astype(np.uint64)
    for k in range(0, 2 * (width - GRAM) + GRAM, GRAM):  # grams that cover the longest fragment
        sign = mixed(sign + h[np.minimum(first + k, end)])
    own, left = own[new], left[new]
    core, core_end = own - (half + 1) * left, own + (width - half - GRAM) * ~left  # the first and the last gram of what all windows of this side have
    key = left.astype(np.uint64) + np.uint64(1)
    for k in range(0, width - half, GRAM):
        key = mixed(key + h[np.minimum(core + k, core_end)])
    return text, first - start[text], last - start[text], key, sign


def portions(rows: Iterator[tuple], limit: int = 200_000) -> Iterator[list[tuple]]:
    """Rows in lists whose last items, texts, have about `limit` bytes together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def six(keys: np.ndarray) -> bytes:
    """The upper six bytes of each key."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows of that shard)."""
    shard = ((keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(shard[part[0]]), part


def first_documents(text: np.ndarray, start: np.ndarray, least: np.ndarray, width: int, memory_rows: int, levels: list | None = None) -> np.ndarray:
    """The least document that the window at each position starts in. `text` has fragments, as bytes plus 1, with a 0 after each; `start` and `least` are where each begins and the least document that has it."""
    stop = array(len(text), bool, memory_rows)
    for p in blocks(len(text), memory_rows):
        stop[p] = text[p] == 0
    position, prefix = suffixes(text, stop, width, memory_rows, levels)
    first = array(len(text), np.int64, memory_rows)
    held, low = [], LAST  # the group of equal windows that is open at the end of a block
    for p in blocks(len(position), memory_rows):
        at = position[p]
        doc = least[np.searchsorted(start, at, "right") - 1]
        new = np.flatnonzero(prefix[p] < width)
        head = int(new[0]) if len(new) else len(at)
        if head:
            held.append(at[:head])
            low = min(low, int(doc[:head].min()))
        if len(new):
            for x in held:
                first[x] = low
            lows, sizes = np.minimum.reduceat(doc[head:], new - head), np.diff(np.append(new, len(at)))
            first[at[head : new[-1]]] = np.repeat(lows[:-1], sizes[:-1])
            held, low = [at[new[-1] :]], int(lows[-1])
    for x in held:
        first[x] = low
    return first


def removed(docs: DataFrame, keep: list[str], width: int = 50, block_bytes: int = 12_000_000, shard_bytes: int = 12_000_000, memory_rows: int = 1 << 17, whole_characters: bool = False, most_variants: int = 8192) -> DataFrame:
    """The columns `keep` and n_bytes (long), spans (array of start, end in bytes), kept (binary), one row per input row.

    Texts are UTF-8 bytes, null as empty. A byte is removed if a string of
    `width` bytes that covers it also starts in a document of smaller doc_id;
    matches lie within a document, and are judged on the input. Rows that
    share a doc_id do not count against each other; a null doc_id counts as
    larger than all others. `spans` are the maximal removed runs, `kept` is
    the rest; with `whole_characters` the runs give up parts of characters at
    their ends, so that `kept` is text. Found windows are compared by all
    their bytes, but a fragment finds its answer by a 128-bit hash.

    Documents are dealt into blocks of about `block_bytes`, by hash of doc_id
    and text, and fragments into shards for about `shard_bytes` of text each;
    both grow with the input. Of the sort of a shard, `memory_rows` entries of
    each array and of its queues are in memory; text, order, prefixes and
    answers are in temporary files of the task beyond that, and the sort
    recurses while there are more than four times as many names. In memory are a shard's packed
    fragments as they arrive, and a digest, a document and an anchor of each
    distinct one. An anchor with more than `most_variants` fragments (counted
    by block, so one may count several times) is dealt out by windows. An
    empty table gives no rows; columns of `keep` named like a result give way,
    other names clash with nothing.
    """
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // block_bytes))
    shards = max(n_blocks, -(-total // shard_bytes))
    kept = Kept(keep, "n_bytes", "spans", "kept")
    keep, passed = kept.inner, kept.columns()
    kept_schema = docs.select(*passed).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        frugal()
        for b in batches:
            texts = [packer.compress(t or b"") for part in text_slices(b.column("_text").cast(pa.binary())) for t in part]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], [*b.schema.names[:-1], "_packed"])

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    head = [block_of_row(n_blocks).alias("_block"), order.alias("_doc"), *passed]
    packed = docs.select(*head, F.col("text").alias("_text")).mapInArrow(pack, docs.select(*head).schema.add("_packed", "binary")).repartition(n_blocks, "_block")

    def texts_of(b, *columns: str) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        for *own, data in zip(*[b.column(c).to_pylist() for c in columns], b.column("_packed").to_pylist(), strict=True):
            yield (*own, unpack(data))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of each block, whether several of its documents have them, and in how many variants about."""
        frugal()
        seen: dict[int, list] = {}
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for rows in portions(texts_of(b, "_block", "_doc")):
                text, _, _, key, sign = anchors([r[-1] for r in rows], width)
                block, doc = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
                for k in np.unique(block):
                    mine = block[text] == k
                    seen.setdefault(int(k), []).append((key[mine], doc[text[mine]], sign[mine]))
        for k in sorted(seen):
            parts = seen.pop(k)
            key, doc, sign = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
            at = np.lexsort((doc, key))
            key, doc, sign = key[at], doc[at], sign[at]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            several = doc[new] != doc[np.append(new[1:], len(key)) - 1] if len(new) else np.zeros(0, bool)
            variants = np.diff(np.append(new, len(key)))
            for i in np.flatnonzero(variants > 16).tolist():
                variants[i] = len(np.unique(sign[new[i] : new[i] + variants[i]]))
            key, variants = key[new], variants.astype(np.uint32)
            got = [(s, k, six(key[part]), np.packbits(several[part]).tobytes(), packer.compress(variants[part].tobytes())) for s, part in by_shard(key, shards)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["shard", "_block", "keys", "several", "variants"])

    asked = packed.mapInArrow(ask, "shard int, _block int, keys binary, several binary, variants binary")

    def answer(table: pa.Table) -> pa.Table:
        """The anchors that two documents or more have, to each block that has them, and which of them have too many variants for one shard."""
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [from_six(x) for x in table.column("keys").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] for x, p in zip(table.column("several").to_pylist(), parts, strict=True)]
        whole, weight = np.concatenate(parts), np.concatenate(flags).astype(np.int64) + 1
        unique, back = np.unique(whole, return_inverse=True)
        shared = np.bincount(back, weights=weight) >= 2
        variants = np.concatenate([np.frombuffer(unpack(x), np.uint32) for x in table.column("variants").to_pylist()])
        hot = shared & (np.bincount(back, weights=variants) > most_variants)
        at = [np.searchsorted(unique, p) for p in parts]
        rows = [(b, six(p[shared[i]]), six(p[hot[i]])) for b, p, i in zip(table.column("_block").to_pylist(), parts, at, strict=True) if shared[i].any()]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("_block", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())))})

    shared = asked.groupBy("shard").applyInArrow(answer, "_block int, keys binary, hot binary")

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        """Each distinct fragment of a block with a shared anchor (of hot anchors, each window), with the least and the largest document that has it."""
        frugal()
        hot = b"".join(found.column("hot").to_pylist())
        apart = set(from_six(hot).tolist())
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(from_six, found.column("keys").to_pylist())]))
        fragments: dict[bytes, list] = {}
        for rows in portions(texts_of(table, "_doc")) if len(wanted) else []:
            text, lo, hi, own, _ = anchors([r[-1] for r in rows], width)
            short = own & ~np.uint64(0xFFFF)
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short)
            for t, a, b, k in zip(text[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), own[hit].tolist(), strict=True):
                doc, data = rows[t]
                windows = apart and k & ~0xFFFF in apart
                for piece in [data[i : i + width] for i in range(a, b + 1)] if windows else [data[a : b + width]]:
                    was = fragments.get(piece)
                    if was is None:
                        fragments[piece] = [doc, doc, xxhash.xxh3_64_intdigest(piece) if windows else k]
                    elif doc < was[0]:
                        was[0] = doc
                    elif doc > was[1]:
                        was[1] = doc
        pieces = list(fragments)
        docs_of = np.array([fragments[p][:2] for p in pieces], np.int64).reshape(-1, 2)
        keys = np.array([fragments[p][2] for p in pieces], np.uint64)
        out, pack = [], zstandard.ZstdCompressor(level=3).compress
        for s, part in by_shard(keys, shards):
            part = part[np.argsort(keys[part], kind="stable")]
            own = [pieces[i] for i in part.tolist()]
            out.append((s, int(table.column("_block")[0].as_py()), pack(b"".join(own)), pack(np.array([len(p) for p in own], np.int32).tobytes()), pack(docs_of[part].tobytes()), six(keys[part]), b"" if out else hot))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(("shard", "_block", "pieces", "sizes", "docs", "keys", "hot"), kinds, strict=True))})

    fragments = packed.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(cut_out, "shard int, _block int, pieces binary, sizes binary, docs binary, keys binary, hot binary")

    def sort_shard(table: pa.Table) -> pa.Table:
        """For each block, the fragments in which it has something to remove, and the first document of each of their windows in runs."""
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        frugal()
        rows = list(zip(*[table.column(c).to_pylist() for c in ("pieces", "sizes", "docs", "keys")], strict=True))
        number: dict[bytes, int] = {}  # by digest
        asked_by, low, anchor, length = [], [], [], []
        for data, sizes, docs_of, keys in rows:
            whole, size = unpack(data), np.frombuffer(unpack(sizes), np.int32)
            ends = np.cumsum(size).tolist()
            pair = np.frombuffer(unpack(docs_of), np.int64).reshape(-1, 2)
            own = np.array([number.setdefault(xxhash.xxh3_128_digest(whole[a:b]), len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
            asked_by.append((own, pair[:, 1]))
            low.append(pair[:, 0])
            anchor.append(from_six(keys))
            length.append(size)
        least, key, size = np.full(len(number), LAST), np.zeros(len(number), np.uint64), np.zeros(len(number), np.int64)
        for (own, _), docs_low, keys, n in zip(asked_by, low, anchor, length, strict=True):
            np.minimum.at(least, own, docs_low)
            key[own], size[own] = keys, n
        del low, anchor, length
        # windows are equal only if their anchors are, so an anchor with but one fragment has nothing to be compared with
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        sorted_ones = np.flatnonzero(count[group] > 1)
        place = np.full(len(number), -1)
        place[sorted_ones] = np.arange(len(sorted_ones))
        own_size = size[sorted_ones]
        start = np.cumsum(own_size + 1) - own_size - 1
        text = array(int((own_size + 1).sum()), np.uint8, memory_rows)
        for p in blocks(len(text), memory_rows):
            text[p] = 0
        written = np.zeros(len(sorted_ones) + 1, bool)  # the last stands for those that are not sorted
        for (data, *_), (own, _) in zip(rows, asked_by, strict=True):
            whole, ends = np.frombuffer(unpack(data), np.uint8) + np.uint8(1), np.cumsum(size[own])
            at = place[own]
            fresh = np.flatnonzero((at >= 0) & ~written[at])
            for i in fresh.tolist():
                a, n = start[at[i]], size[own[i]]
                text[a : a + n] = whole[ends[i] - n : ends[i]]
            written[at[fresh]] = True
        first = first_documents(text, start, least[sorted_ones], width, memory_rows)
        lowest, windows = least.copy(), own_size - (width - 1)
        for p in blocks(len(start), max(1, memory_rows // width)):
            a, b = int(start[p.start]), int(start[p.stop - 1] + own_size[p.stop - 1] + 1)
            edges = np.stack([start[p], start[p] + windows[p]], 1).ravel() - a
            lowest[sorted_ones[p]] = np.minimum.reduceat(first[a:b], edges)[::2]
        digests = list(number)
        runs: dict[int, bytes] = {}
        out = []
        for block, hot, (own, most) in zip(table.column("_block").to_pylist(), table.column("hot").to_pylist(), asked_by, strict=True):
            names, told = [], []
            some = own[lowest[own] < most]
            for i in some.tolist():
                if i not in runs:
                    k = place[i]
                    f = first[start[k] : start[k] + windows[k]] if k >= 0 else least[i : i + 1]
                    at = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                    runs[i] = np.stack([at, f[at]]).T.tobytes()
                names.append(digests[i])
                told.append(runs[i])
            if names or hot:
                out.append((block, b"".join(names), six(np.unique(key[some])), pack(np.array([len(t) for t in told], np.int32).tobytes()), pack(b"".join(told)), hot))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(("_block", "names", "keys", "sizes", "runs", "hot"), kinds, strict=True))})

    told = fragments.groupBy("shard").applyInArrow(sort_shard, "_block int, names binary, keys binary, sizes binary, runs binary, hot binary")

    def spans_of(doc: int, windows: list[tuple[int, int, bytes]]) -> list[list[int]]:
        """Maximal runs removed from one document, from (first window, last window, runs of first documents)."""
        out: list[list[int]] = []
        for lo, hi, data in windows:
            pairs = np.frombuffer(data, np.int64).reshape(-1, 2).tolist()
            for (at, first), (end, _) in zip(pairs, [*pairs[1:], [hi - lo + 1, 0]], strict=True):
                if first < doc:
                    if out and lo + at <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], lo + end - 1 + width)
                    else:
                        out.append([lo + at, lo + end - 1 + width])
        return out

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        frugal()
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, bytes] = {}
        apart = set(from_six(b"".join(found.column("hot").to_pylist())).tolist())
        for names, sizes, data in zip(*[found.column(c).to_pylist() for c in ("names", "sizes", "runs")], strict=True):
            whole, ends = unpack(data), np.cumsum(np.frombuffer(unpack(sizes), np.int32)).tolist()
            known.update((names[16 * i : 16 * i + 16], whole[a:b]) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)))
        hot_keys = np.array(sorted(apart), np.uint64)
        asked = np.unique(np.concatenate([hot_keys, *map(from_six, found.column("keys").to_pylist())]))
        n_bytes, spans, rest = [], [], []
        for rows in portions(texts_of(table, "_doc")):
            hits: list[list] = [[] for _ in rows]
            if known:
                text, lo, hi, key, _ = anchors([r[-1] for r in rows], width)
                key &= ~np.uint64(0xFFFF)
                some = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key)
                for t, a, b, k in zip(*[x[some].tolist() for x in (text, lo, hi, key)], strict=True):
                    for i, j in [(i, i) for i in range(a, b + 1)] if k in apart else ((a, b),):
                        runs = known.get(xxhash.xxh3_128_digest(rows[t][-1][i : j + width]))
                        if runs is not None:
                            hits[t].append((i, j, runs))
            for (doc, data), windows in zip(rows, hits, strict=True):
                own = spans_of(doc, windows)
                if whole_characters:
                    own = [x for x in (whole_span(data, a, b) for a, b in own) if x[0] < x[1]]
                n_bytes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in own])
                rest.append(b"".join(data[a:b] for a, b in zip([0, *[x[1] for x in own]], [*[x[0] for x in own], len(data)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays([*[table.column(c) for c in keep], pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], [*keep, "n_bytes", "spans", "kept"])

    spark = docs.sparkSession
    schema = spark.createDataFrame([], "n_bytes long, spans array<struct<start:long,end:long>>, kept binary").schema
    for f in schema:
        kept_schema = kept_schema.add(f)
    return kept.restored(packed.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(remove, kept_schema), "n_bytes", "spans", "kept")


def whole_span(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that consists of whole UTF-8 characters."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end
