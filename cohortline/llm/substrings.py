"""Substring dedup: 50-byte strings found by interval expansion on Burrows-Wheeler transforms.

Texts are cut into pieces so that equal 50-byte strings meet in one task, whatever their
documents. Of the 24-byte grams in a 50-byte window the one with the least hash (the
rightmost of equals) is the window's anchor; windows that follow each other and share
an anchor are a piece. Equal windows have equal anchors, so the pieces of an anchor hold
all their occurrences. Equal pieces count once, with their smallest doc_id.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import stored, text_or_empty, travels

# Length of the strings, and of the grams that anchor them.
LENGTH, GRAM = 50, 24
# Bytes of text in a block (a longer text alone), and for each part that anchors are dealt to.
BLOCK_BYTES, PART_BYTES = 1 << 20, 4 << 20
# Symbols of a transform; the pieces of one anchor stay together.
SYMBOLS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)
U32 = np.uint64(32)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, inverse))


class Hashes:
    """Hashes of any stretches of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(1 << max(20, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self) -> np.ndarray:
        """Hash of the gram at each place."""
        n = max(0, len(self.sums) - GRAM)
        return mixed((self.sums[GRAM : GRAM + n] - self.sums[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U32)) * MIX
    x = (x ^ (x >> U32)) * MIX
    return x ^ (x >> U32)


class Pieces:
    """Pieces of a block of texts, and the distinct ones among them.

    ``start``, ``windows``, ``anchor``, ``doc`` describe every piece (first window, number of
    windows, gram hash, number of its text); ``of`` maps it to a distinct piece. Distinct
    pieces are ordered by part and hash, and ``first`` names one piece of each.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: int):
        hashes = Hashes(data)
        grams = hashes.grams()
        span = LENGTH - GRAM + 1
        packed = (grams & ~LOW) | (LOW - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while width * 2 <= span:
            packed = np.minimum(packed[:-width], packed[width:]) if len(packed) > width else packed[:0]
            width *= 2
        rest = span - width
        packed = np.minimum(packed[: len(packed) - rest], packed[rest:]) if len(packed) > rest else packed[:0]
        valid = np.ones(len(packed), bool)
        for end in offsets[1:-1].tolist():  # windows that would run into the next text
            valid[max(0, end - LENGTH + 1) : end] = False
        at = np.flatnonzero(valid)
        place = (LOW - (packed[at] & LOW)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.start, self.windows = at[begin], np.diff(np.append(begin, len(at)))
        self.offset = place[begin] - self.start
        self.anchor = mixed(grams[place[begin]])  # least hashes are all small: mixed anew they deal evenly
        self.part = (((self.anchor >> U32) * np.uint64(parts)) >> U32).astype(np.int64)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        content = hashes.of(self.start, self.start + self.windows + LENGTH - 1)
        order = np.lexsort((content, self.part))
        changed = np.ones(len(order), bool)
        changed[1:] = (content[order][1:] != content[order][:-1]) | (self.part[order][1:] != self.part[order][:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(changed) - 1
        self.order, self.heads = order, np.flatnonzero(changed)
        self.first = order[self.heads]

    def extremes(self, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest doc_id of each distinct piece."""
        ids = doc_ids[self.doc[self.order]]
        if not len(ids):
            return ids, ids
        return np.minimum.reduceat(ids, self.heads), np.maximum.reduceat(ids, self.heads)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string."""
    head = struct.pack(f"<{1 + len(arrays)}Q", len(arrays), *[a.nbytes for a in arrays])
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}Q", raw, 8), 8 * (1 + len(kinds)), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def blocks_of(docs: DataFrame) -> DataFrame:
    """Texts packed into compressed blocks: block, n_bytes, data. Any order of rows will do."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0

        def block(ids: list[int], texts: list[bytes]):
            nonlocal k
            offsets = np.cumsum([0, *map(len, texts)])
            data = pack(np.array(ids, np.int64), offsets.astype(np.int64), np.frombuffer(b"".join(texts), np.uint8))
            k += 1
            return pa.RecordBatch.from_pydict({"block": [(task << 32) + k], "n_bytes": [int(offsets[-1])], "data": [data]}, schema=shape)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer()
                text = text.to_pybytes() if text is not None else b""
                if ids and size + len(text) > BLOCK_BYTES:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(batch.column("doc_id")[i].as_py())
                texts.append(text)
                size += len(text)
        if ids:
            yield block(ids, texts)

    shape = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())])
    return docs.mapInArrow(run, "block long, n_bytes long, data binary")


def chunks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (begin, end) of items whose sizes add up to about ``most``, an item at least."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *cut.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def opened(data: bytes, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Pieces]:
    doc_ids, offsets, text = unpack(data, "<i8", "<i8", "u1")
    return doc_ids, offsets, text, Pieces(text, offsets, parts)


def each_block(df: DataFrame, work, schema: dict[str, pa.DataType]) -> DataFrame:
    """Rows that ``work`` makes of one row of blocks at a time, without copies of a whole batch."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(work(*[column[i] for column in batch.columns]))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=list(schema))

    spelled = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return df.mapInArrow(run, ", ".join(f"{c} {spelled[t]}" for c, t in schema.items()))


def by_part(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the runs of a sorted array."""
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cut.tolist(), len(part)]
    return [(int(part[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def anchors(blocks: DataFrame, parts: int) -> DataFrame:
    """Distinct anchors of each block and part, and whether two texts of the block hold them."""

    def work(block, data):
        doc_ids, _, _, pieces = opened(data.as_buffer(), parts)
        low, high = pieces.extremes(doc_ids)
        part, gram = pieces.part[pieces.first], (pieces.anchor[pieces.first] & LOW).astype(np.uint32)
        order = np.lexsort((gram, part))
        part, gram, low, high = part[order], gram[order], low[order], high[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(new)
        if len(heads):
            several = np.minimum.reduceat(low, heads) < np.maximum.reduceat(high, heads)
            part, gram = part[heads], gram[heads]
            for p, a, b in by_part(part):
                yield p, block.as_py(), gram[a:b].tobytes(), np.packbits(several[a:b]).tobytes()

    schema = {"part": pa.int64(), "block": pa.int64(), "grams": pa.binary(), "several": pa.binary()}
    return each_block(blocks.select("block", "data"), work, schema)


def shared_anchors(found: DataFrame) -> DataFrame:
    """For each block and part, which of its anchors two texts hold, anywhere."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, "<u4") for g in frame["grams"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(g)) for s, g in zip(frame["several"], grams, strict=True)])
        _, of, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = (n > 1) | (np.bincount(of, weights=several, minlength=len(n)) > 0)
        flags = np.split(shared[of], np.cumsum([len(g) for g in grams])[:-1])
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "data": [np.packbits(f).tobytes() for f in flags]})

    return found.groupBy("part").applyInPandas(run, "block long, part long, data binary")


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with what the parts sent back: block, data, parts, replies.

    A plain join at every size: replies grow with the input, so they are not broadcast.
    """
    packed = replies.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("r"))  # a block's parts at most
    packed = packed.select("block", F.col("r.part").alias("parts"), F.col("r.data").alias("replies"))
    return blocks.select("block", "data").join(packed, "block", "left")


def shared_pieces(asked: DataFrame, parts: int) -> DataFrame:
    """Distinct pieces of each block whose anchors are shared: part, block, data."""

    def work(block, data, names, replies):
        if not names.is_valid:
            return
        doc_ids, _, text, pieces = opened(data.as_buffer(), parts)
        low, high = pieces.extremes(doc_ids)
        part, gram = pieces.part[pieces.first], (pieces.anchor[pieces.first] & LOW).astype(np.uint32)
        flags = dict(zip(names.as_py(), replies.as_py(), strict=True))
        for p, a, b in by_part(part):
            distinct, of = np.unique(gram[a:b], return_inverse=True)
            number = np.flatnonzero(np.unpackbits(np.frombuffer(flags[p], np.uint8), count=len(distinct))[of])
            if not len(number):
                continue
            one = pieces.first[a:b][number]
            start, windows = pieces.start[one], pieces.windows[one]
            size = windows + LENGTH - 1
            body = text[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]
            arrays = (number.astype(np.uint32), low[a:b][number], high[a:b][number], pieces.offset[one].astype(np.uint8), windows.astype(np.uint8), body)
            yield p, block.as_py(), pack(*arrays)

    return each_block(asked, work, {"part": pa.int64(), "block": pa.int64(), "data": pa.binary()})


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first 56 symbols (of at most nine bits each)."""
    n = len(symbols)
    pad = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    two = pad[:-1] << np.uint64(9) | pad[1:]
    three = two[:-1] << np.uint64(9) | pad[2:]
    four = two[:-2] << np.uint64(18) | two[2:]
    key = four[:n] << np.uint64(27) | three[4 : n + 4]
    reach = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        if reach >= LENGTH:
            return order
        rank = np.zeros(n + reach, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(np.uint64) + np.uint64(1)
        key = rank[:n] << U32 | rank[reach:]
        reach *= 2


def interval_edges(bwt: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at each row of the transform whose suffix differs from the one before within ``length`` symbols.

    Breadth-first backward extension, by increasing common prefix: extending the intervals of
    length-k prefixes by the symbol before them gives those of length k + 1. Rows r - 1 and r
    that begin with the same symbol are the extensions of two rows i < j (``back``), and
    their common prefix is k + 1 exactly if an edge of length k lies between i and j. Rows
    without an edge after ``length`` - 1 extensions share a prefix of ``length`` or more.
    """
    back = np.argsort(bwt, kind="stable")
    first = bwt[back]
    edge = np.ones(len(bwt), bool)
    edge[1:] = first[1:] != first[:-1]
    left = np.flatnonzero(~edge)
    low, high = np.minimum(back[left - 1], back[left]), np.maximum(back[left - 1], back[left])
    for _ in range(length - 1):
        edges = np.cumsum(edge, dtype=np.int32)
        apart = edges[high] > edges[low]
        if not apart.any():
            break
        edge[left[apart]] = True
        left, low, high = left[~apart], low[~apart], high[~apart]
    return edge


def earliest(body: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Smallest doc_id that holds the string of each window of the given pieces, all windows in a row."""
    size = windows + LENGTH - 1
    ends = np.cumsum(size)
    symbols = np.zeros(len(body) + len(size), np.uint16)  # zero ends a piece
    starts = ends - size + np.arange(len(size))
    symbols[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body.astype(np.uint16) + np.uint16(1)
    order = suffix_order(symbols)
    edge = interval_edges(symbols[order - 1])
    at = np.arange(windows.sum()) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    owner = np.full(len(symbols), np.iinfo(np.int64).max)
    owner[at] = np.repeat(doc, windows)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(edge))
    out = np.empty(len(symbols), np.int64)
    out[order] = least[np.cumsum(edge) - 1]
    return out[at]


def earlier_windows(sent: DataFrame) -> DataFrame:
    """Runs of windows that an earlier text holds, for each block and part: block, part, data."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [unpack(d, "<u4", "<i8", "<i8", "u1", "u1", "u1") for d in frame["data"]]
        number, low, high, offset, windows, body = (np.concatenate(x) for x in zip(*sets, strict=True))
        windows, offset = windows.astype(np.int64), offset.astype(np.int64)
        size = windows + LENGTH - 1
        begin = np.cumsum(size) - size
        content, grams = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
        for a, b in chunks(size, SYMBOLS):
            at, length, hashes = begin[a:b] - begin[a], size[a:b], Hashes(body[begin[a] : begin[b - 1] + size[b - 1]])
            content[a:b], grams[a:b] = hashes.of(at, at + length), hashes.of(at + offset[a:b], at + offset[a:b] + GRAM)
        _, first, of = np.unique(content, return_index=True, return_inverse=True)
        doc = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(doc, of, low)
        gram = grams[first]
        order = np.argsort(gram, kind="stable")
        alone = np.ones(len(order) + 1, bool)
        alone[1:-1] = gram[order][1:] != gram[order][:-1]
        alone = alone[:-1] & alone[1:]  # nothing to compare a piece with: its windows are its own
        wins = windows[first]
        base = np.cumsum(wins) - wins
        found = np.repeat(doc, wins)
        rest = order[~alone]
        group = np.cumsum(np.concatenate([[True], gram[rest][1:] != gram[rest][:-1]])) if len(rest) else rest
        while len(rest):
            total = np.cumsum(size[first[rest]] + 1)
            take = max(int(np.searchsorted(total, SYMBOLS)), int(np.searchsorted(group, group[0], side="right")))
            take = take if take >= len(rest) or group[take] != group[take - 1] else int(np.searchsorted(group, group[take]))
            take = max(take, int(np.searchsorted(group, group[0], side="right")))
            now, rest, group = rest[:take], rest[take:], group[take:]
            length = size[first[now]]
            text = body[np.arange(length.sum()) + np.repeat(begin[first[now]] - (np.cumsum(length) - length), length)]
            places = np.arange(wins[now].sum()) + np.repeat(base[now] - (np.cumsum(wins[now]) - wins[now]), wins[now])
            found[places] = earliest(text, wins[now], doc[now])
        rows, at = [], 0
        for block, part, numbers in zip(frame["block"], frame["part"], [s[0] for s in sets], strict=True):
            mine = slice(at, at := at + len(numbers))
            w, piece = windows[mine], np.repeat(np.arange(len(numbers)), windows[mine])
            inner = np.arange(len(piece)) - np.repeat(np.cumsum(w) - w, w)
            value = found[np.repeat(base[of[mine]], w) + inner]
            new = np.ones(len(piece), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (value[1:] != value[:-1])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(piece)) - 1
            use = value[head] < high[mine][piece[head]]
            if use.any():
                head, last = head[use], last[use]
                arrays = (numbers[piece[head]], inner[head].astype(np.uint8), inner[last].astype(np.uint8), value[head])
                rows.append((block, part, pack(*arrays)))
        return pd.DataFrame(rows, columns=["block", "part", "data"])

    return sent.groupBy("part").applyInPandas(run, "block long, part long, data binary")


def removed(asked: DataFrame, parts: int) -> DataFrame:
    """Apply the replies: doc_id, kept, n_bytes, n_removed, starts, ends."""

    def work(block, data, names, replies):
        doc_ids, offsets, text, pieces = opened(data.as_buffer(), parts)
        change = np.zeros(len(text) + 1, np.int64)
        bounds = {p: a for p, a, _ in by_part(pieces.part[pieces.first])}
        edges = np.append(pieces.heads, len(pieces.order))
        for p, reply in zip(names.as_py() or (), replies.as_py() or (), strict=True):
            number, first, last, value = unpack(reply, "<u4", "u1", "u1", "<i8")
            distinct = number.astype(np.int64) + bounds[p]
            n = edges[distinct + 1] - edges[distinct]
            one = pieces.order[np.arange(n.sum()) + np.repeat(edges[distinct] - (np.cumsum(n) - n), n)]
            later = doc_ids[pieces.doc[one]] > np.repeat(value, n)
            begin = pieces.start[one] + np.repeat(first.astype(np.int64), n)
            end = pieces.start[one] + np.repeat(last.astype(np.int64), n) + LENGTH
            np.add.at(change, begin[later], 1)
            np.add.at(change, end[later], -1)
        gone = np.cumsum(change[:-1]) > 0
        for k, doc_id in enumerate(doc_ids.tolist()):
            mine, own = gone[offsets[k] : offsets[k + 1]], text[offsets[k] : offsets[k + 1]]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            yield doc_id, own[~mine].tobytes(), len(own), int(mine.sum()), turn[::2], turn[1::2]

    runs = pa.list_(pa.int64())
    schema = {"doc_id": pa.int64(), "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "starts": runs, "ends": runs}
    return each_block(asked, work, schema)


def drop_repeated_strings(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Remove bytes of 50-byte strings that a document with a smaller doc_id holds, too.

    One row per row of ``docs``: doc_id, kept (binary; a cut may fall within a character),
    n_bytes, n_removed, starts and ends (the removed runs). Strings are judged on the
    input, overlaps count, and matches never cross documents.

    Texts are packed once into blocks in the shared folder, and each pass reads blocks. The
    first sends the distinct anchors of a block (four bytes each) to parts of the anchors'
    hash range and learns which are shared by two texts. The second sends the distinct
    pieces of shared anchors; each part sorts the suffixes of its pieces, expands the
    intervals of their transform up to 50 bytes and finds for every window the smallest
    doc_id. The third applies the runs of windows that come back. Replies meet their blocks
    by a join on the block. Parts grow in number with the input, and a text, line or
    passage that many documents share counts once for each block, so no part gathers its
    documents. The pieces of one anchor do meet in one part: as many as there are
    different neighbourhoods of one 24-byte gram.

    NULL and empty texts, and those under 50 bytes, keep all bytes. Of rows that repeat a doc_id
    neither is earlier. NULL doc_id counts as the smallest of all. An empty table gives an
    empty result. Only doc_id and text are read. One text is held whole by one task.
    """
    lowest = F.lit(-(1 << 63))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), text_or_empty().alias("text"))
    blocks = stored(blocks_of(base), "strings-blocks")
    parts = max(1, -(-(blocks.agg(F.sum("n_bytes").alias("n")).first().n or 0) // part_bytes))
    flags = stored(shared_anchors(anchors(blocks, parts)), "strings-shared")
    runs = stored(earlier_windows(shared_pieces(with_replies(blocks, flags), parts)), "strings-runs")
    return removed(with_replies(blocks, runs), parts).withColumn("doc_id", F.nullif("doc_id", lowest))


travels(__name__)
