"""Repeated passages by a distributed suffix array over a difference cover.

Removes every byte that a ``width``-byte string covers which also starts in a
document with a smaller id. Steps:

1. Candidates, without loss: a place's fingerprint is the least hash of the GRAM-byte
   strings in its next ``width`` bytes, so equal strings have equal fingerprints.
   Places in a row with one fingerprint form a piece. Blocks of texts send their
   distinct fingerprints, packed by hash range, and are told by one bit each which
   of them another block has too.
2. Pieces whose fingerprint two texts share are exchanged by it, equal ones of a block
   once, with their least id. Equal strings so meet in one suffix array.
3. Suffix array (``suffix_order``). Places i with i mod 3 in {1, 2} are the sample. Triples
   of two-byte symbols are sorted and named by rank; triples of names are sorted and
   named again, which decides 18, then 54 bytes, unless all names differ before. The
   other suffixes are merged by (byte, rank of the next place) against class 1 and by
   (two bytes, rank of the place after) against class 2.
4. Neighbours in that order are compared in their first ``width`` bytes (by 64-bit
   fingerprint); runs of equal ones share the least id of their pieces, which goes back
   to every block that sent the piece. The block has kept its texts' places, so only what
   a block sent is exchanged, and each text's spans are made in one task.

Spark deals blocks and fingerprints to tasks; a task holds one block, or the pieces of
about ``ARRAY_BYTES`` of text, and sorts about ``SORTED_BYTES`` of them in one array. A
fingerprint is never split.

Defined results: null text is empty; a null id counts as greater than all others;
rows with equal ids do not remove from each other; texts shorter than ``width`` stay
whole; repeated rows with one id are cut alike; a very long text is read whole; the
input's columns are kept in a struct, so their names cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.columns import row_of, text_of
from strideline.llm.hashing import Spans, blocks, buffer_of
from strideline.sources.scratch import Scratch

GRAM = 20
#: Longest row of places with one fingerprint that is kept as one piece.
LONGEST = 64
ARRAY_BYTES = 1 << 21
#: Places whose fingerprints are computed at a time: few enough for a core's cache.
STRETCH = 1 << 14
#: Text bytes of one suffix array, more only where one fingerprint has more: its sort keys and indices fit 64 bits, its arrays the cache.
SORTED_BYTES = 1 << 15
#: Text bytes for each hash range of fingerprints.
RANGE_BYTES = 8 << 20

_SENT = (
    "block bigint, bucket int, fps binary, ords array<bigint>, ths array<bigint>, counts array<int>, "
    "starts binary, lens binary, of binary, twice binary"
)


def minima(data: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of every place with ``width`` bytes ahead."""
    out = np.empty(max(len(data) - width + 1, 0), np.uint64)
    for a in range(0, len(out), STRETCH):
        part = data[a : a + STRETCH + width - 1]
        m, reach, wanted = Spans(part).every(GRAM), 1, width - GRAM + 1
        while 2 * reach <= wanted:
            m, reach = np.minimum(m[:-reach], m[reach:]), 2 * reach
        more = wanted - reach
        np.minimum(m[: len(m) - more], m[more:], out=out[a : a + STRETCH])
    return out


def pieces(first: np.ndarray, m: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the buffer and number of places of every piece of a buffer of texts."""
    a, b = first[:-1], first[1:] - width  # a text's places; the line feed after it is not its own
    long = b > a
    edges = np.sort(np.concatenate([np.flatnonzero(m[1:] != m[:-1]) + 1, a[long], b[long]]))
    start, end = edges[:-1], edges[1:]
    inside = (start < end) & (start < b[np.searchsorted(first, start, "right") - 1])
    start, end = start[inside], end[inside]
    parts = -(-(end - start) // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = np.repeat(start, parts) + nth * LONGEST, np.repeat(end, parts)
    return np.searchsorted(first, start, "right") - 1, start, np.minimum(end - start, LONGEST)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and where in it each group of equal ones begins."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _sent(rows: DataFrame, width: int, ranges: int) -> DataFrame:
    """A row a block and hash range with the block's distinct fingerprints; a row a block (bucket -1) with its pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = 0
            for texts in blocks(batch.column(2).to_pylist(), ARRAY_BYTES):
                o, t = ords[row : row + len(texts)], ths[row : row + len(texts)]
                row += len(texts)
                data, first = buffer_of(texts, lower=False)
                m = minima(data, width)
                of_text, start, n = pieces(first, m, width)
                if not len(start):
                    continue
                fps = m[start]
                order, begin = _groups(fps)
                fps, of = fps[order[begin]], np.empty(len(start), np.uint32)
                of[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(start)))
                seen = o[of_text][order]
                twice = np.minimum.reduceat(seen, begin) != np.maximum.reduceat(seen, begin)
                bucket = ((fps >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                texts_with, counts = np.unique(of_text, return_counts=True)
                block = uuid.uuid4().int >> 65
                out = [
                    {
                        "block": block, "bucket": -1, "ords": o[texts_with], "ths": t[texts_with], "counts": counts.astype(np.int32),
                        "starts": (start - first[of_text]).astype(np.int32).tobytes(), "lens": n.astype(np.uint8).tobytes(),
                        "of": of.tobytes(), "twice": np.packbits(twice).tobytes(),
                    }
                ]
                found, at = np.unique(bucket, return_index=True)
                for k, part in zip(found, np.split(fps, at[1:]), strict=True):
                    out.append({"block": block, "bucket": int(k), "fps": part.tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=_SENT_ARROW)

    return rows.select("ord", "th", "t").mapInArrow(work, _SENT)


_SENT_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("bucket", pa.int32()), ("fps", pa.binary()), ("ords", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())), ("starts", pa.binary()), ("lens", pa.binary()), ("of", pa.binary()), ("twice", pa.binary()),
    ]
)


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block's fingerprints of one range, a bit that tells whether another block has it."""
    parts = [np.frombuffer(x, np.uint64) for x in pdf["fps"]]
    _, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(n[of] > 1, cuts)]
    return pd.DataFrame({"told": pdf["block"], "bucket": pdf["bucket"], "n": [len(p) for p in parts], "bits": bits})


def _hits(sent: DataFrame) -> DataFrame:
    """ho, hh, and the starts and lengths of the shared pieces of every text that has any."""
    answers = sent.filter("bucket >= 0").select("block", "bucket", "fps").groupBy("bucket")
    answers = answers.applyInPandas(_answers, "told bigint, bucket int, n int, bits binary")
    answers = answers.groupBy("told").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shared = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in r["answers"]])
                shared |= np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(shared))
                wanted = shared[np.frombuffer(r["of"], np.uint32)].astype(bool)
                starts, lens = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["lens"], np.uint8)
                out = [[], [], [], []]
                at = 0
                for o, h, n in zip(r["ords"], r["ths"], r["counts"], strict=True):
                    w = wanted[at : at + n]
                    if w.any():
                        for column, x in zip(out, (o, h, starts[at : at + n][w].tobytes(), lens[at : at + n][w].tobytes()), strict=True):
                            column.append(x)
                    at += n
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["ho", "hh", "starts", "lens"])

    info = sent.filter("bucket < 0").drop("bucket", "fps").join(answers, F.col("block") == F.col("told"))
    rows = info.select("answers", "ords", "ths", "counts", "starts", "lens", "of", "twice")
    return rows.mapInArrow(work, "ho bigint, hh bigint, starts binary, lens binary").dropDuplicates(["ho", "hh"])


_FOUND = (
    "block bigint, at int, fp bigint, pid bigint, least bigint, greatest bigint, bytes binary, "
    "ords array<bigint>, ths array<bigint>, counts array<int>, starts binary, of binary"
)


def _found(near: DataFrame, width: int) -> DataFrame:
    """A row a block and different shared piece: its least and (if another) greatest id, its bytes; a row a block (at -1) with all places of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts, lens = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            row = 0
            for texts in blocks(batch.column(2).to_pylist(), ARRAY_BYTES):
                rows = slice(row, row + len(texts))
                row += len(texts)
                data, first = buffer_of(texts, lower=False)
                m = minima(data, width)
                counts = np.array([len(x) // 4 for x in starts[rows]], np.int32)
                inside = np.frombuffer(b"".join(starts[rows]), np.int32)
                n = np.frombuffer(b"".join(lens[rows]), np.uint8)
                a = np.repeat(first[:-1], counts) + inside
                b = a + n + (width - 1)
                fp, pid, o = m[a].view(np.int64), Spans(data).hash(a, b).view(np.int64), np.repeat(ords[rows], counts)
                order, begin = _groups(fp, pid)
                shown = order[begin]
                # In the order of the text, where the bytes of neighbours overlap and so take little once compressed.
                by_text = np.argsort(shown)
                nth, of = np.empty(len(shown), np.uint32), np.empty(len(a), np.uint32)
                nth[by_text] = np.arange(len(shown))
                of[order] = np.repeat(nth, np.diff(begin, append=len(a)))
                shown = shown[by_text]
                least, greatest = np.minimum.reduceat(o[order], begin)[by_text], np.maximum.reduceat(o[order], begin)[by_text]
                whole = data.tobytes()
                raw = [whole[x:y] for x, y in zip(a[shown].tolist(), b[shown].tolist(), strict=True)]
                block = uuid.uuid4().int >> 65
                different = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(shown), block)), pa.array(np.arange(len(shown), dtype=np.int32)), pa.array(fp[shown]), pa.array(pid[shown]),
                        pa.array(least), pa.array(greatest, mask=greatest == least), pa.array(raw, pa.binary()),
                        *(pa.nulls(len(shown), t) for t in _FOUND_ARROW.types[7:]),
                    ],
                    schema=_FOUND_ARROW,
                )
                yield different
                places = {
                    "block": block, "at": -1, "ords": ords[rows], "ths": ths[rows], "counts": counts,
                    "starts": inside.tobytes(), "of": of.tobytes(),
                }
                yield pa.RecordBatch.from_pylist([places], schema=_FOUND_ARROW)

    return near.select("ord", "th", "t", "starts", "lens").mapInArrow(work, _FOUND)


_FOUND_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("at", pa.int32()), ("fp", pa.int64()), ("pid", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()),
        ("bytes", pa.binary()), ("ords", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
        ("starts", pa.binary()), ("of", pa.binary()),
    ]
)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of keys of 0 or more: one sort of (key, index) as a word where both fit, which is faster than argsort."""
    bits = np.uint64(len(key).bit_length())
    if not len(key) or int(key.max()).bit_length() + int(bits) > 64:
        return np.argsort(key, kind="stable")
    packed = key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _named(*keys: np.ndarray) -> np.ndarray:
    """Rank (1, 2, ...) of every row of keys among the distinct ones."""
    bits = max(int(k.max()).bit_length() for k in keys)
    if bits * len(keys) <= 64:
        packed = keys[0].astype(np.uint64)
        for k in keys[1:]:
            packed = packed << np.uint64(bits) | k.astype(np.uint64)
        keys = (packed,)
    order = _order(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def _ahead(names: np.ndarray, k: int) -> np.ndarray:
    """The name k places on in the sample, 0 beyond its end."""
    return np.concatenate([names[k:], np.zeros(min(k, len(names)), np.int64)])


def suffix_order(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """``places`` of ``data`` in an order that sorts their next ``width`` bytes."""
    size = -(-(len(data) + 3) // 3) * 3
    text = np.zeros(size + 8, np.int64)
    text[: len(data)] = data
    # The sample, in the order of the text: places 1, 2, 4, 5, ...
    at = np.arange(size).reshape(-1, 3)[:, 1:].ravel()
    two = text[:-1] << 8 | text[1:]
    names, depth = _named(two[at] << 32 | two[at + 2] << 16 | two[at + 4]), 6
    while depth < width + 2 and int(names.max()) < len(names):
        step = depth // 3 * 2
        names, depth = _named(names, _ahead(names, step), _ahead(names, 2 * step)), 3 * depth
    rank = np.zeros(size + 8, np.int64)
    rank[at] = names
    # Merge: a suffix's place is the number of suffixes before it in its own list and in the others.
    cls = places % 3
    zero, one, both = places[cls == 0], places[cls == 1], places[cls > 0]
    deuce = places[cls == 2]
    bits = int(rank.max()).bit_length()
    by_one = {x: text[p] << bits | rank[p + 1] for x, p in (("z", zero), ("s", one))}
    by_two = {x: two[p] << bits | rank[p + 2] for x, p in (("z", zero), ("s", deuce))}
    place = np.zeros(len(places), np.int64)
    own = np.empty(len(both), np.int64)
    own[_order(rank[both])] = np.arange(len(both))
    place[cls > 0] = own
    place[cls == 1] += np.searchsorted(np.sort(by_one["z"]), by_one["s"], "right")
    place[cls == 2] += np.searchsorted(np.sort(by_two["z"]), by_two["s"], "right")
    own = np.empty(len(zero), np.int64)
    own[_order(by_one["z"])] = np.arange(len(zero))
    place[cls == 0] = own + np.searchsorted(np.sort(by_one["s"]), by_one["z"]) + np.searchsorted(np.sort(by_two["s"]), by_two["z"])
    return places[_order(place)]


def lowest(data: np.ndarray, size: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece of every place, and the least id of all pieces in which its next ``width`` bytes start; pieces of ``size`` bytes lie in a row."""
    n, first = size - width + 1, np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), n)
    places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(of))
    order = suffix_order(data, places, width)
    h = Spans(data).hash(order, order + width)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    number = np.zeros(len(data), np.int64)
    number[places] = np.arange(len(places))
    at = number[order]
    low = np.minimum.reduceat(least[of[at]], np.flatnonzero(new))
    out = np.empty(len(places), np.int64)
    out[at] = low[np.cumsum(new) - 1]
    return of, out


def _shares(fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each suffix array's pieces begin: about ``SORTED_BYTES`` of text, a fingerprint is never split; and the end."""
    begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    share = (np.cumsum(size) - size)[begin] // SORTED_BYTES
    return np.append(begin[np.concatenate([[True], share[1:] != share[:-1]])], len(fp))


def lows_of(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    """``_lows`` of rows sorted by fingerprint and piece, of whole fingerprints."""
    t = pa.Table.from_batches(held)
    fp, pid, least = (t.column(i).to_numpy() for i in (2, 3, 4))
    greatest = pc.coalesce(t.column(5), t.column(4)).to_numpy()
    new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (pid[1:] != pid[:-1])])
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(least, begin)
    raw = t.column(6).take(pa.array(begin)).combine_chunks()
    size = pc.binary_length(raw).to_numpy().astype(np.int64)
    data, ends = np.frombuffer(b"".join(raw.to_pylist()), np.uint8), np.append(0, np.cumsum(size))
    cuts = _shares(fp[begin], size)
    parts = [lowest(data[ends[a] : ends[b]], size[a:b], least[a:b], width) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    low = np.concatenate([p[1] for p in parts])
    n = size - width + 1
    first = np.cumsum(n) - n
    smallest = np.minimum.reduceat(low, first)
    # Places in a row with one value are a run; back to the rows: each block with a piece is told its runs.
    run = np.concatenate([[True], low[1:] != low[:-1]])
    run[first] = True
    runs = np.flatnonzero(run)
    length, value = np.diff(runs, append=len(low)).astype(np.uint8), low[runs]
    first = np.searchsorted(runs, first)
    told = np.diff(first, append=len(runs))
    of = np.cumsum(new) - 1
    rows = np.flatnonzero(smallest[of] < greatest)
    first, told = first[of[rows]], told[of[rows]]
    offsets = np.append(0, np.cumsum(told))
    which = np.repeat(first - offsets[:-1], told) + np.arange(offsets[-1])
    offsets = pa.array(offsets.astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(value[which]))
    lengths = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(length[which].tobytes())])
    columns = [t.column(i).take(pa.array(rows)).combine_chunks() for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, lists, lengths], names=["told", "piece", "low", "places"])


def _lows(rows: DataFrame, width: int) -> DataFrame:
    """told, piece, ``low`` and ``places`` of every piece of a block that loses a place: its places' least ids, and how many in a row have each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= ARRAY_BYTES:
                fp = batch.column(2).to_numpy()
                same = int(np.searchsorted(fp, held[-1].column(2)[-1].as_py(), "right"))
                if same < batch.num_rows:  # the fingerprint at hand ends in this batch
                    yield lows_of([*held, batch.slice(0, same)], width)
                    held, size, batch = [], 0, batch.slice(same)
            held.append(batch)
            size += batch.column(6).nbytes
        if held:
            yield lows_of(held, width)

    return rows.select("block", "at", "fp", "pid", "least", "greatest", "bytes").mapInArrow(work, "told bigint, piece int, low array<bigint>, places binary")


def joined(spans: np.ndarray) -> np.ndarray:
    """The maximal runs of spans, each start * 2**32 + end, sorted."""
    if not len(spans):
        return spans
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 2**32 - 1)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new] << 32 | end[np.append(new[1:], True)]


def _spans(places: pa.Table, lows: pa.Table, width: int) -> pa.Table:
    """so, sh and ``spans`` of the texts of one block that lose bytes."""
    out = [[], [], []]
    for r in places.to_pylist() if lows.num_rows else []:
        low = lows.column("low").combine_chunks()
        piece, told, values = lows.column("piece").to_numpy(), pc.list_value_length(low).to_numpy(), low.flatten().to_numpy()
        length = np.frombuffer(b"".join(lows.column("places").to_pylist()), np.uint8).astype(np.int64)
        of, start = np.frombuffer(r["of"], np.uint32), np.frombuffer(r["starts"], np.int32).astype(np.int64)
        counts = np.array(r["counts"])
        runs, begin = np.zeros(int(of.max()) + 1, np.int64), np.zeros(int(of.max()) + 1, np.int64)
        runs[piece], begin[piece] = told, np.cumsum(told) - told
        ahead = np.cumsum(length) - length
        # A span for each place of a piece and run of it.
        times = runs[of]
        at = np.repeat(begin[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        text = np.repeat(np.repeat(np.arange(len(counts)), counts), times)
        gone = values[at] < np.array(r["ords"])[text]
        a = (np.repeat(start, times) + ahead[at] - np.repeat(ahead[begin[of]], times))[gone]
        spans, text = a << 32 | a + length[at[gone]] + (width - 1), text[gone]
        which, first = np.unique(text, return_index=True)
        for i, s in zip(which.tolist(), np.split(spans, first[1:]), strict=True):
            for column, x in zip(out, (r["ords"][i], r["ths"][i], joined(s)), strict=True):
                column.append(x)
    types = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["so", "sh", "spans"])


def repeated_spans(docs: DataFrame, width: int, key: str, text: str, scratch: Scratch) -> DataFrame:
    """so, sh and ``spans``, the byte ranges to remove as start * 2**32 + end, of every row that loses bytes."""
    rows = _keyed(docs, key, text)
    ranges = 1 + int(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // RANGE_BYTES
    sent = scratch.save(_sent(rows, width, ranges), "sent")
    hits = scratch.save(_hits(sent), "hits")
    scratch.drop("sent")
    near = rows.join(hits, (F.col("ord") == F.col("ho")) & (F.col("th") == F.col("hh")))
    found = scratch.save(_found(near, width), "found", compression="zstd")
    scratch.drop("hits")
    shown = found.filter("at >= 0").select("block", "at", "fp", "pid", "least", "greatest", "bytes")
    shown = shown.repartition(ranges, "fp").sortWithinPartitions("fp", "pid")
    lows = scratch.save(_lows(shown, width), "lows", compression="zstd")
    places = found.filter("at < 0").select("block", "ords", "ths", "counts", "starts", "of")

    def told(places: pa.Table, lows: pa.Table) -> pa.Table:
        return _spans(places, lows, width)

    spans = places.groupBy("block").cogroup(lows.groupBy("told")).applyInArrow(told, "so bigint, sh bigint, spans array<bigint>")
    return spans.dropDuplicates(["so", "sh"])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = text_of(text)
    return docs.select(row_of(docs).alias("row"), F.coalesce(F.col(key), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(t).alias("th"), t.alias("t"))


_CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and what is left."""
    if not len(spans):
        return len(raw), 0, 0, raw
    spans = joined(spans)
    start, end = spans >> 32, spans & 2**32 - 1
    bounds = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(raw)]]).tolist()
    kept = [raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
    return len(raw), int((end - start).sum()), len(start), b"".join(kept)


_NONE = np.zeros(0, np.int64)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [cut(t.encode("utf-8", "surrogatepass"), _NONE if s is None else s) for t, s in zip(texts, spans, strict=True)]
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """``row``, n_bytes, n_removed, n_spans and the ``kept`` bytes of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    spans = scratch.save(repeated_spans(docs, width, key, text, scratch), "spans")
    scratch.drop("found", "lows")
    rows = _keyed(docs, key, text).join(spans, (F.col("ord") == F.col("so")) & (F.col("th") == F.col("sh")), "left")
    return rows.select("row", F.pandas_udf(_cut, _CUT)("t", "spans").alias("x")).select("row", "x.*")
