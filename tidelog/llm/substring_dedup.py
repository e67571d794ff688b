"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the 16 bytes before has four zero bits, so chunks of a repeated passage are the same
whatever stands before it. Chunks are dealt by 128-bit digest; of each, the first place in (doc_id, place) order stays.
Chunks alike within a batch are settled before the shuffle, so a chunk that all documents share reaches a task once a
batch. Runs of chunks repeated from one place are extended byte by byte to both sides, as far as the bytes there are the
same as beside that earlier place: a passage seldom begins and ends where chunks do. Those of `least` bytes or more join
with neighbouring repeated chunks into spans; spans of `least` bytes or more go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, by_bytes, mapped, texts
from tidelog.llm.suffix_dedup import _batch, _first, _raw, _whole_groups, cut_out, restored, unique_ids, with_spans

WIDTH, ZEROS, NEAREST, MOST = 16, 4, 16, 256
#: Shorter repeated spans stay: a phrase isn't a passage.
LEAST = 100
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256).astype(np.uint16)
#: Bytes on each side of a run that are compared first; runs alike over all of them are compared again, over REACH times as many.
SIDE, REACH = WIDTH + NEAREST + MOST, 16
_ROWS = "d1 long, d2 long, doc_id long, packed long, s_doc long, s_at long"


def cuts(x: np.ndarray) -> np.ndarray:
    """Ends of natural chunks in one or more joined texts: positions behind a hash with ZEROS leading zero bits, none within NEAREST of one before."""
    h, m = _GEAR[x], 1
    while m < WIDTH:
        h[m:] = h[m:] + (h[:-m] << np.uint16(m))
        m *= 2
    at = np.flatnonzero(h < 1 << 16 - ZEROS) + 1
    at = at[at >= WIDTH]
    return at[np.r_[True, np.diff(at) >= NEAREST]] if len(at) else at


def chunks(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, size) of every chunk, in order. A text's own bytes decide its chunks."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found = cuts(np.frombuffer(b"".join(docs), np.uint8)) if ends[-1:].sum() else np.zeros(0, np.int64)
    own = np.searchsorted(ends, found, "left")
    found = found[found - starts[np.minimum(own, len(docs) - 1)] >= WIDTH + NEAREST] if len(found) else found  # hash and spacing within the text
    edges = np.unique(np.r_[found, ends[sizes > 0], starts[sizes > 0]])
    begin, end = edges[:-1], edges[1:]
    parts = -(-(end - begin) // MOST)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(begin, parts) + MOST * (np.arange(parts.sum()) - first)
    size = np.minimum(np.repeat(end, parts) - at, MOST)
    text = np.searchsorted(ends, at, "right")
    return text, at - starts[text] if len(at) else at, size


RUN, GONE = 0, 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for b in batches:
        t, ids, out = texts(b), b.column("doc_id").to_numpy(), []
        for x, y in by_bytes(t, 4 << 20):
            text, begin, size = chunks(t[x:y])
            joined = b"".join(t[x:y])
            ends = np.cumsum(size)
            made = b"".join(xxh3_128_digest(joined[i:j]) for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True))
            both = np.frombuffer(made, np.int64).reshape(-1, 2)
            out.append((both[:, 0], both[:, 1], ids[x + text], begin << 20 | size << 4))
        if not out:
            continue
        d1, d2, doc, packed = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((packed, doc, d2, d1))
        d1, d2, doc, packed = d1[order], d2[order], doc[order], packed[order]
        first = _first(d1, d2)
        head = np.maximum.accumulate(np.where(first, np.arange(len(d1)), 0))  # an earlier place within the batch
        yield _batch([d1, d2, doc, packed | np.where(first, RUN, GONE), np.where(first, 0, doc[head]), np.where(first, 0, packed[head] >> 20)], _ROWS)


_FOUND = "doc_id long, begin long, end long, s_doc long, s_begin long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _whole_groups(batches, ["d1", "d2", "doc_id", "packed", "s_doc", "s_at"], "d1"):
        d1, d2, doc, packed, s_doc, s_at = (c.to_numpy() for c in cols)
        gone, s_doc, s_at = packed & 15 == GONE, s_doc.copy(), s_at.copy()
        own = np.flatnonzero(~gone)
        first = _first(d1[own], d2[own])
        head = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        s_doc[own], s_at[own] = doc[head], packed[head] >> 20
        gone[own] = ~first
        begin = packed[gone] >> 20
        yield _batch([doc[gone], begin, begin + (packed[gone] >> 4 & 0xFFFF), s_doc[gone], s_at[gone]], _FOUND)


_EDGES = "doc_id long, begin long, end long, s_doc long, s_begin long, s_end long, before binary, behind binary"
_SOURCES = "s_doc long, s_begin long, s_end long, s_before binary, s_behind binary"
_EXTENDED = "doc_id long, begin long, end long, s_doc long, s_begin long, more boolean"


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _by_size(rows: Iterator[tuple], names: str) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += 64 + len(r[-1]) + len(r[-2])
        if held > 4 << 20:
            yield _table(out, names)
            out, held = [], 0
    yield _table(out, names)


def _edges(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Runs of chunks repeated from one place and the bytes beside them, where what is not known to be repeated is that near."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for doc, raw, own in zip(b.column("doc_id").to_pylist(), _raw(b), b.column("list"), strict=True):
                begin, end, s_doc, s_begin = (own.values.field(k).to_numpy() for k in ("begin", "end", "s_doc", "s_begin"))
                order = np.argsort(begin, kind="stable")
                reach = np.maximum.accumulate(end[order])
                heads = np.flatnonzero(np.r_[True, begin[order][1:] > reach[:-1]])
                covers, until = begin[order][heads], reach[np.r_[heads[1:] - 1, len(order) - 1]]
                shift = begin - s_begin
                order = np.lexsort((begin, shift, s_doc))
                begin, end, s_doc, shift = begin[order], end[order], s_doc[order], shift[order]
                same = (s_doc[1:] == s_doc[:-1]) & (shift[1:] == shift[:-1])
                heads = np.flatnonzero(np.r_[True, ~same | (begin[1:] != end[:-1])])
                last = np.r_[heads[1:] - 1, len(begin) - 1]
                same = same[heads[1:] - 1]
                begin, end, s_doc, shift = begin[heads], end[last], s_doc[heads], shift[heads]
                floor, roof = np.r_[0, np.where(same, end[:-1], 0)], np.r_[np.where(same, begin[1:], len(raw)), len(raw)]
                cover = np.searchsorted(covers, begin, "right") - 1
                low = np.where(begin - covers[cover] < side, np.maximum(floor, begin - side), begin)
                high = np.where(until[cover] - end < side, np.minimum(roof, end + side), end)
                for a, z, d, k, x, y in zip(*(c.tolist() for c in (begin, end, s_doc, shift, low, high)), strict=True):
                    if x < a or z < y:
                        yield doc, a, z, d, a - k, z - k, raw[x:a], raw[z:y]

    yield from _by_size(rows(), _EDGES)


def _sources(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for doc, raw, own in zip(b.column("doc_id").to_pylist(), _raw(b), b.column("list").to_pylist(), strict=True):
                for r in own:
                    a, z = r["s_begin"], r["s_end"]
                    yield doc, a, z, raw[max(0, a - side) : a], raw[z : z + side]

    yield from _by_size(rows(), _SOURCES)


def alike(a: bytes, b: bytes, back: bool = False) -> int:
    """How many bytes are the same, from the begin or back from the end."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (a[-n:], b[-n:]) if back else (a[:n], b[:n])
    if x == y:
        return n
    other = np.flatnonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))
    return int(n - 1 - other[-1] if back else other[0])


def _extend(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, begin, end, s_doc, s_begin, before, behind, s_before, s_behind in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
            x, y = alike(before, s_before, True), alike(behind, s_behind)
            rows.append((doc, begin - x, end + y, s_doc, s_begin - x, side in (x, y)))
        yield _table(rows, _EXTENDED)


def extended(docs: DataFrame, found: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(doc_id, begin, end) of found's runs of chunks, with the bytes beside them that are the same as beside their earlier place; `least` bytes or more."""
    runs, side, out = found, SIDE, None
    while True:
        lists = runs.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "s_doc", "s_begin")).alias("list"))
        edges = scratch.save(mapped(with_spans(docs, lists, "inner"), lambda batches, n=side: _edges(batches, n), _EDGES), f"edges{side}")
        asked = edges.select(F.col("s_doc").alias("doc_id"), "s_begin", "s_end").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("s_begin", "s_end")).alias("list"))
        sources = scratch.save(mapped(with_spans(docs, asked, "inner"), lambda batches, n=side: _sources(batches, n), _SOURCES), f"sources{side}")
        key = ["s_doc", "s_begin", "s_end"]
        met = edges.join(sources.hint("shuffle_merge"), key).select("doc_id", "begin", "end", "s_doc", "s_begin", "before", "behind", "s_before", "s_behind")
        made = scratch.save(mapped(met, lambda batches, n=side: _extend(batches, n), _EXTENDED), f"extended{side}")
        for name in ("edges", "sources"):
            scratch.drop(f"{name}{side}")
        spans = made.filter(F.col("end") - F.col("begin") >= least).select("doc_id", "begin", "end")
        out = spans if out is None else out.unionByName(spans)
        runs, side = made.filter("more").drop("more"), side * REACH
        if runs.isEmpty():
            return out


def repeated_chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, begin, end, s_doc, s_begin) of chunks that occur earlier, and an earlier place of each. docs: doc_id (unique, not null), text."""
    rows = mapped(docs, _scan, _ROWS)
    dealt = rows.repartition(F.when(F.col("packed").bitwiseAND(15) == RUN, F.col("d1")).otherwise(F.xxhash64("doc_id", "packed")))
    return scratch.save(mapped(dealt.sortWithinPartitions("d1", "d2", "doc_id", "packed"), _judge, _FOUND), "gone")


def repeated(docs: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(doc_id, begin, end), perhaps overlapping: repeated chunks and extended runs of them."""
    found = repeated_chunks(docs, scratch)
    return found.select("doc_id", "begin", "end").unionByName(extended(docs, found, scratch, least))


def substring_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    Of chunks with the same bytes, the first stays: the smallest doc_id, then the earliest in it. What goes beside
    chunks stands earlier too. Null texts are empty.
    Rows without doc_id stay whole; of rows that repeat a doc_id, the one with the least text takes part, and others
    give its result if their text is the same, else stay whole. An empty table gives no rows. Only doc_id and text are
    read.
    """
    scratch = Scratch(docs.sparkSession)
    rows, own, again = unique_ids(docs)
    return restored(rows, own, again, cut_out(own, repeated(own, scratch, least), scratch, least), scratch)
