"""Suffix-array dedup of repeated 100-byte strings, by bucket-pointer refinement over sampled q-gram buckets.

Sorting every suffix of a corpus in one array would move each byte's suffix many times. Two equal 100-byte strings hold
the same least q-gram (by hash, leftmost of ties; q = 32) at the same place, so suffixes are first dealt into buckets by
that q-gram, and only suffixes of one bucket are ever compared:

1. A scan finds each text's runs: consecutive window starts with one least q-gram. A run is a row (q-gram hash, hash of
   its whole span, place). Rows alike within a batch are combined before the shuffle.
2. Tasks own q-gram hashes. A run whose whole span occurs earlier goes whole. First occurrences whose q-gram has other
   spans too are undecided.
3. Undecided spans fetch their bytes and meet by q-gram. Their suffixes start in buckets of 8 bytes, refined by sorting
   on the bucket pointers of later offsets (8, 16, 32, then 36 bytes on), pointers updated in one pass being used in
   the next; a bucket of one is done. After 100 bytes a bucket is a repeated string, and all but its first place go.
4. A bucket of more than HOT undecided spans is refined before it is met: it falls into two by where the q-gram stands in
   a window, and each of these by the bytes that all such windows have around it, and so on while it holds more than
   HOT. Of a bucket's equal spans only the first is carried on, and the others go whole. At the last such step a bucket's
   windows are one string, so that one is left.

Each step is exact up to 128 bits of hash; nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, by_bytes, mapped, sized, texts

LENGTH, Q = 100, 32
SPAN = LENGTH - Q + 1  # q-grams in a window
HOT = 1024
SLICE = 2 << 20
_G = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def runs_of(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts joined in x: (text, first window, windows, place of the q-gram behind the first window, q-gram hash)."""
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    h = _G[x]
    p = np.uint64(0x9E3779B97F4A7C15 | 1)
    m = 1
    with np.errstate(over="ignore"):
        while m < Q:
            h = h[:-m] * p + h[m:]
            p = p * p
            m *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= SPAN:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    least = np.minimum(least[: len(least) - (SPAN - m)], least[SPAN - m :])
    at = (least & _LOW).astype(np.int64)
    whole = ends - starts >= LENGTH
    texts_ = np.flatnonzero(whole)
    if not len(texts_):
        return none, none, none, none, none.astype(np.uint64)
    begins, stops = starts[whole], ends[whole] - LENGTH + 1
    inside = np.zeros(len(at) + 1, np.int8)
    inside[begins] += 1
    np.add.at(inside, stops, -1)
    fresh = np.r_[True, at[1:] != at[:-1]]
    fresh[begins] = True
    lo = np.flatnonzero(fresh & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    own = np.searchsorted(begins, lo, "right") - 1
    hi = np.minimum(np.r_[lo[1:], len(at)], stops[own])
    return texts_[own], lo, hi - lo, at[lo] - lo, h[at[lo]]


def _rows(docs: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """(q-gram, span, doc, packed place) of all runs of these texts."""
    from xxhash import xxh3_64_intdigest

    out = []
    for a, b in by_bytes(docs, SLICE):
        parts = [(docs[a:b], 0)]
        if b - a == 1 and len(docs[a]) > SLICE:
            d = docs[a]
            parts = [([d[i : i + SLICE + LENGTH - 1]], i) for i in range(0, len(d), SLICE)]
        for own, shift in parts:
            joined = b"".join(own)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            text, lo, n, off, gram = runs_of(np.frombuffer(joined, np.uint8), starts, ends)
            span = np.fromiter((xxh3_64_intdigest(joined[i:j]) for i, j in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(lo))
            place = lo - starts[text] + shift
            out.append((gram.view(np.int64), span.view(np.int64), ids[a + text], place << 20 | off << 12 | n << 4))
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


RUN, GONE, OPEN = 0, 1, 2  # a run to be judged; a span that occurs earlier; an undecided one
_RUNS = "gram long, span long, doc_id long, packed long"


def _first(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _batch(cols: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in names.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        gram, span, doc, packed = _rows(texts(b), b.column("doc_id").to_numpy())
        order = np.lexsort((packed, doc, span, gram))
        gram, span, doc, packed = gram[order], span[order], doc[order], packed[order]
        first = _first(gram, span)
        # Copies within the batch are settled here; of a q-gram with several spans, all are undecided, and one marker tells the others.
        heads = np.flatnonzero(_first(gram))
        group = np.cumsum(_first(gram)) - 1
        several = np.add.reduceat(first.astype(np.int64), heads)[group] > 1 if len(heads) else np.zeros(0, bool)
        kind = np.where(first, np.where(several, OPEN, RUN), GONE)
        marks = gram[heads[several[heads]]] if len(heads) else gram
        zero = np.zeros(len(marks), np.int64)
        yield _batch([np.r_[gram, marks], np.r_[span, zero], np.r_[doc, zero], np.r_[packed | kind, zero]], _RUNS)


_FOUND = "kind int, doc_id long, packed long, gram long"


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], key: str, least: int = 0) -> Iterator[list]:
    """Columns of complete key groups, from rows sorted by key; at least so many rows at once."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(c) for c in names]
        now = [pa.concat_arrays([x, y]) for x, y in zip(held, now, strict=True)] if held else now
        keys = now[names.index(key)].to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        end = int(change[-1]) + 1 if len(change) and len(keys) >= least else 0
        if end:
            yield [x.slice(0, end) for x in now]
        held = [x.slice(end) for x in now]
    if held and len(held[0]):
        yield held


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _whole_groups(batches, ["gram", "span", "doc_id", "packed"], "gram"):
        gram, span, doc, packed = (c.to_numpy() for c in cols)
        kind = packed & 15
        out = kind.copy()
        own = np.flatnonzero(kind == RUN)
        if len(own):
            g, s, n = gram[own], span[own], packed[own] >> 4 & 255
            mark = n == 0
            group = np.cumsum(_first(g)) - 1
            heads = np.flatnonzero(_first(g))
            first = _first(g, s, mark)
            spans = np.add.reduceat((first & ~mark).astype(np.int64), heads) + 2 * np.add.reduceat(mark.astype(np.int64), heads)
            out[own] = np.where(mark, -1, np.where(~first, GONE, np.where(spans[group] > 1, OPEN, RUN)))
        stay = out > 0
        yield _batch([out[stay].astype(np.int32), doc[stay], packed[stay], gram[stay]], _FOUND)


def refine(group: np.ndarray, spans: list[bytes], anchor: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (span, offset) whose LENGTH bytes occur more than once at one place of a group, with their bucket."""
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    x = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    n = len(x) - 8
    own = np.repeat(np.arange(len(spans)), sizes)
    t = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[own] - t  # bytes up to the span's end
    gram = np.zeros(n, np.uint64)
    for k in range(8):
        gram = gram << np.uint64(8) | x[k : k + n]
    place = group[own] << 9 | (t - anchor[own] + 256)
    order = np.lexsort((gram, place))
    pointer = np.empty(n, np.int64)
    pointer[order] = np.cumsum(_first(place[order], gram[order]))
    top, depth = int(pointer.max(initial=0)) + 1, 8
    live = np.flatnonzero(left >= 8)
    for step in (8, 16, 32, LENGTH - 64):
        live = live[np.bincount(pointer[live], minlength=top)[pointer[live]] > 1]  # a bucket of one needs no more
        depth = depth + step
        live = live[left[live] >= depth]
        if depth == LENGTH:
            live = live[t[live] < windows[own[live]]]
        if not len(live):
            break
        _, dense = np.unique(pointer[live] << 31 | pointer[live + step], return_inverse=True)
        base = top
        # A bucket that was one before keeps its pointer; refined ones get new pointers above all old ones.
        pointer[live] = base + dense
        top = base + int(dense.max()) + 1
    if len(live):
        live = live[np.bincount(pointer[live], minlength=top)[pointer[live]] > 1]
    return own[live], t[live], pointer[live]


_SPANS = "doc_id long, begin long, end long"


def _runs_to_spans(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Windows as spans: neighbours joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.ones(len(doc), bool)
    if len(doc):
        fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
    heads = np.flatnonzero(fresh)
    return [doc[heads], start[heads], start[np.r_[heads[1:], len(doc)] - 1][: len(heads)] + LENGTH if len(doc) else start]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for gram, doc, packed, raw in _whole_groups(batches, ["gram", "doc_id", "packed", "bytes"], "gram", 8192):
        gram, doc, packed = (c.to_numpy() for c in (gram, doc, packed))
        group = np.cumsum(_first(gram)) - 1
        for a in _lots(group, 16384):
            g, d, k = group[a], doc[a], packed[a]
            own, t, bucket = refine(g - g[0], raw.slice(a.start, a.stop - a.start).to_pylist(), k >> 12 & 255, k >> 4 & 255)
            start = (k >> 20)[own] + t
            order = np.lexsort((start, d[own], bucket))
            gone = order[~_first(bucket[order])]
            yield _batch(_runs_to_spans(d[own][gone], start[gone]), _SPANS)


def _lots(group: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of whole groups, of about `most` rows."""
    heads = np.r_[np.flatnonzero(_first(group)), len(group)]
    begin = 0
    for h, nxt in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if nxt - begin > most and h > begin:
            yield slice(begin, h)
            begin = h
    if begin < len(group):
        yield slice(begin, len(group))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([z.compress(x) for x in texts(b)], pa.binary())], ["doc_id", "z"])


def _open(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text) as (doc_id, z) joined with spans (doc_id, list): compressed texts are shuffled, as spans grow with the corpus."""
    return mapped(docs, _squeeze, "doc_id long, z binary").join(spans.hint("shuffle_merge"), "doc_id", how)


def _raw(b: pa.RecordBatch) -> Iterator[bytes]:
    """One text at a time: a batch is bounded by its compressed bytes."""
    return map(_open, b.column("z").to_pylist())


#: lo and hi: how many bytes at least and at most stand before the q-gram in a window of this bucket.
_OPENED = "gram long, lo int, hi int, doc_id long, packed long, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, raw, own in zip(b.column("doc_id").to_pylist(), _raw(b), b.column("list").to_pylist(), strict=True):
            for r in own:
                lo = r["packed"] >> 20
                out.append((r["gram"], 0, LENGTH - Q, doc, r["packed"], raw[lo : lo + (r["packed"] >> 4 & 255) + LENGTH - 1]))
            if len(out) >= 50_000:
                yield _opened(out)
                out = []
        yield _opened(out)


def _opened(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OPENED.split(", ")])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of buckets as spans of the two buckets that each falls into: windows with few, and with many, bytes before the q-gram.

    A bucket is named by its parent and by the bytes that all its windows have, whatever else a span has. Spans made
    together that are alike are settled here, before the shuffle.
    """
    from xxhash import xxh3_64_intdigest

    out: list[tuple] = []
    for b in batches:
        for gram, lo, hi, doc, packed, raw in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
            place, off, n, middle = packed >> 20, packed >> 12 & 255, packed >> 4 & 255, (lo + hi) // 2
            for low, high in ((lo, middle), (middle + 1, hi)):
                begin, end = max(0, off - high), min(n - 1, off - low)
                if begin <= end:
                    name = xxh3_64_intdigest(b"%d %d %d " % (gram, low, high) + raw[off - low : off - high + LENGTH])
                    out.append((name - (name >> 63 << 64), low, high, doc, place + begin << 20 | off - begin << 12 | end - begin + 1 << 4, raw[begin : end + LENGTH]))
            if len(out) >= 20_000:
                yield _opened(_settled(sorted(out, key=_IN_ORDER)))
                out = []
    yield _opened(_settled(sorted(out, key=_IN_ORDER)))


_IN_ORDER = itemgetter(0, 5, 3, 4)  # bucket, bytes, place


def _settled(rows: Iterable[tuple], last: tuple = ()) -> list[tuple]:
    """Rows in order, behind one with the bucket and bytes of `last`: of those alike, all but the first are GONE and need their bytes no more."""
    out = []
    for gram, lo, hi, doc, packed, raw in rows:
        alike = last == (gram, raw)
        last = gram, raw
        out.append((gram, lo, hi, doc, packed | GONE, b"") if alike else (gram, lo, hi, doc, packed, raw))
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans, of which those are GONE that come earlier in their bucket."""
    last: tuple = ()
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True))
        if rows:
            yield _opened(_settled(rows, last))
            last = rows[-1][0], rows[-1][5]


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, begin, end): stored spans, perhaps overlapping, that hold exactly the bytes to go. docs: doc_id (unique, not null), text."""
    runs = mapped(docs, _scan, _RUNS)
    dealt = runs.repartition(F.when(F.col("packed").bitwiseAND(15) == RUN, F.col("gram")).otherwise(F.xxhash64("doc_id", "packed")))
    found = scratch.save(mapped(dealt.sortWithinPartitions("gram", "span", "doc_id", "packed"), _judge, _FOUND), "found")
    begin = F.shiftright("packed", 20)
    places = begin.alias("begin"), (begin + F.shiftright("packed", 4).bitwiseAND(255) + LENGTH - 1).alias("end")
    gone = found.filter(F.col("kind") == GONE).select("doc_id", *places)
    still = found.filter(F.col("kind") == OPEN).select("doc_id", "packed", "gram")
    lists = scratch.save(still.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "packed")).alias("list")), "open")
    rows = mapped(with_spans(docs, lists, "inner"), _fetch, _OPENED)
    hot, cool, turn, is_gone = _hot(still, scratch, 0), [], 0, F.col("packed").bitwiseAND(15) == GONE
    # After so many turns every bucket is one string, of which one span is left.
    while turn < (LENGTH - Q).bit_length() and not hot.isEmpty():
        rows, turn, hot = rows if turn else scratch.save(rows, "opened"), turn + 1, sized(hot)
        cool.append(rows.join(hot, "gram", "left_anti"))
        rows = rows.join(hot, "gram", "left_semi").select(*(x.split()[0] for x in _OPENED.split(", ")))
        halves = mapped(rows, _halves, _OPENED).repartition(F.when(is_gone, F.xxhash64("doc_id", "packed")).otherwise(F.xxhash64("gram", "bytes")))
        halves = scratch.save(mapped(halves.sortWithinPartitions("gram", "bytes", "doc_id", "packed"), _alike, _OPENED), f"halves-{turn}")
        gone = gone.unionByName(halves.filter(is_gone).select("doc_id", *places))
        rows = halves.filter(~is_gone)
        hot = _hot(rows, scratch, turn)
    cool.append(rows)
    compared = reduce(DataFrame.unionByName, (x.select("gram", "doc_id", "packed", "bytes") for x in cool))
    met = mapped(compared.repartition("gram").sortWithinPartitions("gram"), _compare, _SPANS)
    return gone.unionByName(scratch.save(met, "met"))


def _hot(rows: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    return scratch.save(rows.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram"), f"hot-{turn}")


def merge(own: list) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["begin"], r["end"]) for r in own):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        lists = [[{"begin": x, "end": y} for x, y in merge(own) if y - x >= least] for own in b.column("list").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lists, kind)], ["doc_id", "list"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(docs: DataFrame, spans: DataFrame, scratch: Scratch, least: int = 1) -> DataFrame:
    """RESULT of docs (doc_id, text) without the bytes in spans (doc_id, begin, end); joined spans under `least` bytes stay."""
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("list"))
    lists = scratch.save(mapped(grouped, lambda batches: _merged(batches, least), "doc_id long, list array<struct<begin: long, end: long>>"), "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, own in zip(_raw(b), b.column("list").to_pylist(), strict=True):
                digest, at, gone = hashlib.sha256(), 0, 0
                for r in own or ():
                    digest.update(raw[at : r["begin"]])
                    at = r["end"]
                    gone += r["end"] - r["begin"]
                digest.update(raw[at:])
                rows.append((len(raw), gone, len(own or ()), digest.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return mapped(with_spans(docs, lists, "left"), run, RESULT)


def unique_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(all rows, rows that take part) as (doc_id, text), and whether ids repeat: of rows that repeat a doc_id, one with the least text takes part; none without doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    again = known.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return rows, known, False
    return rows, known.groupBy("doc_id").agg(F.min("text").alias("text")), True


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    Each byte goes that a 100-byte string covers which also starts earlier: in a smaller doc_id, or before in the same
    document. Null texts are empty. Rows without doc_id have no place in the order and stay whole. Of rows that repeat a
    doc_id, the one with the least text takes part, and others give its result if their text is the same, else stay
    whole. Texts under 100 bytes lose nothing. An empty table gives no rows. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    rows, own, again = unique_ids(docs)
    return restored(rows, own, again, cut_out(own, repeated_spans(own, scratch), scratch), scratch)


def restored(rows: DataFrame, own: DataFrame, again: bool, result: DataFrame, scratch: Scratch) -> DataFrame:
    """result for every row: rows that took no part are whole."""
    size = F.octet_length("text").cast("long")
    whole = lambda x: x.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
    lost = whole(rows.filter(F.col("doc_id").isNull()))
    if not again:
        return result.unionByName(lost)
    held = scratch.save(result.join(own.select("doc_id", F.sha2(F.col("text"), 256).alias("sha")), "doc_id"), "result")
    known = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2(F.col("text"), 256).alias("sha"))
    same = known.select("doc_id", "sha").join(held, ["doc_id", "sha"]).select(*result.columns)
    other = whole(known.join(held, ["doc_id", "sha"], "left_anti"))
    return same.unionByName(other).unionByName(lost)
