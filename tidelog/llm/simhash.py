"""SimHash near-dedup: exact links between fingerprints within a Hamming radius, by bit-sliced comparison.

Fingerprints are cut into `blocks`; two within the radius agree on at least blocks - radius of them, so each pair meets
in some bucket keyed by `agree` <= blocks - radius whole blocks. Within buckets, bit planes lie vertically, small buckets
side by side: one word holds one bit of 64 fingerprints. Distances grow in carry-save counters, and words whose 64
distances all exceed the radius are abandoned. A bucket gives a spanning forest of its links, never all pairs, which
keeps every component. Buckets over TILE are dealt out as pairs of tiles, so no task holds more than two tiles, and no
link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, by_bytes, mapped, sized, texts
from tidelog.llm.components import components

#: Fingerprints of one bucket that are compared in one task at most, twice.
TILE = 8192
#: Lanes, of 64 distances each, that are held at once.
LANES = 1 << 17
#: Bytes of buckets that are held at once, or those of one.
HELD = 16 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(docs: list[bytes], words: int, more: int = 0, once: bool = False) -> np.ndarray:
    """(texts, 1 + more): a bit is 1 if set in over half of the shingles' XXH64; no word: zero. once: a shingle that repeats counts once.

    Further words do so with numbers mixed from those hashes, a tie being settled by the least hash: else texts of two
    shingles would have few bits set and be alike.
    """
    out = np.zeros((len(docs), 1 + more), np.uint64)
    for k, text in enumerate(docs):
        counts, least, n, seen = np.zeros((1 + more, 64), np.int64), _ALL, 0, []
        for h in shingle_hashes(text, words):
            if once:
                seen.append(h)
                continue
            counts, least, n = _counted(h, counts), min(least, h.min()), n + len(h)
        if once and seen:
            h = np.unique(np.concatenate(seen))
            counts, least, n = _counted(h, counts), h[0], len(h)
        if not n:
            continue
        for j in range(1, 1 + more):
            counts[j] += (2 * counts[j] == n) & (_bit_counts(mixed(np.array([least]), j)) > 0)
        out[k] = np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, at most 65,536 at once; of fewer words, the whole is one shingle; of none, there is none."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not own:
        return
    whole = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words - 1 :].tolist() if len(own) >= words else [len(whole)]
    for i in range(0, len(last), 65536):
        yield np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[i : i + 65536], last[i : i + 65536], strict=False)], np.uint64)


def _counted(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    for j in range(len(counts)):
        counts[j] += _bit_counts(mixed(h, j) if j else h)
    return counts


def mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th number drawn from each hash, by SplitMix64's finisher."""
    z = h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    bits = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, prints: np.ndarray, word: np.ndarray, query: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Lanes (word, query, alive) in which something is left: bits of `alive` stay where the query is within the radius.

    planes: (64 k, words) of the k columns of prints. Each lane adds one bit of 64 distances at a time.
    """
    wide = radius.bit_length()
    limit = [radius + 1 >> i & 1 for i in range(wide + 1)]
    counters = np.zeros((wide + 1, len(word)), np.uint64)
    for bit in range(len(planes)):
        carry = planes[bit][word] ^ (np.uint64(0) - (prints[query, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)))
        for c in counters[:-1]:
            both = c & carry
            c ^= carry
            carry = both
        counters[-1] |= carry
        if bit % 4 == 3:
            # Over the radius: the counter reached radius + 1, compared from its highest bit; what reached it stays there.
            over, equal = np.zeros_like(alive), np.full_like(alive, _ALL)
            for i in range(wide, -1, -1):
                if limit[i]:
                    equal &= counters[i]
                else:
                    over |= equal & counters[i]
            alive = alive & ~(over | equal)
            stay = alive != 0
            if not stay.all():
                word, query, alive, counters = word[stay], query[stay], alive[stay], np.ascontiguousarray(counters[:, stay])
                if not len(word):
                    break
    return word, query, alive


Confirm = Callable[[np.ndarray, np.ndarray], np.ndarray]


def forest(prints: np.ndarray, sizes: np.ndarray, radius: int, wide: int = 0, confirm: Confirm | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join, within each bucket of so many rows, what the radius joins: from each row but the first of what it is joined with, to that one.

    prints: (rows, columns), buckets one behind the other. The first column is compared with radius; where there are
    more, all with `wide` as well. confirm: says of pairs within them which are links; asked of rows not yet joined only.
    """
    row = np.arange(len(prints))
    stop = np.repeat(np.cumsum(sizes), sizes)  # its bucket's end
    total = -(-len(prints) // 64)
    laid = np.zeros((64 * total, prints.shape[1]), np.uint64)
    laid[: len(prints)] = prints
    columns = [planes_of(laid[:, j]) for j in range(prints.shape[1])]
    planes, every = columns[0], np.concatenate(columns)
    # Each row against the rows behind it in its bucket: the words that hold them.
    first = row + 1 >> 6
    lanes = np.where(row + 1 < stop, (stop - 1 >> 6) - first + 1, 0)
    label = row.copy()
    steps = np.cumsum(lanes)
    begin = 0
    while begin < len(prints):
        end = max(begin + 1, int(np.searchsorted(steps, (steps[begin - 1] if begin else 0) + LANES, "right")))
        own = lanes[begin:end]
        query = np.repeat(row[begin:end], own)
        word = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(own) - own, own)
        low = np.maximum(query + 1 - 64 * word, 0).astype(np.uint64)
        high = np.minimum(stop[query] - 64 * word, 64).astype(np.uint64)
        word, query, alive = within(planes, prints, word, query, _ALL << low & _ALL >> np.uint64(64) - high, radius)
        if len(columns) > 1 and len(word):
            word, query, alive = within(every, prints, word, query, alive, wide)
        for i in range(0, len(word), 1 << 14):  # at most 64 pairs a lane
            bits = np.unpackbits(np.ascontiguousarray(alive[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lane, bit = np.nonzero(bits)
            _join(label, query[i + lane], 64 * word[i + lane] + bit, confirm)
        begin = end
    moved = np.flatnonzero(label != row)
    return moved, label[moved]


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray, confirm: Confirm | None) -> None:
    """Joins pairs in label, or those that are confirmed: one of each x first, then two, four, for what is not yet joined."""
    if confirm is None:
        return _hook(label, x, y)
    take = 1
    while True:
        differ = label[x] != label[y]
        x, y = x[differ], y[differ]
        if not len(x):
            return None
        heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        now = np.arange(len(x)) - np.repeat(heads, np.diff(np.r_[heads, len(x)])) < take
        sure = confirm(x[now], y[now])
        _hook(label, x[now][sure], y[now][sure])
        x, y, take = x[~now], y[~now], 2 * take


def _hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins x and y in label: each row's root, the first of what it is joined with."""
    while len(x):
        u, v = label[x], label[y]
        differ = u != v
        x, y, u, v = x[differ], y[differ], u[differ], v[differ]
        if not len(x):
            return
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(label, high, low)  # roots only: a root's label is itself or now a smaller root
        while True:  # to the roots again
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str], least: int = 1 << 16) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """(columns, sizes) of complete buckets of several rows, from rows sorted by the first two columns (key, lot); about `least` rows, or HELD bytes, at once."""
    held: list[list[pa.Array]] = []
    rows = size = 0
    for batch in batches:
        held.append([batch.column(c) for c in names])
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= least or size > HELD and rows:
            columns, sizes, held = _cut(held, False)
            rows = sum(len(x[0]) for x in held)
            size = 0
            if len(sizes):
                yield columns, sizes
    if rows:
        columns, sizes, _ = _cut(held, True)
        if len(sizes):
            yield columns, sizes


def _cut(held: list[list[pa.Array]], last: bool) -> tuple[list[pa.Array], np.ndarray, list]:
    """What is complete of the rows held, without buckets of one; the sizes of its buckets; and the rest."""
    now = [pa.concat_arrays(x) for x in zip(*held, strict=True)]
    key, lot = now[0].to_numpy(), now[1].to_numpy()
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lot[1:] != lot[:-1])])
    end = len(key) if last else int(heads[-1])  # the last bucket may go on
    sizes = np.diff(np.r_[heads, len(key)])[: len(heads) - (not last)]
    keep = np.flatnonzero(np.repeat(sizes > 1, sizes))
    return [x.slice(0, end).take(pa.array(keep)) for x in now], sizes[sizes > 1], [[x.slice(end) for x in now]] if end < len(key) else []


def dealt(rows: DataFrame, tiles: DataFrame, row: str) -> DataFrame:
    """rows (key, ...) with lot, sorted by both: keys in tiles (key, tiles) are dealt out as pairs of tiles, by the hash of column `row`."""
    if tiles.isEmpty():
        out = rows.withColumn("lot", F.lit(0).cast("long"))
    else:
        tagged = rows.join(sized(tiles), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.expr(f"pmod(xxhash64({row}), tiles)"))
        lots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.least(F.col("tile"), j) * F.col("tiles") + F.greatest(F.col("tile"), j))
        out = tagged.withColumn("lot", F.explode(lots)).drop("tiles", "tile")
    return out.repartition("key", "lot").sortWithinPartitions("key", "lot")


def as_prints(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([x.to_numpy().view(np.uint64) for x in columns], 1)


def bucket_links(reps: DataFrame, keys: list[Column], scratch: Scratch, radius: int, wide: int = 0) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of the links of reps (print, further words print1.., rep): pairs that share one of `keys` and are within the radius."""
    columns = [c for c in reps.columns if c.startswith("print")]
    sizes = reps.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    big = scratch.save(sizes.filter(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).cast("long").alias("tiles")), "big")
    rows = dealt(reps.select(F.explode(F.array(*keys)).alias("key"), *columns, "rep"), big, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, sizes in whole_buckets(batches, ["key", "lot", *columns, "rep"]):
            rep = found[-1].to_numpy()
            a, b = forest(as_prints(found[2:-1]), sizes, radius, wide)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return mapped(rows, run, "a long, b long").distinct()


def near_links(reps: DataFrame, scratch: Scratch, radius: int, blocks: int, agree: int) -> DataFrame:
    """(a, b): links of reps (print, rep) with distinct fingerprints that join what the radius joins."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, own in enumerate(combinations(range(blocks), agree)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in own)
        keys.append(F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(mask - (mask >> 63 << 64)))))
    return bucket_links(reps, keys, scratch, radius)


def stored_prints(docs: DataFrame, scratch: Scratch, words: int, more: int = 0, once: bool = False) -> tuple[DataFrame, list[str]]:
    """(doc_id, print, print1..) of each row, as a stored table, and the names of its print columns."""
    columns = ["print", *(f"print{j}" for j in range(1, more + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts(b)
            parts = [fingerprints(t[x:y], words, more, once) for x, y in by_bytes(t, 4 << 20)]
            made = np.concatenate([np.zeros((0, 1 + more), np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, np.ascontiguousarray(made.T))], ["doc_id", *columns])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *columns))
    return scratch.save(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema), "prints"), columns


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, agree: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null, empty and all-white texts have fingerprint zero and link like any other. Texts of fewer words than a shingle
    are one shingle. Rows that repeat, and texts that tie on a fingerprint, stay rows of one component. component_id is
    the smallest doc_id reachable; a row with a null doc_id takes its fingerprint's component, and only null ones among
    themselves have none. A very long text is hashed in parts of 65,536 shingles. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    prints, _ = stored_prints(docs, scratch, words)
    reps = scratch.save(prints.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(near_links(reps, scratch, radius, blocks, agree), scratch)
    labels = reps.join(found, reps["rep"] == found["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    # A fingerprint may be a third of all rows: a left join lets Spark split them.
    out = prints.join(labels.hint("shuffle_merge"), "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
