"""Near duplicates by their words' shingles: SimHash finds candidates, an exact Jaccard similarity decides.

1. Fingerprints of 192 bits: 64 of the distinct shingles' hashes and 128 of numbers mixed from them.
2. Fingerprints meet in buckets of some of their bits, and bit-sliced comparison keeps pairs within a loose radius. A
   bucket's bits grow with the logarithm of the documents, so that buckets don't, and so does, slowly, how many buckets a
   fingerprint is in, so that a pair at `similarity` is missed as seldom at any size.
3. Components of those pairs hold whatever may be alike. Within them, each text's set of shingle hashes is fetched once,
   equal sets become one, and pairs within the radius are links if their sets' Jaccard similarity is `similarity` or
   more. Pairs that are already joined by other links aren't asked, so a group of copies takes as many comparisons as it
   has texts. Components over a tile are dealt out as pairs of tiles.
4. Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, mapped, sized, texts
from tidelog.llm.components import components
from tidelog.llm.simhash import as_prints, bucket_links, dealt, forest, shingle_hashes, stored_prints, whole_buckets

WORDS, SIMILARITY = 5, 0.8
#: Further words of 64 bits in a fingerprint.
MORE = 2
#: Of five-word shingles, a similarity of 0.8 is a cosine of about 0.89: 10 of 64 and 29 of 192 differing bits are expected,
#: 12 and 36 of texts of a few words, give or take 3 and 6; 96 of texts that share nothing, give or take 7.
RADIUS, WIDE = 22, 52
#: Fingerprints that a bucket holds at most if all are unlike, and the bits of a bucket at least.
FULL, LEAST_BITS = 1024, 11
#: So many differing bits of 192 are missed by all buckets with a probability of MISSED at most.
APART, MISSED = 32, 0.02
#: Rows and bytes of hashes of a component's tile.
TILE_ROWS, TILE_BYTES = 2048, 8 << 20


def bucket_bits(n: int) -> list[list[int]]:
    """Of n fingerprints, the bits that key each bucket."""
    size = 64 * (1 + MORE)
    bits = max(LEAST_BITS, ceil(log2(max(1, n) / FULL)))
    times = ceil(log(MISSED) / log(1 - (1 - APART / size) ** bits))
    r = np.random.default_rng(5)
    return [sorted(r.choice(size, bits, replace=False).tolist()) for _ in range(times)]


def bucket_keys(columns: list[str], n: int) -> list[Column]:
    out = []
    for t, own in enumerate(bucket_bits(n)):
        masks = [sum(1 << b % 64 for b in own if b // 64 == j) for j in range(len(columns))]
        out.append(F.xxhash64(F.lit(t), *(F.col(c).bitwiseAND(F.lit(m - (m >> 63 << 64))) for c, m in zip(columns, masks, strict=True))))
    return out


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have that Jaccard similarity; two empty ones have."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (few + many - shared)


_SETS = "key long, doc_id long, d1 long, d2 long, n long, hashes binary"


def stored_sets(docs: DataFrame, asked: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """_SETS of the documents in asked (doc_id, key), as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sets = [shingle_set(t, words).astype("<u8").tobytes() for t in texts(b)]
            digests = np.frombuffer(b"".join(map(xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
            cols = [b.column("key"), b.column("doc_id"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _SETS.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(asked), "doc_id").select("key", "doc_id", "text")
    return scratch.save(mapped(own, run, _SETS), "sets")


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy: component_id is the smallest doc_id of the group.

    Texts are near copies if their sets of word shingles, in lower case (A-Z), have that Jaccard similarity; groups are
    what such links join. Texts without a word equal each other; texts of fewer words than a shingle are one. Very long
    texts are hashed whole. Rows with a null doc_id have no part. Rows that repeat a doc_id count as one document.
    Candidates are estimates: see APART for what is missed. Only doc_id and text are read. Some stages are run, and
    their tables stored, before this returns.
    """
    scratch = Scratch(docs.sparkSession)
    prints, columns = stored_prints(docs.filter(F.col("doc_id").isNotNull()), scratch, words, MORE, once=True)
    reps = scratch.save(prints.groupBy(*columns).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    loose = components(bucket_links(reps.drop("n"), bucket_keys(columns, reps.count()), scratch, RADIUS, WIDE), scratch, "loose")
    # Of a fingerprint, or of linked ones: what may have a near copy.
    labels = reps.join(loose, reps["rep"] == loose["node"], "left").filter("component is not null or n > 1").select(*columns, F.coalesce("component", "rep").alias("key"))
    asked = scratch.save(prints.join(labels.hint("shuffle_merge"), columns, "left").filter("key is not null").select("doc_id", "key", *columns), "asked")
    sets = stored_sets(docs, asked.select("doc_id", "key").distinct(), scratch, words)
    firsts = scratch.save(sets.groupBy("key", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "firsts")
    copies = sets.select("key", "d1", "d2", F.col("doc_id").alias("a")).join(firsts.withColumnRenamed("doc_id", "b"), ["key", "d1", "d2"]).filter("a <> b").select("a", "b")
    size = F.greatest(F.count("*") / TILE_ROWS, F.sum(8 * F.col("n")) / TILE_BYTES)
    sizes = firsts.groupBy("key").agg(F.count("*").alias("rows"), F.ceil(size).cast("long").alias("tiles"))
    tiles = scratch.save(sizes.filter("rows > 1 and tiles > 1").select("key", "tiles"), "tiles")
    several = sizes.filter("rows > 1").select("key")
    ones = sets.join(sized(firsts.join(several, "key", "left_semi").select("doc_id", "d1", "d2")), ["doc_id", "d1", "d2"], "left_semi").select("key", "doc_id", "hashes")
    own = asked.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("p")).select("doc_id", *(F.col(f"p.{c}").alias(c) for c in columns))
    rows = dealt(ones.join(sized(own), "doc_id"), tiles, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, counts in whole_buckets(batches, ["key", "lot", *columns, "doc_id", "hashes"], 2 * TILE_ROWS):
            doc, raw = found[-2].to_numpy(), found[-1]
            own = [np.frombuffer(x.as_buffer(), "<u8") for x in raw]
            confirm = lambda x, y: np.fromiter((alike(own[i], own[j], similarity) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))  # noqa: E731, B023
            a, b = forest(as_prints(found[2:-2]), counts, RADIUS, WIDE, confirm)
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b])], ["a", "b"])

    links = scratch.save(mapped(rows, run, "a long, b long").unionByName(copies), "links")
    return components(links, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns as they are. Rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    mine = f"__{scratch.root[-8:]}"
    gone = scratch.save(near_groups(docs, words, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias(mine)).distinct(), "gone")
    return docs.join(sized(gone), docs["doc_id"] == gone[mine], "left_anti")
