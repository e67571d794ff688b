"""Exact dedup over an extendible-hash index kept in shared files. DataFrame functions only.

1. One scan gives an entry per row: 64-bit key of the normalised text, its SHA-256, lengths, doc_id.
2. The directory is a table of cells, key prefixes of the global depth. It begins at about the depth that the number of
   keys asks for, and doubles where a bucket is overfull: a cell's bucket is its shortest prefix that holds no more than
   `capacity` keys. It stays on the executors, at whatever size.
3. Entries are written to the pages of their buckets, several where one key alone overfills its bucket, and pages to the
   files of their owners: tasks that read them again without a shuffle.
4. Owners chain the equal keys of their pages, tell the links apart by SHA-256 and length, and answer. Of a chain that
   goes on over several pages, what its pages know is put together, a row a page and link, and joined back.
5. Texts of links with several rows are compared byte by byte: least and greatest text of a link, combined before the
   shuffle, must be the same.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import Scratch, sized

#: Keys a bucket holds before it splits; a page holds PAGE times as many entries.
CAPACITY, PAGE = 4096, 4
#: Doublings of the directory, at most, beyond what evenly spread keys ask for.
DOUBLINGS = 8
#: Entries that an owner reads, where they are many.
OWNED = 1_000_000
#: Rows of an entry that come again at once.
LOT = 10_000
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def directory(cells: DataFrame, low: int, high: int, capacity: int = CAPACITY) -> DataFrame:
    """(cell, bucket, depth) of cells (cell, n): key prefixes of `high` bits and how many keys have them.

    A bucket begins as a prefix of `low` bits and doubles by its next bit while it holds more than capacity, up to `high`.
    """
    spread = cells.select("cell", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"cast(shiftright(cell, {high} - depth) as bigint)"))
    loads = spread.groupBy("depth", "prefix").agg(F.sum("n").alias("load")).filter((F.col("load") <= capacity) | (F.col("depth") == high))
    own = spread.join(loads, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return own.select("cell", F.expr(f"shiftleft(shiftright(cell, {high} - depth), {high} - depth)").alias("bucket"), "depth")


def entries_of(docs: DataFrame) -> DataFrame:
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "n_chars", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("n_bytes"))


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The index as a stored table: an entry for each distinct (doc_id, text), with how many rows it stands for."""
    spark = docs.sparkSession
    entries = scratch.save(entries_of(docs).groupBy("key", "sha", "n_bytes", "doc_id", "n_chars").agg(F.count("*").alias("rows")), "entries")
    keys = scratch.save(entries.select("key").distinct(), "keys")
    low = max(0, floor(log2(max(1, keys.count()) / capacity)) - 1)
    high = min(low + DOUBLINGS, 60)
    cell = F.shiftrightunsigned("key", 64 - high)
    cells = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    tagged = entries.withColumn("cell", cell).join(sized(scratch.save(directory(cells, low, high, capacity), "directory")), "cell").drop("cell", "depth")
    sizes = scratch.save(tagged.groupBy("bucket").agg(F.ceil(F.count("*") / (PAGE * capacity)).cast("long").alias("pages")), "buckets")
    paged = tagged.join(sized(sizes), "bucket").withColumn("page", F.expr("pmod(xxhash64(doc_id), pages)"))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(entries.count() // OWNED, 100_000))
    return scratch.save_owned(paged, "index", ["bucket", "page"], owners, "key")


def compare_bytes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(sha, same) of the links with a key in keys (key), from their texts; copies are combined before the shuffle."""
    norm = docs.select(normalised(F.col("text")).alias("norm")).select("norm", F.xxhash64("norm").alias("key"))
    held = norm.join(sized(keys), "key", "left_semi")
    return held.groupBy(F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.min("norm").alias("least"), F.max("norm").alias("most")).select("sha", (F.col("least") == F.col("most")).alias("same"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Null texts count as empty and so equal each other, empty and all-white texts. Of rows that repeat a doc_id and
    text, one is kept. A null doc_id comes after all others and keep_id is null only where a group has no other. Two
    texts with one SHA-256 but other bytes stop the run: dropping one would be wrong. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    index = build_index(docs, scratch, capacity)
    several = scratch.save(chained(index).filter("pages > 1 or group_size > 1").select("key").distinct(), "several")
    if not compare_bytes(docs, several).filter("not same").isEmpty():
        raise ValueError("two texts share a SHA-256")
    return answered(index, scratch)


LINK = ["bucket", "key", "sha", "n_bytes"]


def _first() -> Column:
    """The least is the row that stays."""
    return F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id")


def chained(index: DataFrame) -> DataFrame:
    """(LINK, page, pages, group_size, first): what an owner's pages know of each link."""
    return index.groupBy("page", "pages", *LINK).agg(F.sum("rows").alias("group_size"), F.min(_first()).alias("first"))


def answered(index: DataFrame, scratch: Scratch) -> DataFrame:
    """The result's rows: of buckets of one page from the index alone, of others with what all pages know."""
    link = Window.partitionBy("page", *LINK)
    alone = index.filter("pages = 1").withColumn("group_size", F.sum("rows").over(link)).withColumn("first", F.min(_first()).over(link))
    out = alone.select(*LINK, "doc_id", "n_chars", "rows", "group_size", "first")
    paged = index.filter("pages > 1")
    if not paged.isEmpty():
        joined = scratch.save(chained(paged).groupBy(*LINK).agg(F.sum("group_size").alias("group_size"), F.min("first").alias("first")), "joined")
        out = out.unionByName(paged.join(sized(joined), LINK).select(*out.columns))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (-F.col("n_chars") == F.col("first.fewer"))
    flat = out.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", stays.alias("stays"), F.lower(F.hex("sha")).alias("text_sha256"), "rows")
    # An entry's rows come again in lots, so that no array grows with them.
    lots = flat.withColumn("lot", F.explode(F.expr(f"sequence(0L, (rows - 1) div {LOT})")))
    each = lots.withColumn("copy", F.explode(F.expr(f"sequence(1, cast(least({LOT}L, rows - lot * {LOT}) as int))")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("lot") == 0) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; columns as they are. Of rows that repeat the kept one's id and text, one stays: the longest."""
    scratch = Scratch(docs.sparkSession)
    mine = f"__{scratch.root[-8:]}"
    found = scratch.save(exact_dedup(docs), "found")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("every")).filter("not every")
    by_id = scratch.save(by_id.select(F.col("doc_id").alias(mine), "some"), "by_id")
    if by_id.filter(F.col("some") | F.col(mine).isNull()).isEmpty():  # all rows of an id stay, or all go
        return docs.join(sized(by_id.select(mine)), docs["doc_id"] == F.col(mine), "left_anti")
    goes = found.filter("not kept").select("doc_id", "text_sha256").distinct()
    keyed = docs.withColumn(mine, F.sha2(normalised(F.col("text")), 256))
    gone = goes.select(F.col("doc_id").alias(f"{mine}_id"), F.col("text_sha256").alias(f"{mine}_sha"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{mine}_id")) & (F.col(mine) == F.col(f"{mine}_sha"))
    out = keyed.join(sized(gone), same, "left_anti")
    # Rows that repeat the kept one's id and text were all taken out: one of them comes back.
    stays = found.filter("kept").select("doc_id", "text_sha256")
    back = stays.join(sized(gone), stays["doc_id"].eqNullSafe(gone[f"{mine}_id"]) & (stays["text_sha256"] == gone[f"{mine}_sha"]), "left_semi").select(F.col("doc_id").alias(f"{mine}_id"), F.col("text_sha256").alias(f"{mine}_sha"))
    rows = keyed.join(sized(back), same, "left_semi").withColumn(f"{mine}_n", -F.length("text"))
    first = rows.withColumn(f"{mine}_k", F.row_number().over(Window.partitionBy("doc_id", mine).orderBy(f"{mine}_n"))).filter(f"{mine}_k = 1")
    return out.unionByName(first.drop(f"{mine}_n", f"{mine}_k")).drop(mine)
