"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has a byte context tree of orders 0 to ORDER with frozen counts. A text's exact code length under each
tree, in bits, decides: the shortest wins. Trees are fitted on the driver from a bounded sample of labelled documents,
merged into tables of (context + symbol) -> bits for every language, and broadcast; all documents are scored whole, in
Arrow batches, without a shuffle.

The sample: of the MOST_LANGS languages with the most documents, up to PER_LANG documents each, none over MOST_BYTES,
and SAMPLE_BYTES divided by the square of the number of languages. The model holds a number for each gram and language,
so that bounds the driver's memory whatever labels there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import by_bytes, joined, mapped, texts

ORDER = 3
PER_LANG = 400
MOST_BYTES = 65_536
MOST_LANGS, SAMPLE_BYTES = 128, 64 << 20
FOLDS = 5
#: Bits of a byte without any model.
NO_MODEL = 8.0
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Table:
    """Open addressing from 64-bit codes to row numbers."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(8, int(4 * max(1, len(codes))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(codes)), self.slot(codes)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = codes[todo[free]]  # of several for one slot the last stays
            self.rows[at[free]] = todo[free]
            lost = self.keys[at] != codes[todo]
            todo, at = todo[lost], (at[lost] + 1) & (len(self.keys) - 1)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        at = self.slot(codes)
        got = self.keys[at]
        out = np.where(got == codes, self.rows[at], -1)
        todo = np.flatnonzero((got != codes) & (got != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            got = self.keys[at]
            hit = got == codes[todo]
            out[todo[hit]] = self.rows[at[hit]]
            stay = ~hit & (got != -1)
            todo, at = todo[stay], at[stay]
        return out


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """At each position, the bytes up to it, `width` of them, as a number; the first positions are short."""
    x = np.zeros(len(data), np.int64)
    for k in range(width):
        x[k:] |= data[: len(data) - k].astype(np.int64) << 8 * k
    return x


class Model:
    """What languages' trees give: for each width, the grams some language has seen, with bits for every language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        grams = []
        for lang in self.langs:
            data, starts, ends = joined(samples[lang], ORDER)
            inside = np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            where = np.flatnonzero(np.cumsum(inside[:-1]))
            lowered = _LOWER[data]
            grams.append([np.unique(_codes(lowered, w)[where], return_counts=True) for w in range(1, ORDER + 2)])
        n = len(self.langs)
        self.tables, self.bits, self.contexts, self.escapes = [], [], [], []
        below = np.full((1, n), 8.0)  # every byte alike
        below_find = lambda c: np.zeros(len(c), np.int64)
        for w in range(1, ORDER + 2):
            codes = np.unique(np.concatenate([g[w - 1][0] for g in grams])) if n else np.zeros(0, np.int64)
            heads = np.unique(codes >> 8)
            counts, total, kinds = np.zeros((len(codes), n)), np.zeros((len(heads), n)), np.zeros((len(heads), n))
            for k, g in enumerate(grams):
                own, many = g[w - 1]
                counts[np.searchsorted(codes, own), k] = many
                head = np.searchsorted(heads, own >> 8)
                np.add.at(total[:, k], head, many)
                np.add.at(kinds[:, k], head, 1)
            whole = np.maximum(total + kinds, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
            at = np.searchsorted(heads, codes >> 8)
            lower = below[below_find(codes & ((1 << 8 * (w - 1)) - 1))]
            bits = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / whole[at]), escape[at] + lower)
            self.tables.append(Table(codes))
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(Table(heads))
            self.escapes.append(escape.astype(np.float32))
            below, below_find = bits, lambda c, codes=codes: np.searchsorted(codes, c)

    def lengths(self, docs: list[bytes]) -> np.ndarray:
        """(texts, languages): code lengths in bits."""
        out = np.zeros((len(docs), len(self.langs)))
        if not self.langs:
            return out
        data, starts, ends = joined(docs, ORDER)
        data = _LOWER[data]
        for a in range(0, len(data), 1 << 18):  # bounded arrays, however long a text is
            b = min(len(data), a + (1 << 18))
            x = data[max(0, a - ORDER) : b]
            cost = self._bits(x)[a - max(0, a - ORDER) :]
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
            lo, hi = np.clip(starts[first:last] - a, 0, b - a), np.clip(ends[first:last] - a, 0, b - a)
            sums = np.vstack([np.zeros((1, cost.shape[1])), np.cumsum(cost, 0, dtype=np.float64)])
            out[first:last] += sums[hi] - sums[lo]
        return out

    def _bits(self, data: np.ndarray) -> np.ndarray:
        width = ORDER + 1
        codes = _codes(data, width)
        row = self.tables[-1].find(codes)
        out = self.bits[-1][np.maximum(row, 0)]
        todo = np.flatnonzero(row < 0)
        if len(todo):
            out[todo] = 0
        while len(todo):
            own = codes[todo] & ((1 << 8 * width) - 1)
            head = self.contexts[width - 1].find(own >> 8)
            out[todo] += np.where(head[:, None] >= 0, self.escapes[width - 1][np.maximum(head, 0)], 0)
            width -= 1
            if not width:
                out[todo] += 8
                break
            row = self.tables[width - 1].find(own & ((1 << 8 * width) - 1))
            hit = row >= 0
            out[todo[hit]] += self.bits[width - 1][row[hit]]
            todo = todo[~hit]
        return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, most_bytes: int = MOST_BYTES, sample_bytes: int = SAMPLE_BYTES, most_langs: int = MOST_LANGS) -> Model:
    """From labelled documents outside the held-out fold: per language, those with the smallest hashed ids."""
    size = F.octet_length("text").cast("long")
    keys = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (size <= most_bytes)).select("doc_id", F.col("lang").alias("label"), F.xxhash64("doc_id").alias("order"), size.alias("size"))
    counted = keys.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_langs).collect()  # at most most_langs rows
    if not counted:
        return Model({})
    # A hashed id below a language's limit is one of about four times as many as are wanted: only those are sorted.
    limits = [(r["label"], int(min(1.0, (4 * per_lang + 64) / r["n"]) * (1 << 62) * 2 - (1 << 63)) if r["n"] > 4 * per_lang + 64 else (1 << 63) - 1) for r in counted]
    few = keys.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "label string, limit long")), "label").filter(F.col("order") <= F.col("limit")).select("label", "doc_id", "order", "size").distinct()
    before = Window.partitionBy("label").orderBy("order", "doc_id", "size")
    taken = few.withColumn("k", F.row_number().over(before)).filter(F.col("k") <= per_lang).withColumn("bytes", F.sum("size").over(before))
    ids = taken.filter((F.col("k") == 1) | (F.col("bytes") <= sample_bytes // len(counted) ** 2)).select("doc_id", "label").distinct()
    held = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").filter((F.col("lang") == F.col("label")) & (size <= most_bytes))
    rows = held.groupBy("label", "doc_id").agg(F.min("text").alias("text")).collect()  # bounded as said above, however often a row repeats
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["doc_id"])):
        samples.setdefault(r["label"], []).append((r["text"] or "").encode())
    return Model(samples)


def classify(docs: DataFrame, model: Model, keep: list[str], pred: str = "lang_pred", score: str = "score", rate: str = "bits") -> DataFrame:
    """The columns `keep` of docs with a prediction, its score, and its code length in bits a byte. und, with score 0: the text is null, has no letter, or no language was learned."""
    spark = docs.sparkSession
    mine = "text" if "text" in keep else f"__{uuid.uuid4().hex}"
    held = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(pred, "string").add(score, "double").add(rate, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            t = texts(b, mine)
            preds, scores, rates = [], [], []
            for x, y in by_bytes(t, 1 << 20):
                bits = model.lengths(t[x:y])
                for d, own in zip(t[x:y], bits, strict=True):
                    if not model.langs or not any(map(str.isalpha, d.decode())):
                        preds.append("und")
                        scores.append(0.0)
                        rates.append(NO_MODEL)
                        continue
                    k = int(own.argmin())
                    preds.append(model.langs[k])
                    rates.append(float(own[k] / len(d)))
                    # The odds as if the text's mean evidence were that of at most 64 bytes.
                    scores.append(float(1 / np.exp2(-(own - own[k]) * min(1, 64 / len(d))).sum()))
            cols = [c for c in b.schema.names if c in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*cols, pred, score, rate])

    return mapped(docs.select(*keep, *([] if mine == "text" else [F.col("text").alias(mine)])), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learned from docs itself.

    lang, source and doc_id decide only what is learned from; none is an input of a prediction. Rows without doc_id or
    lang are predicted, not learned from. Repeated rows give repeated results; ties between languages go to the first
    by name. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    flagged = own.select("doc_id", held_out().alias("held_out"), "text")
    return classify(flagged, fit(own), ["doc_id", "held_out"]).drop("bits")


def keep_known(docs: DataFrame, most: float = NO_MODEL) -> DataFrame:
    """docs in a learned language; columns as they are. Languages are learned from docs itself, as by identify.

    Without those of no prediction (und), and without those whose code is `most` bits a byte or longer under every
    learned language: by default, those of which the best model knows no more than none. Null and empty texts go.
    """
    mine = f"__{uuid.uuid4().hex}"
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = classify(docs, fit(known), docs.columns, f"{mine}_pred", f"{mine}_score", f"{mine}_bits")
    return out.filter((F.col(f"{mine}_pred") != "und") & (F.col(f"{mine}_bits") < most)).select(*docs.columns)
