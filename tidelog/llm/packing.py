"""Best-fit packing by minimum bin slack over the histogram of lengths.

Pieces of a length are alike, so the plan needs only how many there are of each length: at most `capacity` numbers,
whatever the corpus. Per bin, a bitset subset-sum over the lengths left finds the fullest combination around the longest
piece; the combination is taken as often as the counts allow. Pieces then get a rank within their length and look up
their place in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import PieceCache, Scratch, by_bytes, cut, give_back, mapped, texts

_caches: dict[tuple[str, bool], PieceCache] = {}
#: Texts whose words are told apart at once; arrays of several times as many bytes are made of them.
SLICE_BYTES = 1 << 20


#: A run of letters, then a run of marks: what the vocabulary's pre-tokeniser makes of such a word is these two parts, the
#: letters in lower case. Letters are those of Latin scripts that composition and lower-casing leave single.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: Lines that are no plain word, and the place between a plain word's two parts.
_OTHER = re.compile(f"^(?![{_LETTERS}]*[{_MARKS}]*$).*$", re.M)
_BETWEEN = re.compile(f"(?<=[{_LETTERS}])(?=[{_MARKS}])")
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_SHOW = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_BYTES))}
#: How a tokenizer file of this kind normalises and splits. White space ends every token of it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _ids(found: list) -> list[bytes]:
    return [np.array(x.ids, "<u4").tobytes() for x in found]


class Merges:
    """The vocabulary's merges over bytes, many words to a call, by tiktoken's merge loop.

    A part's last symbol is marked by a zero byte, merged first of all. That loop merges by the merged text's rank, where
    the vocabulary names pairs. Both agree where every token, taken alone, comes out of its own merges as one token: what
    lies between two boundaries merges as it does alone, so no other pair with that text ever stands there. `sound`
    checks this for all tokens.
    """

    def __init__(self, tokenizer: str):
        import tiktoken

        model = _file(tokenizer)["model"]
        back = {c: bytes([b]) for b, c in _SHOW.items()}
        raw = lambda t: b"".join(map(back.__getitem__, t.removesuffix("</w>"))) + b"\0" * t.endswith("</w>")
        made = [*(_SHOW[b] + "</w>" for b in range(256)), *(x + y for x, y in _pairs(model))]
        single = [_SHOW[b] for b in range(256)]
        names = [*made, *single]
        ranks = {raw(t): k for k, t in enumerate(made)} | {bytes([b]): len(made) + b for b in range(256)}
        self.id_of = np.array([model["vocab"][t] for t in names], "<u4")
        self.ends = np.array([t.endswith("</w>") for t in names])
        self.coder = tiktoken.Encoding("merges", pat_str="[^ \n]+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, words: list[str]) -> list[bytes]:
        """Each plain word's ids. A thousand words are one text: parts end with a zero byte, words with a line end."""
        out = []
        for a in range(0, len(words), 4000):
            text = _BETWEEN.sub("\0 ", "\n".join(words[a : a + 4000]).lower()).replace("\n", "\0\n") + "\0\n"
            found = np.array(self.coder.encode_ordinary(text), np.int64)
            raw = np.frombuffer(text.encode(), np.uint8)
            parts = np.cumsum(raw == 0)[raw == 10]  # parts up to each word's end
            stops = (4 * (np.flatnonzero(self.ends[found])[parts - 1] + 1)).tolist()
            ids = self.id_of[found].tobytes()
            out += [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        return out


def _file(tokenizer: str) -> dict:
    import json

    with open(tokenizer, encoding="utf-8") as f:
        return json.load(f)


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]


@lru_cache
def by_words(tokenizer: str) -> bool:
    """Whether texts may be cut at white space: the file normalises and splits as _NORMALIZER and _SPLIT say, and nothing else does."""
    d = _file(tokenizer)
    return (d["normalizer"], d["pre_tokenizer"], d["post_processor"], d["truncation"], d["padding"]) == (_NORMALIZER, _SPLIT, None, None, None) and all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not re.search(r"\s", x["content"]) for x in d["added_tokens"])


@lru_cache
def sound(tokenizer: str) -> bool:
    """Whether plain words may go through Merges: every token of the vocabulary, taken alone, is one token."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    model = _file(tokenizer)["model"]
    if not by_words(tokenizer) or model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges"):
        return False
    merges = _pairs(model)
    made = [x + y for x, y in merges]
    last, inner = (Tokenizer(BPE(vocab=model["vocab"], merges=merges, **({"end_of_word_suffix": "</w>"} if s else {}))) for s in (True, False))
    one = lambda tk, texts, names: all(x.ids == [model["vocab"][n]] for x, n in zip(tk.encode_batch(texts), names, strict=True))
    tails, others = [t for t in made if t.endswith("</w>")], [t for t in made if not t.endswith("</w>")]
    return len(set(made)) == len(made) and one(last, [t.removesuffix("</w>") for t in tails], tails) and one(inner, others, others)


def _library(tokenizer: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def _cache(tokenizer: str, plain: bool) -> PieceCache:
    """plain: words of letters and marks go through Merges, which `sound` allows; all others, and else all, through the library."""
    if (tokenizer, plain) not in _caches:
        tk = _library(tokenizer)
        merges = Merges(tokenizer) if plain else None
        whole = lambda words: _ids(tk.encode_batch_fast(words, add_special_tokens=False))

        def encode(raw: list[bytes]) -> list[bytes]:
            lines = b"\n".join(raw).decode()
            words = lines.split("\n")
            if merges is None:
                return whole(words)
            others = _OTHER.findall(lines)
            if not others:
                return merges(words)
            apart = dict(zip(others, whole(others), strict=True))
            ids = iter(merges([w for w in words if w not in apart]))
            return [apart[w] if w in apart else next(ids) for w in words]

        _caches[tokenizer, plain] = PieceCache(encode, 16 << 20, 200_000)
        give_back()  # what was read of the file
    return _caches[tokenizer, plain]


def _after_space(text: bytes, i: int) -> int:
    found = [j for c in (b" ", b"\n", b"\t") if (j := text.find(c, i, i + (1 << 20))) >= 0]
    return min(found) if found else -1


def encode_ids(docs: list[bytes], tokenizer: str, words: bool, plain: bool) -> Iterator[Iterator[bytes]]:
    """For each text, its ids as little-endian 32-bit numbers, in one or more parts.

    words: as by_words says, texts are cut at white space and words encoded alone; else whole. plain: as `sound` says.
    """
    if not words:
        tk = _library(tokenizer)
        for d in docs:
            yield iter(_ids([tk.encode(d.decode(), add_special_tokens=False)]))
        return
    cache = _cache(tokenizer, plain)
    for a, b in by_bytes(docs, SLICE_BYTES):
        if b - a == 1 and len(docs[a]) > SLICE_BYTES:
            yield (part for s in cut(docs[a], _after_space, SLICE_BYTES) for part in _slice_ids([s], cache))
        else:
            yield from map(iter, zip(_slice_ids(docs[a:b], cache)))


def _slice_ids(docs: list[bytes], cache: PieceCache) -> Iterator[bytes]:
    """Each text's ids: words are split, told apart and put together in arrays, so that Python sees each distinct one once."""
    split = pc.ascii_split_whitespace(pa.array(docs, pa.large_binary()).cast(pa.large_string()))
    words = split.values.dictionary_encode()
    own = words.dictionary.cast(pa.large_binary()).to_pylist()
    get = cache([[w for w in own if w]])
    ids = [get(w) if w else b"" for w in own]
    flat, many = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    word = words.indices.to_numpy()
    n = many[word]
    ends = np.cumsum(n)
    found = flat[np.arange(n.sum()) + np.repeat((np.cumsum(many) - many)[word] - ends + n, n)].tobytes()
    stops = (4 * np.r_[0, ends][split.offsets.to_numpy()]).tolist()
    return (found[i:j] for i, j in zip(stops[:-1], stops[1:], strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids with end_id behind them."""
    words, plain = by_words(tokenizer), sound(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, end = 4 * capacity, np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, parts in zip(b.column("doc_id").to_pylist(), encode_ids(texts(b), tokenizer, words, plain), strict=True):
                held, piece = bytearray(), 0
                for part in parts:
                    held += part
                    while len(held) > size:
                        rows.append((doc, piece, piece * capacity, capacity, zlib.crc32(held[:size])))
                        del held[:size]
                        piece += 1
                held += end
                for i in range(0, len(held), size):
                    x = held[i : i + size]
                    rows.append((doc, piece, piece * capacity, len(x) // 4, zlib.crc32(x)))
                    piece += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", keep=True)


def fullest(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of (length, count), longest first, the combination with the largest sum up to room: length to how many."""
    bits, mask, steps = 1, (1 << room + 1) - 1, []
    for length, count in lengths:
        left, part = min(count, room // length), 1
        while left:
            take = min(part, left)
            new = (bits | bits << take * length) & mask
            if new != bits:
                steps.append((length, take, bits))
                bits = new
            left -= take
            part *= 2
        if bits >> room & 1:
            break
    total, out = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= take * length
    return out


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, how many a bin, first bin, offset in the bin), sorted by length and rank."""
    left, used, rows, bins = dict(sorted(counts.items(), reverse=True)), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = next(iter(left))
        rest = [(n, c - (n == longest)) for n, c in left.items() if n <= capacity - longest and c > (n == longest)]
        took = fullest(rest, capacity - longest) if rest else {}
        took[longest] = took.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in took.items()), 0
        for n, k in sorted(took.items(), reverse=True):
            rows.append((n, used[n], k, bins, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += k * n
            if not left[n]:
                del left[n]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a stored table) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    packed = plan(counts, capacity)
    keys = packed[:, 0] << 48 | packed[:, 1] if len(packed) else np.zeros(0, np.int64)
    held = spark.sparkContext.broadcast((keys, packed))  # at most some hundred thousand rows: lengths in a bin sum to capacity
    # A length's c pieces are ranked in about sqrt(c) salted groups of about sqrt(c): neither groups nor pieces of one gather.
    salts = F.broadcast(spark.createDataFrame([(n, 1 + isqrt(c)) for n, c in counts.items()], "length long, salts long"))
    salted = pieces.join(salts, "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), salts)")).drop("salts")
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.join(base.hint("shuffle_merge"), ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, packed = held.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = packed[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            i = rank - at[:, 1]
            k = at[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 3] + i // k), pa.array(at[:, 4] + i % k * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    cols = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return mapped(cols, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's pieces with their place in as few sequences of at most `capacity` tokens as the plan finds.

    Null and empty texts are one piece of the end id. Repeated rows are packed each; a null doc_id stays null. An empty
    table gives no rows. Ties among pieces of a length are broken by doc_id and piece, which changes no figure.
    """
    spark = docs.sparkSession
    return place(spark, Scratch(spark).save(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
