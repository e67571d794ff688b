"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SLICE_BYTES, PieceCache, by_bytes, mapped, texts

_MARK = "▁".encode()
#: A space after something that isn't itself white: no piece of the vocabulary holds a mark behind another character.
_SAFE = re.compile(rb"(?<=[^ ])(?<!\xe2\x96\x81) ")
_caches: dict[str, PieceCache] = {}


def _cache(model: str) -> PieceCache:
    if model not in _caches:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("this vocabulary has pieces across word starts; texts have no safe boundary")
        _caches[model] = PieceCache(lambda x: [len(i) if p else 1 for p, i in zip(x, sp.encode([p.decode() for p in x], num_threads=1), strict=True)])
    return _caches[model]


def split_words(text: bytes) -> list[bytes]:
    """Parts that are encoded alone: the space at each cut becomes the mark that the library puts before a part."""
    if text.startswith(b" ") or b"  " in text or _MARK in text:
        return _SAFE.split(text)
    return text.split(b" ")


def _slices(text: bytes) -> Iterator[bytes]:
    """Of a long text, cut at safe spaces, which are left out."""
    begin = 0
    while len(text) - begin > SLICE_BYTES and (m := _SAFE.search(text, begin + SLICE_BYTES)):
        yield text[begin : m.start()]
        begin = m.end()
    yield text[begin:]


def count_texts(docs: list[bytes], model: str) -> list[int]:
    cache, out = _cache(model), []
    for a, b in by_bytes(docs, SLICE_BYTES):
        if b - a == 1 and len(docs[a]) > SLICE_BYTES:
            total = 0
            for s in _slices(docs[a]):
                words = split_words(s) if s else [b""]
                total += sum(map(cache([words]), words))
            out.append(total)
            continue
        words = [split_words(d) if d else [] for d in docs[a:b]]
        get = cache(words)
        out += [sum(map(get, w)) for w in words]
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; nothing is shuffled.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results; a null id stays null. Texts over
    4 MB are encoded in slices cut at safe spaces, so that memory is bounded by the longest stretch without one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts(b)
            n = count_texts(t, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, t), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keep=True)
