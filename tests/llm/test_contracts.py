"""Each query against a brute-force version over whole small tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest
from conftest import SF
from helpers import SMALL, chunk_spans, covered, exact_groups, leaks, linked, pieces, simhash

from tidelog.llm import queries as llm


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_op1_counts_equal_the_library(spark, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows}
    assert by_id(llm.op1_token_counts(spark, SMALL), "n_bytes", "n_tokens", "over_limit") == want


def test_op2_pieces_and_places(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = llm.op2_best_fit_packing(spark, SMALL).collect()
    want = sorted((i, *p) for i, t in rows for p in pieces(t, tk, 4096))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_line_dedup"])
def test_sql(spark, same_as_sql, name):
    assert same_as_sql(llm.queries()[name](spark, SF), llm.oracle_sql()[name]) > 0


def test_op3_groups(spark, rows):
    assert by_id(llm.op3_exact_dedup(spark, SMALL), "keep_id", "group_size", "kept", "text_sha256") == exact_groups(rows)


def test_op4_fingerprints_and_components(spark, rows):
    rows = sorted(rows)
    prints = [simhash(t, 3)[0] for _, t in rows]
    root = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, root, strict=True)}
    assert by_id(llm.op4_simhash_near_dedup(spark, SMALL), "fingerprint", "component_id") == want


def test_op6_held_out_accuracy(spark):
    found = by_id(llm.op6_language_id(spark, SF), "held_out", "lang_pred", "score")
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(found) == set(docs)
    right = total = 0
    for i, (held, pred, score) in found.items():
        text, lang = docs[i]["text"], docs[i]["lang"]
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1
        assert (pred == "und") == (text is None or not any(map(str.isalpha, text)))
        if held and lang is not None and pred != "und":
            total += 1
            right += pred == lang
    assert total > 50
    assert right / total > 0.95


def test_op7_equals_every_chunk(spark, rows):
    assert by_id(llm.op7_substring_dedup(spark, SMALL), "n_bytes", "n_removed", "n_spans", "kept_sha256") == chunk_spans(rows)


def test_op8_equals_all_strings(spark, rows):
    assert by_id(llm.op8_suffix_array_dedup(spark, SMALL), "n_bytes", "n_removed", "n_spans", "kept_sha256") == covered(rows)


def test_op9_leaves_no_entity_and_keeps_them_apart(spark):
    """By plain patterns over the whole table: entities are gone, stand where they stood, and map one to one over all documents."""
    kinds = {
        "email": (r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", str.lower),
        "ip": (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", str),
        "ssn": (r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", str),
        "card": (r"(?<!\d)\d{16}(?!\d)", str),
        "secret": (r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])[0-9a-f]{32,}(?![0-9A-Za-z])", str),
    }
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in llm.op9_pii_surrogates(spark, SF).collect()}
    assert set(found) == {i for i, _ in rows}
    total = 0
    for pattern, same in kinds.values():
        there: dict = {}
        for i, text in rows:
            old, new = (re.findall(pattern, t or "") for t in (text, found[i]["text"]))
            assert len(old) == len(new)
            for a, b in zip(map(same, old), map(same, new), strict=True):
                assert a != b and there.setdefault(a, b) == b
            total += len(old)
        assert len(set(there.values())) == len(there)
    assert total > 50
    for i, text in rows:
        if text is None or not re.search(r"[0-9@]", text) and not found[i]["n_replaced"]:
            assert found[i]["text"] == text
        if text is not None:
            assert re.sub(r"\w", "w", found[i]["text"]) == re.sub(r"\w", "w", text) or "ip" in dict(found[i]["types"]) or "email" in dict(found[i]["types"])


def test_op10_equals_every_document_against_every_item(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in llm.op10_benchmark_decontamination(spark, SMALL).collect()}
    assert found
    assert found == leaks(rows, items)


def test_op10_finds_items_and_nothing_else(spark):
    """Documents that hold all of an item's words in order, and only those that share most of an item."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    items = {r["item_id"]: grams(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: grams(words(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    share = {(d, i): len(own & g) / len(g) for d, own in docs.items() for i, g in items.items() if g and own & g}
    found = {(r["doc_id"], r["item_id"]) for r in llm.op10_benchmark_decontamination(spark, SF).collect()}
    assert {k for k, v in share.items() if v == 1} <= found
    assert all(share.get(k, 0) > 0.5 for k in found)
