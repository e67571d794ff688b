"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from helpers import SMALL, awkward, chunk_spans, corpus, covered, docs_of, empty, exact_groups, leaks, linked, similar, simhash
from pyspark.sql import functions as F

from tidelog.llm import decontam, exact_dedup, langid, line_dedup, near_dedup, packing, pii, simhash as sim, substring_dedup, suffix_dedup, token_counts


def model(name):
    import public_tokenizers

    return public_tokenizers.path(name)


KEY = pii.derived_key("tests")
OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d, model("piece_bpe_32k.model")),
    "pack": lambda d: packing.pack(d, model("word_bpe_49k.json")),
    "exact_dedup": exact_dedup.exact_dedup,
    "drop_copies": exact_dedup.drop_copies,
    "simhash_groups": sim.simhash_groups,
    "one_of_each": near_dedup.one_of_each,
    "identify": langid.identify,
    "keep_known": langid.keep_known,
    "substring_dedup": substring_dedup.substring_dedup,
    "suffix_dedup": suffix_dedup.suffix_dedup,
    "surrogates": lambda d: pii.surrogates(d, KEY),
    "contaminated": lambda d: decontam.contaminated(d, d.sparkSession.read.parquet(f"{SMALL}/benchmark.parquet")),
    "drop_contaminated": lambda d: decontam.drop_contaminated(d, d.sparkSession.read.parquet(f"{SMALL}/benchmark.parquet")),
}
ROW_FOR_ROW = {"token_counts", "exact_dedup", "simhash_groups", "identify", "substring_dedup", "suffix_dedup", "surrogates"}
FILTERS = {"drop_copies", "one_of_each", "keep_known", "drop_contaminated"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    out = OPERATORS[name](empty(spark))
    assert out.collect() == []
    if name in FILTERS:
        assert out.columns == empty(spark).columns


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, name):
    docs = awkward(spark).cache()
    out = OPERATORS[name](docs)
    found = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    mine = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    if name in ROW_FOR_ROW:
        assert found == mine
    if name in FILTERS:
        assert out.columns == docs.columns
        assert not found - mine
    docs.unpersist()


def test_filters_on_awkward_rows(spark):
    docs = awkward(spark).cache()
    kept = Counter(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect())
    # 0 is null, 1 empty, 2 white, one of the two rows without id null: one of these four stays; 3 repeats; 5 copies 4.
    assert kept == Counter([2, 3, 4, 6, 7, 8, 9, None])
    known = Counter(r["doc_id"] for r in langid.keep_known(docs).collect())
    letters = Counter(r["doc_id"] for r in docs.filter(F.col("text").rlike("\\p{L}")).collect())
    assert known[4] == known[5] == 1 and not known - letters  # of a learned text's words
    near = Counter(r["doc_id"] for r in near_dedup.one_of_each(docs).collect())
    assert near[4] == 1 and near[5] == 0 and near[6] == 1 and near[None] == 4
    docs.unpersist()


def test_token_counts_of_odd_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model("piece_bpe_32k.model"))
    texts = [None, "", " ", "  a  b ", "a\nb\t\tc ", "▁a ▁ b", " ▁", "x▁y z", "</s> <s> <unk>", "ｆｕｌｌ １２", "a　b c", "é é", "a" * 3000, " lead", "trail ", "▁▁ ▁", "word  ▁  word"]
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs_of(spark, texts), model("piece_bpe_32k.model")).collect()}
    assert out == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_token_counts_of_long_texts_are_the_librarys(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model("piece_bpe_32k.model"))
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 50)
    texts = [t for t in corpus(3, 20)] + ["a  b   " * 40, "word ▁ " * 30]
    assert token_counts.count_texts([t.encode() for t in texts], model("piece_bpe_32k.model")) == [len(sp.encode(t)) for t in texts]


def test_packing_ids_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(model("word_bpe_49k.json"))
    texts = [None, "", " \n", "It's  they're I'LL O'Neil's", "x1y2 3,000.5 a_b--c", "ÉCOLE Ñandú ſtraße İstanbul", "é Å Å ﬁ", "<|endoftext|> a <|startoftext|>b", "北京 wörld…«x»", "a b　c d", "\x00 \x1c \x85 q", "'s 'T 'll x'd", "don`t #tag @you $5.00 50%", "Ⅷ ² ½ ١٢"]
    raw = [(t or "").encode() for t in texts]
    got = [b"".join(p) for p in packing.encode_ids(raw, model("word_bpe_49k.json"), True, True)]
    assert got == [b"".join(x.to_bytes(4, "little") for x in tk.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_vocabulary_is_sound():
    assert packing.by_words(model("word_bpe_49k.json")) and packing.sound(model("word_bpe_49k.json"))
    assert not packing.by_words(model("byte_bpe_50k.json")) and not packing.sound(model("byte_bpe_50k.json"))


@pytest.mark.parametrize(("name", "words", "plain"), [("word_bpe_49k.json", True, True), ("word_bpe_49k.json", True, False), ("byte_bpe_50k.json", False, False)])
def test_packing_ids_are_the_librarys(monkeypatch, name, words, plain):
    """Made-up texts of hostile characters, whole and in slices, by every way that a vocabulary may be read."""
    import random

    from tokenizers import Tokenizer

    r, tk = random.Random(21), Tokenizer.from_file(model(name))
    signs = [*"abcdeEXZ'tsdm.,!?&()-_=+[]`~|@#$%^*{}\\/<>\"0189éÉßñžŽſİıŉĸǅ̀́ ΣςσЖж北京한👍🏽½Ⅷ²١\u200b\u00ad", "'re", "'LL", "\x00", "\x1c", "\x85", "\u2028", "\u3000", "\xa0", " ", " ", "\n", "\t", "\r", "\x0b", "<|endoftext|>", "don't", "Straße", "</w>", "Ġ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["", " ", "\n a", "a \n"]
    want = [b"".join(x.to_bytes(4, "little") for x in e.ids) for e in tk.encode_batch(texts, add_special_tokens=False)]
    for size in (4 << 20, 3000, 20):
        monkeypatch.setattr(packing, "SLICE_BYTES", size)
        assert [b"".join(p) for p in packing.encode_ids([t.encode() for t in texts], model(name), words, plain)] == want


def test_packing_plan_is_full():
    counts = {4096: 3, 2048: 5, 1000: 7, 48: 30, 1: 90}
    plan = packing.plan(counts, 4096)
    rows = []
    for length, n in counts.items():
        own = [p for p in plan.tolist() if p[0] == length]
        for rank in range(n):
            _, first, k, b, offset = max((p for p in own if p[1] <= rank), key=lambda p: p[1])
            rows.append((b + (rank - first) // k, offset + (rank - first) % k * length, length))
    bins: dict = {}
    for b, offset, length in sorted(rows):
        assert offset == bins.get(b, 0)
        bins[b] = offset + length
    assert max(bins.values()) <= 4096
    assert len(bins) == -(-sum(n * c for n, c in counts.items()) // 4096)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup_of_a_corpus(spark, seed):
    texts = [None, "", " \t", *(t.replace(" ", "\n", k % 3) for k, t in enumerate(corpus(seed, 300)))]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs_of(spark, texts), capacity=8).collect()}
    assert out == exact_groups(list(enumerate(texts)))
    kept = sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs_of(spark, texts)).collect())
    assert kept == sorted(i for i, v in out.items() if v[2])


@pytest.mark.parametrize("low", [0, 2])
def test_directory_doubles_until_buckets_hold(spark, low):
    cells = {c: 10 for c in range(16)} | {7: 1000}
    found = [tuple(r) for r in exact_dedup.directory(spark.createDataFrame(list(cells.items()), "cell long, n long"), low, 4, 40).collect()]
    assert sorted(c for c, _, _ in found) == sorted(cells)
    for bucket, depth in {(b, d) for _, b, d in found}:
        own = [c for c, b, _ in found if b == bucket]
        assert depth == 4 or sum(cells[c] for c in own) <= 40
        assert depth == low or sum(n for c, n in cells.items() if c >> (5 - depth) == bucket >> (5 - depth)) > 40  # its parent was overfull
        assert {c >> (4 - depth) for c in own} == {bucket >> (4 - depth)}


def test_owners_answer_without_a_shuffle(spark):
    """Chains are made and rows are answered from the index's pages, without an exchange."""
    from tidelog.llm.common import Scratch

    docs, scratch = docs_of(spark, corpus(5, 200)), Scratch(spark)
    index = exact_dedup.build_index(docs, scratch, 8)
    for df in (exact_dedup.chained(index), exact_dedup.answered(index, scratch)):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert index.groupBy("bucket").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0] <= 8


def test_exact_dedup_of_a_hot_text_over_many_pages(spark):
    texts = ["hot text", "hot  text"] * 150 + [f"cold {i}" for i in range(20)]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs_of(spark, texts), capacity=4).collect()}
    assert out == exact_groups(list(enumerate(texts)))


def test_exact_dedup_of_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOT", 3)
    rows = [(1, "a b"), *[(2, "a  b")] * 10]
    out = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert out == sorted([(1, 2, 11, False), (2, 2, 11, True), *[(2, 2, 11, False)] * 9])


@pytest.mark.parametrize("seed", [3, 4])
def test_simhash_links_of_a_corpus(spark, seed):
    texts = [None, "", *corpus(seed, 250)]
    prints = [simhash(t, 3)[0] for t in texts]
    root = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sim.simhash_groups(docs_of(spark, texts)).collect()}
    assert out == {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, root, strict=True))}


def test_simhash_tiles_lose_no_link(spark, monkeypatch):
    """A bucket of more fingerprints than a tile holds."""
    import random

    r = random.Random(5)
    base = r.getrandbits(64)
    prints = sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)})
    monkeypatch.setattr(sim, "TILE", 40)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "print long, rep long")
    from tidelog.llm.common import Scratch
    from tidelog.llm.components import components

    scratch = Scratch(spark)
    found = {r["node"]: r["component"] for r in components(sim.near_links(reps, scratch, 2, 4, 2), scratch).collect()}
    root = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {i: found.get(i, i) for i in range(len(prints))} == dict(enumerate(root))


@pytest.mark.parametrize("seed", [1, 2])
def test_bit_planes_of_buckets_of_every_size(seed):
    """Small and large buckets side by side in the planes: what the forest joins is what all pairs join."""
    import random

    import numpy as np

    r = random.Random(seed)
    sizes = [r.choice([2, 2, 3, 5, 12, 13, 63, 64, 65, 130]) for _ in range(40)]
    prints = []
    for n in sizes:
        base = r.getrandbits(64)
        prints += [[(base ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3)))) % (1 << 64), r.getrandbits(3)] for _ in range(n)]
    both = np.array(prints, np.uint64)
    for own, radius, wide in ((both[:, :1], 2, 0), (both, 4, 5)):
        a, b = sim.forest(own, np.array(sizes), radius, wide)
        root, begin = [], 0
        for n in sizes:
            apart = lambda x, y: [int(p ^ q).bit_count() for p, q in zip(x.tolist(), y.tolist(), strict=True)]
            near = lambda x, y: (d := apart(x, y))[0] <= radius and (len(d) == 1 or sum(d) <= wide)  # noqa: E731, B023
            root += [begin + k for k in linked(list(own[begin : begin + n]), near)]
            begin += n
        found = linked(list(range(len(own))), lambda i, j, links=frozenset(zip(a.tolist(), b.tolist(), strict=True)): (i, j) in links or (j, i) in links)
        assert found == root
        assert len(a) <= len(own)


def test_suffix_dedup_of_a_corpus(spark):
    texts = [None, "", *corpus(6, 200), "z" * 450, "ab" * 200, "short", "z" * 99]
    out = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert out == covered(list(enumerate(texts)))


@pytest.mark.parametrize("hot", [1, 20])
def test_suffix_dedup_of_hot_strings(spark, monkeypatch, hot):
    """Buckets of many spans are refined until they hold few, or are one string."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [*corpus(7, 120), "z" * 450, "ab" * 200, *["q" * 130 + str(i) for i in range(30)]]
    out = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert out == covered(list(enumerate(texts)))


def test_suffix_dedup_carries_equal_spans_once(spark, monkeypatch):
    """A passage in many documents: of its spans, refining carries on the different ones, not a row for each window of each document."""
    import random

    r = random.Random(10)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(300)
    texts = [letters(60) + passage + letters(60) for _ in range(300)]
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    made, save = {}, suffix_dedup.Scratch.save
    monkeypatch.setattr(suffix_dedup.Scratch, "save", lambda self, df, name: made.setdefault(name, save(self, df, name)))
    out = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert out == covered(list(enumerate(texts)))
    undecided = made["found"].filter(F.col("kind") == suffix_dedup.OPEN).count()
    carried = sum(df.filter(F.col("packed").bitwiseAND(15) != suffix_dedup.GONE).count() for name, df in made.items() if name.startswith("halves-"))
    assert undecided >= 600
    assert 0 < carried <= 8 * undecided


@pytest.mark.parametrize("seed", [6, 7])
def test_substring_dedup_of_a_corpus(spark, seed):
    """Of one batch: the earliest place in it is the earliest of all."""
    texts = [None, "", *corpus(seed, 150, 120), "z" * 900, "ab" * 300, "short"]
    out = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs_of(spark, texts, parts=1)).collect()}
    assert out == chunk_spans(list(enumerate(texts)))


def test_substring_dedup_keeps_first_passages(spark):
    """What is left with what was removed makes each text; passages of many words go where they come again, wherever they begin."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = [" ".join([*(word() for _ in range(r.randint(0, 40))), passage, *(word() for _ in range(20))]) for _ in range(20)]
    clean = [" ".join(word() for _ in range(100)) for _ in range(20)]
    out = {x["doc_id"]: x for x in substring_dedup.substring_dedup(docs_of(spark, texts + clean)).collect()}
    assert out[0]["n_removed"] == 0
    for i in range(1, 20):
        assert len(passage) * 0.7 <= out[i]["n_removed"] <= len(passage) + 64
        assert out[i]["n_spans"] >= 1
    for i in range(20, 40):
        assert out[i]["n_removed"] == 0
        assert out[i]["kept_sha256"] == hashlib.sha256(clean[i - 20].encode()).hexdigest()


def test_substring_dedup_of_fifty_words(spark):
    """Passages of 51 words go whole where they come again, but for a few; what goes has an earlier copy of 100 bytes."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(200)]
    texts = [" ".join([*(word() for _ in range(r.randint(0, 40))), p, *(word() for _ in range(20))]) for p in passages * 2]
    out = {x["doc_id"]: x for x in substring_dedup.substring_dedup(docs_of(spark, texts)).collect()}
    assert all(out[i]["n_removed"] == 0 for i in range(200))
    left = [len(p) - out[200 + i]["n_removed"] for i, p in enumerate(passages)]
    assert sum(x <= 0 for x in left) >= 190
    assert sum(max(0, x) for x in left) <= 0.04 * sum(map(len, passages))
    exact = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert all(out[i]["n_removed"] <= exact[i] for i in exact)


def test_substring_dedup_reaches_far(spark, monkeypatch):
    """Bytes alike over all of a side are compared again, further out."""
    monkeypatch.setattr(substring_dedup, "SIDE", 8)
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3000))
    out = {x["doc_id"]: x for x in substring_dedup.substring_dedup(docs_of(spark, [text, "Q" * 500 + text[700:1900] + "Z" * 40])).collect()}
    assert out[1]["n_removed"] >= 1200


def edited(r, own: list[str], n: int, vocabulary: list[str]) -> list[str]:
    """own with n words changed, put in or taken out."""
    x = list(own)
    for _ in range(n):
        at = r.randrange(len(x))
        x[at : at + r.choice([0, 1, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
    return x


def test_near_groups_equal_all_pairs(spark):
    """Groups equal those of all pairs, but for few that the fingerprints miss; none is joined under the similarity."""
    import random

    r = random.Random(13)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    texts = []
    for _ in range(120):
        own = [r.choice(vocabulary) for _ in range(r.choice([6, 9, 20, 60, 200, 500]))]
        texts += [" ".join(own), " ".join(edited(r, own, max(1, len(own) * r.choice([1, 2, 3, 6]) // 100), vocabulary))]
    texts += [None, "", " \t", "one two", "One  two", "x " * 2000, "x " * 2000 + "y"]
    want = similar(texts)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing under the similarity
    inside = [i for i, w in enumerate(want) if i != w]
    assert len(inside) >= 50
    assert sum(got.get(i) == want[i] for i in inside) >= 0.97 * len(inside)


def test_near_groups_of_one_large_family(spark, monkeypatch):
    """Many near copies of one text, dealt out as tiles, are one group; a family whose members are less alike isn't."""
    import random

    r = random.Random(14)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    base, other = ([r.choice(vocabulary) for _ in range(200)] for _ in range(2))
    texts = [" ".join(base), *(" ".join(edited(r, base, 2, vocabulary)) for _ in range(150)), *(" ".join(edited(r, other, 14, vocabulary)) for _ in range(60))]
    want = similar(texts)
    monkeypatch.setattr(near_dedup, "TILE_ROWS", 20)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert sum(got.get(i) == 0 for i in range(151)) >= 150
    assert all(want[i] == want[c] for i, c in got.items())


def test_bucket_bits_grow_slowly():
    for n in (10, 10**6, 10**8, 10**10):
        own = near_dedup.bucket_bits(n)
        bits = len(own[0])
        assert n / 2**bits <= near_dedup.FULL
        assert (1 - (1 - near_dedup.APART / 192) ** bits) ** len(own) <= near_dedup.MISSED
    assert len(near_dedup.bucket_bits(10**10)) <= 400


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, line string, pages string, drop string")


def test_line_dedup(spark):
    own = lambda i, host, lines: (i, f"https://{host}/p{i}?q", "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>", *["clash"] * 4)
    rows = [own(i, "A.example", ["menu", f"text {i}", "half" if i % 2 else f"other {i}", "menu"]) for i in range(4)]
    rows += [own(10 + i, "b.example", ["menu", "twice"]) for i in range(2)]
    rows += [(20, None, None, *[None] * 4), (21, None, "", *[None] * 4), (22, "no scheme", "<p>menu</p>", *[None] * 4), (None, "https://a.example/", "<script>menu()</script><p>menu", *[None] * 4)]
    out = {r["page_id"]: r for r in line_dedup.line_dedup(pages_of(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert (out[0]["host"], out[0]["n_lines"], out[0]["n_removed"], out[0]["text"]) == ("a.example", 4, 2, "text 0\nother 0")
    assert out[1]["text"] == "text 1\nhalf"  # two of five pages
    assert out[10]["text"] == "menu\ntwice"  # too few pages for a ratio
    assert (out[20]["n_lines"], out[20]["text"]) == (0, "")
    assert out[None]["text"] == ""
    assert line_dedup.line_dedup(pages_of(spark, [])).collect() == []


def test_surrogates(spark):
    texts = ["Write to ann.lee@mail.example or ANN.LEE@mail.example, +49 30 1234567.", "ann.lee@mail.example; card 4111 1111 1111 1111; 10.0.0.7; 123-45-6789", "Mrs. Anna Keller met Frau Анна and Herr Karl Otto.", "Mrs. Anna Keller again", None, "", "no entity at all"]
    out = {r["doc_id"]: r for r in pii.surrogates(docs_of(spark, texts), KEY).collect()}
    words = {i: (r["text"] or "").split(" ") for i, r in out.items()}
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == texts[6]
    assert "ann.lee" not in out[0]["text"].lower()
    assert words[0][2].lower() == words[0][4].rstrip(",").lower() == words[1][0].rstrip(";")  # coreference, whatever the case
    assert words[0][4].isupper() is False and words[0][4].split("@")[0].isupper()
    card = out[1]["text"].split("card ")[1].split(";")[0]
    assert [len(x) for x in card.split(" ")] == [4] * 4 and card != "4111 1111 1111 1111"
    assert pii._luhn(card.replace(" ", "")) == 0
    assert words[2][1] in pii.FEMALE and words[2][1] != "Anna"
    assert words[2][:3] == words[3][:3]
    assert all("а" <= c.lower() <= "я" for c in words[2][5])  # the script stays
    assert out[1]["n_replaced"] == 4 and dict(out[1]["types"]) == {"email": 1, "card": 1, "ip": 1, "ssn": 1}


def test_entities_side_by_side_stay_apart():
    kinds = lambda t: [(m.lastgroup, m[0]) for m in pii._PATTERN.finditer(t)]
    assert kinds("+1 (426) 555-4081 190.137.223.204 x") == [("phone", "+1 (426) 555-4081"), ("ip", "190.137.223.204")]
    assert kinds("+44 20 7946 0958 190.137.223.204") == [("phone", "+44 20 7946 0958"), ("ip", "190.137.223.204")]
    assert kinds("+1 (171) 555-2028 4929348385146306 a@b.example") == [("phone", "+1 (171) 555-2028"), ("card", "4929348385146306"), ("email", "a@b.example")]


def test_whole_secrets_and_cards_go():
    """Keys of any length, letters alone, and cards written 4-6-5."""
    body = "aB3" * 50
    secrets = [f"sk-{body}", f"ghp_{body * 200}", "sk-" + "ab1-cd_2" * 40, "0a" * 70, "AB" * 16, "AKIA" + "QWERTYUIOPASDFGH"]
    for x in secrets:
        new, counts = pii.replace(f"key {x} here", KEY)
        assert counts == {"secret": 1}
        assert len(new) == len(f"key {x} here")
        tail = x[4:]
        assert not any(tail[i : i + 12] in new for i in range(len(tail) - 11))
    long = ["a0" * 500 + x for x in "abcdef"]
    assert len({pii.surrogate(KEY, "secret", x) for x in long}) == 6
    new, counts = pii.replace("card 3782 822463 10005 and 3782-822463-10005.", KEY)
    assert counts == {"card": 2}
    assert "822463" not in new


def test_persons_without_titles_and_again():
    """Whole names go, with or without a title, and again where they stand alone; like names have like surrogates."""
    cases = {
        "We met Alice Smith there.": ["Alice", "Smith"],
        "Yes, Mrs Alice Smith came. Smith said that Alice's hat and the Smiths were late.": ["Alice ", "Smith ", "Alice'"],
        "Dr Keller and Prof. Dr. Weber": ["Keller", "Weber"],
        "Mr Ivan Petrov Sidorov left": ["Ivan", "Petrov", "Sidorov"],
        "Mr O'Brien and Mrs. J. Fenton and Mr McDonald": ["Brien", "J.", "Fenton", "Donald"],
        "Herr von der Leyen und Frau Smith-Jones": ["Leyen", "Smith", "Jones"],
        "with Mr Dvořák": ["Dvo", "řák"],
    }
    for text, gone in cases.items():
        new, counts = pii.replace(text, KEY)
        assert set(counts) == {"person"}
        assert len(new.split(" ")) == len(text.split(" "))
        for x in gone:
            assert x not in new, (text, new)
    new, counts = pii.replace("Smith wrote to Mrs Alice Smith. Alice and Smith met the smith, Smithson and Malice.", KEY)
    w = new.split(" ")
    assert w[0] == w[5].rstrip(".") == w[8] and w[4] == w[6] and w[4] in pii.FEMALE
    assert new.endswith("the smith, Smithson and Malice.") and counts == {"person": 4}
    for same in ("The Boston river runs. Maria and the others go.", "Mr and Mrs are titles", "the Drum of Alice in it"):
        assert pii.replace(same, KEY) == (same, {})
    assert pii.replace("Mr Smith The rest. The end.", KEY)[0].endswith(" The rest. The end.")


def test_surrogates_are_permutations():
    numbers = [f"{a:03d}-{b:02d}-1234" for a in range(0, 1000, 7) for b in range(0, 100, 9)]
    made = {pii.surrogate(KEY, "ssn", x) for x in numbers}
    assert len(made) == len(numbers)
    names = {pii.surrogate(KEY, "person", f"Mrs. {n}") for n in pii.FEMALE}
    assert names == {f"Mrs. {n}" for n in pii.FEMALE}


def test_no_surrogate_is_its_entity():
    """Under any key: neither known names, nor numbers of few digits, nor names of few letters."""
    for k in range(20):
        key = pii.derived_key(str(k))
        for size in (2, 3, 10, 37, 256):
            moved = [pii.moved(key, "x", i, size) for i in range(size)]
            assert sorted(moved) == list(range(size)) and all(a != b for a, b in enumerate(moved))
            assert [pii._feistel(key, "x", pii._feistel(key, "x", i, size), size, back=True) for i in range(size)] == list(range(size))
        for own in (pii.FEMALE, pii.MALE):
            made = [pii._word(key, n, None) for n in own]
            assert sorted(made) == sorted(own) and all(a != b for a, b in zip(made, own, strict=True))
        for word in ("Li", "Ng", "Bo", "Öz", "Keller", "Мюллер"):
            new = pii._word(key, word, None)
            assert new != word and len(new) == len(word) and new[0].isupper()
            assert [c.lower() in pii._VOWELS for c in new] == [c.lower() in pii._VOWELS for c in word]


def test_one_entity_has_one_surrogate_however_written():
    def digits(t):
        return re.sub(r"[^0-9A-Za-z]", "", t)

    for forms in (["+1 426 555 4081", "+14265554081", "+1 (426) 555-4081"], ["(426) 555-4081", "426-555-4081", "426.555.4081"], ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]):
        made = [pii.replace(f"x {f} y", KEY)[0][2:-2] for f in forms]
        assert len({digits(m) for m in made}) == 1 and digits(made[0]) != digits(forms[0])
        assert [re.sub("[0-9A-Za-z]", "0", m) for m in made] == [re.sub("[0-9A-Za-z]", "0", f) for f in forms]
    assert digits(pii.replace("(426) 555-4081", KEY)[0]) == digits(pii.replace("+1 426 555 4081", KEY)[0])[1:]

    def check(t):
        own = digits(t)
        return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97

    assert check(pii.surrogate(KEY, "iban", "GB82 WEST 1234 5698 7654 32")) == 1
    assert check(pii.surrogate(KEY, "iban", "GB83 WEST 1234 5698 7654 32")) != 1
    ibans = [f"DE{a:02d}37040044053201{b:04d}" for a in range(97) for b in range(0, 100, 7)]
    assert len({pii.surrogate(KEY, "iban", x) for x in ibans}) == len(ibans)
    cards = [f"411111111111{b:04d}" for b in range(500)]
    assert len({pii.surrogate(KEY, "card", x) for x in cards}) == 500
    assert all((pii._luhn(x) == 0) == (pii._luhn(pii.surrogate(KEY, "card", x)) == 0) for x in cards)


def test_a_surrogate_that_another_entity_has_is_drawn_anew():
    new = pii.surrogate(KEY, "ssn", "123-45-6789")
    seen = {("ssn", re.sub("-", "", new)): "987654321"}
    other = pii.distinct(KEY, "ssn", "123-45-6789", seen)
    assert other != new and re.fullmatch(r"\d{3}-\d\d-\d{4}", other)
    assert pii.distinct(KEY, "ssn", "987-65-4321", {}) == pii.surrogate(KEY, "ssn", "987-65-4321")


def test_sides_are_sized_by_rows_and_bytes(spark):
    from tidelog.llm.common import sized

    df = spark.createDataFrame([(1, "x" * 1000, ["a", None, "bcd"]), (2, None, None)], "k long, t string, s array<string>")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(sized(df)) and not hinted(sized(df, most=1)) and not hinted(sized(df, most_bytes=1000)) and hinted(sized(df, most_bytes=1300))


def test_a_text_over_a_slice_through_whole_queries(spark, tmp_path):
    """5 MB in one text, with an entity and a benchmark item at its end, and its second half again in another."""
    import random

    import sentencepiece
    from helpers import pieces
    from tokenizers import Tokenizer

    r = random.Random(17)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    item = "which of these five rivers runs through the old town of the north"
    long = " ".join(r.choice(vocabulary) for _ in range(790_000)) + f" ann@mail.example {item}"
    half = long[len(long) // 2 :]
    assert len(long) > 5_000_000
    docs = docs_of(spark, [long, half, "a short text"], langs=["en"] * 3)
    by_id = lambda df: {x["doc_id"]: x for x in df.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model("piece_bpe_32k.model"))
    assert by_id(token_counts.token_counts(docs, model("piece_bpe_32k.model")))[0]["n_tokens"] == len(sp.encode(long))
    packed = packing.pack(docs, model("word_bpe_49k.json")).filter("doc_id = 0").orderBy("piece").collect()
    assert [(x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in packed] == pieces(long, Tokenizer.from_file(model("word_bpe_49k.json")), 4096)
    assert by_id(exact_dedup.exact_dedup(docs))[0]["text_sha256"] == hashlib.sha256(long.replace(" ", "").encode()).hexdigest()
    assert by_id(sim.simhash_groups(docs))[0]["fingerprint"] == f"{simhash(long, 3)[0]:016x}"
    assert by_id(langid.identify(docs))[0]["lang_pred"] == "en"
    found = by_id(suffix_dedup.suffix_dedup(docs))
    assert (found[0]["n_removed"], found[1]["n_removed"]) == (0, len(half))
    assert by_id(substring_dedup.substring_dedup(docs))[1]["n_removed"] == len(half)
    assert "ann@mail" not in by_id(pii.surrogates(docs, KEY))[0]["text"][-200:]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {x["doc_id"] for x in decontam.contaminated(docs, bench).collect()} == {0, 1}
    assert sorted(x["doc_id"] for x in near_dedup.one_of_each(docs).select("doc_id").collect()) == [0, 1, 2]


def test_scratch_tables_go(spark):
    import os

    from tidelog.llm.common import Scratch

    kept = len(Scratch.made)
    scratch = Scratch(spark)
    folder = scratch.root.removeprefix("file:")
    assert scratch.save(spark.range(3), "n").count() == 3
    assert scratch.save_owned(spark.range(9), "owned", ["id"], 2, "id").count() == 9
    assert os.path.exists(f"{folder}/n") and os.path.exists(f"{folder}/owned")
    Scratch.forget(kept)
    assert not os.path.exists(folder) and len(Scratch.made) == kept


def test_decontamination(spark):
    item = "A train leaves the city of Boston with 120 people and travels 300 miles in 5 hours before it stops near the river for repairs"
    other = "which of these gases is most common in the air that we breathe every day on this planet"
    bench = spark.createDataFrame([(1, item, None), (2, other, None), (3, "too short", None), (4, None, None), (None, item, None)], "item_id long, text string, window string")
    copy = f"Some words come first. {item}. And others behind it."
    changed = item.replace("Boston", "Denver").replace("120", "75").replace("300", "410").replace("5 hours", "7 hours")
    mixed = item.replace("120", "300")  # two values for one: another question
    texts = [copy, f"intro words {changed} end", "clean words about trains and the city of Boston, nothing else in it", None, "", f"{other} {item}", mixed]
    out = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert {(0, 1), (1, 1), (5, 1), (5, 2)} <= out
    assert {d for d, _ in out} <= {0, 1, 5}
    left = sorted(r["doc_id"] for r in decontam.drop_contaminated(docs_of(spark, texts), bench).collect())
    assert left == [2, 3, 4, 6]


def _found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}


def test_decontamination_of_numbers(spark):
    """Windows of numbers are matched by their values: a copy is found, other numbers in the same pattern are not."""
    items = ["12 + 7 * 3 - 5 = 28 or 29, 30", "Compute 4 9 16 25 36 49 64 81 100 121 next please now"]
    copy = f"see: {items[0]}; and {items[1]} end"
    out = _found(spark, items, [copy, items[0].replace("7", "8").replace("28", "31"), "Compute 5 8 17 26 37 50 65 82 101 122 next please now"])
    assert set(out) == {(0, 0), (0, 1)}
    assert out[0, 1] == (10, 10)


def test_decontamination_whatever_the_case_and_spacing(spark):
    """A copy is found if it is wrapped, spaced or cased otherwise, or stands behind a lower-case word; a slot or so may disagree."""
    item = "the road from Boston to Denver by way of Chicago was built before the war by workers of many lands"
    short = "Copper conducts heat better than iron"
    words = "bread milk eggs rice beans flour salt sugar corn wine meat fish".split()
    many = lambda values: " then ".join(f"they paid {v} for the {w}" for v, w in zip(values, words, strict=True))
    texts = [item.replace("Boston", "New York").replace("Chicago", "San Jose"), item.title(), item.replace(" ", "\n"), item.replace(" ", "  "), item.lower(), item.upper(), f"we know that {short}", many([*range(31, 42), 41]), many([31] * 12)]
    out = _found(spark, [item, short, many(range(11, 23))], texts)
    assert set(out) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 2)}


def test_decontamination_equals_every_pair(spark):
    """Made-up items and documents with copies, other values, other names of one word or two, and half copies."""
    import random

    r = random.Random(31)
    common = "the of and a to in is was for on with as by at from that this they were".split()
    names = ["Boston", "Denver", "New York", "San Jose", "Paris", "Los Angeles"]
    word = lambda: r.choice([*common, *(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(3))])
    blank = lambda: r.choice([word, word, word, lambda: "{n}", lambda: "{c}", lambda: "{n} km"])()
    fill = lambda t: re.sub(r"\{(n|c)\}", lambda m: str(r.randint(2, 99)) if m[1] == "n" else f"near {r.choice(names)}", t)
    forms = [" ".join(["is", *(blank() for _ in range(r.randint(4, 25)))]) for _ in range(25)] + ["{n} {n} {n} {n} {n} {n} {n}", "for {n} and {n} or {n} {n} {n} by {n}"]
    items = [(i, fill(f)) for i, f in enumerate(forms)] + [(90, None), (91, ""), (92, "too short")]
    texts = [None, ""]
    for i, f in enumerate(forms):
        own = items[i][1]
        half = own.split(" ")
        texts += [f"{word()} {own} {word()}", f"{word()} {fill(f)} {word()}", own.upper(), own.replace(" ", "\n"), " ".join(half[: len(half) // 2]), " ".join(word() for _ in range(30)), f"{own} {fill(f)}"]
    want = leaks(list(enumerate(texts)), items)
    assert _found(spark, [t for _, t in items[:27]], texts) == want
    assert len(want) > 80


def test_decontamination_of_a_window_that_all_share(spark):
    """Items and documents that have windows in common aren't paired by these alone."""
    from tidelog.llm.common import Scratch

    shared = "please read the text and answer the question below in one word"
    rare = [" ".join(f"{chr(97 + i)}{chr(97 + j)}{k}x" for k in range(12)) for i in range(6) for j in range(5)]
    bench = spark.createDataFrame([(i, f"{shared} {t}") for i, t in enumerate(rare)], "item_id long, text string")
    docs = docs_of(spark, [f"{shared} {' '.join(f'z{i}q{k}' for k in range(9))}" for i in range(40)] + [f"{shared} {rare[3]}"])
    out = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert out == {(40, 3)}
    scratch = Scratch(spark)
    items = decontam.item_windows(bench)
    both = items.groupBy("item_id", "window").agg(F.max("form").alias("form"), F.max(1 - F.col("form")).alias("word"))
    sizes = both.groupBy("item_id").agg(F.sum("form").alias("n_form"), F.sum("word").alias("n_word"))
    hashes = decontam.hashed(docs, "doc_id").select("doc_id", F.explode(decontam.all_windows()).alias("window"))
    met = scratch.save(hashes.join(both.select("window").distinct(), "window", "left_semi").distinct(), "met")
    assert met.join(decontam.probes(both, sizes, met, 0.8), "window").select("doc_id", "item_id").distinct().count() == 1


def test_langid_learns_only_from_its_folds(spark):
    texts = ["the cat sat on the mat and then it ran"] * 40 + ["le chat dort sur la table et puis il mange"] * 40
    langs = ["en"] * 40 + ["fr"] * 40
    plain = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(spark, texts, langs=langs)).collect()}
    assert all(plain[i] == lang for i, lang in enumerate(langs))
    import zlib

    turned = ["xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang for i, lang in enumerate(langs)]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(spark, texts, langs=turned)).collect()} == plain


def test_langid_sample_is_bounded(spark):
    """However many labels and documents there are."""
    n = 300
    docs = docs_of(spark, [f"text number {i} of some words" for i in range(n)], langs=[f"l{i % 60:02d}" for i in range(n)])
    few = langid.fit(docs, most_langs=7)
    assert len(few.langs) == 7
    small = langid.fit(docs, sample_bytes=60 * 60 * 60)
    assert len(small.langs) == 60
    assert langid.fit(docs, per_lang=1).langs == small.langs
    assert langid.fit(docs.limit(0)).langs == []


def test_code_lengths_are_those_of_the_tree():
    """The batched tables against a plain recursive coder."""
    import math
    from collections import Counter

    samples = {"a": [b"abracadabra", b"abc"], "b": [b"bcbcbc"]}
    found = langid.Model(samples)
    text = b"abraxbc"
    for k, lang in enumerate(found.langs):
        counts = Counter()
        for s in samples[lang]:
            padded = bytes(langid.ORDER) + s
            for i in range(langid.ORDER, len(padded)):
                for w in range(1, langid.ORDER + 2):
                    counts[padded[i - w + 1 : i + 1]] += 1

        def cost(context: bytes, symbol: bytes) -> float:
            own = {g: n for g, n in counts.items() if len(g) == len(context) + 1 and g[:-1] == context}
            total = sum(own.values())
            if context + symbol in own:
                return -math.log2(own[context + symbol] / (total + len(own)))
            escape = -math.log2(len(own) / (total + len(own))) if total else 0.0
            return escape + (cost(context[1:], symbol) if context else 8.0)

        padded = bytes(langid.ORDER) + text
        want = sum(cost(padded[i - langid.ORDER : i], padded[i : i + 1]) for i in range(langid.ORDER, len(padded)))
        assert abs(found.lengths([text])[0][k] - want) < 1e-3
