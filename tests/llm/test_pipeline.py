"""The pipeline's stages against brute-force versions, each over what the one before kept."""

from __future__ import annotations

import corpus_pipeline
import pytest
from helpers import SMALL, awkward, corpus, docs_of, empty, exact_groups, pieces, similar
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Each stage's rows over the small documents, as the pipeline stores them."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def texts_of(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stored):
    assert all(d.columns == stored[0].columns for d in stored[:-1])


def test_language_keeps_what_a_language_knows(spark, stored):
    """Of the small documents, those with a letter; of others, none in a language or script that wasn't learned, or of letters at random."""
    assert texts_of(stored[1]) == {i: t for i, t in texts_of(stored[0]).items() if any(map(str.isalpha, t or ""))}
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由，在尊严和权利上一律平等", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", "qzxj vkwq xzzq jjkw qqxz vvkj zxqw kjqx", "12 34", None]
    n = 1_000_000
    docs = stored[0].unionByName(docs_of(spark, foreign, [n + i for i in range(len(foreign))]))
    assert texts_of(corpus_pipeline.language(spark, docs, SMALL)) == texts_of(stored[1])


def test_exact(stored):
    before = texts_of(stored[1])
    want = {i for i, v in exact_groups(list(before.items())).items() if v[2]}
    assert texts_of(stored[2]) == {i: before[i] for i in want}


def test_near(stored):
    before = sorted(texts_of(stored[2]).items())
    root = similar([t for _, t in before])
    assert texts_of(stored[3]) == {i: t for k, (i, t) in enumerate(before) if root[k] == k}


def test_decontaminated(spark, stored):
    import re

    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len((w := words(r["text"])).split()) >= 5]
    before = texts_of(stored[3])
    after = texts_of(stored[4])
    holds = {i for i, t in before.items() if any(w in words(t) for w in items)}
    assert not holds & set(after)
    grams = lambda w: {tuple(w.split()[i : i + 5]) for i in range(len(w.split()) - 4)}
    seen = set().union(*map(grams, items))
    assert {i for i, t in before.items() if not grams(words(t)) & seen} <= set(after)


def test_packed(stored):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, *p) for i, t in texts_of(stored[4]).items() for p in pieces(t, tk, 4096))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stored[5].collect()) == want


def test_run_is_the_stages(spark, stored):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(cols).collect())) == sorted(map(tuple, stored[-1].select(cols).collect()))


def test_near_copies_go_and_others_stay(spark):
    import random

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(60)]
    copies = []
    for own in base[:30]:
        x = list(own)
        for _ in range(3):
            x[r.randrange(len(x))] = r.choice(vocabulary)
        copies.append(x)
    out = {r["doc_id"] for r in corpus_pipeline.near(spark, docs_of(spark, [" ".join(x) for x in base + copies]), SMALL).collect()}
    assert set(range(60)) <= out
    assert len(out) <= 61  # fingerprints are estimates: of 30 copies of similarity 0.9, one at most is missed


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, empty(spark), SMALL).collect() == []
    docs = awkward(spark)
    out = stage(spark, docs, SMALL)
    kept = 6 if k else 4  # of the long text's words, over 64 KB, no language was learned
    assert out.select("doc_id").filter(F.col("doc_id") == kept).count() >= 1
    if k < 4:
        assert out.columns == docs.columns


def test_pipeline_over_a_hostile_corpus(spark, tmp_path):
    texts = [None, "", " ", "123 456", *corpus(12, 60)]
    docs_of(spark, texts, langs=["en"] * len(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out
    assert min(r["doc_id"] for r in out) >= 4
