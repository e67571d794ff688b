"""Small document tables, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

WHITE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, texts, ids=None, langs=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def awkward(spark, copies=2):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names operators might use."""
    long = "lorem ipsum dolor sit amet consectetur " * 30_000
    texts = [None, "", " \t\n", "a", "the same short text of some words here", "the same short text of some words here", long, long + "end", "ñandú über 北京 \U00010437 1234", "x" * 50_000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)]
    rows += [(None, "no id, but some words stand here", None, None, None), (None, None, None, None, None), (3, "a", "en", "s", 1)] * copies
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("n", "key", "sha", "rows", "norm", "print", "rep", "component_id", "lang_pred", "score", "kept", "keep_id", "length", "window", "item_id", "list", "begin", "raw", "z", "fingerprint", "piece", "sequence_id", "bucket", "page"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def corpus(seed: int, n: int, words: int = 60) -> list[str]:
    """Invented prose with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(55))
    out: list[str] = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.2:
            out.append(r.choice(out))
        elif out and kind < 0.4:
            own = r.choice(out).split(" ")
            own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
        else:
            own = [r.choice(vocabulary) for _ in range(r.randint(1, words))]
            if kind < 0.6:
                own.insert(r.randrange(len(own)), passage)
            out.append(" ".join(own))
    return out


def normal(text: str | None) -> str:
    return WHITE.sub("", text or "")


def exact_groups(rows: list[tuple]) -> dict:
    """(doc_id, text) rows with unique ids to op3's columns by id."""
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def simhash(text: str | None, words: int, seeds=(42,)) -> list[int]:
    import xxhash

    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not own:
        return [0] * len(seeds)
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    out = []
    for s in seeds:
        hashes = [xxhash.xxh64_intdigest(x, s) for x in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def linked(keys: list, near) -> list[int]:
    """The smallest index reachable from each, all pairs compared."""
    root = list(range(len(keys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def similar(texts: list) -> list[int]:
    """The first text of each one's group: groups are what a Jaccard similarity of 0.8 of five-word shingles joins, all pairs compared."""
    def shingles(t):
        own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()

    return linked([shingles(t) for t in texts], lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0)


def covered(rows: list[tuple], length: int = 100) -> dict:
    """(doc_id, text) rows with unique ids to op8's columns by id, from every string of `length` bytes."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        own: set[bytes] = set()
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen or w in own:
                gone[s : s + length] = b"\1" * length
            own.add(w)
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def pieces(text: str | None, tokenizer, capacity: int) -> list[tuple]:
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    out = []
    for k, start in enumerate(range(0, len(ids), capacity)):
        own = ids[start : start + capacity]
        out.append((k, start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    return out


def template_tokens(text: str | None) -> list[str]:
    """Decontamination's tokens of a text, step by step."""
    import regex

    from tidelog.llm.decontam import _UNITS

    t = regex.sub(r"[ \t\n\x0b\f\r\x85\p{Z}\x01-\x04]+", " ", text or "")
    t = regex.sub(r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)(?!\p{L})", "\x02\\1", t)
    t = regex.sub("(?<=\x02\\p{L}{1,40}) \x02", "\x04", t)
    t = regex.sub(r"(?<=[0-9])[.,:](?=[0-9])", "", t).lower()
    t = regex.sub(r"[^\p{L}\p{N}\p{M}\x02\x04]+", " ", t)
    t = regex.sub(r"(?<![\p{L}\p{N}])(\p{N}+)", "\x01\\1", t)
    t = regex.sub("(\x01\\p{N}+) ?(" + _UNITS + ")(?![\\p{L}\\p{N}])", "\\1 \x03\\2", t)
    return [x for x in t.split(" ") if x]


def leaks(docs: list[tuple], items: list[tuple], least: float = 0.8) -> dict:
    """(doc_id, text) and (item_id, text) to {(doc_id, item_id): (n_windows, n_found)}, every document against every item."""
    five = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    slot = lambda x: x[0] <= "\x03"

    def views(text):
        tokens = template_tokens(text)
        values = [x[1:] if slot(x) else x for x in tokens]
        words = [w for v in values for w in v.split("\x04")]
        forms = [v if sum(a != b for a, b in zip(f, v, strict=True)) > 3 else f for f, v in zip(five([x[0] if slot(x) else x for x in tokens]), five(values), strict=True)]
        return tokens, forms, five(words)

    def fits(doc, item) -> bool:
        at = defaultdict(list)
        for i, w in enumerate(doc[1]):
            at[w].append(i)
        pairs = defaultdict(set)
        for k, w in enumerate(item[1]):
            for i in at[w]:
                pairs[i - k] |= {(b, a) for a, b in zip(doc[0][i : i + 5], item[0][k : k + 5], strict=True) if slot(a) and slot(b)}
        judged = []
        for own in pairs.values():
            theirs, ours = defaultdict(set), defaultdict(set)
            for b, a in own:
                theirs[b].add(a)
                ours[a].add(b)
            if theirs:
                judged.append((len(theirs), sum(len(x) == 1 and len(ours[min(x)]) == 1 for x in theirs.values())))
        best = max((m for m, _ in judged), default=0)
        return not judged or any(agreed >= least * m for m, agreed in judged if 2 * m >= best)

    held = [(i, views(t)) for i, t in docs]
    out = {}
    for k, t in items:
        item = views(t)
        for i, doc in held:
            found = []
            for kind in (1, 2):
                n, share = len(set(item[kind])), len(set(item[kind]) & {*doc[1], *doc[2]})
                if n and share >= least * n and (kind == 2 or fits(doc, item)):
                    found.append((share / n, n, share))
            if found:
                out[i, k] = max(found)[1:]
    return out


def chunk_spans(rows: list[tuple]) -> dict:
    """(doc_id, text) rows with unique ids to op7's columns by id: chunks by the rolling hash of every place, the first of each stays, runs grow byte by byte."""
    from tidelog.llm.substring_dedup import _GEAR, LEAST, MOST, NEAREST, SIDE, WIDTH, ZEROS

    gear = [int(g) for g in _GEAR]
    raws = {i: (t or "").encode() for i, t in sorted(rows)}

    def chunks(x: bytes) -> list[tuple[int, int]]:
        natural = [p for p in range(WIDTH, len(x) + 1) if sum(gear[x[p - 1 - j]] << j for j in range(WIDTH)) % (1 << 16) < 1 << 16 - ZEROS]
        ends = [p for k, p in enumerate(natural) if p >= WIDTH + NEAREST and (not k or p - natural[k - 1] >= NEAREST)]
        edges = sorted({0, len(x), *ends})
        return [(at, min(at + MOST, z)) for a, z in zip(edges, edges[1:], strict=False) for at in range(a, z, MOST)]

    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for i, x in raws.items():
        found = []  # (begin, end, source, shift)
        for a, z in chunks(x):
            source, at = first.setdefault(x[a:z], (i, a))
            if (source, at) != (i, a):
                found.append((a, z, source, a - at))
        spans = [(a, z) for a, z, _, _ in found]
        covers = joined_spans(spans)
        runs: list[list] = []
        for a, z, source, shift in sorted(found, key=lambda f: (f[2], f[3], f[0])):
            if runs and runs[-1][2:] == [source, shift] and runs[-1][1] == a:
                runs[-1][1] = z
            else:
                runs.append([a, z, source, shift])
        for k, (a, z, source, shift) in enumerate(runs):
            other = raws[source]
            floor = runs[k - 1][1] if k and runs[k - 1][2:] == [source, shift] else 0
            roof = runs[k + 1][0] if k + 1 < len(runs) and runs[k + 1][2:] == [source, shift] else len(x)
            cover = next(c for c in covers if c[0] <= a < c[1])
            if a - cover[0] < SIDE:
                while a > floor and a > shift and x[a - 1] == other[a - 1 - shift]:
                    a -= 1
            if cover[1] - z < SIDE:
                while z < roof and z - shift < len(other) and x[z] == other[z - shift]:
                    z += 1
            if z - a >= LEAST:
                spans.append((a, z))
        gone = [(a, z) for a, z in joined_spans(spans) if z - a >= LEAST]
        kept = b"".join(x[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(x)], strict=True))
        out[i] = (len(x), sum(z - a for a, z in gone), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out
