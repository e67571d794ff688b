"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become tokens in which numbers, names and units are typed: the type is the template, the value a slot; a name of
several words is one slot. Windows of five template tokens are hashed, those of more than MOST_SLOTS slots with their
values; the benchmark's windows, broadcast where few and shuffled where not, meet those of all documents. A document that
holds at least `least` of an item's windows is a candidate; its slots must then agree, as many as that: an item's value
stands for one value throughout, and no other value for it. That finds an item whose numbers, names or units were
replaced, and leaves accidents alone. Windows of the plain words meet as well, and there nothing else is asked: a copy is
found however it is cased, spaced or wrapped.

A document that holds `least` of an item's windows holds one of any few of them that leave less than `least`. Documents
and items are therefore paired only where they meet in such of the item's windows as the fewest documents hold: a window
that all items or documents have pairs nothing by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import BROADCAST_ROWS, Scratch, sized

WINDOW = 5
LEAST = 0.8
#: Windows with more slots than this say too little without their values ("N N N N of"): they are hashed with them.
MOST_SLOTS = 3
NUMBER, NAME, UNIT, JOIN = "\x01", "\x02", "\x03", "\x04"
#: Classes of characters: white space, and what tokens are made of.
_WHITE, _TOKEN = "\\s\\u0085\\p{Z}\\x01-\\x04", "\\p{L}\\p{N}\\p{M}\\x02\\x04"
_UNITS = "km|cm|mm|kg|mg|ml|kb|mb|gb|tb|mph|kmh|hz|kwh|m|g|l|s|h|km2|m2|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|kilos?|pounds?|ounces?|tons?|tonnes?|litres?|liters?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|heures?|jours?|stunden?|tagen?|horas?|litros?|metros?"


def canonical(text: Column) -> Column:
    """Lower-case words without punctuation, between single spaces; a slot has its type's control character before its value."""
    # Patterns begin with what is rare: a look behind comes after it, and single spaces, which stay, match nothing.
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_WHITE}&&[^ ]][{_WHITE}]*+| [{_WHITE}]++", " ")
    # A capitalised word behind a lower-case one, inside a sentence, is a name; names side by side are one.
    t = F.regexp_replace(t, "(\\p{Lu}(?<=[\\p{Ll},;] .)\\p{Ll}++)(?!\\p{L})", f"{NAME}$1")
    t = F.regexp_replace(t, f" {NAME}(?<={NAME}\\p{{L}}{{1,40}} {NAME})", JOIN)
    t = F.lower(F.regexp_replace(t, "[.,:](?<=\\d.)(?=\\d)", ""))
    t = F.regexp_replace(t, f"[^{_TOKEN} ][^{_TOKEN}]*+| [^{_TOKEN}]++", " ")
    t = F.regexp_replace(t, "(\\p{N}(?<![\\p{L}\\p{N}]\\p{N})\\p{N}*+)", f"{NUMBER}$1")
    t = F.regexp_replace(t, f"({NUMBER}\\p{{N}}+) ?({_UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT}$2")
    return F.trim(t)


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """keep of df (with text), its tokens, and hashes: `forms` of the tokens' templates, `words` of the plain words, of which a name may have several."""
    plain, cut = F.translate("canon", f"{JOIN}{NUMBER}{NAME}{UNIT}", " "), lambda t: F.when(t != "", F.split(t, " ")).otherwise(F.array().cast("array<string>"))
    own = df.select(*keep, canonical(F.col("text")).alias("canon"))
    own = own.select(*keep, cut(F.col("canon")).alias("tokens"), F.transform(cut(plain), lambda x: F.xxhash64(x)).alias("words"))
    # Texts without a slot, and tokens that aren't one, are their own templates.
    marks = F.filter(F.transform("tokens", lambda x, i: F.when(x <= f"{JOIN}", i)), lambda i: i.isNotNull())
    own = own.select("*", marks.alias("slots"))
    return own.select("*", F.when(F.size("slots") > 0, F.transform("tokens", lambda x: F.xxhash64(F.when(x <= f"{JOIN}", F.substring(x, 1, 1)).otherwise(x)))).alias("forms"))


def _hash(name: str, i: Column) -> Column:
    return F.xxhash64(*(F.element_at(name, i + k) for k in range(1, WINDOW + 1)))


def plain_windows() -> Column:
    """Of each five words in a row; none where there are fewer."""
    return F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: _hash("words", i))).otherwise(F.array().cast("array<bigint>"))


def _value(token: Column) -> Column:
    return F.xxhash64(F.when(token <= JOIN, F.substring(token, 2, 1 << 30)).otherwise(token))


def template_windows() -> Column:
    """(pos, window) of each five tokens in a row with a slot among them: of their templates, or with more than MOST_SLOTS slots, of their values."""
    near = F.array_distinct(F.flatten(F.transform("slots", lambda i: F.sequence(F.greatest(i - (WINDOW - 1), F.lit(0)), i))))
    at = F.filter(near, lambda i: i <= F.size("tokens") - WINDOW)
    many = lambda i: F.size(F.filter("slots", lambda s: s.between(i, i + (WINDOW - 1))))
    values = lambda i: F.xxhash64(*(_value(F.element_at("tokens", i + k)) for k in range(1, WINDOW + 1)))
    made = F.transform(at, lambda i: F.struct(i.alias("pos"), F.when(many(i) > MOST_SLOTS, values(i)).otherwise(_hash("forms", i)).alias("window")))
    return F.when(F.size("slots") > 0, made).otherwise(F.array().cast("array<struct<pos: int, window: bigint>>"))


def all_windows() -> Column:
    """The windows of both kinds; without slots, they are the same."""
    return F.concat(plain_windows(), F.transform(template_windows(), lambda w: w["window"]))


def slots_at(pos: Column) -> Column:
    """The slots of the five tokens from pos on, null for words."""
    return F.transform(F.slice("tokens", pos + 1, WINDOW), lambda x: F.when(x <= JOIN, x))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, ipos, window, slots, form): plain windows, with form 0, and template windows, with form 1 and the values of their slots by place, null for words.

    A template window without slots is the plain one, and is there as both.
    """
    own = hashed(benchmark.select("item_id", F.col("text")), "item_id")
    words = own.select("item_id", F.posexplode(plain_windows()).alias("ipos", "window"), F.lit(None).cast("array<string>").alias("slots"), F.lit(0).alias("form"))
    typed = own.select("item_id", "tokens", F.explode(template_windows()).alias("w")).select("item_id", F.col("w.pos").alias("ipos"), F.col("w.window").alias("window"), slots_at(F.col("w.pos")).alias("slots"), F.lit(1).alias("form"))
    # Tokens and words stand at other places where names of several words come before: windows of bare tokens are made anew.
    bare = F.filter(F.sequence(F.lit(0), F.size("tokens") - WINDOW), lambda i: ~F.exists("slots", lambda s: s.between(i, i + (WINDOW - 1))))
    bare = own.filter(F.size("tokens") >= WINDOW).select("item_id", "tokens", F.explode(bare).alias("ipos"))
    window = F.xxhash64(*(_value(F.element_at("tokens", F.col("ipos") + k)) for k in range(1, WINDOW + 1)))
    return words.unionByName(typed).unionByName(bare.select("item_id", "ipos", window.alias("window"), F.lit(None).cast("array<string>").alias("slots"), F.lit(1).alias("form")))


def probes(both: DataFrame, sizes: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """(item_id, window): of each item's windows (both: form, word), those held by the fewest documents, as many as may all be missing, and one more."""
    held = met.groupBy("window").agg(F.count("*").alias("docs"))
    rare = both.join(sized(held), "window").join(sized(sizes), "item_id")
    out = None
    for kind in ("form", "word"):
        missing = F.col(f"n_{kind}") - F.col(f"found_{kind}")  # windows that no document holds come first
        asked = F.floor((1 - least) * F.col(f"n_{kind}") + 1e-9) + 1 - missing
        counted = rare.filter(F.col(kind) == 1).withColumn(f"found_{kind}", F.count("*").over(Window.partitionBy("item_id")))
        ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("docs", "window"))).filter(F.col("rank") <= asked).select("item_id", "window")
        out = ranked if out is None else out.unionByName(ranked)
    return out.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, containment): one row for each item that a document holds.

    containment is the share of the item's distinct windows found in the document, of plain windows or of templates with
    agreeing slots, whichever is greater. Items of fewer than five tokens, and null or empty texts on either side, match
    nothing. Rows that repeat a doc_id count as one document, and items that share all windows are found each; the
    greater share of a pair is given, then the one of more windows. Rows with a null doc_id or item_id take no part.
    Texts are read whole; a very long one is a row of many windows. Only doc_id, text and item_id are read. Stages are
    run, and their tables stored, before this returns.
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.save(item_windows(benchmark.filter(F.col("item_id").isNotNull())), "items")
    both = scratch.save(items.groupBy("item_id", "window").agg(F.max("form").alias("form"), F.max(1 - F.col("form")).alias("word")), "windows")
    sizes = scratch.save(both.groupBy("item_id").agg(F.sum("form").alias("n_form"), F.sum("word").alias("n_word")), "sizes")
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = hashed(known, "doc_id").select("doc_id", F.explode(all_windows()).alias("window"))
    met = scratch.save(spread.join(sized(both.select("window").distinct()), "window", "left_semi").distinct(), "met")
    pairs = scratch.save(met.join(sized(probes(both, sizes, met, least)), "window").select("doc_id", "item_id").distinct(), "pairs")
    counted = pairs.join(sized(both), "item_id").join(met, ["doc_id", "window"]).groupBy("doc_id", "item_id").agg(F.sum("form").alias("form"), F.sum("word").alias("word"))
    counted = counted.join(sized(sizes), "item_id")
    close = scratch.save(counted.filter((F.col("form") >= least * F.col("n_form")) | (F.col("word") >= least * F.col("n_word"))), "close")
    out = lambda x: x.select("doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("containment"))
    as_words = close.select("doc_id", "item_id", F.col("n_word").alias("n_windows"), F.col("word").alias("n_found"))
    as_forms = close.select("doc_id", "item_id", F.col("n_form").alias("n_windows"), F.col("form").alias("n_found"))
    slotted = items.filter("slots is not null").select("item_id", "ipos", "window", "slots")
    if slotted.isEmpty():
        return out(as_words)
    asked = close.filter(F.col("form") >= least * F.col("n_form"))
    bad = inconsistent(known, asked, slotted, scratch, least)
    fit = asked.select("doc_id", "item_id").join(bad, ["doc_id", "item_id"], "left_anti").join(as_forms, ["doc_id", "item_id"])
    found = out(as_words.filter(F.col("n_found") >= least * F.col("n_windows"))).unionByName(out(fit))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_windows", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_found", "b.containment")


def inconsistent(known: DataFrame, close: DataFrame, slotted: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(doc_id, item_id) of candidates in which no placement of the item has `least` of its values agreeing.

    A placement is a difference of positions at which at least half as many windows meet as at the best one.
    """
    with_slots = close.join(sized(slotted.select("item_id").distinct()), "item_id", "left_semi").select("doc_id", "item_id")
    ids = with_slots.select("doc_id").distinct()
    held = hashed(known.join(sized(ids), "doc_id", "left_semi"), "doc_id")
    cut = held.select("doc_id", "tokens", F.explode(template_windows()).alias("w")).select("doc_id", F.col("w.pos").alias("pos"), F.col("w.window").alias("window"), slots_at(F.col("w.pos")).alias("values"))
    met = with_slots.join(sized(slotted), "item_id").join(cut, ["doc_id", "window"])
    each = met.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), F.explode(F.arrays_zip("slots", "values")).alias("s")).filter("s.slots is not null and s.values is not null")
    each = each.select("doc_id", "item_id", "shift", F.col("s.slots").alias("theirs"), F.col("s.values").alias("ours")).distinct()
    key = ["doc_id", "item_id", "shift"]
    one = each.groupBy(*key, "theirs").agg(F.count("*").alias("n"), F.min("ours").alias("ours"))
    two = each.groupBy(*key, "ours").agg(F.count("*").alias("m"))
    agrees = ((F.col("n") == 1) & (F.col("m") == 1)).cast("int")
    placements = one.join(two, [*key, "ours"]).groupBy(*key).agg(F.count("*").alias("met"), F.sum(agrees).alias("agreed"))
    best = placements.groupBy("doc_id", "item_id").agg(F.max("met").alias("best"))
    judged = placements.join(best, ["doc_id", "item_id"]).filter(F.col("met") * 2 >= F.col("best"))
    return scratch.save(judged.groupBy("doc_id", "item_id").agg(F.max(F.col("agreed") >= least * F.col("met")).alias("fits")).filter("not fits").select("doc_id", "item_id"), "unfit")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns as they are. Rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    mine = f"__{scratch.root[-8:]}"
    gone = scratch.save(contaminated(docs, benchmark, least).select(F.col("doc_id").alias(mine)).distinct(), "gone")
    return docs.join(sized(gone, BROADCAST_ROWS), docs["doc_id"] == gone[mine], "left_anti")
