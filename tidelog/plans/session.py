"""Command scripts: lines become requests by a grammar, requests become responses by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.commands import parse_client, parse_repl
from tidelog.plans.store import Engine


def run_script(engine: Engine, lines: DataFrame, grammar: str = "client") -> DataFrame:
    """lines (seq, line) as responses (seq, op, key, outcome, value): lines behind an exit are left out; invalid ones answer `invalid`.

    list, segment-list and segment-inspect answer what the store holds when the script ends, one row a line, values
    joined by line ends: their size is what a shell would print.
    """
    parsed = (parse_client if grammar == "client" else parse_repl)(lines)
    end = parsed.filter("op = 'exit'").agg(F.min("seq")).first()[0]
    parsed = parsed if end is None else parsed.filter(F.col("seq") < end)
    asked = parsed.filter(F.col("op").isin("get", "set", "delete")).select("seq", "op", "key", "value")
    answers = engine.apply(asked).select("seq", "outcome", F.col("value").alias("answer"))
    out = parsed.join(answers, "seq", "left").select("seq", "op", "key", F.coalesce("outcome", F.when(F.col("op") == "invalid", "invalid").otherwise("ok")).alias("outcome"), F.col("answer").alias("value"))
    shown = {"list": lambda: [r["key"] for r in engine.list().collect()], "segment-list": lambda: [f"segment-{r['segment_id']}.dat" for r in engine.segments().select("segment_id").orderBy("segment_id").collect()]}
    for op, rows in shown.items():
        if not parsed.filter(F.col("op") == op).isEmpty():
            out = out.withColumn("value", F.when(F.col("op") == op, F.lit("\n".join(rows()))).otherwise(F.col("value")))
    from tidelog.functions.codec import segment_id_of
    from tidelog.operators.index import sparse_index

    wanted = out.filter("op = 'segment-inspect'").select("seq", segment_id_of(F.col("key")).alias("segment_id"))
    if wanted.isEmpty():
        return out
    index = sparse_index(engine.store.entries().join(F.broadcast(wanted.select("segment_id").distinct()), "segment_id", "left_semi"))
    line = F.concat(F.col("key"), F.lit(" @ "), F.col("offset").cast("string"))
    text = index.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    texts = wanted.join(text, "segment_id", "left").select("seq", F.coalesce("text", F.lit("no such segment")).alias("text"))
    return out.join(texts, "seq", "left").withColumn("value", F.coalesce("value", "text")).drop("text")
