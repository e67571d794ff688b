"""The two command grammars as columns: a line becomes (op, key, value), op `invalid` where the grammar has no match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's \s with (?U) is Unicode white space.
_ENDS = r"(?U)^\s+|\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


CLIENT_GET = r"(?is)^get[ \t]+(.*)$"
CLIENT_SET = r"(?is)^set[ \t]+([^= \t][^=]*)=([^=]+)"
CLIENT_DELETE = r"(?is)^delete[ \t]+(.*)$"
CLIENT_EXIT = r"(?is)^exit"


def parse_client(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with op, key and value by the client's grammar; the case of keys and values stays. A null line is invalid."""
    t = F.coalesce(F.col(line), F.lit(""))
    is_get, is_set, is_delete = (t.rlike(p) for p in (CLIENT_GET, CLIENT_SET, CLIENT_DELETE))
    op = F.when(is_get, "get").when(is_set, "set").when(is_delete, "delete").when(t.rlike(CLIENT_EXIT), "exit").otherwise("invalid")
    key = F.when(is_get, F.regexp_extract(t, CLIENT_GET, 1)).when(is_set, F.regexp_extract(t, CLIENT_SET, 1)).when(is_delete, F.regexp_extract(t, CLIENT_DELETE, 1))
    value = F.when(~is_get & is_set, F.regexp_extract(t, CLIENT_SET, 2))
    return lines.select("*", op.alias("op"), trimmed(key).alias("key"), trimmed(value).alias("value"))


#: Verb to its number of arguments.
REPL = {"set": 2, "get": 1, "del": 1, "list": 0, "segment-list": 0, "segment-inspect": 1, "exit": 0}


def parse_repl(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with op, key and value by the shell's grammar: trimmed, lower case throughout, cut at single spaces."""
    words = F.split(F.lower(trimmed(F.coalesce(F.col(line), F.lit("")))), " ")
    verb, n = words[0], F.size(words) - 1
    op = F.lit("invalid")
    for name, args in REPL.items():
        op = F.when((verb == name) & (n == args), "delete" if name == "del" else name).otherwise(op)
    key = F.when(op.isin("set", "get", "delete", "segment-inspect"), F.get(words, F.lit(1)))
    return lines.select("*", op.alias("op"), key.alias("key"), F.when(op == "set", F.get(words, F.lit(2))).alias("value"))


def parse_assignment(text: Column) -> Column:
    """struct<key, value> of text cut at its first `=`, both trimmed; null where there is none."""
    at = F.instr(text, "=")
    both = F.struct(trimmed(F.substring_index(text, "=", 1)).alias("key"), trimmed(F.substring(text, at + 1, F.length(text))).alias("value"))
    return F.when(at > 0, both)
