"""Record and wire formats as binary columns: JVM expressions for encoding, a byte-level decoder for files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import CorruptRecord, TooLarge

MOST = 0xFFFFFFFF
SET, DELETE = 1, 2  # on disk
WIRE = {"get": 1, "set": 2, "delete": 3}
OUTCOME = {"failed": 0, "ok": 1, "not_found": 2}


def stride(key: str = "key", value: str = "value", tombstone: str = "tombstone") -> Column:
    """Bytes of an entry's record."""
    return F.octet_length(key).cast("long") + F.when(F.col(tombstone), F.lit(5)).otherwise(F.octet_length(value).cast("long") + 9)


def too_large(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.coalesce(F.octet_length(n).cast("long"), F.lit(0)) > MOST)
    return out


def _byte(n: int) -> Column:
    return F.unhex(F.lit(f"{n:02X}"))


def sized(text: Column) -> Column:
    """Big-endian 32-bit byte length, then the bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")), F.encode(text, "UTF-8"))


def encode_record(key: str = "key", value: str = "value", tombstone: str = "tombstone") -> Column:
    k = sized(F.col(key))
    return F.when(F.col(tombstone), F.concat(_byte(DELETE), k)).otherwise(F.concat(_byte(SET), k, sized(F.col(value))))


def encode_request(op: str = "op", key: str = "key", value: str = "value") -> Column:
    k, o = sized(F.col(key)), F.col(op)
    return F.when(o == "get", F.concat(_byte(WIRE["get"]), k)).when(o == "set", F.concat(_byte(WIRE["set"]), k, sized(F.col(value)))).when(o == "delete", F.concat(_byte(WIRE["delete"]), k))


def encode_response(op: Column, outcome: Column, value: Column) -> Column:
    """A get that hits has its value behind the outcome; every other response is one byte."""
    hit = (op == "get") & (outcome == "ok")
    return F.when(hit, F.concat(_byte(OUTCOME["ok"]), sized(value))).when(outcome == "ok", _byte(OUTCOME["ok"])).when(outcome == "not_found", _byte(OUTCOME["not_found"])).otherwise(_byte(OUTCOME["failed"]))


def pack_text(text: str, part: str, most: int = MOST) -> bytes:
    raw = text.encode()
    if len(raw) > most:
        raise TooLarge(part, len(raw), most)
    return struct.pack(">I", len(raw)) + raw


def pack_record(key: str, value: str | None, most: int = MOST) -> bytes:
    """One record; both lengths are checked before any byte is made."""
    head = pack_text(key, "key", most)
    return bytes([DELETE]) + head if value is None else bytes([SET]) + head + pack_text(value, "value", most)


def decode_records(data: bytes, strict: bool = False) -> Iterator[tuple[str, str | None, bool, int]]:
    """(key, value, tombstone, offset). A torn or unknown record ends reading, or raises if strict."""
    return read_records(io.BytesIO(data), len(data), strict)


def read_records(file: BinaryIO, size: int, strict: bool = False) -> Iterator[tuple[str, str | None, bool, int]]:
    """decode_records of a file of so many bytes, a record at a time: its size doesn't matter, and a length beyond its end is not believed."""
    at = begin = 0

    def take(n: int) -> bytes:
        nonlocal at
        got = file.read(n) if n <= size - at else b""
        if len(got) < n:
            raise CorruptRecord(f"the record at byte {begin} ends early")
        at += n
        return got

    def text() -> str:
        return take(struct.unpack(">I", take(4))[0]).decode()

    while at < size:
        begin = at
        try:
            tag = take(1)[0]
            if tag not in (SET, DELETE):
                raise CorruptRecord(f"unknown tag {tag} at byte {begin}")
            key, value = text(), text() if tag == SET else None
        except (CorruptRecord, UnicodeDecodeError) as e:
            if strict:
                raise e if isinstance(e, CorruptRecord) else CorruptRecord(f"the record at byte {begin} isn't UTF-8") from e
            return
        yield key, value, tag == DELETE, begin


def segment_name(segment_id: int) -> str:
    return f"segment-{segment_id}.dat"


def segment_id_of(path: Column) -> Column:
    """The id in a path's last part, null where it isn't a segment's; ids compare as numbers."""
    found = F.regexp_extract(path, r"(?:^|/)segment-([0-9]+)\.dat$", 1)
    n = found.try_cast("bigint")
    return F.when((found != "") & (n <= MOST), n)
