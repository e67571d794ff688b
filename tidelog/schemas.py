"""Explicit schemas: keys and values are opaque UTF-8 strings, compared by bytes; a null value with tombstone set is a delete."""

from __future__ import annotations

OP_LOG = "seq bigint not null, key string not null, value string, tombstone boolean not null"
SEGMENT = "segment_id bigint, key string, value string, tombstone boolean"
INDEX = "segment_id bigint, key string, offset bigint"
REQUEST = "seq bigint, op string, key string, value string"
RESPONSE = "seq bigint, key string, outcome string, value string"
MANIFEST_SEGMENT = ("segment_id", "path", "entries")
