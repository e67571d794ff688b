"""The log engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import BLOOM_FPR, Config
from tidelog.functions import codec, commands
from tidelog.functions.shared import shared_dir
from tidelog.operators import bloom, compact, index, resolve, segment
from tidelog.plans.store import Engine
from tidelog.sources import oplog

CAPACITY, BULK_CAPACITY = 40, 1024
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]):
    _Q[f.__name__] = f
    return f


@_query
def live_scan(spark, d):
    return resolve.live(oplog.event_log(spark, d))


@_query
def list_keys(spark, d):
    return resolve.list_keys(oplog.event_log(spark, d))


@_query
def tombstoned_keys(spark, d):
    return resolve.tombstoned(oplog.event_log(spark, d))


@_query
def point_get(spark, d):
    return resolve.point_get(oplog.event_log(spark, d), "user:000003")


def _wanted(spark, d) -> DataFrame:
    return oplog.read(spark, d, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))


@_query
def batch_get(spark, d):
    return resolve.batch_get(oplog.event_log(spark, d), _wanted(spark, d))


@_query
def memtable_probe(spark, d):
    assigned = _assigned(spark, d)
    return resolve.probe(segment.memtable_residual(assigned, CAPACITY), _wanted(spark, d))


@_query
def wal_replay(spark, d):
    return resolve.newest(oplog.event_log(spark, d))


@_query
def large_value_state(spark, d):
    return resolve.newest(oplog.large_value_log(spark, d)).select("key", F.octet_length("value").cast("long").alias("n_bytes"), F.md5(F.col("value").cast("binary")).alias("digest"))


@_query
def asof_reads(spark, d):
    return resolve.asof_reads(oplog.session_log(spark, d))


@_query
def session_responses(spark, d):
    return resolve.session_responses(oplog.session_log(spark, d))


def _assigned(spark, d) -> DataFrame:
    return segment.assign_segments(oplog.event_log(spark, d), CAPACITY)


def _entries(spark, d) -> DataFrame:
    return segment.segment_entries(_assigned(spark, d), CAPACITY)


@_query
def segment_assign(spark, d):
    return _assigned(spark, d)


@_query
def segment_entries(spark, d):
    return _entries(spark, d)


@_query
def memtable_residual(spark, d):
    return segment.memtable_residual(_assigned(spark, d), CAPACITY)


@_query
def segment_list(spark, d):
    return segment.segment_list(_entries(spark, d))


@_query
def bulk_segments(spark, d):
    return segment.segment_list(segment.bulk_segments(oplog.bulk_log(spark, d), BULK_CAPACITY))


@_query
def segment_ids(spark, d):
    """Paths made from ids, and ids read back from paths, proper and not."""
    ids = oplog.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    path = F.when(F.col("id") % 5 == 0, F.concat(F.lit("data/segment"), F.col("id").cast("string"), F.lit(".dat"))).otherwise(F.concat(F.lit("data/segment-"), F.col("id").cast("string"), F.lit(".dat")))
    return ids.select("id", path.alias("path")).select("id", "path", codec.segment_id_of(F.col("path")).alias("segment_id"))


@_query
def encode_entries(spark, d):
    return _entries(spark, d).select("segment_id", "key", F.hex(codec.encode_record()).alias("record"), codec.stride().alias("stride"))


@_query
def entry_offsets(spark, d):
    return index.entry_offsets(_entries(spark, d)).select("segment_id", "key", "idx", "stride", "offset")


@_query
def sparse_index(spark, d):
    return index.sparse_index(_entries(spark, d))


@_query
def segment_inspect(spark, d):
    return index.segment_inspect(index.sparse_index(_entries(spark, d)), 2)


def _probes(spark, d) -> DataFrame:
    """Every written key, asked of the segment before the one that it went to."""
    return _assigned(spark, d).select((F.col("segment_id") - 1).alias("segment_id"), "key").filter("segment_id > 0").distinct()


@_query
def byte_range(spark, d):
    return index.byte_range(index.sparse_index(_entries(spark, d)), _probes(spark, d))


@_query
def bounded_lookup(spark, d):
    entries = _entries(spark, d)
    return index.bounded_lookup(entries, index.sparse_index(entries), _probes(spark, d))


@_query
def bloom_probe(spark, d):
    """Of keys in each bulk segment, and of as many that aren't, how many its filter lets through; every third is asked three times."""
    entries = segment.bulk_segments(oplog.bulk_log(spark, d), BULK_CAPACITY)
    there = entries.select("segment_id", "key", "seq", F.lit(True).alias("present"))
    asked = there.unionByName(entries.select("segment_id", F.concat("key", F.lit("?")).alias("key"), "seq", F.lit(False).alias("present")))
    again = F.explode(F.when(F.col("seq") % 3 == 0, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0))))
    asked = asked.select("segment_id", "key", "present", again.alias("turn")).drop("turn")
    found = bloom.maybe_contains(*bloom.build(entries), asked)
    return found.groupBy("segment_id", "present").agg(F.count("*").alias("asked"), F.sum(F.col("maybe").cast("long")).alias("passed"))


@_query
def compact_pair(spark, d):
    entries = _entries(spark, d)
    return compact.merge_pair(entries.filter("segment_id = 1"), entries.filter("segment_id = 2"))


@_query
def compact_rounds(spark, d):
    return compact.compact(_entries(spark, d), 3)


@_query
def compact_all(spark, d):
    return compact.merge_runs(_entries(spark, d))


@_query
def compact_purge(spark, d):
    return compact.merge_runs(_entries(spark, d), purge=True)


def _client_lines(spark, d) -> DataFrame:
    k, t = F.col("user_id").cast("string"), F.col("event_type")
    n = F.col("event_id") % 7
    line = (
        F.when(t == "error", F.concat(F.lit("delete "), k))
        .when(t == "view", F.concat(F.lit("GET  User "), k, F.lit("\n")))
        .when(n == 0, F.concat(F.lit("set  ="), k))
        .when(n == 1, F.concat(F.lit("Set User "), k, F.lit(" = "), "props", F.lit("\n")))
        .when(n == 2, F.concat(F.lit("set "), k, F.lit("=\n")))
        .when(n == 3, F.concat(F.lit("set "), k, F.lit("=a=b")))
        .when(n == 4, F.lit("exitfoo"))
        .when(n == 5, F.concat(F.lit("get "), k))
        .otherwise(F.lit(""))
    )
    return oplog.read(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("line"))


@_query
def parse_client(spark, d):
    return commands.parse_client(_client_lines(spark, d))


def _repl_lines(spark, d) -> DataFrame:
    k, t = F.col("user_id").cast("string"), F.col("event_type")
    n = F.col("event_id") % 7
    line = (
        F.when(t == "error", F.concat(F.lit(" del User"), k, F.lit("\n")))
        .when(t == "view", F.concat(F.lit("GET User"), k))
        .when(n == 0, F.concat(F.lit("set  "), k))
        .when(n == 1, F.concat(F.lit("SET User"), k, F.lit(" V"), k))
        .when(n == 2, F.lit("segment-inspect segment-1.dat"))
        .when(n == 3, F.lit("List"))
        .when(n == 4, F.lit("exitfoo"))
        .when(n == 5, F.lit("segment-list"))
        .otherwise(F.concat(F.lit("set "), k, F.lit("  v")))
    )
    return oplog.read(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("line"))


@_query
def parse_repl(spark, d):
    return commands.parse_repl(_repl_lines(spark, d))


@_query
def parse_assignment(spark, d):
    e = oplog.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit(" user "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(" = "), F.col("props")).alias("text"))
    return e.select("seq", commands.parse_assignment(F.col("text")).alias("a")).select("seq", F.col("a.key").alias("key"), F.col("a.value").alias("value"))


@_query
def wire_requests(spark, d):
    return oplog.session_log(spark, d).select("seq", F.hex(codec.encode_request()).alias("frame"))


@_query
def wire_responses(spark, d):
    session = oplog.session_log(spark, d)
    ops = session.select("seq", "op")
    answers = resolve.session_responses(session).join(ops, "seq")
    return answers.select("seq", F.hex(codec.encode_response(F.col("op"), F.col("outcome"), F.col("value"))).alias("frame"))


def _store(spark, d, batches: int) -> Engine:
    """A store in the shared folder that took the events in so many batches, each of rows from all over the log: most come late."""
    engine = Engine(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", Config(capacity=CAPACITY))
    log = oplog.event_log(spark, d)
    for k in range(batches):
        engine.store.append(log.filter(F.col("seq") % batches == batches - 1 - k), "events", k)
    return engine


@_query
def store_segments(spark, d):
    """What one batch was cut into, as the store has it."""
    return _store(spark, d, 1).segments()


@_query
def store_state(spark, d):
    """Live pairs of three batches, the three oldest segments compacted."""
    engine = _store(spark, d, 3)
    engine.compact(2)
    return engine.state()


@_query
def store_get(spark, d):
    return _store(spark, d, 2).batch_get(_wanted(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


_USER = "'user:' || lpad(user_id::varchar, 6, '0')"
_LOG = f"log as (select event_id as seq, {_USER} as key, case when event_type <> 'error' then props end as value, event_type = 'error' as tombstone from events)"
_SESSION = f"ses as (select event_id as seq, case when event_type in ('purchase', 'signup') then 'set' when event_type = 'error' then 'delete' else 'get' end as op, {_USER} as key, case when event_type in ('purchase', 'signup') then props end as value from events)"
_NEW = "new as (select key, value, tombstone from (select *, row_number() over (partition by key order by seq desc) as rn from log) where rn = 1)"
_WANTED = "wanted as (select 'user:' || lpad(c_custkey::varchar, 6, '0') as key from customer)"
_THREE = "case when n.tombstone is null then 'absent' when n.tombstone then 'tombstone' else 'value' end as state, n.value"
_CUT = f"""{_LOG},
prv as (select *, lag(seq) over (partition by key order by seq) as p from log),
bounds as (
  select 1::bigint as segment_id, (select min(seq) from log) as s, (select max(seq) from log) as last
  union all
  select b.segment_id + 1, (select min(seq) + 1 from (select seq, tombstone, sum(case when p is null or p < b.s then 1 else 0 end) over (order by seq) as dc from prv where seq >= b.s) where dc >= {CAPACITY} and not tombstone), b.last
  from bounds b where b.s is not null and b.s <= b.last),
cut as (select l.*, b.segment_id from log l asof join (select * from bounds where s is not null) b on l.seq >= b.s),
ent0 as (select segment_id, key, value, tombstone, seq from (select *, row_number() over (partition by segment_id, key order by seq desc) as rn from cut) where rn = 1),
done as (select segment_id, count(*) >= {CAPACITY} and not arg_max(tombstone, seq) as closed from ent0 group by segment_id),
ent as (select e.segment_id, key, value, tombstone from ent0 e join done using (segment_id) where closed)"""
_STRIDE = "octet_length(encode(key)) + case when tombstone then 5 else octet_length(encode(value)) + 9 end"
_OFF = f"off as (select *, row_number() over w - 1 as idx, ({_STRIDE})::bigint as stride, coalesce(sum({_STRIDE}) over (partition by segment_id order by key rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from ent window w as (partition by segment_id order by key))"
_IDX = f"{_OFF}, idxs as (select segment_id, key, \"offset\" from off where idx % 4 = 0)"
_PROBES = "probes as (select distinct segment_id - 1 as segment_id, key from cut where segment_id > 1)"
_RANGE = "rng as (select p.segment_id, p.key, max(i.\"offset\") filter (i.key <= p.key) as \"start\", min(i.\"offset\") filter (i.key > p.key) as \"end\" from probes p left join idxs i using (segment_id) group by 1, 2)"
_BULK = f"bulk as (select c_custkey as seq, c_name as key, c_mktsegment as value, false as tombstone, (row_number() over (order by c_custkey) - 1) // {BULK_CAPACITY} + 1 as segment_id from customer)"
_LIST = f"select segment_id, count(*) as entries, min(key) as min_key, max(key) as max_key, sum(tombstone::int)::bigint as tombstones, sum({_STRIDE})::bigint as bytes from {{}} group by segment_id"
_ASOF = """answered as (select r.seq, r.key, case when w.op = 'set' then 'ok' else 'not_found' end as outcome, case when w.op = 'set' then w.value end as value
  from (select * from ses where op = 'get') r asof left join (select * from ses where op <> 'get') w on r.key = w.key and r.seq > w.seq)"""
_SIZED = "printf('%08X', octet_length(encode({0}))) || hex(encode({0}))"
_K, _V = _SIZED.format("key"), _SIZED.format("value")
_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_CLIENT = f"""with l as (select event_id as seq, case when event_type = 'error' then 'delete ' || user_id
  when event_type = 'view' then 'GET  User ' || user_id || chr(10) when event_id % 7 = 0 then 'set  =' || user_id
  when event_id % 7 = 1 then 'Set User ' || user_id || ' = ' || props || chr(10) when event_id % 7 = 2 then 'set ' || user_id || '=' || chr(10)
  when event_id % 7 = 3 then 'set ' || user_id || '=a=b' when event_id % 7 = 4 then 'exitfoo' when event_id % 7 = 5 then 'get ' || user_id else '' end as line from events),
c as (select *, case when lower(line[1:3]) in ('get', 'set') and line[4:4] in (' ', chr(9)) then 3 when lower(line[1:6]) = 'delete' and line[7:7] in (' ', chr(9)) then 6 end as n from l),
r as (select *, lower(line[1:n]) as verb, ltrim(line[n + 1:], ' ' || chr(9)) as rest from c),
o as (select *, case when verb in ('get', 'delete') then verb when verb = 'set' and instr(rest, '=') > 1 and split_part(rest, '=', 2) <> '' then 'set' when lower(line[1:4]) = 'exit' then 'exit' else 'invalid' end as op from r)
select seq, line, op, case when op in ('get', 'delete') then {_trim('rest')} when op = 'set' then {_trim("split_part(rest, '=', 1)")} end as key,
  case when op = 'set' then {_trim("split_part(rest, '=', 2)")} end as value from o"""
_REPL = f"""with l as (select event_id as seq, case when event_type = 'error' then ' del User' || user_id || chr(10) when event_type = 'view' then 'GET User' || user_id
  when event_id % 7 = 0 then 'set  ' || user_id when event_id % 7 = 1 then 'SET User' || user_id || ' V' || user_id when event_id % 7 = 2 then 'segment-inspect segment-1.dat'
  when event_id % 7 = 3 then 'List' when event_id % 7 = 4 then 'exitfoo' when event_id % 7 = 5 then 'segment-list' else 'set ' || user_id || '  v' end as line from events),
w as (select *, string_split(lower({_trim('line')}), ' ') as ws from l),
o as (select *, case when (ws[1] = 'set' and len(ws) = 3) or (ws[1] = 'get' and len(ws) = 2) or (ws[1] in ('list', 'segment-list', 'exit') and len(ws) = 1) or (ws[1] = 'segment-inspect' and len(ws) = 2) then ws[1]
  when ws[1] = 'del' and len(ws) = 2 then 'delete' else 'invalid' end as op from w)
select seq, line, op, case when op in ('set', 'get', 'delete', 'segment-inspect') then ws[2] end as key, case when op = 'set' then ws[3] end as value from o"""
_K_HASHES = bloom.hashes()
_BLOOM = f"""with {_BULK}, sizes as (select segment_id, greatest(ceil(count(*) * {-math.log(BLOOM_FPR) / math.log(2) ** 2!r})::bigint, 8) as bits from bulk group by 1),
pos as (select b.segment_id, b.key, present, case when seq % 3 = 0 then 3 else 1 end as times, unnest(list_distinct(list_transform(range({_K_HASHES}), lambda i: (('0x' || substr(md5(b.key), 1, 8))::bigint + i * ('0x' || substr(md5(b.key), 9, 8))::bigint) % bits))) as bit
  from (select segment_id, key, seq, true as present from bulk union all select segment_id, key || '?', seq, false from bulk) b join sizes using (segment_id)),
setb as (select distinct segment_id, bit from pos where present),
hit as (select p.segment_id, p.key, p.present, p.times, count(*) = count(s.bit) as maybe from pos p left join setb s on p.segment_id = s.segment_id and p.bit = s.bit group by all)
select segment_id, present, sum(times)::bigint as asked, sum(maybe::int * times)::bigint as passed from hit group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    rec = f"case when tombstone then '02' || {_K} else '01' || {_K} || {_V} end"
    merged = "select key, value, tombstone from (select *, row_number() over (partition by key order by segment_id desc) as rn from ent {}) where rn = 1"
    cut = f"with recursive {_CUT}"
    responses = "select * from answered union all select seq, key, 'ok', null from ses where op <> 'get'"
    return {
        "live_scan": f"with {_LOG}, {_NEW} select key, value from new where not tombstone",
        "list_keys": f"with {_LOG}, {_NEW} select key from new where not tombstone order by key",
        "tombstoned_keys": f"with {_LOG}, {_NEW} select key from new where tombstone",
        "point_get": f"with {_LOG}, {_NEW} select key, value from new where not tombstone and key = 'user:000003'",
        "batch_get": f"with {_LOG}, {_NEW}, {_WANTED} select w.key, {_THREE} from wanted w left join new n on n.key = w.key",
        "memtable_probe": f"{cut}, {_WANTED}, res as (select e.* from ent0 e join done using (segment_id) where not closed) select w.key, {_THREE} from wanted w left join res n on n.key = w.key",
        "wal_replay": f"with {_LOG}, {_NEW} select * from new",
        "large_value_state": "select source as key, octet_length(encode(arg_max(text, doc_id)))::bigint as n_bytes, md5(arg_max(text, doc_id)) as digest from documents group by source",
        "asof_reads": f"with {_SESSION}, {_ASOF} select * from answered",
        "session_responses": f"with {_SESSION}, {_ASOF} {responses}",
        "segment_assign": f"{cut} select seq, key, value, tombstone, segment_id from cut",
        "segment_entries": f"{cut} select segment_id, key, value, tombstone from ent",
        "memtable_residual": f"{cut} select key, value, tombstone from ent0 join done using (segment_id) where not closed",
        "segment_list": f"{cut} {_LIST.format('ent')}",
        "bulk_segments": f"with {_BULK} {_LIST.format('bulk')}",
        "segment_ids": "with p as (select c_custkey as id, case when c_custkey % 5 = 0 then 'data/segment' else 'data/segment-' end || c_custkey || '.dat' as path from customer) select id, path, try_cast(nullif(regexp_extract(path, '(?:^|/)segment-([0-9]+)\\.dat$', 1), '') as bigint) as segment_id from p",
        "encode_entries": f"{cut} select segment_id, key, {rec} as record, ({_STRIDE})::bigint as stride from ent",
        "entry_offsets": f"{cut}, {_OFF} select segment_id, key, idx, stride, \"offset\" from off",
        "sparse_index": f"{cut}, {_IDX} select * from idxs",
        "segment_inspect": f"{cut}, {_IDX} select key, \"offset\" from idxs where segment_id = 2 order by key",
        "byte_range": f"{cut}, {_IDX}, {_PROBES}, {_RANGE} select * from rng",
        "bounded_lookup": f"{cut}, {_IDX}, {_PROBES}, {_RANGE}, n as (select o.*, r.segment_id as sid, r.key as k from rng r left join off o on o.segment_id = r.segment_id and o.key = r.key and o.\"offset\" >= coalesce(r.\"start\", 0) and (r.\"end\" is null or o.\"offset\" < r.\"end\")) select sid as segment_id, k as key, {_THREE} from n",
        "bloom_probe": _BLOOM,
        "compact_pair": f"{cut}, a as (select * from ent where segment_id = 1), b as (select * from ent where segment_id = 2) select coalesce(b.key, a.key) as key, case when b.key is null then a.value else b.value end as value, case when b.key is null then a.tombstone else b.tombstone end as tombstone from a full join b on a.key = b.key",
        "compact_rounds": f"{cut}, o as (select segment_id from (select distinct segment_id from ent) order by 1 limit 4), top as (select max(segment_id) as t from o) select (select t from top) as segment_id, * from ({merged.format('where segment_id <= (select t from top)')}) union all select segment_id, key, value, tombstone from ent where segment_id > (select t from top)",
        "compact_all": f"{cut} {merged.format('')}",
        "store_segments": f"{cut} {_LIST.format('ent')}",
        "store_state": f"with {_LOG}, {_NEW} select key, value from new where not tombstone",
        "store_get": f"with {_LOG}, {_NEW}, {_WANTED} select w.key, {_THREE} from wanted w left join new n on n.key = w.key",
        "compact_purge": f"{cut} select * from ({merged.format('')}) where not tombstone",
        "parse_client": _CLIENT,
        "parse_repl": _REPL,
        "parse_assignment": f"with e as (select event_id as seq, ' user ' || user_id || case when event_id % 3 = 0 then '' else ' = ' end || props as text from events) select seq, case when instr(text, '=') > 0 then {_trim('substr(text, 1, instr(text, chr(61)) - 1)')} end as key, case when instr(text, '=') > 0 then {_trim('substr(text, instr(text, chr(61)) + 1)')} end as value from e",
        "wire_requests": f"with {_SESSION} select seq, case op when 'get' then '01' || {_K} when 'set' then '02' || {_K} || {_V} else '03' || {_K} end as frame from ses",
        "wire_responses": f"with {_SESSION}, {_ASOF}, r as ({responses}) select r.seq, case when s.op = 'get' and r.outcome = 'ok' then '01' || {_SIZED.format('r.value')} when r.outcome = 'ok' then '01' else '02' end as frame from r join ses s using (seq)",
    }
