"""One query for each operator, with SQL written independently for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, scalar
from ..operators import cache, check, era, islands, rangejoin, repair, thin
from ..sinks import text
from ..streaming import era_tracker
from . import views as V

QUERIES, ORACLES = {}, {}

#: The derived relations for the SQL twins.
VIEWS = """with m as (
  select dev_id, thin_block, case when priv = 1 then thin_block + 400000 * (dev_id + 1) else thin_block end as data_block,
         cast(case when priv = 1 then 1 + dev_id else 0 end as bigint) as map_time
  from (select l_suppkey % 6 as dev_id, l_orderkey as thin_block, max(case when l_linenumber >= 6 then 1 else 0 end) as priv
        from lineitem group by all) x),
d as (select dev_id, count(*) + case when dev_id = 5 then 3 else 0 end as mapped_blocks, dev_id + 1 as transaction_id, dev_id as creation_time, dev_id as snapshotted_time from m group by dev_id),
rc as (select data_block, count(*) as ref_count from m group by data_block),
disk as (select data_block, ref_count + case when data_block % 997 = 0 then 1 else 0 end as ref_count from rc
         union all select 2800000 + p_partkey, 1 from part where p_size <= 5),
buys as (select extract(day from ts) as era, event_id % 2000 as block from events where event_type = 'purchase'),
ws as (select distinct era, block from buys where era >= 15),
ea as (select u.block, cast(coalesce(max(b.era), 0) as bigint) as era from (select distinct event_id % 2000 as block from events) u
       left join (select * from buys where era < 15) b on u.block = b.block group by u.block),
c as (select o_orderkey as cblock, case when o_orderstatus = 'P' then 0 when o_orderkey % 101 = 0 then o_orderkey - 1 else o_orderkey end as oblock,
             case when o_orderstatus = 'P' then 0 else 1 end as is_valid,
             case when o_orderstatus <> 'P' and o_totalprice > 200000 then 1 else 0 end as is_dirty
      from orders where o_orderkey > 0)
"""


def runs_sql(source: str, keys: str, pos: str, extra: str = "") -> str:
    """Islands of pos within keys."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    return f"(select {k}min({pos}) as b, count(*) as n{extra} from (select *, {pos} - row_number() over ({part}order by {pos}) as g from {source}) group by {k}g)"


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (VIEWS + ("" if sql.lstrip().startswith(",") else " ") + sql) if views else sql
        return f

    return add


USED = "(select *, data_block in (select data_block from rc where ref_count > 1) as shared from m)"
FREE = """(select lag(data_block, 1, -1) over (order by data_block) + 1 as b, data_block as e from
           (select distinct data_block from {source} where data_block < {n} union all select {n}))"""
MOVES = """, above as (select data_block as src, row_number() over (order by data_block) as r from (select distinct data_block from m where data_block >= 400000)),
free as (select f.range as dst, row_number() over (order by f.range) as r from range(0, 400000) f where f.range not in (select data_block from m)),
moves as (select src, dst from above join free using (r))
"""


# --- sources and columns -------------------------------------------------------------------------------------------

@query("select dev_id, (data_block << 24) | map_time as packed, data_block, map_time as t from m")
def fn_bt(spark, d):
    """Pack and unpack of block and time."""
    from .. import schema

    x = V.thin_mappings(spark, d).withColumn("packed", schema.pack_block_time(F.col("data_block"), F.col("map_time")))
    block, time = schema.unpack_block_time(F.col("packed"))
    return x.select("dev_id", "packed", block.alias("data_block"), time.alias("t"))


@query("select cblock, (oblock << 16) | (is_valid + 2 * is_dirty) as packed, oblock, is_valid + 2 * is_dirty as flags from c")
def fn_cache_mapping(spark, d):
    from .. import schema

    flags = (F.col("is_valid") + 2 * F.col("is_dirty")).cast("long")
    x = V.cache_mappings(spark, d).withColumn("packed", schema.pack_cache_mapping(F.col("oblock"), flags))
    oblock, f = schema.unpack_cache_mapping(F.col("packed"))
    return x.select("cblock", "packed", oblock.alias("oblock"), f.alias("flags"))


@query("select data_block, map_time as t from m where dev_id = 1 and thin_block = (select min(thin_block) from m where dev_id = 1)")
def src_lookup(spark, d):
    """Point lookup by key."""
    x = V.thin_mappings(spark, d).filter("dev_id = 1")
    return x.join(F.broadcast(x.agg(F.min("thin_block").alias("thin_block"))), "thin_block").select("data_block", F.col("map_time").alias("t"))


@query("select block // 64 as w, block % 64 as b, era from ws")
def src_bitset(spark, d):
    """Bits of writesets, packed in words of 64 and unpacked."""
    words = V.era_writesets(spark, d).groupBy("era", islands.div(F.col("block"), 64).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("block") % 64).cast("int"))).alias("word"))
    bits = words.select("w", "era", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return bits.filter(F.call_function("bit_get", F.col("word"), F.col("b")) == 1).select("w", F.col("b").cast("long").alias("b"), "era")


@query("select data_block as block, ref_count from disk")
def src_sm(spark, d):
    """Two-bit counts with overflow lookup."""
    disk = V.disk_ref_counts(spark, d)
    small = disk.select(F.col("data_block").alias("block"), F.least("ref_count", F.lit(3)).alias("bits"))
    return check.overflow_counts(small, disk.filter("ref_count >= 3").select(F.col("data_block").alias("block"), "ref_count"))


@query("select b.block, case when b.bits = 3 then o.ref_count else b.bits end as n from (select data_block as block, least(ref_count, 3) as bits from disk) b left join (select * from disk where ref_count >= 3) o on b.block = o.data_block where b.bits = 3")
def op_overflow_join(spark, d):
    disk = V.disk_ref_counts(spark, d)
    small = disk.select(F.col("data_block").alias("block"), F.least("ref_count", F.lit(3)).alias("bits")).filter("bits = 3")
    return check.overflow_counts(small, disk.filter("ref_count >= 3").select(F.col("data_block").alias("block"), "ref_count")).withColumnRenamed("ref_count", "n")


_LS = f"select dev_id, count(*) as mapped, sum(case when shared then 0 else 1 end) as exclusive, sum(case when shared then 1 else 0 end) as shared, max(thin_block) as highest from {USED} group by dev_id"


@query(f"select dev_id, cast(mapped as bigint) as mapped, cast(exclusive as bigint) as exclusive, cast(shared as bigint) as shared, highest from ({_LS})")
def op_ls(spark, d):
    return thin.usage(V.thin_mappings(spark, d))


def _pretty_sql(b: str) -> str:
    """Bytes under 2^40 as printed."""
    up = lambda x, unit: f"cast(cast(floor(({x}) / 1024.0 + 0.5) as bigint) as varchar) || '{unit}'"
    step = lambda x, small, large: f"case when {x} > 8192 then {up(x, large)} else cast({x} as varchar) || '{small}' end"
    return f"case when {b} < 1048576 then {step(b, 'b', 'KiB')} when {b} < 1073741824 then {step(f'({b} >> 10)', 'KiB', 'MiB')} else {step(f'({b} >> 20)', 'MiB', 'GiB')} end"


LS_FIELDS = ["DEV", *(f"{n}{u}" for n in ("MAPPED", "EXCLUSIVE", "SHARED") for u in ("_BLOCKS", "_SECTORS", "_BYTES", "")),
             "HIGHEST_BLOCK", "HIGHEST_SECTOR", "HIGHEST_BYTE", "HIGHEST_MAPPED", "TRANSACTION", "CREATE_TIME", "SNAP_TIME"]
_LS_COUNTS = ", ".join(f"{c} as {n}_BLOCKS, {c} * 128 as {n}_SECTORS, {c} * 65536 as {n}_BYTES, {_pretty_sql(f'({c} * 65536)')} as {n}" for n, c in (("MAPPED", "mapped"), ("EXCLUSIVE", "exclusive"), ("SHARED", "shared")))


@query(f"""select dev_id as DEV, {_LS_COUNTS}, highest as HIGHEST_BLOCK, (highest + 1) * 128 - 1 as HIGHEST_SECTOR, (highest + 1) * 65536 - 1 as HIGHEST_BYTE,
 {_pretty_sql("((highest + 1) * 65536)")} as HIGHEST_MAPPED, transaction_id as "TRANSACTION", creation_time as CREATE_TIME, snapshotted_time as SNAP_TIME
 from (select d.*, mapped, cast(exclusive as bigint) as exclusive, cast(shared as bigint) as shared, highest from d join ({_LS}) u using (dev_id))""")
def op_ls_project(spark, d):
    """All fields of a listing."""
    return thin.listing(V.thin_devices(spark, d), V.thin_mappings(spark, d), LS_FIELDS, V.BLOCK_SECTORS)


@query("select dev_id as DEV, creation_time as CREATE_TIME from d")
def op_skip_mappings(spark, d):
    """Detail fields only: no mapping scan."""
    return thin.listing(V.thin_devices(spark, d), None, ["DEV", "CREATE_TIME"])


@query("select * from m where dev_id in (1, 4, 99)")
def op_dev_filter(spark, d):
    return thin.select_devices(V.thin_mappings(spark, d), [1, 4, 99])


@query("select * from m where data_block between 100 and 899 or data_block between 500 and 1499 or data_block between 400000 and 400999")
def op_region_filter(spark, d):
    return thin.in_regions(V.thin_mappings(spark, d), [(100, 900), (500, 1500), (400000, 401000)])


@query("select cast(5 as bigint) as transaction, cast(3000000 as bigint) as nr_data_blocks, cast(256 as bigint) as data_block_size")
def op_override(spark, d):
    sb = spark.range(1).selectExpr("2L as transaction", "3000000L as nr_data_blocks", "128L as data_block_size")
    return repair.override(sb, transaction=5, nr_data_blocks=1000, data_block_size=256)


# --- joins ---------------------------------------------------------------------------------------------------------

_DELTA = """, a as (select thin_block, data_block as l from m where dev_id = 1), b as (select thin_block, data_block as r from m where dev_id = 2),
x as (select coalesce(a.thin_block, b.thin_block) as thin_block, l, r, case when r is null then 'left_only' when l is null then 'right_only' when l = r then 'same' else 'differ' end as kind
      from a full join b on a.thin_block = b.thin_block)
"""


@query(_DELTA + "select thin_block, l as left_data, r as right_data, kind from x")
def op_delta(spark, d):
    return thin.delta_blocks(V.thin_mappings(spark, d), 1, 2)


@query(_DELTA + "select kind, b as thin_begin, n as len from " + runs_sql("x", "kind", "thin_block"))
def op_delta_runs(spark, d):
    return thin.delta(V.thin_mappings(spark, d), 1, 2)


@query(_DELTA + "select kind, b as thin_begin, n as len, l as left_data, r as right_data from " + runs_sql("x", "kind", "thin_block", ", arg_min(struct_pack(l := l, r := r), thin_block).l as l, arg_min(struct_pack(l := l, r := r), thin_block).r as r"))
def op_delta_verbose(spark, d):
    return thin.delta(V.thin_mappings(spark, d), 1, 2, verbose=True)


@query("select m.dev_id, thin_block, data_block, map_time, mapped_blocks, transaction_id, creation_time, snapshotted_time from m join d on m.dev_id = d.dev_id")
def op_details_join(spark, d):
    return check.details_join(V.thin_devices(spark, d), V.thin_mappings(spark, d))


@query(f"select * from {USED}")
def op_share_join(spark, d):
    return thin.with_sharing(V.thin_mappings(spark, d))


_DIFF = "(select coalesce(rc.data_block, disk.data_block) as data_block, coalesce(rc.ref_count, 0) as expected, coalesce(disk.ref_count, 0) as actual from rc full join disk on rc.data_block = disk.data_block)"


@query(f"select * from {_DIFF} where expected <> actual")
def op_sm_diff(spark, d):
    return check.space_map_diff(thin.ref_counts(V.thin_mappings(spark, d)), V.disk_ref_counts(spark, d))


@query("select dev_id, thin_block, data_block, map_time from m")
def op_ref_expand(spark, d):
    """Volumes as refs to one def each."""
    m = V.thin_mappings(spark, d)
    defs = m.select(F.concat(F.lit("d"), F.col("dev_id")).alias("def_name"), "thin_block", "data_block", "map_time")
    refs = m.select("dev_id").distinct().selectExpr("dev_id", "concat('d', dev_id) as ref_name", "cast(null as bigint) as thin_block", "cast(null as bigint) as data_block", "cast(null as bigint) as map_time")
    return thin.expand_refs(refs, defs)[0].select("dev_id", "thin_block", "data_block", "map_time")


@query("select dev_id, dev_id * 7 as root from d where dev_id % 2 = 1")
def op_snap_excl(spark, d):
    dev = V.thin_devices(spark, d)
    return check.snapshot_only(dev.select("dev_id", (F.col("dev_id") * 7).alias("root")), dev.select("dev_id", (F.col("dev_id") * 7 + F.col("dev_id") % 2).alias("root")))


@query("select cblock, cblock * 3 as hint from c where is_valid = 1")
def op_hint_join(spark, d):
    c = V.cache_mappings(spark, d)
    return cache.hints_of_valid(c.select("cblock", (F.col("cblock") * 3).alias("hint")), c)


@query("select cblock, oblock, case when cblock % 5 = 0 then true else is_dirty = 1 end as dirty from c where is_valid = 1")
def op_dirty_join(spark, d):
    """A fifth of the bitset is unreadable."""
    c = V.cache_mappings(spark, d)
    return cache.with_dirty(c, c.filter("cblock % 5 <> 0").select("cblock", (F.col("is_dirty") == 1).alias("dirty")))


_PAIRS = """, t as (select dev_id % 3 as root, dev_id, count(*) as mappings from m group by all),
s as (select root, sum(mappings) as total, list_sort(list(distinct dev_id)) as ids from t group by root)
"""


@query(_PAIRS + "select a.root as device_root, b.root + 100 as details_root from s a join s b on a.total = b.total and a.ids = b.ids")
def op_root_pairs(spark, d):
    t = V.thin_mappings(spark, d).groupBy((F.col("dev_id") % 3).alias("root"), "dev_id").agg(F.count("*").alias("mappings"))
    return repair.root_pairs(t, t.withColumn("root", F.col("root") + 100))


def _above(spark, d):
    m = V.thin_mappings(spark, d)
    return m, thin.shrink_remaps(spark, m, V.SHRUNK_BLOCKS)


@query(MOVES + "select src, dst from moves")
def op_rank_align(spark, d):
    r = _above(spark, d)[1].withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    return r.select((F.col("src_begin") + F.col("k")).alias("src"), (F.col("dst_begin") + F.col("k")).alias("dst"))


@query(MOVES + "select m.dev_id, m.thin_block, coalesce(moves.dst, m.data_block) as data_block, m.map_time from m left join moves on m.data_block = moves.src")
def op_remap_overlap(spark, d):
    m, remaps = _above(spark, d)
    moved = thin.remap_runs(thin.dump_runs(m), remaps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    return moved.select("dev_id", (F.col("thin_begin") + F.col("k")).alias("thin_block"), (F.col("data_begin") + F.col("k")).alias("data_block"), "map_time")


@query("select (count(distinct data_block) filter (data_block >= 400000)) as to_move, 400000 - (count(distinct data_block) filter (data_block < 400000)) as free, (count(distinct data_block) filter (data_block >= 400000)) <= 400000 - (count(distinct data_block) filter (data_block < 400000)) as fits from m")
def op_shrink_space(spark, d):
    return thin.insufficient_space(spark, V.thin_mappings(spark, d), V.SHRUNK_BLOCKS)


# --- aggregates ----------------------------------------------------------------------------------------------------

@query("select data_block, ref_count from rc")
def op_refcount(spark, d):
    return thin.ref_counts(V.thin_mappings(spark, d))


@query("select data_block, least(ref_count, 2) as ref_count from rc")
def op_refcount_sat2(spark, d):
    return thin.ref_counts_saturated(V.thin_mappings(spark, d))


@query("select data_block, dev_id, thin_block from (select *, row_number() over (partition by data_block order by dev_id, thin_block) as r from m) where r = 1")
def op_first_seen(spark, d):
    return thin.first_seen(V.thin_mappings(spark, d))


@query(f"select dev_id, min(thin_block) as key_low, max(thin_block) as key_high, count(*) as nr_mappings, cast(sum(case when shared then 1 else 0 end) as bigint) as nr_shared from {USED} group by dev_id")
def op_node_summary(spark, d):
    return thin.node_summary(V.thin_mappings(spark, d))


@query("select ref_count, count(*) as n, count(*) / sum(count(*)) over () * 100 as pct from rc group by ref_count")
def op_rc_hist(spark, d):
    return thin.histogram(thin.ref_counts(V.thin_mappings(spark, d)), "ref_count")


@query("select ref_count, count(*) as n, count(*) / sum(count(*)) over () * 100 as pct from disk group by ref_count")
def op_meta_rc_hist(spark, d):
    return thin.histogram(V.disk_ref_counts(spark, d), "ref_count")


@query("select n as len, count(*) as n from " + runs_sql("(select *, data_block - thin_block as o from m)", "dev_id, o", "thin_block") + " group by len")
def op_run_hist(spark, d):
    return thin.run_histogram(V.thin_mappings(spark, d))


@query("select map_time, count(*) as n from m group by map_time")
def op_time_counts(spark, d):
    return thin.time_counts(V.thin_mappings(spark, d))


def _members(spark, d):
    return V.thin_mappings(spark, d).groupBy((F.col("dev_id") % 2).alias("root"), "dev_id").agg(
        F.count("*").alias("mappings"), F.max("map_time").alias("age"), (F.max("map_time") + 1).alias("tid"), F.max("data_block").alias("highest"))


@query("select dev_id % 2 as root, count(distinct dev_id) as nr_devices, count(*) as nr_mappings, max(map_time) as age, max(map_time) + 1 as tid, max(data_block) as highest from m group by dev_id % 2")
def op_root_stats(spark, d):
    return repair.root_stats(_members(spark, d))


@query("select count(*) as nr_allocated, 3000000 - count(*) as nr_free from disk where ref_count > 0")
def op_alloc_count(spark, d):
    return thin.alloc_counts(V.disk_ref_counts(spark, d), V.POOL_BLOCKS)


_OUT = """, w as (select cblock as src, oblock as dst, case when cblock % 97 = 0 then 'read' when cblock % 89 = 0 then 'write' else 'copied' end as state from c where is_valid = 1 and is_dirty = 1)
"""


def _outcome(spark, d):
    copies = cache.writeback(V.cache_mappings(spark, d), True, 1)
    bad = copies.select("src", F.when(F.col("src") % 97 == 0, "read").when(F.col("src") % 89 == 0, "write").alias("kind")).filter("kind is not null")
    return cache.writeback_outcome(copies, bad)


@query(_OUT + "select count(*) as nr_blocks, count(*) filter (state = 'copied') as nr_copied, count(*) filter (state = 'read') as nr_read_errors, count(*) filter (state = 'write') as nr_write_errors from w")
def op_writeback_stats(spark, d):
    return cache.writeback_stats(_outcome(spark, d))


@query(_OUT + "select cblock, oblock, is_valid, case when cblock in (select src from w where state = 'copied') then 0 else is_dirty end as is_dirty from c")
def op_writeback_clean(spark, d):
    return cache.cleaned(V.cache_mappings(spark, d), _outcome(spark, d)).select("cblock", "oblock", "is_valid", "is_dirty")


# --- ordered operators ---------------------------------------------------------------------------------------------

_OFF = "(select *, data_block - thin_block as o from m)"


@query("select dev_id, b as thin_begin, b + o as data_begin, n as len, map_time from " + runs_sql(_OFF, "dev_id, o, map_time", "thin_block"))
def op_runs_time(spark, d):
    return thin.dump_runs(V.thin_mappings(spark, d))


@query("select dev_id, b as thin_begin, b + o as data_begin, n as len from " + runs_sql(_OFF, "dev_id, o", "thin_block"))
def op_runs(spark, d):
    return thin.runs(V.thin_mappings(spark, d))


_RMAP = "select b as data_begin, b + n as data_end, dev_id, b - o as thin_begin from " + runs_sql(f"(select * from {_OFF} where data_block between 100 and 899 or data_block between 400000 and 400999)", "dev_id, o", "data_block")


@query(_RMAP)
def op_rmap(spark, d):
    return thin.rmap(V.thin_mappings(spark, d), [(100, 900), (400000, 401000)])


@query(_RMAP + " order by all")
def op_sort_rmap(spark, d):
    return thin.sorted_rmap(thin.rmap(V.thin_mappings(spark, d), [(100, 900), (400000, 401000)]))


_BITS = "(select block, era >= 10 as bit from ea)"


@query("select bit, b as begin, n as len from " + runs_sql(_BITS, "bit", "block"))
def op_bit_runs(spark, d):
    return islands.bit_runs(V.era_array(spark, d).select("block", (F.col("era") >= 10).alias("bit")), [], "block", "bit")


@query("select era, b as begin, b + n as end from " + runs_sql("ws", "era", "block"))
def op_marked_runs(spark, d):
    return era.marked_ranges(V.era_writesets(spark, d))


@query("select b as begin, e as end from " + FREE.format(source="disk", n=3000000) + " where e > b")
def op_gaps(spark, d):
    return thin.trim(spark, V.disk_ref_counts(spark, d), V.POOL_BLOCKS)


@query(""", r as (select thin_block from m where dev_id = 3), k as (select b, n from """ + runs_sql("r", "", "thin_block") + """)
select 'copy' as kind, b as begin, n as len from k union all
select 'skip', p, b - p from (select b, coalesce(lag(b + n) over (order by b), 0) as p from k) where b > p""")
def op_migrate_chunks(spark, d):
    return thin.migrate_chunks(V.thin_mappings(spark, d), 3)


_DUP = "(select cblock, oblock, row_number() over (partition by oblock order by cblock) as r from c where is_valid = 1)"


@query(f"select cblock, oblock from {_DUP} where r > 1")
def op_dup_oblock(spark, d):
    return cache.duplicate_origins(V.cache_mappings(spark, d))


@query(""", lv as (select dev_id as seq, thin_block // 64 as pos, list(struct_pack(t := thin_block, b := data_block) order by thin_block) as content from m group by all),
lb as (select seq, pos, min(seq * 10000000 + pos) over (partition by content) as leaf from lv),
x as (select *, lag(leaf) over w as p, lead(leaf) over w as q from lb window w as (partition by seq order by pos)),
f as (select leaf, count(*) as uses, count(*) filter (p is null) as starts, count(*) filter (q is null) as stops, count(distinct p) as np, count(distinct q) as nq from x group by leaf),
y as (select x.*, f.uses, f.starts > 0 or f.np <> 1 or coalesce(g.stops > 0 or g.nq <> 1, false) as head from x join f using (leaf) left join f g on x.p = g.leaf),
z as (select *, count(*) filter (head) over (partition by seq order by pos) as run from y)
select distinct first_value(leaf) over w as atom, pos - first_value(pos) over w as pos, leaf, uses > 1 as shared from z window w as (partition by seq, run order by pos)""")
def op_atomic_seqs(spark, d):
    """Leaf sequences of volumes: a leaf is a stretch of 64 thin blocks with its data, named by the first place that has it."""
    from pyspark.sql import Window

    m = V.thin_mappings(spark, d).withColumn("at", islands.div(F.col("thin_block"), 64))
    leaves = m.groupBy("dev_id", "at").agg(F.sort_array(F.collect_list(F.struct("thin_block", "data_block"))).alias("content"))
    named = leaves.withColumn("leaf", F.min(F.col("dev_id") * 10000000 + F.col("at")).over(Window.partitionBy("content")))
    return thin.atomic_sequences(named.select(F.col("dev_id").alias("seq"), F.col("at").alias("pos"), "leaf"))


# --- order, sets ---------------------------------------------------------------------------------------------------

_ROOTS = """, h as (select dev_id as root, list(struct_pack(t := map_time, n := n) order by map_time desc) as hist from (select dev_id, map_time, count(*) as n from m group by all) group by dev_id)
"""


@query(_ROOTS + "select root, len(hist) as k from h order by hist desc, root desc")
def op_sort_roots(spark, d):
    t = V.thin_mappings(spark, d).groupBy(F.col("dev_id").alias("root"), F.col("map_time").alias("time")).agg(F.count("*").alias("n"))
    return repair.ranked_roots(t).select("root", F.size("history").cast("long").alias("k"))


@query(_ROOTS + "select root, len(hist) as k from h order by hist desc, root desc limit 1")
def op_top1_root(spark, d):
    t = V.thin_mappings(spark, d).groupBy(F.col("dev_id").alias("root"), F.col("map_time").alias("time")).agg(F.count("*").alias("n"))
    return repair.best_root(repair.ranked_roots(t)).select("root", F.size("history").cast("long").alias("k"))


@query("select cblock as src, oblock as dst from c where is_valid = 1 and is_dirty = 1 order by oblock, cblock")
def op_sort_copy(spark, d):
    return cache.sorted_copies(cache.writeback(V.cache_mappings(spark, d), True, 1))


@query("select block from ws where era >= 15 union select block from ea where era >= 12")
def op_union(spark, d):
    return era.invalidated_blocks(V.era_writesets(spark, d), V.era_array(spark, d), 12)


@query("select b as begin, e - b as len from " + FREE.format(source="m", n=400000) + " where e > b")
def op_free(spark, d):
    return islands.gaps(spark, V.thin_mappings(spark, d), "data_block", V.SHRUNK_BLOCKS)


@query(", r as (select b, b + n as e from " + runs_sql("(select distinct data_block from m)", "", "data_block") + """)
select b as begin, least(e, 410000) - b as len, true as below from r where b < 410000 union all select greatest(b, 410000), e - greatest(b, 410000), false from r where e > 410000""")
def op_split_at(spark, d):
    blocks = V.thin_mappings(spark, d).select("data_block").distinct()
    return thin.split_at(islands.islands(blocks, [], "data_block"), 410000)


@query("select l.dev_id as left_dev, r.dev_id as right_dev, greatest(l.b, r.b) as begin, least(l.b + l.n, r.b + r.n) - greatest(l.b, r.b) as len from " + runs_sql("m", "dev_id", "thin_block") + " l join " + runs_sql("m", "dev_id", "thin_block") + " r on l.dev_id < r.dev_id and l.b < r.b + r.n and r.b < l.b + l.n")
def op_range_overlap(spark, d):
    r = islands.islands(V.thin_mappings(spark, d).select("dev_id", "thin_block"), ["dev_id"], "thin_block")
    left = r.select(F.col("dev_id").alias("left_dev"), "begin", "len")
    right = r.select(F.col("dev_id").alias("right_dev"), F.col("begin").alias("r_begin"), F.col("len").alias("r_len"))
    return rangejoin.overlap_join(left, right).filter("left_dev < right_dev").select("left_dev", "right_dev", F.col("o_begin").alias("begin"), F.col("o_len").alias("len"))


# --- cache ---------------------------------------------------------------------------------------------------------

@query("select cblock, oblock, is_dirty from c where is_valid = 1")
def op_valid_filter(spark, d):
    return cache.valid(V.cache_mappings(spark, d))


@query("select cblock as src, oblock as dst from c where is_valid = 1 and is_dirty = 1")
def op_dirty_v1(spark, d):
    return cache.writeback(V.cache_mappings(spark, d), True, 1)


@query("select cblock as src, oblock as dst from c where is_valid = 1 and cblock % 3 = 0")
def op_dirty_v2(spark, d):
    c = V.cache_mappings(spark, d)
    return cache.writeback(c, True, 2, c.filter("cblock % 3 = 0").select("cblock"))


@query("select cblock as src, oblock as dst from c where is_valid = 1")
def op_dirty_all(spark, d):
    return cache.writeback(V.cache_mappings(spark, d), False, 2)


@query("select count(*) as n from c where is_dirty = 1 and oblock > 1000")
def op_count_where(spark, d):
    return cache.count_where(V.cache_mappings(spark, d), (F.col("is_dirty") == 1) & (F.col("oblock") > 1000))


@query(f"select 'duplicate origin' as kind, cblock, oblock from {_DUP} where r > 1 union all select 'out of bounds', cblock, oblock from c where is_valid = 1 and oblock >= 50000")
def chk_cache(spark, d):
    return cache.check(V.cache_mappings(spark, d), 50000)


@query("select 'no dirty bitset' as kind union all select 'hint size is not 4' union all select 'unknown version'", views=False)
def chk_cache_sb(spark, d):
    sb = spark.range(1).selectExpr("explode(array(struct(2 as version, 0 as dirty_root, 4 as hint_size), struct(1 as version, 0 as dirty_root, 8 as hint_size), struct(3 as version, 9 as dirty_root, 4 as hint_size))) as x").select("x.*")
    return cache.check_superblock(sb)


# --- era -----------------------------------------------------------------------------------------------------------

_INV = "(select distinct block from ws where era >= {s} union select block from ea where era >= {s} and (select min(era) from ws) > {s})"


@query("select b as begin, b + n as end from " + runs_sql(_INV.format(s=12), "", "block"))
def op_invalidate(spark, d):
    return era.invalidate(V.era_writesets(spark, d), V.era_array(spark, d), 12)


@query("select era, block from ws where era < 28 union all select distinct 28, block from ws where era >= 28")
def op_writesets(spark, d):
    w = V.era_writesets(spark, d)
    return era.all_writesets(w.filter("era < 28"), w.filter("era >= 28").select(F.lit(28).cast("long").alias("era"), "block").distinct())


@query("select range as era from range(15, 41) where range not in (select era from ws)")
def op_missing_eras(spark, d):
    return era.missing_eras(V.era_writesets(spark, d).select("era").unionByName(spark.range(1).selectExpr("15L as era")), 40)


@query("select ea.block, coalesce(max(ws.era), any_value(ea.era)) as era from ea left join ws on ea.block = ws.block group by ea.block")
def op_era_logical(spark, d):
    return era.logical(V.era_writesets(spark, d), V.era_array(spark, d))


@query("select block, era from ea where era > 10")
def chk_era(spark, d):
    return era.check_array(V.era_array(spark, d), 10)


# --- checks --------------------------------------------------------------------------------------------------------

@query("select 5 as dev_id, 'no mappings' as kind union all select 0, 'no details'")
def chk_devids(spark, d):
    m = V.thin_mappings(spark, d)
    return check.device_ids(V.thin_devices(spark, d).filter("dev_id <> 0"), m.filter("dev_id <> 5"))


@query("select d.dev_id, mapped_blocks as declared, n as found, 'count differs' as kind from d join (select dev_id, count(*) as n from m group by dev_id) x using (dev_id) where mapped_blocks <> n")
def chk_mapped(spark, d):
    return check.mapped_counts(V.thin_devices(spark, d), V.thin_mappings(spark, d))


@query("select * from m where data_block >= 2000000")
def chk_oob(spark, d):
    return check.out_of_bounds(V.thin_mappings(spark, d), 2000000)


@query(f"select *, case when expected = 0 and actual = 1 then 'leak' else 'bad' end as kind from {_DIFF} where expected <> actual")
def chk_sm(spark, d):
    return check.space_map_check(thin.ref_counts(V.thin_mappings(spark, d)), V.disk_ref_counts(spark, d))


@query("select * from disk where not (ref_count = 1 and data_block not in (select data_block from rc))")
def chk_sm_repair(spark, d):
    return check.space_map_repair(thin.ref_counts(V.thin_mappings(spark, d)), V.disk_ref_counts(spark, d))


@query("select dev_id, dev_id * 7 as root from d where dev_id % 2 = 1")
def chk_snap(spark, d):
    return op_snap_excl(spark, d)


def _leaves(spark, d):
    """Leaves of up to 252 mappings, in key order, for each volume."""
    m = V.thin_mappings(spark, d).withColumn("at", islands.div(F.col("thin_block"), 400))
    return m.groupBy("dev_id", "at").agg(F.count("*").alias("nr_entries"), F.min("thin_block").alias("key_low"), F.max("thin_block").alias("key_high"))


_LEAVES = ", n as (select dev_id, thin_block // 400 as slot, count(*) as nr_entries, min(thin_block) as key_low, max(thin_block) as key_high from m group by all)\n"


@query(_LEAVES + "select dev_id, slot, nr_entries from n where nr_entries < 585 // 3 and slot <> 0")
def chk_underfull(spark, d):
    """Leaves below a third of a room of 585; the first of each volume counts as its root."""
    x = _leaves(spark, d).withColumn("is_root", F.col("at") == 0)
    return check.underfull(x, 585).select("dev_id", F.col("at").alias("slot"), "nr_entries")


@query(_LEAVES + "select dev_id, slot from n where key_low < slot * 400 + 1 or (slot < (select max(slot) from n k where k.dev_id = n.dev_id) and (select min(k.slot) from n k where k.dev_id = n.dev_id and k.slot > n.slot) * 400 + 1 < key_high)")
def chk_keyrange(spark, d):
    x = _leaves(spark, d).select(F.col("dev_id").alias("parent"), F.col("at").alias("pos"), (F.col("at") * 400 + 1).alias("parent_key"), "key_low", "key_high")
    return check.key_ranges(x).select(F.col("parent").alias("dev_id"), F.col("pos").alias("slot"))


@query(_LEAVES + "select dev_id, slot from (select *, max(key_high + case when slot % 7 = 0 then 5000 else 0 end) over (partition by dev_id order by slot rows between unbounded preceding and 1 preceding) as p from n) where key_low <= p")
def chk_overlap(spark, d):
    x = _leaves(spark, d).select(F.col("dev_id").alias("parent"), F.col("at").alias("pos"), "key_low", (F.col("key_high") + F.when(F.col("at") % 7 == 0, 5000).otherwise(0)).alias("key_high"))
    return check.overlaps(x).select(F.col("parent").alias("dev_id"), F.col("pos").alias("slot"))


@query(f"select max(case when expected = 0 and actual = 1 then 1 else 2 end) as severity from {_DIFF} where expected <> actual")
def chk_outcome(spark, d):
    return check.outcome(chk_sm(spark, d).select(F.when(F.col("kind") == "leak", 1).otherwise(2).alias("severity")))


@query("select false as clear_flag", views=False)
def chk_flags(spark, d):
    return check.needs_check(chk_outcome(spark, d), clear=True, repaired=True)


# --- scalar functions ----------------------------------------------------------------------------------------------

_K = "from lineitem"


@query("select l_orderkey as k, l_linenumber as n, cast(l_quantity as bigint) * case l_linenumber % 4 when 0 then 512 when 1 then 1024 when 2 then 1000000 else 1073741824 end as bytes " + _K, views=False)
def fn_units(spark, d):
    x = V.table(spark, d, "lineitem")
    unit = F.element_at(F.array(F.lit(""), F.lit("KiB"), F.lit("M"), F.lit("gibibyte")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), scalar.parse_size(F.concat(F.col("l_quantity").cast("long").cast("string"), unit)).cast("long").alias("bytes"))


@query("""select b, case when b < 1048576 then case when b > 8192 then cast(cast(floor(b / 1024.0 + 0.5) as bigint) as varchar) || 'KiB' else cast(b as varchar) || 'b' end
 when b < 1073741824 then case when b >> 10 > 8192 then cast(cast(floor((b >> 10) / 1024.0 + 0.5) as bigint) as varchar) || 'MiB' else cast(b >> 10 as varchar) || 'KiB' end
 else case when b >> 20 > 8192 then cast(cast(floor((b >> 20) / 1024.0 + 0.5) as bigint) as varchar) || 'GiB' else cast(b >> 20 as varchar) || 'MiB' end end as pretty
from (select distinct o_orderkey * o_orderkey as b from orders)""", views=False)
def fn_pretty(spark, d):
    x = V.table(spark, d, "orders").select((F.col("o_orderkey") * F.col("o_orderkey")).alias("b")).distinct()
    return x.select("b", scalar.pretty_size(F.col("b")).alias("pretty"))


@query("select o_orderkey as k, (o_orderkey * 65536) / 1048576.0 as mib from orders", views=False)
def fn_to_units(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), scalar.to_unit(F.col("o_orderkey") * 65536, "m").alias("mib"))


@query("select p_partkey as k, least(1 + (p_partkey * 1000 // 64 + 125) // 126 + p_size, 4161600) * 4096 as bytes from part", views=False)
def fn_thin_size(spark, d):
    x = V.table(spark, d, "part")
    return x.select(F.col("p_partkey").alias("k"), scalar.thin_metadata_bytes(F.col("p_partkey") * 1000, F.lit(64), F.col("p_size").cast("long")).alias("bytes"))


@query("select p_partkey as k, least(4194304 + 16 * n + 12 * n, 17045913600) as bytes from (select p_partkey, (p_partkey * 1000 + 63) // 64 as n from part)", views=False)
def fn_cache_size(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), scalar.cache_metadata_bytes(F.col("p_partkey") * 1000, F.lit(64)).alias("bytes"))


@query("select l_orderkey as k, l_linenumber as n, (l_orderkey + l_linenumber - 1) // l_linenumber as q from lineitem", views=False)
def fn_div_up(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), scalar.div_up(F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("q"))


@query("select o_orderkey as k, case when o_custkey > o_orderkey then o_orderkey end as b, case when o_custkey > o_orderkey then o_custkey end as e from orders", views=False)
def fn_range(spark, d):
    r = scalar.parse_range(F.concat(F.col("o_orderkey").cast("string"), F.lit(".."), F.col("o_custkey").cast("string")))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), r["begin"].alias("b"), r["end"].alias("e"))


# --- codecs, sinks, streams ----------------------------------------------------------------------------------------

@query("select l_orderkey as k, array_to_string(list(l_partkey order by l_linenumber, l_partkey), ',') as decoded from lineitem group by l_orderkey", views=False)
def fn_delta_enc(spark, d):
    """Lists as steps, and back."""
    x = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("v"))
    return x.select("k", F.array_join(codec.delta_decode(codec.delta_encode(F.col("v"))), ",").alias("decoded"))


@query("""with t as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 2197175160) else c >> 1 end)) as steps)
select c_custkey as k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::bigint)),
  lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) as crc from customer, t""", views=False)
def fn_crc32c(spark, d):
    """Checksums of customers' names."""
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), codec.crc32c(F.col("c_name").cast("binary")).alias("crc"))


_RUNS = "(select dev_id, b as thin_begin, b + o as data_begin, n, map_time from " + runs_sql(_OFF, "dev_id, o, map_time", "thin_block") + ")"


@query(f"""select '<superblock uuid="" time="6" transaction="7" version="2" data_block_size="128" nr_data_blocks="3000000">' as line union all select '</superblock>'
union all select '  <device dev_id="' || dev_id || '" mapped_blocks="' || mapped_blocks || '" transaction="' || transaction_id || '" creation_time="' || creation_time || '" snap_time="' || snapshotted_time || '">' from d
union all select '  </device>' from d
union all select case when n = 1 then '    <single_mapping origin_block="' || thin_begin || '" data_block="' || data_begin || '" time="' || map_time || '"/>'
 else '    <range_mapping origin_begin="' || thin_begin || '" data_begin="' || data_begin || '" length="' || n || '" time="' || map_time || '"/>' end from {_RUNS}""")
def snk_thin_xml(spark, d):
    sb = spark.range(1).selectExpr("'' as uuid", "6 as time", "7 as transaction", "2 as version", "128 as data_block_size", "3000000 as nr_data_blocks")
    return text.thin_xml(sb, V.thin_devices(spark, d), thin.dump_runs(V.thin_mappings(spark, d)))


@query(f"""select x as line from d, (select unnest(['device: ' || dev_id, 'mapped_blocks: ' || mapped_blocks, 'transaction: ' || transaction_id, 'creation time: ' || creation_time, 'snap time: ' || snapshotted_time, '']) as x, dev_id as i from d) u where d.dev_id = u.i
union all select '    (' || thin_begin || '..' || (thin_begin + n - 1) || ') -> (' || data_begin || '..' || (data_begin + n - 1) || '), ' || map_time from {_RUNS}""")
def snk_thin_hr(spark, d):
    return text.thin_readable(V.thin_devices(spark, d), thin.dump_runs(V.thin_mappings(spark, d)))


@query(_DELTA + "select '  <' || case kind when 'differ' then 'different' else kind end || ' begin=\"' || b || '\" length=\"' || n || '\"/>' as line from " + runs_sql("x", "kind", "thin_block"))
def snk_delta_xml(spark, d):
    return text.delta_xml(thin.delta(V.thin_mappings(spark, d), 1, 2))


@query("""select '    <mapping cache_block="' || cblock || '" origin_block="' || oblock || '" dirty="' || case when is_dirty = 1 then 'true' else 'false' end || '"/>' as line from c where is_valid = 1
union all select unnest(['<superblock uuid="" block_size="512" nr_cache_blocks="4096" policy="smq" hint_width="4">', '  <mappings>', '  </mappings>', '  <hints>', '  </hints>', '</superblock>'])""")
def snk_cache_xml(spark, d):
    sb = spark.range(1).selectExpr("'' as uuid", "512 as block_size", "4096 as nr_cache_blocks", "'smq' as policy", "4 as hint_width")
    return text.cache_xml(sb, cache.valid(V.cache_mappings(spark, d)), spark.createDataFrame([], "cblock long, hint binary"))


@query("""select '    <marked block_begin="' || b || '" len="' || n || '"/>' as line from """ + runs_sql("ws", "era", "block") + """
union all select '    <era block="' || block || '" era="' || era || '"/>' from ea
union all select '  <writeset era="' || era || '" nr_bits="2000">' from (select distinct era from ws) union all select '  </writeset>' from (select distinct era from ws)
union all select unnest(['<superblock uuid="" block_size="128" nr_blocks="2000" current_era="31">', '  <era_array>', '  </era_array>', '</superblock>'])""")
def snk_era_xml(spark, d):
    sb = spark.range(1).selectExpr("'' as uuid", "128 as block_size", "2000 as nr_blocks", "31 as current_era")
    w = V.era_writesets(spark, d)
    return text.era_xml(sb, w.select("era", F.lit(2000).alias("nr_bits")).distinct(), era.marked_ranges(w), V.era_array(spark, d))


@query(", t as (select d.dev_id as dev, count(*) as mapped from d join m on d.dev_id = m.dev_id group by d.dev_id), w as (select greatest(3, max(length(dev::varchar))) as a, greatest(6, max(length(mapped::varchar))) as b from t) select lpad('dev', a::int, ' ') || ' ' || lpad('mapped', b::int, ' ') || ' ' as line from w union all select lpad(dev::varchar, a::int, ' ') || ' ' || lpad(mapped::varchar, b::int, ' ') || ' ' from t, w")
def snk_grid(spark, d):
    return text.grid(thin.usage(V.thin_mappings(spark, d)).select(F.col("dev_id").alias("dev"), "mapped"), ["dev"])


@query("select block, max(era) as era from buys group by block")
def op_era_stream(spark, d):
    """Newest era of each block, as the streaming tracker aggregates it."""
    return era_tracker.newest_era(V._purchases(spark, d))


from . import format_queries  # noqa: E402, F401  registers its queries here
