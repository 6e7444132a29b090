"""The trie of conversation prefixes from sorted sequences and their common prefixes.

A conversation is the sequence of its turns' hashes (16 bytes a turn; texts stay where they are). Equal sequences become
one row with their number, and all rows are sorted by range partitions, so prefixes are runs of rows: a hot first turn or a
hot conversation is dealt out over as many ranges as its rows fill. Beside each row stands the length of the prefix that it
shares with the row before. A sparse table over those lengths gives the least of any stretch at once; every candidate
prefix, a row and a depth, searches its left and its right extent with it independently, by halving steps. So each gets its
interval of rows without a stack, and members, leaves and the smallest member are sums and minima over the interval.

Rows are cut into blocks of ``BLOCK_ROWS``. The searches in a block see its own rows; where one runs over the edge, it goes
on in a sparse table over the least lengths of all blocks (a row for each, broadcast) to the block it ends in, and two
small tables of the edges of blocks say where in that block, by a join. Sums over subtrees are differences of running sums.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.llm.common import record, table
from mnemoframe.scratch import written

#: Rows of a block, and turns that its rows do not share with the row before.
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 20
#: Bytes of a turn in a key.
WIDTH = 16
#: Characters of member ids that are joined in one piece.
PIECE = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` with ``turns`` an array of (h, bytes): a hash of role and text, and the bytes of the text.

    Turns go by ``turn``, null first; turns with one number by their hash. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation and are left out; other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    h = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), h.alias("h"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["h"].alias("h"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(found: DataFrame, span: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from c - c % ``span``, h = crc32(c) % ``most``."""
    c = F.col("conv_id")
    heads = found.where(c % span == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    each = found.withColumn("base", c - c % span).withColumn("h", (F.crc32(c.cast("string")) % most).cast("int"))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return each.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _ends(keyed: DataFrame) -> DataFrame:
    """``kid, ends_sha256``: the hash of the ids of all conversations that are one sequence, ascending, with commas between.

    The ids of a sequence are joined in pieces by the tasks of their ranges; what one task hashes is those pieces, one
    after the other.
    """
    piece = pa.schema([("kid", pa.string()), ("lo", pa.int64()), ("ids", pa.string())])
    whole = pa.schema([("kid", pa.string()), ("ends_sha256", pa.string())])

    def cut(batches):
        now, lo, held, size, out = None, 0, [], 0, []
        for b in batches:
            for kid, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if kid != now or size > PIECE:
                    if held:
                        out.append((now, lo, ",".join(held)))
                    now, lo, held, size = kid, c, [], 0
                held.append(str(c))
                size += len(held[-1])
            if len(out) > 1000 or sum(len(x[2]) for x in out) > PIECE:
                yield record(piece, list(zip(*out, strict=True)))
                out = []
        if held:
            out.append((now, lo, ",".join(held)))
        if out:
            yield record(piece, list(zip(*out, strict=True)))

    def hashed(batches):
        now, h, out = None, None, []
        for b in batches:
            for kid, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kid == now:
                    h.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h = kid, hashlib.sha256(ids.encode())
            if len(out) > 10_000:
                yield record(whole, list(zip(*out, strict=True)))
                out = []
        if now is not None:
            out.append((now, h.hexdigest()))
        if out:
            yield record(whole, list(zip(*out, strict=True)))

    pieces = keyed.select("kid", "conv_id").repartitionByRange("kid", "conv_id").sortWithinPartitions("kid", "conv_id").mapInArrow(cut, "kid string, lo long, ids string")
    return pieces.repartition("kid").sortWithinPartitions("kid", "lo").mapInArrow(hashed, "kid string, ends_sha256 string")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    if a[: hi * WIDTH] == b[: hi * WIDTH]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH]:
            lo = mid
        else:
            hi = mid
    return lo


_PLACED = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("kid", pa.string()), ("lcp", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("leaf", pa.bool_()), ("sha", pa.string()), ("bytes", pa.list_(pa.int64())), ("edge", pa.binary())])
_PLACED_SQL = "block long, idx int, kid string, lcp int, size int, n long, least long, leaf boolean, sha string, bytes array<long>, edge binary"


def _placed(distinct: DataFrame) -> DataFrame:
    """Sorted rows with their block, place, shared length and whether no other row goes on from them.

    ``lcp`` is null in the first row of a range and ``leaf`` in its last; ``edge`` has the keys of these two. ``bytes`` are
    those of the turns that are not shared with the row before.
    """

    def work(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        idx = turns = 0
        last, row, out = None, None, []
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for key, kid, n, least, sha, sizes in zip(*(c.to_pylist() for c in cols), strict=True):
                lcp = None if last is None else shared(last, key)
                if row is not None:
                    row[7] = lcp < row[4]
                    out.append(row)
                if idx >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                    block, idx, turns = block + 1, 0, 0
                row = [block, idx, kid, lcp, len(sizes), n, least, None, sha, sizes[lcp or 0 :], key if last is None else None]
                idx, turns, last = idx + 1, turns + len(row[9]), key
            if out:
                yield record(_PLACED, list(zip(*out, strict=True)))
                out = []
        if row is not None:
            row[10] = last
            yield record(_PLACED, [[x] for x in row])

    return distinct.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(work, _PLACED_SQL)


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """``[j][x]``: the least of the 2^j values from x."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least from ``lo`` to ``hi``, both included; no stretch may be empty."""
    j = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), levels[0].dtype)
    for k in np.unique(j):
        at = j == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
    return out


def _right(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place from ``at`` on so that all values behind ``at`` up to it are at least ``depth``."""
    r = at.copy()
    for j in range(len(levels) - 1, -1, -1):
        to = r + (1 << j)
        r = np.where((to < len(levels[0])) & (levels[j][np.clip(r + 1, 0, len(levels[j]) - 1)] >= depth), to, r)
    return r


def _left(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place so that all values behind it up to ``at`` are at least ``depth``."""
    l = at.copy()  # noqa: E741
    for j in range(len(levels) - 1, -1, -1):
        to = l - (1 << j)
        l = np.where((to >= 0) & (levels[j][np.clip(to + 1, 0, len(levels[j]) - 1)] >= depth), to, l)  # noqa: E741
    return l


@dataclass
class Blocks:
    """One entry for each block, in order: what searches that leave their block go by."""

    ids: np.ndarray
    start: np.ndarray
    lcp: np.ndarray
    first: np.ndarray
    members: np.ndarray
    leaves: np.ndarray
    least: np.ndarray
    last_leaf: np.ndarray

    def __post_init__(self):
        self.by_lcp, self.by_least = _sparse(self.lcp), _sparse(self.least)
        self.members, self.leaves, self.start = (np.append(0, np.cumsum(x)) for x in (self.members, self.leaves, self.start))


def _blocks(placed: DataFrame) -> Blocks:
    """The driver gets a row for each block, and the two keys at the edges of each range, one after the other."""
    rows = placed.groupBy("block").agg(F.count(F.lit(1)), F.min("lcp"), F.min_by("lcp", "idx"), F.sum("n"), F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(0)), F.min("least")).orderBy("block").collect()
    first_of, leaf_of, before = {}, {}, None
    for block, size, edge, opens in placed.where(F.col("edge").isNotNull()).select("block", "size", "edge", F.col("lcp").isNull()).orderBy("block", "idx").toLocalIterator():
        if opens:
            first_of[block] = -1 if before is None else shared(before[2], edge)
            if before is not None:
                leaf_of[before[0]] = first_of[block] < before[1]
        before = (block, size, edge)
    if before is not None:
        leaf_of[before[0]] = True
    least = [first_of[r[0]] if r[3] is None and r[2] is None else min(x for x in (r[2], first_of.get(r[0])) if x is not None) for r in rows]
    first = [first_of.get(r[0], r[3]) for r in rows]
    leaves = [r[5] + bool(leaf_of.get(r[0])) for r in rows]
    last = [leaf_of.get(r[0], False) for r in rows]
    of = lambda x, kind=np.int64: np.array(x, kind)
    return Blocks(of([r[0] for r in rows]), of([r[1] for r in rows]), of(least), of(first), of([r[4] for r in rows]), of(leaves), of([r[6] for r in rows]), of(last, bool))


#: Kinds of rows that ``_searched`` makes.
_CANDIDATE, _HEAD, _TAIL = 0, 1, 2
_FOUND = pa.schema([(c, pa.int64()) for c in ("kind", "block", "i", "depth", "l", "r", "n", "leaves", "least", "left_block", "right_block", "bytes")] + [("owned", pa.bool_()), ("goes_on", pa.bool_()), ("sha", pa.string())])
_FOUND_SQL = "kind long, block long, i long, depth long, l long, r long, n long, leaves long, least long, left_block long, right_block long, bytes long, owned boolean, goes_on boolean, sha string"


def _interval(block: pa.Table, all_: Blocks) -> pa.Table:
    block = block.sort_by("idx")
    col = lambda c: block.column(c).to_numpy()
    b = int(np.searchsorted(all_.ids, col("block")[0]))
    lcp = block.column("lcp").fill_null(int(all_.first[b])).to_numpy().astype(np.int64)
    leaf = block.column("leaf").fill_null(bool(all_.last_leaf[b])).to_numpy(zero_copy_only=False).astype(np.int64)
    size, n, least = col("size").astype(np.int64), col("n"), col("least")
    end, start = len(lcp), int(all_.start[b])
    by_lcp, by_least = _sparse(lcp), _sparse(least)
    members, leaves = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(leaf))

    # candidates: of every row the depths from the shared one (it is the parent of the first of its own) to its whole length
    lowest = np.maximum(lcp, 0)
    many = size - lowest + 1
    at = np.repeat(np.arange(end), many)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + lowest[at]
    owned = depth > lcp[at]
    l, r = _left(by_lcp, at, depth), _right(by_lcp, at, depth)  # noqa: E741
    total, leaf_sum, smallest = members[r + 1] - members[l], leaves[r + 1] - leaves[l], _least(by_least, l, r)
    left_block, right_block = np.full(len(at), -1), np.full(len(at), -1)
    to_l, to_r = l + start, r + start

    over = np.flatnonzero((r == end - 1) & (np.append(all_.first, -2)[b + 1] >= depth))
    if len(over):
        last = _right(all_.by_lcp, np.full(len(over), b), depth[over])  # all blocks up to it are inside
        full = last > b
        inside = over[full]
        if len(inside):
            smallest[inside] = np.minimum(smallest[inside], _least(all_.by_least, np.full(len(inside), b + 1), last[full]))
        total[over] += all_.members[last + 1] - all_.members[b + 1]
        leaf_sum[over] += all_.leaves[last + 1] - all_.leaves[b + 1]
        to_r[over] = all_.start[last + 1] - 1
        partly = (last + 1 < len(all_.ids)) & (np.append(all_.first, -2)[last + 1] >= depth[over])
        right_block[over[partly]] = all_.ids[last[partly] + 1]
    over = np.flatnonzero((l == 0) & (lcp[0] >= depth))
    if len(over):
        whole = _left(all_.by_lcp, np.full(len(over), b - 1), depth[over])  # all blocks behind it are inside, it is not
        full = whole < b - 1
        inside = over[full]
        if len(inside):
            smallest[inside] = np.minimum(smallest[inside], _least(all_.by_least, whole[full] + 1, np.full(len(inside), b - 1)))
        total[over] += all_.members[b] - all_.members[whole + 1]
        leaf_sum[over] += all_.leaves[b] - all_.leaves[whole + 1]
        left_block[over] = all_.ids[whole]
        to_l[over] = -1

    # a row's list ends with its last turn
    own, listed = pc.list_flatten(block.column("bytes")).to_numpy(), pc.list_value_length(block.column("bytes")).to_numpy().astype(np.int64)
    used = np.zeros(len(at), np.int64)
    mine = np.flatnonzero(owned & (depth > 0))
    used[mine] = own[(np.cumsum(listed) - size)[at[mine]] + depth[mine] - 1]
    shas = block.column("sha").take(pa.array(at))
    sha = pc.if_else(pa.array(depth == size[at]), shas, NOTHING)
    optional = lambda x: pa.array(x, mask=x < 0)
    k = len(at)
    rows = [pa.array(np.full(k, _CANDIDATE)), pa.array(np.full(k, all_.ids[b])), pa.array(at + start), pa.array(depth), pa.array(to_l), pa.array(to_r), pa.array(total), pa.array(leaf_sum), pa.array(smallest), optional(left_block), optional(right_block), pa.array(used), pa.array(owned), pa.array(depth < size[at]), sha]
    out = [pa.Table.from_arrays(rows, schema=_FOUND)]

    # where in this block intervals of other blocks end or begin, for the depths at which they can
    low = int(all_.lcp[b])
    for kind, upto in ((_HEAD, int(lcp[0])), (_TAIL, int(np.append(all_.first, -2)[b + 1]))):
        d = np.arange(low + 1, upto + 1)
        if len(d):
            if kind == _HEAD:
                lo, hi = np.zeros(len(d), np.int64), _right(by_lcp, np.zeros(len(d), np.int64), d)
            else:
                lo, hi = _left(by_lcp, np.full(len(d), end - 1), d), np.full(len(d), end - 1)
            of = lambda x: pa.array(x, pa.int64())
            blank = pa.nulls(len(d), pa.int64())
            out.append(pa.Table.from_arrays([of(np.full(len(d), kind)), of(np.full(len(d), all_.ids[b])), blank, of(d), of(lo + start), of(hi + start), of(members[hi + 1] - members[lo]), of(leaves[hi + 1] - leaves[lo]), of(_least(by_least, lo, hi)), blank, blank, blank, pa.nulls(len(d), pa.bool_()), pa.nulls(len(d), pa.bool_()), pa.nulls(len(d), pa.string())], schema=_FOUND))
    return pa.concat_tables(out)


def _resolved(found: DataFrame) -> DataFrame:
    """The candidates with the rest of their intervals in the blocks where these begin and end."""
    candidates = found.where(F.col("kind") == _CANDIDATE).drop("kind")
    closed = candidates.where("left_block is null and right_block is null")
    edge = lambda kind, name: found.where(F.col("kind") == kind).select(F.col("block").alias(f"{name}_block"), "depth", *(F.col(c).alias(f"{name}_{c}") for c in ("l", "r", "n", "leaves", "least")))
    opened = candidates.where("left_block is not null or right_block is not null").join(edge(_HEAD, "right"), ["right_block", "depth"], "left").join(edge(_TAIL, "left"), ["left_block", "depth"], "left")
    add = lambda c: (F.col(c) + F.coalesce(f"right_{c}", F.lit(0)) + F.coalesce(f"left_{c}", F.lit(0))).alias(c)
    mended = opened.select("block", "i", "depth", F.coalesce("left_l", "l").alias("l"), F.coalesce("right_r", "r").alias("r"), add("n"), add("leaves"), F.least("least", "right_least", "left_least").alias("least"), "left_block", "right_block", "bytes", "owned", "goes_on", "sha")
    return closed.unionByName(mended)


def build(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of ``found`` (``conv_id, turns`` as ``sequences`` makes them, a conv_id once): its nodes and its members.

    Nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, first_rank,
    last_rank``. Members: ``conv_id, rank``; a node's members are those with a rank in its interval. Conversations without
    turns belong to the root alone. No conversation: no node. A conversation is one row of 24 bytes a turn.
    """
    spark = found.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["h"]), ""))
    keyed = written(found.select("conv_id", key.alias("key"), F.md5(key).alias("kid"), F.transform("turns", lambda x: x["bytes"]).alias("sizes")), "sequences")
    distinct = keyed.groupBy("key", "kid").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.any_value("sizes").alias("sizes"))
    placed = written(_placed(distinct.join(_ends(keyed), "kid").select("key", "kid", "n", "least", "ends_sha256", "sizes")), "placed")
    blocks = _blocks(placed)
    known = spark.sparkContext.broadcast(blocks)
    searched = written(placed.drop("edge", "kid").groupBy("block").applyInArrow(lambda t: _interval(t, known.value), _FOUND_SQL), "searched")
    every = _resolved(searched)

    path = W.partitionBy("i").orderBy("depth")
    cost = F.when(F.col("owned"), (F.col("n") - 1) * F.col("bytes"))
    below = F.sum(cost).over(W.partitionBy("i").orderBy(F.desc("depth")))
    nodes = written(every.withColumn("parent_conv_id", F.lag("least").over(path)).withColumn("cost", cost).withColumn("below", below).drop("left_block", "right_block"), "candidates")
    own = nodes.where("owned")
    children = nodes.where("not owned").groupBy("l", "depth").agg(F.count(F.lit(1)).alias("more"))
    spent = own.groupBy("block", "i").agg(F.sum("cost").alias("cost")).withColumn("upto", F.sum("cost").over(W.partitionBy("block").orderBy("i")))
    ends = {r[0]: r[1] for r in own.groupBy("block").agg(F.sum("cost")).collect()}
    ahead = np.append(0, np.cumsum([ends[b] for b in blocks.ids.tolist()], dtype=np.int64))
    before = spark.createDataFrame(list(zip(blocks.ids.tolist(), ahead.tolist(), strict=False)), "block long, ahead long")
    upto = written(spent.join(F.broadcast(before), "block").select("i", (F.col("upto") + F.col("ahead")).alias("upto")), "spent")
    joined = own.join(children, ["l", "depth"], "left").join(upto.withColumnRenamed("upto", "here"), "i").join(upto.select(F.col("i").alias("r"), F.col("upto").alias("there")), "r")
    out = joined.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), (F.coalesce("more", F.lit(0)) + F.col("goes_on").cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("there") - F.col("here")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"), F.col("l").alias("first_rank"), F.col("r").alias("last_rank"),
    )
    starts = spark.createDataFrame(list(zip(blocks.ids.tolist(), blocks.start.tolist(), strict=False)), "block long, start long")
    ranks = placed.join(F.broadcast(starts), "block").select("kid", (F.col("start") + F.col("idx")).alias("rank"))
    return out, keyed.select("conv_id", "kid").join(ranks, "kid").select("conv_id", "rank")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations; nulls, ties and repeats are treated as in ``sequences``."""
    return build(rebuilt(sequences(table(spark, sf_dir, "conversations"))))[0].drop("first_rank", "last_rank")


OP11_SQL = """
with t_ as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
n_ as (select conv_id, max(pos) as n from t_ group by 1),
c_ as (select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 as h from n_),
r_ as (select c_.conv_id, pos as d, role, txt from c_ join t_ on t_.conv_id = base where pos <= h union all select c_.conv_id, pos - h + least(h, coalesce(b.n, 0)), role, txt from c_ join t_ on t_.conv_id = c_.conv_id left join n_ b on b.conv_id = base where pos > h),
p_ as (select conv_id, d, string_agg(md5(strlen(role) || ':' || role || txt), '') over (partition by conv_id order by d) as path, strlen(txt) as bytes from r_ union all select conv_id, 0, '', 0 from n_),
l_ as (select conv_id, max(d) as size from p_ group by 1),
v_ as (select path, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = size), '') as ends from p_ join l_ using (conv_id) group by 1, 2),
k_ as (select left(path, 32 * (d - 1)) as path, count(*) as n_children from v_ where d > 0 group by 1),
s_ as (select left(path, 32 * up) as path, sum((n_convs - 1) * bytes) as saved, count(*) filter (n_children is null) as leaves from (select v_.*, n_children, unnest(range(0, v_.d + 1)) as up from v_ left join k_ using (path)) group by 1)
select v_.conv_id, cast(v_.d as bigint) as depth, u.conv_id as parent_conv_id, v_.n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(v_.ends) as ends_sha256 from v_ join s_ using (path) left join k_ using (path) left join v_ u on v_.d > 0 and u.path = left(v_.path, 32 * (v_.d - 1))
"""
