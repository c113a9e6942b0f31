"""The prefix trie of rebuilt conversations, by double-array tries over prefix shards.

Each distinct sequence of a conversation's first turns (role, text) is a node; conversations that start with it are its
members. A turn travels as 16 bytes of its SHA-256 and the UTF-8 length of its text, never as text.

Shards. Distinct sequences, sorted as strings of turn digests, are dealt by range, so a shard holds neighbours of the
prefix order and a prefix that very many conversations share is cut into several shards at whatever depth it needs.
Copies of a sequence are counted, and their ids are joined into blocks, before that. In a shard turns get dense
ids in breadth-first order and a BASE and a CHECK array are packed over them; all sequences then walk the arrays
level by level, and the nodes' aggregates come from the slots they pass. Only nodes on the way to a shard's first or last
sequence can also be in another shard: these upper nodes' aggregates are merged globally by a digest of the prefix.

Sums over subtrees of upper nodes need no rounds: each upper node gives its own value to one of the chains (ways to a first
or last sequence) through it, a chain sums what it was given from its end up, and an upper node's subtree is the
sum over all chains through it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelantern.llm.common import cut, dealt, release, table

KEY = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id and items, an array of (key, size) in turn order: a digest of role and text, and the text's UTF-8 bytes.

    Turns are ordered by turn, null first, equal ones by the digest. A null role or text counts as empty; repeated rows
    are turns of their own; rows with a null conv_id take no part; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    item = F.struct("turn", F.substring(F.sha2(told, 256), 1, 2 * KEY).alias("key"), F.octet_length(text).alias("size"))
    rows = turns.where("conv_id is not null").select("conv_id", item.alias("item"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return convs.select("conv_id", F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("items"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 5, h = crc32(c as text) % 9.

    The other one gives as many as it has, none if absent; c's own turns after its first h follow. Only first turns of
    every fifth conversation meet the others, so a key of the join has at most nine rows.
    """
    heads = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("items", 1, 8).alias("head"))
    rest = convs.where("conv_id % 5 <> 0").withColumn("base", F.expr("conv_id - conv_id % 5"))
    rest = rest.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    got = F.slice(F.coalesce("head", F.expr("slice(items, 1, 0)")), F.lit(1), F.col("h"))
    own = F.slice("items", F.col("h") + 1, F.greatest(F.size("items") - F.col("h"), F.lit(0)))
    rest = rest.join(heads, "base", "left").select("conv_id", F.concat(got, own).alias("items"))
    return convs.where("conv_id % 5 = 0").unionByName(rest)


def _runs(batches, each: int = 4096):
    """From rows sorted by path and conv_id: for each run of equal paths its ids, in blocks of at most `each`."""
    path, sizes, ids, out = None, None, [], []

    def table_of(rows):
        return pa.RecordBatch.from_pylist(rows, schema=RUNS)

    for b in batches:
        for p, s, c in zip(b.column("path").to_pylist(), b.column("sizes").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (p != path or len(ids) == each):
                out.append({"path": path, "sizes": sizes, "conv": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})
                ids = []
            path, sizes = p, s
            ids.append(c)
        yield table_of(out)
        out = []
    if ids:
        yield table_of([{"path": path, "sizes": sizes, "conv": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}])


RUNS = pa.schema([("path", pa.binary()), ("sizes", pa.list_(pa.int32())), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


class DoubleArray:
    """A trie of sequences of dense ids: the child of slot s by id c is slot base[s] + c, if check of it is s.

    flat holds the sequences one after another, lens their lengths. Slot 0 is the root; ids are 0 or more.
    """

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        self.flat, self.lens = flat, lens
        self.starts = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0], self.top, self.low = 0, 1, 1  # all slots from top on and none below low are free
        width = int(flat.max()) + 1 if len(flat) else 1
        at, state = np.arange(len(lens)), np.zeros(len(lens), np.int64)
        for depth in range(int(lens.max(initial=0))):
            state, at = state[lens[at] > depth], at[lens[at] > depth]
            kids, which = np.unique(state * width + flat[self.starts[at] + depth], return_inverse=True)
            state = self._place(kids // width, kids % width)[which]

    def _room(self, slots: int):
        if slots >= len(self.check):  # grows by doubling
            more = 2 * slots - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots for children (parent slot, id), sorted; families of several first, lone children into the gaps."""
        slots = np.empty(len(ids), np.int64)
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        many = np.diff(np.r_[first, len(ids)])
        for f, m in zip(first[many > 1].tolist(), many[many > 1].tolist()):
            base = self._fit(ids[f : f + m])
            slots[f : f + m] = base + ids[f : f + m]
            self.base[parents[f]], self.check[slots[f : f + m]] = base, parents[f]
            self.top = max(self.top, int(slots[f + m - 1]) + 1)
        lone = first[many == 1]
        self._room(self.top + len(lone))
        free = self.low + np.flatnonzero(self.check[self.low : self.top + len(lone)] < 0)[: len(lone)]
        slots[lone] = free
        self.base[parents[lone]], self.check[free] = free - ids[lone], parents[lone]
        if len(lone):
            self.top, self.low = max(self.top, int(free[-1]) + 1), int(free[-1]) + 1
        return slots

    def _fit(self, ids: np.ndarray, tries: int = 64) -> int:
        """A base at which all ids fall on free slots: one of the first gaps, else behind all slots."""
        self._room(self.top + int(ids[-1] - ids[0]))
        gaps = self.low + np.flatnonzero(self.check[self.low : min(self.top, self.low + (tries << 6))] < 0)[:tries]
        for g in gaps.tolist():
            if (self.check[g + ids - ids[0]] < 0).all():
                return g - int(ids[0])
        return self.top - int(ids[0])

    def walk(self):
        """For each depth from 1 on: the sequences that reach it and the slots where they are."""
        at, state = np.arange(len(self.lens)), np.zeros(len(self.lens), np.int64)
        for depth in range(int(self.lens.max(initial=0))):
            state, at = state[self.lens[at] > depth], at[self.lens[at] > depth]
            nxt = self.base[state] + self.flat[self.starts[at] + depth]
            if (self.check[nxt] != state).any():
                raise AssertionError("a sequence left the trie")
            state = nxt
            yield at, state


def dense(keys: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """keys (pairs of uint64, the sequences' turns one after another) as ids 0, 1, ... in breadth-first order of their first place."""
    depth = np.arange(len(keys)) - np.repeat(np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64), lens)
    order = np.lexsort((np.arange(len(keys)), depth, keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(1)][: len(keys)]
    heads = order[new]  # the first place of each distinct turn
    rank = np.empty(len(heads), np.int64)
    rank[np.lexsort((heads, depth[heads]))] = np.arange(len(heads))
    ids = np.empty(len(keys), np.int64)
    ids[order] = rank[np.cumsum(new) - 1]
    return ids


NODES = "chain long, upper boolean, key binary, parent_key binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
NODES_ARROW = pa.schema([("chain", pa.int64()), ("upper", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int32())] + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")] + [("ends_sha256", pa.string())])


def _shard(batches):
    """Nodes of one shard, from its runs sorted by path and conv.

    Complete nodes come with their final aggregates; where the parent is an upper node, chain says by which chain it is known.
    Upper nodes come once for each chain through them; aggregates that more than one chain of the shard would tell are in
    the first. Their sums hold only what hangs below through complete children.
    """
    paths, sizes, n, low, hashes = [], [], [], [], []
    for b in batches:
        for p, s, c, k, ids in zip(*(b.column(x).to_pylist() for x in ("path", "sizes", "conv", "n", "ids"))):
            if paths and paths[-1] == p:
                n[-1] += k
                hashes[-1].update(b"," + ids.encode())
            else:
                paths.append(p)
                sizes.append(s)
                n.append(k)
                low.append(c)
                hashes.append(hashlib.sha256(ids.encode()))
    if not paths:
        return
    lens = np.array([len(p) // KEY for p in paths], np.int64)
    keys = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    trie = DoubleArray(dense(keys, lens), lens)
    n, low, flat = np.array(n, np.int64), np.array(low, np.int64), np.array([x for s in sizes for x in s], np.int64)
    slots = trie.top
    convs, least, size, kids, leaves, saved = (np.zeros(slots, np.int64) for _ in range(6))
    depth, end = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    least[:] = np.iinfo(np.int64).max
    upper, levels, ways = np.zeros(slots, bool), [], ([0], [0])
    convs[0], least[0], upper[0], end[0] = n.sum(), low.min(), True, 0 if not lens[0] else -1
    for d, (at, where) in enumerate(trie.walk(), 1):
        np.add.at(convs, where, n[at])
        np.minimum.at(least, where, low[at])
        size[where], depth[where] = flat[trie.starts[at] + d - 1], d
        done = lens[at] == d
        end[where[done]] = at[done]
        for way, i in zip(ways, (0, len(lens) - 1)):
            if lens[i] >= d:
                way.append(int(where[np.searchsorted(at, i)]))
        levels.append(np.unique(where))
    for way in ways:
        upper[way] = True
    parent = trie.check[:slots]
    for there in levels:
        np.add.at(kids, parent[there[~upper[there]]], 1)
    for there in reversed(levels):
        there = there[~upper[there]]
        leaves[there] += kids[there] == 0
        saved[there] += (convs[there] - 1) * size[there]
        np.add.at(leaves, parent[there], leaves[there])
        np.add.at(saved, parent[there], saved[there])
    ends = lambda s: hashes[end[s]].hexdigest() if end[s] >= 0 else None
    shard, rows, chain_of = TaskContext.get().partitionId(), [], {}
    for which, (way, i) in enumerate(zip(ways, (0, len(lens) - 1))):
        if which and len(lens) == 1:
            break
        prefix, above = hashlib.blake2b(digest_size=KEY), None
        for d, s in enumerate(way):
            if d:
                prefix.update(paths[i][KEY * (d - 1) : KEY * d])
            row = {"chain": 2 * shard + which, "upper": True, "key": prefix.copy().digest(), "parent_key": above, "depth": d, "size": int(size[s])}
            above = row["key"]
            told = {"conv_id": int(least[s]), "n_convs": int(convs[s]), "n_children": int(kids[s]), "n_leaves": int(leaves[s]), "saved_tokens": int(saved[s]), "ends_sha256": ends(s)}
            rows.append(row | (told if s not in chain_of else dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), 0)))
            chain_of.setdefault(s, 2 * shard + which)
    yield pa.RecordBatch.from_pylist(rows, schema=NODES_ARROW)
    for there in levels:
        there = there[~upper[there]]
        for part in (there[k : k + 20_000] for k in range(0, len(there), 20_000)):
            up, above = upper[parent[part]], parent[part]
            chain = pa.array([chain_of[s] if u else None for s, u in zip(above.tolist(), up)], pa.int64())
            known = pa.array(least[above], mask=up)
            none, text = pa.nulls(len(part), pa.binary()), pa.array([ends(s) for s in part], pa.string())
            numbers = [pa.array(x[part]) for x in (convs, kids, leaves, saved, size)]
            columns = [chain, pa.array(np.zeros(len(part), bool)), none, none, pa.array(depth[part].astype(np.int32)), pa.array(least[part]), known, *numbers, text]
            yield pa.RecordBatch.from_arrays(columns, schema=NODES_ARROW)
    release()


def trie_nodes(convs: DataFrame, each: int = 200_000) -> DataFrame:
    """A row for each node of the prefix trie of convs (conv_id, distinct and not null; items, arrays of (key, size)).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without children in the subtree,
    itself included), saved_tokens ((n_convs - 1) times the bytes of the last text, summed over the subtree) and
    ends_sha256 (SHA-256 of the ids of members that end here, ascending and joined by commas). The root has depth 0 and no
    parent; conversations without turns are its members. No conversations give no rows.

    A shard holds about `each` turns of distinct sequences. A sequence is one row, of 20 bytes a turn. SHA-256 reads
    its input in order by definition: copies of one sequence are joined into blocks of ids by many tasks, then hashed as a
    stream by the task that holds the sequence.
    """
    path = F.unhex(F.array_join(F.transform("items", lambda x: x["key"]), ""))
    flat = cut(convs.select("conv_id", path.alias("path"), F.transform("items", lambda x: x["size"].cast("int")).alias("sizes")))
    turns, rows = flat.agg(F.sum(F.size("sizes")), F.count("*")).first()
    many = dealt((turns or 0) + rows, each, 12)
    runs = flat.repartitionByRange(many, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    runs = cut(runs.mapInArrow(_runs, "path binary, sizes array<int>, conv long, n long, ids string"))
    nodes = runs.repartitionByRange(many, "path").sortWithinPartitions("path", "conv")
    nodes = cut(nodes.mapInArrow(_shard, NODES))
    upper, whole = nodes.where("upper"), nodes.where("not upper")
    return merged_upper(upper).unionByName(known_parents(whole, upper))


def _merge(upper: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    tops = [F.max(c).alias(c) for c in ("parent_key", "depth", "size", "ends_sha256")]
    return upper.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("chain").alias("owner"), *sums, *tops)


def merged_upper(upper: DataFrame) -> DataFrame:
    """Upper nodes of all shards as final nodes."""
    once = cut(_merge(upper))
    kids = once.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    once = once.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = once.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    own = own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    given = upper.select("chain", "key", "depth").join(own.select("key", "owner", "n_leaves", "saved_tokens"), "key")
    below = Window.partitionBy("chain").orderBy(F.desc("depth"))
    mine = lambda c: F.sum(F.when(F.col("owner") == F.col("chain"), F.col(c)).otherwise(0)).over(below)
    sums = given.select("key", mine("n_leaves").alias("n_leaves"), mine("saved_tokens").alias("saved_tokens"))
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = once.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return _final(own.drop("n_leaves", "saved_tokens").join(sums, "key").join(parents, "parent_key", "left"))


def known_parents(whole: DataFrame, upper: DataFrame) -> DataFrame:
    """Complete nodes with the parent's conv_id, which for an upper parent is looked up by shard chain and depth."""
    ways = upper.select("chain", F.col("depth"), "key").join(_merge(upper).select("key", F.col("conv_id").alias("above")), "key")
    ways = ways.select("chain", (F.col("depth") + 1).alias("depth"), "above")
    out = whole.join(ways, ["chain", "depth"], "left")
    return _final(out.withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")))


def _final(nodes: DataFrame) -> DataFrame:
    long = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *long, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie_nodes(rebuilt(cut(turn_sequences(table(spark, sf_dir, "conversations")))))


SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos
  from conversations where conv_id is not null),
convs as (select distinct conv_id, conv_id - conv_id % 5 as base from turns),
crc as (  -- CRC-32 of the decimal digits, a byte after another and bit by bit
  select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda b: ascii(b)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)), 4294967295) % 9 as h
  from convs),
made as (
  select c.conv_id, t.pos, t.role, t.text from convs c join crc using (conv_id) join turns t on t.conv_id = c.base and t.pos <= crc.h
  union all
  select c.conv_id, t.pos, t.role, t.text from convs c join crc using (conv_id) join turns t on t.conv_id = c.conv_id and t.pos > crc.h),
numbered as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, sha256(concat(length(role), ':', role, text)) as turn, strlen(text) as size from made),
prefixes as (
  select conv_id, depth, size, string_agg(turn, '') over (partition by conv_id order by depth) as prefix from numbered
  union all select conv_id, 0, 0, '' from convs),
lengths as (select conv_id, max(depth) as len from prefixes group by conv_id),
nodes as (
  select prefix, any_value(depth) as depth, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len = depth), '')) as ends_sha256
  from prefixes join lengths using (conv_id) group by prefix),
linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and starts_with(k.prefix, n.prefix)) as n_children
  from nodes n left join nodes p on n.depth > 0 and p.prefix = left(n.prefix, 64 * (n.depth::int - 1)))
select u.conv_id, u.depth::bigint as depth, u.parent_conv_id, u.n_convs, u.n_children,
  count(*) filter (where d.n_children = 0) as n_leaves, sum((d.n_convs - 1) * d.size)::bigint as saved_tokens, u.ends_sha256
from linked u join linked d on starts_with(d.prefix, u.prefix)
group by u.conv_id, u.depth, u.parent_conv_id, u.n_convs, u.n_children, u.ends_sha256, u.prefix
"""
