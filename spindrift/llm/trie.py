"""Prefix trie of conversations, with sums over subtrees by pointer jumping: rounds follow the logarithm of the depth."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import by_place, lookup, running
from .mixing import word_count
from .shared import arrow, cut, drop

#: Ids that are joined to one piece of text before a node's ids are hashed.
IDS = 4096
_PARTS = ("a", "b", "c", "d")


def _key(depth: Column, sums: list[Column]) -> Column:
    """A 16-byte digest of a sequence of turns from its length and the sums of its turns' hashes."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def _halves(place: Column) -> list[Column]:
    """A turn at its place as four 32-bit numbers: their sums over a sequence tell sequences apart, and add up in any order."""
    both = [F.xxhash64(F.lit(seed), place, F.col("u"), F.col("v")) for seed in (1, 2)]
    return [x for h in both for x in (h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32))]


def ordered_turns(conv: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, place, u, v, words) of each turn: two hashes of role and text, the text's words, and the place in the conversation from 0.

    Turns go by number, null first, then by role and text; null roles and texts
    count as empty; rows without a conversation are left out. A conversation may
    hold most of the table.
    """
    c = conv.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    t = running(c.where("conv_id is not null"), ["conv_id"], ["turn", "role", "text"], place="place")
    return t.select("conv_id", "place", F.xxhash64(F.lit(3), "role", F.lit("|"), "text").alias("u"), F.xxhash64(F.lit(4), "role", F.lit("|"), "text").alias("v"), word_count("text").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations with their places, and all conversations (conv_id).

    A conversation takes its first h = crc32(conv_id) % ``most`` turns from
    conversation conv_id - conv_id % ``every`` (all of them if it has fewer, none
    if it isn't there), and its own turns after its first h behind them.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")), "convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = cut(convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k")), "taken")
    firsts = turns.where((F.col("place") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lent = taken.where("k > 0").select("conv_id", "base", "k").join(firsts, "base").where("place < k").select("conv_id", "place", "u", "v", "words")
    short = taken.where("k < h").select("conv_id", F.col("h") - F.col("k"))
    own = lookup(turns.withColumn("h", h).where("place >= h"), short.toDF("conv_id", "less"), "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "u", "v", "words")
    return lent.unionByName(own), convs.select("conv_id")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words): a row for each conversation and each prefix of it, the empty one included."""
    halves = dict(zip(_PARTS, _halves(F.col("place")), strict=True))
    t = by_place(cut(turns, "turns"), ["conv_id"], "place", halves)
    whole = [F.col(p) for p in _PARTS]
    before = [F.col(p) - x for p, x in zip(_PARTS, _halves(F.col("place")), strict=True)]
    rows = t.select("conv_id", (F.col("place") + 1).alias("depth"), _key(F.col("place") + 1, whole).alias("key"), _key(F.col("place"), before).alias("parent"), "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"))
    return rows.unionByName(root)


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): ids are sorted over the cluster and joined to pieces of ``IDS``; a node's pieces then stream through one hash."""

    def fold(batches):
        key, ids, out = None, [], []

        def pop():
            out.append((key, ids[0], len(ids), ",".join(map(str, ids))))

        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or len(ids) == IDS:
                    if ids:
                        pop()
                    key, ids = k, []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "low", "n", "ids"])
            out = []
        if ids:
            pop()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "low", "n", "ids"])

    def digest(batches):
        key, h, out = None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])

        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(s.encode())
                else:
                    h.update(b"," + s.encode())
            yield batch()
            out = []
        if key is not None:
            out.append((key, h.hexdigest()))
            yield batch()

    pieces = arrow(ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), fold, "key binary, low long, n long, ids string")
    return arrow(pieces.repartition("key").sortWithinPartitions("key", "low").select("key", "ids"), digest, "key binary, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (key, parent, values) with each value summed over the node's subtree, itself included.

    Pointer jumping: after round k a node's sums cover its descendants less than
    2^k levels below and its pointer is its ancestor 2^k levels above. A round
    adds the sums of those that point to a node to its own and takes over the
    pointer of the node pointed to, so a trie of depth d takes log2(d) + 1
    rounds, each written to the shared folder. Nodes to which many point are
    broadcast (``scans.lookup``), the sums are combined before the shuffle.
    """
    state = cut(nodes.select("key", F.col("parent").alias("up"), *values), "jump")
    while state.where("up is not null").limit(1).count():
        live = cut(state.where("up is not null"), "live")
        add = live.groupBy(F.col("up").alias("key")).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        far = lookup(live.select("key", "up"), state.select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("key", "next")
        new = state.join(add, "key", "left").join(far, "key", "left")
        new = cut(new.select("key", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]), "jump")
        drop(state, live)
        state = new
    return state.select("key", *values)


def trie(conv: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", every: int = 20, most: int = 4) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations: (key, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversations of which nothing is left are members of the root. Turns without
    a conversation are left out, repeated turns are turns, ties go by role and
    text, an empty table has no node, further columns are ignored.
    """
    turns = cut(ordered_turns(conv, conv_col, turn_col, role_col, text_col), "places")
    rows = cut(prefixes(*rebuilt(turns, every, most)), "prefixes")
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = cut(nodes, "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    ends = _digests(rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key")))
    full = nodes.join(kids, "key", "left").join(ends, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    full = full.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    full = cut(full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("words"), "counted")
    sums = roll_up(full, ["n_leaves", "saved_tokens"])
    named = lookup(full.drop("n_leaves", "saved_tokens"), nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return named.join(sums, "key").select("key", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_report(conv: DataFrame) -> DataFrame:
    return trie(conv).drop("key", "parent")


# A fixed value: the polynomial of CRC-32, bits reversed.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(regexp_extract_all(conv_id::varchar, '.'), lambda z: [ascii(z)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295::bigint)"

SQL = rf"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '') collate "C", coalesce(text, '') collate "C") - 1 as place from conversations where conv_id is not null),
l as materialized (select conv_id, list({{'role': role, 'text': text}} order by place) as own, {_CRC} % 4 as h from t group by conv_id),
r as materialized (select l.conv_id, list_concat(coalesce(b.own[1 : l.h], []), l.own[l.h + 1 :]) as s from l left join l b on b.conv_id = l.conv_id - l.conv_id % 20),
p as materialized (select conv_id, d as depth, md5(s[1 : d]::varchar) || d as key, case when d > 0 then md5(s[1 : d - 1]::varchar) || (d - 1) end as parent, d = len(s) as ends,
  case when d = 0 then 0 else len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) end as words from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from r)),
n as materialized (select key, min(conv_id) as conv_id, any_value(depth) as depth, any_value(parent) as parent, count(*) as n_convs, any_value(words) as words, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from p group by key),
k as materialized (select n.*, coalesce(c, 0) as n_children, (n_convs - 1) * words as saves from n left join (select parent as key, count(*) as c from n where parent is not null group by parent) using (key)),
u as (select p.key, sum((k.n_children = 0)::int)::bigint as n_leaves, sum(k.saves)::bigint as saved_tokens from k join p on p.conv_id = k.conv_id and p.depth <= k.depth group by p.key)
select k.conv_id, k.depth, q.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256 from k join u using (key) left join n q on q.key = k.parent
"""
