"""Prefix trie of conversations as a burst trie: containers of suffixes under heads, oversized ones burst by the next turn, the others sorted and swept into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a turn's id: the MD5 digest of its role and text.
ID = 16
#: A container of more conversations bursts.
CONTAINER = 1_000
#: Conversation ids that are joined into one piece of text before a node's digest is taken.
CHUNK = 1 << 14

#: prefix is set for a container's top node only.
_NODE = "prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id, words): each conversation's turns by turn number, null first, ties by role and text; null roles and texts are empty.
    Rows without a conv_id are in no conversation."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    # the role's length tells where the role ends
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("conv_id", pos.alias("pos"), digest.alias("id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def sequences(ordered: DataFrame) -> DataFrame:
    """(conv_id, ids binary, words array<long>) of rows (conv_id, pos, id, words): the turns' ids one after the other."""
    turns = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))
    held = ordered.groupBy("conv_id").agg(turns.alias("turns"))
    # hexadecimal digits join as text; bytes of an array do not
    held = held.withColumn("turns", F.filter("turns", lambda t: t["id"].isNotNull()))
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return held.select("conv_id", F.coalesce(ids, F.lit(b"")).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))


def rebuilt(ordered: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % group, then its own turns behind its first h; h is the CRC-32 of c's digits modulo heads.

    Only a conversation's first heads - 1 turns are joined, and they go to group conversations at most.
    Returns (conv_id, pos, id, words), and a row with null id for a conversation without turns.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = ordered.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("head"))
    firsts = ordered.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    # in one order: what is taken stands at 1, 2, ...; own turns follow from head + 1 on, and gaps between do not matter
    taken = convs.join(firsts, "base").where(F.col("pos") <= F.col("head")).select("conv_id", "pos", "id", "words")
    own = ordered.withColumn("head", head).where(F.col("pos") > F.col("head")).select("conv_id", "pos", "id", "words")
    none = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(none)


def _prefix(depth) -> Column:
    return F.substring(F.col("ids"), F.lit(1), (depth * ID).cast("int"))


def _burst(convs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Heads (prefix, depth, n_convs, conv_id, words) and conversations (conv_id, ids, words, cut): a conversation of `cut` turns ends at the head of that depth,
    and a longer one is in the container of its first cut + 1 turns.

    The root is a head. Containers are counted by the turns that follow a head; those of more than `most` conversations burst. The common
    prefix of a container's smallest and greatest sequence is common to all, so the heads on it come at once, and a round either splits a container or ends conversations in it.
    """
    n_turns = F.size("words")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    heads = root.select(F.lit(b"").alias("prefix"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"))
    done, pending = [], convs.withColumn("cut", F.lit(0).cast("long"))
    while True:
        done.append(pending.where(n_turns <= F.col("cut")))
        open_ = pending.where(n_turns > F.col("cut")).withColumn("container", _prefix(F.col("cut") + 1))
        ends = F.struct("ids", "words")
        groups = open_.groupBy("container").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("cut").alias("at"), F.min_by(ends, "ids").alias("low"), F.max("ids").alias("high"))
        groups = written(groups.where(F.col("n_convs") > most), "burst")
        if groups.isEmpty():
            done.append(open_.drop("container"))
            break
        # the first turn at which the smallest and the greatest differ, or the end of the smallest
        low = F.size("low.words")
        differ = F.filter(F.sequence(F.col("at") + 2, low.cast("long")), lambda d: F.substring("low.ids", ((d - 1) * ID + 1).cast("int"), F.lit(ID)) != F.substring("high", ((d - 1) * ID + 1).cast("int"), F.lit(ID)))
        last = F.when(low < F.col("at") + 2, F.col("at") + 1).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, low.cast("long")))
        groups = groups.withColumn("last", last)
        chain = groups.select("n_convs", "conv_id", F.col("low.ids").alias("ids"), "low.words", F.explode(F.sequence(F.col("at") + 1, F.col("last"))).alias("depth"))
        heads = heads.unionByName(chain.select(_prefix(F.col("depth")).alias("prefix"), "depth", "n_convs", "conv_id", F.element_at("words", F.col("depth").cast("int")).alias("words")))
        held = open_.join(groups.select("container", "last"), "container", "left")
        done.append(held.where("last is null").drop("container", "last"))
        pending = written(held.where("last is not null").select("conv_id", "ids", "words", F.col("last").alias("cut")), "pending")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return heads, out


class _Node:
    __slots__ = ("depth", "words", "conv_id", "n_convs", "n_leaves", "saved", "digest", "children")

    def __init__(self, depth: int, words: int):
        self.depth, self.words = depth, words
        self.conv_id, self.n_convs, self.n_leaves, self.saved, self.digest = None, 0, 0, 0, None
        self.children: list[tuple] = []  # finished nodes that wait for the smallest member

    def end(self, conv_id: int) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256(b"%d" % conv_id)
        else:
            self.digest.update(b",%d" % conv_id)


def sweep(rows: Iterator[tuple[bytes, int, list[int], int]]) -> Iterator[list[tuple]]:
    """The nodes of each container from (ids, conv_id, words, cut), sorted by ids and conv_id: a stack holds the path of open nodes, and a node closes when a
    sequence leaves it. A node's children wait for its smallest member; so at most one container's nodes are held."""
    stack: list[_Node] = []
    out: list[tuple] = []
    prefix = before = b""

    def close() -> None:
        node = stack.pop()
        out.extend((*row[:3], node.conv_id, *row[3:]) for row in node.children)
        leaves = node.n_leaves or 1
        saved = node.saved + (node.n_convs - 1) * node.words
        row = (node.conv_id, node.depth, node.n_convs, len(node.children), leaves, saved, node.digest.hexdigest() if node.digest else _EMPTY)
        if not stack:
            out.append((prefix, *row[:2], None, *row[2:]))
            return
        above = stack[-1]
        above.n_convs += node.n_convs
        above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
        above.n_leaves += leaves
        above.saved += saved
        above.children.append((None, *row))

    for ids, conv_id, words, cut in rows:
        first, end = cut + 1, len(words)
        common = 0
        if stack and first == stack[0].depth and ids[: first * ID] == prefix:
            common = first
            while common < end and common < stack[-1].depth and ids[common * ID : (common + 1) * ID] == before[common * ID : (common + 1) * ID]:
                common += 1
        while stack and stack[-1].depth > common:
            close()
        if not stack:
            if out:
                yield out
            out, prefix = [], ids[: first * ID]
        for depth in range(max(first, common + 1), end + 1):
            stack.append(_Node(depth, words[depth - 1]))
        node = stack[-1]
        node.n_convs += 1
        node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
        node.end(conv_id)
        before = ids
    while stack:
        close()
    if out:
        yield out


def _swept(containers: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _NODE.split(", ")]
    types = [pa.binary(), *[pa.int64()] * 7, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)))

        out: list[tuple] = []
        for nodes in sweep(rows()):
            out += nodes
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = containers.withColumn("container", F.md5(_prefix(F.col("cut") + 1))).repartition("container").sortWithinPartitions("container", "ids", "conv_id")
    return rows.select("ids", "conv_id", "words", "cut").mapInArrow(run, _NODE)


def _end_digests(ended: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of (prefix, conv_id): the digest of the ids in order. Tasks join CHUNK ids' range into one text each; a digest is sequential, so
    one task reads a head's texts in order and keeps nothing but the digest's state."""
    chunk = F.expr(f"conv_id div {CHUNK}")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ended.groupBy("prefix", chunk.alias("chunk")).agg(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, digest = None, None
        for batch in batches:
            out = []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != prefix:
                    if digest is not None:
                        out.append((prefix, digest.hexdigest()))
                    prefix, digest = p, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
            yield pa.RecordBatch.from_pydict({"prefix": pa.array([p for p, _ in out], pa.binary()), "ends_sha256": pa.array([d for _, d in out], pa.string())})
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"prefix": pa.array([prefix], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    return chunks.repartition("prefix").sortWithinPartitions("prefix", "chunk").select("prefix", "text").mapInArrow(run, "prefix binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, most: int = CONTAINER) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct sequence of a conversation's first turns.

    convs: (conv_id, ids, words), as of sequences(), one row a conversation. conv_id is the smallest member, parent_conv_id the parent's (null for the root),
    n_convs the members, n_children the nodes one turn longer, n_leaves the childless nodes in the subtree (itself if it is one), saved_tokens the sum over the
    subtree of (n_convs - 1) times the words of a node's last turn, ends_sha256 the digest of the members of just these turns (ascending, comma-joined). No conversations give no node.

    Heads of the burst trie are the nodes of more than `most` members, and the root. Their subtree sums are added up from the containers below, each of which
    tells all heads above it. A conversation is one row, 16 bytes and a number for each turn.
    """
    heads, placed = _burst(written(convs, "conversations"), most)
    placed = written(placed, "placed")
    heads = written(heads, "heads")
    nodes = written(_swept(placed.where(F.size("words") > F.col("cut"))), "nodes")
    ended = placed.where(F.size("words") == F.col("cut")).select(_prefix(F.col("cut")).alias("prefix"), "conv_id")
    digests = _end_digests(ended)

    above = lambda prefix, depth: F.substring(prefix, F.lit(1), ((depth - 1) * ID).cast("int"))
    tops = nodes.where("prefix is not null").select("prefix", "depth", "n_leaves", "saved_tokens")
    children = tops.select(above("prefix", F.col("depth")).alias("prefix")).unionByName(heads.where("depth > 0").select(above("prefix", F.col("depth")).alias("prefix")))
    children = children.groupBy("prefix").agg(F.count("*").alias("n_children"))
    own = written(heads.join(children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "heads-children")
    # what a head or a container adds to each head on its path
    path = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at")
    sums = tops.select("prefix", path(F.col("depth") - 1), "n_leaves", "saved_tokens").unionByName(
        own.select("prefix", path(F.col("depth")), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    )
    sums = sums.groupBy(F.substring("prefix", F.lit(1), (F.col("at") * ID).cast("int")).alias("prefix")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = heads.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("of_parent"))
    of_heads = own.join(sums, "prefix").join(digests, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_heads = of_heads.withColumn("parent", F.when(F.col("depth") > 0, above("prefix", F.col("depth")))).join(parents, "parent", "left").withColumn("parent_conv_id", F.col("of_parent"))
    of_tops = nodes.where("prefix is not null").withColumn("parent", above("prefix", F.col("depth"))).join(parents, "parent", "left").withColumn("parent_conv_id", F.col("of_parent"))
    return of_heads.select(*columns).unionByName(of_tops.select(*columns)).unionByName(nodes.where("prefix is null").select(*columns))
