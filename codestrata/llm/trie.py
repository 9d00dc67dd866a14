"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, built per range of sorted keys and merged.

A turn id is the MD5 of its role and text, 16 bytes.  A conversation's key is its turn ids one after the other, cut into segments
of ``SEGMENT`` turns; equal segments below an equal prefix are one row with a count.  Rows are sorted by (prefix, key) over all
tasks, and each task builds a tree per prefix and ``RUN_KEYS`` keys; only byte depths that are whole turns are nodes.  A node
whose keys all lie within one run is whole there.  The others lie on the paths of a run's first or last key, or of keys that
go on below their segment: they come out with what hangs below them, are summed by id and handed to their ancestors.  Turns
below the last prefix that two conversations share are a chain of one conversation, for which no tree is needed.  Segments
that conversations share are finished from the deepest up: one small job per ``SEGMENT`` turns of the longest shared prefix.

The prefix of a segment is told by the exclusive or of hashes of the segments before it, each with its number: a running sum over
sorted ranges, as is the numbering of turns, so that no conversation has to fit into a task.

Rows without ``conv_id`` are in no conversation.  A null role or text is empty.  Turns are ordered by ``turn``, null first, then by
turn id; repeated rows are turns of their own.  Other columns than conv_id, turn, role and text are not read.  An empty table
has no nodes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import common
from .radix import Tree

WIDTH = 16
SEGMENT = 32
RUN_KEYS = 20_000
HEAD = 8  # turns that a conversation may take over from the one it continues
PIECE_BYTES = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def counting_runs(key: str, values: list[str]):
    """Arrow function over sorted rows: number of each row among those of its key, and running exclusive or of ``values``."""

    def run(batches):
        last, number, held = None, 0, [np.int64(0)] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(first, len(keys)))
            goes_on = last is not None and keys[0] == last
            nth = np.arange(1, len(keys) + 1) - np.repeat(first, size)
            nth[: size[0]] += number if goes_on else 0
            out = [nth]
            for k, name in enumerate(values):
                sums = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
                before = np.append(np.int64(0), sums)[first]
                before[0] = held[k] if goes_on else 0
                sums ^= np.repeat(before, size)
                held[k] = sums[-1]
                out.append(sums)
            last, number = keys[-1], int(nth[-1])
            columns = [pa.array(x.astype(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "nth", *[f"run_{v}" for v in values]])

    return run


def running(df: DataFrame, key: str, order: list[Column], values: list[str], name: str) -> DataFrame:
    """``df`` with ``nth``, the place of each row among those of its key, and ``run_v`` for each of ``values``.

    Rows are sorted over all tasks by key and order, so one key's rows may fill many; what the tasks before hold of a key is
    added from a table of at most two rows a task.
    """
    # Rows equal in all of this may lie in any order: the last column lets them fill several tasks.
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} long" for c in ("nth", *[f"run_{v}" for v in values]))
    rows = common.staged(rows.mapInArrow(counting_runs(key, values), schema).withColumn("part", F.spark_partition_id()), name)
    edges = rows.groupBy("part").agg(F.array(F.min(key), F.max(key)).alias("edge")).select(F.explode("edge").alias(key)).distinct()
    sums = [F.count(F.lit(1)).alias("n"), *[F.bit_xor(v).alias(f"x_{v}") for v in values]]
    held = rows.join(F.broadcast(edges), key, "left_semi").groupBy(key, "part").agg(*sums)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("n").over(before).alias("n_before"), *[F.bit_xor(f"x_{v}").over(before).alias(f"{v}_before") for v in values]]
    held = held.select(key, "part", *carried).where("n_before is not null")
    rows = rows.join(F.broadcast(held), [key, "part"], "left")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("nth", F.col("nth") + F.coalesce("n_before", zero))
    for v in values:
        rows = rows.withColumn(f"run_{v}", F.col(f"run_{v}").bitwiseXOR(F.coalesce(f"{v}_before", zero)))
    return rows.drop("part", "n_before", *[f"{v}_before" for v in values])


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns by place: conv_id, nth (from 1), tid (turn id) and bytes (of the text in UTF-8)."""
    role, text = [F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text")]
    tid = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), tid.alias("tid"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = rows.where("conv_id is not null")
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("tid")], [], "turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c anew: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9.

    Returns the turns (conv_id, pos, tid, bytes) and the conversations (conv_id, total), those without turns included.
    """
    own = turns.groupBy("conv_id").agg(F.max("nth").alias("own"))
    heads = turns.where(f"conv_id % 5 = 0 and nth <= {HEAD}").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("nth", "tid", "bytes"))).alias("head"))
    convs = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")).withColumn("base", F.expr("conv_id - conv_id % 5"))
    convs = convs.join(heads, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h")))
    convs = common.staged(convs.select("conv_id", "h", "taken", "total", "head"), "conversations")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("nth > h")
    kept = kept.select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("pos"), "tid", "bytes")
    given = convs.where("taken > 0").select("conv_id", F.inline(F.slice("head", F.lit(1), F.col("taken"))))
    given = given.select("conv_id", F.col("nth").alias("pos"), "tid", "bytes")
    return kept.unionByName(given), convs.select("conv_id", "total")


def told(*numbers: Column) -> Column:
    """Longs as big-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(n.cast("long")), 16, "0") for n in numbers]))


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and segment: its key, sizes of its texts, its prefix (a1, a2) and the prefix below it (z1, z2)."""
    numbers = turns.withColumn("seg", F.expr(f"(pos - 1) div {SEGMENT}")).groupBy("conv_id", "seg")
    rows = numbers.agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "bytes"))).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["tid"])), ""))
    rows = rows.select("conv_id", "seg", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    none = convs.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), F.unhex(F.lit("")).alias("key"), F.array().cast("array<long>").alias("sizes"))
    rows = rows.join(convs.where("total > 0"), "conv_id").unionByName(none.withColumn("total", F.lit(0).cast("long")))
    rows = rows.withColumn("x1", F.xxhash64("seg", "key")).withColumn("x2", F.xxhash64(F.lit(1), "seg", "key"))
    rows = common.staged(rows, "segments")
    zero = F.lit(0).cast("long")
    short = rows.where(f"total <= {SEGMENT}").withColumn("z1", F.col("x1")).withColumn("z2", F.col("x2"))
    long = running(rows.where(f"total > {SEGMENT}"), "conv_id", [F.col("seg")], ["x1", "x2"], "long-segments")
    long = long.withColumnsRenamed({"run_x1": "z1", "run_x2": "z2"}).drop("nth")
    both = short.unionByName(long)
    for k in ("1", "2"):
        both = both.withColumn(f"a{k}", F.when(F.col("seg") == 0, zero).otherwise(F.col(f"z{k}").bitwiseXOR(F.col(f"x{k}"))))
    return both.withColumn("goes_on", F.col("total") > (F.col("seg") + 1) * SEGMENT).drop("x1", "x2", "total")


NODE = (
    "id binary, parent binary, depth long, n_convs long, conv_id long, bytes long, n_children long, n_leaves long, saved long, "
    "partial boolean, ancestors array<binary>, parent_conv_id long"
)


def run_nodes(seg: int, a1: int, a2: int, rows: list[tuple]) -> list[tuple]:
    """Nodes of one tree over sorted distinct keys: rows are (key, z1, z2, sizes, n, smallest conversation, how many go on)."""
    tree = Tree()
    for i, row in enumerate(rows):
        tree.insert(row[0], i)
    parents, depths, ends = tree.levels(WIDTH)
    count = len(parents)
    n, least, sample = [0] * count, [None] * count, [0] * count
    kids, leaves, saved, partial = [0] * count, [0] * count, [0] * count, [False] * count
    partial[0] = True
    for i, row in enumerate(ends):
        if row < 0:
            continue
        key, _, _, _, convs, smallest, on = rows[row]
        n[i], least[i], sample[i] = convs, smallest, row
        if on == 1:  # goes on as a chain of its own
            kids[i], leaves[i] = 1, 1
        if row in (0, len(rows) - 1) or on and convs > 1:
            at = i
            while not partial[at]:
                partial[at] = True
                at = parents[at]
    for i in range(count - 1, 0, -1):
        up = parents[i]
        n[up] += n[i]
        least[up] = least[i] if least[up] is None else min(least[up], least[i])
        sample[up] = sample[i]
        if not partial[i]:
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * rows[sample[i]][3][depths[i] - 1]
            kids[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    head = struct.pack(">qqq", seg, a1, a2)
    ids, lines, out = [], [], []
    for i in range(count):
        key, z1, z2, sizes = rows[sample[i]][:4] if rows else (b"", 0, 0, [])
        depth, up = depths[i], parents[i]
        if depth == SEGMENT:
            ids.append(hashlib.md5(struct.pack(">qqq", seg + 1, z1, z2)).digest())
        else:
            ids.append(hashlib.md5(head + key[: depth * WIDTH]).digest())
        top = i == 0 and seg > 0  # counted at the end of the segment above
        lines.append((*lines[up], ids[up]) if up >= 0 and partial[i] else ())
        out.append(
            (
                ids[i], ids[up] if up >= 0 else None, seg * SEGMENT + depth, 0 if top else n[i], None if top else least[i], 0 if top or not depth else sizes[depth - 1],
                kids[i], leaves[i], saved[i], partial[i], list(lines[i]) if partial[i] and not top else None, None if up < 0 or partial[up] else least[up],
            )
        )
    return out


def building(batches):
    """Arrow function over sorted keys: nodes of a tree per prefix and run."""
    schema = pa.schema(
        [("id", pa.binary()), ("parent", pa.binary())]
        + [(c, pa.int64()) for c in ("depth", "n_convs", "conv_id", "bytes", "n_children", "n_leaves", "saved")]
        + [("partial", pa.bool_()), ("ancestors", pa.list_(pa.binary())), ("parent_conv_id", pa.int64())]
    )

    def batch_of(prefix, rows):
        found = list(zip(*run_nodes(*prefix, rows)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    prefix, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("seg", "a1", "a2", "key", "z1", "z2", "sizes", "n", "conv_id", "on")]
        for seg, a1, a2, *row in zip(*columns):
            if held and (prefix != (seg, a1, a2) or len(held) >= RUN_KEYS):
                yield batch_of(prefix, held)
                held = []
            prefix = (seg, a1, a2)
            held.append(row)
    if held:
        yield batch_of(prefix, held)


def hashing_ends(batches):
    """Arrow function over ids sorted with their conversations: SHA-256 of whole lists, and pieces of those that may be cut."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["id", "sha", "part", "piece", "text"]

    def batch_of(rows):
        types = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    current, text, size, piece, first, out = None, [], 0, 0, True, []

    def close(last):
        if first or last or piece:
            return (current, None, part, piece, ",".join(text))
        return (current, hashlib.sha256(",".join(text).encode()).hexdigest(), part, 0, None)

    for batch in batches:
        for node, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
            if node != current:
                if current is not None:
                    out.append(close(False))
                    first = False
                current, text, size, piece = node, [], 0, 0
            elif size > PIECE_BYTES:
                out.append((current, None, part, piece, ",".join(text)))
                text, size, piece = [], 0, piece + 1
            text.append(str(conv))
            size += len(text[-1]) + 1
        if out:
            yield batch_of(out)
            out = []
    if current is not None:
        yield batch_of([close(True)])


def joining_ends(batches):
    """Arrow function over pieces in order: SHA-256 of each id's whole list, one piece in memory."""

    def batch_of(node, state):
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["id", "sha"])

    current, state = None, None
    for batch in batches:
        for node, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if node != current:
                if state is not None:
                    yield batch_of(current, state)
                current, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if state is not None:
        yield batch_of(current, state)


def ends_of(ended: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conversations, ascending, per id.  A list longer than a task's share goes on as pieces."""
    rows = ended.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    rows = common.staged(rows.mapInArrow(hashing_ends, "id binary, sha string, part int, piece int, text string"), "ends")
    pieces = rows.where("sha is null").repartition("id").sortWithinPartitions("id", "part", "piece")
    return rows.where("sha is not null").select("id", "sha").unionByName(pieces.select("id", "text").mapInArrow(joining_ends, "id binary, sha string"))


def finished(partial: DataFrame) -> DataFrame:
    """Nodes that several runs tell parts of, with what hangs below them."""
    merged = partial.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ancestors").alias("ancestors"),
    )
    merged = common.staged(merged, "trie-partial")
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    nodes = merged.join(below, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).drop("more")
    nodes = common.staged(nodes.withColumn("level", F.expr(f"greatest(depth - 1, 0) div {SEGMENT}")), "trie-merged")
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    out, below = None, None
    for level in range(deepest, -1, -1):
        own = nodes.where(F.col("level") == level)
        if below is not None:  # what the segment below tells of its top, which is a node of this one
            own = own.join(below, "id", "left")
            own = own.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        up = own.select(F.explode(F.concat(F.array("id"), "ancestors")).alias("id"), "n_leaves", "saved")
        sums = common.staged(up.groupBy("id").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), f"trie-level-{level}")
        whole = nodes.where(F.col("level") == level).join(sums, "id")
        whole = whole.select("id", "parent", "depth", "n_convs", "conv_id", "n_children", F.col("more_leaves").alias("n_leaves"), F.col("more_saved").alias("saved"))
        out, below = (whole if out is None else out.unionByName(whole)), sums
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations' turns.

    ``turns``: conv_id, pos (from 1, gapless), tid (16 bytes) and bytes; ``convs``: conv_id and total, all conversations, also those
    without turns.  Returns per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    rows = segments(turns, convs)
    prefix = ["seg", "a1", "a2"]
    whole = F.octet_length("key") == SEGMENT * WIDTH
    end_id = F.when(whole, F.md5(told(F.col("seg") + 1, F.col("z1"), F.col("z2")))).otherwise(F.md5(F.concat(told(*[F.col(c) for c in prefix]), F.col("key"))))
    rows = common.staged(rows.withColumn("id", F.when(~F.col("goes_on"), F.unhex(end_id))), "trie-rows")
    keys = rows.groupBy(*prefix, "z1", "z2", "key", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.col("goes_on").cast("long")).alias("on"))
    keys = common.staged(keys, "trie-keys")
    members = keys.where("seg > 0").groupBy(*prefix).agg(F.sum("n").alias("members"))
    deep = common.staged(keys.where("seg > 0").join(members, prefix), "trie-deep")
    trees = keys.where("seg = 0").unionByName(deep.where("members > 1").drop("members"))
    trees = trees.repartitionByRange(*prefix, "key").sortWithinPartitions(*prefix, "key")
    trees = common.staged(trees.mapInArrow(building, NODE), "trie-nodes")

    shared = common.staged(finished(trees.where("partial")), "trie-shared")
    owners = broadcast_if_small(shared.select(F.col("id").alias("parent"), F.col("conv_id").alias("owner")))
    columns = ["id", "parent", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved"]
    inner = trees.where("not partial and parent_conv_id is not null").select(*columns, "parent_conv_id")
    outer = trees.where("not partial and parent_conv_id is null").select(*columns).unionByName(shared.select(*columns))
    outer = outer.join(owners, "parent", "left").select(*columns, F.col("owner").alias("parent_conv_id"))
    nodes = inner.unionByName(outer).join(ends_of(rows.where("id is not null").select("id", "conv_id")), "id", "left")
    nodes = nodes.withColumn("sha", F.coalesce("sha", F.lit(NO_ENDS)))

    chains = deep.where("members = 1").select("*", F.posexplode("sizes").alias("at", "bytes"))
    last = (F.col("at") == F.size("sizes") - 1) & (F.col("on") == 0)
    one = F.lit(1).cast("long")
    chains = chains.select(
        F.when(F.col("at") == 0, F.unhex(F.md5(told(*[F.col(c) for c in prefix])))).alias("parent"),
        (F.col("seg") * SEGMENT + F.col("at") + 1).alias("depth"), one.alias("n_convs"), "conv_id",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS)).alias("sha"),
    )
    chains = chains.join(owners, "parent", "left").withColumn("parent_conv_id", F.coalesce("owner", "conv_id"))
    told_columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256")]
    return nodes.select(*told_columns).unionByName(chains.select(*told_columns))
