"""Token-id files: static range asymmetric numeral system (rANS) over shared frequency tables.

Every whole text is encoded with a public tokenizer and an end id; the ids of all documents, in ascending order of
``doc_id`` (nulls first, repeated ids each for itself), are written as a table of independent blocks of whole documents.
A block is coded in ``LANES`` interleaved states: id ``i`` belongs to lane ``i % LANES``.  Every ``CHECKPOINT`` rows of
lanes the states and the place in the word stream are noted, so that parts of one block decode in parallel, and each
block carries the CRC-32 of its ids.  All blocks share one table of id frequencies, counted over all documents.

Null text: empty, so the end id alone.  Empty input: empty table.  The frequency table has one row per id of the
vocabulary, which bounds what reaches the driver; ids and blocks stay in tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices, staged

LANES = 32
CHECKPOINT = 512
BLOCK_TOKENS = 65_536
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
CODED_AT_ONCE = 4_000_000

IDS = "doc_id long, n_tokens long, ids binary, key long, row long"
BLOCKS = """file int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>,
    crc32 long, states binary, words binary, checkpoint_at array<long>, checkpoint_states binary"""


def id_type(tokenizer: str, end_id: int) -> str:
    """Type of the ids between the steps: two bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", dtype: str = "<u4") -> DataFrame:
    """``doc_id, n_tokens, ids``: ids of each whole text and the end id, as little-endian unsigned integers.

    ``key`` (CRC-32 of the ids) and ``row`` order rows that repeat an id.
    """

    def run(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        from .tokens import encoder

        enc, row, width = encoder(tokenizer), TaskContext.get().partitionId() << 33, np.dtype(dtype).itemsize
        for batch in slices(batches, "text"):
            ids, counts = enc.encode(batch.column(1))
            upto = np.cumsum(counts)
            ids = np.insert(ids, upto, end_id).astype(dtype)
            ends = np.concatenate([[0], width * (upto + np.arange(1, len(counts) + 1))]).astype(np.int64)
            value = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            raw = memoryview(ids).cast("B")
            keys = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())
            rows = pa.array(np.arange(row, row + len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1, pa.int64()), value.cast(pa.binary()), keys, rows], names=["doc_id", "n_tokens", "ids", "key", "row"])

    rows = documents(docs, "doc_id", text).toDF("doc_id", "text")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, IDS)


def id_counts(ids: DataFrame, dtype: str = "<u4") -> DataFrame:
    """``id, n``: how often each id occurs; every task sums its own first."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())  # the rows' ids lie one after the other
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if not len(column) or ends[-1] == ends[0]:
                continue
            n = np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype))
            if len(n) > len(total):
                total, n = n.astype(np.int64), total
            total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Table:
    """Frequencies scaled to a sum of 2 to the power of ``bits``, at least 1 for each id that occurs."""

    def __init__(self, ids, counts, bits: int = SCALE_BITS):
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.float64)
        if len(ids) > 1 << bits:
            raise ValueError("more ids than the frequency scale can tell apart")
        self.bits = np.uint64(bits)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        if len(ids):
            order = np.argsort(ids)
            ids, counts = ids[order], counts[order]
            scaled = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
            excess = int(scaled.sum()) - (1 << bits)
            for i in np.argsort(-scaled, kind="stable"):  # what rounding left over goes to the most frequent ids
                step = min(excess, int(scaled[i]) - 1) if excess > 0 else excess
                scaled[i] -= step
                excess -= step
                if not excess:
                    break
            self.freq[ids] = scaled.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))


def encode_blocks(table: Table, blocks: list[np.ndarray]) -> list[tuple]:
    """``(states, words, checkpoint_at, checkpoint_states)`` of each block; all blocks advance together, last ids first."""
    rows = np.array([-(-len(b) // LANES) for b in blocks])
    order = np.argsort(-rows, kind="stable")
    height, n = int(rows.max(initial=0)), len(blocks)
    grid = np.zeros((height, n, LANES), np.uint32)
    live = np.zeros((height, n, LANES), bool)
    for k, i in enumerate(order):
        flat = np.zeros(rows[i] * LANES, np.uint32)
        flat[: len(blocks[i])] = blocks[i]
        grid[: rows[i], k] = flat.reshape(-1, LANES)
        live[: rows[i], k] = (np.arange(rows[i] * LANES) < len(blocks[i])).reshape(-1, LANES)
    state = np.full((n, LANES), LOW, np.uint64)
    spilled, spilled_by = [np.zeros(0, np.uint32)], [np.zeros((0,), np.int64)]
    marks = [[] for _ in range(n)]
    written = np.zeros(n, np.int64)
    shift = np.uint64(31) + WORD - table.bits
    tall = rows[order]
    for r in range(height - 1, -1, -1):
        k = int(np.searchsorted(-tall, -r, side="left"))  # blocks with more than r rows
        if (r + 1) % CHECKPOINT == 0:
            for j in range(int(np.searchsorted(-tall, -(r + 1), side="left"))):
                marks[j].append((int(written[j]), state[j].copy()))
        ids, on, x = grid[r, :k], live[r, :k], state[:k]
        f = np.where(on, table.freq[ids], np.uint64(1))
        spill = on & (x >= (f << shift))
        low = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        per = spill.sum(1)
        if per.any():
            spilled.append(low[:, ::-1][spill[:, ::-1]])  # read back in the opposite order
            spilled_by.append(np.repeat(np.arange(k), per))
            written[:k] += per
        x = np.where(spill, x >> WORD, x)
        q = x // f
        state[:k] = np.where(on, (q << table.bits) + (x - q * f) + table.start[ids], x)
    found: list = [None] * n
    by_block = np.argsort(np.concatenate(spilled_by), kind="stable")
    parts = np.split(np.concatenate(spilled)[by_block], np.cumsum(written)[:-1])
    for k, i in enumerate(order):
        words = parts[k][::-1]
        at = [len(words) - w for w, _ in marks[k][::-1]]
        states = np.concatenate([s for _, s in marks[k][::-1]]) if marks[k] else np.zeros(0, np.uint64)
        found[i] = (state[k].astype("<u8").tobytes(), words.astype("<u4").tobytes(), at, states.astype("<u8").tobytes())
    return found


def decode_blocks(table: Table, blocks: list[tuple]) -> list[np.ndarray]:
    """Ids of blocks given as ``(n, states, words, checkpoint_at, checkpoint_states)``; their parts decode together."""
    parts, sizes = [], []
    for i, (n, states, _, at, more) in enumerate(blocks):
        starts = np.concatenate([np.frombuffer(states, "<u8"), np.frombuffer(more, "<u8")]).reshape(-1, LANES)
        whole = CHECKPOINT * LANES
        for p, (state, begin) in enumerate(zip(starts, [0, *at], strict=True)):
            size = min(n - p * whole, whole) if p < len(starts) - 1 else n - p * whole
            if size > 0 or not p:
                parts.append((i, p, state, begin))
                sizes.append(size)
    sizes = np.array(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    base = np.concatenate([[0], np.cumsum([len(b[2]) // 4 for b in blocks])])
    words = np.concatenate([np.frombuffer(b[2], "<u4") for b in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    x = np.stack([parts[k][2] for k in order]).astype(np.uint64)
    at = np.array([base[parts[k][0]] + parts[k][3] for k in order], np.int64)
    height = -(-int(sizes.max(initial=0)) // LANES)
    grid = np.zeros((height, len(parts), LANES), np.uint32)
    mask, lane = np.uint64((1 << int(table.bits)) - 1), np.arange(LANES)
    for r in range(height):
        k = int(np.searchsorted(-sizes, -r * LANES, side="left"))
        on = lane + r * LANES < sizes[:k, None]
        y = x[:k]
        slot = y & mask
        ids = table.slot[np.where(on, slot, 0).astype(np.int64)]
        y = np.where(on, table.freq[ids] * (y >> table.bits) + slot - table.start[ids], y)
        need = on & (y < LOW)
        place = at[:k, None] + np.cumsum(need, axis=1) - 1
        y = np.where(need, (y << WORD) | words[np.where(need, place, 0)], y)
        at[:k] += need.sum(1)
        x[:k], grid[r, :k] = y, ids
    found: list = [[] for _ in blocks]
    for j in np.argsort(order):
        found[parts[order[j]][0]].append(grid[:, j].reshape(-1)[: sizes[j]])
    return [np.concatenate(f) for f in found]


def write_blocks(ids: DataFrame, table: Table, name: str = "rans", dtype: str = "<u4") -> DataFrame:
    """Blocks of all documents in ascending ``doc_id``, written in the shared folder; ``file`` numbers run with the order."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file, block, first = TaskContext.get().partitionId(), 0, 0
        open_docs, waiting = [], []

        def closed():
            nonlocal block, first
            coded = encode_blocks(table, [np.concatenate([v for _, v in w]) for w in waiting])
            rows = {c: [] for c in names}
            for docs, (states, words, at, more) in zip(waiting, coded, strict=True):
                sizes = [len(v) for _, v in docs]
                crc = 0
                for _, v in docs:
                    crc = zlib.crc32(v.tobytes(), crc)
                values = (file, block, first, sum(sizes), [d for d, _ in docs], sizes, crc, states, words, at, more)
                for c, v in zip(names, values, strict=True):
                    rows[c].append(v)
                block, first = block + 1, first + sum(sizes)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(names, types, strict=True)], names=names)

        names = [x.split()[0] for x in BLOCKS.split(",")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        types = [kinds[x.split()[1]] for x in BLOCKS.split(",")]
        held = inside = 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                open_docs.append((doc, np.frombuffer(value.as_buffer(), dtype).astype("<u4")))
                inside += len(open_docs[-1][1])
                if inside >= BLOCK_TOKENS:
                    waiting.append(open_docs)
                    open_docs, held, inside = [], held + inside, 0
                if held >= CODED_AT_ONCE:
                    yield closed()
                    held = 0
        if open_docs:
            waiting.append(open_docs)
        if waiting:
            yield closed()

    # Range partitions in order, each sorted: sampling the narrow staged keys is cheap, and rows that repeat an id spread too.
    order = [F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("row")]
    ordered = ids.select("doc_id", "ids", "key", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(run, BLOCKS), name)


def file_starts(blocks: DataFrame) -> DataFrame:
    """``file, before``: ids in all earlier files.  One narrow row per file goes through the ordered sum."""
    totals = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    return totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))


def read_blocks(blocks: DataFrame, table: Table) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` decoded from the blocks; a wrong checksum fails the job."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                take, size = [], 0
                while rows and (not take or size + rows[0]["n_tokens"] <= CODED_AT_ONCE):
                    take.append(rows.pop(0))
                    size += take[-1]["n_tokens"]
                found = decode_blocks(table, [(r["n_tokens"], r["states"], r["words"], r["checkpoint_at"], r["checkpoint_states"]) for r in take])
                out = ([], [], [], [])
                for r, ids in zip(take, found, strict=True):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != r["crc32"]:
                        raise ValueError(f"checksum of block {r['block']} of file {r['file']} does not match")
                    upto = np.cumsum(r["doc_tokens"])
                    out[0].extend(r["doc_ids"])
                    out[1].extend((r["before"] + r["first"] + upto - r["doc_tokens"]).tolist())
                    out[2].extend(r["doc_tokens"])
                    out[3].extend(v.astype("<u4").tobytes() for v in np.split(ids, upto[:-1]))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    starts = F.broadcast(file_starts(blocks))  # one narrow row for each range partition of the writing job
    return blocks.join(starts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, Table]:
    """Tokenize, count, code and write; returns the table of blocks and the frequency table to decode it with."""
    dtype = id_type(tokenizer, end_id)
    ids = staged(tokenize(docs, tokenizer, end_id, dtype=dtype), "ids")
    counts = id_counts(ids, dtype).collect()  # bounded by the vocabulary
    table = Table([r["id"] for r in counts], [r["n"] for r in counts])
    return write_blocks(ids, table, dtype=dtype), table
