"""Packing token sequences by linear grouping: rounded large lengths, few-size configurations, best fit for the small.

Pieces are at most ``CAPACITY`` long; only longer documents are cut, from their end, so that the first piece may be
shorter.  The plan needs nothing but the number of pieces of each length - at most ``CAPACITY`` numbers, whatever the size
of the data - and is made of runs: so many pieces of one length, by rank, go to so many sequences with consecutive
numbers at one offset.

1. Large lengths (over ``CAPACITY / SMALL``) are sorted and cut into ``GROUPS`` groups of equal cardinality; each length is
   rounded up to the largest of its group.
2. Configurations of rounded sizes that fill a sequence are chosen by a linear program (column generation: a bounded
   knapsack prices new configurations), rounded down; what is left is packed by best fit with the small pieces.
3. Actual pieces, largest first, take the places of their group's rounded size; the last place of a configuration and
   the space that rounding left behind it go to the largest pieces left that fit.
4. Small pieces, and large ones that no whole configuration took, go largest first where they fit best; new sequences open
   only when nothing fits.

A piece's rank within its length is its place in its part of the staged table plus the counts of earlier parts.  Null text:
empty, so the end id alone.  Rows that repeat an id are documents of their own.  An empty table gives no pieces.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices, staged

CAPACITY = 2048
SMALL = 4
GROUPS = 80
PIECES = "doc_id long, piece int, start long, length long, part int, nth long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each whole text's ids (little-endian unsigned 32-bit), with their rank within part and length; staged."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            ids, counts = enc.encode(batch.column(1))
            ends = np.cumsum(counts)
            ids, sizes = np.insert(ids, ends, end_id).astype("<u4"), counts + 1
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lead = (sizes - (n - 1) * capacity)[doc]  # length of the document's first piece
            length = np.where(piece == 0, lead, capacity)
            start = np.where(piece == 0, 0, lead + (piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.searchsorted(ranked, ranked)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - first + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            offsets = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int64))
            value = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, offsets, pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(np.full(len(length), part), pa.int32()), pa.array(nth), value],
                names=["doc_id", "piece", "start", "length", "part", "nth", "ids"],
            )

    rows = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return staged(rows.mapInArrow(run, PIECES), "pieces")


class Plan:
    """Runs of pieces and the free space of the sequences opened so far, by equal ranges of sequences."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.rest = counts.astype(np.int64).copy()  # pieces by length that have no place yet
        self.next = np.zeros(capacity + 1, np.int64)  # rank of the first of them
        self.opened = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset
        self.free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges of sequences (first, number)
        self.spaces: list[int] = []  # its keys, sorted

    def open(self, number: int) -> int:
        self.opened += number
        return self.opened - number

    def give(self, space: int, first: int, number: int) -> None:
        if space > 0 and number > 0:
            if space not in self.free:
                self.free[space] = []
                bisect.insort(self.spaces, space)
            self.free[space].append((first, number))

    def take(self, space: int) -> tuple[int, int]:
        found = self.free[space].pop()
        if not self.free[space]:
            del self.free[space]
            self.spaces.remove(space)
        return found

    def place(self, length: int, number: int, first: int, space: int) -> None:
        """The next ``number`` pieces of ``length`` into sequences from ``first`` on, each with ``space`` free."""
        self.runs.append((length, int(self.next[length]), number, first, self.capacity - space))
        self.next[length] += number
        self.rest[length] -= number

    def best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.rest[length]:
                at = bisect.bisect_left(self.spaces, length)
                if at < len(self.spaces):
                    space = self.spaces[at]
                    first, number = self.take(space)
                    used = min(number, int(self.rest[length]))
                    if used < number:
                        self.give(space, first + used, number - used)
                    self.place(length, used, first, space)
                    self.give(space - length, first, used)
                else:  # nothing fits: full new sequences of this length, and one for what is left of it
                    per = self.capacity // length
                    number, extra = divmod(int(self.rest[length]), per)
                    for size, many in ((per, number), (extra, 1 if extra else 0)):
                        first = self.open(many) if many else 0
                        space = self.capacity
                        for _ in range(size if many else 0):
                            self.place(length, many, first, space)
                            space -= length
                        self.give(space, first, many)


def grouped(counts: np.ndarray, small: int, groups: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rounded sizes, largest first, their numbers of pieces, and the group of each length (-1: small)."""
    capacity = len(counts) - 1
    total = int(counts[small + 1 :].sum())
    sizes, numbers, of = [], [], np.full(capacity + 1, -1)
    per, taken = max(1, -(-total // groups)), 0
    for length in range(capacity, small, -1):
        if counts[length]:
            if not sizes or taken >= per * len(sizes):
                sizes.append(length)
                numbers.append(0)
            of[length] = len(sizes) - 1
            numbers[-1] += int(counts[length])
            taken += int(counts[length])
    return sizes, np.array(numbers, np.int64), of


def best_configuration(sizes: list[int], values: np.ndarray, numbers: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The fill of one sequence with the largest value: a bounded knapsack over the rounded sizes."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, size in enumerate(sizes):
        base, most = best.copy(), int(min(capacity // size, numbers[i]))
        for k in range(1, most + 1):
            with_k = np.full(capacity + 1, -1.0)
            with_k[k * size :] = base[: capacity + 1 - k * size] + k * values[i]
            better = with_k > best + 1e-12
            best = np.where(better, with_k, best)
            took[i] = np.where(better, k, took[i])
    room, config = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        config[i] = took[i, room]
        room -= int(config[i]) * sizes[i]
    return float(best[capacity]), config


def configurations(sizes: list[int], numbers: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in an optimal fractional packing of the rounded sizes."""
    k = len(sizes)
    base = [np.eye(k, dtype=np.int64)[i] * min(capacity // sizes[i], int(numbers[i])) for i in range(k)]
    matrix = np.array(base, np.float64).T
    use = np.linalg.solve(matrix, numbers.astype(np.float64))
    for _ in range(rounds):
        price = np.linalg.solve(matrix.T, np.ones(k))
        value, config = best_configuration(sizes, np.maximum(price, 0), numbers, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(matrix, config.astype(np.float64))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        use = np.maximum(use - move * step, 0)
        use[out] = move
        matrix[:, out] = config
        base[out] = config
    return [(c, float(u)) for c, u in zip(base, use, strict=True)]


def substituted(plan: Plan, config: np.ndarray, members: list[list[int]], number: int) -> None:
    """Open ``number`` sequences of one configuration and put actual pieces, largest first, where it has rounded sizes.

    Rounding leaves space in each sequence.  The configuration's smallest place, and what is still free behind it, therefore goes
    to the largest pieces left that fit, which are no shorter than its group's.
    """
    first = plan.open(number)
    ranges = [(first, number, plan.capacity)]  # sequences with equal free space
    wanted = [g for g in np.flatnonzero(config) for _ in range(int(config[g]))]
    for g in wanted[:-1]:
        after = []
        for at, many, space in ranges:
            while many:
                length = next(x for x in members[g] if plan.rest[x])
                used = min(many, int(plan.rest[length]))
                plan.place(length, used, at, space)
                after.append((at, used, space - length))
                at, many = at + used, many - used
        ranges = after
    while ranges:
        at, many, space = ranges.pop()
        fits = np.flatnonzero(plan.rest[: space + 1])
        if not len(fits):
            plan.give(space, at, many)
            continue
        length = int(fits[-1])
        used = min(many, int(plan.rest[length]))
        plan.place(length, used, at, space)
        ranges += [(at + used, many - used, space)] * (used < many) + [(at, used, space - length)] * (space > length)


def plan_of(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> Plan:
    """The runs that place all pieces; ``counts`` has the number of pieces of each length."""
    plan = Plan(counts, capacity)
    sizes, numbers, of = grouped(counts, capacity // small, groups)
    if sizes:
        members = [[int(x) for x in np.flatnonzero(of == g)[::-1]] for g in range(len(sizes))]
        for config, use in configurations(sizes, numbers, capacity):
            left = [int(plan.rest[m].sum()) for m in members]
            number = min([int(use + 1e-6), *(left[g] // int(c) for g, c in enumerate(config) if c)])
            if number:
                substituted(plan, config, members, number)
    plan.best_fit()
    return plan


def placements(found: DataFrame, plan: Plan) -> DataFrame:
    """``found`` (pieces without ids) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    runs = sorted(plan.runs)
    lengths = np.array([r[0] for r in runs], np.int64)
    table = np.array([r[1:] for r in runs], np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((lengths, table))  # bounded by the capacity, not by the data

    def run(batches):
        import pyarrow as pa

        lengths, table = shared.value
        scale = int(table[:, :2].sum(axis=1).max(initial=0)) + 1
        keys = lengths * scale + table[:, 0] if int(lengths.max(initial=0)) * scale < 1 << 62 else None
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            if keys is not None:
                at = np.searchsorted(keys, length * scale + rank, side="right") - 1
            else:
                at = np.array([bisect.bisect_right(runs, (int(a), int(b), 1 << 62)) - 1 for a, b in zip(length, rank, strict=True)])
            sequence = table[at, 2] + rank - table[at, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(table[at, 3])], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each piece among all of its length."""
    per = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    per = per.select("length", "part", before.alias("before"))  # one row for each part of the table, not for each piece
    return found.join(per, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before")


def pack(cut: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, piece, start, length, sequence_id, offset`` and the ``keep`` columns of staged pieces."""
    base = ["doc_id", "piece", "start", "length", "part", "nth"]
    narrow = cut.select(*base, *[c for c in keep if c not in base])
    counts = np.zeros(capacity + 1, np.int64)
    for row in narrow.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    placed = placements(ranked(narrow), plan_of(counts, capacity))
    return placed.select("doc_id", "piece", "start", "length", *keep, "sequence_id", "offset")


def sequences(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, lengths``: the packed sequences themselves, at most ``capacity`` ids each."""
    told = pack(cut, capacity, ("part", "nth"))
    whole = told.join(cut.select("length", "part", "nth", "ids"), ["length", "part", "nth"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = whole.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("in"))
    joined = F.aggregate(F.transform("in.ids", lambda x: F.hex(x)), F.lit(""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", "n_tokens", F.unhex(joined).alias("ids"), F.col("in.doc_id").alias("doc_ids"), F.col("in.length").alias("lengths"))
