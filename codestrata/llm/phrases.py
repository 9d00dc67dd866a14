"""Phrase collocations by dynamic itemset counting: phrase lengths interleave in cyclic scans of the shards.

The rows are dealt over ``shards`` parts.  Step t scans part t mod ``shards``.  Single words count from step 0; a longer phrase
counts from the step after the one at whose end both its subphrases (all words but the last, all but the first) have reached
``threshold``, and for ``shards`` steps: one full cycle, so every count is exact.  A phrase that reaches the threshold has
subphrases that reach it too, so none is missed.

Which phrases have reached the threshold, and when, travels to the tasks as a table of fixed size (``SLOTS`` bytes a probe):
a slot holds the earliest step at which a phrase that falls into it got there.  A phrase found by chance counts from the
step that the table tells, for one full cycle as well: chance costs work, never a count.  Words are 64-bit hashes of language
and word; phrases are tuples of them.  Two words of one hash would be found when the texts of words are looked up, and the
work then starts anew with another salt.

A null text is empty and a null ``lang`` is ``und``; repeated rows count as often as they occur; an empty table or one whose
phrases stay below the threshold gives no rows; other columns than ``lang`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import hash_ranges, mix

SHARDS = 3
SLOTS = 1 << 23
NEVER = 255
SLICE_BYTES = 2 << 20
BITMAP_BITS = 32768  # of one result of bitmap_construct_agg

# Fixed values of the task: what ends a piece, and what parts words within one.
ENDS_PIECE = b".,;:!?\x0a\x0b\x0c\x0d"
PARTS_WORDS = b"\x20\x09"


class Pieces:
    """Lower-cased words of the texts of an Arrow large-string array; ``linked[i]``: words i and i + 1 follow each other in a piece."""

    def __init__(self, array):
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        raw = array.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        fold, kind = np.arange(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
        fold[65:91] += 32
        kind[list(PARTS_WORDS)] = 1
        kind[list(ENDS_PIECE)] = 2
        self.data, kinds = fold[data], kind[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        inside = kinds == 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        ended = np.cumsum(kinds == 2, dtype=np.int32)[self.start] if len(data) else np.zeros(0, np.int32)
        self.linked = np.zeros(len(self.start), dtype=bool)
        self.linked[:-1] = (ended[1:] == ended[:-1]) & (self.text[1:] == self.text[:-1])

    def hashes(self, langs: list[str], salt: int) -> np.ndarray:
        """64-bit hash of each word in its text's language."""
        salts = {x: hashlib.blake2b(f"{salt}:{x}".encode(), digest_size=8).digest() for x in set(langs)}
        per_text = np.array([np.frombuffer(salts[x], np.uint64)[0] for x in langs], dtype=np.uint64)
        return mix(hash_ranges(self.data, self.start, self.end) ^ per_text[self.text]) if len(self.start) else np.zeros(0, np.uint64)

    def strings(self, at: np.ndarray) -> pa.Array:
        """Texts of the words ``at``."""
        size = self.end[at] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[index])).cast(pa.string())


def joined(parts):
    """One 64-bit value of a tuple of word hashes (numpy arrays)."""
    x = parts[0]
    for part in parts[1:]:
        x = ((x << np.uint64(29)) | (x >> np.uint64(35))) ^ part
    return x


def joined_column(parts):
    """As ``joined``, for Spark columns of longs."""
    x = parts[0]
    for part in parts[1:]:
        x = F.shiftleft(x, 29).bitwiseOR(F.shiftrightunsigned(x, 35)).bitwiseXOR(part)
    return x


class Reached:
    """Earliest step at which phrases of one length reached the threshold, in two tables of fixed size."""

    def __init__(self, slots: int):
        self.slots, self.table = slots, np.full((2, slots), NEVER, dtype=np.uint8)

    def add(self, phrases: DataFrame, columns: list[str], step: int) -> bool:
        """Note the phrases, which reached the threshold at ``step``; whether there were any.

        The driver gets bitmaps: ``slots`` bits a probe at most, whatever the number of phrases.
        """
        x = joined_column([F.col(c) for c in columns])
        probes = F.array(
            *[F.struct(F.lit(i).alias("probe"), (at.bitwiseAND(F.lit(self.slots - 1)) + 1).alias("slot")) for i, at in enumerate((x, F.shiftrightunsigned(x, 32)))]
        )
        found = phrases.select(F.inline(probes)).groupBy("probe", F.bitmap_bucket_number("slot").alias("part"))
        rows = found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
        for row in rows:
            bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little").astype(bool)
            first = (row["part"] - 1) * BITMAP_BITS
            part = self.table[row["probe"], first : first + BITMAP_BITS]
            part[bits[: len(part)] & (part == NEVER)] = step
        return bool(rows)

    def packed(self) -> bytes:
        """For a broadcast: slots that hold nothing take next to no room."""
        return zlib.compress(self.table, 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(2, -1)


def steps_of(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Step at which each phrase reached the threshold by the tables, or ``NEVER``."""
    mask = np.uint64(table.shape[1] - 1)
    return np.maximum(table[0][x & mask], table[1][(x >> np.uint64(32)) & mask])


def runs(columns: list[np.ndarray]):
    """Distinct tuples of the columns: an index of each, and how often it occurs."""
    order = np.argsort(joined(columns))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:  # tuples of one joined value stay apart; one may then come out in several parts
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def counting(tables, step: int, shards: int, longest: int, salt: int):
    """Arrow function: phrases that count at ``step``, with the step they count from, per slice of texts."""

    def run(batches):
        reached = [unpacked(t) for t in tables.value]
        for batch in common.slices(batches, "text", SLICE_BYTES):
            pieces = Pieces(batch.column("text"))
            w = pieces.hashes(batch.column("lang").to_pylist(), salt)
            found = [([w], np.zeros(len(w), np.int64))] if step < shards else []
            x, open_ = w, np.ones(len(w), dtype=bool)
            for n in range(2, longest + 1):
                # Step from which the n-gram at each place counts: one after the later of its two subphrases.
                at = np.flatnonzero(open_)
                known = np.full(len(w) + 1, NEVER, dtype=np.int64)
                known[at] = steps_of(reached[n - 2], x[at])
                after = np.maximum(known[:-1], known[1:])
                open_ = (after != NEVER) & pieces.linked if n == 2 else after != NEVER
                x = ((x << np.uint64(29)) | (x >> np.uint64(35))) ^ np.concatenate([w[n - 1 :], np.zeros(min(n - 1, len(w)), np.uint64)])
                at = np.flatnonzero(open_ & (after + 1 <= step) & (step <= after + shards))
                found.append(([w[at + k] for k in range(n)], after[at] + 1))
            for words, since in found:
                if not len(since):
                    continue
                first, times = runs(words)
                columns = [pa.array(v[first].view(np.int64)) for v in words] + [pa.nulls(len(first), pa.int64())] * (longest - len(words))
                names = [f"w{k}" for k in range(1, longest + 1)] + ["since", "f"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(since[first]), pa.array(times.astype(np.int64))], names=names)

    return run


def naming(table, salt: int):
    """Arrow function: texts of the words in the table, and the number of all words by language, per slice of texts."""

    def run(batches):
        wanted = unpacked(table.value)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            pieces, langs = Pieces(batch.column("text")), batch.column("lang").to_pylist()
            w = pieces.hashes(langs, salt)
            of_text = np.bincount(pieces.text, minlength=len(langs))
            per_lang = {}
            for lang, n in zip(langs, of_text.tolist()):
                per_lang[lang] = per_lang.get(lang, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(per_lang), pa.int64()), pa.array(list(per_lang), pa.string()), pa.nulls(len(per_lang), pa.string()), pa.array(list(per_lang.values()), pa.int64())],
                names=["w", "lang", "word", "n"],
            )
            at = np.flatnonzero(steps_of(wanted, w) != NEVER)
            # Distinct by this hash and another one, so that two words of one hash both come out.
            other = hash_ranges(pieces.data ^ np.uint8(0x5A), pieces.start[at], pieces.end[at])
            at = at[np.unique(mix(w[at] + other), return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[at].view(np.int64)), pa.array([langs[i] for i in pieces.text[at]], pa.string()), pieces.strings(at), pa.nulls(len(at), pa.int64())],
                names=["w", "lang", "word", "n"],
            )

    return run


def count_phrases(texts: DataFrame, threshold: int, longest: int, shards: int, salt: int, slots: int) -> dict[int, DataFrame]:
    """Phrases of each length that occur ``threshold`` times or more: columns w1, w2, ..., f.

    ``texts``: lang, text and shard, as written.  Per step one scan of one shard; what is still counting goes on in a table
    written at each step, and a phrase that ends its cycle below the threshold leaves it.
    """
    spark = texts.sparkSession
    keys = [f"w{k}" for k in range(1, longest + 1)]
    schema = ", ".join(f"{k} long" for k in keys) + ", since long, f long"
    sketches = [Reached(slots) for _ in range(longest - 1)]
    last = [0] * longest  # of each length: the last step at which one of its phrases began to count
    state, whole, step = None, {n: [] for n in range(1, longest + 1)}, 0
    while step < max(last) + shards:
        tables = spark.sparkContext.broadcast([s.packed() for s in sketches])
        rows = texts.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(counting(tables, step, shards, longest, salt), schema)
        rows = rows.withColumn("reached", F.lit(None).cast("int"))
        if state is not None:
            rows = state.unionByName(rows)
        summed = rows.groupBy(*keys).agg(F.min("since").alias("since"), F.sum("f").alias("f"), F.min("reached").alias("reached"))
        summed = summed.withColumn("reached", F.coalesce("reached", F.when(F.col("f") >= threshold, F.lit(step))))
        ended = F.col("since") + shards - 1 <= step
        table = common.staged(summed.where(~ended | (F.col("f") >= threshold)).withColumn("ended", ended), f"phrases-{step}")
        for n in range(1, longest + 1):
            own = table.where(F.col(keys[n - 1]).isNotNull())
            own = own.where(F.col(keys[n]).isNull()) if n < longest else own
            whole[n].append(own.where("ended").select(*keys[:n], "f"))
            if n < longest and sketches[n - 1].add(own.where(F.col("reached") == step), keys[:n], step):
                last[n] = step + 1
        state = table.where("not ended").drop("ended")
        tables.destroy()
        step += 1
    out = {}
    for n, parts in whole.items():
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        out[n] = common.staged(rows, f"phrases-of-{n}")  # one small table, read in many places
    return out


def collocations(docs: DataFrame, top: int = 2000, threshold: int = 10, longest: int = 3, shards: int = SHARDS, slots: int = SLOTS, salt: int = 0) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by the score of their weakest cut.

    Returns lang, rank (from 1), phrase (space-joined), a (occurrences), l and r (occurrences of the parts of the cut of
    lowest score), n (words of the language) and score = floor(1000000 a a / (l r)), all numbers long.  A candidate occurs
    ``threshold`` times or more; one that half or more of whose occurrences (100 f >= 50 a) lie in one longer candidate is
    left out.  Order: score and a descending, then the phrase by its UTF-8 bytes.
    """
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    spark = docs.sparkSession
    path = f"{common.shared_folder(spark)}/llm/phrase-shards-{uuid.uuid4().hex}"
    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    counted = count_phrases(texts, threshold, longest, shards, salt, slots)
    words_of = {n: [f"w{k}" for k in range(1, n + 1)] for n in counted}

    # Words of candidates, by their hashes; the scan for their texts also counts all words.
    used = Reached(slots)
    for n in range(2, longest + 1):
        used.add(counted[n].select(F.explode(F.array(*words_of[n])).alias("w")), ["w"], 0)
    table = spark.sparkContext.broadcast(used.packed())
    named = texts.select("lang", "text").mapInArrow(naming(table, salt), "w long, lang string, word string, n long")
    named = common.staged(named.groupBy("w", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    names, totals = named.where("w is not null").select("w", "lang", "word"), named.where("w is null").select("lang", "n")
    if names.groupBy("w").count().where("count > 1").limit(1).count():
        return collocations(docs, top, threshold, longest, shards, slots, salt + 1)

    scored = None
    for n in range(2, longest + 1):
        cands = counted[n].withColumnRenamed("f", "a")
        for longer in range(n + 1, longest + 1):
            windows = F.array(*[F.struct(*[F.col(f"w{at + k}").alias(f"w{k}") for k in range(1, n + 1)]) for at in range(longer - n + 1)])
            most = counted[longer].select("f", F.inline(windows)).groupBy(*words_of[n]).agg(F.max("f").alias("within"))
            cands = cands.join(most, words_of[n], "left").where("within is null or 100 * within < 50 * a").drop("within")
        cuts = []
        for k in range(1, n):
            first = counted[k].withColumnRenamed("f", f"l{k}")
            rest = counted[n - k].select(*[F.col(f"w{i}").alias(f"w{k + i}") for i in range(1, n - k + 1)], F.col("f").alias(f"r{k}"))
            cands = cands.join(first, words_of[k]).join(rest, [f"w{i}" for i in range(k + 1, n + 1)])
            wide = [F.col(c).cast("decimal(19,0)") for c in ("a", f"l{k}", f"r{k}")]
            cands = cands.withColumn(f"big{k}", wide[0] * wide[0]).withColumn(f"under{k}", wide[1] * wide[2])
            score = F.expr(f"(cast(1000000 as decimal(7,0)) * big{k}) div under{k}").cast("long")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        lowest = F.array_min(F.array(*cuts))
        cands = cands.withColumn("cut", lowest)
        for k in range(1, n + 1):
            name = names.select(F.col("w").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"word{k}"))
            cands = cands.join(name, f"w{k}")
        part = cands.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(1, n + 1)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        scored = part if scored is None else scored.unionByName(part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = ranked.join(totals, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
