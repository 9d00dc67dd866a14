"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document's set holds its distinct runs of ``N`` words (one shorter run if it has fewer words).  Documents with equal
sets are copies: one of them, the smallest id, stands for all.  ``bands`` and ``rows`` are the cheapest choice that
finds a pair at the threshold with the target probability.  Band hashes deal the signatures into buckets; buckets with
the same members are one bucket.  Within a bucket all pairs of full sets are compared inside the task, as a product of
incidence matrices, and only each document's number of links and a spanning forest of the links leave the task: no list
of pairs exists anywhere.  A bucket beyond ``BLOCK`` members or ``BLOCK_GRAMS`` n-grams is dealt into blocks, and each pair of
blocks is a task of its own.  A pair that shares several buckets counts in the first one only.  Links join documents into classes; their class
id is the smallest id reachable over links.

Result: one row per document: ``doc_id, copy_id, class_id, n_links`` - links are other documents, copies included.  Null
and empty texts and texts without words have an empty set and link to nothing.  Rows that repeat an id are documents of
their own.  Null ids take no part and are returned unlinked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices, staged
from .words import Words, grams, mix

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 100
BLOCK = 1500
BLOCK_GRAMS = 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest chance meetings, with which a pair at the threshold is found.

    A pair of similarity ``s`` agrees in a band of ``r`` rows with probability ``s ** r``.
    """
    best = None
    for rows in range(1, 65):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no choice of bands within the hashes reaches the recall")
    return best


def gram_sets(w: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and where each text's begin."""
    hashes = w.hashes()
    found, at = grams(hashes, w.first, n)
    text = w.text_of()[at]
    sizes = np.diff(w.first)
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):  # the whole short text is its one n-gram
        run, _ = grams(hashes[w.first[i] : w.first[i + 1]], np.array([0, sizes[i]]), int(sizes[i]))
        found, text = np.append(found, mix(run + np.uint64(sizes[i]))), np.append(text, i)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(w.n_texts + 1))


def signatures(found: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes ``(texts, bands)`` of nonempty sets."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    for band in range(bands):
        key = np.full(len(first) - 1, band + 1, np.uint64)
        for row in range(rows):
            seed = mix(np.array([band * rows + row + 1], np.uint64))
            # The upper half of a product with an odd number orders the sets' members well enough for a minimum.
            low = np.minimum.reduceat((found ^ seed) * (seed | np.uint64(1)), first[:-1])
            key = mix(key ^ mix(low))
        out[:, band] = key
    return out


def set_id(found: np.ndarray) -> bytes:
    """128-bit id of a set of hashes."""
    a, b = mix(found + np.uint64(1)), mix(found ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, set_id, n_grams, keys, text_key`` of each document.

    128-bit id of its set, size, band hashes (none without words), 64-bit hash of the text.
    """

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            found, first = gram_sets(Words(batch.column(1)), n)
            sizes = np.diff(first)
            has = np.flatnonzero(sizes)
            keys = np.zeros((len(sizes), bands), np.uint64)
            if len(has):
                begin = np.append(first[:-1][has], first[-1])
                keys[has] = signatures(found, begin, bands, rows)
            ids = pa.array([set_id(found[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            values = [keys[i].view(np.int64).tolist() if s else [] for i, s in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64())), batch.column(2)],
                names=["doc_id", "set_id", "n_grams", "keys", "text_key"],
            )

    rows_of = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))
    return rows_of.mapInArrow(run, "doc_id long, set_id binary, n_grams long, keys array<long>, text_key long")


# Bits of the filter that tells which texts are asked for: 4 MB; more ids than bits only let more texts through.
FILTER_BITS = 1 << 25


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among those of ``wanted``: all that are and few others, without a shuffle of the rows.

    The filter has a fixed size whatever the number of keys, so it is broadcast at every size.
    """
    bit = _bit(key)
    bits = wanted.select(F.bitmap_bucket_number(bit).alias("_part"), F.bitmap_bit_position(bit).alias("_at")).repartition("_part")
    bits = bits.groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_part", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_part")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """``rep, weight, dealt, grams``: the n-gram set of each text whose set is the wanted one."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            found, first = gram_sets(Words(batch.column(4)), n)
            cut = list(zip(first[:-1], first[1:], strict=True))
            values = pa.array([found[a:b].tobytes() for a, b in cut], pa.binary())
            same = pa.array([set_id(found[a:b]) == want for (a, b), want in zip(cut, batch.column(3).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], values], names=["rep", "weight", "dealt", "grams"])
            yield out.filter(same)

    return docs.select("rep", "weight", "dealt", "set_id", "text").mapInArrow(run, "rep long, weight long, dealt array<struct<bucket:long,blocks:int>>, grams binary")


def _incidence(lists: list[np.ndarray]) -> np.ndarray:
    """0/1 matrix of rows by those members that occur in at least two rows."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    kinds, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n > 1
    column = np.cumsum(common) - 1
    keep = common[code]
    out = np.zeros((len(lists), int(common.sum())), np.float32)
    out[row[keep], column[code[keep]]] = 1
    return out


def _overlaps(lists: list[np.ndarray], rows: slice, columns: slice, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of two ranges of sets, a strip of members at a time."""
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    kinds, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = (n > 1)[code]
    column = (np.cumsum(n > 1) - 1)[code[keep]]
    row = row[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((rows.stop - rows.start, columns.stop - columns.start), np.float32)
    for low in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        strip = np.zeros((len(lists), min(width, int((n > 1).sum()) - low)), np.float32)
        strip[row[a:b], column[a:b] - low] = 1
        total += strip[rows] @ strip[columns].T
    return total


def links_in_bucket(bucket: int, left: list, right: list, threshold: float):
    """Links between the members of two blocks of a bucket (``right`` None: within one block).

    Members are ``(rep, weight, buckets, grams)``.  Gives ``rep, links, to``: link counts and, for a spanning forest, the
    smallest id of a member's connected part.
    """
    members = left + (right or [])
    cut = len(left)
    rows, columns = slice(0, cut), slice(cut, len(members)) if right else slice(0, cut)
    sets = [m[3] for m in members]
    sizes = np.array([len(s) for s in sets], np.float32)
    both = _overlaps(sets, rows, columns)
    # Whole numbers well below 2 ** 24 in float32; the comparison itself is exact in float64.
    linked = both.astype(np.float64) >= threshold * (sizes[rows, None] + sizes[None, columns] - both).astype(np.float64) - 1e-9
    earlier = [m[2][m[2] < bucket] for m in members]
    if any(len(e) for e in earlier):
        e = _incidence(earlier)
        linked &= (e[rows] @ e[columns].T) == 0  # counted in an earlier bucket that they share
    if not right:
        np.fill_diagonal(linked, False)
    weight = np.array([m[1] for m in members])
    count = np.zeros(len(members), np.int64)
    count[rows] += linked @ weight[columns]
    if right:
        count[columns] += linked.T @ weight[rows]
    rep = np.array([m[0] for m in members])
    part = rep.copy()  # smallest id within reach, by label passing over the matrix
    while True:
        before = part.copy()
        big = np.iinfo(np.int64).max
        to_rows = np.where(linked, part[columns][None, :], big).min(axis=1, initial=big)
        part[rows] = np.minimum(part[rows], to_rows)
        to_columns = np.where(linked, part[rows][:, None], big).min(axis=0, initial=big)
        part[columns] = np.minimum(part[columns], to_columns)
        if (part == before).all():
            break
    seen = count > 0
    return rep[seen], count[seen], part[seen]


def bucket_links(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, links, to`` over all buckets; ``members`` has ``bucket, left, right, side, rep, weight, buckets, grams``."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["rep", "side"])  # rows of the input that repeat id and text
        rows = [(r, w, np.sort(np.asarray(b, np.int64)), np.frombuffer(g, np.uint64)) for r, w, b, g in zip(pdf["rep"], pdf["weight"], pdf["buckets"], pdf["grams"], strict=True)]
        side = pdf["side"].to_numpy()
        left = [r for r, s in zip(rows, side, strict=True) if s == 0]
        right = [r for r, s in zip(rows, side, strict=True) if s == 1]
        two = pdf["left"].iloc[0] != pdf["right"].iloc[0]
        if not left or (two and not right):
            return pd.DataFrame({"rep": [], "links": [], "to": []}, dtype="int64")
        rep, links, to = links_in_bucket(int(pdf["bucket"].iloc[0]), left, right if two else None, threshold)
        return pd.DataFrame({"rep": rep, "links": links, "to": to})

    return members.groupBy("bucket", "left", "right").applyInPandas(run, "rep long, links long, to long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root``: smallest id reachable over undirected edges ``a, b``, for every id on an edge.

    Alternating star steps: each node hands the smallest id around it to its larger neighbours, then to all smaller ones,
    which keeps the number of edges and halves paths.  Every round is a table in the shared folder.
    """
    def tidy(e):
        return staged(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = tidy(edges)
    was = mark(edges)
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = tidy(new)
        now = mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def classes_of(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and ``set_id, copy_id, copy_key, class_id, class_set, n_links`` of each set.

    ``copy_id``/``copy_key``: smallest id with the set and the text's hash there; ``class_set``: the set that ``class_id`` is of,
    as several sets, of one class or of different ones, may have the same smallest id.
    """
    bands, rows = choose_bands(threshold, recall)
    rows_of = staged(sketches(docs, n, bands, rows), "sketches")
    known = rows_of.where("doc_id is not null and set_id is not null")
    first = F.min(F.struct("doc_id", "text_key"))
    reps = known.groupBy("set_id").agg(first.alias("copy"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"), F.min("n_grams").alias("n_grams"))
    # Rounded up to a power of two, which is enough to bound blocks and takes next to no room in a shuffle.
    reps = reps.withColumn("n_grams", F.pow(F.lit(2.0), F.ceil(F.log2("n_grams"))).cast("long"))
    reps = reps.select("set_id", F.col("copy.doc_id").alias("copy_id"), F.col("copy.text_key").alias("copy_key"), "weight", "n_grams", "keys")
    reps = staged(reps.withColumn("rep", F.xxhash64("set_id")), "reps")
    keyed = reps.select("rep", "n_grams", F.posexplode("keys").alias("band", "key"))
    # Buckets with two members at least; of those with the same members only the first.
    buckets = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep", F.lit(3))).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("x"), F.sum("n_grams").alias("grams"))
    buckets = buckets.withColumn("blocks", F.ceil(F.greatest(F.col("size") / block, F.col("grams") / BLOCK_GRAMS)).cast("int"))
    buckets = buckets.where("size > 1").groupBy("size", "s", "x").agg(F.min(F.struct("band", "key", "blocks")).alias("b"))
    buckets = buckets.select("b.band", "b.key", "b.blocks")
    bucket = F.xxhash64("band", "key")
    inside = keyed.join(buckets, ["band", "key"]).select("rep", bucket.alias("bucket"), "blocks")
    listed = inside.groupBy("rep").agg(F.collect_list(F.struct("bucket", "blocks")).alias("dealt"))  # at most one for each band
    listed = staged(listed.join(reps.select("rep", "set_id", "copy_id", "weight"), "rep"), "members")

    # The text of one document of each candidate set: only texts that may be asked for are shuffled, at every size alike.
    texts = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = likely(texts, "doc_id", listed.select(F.col("copy_id").alias("doc_id")))
    asked = listed.select(F.col("copy_id").alias("doc_id"), "rep", "set_id", "weight", "dealt")
    sets = full_sets(texts.join(asked.hint("merge"), "doc_id"), n)
    dealt = sets.select("rep", "weight", F.col("dealt.bucket").alias("buckets"), "grams", F.explode("dealt").alias("one"))
    n_blocks = F.col("one.blocks")
    dealt = dealt.withColumn("blocks", n_blocks).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(11)), n_blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        F.col("one.bucket").alias("bucket"), F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep", "weight", "buckets", "grams",
    )
    found = staged(bucket_links(dealt, threshold), "links")

    roots = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.select("set_id", "rep", "copy_id", "copy_key", "weight").join(linked, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    firsts = classes.where("root is not null").groupBy("root").agg(F.min(F.struct("copy_id", "set_id")).alias("own"))
    return rows_of, classes.join(firsts, "root", "left").select(
        "set_id", "copy_id", "copy_key", F.coalesce("own.copy_id", classes["copy_id"]).alias("class_id"), F.coalesce("own.set_id", classes["set_id"]).alias("class_set"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )


def representatives(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_key`` (xxhash64 of the text) of one document of each class, and of all documents without words.

    Other rows that repeat the id aren't named by it.  Null ids take no part.
    """
    rows_of, classes = classes_of(docs, n, threshold, recall, block)
    chosen = classes.where("set_id = class_set").select(F.col("copy_id").alias("doc_id"), F.col("copy_key").alias("text_key"))
    return chosen.union(rows_of.where("doc_id is not null and set_id is null").select("doc_id", "text_key").distinct())


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, copy_id, class_id, n_links`` of each document."""
    rows_of, classes = classes_of(docs, n, threshold, recall, block)
    known = rows_of.where("doc_id is not null and set_id is not null")
    # Rows without a set or an id keep their own id; the others find their set, whose copies may be very many.
    alone = rows_of.where("doc_id is null or set_id is null").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    spread = 32
    many = known.select("doc_id", "set_id", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("salt"))
    copies = classes.select("set_id", "copy_id", "class_id", "n_links").where("n_links > 0").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    told = many.join(copies, ["set_id", "salt"], "left")
    own = F.col("doc_id")
    return told.select("doc_id", F.coalesce("copy_id", own).alias("copy_id"), F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).union(alone)
