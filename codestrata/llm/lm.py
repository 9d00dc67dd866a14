"""Stupid-backoff language-model scores of documents against the rest of the corpus.

Every text is scored with n-gram counts of the whole corpus less its own, so that no document explains itself.  A word
whose n-gram is known elsewhere scores count(n-gram) / count(context); otherwise the context loses its first word and the
score a factor of ``ALPHA``; a word that occurs nowhere else scores as if it had been seen ``UNSEEN`` times.  A document's
score is the sum of the logarithms over its words.

The count tables are partitioned by n-gram hash.  Documents are dealt into chunks; a chunk sends each of its distinct
n-grams once, with its count, to the bucket of the hash, as sorted packed arrays: a frequent n-gram costs one entry a
chunk however often it occurs.  A bucket sums its entries into the counts, joins them back to the chunks that asked, and
the chunk explodes its texts into n-grams again, looks its counts up and sums per document.

Null or empty texts, and texts of an empty table, have no words: score 0, mean null.  Rows that repeat an id or a text are
documents of their own.  N-grams are told apart by ``HASH_BITS`` bits of a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, documents, slices, staged
from .words import Words

ORDER = 3
ALPHA = 0.4
UNSEEN = 0.5
# N-grams are told apart by so many bits: with a billion of them in the corpus, one in a billion shares its number.
HASH_BITS = 60
# Text of a chunk: the larger, the fewer n-grams are sent twice; a task holds one chunk at a time.
CHUNK_BYTES = 12 << 20
# N-grams, each as often as it occurs, that a bucket takes on average.
BUCKET_GRAMS = 6_000_000


def orders_of(w: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and first words of the n-grams of each order from 1."""
    hashes = w.hashes()
    return [(h >> np.uint64(64 - HASH_BITS), at) for h, at in (w.grams(hashes, n) for n in range(1, order + 1))]


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, cut into byte planes of which the empty upper ones vanish under compression."""
    import zstandard

    gaps = np.diff(values, prepend=np.zeros(1, values.dtype))
    return zstandard.compress(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """64-bit counts as byte planes; the upper ones are empty but for huge counts and vanish under compression."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, n_words, doc_ids, sizes, data``: whole documents, about ``chunk_bytes`` of text in each row, compressed."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", chunk_bytes):
            chunk, text = (part << 32) + k, batch.column(1)
            k += 1
            words = Words(text)
            data = zstandard.compress(words.data.tobytes(), 6)
            ids, sizes = batch.column(0).cast(pa.string()).to_pylist(), pc.binary_length(text).to_pylist()
            columns = [pa.array([chunk]), pa.array([len(words)]), pa.array([ids], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n_words", "doc_ids", "sizes", "data"])

    rows = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "chunk long, n_words long, doc_ids array<string>, sizes array<long>, data binary")


def words_of(sizes, data: bytes) -> Words:
    """The words of texts that follow each other in ``data``."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    return Words(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)))


def requests(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """``chunk, bucket, grams, counts``: the distinct n-grams of each chunk, of all orders, by bucket."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                chunk, w = row["chunk"], words_of(row["sizes"], zstandard.decompress(row["data"]))
                keys, n = np.unique(np.concatenate([h for h, _ in orders_of(w, order)]), return_counts=True)
                cut = np.searchsorted(keys, bucket_starts(buckets))
                out = [(b, pack(k), pack_counts(c)) for b, (k, c) in enumerate(zip(np.split(keys, cut[1:]), np.split(n, cut[1:]), strict=True)) if len(k)]
                if out:
                    b, k, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(b), pa.int64()), pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["chunk", "bucket", "grams", "counts"])

    return chunks.select("chunk", "sizes", "data").mapInArrow(run, "chunk long, bucket int, grams binary, counts binary")


def bucket_starts(buckets: int) -> np.ndarray:
    """First hash of each bucket: equal ranges of the hashes."""
    return np.array([(b << HASH_BITS) // buckets for b in range(buckets)], np.uint64)


def counted(asked: DataFrame) -> DataFrame:
    """``chunk, bucket, counts``: for each n-gram a chunk asked for, in order, its count in the whole corpus."""

    def run(pdf):
        import pandas as pd

        grams = [unpack(g) for g in pdf["grams"]]
        counts = np.concatenate([unpack_counts(c) for c in pdf["counts"]])
        code, kinds = pd.factorize(np.concatenate(grams))
        total = np.bincount(code, counts, minlength=len(kinds))[code].astype(np.int64)
        ends = np.cumsum([len(g) for g in grams])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "totals": [pack_counts(t) for t in np.split(total, ends[:-1])]})

    return asked.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, totals binary")


def score_texts(first: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words_in_corpus: int, alpha: float, unseen: float) -> np.ndarray:
    """Sum of the logarithms of the stupid-backoff scores of each text.

    ``first``: first word of each text and the number of words; ``found``: by order the hashes of the n-grams, their first words
    and their counts in the corpus.
    """
    import pandas as pd

    n_texts, n_words = len(first) - 1, int(first[-1])
    sizes = np.diff(first)
    text = np.repeat(np.arange(n_texts), sizes)
    left = []  # by order: counts without the text's own, at each first word
    for grams, at, totals in found:
        code, _ = pd.factorize(grams ^ (text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        own = np.bincount(code)[code] if len(code) else code
        rest = np.zeros(n_words, np.int64)
        rest[at] = totals - own
        left.append(rest)
    out, open_ = np.zeros(n_words), np.ones(n_words, bool)
    place = np.arange(n_words) - first[:-1][text]
    for n in range(len(found), 0, -1):
        fits = open_ & (place >= n - 1)
        word = np.flatnonzero(fits)
        count = left[n - 1][word - n + 1]
        hit = word[count > 0]
        context = left[n - 2][hit - n + 1] if n > 1 else (words_in_corpus - sizes)[text[hit]]
        # Where a text can't offer more words, that alone is no backoff.
        steps = np.minimum(len(found) - 1, place[hit]) - (n - 1)
        out[hit] = np.log(count[count > 0]) - np.log(context) + steps * np.log(alpha)
        open_[hit] = False
    never = np.flatnonzero(open_)
    rest = np.maximum((words_in_corpus - sizes)[text[never]], 1)
    out[never] = np.log(unseen) - np.log(rest) + np.minimum(len(found) - 1, place[never]) * np.log(alpha)
    return np.bincount(text, out, minlength=n_texts)


def with_totals(found: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams with their counts; ``totals`` are those of the distinct n-grams of all orders, by ascending hash.

    Both sides are sorted, so the look-ups walk through memory in order, and one order's arrays are held at a time.
    """
    keys = np.concatenate([grams for grams, _ in found])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    out = []
    for grams, at in found:
        by = np.argsort(grams)
        counts = np.empty(len(grams), np.int64)
        counts[by] = totals[np.searchsorted(keys, grams[by])]
        out.append((grams, at.astype(np.int32), counts))
    return out


def buckets_for(words: int, order: int) -> int:
    """Buckets of about ``BUCKET_GRAMS`` n-grams, so that a bucket's size does not grow with the corpus."""
    return max(64, -(-words * order // BUCKET_GRAMS))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, unseen: float = UNSEEN, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of each document."""
    chunks = staged(chunked(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    answers = counted(requests(chunks, order, buckets or buckets_for(total, order)))

    def run(left, right):
        import pandas as pd
        import zstandard

        out = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "n_words": pd.Series(dtype="int64"), "log_score": pd.Series(dtype="float64")})
        if not len(left):
            return out
        sizes, data = np.asarray(left["sizes"].iloc[0], np.int64), zstandard.decompress(left["data"].iloc[0])
        w = words_of(sizes, data)
        first, ends = w.first, np.cumsum(sizes)
        found = orders_of(w, order)
        del w, data
        totals = [unpack_counts(t) for t in right.sort_values("bucket")["totals"]]
        found = with_totals(found, np.concatenate([np.zeros(0, np.int64), *totals]))
        del totals
        values, a = [], 0
        while a < len(sizes):  # a part of the chunk's texts at a time, to bound the arrays
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + SLICE_BYTES // 2, side="right")))
            part = []
            for grams, at, totals in found:
                lo, hi = np.searchsorted(at, [first[a], first[b]])
                part.append((grams[lo:hi], at[lo:hi] - first[a], totals[lo:hi]))
            values.append(score_texts(first[a : b + 1] - first[a], part, total, alpha, unseen))
            a = b
        ids = pd.array([None if x is None else int(x) for x in left["doc_ids"].iloc[0]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_words": np.diff(first), "log_score": np.concatenate(values)})

    scored = chunks.drop("n_words").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
