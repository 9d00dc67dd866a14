"""Quality rules: a fixed base rule and a calibrated classifier on hashed word and character n-grams.

Base figures count over the whole text; ``base_failed`` is their rule.  The classifier is a logistic regression on three
groups of hashed features - words, word pairs, runs of four characters - each a share of its group's occurrences in the text.
It is fitted on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of their id), two thirds for the
weights and one third to calibrate its scores into probabilities; equal texts lie on one side.  A document is kept if the base rule holds and its
probability of good quality reaches ``KEEP_AT``.

Null or empty text: no words, so the base rule fails.  Without labelled rows of both kinds there is no model and the base
rule decides alone.  Each row is scored for itself: repeated ids and texts give repeated results.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import logistic
from .common import documents, slices
from .words import Words, hash_ranges, mix

DIMS = 1 << 18
SAMPLE_ROWS = 3000
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# Text that one step works on: a feature of each character takes some fifty bytes for a moment.
STEP_BYTES = 1 << 20
# Scales the shares so that single features weigh in steps of about one.
GAIN = 20.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    import pandas as pd

    code, _ = pd.factorize(key)
    return np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)


def base_counts(w: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The five base figures of each text."""
    n, text = w.n_texts, w.text_of()
    symbol = np.concatenate([[0], np.cumsum(np.isin(w.data, np.frombuffer(SYMBOLS.encode(), np.uint8)))])

    grams, at = w.grams(hashes, 3)
    twice = at[repeated(grams ^ mix(text[at].astype(np.uint64)))]
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[twice + k] = True

    breaks = np.flatnonzero(w.data == 10)
    line_start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([breaks, w.offsets[1:]]), kind="stable")
    has = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[has], line_end[has]
    of = np.searchsorted(w.offsets, line_start, side="right") - 1
    import pandas as pd

    key = hash_ranges(w.data, line_start, line_end) ^ mix(of.astype(np.uint64))
    again = pd.Series(key).duplicated().to_numpy()
    return {
        "n_words": np.diff(w.first),
        "word_chars": np.bincount(text, w.chars(), minlength=n).astype(np.int64),
        "n_symbols": np.diff(symbol[w.offsets]),
        "n_dup_lines": np.bincount(of[again], minlength=n),
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


def features(w: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of features: the text and the hashed dimension of every occurrence."""
    text = w.text_of()
    pairs, at = w.grams(hashes, 2)
    groups = [(text, hashes), (text[at], mix(pairs))]
    # Code points of the texts, whole characters whatever their number of bytes.
    chars = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = (w.data & 0xC0) != 0x80
    of = np.repeat(np.arange(w.n_texts), np.diff(np.concatenate([[0], np.cumsum(lead)])[w.offsets]))
    if len(chars) >= 4 and len(of) == len(chars):
        c = chars.astype(np.uint64)
        same = of[:-3] == of[3:]
        runs = (c[:-3] | (c[1:-2] << np.uint64(21)) | (c[2:-1] << np.uint64(42)))[same]
        runs = (runs * np.uint64(0x9E3779B97F4A7C15)) ^ (c[3:][same] * np.uint64(0xD6E8FEB86659FD93))
        groups.append((of[:-3][same], runs >> np.uint64(46)))
    return [(t, (h % np.uint64(DIMS)).astype(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)) for t, h in groups]


def linear_scores(w: Words, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the groups of the mean weight of a text's features."""
    total = np.zeros(w.n_texts)
    for text, dim in features(w, hashes):
        n = np.bincount(text, minlength=w.n_texts)
        total += GAIN * np.bincount(text, weights[dim], minlength=w.n_texts) / np.maximum(n, 1)
    return total


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, label`` of at most ``rows`` labelled rows, chosen by a hash of their ids."""
    known = documents(labels, "doc_id", label).toDF("doc_id", "label").where("label in (0, 1) and doc_id is not null")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of the sampled ids, one row an id: of rows that repeat it the one of smallest text hash."""
    texts = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.join(F.broadcast(sample), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "label")
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "label", "text")


def sparse_rows(sample: DataFrame) -> DataFrame:
    """``doc_id, label, dims, shares`` of the sampled texts, made where the texts are."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", STEP_BYTES):
            w = Words(batch.column(2))
            groups = features(w, w.hashes())
            out: list[list] = [[], []]
            sizes = [np.bincount(t, minlength=w.n_texts) for t, _ in groups]
            ends = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
            for i in range(w.n_texts):
                dims, shares = [], []
                for (_, dim), end in zip(groups, ends, strict=True):
                    used, n = np.unique(dim[end[i] : end[i + 1]], return_counts=True)
                    dims.append(used)
                    shares.append(GAIN * n / max(n.sum(), 1))
                out[0].append(np.concatenate(dims).astype("<i4").tobytes())
                out[1].append(np.concatenate(shares).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0]), pa.array(out[1])], names=["doc_id", "label", "dims", "shares"])

    return sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, dims binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Weights and calibration, fitted in one task on the bounded sample; None without labelled rows of both kinds."""
    sample = labelled_sample(labels, "quality", sample_rows)  # at most ``sample_rows`` narrow rows: safe to broadcast
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    texts = sampled_texts(docs, sample)

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "dims"], kind="stable")
        y = pdf["label"].to_numpy()
        fold = np.array([zlib.crc32(x) % 3 == 2 for x in pdf["dims"]])
        if min(np.bincount(y[~fold], minlength=2).min(), np.bincount(y[fold], minlength=2).min()) == 0:
            return pd.DataFrame({"weights": [], "told": []}, dtype=object)
        dims = [np.frombuffer(x, "<i4") for x in pdf["dims"]]
        shares = [np.frombuffer(x, "<f4") for x in pdf["shares"]]
        inside = np.flatnonzero(~fold)
        row = np.repeat(np.arange(len(inside)), [len(dims[i]) for i in inside])
        w, bias = logistic.fit_sparse(row, np.concatenate([dims[i] for i in inside]), np.concatenate([shares[i] for i in inside]), y[inside], 2, DIMS)
        w, bias = (w[:, 1] - w[:, 0]).astype(np.float32), float(bias[1] - bias[0])
        scores = np.array([w[dims[i]] @ shares[i] + bias for i in np.flatnonzero(fold)], np.float64)
        a, b = logistic.platt(scores, y[fold])
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "told": [[bias, a, b]]})

    found = sparse_rows(texts).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "weights binary, told array<double>").collect()
    if not found:
        return None
    return {"weights": np.frombuffer(found[0]["weights"], "<f4"), "told": tuple(found[0]["told"])}


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns, the base figures, ``base_failed``, ``probability`` of good quality (null without a model), ``kept``.

    ``with_text`` adds the text, empty for null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = documents(docs, *keep, "text").toDF(*[f"k{i}" for i in range(len(keep))], "text")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]])
    names = rows.columns[:-1]

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in slices(batches, "text", STEP_BYTES):
            w = Words(batch.column(len(keep)))
            hashes = w.hashes()
            counts = base_counts(w, hashes)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            good, p = ~failed, pa.nulls(w.n_texts, pa.float64())
            if known:
                bias, a, b = known["told"]
                value = logistic.sigmoid(a * (linear_scores(w, hashes, known["weights"]) + bias) + b)
                good, p = good & (value >= KEEP_AT), pa.array(value)
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(counts[c], pa.int64()) for c in BASE]
            arrays += [pa.array(failed), p, pa.array(good)] + [batch.column(len(keep)).cast(pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *BASE, "base_failed", "probability", "kept", *["text"] * with_text])

    out = ", ".join([schema, *(f"{c} long" for c in BASE), "base_failed boolean, probability double, kept boolean", *["text string"] * with_text])
    found = rows.mapInArrow(run, out)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *found.columns[len(keep) :])
