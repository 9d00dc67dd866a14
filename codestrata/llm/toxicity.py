"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Tokens are words.  The labels mark documents only, so token labels for training come from them: a word form counts as toxic
if, in labelled documents, it is ``MIN_RATIO`` times likelier in toxic documents than in the others, in at least ``MIN_DOCUMENTS`` of them, by a
likelihood-ratio test over its different contexts (the words around it) whose bound grows with the number of forms tested;
such words within toxic documents are the labelled tokens.  The
random field has two states, hashed features of the word, its prefix, suffix and neighbours, and weights for transitions
and the start of a text.  Marginals come from the forward-backward recursions over whole texts.  A document's score is a
logistic function of its largest marginal and its expected number of toxic tokens, fitted on the document labels.

Training rows: at most ``SAMPLE_ROWS`` labelled rows with the smallest hash of their id, never rows whose
crc32(doc_id) mod 5 is 0 (they are held out), and no column but the text is a feature.  Null or empty texts have no tokens
and get the score of a document without toxic tokens.  Without labelled rows of both kinds no token is toxic and the
score is 0.  Rows are scored one by one, so repeated ids and texts give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import documents, slices
from .quality import labelled_sample, sampled_texts
from .words import Words, hash_ranges, mix

DIMS = 1 << 18
SAMPLE_ROWS = 3000
MIN_DOCUMENTS = 2
MIN_RATIO = 10.0
SPAN_AT = 0.5
STEPS = 30
FOLDS = 5
# Punctuation at the ends of a word that is not part of its form.
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
GROUPS = 5
# Bytes of the prefix and suffix features.
HEAD, TAIL = 5, 3


def forms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words without punctuation at their ends (the whole word if nothing else is in it)."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(8):
        if not len(start):
            break
        start += _EDGE[w.data[start]] & (end - start > 1)
        end -= _EDGE[w.data[end - 1]] & (end - start > 1)
    return start, end


def token_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed dimensions ``(tokens, GROUPS)`` and the hashes of each token's form and of its first bytes."""
    data = np.where((w.data >= 65) & (w.data <= 90), w.data + 32, w.data).astype(np.uint8)
    start, end = forms(w)
    form = hash_ranges(data, start, end)
    head = hash_ranges(data, start, np.minimum(start + HEAD, end))
    tail = hash_ranges(data, np.maximum(end - TAIL, start), end)
    before, after = np.zeros_like(form), np.zeros_like(form)
    before[1:], after[:-1] = form[:-1], form[1:]
    has = w.first[:-1] < w.first[1:]
    before[w.first[:-1][has]] = 1  # start and end of the text
    after[w.first[1:][has] - 1] = 2
    out = np.stack([mix(x + np.uint64(i + 1)) % np.uint64(DIMS) for i, x in enumerate((form, head, tail, before, after))], axis=1)
    return out.astype(np.int64), form, head


def _steps(a: np.ndarray, chunk: int) -> np.ndarray:
    """Forward vectors after each matrix of the row-vector product ``v @ a[0] @ a[1] ...``, scaled to sum 1.

    Done over chunks: their products first, then the vectors at their starts, then all positions; each pass advances all
    chunks together.
    """
    n = len(a)
    k = -(-n // chunk)
    if k * chunk > n:
        a = np.concatenate([a, np.broadcast_to(np.eye(2), (k * chunk - n, 2, 2))])
    # One contiguous row of chunks for each step and matrix element.
    a = np.ascontiguousarray(a.reshape(k, chunk, 4).transpose(1, 2, 0))
    p, q, r, s = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for i in range(chunk):
        w, x, y, z = a[i]
        p, q, r, s = p * w + q * y, p * x + q * z, r * w + s * y, r * x + s * z
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    starts = np.empty(k)
    v = 0.5  # share of the second state
    for j, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        starts[j] = v
        first, second = (1 - v) * w + v * y, (1 - v) * x + v * z
        v = second / (first + second)
    out = np.empty((chunk, k))
    v = starts
    for i in range(chunk):
        w, x, y, z = a[i]
        u = 1 - v
        first, second = u * w + v * y, u * x + v * z
        v = second / (first + second)
        out[i] = v
    second = np.clip(out.T.reshape(-1)[:n], 1e-15, 1 - 1e-15)
    return np.stack([1 - second, second], axis=1)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, opening: np.ndarray):
    """State marginals ``(tokens, 2)`` and pair marginals ``(tokens, 2, 2)`` of texts whose tokens begin at ``first``.

    ``emission``: score of the toxic state less that of the other; the pair of a text's first token is empty.
    """
    n = len(emission)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2, 2))
    e = np.clip(emission, -30, 30)
    emit = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], axis=1)
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    move = np.exp(transition - transition.max())
    enter = np.exp(opening - opening.max())
    a = move[None] * emit[:, None, :]
    a[opens] = enter[None, None, :] * emit[opens][:, None, :]  # whatever came before has no say
    chunk = max(1, int(n**0.5))
    forward = _steps(a, chunk)
    # Backward: the same recursion over the transposed matrices in reverse order.
    b = np.empty_like(a)
    b[0] = np.eye(2)
    b[1:] = np.swapaxes(a[:0:-1], 1, 2)
    backward = _steps(b, chunk)[::-1]
    both = forward * backward
    state = both / both.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    if n > 1:
        pair[1:] = forward[:-1, :, None] * a[1:] * backward[1:, None, :]
        pair[1:] /= pair[1:].sum(axis=(1, 2), keepdims=True)
    pair[opens] = 0
    return state, pair


def fit_chain(dims: np.ndarray, tags: np.ndarray, first: np.ndarray, steps: int = STEPS, rate: float = 0.25, l2: float = 1e-5):
    """Weights of the random field that make the tags likely: gradient = observed less expected counts."""
    used, flat = np.unique(dims, return_inverse=True)
    flat = flat.reshape(dims.shape)
    opens = first[:-1][first[:-1] < first[1:]]
    inner = np.ones(len(tags), bool)
    inner[opens] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (tags[at - 1], tags[at]), 1)
    began = np.bincount(tags[opens], minlength=2)
    rare = max(1.0, (tags == 0).sum() / max(1, (tags == 1).sum()))
    theta = np.concatenate([np.zeros(len(used)), np.zeros(6), [-np.log(rare)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(used)
    scale = max(1, int((tags == 1).sum()))
    for t in range(1, steps + 1):
        emission = theta[:k][flat].sum(axis=1) + theta[-1]
        state, pair = marginals(emission, first, theta[k : k + 4].reshape(2, 2), theta[k + 4 : k + 6])
        gap = (tags == 1) - state[:, 1]
        grad = np.concatenate([
            sum(np.bincount(flat[:, g], gap, minlength=k) for g in range(dims.shape[1])),
            (seen - pair.sum(axis=0)).ravel(), began - state[opens].sum(axis=0), [gap.sum()],
        ])
        grad = -grad / scale + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(DIMS, np.float32)
    weights[used] = theta[:k]
    return weights, theta[k:]


def chain_marginals(dims: np.ndarray, first: np.ndarray, weights: np.ndarray, rest: np.ndarray) -> np.ndarray:
    emission = weights[dims].sum(axis=1) + rest[-1]
    return marginals(emission, first, rest[:4].reshape(2, 2), rest[4:6])[0][:, 1]


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal, and the logarithm of 1 plus the expected number of toxic tokens."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    top = np.zeros(n)
    np.maximum.at(top, text, p)
    return np.stack([top, np.log1p(np.bincount(text, p, minlength=n))], axis=1)


def toxic_forms(form: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Form hashes that mark toxic documents, by the contexts they stand in.

    The evidence of a form is the log-likelihood ratio of its contexts, twice over; of as many forms without any bearing on
    toxicity as there are, the most extreme one would reach about twice the logarithm of their number.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before, after = np.roll(form, 1), np.roll(form, -1)
    context = mix(mix(form ^ mix(before)) + after)
    _, one = np.unique(mix(context) ^ toxic[text].astype(np.uint64), return_index=True)
    kinds, code = np.unique(form[one], return_inverse=True)
    if not len(kinds):
        return kinds
    bad = np.bincount(code, toxic[text[one]], minlength=len(kinds))
    good = np.bincount(code, 1 - toxic[text[one]], minlength=len(kinds))
    places = np.unique(code.astype(np.int64) * len(first) + text[one])
    documents_with = np.bincount(places // len(first), toxic[places % len(first)], minlength=len(kinds))
    share = np.clip(toxic[text[one]].mean(), 1e-9, 1 - 1e-9)
    n = bad + good
    ratio = (bad / share) / ((good + 0.5) / (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(bad > 0, bad * np.log(bad / (n * share)), 0) + np.where(good > 0, good * np.log(good / (n * (1 - share))), 0))
    return kinds[(documents_with >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO) & (evidence >= 2 * np.log(len(kinds)))]


def held_out(doc_id) -> F.Column:
    """Rows kept out of the training: crc32 of the id as text, mod 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The random field and the document model, fitted in one task on the bounded sample; None if there is nothing to learn."""
    sample = labelled_sample(labels.where(~held_out(labels["doc_id"])), "toxic", sample_rows)
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    texts = sampled_texts(docs, sample)

    def tokens(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            w = Words(batch.column(2))
            dims, form, head = token_features(w)
            cut = [(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (dims.astype("<i4"), form, head))],
                names=["doc_id", "label", "dims", "forms", "heads"],
            )

    def train(pdf):
        import pandas as pd

        none = pd.DataFrame({"weights": [], "told": []}, dtype=object)
        pdf = pdf.sort_values(["doc_id", "forms"], kind="stable").drop_duplicates("forms")
        y = pdf["label"].to_numpy()
        if np.bincount(y, minlength=2).min() == 0:
            return none
        form = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["forms"]])
        dims = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, GROUPS) for x in pdf["dims"]])
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in pdf["forms"]])])
        head = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["heads"]])
        marked = np.isin(form, toxic_forms(form, first, y)) | np.isin(head, toxic_forms(head, first, y))
        tags = (marked & (np.repeat(y, np.diff(first)) == 1)).astype(np.int64)
        if not tags.any():
            return none
        weights, rest = fit_chain(dims, tags, first)
        theta = logistic.fit_dense(summary(chain_marginals(dims, first, weights, rest), first), y)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "told": [[*rest, *theta]]})

    rows = texts.select("doc_id", "label", "text").mapInArrow(tokens, "doc_id long, label int, dims binary, forms binary, heads binary")
    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "weights binary, told array<double>").collect()
    if not found:
        return None
    told = np.array(found[0]["told"])
    return {"weights": np.frombuffer(found[0]["weights"], "<f4"), "rest": told[:7], "document": told[7:]}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``; ``spans`` lists start:end of runs of toxic words, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = documents(docs, "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in slices(batches, "text"):
            w = Words(batch.column(1))
            if known is None:
                value, spans = np.zeros(w.n_texts), [""] * w.n_texts
            else:
                dims, _, _ = token_features(w)
                p = chain_marginals(dims, w.first, known["weights"], known["rest"])
                s, theta = summary(p, w.first), known["document"]
                value = logistic.sigmoid(s @ theta[:-1] + theta[-1])
                spans = span_lists(w, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, spans string")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "spans")


def span_lists(w: Words, p: np.ndarray) -> list[str]:
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    out: list[list[list[int]]] = [[] for _ in range(w.n_texts)]
    text = w.text_of()
    last = -2
    for i in np.flatnonzero(p >= SPAN_AT):
        t = text[i]
        base = lead[w.offsets[t]]
        if i == last + 1 and out[t]:
            out[t][-1][1] = int(lead[w.end[i]] - base)
        else:
            out[t].append([int(lead[w.start[i]] - base), int(lead[w.end[i]] - base)])
        last = i
    return [",".join(f"{a}:{b}" for a, b in spans) for spans in out]
