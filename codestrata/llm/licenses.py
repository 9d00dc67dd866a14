"""Licence families of paragraphs: sparse word n-gram logistic regression, an unknown class, and template confirmation.

A paragraph is a run of adjoining lines with a word; signs alone (comment marks, rules) are no words.  The classifier is a
softmax regression on hashed runs of one to three words (letters folded, punctuation at word ends dropped).  Its training
set: crops of the template sentences below, and as the unknown class at most ``UNKNOWN_ROWS`` lines of at most
``SAMPLE_DOCS`` documents of the corpus (smallest hash of their id) outside every passage that holds half a template.  A
third of it calibrates the scores by one temperature.

Both steps look across line breaks.  A paragraph is predicted if a window of it - a line, adjoining lines up to the length
of the longest sentence, or a passage with template runs - is other than unknown with probability ``REPORT_AT``.  A family
is confirmed where ``CONFIRM`` of the three-word runs of one of its sentences stand in a passage of at most ``REACH`` times
the sentence's words, or in one line, and the classifier gives that passage or line the family.  Of confirmed
families that claim the same passage (one covers most of the other) the one whose sentence is held more fully stays; all
others are reported.

Result: one row per document.  Null or empty texts have no paragraphs and no families; repeated ids and texts give
repeated rows; an empty table gives an empty result, as does a corpus without lines for the unknown class (the templates
then stand alone against an empty line).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import documents, slices
from .toxicity import _EDGE, forms
from .words import Words, grams, hash_ranges, mix

DIMS = 1 << 16
SAMPLE_DOCS = 400
UNKNOWN_ROWS = 4000
REPORT_AT = 0.5
CONFIRM = 0.7
REACH = 2
ORDERS = 3
GAIN = 10.0
# Words that one step of the classifier works on; bounds its arrays, not the size of a text.
STEP_WORDS = 1 << 15

# Sentences of public licence texts and of the usual notices that name them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 2-Clause License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Eclipse Public License - v 2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "proprietary": ["All rights reserved.", "This document is proprietary and confidential; unauthorized copying of this file is strictly prohibited."],
}
# Identifiers of the public SPDX list by family; each makes the one-line notice.
SPDX = {
    "apache-2.0": ["Apache-2.0"],
    "mit": ["MIT", "MIT-0"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "mpl-2.0": ["MPL-2.0"],
    "epl-2.0": ["EPL-1.0", "EPL-2.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
    "isc": ["ISC"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {i}" for i in _ids]
FAMILIES = list(TEMPLATES)


class Lines:
    """Folded word hashes of a batch, the first word of each line with a word, and the first word of each paragraph."""

    def __init__(self, array):
        self.words = w = Words(array)
        data = np.where((w.data >= 65) & (w.data <= 90), w.data + 32, w.data).astype(np.uint8)
        inner = np.concatenate([[0], np.cumsum(~_EDGE[w.data])])
        keep = inner[w.end] > inner[w.start]
        start, end = forms(w)
        self.hashes = hash_ranges(data, start[keep], end[keep])
        self.begin, self.end = w.start[keep], w.end[keep]
        text = w.text_of()[keep]
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        self.number = breaks[self.begin] - breaks[w.offsets[text]]  # line of each word in its text
        other, step = np.diff(text, prepend=-1) != 0, np.diff(self.number, prepend=-1)
        opens = other | (step != 0)
        self.start = np.flatnonzero(opens)
        self.first = np.append(self.start, len(self.hashes))
        self.text = text[self.start]
        self.line = np.cumsum(opens) - 1  # of each word
        self.paragraph = np.cumsum((other | (step > 1))[self.start]) - 1  # of each line
        fresh = np.diff(self.paragraph, prepend=-1) != 0
        self.paragraph_text = self.text[fresh]
        self.paragraph_first = np.append(self.start[fresh], len(self.hashes))

    def __len__(self) -> int:
        return len(self.start)

    def runs(self):
        """For each length of runs: the line and the hash of every run."""
        line = np.repeat(np.arange(len(self)), np.diff(self.first))
        for n in range(1, ORDERS + 1):
            h, at = grams(self.hashes, self.first, n)
            yield line[at], mix(h + np.uint64(n))


def of_strings(texts: list[str]) -> Lines:
    import pyarrow as pa

    return Lines(pa.array(texts, pa.large_string()))


def template_runs() -> tuple[np.ndarray, ...]:
    """All three-word runs of the sentences: hash and sentence; family, number of runs and of words of each sentence."""
    sentences = [(f, s) for f, family in enumerate(FAMILIES) for s in TEMPLATES[family]]
    lines = of_strings([s for _, s in sentences])
    *_, (line, h) = lines.runs()
    # Sentences of one or two words are one run of what they have.
    for k in np.flatnonzero(np.diff(lines.first) < ORDERS):
        for run_line, run_hash in list(lines.runs())[int(np.diff(lines.first)[k]) - 1 : int(np.diff(lines.first)[k])]:
            line, h = np.append(line, k), np.append(h, run_hash[run_line == k])
    keep = np.unique(np.stack([h, line.astype(np.uint64)]), axis=1)
    h, line = keep[0], keep[1].astype(np.int64)
    return h, line, np.array([f for f, _ in sentences]), np.bincount(line, minlength=len(sentences)), np.diff(lines.first)


def examples(seed: int = 5, crops: int = 40) -> tuple[list[str], list[int]]:
    """Whole sentences and crops of them, with the class of their family (0 is unknown)."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for f, family in enumerate(FAMILIES):
        for sentence in TEMPLATES[family]:
            words = sentence.split()
            for k in range(crops):
                keep = words
                if k:
                    size = max(min(3, len(words)), int(len(words) * rng.uniform(0.6, 1.0)))
                    at = rng.integers(0, len(words) - size + 1)
                    keep = words[at : at + size]
                texts.append(" ".join(keep))
                labels.append(f + 1)
    return texts, labels


def sparse(lines: Lines):
    """Line, dimension and share of every run of a line."""
    rows, dims, shares = [], [], []
    for line, h in lines.runs():
        n = np.bincount(line, minlength=len(lines))
        rows.append(line)
        dims.append((h % np.uint64(DIMS)).astype(np.int64))
        shares.append(GAIN / n[line])
    return np.concatenate(rows), np.concatenate(dims), np.concatenate(shares)


def hits(lines: Lines, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and template run of every run that a paragraph shares with a template."""
    h = known[0]
    order = np.argsort(h, kind="stable")
    begin, end, run = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, ORDERS + 1):
        found, at = grams(lines.hashes, lines.paragraph_first, n)
        found = mix(found + np.uint64(n))
        low, high = np.searchsorted(h[order], found), np.searchsorted(h[order], found, side="right")
        hit = np.flatnonzero(high > low)
        for k in range(int((high - low)[hit].max(initial=0))):
            more = hit[low[hit] + k < high[hit]]
            begin.append(at[more])
            end.append(at[more] + n)
            run.append(order[low[more] + k])
    return np.concatenate(begin), np.concatenate(end), np.concatenate(run)


def passages(lines: Lines, known, least: float) -> list[tuple[int, int, int, int, int, float]]:
    """Passages and lines that hold at least the share ``least`` of a sentence's runs.

    Each: words (from, to) to classify, words (from, to) between the first and last run, sentence, share.
    """
    _, sentence_of, _, size, n_words = known
    begin, end, run = hits(lines, known)
    sentence = sentence_of[run]
    need = np.ceil(least * size - 1e-9).astype(np.int64)
    out = []
    # Lines by themselves, whatever their length.
    line = lines.line[begin]
    inside = np.flatnonzero(lines.line[end - 1] == line)
    order = inside[np.lexsort((begin[inside], sentence[inside], line[inside]))]
    cuts = np.flatnonzero((np.diff(line[order], prepend=-1) != 0) | (np.diff(sentence[order], prepend=-1) != 0))
    ends = np.append(cuts, len(order))[1:]
    for a, b in zip(cuts, ends, strict=True):
        s = sentence[order[a]]
        if b - a >= need[s]:
            n = len(set(run[order[a:b]].tolist()))
            if n >= need[s]:
                i = line[order[a]]
                out.append((lines.first[i], lines.first[i + 1], begin[order[a]], int(end[order[a:b]].max()), s, n / size[s]))
    # Passages across lines: from each run the runs within reach; of those that meet, the fullest and shortest.
    paragraph = lines.paragraph[line]
    order = np.lexsort((begin, paragraph, sentence))
    begin, end, run, sentence, paragraph = begin[order], end[order], run[order], sentence[order], paragraph[order]
    wide = len(lines.hashes) + REACH * int(n_words.max()) + 1
    group = np.cumsum((np.diff(sentence, prepend=-1) != 0) | (np.diff(paragraph, prepend=-1) != 0))
    stop = np.searchsorted(group * wide + begin, group * wide + begin + REACH * n_words[sentence])
    some = []
    for k in np.flatnonzero(stop - np.arange(len(run)) >= need[sentence]):
        seen, last = set(), k
        for j, r in enumerate(run[k : stop[k]].tolist(), k):
            if r not in seen:
                seen.add(r)
                last = j
        if len(seen) >= need[sentence[k]]:
            some.append((-len(seen), int(end[last] - begin[k]), k, last))
    taken = np.zeros(len(run), bool)
    for n, length, k, last in sorted(some):
        if not taken[k : last + 1].any():
            taken[k : last + 1] = True
            s = sentence[k]
            out.append((begin[k], begin[k] + length, begin[k], begin[k] + length, s, -n / size[s]))
    return out


def clean_lines(batches):
    """Lines outside all passages that hold half a template."""
    import pyarrow as pa

    known = template_runs()
    for batch in slices(batches, "text"):
        lines = Lines(batch.column(1))
        clean = np.ones(len(lines), bool)
        for _, _, a, b, _, _ in passages(lines, known, 0.5):
            clean[lines.line[a] : lines.line[b - 1] + 1] = False
        begin, end = lines.begin[lines.first[:-1][clean]], lines.end[lines.first[1:][clean] - 1]
        texts = [lines.words.data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["line"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, unknown_rows: int = UNKNOWN_ROWS) -> dict:
    """Weights, bias and temperature, fitted in one task on the templates and a bounded sample of lines."""
    some = documents(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    chosen = F.broadcast(some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct())  # bounded rows
    lines = some.join(chosen, "doc_id").select("doc_id", "text").mapInArrow(clean_lines, "line string")
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(unknown_rows)
    one = docs.sparkSession.createDataFrame([("",)], "line string")
    lines = lines.select("line").union(one)

    def train(pdf):
        import pandas as pd

        unknown = of_strings(pdf["line"].tolist())
        r0, d0, s0 = sparse(unknown)
        texts, labels = examples()
        known = of_strings(texts)
        r1, d1, s1 = sparse(known)
        row, dim, share = np.concatenate([r0, r1 + len(unknown)]), np.concatenate([d0, d1]), np.concatenate([s0, s1])
        y = np.concatenate([np.zeros(len(unknown), np.int64), np.array(labels)])
        fold = np.arange(len(y)) % 3 == 2
        part = lambda keep: (keep[row], np.cumsum(keep)[row] - 1)
        inside, new = part(~fold)
        w, bias = logistic.fit_sparse(new[inside], dim[inside], share[inside], y[~fold], len(FAMILIES) + 1, DIMS, steps=60)
        outside, new = part(fold)
        rest = y[fold]
        z = np.stack([np.bincount(new[outside], w[dim[outside], c] * share[outside], minlength=len(rest)) for c in range(w.shape[1])], axis=1) + bias
        losses = [(-np.log(logistic.softmax(z / t)[np.arange(len(rest)), rest] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41)]
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "told": [[*bias, min(losses)[1]]]})

    found = lines.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "weights binary, told array<double>").first()
    told = np.array(found["told"])
    return {"weights": np.frombuffer(found["weights"], "<f4").reshape(DIMS, -1), "bias": told[:-1], "temperature": told[-1]}


def probabilities(lines: Lines, model: dict, low: int, high: int):
    """Function from ranges of words between ``low`` and ``high``, each within a paragraph, to class probabilities."""
    weights = model["weights"]
    cuts = lines.paragraph_first
    cuts = cuts[np.searchsorted(cuts, low, side="right") : np.searchsorted(cuts, high)]
    cuts = np.concatenate([[0], cuts - low, [high - low]])
    sums = []
    for n in range(1, ORDERS + 1):
        h, at = grams(lines.hashes[low:high], cuts, n)
        total = np.zeros((high - low + 1, weights.shape[1]))
        total[at + 1] = weights[(mix(h + np.uint64(n)) % np.uint64(DIMS)).astype(np.int64)]
        sums.append(np.cumsum(total, axis=0, out=total))

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.tile(model["bias"], (len(a), 1))
        for n, total in enumerate(sums, 1):
            size = b - a - n + 1
            has = np.flatnonzero(size > 0)
            z[has] += GAIN * (total[b[has] - low - n + 1] - total[a[has] - low]) / size[has, None]
        return logistic.softmax(z / model["temperature"])

    return of


def judged(lines: Lines, model: dict, known) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """Whether each paragraph is predicted, and the confirmed passages: words (from, to), family, share."""
    predicted = np.zeros(len(lines.paragraph_text), bool)
    held, agreed = sorted(passages(lines, known, CONFIRM)), []
    from_, to = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
    first, longest = lines.first, int(known[4].max())
    low = 0
    while low < len(lines):
        high = max(low + 1, int(np.searchsorted(first, first[low] + STEP_WORDS, side="right")) - 1)
        mine = slice(*np.searchsorted(from_, [first[low], first[high]]))
        end = first[min(len(lines), int(np.searchsorted(first, first[high] + longest)))]
        of = probabilities(lines, model, int(first[low]), int(max(end, to[mine].max(initial=0))))
        i, more = np.arange(low, high), 0
        while len(i):  # each line with as many lines after it as the longest sentence may take
            p = of(first[i], first[i + more + 1])
            predicted[lines.paragraph[i[(p.argmax(axis=1) > 0) & (p.max(axis=1) >= REPORT_AT)]]] = True
            more += 1
            i = i[(i + more < len(lines)) & (first[np.minimum(i + more, len(lines))] - first[i] < longest)]
            i = i[lines.paragraph[i + more] == lines.paragraph[i]]
        p = of(from_[mine], to[mine])
        for (_, _, a, b, s, share), best, sure in zip(held[mine], p.argmax(axis=1), p.max(axis=1, initial=0), strict=True):
            if best > 0 and sure >= REPORT_AT:
                predicted[lines.paragraph[lines.line[a]]] = True
                if best == known[2][s] + 1:
                    agreed.append((int(a), int(b), int(best) - 1, float(share)))
        low = high
    agreed = sorted(set(agreed))
    lost = set()
    for k, (a, b, family, share) in enumerate(agreed):
        for j in range(k + 1, len(agreed)):
            a2, b2, family2, share2 = agreed[j]
            if a2 >= b:
                break
            if family != family2 and share != share2 and 2 * (min(b, b2) - a2) > max(b - a, b2 - a2):
                lost.add(k if share < share2 else j)
    return predicted, [x for k, x in enumerate(agreed) if k not in lost]


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, n_paragraphs, n_predicted, n_confirmed, families, spans`` of each document.

    ``families``: confirmed ones, sorted and comma-joined; ``spans``: family:line number (from 0) of the first line of each
    confirmed passage.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = documents(docs, "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        known = template_runs()
        for batch in slices(batches, "text"):
            lines = Lines(batch.column(1))
            n = lines.words.n_texts
            predicted, passed = judged(lines, shared.value, known)
            confirmed = np.zeros(len(predicted), bool)
            names: list[set] = [set() for _ in range(n)]
            spans: list[dict] = [{} for _ in range(n)]
            for a, _, family, _ in passed:
                i = lines.line[a]
                confirmed[lines.paragraph[i]] = True
                names[lines.text[i]].add(FAMILIES[family])
                spans[lines.text[i]][f"{FAMILIES[family]}:{lines.number[a]}"] = True
            count = lambda keep: pa.array(np.bincount(lines.paragraph_text[keep], minlength=n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(slice(None)), count(predicted), count(confirmed), pa.array([",".join(sorted(x)) for x in names], pa.string()), pa.array([",".join(x) for x in spans], pa.string())],
                names=["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_predicted long, n_confirmed long, families string, spans string")
