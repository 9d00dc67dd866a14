"""Words, personal data, quality figures, toxicity and licences against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pa = pytest.importorskip("pyarrow")
from codestrata.llm import licenses, logistic, pii, quality, toxicity  # noqa: E402
from codestrata.llm.words import Words  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab |#\n\té\x0b", max_size=60), max_size=6)


def words(texts):
    return Words(pa.array(texts, pa.large_string()))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_base_figures_match_a_plain_count(texts):
    w = words(texts)
    got = quality.base_counts(w, w.hashes())
    for i, text in enumerate(texts):
        found = WORD.findall(text)
        grams = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
        n = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert want == tuple(int(got[c][i]) for c in quality.BASE)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in BASE.items()}


PARTS = st.sampled_from(["@", "a", ".", "-", "1", "12", " ", "+", "4", "(", "x@y.z", "1.2.3.4", "256", "4111111111111111", "é", "+1 (017) 555-7713"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text,kind,source",
    [
        ("write to john [at] mail (dot) com now", "email", "john [at] mail (dot) com"),
        ("john at mail dot com", "email", "john at mail dot com"),
        ("x pаypal@mail.com", "email", "pаypal@mail.com"),
        ("plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"),
        ("４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("4111​111111111111", "card", "4111​111111111111"),
        ("one nine two dot one dot two dot three", "ip", "one nine two dot one dot two dot three"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base = pii.base_spans(text)
    found = pii.disguised_spans(text, base)
    assert [text[a:b] for a, b in found[kind]] == [source] and (text[0] == "x" or not base[kind])


@pytest.mark.parametrize(
    "source",
    [
        "john (at) mail dot com", "john at mail (dot) com", "john@mail dot com", "john dot doe at mail dot com", "john@mail&#46;com",
        "john@mail&period;com", "john dot doe@mail.com", "john [dot] doe at mail dot example (dot) com", "john dot doe (at) mail.com",
        "john dot a dot doe &#64; mail dot com", "john AT mail DOT com",
    ],
)
def test_mixed_disguises_are_found_whole(source):
    text = f"write {source}, or call"
    base = pii.base_spans(text)
    more = pii.disguised_spans(text, base)
    assert [text[a:b] for a, b in more["email"]] == [source]
    assert pii.masked(text, {k: base[k] + more[k] for k in pii.KINDS}) == "write [EMAIL], or call"


def test_wide_spaces_and_repeated_words():
    for source in ("john  at  mail  dot  com", "john   dot  doe at mail   dot com"):
        assert pii.disguised_spans(source, pii.base_spans(source))["email"] == [(0, len(source))]
    assert not any(pii.disguised_spans("meet at noon dot dot", pii.base_spans("meet at noon dot dot")).values())


def test_bare_words_in_prose_are_no_addresses():
    for text in ["Look at example.com today.", "It was at one dot two then.", "The dot came at noon. A dot is a dot here.", "Ask @john about it."]:
        assert not any(pii.disguised_spans(text, pii.base_spans(text)).values())


def test_plain_prose_gets_no_added_spans():
    text = "He was at one of two places. Dot came at seven. See version 1.2.3 (at home)."
    assert not any(pii.disguised_spans(text, pii.base_spans(text)).values())


def test_personal_data_query_shape(odd):
    found = pii.find(odd, mask=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(found) == 7 and all(r["base_sha256"] == empty and r["spans"] == "" for r in found)


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    first, emission = np.array([0, 3, 3, 8, 9]), rng.normal(size=9) * 2
    move, enter = rng.normal(size=(2, 2)), rng.normal(size=2)
    state, _ = toxicity.marginals(emission, first, move, enter)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = np.zeros((b - a, 2))
        for tags in itertools.product((0, 1), repeat=int(b - a)):
            if tags:
                s = enter[tags[0]] + sum(emission[a + i] for i, t in enumerate(tags) if t) + sum(move[x, y] for x, y in zip(tags, tags[1:], strict=False))
                for i, t in enumerate(tags):
                    total[i, t] += np.exp(s)
        if b > a:
            assert np.allclose(total / total.sum(axis=1, keepdims=True), state[a:b])


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for d in range(400):
        text = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(60)]
        toxic, good = d % 4 == 0, d % 5 != 0
        for k in rng.integers(0, 60, 3 if toxic else 0):
            text[k] = "vile"
        if not good:
            text = [w + "##" for w in text]
        docs.append((d, " ".join(text)))
        labels.append((d, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(marked):
    docs, labels = marked
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
    held = [(r["predicted"], int(d % 4 == 0)) for d, r in found.items() if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    text = dict(docs.collect())
    spans = [text[d][int(a) : int(b)] for d, r in found.items() if r["spans"] for a, b in (s.split(":") for s in r["spans"].split(","))]
    assert spans and sum("vile" in s for s in spans) >= 0.95 * len(spans)


def test_quality_model_and_rules(marked, odd):
    docs, labels = marked
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in found) >= 0.97 * len(found)
    assert [r["base_failed"] for r in quality.score(odd, model).collect()] == [True] * 7
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs, None).where("kept").count() == 400


def test_few_labelled_rows_still_teach(spark):
    """A small table: the evidence asked for shrinks with the number of forms, so five toxic texts are enough."""
    rng = np.random.default_rng(5)
    plain = lambda: " ".join(f"w{k}" for k in rng.integers(0, 200, 60))
    texts = [plain() for _ in range(40)] + [plain() + " you vile grubnak " + plain() + " such a grubnak" for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(50)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sum((r["predicted"] == 1) == (r["doc_id"] >= 40) for r in found) >= 48


def test_samples_take_one_row_an_id(spark):
    """An id that very many rows share gives one row to the training, always the same."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (2, "b"), (3, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    for rows in (docs, docs.orderBy("text")):
        found = sorted((r["doc_id"], r["text"]) for r in quality.sampled_texts(rows, sample).collect())
        assert [i for i, _ in found] == [1, 2, 3] and found == sorted((r["doc_id"], r["text"]) for r in quality.sampled_texts(docs, sample).collect())


def test_character_runs_are_whole_characters():
    """Texts of equal characters have equal features whatever their bytes: four characters make one run."""
    w = words(["éñü日本", "abcde", "ab", ""])
    of, dims = quality.features(w, w.hashes())[2]
    assert of.tolist() == [0, 0, 1, 1] and len(set(dims.tolist())) == 4


def test_empty_tables_of_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan(none, licenses.fit(none)).count() == 0
    assert pii.find(none, mask=True).count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_without_labels_nothing_is_toxic(marked, odd):
    docs, labels = marked
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_licence_families(spark, odd):
    texts = ["Some prose here.\n" + s for family in licenses.FAMILIES for s in licenses.TEMPLATES[family][:1]] + ["Nothing of the kind. Mit ihr."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(docs)
    found = {r["doc_id"]: r["families"] for r in licenses.scan(docs, model).collect()}
    assert found == {**dict(enumerate(licenses.FAMILIES)), len(texts) - 1: ""}
    assert [r["families"] for r in licenses.scan(odd, model).collect()] == [""] * 7


def test_every_identifier_and_title(spark):
    """One-line notices by the public identifiers, upper- or lower-case, and titles; what only resembles one is none."""
    lines = [(f, f"// SPDX-License-Identifier: {i}") for f, ids in licenses.SPDX.items() for i in ids]
    lines += [("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), ("epl-2.0", "Eclipse Public License - v 2.0")]
    lines += [("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE\nWARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")]
    lines += [("", "SPDX-License-Identifier: Other-1.0"), ("", "The public library opens at nine; the licence plate was found.")]
    prose = "\n\n".join(f"word{k} some plain prose number {k} stands here" for k in range(30))
    docs = spark.createDataFrame([(k, f"{line}\n\n{prose}") for k, (_, line) in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert [found[k] for k in range(len(lines))] == [f for f, _ in lines]


def test_licence_counts_against_a_plain_search(spark):
    """Paragraphs, confirmed families and predictions by a reimplementation that goes window by window."""
    import itertools

    rng = np.random.default_rng(11)
    sentences = [s for f in ("mit", "gpl", "bsd", "isc") for s in licenses.TEMPLATES[f][:2]]
    texts = []
    for _ in range(40):
        parts = [str(rng.choice(sentences)) if rng.random() < 0.4 else " ".join(f"w{rng.integers(300)}" for _ in range(rng.integers(1, 14))) for _ in range(6)]
        texts.append("".join(p + str(rng.choice(["\n", "\n\n", "\n \n"])) for p in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(docs)
    found = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}

    def folded(line):
        words = [w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) or w for w in line.lower().split()]
        return [w for w in words if any(c.isalnum() or ord(c) > 127 for c in w)]

    for k, text in enumerate(texts):
        paragraphs = [list(g) for has, g in itertools.groupby((folded(x) for x in text.split("\n")), key=bool) if has]
        assert found[k]["n_paragraphs"] == len(paragraphs)
        families, confirmed = set(), 0
        for lines in paragraphs:
            words = [w for line in lines for w in line]
            held = set()
            for family in licenses.FAMILIES:
                for s in licenses.TEMPLATES[family]:
                    want = folded(s)
                    if any(words[i : i + len(want)] == want for i in range(len(words) - len(want) + 1)):
                        held.add(family)
            families |= held
            confirmed += bool(held)
        assert families <= set(filter(None, found[k]["families"].split(",")))
        assert confirmed <= found[k]["n_confirmed"] <= found[k]["n_predicted"] <= found[k]["n_paragraphs"]
        assert found[k]["families"] == ",".join(sorted(families))


NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def test_hard_wrapped_notices(spark):
    prose = "\n".join("".join(chr(97 + (i * k) % 26) for k in range(1, 7)) + " some words of prose stand in this line" for i in range(40))
    want, texts = [], []
    for family, notice in NOTICES.items():
        for width in (40, 70, 80, 2000):
            for mark in ("", " * ", "# ", "// "):
                want.append(family)
                texts.append(f"/*\n{wrapped(notice, width, mark)}\n*/\n{prose}")
        want.append(family)
        texts.append(prose + "\n" + wrapped(notice, 75).replace("\n\n", "\n") + prose)  # no blank line anywhere
    want += ["bsd,mit", "apache-2.0,gpl", "", ""]
    texts.append(wrapped(NOTICES["mit"], 72) + "\n\n" + wrapped(NOTICES["bsd"], 72))
    texts.append("Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 3.")
    texts += [prose, "Permission is hereby granted to no one. The above notice shall be included in the list of conditions."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert [found[i]["families"] for i in range(len(texts))] == want
    both = found[len(texts) - 4]
    assert both["n_confirmed"] == 6 and both["spans"].startswith("mit:0,mit:")


def test_passages_match_a_plain_search():
    rng = np.random.default_rng(7)
    vocabulary = " ".join(licenses.TEMPLATES["mit"] + licenses.TEMPLATES["gpl"]).split()
    texts = ["".join(w + str(rng.choice([" ", "\n"])) for w in rng.choice(vocabulary, 60)) + licenses.TEMPLATES["isc"][1].replace(" ", "\n", 3) for _ in range(20)]
    lines, known = licenses.of_strings(texts), licenses.template_runs()
    isc = [s for s, f in enumerate(known[2]) if licenses.FAMILIES[f] == "isc"][1]
    found = [(lines.text[lines.line[a]], b - a, share) for _, _, a, b, s, share in licenses.passages(lines, known, 0.9) if s == isc]
    assert found == [(i, known[4][isc], 1.0) for i in range(20)]


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(int)
    a, b = logistic.platt(5 * (rng.normal(size=4000) + y), y)
    assert abs(a - 0.2) < 0.03 and abs(b - (math.log(0.3 / 0.7) - 0.5)) < 0.15
