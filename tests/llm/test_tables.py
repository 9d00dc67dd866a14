"""Operators over tables against brute force, and their odd inputs."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import ann, common, jaccard, lm, mixing, packing, rans

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shared_folder_is_required_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


# ---- token files ------------------------------------------------------------------------------------------


def ids_of(name, text):
    t = tokenizers.Tokenizer.from_file(public.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "", None, "a", "  two  spaces\n\nand\tmore ", "it's we'll 1234 x", "Σας é́ ñ 日本語", "<|endoftext|> a", "　wide  space ", "\n", "word " * 9000,
    "q" * 400 + " é" * 50, "x<|startoftext|>y <|endoftext|><|endoftext|>\n<|endoftext|", "nul \x00 mark \x00\x00 a\x00b",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_round_trip(spark, rows, name):
    docs = rows([(7 * i % 13, t, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", "s")])
    blocks, table = rans.token_files(spark, docs, public.path(name), 1)
    found = sorted(rans.read_blocks(blocks, table).collect(), key=lambda r: r["start"])
    ids = [None if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == [None, *sorted(7 * i % 13 for i in range(13))]
    texts, start = {7 * i % 13: t for i, t in enumerate(TEXTS)} | {None: "null id"}, 0
    for r in found:
        want = np.array([*ids_of(name, texts[r["doc_id"]]), 1], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(want), want.tobytes())
        start += len(want)


def test_blocks_of_any_size():
    rng = np.random.default_rng(3)
    blocks = [rng.geometric(0.01, n).astype(np.uint32) for n in (1, 31, 32, 33, 16_384, 16_385, 40_000)]
    ids, n = np.unique(np.concatenate(blocks), return_counts=True)
    table = rans.Table(ids, n)
    assert int(table.freq.sum()) == 1 << rans.SCALE_BITS
    coded = rans.encode_blocks(table, blocks)
    for block, back in zip(blocks, rans.decode_blocks(table, [(len(b), *c) for b, c in zip(blocks, coded, strict=True)]), strict=True):
        assert (block == back).all()
    assert [len(c[2]) for c in coded] == [0, 0, 0, 0, 0, 1, 2]


def test_damaged_block_is_found(spark, rows):
    from pyspark.sql import functions as F

    blocks, table = rans.token_files(spark, rows([(i, f"some text {i}", "s") for i in range(9)]), public.path("word_bpe_49k.json"), 1)
    with pytest.raises(Exception, match="checksum"):
        rans.read_blocks(blocks.withColumn("crc32", F.col("crc32") + 1), table).collect()


def test_empty_tables(spark, rows):
    none = rows([])
    blocks, table = rans.token_files(spark, none, public.path("word_bpe_49k.json"), 1)
    assert rans.read_blocks(blocks, table).count() == 0
    assert packing.pack(packing.pieces(none, public.path("byte_bpe_50k.json"), 0)).count() == 0
    assert mixing.mix(none)[0].count() == 0
    assert lm.score(none).count() == 0
    assert jaccard.join(none).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------


def test_packing_places_every_piece_once(spark, odd):
    cut = packing.pieces(odd, public.path("byte_bpe_50k.json"), 0)
    found = packing.pack(cut).collect()
    assert len(found) == cut.count() and sum(r["length"] for r in found) == cut.groupBy().sum("length").first()[0]
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    whole = packing.sequences(cut).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in found) and len(whole) == len(by)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6 + seed / 3, 1, 20_000).astype(int) + 1), minlength=2049)
    plan = packing.plan_of(counts)
    placed, fill = np.zeros(2049, np.int64), np.zeros(plan.opened, np.int64)
    for length, first, number, sequence, offset in plan.runs:
        assert placed[length] == first and (fill[sequence : sequence + number] == offset).all()
        placed[length] += number
        fill[sequence : sequence + number] += length
    assert (placed == counts).all() and fill.max() <= 2048
    bound = max(-(-int((counts * np.arange(2049)).sum()) // 2048), int(counts[1025:].sum()))
    plain = packing.Plan(counts, 2048)
    plain.best_fit()
    assert plan.opened <= min(1.002 * bound + 1, 1.001 * plain.opened + 1)


def test_grouping_beats_best_fit_where_sizes_are_awkward():
    """Pieces of about a quarter to a half of a sequence: plain best fit wastes what configurations don't."""
    counts = np.bincount(np.random.default_rng(4).integers(500, 1100, 5000), minlength=2049)
    plan, plain = packing.plan_of(counts), packing.Plan(counts, 2048)
    plain.best_fit()
    assert plan.opened < 0.98 * plain.opened


# ---- mixing -----------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark, rows):
    rng = np.random.default_rng(4)
    data = [(i, "w " * int(rng.integers(0, 900)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 40 + [None] * 9)]
    found, slots = mixing.mix(rows(data), block_words=64)
    found = found.collect()
    assert len(found) == len(data) and all(r["taken"] <= 2 * r["size"] for r in found)
    per = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in found:
        p = per[r["source"]]
        p[0], p[1], p[2] = p[0] + r["taken"], r["target"], p[2] + r["size"]
    assert all(abs(taken - target) <= 1 for taken, target, _ in per.values())
    total = 1.5 * sum(p[2] for p in per.values())
    assert math.isclose(sum(p[1] for p in per.values()), total)
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    free = {s: p[1] / weights[s] for s, p in per.items() if p[1] < 2 * p[2] - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6
    order = [r["sid"] for r in slots.orderBy("position").collect()]
    share = collections.Counter(order)
    ahead = order[: len(order) // 2]
    assert all(abs(ahead.count(s) - n / 2) <= 8 for s, n in share.items())
    again = mixing.mix(rows(data), block_words=64)[0].collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_mix_of_odd_rows(odd):
    found = mixing.mix(odd)[0].collect()
    assert len(found) == 7 and sum(r["size"] == 0 and r["taken"] == 0 for r in found) == 3


# ---- language model ---------------------------------------------------------------------------------------


def plain_scores(texts, order=3, alpha=0.4, unseen=0.5):
    found = [WORD.findall(t or "") for t in texts]
    count = [collections.Counter(tuple(w[i : i + n]) for w in found for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, found))
    for w in found:
        own = [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        score = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = count[n - 1][g] - own[n - 1][g]
                if c > 0:
                    base = total - len(w) if n == 1 else count[n - 2][g[:-1]] - own[n - 2][g[:-1]]
                    score += math.log(c / base) + (most - n) * math.log(alpha)
                    break
            else:
                score += math.log(unseen / max(1, total - len(w))) + (most - 1) * math.log(alpha)
        yield len(w), score


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_lm_scores(rows, chunk_bytes):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40)))) for _ in range(40)] + [None, "", "zz unseen words here"]
    found = {r["doc_id"]: r for r in lm.score(rows([(i, t, "s") for i, t in enumerate(texts)]), chunk_bytes=chunk_bytes).collect()}
    for i, (n, score) in enumerate(plain_scores(texts)):
        assert found[i]["n_words"] == n and math.isclose(found[i]["log_score"], score, abs_tol=1e-6)


def test_lm_scores_of_odd_rows(odd):
    assert sorted(r["n_words"] for r in lm.score(odd).collect()) == [0, 0, 0, 1, 1, 7, 30_002]


# ---- Jaccard join -----------------------------------------------------------------------------------------


def plain_classes(texts):
    def grams(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * len(sets[i] | sets[j]):
            links[i], links[j] = links[i] + 1, links[j] + 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [7, 1500])
def test_jaccard_join_matches_all_pairs(rows, block):
    rng = np.random.default_rng(6)
    texts = [None, "", "one two", "one two", "one two three"]
    for size in (1, 2, 3, 40):
        base = [f"w{k}" for k in rng.integers(0, 5000, 90)]
        for _ in range(size):
            copy = list(base)
            for k in rng.integers(0, 90, int(rng.integers(0, 4))):
                copy[k] = f"n{rng.integers(0, 9999)}"
            texts += [" ".join(copy)] * int(rng.integers(1, 3))
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(rows([(i, t, "s") for i, t in enumerate(texts)]), block=block).collect()}
    assert [found[i] for i in range(len(texts))] == plain_classes(texts)


def test_texts_asked_for_are_let_through_and_few_others(spark):
    every = spark.range(-3000, 3000).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    wanted = every.where("doc_id % 50 = 0")
    kept = jaccard.likely(every, "doc_id", wanted)
    assert kept.join(wanted, "doc_id", "left_semi").count() == wanted.count() <= kept.count() <= wanted.count() + 20
    assert jaccard.likely(every, "doc_id", wanted.limit(0)).count() == 0


def test_jaccard_join_of_odd_rows(odd):
    found = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(odd).collect()), key=str)
    assert found == sorted([(None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (4, 4, 1), (5, 5, 0)], key=str)


def test_large_sets_are_dealt_into_blocks(rows, monkeypatch):
    """Blocks by n-grams as well as by members: the same links in any number of blocks."""
    base = [f"w{i}" for i in range(3000)]
    data = [(k, " ".join(base[: 3000 - 40 * k]), "s") for k in range(8)] + [(50 + k, " ".join(f"x{k}y{i}" for i in range(50)), "s") for k in range(3)]
    want = sorted(tuple(r) for r in jaccard.join(rows(data)).collect())
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 5000)
    assert sorted(tuple(r) for r in jaccard.join(rows(data)).collect()) == want
    plain = plain_classes([t for _, t, _ in data])
    assert [(c, n) for _, _, c, n in want] == [(data[c][0], n) for c, n in plain]


def test_bands_reach_the_recall():
    bands, per = jaccard.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**per) ** bands >= 0.9995 and bands * per <= jaccard.MOST_HASHES


# ---- neighbours -------------------------------------------------------------------------------------------


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24)) + 3 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    x[5] = x[7] = x[100]
    data = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    data += [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [float("nan")] * 24, 0), (9004, [None] * 24, 0), (None, [1.0] * 24, 0), (9100, [1.0], 0)]
    items = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    found = collections.defaultdict(list)
    for r in ann.neighbours(items, "id % 100 = 0").orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 3000, 100))
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert len(got) == 10 and [g for g in got] == sorted(got, key=lambda g: (g[1], g[0]))
        assert all(math.isclose(s, d[v]) for v, s in got)
        hits += len(set(best) & {v for v, _ in got})
    assert hits >= 0.9 * 10 * len(found)
    assert [v for v, _ in found[100][:2]] == [5, 7]


def test_neighbours_of_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(few, "id % 100 = 0").collect()] == [(0, 1, 1, 1.0)]
    assert ann.neighbours(few.limit(0), "id % 100 = 0").count() == 0


# ---- pipeline ---------------------------------------------------------------------------------------------


def test_near_duplicates_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    def text(k, last=""):
        return " ".join(f"w{k}x{i}" for i in range(60)) + last

    data = [
        (3, text(1)), (7, text(1)), (7, text(2)),  # a copy and a text of its own under one id
        (8, text(3)), (8, text(4)), (8, text(4)), (9, text(4, " near")),  # two texts, one of them twice and nearly again
        (None, text(5)), (None, text(5)), (None, text(6)), (None, text(3)),  # copies among null ids and of a known id
        (10, text(7)), (10, text(7, " near")), (11, text(8)), (11, text(8, " near")), (11, text(9)),  # near copies under one id
        (12, ""), (12, ""), (12, None), (13, ""), (None, None), (None, None),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.orderBy("n_chars", "text")):
        found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()]
        alike = collections.Counter((d, (t or "").removesuffix(" near")) for d, t in found)
        want = [(3, 1), (7, 2), (8, 3), (8, 4), (None, 5), (None, 6), (10, 7), (11, 8), (11, 9)]
        assert alike == collections.Counter([*((d, text(k)) for d, k in want), (12, ""), (12, ""), (13, ""), (None, "")])
        assert (8, text(4)) in found


def test_source_mix_takes_rows_and_not_ids(spark):
    """Rows that repeat an id are taken each for itself; extra copies go by the mix alone."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    data = [(i % 7, " ".join(f"w{k}" for k in rng.integers(0, 99, 40 + i)), "en", "ab"[i % 2], 1) for i in range(60)] + [(None, "x y z", None, None, None), (1, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    found = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.source_mix(spark, docs, "").collect())
    mixed, _ = mixing.mix(docs.select(F.xxhash64(*corpus_pipeline.COLUMNS).alias("doc_id"), "source", "text"))
    keys = {r["k"]: (r["doc_id"], r["text"]) for r in docs.select("*", F.xxhash64(*corpus_pipeline.COLUMNS).alias("k")).collect()}
    want = {keys[r["doc_id"]]: max(1, round(r["taken"] / r["size"])) for r in mixed.where("taken > 0").collect()}
    assert found == want and len({n for n in want.values()}) > 1


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, rank int, bucket string")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from codestrata.llm import quality

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept.append(docs)
    first, unique, masked, mixed, packed = (d.collect() for d in kept)
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    text = {r["doc_id"]: r["text"] for r in start}
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).where("kept").collect()}
    assert {r["doc_id"] for r in first} == good and all(text[r["doc_id"]] == r["text"] for r in first)
    ids = sorted(good)
    classes = plain_classes([text[i] for i in ids])
    assert sorted(r["doc_id"] for r in unique) == sorted({ids[c] for c, _ in classes})
    assert sorted(r["doc_id"] for r in masked) == sorted(r["doc_id"] for r in unique)
    from codestrata.llm import pii

    assert not any(any(pii.base_spans(r["text"]).values()) for r in masked)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked} and {r["text"] for r in mixed} <= {r["text"] for r in masked}
    tokens = sum(len(ids_of("byte_bpe_50k.json", r["text"])) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == tokens
    for d in kept:
        d.unpersist()
