"""Prefix trie, WARC archives and phrase collocations against plain reimplementations, and their odd inputs."""

import collections
import gzip
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from codestrata.llm import phrases, radix, trie, warc

# ---- radix tree -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [2, 7, 30, 256])
def test_radix_tree_levels_are_the_distinct_prefixes(letters):
    rng = random.Random(letters)
    for width in (1, 2, 3):
        keys = {b"".join(bytes([rng.randrange(letters) for _ in range(width)]) for _ in range(rng.randrange(6))) for _ in range(600)}
        keys = sorted(keys)
        rng.shuffle(keys)
        tree = radix.Tree()
        for i, key in enumerate(keys):
            tree.insert(key, i)
        parents, depths, rows = tree.levels(width)
        paths = {key[: width * d] for key in keys for d in range(len(key) // width + 1)} | {b""}
        assert len(parents) == len(paths)
        assert sorted(keys[r] for r in rows if r >= 0) == sorted(keys)
        for parent, depth, row in zip(parents, depths, rows):
            assert parent == -1 if depth == 0 else depths[parent] == depth - 1
            assert row < 0 or len(keys[row]) == width * depth


def test_radix_tree_layouts_grow():
    tree, seen = radix.Tree(), []
    for i in range(256):
        tree.insert(bytes([i]) * 3, i)
        seen.append(type(tree.root).__name__)
    assert [seen[i] for i in (0, 1, 3, 4, 15, 16, 47, 48, 255)] == ["Leaf", "Node4", "Node4", "Node16", "Node16", "Node48", "Node48", "Node256", "Node256"]
    assert [tree.root.find(i).row for i in range(256)] == list(range(256))


# ---- prefix trie ------------------------------------------------------------------------------------------


def plain_trie(seqs):
    """seqs: conversation -> list of (role, text)."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
        ends[tuple(seq)].append(conv)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        worth = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += not kids[node]
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tid = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, tid), (role, text)))
    own = {c: [x for _, x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(int(c - c % 5 if c >= 0 else c + (-c) % 5), [])[:h] + turns[h:]
    return out


SCHEMA = "conv_id long, turn int, role string, text string, nth int, depth string, id binary"


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", b"y") for r in rows], SCHEMA)
    found = trie.prefix_trie(*trie.rebuilt(trie.numbered(df)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def check_trie(spark, rows):
    assert trie_of(spark, rows) == sorted(plain_trie(plain_rebuilt(rows)), key=str)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (1, None, None, None), (1, 2, "a", "b"), (1, 2, "a", "b"), (1, 2, "a", "ab"), (0, 1, "", ""), (0, 2, "u", "é"), (5, 1, "u", "x" * 300_000),
        (6, 1, "u", "x" * 300_000), (6, 1, "u", "x" * 300_000), (11, 1, "u", "only own turn, before the cut"), (-3, 1, "u", "below zero"), (-4, 9, "u", "b"), (2**62, 0, "u", "far"),
    ]
    check_trie(spark, rows)


def test_trie_of_no_rows(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "a", "b")]) == []


def test_trie_of_short_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_KEYS", 7)  # many runs, so that most nodes are told by several
    monkeypatch.setattr(trie, "PIECE_BYTES", 30)
    rng = random.Random(5)
    rows = []
    for c in range(300):
        script = rng.choice("abc")
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 else "assistant", script if rng.random() < 0.7 else rng.choice("xyzé")))
    common_start = [("user", f"step {i}") for i in range(110)]
    for c, length in [(1000, 110), (1001, 110), (1002, 90), (1003, 64), (1004, 65), (1005, 32), (1010, 33), (1015, 110), (1020, 31), (1025, 96)]:
        rows += [(c, i, r, x) for i, (r, x) in enumerate(common_start[:length])]
    rows += [(1005, 40 + i, "user", f"own {i}") for i in range(70)]
    rows += [(2000 + c, i, "u", f"same {i}") for c in range(0, 40, 5) for i in range(3)]
    rng.shuffle(rows)
    check_trie(spark, rows)


def test_numbering_of_a_conversation_over_several_tasks(spark):
    rows = [(5 if i % 3 else i, i // 2, "u", f"t{i % 4}") for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = collections.defaultdict(list)
    for r in trie.numbered(df).collect():
        found[r["conv_id"]].append(r["nth"])
    sizes = collections.Counter(r[0] for r in rows)
    assert {c: sorted(n) for c, n in found.items()} == {c: list(range(1, n + 1)) for c, n in sizes.items()}


# ---- WARC -------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, key string, value int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], PAGE)


def plain_warc(rows):
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r)
    out = []
    for html, group in groups.items():
        raw = html.encode()
        group = sorted(group, key=rank, reverse=True)
        for i, r in enumerate(group):
            again = len(raw) >= 1000 and i > 0
            out.append((r[0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", group[0][0] if again else None))
    return sorted(out, key=str)


def warc_rows():
    big, umlauts = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</p>", "é" * 500
    rows = [(i, f"http://a/{i}", big) for i in range(40)]
    rows += [(None, "http://null/", big), (None, None, "z" * 2000), (7, "http://a/7", big), (7, "http://a/7", big), (7, "u", umlauts), (8, None, umlauts)]
    rows += [(100, "http://b/ \r\nWARC-Type: revisit", "é" * 499), (101, "b", "é" * 499), (102, None, None), (103, "c", ""), (103, "c", ""), (104, "d", "\n"), (105, "e", "\r\n\r\n" * 300)]
    rows += [(200, "long", "<b>" + "word é " * 200_000), (201, "long", "<b>" + "word é " * 200_000)]
    return rows


def test_warc_round_trip(spark):
    rows = warc_rows()
    found = warc.resolve(warc.read(spark, warc.archive(pages_of(spark, rows))))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_warc(rows)


def test_warc_files_hold_each_payload_once(spark):
    """A plain reader that goes by the content lengths alone."""
    rows = warc_rows()
    folder = warc.archive(pages_of(spark, rows), date="2020-01-02T03:04:05Z")
    seen, payloads, targets = [], [], []
    for file in Path(folder.removeprefix("file:")).glob("part-*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            block, data = data[:size], data[size:]
            assert data[:4] == b"\r\n\r\n"
            data = data[4:]
            http, payload = block.split(b"\r\n\r\n", 1)
            seen.append((fields["WARC-Record-ID"], fields["WARC-Type"]))
            assert fields["WARC-Date"] == "2020-01-02T03:04:05Z"
            if fields["WARC-Type"] == "response":
                payloads.append(payload)
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            else:
                assert payload == b"" and int(re.search(rb"Content-Length: (\d+)", http)[1]) >= 1000
                targets.append(fields["WARC-Refers-To"])
    assert len(seen) == len(rows) == len({i for i, _ in seen})
    long = [p for p in payloads if len(p) >= 1000]
    assert len(long) == len(set(long))
    assert set(targets) <= {i for i, kind in seen if kind == "response"}


def test_warc_of_no_pages(spark):
    assert warc.resolve(warc.read(spark, warc.archive(pages_of(spark, [])))).collect() == []


def test_warc_damage_is_an_error(spark, tmp_path):
    folder = warc.archive(pages_of(spark, [(1, "u", "a" * 1500)]))
    file = next(Path(folder.removeprefix("file:")).glob("part-*.gz"))
    whole = next(f for f in Path(folder.removeprefix("file:")).glob("part-*.gz") if gzip.decompress(f.read_bytes()))
    data = gzip.decompress(whole.read_bytes())
    for changed in (data.replace(b"aaaa", b"aaab", 1), data.replace(b"aaaa", b"aaa", 1)):
        bad = tmp_path / f"bad{len(changed)}"
        bad.mkdir()
        (bad / "part-0.txt.gz").write_bytes(gzip.compress(changed))
        with pytest.raises(Exception, match="differs from its digest|another length"):
            warc.resolve(warc.read(spark, str(bad))).collect()
    assert file.exists()


# ---- phrases ----------------------------------------------------------------------------------------------


def plain_counts(docs, longest):
    counts, words = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in range(1, longest + 1):
                counts.update((lang, *ws[i : i + n]) for i in range(len(ws) - n + 1))
    return counts, words


def plain_phrases(docs, top=2000, threshold=10, longest=3):
    counts, words = plain_counts(docs, longest)
    cands = {p: f for p, f in counts.items() if len(p) > 2 and f >= threshold}
    most = collections.Counter()
    for p, f in cands.items():
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                inner = (p[0], *p[i : i + n])
                most[inner] = max(most[inner], f)
    out = collections.defaultdict(list)
    for p, a in cands.items():
        if 100 * most[p] >= 50 * a and most[p]:
            continue
        lang, ws = p[0], p[1:]
        cuts = []
        for k in range(1, len(ws)):
            l, r = counts[lang, *ws[:k]], counts[lang, *ws[k:]]  # noqa: E741
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, words[lang], -score) for lang, rows in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    )


def docs_of(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, w1 string, shard int")


def found_phrases(spark, docs, **options):
    found = phrases.collocations(docs_of(spark, docs), slots=1 << 15, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def some_docs(seed, count=400):
    rng = random.Random(seed)
    words = ["red", "Blue", "é", "日本", "x y", "zé", "one", "two", "three", "four"] + [f"w{i}" for i in range(60)]
    docs = []
    for i in range(count):
        out = []
        for _ in range(rng.randrange(40)):
            out.append(rng.choice(["New York City", "new york", "a  b\tc", "of the", rng.choice(words), rng.choice(words)]))
            out.append(rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        docs.append((i, "".join(out), rng.choice(["en", "en", "fr", None])))
    return docs


@pytest.mark.parametrize("shards", [1, 2, 3, 5])
def test_phrases(spark, shards):
    docs = some_docs(shards)
    assert found_phrases(spark, docs, shards=shards) == plain_phrases(docs)


def test_phrases_longer_and_few(spark):
    docs = some_docs(9) + [(i, "to be or not to be that is", "en") for i in range(30)]
    assert found_phrases(spark, docs, longest=5, top=7, threshold=12) == plain_phrases(docs, 7, 12, 5)


def test_phrases_of_odd_rows(spark):
    docs = [(None, None, None), (1, "", "en"), (2, " \t\n.,", "en"), (3, "x" * 70_000 + " " + "a b " * 60_000, "en"), (3, "A b.a B", None)] + [(4, "same row here", "und")] * 25
    assert found_phrases(spark, docs) == plain_phrases(docs)
    assert found_phrases(spark, []) == [] == found_phrases(spark, [(1, "a b c", "en")])


def test_phrases_with_two_words_of_one_hash(spark, monkeypatch):
    """Under the first salt all words collide in a few hashes; the work starts anew with the next one."""
    real = phrases.Pieces.hashes

    def weak(self, langs, salt):
        h = real(self, langs, salt)
        return h if salt else h & phrases.np.uint64(0x3)

    docs = some_docs(4, 100)
    monkeypatch.setattr(phrases.Pieces, "hashes", weak)
    assert found_phrases(spark, docs) == plain_phrases(docs)


def test_chance_hits_in_the_tables_change_no_count(spark):
    """Tables far too small for the phrases: nearly every one seems to be reached early."""
    docs = some_docs(6)
    found = phrases.collocations(docs_of(spark, docs), slots=64)
    assert sorted(tuple(r) for r in found.collect()) == plain_phrases(docs)
