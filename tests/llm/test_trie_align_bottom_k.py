"""Prefix trie, token alignment and bottom-k near-duplicates against plain versions."""

import hashlib
import os
import random
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from plain import words
from test_plain import vocabulary

from provspark.llm import align, minhash, trie

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import compare  # noqa: E402


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Prefix trie


@pytest.fixture(scope="module")
def talks():
    """Bases and their conversations, ties, nulls and repeated rows, long conversations and one shared by many."""
    r = random.Random(3)
    rows = [(c, r.choice([None, 1, 1, 2, 3, 4]), r.choice([None, "user", "a"]), r.choice([None, "", "x", "éé", "y"]))
            for c in [0, 1, 2, 3, 5, 7, 99, 100, 101, 150, 199, 205, -5, -101, None] for _ in range(r.choice([1, 2, 3, 5, 9, 30]))]
    rows += [(c, k, "user", f"t{k % 7}") for c in (102, 103) for k in range(60)]
    return rows + [row for c in range(1000, 1030) for row in [(c, 1, "u", "hot"), (c, 2, "a", f"p{c % 9}"), (c, 3, "a", f"p{c % 3}")] * 2]


@pytest.mark.parametrize("options", [{}, {"band": 4, "shard": 40, "held": 4}])
def test_trie_equals_suffix_sums_over_lists_of_turns(spark, talks, options):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", talks)
    df = spark.createDataFrame([(*row, 1, "x") for row in talks], "conv_id long, turn int, role string, text string, depth int, id string").repartition(5)
    assert not compare(trie.trie(df, **options), con, trie.SQL)


def test_trie_of_nothing(spark):
    assert not trie.trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect()


def test_spilling_queue_gives_back_in_order():
    r, queue, want = random.Random(1), trie.SpillingQueue(5), defaultdict(list)
    for i in range(3000):
        key = (r.randrange(400), b"k")
        want[key].append((i,))
        queue.push(key, (i,))
    assert len(queue.heap) <= 5 and len(queue.runs) > 100
    for key in sorted(want):
        assert sorted(queue.pop(key)) == want[key]
        assert not list(queue.pop(key))


# Token alignment


def plain_alignment(rows):
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(align.files("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    tables = align.tokenizers(align.files("byte_bpe_50k.json"), None, align.files("piece_bpe_32k.model"))
    found, held = [], Counter()
    for _, text in rows:
        found.append(None)
        if not text:
            continue
        raw = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, tables[1].model.encode(text)
        sides = [[t.bytes[i] for i in ids] for t, ids in zip(tables, (a, b), strict=True)]
        if any(b"".join(side) != raw for side in sides):
            continue
        owner = [[k for k, token in enumerate(side) for _ in token] for side in sides]
        links = list(dict.fromkeys(zip(*owner, strict=True)))
        groups, ga, gb = [], [], []
        for at in range(len(raw)):
            ends = [at + 1 == len(raw) or o[at] != o[at + 1] for o in owner]
            ga += [a[owner[0][at]]] * ends[0]
            gb += [b[owner[1][at]]] * ends[1]
            if all(ends):
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        pairs = [(a[i], b[j]) for i, j in links]
        held.update(set(pairs))
        found[-1] = (len(a), len(b), groups, pairs)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, pairs = f
            out.append((doc_id, na, nb, len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr), {(x, y, n) for (x, y), n in held.items()}


@pytest.mark.parametrize("limit", [align.TABLE, 300, 0])
def test_alignment_equals_plain(spark, small, limit):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(None, rows[0][1]), (5001, None), (5002, ""), (5003, " x ▁ y"), (5004, "<s> <|endoftext|> <0x41> 你好 \U0001f600 текст"), (5005, "▁"), (5006, "a\x00b\r\n\t  c "),
             (5007, "a" * 5000), (5008, "ﬁ é é"), (rows[1][0], rows[1][1]), (5009, "word " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, digest string").repartition(4)
    measures, pairs = align.aligned(df, limit=limit)
    want, counts = plain_alignment(rows)
    assert listed(measures, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == want
    assert {tuple(r) for r in pairs.select("a_id", "b_id", "count").collect()} == counts


def test_alignment_of_nothing(spark):
    measures, pairs = align.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert listed(measures, "doc_id", "n_a", "groups_sha256") == [(1, 0, ""), (2, 0, "")] and not pairs.count()
    assert not align.aligned(spark.createDataFrame([], "doc_id long, text string"))[0].count()


def test_both_encoders_agree_on_latin_texts(spark, small):
    first = align.ByteBpe(align.files("byte_bpe_50k.json"), align.files("byte_bpe_50k.tiktoken"))
    assert first.fast
    for r in spark.read.parquet(f"{small}/documents.parquet").where("text <> ''").select("text").limit(50).collect():
        assert first.fast.encode_ordinary(" " + r[0]) == first.slow.encode(" " + r[0], add_special_tokens=False).ids


# Bottom-k near-duplicates


def plain_components(rows, width):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 5 * min(len(s), len(sets[j])) >= 4 * max(len(s), len(sets[j])) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = min(least[root(i)], default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_bottom_k_equals_all_pairs(spark, block):
    r = random.Random(11)
    v = vocabulary(400)
    base = [r.choice(v) for _ in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 40)):
            w[r.randrange(len(w))] = r.choice(v)
        rows.append((1000 + i, " ".join(w)))
    for i in range(120):
        n = r.randint(2, 80)
        w = base[:n]
        for _ in range(r.randint(0, n // 8 + 1)):
            w[r.randrange(len(w))] = r.choice(v)
        rows.append((2000 + i, "\n".join(w)))
    passage = [r.choice(v) for _ in range(60)]
    rows += [(3000 + i, " ".join([r.choice(v) for _ in range(25)] + passage)) for i in range(25)]
    rows += [(4000 + i, " ".join(r.choice(v) for _ in range(r.randint(1, 90)))) for i in range(40)]
    rows += [(None, rows[3][1]), (None, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9003, "b c d"), (None, "zz yy"), (9005, rows[7][1].upper()), rows[9], (9006, " ".join(r.choice(v) for _ in range(20_000)))]
    df = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], "doc_id long, text string, n int, sid string, v int").repartition(5)
    assert listed(minhash.near_duplicates(df, block=block), "doc_id", "n_shingles", "component_id", "kept") == plain_components(rows, 2)


def test_bottom_k_of_nothing(spark):
    assert not minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect()
    assert listed(minhash.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")), "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True)]


def test_union_sketch_lets_linked_sets_pass():
    import numpy as np

    r = np.random.default_rng(4)
    for n in (5, 40, 63, 64, 65, 80, 300, 4000):
        for _ in range(40):
            shared = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            more = [np.unique(r.integers(0, 1 << 63, int(len(shared) * x) + 1, dtype=np.uint64))[:int(len(shared) * x)] for x in (0.12, 0.13)]
            s, t = (np.union1d(shared, m) for m in more)
            table = np.full((1, minhash.K), np.iinfo(np.uint64).max, np.uint64)
            table[0, :min(minhash.K, len(t))] = t[:minhash.K]
            assert minhash.may_link(len(s), s[:minhash.K], np.array([len(t)]), table)[0] or not minhash.linked(s, t)
            sketches = [u[:minhash.K] for u in (s, t)]
            bits = minhash.bitmaps(np.concatenate(sketches), np.cumsum([0, *map(len, sketches)])).view(np.uint64)
            assert minhash.may_share(len(s), bits[0], np.array([len(t)]), bits[1:])[0] or not minhash.linked(s, t)
