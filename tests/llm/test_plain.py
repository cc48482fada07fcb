"""Operators against plain versions on small tables, with nulls, empty and long texts, ties and repeated rows."""

import random
import re
from collections import Counter

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provspark.llm import html, jaccard, leaks, mixing, neighbours, pieces, pii, quality, secrets, shards
from provspark.llm.common import among, apart

SCHEMA = "doc_id long, text string, score double, sid string, blob int, rank int, pii string, secrets string, linked boolean"


def make(spark, docs):
    """Documents with extra columns that carry names the operators use themselves."""
    return spark.createDataFrame([(d, t, 0.5, "x", 1, 2, "p", "s", True) for d, t in docs], SCHEMA)


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Prose, exact and near copies in chains, shared passages, tiny and empty texts, one long text."""
    r = random.Random(5)
    v = vocabulary(300)
    fresh = lambda n: [r.choice(v) for _ in range(n)]
    docs = [" ".join(fresh(r.randint(1, 120))) for _ in range(60)]
    base = fresh(150)
    for k in range(40):
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = r.choice(v)
        docs.append(" ".join(w))
    chain = fresh(80)
    for _ in range(12):
        chain = chain[6:] + fresh(6)
        docs.append("\n".join(chain))
    passage = fresh(60)
    docs += [" ".join(fresh(20) + passage + fresh(r.randint(5, 90))) for _ in range(25)]
    docs += [docs[0]] * 5 + [docs[3].upper()] * 2 + ["", None, " \n\t ", "one", "One", "a b c d", "a b c d e", None, "", "é " * 30]
    docs.append(" ".join(fresh(20_000)))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(docs)]
    return rows + [rows[2], rows[2], (None, docs[61]), (None, None), (rows[4][0], docs[62])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts).repartition(5).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, texts):
    got = sorted(jaccard.near_duplicates(docs).collect(), key=str)
    want = sorted(((d, *c) for (d, _), c in zip(texts, plain.near_duplicates(texts))), key=str)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_one_of_each(docs, texts):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    # Components over row numbers, as ids repeat or are null.
    part = [c for _, c in plain.near_duplicates([(i, t) for i, (_, t) in enumerate(texts)])]
    least, of_text = {}, {}
    for i, (d, t) in enumerate(texts):
        if plain.words(t):
            least[part[i]] = min(least.get(part[i], (True, 0)), (d is None, d or 0))
            of_text[t] = part[i]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    worded = [(d, t) for d, t in got if plain.words(t)]
    assert sorted((of_text[t], (d is None, d or 0)) for d, t in worded) == sorted(least.items())
    assert Counter(x for x in got if not plain.words(x[1])) == Counter(x for x in texts if not plain.words(x[1]))


def test_one_of_each_loses_no_text_of_a_repeated_id(spark):
    a, b = ("alpha beta gamma delta epsilon zeta " * 3).strip(), "quite another text of its own with enough words"
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, "a third text that nobody else has at all"), (None, "a third text that nobody else has at all"), (5, None), (5, None)]
    got = jaccard.one_of_each(make(spark, rows)).select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (2, b), (None, rows[5][1]), (5, None), (5, None)])


def test_shared_shingles_take_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 10, True), (2, 10, False), (3, 12, True)], "h long, s64 long, core boolean")
    assert sorted(tuple(r[c] for c in ("h", "s64", "core")) for r in jaccard._met(rows).collect()) == [(1, 10, True), (1, 11, False)]
    assert jaccard._met(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_signature_bounds_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, m = r.integers(1, 300, 2)
        pool = r.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        x, y = jaccard.signature(a), jaccard.signature(b)
        width = min(len(x), len(y))
        differ = np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum(dtype=np.int64)
        common = len(np.intersect1d(a, b))
        assert (len(a) + len(b) - differ) // 2 >= common
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert jaccard.may_link(len(a), len(b), differ) >= 0


@pytest.mark.parametrize("size", range(5, 21))
def test_masks_hit_every_pattern_of_replacements(size):
    from itertools import combinations

    for gone in combinations(range(size), size // 5):
        assert any(all(p + o not in gone for o in mask) for mask in leaks.MASKS for p in range(size - mask[-1]))


def test_leaks(spark):
    r = random.Random(9)
    v = vocabulary(400, 3)
    items = [(i, " ".join(r.choice(v) for _ in range(n))) for i, n in enumerate((5, 7, 12, 15, 20, 33, 60, 3))] + [(8, None), (9, ""), (None, None), (3, None)]
    docs = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 90)))) for i in range(40)]
    for i in range(60):
        w = items[i % 8][1].split()
        for _ in range(r.randint(0, max(1, len(w) // 4))):
            w[r.randrange(len(w))] = r.choice(v)
        docs.append((100 + i, " ".join([r.choice(v) for _ in range(r.randint(0, 30))] + [x.title() + r.choice(["", ",", "."]) for x in w] + [r.choice(v)])))
    docs += [(500, None), (501, ""), (None, items[5][1]), docs[45], docs[45], (502, (items[4][1] + " ") * 300)]
    table = make(spark, docs).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = leaks.leaks(table, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == plain.leaks(docs, [i for i in items if i[0] is not None])
    assert got.groupBy("doc_id", "item_id").count().where("count > 1").count() == 0
    kept = leaks.without_leaks(table, bench)
    assert kept.columns == table.columns and kept.where("doc_id = 500").count() == 1 and kept.where("doc_id = 502").count() == 0
    assert leaks.leaks(table.limit(0), bench).count() == 0 and leaks.leaks(table, bench.limit(0)).count() == 0


TRICKY = [
    "token = \"abc\" token: abcdef password=token: abcdefgh API_KEY='k-e_y.1=' apikey=12345 Secret:=x secret : zzzzzz",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAAKIA" + "C" * 16, "0123456789abcdef01234567" + "g" + "f" * 23 + "é" + "a" * 40,
    "ghp_" + "a1" * 20 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY----- 😀 token=abcdef", None, "", "=" * 50, "token=" * 3,
    "a@b.com%c@d.com x.y@z @q.com a@b..c a@-.- é@b.fr n@m.co.uk. a@b", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.255 1.2.3 99999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111 0000 0000 0000 00", "+1 (622) 555-2885 +12 34 +1-800.555.1234x +123456789012345678 ++33 1 23 45 67 89",
    "1 " * 3000, "1.1." * 2000 + "@a.b" * 300, "a." * 3000 + "@b.c", "+1" + "0" * 5000,
]


def test_secrets(spark):
    docs = [(i, t) for i, t in enumerate(TRICKY)] + [(3, TRICKY[3]), (None, TRICKY[0])]
    got = secrets.digest(secrets.secrets_of(make(spark, docs).repartition(3))).collect()
    want = [(d, *plain.spans(t, plain.SECRETS)[:2]) for d, t in docs]
    assert sorted(map(str, ((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in got))) == sorted(map(str, want))
    spans = next(r.spans for r in got if r.doc_id == 3)
    assert {x.split(":")[0] for x in spans.split(",")} == {"assign", "hex", "github", "slack", "pem"}


def test_ledger_scans_each_pair_once(spark):
    first = make(spark, [(1, TRICKY[0]), (2, TRICKY[0]), (3, "clean")])
    ledger = secrets.scan(secrets.pending_blobs(first))
    assert ledger.count() == 2 * len(secrets.RULES)
    later = make(spark, [(1, TRICKY[0]), (4, TRICKY[1])])
    assert secrets.pending_blobs(later, ledger=ledger).count() == 1
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{30,}", (), base=True))
    pending = secrets.scan(secrets.pending_blobs(later, ledger=ledger, rules=newer), newer)
    assert {(r.rule, r.version) for r in pending.collect()} == {("assign", 1), ("access", 1), ("hex", 2)}
    assert pending.where("rule = 'assign'").count() == 1  # of the new blob only
    both = secrets.secrets_of(later, ledger=ledger).collect()
    alone = secrets.secrets_of(later).collect()
    assert sorted(map(str, both)) == sorted(map(str, alone))


def test_personal_data(spark):
    docs = [(i, t) for i, t in enumerate(TRICKY)] + [(8, TRICKY[8]), (None, TRICKY[11])]
    found = pii.personal_data(make(spark, docs).repartition(3), pii.Trees(0.0, (), float("inf")))
    got = pii.digest(found).collect()
    want = [(d, *plain.spans(t, plain.PERSONAL)) for d, t in docs]
    assert sorted(map(str, ((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) for r in got))) == sorted(map(str, want))


def test_trees_add_spans_and_redaction_keeps_the_rest(spark, small):
    documents = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet")
    model = pii.train(documents)
    docs = [(1, "mail bob at mail6 dot example dot com or call (622) 555-2885 now"), (2, "the years 1999 2000 2001 and 3.14159 are fine"), (3, None), (4, "é a@b.com 😀 a@b.com"), (5, "")]
    found = pii.personal_data(make(spark, docs), model)
    by = {r.doc_id: r.text for r in pii.redacted(found).collect()}
    assert by == {1: "mail [SPELLED] or call [LOCAL] now", 2: docs[1][1], 3: None, 4: "é [EMAIL] 😀 [EMAIL]", 5: ""}
    x = np.array([[float(i % 7), float(i % 3)] + [0.0] * 10 for i in range(400)])
    y = ((x[:, 0] > 3) & (x[:, 1] < 2)).astype(float)
    trees = pii.fit(x, y)
    assert ((trees.score(x) >= trees.threshold) == (y == 1)).mean() > 0.95
    rows = spark.createDataFrame([(r.tolist(),) for r in x[:50]], "f array<double>")
    assert np.allclose([r.s for r in rows.select(trees.column(F.col("f")).alias("s")).collect()], trees.score(x[:50]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a0.@-+ 1é()", max_size=40))
def test_base_patterns_agree_with_their_plain_forms(text):
    """The patterns used differ from the plain ones to stay linear; the matches must not."""
    mark = pii.MARK
    dotted = re.sub(r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", mark, text)
    plain_email = [m.span() for m in re.finditer(plain.PERSONAL[0][1], text)]
    fast = [m.span() for m in re.finditer(rf"[A-Za-z0-9._%+{mark}-]+@[A-Za-z0-9-]+{mark}[A-Za-z0-9{mark}-]+", dotted)]
    assert plain_email == fast
    joined = re.sub(r"(?<=[0-9])[\x20-](?=[0-9])", mark, text)
    assert [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if len(m[0]) > 13] == [m.span() for m in re.finditer(rf"[0-9{mark}]{{14,}}", joined)]


def test_unigram_base_and_mixing(docs, texts):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in mixing.scored(docs).collect()), key=str)
    want = sorted(((d, a, b, c, round(s, 6), plain.crc(d) % 7 == 2) for (d, _), (a, b, c, s) in zip(texts, plain.unigram(texts))), key=str)
    assert got == want


def test_mixing_is_a_distribution_and_learns(spark, small):
    rng = np.random.default_rng(0)
    model = mixing.Model.of([rng.normal(0, 2, 1 << s).astype(np.float32) for s in mixing.SLOTS], rng.integers(0, 8, 1 << mixing.SLOTS[-1]).astype(np.int8))
    context, word = mixing.grams(np.frombuffer(b"the cat", np.uint8), np.array([7]))
    every = (context[-1] & ~np.int64(255)) | np.arange(256)
    assert abs(np.exp(model.nats(every, np.full(256, word[-1]))).sum() - 1) < 1e-6
    rows = mixing.scored(spark.read.parquet(f"{small}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("n_bytes")).first()
    assert -rows[0] * 3.3219 / rows[1] < 4.5  # bits a byte; eight without learning


def test_mixing_counts_the_texts_its_weights_learn_from(spark):
    """A word of the end of a long text that only the weights learn from is known to the tables."""
    r = random.Random(3)
    fresh = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    used = [i for i in range(20_000) if plain.crc(i) % mixing.FOLDS != mixing.HELD]
    apart = [i for i in used if plain.crc(i) % mixing.DEV == 0][:3]
    rest = [i for i in used if plain.crc(i) % mixing.DEV][:60]
    held = [i for i in range(20_000) if plain.crc(i) % mixing.FOLDS == mixing.HELD][:2]
    rare = "ZQXWVKY-" * 4
    rows = [(i, fresh(9_000) + " ".join([rare] * 20)) for i in apart] + [(i, fresh(300)) for i in rest] + [(held[0], " ".join([rare] * 3)), (held[1], "RLOPMNTU-" * 10)]
    bits = {x.doc_id: x.bits_per_byte for x in mixing.scored(make(spark, rows)).collect()}
    assert bits[held[0]] < 3 < bits[held[1]]


def test_mixing_weights_learn_from_every_text(spark):
    """Sums over the parts of a table equal those over all of its texts, whatever their number."""
    rng = np.random.default_rng(1)
    tables = [rng.normal(0, 2, 1 << s).astype(np.float32) for s in mixing.SLOTS], rng.integers(0, 8, 1 << mixing.SLOTS[-1]).astype(np.int8)
    lines = [f"{i} some words {i * i % 97} " * 3 for i in range(700)]
    parts, plainly = mixing.Model.of(*tables), mixing.Model.of(*tables)
    mixing.fit(spark.createDataFrame([(t,) for t in lines], "text string").repartition(5), parts)
    keys, words = mixing.grams(*mixing.byte_stream(lines))
    for _ in range(mixing.WEIGHT_ROUNDS):
        plainly.step_weights(plainly.weight_sums(keys, words, np.ones(len(keys), int)))
    for _ in range(mixing.REFINE_ROUNDS):
        plainly.step_refine(plainly.refine_sums(keys, words, np.ones(len(keys), int)))
    assert np.allclose(parts.weights, plainly.weights, atol=1e-3) and np.allclose(parts.refine, plainly.refine, atol=1e-3)


def test_mixing_fits_every_training_text_apart_from_its_own_counts(spark, monkeypatch):
    """Both halves are fitted, each with the tables that count the other one; held-out texts with none."""
    rows = [(i, f"text {chr(0x4E00 + i)} of its own") for i in range(300)]
    seen = []

    def fit(texts, model, *others):
        for part, lm in ((texts, model), *others):
            got = [r.text for r in part.collect()]
            codes, words = mixing.grams(*mixing.byte_stream(got))
            known = [lm.odds[3][mixing.slots(mixing.contexts(codes, words)[3], mixing.spread(node), 3)] for _, node, _ in mixing.decisions(codes)]
            seen.append((got, float(np.mean(np.stack(known) != 0))))

    monkeypatch.setattr(mixing, "fit", fit)
    mixing.scored(make(spark, rows))
    assert sorted(t for part, _ in seen for t in part) == sorted(t for i, t in rows if plain.crc(i) % mixing.FOLDS != mixing.HELD)
    assert len(seen) == 2 and all(0.3 < share < 0.95 for _, share in seen)


def test_mixing_adds_up_equal_grams_of_all_texts(spark, monkeypatch):
    """Each distinct gram of a half once, with the times it occurs in all texts of the half, whatever a task holds at once."""
    lines = [(f"{i % 40} some words {i * i % 97} é ", i % 3 == 0) for i in range(400)]
    rows = spark.createDataFrame(lines, "text string, first boolean").repartition(4)
    got = mixing.added_up(rows.mapInArrow(mixing._gather, mixing.GATHERED)).collect()
    want = Counter()
    for t, first in lines:
        keys, words = mixing.grams(*mixing.byte_stream([t]))
        want.update((first, k, w) for k, w in zip(keys.tolist(), words.view(np.int64).tolist()))
    assert {(r.first, r.key, r.word): r.times for r in got} == dict(want) and len(got) == len(want)
    monkeypatch.setattr(mixing, "HELD_GRAMS", 90)
    some, key = mixing.Grams(), np.arange(50)
    some.add(key, np.zeros(50, np.uint64), np.ones(50, int))
    some.add(key[::-1], np.zeros(50, np.uint64), np.full(50, 1 << 40))
    key, _, times = some.summed()
    assert key.tolist() == list(range(50)) and set(times.tolist()) == {(1 << 40) + 1}
    word = np.arange(3).astype(np.uint64) << np.uint64(62)
    assert all((a == b).all() for a, b in zip(mixing.unpacked_grams(mixing.packed_grams(key[:3], word, times[:3])), (key[:3], word, times[:3])))


def test_mixing_counts_more_than_four_bytes_hold():
    slot, zeros, ones = np.array([0, 8191]), np.array([1 << 40, 2]), np.array([3, 1 << 33])
    assert all((a == b).all() for a, b in zip(mixing.unpacked(mixing.packed(slot, zeros, ones)), (slot, zeros, ones)))


def test_mixing_long_and_empty(spark, nothing):
    assert mixing.scored(nothing).count() == 0
    rows = mixing.scored(make(spark, [(2, "x" * 200_000), (None, None), (2, "")])).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2] and all(r.score <= 0 for r in rows)


def brute_nearest(rows, k=5):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, a in good:
        if q % 50 == 0:
            s = {}
            for i, b in good:
                if i != q:
                    s[i] = max(s.get(i, -2.0), float(a @ b / np.sqrt((a @ a) * (b @ b))))
            out[q] = sorted(((round(-x, 9), i) for i, x in s.items()))[:k]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(i, rows[50][1]) for i in range(200, 230)] + [(300, None), (350, [0.0] * 4), (400, [1.0, float("nan"), 0.0, 0.0]), (450, [1.0, None, 0.0, 0.0]), (500, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[1][1]), (3, rows[3][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, rep int").repartition(3)
    got = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
    assert got == brute_nearest(rows)
    assert neighbours.nearest(table.limit(0)).count() == 0
    two = neighbours.nearest(table.where("vec_id in (50, 7)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(50, 1, 7)]


def test_scaled_copies_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(0)
    rows = [(1000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    base = rows[3][1]
    rows += [(50, base)] + [(i, [x * 2.0 ** (i % 9 - 4) for x in base]) for i in range(1, 59) if i != 50]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(table).where("query_id = 50").orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(i, 1.0) for i in range(1, 6)]


def test_recall(spark, small):
    table = spark.read.parquet(f"{small[:-5]}0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute_nearest(rows)
    hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in neighbours.nearest(table).collect())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_shards_are_even_and_keep_groups(docs, texts, nothing):
    rows = shards.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    import zlib

    want = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t in texts)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shards.shard_documents(nothing).count() == 0


def test_shards_pull_copies_together(spark):
    many = [(i, f"text {i // 4}") for i in range(1600)]
    rows = shards.shard_documents(make(spark, many)).collect()
    cut = {}
    for r in rows:
        cut.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert sum(len(s) for s in cut.values()) < 1.4 * len(cut)
    hot = shards.shard_documents(make(spark, [(i, "same") for i in range(800)] + many[:800])).groupBy("shard").count().collect()
    assert {r["count"] for r in hot} == {100}


def test_shards_hold_large_groups_together(spark):
    """A group of a third of all rows, of 1 % and of a tenth to two fifths of a shard, beside pairs and single rows."""
    third, parts = 10_667, {"2 %": 40, "10 %": 200, "1 % of all": 320, "20 %": 400, "40 %": 800, "5 %": 100}
    docs = ["third"] * third + [k for k, n in parts.items() for _ in range(n)] + [f"pair {i // 2}" for i in range(6000)]
    docs += [f"alone {i}" for i in range(32_000 - len(docs))]
    rows = shards.shard_documents(make(spark, list(enumerate(docs)))).select("doc_id", "shard").collect()
    on = {}
    for r in rows:
        on.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert len(on["third"]) == 6
    assert {k: len(on[k]) for k in parts} == dict.fromkeys(parts, 1)
    pairs = [len(s) for t, s in on.items() if t.startswith("pair")]
    assert sum(pairs) == len(pairs)
    counts = Counter(r.shard for r in rows)
    assert set(counts.values()) == {2000} and len(counts) == 16


def test_shards_without_single_rows_keep_groups(spark):
    """No row is free to give way: shards exchange parts of their wishes."""
    rows = shards.shard_documents(make(spark, [(i, f"text {i // 4}") for i in range(32_000)])).select("doc_id", "shard").collect()
    on = {}
    for r in rows:
        on.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert sum(map(len, on.values())) < 1.1 * len(on)
    assert set(Counter(r.shard for r in rows).values()) == {2000}


def test_quality_holds_out_and_ranks(spark, small):
    big = small[:-5] + "0.01"
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(documents, labels)
    rows = quality.scored(documents.withColumn("score", F.lit("clash")), model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("score", "predicted", "quality").collect()
    good = [r.score for r in rows if r.quality == 1]
    assert np.mean([[a > b for a in good] for b in (r.score for r in rows if r.quality == 0)]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_quality_edges(spark, nothing, docs):
    empty = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.scored(docs, empty).select("score").collect()} == {0.5}
    labels = spark.createDataFrame([(7, 0), (7, 1), (14, None), (None, 1), (21, 1)], "doc_id long, quality int")
    assert quality.scored(docs, quality.train(docs, labels)).where("score between 0 and 1").count() == docs.count()
    assert quality.scored(nothing, empty).count() == 0
    assert quality.kept(docs, labels).columns == docs.columns


def test_quality_minimises_the_loss_of_all_pairs(spark):
    """More pairs than were ever drawn; the gradient over all of them, listed, is nothing at the fitted weights."""
    rng = np.random.default_rng(5)
    y = (rng.random(900) < 0.6).astype(int)
    x = rng.normal(0, 1, (900, quality.WIDTH)) * (np.arange(quality.WIDTH) % 5) + 0.7 * y[:, None] * (np.arange(quality.WIDTH) % 3 == 0)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "quality int, x array<double>")
    model = quality.fit(rows.repartition(5))
    assert np.allclose(model.mean, x.mean(0), atol=1e-5) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-5)
    z, s = (x - model.mean) / model.scale, model.strength(x)
    p = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
    gradient = (p.mean(0) @ z[y == 0]) / (y == 0).sum() - (p.mean(1) @ z[y == 1]) / (y == 1).sum() + quality.DECAY * model.weights
    assert np.abs(gradient).max() < 1e-3 < np.abs(z[y == 0].mean(0) - z[y == 1].mean(0)).max() / 2
    share = (y == 0).mean()
    least = min(((s >= c) != (y == 1)).sum() for c in np.quantile(s, np.clip(share * np.linspace(0.7, 1.3, 121), 0, 1)))
    assert ((s >= model.cut) != (y == 1)).sum() <= least + 1 and abs(model.spread - s.std()) < 1e-3
    again = quality.fit(rows.repartition(2))
    assert (model.weights == again.weights).all() and model.cut == again.cut


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    rows = [(i, f"{i} words") for i in range(26_000)]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda got: seen.append(got.count()))
    quality.train(make(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    assert seen == [sum(plain.crc(i) % quality.FOLDS != 0 for i, _ in rows)] and seen[0] > 20_000


def test_quality_fits_parts_of_one_label(spark):
    """Parts of the table may hold rows of one label only, or none; the weights stay the same."""
    rng = np.random.default_rng(6)
    y = np.sort((rng.random(300) < 0.6).astype(int))
    x = rng.normal(0, 1, (300, quality.WIDTH)) + y[:, None] * (np.arange(quality.WIDTH) % 3 == 0)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "quality int, x array<double>")
    apart, mixed = quality.fit(rows.repartition(9, "quality")), quality.fit(rows.coalesce(1))
    assert (apart.weights == mixed.weights).all() and apart.cut == mixed.cut and apart.weights.any()


def test_quality_shuffles_figures_and_no_texts(spark, docs, monkeypatch):
    """Texts become figures before they meet the labels, by the same join for few labels as for many."""
    plans = []
    monkeypatch.setattr(quality.Scratch, "put", lambda self, df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df)
    quality.train(docs, spark.createDataFrame([(7, 0), (14, 1), (21, 1)], "doc_id long, quality int"))
    assert 0 <= plans[0].index("SortMergeJoin") < plans[0].index("MapInArrow")


def test_decoding_holds_few_rows_as_python_numbers():
    import tracemalloc

    import pyarrow as pa

    class Held:
        value = pieces.model_bytes()

    ids = pa.array(np.tile(np.arange(1000, 2000), 4000), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4_000_001, 1000), pa.int32()), ids)
    run = pieces._decoded(Held, 0, "text")
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([lists], ["piece_ids"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 20_000_000  # all ids as Python numbers: more than 100 MB


def test_pieces_round_trip_and_differ(docs, texts):
    model = pieces.model_bytes()
    rows = pieces.sampled(docs, model, 3, keep=("doc_id", "rank", "score"))
    back = pieces.decoded(rows, model).collect()
    assert {r.text for r in back} == {t or "" for _, t in texts}
    per = {}
    for r in back:
        per.setdefault((r.doc_id, r.text), []).append((r["sample"], tuple(r.piece_ids)))
        assert 0 <= r.inclusion <= 1 + 1e-12 and r.n_pieces == len(r.piece_ids) and r.rank == 2
    copies = {}
    for d, t in texts:
        copies[(d, t or "")] = copies.get((d, t or ""), 0) + 1
    for k, v in per.items():
        assert len(set(v)) * copies[k] == len(v)  # repeated rows get equal rows
        assert len({ids for _, ids in v}) == len(set(v))
    again = pieces.sampled(docs.repartition(2), model, 3, keep=("doc_id",)).collect()
    assert sorted((str(r.doc_id), r["sample"], tuple(r.piece_ids)) for r in again) == sorted((str(r.doc_id), r["sample"], tuple(r.piece_ids)) for r in back)


def test_pieces_follow_their_distribution():
    vocab = pieces.Vocabulary(pieces.model_bytes())
    n = 30_000
    got = pieces.Sampler(vocab).run(["theb"] * n, np.arange(n) * 7919, 2)
    ends = np.cumsum(got["sizes"])
    path = [tuple(got["ids"][b - s:b]) for b, s in zip(ends, got["sizes"])]
    p = {a: float(np.exp(x)) for a, x in zip(path, got["log"])}
    assert abs(sum(p.values()) - 1) < 1e-3
    first = {t: a for t, r, a in zip(got["text"], got["rank"], path) if r == 1}
    for a in sorted(p, key=p.get)[-3:]:
        assert abs(sum(x == a for x in first.values()) / n - p[a]) < 0.01
    pairs = {}
    for t, r, a in zip(got["text"], got["rank"], path):
        if r == 2:
            pairs[(first[t], a)] = pairs.get((first[t], a), 0) + 1
    for (a, b), c in pairs.items():
        assert abs(c / n - p[a] * p[b] / (1 - p[a])) < 0.01


def article(page):
    a = re.search(r"<article>(.*)</article>", page, re.S)[1]
    import html as references

    return " ".join(references.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())


def test_html(spark, small):
    table = spark.read.parquet(f"{small[:-5]}0.01/pages.parquet")
    model = html.train(table)
    rows = html.extracted(table, model).join(table.select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    assert sum(r.text == article(r.html) for r in rows) >= 245
    assert all(r.n_chars == len(r.text) for r in rows)
    p = [re.findall(r"<p>([^<]{80,})</p>", r.html) for r in rows]
    p = [x for q in p for x in q][:6]
    page = f"""<body><header class=top><p>{p[0]}</p></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article class=post><h1>Head &amp; more</h1>
      <p>{p[1]}<p>{p[2]}</p><script>var x = "<p>no</p>";</script><style>p {{}}</style></article></main><section id=comments><p>{p[3]}</p></section><aside><p>{p[4]}</p></aside>
      <form><label>Mail</label><textarea>t</textarea></form><footer>&copy; {p[5][:40]}</footer></body>"""
    edge = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<", 1), (5, "u", "<p>" * 3000 + "x &amp;   y <foo", 1), (6, "u", "<!-- <p>gone</p>", 1), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = html.extracted(edge, model).collect()
    import html as references

    assert [r.text for r in got if r.page_id == 1] == [" ".join(["Head & more", references.unescape(p[1]), references.unescape(p[2])])] * 2
    assert {r.page_id: r.n_chars for r in got if r.page_id in (2, 3, 6)} == {2: 0, 3: 0, 6: 0}
    assert html.extracted(edge.limit(0), model).count() == 0
    assert " ".join(b.text for b in html.blocks("<p>" * 3000 + "x &amp;   y <foo")) == "x & y"


def test_deep_and_long_pages_are_cut_in_linear_time():
    import time

    begin = time.time()
    deep = html.blocks("<div class='box x'>w" * 20_000)
    x = html.vectors(deep)
    assert len(deep) == 20_000 and len(x) == 20_000
    long = html.blocks("<main>" + "<p>some words</p></b>" * 50_000)
    assert len(long) == 50_000 and time.time() - begin < 60
    assert html.taught(long).all() and html.taught(deep) is None
    few = html.blocks("<article><div class='a b'><ul class=c><li class=d>x")
    tokens = ["article", "div", ".a", ".b", "ul", ".c", "li", ".d"]
    want = np.zeros(html.PATH)
    for k, t in enumerate(reversed(tokens)):
        want[html._bucket(t, html.PATH)] += 1.0 if k < 6 else 0.6
    assert np.allclose(html.vectors(few)[0, :html.PATH], want, atol=1e-5)


def test_batches_of_pages_hold_a_bounded_number_of_blocks():
    sizes = [1] * 100 + [300] * 10 + [50_000]
    groups = list(html.like_length(list(range(len(sizes))), sizes))
    assert [i for g in groups for i in g] == list(range(len(sizes)))
    assert all(len(g) == 1 or len(g) <= 64 and len(g) * max(sizes[i] for i in g) <= 20_000 for g in groups) and groups[-1] == [110]


def test_redaction_of_very_many_overlapping_spans(spark):
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + i % 26) if i % 50 else "é" for i in range(60_000))
    starts = np.sort(rng.choice(59_000, 3000, replace=False))
    spans = [(int(a), int(a + rng.integers(1, 60))) for a in starts]
    kinds = (*pii.BASE, *pii.EXTRA)
    held = {k: [spans[i] for i in range(len(spans)) if i % len(kinds) == j] for j, k in enumerate(kinds)}
    fields = ", ".join(f"{k}: array<struct<start: bigint, end: bigint>>" for k in kinds)
    df = spark.createDataFrame([(1, text, tuple(held[k] for k in kinds)), (2, "plain", tuple([] for _ in kinds))], f"doc_id long, text string, pii struct<{fields}>")
    out, at = [], 0
    for a, b, k in sorted((a, b, k.upper()) for k in kinds for a, b in held[k]):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    want = {1: "".join(out) + text[at:], 2: "plain"}
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()} == want


def test_segmentations_of_the_whole_table_give_its_texts_back(spark):
    from provspark.llm.queries import QUERIES

    rows = QUERIES["op7_gumbel_pieces"](spark, "/root/testdata/sf0.001").select("sample", "gives_text_back").collect()
    assert {r.sample for r in rows} == {1, 2} and all(r.gives_text_back for r in rows)


def test_sampling_and_decoding_in_one_worker_equal_both_apart(spark, docs):
    model = pieces.model_bytes()
    got = pieces.sampled_and_decoded(docs, model)
    apart_ = pieces.decoded(pieces.sampled(docs, model, keep=("doc_id", "text")), model, out="decoded")
    apart_ = apart_.withColumn("gives_text_back", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("text", "decoded")
    assert got.schema == apart_.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, apart_.collect()))
    steps = [r.count("MapInArrow") for r in (x._jdf.queryExecution().optimizedPlan().toString() for x in (got, apart_))]
    assert steps == [1, 2]
    assert "text" not in got.columns and pieces.sampled_and_decoded(docs, model, keep=("text", "doc_id")).columns[:2] == ["doc_id", "text"]


@given(st.text(" \n\0\tab\u3000", max_size=14))
def test_units_of_a_text_are_those_of_the_pattern(text):
    assert pieces.units_of(text) == (pieces.UNIT.findall(" " + text) if text else [])


def test_lattices_that_are_cleared_write_their_arrays_again():
    sampler = pieces.Sampler(pieces.vocabulary(pieces.model_bytes()))
    key = np.arange(3)
    first = sampler.run(["the cat", "sat\non the mat", "\u4e00 x"], key, 2)
    before = sampler.lattices.key.data
    sampler.lattices.clear()
    sampler.run(["other words", "than these", None], key, 2)
    sampler.lattices.clear()
    again = sampler.run(["the cat", "sat\non the mat", "\u4e00 x"], key, 2)
    assert sampler.lattices.key.data is before and all((first[x] == again[x]).all() for x in ("text", "rank", "sizes", "ids"))


def test_mixing_keeps_scores_of_grams_and_gives_those_of_the_model(monkeypatch):
    rng = np.random.default_rng(5)
    model = mixing.Model.of([rng.normal(0, 2, 1 << s).astype(np.float32) for s in mixing.SLOTS], rng.integers(0, 8, 1 << mixing.SLOTS[-1]).astype(np.int8))
    key, word = mixing.grams(*mixing.byte_stream([f"the words {i % 70} of text {i % 9}" for i in range(300)]))
    _, key, word = mixing.distinct(key, word)
    for places in (3, 19):
        monkeypatch.setattr(mixing, "KNOWN", places)
        known, worked = mixing.Known(model), []
        for _ in range(30):
            some = rng.permutation(len(key))[:len(key) // 2]
            assert (known.nats(key[some], word[some]) == model.nats(key[some], word[some])).all()
        monkeypatch.setattr(model, "nats", lambda k, w: worked.append(len(k)) or np.zeros(len(k)))
        known.nats(key, word)
        monkeypatch.undo()
        assert sum(worked) < len(key) / 4 if places == 19 else sum(worked) > len(key) / 2
    assert len(mixing.Known(model).nats(key[:0], word[:0])) == 0


def test_mixing_driver_holds_no_more_tokens_than_it_may(spark):
    counts = {b"%d" % i: c for i, c in enumerate([9, 9, 9, 5, 5, 5, 5, 2, 1, 1, 1])}
    rows = spark.createDataFrame([(bytearray(t), c) for t, c in counts.items()], "token binary, c long")
    for most, least in ((0, 10), (2, 10), (3, 9), (6, 9), (7, 5), (8, 2), (10, 2), (11, 1), (99, 1)):
        assert mixing.hot_tokens(rows, most) == {t: c for t, c in counts.items() if c >= least}
    assert mixing.hot_tokens(rows.where("c < 0")) == {}


def test_mixing_driver_lets_go_of_tables_that_tasks_have(spark, monkeypatch):
    made = []
    of = mixing.Model.of
    monkeypatch.setattr(mixing.Model, "of", staticmethod(lambda odds, seen: made.append(of(odds, seen)) or made[-1]))
    step, held = mixing.Model.step_weights, []
    monkeypatch.setattr(mixing.Model, "step_weights", lambda self, sums: held.append(sum(len(o) for m in made for o in m.odds)) or step(self, sums))
    model, _ = mixing.train(make(spark, [(i, f"text {i} of some words") for i in range(40)]), mixing.Scratch(spark, "test"))
    assert held == [0] * mixing.WEIGHT_ROUNDS and [len(o) for o in model.odds] == [1 << s for s in mixing.SLOTS]


def test_rows_are_told_apart_without_a_shuffle_of_all(spark):
    rows = make(spark, [(i % 400 or None, f"text {i % 300}") for i in range(2000)] + [(7, None), (None, None)])
    gone = make(spark, [(7, "text 7"), (None, "text 100"), (7, None), (9, "text 9"), (9, "text 9"), (12_345, "text 1")])
    lost = {tuple(r) for r in gone.collect()}
    kept, found = among(rows, gone, ["doc_id", "text"])
    every = [tuple(r) for r in rows.collect()]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in every if r not in lost)
    assert Counter(tuple(r) for r in found.collect()) == Counter(r for r in every if r in lost)
    other, maybe = apart(rows, gone, ["doc_id", "text"])
    plan = other._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and maybe.count() < 100


def test_whole_documents_are_not_shuffled_to_lose_leaks(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(leaks, "leaks", lambda docs, benchmark: make(spark, [(3, ""), (None, "")]).select("doc_id"))
    monkeypatch.setattr(leaks, "among", lambda rows, known, names: seen.append(names) or among(rows, known, names))
    kept = leaks.without_leaks(docs, docs)
    assert seen == [["doc_id"]] and kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(tuple(r) for r in docs.collect() if r.doc_id not in (3, None))


def test_mixing_grams_leave_a_task_added_up_and_small(monkeypatch):
    """Repeated grams do not make a task give up what it holds; shared beginnings and high bytes are written once."""
    import pyarrow as pa

    monkeypatch.setattr(mixing, "TEXT_CHARS", 200)
    monkeypatch.setattr(mixing, "HELD_GRAMS", 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(["the same few words again and again, " * 5] * 200), pa.array([i % 2 == 0 for i in range(200)])], ["text", "first"])
    rows = [r for b in mixing._gather(iter([batch])) for r in b.to_pylist() if r["grams"] is not None]
    assert len(rows) == len({(r["first"], r["grp"]) for r in rows})
    r, v = random.Random(5), vocabulary(3000, 6)
    key, word = mixing.grams(*mixing.byte_stream([" ".join(r.choice(v) for _ in range(20_000))]))
    code, key, word = mixing.distinct(key, word)
    order = np.lexsort((key & 255, word, key >> 8))
    whole = key[order], word[order], np.bincount(code)[order]
    data = mixing.packed_grams(*whole)
    assert len(data) < 10 * len(key) and all((a == b).all() for a, b in zip(mixing.unpacked_grams(data), whole))
    assert [len(x) for x in mixing.unpacked_grams(mixing.packed_grams(*(x[:0] for x in whole)))] == [0, 0, 0]


def test_piece_lookup_and_decoding_take_no_step_per_piece():
    import pyarrow as pa

    model = pieces.model_bytes()
    v = pieces.vocabulary(model)
    assert v is pieces.vocabulary(model)  # made once in a worker
    begun = {}
    for text, i in v.ids.items():
        h = 0
        for c in text:
            h = (h + ord(c) + 1) * pieces.HASH % (1 << 64)
            begun.setdefault(h, -1)
        begun[h] = i
    rng = np.random.default_rng(2)
    hashes = np.concatenate([np.array(list(begun), np.uint64), rng.integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2), np.zeros(1, np.uint64)])
    assert v.lookup(hashes).tolist() == [begun.get(h, -2) for h in hashes.tolist()]
    raw = pieces.raw_pieces(pieces.processor(model))
    ids = [[], None, *(rng.choice(list(v.ids.values()), n).tolist() for n in (1, 2, 900)), v.byte_ids[0xC3:0xC4] + v.byte_ids[0xA9:0xAA] * 1]
    want = [None if x is None else b"".join(raw[i] for i in x).decode()[1:] for x in ids]
    lists = pa.array(ids, pa.list_(pa.int32()))
    for lo in range(len(ids) + 1):
        assert pieces.texts_of(pieces.raw_array(model), lists.slice(lo)) == want[lo:]
