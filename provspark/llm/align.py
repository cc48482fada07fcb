"""Two tokenizers laid over the same texts: groups of tokens that end together, links, and corpus-wide counts of id pairs.

1. Rows are shuffled by their full text; each distinct text is tokenised and aligned once and keeps its multiplicity.
   Both token sequences cover the same bytes, so their ends cut the text into segments; each segment lies in one token
   of either side and is one link. A row keeps its distinct id pairs and how often each occurs.
2. Counts of pairs are summed inside the tasks, weighted by multiplicity, and then by Spark.
3. The best count of each A id (at most as many rows as the vocabulary has) and the counts of at most ``TABLE`` frequent
   pairs go to the tasks; pairs outside that table meet their counts in a join.
4. Measures of distinct texts are joined to the doc_ids by SHA-256 of the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import Scratch, in_chunks, spread_join

#: An id pair is one integer: A's id times SIDE plus B's id.
SIDE = 1 << 15
#: Pairs whose counts are sent to the tasks, at most (12 MB); pairs that a task sums before it hands them on (32 MB).
TABLE, HELD = 1 << 20, 1 << 21
#: Up to this UTF-8 lead byte (below U+0340), all versions of Unicode agree on what is a letter.
SETTLED = 0xCC
TEXT, ALIGNED = "digest binary, n long", "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def files(name: str) -> str:
    """Path of a vocabulary file of the public tokenizers; any other path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """The byte-level BPE of a tokenizers file. Latin texts may go through a faster encoder over the same ranks."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(letters)]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            if all(self.bytes[i] == t for t, i in ranks.items()):
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, raw: bytes) -> list[int]:
        if self.fast and (raw.isascii() or np.frombuffer(raw, np.uint8).max() <= SETTLED):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, a_ranks: str | None, b_path: str) -> tuple[ByteBpe, Pieces]:
    return ByteBpe(a_path, a_ranks), Pieces(b_path)


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to 65535, right-aligned in five bytes with a sixth for what follows, and which of them count."""
    n = np.arange(1 << 16)
    digits = np.stack([n // 10 ** (4 - k) % 10 + 48 for k in range(5)] + [n * 0], axis=1).astype(np.uint8)
    counts = np.stack([n >= 10 ** (4 - k) for k in range(5)] + [n >= 0], axis=1)
    counts[:, 4] = True
    return digits, counts


def align(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, text_ends: np.ndarray):
    """(groups, links, written groups, pair codes of the links) per text; ids and ends of all texts laid end to end."""
    mark = np.zeros(text_ends[-1] + 1, np.uint8)
    mark[a_ends] = 1
    mark[b_ends] += 2
    ends = np.flatnonzero(mark)
    at = mark[ends]
    common = ends[at == 3]
    before = [np.cumsum(at & bit != 0) - (at & bit != 0) for bit in (1, 2)]
    links = a[before[0]] * SIDE + b[before[1]]
    # Tokens by group, A before B; what follows a token: "," inside a side, "|" after the last A, ";" after the last B.
    digits, counts = _digits()
    closes = [mark[a_ends] == 3, mark[b_ends] == 3]
    group = [np.cumsum(c) - c for c in closes]
    sizes = [np.cumsum(np.bincount(g, minlength=len(common))) for g in group]
    places = [np.arange(len(a)) + np.concatenate([[0], sizes[1]])[group[0]], np.arange(len(b)) + sizes[0][group[1]]]
    ids = np.empty(len(a) + len(b), np.int64)
    follows = np.full(len(ids), ord(","), np.uint8)
    for side, (own, place, close) in enumerate(zip((a, b), places, closes, strict=True)):
        ids[place] = own
        follows[place[close]] = b"|;"[side]
    out, used = digits[ids], counts[ids]
    out[:, 5] = follows
    tokens = np.searchsorted(a_ends, text_ends, side="right") + np.searchsorted(b_ends, text_ends, side="right")
    used[tokens - 1, 5] = False
    written = out[used].tobytes()
    cuts = np.concatenate([[0], np.cumsum(used.sum(1))])[np.concatenate([[0], tokens])]
    strings = [written[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    groups = np.diff(np.searchsorted(common, text_ends, side="right"), prepend=0)
    n_links = np.diff(np.searchsorted(ends, text_ends, side="right"), prepend=0)
    return groups, n_links, strings, links


def _aligned(a_path: str, a_ranks: str | None, b_path: str):
    """(text, digest, n) -> ALIGNED; texts that one side does not give back have no tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(a_path, a_ranks, b_path)
        for batch in batches:
            for begin, end, texts in in_chunks(batch, "text"):
                whole = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
                a = [first.encode(" " + t, raw) for t, raw in zip(texts, whole, strict=True)]
                b = second.encode(texts)
                good = [i for i, raw in enumerate(whole) if b"".join(map(first.bytes.__getitem__, a[i])) == raw and b"".join(map(second.bytes.__getitem__, b[i])) == raw]
                n = len(texts)
                columns = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")}
                sha, pairs, times = [""] * n, [[]] * n, [[]] * n
                if good:
                    flat = [np.fromiter(chain.from_iterable(ids[i] for i in good), np.int64) for ids in (a, b)]
                    sizes = [np.array([len(t) for t in side.bytes]) for side in (first, second)]
                    text_ends = np.cumsum([len(whole[i]) for i in good])
                    groups, links, strings, codes = align(flat[0], np.cumsum(sizes[0][flat[0]]), flat[1], np.cumsum(sizes[1][flat[1]]), text_ends)
                    keys = np.repeat(np.arange(len(good)), links) << 32 | codes
                    keys, count = np.unique(keys, return_counts=True)
                    cuts = np.searchsorted(keys, np.arange(len(good) + 1) << 32)
                    codes, count = (keys & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)
                    for k, i in enumerate(good):
                        columns["n_a"][i], columns["n_b"][i], columns["n_groups"][i], columns["n_links"][i] = len(a[i]), len(b[i]), int(groups[k]), int(links[k])
                        sha[i] = hashlib.sha256(strings[k]).hexdigest()
                        pairs[i], times[i] = codes[cuts[k]:cuts[k + 1]], count[cuts[k]:cuts[k + 1]]
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in ("digest", "n")] + [pa.array(v, pa.int64()) for v in columns.values()]
                    + [pa.array(sha, pa.string()), pa.array(pairs, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                    ["digest", "n", *columns, "groups_sha256", "pairs", "times"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pairs, n) -> pair, count: sums of n over the rows of a task, handed on when HELD pairs are held."""
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back, np.concatenate([c for _, c in parts]))
        return pair, total

    parts, fresh, held = [], 0, 0
    for batch in batches:
        lists, n = batch.column(0), batch.column(1).to_numpy()
        flat = lists.flatten().to_numpy().astype(np.int32)
        parts.append((flat, np.repeat(n, lists.value_lengths().fill_null(0).to_numpy())))
        fresh += len(flat)
        if fresh > HELD:
            parts = [merged(parts)]
            fresh, held = 0, len(parts[0][0])
            if held > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["pair", "count"])
                parts = []
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], ["pair", "count"])


def _measured(table):
    """Adds n_best and count_sum over the pairs of the broadcast table, and the pairs outside it: rest, rest_times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for batch in batches:
            lists, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            size = lists.value_lengths().fill_null(0).to_numpy()
            flat, often = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(known, flat)
            inside = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == flat) if len(known) else np.zeros(len(flat), bool)
            count = np.zeros(len(flat), np.int64)
            count[inside] = counts[at[inside]]
            ends = np.concatenate([[0], np.cumsum(size)])
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            top = np.where(inside & (count == best[flat // SIDE]), often, 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(~inside)])[ends].astype(np.int32))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("digest", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                keep + [pa.array(total(top)), pa.array(total(count * often)), pa.ListArray.from_arrays(offsets, pa.array(flat[~inside])), pa.ListArray.from_arrays(offsets, pa.array(often[~inside].astype(np.int32)))],
                ["digest", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "rest_times"])

    return run


def frequent(counts: DataFrame, limit: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts of ``counts(pair, count)`` from the least power of two on that leaves at most ``limit`` pairs."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("count")).cast("int")).count().collect()}
    least, room = 64, limit
    while least and (room := room - sizes.get(least - 1, 0)) >= 0:
        least -= 1
    table = counts.where(F.col("count") >= F.lit(2.0 ** least)).toArrow()
    pair, count = table.column("pair").to_numpy(), table.column("count").to_numpy()
    order = np.argsort(pair)
    return pair[order], count[order]


def aligned(docs: DataFrame, a_path: str | None = None, a_ranks: str | None = None, b_path: str | None = None, limit: int = TABLE) -> tuple[DataFrame, DataFrame]:
    """(measures, pair counts) of ``docs(doc_id, text)``.

    Measures have one row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pair counts
    are (a_id, b_id, count): how many rows hold the pair linked; rows that repeat a doc_id or text count each by itself.
    A null or empty text, and one that either side does not give back byte for byte, has zeros and an empty groups_sha256
    and counts for no pair. A null doc_id is kept. Other columns are ignored; an empty table gives empty results.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "align")
    a_path, b_path = a_path or files("byte_bpe_50k.json"), b_path or files("piece_bpe_32k.model")
    a_ranks = a_ranks or files("byte_bpe_50k.tiktoken")
    texts = docs.where("text <> ''").groupBy(F.col("text").cast("string").alias("text")).agg(F.count("*").alias("n"))
    distinct = texts.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "n")
    one = scratch.put(distinct.mapInArrow(_aligned(a_path, a_ranks, b_path), ALIGNED), "aligned")
    counts = one.select("pairs", "n").mapInArrow(_summed, "pair int, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = scratch.put(counts, "counts")
    best = counts.groupBy(F.floor(F.col("pair") / SIDE).cast("int").alias("a_id")).agg(F.max("count").alias("best"))
    best = scratch.put(best, "best")
    rows = best.toArrow()  # at most one row for each id of A
    highest = np.zeros(1 << 16, np.int64)
    highest[rows.column("a_id").to_numpy()] = rows.column("best").to_numpy()
    table = spark.sparkContext.broadcast((*frequent(counts, limit), highest))
    schema = "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<int>, rest_times array<int>"
    measured = scratch.put(one.mapInArrow(_measured(table), schema), "measured")
    rare = measured.select("digest", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("digest", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    rare = rare.join(counts, "pair").withColumn("a_id", F.floor(F.col("pair") / SIDE).cast("int")).join(best, "a_id")
    rare = rare.groupBy("digest").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    whole = measured.drop("rest", "rest_times").join(rare, "digest", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole = scratch.put(whole.select("digest", "n", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + zero("more_best")).alias("n_best"), (F.col("count_sum") + zero("more_sum")).alias("count_sum"), "groups_sha256"), "whole")
    ids = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"))
    out = spread_join(ids, whole, "digest", "n", F.col("doc_id")).select(
        "doc_id", *[zero(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    pairs = counts.select(F.floor(F.col("pair") / SIDE).cast("int").alias("a_id"), (F.col("pair") % SIDE).alias("b_id"), "count")
    return out, pairs
