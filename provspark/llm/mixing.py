"""Language-model scores by logistic context mixing.

A text is its UTF-8 bytes with A-Z lower-cased and one byte that no text holds at the end, each byte eight binary
decisions. Tables addressed by hashes of the last one to four bytes, or of the word so far, and the decisions made before hold how often either
side was taken; each gives a log-odds. Weights picked by a gate (the decision's number and the longest context known)
combine them, and a table over the combined log-odds and the last byte refines the result. As a text fixes all
decisions, the bits of all bytes and the end sum to a probability over texts.

The weights and the refinement are fitted on all training texts, all of their bytes. Texts are in one of two halves, and each
half is coded with tables that count the other one, so no text meets its own counts: fixed numbers of Newton rounds, each
one pass over either half that sums gradients and curvatures per gate or level. Then the tables count both halves. Scores
depend on a text and the model alone.

What a byte adds to counts and sums depends on its gram alone, the bytes before it and its word so far. So one pass over the
training texts adds up how often each distinct gram occurs in either half; all counts and rounds go over distinct grams.

The base score is a unigram with add-one smoothing over all training texts. Counts of at most ``HOT`` of the most frequent tokens
are looked up where the text is; the others meet their counts in a join, so the vocabulary may have any size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import LOWER, Scratch, in_chunks, mix64, remainder, words_of

FOLDS, HELD = 7, 2
HOT = 1 << 17
ORDERS = (1, 2, 3, 4)
TABLES = len(ORDERS) + 1
#: Base of the words' hashes and its inverse modulo 2^64.
POWER = 0x9E3779B97F4A7C15
POWER_BACK = pow(POWER, -1, 1 << 64)
#: Slots of each order's table, as powers of two; fixed, so the model's size is too. Slots that travel in one row.
SLOTS, CHUNK = (16, 18, 19, 20, 22), 8192
#: Texts whose crc32 is a multiple of this are the first half, the others the second.
DEV = 2
#: Newton rounds of the weights and of the refinement, ridges towards where they start, which few texts do not overcome, and the largest step.
WEIGHT_ROUNDS, REFINE_ROUNDS, WEIGHT_RIDGE, REFINE_RIDGE, STEP = 4, 2, 1000.0, 100.0, 0.5
START = 0.3
#: Sums are exact in whole numbers of this size, so they do not depend on the order of tasks.
UNIT = 1 << 20
END = 255
#: Weights are picked by the decision's number and how often the word so far was seen there (powers of two).
SEEN = 8
GATES = 8 * SEEN
LEVELS, RANGE = 24, 8.0
#: Characters worked on at once, and distinct grams.
TEXT_CHARS, BLOCK = 1_000_000, 16_384
#: Places for grams whose log-probability a scoring task keeps, as a power of two (12 MB).
KNOWN = 19
#: Grams a task holds before it adds up equal ones; groups that grams are dealt to by hash.
HELD_GRAMS, GROUPS = 1 << 21, 1 << 10
GATHERED = "first boolean, grp int, grams binary, token binary, times long"
ADDED = "first boolean, grams binary"
GRAMS = "first boolean, key long, word long, times long"
#: Codec of packed grams.
CODEC = "zstd"


def byte_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with their ends, and the number of bytes of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) + b"\xff" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def grams(stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, word): each byte with the four before it in its own text (0 before the start), the byte lowest, and a hash
    of the bytes of its word so far. A word starts after white space."""
    n = len(stream)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n) - start
    key = stream.astype(np.int64)
    for k in range(1, ORDERS[-1] + 1):
        before = np.zeros(n, np.int64)
        before[k:] = stream[:-k] if k < n else 0
        before[place < k] = 0
        key |= before << (8 * k)
    # sum of b_j P^(i-j) over the word's bytes before i, from running sums of b_j P^-j; P is odd, so it has an inverse
    space = (stream == 32) | ((stream >= 9) & (stream <= 13))
    word = np.where(place == 0, np.arange(n), 0)
    word[1:] = np.maximum(word[1:], np.where(space[:-1], np.arange(1, n), 0))
    word = np.maximum.accumulate(word)
    with np.errstate(over="ignore"):
        down, up = powers(1 << max(1, n).bit_length())
        sums = np.concatenate([[np.uint64(0)], np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * down[:n])])
        return key, mix64((sums[:-1] - sums[word]) * up[:n])


def distinct(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, key, word): the distinct pairs and which of them each position has."""
    with np.errstate(over="ignore"):
        code, _ = pd.factorize(mix64(key.astype(np.uint64)) + word)
    first = np.empty(code.max() + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, key[first], word[first]


def spread(node: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def slots(hashes: np.ndarray, spread_node: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((hashes ^ spread_node) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS[order])).view(np.int64)


def contexts(key: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last one to four bytes, and of the word so far."""
    out = []
    for k in ORDERS:
        c = (key >> 8) & ((1 << (8 * k)) - 1)
        with np.errstate(over="ignore"):
            out.append(mix64(c.astype(np.uint64) * np.uint64(8) + np.uint64(k)))
    return [*out, word]


def decisions(key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, node, side) of the eight decisions of the lowest byte; the node names the decisions before."""
    byte = key & 255
    for b in range(8):
        yield b, (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1


def rows_of(key: np.ndarray) -> np.ndarray:
    """Where the refinement of the last byte starts."""
    return (((key >> 8) & 255) * (LEVELS + 1)).astype(np.int32)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(p))])) for p in (POWER_BACK, POWER))


def levels() -> np.ndarray:
    """The refinement that changes nothing."""
    return np.tile(np.linspace(-RANGE, RANGE, LEVELS + 1, dtype=np.float32), 256)


@dataclass
class Model:
    """Log-odds by slot for each table, how often the words' slots were seen, weights by gate, refinement by last byte and level."""

    odds: list[np.ndarray]
    seen: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    tokens: int = 0
    vocabulary: int = 0
    #: Packed grams of the texts to fit on, where they are known already.
    grams: DataFrame | None = None

    @staticmethod
    def of(odds: list[np.ndarray], seen: np.ndarray) -> Model:
        return Model(odds, seen, np.full((TABLES, GATES), START, np.float32), levels())

    def inputs(self, hashes: list[np.ndarray], number: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = spread(node)
        x = np.empty((TABLES, len(node)), np.float32)
        for o in range(TABLES):
            s = slots(hashes[o], at, o)
            x[o] = self.odds[o].take(s)
        return x, number * SEEN + self.seen.take(s).astype(np.int64)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.weights[0].take(gate)
        for o in range(1, TABLES):
            z += x[o] * self.weights[o].take(gate)
        return np.clip(z, -RANGE, RANGE, out=z)

    def refined(self, row: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Between the two levels around ``z`` in the last byte's row, with the lower one's place and the share above it."""
        at = (np.minimum(z, np.float32(RANGE - 1e-3)) + np.float32(RANGE)) * np.float32(LEVELS / (2 * RANGE))
        low = at.astype(np.int32)
        share = at - low.astype(np.float32)
        low += row
        below = self.refine.take(low)
        return below + share * (self.refine.take(low + 1) - below), low, share

    def nats(self, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's byte after the others, in blocks that stay in a core's cache."""
        out = np.empty(len(keys))
        for lo in range(0, len(keys), BLOCK):
            key = keys[lo:lo + BLOCK]
            hashes, row, p = contexts(key, words[lo:lo + BLOCK]), rows_of(key), np.ones(len(key))
            for number, node, side in decisions(key):
                z = self.mixed(*self.inputs(hashes, number, node))
                z += self.refined(row, z)[0]
                z *= (0.5 - side).astype(np.float32)  # half the sum, its sign turned where the side is 1
                p *= 1 + np.exp(z.astype(np.float64))
            out[lo:lo + BLOCK] = -np.log(p)
        return out

    def weight_sums(self, key: np.ndarray, word: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Per gate: gradient and curvature of the log-loss in the weights, over grams that occur ``times`` each."""
        out = np.zeros((TABLES + TABLES * TABLES, GATES))
        for lo in range(0, len(key), BLOCK):
            part, often = key[lo:lo + BLOCK], times[lo:lo + BLOCK]
            hashes = contexts(part, word[lo:lo + BLOCK])
            for number, node, side in decisions(part):
                x, gate = self.inputs(hashes, number, node)
                p = 1 / (1 + np.exp(-self.mixed(x, gate).astype(np.float64)))
                miss, curve = often * (side - p), often * p * (1 - p)
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                gates, first = np.unique(gate[order], return_index=True)
                x, miss, curve = x[:, order].astype(np.float64), miss[order], curve[order]
                for g, a, b in zip(gates.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                    out[:TABLES, g] += x[:, a:b] @ miss[a:b]
                    out[TABLES:, g] += ((x[:, a:b] * curve[a:b]) @ x[:, a:b].T).ravel()
        return out.ravel()

    def refine_sums(self, key: np.ndarray, word: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Per last byte and level: gradient and a bound of the curvature of the log-loss in the refinement."""
        size = len(self.refine)
        out = np.zeros((2, size))
        for lo in range(0, len(key), BLOCK):
            part, often = key[lo:lo + BLOCK], times[lo:lo + BLOCK]
            hashes, row = contexts(part, word[lo:lo + BLOCK]), rows_of(part)
            for number, node, side in decisions(part):
                fine, low, share = self.refined(row, self.mixed(*self.inputs(hashes, number, node)))
                p = 1 / (1 + np.exp(-fine.astype(np.float64)))
                for i, v in enumerate((often * (side - p), often * p * (1 - p))):
                    out[i] += np.bincount(low, weights=v * (1 - share), minlength=size) + np.bincount(low + 1, weights=v * share, minlength=size)
        return out.ravel()

    def step_weights(self, sums: np.ndarray) -> None:
        sums = sums.reshape(TABLES + TABLES * TABLES, GATES)
        curve = sums[TABLES:].T.reshape(GATES, TABLES, TABLES) + WEIGHT_RIDGE * np.eye(TABLES)
        gradient = sums[:TABLES] - WEIGHT_RIDGE * (self.weights - START)
        self.weights += np.clip(np.linalg.solve(curve, gradient.T[..., None])[..., 0].T, -STEP, STEP).astype(np.float32)

    def step_refine(self, sums: np.ndarray) -> None:
        gradient, curve = sums.reshape(2, -1)
        self.refine += np.clip((gradient - REFINE_RIDGE * (self.refine - levels())) / (curve + REFINE_RIDGE), -STEP, STEP).astype(np.float32)


class Known:
    """Log-probabilities of grams that a task met lately: a place by hash for each, which the next gram there takes over.
    Grams are compared whole, so what is found is what the model gives."""

    def __init__(self, model: Model):
        self.model, n = model, 1 << KNOWN
        self.key, self.word, self.value = np.full(n, -1, np.int64), np.zeros(n, np.uint64), np.zeros(n)

    def nats(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = (spread(mix64(key.astype(np.uint64)) ^ word) >> np.uint64(64 - KNOWN)).view(np.int64)
        out = self.value.take(at)
        new = np.flatnonzero((self.key.take(at) != key) | (self.word.take(at) != word))
        if len(new):
            at, key, word = at[new], key[new], word[new]
            out[new] = value = self.model.nats(key, word)
            self.key[at], self.word[at], self.value[at] = key, word, value  # of grams with one place, the last one in each array
        return out


def packed(slot: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> bytes:
    """Counts of some slots of a chunk; most are small, so their bytes are laid out by place and compressed."""
    planes = [slot.astype("<u2").view(np.uint8).reshape(-1, 2).T, *[c.astype("<u8").view(np.uint8).reshape(-1, 8).T for c in (zeros, ones)]]
    return zlib.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(18, -1)
    slot, zeros, ones = (np.ascontiguousarray(planes[a:b].T).view(f"<u{b - a}").ravel() for a, b in ((0, 2), (2, 10), (10, 18)))
    return slot.astype(np.int64), zeros.astype(np.int64), ones.astype(np.int64)


class Grams:
    """Distinct grams and how often they occur, added up in bounded memory."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, word: np.ndarray, times: np.ndarray) -> bool:
        """Whether many distinct ones are held, as far as they are added up."""
        self.parts.append((key, word, times))
        self.size += len(key)
        if self.size > HELD_GRAMS:
            self.summed()
            return self.size > HELD_GRAMS // 2
        return False

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, word, times) in the order of key and word."""
        key, word, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((word, key))
        key, word, times = key[order], word[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (word[1:] != word[:-1])]))
        self.parts, self.size = [(key[heads], word[heads], np.add.reduceat(times, heads))], len(heads)
        return self.parts[0]


def group_of(key: np.ndarray) -> np.ndarray:
    """One of GROUPS; grams that differ in their last byte or word alone are in one."""
    return (mix64((key >> 8).astype(np.uint64)) >> np.uint64(54)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Bytes by place, so that equal high ones lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = data.reshape(width, -1).T
    return wide.view("<u8").ravel()


def packed_grams(key: np.ndarray, word: np.ndarray, times: np.ndarray) -> bytes:
    """The bytes before and the word of grams that follow one another and share them are written once."""
    before = key >> 8
    heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(key)))
    data = b"".join([_planes(before[heads], ORDERS[-1]), _planes(word[heads], 8), _planes(sizes, 8), _planes(key & 255, 1), _planes(times, 8)])
    return np.array([len(heads), len(key)], "<u8").tobytes() + pa.compress(data, codec=CODEC, asbytes=True)


def unpacked_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs, n = np.frombuffer(data[:16], "<u8").tolist()
    widths = ((runs, ORDERS[-1]), (runs, 8), (runs, 8), (n, 1), (n, 8))
    whole = np.frombuffer(pa.decompress(data[16:], sum(a * b for a, b in widths), codec=CODEC), np.uint8)
    cuts = np.cumsum([0] + [a * b for a, b in widths]).tolist()
    before, word, sizes, low, times = (_from_planes(whole[a:b], w) for a, b, (_, w) in zip(cuts[:-1], cuts[1:], widths, strict=True))
    sizes = sizes.astype(np.int64)
    return (np.repeat(before, sizes) << np.uint64(8) | low).astype(np.int64), np.repeat(word, sizes), times.astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, first): a task's tokens (token, times), and its distinct grams by half and group."""
    held = {True: Grams(), False: Grams()}
    tokens: Counter = Counter()
    names = ["first", "grp", "grams", "token", "times"]

    def token_rows() -> pa.RecordBatch:
        n = len(tokens)
        rows = [pa.array([None] * n, pa.bool_()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.binary()), pa.array(list(tokens.keys()), pa.binary()), pa.array(list(tokens.values()), pa.int64())]
        tokens.clear()
        return pa.RecordBatch.from_arrays(rows, names)

    def gram_rows(first: bool) -> pa.RecordBatch:
        key, word, times = held[first].summed()
        held[first].clear()
        group = group_of(key)
        order = np.lexsort((word, key >> 8, group))
        key, word, times, group = key[order], word[order], times[order], group[order]
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        n = len(cuts) - 1
        return pa.RecordBatch.from_arrays([
            pa.array([first] * n, pa.bool_()), pa.array(group[cuts[:-1]], pa.int32()), pa.array([packed_grams(key[a:b], word[a:b], times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            pa.array([None] * n, pa.binary()), pa.array([None] * n, pa.int64())], names)

    for batch in batches:
        first = batch.column(1).to_numpy(zero_copy_only=False)
        for begin, _, texts in in_chunks(batch, "text", TEXT_CHARS):
            for t in texts:
                tokens.update(words_of(t))
            tokens[b""] += len(texts)
            if len(tokens) > 300_000:
                yield token_rows()
            for half in (False, True):
                stream, sizes = byte_stream([t for i, t in enumerate(texts) if first[begin + i] == half])
                if len(stream):
                    code, key, word = distinct(*grams(stream, sizes))
                    if held[half].add(key, word, np.bincount(code)):
                        yield gram_rows(half)
    if tokens:
        yield token_rows()
    for half in (False, True):
        if held[half].size:
            yield gram_rows(half)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, grp, grams) sorted by half and group: each distinct gram once, packed by a few blocks."""
    at, some = None, Grams()

    def rows() -> Iterator[pa.RecordBatch]:
        key, word, times = some.summed()
        some.clear()
        order = np.lexsort((word, key >> 8))
        for lo in range(0, len(key), 2 * BLOCK):
            part = order[lo:lo + 2 * BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.bool_()), pa.array([packed_grams(key[part], word[part], times[part])], pa.binary())], ["first", "grams"])

    for batch in batches:
        firsts, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if (firsts[i], groups[i]) != at:
                if at:
                    yield from rows()
                at = firsts[i], groups[i]
            some.add(*unpacked_grams(batch.column(2)[i].as_py()))
    if at:
        yield from rows()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, grams) as a row for each gram."""
    for batch in batches:
        for first, grams_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            key, word, times = unpacked_grams(grams_.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([first] * len(key), pa.bool_()), pa.array(key), pa.array(word.view(np.int64)), pa.array(times)], ["first", "key", "word", "times"])


def packed_up(gathered: DataFrame) -> DataFrame:
    """first, grams: each distinct gram of a half once, many in a row."""
    return gathered.where("grams is not null").select("first", "grp", "grams").repartition("first", "grp").sortWithinPartitions("first", "grp").mapInArrow(_add_up, ADDED)


def added_up(gathered: DataFrame) -> DataFrame:
    """first, key, word, times: each distinct gram of a half once, in a row of its own."""
    return packed_up(gathered).mapInArrow(_opened, GRAMS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, word, times) of rows of packed grams, a few blocks at once."""
    some, size = [], 0
    for batch in batches:
        for row in batch.column(0):
            some.append(unpacked_grams(row.as_py()))
            size += len(some[-1][0])
            if size >= 2 * BLOCK:
                yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                some, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _count(apart: bool):
    """Rows (order, chunk of slots, packed counts) of a task's packed grams, those of the first half of the texts
    under orders above ``TABLES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones = ([np.zeros(1 << s, np.int64) for s in SLOTS] for _ in range(2))
        for keys, words, every in _blocks(batches):
            for lo in range(0, len(keys), BLOCK):
                key, times = keys[lo:lo + BLOCK], every[lo:lo + BLOCK]
                hashes = contexts(key, words[lo:lo + BLOCK])
                for _, node, side in decisions(key):
                    at, one = spread(node), side == 1
                    zero, t1 = ~one, times[one]
                    t0 = times[zero]
                    for o in range(TABLES):
                        s = slots(hashes[o], at, o)
                        np.add.at(zeros[o], s[zero], t0)
                        np.add.at(ones[o], s[one], t1)
        for o in range(TABLES):
            used = np.flatnonzero(zeros[o] + ones[o])
            cuts = np.flatnonzero(np.diff(used // CHUNK)) + 1
            parts = [p for p in np.split(used, cuts) if len(p)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([o + 1 + TABLES * apart] * n, pa.int32()), pa.array([int(p[0]) // CHUNK for p in parts], pa.int32()),
                pa.array([packed(p % CHUNK, zeros[o][p], ones[o][p]) for p in parts], pa.binary())], ["kind", "chunk", "counts"])

    return run


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of the sides' frequencies, drawn towards even ones where little was seen."""
    n = zeros + ones
    return (np.log((ones + 0.3) / (zeros + 0.3)) * (n / (n + 0.5))).astype(np.float32)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (order, chunk): one row of log-odds (float32) and of how often slots were seen (int8) for each."""
    at, zeros, ones = None, None, None

    def row() -> pa.RecordBatch:
        seen = np.minimum(np.ceil(np.log2(zeros + ones + 1.0)), SEEN - 1).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([log_odds(zeros, ones).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["kind", "chunk", "odds", "seen"])

    for batch in batches:
        kinds, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if (kinds[i], chunks[i]) != at:
                if at:
                    yield row()
                at, zeros, ones = (kinds[i], chunks[i]), np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
            s, a, b = unpacked(batch.column(2)[i].as_py())
            zeros[s] += a
            ones[s] += b
    if at:
        yield row()


def _tables(counted: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Log-odds of all tables, and how often the words' slots were seen, from rows of counts."""
    order = ((F.col("kind") - 1) % TABLES + 1).alias("kind")
    summed = counted.select(order, "chunk", "counts").repartition("kind", "chunk").sortWithinPartitions("kind", "chunk") \
        .mapInArrow(_sum, "kind int, chunk int, odds binary, seen binary").toArrow()  # as many numbers as the tables have slots
    odds, seen = [np.zeros(1 << n, np.float32) for n in SLOTS], np.zeros(1 << SLOTS[-1], np.int8)
    for kinds, chunks, a, b in (batch.columns for batch in summed.to_batches()):
        for i in range(len(kinds)):
            kind, lo = kinds[i].as_py(), chunks[i].as_py() * CHUNK
            odds[kind - 1][lo:lo + CHUNK] = np.frombuffer(a[i].as_buffer(), np.float32)
            if kind == TABLES:
                seen[lo:lo + CHUNK] = np.frombuffer(b[i].as_buffer(), np.int8)
    return odds, seen


def fit(texts: DataFrame, model: Model, *others: tuple[DataFrame, Model]) -> None:
    """Newton rounds of the weights, then of the refinement, over all of ``texts(text)`` with the tables of ``model``.

    ``others`` are further texts with the models whose tables code them; their sums join those of ``texts``.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "mixing_fit")
    parts = []
    for i, (t, m) in enumerate(((texts, model), *others)):
        known = m.grams if m.grams is not None else scratch.put(packed_up(t.select("text", F.lit(True).alias("first")).mapInArrow(_gather, GATHERED)), f"grams_{i}")
        parts.append((known.select("grams"), spark.sparkContext.broadcast((m.odds, m.seen))))
        if m.grams is not None:  # the tables are the tasks' from here on; what fits on all texts counts its own
            m.odds, m.seen = [], None

    def round_of(name: str, size: int) -> np.ndarray:
        weights, refine = model.weights, model.refine

        def summed(tables):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                lm, total = Model(*tables.value, weights, refine), np.zeros(size, np.int64)
                for key, word, times in _blocks(batches):
                    total += np.rint(getattr(lm, name)(key, word, times) * UNIT).astype(np.int64)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["place", "total"])

            return run

        sums = np.zeros(size)
        for t, tables in parts:  # one after the other, so a task holds the tables of one part
            for r in t.mapInArrow(summed(tables), "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
                sums[r["place"]] += float(r["total"]) / UNIT
        return sums

    for _ in range(WEIGHT_ROUNDS):
        model.step_weights(round_of("weight_sums", (TABLES + TABLES * TABLES) * GATES))
    for _ in range(REFINE_ROUNDS):
        model.step_refine(round_of("refine_sums", 2 * len(model.refine)))
    for _, tables in parts:
        tables.destroy()
    scratch.drop()


def train(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model, and token, c of all training tokens."""
    part = docs.select(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("crc") % FOLDS != HELD)
    first = F.col("crc") % DEV == 0
    gathered = scratch.put(part.select("text", first.alias("first")).mapInArrow(_gather, GATHERED), "gathered")
    counts = scratch.put(gathered.where("token is not null").groupBy("token").agg(F.sum("times").alias("c")), "tokens")
    known = scratch.put(packed_up(gathered), "grams")
    scratch.drop("gathered")
    halves = [known.where(half).select("grams") for half in (~F.col("first"), F.col("first"))]
    counted = scratch.put(reduce(DataFrame.unionAll, [half.mapInArrow(_count(apart), "kind int, chunk int, counts binary") for half, apart in zip(halves, (False, True), strict=True)]), "counted")
    model, other = Model.of(*_tables(counted.where(F.col("kind") <= TABLES))), Model.of(*_tables(counted.where(F.col("kind") > TABLES)))
    other.grams, model.grams = halves
    fit(part.where(first).select("text"), model, (part.where(~first).select("text"), other))
    model.odds, model.seen = _tables(counted)
    model.grams = None
    model.tokens, model.vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return model, counts


def hot_tokens(counts: DataFrame, most: int = HOT) -> dict[bytes, int]:
    """The most frequent of ``counts(token, c)``, at most ``most``: all that occur more often than some number of times."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).toArrow()  # as many rows as there are different counts
    times, n = (sizes.column(i).to_numpy() for i in range(2))
    order = np.argsort(times)[::-1]
    left_out = times[order][np.cumsum(n[order]) > most]
    hot = counts.where(F.col("c") > int(left_out[0] if len(left_out) else 0)).select("token", "c").toArrow()
    return {bytes(t): c for batch in hot.to_batches() for t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)}


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row of ``docs``.

    A null text is the empty one: its only token is the end. A null doc_id is held against the crc32 of no bytes.
    Repeated rows get a row each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    model, counts = train(docs, scratch)
    scale = float(np.log10(model.tokens + model.vocabulary + 1))
    train_tokens = model.tokens
    held = spark.sparkContext.broadcast((model, hot_tokens(counts)))
    del model
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value
        lm = Known(model)
        base, number = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for begin, end, texts in in_chunks(batch, "text", TEXT_CHARS):
                stream, sizes = byte_stream(texts)
                code, key, word = distinct(*grams(stream, sizes))
                total = np.add.reduceat(lm.nats(key, word)[code], np.cumsum(sizes) - sizes) / np.log(10)
                n_tokens, n_hot, logs, rest_token, rest_times, rest_sizes = [], [], [], [], [], []
                for t in texts:
                    words = words_of(t)
                    words.append(b"")
                    c = [known.get(w, 0) for w in words]
                    found = np.array(c, np.int64)
                    n_tokens.append(len(words))
                    n_hot.append(int(np.count_nonzero(found)))
                    logs.append(float(np.log10(found + 1.0).sum()))
                    rest = Counter(w for w, k in zip(words, c, strict=True) if not k)
                    rest_token += rest.keys()
                    rest_times += rest.values()
                    rest_sizes.append(len(rest))
                part = batch.slice(begin, end - begin)
                ids = base + number + np.arange(len(texts))
                number += len(texts)
                entries = pa.StructArray.from_arrays([pa.array(rest_token, pa.binary()), pa.array(rest_times, pa.int64())], ["token", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest_sizes)]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(logs, pa.float64()), pa.array(total, pa.float64()), pa.array(sizes - 1, pa.int64()), rest],
                                                 ["row", "doc_id", "n_tokens", "n_hot", "logs", "score", "n_bytes", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = scratch.put(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_hot long, logs double, score double, n_bytes long, rest array<struct<token:binary,times:long>>"), "rows")
    rare = out.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.times").join(counts, "token") \
        .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("add"))
    return out.drop("rest").join(rare, "row", "left").select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "n_tokens", (F.col("n_hot") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
