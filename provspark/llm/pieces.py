"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that matches, and one of byte pieces for a character
that is no piece; the model's merge ranks give the pieces' weights by Zipf's law. Pieces do not cross the ends of words
(a space belongs to the word after it) nor line ends, so sums over all paths are taken per distinct word.

A path's perturbed score is its log-probability plus Gumbel noise. The best ``k`` paths are found by A* over regions of
the lattice: a region is all paths that share a beginning and then avoid some edges; its mass is known, so is the
greatest perturbed score in it, a Gumbel variable at its log-mass, truncated at what was popped before. The region with
the greatest is popped, its path drawn, and what remains is split along the path. All steps are done for many texts at
once. Noise is a hash of the row's key, so a row's segmentations depend on its key and text alone.

A path's inclusion score is the probability that it exceeds the (k+1)-th best perturbed score, which is known too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.llm.common import in_chunks, mix64

SAMPLES = 2
#: Weight of a piece is 1 / (rank + SHIFT); a byte piece has the rank after the last.
SHIFT = 20.0
UNIT = re.compile(r" ?[^ \n]+|\n| ")
SPACE = "▁"
#: Distinct words whose lattices are kept, and characters worked on at once: some 150 MB together.
TYPES = 80_000
TEXT_CHARS = 200_000
#: Rows decoded at once.
DECODED = 256
HASH = 0x9E3779B97F4A7C15


def units_of(text: str | None) -> list[str]:
    """``UNIT`` all over the text with a space before it; none of no text."""
    if not text:
        return []
    if "\0" in text:
        return UNIT.findall(" " + text)
    cut = (" " + text).replace(" ", "\0 ")  # a mark where a unit begins
    return list(filter(None, cut.replace("\n", "\0\n\0").split("\0")))


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def raw_pieces(p) -> list[bytes]:
    """The bytes each piece stands for, by id; none for control pieces."""
    def raw(i: int) -> bytes:
        piece = p.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else piece.replace(SPACE, " ").encode()

    return [raw(i) for i in range(p.get_piece_size())]


class Vocabulary:
    """Pieces of a model file with their log-weights; a space stands for the model's mark of one."""

    def __init__(self, model: bytes):
        p = processor(model)
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        n = p.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i)):
                text = piece.replace(SPACE, " ")
                self.ids[text] = i
                self.weight[text] = -math.log(min(-p.get_score(i), float(n)) + SHIFT)
        self.byte_weight = -math.log(n + SHIFT)
        self.weights = np.zeros(n)
        # Every beginning of a piece by its hash, with the piece's id, or -1 where it is none.
        begun: dict[int, int] = {}
        for text, i in self.ids.items():
            self.weights[i], h = self.weight[text], 0
            for c in text:
                h = (h + ord(c) + 1) * HASH % (1 << 64)
                begun.setdefault(h, -1)
            begun[h] = i
        # A slot for each beginning, the next free one from its hash's first bits on; four slots at least for one that is used.
        bits = max(10, (4 * len(begun)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.found = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int64)
        for h, i in begun.items():
            at = h >> (64 - bits)
            while self.found[at] != -2:
                at = (at + 1) & self.last
            self.slots[at], self.found[at] = h, i

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, -1 for a beginning only, -2 for neither."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.found[at]
        other = np.flatnonzero((self.slots[at] != hashes) & (out != -2))
        at = at[other]
        while len(other):  # slots that another beginning holds
            at = (at + 1) & self.last
            out[other] = self.found[at]
            on = (self.slots[at] != hashes[other]) & (out[other] != -2)
            other, at = other[on], at[on]
        return out


@lru_cache(maxsize=1)
def vocabulary(model: bytes) -> Vocabulary:
    """Made once in a worker, not in each of its tasks."""
    return Vocabulary(model)


@lru_cache(maxsize=1)
def raw_array(model: bytes) -> pa.Array:
    return pa.array(raw_pieces(processor(model)), pa.large_binary())


class Grown:
    """A flat array that is added to at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 20, kind), 0  # pages that are not written cost nothing

    def clear(self) -> None:
        self.size = 0  # its pages are written again

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            wider = np.zeros(max(len(self.data) * 5 // 4, self.size + len(values)), self.data.dtype)
            wider[:self.size] = self.data[:self.size]
            self.data = wider
        self.data[self.size:self.size + len(values)] = values
        self.size += len(values)

    @property
    def view(self) -> np.ndarray:
        return self.data[:self.size]


class Lattices:
    """Lattices of distinct words in flat arrays. Node numbers are global; an edge's key is its node plus the share of the
    node's probability up to its end, so a number in a node's unit interval picks an edge."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.key, self.log, self.share = Grown(np.float64), Grown(np.float64), Grown(np.float64)
        self.target, self.first, self.count, self.pool = Grown(np.int32), Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self.head, self.tail = Grown(np.int32), Grown(np.int32)  # first and last edge of a node
        self.clear()

    def clear(self) -> None:
        self.base: dict[str, int] = {}
        self.nodes = 0
        for x in (self.key, self.log, self.share, self.target, self.first, self.count, self.pool, self.head, self.tail):
            x.clear()

    def __len__(self) -> int:
        return len(self.base)

    def starts(self, words: list[str]) -> np.ndarray:
        base = self.base
        if new := set(words).difference(base):
            self._add(list(new))
        return np.fromiter(map(base.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        """Edges of all words, then sums over all paths to the ends, node by node from the ends."""
        by_bytes = self.v.byte_ids
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        self.base.update(zip(words, (self.nodes + begin).tolist(), strict=True))
        node = int(sizes.sum())
        ends = np.repeat(begin + sizes, sizes)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # Pieces from every node at once, a character longer each time, as long as some piece begins like this. A character
        # that is no piece has the edge -1, so each node has one at least.
        at, hashed = np.arange(node), np.zeros(node, np.uint64)
        widths = np.zeros(node, np.int64)
        found, size = [], 0
        while len(at):
            with np.errstate(over="ignore"):
                hashed = (hashed + chars[at + size] + np.uint64(1)) * np.uint64(HASH)
            size += 1
            k = self.v.lookup(hashed)
            hit = k >= 0
            if size == 1:
                found.append((at, np.zeros(node, np.int64), np.where(hit, k, -1)))
                widths += 1
            else:
                to = at[hit]
                found.append((to, widths[to], k[hit]))
                widths[to] += 1
            on = (k > -2) & (at + size < ends[at])
            at, hashed = at[on], hashed[on]
        heads = np.cumsum(widths) - widths
        src = np.repeat(np.arange(node), widths)
        dst, ids = np.empty(len(src), np.int64), np.empty(len(src), np.int64)
        for far, (to, place, k) in enumerate(found, 1):
            place += heads[to]
            dst[place], ids[place] = to + far, k
        raws = {int(e): chr(int(chars[src[e]])).encode("utf-8", "surrogatepass") for e in np.flatnonzero(ids < 0)}
        left = ends - np.arange(node)  # characters from a node to its word's end
        weight = self.v.weights[ids]
        count = np.ones(len(ids), np.int32)
        for e, raw in raws.items():
            weight[e], count[e] = self.v.byte_weight * len(raw), len(raw)
        after = np.zeros(node + 1)  # the last one stands for a word's end
        last = dst == ends[src]
        # Nodes by that distance, and their edges.
        nodes = np.argsort(left.astype(np.int16), kind="stable") if left.max() < 32_000 else np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[nodes], np.arange(1, int(left.max()) + 2)).tolist()
        wide = widths[nodes]
        begins = np.append(0, np.cumsum(wide))
        order = np.repeat(heads[nodes] - begins[:-1], wide) + np.arange(len(ids))
        onto, value = np.where(last, node, dst)[order], weight[order]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                a, b = begins[lo], begins[hi]
                value[a:b] += after[onto[a:b]]
                first = begins[lo:hi] - a
                top = np.maximum.reduceat(value[a:b], first)
                after[nodes[lo:hi]] = top + np.log(np.add.reduceat(np.exp(value[a:b] - np.repeat(top, wide[lo:hi])), first))
        total = np.empty(len(ids))
        total[order] = value
        log = total - after[src]
        share = np.exp(log)
        share[heads[widths == 1]] = 1.0
        run = np.cumsum(share)
        done = np.minimum(run - np.repeat(run[heads] - share[heads], widths), 1.0)
        done[np.append(heads[1:], len(src)) - 1] = 1.0
        self.head.extend(self.key.size + heads)
        self.tail.extend(self.key.size + heads + widths - 1)
        self.key.extend(self.nodes + src + done)
        self.log.extend(log)
        self.share.extend(share)
        self.target.extend(np.where(last, -1, self.nodes + dst))
        self.first.extend(self.pool.size + np.cumsum(count) - count)
        self.count.extend(count)
        if raws:
            flat = np.repeat(ids, count)
            at = np.cumsum(count) - count
            for e, raw in raws.items():
                flat[at[e]:at[e] + len(raw)] = [by_bytes[b] for b in raw]
            ids = flat
        self.pool.extend(ids)
        self.nodes += node

    def arrays(self):
        return tuple(x.view for x in (self.key, self.log, self.share, self.target, self.first, self.count, self.pool, self.head, self.tail))


def uniform(key: np.ndarray, draw: int, index: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's key, the draw and the place."""
    with np.errstate(over="ignore"):
        h = mix64(key + (index.astype(np.uint64) * np.uint64(64) + np.uint64(draw)) * np.uint64(HASH))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Greatest perturbed score of a region of log-mass ``mass``, given that it is at most ``bound``."""
    with np.errstate(divide="ignore"):
        return np.where(mass > -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - mass), -np.inf)


class Sampler:
    """Segmentations of many texts at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.lattices = Lattices(vocabulary)

    def _walk(self, node: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int, forced: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(edges, counts): the edges drawn from each node to the end of its word, word by word. forced: first edges, -1 where free."""
        at, who, steps = node, np.arange(len(node)), []
        while len(who):
            x = at + uniform(key[who], draw, (place[who] << 20) + len(steps))
            edge, low = self.tail[at], self.head[at]
            open_ = np.flatnonzero(edge > low)
            while len(open_):  # from the longest piece down to the one whose share holds x
                open_ = open_[self.key[edge[open_] - 1] >= x[open_]]
                edge[open_] -= 1
                open_ = open_[edge[open_] > low[open_]]
            if forced is not None and not steps:
                edge = np.where(forced >= 0, forced, edge)
            steps.append((who, edge))
            nxt = self.target[edge]
            who, at = who[nxt >= 0], nxt[nxt >= 0]
        counts = np.zeros(len(node), np.int64)
        for w, _ in steps:
            counts[w] += 1
        begin = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for k, (w, e) in enumerate(steps):
            edges[begin[w] + k] = e
        return edges, counts

    def _other_edge(self, taken: list[np.ndarray], u: np.ndarray) -> np.ndarray:
        """An edge at the node of ``taken[0]`` that is none of the taken ones (-1: no entry)."""
        node = np.floor(self.key[taken[0]] - 1e-12).astype(np.int64)
        node = np.where(self.key[taken[0]] == np.floor(self.key[taken[0]]), self.key[taken[0]].astype(np.int64) - 1, node)
        gone = np.stack([np.where(t >= 0, t, np.iinfo(np.int64).max) for t in taken])
        gone.sort(axis=0)
        shares = np.where(gone < np.iinfo(np.int64).max, self.share[np.minimum(gone, len(self.share) - 1)], 0.0)
        x = u * np.maximum(1.0 - shares.sum(0), 0.0)
        for g, s in zip(gone, shares, strict=True):  # in order of the edges: what lies at or after a taken one moves up by its share
            ok = g < np.iinfo(np.int64).max
            gi = np.minimum(g, len(self.key) - 1)
            before = self.key[gi] - node - s
            x = np.where(ok & (x >= before - 1e-15), x + s, x)
        edge = np.searchsorted(self.key, node + np.minimum(x, 1 - 1e-12), "left")
        for g in gone:  # rounding may land on a taken edge; the next one, or the one before at the node's end, is free
            edge = np.where(edge == g, np.where(np.floor(self.key[np.minimum(edge, len(self.key) - 1)] - 1e-12) < node + 1, edge + 1, edge), edge)
        return edge

    def run(self, texts: list[str | None], keys: np.ndarray, k: int) -> dict[str, np.ndarray]:
        """text, rank, log, perturbed, inclusion, sizes and ids (flat) of up to ``k`` distinct segmentations of each text."""
        if len(self.lattices) > TYPES:
            self.lattices.clear()
        units = [units_of(t) for t in texts]
        n_words = np.fromiter(map(len, units), np.int64, len(units))
        start = self.lattices.starts(list(chain.from_iterable(units)))
        self.key, self.log, self.share, self.target, self.first, self.count, self.pool, self.head, self.tail = self.lattices.arrays()
        docs = len(texts)
        keys = mix64(keys.astype(np.int64).view(np.uint64))
        word_end = np.cumsum(n_words)
        word_doc = np.repeat(np.arange(docs), n_words)
        word_place = np.arange(len(start)) - np.repeat(word_end - n_words, n_words)
        out = {x: [] for x in ("text", "rank", "log", "perturbed", "sizes", "ids")}
        everyone = np.zeros(docs, np.int64)
        gumbel = -np.log(-np.log(uniform(keys, 0, everyone)))
        live = np.arange(docs)
        bound, split = gumbel, np.full(docs, -1)
        paths: list[dict] = []
        best = None
        for rank in range(k):
            if rank == 0:
                edges, counts = self._walk(start, keys[word_doc], word_place, 1)
                word_of = np.repeat(np.arange(len(start)), counts)
                owner = word_doc[word_of]
                excluded = None
            else:
                live = np.flatnonzero(best["g"] > -np.inf)
                if not len(live):
                    break
                edges, word_of, owner, excluded, split = self._redraw(paths, best, live, rank, start, keys, word_doc, word_place, word_end)
                bound = np.where(best["g"] > -np.inf, best["g"], bound)
            path = self._path(edges, word_of, owner, excluded, bound, split, live, docs, keys, rank)
            paths.append(path)
            pieces = self.count[edges]
            sizes = np.bincount(owner, weights=pieces, minlength=docs).astype(np.int64)
            for name, v in (("text", live), ("rank", np.full(len(live), rank + 1)), ("log", path["total"][live]), ("perturbed", bound[live]), ("sizes", sizes[live])):
                out[name].append(v)
            at = np.repeat(self.first[edges] - (np.cumsum(pieces) - pieces), pieces) + np.arange(int(pieces.sum()))
            out["ids"].append(self.pool[at])
            best = self._best(paths, docs)
        flat = {x: np.concatenate(v) for x, v in out.items()}
        threshold = best["g"][flat["text"]]
        with np.errstate(over="ignore"):
            flat["inclusion"] = np.where(threshold > -np.inf, -np.expm1(-np.exp(np.minimum(flat["log"] - threshold, 50.0))), 1.0)
        return flat

    def _path(self, edges, word_of, owner, excluded, bound, split, live, docs, keys, rank) -> dict:
        """A drawn path of each live text and the regions beside it."""
        log = self.log[edges]
        run = np.cumsum(log)
        begin = np.searchsorted(owner, np.arange(docs), "left")
        end = np.searchsorted(owner, np.arange(docs), "right")
        before = run - log
        zero = np.where(end > begin, before[np.minimum(begin, max(0, len(edges) - 1))] if len(edges) else 0.0, 0.0)
        before = before - zero[owner]
        taken = self.share[edges].copy()
        place = np.arange(len(edges)) - begin[owner]
        at_split = place == split[owner]
        if excluded is not None:
            for e in excluded:
                extra = np.where(e >= 0, self.share[np.maximum(e, 0)], 0.0)
                taken = np.where(at_split, taken + extra[owner], taken)
        with np.errstate(divide="ignore"):
            mass = before + np.log(np.where(taken < 1 - 1e-12, 1 - taken, 0.0))
        mass[place < split[owner]] = -np.inf  # these beginnings belong to the path that was split
        g = truncated(mass, bound[owner], uniform(keys[owner], 2 + 2 * rank, place))
        total = np.bincount(owner, weights=log, minlength=docs)
        return {"edges": edges, "word_of": word_of, "begin": begin, "end": end, "g": g, "owner": owner, "total": total, "excluded": excluded, "split": split}

    def _best(self, paths: list[dict], docs: int) -> dict:
        """The region of the greatest perturbed score of each text: path and place."""
        g, which, where = np.full(docs, -np.inf), np.full(docs, -1), np.full(docs, -1)
        for p, path in enumerate(paths):
            has = np.flatnonzero(path["end"] > path["begin"])
            if not len(has):
                continue
            top = np.full(docs, -np.inf)
            top[has] = np.maximum.reduceat(path["g"], path["begin"][has])
            at = np.flatnonzero(path["g"] == top[path["owner"]])
            place = np.full(docs, -1)
            place[path["owner"][at][::-1]] = at[::-1] - path["begin"][path["owner"][at][::-1]]
            better = top > g
            g, which, where = np.where(better, top, g), np.where(better, p, which), np.where(better, place, where)
        return {"g": g, "path": which, "place": where}

    def _redraw(self, paths, best, live, rank, start, keys, word_doc, word_place, word_end):
        """Paths of the popped regions: the beginning of the path that was split, another edge, then fresh draws."""
        docs = len(word_end)
        split = np.where(best["g"] > -np.inf, best["place"], -1)
        taken = [np.full(docs, -1) for _ in range(len(paths) + 1)]
        keep_edges, keep_words, keep_owner = [], [], []
        for p, path in enumerate(paths):
            mine = live[best["path"][live] == p]
            if not len(mine):
                continue
            at = path["begin"][mine] + best["place"][mine]
            taken[0][mine] = path["edges"][at]
            if path["excluded"] is not None:  # edges that the region avoids already
                same = mine[path["split"][mine] == best["place"][mine]]
                for slot, e in enumerate(path["excluded"]):
                    taken[slot + 1][same] = e[same]
            path["g"][at] = -np.inf  # popped
            size = best["place"][mine]
            pos = np.repeat(path["begin"][mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            keep_edges.append(path["edges"][pos])
            keep_words.append(path["word_of"][pos])
            keep_owner.append(np.repeat(mine, size))
        used = [taken[0], *[t for t in taken[1:] if (t >= 0).any()]]
        word = np.full(docs, -1)
        for p, path in enumerate(paths):
            mine = live[best["path"][live] == p]
            word[mine] = path["word_of"][path["begin"][mine] + best["place"][mine]] if len(mine) else word[mine]
        first = self._other_edge([t[live] for t in used], uniform(keys[live], 1 + 2 * rank, split[live] + (1 << 40)))
        # The rest of the split word from the new edge on, and all words after it.
        rest = word_end[live] - word[live]
        words = np.repeat(word[live] - (np.cumsum(rest) - rest), rest) + np.arange(int(rest.sum()))
        node, forced = start[words].copy(), np.full(len(words), -1)
        forced[np.cumsum(rest) - rest] = first
        fresh, counts = self._walk(node, keys[word_doc[words]], word_place[words], 1 + 2 * rank, forced)
        new_words = np.repeat(words, counts)
        edges = np.concatenate([*keep_edges, fresh])
        word_of = np.concatenate([*keep_words, new_words])
        owner = np.concatenate([*keep_owner, word_doc[new_words]])
        order = np.argsort(owner, kind="stable")
        return edges[order], word_of[order], owner[order], used, split


def _rows(held, k: int, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(vocabulary(held.value))
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for begin, end, texts in in_chunks(batch, text, TEXT_CHARS):
                got = sampler.run(texts, key[begin:end], k)
                rows = batch.slice(begin, end - begin).take(pa.array(got["text"]))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(got["sizes"])]), pa.int32()), pa.array(got["ids"], pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(i) for i, c in enumerate(batch.schema.names[:-1]) if c in columns], pa.array(got["rank"], pa.int32()), pa.array(got["sizes"], pa.int64()), ids,
                    pa.array(got["log"], pa.float64()), pa.array(got["perturbed"], pa.float64()), pa.array(got["inclusion"], pa.float64())], [*columns, *ADDED])

    return run


ADDED = {"sample": T.IntegerType(), "n_pieces": T.LongType(), "piece_ids": T.ArrayType(T.IntegerType()), "log_prob": T.DoubleType(), "perturbed": T.DoubleType(), "inclusion": T.DoubleType()}


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read where the job is planned."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _seeded(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, T.StructType]:
    """Rows of ``keep``, the text and the seed, and the schema of their segmentations."""
    keep = tuple(c for c in keep if c not in ADDED)
    names = [c for c in docs.columns if c in keep or c == text]
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in names], F.xxhash64(key).alias("_seed"))
    return rows, T.StructType([f for f in rows.schema.fields if f.name in keep] + [T.StructField(n, t) for n, t in ADDED.items()])


def sampled(docs: DataFrame, model: bytes, k: int = SAMPLES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with the columns ``keep``, sample (1 to k, by perturbed score), n_pieces, piece_ids, log_prob, perturbed, inclusion.

    A text with fewer segmentations than ``k`` has a row for each, of inclusion 1; the empty text and null have one, of
    no pieces. Rows of equal key and text get equal rows. Columns named like the added ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema = _seeded(docs, key, text, keep)
    return rows.mapInArrow(_rows(held, k, text, [f.name for f in schema.fields if f.name not in ADDED]), schema)


def texts_of(raw: pa.Array, lists: pa.ListArray) -> list[str | None]:
    """The text of each list of pieces, without the space before it."""
    ids = lists.flatten()
    if ids.null_count:
        raise ValueError("a piece is null")
    flat = raw.take(ids)  # the pieces' bytes lie in a row
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    cuts = at[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
    data = memoryview(flat.buffers()[2] or b"")
    return [str(data[a:b], "utf-8", "surrogatepass")[1:] if ok else None for a, b, ok in zip(cuts[:-1], cuts[1:], lists.is_valid().to_pylist(), strict=True)]


def _decoded(held, at: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = raw_array(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED):
                part = batch.slice(lo, DECODED)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts_of(raw, part.column(at)), pa.string())], [*batch.schema.names, out])

    return run


def decoded(rows: DataFrame, model: bytes, ids: str = "piece_ids", out: str = "text") -> DataFrame:
    """All rows and columns with the text of the pieces; null pieces give null."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop(out)
    at = rows.columns.index(ids)
    return rows.mapInArrow(_decoded(held, at, out), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def _gives_back(of_rows, of_ids, text: str, names: list[str], out: str):
    """``of_rows``, then ``of_ids`` on what it gives, batch by batch; whether each decoded text is the row's own, null as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_ids(of_rows(batches)):
            same = pc.equal(batch.column(out), pc.fill_null(batch.column(text), ""))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], same], [*names, out])

    return run


def sampled_and_decoded(docs: DataFrame, model: bytes, k: int = SAMPLES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "gives_text_back") -> DataFrame:
    """Rows of ``sampled`` and whether ``decoded`` makes each one's text of its pieces.

    Both run in one worker one after the other, so texts and pieces do not travel to the JVM and to a second worker between.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema = _seeded(docs, key, text, (*keep, text))
    names = [f.name for f in schema.fields if f.name in keep or f.name in ADDED]
    step = _gives_back(_rows(held, k, text, [f.name for f in schema.fields if f.name not in ADDED]), _decoded(held, schema.names.index("piece_ids"), out), text, names, out)
    return rows.mapInArrow(step, T.StructType([*[schema[n] for n in names], T.StructField(out, T.BooleanType())]))
