"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed A* search over the lattice.

The lattice of a text has a node between any two characters and an edge for each vocabulary piece; a character without a
piece of its own has one edge that stands for its bytes. Pieces never join words, so the lattice of a text is the chain of
its words' lattices, and each different word that a worker meets gets one backward pass (log-sum-exp), vectorised over all words.
A piece's log probability follows Zipf's law in its rank: -log(rank + 2), up to a constant that cancels.

Search. Every set of segmentations S that shares a prefix has a perturbed maximum, Gumbel(log P(S)); the A* queue holds such
sets with their maxima as exact priorities. The best set is popped and its maximal segmentation read off top-down (at each
node the maximum goes to an edge with the edge's conditional probability). What remains of the set is split by the word in
which it leaves that path, and each part gets its maximum from the Gumbel distribution cut off at the popped one's. So
the k-th pop is the k-th largest perturbed segmentation: k distinct ones, as if drawn one after another without
replacement. The queue's best after k pops is the threshold kappa of the inclusion scores P(Gumbel(log p) > kappa).

A set is a path's words before some word, any segmentation of that word but those already taken there, and anything
behind. What the taken ones leave of a word is summed over the tree of their pieces, from sums of the other edges and
never by a difference, so a rest of any size keeps its precision and no segmentation is lost however improbable it is.

All texts of a chunk are searched together, with one numpy pass for each pop. Draws are hashes of row key, pop and position, so a row
gives the same samples in any batch, partition or run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import chunks, mix, powers

SAMPLES, SEED = 2, 2024
#: Log probability of each byte of a character that the vocabulary lacks, beside the rarest piece.
BYTE_PENALTY = 2.0
CHUNK = 1 << 20
#: Characters of different words whose lattices a worker keeps (about 70 bytes each).
WORD_CHARS = 3 << 19
#: Up to so many characters before a word's end, probabilities are summed as they are; before that as logarithms.
LINEAR = 12
#: Log probabilities of words before a set are multiples of 1 / GRID: such sums are exact and don't depend on what else is in a chunk.
GRID = 2.0**30
#: Slots of the hash tables of pieces, and of those by which prefixes of pieces are told from most other strings.
SLOTS = 1 << 18
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = "▁"


def _hashes(cp: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``(h[e] - h[s]) * inverse**s`` is the hash of characters s to e."""
    out = np.zeros(len(cp) + 1, _U)
    np.cumsum(mix(cp.astype(_U)) * powers(_BASE, len(cp)), out=out[1:])
    return out


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Vocabulary:
    """The pieces of a SentencePiece model file, by hash, and their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int32)
        usual, scores = [], {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usual.append(i)
                scores[i] = sp.get_score(i)
        self.unknown = sp.unk_id()
        # a piece's rank by score; pieces of blanks, which have a mark instead of a score, rank as their shortest neighbours do
        order = sorted(usual, key=lambda i: (-scores[i], i))
        rank = {i: k for k, i in enumerate(order)}
        rank |= {i: len(self.pieces[i]) for i in usual if not self.pieces[i].strip(_BLANK)}
        self.logp = np.zeros(n)
        for i in usual:
            self.logp[i] = -math.log(rank[i] + 2)
        self.byte_logp = -math.log(len(usual) + 2) - BYTE_PENALTY
        self.longest = max(len(self.pieces[i]) for i in usual)
        hashed = {i: _hashes(_codepoints(self.pieces[i])) for i in usual}
        self.table = []
        for size in range(1, self.longest + 1):
            ids = [i for i in usual if len(self.pieces[i]) == size]
            h = np.array([int(hashed[i][-1]) for i in ids], _U)
            prefix = np.zeros(SLOTS, bool)
            prefix[np.array([int(x[size]) % SLOTS for x in hashed.values() if len(x) > size], np.int64)] = True
            slot, chain = np.full(SLOTS, -1, np.int32), np.full(len(ids) + 1, -1, np.int32)
            for k, at in enumerate((h % _U(SLOTS)).astype(np.int64).tolist()):
                slot[at], chain[k] = k, slot[at]
            self.table.append((h, np.array(ids, np.int32), slot, chain, prefix))
        self.raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.spelled: dict[int, np.ndarray] = {}
        self.lattices = Lattices(self)

    def matches(self, h: np.ndarray, inverse: np.ndarray, source: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that start at the characters ``source`` and fit into ``left`` characters: place in source, id and length."""
        at, out = np.arange(len(source)), []
        for size, (keys, ids, slot, chain, prefix) in enumerate(self.table, 1):
            fits = left[at] >= size
            at = at[fits] if not fits.all() else at
            begin = source[at]
            key = (h[begin + size] - h[begin]) * inverse[begin]
            to = (key & _U(SLOTS - 1)).astype(np.int64)
            some = prefix[to]
            at, key, to = at[some], key[some], to[some]
            if not len(at):
                break
            found, where = slot[to], np.arange(len(at))
            piece = np.full(len(at), -1, np.int32)
            while len(where := where[found >= 0]):
                found = found[found >= 0]
                same = keys[found] == key[where]
                piece[where[same]] = ids[found[same]]
                where, found = where[~same], chain[found[~same]]
            same = piece >= 0
            out.append((at[same], piece[same], np.full(int(same.sum()), size, np.int8)))
        none = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int8))
        return tuple(np.concatenate(x) for x in zip(none, *out, strict=True))

    def spelling(self, character: int) -> np.ndarray:
        """Ids of a character without a piece: of its bytes, or unknown."""
        if character not in self.spelled:
            ids = self.bytes[list(chr(character).encode("utf-8", "replace"))]
            self.spelled[character] = ids if (ids >= 0).all() else np.array([self.unknown], np.int32)
        return self.spelled[character]

    def spelled_out(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.raw_first[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that the model puts in front is dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of the different words of a worker's chunks: the edges at each character with their conditional probabilities.

    The edges of a node stand together, the likeliest first. A word's lattice is built once and kept; when all that is kept
    exceeds WORD_CHARS characters, a chunk starts afresh.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.used = np.empty(0, _U), np.empty(0, np.int64), 0
        self.first = np.zeros(1, np.int32)  # of each node's edges; one more at the end
        self.cum, self.logc = np.empty(0, np.float32), np.empty(0)  # running probability (infinite at the last edge), log probability
        self.piece, self.size = np.empty(0, np.int32), np.empty(0, np.int8)

    def place(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each word's characters begin in the tables; words that are not there yet are added."""
        h = _hashes(cp)
        inverse = powers(_INVERSE, len(cp) + 1)
        key = mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(_U))
        key, first, word = np.unique(key, return_index=True, return_inverse=True)
        new = ~np.isin(key, self.keys, assume_unique=True)
        if self.used + int((ends - starts)[first[new]].sum()) > WORD_CHARS:
            self._empty()
            new[:] = True
        if new.any():
            base = self._add(cp, h, inverse, starts[first[new]], ends[first[new]])
            keys, at = np.concatenate([self.keys, key[new]]), np.concatenate([self.at, base])
            order = np.argsort(keys)
            self.keys, self.at = keys[order], at[order]
        return self.at[np.searchsorted(self.keys, key)][word]

    def _add(self, cp: np.ndarray, h: np.ndarray, inverse: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Builds the lattices of the words from s to e; one backward pass over all of them."""
        v, length = self.v, e - s
        base = np.cumsum(length) - length  # of each word, in the joined characters
        total = int(length.sum())
        source = np.arange(total) + np.repeat(s - base, length)  # where each joined character stands in cp
        left = np.repeat(e, length) - source  # characters up to the end of the word
        at, piece, size = v.matches(h, inverse, source, left)
        lone = np.ones(total, bool)
        lone[at[size == 1]] = False
        lone = np.flatnonzero(lone)
        c = cp[source[lone]]
        logp = np.concatenate([v.byte_logp * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)), v.logp[piece]])
        at, piece, size = np.concatenate([lone, at]), np.concatenate([np.full(len(lone), -1, np.int32), piece]), np.concatenate([np.ones(len(lone), np.int8), size])
        # edges stand by size, those of one size by node: the n-th of a node is the n-th that is met
        count, nth, a = np.zeros(total, np.int64), np.empty(len(at), np.int64), 0
        for b in [len(lone), *(len(lone) + np.searchsorted(size[len(lone) :], np.arange(1, self.v.longest + 1), "right")).tolist()]:
            nth[a:b] = count[at[a:b]]
            count[at[a:b]] += 1
            a = b
        # nodes by characters left, the edges of a node together
        node = np.argsort(left.astype(np.int16) if total and left.max() < 1 << 15 else left, kind="stable")
        start = np.empty(total, np.int64)
        start[node] = np.cumsum(count[node]) - count[node]
        to = start[at] + nth
        logw, ahead, final = np.empty(len(at)), np.empty(len(at), np.int64), np.empty(len(at), bool)
        logw[to], ahead[to], final[to] = logp, at + size, left[at] == size
        p, start, times = np.exp(logw), start[node], count[node]
        beta, log_beta, cond = np.zeros(total + 1), np.zeros(total + 1), np.empty(len(at))
        bounds = np.searchsorted(left[node], np.arange(1, int(left.max(initial=0)) + 2))
        edges = np.append(start, len(at))
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 1):
            if a == b:
                continue
            x, here, own = slice(int(edges[a]), int(edges[b])), start[a:b] - start[a], node[a:b]
            if d <= LINEAR:  # no product of so few probabilities underflows
                w = p[x] * np.where(final[x], 1.0, beta[ahead[x]])
                sums = np.add.reduceat(w, here)
                beta[own], log_beta[own] = sums, np.log(sums)
            else:
                w = logw[x] + np.where(final[x], 0.0, log_beta[ahead[x]])
                top = np.maximum.reduceat(w, here)
                w = np.exp(w - np.repeat(top, times[a:b]))
                sums = np.add.reduceat(w, here)
                log_beta[own] = top + np.log(sums)
            cond[x] = w / np.repeat(sums, times[a:b])
        cond = cond[to]  # as the edges stand
        # nodes by place; a node's likeliest edge first, the others by size
        top, best = np.zeros(total), np.full(total, 1 << 30, np.int64)
        np.maximum.at(top, at, cond)
        likeliest = np.flatnonzero(cond == top[at])
        np.minimum.at(best, at[likeliest], nth[likeliest])
        start = np.cumsum(count) - count
        to = start[at] + np.where(nth == best[at], 0, nth + (nth < best[at]))
        placed = [np.empty(len(at), x.dtype) for x in (cond, piece, size)]
        for new, old in zip(placed, (cond, piece, size), strict=True):
            new[to] = old
        cond, piece, size = placed
        cum, rest = cond.copy(), np.zeros(total)
        for k in range(1, int(count.max(initial=0))):  # added up edge by edge: the same in any chunk
            have = np.flatnonzero(count > k)
            more = start[have] + k
            cum[more] += cum[more - 1]
            rest[have] += cond[more]
        cum[start + count - 1] = np.inf
        with np.errstate(divide="ignore"):
            logc = np.log(cond)
        logc[start] = np.where(cond[start] > 0.5, np.log1p(-np.minimum(rest, 0.5)), logc[start])
        start = np.append(start, len(at))
        self.first = np.concatenate([self.first, (self.first[-1] + start[1:]).astype(np.int32)])
        for name, more in (("cum", cum.astype(np.float32)), ("logc", logc), ("piece", piece), ("size", size)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.used += total
        return base + self.used - total


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


@dataclass
class Path:
    """The segmentations of one pop: the edge taken at each character (-1: none), and for each word the log probability of
    the words before it and the priority of the set that leaves the path in it."""

    edge: np.ndarray
    before: np.ndarray
    priority: np.ndarray


class Rest:
    """A word without some segmentations: the tree of their edges, with the share that is left of each of its nodes."""

    def __init__(self, lattice: Lattices, node: int, taken: list[list[int]]):
        self.lattice = lattice
        self.nodes, self.children = [node], [{}]
        for edges in taken:
            at = 0
            for e in edges:
                if e not in self.children[at]:
                    self.children[at][e] = len(self.nodes)
                    self.nodes.append(self.nodes[at] + int(lattice.size[e]))
                    self.children.append({})
                at = self.children[at][e]
        self.left = [0.0] * len(self.nodes)
        for at in range(len(self.nodes) - 1, -1, -1):  # children come after their parents
            if self.children[at]:
                self.left[at] = math.fsum(x for _, x in self.edges(at))

    def edges(self, at: int) -> list[tuple[int, float]]:
        """The edges of a node of the tree and what is left of each."""
        low, high = int(self.lattice.first[self.nodes[at]]), int(self.lattice.first[self.nodes[at] + 1])
        return [(e, math.exp(x) * (self.left[self.children[at][e]] if e in self.children[at] else 1.0)) for e, x in enumerate(self.lattice.logc[low:high].tolist(), low)]

    def draw(self, uniform: Iterator[float]) -> list[int]:
        """Edges from the word's start up to and with the one that leaves the tree."""
        at, out = 0, []
        while at is not None:
            some = [(e, x) for e, x in self.edges(at) if x > 0]
            goal = next(uniform) * self.left[at]
            for e, x in some:
                goal -= x
                if goal <= 0:
                    break
            out.append(e)
            at = self.children[at].get(e)
        return out


class Search:
    """k pops of the perturbed A* search for each text of a chunk (all texts at once)."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: np.ndarray):
        self.v = v
        self.texts = [v.normalize(t) for t in texts]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.cp = _codepoints("".join(self.texts))
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.keys = keys
        n = len(self.cp)
        blank = self.cp == ord(_BLANK)
        start = np.zeros(n, bool)
        start[self.first[:-1][size > 0]] = True
        start[1:] |= blank[1:] & ~blank[:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.lattice = v.lattices
        base = self.lattice.place(self.cp, self.starts, self.ends)
        self.word = np.cumsum(start, dtype=np.int32) - np.int32(1)
        self.shift = base - self.starts  # from a word's characters to their nodes
        self.word_doc = self.doc[self.starts]
        self.first_word = np.searchsorted(self.starts, self.first)

    def _uniform(self, at: np.ndarray, draw: int) -> np.ndarray:
        d = self.doc[at]
        return _uniform(self.keys[d] + (at - self.first[d]).astype(_U) * _U(0x9E6C63D0876A9A47) + _U(draw * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))

    def _draw(self, at: np.ndarray, pop: int, edge: np.ndarray, logs: np.ndarray) -> None:
        """Edges read off top-down from characters ``at`` to the ends of their words: put in edge, their log probabilities added to their words'."""
        lattice = self.lattice
        while len(at):
            word = self.word[at]
            node = at + self.shift[word]
            e = lattice.first[node]
            open_ = np.flatnonzero(lattice.cum[e] < np.inf)
            u = self._uniform(at[open_], 4 * pop)
            over = lattice.cum[e[open_]] <= u
            while over.any():
                open_, u = open_[over], u[over]
                e[open_] += 1
                over = lattice.cum[e[open_]] <= u
            edge[at] = e
            logs[word] += lattice.logc[e]
            nxt = at + lattice.size[e]
            at = nxt[nxt < self.ends[word]]

    def _edges(self, edge: np.ndarray, word: int) -> list[int]:
        at, end, out = int(self.starts[word]), int(self.ends[word]), []
        while at < end:
            out.append(int(edge[at]))
            at += int(self.lattice.size[out[-1]])
        return out

    def _draws(self, at: int, pop: int) -> Iterator[float]:
        k = 0
        while True:
            yield float(self._uniform(np.array([at]), 4 * ((pop << 20) + k) + 1)[0])
            k += 1

    def run(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]]:
        """For each pop: which texts have one, the edges taken at each character, log probabilities and perturbed maxima.

        Ends with the thresholds kappa as a fifth kind of entry: (texts, None, None, kappa)."""
        docs, words = len(self.texts), len(self.starts)
        alive = np.ones(docs, bool)
        top = -np.log(-np.log(_uniform(self.keys ^ mix(np.full(docs, 0xA11CE, _U)))))
        edge, logs = np.full(len(self.cp), -1, np.int32), np.zeros(words)
        self._draw(self.starts, 0, edge, logs)
        paths: list[Path] = []
        taken: dict[tuple[int, int], list[list[int]]] = {}  # path, word -> segmentations already taken there
        since = self.first_word[:-1].copy()  # the first word of which the popped set leaves more than the path
        some = np.flatnonzero(np.diff(self.first_word))  # texts that have words
        for pop in range(k):
            whole = np.round(logs * GRID) / GRID
            total = np.concatenate([[0.0], np.cumsum(whole)])
            bounds = total[self.first_word]
            before = total[:-1] - bounds[self.word_doc]
            yield alive.copy(), edge, np.diff(bounds), top.copy()
            free = np.flatnonzero((logs < 0) & alive[self.word_doc] & (np.arange(words) >= since[self.word_doc]))
            priority = np.full(words, -np.inf)
            with np.errstate(divide="ignore"):
                priority[free] = self._cut(before[free] + np.log(-np.expm1(logs[free])), top[self.word_doc[free]], self.starts[free], 4 * pop + 2)
            paths.append(Path(edge, before, priority))
            # the best set of each text over all paths
            best, path, where = np.full(docs, -np.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            for a, one in enumerate(paths):
                m = np.full(docs, -np.inf)
                if len(some):
                    m[some] = np.maximum.reduceat(one.priority, self.first_word[some])
                hit = np.flatnonzero((one.priority > -np.inf) & (one.priority == m[self.word_doc]))
                hit = hit[m[self.word_doc[hit]] > best[self.word_doc[hit]]]
                to = self.word_doc[hit]
                best[to], path[to], where[to] = m[to], a, hit
            if pop == k - 1:
                yield np.isfinite(best), None, None, best
                return
            alive = np.isfinite(best)
            top = np.where(alive, best, -np.inf)
            edge, logs = np.full(len(self.cp), -1, np.int32), np.zeros(words)
            # up to the popped word the path is that of the set; behind it there are new draws
            for a, one in enumerate(paths):
                mine = alive & (path == a)
                old = mine[self.word_doc] & (np.arange(words) < where[self.word_doc])
                at = np.flatnonzero(old[self.word] & (one.edge >= 0))
                edge[at] = one.edge[at]
                np.add.at(logs, self.word[at], self.lattice.logc[one.edge[at]])
            restart = []
            for d in np.flatnonzero(alive).tolist():
                a, w = int(path[d]), int(where[d])
                done = taken.setdefault((a, w), [self._edges(paths[a].edge, w)])
                at, node = int(self.starts[w]), int(self.starts[w] + self.shift[w])
                for e in Rest(self.lattice, node, done).draw(self._draws(at, pop)):
                    edge[at] = e
                    logs[w] += self.lattice.logc[e]
                    at += int(self.lattice.size[e])
                if at < self.ends[w]:
                    restart.append(at)
            later = alive[self.word_doc] & (np.arange(words) > where[self.word_doc])
            self._draw(np.concatenate([np.array(restart, np.int64), self.starts[later]]), pop + 1, edge, logs)
            since = np.where(alive, where + 1, 0)
            for d in np.flatnonzero(alive).tolist():  # what still is in the popped set: all but the segmentations taken in its word
                a, w = int(path[d]), int(where[d])
                taken[a, w].append(self._edges(edge, w))
                left, at = Rest(self.lattice, int(self.starts[w] + self.shift[w]), taken[a, w]).left[0], self.starts[w : w + 1]
                paths[a].priority[w] = self._cut(paths[a].before[w : w + 1] + math.log(left), top[d : d + 1], at, 4 * pop + 3)[0] if left > 0 else -np.inf

    def _cut(self, loc: np.ndarray, top: np.ndarray, at: np.ndarray, draw: int) -> np.ndarray:
        """Draws from Gumbel(loc) cut off at top."""
        return loc - np.log(np.exp(np.minimum(loc - top, 700)) - np.log(self._uniform(at, draw)))

    def ids(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        at = np.flatnonzero(edge >= 0)
        found = self.lattice.piece[edge[at]]
        lone = np.flatnonzero(found < 0)
        count = np.ones(len(at), np.int64)
        if len(lone):
            characters, which = np.unique(self.cp[at[lone]], return_inverse=True)
            spelled = [self.v.spelling(int(c)) for c in characters]
            size = np.array([len(x) for x in spelled])
            count[lone] = size[which]
            flat, first, ends = np.concatenate(spelled), np.cumsum(size) - size, np.cumsum(size[which])
            out = np.repeat(found, count)
            out[out < 0] = flat[np.repeat(first[which] - ends + size[which], size[which]) + np.arange(int(ends[-1]))]
            found = out
        return found, np.bincount(self.doc[at], weights=count, minlength=len(self.texts)).astype(np.int64)


def inclusion(logp: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log P(Gumbel(logp) > kappa); 0 where kappa is -inf (all segmentations are included)."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        gap = np.where(np.isfinite(kappa), logp - kappa, np.inf)
        return np.where(gap > 3, np.log1p(-np.exp(-np.exp(np.minimum(gap, 50)))), np.where(gap > -30, np.log(-np.expm1(-np.exp(np.minimum(gap, 3)))), gap))


OUT = "rank int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sample(docs: DataFrame, model_path: str, *, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k rows per row of docs, by rank from 0: sampled ids of the whole text (if asked) and what they score.

    n_tokens; ids_crc32 of the ids as little-endian 32-bit integers; log_prob of the segmentation among all of its text;
    perturbed, its Gumbel value; log_inclusion, the log of its inclusion score; round_trip, whether the ids decode to the
    normalised text. A text with fewer than k segmentations has as many rows as it has (log_inclusion 0). Null counts as
    empty, which has one segmentation, of no pieces. The row key is the id, so rows that repeat id and text get the same
    samples and texts that share an id share its draws; null ids count as one value. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in chunks(batches, limit=CHUNK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = list(_samples(v, texts, batch.column("key").to_numpy().view(_U), k, with_ids))
            order = sorted(found, key=lambda r: (r[0], r[1]))
            columns = list(zip(*order, strict=True))
            ids = batch.column("id").take(pa.array(columns[0], pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), *([pa.list_(pa.int32())] if with_ids else []))
            names = ["id", "rank", "n_tokens", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {OUT}" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def _samples(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int, with_ids: bool) -> Iterator[tuple]:
    search = Search(v, texts, keys)
    plain = np.frombuffer("".join(search.texts).replace(_BLANK, " ").encode("utf-8", "replace"), np.uint8)
    size = np.bincount(search.doc, weights=1 + (search.cp > 0x7F) + (search.cp > 0x7FF) + (search.cp > 0xFFFF) - 2 * (search.cp == ord(_BLANK)), minlength=len(texts)).astype(np.int64)
    first = np.cumsum(size) - size
    pops = []
    for have, edge, logp, value in search.run(k):
        if edge is None:
            kappa = value
            break
        ids, n = search.ids(edge)
        spelled = v.spelled_out(ids)
        ends, spelled_ends = np.cumsum(n), np.concatenate([[0], np.cumsum(v.raw_size[ids])])
        raw = memoryview(ids.astype("<u4").tobytes())
        low = ends - n
        rows = []
        for d in np.flatnonzero(have).tolist():
            back = spelled[spelled_ends[low[d]] : spelled_ends[ends[d]]]
            same = len(back) == size[d] and bool((back == plain[first[d] : first[d] + size[d]]).all())
            rows.append((d, int(n[d]), zlib.crc32(raw[4 * low[d] : 4 * ends[d]]), same, ids[low[d] : ends[d]] if with_ids else None))
        pops.append((rows, logp, value))
    for rank, (rows, logp, value) in enumerate(pops):
        score = inclusion(logp, kappa)
        for d, n_, crc, same, own in rows:
            base = (d, rank, n_, crc, float(logp[d]), float(value[d]), float(score[d]), same)
            yield (*base, own) if with_ids else base


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and ids, the model's own best segmentation. Null counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in chunks(batches):
            out = sp.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and text of the ids. Null ids give a null text; ids outside the vocabulary raise an error."""
    source = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            out = [None if x is None else v.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
