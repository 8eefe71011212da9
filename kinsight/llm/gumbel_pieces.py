"""Distinct sampled segmentations: Gumbel top-k without replacement over a text's piece lattice.

A segmentation is a path through the lattice of vocabulary pieces; its probability is the product of its pieces'
weights, over all paths one. A node of the search is a path's beginning, and stands for all paths that begin so. Its
best perturbed log-probability is known without looking at them: the root's is a Gumbel number, the branch drawn next
inherits it, and the branches not drawn get one truncated at it. The search takes the node with the best value, as A*
does with an exact bound, and completes it by drawing; each node that is taken gives one more sample, in the order of
the perturbed values. All numbers come from a hash of the row's key.

The lattice falls apart where no piece of the vocabulary has the two characters beside each other, so lattices are
built once for each distinct part of a text and remembered; drawing goes over the parts of many texts at once. White
space is handled as by the tokenizer itself: a space in front, and spaces as the mark U+2581.
"""

from __future__ import annotations

import codecs
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import remembered, ship, text_or_empty
from kinsight.llm.encoding import LATIN, gathered
from kinsight.llm.mixing import mixed, uniform

MARK = "▁"
_ENDINGS = ".,;:!?"
SAMPLES = "doc_id long, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids binary"

_SPELLINGS: dict[str, Spellings] = {}


class Lattices:
    """States and their outgoing pieces, in flat arrays.

    A state is a place in a part of a text; its children are pieces, shortest first, with the probability to be
    drawn there (piece weight times the weight of all ways to go on). A weight is the piece's probability by Zipf's
    law on the vocabulary's ranks, to the power ``alpha``: 1 samples by probability, 0 alike; nothing is trained. A character that is no piece is a chain of byte pieces.
    """

    def __init__(self, path: str, alpha: float, limit: int = 8_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.limit, self.bytes, ranks = limit, [0] * 256, {}
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ranks[model.id_to_piece(i)] = (i, min(float(size), -model.get_score(i)))
        total = sum(1 / (r + 1) for _, r in ranks.values()) + 256 / (size + 1)
        self.pieces = {p: (i, (total * (r + 1)) ** -alpha) for p, (i, r) in ranks.items()}
        self.byte_weight = (total * (size + 1)) ** -alpha
        #: Every beginning of a piece; those that are no piece themselves have the id -1.
        self.table = {p[:n]: (-1, 0.0) for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.beside = {p[n : n + 2] for p in self.pieces for n in range(len(p) - 1)}
        # the same for many places at once: beginnings are numbered, and found by their last character's kind
        letters = sorted({c for p in self.table for c in p})
        self.kinds, self.kind = len(letters) + 1, np.zeros(0x110000, np.int64)
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.kinds)
        numbers = {"": 0} | {p: n for n, p in enumerate(self.table, 1)}
        keys = np.array([numbers[p[:-1]] * self.kinds + self.kind[ord(p[-1])] for p in self.table] + [np.iinfo(np.int64).max])
        self.longer = np.argsort(keys)
        self.keys, self.longer = keys[self.longer], self.longer + 1
        self.piece_at = np.array([-1, *[i for i, _ in self.table.values()]], np.int32)
        self.weight_at = np.array([0.0, *[w for _, w in self.table.values()]])
        alone = self.step(np.zeros(self.kinds, np.int64), np.arange(self.kinds))
        self.single = np.where(self.piece_at[alone] >= 0, alone, 0)  # the characters that are pieces, by kind
        #: Up to this length the smallest product of weights is far from the smallest float.
        self.short = int(200 / max(1e-9, -4 * math.log10(self.byte_weight)))
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.cuts, self.begins = array("q", [0]), array("q")
        self.first, self.share = array("q", [0]), array("d")
        self.next, self.piece = array("i"), array("i")

    def views(self) -> None:
        """The arrays as numpy sees them, until the next change."""
        self.at, self.shares = np.frombuffer(self.first, np.int64), np.frombuffer(self.share, np.float64)
        self.to, self.ids = np.frombuffer(self.next, np.int32), np.frombuffer(self.piece, np.int32)

    def release(self) -> None:
        self.at = self.shares = self.to = self.ids = None

    def _edges(self, text: str, i: int) -> list[tuple[float, int, int]]:
        """(weight, end, piece id) of the pieces that begin at a place, shortest first; id -1 for a byte chain."""
        table, n, j, found = self.table, len(text), i + 1, []
        hit = table.get(text[i:j])
        if hit is None or hit[0] < 0:
            found.append((self.byte_weight ** len(text[i].encode("utf-8", "replace")), j, -1))
        while hit is not None:
            if hit[0] >= 0:
                found.append((hit[1], j, hit[0]))
            j += 1
            if j > n:
                break
            hit = table.get(text[i:j])
        return found

    def _build(self, parts: list[str]) -> None:
        """Lattices of new parts: together where all characters are pieces and the part is short, else one by one."""
        short = [t for t in parts if len(t) <= self.short]
        if short:
            codes = np.frombuffer("".join([f"{t}\n" for t in short]).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(t) + 1 for t in short]) - 1
            kinds = self.kind[codes]
            kinds[ends] = 0
            alone = self.single[kinds]
            fit = alone > 0
            fit[ends] = True
            plain = np.logical_and.reduceat(fit, np.concatenate([[0], ends[:-1] + 1]))
            if not plain.all():
                kept = np.repeat(plain, np.diff(ends, prepend=-1))
                kinds, alone = kinds[kept], alone[kept]
            short = [t for t, p in zip(short, plain.tolist(), strict=True) if p]
        if short:
            self.parts.update(zip(short, self._plain(kinds, alone, np.cumsum([len(t) + 1 for t in short]) - 1).tolist(), strict=True))
        for text in parts:
            if text not in self.parts:
                self.parts[text] = self._general(text)

    def step(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Beginnings of pieces, by number, that are one character longer; 0 where none is."""
        keys = nodes * self.kinds + kinds
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.longer[at], 0)

    def _plain(self, kinds: np.ndarray, alone: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lattices of parts whose characters are all pieces, one state a place: the states at their beginnings.
        ``kinds`` has the parts' characters one after the other, with a place behind each part, at ``ends``; ``alone``
        the beginnings of pieces that these are."""
        places, nodes, found, n = np.arange(len(kinds)), alone, [], 0
        while len(places):  # all pieces at all places, a character longer each time; none goes over an end
            nodes = self.step(nodes, kinds[places + n]) if n else nodes
            on = nodes > 0
            places, nodes, n = places[on], nodes[on], n + 1
            piece = self.piece_at[nodes]
            is_piece = piece >= 0
            found.append((places[is_piece], places[is_piece] + n, piece[is_piece], self.weight_at[nodes[is_piece]]))
        start, end, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")  # shortest first at each place
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(kinds))  # characters up to the part's end
        onward, share = np.ones(len(kinds)), np.empty(len(start))  # weight of all ways from a place to the end
        by_left = np.argsort(left[start].astype(np.uint8 if left.max() < 256 else np.int64), kind="stable")
        levels = np.searchsorted(left[start[by_left]], np.arange(1, left.max() + 2))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            these = by_left[a:b]
            ways, own = weight[these] * onward[end[these]], start[these]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            rank = np.repeat(np.arange(len(first)), np.diff(first, append=len(own)))
            total = np.bincount(rank, ways)
            onward[own[first]] = total
            share[these] = ways / total[rank]
        inside = left > 0
        state = np.where(inside, np.cumsum(inside) - 1 + len(self.first) - 1, -1)
        counts = np.bincount(start, minlength=len(kinds))[inside]
        self._add(share, state[end].astype(np.int32), piece, len(self.share) + np.cumsum(counts))
        return state[np.concatenate([[0], ends[:-1] + 1])]

    def _general(self, text: str) -> int:
        """Lattice of any part, in logarithms, with chains of bytes; only places that can be reached get states."""
        n, logs = len(text), [0.0] * (len(text) + 1)
        out: list[list[tuple[float, int, int]]] = [[]] * n  # (probability, end, piece id), shortest first
        for i in range(n - 1, -1, -1):
            edges = [(math.log(w) + logs[j], j, piece) for w, j, piece in self._edges(text, i)]
            top = max(e[0] for e in edges)
            logs[i] = top + math.log(sum(math.exp(x - top) for x, _, _ in edges))
            out[i] = [(math.exp(x - logs[i]), j, piece) for x, j, piece in edges]
        reached, state, count, base = bytearray(n + 1), [-1] * (n + 1), 0, len(self.first) - 1
        reached[0] = 1
        for i in range(n):
            if reached[i]:
                state[i] = base + count
                count += 1
                for e in out[i]:
                    reached[e[1]] = 1
        share, onto, pieces, first, size, chains = [], [], [], [], len(self.share), []
        for i in range(n):
            if not reached[i]:
                continue
            for p, j, piece in out[i]:
                to = state[j]
                if piece < 0:  # one state for each further byte
                    raw = [self.bytes[b] for b in text[i].encode("utf-8", "replace")]
                    piece, end = raw[0], to
                    for k, b in enumerate(raw[1:]):
                        to = base + count + len(chains) if k == 0 else to
                        chains.append((base + count + len(chains) + 1 if k + 2 < len(raw) else end, b))
                share.append(p)
                onto.append(to)
                pieces.append(piece)
            first.append(size + len(share))
        for to, b in chains:
            share.append(1.0)
            onto.append(to)
            pieces.append(b)
            first.append(size + len(share))
        self._add(np.array(share), np.array(onto, np.int32), np.array(pieces, np.int32), np.array(first, np.int64))
        return state[0]

    def _add(self, share: np.ndarray, onto: np.ndarray, pieces: np.ndarray, first: np.ndarray) -> None:
        """Append the children of new states, and where those of each state end."""
        self.share.frombytes(share.tobytes())
        self.next.frombytes(onto.tobytes())
        self.piece.frombytes(pieces.tobytes())
        self.first.frombytes(first.tobytes())

    def _cut(self, chunk: str) -> tuple[str, ...]:
        """The parts of a chunk. A word with closing punctuation is cut between the two, if at all; other chunks
        wherever no piece goes across."""
        word = chunk.rstrip(_ENDINGS)
        if word[1:].isalpha():
            whole = len(word) == len(chunk) or word[-1] + chunk[len(word)] in self.beside
            return (chunk,) if whole else (word, chunk[len(word) :])
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.beside]
        return tuple(chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True))

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of distinct chunks or of the words of some, given without the mark in front; what is new is built at once. The states at the
        beginnings of the parts of chunk n are ``begins[cuts[n] : cuts[n + 1]]``."""
        numbers = np.array(list(map(self.chunks.get, chunks, repeat(-1))), np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [chunks[i] for i in new.tolist()]
            cut = [(MARK + c,) if c.isalpha() else self._cut(MARK + c) for c in fresh]
            flat, of = list(chain.from_iterable(cut)), self.parts
            missing = [p for p in dict.fromkeys(flat) if p not in of]
            for at in range(0, len(missing), 4000):  # so that what is worked on stays near the processor
                self._build(missing[at : at + 4000])
            self.cuts.extend((len(self.begins) + np.cumsum(list(map(len, cut)))).tolist())
            self.begins.extend([of[p] for p in flat])
            known = len(self.chunks)
            numbers[new] = np.arange(known, known + len(new))
            self.chunks.update(zip(fresh, range(known, known + len(new)), strict=True))
        return numbers

    def _parted(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The states at the beginnings of the parts of distinct chunks, one after the other, and how many each has.
        Words of Latin letters with closing punctuation are cut as ``_cut`` does, but together; what is left of them is
        looked up like a word, so that it is known with any punctuation."""
        words = pc.utf8_rtrim(chunks, characters=_ENDINGS)
        marked = pc.and_(pc.not_equal(words, chunks), pc.match_substring_regex(words, LATIN + "$")).to_numpy(zero_copy_only=False)
        closed, endings = words.filter(pa.array(marked)), pc.replace_substring_regex(chunks.filter(pa.array(marked)), LATIN, "")
        pairs = pc.binary_join_element_wise(
            pc.utf8_slice_codeunits(closed, -1), pc.utf8_slice_codeunits(endings, 0, 1), pa.scalar("", pa.large_string())
        ).dictionary_encode()
        apart = ~np.array([p in self.beside for p in pairs.dictionary.to_pylist()], bool)[pairs.indices.to_numpy()]
        marked[marked] = apart
        endings = endings.filter(pa.array(apart)).dictionary_encode()
        units = pc.if_else(pa.array(marked), words, chunks).dictionary_encode()
        known, marks = self._numbers(units.dictionary.to_pylist()), endings.dictionary.to_pylist()
        self._build([m for m in marks if m not in self.parts])
        cuts = np.array(self.cuts)
        begins = np.concatenate([np.array(self.begins, np.int64), np.array([self.parts[m] for m in marks], np.int64)])
        nothing = len(cuts) - 1  # what each chunk consists of: numbers known, then none, then the endings
        first = np.concatenate([cuts, len(self.begins) + np.arange(len(marks))])
        size = np.concatenate([np.diff(cuts), [0], np.ones(len(marks), np.int64)])
        both = np.full((len(chunks), 2), nothing)
        both[:, 0] = known[units.indices.to_numpy()]
        both[marked, 1] = nothing + 1 + endings.indices.to_numpy()
        return gathered(begins, first[both.ravel()], size[both.ravel()]), size[both].sum(axis=1)

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the states at the beginnings of its parts."""
        if len(self.share) > self.limit or len(self.chunks) > 400_000:  # some 3 million states, of some 400,000 parts
            self.forget()
        # a chunk is a mark and what goes up to the next; where marks follow each other, all of them and what follows
        spaced = [text.replace(MARK, " ") for text in texts]
        odd = [i for i, text in enumerate(spaced) if not text or text[0] == " " or "  " in text]
        runs = [[c[1:] for c in re.findall(" +[^ ]*", " " + spaced[i])] if spaced[i] else [] for i in odd]
        for i in odd:
            spaced[i] = None
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        chunks = pa.concat_arrays([split.flatten(), pa.array([c.replace(" ", MARK) for r in runs for c in r], pa.large_string())])
        numbered = chunks.dictionary_encode()
        pool, size = self._parted(numbered.dictionary)
        own = numbered.indices.to_numpy()
        states = gathered(pool, (np.cumsum(size) - size)[own], size[own])
        place = np.concatenate([[0], np.cumsum(size[own])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = [states[place[a] : place[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        begin = bounds[-1]
        for i, r in zip(odd, runs, strict=True):
            out[i] = states[place[begin] : place[begin + len(r)]]
            begin += len(r)
        return out

    def draw(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Complete each state's part by drawing; all pieces (as child numbers) and which state they belong to, in
        order."""
        owner, pieces, step = np.arange(len(states)), [], 0
        owners, current, counts = [], states, np.zeros(len(states), np.int64)
        while len(current):
            u = uniform(mixed(seeds[owner], 100 + step))
            begin, child = self.at[current], self.at[current + 1] - 1  # from the longest piece on
            share = self.shares[child]
            more = np.flatnonzero((u >= share) & (child > begin))
            u, share, shorter, begin = u[more], share[more], child[more], begin[more]
            while len(more):
                u -= share
                shorter -= 1
                child[more] = shorter
                share = self.shares[shorter]
                on = np.flatnonzero((u >= share) & (shorter > begin))
                more, u, share, shorter, begin = more[on], u[on], share[on], shorter[on], begin[on]
            pieces.append(child)
            owners.append(owner)
            counts[owner] += 1
            to = self.to[child]
            on = to >= 0
            owner, current, step = owner[on], to[on].astype(np.int64), step + 1
        first, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
        for step, (owner, child) in enumerate(zip(owners, pieces, strict=True)):
            out[first[owner] + step] = child
        return out, np.repeat(np.arange(len(states)), counts)

    def state_of(self, child: int) -> int:
        return int(np.searchsorted(self.at, child, "right")) - 1

    def children(self, state: int) -> range:
        return range(int(self.at[state]), int(self.at[state + 1]))


def truncated(location: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers with these locations that do not exceed ``bound``."""
    free = location - np.log(-np.log(u))
    near = np.flatnonzero(free > bound - 40)  # elsewhere the bound changes less than a float can hold
    bound = np.broadcast_to(bound, free.shape)[near]
    free[near] = np.minimum(bound, -np.logaddexp(-bound, -free[near]))
    return free


class Path:
    """A sampled segmentation. Its own part begins at ``fork``; the branches not taken from there on are nodes."""

    __slots__ = ("best", "children", "fork", "log_prob", "parts", "perturbed", "tried", "values")

    def __init__(self, children, parts, fork, tried, log_prob, perturbed, values):
        self.children, self.parts, self.fork, self.tried = children, parts, fork, tried
        self.log_prob, self.perturbed, self.values = log_prob, perturbed, values
        self.look()

    def look(self) -> None:
        self.best = float(self.values.max()) if len(self.values) else -math.inf


#: So many branches of a path are looked at first. Those behind begin with a probability that falls from piece to
#: piece; where even the first of them is exp(45) times less likely than the k-th best so far, none is looked at: that
#: one of them would be taken has a chance below 10^-15.
FIRST, HOPELESS = 256, 45.0


def _nodes(lattices, drawn: list[tuple], keys: np.ndarray, sample: int, most: int) -> list[np.ndarray]:
    """For each of ``drawn`` (text, children, logarithms of their shares, fork, tried children, bound) the perturbed
    values of the branches not taken at the first ``most`` pieces from the fork on."""
    sizes = np.array([max(0, min(len(children) - fork, most)) for _, children, _, fork, _, _ in drawn], np.int64)
    ends = np.cumsum(sizes)
    mass, p = np.empty(int(sizes.sum())), np.empty(int(sizes.sum()))
    for (_, children, logs, fork, tried, _), end, size in zip(drawn, ends.tolist(), sizes.tolist(), strict=True):
        if size:
            own = logs[: fork + size]
            mass[end - size : end] = (np.cumsum(own) - own)[fork:]
            p[end - size : end] = lattices.shares[children[fork : fork + size]]
            if len(tried) > 1:
                p[end - size] = math.fsum(lattices.shares[c] for c in tried)
    with np.errstate(divide="ignore"):
        rest = np.where(p < 1 - 1e-12, np.log1p(-np.minimum(p, 1.0)), -np.inf)
    places = np.arange(len(p)) + np.repeat(np.array([d[3] for d in drawn], np.int64) - (ends - sizes), sizes)
    u = uniform(mixed(places.astype(np.uint64) ^ np.repeat(keys[[d[0] for d in drawn]], sizes), 50 + sample))
    with np.errstate(invalid="ignore"):
        values = truncated(mass + rest, np.repeat([d[5] for d in drawn], sizes), u)
    values[~np.isfinite(rest)] = -np.inf
    return np.split(values, ends[:-1])


def sample_group(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """For each text at most ``k`` distinct paths, best perturbed value first, and the value of the next one."""
    return sample_starts(lattices, begun(lattices, texts), keys, k)


def begun(lattices: Lattices, texts: list[str]) -> list[np.ndarray]:
    """For each text the states at the beginnings of its parts, whose lattices are then there."""
    lattices.release()
    starts = lattices.starts(texts)
    lattices.views()
    return starts


def sample_starts(lattices: Lattices, starts: list[np.ndarray], keys: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """``sample_group`` for texts whose lattices are there."""
    found: list[list[Path]] = [[] for _ in starts]
    # what is to be completed: text, path so far, its parts, fork, tried children, states, their parts, bound
    todo = []
    roots = -np.log(-np.log(uniform(mixed(keys, 1))))
    for i, (states, root) in enumerate(zip(starts, roots.tolist(), strict=True)):
        todo.append((i, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, (), states, np.arange(len(states)), root))
    for sample in range(k):
        sizes = [len(t[5]) for t in todo]
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        text_of = np.repeat([t[0] for t in todo], sizes).astype(int)
        seeds = mixed(keys[text_of] ^ mixed(np.concatenate([t[6] for t in todo]) if todo else [], 10 + sample), 2)
        drawn, owners = lattices.draw(np.concatenate([t[5] for t in todo]) if todo else np.zeros(0, np.int64), seeds)
        cuts, completed, parts_of = np.searchsorted(owners, begins), [], []
        logs_drawn = np.log(lattices.shares[drawn])
        for n, (i, before, parts_before, fork, tried, _, parts, bound) in enumerate(todo):
            new = slice(cuts[n], cuts[n + 1])
            children = np.concatenate([before, drawn[new]])
            logs = np.concatenate([np.log(lattices.shares[before]), logs_drawn[new]])
            completed.append((i, children, logs, fork, tried, bound))
            parts_of.append(np.concatenate([parts_before, parts[owners[new] - begins[n]]]))
        looked_at = _nodes(lattices, completed, keys, sample, FIRST) if completed else []
        for now, parts, values in zip(completed, parts_of, looked_at, strict=True):
            i, children, logs, fork, tried, bound = now
            ahead = fork + len(values)
            if ahead < len(children):
                best = np.sort(values)[::-1]
                if len(best) < k or best[k - 1] < logs[:ahead].sum() + HOPELESS:
                    (values,) = _nodes(lattices, [now], keys, sample, len(children))
            found[i].append(Path(children, parts, fork, tried, float(logs.sum()), bound, values))
        if sample == k - 1:
            break
        chances = uniform(mixed(keys, 70 + sample))
        todo = [t for t in (take(lattices, i, paths, starts[i], chances[i], sample) for i, paths in enumerate(found)) if t]
    out = [(paths, max(p.best for p in paths)) for paths in found]
    return out


def take(lattices: Lattices, i: int, paths: list[Path], starts: np.ndarray, chance: float, sample: int):
    """Take the best node of a text's paths: what is to be completed from there, or None when no path is left. ``chance``
    is a number between 0 and 1 that chooses among the branches."""
    path = max(paths, key=lambda p: p.best)
    if path.best == -math.inf or len(paths) != sample + 1:
        return None
    at = int(path.values.argmax())
    bound, step = path.best, path.fork + at
    chosen = int(path.children[step])
    tried = path.tried if at == 0 and path.tried else (chosen,)
    state = lattices.state_of(chosen)
    left = [c for c in lattices.children(state) if c not in tried]
    weights = lattices.shares[left]
    u = chance * weights.sum()
    branch = left[min(int(np.searchsorted(np.cumsum(weights), u, "right")), len(left) - 1)]
    path.values[at] = -np.inf
    path.look()
    part = int(path.parts[step])
    onward = int(lattices.to[branch])
    states, parts = starts[part + 1 :], np.arange(part + 1, len(starts))
    if onward >= 0:
        states, parts = np.concatenate([[onward], states]), np.concatenate([[part], parts])
    before = np.append(path.children[:step], branch)
    return i, before, np.append(path.parts[:step], part), step, (*tried, branch), states, parts, bound


def spans(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Where groups of neighbouring texts begin and end that have about ``most`` characters, or a text more."""
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= most or end == len(texts):
            yield begin, end
            begin, held = end, 0


def lattices_of(path: str, alpha: float) -> Lattices:
    """One per Python worker and set of parameters."""
    known = remembered("gumbel_pieces")
    if (path, alpha) not in known:
        known[path, alpha] = Lattices(path, alpha)
    return known[path, alpha]


def sample_segmentations(docs: DataFrame, path: str, k: int = 3, alpha: float = 0.2, seed: int = 11) -> DataFrame:
    """Up to ``k`` rows per row of ``docs``: doc_id, sample (1 for the best perturbed value), n_pieces, log_prob,
    perturbed, log_inclusion (of being among the first ``k``, given the next value; 0 where no further segmentation
    exists), ids as little-endian 32-bit integers.

    Segmentations of a text are distinct, and fewer than ``k`` only where it has no more. An empty or null text has
    one, without pieces. Rows with equal doc_id and text get equal samples; null identifiers share one seed.
    """
    ship(docs.sparkSession)
    columns = [c.split()[0] for c in SAMPLES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = lattices_of(path, alpha)
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            numbers = np.array([-1 if i is None else i for i in ids], np.int64).view(np.uint64)
            keys, texts = mixed(numbers, seed), list(batch["text"])
            for first, last in spans(texts, 4_000_000):  # lattices are made for many texts at once, samples for fewer
                starts = begun(lattices, texts[first:last])
                for begin, end in spans(texts[first:last], 200_000):
                    rows, own = [], slice(first + begin, first + end)
                    found = sample_starts(lattices, starts[begin:end], keys[own], k)
                    for doc_id, (paths, following) in zip(ids[own], found, strict=True):
                        for place, p in enumerate(paths, 1):
                            gap = p.log_prob - following
                            inclusion = 0.0 if following == -math.inf or gap > 5 else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))
                            rows.append((doc_id, place, len(p.children), p.log_prob, p.perturbed, inclusion, lattices.ids[p.children].tobytes()))
                    yield pd.DataFrame(rows, columns=columns)
                lattices.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, SAMPLES)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """U+FFFD for every byte that belongs to no character."""
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("kinsight.each_byte", _each_byte)


class Spellings:
    """What each id stands for, in bytes: a piece's characters, with spaces for the mark, or a byte piece's one byte.
    Control ids stand for nothing. The unknown id, and every id that the vocabulary doesn't have, is U+2047 between
    spaces, as the library writes it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown, self.of = " \u2047 ".encode(), []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.of.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_unknown(i):
                self.of.append(self.unknown)
            else:
                self.of.append(b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode())

    def text(self, ids: bytes) -> str:
        of, unknown, n = self.of, self.unknown, len(self.of)
        joined = b"".join([of[i] if 0 <= i < n else unknown for i in np.frombuffer(ids, "<i4").tolist()])
        # the space that encoding puts in front; only a piece that begins with the mark, or the byte, can have left it
        front = joined[:1] == b" " and not joined.startswith(unknown)
        return joined[front:].decode("utf-8", "kinsight.each_byte")


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text that the column ``ids`` (little-endian 32-bit integers) spells, in the column ``into``.

    The inverse of ``sample_segmentations``, whichever segmentation was drawn: all samples of a text decode to it,
    except that a U+2581 in the text comes back as the space that it stands for. Null ids have a null text, no ids the
    empty text. Bytes that form no character become U+FFFD, one each. Repeated rows stay, and a column that is called
    like ``into`` is replaced; all other columns are handed through. A row is decoded by itself, so a lost task is
    simply run again, and no more than one batch of rows is in memory.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def spelled(column: pd.Series) -> pd.Series:
        known = _SPELLINGS.get(path) or _SPELLINGS.setdefault(path, Spellings(path))
        return pd.Series([None if v is None else known.text(v) for v in column], dtype=object)

    return rows.withColumn(into, spelled(F.col(ids)))
