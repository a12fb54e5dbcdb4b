"""SentencePiece segmentations: distinct samples from the lattice, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm import tokens
from pulseweave.llm.common import query, table
from pulseweave.llm.tokens import lists, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Power of the pieces' probabilities: the smaller, the more different the samples.
SMOOTHING = 0.3
#: Different segmentations of a text, so that the search goes on from several branches of several samples.
SAMPLES = 8
#: Code points that are worked on at a time; a longer text makes a run of its own.
CHUNK = 1 << 19
#: Steps of a text whose branches are looked at first, and what a perturbed score can exceed its log-probability by.
WINDOW, FARTHEST = 32, 37.0
_BITS = 20
_SPACE, _LITERAL = 0x2581, 0x110001


class Pieces:
    """A SentencePiece vocabulary as hash tables.

    The file ranks its pieces and has no probabilities, so a piece of rank r gets the
    share 1 / (r + 2) of them (Zipf's law); a byte gets that of the last rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int32)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                raw[i] = bytes([value])
        share = 1.0 / (np.arange(len(ids)) + 2.0)
        self.logp = np.full(n + 1, -np.inf)  # the last one is of no piece
        self.logp[ids] = SMOOTHING * np.log(share / share.sum())
        self.byte_logp = self.logp[ids].min()
        prefixes: dict[str, int] = {}
        self.joins = np.zeros(_LITERAL + 1, bool)
        for i in ids:
            piece = sp.id_to_piece(i)
            raw[i] = piece.replace("▁", " ").encode()
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], -1)
            prefixes[piece] = i
            if len(piece) > 1:
                self.joins[[ord(c) for c in piece]] = True
        self.longest = max(map(len, prefixes))
        up, _ = powers(self.longest + 1)
        h = [(np.array([ord(c) + 1 for c in p], np.uint64) * up[:len(p)]).sum(dtype=np.uint64) for p in prefixes]
        h = mix(np.array(h, np.uint64))
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.fromiter(prefixes.values(), np.int32)[order]
        # Where the hashes with the same leading bits begin, and how many share them at most.
        self.begin = np.searchsorted(self.hashes, np.arange(1 << _BITS, dtype=np.uint64) << np.uint64(64 - _BITS))
        self.begin = np.append(self.begin, len(h))
        self.crowd = int(np.diff(self.begin).max(initial=0))
        self.hashes = np.append(self.hashes, np.zeros(self.crowd, np.uint64))
        self.begin = self.begin.astype(np.int32)
        # Single characters by code point: their piece or -1, and -2 where no piece begins.
        self.single = np.full(_LITERAL + 1, -2, np.int32)
        for piece, i in prefixes.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self.id_logp = self.logp[:n].copy()
        self.id_logp[self.byte_ids] = self.byte_logp
        self.raw = pa.array(raw, pa.large_binary())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the table, or -1."""
        lead = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        place = self.begin[lead]
        hit = self.hashes[place] == h
        more = np.flatnonzero(~hit & (self.begin[lead + 1] - place > 1))
        for k in range(1, self.crowd):
            later = place[more] + k
            same = self.hashes[later] == h[more]
            place[more[same]] = later[same]
            hit[more[same]] = True
        return np.where(hit, place, -1)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids.  The blank that encoding puts first goes."""
        _, ends, data = self.raw.take(pa.array(ids)).buffers()
        data, ends = (data or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(ends, np.int64)
        borders = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + 1:b].decode("utf-8", "replace") if b > a else "" for a, b in zip(borders[:-1], borders[1:])]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def uniform(keys: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Lattice:
    """The lattices of the texts of a run.

    No piece crosses the start of a run of blanks, nor a character that only stands alone,
    so a text is a sequence of units and its lattice one after the other.  Equal units
    share one lattice: its rows are the positions, its columns the lengths of pieces less 1.
    """

    def __init__(self, texts: list[str], pieces: Pieces):
        self.pieces = pieces
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        joined = "".join(" " + t for t in texts if t)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[codes == _SPACE] = _LITERAL
        codes[codes == 0x20] = _SPACE
        n = len(codes)
        cut = np.ones(n, bool)
        blank, joins = codes == _SPACE, pieces.joins[codes]
        cut[1:] = (blank[1:] & ~blank[:-1]) | ~joins[1:] | ~joins[:-1]
        first = np.cumsum(lengths) - lengths
        cut[first[lengths > 0]] = True
        starts = self.starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        unit, distinct = pd.factorize((mix((sums[ends] - sums[starts]) * down[starts])).view(np.int64))
        known = np.zeros(len(distinct), np.int64)
        known[unit[::-1]] = np.arange(len(unit))[::-1]
        self.docs = len(texts)
        self.occ_doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
        self.occ_first = np.searchsorted(self.occ_doc, np.arange(self.docs + 1))
        # Units by falling size, rows by what is left of the unit: the units that have so
        # much left are then the first ones of every smaller level, and each level is one
        # slice.  A row is ``level[left] + unit``; left 0 is the end.
        order = np.argsort(-(ends - starts)[known], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = known[order]
        size = (ends - starts)[known]
        self.occ_unit = rank[unit]
        self.occ_size = size[self.occ_unit]
        deepest = int(size[0]) if len(size) else 0
        held = np.searchsorted(-size, -np.arange(deepest + 1), side="right")
        self.level = np.cumsum(held) - held
        self.left = np.repeat(np.arange(deepest + 1), held)
        rows = len(self.left)
        owner = np.arange(rows) - self.level[self.left]
        at = starts[known][owner] + size[owner] - self.left
        alive = np.arange(held[0] if len(held) else 0, rows)
        self.codes = np.zeros(rows, np.uint32)
        self.codes[alive] = codes[at[alive]]
        self.choices = np.zeros(rows, np.int64)
        self.bytes_only = self.left > 0
        single = pieces.single[self.codes[alive]]
        is_piece = single >= 0
        found = [(alive[is_piece], single[is_piece])]
        self.bytes_only[alive[is_piece]] = False
        alive = alive[(single > -2) & (self.left[alive] > 1)]
        here = at[alive]
        base, scale = sums[here], down[here]
        for k in range(2, pieces.longest + 1):
            if not len(alive):
                break
            place = pieces.find(mix((sums[here + k] - base) * scale))
            hit = np.flatnonzero(place >= 0)
            place = pieces.ids[place[hit]]
            is_piece = place >= 0
            found.append((alive[hit[is_piece]], place[is_piece]))
            hit = hit[self.left[alive[hit]] > k]
            alive, here, base, scale = alive[hit], here[hit], base[hit], scale[hit]
        while len(found) > 1 and not len(found[-1][0]):
            found.pop()
        longest = self.longest = len(found)
        self.ids = np.full((longest, rows), -1, np.int32)
        score = self.score = np.full((longest, rows), -np.inf)
        for k, (r, i) in enumerate(found):
            self.ids[k, r] = i
            score[k, r] = pieces.logp[i]
            self.choices[r] += 1
        self.codes[self.codes == _LITERAL] = _SPACE
        self.width = 1 + (self.codes > 0x7F).astype(np.int64) + (self.codes > 0x7FF) + (self.codes > 0xFFFF)
        score[0, self.bytes_only] = self.width[self.bytes_only] * pieces.byte_logp
        self.choices[self.bytes_only] += 1
        # Backward sums, a level at a time.
        total = self.total = np.zeros(rows)
        below = self.below = np.empty((longest, rows), np.float32)
        for d in range(1, deepest + 1):
            n, first = held[d], self.level[d]
            reach = min(d, longest)
            values = score[:reach, first:first + n].copy()
            for k in range(reach):
                start = self.level[d - k - 1]
                values[k] += total[start:start + n]
            top = values.max(axis=0)
            share = np.exp(values - top)
            whole = share.sum(axis=0)
            total[first:first + n] = top + np.log(whole)
            np.cumsum(share, axis=0, out=share)
            share /= whole
            below[:reach, first:first + n] = share
        # The last choice of a row takes what rounding leaves of the sum.
        later = np.zeros(rows, bool)
        for k in range(longest - 1, -1, -1):
            np.copyto(below[k], 2.0, where=~later)
            later |= score[k] > -np.inf

    def step_logp(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Log-probability of a step, given its position."""
        after = row - self.level[self.left[row]] + self.level[np.maximum(self.left[row] - column - 1, 0)]
        return self.score[column, row] + self.total[after] - self.total[row]

    def walk(self, unit: np.ndarray, left: np.ndarray, keys: np.ndarray):
        """Sample a way to the end of each unit of which so much is left: (walk, row, column, log-probability) of all steps, in order."""
        n, steps = self.draw(unit, left, keys)
        column, row = np.divmod(steps, len(self.left))
        return np.repeat(np.arange(len(n)), n), row, column, self.step_logp(row, column)

    def draw(self, unit: np.ndarray, left: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same walks as steps per walk and all steps in order.

        A step is its place in the flat tables, ``column * rows + row``.
        """
        n = np.zeros(len(unit), np.int64)
        who = np.flatnonzero(left)
        unit, left, keys, found = unit[who], left[who], keys[who], []
        row, rows = self.level[left] + unit, len(self.left)
        while len(who):
            u = uniform(keys + np.uint64(len(found) * 0x2545F491)).astype(np.float32)
            column, rest, at = np.zeros(len(who), np.int64), None, row
            for k in range(self.longest - 1):
                higher = np.flatnonzero(self.below[k].take(at) <= u)
                if not len(higher):
                    break
                rest, at, u = higher if rest is None else rest[higher], at[higher], u[higher]
                column[rest] = k + 1
            found.append((who, column * rows + row))
            left = left - column - 1
            on = left > 0
            n[who[~on]] = len(found)
            more = np.flatnonzero(on)
            who, unit, left, keys = who[more], unit[more], left[more], keys[more]
            row = self.level[left] + unit
        first = np.cumsum(n) - n
        steps = np.empty(int(n.sum()), np.int64)
        for k, (who, step) in enumerate(found):
            steps[first[who] + k] = step
        return n, steps

    def step_ids(self, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of steps, and where those of each text begin: a character out of vocabulary is its bytes."""
        found = self.ids.reshape(-1).take(steps)
        odd = np.flatnonzero(found < 0)
        if not len(odd):
            return found, first
        n = np.ones(len(steps), np.int64)
        n[odd] = self.width[steps[odd] % len(self.left)]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.repeat(found, n)
        text = self.codes[steps[odd] % len(self.left)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = n[odd]
        ids[np.repeat(ends[odd] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = self.pieces.byte_ids[data]
        return ids, ends[first]


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges that begin at ``first`` and are ``n`` long, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Path:
    """One sampled segmentation of each of some texts, with the branches that leave it.

    Scores of branches fall with the probability of what lies before them, so they are made
    for the first steps of each text; ``rest`` is what the others can reach at most, and
    :meth:`extend` looks at more of them.
    """

    def __init__(self, lattice, first, steps, start, taken, bound, seeds, number):
        self.lattice, self.first, self.steps, self.start, self.taken = lattice, first, steps, start, taken
        self.bound, self.seeds, self.number = bound, seeds, number
        self.gone: list[np.ndarray] = []
        self.ends = np.minimum(first[:-1] + start + WINDOW, first[1:])
        self.rest, self.top = np.full((2, lattice.docs), -np.inf)
        self.at = self.doc = self.branch = np.empty(0, np.int64)
        self._look(np.flatnonzero(np.diff(first)))

    def _look(self, docs: np.ndarray) -> None:
        lattice, first = self.lattice, self.first
        n = self.ends[docs] - first[docs]
        at, doc = ragged(first[docs], n), np.repeat(docs, n)
        column, row = np.divmod(self.steps[at], len(lattice.left))
        logp = lattice.step_logp(row, column)
        before = np.concatenate([[0.0], np.cumsum(logp)])
        begin = np.cumsum(n) - n
        self.rest[docs] = np.where(self.ends[docs] < first[docs + 1], before[begin + n] - before[begin] + FARTHEST, -np.inf)
        # Only steps drawn anew, with choices left, can be branched.
        steps = np.flatnonzero((at >= (first[:-1] + self.start)[doc]) & (lattice.choices[row] > 1))
        before = before[steps] - np.repeat(before[begin], n)[steps]
        at, doc, row, column, used = at[steps], doc[steps], row[steps], column[steps], logp[steps]
        nth = at - first[doc]
        n_taken = np.ones(len(steps), np.int64)
        several = np.flatnonzero((nth == self.start[doc]) & (self.taken[doc] & (self.taken[doc] - 1) != 0))
        for c in range(lattice.longest):
            extra = several[(self.taken[doc[several]] >> c & 1 == 1) & (column[several] != c)]
            if not len(extra):
                continue
            used[extra] = np.logaddexp(used[extra], lattice.step_logp(row[extra], np.full(len(extra), c)))
            n_taken[extra] += 1
        with np.errstate(divide="ignore", over="ignore"):
            mass = before + np.log(-np.expm1(np.minimum(used, 0.0)))
            mass[several] = np.where(lattice.choices[row[several]] > n_taken[several], mass[several], -np.inf)
            # The best perturbed score below a branch is a Gumbel value cut off at that of its parent.
            key = self.seeds[doc] + np.uint64(self.number * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
            waste = -np.log(np.minimum(uniform(key ^ np.uint64(0xABCDEF)), 1.0 - 2.0 ** -53))
            branch = np.where(np.isfinite(mass), mass - np.log(np.exp(mass - self.bound[doc]) + waste), -np.inf)
        branch[np.isin(at, self.gone)] = -np.inf
        again = np.zeros(lattice.docs, bool)
        again[docs] = True
        old = ~again[self.doc]
        self.at, self.doc, self.branch = (np.concatenate([a[old], b]) for a, b in ((self.at, at), (self.doc, doc), (self.branch, branch)))
        self.top[docs] = -np.inf
        np.maximum.at(self.top, doc, branch)

    def extend(self, docs: np.ndarray) -> None:
        """Look at eight times as many steps of some texts."""
        begin = self.first[docs] + self.start[docs]
        self.ends[docs] = np.minimum(begin + 8 * (self.ends[docs] - begin), self.first[docs + 1])
        self._look(docs)

    def pop(self, docs: np.ndarray) -> np.ndarray:
        """The steps at which some texts have their best branch, which is gone then."""
        mine = np.zeros(self.lattice.docs, bool)
        mine[docs] = True
        hit = np.flatnonzero(mine[self.doc] & np.isfinite(self.branch) & (self.branch == self.top[self.doc]))
        hit = hit[np.unique(self.doc[hit], return_index=True)[1]]
        self.gone.extend(self.at[hit])
        self.branch[hit] = self.top[docs] = -np.inf
        np.maximum.at(self.top, self.doc, self.branch)
        return self.at[hit]


def best_branches(paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """The largest perturbed score among each text's branches, and whose it is."""
    while True:
        scores = np.stack([p.top for p in paths])
        best = scores.max(axis=0)
        short = [(p, np.flatnonzero(p.rest > best)) for p in paths]
        if not any(len(docs) for _, docs in short):
            return best, scores.argmax(axis=0)
        for p, docs in short:
            if len(docs):
                p.extend(docs)


def sample(texts: list[str], seeds: np.ndarray, k: int, pieces: Pieces):
    """Gumbel top-k over the lattice: distinct segmentations in falling perturbed score.

    A search in the manner of A* sampling (Maddison et al.; Kool et al., "Stochastic Beams
    and Where to Find Them"): a node is a prefix of pieces, its perturbed score the largest
    of all segmentations with it, and the child that holds that one is drawn by its
    probability, the other children sharing a cut-off Gumbel value.  Popping the best node
    k times gives a sample of k segmentations without replacement.

    Yields, per path, (texts, log-probability, perturbed score, ids, ids per text); then
    the best perturbed score that is left of each text.
    """
    lattice = Lattice(texts, pieces)
    docs, rows = lattice.docs, len(lattice.left)
    bound = -np.log(-np.log(uniform(seeds)))
    nth = np.arange(len(lattice.occ_doc)) - lattice.occ_first[lattice.occ_doc]
    nth = nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    keys = lambda occ, number: mix(seeds + np.uint64(number))[lattice.occ_doc[occ]] + nth[occ]
    # A step's log-probability is its score less what telescopes over the steps of a unit.
    total = np.concatenate([[0.0], np.cumsum(lattice.total[lattice.level[lattice.occ_size] + lattice.occ_unit])])
    total = np.diff(total[lattice.occ_first])
    n, steps = lattice.draw(lattice.occ_unit, lattice.occ_size, keys(np.arange(len(lattice.occ_doc)), 1))
    first = np.concatenate([[0], np.cumsum(n)])[lattice.occ_first]
    none = np.zeros(docs, np.int64)
    paths, live = [Path(lattice, first, steps, none, none, bound, seeds, 1)], np.arange(docs)
    for number in range(1, k + 1):
        ids, begin = lattice.step_ids(steps, first)
        held = np.flatnonzero(np.diff(begin))
        logp = np.zeros(docs)
        logp[held] = np.add.reduceat(pieces.id_logp[ids], begin[held]) - total[held] if len(held) else 0.0
        yield live, np.minimum(logp[live], 0.0), bound[live], ids, np.diff(begin)[live]
        best, which = best_branches(paths)
        live = np.flatnonzero(np.isfinite(best))
        if number == k or not len(live):
            break
        cut, step, taken = (np.zeros(docs, np.int64) for _ in range(3))
        head = {}
        for j, parent in enumerate(paths):
            d = live[which[live] == j]
            if not len(d):
                continue
            at = parent.pop(d)
            cut[d], step[d] = at - parent.first[d], parent.steps[at]
            taken[d] = np.where(cut[d] == parent.start[d], parent.taken[d], 0)
            head |= {i: parent.steps[a:b] for i, a, b in zip(d.tolist(), parent.first[d].tolist(), at.tolist())}
        # Another child at the branch, by probability among those not taken yet.
        column, r = np.divmod(step[live], rows)
        taken[live] |= 1 << column
        every = np.arange(lattice.longest)
        logp = lattice.step_logp(np.repeat(r, len(every)), np.tile(every, len(r))).reshape(len(r), -1)
        open_ = np.isfinite(logp) & ((taken[live][:, None] >> every) & 1 == 0)
        weight = np.where(open_, np.exp(logp), 0.0)
        weight = np.where(weight.sum(axis=1, keepdims=True) > 0, weight, open_)
        u = uniform(seeds[live] + np.uint64(number * 7919 + 13)) * weight.sum(axis=1)
        c = np.minimum((np.cumsum(weight, axis=1) <= u[:, None]).sum(axis=1),
                       lattice.longest - 1 - np.argmax(open_[:, ::-1], axis=1))
        taken[live] |= 1 << c
        # From there on everything is drawn anew: the rest of the unit, then later units.
        covered = np.array([(head[i] // rows).sum() + len(head[i]) for i in live.tolist()])
        o = np.searchsorted(lattice.starts, lattice.starts[lattice.occ_first[live]] + covered, side="right") - 1
        n = lattice.occ_first[live + 1] - o
        todo = ragged(o, n)
        begin = lattice.occ_size[todo]
        begin[np.cumsum(n) - n] = lattice.left[r] - c - 1
        drawn, walked = lattice.draw(lattice.occ_unit[todo], begin, keys(todo, number + 1))
        ends = np.cumsum(drawn)[np.cumsum(n) - 1]
        child = c * rows + r
        steps = np.concatenate([part for j, (i, a, b) in enumerate(zip(live.tolist(), [0, *ends.tolist()], ends.tolist()))
                                for part in (head[i], child[j:j + 1], walked[a:b])])
        count = np.zeros(docs, np.int64)
        count[live] = cut[live] + 1 + np.diff(ends, prepend=0)
        first = np.concatenate([[0], np.cumsum(count)])
        bound = best
        paths.append(Path(lattice, first, steps, cut, taken, bound, seeds, number + 1))
    yield None, best if docs else np.empty(0), None, None, None


SAMPLED = "doc_id long, sample int, log_prob double, perturbed double, inclusion double, log_inclusion double, ids array<int>"


def _sampled(k: int, model: str, seed: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            keys = batch.column(0)
            seeds = mix(keys.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1))
            for first, run in tokens.runs(batch.column(1).to_pylist(), CHUNK):
                *found, left = sample(run, seeds[first:first + len(run)], k, pieces)
                for number, (docs, logp, perturbed, ids, n) in enumerate(found, 1):
                    odds = np.minimum(logp - left[1][docs], 700.0)
                    inclusion = -np.expm1(-np.exp(odds))
                    # Of long texts the score is too small for a double, but not its logarithm.
                    with np.errstate(divide="ignore"):
                        log_inclusion = np.where(odds < -30, odds, np.log(inclusion))
                    told = [pa.array(pieces.decode(ids, n), pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(docs + first)), pa.array(np.full(len(docs), number, np.int32)), pa.array(logp),
                        pa.array(perturbed), pa.array(inclusion), pa.array(log_inclusion), lists(ids, n, pa.int32()),
                        *(c.take(pa.array(docs + first)) for c in batch.columns[2:]), *told,
                    ], names=["doc_id", "sample", "log_prob", "perturbed", "inclusion", "log_inclusion", "ids", *batch.schema.names[2:],
                              *["decoded"][:len(told)]])

    return run


def encode(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text: str = "text",
           model: str = MODEL, seed: int = 0, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(id, sample, log_prob, perturbed, inclusion, log_inclusion, ids, *carry): ``samples`` different segmentations of each text.

    Drawn without replacement by the lattice's probabilities, seeded by ``seed`` and the
    row's id, so a row's samples don't depend on its neighbours.  ``inclusion`` is
    ``1 - exp(-exp(log_prob - threshold))`` with the best perturbed score left as the
    threshold; 1 when the text has no further segmentation.  A text with fewer
    segmentations gives fewer rows.  A NULL or empty text has one, of no pieces.  A
    character outside the vocabulary, and a literal U+2581, becomes its bytes, so that
    decoding is exact.  Rows that repeat an id and text repeat their samples; rows
    without id share one seed.  Columns named in ``carry`` go along, others are ignored.
    With ``decoded``, a column of that name holds the ids as text, as :func:`decode` gives it,
    without sending the ids to another worker.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([SAMPLED, *(f"{c} {kinds[c]}" for c in carry), *["decoded string"][:decoded]])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry) \
        .mapInArrow(_sampled(samples, model, seed, decoded), schema).withColumnRenamed("doc_id", id_column)


def decode(encoded: DataFrame, columns: list[str], ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``columns`` of the rows and ``text``, their ids as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            column = batch.column(len(columns))
            counts = np.diff(column.offsets.to_numpy())
            texts = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, "text"])

    kinds = dict(encoded.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", text string"
    return encoded.select(*columns, ids).mapInArrow(run, schema)


@query("op3_pieces")
def op3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    found = encode(table(spark, directory, "documents", "doc_id", "text"), decoded=True)
    return found.select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), "log_prob", "perturbed", "inclusion", "log_inclusion",
        F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"),
    )
