"""An adaptive range coder for token ids that mixes predictions of order 0, 1 and 2.

A block of ids is cut into lanes of ``STEPS`` ids.  All lanes are coded side by side, one id of each
at a step, as numpy arrays, so the work per id is a few array operations; the model is shared by
the lanes of a block and starts anew with each block.

Every id is coded by the mixture

    P(id) = w2 [id is what followed the same two ids last] + w1 [id is what followed the same id last] + w0 P0(id)

whose weights are learnt for each pair of confidences that the two higher orders
have; P0 is an adaptive count of the ids that neither of them foresaw.  The first
choice picks the order, a second one codes the id where order 0 was picked.

Each lane has a range coder of 64 bits that emits words of 32 (no carry: a range that
straddles a word is cut short).  After a word is out, a range holds at least 2^32 values, so
totals below that are exact.
"""

from __future__ import annotations

import numpy as np

STEPS = 128
#: Slots for pairs of ids; pairs that share a slot only predict worse.
PAIRS = 1 << 20
PAIR_SHIFT = np.uint32(12)
P1, P2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
TOP_CONFIDENCE = 7
#: Two confidences of 0 to 7, and whether both orders foresee the same id.
CONTEXTS = 128
#: What an id adds to its count of order 0, and a choice to its weight.
U = np.uint64
ID_GAIN, CHOICE_GAIN, CHOICE_LIMIT = U(32), 24, 1 << 16

WORD = U(32)
LOW_WORD = U(0xFFFFFFFF)


class Model:
    """Predictions of one block; encoder and decoder put it through the same steps."""

    def __init__(self, vocab: int, lanes: int):
        none = vocab << 3  # no id yet, no confidence
        self.after_two = np.full(PAIRS, none, dtype=np.int32)
        self.after_one = np.full(vocab + 1, none, dtype=np.int32)
        # Bounds of the three choices in each context: 0, w2, w2 + w1, total.
        self.weights = np.ones((3, CONTEXTS), dtype=np.int64)
        self.bounds = np.zeros((4, CONTEXTS), dtype=U)
        self.counts = np.ones(vocab, dtype=U)
        self.sums = np.zeros(vocab + 1, dtype=U)
        np.cumsum(self.counts, out=self.sums[1:])
        self.before = np.full(lanes, vocab, dtype=np.int32)
        self.last = np.full(lanes, vocab, dtype=np.int32)

    def predict(self, n: int) -> None:
        """Predictions for the first ``n`` lanes."""
        last = self.last[:n]
        # Products wrap around: any bits will do, as long as both sides get the same.
        self.pair = (self.before[:n].view(np.uint32) * P1 + last.view(np.uint32) * P2) >> PAIR_SHIFT
        self.two, self.one = self.after_two[self.pair], self.after_one[last]
        self.from_two, self.from_one = self.two >> 3, self.one >> 3
        self.context = ((self.two & 7) << 4) | ((self.one & 7) << 1) | (self.from_two == self.from_one)
        np.cumsum(self.weights, axis=0, out=self.bounds[1:], dtype=U)
        self.total = self.bounds[3][self.context]

    def interval(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's choice."""
        self.chosen = choice * CONTEXTS + self.context
        flat = self.bounds.reshape(-1)
        start = flat[self.chosen]
        return start, flat[self.chosen + CONTEXTS] - start

    def learn(self, ids: np.ndarray, rare: np.ndarray) -> None:
        """ids of the predicted lanes, and the lanes where order 0 was chosen."""
        n = len(ids)
        self.weights += np.bincount(self.chosen, minlength=3 * CONTEXTS).reshape(3, CONTEXTS) * CHOICE_GAIN
        full = self.weights.sum(axis=0) > CHOICE_LIMIT
        if full.any():
            self.weights[:, full] = self.weights[:, full] + 1 >> 1
        if len(rare):
            np.add.at(self.counts, ids[rare], ID_GAIN)
            np.cumsum(self.counts, out=self.sums[1:])
        fresh = (ids << 3) | 1
        for table, slot, entry, foreseen in (
            (self.after_two, self.pair, self.two, self.from_two), (self.after_one, self.last[:n], self.one, self.from_one),
        ):
            # A foreseen id gains confidence; another one halves it, and takes the place once little is left.
            sure = entry & 7
            less = np.where(sure > 1, entry - sure + (sure >> 1), fresh)
            table[slot] = np.where(foreseen == ids, entry + (sure < TOP_CONFIDENCE), less)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


class Encoder:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=U)
        self.range = np.full(lanes, ~U(0), dtype=U)
        self.lanes, self.words = [], []

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.ndarray | U) -> None:
        """Code [start, start + size) of total for each of the lanes."""
        part = self.range[lanes] // total
        low = self.low[lanes] + part * start
        wide = part * size
        low, wide, out = narrowed(low, wide)
        if len(out):
            self.lanes.append(out if isinstance(lanes, slice) else lanes[out])
            self.words.append((low[out] >> WORD).astype(np.uint32))
            low[out] <<= WORD
            wide[out] <<= WORD
        self.low[lanes], self.range[lanes] = low, wide

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, one after the other, and how many each lane has."""
        n = len(self.low)
        # A range holds at least one value that ends in 32 zeros: one word is enough.
        self.lanes.append(np.arange(n))
        self.words.append((self.low + LOW_WORD >> WORD).astype(np.uint32))
        lanes = np.concatenate(self.lanes)
        return np.concatenate(self.words)[np.argsort(lanes, kind="stable")], np.bincount(lanes, minlength=n)


class Decoder:
    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        # Lanes read zeros beyond their last word.
        ends = np.cumsum(lengths)
        self.words = np.append(words, np.uint32(0)).astype(U)
        self.at, self.end = ends - lengths, ends
        n = len(lengths)
        self.low, self.range = np.zeros(n, dtype=U), np.full(n, ~U(0), dtype=U)
        self.code = np.zeros(n, dtype=U)
        for _ in range(2):
            self.code = (self.code << WORD) | self.next_word(np.arange(n))

    def next_word(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        return self.words[np.where(at < self.end[lanes], at, len(self.words) - 1)]

    def value(self, lanes: np.ndarray | slice, total: np.ndarray | U) -> np.ndarray:
        self.part = self.range[lanes] // total
        return np.minimum((self.code[lanes] - self.low[lanes]) // self.part, total - U(1))

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        """Go on past the interval that ``value`` fell into."""
        low = self.low[lanes] + self.part * start
        wide = self.part * size
        low, wide, out = narrowed(low, wide)
        if len(out):
            which = out if isinstance(lanes, slice) else lanes[out]
            low[out] <<= WORD
            wide[out] <<= WORD
            self.code[which] = (self.code[which] << WORD) | self.next_word(which)
        self.low[lanes], self.range[lanes] = low, wide


def narrowed(low: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that fix a word or are too small for the next symbol, the latter cut at the word's end; places of both."""
    fixed = (low ^ (low + wide)) <= LOW_WORD
    small = ~fixed & (wide <= LOW_WORD)
    if small.any():
        wide = np.where(small, (~low + U(1)) & LOW_WORD, wide)
    return low, wide, np.flatnonzero(fixed | small)


def encoded(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per lane) of a block of ids below ``vocab``."""
    lanes = max(1, -(-len(ids) // STEPS))
    grid = np.zeros(lanes * STEPS, dtype=np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model, coder = Model(vocab, lanes), Encoder(lanes)
    for step in range(min(STEPS, len(ids))):
        n = active(len(ids), lanes, step)
        x = grid[step, :n]
        model.predict(n)
        missed = x != model.from_two
        choice = missed.astype(np.int64) + (missed & (x != model.from_one))
        coder.put(slice(0, n), *model.interval(choice), model.total)
        rare = np.flatnonzero(choice == 2)
        if len(rare):
            y = x[rare]
            coder.put(rare, model.sums[y], model.counts[y], model.sums[-1])
        model.learn(x, rare)
    return coder.done()


def decoded(words: np.ndarray, lengths: np.ndarray, size: int, vocab: int) -> np.ndarray:
    """The ``size`` ids of a block."""
    lanes = len(lengths)
    grid = np.zeros((STEPS, lanes), dtype=np.int32)
    model, coder = Model(vocab, lanes), Decoder(words, lengths)
    for step in range(min(STEPS, size)):
        n = active(size, lanes, step)
        every = slice(0, n)
        model.predict(n)
        v = coder.value(every, model.total)
        choice = (v >= model.bounds[1][model.context]).astype(np.int64) + (v >= model.bounds[2][model.context])
        coder.take(every, *model.interval(choice))
        x = np.where(choice == 0, model.from_two, model.from_one)
        rare = np.flatnonzero(choice == 2)
        if len(rare):
            v = coder.value(rare, model.sums[-1])
            order = np.argsort(v)  # a search for ascending values stays in the cache
            y = np.empty(len(v), dtype=np.int64)
            y[order] = np.searchsorted(model.sums, v[order], side="right") - 1
            coder.take(rare, model.sums[y], model.counts[y])
            x[rare] = y
        grid[step, :n] = x
        model.learn(x, rare)
    return np.ascontiguousarray(grid.T).reshape(-1)[:size]


def active(size: int, lanes: int, step: int) -> int:
    """Lanes that have an id at a step: all, or all but the last."""
    return lanes if (lanes - 1) * STEPS + step < size else lanes - 1
