"""Online logistic context mixing over words, in numpy.

A token is first guessed: where its last two words were followed by some word in training, one bit says whether that
word follows again. The guess's counts and the outcomes of the guesses before it are the contexts of this bit. Other
tokens are coded as a symbol of BITS bits and then as one of its symbol's words. Frequent words are symbols of their own;
other head words share symbols by frequency and by group (words that occur among the same frequent words); two symbols
are for words outside the head and for the end. A symbol's bits are predicted by contexts of symbols, classes and groups,
each of which has a place of its own: their number is fixed by these alphabets, so that nothing collides as texts grow.
What grows with the corpus, the pairs of words and what follows them, is kept outside; a token's `code` says what was
found there.

For each bit the predictors' logits are summed with weights that a gate selects, and the sum is refined by an adaptive
table. Weights, refinement and the guess's counts are learned online, step by step; a bit's own count is taken off first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 8
SYMBOLS = 1 << BITS
OWN, GROUPS, RANKS = 126, 8, 16
TAIL, END = SYMBOLS - 2, SYMBOLS - 1
#: Classes of symbols: by group and kind, the tail and the end; words that the usual group is taken from.
CLASSES, WINDOW = 32, 16
#: Values of each context of a symbol's bits: the last symbol, the usual group and last class, the last two classes.
CONTEXTS = (SYMBOLS, (GROUPS + 1) * CLASSES, CLASSES * CLASSES)
OFFSETS = SYMBOLS * np.concatenate(([0], np.cumsum(CONTEXTS)))
SLOTS = int(OFFSETS[-1])
INPUTS = len(CONTEXTS) + 1
SURE, STEPS = 4, 33
#: A guess's code: 0 for none, else 1 + 5 * (how often the guessed word followed) + (how often another), quantised; and
#: whether it is right. Histories are the outcomes (none, wrong, right) of the last three.
GUESSES, HIT, HISTORIES = 26, 128, 27
#: Bits of a word's number among the followers; beyond the head several words share one.
WORD_BITS = 24
#: Tokens that weights are moved by at once.
STEP = 1 << 14


def symbol_table(groups: np.ndarray) -> np.ndarray:
    """Symbol of each head word, by rank; two entries after the last are for words outside the head and for the end."""
    n = len(groups)
    rank = np.arange(n)
    step = np.clip((2 * np.log2(np.maximum(rank, OWN) / OWN)).astype(int), 0, RANKS - 1)
    shared = np.minimum(OWN + groups * RANKS + step, TAIL - 1)
    return np.append(np.where(rank < OWN, rank, shared), [TAIL, END])


def symbol_groups(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, class) of each symbol; GROUPS stands for no group."""
    s = np.arange(SYMBOLS)
    group = np.minimum((s - OWN) // RANKS, GROUPS - 1)
    own = groups[:OWN]
    group[: len(own)] = own
    kind = np.where(s < 16, 0, np.where(s < OWN, 1, 2))
    classes = group * 3 + kind
    group[TAIL:], classes[TAIL:] = GROUPS, (3 * GROUPS, 3 * GROUPS + 1)
    return group, classes


def near_words(ranks: np.ndarray, text: np.ndarray, words: int, anchors: int, into: np.ndarray, reach: int = 2) -> None:
    """Add to `into` (words * anchors) how often each word has each anchor, a most frequent word, within reach.

    `text` tells the texts of the tokens apart; ranks beyond the table (words outside the head, ends) are passed over.
    """
    at = np.flatnonzero(ranks < anchors)
    for d in range(1, reach + 1):
        for other in (at - d, at + d):
            inside = (other >= 0) & (other < len(ranks))
            a, b = at[inside], other[inside]
            same = (text[a] == text[b]) & (ranks[b] < words)
            np.add.at(into, ranks[b[same]] * anchors + ranks[a[same]], 1)


def word_groups(near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Groups of head words from their counts of frequent words nearby (words, anchors), which are overwritten.

    Words hardly ever seen near a frequent one are in group 0.
    """
    head = len(near)
    unit = np.sqrt(near, out=near)
    size = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    unit /= np.maximum(size, 1e-9)[:, None]
    seen = np.flatnonzero(size > 1.5)
    if len(seen) < GROUPS:
        return np.zeros(head, np.int64)
    unit, size = unit[seen], size[seen]
    centre = [0]
    for _ in range(GROUPS - 1):
        centre.append(int(np.argmin((unit[:400] @ unit[centre].T).max(axis=1))))
    c = unit[centre]
    for _ in range(rounds):
        of = np.argmax(unit @ c.T, axis=1)
        for g in range(GROUPS):
            if (of == g).any():
                v = np.sqrt(size[of == g]) @ unit[of == g]
                c[g] = v / max(1e-9, np.sqrt((v * v).sum()))
    out = np.zeros(head, np.int64)
    out[seen] = np.argmax(unit @ c.T, axis=1)
    return out


def _before(x: np.ndarray, d: int, since: np.ndarray, none: int) -> np.ndarray:
    out = np.full(len(x), none, x.dtype)
    if len(x) > d:
        out[d:] = x[:-d]
    out[since < d] = none
    return out


def since_start(first: np.ndarray) -> np.ndarray:
    """How many tokens of its text are before each token; `first` marks each text's first."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def word_contexts(words: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Hash of the two words before each token; a text starts after two words that are none."""
    one, two = (_before(words.astype(np.uint64) + np.uint64(1), d, since, 0) for d in (1, 2))
    return _mixed(one ^ _mixed(two ^ np.uint64(0x9E3779B97F4A7C15)))


def guess_codes(pairs: np.ndarray, counts: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The code of each asked pair (context in the upper bits, follower in the lower WORD_BITS).

    `counts` says how many training tokens of one asker are such a pair, `train` whether it asks for a training token:
    then one count, the token's own, is taken off. The guess is the most frequent follower, of equals the smallest.
    """
    order = np.argsort(pairs)
    p, c = pairs[order], np.where(train, counts, 0)[order].astype(np.int64)
    new = np.append(True, p[1:] != p[:-1])
    starts = np.flatnonzero(new)
    n = np.add.reduceat(c, starts)  # of each distinct pair
    context = p[starts] >> np.uint64(WORD_BITS)
    opens = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    size = np.diff(np.append(opens, len(starts)))
    total, best = np.add.reduceat(n, opens), np.maximum.reduceat(n, opens)
    of = np.repeat(np.arange(len(opens)), size)
    is_best = n == best[of]
    place = np.arange(len(starts))
    top = np.minimum.reduceat(np.where(is_best, place, len(starts)), opens)  # the first of the most frequent
    rest = n.copy()
    rest[top] = -1
    second = np.maximum.reduceat(rest, opens)
    after = np.minimum.reduceat(np.where(rest == second[of], place, len(starts)), opens)
    # Each asked pair, with its own count taken off.
    which = np.cumsum(new) - 1
    own = train[order].astype(np.int64)
    ctx = of[which]
    on_top = which == top[ctx]
    mine = best[ctx] - own
    loses = on_top & (own > 0) & ((mine < second[ctx]) | ((mine == second[ctx]) & (after[ctx] < top[ctx])))
    right = on_top & ~loses
    often = np.where(on_top, np.where(loses, second[ctx], mine), best[ctx])
    all_of = total[ctx] - own
    code = np.where(all_of > 0, 1 + 5 * _quantised(often) + np.minimum(4, _quantised(all_of - often + 1)) + HIT * (right & (often > 0)), 0)
    out = np.empty(len(pairs), np.uint8)
    out[order] = code
    return out


def _quantised(n: np.ndarray) -> np.ndarray:
    """0 for 1, then by powers of two up to 4."""
    return np.minimum(4, np.ceil(np.log2(np.maximum(1, n)))).astype(np.int64)


def contexts(symbols: np.ndarray, since: np.ndarray, group_of: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """(contexts, tokens): the value of each context, as the place of its first slot."""
    n = len(symbols)
    last = _before(symbols, 1, since, END)
    one, two = class_of[last], class_of[_before(symbols, 2, since, END)]
    held = np.append(np.left_shift(np.uint64(1), (8 * np.arange(GROUPS)).astype(np.uint64)), np.uint64(0))
    sums = np.append(np.uint64(0), np.cumsum(held.take(group_of.take(symbols))))  # eight counts in the bytes of a number
    at = np.arange(n)
    window = sums[at] - sums[at - np.minimum(since, WINDOW)]
    usual = np.where(window == 0, GROUPS, window.view(np.uint8).reshape(n, GROUPS).argmax(axis=1))
    out = np.stack([last, usual * CLASSES + one, one * CLASSES + two])
    return out * SYMBOLS + OFFSETS[:-1, None]


def count(symbols: np.ndarray, places: np.ndarray, into: np.ndarray) -> None:
    """Add to `into` (SLOTS) how often each context has each symbol."""
    for k, row in enumerate(places):
        into[OFFSETS[k] : OFFSETS[k + 1]] += np.bincount(row + symbols - OFFSETS[k], minlength=OFFSETS[k + 1] - OFFSETS[k]).astype(into.dtype)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    out = np.negative(z)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _steps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip(z * 2 + STEPS // 2, 0, STEPS - 1.001)
    low = at.astype(np.int64)
    return low, at - low.astype(at.dtype)


class Mixer:
    """Predictors' tables, and the parameters that are learned: weights, refinement, and the guess's."""

    def __init__(self, counts: np.ndarray):
        """`counts` (SLOTS): how often each context has each symbol."""
        by_symbol = counts.reshape(-1, SYMBOLS).astype(np.float64)
        zeros, ones = np.zeros_like(by_symbol), np.zeros_like(by_symbol)
        for depth in range(BITS):
            half = by_symbol.reshape(len(by_symbol), 1 << depth, 2, -1).sum(axis=3)
            zeros[:, 1 << depth : 2 << depth], ones[:, 1 << depth : 2 << depth] = half[:, :, 0], half[:, :, 1]
        zeros, ones = zeros.ravel(), ones.ravel()
        logit = lambda a, b: np.log((np.maximum(a, 0) + 0.4) / (np.maximum(b, 0) + 0.4)).astype(np.float32)
        self.plain = logit(ones, zeros)
        self.without = np.concatenate((logit(ones, zeros - 1), logit(ones - 1, zeros)))
        self.sure = np.minimum(SURE - 1, np.log2(1 + zeros + ones) // 3).astype(np.int64)
        self.weights = np.full((INPUTS, BITS * SURE), 0.3, np.float32)
        self.weights[-1] = 0
        self.refined = np.tile(_sigmoid((np.arange(STEPS) - STEPS // 2) / 2.0), (SYMBOLS, 1))
        self.seen = np.full((2, GUESSES * (HISTORIES + 1) + HISTORIES), 0.5)
        self.guess_weights = np.tile(np.array([0.4, 0.4, 0.2, 0.0]), (GUESSES, 1))

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel().astype(np.float64) for x in (self.weights, self.refined, self.seen, self.guess_weights)])

    def with_parameters(self, flat: np.ndarray) -> Mixer:
        """A model of the same tables with these parameters as its own."""
        other, at = Mixer.__new__(Mixer), 0
        other.plain, other.without, other.sure = self.plain, self.without, self.sure
        for name in ("weights", "refined", "seen", "guess_weights"):
            own = getattr(self, name)
            setattr(other, name, flat[at : at + own.size].reshape(own.shape).astype(own.dtype))
            at += own.size
        return other

    def _bits(self, symbols: np.ndarray, places: np.ndarray, own: bool) -> Iterator[tuple]:
        """For each bit: its depth, the inputs with a constant, the bit, how much is known (SURE levels), and the sum of
        the weighted inputs."""
        x = np.full((INPUTS, len(symbols)), 0.3, np.float32)
        everyone, table = np.arange(len(symbols)), self.without if own else self.plain
        for depth in range(BITS):
            node = (symbols >> (BITS - depth)) + (1 << depth)
            bit = (symbols >> (BITS - 1 - depth)) & 1
            slots = places + node
            sure = self.sure.take(slots[-1])
            table.take(slots + bit * SLOTS if own else slots, out=x[:-1], mode="clip")
            z = (self.weights[:, depth * SURE : (depth + 1) * SURE].T @ x).ravel().take(sure * len(symbols) + everyone)
            yield depth, x, bit, sure, np.clip(z, -12, 12, out=z)

    def _history(self, code: np.ndarray, since: np.ndarray) -> np.ndarray:
        outcome = np.where(code == 0, 0, 1 + (code >= HIT)).astype(np.int64)
        return sum(3**k * _before(outcome, k + 1, since, 0) for k in range(3))

    def _guess(self, code: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For codes that have a guess: the predictors' places, their logits with a constant, and the sum."""
        kind = (code % HIT).astype(np.int64)
        places = np.stack([kind, GUESSES + kind * HISTORIES + history, GUESSES * (HISTORIES + 1) + history])
        x = np.append(np.log(self.seen[1][places] / self.seen[0][places]), np.full((1, len(code)), 0.3), axis=0)
        return places, x, np.clip((x * self.guess_weights[kind].T).sum(axis=0), -9, 9)

    def learn(self, symbols: np.ndarray, places: np.ndarray, code: np.ndarray, since: np.ndarray, keep: np.ndarray, rate: float = 0.05) -> None:
        """Online steps over the tokens to `keep`: move weights against the coding error and the tables towards the bits."""
        history = self._history(code, since)
        for at in range(0, len(symbols), STEP):
            some = np.flatnonzero(keep[at : at + STEP]) + at
            if not len(some):
                continue
            guessed = some[code[some] > 0]
            if len(guessed):
                self._learn_guess(code[guessed], history[guessed], rate)
            self._learn_bits(symbols[some], places[:, some], rate)

    def _learn_guess(self, code: np.ndarray, history: np.ndarray, rate: float) -> None:
        spots, x, z = self._guess(code, history)
        hit, kind = code >= HIT, (code % HIT).astype(np.int64)
        error = hit - _sigmoid(z)
        n = np.maximum(1, np.bincount(kind, minlength=GUESSES))
        for k in range(len(x)):
            self.guess_weights[:, k] += rate * np.bincount(kind, weights=error * x[k], minlength=GUESSES) / np.sqrt(n) / 8
        for row in spots:
            self.seen[0] += np.bincount(row[~hit], minlength=self.seen.shape[1])
            self.seen[1] += np.bincount(row[hit], minlength=self.seen.shape[1])

    def _learn_bits(self, symbols: np.ndarray, places: np.ndarray, rate: float) -> None:
        last = places[0] >> BITS
        for depth, x, bit, sure, z in self._bits(symbols, places, True):
            each = (sure == np.arange(SURE)[:, None]).astype(np.float32)
            by = rate / 8 / np.sqrt(np.maximum(1, each.sum(axis=1)))
            self.weights[:, depth * SURE : (depth + 1) * SURE] += (x * (bit.astype(np.float32) - _sigmoid(z))) @ each.T * by
            low, part = _steps(z)
            flat = last * STEPS + low + (part > 0.5)
            n = np.bincount(flat, minlength=SYMBOLS * STEPS).reshape(SYMBOLS, STEPS)
            ones = np.bincount(flat[bit == 1], minlength=SYMBOLS * STEPS).reshape(SYMBOLS, STEPS)
            self.refined += (ones - n * self.refined) / (n + 50)

    def guess_chance(self, code: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The probability that each token is the guessed word; 0 where there is no guess."""
        out, some = np.zeros(len(code)), np.flatnonzero(code)
        if len(some):
            out[some] = _sigmoid(self._guess(code[some], self._history(code, since)[some])[2])
        return out

    def log10(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of each token's symbol's probability, without the guess."""
        out = np.empty(len(symbols))
        flat = self.refined.astype(np.float32).ravel()
        for at in range(0, len(symbols), STEP):
            s, p = symbols[at : at + STEP], places[:, at : at + STEP]
            last = (p[0] >> BITS) * STEPS
            sums, chance = np.zeros(len(s)), None
            for _, _, bit, _, z in self._bits(s, p, False):
                low, part = _steps(z)
                low += last
                fine = flat.take(low)
                fine += (flat.take(low + 1) - fine) * part
                one = np.clip(0.5 * _sigmoid(z) + 0.5 * fine, 1e-6, 1 - 1e-6)
                right = np.abs(one - (1 - bit).astype(np.float32))
                if chance is None:
                    chance = right.astype(np.float64)
                else:
                    chance *= right
            np.log10(chance, out=sums)  # eight factors of 1e-6 at least stay far above the least double
            out[at : at + STEP] = sums
        return out
