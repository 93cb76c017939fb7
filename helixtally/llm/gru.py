"""A small gated recurrent language model in NumPy with a class-factored output.

Inputs are ids: frequent words one by one, all others by the class of their ending.
The output is P(class | state) * P(word | class, state); the words of an ending class
share its probability, which their counts divide outside this model.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
CLASS_WORDS = 32  # frequent words per output class
WINDOW, LANES = 32, 512  # truncated backpropagation: steps, and streams side by side
RATE = 0.03
_FLUSH = 1 << 13  # states whose outputs are computed at once
_NEAR = 1 << 10  # and those of them that are gone through together


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


class Gru:
    """frequent: how many words have ids of their own (a multiple of CLASS_WORDS); endings: ids for all others."""

    def __init__(self, frequent: int, endings: int, values: np.ndarray | None = None) -> None:
        self.frequent, self.blocks = frequent, frequent // CLASS_WORDS
        classes = self.blocks + endings
        sizes = ((frequent + endings, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (classes, HIDDEN), (classes,), (frequent, HIDDEN), (frequent,))
        stops = np.cumsum([int(np.prod(s)) for s in sizes])
        if values is None:
            values = (0.08 * np.random.default_rng(3).standard_normal(stops[-1])).astype(np.float32)
        self.values = values
        parts = [v.reshape(s) for v, s in zip(np.split(values, stops[:-1]), sizes, strict=True)]
        self.table, self.recurrent, self.out, self.out_bias, self.word, self.word_bias = parts

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases that make the untrained model the corpus's frequencies; counts per id, all positive."""
        words = counts[: self.frequent].reshape(-1, CLASS_WORDS)
        classes = np.concatenate((words.sum(1), counts[self.frequent :]))
        self.out[:], self.word[:] = 0, 0
        self.out_bias[:] = np.log(classes / classes.sum())
        self.word_bias[:] = np.log(words / words.sum(1, keepdims=True)).reshape(-1)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.frequent, ids // CLASS_WORDS, self.blocks + ids - self.frequent)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Update gate, reset gate, candidate, recurrent part of the candidate, new state."""
        g = h @ self.recurrent
        z, r = (_sigmoid(x[:, at : at + HIDDEN] + g[:, at : at + HIDDEN]) for at in (0, HIDDEN))
        g = g[:, 2 * HIDDEN :].copy()  # rows side by side, which NumPy goes through faster
        n = r * g
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, g, new

    def _outputs(self, h: np.ndarray, ids: np.ndarray, grads: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each id after each state; with grads, also the loss's slope at the states.

        An id of -1 stands for no token: its log probability is 0, and nothing is learnt from it.
        """
        kind = self.class_of(ids)
        p = np.empty((len(ids), len(self.out)), np.result_type(h, self.out))
        own, total, back = np.empty(len(ids), p.dtype), np.empty(len(ids), p.dtype), None if grads is None else np.empty_like(h)
        some = [slice(at, at + _NEAR) for at in range(0, len(ids), _NEAR)]  # rows that stay in the CPU's cache
        tops = []
        for at in some:
            np.matmul(h[at], self.out.T, out=p[at])
            p[at] += self.out_bias
            tops.append(p[at].max())
        most = max(tops, default=0)  # one number for all rows: states lie within 1, so rows differ by little
        for at in some:
            part, rows = p[at], np.arange(len(ids[at]))
            part -= most
            own[at] = part[rows, kind[at]]
            np.exp(part, out=part)
            total[at] = part @ np.ones(part.shape[1], p.dtype)
            if grads is not None:
                part *= ((ids[at] >= 0) / total[at])[:, None].astype(p.dtype)
                part[rows, kind[at]] -= ids[at] >= 0
                back[at] = part @ self.out
        logs = own - np.log(total)
        if grads is not None:
            grads.out += p.T @ h
            grads.out_bias += p.sum(0)
        order = np.argsort(np.where(ids < 0, len(self.out), kind).astype(np.int16), kind="stable")  # by class, no tokens last
        bounds = np.searchsorted(kind[order][: int((ids >= 0).sum())], np.arange(self.blocks + 1))
        order = order[: bounds[-1]]
        states, mine = h[order], ids[order] % CLASS_WORDS
        found = np.empty(len(order), logs.dtype)
        slopes = np.empty_like(states)
        for k in np.flatnonzero(np.diff(bounds)):
            at, block = slice(bounds[k], bounds[k + 1]), slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
            q = states[at] @ self.word[block].T
            q += self.word_bias[block]
            q -= q.max()
            inside = np.arange(len(q))
            own = q[inside, mine[at]]
            np.exp(q, out=q)
            total = q @ np.ones(q.shape[1], q.dtype)
            found[at] = own - np.log(total)
            if grads is not None:
                q /= total[:, None]
                q[inside, mine[at]] -= 1
                slopes[at] = q @ self.word[block]
                grads.word[block] += q.T @ states[at]
                grads.word_bias[block] += q.sum(0)
        logs[order] += found
        logs[ids < 0] = 0
        if grads is not None:
            back[order] += slopes
        return logs, back

    def score(self, ids: np.ndarray, stops: np.ndarray, first: int) -> np.ndarray:
        """Natural log probability of each document; ids of all documents in a row, `first` is what stands before each.

        Documents run side by side, longest first; the state is carried to the end of each.
        """
        starts = np.concatenate(([0], stops[:-1]))
        order = np.argsort(starts - stops, kind="stable")
        starts, sizes = starts[order], (stops - starts)[order]
        found = np.zeros(len(sizes))
        h = np.zeros((len(sizes), HIDDEN), np.float32)
        before = np.full(len(sizes), first)
        states, wanted, owners, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            if held:
                logs, _ = self._outputs(np.concatenate(states), np.concatenate(wanted))
                found[:] += np.bincount(np.concatenate(owners), logs, len(found))
                for x in (states, wanted, owners):
                    x.clear()
                held = 0

        actives = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left").tolist()
        every = np.arange(len(sizes))
        for t, m in enumerate(actives):
            h[:m] = self.step(self.table[before[:m]], h[:m])[4]
            before[:m] = ids[starts[:m] + t]
            states.append(h[:m].copy())
            wanted.append(before[:m].copy())
            owners.append(every[:m])
            held += m
            if held >= _FLUSH:
                flush()
        flush()
        out = np.empty(len(sizes))
        out[order] = found
        return out

    def learner(self, first: int) -> Learner:
        return Learner(self, first)


class Learner:
    """Truncated backpropagation with Adam, whose state lasts from one run of ids to the next."""

    def __init__(self, model: Gru, first: int) -> None:
        self.model, self.first, self.turn = model, first, 0
        self.mean, self.spread = np.zeros_like(model.values), np.zeros_like(model.values)
        self.grads = Gru(model.frequent, len(model.out) - model.blocks, np.zeros_like(model.values))

    def learn(self, ids: np.ndarray) -> None:
        """One pass over all ids (documents in a row, each ended by `first`): streams side by side, windows with carried state.

        The streams' last places, where ids don't fill them, hold no token (-1).
        """
        if not len(ids):
            return
        lanes = max(1, min(LANES, len(ids) // WINDOW))
        steps = -(-len(ids) // lanes)
        wanted = np.concatenate((ids, np.full(steps * lanes - len(ids), -1, ids.dtype))).reshape(lanes, steps).T.copy()
        given = np.concatenate((np.full((1, lanes), self.first, ids.dtype), np.maximum(wanted[:-1], 0)))
        h = np.zeros((lanes, HIDDEN), np.float32)
        values = self.model.values
        for at in range(0, steps, WINDOW):
            self.grads.values[:] = 0
            h = self._window(given[at : at + WINDOW], wanted[at : at + WINDOW], h)
            self.turn += 1
            slope = self.grads.values / max(1, int((wanted[at : at + WINDOW] >= 0).sum()))
            self.mean += 0.1 * (slope - self.mean)
            self.spread += 0.01 * (slope * slope - self.spread)
            values -= RATE * (self.mean / (1 - 0.9**self.turn)) / (np.sqrt(self.spread / (1 - 0.99**self.turn)) + 1e-6)

    def _window(self, given: np.ndarray, wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adds the window's slopes to grads; the state after it."""
        model, grads, kept = self.model, self.grads, []
        states = np.empty((*given.shape, HIDDEN), np.float32)
        inputs, goes_on = model.table[given], (given != self.first)[:, :, None].astype(np.float32)  # a document begins with an empty state
        for t in range(len(given)):
            h = h * goes_on[t]
            z, r, n, g, new = model.step(inputs[t], h)
            kept.append((h, z, r, n, g))
            states[t] = h = new
        _, back = model._outputs(states.reshape(-1, HIDDEN), wanted.reshape(-1), grads)
        back = back.reshape(states.shape)
        slopes = np.empty((*given.shape, 3 * HIDDEN), np.float32)
        inner = np.empty_like(slopes)
        later = np.zeros_like(h)
        for t in range(len(given) - 1, -1, -1):
            old, z, r, n, g = kept[t]
            d = back[t] + later
            away = 1 - z
            dn = d * away
            square = n * n
            dn *= np.subtract(1, square, out=square)
            dz = old - n
            dz *= d
            dz *= z
            dz *= away
            dr = dn * g
            dr *= r
            dr *= 1 - r
            slopes[t, :, :HIDDEN] = inner[t, :, :HIDDEN] = dz
            slopes[t, :, HIDDEN : 2 * HIDDEN] = inner[t, :, HIDDEN : 2 * HIDDEN] = dr
            slopes[t, :, 2 * HIDDEN :] = dn
            dn *= r
            inner[t, :, 2 * HIDDEN :] = dn
            d *= z
            later = inner[t] @ model.recurrent.T
            later += d
            later *= goes_on[t]
        olds = np.stack([k[0] for k in kept]).reshape(-1, HIDDEN)
        grads.recurrent += olds.T @ inner.reshape(-1, 3 * HIDDEN)
        every = given.reshape(-1)
        order = np.argsort(every.astype(np.int16), kind="stable")
        starts = np.flatnonzero(np.diff(every[order], prepend=-1))
        grads.table[every[order][starts]] += np.add.reduceat(slopes.reshape(-1, 3 * HIDDEN)[order], starts, 0)
        return h
