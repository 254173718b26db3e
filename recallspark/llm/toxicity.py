"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words and characters: a word's vector is its own row of a hashed table and the mean of the
rows of its character 3- to 5-grams. Words over 40 bytes are read as parts that overlap by four bytes,
so that every gram is in some part. Rows start with the log odds that training documents with the
word or gram are toxic; of the grams' odds the highest is taken. Two gated recurrent layers read each window of words in
both directions, attention pools their states, and a logistic unit scores the window. Windows
overlap by half, so that a phrase of up to half a window lies whole in one of them, and all are scored.
A document's score weighs its best windows and two averages over all of them, by a logistic regression.

Training takes windows of labelled documents: all of a clean document's, and of a toxic one those
with the highest score so far, as the label says that some window is toxic, not which.

The sample of labelled documents is bounded by ``MOST_DOCS`` documents and ``MOST_BYTES`` of text,
taken in the order of a hash of doc_id; it is the only thing that reaches the driver.

Defined results: null, empty and blank texts have one window of padding and score as that; rows that
repeat repeat their score; further columns are ignored; without labels of both kinds all scores are
0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import held_out, small_slices
from recallspark.plans.shipping import ensure_on_executors

WINDOW, STRIDE = 24, 12
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 15, 1 << 15, 6, 8
MOST_DOCS, MOST_BYTES, MODULUS = 5000, 10 << 20, 5
WORDS_KNOWN, SLICE_BYTES = 60_000, 1 << 18
#: Bytes of a part of a long word, and those that it shares with the next.
PART, SHARED = 40, 4
PAD = 0
#: Windows without common words that a document's score takes, the logit of one that it lacks, share of
#: the documents that smooths the evidence (and documents at least), and the tables' rate against the network's.
TOP, MISSING, SMOOTH, SMOOTH_LEAST, TABLE_RATE = 3, -8.0, 0.0125, 4.0, 2.0
#: Rounds of training at least and at most, and documents gone through in between.
EPOCHS, MOST_EPOCHS, PASSES = 8, 40, 20_000


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


def word_rows(words: list[bytes]) -> np.ndarray:
    """Each word's row in the word table; row 0 is padding."""
    return np.array([xxhash.xxh32_intdigest(w.lower()) % (WORD_ROWS - 1) + 1 for w in words], np.int64)


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of all character 3- to 5-grams of words, with their ends marked."""
    marked = [b"^" + w.lower() + b"$" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes to the word's end
    owners, rows = [], []
    code = flat.copy()
    for n in (2, 3, 4, 5):
        code = code[:-1] * np.uint64(257) + flat[n - 1 :]
        if n == 2:
            continue
        at = np.flatnonzero(left[: len(code)] >= n)
        h = (code[at] + np.uint64(n)) * _ODD[0]
        h = (h ^ (h >> np.uint64(29))) * _ODD[1]
        owners.append(owner[at])
        rows.append(((h >> np.uint64(33)) % np.uint64(GRAM_ROWS - 1)).astype(np.int64) + 1)
    return np.concatenate(owners), np.concatenate(rows)


_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"


def words_of(text: bytes) -> list[bytes]:
    words = [w.strip(_STRIP) or w for w in text.split()]
    if max(map(len, words), default=0) <= PART:
        return words
    return [w[a : a + PART] for w in words for a in range(0, max(1, len(w) - SHARED), PART - SHARED)]


@dataclass
class Model:
    """Parameters: tables, input maps, recurrent maps of both directions, attention and output."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray]

    def vectors(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), 2 * WIDTH), np.float32)
        for a in range(0, len(words), 8_000):
            units = _Units(words[a : a + 8_000])
            out[a : a + 8_000] = _vectors(self.words, self.grams, units.word, units.gram, units.bounds[:-1])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _scan(x: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, n, H) of a gated recurrent layer over inputs (T, n, 3H): update, reset, candidate."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out, saved = np.empty((steps, n, HIDDEN), np.float32), []
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in range(steps):
        gates = h @ u_gates
        gates += x[t, :, : 2 * HIDDEN]
        np.negative(gates, gates)
        np.exp(gates, gates)
        gates += 1
        np.reciprocal(gates, gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rh = r * h
        new = rh @ u_new
        new += x[t, :, 2 * HIDDEN :]
        np.tanh(new, new)
        if keep:
            saved.append((h, z, r, rh, new))
        h = h + z * (new - h)
        out[t] = h
    return out, saved


def _scan_back(grad: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent map."""
    steps, n, _ = grad.shape
    gx, gu, gh = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, rh, new = saved[t]
        g = gh + grad[t]
        g_new = g * z * (1 - new * new)
        g_z = g * (new - h) * z * (1 - z)
        g_rh = g_new @ u[:, 2 * HIDDEN :].T
        g_r = g_rh * h * r * (1 - r)
        gx[t] = np.concatenate([g_z, g_r, g_new], axis=1)
        gu[:, 2 * HIDDEN :] += rh.T @ g_new
        gu[:, : 2 * HIDDEN] += h.T @ gx[t, :, : 2 * HIDDEN]
        gh = g * (1 - z) + g_rh * r + gx[t, :, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
    return gx, gu


def _forward(p: dict, inputs: tuple[np.ndarray, np.ndarray], keep: bool = False):
    """Window scores from projected inputs (T, n, 3H) of both directions, the second in reading order."""
    fwd, s1 = _scan(inputs[0], p["u1"], keep)
    bwd, s2 = _scan(inputs[1][::-1], p["u2"], keep)
    states = np.concatenate([fwd, bwd[::-1]], axis=2)
    hidden = np.tanh(states @ p["a"])
    energy = hidden @ p["v"]
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    score = _sigmoid(pooled @ p["o"] + p["c"])
    return score, (states, hidden, weight, pooled, s1, s2)


def _gradients(p: dict, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients for word vectors x (T, n, 2 * WIDTH)."""
    inputs = (x @ p["w1"] + p["b1"], x @ p["w2"] + p["b2"])
    score, (states, hidden, weight, pooled, s1, s2) = _forward(p, inputs, True)
    n = len(label)
    loss = -np.mean(label * np.log(score + 1e-7) + (1 - label) * np.log(1 - score + 1e-7))
    g = ((score - label) / n).astype(np.float32)
    out = {"o": pooled.T @ g, "c": g.sum(keepdims=True)}
    g_pool = g[:, None] * p["o"]
    g_states = weight[:, :, None] * g_pool
    g_weight = (states * g_pool).sum(axis=2)
    g_energy = weight * (g_weight - (weight * g_weight).sum(axis=0))
    g_hidden = g_energy[:, :, None] * p["v"] * (1 - hidden**2)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    out["v"] = flat(hidden).T @ g_energy.ravel()
    out["a"] = flat(states).T @ flat(g_hidden)
    g_states = g_states + g_hidden @ p["a"].T
    g1, out["u1"] = _scan_back(g_states[:, :, :HIDDEN], s1, p["u1"])
    g2, out["u2"] = _scan_back(g_states[::-1, :, HIDDEN:], s2, p["u2"])
    g2 = g2[::-1]
    for k, gi in (("1", g1), ("2", g2)):
        out["w" + k] = flat(x).T @ flat(gi)
        out["b" + k] = flat(gi).sum(axis=0)
    out["x"] = (flat(g1) @ p["w1"].T + flat(g2) @ p["w2"].T).reshape(x.shape)
    return float(loss), out


def _windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words; together they cover it."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _evidence(coded: list[np.ndarray], toxic: np.ndarray, units: _Units, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of toxic documents for the rows of both tables."""
    counts = [np.zeros((2, WORD_ROWS)), np.zeros((2, GRAM_ROWS))]
    for own, t in zip(coded, toxic.tolist()):
        at = np.unique(own) - 1
        if len(at):
            counts[0][int(t), np.unique(units.word[at])] += 1
            counts[1][int(t), np.unique(units.gram[units.spans(at)[0]])] += 1
    share = min(max(toxic.mean(), 0.01), 0.99) if len(toxic) else 0.5
    out = []
    for c in counts:
        odds = np.log((c[1] + smooth * share) / share) - np.log((c[0] + smooth * (1 - share)) / (1 - share))
        out.append(np.clip(odds, -4, 4).astype(np.float32))
        out[-1][PAD] = 0
    return out[0], out[1]


class _Units:
    """Table rows of a vocabulary's words and of their grams, word by word."""

    def __init__(self, vocabulary: list[bytes]):
        self.word = word_rows(vocabulary)
        owner, rows = gram_rows(vocabulary)
        order = np.argsort(owner, kind="stable")
        self.gram = rows[order]
        self.bounds = np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams of some words, and each word's first among them; every word has grams."""
        sizes = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(sizes)
        return np.repeat(self.bounds[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), ends - sizes


def _vectors(words: np.ndarray, grams: np.ndarray, word: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inputs of words: their own rows, the means of their grams' rows, and the strongest gram's evidence."""
    out = np.empty((len(word), 2 * WIDTH), np.float32)
    out[:, :WIDTH] = words[word]
    rows = grams[gram]
    sizes = np.diff(np.append(starts, len(gram)))
    out[:, WIDTH + 1 :] = np.add.reduceat(rows[:, 1:], starts) / sizes[:, None]
    out[:, WIDTH] = np.maximum.reduceat(rows[:, 0], starts)
    return out


class _Trained:
    """Both tables while they are trained: sums of squared gradients set each row's rate."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.tables = words, grams
        self.squares = np.full_like(words, 1e-6), np.full_like(grams, 1e-6)

    def descend(self, word: np.ndarray, gram: np.ndarray, starts: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """One step against the gradients of words' vectors; the evidence in the first column stays."""
        sizes = np.diff(np.append(starts, len(gram)))
        shared = np.repeat(grad[:, WIDTH + 1 :] / sizes[:, None], sizes, axis=0)
        for table, square, rows, g in zip(self.tables, self.squares, (word, gram), (grad[:, 1:WIDTH], shared)):
            own, inverse = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(inverse, g[:, c], len(own)) for c in range(g.shape[1])], axis=1).astype(np.float32)
            square[own, 1:] += total * total
            table[own, 1:] -= rate * total / np.sqrt(square[own, 1:])


def _best_windows(logit: np.ndarray, owner: np.ndarray, start: np.ndarray, docs: int) -> np.ndarray:
    """Per document: logits of its best window, of the best that share no word with it, of the best
    that share none with both; and the log of all windows' odds, averaged and added up."""
    out = np.full((docs, TOP + 2), MISSING)
    rest = logit.astype(float).copy()
    for k in range(TOP):
        np.maximum.at(out[:, k], owner, rest)
        where = np.full(docs, -(1 << 40))
        top = (rest == out[owner, k]) & (rest > MISSING)
        np.maximum.at(where, owner[top], start[top])
        rest[np.abs(start - where[owner]) < WINDOW] = MISSING
    odds = np.bincount(owner, np.exp(np.minimum(logit, 4)), docs)
    out[:, TOP] = np.log(odds / np.maximum(np.bincount(owner, minlength=docs), 1) + 1e-3)
    out[:, TOP + 1] = np.log(odds + 1e-3)
    return out


def _fit_top(x: np.ndarray, label: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by Newton steps with a small penalty."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, 1.0), 1e-6)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (q - label) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int | None = None, batch: int = 256) -> Model | None:
    """Fits tables, network and the weights of a document's best windows; None without labels of both kinds.

    The evidence of a word in a document comes from the other half of the documents while the network
    is trained, as it will for documents that it has not seen; the final tables hold that of all.
    """
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    vocabulary = sorted({w for d in docs for w in d})  # sums must not depend on the order of a set
    index = {w: i + 1 for i, w in enumerate(vocabulary)}
    units = _Units(vocabulary)
    coded = [np.array([index[w] for w in words], np.int32) for words in docs]
    half = rng.permutation(len(docs)) % 2
    every = np.arange(len(docs))
    gram, starts = units.spans(np.arange(len(vocabulary)))
    gram = units.gram[gram]

    def of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _evidence([coded[i] for i in own], label[own] > 0, units, max(SMOOTH_LEAST, SMOOTH * len(docs)))

    def known(pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Evidence of the vocabulary's words and of their strongest grams, after padding."""
        own = np.stack([pair[0][units.word], np.maximum.reduceat(pair[1][gram], starts) if len(vocabulary) else pair[0][units.word]], axis=1)
        return np.concatenate([np.zeros((1, 2), np.float32), own])

    other = np.stack([known(of(every[half == 1 - k])) for k in (0, 1)])  # by a document's half
    words, grams = (rng.normal(0, 0.05, (n, WIDTH)).astype(np.float32) for n in (WORD_ROWS, GRAM_ROWS))
    trained = _Trained(words, grams)
    size = 2 * WIDTH
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"w1": init(size, 3 * HIDDEN), "w2": init(size, 3 * HIDDEN), "b1": np.zeros(3 * HIDDEN, np.float32), "b2": np.zeros(3 * HIDDEN, np.float32), "u1": init(HIDDEN, 3 * HIDDEN), "u2": init(HIDDEN, 3 * HIDDEN), "a": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN, 1)[:, 0], "o": init(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}
    rows, owner, begin = [], [], []
    for i, own in enumerate(coded):
        padded = np.append(own, np.zeros(max(0, WINDOW - len(own)), np.int32))
        at = _windows(len(own))
        rows.append(padded[at[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(at), i))
        begin.append(at)
    rows, owner, begin = np.concatenate(rows), np.concatenate(owner), np.concatenate(begin)

    def inputs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Word vectors (T, n, 2 * WIDTH) of windows, their words' places, and what the words are made of."""
        here, place = np.unique(rows[own], return_inverse=True)
        place = place.reshape(rows[own].shape)
        real = here[here > 0] - 1
        at, first = units.spans(real)
        made = units.word[real], units.gram[at], first
        x = np.zeros((len(here), size), np.float32)
        if len(real):
            x[len(here) - len(real) :] = _vectors(words, grams, *made)
        x = x[place]
        x[:, :, [0, WIDTH]] = other[half[owner[own]][:, None], rows[own]]
        return np.ascontiguousarray(x.transpose(1, 0, 2)), place, made

    def score_all() -> np.ndarray:
        table = np.zeros((len(vocabulary) + 1, size), np.float32)
        for a in range(0, len(vocabulary), 20_000):
            real = np.arange(a, min(a + 20_000, len(vocabulary)))
            at, first = units.spans(real)
            table[1 + real] = _vectors(words, grams, units.word[real], units.gram[at], first)
        out = np.empty(len(rows))
        for k in (0, 1):
            table[:, [0, WIDTH]] = other[k]
            one, two = table @ p["w1"] + p["b1"], table @ p["w2"] + p["b2"]
            mine = np.flatnonzero(half[owner] == k)
            for a in range(0, len(mine), 8192):
                out[mine[a : a + 8192]] = score_rows(p, None, rows[mine[a : a + 8192]], (one, two))
        return out

    best = other[half[owner][:, None], rows].max(axis=2)
    best = np.sort(best, axis=1)[:, -3:].sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, PASSES // len(docs)))
    for epoch in range(epochs):
        order = np.lexsort((-best, owner))
        per_doc = np.empty(len(order), np.int64)
        per_doc[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = label[owner] > 0
        clean = np.flatnonzero(~toxic & (per_doc < 4))  # a clean document's hardest windows, and some others
        more = np.flatnonzero(~toxic & (per_doc >= 4))
        some = rng.choice(more, min(len(more), len(clean)), replace=False)
        hot = np.repeat(np.flatnonzero(toxic & (per_doc < 2)), 3)
        pick = rng.permutation(np.concatenate([hot, clean, some]))
        for a in range(0, len(pick), batch):
            own = pick[a : a + batch]
            x, place, made = inputs(own)
            _, grads = _gradients(p, x, label[owner[own]])
            g = grads.pop("x").transpose(1, 0, 2).reshape(-1, size)
            n = int(place.max()) + 1
            total = np.stack([np.bincount(place.ravel(), g[:, c], n) for c in range(size)], axis=1).astype(np.float32)
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            if len(made[0]):
                trained.descend(*made, total[n - len(made[0]) :], TABLE_RATE * rate)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        best = score_all()
    words[:, 0], grams[:, 0] = of(every)
    words[PAD] = grams[PAD] = 0
    x = _best_windows(_logit(best), owner, begin, len(docs))
    p["top"] = _fit_top(x, label)
    # documents are judged at 0.5: move the bias to where both errors balance
    p["top"][-1] -= _balance(x @ p["top"][:-1] + p["top"][-1], label)
    return Model(words, grams, p)


def _logit(score: np.ndarray) -> np.ndarray:
    score = np.clip(score.astype(float), 1e-7, 1 - 1e-7)
    return np.log(score) - np.log(1 - score)


def _balance(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut of best F1, the middle of all such."""
    cuts = np.linspace(-6, 6, 121)
    f1 = [2 * ((logit >= c) & (label > 0)).sum() / max(1, (logit >= c).sum() + (label > 0).sum()) for c in cuts]
    return float(cuts[np.array(f1) >= max(f1) - 1e-9].mean())


def score_rows(p: dict, table: np.ndarray, rows: np.ndarray, projected: tuple | None = None) -> np.ndarray:
    """Scores of windows given as rows of word places (n, WINDOW)."""
    one, two = projected or (table @ p["w1"] + p["b1"], table @ p["w2"] + p["b2"])
    by_step = rows.T
    return _forward(p, (one[by_step], two[by_step]))[0]


class Scorer:
    """Scores whole texts; keeps a bounded table of word vectors already projected."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        p = self.model.p
        self.known: dict[bytes, int] = {}
        self.one = np.empty((1024, 3 * HIDDEN), np.float32)
        self.two = np.empty((1024, 3 * HIDDEN), np.float32)
        self.one[PAD], self.two[PAD] = p["b1"], p["b2"]
        self.size = 1

    def _add(self, words: list[bytes]) -> None:
        x = self.model.vectors(words)
        n, p = len(words), self.model.p
        while self.size + n > len(self.one):
            self.one, self.two = np.concatenate([self.one, np.empty_like(self.one)]), np.concatenate([self.two, np.empty_like(self.two)])
        self.one[self.size : self.size + n], self.two[self.size : self.size + n] = x @ p["w1"] + p["b1"], x @ p["w2"] + p["b2"]
        self.known.update(zip(words, range(self.size, self.size + n)))
        self.size += n

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        own = sorted({w for d in docs for w in d})
        fresh = [w for w in own if w not in self.known]
        if self.size + len(fresh) > WORDS_KNOWN:
            self._clear()
            fresh = own
        if fresh:
            self._add(fresh)
        get = self.known.__getitem__
        rows, owner, begin = [], [], []
        for i, d in enumerate(docs):
            own = np.fromiter(map(get, d), np.int64, len(d))
            if len(own) < WINDOW:
                own = np.append(own, np.zeros(WINDOW - len(own), np.int64))
            starts = _windows(len(d))
            rows.append(own[starts[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(starts), i))
            begin.append(starts)
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        p = self.model.p
        out = np.concatenate([_forward(p, (self.one[rows[a : a + 2048].T], self.two[rows[a : a + 2048].T]))[0] for a in range(0, len(rows), 2048)])
        x = _best_windows(_logit(out), owner, np.concatenate(begin), len(docs))
        return _sigmoid(x @ p["top"][:-1] + p["top"][-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int = MODULUS, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of training documents, at most so many and so many bytes, in hash order.

    Texts that don't fit into the bytes left are passed over. Lengths are gathered first, so no task and
    not the driver ever holds more text than the bound.
    """
    y = labels.where(F.col(target).isNotNull() & ~held_out("doc_id", modulus)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)  # so few that every task can hold them
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = own.join(F.broadcast(y), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("tag"), F.octet_length("text").alias("n"))
    picked, size = [], 0
    for row in sizes.where(F.col("n") <= most_bytes).orderBy(F.xxhash64("doc_id"), "doc_id", "tag").limit(most_docs).collect():
        if size + row["n"] <= most_bytes:  # a long text doesn't end the sample
            size += row["n"]
            picked.append((len(picked), row["doc_id"], row["tag"], int(row["y"])))
    if not picked:
        return [], []
    chosen = docs.sparkSession.createDataFrame(picked, "place long, doc_id long, tag long, y int")
    texts = own.withColumn("tag", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "tag"]).dropDuplicates(["place"])
    rows = texts.orderBy("place").select("text", "y").collect()
    return [r["text"].encode() for r in rows], [r["y"] for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = MODULUS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    spark = docs.sparkSession
    ensure_on_executors(spark)
    model = train(*labelled_sample(docs, labels, "toxic", modulus))
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for rb in small_slices(batches, "text", SLICE_BYTES):
            texts = [t or b"" for t in rb.column("text").cast(pa.large_binary()).to_pylist()]
            score = scorer(texts) if scorer else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus).alias("held_out"), "text")
    out = source.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
