"""Quality by attention-based multiple-instance learning over passages, in numpy.

A document is a bag of passages of 48 words. Every passage is encoded from its words, as the mean of
their rows in a hashed table that is trained with the rest, and from its measures (classes of
characters, word lengths, words and three-word windows that recur in the passage or earlier in the
document, line breaks); gated attention weights, learnt from document labels alone, say how much each
passage counts, and the weighted sum of the encodings is scored.

The training sample is bounded by ``MOST_DOCS`` documents and ``MOST_BYTES`` of text, taken in the
order of a hash of doc_id; it and the fitted model are all that the driver holds.

Defined results: null, empty and blank texts are one passage without words; repeated rows repeat
their score; further columns are ignored; without labels of both kinds all scores are 0.5; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import held_out, lean, small_slices, text_bytes
from recallspark.llm.toxicity import labelled_sample
from recallspark.plans.shipping import ensure_on_executors

PASSAGE, ENCODED, ATTENTION = 48, 16, 12
#: Rows and width of the word table.
WORD_ROWS, WIDTH = 1 << 15, 8
MOST_DOCS, MOST_BYTES, MODULUS = 6000, 12 << 20, 5
SLICE_BYTES = 1 << 20

#: Classes of bytes: white space, line feed, A-Z, a-z, digits, UTF-8 beyond ASCII, ! and ?, other
#: sentence marks, table bars, symbols, all others.
SPACE, LINE, UPPER, LOWER, DIGIT, HIGH, SHOUT, MARK, BAR, SYMBOL, OTHER = range(11)
CLASSES = 11
_CLASS = np.full(256, OTHER, np.int64)
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = LINE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = UPPER, LOWER, DIGIT, HIGH
for _chars, _kind in (("!?", SHOUT), (".,;:'\"()-", MARK), ("|", BAR), ("#*$%&<>@^~\\{}[]_=+/`", SYMBOL)):
    _CLASS[[ord(c) for c in _chars]] = _kind
FEATURES = CLASSES + 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _recurs(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the key occurs earlier in its group."""
    order = np.lexsort((key, group))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (group[order][1:] == group[order][:-1]) & (key[order][1:] == key[order][:-1])
    return again


def passages(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every passage (n, FEATURES), the text that each belongs to, each passage's number of
    words, and all words' rows in the word table, passage by passage."""
    docs = len(offsets) - 1
    kind = _CLASS[flat]
    solid = kind > LINE
    before = np.zeros(len(flat), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(flat)]] = False
    starts = np.flatnonzero(solid & ~before)
    doc_of_word = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(doc_of_word, minlength=docs)
    first_word = np.cumsum(n_words) - n_words
    number = np.arange(len(starts)) - first_word[doc_of_word]
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first_pass = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    owner = np.repeat(np.arange(docs), n_pass)
    own = first_pass[doc_of_word] + number // PASSAGE  # each word's passage
    # bytes belong to the passage of the last word begun, or to the text's first passage
    begins = number % PASSAGE == 0
    at = np.concatenate([starts[begins & (number > 0)], offsets[:-1]])
    which = np.concatenate([own[begins & (number > 0)], first_pass])
    order = np.lexsort((which, at))
    at, which = at[order], which[order]
    byte_pass = np.repeat(which, np.diff(np.append(at, len(flat))))
    x = np.zeros((total, FEATURES), np.float32)
    counts = np.bincount(byte_pass * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    size = np.maximum(counts.sum(axis=1), 1)
    x[:, :CLASSES] = np.sqrt(counts / size[:, None])
    if not len(starts):
        return x, owner, np.zeros(total, np.int64), np.zeros(0, np.int64)
    stops = np.flatnonzero(solid & np.append(~solid[1:], True))
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flat))]
    edge = edge[solid[edge - 1] & solid[edge]] - 1  # words that a text's end cuts
    stops = np.union1d(stops, edge)
    length = stops - starts + 1
    begun = np.append(0, starts)  # bytes before the first word count as after an empty one
    place = np.arange(len(flat)) - np.repeat(begun, np.diff(np.append(begun, len(flat))))
    powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    value = (flat.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)] * solid
    h = _mix(np.add.reduceat(value, starts) + length.astype(np.uint64))
    many = np.maximum(np.bincount(own, minlength=total), 1)
    mean = lambda v: np.bincount(own, v, total) / many
    three = h.copy()
    three[2:] = _mix(h[2:] * np.uint64(3) + _mix(h[1:-1] * np.uint64(5) + h[:-2]))
    three[number < 2] = _mix(h[number < 2] + number[number < 2].astype(np.uint64) * np.uint64(7919) + np.uint64(1))
    adjacent = np.zeros(len(h), bool)
    adjacent[1:] = (h[1:] == h[:-1]) & (number[1:] > 0)
    x[:, CLASSES] = mean(np.minimum(length, 40) / 10)
    x[:, CLASSES + 1] = mean(length <= 3)
    x[:, CLASSES + 2] = mean(length > 15)
    x[:, CLASSES + 3] = mean(_recurs(own, h))
    x[:, CLASSES + 4] = mean(adjacent)
    x[:, CLASSES + 5] = mean(_recurs(doc_of_word, three))
    x[:, CLASSES + 6] = np.minimum(many, PASSAGE) / PASSAGE
    x[:, CLASSES + 7] = np.log1p(n_words[owner]) / 10
    lower = flat + np.uint8(32) * ((flat >= 65) & (flat <= 90))
    folded = _mix(np.add.reduceat((lower.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)] * solid, starts))
    return x, owner, np.bincount(own, minlength=total), (folded >> np.uint64(40)).astype(np.int64) % WORD_ROWS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _word_means(table: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean row of every passage's words; zeros without words."""
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(table[rows], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
    return out


def _forward(p: dict, x: np.ndarray, words: np.ndarray, first: np.ndarray):
    """Scores of bags whose passages begin at ``first``, with what the backward pass needs."""
    x = np.concatenate([(x - p["mean"]) / p["scale"], words], axis=1)
    h = np.tanh(x @ p["w"] + p["b"])
    tan, gate = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    energy = (tan * gate) @ p["a"]
    n = np.diff(np.append(first, len(x)))
    top = np.repeat(np.maximum.reduceat(energy, first), n)
    weight = np.exp(energy - top)
    weight /= np.repeat(np.add.reduceat(weight, first), n)
    bag = np.add.reduceat(weight[:, None] * h, first)
    return _sigmoid(bag @ p["o"] + p["c"]), (x, h, tan, gate, weight, bag, n)


def _gradients(p: dict, x: np.ndarray, words: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
    """Gradients of the mean log loss, those of the passages' word means among them."""
    score, (x, h, tan, gate, weight, bag, n) = _forward(p, x, words, first)
    g = (score - label) / len(label)
    out = {"o": bag.T @ g, "c": g.sum(keepdims=True)}
    g_bag = np.repeat(g[:, None] * p["o"], n, axis=0)
    g_weight = (h * g_bag).sum(axis=1)
    g_energy = weight * (g_weight - np.repeat(np.add.reduceat(weight * g_weight, first), n))
    out["a"] = (tan * gate).T @ g_energy
    g_mixed = g_energy[:, None] * p["a"]
    g_tan, g_gate = g_mixed * gate * (1 - tan**2), g_mixed * tan * gate * (1 - gate)
    out["v"], out["u"] = h.T @ g_tan, h.T @ g_gate
    g_h = (weight[:, None] * g_bag + g_tan @ p["v"].T + g_gate @ p["u"].T) * (1 - h**2)
    out["w"], out["b"] = x.T @ g_h, g_h.sum(axis=0)
    out["words"] = g_h @ p["w"][FEATURES:].T
    return out


def train(texts: list[bytes], labels: list[int], seed: int = 11, epochs: int = 25, batch: int = 128) -> dict | None:
    """Fits encoder, attention and output to document labels; None without labels of both kinds."""
    label = np.array(labels, float)
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(texts), 200):
        part = texts[a : a + 200]
        offsets = np.append(0, np.cumsum([len(t) for t in part])).astype(np.int64)
        x, owner, sizes, rows = passages(np.frombuffer(b"".join(part), np.uint8), offsets)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        bags += zip(np.split(x, cuts), np.split(sizes, cuts), np.split(rows, np.cumsum(sizes)[cuts - 1]))
    everything = np.concatenate([b[0] for b in bags])
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": init(FEATURES + WIDTH, ENCODED), "b": np.zeros(ENCODED), "v": init(ENCODED, ATTENTION), "u": init(ENCODED, ATTENTION), "a": init(ATTENTION, 1)[:, 0], "o": init(ENCODED, 1)[:, 0], "c": np.zeros(1)}
    table, squares = rng.normal(0, 0.1, (WORD_ROWS, WIDTH)), np.full((WORD_ROWS, WIDTH), 1e-4)
    fixed = {"mean": everything.mean(axis=0), "scale": everything.std(axis=0) + 1e-3}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            own = [bags[i] for i in order[a : a + batch]]
            n = np.array([len(b[0]) for b in own])
            sizes, rows = np.concatenate([b[1] for b in own]), np.concatenate([b[2] for b in own])
            grads = _gradients(p | fixed, np.concatenate([b[0] for b in own]), _word_means(table, sizes, rows), np.cumsum(n) - n, label[order[a : a + batch]])
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            of_words = np.repeat(grads.pop("words") / np.maximum(sizes, 1)[:, None], sizes, axis=0)
            here, at = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(at, of_words[:, c], len(here)) for c in range(WIDTH)], axis=1)
            squares[here] += total * total
            table[here] -= rate * total / np.sqrt(squares[here])
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in (p | fixed | {"table": table}).items()}


def score_slice(model: dict, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, owner, sizes, rows = passages(flat, offsets)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return _forward(model, x, _word_means(model["table"], sizes, rows), first)[0].astype(float)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = MODULUS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = train(*labelled_sample(docs, labels, "quality", modulus, MOST_DOCS, MOST_BYTES))
    return apply_quality(docs, model, threshold, modulus)


def apply_quality(docs: DataFrame, model: dict | None, threshold: float = 0.3, modulus: int = MODULUS) -> DataFrame:
    spark = docs.sparkSession
    ensure_on_executors(spark)
    shared = spark.sparkContext.broadcast(model)  # a megabyte, by the table's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in small_slices(batches, "text", SLICE_BYTES):
            score = score_slice(shared.value, *text_bytes(rb, "text")) if shared.value else np.full(rb.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus).alias("held_out"), "text")
    out = source.mapInArrow(lean(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, unchanged, whose text scores at least the threshold."""
    spark = docs.sparkSession
    ensure_on_executors(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in small_slices(batches, "text", SLICE_BYTES):
            if shared.value:
                rb = rb.filter(pa.array(score_slice(shared.value, *text_bytes(rb, "text")) >= threshold))
            yield rb

    return docs.mapInArrow(lean(run), docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
