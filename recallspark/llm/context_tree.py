"""Language-model scoring by context-tree weighting over bytes, with a word model as base.

Both models read the texts with A-Z lower-cased.

Each byte is eight binary decisions; the decisions at one place of that binary tree share a context
tree over the preceding bytes, which mixes Krichevsky-Trofimov estimates of all depths by weights
learnt from the training texts. With the counts fixed, the probability of a byte after its context
depends only on the last ``depth`` bytes and the byte, so texts are scored by their distinct strings
of that length. Counts of those strings and of words cover all training documents and nothing is
pruned: blocks of documents count their own and send packed arrays to shards, which add them up; the
strings of a shard end their contexts in the same pairs of bytes, so that it holds whole subtrees
below depth 1. Shards become more as the corpus grows, and one that holds more than ``MOST_KEYS`` strings is
split: pairs are dealt anew, and a pair that alone holds so many goes by three bytes, by four and so on.
Probabilities, in single precision, go back to the blocks as a stream past each shard's own. No table that
grows with the corpus is broadcast; of the trees only depths 0 and 1 (at most 257 * 255 nodes) and the contexts
that were split (255 nodes each) pass through the driver.

Defined results: null text is empty; an empty text has its end token alone and a model score of 0;
before a text's first byte the context is zero bytes; repeated rows count repeatedly, and rows that
repeat an id and its text share a block; null ids are scored like others, the split takes them as '';
further columns are ignored; without training documents all estimates are uniform; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import held_out, small_slices, text_bytes
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Bytes of context (2 to 6), remainder of the held-out split, and text bytes of a block of documents.
DEPTH, MODULUS, BLOCK_BYTES = 6, 10, 16 << 20
#: Text bytes of a block that are counted or looked up at a time, and counts that wait to be added up.
SLICE_BYTES, WAITING = 1 << 20, 4_000_000
#: Shards of strings and of words at least and at most (powers of two), text bytes to a shard between,
#: and strings of all blocks from which a shard of strings is split, into so many parts at most.
SHARDS, MOST_SHARDS, SHARD_BYTES, MOST_KEYS, MOST_PARTS = 256, 1 << 16, 64 << 20, 4_000_000, 1024
#: The end token's key among word hashes.
END_KEY = xxhash.xxh3_64_intdigest(b"\n") - (1 << 63)

def word_key(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


def lowered(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)


def grams(flat: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with its ``depth`` predecessors in the same text, the nearest highest and the byte lowest.

    Contexts of all lengths are prefixes of such a number, so sorted strings hold subtrees together.
    """
    out = flat.astype(np.int64)
    for k in range(1, depth + 1):
        before = np.zeros(len(flat), np.int64)
        before[k:] = flat[:-k]
        for j in range(k):  # the first k bytes of a text have nothing so far back
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = 0
        out |= before << (8 * (depth + 1 - k))
    return out


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers, or the gaps between ascending ones, compressed by byte planes, after their count."""
    if ascending:
        x = np.diff(x, prepend=x[:0].dtype.type(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, kind: type = np.int64, ascending: bool = False) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=width * n, codec="zstd"), np.uint8)
    x = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(x) if ascending else x


def pack_keys(x: np.ndarray) -> bytes:
    return pack(x, ascending=True)


def unpack_keys(b: bytes) -> np.ndarray:
    return unpack(b, ascending=True)


def unpack_values(b: bytes, word: bool) -> np.ndarray:
    """Counts of words, or log probabilities of strings."""
    return unpack(b, np.float64 if word else np.float32)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, n
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(n[order], starts)


class _Sum:
    """Adds up counts by key; what waits is bounded, besides the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(WAITING, len(self.keys[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = added(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [key], [n], 0
        return key, n


def shard_of(keys: np.ndarray, word: bool, depth: int, shards: int) -> np.ndarray:
    """Shards of words by their hash, of strings by the last two bytes of the context."""
    if word:
        return keys & (shards - 1)
    return ((keys >> 8 * (depth - 1) & 0xFFFF) * 0x9E3779B1 >> 16) & (shards - 1)


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(shard, keys, counts) of sorted keys, packed by shard."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)], len(shard))
    return [(int(shard[a]), pack_keys(keys[a:b]), pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def _sharded(keys: np.ndarray, counts: np.ndarray, word: bool, depth: int, shards: int) -> list[tuple[bool, int, bytes, bytes]]:
    return [(word, *row) for row in _dealt(keys, counts, shard_of(keys, word, depth, shards).astype(np.uint16))]


def context_of(keys: np.ndarray, k: int, depth: int) -> np.ndarray:
    """The last ``k`` bytes of the strings' contexts, the nearest highest."""
    return keys >> 8 * (depth + 1 - k)


def depth_of(shard: int) -> int:
    """Bytes of context by which the strings of a shard were dealt."""
    return shard >> 16 & 15 or 2


def part_of(keys: np.ndarray, shard: int, parts: int, split: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Shards of the strings of a shard that is split; ``split``: sorted contexts of 2, 3, ... bytes that are dealt by one byte more."""
    k = np.full(len(keys), 2)
    for d in sorted(split):
        k[(k == d) & np.isin(context_of(keys, d, depth), split[d])] = d + 1
    unit = keys >> 8 * (depth + 1 - k)
    mixed = unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return shard | k << 16 | (mixed.astype(np.int64) & (parts - 1)) << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


#: ``log_kt`` of small counts.
_SMALL = 128
_KT = log_kt(*np.divmod(np.arange(_SMALL * _SMALL), _SMALL)).reshape(_SMALL, _SMALL)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    low = np.maximum(zeros, ones) < _SMALL
    out = _KT[np.where(low, zeros, 0).astype(np.int64), np.where(low, ones, 0).astype(np.int64)]
    out[~low] = log_kt(zeros[~low], ones[~low])
    return out


class _Level:
    """Nodes of one depth: sorted keys (context, place in the byte) with counts and ln weights."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, ascending: bool = False):
        if ascending:
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            self.keys, self.inverse = keys[new], np.cumsum(new) - 1
        else:
            self.keys, self.inverse = np.unique(keys, return_inverse=True)
        n = len(self.keys)
        self.zeros, self.ones = np.bincount(self.inverse, zeros, n), np.bincount(self.inverse, ones, n)
        own = _log_kt(self.zeros, self.ones)
        if below is None:  # the deepest contexts stand by their own estimate
            self.odds, self.weighted = np.full(n, np.inf), own
        else:
            rest = np.bincount(self.inverse, below, n)
            self.odds = own - rest
            self.weighted = np.logaddexp(own, rest) - math.log(2)

    def mixed(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of each decision by the node at ``at``, mixed with that of the deeper nodes."""
        seen = np.where(bit == 1, self.ones[at], self.zeros[at])
        own = (seen + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        if deeper is None:
            return own
        share = 1 / (1 + np.exp(-np.clip(self.odds, -700, 700)))[at]
        return share * own + (1 - share) * deeper


def _decision(gram: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and bit of the decision ``j`` of each string's last byte."""
    byte = gram & 255
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _parent(keys: np.ndarray) -> np.ndarray:
    """Node keys without the byte of their context that is furthest back."""
    return keys >> 16 << 8 | keys & 255


def _levels(gram: np.ndarray, count: np.ndarray, depth: int, j: int, least: int) -> Iterator[tuple[_Level, np.ndarray]]:
    """Levels ``depth`` to ``least`` of the trees of one decision, and each string's node there; ``gram`` ascends."""
    place, bit = _decision(gram, j)
    level = _Level((gram >> 8) << 8 | place, count * (bit == 0), count * (bit == 1), None, ascending=True)
    at = level.inverse
    yield level, at
    for _ in range(depth - least):
        level = _Level(_parent(level.keys), level.zeros, level.ones, level.weighted)
        at = level.inverse[at]
        yield level, at


def _shard_tops(gram: np.ndarray, count: np.ndarray, depth: int, least: int) -> pa.RecordBatch:
    """Nodes of depth ``least`` of a shard dealt by so many bytes: (level, last, key, zeros, ones, weighted); last: the parent's context."""
    tops = []
    for j in range(8):
        for level, _ in _levels(gram, count, depth, j, least):
            pass
        tops.append(level)
    key, zeros, ones, weighted = (np.concatenate([getattr(x, k) for x in tops]) for k in ("keys", "zeros", "ones", "weighted"))
    return pa.RecordBatch.from_pydict({"level": np.full(len(key), least, np.int32), "last": key >> 16, "key": key, "zeros": zeros, "ones": ones, "weighted": weighted})


def _parents(table: pa.Table) -> pa.Table:
    """Sums of the nodes of one depth at their parents, in the order of the keys."""
    table = table.sort_by("key")
    key, zeros, ones, weighted = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted"))
    parent, inverse = np.unique(_parent(key), return_inverse=True)
    level = np.full(len(parent), table.column("level")[0].as_py() - 1, np.int32)
    return pa.table({"level": level, "key": parent} | {k: np.bincount(inverse, x, len(parent)) for k, x in (("zeros", zeros), ("ones", ones), ("below", weighted))})


def _upper_levels(sums: pa.Table) -> list[_Level]:
    """The nodes above all shards, by depth from 0 on, of what the shards add to their parents."""
    sums = sums.sort_by([("level", "ascending"), ("key", "ascending")])
    depth, *columns = (sums.column(c).to_numpy() for c in ("level", "key", "zeros", "ones", "below"))
    out: list[_Level] = []
    above: _Level | None = None
    for d in range(int(depth.max(initial=1)), -1, -1):
        own = [x[depth == d] for x in columns]
        if above is not None:  # split contexts add to theirs what shards can't
            own = [np.concatenate(x) for x in zip(own, (_parent(above.keys) if d else above.keys & 255, above.zeros, above.ones, above.weighted))]
        above = _Level(*own)
        out.insert(0, above)
    return out


def _shard_scores(gram: np.ndarray, count: np.ndarray, depth: int, upper: list[_Level], least: int) -> np.ndarray:
    """log10 probability of each string's last byte after its context."""
    out = np.zeros(len(gram))
    for j in range(8):
        place, bit = _decision(gram, j)
        p = None
        for level, at in _levels(gram, count, depth, j, least):
            p = level.mixed(at, bit, p)
        for d in range(least - 1, -1, -1):
            key = context_of(gram, d, depth) << 8 | place if d else place
            p = upper[d].mixed(np.searchsorted(upper[d].keys, key), bit, p)
        out += np.log10(p)
    return out


def _add_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all rows (word, shard, key, n) of a shard."""
    total, word, shard = _Sum(), None, None
    for rb in batches:
        for word, shard, key, n in zip(*(rb.column(c).to_pylist() for c in ("word", "shard", "key", "n"))):
            total.add(unpack_keys(key), unpack(n))
    key, n = total.total()
    yield pa.RecordBatch.from_pydict({"word": [word], "shard": pa.array([shard], pa.int32()), "key": [pack_keys(key)], "n": [pack(n)]})


def _shard_values(sums: DataFrame, depth: int) -> DataFrame:
    """(shard, key, value) of the shards of strings in ``sums``, packed."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for shard, key, n in zip(*(rb.column(c).to_pylist() for c in ("shard", "key", "n"))):
                yield _shard_tops(unpack_keys(key), unpack(n), depth, depth_of(shard))

    tops = sums.select("shard", "key", "n").mapInArrow(top, "level int, last long, key long, zeros double, ones double, weighted double")
    place = F.pmod("key", F.lit(16))  # nodes of a common last byte meet in several groups
    added_up = tops.groupBy("level", "last", place).applyInArrow(_parents, "level int, key long, zeros double, ones double, below double")
    upper = _upper_levels(added_up.toArrow())  # at most 256 * 255 rows, and 255 for each context that was split

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for shard, key, n in zip(*(rb.column(c).to_pylist() for c in ("shard", "key", "n"))):
                value = _shard_scores(unpack_keys(key), unpack(n), depth, upper, depth_of(shard))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "key": [key], "value": [pack(value.astype(np.float32))]})

    return sums.select("shard", "key", "n").mapInArrow(score, "shard int, key binary, value binary")


def string_scores(counts: DataFrame, depth: int, shards: int = SHARDS) -> DataFrame:
    """(key, value) of each string in ``counts`` (key, n): log10 probability of its last byte."""

    def put(table: pa.Table) -> pa.Table:
        key, n = added([table.column("key").to_numpy()], [table.column("n").to_numpy()])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "key": [pack_keys(key)], "n": [pack(n)]})

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for key, value in zip(rb.column("key").to_pylist(), rb.column("value").to_pylist()):
                yield pa.RecordBatch.from_pydict({"key": unpack_keys(key), "value": unpack_values(value, False).astype(float)})

    pair = F.shiftright("key", 8 * (depth - 1)).bitwiseAND(F.lit(0xFFFF))
    dealt = counts.select(F.pmod(pair, F.lit(shards)).cast("int").alias("shard"), F.col("key").cast("long").alias("key"), F.col("n").cast("long").alias("n"))
    sums = Scratch.of(counts.sparkSession).save(dealt.groupBy("shard").applyInArrow(put, "shard int, key binary, n binary"))
    return _shard_values(sums, depth).mapInArrow(take, "key long, value double")


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    flat, offsets = text_bytes(part, "text")
    raw = flat.tobytes()
    return [raw[a:b].lower().split() for a, b in zip(offsets[:-1], offsets[1:])]


_COUNTED = "block long, word boolean, shard int, key binary, n binary, size long"


def _count_block(table: pa.Table, depth: int, shards: int) -> pa.Table:
    """(block, word, shard, key, n, size): strings and words of a block, with their counts in training texts, and how many there are."""
    strings, words = _Sum(), _Sum()
    for part in small_slices(iter(table.to_batches()), "text", SLICE_BYTES):
        flat, offsets = text_bytes(part, "text")
        on = ~part.column("held_out").to_numpy(zero_copy_only=False)
        words.add(np.array([END_KEY], np.int64), np.array([on.sum()], np.int64))
        codes = grams(lowered(flat), offsets, depth) << 1 | np.repeat(on, np.diff(offsets))
        codes.sort()
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        strings.add(codes[starts] >> 1, np.diff(starts, append=len(codes)) * (codes[starts] & 1))
        seen: dict[bytes, int] = {}
        for own, counts in zip(_words(part), on.tolist()):
            for w in own:
                seen[w] = seen.get(w, 0) + counts
        words.add(np.fromiter(map(word_key, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
    rows = _sharded(*strings.total(), False, depth, shards) + _sharded(*words.total(), True, depth, shards)
    word, shard, key, n = zip(*rows)
    block = table.column("block")[0].as_py()
    size = [int.from_bytes(k[:8], "little") for k in key]
    return pa.table({"block": np.full(len(rows), block, np.int64), "word": list(word), "shard": pa.array(shard, pa.int32()), "key": list(key), "n": list(n), "size": pa.array(size, pa.int64())})


def _split_shards(counted: DataFrame, depth: int, most_keys: int) -> DataFrame:
    """``counted`` with the shards of strings that hold more than ``most_keys`` of all blocks split."""
    strings = counted.where("not word")
    sizes = strings.groupBy("shard").agg(F.sum("size").alias("size")).where(F.col("size") > most_keys).collect()
    parts = {r["shard"]: min(MOST_PARTS, 1 << math.ceil(r["size"] / most_keys - 1).bit_length()) for r in sizes}
    if not parts:
        return counted
    crowded = F.col("shard").isin(list(parts))
    split: dict[int, np.ndarray] = {}

    def counts(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for key in rb.column("key").to_pylist():
                    key = unpack_keys(key)
                    if k > 2:
                        key = key[np.isin(context_of(key, k - 1, depth), split[k - 1])]
                    context, n = np.unique(context_of(key, k, depth), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"context": context, "n": n.astype(np.int64)})

        return run

    for k in range(2, depth):
        rows = strings.where(crowded).select("key").mapInArrow(counts(k), "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
        found = rows.where(F.col("n") > most_keys).collect()
        if not found:
            break
        split[k] = np.sort(np.array([r["context"] for r in found], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block, shard, key, n in zip(*(rb.column(c).to_pylist() for c in ("block", "shard", "key", "n"))):
                key = unpack_keys(key)
                own, keys, counts = zip(*_dealt(key, unpack(n), part_of(key, shard, parts[shard], split, depth)))
                size = [int.from_bytes(k[:8], "little") for k in keys]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(own), pa.int64()), "word": [False] * len(own), "shard": pa.array(own, pa.int32()), "key": list(keys), "n": list(counts), "size": pa.array(size, pa.int64())})

    return counted.where(F.col("word") | ~crowded).union(strings.where(crowded).mapInArrow(deal, _COUNTED))


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, key, value) of the blocks' rows of each shard, which follow its row without a block."""
    keys = values = None
    for rb in batches:
        for block, word, key, value in zip(*(rb.column(c).to_pylist() for c in ("block", "word", "key", "value"))):
            if block is None:
                keys, values = unpack_keys(key), unpack_values(value, word)
                continue
            found = pack(values[np.searchsorted(keys, unpack_keys(key))])
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "word": [word], "key": pa.array([key], pa.binary()), "value": pa.array([found], pa.binary())})


def _known(table: pa.Table, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a block's words or strings, and their values."""
    rows = [(k, v) for w, k, v in zip(*(table.column(c).to_pylist() for c in ("word", "key", "value"))) if w == word]
    key = np.concatenate([np.zeros(0, np.int64), *(unpack_keys(k) for k, _ in rows)])
    value = np.concatenate([np.zeros(0, np.float32), *(unpack_values(v, word) for _, v in rows)])
    order = np.argsort(key)
    return key[order], value[order]


def _score_block(texts: pa.Table, known: pa.Table, depth: int, train_tokens: int, distinct: int) -> pa.Table:
    if not texts.num_rows:
        return pa.table({k: pa.array([], t) for k, t in _SCORE_TYPES.items()})
    (g, gv), (words, counts) = _known(known, False), _known(known, True)
    end = float(counts[np.searchsorted(words, END_KEY)])
    below = train_tokens + 0.1 * (distinct + 1)
    scores, sizes, n_tokens, n_known, base = [], [], [], [], []
    for part in small_slices(iter(texts.to_batches()), "text", SLICE_BYTES):
        flat, offsets = text_bytes(part, "text")
        codes = grams(lowered(flat), offsets, depth)
        order = np.argsort(codes)
        values = np.empty(len(codes))
        values[order] = gv[np.searchsorted(g, codes[order])]
        total = np.append(0.0, np.cumsum(values))
        scores.append(total[offsets[1:]] - total[offsets[:-1]])
        sizes.append(np.diff(offsets))
        docs = _words(part)
        own = list({w for d in docs for w in d})
        at = np.searchsorted(words, np.fromiter(map(word_key, own), np.int64, len(own)))
        get = dict(zip(own, counts[at].tolist())).__getitem__
        for d in docs:
            c = np.array([*map(get, d), end])
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 0.1) / below).sum()))
    score, size = np.concatenate(scores), np.concatenate(sizes)
    bits = np.where(size > 0, -score / math.log10(2) / np.maximum(size, 1), 0.0)
    return pa.table(
        {
            "doc_id": texts.column("doc_id"),
            "held_out": texts.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([train_tokens] * texts.num_rows, pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
            "bits_per_byte": pa.array(bits, pa.float64()),
        }
    )


_SCORE_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "bits_per_byte": pa.float64()}
_SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, depth: int = DEPTH, modulus: int = MODULUS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """Scores of every row by models learnt from the rows that the split doesn't hold out."""
    spark = docs.sparkSession
    ensure_on_executors(spark)
    scratch = Scratch.of(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    shards = min(MOST_SHARDS, max(SHARDS, 1 << math.ceil(size / SHARD_BYTES).bit_length()))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    dealt = source.select("doc_id", "text", held_out("doc_id", modulus).alias("held_out"), block.alias("block"))
    counted = scratch.save(dealt.groupBy("block").applyInArrow(lambda t: _count_block(t, depth, shards), _COUNTED), large_rows=True)
    scratch.release_shuffles()
    counted = _split_shards(counted, depth, most_keys)
    sums = scratch.save(counted.select("word", "shard", "key", "n").groupBy("word", "shard").applyInArrow(_add_shard, "word boolean, shard int, key binary, n binary"), large_rows=True)
    scratch.release_shuffles()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for shard, key, n in zip(*(rb.column(c).to_pylist() for c in ("shard", "key", "n"))):
                n = unpack(n)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "key": [key], "value": [pack(n.astype(float))], "tokens": [int(n.sum())], "seen": [int((n > 0).sum())]})

    counts = scratch.save(sums.where("word").select("shard", "key", "n").mapInArrow(words, "shard int, key binary, value binary, tokens long, seen long"), large_rows=True)
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    strings = scratch.save(_shard_values(sums.where("not word"), depth), large_rows=True)
    scratch.drop(sums)
    values = counts.select(F.lit(True).alias("word"), "shard", "key", "value").union(strings.select(F.lit(False).alias("word"), "shard", "key", "value"))
    values = values.select(F.lit(None).cast("long").alias("block"), "word", "shard", "key", "value")
    asked = counted.select("block", "word", "shard", "key", F.lit(None).cast("binary").alias("value"))
    lined_up = asked.union(values).repartition("word", "shard").sortWithinPartitions("word", "shard", F.col("block").asc_nulls_first())
    known = lined_up.select("block", "word", "key", "value").mapInArrow(_look_up, "block long, word boolean, key binary, value binary")

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        return _score_block(texts, table, depth, train_tokens, distinct)

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, _SCORE_SCHEMA)


def op6_context_tree(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
