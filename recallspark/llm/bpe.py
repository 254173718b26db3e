"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a
cut there is certain. Each pretoken is cut at all such pairs, the fragments are encoded
independently, and their ids are concatenated. Pretokens recur, so each worker keeps a bounded table
of those already encoded; the table changes cost only, never results.

Fragments are merged in the order of the vocabulary's ids. That is the order of its merges only where
each merge makes the next larger id, so a vocabulary for which this or another assumption fails is
refused. Special tokens that the vocabulary file lists are matched in texts first, as the library does.
Decoding looks up every id's bytes and reads the concatenation as UTF-8 with replacement.

Defined results: null text counts as empty and has no ids; texts of any length are taken whole;
null ids stay null; repeated rows give repeated results; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recallspark.llm.common import small_slices, texts
from recallspark.plans.shipping import ensure_on_executors

#: Pretokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
SLICE_BYTES = 2 << 20


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _check(spec: dict, ranks: dict[bytes, int], chars: dict[str, int]) -> None:
    """Raises where merging by ids, or matching special tokens as they are, would differ from the file."""
    model, last = spec["model"], -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = ranks.get(bytes(chars[c] for c in left + right), -1)
        if made <= last:
            raise ValueError(f"merge {left!r} {right!r} doesn't make the next larger id")
        last = made
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("the model's options change how pairs are merged")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]):
        raise ValueError("special tokens are to be matched as they are")


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        _check(spec, ranks, chars)
        for token in special:
            ranks.pop(token.encode(), None)
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        inside = np.zeros(1 << 16, bool)
        for token, i in ranks.items():
            self.bytes_of[i] = token
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = True
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        #: inside[a << 8 | b]: some token holds byte a directly before byte b.
        self.inside = inside
        self.bpe_one = tiktoken.Encoding("recallspark", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.starts = {k[0] for k in special}
        self.known: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever two neighbouring bytes occur inside no token."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(piece)):
            if not inside[piece[i - 1] << 8 | piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def _encode_pretoken(self, token: str) -> bytes:
        ids: list[int] = []
        for part in self.fragments(token.encode("utf-8")):
            ids += self.bpe_one(part)
        packed = np.array(ids, "<u4").tobytes()
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if len(token) <= 256:
            self.known[token] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        get, make = self.known.get, self._encode_pretoken
        if self.split_special and any(c in text for c in self.starts):
            out = []
            for part in self.split_special(text):
                if part in self.special:
                    out.append(self.special[part])
                else:
                    out += [get(t) or make(t) for t in self.pretokens(part)]
            return b"".join(out)
        return b"".join([get(t) or make(t) for t in self.pretokens(text)])

    def decode_packed(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder for each worker process and vocabulary."""
    return ForcedBoundaryBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of token ids of every whole text."""
    ensure_on_executors(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rb in small_slices(batches, "text", SLICE_BYTES):
            ids = [np.frombuffer(enc.encode_packed(t), "<u4").astype(np.int32) for t in texts(rb, "text")]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids are none."""
    ensure_on_executors(encoded.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rb in batches:
            out = [enc.decode_packed(np.array(x or [], "<u4").tobytes()) for x in rb.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every row."""
    ensure_on_executors(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rb in small_slices(batches, "text", SLICE_BYTES):
            counts, ids_sha, text_sha = [], [], []
            for text in texts(rb, "text"):
                packed = enc.encode_packed(text)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_packed(packed).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
