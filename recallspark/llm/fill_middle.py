"""Fill-in-middle transformation by run-length class encoding.

A text is stored as its maximal runs of one character class, each with the number of units that end
in it or before. With ``unit="word"`` the classes are white space and the rest: a unit is a word with
the white space before it, and white space at the end of a text is a unit of its own, so a run ends
one unit or none. With ``unit="char"`` each code point is a unit; the classes are the widths of code
points in UTF-8, so a run ends as many units as its length holds widths.

A cut after k units is found by binary search for the first run whose cumulative count reaches k.
Its place inside the run is arithmetic: the run's start and one width for each unit that the cut goes
into it, or the run's end where a run is a unit. Runs are found for a batch of texts at once.

Defined results: null text counts as empty; empty texts and texts that hold a marker come out as
they are (form ``plain``), without cuts; a null id draws like the empty text; texts of any length are
taken whole, at up to 50 bytes of working memory a byte; repeated rows give repeated results;
further columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import small_slices, text_bytes
from recallspark.plans.shipping import ensure_on_executors

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed before ids, percentage of documents that are transformed, and of these in suffix-first order.
SEED, RATE, SPM_RATE = 42, 50, 80
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of a code point by its first byte; 0 for a byte inside one.
_WIDTH = np.repeat([1, 0, 2, 3, 4], [0x80, 0x40, 0x20, 0x10, 0x10])


@dataclass(frozen=True)
class Runs:
    """Maximal runs of all texts of a batch; ``units`` counts over the batch, up to each run's end."""

    start: np.ndarray
    end: np.ndarray
    units: np.ndarray
    #: Bytes of a unit inside the run, 0 where the whole run is one unit or none.
    step: np.ndarray
    #: First run of each text, one more entry than texts, and units before each text.
    first: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, offsets: np.ndarray, unit: str = "word") -> Runs:
        """``flat``: the bytes of texts in UTF-8, cut at ``offsets``."""
        at = np.flatnonzero(_WIDTH[flat]) if unit == "char" else np.arange(len(flat))
        kind = _WIDTH[flat[at]] if unit == "char" else _SPACE[flat]
        change = np.ones(len(at), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(flat)])] = True
        start, kind = at[change], kind[change]
        end = np.append(start[1:], len(flat))[: len(start)]
        first = np.searchsorted(start, offsets)
        if unit == "char":
            step, ended = kind, (end - start) // kind
        else:
            step, ended = np.zeros(len(start), np.int64), (~kind).astype(np.int64)
            ended[first[1:][np.diff(first) > 0] - 1] = 1  # a word, or white space at the end
        units = np.cumsum(ended)
        return cls(start, end, units, step, first, np.append(0, units)[first[:-1]])

    @property
    def n(self) -> np.ndarray:
        """Units of each text."""
        return np.append(0, self.units)[self.first[1:]] - self.before

    def place(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places after the first k units of texts that aren't empty; k = 0 is the text's start."""
        goal = self.before[text] + k
        run = np.searchsorted(self.units, goal)
        into = goal - np.append(0, self.units)[run]
        at = np.where(self.step[run] > 0, self.start[run] + into * self.step[run], self.end[run])
        return np.where(k == 0, self.start[self.first[text]], at)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits from the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the transformed text ``output`` of every row."""
    ensure_on_executors(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in small_slices(batches, "text", SLICE_BYTES):
            flat, offsets = text_bytes(rb, "text")
            runs, whole = Runs.of(flat, offsets, unit), flat.tobytes()
            n, ids = runs.n, rb.column("doc_id").to_pylist()
            h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            moved = (h[:, 2] % 100 < rate) & (np.diff(offsets) > 0)
            for i in np.flatnonzero(moved).tolist():
                a, b = offsets[i], offsets[i + 1]
                moved[i] = all(whole.find(m, a, b) < 0 for m in marks)
            cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            rows = np.flatnonzero(moved)
            ends = np.zeros((len(ids), 2), np.int64)
            if len(rows):
                ends[rows, 0], ends[rows, 1] = runs.place(rows, cut[rows, 0]), runs.place(rows, cut[rows, 1])
            form, out = [], []
            chars = np.zeros((len(ids), 2), np.int64)
            leads = (flat & 0xC0) != 0x80
            for i in range(len(ids)):
                a, d = int(offsets[i]), int(offsets[i + 1])
                if not moved[i]:
                    form.append("plain")
                    out.append(whole[a:d])
                    continue
                b, c = int(ends[i, 0]), int(ends[i, 1])
                chars[i] = np.count_nonzero(leads[a:b]), np.count_nonzero(leads[b:c])
                p, m, s = whole[a:b], whole[b:c], whole[c:d]
                form.append("spm" if h[i, 3] % 100 < spm_rate else "psm")
                out.append(marks[1] + s + marks[0] + p + marks[2] + m if form[-1] == "spm" else marks[0] + p + marks[1] + s + marks[2] + m)
            cols = [rb.column("doc_id"), pa.array(n), pa.array(form), pa.array(chars[:, 0], mask=~moved), pa.array(chars[:, 1], mask=~moved), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The original text, from a transformed one and its form. Parts hold no marker, so each occurs once."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    before = lambda x, m: F.substring_index(x, m, 1)
    after = lambda x, m: F.substring_index(x, m, -1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents
), b AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM a
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM b
), d AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:x], '') AS p, array_to_string(tokens[x+1:y], '') AS m, array_to_string(tokens[y+1:], '') AS s FROM c
), e AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
            ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM d
), f AS (
  SELECT *, string_split(output, '{PREFIX}') AS at_p, string_split(output, '{SUFFIX}') AS at_s, string_split(output, '{MIDDLE}') AS at_m FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN string_split(at_p[2], '{SUFFIX}')[1] || at_m[2] || string_split(at_s[2], '{MIDDLE}')[1]
              WHEN 'spm' THEN string_split(at_p[2], '{MIDDLE}')[1] || at_m[2] || string_split(at_s[2], '{PREFIX}')[1] ELSE output END) AS restored_sha256
FROM f"""
