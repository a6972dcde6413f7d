"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: a slot has a
bit for each language, in words of 64, and an n-gram's languages are the AND of
its slots. A text's hits are counted for each language, corrected for the
filter's false positives in that language, and set against the share that the
language's own texts reach.

The filter is fitted on a bounded sample of labelled texts (SAMPLE_DOCS of each
language, chosen by a hash of the id); prediction reads every whole text.

Defined results: a null text or one without a letter is `und` with score 0. If
nothing was learnt, every text is `und`. Of tied languages the first by code
point wins. Rows are judged one by one, so equal rows get equal results. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tokens import classes

#: Labelled texts of each language to learn from, at about; texts of the sample that must hold an n-gram.
SAMPLE_DOCS, LEAST_DOCS = 2000, 2
#: Code points of an n-gram; the filter's slots and hash functions.
WIDTH, SLOTS, HASHES = 4, 1 << 19, 3
UNKNOWN = "und"
_folded: np.ndarray | None = None


def folded() -> np.ndarray:
    """Each code point as the n-grams see it: letters in lower case, all else a space."""
    global _folded
    if _folded is None:
        kind = classes()
        out = np.full(len(kind), 32, dtype=np.uint32)
        letters = np.flatnonzero(kind == 1)
        out[letters] = [ord(c) if len(c := chr(x).lower()) == 1 else x for x in letters.tolist()]
        _folded = out
    return _folded


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, has a letter by row) of all n-grams of a slice's texts; a space stands before and after each text, and none holds two spaces in a row."""
    n = len(offsets) - 1
    points = folded()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # Each text between two spaces.
    row = np.repeat(np.arange(n), np.diff(heads) + 2)
    padded = np.full(len(points) + 2 * n, 32, dtype=np.uint32)
    padded[np.arange(len(points)) + 2 * np.repeat(np.arange(n), np.diff(heads)) + 1] = points
    blank = padded == 32
    lettered = np.bincount(row[~blank], minlength=n) > 0
    code = T.mix(padded.astype(np.uint64) + T.MULTIPLIERS[2])
    m = max(0, len(padded) - WIDTH + 1)
    fits = row[:m] == row[WIDTH - 1 :] if m else np.zeros(0, dtype=bool)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(WIDTH):
        h += code[k : m + k] * T.MULTIPLIERS[k]
        if k:
            fits = fits & ~(blank[k : m + k] & blank[k - 1 : m + k - 1])
    # A text of fewer code points than an n-gram has is one n-gram.
    short = np.flatnonzero(lettered & (np.bincount(row[:m][fits], minlength=n) == 0))
    first = np.concatenate([[0], np.cumsum(np.diff(heads) + 2)])
    extra = np.array([code[first[k] : first[k + 1]].sum(dtype=np.uint64) for k in short], dtype=np.uint64)
    return np.concatenate([row[:m][fits], short]), T.mix(np.concatenate([h[fits], extra])), lettered


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The filter's slots of each hash."""
    step = T.mix(h + T.MULTIPLIERS[3]) | T.U(1)
    return [((h + T.U(k) * step) >> T.U(64 - SLOTS.bit_length() + 1)).astype(np.int64) for k in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilter:
    names: list[str]
    bits: np.ndarray  # uint64 by word (of 64 languages each) and slot
    reached: np.ndarray  # corrected share of hits that a language's own texts reach, by language

    @property
    def false_rate(self) -> np.ndarray:
        return np.array([float(((self.bits[k // 64] >> T.U(k % 64)) & T.U(1)).mean()) ** HASHES for k in range(len(self.names))])

    def shares(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): corrected shares of each text's n-grams that a language holds."""
        held = np.full((len(self.bits), len(h)), ~T.U(0))
        for at in slots(h):
            held &= self.bits[:, at]
        total = np.maximum(1, np.bincount(row, minlength=rows))
        hits = np.stack([np.bincount(row[((held[k // 64] >> T.U(k % 64)) & T.U(1)).astype(bool)], minlength=rows) for k in range(len(self.names))], axis=1) / total[:, None]
        false = self.false_rate
        return np.clip((hits - false) / np.maximum(1e-9, 1 - false), 0, 1)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        row, h, lettered = grams(data, offsets)
        if not self.names:
            return [UNKNOWN] * rows, np.zeros(rows)
        share = self.shares(row, h, rows) / np.maximum(self.reached, 1e-6)
        best = share.argmax(axis=1)
        score = np.where(lettered, np.clip(share[np.arange(rows), best], 0, 1), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], score


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n-gram, texts that hold it) of a batch."""
    for batch in batches:
        language = batch.column("k").to_numpy()
        for at, to, data, offsets in T.pieces(batch.column("text")):
            row, h, _ = grams(data, offsets)
            for k in np.unique(language[at:to]):
                own = language[at:to][row] == k
                pairs = np.unique(np.stack([h[own], row[own].astype(np.uint64)]), axis=1)
                found, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, dtype=np.int32)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "h", "n"])


def _sample_shares(batches: Iterator[pa.RecordBatch], model: LanguageFilter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        language = batch.column("k").to_numpy()
        for at, to, data, offsets in T.pieces(batch.column("text")):
            row, h, lettered = grams(data, offsets)
            own = model.shares(row, h, to - at)[np.arange(to - at), language[at:to]]
            yield pa.RecordBatch.from_arrays([pa.array(language[at:to][lettered]), pa.array(own[lettered])], names=["k", "share"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageFilter:
    """Learn from a bounded sample of the labelled rows; rows with a null label are left out."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in labelled.groupBy(lang_col).count().collect()}
    names = sorted(counts)
    empty = LanguageFilter(names, np.zeros((-(-len(names) // 64), SLOTS), dtype=np.uint64), np.ones(len(names)))
    if not names:
        return empty
    scale = 1 << 30
    limits = spark.createDataFrame([(k, x, min(scale, sample_docs * scale // counts[x])) for k, x in enumerate(names)], "k int, name string, most long")
    sample = labelled.join(F.broadcast(limits), F.col(lang_col) == F.col("name")).where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale)) < F.col("most")).select("k", F.col(text_col).alias("text"))
    found = sample.mapInArrow(_sample_grams, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    least = F.when(F.lit(True), F.lit(LEAST_DOCS))
    rare = {k for k, x in enumerate(names) if counts[x] < 10 * LEAST_DOCS}  # of few texts, every n-gram counts
    rows = found.where((F.col("n") >= least) | F.col("k").isin(*(rare or {-1}))).select("k", "h").toArrow()
    k, h = rows.column("k").to_numpy(), rows.column("h").to_numpy().view(np.uint64)
    for at in slots(h):
        np.bitwise_or.at(empty.bits, (k // 64, at), T.U(1) << (k % 64).astype(np.uint64))
    own = {r["k"]: r["share"] for r in sample.mapInArrow(lambda it: _sample_shares(it, empty), "k int, share double").groupBy("k").agg(F.avg("share").alias("share")).collect()}
    return LanguageFilter(names, empty.bits, np.array([own.get(k, 1.0) for k in range(len(names))]))


def predicted(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every whole text. The model has a fixed size for each 64 languages, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in T.pieces(batch.column(1)):
                names, score = shared.value.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(names, type=pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, "id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
