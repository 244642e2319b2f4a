"""Language identification with error-correcting output codes.

Each language has a codeword of bits that is far from all others.  One binary
classifier for each bit predicts it from hashed byte trigrams of the lower-cased
text; its weight for a trigram is the log-odds of the languages whose codeword
has the bit against those whose codeword hasn't.  Decoding sums a logistic loss
over the bits of each codeword, weighted by how well the bit's classifier does on
labelled texts that it was not fitted on, and takes the language with the least
loss.

A text is flagged ambiguous for one of two reasons, both calibrated on those same
texts: the gap to the second language is under ``Model.least``, the gap from which
on short pieces are right in ``SURE`` of cases; or the gap a trigram is under
``MIXED`` of what a text of that language alone has, which is so where a text
mixes languages, however long it is.

Training reads at most about ``FIT_ROWS`` rows of each of the ``MOST_LANGS`` most
frequent labels, chosen by a hash of the id: ``FIT_SHARE`` of them are counted, the
rest weigh the bits and calibrate the flag.  Prediction reads whole texts of any
length, in blocks of ``BLOCK`` bytes.

Defined results: null text or text without a letter is ``und`` with score 0 and
flagged; with no labelled row all texts are ``und``; one language only: it is
always predicted.  Rows with a null id are never in the training set; rows that
repeat an id or a text count once each.  Texts that are too short for a trigram
are decoded from zero evidence and flagged.  Ties between languages fall to the
first by name, ties between labels at ``MOST_LANGS`` likewise.  An empty table
gives an empty result.  Only the named columns are read, so others may have any
name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import crc_mod, discard, table, uniform, written
from protolith.llm._vec import chunks, flat

#: Training rows of each language, about.
FIT_ROWS = 3000
#: Buckets of hashed trigrams.
BUCKETS = 1 << 16
SMOOTH = 0.5
#: Languages at most, the most frequent; the counts of each take half a megabyte on the driver.
MOST_LANGS = 128
#: The part of the training rows that is counted.
FIT_SHARE = 0.75
#: Short pieces with a gap that is not flagged are right so often.
SURE = 0.99
#: Of the usual gap a trigram, under which a text is taken for mixed.
MIXED = 0.5
#: Bytes of the pieces that calibrate the flag.
PIECES = (8, 16, 32, 64)
#: Bytes that are scored at once.
BLOCK = 1 << 16
UND = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1, pairwise far apart: all splits of up to 5 languages, else the best of many random draws."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 5:
        masks = np.arange(1, 1 << (n - 1))
        return np.where((masks[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    bits, rng, best = max(15, math.ceil(6 * math.log2(n))), np.random.default_rng(seed), None
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        if (np.abs(code.sum(0)) == n).any():
            continue
        near = (bits - (code.astype(int) @ code.T.astype(int) - 2 * bits * np.eye(n, dtype=int)).max()) // 2
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of each trigram of one text's bytes."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - int(BUCKETS).bit_length() + 1)).astype(np.int64)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


class Model:
    """Codewords, a table of weights (bucket x bit), the weight of each bit, and the bounds of the flag."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
        plus, minus = (self.code > 0).astype(float), (self.code < 0).astype(float)
        share = lambda side: (side.T @ p) / np.maximum(side.sum(0), 1)[:, None]
        self.table = np.ascontiguousarray((np.log(share(plus)) - np.log(share(minus))).T, dtype=np.float32) if self.code.shape[1] else np.zeros((counts.shape[1], 0), np.float32)
        self.bits = np.ones(self.code.shape[1])
        self.least, self.usual = 0.0, np.zeros(len(langs))

    def evidence(self, data: np.ndarray) -> np.ndarray:
        """Of each bit: summed log-odds over the root of the number of trigrams."""
        total, n = np.zeros(self.code.shape[1]), max(0, len(data) - 2)
        for at in range(0, n, BLOCK):
            total += self.table[trigrams(data[at : at + BLOCK + 2])].sum(0, dtype=np.float64)
        return total / math.sqrt(max(n, 1))

    def decode(self, evidence: np.ndarray) -> tuple[int, float, float]:
        """Place of the language, its score from 0 to 1, and the gap to the second."""
        if len(self.langs) == 1:
            return 0, 1.0, 1.0
        loss = np.logaddexp(0, -self.code * evidence[None, :]) @ self.bits / max(self.bits.sum(), 1e-9)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * self.code.shape[1])
        return int(order[0]), float(p[order[0]] / p.sum()), float(loss[order[1]] - loss[order[0]])

    def ambiguous(self, lang: int, gap: float, n: int) -> bool:
        """Whether a text of n bytes with this gap is too short or too mixed to tell."""
        return n < 3 or gap < self.least or gap / math.sqrt(n - 2) < MIXED * self.usual[lang]

    def calibrate(self, rows: list[tuple[int, int, float, bool, bool]]) -> None:
        """From (language, bytes, gap, whether decoded right, whether a piece) of texts and pieces of them."""
        pieces = sorted(((gap, ok) for _, _, gap, ok, piece in rows if piece), reverse=True)
        ok = np.cumsum([x for _, x in pieces]) / np.arange(1, len(pieces) + 1)
        sure = np.flatnonzero(ok >= SURE)
        self.least = pieces[sure[-1]][0] if len(sure) else max((gap for gap, _ in pieces), default=0.0)
        for k in range(len(self.langs)):
            own = [gap / math.sqrt(n - 2) for lang, n, gap, right, piece in rows if lang == k and right and not piece and n > 2]
            self.usual[k] = float(np.median(own)) if own else 0.0


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learn from the rows where ``usable`` holds and text and language are known."""
    spark = docs.sparkSession
    known = docs.filter(usable & F.col(lang_col).isNotNull() & (F.col(lang_col) != UND) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    have = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not have:
        return Model([], np.zeros((0, BUCKETS)))
    share = spark.createDataFrame([(r.lang, min(1.0, rows / r.n)) for r in have], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").filter(uniform(F.col("id"), 11) < F.col("share")).repartition(min(64, 2 * spark.sparkContext.defaultParallelism), "id")
    drawn = written(drawn.select("lang", "text", (uniform(F.col("id"), 15) < FIT_SHARE).alias("counted")), "lang-sample")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for part in chunks(b, "text"):
                data, o = flat(lowered(part.column(1)))
                for i, lang in enumerate(part.column(0).to_pylist()):
                    seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for at in range(int(o[i]), max(int(o[i]), int(o[i + 1]) - 2), BLOCK):
                        seen[lang] += np.bincount(trigrams(data[at : min(at + BLOCK + 2, o[i + 1])]), minlength=BUCKETS)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["lang", "counts"])

    def add(pdf):
        pdf["counts"] = [sum(np.frombuffer(x, np.int64) for x in pdf["counts"]).tobytes()] + [None] * (len(pdf) - 1)
        return pdf.iloc[:1]

    counted = drawn.filter("counted").select("lang", "text")
    parts = counted.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()
    langs = sorted(r.lang for r in parts)
    model = Model(langs, np.array([np.frombuffer(next(r.counts for r in parts if r.lang == k), np.int64) for k in langs], dtype=float).reshape(-1, BUCKETS))
    if model.code.shape[1]:
        _weigh(model, drawn.filter("NOT counted").select("lang", "text").filter(F.col("lang").isin(langs)))
    discard(drawn)
    return model


def _weigh(model: Model, rest: DataFrame) -> None:
    """Weigh the bits and calibrate the flag by labelled texts that weren't counted; bounded by the sample."""

    def texts(batches):
        for b in batches:
            for part in chunks(b, "text"):
                data, o = flat(lowered(part.column(1)))
                for i, lang in enumerate(part.column(0).to_pylist()):
                    yield model.langs.index(lang), data[o[i] : o[i + 1]]

    def right(batches):
        hit, n = np.zeros(model.code.shape[1]), 0
        for k, data in texts(batches):
            hit += np.sign(model.evidence(data)) == model.code[k]
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([hit.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["hit", "n"])

    def gaps(batches):
        out = []
        for k, data in texts(batches):
            for size in (0, *(p for p in PIECES if p < len(data))):
                piece = data[len(data) // 3 :][:size] if size else data
                got, _, gap = model.decode(model.evidence(piece))
                out.append((k, len(piece), gap, got == k, size > 0))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], names=["lang", "n", "gap", "ok", "piece"])

    tried = rest.mapInArrow(right, "hit binary, n long").collect()  # a row for each of a fixed number of tasks
    if n := sum(r.n for r in tried):
        model.bits = np.maximum(1e-3, 2 * sum(np.frombuffer(r.hit) for r in tried) / n - 1)
        model.calibrate([tuple(r) for r in rest.mapInArrow(gaps, "lang int, n long, gap double, ok boolean, piece boolean").collect()])


def _predicted(model: Model, part: pa.RecordBatch, at: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether ambiguous for each text of column ``at``."""
    texts = part.column(at)
    letters = pc.match_substring_regex(texts.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
    data, o = flat(lowered(texts))
    lang, score, unclear = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for i in np.flatnonzero(letters) if model.langs else []:
        own = data[o[i] : o[i + 1]]
        k, score[i], gap = model.decode(model.evidence(own))
        lang[i], unclear[i] = model.langs[k], model.ambiguous(k, gap, len(own))
    return lang, score, unclear


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **keep: Column) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score and ambiguous for every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("__text"))

    def predict(batches):
        for b in batches:
            for part in chunks(b, "__text"):
                lang, score, unclear = _predicted(model, part, part.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)], names=[*part.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    head = ", ".join(f"`{n}` {t}" for n, t in base.dtypes[:-1])
    return base.mapInArrow(predict, f"{head}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the documents that aren't held out."""
    return fit(docs, F.col(id_col).isNotNull() & ~held_out(id_col), id_col, text_col, lang_col)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which a language is found, with the columns of ``docs``.

    Rejected are texts that are ``und``: null, or without a letter.  An ambiguous
    text is in one of the languages all the same, and stays.
    """
    model, at = trained(docs, id_col, text_col, lang_col), docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            for part in chunks(b, text_col):
                lang, _, _ = _predicted(model, part, at)
                yield part.filter(pa.array([k != UND for k in lang], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained(docs), held_out=held_out())
