"""Toxicity by maximum-scoring segments of token log-odds.

A token is a maximal run of letters, lower-cased in ASCII and Latin-1.  Its
log-odds is learned from the labelled documents that hold it, with a chain of
Dirichlet (here, of two classes: Beta) priors: a word's share of toxic documents
is shrunk to that of its first five bytes, that to the first four, and that to
the share of all documents, so a rare or unseen form of a toxic stem still
scores.  A constant drift makes ordinary text score below zero.

A linear scan finds all maximal scoring segments of a text.  The best segment of
clean texts follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-x L)) for
n tokens; K and L are fitted to clean labelled texts.  A segment is a significant
passage when clean text of that length has one with a chance under
``SIGNIFICANT``, and a document's score is a logistic function of the best
segment's.  The law and the logistic function are fitted to segments that each
training document has under the counts of the ``FOLDS`` - 1 parts it isn't in; the
final counts are of all parts.

Training reads at most about ``FIT_ROWS`` labelled documents of each class,
chosen by a hash of the id, and learns at most ``MOST_KEYS`` words and stems, those
of most documents.  A word that one training document alone holds has no entry and
scores as its longest known stem does.  Scoring reads whole texts of any length.

Defined results: null or empty text has no passage and the score of a text
without evidence; where one class has no labelled row every score is 0; labels
of a repeated id count as toxic if any is; a null id or label is not learned from;
documents that repeat an id are each scored and each learned from; of segments
with equal scores the first is kept; an empty table gives an empty result, and
only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import crc_mod, discard, table, uniform, written
from protolith.llm._vec import LOWER, chunks, flat, hash_words, per_text, words_between

#: Labelled documents of each class that are learned from, about.
FIT_ROWS = 6000
#: Words and stems that are learned at most.
MOST_KEYS = 1 << 20
#: Parts of the training documents, each scored by the counts of the others.
FOLDS = 4
#: Strength of each prior in the chain, in documents.
PRIOR = 8.0
#: Taken from each token's log-odds.
DRIFT = 1.0
#: Chance in clean text below which a segment is reported.
SIGNIFICANT = 0.01
STEMS = (4, 5)
#: A token that repeats one of so many before it adds no evidence: the counts are of documents, not of uses.
REPEATS = 8

_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = True
_WORD[128:] = True


def lowered_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters; lengths stay."""
    out = LOWER[data]
    after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[after] += 0x20
    return out


def tokens(texts: pa.Array):
    """Bytes, starts and ends of the tokens, and each text's offsets into them."""
    data, o = flat(texts)
    data = lowered_bytes(data)
    # bytes of U+2000 to U+2FFF and U+3000 (punctuation, symbols) and of U+0080 to U+00BF are no letters
    word = _WORD[data]
    lead = np.flatnonzero((data == 0xE2) | (data == 0xC2))
    for k in range(3):
        at = lead[lead + k < len(data)] + k
        word[at if k < 2 else at[data[at - 2] == 0xE2]] = False
    starts, ends = words_between(~word, o)
    return data, o, starts, ends, per_text(starts, o)


def _levels(data, starts, ends):
    """(level, hash, hash of the parent) of each token, level by level from the stems to the word."""
    parent = np.zeros(len(starts), dtype=np.uint64)
    for level, k in enumerate((*STEMS, 0)):
        has = (ends - starts > k) if k else np.ones(len(starts), dtype=bool)
        own = np.zeros(len(starts), dtype=np.uint64)
        own[has] = hash_words(data, starts[has], starts[has] + k if k else ends[has], 31 + level)
        yield level, has, own, parent
        parent = np.where(has, own, parent)


def segments(left: list[float], right: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last) over the positive tokens.

    left and right: running totals before and after each positive token.
    """
    out: list[list] = []  # left total, right total, first, last, place of the last earlier one with a smaller left
    for k, (lo, hi) in enumerate(zip(left, right, strict=True)):
        now = [lo, hi, k, k, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= now[0]:
                j = out[j][4]
            if j < 0 or out[j][1] >= now[1]:
                now[4] = j
                out.append(now)
                break
            now = [out[j][0], now[1], out[j][2], now[3], -1]
            del out[j:]
    return [(b - a, i, j) for a, b, i, j, _ in out]


class Model:
    """Sorted hashes of each level with their log-odds; the extreme-value law; the logistic function."""

    def __init__(self):
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * (len(STEMS) + 1)
        self.odds: list[np.ndarray] = [np.zeros(0)] * (len(STEMS) + 1)
        self.law, self.logit, self.known = (1.0, 1.0), (0.0, 0.0), False

    def learn(self, level, key, parent, toxic, clean, n_toxic: int, n_clean: int) -> None:
        root = n_toxic / (n_toxic + n_clean)
        shares: dict[int, float] = {}
        for k in range(len(STEMS) + 1):
            at = np.flatnonzero(level == k)
            at = at[np.argsort(key[at])]
            prior = np.array([shares.get(p, root) for p in parent[at].tolist()]) if k else np.full(len(at), root)
            share = (toxic[at] + PRIOR * prior) / (toxic[at] + clean[at] + PRIOR)
            if k < len(STEMS):
                shares |= dict(zip(key[at].tolist(), share.tolist(), strict=True))
            self.hashes[k], self.odds[k] = key[at], np.log(share / (1 - share)) - np.log(root / (1 - root))
        self.known = True

    def token_odds(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, by its most specific known level; and a number that equal tokens share."""
        if not len(starts):
            return np.zeros(0), np.zeros(0, np.int64)
        whole = hash_words(data, starts, ends, 31 + len(STEMS))
        _, first, back = np.unique(whole, return_index=True, return_inverse=True)
        order = np.argsort(first)  # one token of each kind, in the order of the text
        first, back = first[order], np.argsort(order)[back]
        out = np.zeros(len(first))
        for level, has, own, _ in _levels(data, starts[first], ends[first]):
            if len(self.hashes[level]):
                at = np.minimum(np.searchsorted(self.hashes[level], own), len(self.hashes[level]) - 1)
                hit = has & (self.hashes[level][at] == own)
                out[hit] = self.odds[level][at[hit]]
        return out[back], back

    def passages(self, texts: pa.Array):
        """For each text: number of tokens, and its segments as (score, start byte, end byte)."""
        data, o, starts, ends, own = tokens(texts)
        odds, same = self.token_odds(data, starts, ends)
        gain, doc = odds - DRIFT, np.repeat(np.arange(len(texts)), np.diff(own))
        for lag in range(1, min(REPEATS, len(gain) - 1) + 1):
            again = np.flatnonzero((same[lag:] == same[:-lag]) & (doc[lag:] == doc[:-lag])) + lag
            gain[again] = np.minimum(gain[again], -DRIFT)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        up = np.flatnonzero(gain > 0)
        cut = np.searchsorted(up, own)
        for i in range(len(texts)):
            at = up[cut[i] : cut[i + 1]]
            found = segments(total[at].tolist(), total[at + 1].tolist()) if len(at) else []
            yield int(own[i + 1] - own[i]), [(s, int(starts[at[a]] - o[i]), int(ends[at[b]] - o[i])) for s, a, b in found], data[o[i] : o[i + 1]]

    def surprise(self, best, n):
        """Minus the log of the chance that clean text of n tokens has such a segment; 0 without a segment."""
        lam, k = self.law
        best, n = np.asarray(best, float), np.maximum(np.asarray(n, float), 1)
        chance = -np.expm1(-k * n * np.exp(-lam * best))
        return np.where(best > 0, -np.log(np.maximum(chance, 1e-300)), 0.0)

    def score(self, best: float, n: int) -> float:
        if not self.known:
            return 0.0
        a, b = self.logit
        return float(1 / (1 + np.exp(-np.clip(a * self.surprise(best, n) + b, -60, 60))))


def fit_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """L and K of the extreme-value law by maximum likelihood."""
    if len(best) < 2 or best.std() < 1e-9:
        return 1.0, 1.0
    spread = lambda lam: (w := n * np.exp(-lam * (best - best.min()))) @ best / w.sum() + 1 / lam - best.mean()
    lo, hi = 1e-3, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spread(mid) > 0 else (lo, mid)
    return lo, float(len(best) / (n * np.exp(-lo * best)).sum())


def fit_logit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic regression on one feature."""
    mu, sd = x.mean(), x.std() or 1.0
    z = np.stack([(x - mu) / sd, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -60, 60)))
        ridge = np.diag([0.1, 0.01])
        w = w - np.linalg.solve((z * (p * (1 - p))) @ z.T + ridge, z @ (p - y) + ridge @ w)
    return float(w[0] / sd), float(w[1] - w[0] * mu / sd)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled documents where ``usable`` (over ``doc_id``) holds."""
    model = Model()
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    have = {int(r.y > 0): r.n for r in marks.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(have) < 2:
        return model
    share = F.when(F.col("y") > 0, min(1.0, rows / have[1])).otherwise(min(1.0, rows / have[0]))
    marks = marks.filter(uniform(F.col("doc_id"), 12) < share).select(F.col("doc_id").alias("__id"), (F.col("y") > 0).alias("y"), F.floor(uniform(F.col("doc_id"), 13) * FOLDS).cast("int").alias("fold"))
    # about 2 * rows ids of a few bytes each: a bounded side
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "__id").select("y", "fold", "text").repartition(min(64, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    sample = written(sample, "tox-sample")

    def count(batches):
        rows, n = [], np.zeros((FOLDS, 2), np.int64)
        for b in batches:
            for part in chunks(b, "text"):
                y, fold = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_numpy().astype(np.int64)
                np.add.at(n, (fold, y), 1)
                data, _, starts, ends, own = tokens(part.column(2))
                doc = np.repeat(np.arange(len(y)), np.diff(own))
                for level, has, key, parent in _levels(data, starts, ends):
                    once = np.unique(np.stack([doc[has].astype(np.uint64), key[has], parent[has]]), axis=1) if has.any() else np.zeros((3, 0), np.uint64)
                    at = once[0].astype(int)
                    rows.append((np.full(len(at), level), once[1], once[2], fold[at], y[at], 1 - y[at]))
        # the numbers of documents stand under level -1
        f = np.arange(FOLDS)
        rows.append((np.full(FOLDS, -1), np.zeros(FOLDS, np.uint64), np.zeros(FOLDS, np.uint64), f, n[:, 1], n[:, 0]))
        level, key, parent, fold, toxic, clean = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(parent.view(np.int64)), pa.array(fold.astype(np.int32)), pa.array(toxic.astype(np.int32)), pa.array(clean.astype(np.int32))], names=["level", "key", "parent", "fold", "toxic", "clean"])

    of = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).cast("int").alias(f"{c}{f}")
    seen = sample.mapInArrow(count, "level int, key long, parent long, fold int, toxic int, clean int").groupBy("level", "key").agg(F.first("parent").alias("parent"), F.sum(F.col("toxic") + F.col("clean")).alias("n"), *[of(c, f) for c in ("toxic", "clean") for f in range(FOLDS)])
    seen = seen.filter((F.col("level") < len(STEMS)) | (F.col("n") >= 2)).orderBy(F.col("level") >= 0, F.desc("n"), "level", "key").limit(MOST_KEYS).toArrow()
    level, key, parent = (seen.column(c).to_numpy() for c in ("level", "key", "parent"))
    toxic, clean = (np.stack([seen.column(f"{c}{f}").to_numpy() for f in range(FOLDS)]).astype(np.int64) for c in ("toxic", "clean"))
    key, parent, total = key.view(np.uint64), parent.view(np.uint64), np.flatnonzero(level < 0)

    def learned(model: Model, skip: int) -> Model:
        t, c = (x.sum(0) - (x[skip] if skip >= 0 else 0) for x in (toxic, clean))
        if len(total) and t[total[0]] and c[total[0]]:
            held = (level >= 0) & (t + c > 0)
            model.learn(level[held], key[held], parent[held], t[held], c[held], int(t[total[0]]), int(c[total[0]]))
        return model

    if not learned(model, -1).known:
        discard(sample)
        return model
    others = docs.sparkSession.sparkContext.broadcast([learned(Model(), f) for f in range(FOLDS)])  # bounded by MOST_KEYS

    def best(batches):
        for b in batches:
            for part in chunks(b, "text"):
                for f, other in enumerate(others.value):
                    mine = part.filter(pa.array(part.column(1).to_numpy() == f))
                    got = [(n, max([s for s, _, _ in found], default=0.0)) for n, found, _ in other.passages(mine.column(2))] if other.known else []
                    yield pa.RecordBatch.from_arrays([mine.column(0) if got else pa.array([], pa.bool_()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["y", "n", "best"])

    rest = sample.mapInArrow(best, "y boolean, n long, best double").toArrow()  # bounded by the sample
    discard(sample)
    y, n, top = rest.column("y").to_numpy().astype(bool), np.maximum(rest.column("n").to_numpy(), 1).astype(float), rest.column("best").to_numpy()
    if y.any() and not y.all():
        model.law = fit_law(top[~y], n[~y])
        model.logit = fit_logit(model.surprise(top, n), y.astype(float))
    else:
        model.logit = (1.0, -5.0)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **keep: Column) -> DataFrame:
    """doc_id, ``keep``, score, predicted and passages (start and end in code points, score) for every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("__text"))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def judge(batches):
        for b in batches:
            for part in chunks(b, "__text"):
                out, shown = [], []
                for n, found, data in model.passages(part.column(part.num_columns - 1)):
                    out.append(model.score(max([s for s, _, _ in found], default=0.0), n))
                    real = [x for x in found if model.surprise(x[0], n) > -np.log(SIGNIFICANT)]
                    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if real else None
                    shown.append([{"start": int(point[a]), "end": int(point[z]), "score": float(s)} for s, a, z in real])
                s = np.array(out)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(shown, passage)], names=[*part.schema.names[:-1], "score", "predicted", "passages"])

    head = ", ".join(f"`{n}` {t}" for n, t in base.dtypes[:-1])
    return base.mapInArrow(judge, f"{head}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model, held_out=held_out())
