"""Exact deduplication of an incoming batch against immutable snapshots.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; a digest is
the sha256 of what is left.  A snapshot never changes once written, so its set
of digests gets a static 3-wise binary-fuse filter, one for each range of
digests, built once.  An incoming batch is first grouped by digest on its own
(its internal duplicates never touch the snapshot); each distinct new digest is
then screened by the filter of its range.  Nearly all that pass are true members;
they join the exact buckets of the snapshot by digest, and the normalised bytes
of one text from either side are compared before two groups become one.  A batch
group that the filter denies, or whose bytes differ, is a new group.

A digest's range is its first 16 bits modulo a number of ranges that grows with
the larger side, so a filter task holds about ``RANGE_KEYS`` digests at any size.
Groups are aggregated before any shuffle, and where rows join their group a large
group's rows are dealt into parts; no task holds the rows of a group.

Defined results: null and blank texts are equal to the empty text and form one
group; of a group the row with the most code points, then the smallest id, then
a null id, stays (so ties have one answer); rows that repeat an id and a text are
all reported with the same answer, and ``distinct_rows`` keeps one of them; texts
of any length are hashed whole; an empty table gives an empty result.  Other
columns are not read, so they may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolith.llm._common import crc_mod, discard, hot_keys, salted_join, table, written
from protolith.llm._vec import mix

#: Digests that one filter holds, about.
RANGE_KEYS = 500_000


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys.

    Slots are split into segments; a key's three slots lie in three consecutive
    segments.  Keys are peeled in rounds: every key that is alone in one of its
    slots is removed at once, and fingerprints are set in the reverse order.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        self.segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        slots = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 1
        self.segments = max(1, -(-slots // self.segment) - 2)
        size = (self.segments + 2) * self.segment
        for self.seed in range(1, 200):
            if (peeled := self._peel(keys, size)) is not None:
                break
        else:
            raise RuntimeError("no seed lets the keys be peeled")
        self.prints = np.zeros(size, dtype=np.uint16)
        for which, alone in reversed(peeled):
            own = self._slots(keys[which])
            rest = self._print(keys[which])
            for k in range(3):
                rest = np.where(own[k] == alone, rest, rest ^ self.prints[own[k]])
            self.prints[alone] = rest

    def _slots(self, keys):
        with np.errstate(over="ignore"):
            h = mix(keys + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(self.segment - 1)
        g = mix(h)  # the places within the segments, of bits that don't choose the segment
        places = (h & mask, g & mask, (g >> np.uint64(32)) & mask)
        own = [(first + k) * self.segment + p.astype(np.int64) for k, p in enumerate(places)]
        return own

    def _print(self, keys):
        return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFF)).astype(np.uint16)

    def _peel(self, keys, size):
        own = self._slots(keys)
        count, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for o in own:
            np.add.at(count, o, 1)
            np.add.at(total, o, np.arange(len(keys)))
        left, order = len(keys), []
        while left:
            slot = np.flatnonzero(count == 1)
            if not len(slot):
                return None
            which, pick = np.unique(total[slot], return_index=True)
            order.append((which, slot[pick]))
            for o in own:
                np.subtract.at(count, o[which], 1)
                np.subtract.at(total, o[which], which)
            left -= len(which)
        return order

    def has(self, keys: np.ndarray) -> np.ndarray:
        own = self._slots(keys.astype(np.uint64))
        return self.prints[own[0]] ^ self.prints[own[1]] ^ self.prints[own[2]] == self._print(keys.astype(np.uint64))

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, data: bytes) -> BinaryFuse:
        out = cls.__new__(cls)
        out.seed, out.segment, out.segments = map(int, np.frombuffer(data, np.int64, 3))
        out.prints = np.frombuffer(data, np.uint16, offset=24)
        return out


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[2:10] for d in digests), np.uint64) if len(digests) else np.zeros(0, np.uint64)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **keys: Column) -> DataFrame:
    """doc_id, digest (binary sha256), points (code points of the original), and ``keys``."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).alias("points"), *[c.alias(n) for n, c in keys.items()])


def grouped(rows: DataFrame) -> DataFrame:
    """digest -> best (points, doc_id of the row that stays) and group size, combined before the shuffle."""
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))


def _range(digest: Column, ranges: int) -> Column:
    return (F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int") % ranges).alias("range")


def snapshot_filters(groups: DataFrame, ranges: int) -> DataFrame:
    """One binary-fuse filter for each range of a snapshot's digests: (range, filter)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"range": pdf["range"].iloc[:1], "filter": [BinaryFuse(_keys(pdf["digest"])).dump()]})

    return groups.select(_range(F.col("digest"), ranges), "digest").groupBy("range").applyInPandas(build, "range int, filter binary")


def screened(groups: DataFrame, filters: DataFrame, ranges: int) -> DataFrame:
    """The distinct digests of a batch with ``maybe``: whether the snapshot's filter has them."""

    def screen(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = BinaryFuse.load(right["filter"].iloc[0]).has(_keys(left["digest"])) if len(right) and len(left) else np.zeros(len(left), bool)
        return pd.DataFrame({"digest": left["digest"], "maybe": maybe})

    left = groups.select(_range(F.col("digest"), ranges), "digest").groupBy("range")
    return left.cogroup(filters.groupBy("range")).applyInPandas(screen, "digest binary, maybe boolean")


def dedup(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of both sides: doc_id, digest, points, keep_id, group_size, kept, in_batch.

    ``snapshot`` and ``batch`` are tables that hold the id and the text.
    """
    rows = written(digests(snapshot, id_col, text_col, in_batch=F.lit(False)).unionByName(digests(batch, id_col, text_col, in_batch=F.lit(True))), "exact-digests")
    old = written(grouped(rows.filter("NOT in_batch")), "exact-snapshot")
    new = written(grouped(rows.filter("in_batch")), "exact-batch")
    # by the larger side, so a task holds a bounded share of either
    ranges = max(1, min(65536, -(-max(old.count(), new.count()) // RANGE_KEYS)))
    maybe = screened(new, snapshot_filters(old, ranges), ranges).filter("maybe").select("digest")

    # exact buckets, then the bytes of one text from each side
    both = written(maybe.join(old.select("digest", F.col("best.doc_id").alias("old_id")), "digest").join(new.select("digest", F.col("best.doc_id").alias("new_id")), "digest"), "exact-positives")

    def texts(docs, side):
        want = both.select(F.col(f"{side}_id").alias("best_id"), F.col("digest").alias("best_d"))
        # a group of null ids alone has a null id; by id first, so only few texts are hashed again
        own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(want, F.col("own_id").eqNullSafe(F.col("best_id")), "left_semi")
        own = own.select("own_id", normalised(F.col("text")).alias(f"{side}_text")).withColumn("d", F.unhex(F.sha2(f"{side}_text", 256)))
        return own.join(want, (F.col("d") == F.col("best_d")) & F.col("own_id").eqNullSafe(F.col("best_id")), "left_semi").dropDuplicates(["d"]).drop("own_id")

    same = written(texts(snapshot, "old").join(texts(batch, "new"), "d").filter("old_text = new_text").select(F.col("d").alias("digest"), F.lit(True).alias("same")), "exact-same")

    # a batch group joins the snapshot's only by that; all others are new groups
    sides = old.withColumn("in_batch", F.lit(False)).unionByName(new.withColumn("in_batch", F.lit(True)))
    sides = sides.join(same, "digest", "left").withColumn("part", F.col("in_batch") & F.col("same").isNull())
    final = sides.groupBy("digest", "part").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("in_batch").alias("of"))
    final = final.select("digest", F.explode("of").alias("of_batch"), F.col("best.doc_id").alias("keep_id"), "group_size")
    hot = hot_keys(old.unionByName(new).groupBy(F.col("digest").alias("key")).agg(F.sum("n").alias("n")))
    out = salted_join(rows, final, "digest", hot, "doc_id").filter("in_batch = of_batch").drop("of_batch")
    discard(both)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as a snapshot (rows whose crc32 of the id is even) and a batch (all others)."""
    even = F.coalesce(crc_mod(F.col(id_col), 2) == 0, F.lit(False))
    return docs.filter(even), docs.filter(~even)


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with the columns of ``docs``."""
    own = docs.columns
    snapshot, batch = halves(docs.select(id_col, text_col), id_col)
    keep = dedup(snapshot, batch, id_col, text_col).filter("kept").groupBy(F.col("doc_id").alias("__pl_id"), F.col("digest").alias("__pl_digest")).agg(F.max("points").alias("__pl_points"))
    marked = docs.withColumn("__pl_key", F.xxhash64(F.col(id_col)))
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    rows = marked.join(keep.withColumn("__pl_key", F.xxhash64("__pl_id")), "__pl_key").filter(F.col(id_col).eqNullSafe(F.col("__pl_id")) & (digest == F.col("__pl_digest")) & (F.coalesce(F.char_length(F.col(text_col)), F.lit(0)) == F.col("__pl_points")))
    # one of the rows that agree in id and text: the join has already brought them together
    first = F.row_number().over(Window.partitionBy("__pl_key").orderBy("__pl_key", "__pl_digest"))
    again = F.lag("__pl_digest").over(Window.partitionBy("__pl_key").orderBy("__pl_key", "__pl_digest"))
    return rows.withColumns({"__pl_n": first, "__pl_again": again}).filter((F.col("__pl_n") == 1) | ~F.col("__pl_again").eqNullSafe(F.col("__pl_digest"))).select(*[F.col(f"`{c}`") for c in own])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(*halves(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept, text_sha256
FROM d"""
