"""Near-duplicate documents: MinHash bands for candidates, odd sketches to screen, full sets to confirm.

A document's set holds its distinct shingles of ``SHINGLE`` words (lower-cased in
A-Z, split at ``[\\x20\\x09-\\x0D]``); a text of fewer words is one shingle.  Texts
with the same words in the same order are one node, so copies are never
compared.  MinHash samples are grouped in bands; nodes that share a band are
candidates.  An odd sketch folds the bottom-k sample of a set into a parity
bitmap.  Here k is the size of the set and the bitmap has two to four bits an
element, so nothing is left to sampling: the ones in the XOR of two bitmaps never
exceed the difference of the sets, and a pair with more of them than the threshold
allows is no link for sure; at 0.8 nearly all pairs under 0.77 are dropped.
Bitmaps have powers of two bits, so the larger of two is folded to the smaller.
All others are confirmed on their full sets, so no link is false; a pair at the
threshold is missed by all bands with a chance of about 3 in a million.

No bucket is expanded into all pairs.  First each node is compared with one hub
only, the node with the most bucket mates among those it shares most bands with;
true groups become one component by that.  Then, in buckets that still hold
several components, the members outside the largest are compared with all others
in blocks: a task holds the sketches of two blocks of at most about
``BLOCK_ROWS`` members, and of what passes gives the likeliest pairs of each
member and component.  Those are confirmed and components merged, and as long
as a block held pairs back the rest follows with a larger share, up to all: no
partner is capped, but most pairs need no look once their components are one.

Hot keys (a band, hub or text that many rows share) are dealt into parts by
``salted_join``; copies are aggregated before any shuffle.

Defined results: null, empty and blank texts have no shingle and link with
nothing; a null id is never linked, has component null and is kept; rows that
repeat an id count as one document with the links of all its texts; repeated
rows are all returned; ties (two hubs, two pairs of equal likeness) fall to the
smaller or larger id alike on every run, and never change the components; an
empty table gives an empty result.  Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import discard, hot_keys, salted_join, table, written
from protolith.llm._components import components
from protolith.llm._vec import LOWER, SPACE, chunks, flat, hash_words, mix, per_text, stream, words_between

BANDS, ROWS = 32, 5
#: Members of a block in the comparison of a bucket's left-over nodes, about.
BLOCK_ROWS = 512
#: Pairs that a block gives for each member and component at first, and how that share grows.
FIRST_PAIRS, MORE = 1, 32
_PERMS = BANDS * ROWS
_XOR = (stream(_PERMS, 101) >> np.uint64(32)).astype(np.uint32)
_MUL = ((stream(_PERMS, 102) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
_BAND = stream(_PERMS, 103).reshape(BANDS, ROWS) | np.uint64(1)
_SALT = stream(1, 104)


def shingle_sets(texts: pa.Array, width: int):
    """For each text: the digest of its words, and its sorted distinct shingle hashes."""
    data, o = flat(texts)
    data = LOWER[data]
    starts, ends = words_between(SPACE[data], o)
    words, own = hash_words(data, starts, ends, 21), per_text(starts, o)
    weights = stream(width, 22) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        rolled = mix(sum((words[k : k + n] * weights[k] for k in range(width)), np.zeros(n, np.uint64)))
    for i in range(len(texts)):
        a, b = int(own[i]), int(own[i + 1])
        mark = hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()
        if b - a >= width:
            yield mark, np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mark, np.frombuffer(mark[:8], np.uint64)
        else:
            yield mark, np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_PERMS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            np.minimum(out, ((x[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of a non-empty set as 64-bit words: the least power of two of bits from twice its size on."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    at = (mix(shingles ^ _SALT) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, *more: Column) -> DataFrame:
    """doc_id, seq (digest of the words), n, bands and sketch for every row, and ``more``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    own = base.columns[2:]

    def run(batches):
        for b in batches:
            for part in chunks(b, "text"):
                seq, n, bands, sketch = [], [], [], []
                for mark, s in shingle_sets(part.column(1), width):
                    sig = signature(s) if len(s) else None
                    seq.append(mark)
                    n.append(len(s))
                    bands.append(None if sig is None else band_keys(sig))
                    sketch.append(None if sig is None else odd_sketch(s))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seq, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, longs), pa.array(sketch, longs), *part.columns[2:]], names=["doc_id", "seq", "n", "bands", "sketch", *own])

    return base.mapInArrow(run, ", ".join([f"doc_id {dict(base.dtypes)['doc_id']}, seq binary, n long, bands array<long>, sketch array<long>", *[f"{c} {t}" for c, t in base.dtypes[2:]]]))


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles) of the documents whose id is in ``ids``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")

    def run(batches):
        for b in batches:
            for part in chunks(b, "text"):
                sets = [(mark, s.view(np.int64)) for mark, s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m for m, _ in sets], pa.binary()), pa.array([s for _, s in sets], pa.list_(pa.int64()))], names=["id", "seq", "shingles"])

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, seq binary, shingles array<long>").dropDuplicates(["id", "seq"]).drop("seq")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and odd sketches of two sides allow a link."""
    na, nb, sa, sb = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"sketch_{a}"), F.col(f"sketch_{b}")
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(s: Column, to: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        # sizes that allow a link differ by less than a factor of two
        return F.when(F.size(s) > to, F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), xor)).otherwise(s)

    least = F.least(F.size(sa), F.size(sb))
    ones = F.aggregate(F.zip_with(folded(sa, least), folded(sb, least), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0)))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (ones <= (na + nb) * (100 - percent) / (100 + percent))


def _dealt(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the sets of one side, of which a hub may have very many rows."""
    hot = hot_keys(pairs.groupBy(F.col(side).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    return salted_join(pairs, sets.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")), side, hot, other)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = written(full_sets(docs, ids, id_col, text_col, width), "near-sets")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = _dealt(_dealt(pairs.select("a", "b"), sets, "b", "a"), sets, "a", "b")
    out = written(joined.filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct(), "near-links")
    discard(sets)
    return out


def _ones(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _fold(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _compared(ident, comp, main, n, words, sketch_at, asks, percent: int, most: int):
    """Of one pair of blocks: places of pairs that may link, and whether some were held back.

    ``asks`` marks the rows on the asking side; the others are the side that is asked.
    """
    size = np.diff(sketch_at)
    q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
    stacks = {int(w): (i := d[size[d] == w], words[sketch_at[i][:, None] + np.arange(w)]) for w in np.unique(size[d])}
    out_q, out_d, more = [], [], False
    for k in q.tolist():
        w, near, ones = int(size[k]), [], []
        own = words[sketch_at[k] : sketch_at[k + 1]][None, :]
        for v in (w // 2, w, 2 * w):
            if v in stacks:
                i, s = stacks[v]
                total = n[i] + n[k]
                # two left-over nodes meet once, a left-over node meets all of the main component
                ok = (comp[i] != comp[k]) & ((comp[i] == main[i]) | (ident[k] < ident[i])) & (100 * np.minimum(n[i], n[k]) >= percent * np.maximum(n[i], n[k]))
                i, s, total = i[ok], s[ok], total[ok]
                if len(i):
                    c = _ones(_fold(s) if v > w else s, _fold(own) if v < w else own)
                    fits = c * (100 + percent) <= total * (100 - percent)
                    near.append(i[fits])
                    ones.append(c[fits] / total[fits])
        if near and len(i := np.concatenate(near)):
            order = np.lexsort((ident[i], np.concatenate(ones), comp[i]))
            i = i[order]
            first = np.flatnonzero(np.concatenate([[True], comp[i][1:] != comp[i][:-1]]))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            more |= bool((rank >= most).any())
            out_d.append(i[rank < most])
            out_q.append(np.full(len(out_d[-1]), k))
    none = np.zeros(0, np.int64)
    return np.concatenate(out_q) if out_q else none, np.concatenate(out_d) if out_d else none, more


def _block_pairs(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, more) from rows that are grouped by (key, i, j) and sorted so."""
    names = ["key", "i", "j", "id", "comp", "main", "n", "asks", "sketch"]

    def run(batches):
        held = None

        def done(t: pa.Table):
            cols = [t.column(c).combine_chunks() for c in names]
            key, i, j, ident, comp, main, n = (c.to_numpy(zero_copy_only=False) for c in cols[:7])
            asks, at = cols[7].to_numpy(zero_copy_only=False), np.asarray(cols[8].offsets)
            words = cols[8].values.to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            a, b, held_back = [], [], []
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                p, q, more = _compared(ident[x:y], comp[x:y], main[x:y], n[x:y], words, at[x : y + 1], asks[x:y], percent, most)
                a.append(ident[x:y][p])
                b.append(ident[x:y][q])
                held_back.append(np.full(len(p), more))
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(held_back).astype(bool))], names=["a", "b", "more"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            # all but the last group, of which more rows may follow
            same = (np.asarray(t.column("key")) == t.column("key")[-1].as_py()) & (np.asarray(t.column("i")) == t.column("i")[-1].as_py()) & (np.asarray(t.column("j")) == t.column("j")[-1].as_py())
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = t.slice(at)
            if at:
                yield done(t.slice(0, at))
        if held is not None and held.num_rows:
            yield done(held)

    id_type = dict(rows.dtypes)["id"]
    return rows.select(*names).mapInArrow(run, f"a {id_type}, b {id_type}, more boolean")


def left_over_pairs(bucket: DataFrame, found: DataFrame, nodes: DataFrame, hot: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, more): pairs between components that a bucket still holds, by their sketches."""
    placed = written(bucket.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "near-placed")
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    mixed = mixed.select("key", F.col("top.comp").alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("top.size")).alias("asking"))
    rows = salted_join(placed, mixed, "key", hot, "id").join(nodes.select("id", "n", "sketch"), "id")
    own = lambda c: F.pmod(F.xxhash64("id", F.lit(5)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ("key", "id", "comp", "main", "n", "sketch")
    asked = rows.select(*cols, F.lit(False).alias("asks"), each("asking").alias("i"), own("blocks").alias("j"))
    asking = rows.filter("comp <> main").select(*cols, F.lit(True).alias("asks"), own("asking").alias("i"), each("blocks").alias("j"))
    # every block of left-over members against every block of the bucket
    dealt = asked.unionByName(asking).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    out = written(_block_pairs(dealt, percent, most).groupBy("a", "b").agg(F.max("more").alias("more")), "near-pairs")
    discard(placed)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, *more: Column) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row, and ``more``.

    ``width``: words in a shingle; ``percent``: least similarity in hundredths.
    """
    rows = written(signed(docs, id_col, text_col, width, *more), "near-signed")
    best = F.min(F.struct(F.col("doc_id").alias("id"), "n", "bands", "sketch")).alias("x")
    nodes = written(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("seq").agg(best).select("seq", "x.*"), "near-nodes")

    # buckets of two nodes or more
    banded = nodes.select("id", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-keys")
    hot = hot_keys(shared)
    bucket = written(salted_join(banded, shared.withColumnRenamed("n", "mates"), "key", hot, "id"), "near-buckets")
    hubs = bucket.groupBy("id").agg(F.sum("mates").alias("degree"))
    lead = bucket.join(hubs, "id").groupBy("key").agg(F.max(F.struct("degree", F.col("id"))).getField("id").alias("hub"))
    met = salted_join(bucket.select("key", "id"), lead, "key", hot, "id").filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("bands"))
    star = written(met.groupBy("id").agg(F.max(F.struct("bands", "hub")).getField("hub").alias("hub")), "near-star")
    of = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    by_hub = hot_keys(star.groupBy(F.col("hub").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    near = salted_join(star.join(of("id"), "id"), of("hub"), "hub", by_hub, "id").filter(_may_link("id", "hub", percent))
    tried = written(near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "near-tried")
    links = confirmed(tried, docs, id_col, text_col, width, percent)
    found = components(links)

    # what is outside its bucket's main component, against the rest of the bucket
    most = FIRST_PAIRS
    while True:
        pairs = left_over_pairs(bucket, found, nodes, hot, percent, most)
        fresh = written(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "near-fresh")
        held_back = not pairs.filter("more").isEmpty()
        if not fresh.isEmpty():
            linked = confirmed(fresh, docs, id_col, text_col, width, percent)
            if not linked.isEmpty():
                links_now, found_before = written(links.union(linked), "near-links"), found
                found = components(links_now)
                discard(links, found_before)
                links = links_now
            tried_now = written(tried.union(fresh), "near-tried")
            discard(tried, linked)
            tried = tried_now
        discard(pairs, fresh)
        if not held_back:
            break
        most *= MORE
    discard(shared, star, tried, bucket)

    named = nodes.select("seq", "id").join(found, "id", "left").select("seq", F.coalesce("component", "id").alias("component"))
    many = hot_keys(rows.groupBy(F.col("seq").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    # rows that repeat an id with other texts are one document
    own = salted_join(rows, named, "seq", many, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), *rows.columns[5:])
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with the columns of ``docs``."""
    digest = F.sha2(F.col(text_col), 256)
    # by the text too: of the texts of a repeated id, one may stay and another go
    gone = near_components(docs, id_col, text_col, width, percent, digest.alias("__pl_digest")).filter("NOT kept").select(F.col("doc_id").alias("__pl_id"), "__pl_digest").distinct()
    return docs.join(gone, (F.col(id_col) == F.col("__pl_id")) & (digest == F.col("__pl_digest")), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=4, percent=80)
