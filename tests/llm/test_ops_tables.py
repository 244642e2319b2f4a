"""Dedup, mixing, embeddings and the pipeline against brute force or SQL."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protolith.llm import embeddings, exact, mix, near
from protolith.llm import registry as R
from protolith.llm import _components
from protolith.llm._components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Find:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def of(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self.up[b] = a


@pytest.mark.parametrize("name", sorted(R.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df, want = R.QUERIES[name](spark, f"/root/testdata/{sf}"), con.sql(R.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    back = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in back)) for r in want.fetchall())


# --- exact dedup


def test_binary_fuse_filter_has_all_its_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = exact.BinaryFuse.load(exact.BinaryFuse(keys).dump())
        assert f.has(keys).all()
        assert f.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.001
    assert len(exact.BinaryFuse(rng.integers(0, 1 << 63, 50_000).astype(np.uint64)).prints) < 1.25 * 50_000


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_of_odd_rows(spark, odd, none):
    got = exact.dedup(*exact.halves(odd)).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[squeezed(r.text)].append(r)
    best = {k: min(v, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for k, v in groups.items()}
    texts = {hashlib.sha256(k.encode()).digest(): k for k in groups}
    for r in got:
        k = texts[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (best[k].doc_id, len(groups[k])) and r.kept == (r.doc_id == best[k].doc_id)
    kept = exact.distinct_rows(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(r.doc_id), r.text or "") for r in best.values())
    assert exact.dedup(*exact.halves(none)).count() == 0 and exact.distinct_rows(none).count() == 0


def test_a_positive_of_the_filter_must_pass_the_byte_check(spark, monkeypatch):
    monkeypatch.setattr(exact, "screened", lambda groups, filters, ranges: groups.select("digest", F.lit(True).alias("maybe")))
    rows = spark.createDataFrame([(i, f"t{i // 2}") for i in range(40)], "doc_id long, text string")
    got = exact.dedup(*exact.halves(rows)).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id - r.doc_id % 2 for r in got)


# --- near duplicates


def brute_near(rows, width, percent):
    """component of each id, from all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    find = Find(sets)
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                find.join(a, b)
    return {i: find.of(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def varied(seed, families=12, most=14):
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(families):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 8, 40, 150, 900]))]
        for _ in range(rnd.randint(1, most)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, max(1, len(base) // 40), max(1, len(base) // 20)])):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
            rows.append((n, rnd.choice([" ", "\n", "  "]).join(words).upper() if rnd.random() < 0.3 else " ".join(words)))
            n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,seed", [(4, 1), (5, 2)])
def test_near_components_equal_brute_force(spark, width, seed):
    rows = varied(seed)
    got = {r.doc_id: r for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
    comp, size = brute_near(rows, width, 80)
    assert {i: r.component_id for i, r in got.items()} == comp
    assert {i: r.n_shingles for i, r in got.items()} == size
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_of_odd_rows(spark, odd, none):
    got = near.near_components(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert {r.component_id for r in got if r.doc_id is None} == {None} and by[2, 0].component_id == 2 and by[4, 0].component_id == 4
    kept = near.one_of_each(odd)
    assert kept.columns == odd.columns and {2, 3, 4, 7, 8, None} <= {r.doc_id for r in kept.collect()}
    assert near.near_components(none).count() == 0 and near.one_of_each(none).count() == 0


def test_sketch_ones_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 10, 200, 512, 513, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.permutation(n)[n // 10 :]], rng.integers(0, 1 << 63, n // 8).astype(np.uint64) * np.uint64(2)]))
        x, y = (near.odd_sketch(s).view(np.uint64)[None, :] for s in (a, b))
        assert len(a) / 32 <= x.shape[1] <= max(1, len(a) / 16)
        while x.shape != y.shape:
            x, y = (near._fold(s) if s.shape[1] > min(x.shape[1], y.shape[1]) else s for s in (x, y))
        ones, differ = int(near._ones(x, y)[0]), len(np.setxor1d(a, b))
        assert ones <= differ and (ones - differ) % 2 == 0 and ones >= 0.6 * differ - 6


def test_near_misses_of_one_template_are_not_confirmed_pair_by_pair(spark, monkeypatch):
    """Documents of one template at about 0.73: the sketches and not the full sets must part them."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(1200)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rnd.sample(range(1200), 24):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[i][1] + f" tail{i}") for i in range(0, 40, 4)]
    seen = []
    real = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    monkeypatch.setattr(near, "BLOCK_ROWS", 100)
    got = {r.doc_id: r.component_id for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in got}
    assert sum(seen) < 2 * len(rows)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, 9)], [(5, 3), (3, 8), (20, 10), (8, 21), (30, 31)]])
@pytest.mark.parametrize("few", [0, 3, 1 << 17])
def test_components(spark, monkeypatch, edges, few):
    monkeypatch.setattr(_components, "FEW_EDGES", few)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    find = Find(nodes)
    for a, b in edges:
        if a != b:
            find.join(a, b)
    assert got == {n: find.of(n) for n in nodes}


# --- embeddings


def brute_links(ids, vecs, threshold=0.9):
    v = np.array(vecs, float)
    n = np.sqrt((v * v).sum(1))
    link = (v @ v.T) / (n[:, None] * n[None]) >= threshold
    np.fill_diagonal(link, False)
    find = Find(ids)
    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        find.join(ids[i], ids[j])
    return {i: (int(k), find.of(i)) for i, k in zip(ids, link.sum(1), strict=True)}


@pytest.mark.parametrize("block", [60, 4096])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    pts = [b + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.35]) for b in rng.normal(size=(30, 16)) for _ in range(rng.integers(1, 20))]
    pts += [pts[0]] * 20 + [2 * pts[1]]
    ids = rng.permutation(len(pts)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, pts, strict=True)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 5), (9005, [1.0] * 15 + [None]), (9006, [float("inf")] * 16), (None, pts[0].tolist())]
    got = embeddings.linked(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))).collect()
    assert len(got) == len(rows) + len(odd)
    want = brute_links(ids, pts)
    for r in got:
        if r.vec_id is None or r.vec_id > 9000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_embeddings_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.linked(df).count() == 0
    assert embeddings.linked(spark.createDataFrame([(1, None)], df.schema)).collect()[0].n_links == 0


# --- mixing


def test_targets_fill_to_the_brim(spark):
    rows = [(f"={s}" if s else "~", s, n) for s, n in (("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 600))]
    got = {r.src: r.target for r in mix.targets(spark.createDataFrame(rows, "src string, source string, source_size long")).collect()}
    goal, weight = 1.5 * 2615, {"=a": 5, "=b": 2, "=c": 1, "=d": 5, "~": 2}
    assert sum(got.values()) == pytest.approx(goal)
    full = {s for s, _, n in rows if got[s] == 2 * n}
    levels = {round(got[s] / weight[s], 6) for s in got if s not in full}
    assert {"=a", "=d"} <= full and len(levels) == 1
    assert all(2 * n / weight[s] <= levels.copy().pop() + 1e-6 for s, _, n in rows if s in full)


def test_mix_of_odd_rows(spark, odd, none):
    got = mix.mix(odd).collect()
    assert len(got) == odd.count()
    sizes = collections.Counter()
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        sizes[r.source] += r.taken
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sizes[s] - mine[0].target) <= max(r.size for r in mine)
    again = mix.mix(odd.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    order = mix.curriculum(odd)
    assert order.columns == odd.columns and {r.doc_id for r in order.collect()}.isdisjoint({2, 3, 4})
    assert mix.mix(none).count() == 0 and mix.curriculum(none).count() == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "x " * 10, s) for i, s in enumerate(["a", "b", "c"] * 400)], "doc_id long, text string, source string")
    got = mix.mix(docs).select("source", F.explode("positions").alias("p")).toPandas()
    early = got.assign(early=got.p < 0.5).groupby("source").early.mean()
    assert early["a"] == pytest.approx(0.625, abs=0.02) and early["b"] == pytest.approx(0.4375, abs=0.02) and early["c"] == pytest.approx(0.375, abs=0.02)


def test_inverse_of_demand(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.5))
    t, w, d = ([float(a) for a, _ in knots], [float(b) for _, b in knots], mix.integrated(knots))
    lit = lambda x: F.array(*map(F.lit, x))
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        at = spark.range(1).select(mix.inverse_demand(F.lit(q), lit(t), lit(w), lit(d)).alias("t")).first().t
        grid = np.linspace(0, at, 100_001)
        assert np.trapezoid(np.interp(grid, t, w), grid) == pytest.approx(q * d[-1], abs=1e-6)


# --- the pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        frames[name] = docs.cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        if name == "exact_dedup":
            groups = collections.defaultdict(list)
            for r in before.collect():
                groups[squeezed(r.text)].append((-len(r.text), r.doc_id))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(min(g)[1] for g in groups.values())
        if name == "near_dedup":
            comp, _ = brute_near([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(comp.values()))
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in frames["mix_sources"].collect()}
    for r in frames["bpe"].collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(lib.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert frames["bpe"].count() == frames["mix_sources"].count()
    last = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, last.collect())) == sorted(map(repr, frames["bpe"].collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert docs.count() >= 0, name


def test_shingles_of_sliced_batches():
    texts = pa.array(["a b c d e", None, "", "A  B\tc d e"])
    whole = list(near.shingle_sets(texts, 4))
    assert [len(s) for _, s in whole] == [2, 0, 0, 2] and whole[0][0] == whole[3][0]
    assert [m for m, _ in near.shingle_sets(texts.slice(3), 4)] == [whole[3][0]]
