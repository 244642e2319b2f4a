"""Tokens, language, toxicity, secrets and URLs against brute force, the library, or held-out rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from protolith.llm import bpe, language, secrets, tokens_out, toxicity, urls
from protolith.llm import registry as R

SIGNS = [*"abstrevmld'' \n\t.,!-123ÉéßİÀ½²\x85\xa0\x1c<|>_ǅ", "<|endoftext|>", "'re", "'LL", "'s", "’", "你", "́", "Σ", "😀", " ", " "]


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 30))) for _ in range(n)] + ["", "'s", "''s", "it's", " 's", "\n's", "  's", "\n", "  ", "'"]


def test_bpe_equals_the_library_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, merges = Tokenizer.from_file(path), bpe.Merges.read(path)
    words = [w.encode() for w in ("hello", "bald", "rev", "the", "é", "'s")]
    codec = bpe.Codec(path, bpe.Lexicon(bpe.Lexicon.compile({w: merges.word(w) for w in words})))
    texts = odd_texts(1500, 1)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert codec.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_lexicon_is_exact_and_minimal():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é"])}
    lex = bpe.Lexicon(bpe.Lexicon.compile(words))
    ask = [*words, b"ta", b"topss", b"x", b"s"]
    ends = np.cumsum([len(w) for w in ask])
    got = lex.places(np.frombuffer(b"".join(ask), np.uint8), ends - [len(w) for w in ask], ends)
    assert [p >= 0 for p in got] == [True] * 7 + [False] * 4
    for w, p in zip(ask[:7], got, strict=False):
        assert lex.out[lex.offs[p] : lex.offs[p + 1]].tolist() == words[w]
    assert len(lex.key) < sum(map(len, words)) - 6  # suffixes are shared
    assert len(bpe.Lexicon(bpe.Lexicon.compile({})).places(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_bpe_query(spark, fresh, odd, none):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lex = bpe.build_lexicon(odd, public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.digests(odd, lex).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(none, bpe.build_lexicon(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_pieces_equal_the_library_on_odd_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), tokens_out.Encoder(path)
    texts = odd_texts(1500, 2)
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_blocks_round_trip_and_give_any_range():
    rnd = random.Random(3)
    ids = [np.array(rnd.choices(range(20), k=rnd.randint(0, 400)) + [7] * rnd.randint(0, 9), np.uint32) for _ in range(200)]
    block, every = tokens_out.Block(tokens_out.pack(ids, 50257)), np.concatenate(ids)
    assert len(block.rules) and len(block.symbols) < len(every)
    assert np.array_equal(block.all(), every)
    assert all(np.array_equal(block.document(k), x) for k, x in enumerate(ids))
    for _ in range(50):
        a, b = sorted(rnd.choices(range(len(every) + 1), k=2))
        assert np.array_equal(block.tokens(a, b), every[a:b])
    assert len(tokens_out.Block(tokens_out.pack([], 50257)).all()) == 0


def test_token_files(spark, odd, none, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens_out.write_tokens(odd, str(tmp_path / "t"))
    got = tokens_out.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    at = 0
    for r, (known, i, text) in zip(got, rows, strict=True):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokens_out.write_tokens(none, str(tmp_path / "n"))
    assert tokens_out.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in R.QUERIES["op2_language_id"](spark, sf).collect()}
    want = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [i for i, r in got.items() if r.held_out]
    assert set(got) == set(want) and {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(got[i].lang_pred == want[i] for i in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark, odd, none):
    model = language.trained(odd)
    got = language.identify(odd, model).collect()
    by_text = {(r.doc_id, r.lang_pred == "und") for r in got}
    assert len(got) == odd.count() and {(2, True), (3, True), (4, True), (6, True), (7, False)} <= by_text
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    kept = language.with_language(odd)
    assert kept.columns == odd.columns and {2, 3, 4, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.with_language(none).count() == 0 and language.identify(none, language.trained(none)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.trained(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_far_apart(n):
    code = language.codewords(n).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= {2: 1, 3: 2, 4: 4, 5: 8}.get(n, 4)
    if n > 5:  # the best of the draws, drawn once more
        bits, rng, best = code.shape[1], np.random.default_rng(7), 0
        for _ in range(200):
            draw = np.where(rng.random((n, bits)) < 0.5, 1, -1)
            if not (np.abs(draw.sum(0)) == n).any():
                best = max(best, min((draw[i] != draw[j]).sum() for i in range(n) for j in range(i)))
        assert min(apart) == best


def brute_decode(model, text):
    """Language and losses by their definition, one trigram, bit and codeword at a time."""
    data, total = text.lower().encode(), [0.0] * model.code.shape[1]
    for k in range(len(data) - 2):
        x = (data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 % 2**32 >> 16
        total = [t + float(w) for t, w in zip(total, model.table[x], strict=True)]
    root = max(len(data) - 2, 1) ** 0.5
    loss = [sum(w * math.log(1 + math.exp(-c * t / root)) for c, t, w in zip(code, total, model.bits, strict=True)) / sum(model.bits) for code in model.code.tolist()]
    order = sorted(range(len(loss)), key=lambda k: loss[k])
    return order[0], loss[order[1]] - loss[order[0]]


def test_decoding_equals_brute_force_and_flags_short_and_mixed_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.trained(docs)
    rows = [r for r in docs.filter("text IS NOT NULL AND length(text) BETWEEN 1000 AND 4000").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    for t in [r.text[:400] for r in rows[:20]] + ["", "a", "ab", "été", "x y z"]:
        k, _, gap = model.decode(model.evidence(np.frombuffer(t.lower().encode(), np.uint8)))
        want, wide = brute_decode(model, t)
        assert gap == pytest.approx(wide, abs=1e-4) and (k == want or wide < 1e-4)
    by = {lang: [r.text[:900] for r in rows if r.lang == lang] for lang in model.langs}
    mixed = [a + " " + b for x, y in zip(model.langs, model.langs[1:], strict=False) for a, b in zip(by[x], by[y], strict=False)]
    made = [(i, t) for i, t in enumerate([*mixed, *(r.text for r in rows), "de", "a"])]
    monkeypatch.setattr(language, "BLOCK", 1000)  # texts are longer than a block
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(made, "doc_id long, text string"), model).collect()}
    flag = [got[i].ambiguous for i in range(len(made))]
    seen, pure = flag[: len(mixed)], flag[len(mixed) : -2]
    assert mixed and sum(seen) > 0.8 * len(seen) and sum(pure) < 0.05 * len(pure) and all(flag[-2:])


def brute_segments(gain):
    """Maximal scoring segments by their definition: best first, then left and right of it."""
    best = max(((sum(gain[i : j + 1]), -(j - i), i, j) for i in range(len(gain)) for j in range(i, len(gain))), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    right = [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(gain[j + 1 :])]
    return brute_segments(gain[:i]) + [(best[0], i, j)] + right


def test_segments_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        gain = rng.choice([-3.1, -1.7, -0.9, 1.3, 2.2, 4.05], size=rng.integers(0, 14)).tolist()
        total = np.concatenate([[0], np.cumsum(gain)])
        up = [k for k, g in enumerate(gain) if g > 0]
        got = toxicity.segments([total[k] for k in up], [total[k + 1] for k in up])
        assert [(round(s, 6), up[a], up[b]) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in brute_segments(gain)]


def toxic_tables(spark):
    rnd = random.Random(5)
    plain = ["the", "house", "river", "green", "walks", "under", "tree", "stone", "light", "over"]
    docs, labels = [], []
    for i in range(400):
        words = rnd.choices(plain, k=rnd.randint(20, 200))
        bad = i % 4 == 0
        if bad:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(["grumbolo", "grumbax", "snarfle"]) for _ in range(2)]
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_rows_and_unseen_forms(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.score(docs, model, held_out=toxicity.held_out()).collect() if r.held_out]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    text = "The é house. GRUMBZZZ grumbolo, river " + "light " * 300
    row = toxicity.score(spark.createDataFrame([(1, text), (2, "light " * 50)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in row] == [1, 0] and not row[1].passages
    p = row[0].passages[0]
    assert text[p.start : p.end] == "GRUMBZZZ grumbolo"


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(odd, labels.filter("toxic = 0"), ~toxicity.held_out())
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.0}


BASE = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    (re.compile("[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= least)


def test_secrets_equal_brute_force(spark, odd):
    rnd = random.Random(6)
    parts = ["secret", "TOKEN", "apikey", "api_key", "=", ":", " ", "'", '"', "abc", "token=", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2, "é", "😀", "-", "\n", "passwd"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 25)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = dict(rows)
    got = secrets.Ledger(spark).scan(docs).filter("doc_id >= 9").collect()
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind < 3] == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_ledger_scans_only_what_it_has_not_seen(spark, odd, tmp_path):
    ledger = secrets.Ledger(spark)
    assert ledger.scan(odd).count() == odd.count()
    n = ledger.entries().count()
    assert n == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    more = spark.createDataFrame([(90, "token=abcdef1234"), (91, "token=abcdef1234"), (92, "")], "doc_id long, text string")
    found = {r.doc_id: len(r.spans) for r in ledger.scan(odd.select("doc_id", "text").unionByName(more)).collect() if (r.doc_id or 0) >= 90}
    assert found == {90: 1, 91: 1, 92: 0} and ledger.entries().count() == n + 1
    newer = secrets.Ledger(spark, ledger.path, version=2)
    assert newer.entries().count() == 0 and newer.scan(more).count() == 3 and newer.entries().count() == 2
    key = "-----BEGIN RSA PRIVATE KEY-----"
    row = ledger.scan(spark.createDataFrame([(1, f"x {key}")], "doc_id long, text string")).first()
    assert [tuple(s) for s in row.spans] == [(2, 3, 2 + len(key))]


def test_secret_plan_runs_no_python(spark):
    plan = R.QUERIES["op4_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/7x?q=/en/", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://a.com/en/", "a.com", "/en/", "com/en/", "block"),
        (3, "http://example.net/de/85#a", "example.net", "/de/85", "example.net/de/8", "block"),
        (4, "http://badexample.org/x", "badexample.org", "/x", None, "allow"),
        (5, "http://my-casino.org/x", "my-casino.org", "/x", None, "block"),
        (6, "http://cheap-pills.org", "cheap-pills.org", "", None, "block"),
        (7, "http://cheap-cheap.org/cheapest", "cheap-cheap.org", "/cheapest", None, "allow"),
        (8, "http://casinos.org/xcasino", "casinos.org", "/xcasino", None, "allow"),
        (9, "mailto:casino", "", "", None, "block"),
        (10, None, "", "", None, "allow"),
        (11, "", "", "", None, "allow"),
        (12, "http://com/en/7", "com", "/en/7", "com/en/", "block"),
        (None, "http://a.net:80/de/", "a.net:80", "/de/", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert urls.judge(pages.limit(0)).count() == 0
    long = "http://a.net/" + "x/" * 200_000 + "casino"
    twice = spark.createDataFrame([(1, long), (1, long), (2, long + "o")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.strict_hits) for r in urls.judge(twice).collect()) == [(1, "block", 1), (1, "block", 1), (2, "allow", 0)]


def test_url_vocabulary_is_weighed_and_bounded(spark, tmp_path, monkeypatch):
    terms = [("alpha", "soft", 0.5), ("beta", "soft", 1.5), ("gamma", "strict", 1.0), ("alpha", "soft", 0.25), ("a.b", "soft", 2.0), ("", "soft", 9.0)]
    pages = spark.createDataFrame([(1, "http://x/alpha"), (2, "http://x/alpha-beta"), (3, "http://x/beta/beta"), (4, "http://gamma/"), (5, "http://a.b/alphabet"), (6, "http://x/éalphaé")], "page_id long, url string")
    want = {1: ("allow", 0, 1, 0.5), 2: ("block", 0, 2, 2.0), 3: ("allow", 0, 1, 1.5), 4: ("block", 1, 0, 0.0), 5: ("block", 0, 1, 2.0), 6: ("allow", 0, 1, 0.5)}
    path = tmp_path / "terms.csv"
    path.write_text("term,kind,weight\n" + "".join(f"{t},{k},{w}\n" for t, k, w in terms))
    for vocabulary in (terms, path, spark.createDataFrame(terms, "term string, kind string, weight double")):
        got = urls.judge(pages, rules=(), vocabulary=vocabulary).collect()
        assert {r.page_id: (r.verdict, r.strict_hits, r.soft_hits, r.soft_weight) for r in got} == want
    assert {r.verdict for r in urls.judge(pages, rules=(), vocabulary=[]).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.packed([("a", "hard", 1.0)])
    monkeypatch.setattr(urls, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        urls.packed(terms)
    with pytest.raises(ValueError):
        urls.terms_of(spark.createDataFrame(terms, "term string, kind string, weight double"))
