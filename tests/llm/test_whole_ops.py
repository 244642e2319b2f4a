"""Operators whose method must decide the result, and rows that a shortcut would lose."""

import json
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from protolith.llm import bpe, exact, near, tokens_out


def test_a_false_negative_of_the_filter_changes_the_result(spark, monkeypatch):
    snapshot, batch = (spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 20).alias("text")) for a, b in ((0, 20), (30, 50)))
    assert {r.group_size for r in exact.dedup(snapshot, batch).collect()} == {2}
    monkeypatch.setattr(exact, "screened", lambda groups, filters, ranges: groups.select("digest", F.lit(False).alias("maybe")))
    assert {(r.group_size, r.kept) for r in exact.dedup(snapshot, batch).collect()} == {(1, True)}


def test_a_group_of_null_ids_joins_the_snapshot(spark):
    rows = [(1, "a b"), (None, "ab"), (None, "a  b"), (None, "alone")]
    schema = "doc_id long, text string"
    for snapshot, batch in ((rows[:1], rows[1:]), (rows[1:], rows[:1]), (rows[1:2], rows[2:])):
        got = exact.dedup(spark.createDataFrame(snapshot, schema), spark.createDataFrame(batch, schema)).collect()
        assert sorted(r.group_size for r in got) == [1] + [len(got) - 1] * (len(got) - 1)


def test_a_text_of_a_repeated_id_stays_where_no_copy_of_it_does(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a, "x"), (7, a, "y"), (7, b, "z"), (7, None, "w"), (None, a, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = near.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.source for r in got.collect()) == ["v", "w", "x", "z"]


def test_repair_goes_on_until_no_pair_is_frequent():
    document = np.random.default_rng(4).permutation(2000).astype(np.uint32)
    block = tokens_out.Block(tokens_out.pack([document] * 40, 50257))
    assert (block.all() == np.tile(document, 40)).all() and (block.document(17) == document).all()
    pairs, n = np.unique(np.stack([block.symbols[:-1], block.symbols[1:]]), axis=1, return_counts=True)
    assert n.max(initial=0) < tokens_out.LEAST and block.length.max() >= 2000


def recounted(tokens, vocabulary):
    """Re-Pair that counts every pair again in every round and replaces from left to right."""
    s, rules = tokens.tolist(), []
    while (room := min(tokens_out.ROUND_PAIRS, 65536 - vocabulary - len(rules))) > 0:
        counts = Counter(pairwise(s))
        often = sorted((p for p in counts if counts[p] >= tokens_out.LEAST), key=lambda p: (-counts[p], p[1], p[0]))
        left, right = ({x: k for k, x in reversed([(k, p[side]) for k, p in enumerate(often)])} for side in (0, 1))
        never, chosen = len(often), []
        for k, (a, b) in enumerate(often):
            if a == b and left[a] == right[a] == k or a != b and left[a] < right.get(a, never) and right[b] < left.get(b, never):
                chosen.append((a, b))
        if not chosen:
            break
        rule, out, k = {p: vocabulary + len(rules) + n for n, p in enumerate(chosen[:room])}, [], 0
        while k < len(s):
            new = rule.get(tuple(s[k : k + 2]))
            out.append(s[k] if new is None else new)
            k += 1 if new is None else 2
        s, rules = out, rules + chosen[:room]
    return s, [list(p) for p in rules]


def test_repair_counts_pairs_once_and_then_only_what_changes(monkeypatch):
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3000, rng.integers(2, 9)) for _ in range(500)]
    texts = [np.concatenate([words[k] for k in np.minimum(rng.zipf(1.3, 6000) - 1, 499)])]
    texts += [rng.integers(0, rng.integers(1, 30), rng.integers(0, 2000)) for _ in range(60)]
    texts += [np.repeat(x, rng.integers(1, 9, len(x))) for x in texts[1:30]]  # runs of one symbol
    for k, x in enumerate(texts):
        vocabulary = 65536 - 1 - k % 40 if k % 3 == 1 else 50257  # now and then the symbols run out
        s, rules = tokens_out.repair(x.astype(np.uint32), vocabulary)
        assert (s.tolist(), rules.tolist()) == recounted(x, vocabulary)
    seen, tallied = [], tokens_out.tallied
    monkeypatch.setattr(tokens_out, "tallied", lambda pairs: seen.append(len(pairs)) or tallied(pairs))
    s, rules = tokens_out.repair(texts[0].astype(np.uint32), 50257)
    # each replacement ends two pairs beside it and brings two, however many rounds there are
    assert len(seen) > 9 and sum(seen) <= len(texts[0]) + 4 * (len(texts[0]) - len(s))


def test_short_pieces_are_merged_together_and_not_one_by_one(monkeypatch):
    enc, rnd = tokens_out.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    pieces = [bytes(rnd.choices(letters, k=rnd.randint(1, 50))) for letters in (range(256), b"aeinorst ", b" -=", b"e") for _ in range(2000)]
    pieces += [" überflüssige Straßen".encode(), "日本語".encode(), b" antidisestablishmentarianism", b"aaaa", b"\x00"]
    exact = enc.spelt(pieces)
    asked, spelt = [], enc.spelt
    monkeypatch.setattr(enc, "spelt", lambda some: asked.extend(some) or spelt(some))
    ids, n = enc.merged(pieces)
    assert np.split(ids, np.cumsum(n)[:-1])[-1].tolist() == exact[-1] and ids.tolist() == [i for x in exact for i in x] and n.tolist() == list(map(len, exact))
    assert asked and min(map(len, asked)) > tokens_out.LOCK_STEP[-1]


def test_files_with_options_or_merges_made_twice_are_left_to_the_library(tmp_path):
    model = {"vocab": {c: k for k, c in enumerate([*bpe.SIGNS, "ab", "bc", "abc"])}, "merges": ["a b", "b c", "ab c"]}
    pieces = [b"abc", b"abcab", b"bcbc", b"xabcx" * 9]
    for changed in ({}, {"merges": ["a b", "b c", "ab c", "a bc"]}, {"merges": ["ab c", "a b", "b c"]}, {"ignore_merges": True}):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", **model, **changed}}))
        enc = tokens_out.Encoder(str(path))
        assert enc.merges.exact == (not changed)
        assert enc.merged(pieces)[0].tolist() == [i for x in enc.spelt(pieces) for i in x]
