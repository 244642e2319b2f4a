"""Token-id output in blocks compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by id, encoded with the tokenizers
library's merges, ended with an end id, and packed into blocks.  In each block
the most frequent pairs of neighbouring symbols are replaced by new symbols,
round after round, until no pair occurs ``LEAST`` times or the symbols run out.
The pairs of one round are chosen so that no symbol is the
left of one and the right of another: their occurrences can't overlap, so doing
them together equals doing them one by one.

File format: a Parquet row for each block (shard, block, ids of its documents)
with a payload of little-endian fields:

    magic, vocabulary size, rules, symbols, documents     5 x uint32
    left and right symbol of each rule                    2 x uint16 a rule
    expansion length of each rule                         uint32 a rule
    token offset of each document                         uint32, documents + 1
    token offset of every STRIDE-th symbol                uint32
    symbols                                               uint16

A range of tokens is decoded from the nearest stride on, skipping by expansion
lengths.  Symbols are 16 bits wide, so the vocabulary must be under 65,536; a
larger one, or an id outside it, is an error and never cut.

Defined results: null text is the empty text, which has the end id alone; null
ids come first, then ascending; rows that repeat an id keep the order of their
texts, ties of both have equal ids; a text longer than a block has a block of its
own; an empty table has no blocks.  Only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate, chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolith.llm._common import table, work_path
from protolith.llm._vec import WordTable, all_below, as_bytes, chunks, code_points
from protolith.llm.bpe import _CLASS, FAST, SIGNS, contracted
from protolith.llm.bpe import SPACE as BLANK

#: Tokens of a block, about; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 20
#: New symbols in a round at most, which bounds the table of pairs, and the least count that pays for one.
ROUND_PAIRS, LEAST = 4096, 12
STRIDE = 1024
MAGIC = 0x52505231
MEMO_WORDS = 1_600_000
BATCH_BYTES = 1_500_000
#: Pieces of so many bytes at most are merged together in lock-step; longer ones by the library.
LOCK_STEP = (6, 10, 16, 32)
END_ID = 2


def pieces_of(units: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of byte-level pieces, and each text's offsets into them.

    A piece is a contraction, or a run of letters, digits or other signs with the
    space before it, or white space that nothing takes.  For texts below FAST.
    """
    n = len(units)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _CLASS.take(units, mode="clip")
    start = np.ones(n, dtype=np.uint8)  # 2: first of a text
    np.not_equal(kind[1:], kind[:-1], out=start[1:].view(bool))
    start[offs[:-1][offs[:-1] < n]] = 2
    blank = kind == BLANK
    # the last blank before a word stands apart from those before it; a space joins the word
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (start[1:] != 2))
    start[last] = np.maximum(start[last], 1)
    start[last[units[last] == 32] + 1] = 0
    contracted(units, start, np.flatnonzero((start > 0) & (units == 39)))
    first = np.flatnonzero(start)
    return first, np.append(first[1:], n), np.searchsorted(first, offs)


class Merges:
    """The merges of a byte-level BPE file, done for many pieces in lock-step: in each, the first pair of the least rank.

    ``exact`` says that this equals the library: the file has no options, the sign of
    every byte, and no merge that makes what an earlier one uses or another one makes,
    so a merge never brings up a pair of a lower rank than its own.
    """

    NONE, GONE = np.uint32(0x7FFFFFFF), np.uint32(0xFFFF)  # the rank of no merge; a place without a symbol

    def __init__(self, tokenizer: str):
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: k for k, (a, b) in enumerate(merges)}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        self.exact = (
            not any(model.get(k) for k in options)
            and all(c in vocab for c in SIGNS)
            and max(vocab.values(), default=0) < self.GONE
            and len(made) == len(merges)
            and all(made.get(x, -1) < k for k, m in enumerate(merges) for x in m)
        )
        if not self.exact:
            return
        self.of_byte = np.array([vocab[c] for c in SIGNS], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        codes = np.array([vocab[a] | vocab[b] << 16 for a, b in merges], np.uint32)
        self.shift = np.uint32(32 - max(4, (8 * len(codes)).bit_length()))
        self.slots = np.full(1 << 32 - int(self.shift), np.uint64(0xFFFFFFFF << 32) | np.uint64(self.NONE))  # a pair, and its rank
        value, slot = codes.astype(np.uint64) << np.uint64(32) | np.arange(len(codes), dtype=np.uint64), self._slot(codes)
        empty = self.slots[0]
        while len(slot):
            free = np.flatnonzero(self.slots[slot] == empty)
            now = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[now]] = value[now]
            left = np.ones(len(slot), dtype=bool)
            left[now] = False
            slot, value = (slot[left] + 1) % len(self.slots), value[left]
        self.of_bytes = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of symbols, or NONE."""
        codes = a | b << np.uint32(16)
        slot = self._slot(codes)
        seen = self.slots[slot]
        out, pair = seen.astype(np.uint32), (seen >> np.uint64(32)).astype(np.uint32)
        go = np.flatnonzero((pair != codes) & (out != self.NONE))
        out[pair != codes] = self.NONE
        while len(go):
            slot[go] = (slot[go] + 1) % len(self.slots)
            seen = self.slots[slot[go]]
            rank, same = seen.astype(np.uint32), (seen >> np.uint64(32)).astype(np.uint32) == codes[go]
            out[go[same]] = rank[same]
            go = go[~same & (rank != self.NONE)]
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in turn, and how many each has."""
        n, long = len(starts), int(size.max(initial=0))
        wide = long + 2  # a place before the first symbol and one after the last
        column = np.arange(long)
        inside = column < size[:, None]
        byte = data.take(starts[:, None] + column, mode="clip")
        s, r = np.full((n, wide), self.GONE), np.full((n, wide), self.NONE)
        s[:, 1:-1] = np.where(inside, self.of_byte[byte], self.GONE)
        r[:, 1:-2] = np.where(inside[:, 1:], self.of_bytes[byte[:, :-1].astype(np.int32) << 8 | byte[:, 1:]], self.NONE)
        flat, rank = s.ravel(), r.ravel()
        after = np.arange(1, n * wide + 1, dtype=np.int32)
        before = np.arange(-1, n * wide - 1, dtype=np.int32)
        rows = np.arange(n)
        while True:
            at = rows * wide + (r if len(rows) == n else r[rows]).argmin(axis=1)
            least = rank[at]
            go = least != self.NONE
            if not go.all():
                rows, at, least = rows[go], at[go], least[go]
            if not len(rows):
                break
            flat[at] = new = self.made[least]
            old, left = after[at], before[at]
            flat[old], rank[old] = self.GONE, self.NONE
            after[at] = right = after[old]
            before[right] = at
            rank[at], rank[left] = self.rank(new, flat[right]), self.rank(flat[left], new)
        left = s != self.GONE
        return s[left], np.count_nonzero(left, axis=1)


class Encoder:
    """The library's encoding of whole texts, one merge for each distinct piece of a batch."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = WordTable(MEMO_WORDS)
        self.signs = {b: ord(c) for b, c in enumerate(SIGNS)}
        self.merges = Merges(tokenizer)

    def spelt(self, pieces: list[bytes]) -> list[list[int]]:
        """The library's ids of each piece; all are spelt in the signs of their bytes at once."""
        ends = list(accumulate(map(len, pieces), initial=0))
        signs = b"".join(pieces).decode("latin-1").translate(self.signs)
        return [[t.id for t in self.model.tokenize(signs[a:b])] for a, b in pairwise(ends)]

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in turn, and how many each has."""
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, found = np.cumsum(size) - size, []
        low = -1
        for most in LOCK_STEP if self.merges.exact else ():
            some = np.flatnonzero((size > low) & (size <= most))
            if len(some):
                found.append((some, *self.merges.of(data, starts[some], size[some])))
            low = most
        rest = np.flatnonzero(size > low)
        if len(rest):
            lists = self.spelt([pieces[k] for k in rest.tolist()])
            found.append((rest, np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))))
        count = np.zeros(len(pieces), np.int64)
        for some, _, n in found:
            count[some] = n
        begin, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.uint32)
        for some, ids, n in found:
            out[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, and behind them ``end`` if given."""
        units, offs = code_points(texts)
        plain = all_below(units, offs, FAST)
        for special in self.special:
            if any(special in t for t in texts):
                plain = [p and special not in t for p, t in zip(plain, texts, strict=True)]
        if not all(plain):
            units, offs = code_points([t for t, p in zip(texts, plain, strict=True) if p])
        s, e, own = pieces_of(units, offs)
        ids, size = self.memo.ids(*as_bytes(units, s, e), self.merged)
        cut = np.concatenate([[0], np.cumsum(size)])[own]
        if end is not None:
            ids, cut = np.insert(ids, cut[1:], end), cut + np.arange(len(cut))
        last = [] if end is None else [end]
        out, k = [], 0
        for t, p in zip(texts, plain, strict=True):
            out.append(ids[cut[k] : cut[k + 1]] if p else np.array(self.library.encode(t, add_special_tokens=False).ids + last, np.uint32))
            k += p
        return out


def tallied(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ascending, and how often each is there; sorts its argument."""
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    pairs.sort()
    at = np.concatenate([[0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1])
    return pairs[at], np.diff(at, append=len(pairs))


def pairs_at(s: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The symbols at these places and those after them, as numbers: the right symbol is the upper half."""
    out = s[1:][at].astype(np.uint32)
    out <<= np.uint32(16)
    out |= s[:-1][at]
    return out


def repair(tokens: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of a Re-Pair grammar for the tokens.

    Pairs are counted once.  A round then takes away the pairs that its replacements
    end and counts those that they bring, which all have a symbol of this round; any
    other pair only gets rarer, so what is below LEAST once can be forgotten.
    """
    s, rules = tokens.astype("<u2"), []
    pairs, n = tallied(pairs_at(s, slice(None)))
    often = n >= LEAST
    pairs, n = pairs[often], n[often]
    while True:
        room = min(ROUND_PAIRS, 65536 - vocabulary - len(rules))
        if not len(pairs) or room <= 0:
            break
        # by falling count, then by the pair
        found = ((np.uint64(1 << 32) - n.astype(np.uint64)) << np.uint64(32)) | pairs
        found.sort()
        found = found.astype(np.uint32)
        a, b = (found & np.uint32(0xFFFF)).astype(np.int32), (found >> np.uint32(16)).astype(np.int32)
        # a symbol is a left or a right one in this round, as in the most frequent pair that has it; a pair of
        # one symbol with itself is taken where it is the first to have that symbol
        place, never = np.arange(len(found), dtype=np.int32), len(found)
        as_left, as_right = np.full(65536, never, np.int32), np.full(65536, never, np.int32)
        as_left[a[::-1]], as_right[b[::-1]] = place[::-1], place[::-1]
        ok = np.where(a == b, (as_left[a] == place) & (as_right[a] == place), (as_left[a] < as_right[a]) & (as_right[b] < as_left[b]))
        a, b, chosen = a[ok][:room], b[ok][:room], found[ok][:room]
        # a small table of left by right symbols says which rule a pair is
        side = np.zeros(65536, np.uint8)  # 1: left, 2: right, 3: both
        side[a] = 1
        side[b] |= 2
        ls, rs = np.flatnonzero((side & 1).view(bool)), np.flatnonzero((side >> 1).view(bool))
        left, right = np.zeros(65536, np.int32), np.zeros(65536, np.int32)
        left[ls], right[rs] = np.arange(len(ls)) * len(rs), np.arange(len(rs))
        rule = np.full(len(ls) * len(rs), -1, np.int16)
        rule[left[a] + right[b]] = np.arange(len(a))
        at = side.take(s, mode="clip")
        hit = np.flatnonzero((at[:-1] & (at[1:] >> 1)).view(bool))
        where = rule.take(left.take(s[hit], mode="clip") + right.take(s[hit + 1], mode="clip"), mode="clip")
        ok = where >= 0
        hit, where = hit[ok], where[ok]
        # neighbouring hits only come from runs of one symbol: every second one counts
        gap = np.diff(hit)
        if gap.min(initial=2) == 1:
            run = np.arange(len(hit))
            run[1:][gap == 1] = 0
            ok = (np.arange(len(hit)) - np.maximum.accumulate(run)) % 2 == 0
            hit, where = hit[ok], where[ok]
            gap = np.diff(hit)
        # the pairs that end: those replaced, and those with the symbol before or after, each place once
        apart = np.concatenate([[hit[0] > 0], gap > 2])
        n[np.searchsorted(pairs, chosen)] -= np.bincount(where, minlength=len(chosen))
        gone, m = tallied(pairs_at(s, np.concatenate([hit[apart] - 1, (hit[:-1] if hit[-1] + 2 == len(s) else hit) + 1])))
        k = np.minimum(np.searchsorted(pairs, gone), len(pairs) - 1)
        ok = pairs[k] == gone
        n[k[ok]] -= m[ok]
        s[hit] = where.astype(np.uint16) + np.uint16(vocabulary + len(rules))
        keep = np.ones(len(s), dtype=bool)
        keep[hit + 1] = False
        s = s[keep]
        rules.extend(zip(a.tolist(), b.tolist(), strict=True))
        hit -= np.arange(len(hit))
        come, m = tallied(pairs_at(s, np.concatenate([hit[apart] - 1, hit[:-1] if hit[-1] + 1 == len(s) else hit])))
        often, more = n >= LEAST, m >= LEAST
        pairs, n = np.concatenate([pairs[often], come[more]]), np.concatenate([n[often], m[more]])
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
    return s, np.array(rules, np.uint16).reshape(-1, 2)


class Expansion:
    """What each symbol stands for, laid out in one array."""

    def __init__(self, rules: np.ndarray, vocabulary: int):
        top, total = rules.astype(np.int64).max(axis=1, initial=0), vocabulary + len(rules)
        self.flat, self.length, self.first = np.arange(vocabulary, dtype=np.uint32), np.ones(total, np.int32), np.arange(total, dtype=np.int32)
        done = vocabulary
        while done < total:  # the rules that only have symbols laid out already: a round of them at once
            later = np.flatnonzero(top[done - vocabulary :] >= done)
            to = done + int(later[0]) if len(later) else total
            some = rules[done - vocabulary : to - vocabulary]
            self.length[done:to] = self.length[some].sum(axis=1)
            self.first[done:to] = len(self.flat) + np.cumsum(self.length[done:to]) - self.length[done:to]
            self.flat = np.concatenate([self.flat, self.of(some.ravel())])
            done = to

    def of(self, s: np.ndarray) -> np.ndarray:
        """The tokens that the symbols stand for."""
        size = self.length[s]
        begin = self.first[s] - (np.cumsum(size, dtype=np.int32) - size)
        begin = np.repeat(begin, size)
        begin += np.arange(len(begin), dtype=np.int32)
        return self.flat[begin]


def vocabulary_of(tokenizer_name: str, end_id: int) -> int:
    """The number of ids of a tokenizer; an error where symbols of 16 bits can't hold them and a rule."""
    from tokenizers import Tokenizer

    n = max(Tokenizer.from_file(public_tokenizers.path(tokenizer_name)).get_vocab(with_added_tokens=True).values()) + 1
    if not 0 <= end_id < n:
        raise ValueError(f"the end id {end_id} isn't one of the tokenizer's {n} ids")
    if n >= 65536:
        raise ValueError(f"{n} ids don't fit symbols of 16 bits")
    return n


def pack(ids: list[np.ndarray], vocabulary: int) -> bytes:
    """A block's payload; an error where an id is not below ``vocabulary``, or that not below 65,536."""
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if vocabulary >= 65536 or len(tokens) and int(tokens.max()) >= vocabulary:
        raise ValueError(f"ids must be below the vocabulary's size of {vocabulary}, and that below 65,536")
    s, rules = repair(tokens, vocabulary)
    length = Expansion(rules, vocabulary).length.astype(np.int64)
    before = np.cumsum(length[s]) - length[s]
    docs = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    head = np.array([MAGIC, vocabulary, len(rules), len(s), len(ids)], "<u4")
    return b"".join(x.tobytes() for x in (head, rules.astype("<u2"), length[vocabulary:].astype("<u4"), docs.astype("<u4"), before[::STRIDE].astype("<u4"), s.astype("<u2")))


class Block:
    """A payload, read."""

    def __init__(self, data: bytes):
        magic, self.vocabulary, rules, symbols, docs = map(int, np.frombuffer(data, "<u4", 5))
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = 20
        self.rules = np.frombuffer(data, "<u2", 2 * rules, at).reshape(-1, 2)
        self.length = np.concatenate([np.ones(self.vocabulary, np.int64), np.frombuffer(data, "<u4", rules, at := at + 4 * rules)])
        self.expansion = Expansion(self.rules, self.vocabulary)
        self.docs = np.frombuffer(data, "<u4", docs + 1, at := at + 4 * rules).astype(np.int64)
        strides = -(-symbols // STRIDE)
        self.strides = np.frombuffer(data, "<u4", strides, at := at + 4 * (docs + 1)).astype(np.int64)
        self.symbols = np.frombuffer(data, "<u2", symbols, at + 4 * strides)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens [start, end), expanding only the symbols that cover them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.strides, start, side="right")) - 1
        z = int(np.searchsorted(self.strides, end, side="left"))
        part = self.symbols[k * STRIDE : z * STRIDE]
        before = self.strides[k] + np.cumsum(self.length[part]) - self.length[part]
        a, b = int(np.searchsorted(before, start, side="right")) - 1, int(np.searchsorted(before, end, side="left"))
        return self.expansion.of(part[a:b])[start - before[a] : end - before[a]]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.docs[k]), int(self.docs[k + 1]))

    def all(self) -> np.ndarray:
        return self.expansion.of(self.symbols)


_ENCODERS: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer_name: str = "byte_bpe_50k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending order of id, as blocks below ``path``."""
    vocabulary = vocabulary_of(tokenizer_name, end_id)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if tokenizer_name not in _ENCODERS:
            _ENCODERS[tokenizer_name] = Encoder(public_tokenizers.path(tokenizer_name))
        encoder = _ENCODERS[tokenizer_name]
        shard, block, ids, own, held = TaskContext.get().partitionId(), 0, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(own)), pa.array([pack(ids, vocabulary)], pa.binary())],
                names=["shard", "block", "n_tokens", "doc_ids", "payload"],
            )

        for b in batches:
            for part in chunks(b, "text", BATCH_BYTES):
                for k, x in enumerate(encoder.encode(part.column(1).to_pylist(), end_id)):
                    if held and held + len(x) > BLOCK_TOKENS:
                        yield done()
                        block, ids, own, held = block + 1, [], [], 0
                    ids.append(x)
                    own.append(part.column(0).slice(k, 1))
                    held += len(x)
        if ids:
            yield done()

    rows.mapInArrow(run, f"shard int, block int, n_tokens long, doc_ids array<{id_type}>, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    blocks = spark.read.parquet(path)
    per_shard = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = per_shard.select("shard", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(1)).orderBy("shard"))), F.lit(0)).alias("shard_start"))
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0)).alias("block_start")).join(shards, "shard")

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block = Block(b.column(3)[k].as_py())
                tokens, docs = block.all(), block.docs
                data = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * n, pa.int32()), pa.array([b.column(1)[k].as_py()] * n, pa.int32()), b.column(2)[k].values, pa.array(docs[:-1]), pa.array(np.diff(docs)), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(run, f"shard int, block int, doc_id {id_type}, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
