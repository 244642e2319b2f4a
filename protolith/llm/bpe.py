"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Words are counted over all documents.  The most frequent ones, with the ids that
the merges give them, are compiled into a minimal acyclic automaton whose arcs
carry numbers: the sum along a word's path is its place in the list of outputs,
so words share both prefixes and suffixes and still have their own ids.  The
lexicon is one flat file that each worker maps into memory; a batch's distinct
words walk it in lock-step.  Words that it lacks are merged exactly.

Words are found for whole batches at once by classes of code points; texts with
code points beyond Latin letters and common punctuation, or with the strings of
special tokens, take the tokenizer's own normaliser and pre-tokenizer to find
their words, and share the rest.

Results equal those of the tokenizers library with ``add_special_tokens=False``
for BPE files whose normaliser is NFC, white space and lower case, whose words
are contractions, letter runs, single digits and runs of other signs, and which
decode to the tokens joined by spaces.

Defined results: null text counts as empty and has no ids; a null id is returned
with its text's ids; texts of any length are encoded whole, in batches of about
``BATCH_BYTES``; repeated rows are all returned, and the ids of equal texts are
equal; ties in frequency at the lexicon's bound leave all words of that count out,
which changes no ids; an empty table has an empty lexicon and an empty result.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import discard, table, written
from protolith.llm._vec import WordTable, all_below, as_bytes, chunks, code_points, hash_words

#: Words in the lexicon at most; the others are merged, so this bounds memory and changes no result.
LEXICON_WORDS = 1 << 17
#: Distinct words whose ids a worker remembers, beside the mapped lexicon.
MEMO_WORDS = 400_000
#: Texts that are encoded at once, in bytes, about.
BATCH_BYTES = 1_500_000
#: Code points below this have a class of their own in the fast path.
FAST = 0x250
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: The class of each code point below FAST, and last that of all others.
_CLASS = np.array([SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(FAST)] + [OTHER], dtype=np.uint8)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


SIGNS = byte_signs()


def contracted(units: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """Moves the starts of words around contractions such as 're.

    start: 0 within a word, 1 at its start, 2 at the start of a text.
    at: places of apostrophes where a word starts.
    """
    n, done = len(units), np.zeros(len(at), dtype=bool)
    for tail in CONTRACTIONS:
        fits = ~done & (at + len(tail) < n)
        for k, c in enumerate(tail, 1):
            where = np.minimum(at + k, n - 1)
            fits &= (units[where] == ord(c)) & (start[where] != 2)
        hit = at[fits]
        start[hit + 1] = 0
        after = hit + 1 + len(tail)
        after = after[after < n]
        start[after] = np.maximum(start[after], 1)
        done |= fits


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts and ends of the words, and each text's offsets into them.

    For texts below ``FAST`` that are lower-cased already.
    """
    units, offs = code_points(texts)
    n = len(units)
    if not n:
        return units, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _CLASS.take(units, mode="clip")
    start = np.ones(n, dtype=np.uint8)  # 2: first of a text
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start[offs[:-1][offs[:-1] < n]] = 2
    contracted(units, start, np.flatnonzero((start > 0) & (units == 39)))
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    keep = kind[first] != SPACE
    first, last = first[keep], last[keep]
    return units, first, last, np.searchsorted(first, offs)


@dataclass
class Merges:
    """Exact byte-pair merging of single words."""

    ids: dict[str, int]
    rank: dict[tuple[int, int], tuple[int, int]]
    suffix: str
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        ids, end = m["vocab"], m.get("end_of_word_suffix") or ""
        rank = {}
        for k, pair in enumerate(m["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rank.setdefault((ids[a], ids[b]), (k, ids[a + b]))
        return cls(ids, rank, end, {t["content"]: t["id"] for t in d["added_tokens"]})

    def word(self, data: bytes) -> list[int]:
        """The ids of one word, given as UTF-8."""
        signs = [SIGNS[b] for b in data]
        signs[-1] += self.suffix
        out = [self.ids[s] for s in signs]
        while len(out) > 1:
            best = min((self.rank.get(p, (1 << 40, -1)) for p in pairwise(out)), default=(1 << 40, -1))
            if best[1] < 0:
                break
            merged, k = [], 0
            while k < len(out):
                if k + 1 < len(out) and self.rank.get((out[k], out[k + 1]), (-1, -1)) == best:
                    merged.append(best[1])
                    k += 2
                else:
                    merged.append(out[k])
                    k += 1
            out = merged
        return out


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to lists of ids, in one flat buffer.

    Arcs lie in order of (state, byte); an arc holds its target and how many
    accepted words come before its own under that state.
    """

    MAGIC = 0x50544C31

    def __init__(self, data: bytes | mmap.mmap):
        head = np.frombuffer(data, np.int64, 4)
        if head[0] != self.MAGIC:
            raise ValueError("not a lexicon")
        arcs, words, outs = map(int, head[1:])
        at = 32

        def part(kind, n):
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += -(-x.nbytes // 8) * 8
            return x

        self.key, self.to, self.skip = part(np.int64, arcs), part(np.int32, arcs), part(np.int32, arcs)
        self.final, self.offs, self.out = part(np.uint8, int(head[1]) + 2), part(np.int64, words + 1), part(np.uint32, outs)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """From sorted words, minimising each branch as soon as it is complete."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []  # of each minimal state: (byte, target)
        finals: list[bool] = []
        below: list[int] = []  # accepted words from each state
        root: list = [[], False]  # arcs so far, final
        stack, into = [root], []  # the states on the current word, and the bytes between them

        def freeze(state) -> int:
            mark = (state[1], tuple(state[0]))
            if mark not in register:
                register[mark] = len(arcs)
                arcs.append(list(state[0]))
                finals.append(state[1])
                below.append(int(state[1]) + sum(below[t] for _, t in state[0]))
            return register[mark]

        before = b""
        for w in order:
            common = 0
            while common < min(len(w), len(before)) and w[common] == before[common]:
                common += 1
            while len(stack) > common + 1:
                done = freeze(stack.pop())
                stack[-1][0].append((into.pop(), done))
            for b in w[common:]:
                stack.append([[], False])
                into.append(b)
            stack[-1][1] = True
            before = w
        while len(stack) > 1:
            done = freeze(stack.pop())
            stack[-1][0].append((into.pop(), done))
        top = freeze(root)
        # the root becomes state 0
        name = lambda s: 0 if s == top else s + 1
        key, to, skip, final = [], [], [], np.zeros(sum(map(len, arcs)) + 2 if arcs else 2, np.uint8)
        for s in sorted(range(len(arcs)), key=name):
            passed = int(finals[s])
            if finals[s]:
                final[name(s)] = 1
            for b, t in arcs[s]:
                key.append(name(s) << 8 | b)
                to.append(name(t))
                skip.append(passed)
                passed += below[t]
        sizes = np.array([len(words[w]) for w in order], np.int64)
        outs = np.array([i for w in order for i in words[w]], np.uint32)
        parts = [np.array(key, np.int64), np.array(to, np.int32), np.array(skip, np.int32), final[: len(key) + 2], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), outs]
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        return np.array([cls.MAGIC, len(key), len(order), len(outs)], np.int64).tobytes() + b"".join(pad(p.tobytes()) for p in parts)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word in the output list, or -1; all words step together."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts)) if len(self.key) else np.zeros(0, np.int64)
        out = np.full(len(starts), -1, np.int64)
        step = 0
        while len(alive):
            ended = starts[alive] + step == ends[alive]
            stop = alive[ended]
            good = stop[self.final[state[stop]] > 0]
            out[good] = total[good]
            alive = alive[~ended]
            want = state[alive] << 8 | data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            alive, at = alive[hit], at[hit]
            state[alive] = self.to[at]
            total[alive] += self.skip[at]
            step += 1
        return out


def mapped(data: bytes, owner: str = "") -> Lexicon:
    """The lexicon as a file in this machine's temporary folder, mapped into memory and shared by its workers.

    ``owner`` names the application: its older lexicons go, those of others stay.
    """
    mine = os.path.join(tempfile.gettempdir(), f"protolith-{owner}-")
    path = f"{mine}{hashlib.sha256(data).hexdigest()[:24]}.lex"
    if not os.path.exists(path):
        for old in glob.glob(f"{glob.escape(mine)}*.lex"):  # maps of them stay valid
            with contextlib.suppress(FileNotFoundError):
                os.remove(old)
        fd, part = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(part, path)
    try:
        f = open(path, "rb")
    except FileNotFoundError:  # another worker has just removed it
        return Lexicon(data)
    with f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Codec:
    """Encodes batches of texts; holds the lexicon, the merges and a bounded memory of other words."""

    def __init__(self, tokenizer: str, lexicon: Lexicon):
        from tokenizers import Tokenizer

        self.merges, self.lexicon = Merges.read(tokenizer), lexicon
        self.library = Tokenizer.from_file(tokenizer)
        self.special = self.merges.special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in [*self.merges.ids.items(), *self.special.items()]}
        self.names = [names.get(i, "").encode() for i in range(max(names, default=-1) + 1)]
        self.memo = WordTable(MEMO_WORDS)

    def ids_of(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each has; words that the worker hasn't met go through the lexicon or the merges."""
        return self.memo.ids(*as_bytes(units, starts, ends), self.looked_up)

    def looked_up(self, words: list[bytes]) -> list[list[int]]:
        """The ids of distinct words: those of the lexicon, else merged."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes)
        place = self.lexicon.places(np.frombuffer(b"".join(words), np.uint8), last - sizes, last)
        offs, out = self.lexicon.offs, self.lexicon.out
        return [out[offs[p] : offs[p + 1]].tolist() if p >= 0 else self.merges.word(w) for w, p in zip(words, place.tolist(), strict=True)]

    def normal(self, text: str) -> list[list[bytes] | int]:
        """Words (as UTF-8) between special tokens (as ids), by the tokenizer's own normaliser and pre-tokenizer."""
        out: list[list[bytes] | int] = []
        back = {s: b for b, s in enumerate(SIGNS)}
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                normal = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
                out.append([bytes(back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        low = [t.lower() for t in texts]
        plain = all_below(*code_points(texts), FAST)
        if self.split:
            plain = [p and not ("<|" in t and self.split.search(t)) for p, t in zip(plain, texts, strict=True)]
        units, s, e, own = words_of([t for t, p in zip(low, plain, strict=True) if p])
        ids, count = self.ids_of(units, s, e)
        cut = np.concatenate([[0], np.cumsum(count)])[own]
        slow = iter(self._slow([t for t, p in zip(texts, plain, strict=True) if not p]))
        out, k = [], 0
        for p in plain:
            if p:
                out.append(ids[cut[k] : cut[k + 1]])
                k += 1
            else:
                out.append(next(slow))
        return out

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts whose words the tokenizer's own rules find, the words of all of them looked up at once."""
        parts = [self.normal(t) for t in texts]
        words = [w.decode() for text in parts for part in text if not isinstance(part, int) for w in part]
        units, offs = code_points(words)
        ids, count = self.ids_of(units, offs[:-1], offs[1:])
        cut, k, out = np.concatenate([[0], np.cumsum(count)]), 0, []
        for text in parts:
            seen = [np.zeros(0, np.uint32)]
            for part in text:
                n = 0 if isinstance(part, int) else len(part)
                seen.append(np.array([part], np.uint32) if isinstance(part, int) else ids[cut[k] : cut[k + n]])
                k += n
            out.append(np.concatenate(seen))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that the ids stand for, special tokens included."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


class WordTally:
    """Distinct words with their counts, by hash; bounded by what is put in before it is emptied."""

    def __init__(self):
        self.hashes, self.n, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string())

    def add(self, words: pa.Array, hashes: np.ndarray, n: np.ndarray) -> None:
        self.hashes, first, back = np.unique(np.concatenate([self.hashes, hashes]), return_index=True, return_inverse=True)
        self.n = np.bincount(back, np.concatenate([self.n, n])).astype(np.int64)
        self.words = pa.concat_arrays([self.words, words]).take(pa.array(first))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([self.words, pa.array(self.n)], names=["word", "n"])
        self.__init__()
        return out


def tokenizer_path(tokenizer: str) -> str:
    """The file of a tokenizer that is given by its name or by its path."""
    return tokenizer if os.path.exists(tokenizer) else public_tokenizers.path(tokenizer)


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; each task's words are counted before the shuffle."""

    def count(batches):
        tally, own = WordTally(), lambda t: _codec(tokenizer_path(tokenizer), Lexicon.compile({}), "").normal(t)
        for b in batches:
            for part in chunks(b, text_col, BATCH_BYTES):
                texts = [t for t in part.column(0).to_pylist() if t]
                plain = all_below(*code_points(texts), FAST)
                units, s, e, _ = words_of([t.lower() for t, p in zip(texts, plain, strict=True) if p])
                # words that the tokenizer's own rules find, in the other texts
                more = [w.decode() for t, p in zip(texts, plain, strict=True) if not p for x in own(t) if not isinstance(x, int) for w in x]
                if more:
                    rest, offs = code_points(more)
                    s, e = np.concatenate([s, offs[:-1] + len(units)]), np.concatenate([e, offs[1:] + len(units)])
                    units = np.concatenate([units, rest])
                if len(s):
                    h, first, n = np.unique(hash_words(units, s, e, 3), return_index=True, return_counts=True)
                    text = units.tobytes().decode("utf-32-le", "surrogatepass")
                    tally.add(pa.array([text[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)], pa.string()), h, n)
                if len(tally.n) > MEMO_WORDS:
                    yield tally.batch()
        yield tally.batch()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """The flat lexicon of the ``most`` most frequent words that occur twice at least.

    The least count that fits is read off the counts of counts, so what reaches
    the driver is bounded by ``most`` and not by the number of words.
    """
    words = written(word_counts(docs, tokenizer, text_col).filter("n > 1"), "bpe-words")
    tally = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = tally.orderBy(F.desc("n")).limit(most).collect()  # a count of counts: each row stands for a word at least
    total, least = 0, 2
    for r in upto:
        total += r.words
        if total > most:
            least = r.n + 1
            break
    chosen = words.filter(F.col("n") >= least).select("word").toArrow().column(0).to_pylist()
    discard(words)
    merges = Merges.read(tokenizer_path(tokenizer))
    return Lexicon.compile({w.encode(): merges.word(w.encode()) for w in chosen})


def encode(docs: DataFrame, lexicon: bytes, tokenizer_name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text for every row."""
    return _encoded(docs, lexicon, tokenizer_name, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([t.decode() for t in text], pa.string())])


def digests(docs: DataFrame, lexicon: bytes, tokenizer_name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row."""
    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
    return _encoded(docs, lexicon, tokenizer_name, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: [pa.array([len(x) for x in ids], pa.int64()), sha(x.astype("<u4").tobytes() for x in ids), sha(text)])


_CODECS: dict = {}


def _codec(tokenizer: str, data: bytes, owner: str) -> Codec:
    """One codec for each lexicon and worker; without words it needs no file."""
    mark = (tokenizer, hashlib.sha256(data).hexdigest())
    if mark not in _CODECS:
        _CODECS.clear()
        _CODECS[mark] = Codec(tokenizer, mapped(data, owner) if owner else Lexicon(data))
    return _CODECS[mark]


def _encoded(docs, lexicon, name, id_col, text_col, columns, form) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    shared, owner = sc.broadcast(lexicon), sc.applicationId  # bounded by LEXICON_WORDS

    def run(batches):
        codec = _codec(tokenizer_path(name), shared.value, owner)
        for b in batches:
            for part in chunks(b, "text", BATCH_BYTES):
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                for at in range(0, len(ids), 256):
                    some = ids[at : at + 256]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(some)), *form(some, [codec.decode(x) for x in some])], names=["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, {columns}")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = table(spark, sf_dir, "documents"), "word_bpe_49k.json"
    return digests(docs, build_lexicon(docs, name), name)
