"""BPE encoding and decoding by speculation: greedy tokens, vectorised pair checks, exact merging of failures.

A token sequence is the BPE encoding of a word exactly when every token encodes to itself and no adjacent pair
could have merged across its boundary. Greedy longest match proposes tokens for all unseen words of a batch, one
numpy pass tests every adjacent pair of the batch against the merge table, and only words with a failing pair go
through merging.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm.textarrays import trim

#: Split pattern of byte-level BPE (fixed value of the published vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these ranges the regex module and the tokenizers library may know different Unicode versions; texts with
#: such characters are split by the library's own pre-tokenizer.
AGREED = regex.compile("[^\\x00-\\u0557\\u2000-\\u208E\\u3000-\\u9FEF\\uAC00-\\uD7A3\\U0001F300-\\U0001F64F]")
#: Words remembered per Python worker and generation; two generations are kept, so memory stays bounded.
CACHE_WORDS = 100_000
#: Text handled at once inside a batch, in characters.
CHUNK_CHARS = 500_000
#: Words up to this many bytes are merged together in numpy, longer ones one by one with a heap.
SHORT_WORD = 64
NO_RULE = np.int64(1) << 40


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class SpeculativeBPE:
    """Encoder and decoder over a tokenizers-format JSON file of a byte-level BPE."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        as_bytes = {s: bytes(alphabet[c] for c in s) for s in vocab}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for s, i in vocab.items():
            self.token_bytes[i] = as_bytes[s]
        for s, i in added.items():
            self.token_bytes[i] = s.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rules[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([(x << 32) | y for x, y in self.rules], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.key_to = np.array([z for _, z in self.rules.values()], np.int64)[order]
        self.byte_ids = np.array(self.byte_id, np.int64)
        # Only tokens that encode to themselves may be proposed.
        self.ids = {b: i for s, b in as_bytes.items() if self.merge(b) == [i := vocab[s]]}
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            for head in {b[:2], b[:3]}:
                self.longest[head] = max(len(b) if head == b[:3] or len(head) == 3 else 2, self.longest.get(head, 1))
        self.added = added
        self.split_added = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.words = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path)
        self.cache_words, self.cache, self.old = cache_words, {}, {}

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the lowest rule, leftmost first; a heap keeps long words at n log n."""
        ids = [self.byte_id[b] for b in word]
        n, rules = len(ids), self.rules
        if n < 2:
            return ids
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if r := rules.get((z, ids[k])):
                    heapq.heappush(heap, (r[0], i, z, ids[k], r[1]))
            h = prev[i]
            if h >= 0 and (r := rules.get((ids[h], z))):
                heapq.heappush(heap, (r[0], h, ids[h], z, r[1]))
        return [x for x in ids if x >= 0]

    def rule(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the rule of each pair; NO_RULE where there is none."""
        key = (x << 32) | y
        pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[pos] == key, self.key_rank[pos], NO_RULE), self.key_to[pos]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed exact encodings of short words: every round applies to each word its lowest rule, leftmost first."""
        out = [b""] * len(words)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), list(map(len, words)))
        rank, to = np.full(len(ids), NO_RULE), np.zeros(len(ids), np.int64)
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pairs], to[pairs] = self.rule(ids[pairs], ids[pairs + 1])
        while ids.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NO_RULE, sizes)
            if over.any():
                packed, done = ids[over].astype("<u4").tobytes(), best == NO_RULE
                at = 0
                for w, k in zip(owner[starts[done]].tolist(), (sizes[done] * 4).tolist(), strict=True):
                    out[w] = packed[at : at + k]
                    at += k
                ids, owner, rank, to = ids[~over], owner[~over], rank[~over], to[~over]
                best, sizes = best[~done], sizes[~done]
                if not ids.size:
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            ids[hits] = to[hits]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            moved = hits - np.arange(len(hits))
            ids, owner, rank, to = ids[stay], owner[stay], rank[stay], to[stay]
            for i in (moved, moved[moved > 0] - 1):
                j = np.minimum(i + 1, len(ids) - 1)
                r, t = self.rule(ids[i], ids[j])
                rank[i], to[i] = np.where((owner[i] == owner[j]) & (i != j), r, NO_RULE), t
        return out

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, i, n, get, longest = [], 0, len(word), self.ids.get, self.longest.get
        while i < n:
            j = i + (longest(word[i : i + 3]) or longest(word[i : i + 2], 1))
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For every pair, whether no rule could have joined the pieces on both sides of its boundary.

        Pieces at the boundary are undone in reverse order of their creation. A rule between two pieces that
        existed at once wins if it ranks below the rule that consumed the left piece, or not above the one that
        consumed the right piece (of equal rules the leftmost goes first).
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        used_x = np.full(len(a), NO_RULE)
        used_y = used_x.copy()
        while at.size:
            r, _ = self.rule(x, y)
            clash = (r < used_x) & (r <= used_y) & (r < NO_RULE)
            ok[at[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            at, x, y, used_x, used_y, rx, ry = (v[go] for v in (at, x, y, used_x, used_y, rx, ry))
            undo = rx > ry
            used_x, used_y = np.where(undo, rx, used_x), np.where(undo, used_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode unseen words into the cache."""
        raw = [w.encode() for w in words]
        proposed = [[self.added[w]] if w in self.added else self.greedy(b) for w, b in zip(words, raw, strict=True)]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        same = owner[1:] == owner[:-1] if len(flat) else np.zeros(0, bool)
        first = np.flatnonzero(same)
        fails = np.unique(owner[first[~self.compatible(flat[first], flat[first + 1])]]).tolist() if first.size else []
        cache = self.cache
        packed, start = flat.astype("<u4").tobytes(), 0
        for w, end in zip(words, (np.cumsum(sizes) * 4).tolist(), strict=True):
            cache[w] = packed[start:end]
            start = end
        short = [i for i in fails if len(raw[i]) <= SHORT_WORD]
        for i, ids in zip(short, self.merge_all([raw[i] for i in short]) if short else [], strict=True):
            cache[words[i]] = ids
        for i in fails:
            if len(raw[i]) > SHORT_WORD:
                cache[words[i]] = np.array(self.merge(raw[i]), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the unseen words of all texts are learned at once."""
        split = [self.pieces(t) for t in texts]
        if len(self.cache) > self.cache_words:
            self.old, self.cache = self.cache, {}
        cache, old, new = self.cache, self.old, []
        for w in set().union(*split).difference(cache):
            if w in old:
                cache[w] = old[w]
            else:
                new.append(w)
        if new:
            self.learn(new)
        return [b"".join(map(cache.__getitem__, words)) for words in split]

    def pieces(self, text: str) -> list[str]:
        """The words of a text; the string of an added token is a piece of its own."""
        if self.split_added is None or not any(s in text for s in self.added):
            return self._words(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*self._words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if AGREED.search(text) is None:
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, SpeculativeBPE] = {}


def load(path: str) -> SpeculativeBPE:
    """The encoder of a vocabulary file, once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBPE(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``decoded`` (string) of every whole text.

    Null and empty texts give no ids and an empty decoded text. Repeated rows are encoded each; null ids pass
    through; other columns are ignored. The strings of added tokens in a text become those tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)

        def made(i: list, x: list, d: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(x, pa.binary()), pa.array(d, pa.string())], names=["id", "ids", "decoded"])

        def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
            ids, texts, held = [], [], 0
            column = batch.column(1)
            for k, i in enumerate(batch.column(0).to_pylist()):
                ids.append(i)
                texts.append(column[k].as_py() or "")
                held += len(texts[-1])
                if held > CHUNK_CHARS:
                    yield ids, texts
                    ids, texts, held = [], [], 0
            if ids:
                yield ids, texts

        try:
            for batch in batches:
                for ids, texts in chunks(batch):
                    packed = bpe.encode_batch(texts)
                    yield made(ids, packed, list(map(bpe.decode, packed)))
        finally:  # Spark keeps the process for other tasks, which have no use for these words
            bpe.cache, bpe.old = {}, {}
            trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)
