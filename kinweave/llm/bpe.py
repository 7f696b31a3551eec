"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks every adjacent pair up by
binary search in the sorted pair keys, takes each word's lowest rank and merges all its pairs
of that rank at once, left to right without overlap. A vocabulary's merges that use a symbol
rank after the merge that makes it, so a round equals the one-by-one procedure."""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinweave.llm.common import fresh, map_texts
from kinweave.llm.pretokens import Splitter, byte_chars, description

#: Entries and characters of a worker's word cache, words merged at a time, bytes from which a word is merged alone.
CACHE_SIZE, CACHE_CHARS, BATCH_WORDS, LONG = 300_000, 1 << 24, 1 << 16, 1 << 10
_NONE = np.int64(1) << 40


class Merger:
    """The merge table of one tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        spec = description(path)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["id"] for t in spec["added_tokens"]}
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        keys, made = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] << 20 | vocab[b])
            made.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.by_rank = keys[order], order.astype(np.int64), np.array(made, np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The token ids of each pre-token (none of them empty)."""
        out: list = []
        for i in range(0, len(words), BATCH_WORDS):
            raw = [w.encode() for w in words[i : i + BATCH_WORDS]]
            made = iter(self._encode([r for r in raw if len(r) < LONG]))
            out += [next(made) if len(r) < LONG else self._encode_long(r) for r in raw]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE for pairs that never merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _encode_long(self, raw: bytes) -> list[int]:
        """One long word. Positions wait in a pool for the round of their pair's rank, and a round touches its own
        positions and their neighbours only: the cost follows the merges, not rounds times length."""
        flat = np.frombuffer(raw, np.uint8)
        n = len(flat)
        symbols = np.append(self.inner[flat], 0)
        symbols[n - 1] = self.last[flat[-1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ranks = np.full(n + 1, _NONE)
        pools: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Look the pairs that begin at these positions up anew."""
            ranks[at] = np.where(after[at] < n, self._rank(symbols[at], symbols[np.minimum(after[at], n)]), _NONE)
            at = at[ranks[at] < _NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            found, first = np.unique(ranks[at], return_index=True)
            for rank, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                if rank not in pools:
                    pools[rank] = []
                    heapq.heappush(waiting, rank)
                pools[rank].append(at[a:b])

        wait(np.arange(n))
        while waiting:
            rank = heapq.heappop(waiting)
            at = np.unique(np.concatenate(pools.pop(rank)))
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            # Of overlapping hits (runs of one symbol) every second one stays.
            new = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbols[at] = self.by_rank[rank]
            ranks[gone] = _NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            wait(np.unique(np.concatenate([at, left[left >= 0]])))
        out, at = [], 0
        hops, ids = after.tolist(), symbols.tolist()
        while at < n:
            out.append(ids[at])
            at = hops[at]
        return out

    def _encode(self, raw: list[bytes]) -> list[list[int]]:
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1] = np.where(word[:-1] == word[1:], self._rank(symbols[:-1], symbols[1:]), _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            lowest = np.repeat(best, np.diff(np.r_[starts, len(word)]))
            over = lowest == _NONE
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            hit = np.flatnonzero((ranks == lowest) & ~over)
            if len(hit):
                # Of overlapping hits (runs of one symbol) every second one stays.
                run = np.cumsum(np.r_[True, np.diff(hit) > 1])
                first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                hit = hit[(np.arange(len(hit)) - first[run - 1]) % 2 == 0]
                symbols = symbols.copy()
                symbols[hit] = self.by_rank[ranks[hit]]
            live = ~over
            live[hit + 1] = False
            symbols, word = symbols[live], word[live]
        symbols, word = np.concatenate(done_symbols or [symbols]), np.concatenate(done_words or [word])
        order = np.argsort(word, kind="stable")
        flat_ids, ends = symbols[order].tolist(), np.cumsum(np.bincount(word, minlength=len(raw))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


class Codec:
    """Encodes and decodes texts; words already met are taken from a bounded cache."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.split, self.merge, self.cache_size = Splitter(path), merger(path), cache_size
        self.words: dict[str, tuple[str, str]] = {}  # ids and tokens of a word, joined by spaces
        self.chars = 0
        self.decodes_bytes = (description(path)["decoder"] or {}).get("type") == "ByteLevel"

    def learn(self, parts: list[list]) -> None:
        fresh_words = set().union(*(s for p in parts for s in p if not isinstance(s, int)))
        missing = [w for w in fresh_words if w not in self.words]
        tokens = self.merge.tokens
        for w, ids in zip(missing, self.merge.encode(missing) if missing else []):
            self.words[w] = " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])
            self.chars += len(w)

    def encode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids and its tokens, joined by spaces."""
        parts = [self.split.segments(t or "") for t in texts]
        self.learn(parts)
        of, out = self.words.__getitem__, []
        for p in parts:
            pairs = list(map(of, p[0])) if len(p) == 1 else [x for s in p for x in ([(str(s), self.merge.tokens[s])] if isinstance(s, int) else map(of, s))]
            ids, tokens = zip(*pairs) if pairs else ((), ())
            out.append((" ".join(ids), " ".join(tokens)))
        if len(self.words) > self.cache_size or self.chars > CACHE_CHARS:
            self.words.clear()
            self.chars = 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, special ones included."""
        tokens = [self.merge.tokens[i] for i in ids]
        if not self.decodes_bytes:  # no decoder is named: tokens are joined by spaces
            return " ".join(tokens)
        back, out = self.split.to_bytes, bytearray()
        for i, t in zip(ids, tokens):
            out += t.encode() if i in self.merge.special else bytes(map(back.__getitem__, t))
        return out.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ids (array) and decoded (names that clash get a trailing _).

    Null and empty texts have no ids and decode to ''. Rows pass through one to one, repeated
    rows too; long texts are encoded whole; an empty table stays empty."""
    keep = docs.columns if keep is None else keep
    n, ids, decoded = fresh(keep, "n_tokens", "ids", "decoded")

    def kernel():
        codec = Codec(path)

        def work(texts):
            made = [[int(x) for x in i.split()] for i, _ in codec.encode(texts)]
            return [[len(i) for i in made], made, [codec.decode(i) for i in made]]

        return work

    fields = [T.StructField(n, T.LongType()), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return map_texts(docs, text, fields, kernel, keep)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256, as `encode` would give them, without
    moving ids out of the workers. The same rules hold for null, empty and repeated rows."""
    keep = docs.columns if keep is None else keep
    names = fresh(keep, "n_tokens", "ids_sha256", "decoded_sha256")

    def kernel():
        codec = Codec(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(texts):
            made = codec.encode(texts)
            joined = [t if not codec.decodes_bytes else codec.decode([int(x) for x in i.split()]) for i, t in made]
            return [[i.count(" ") + 1 if i else 0 for i, _ in made], [digest(i) for i, _ in made], [digest(t) for t in joined]]

        return work

    types = (T.LongType(), T.StringType(), T.StringType())
    return map_texts(docs, text, [T.StructField(a, b) for a, b in zip(names, types)], kernel, keep)
