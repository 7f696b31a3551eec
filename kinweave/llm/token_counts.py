"""Token counts with a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to all
tasks; its size is a parameter and doesn't grow with the corpus. Tier two is a bounded cache in
each Python worker, filled by encoding what tier one misses. No pre-token is ever shuffled.
The table comes from heavy-hitter summaries over all documents: each task keeps a bounded summary
of the space-separated chunks it reads, and summaries are merged in rounds, many to one. It only
saves time, since counts are the same whatever it holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, map_texts, release, sliced
from kinweave.llm.pretokens import Splitter, tokenizer
from kinweave.session import Scratch

#: Entries of the broadcast table and of a summary, entries of a worker's cache, words encoded at a time.
TABLE_SIZE, SUMMARY_SIZE, CACHE_SIZE, PORTION = 1 << 15, 1 << 15, 250_000, 4096
#: Characters of the longest word in the table, and summaries that one task merges.
LONGEST, FAN = 64, 64


def lengths_of(path: str, words: list[str]) -> list[int]:
    """Tokens of each pre-token; a pre-token alone is always split into itself. Encoded in portions, as encodings are large."""
    encode = tokenizer(path).encode_batch
    return [len(e) for i in range(0, len(words), PORTION) for e in encode(words[i : i + PORTION], add_special_tokens=False)]


def pack(words: list[str], lengths: list[int]) -> tuple[bytes, bytes, bytes]:
    """The table as three flat buffers: all words, where each ends, its length in tokens."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype=np.uint32)
    return b"".join(raw), ends.tobytes(), np.asarray(lengths, np.uint16).tobytes()


def unpack(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, ends, lengths = table[0], np.frombuffer(table[1], np.uint32).tolist(), np.frombuffer(table[2], np.uint16).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *ends], ends, lengths)}


def shrink(seen: dict[str, int], size: int) -> dict[str, int]:
    """The `size` commonest entries at most, less the count of the next one, so that summaries can be merged: what is
    lost of a count is at most 1 / (size + 1) of all that was counted, over any number of merges."""
    if len(seen) <= size:
        return seen
    cut = int(np.partition(np.fromiter(seen.values(), np.int64, len(seen)), len(seen) - size - 1)[len(seen) - size - 1])
    return {w: n - cut for w, n in seen.items() if n > cut}


def _add(seen: dict[str, int], more, size: int) -> dict[str, int]:
    for w, n in more:
        seen[w] = seen.get(w, 0) + n
    return shrink(seen, size) if len(seen) > 2 * size else seen


_SUMMARY = "words string, counts binary"


def _summary(seen: dict[str, int], size: int) -> pa.RecordBatch:
    """One row: the chunks, which have no spaces, joined by spaces, and their counts."""
    seen = shrink(seen, size)
    counts = np.fromiter(seen.values(), np.int64, len(seen)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([" ".join(seen)], pa.string()), pa.array([counts], pa.binary())], names=["words", "counts"])


def _entries(words: str, counts: bytes):
    return zip(words.split(" "), np.frombuffer(counts, np.int64).tolist())


def _summarize(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        for part in sliced(batch, 0):
            chunks: Counter = Counter()
            for t in part.column(0).to_pylist():
                chunks.update((t or "").split(" "))
            seen = _add(seen, ((w, n) for w, n in chunks.items() if len(w) < LONGEST), size)
    if seen:
        yield _summary(seen, size)
    del seen
    release()


def _merge(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = _add(seen, _entries(words, counts), size)
    if seen:
        yield _summary(seen, size)


def heavy_chunks(docs: DataFrame, text: str, size: int = SUMMARY_SIZE, fan: int = FAN) -> dict[str, int]:
    """At most `size` space-separated chunks of all texts, with counts that lack at most 1 / (size + 1) of all chunks.

    A task sends one row, and no chunk is shuffled: summaries are written and read again by fewer tasks, `fan` to
    one, until one row is left, so that neither a task nor the driver holds more than the parameters say."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(docs.select(F.col(text).alias("text")).mapInArrow(partial(_summarize, size=size), _SUMMARY))
    while (n := made.count()) > 1:
        old, made = made, scratch.save(made.coalesce(-(-n // fan)).mapInArrow(partial(_merge, size=size), _SUMMARY))
        scratch.drop(old)
    rows = made.collect()
    scratch.drop(made)
    return dict(_entries(*rows[0])) if rows else {}


def frequent_table(docs: DataFrame, text: str, path: str, size: int = TABLE_SIZE) -> tuple[bytes, bytes, bytes]:
    """The commonest pre-tokens of the corpus' commonest chunks, at most `size` of them."""
    split, total = Splitter(path), Counter()
    for chunk, n in heavy_chunks(docs, text).items():
        # Most chunks follow a space, which their first pre-token takes in.
        for s in split.segments(f" {chunk}"):
            if not isinstance(s, int):
                for w in s:
                    total[w] += n
    words = [w for w, _ in total.most_common(size)]
    return pack(words, lengths_of(path, words))


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None, cache_size: int = CACHE_SIZE
) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (names that clash get a trailing _).

    Null and empty texts have 0 of each. Special strings inside a text count as one token, as the
    library does by default. Rows, repeated ones included, pass through one to one; an empty
    table stays empty; long texts are counted whole."""
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_table(docs, text, path))
    n_tokens, n_bytes, over = fresh(keep, "n_tokens", "n_bytes", "over_limit")

    def kernel():
        split, known = Splitter(path), unpack(shared.value)
        table = len(known)

        def work(texts):
            parts = [split.segments(t or "") for t in texts]
            words = set().union(*(s for p in parts for s in p if not isinstance(s, int)))
            missing = [w for w in words if w not in known]
            known.update(zip(missing, lengths_of(path, missing)))
            of = known.__getitem__
            out = [sum(1 if isinstance(s, int) else sum(map(of, s)) for s in p) for p in parts]
            if len(known) > table + cache_size:
                for w in list(islice(known, table, None)):
                    del known[w]
            return [out]

        return work

    counted = map_texts(docs, text, [T.StructField(n_tokens, T.LongType())], kernel, list(dict.fromkeys([*keep, text])))
    return counted.select(
        *keep,
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias(n_bytes),
        n_tokens,
        (F.col(n_tokens) > limit).alias(over),
    )
