"""Repeated passages by a blockwise suffix array with a difference cover.

Every LENGTH-byte string is assigned to a bucket by its content: the smallest hash among its
GRAM-byte grams. Equal strings share a bucket, so suffixes are sorted bucket by bucket and no
task needs the corpus. Runs of neighbouring strings of one bucket (segments) travel as one piece of
text; pieces that are equal fold into one with a count before anything is sorted.

A block of buckets is sorted as the difference-cover method has it: the positions of its text
that lie in a cover modulo PERIOD are ranked first; suffixes are then sorted to PERIOD bytes, one
bucket of leading bytes at a time, and longer ties are resolved by comparing, for each pair, the
cover ranks at the one shift where both positions are in the cover. Neighbours in the sorted order are
compared byte by byte.

Hashes decide in two places, each by 128 bits. Pieces fold if bucket, piece hash and length agree, so copies are
repeated without a comparison of bytes. And in a bucket of more than HOT distinct pieces, which would have to meet in
one task, the strings are counted by two hashes with partial sums. Of n strings, two different ones take
one hash with a probability of about n * n / 2^129: 1e-11 for the 1e14 strings of 100 TB."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, sliced
from kinweave.session import Scratch

#: Production parameters: bytes of a repeated string, of a gram; grams of a string.
LENGTH, GRAM = 200, 48
WINDOW = LENGTH - GRAM + 1
#: Bytes of text sorted at a time, suffixes sorted at a time, distinct pieces of a bucket that one task holds.
BLOCK, SLICE, HOT = 2 << 20, 1 << 17, 2048

#: The powers of 2 modulo 73 are a perfect difference cover: every shift modulo 73 is a difference of two of them.
PERIOD = 73
COVER = np.array(sorted({pow(2, k, PERIOD) for k in range(9)}))
_rng = np.random.default_rng(7)
_TABLES = _rng.integers(1, 1 << 63, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shifts() -> np.ndarray:
    """[i, j]: the least d for which i + d and j + d are both in the cover modulo PERIOD."""
    inside = np.zeros(PERIOD, bool)
    inside[COVER] = True
    out = np.full((PERIOD, PERIOD), PERIOD)
    i, j = np.indices(out.shape)
    for d in reversed(range(PERIOD)):
        out[inside[(i + d) % PERIOD] & inside[(j + d) % PERIOD]] = d
    return out


SHIFT = _shifts()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hashes of all substrings of a text, modulo 2^64, mixed."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(data) + 1
        power, self.inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        power[0] = self.inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * power[:-1], dtype=np.uint64)])

    def of(self, starts, lengths) -> np.ndarray:
        return _mix((self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts] + np.asarray(lengths, np.uint64))

    def all(self, length: int) -> np.ndarray:
        return _mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima forwards and backwards inside blocks."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, _TOP)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, strings, bucket, piece hash) of the segments of all texts of LENGTH bytes or more."""
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not long:
        return tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    rolling = Rolling(data)
    grams = rolling.all(GRAM)
    at = np.arange(len(data))
    room = np.repeat(ends, sizes) - at
    grams[room[: len(grams)] < GRAM] = _TOP
    low = sliding_min(grams, WINDOW)
    valid = room[: len(low)] >= LENGTH
    # A segment ends where its smallest gram changes or is left behind.
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])
    starts = np.flatnonzero(first)
    last = valid & ~np.append(valid[1:], False) | np.append(first[1:], False)
    counts = np.flatnonzero(last & valid) - starts + 1
    text = np.searchsorted(ends, starts, side="right")
    return np.array(long)[text], starts - begins[text], counts, low[starts], rolling.of(starts, counts + (LENGTH - 1))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number whose order is theirs."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : len(data) + k]
    return out


_STEPS = [*range(0, PERIOD - 8, 8), PERIOD - 8]


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """For each position in the cover, its rank by LENGTH bytes or more; -1 elsewhere. `words` reaches past n."""
    at = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    at = at[at < n]
    order = np.lexsort([words[at + s] for s in reversed(_STEPS)])
    differs = np.zeros(len(at), bool)
    for s in _STEPS:
        w = words[at[order] + s]
        differs[1:] |= w[1:] != w[:-1]
    ranks = np.full(len(words), -1, np.int64)
    ranks[at[order]] = np.cumsum(differs)
    reach = PERIOD
    while reach < LENGTH + PERIOD:
        pair = ranks[at] << 32 | (ranks[np.minimum(at + reach, len(words) - 1)] + 1)
        ranks[at] = np.unique(pair, return_inverse=True)[1]
        reach *= 2
    return ranks


def _merge_network(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batcher's odd-even merge sort for a power of two: the disjoint comparisons of each step."""
    i = np.arange(n)
    p = 1
    while p < n:
        k = p
        while k:
            low = i[(i >= k % p) & ((i - k % p) % (2 * k) < k) & (i + k < n)]
            low = low[low // (2 * p) == (low + k) // (2 * p)]
            yield low, low + k
            k //= 2
        p *= 2


def resolve_ties(at: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sort each group of positions (equal to PERIOD bytes) by the cover ranks; groups are runs."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[begins, len(at)])
    out = at.copy()
    width = 2
    while len(begins) and width // 2 < sizes.max():
        picked = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        for part in np.array_split(picked, max(1, len(picked) * width // SLICE)):
            if not len(part):
                continue
            cell = begins[part][:, None] + np.arange(width)
            real = np.arange(width) < sizes[part][:, None]
            m = np.where(real, at[np.minimum(cell, len(at) - 1)], -1)
            for low, high in _merge_network(width):
                x, y = m[:, low], m[:, high]
                d = SHIFT[x % PERIOD, y % PERIOD]
                swap = (y >= 0) & ((x < 0) | (ranks[x + d] > ranks[y + d]))
                m[:, low], m[:, high] = np.where(swap, y, x), np.where(swap, x, y)
            out[cell[real]] = m[real]
        width *= 2
    return out


def repeated(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start, whether its LENGTH bytes equal those of another start."""
    text = np.concatenate([data, np.zeros(LENGTH + 4 * PERIOD, np.uint8)])
    words = _words(text)
    ranks = cover_ranks(words, len(data) + PERIOD)
    leading = (words[starts] >> np.uint64(48)).astype(np.int64)
    sizes = np.bincount(leading, minlength=1 << 16)
    slices = np.cumsum(sizes) // SLICE
    out = np.zeros(len(starts), bool)
    # Which start each position of a slice is; read only where the slice has written it.
    where = np.empty(len(text), np.int64)
    number = slices[leading]
    by_slice = np.argsort(number, kind="stable")
    for part in np.split(by_slice, np.flatnonzero(np.diff(number[by_slice])) + 1):
        at = starts[part]
        order = np.lexsort([words[at + s] for s in reversed(_STEPS)])
        at, part = at[order], part[order]
        differs = np.zeros(len(at), bool)
        for s in _STEPS:
            w = words[at + s]
            differs[1:] |= w[1:] != w[:-1]
        group = np.cumsum(differs)
        tied = np.zeros(len(at), bool)
        tied[1:] |= ~differs[1:]
        tied[:-1] |= ~differs[1:]
        where[at] = part
        if tied.any():
            at[tied] = resolve_ties(at[tied], group[tied], ranks)
        same = np.arange(len(at) - 1)
        for s in range(0, LENGTH, 8):
            same = same[words[at[same] + s] == words[at[same + 1] + s]]
        part = where[at]
        out[part[same]] = True
        out[part[same + 1]] = True
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    """(start, length) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], axis=1).astype(np.int32)


def _sort_block(rows: list[tuple]) -> tuple[list, list, list]:
    """rows: (bucket, piece hash, copies, piece). The runs of repeated starts of each piece."""
    sizes = np.array([len(r[3]) for r in rows])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - (LENGTH - 1)
    firsts = np.cumsum(counts) - counts
    starts = np.repeat(begins - firsts, counts) + np.arange(counts.sum())
    hit = repeated(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), starts)
    out: tuple[list, list, list] = ([], [], [])
    for r, f, n in zip(rows, firsts, counts):
        flags = np.ones(n, bool) if r[2] > 1 else hit[f : f + n]
        if flags.any():
            for column, value in zip(out, (r[0], r[1], _runs(flags).tobytes())):
                column.append(value)
    return out


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, sorted by bucket within the partition, in blocks of about BLOCK bytes."""
    held, size = [], 0
    send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_sort_block(rows), (pa.int64(), pa.int64(), pa.binary()))], names=["b", "c", "runs"])
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield send(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield send(held)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, 2):
            text, start, n, bucket, piece = segments([(t or "").encode() for t in part.column(2).to_pylist()])
            who = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(who), part.column(1).take(who), pa.array(start, pa.int32()), pa.array(n, pa.int16()), pa.array(bucket.view(np.int64)), pa.array(piece.view(np.int64))], names=["k", "h", "lo", "n", "b", "c"]
            )


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, c, copies, piece = [], [], [], []
        for text, wanted in zip(batch.column(0), batch.column(1)):
            raw = text.as_py().encode()
            for w in wanted.as_py():
                b.append(w["b"])
                c.append(w["c"])
                copies.append(w["copies"])
                piece.append(raw[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(copies, pa.int64()), pa.array(piece, pa.binary())], names=["b", "c", "copies", "piece"])


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, c, copies, off, w1, w2) for each string of each piece."""
    for batch in batches:
        pieces = batch.column(3).to_pylist()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        counts = sizes - (LENGTH - 1)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + (off := np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        row = pa.array(np.repeat(np.arange(len(pieces)), counts))
        hashes = [pa.array(Rolling(data, k).of(starts, np.full(len(starts), LENGTH)).view(np.int64)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(off, pa.int32()), *hashes], names=["b", "c", "copies", "off", "w1", "w2"])


def _pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = []
        for offs in batch.column(2).to_pylist():
            flags = np.zeros(max(offs) + 1, bool)
            flags[offs] = True
            runs.append(_runs(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["b", "c", "runs"])


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's runs as merged byte ranges (start, end)."""
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            spans = np.concatenate([np.frombuffer(p["runs"], np.int32).reshape(-1, 2) + np.array([p["lo"], LENGTH - 1], np.int32) for p in parts])
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            begin, end = spans[:, 0], np.maximum.accumulate(spans.sum(axis=1))
            new = np.r_[True, begin[1:] > end[:-1]]
            out.append(np.stack([begin[new], end[np.r_[new[1:], True]]], axis=1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["k", "h", "ranges"])


def repeated_ranges(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(k, h, ranges): the byte ranges that repeated strings cover, for documents that have any."""
    keyed = docs.select(F.col(doc_id).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = scratch.save(keyed.mapInArrow(_segment_rows, f"k {kind}, h long, lo int, n short, b long, c long"))
    # Most strings' buckets hold one segment: these fall away first.
    shared = scratch.save(found.groupBy("b").agg(F.count("*").alias("m")).where("m > 1").select("b"))
    segs = scratch.save(found.join(scratch.large(shared), "b", "left_semi"))
    scratch.drop(found)
    pieces = scratch.save(segs.groupBy("b", "c", "n").agg(F.count("*").alias("copies"), F.min(F.struct("k", "h", "lo")).alias("at")).select("b", "c", "n", "copies", "at.*"))
    width = scratch.save(pieces.groupBy("b").agg(F.count("*").alias("pieces")).where("pieces > 1"))
    # A bucket of one distinct piece needs no sort: its copies are equal throughout.
    mixed = pieces.join(scratch.large(width), "b").select("b", "c", "n", "copies", "k", "h", "lo")
    wanted = scratch.save(mixed.groupBy("k", "h").agg(F.collect_list(F.struct("b", "c", "n", "lo", "copies")).alias("wanted")))
    near = scratch.large(wanted)
    cut = keyed.join(near, keyed["k"].eqNullSafe(near["k"]) & (keyed["h"] == near["h"])).select("x", "wanted")
    texts = scratch.save(cut.mapInArrow(_cut_pieces, "b long, c long, copies long, piece binary"))
    hot_buckets = scratch.save(width.where(F.col("pieces") > HOT).select("b"))
    cold = texts.join(scratch.large(hot_buckets), "b", "left_anti").repartition("b").sortWithinPartitions("b")
    sorted_runs = scratch.save(cold.mapInArrow(_sort_buckets, "b long, c long, runs binary"))
    runs = sorted_runs
    if not hot_buckets.isEmpty():
        strings = scratch.save(texts.join(scratch.large(hot_buckets), "b", "left_semi").mapInArrow(_hash_strings, "b long, c long, copies long, off int, w1 long, w2 long"))
        twice = scratch.save(strings.groupBy("w1", "w2").agg(F.sum("copies").alias("m")).where("m > 1").select("w1", "w2"))
        hit = strings.join(scratch.large(twice), ["w1", "w2"], "left_semi").groupBy("b", "c").agg(F.collect_list("off").alias("offs"))
        runs = runs.union(hit.mapInArrow(_pack_runs, "b long, c long, runs binary"))
    runs = scratch.save(runs)
    alone = scratch.save(pieces.join(scratch.large(width), "b", "left_anti").select("b", "c"))
    whole = segs.join(scratch.large(alone), ["b", "c"], "left_semi").select("k", "h", "lo", F.col("n").cast("int").alias("n"))
    whole = whole.mapInArrow(_whole_runs, f"k {kind}, h long, lo int, runs binary")
    partly = segs.join(scratch.large(runs), ["b", "c"]).select("k", "h", "lo", "runs")
    per_doc = whole.union(partly).groupBy("k", "h").agg(F.collect_set(F.struct("lo", "runs")).alias("parts"))
    return scratch.save(per_doc.mapInArrow(_merge_ranges, f"k {kind}, h long, ranges binary"))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32)
        runs = np.stack([np.zeros_like(n), n], axis=1)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([r.tobytes() for r in runs], pa.binary())], names=["k", "h", "lo", "runs"])


def _cut(text: str | None, ranges: bytes | None) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, spans)."""
    raw = (text or "").encode()
    if not ranges:
        return raw, 0, 0
    spans = np.frombuffer(ranges, np.int32).reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), sum(b - a for a, b in spans), len(spans)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """Append n_bytes, n_removed, n_spans and kept_sha256 (and kept_bytes if `texts`); names that clash get a trailing _.

    Null texts are empty; texts under LENGTH bytes lose nothing. Rows that repeat each other
    lose what they share; null ids are told apart by a hash of the text. An empty table
    stays empty; long texts are searched whole."""
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    ranges = scratch.large(repeated_ranges(docs, doc_id, text, scratch))
    k, h, r, x = fresh(docs.columns, "k_", "h_", "ranges_", "text_")
    right = ranges.select(F.col("k").alias(k), F.col("h").alias(h), F.col("ranges").alias(r))
    joined = docs.join(right, docs[doc_id].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(h)), "left").select(*[docs[c] for c in keep], docs[text].alias(x), r)
    names = fresh(keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")[: 5 if texts else 4]
    types = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType()]
    schema = T.StructType([joined.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, types)])
    width = len(keep)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, width):
                made = [_cut(t, s) for t, s in zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist())]
                columns = [[len(b) + n for b, n, _ in made], [n for _, n, _ in made], [s for _, _, s in made], [hashlib.sha256(b).hexdigest() for b, _, _ in made], [b for b, _, _ in made]]
                arrays = [part.column(i) for i in range(width)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))][: len(names)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(run, schema)
