"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents with one shingle set form a class. Class signatures are cut into trees; in each tree
the classes are sorted by their signature slice, and neighbours in that order are the ones with
the longest common prefixes, so the depth at which two classes meet adapts to how crowded the
region is. Each sorted row carries a sketch of its signature, so neighbours that are alike in one prefix
only fall away before anything is joined. Candidates are verified on full shingle sets, best first for each component: a pair
inside one component needs no check, so verification stays near one pair a class even in groups of thousands.
Where more rows share the leading values than neighbours can meet, the candidates are trees over these rows, and if
they aren't one component after that, blocks of them are compared with each other until every pair of two
components was met, so a document whose only partner lies in a crowd is linked too."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import LOWER_TABLE, fresh, map_texts
from kinweave.operators.components import connected_components, stars
from kinweave.session import Scratch

#: Production parameters. Each tree orders the classes by DEPTH of the VALUES minima, in an order of its own; a
#: pair at 0.85 shares two leading values in none of 16 trees with probability 1e-9, one at 0.8 with 8e-8. The depth lets the order tell
#: apart a crowd of thousands that share most values.
SHINGLE, VALUES, TREES, DEPTH, MIN_DEPTH = 5, 128, 16, 16, 2
#: Trees whose crowds are swept together: each round starts from the components of those before, so the later ones find little left.
ROUNDS = (range(0, 1), range(1, 4), range(4, TREES))
#: Rows of a crowd that meet in one unit on each side, their shingles, and columns of the matrix of their shingles at a time.
BLOCK, BLOCK_SHINGLES, _COLUMNS = 1024, 1 << 20, 4096
#: Neighbours taken on each side, and rounds of best-first verification before all remaining cross pairs are verified.
NEIGHBOURS, BEST_ROUNDS = 4, 2
#: Similarity of linked documents in percent: 100 * intersection >= THRESHOLD * union. A parameter of near_duplicates.
THRESHOLD = 80
#: Wrong drops, by the estimate of their equal minima, of pairs that lie right at the threshold.
WRONG_DROPS = 1e-6
_CACHE = 500_000


@lru_cache(8)
def least_equal(threshold: int) -> int:
    """Equal minima, of VALUES, that a candidate needs to be verified: fewer are found at the threshold with a probability of
    at most WRONG_DROPS. Sketches agree by chance in a sixteenth of the others, so they show a few more."""
    p, k, fewer = threshold / 100, 0, 0.0
    while (fewer := fewer + comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k)) <= WRONG_DROPS:
        k += 1
    return k


class _Words(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240117)
_STEP = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_MUL = _rng.integers(1, 1 << 31, VALUES, np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, VALUES, np.uint32)
#: Which minima each tree looks at, first to last.
ORDERS = np.array([_rng.permutation(VALUES)[:DEPTH] for _ in range(TREES)])


def shingles(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words make one shingle; none for no words."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) <= size:
        return _mix((h * _STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += h[k : n + k] * _STEP[k]
    return np.unique(_mix(total))


def signature(items: np.ndarray) -> bytes:
    """The low halves of VALUES minima, big-endian, so that byte order is value order."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        v = (x[i : i + 512, None] ^ _XOR) * _MUL
        np.minimum(low, v.min(axis=0), out=low)
    return low.astype(np.uint16).astype(">u2").tobytes()


def _sign():
    hashes = _Words()

    def work(texts):
        out: list[list] = [[], [], [], [], []]
        for t in texts:
            s = shingles(t, hashes)
            sig = signature(s) if len(s) else b""
            row = (len(s), int(s.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_mix(s + np.uint64(1))).astype(np.int64)), sig, sketch(sig)) if len(s) else (0, 0, 0, b"", b"")
            for column, value in zip(out, row):
                column.append(value)
        return out

    return work


#: How many of a byte's two halves are zero.
_ZEROS = np.array([(not x >> 4) + (not x & 15) for x in range(256)], np.uint8)


def sketch(sig: bytes) -> bytes:
    """The low four bits of each minimum, two a byte: enough to tell the unlike apart where the rows are sorted."""
    low = np.frombuffer(sig, np.uint8)[1::2] & 15
    return (low[::2] << 4 | low[1::2]).tobytes()


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minima that agree by their sketches, of each row."""
    return _ZEROS[x ^ y].sum(axis=1, dtype=np.int32)


def neighbour_pairs(keys: np.ndarray, trees: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, least: int, seen: int = 0):
    """((a, b, w), crowd): pairs of sorted rows that a new row (from `seen` on) is part of, and the nodes of crowds.

    Rows that share MIN_DEPTH leading values are a run. In runs that neighbours span, all pairs whose sketches agree in
    w >= least values are candidates. Longer runs are crowds: each row keeps its most alike
    follower of NEIGHBOURS, which makes trees over the crowd; the crowd's other pairs are left to sweep()."""
    n = len(keys)
    heads = keys[:, :MIN_DEPTH]
    together = lambda s: (heads[:-s] == heads[s:]).all(axis=1) & (trees[:-s] == trees[s:])
    crowd = np.zeros(n, bool)
    if n > NEIGHBOURS + 1:
        long = np.flatnonzero(together(NEIGHBOURS + 1))
        for s in range(NEIGHBOURS + 2):
            crowd[long + s] = True
    found = []
    for s in range(1, min(NEIGHBOURS, n - 1) + 1):
        i = np.flatnonzero(together(s))
        i = i[i + s >= seen]
        w = agreeing(sketches[i], sketches[i + s])
        i, w = i[w >= least], w[w >= least]
        found.append(np.stack([i, i + s, w, np.full(len(i), s)], axis=1))
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    rows = rows[np.lexsort([rows[:, 3], -rows[:, 2], rows[:, 0]])]
    best = np.r_[True, rows[1:, 0] != rows[:-1, 0]] if len(rows) else np.empty(0, bool)
    rows = rows[best | ~crowd[rows[:, 0]]]
    x, y = nodes[rows[:, 0]], nodes[rows[:, 1]]
    return (np.minimum(x, y), np.maximum(x, y), rows[:, 2]), nodes[crowd]


_SCAN = "a long, b long, w int, border int, tree int, key binary, sketch binary"


def _scanned(a, b=None, w=None, **border) -> pa.RecordBatch:
    n = len(a)
    columns = {"a": a, "b": b, "w": w} | {c: border.get(c) for c in ("border", "tree", "key", "sketch")}
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns.values(), kinds)], names=list(columns))


def _neighbours(rows: list[tuple], least: int, seen: int = 0) -> Iterator[pa.RecordBatch]:
    """Candidates among sorted rows (tree, key, node, sketch), as (a, b, w); crowd members have no b."""
    tree, key, node, sketches = zip(*rows)
    keys = np.frombuffer(b"".join(key), ">u2").reshape(len(key), DEPTH)
    pairs, crowd = neighbour_pairs(keys, np.array(tree), np.array(node, np.int64), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1), least, seen)
    yield _scanned(*pairs)
    yield _scanned(np.unique(crowd))


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition, and its first and last rows for the partitions beside it."""
    me, reach, head, tail = TaskContext.get().partitionId(), NEIGHBOURS + 1, [], []
    for batch in batches:
        new = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        if not new:
            continue
        head += new[: reach - len(head)] if len(head) < reach else []
        yield from _neighbours(tail + new, least, len(tail))
        tail = (tail + new)[-reach:]
    ends = [(r, me) for r in head] + [(r, me + 1) for r in tail]
    if ends:
        yield _scanned([r[2] for r, _ in ends], border=[x for _, x in ends], tree=[r[0] for r, _ in ends], key=[r[1] for r, _ in ends], sketch=[r[3] for r, _ in ends])


def _border_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column(0).to_pylist():
            yield from _neighbours(sorted({(m["tree"], m["key"], m["a"], m["sketch"]) for m in members}), least)


def candidates(classes: DataFrame, scratch: Scratch, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, w), a < b, of neighbours in some tree, and the nodes that lie in a crowd of some tree; classes have node and sig."""
    least = least_equal(threshold)
    slices = F.array(*[F.concat(*[F.substring("sig", 2 * int(i) + 1, 2) for i in order]) for order in ORDERS])
    rows = classes.select("node", "sketch", F.posexplode(slices).alias("tree", "key")).select("tree", "key", "node", "sketch")
    rows = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    scanned = scratch.save(rows.mapInArrow(partial(_scan, least=least), _SCAN))
    # A border has a few rows of the two partitions at it.
    border = scanned.where("border is not null").groupBy("border").agg(F.collect_list(F.struct("tree", "key", "a", "sketch")).alias("rows")).select("rows")
    found = scanned.where("border is null").select("a", "b", "w").union(border.mapInArrow(partial(_border_pairs, least=least), _SCAN).select("a", "b", "w"))
    # One shuffle for both: a crowd's member is a row without b.
    found = scratch.save(found.groupBy("a", "b").agg(F.max("w").alias("w")))
    scratch.drop(scanned)
    return found.where("b is not null"), found.where("b is null").select(F.col("a").alias("node"))


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    hashes = _Words()
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            s, t = shingles(x.as_py(), hashes), shingles(y.as_py(), hashes)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= threshold * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["ca", "cb", "ok"])


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(ca, cb), the components that the saved pairs (a, b, ca, cb) tie together as their full sets are similar. Only texts of wanted nodes are moved."""
    wanted = scratch.large(pairs)
    left = texts.join(wanted, texts["node"] == pairs["a"]).select("a", "b", "ca", "cb", F.col("text").alias("x"))
    right = texts.join(wanted, texts["node"] == pairs["b"]).select("a", "b", F.col("text").alias("y"))
    both = left.join(right.hint("merge"), ["a", "b"]).select("ca", "cb", "x", "y")
    return scratch.save(both.mapInArrow(partial(_compare, threshold=threshold), "ca long, cb long, ok boolean").where("ok").select("ca", "cb"))


def merged(found: DataFrame | None, ties: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after the ties (ca, cb) between components; a component is named by its smallest node."""
    step = connected_components(ties, scratch, "ca", "cb")
    if found is None:
        return step
    near = scratch.large(step)
    moved = found.join(near, found["component"] == near["node"], "left").select(found["node"], F.coalesce(near["component"], found["component"]).alias("component"))
    return scratch.save(moved.union(step.join(scratch.large(found), "node", "left_anti").select("node", "component")))


def settle(open_pairs: DataFrame, texts: DataFrame, found: DataFrame | None, scratch: Scratch, threshold: int) -> DataFrame | None:
    """(node, component) after all candidates were verified or lie inside one component; found holds what is known before."""
    if open_pairs.isEmpty():
        return found
    # Only texts that may be compared are moved, once; later joins read this table.
    ends = scratch.save(open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = scratch.save(texts.join(scratch.large(ends), "node", "left_semi"))
    for k in range(BEST_ROUNDS + 1):
        if found is None:
            cross = open_pairs.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
        else:
            near = scratch.large(found)
            x = open_pairs.join(near, open_pairs["a"] == near["node"], "left").select("a", "b", "w", F.coalesce("component", "a").alias("ca"))
            cross = x.join(near, x["b"] == near["node"], "left").select("a", "b", "w", "ca", F.coalesce("component", "b").alias("cb")).where("ca <> cb")
        cross = scratch.save(cross)
        if cross.isEmpty():
            break
        if k < BEST_ROUNDS:
            best = F.struct("w", "a", "b", "ca", "cb").alias("p")
            sides = cross.select(F.col("ca").alias("c"), best).union(cross.select(F.col("cb").alias("c"), best))
            picked = scratch.save(sides.groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b", "p.ca", "p.cb").distinct())
        else:
            picked = scratch.save(cross.select("a", "b", "ca", "cb"))
        found = merged(found, verify(picked, texts, scratch, threshold), scratch)
        open_pairs = scratch.save(cross.join(scratch.large(picked.select("a", "b")), ["a", "b"], "left_anti").select("a", "b", "w"))
        scratch.drop(cross)
    scratch.drop(texts)
    return found


def _units(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(unit, rows) of a partition sorted by its first `size` columns; rows are the other columns."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for unit, members in groupby(rows, lambda r: r[:size]):
        yield unit, [m[size:] for m in members]


def closest(sigs: np.ndarray, parts: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a row of another component on the other side whose signature agrees in `least` values or more."""
    hit, right = np.zeros(len(sigs), bool), np.flatnonzero(~left)
    x, y = sigs[right], parts[right]
    for i in np.flatnonzero(left):
        found = right[((x == sigs[i]).sum(axis=1) >= least) & (y != parts[i])]
        hit[found] = True
        hit[i] = len(found) > 0
    return hit


def _crowded(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for unit, rows in _units(batches, 4):
        node, part, left, sigs = zip(*rows)
        parts = np.array(part, np.int64)
        hit = closest(np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, VALUES), parts, np.array(left), least)
        # A row may lie on both sides.
        kept = sorted({(node[i], part[i]) for i in np.flatnonzero(hit)})
        columns = [[x] * len(kept) for x in unit] + [[k[0] for k in kept], [k[1] for k in kept]]
        types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "head", "i", "j", "node", "part"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        i, j = np.searchsorted(column, (start, start + _COLUMNS))
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[rows[i:j], column[i:j] - start] = 1
        both += x @ x.T
    return both.astype(np.int64)


def _tied(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    hashes = _Words()
    for _, rows in _units(batches, 4):
        parts = np.array([r[0] for r in rows], np.int64)
        sets = [shingles(r[1], hashes) for r in rows]
        both, size = overlaps(sets), np.array([len(s) for s in sets])
        i, j = np.nonzero((both > 0) & (100 * both >= threshold * (size[:, None] + size - both)) & (parts[:, None] < parts))
        ties = stars(zip(parts[i].tolist(), parts[j].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in ties], pa.int64()) for k in (0, 1)], names=["ca", "cb"])


def sweep(crowd: DataFrame, texts: DataFrame, trees: range, scratch: Scratch, threshold: int) -> DataFrame | None:
    """(ca, cb), the components (part) that are tied by rows sharing MIN_DEPTH leading values in one of the trees; None if no rows are left to compare.

    Runs of up to NEIGHBOURS + 1 such rows have met as neighbours. In a larger run rows outside
    its largest component, on the left, are compared with all rows, on the right, block by block."""
    heads = F.array(*[F.struct(F.lit(t).alias("tree"), F.concat(*[F.substring("sig", 2 * int(i) + 1, 2) for i in ORDERS[t][:MIN_DEPTH]]).alias("head")) for t in trees])
    rows = crowd.select("node", "n", "part", F.explode(heads).alias("h")).select("h.tree", "h.head", "node", "n", "part")
    inside = rows.groupBy("tree", "head", "part").agg(F.count("*").alias("n"), F.sum("n").alias("size"))
    runs = inside.groupBy("tree", "head").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "part", "size")).alias("m"))
    runs = runs.where((F.col("n") > NEIGHBOURS + 1) & (F.col("m.n") < F.col("n")))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    outside = blocks(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size"))
    runs = scratch.save(runs.select("tree", "head", F.col("m.part").alias("most"), outside.alias("nl"), blocks(F.col("n"), F.col("size")).alias("nr")))
    if runs.isEmpty():
        return None
    lot = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    side = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    lefts = F.when(F.col("part") != F.col("most"), F.transform(numbers("nr"), lambda j: side(lot("nl", 1), j, True)))
    rights = F.transform(numbers("nl"), lambda i: side(i, lot("nr", 2), False))
    member = rows.join(scratch.large(runs), ["tree", "head"]).select("tree", "head", "node", "part", F.explode(F.concat(F.coalesce(lefts, F.array().cast("array<struct<i:int,j:int,left:boolean>>")), rights)).alias("u"))
    sigs = crowd.select(F.col("node").alias("n_"), "sig")
    unit = ["tree", "head", "i", "j"]
    met = member.join(scratch.large(sigs), member["node"] == sigs["n_"]).select("tree", "head", "u.i", "u.j", "node", "part", "u.left", "sig")
    hits = scratch.save(met.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(partial(_crowded, least=least_equal(threshold)), "tree int, head binary, i int, j int, node long, part long"))
    if hits.isEmpty():
        return None
    near = scratch.large(hits)
    full = texts.withColumnRenamed("node", "n_").join(near, F.col("n_") == near["node"]).select(*unit, "part", "text")
    ties = scratch.save(full.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(partial(_tied, threshold=threshold), "ca long, cb long").distinct())
    scratch.drop(runs, hits)
    return ties


def group(classes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(node, component) for the classes that have a verified link; classes have node, n, sig and sketch."""
    pairs, crowded = candidates(classes, scratch, threshold)
    found = settle(pairs, texts, None, scratch, threshold)
    crowd = scratch.save(classes.select("node", "n", "sig").join(scratch.large(crowded), "node", "left_semi"))
    for trees in ROUNDS:
        if found is None:
            parted = crowd.withColumn("part", F.col("node"))
        else:
            near = scratch.large(found)
            parted = crowd.join(near, crowd["node"] == near["node"], "left").select(crowd["node"], "n", "sig", F.coalesce("component", crowd["node"]).alias("part"))
        ties = sweep(scratch.save(parted), texts, trees, scratch, threshold)
        if ties is not None and not ties.isEmpty():
            found = merged(found, ties, scratch)
    return found if found is not None else classes.select("node", F.col("node").alias("component")).limit(0)


def _numbered(docs: DataFrame, doc_id: str, text: str, keep: list[str], threshold: int) -> DataFrame:
    """near_duplicates for ids that are no whole numbers: ids are numbered in their order, and numbers named by ids again."""
    scratch = Scratch(docs.sparkSession)
    number, own, id_, root = fresh(docs.columns, "number", "own", "id_of", "root")
    order = F.col(id_)
    ids = docs.select(F.col(doc_id).alias(id_)).where(order.isNotNull()).distinct().repartitionByRange(order).sortWithinPartitions(order)
    ids = scratch.save(ids.withColumn(number, F.monotonically_increasing_id()))
    near = scratch.large(ids)
    made = near_duplicates(docs.join(near, docs[doc_id] == near[id_], "left").drop(id_), number, text, threshold=threshold)
    n, component, kept = made.columns[-3:]
    names = ids.select(F.col(id_).alias(root), F.col(number).alias(own))
    out = made.join(scratch.large(names), made[component] == F.col(own), "left")
    return out.select(*[made[c] for c in keep], n, F.col(root).alias(fresh(docs.columns, "component_id")[0]), kept).withColumnsRenamed(dict(zip((n, kept), fresh(docs.columns, "n_shingles", "kept"))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Append n_shingles, component_id (of the id's type) and kept (names that clash get a trailing _).

    Documents are linked where 100 * intersection >= threshold * union of their shingle sets.
    Texts that are null or without words have no shingles and are linked with nothing. Copies of
    one shingle set are linked through their class. Rows that share an id count as one document;
    rows with a null id are linked with nothing, have a null component and are kept. An empty
    table stays empty; long texts are compared whole; ties are broken by the smallest id."""
    keep = docs.columns if keep is None else keep
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return _numbered(docs, doc_id, text, keep, threshold)
    scratch = Scratch(docs.sparkSession)
    key = ["n", "s1", "s2"]
    fields = [T.StructField(n, T.LongType()) for n in key] + [T.StructField(n, T.BinaryType()) for n in ("sig", "sketch")]
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = scratch.save(map_texts(base, "text", fields, _sign, ["id"]))
    real = signed.where("n > 0 and id is not null")
    # Copies fold into their class before and after the shuffle.
    folded = real.groupBy(*key).agg(F.min(F.struct("id", "sig", "sketch")).alias("m"), F.count("*").alias("copies"))
    classes = scratch.save(folded.select(*key, F.col("m.id").alias("node"), "m.sig", "m.sketch", "copies"))
    texts = base.select(F.col("id").alias("node"), "text").where("node is not null")
    found = scratch.save(group(classes.select("node", "n", "sig", "sketch"), texts, scratch, threshold))
    near = scratch.large(found)
    labelled = classes.join(near, classes["node"] == near["node"], "left").select(*key, F.coalesce("component", classes["node"]).alias("component"), "copies", F.col("component").isNotNull().alias("linked"))
    # Only classes whose component may differ from the document's own id are looked up.
    labels = scratch.save(labelled.where("copies > 1 or linked").select(*key, "component"))
    own = signed.select("id", *key).join(scratch.large(labels), key, "left").select("id", "n", F.coalesce("component", "id").alias("c")).distinct()
    by_id = scratch.save(own.where("id is not null").groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c")))
    names = fresh(docs.columns, "n_shingles", "component_id", "kept")
    id_, own_n, k_, n_, c_ = fresh([*docs.columns, *names], "id_of", "own_n", "key_of", "n_of", "component_of")
    kind = docs.schema[doc_id].dataType
    if keep == [doc_id]:
        # Nothing but the id is wanted: no text is read again.
        rows = signed.select(F.col("id").cast(kind).alias(doc_id), F.col("id").alias(id_), F.col("n").alias(own_n))
    else:
        rows = docs.select(*keep, F.col(doc_id).cast("long").alias(id_), F.lit(None).cast("long").alias(own_n))
    right = scratch.large(by_id.select(F.col("id").alias(k_), F.col("n").alias(n_), F.col("c").alias(c_)))
    out = rows.join(right, F.col(id_) == F.col(k_), "left")
    made = [F.coalesce(own_n, n_, F.lit(0)), F.col(c_).cast(kind), F.coalesce(F.col(c_) == F.col(id_), F.lit(True))]
    return out.select(*keep, *[c.alias(n) for c, n in zip(made, names)])
