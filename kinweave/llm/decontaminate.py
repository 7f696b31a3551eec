"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are sets of words that a document must contain whole and in order. The words of
the windows are ordered by rarity over all documents. Containment needs every word, so the
prefix that has to match is one word: the window's rarest. Document positions of such words,
less the word's offset, are candidate starts; starts that the window's length or the document's
ends rule out fall away, and the rest are verified word by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, lower_ascii
from kinweave.session import BROADCAST_BYTES, Scratch

#: Production parameters: words of a window, and the share of words hit, in twentieths.
WINDOW, MIN_TWENTIETHS = 13, 1
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP, -1), "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(win, len, item): each window of each item, its words joined by spaces; items without words have none."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    out = w.select("item", "w", F.explode(starts).alias("at"))
    part = F.slice("w", F.col("at"), F.least(F.size("w"), F.lit(size)))
    return out.select("item", F.array_join(part, " ").alias("win"), F.size(part).alias("len")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(word, offset, len, win, first, last): the rarest word of each distinct window, by documents that have it."""
    tokens = windows.select("win", "len").distinct().select("win", "len", F.posexplode(F.split("win", " ")).alias("offset", "word"))
    tokens = scratch.save(tokens)
    known = scratch.save(tokens.select("word").distinct())
    seen = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).join(scratch.small(known), "word", "left_semi")
    counts = scratch.save(seen.groupBy("word").agg(F.count("*").alias("df")))
    ranked = tokens.join(scratch.small(counts), "word", "left").select("win", "len", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset").alias("t"))
    least = ranked.groupBy("win", "len").agg(F.min("t").alias("t"))
    return least.select("t.word", "t.offset", "len", "win", F.substring_index("win", " ", 1).alias("first"), F.substring_index("win", " ", -1).alias("last"))


def _parts(prefix: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The saved prefix table for broadcasts: one, or parts of its words that each fit the limit."""
    # Files are compressed: the limit is taken at a quarter of their size.
    n = -(-scratch.bytes(prefix) * 4 // BROADCAST_BYTES) or 1
    return [F.broadcast(prefix.where(F.pmod(F.xxhash64("word"), F.lit(n)) == k) if n > 1 else prefix) for k in range(n)]


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, scratch: Scratch) -> DataFrame:
    """(k, h, n_hit, n_items, items_sha256) for the documents (k = id, h = hash of the text) that a window occurs in.

    A document's words meet the prefix table and its candidates are verified in one stage: only
    true hits are shuffled, never a text."""
    keyed = docs.select(F.col(doc_id).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    windows = scratch.save(item_windows(items, item_id, item_text))
    prefix = scratch.save(prefixes(windows, keyed, "x", scratch))
    places = keyed.select("k", "h", words(F.col("x")).alias("w")).select("k", "h", "w", F.posexplode("w").alias("pos", "own"))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("w"))
    # The ends are compared first: they differ for most candidates.
    ends = (F.get("w", start) == F.col("first")) & (F.get("w", start + F.col("len") - 1) == F.col("last"))
    exact = F.array_join(F.slice("w", start + 1, F.col("len")), " ") == F.col("win")
    found = [places.join(p, (F.col("own") == F.col("word")) & inside & ends & exact).select("k", "h", F.struct(start.alias("s"), "len", "win").alias("c")) for p in _parts(prefix, scratch)]
    hits = scratch.save(reduce(DataFrame.union, found).groupBy("k", "h").agg(F.array_sort(F.collect_set("c")).alias("c")))
    covered = F.aggregate(
        "c",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, c: F.struct(
            F.greatest(a.end, c.s + c.len).alias("end"), (a.n + F.greatest(F.lit(0), c.s + c.len - F.greatest(a.end, c.s))).alias("n")
        ),
        lambda a: a.n,
    )
    spans = hits.select("k", "h", covered.cast("long").alias("n_hit"), F.explode(F.array_distinct(F.transform("c", lambda c: c.win))).alias("win"))
    named = spans.join(scratch.small(windows), "win").groupBy("k", "h").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("i"))
    return scratch.save(named.select("k", "h", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256")))


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated (names that clash get a trailing _).

    A null text has no words; an item without words has no window; null item ids read as empty.
    Rows with one id and one text are judged alike; rows with one id and other texts, or a null id, are kept
    apart by a hash of the text. Empty tables give empty or clean results. Long texts are searched whole."""
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    hits = find_hits(docs, items, doc_id, text, item_id, item_text, scratch)
    names = fresh(docs.columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    # Measured before the join, so that a text moves only where it is kept.
    id_, hash_, n_ = fresh([*docs.columns, *names, *hits.columns], "id_of", "hash_of", "n_of")
    measured = docs.select(*keep, F.col(doc_id).alias(id_), F.xxhash64(text).alias(hash_), F.size(words(F.col(text))).cast("long").alias(n_))
    joined = measured.join(scratch.large(hits), measured[id_].eqNullSafe(hits["k"]) & (measured[hash_] == hits["h"]), "left")
    n_words, n_hit = measured[n_], F.coalesce(hits["n_hit"], F.lit(0))
    made = [n_words, n_hit, F.coalesce(hits["n_items"], F.lit(0)), F.coalesce(hits["items_sha256"], F.sha2(F.lit(""), 256)), (n_hit > 0) & (20 * n_hit >= MIN_TWENTIETHS * n_words)]
    return joined.select(*[measured[c] for c in keep], *[c.alias(n) for c, n in zip(made, names)])
