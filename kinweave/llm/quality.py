"""Quality rules with host verdicts.

Every document is measured. Failures of the rules are summed by host with map-side partial
sums; each host's failure rate is shrunk towards the corpus with a beta prior fitted to all hosts
by the method of moments; hosts whose shrunk rate is high are strict. A document stays if it
passes the base rules and, on a strict host, the host rules too."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, map_texts
from kinweave.session import Scratch

#: Production parameters. A host is strict if more than this share of its documents (shrunk) fails.
STRICT_RATE = 0.5
#: Limits of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)
#: What is measured of each document.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACE = re.compile("[\x20\x09-\x0d]+")
_ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str) -> list[str]:
    """Runs of [^\\x20\\x09-\\x0D]."""
    return [w for w in _SPACE.split(text) if w]


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text has twice or more, first ones included."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    window = pair[:-1] * len(ids) + w[2:]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; null is measured as empty."""
    text = text or ""
    words = words_of(text)
    chars = sum(map(len, words))
    lines = [s for s in text.split("\n") if s.strip(_ASCII_SPACE)]
    return (len(words), chars, len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def _kernel():
    return lambda texts: [list(c) for c in zip(*map(measure, texts))] or [[]] * len(MEASURES)


def base_failed(q: dict[str, Column]) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def host_rules(q: dict[str, Column]) -> dict[str, Column]:
    """What counts as a failure when hosts are judged, in whole numbers: short or long words, many symbols, many repeated lines."""
    return {
        "word_length": (q["word_chars"] < 3 * q["n_words"]) | (q["word_chars"] > 12 * q["n_words"]),
        "symbols": 10 * q["n_symbols"] > q["n_words"],
        "dup_lines": 100 * q["n_dup_lines"] > 30 * q["n_lines"],
    }


def host_verdicts(measured: DataFrame, host: str, failed: str, strict_rate: float = STRICT_RATE) -> DataFrame:
    """One row per host: n, failures, rate (shrunk) and strict. A null host is a host."""
    by_host = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    p = F.col("failures") / F.col("n")
    moments = by_host.agg(F.sum("failures").alias("f"), F.sum("n").alias("d"), F.count("*").alias("h"), F.sum(F.col("n") * p * p).alias("s"))
    mean = F.coalesce(F.try_divide("f", "d"), F.lit(0.0))
    prior = moments.select(mean.alias("mean"), F.greatest(F.coalesce(F.try_divide("s", "d"), F.lit(0.0)) - mean * mean, F.lit(0.0)).alias("var"))
    weight = F.coalesce(F.try_divide(F.col("mean") * (1 - F.col("mean")), F.col("var")) - 1, F.lit(PRIOR_WEIGHT[1]))
    # The prior is one row.
    out = by_host.join(F.broadcast(prior.select("mean", F.least(F.greatest(weight, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])).alias("weight"))))
    rate = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return out.select("host", "n", "failures", rate.alias("rate"), (rate > strict_rate).alias("strict"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, strict_rate: float = STRICT_RATE) -> DataFrame:
    """Append MEASURES, base_failed and kept (names that clash get a trailing _).

    Null texts are empty and fail the base rules; null hosts share one verdict; repeated rows
    are judged alike; an empty table stays empty; long texts are measured whole; the input's columns may have
    any names. Measured rows are written once to the shared folder; only sums by host are shuffled, and host verdicts come back by a join that is a
    broadcast where the measured size allows."""
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    source, *names = fresh([*docs.columns, "host", "n", "failures", "rate", "strict"], "host_of", *MEASURES, "failed", "base_failed", "kept")
    fields = [T.StructField(n, T.LongType()) for n in names[: len(MEASURES)]]
    measured = map_texts(docs.withColumn(source, F.col(host)), text, fields, _kernel, [*dict.fromkeys([*keep, source])])
    q = {m: F.col(n) for m, n in zip(MEASURES, names)}
    failed, base, kept = names[len(MEASURES) :]
    soft = F.lit(False)
    for rule in host_rules(q).values():
        soft = soft | rule
    measured = scratch.save(measured.withColumn(base, base_failed(q)).withColumn(failed, F.col(base) | soft))
    # Only strict hosts are joined back: all others need no look-up.
    host_, strict_ = fresh(measured.columns, "host", "strict")
    judged = host_verdicts(measured.select(source, failed), source, failed, strict_rate)
    verdicts = scratch.save(judged.where("strict").select(F.col("host").alias(host_), F.col("strict").alias(strict_)))
    joined = measured.join(scratch.small(verdicts), measured[source].eqNullSafe(verdicts[host_]), "left")
    strict = F.coalesce(F.col(strict_), F.lit(False))
    return joined.select(*keep, *names[: len(MEASURES)], base, (~F.col(base) & ~(strict & F.col(failed))).alias(kept))
