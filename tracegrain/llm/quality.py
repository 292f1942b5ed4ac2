"""Quality rules with verdicts on whole hosts.

Every text is measured once. Rule failures are summed by host, each host's failure rate is shrunk towards the corpus by a
beta prior that is fitted to the spread of the hosts' own rates, and the verdict is joined back to the documents. A host
with two documents, both bad, is therefore not condemned the way a host with two million bad ones is.

Defined results: a null or empty text has no words and fails the base rule; documents without a host are judged together, as
one host; repeated rows are judged one by one; an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm.words import Words, column_words, mix, span_hashes, _BYTES
from tracegrain.session import cut_lineage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
RULES = ("short", "repeated", "symbols", "dup_lines")


def _per_text(flags: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(sums[text_at])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _lines(w: Words, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that have a word, and those among them equal to an earlier line of the text."""
    breaks = np.flatnonzero(w.data == 10)
    starts = np.concatenate([w.text_at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(w.rows), np.searchsorted(w.text_at, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    ends[last] = w.text_at[owner[last] + 1]
    worded = np.concatenate([[0], np.cumsum(inside)])
    full = worded[ends] > worded[starts]
    starts, ends, owner = starts[full], ends[full], owner[full]
    hashes = mix(span_hashes(w.data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTES) ^ (ends - starts).astype(np.uint64))
    order = np.lexsort((hashes, owner))
    again = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return np.bincount(owner, minlength=w.rows), np.bincount(owner[order][1:][again], minlength=w.rows)


def measure(w: Words) -> dict[str, np.ndarray]:
    """The counts named in MEASURES, for each text."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    lines, dup_lines = _lines(w, inside)
    begin, hashes, at = w.windows(REPEAT_WINDOW)
    # The row takes part in the key: windows of different texts never meet.
    rows = np.repeat(np.arange(w.rows, dtype=np.uint64), np.diff(at))
    repeated = begin[_repeats(mix(hashes + mix(rows)))]
    cover = np.zeros(len(w.starts) + 1, np.int64)
    cover[repeated] += 1
    cover[repeated + REPEAT_WINDOW] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": w.counts,
        "word_chars": _per_text(inside & ((w.data & 0xC0) != 0x80), w.text_at),
        "n_symbols": _per_text(_SYMBOL[w.data], w.text_at),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(covered, w.first),
        "n_lines": lines,
    }


_STRUCT = pa.struct([(name, pa.int64()) for name in MEASURES])


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def text_measures(texts: pa.Array) -> pa.Array:
    parts = [measure(w) for w in column_words(texts)]
    columns = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_STRUCT))


def base_failed(m: str, min_words: int, max_repeat_percent: int) -> Column:
    return (F.col(f"{m}.n_words") < min_words) | (100 * F.col(f"{m}.n_repeat_words") > max_repeat_percent * F.col(f"{m}.n_words"))


def rule_failures(m: str, min_words: int, max_repeat_percent: int) -> dict[str, Column]:
    """What a document can fail, for the rates of its host. The last two count against a host alone."""
    return {
        "short": F.col(f"{m}.n_words") < min_words,
        "repeated": 100 * F.col(f"{m}.n_repeat_words") > max_repeat_percent * F.col(f"{m}.n_words"),
        "symbols": 10 * F.col(f"{m}.n_symbols") > F.col(f"{m}.n_words"),
        "dup_lines": 100 * F.col(f"{m}.n_dup_lines") > 30 * F.col(f"{m}.n_lines"),
    }


def host_verdicts(measured: DataFrame, host_col: str, m: str, min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.7) -> DataFrame:
    """One row per host: `host`, its documents, failures and shrunk rate by rule, and `host_failed`.

    The prior is fitted for each rule over all hosts: mean m = failures / documents; intraclass correlation r from the weighted
    spread of the hosts' rates, less what chance alone gives; strength (1 - r) / r, from 1 to a million documents. A host fails if the
    shrunk rate of any rule is above max_host_rate.
    """
    rules = rule_failures(m, min_words, max_repeat_percent)
    hosts = cut_lineage(
        measured.groupBy(F.col(host_col).cast("string").alias("host"))
        .agg(F.count("*").alias("n_docs"), *[F.sum(c.cast("long")).alias(f"{r}_failures") for r, c in rules.items()]))
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
        *[F.sum(f"{r}_failures").alias(f"{r}_f") for r in rules],
        *[F.sum(F.col(f"{r}_failures").cast("double") * F.col(f"{r}_failures") / F.col("n_docs")).alias(f"{r}_q") for r in rules],
    ).first()
    failed = F.lit(False)
    for r in rules:
        mean, strength = beta_prior(sums["hosts"], sums["n"] or 0, sums["nn"] or 0.0, sums[f"{r}_f"] or 0, sums[f"{r}_q"] or 0.0)
        rate = (F.col(f"{r}_failures") + mean * strength) / (F.col("n_docs") + strength)
        hosts = hosts.withColumn(f"{r}_rate", rate)
        failed = failed | (F.col(f"{r}_rate") > max_host_rate)
    return hosts.withColumn("host_failed", failed)


def beta_prior(hosts: int, n: int, nn: float, failures: int, q: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior, by moments; q is the sum of failures**2 / documents over the hosts."""
    if not n or not 0 < failures < n:
        return (failures / n if n else 0.0), 1.0
    mean = failures / n
    spread = (q - n * mean * mean) / (mean * (1 - mean))
    room = n - nn / n - (hosts - 1)
    r = (spread - (hosts - 1)) / room if room > 0 else 0.0
    r = min(max(r, 1e-6), 0.5)
    return mean, (1 - r) / r


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.7) -> DataFrame:
    """One row per document: id, the counts, base_failed, host_failed, and kept."""
    measured = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_measures(F.col(text_col)).alias("m")))
    verdicts = host_verdicts(measured, "host", "m", min_words, max_repeat_percent, max_host_rate).select(F.col("host").alias("of_host"), "host_failed")
    base = base_failed("m", min_words, max_repeat_percent)
    return (
        measured.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
        .select("doc_id", *[F.col(f"m.{c}") for c in MEASURES[:-1]], base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept"), "host_failed", "host"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.7) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured a second time rather than joined by id, so repeated ids do no harm."""
    narrow = docs.select(F.col(host_col).cast("string").alias("_host"), text_measures(F.col(text_col)).alias("_m"))
    verdicts = host_verdicts(narrow, "_host", "_m", min_words, max_repeat_percent, max_host_rate)
    bad = verdicts.where("host_failed").select(F.col("host").alias("_of"))
    measured = docs.withColumn("_m", text_measures(F.col(text_col))).where(~base_failed("_m", min_words, max_repeat_percent)).drop("_m")
    return measured.join(bad, F.col(host_col).cast("string").eqNullSafe(F.col("_of")), "left_anti")
