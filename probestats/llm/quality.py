"""Quality rules per document, with verdicts on whole hosts.

Each document is measured by itself. Failures are then counted per host (here: the source), the rate of a host
is shrunk towards the corpus by an empirical beta prior, and the host's verdict goes back to its documents: in a
host that fails too often the strict limits of the rules hold, elsewhere the wide ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from probestats.llm.shared import parts, small
from probestats.operators.stage import stage

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\v\f\r"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters"]
#: Shares that a document may not exceed, in hosts that fail too often and in others: symbols and stutters (words
#: equal to the word before) of the words, repeated lines of the lines, characters a word.
STRICT = {"symbols": 0.1, "lines": 0.3, "stutters": 0.2, "word_length": 15.0}
WIDE = {"symbols": 0.2, "lines": 0.6, "stutters": 0.3, "word_length": 25.0}


def measure_text(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if n > WINDOW:
        ids: dict[bytes, int] = {}
        w = [ids.setdefault(x, len(ids)) for x in words]
        windows = list(zip(*(w[i:] for i in range(WINDOW)), strict=False))
        found = Counter(windows)
        if len(found) < len(windows):
            end = 0  # words before it are counted
            for i, x in enumerate(windows):
                if found[x] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    stutters = sum(map(eq, words, words[1:]))
    return n, chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), stutters


def measure(docs: DataFrame, host: str, row: Column) -> DataFrame:
    """``row`` (what stands for the document), its host and ``MEASURES``."""
    rows = docs.select(row.alias("row"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text"):
            columns = zip(*map(measure_text, batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)], ["row", "host", *MEASURES])

    kind = StructType([rows.schema["row"], rows.schema["host"], *(StructField(m, LongType()) for m in MEASURES)])
    return rows.mapInArrow(batches, kind)


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents ``n``, failing documents ``k``, and the rate (k + a) / (n + a + b).

    The beta prior (a, b) is fitted to the hosts' rates by moments: mean m = sum k / sum n; the spread of the
    rates, less what drawing n documents explains by itself, gives a + b (spread no larger: very large, so all
    hosts get the common rate). All moments are sums over hosts, so nothing but two numbers leaves the executors.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("n_failed") > 0).cast("long")).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    s = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("n2"), F.sum(k * k / n).alias("k2n")).first()
    if not s["h"]:
        return hosts.withColumn("rate", F.lit(None).cast("double"))
    m = s["k"] / s["n"]
    between = s["k2n"] - s["n"] * m * m - (s["h"] - 1) * m * (1 - m)  # observed less binomial sum of squares
    weight = s["n"] - s["n2"] / s["n"] - (s["h"] - 1)
    rho = between / (weight * m * (1 - m)) if weight > 0 and 0 < m < 1 else 0.0
    strength = max(1.0, 1 / max(rho, 1e-6) - 1)
    return hosts.withColumn("rate", (k + m * strength) / (n + strength))


def _rules_failed(limits: dict[str, float]) -> Column:
    n = F.col("n_words")
    failed = [
        F.col("n_symbols") > limits["symbols"] * n,
        F.col("n_dup_lines") > limits["lines"] * F.col("n_lines"),
        F.col("n_stutters") > limits["stutters"] * n,
        F.col("word_chars") > limits["word_length"] * n,
    ]
    return sum((f.cast("int") for f in failed[1:]), failed[0].cast("int"))


def judge(docs: DataFrame, host: str = "source", host_rate: float = 0.3, strict: dict[str, float] = STRICT, wide: dict[str, float] = WIDE) -> DataFrame:
    """One row per document: doc_id, host, measures, ``base_failed``, ``n_failed``, ``host_rate``, ``kept``.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated 5-word windows. ``n_failed`` counts the
    base and the rules under the strict limits; a host's rate is that of documents with any failure. Dropped are
    documents that fail the base or a wide limit, and, in hosts whose shrunk rate exceeds ``host_rate``, those that
    fail a strict limit. A document that fails nothing is always kept. Runs jobs.

    NULL text: no words, so dropped. NULL host: a host of its own. Repeated rows: judged alike, counted each.
    NULL doc_id: judged like any other. Other columns are ignored. Empty table: no rows.
    """
    measured = stage(_failures(measure(docs, host, F.col("doc_id").cast("long")), strict), "measures")  # read twice
    judged = _with_hosts(measured, measured)
    return judged.withColumn("kept", ~_dropped(strict, wide, host_rate)).withColumnRenamed("row", "doc_id")


def _failures(measured: DataFrame, strict: dict[str, float]) -> DataFrame:
    measured = measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return measured.withColumn("n_failed", F.col("base_failed").cast("int") + _rules_failed(strict))


def _with_hosts(rows: DataFrame, measured: DataFrame) -> DataFrame:
    hosts = small(stage(host_rates(measured).select(F.col("host").alias("of"), F.col("rate").alias("host_rate")), "hosts"))
    return rows.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")


def _dropped(strict: dict[str, float], wide: dict[str, float], host_rate: float) -> Column:
    strict_failed = F.col("n_failed") > F.col("base_failed").cast("int")
    return F.col("base_failed") | (_rules_failed(wide) > 0) | (strict_failed & F.coalesce(F.col("host_rate") > host_rate, F.lit(False)))


def keep_good(docs: DataFrame, host: str = "source", host_rate: float = 0.3, strict: dict[str, float] = STRICT, wide: dict[str, float] = WIDE) -> DataFrame:
    """The documents that ``judge`` keeps, row by row, with all columns as they are. Runs jobs.

    Texts are measured twice, for the hosts' rates and for the verdicts, rather than written or shuffled.
    """
    rates = stage(_failures(measure(docs, host, F.lit(0)), strict).select("host", "n_failed"), "failures")
    rows = _failures(measure(docs, host, F.struct(*(docs[c] for c in docs.columns))), strict)
    return _with_hosts(rows, rates).where(~_dropped(strict, wide, host_rate)).select("row.*")
