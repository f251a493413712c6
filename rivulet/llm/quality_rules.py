"""Quality rules: per-document statistics, and robust multivariate outliers of them by language and source."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SYMBOLS = b"#*$%&|<>"

#: Words that the least repetition repeats: a 3-word window, twice.
REPEAT = 6

#: What is added to variances, so that a group without any spread has an inverse.
TINY = 1e-9

#: Share of a group that the determinant is minimal over, and the least rows of a group with its own estimate.
SUPPORT = 0.75
LEAST_GROUP = 50

#: Probability that a clean row of a normal population passes.
PASS = 0.9999

#: C-steps end when no group's determinant falls by more than a thousandth, at the latest after so many.
STEPS = 8

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated(words: list[bytes], counts: list[int]):
    """Words of each document in 3-word windows that the document has twice or more. Words of documents in turn."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.int64)
    if len(words) < 3:
        return out
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(len(counts)), counts)
        code = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + (h[2:] ^ (h[2:] >> np.uint64(31)))
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + owner[:-2].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    order = inside[np.argsort(code[inside], kind="stable")]
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[order[again] + k] = True
    np.add.at(out, owner[covered], 1)
    return out


def statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep`, and n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    are equal to an earlier one), n_repeat_words and n_lines (lines with a word) of each whole text. Null: none."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        rows, words, counts = [], [], []
        for text in texts:
            raw = (text or "").encode()
            found = raw.split()
            lines = [line for line in raw.split(b"\n") if line.strip()]
            bare = raw.translate(None, shared.SPACE)
            rows.append((len(found), len(text or "") - (len(raw) - len(bare)), len(bare) - len(bare.translate(None, SYMBOLS)), len(lines) - len(set(lines)), len(lines)))
            words += found
            counts.append(len(found))
        repeats = _repeated(words, counts).tolist()
        made = [[r[i] for r in rows] for i in range(4)] + [repeats, [r[4] for r in rows]]
        return [pa.array(m, pa.int64()) for m in made]

    return shared.text_map(df, text_col, keep, [T.StructField(n, T.LongType()) for n in _STATS], make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Statistics by word or line, on scales on which clean texts are about symmetric."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "length": F.log(share("word_chars", "n_words") + 1),
        "symbols": F.sqrt(share("n_symbols", "n_words")),
        "lines": F.sqrt(share("n_dup_lines", "n_lines")),
        "repeats": F.sqrt(share("n_repeat_words", "n_words")),
    }


def _noise() -> dict[str, Column]:
    """Variance of each statistic of _vector by counting alone: that of a Poisson count's square root is 1/4, a repetition
    counts REPEAT words, and word lengths vary by their mean. Most documents have no symbol, no repeated line and no
    repeated words; where a whole group has none, this is all the spread that a document is judged with."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    mean = F.col("word_chars") / words
    found = {"length": mean / (words * (mean + 1) ** 2), "symbols": 1 / (4 * words), "lines": 1 / (4 * lines), "repeats": REPEAT / (4 * words)}
    return {f"v_{n}": c for n, c in found.items()}


def _chi2(x: float, df: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, df) < p else (low, mid)
    return high


def _consistency(share: float) -> float:
    """Factor for the covariance of the `share` nearest rows of a normal population."""
    return share / _chi2(_quantile(share, len(_NAMES)), len(_NAMES) + 2)


_KEY = ["g_lang", "g_source"]
_NAMES = ["length", "symbols", "lines", "repeats"]
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i:]]


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """(key, center, cov, inverse, logdet) of each group, from its sums. Groups are independent rows."""
    schema = ", ".join([f"{k} string" for k in _KEY] + ["center array<double>", "cov array<double>", "inverse array<double>", "logdet double"])

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n = max(r["n"], 1)
                mean = np.array([r[f"s_{a}"] for a in _NAMES]) / n
                cov = np.zeros((len(_NAMES), len(_NAMES)))
                for a, b in _PAIRS:
                    i, j = _NAMES.index(a), _NAMES.index(b)
                    cov[i, j] = cov[j, i] = r[f"q_{a}_{b}"] / n - mean[i] * mean[j]
                cov *= factor
                cov += np.eye(len(_NAMES)) * TINY
                inverse = np.linalg.inv(cov)
                out.append([r[k] for k in _KEY] + [mean.tolist(), cov.ravel().tolist(), inverse.ravel().tolist(), float(np.linalg.slogdet(cov)[1])])
            yield pd.DataFrame(out, columns=[*_KEY, "center", "cov", "inverse", "logdet"])

    return moments.mapInPandas(solve, schema)


def _noise_of(rows: DataFrame) -> dict[str, Column]:
    return {n: F.col(f"v_{n}") if f"v_{n}" in rows.columns else F.lit(0.0) for n in _NAMES}


def _with_distance(rows: DataFrame, name: str = "d") -> DataFrame:
    """rows with the squared Mahalanobis distance to center by cov, and by the row's own counting noise on its diagonal."""

    def solve(x: pa.Array, noise: pa.Array, center: pa.Array, cov: pa.Array) -> pa.Array:
        import numpy as np

        x, noise, center, cov = (a.flatten().to_numpy(zero_copy_only=False) for a in (x, noise, center, cov))
        k = len(_NAMES)
        off, own = (x - center).reshape(-1, k), cov.reshape(-1, k, k).copy()
        own[:, range(k), range(k)] += noise.reshape(-1, k)
        return pa.array(np.einsum("ij,ij->i", off, np.linalg.solve(own, off[..., None])[..., 0]), pa.float64())

    distance = F.arrow_udf(solve, "double").asNondeterministic()  # a filter doesn't compute it again
    return rows.withColumn(name, distance(F.array(*_NAMES), F.array(*_noise_of(rows).values()), "center", "cov"))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(a).alias(f"s_{a}") for a in _NAMES] + [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in _PAIRS]
    return rows.groupBy(*_KEY).agg(F.count("*").alias("n"), *sums)


def _by_key(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(shared.sized(params), _KEY)


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with their group: language and source if LEAST_GROUP rows share them, else the language's other rows, else
    all other rows. Null languages and sources are groups of their own."""
    named = rows.withColumn("g_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))).withColumn("g_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    sizes = named.groupBy(*_KEY).agg(F.count("*").alias("n"))
    langs = sizes.where(F.col("n") < LEAST_GROUP).groupBy("g_lang").agg(F.sum("n").alias("m"))
    held = sizes.join(langs, "g_lang", "left").select(
        *_KEY,
        F.when((F.col("n") >= LEAST_GROUP) | (F.col("m") >= LEAST_GROUP), F.col("g_lang")).otherwise("*").alias("to_lang"),
        F.when(F.col("n") >= LEAST_GROUP, F.col("g_source")).otherwise("*").alias("to_source"),
    )
    moved = _by_key(named, held)
    return moved.drop(*_KEY).withColumnsRenamed({"to_lang": "g_lang", "to_source": "g_source"})


def outliers(rows: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(key, center, cov, inverse): the reweighted minimum-covariance-determinant estimate of each group of rows.

    rows: g_lang, g_source, the statistics and, unless none, the counting noise of _noise. The start is each group's medians and median deviations (a
    deterministic start); a C-step takes the SUPPORT share of rows nearest to the estimate and estimates anew,
    which never raises the determinant. Quantiles are sketches (relative rank error 1e-3) and moments are sums, so
    a group of any size is aggregated in parts; no group is ever in one task.
    """
    accuracy = 1000
    median = lambda c: F.percentile_approx(c, 0.5, accuracy)
    centers = scratch.table(rows.groupBy(*_KEY).agg(*[median(n).alias(f"m_{n}") for n in _NAMES]))
    near = _by_key(rows, centers)
    spreads = scratch.table(near.groupBy(*_KEY).agg(*[F.first(f"m_{n}").alias(f"m_{n}") for n in _NAMES], *[(1.4826 * median(F.abs(F.col(n) - F.col(f"m_{n}")))).alias(f"d_{n}") for n in _NAMES]))
    start = reduce(lambda a, b: a + b, [(F.col(n) - F.col(f"m_{n}")) ** 2 / (F.col(f"d_{n}") ** 2 + v + TINY) for n, v in _noise_of(rows).items()])
    near = _by_key(rows, spreads).withColumn("d", start)
    logdet = None
    for _ in range(STEPS):
        limits = scratch.table(near.groupBy(*_KEY).agg(F.percentile_approx("d", SUPPORT, accuracy).alias("limit")))
        params = scratch.table(_estimate(_moments(_by_key(near, limits).where("d <= limit")), _consistency(SUPPORT)))
        near = _with_distance(_by_key(rows, params.drop("logdet")))
        if logdet is not None and shared.small(logdet.join(params.withColumnRenamed("logdet", "now"), _KEY).where("logdet - now > 0.001"), 0):
            break
        logdet = params.select(*_KEY, "logdet")
    weight = 0.975
    return scratch.keep(_estimate(_moments(near.where(F.col("d") <= _quantile(weight, len(_NAMES)))), _consistency(weight)).drop("logdet"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, the statistics, base_failed, distance (squared Mahalanobis distance of the transformed
    statistics, the document's counting noise added to the variances) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows. Others are kept unless their
    distance to the estimate of their language and source exceeds the chi-square quantile of PASS. Estimates are over
    all rows that pass the base rules. Groups of fewer than LEAST_GROUP rows are pooled; a pool that is still smaller is
    estimated as it is. Null texts have no words and fail the base rules. Rows stay, repeated or of null id.
    """
    with shared.Scratch(df.sparkSession) as scratch:
        named = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
        stats = statistics(named, ["doc_id", "lang", "source"])
        marked = scratch.table(stats.withColumn("base_failed", base_failed()).withColumns(_vector() | _noise()))
        rows = _grouped(marked.where("not base_failed"))
        rows = scratch.table(rows)
        params = outliers(rows.select(*_KEY, *_NAMES, *_noise()), scratch)
        cut = _quantile(PASS, len(_NAMES))
        plain = ["doc_id", *_STATS, "base_failed"]
        judged = _with_distance(_by_key(rows, params), "distance").select(*plain, "distance", (F.col("distance") <= cut).alias("kept"))
        failed = marked.where("base_failed").select(*plain, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
        found = scratch.keep(judged.unionByName(failed))
    return found.withColumnRenamed("doc_id", id_col)
