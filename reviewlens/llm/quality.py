"""Quality rules: robust multivariate outliers per language and source.

Statistics of every text become a vector of logarithms. Per (language, source) the minimum covariance
determinant is sought by concentration steps: from medians and quartile ranges, keep the share of rows with
the smallest Mahalanobis distances, take their mean and covariance, repeat. Rows beyond a chi-squared quantile
of the final estimate are rejected. Everything is native expressions.

A variance counts as estimated, but for one that falls short of what a single text resolves: the counting error
of its words, or half a symbol, line or window at the usual length of the group. That much is put in its place.

Vectors are rounded to fixed point, so all sums are exact integers and do not depend on row order. Groups
enter the steps only as partial sums per (group, distance bin): a source with a third of all rows is no
single task, and no row is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.names import null_safe_key, unused, words
from reviewlens.sources.scratch import materialise

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WINDOW = 8
# Fixed point of the vectors, and the least standard deviation per component: length, word length, symbols,
# duplicate lines, repeated words, as SQL of the first two means. Constant components keep a finite scale this way.
_SCALE = 256
_FLOORS = (
    "exp(-{0} / 2)",
    "0.5 * exp(-{0} / 2)",
    "0.5 * ln(1 + 1000 * exp(-{0} - {1}))",
    "0.5 * ln(1 + 100 * exp(-{0}))",
    "0.5 * ln(1 + 800 * exp(-{0}))",
)
_P = len(_FLOORS)
# Distance bins per factor e.
_BINS = 64
_POOLED = "pooled"


def _chi2_cdf(x: float, k: int) -> float:
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 400):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2) * (x / 2) ** (k / 2)


def _chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, k) < share else (low, middle)
    return low


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five ``STATISTICS`` as longs, replacing columns of these names.

    Words have no ASCII white space. ``word_chars``: code points in words. ``n_symbols``: characters of
    ``#*$%&|<>``. ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``: words
    in windows of eight that occur twice or more. Windows compare by their 64-bit hashes inside one text.
    A null text is empty and has zeros.
    """
    plain = df.drop(*STATISTICS)
    ws, lines, windows, ranked, marked = (unused(plain, f"_{stem}") for stem in ("ws", "lines", "windows", "ranked", "marked"))
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    first = df if not set(STATISTICS) & set(df.columns) else plain
    step = first.withColumns({ws: words(F.col(text)), lines: F.filter(F.split(body, "\n"), has_word)})
    # Hashes of one word, then of 2, 4 and 8 in a row: each zips two shifted copies of the one before.
    step = step.withColumn(windows, F.transform(ws, lambda word: F.xxhash64(word)))
    for span in (1, 2, 4):
        count = F.size(windows) - span
        pairs = F.zip_with(F.slice(windows, 1, count), F.slice(windows, span + 1, count), lambda a, b: F.xxhash64(a, b))
        step = step.withColumn(windows, F.when(count > 0, pairs).otherwise(F.array().cast("array<bigint>")))
    # Sorted hashes stand next to their equals; most texts have none and skip this.
    numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(ranked, F.when(F.size(F.array_distinct(windows)) < F.size(windows), numbered))
    twice = F.transform(
        ranked,
        lambda x, k: F.when(
            (x["h"] == F.get(F.col(ranked), k - 1)["h"]) | (x["h"] == F.get(F.col(ranked), k + 1)["h"]), x["i"]
        ),
    )
    step = step.withColumn(marked, F.sort_array(F.array_compact(twice)))
    # Every repeated window adds the words that the one before it does not cover.
    begin = F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last"))
    covered = F.aggregate(
        marked,
        begin,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(_WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.array_join(ws, "")),
        "n_symbols": F.length(body) - F.length(_without(body, "#*$%&|<>")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # Generator output: a later filter on a statistic reads it instead of repeating how it came about.
    once = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))).alias(ws)
    return step.select(*[F.col(f"`{c}`") for c in plain.columns], once).select(
        *[F.col(f"`{c}`") for c in plain.columns], *[F.col(ws)[k].alias(k) for k in STATISTICS]
    )


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


_VECTOR = (
    "ln(1 + n_words)",
    "ln((word_chars + 1) / (n_words + 1))",
    "ln(1 + 1000 * n_symbols / (word_chars + 1))",
    "ln(1 + 100 * n_dup_lines / (n_words + 1))",
    "ln(1 + 100 * n_repeat_words / (n_words + 1))",
)


def _vector() -> list[str]:
    """The components in fixed point, as SQL."""
    return [f"cast(round({part} * {_SCALE}) as bigint)" for part in _VECTOR]


def _distance(vector: list[str], p: str) -> str:
    """Squared Mahalanobis distance, as SQL: the inverse Cholesky factor in ``p`` makes it a sum of squares."""
    away = [f"({x} / {_SCALE}e0 - {p}.mean[{i}])" for i, x in enumerate(vector)]
    rows = ["+".join(f"{p}.inverse[{i * (i + 1) // 2 + j}] * {away[j]}" for j in range(i + 1)) for i in range(_P)]
    return " + ".join(f"power({row}, 2)" for row in rows)


def _estimate(moments: DataFrame, inflate: float) -> DataFrame:
    """``(key, p)``: mean and inverse Cholesky factor from exact sums.

    The covariance is scaled by ``inflate``; variances below the squared floors are raised to them, and pivots
    to the resolution of the vectors. One projection per row of the factor, so that no expression repeats another.
    """
    means = [f"s{i} / n / {_SCALE}e0 as m{i}" for i in range(_P)]
    covs = []
    for i in range(_P):
        for j in range(i + 1):
            cov = f"q{i}{j} / n / {_SCALE**2}e0 - (s{i} / n / {_SCALE}e0) * (s{j} / n / {_SCALE}e0)"
            covs.append(f"{inflate!r}D * ({cov}) as r{i}{j}")
    raised = [
        f"greatest(r{i}{j}, power({_FLOORS[i].format('m0', 'm1')}, 2)) as c{i}{j}" if i == j else f"r{i}{j} as c{i}{j}"
        for i in range(_P)
        for j in range(i + 1)
    ]
    fitted = moments.selectExpr("key", *means, *covs).selectExpr("*", *raised)
    for i in range(_P):
        for j in range(i + 1):
            below = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            left = f"c{i}{j}{below}"
            fitted = fitted.selectExpr("*", f"sqrt(greatest({left}, {_SCALE**-2!r}D)) as l{i}{i}" if i == j else f"({left}) / l{j}{j} as l{i}{j}")
    for i in range(_P):
        entries = []
        for j in range(i):
            entries.append(f"-({' + '.join(f'l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} as v{i}{j}")
        fitted = fitted.selectExpr("*", *entries, f"1 / l{i}{i} as v{i}{i}")
    mean = ", ".join(f"m{i}" for i in range(_P))
    inverse = ", ".join(f"v{i}{j}" for i in range(_P) for j in range(i + 1))
    return fitted.selectExpr("key", f"struct(array({mean}) as mean, array({inverse}) as inverse) as p")


def _sums() -> list[Column]:
    firsts = [f"sum(x{i}) as s{i}" for i in range(_P)]
    return [F.expr(e) for e in firsts + [f"sum(x{i} * x{j}) as q{i}{j}" for i in range(_P) for j in range(i + 1)]]


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and quartile ranges per group, from counts per value; no covariances yet."""
    by_value = vectors.select(
        "key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(_P)])).alias("v")
    )
    counts = by_value.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy("key", "v.i")
    upto = F.sum("c").over(inside.orderBy("v.x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("key", "v", upto.alias("upto"), F.sum("c").over(inside).alias("all"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("v.x"))) / _SCALE
    spread = ranked.groupBy("key", F.col("v.i").alias("i")).agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    parts = spread.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "mid", "sd"))).alias("d"))
    inverse = []
    for i in range(_P):
        inverse += ["0D"] * i + [f"1 / greatest(d[{i}].sd, {_FLOORS[i].format('d[0].mid', 'd[1].mid')})"]
    return parts.selectExpr("key", f"struct(d.mid as mean, array({', '.join(inverse)}) as inverse) as p")


def fit(
    counted: DataFrame, lang: str = "lang", source: str = "source", share: float = 0.75, steps: int = 4, least: int = 100
) -> DataFrame:
    """``(key, group, p)``: one robust estimate per (language, source) of a table with ``STATISTICS``.

    Rows that fail the base rules take no part. Groups of fewer than ``least`` rows share one pooled
    estimate; so do languages and sources that no row was fitted for. Nulls are values of their own.
    ``share`` of the rows of a group, ties of the last distance bin included, carry each step.
    """
    key = null_safe_key(F.col(lang), F.col(source)).alias("group")
    vectors = counted.where(~base_failed()).select(key, *[F.expr(f"{x} as x{i}") for i, x in enumerate(_vector())])
    vectors = materialise(vectors, "vectors")
    sizes = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(
        sizes.select("group", F.when(F.col("n") >= least, F.col("group")).otherwise(_POOLED).alias("key")), "groups"
    )
    vectors = materialise(vectors.join(groups, "group").drop("group"), "grouped")
    estimate = materialise(_start(vectors), "estimate")
    # A share of a normal sample has too small a covariance; the factor undoes that.
    cut = _chi2_quantile(share, _P)
    kept_share = share / _chi2_cdf(cut, _P + 2)
    inside = Window.partitionBy("key")
    for step in range(steps + 1):
        distance = _distance([f"x{i}" for i in range(_P)], "p")
        placed = vectors.join(estimate, "key").selectExpr("*", f"floor(ln({distance} + 1e-6D) * {_BINS}) as bin")
        binned = placed.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
        if step < steps:
            before = F.coalesce(F.sum("n").over(inside.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            near = binned.withColumn("before", before).withColumn("all", F.sum("n").over(inside)).where(
                F.col("before") < F.lit(share) * F.col("all")
            )
            inflate = kept_share
        else:  # last, all rows inside the 97.5 % quantile: less is lost to the estimate
            last = _chi2_quantile(0.975, _P)
            near, inflate = binned.where(F.col("bin") <= math.log(last) * _BINS), 0.975 / _chi2_cdf(last, _P + 2)
        names = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i in range(_P) for j in range(i + 1)]]
        moments = near.groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
        estimate = materialise(_estimate(moments, inflate), "estimate")
    return materialise(groups.join(estimate, "key"), "estimates")


def judged(
    counted: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source", quantile: float = 0.9999
) -> DataFrame:
    """Adds ``base_failed``, ``distance`` (squared; null where no estimate holds) and ``kept``.

    A row is kept if the base rules pass and its distance is within the ``quantile`` of a chi-squared variate
    with five degrees: of normal rows one in ten thousand goes. A row without an estimate is judged by the
    base rules alone.
    """
    group, p = unused(counted, "_group"), unused(counted, "_p")
    named = estimates.select(F.col("group").alias(group), F.col("p").alias(p))
    joined = counted.withColumn(group, null_safe_key(F.col(lang), F.col(source))).join(named, group, "left")
    distance = F.expr(_distance(_vector(), f"`{p}`"))
    joined = joined.withColumns({"base_failed": base_failed(), "distance": distance})
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= _chi2_quantile(quantile, _P), F.lit(True))
    return joined.withColumn("kept", kept).drop(group, p)


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """``(doc_id, statistics, base_failed, distance, kept)``, one row per row of ``df``; other columns are not read."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = materialise(text_statistics(narrow).drop("text"), "statistics")
    return judged(counted, fit(counted), **options).drop("lang", "source")


def quality_filtered(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``df`` that are kept, with its columns.

    The statistics are worked out twice, once for the estimates and once for the verdicts: that costs less
    than carrying all texts through a shuffle.
    """
    narrow = df.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    estimates = fit(materialise(text_statistics(narrow).drop("text"), "statistics"))
    # Under names of its own: the caller's columns may be called like the statistics.
    names = {c: unused(df, f"given_{c}") for c in df.columns}
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    counted = text_statistics(renamed, names[text])
    kept = judged(counted, estimates, names[lang], names[source], **options).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
