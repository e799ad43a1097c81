"""Quality rules: length and repetition rules, and robust multivariate outliers.

Every text gets counts from array expressions alone. Per language and source a minimum-covariance-determinant
estimate is fitted to four transformed statistics (mean word length, symbols per word, repeated-word share,
duplicate-line share): from medians and quartiles, concentration steps refit centre and covariance to the
``SHARE`` of documents closest by Mahalanobis distance. A document is rejected beyond a chi-square quantile.

Variances get a floor (``FLOORS``), for clean prose has statistics without any spread, and the covariance is
scaled for consistency. Quantiles are taken on fixed grids, so their state is bounded and reruns agree.

Null or empty texts have all counts 0 and fail the base rules. Null languages and sources form groups of their
own. Repeated rows count as often as they occur; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import join_small, written

MIN_WORDS, MAX_REPEAT = 50, 50
SHARE, STEPS = 0.75, 3
#: Least standard deviation of each transformed statistic.
FLOORS = (0.08, 0.04, 0.15, 0.08)
#: Chance that a document of a Gaussian group lies beyond the cut.
TAIL = 1e-10
SYMBOLS = "#*$%&|<>"
N = len(FLOORS)

_SPACE = r"' \t\n\u000b\u000c\r'"
_TEXT = "coalesce(text, '')"
#: Nested transforms over one-element arrays bind a value once; a plain reference would be expanded and
#: evaluated for each element.
_WORDS = rf"if(btrim({_TEXT}, {_SPACE}) = '', cast(array() as array<string>), split(btrim({_TEXT}, {_SPACE}), '[\\x20\\x09-\\x0D]+', -1))"
_REPEATS = """
if(size(w) < 4, 0, transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
  if(size(array_distinct(h)) = size(h), 0,
    transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
      size(array_distinct(flatten(transform(
        filter(s, (x, j) -> if(j > 0, s[greatest(j - 1, 0)].h = x.h, false) or if(j + 1 < size(s), s[least(j + 1, size(s) - 1)].h = x.h, false)),
        x -> array(x.i, x.i + 1, x.i + 2))))))[0]))[0])
"""
_LINES = rf"filter(split({_TEXT}, '\n', -1), l -> btrim(l, {_SPACE}) != '')"


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with _n_words, _word_chars, _n_symbols, _n_lines, _n_dup_lines and _n_repeat_words (long)."""
    words = F.expr(f"transform(array({_WORDS}), w -> struct(size(w) as n, {_REPEATS} as repeats))[0]")
    lines = F.expr(f"transform(array({_LINES}), l -> struct(size(l) as n, size(l) - size(array_distinct(l)) as dups))[0]")
    text = F.coalesce("text", F.lit(""))
    return (
        docs.withColumns({"_w": words, "_l": lines})
        .withColumns(
            {
                "_n_words": F.col("_w.n").cast("long"),
                "_word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
                "_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "_n_lines": F.col("_l.n").cast("long"),
                "_n_dup_lines": F.col("_l.dups").cast("long"),
                "_n_repeat_words": F.col("_w.repeats").cast("long"),
            }
        )
        .drop("_w", "_l")
    )


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT * F.col("_n_words"))


def _statistics() -> list[Column]:
    words = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("_word_chars"), F.lit(1)) / words),
        F.log1p(F.col("_n_symbols") / words),
        F.col("_n_repeat_words") / words,
        F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double"),
    ]


def chi_square_below(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def chi_square_quantile(tail: float, freedom: int) -> float:
    """Where the chance of more is ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        term = above = math.exp(-mid / 2)
        for k in range(1, freedom // 2):
            term *= mid / 2 / k
            above += term
        low, high = (mid, high) if above > tail else (low, mid)
    return high


def _inverse_factor(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance columns _c{i}{j}, entry by entry, as _f{i}{j}."""
    for i in range(N):
        for j in range(i + 1):
            value = F.col(f"_c{i}{j}")
            for k in range(j):
                value = value - F.col(f"_f{i}{k}") * F.col(f"_f{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"_f{j}{j}")
            params = params.withColumn(f"_f{i}{j}", value)
    return params


def _distance(joined: DataFrame) -> DataFrame:
    """Adds _d, the squared Mahalanobis distance, by forward substitution."""
    for i in range(N):
        value = F.col(f"_x{i}") - F.col(f"_m{i}")
        for k in range(i):
            value = value - F.col(f"_f{i}{k}") * F.col(f"_z{k}")
        joined = joined.withColumn(f"_z{i}", value / F.col(f"_f{i}{i}"))
    return joined.withColumn("_d", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, N)), F.col("_z0") * F.col("_z0"))).drop(*[f"_z{i}" for i in range(N)])


def fit(stats: DataFrame, groups: list[str], share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor of each group of ``stats`` (groups, _x0.._x3), written."""
    grid = [F.percentile(F.round(F.col(f"_x{i}"), 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q{i}") for i in range(N)]
    start = stats.groupBy(*groups).agg(*grid)
    columns = {}
    for i in range(N):
        columns[f"_m{i}"] = F.col(f"_q{i}")[1]
        for j in range(i + 1):
            spread = F.greatest((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
            columns[f"_c{i}{j}"] = spread * spread if i == j else F.lit(0.0)
    params = written(_inverse_factor(start.withColumns(columns)).select(*groups, *[f"_m{i}" for i in range(N)], *[f"_f{i}{j}" for i in range(N) for j in range(i + 1)]))
    cut = chi_square_quantile(1 - share, N)
    scale = share / chi_square_below(cut, N + 2)
    for _ in range(steps):
        near = _distance(join_small(stats, params, groups, "inner"))
        near = near.withColumn("_g", F.round(F.log(F.col("_d") + 1e-6), 2))
        limits = written(near.groupBy(*groups).agg(F.percentile("_g", share).alias("_limit")))
        inner = join_small(near, limits, groups, "inner").filter(F.col("_g") <= F.col("_limit"))
        sums = [F.avg(f"_x{i}").alias(f"_m{i}") for i in range(N)] + [F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_v{i}{j}") for i in range(N) for j in range(i + 1)]
        fitted = inner.groupBy(*groups).agg(*sums)
        fitted = fitted.withColumns({f"_c{i}{j}": F.col(f"_v{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(N) for j in range(i + 1)})
        params = written(_inverse_factor(fitted).select(*groups, *[f"_m{i}" for i in range(N)], *[f"_f{i}{j}" for i in range(N) for j in range(i + 1)]))
    return params


def judged(docs: DataFrame, share: float = SHARE, tail: float = TAIL) -> DataFrame:
    """``docs`` without its text, with the counts, _distance (null where the base rules fail) and _kept."""
    groups = ["lang", "source"]
    stats = counts(docs).drop("text").withColumn("_base_failed", base_failed())
    stats = written(stats.withColumns({f"_x{i}": c for i, c in enumerate(_statistics())}))
    params = fit(stats.filter(~F.col("_base_failed")).select(*groups, *[f"_x{i}" for i in range(N)]), groups, share)
    cut = chi_square_quantile(tail, N)
    far = _distance(join_small(stats, params, groups, "left"))
    return far.withColumn("_distance", F.when(~F.col("_base_failed"), F.col("_d"))).withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_d") <= cut, F.lit(True)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns. Verdicts are joined back on id and text hash."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text", "lang", "source").alias("key"))
    verdicts = judged(docs.select(F.xxhash64("doc_id", "text", "lang", "source").alias("key"), "text", "lang", "source")).filter("not _kept").select("key").distinct()
    return keyed.join(verdicts, "key", "left_anti").select("row.*")


def quality_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and the distance."""
    found = judged(docs.select("doc_id", "text", "lang", "source"))
    return found.select(
        "doc_id",
        *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_distance").alias("distance"),
    )
