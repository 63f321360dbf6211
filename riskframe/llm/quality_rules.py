"""Quality rules: fixed limits, then robust multivariate outliers by minimum-covariance-determinant estimates.

Everything is DataFrame work. A document's counts become five transformed statistics. For each language and source the estimate
starts from three deterministic robust scatters and takes concentration steps. One step is one scan: distances are counted on a
fine logarithmic grid together with the sums and products of each cell, so that the cells up to the one that holds the h-th
smallest distance give the next mean and covariance without sorting a group or holding it in a task. The best start is refined
until its determinant stands still, then reweighted once; rows beyond the chi-square quantile are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.shared import small_side, stored

#: Transformed statistics, each with the least standard deviation that an estimate may have. Clean text often has none of a
#: thing (symbols, repeated lines), which would make a covariance singular and one symbol an outlier.
FLOORS = {"x_length": 0.1, "x_symbols": 0.5, "x_lines": 0.5, "x_repeats": 0.7, "x_upper": 0.4}
NAMES = list(FLOORS)
P = len(NAMES)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
#: Cells of the distance grid per factor e, and of the statistics' grid per unit.
PER_E, PER_UNIT = 16, 64


def chi2_share(x: float, k: int) -> float:
    """Chi-square distribution function for k degrees of freedom."""
    at, term = (1, math.erf(math.sqrt(x / 2))) if k % 2 else (2, 1 - math.exp(-x / 2))
    while at < k:
        term -= (x / 2) ** (at / 2) * math.exp(-x / 2) / math.gamma(at / 2 + 1)
        at += 2
    return term


def chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, k) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """What a covariance of the ``share`` nearest rows is multiplied by so that it estimates a normal covariance."""
    return share / chi2_share(chi2_quantile(share, P), P + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (long).

    Words are runs of other characters than 0x20 and 0x09 to 0x0D. A null or empty text has zeros.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    one = docs.withColumns({"_words": words, "_lines": lines, "_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
                            "_upper": F.regexp_count(text, F.lit(r"\p{Lu}"))}).drop("text")
    windows = F.when(F.size("_words") >= 5, F.transform(
        F.sequence(F.lit(1), F.size("_words") - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))).otherwise(F.array().cast("array<long>"))
    two = one.select(*[c for c in one.columns if c not in ("_words", "_lines")], F.size("_words").cast("long").alias("n_words"),
                     F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     windows.alias("_windows"))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = F.when(twice, F.sort_array(F.zip_with("_windows", F.sequence(F.lit(1), F.size("_windows")),
                                                   lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    three = two.withColumn("_ranked", ranked)
    same = lambda k: F.element_at("_ranked", k)["x"] == F.element_at("_ranked", k + 1)["x"]
    again = F.filter(F.sequence(F.lit(1), F.size("_ranked")), lambda k: ((k > 1) & same(F.greatest(k - 1, F.lit(1))))
                     | ((k < F.size("_ranked")) & same(F.least(k, F.size("_ranked") - 1))))
    covered = F.flatten(F.transform(again, lambda k: F.sequence(F.element_at("_ranked", k)["i"], F.element_at("_ranked", k)["i"] + 4)))
    repeats = F.when(F.col("_ranked").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return three.select(*[c for c in three.columns if c not in ("_windows", "_ranked", "_symbols", "_upper")],
                        F.col("_symbols").cast("long").alias("n_symbols"), F.col("_upper").cast("long").alias("n_upper"),
                        repeats.cast("long").alias("n_repeat_words"))


def transformed() -> dict[str, Column]:
    """The five statistics of a row with at least one word; a row without words has zeros."""
    per = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_symbols": per("n_symbols", "n_words"), "x_lines": per("n_dup_lines", "n_words"),
            "x_repeats": per("n_repeat_words", "n_words"), "x_upper": per("n_upper", "word_chars")}


def _key(level: int, lang, source) -> Column:
    return F.struct(F.lit(level).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))


def _keys(stats: DataFrame, least: int) -> DataFrame:
    """(lang, source, key): the estimate that judges a group, its own or, below ``least`` rows, its language's or that of all."""
    sizes = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    everyone = stats.select("lang", "source").distinct().join(
        sizes.withColumnsRenamed({"lang": "l", "source": "s"}), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")),
        "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    by_lang = F.sum("n").over(Window.partitionBy("lang"))
    none = F.lit(None)
    return everyone.withColumn("of_lang", by_lang).select(
        "lang", "source", F.when(F.col("n") >= least, _key(2, F.col("lang"), F.col("source")))
        .when(F.col("of_lang") >= least, _key(1, F.col("lang"), none)).otherwise(_key(0, none, none)).alias("key"))


def _scatter(name: str, i: int, j: int) -> str:
    return f"{name}_{i}_{j}"


def _inverse_root(params: DataFrame) -> DataFrame:
    """Adds a_i_j, the inverse of the Cholesky factor of s_i_j, and log_det; floors are added to the diagonal first."""
    for i, j in LOWER:
        rest = F.lit(0.0)
        for k in range(j):
            rest = rest + F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        if i == j:
            floor = FLOORS[NAMES[i]] ** 2
            params = params.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(F.col(f"s_{i}_{i}") + floor - rest, F.lit(floor / 100))))
        else:
            params = params.withColumn(f"l_{i}_{j}", (F.col(f"s_{i}_{j}") - rest) / F.col(f"l_{j}_{j}"))
    for j in range(P):
        params = params.withColumn(f"a_{j}_{j}", 1 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, P):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest + F.col(f"l_{i}_{k}") * F.col(f"a_{k}_{j}")
            params = params.withColumn(f"a_{i}_{j}", -rest / F.col(f"l_{i}_{i}"))
    log_det = F.lit(0.0)
    for i in range(P):
        log_det = log_det + 2 * F.log(F.col(f"l_{i}_{i}"))
    return params.select("key", "start", *[f"m_{i}" for i in range(P)], *[f"a_{i}_{j}" for i, j in LOWER], "was", log_det.alias("log_det"))


def _gap(i: int) -> Column:
    return F.col(NAMES[i]) - F.col(f"m_{i}")


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its parameters."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"a_{i}_{j}") * _gap(j)
        total = total + z * z
    return total


def _moments(gap) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(gap(i)).alias(f"t_{i}") for i in range(P)],
            *[F.sum(gap(i) * gap(j)).alias(f"q_{i}_{j}") for i, j in LOWER]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Parameters from the moments of the chosen rows about the old mean; ``factor`` makes the scatter consistent. ``was`` is the
    old estimate's log determinant."""
    mean = [F.col(f"m_{i}") + F.col(f"t_{i}") / F.col("n") for i in range(P)]
    cov = [((F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n") / F.col("n")) * factor).alias(f"s_{i}_{j}")
           for i, j in LOWER]
    return _inverse_root(sums.select("key", "start", "was", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *cov))


#: Estimates that are broadcast, and how many of them one task makes when they are.
FEW, EACH = 100_000, 2_000


class Groups:
    """How estimates meet rows: as a broadcast table while there are at most FEW of them, by a shuffle beyond."""

    def __init__(self, n: int) -> None:
        self.few, self.parts = n <= FEW, 1 + n // EACH

    def meet(self, rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(params) if self.few else params, "key", how)

    def kept(self, params: DataFrame, label: str) -> DataFrame:
        return stored(params.coalesce(self.parts) if self.few else params, label)


def _starts(rows: DataFrame, groups: Groups) -> DataFrame:
    """Three scatters about the medians: the quartiles' scales, the products of tanh scores, and those of spatial signs."""
    cells = rows.select("key", F.posexplode(F.array(*NAMES)).alias("axis", "x"))
    cells = cells.groupBy("key", "axis", F.floor(F.col("x") * PER_UNIT).alias("cell")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("key", "axis").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("key", "axis")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("cell"))) / PER_UNIT
    axes = cells.groupBy("key", "axis").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    pick = lambda c, i: F.max(F.when(F.col("axis") == i, c))
    wide = axes.groupBy("key").agg(
        *[pick(F.col("mid"), i).alias(f"m_{i}") for i in range(P)],
        *[pick(F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(FLOORS[NAMES[i]])), i).alias(f"d_{i}") for i in range(P)])
    wide = groups.kept(wide, "medians")
    scaled = groups.meet(rows, wide)
    scaled = scaled.withColumns({f"z_{i}": _gap(i) / F.col(f"d_{i}") for i in range(P)})
    norm = F.lit(1e-9)
    for i in range(P):
        norm = norm + F.col(f"z_{i}") * F.col(f"z_{i}")
    scaled = scaled.withColumn("norm", F.sqrt(norm)).select(
        "key", *[F.tanh(f"z_{i}").alias(f"u_{i}") for i in range(P)], *[(F.col(f"z_{i}") / F.col("norm")).alias(f"v_{i}") for i in range(P)])
    products = scaled.groupBy("key").agg(*[F.avg(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"u_{i}_{j}") for i, j in LOWER],
                                         *[(P * F.avg(F.col(f"v_{i}") * F.col(f"v_{j}"))).alias(f"v_{i}_{j}") for i, j in LOWER])
    both = wide.join(products, "key")
    forms = []
    for start, value in enumerate((lambda i, j: F.lit(float(i == j)), lambda i, j: F.col(f"u_{i}_{j}"), lambda i, j: F.col(f"v_{i}_{j}"))):
        forms.append(both.select("key", F.lit(start).alias("start"), F.lit(None).cast("double").alias("was"), *[f"m_{i}" for i in range(P)],
                                 *[(value(i, j) * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"s_{i}_{j}") for i, j in LOWER]))
    return groups.kept(_inverse_root(forms[0].unionByName(forms[1]).unionByName(forms[2])), "starts")


def _centre() -> list[Column]:
    return [*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)], F.first("was").alias("was")]


def _concentrate(rows: DataFrame, params: DataFrame, support: float, groups: Groups) -> DataFrame:
    """One concentration step for every key and start."""
    cell = F.floor(F.log(F.greatest(_distance(), F.lit(1e-6))) * PER_E).cast("int")
    cells = groups.meet(rows, params.withColumn("was", F.col("log_det"))).withColumn("cell", cell)
    cells = cells.groupBy("key", "start", "cell").agg(*_moments(_gap), *_centre())
    run = Window.partitionBy("key", "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    cells = cells.withColumn("all", F.sum("n").over(Window.partitionBy("key", "start")))
    near = cells.where(F.col("before") < F.ceil(F.col("all") * support))
    sums = near.groupBy("key", "start").agg(F.sum("n").alias("n"), *[F.sum(f"t_{i}").alias(f"t_{i}") for i in range(P)],
                                            *[F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in LOWER], *_centre())
    return groups.kept(_estimate(sums, consistency(support)), "steps")


def estimates(rows: DataFrame, groups: Groups, support: float = 0.6, trial_steps: int = 2, most_steps: int = 20) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates of ``rows`` (key and the five statistics), one row per key."""
    params = _starts(rows, groups)
    for _ in range(trial_steps):
        params = _concentrate(rows, params, support, groups)
    best = Window.partitionBy("key").orderBy("log_det", "start")
    params = groups.kept(params.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank"), "best")
    for _ in range(most_steps):
        params = _concentrate(rows, params, support, groups)
        if params.where(F.abs(F.col("was") - F.col("log_det")) > 1e-3).isEmpty():
            break
    near = groups.meet(rows, params.withColumn("was", F.col("log_det"))).where(_distance() <= chi2_quantile(0.975, P))
    sums = near.groupBy("key", "start").agg(*_moments(_gap), *_centre())
    return groups.kept(_estimate(sums, consistency(0.975)), "estimates")


def quality_rules(docs: DataFrame, min_words: int = 10, most_repeats: int = 20, least_group: int = 50, support: float = 0.6,
                  quantile: float = 0.9999) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): its counts, ``base_failed``, ``distance``, ``text_hash``, ``kept``.

    A document fails the base rules with fewer than ``min_words`` words (a null or empty text has none) or more than
    ``most_repeats`` % of words in repeated 5-word windows. The others are judged by the estimate of their language and source;
    a group with fewer than ``least_group`` of them by its language's, or that of all rows. Null languages and sources are
    groups of their own. Repeated rows and ids are judged row by row; without any row to estimate from, the base rules decide.
    """
    stats = statistics(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed).withColumns(transformed()), "statistics")
    keys = stored(_keys(stats, least_group), "groups")
    named = small_side(keys.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    keyed = stats.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")
    none = F.lit(None)
    levels = F.explode(F.array(_key(2, F.col("lang"), F.col("source")), _key(1, F.col("lang"), none), _key(0, none, none)))
    used = keys.select("key").distinct()
    groups = Groups(used.count())
    fit = groups.meet(stats.where("not base_failed").select(levels.alias("key"), *NAMES), used, "left_semi")
    found = estimates(stored(fit, "fit"), groups, support)
    judged = groups.meet(keyed, found, "left").withColumn("distance", F.sqrt(_distance()))
    inside = F.coalesce(F.col("distance") <= math.sqrt(chi2_quantile(quantile, P)), F.lit(True))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper",
                         "base_failed", "distance", "text_hash", (~F.col("base_failed") & inside).alias("kept"))
