"""Synthetic minority rows between near neighbours, and removal of Tomek links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest, uniform, word
from ..session import durable
from .neighbors import Index, nearest
from .split import Cuts


def _quota(seeds: DataFrame, name: str, needed: int, n: int, key: str, y: str, seed: int) -> DataFrame:
    """Seeds of one class with how many rows each must yield: an equal share, the rest by hash order."""
    mine = seeds.where(F.col(y) == name)
    each, rest = divmod(needed, n)
    if not rest:
        return mine.withColumn("_quota", F.lit(each))
    cut = Cuts.fit(mine, key, seed, [(rest / n, lambda _n: rest)])
    return mine.withColumn("_quota", F.lit(each) + (cut.part() == 0).cast("int"))


def _synthesize(seeds: DataFrame, pool: DataFrame, y: str, features: Sequence[str],
                targets: Mapping[str, tuple[int, int]], key: str, k: int, seed: int, index: Index | None = None) -> DataFrame:
    """x + u (neighbour - x) with neighbours from the same class in ``pool``, or in an index of it by class."""
    raised = {c: t - n for c, (n, t) in targets.items() if t > n}
    sizes = {r[y]: r["n"] for r in seeds.where(F.col(y).isin(list(raised))).groupBy(y)
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [_quota(seeds, c, need, sizes[c], key, y, seed) for c, need in raised.items() if sizes.get(c)]
    if not parts:
        empty = seeds.select(y, F.col(key).alias("seed_id"), F.lit(0).alias("copy"), *features)
        return empty.limit(0)
    quotas = parts[0]
    for p in parts[1:]:
        quotas = quotas.unionByName(p)
    quotas = quotas.where(F.col("_quota") > 0)
    own = [y, *features]
    queries = quotas.select(F.col(key).alias("id"), *own)
    if index is None:
        index = Index.fit(pool.where(F.col(y).isin(list(sizes))).select(F.col(key).alias("id"), *own), features, k + 1, y, features)
    near = index.nearest(queries.withColumnRenamed(y, index.group), k, exclude_self=True, carry=features)
    copies = (quotas.join(near.withColumnRenamed("id", key), key)
              .where(F.size("near") > 0)
              .select(y, key, *features, "near", F.explode(F.sequence(F.lit(0), F.col("_quota") - 1)).alias("copy")))
    draw = digest(seed, key, "copy")
    pick = F.element_at("near", (F.pmod(word(draw, 0), F.size("near")) + 1).cast("int"))
    mixed = copies.withColumns({"_to": pick, "_u": uniform(word(draw, 1))})
    return mixed.select(y, F.col(key).alias("seed_id"), "copy", *[
        (F.col(c) + F.col("_u") * (F.col(f"_to.{c}") - F.col(c))).alias(c) for c in features])


def regular(df: DataFrame, y: str, features: Sequence[str], targets: Mapping[str, tuple[int, int]], key: str,
            k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows ``(y, seed_id, copy, features)`` that lift each class from its rows to its target.

    Features must be complete. Every row of a raised class seeds about the same number of copies.
    """
    rows = durable(df.select(key, y, *features))  # read by quotas, neighbour search and the final join
    return _synthesize(rows, rows, y, features, targets, key, k, seed)


def _indexed(df: DataFrame, y: str, features: Sequence[str], key: str, reach: int) -> Index:
    """All rows in boxes by class; a row brings its features and the number of its class."""
    names = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().collect())  # class names
    code = F.lit(None).cast("double")
    for i, c in enumerate(names):
        code = F.when(F.col(y) == c, float(i)).otherwise(code)
    rows = df.select(F.col(key).alias("id"), *features, code.alias("_code"), F.coalesce(F.col(y).cast("string"), F.lit("")).alias("_class"))
    return Index.fit(rows, features, reach, "_class", [*features, "_code"])


def danger(df: DataFrame, y: str, classes: Sequence[str], features: Sequence[str], key: str, m: int = 10,
           index: Index | None = None) -> DataFrame:
    """Rows of ``classes`` with at least half, but not all, of their m nearest rows in other classes."""
    index = index or _indexed(df, y, features, key, m + 1)
    names = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().collect())  # class names
    mine = df.where(F.col(y).isin(list(classes))).select(F.col(key).alias("id"), *features, y)
    near = index.nearest(mine, m, exclude_self=True, carry=["_code"], everywhere=True)
    own = F.lit(None).cast("double")
    for c in classes:
        own = F.when(F.col(y) == c, float(names.index(c)) if c in names else None).otherwise(own)
    marked = near.join(mine.select("id", y, own.alias("_own")), "id")
    others = F.size(F.filter("near", lambda p: p["_code"] != F.col("_own")))
    return (marked.select(F.col("id").alias(key), y, others.alias("others"), F.size("near").alias("m"))
            .where((F.col("others") * 2 >= F.col("m")) & (F.col("others") < F.col("m"))))


def borderline(df: DataFrame, y: str, features: Sequence[str], targets: Mapping[str, tuple[int, int]], key: str,
               k: int = 5, m: int = 10, seed: int = 42, index: Index | None = None) -> DataFrame:
    """Like ``regular``, but only endangered rows seed new ones. Both searches use one index of the rows."""
    classes = [c for c, (n, t) in targets.items() if t > n]
    rows = durable(df.select(key, y, *features))
    index = index or _indexed(rows, y, features, key, max(k, m) + 1)
    seeds = durable(rows.join(danger(rows, y, classes, features, key, m, index).select(key), key, "left_semi"))
    return _synthesize(seeds, rows, y, features, targets, key, k, seed, index)


def tomek_links(df: DataFrame, y: str, features: Sequence[str], key: str) -> DataFrame:
    """``(id_a, id_b)``: pairs of different classes that are each other's nearest row."""
    df = durable(df.select(key, y, *features))
    rows = df.select(F.col(key).alias("id"), *features)
    near = nearest(rows, rows, features, 1, exclude_self=True).where(F.size("near") > 0)
    did = F.element_at("near", 1)["did"]
    # a mutual pair shows up once from each side
    mutual = (near.select(F.least("id", did).alias("id_a"), F.greatest("id", did).alias("id_b"))
              .groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("sides")).where(F.col("sides") == 2))
    ends = df.select(F.col(key).alias("id"), F.col(y).alias("c"))
    return (mutual.join(ends.withColumnsRenamed({"id": "id_a", "c": "class_a"}), "id_a")
            .join(ends.withColumnsRenamed({"id": "id_b", "c": "class_b"}), "id_b")
            .where(F.col("class_a") != F.col("class_b")).select("id_a", "id_b", "class_a", "class_b"))


def with_synthetic(df: DataFrame, synthetic: DataFrame, y: str, features: Sequence[str], key: str,
                   targets: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Original rows followed by synthetic ones; new ids are negative and derived from seed and copy.

    Seed ids too large to be packed with a copy number in 63 bits are hashed with it instead."""
    width = max((t for _, t in targets.values()), default=1) + 1  # no seed yields more copies than this
    packed = F.try_subtract(F.try_subtract(F.lit(0).cast("bigint"), F.try_add(F.try_multiply(F.col("seed_id"), F.lit(width).cast("bigint")),
                                                                             F.col("copy"))), F.lit(1))
    hashed = -F.shiftrightunsigned(F.xxhash64("seed_id", "copy"), 1) - 1
    new = synthetic.select(F.coalesce(packed, hashed).alias(key), y, *features)
    return df.select(key, y, *features).unionByName(new)


def attempt(df: DataFrame, y: str, features: Sequence[str], targets: Mapping[str, tuple[int, int]], key: str, k: int = 5,
            seed: int = 42) -> tuple[DataFrame, bool]:
    """The table with synthetic rows and True; or, where a class to be raised has no k neighbours, the original rows and False."""
    if any(n <= k for n, t in targets.values() if t > n):
        return df.select(key, y, *features), False
    return with_synthetic(df, regular(df, y, features, targets, key, k, seed), y, features, key, targets), True


def combined(df: DataFrame, y: str, features: Sequence[str], targets: Mapping[str, tuple[int, int]], key: str,
             k: int = 5, seed: int = 42) -> DataFrame:
    """Regular synthesis, then both ends of every Tomek link are removed."""
    full = durable(with_synthetic(df, regular(df, y, features, targets, key, k, seed), y, features, key, targets))
    links = tomek_links(full, y, features, key)
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias(key))
    return full.join(ends, key, "left_anti")
