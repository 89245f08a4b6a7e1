"""Deterministic samples: ranks by hash, fixed draws per band, and stratified allocation with floors and caps."""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "\x1f"
Stratum = tuple[str, ...]
#: More strata than this aren't a table for the driver.
MOST_STRATA = 100_000


def hash_rank(namespace: str, seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(namespace), F.lit(seed), key.cast("string")), 256)


def draw(df: DataFrame, by: list[str], key: str, n: int, *, namespace: str, seed: str) -> DataFrame:
    """The n rows of the lowest hash ranks in each group."""
    return df.withColumn("_h", hash_rank(namespace, seed, F.col(key))).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("place") <= n).drop("_h")


def candidates(rows: DataFrame, key: str, *, year: str, kind: str, priorities: list[str], owner: str) -> DataFrame:
    """One row per key: the least year, the kind of the best priority, the first owner and all owners, sorted."""
    place = F.array_position(F.array(*map(F.lit, priorities)), F.col(kind))
    order = F.struct(F.when(place > 0, place).otherwise(F.lit(len(priorities) + 1)), F.col(kind))
    return rows.groupBy(key).agg(F.min(year).alias("year"), F.min_by(kind, order).alias("kind"), F.min(owner).alias("owner"), F.sort_array(F.collect_set(owner)).alias("owners"))


def _lot(namespace: str, seed: str, key: str) -> str:
    return hashlib.sha256(SEPARATOR.join((namespace, seed, key)).encode()).hexdigest()


def fill(limits: dict[Stratum, int], budget: int, order: list[Stratum]) -> dict[Stratum, int]:
    """The first `budget` of the slots (1st, 2nd, ... up to its limit) of all strata, taken by number and, within a number, in the given
    order: everyone gets up to a common level, and the first few in the order that have room one more."""
    low, high = 0, max(limits.values(), default=0)
    while low < high:  # the highest level that the budget pays for
        level = (low + high + 1) // 2
        low, high = (level, high) if sum(min(n, level) for n in limits.values()) <= budget else (low, level - 1)
    out = {s: min(n, low) for s, n in limits.items()}
    rest = max(0, budget - sum(out.values()))
    return out | {s: out[s] + 1 for s in [s for s in order if limits[s] > low][:rest]}


def allocate(capacity: dict[Stratum, int], size: int, *, floor: int, share: float | str, caps: dict[str, int] | None = None, namespace: str, seed: str) -> dict[Stratum, int]:
    """How many rows each stratum gives; the first part of a stratum's name is its cohort.

    Each step fills strata up to a level: floors first; what is left goes in proportion to headroom, in whole numbers and then by
    remainder; a cohort keeps its lowest slots up to its cap; and what the caps free is filled within their room. Hashes order equals.
    """
    by = {kind: sorted(capacity, key=lambda s, k=kind: (_lot(namespace, seed, f"{k}:" + "/".join(s)), s)) for kind in ("stratum", "remainder", "trim")}
    cohorts = {c: [s for s in capacity if s[0] == c] for c in sorted({s[0] for s in capacity})}
    cap = {c: min(size, (caps or {}).get(c, int(Fraction(str(share)) * size))) for c in cohorts}

    given = fill({s: min(floor, n) for s, n in capacity.items()}, size, by["stratum"])
    room = {s: n - given[s] for s, n in capacity.items()}
    left, every = min(size - sum(given.values()), sum(room.values())), max(1, sum(room.values()))
    given = {s: n + left * room[s] // every for s, n in given.items()}
    rest = left - sum(left * r // every for r in room.values())
    for s in sorted(by["remainder"], key=lambda s: -(left * room[s] % every))[:rest]:
        given[s] += 1
    for c, own in cohorts.items():
        given |= fill({s: given[s] for s in own}, cap[c], [s for s in by["trim"] if s[0] == c])
    extra: dict[Stratum, int] = {}
    for c, own in cohorts.items():
        extra |= fill({s: capacity[s] - given[s] for s in own}, cap[c] - sum(given[s] for s in own), [s for s in by["stratum"] if s[0] == c])
    more = fill(extra, size - sum(given.values()), by["stratum"])
    return {s: n + more[s] for s, n in given.items()}


def stratified(df: DataFrame, strata: list[str], key: str, size: int, *, floor: int = 1, share: float | str = "0.5", caps: dict[str, int] | None = None, exclude: DataFrame | None = None, namespace: str = "v1", seed: str = "seed") -> DataFrame:
    """A stratified sample: counts of strata (a small table, or an error) go to the allocation, rows stay where they are.

    Hashes are even, so a stratum's lowest ones lie below a bound that follows from its count; only rows below it are ranked, and where
    that were too few (which is counted), all of the stratum's.
    """
    pool = df if exclude is None else df.join(exclude.select(key).distinct(), key, "left_anti")
    found = pool.groupBy(*strata).agg(F.count("*").alias("n")).limit(MOST_STRATA + 1).collect()
    if len(found) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    counts = {tuple(str(r[c]) for c in strata): r["n"] for r in found}
    given = allocate(counts, size, floor=floor, share=share, caps=caps, namespace=namespace, seed=seed)
    parts = ", ".join(f"_s{i} string" for i in range(len(strata)))
    on = [F.coalesce(F.col(c).cast("string"), F.lit("None")) == F.col(f"_s{i}") for i, c in enumerate(strata)]
    hashed = pool.withColumn("_h", hash_rank(namespace, seed, F.col(key)))

    def below(bounds: dict[Stratum, str]) -> DataFrame:
        table = df.sparkSession.createDataFrame([(*s, n, bounds[s]) for s, n in given.items()] or [], f"{parts}, take int, _below string")
        return hashed.join(F.broadcast(table), on).where(F.col("_h") < F.col("_below"))

    bounds = {s: _bound(n, counts[s]) for s, n in given.items()}
    enough = {tuple(r[f"_s{i}"] for i in range(len(strata))) for r in below(bounds).groupBy(*[f"_s{i}" for i in range(len(strata))], "take").agg(F.count("*").alias("n")).where("n >= take").collect()}
    ranked = below({s: b if s in enough else "g" for s, b in bounds.items()})
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where("place <= take").select(*df.columns, "place")


def _bound(take: int, n: int) -> str:
    """A hexadecimal bound below which about six deviations more than `take` of n even hashes lie ("g": all)."""
    share = (take + 6 * take**0.5 + 20) / max(1, n)
    return "g" if share >= 1 else f"{int(share * 16**12):012x}"
