"""Reference sampling: admissible times, quotas, balanced sensors, early references.

Draws are by hash of (seed, key), so a sample is the same in every run and on every partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.temporal import even_sample, islands


def draw(*keys: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *keys))


def time_grid(files: DataFrame, step: int, edge: int, start: str = "start_us", end: str = "end_us", name: str = "time_us") -> DataFrame:
    """Times every step within each file, edge away from its ends."""
    first, last = F.col(start) + edge, F.col(end) - edge
    return files.where(last >= first).withColumn(name, F.explode(F.sequence(first, last, F.lit(step))))


def admissible(grid: DataFrame, allowed: DataFrame, shrink: int, width: int, time: str = "time_us") -> DataFrame:
    """Grid times within an allowed closed interval shrunk at both ends; each time once for each kind."""
    a = allowed.select("kind", (F.col("start_us") + shrink).alias("s"), (F.col("end_us") - shrink).alias("e")).where("s <= e")
    a = a.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long"))))
    g = grid.select(time).distinct().withColumn("__b", F.floor(F.col(time) / width).cast("long"))
    return g.join(a, "__b").where((F.col(time) >= F.col("s")) & (F.col(time) <= F.col("e"))).select(time, "kind").distinct()


def covered(files: DataFrame, allowed: DataFrame, edge: int, shrink: int, width: int) -> DataFrame:
    """kind, first, start_us, end_us: where a file, edge away from its ends, and an allowed interval of the kind,
    shrunk at both ends, hold the same times; first is where the file's own times begin.

    Intervals of a kind are joined into their union in buckets of that width first, so however many overlap, a
    file meets few; both sides meet in the buckets."""
    a = allowed.select("kind", (F.col("start_us") + shrink).alias("s"), (F.col("end_us") - shrink).alias("e")).where("s <= e")
    a = a.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long"))))
    a = a.select("kind", "__b", F.greatest("s", F.col("__b") * width).alias("s"), F.least("e", (F.col("__b") + 1) * width - 1).alias("e")).distinct()
    unions = islands(a, ["kind", "__b"], "s", "e", []).groupBy("kind", "__b", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    f = files.select((F.col("start_us") + edge).alias("first"), (F.col("end_us") - edge).alias("until")).where("first <= until")
    f = f.withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor(F.col("until") / width).cast("long"))))
    met = f.join(unions, "__b").select("kind", "first", F.greatest("first", "s").alias("start_us"), F.least("until", "e").alias("end_us"))
    return met.where("start_us <= end_us")


def admissible_times(files: DataFrame, allowed: DataFrame, step: int, edge: int, shrink: int, width: int, time: str = "time_us") -> DataFrame:
    """time_us, kind: what admissible gives of time_grid, with no time made that isn't asked for."""
    c = covered(files, allowed, edge, shrink, width)
    next_ = F.col("first") + F.ceil((F.col("start_us") - F.col("first")) / step) * step
    return c.withColumn("next", next_).where("next <= end_us").select(F.explode(F.sequence("next", "end_us", F.lit(step).cast("long"))).alias(time), "kind").distinct()


def outside(grid: DataFrame, excluded: DataFrame, width: int, time: str = "time_us") -> DataFrame:
    """Grid times that no excluded closed interval holds."""
    x = excluded.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_us") / width).cast("long"), F.floor(F.col("end_us") / width).cast("long"))))
    g = grid.withColumn("__b", F.floor(F.col(time) / width).cast("long"))
    hit = (g["__b"] == x["__b"]) & (g[time] >= x["start_us"]) & (g[time] <= x["end_us"])
    return g.join(x, hit, "left_anti").drop("__b")


def quota_sample(df: DataFrame, group: str, key: str, quota: int, seed: int = 0) -> DataFrame:
    """quota rows over all groups: divmod shares, the groups first in order get one more, drawn by hash.

    The share depends on the number of groups, which is a short list."""
    groups = df.select(group).distinct()
    n = groups.count()
    if not n:
        return df
    share = groups.withColumn("__i", F.row_number().over(Window.orderBy(group)) - 1).withColumn("__q", F.lit(quota // n) + (F.col("__i") < quota % n).cast("int"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(draw(group, key, seed=seed), key)))
    return ranked.join(F.broadcast(share), group).where(F.col("__r") <= F.col("__q")).drop("__r", "__i", "__q")


def round_robin(df: DataFrame, stratum: Sequence[str], key: str, count: int, seed: int = 0) -> DataFrame:
    """count rows, taking one of each stratum in turn."""
    own = df.withColumn("__turn", F.row_number().over(Window.partitionBy(*stratum).orderBy(draw(key, seed=seed), key)))
    return own.orderBy("__turn", *stratum).limit(count).drop("__turn")


def family_quotas(available: DataFrame, plan: dict[str, int], family: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows as the plan's quotas sum to: every family its quota of times, none used twice, the scarcest
    family first; then, while some are missing, one of each family in turn; and then, if all times are used, draws
    from all of them with replacement.  family is the one that a time was taken for.

    Each choice depends on the ones before it.  A family can give no more than the whole plan, so only its first
    2 x plan times by their draw take part, and the choice itself is of the plan's size and not the data's."""
    want = sum(plan.values())
    if not want:
        return available.limit(0)
    rank = F.row_number().over(Window.partitionBy(family).orderBy(draw(key, seed=seed), key))
    distinct = available.where(F.col(family).isin(list(plan))).dropDuplicates([family, key])
    sizes = {r[0]: r[1] for r in distinct.groupBy(family).agg(F.count("*").alias("n")).collect()}  # a row a family
    first = distinct.select(family, key, rank.alias("__r")).where(F.col("__r") <= 2 * want).collect()  # 2 x plan rows a family
    queue: dict[str, list] = {f: [] for f in plan}
    for f, k, _ in sorted(first, key=lambda r: r["__r"]):
        queue[f].append(k)
    used: dict[object, str] = {}

    def take(f: str) -> bool:
        while queue[f]:
            k = queue[f].pop(0)
            if k not in used:
                used[k] = f
                return True
        return False

    for f in sorted(plan, key=lambda f: (sizes.get(f, 0), f)):
        for _ in range(plan[f]):
            if len(used) < want:
                take(f)
    while len(used) < want and any([len(used) < want and take(f) for f in plan]):
        pass
    picks = [(f, k, 0) for k, f in used.items()]
    pool = sorted(used)  # everything that there is, if any is missing
    for i in range(want - len(picks) if pool else 0):
        k = pool[int(hashlib.md5(f"{seed}:again:{i}".encode()).hexdigest(), 16) % len(pool)]
        picks.append((used[k], k, i + 1))
    kinds = dict(available.dtypes)
    chosen = available.sparkSession.createDataFrame(picks, f"__f {kinds[family]}, __k {kinds[key]}, __copy int")
    return distinct.join(F.broadcast(chosen), (F.col(family) == F.col("__f")) & (F.col(key) == F.col("__k"))).select(*available.columns)  # the plan's size


def check_plan(plan: DataFrame, kinds: DataFrame) -> DataFrame:
    """check, violations: the family plan covers all kinds, names no others, and no kind is in two classes."""
    missing = kinds.select("kind").exceptAll(plan.select("kind").distinct()).agg(F.count("*").alias("violations")).select(F.lit("kind_without_family").alias("check"), "violations")
    extra = plan.select("kind").distinct().exceptAll(kinds.select("kind")).agg(F.count("*").alias("violations")).select(F.lit("unknown_kind").alias("check"), "violations")
    crossing = plan.groupBy("kind").agg(F.count_distinct("task_class").alias("c")).agg(F.count_if("c > 1").alias("violations")).select(F.lit("kind_in_two_classes").alias("check"), "violations")
    return missing.unionByName(extra).unionByName(crossing)


def early_references(events: DataFrame, start: int, end: int, stratum: Sequence[str], each: int, most: int) -> DataFrame:
    """Evenly spaced events of the early period in every stratum, at most so many in all.  Half open; may be empty."""
    early = events.where((F.col("peak_us") >= start) & (F.col("peak_us") < end))
    picked = even_sample(early, list(stratum), ["peak_us", "event_id"], each)
    return picked.orderBy(draw("event_id"), "event_id").limit(most)


def feature_tasks(candidates: DataFrame, times: DataFrame, sensors: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidate tasks and reference tasks (each sampled time with each sampled sensor), ids by class and number."""
    own = candidates if limit is None else even_sample(candidates, [], ["peak_us", "event_id"], limit)
    own = own.select(F.concat_ws(":", F.lit("candidate"), "event_id").alias("task_id"), F.lit("candidate").alias("task_class"), F.col("peak_us").alias("time_us"), "channel")
    # both samples are of a set size, and every pair of them is what is asked for
    pairs = times.select("kind", "time_us").join(F.broadcast(sensors.select("channel")), how="inner", on=F.lit(True))
    refs = pairs.select(F.concat_ws(":", "kind", "time_us", "channel").alias("task_id"), F.col("kind").alias("task_class"), "time_us", "channel")
    return own.unionByName(refs)
