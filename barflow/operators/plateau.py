"""Plateau selection: prefer parameter settings whose neighbours do well too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.session import reliable_checkpoint


def normalise_trials(trials: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Min-max scale numeric parameters per study (missing becomes 0.5, a constant one collapses)."""
    b = trials.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))])
    d = trials.join(b, list(keys))
    for c in numeric:
        width = F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 1.0).otherwise(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        d = d.withColumn(f"_x_{c}", F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / width, F.lit(0.5)))
    return d.drop(*[f"_{n}_{c}" for c in numeric for n in ("lo", "hi")])


def _points(d: DataFrame, keys: Sequence[str], trial: str, coords: Sequence[str], k: int) -> DataFrame:
    """Trials with equal parameters as one point that keeps its k + 1 lowest numbers (no list of neighbours can need more of them)."""
    number_value = F.struct(F.col(trial).alias("t"), F.col("value").alias("v"))
    rank = Window.partitionBy(*keys, *coords).orderBy(trial)  # the limit holds before the shuffle too, so a group of copies may hold any share of the rows
    kept = d.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k + 1)
    points = kept.groupBy(*keys, *coords).agg(F.array_sort(F.collect_list(number_value)).alias("members"))  # k + 1 at most
    return points.withColumn("_id", F.element_at("members", 1)["t"])


def _entries(points: DataFrame, numeric: Sequence[str], categorical: Sequence[str], levels: int) -> DataFrame:
    """Every point in its cell of every level: ``_cat`` tells the categories, or is empty for the grid of all of them.  Level l halves each parameter l times."""
    side = F.expr("shiftleft(1, _level)")
    cell = F.array(*[F.least(F.floor(F.col(f"_x_{c}") * side), side - 1).cast("int") for c in numeric])
    grids = F.array(F.lit(""), F.to_json(F.struct(*categorical), {"ignoreNullFields": "false"})) if categorical else F.array(F.lit(""))
    return points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"_cell": cell, "_cat": F.explode(grids)})


def _radius(points: DataFrame, entries: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], k: int) -> DataFrame:
    """``points`` with ``_r2``, a bound on the squared distance at which k other trials are found.

    It is that of representatives (k + 1 points at most) of the finest cell around the point that holds k + 1 trials.
    """
    place = [*keys, "_cat", "_level", "_cell"]
    shape = F.struct(*[f"_x_{c}" for c in numeric], *categorical, F.size("members").alias("_n"))
    first = Window.partitionBy(*place).orderBy("_id")
    reps = entries.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k + 1).groupBy(*place).agg(F.collect_list(shape).alias("_reps"), F.sum(F.size("members")).alias("_held"))
    near = entries.join(reps.where(F.col("_held") >= k + 1).hint("merge"), place).groupBy(*keys, "_cat", "_id").agg(F.max_by("_reps", "_level").alias("_reps"))
    d = points.join(near.hint("merge"), [*keys, "_id"], "left").withColumn("_me", shape)
    far = F.array_sort(F.transform(F.coalesce("_reps", F.array()), lambda o: F.struct(_pair(F.col("_me"), o, numeric, categorical).alias("d"), o["_n"].alias("n"))))
    run = F.aggregate(
        far, F.struct(F.lit(0).alias("n"), F.lit(float("inf")).alias("r")),
        lambda a, o: F.struct((a["n"] + o["n"]).alias("n"), F.when((a["n"] < k + 1) & (a["n"] + o["n"] >= k + 1), o["d"]).otherwise(a["r"]).alias("r")),
    )
    bound = d.withColumn("_r2", run["r"]).groupBy(*keys, "_id").agg(F.min("_r2").alias("_r2"))
    return points.join(bound.hint("merge"), [*keys, "_id"])


def _within(points: DataFrame, entries: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], levels: int) -> DataFrame:
    """(point, other point, squared distance) for all points within each point's bound, by cells as wide as the radius.

    Points of the same categories lie within the bound; others have 2 or more of it used up by their categories, and are only looked for where it is that wide.
    """
    most = float(len(numeric))

    def search(d: DataFrame, cat, square) -> DataFrame:
        reach = F.sqrt(F.least(square, F.lit(most))) + 1e-12
        level = F.greatest(F.least(F.floor(-F.log2(reach)), F.lit(levels)), F.lit(0)).cast("int")
        d = d.withColumns({"_cat": cat, "_reach": reach, "_level": level})
        side = F.expr("shiftleft(1, _level)")
        at = lambda v: F.greatest(F.least(F.floor(v * side), side - 1), F.lit(0)).cast("int")
        product = lambda cells, span: F.flatten(F.transform(cells, lambda done: F.transform(span, lambda v: F.concat(done, F.array(v)))))
        cells = F.array(F.array().cast("array<int>"))
        for c in numeric:  # three cells a parameter at most
            cells = product(cells, F.sequence(at(F.col(f"_x_{c}") - F.col("_reach")), at(F.col(f"_x_{c}") + F.col("_reach"))))
        return d.withColumn("_cell", F.explode(cells))

    cats = F.to_json(F.struct(*categorical), {"ignoreNullFields": "false"}) if categorical else F.lit("")
    wanted = search(points, cats, F.col("_r2")).withColumn("_other", F.lit(False))
    if categorical:
        wanted = wanted.unionByName(search(points.where("_r2 >= 2"), F.lit(""), F.col("_r2") - 2).withColumn("_other", F.lit(True)))
    wanted = wanted.select(*keys, "_cat", "_level", "_cell", "_other", "_r2", F.col("_id").alias("_from"), F.struct(*[f"_x_{c}" for c in numeric], *categorical).alias("_me"))
    there = entries.select(*keys, "_cat", "_level", "_cell", "members", F.struct(*[f"_x_{c}" for c in numeric], *categorical).alias("_o"))
    met = wanted.join(there.hint("merge"), [*keys, "_cat", "_level", "_cell"])
    if categorical:
        same = F.lit(True)
        for c in categorical:
            same = same & F.col(f"_me.{c}").eqNullSafe(F.col(f"_o.{c}"))
        met = met.where(~(F.col("_other") & same))
    met = met.withColumn("_d2", _pair(F.col("_me"), F.col("_o"), numeric, categorical))
    return met.where(F.col("_d2") <= F.col("_r2")).select(*keys, F.col("_from").alias("_id"), "_d2", "members")


def nearest_trials(d: DataFrame, keys: Sequence[str], trial: str, numeric: Sequence[str], categorical: Sequence[str], k: int, levels: int = 10) -> DataFrame:
    """The ``k`` nearest other trials of every trial, ties by trial number, without forming all pairs.

    Parameters span a grid that is halved ``levels`` times.  The finest cell around a trial that holds enough trials bounds the distance to the k-th
    neighbour; then the cells of about that width around it hold all candidates.  Exact for any data: a bound is a distance to trials that exist.
    Both sides of every join grow with the trials, so none is broadcast: arrays pack well in a shuffle and would take many times that size in the driver.
    Time is near-linear while trials of a study spread over the cells; many distinct trials within one finest cell are compared pairwise.
    """
    keys = list(keys)
    coords = [*[f"_x_{c}" for c in numeric], *categorical]
    points = reliable_checkpoint(_points(d, keys, trial, coords, k))
    entries = _entries(points, numeric, categorical, levels)
    bounded = reliable_checkpoint(_radius(points, entries, keys, numeric, categorical, k))
    near = _within(bounded, entries, keys, numeric, categorical, levels).withColumn("_o", F.explode("members"))
    # the k + 1 nearest, the point's own trials included; the limit also holds before the shuffle
    rank = Window.partitionBy(*keys, "_id").orderBy("_d2", "_o.t")
    near = near.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k + 1)
    best = near.groupBy(*keys, "_id").agg(F.array_sort(F.collect_list(F.struct("_d2", F.col("_o.t").alias("t"), F.col("_o.v").alias("v")))).alias("_best"))
    same = F.lit(True)
    for c in [*keys, *coords]:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}"))
    own = d.alias("o").join(points.select(*keys, *coords, "_id").alias("p").hint("merge"), same).select(*[F.col(f"o.{c}") for c in keys], F.col(f"o.{trial}").alias("trial"), "o.value", "p._id")
    j = own.join(best.hint("merge"), [*keys, "_id"])
    others = F.slice(F.filter("_best", lambda o: o["t"] != F.col("trial")), 1, k)
    return j.withColumn("neighbours", others).drop("_id", "_best")


def _pair(a: Column, b: Column, numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in numeric:
        total = total + (a[f"_x_{c}"] - b[f"_x_{c}"]) * (a[f"_x_{c}"] - b[f"_x_{c}"])
    for c in categorical:
        total = total + F.when(a[c].eqNullSafe(b[c]), 0.0).otherwise(2.0)
    return total


def plateau_winners(
    trials: DataFrame, keys: Sequence[str], trial: str, value: str, numeric: Sequence[str], categorical: Sequence[str] = (),
    k: int = 5, alpha: float = 0.5, min_trials: int = 8,
) -> DataFrame:
    """Per study: best trial (spike), best neighbourhood (median - alpha x deviation) and which to use."""
    keys = list(keys)
    ok = trials.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("value", F.col(value).cast("double"))
    enough = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials")).where(F.col("n_trials") >= min_trials)
    d = normalise_trials(ok.join(enough, keys), keys, numeric, categorical)
    near = nearest_trials(d, keys, trial, numeric, categorical, k)
    v = F.transform("neighbours", lambda o: o["v"])
    near = near.withColumns({"_v": F.array_sort(v), "_n": F.size("neighbours").cast("int")})
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    near = near.withColumn("_mean", mean)
    half = F.call_function("div", F.col("_n"), F.lit(2)).cast("int")
    mid = F.when(F.pmod("_n", F.lit(2)) == 1, F.get("_v", half)).otherwise((F.get("_v", half - 1) + F.get("_v", half)) / 2)
    dev = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    sd = F.when(F.col("_n") >= 2, F.sqrt(dev / (F.col("_n") - 1))).otherwise(0.0)
    near = near.withColumn("score", mid - alpha * sd)
    first = lambda c: F.struct(F.col(c), -F.col("trial"))
    g = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.max_by(F.struct("trial", "value", "score"), first("score")).alias("_p"), F.max_by(F.struct("trial", "value", "score"), first("value")).alias("_s"),
    )
    recovery = F.when(F.col("_s.value") != 0, F.col("_p.value") / F.col("_s.value")).otherwise(1.0)
    beats = F.col("_p.score") > F.col("_s.score")
    pick = F.when(F.col("_p.trial") == F.col("_s.trial"), "tie").when(beats & (recovery >= 0.85), "plateau").otherwise("spike")
    return g.select(
        *keys, "n_trials", F.col("_p.trial").alias("plateau_trial"), F.col("_p.score").alias("plateau_score"), F.col("_s.trial").alias("spike_trial"),
        F.col("_s.score").alias("spike_score"), recovery.alias("recovery"), pick.alias("recommendation"),
    )
