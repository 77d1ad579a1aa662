"""Research operators: standardising, portfolios, event paths, matching, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.quantiles import exact_percentiles
from ..session import cut_lineage

PRE, POST, CALIPER = 4, 8, 0.010
RETURN_VARS = ("ar_m1", "ar_m2", "pre_car_34")
MATCH_VARS = (*RETURN_VARS, "log_mktcap", "log_turnover")


# ------------------------------------------------------------------ preparation
def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ordered, de-duplicated columns; infinities are missing; complete rows only."""
    cols = list(dict.fromkeys(cols))
    return df.select(*[W.finite(F.col(c)).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in cols]).dropna()


def top_rows(df: DataFrame, keys: list[tuple[str, bool, bool]], n: int) -> DataFrame:
    """The first ``n`` rows by ``keys`` (column, descending, nulls first) with their ``place``; a bounded sort, no global window."""
    order = [getattr(F.col(c), ("desc" if down else "asc") + ("_nulls_first" if first else "_nulls_last"))() for c, down, first in keys]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def standardise(df: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    """z-scores within a group; no spread gives null, rows without a group are dropped.

    Groups are few and large (tiers), so their moments are aggregated and broadcast: a window
    would sort each group in one task.  The rows are read twice and kept in between.
    """
    rows = cut_lineage(df.dropna(subset=group))
    stats = rows.groupBy(*group).agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])  # a row a group
    z = {f"z_{c}": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))) for c in cols}
    names = [*df.columns, *(n for n in z if n not in df.columns)]
    return rows.join(F.broadcast(stats), group).withColumns(z).select(*names)


def winsorise(df: DataFrame, cols: str | list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds ``<col>_w``, cut at its percentiles; the two edges of each column are found in one pass over all and become literals."""
    cols = [cols] if isinstance(cols, str) else list(dict.fromkeys(cols))
    edges = {r["variable"]: r["q"] for r in exact_percentiles(df, cols, [low, high]).collect()}  # a row a column
    return df.withColumns({f"{c}_w": F.greatest(F.least(c, F.lit(edges[c][1])), F.lit(edges[c][0])) for c in cols}) if cols else df


def control_shares(df: DataFrame, controls: list[str], least: float = 0.5) -> DataFrame:
    """control, share of rows with a value, and whether it is enough to be used."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in controls])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("control"), F.coalesce(F.col(c), F.lit(0.0)).alias("share")) for c in controls])).alias("r"))
    return rows.select("r.*").withColumn("available", F.col("share") >= least)


def available_controls(df: DataFrame, controls: list[str], least: float = 0.5) -> list[str]:
    found = {r["control"] for r in control_shares(df, controls, least).where("available").collect()}  # a row a control
    return [c for c in controls if c in found]


# ------------------------------------------------------------------ reports
def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """n, missing share, mean, sd, min, percentiles 1/25/50/75/99 and max per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("r.*")
    q = exact_percentiles(df, cols, [0.01, 0.25, 0.5, 0.75, 0.99]).select("variable", "q")
    out = long.groupBy("variable").agg(F.count("x").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("missing_share"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.join(F.broadcast(q), "variable", "left").select("variable", "n", "missing_share", "mean", "sd", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p25", "p50", "p75", "p99"))], "max")


def coverage(df: DataFrame, cols: list[str], entity: str) -> DataFrame:
    """Per column: values, their share, entities with data."""
    long = df.select(entity, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).isNotNull().alias("there")) for c in cols])).alias("r")).select(entity, "r.*")
    return long.groupBy("variable").agg(F.count_if("there").alias("n"), F.avg(F.col("there").cast("double")).alias("share"), F.countDistinct(F.when(F.col("there"), F.col(entity))).alias("n_entities"))


def mode_per_group(df: DataFrame, group: str, value: str, empty: str = "unknown") -> DataFrame:
    """Most frequent value of each group; ties take the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).count()
    best = n.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), value))).where("rn = 1")
    return df.select(group).distinct().join(best.select(group, value), group, "left").select(group, F.coalesce(value, F.lit(empty)).alias("mode"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values])


def month_gaps(df: DataFrame, day: Column) -> DataFrame:
    """Months between the first and the last that have no row."""
    months = df.select(F.trunc(day, "month").alias("month")).distinct()
    span = months.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return span.join(months, "month", "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum by the smallest seeded hash of the key."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


# ------------------------------------------------------------------ portfolios
def round_trip_cost(fee: float = 0.001425, discount: float = 0.6, tax: float = 0.003, slip_bps: float = 20) -> float:
    return fee * discount * 2 + tax + 2 * slip_bps / 1e4


def quantile_buckets(panel: DataFrame, signal: str, n_q: int = 5, per_bucket: int = 5, entity: str = "ticker") -> DataFrame:
    """Rows of weeks with at least n_q x per_bucket names, with their bucket 1..n_q."""
    rows = panel.dropna(subset=[signal, "ret_next"])
    size = F.count(F.lit(1)).over(Window.partitionBy("week"))
    rows = rows.withColumn("__n", size).where(F.col("__n") >= n_q * per_bucket).drop("__n")
    return rows.withColumn("bucket", W.qcut_first(F.col(signal), n_q, ["week"], entity))


def bucket_returns(buckets: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean next return per week and bucket; weighted means fall back to plain ones without weights."""
    r = F.col("ret_next")
    if weight is None:
        mean = F.avg(r)
    else:
        cap = F.coalesce(F.col(weight), F.lit(0.0))
        mean = F.when(F.count(weight) == 0, F.avg(r)).otherwise(F.try_divide(F.sum(r * cap), F.nullif(F.sum(cap), F.lit(0.0))))
    return buckets.groupBy("week", "bucket").agg(mean.alias("r"), F.count(F.lit(1)).alias("n"))


def long_short(returns: DataFrame, n_q: int = 5) -> DataFrame:
    return returns.groupBy("week").agg(*[F.max(F.when(F.col("bucket") == q, F.col("r"))).alias(f"q{q}") for q in range(1, n_q + 1)]).withColumn("long_short", F.col(f"q{n_q}") - F.col("q1"))


def churn(buckets: DataFrame, n_q: int = 5, entity: str = "ticker") -> DataFrame:
    """Mean share of names new to each leg against the previous sorted week; 1 at first."""
    legs = buckets.where(F.col("bucket").isin(1, n_q))
    w = Window.partitionBy(entity, "bucket").orderBy("week")
    weeks = buckets.select("week").distinct().withColumn("prev_week", F.lag("week").over(Window.orderBy("week")))  # one row a week
    held = legs.withColumn("last_week", F.lag("week").over(w)).join(F.broadcast(weeks), "week")
    new = F.coalesce(F.col("last_week") != F.col("prev_week"), F.lit(True)) | F.col("prev_week").isNull()
    leg = held.groupBy("week", "bucket").agg(F.avg(new.cast("double")).alias("new_share"))
    return leg.groupBy("week").agg(F.avg("new_share").alias("churn"))


def net_of_cost(spread: DataFrame, churned: DataFrame, cost: float) -> DataFrame:
    return spread.join(churned, "week").withColumn("net", F.col("long_short") - 2 * cost * F.col("churn"))


def mean_t(df: DataFrame, x: str, group: list[str] | None = None) -> DataFrame:
    """n, mean, sd (ddof 1) and t of the mean."""
    out = df.groupBy(*(group or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return out.withColumn("t", F.try_divide("mean", F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))))


# ------------------------------------------------------------------ event paths
def abnormal_returns(panel: DataFrame) -> DataFrame:
    """Return minus the week's mean of the sample at hand.

    The means are aggregated and broadcast, a row a week: a window over a week would sort all
    its entities in one task.  The rows are read twice and kept in between.
    """
    rows = cut_lineage(panel)
    means = rows.groupBy(F.col("week").alias("__w")).agg(F.avg("ret").alias("__mean"))
    out = rows.join(F.broadcast(means), F.col("week").eqNullSafe(F.col("__w")), "left")
    return out.select(*panel.columns, (F.col("ret") - F.col("__mean")).alias("ar"))


def event_windows(panel: DataFrame, complete: bool = True, pre: int = PRE, post: int = POST, entity: str = "ticker") -> DataFrame:
    """Rows whose weeks -pre..+post are contiguous, with the path as an array."""
    w = W.by(entity, "week")
    at = lambda c, t: F.lag(c, -t).over(w) if t < 0 else F.lead(c, t).over(w) if t else F.col(c)
    span = (F.lag("week", pre).over(w) == F.date_sub("week", 7 * pre)) & (F.lead("week", post).over(w) == F.date_add("week", 7 * post))
    path = F.array(*[at("ar", t) for t in range(-pre, post + 1)])
    out = panel.withColumns({"__span": span, "path": path}).where("__span").drop("__span")
    return out.where(F.forall("path", lambda x: x.isNotNull())) if complete else out


def initiation_counts(panel: DataFrame, event: str = "is_initiation", group: str = "sparsity_tier", entity: str = "ticker") -> DataFrame:
    """Events, entities with one, and weeks with one, per group."""
    e = F.col(event)
    return panel.groupBy(group).agg(F.count_if(e).alias("n_events"), F.countDistinct(F.when(e, F.col(entity))).alias("n_entities"), F.countDistinct(F.when(e, F.col("week"))).alias("n_weeks"))


def weekly_terciles(df: DataFrame, value: str) -> DataFrame:
    """Rows with their weekly value tercile (1, 2, 3): ties stay together; null where the week's edges are not all different."""
    e = F.col("__q")
    q = df.where(F.col(value).isNotNull()).groupBy("week").agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in (0.0, 1 / 3, 2 / 3, 1.0)])).alias("__q"))  # names of a week
    apart = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3])
    b = F.when(F.col(value) <= e[1], 1).when(F.col(value) <= e[2], 2).otherwise(3)
    return df.where(F.col(value).isNotNull()).join(q, "week").withColumn("bucket", F.when(apart, b)).drop("__q")


def path_stats(windows: DataFrame, pre: int = PRE) -> DataFrame:
    """tau, n, mean, se, t, and the cumulated mean."""
    long = windows.select(F.posexplode("path").alias("pos", "ar")).select((F.col("pos") - pre).alias("tau"), "ar").where("ar IS NOT NULL")
    stats = long.groupBy("tau").agg(F.count("ar").alias("n"), F.avg("ar").alias("mean"), (F.stddev_samp("ar") / F.sqrt(F.count("ar"))).alias("se"))
    w = Window.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)  # pre+post+1 rows
    return stats.withColumns({"t": F.try_divide("mean", F.nullif(F.col("se"), F.lit(0.0))), "car": F.sum("mean").over(w)})


def candidates(windows: DataFrame, event: str, pre: int = PRE) -> DataFrame:
    p = F.col("path")
    total = lambda a, b: sum((p[i] for i in range(a + 1, b)), p[a])
    return windows.withColumns({"treated": F.coalesce(F.col(event), F.lit(False)), "pre_car": total(0, pre), "ar_m1": p[pre - 1], "ar_m2": p[pre - 2], "pre_car_34": total(0, pre - 2)})


#: Controls in a box of the nearest-neighbour search, and the slack that rounding may need.
BOX_ROWS, ROUNDING = 32, 1e-9


def nearest_pairs(t: DataFrame, c: DataFrame, group: list[str], zs: list[str], k: int, entity: str = "ticker") -> DataFrame:
    """(group, t_entity, c_entity): the ``k`` nearest controls of every treated row, ties to the smaller one; exact.

    Treated rows of one place ask once, and of controls of one place the ``k`` smallest are
    enough.  Controls of a block are packed into boxes of about ``BOX_ROWS`` by sorting along
    three variables in turn; the slabs and columns on the way are boxes as well.  An asker goes
    down to a near box, whose k-th distance bounds the search, and goes down again to all boxes
    that come as near.  So it meets the slabs of its block, a cube root of the boxes, and what
    lies inside the slabs and columns within the bound, never all boxes.
    """
    here, there = [f"t_{z}" for z in zs], [f"c_{z}" for z in zs]
    same = Window.partitionBy(*group, *there).orderBy(f"c_{entity}")
    own = c.select(*group, f"c_{entity}", *there).withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= k).drop("__r")
    w = lambda part, z: Window.partitionBy(*group, *part).orderBy(f"c_{z}", f"c_{entity}")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    own = own.withColumn("__m", F.ceil(F.pow(n / max(BOX_ROWS, 2 * k), F.lit(1 / min(3, len(zs))))))
    parts: list[str] = []
    for i, z in enumerate(zs[:3]):
        size = F.count(F.lit(1)).over(Window.partitionBy(*group, *parts))
        own = own.withColumn(f"__s{i}", F.floor((F.row_number().over(w(parts, z)) - 1) * F.col("__m") / size))
        parts = [*parts, f"__s{i}"]
    own = cut_lineage(own.drop("__m"))
    edges = [f(f"c_{z}").alias(f"__{e}_{z}") for z in zs for e, f in (("lo", F.min), ("hi", F.max))]
    gap = lambda z: F.greatest(F.col(f"__lo_{z}") - F.col(f"t_{z}"), F.col(f"t_{z}") - F.col(f"__hi_{z}"), F.lit(0.0))
    total = lambda f: sum((f(z) ** 2 for z in zs[1:]), f(zs[0]) ** 2)
    square = total(lambda z: F.col(f"t_{z}") - F.col(f"c_{z}"))

    def met(rows: DataFrame, level: int) -> DataFrame:
        """Rows with the boxes of a level inside their box of the level before."""
        boxes = own.groupBy(*group, *parts[: level + 1]).agg(*edges)
        return rows.join(boxes, [*group, *parts[:level]]).withColumn("__gap", total(gap)).select(*rows.columns, parts[level], "__gap")

    first = t.select(*group, *here).distinct()
    for i, p in enumerate(parts):
        first = met(first, i).groupBy(*first.columns).agg(F.min_by(p, F.struct("__gap", p)).alias(p))
    seen = first.join(own, [*group, *parts]).withColumn("__d", square)
    # The k-th of one box; without k rows in it nothing is ruled out.
    close = seen.groupBy(*group, *here).agg(F.get(F.sort_array(F.collect_list("__d")), F.lit(k - 1)).alias("__k"))
    for i in range(len(parts)):
        close = met(close, i).where(F.col("__k").isNull() | (F.col("__gap") <= F.col("__k") * (1 + ROUNDING) + ROUNDING**2)).drop("__gap")
    order = Window.partitionBy(*group, *here).orderBy("__d", f"c_{entity}")
    best = close.join(own, [*group, *parts]).withColumn("__d", F.sqrt(square)).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return t.select(*group, f"t_{entity}", *here).join(best.select(*group, *here, f"c_{entity}"), [*group, *here]).select(*group, f"t_{entity}", f"c_{entity}")


def match_pairs(cands: DataFrame, k: int = 1, caliper: float | None = CALIPER, group=("week", "sparsity_tier"), variables=MATCH_VARS, entity: str = "ticker") -> DataFrame:
    """k nearest controls of every treated row in its block, inside the caliper.

    Distances are over block z-scores (missing counts 0).  With a caliper, treated and
    controls meet only in equal or adjacent cells of one caliper's width of the first
    return variable; without one, only where the nearest can be (``nearest_pairs``).  A block
    is never compared pair by pair.  Rows are kept once for both sides; a block's moments
    are aggregated and broadcast (a row a week and tier), never a window over a block.
    """
    group = list(group)
    rows = cut_lineage(cands.dropna(subset=list(variables)).select(*group, entity, "treated", *variables, "path"))
    moments = [f(v).alias(f"__{n}{i}") for i, v in enumerate(variables) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    blocks = cut_lineage(rows.groupBy(*group).agg(F.count_if("treated").alias("__nt"), F.count_if(~F.col("treated")).alias("__nc"), *moments).where((F.col("__nt") > 0) & (F.col("__nc") >= k)))
    z = {f"z{i}": F.coalesce(F.try_divide(F.col(v) - F.col(f"__m{i}"), F.nullif(F.col(f"__s{i}"), F.lit(0.0))), F.lit(0.0)) for i, v in enumerate(variables)}
    rows = rows.join(F.broadcast(blocks), group).withColumns(z)
    cols = [*group, entity, *z, *variables, "path"]
    t = rows.where("treated").select(*[F.col(c).alias(c if c in group else f"t_{c}") for c in cols])
    c = rows.where("NOT treated").select(*[F.col(x).alias(x if x in group else f"c_{x}") for x in cols])
    if caliper is not None:
        cell = lambda col: F.floor(F.col(col) / caliper)
        t = t.withColumn("__cell", F.explode(F.array(*[cell(f"t_{variables[0]}") + d for d in (-1, 0, 1)])))
        pairs = t.join(c.withColumn("__cell", cell(f"c_{variables[0]}")), [*group, "__cell"])
        for v in RETURN_VARS:
            if v in variables:
                pairs = pairs.where(F.abs(F.col(f"t_{v}") - F.col(f"c_{v}")) <= caliper)
    else:
        pairs = nearest_pairs(t, c, group, list(z), k, entity).join(t, [*group, f"t_{entity}"]).join(c, [*group, f"c_{entity}"])
    square = sum(((F.col(f"t_z{i}") - F.col(f"c_z{i}")) ** 2 for i in range(1, len(variables))), (F.col("t_z0") - F.col("c_z0")) ** 2)
    pairs = pairs.withColumn("distance", F.sqrt(square))
    w = Window.partitionBy(*group, f"t_{entity}").orderBy("distance", f"c_{entity}")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def balance(pairs: DataFrame, variables=MATCH_VARS) -> DataFrame:
    """Standardised mean differences; balanced below 0.1."""
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"t_{v}").alias("t"), F.col(f"c_{v}").alias("c")) for v in variables])).alias("r")).select("r.*")
    out = long.groupBy("variable").agg(F.avg("t").alias("mean_t"), F.avg("c").alias("mean_c"), F.var_samp("t").alias("__vt"), F.var_samp("c").alias("__vc"))
    out = out.withColumn("smd", F.try_divide(F.col("mean_t") - F.col("mean_c"), F.nullif(F.sqrt((F.col("__vt") + F.col("__vc")) / 2), F.lit(0.0))))
    return out.withColumn("balanced", F.abs("smd") < 0.1).drop("__vt", "__vc")


def did_path(pairs: DataFrame, pre: int = PRE, entity: str = "ticker") -> DataFrame:
    """tau, difference of treated and (mean) control, its week-clustered se, and the sum."""
    one = pairs.select("week", f"t_{entity}", F.posexplode(F.arrays_zip(F.col("t_path").alias("t"), F.col("c_path").alias("c"))).alias("pos", "v"))
    per_event = one.groupBy("week", f"t_{entity}", "pos").agg((F.avg("v.t") - F.avg("v.c")).alias("d"))
    means = per_event.groupBy("pos").agg(F.avg("d").alias("m"), F.count(F.lit(1)).alias("n"))
    clusters = per_event.groupBy("pos", "week").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("k")).join(F.broadcast(means), "pos")
    e = F.col("s") - F.col("k") * F.col("m")
    out = clusters.groupBy("pos").agg(F.first("m").alias("diff"), F.first("n").alias("n_events"), F.count(F.lit(1)).alias("n_weeks"), F.sum(e * e).alias("__ss"))
    g, n = F.col("n_weeks"), F.col("n_events")
    # The small-sample factor (n - 1) / (n - k) of a mean is one.
    se = F.sqrt(F.try_divide(g, g - 1) * F.col("__ss")) / n
    out = out.withColumns({"tau": F.col("pos") - pre, "se": se})
    w = Window.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({"t": F.try_divide("diff", F.nullif(F.col("se"), F.lit(0.0))), "car_diff": F.sum("diff").over(w)}).drop("pos", "__ss")


def clean_events(cands: DataFrame, pairs: DataFrame, entity: str = "ticker") -> DataFrame:
    """Pairs whose treated row is in the middle third of the treated by its return before the event."""
    treated = cands.where("treated")
    q = exact_percentiles(treated, ["pre_car"], [1 / 3, 2 / 3]).select(F.col("q").alias("__q"))
    calm = treated.join(F.broadcast(q)).where(F.col("pre_car").between(F.col("__q")[0], F.col("__q")[1]))
    return pairs.join(calm.select("week", F.col(entity).alias(f"t_{entity}")).distinct(), ["week", f"t_{entity}"], "left_semi")


def unmatched_path(cands: DataFrame, pre: int = PRE) -> DataFrame:
    """tau, means of treated and other rows, their difference and its sum: the path before matching."""
    long = cands.select("treated", F.posexplode("path").alias("pos", "ar")).groupBy("pos").agg(F.avg(F.when(F.col("treated"), F.col("ar"))).alias("treated_mean"), F.avg(F.when(~F.col("treated"), F.col("ar"))).alias("control_mean"), F.count_if("treated").alias("n_events"))
    out = long.select((F.col("pos") - pre).alias("tau"), "treated_mean", "control_mean", (F.col("treated_mean") - F.col("control_mean")).alias("diff"), "n_events")
    return out.withColumn("car_diff", F.sum("diff").over(Window.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)))  # pre + post + 1 rows


def path_verdict(path: DataFrame, critical: float = 1.96) -> DataFrame:
    """One row: n_pre_significant, n_post_significant, parallel, verdict of a path (tau, t).

    Differences before the event mean that the design identifies nothing; without them,
    differences after it speak for information beyond price momentum.
    """
    loud = F.coalesce(F.abs("t") > critical, F.lit(False))
    one = path.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("tau") < 0) & ~F.coalesce(F.abs("t") < critical, F.lit(False))).alias("n_pre_significant"), F.count_if((F.col("tau") >= 1) & loud).alias("n_post_significant"))
    parallel = F.col("n_pre_significant") == 0
    verdict = F.when(F.col("n") == 0, "no_matched_events").when(~parallel, "not_identified").when(F.col("n_post_significant") > 0, "information").otherwise("momentum_only")
    return one.select("n_pre_significant", "n_post_significant", parallel.alias("parallel"), verdict.alias("verdict"))


# ------------------------------------------------------------------ screens and checks
def powered_correlation(series: DataFrame, matches: DataFrame, a: str, b: str, entity: str = "ticker", least_matches: int = 30, least_weeks: int = 15, least_corr: float = 0.5) -> DataFrame:
    """Correlation of two series per entity, judged only where both have power."""
    stats = series.groupBy(entity).agg(W.safe_corr(a, b).alias("corr"), F.count_if(F.col(a) > 0).alias("weeks_a"), F.count_if(F.col(b) > 0).alias("weeks_b"))
    out = stats.join(matches, entity, "left")
    powered = (F.col("n_a") >= least_matches) & (F.col("n_b") >= least_matches) & (F.col("weeks_a") >= least_weeks) & (F.col("weeks_b") >= least_weeks)
    out = out.withColumn("powered", F.coalesce(powered, F.lit(False)))
    return out.withColumn("status", F.when(~F.col("powered"), "insufficient_power").when(F.col("corr") >= least_corr, "pass").otherwise("fail"))


def quality_tier(comoves: Column, corr_fail: Column, code_only: Column, powered: Column) -> Column:
    return F.when(~comoves, "C").when(corr_fail | code_only, "B").when(~powered, "D").otherwise("A")


def joint_reading(coefs: DataFrame, critical: float = 1.96) -> DataFrame:
    """block, h, beta, t -> flags and one verdict.

    Block A holds interaction terms, block B the effect at horizon 1 and later horizons.
    A negative interaction alone identifies nothing: without a main effect neither reading
    holds; with one, reversal afterwards tells price pressure from information.
    """
    a, b = F.col("block") == "A", F.col("block") == "B"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    row = coefs.agg(
        any_(a & (F.col("beta") < 0) & (F.col("t") < -critical)).alias("any_negative"),
        any_(b & (F.col("h") == 1) & (F.abs("t") > critical)).alias("effect"),
        any_(b & (F.col("h") > 1) & (F.col("t") < -critical)).alias("reversal"),
    )
    verdict = F.when(~F.col("effect"), "no_main_effect").when(F.col("any_negative") & F.col("reversal"), "price_pressure").when(F.col("any_negative"), "information").otherwise("not_concentrated")
    return row.withColumn("verdict", verdict)
