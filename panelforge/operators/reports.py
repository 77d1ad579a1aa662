"""Report tables: health and readiness checks, lead and lag, coverage, statuses, figure data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.quantiles import exact_percentiles
from . import specs


def check(name: str, requirement: str, observed: Column, passed: Column) -> Column:
    """One line of a table of checks."""
    return F.struct(F.lit(name).alias("check"), F.lit(requirement).alias("requirement"), observed.cast("double").alias("observed"), F.coalesce(passed, F.lit(False)).alias("passed"))


def table_of(one: DataFrame, checks: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*checks)))


# ------------------------------------------------------------------ health
def universe_checks(universe: DataFrame, n_entities: int, n_sectors: int) -> DataFrame:
    """Size, unique keys, sectors, venues and listing dates of the universe."""
    c = F.col
    one = universe.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("u"), F.countDistinct("sector").alias("s"),
        F.count_if(c("venue").isNull()).alias("v"), F.count_if(c("listing_date").isNull()).alias("l"),
    )
    return table_of(one, [
        check("universe_rows", f"exactly {n_entities}", c("n"), c("n") == n_entities),
        check("unique_entities", "no repeats", c("n") - c("u"), c("n") == c("u")),
        check("sectors", f"exactly {n_sectors}", c("s"), c("s") == n_sectors),
        check("venues_resolved", "none missing", c("v"), c("v") == 0),
        check("listing_dates", "none missing", c("l"), c("l") == 0),
    ])


def panel_checks(panel: DataFrame, dense_least: int = 40, windows: tuple[str, ...] = ("abn_attention_weekend", "abn_attention_non_trading")) -> DataFrame:
    """Keys, imbalance range and clumps, window columns and their correlations, dense names, rows before listing.

    Needs ticker, week, roi, att_all, att_weekday, att_weekend, sparsity_tier, listing_date.
    """
    c, there = F.col, all(w in panel.columns for w in windows)
    modal = panel.where("sparsity_tier IS NOT NULL").groupBy("ticker", "sparsity_tier").count()
    first = Window.partitionBy("ticker").orderBy(F.desc("count"), "sparsity_tier")
    modal = modal.withColumn("rn", F.row_number().over(first)).where("rn = 1").agg(F.count_if(c("sparsity_tier") == "dense").alias("modal"))
    one = panel.agg(
        (F.count(F.lit(1)) - F.countDistinct("ticker", "week")).alias("dup"),
        F.count_if(F.abs("roi") > 1).alias("outside"), F.avg(F.when(c("roi").isNotNull(), (F.abs("roi") > 0.99).cast("double"))).alias("clump"),
        W.safe_corr("att_all", "att_weekday").alias("cd"), W.safe_corr("att_all", "att_weekend").alias("ce"),
        F.countDistinct(F.when(c("sparsity_tier") == "dense", c("ticker"))).alias("dense"), F.count_if(c("week") < c("listing_date")).alias("early"),
    ).join(F.broadcast(modal))
    return table_of(one, [
        check("unique_keys", "no repeats of entity and week", c("dup"), c("dup") == 0),
        check("imbalance_range", "within -1 and 1", c("outside"), c("outside") == 0),
        check("imbalance_clumps", "share near the ends below 0.01", F.coalesce("clump", F.lit(0.0)), F.coalesce(c("clump") < 0.01, F.lit(True))),
        check("both_windows", "calendar and session columns", F.lit(int(there)), F.lit(there)),
        check("window_correlations", "weekdays closer to the whole week than weekends", c("cd") - c("ce"), c("cd") > c("ce")),
        check("dense_names", f"at least {dense_least} in the sample", c("dense"), c("dense") >= dense_least),
        check("dense_names_modal", "for description", c("modal"), F.lit(True)),
        check("rows_before_listing", "none", c("early"), c("early") == 0),
    ])


def readiness(panel: DataFrame, controls: list[str], prices_verified: bool) -> DataFrame:
    """One row: which controls have no value, and whether the main tables can be called formal."""
    c = F.col
    have = F.array_compact(F.array(*[F.when(c(f"n_{x}") == 0, F.lit(x)) if x in panel.columns else F.lit(x) for x in controls]))
    one = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_entities"), F.countDistinct("week").alias("n_weeks"), *[F.count(x).alias(f"n_{x}") for x in controls if x in panel.columns])
    out = one.withColumn("missing", have)
    complete = F.size("missing") == 0
    return out.select("n_rows", "n_entities", "n_weeks", F.array_join("missing", ";").alias("missing_controls"), complete.alias("controls_available"), F.lit(prices_verified).alias("prices_verified"), (complete & F.lit(prices_verified)).alias("formal"))


def screening_checks(screen: DataFrame, ready: DataFrame) -> DataFrame:
    """Screens run, names that move with trading, controls and adjustment.  ``screen``: tier, passed."""
    c = F.col
    one = screen.agg(F.count_if(c("tier") == "A").alias("a"), F.count_if("passed").alias("p")).join(F.broadcast(ready))
    return table_of(one, [
        check("screens_run", "all three reported", c("a"), F.lit(True)),
        check("comovement", "number that passes", c("p"), F.lit(True)),
        check("formal_controls", "all available", c("controls_available").cast("int"), c("controls_available")),
        check("adjustment_verified", "against a third party", c("prices_verified").cast("int"), c("prices_verified")),
    ])


def evidence_checks(digests: DataFrame, agreement: DataFrame, lead: DataFrame) -> DataFrame:
    """The archive's digest, the parsers' agreement, and the lead-lag checks as lines of the health table."""
    c = F.col
    one = digests.agg(F.count(F.lit(1)).alias("n_digests")).join(F.broadcast(agreement)).join(F.broadcast(lead.agg(F.count(F.lit(1)).alias("k"), F.count_if("passed").alias("ok"))))
    return table_of(one, [
        check("archive_digest", "every batch has one", c("n_digests"), c("n_digests") > 0),
        check("title_parsing", "agreement above 0.95", c("agreement_rate"), c("agreement_rate") > 0.95),
        check("strict_lead", "all lead-lag checks pass", c("ok"), c("ok") == c("k")),
    ])


def lead_lag(panel: DataFrame) -> DataFrame:
    """Five checks that next week's return is next week's.

    Needs ticker, week, att_all, ret, ret_next, n_days (0 or null: no session in the week).
    """
    c = F.col
    rows = panel.withColumn("__next", F.lead("week").over(W.by("ticker", "week")))
    all_three = c("att_all").isNotNull() & c("ret").isNotNull() & c("ret_next").isNotNull()
    pick = lambda x: F.when(all_three, x)
    closed = F.coalesce(c("n_days"), F.lit(0)) == 0
    one = rows.agg(
        F.count_if(c("ret_next").isNotNull() & ~F.coalesce(c("__next") == F.date_add("week", 7), F.lit(False))).alias("skipped"),
        F.count_if(F.weekday("week") != 6).alias("days"), F.count_if(F.datediff("__next", "week") < 1).alias("late"),
        W.safe_corr(pick(F.log1p("att_all")), pick(c("ret"))).alias("same"), W.safe_corr(pick(F.log1p("att_all")), pick(c("ret_next"))).alias("next"),
        F.count_if(closed & c("ret").isNotNull()).alias("closed_ret"),
    )
    return table_of(one, [
        check("next_is_contiguous", "no week is passed over", c("skipped"), c("skipped") == 0),
        check("weeks_end_on_sunday", "every label", c("days"), c("days") == 0),
        check("return_week_is_later", "strictly", c("late"), c("late") == 0),
        check("same_week_closer", "correlation with the same week is larger", F.abs("same") - F.abs("next"), F.abs("same") > F.abs("next")),
        check("closed_weeks_without_return", "none has one", c("closed_ret"), c("closed_ret") == 0),
    ])


# ------------------------------------------------------------------ statuses and coverage
def model_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Every model tried, once a table: status, sizes, note.  Tables name it ``model`` or ``check``."""
    out = None
    for name, t in tables.items():
        key = "model" if "model" in t.columns else "check"
        if key not in t.columns or "status" not in t.columns:
            continue
        col = lambda c, kind: F.col(c).cast(kind) if c in t.columns else F.lit(None).cast(kind)  # noqa: E731, B023
        rest = F.struct(F.col("status"), col("n_obs", "long").alias("n_obs"), col("n_entities", "long").alias("n_entities"), col("n_periods", "long").alias("n_periods"), col("note", "string").alias("note"))
        rows = t.groupBy(F.col(key).alias("model")).agg(F.min(rest).alias("r")).select(F.lit(name).alias("table"), "model", "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def research_status(panel: DataFrame, health: DataFrame, ready: DataFrame, phases: list[tuple[str, str]]) -> DataFrame:
    """phase, status, note: the stated phases, then what data and checks say of the last two."""
    size = panel.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("e"), F.countDistinct("week").alias("w"))
    passed = health.agg(F.count_if("passed").alias("ok"), F.count(F.lit(1)).alias("k"))
    one = size.join(F.broadcast(passed)).join(F.broadcast(ready.select("missing_controls", "controls_available")))
    line = lambda p, s, n: F.struct(F.lit(p).alias("phase"), s.alias("status"), n.alias("note"))
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    lines = [line(p, F.lit("DONE"), F.lit(n)) for p, n in phases]
    lines += [
        line("panel", F.when(F.col("n") > 0, "DONE").otherwise("BLOCKED"), text(F.col("n").cast("string"), " rows, ", F.col("e").cast("string"), " entities, ", F.col("w").cast("string"), " weeks")),
        line("controls", F.when(F.col("controls_available"), "DONE").otherwise("BLOCKED"), text("missing: ", F.col("missing_controls"))),
        line("checks", F.when(F.col("ok") == F.col("k"), "DONE").otherwise("PARTIAL"), text(F.col("ok").cast("string"), " of ", F.col("k").cast("string"), " passed")),
    ]
    return one.select(F.inline(F.array(*lines)))


def years_covered(universe: DataFrame, found: DataFrame) -> DataFrame:
    """Years with a statement of every entity; none is NOT_COVERED, never zero.  ``found``: ticker, year."""
    years = found.groupBy("ticker").agg(F.array_sort(F.collect_set("year")).alias("years"))  # years of one entity
    out = universe.join(years, "ticker", "left")
    return out.select(*universe.columns, F.coalesce(F.size("years"), F.lit(0)).alias("n_years"), F.coalesce(F.array_join("years", ";"), F.lit("")).alias("years"), F.when(F.size("years") > 0, "OK").otherwise("NOT_COVERED").alias("status"))


def title_agreement_rates(parsed: DataFrame) -> DataFrame:
    """One row of agreement rates of two parsers.  ``parsed``: the fields of ``text.title_agreement``."""
    rate = lambda c: F.avg(c.cast("double"))
    both = rate(F.col("both_agree"))
    return parsed.agg(F.count(F.lit(1)).alias("n"), both.alias("agreement_rate"), rate(F.col("category_agree")).alias("category_agreement"), rate(F.col("reply_agree")).alias("reply_agreement"), rate(F.col("is_reply")).alias("share_reply"), (both > 0.95).alias("passed"))


# ------------------------------------------------------------------ data of the figures
def placed(totals: DataFrame, entity: str, total: str = "total") -> DataFrame:
    """``totals`` with ``place`` from 1: the largest total first, ties by entity; numbered by size class, not in one task.

    A class holds totals of one power of two; the classes before it shift its numbers.
    """
    cls = F.coalesce(F.floor(F.log2(F.col(total) + 1)), F.lit(-1)).cast("int")
    rows = totals.withColumn("__c", cls).withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy(F.desc(total), entity)))
    sizes = rows.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__c", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # 65 classes
    return rows.join(F.broadcast(before), "__c").withColumn("place", (F.col("__r") + F.col("__b")).cast("int")).drop("__c", "__r", "__b")


def coverage_map(panel: DataFrame, entity: str = "ticker") -> DataFrame:
    """entity, week, log count, and the entity's place by total count."""
    cells = panel.groupBy(entity, "week").agg(F.sum("att_all").alias("att"))
    place = placed(cells.groupBy(entity).agg(F.sum("att").alias("total")), entity).select(entity, "place")
    return cells.join(place, entity).select(entity, "week", F.log1p(F.coalesce("att", F.lit(0))).alias("log_att"), "place")


def bin_betas(panel: DataFrame, x: str, level: str, n_bins: int = 5, controls=(), **kw) -> DataFrame:
    """bin, beta, se, mean_level, n_obs: the effect of ``x`` by bins of equal counts of ``level``.

    Edges are exact percentiles, equal values share the lower bin; all bins are one battery.
    """
    rows = panel.where(F.col(level).isNotNull())
    edges = exact_percentiles(rows, [level], [i / n_bins for i in range(1, n_bins)]).first()["q"]
    at = F.lit(n_bins)
    for i in reversed(range(n_bins - 1)):
        at = F.when(F.col(level) <= F.lit(edges[i]), i + 1).otherwise(at)
    rows = rows.withColumn("bin", at)
    means = rows.groupBy("bin").agg(F.avg(level).alias("mean_level"))
    battery = [specs.Spec(f"bin{i}", "ret_next", (x,), where=F.col("bin") == i) for i in range(1, n_bins + 1)]
    fits = [(i, f.params.get(x), f.stderr.get(x), f.n_obs) for i, f in enumerate(specs.run(rows, battery, controls, **kw), 1) if f.status == "OK"]
    out = panel.sparkSession.createDataFrame(fits, "bin int, beta double, se double, n_obs long")
    return out.join(means, "bin").select("bin", "beta", "se", "mean_level", "n_obs")


def weekly_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("week").agg(F.sum("att_all").alias("att_total"), F.count_if(F.col("att_all") > 0).alias("n_discussed"))


def specification_curve(coefficients: DataFrame, checks: DataFrame, term: str) -> DataFrame:
    """name, beta, interval and place of one term over all specifications.

    ``coefficients``: model, term, beta, se; ``checks``: check, status, beta_focus, t_focus.
    """
    a = coefficients.where(F.col("term") == term).select(F.col("model").alias("name"), "beta", "se")
    b = checks.where("status = 'OK'").select(F.col("check").alias("name"), F.col("beta_focus").alias("beta"), F.try_divide("beta_focus", F.nullif(F.col("t_focus"), F.lit(0.0))).alias("se"))
    rows = a.unionByName(b).where("beta IS NOT NULL")
    place = F.row_number().over(Window.orderBy("beta", "name"))  # one row a specification
    return rows.select("name", "beta", (F.col("beta") - 1.96 * F.abs("se")).alias("low"), (F.col("beta") + 1.96 * F.abs("se")).alias("high"), place.alias("place"))


def cumulative_spread(weekly: DataFrame, cost: Column, spread: str = "long_short") -> DataFrame:
    """week, cumulated spread before and after the assumed weekly cost; a missing week counts as zero."""
    x = F.coalesce(F.col(spread), F.lit(0.0))
    w = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # one row a week
    return weekly.select("week", F.sum(x).over(w).alias("gross"), F.sum(x - cost).over(w).alias("net"))
