"""Trading simulation: inputs in Spark, the sequential cash account in one small group.

Cash in a week depends on the week before, so a strategy's account is inherently
sequential.  Everything that grows with the data - ranks, liquidity, prices, the costs in
force - is computed as DataFrames; only the top-k rows a week of a strategy reach its
account.

A buy is refused when the entry or the exit price of its week is missing, so a filled buy
always sells: ``n_positions_carried`` is zero throughout, and a failed exit cannot happen.
That rule looks ahead at the exit price; ``strict`` candidates do at least not look ahead
at labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import asof, evaluate, market


@dataclass(frozen=True)
class Costs:
    """A dated cost schedule entry."""

    fee_rate: float = 0.001425
    fee_discount: float = 0.6
    tax_rate_sell: float = 0.003
    slippage_bps: float = 20.0
    min_fee: float = 20.0
    lot_size: int = 1000

    def fee(self, gross: float) -> float:
        return max(self.min_fee, gross * self.fee_rate * self.fee_discount)

    def sell_fee(self, gross: float) -> float:
        return self.fee(gross) + gross * self.tax_rate_sell

    def slip(self, side: int, stress: float = 1.0) -> float:
        return 1.0 + side * self.slippage_bps / 1e4 * stress


def costs_at(asked: DataFrame, schedule: DataFrame, at: str = "as_of") -> DataFrame:
    """The schedule entry in force (inclusive); dates before the first one fail."""
    one = schedule.withColumn("__k", F.lit(1))
    fields = [c for c in schedule.columns if c != "effective_from"]
    days = asked.select(at).distinct().withColumn("__k", F.lit(1))
    found = asof.backward(days, one, ["__k"], at, "effective_from", fields, strict=False).drop("__k")
    # On every column, so that the check stays whichever of them is used.
    kinds = dict(schedule.dtypes)
    sure = lambda c: F.when(F.col("effective_from").isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("no cost schedule in force")).cast(kinds[c]))
    checked = found.select(at, *[sure(c).alias(c) for c in ("effective_from", *fields)])
    return asked.join(F.broadcast(checked), at)


def candidates(pred: DataFrame, labels: DataFrame, daily: DataFrame, pred_col: str, top_k: int = 20, strict: bool = False) -> DataFrame:
    """Top-k names a week with liquidity and prices.

    By default names without a usable label are dropped before ranking; ``strict`` ranks
    first, as one could have at the time.
    """
    # Of labels that repeat a key the earliest entry counts, whatever the order of the rows.
    fields = ["entry_at", "label_end_at", "label_status"]
    lab = labels.groupBy("as_of", "ticker").agg(F.min(F.struct(*fields)).alias("__l")).select("as_of", "ticker", "__l.*")
    pred = pred.drop(*fields)
    rows = pred.join(lab, ["as_of", "ticker"], "left").where(F.col(pred_col).isNotNull())
    fine = (F.col("label_status") == "ok") & F.col("entry_at").isNotNull() & F.col("label_end_at").isNotNull()
    rows = rows if strict else rows.where(fine)
    w = Window.partitionBy("as_of").orderBy(F.desc(pred_col), "ticker")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    # ``top_k`` names a date: few enough to broadcast, and only their days are looked at.
    top = cut_lineage(top.where(fine) if strict else top)
    daily = daily.join(F.broadcast(top.select("ticker").distinct()), "ticker", "left_semi")
    top = market.adv_at(top, daily)
    px = daily.select("ticker", F.col("date").alias("d_in"), F.struct(F.col("adj_open").alias("px")).alias("o"))
    top = asof.forward(top, px, ["ticker"], "entry_at", "d_in", ["o"], strict=False)
    px = daily.select("ticker", F.col("date").alias("d_out"), F.struct(F.col("adj_close").alias("px")).alias("c"))
    top = asof.backward(top, px, ["ticker"], "label_end_at", "d_out", ["c"], strict=False)
    inside = (F.col("d_in") <= F.col("label_end_at")) & (F.col("d_out") >= F.col("entry_at"))
    both = inside & (F.col("o.px") > 0) & F.col("c.px").isNotNull()
    return top.select("as_of", "ticker", "rank", "entry_at", "label_end_at", "n_obs", "adv", F.when(both, F.col("o.px")).alias("px_in"), F.when(both, F.col("c.px")).alias("px_out"))


#: Cost columns of a row, and what they are taken from if one schedule holds throughout.
COST_FIELDS = ("fee_rate", "fee_discount", "tax_rate_sell", "slippage_bps", "min_fee", "lot_size")
NAV = "strategy string, as_of date, nav double, cash double, fees double, turnover double, n_positions_carried long, is_initial boolean"
ORDERS = "strategy string, as_of date, ticker string, side string, status string, shares long, price double, gross double, fee double, entry_at date, exit_at date"


def with_costs(rows: DataFrame, costs: Costs | DataFrame, at: str = "as_of") -> DataFrame:
    """``rows`` with the cost columns in force at ``at``: of a dated schedule (effective_from and COST_FIELDS), or the same for all."""
    if isinstance(costs, Costs):
        return rows.withColumns({f: F.lit(getattr(costs, f)) for f in COST_FIELDS})
    return costs_at(rows, costs.select("effective_from", *COST_FIELDS), at).drop("effective_from")


def _costs(row) -> Costs:
    return Costs(*(getattr(row, f) for f in COST_FIELDS))


def account(rows: pd.DataFrame, cash: float = 1e6, max_weight: float = 0.05, min_adv: float = 5e6, adv_share: float = 0.01, stress: float = 1.0, least_obs: int = 20) -> tuple[list[dict], list[dict]]:
    """Weekly round trips in rank order, at each week's own costs: (orders, nav)."""
    orders, nav = [], [{"as_of": None, "nav": cash, "cash": cash, "fees": 0.0, "turnover": 0.0, "is_initial": True}]
    for at, week in rows.sort_values(["as_of", "rank"]).groupby("as_of", sort=True):
        made: list[dict] = []
        room, spent, back = cash * max_weight, 0.0, 0.0
        for r in week.itertuples():
            costs = _costs(r)
            log = lambda side, status, **kw: made.append({"as_of": at, "ticker": r.ticker, "side": side, "status": status, "entry_at": r.entry_at, "exit_at": r.label_end_at, **kw})  # noqa: E731, B023
            if pd.isna(r.adv):
                log("buy", "insufficient_adv_history" if r.n_obs < least_obs else "rejected_adv")
                continue
            if r.adv < min_adv:
                log("buy", "rejected_adv")
                continue
            if pd.isna(r.px_in) or pd.isna(r.px_out):
                log("buy", "no_price")
                continue
            budget = min(room, cash - spent)
            if budget <= 0:
                break  # lower ranks are not tried
            price = r.px_in * costs.slip(1, stress)
            shares = int(min(budget, r.adv * adv_share) / price / costs.lot_size) * costs.lot_size
            if shares <= 0:
                log("buy", "lot_too_small")
                continue
            gross = shares * price
            if gross + costs.fee(gross) > cash - spent:
                continue
            spent += gross + costs.fee(gross)
            log("buy", "filled", shares=shares, price=price, gross=gross, fee=costs.fee(gross))
            out = r.px_out * costs.slip(-1, stress)
            sold = shares * out
            back += sold - costs.sell_fee(sold)
            log("sell", "filled", shares=shares, price=out, gross=sold, fee=costs.sell_fee(sold))
        cash += back - spent
        filled = [o for o in made if "gross" in o]
        nav.append({"as_of": at, "nav": cash, "cash": cash, "fees": sum(o["fee"] for o in filled), "turnover": sum(o["gross"] for o in filled), "is_initial": False})
        orders += made
    return orders, [n | {"n_positions_carried": 0} for n in nav]


def simulate(cands: DataFrame, costs: Costs | DataFrame = Costs(), strategy: str = "strategy", what: str = "nav", **options) -> DataFrame:
    """The account of each strategy (column ``strategy``, else one): its nav or its orders.

    ``costs``: one entry for all dates, or a dated schedule.
    """
    rows = cands if "strategy" in cands.columns else cands.withColumn("strategy", F.lit(strategy))
    schema = NAV if what == "nav" else ORDERS
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        orders, nav = account(pdf, **options)
        out = pd.DataFrame(nav if what == "nav" else orders)
        out["strategy"] = pdf["strategy"].iloc[0]
        return out.reindex(columns=cols)

    slim = rows.select("strategy", "as_of", F.col("ticker").cast("string").alias("ticker"), "rank", "entry_at", "label_end_at", "n_obs", "adv", "px_in", "px_out")
    return with_costs(slim, costs).groupBy("strategy").applyInPandas(run, schema)


def totals(nav: DataFrame, initial: float | None = None) -> DataFrame:
    """Metrics of each strategy with its fees and turnover."""
    sums = nav.groupBy("strategy").agg(F.sum("fees").alias("total_fees"), F.sum("turnover").alias("total_turnover"), F.max("n_positions_carried").alias("n_positions_carried"))
    return evaluate.nav_metrics(nav, initial=initial).join(sums, "strategy")


def benchmark_account(spans: DataFrame, costs: Costs | DataFrame = Costs(), cash: float = 1e6, hold: bool = False, stress: float = 1.0) -> DataFrame:
    """One series traded each week (or bought once and held): as_of, nav, cash, fees, turnover.

    ``spans``: as_of, px_in, px_out, one row a week.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        money, shares, out = cash, 0, []
        for i, r in enumerate(pdf.sort_values("as_of").itertuples()):
            c, fees, turnover = _costs(r), 0.0, 0.0
            if hold:
                if i == 0 and not pd.isna(r.px_in):
                    price = r.px_in * c.slip(1, stress)
                    shares = int(money / price / c.lot_size) * c.lot_size
                    fees, turnover = (c.fee(shares * price), shares * price) if shares else (0.0, 0.0)
                    money -= turnover + fees
                out.append((r.as_of, money + shares * (0.0 if pd.isna(r.px_out) else r.px_out), money, fees, turnover))
                continue
            if not (pd.isna(r.px_in) or pd.isna(r.px_out)):
                price = r.px_in * c.slip(1, stress)
                n = int(money / price / c.lot_size) * c.lot_size
                if n > 0:
                    buy, sell = n * price, n * r.px_out * c.slip(-1, stress)
                    fees, turnover = c.fee(buy) + c.sell_fee(sell), buy + sell
                    money += sell - buy - fees
            out.append((r.as_of, money, money, fees, turnover))
        return pd.DataFrame(out, columns=["as_of", "nav", "cash", "fees", "turnover"])

    return with_costs(spans, costs).withColumn("__k", F.lit(1)).groupBy("__k").applyInPandas(run, "as_of date, nav double, cash double, fees double, turnover double")


def diagnostics(orders: DataFrame, nav: DataFrame, top_k: int = 20) -> DataFrame:
    """Fill rate, cash share and rejection counts per week."""
    buys = orders.where("side = 'buy'")
    kinds = ["filled", "rejected_adv", "insufficient_adv_history", "lot_too_small", "no_price"]
    per = buys.groupBy("as_of").agg(F.lit(top_k).alias("intended_buys"), F.count(F.lit(1)).alias("attempted_buys"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    return per.join(nav.select("as_of", "nav", "cash"), "as_of", "left").withColumns({"fill_rate": F.col("filled") / top_k, "cash_fraction": F.try_divide("cash", F.nullif(F.col("nav"), F.lit(0.0)))})
