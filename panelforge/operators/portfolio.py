"""Execution costs, order sizing and the sequential account replay."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import clip, col, corr, safe_ratio


def impact_bps(order_value: str | Column, daily_amount: str | Column, volatility: str | Column, base: float, most: float) -> Column:
    """Square-root impact: 1e4 x 0.25 x volatility x sqrt(participation) between base and most; most where liquidity is unknown."""
    share = safe_ratio(F.abs(col(order_value)), daily_amount)
    raw = 10_000 * 0.25 * col(volatility) * F.sqrt(share)
    return F.coalesce(clip(raw, base, most), F.lit(float(most)))


def fill(df: DataFrame, price: str, shares: str, side: str, slippage_bps: Column, commission_rate: float, min_commission: float, stamp_rate: float) -> DataFrame:
    """Fill price, gross amount, commission (at least the minimum), stamp duty on sells and net cash flow."""
    sign = F.when(F.col(side) == "buy", 1).otherwise(-1)
    d = df.withColumn("fill_price", F.round(F.col(price) * (1 + sign * slippage_bps / 10_000), 4)).withColumn("gross", F.col("fill_price") * F.col(shares))
    d = d.withColumn("commission", F.greatest(F.col("gross") * commission_rate, F.lit(min_commission))).withColumn("stamp", F.when(F.col(side) == "sell", F.col("gross") * stamp_rate).otherwise(0.0))
    return d.withColumn("net", -sign * F.col("gross") - F.col("commission") - F.col("stamp"))


def worth_trading(edge: str | Column, cost: str | Column, uncertainty: str | Column, safety: float, caution: float) -> Column:
    return F.coalesce(col(edge) > col(cost) * safety + col(uncertainty) * caution, F.lit(False))


def lot_shares(value: str | Column, price: str | Column, lot: int, cap_value: str | Column | None = None) -> Column:
    """Whole lots for a value; one lot where none fits but one is within the cap."""
    n = F.floor(col(value) / (col(price) * lot)) * lot
    return n if cap_value is None else F.when((n == 0) & (col(price) * lot <= col(cap_value)) & (col(value) > 0), lot).otherwise(n)


def inverse_vol_weights(df: DataFrame, by: list[str], vol: str, most: float) -> DataFrame:
    """Weights in proportion to 1 / volatility, capped; what the cap frees goes to cash."""
    from pyspark.sql import Window as W

    inv = F.when(F.col(vol) > 0, 1 / F.col(vol))
    return df.withColumn("__i", inv).withColumn("weight", F.least(F.coalesce(F.col("__i") / F.sum("__i").over(W.partitionBy(*by)), F.lit(0.0)), F.lit(most))).drop("__i")


def water_fill(proposal: list[float], name_cap: float, groups: list[str], group_cap: float, budget: float) -> list[float]:
    """Scale the proposal until the first name or group cap binds, freeze what it binds, go on with the rest."""
    weights, live, left = [0.0] * len(proposal), {i for i, p in enumerate(proposal) if p > 0}, budget
    while live and left > 1e-12:
        total = sum(proposal[i] for i in live)
        step = left / total
        for i in live:
            step = min(step, (name_cap - weights[i]) / proposal[i])
        for g in {groups[i] for i in live}:
            room = group_cap - sum(w for w, h in zip(weights, groups) if h == g)
            step = min(step, room / sum(proposal[i] for i in live if groups[i] == g))
        for i in live:
            weights[i] += step * proposal[i]
        left -= step * total
        full = {g for g in set(groups) if group_cap - sum(w for w, h in zip(weights, groups) if h == g) <= 1e-12}
        live = {i for i in live if name_cap - weights[i] > 1e-12 and groups[i] not in full}
    return weights


def affordable(free: float, price: float, lot: int, commission_rate: float, min_commission: float) -> int:
    """The most shares in whole lots whose price and commission, at least the minimum, the cash covers."""
    n = math.floor(min(free / (price * (1 + commission_rate)), (free - min_commission) / price) / lot) * lot
    while n > 0 and n * price + max(n * price * commission_rate, min_commission) > free:  # the last digit of a quotient
        n -= lot
    return max(0, n)


def replay(signals: DataFrame, account: str, cash: float, lot: int = 100, commission_rate: float = 0.0003, min_commission: float = 5.0, stamp_rate: float = 0.001, slippage_bps: float = 5.0) -> DataFrame:
    """Daily accounts: orders of the day before are executed at the open (sells first, whole lots, never beyond cash; shares bought
    today are sold tomorrow at the earliest), the NAV is taken at the close, then targets become the next day's orders.

    signals: account, trade_date, code, open, close, weight (target, null: no signal that day). The state of an account is
    sequential, so each account is one group; it gets the names it ever aims at (and its dates), not the universe.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        free, held, bought, last, pending, out = cash, {}, {}, {}, {}, []
        pdf = pdf.sort_values(["trade_date", "code"], na_position="first")
        dates, *columns = (pdf[c].tolist() for c in ("trade_date", "code", "open", "close", "weight"))
        starts = [i for i, d in enumerate(dates) if i == 0 or d != dates[i - 1]]
        for first, end in zip(starts, [*starts[1:], len(dates)]):
            date, day = dates[first], [x for x in zip(*(c[first:end] for c in columns)) if x[0] is not None]
            quotes = {code: (o, c) for code, o, c, _ in day}
            trades, costs, carried = 0, 0.0, {}
            for side in (-1, 1):
                for code in sorted(c for c, n in pending.items() if n * side > 0):
                    if code not in quotes or not quotes[code][0] > 0:
                        carried[code] = pending[code]
                        continue
                    price = quotes[code][0] * (1 + side * slippage_bps / 10_000)
                    if side < 0:
                        n = min(-pending[code], held.get(code, 0) if bought.get(code) != date else 0)
                    else:
                        n = min(pending[code], affordable(free, price, lot, commission_rate, min_commission))
                    if n <= 0:
                        continue
                    cost = max(n * price * commission_rate, min_commission) + (n * price * stamp_rate if side < 0 else 0.0)
                    free += -side * n * price - cost
                    held[code] = held.get(code, 0) + side * n
                    if side > 0:
                        bought[code] = date
                    trades, costs = trades + 1, costs + cost
            last |= {c: q[1] for c, q in quotes.items() if q[1] > 0}
            held = {c: n for c, n in held.items() if n}
            nav = free + sum(n * last[c] for c, n in held.items())
            out.append((date, nav, free, len(held), trades, costs))
            targets = {code: w for code, _, _, w in day if w is not None and w == w}
            if targets:
                want = {c: math.floor(w * nav / (last[c] * lot)) * lot for c, w in targets.items() if c in last}
                pending = {c: want.get(c, 0) - held.get(c, 0) for c in {*want, *held} if want.get(c, 0) != held.get(c, 0)}
            else:
                pending = carried
        return pd.DataFrame(out, columns=["trade_date", "nav", "cash", "positions", "trades", "costs"]).assign(**{account: pdf[account].iloc[0]})[[account, "trade_date", "nav", "cash", "positions", "trades", "costs"]]

    kinds = f"{account} {signals.schema[account].dataType.simpleString()}, trade_date string, nav double, cash double, positions int, trades int, costs double"
    rows = signals.select(account, "trade_date", "code", "open", "close", "weight")
    aimed = rows.filter("weight is not null").select(account, "code").distinct()
    days = rows.select(account, "trade_date").distinct()
    own = rows.join(aimed, [account, "code"], "left_semi").unionByName(days, allowMissingColumns=True)
    return own.groupBy(account).applyInPandas(run, kinds)


def settlement(orders: DataFrame, account: str, cash: float, lag: int = 2) -> DataFrame:
    """Cash that sells bring is free `lag` rows of dates later; buys are all or nothing from free cash. orders: account, trade_date, side, value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        free, queue, out = cash, [], []
        days: dict[str, list[tuple[str, float]]] = {}
        for date, side, value in zip(pdf["trade_date"].tolist(), pdf["side"].tolist(), pdf["value"].tolist()):
            days.setdefault(date, []).append((side, value))
        for i, date in enumerate(sorted(days)):
            free += sum(v for due, v in queue if due <= i)
            queue = [(due, v) for due, v in queue if due > i]
            filled = rejected = 0
            for side, value in sorted(days[date]):
                if side == "sell":
                    queue.append((i + lag, value))
                    filled += 1
                elif value <= free:
                    free -= value
                    filled += 1
                else:
                    rejected += 1
            out.append((pdf[account].iloc[0], date, free, sum(v for _, v in queue), filled, rejected))
        return pd.DataFrame(out, columns=[account, "trade_date", "free_cash", "receivable", "filled", "rejected"])

    return orders.groupBy(account).applyInPandas(run, f"{account} {orders.schema[account].dataType.simpleString()}, trade_date string, free_cash double, receivable double, filled int, rejected int")


def correlation_pairs(returns: DataFrame, code: str, date: str, ret: str, least: int) -> DataFrame:
    """Correlation of every pair of codes on common dates with at least `least` observations; few codes (funds), many dates."""
    a, b = returns.select(date, F.col(code).alias("a"), F.col(ret).alias("ra")), returns.select(date, F.col(code).alias("b"), F.col(ret).alias("rb"))
    return a.join(b, date).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), corr("ra", "rb").alias("corr")).filter(F.col("n") >= least)


def clusters(pairs: DataFrame, least: float) -> dict[str, str]:
    """Union-find over pairs with a correlation of at least `least`: code -> smallest code of its cluster. Codes are few (one book)."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in pairs.filter(F.col("corr") >= least).select("a", "b").toLocalIterator():
        a, b = find(r["a"]), find(r["b"])
        parent[max(a, b)] = min(a, b)
    return {c: find(c) for c in parent}


def mean_variance(returns: DataFrame, account: str, name: str, date: str, ret: str, risk_aversion: float, name_cap: float, budget: float, most: int, rounds: int = 500) -> DataFrame:
    """Long-only mean-variance weights per account with at most `most` names: (account, name, weight).

    Means and covariances are one aggregate (pairs of an account's names on common dates); an account's matrix is one small group. Names
    are dropped one by one, smallest weight first, until `most` are left; each problem is solved by projected gradient steps onto
    0 <= w <= name_cap, sum w <= budget.
    """
    import numpy as np

    a = returns.select(account, date, F.col(name).alias("a"), F.col(ret).alias("ra"))
    b = returns.select(account, date, F.col(name).alias("b"), F.col(ret).alias("rb"))
    moments = a.join(b, [account, date]).groupBy(account, "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.avg("ra").alias("mean"))

    def inside(v: np.ndarray) -> np.ndarray:
        w = np.clip(v, 0, name_cap)
        if w.sum() <= budget:
            return w
        low, high = 0.0, float(v.max())
        for _ in range(60):  # the shift that makes the weights use the budget
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, name_cap).sum() > budget else (low, mid)
        return np.clip(v - high, 0, name_cap)

    def solve(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        step = 1 / (risk_aversion * max(float(np.linalg.eigvalsh(cov)[-1]), 1e-12))
        w = inside(np.full(len(mean), budget / len(mean)))
        for _ in range(rounds):
            w = inside(w + step * (mean - risk_aversion * cov @ w))
        return w

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]))
        at = {n: i for i, n in enumerate(names)}
        cov, mean = np.zeros((len(names), len(names))), np.zeros(len(names))
        for x, y, c, m in zip(pdf["a"], pdf["b"], pdf["cov"].fillna(0.0), pdf["mean"]):
            cov[at[x], at[y]] = c
            if x == y:
                mean[at[x]] = m
        live = np.arange(len(names))
        while True:
            w = solve(mean[live], cov[np.ix_(live, live)])
            if len(live) <= most:
                break
            live = np.delete(live, int(np.lexsort((-live, w))[0]))
        return pd.DataFrame({account: pdf[account].iloc[0], name: [names[i] for i in live], "weight": w})

    kinds = f"{account} {returns.schema[account].dataType.simpleString()}, {name} {returns.schema[name].dataType.simpleString()}, weight double"
    return moments.groupBy(account).applyInPandas(run, kinds)


def residual_lots(targets: DataFrame, account: str, lot: int, name_cap: float) -> DataFrame:
    """Whole lots of the wanted weights, then one lot more at a time where the gap to the wanted value is largest, as long as cash and cap allow.

    targets: account, code, weight, price, nav. An account's targets are one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code").reset_index(drop=True)
        nav = float(pdf["nav"].iloc[0])
        want, price = (pdf["weight"] * nav).tolist(), pdf["price"].tolist()
        shares = [math.floor(w / (p * lot)) * lot if p > 0 else 0 for w, p in zip(want, price)]
        cash = sum(want) - sum(n * p for n, p in zip(shares, price))
        while True:
            gaps = [(w - n * p, -i) for i, (w, n, p) in enumerate(zip(want, shares, price)) if p > 0 and p * lot <= cash + 1e-9 and (n + lot) * p <= name_cap * nav + 1e-9 and w > n * p]
            if not gaps:
                break
            i = -max(gaps)[1]
            shares[i] += lot
            cash -= price[i] * lot
        return pdf[[account, "code"]].assign(shares=shares)

    return targets.select(account, "code", "weight", "price", "nav").groupBy(account).applyInPandas(run, f"{account} {targets.schema[account].dataType.simpleString()}, code string, shares long")


def target_orders(book: DataFrame, by: list[str], lot: int, commission_rate: float, min_commission: float, stamp_rate: float) -> DataFrame:
    """Orders that take held shares to the wanted weights, sells first, buys by falling weight as far as the cash goes: by, code, side, shares,
    value and the cash after each order. What was bought today is not sellable: sells are cut to it; a whole exit may be an odd lot.

    book: by, code, weight (null: out), price, shares, sellable (null: none), cash. One account and day is one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.fillna({"weight": 0.0, "shares": 0, "sellable": 0}).sort_values(["weight", "code"], ascending=[False, True])
        cash = float(pdf["cash"].iloc[0])
        nav = cash + float((pdf["shares"] * pdf["price"]).sum())
        out = []
        want = [math.floor(w * nav / (p * lot)) * lot if p > 0 else int(n) for w, p, n in zip(pdf["weight"], pdf["price"], pdf["shares"])]
        for side in ("sell", "buy"):
            for code, price, held, free, n in zip(pdf["code"], pdf["price"], pdf["shares"].astype(int), pdf["sellable"].astype(int), want):
                change = n - held
                if side == "sell" and change < 0:
                    size = min(-change, free)
                    size = size if size == held else size // lot * lot
                elif side == "buy" and change > 0:
                    size = min(change // lot * lot, affordable(cash, price, lot, commission_rate, min_commission))
                else:
                    continue
                if size > 0:
                    value = size * price
                    cash += (1 if side == "sell" else -1) * value - max(value * commission_rate, min_commission) - (value * stamp_rate if side == "sell" else 0.0)
                    out.append((code, side, size, value, cash))
        return pd.DataFrame(out, columns=["code", "side", "shares", "value", "cash_after"]).assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "code", "side", "shares", "value", "cash_after"]]

    keys = ", ".join(f"{c} {book.schema[c].dataType.simpleString()}" for c in by)
    return book.select(*by, "code", "weight", "price", "shares", "sellable", "cash").groupBy(*by).applyInPandas(run, f"{keys}, code string, side string, shares long, value double, cash_after double")
