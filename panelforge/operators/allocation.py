"""Weights from covariances: blocked sums of products, shrinkage, risk-adjusted weights and constrained mean-variance.

Products of an account's names are summed in blocks of dates where the rows lie, so what is shuffled is a row a pair
of names and block, whatever the number of dates. A book (the candidates of an account) is one small group; its weights come from an
interior-point solver of a convex quadratic program, its names from branch and bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: names times positions up to which supports are searched exactly; larger books keep the largest relaxed weights.
EXACT_SEARCH = 96
#: Losses of a unit of exposure under stress.
SHOCKS = {"market": -0.20, "industry": -0.15, "volatility": -0.10, "fx": -0.08, "premium": -0.10}
#: Weights and slacks under this count as 0; a missing unit of gross exposure costs this much times its square.
SMALL, SHORTFALL = 1e-7, 10.0


def pair_sums(returns: DataFrame, account: str, name: str, date: str, ret: str) -> DataFrame:
    """(account, a, b, n, sa, sb, saa, sab, sbb) over the dates on which both names of an account have a return, a <= b.

    Rows of a date are one array; a task multiplies the dates of a batch as one matrix per account, so pairs of names are emitted
    once a batch and not once a date. A repeated (account, date, name) counts with its mean. Null returns are no rows.
    """
    kind, named = returns.schema[account].dataType.simpleString(), returns.schema[name].dataType.simpleString()
    r = returns.filter(F.col(ret).isNotNull() & ~F.isnan(ret)).groupBy(account, date, name).agg(F.avg(ret).alias("__r"))
    days = r.groupBy(account, date).agg(F.collect_list(F.struct(name, "__r")).alias("__x")).select(account, "__x")

    def run(batches):
        for pdf in batches:
            for key, of in pdf.groupby(account, sort=True):
                at = np.repeat(np.arange(len(of)), of["__x"].map(len))
                flat = [(x[name], x["__r"]) for day in of["__x"] for x in day]
                names, col = np.unique([f[0] for f in flat], return_inverse=True)
                x, on = np.zeros((len(of), len(names))), np.zeros((len(of), len(names)))
                x[at, col], on[at, col] = [f[1] for f in flat], 1.0
                sums = [m[np.triu_indices(len(names))] for m in (on.T @ on, x.T @ on, on.T @ x, (x * x).T @ on, x.T @ x, on.T @ (x * x))]
                i, j = np.triu_indices(len(names))
                out = pd.DataFrame({account: key, "a": names[i], "b": names[j], **dict(zip(["n", "sa", "sb", "saa", "sab", "sbb"], sums))})
                yield out[out["n"] > 0]

    parts = days.mapInPandas(run, f"{account} {kind}, a {named}, b {named}, n double, sa double, sb double, saa double, sab double, sbb double")
    return parts.groupBy(account, "a", "b").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in ("sa", "sb", "saa", "sab", "sbb")])


def covariances(sums: DataFrame, least: int = 2) -> DataFrame:
    """Sums of pairs with `cov` (n - 1 in the denominator) and `corr`, of pairs with `least` common dates."""
    n = F.col("n")
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - 1)
    var = lambda c: F.greatest((F.col(f"s{c}{c}") - F.col(f"s{c}") ** 2 / n) / (n - 1), F.lit(0.0))
    d = sums.filter(n >= max(2, least)).withColumn("cov", cov)
    return d.withColumn("corr", F.col("cov") / F.nullif(F.sqrt(var("a") * var("b")), F.lit(0.0)))


def shrunk(returns: DataFrame, account: str, name: str, date: str, ret: str) -> DataFrame:
    """(account, a, b, cov, shrinkage): covariances shrunk towards equal variances without correlation, as far as Ledoit and Wolf prescribe; a <= b.

    The optimal share needs, beside the covariances S, only the sum over dates of the fourth power of the centered rows' norms. Names
    of an account are taken as observed on the account's common dates only, so S is one matrix of one set of rows.
    """
    r = returns.filter(F.col(ret).isNotNull() & ~F.isnan(ret)).groupBy(account, date, name).agg(F.avg(ret).alias("__r"))
    size = r.groupBy(account).agg(F.countDistinct(name).alias("__p"))
    whole = r.groupBy(account, date).agg(F.count(F.lit(1)).alias("__k")).join(size, account).filter("__k = __p").select(account, date, "__p")
    r = r.join(whole, [account, date])
    mean = r.groupBy(account, name).agg(F.avg("__r").alias("__m"))
    centered = r.join(mean, [account, name]).select(account, date, name, (F.col("__r") - F.col("__m")).alias("__x"))
    sums = pair_sums(centered, account, name, date, "__x")
    scatter = sums.select(account, "a", "b", (F.col("sab") / F.col("n")).alias("s"), "n")
    norms = centered.groupBy(account, date).agg(F.sum(F.col("__x") ** 2).alias("__q")).groupBy(account).agg(F.sum(F.col("__q") ** 2).alias("__q4"))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    whole = scatter.groupBy(account).agg(F.max("n").alias("__n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("__tr"), F.sum(twice * F.col("s") ** 2).alias("__s2")).join(size, account).join(norms, account)
    mu = F.col("__tr") / F.col("__p")
    apart = F.col("__s2") - F.col("__p") * mu**2
    noise = (F.col("__q4") / F.col("__n") - F.col("__s2")) / F.col("__n")
    share = whole.select(account, mu.alias("__mu"), F.when(apart > 0, F.least(F.greatest(noise / apart, F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("shrinkage"))
    d = scatter.join(share, account)
    return d.select(account, "a", "b", (F.col("s") * (1 - F.col("shrinkage")) + F.when(F.col("a") == F.col("b"), F.col("shrinkage") * F.col("__mu")).otherwise(0.0)).alias("cov"), "shrinkage")


def project_budget(wanted: np.ndarray, cap: float, budget: float, groups: np.ndarray | None = None, group_cap: float = 1.0) -> np.ndarray:
    """Weights in proportion to `wanted` that use the budget as far as the caps of names and groups allow: what exceeds a cap is dealt to the others, until nothing more fits.

    A group whose names want more than its cap gets its cap, dealt among them in the same way.
    """
    w = np.where(np.isfinite(wanted), np.maximum(wanted, 0.0), 0.0)
    out, live, left = np.zeros(len(w)), w > 0, max(budget, 0.0)
    labels = np.arange(len(w)) if groups is None else np.unique(groups, return_inverse=True)[1]
    room = np.full(labels.max() + 1 if len(w) else 0, np.inf if groups is None else group_cap)
    while live.any() and left > 1e-15:
        step = np.where(live, w, 0.0)
        share = step / step.sum()
        by_name = np.where(live, (cap - out) / np.where(share > 0, share, 1), np.inf)
        want = np.bincount(labels, share, len(room))
        by_group = np.where(want > 0, room / np.where(want > 0, want, 1), np.inf)
        t = min(left, by_name.min(), by_group.min())
        out, room, left = out + t * share, room - t * want, left - t
        live &= (out < cap - 1e-15) & (room[labels] > 1e-15)
    return out


def covariance_weights(candidates: DataFrame, cov: DataFrame, account: str, name: str, cap: float, budget: float = 1.0, group: str | None = None, group_cap: float = 1.0, risk_aversion: float = 1.0, turnover_penalty: float = 0.0, band: float = 0.0, rounds: int = 40) -> DataFrame:
    """(account, name, weight): inverse-volatility weights tilted by active forecasts, moved towards equal marginal risk of the covariance, blended with what is held, projected onto caps and budget after each step.

    candidates: account, name, volatility, and expected, confidence, current where there are any (null: no forecast, not held).
    cov: account, a, b, cov of the account's names (a <= b); names without covariances keep the first weights. Volatility that is missing
    or not positive counts as the median; a change below `band` is not made. A book is one small group.
    """
    given = [c for c in ("expected", "confidence", "current") if c in candidates.columns]
    keys = [account, name, "volatility", *given, *([group] if group else [])]

    def run(book: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(book):
            return pd.DataFrame({account: [], name: [], "weight": []}, dtype=object)
        book = book.sort_values(name).reset_index(drop=True)
        column = lambda c: book[c].to_numpy(float) if c in book else np.full(len(book), np.nan)
        groups = book[group].to_numpy() if group else None
        fit = lambda w: project_budget(w, cap, budget, groups, group_cap)
        vol = np.abs(column("volatility"))
        good = np.isfinite(vol) & (vol > 0)
        mid = float(np.median(vol[good])) if good.any() else 0.2
        vol = np.clip(np.where(good, vol, mid), max(mid * 0.25, 1e-4), max(mid * 4.0, 1e-4)) if good.any() else np.full(len(book), 0.2)
        inverse = 1 / vol
        wanted = np.clip(inverse / (np.median(inverse) or 1.0), 0.5, 2.0) * tilt(column("expected") * column("confidence") / vol)
        w = anchor = fit(wanted)
        s = matrix(book[name].tolist(), pairs)
        if s is not None and len(book) > 1 and (scale := float(np.median(np.diag(s)))) > 1e-12:
            s = s / scale
            blend = min(max(risk_aversion, 0.0) / (1 + max(risk_aversion, 0.0)), 0.85)
            for _ in range(rounds):
                w = (1 - blend) * anchor + blend * fit((anchor + 1e-8) / np.sqrt(np.diag(s) + np.maximum(s @ w, 0.0) + 1e-8))
            w = fit(w)
        if "current" in book:
            held = np.nan_to_num(column("current"))
            penalty = min(max(turnover_penalty, 0.0), 0.95)
            w = fit(np.where((np.abs(w - held) < band) & (band > 0), held, (1 - penalty) * w + penalty * held))
        return pd.DataFrame({account: book[account], name: book[name], "weight": w})

    kinds = f"{account} {candidates.schema[account].dataType.simpleString()}, {name} {candidates.schema[name].dataType.simpleString()}, weight double"
    return candidates.select(*keys).groupBy(account).cogroup(cov.select(account, "a", "b", "cov").groupBy(account)).applyInPandas(run, kinds)


def tilt(utility: np.ndarray) -> np.ndarray:
    """exp(0.45 z) of robustly standardised utilities, z within 1.5; 1 where there is none."""
    ok = np.isfinite(utility)
    if not ok.any():
        return np.ones(len(utility))
    center = float(np.median(utility[ok]))
    scale = float(np.median(np.abs(utility[ok] - center))) * 1.4826
    scale = scale if scale > 1e-12 else max(float(np.abs(utility[ok]).max()), 1e-12)
    return np.where(ok, np.exp(0.45 * np.clip((np.where(ok, utility, center) - center) / scale, -1.5, 1.5)), 1.0)


def matrix(names: list, pairs: pd.DataFrame) -> np.ndarray | None:
    """The symmetric matrix of (a, b, cov) in the order of names; None where a pair is missing."""
    at = {n: i for i, n in enumerate(names)}
    s = np.full((len(names), len(names)), np.nan)
    for a, b, c in zip(pairs["a"], pairs["b"], pairs["cov"]):
        if a in at and b in at:
            s[at[a], at[b]] = s[at[b], at[a]] = c
    return s if np.isfinite(s).all() else None


@dataclass(frozen=True)
class Limits:
    """What weights must keep: `groups` and `exposures` map a column to the cap of each of its values, or of its weighted sum."""

    positions: int
    name: float = 1.0
    gross: float = 1.0
    target_gross: float = 0.0
    cash: float = 0.0
    turnover: float = 1.0
    tracking_error: float | None = None
    groups: dict[str, float] = field(default_factory=dict)
    exposures: dict[str, float] = field(default_factory=dict)

    @property
    def budget(self) -> float:
        return min(self.gross, 1 - self.cash)


@np.errstate(all="ignore")  # a point that is no longer finite ends the search
def interior_point(h: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 80) -> np.ndarray | None:
    """The x that minimises x'hx / 2 + g'x over ax <= b (h positive semidefinite), by a primal-dual predictor-corrector method; None if it finds no feasible one."""
    n, m = len(g), len(b)
    x, s, z = np.zeros(n), np.maximum(b, 1.0), np.ones(m)
    unit = max(1.0, np.abs(g).max(), np.abs(b).max())
    for _ in range(steps):  # where numbers give out, the last point stands or falls by its feasibility
        dual, primal, gap = h @ x + g + a.T @ z, a @ x + s - b, s @ z / m
        if max(np.abs(dual).max(), np.abs(primal).max()) < 1e-10 * unit and gap < 1e-12 * unit:
            break
        d = z / s
        k = h + (a * d[:, None]).T @ a + 1e-14 * np.eye(n)

        def direction(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dx = np.linalg.solve(k, -dual - a.T @ (d * primal - r / s))
            ds = -primal - a @ dx
            return dx, ds, (-r - z * ds) / s

        def longest(v: np.ndarray, dv: np.ndarray) -> float:
            return min(1.0, float(np.min(-v[dv < 0] / dv[dv < 0], initial=np.inf)))

        try:
            _, ds, dz = direction(s * z)
            if not (np.isfinite(ds).all() and np.isfinite(dz).all()):
                break
            ahead = (s + longest(s, ds) * ds) @ (z + longest(z, dz) * dz) / m
            dx, ds, dz = direction(s * z + ds * dz - (ahead / gap) ** 3 * gap)
        except np.linalg.LinAlgError:
            break
        if not (np.isfinite(dx).all() and np.isfinite(ds).all() and np.isfinite(dz).all()):
            break
        p, q = 0.99 * longest(s, ds), 0.99 * longest(z, dz)
        x, s, z = x + p * dx, np.maximum(s + p * ds, 1e-16), np.maximum(z + q * dz, 1e-16)
    return x if np.isfinite(x).all() and np.max(a @ x - b) < 1e-6 else None


class Book:
    """An account's problem: alpha, costs, holdings, benchmark, covariance and limits as arrays in the order of names."""

    def __init__(self, book: pd.DataFrame, cov: np.ndarray, name: str, limits: Limits, risk_aversion: float, active_risk_aversion: float, cost_aversion: float):
        column = lambda c, other: book[c].fillna(other).to_numpy(float) if c in book else np.full(len(book), other)
        self.names, self.limits, self.cov = book[name].tolist(), limits, cov
        self.alpha, self.cost = column("alpha", 0.0), column("cost_bps", 0.0) / 1e4
        self.current, self.benchmark = column("current", 0.0), column("benchmark", 0.0)
        self.cap = np.minimum(np.clip(column("liquidity_cap", 1.0), 0, 1), limits.name)
        self.groups = [(f"group:{c}:{v}", (book[c] == v).to_numpy(float), cap) for c, cap in sorted(limits.groups.items()) for v in sorted(book[c].unique())]
        self.sums = self.groups + [(f"exposure:{c}", column(c, 0.0), cap) for c, cap in sorted(limits.exposures.items())]
        self.risk, self.active, self.aversion = risk_aversion, active_risk_aversion, cost_aversion

    def objective(self, w: np.ndarray) -> float:
        active = w - self.benchmark
        short = max(self.limits.target_gross - w.sum(), 0.0)
        return float(self.alpha @ w - self.risk / 2 * w @ self.cov @ w - self.active / 2 * active @ self.cov @ active - self.aversion * self.cost @ np.abs(w - self.current) - SHORTFALL * short**2)

    def turnover(self, w: np.ndarray) -> float:
        return float(np.abs(w - self.current).sum() + abs(w.sum() - self.current.sum())) / 2

    def tracking_error(self, w: np.ndarray) -> float:
        return float(np.sqrt(max((w - self.benchmark) @ self.cov @ (w - self.benchmark), 0.0)))

    def relaxed(self, allowed: np.ndarray, extra: float = 0.0) -> np.ndarray | None:
        """Best weights of the allowed names, whatever their number; variables are weights, trades, the change of cash and the shortfall."""
        n, lim = len(self.alpha), self.limits
        one, eye, zero, trade = np.ones(n), np.eye(n), np.zeros((n, n)), np.zeros((n, 2))
        cap = np.where(allowed, self.cap, 0.0)
        row = lambda w, t, c, s: np.concatenate([w, t, [c, s]])[None]
        no = np.zeros(n)
        a = [np.hstack([-eye, zero, trade]), np.hstack([eye, zero, trade]), np.hstack([eye, -eye, trade]), np.hstack([-eye, -eye, trade])]
        b = [no, cap, self.current, -self.current]
        rows = [(row(one, no, -1, 0), self.current.sum()), (row(-one, no, -1, 0), -self.current.sum()), (row(no, one, 1, 0), 2 * lim.turnover), (row(one, no, 0, 0), lim.budget), (row(no, no, 0, -1), 0.0), (row(-one, no, 0, -1), -lim.target_gross)]
        rows += [(row(v, no, 0, 0), c) for _, v, c in self.sums]
        a, b = np.vstack(a + [r for r, _ in rows]), np.concatenate(b + [[v] for _, v in rows])
        h = np.zeros((2 * n + 2, 2 * n + 2))
        h[:n, :n] = (self.risk + self.active + extra) * self.cov
        h[-1, -1] = 2 * SHORTFALL
        g = np.concatenate([-self.alpha - (self.active + extra) * self.cov @ self.benchmark, self.aversion * self.cost, [0, 0]])
        x = interior_point(h, g, a, b)
        return None if x is None else np.where(x[:n] > SMALL, np.minimum(x[:n], cap), 0.0)

    def tracked(self, allowed: np.ndarray) -> np.ndarray | None:
        """Like relaxed, within the tracking error: the least extra active risk aversion that keeps it, by bisection; the error falls as the aversion grows."""
        w, most = self.relaxed(allowed), self.limits.tracking_error
        if w is None or most is None or self.tracking_error(w) <= most + 1e-9:
            return w
        low, high = 0.0, 1.0
        while (v := self.relaxed(allowed, high)) is not None and self.tracking_error(v) > most:
            low, high = high, high * 8
            if high > 1e9:
                return None
        for _ in range(60):
            mid = (low + high) / 2
            u = self.relaxed(allowed, mid)
            if u is None or self.tracking_error(u) > most:
                low = mid
            else:
                high, v = mid, u
        return v

    def exact(self) -> np.ndarray | None:
        """Best weights of at most `positions` names: relaxations bound what a set of excluded and required names can reach."""
        best, at = None, -np.inf
        open_ = [(np.ones(len(self.alpha), bool), frozenset())]
        while open_:
            allowed, forced = open_.pop()
            w = self.tracked(allowed)
            if w is None or self.objective(w) <= at + 1e-10:
                continue
            held = np.flatnonzero(w > SMALL)
            if len(held) <= self.limits.positions:
                best, at = w, self.objective(w)
                continue
            if len(forced) == self.limits.positions:
                open_.append((np.isin(np.arange(len(allowed)), list(forced)), forced))
                continue
            i = max((i for i in held if i not in forced), key=lambda i: (w[i], -i))
            without = allowed.copy()
            without[i] = False
            open_ += [(without, forced), (allowed, forced | {int(i)})]
        return best

    def solved(self) -> tuple[np.ndarray, str | None]:
        """(weights, reason why all is cash, or None)."""
        lim, none = self.limits, np.zeros(len(self.alpha))
        if lim.target_gross > lim.budget + SMALL:
            return none, "target_gross_exposure_above_budget"
        if len(self.alpha) * lim.positions <= EXACT_SEARCH:
            w = self.exact()
        else:
            w = self.tracked(np.ones(len(self.alpha), bool))
            if w is not None and (w > SMALL).sum() > lim.positions:
                rank = np.lexsort((np.arange(len(w)), -self.alpha, -w))[: lim.positions]
                again = self.tracked(np.isin(np.arange(len(w)), rank))
                if again is None:
                    rank = np.lexsort((np.arange(len(w)), -self.alpha, -w, -(self.current + self.benchmark)))[: lim.positions]
                    again = self.tracked(np.isin(np.arange(len(w)), rank))
                w = again
        if w is None:
            return none, "infeasible_constraints"
        if w.sum() <= SMALL or (lim.target_gross <= SMALL and self.objective(w) <= self.objective(none) + 1e-10):
            return none, "non_positive_net_utility"
        return w, None

    def binding(self, w: np.ndarray) -> list[str]:
        """Names of the constraints that hold with equality."""
        lim, gross, near = self.limits, float(w.sum()), 1e-5
        out = {"max_gross_exposure": abs(gross - lim.budget) <= near, "target_gross_exposure": lim.target_gross > 0 and gross >= lim.target_gross - near, "target_gross_exposure_shortfall": lim.target_gross - gross > near}
        out |= {"min_cash_weight": abs(1 - gross - lim.cash) <= near, "max_positions": (w > SMALL).sum() >= lim.positions, "max_turnover": self.turnover(w) >= lim.turnover - near}
        out |= {"max_tracking_error": lim.tracking_error is not None and self.tracking_error(w) >= lim.tracking_error - near}
        out |= {f"max_name_weight:{n}": v >= lim.name - near for n, v in zip(self.names, w)} | {f"liquidity:{n}": c < lim.name and v >= c - near for n, v, c in zip(self.names, w, self.cap)}
        return sorted([k for k, ok in out.items() if ok] + [k for k, v, c in self.sums if v @ w >= c - near])


def stress_losses(exposures: dict[str, float], groups: dict[str, float], shocks: dict[str, float] = SHOCKS) -> dict[str, float]:
    """Losses under each shock of a book's exposures (market_beta, volatility_beta, ...); the industry shock meets its largest industry."""
    out = {k: max(0.0, -v * exposures.get(f"{k}_beta", 0.0)) for k, v in shocks.items() if k != "industry"}
    out["industry"] = max(0.0, -shocks["industry"] * max(groups.values(), default=0.0))
    return out


def constrained_weights(candidates: DataFrame, cov: DataFrame, account: str, name: str, limits: Limits, risk_aversion: float = 1.0, active_risk_aversion: float = 0.0, cost_aversion: float = 1.0) -> DataFrame:
    """(account, name, weight, risk, cash, turnover, volatility, tracking_error, objective, binding, fallback): the long-only weights of at most `positions` names that maximise alpha less risk, active risk and cost within the limits.

    candidates: account, name, alpha, and where given liquidity_cap, current, benchmark, cost_bps and the columns of groups and exposures.
    cov: account, a, b, cov (a <= b). risk: a name's share of the volatility. Books of at most EXACT_SEARCH names times
    positions are solved exactly, larger ones on the names with the largest relaxed weights. Where no weights satisfy the limits, a covariance is missing, a
    name stands twice, or nothing beats cash, all is cash and `fallback` says why. A book is one small group.
    """

    def run(book: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values(name).reset_index(drop=True)
        s = matrix(book[name].tolist(), pairs)
        fallback = "duplicate_candidate_codes" if book[name].duplicated().any() else "missing_covariance" if s is None else None
        w, b = np.zeros(len(book)), None
        if fallback is None:
            values, vectors = np.linalg.eigh(s)
            b = Book(book, (vectors * np.clip(values, 0, None)) @ vectors.T, name, limits, risk_aversion, active_risk_aversion, cost_aversion)
            w, fallback = b.solved()
        volatility = float(np.sqrt(max(w @ b.cov @ w, 0.0))) if b else 0.0
        out = pd.DataFrame({account: book[account], name: book[name], "weight": w})
        out["risk"] = w * (b.cov @ w) / volatility if b and volatility > 1e-12 else 0.0
        out["cash"], out["turnover"], out["volatility"] = 1 - float(w.sum()), b.turnover(w) if b and not fallback else 0.0, volatility
        out["tracking_error"], out["objective"] = (b.tracking_error(w), b.objective(w)) if b and not fallback else (0.0, 0.0)
        out["binding"] = [["fail_closed"] if fallback else b.binding(w)] * len(book)
        return out.assign(fallback=fallback)

    kinds = f"{account} {candidates.schema[account].dataType.simpleString()}, {name} {candidates.schema[name].dataType.simpleString()}, weight double, risk double, cash double, turnover double, volatility double, tracking_error double, objective double, binding array<string>, fallback string"
    both = lambda empty: lambda a, b: run(a, b) if len(a) else empty()
    nothing = lambda: pd.DataFrame({c.split()[0]: [] for c in kinds.split(", ")}, dtype=object)
    return candidates.groupBy(account).cogroup(cov.select(account, "a", "b", "cov").groupBy(account)).applyInPandas(both(nothing), kinds)


def enumerated(solve: Callable[[np.ndarray], np.ndarray | None], objective: Callable[[np.ndarray], float], names: int, positions: int) -> np.ndarray | None:
    """The best of all supports of at most `positions` names, one by one: what `Book.exact` must equal."""
    from itertools import combinations

    best, at = None, -np.inf
    for support, _ in zip(combinations(range(names), min(positions, names)), count()):
        w = solve(np.isin(np.arange(names), support))
        if w is not None and objective(w) > at:
            best, at = w, objective(w)
    return best
