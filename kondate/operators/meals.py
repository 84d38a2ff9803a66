"""Meals: one staple with up to two side dishes under a budget and an energy range, by request."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate import schema
from kondate.operators.metrics import eligible, pfc_distance, pfc_ratios, protein_per_100yen
from kondate.operators.rank import top_k

STAPLE, SIDE = "主食", "副菜"
REQUEST = ["request_id", "store", "budget", "calories", "tp", "tf", "tc", "tolerance"]


def _target() -> tuple[Column, Column, Column]:
    return F.col("tp"), F.col("tf"), F.col("tc")


def ranked_candidates(catalog: DataFrame, requests: DataFrame, most: int = 60) -> DataFrame:
    """The best staples and sides of each request: by protein for the money, then nearness to the target."""
    fits = (F.col("i.price") <= F.col("r.budget")) & (F.col("i.kcal") <= F.col("r.calories")) & (F.col("i.store") == F.col("r.store"))
    items = catalog.where(eligible() & protein_per_100yen().isNotNull() & F.col("category").isin(STAPLE, SIDE))
    joined = items.alias("i").join(requests.alias("r"), fits).select("r.*", *[f"i.{x}" for x in ("id", "name", "category", "ord", *schema.NUMBERS)])
    order = [F.desc(protein_per_100yen(unit=None)), F.asc(pfc_distance(_target())), F.asc("ord")]
    return top_k(joined, ["request_id", "category"], order, most, "rk")


def combinations(ranked: DataFrame) -> DataFrame:
    """All meals of each request within budget and energy: items, their ranks and the five sums, added in the order of the items."""
    item = F.struct("id", "name", "price").alias("item")
    sums = [F.col(x) for x in schema.NUMBERS]
    staple = ranked.where(F.col("category") == STAPLE).select(*REQUEST, F.col("rk").alias("s"), item.alias("s_item"), *[x.alias(f"s_{n}") for x, n in zip(sums, schema.NUMBERS, strict=True)])

    def side(letter: str) -> DataFrame:
        return ranked.where(F.col("category") == SIDE).select(F.col("request_id").alias(f"{letter}_request"), F.col("rk").alias(letter), item.alias(f"{letter}_item"), *[x.alias(f"{letter}_{n}") for x, n in zip(sums, schema.NUMBERS, strict=True)])

    def of(df: DataFrame, letters: list[str]) -> DataFrame:
        places = [F.col(x) if x in letters else F.lit(0) for x in "sab"]
        total = [sum((F.col(f"{x}_{n}") for x in letters[1:]), F.col(f"{letters[0]}_{n}")).alias(n) for n in schema.NUMBERS]
        return df.select(*REQUEST, F.array(*[f"{x}_item" for x in letters]).alias("items"), F.lit(len(letters)).alias("size"), *[p.alias(x) for p, x in zip(places, "sab", strict=True)], *total)

    def within(*letters: str) -> Column:
        total = lambda n: sum((F.col(f"{x}_{n}") for x in letters[1:]), F.col(f"{letters[0]}_{n}"))
        return (total("price") <= F.col("budget") + 1e-8) & (total("kcal") <= F.col("calories") + 1e-8)

    pair = staple.join(side("a"), (F.col("request_id") == F.col("a_request")) & within("s", "a"))
    triple = pair.join(side("b"), (F.col("request_id") == F.col("b_request")) & (F.col("a") < F.col("b")) & within("s", "a", "b"))
    return of(staple, ["s"]).unionByName(of(pair, ["s", "a"])).unionByName(of(triple, ["s", "a", "b"]))


BEST = "request_id string, store string, budget double, calories double, tp double, tf double, tc double, tolerance double, items array<struct<id:string,name:string,price:double>>, size int, s int, a int, b int, p double, f double, c double, kcal double, price double, rank int, looked long"
#: What rounding may add to a sum; bounds are wider by it, so that they never cut what the exact test lets through.
SLACK = 1e-6


class _Meals:
    """The best meals of one request, by branch and bound over its ranked staples and sides (numpy rows p, f, c, kcal, price)."""

    def __init__(self, staples: np.ndarray, sides: np.ndarray, request: dict, k: int):
        self.staples, self.sides, self.k, self.best, self.looked = staples, sides, k, [], 0
        self.budget, self.calories, self.target, self.tolerance = request["budget"], request["calories"], [request[x] for x in ("tp", "tf", "tc")], request["tolerance"]
        # what no meal may have above 0: sums over items of price, energy (both ways) and each ratio's distance to its limits
        self.side_forms, self.limits = self._forms(sides)
        self.staple_forms, _ = self._forms(staples)

    def _forms(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.stack([4 * x[:, 0], 9 * x[:, 1], 4 * x[:, 2]], 1)
        total = parts.sum(1)
        ratios = [w for i, t in enumerate(self.target) for w in (100 * parts[:, i] - (t + self.tolerance + SLACK) * total, (t - self.tolerance - SLACK) * total - 100 * parts[:, i])]
        limits = [self.budget + SLACK, self.calories + SLACK, SLACK - self.calories * 0.75, *[SLACK] * 6]
        return np.stack([x[:, 4], x[:, 3], -x[:, 3], *ratios], 1), np.array(limits)

    def _take(self, s: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> None:
        """Test these meals exactly and keep the best."""
        self.looked += len(s)
        sums = self.staples[s]
        for side in (a, b):
            sums = sums if side is None else sums + self.sides[side]
        p, f, c, kcal, price = sums.T
        parts = (4 * p, 9 * f, 4 * c)
        total = parts[0] + parts[1] + parts[2]
        with np.errstate(divide="ignore", invalid="ignore"):
            gaps = [np.abs(x / total * 100 - t) for x, t in zip(parts, self.target, strict=True)]
            value = 100 * p / price
        fine = (price <= self.budget + 1e-8) & (kcal <= self.calories + 1e-8) & (kcal >= self.calories * 0.75) & (total != 0) & (p > 0) & (price > 0)
        fine &= np.maximum(np.maximum(gaps[0], gaps[1]), gaps[2]) <= self.tolerance + 1e-8
        far, none = gaps[0] + gaps[1] + gaps[2], np.zeros(len(s), "i8")
        size = 1 + (a is not None) + (b is not None)
        first, second = (none if a is None else a + 1), (none if b is None else b + 1)
        rows = zip(-value[fine], far[fine], price[fine], s[fine] + 1, [size] * int(fine.sum()), first[fine], second[fine], map(tuple, sums[fine]), strict=True)
        self.best = heapq.nsmallest(self.k, [*self.best, *rows])

    def _least(self) -> float:
        """The value that a meal must reach to be one of the best so far."""
        return -self.best[-1][0] * (1 - 1e-12) if len(self.best) == self.k else 0.0

    def search(self) -> _Meals:
        n, m = len(self.staples), len(self.sides)
        self._take(np.arange(n))
        s, a = np.divmod(np.arange(n * m), max(m, 1))
        self._take(s, a)
        if m < 2:
            return self
        # the least that a later side can add to each form
        after = np.minimum.accumulate(self.side_forms[::-1])[::-1][1:]
        for s in range(n):
            least = self._least()
            gain = 100 * self.sides[:, 0] - least * self.sides[:, 4]  # a meal's value reaches `least` if its gains sum up to 0
            more = np.maximum.accumulate(gain[::-1])[::-1][1:]
            own = 100 * self.staples[s, 0] - least * self.staples[s, 4]
            left = self.limits - self.staple_forms[s] - self.side_forms[:-1]
            open_ = np.flatnonzero((after <= left).all(1) & (own + gain[:-1] + more >= -SLACK))
            if not len(open_):
                continue
            later = np.arange(m)[None, :] > open_[:, None]
            fits = later & (own + gain[open_][:, None] + gain[None, :] >= -SLACK)
            for form in range(len(self.limits)):
                fits &= self.side_forms[None, :, form] <= left[open_, form][:, None]
            i, b = np.nonzero(fits)
            self._take(np.full(len(i), s), open_[i], b)
        return self


def best_meals(ranked: DataFrame, k: int) -> DataFrame:
    """BEST: the best k meals of each request from its ranked candidates, and how many of all were tested (looked).

    A request's candidates are 120 rows at most. Single staples and pairs are tested first; they give the value that a
    meal has to reach. A staple and a side go on only if some later side could keep all linear limits (price, energy,
    each ratio) and reach that value, by the least that later sides add to each; then so must each third item itself.
    What is left is tested exactly, in the arithmetic of ``combinations``.
    """

    def search(group: pd.DataFrame) -> pd.DataFrame:
        request = {x: group[x].iloc[0] for x in REQUEST}
        parts = [group[group["category"] == kind].sort_values("rk") for kind in (STAPLE, SIDE)]
        staples, sides = (x[["p", "f", "c", "kcal", "price"]].to_numpy("f8") for x in parts)
        found = _Meals(staples, sides, request, k).search()
        items = [[{c: row[c] for c in ("id", "name", "price")} for row in x[["id", "name", "price"]].to_dict("records")] for x in parts]
        rows = []
        for rank, (_, _, _, s, size, a, b, sums) in enumerate(sorted(found.best), 1):
            chosen = [items[0][s - 1], *[items[1][x - 1] for x in (a, b) if x]]
            rows.append({**request, "items": chosen, "size": size, "s": s, "a": a, "b": b, **dict(zip(("p", "f", "c", "kcal", "price"), sums, strict=True)), "rank": rank, "looked": found.looked})
        return pd.DataFrame(rows, columns=[x.split()[0] for x in re.split(r", (?=\w+ )", BEST)])

    return ranked.groupBy("request_id").applyInPandas(search, BEST)


def lunch_options(catalog: DataFrame, requests: DataFrame, k: int = 5, most: int = 60) -> DataFrame:
    """The best k meals of each request, with their rank."""
    return best_meals(ranked_candidates(catalog, requests, most), k).drop("looked")
