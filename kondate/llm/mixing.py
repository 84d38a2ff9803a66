"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, join_by_key

MARGINS = ("source", "lang", "topic")
#: Share of a margin's value is its natural share to this power, before normalising: below 1 lifts the small ones.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.8}


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space in the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic class from the text alone: figures (3 % digits or more), brief, article or long."""
    text = F.coalesce(text, F.lit(""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    by_length = F.when(tokens < 200, "brief").when(tokens < 1500, "article").otherwise("long")
    return F.when((digits * 100 >= F.length(text) * 3) & (digits > 0), "figures").otherwise(by_length)


def with_margins(documents: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, _source, _lang, _topic, _tokens of the documents, and row, a struct of all their columns.

    A null source or language is one value with ''. topic: a column of labels, if the documents have better ones than
    ``topic_of``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("source", "lang")]
    given = F.lit(None).cast("string") if topic is None else topic.cast("string")
    rows = documents.select(whole, F.col("doc_id").cast("long").alias("doc_id"), *known, tokens_of(F.col("text")).alias("_tokens"), given.alias("_given"))
    return rows.withColumn("_topic", F.coalesce("_given", topic_of(F.col("row.text"), F.col("_tokens")))).drop("_given")


def natural_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """value, target: shares of a margin, flattened by a power; they add up to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.select("value", F.pow(F.col("t"), F.lit(power)).alias("w"))
    whole = raised.agg(F.sum("w")).first()[0] or 1.0
    return raised.select("value", (F.col("w") / F.lit(whole)).alias("target"))


#: Cells that are raked in one task; more are shuffled.
ONE_TASK_CELLS = 100_000


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Cells with weight and miss, scaled margin by margin until every margin's sum of weights is its target.

    cells: one row per combination of margins, with tokens; targets: margin to (value, target). Starts from the
    natural shares, so the weights are the closest to them that meet the targets. Stops when the largest relative
    miss is within the tolerance, when no weight moves any more, as margins that contradict each other never meet, or
    after `rounds`; miss says how far a cell's margins are off at the end. Values without a target and cells without tokens get weight 0. With a column cap no weight exceeds it: what a cell can't take goes
    to the open cells of its margins, so the weights end at the targets where any bounded ones meet them; cells with
    a column weight start from it. Each round is written, so lineage doesn't grow. Up to a counted
    bound the cells stay in one partition, which needs no shuffles; beyond it, each margin is a grouped sum and a join.
    """
    sums = cells.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    kept = [c for c in cells.columns if c not in ("weight", "cap", "miss")]
    start = F.col("weight") if "weight" in cells.columns else F.col("tokens") / F.lit(float(max(1, sums["t"] or 0)))
    cap = F.col("cap") if "cap" in cells.columns else F.lit(float("inf"))
    fitted = cells.select(*kept, F.least(start, cap).alias("weight"), cap.alias("cap"))
    for margin, wanted in targets.items():
        named = wanted.select(F.col("value").alias(margin), F.col("target").alias(f"_t_{margin}"))
        fitted = fitted.join(named, margin, "left").na.fill(0.0, [f"_t_{margin}"])
    small = sums["n"] <= ONE_TASK_CELLS
    fitted = scratch.table(fitted.coalesce(1) if small else fitted, "rake-0")
    for turn in range(1, rounds + 1):
        fitted = fitted.withColumn("_was", F.col("weight"))
        fitted = _round(fitted.coalesce(1), targets) if small else _shuffled_round(fitted, targets, scratch, turn)
        seen = Observation()
        moved = F.max(F.abs(F.col("weight") - F.col("_was"))).alias("moved")
        fitted = scratch.table(fitted.observe(seen, F.max("miss").alias("miss"), moved).drop("_was"), f"rake-{turn}")
        if (seen.get["miss"] or 0.0) <= tolerance or seen.get["moved"] <= tolerance / 10:
            break
        if turn < rounds:
            fitted = fitted.drop("miss")
    return fitted.select(*kept, "weight", "miss")


#: Grouped sums by margin: all weights, and those below their cap.
_SUMS = {"_sum": F.sum, "_open": lambda w: F.sum(F.when(w < F.col("cap"), w).otherwise(0.0))}


def _scaled(margin: str) -> Column:
    """Weights over their target are all scaled down; of those under it, only open ones can grow, up to their caps."""
    target = F.col(f"_t_{margin}")
    grown = F.coalesce(F.try_divide(target - F.col("_sum") + F.col("_open"), F.col("_open")), F.lit(1.0))
    shrunk = F.coalesce(F.try_divide(target, F.col("_sum")), F.lit(0.0))
    return F.least(F.col("cap"), F.col("weight") * F.when(target > F.col("_sum"), grown).otherwise(shrunk))


def _miss(margin: str) -> Column:
    return F.coalesce(F.abs(F.try_divide(F.col("_sum"), F.col(f"_t_{margin}")) - 1), F.lit(0.0))


def _round(fitted: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    for margin in targets:
        sums = {n: f(F.col("weight")).over(Window.partitionBy(margin)) for n, f in _SUMS.items()}
        fitted = fitted.withColumns(sums).withColumn("weight", _scaled(margin))
    miss = F.lit(0.0)
    for margin in targets:
        fitted = fitted.withColumn("_sum", F.sum("weight").over(Window.partitionBy(margin))).withColumn(f"_m_{margin}", _miss(margin))
        miss = F.greatest(miss, F.col(f"_m_{margin}"))
    return fitted.withColumn("miss", miss).drop(*_SUMS, *[f"_m_{m}" for m in targets])


def _shuffled_round(fitted: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch, turn: int) -> DataFrame:
    miss = F.lit(0.0)
    for i, margin in enumerate([*targets, *targets]):
        joined = fitted.join(fitted.groupBy(margin).agg(*[f(F.col("weight")).alias(n) for n, f in _SUMS.items()]), margin)
        if i < len(targets):
            fitted = scratch.table(joined.withColumn("weight", _scaled(margin)).drop(*_SUMS), f"rake-{turn}-{margin}")
        else:
            fitted = joined.withColumn(f"_m_{margin}", _miss(margin)).drop(*_SUMS)
            miss = F.greatest(miss, F.col(f"_m_{margin}"))
    return fitted.withColumn("miss", miss).drop(*[f"_m_{m}" for m in targets])


def bounded_targets(cells: DataFrame, margin: str, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """value, target: no more than the caps of a value's cells add up to; what it can't take goes to the others in proportion."""
    room = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("cap").alias("room"))
    both = scratch.table(targets.join(room, "value"), f"room-{margin}")
    factor = 1.0
    while True:
        full = F.col("target") * F.lit(factor) >= F.col("room")
        left = both.agg(F.sum(F.when(full, F.col("room"))).alias("full"), F.sum(F.when(~full, F.col("target"))).alias("open")).first()
        raised = (1.0 - (left["full"] or 0.0)) / left["open"] if left["open"] else factor
        if raised <= factor * (1 + 1e-9):
            return both.select("value", F.least(F.col("room"), F.col("target") * F.lit(factor)).alias("target"))
        factor = raised


def mixture(documents: DataFrame, fraction: float = 0.5, powers: Mapping[str, float] = POWERS, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The cells: _source, _lang, _topic, weight, probability, _miss, _cell_tokens, _documents.

    weight: the raked share without regard to how many tokens a cell has. probability: from weights raked again with
    no cell above probability 1, so that the expected tokens of a sample of `fraction` of all tokens follow the
    targets, as far as the cells have the tokens (``expected_margins`` gives the misses). _miss: how far the raked
    margins of the cell were from what they could reach when raking ended. No document is repeated.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    cells = documents.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents"))
    cells = scratch.table(cells, "cells")
    wanted = {m: scratch.table(natural_targets(cells, m, powers[m]), f"target-{m}") for m in MARGINS} if targets is None else targets
    size = fraction * (cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = rake(cells, wanted, scratch)
    cap = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(float(size))), F.lit(0.0))
    bounded = Scratch(documents.sparkSession, "mixing-bounded")
    capped = bounded.table(fitted.withColumns({"raked": F.col("weight"), "cap": cap}), "capped")
    most = {m: bounded_targets(capped, m, t, bounded) for m, t in wanted.items()}
    fitted = rake(capped, most, bounded)
    probability = F.when((F.col("tokens") > 0) & (F.col("weight") >= cap), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("weight"), cap), F.lit(0.0))))
    named = [F.col(m).alias(f"_{m}") for m in MARGINS]
    return bounded.table(fitted.select(*named, F.col("raked").alias("weight"), probability.alias("probability"), F.col("miss").alias("_miss"), F.col("tokens").alias("_cell_tokens"), F.col("documents").alias("_documents")), "mixture")


def expected_margins(cells: DataFrame, fraction: float, targets: Mapping[str, DataFrame]) -> DataFrame:
    """margin, value, target, expected (shares of the sample's size), miss (relative) of ``mixture``'s cells."""
    size = fraction * (cells.agg(F.sum("_cell_tokens")).first()[0] or 0)
    share = F.coalesce(F.try_divide(F.sum(F.col("probability") * F.col("_cell_tokens")), F.lit(float(size))), F.lit(0.0))
    parts = [targets[m].join(cells.groupBy(F.col(f"_{m}").alias("value")).agg(share.alias("expected")), "value").select(F.lit(m).alias("margin"), "value", "target", "expected") for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("miss", F.col("expected") / F.col("target") - 1)


def drawn(seed: int) -> Column:
    """A document's place in [0, 1), from its doc_id and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))


_CELL = [f"_{m}" for m in MARGINS]


def sample_decisions(documents: DataFrame, fraction: float = 0.5, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, miss, sampled of every row.

    weight: the cell's calibrated share of the tokens; miss: how far its margins were off when raking ended. Rows that
    repeat a doc_id are drawn alike if of one cell. Null sources and languages count as ''; texts without words have
    no tokens, and a cell of those only is never drawn. An empty table gives an empty result. Rows of large cells are
    joined by broadcast, those of the many small ones by shuffle.
    """
    scratch = Scratch(documents.sparkSession, "mixing-rows")
    rows = scratch.table(with_margins(documents, topic).select("doc_id", *_CELL, "_tokens"), "rows")
    joined = join_by_key(rows, mixture(rows, fraction), _CELL, "_documents")
    return joined.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "weight", "probability", F.col("_miss").alias("miss"), (drawn(seed) < F.col("probability")).alias("sampled"))


def sample_documents(documents: DataFrame, fraction: float = 0.5, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """The drawn documents, with their columns, whatever those are called. Texts are shuffled only in the small cells of very many."""
    rows = with_margins(documents, topic)
    narrow = Scratch(documents.sparkSession, "mixing-narrow").table(rows.select(*_CELL, "_tokens"), "rows")
    joined = join_by_key(rows.drop("_tokens"), mixture(narrow, fraction), _CELL, "_documents")
    return joined.where(drawn(seed) < F.col("probability")).select("row.*")
