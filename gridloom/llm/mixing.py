"""Mixing sources to target weights by iterative proportional fitting.

Token totals are gathered once per (source, language, topic) cell. The cell weights are then raked: scaled in turn
so that the sums per source, per language and per topic meet their targets, until all are met. A document is
expected in the sample as often as the ratio of its cell's raked weight to the cell's tokens says: the whole part as
repeats, the fraction as the probability of one more. The expected tokens then have exactly the raked marginals.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import attach, fits_broadcast, materialise

MARGINS = ("source", "lang", "topic")
# The term that marks each topic, in order of precedence.
TOPIC_TERMS = (("relation", "tion"), ("action", "ing"), ("state", "ung"), ("manner", "ment"), ("event", "ción"))
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-6  # relative gap between target and reached share at which raking ends
CYCLES = 10_000  # the most cycles, for targets that are approached ever more slowly
PATIENCE = 256  # cycles after which targets can count as contradictory
SMALL, SMALL_BYTES = 10_000, 2_000_000  # cells raked on the driver


def topic_of(text: Column, terms=TOPIC_TERMS) -> Column:
    """The topic whose term occurs most often in the whole text; the first of equals; ``other`` without any."""
    body = F.coalesce(text, F.lit(""))
    counts = [F.length(body) - F.length(F.replace(body, F.lit(t), F.lit(""))) for _, t in terms]
    counts = [(c / F.lit(len(t))).cast("bigint") for c, (_, t) in zip(counts, terms)]
    best = F.greatest(*counts)
    choice = F.when(best == 0, F.lit("other"))
    for (name, _), c in zip(terms, counts):
        choice = choice.when(c == best, F.lit(name))
    return choice


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def described(docs: DataFrame, text_col: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` with ``_mix_source``, ``_mix_lang``, ``_mix_topic`` and ``_mix_tokens``; nulls are a group of their own. Tokens that
    are not ``counted`` are 1 where a text has any, which a draw needs to know."""
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    text = F.col(f"`{text_col}`")
    return docs.select(
        "*", group("source").alias("_mix_source"), group("lang").alias("_mix_lang"), topic_of(text).alias("_mix_topic"),
        (tokens_of(text) if counted else F.coalesce(text.rlike(WORD), F.lit(False)).cast("bigint")).alias("_mix_tokens"),
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: token shares raised to ``power`` and normalised (1 keeps them, 0 levels them)."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("sum"))
    raised = sums.select(margin, F.when(F.col("sum") > 0, F.pow(F.col("sum").cast("double"), F.lit(float(power)))).otherwise(0.0).alias("raised"))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select(margin, (F.col("raised") / F.lit(total)).alias(f"target_{margin}"))


def _here(now: DataFrame, margins: list[str]):
    """Rake a small table on the driver: (cycle, finish). ``cycle`` scales once by all margins and returns the largest gap."""
    rows = now.collect()
    weight = np.array([float(r["tokens"] or 0) for r in rows])
    parts = []
    for m in margins:
        values = {v: i for i, v in enumerate(dict.fromkeys(r[m] for r in rows))}
        code, goal = np.array([values[r[m]] for r in rows], np.int64), np.zeros(len(values))
        goal[code] = [r[f"target_{m}"] or 0.0 for r in rows]
        goal[np.bincount(code, weight, len(values)) <= 0] = 0
        parts.append((code, goal))

    def cycle() -> float:
        nonlocal weight
        for code, goal in parts:
            sums = np.bincount(code, weight, len(goal))
            weight = weight * np.divide(goal, sums, out=np.zeros(len(goal)), where=sums > 0)[code]
        worst = 0.0
        for code, goal in parts:
            wanted, sums = goal > 0, np.bincount(code, weight, len(goal))
            if wanted.any():
                want, have = goal[wanted] / goal.sum(), sums[wanted] / (sums.sum() or 1.0)
                worst = max(worst, float(np.abs(have / want - 1).max()))
        return worst

    def finish() -> DataFrame:
        done = [tuple(float(w) if c == "weight" else r[c] for c in now.columns) for r, w in zip(rows, weight)]
        return materialise(now.sparkSession.createDataFrame(done, now.schema), "rake")

    return cycle, finish


def _written(now: DataFrame, margins: list[str]):
    """The same for a table of any size. A weight is the tokens times one factor per margin; a step sums the cells by one
    margin, map-side first, and writes that margin's new factors, a row per value. The cells stay as they are."""
    factors: dict[str, DataFrame] = {}

    def weighted(without: str | None = None) -> DataFrame:
        out, weight = now.drop("weight"), F.col("tokens").cast("double")
        for m, table in factors.items():
            if m != without:
                out = attach(out, table, m)
                weight = weight * F.col(f"factor_{m}")
        return out.withColumn("weight", weight).drop(*[f"factor_{m}" for m in factors])

    def cycle() -> float:
        worst = 0.0
        for m in margins:
            old = factors[m].select(m, F.col(f"factor_{m}").alias("old")) if m in factors else now.select(m, F.lit(1.0).alias("old")).distinct()
            sums = weighted(without=m).groupBy(m).agg(F.sum("weight").alias("sum"), F.coalesce(F.max(f"target_{m}"), F.lit(0.0)).alias("goal"))
            sums = materialise(sums.join(old, m), "rake-sums")
            want = F.when(F.col("sum") > 0, F.col("goal")).otherwise(0.0)
            totals = sums.agg(F.sum(F.col("sum") * F.col("old")).alias("have"), F.sum(want).alias("want")).first()
            if totals["have"] and totals["want"]:
                off = F.abs(F.col("sum") * F.col("old") / F.lit(totals["have"]) / (want / F.lit(totals["want"])) - 1)
                worst = max(worst, sums.where(want > 0).agg(F.max(off)).first()[0] or 0.0)
            factors[m] = materialise(sums.select(m, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias(f"factor_{m}")), "rake-factors")
        return worst

    return cycle, lambda: materialise(weighted().select(*now.columns), "rake")


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], cycles: int = CYCLES, tolerance: float = TOLERANCE, small: int = SMALL
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the raked share ``weight``.

    ``targets`` holds per margin a table of its values and ``target_<margin>``. A value without a target gets
    weight zero; a target for a value without tokens is not met, and the others are scaled to sum to one. Raking goes on
    until no value of any margin is off its target by more than ``tolerance`` (relative); a warning tells of targets that
    are not met because they contradict each other (``gaps`` shows where) or because ``cycles`` ended. Up to ``small``
    cells are raked on the driver, more as a table.
    """
    now = cells
    for margin, table in targets.items():
        now = now.join(table, margin, "left")
    now = materialise(now.withColumn("weight", F.col("tokens").cast("double")), "rake")
    cycle, finish = (_here if fits_broadcast(now, small, SMALL_BYTES) else _written)(now, list(targets))
    before, gap, k = float("inf"), 0.0, 0
    for k in range(1, cycles + 1):
        gap = cycle()
        if gap <= tolerance:
            return finish()
        if k >= PATIENCE and k & (k - 1) == 0:  # targets that agree come nearer with twice the cycles
            if gap > 0.99 * before:
                break
            before = gap
    warnings.warn(f"raking: a target is off by {gap:.2g} of itself after {k} cycles; mixing.gaps shows which", stacklevel=2)
    return finish()


def gaps(raked: DataFrame, margin: str) -> DataFrame:
    """Target and reached share of each value of a margin. Targets that contradict each other over the cells that have
    tokens cannot all be met; the margin scaled last is, and the others show here how far they are off."""
    total = raked.agg(F.sum("weight")).first()[0] or 1.0
    return raked.groupBy(margin).agg(F.max(f"target_{margin}").alias("target"), (F.sum("weight") / F.lit(total)).alias("reached"))


def cell_copies(raked: DataFrame, rate: float, repeats: bool = True) -> DataFrame:
    """``expected``: how many copies of a document of each cell the sample should hold, weight over tokens, such that the
    sample has ``rate`` of all tokens. Without ``repeats`` no cell may exceed one copy: all are scaled down until the
    densest cell has one, which keeps the margins and may leave fewer tokens than ``rate``."""
    ratio = F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.col("weight") / F.col("tokens")).otherwise(0.0)
    rates = raked.withColumn("ratio", ratio)
    top, mass, tokens = rates.agg(F.max("ratio"), F.sum("weight"), F.sum("tokens")).first()
    scale = (rate * tokens / mass if repeats else min(1.0 / top, rate * tokens / mass)) if top else 0.0
    expected = F.col("ratio") * F.lit(scale)
    return materialise(rates.select(*MARGINS, "weight", (expected if repeats else F.least(F.lit(1.0), expected)).alias("expected")), "mixture")


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the identifier and the seed alone, so a repeated run draws the same rows."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", powers: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None, rate: float = 1.0, repeats: bool = True, cycles: int = CYCLES, seed: int = 0,
) -> DataFrame:
    """``docs`` with ``topic, tokens, weight, expected, copies`` appended (columns of these names are replaced).

    Targets default to tempered shares (``powers``, 0.7 for each margin). ``expected`` is the calibrated number of copies:
    the sample holds ``rate`` of all tokens, with the raked shares. Its whole part is taken for certain and its fraction is
    the probability of one more, so ``copies`` is 0 for documents left out, and 2 or more for repeats. Without
    ``repeats`` it is a plain probability, and the densest cell bounds how much of the corpus a sample can hold.

    Documents without tokens have no copies. Null sources and languages form groups of their own; rows that repeat an
    identifier are drawn together; an empty table gives an empty result.
    """
    return _mixed(described(docs, text_col), docs.columns, id_col, powers, targets, rate, repeats, cycles, seed)


def _mixed(full: DataFrame, columns, id_col: str, powers=None, targets=None, rate=1.0, repeats=True, cycles=CYCLES, seed=0, drawn: DataFrame | None = None) -> DataFrame:
    """``mix`` of documents that are described; of their own columns those in ``columns`` are kept. ``drawn``: the same documents,
    described without a count, from which is drawn."""
    powers = powers or {m: 0.7 for m in MARGINS}
    added = ("topic", "tokens", "weight", "expected", "copies")
    own = [c for c in columns if c not in added]
    slim = full.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"), F.col("_mix_topic").alias("topic"))
    cells = materialise(slim.agg(F.sum("_mix_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or {m: tempered(cells, m, powers[m]) for m in MARGINS}, cycles)
    chances = cell_copies(raked, rate, repeats).select(
        *[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("weight").alias("_mix_weight"), F.col("expected").alias("_mix_expected"))
    out = attach(full if drawn is None else drawn, chances, ["_mix_source", "_mix_lang", "_mix_topic"], "left")
    expected = F.when(F.col("_mix_tokens") > 0, F.coalesce(F.col("_mix_expected"), F.lit(0.0))).otherwise(0.0)
    whole = F.floor(expected)
    return out.select(
        *[F.col(f"`{c}`") for c in own], F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("tokens"),
        F.coalesce(F.col("_mix_weight"), F.lit(0.0)).alias("weight"), expected.alias("expected"),
        (whole + (draw(id_col, seed) < expected - whole).cast("bigint")).alias("copies"),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, columns unchanged, each as often as it was drawn.

    Words are counted for the totals alone; the draw asks only whether a text has any.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row")
    slim = docs.select(whole, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), "source", "lang")
    mixed = _mixed(described(slim), ["_mix_row", "id"], "id", **options, drawn=described(slim, counted=False)).where("copies > 0")
    return mixed.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_mix_row.*")
