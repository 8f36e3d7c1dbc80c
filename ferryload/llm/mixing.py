"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Spark sums the tokens of each cell. Raking multiplies the cells by
target / actual of one marginal after the other until all marginals agree, which gives every cell the token weight it
should have. A document of a cell is drawn with a probability of at most 1: the cells are raked again for the wanted
number of tokens with that bound inside the rounds, so a scarce cell is taken whole and the others of its categories make
up for it. The number is the largest at which all marginals are met (to `most_miss`), so the sample has the targets as its
expected token shares. `least_keep` may ask for more tokens: scarce categories are then taken whole and miss their targets.

Every category of the data is a category of its marginal, with a target of its own; given targets may leave some to
"(other)". Only cells that have tokens are held: they are summed in Spark and raked on the driver, whose memory grows
with their number (some hundred bytes a cell), not with the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.llm.common import SPACE_PATTERN, Workspace, whole

OTHER = "(other)"
#: Cells up to which their rates are broadcast; beyond, Spark chooses the join.
SMALL_TABLE = 100_000
MARGINS = ["source", "lang", "topic"]


@dataclass(frozen=True)
class Mix:
    """smoothing: targets taken from data are proportional to tokens ** smoothing. keep: expected share of all tokens
    that is drawn; None draws as many as the targets allow, with a miss of at most `most_miss` in any category's share of
    the drawn tokens, but at least `least_keep`, for which targets are missed by more."""

    smoothing: float = 0.7
    keep: float | None = None
    least_keep: float = 0.75
    most_miss: float = 1e-8
    rounds: int = 500
    tolerance: float = 1e-10
    seed: int = 5


def token_count(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.size(F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    """Kind of a text by its form: table, notice (license lines), listing (many symbols), shout (mostly capitals) or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    symbols = size - F.length(F.translate(text, "#*$%&<>!", ""))
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (F.when(text.contains(" | "), "table").when(text.contains("icense"), "notice").when(symbols / size > 0.05, "listing")
            .when(capitals / size > 0.3, "shout").otherwise("prose"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; missing sources and languages are a category of their own."""
    text = whole("text")
    missing = lambda c: F.coalesce(F.col(c), F.lit("(none)")).alias(c)
    return docs.select("doc_id", missing("source"), missing("lang"), topic_of(text).alias("topic"), token_count(text).alias("n_tokens"))


def folded(rows: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Categories without a target of their own become OTHER."""
    out = rows
    for margin in MARGINS:
        names = [k for k in targets[margin] if k != OTHER]
        out = out.withColumn(f"_{margin}", F.when(F.col(margin).isin(names), F.col(margin)).otherwise(OTHER) if names else F.lit(OTHER))
    return out


def raked(tokens: np.ndarray, at: list[np.ndarray], shares: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Weights of total 1 of cells (tokens, category per margin) with the given marginals, as far as the missing cells allow.
    A category without tokens leaves its share to the others."""
    weights = tokens / max(tokens.sum(), 1)
    if not len(tokens):
        return weights
    wanted = []
    for i, share in zip(at, shares):
        there = np.where(np.bincount(i, tokens, len(share)) > 0, share, 0.0)
        wanted.append(there / there.sum() if there.sum() else there)
    for _ in range(rounds):
        worst = 0.0
        for i, share in zip(at, wanted):
            actual = np.bincount(i, weights, len(share))
            factor = np.divide(share, actual, out=np.zeros_like(actual), where=actual > 0)
            worst = max(worst, float(np.abs(actual - share).max(initial=0.0)))
            weights = weights * factor[i]
        if worst <= tolerance:
            break
    return weights


def rake(cells: np.ndarray, shares: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """The same of an array of tokens with one axis per margin."""
    out, at = np.zeros(cells.shape), np.nonzero(cells)
    out[at] = raked(cells[at], list(at), shares, rounds, tolerance)
    return out


def _filled(wanted: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Wanted tokens per category, none above what is there; the others get the rest in proportion."""
    out, total = np.minimum(wanted, there), wanted.sum()
    for _ in range(len(wanted)):
        short, below = total - out.sum(), (out < there) & (wanted > 0)
        if short <= 1e-12 * total or not below.any():
            break
        out[below] = np.minimum(there[below], out[below] * (1 + short / out[below].sum()))
    return out


def bounded(tokens: np.ndarray, at: tuple[np.ndarray, ...], weights: np.ndarray, keep: float, how: Mix) -> tuple[np.ndarray, float]:
    """Chances of cells (tokens, category per margin) for a share ``keep`` of all tokens with the marginals of the weights, raked
    with the bound of 1 inside the rounds: cells that are cut stay at 1 and the others of their category make up for
    them. Also the largest miss of a marginal's category, as a share of the drawn tokens."""
    total = tokens.sum()
    there = [np.bincount(i, tokens) for i in at]
    wanted = [np.bincount(i, weights) * keep * total for i in at]
    goals = [_filled(w, t) for w, t in zip(wanted, there)]
    start = ratio = weights * keep * total / tokens
    drawn = lambda i: np.bincount(i, np.minimum(1.0, ratio) * tokens)
    for _ in range(how.rounds):
        worst = 0.0
        for i, goal in zip(at, goals):
            now, free = drawn(i), np.bincount(i, np.where(ratio < 1, ratio, 0.0) * tokens)
            worst = max(worst, float(np.abs(now - goal).max()))
            less = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            more = 1 + np.divide(goal - now, free, out=np.zeros_like(now), where=free > 0)
            ratio = np.clip(ratio * np.where(now > goal, less, more)[i], start / 1e6, start * 1e6)  # finite if goals conflict
        if worst <= how.tolerance * keep * total:
            break
    miss = max(float(np.abs(drawn(i) - w).max()) for i, w in zip(at, wanted)) / (keep * total)
    return np.minimum(1.0, ratio), miss


def chances(tokens: np.ndarray, at: tuple[np.ndarray, ...], weights: np.ndarray, how: Mix) -> np.ndarray:
    """Chance of a document of each cell. Without ``how.keep`` the share that is drawn is the largest, to a thousandth, at
    which no marginal misses its share by more than ``most_miss``, and ``least_keep`` at least; beyond it they are met as far
    as the cells allow."""
    total = tokens.sum()
    if not weights.any():
        return np.zeros(len(tokens))
    if how.keep is not None:
        keep = how.keep
    else:
        keep = low = float(min(1.0, 1 / (weights * total / tokens).max()))  # no cell is cut
        high = 1.0
        if high > how.least_keep:
            ask = high
            while high - low > 0.001 * high:
                if bounded(tokens, at, weights, ask, how)[1] <= how.most_miss:
                    keep = low = ask
                else:
                    high = ask
                ask = (low + high) / 2
        keep = max(keep, how.least_keep)
    chance, _ = bounded(tokens, at, weights, keep, how)
    chance = chance * min(1.0, keep * total / max((chance * tokens).sum(), 1e-9))
    for _ in range(100):  # cells below 1 make up for what the marginals left open
        short = keep * total - (chance * tokens).sum()
        below = (chance < 1) & (weights > 0)
        room = (chance * tokens)[below].sum()
        if short <= 1e-9 * total or not room:
            break
        chance[below] = np.minimum(1.0, chance[below] * (1 + short / room))
    return chance


def probabilities(cells: np.ndarray, weights: np.ndarray, how: Mix) -> np.ndarray:
    """Chances as an array like ``cells``; 0 for cells without tokens."""
    out, at = np.zeros(cells.shape), np.nonzero(cells)
    if len(at[0]):
        out[at] = chances(cells[at], at, weights[at], how)
    return out


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, how: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    weight: wanted share of the tokens over the present share of the document's cell. kept: the document is drawn,
    by a hash of doc_id and seed, so equal ids are drawn alike and a rerun draws the same. Missing sources and languages
    are categories of their own; documents without words have no tokens and keep their cell's probability. targets: shares
    per category of source, lang and topic, with (other) for all that are not named; without them, smoothed shares of
    the data. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "mixing")
    rows = work.write(described(docs), "described")
    rows = folded(rows, targets) if targets else rows.withColumns({f"_{m}": F.col(m) for m in MARGINS})
    keys = [f"_{m}" for m in MARGINS]
    cells = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").orderBy(*keys).toPandas()
    tokens, at, shares = cells["tokens"].to_numpy(np.float64), [], []
    for margin, key in zip(MARGINS, keys):
        names, inverse = np.unique(cells[key].to_numpy(str), return_inverse=True)
        at.append(inverse)
        shares.append(np.array([targets[margin].get(k, 0.0) for k in names]) if targets else np.bincount(inverse, tokens, len(names)) ** how.smoothing)
    weights = raked(tokens, at, shares, how.rounds, how.tolerance)
    chance = chances(tokens, at, weights, how)
    table = cells[keys].assign(weight=weights * tokens.sum() / tokens, probability=chance)
    schema = ", ".join(f"{key} string" for key in keys) + ", weight double, probability double"
    rates = docs.sparkSession.createDataFrame(list(table.itertuples(index=False, name=None)), schema)
    rates = F.broadcast(rates) if len(table) <= SMALL_TABLE else rates
    joined = rows.join(rates, keys, "left")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(1 << 30)) / float(1 << 30)
    # a cell of documents without words has no weight and is not thinned
    chance_column = F.coalesce("probability", F.lit(1.0))
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"),
                         chance_column.alias("probability"), (drawn < chance_column).alias("kept"))


def draw(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, how: Mix = Mix()) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Rows that share a doc_id share a draw, but each by its own cell."""
    columns = docs.columns
    text = whole("text")
    key = F.struct("doc_id", F.coalesce("source", F.lit("(none)")), F.coalesce("lang", F.lit("(none)")), topic_of(text))
    kept = mixed(docs, targets, how).where("kept").select(F.struct("doc_id", "source", "lang", "topic").alias("_mix_key")).distinct()
    return docs.withColumn("_mix_key", key).join(kept, "_mix_key").select(*columns)
