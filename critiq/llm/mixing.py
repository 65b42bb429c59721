"""Mixing of sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
bisected (``POINTS`` trial values per pass over the table of sources) to the most even mix that
repeats no source more than a limit, or to a given entropy, beyond 1 if that is below the
entropy of the natural shares; a target that no exponent meets is an error. The token budget, by default the
least that draws the largest source once and so leaves out no document, times the weights
gives each source its tokens. They are realised as block permutations: a source's documents lie
in ``BLOCKS`` blocks by hash; each epoch has its own order of blocks and of rows inside blocks.
Whole epochs are taken, then a last epoch's blocks in order while they fit, and of the block at
the edge the rows in order while they fit. What a row needs to know is one line per source, so
rows never move: no window or group holds a source's rows but for the one block at the edge.

Tokens of a document are its words and one end mark. Defined results: null and empty texts have
one token. A null source is a source of its own. Rows of equal ids have equal places in every
order and come and go together. Empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import written

BLOCKS = 1024
POINTS = 31
PASSES = 6
MAX_REPEATS = 2.0


@dataclass
class Mix:
    """Exponent and the line per source: __source, target, epochs, edge, cut, whole."""

    exponent: float
    lines: DataFrame


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + F.lit(1)


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(BLOCKS)).cast("int")


def _block_order(block: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit("blocks"), epoch, block)


def _row_order(key: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit("rows"), epoch, key)


def solve_exponent(
    shares: DataFrame, budget_share: float | None, max_repeats: float | None, entropy: float | None
) -> float:
    """The exponent for a table of (share), by repeated division of the bracket.

    It lies in [0, 1], or above 1 where an entropy asks for it. Raises ``ValueError`` where no
    exponent meets the target.
    """
    low, high = 0.0, 1.0
    least, most = shares.agg(F.min("share"), F.max("share")).first()
    if least is None:
        return 1.0
    unit = most if entropy is not None else 1.0  # keeps high powers from vanishing

    def met(tried: np.ndarray, spare: float = 0.0) -> list[bool]:
        sums = []
        for x in tried:
            ratio = F.col("share") / F.lit(float(unit))
            power = F.pow(ratio, F.lit(float(x)))
            sums += [F.sum(power), F.sum(power * F.log(ratio))]
        row = shares.agg(*sums).first()
        fits = []
        for i, x in enumerate(tried):
            total, logs = row[2 * i], row[2 * i + 1]
            if entropy is not None:
                fits.append(np.log(total) - x * logs / total <= entropy + spare)
            else:
                budget = budget_share / total if budget_share else most ** (1.0 - x)
                fits.append(budget * least ** (x - 1.0) <= max_repeats + spare)
        return fits

    # At 1 all sources repeat alike; beyond it, the largest repeats more. Entropy falls on.
    reach = 2.0 ** np.arange(0, 1 if entropy is None else 60)
    first = next((i for i, f in enumerate(met(reach, 1e-9)) if f), None)
    if first is None:
        raise ValueError("no exponent meets the target of the mix")
    high = float(reach[first])
    low = high / 2 if first else 0.0
    for _ in range(PASSES):
        tried = np.linspace(low, high, POINTS + 2)
        fits = met(tried)
        # Both measures fall as the exponent grows: the first that fits ends the bracket.
        first = next((i for i, f in enumerate(fits) if f), len(tried) - 1)
        low, high = float(tried[max(0, first - 1)]), float(tried[first])
        if first == 0:
            break
    return high


def plan_mix(
    docs: DataFrame, budget_share: float | None = None, max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """What each source contributes to a budget of ``budget_share`` times all tokens.

    Without ``budget_share`` the largest source is drawn once, and so are all others at least.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    key = F.col("key")
    rows = written(docs.select(
        F.col(id_col).cast("string").alias("key"), F.col(source_col).alias("__source"),
        token_count(F.col(text_col)).cast("long").alias("tokens"),
    ))
    blocks = written(
        rows.groupBy("__source", _block(key).alias("block")).agg(F.sum("tokens").alias("tokens"))
    )
    sizes = blocks.groupBy("__source").agg(F.sum("tokens").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shares = sizes.withColumn("share", F.col("size") / F.lit(float(max(1, total))))
    exponent = solve_exponent(shares, budget_share, max_repeats, entropy)
    most = shares.agg(F.max("share")).first()[0] or 1.0
    ratio = F.col("share") / F.lit(most)  # keeps high powers from vanishing
    norm = shares.agg(F.sum(F.pow(ratio, F.lit(exponent)))).first()[0]
    repeats = F.pow(ratio, F.lit(exponent - 1.0))
    if budget_share and norm:
        repeats = repeats * F.lit(budget_share / (norm * most))
    target = F.floor(F.col("size") * repeats + 1e-6)
    lines = written(shares.select(
        "__source", "size", target.alias("target"),
        F.floor(target / F.col("size")).cast("int").alias("epochs"),
    ))
    last = F.col("epochs") + 1
    rest = F.col("target") - F.col("epochs") * F.col("size")
    same = blocks.withColumnRenamed("__source", "__of")
    order = Window.partitionBy("__of").orderBy("order").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    taken = (
        same.join(lines, F.col("__of").eqNullSafe(F.col("__source")))
        .withColumn("order", _block_order(F.col("block"), last))
        .withColumn("end", F.sum("tokens").over(order))
    )
    # The edge is the first block that doesn't fit as a whole.
    edges = taken.filter(F.col("end") > rest).groupBy("__of").agg(
        F.min("order").alias("edge"),
        F.min_by(rest - F.col("end") + F.col("tokens"), "order").alias("room"),
    )
    edges = written(
        lines.join(edges, F.col("__of").eqNullSafe(F.col("__source")), "left")
        .select("__source", "target", "epochs", "edge", "room")
    )
    at_edge = rows.withColumnRenamed("__source", "__of").join(
        edges, F.col("__of").eqNullSafe(F.col("__source"))
    ).filter(_block_order(_block(key), last) == F.col("edge"))
    inside = Window.partitionBy("__of").orderBy("row_order").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cuts = (
        at_edge.withColumn("row_order", _row_order(key, last))
        .withColumn("end", F.sum("tokens").over(inside)).filter(F.col("end") <= F.col("room"))
        .groupBy("__of").agg(F.max("row_order").alias("cut"))
    )
    lines = written(
        edges.join(cuts, F.col("__of").eqNullSafe(F.col("__source")), "left")
        .select("__source", "target", "epochs", "edge", "cut")
    )
    return Mix(exponent, lines)


def mixed_rows(
    docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Rows of ``docs`` once per epoch they are drawn in, with __epoch, __block and __row.

    Sorting by these three gives the order of the permutations.
    """
    key, last = F.col(id_col).cast("string"), F.col("__m.epochs") + 1
    order = _block_order(_block(key), last)
    drawn = (
        (order < F.col("__m.edge"))
        | ((order == F.col("__m.edge")) & (_row_order(key, last) <= F.col("__m.cut")))
    )
    copies = F.col("__m.epochs") + F.coalesce(drawn, F.lit(False)).cast("int")
    line = mix.lines.select(F.struct("*").alias("__m"))
    rows = docs.join(line, docs[f"`{source_col}`"].eqNullSafe(F.col("__m.__source")))
    rows = rows.filter(copies > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(1), copies)))
    return rows.drop("__m").withColumns({
        "__block": _block_order(_block(key), F.col("__epoch")),
        "__row": _row_order(key, F.col("__epoch")),
    })


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with rows repeated or left out to the mix; the columns are those of ``docs``."""
    rows = mixed_rows(docs, plan_mix(docs, **options))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
