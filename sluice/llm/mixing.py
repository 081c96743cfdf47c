"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their
marginals meet the targets within TOLERANCE; documents are then kept with the
probability that their cell's weight calls for.  Everything is DataFrame or SQL
expressions.  Documents are aggregated to cells first, so a source that holds a
third of them is as light as any other in the loop, and the raking works on the
cell table only, however many documents there are.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcore import cut, fresh

DIMENSIONS = ("source", "lang", "topic")
#: Sweeps between two writes of the cell table and tests of the marginals; sweeps at most, for
#: targets that the cells can't meet; the largest difference of a marginal share from its target.
BETWEEN, SWEEPS, TOLERANCE = 4, 60, 1e-9
#: Marginals that are named when some are off.
TOLD = 5
#: Cells up to this number are sent to all tasks for the last join; beyond it, the join shuffles.
BROADCAST_CELLS = 50_000
#: Share of all tokens to keep, and the exponent that tempers the present shares to default targets.
BUDGET, TEMPER = 0.5, 0.5
NONE = "(none)"


def token_count(text: Column) -> Column:
    """White-space words of a text; 0 for a null or empty one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """Topic by form: marked-up, listed, long, short or plain text."""
    body = F.coalesce(text, F.lit(""))
    gone = lambda marks: F.length(body) - F.length(F.translate(body, marks, ""))
    return (
        F.when(tokens == 0, "empty")
        .when(gone("|#$%*&<>{}") * 10 > tokens, "marked")
        .when(gone("\n") * 8 > tokens, "listed")
        .when(tokens >= 800, "long")
        .when(tokens < 120, "short")
        .otherwise("plain")
    )


def counted(docs: DataFrame, names: list[str], text: str = "text", topic: Column | None = None) -> DataFrame:
    """docs with the columns `names`: source, lang and topic (null counts as one value) and tokens.

    `topic` is any expression that names a document's topic, by default topic_of.
    """
    source, lang, topics, tokens = names
    out = docs.withColumn(tokens, token_count(F.col(text)))
    return out.withColumns({
        topics: F.coalesce(topic.cast("string"), F.lit(NONE)) if topic is not None else topic_of(F.col(text), F.col(tokens)),
        source: F.coalesce(F.col("source").cast("string"), F.lit(NONE)), lang: F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
    })


def cell_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, lang, topic, tokens, n_docs) of rows with the columns `names`."""
    return rows.groupBy(*(F.col(n).alias(d) for d, n in zip(DIMENSIONS, names))).agg(
        F.sum(names[3]).alias("tokens"), F.count(F.lit(1)).alias("n_docs")
    )


def _with_targets(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, temper: float) -> DataFrame:
    """Adds t_<dimension>, each value's target share; shares of present values sum to 1."""
    out = cells
    for d in DIMENSIONS:
        wanted = (targets or {}).get(d)
        each = Window.partitionBy(d)
        if wanted:
            pairs = [F.lit(x) for k, v in wanted.items() for x in (k, float(v))]
            share = F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(each).cast("double"), F.lit(temper))
        out = out.withColumn(f"t_{d}", share).withColumn(f"__n_{d}", F.count(F.lit(1)).over(each))
    # each value's share comes once for each of its cells, hence the division
    sums = out.agg(*(F.sum(F.col(f"t_{d}") / F.col(f"__n_{d}")).alias(d) for d in DIMENSIONS)).head()
    for d in DIMENSIONS:
        out = out.withColumn(f"t_{d}", F.col(f"t_{d}") / F.lit(sums[d]) if sums[d] else F.lit(0.0))
    return out.drop(*(f"__n_{d}" for d in DIMENSIONS))


def missed(cells: DataFrame) -> DataFrame:
    """(dimension, value, target, share, missed) of the raked cells: how far each marginal is off."""
    out = None
    total = F.sum("weight").over(Window.partitionBy())
    for d in DIMENSIONS:
        shares = cells.groupBy(F.col(d).alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum("weight").alias("weight"))
        part = shares.select(
            F.lit(d).alias("dimension"), "value", "target", F.when(total > 0, F.col("weight") / total).otherwise(0.0).alias("share")
        ).withColumn("missed", F.abs(F.col("share") - F.col("target")))
        out = part if out is None else out.union(part)
    return out


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, on_missed: str = "warn") -> DataFrame:
    """cells with t_<dimension> and `weight`, the raked share of tokens.

    Sweeps end when every marginal is within `tolerance` of its target, or when
    BETWEEN sweeps bring the worst one no nearer: then the cells can't serve all
    targets together.  Whatever ends them, marginals that are off are told: a
    warning with the worst ones, or an error with on_missed="error", or nothing
    with "ignore"; missed() has them all.  A target that no cell can serve is spread over the others in proportion.  Cells without tokens, or
    with a target of 0, get weight 0.
    """
    if on_missed not in ("warn", "error", "ignore"):
        raise ValueError("on_missed is warn, error or ignore")
    fitted = cut(_with_targets(cells, targets, temper).withColumn("weight", F.col("tokens").cast("double")))
    last, worst = float("inf"), 0.0
    for done in range(0, sweeps, BETWEEN):
        for _ in range(min(BETWEEN, sweeps - done)):
            for d in DIMENSIONS:
                marginal = F.sum("weight").over(Window.partitionBy(d))
                fitted = fitted.withColumn("weight", F.when(marginal > 0, F.col("weight") * F.col(f"t_{d}") / marginal).otherwise(0.0))
        fitted = cut(fitted)
        worst = missed(fitted).agg(F.max("missed")).head()[0] or 0.0
        if worst <= tolerance or worst > last * (1 - 1e-6):
            break
        last = worst
    if worst > tolerance and on_missed != "ignore":
        off = missed(fitted).orderBy(F.desc("missed"), "dimension", "value").limit(TOLD).collect()
        text = "targets that the cells don't meet: " + ", ".join(f"{r['dimension']} {r['value']} has {r['share']:.4g} of {r['target']:.4g}" for r in off if r["missed"] > tolerance)
        if on_missed == "error":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return fitted


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds `probability`: of keeping a document of the cell, at most 1.

    A cell wants scale * weight tokens; where that is more than it has it gives
    all, and the scale rises for the others until none of them is short, so
    that the expected tokens come to `budget` of all if the cells with weight
    can give as much.
    """
    total = cells.agg(F.sum("tokens").alias("n"), F.sum("weight").alias("w")).head()
    n, w = float(total["n"] or 0), float(total["w"] or 0)
    scale = budget * n / w if w else 0.0
    while scale > 0:  # each round but the last finds another short cell
        short = F.col("weight") * scale >= F.col("tokens")
        part = cells.agg(F.sum(F.when(short, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(short, 0.0).otherwise(F.col("weight"))).alias("rest")).head()
        rest = float(part["rest"] or 0)
        new = max(budget * n - float(part["full"] or 0), 0.0) / rest if rest > 0 else 0.0
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.withColumn(
        "probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens"))).otherwise(0.0)
    )


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id and the seed: 52 bits of an md5."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


MIXED = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")


def with_weights(rows: DataFrame, names: list[str], targets: Mapping[str, Mapping[str, float]] | None, budget: float, temper: float, seed: int, doc_id: str, on_missed: str = "warn") -> DataFrame:
    """rows, which have the columns `names` (see counted), with those of MIXED."""
    cells = cut(calibrate(rake(cut(cell_table(rows, names)), targets, temper, on_missed=on_missed), budget))
    total = cells.agg(F.sum("tokens")).head()[0] or 0
    small = cells.count() <= BROADCAST_CELLS
    keys = fresh(rows, *(f"__cell_{d}" for d in DIMENSIONS))
    side = cells.select(
        *(F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys)),
        F.when(F.col("tokens") > 0, F.col("weight") * float(total) / F.col("tokens")).otherwise(0.0).alias("mix_weight"),
        F.col("probability").alias("mix_probability"),
    )
    same = [F.col(n) == F.col(k) for n, k in zip(names, keys)]
    joined = rows.join(F.broadcast(side) if small else side, same[0] & same[1] & same[2], "left")
    return joined.withColumns({
        "mix_topic": F.col(names[2]), "mix_tokens": F.col(names[3]), "mix_kept": draw(F.col(doc_id), seed) < F.col("mix_probability"),
    }).drop(*keys)


def mix_sources(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, temper: float = TEMPER, seed: int = 5,
    text: str = "text", doc_id: str = "doc_id", topic: Column | None = None, on_missed: str = "warn",
) -> DataFrame:
    """docs with mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept.

    targets gives shares by value for any of source, lang and topic; a missing
    dimension is tempered: its present token shares to the power `temper`.
    `topic` is an expression over docs that names a document's topic (default:
    its form, see topic_of).  mix_weight is the raked weight of a token of the
    cell (1 on average).  Equal ids, null ones too, share a draw; nulls are
    values of their own; texts without a word have probability 0; an empty table
    stays empty.  Targets that the documents can't meet together are told as
    rake() says.  Existing columns of MIXED are replaced, all others pass,
    whatever their names.
    """
    rest = docs.drop(*MIXED)
    names = fresh(rest, "__source", "__lang", "__topic", "__tokens")
    found = with_weights(counted(rest, names, text, topic), names, targets, budget, temper, seed, doc_id, on_missed)
    return found.select(*rest.columns, *MIXED)


def op5_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    names = ["c_source", "c_lang", "c_topic", "c_tokens"]
    rows = cut(counted(docs, names).drop("text"))  # the texts are read once, and only their counts kept
    return with_weights(rows, names, None, BUDGET, TEMPER, 5, "doc_id").select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"),
        F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"),
    )
