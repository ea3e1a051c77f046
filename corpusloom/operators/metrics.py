"""Summaries of losses recorded while training and evaluating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import IGNORE_LABEL
from corpusloom.functions.scalars import perplexity
from corpusloom.operators.prefix import running_sums


def eval_summary(batch_losses: DataFrame, by: list[str]) -> DataFrame:
    """(by, eval_loss, perplexity): losses weighted by their number of predicted positions.

    A batch without that number counts once. A loss of NaN stays NaN.
    """
    weight = F.coalesce(F.col("num_masked").cast("bigint"), F.lit(1).cast("bigint"))
    loss = F.sum(F.col("loss") * weight) / F.greatest(F.sum(weight), F.lit(1).cast("bigint"))
    summed = batch_losses.groupBy(*by).agg(loss.alias("eval_loss"))
    if not by:
        summed = summed.select(F.coalesce("eval_loss", F.lit(float("nan"))).alias("eval_loss"))
    return summed.withColumn("perplexity", perplexity(F.col("eval_loss")))


def train_summary(steps: DataFrame, prior: DataFrame | None = None, by: str = "run") -> DataFrame:
    """(by, loss_steps, train_loss): the plain mean over all steps, those before a resume included.

    ``prior`` has (by, loss_sum, loss_steps, global_step). Older states lack
    the number of steps: then it is the global step if there is a sum, else 0.
    """
    now = steps.groupBy(by).agg(F.sum("loss").alias("loss_sum"), F.count("loss").alias("loss_steps"))
    if prior is not None:
        counted = F.when(F.col("loss_sum").isNotNull(), F.coalesce("global_step", F.lit(0))).otherwise(F.lit(0))
        restored = prior.select(
            by,
            F.coalesce("loss_sum", F.lit(0.0)).alias("loss_sum"),
            F.coalesce("loss_steps", counted).cast("bigint").alias("loss_steps"),
        )
        now = now.unionByName(restored).groupBy(by).agg(
            F.sum("loss_sum").alias("loss_sum"), F.sum("loss_steps").alias("loss_steps")
        )
    mean = F.col("loss_sum") / F.greatest("loss_steps", F.lit(1).cast("bigint"))
    return now.select(by, "loss_steps", mean.alias("train_loss"))


def running_loss(steps: DataFrame, by: str = "run", step: str = "step") -> DataFrame:
    """Adds ``mean_loss``, the mean of the run's losses so far; a long run is summed in blocks of steps."""
    ones = F.lit(1).cast("bigint")
    summed = running_sums(steps, step, {"loss_sum": F.col("loss"), "steps": ones}, by=[by], bits=12)
    mean = (F.col("before_loss_sum") + F.col("loss")) / (F.col("before_steps") + 1)
    return summed.select(*steps.columns, mean.alias("mean_loss"))


def logged_steps(steps: DataFrame, log_every: int, step: str = "step") -> DataFrame:
    return steps.where(F.pmod(step, F.lit(max(log_every, 1))) == 0)


def due_steps(steps: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Steps after which an evaluation or a saved state is due."""
    if every < 1:
        raise ValueError(f"every must be >= 1, got {every}")
    return steps.where(F.pmod(F.col(step) + 1, F.lit(every)) == 0)


def cross_entropy(logits: Column, label: Column) -> Column:
    """``logsumexp(logits) - logits[label]``, shifted by the maximum so that it can't overflow.

    A label outside the logits is an error.
    """
    values = logits.cast("array<double>")
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    outside = F.raise_error(F.format_string("Label %s is outside the logits", label.cast("string"))).cast("double")
    own = F.when((label >= 0) & (label < F.size(values)), F.get(values, label)).otherwise(outside)
    return top + F.log(total) - own


def masked_cross_entropy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, loss, num_masked) from rows (by, logits, label) or (by, logprob, label).

    Positions with the ignored label don't count; a batch without others has
    loss 0 and no number. Missing scores of a counted position are an error.
    """
    counts = F.col("label") != IGNORE_LABEL
    if "logits" in predictions.columns:
        score = cross_entropy(F.col("logits"), F.col("label"))
        given = F.col("logits").isNotNull()
    elif "logprob" in predictions.columns:
        score, given = -F.col("logprob"), F.col("logprob").isNotNull()
    else:
        raise ValueError("Predictions need a column of logits or of logprob")
    missing = F.raise_error(F.lit("Logits must not be null")).cast("double")
    per_position = F.when(counts, F.when(given, score).otherwise(missing))
    lost = predictions.select(*by, per_position.alias("loss"))
    return lost.groupBy(*by).agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"),
        F.nullif(F.count("loss"), F.lit(0)).cast("double").alias("num_masked"),
    )


def block_states(blocks: DataFrame, by: list[str]) -> DataFrame:
    """``(by, pos, top, total, own)`` per block of scores: its largest, the sum of ``exp(x - top)``, and the label's score if it has it.

    ``blocks`` holds rows ``(by, pos, first, logits, label)``: the scores of the
    classes from ``first`` on, and the position's label on each of its blocks.
    """
    values = F.col("logits").cast("array<double>")
    at = F.col("label") - F.col("first")
    missing = F.raise_error(F.lit("Logits must not be null")).cast("double")
    top = F.when(F.col("logits").isNull() | F.exists("logits", lambda x: x.isNull()), missing).otherwise(F.array_max(values))
    states = blocks.where(F.col("label") != IGNORE_LABEL).select(
        *by, "pos", "label", values.alias("values"), top.alias("top"), at.alias("at")
    )
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    own = F.when((F.col("at") >= 0) & (F.col("at") < F.size("values")), F.get("values", F.col("at").cast("int")))
    return states.where(F.col("values").isNull() | (F.size("values") > 0)).select(*by, "pos", "label", "top", total.alias("total"), own.alias("own"))


def merged_states(states: Column) -> Column:
    """One ``(top, total, own)`` from an array of them; merging is associative, so blocks may come in any order."""

    def merge(a: Column, b: Column) -> Column:
        top = F.greatest(a["top"], b["top"])
        total = a["total"] * F.exp(a["top"] - top) + b["total"] * F.exp(b["top"] - top)
        return F.struct(top.alias("top"), total.alias("total"), F.coalesce(a["own"], b["own"]).alias("own"))

    return F.aggregate(F.slice(states, 2, F.size(states)), F.get(states, F.lit(0)), merge)


def masked_cross_entropy_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """As ``masked_cross_entropy``, of scores that come in blocks of the vocabulary, each in its own row.

    A block is reduced to three numbers where it lies; only these are shuffled,
    and a position gathers as many as it has blocks. So no row ever holds the
    scores of a whole vocabulary. A counted position whose label is in none of
    its blocks is an error.
    """
    states = block_states(blocks, by)
    gathered = states.groupBy(*by, "pos", "label").agg(
        merged_states(F.sort_array(F.collect_list(F.struct("top", "total", "own")))).alias("s")
    )
    outside = F.raise_error(F.format_string("Label %s is outside the logits", F.col("label").cast("string"))).cast("double")
    lost = gathered.select(*by, (F.col("s.top") + F.log("s.total") - F.coalesce("s.own", outside)).alias("loss"))
    # Groups without a counted position have loss 0 and no number.
    groups = blocks.select(*by).distinct().join(lost.groupBy(*by).agg(F.avg("loss").alias("loss"), F.count("*").alias("n")), by, "left")
    return groups.select(
        *by, F.coalesce("loss", F.lit(0.0)).alias("loss"), F.col("n").cast("double").alias("num_masked")
    )
