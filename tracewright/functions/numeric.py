"""Numbers: schedules, scores, token log-probabilities and frame indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, 0.0 where ``d`` is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.when(d != 0, d))


def linear_factor(step: int, total: int, zero: float, full: float) -> float:
    """0 up to ``zero`` of all steps, 1 from ``full`` on, linear between."""
    if not 0 <= zero < full <= 1 or total <= 0 or step < 0 or int(step) != step:
        raise ValueError("need 0 <= zero < full <= 1, total > 0 and a whole step >= 0")
    return min(1.0, max(0.0, (step / total - zero) / (full - zero)))


def linear_factor_col(step: Column, total: int | Column, zero: float, full: float) -> Column:
    """The same for columns; ``total`` may be a number or a column."""
    linear_factor(0, 1 if isinstance(total, Column) else total, zero, full)
    of = total.cast("double") if isinstance(total, Column) else F.lit(float(total))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step / of - F.lit(zero)) / F.lit(full - zero)))


def phase(factor: Column) -> Column:
    return F.when(factor == 0.0, "zero").when(factor == 1.0, "full").otherwise("ramp")


def quality_reward(score: Column) -> Column:
    """Scores 1 to 3 as 0 to 1."""
    return (score - 1) / F.lit(2.0)


def grounding(text: Column, audio: Column, visual: Column) -> Column:
    """The mean of the three evidence labels; integration does not count."""
    return (text + audio + visual) / F.lit(3.0)


def mean_logprob(tokens: Column) -> Column:
    """``(mean, tokens)`` of an array of log-probabilities: nulls are skipped; any that is not finite makes the mean null."""
    known = F.filter(tokens, lambda x: x.isNotNull())
    finite = F.forall(known, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        F.when(finite & (F.size(known) > 0), total / F.when(F.size(known) > 0, F.size(known))).alias("mean"), F.greatest(F.size(tokens), F.lit(0)).alias("tokens")
    )


def frame_indices(total: Column, duration: Column, fps: float, most: int) -> Column:
    """Indices of frames spread evenly from first to last, halves rounded to even, each once."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), total, F.floor(duration * fps).cast("int")))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rint(i * (total - 1) / F.greatest(n - 1, F.lit(1))).cast("int"))
    return F.array_distinct(at)


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """``(percent, eta)``: whole percent done, and the seconds left at the speed so far."""
    eta = F.when(done > 0, F.floor((total - done) * elapsed / F.when(done > 0, done)))
    return F.struct(F.when(total > 0, F.floor(done * 100 / F.when(total > 0, total))).alias("percent"), eta.alias("eta"))


def first_finite(*values: Column) -> Column:
    """The first value that is a finite number."""
    known = [v.try_cast("double") if hasattr(v, "try_cast") else v.cast("double") for v in values]
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for v in known])
