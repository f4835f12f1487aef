"""Column functions: packed lists, vectors and array signals, all within the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ints(packed: Column) -> Column:
    """The integers of a ;-separated list; what isn't one is left out."""
    found = F.transform(F.split(packed, ";"), lambda x: F.trim(x).try_cast("int"))
    return F.filter(found, lambda x: x.isNotNull())


def truthy(flag: Column) -> Column:
    return F.lower(F.trim(flag.cast("string"))).isin("true", "1", "yes", "y")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda over an array refers to is otherwise worked out anew
    for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def rms(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a))


def square_integral(a: Column, fs: float) -> Column:
    return total(F.transform(a, lambda x: x * x)) / fs


def normalised(a: Column) -> Column:
    """Shares of the total; equal shares where that isn't above 0."""
    return once(a, lambda a: once(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(1.0 / F.size(a)))))


def entropy(shares: Column) -> Column:
    """Of shares, in units of the largest possible."""
    return -total(F.transform(shares, lambda p: p * F.ln(F.greatest(p, F.lit(1e-15))))) / F.ln(F.size(shares))


def js_distance(p: Column, q: Column, floor: float = 1e-15) -> Column:
    """Square root of the Jensen-Shannon divergence, natural logarithm, of two vectors taken as shares."""
    lift = lambda a: F.transform(a, lambda x: F.greatest(x, F.lit(floor)))
    p, q = normalised(lift(p)), normalised(lift(q))
    both = F.zip_with(p, q, lambda x, y: 0.5 * x * F.ln(2 * x / (x + y)) + 0.5 * y * F.ln(2 * y / (x + y)))
    return F.sqrt(F.greatest(total(both), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; 0 where one of them doesn't vary."""
    less = lambda a: once(mean(a), lambda m: F.transform(a, lambda x: x - m))
    def share(d: Column) -> Column:
        down = norm(d["a"]) * norm(d["b"])
        return F.when(down > 1e-12, total(F.zip_with(d["a"], d["b"], lambda x, y: x * y)) / down).otherwise(0.0)

    return once(F.struct(less(a).alias("a"), less(b).alias("b")), share)


def detrend(a: Column) -> Column:
    """The array less its least-squares line."""
    n = F.size(a)
    mid = (n - 1) / 2.0

    def less(m: Column) -> Column:
        num = total(F.transform(a, lambda x, i: (i - mid) * (x - m)))
        slope = F.when(n > 1, num / (n * (n * n - 1) / 12.0)).otherwise(0.0)
        return once(slope, lambda s: F.transform(a, lambda x, i: x - m - s * (i - mid)))

    return once(mean(a), less)


def frames_rms(a: Column, frames: int) -> Column:
    """RMS of equal frames; the samples that don't fill a frame are left out."""
    width = F.floor(F.size(a) / frames).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: rms(F.slice(a, k * width + 1, width)))


def temporal_concentration(a: Column, frames: int = 10) -> Column:
    """Largest frame RMS over their mean; 1 for arrays shorter than the frames."""
    share = once(frames_rms(a, frames), lambda r: F.array_max(r) / F.greatest(mean(r), F.lit(1e-20)))
    return F.when(F.size(a) >= frames, share).otherwise(1.0)


def window_rms(a: Column, width: int, step: int) -> Column:
    """RMS of every window of that width at every step."""
    starts = F.when(F.size(a) >= width, F.sequence(F.lit(1), F.size(a) - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: rms(F.slice(a, s, width)))


def kurtosis_pearson(a: Column) -> Column:
    """Bias-corrected, normal = 3; null under four samples or without variance."""
    n = F.size(a)
    power = lambda m, k: total(F.transform(a, lambda x: (x - m) * (x - m) if k == 2 else (x - m) * (x - m) * (x - m) * (x - m))) / n

    def corrected(m: Column) -> Column:
        m2, m4 = m["m2"], m["m4"]
        g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2)) - 3.0 * (n - 1)) + 3.0
        return F.when((n > 3) & (m2 > 0), g)

    return once(mean(a), lambda m: once(F.struct(power(m, 2).alias("m2"), power(m, 4).alias("m4")), corrected))


def interval_gap(s1: str, e1: str, s2: str, e2: str) -> Column:
    """0 where the intervals meet."""
    return F.greatest(F.lit(0), F.col(s2) - F.col(e1), F.col(s1) - F.col(e2))


def support_fraction(local: Column, other: Column, floor: float = 0.05) -> Column:
    """Share of local values above the others' median plus the larger of their 1.4826 MAD and the floor."""
    def middle(a: Column) -> Column:
        n = F.size(a)
        return once(F.sort_array(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    limit = lambda m: m + F.greatest(1.4826 * middle(F.transform(other, lambda x: F.abs(x - m))), F.lit(floor))
    above = lambda most: F.size(F.filter(local, lambda x: x > most))
    return once(middle(other), lambda m: once(limit(m), above)) / F.size(local)
