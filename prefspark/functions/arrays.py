"""Per-token array expressions. Every function is row-local: no shuffle, no explode."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.scalars import bind, safe_div


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def masked_sum(values: Column, mask: Column) -> Column:
    return array_sum(mul(values, as_double(mask)))


def masked_mean(values: Column, mask: Column) -> Column:
    """Σ(x·m)/Σm; NULL for an all-zero mask."""
    return safe_div(masked_sum(values, mask), array_sum(as_double(mask)))


def masked_normalize(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Zero the masked cells, centre by the masked mean, scale by the masked deviation.

    Masked cells end as ``-mean * scale`` because centring follows the zeroing.
    """
    kept = mul(values, as_double(mask))

    def scaled(centred: Column) -> Column:
        deviation = F.sqrt(F.greatest(masked_mean(mul(centred, centred), mask), F.lit(eps)))
        return bind(deviation, lambda d: F.transform(centred, lambda x: x / d))

    centred = bind(masked_mean(kept, mask), lambda mean: F.transform(kept, lambda x: x - mean))
    return bind(centred, scaled)


def last_one_index(mask: Column) -> Column:
    """0-based index of the last cell equal to one; the last cell when there is none."""
    hit = F.array_position(F.reverse(mask), F.lit(1).cast("int"))
    return F.size(mask) - F.greatest(hit, F.lit(1)).cast("int")


def shift_left(a: Column, fill) -> Column:
    """Drop the first cell and append ``fill``; an empty array stays empty."""
    n = F.size(a)
    return F.when(n > 0, F.concat(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(fill)))).otherwise(a)


def cut(a: Column, n) -> Column:
    """First ``n`` elements."""
    return F.slice(a, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def drop_first(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def pad_to(a: Column, n, value, side: str = "right") -> Column:
    """Extend to ``n`` cells with ``value``; longer arrays are left alone."""
    n = n if isinstance(n, Column) else F.lit(n)
    fill = F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0)))
    if side == "right":
        return F.concat(a, fill)
    if side == "left":
        return F.concat(fill, a)
    raise ValueError(f"unknown padding side {side!r}")


def range_mask(n: Column, ranges: Column) -> Column:
    """``n`` cells, one inside the half-open ``start`` to ``end`` of ascending, disjoint ranges; other cells zero.

    Runs of zeros and ones laid end to end: linear in the cells, whatever the number of ranges.
    """

    def laid(r: Column) -> Column:
        ends = F.transform(r, lambda x: F.least(x["end"], n))
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(r))
        def run(x: Column, last: Column) -> Column:
            start, end = F.least(F.greatest(x["start"], last), n), F.least(x["end"], n)
            return F.concat(F.array_repeat(F.lit(0), start - last), F.array_repeat(F.lit(1), F.greatest(end - start, F.lit(0))))
        rest = n - F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        return F.concat(F.flatten(F.zip_with(r, before, run)), F.array_repeat(F.lit(0), rest))

    ints = F.transform(ranges, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    return bind(ints, laid)


def log_sum_exp(x: Column) -> Column:
    """ln Σ e^x with the maximum taken out."""
    return bind(
        F.array_max(x), lambda top: top + F.ln(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    )


def discounted_suffix(values: Column, decay: float) -> Column:
    """y_t = x_t + decay * y_{t+1} along each array.

    A suffix scan has no linear-time expression over higher-order functions (growing the output with
    ``concat`` is quadratic), so it runs on Arrow buffers: one NumPy step per token position for the
    whole batch.
    """

    @F.arrow_udf("array<double>")
    def scan(column: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=True)
        ends = np.cumsum(lengths)
        by_length = np.argsort(-lengths, kind="stable")
        last = (ends - 1)[by_length]
        longest = int(lengths.max()) if len(lengths) else 0
        # live[s] = number of arrays with more than s cells
        live = np.searchsorted(-lengths[by_length], -np.arange(longest), side="left")
        for s in range(1, longest):
            at = last[: live[s]] - s
            flat[at] += decay * flat[at + 1]
        offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=column.is_null() if column.null_count else None)

    return scan(values)
