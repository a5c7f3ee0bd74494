"""Vectors as integers: the shared base of the vector codes and the centroid clustering.

A component x becomes floor(256 * x), taken in double precision.  So that sums of squared differences fit 64 bits,
integers are held within a bound that depends on the number of components (2 to the power of 27 for 64 of them,
that is components up to half a million); larger ones count as the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256


def bound(dims: int) -> int:
    """The largest integer with which ``dims`` squared differences still sum to less than 2 to the power of 63."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of a (rows, dims) array of finite doubles, within the bound."""
    most = float(bound(x.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -most, most).astype(np.int64)


def integer_rows(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) per vector length: the rows whose vector is neither null nor empty and has finite components only."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    low = int(offsets[0]) if len(offsets) else 0
    values = pc.cast(lists.values.slice(low, int(offsets[-1]) - low), pa.float64()).to_numpy(zero_copy_only=False)
    offsets = offsets - low
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # nulls have become NaN
    sizes = np.diff(offsets)
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == n))
        yield rows, to_integers(values[offsets[rows][:, None] + np.arange(n)])


def _smallest(k: int, wanted):
    def smallest(batches):
        held: dict[int, dict] = {}  # length -> {(key is null, key): least vector}
        kind = None
        for batch in batches:
            keys, kind = batch.column("key"), batch.schema.field("key").type
            order = pc.array_sort_indices(keys, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names = keys.to_pylist()
            for rows, ints in integer_rows(batch.column("x")):
                if not wanted(ints.shape[1]):
                    continue
                own = held.setdefault(ints.shape[1], {})
                for i in np.argsort(place[rows], kind="stable").tolist():
                    name = names[rows[i]]
                    key = (name is None, name if name is not None else 0)
                    if key in own:
                        own[key] = min(own[key], tuple(ints[i].tolist()))
                    elif len(own) < k:
                        own[key] = tuple(ints[i].tolist())
                    elif key < (last := max(own)):
                        del own[last]
                        own[key] = tuple(ints[i].tolist())
                    else:
                        break  # the keys still to come are larger
        found = [(n, key[1] if not key[0] else None, list(v)) for n, own in held.items() for key, v in own.items()]
        for low in range(0, len(found), 256):
            part = found[low: low + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], kind),
                 pa.array([p[2] for p in part], pa.list_(pa.int64()))], ["dims", "key", "v"])

    return smallest


def smallest_vectors(rows: DataFrame, k: int, wanted=lambda dims: True) -> dict[int, np.ndarray]:
    """{dims: (up to k, dims) integers}: per vector length that is ``wanted`` those with the ``k`` smallest different
    keys, in ascending order, null last; of rows that repeat a key the least vector.  ``rows``: key, x.

    Each task sends its own ``k`` only; what reaches the driver is bounded by ``k`` per length.
    """
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_smallest(k, wanted), f"dims int, key {kind}, v array<bigint>")
    first = Window.partitionBy("dims").orderBy(F.asc_nulls_last("key"))
    top = (found.groupBy("dims", "key").agg(F.min("v").alias("v"))
           .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))
    out: dict[int, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["dims"], r["rank"])):
        out.setdefault(r["dims"], []).append(r["v"])
    return {n: np.array(v, np.int64) for n, v in out.items()}
