"""Helpers the operators share: Arrow column functions, broadcasts, id and text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import tune

#: Most bytes of one broadcast. Larger inputs are cut into shards of this size.
BROADCAST_BYTES = 64 << 20
#: Rows turned into Python objects at once; Arrow batches are also bounded by bytes.
SLICE_ROWS = 512


def text_udf(make: Callable[[], Callable[[list], list]], schema: str, utf8: bool = False) -> Callable[..., Column]:
    """A column function over one text column, run on Arrow batches.

    ``make`` runs once per task and returns a function from a list of values to a list
    of results of type ``schema``. ``utf8`` hands the texts over as bytes. The result is
    marked non-deterministic so that it is computed once, however often it is used.
    A batch gives one array for each slice, and what a slice has freed goes back to the
    system: the Arrow pool of a worker would else keep several batches of whole texts.
    """
    arrow_type = to_arrow(schema)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            if utf8:
                batch = batch.cast(pa.binary())
            for at in range(0, max(1, len(batch)), SLICE_ROWS):
                yield pa.array(work(batch.slice(at, SLICE_ROWS).to_pylist()), arrow_type)
                pa.default_memory_pool().release_unused()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def to_arrow(schema: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_type(_parse_datatype_string(schema))


def once(broadcast: Any, key: str, build: Callable[[Any], Any]) -> Any:
    """An object built from a broadcast dictionary once per Python worker and kept there."""
    holder = broadcast.value
    if key not in holder:
        holder[key] = build(holder)
    return holder[key]


def share(spark: SparkSession, value: dict[str, Any], size: int, limit: int = BROADCAST_BYTES) -> Any:
    """Broadcast plain data after a check of its size in bytes."""
    if size > limit:
        raise ValueError(f"{size} bytes to broadcast, the bound is {limit}")
    return spark.sparkContext.broadcast(value)


class Generations:
    """What a worker remembers of strings: two generations, the older one is dropped."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def look_up(self, keys: set[str]) -> tuple[dict[str, Any], list[str]]:
        """The values that are known, and the keys that are not."""
        new, old = self.new, self.old
        found = {k: new[k] for k in keys if k in new}
        rest = [k for k in keys if k not in found] if len(found) < len(keys) else []
        again = {k: old[k] for k in rest if k in old}
        self.keep(again)
        return found | again, [k for k in rest if k not in again]

    def keep(self, values: dict[str, Any]) -> None:
        if len(self.new) + len(values) > self.limit:
            self.old, self.new = self.new, {}
        self.new.update(values)


def session(spark: SparkSession) -> SparkSession:
    """The options of the library, and Arrow batches of whole texts that a worker can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * SLICE_ROWS))
    return tune(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
