"""Arrow batches of whole texts: one Python call per batch, bytes in, Arrow columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: ASCII letters to lower case, all other bytes below 0x80 but digits and letters to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Spark's limit on the rows of an Arrow batch.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark: SparkSession, rows: int) -> None:
    """From now on the session's Arrow batches have so many rows at most; a smaller limit of its own stays.

    A batch is held whole by the JVM, off its heap, and by the Python worker. The limit is read when a plan is
    executed, so it can't be taken back once a lazy result is returned; it changes no result.
    """
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def map_texts(
    df: DataFrame,
    factory: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    fields: str,
    keep: list[str] | None = None,
    text: str = "text",
    with_row: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """keep columns (all by default) plus the fields that the factory's function makes of the texts.

    The factory runs once per task; its function gets a batch's texts as UTF-8 bytes (null as
    None) and, if with_row names columns, their values as further lists. Fields must not clash
    with kept columns. rows limits the session's batches, where texts or what is made of them are large.
    """
    if rows is not None:
        limit_batches(df.sparkSession, rows)
    keep = df.columns if keep is None else keep
    extra = with_row or []
    names = list(dict.fromkeys([*keep, text, *extra]))
    src = df.select(*names)
    added = T._parse_datatype_string(fields)
    schema = T.StructType([src.schema[c] for c in keep] + list(added.fields))
    at, kept, more = names.index(text), [names.index(c) for c in keep], [names.index(c) for c in extra]
    out_names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for b in (x.slice(i, rows or len(x)) for x in batches for i in range(0, len(x), rows or len(x) or 1)):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            cols = fn(texts, *(b.column(i).to_pylist() for i in more))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + cols, names=out_names)

    return src.mapInArrow(run, schema)
