"""What the operators of this subpackage share: reading, written intermediates, size-checked joins, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import staged

#: Words of the white-space kind, as a pattern for Java and for Python alike.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many bytes as written; above, Spark joins by key and splits hot keys.
BROADCAST_BYTES = 8 << 20
#: Rows, and bytes, that a worker turns into Python objects at once: long texts stay within its memory.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_SPACES = bytes(range(9, 14)) + b" "
#: Byte tables: A-Z become lower case; what separates words becomes a space.
LOWER_SPACE = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
KEEP_SPACE = bytes(32 if b in _SPACES else b for b in range(256))
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None, table: bytes) -> list[bytes]:
    """The words of a text after a byte table; bytes above 127 always belong to words."""
    return utf8(text).translate(table).split()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def word_count(text: str | Column) -> Column:
    """Words of a text, on the JVM; null has none."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


#: written(df, name): the rows written once to the shared folder and read again. Lineage ends there, so a lost executor costs no recomputation, and the optimiser knows the size.
written = staged


def written_bytes(df: DataFrame) -> int:
    """Bytes of a table from written()."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a table from written(): broadcast while its size is within the limit, else by key, where Spark splits hot keys."""
    return big.join(F.broadcast(small) if written_bytes(small) <= limit else small, on, how)


def pieces(batch: pa.RecordBatch, rows: int, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and bytes; a row that is larger stands alone."""
    todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_batches(df: DataFrame, schema: T.StructType | str, f: Callable[[pa.RecordBatch], dict], rows: int = ARROW_ROWS) -> DataFrame:
    """Rows in Arrow batches: f gives the columns that are new or changed, as lists or arrays; all others pass in Arrow's own form, so ids and
    columns of any type stay as they are. Under the key None, f may give which rows to keep. f sees pieces() of Spark's batches, which Spark bounds in bytes itself."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {field.name: field.type for field in to_arrow_schema(schema)}
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, rows):
                new = f(part)
                columns = [new[n] if isinstance(new.get(n), pa.Array) else pa.array(new[n], types[n]) if n in new else part.column(n) for n in names]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out.filter(pa.array(new[None], pa.bool_())) if None in new else out

    return df.mapInArrow(apply, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def kind(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3; rows of fold 1 are held out of every fit. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


#: A fit uses at most so many labelled rows (those first in order of a hash of their ids), each of at most so many characters, and so many together: what
#: the driver holds is bounded.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TOTAL = 4000, 50_000, 24_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels to fit on: labelled rows outside fold 1, one text for each id. The ids joined are at most `rows`, so they may be broadcast, and
    the window that adds up their characters sees no more than them."""
    known = labels.where(F.col(label).isNotNull() & (fold() != 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    some = some.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("total", F.sum(F.length("text")).over(Window.orderBy("h", "text")))
    found = some.where(F.col("total") <= TRAIN_TOTAL).select("text", "y", "h").collect()
    found.sort(key=lambda r: (r["h"], r["text"]))
    return [r["text"] for r in found], [int(r["y"]) for r in found]
