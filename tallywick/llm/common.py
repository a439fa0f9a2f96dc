"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import stage_path, staged

__all__ = ["stage_path", "staged"]

#: White space as the contracts define it: \x20 and \x09-\x0D. ``bytes.split()`` splits on exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to Python at once; texts can be long, so this is small.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, with underscores appended until no column of ``df`` has them (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def no_null_text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def values(column: pa.Array) -> list:
    """The column's values as Python objects; lists of numbers without nulls by way of numpy, which is ten times as fast."""
    if not pa.types.is_list(column.type) or not pa.types.is_integer(column.type.value_type) or column.null_count or column.values.null_count:
        return column.to_pylist()
    flat, ends = column.values.to_numpy(), column.offsets.to_pylist()
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def map_columns(df: DataFrame, inputs: list[Column], keep: Iterable[str], fields: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Apply a Python function to every row, in Arrow batches, beside the columns ``keep``.

    ``make()`` is called once a task and returns the function, which gets the values of ``inputs`` and
    returns one value for each of ``fields`` (a DDL string).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keep = list(keep)
    added = StructType.fromDDL(fields)
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for whole in batches:
            for batch in slices(whole):
                given = [values(batch.column(i)) for i in range(n_keep, batch.num_columns)]
                rows = [call(*x) for x in zip(*given, strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * len(added)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
                    + [pa.array(c, arrow.field(n_keep + i).type) for i, c in enumerate(columns)],
                    schema=arrow,
                )

    names = fresh(df.select(*keep), *[f"given{i}" for i in range(len(inputs))])
    return df.select(*keep, *[c.alias(n) for c, n in zip(inputs, names, strict=True)]).mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Iterable[str],
    fields: str,
    make: Callable[[], Callable[[bytes], tuple]],
    as_bytes: bool = True,
) -> DataFrame:
    """``map_columns`` of one column of texts, given as UTF-8 bytes or (``as_bytes`` false) as they are; null as empty."""
    empty: bytes | str = b"" if as_bytes else ""

    def guarded() -> Callable[..., tuple]:
        call = make()
        return lambda x: call(empty if x is None else x)

    return map_columns(df, [F.col(text).cast("binary") if as_bytes else F.col(text)], keep, fields, guarded)


#: Order of a row without an id: after all others.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with a key of two longs that orders its documents: the id (null last) and a hash of the text.

    Ids are whole numbers; others are an error. Rows that repeat both are the same document. A row without
    an id is hashed apart, so that it is not taken for one with the largest id.
    """
    kind = docs.schema[doc_id].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    did, hash_ = fresh(docs, "did", "hash")
    none = F.col(doc_id).isNull()
    return docs.withColumns({did: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), hash_: F.when(none, F.xxhash64(text, F.lit("no id"))).otherwise(F.xxhash64(text))}), did, hash_


def with_new_text(docs: DataFrame, text: str, removed: DataFrame, doc_id: str, make: Callable[[], Callable[[str, list[int] | None], tuple[str]]], n_removed: str | None = None) -> DataFrame:
    """``docs`` with parts of the texts removed: ``removed`` has (did, hash, places), one row a document at most.

    The rows of ``docs`` are joined on their key, so a text moves once; ``make()`` gives the function that
    builds a text without the places. With ``n_removed``, a column of that name has their number, in place
    of one that is there already.
    """
    rows, did, hash_ = keyed(docs, doc_id, text)
    places, new = fresh(rows, "places", "new")
    gone = removed.select(F.col("did").alias(did), F.col("hash").alias(hash_), F.col("places").alias(places))
    joined = rows.join(gone, [did, hash_], "left").withColumn(places, F.coalesce(places, F.array().cast("array<int>")))
    others = [c for c in docs.columns if n_removed is None or c.lower() != n_removed.lower()]
    keep = [c for c in others if c != text] + ([places] if n_removed else [])
    built = map_columns(joined, [F.col(text), F.col(places)], keep, f"{new} string", make)
    columns = [F.col(new).alias(text) if c == text else F.col(c) for c in others]
    return built.select(*columns, *([F.size(places).cast("long").alias(n_removed)] if n_removed else []))
