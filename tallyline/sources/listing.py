"""Incremental listing: pages from the newest on, read until one has nothing that isn't known.

The known ids, however many, are scanned once into a Bloom filter of bounded size: bit positions from hashes,
set in bitmaps by bucket with partial aggregation. Tasks that read a page look its entries up there; what the
filter doesn't have is new for certain, and only what it may have is compared with the known ids themselves.
Pages are read in growing groups, by partition, so files behind the page that stops the listing stay unread
but for the rest of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.session import let_workers_import, written

#: Bits of the filter (16 MB), and hashes of an id.
BITS, HASHES = 1 << 27, 4
#: Bits of one bitmap of Spark's, and ids up to which a group's are broadcast to the scan of the known ones.
BUCKET, MAX_BROADCAST = 32_768, 1_000_000


def positions(key: str, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits of an id."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(bits)) for k in range(hashes)))


def bloom(known: DataFrame, key: str, bits: int = BITS, hashes: int = HASHES) -> np.ndarray:
    """The filter of all known ids, a bit an element of bytes; its size doesn't depend on them."""
    at = known.where(F.col(key).isNotNull()).select(F.explode(positions(key, bits, hashes)).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = np.zeros((bits // BUCKET + 2, BUCKET // 8), np.uint8)
    for r in maps.collect():  # at most bits / BUCKET rows
        out[r["b"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def maybe_known(rows: DataFrame, key: str, filter_: np.ndarray, name: str = "maybe_known", bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """Add whether the filter may have the id: false is certain; a null id isn't known."""
    let_workers_import(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(filter_)
    asked = rows.withColumn("_at", F.transform(positions(key, bits, hashes), lambda p: F.struct(F.bitmap_bucket_number(p).alias("b"), F.bitmap_bit_position(p).alias("p"))))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])
    known = F.col(key).isNotNull().alias("_some")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").flatten()
            b, p = (at.field(k).to_numpy().astype(np.int64).reshape(-1, hashes) for k in (0, 1))
            hit = (shared.value[b, p // 8] >> (p % 8) & 1).all(1) & batch.column("_some").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hit)], schema=None, names=[*batch.schema.names[:-2], name])

    return asked.select(*rows.columns, "_at", known).mapInArrow(run, schema)


def new_entries(read: Callable[[int, int], DataFrame], pages: int, known: DataFrame, key: str, date: str | None = None, today: str | None = None, first: int = 4) -> tuple[DataFrame | None, int, int]:
    """(entries that aren't known, pages read, page that stopped it or -1), from page 0, the newest, on.

    read(a, b) gives the pages a to b, b left out, with their number as page. Entries dated after today are neither
    new nor do they stop the listing; nor does an empty page. The listing stops with the first page whose entries are
    all known, so entries on pages behind that one aren't looked for. A null id is new.
    """
    filter_, ids = bloom(known, key), known.select(F.col(key).alias("_known")).where(F.col("_known").isNotNull())
    low, size, found, stopped = 0, first, [], -1
    while low < pages and stopped < 0:
        high = min(pages, low + size)
        rows = read(low, high)
        if date and today:
            rows = rows.where(F.col(date).isNull() | (F.col(date) <= F.lit(today).cast("date")))
        group = written(maybe_known(rows, key, filter_, "_maybe"), "listed")
        asked = group.where("_maybe").select(F.col(key).alias("_known")).distinct()
        wanted = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
        have = written(ids.join(wanted, "_known", "left_semi").distinct(), "known")
        told = group.join(have.withColumn("_have", F.lit(True)), F.col(key) == F.col("_known"), "left").withColumn("_new", F.col("_have").isNull())
        sums = told.groupBy("page").agg(F.sum(F.col("_new").cast("int")).alias("new")).orderBy("page").collect()  # a row a page of the group
        stopped = next((r["page"] for r in sums if r["new"] == 0), -1)
        upto = F.lit(True) if stopped < 0 else F.col("page") < stopped
        found.append(told.where(F.col("_new") & upto).drop("_maybe", "_known", "_have", "_new"))
        low, size = high, 2 * size
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    return out, low, stopped
