"""Exact dedup over an extendible-hash index kept in shared files (operator 1).

Only DataFrame operations. Rows with equal text meet in map-side aggregation
first, so a text that fills a third of the table reaches its owner once per
task. The owner compares whole texts, byte by byte, as grouping keys. Entries
go to buckets of an extendible-hash directory: the directory doubles while a
bucket holds more bytes than allowed, buddies that still fit keep a smaller
local depth. Owner tasks take ranges of buckets, chain the entries whose keys
are equal though their texts are not, and write a folder for each bucket. A
lookup goes from a row's key by the directory's cell to its bucket, and finds
the key there. A split writes the entries of the split bucket and no others.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, new_folder

#: Bytes that an entry takes, that a bucket may hold, and of the buckets that an owner task takes.
ENTRY_BYTES, BUCKET_BYTES, OWNER_BYTES = 128, 4 << 20, 8 << 20
MAX_DEPTH = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _key(norm: Column, key_bits: int) -> Column:
    """The leading key_bits of the text's hash, ordered as an unsigned number would be."""
    h = F.xxhash64(norm)
    if key_bits < 64:
        h = F.shiftleft(h, 64 - key_bits)
    return h.bitwiseXOR(F.lit(-(2**63)))


def _prefix(key: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 64 - depth)


class Index(NamedTuple):
    """A folder for each bucket, the global depth, (cell, local_depth, bucket) of each used cell, and the entries."""

    path: str
    depth: int
    directory: DataFrame
    entries: DataFrame


def _bucket(prefix: Column, depth: Column) -> Column:
    """A bucket's name is its entries' shared bits, so it stays the same when the directory doubles."""
    bits = F.lpad(F.bin(prefix), MAX_DEPTH, "0")
    return F.concat(F.lit("b"), F.when(depth > 0, bits.substr(F.lit(MAX_DEPTH + 1) - depth, depth)).otherwise(""))


def directory(entries: DataFrame, bucket_bytes: int, max_depth: int) -> tuple[int, DataFrame]:
    """Double the directory until no bucket with several keys is overfull.

    Returns the global depth and (cell, local_depth, bucket): one row for each
    used cell of the directory.
    """
    total = entries.count() * ENTRY_BYTES
    depth = min(max_depth, max(0, (int(total) // bucket_bytes).bit_length()))
    while True:
        cells = entries.groupBy(_prefix(F.col("k"), depth).alias("cell")).agg((F.count(F.lit(1)) * ENTRY_BYTES).alias("weight"), F.min("k").alias("first"), F.max("k").alias("last"))
        full = cells.where((F.col("weight") > bucket_bytes) & (F.col("first") < F.col("last")))
        if depth == max_depth or full.isEmpty():
            break
        depth += 1
    # a cell's weight counts for its bucket at each smaller depth; the smallest depth at which it fits is the local one
    rolled = cells.select("cell", "weight", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    rolled = rolled.withColumn("p", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
    fits = rolled.groupBy("d", "p").agg(F.sum("weight").alias("w"), F.min("first").alias("f"), F.max("last").alias("l"))
    fits = fits.where((F.col("w") <= bucket_bytes) | (F.col("f") == F.col("l")) | (F.col("d") == depth)).select("d", "p")
    local = rolled.join(fits, ["d", "p"]).groupBy("cell").agg(F.min("d").alias("local_depth"))
    return depth, local.withColumn("bucket", _bucket(F.expr(f"shiftrightunsigned(cell, {depth} - local_depth)"), F.col("local_depth")))


def _placed(rows: DataFrame, depth: int, cells: DataFrame) -> DataFrame:
    """rows with a key k, and the bucket that the directory sends it to. On disk the directory's size is known, so the engine broadcasts it only if it is small."""
    return rows.withColumn("cell", _prefix(F.col("k"), depth)).join(cells.select("cell", "local_depth", "bucket"), "cell").drop("cell")


def _write(placed: DataFrame, path: str, n: int) -> None:
    """Owner tasks take ranges of buckets, as many bytes each, chain equal keys and write a folder for each bucket."""
    chain = Window.partitionBy("bucket", "k")
    owners = max(1, -(-n * ENTRY_BYTES // OWNER_BYTES))
    owned = placed.repartitionByRange(owners, "bucket", "k").select(
        "bucket", "k", "local_depth", "keep_id", "group_size", "text_sha256",
        F.row_number().over(chain.orderBy("text_sha256", "keep_id")).alias("chain_pos"),
        F.count(F.lit(1)).over(chain).alias("chain_len"),
    )
    owned.write.mode("append").partitionBy("bucket").parquet(path)


def _opened(spark, path: str) -> DataFrame:
    kinds = "k long, local_depth int, keep_id long, group_size long, text_sha256 string, chain_pos int, chain_len long, bucket string"
    return spark.read.schema(kinds).parquet(path)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> Index:
    """An entry for each distinct text, without the text: its key, bucket, place in its key's chain and verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    entries = rows.groupBy(_key(F.col("norm"), key_bits).alias("k"), "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = materialize(entries.select("k", "keep_id", "group_size", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256")), "entries")
    depth, cells = directory(entries, bucket_bytes, min(key_bits, MAX_DEPTH))
    cells, path = materialize(cells, "directory"), new_folder(docs.sparkSession, "index")
    _write(_placed(entries, depth, cells), path, entries.count())
    drop_table(entries)
    return Index(path, depth, cells, _opened(docs.sparkSession, path))


def split_overfull(index: Index, bucket_bytes: int) -> Index:
    """The index with buckets of bucket_bytes at most. Only the entries of buckets that hold more are written again."""
    spark = index.entries.sparkSession
    full = index.entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("f"), F.max("k").alias("l")).where(f"n * {ENTRY_BYTES} > {bucket_bytes} and f < l")
    full = materialize(full.select("bucket"), "full")
    moved = materialize(index.entries.join(full, "bucket", "left_semi").select("k", "keep_id", "group_size", "text_sha256"), "moved")
    if moved.isEmpty():
        return index
    depth, split = directory(moved, bucket_bytes, MAX_DEPTH)
    grown = max(depth, index.depth)
    by = F.expr(f"explode(sequence(0L, shiftleft(1L, {grown - index.depth}) - 1))")  # each old cell becomes as many as the directory has doubled
    stay = index.directory.join(full, "bucket", "left_anti").withColumn("_i", by).select((F.shiftleft("cell", grown - index.depth) + F.col("_i")).alias("cell"), "local_depth", "bucket")
    by = F.expr(f"explode(sequence(0L, shiftleft(1L, {grown - depth}) - 1))")
    split = split.withColumn("_i", by).select((F.shiftleft("cell", grown - depth) + F.col("_i")).alias("cell"), "local_depth", "bucket")
    cells = materialize(stay.union(split), "directory")
    _write(_placed(moved, grown, cells), index.path, moved.count())
    for r in full.toLocalIterator():  # the folders of the buckets that were split
        drop_table(_folder(index.entries, f"{index.path}/bucket={r['bucket']}"))
    drop_table(moved)
    return Index(index.path, grown, cells, _opened(spark, index.path))


def _folder(df: DataFrame, path: str) -> DataFrame:
    out = df.limit(0)
    out._querylens_path = path
    return out


def verdicts(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """Each row's verdict as the index has it: key, cell of the directory, bucket, entry."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("k", _key(F.col("norm"), key_bits))
    verdict = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"]
    # the owner has compared the bytes of all texts with this key: a chain of one needs no second look
    found = _placed(rows.select("doc_id", "k"), index.depth, index.directory).drop("local_depth")
    out = found.join(index.entries.where("chain_len = 1").select("bucket", "k", "keep_id", "group_size", "text_sha256"), ["bucket", "k"]).select(*verdict)
    chained = index.entries.where("chain_len > 1").select("bucket", "k", "keep_id", "group_size", "text_sha256")
    if chained.isEmpty():
        return out
    rows = rows.withColumn("text_sha256", F.sha2(F.encode("norm", "utf-8"), 256)).select("doc_id", "k", "text_sha256")
    return out.union(_placed(rows, index.depth, index.directory).join(chained, ["bucket", "k", "text_sha256"]).select(*verdict))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text
    counts as empty. Of equal texts the row with the largest doc_id stays. Rows
    that repeat the same doc_id and text are the same document and share its
    verdict; a null doc_id stays only by chance of no other (kept is false, its
    group's keep_id ignores it). Extra columns are not read. An empty table
    gives an empty result.
    """
    return verdicts(docs, build_index(docs, id_col, text_col, bucket_bytes, key_bits), id_col, text_col, key_bits)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns kept; those with a null id are left alone."""
    gone = exact_dedup(docs, id_col, text_col).where("doc_id is not null and not kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.encode(normalised(docs[text_col]), "utf-8"), 256)
    return docs.join(gone, (docs[id_col] == gone["doc_id"]) & (sha == gone["text_sha256"]), "left_anti")
