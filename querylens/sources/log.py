"""The stored log: encrypted payloads, decrypted and parsed with built-in functions; a SQLite source.

A token of the public Fernet layout is version 0x80, a time stamp, an IV, an
AES-128-CBC ciphertext and an HMAC-SHA256 of all that, in URL-safe base64.
"""

from __future__ import annotations

import base64
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The stored table and its columns.
TABLE = "benchmark_queries"
STORED = "id long, encrypted_query_data string, source string, result_count int, collected_on date"


def _keys(key: str) -> tuple[bytes, bytes]:
    raw = base64.urlsafe_b64decode(key)
    if len(raw) != 32:
        raise ValueError("a key has 32 bytes")
    return raw[:16], raw[16:]


def _hex(b: bytes) -> str:
    return f"unhex('{b.hex()}')"


def _mac(sign: bytes, message: str) -> str:
    inner, outer = (bytes(x ^ p for x in sign.ljust(64, b"\0")) for p in (0x36, 0x5C))
    return f"unhex(sha2(concat({_hex(outer)}, unhex(sha2(concat({_hex(inner)}, {message}), 256))), 256))"


def decrypted(token: str, key: str) -> Column:
    """The text of a token column; null for a token that this key did not sign."""
    sign, secret = _keys(key)
    raw = f"try_to_binary(translate({token}, '-_', '+/'), 'base64')"
    n = f"octet_length({raw})"
    good = f"{n} >= 73 and substring({raw}, 1, 1) = X'80' and {_mac(sign, f'substring({raw}, 1, {n} - 32)')} = substring({raw}, {n} - 31, 32)"
    plain = f"try_aes_decrypt(substring({raw}, 10, {n} - 41), {_hex(secret)}, 'CBC', 'PKCS')"
    return F.expr(f"case when {good} then try_validate_utf8(cast({plain} as string)) end")


def encrypted(text: str, key: str, iv: str) -> Column:
    """A token of a text column with an IV of 16 bytes, stamped with time 0. For tests and round trips."""
    sign, secret = _keys(key)
    body = f"concat(X'80', X'0000000000000000', aes_encrypt({text}, {_hex(secret)}, 'CBC', 'PKCS', {iv}))"
    return F.expr(f"translate(base64(concat({body}, {_mac(sign, body)})), '+/\\r\\n', '-_')")


def parsed(payload: str) -> Column:
    """struct(q, pkg) of a JSON payload; null unless it is an object with a string q. A missing list of packages is empty."""
    v = f"try_parse_json({payload})"
    q = f"try_variant_get({v}, '$.q', 'variant')"
    items = f"try_variant_get({v}, '$.pkg', 'array<string>')"
    return F.expr(f"case when schema_of_variant({q}) = 'STRING' then named_struct('q', try_variant_get({v}, '$.q', 'string'), 'pkg', coalesce({items}, cast(array() as array<string>))) end")


def load_log(stored: DataFrame, key: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, report) of stored rows: rows that do not decrypt are left out and counted. The date predicate reaches the source."""
    if since is not None:
        stored = stored.where(F.col("collected_on") >= F.lit(since).cast("date"))
    rows = stored.withColumn("_p", decrypted("encrypted_query_data", key)).withColumn("_p", parsed("_p"))
    log = rows.where("_p is not null").select(F.col("id").alias("row_id"), F.col("_p.q").alias("query"), F.col("_p.pkg").alias("packages"), "source", "result_count", "collected_on")
    report = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count("_p").alias("rows_loaded"), (F.count(F.lit(1)) - F.count("_p")).alias("rows_undecryptable"))
    return log, report


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of ids of one read-only database file on a shared file system; options: path, since, partitions."""

    def __init__(self, path: str, since: str | None, parts: int):
        self.path, self.since, self.parts = path, since, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            low, high = c.execute(f"select min(id), max(id) from {TABLE}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high + 1 - low) // self.parts)
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        import datetime

        sql = f"select id, encrypted_query_data, source, result_count, collected_on from {TABLE} where id >= ? and id < ?"
        args: list = [partition.low, partition.high]
        if self.since:
            sql, args = sql + " and collected_on >= ?", [*args, self.since]
        with self._open() as c:
            for i, token, source, n, day in c.execute(sql, args):
                yield i, token, source, n, datetime.date.fromisoformat(day)


class SqliteLog(DataSource):
    """spark.read.format("sqlite_log").option("path", file).load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_log"

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options.get("since"), int(self.options.get("partitions", "8")))


def read_sqlite(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteLog)
    reader = spark.read.format("sqlite_log")
    return (reader.option("since", since) if since else reader).load(path)
