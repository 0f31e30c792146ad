"""The store's operators over Parquet tables: keyset search, retention by anti-joins, versioned projections, idempotent jobs, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of severities in searches.
SEARCH_RANK = {"none": 0, "informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def keyset_page(df: DataFrame, sort: str, key: str, size: int = 50, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """The next page and one row more (which tells that another page follows): nulls last, ties by key. after: (sort value, key) of the last row.

    A filter that reaches the scan, then a top-k that needs no full sort."""
    s, k = F.col(sort), F.col(key)
    if after is not None:
        value, at = after
        beyond = s.isNull() & (k > at) if value is None else ((s < value) if descending else (s > value)) | ((s == value) & (k > at)) | s.isNull()
        df = df.where(beyond)
    return df.orderBy(s.desc_nulls_last() if descending else s.asc_nulls_last(), k.asc()).limit(size + 1)


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEARCH_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def expired(df: DataFrame, aged: Column, terminal: Column, protected: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows that are old and in a final state and that no protecting table names."""
    out = df.where(aged & terminal)
    for other, column in protected:
        out = out.join(other.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return out


def project_versions(state: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The next state (key, hash, version): version grows by one exactly where a document's content hash has changed; new keys begin at 1."""
    columns = sorted(c for c in documents.columns if c != key)
    now = documents.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("new_hash"))
    both = state.join(now, key, "full_outer")
    changed = F.col("new_hash").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("hash"))
    return both.select(key, F.coalesce("new_hash", "hash").alias("hash"), (F.coalesce("version", F.lit(0)) + changed.cast("int")).alias("version"), changed.alias("changed"))


def enqueue(outbox: DataFrame, messages: DataFrame, key: str = "dedup_key") -> DataFrame:
    """The outbox with the messages that it lacks; of messages with one key only one."""
    return outbox.unionByName(messages.dropDuplicates([key]).join(outbox.select(key), key, "left_anti").select(*outbox.columns))


def job_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def archive(df: DataFrame, path: str, time: str) -> DataFrame:
    """Writes gzipped JSON lines, reads them back and gives the manifest: rows, least and greatest time, and the sum of the rows' hashes, which row
    order doesn't change and in which repeated rows count."""
    df.write.json(path, compression="gzip")
    return manifest(df.sparkSession.read.schema(df.schema).json(path), time)


def manifest(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(time).alias("least"), F.max(time).alias("greatest"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def archive_faults(rows: DataFrame, time: str, told: DataFrame) -> DataFrame:
    """(item): what of a manifest an archive, as read, doesn't meet; no rows if it is whole."""
    items = ("n", "least", "greatest", "checksum")
    two = manifest(rows, time).select(*items, F.lit(0).alias("side")).unionByName(told.select(*items, F.lit(1).alias("side")))
    fault = [F.when(~F.min_by(i, "side").eqNullSafe(F.max_by(i, "side")), F.lit(i)) for i in items]
    return two.agg(F.array_compact(F.array(*fault)).alias("faults")).select(F.explode("faults").alias("item"))
