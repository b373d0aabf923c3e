"""Readers, renames, sized and verified writers, and the store of train/validation folds."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.files import entries, exists, remove


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session, as in tests, may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (at or "/tmp/checkpoints/tidemark").rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write df to the folder all executors share and read it back: cuts the lineage of iterations."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.staged_at)


def read_table(spark: SparkSession, *paths: str, schema: StructType | str | None = None, merge: bool = False) -> DataFrame:
    """Parquet, from one or several paths, with a declared schema or with the files' schemas merged."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def read_guarded(spark: SparkSession, path: str, few: tuple[int, ...] = (10_000, 1_000_000, 100_000_000), **kw) -> tuple[DataFrame, int]:
    """Parquet with its partition folders as columns, and its row count; warns of the smallest bound it falls below."""
    df = read_table(spark, path, **kw)
    rows = df.count()  # from the files' footers
    below = [b for b in few if rows < b]
    if below:
        warnings.warn(f"{path} has {rows} rows, fewer than {below[0]}", stacklevel=2)
    return df, rows


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", columns: tuple[str, ...] = (), infer: bool = False) -> DataFrame:
    """CSV with a header; strings unless a schema is given or types are inferred, which reads the file once more; optionally some columns only."""
    reader = spark.read.format("csv").option("header", True).option("sep", sep).option("inferSchema", infer and not schema)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(*columns) if columns else df


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Lines `node<TAB>{'neighbour': count, ...}` as (src, dst, weight)."""
    line = F.split("value", "\t")
    edges = F.from_json(F.replace(line[1], F.lit("'"), F.lit('"')), "map<string,bigint>")
    return spark.read.text(path).select(line[0].alias("src"), F.explode(edges).alias("dst", "weight"))


def from_values(spark: SparkSession, values: Iterable, schema: StructType | str) -> DataFrame:
    """A table of the driver's rows, or of plain values where the schema has one column."""
    rows = [v if isinstance(v, (tuple, list, dict)) else (v,) for v in values]
    return spark.createDataFrame(rows, schema)


def temporary_views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def collected(df: DataFrame, most: int = 100_000) -> list:
    """All rows on the driver; ValueError if there are more than `most`, of which no more than one too many is sent."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def lower_names(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else c.lower() for c in df.columns])


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Explicit names for the columns that exist, lower case for the rest unless that would clash."""
    taken = {mapping[c] for c in df.columns if c in mapping}
    return df.withColumnsRenamed({c: mapping.get(c, c.lower() if c.lower() not in taken else c) for c in df.columns})


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Drop the columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def as_strings(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def filled_columns(df: DataFrame, columns: tuple[str, ...] | None = None, least: float = 0.0) -> list[str]:
    """The columns whose share of values is above `least`, found in one pass over all rows."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    if not names:
        return []
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(c) for c in names]).first()
    return [c for c in names if row[c] > least * row["__n"]]


def duplicate_names(df: DataFrame) -> dict[str, list[str]]:
    """Names that differ in case alone, by their lower-case form."""
    by: dict[str, list[str]] = {}
    for c in df.columns:
        by.setdefault(c.lower(), []).append(c)
    return {k: v for k, v in by.items() if len(v) > 1}


def resolve_column(df: DataFrame, candidates: tuple[str, ...], part: str | None = None) -> str:
    """The first candidate that exists, else the first column holding `part`; ValueError if none."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    for low, c in have.items():
        if part and part in low:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")


def parts_for(rows: int) -> int:
    """How many files a table of so many rows is written to."""
    if rows < 1_000_000:
        return max(10, rows // 100_000)
    if rows < 10_000_000:
        return max(50, rows // 150_000)
    return min(max(rows // 200_000, 200), 500)


def write_sized(df: DataFrame, path: str, rows: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    out = df.repartition(parts_for(df.count() if rows is None else rows)).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_verified(df: DataFrame, path: str, critical: tuple[str, ...] = ()) -> DataFrame:
    """Write, read back, and insist on the row count and the critical columns."""
    rows = df.count()
    write_sized(df, path, rows)
    back = df.sparkSession.read.parquet(path)
    missing = [c for c in critical if c not in back.columns]
    if missing or back.count() != rows:
        raise ValueError(f"{path}: {missing or 'row count'} differs from what was written")
    return back


def write_adaptive(df: DataFrame, path: str, most: int = 500, to: int = 200, least: int = 10, up: int = 50) -> int:
    """Overwrite Parquet; more than `most` partitions are put together to `to`, fewer than `least` dealt to `up`.  Returns the partitions written."""
    n = df.rdd.getNumPartitions()
    out, n = (df.coalesce(to), to) if n > most else (df.repartition(up), up) if n < least else (df, n)
    out.write.mode("overwrite").parquet(path)
    return n


def write_shards(df: DataFrame, path: str, rows: int | None = None, each: int = 30_000, least: int = 2000, most: int = 8000) -> int:
    """Overwrite Parquet in shards of about `each` rows, between `least` and `most` of them, for training jobs that deal files to ranks."""
    rows = df.count() if rows is None else rows
    n = min(max(rows // each, least), most)
    df.repartition(n).write.mode("overwrite").parquet(path)
    return n


def table_size(df: DataFrame) -> dict[str, int]:
    """Rows, columns and bytes as Parquet, measured by a temporary write of the whole table."""
    kept = staged(df)
    try:
        size = sum(e["size"] for e in entries(df.sparkSession, kept.staged_at) if not e["folder"])
        return {"rows": kept.count(), "columns": len(df.columns), "bytes": size}
    finally:
        unstaged(kept)


def is_complete(spark: SparkSession, path: str, columns: tuple[str, ...], least: float = 0.97) -> bool:
    """The table exists and the columns are filled: what a resumed job may skip."""
    if not exists(spark, path):
        return False
    df = spark.read.parquet(path)
    if any(c not in df.columns for c in columns):
        return False
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns]).first()
    return row["__n"] > 0 and all(row[c] >= least * row["__n"] for c in columns)


@dataclass
class Fold:
    train: DataFrame
    held: DataFrame
    kind: str  # "VAL" or "TEST"


class FoldStore:
    """Folds as Parquet under `{root}/{source}_{version}{suffix}_FOLD_{i}_{TRAIN|VAL|TEST}.parquet`."""

    def __init__(self, spark: SparkSession, root: str, source: str = "DATA", suffix: str = ""):
        self.spark, self.root, self.source, self.suffix = spark, root, source, suffix

    def path(self, version: str, i: int, kind: str) -> str:
        return f"{self.root}/{self.source}_{version}{self.suffix}_FOLD_{i}_{kind}.parquet"

    def save(self, version: str, folds: list[Fold]) -> None:
        for i, f in enumerate(folds, 1):
            write_sized(f.train, self.path(version, i, "TRAIN"))
            write_sized(f.held, self.path(version, i, f.kind))

    def load(self, version: str) -> list[Fold]:
        """The folds of a version in order of their numbers, a hole in the numbering skipped; KeyError if it has none."""
        if version not in self.versions():
            raise KeyError(version)
        return [self.fold(version, i) for i in self.versions()[version]]

    def fold(self, version: str, i: int) -> Fold:
        kind = "VAL" if exists(self.spark, self.path(version, i, "VAL")) else "TEST"
        return Fold(*(read_table(self.spark, self.path(version, i, k), merge=True) for k in ("TRAIN", kind)), kind)

    def versions(self) -> dict[str, list[int]]:
        """Fold numbers of each version that has a training part under this root, source and suffix."""
        out: dict[str, list[int]] = {}
        for name in (e["name"] for e in entries(self.spark, self.root)) if exists(self.spark, self.root) else ():
            head, tail = f"{self.source}_", "_TRAIN.parquet"
            if name.startswith(head) and name.endswith(tail):
                version, mark, number = name[len(head) : -len(tail)].rpartition(f"{self.suffix}_FOLD_")
                if mark and number.isdigit():
                    out.setdefault(version, []).append(int(number))
        return {v: sorted(n) for v, n in sorted(out.items())}

    def load_all(self, wanted: Iterable[str]) -> dict[str, list[Fold]]:
        """The wanted versions that exist; what is missing is left out with a warning, any other fault is raised."""
        out = {}
        for v in wanted:
            try:
                out[v] = self.load(v)
            except KeyError:
                warnings.warn(f"no folds of version {v} under {self.root}", stacklevel=2)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                warnings.warn(f"folds of version {v} went while they were read", stacklevel=2)
        return out


def augment(store: FoldStore, version: str, suffix: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], expected: tuple[str, ...] = ()) -> list[int]:
    """Write each fold again with features that `fit` learns on its training part alone; returns the folds that were made.

    A fold is left as it is if both parts exist with the expected columns filled, so an interrupted job goes on where it
    stopped.
    """
    to, made = FoldStore(store.spark, store.root, store.source, store.suffix + suffix), []
    for i in store.versions().get(version, []):
        f = store.fold(version, i)
        paths = {k: to.path(version, i, k) for k in ("TRAIN", f.kind)}
        if all(is_complete(store.spark, p, expected) for p in paths.values()):
            continue
        transform = fit(f.train)
        write_sized(transform(f.train), paths["TRAIN"])
        write_sized(transform(f.held), paths[f.kind])
        made.append(i)
    return made


#: What messages of passing faults of a cluster hold.
PASSING = ("Connection reset", "Connection refused", "SocketTimeout", "TimeoutException", "ExecutorLost", "FetchFailed", "heartbeat", "temporarily unavailable", "Stage cancelled")


def retried(job: Callable[[], object], tries: int = 3, wait: float = 2.0, passing: tuple[str, ...] = PASSING, sleep: Callable[[float], None] = time.sleep) -> object:
    """The job's result; a passing fault is tried again after a wait that doubles, any other is raised at once."""
    for k in range(tries):
        try:
            return job()
        except Exception as e:
            if k + 1 == tries or not any(p in str(e) for p in passing):
                raise
            sleep(wait * 2**k)
    raise ValueError("tries is at least 1")
