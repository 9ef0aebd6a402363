"""A Parquet store of bars, ticks and funding rates, in segments: one folder a frame, market, exchange and segment.

A read adds the segment bounds to the time bounds, so that folders outside the range aren't listed as input. A change touches the folders of
the segments it concerns and no others: what they become is written beside them, then each folder is swapped by renames. The old folders stay until the
change is kept for good, so a transaction can undo it, and `recover` puts back what a crash left between two renames.

Metadata (first and last time and count of each series in each segment) is a small table with the same folders, written by the same swap.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions.timeframe import HOUR, SECONDS, SEGMENT
from marketloom.operators import bars as bar_ops
from marketloom.operators import catalog

PARTS = ["time_frame", "market_type", "exchange_id", "segment"]
SERIES = ["market_type", "exchange_id", "symbol_id"]
DAY = 24 * HOUR
#: Columns of each kind; a provider of funding rates is an exchange.
KINDS = {
    "bars": f"{types.SERIES_KEY}, {types.MARKET_BAR}",
    "ticks": f"{types.SERIES_KEY}, seq long, {types.MARKET_TICK}",
    "funding": f"{types.SERIES_KEY}, time_ms long, funding_rate double, mark_price double, premium_index double, period_ms long",
}
FLAGS = {"bars": types.STORE_BARS, "ticks": types.STORE_TICKS, "funding": types.STORE_FUNDING}
META = "market_type int, exchange_id int, symbol_id int, time_frame string, segment long, start_ms long, end_ms long, count long"
OPTIONS = {"compression": {"zstd", "snappy", "gzip", "lz4", "none", "uncompressed"}, "read_only": {True, False}}


def duration(kind: str, frame: str) -> int:
    return SEGMENT[frame] if kind == "bars" else HOUR if kind == "ticks" else 30 * DAY


class Change:
    """A change that is done: `undo` puts the folders of before back, `keep` deletes them."""

    def __init__(self, undo: Callable[[], None], keep: Callable[[], None]):
        self.undo, self.keep = undo, keep


class Store:
    """One backend. flags: the kinds of data that it takes (types.STORE_*)."""

    def __init__(self, spark: SparkSession, root: str, name: str = "store", flags: int = types.STORE_BARS | types.STORE_TICKS | types.STORE_FUNDING, options: dict | None = None):
        self.spark, self.root, self.name, self.flags = spark, root.rstrip("/"), name, flags
        self.options = {"compression": "zstd", "read_only": False} | (options or {})
        if not self.root:
            raise ValueError("a store needs a folder")
        for k, v in self.options.items():
            if k not in OPTIONS or v not in OPTIONS[k]:
                raise ValueError(f"no option {k}={v}")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def exists(self, kind: str) -> bool:
        return self._there(self._place(kind))

    def _read(self, kind: str, schema: str, paths: Sequence[str] | None = None) -> DataFrame:
        place = self._place(kind)
        paths = [p for p in ([place] if paths is None else paths) if self._there(p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", place).parquet(*paths)

    def scan(self, kind: str, parts: Sequence[str] | None = None) -> DataFrame:
        """All that is held of a kind, or of some of its folders; an empty frame before the first write."""
        return self._read(kind, f"{KINDS[kind]}, time_frame string, segment long", None if parts is None else [f"{self._place(kind)}/{p}" for p in parts])

    def _folders(self, rows: DataFrame) -> list[str]:
        """Folders of the segments that rows are in; their number is that of segments, not of rows."""
        return sorted("/".join(f"{c}={r[c]}" for c in PARTS) for r in rows.select(*PARTS).distinct().collect())

    def _swap(self, kind: str, touched: list[str], rows: DataFrame | None) -> Change:
        """Makes the touched folders hold rows, and the metadata tell it."""
        if self.options["read_only"]:
            raise PermissionError(f"the store {self.name} is read only")
        mark = uuid.uuid4().hex
        staged, old = f"{self.root}/.staged-{mark}", f"{self.root}/.old-{mark}"
        if rows is not None:
            names = [c.split()[0] for c in KINDS[kind].split(", ")]
            out = rows.select(*names, "time_frame", "segment").repartition(*PARTS).sortWithinPartitions(*PARTS, "symbol_id", "time_ms")
            out.write.partitionBy(*PARTS).option("compression", self.options["compression"]).parquet(f"{staged}/{kind}")
            found = self.spark.read.schema(f"{KINDS[kind]}, time_frame string, segment long").parquet(f"{staged}/{kind}")
            meta = found.groupBy(*SERIES, "time_frame", "segment").agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), F.count("*").alias("count"))
            meta.repartition(*PARTS).write.partitionBy(*PARTS).parquet(f"{staged}/meta-{kind}")
        places = [f"{k}/{p}" for p in touched for k in (kind, f"meta-{kind}")]
        for p in places:
            self._rename(f"{self.root}/{p}", f"{old}/{p}")
            self._rename(f"{staged}/{p}", f"{self.root}/{p}")
        self._fs.delete(self._path(staged), True)
        self._refresh(kind)

        def undo() -> None:
            for p in places:
                self._fs.delete(self._path(f"{self.root}/{p}"), True)
            self._restore(old)

        return Change(undo, lambda: self._fs.delete(self._path(old), True))

    def _rename(self, source: str, target: str) -> None:
        """Does nothing where there is no source."""
        if self._there(source):
            self._fs.mkdirs(self._path(target).getParent())
            if not self._fs.rename(self._path(source), self._path(target)):
                raise OSError(f"{source} can't be renamed to {target}")

    def _refresh(self, kind: str) -> None:
        for k in (kind, f"meta-{kind}"):
            self.spark.catalog.refreshByPath(self._place(k))

    def _restore(self, old: str) -> None:
        """Folders under `old` go back to where nothing stands now; then `old` goes."""
        for kind in KINDS:
            for k in (kind, f"meta-{kind}"):
                found = self._fs.globStatus(self._path(f"{old}/{k}/*/*/*/*")) or []
                for x in found:
                    part = "/".join(x.getPath().toString().split("/")[-4:])
                    if not self._there(f"{self.root}/{k}/{part}"):
                        self._rename(x.getPath().toString(), f"{self.root}/{k}/{part}")
            self._refresh(kind)
        self._fs.delete(self._path(old), True)

    def recover(self) -> None:
        """Ends changes that a crash cut short: folders that were moved away and not replaced return, staged ones go. For a store that nobody is writing."""
        for pattern, end in ((".old-*", self._restore), (".staged-*", lambda p: self._fs.delete(self._path(p), True))):
            for x in self._fs.globStatus(self._path(f"{self.root}/{pattern}")) or []:
                end(x.getPath().toString())

    def write(self, kind: str, rows: DataFrame, frame: str) -> None:
        self.upsert(kind, rows, frame)

    def changed(self, kind: str, rows: DataFrame, frame: str) -> Change:
        """Replaces, in each segment, the series that rows has, or of funding rates those of equal time; all else of the segment stays. Bars
        must not stand before an earlier bar of their series by `seq`, if rows has it."""
        if not self.flags & FLAGS[kind]:
            raise ValueError(f"the store {self.name} takes no {kind}")
        if kind == "bars" and "seq" in rows.columns:
            if not bar_ops.out_of_order(rows, SERIES).where("out_of_order > 0").isEmpty():
                raise ValueError("bars aren't in order of time")
            rows = rows.drop("seq")
        names = [c.split()[0] for c in KINDS[kind].split(", ")]
        new = rows.select(*names, F.lit(frame).alias("time_frame"), bar_ops.segment_of("time_ms", duration(kind, frame)).alias("segment"))
        touched = self._folders(new)
        on = [*SERIES, "time_frame", "segment", *(["time_ms"] if kind == "funding" else [])]
        return self._swap(kind, touched, catalog.replace_segments(self.scan(kind, touched).select(*new.columns), new, on))

    def upsert(self, kind: str, rows: DataFrame, frame: str) -> None:
        self.changed(kind, rows, frame).keep()

    def read(self, kind: str, frame: str, start_ms: int, end_ms: int, market: int | None = None, exchange: int | None = None, symbol: int | None = None) -> DataFrame:
        """Rows of [start, end); bounds of segments, markets and exchanges prune folders, those of symbol and time row groups."""
        length = duration(kind, frame)
        rows = self.scan(kind).where(F.col("time_frame") == frame)
        rows = rows.where(F.col("segment").between(start_ms // length, (end_ms - 1) // length))
        rows = rows.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < end_ms))
        for name, value in zip(SERIES, (market, exchange, symbol), strict=True):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return rows

    def read_segment(self, kind: str, frame: str, segment: int, market: int, exchange: int, symbol: int) -> DataFrame:
        rows = self.scan(kind).where((F.col("time_frame") == frame) & (F.col("segment") == segment))
        return rows.where((F.col("market_type") == market) & (F.col("exchange_id") == exchange) & (F.col("symbol_id") == symbol))

    def segments(self, kind: str = "bars") -> DataFrame:
        """The kept metadata: one row a series, frame and segment."""
        return self._read(f"meta-{kind}", META)

    def metadata(self, kind: str = "bars") -> DataFrame:
        """One row a series and frame: first and last time, and count; from the kept metadata, without a scan of the data."""
        return self.segments(kind).groupBy("time_frame", *SERIES).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("count").alias("n"))

    def coverage(self, kind: str = "bars") -> DataFrame:
        """This store's row for routing, from the kept metadata."""
        sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in zip(SERIES, catalog.SETS)]
        bounds = (F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        return self.segments(kind).groupBy(F.lit(self.name).alias("store")).agg(F.lit(self.flags).cast("long").alias("data_flags"), *bounds, *sets)

    def erased(self, kind: str, frame: str | None = None, market: int | None = None, exchange: int | None = None, symbol: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> Change:
        """Deletes segments: all, or those of a frame, series and range. A segment that a range touches goes whole."""
        gone = F.lit(True)
        for name, value in (("time_frame", frame), ("market_type", market), ("exchange_id", exchange), ("symbol_id", symbol)):
            gone = gone if value is None else gone & (F.col(name) == value)
        if start_ms is not None or end_ms is not None:
            if frame is None:
                raise ValueError("a range needs a frame")
            length = duration(kind, frame)
            gone = gone if start_ms is None else gone & (F.col("segment") >= start_ms // length)
            gone = gone if end_ms is None else gone & (F.col("segment") <= (end_ms - 1) // length)
        return self._erased(kind, gone)

    def erase(self, kind: str, **what) -> None:
        self.erased(kind, **what).keep()

    def erase_by_metadata(self, kind: str, meta: dict) -> None:
        """Segments of any frame that touch the metadata's time range (0 is open), of its markets, exchanges and symbols."""
        start, end = meta.get("start_ms", 0), meta.get("end_ms", 0)
        gone = F.lit(True)
        for name, c in zip(catalog.SETS, SERIES):
            gone = gone & F.col(c).isin(*meta[name])
        length = F.lit(duration(kind, "UNKNOWN") if kind != "bars" else 0).cast("long")
        if kind == "bars":
            for f, n in SEGMENT.items():
                length = F.when(F.col("time_frame") == f, n).otherwise(length)
        if start:
            gone = gone & ((F.col("segment") + 1) * length > start)
        if end:
            gone = gone & (F.col("segment") * length < end)
        self._erased(kind, gone).keep()

    def _erased(self, kind: str, gone: Column) -> Change:
        """gone is a condition on a series and its segment. Folders without such a series aren't touched, those of nothing else are only moved away."""
        touched = self.segments(kind).groupBy(*PARTS).agg(F.max(gone).alias("some"), F.min(gone).alias("all")).where("some").collect()
        name = lambda r: "/".join(f"{c}={r[c]}" for c in PARTS)
        partly = sorted(name(r) for r in touched if not r["all"])
        stay = self.scan(kind, partly).where(~gone) if partly else None
        return self._swap(kind, sorted(map(name, touched)), stay)


class Transaction:
    """Staged changes over several stores: none is done before commit, which does them in turn. If one fails, those done before it are
    undone, last first; leaving the block without a commit drops all. Before and after hooks run around them.

    A step is any call; writes and erasures of stores and hubs, and calls that return a `Change`, can be undone.
    """

    def __init__(self, before: Sequence[Callable] = (), after: Sequence[Callable] = ()):
        self.before, self.after, self.pending, self.open = before, after, [], False

    def __enter__(self) -> Transaction:
        if self.open:
            raise RuntimeError("the transaction is open already")
        self.open, self.pending = True, []
        for f in self.before:
            f()
        return self

    def add(self, step: Callable, *args, **named) -> None:
        if not self.open:
            raise RuntimeError("no transaction is open")
        name = {"write": "changed", "upsert": "changed", "erase": "erased"}.get(getattr(step, "__name__", ""))
        if name and isinstance(getattr(step, "__self__", None), (Store, Hub)):
            step = getattr(step.__self__, name)  # the same change, which can be undone until it is kept
        self.pending.append((step, args, named))

    def commit(self) -> None:
        if not self.open:
            raise RuntimeError("no transaction is open")
        done: list[Change] = []
        try:
            for step, args, named in self.pending:
                made = step(*args, **named)
                if isinstance(made, Change):
                    done.append(made)
        except Exception:
            for change in reversed(done):
                change.undo()
            self.rollback()
            raise
        for change in done:
            change.keep()
        self.open, self.pending = False, []
        for f in self.after:
            f()

    def rollback(self) -> None:
        self.open, self.pending = False, []

    def __exit__(self, *_) -> None:
        self.rollback()


class Hub:
    """Several stores, asked in the order in which they were added; they are fixed once it has started."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stores, self.started = spark, [], False

    def add(self, store: Store) -> None:
        if self.started:
            raise RuntimeError("stores are added before start")
        self.stores.append(store)

    def start(self) -> None:
        if not self.stores:
            raise RuntimeError("no store was added")
        self.started = True

    def stop(self) -> None:
        self.started = False

    def is_connected(self) -> bool:
        return self.started

    def transaction(self) -> Transaction:
        if not self.started:
            raise RuntimeError("start the hub first")
        return Transaction()

    def metadata(self, kind: str = "bars") -> DataFrame:
        out = None
        for k, store in enumerate(self.stores):
            one = store.coverage(kind).withColumn("priority", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def read(self, kind: str, frame: str, start_ms: int, end_ms: int, **series) -> DataFrame:
        """The union over stores; of a segment of a series that several hold, the first store's rows."""
        key = ["market_type", "exchange_id", "symbol_id", "segment"]
        parts = [s.read(kind, frame, start_ms, end_ms, **series).withColumn("priority", F.lit(k)) for k, s in enumerate(self.stores) if s.flags & FLAGS[kind]]
        if not parts:
            raise ValueError("no store takes this kind of data")
        out = parts[0]
        if len(parts) == 1:
            return out.drop("priority")
        for p in parts[1:]:
            out = out.unionByName(p)
        best = out.groupBy(*key).agg(F.min("priority").alias("priority"))
        return out.join(best, [*key, "priority"], "left_semi").drop("priority")

    def changed(self, kind: str, rows: DataFrame, frame: str, store: str) -> Change:
        for s in self.stores:
            if s.name == store:
                return s.changed(kind, rows, frame)
        raise ValueError(f"no store {store}")

    def upsert(self, kind: str, rows: DataFrame, frame: str, store: str) -> None:
        self.changed(kind, rows, frame, store).keep()

    def erased(self, kind: str, **what) -> Change:
        done: list[Change] = []
        try:
            for s in self.stores:
                done.append(s.erased(kind, **what))
        except Exception:
            for change in reversed(done):
                change.undo()
            raise
        return Change(lambda: [c.undo() for c in reversed(done)], lambda: [c.keep() for c in done])

    def erase(self, kind: str, **what) -> None:
        self.erased(kind, **what).keep()


#: Store factories by backend name; further backends may be registered.
BACKENDS: dict[str, Callable[..., Store]] = {"PARQUET": Store}


def create(backend: str, spark: SparkSession, root: str, **options) -> Store:
    if backend not in BACKENDS:
        raise ValueError(f"no backend {backend}")
    return BACKENDS[backend](spark, root, **options)


def parameterised(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Prepared SQL over DataFrames: named parameters are bound, never pasted in."""
    return spark.sql(sql, args=args, **tables)


def sqlite_rows(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """files: path, content, of SQLite files; the rows of a read-only statement on each, a bounded batch at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                db.execute("PRAGMA query_only = ON")
                cursor = db.execute(sql)
                while rows := cursor.fetchmany(50_000):
                    yield pd.DataFrame(rows, columns=names)
                db.close()

    return files.mapInPandas(run, schema)


def sqlite_file(rows: DataFrame, table: str, group: str) -> DataFrame:
    """path, content: an SQLite file of each group's rows, whose columns it has; a group is one task's."""
    names = [c for c in rows.columns if c != group]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
        marks = ", ".join("?" * len(names))
        db.executemany(f"INSERT INTO {table} VALUES ({marks})", pdf[names].astype(object).itertuples(index=False))
        db.commit()
        return pd.DataFrame({"path": [f"{key[0]}.sqlite"], "content": [db.serialize()]})

    return rows.groupBy(group).applyInPandas(run, "path string, content binary")


def interval_frame(ms: int) -> str:
    """The frame of that many milliseconds."""
    for name, s in SECONDS.items():
        if s * 1000 == ms:
            return name
    return "UNKNOWN"
