"""Keyed tables that grow by batches: logs of sorted runs, with a Bloom filter of their keys.

A batch is written as one run, in proportion to itself: one row per key, in files that are
buckets by the hash of the key, each sorted by key. Reading takes the winning row of each key over all runs. Runs of one level are
merged into one of the next when there are `fan` of them, so each row is rewritten only a few
times, and at most `fan` runs a level are read. A run counts when it has its name, which is given
to a finished folder; runs that a merged one covers are left for `vacuum`.

One writer at a time may append to a log; readers may read meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.session import stage

# Bits of a partition of the filter, as Spark's bitmap functions make them.
_BITS = 32768
_PROBES = 4
_RUN, _SEQ, _ABOUT = "run-", "_seq", "about.json"


@dataclass(frozen=True)
class Run:
    """A finished run: the batches `first` to `last`, merged `level` times."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{_RUN}{self.level}-{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


@dataclass(frozen=True)
class KeyedLog:
    """A log at `path` with rows of `schema`, one per `keys`.

    With `keep="last"` a key's row is the one with the greatest `order` values, and of equal ones
    that of the latest batch; with `keep="first"` it is that of the earliest batch, the least by
    `order` in it. Of rows that are equal in all this, the least counts. Columns must have an order.
    Null keys are keys. Runs of `filter_from` keys or more have a filter with `bits` a key; smaller
    ones are asked exactly, and all of them where it is None.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    keep: str = "last"
    fan: int = 8
    bits: int = 16
    filter_from: int | None = 100_000

    def __post_init__(self) -> None:
        if self.keep not in ("first", "last"):
            raise ValueError(f"keep is first or last, not {self.keep}")

    # -- files

    def _files(self, spark: SparkSession):
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _all_runs(self, spark: SparkSession) -> list[Run]:
        fs, make = self._files(spark)
        found = fs.globStatus(make(f"{self.path}/{_RUN}*")) or []
        return [Run(*map(int, f.getPath().getName()[len(_RUN) :].split("-"))) for f in found]

    def runs(self, spark: SparkSession) -> list[Run]:
        """Runs that count, the one with the oldest and most rows first."""
        found = self._all_runs(spark)
        live = [r for r in found if not any(other.covers(r) for other in found)]
        return sorted(live, key=lambda r: (-r.level, r.first))

    def exists(self, spark: SparkSession) -> bool:
        return bool(self._all_runs(spark))

    # -- writing

    def append(self, batch: DataFrame, unique: bool = False) -> Run | None:
        """Write a batch as a run (none for an empty one), then merge runs where it is time.
        `unique`: the batch is known to have one row per key."""
        spark = batch.sparkSession
        number = max((r.last for r in self._all_runs(spark)), default=-1) + 1
        run = Run(0, number, number)
        rows = batch.select(*self.schema.fieldNames())
        rest = [c for c in self.schema.fieldNames() if c not in (*self.keys, *self.order)]
        if unique:
            rows = rows.repartition(*self.keys)
        elif rest:
            groups = rows.groupBy(*self.keys, *self.order).agg(F.min(F.struct(*rest)).alias("_rest"))
            rows = groups.select(*self.keys, *self.order, "_rest.*")
        numbered = rows.withColumn(_SEQ, F.lit(number).cast("bigint"))
        single = unique or (rest and not self.order)
        if not self._write(numbered if single else self._winners(numbered), run):
            return None
        self.compact(spark)
        return run

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row per key. Rows of one key are told apart by order and batch."""
        rest = [c for c in (*self.schema.fieldNames(), _SEQ) if c not in self.keys]
        if self.keep == "last":
            row = F.max_by(F.struct(*rest), F.struct(*self.order, _SEQ))
        else:
            row = F.min_by(F.struct(*rest), F.struct(_SEQ, *self.order))
        return rows.groupBy(*self.keys).agg(row.alias("_row")).select(*self.keys, "_row.*").select(*rows.columns)

    def _write(self, rows: DataFrame, run: Run) -> bool:
        """Write rows, unique by key and dealt by it, as a run; false where there are none."""
        spark = rows.sparkSession
        fs, make = self._files(spark)
        own = f"{self.path}/_open-{uuid.uuid4().hex}"
        ordered = rows.select(*self.schema.fieldNames(), _SEQ).sortWithinPartitions(*self.keys)
        ordered.write.parquet(own)
        many = spark.read.schema(self._stored()).parquet(own).count()
        if not many:
            fs.delete(make(own), True)
            return False
        if self.filter_from is not None and many >= self.filter_from:
            self._write_filter(spark, own, many)
        if run.first == 0 and run.level == 0:
            self._describe(spark)
        if fs.exists(make(f"{self.path}/{run.name}")) or not fs.rename(make(own), make(f"{self.path}/{run.name}")):
            raise FileExistsError(f"{self.path}/{run.name}: another writer was here")
        return True

    def compact(self, spark: SparkSession) -> list[Run]:
        """Merge the runs of every level that has `fan` of them; the new runs."""
        made = []
        while True:
            live = self.runs(spark)
            full = [level for level in {r.level for r in live} if sum(r.level == level for r in live) >= self.fan]
            if not full:
                return made
            own = [r for r in live if r.level == min(full)]
            merged = Run(min(full) + 1, own[0].first, own[-1].last)
            self._write(self._winners(self._rows(spark, own)), merged)
            made.append(merged)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete runs that merged ones cover, and what failed writers left: how many folders.
        Call it when no reader of an older state is at work."""
        fs, make = self._files(spark)
        found = self._all_runs(spark)
        gone = [r.name for r in found if any(other.covers(r) for other in found)]
        gone += [f.getPath().getName() for f in fs.globStatus(make(f"{self.path}/_open-*")) or []]
        for name in gone:
            fs.delete(make(f"{self.path}/{name}"), True)
        return len(gone)

    # -- reading

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(_SEQ, T.LongType())])

    def _rows(self, spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            # Known to be empty, so that joins with it are planned away.
            return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self._stored()]).limit(0)
        reader = spark.read.schema(self._stored())
        return reader.parquet(*[f"{self.path}/{r.name}" for r in runs])

    def _same(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        on = reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in self.keys])
        return left.join(right, on, how)

    def absent(self, keys: DataFrame, rows: DataFrame) -> DataFrame:
        """`keys` that no row of `rows` has."""
        return self._same(keys, rows.select(*self.keys), "left_anti")

    def of_keys(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """`rows` whose key is one of `keys`."""
        return self._same(rows, keys, "left_semi")

    def read(self, spark: SparkSession) -> DataFrame:
        """The winning row of every key.

        The largest run is not brought together with itself: its rows whose key is in no later run
        stay where they are, and only the others meet the later runs' rows.
        """
        live = self.runs(spark)
        names = self.schema.fieldNames()
        if len(live) < 2:
            return self._rows(spark, live).select(*names)
        base, recent = self._rows(spark, live[:1]), self._rows(spark, live[1:])
        touched = recent.select(*self.keys).distinct()
        old = self._same(base, touched, "left_anti")
        met = self._same(base, touched, "left_semi")
        return old.unionAll(self._winners(met.unionAll(recent))).select(*names)

    # -- the filter

    def _write_filter(self, spark: SparkSession, folder: str, many: int) -> None:
        """A partitioned Bloom filter of a run's keys, beside its files: one bitmap a partition."""
        keys = spark.read.schema(self._stored()).parquet(folder).select(*self.keys)
        parts = max(1, -(-many * self.bits // _BITS))
        probes = keys.select(F.explode(self._places(parts)).alias("place"))
        bitmaps = probes.groupBy(F.expr(f"place div {_BITS}").alias("part")).agg(
            F.bitmap_construct_agg(F.expr(f"place % {_BITS}")).alias("bits")
        )
        bitmaps.withColumn("parts", F.lit(parts).cast("bigint")).write.parquet(f"{folder}/_filter")

    def _hashes(self) -> tuple[Column, Column]:
        return F.xxhash64(F.lit("part"), *self.keys), F.xxhash64(F.lit("bits"), *self.keys)

    def _places(self, parts: int) -> Column:
        """Places of a key's bits, all in the same partition."""
        part, bits = self._hashes()
        own = F.pmod(part, F.lit(parts))
        return F.array(*[own * _BITS + F.shiftrightunsigned(bits, 15 * i).bitwiseAND(_BITS - 1) for i in range(_PROBES)])

    def _held(self) -> Column:
        """Whether all bits of a key are set in `bits`; false without a bitmap."""
        places = self._places(1)
        masks = F.array(*[F.lit(1 << i) for i in range(8)])

        def hit(place: Column) -> Column:
            # A byte is read as hex digits: it is no text.
            byte = F.col("bits").substr((place / 8).cast("int") + 1, F.lit(1))
            return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.get(masks, place % 8)) != 0

        tests = [hit(F.get(places, F.lit(i))) for i in range(_PROBES)]
        return F.coalesce(reduce(Column.__and__, tests), F.lit(False))

    def possible(self, rows: DataFrame, run: Run) -> DataFrame:
        """`rows` with `_possible`: false where the key is surely not in the run."""
        spark = rows.sparkSession
        bitmaps = spark.read.schema("part bigint, bits binary, parts bigint").parquet(f"{self.path}/{run.name}/_filter")
        parts = bitmaps.select("parts").first()
        own = rows.withColumn("part", F.pmod(self._hashes()[0], F.lit(parts["parts"])))
        return own.join(bitmaps.drop("parts"), "part", "left").withColumn("_possible", self._held()).drop("part", "bits")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Rows of `keys` (distinct keys) whose key the log does not hold.

        Later runs are small and asked exactly. For the largest run the filter tells the sure
        misses, which need no join with it; its rows are looked through for the others' keys only.
        """
        spark = keys.sparkSession
        live = self.runs(spark)
        if not live:
            return keys
        names = keys.columns
        if len(live) > 1:
            keys = self._same(keys, self._rows(spark, live[1:]).select(*self.keys), "left_anti")
        fs, make = self._files(spark)
        if not fs.exists(make(f"{self.path}/{live[0].name}/_filter")):
            return self._same(keys, self._rows(spark, live[:1]).select(*self.keys), "left_anti")
        asked = self.possible(keys, live[0])
        sure = asked.filter(~F.col("_possible")).select(*names)
        # Staged, so that its size is known: where it is small, the run's rows stay where they are.
        rest = stage(asked.filter("_possible").select(*names), "possible")
        held = self._same(self._rows(spark, live[:1]).select(*self.keys), rest.select(*self.keys), "left_semi")
        return sure.unionAll(self._same(rest, held, "left_anti"))

    # -- description, for readers that know only the path

    def describe(self) -> str:
        named = {f: getattr(self, f) for f in ("keys", "order", "keep", "fan", "bits", "filter_from")}
        return json.dumps({"schema": json.loads(self.schema.json()), **named})

    def _describe(self, spark: SparkSession) -> None:
        fs, make = self._files(spark)
        out = fs.create(make(f"{self.path}/{_ABOUT}"), True)
        out.write(bytearray(self.describe(), "utf-8"))
        out.close()

    @staticmethod
    def described(path: str, text: str) -> KeyedLog:
        named = json.loads(text)
        schema = T.StructType.fromJson(named.pop("schema"))
        return KeyedLog(path, schema, **{k: tuple(v) if isinstance(v, list) else v for k, v in named.items()})

    @staticmethod
    def open(spark: SparkSession, path: str) -> KeyedLog | None:
        """The log at a path, as its first writer described it; None where there is none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_ABOUT}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        text = spark.read.text(f"{path}/{_ABOUT}", wholetext=True).first()[0]
        return KeyedLog.described(path, text)
