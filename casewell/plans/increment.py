"""Incremental rerun of the transform: two snapshots are compared by row digests, and only what
hangs on a changed row is linked, flattened and counted again.

A run is a step in a folder of its own. It first writes what it is going to do: the view rows that
come or go, the digests, and what that changes in the counts. Then it carries that out on the keyed
logs, and the new counts, written last, end it. A step that was written down but not ended is
carried out by the next run before anything else; doing so twice changes nothing, since a log's
row is replaced by itself. A step that was not yet written down in full is written anew.

Reading compares narrow digests of all rows; links, view and counts cost what has changed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.functions import values as vl
from casewell.operators import keys as K
from casewell.operators.ingest import ingest_rows, typed_incidents
from casewell.plans.flat import flat_view
from casewell.plans.transform import CODED, LOCATIONS, NAMED, link_incidents
from casewell.session import stage
from casewell.sources.keyed_log import KeyedLog

DIMENSIONS = {
    "dim_diagnostico": (CODED, ("code",)),
    "dim_prioridad": (CODED, ("code",)),
    "dim_hospital": (NAMED, ("name",)),
    "ubicaciones": (LOCATIONS, ("direccion", "altura")),
}
PLACES = ("id", "lat", "lon", "comuna")
_EXACT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_AS_JSON = {"timestampFormat": f"{_EXACT}XXX", "timestampNTZFormat": _EXACT}


def digests(df: DataFrame, key: str) -> DataFrame:
    """(key, digest) of rows: SHA-256 of all other columns by name, where NULL has no name."""
    rest = sorted(c for c in df.columns if c != key)
    named = F.to_json(F.struct(*rest), _AS_JSON) if rest else F.lit("")
    return df.select(key, F.sha2(named, 256).alias("digest"))


def snapshot_changes(known: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, digest, gone) of the rows of `now` that are new or not as in `known` (key, digest),
    and of the keys that `now` has no more (`gone`, without a digest). Keys are unique, not NULL."""
    was = known.select(key, F.col("digest").alias("_was"))
    both = was.join(digests(now, key), key, "full_outer")
    changed = both.filter(~F.col("_was").eqNullSafe(F.col("digest")))
    return changed.select(key, "digest", F.col("digest").isNull().alias("gone"))


@dataclass(frozen=True)
class Counts:
    """Rows and true flags per group of the view. Groups and flags are SQL expressions of one view
    row; a NULL flag counts as false. Such counts can be added and taken away."""

    by: Mapping[str, str] = field(default_factory=dict)
    flags: Mapping[str, str] = field(default_factory=dict)

    @property
    def sums(self) -> list[str]:
        return ["n", *[f"{f}_hits" for f in self.flags]]

    def of(self, view: DataFrame, sign: int = 1) -> DataFrame:
        """Counts of view rows; with `sign` -1 what they take away."""
        groups = [F.expr(e).alias(name) for name, e in self.by.items()]
        hits = [F.expr(e).cast("boolean").alias(f"{name}_hits") for name, e in self.flags.items()]
        rows = view.select(*groups, *hits)

        def total(weight: Column) -> Column:
            return F.sum(weight).cast("bigint")

        return rows.groupBy(*self.by).agg(
            total(F.lit(sign)).alias("n"),
            *[total(F.when(F.col(h), sign).otherwise(0)).alias(h) for h in self.sums[1:]],
        )

    def merged(self, *parts: DataFrame) -> DataFrame:
        """The sum of counts, whose groups may be NULL. Groups that add up to nothing stay out."""
        rows = reduce(DataFrame.unionByName, parts)
        added = rows.groupBy(*self.by).agg(*[F.sum(c).cast("bigint").alias(c) for c in self.sums])
        return added.filter(" OR ".join(f"coalesce({c}, 0) <> 0" for c in self.sums))

    def rates(self, counts: DataFrame) -> DataFrame:
        shares = [(F.col(f"{f}_hits") * 100.0 / F.col("n")).alias(f"{f}_rate") for f in self.flags]
        return counts.select(*self.by, "n", *shares)

    def text(self) -> str:
        return json.dumps([dict(self.by), dict(self.flags)])


@dataclass(frozen=True)
class Increment:
    """The tables of the transform under `root`, kept up to date by `run`."""

    root: str
    counts: Counts

    # -- stored tables

    def dimension(self, name: str) -> KeyedLog:
        schema, keys = DIMENSIONS[name]
        return KeyedLog(f"{self.root}/{name}", schema, keys)

    def _digest_log(self, name: str, key: str) -> KeyedLog:
        fields = [T.StructField(key, T.LongType()), T.StructField("digest", T.StringType())]
        schema = T.StructType([*fields, T.StructField("gone", T.BooleanType())])
        return KeyedLog(f"{self.root}/digests-{name}", schema, (key,), filter_from=None)

    # Logs that are never asked for missing keys have no filter.
    def _view_log(self, schema: T.StructType) -> KeyedLog:
        return KeyedLog(f"{self.root}/view", schema, ("id",), filter_from=None)

    def _stored_view(self, spark: SparkSession) -> DataFrame | None:
        log = KeyedLog.open(spark, f"{self.root}/view")
        return None if log is None else log.read(spark).filter("NOT gone").drop("gone")

    def view(self, spark: SparkSession) -> DataFrame:
        """The flat view as the last run left it."""
        stored = self._stored_view(spark)
        if stored is None:
            raise FileNotFoundError(f"{self.root}/view: no run has found an incident")
        return stored.drop("ubicacion_id")

    def current_counts(self, spark: SparkSession) -> DataFrame:
        """Counts per group as the last run left them."""
        ended = self._steps(spark, "counts")
        if not ended:
            raise FileNotFoundError(f"{self.root}: no run has ended")
        return spark.read.parquet(self._step(ended[-1], "counts")).drop("_spec")

    # -- steps

    def _step(self, number: int, part: str) -> str:
        return f"{self.root}/steps/{number}/{part}"

    def _steps(self, spark: SparkSession, part: str) -> list[int]:
        """Numbers of the steps that have written a part in full."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/steps")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"*/{part}/_SUCCESS")) or []
        return sorted(int(m.getPath().getParent().getParent().getName()) for m in marks)

    def carry_out(self, spark: SparkSession) -> None:
        """Carry out a step that is written down but not ended."""
        ended = self._steps(spark, "counts")
        for number in self._steps(spark, "change"):
            if number in ended:
                continue
            rows = spark.read.parquet(self._step(number, "view"))
            self._view_log(rows.schema).append(rows, unique=True)
            for name, key in (("incidents", "id"), ("attributes", "intervencion_id"), ("places", "id")):
                changed = spark.read.parquet(self._step(number, name))
                self._digest_log(name, key).append(changed, unique=True)
            parts = [spark.read.parquet(self._step(number, "change")).drop("_spec")]
            if number > 0:
                parts.append(spark.read.parquet(self._step(number - 1, "counts")).drop("_spec"))
            self._write_counts(self.counts.merged(*parts), number, "counts")

    def _write_counts(self, counts: DataFrame, number: int, part: str) -> None:
        told = counts.withColumn("_spec", F.lit(self.counts.text()))
        told.write.mode("overwrite").parquet(self._step(number, part))

    def _same_counts(self, spark: SparkSession) -> None:
        for number in self._steps(spark, "change"):
            told = spark.read.parquet(self._step(number, "change")).select("_spec").first()
            if told and told[0] != self.counts.text():
                raise ValueError(f"{self.root} holds other counts: {told[0]}")

    # -- a run

    def number(self, raw_rows: DataFrame) -> DataFrame:
        """Incidents from raw page rows. A place on a page keeps its id in all runs; new ones get
        ids after the largest one, in page order."""
        spark = raw_rows.sparkSession
        typed = stage(typed_incidents(ingest_rows(raw_rows, page="page", row="fila")), "incidents")
        placed = typed.withColumn("pagina", F.col("page").cast("bigint")).withColumn("fila", F.col("fila").cast("bigint")).drop("page")
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("pagina", "fila", "id")])
        ids = KeyedLog(f"{self.root}/ids", schema, ("pagina", "fila"), keep="first", filter_from=None)
        # A place comes once. Most are known, so they are asked exactly.
        known = ids.read(spark)
        fresh = stage(ids.absent(placed.select("pagina", "fila"), known), "fresh")
        if not fresh.isEmpty():
            new = stage(K.dense_ids(fresh, ["pagina", "fila"], "id", K.next_id(known)), "new")
            ids.append(new, unique=True)
            known = known.unionByName(new)
        # Staged, as a run reads them many times.
        return stage(placed.join(known, ["pagina", "fila"]), "numbered")

    def grow_dimensions(self, incidents: DataFrame) -> None:
        """Add the values of incidents that the dimensions lack."""
        spark = incidents.sparkSession
        incidents = stage(incidents.select("diagnostico", "codigo_prioridad", "destino_traslado", "direccion", "altura"), "valued")
        for name, label in (("dim_diagnostico", "diagnostico"), ("dim_prioridad", "codigo_prioridad")):
            _grow(self.dimension(name), K.coded_dim(incidents, label), spark)
        _grow(self.dimension("dim_hospital"), incidents.select(F.col("destino_traslado").alias("name")).dropna(), spark)
        places = incidents.select("direccion", vl.int_or_null(F.col("altura")).alias("altura")).dropna()
        _grow(self.dimension("ubicaciones"), places, spark)

    def run(self, incidents: DataFrame, attributes: DataFrame) -> None:
        """Bring the tables up to the given snapshots: `incidents` with a long `id` that is unique
        and stays with its incident, `attributes` (`intervencion_id`, `atributos`) with one row an id.

        Values once in a dimension stay there. Rows of `ubicaciones` may be replaced between runs,
        as by a geocoder; the view follows. An empty snapshot empties view and counts.
        """
        spark = incidents.sparkSession
        self._same_counts(spark)
        self.carry_out(spark)
        number = len(self._steps(spark, "counts"))

        def known(name: str, key: str) -> DataFrame:
            return self._digest_log(name, key).read(spark).filter("NOT gone")

        def told(name: str, rows: DataFrame, key: str) -> DataFrame:
            path = self._step(number, name)
            typed = rows.withColumn(key, F.col(key).cast("bigint"))
            return _kept(snapshot_changes(known(name, key), typed, key), path)

        changed = told("incidents", incidents, "id")
        fresh = incidents.join(changed.filter("NOT gone").select("id"), "id", "left_semi")
        self.grow_dimensions(fresh)
        dims = {name: self.dimension(name).read(spark) for name in DIMENSIONS}
        notes = told("attributes", attributes.select("intervencion_id", "atributos"), "intervencion_id")
        places = told("places", dims["ubicaciones"].select(*PLACES), "id")

        stored = self._stored_view(spark)
        met = changed.select("id").union(notes.select("intervencion_id"))
        if stored is not None:
            moved = places.select(F.col("id").alias("ubicacion_id"))
            met = met.union(stored.select("id", "ubicacion_id").join(moved, "ubicacion_id", "left_semi").select("id"))
        # Staged, so that its size is known: where little has changed, the large sides stay in place.
        ids = stage(met.distinct(), "changed")
        linked = link_incidents(incidents.join(ids, "id", "left_semi"), dims)
        of_ids = ids.withColumnRenamed("id", "intervencion_id")
        notes = attributes.join(of_ids, "intervencion_id", "left_semi")
        rows = flat_view(linked, dims["ubicaciones"], notes, keep=["ubicacion_id"])
        here = rows.withColumn("id", F.col("id").cast("bigint")).withColumn("_here", F.lit(True))
        # An id that only attributes know has no view row and never had one, or has lost it.
        delta = ids.join(here, "id", "left").withColumn("gone", F.col("_here").isNull()).drop("_here")
        delta = _kept(delta, self._step(number, "view"))
        parts = [self.counts.of(delta.filter("NOT gone"))]
        if stored is not None:
            parts.append(self.counts.of(stored.join(ids, "id", "left_semi"), -1))
        # Written last: from here on the step holds.
        self._write_counts(self.counts.merged(*parts), number, "change")
        self.carry_out(spark)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """`df` as written at a path."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grow(log: KeyedLog, source: DataFrame, spark: SparkSession) -> None:
    """Insert-if-absent into a log, one row per key; a numbered one gets ids after the largest."""
    keys, names = list(log.keys), log.schema.fieldNames()
    if set(source.columns) == set(keys):
        fresh = log.missing(source.select(*keys).distinct())
    else:
        rows = stage(K.one_per_key(source, keys), "values")
        fresh = rows.join(log.missing(rows.select(*keys)), keys, "left_semi")
    fresh = stage(fresh, "fresh")
    if fresh.isEmpty():
        return
    if "id" in names:
        fresh = K.dense_ids(fresh, keys, "id", K.next_id(log.read(spark)))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields if f.name not in fresh.columns]
    log.append(fresh.select("*", *absent).select(*names), unique=True)
