"""Materialised raw entities and marts (the job's own "warehouse").

Every registered query needs the three entities and most need the leg
mart. Recomputing the adapter joins and the booking-sized aggregation per
query would repeat the only expensive work, so each is written once as
Parquet under the session's checkpoint directory (``spark.checkpoint.dir``,
a shared folder on a cluster) and read back with column pruning and
filter pushdown. A written table also cuts lineage: a lost executor only
re-reads files instead of re-running the joins.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from aerokpi.params import TESTDATA, KpiParams

_LOCK = threading.RLock()
_INSTANCES: dict[tuple[int, str, str], "Warehouse"] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; a cluster without one is an error, because
    executors can't share a local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="aerokpi-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of all files below the paths, as Spark's file system lists
    them: changed input is another warehouse, whatever store it lies in."""
    h = hashlib.sha1()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = []
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files is not None and files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        h.update("\n".join([path, *sorted(found)]).encode())
    return h.hexdigest()[:16]


class Warehouse:
    """Entities + marts for one input, each materialised at most once.

    ``builders`` maps an entity name to a function ``Warehouse -> DataFrame``
    (so a derived entity can build on an already written one).
    """

    def __init__(self, spark: SparkSession, builders: dict, root: str | None,
                 params: KpiParams = TESTDATA):
        self.spark = spark
        self._builders = builders
        self.root = root  # None: keep everything lazy (tests, small inputs)
        self.params = params
        self._done: dict[str, DataFrame] = {}
        self.sf_dir: str | None = None
        self._lock = threading.RLock()

    @classmethod
    def for_testdata(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        from aerokpi.sources import adapter
        from aerokpi.sources.schema import conform, normalize_columns

        # one warehouse per session object and input; each writes into its own
        # folder, so two sessions never overwrite each other's tables
        fingerprint = _fingerprint(spark, sf_dir)
        key = (id(spark), spark.sparkContext.applicationId, fingerprint)
        with _LOCK:
            wh = _INSTANCES.get(key)
            if wh is None or wh.spark is not spark:
                root = f"{checkpoint_root(spark)}/aerokpi-warehouse/{fingerprint}-{uuid.uuid4().hex[:8]}"
                builders = {
                    "booking_sheet": lambda w: normalize_columns(adapter.booking_sheet(spark, sf_dir)),
                    "passenger": lambda w: conform(normalize_columns(adapter.passenger_sheet(spark, sf_dir)), "passenger"),
                    "flight": lambda w: conform(normalize_columns(adapter.flight_sheet(w.booking())), "flight"),
                }
                wh = cls(spark, builders, root)
                wh.sf_dir = sf_dir
                _INSTANCES[key] = wh
            return wh

    @classmethod
    def from_sheets(cls, spark: SparkSession, booking: str, passenger: str, flight: str, fmt: str = "csv",
                    params: KpiParams | None = None) -> "Warehouse":
        """Warehouse over exported Booking / Passenger / Flight sheets (CSV with
        header or Parquet), materialised under the checkpoint folder."""
        from aerokpi.params import DEFAULT
        from aerokpi.sources.readers import read_entity

        paths = {"booking": booking, "passenger": passenger, "flight": flight}
        root = f"{checkpoint_root(spark)}/aerokpi-warehouse/{_fingerprint(spark, *paths.values())}-{uuid.uuid4().hex[:8]}"
        builders = {k: (lambda w, k=k: read_entity(spark, paths[k], k, fmt)) for k in paths}
        return cls(spark, builders, root, params or DEFAULT)

    @classmethod
    def of(cls, spark: SparkSession, booking: DataFrame, passenger: DataFrame, flight: DataFrame,
           params: KpiParams = TESTDATA, root: str | None = None) -> "Warehouse":
        """Warehouse over given entity DataFrames (lazy unless ``root`` is given)."""
        builders = {"booking": lambda w: booking, "passenger": lambda w: passenger, "flight": lambda w: flight}
        return cls(spark, builders, root, params)

    def with_params(self, params: KpiParams) -> "Warehouse":
        """The same entities and marts under other parameters (none of them depends on any)."""
        other = Warehouse(self.spark, self._builders, self.root and f"{self.root}-{uuid.uuid4().hex[:8]}", params)
        other.sf_dir, other._done, other._lock = self.sf_dir, dict(self._done), threading.RLock()
        return other

    def _materialize(self, name: str, build) -> DataFrame:
        with self._lock:
            if name not in self._done:
                df = build()
                if self.root is None:
                    self._done[name] = df
                else:
                    path = f"{self.root}/{name}"
                    df.write.mode("overwrite").parquet(path)
                    self._done[name] = self.spark.read.parquet(path)
            return self._done[name]

    def stable(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` turned into data: a written table (or, for an in-memory
        warehouse, a reliable checkpoint under the checkpoint folder)."""
        if self.root is None:
            checkpoint_root(self.spark)
            return df.checkpoint()
        return self._materialize(name, lambda: df)

    def _entity(self, name: str) -> DataFrame:
        return self._materialize(name, lambda: self._builders[name](self))

    def booking_sheet(self) -> DataFrame:
        """The booking sheet with normalised headers (test tables only)."""
        return self._entity("booking_sheet")

    def booking(self) -> DataFrame:
        if "booking" in self._builders:
            return self._entity("booking")
        from aerokpi.sources.schema import conform

        return conform(self.booking_sheet(), "booking")  # a projection of the written sheet

    def passenger(self) -> DataFrame:
        return self._entity("passenger")

    def flight(self) -> DataFrame:
        return self._entity("flight")

    # ---- marts -----------------------------------------------------------
    def leg_base(self) -> DataFrame:
        from aerokpi.operators.marts import leg_base

        return self._materialize("leg_base", lambda: leg_base(self.booking()))

    def leg(self) -> DataFrame:
        from aerokpi.operators.marts import leg

        return self._materialize("leg", lambda: leg(self.leg_base(), self.flight()))

    def leg_report(self) -> DataFrame:
        from aerokpi.operators.marts import leg_report

        return self._materialize("leg_report", lambda: leg_report(self.leg_base(), self.flight()))
