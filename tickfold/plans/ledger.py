"""Where a model keeps its ticks: partitioned tables and one commit record per step."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tickfold.config import META, STATE
from tickfold.functions.pyramid import lifetime_of_tick
from tickfold.operators.nearest import Model


META_FIELDS = [f.strip().split(" ")[0] for f in META.split(",")]


class Ledger:
    """Tables below ``root``.

    A step of the model is a part of a tick; late points make a tick have several.
    ``ledger/kind=state|delta/tc=T/part=P``: all micro-clusters after that part of tick T
    (after the last one this is the snapshot of T), and the features that arrived in it.
    ``meta/tc=T/record-P.json``: the commit record, written last. Every write replaces the
    folder of its part, so a repeated step changes nothing. ``positions``: how far
    each source has come, which outlives the records.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- folders -------------------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        fs, target = self._hadoop(path)
        return fs.exists(target)

    def folders(self, path: str) -> list[str]:
        fs, target = self._hadoop(path)
        if not fs.exists(target):
            return []
        return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]

    def ticks_below(self, path: str) -> list[int]:
        names = [n for n in self.folders(path) if n.startswith("tc=")]
        return sorted(int(n[3:]) for n in names)

    def drop(self, path: str) -> None:
        fs, target = self._hadoop(path)
        fs.delete(target, True)

    def path(self, kind: str, tc: int | None = None) -> str:
        base = f"{self.root}/{kind}"
        return base if tc is None else f"{base}/tc={tc}"

    # -- reading -------------------------------------------------------------

    def committed_ticks(self) -> list[int]:
        """Ticks with a commit record; that of the newest may not have been finished."""
        ticks = self.ticks_below(f"{self.root}/meta")
        return ticks if not ticks or self.parts(ticks[-1]) else ticks[:-1]

    def ticks(self, kind: str = "state") -> list[int]:
        """Ticks with a committed snapshot (or delta), from the folder names."""
        committed = set(self.committed_ticks())
        found = self.ticks_below(f"{self.root}/ledger/kind={kind}")
        # A delta outlives the commit record of its tick.
        return [t for t in found if t in committed or (kind == "delta" and committed
                                                       and t <= max(committed))]

    def snapshots(self, kind: str = "state") -> DataFrame:
        """All committed snapshots (or deltas, by part) with their tick ``tc``."""
        ticks = self.ticks(kind)
        if not ticks:
            return self.spark.createDataFrame([], f"{STATE}, tc bigint")
        table = (
            self.spark.read.schema(f"{STATE}, kind string, tc bigint, part bigint")
            .parquet(f"{self.root}/ledger")
            .where((F.col("kind") == kind) & F.col("tc").between(ticks[0], ticks[-1]))
        )
        # Only the newest two ticks can have parts that do not count.
        for tc in self.committed_ticks()[-2:]:
            last, part = max(self.parts(tc)), F.col("part")
            counts = part == last if kind == "state" else part <= last
            table = table.where((F.col("tc") != tc) | counts)
        return table.drop("kind", "part")

    def _table(self, kind: str, tc: int, part: int, schema: str) -> DataFrame:
        path = f"{self.root}/ledger/kind={kind}/tc={tc}/part={part}"
        return self.spark.read.schema(schema).parquet(path)

    def state(self, tc: int, part: int) -> DataFrame:
        return self._table("state", tc, part, STATE)

    def delta(self, tc: int, part: int) -> DataFrame:
        return self._table("delta", tc, part, STATE)

    def model(self, tc: int, part: int) -> tuple[Model, int]:
        """What assignment needs of the micro-clusters, and the next free id."""
        rows = self._table("state", tc, part, f"{STATE}, next_id bigint")
        rows = rows.select("pos", "mc_id", "centroid", "rmsd", "next_id").collect()
        return Model.of_rows(rows), rows[0]["next_id"]

    def parts(self, tc: int) -> list[int]:
        """Committed parts of a tick."""
        fs, target = self._hadoop(self.path("meta", tc))
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(int(n[7:-5]) for n in names if n.startswith("record-") and n.endswith(".json"))

    def meta(self, tc: int, part: int) -> Row:
        record = self._read_json(f"{self.path('meta', tc)}/record-{part}.json")
        return Row(**{name: record.get(name) for name in META_FIELDS})

    def _read_json(self, path: str) -> dict:
        fs, target = self._hadoop(path)
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, folder: str, name: str, content: dict) -> None:
        """One small file, put in place by a rename."""
        fs, fresh = self._hadoop(f"{folder}/_{name}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        target = self._hadoop(f"{folder}/{name}")[1]
        fs.delete(target, False)
        fs.rename(fresh, target)

    def _newest_first(self):
        for tc in reversed(self.committed_ticks()):
            for part in reversed(self.parts(tc)):
                yield self.meta(tc, part)

    def last_before(self, batch_id: int, source: str = "") -> Row | None:
        """Newest commit record that this batch follows.

        Records of the batch itself and of later ones of its source are passed over, as
        they are repeated. Any other source's record is followed, whatever its number.
        """
        for meta in self._newest_first():
            if (meta["source"] or "") != source or meta["batch_id"] < batch_id:
                return meta
        return None

    def latest(self) -> Row | None:
        """Newest commit record."""
        return next(self._newest_first(), None)

    def position(self, source: str) -> int | None:
        """Number of the newest committed batch of a source, whether or not its record is kept."""
        path = f"{self._position_folder()}/{self._position_name(source)}"
        known = self._read_json(path)["batch_id"] if self.exists(path) else None
        # A step that died after its record was written has not moved the position.
        for meta in self._newest_first():
            if (meta["source"] or "") == source:
                return meta["batch_id"] if known is None else max(known, meta["batch_id"])
        return known

    def _position_folder(self) -> str:
        return f"{self.root}/positions"

    @staticmethod
    def _position_name(source: str) -> str:
        return f"{hashlib.md5(source.encode()).hexdigest()}.json"

    # -- writing -------------------------------------------------------------

    def write(self, rows: DataFrame) -> None:
        """Replace the (kind, tc, part) partitions found in ``rows``."""
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("kind", "tc", "part")
            .parquet(f"{self.root}/ledger")
        )

    def commit(self, meta: dict) -> Row:
        """Write the commit record, then note how far its source has come."""
        tc, part = meta["tc"], meta["part"]
        self._write_json(self.path("meta", tc), f"record-{part}.json", meta)
        at = {"source": meta["source"], "batch_id": meta["batch_id"]}
        self._write_json(self._position_folder(), self._position_name(meta["source"]), at)
        self._drop_passed_parts(tc, part)
        return Row(**{name: meta[name] for name in META_FIELDS})

    def _drop_passed_parts(self, tc: int, part: int) -> None:
        """Of the newest two steps the states stay; of ticks before, that of the last part."""
        if part > 0:
            passed, first = tc, part - 1
        else:
            before = [t for t in self.committed_ticks() if t < tc]
            if not before:
                return
            passed = before[-1]
            first = max(self.parts(passed))
        for old in self.parts(passed):
            if old < first:
                self.drop(f"{self.root}/ledger/kind=state/tc={passed}/part={old}")
                self.drop(f"{self.path('meta', passed)}/record-{old}.json")

    def prune(self, now: int, alpha: int, l: int, window_time: int) -> list[int]:  # noqa: E741
        """Delete snapshots past their life, and deltas past the window.

        Returns the ticks that lost their snapshot. The last two always stay, however
        far apart: a repeated batch starts from the tick before its own.
        """
        dropped = []
        for tc in self.ticks_below(f"{self.root}/ledger/kind=state")[:-2]:
            if now >= tc + lifetime_of_tick(tc, alpha, l):
                self.drop(f"{self.root}/ledger/kind=state/tc={tc}")
                self.drop(self.path("meta", tc))
                dropped.append(tc)
        for tc in self.ticks_below(f"{self.root}/ledger/kind=delta"):
            if tc <= now - window_time - 1:
                self.drop(f"{self.root}/ledger/kind=delta/tc={tc}")
        return dropped

    def expire(self, now: int, window_time: int) -> int:
        """Delete every snapshot older than the window, with its delta.

        The last two stay, as in ``prune``.
        """
        threshold = now - window_time + 1
        expired = [t for t in self.ticks_below(f"{self.root}/ledger/kind=state")[:-2]
                   if t < threshold]
        for tc in expired:
            for path in (f"{self.root}/ledger/kind=state/tc={tc}",
                         f"{self.root}/ledger/kind=delta/tc={tc}",
                         self.path("meta", tc)):
                self.drop(path)
        return len(expired)
