"""Tables whose parts are replaced only when the new rows are ready.

New rows are first written beside the old ones; a manifest then names the folder of every part, and
one rename makes it current. Readers follow the newest manifest, so they see all of a change or
nothing of it, and a run that fails before the rename leaves the table as it was. Parts are either
those of columns (a session's rows) or buckets of a hash of the keys (a merge rewrites only the
buckets that it touches).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridstone.operators.relational import stored, upsert

_PART = "_part"


class VersionedTable:
    """A table in a folder of any store that Spark knows. by: the columns whose values make a part; else `buckets` parts by a hash of keys.

    One writer at a time may commit a version: of two that begin from the same one, the second fails and
    leaves the table to the first. A manifest holds a line a part, so parts must be fewer than rows by far.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str] = (), by: Sequence[str] = (), buckets: int = 32):
        if not (keys or by):
            raise ValueError("a table needs keys for a merge or columns that make a part")
        self.spark, self.folder, self.schema, self.keys, self.by, self.buckets = spark, folder.rstrip("/"), schema, list(keys), list(by), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # the manifest

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.folder, *names]))

    def versions(self) -> list[int]:
        """Numbers of the committed versions, the oldest first."""
        at = self._path("manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, parts (folder by part) and note of a version, the newest if none is named."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": -1, "parts": {}, "note": None}
            version = known[-1]
        stream = self._fs.open(self._path("manifest", f"{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, before: dict, parts: dict[str, str], note) -> int:
        version = before["version"] + 1
        waiting, final = self._path("manifest", f".{uuid.uuid4().hex}.waiting"), self._path("manifest", f"{version:012d}.json")
        out = self._fs.create(waiting, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "parts": parts, "note": note}, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self._hadoop, "Options$Rename")
        context.rename(waiting, final, self.spark.sparkContext._gateway.new_array(rename, 0))  # fails if another writer was first
        return version

    # reading and writing

    def _part(self) -> Column:
        if self.by:
            return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("␀"))) for c in self.by])
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The table as a version has it, or some of its parts."""
        found = self.manifest(version)["parts"]
        folders = [f"{self.folder}/{at}" for p, at in sorted(found.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _stage(self, rows: DataFrame, deal: int) -> dict[str, str]:
        """Writes rows beside the table, a folder a part, and returns the folders. deal: files a part, by a hash of the row, so that a large part isn't one task's."""
        names = [f.name for f in self.schema]
        home = f"data/{uuid.uuid4().hex}"
        marked = rows.select(*names).withColumn(_PART, F.sha2(self._part(), 256)).withColumn("_name", self._part())
        marked.drop("_name").repartition(_PART, F.pmod(F.xxhash64(*names), F.lit(deal))).write.partitionBy(_PART).parquet(f"{self.folder}/{home}")
        known = {r["_name"]: r[_PART] for r in marked.select("_name", _PART).distinct().collect()}  # a row a part, as the manifest has
        return {name: f"{home}/{_PART}={code}" for name, code in known.items()}

    def replace(self, rows: DataFrame, deal: int = 1, note=None) -> int:
        """The parts that rows has are replaced by them, others stay; returns the version. Rows are read twice: they should be stored or cheap."""
        before = self.manifest()
        return self._commit(before, before["parts"] | self._stage(rows, deal), note)

    def merge(self, changes: DataFrame, newest_by: str | None = None, deal: int = 1, note=None) -> int:
        """Upsert by the keys: a change replaces the row of its key (if newest_by is given, unless it is older there), a new key is added.

        Only buckets with a change are read and written. Of changes that repeat a key the greatest in newest_by
        (then in the other columns) holds; a null key takes no part. A note that the newest version bears already is a repeated
        batch: nothing is done.
        """
        before = self.manifest()
        if note is not None and before["note"] == note:
            return before["version"]
        names = [f.name for f in self.schema]
        rest = [c for c in names if c not in self.keys and c != newest_by]
        order = F.struct(*([newest_by] if newest_by else []), *rest)
        sound = changes.select(*names).where(" and ".join(f"`{k}` is not null" for k in self.keys))
        single = stored(sound.groupBy(*self.keys).agg(F.max(order).alias("_r")).select(*self.keys, "_r.*").select(*names))  # read three times; a stream's batch would be worked out anew each time
        touched = [r[0] for r in single.select(self._part()).distinct().collect()]  # a row a bucket at most
        if not touched:
            return before["version"]
        old = self.read(before["version"], touched) if before["parts"] else self.spark.createDataFrame([], self.schema)
        after = upsert(old, single, self.keys, when=f"t.`{newest_by}` is null or c.`{newest_by}` >= t.`{newest_by}`" if newest_by else None)
        return self._commit(before, before["parts"] | self._stage(after.select(*names), deal), note)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the newest `keep` and data that none of those names; returns how many folders went. Not while another writes."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._path("manifest", f"{version:012d}.json"), False)
        live = {at.split("/")[1] + "/" + at.split("/")[2] for v in known[-keep:] for at in self.manifest(v)["parts"].values()}
        gone, home = 0, self._path("data")
        for run in self._fs.listStatus(home) if self._fs.exists(home) else []:
            folders = [f.getPath() for f in self._fs.listStatus(run.getPath()) if f.getPath().getName().startswith(f"{_PART}=")]
            dead = [f for f in folders if f"{run.getPath().getName()}/{f.getName()}" not in live]
            for f in [run.getPath()] if len(dead) == len(folders) else dead:
                self._fs.delete(f, True)
            gone += len(dead)
        return gone


def copy_window(target: VersionedTable, source: DataFrame, order: Sequence[Column], most: int | None = None, newest_by: str | None = None) -> int:
    """Merges the first `most` rows of source in an order (all, if none is given) into a serving table: a top-k, never a sort of the whole."""
    rows = source.orderBy(*order).limit(most) if most is not None else source
    return target.merge(rows, newest_by)
