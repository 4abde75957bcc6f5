"""Tables in versions: directories that are never changed, and a manifest, written last, that names the live ones.

A table is cut into parts (by a column ``part``).  A commit writes new directories for the parts that it
changes, then one manifest that names a directory for every part; the rest keep theirs.  A manifest appears by
rename, so a reader sees the version before or the one after, whole, and a writer that dies leaves
directories that no manifest names.  The last ``keep`` versions stay readable.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        if keep < 2:
            raise ValueError("the version before the last is needed when a commit is run again")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):  # noqa: ANN202  the file system that Spark itself uses, and the path in it
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    def _delete(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    def manifests(self) -> list[tuple[int, str]]:
        """Numbers and names of the manifests, oldest first."""
        return [(int(x.split(".")[0]), x) for x in self._names("manifest") if not x.startswith((".", "_"))]

    def _load(self, name: str) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{name}", wholetext=True).first()[0])["parts"]

    def live(self, before: int | None = None) -> dict[str, str]:
        """The directory of each part in the newest version (of those below ``before``); empty without one."""
        found = [x for n, x in self.manifests() if before is None or n < before]
        return self._load(found[-1]) if found else {}

    def write(self, df: DataFrame, part: str = "part") -> dict[str, str]:
        """Writes the rows to new directories, one per value of ``part``; nothing is live yet."""
        commit = f"commit={uuid.uuid4().hex}"
        df.write.partitionBy(part).parquet(f"{self.root}/data/{commit}")
        return {x.split("=", 1)[1]: f"{commit}/{x}" for x in self._names(f"data/{commit}") if x.startswith(f"{part}=")}

    def commit(self, parts: dict[str, str], number: int | None = None) -> int:
        """Makes these directories live, as version ``number`` or the next one; drops versions beyond ``keep``."""
        known = self.manifests()
        number = (known[-1][0] + 1 if known else 0) if number is None else number
        again = sum(n == number for n, _ in known)  # of one number the last manifest counts
        name = f"{number:012d}.{again:06d}.{uuid.uuid4().hex}"
        fs, place = self._fs(f"manifest/{name}")
        hidden = self._fs(f"manifest/.{name}")[1]
        sink = fs.create(hidden, True)
        sink.write(bytearray(json.dumps({"parts": parts}).encode()))
        sink.close()
        if not fs.rename(hidden, place):
            raise OSError(f"{place} can't be written")
        self._drop_old()
        return number

    def _drop_old(self) -> None:
        known = self.manifests()
        kept = set(sorted({n for n, _ in known})[-self.keep :])
        old = [x for n, x in known if n not in kept]
        if not old:
            return
        named = {d for n, x in known if n in kept for d in self._load(x).values()}
        gone = {d for x in old for d in self._load(x).values()} - named
        for name in old:  # first, so that no manifest names what isn't there
            self._delete(f"manifest/{name}")
        for directory in gone:
            self._delete(f"data/{directory}")
            if not any(x.startswith("part=") for x in self._names(f"data/{directory.split('/')[0]}")):
                self._delete(f"data/{directory.split('/')[0]}")

    def read(self, parts: dict[str, str], schema: str | None = None) -> DataFrame:
        """The rows of these directories, with ``part``."""
        reader = self.spark.read.option("basePath", f"{self.root}/data")
        reader = reader.schema(f"{schema}, commit string, part string") if schema else reader
        return reader.parquet(*(f"{self.root}/data/{d}" for d in parts.values())).drop("commit")


def upsert_newest(versions: Versions, batch: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n_parts: int = 16, number: int | None = None) -> int:
    """Keeps the newest row (by ``order``) per ``keys``: merges ``batch`` into the parts that its keys hash to and commits.

    ``number`` is the batch's own; a batch that runs again under it starts from the version before and gives the
    same rows.  Parts without a row in the batch keep their directories.  Returns the version's number.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(n_parts)).cast("string")
    rows = batch.withColumn("part", part)
    before = versions.live(number)
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most n_parts
    old = {p: d for p, d in before.items() if p in touched}
    if old:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        rows = versions.read(old, schema).select(*rows.columns).unionByName(rows)
    payload = [c for c in batch.columns if c not in keys]
    newest = rows.groupBy("part", *keys).agg(F.max_by(F.struct(*payload), F.struct(*order, *(c for c in payload if c not in order))).alias("__row"))
    # Rebalanced, so that a part is few files, and a large one several tasks' work.
    fresh = versions.write(newest.select("part", *keys, "__row.*").hint("rebalance", "part")) if touched else {}
    return versions.commit(before | fresh, number)
