"""Tables kept by user: partition-wise writes behind a version pointer.

Layout under the table's folder:
  rows/version=<n>/user_id=<user>/part-*   what commit n wrote, for the users it touched
  packed/version=<n>/_bucket=<b>/part-*    the same for a commit of many users, by a hash of the
                                           user and in it by user: a folder for each of very many
                                           users would take longer to make and list than its rows
  pointer/<n>                              (user_id, version): where each user's rows are

A commit writes the rows of the touched users alone, as a new version, and then
a new pointer; files of other users are not read, moved or renamed. A pointer
counts once its writer has finished, so a reader sees a commit whole or not at
all, and what a failed commit left behind is overwritten by the next one. Old
versions stay readable for frames made before a commit, until ``vacuum``. One
writer at a time; any number of readers.

Rows without a user belong to nobody and are not stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.session import write_table
from callsift.sources.tables import upsert

# Users of a commit that have a folder each; those of a larger one share buckets.
MAX_FOLDERS, BUCKETS = 1000, 64
POINTER = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("version", T.LongType())])


def _bucket(user):
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


class UserTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        """``schema`` holds user_id (string) and the other columns."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.columns = schema.names
        fields = [f for f in schema.fields if f.name != "user_id"]
        version, user = T.StructField("version", T.LongType()), T.StructField("user_id", T.StringType())
        self._stored = T.StructType([*fields, version, user])
        self._packed = T.StructType([*fields, user, version, T.StructField("_bucket", T.IntegerType())])

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, name: str) -> list[str]:
        fs, path = self._folder(name)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        """The last committed version; 0 for a table never written."""
        numbers = sorted((int(n) for n in self._list("pointer") if n.isdigit()), reverse=True)
        return next((n for n in numbers if "_SUCCESS" in self._list(f"pointer/{n}")), 0)

    def pointer(self) -> DataFrame:
        v = self.version()
        return (self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer/{v}") if v
                else self.spark.createDataFrame([], POINTER))

    def _rows(self, packed: bool) -> DataFrame:
        name, schema = ("packed", self._packed) if packed else ("rows", self._stored)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _at(self, at: DataFrame, users: list[str] | None = None) -> DataFrame:
        """The rows of users at versions, of both layouts; partitions of other
        versions, and of others than ``users``, are not read."""
        live = F.col("version").isin([r.version for r in at.select("version").distinct().collect()])  # versions, not users
        if users is not None:
            live &= F.col("user_id").isin(users)
        found = [self._rows(p).filter(live).join(at, ["user_id", "version"], "left_semi").select(*self.columns)
                 for p, name in ((False, "rows"), (True, "packed")) if self._list(name)]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def read(self, user_id: str | None = None) -> DataFrame:
        """The current rows of one user (its partition alone is read), or of all."""
        if not self.version():
            return self.spark.createDataFrame([], self.schema)
        at = self.pointer()
        if user_id is None:
            return self._at(at)
        own = at.filter(F.col("user_id") == F.lit(user_id)).first()
        version = own.version if own else 0
        packed = f"version={version}" in self._list("packed")
        if not packed and not self._list("rows"):
            return self.spark.createDataFrame([], self.schema)
        found = self._rows(packed).filter((F.col("user_id") == F.lit(user_id)) & (F.col("version") == F.lit(version)))
        return (found.filter(F.col("_bucket") == _bucket(F.lit(user_id))) if packed else found).select(*self.columns)

    def _of(self, users: DataFrame) -> DataFrame:
        """The current rows of some users."""
        if not self.version():
            return self.spark.createDataFrame([], self.schema)
        return self._at(self.pointer().join(users, "user_id", "left_semi"), self._few(users))

    def _commit(self, rows: DataFrame, users: DataFrame) -> int:
        """``rows`` become all that the ``users`` have."""
        n = self.version() + 1
        packed = self._few(users) is None
        for name in ("rows", "packed"):  # what a failed commit left, in whichever layout
            fs, path = self._folder(f"{name}/version={n}")
            fs.delete(path, True)
        rows = rows.select(*self.columns)
        if packed:
            (rows.withColumn("_bucket", _bucket(F.col("user_id"))).hint("rebalance", "_bucket")
             .sortWithinPartitions("_bucket", "user_id").write.mode("overwrite").partitionBy("_bucket")
             .parquet(f"{self.root}/packed/version={n}"))
        else:
            rows.hint("rebalance", "user_id").write.mode("overwrite").partitionBy("user_id").parquet(f"{self.root}/rows/version={n}")
        moved = users.select("user_id", F.lit(n).cast("long").alias("version"))
        (self.pointer().join(users, "user_id", "left_anti").unionByName(moved)
         .write.mode("overwrite").parquet(f"{self.root}/pointer/{n}"))
        return n

    def _few(self, users: DataFrame) -> list[str] | None:
        """The users, if they are few enough to have folders."""
        names = [r.user_id for r in users.select("user_id").limit(MAX_FOLDERS + 1).collect()]
        return names if len(names) <= MAX_FOLDERS else None

    def _users(self, rows: DataFrame) -> DataFrame:
        """The users of some rows, written once: a commit reads them several times."""
        return write_table(rows.filter("user_id IS NOT NULL").select("user_id").distinct(), "users")

    def merge(self, incoming: DataFrame, key: list[str], order: list[str] = ("created_at",)) -> int:
        """Newest row per key of the stored and the incoming rows; users without
        incoming rows are left as they are."""
        incoming = incoming.filter("user_id IS NOT NULL").select(*self.columns)
        users = self._users(incoming)
        return self._commit(upsert(self._of(users), incoming, key, order), users)

    def replace(self, rows: DataFrame, users: DataFrame | None = None) -> int:
        """The given users (by default those with rows) have the given rows and no others."""
        users = self._users(rows if users is None else users)
        return self._commit(rows.join(users, "user_id", "left_semi"), users)

    def append(self, rows: DataFrame) -> int:
        """Rows added to those of their users; repeated rows stay repeated."""
        rows = rows.filter("user_id IS NOT NULL").select(*self.columns)
        users = self._users(rows)
        return self._commit(self._of(users).unionByName(rows), users)

    def delete(self, condition) -> int:
        """Without the rows that meet the condition (a row for which it is null
        stays); only users who have such rows are rewritten."""
        gone = F.coalesce(condition, F.lit(False))
        users = self._users(self.read().filter(gone))
        return self._commit(self._of(users).filter(~gone), users)

    def evict(self, now) -> int:
        """Without the rows that expired before ``now``."""
        return self.delete(F.col("expires_at") < F.lit(now).cast("timestamp"))

    def vacuum(self) -> None:
        """Deletes what no current pointer names: old pointers, and versions
        that no user is at any more."""
        v = self.version()
        used = {r.version for r in self.pointer().select("version").distinct().collect()}  # versions, not users
        kept = {f"version={n}" for n in used}
        for folder, keep in (("pointer", {str(v)}), ("rows", kept), ("packed", kept)):
            for name in self._list(folder):
                if name not in keep and not name.startswith(("_", ".")):
                    fs, path = self._folder(f"{folder}/{name}")
                    fs.delete(path, True)
