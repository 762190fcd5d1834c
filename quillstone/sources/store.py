"""A store of users and analyses as Parquet files under a log of commits.

Data files are only ever added. What a change means is one small file of the log, `_log/<version>`:
the folders that it adds, rows to take away among them. It is written aside and renamed to the
next version's name, which fails if that version exists. So a change is there as a whole or not at
all, wherever its writer stops; readers see the state of the last commit before they began; of two
writers that want one version one wins, and the other looks at the new state and tries again.

The rename must be atomic and must not replace files, as in HDFS. In a store without that (or on a
local disk with several writers) the log needs another keeper.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

USERS = t.StructType([t.StructField(n, k) for n, k in (("id", t.LongType()), ("email", t.StringType()), ("full_name", t.StringType()), ("password_hash", t.StringType()), ("created_at", t.TimestampType()))])
DOCUMENTS = t.StructType(
    [t.StructField(n, t.StringType()) for n in ("id", "filename", "format")]
    + [t.StructField(n, t.IntegerType()) for n in ("pages", "chars", "total_clauses", "high_count", "medium_count", "low_count")]
    + [t.StructField("analysis_json", t.StringType()), t.StructField("created_at", t.TimestampType()), t.StructField("user_id", t.LongType())]
)
LISTED = [f.name for f in DOCUMENTS if f.name != "analysis_json"]


def clean_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def valid_user(email: Column, full_name: Column) -> Column:
    return F.length(email).between(3, 200) & F.length(full_name).between(1, 100)


GONE_DOCUMENTS = t.StructType([t.StructField("id", t.StringType())])
GONE_USERS = t.StructType([t.StructField("id", t.LongType())])
#: Tables of the log: their columns, and what their files are partitioned by.
TABLES = {"users": (USERS, []), "documents": (DOCUMENTS, ["user_id"]), "gone_documents": (GONE_DOCUMENTS, []), "gone_users": (GONE_USERS, [])}
#: Commits after which the next writer puts all data into new files.
COMPACT = 200


@dataclass
class Snapshot:
    """The folders of each table after the commit `version`; 0 is the empty store."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=lambda: {name: [] for name in TABLES})
    commits: int = 0


class Conflict(Exception):
    """Another writer has made the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._paths.Path(name)

    # ---- log ----

    def init(self) -> None:
        """Make the store if it is missing; an existing one stays as it is."""
        self._files.mkdirs(self._path(f"{self.root}/_log"))

    def _versions(self, after: int = 0) -> list[int]:
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/_log"))]
        return sorted(v for v in (int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))) if v > after)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after the last commit, or after an earlier one."""
        at = Snapshot()
        for v in self._versions():
            if version is not None and v > version:
                break
            stream = self._files.open(self._path(f"{self.root}/_log/{v:020}.json"))
            try:
                entry = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            if entry["whole"]:
                at = Snapshot()
            for table, folder in entry["adds"]:
                at.folders[table].append(folder)
            at.version, at.commits = v, at.commits + 1
        return at

    def _commit(self, version: int, adds: list[tuple[str, str]], whole: bool = False) -> None:
        """Make `version` what the state was before and the folders, or nothing but these; raises Conflict if it exists."""
        aside = self._path(f"{self.root}/_log/_{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps({"adds": adds, "whole": whole}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._paths.Options.Rename, 1)
        options[0] = self._paths.Options.Rename.NONE
        context = self._paths.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"{self.root}/_log/{version:020}.json"), options)
        except Py4JJavaError as e:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(version) from None
            raise

    def _written(self, table: str, rows: DataFrame) -> tuple[str, str]:
        """The rows in a new folder, which counts for nothing until a commit names it."""
        schema, by = TABLES[table]
        folder = f"{table}/batch=b{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        return table, folder

    def _change(self, made: Callable[[Snapshot], list[tuple[str, DataFrame]] | None]) -> bool:
        """Commit what `made` gives for the last state, again for a newer one if another writer came first; None changes nothing."""
        written: list[tuple[str, str]] | None = None
        while True:
            at = self.snapshot()
            rows = made(at)
            if rows is None:
                return False
            if written is None or any(table == "users" for table, _ in written):  # a user's id depends on the state
                written = [self._written(table, df) for table, df in rows]
            try:
                self._commit(at.version + 1, written)
            except Conflict:
                continue
            if at.commits >= COMPACT:
                self.compact()
            return True

    def compact(self) -> None:
        """Put what is there into new files and forget what is gone. Older versions stay readable; so do ids stay taken."""
        at = self.snapshot()
        kept = [("users", self.users(at)), ("documents", self.documents(at))]
        ids = self._read("users", at).select("id").unionByName(self._read("gone_users", at))
        top = ids.agg(F.max("id").alias("id")).where("id is not null").join(self.users(at), "id", "left_anti")
        written = [self._written(table, df) for table, df in kept]
        # the largest id stays known, so that it is not given again
        written += [self._written("gone_users", top)]
        try:
            self._commit(at.version + 1, written, whole=True)
        except Conflict:
            pass  # another writer went on; the next one tries

    # ---- tables ----

    def _read(self, table: str, at: Snapshot) -> DataFrame:
        """All rows ever added, those that are gone among them."""
        schema, _ = TABLES[table]
        folders = [f"{self.root}/{x}" for x in at.folders[table]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders).select(*schema.names)

    def users(self, at: Snapshot | None = None) -> DataFrame:
        at = at or self.snapshot()
        return self._read("users", at).join(self._read("gone_users", at), "id", "left_anti").select(*USERS.names)

    def documents(self, at: Snapshot | None = None) -> DataFrame:
        """Documents that are not gone, by themselves or with their user."""
        at = at or self.snapshot()
        users = self._read("gone_users", at).select(F.col("id").alias("user_id"))
        return self._read("documents", at).join(self._read("gone_documents", at), "id", "left_anti").join(users, "user_id", "left_anti").select(*DOCUMENTS.names)

    def add_user(self, email: str, full_name: str, password_hash: str) -> int:
        """Add a user; an address that is taken raises, also if another writer takes it meanwhile. Returns the new id."""
        email, full_name = email.strip().lower(), full_name.strip()
        if not (3 <= len(email) <= 200 and 1 <= len(full_name) <= 100):
            raise ValueError("e-mail of 3 to 200 and name of 1 to 100 characters")
        now, new = datetime.datetime.now(datetime.timezone.utc), 0

        def made(at: Snapshot):
            nonlocal new
            if not self.users(at).where(F.col("email") == email).isEmpty():
                raise ValueError(f"e-mail taken: {email}")
            ids = self._read("users", at).select("id").unionByName(self._read("gone_users", at))
            new = (ids.agg(F.max("id")).first()[0] or 0) + 1
            return [("users", self.spark.createDataFrame([(new, email, full_name, password_hash, now)], USERS))]

        self._change(made)
        return new

    def user_by_email(self, email: str) -> DataFrame:
        return self.users().where(F.col("email") == email.strip().lower())

    def user_by_id(self, user_id: int) -> DataFrame:
        return self.users().where(F.col("id") == user_id)

    def add_documents(self, rows: DataFrame) -> None:
        """Add analyses (columns of the table; missing ids and times are made). An id that is gone is not used again."""
        have = set(rows.columns)
        made = rows if "id" in have else rows.withColumn("id", F.uuid())
        made = made if "created_at" in have else made.withColumn("created_at", F.current_timestamp())
        self._change(lambda at: [("documents", made)])

    def list_documents(self, user_id: int, limit: int = 50) -> DataFrame:
        """The user's newest documents without the analysis itself, ties by id."""
        return listed(self.documents().where(F.col("user_id") == user_id), limit)

    def document(self, id: str, user_id: int) -> DataFrame:
        return self.documents().where((F.col("user_id") == user_id) & (F.col("id") == id))

    def count_documents(self, user_id: int) -> int:
        return self.documents().where(F.col("user_id") == user_id).count()

    def delete_document(self, id: str, user_id: int) -> bool:
        """Remove one of the user's documents; False if the user has none of that id."""
        gone = self.spark.createDataFrame([(id,)], GONE_DOCUMENTS)
        mine = lambda at: self.documents(at).where((F.col("user_id") == user_id) & (F.col("id") == id))
        return self._change(lambda at: None if mine(at).isEmpty() else [("gone_documents", gone)])

    def delete_user(self, user_id: int) -> bool:
        """Remove a user and all their documents, in one commit."""
        gone = self.spark.createDataFrame([(user_id,)], GONE_USERS)
        return self._change(lambda at: None if self.users(at).where(F.col("id") == user_id).isEmpty() else [("gone_users", gone)])


def listed(documents: DataFrame, limit: int = 50, by: str | None = None) -> DataFrame:
    """The newest documents (of each `by`) without the analysis itself, ties by id."""
    rows = documents.select(*[c for c in documents.columns if c != "analysis_json"])
    if by is None:
        return rows.orderBy(F.desc("created_at"), "id").limit(limit)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), "id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def to_json(analysis: Column) -> Column:
    return F.to_json(analysis)


def from_json(text: Column, schema: str) -> Column:
    """A struct of a serialised analysis; text that does not fit fails the query."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})
