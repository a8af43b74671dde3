"""Tables whose rows are replaced group by group, where a failed run leaves the old rows.

Every run writes into a folder of its own: the rows, and the groups that it replaces. It counts only from
the moment its commit file is there, which is created in one step and names the folder. Readers follow the
commit files, so they see all of a run or nothing of it. A group's rows are those of the last run that replaced it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RUN = "_run"


class VersionedTable:
    """A table in the folder `root` of any store that Spark reads, replaced by the groups of `keys`.

    schema is that of the rows; extra that of further columns stored with each group, such as a digest.
    One run commits at a time: of two that start from the same state the second one fails and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], extra: StructType | None = None):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema
        self.group_schema = StructType([schema[k] for k in keys] + list(extra or []))
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files, self.at = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _commits(self) -> list[dict]:
        """What the commit files say since the last that stands for all groups, in order."""
        folder = self.at(f"{self.root}/commits")
        if not self.files.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in self.files.listStatus(folder) if not x.getPath().getName().startswith((".", "_")))
        found: list[dict] = []
        for name in reversed(names):
            stream = self.files.open(self.at(f"{self.root}/commits/{name}"))
            found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            stream.close()
            if found[-1]["whole"]:
                break
        return found[::-1]

    def _commit(self, number: int, folder: str, whole: bool) -> None:
        """Creates the commit file under its number, in one step; fails if another run has taken the number."""
        text = json.dumps({"run": number, "folder": folder, "whole": whole}).encode()
        draft = self.at(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(text))
        stream.close()
        self.files.mkdirs(self.at(f"{self.root}/commits"))
        final = self.at(f"{self.root}/commits/{number:012d}")
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft, False)
            raise RuntimeError(f"another run has committed number {number}")

    def _read(self, part: str, schema: StructType) -> DataFrame:
        folders = [f"{self.root}/{c['folder']}/{part}" for c in self._commits()]
        full = StructType([*schema, StructField(RUN, LongType())])
        return self.spark.read.schema(full).parquet(*folders) if folders else self.spark.createDataFrame([], full)

    def groups(self) -> DataFrame:
        """The last entry of each group, with its run; groups that a run has removed have none."""
        last = self._read("groups", StructType([*self.group_schema, StructField("_gone", self.spark.range(0).selectExpr("true AS g").schema["g"].dataType)]))
        values = [c for c in last.columns if c not in self.keys]
        newest = last.groupBy(*self.keys).agg(F.max_by(F.struct(*values), RUN).alias("_last"))
        return newest.select(*self.keys, "_last.*").where("NOT _gone").drop("_gone")

    def rows(self) -> DataFrame:
        """The rows of every group as its last run wrote them."""
        last = self.groups().select(*self.keys, RUN)
        return self._read("rows", self.schema).join(last, [*self.keys, RUN], "left_semi").select(self.schema.names)

    def replace(self, rows: DataFrame, groups: DataFrame, gone: DataFrame | None = None, whole: bool = False) -> int:
        """Puts rows in place of all rows of the groups, drops the groups of `gone`, and returns the run's number.

        Every row's group must be among groups. A group without rows is stored as an empty one.
        """
        before = self._commits()
        number = before[-1]["run"] + 1 if before else 1
        folder = f"runs/{number:012d}-{uuid.uuid4().hex}"
        marked = groups.select(*self.group_schema.names, F.lit(False).alias("_gone"))
        if gone is not None:
            marked = marked.unionByName(gone.select(*self.keys).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        rows.select(self.schema.names).withColumn(RUN, F.lit(number).cast("long")).write.parquet(f"{self.root}/{folder}/rows")
        marked.withColumn(RUN, F.lit(number).cast("long")).write.parquet(f"{self.root}/{folder}/groups")
        self._commit(number, folder, whole)
        return number

    def compact(self) -> int:
        """Writes all rows as one run, so that readers need no older one."""
        return self.replace(self.rows(), self.groups(), whole=True)

    def vacuum(self) -> int:
        """Deletes the folders of runs that no reader needs: those before the last whole one, and those
        that never committed and have a lower number than the last commit. Returns how many went."""
        known = self._commits()
        folder = self.at(f"{self.root}/runs")
        if not known or not self.files.exists(folder):
            return 0
        needed = {c["folder"].split("/")[1] for c in known}
        old = [n for x in self.files.listStatus(folder) if (n := x.getPath().getName()) not in needed and int(n.split("-")[0]) <= known[-1]["run"]]
        for name in old:
            self.files.delete(self.at(f"{self.root}/runs/{name}"), True)
        return len(old)
