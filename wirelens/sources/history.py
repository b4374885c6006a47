"""The history of runs: Parquet folders, each named by a commit, so that an append is seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.schema import RUN_RECORDS


class _Folder:
    """A history's folder, by the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.sc = path.rstrip("/"), spark.sparkContext
        self.fs, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self.system = self.at().getFileSystem(self.conf)

    def at(self, *names: str):
        return self.fs.Path("/".join([self.path, *names]))

    def commits(self) -> list[int]:
        """Numbers of the commits."""
        if not self.system.exists(self.at("commits")):
            return []
        return sorted(int(n) for f in self.system.listStatus(self.at("commits")) if (n := f.getPath().getName()).isdigit())

    def named(self, number: int) -> str:
        """The data folder that a commit names."""
        source = self.system.open(self.at("commits", f"{number:012d}"))
        try:
            return json.loads(bytes(source.readAllBytes()))["data"]
        finally:
            source.close()

    def commit(self, number: int, data: str) -> bool:
        """Move a commit to its number; False if another writer's is there."""
        made = self.at("commits", f".{uuid.uuid4().hex}")
        out = self.system.create(made)
        out.write(bytearray(json.dumps({"data": data}).encode()))
        out.close()
        context = self.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        try:
            context.rename(made, self.at("commits", f"{number:012d}"), self.sc._gateway.new_array(getattr(self.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self.system.delete(made, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)


def append(records: DataFrame, path: str) -> int:
    """Add run records to a history: the number of records that were new.

    Anything beyond the allowed shape is refused. A record that the history
    has already is not added again, so a rerun changes nothing; a run id with
    another record, in the history or among ``records``, refuses the whole
    append. Records are first written beside the history, where no reader
    looks, and are part of it once a commit names them: a job that is killed
    leaves no row. Of writers at the same time one commits first, and the
    others check again. The file system must refuse to rename onto a file that
    exists, or two such writers may both hold the same commit.
    """
    if [f.name for f in records.schema] != [f.name for f in RUN_RECORDS] or [f.dataType.simpleString() for f in records.schema] != [f.dataType.simpleString() for f in RUN_RECORDS]:
        raise ValueError("not the shape of run records")
    spark = records.sparkSession
    folder, names = _Folder(spark, path), []

    def write(df: DataFrame) -> str:
        names.append(f"data-{uuid.uuid4().hex}")
        df.write.parquet(f"{folder.path}/{names[-1]}")
        return names[-1]

    kept = None
    try:
        staged = spark.read.schema(RUN_RECORDS).parquet(f"{folder.path}/{write(records)}")
        while True:
            number = (folder.commits() or [0])[-1] + 1
            own = staged.select("run_id", F.xxhash64(*RUN_RECORDS.names).alias("print"), F.lit(True).alias("new"))
            held = read(spark, path).select("run_id", F.xxhash64(*RUN_RECORDS.names).alias("print"), F.lit(False).alias("new"))
            runs = own.unionByName(held).groupBy("run_id").agg(F.min("print") != F.max("print"), F.count_if("new"), F.count_if(~F.col("new"))).toDF("run_id", "differ", "n", "known")
            met = runs.where("n > 0").agg(F.coalesce(F.sum(F.col("differ").cast("int")), F.lit(0)), F.count_if(F.col("known") > 0), F.count_if(F.col("n") > 1), F.count_if(F.col("known") == 0)).first()
            if met[0]:
                raise ValueError(f"{met[0]} run ids have other records already")
            if not met[3]:
                return 0
            data = names[0]
            if met[1] or met[2]:
                fresh = staged.alias("l").join(runs.where("n > 0 and known = 0").alias("r"), F.col("l.run_id").eqNullSafe(F.col("r.run_id")), "left_semi")
                data = write(fresh.dropDuplicates())
            if folder.commit(number, data):
                kept = data
                return met[3]
    finally:
        for name in names:
            if name != kept:
                folder.delete(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed records, and those of Parquet files that lie in the folder itself; a folder without either is empty."""
    folder = _Folder(spark, path)
    plain = [f.getPath().getName() for f in folder.system.listStatus(folder.at())] if folder.system.exists(folder.at()) else []
    names = [n for n in plain if n.endswith(".parquet")] + [folder.named(n) for n in folder.commits() or []]
    return spark.read.schema(RUN_RECORDS).parquet(*(f"{folder.path}/{n}" for n in names)) if names else spark.createDataFrame([], RUN_RECORDS)
