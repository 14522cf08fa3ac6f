"""Day tables that grow by whole batches.

A batch is written to a folder of its own and counts from the moment its entry in the ledger
is there: one small file that says which days it holds, put in place by a rename. A run that
dies before leaves a folder that no entry names; it is never read, and its days are loaded
again. A table's columns are those of its entries, so no footers are read to find them.

    {root}/rows/batch=.../day=.../*.parquet
    {root}/ledger/{number}-{batch}.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "number long, batch string, days array<string>, schema string, last_row_id long"


class DayLedger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list[dict]:
        """What has been committed, in order. A file that is no whole entry is none."""
        try:
            found = self.spark.read.schema(_ENTRY).json(f"{self.root}/ledger")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [r.asDict() for r in found.where("batch IS NOT NULL AND schema IS NOT NULL").orderBy("number", "batch").collect()]

    def days(self) -> set[str]:
        """Days that are done, those without rows too."""
        return {day for entry in self.entries() for day in entry["days"]}

    def last_row_id(self) -> int:
        return max([e["last_row_id"] for e in self.entries() if e["last_row_id"] is not None], default=-1)

    def read(self, days: Iterable | None = None) -> DataFrame:
        """All committed rows; ``days`` prunes folders. A column a batch does not have is null there."""
        entries = self.entries()
        if not entries:
            raise FileNotFoundError(f"nothing has been committed to {self.root}")
        fields: dict[str, T.StructField] = {}
        for entry in entries:
            for field in T.StructType.fromJson(json.loads(entry["schema"])).fields:
                if fields.setdefault(field.name, field).dataType != field.dataType:
                    raise TypeError(f"column {field.name} of {self.root} has several types")
        kept = [T.StructField(f.name, f.dataType) for f in fields.values()]
        reader = self.spark.read.schema(T.StructType([*kept, T.StructField("batch", T.StringType())]))
        table = reader.option("basePath", f"{self.root}/rows").parquet(
            *[f"{self.root}/rows/batch={e['batch']}" for e in entries]).drop("batch")
        return table if days is None else table.where(F.col("day").isin(list(days)))

    def append(self, table: DataFrame, days: Iterable[str]) -> DataFrame:
        """Write a batch, then its entry; returns all committed rows. ``days`` are done from then on, with or
        without rows; ``table`` has no others. The rebalance hint splits a day that is much bigger than others."""
        batch = uuid.uuid4().hex
        path = f"{self.root}/rows/batch={batch}"
        table.hint("rebalance", "day").write.partitionBy("day").parquet(path)
        last = None
        if "row_id" in table.columns:
            last = self.spark.read.schema(table.schema).parquet(path).agg(F.max("row_id")).first()[0]
        number = len(self.entries())
        self._put(f"{number:08d}-{batch}.json", {
            "number": number, "batch": batch, "days": sorted(map(str, days)), "schema": table.schema.json(), "last_row_id": last})
        return self.read()

    def _put(self, name: str, entry: dict) -> None:
        """A file that is there as a whole or not at all; names with a leading dot are never read."""
        spark = self.spark
        half, whole = (spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger/{n}") for n in (f".{name}", name))
        files = half.getFileSystem(spark._jsc.hadoopConfiguration())
        out = files.create(half, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not files.rename(half, whole):
            raise OSError(f"could not put {whole.toString()} in place")
