"""Tables that a stream upserts to exactly once, though a batch may be replayed after a crash.

A table is a folder. Rows are dealt into buckets by a hash of their key; a batch writes the buckets it
touches, whole, to data/batch=N/bucket=B, always from the state before N, and then the file commits/N, which
names those buckets, in one rename. Readers take each bucket from its last committed batch and see nothing of a batch
whose commit is missing. A replayed batch that was committed changes nothing; one that wasn't is written anew,
over what it left. So a batch of several tables, of which some were committed, comes out right as well.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = ("first", "last", "coalesce", "max", "sum")


class UpsertTable:
    """One table: its folder, its key columns and, for every other column, how rows of one key are merged.

    first keeps what is known, last takes what is new, coalesce takes what is new unless it is null, max keeps the larger
    and sum adds. Within a batch rows of one key are merged in the same way, in the order of `order` (columns; all of the row by default). Nulls
    never replace values but under last. Null keys are keys like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], policies: dict[str, str], order: list[str] | None = None, buckets: int = 64) -> None:
        if bad := set(policies.values()) - set(POLICIES):
            raise ValueError(f"unknown policies: {sorted(bad)}")
        self.spark, self.path, self.key, self.policies, self.buckets = spark, path.rstrip("/"), key, policies, buckets
        self.schema = spark.createDataFrame([], schema).schema
        if set(self.schema.names) != {*key, *policies}:
            raise ValueError("every column is in the key or has a policy")
        self.order = order or self.schema.names

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def commits(self) -> dict[int, list[int]]:
        """The committed batches and the buckets each has written."""
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return {}
        names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
        if not names:
            return {}
        texts = self.spark.read.format("text").option("wholetext", True).load([str(p.toString()) for p in names]).collect()
        told = [json.loads(r.value) for r in texts]
        return {x["batch"]: x["buckets"] for x in told}

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _last(self, commits: dict[int, list[int]], before: int | None = None) -> dict[int, str]:
        """For each bucket the folder of its last committed batch."""
        out = {}
        for n in sorted(commits):
            if before is None or n < before:
                out |= {b: f"{self.path}/data/batch={n}/bucket={b}" for b in commits[n]}
        return out

    def read(self) -> DataFrame:
        """The rows as of the last commit."""
        return self._read(list(self._last(self.commits()).values()))

    def _reduced(self, rows: DataFrame, name: str) -> F.Column:
        by, c = F.struct(*self.order), F.col(name)
        known = F.when(c.isNotNull(), by)
        return {"first": F.min_by(c, known), "last": F.max_by(c, by), "coalesce": F.max_by(c, known), "max": F.max(c), "sum": F.sum(c).cast(self.schema[name].dataType)}[self.policies[name]]

    def merged(self, existing: DataFrame, incoming: DataFrame) -> DataFrame:
        """existing, one row a key, with incoming upserted by the policies."""
        new = incoming.groupBy(*self.key).agg(*(self._reduced(incoming, c).alias(f"new_{c}") for c in self.policies))
        new = new.withColumnsRenamed({k: f"new_{k}" for k in self.key}).withColumn("new_", F.lit(True))
        old = existing.withColumn("old_", F.lit(True))
        same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in self.key]
        both = old.join(new, [*same], "full")
        pick = {
            "first": lambda a, b: F.coalesce(a, b), "last": lambda a, b: F.when(F.col("new_"), b).otherwise(a), "coalesce": lambda a, b: F.coalesce(b, a),
            "max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        }
        own = {k: F.when(F.col("new_"), F.col(f"new_{k}")).otherwise(F.col(k)) for k in self.key}
        own |= {c: pick[p](F.col(c), F.col(f"new_{c}")).cast(self.schema[c].dataType) for c, p in self.policies.items()}
        return both.select(*(own[c].alias(c) for c in self.schema.names))

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Upserts a batch's rows; False if the batch was committed before, which changes nothing. Batches come in ascending order."""
        commits = self.commits()
        if batch in commits:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        incoming = rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        touched = sorted(r.b for r in incoming.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        last = self._last(commits, before=batch)
        existing = self._read([last[b] for b in touched if b in last])
        out = self.merged(existing, incoming).withColumn("bucket", bucket)
        out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        self._commit(batch, touched)
        return True

    def _commit(self, batch: int, touched: list[int]) -> None:
        fs, at = self._fs(f"{self.path}/commits/{batch}")
        _, half = self._fs(f"{self.path}/commits/_{batch}")
        out = fs.create(half, True)
        out.write(bytearray(json.dumps({"batch": batch, "buckets": touched}).encode()))
        out.close()
        if not fs.rename(half, at) and not fs.exists(at):
            raise OSError(f"batch {batch} could not be committed")

    def vacuum(self) -> int:
        """Deletes what no reader of the present state needs: buckets written anew since, and data of batches never committed before the last. Returns how many folders went."""
        commits = self.commits()
        kept, gone = set(self._last(commits).values()), 0
        fs, at = self._fs(f"{self.path}/data")
        for folder in fs.listStatus(at) if fs.exists(at) else []:
            n = int(folder.getPath().getName().removeprefix("batch="))
            if commits and n > max(commits):
                continue  # perhaps being written
            for b in fs.listStatus(folder.getPath()):
                path = f"{self.path}/data/batch={n}/{b.getPath().getName()}"
                if b.isDirectory() and path not in kept:
                    gone += bool(fs.delete(b.getPath(), True))
        return gone
