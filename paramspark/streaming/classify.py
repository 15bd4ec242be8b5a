"""A mixed stream of labelled and unlabelled examples: each micro-batch is answered by the weights before it, and then learned, once.

``MixedClassifier`` is a ``foreachBatch`` sink. What batch n leaves is a folder of its number in shared storage: the answers of its unlabelled
examples and the weights after it, the weights last. A batch whose weights are complete is skipped when it comes again; one that was
interrupted is answered and learned anew from the weights of the last complete batch, which gives the same rows. So a
restarted query with a new sink goes on as if nothing had happened, and each answer is there exactly once.

Examples are (vec, features, label): features a map of feature number and value; a null label asks. Two classes: labels -1 and 1; more:
0 to ``classes`` - 1. Examples without features are neither answered nor learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passive_aggressive as PA


class MixedClassifier:
    def __init__(self, spark: SparkSession, location: str, *, classes: int = 2, method: str = "OVA", variant: str = "PA", c: float = 1.0, cost: list[list[float]] | None = None, how: str = "mean"):
        self.spark, self.location, self.classes = spark, location.rstrip("/"), classes
        self.method, self.variant, self.c, self.cost, self.how = method, variant, c, cost, how
        self.done = sorted(n for n in self._numbers() if self._exists(f"{n}/weights/_SUCCESS"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _numbers(self) -> list[int]:
        root = self._path("")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [int(x.getPath().getName()) for x in files.listStatus(root)] if files.exists(root) else []

    def weights(self) -> DataFrame:
        """(feature, w) after the last complete batch."""
        if not self.done:
            kind = "array<double>" if self.classes > 2 else "double"
            return self.spark.createDataFrame([], f"feature int, w {kind}")
        return self.spark.read.parquet(f"{self.location}/{self.done[-1]}/weights")

    def answers(self) -> DataFrame:
        """(vec, predicted, batch) of all complete batches."""
        kind = "int" if self.classes > 2 else "boolean"
        found = self.spark.createDataFrame([], f"vec bigint, predicted {kind}, batch bigint")
        return found.unionByName(self.spark.read.parquet(*(f"{self.location}/{n}/answers" for n in self.done))) if self.done else found

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.done and number <= self.done[-1]:
            return
        batch = batch.select(F.col("vec").cast("bigint").alias("vec"), "features", F.col("label").cast("double" if self.classes == 2 else "int").alias("label"))
        one = batch.select("vec", "label", F.explode("features").alias("feature", "x")).select("vec", "label", F.col("feature").cast("int").alias("feature"), F.col("x").cast("double").alias("x"))
        before = self.weights()
        asked = one.where("label IS NULL").select("vec", "feature", "x")
        answers = PA.multi_predict(asked, before, self.classes) if self.classes > 2 else PA.binary_predict(asked, before)
        answers.select("vec", "predicted", F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{self.location}/{number}/answers")
        own, labels = one.where("label IS NOT NULL").select("vec", "feature", "x"), batch.where("label IS NOT NULL").select("vec", "label")
        if self.classes > 2:
            zero = PA.zero_weights(own.join(before.select("feature"), "feature", "left_anti"), self.classes)
            after = PA.multi_round(own, labels, before.unionByName(zero), classes=self.classes, method=self.method, variant=self.variant, c=self.c, cost=self.cost, how=self.how)
        else:
            after = PA.binary_round(own, labels, before, variant=self.variant, c=self.c, how=self.how)
        after.write.mode("overwrite").parquet(f"{self.location}/{number}/weights")
        self.done.append(number)
