"""The tables and models of one offline run, and the record of its ranking models."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import features, rankers
from creditloom.operators.cells import CellIndex
from creditloom.operators.trees import LeafTable, boxes_of
from creditloom.session import settle

TRIALS = "name string, kind string, settings string, split string, n_users long, ndcg double, path string, chosen boolean"


def save_table(df: DataFrame, root: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.parquet(f"{root}/{name}")


@dataclass
class Ranking:
    """A ranking model with the vectors it gives users and products."""

    name: str
    model: rankers.FactorRanker | rankers.PerceptronRanker
    users: DataFrame   # member_id, vector
    items: DataFrame   # item_id, vector


@dataclass
class Artefacts:
    """Where the tables and models of one run lie, read on demand."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def user_spec(self) -> features.FeatureSpec:
        return features.FeatureSpec.load(self.spark, f"{self.root}/user_spec")

    def item_spec(self) -> features.FeatureSpec:
        return features.FeatureSpec.load(self.spark, f"{self.root}/item_spec")

    def repay_model(self) -> GBTClassificationModel:
        return GBTClassificationModel.load(f"{self.root}/repay_model")

    def calibrator(self) -> IsotonicRegressionModel:
        return IsotonicRegressionModel.load(f"{self.root}/calibrator")

    def leaves(self) -> LeafTable:
        return boxes_of(self.repay_model())

    def item_index(self) -> CellIndex:
        return CellIndex(self.spark, f"{self.root}/item_index")

    def committed(self, step: str) -> str | None:
        """What the step of that name was last finished for, if it was."""
        try:
            row = self.spark.read.schema("mark string").json(f"{self.root}/steps/{step}").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if row is None else row.mark

    def commit(self, step: str, mark: str) -> None:
        self.spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").json(f"{self.root}/steps/{step}")

    def trials(self) -> DataFrame:
        """Every ranking model that was tried, with the one in use; a version of this small table is written whole."""
        versions = self.spark.read.schema(f"{TRIALS}, version long").parquet(f"{self.root}/trials")
        newest = versions.agg(F.max("version").alias("version"))
        return versions.join(F.broadcast(newest), "version", "left_semi")

    def record(self, trials: list[tuple]) -> None:
        """Puts a new version of the table of trials in place of the last; readers see one or the other."""
        try:
            version = self.spark.read.schema(f"{TRIALS}, version long").parquet(f"{self.root}/trials").agg(F.max("version")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            version = None
        rows = self.spark.createDataFrame(trials, TRIALS).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.root}/trials/version={0 if version is None else version + 1}")

    def save_ranker(self, name: str, model: rankers.FactorRanker | rankers.PerceptronRanker) -> Ranking:
        """Writes a model with the vectors it gives everyone."""
        path = f"{self.root}/rankers/{name}"
        rankers.save(self.spark, model, f"{path}/model")
        users, items = self.rank_inputs()
        save_table(model.user_vectors(users), path, "users")
        save_table(model.item_vectors(items), path, "items")
        return self.ranking(name)

    def rank_inputs(self) -> tuple[DataFrame, DataFrame]:
        """What ranking models read of users and of products, the collaborative factors included."""
        factors = {side: self.table(f"{side}_factors").withColumnRenamed("vector", f"{side}_factors") for side in ("user", "item")}
        return (self.table("users").join(factors["user"], "member_id", "left"),
                self.table("items").join(settle(factors["item"]), "item_id", "left"))

    def ranking(self, name: str | None = None) -> Ranking:
        """The ranking model of that name, or the one in use."""
        if name is None:
            name = self.trials().where("chosen").first().name
        path = f"{self.root}/rankers/{name}"
        read = self.spark.read.parquet
        return Ranking(name, rankers.load(self.spark, f"{path}/model"), read(f"{path}/users"), read(f"{path}/items"))

    def ranker(self, name: str | None = None) -> rankers.FactorRanker | rankers.PerceptronRanker:
        return self.ranking(name).model


def settings_text(settings: dict) -> str:
    return json.dumps(settings, sort_keys=True)
