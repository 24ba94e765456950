"""Models of words in a folder: versions beside each other, and a name that says which one holds."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.operators.training import WordModel, WordOptions

#: The tables of a version, with their columns.
TABLES = {"vocab": "id long, token string", "merges": "rank long, x long, y long, new long, freq long", "base": "tagged long, id long", "alphabet": "id long, c string"}
CURRENT = "current"


class Folder:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self.jpath(self.path)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """Writes a file beside its place and moves it there, so that a reader sees it whole or not at all."""
        target, fresh = self.jpath(f"{self.path}/{name}"), self.jpath(f"{self.path}/.{name}.new")
        out = self.fs.create(fresh, True)
        out.write(text.encode())
        out.close()
        if not self.fs.rename(fresh, target):
            raise OSError(f"{target} is there already")

    def read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return rows[0]["value"]


def save_model(model: WordModel, path: str) -> int:
    """Adds a version to the folder and makes it the current one; returns its number.

    A version holds once its file `current-<number>` is there, which is written last; a save that breaks off leaves the
    version before as the current one. Of two saves at once the second to finish fails.
    """
    folder = Folder(model.vocab.sparkSession, path)
    version = 1 + max((int(n.rsplit("-", 1)[1]) for n in folder.names() if n.startswith(("version-", f"{CURRENT}-"))), default=0)
    for name in TABLES:
        getattr(model, name).write.parquet(f"{folder.path}/version-{version}/{name}")
    model.corpus.select("tokens", "w").write.parquet(f"{folder.path}/version-{version}/corpus")
    folder.write(f"{CURRENT}-{version}", json.dumps({"version": version, "options": asdict(model.options)}))
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> WordModel:
    """The current version of a saved model, or the version asked for."""
    folder = Folder(spark, path)
    have = sorted(int(n.rsplit("-", 1)[1]) for n in folder.names() if n.startswith(f"{CURRENT}-"))
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no version {version or 'at all'} of a model in {path}")
    said = json.loads(folder.read(f"{CURRENT}-{version or have[-1]}"))
    at = f"{folder.path}/version-{said['version']}"
    tables = {name: spark.read.schema(columns).parquet(f"{at}/{name}") for name, columns in TABLES.items()}
    corpus = spark.read.schema("tokens array<string>, w long").parquet(f"{at}/corpus")
    return WordModel(**tables, corpus=corpus, options=WordOptions(**said["options"]))


def string_ids(model: WordModel) -> DataFrame:
    """token, id: the id of each display string, the last one where several ids show alike."""
    return model.vocab.groupBy("token").agg(F.max("id").alias("id"))
