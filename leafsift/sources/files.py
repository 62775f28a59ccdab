"""Drug maps, leaflet files, and the tables of the index."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from leafsift.config import CorpusType
from leafsift.session import staged

MAP_SCHEMA = "id string, nome string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drug_map(spark: SparkSession, path: str) -> DataFrame:
    """(linha, id, nome) of a map with a header; ids stay text, trailing spaces stay."""
    df = spark.read.csv(path, header=True, schema=MAP_SCHEMA, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return df.select(F.monotonically_increasing_id().alias("linha"), "id", "nome")


def leaflet_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, value): whole files as text."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return df.select(F.input_file_name().alias("path"), "value")


def corpus(spark: SparkSession, root: str, cfg: CorpusType) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(map, originals, simplified) of one corpus; None where its map is missing. Missing folders are empty."""
    path = f"{root}/{cfg.map_csv}"
    if not exists(spark, path):
        return None
    empty = spark.createDataFrame([], "path string, value string")
    folders = []
    for folder, suffix in ((cfg.original_dir, cfg.original_suffix), (cfg.simplified_dir, cfg.simplified_suffix)):
        full = f"{root}/{folder}"
        folders.append(leaflet_files(spark, full, f"*{suffix}") if exists(spark, full) else empty)
    return drug_map(spark, path), folders[0], folders[1]


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Add vector records, one folder per register."""
    chunks.write.mode("append").partitionBy("registro").parquet(path)


BUCKETS = 64
_MANIFEST = re.compile(r"tabela-(\d+)\.json$")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest state of a table: its number, schema, and the folder of each bucket of keys."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    found = [(int(m.group(1)), str(f.getPath())) for f in fs.listStatus(p) if (m := _MANIFEST.search(str(f.getPath())))]
    if not found:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(max(found)[1], wholetext=True).collect()))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written by ``upsert``, as its newest state has it; None if there is none."""
    state = _manifest(spark, path)
    if state is None:
        return None
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/{v}/balde={b}" for b, v in state["buckets"].items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> None:
    """Write ``new`` over the stored rows of its keys.

    Of several rows with one key the latest ``version`` stays, new ones before stored ones of the same.
    Keys are dealt to buckets by their hash, and only buckets with new keys are written again, beside
    the stored ones. Then a manifest with the next number names the folder of every bucket; until it
    stands, readers see the old state, so a run that breaks off changes nothing. Two writers can't
    both take one number: the later one fails. Folders that no state names any more are deleted.
    """
    state = _manifest(spark, path) or {"n": 0, "count": buckets, "schema": None, "buckets": {}}
    balde = F.pmod(F.xxhash64(key), F.lit(state["count"])).cast("int")
    new = staged(new.withColumn("__new", F.lit(1)).withColumn("balde", balde), "novas")
    touched = sorted(r["balde"] for r in new.select("balde").distinct().collect())  # at most ``count``
    if not touched and state["schema"]:
        return
    both = new
    stored = [f"{path}/{state['buckets'][str(b)]}/balde={b}" for b in touched if str(b) in state["buckets"]]
    if stored:
        old = spark.read.schema(StructType.fromJson(state["schema"])).parquet(*stored)
        both = old.withColumn("__new", F.lit(0)).withColumn("balde", balde).unionByName(new, allowMissingColumns=True)
    latest = latest_by(both, [key], [F.desc_nulls_last(version), F.desc("__new")]).drop("__new")
    if state["schema"]:  # columns stored before stay, those of new rows join them
        names = [f.name for f in StructType.fromJson(state["schema"])]
        for f in StructType.fromJson(state["schema"]):
            if f.name not in latest.columns:
                latest = latest.withColumn(f.name, F.lit(None).cast(f.dataType))
        latest = latest.select(*names, *[c for c in latest.columns if c not in names])
    folder = f"v-{uuid.uuid4().hex}"
    latest.repartition(max(len(touched), 1), "balde").write.partitionBy("balde").parquet(f"{path}/{folder}")
    held = {**state["buckets"], **{str(b): folder for b in touched}}
    schema = json.loads(latest.drop("balde").schema.json())
    made = {"n": state["n"] + 1, "count": state["count"], "schema": schema, "buckets": held}
    target, fs = _fs(spark, f"{path}/tabela-{made['n']}.json")
    draft, _ = _fs(spark, f"{path}/_novo-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise OSError(f"another writer has changed {path}; nothing was changed by this one")
    root, _ = _fs(spark, path)
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("v-") and name in state["buckets"].values() and name not in held.values() or name == f"tabela-{state['n']}.json":
            fs.delete(f.getPath(), True)


def write_files(df: DataFrame, folder: str) -> int:
    """Write each (name, value) as a text file of ``folder``, which all machines share; returns how many.

    A file is written beside its place and then moved there, so it is old or new, never half.
    """
    def put(batches):
        import pandas as pd
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        store.create_dir(base, recursive=True)
        for pdf in batches:
            for name, value in zip(pdf["name"], pdf["value"]):
                draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(value.encode("utf-8"))
                store.move(draft, f"{base}/{name}")
            yield pd.DataFrame({"name": pdf["name"]})

    return df.select("name", "value").mapInPandas(put, "name string").count()


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; a rank filter, so the limit acts before the shuffle too."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
