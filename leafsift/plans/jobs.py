"""Batch jobs over a root folder: preparation of the leaflets' files, and indexing of both corpora."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.config import CORPUS_TYPES, CorpusType
from leafsift.operators import index, prep
from leafsift.operators.models import HashingEmbedder
from leafsift.session import staged
from leafsift.sources import files

REPORT = "grupo string, feitos bigint, faltam array<string>"


def _named(spark: SparkSession, root: str, folder: str, suffix: str = "") -> DataFrame:
    """(name, value) of the text files of a folder; a missing folder is empty."""
    full = f"{root}/{folder}"
    if not files.exists(spark, full):
        return spark.createDataFrame([], "name string, value string")
    return files.leaflet_files(spark, full, f"*{suffix}.txt" if not suffix else f"*{suffix}").select(F.element_at(F.split("path", "/"), -1).alias("name"), "value")


def append_texts(spark: SparkSession, root: str, types: Sequence[CorpusType] = CORPUS_TYPES) -> DataFrame:
    """Attach to each tagged file the bare text of the same name; (grupo, feitos, faltam) per folder. Twice changes nothing."""
    out = []
    for cfg in types:
        for meta, text in ((cfg.original_dir, cfg.original_texts), (cfg.simplified_dir, cfg.simplified_texts)):
            done, missing = prep.append_texts(_named(spark, root, meta), _named(spark, root, text))
            names = [r["name"] for r in missing.orderBy("name").collect()]
            out.append((meta, files.write_files(staged(done, "anexos"), f"{root}/{meta}"), names))
    return spark.createDataFrame(out, REPORT)


def copy_headers(spark: SparkSession, root: str, types: Sequence[CorpusType] = CORPUS_TYPES) -> DataFrame:
    """Copy each original's tagged file to the name of its simplified text; (grupo, feitos, faltam) per corpus."""
    out = []
    for cfg in types:
        made = staged(prep.copy_headers(_named(spark, root, cfg.original_dir, cfg.original_suffix), cfg), "copias")
        out.append((cfg.simplified_dir, files.write_files(made, f"{root}/{cfg.simplified_dir}"), []))
    return spark.createDataFrame(out, REPORT)


def apply_brands(spark: SparkSession, root: str, types: Sequence[CorpusType] = CORPUS_TYPES) -> DataFrame:
    """Write the brand found in each original's bare text into the tagged files of both registers.

    (grupo, feitos, faltam): drugs with a brand, and those without, whose files stay as they are.
    """
    out = []
    for cfg in types:
        if not files.exists(spark, f"{root}/{cfg.map_csv}"):
            continue
        drugs = prep.last_wins(files.drug_map(spark, f"{root}/{cfg.map_csv}")).select(F.col("id").try_cast("int").alias("id"), "nome")
        texts = _named(spark, root, cfg.original_texts, cfg.original_suffix).select(_number().alias("id"), F.col("value").alias("texto"))
        marks = staged(prep.brands(texts, drugs.where("id is not null")), "marcas")
        for folder, suffix in ((cfg.original_dir, cfg.original_suffix), (cfg.simplified_dir, cfg.simplified_suffix)):
            tagged = _named(spark, root, folder, suffix).withColumn("id", _number())
            changed = prep.apply_brands(tagged, marks).where("mudou").select("name", "value")
            files.write_files(staged(changed, "etiquetas"), f"{root}/{folder}")
        none = texts.join(marks, "id", "left_anti").select(F.col("id").cast("string").alias("id")).orderBy("id")
        out.append((cfg.tipo, marks.count(), [r["id"] for r in none.collect()]))
    return spark.createDataFrame(out, REPORT)


def _number():
    return F.split_part("name", F.lit("_"), F.lit(1)).try_cast("int")


def both_corpora(spark: SparkSession, root: str, types: Sequence[CorpusType] = CORPUS_TYPES) -> tuple[DataFrame, DataFrame]:
    """(leaflets ready to be indexed, mapped drugs that lack a file) of all corpora as one; a corpus without its map is skipped."""
    ready = missing = None
    for cfg in types:
        read = files.corpus(spark, root, cfg)
        if read is None:
            continue
        r, m = prep.indexable(*read, cfg)
        ready = r if ready is None else ready.unionByName(r)
        missing = m if missing is None else missing.unionByName(m)
    if ready is None:
        raise FileNotFoundError(f"no map of drugs under {root}")
    return ready, missing


def index_corpora(
    spark: SparkSession, root: str, index_path: str, types: Sequence[CorpusType] = CORPUS_TYPES, make: Callable = HashingEmbedder
) -> tuple[int, list[str]]:
    """(leaflets newly indexed, ids of mapped drugs without both files). A second run adds none."""
    ready, missing = both_corpora(spark, root, types)
    new = index.index_leaflets(spark, ready, f"{index_path}/chunks", f"{index_path}/documents", make, postings_path=f"{index_path}/postings")
    return new, [r["id"] for r in missing.orderBy("id").collect()]
