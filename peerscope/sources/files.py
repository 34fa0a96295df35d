"""Input files: selection rules and content hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.session import spread

#: Bytes of a file that are held at a time.
BUFFER = 1 << 20

# --- fixed values: name markers of French editions ------------------------------------------------
FRENCH_MARKERS = ("french", "les_donnees", "rapports_de", "normalisees", "_fr.")


def list_files(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """(path, name, folder, length) of a file pattern; contents are not read, and files without content are not listed."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn(
        "folder", F.element_at(F.split("path", "/"), -2)
    )


def is_english(name: Column) -> Column:
    lowered = F.lower(name)
    french = F.lit(False)
    for marker in FRENCH_MARKERS:
        french = french | F.contains(lowered, F.lit(marker))
    return ~french


def is_energy_input(name: Column) -> Column:
    """Ingested energy files: English, no lists of non-reporters, no normalised series."""
    lowered = F.lower(name)
    return is_english(name) & ~F.contains(lowered, F.lit("non-reporters")) & ~F.contains(lowered, F.lit("normalized"))


def newest_per_folder(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "folder"]
    return files.groupBy("folder").agg(F.max_by(F.struct(*rest), "name").alias("_f")).select("folder", "_f.*")


def hashed(files: DataFrame) -> DataFrame:
    """Add sha256 of each whole file to rows with a path, reading ``BUFFER`` bytes at a time, so that files may have any size."""
    names = [*files.columns, "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(names.index("path")).to_pylist():
                system, place = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/@"))
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while part := stream.read(BUFFER):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names)

    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())])
    return spread(files, "path").mapInArrow(run, schema)


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, sha256) of whole files; each is a step of its own, and contents never pass through a row."""
    files = list_files(spark, list(paths)).select("path", F.col("name").alias("file"))
    return hashed(files).select("file", "sha256")


def source_hash(hashes: DataFrame) -> DataFrame:
    """One hash of all inputs, independent of listing order (one row per input file)."""
    ordered = F.array_sort(F.collect_list(F.struct("file", "sha256")))
    joined = F.array_join(F.transform(ordered, lambda f: f["sha256"]), "|")
    return hashes.agg(F.sha2(joined, 256).alias("source_hash"))
