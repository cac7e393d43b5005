"""Documents from files: dispatch by name, decoding, and the optional PDF and image readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import extension
from quire.operators.structure import clean, split_sections
from quire.operators.tagging import tag
from quire.session import materialize

KINDS = {"txt": "text", "pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image"}


def kind(name: Column) -> Column:
    """text, pdf, image, or null for a type that isn't supported."""
    out = F.lit(None).cast("string")
    for ext, what in KINDS.items():
        out = F.when(extension(name) == ext, what).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Rows (path, content) of all files below a folder or of a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def _decode(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def _pdf(data: bytes) -> str:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pages:
        return "".join(page.get_text("text") + "\n" for page in pages)


def _image(data: bytes) -> str:
    import io

    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(data)), config="--psm 6")


def extract(df: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Adds raw_text and error.

    Text is UTF-8 with invalid bytes dropped (no built-in drops them, hence an
    Arrow-batched UDF). PDF pages and images need their libraries; without them, and
    for broken files or types that aren't supported, ``error`` says so and the text is
    null, so one file never stops a batch.
    """

    @F.pandas_udf("raw_text string, error string")
    def read(what, content):
        import pandas as pd

        readers, rows = {"text": _decode, "pdf": _pdf, "image": _image}, []
        for k, data in zip(what, content, strict=True):
            try:
                if k is None:
                    raise ValueError("Unsupported file type")
                rows.append((readers[k](bytes(data or b"")), None))
            except Exception as failure:  # the file's own error, reported in its row
                rows.append((None, f"{type(failure).__name__}: {failure}"))
        return pd.DataFrame(rows, columns=["raw_text", "error"])

    got = "read"
    while got in {c.lower() for c in df.columns}:
        got += "_"
    made = df.withColumn(got, read(kind(F.col(name_col)), F.col(content_col)))
    return made.withColumn("raw_text", F.col(got)["raw_text"]).withColumn("error", F.col(got)["error"]).drop(got)


#: Spark's writers of the files that ``write_each`` makes, by ending.
WRITERS = {"txt": "text", "csv": "csv"}


def write_each(df: DataFrame, folder: str, by_spark: bool | None = None) -> DataFrame:
    """Write a file for each row (key, text, ending) below ``folder``, which is new: rows (key, path) with the files' full URIs.

    Keys are unlike longs, endings those of WRITERS. Hadoop's local file system starts
    a ``chmod`` process for every file, checksum and folder that it makes, unless its
    native library is there: most of the time goes into these. So there the tasks
    write themselves, an attempt into a folder of its own, whose names only count if it
    succeeds. Elsewhere (or ``by_spark``) Spark's writers make a folder a key, and the names come from a listing.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file" if by_spark is None else by_spark:
        for ending, writer in WRITERS.items():
            rows = df.filter(F.col("ending") == ending).select("key", "text").repartition("key")
            getattr(rows.write.partitionBy("key"), writer)(f"{folder}/kind={writer}")
        there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("path"))
        return there.select(F.regexp_extract("path", r"/key=(-?\d+)/", 1).try_cast("long").alias("key"), "path")
    local = path(folder).toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        own, n = TaskContext.get().taskAttemptId(), 0
        os.makedirs(f"{local}/{own}", exist_ok=True)
        for batch in batches:
            names = []
            for text, ending in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                names.append(f"{own}/{n}.{ending}")
                n += 1
                with open(f"{local}/{names[-1]}", "wb") as out:
                    out.write((text or "").encode() + b"\n")  # never empty: scans pass over empty files
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["key", "path"])

    made = materialize(df.select("key", "text", "ending").mapInArrow(write, "key long, path string"), "names")
    one = made.first()
    if one is None:
        return made
    # A scan of one file tells how scans write the folder's URI.
    named = spark.read.format("binaryFile").load(f"{folder}/{one['path']}").select("_metadata.file_path").first()[0]
    return made.select("key", F.concat(F.lit(named.removesuffix(one["path"])), "path").alias("path"))


#: File names that go into the plan of a scan.
MOST_NAMES = 20_000


def read_named(spark: SparkSession, folder: str, rows: DataFrame, path_col: str = "file", most: int = MOST_NAMES) -> DataFrame:
    """Rows (path, content) of the files below ``folder`` that ``rows`` name, by their full URI.

    Up to ``most`` names become a filter on the files' metadata, by which the scan's
    planning leaves out all other files unopened. More names don't: then all files
    are read, and whoever joins them to the rows does so by a shuffle.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    names = [r[0] for r in rows.select(path_col).filter(F.col(path_col) != "").distinct().limit(most + 1).collect()]
    if len(names) <= most:
        files = files.filter(F.col("_metadata.file_path").isin(names))
    return files.select(F.col("_metadata.file_path").alias("path"), "content")


def stored(df: DataFrame, files: DataFrame, path_col: str = "file") -> DataFrame:
    """Rows of ``df`` with the content of the file that they name."""
    return df.join(files.select(F.col("path").alias(path_col), "content"), path_col, "left")


def read_back(manuals: DataFrame, files: DataFrame) -> DataFrame:
    """The cleaned text of each manual's stored file: (id, text, error); a manual without a file, or whose file is gone, says so."""
    found = extract(stored(manuals.select("id", "file"), files), "file")
    problem = F.when(F.coalesce(F.col("file"), F.lit("")) == "", "no file").when(F.col("content").isNull(), "file not found").otherwise(F.col("error"))
    return clean(found, "raw_text", "text").select("id", F.when(problem.isNull(), F.col("text")).alias("text"), problem.alias("error"))


def ingest(files: DataFrame, name_col: str = "path") -> DataFrame:
    """Files to tagged sections: (name, ord, subtitle, content, tag); a file that fails gives no section."""
    text = clean(extract(files, name_col).filter("error is null"), "raw_text", "text")
    found = text.filter(F.length("text") > 0)
    return tag(split_sections(found, "text", F.col(name_col), (name_col,)))
