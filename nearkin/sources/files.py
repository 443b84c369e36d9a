"""Folders of files: listing, name filters, and text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTED = "text string, error string"
#: Files with names that Spark passes over, which the driver lists.
MAX_HIDDEN = 100_000

# Fixed value: the columns of Spark's binary file source.
_BINARY_FILE = (
    "path string, modificationTime timestamp, length bigint, content binary"
)


# Schemes that Arrow knows by another name than Hadoop does.
_OTHER_NAMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss"}


def has_suffix(filename: Column, suffix: str) -> Column:
    """Case-insensitive suffix test."""
    return F.lower(filename).endswith(suffix.lower())


def name_matches(filename: Column, suffix: str, literal: str | None = None) -> Column:
    """Suffix test plus, if given, a case-sensitive substring test."""
    keep = has_suffix(filename, suffix)
    return keep & filename.contains(literal) if literal else keep


def _escaped(text: str) -> str:
    return "".join("\\" + ch if ch in "*?[]{}\\" else ch for ch in text)


def _glob(suffix: str, literal: str | None) -> str:
    """Listing glob for the name rules, as far as one glob can say them.

    The suffix is spelled in both cases, since globs are case-sensitive. The
    literal is left to the row filter where it could overlap with the suffix.
    """
    tail = "".join(
        f"[{ch.lower()}{ch.upper()}]" if ch.lower() != ch.upper() else _escaped(ch)
        for ch in suffix
    )
    if not literal:
        return "*" + tail
    low, end = literal.lower(), suffix.lower()
    overlap = any(end.startswith(low[-k:]) for k in range(1, len(low) + 1)) or low in end
    return "*" + tail if overlap else f"*{_escaped(literal)}*{tail}"


def _select_files(raw: DataFrame, suffix: str, literal: str | None) -> DataFrame:
    # from the path, because the name in the metadata is percent-encoded
    name = F.substring_index("path", "/", -1).alias("filename")
    named = raw.select("path", name, "content")
    return named.where(name_matches(F.col("filename"), suffix, literal))


def read_folder(
    spark: SparkSession, folder: str, suffix: str = ".pdf", literal: str | None = None
) -> DataFrame:
    """Files of one folder, not its sub-folders: ``path, filename, content``.

    The name rules are part of the listing, because a filter on the name column
    would not keep the content of other files from being read.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffix, literal))
    visible = _select_files(raw.load(folder), suffix, literal)
    hidden = read_hidden(spark, folder, suffix, literal)
    return visible if hidden is None else visible.unionByName(hidden)


def read_hidden(
    spark: SparkSession, folder: str, suffix: str = ".pdf", literal: str | None = None
) -> DataFrame | None:
    """The files whose names start with ``_`` or ``.``, if there are any.

    Spark's file sources pass over such names without a word. Their paths are
    listed here, ``MAX_HIDDEN`` at most, and the files are opened in the tasks.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(folder)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in system.globStatus(hadoop.Path(base, "{_,.}*")) or []:
        name = status.getPath().getName()
        seen = name.startswith("_") and "=" in name  # such names are read anyway
        rules = name.lower().endswith(suffix.lower()) and (literal or "") in name
        if status.isFile() and rules and not seen:
            rows.append((status.getPath().toString(), name))
    if not rows:
        return None
    if len(rows) > MAX_HIDDEN:
        raise ValueError(f"more than {MAX_HIDDEN} files of {folder} start with '_' or '.'")
    paths = spark.createDataFrame(rows, "path string, filename string")
    paths = paths.repartition(min(len(rows), spark.sparkContext.defaultParallelism))
    return paths.select("path", "filename", _opened(F.col("path")).alias("content"))


def _opened(path: Column) -> Column:
    """The bytes of each file, read in the tasks."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            contents = []
            for uri in batch.to_pylist():
                scheme, _, rest = uri.partition(":")
                scheme = _OTHER_NAMES.get(scheme, scheme)
                if scheme == "file":
                    system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    system, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
                with system.open_input_file(name) as f:
                    contents.append(f.read())
            yield pa.array(contents, pa.binary())

    return run.asNondeterministic()(path)


def stream_folder(
    spark: SparkSession,
    folder: str,
    suffix: str = ".pdf",
    literal: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The same rows as a stream of newly arrived files.

    ``max_files`` bounds one micro-batch, so a large backlog is worked off in
    steps that each commit their progress. Names that start with ``_`` or ``.``
    never arrive in a stream; see ``read_hidden``.
    """
    raw = spark.readStream.format("binaryFile").schema(_BINARY_FILE)
    raw = raw.option("pathGlobFilter", _glob(suffix, literal))
    if max_files is not None:
        raw = raw.option("maxFilesPerTrigger", max_files)
    return _select_files(raw.load(folder), suffix, literal)


def utf8_text(content: bytes) -> str:
    """The plainest extractor: the bytes are the text."""
    return content.decode("utf-8")


def extracted(content: Column, extractor: Callable[[bytes], str]) -> Column:
    """``struct<text, error>`` of a caller's extractor run on each file.

    A file that cannot be read gives an error and no text; the job goes on.
    Only the content crosses to Python, in Arrow batches.
    """

    @F.arrow_udf(EXTRACTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, errors = [], []
            for value in batch:
                try:
                    texts.append(extractor(value.as_py()))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"extraction failed: {type(e).__name__}: {e}")
            yield pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                names=["text", "error"],
            )

    # never evaluated twice, whatever filter is put on its result
    return run.asNondeterministic()(content)
