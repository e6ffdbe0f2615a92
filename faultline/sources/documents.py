"""Sources: JSON of either root, hazard documents, manifests, YAML, archives, lists of files, tables."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.schemas import SCHEMAS


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): each file's whole text, for roots of either kind."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def json_string(spark: SparkSession, text: str) -> DataFrame:
    """A document given as a string, as from standard input."""
    return spark.createDataFrame([("-", text)], "file string, value string")


def submission(spark: SparkSession, stdin: str | None = None, path: str | None = None) -> DataFrame:
    """Standard input before a file; neither is an error."""
    if stdin is not None:
        return json_string(spark, stdin)
    if path:
        return json_texts(spark, path)
    raise ValueError("give a submission on standard input or as a file")


def relation(spark: SparkSession, name: str, path: str, format: str = "json") -> DataFrame:
    """A catalogued relation from files: explicit schema, missing strings and numbers filled, arrays and nullable columns left."""
    reader = spark.read.schema(SCHEMAS[name])
    df = (reader.option("multiLine", True) if format == "json" else reader).format(format).load(path)
    return zero_filled(df)


NULLABLE = {"average_mttr", "git_hash", "verified_at", "delay_seconds", "business_criticality"}


def zero_filled(df: DataFrame) -> DataFrame:
    """Missing strings as '' and numbers as 0, but for columns in which null means something."""
    own = [f for f in df.schema.fields if f.name not in NULLABLE]
    text = [f.name for f in own if f.dataType.typeName() == "string"]
    numbers = [f.name for f in own if f.dataType.typeName() in ("integer", "long", "double", "float")]
    return df.na.fill("", text).na.fill(0, numbers)


def enveloped(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Rows up to a limit, and the total before it."""
    return rows.limit(limit), rows.count()


def hazard_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["hazard_document"]).option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, algorithm, key_id, signature, path, hash) in long form."""
    df = spark.read.schema(SCHEMAS["integrity_manifest"]).option("multiLine", True).json(path)
    return df.select("version", "algorithm", "key_id", "signature", F.explode("files").alias("path", "hash"))


def project_config(spark: SparkSession, text: str) -> DataFrame:
    """The project file's one row; needs a YAML library."""
    import yaml

    found = yaml.safe_load(text) or {}
    rows = [(str(found.get("project") or ""), str(found.get("criticality") or ""), [(str(c.get("name") or ""), str(c.get("path") or "")) for c in found.get("components") or []])]
    return spark.createDataFrame(rows, SCHEMAS["project_config"])


def project_file(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The row of the first project file of ``names`` (the current name, then former ones) that ``folder`` has; no row without one.

    Files are left under the names they have.
    """
    for name in names:
        at = f"{folder.rstrip('/')}/{name}"
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            # Names may begin with a dot, which file sources leave out.
            stream = system.open(path)
            try:
                return project_config(spark, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return spark.createDataFrame([], SCHEMAS["project_config"])


#: Bytes of a member that are in one row.
PIECE = 4 << 20


class _Lines(io.RawIOBase):
    """Lines without their ends, read as the bytes that they were cut from."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.rest, self.started = lines, memoryview(b""), False

    def read(self, size: int = -1) -> bytes:
        out, left = [], size
        while left:
            if not self.rest:
                line = next(self.lines, None)
                if line is None:
                    break
                self.rest = memoryview(b"\n" + line if self.started else line)
                self.started = True
                continue
            piece = self.rest[:left]
            self.rest = self.rest[len(piece) :]
            out.append(bytes(piece))
            left -= len(piece)
        return b"".join(out)


def members(rows: Iterator[tuple[str, bytes]], piece: int = PIECE) -> Iterator[tuple[str, str | None, int, bytes | None]]:
    """(archive, path, number, content) of each piece of the regular files of tar archives, given as (archive, line).

    No more than a piece and a line are held. An archive that is no tar, or is cut, ends with a row whose path is null.
    """
    for archive, own in groupby(rows, key=lambda r: r[0]):
        stream = _Lines(line for _, line in own)
        try:
            with tarfile.open(fileobj=stream, mode="r|") as found:
                for m in found:
                    if not m.isfile():
                        continue
                    content, number = found.extractfile(m), 0
                    while True:
                        part = content.read(piece)
                        if part or not number:
                            yield archive, m.name.removeprefix("./"), number, part
                        if len(part) < piece:
                            break
                        number += 1
        except tarfile.TarError:
            yield archive, None, 0, None


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archive, line): the unpacked bytes of gzip files, cut at line ends and in order; one task unpacks one archive.

    Spark unpacks files whose names end in .gz as it reads them, so none is held whole, whatever its size; a line end must
    come within the 2 GB that a value may have.
    """
    return spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("line"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)))


def archive_members(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(archive, path, number, content): the regular files of tar.gz archives in pieces of at most ``piece`` bytes, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in members(_rows(batches), piece):
            if row[1] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.int32(), pa.binary()))], ["archive", "path", "number", "content"])

    return archive_lines(spark, path).mapInArrow(run, "archive string, path string, number int, content binary")


#: The largest file that is kept whole beside its hash.
KEPT = 64 << 20


def archive_hashes(spark: SparkSession, path: str, keep: str = "integrity.manifest.json") -> DataFrame:
    """(archive, path, size, hash, content) of the regular files of tar.gz archives, and a row with a null path of each that can't be read to its end.

    content is null but for files named ``keep`` of at most ``KEPT`` bytes. Of members of one name the last counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def out(row):
            archive, name, size, digest, content = row
            whole = b"".join(content) if name == keep and size <= KEPT else None
            columns = zip((archive, name, size, None if name is None else "sha256:" + digest.hexdigest(), whole), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], ["archive", "path", "size", "hash", "content"])

        for archive, name, number, part in members(_rows(batches)):
            if number == 0:
                if state:
                    yield out(state)
                state = [archive, name, 0, hashlib.sha256(), []]
            if part is not None:
                state[2] += len(part)
                state[3].update(part)
                if name == keep and state[2] <= KEPT:
                    state[4].append(part)
        if state:
            yield out(state)

    rows = archive_lines(spark, path).mapInArrow(run, "archive string, path string, size long, hash string, content binary").withColumn("_n", F.monotonically_increasing_id())
    own = F.struct("size", "hash", "content")
    return rows.groupBy("archive", "path").agg(F.max_by(own, "_n").alias("o")).select("archive", "path", "o.*")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file that are not blank, as of changed files."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).withColumnRenamed("value", "path")


#: Files whose content says what components a tree has.
READ = ["go.work", "Cargo.toml", "package.json", "pom.xml", "settings.gradle", "settings.gradle.kts", "*.sln", "melos.yaml", "pubspec.yaml"]


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, content) of the files under ``root``/<repo>/.

    Only files whose names are in ``READ`` are opened, content of the others is null: they are listed, not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    below = ".*?" + re.escape(root.strip("/")) + "/([^/]+)/(.+)$"
    place = [F.regexp_extract("path", below, 1).alias("repo"), F.regexp_extract("path", below, 2).alias("path")]
    read = files.option("pathGlobFilter", "{" + ",".join(READ) + "}").load(root).select(*place, F.col("content").cast("string").alias("content"))
    # Without content among the columns, the source opens no file.
    listed = files.option("pathGlobFilter", "*").load(root).select(*place)
    name = F.element_at(F.split("path", "/"), -1)
    others = listed.filter(~(name.isin([x for x in READ if "*" not in x]) | name.rlike("|".join(re.escape(x[1:]) + "$" for x in READ if "*" in x))))
    return read.unionByName(others.withColumn("content", F.lit(None).cast("string")))


def installs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the registries that can be read; none is an empty table."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.schema(SCHEMAS["plugin_install"]).option("multiLine", True).json(path)
    return spark.createDataFrame([], SCHEMAS["plugin_install"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
