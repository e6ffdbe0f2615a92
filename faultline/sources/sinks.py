"""Sinks: fixed-width tables, JSON, gates for CI, Markdown summaries, keyed files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One column, line: the given columns padded to their widths (longer values stand whole), the last unpadded."""
    names = [*widths]
    cells: list[Column] = []
    for name in names:
        v = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cells.append(v if name == names[-1] else F.when(F.length(v) < widths[name], F.rpad(v, widths[name], " ")).otherwise(v))
    return df.select(F.concat_ws(" ", *cells).alias("line"))


def json_lines(df: DataFrame, omit_zero: list[str] | None = None) -> DataFrame:
    """One column, json; columns in ``omit_zero`` are left out where they are empty or 0."""
    for name in omit_zero or []:
        kind = df.schema[name].dataType.typeName()
        df = df.withColumn(name, F.nullif(F.col(name), F.lit("") if kind == "string" else F.lit(0).cast(kind)))
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def limited_json(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """JSON of the filtered, limited rows."""
    return json_lines(df.orderBy(*order).limit(limit))


def markdown_summary(counts: dict[str, int], decision: str, path: str) -> None:
    """A review's summary appended to a Markdown file on the driver."""
    lines = [f"## Review: {decision}", "", "| level | count |", "|---|---|", *(f"| {k} | {v} |" for k, v in counts.items()), ""]
    with Path(path).open("a", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")


def exit_code(df: DataFrame) -> int:
    """The status of a gate's one row."""
    return int(df.first()[0])


def project_yaml(project: str, criticality: str, components: list[tuple[str, str]], path: str) -> None:
    import yaml

    body = yaml.safe_dump({"project": project, "criticality": criticality, "components": [{"name": n, "path": p} for n, p in components]}, sort_keys=False)
    Path(path).write_text("# Project configuration\n" + body, encoding="utf-8")


def managed_block(text: str, block: str, begin: str, end: str) -> str:
    """``text`` with what stands between two markers replaced, or the block added; unchanged if it is there already."""
    whole = f"{begin}\n{block.strip()}\n{end}"
    if begin in text and end in text[text.index(begin) :]:
        head, rest = text.split(begin, 1)
        return head + whole + rest.split(end, 1)[1]
    return (text.rstrip() + "\n\n" if text.strip() else "") + whole + "\n"


def overwrite_keyed(df: DataFrame, path: str, format: str = "json") -> None:
    """A table written over the one it was read from: through a copy beside it, which takes its place.

    The old table is set aside before and deleted last, so at any moment one of the two is whole: after a crash in
    between, the next call first puts a table back that was set aside and not replaced.
    """
    spark = df.sparkSession
    fresh, aside = path.rstrip("/") + "._new", path.rstrip("/") + "._old"
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def moved(source: str, target: str) -> None:
        if not system.rename(jvm.Path(source), jvm.Path(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    restore_keyed(spark, path)
    df.write.mode("overwrite").format(format).save(fresh)
    if system.exists(jvm.Path(path)):
        moved(path, aside)
    moved(fresh, path)
    system.delete(jvm.Path(aside), True)


def restore_keyed(spark: SparkSession, path: str) -> None:
    """Puts back the table that an interrupted :func:`overwrite_keyed` set aside, or deletes it where its successor is in place."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at, aside = jvm.Path(path), jvm.Path(path.rstrip("/") + "._old")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(aside):
        if system.exists(at):
            system.delete(aside, True)
        else:
            system.rename(aside, at)


BUCKETS = 64


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and what makes a path of a string."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _renamed(system, source, target) -> None:
    if not system.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def finish_keyed(spark: SparkSession, path: str) -> None:
    """Does the rest of a change of :func:`upsert_keyed` or :func:`delete_keyed` that was written whole but not put in place whole."""
    path = path.rstrip("/")
    system, make = _files(spark, path)
    ready = make(f"{path}._ready")
    if not system.exists(ready):
        return
    system.mkdirs(make(path))
    for found in system.listStatus(ready):
        name = found.getPath().getName()
        if name.startswith("_bucket="):
            target = make(f"{path}/{name}")
            system.delete(target, True)
            _renamed(system, found.getPath(), target)
    system.delete(ready, True)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table that is kept in buckets by key; ``schema`` is that of its rows. No table is an empty one."""
    finish_keyed(spark, path)
    system, make = _files(spark, path)
    empty = spark.createDataFrame([], schema)
    if not system.exists(make(path)):
        return empty
    return spark.read.schema(empty.schema.add("_bucket", "integer")).parquet(path).drop("_bucket")


def _changed(new: DataFrame, path: str, keys: list[str], buckets: int, change) -> None:
    spark, path = new.sparkSession, path.rstrip("/")
    finish_keyed(spark, path)
    system, make = _files(spark, path)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    # No more of them than the table has buckets.
    touched = [r[0] for r in new.select(bucket).distinct().collect()]
    if not touched:
        return
    schema = change.schema
    old = spark.createDataFrame([], schema)
    if system.exists(make(path)):
        old = spark.read.schema(old.schema.add("_bucket", "integer")).parquet(path).filter(F.col("_bucket").isin(touched)).drop("_bucket")
    step = f"{path}._step"
    rows = change(old).select(*old.columns).withColumn("_bucket", bucket)
    rows.repartition(min(buckets, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(step)
    for b in touched:  # a bucket that nothing is left of takes the place of what was there, too
        system.mkdirs(make(f"{step}/_bucket={b}"))
    # From here on the change holds: what is ready is put in place, now or by whoever looks at the table next.
    _renamed(system, make(step), make(f"{path}._ready"))
    finish_keyed(spark, path)


class _Change:
    def __init__(self, schema, make):
        self.schema, self.make = schema, make

    def __call__(self, old: DataFrame) -> DataFrame:
        return self.make(old)


def upsert_keyed(new: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Puts rows in place of those of equal keys in a table in ``buckets`` by a hash of the keys, or adds them; of equal keys the last one stays.

    Only buckets that the new rows are in are read and written, beside the table, whole; then they take their places.
    After a crash the table is the old one until all is written, and the new one from then on, as :func:`read_keyed` and
    the next change put in place what is left. One change at a time; a table has the same buckets throughout.
    """
    from faultline.operators.graph import upsert

    _changed(new, path, keys, buckets, _Change(new.schema, lambda old: upsert(old, new, keys)))


def delete_keyed(gone: DataFrame, path: str, schema, buckets: int = BUCKETS) -> None:
    """Deletes the rows whose keys, all columns of ``gone``, are there; see :func:`upsert_keyed`."""
    keys = gone.columns
    _changed(gone, path, keys, buckets, _Change(schema, lambda old: old.join(gone.distinct(), keys, "left_anti")))
