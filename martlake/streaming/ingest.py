"""Incremental file ingestion into the raw layer: Structured Streaming, lineage, evolving columns, rescued values.

A query reads the files of an entity's landing folder that its checkpoint hasn't seen, adds lineage and appends each
micro-batch to a versioned table under its batch id, so a retried batch is written once.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlake.sources.contracts import LINEAGE, contract
from martlake.sources.store import Store, Table
from martlake.streaming.schema_log import Column as Added
from martlake.streaming.schema_log import SchemaLog

RESCUED = "_rescued_data"
#: Files that a micro-batch takes at most; their names pass through the driver.
MAX_FILES = 10_000
#: Footers that are read at once.
FOOTER_THREADS = 16
#: Fixed value: the folder of a batch.
BATCH_PATTERN = r"/(batch_\d+)/"


def options(entity: str, state_path: str) -> dict[str, str]:
    """Options of the entity's stream: its own checkpoint, files below batch folders, types never inferred."""
    contract(entity)
    return {"recursiveFileLookup": "true", "mergeSchema": "false", "checkpointLocation": f"{state_path.rstrip('/')}/{entity}"}


def read_stream(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The entity's files as text columns, as they arrive."""
    return spark.readStream.schema(contract(entity).landing()).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", MAX_FILES).parquet(path)


def batch_of(path: Column) -> Column:
    """The batch folder in a file's path, null where there is none."""
    return F.nullif(F.regexp_extract(path, BATCH_PATTERN, 1), F.lit(""))


def add_lineage(df: DataFrame, run_id: str) -> DataFrame:
    """Time, file, batch (from the path, never from a parameter) and run of each row."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.current_timestamp().alias("_ingestion_timestamp"), path.alias("_source_file"), batch_of(path).alias("_batch_id"), F.lit(run_id).alias("_pipeline_run_id"))


@dataclass(frozen=True)
class Footers:
    """A micro-batch's files by their schema, and the files that have none that can be read, with the reason."""

    groups: list[tuple[T.StructType, list[str]]]
    unreadable: list[tuple[str, str]]


def footers(spark: SparkSession, files: list[str]) -> Footers:
    """Group files by the schema in their footers, which are read side by side; of a file nothing else is read.

    The names of a micro-batch (``MAX_FILES`` at most) and a footer's text for each are all that the driver holds.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def schema_of(file: str) -> tuple[str | None, str]:
        try:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
            try:
                return reader.getFooter().getFileMetaData().getSchema().toString(), ""
            finally:
                reader.close()
        except Exception as e:
            return None, str(getattr(e, "java_exception", e)).splitlines()[0][:500]

    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        found = list(pool.map(schema_of, files))
    groups: dict[str, list[str]] = {}
    for file, (schema, _) in zip(files, found, strict=True):
        if schema is not None:
            groups.setdefault(schema, []).append(file)
    return Footers([(spark.read.parquet(own[0]).schema, own) for own in groups.values()], [(f, why) for f, (s, why) in zip(files, found, strict=True) if s is None])


def exact_names(spark: SparkSession) -> SparkSession:
    """A session beside this one that tells names apart by case, as files may."""
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def _text(name: str, kind: T.DataType) -> Column:
    """A column as text; nested values as JSON."""
    own = F.col(f"`{name}`")
    return F.to_json(own) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else own.cast("string")


def new_columns(schema: T.StructType, entity: str, run_id: str) -> list[Added]:
    """The columns of a file that the contract lacks and that can become columns: those whose name differs from all
    others by more than case."""
    taken = {c.lower() for c in (*contract(entity).columns, RESCUED, *LINEAGE, "__file")}
    out = []
    for f in schema:
        if f.name.lower() not in taken:
            taken.add(f.name.lower())
            out.append(Added(f.name, f.dataType.simpleString(), run_id))
    return out


def as_text(spark: SparkSession, files: list[str], schema: T.StructType, columns: list[str]) -> DataFrame:
    """The rows of files of one schema: the named columns as text (null where the files lack one), all other columns as
    JSON in ``_rescued_data`` (null if nothing is left), and the file."""
    raw = spark.read.schema(schema).parquet(*files)
    kinds = {f.name: f.dataType for f in schema}
    own = [(_text(c, kinds[c]) if c in kinds else F.lit(None).cast("string")).alias(c) for c in columns]
    rest = [c for c in kinds if c not in columns]
    kept = F.to_json(F.struct(*(_text(c, kinds[c]).alias(c) for c in rest))) if rest else F.lit(None).cast("string")
    return raw.select(*own, F.nullif(kept, F.lit("{}")).alias(RESCUED), F.col("_metadata.file_path").alias("__file"))


def as_written(spark: SparkSession, found: Footers, columns: list[str]) -> DataFrame:
    """The rows of all groups, each cast on its own, so an int, a timestamp and a text of one name meet as text."""
    parts = [as_text(spark, files, schema, columns) for schema, files in found.groups]
    return reduce(DataFrame.unionByName, parts)


def raw_schema(entity: str, added: Iterable[str] = ()) -> T.StructType:
    text = [T.StructField(n, T.StringType()) for n in (*contract(entity).columns, RESCUED)]
    kinds = {"_ingestion_timestamp": T.TimestampType()}
    return T.StructType([*text, *(T.StructField(n, kinds.get(n, T.StringType())) for n in LINEAGE), *(T.StructField(n, T.StringType()) for n in added)])


REJECTED = "file string, reason string, _rejected_at timestamp, _pipeline_run_id string"


def ingest(
    spark: SparkSession, landing: str, entity: str, table: Table, state_path: str, run_id: str, with_rescue: bool = True, evolve: bool = False, rejected: Table | None = None
) -> int:
    """Append all files that weren't seen before to the raw table; the number of rows it has then.

    Files of a micro-batch may differ in their columns and types: they're grouped by the schema in their footers, and
    each group is cast to text on its own. With ``evolve``, a column that the contract lacks becomes a column of the raw
    table (text; null in older rows) through the entity's schema log below ``state_path``; without it, and for names
    that differ from another in case alone, values go to ``_rescued_data`` as JSON. Files whose footer or pages can't be read
    are set aside in ``rejected`` (by default a table beside the raw one) with the reason, and don't stop the entity;
    they're passed over for good, as their names count as seen. ``with_rescue`` off reads text files of the contract's
    columns only, as a plain stream.
    """
    log = SchemaLog(spark, f"{state_path.rstrip('/')}/_schemas/{entity}")
    aside, exact = rejected or Table(spark, f"{table.path}_rejected"), exact_names(spark)
    table.create(raw_schema(entity))

    def set_aside(files: list[tuple[str, str]], batch_id: int) -> None:
        rows = [(f, why, datetime.now(), run_id) for f, why in files]
        aside.append(spark.createDataFrame(rows, REJECTED), batch_id=batch_id)

    def add(rows: DataFrame, added: list[str], batch_id: int) -> None:
        lineage = {"_ingestion_timestamp": F.current_timestamp(), "_source_file": F.col("__file"), "_batch_id": batch_of(F.col("__file")), "_pipeline_run_id": F.lit(run_id)}
        table.append(rows.withColumns(lineage).select(*(F.col(f"`{c}`") for c in raw_schema(entity, added).names)), merge_schema=True, batch_id=batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not with_rescue:
            add(batch.withColumn(RESCUED, F.lit(None).cast("string")), [], batch_id)
            return
        files = sorted(r["__file"] for r in batch.distinct().collect())  # the names of the micro-batch's files
        found = footers(exact, files)
        added = []
        if evolve:
            added = [c.name for c in log.evolve(c for schema, _ in found.groups for c in new_columns(schema, entity, run_id))]
        unreadable = found.unreadable
        if found.groups:
            try:
                add(as_written(exact, found, [*contract(entity).columns, *added]), added, batch_id)
            except Exception:
                # footers are whole but a file may not be: find those that can't be read, and write the others
                broken = [x for schema, own in found.groups for x in damaged(exact, own, schema)]
                if not broken:
                    raise
                bad = {f for f, _ in broken}
                whole = Footers([(s, kept) for s, own in found.groups if (kept := [f for f in own if f not in bad])], [])
                unreadable = [*unreadable, *broken]
                if whole.groups:
                    add(as_written(exact, whole, [*contract(entity).columns, *added]), added, batch_id)
        if unreadable:
            set_aside(unreadable, batch_id)

    path = f"{landing.rstrip('/')}/{entity}"
    if with_rescue:  # the stream only finds files; each batch is then read with whatever columns and types it has
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", MAX_FILES).load(path).select(F.col("path").alias("__file"))
    else:
        files = read_stream(spark, path, entity).select("*", F.col("_metadata.file_path").alias("__file"))
    own = options(entity, state_path)
    query = files.writeStream.foreachBatch(write).option("checkpointLocation", own["checkpointLocation"]).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read().count()


def damaged(spark: SparkSession, files: list[str], schema: T.StructType) -> list[tuple[str, str]]:
    """The files whose pages can't be read, with the reason; halves that can be read whole are left at once."""
    try:
        spark.read.schema(schema).parquet(*files).write.format("noop").mode("overwrite").save()
        return []
    except Exception as e:
        if len(files) == 1:
            return [(files[0], str(e).splitlines()[0][:500])]
    half = len(files) // 2
    return damaged(spark, files[:half], schema) + damaged(spark, files[half:], schema)


def ingest_all(spark: SparkSession, landing: str, store: Store, state_path: str, run_id: str, entities: Iterable[str]) -> dict[str, int]:
    return {e: ingest(spark, landing, e, store.table("bronze", f"{e}_raw"), state_path, run_id, evolve=True) for e in entities}


def append_stream(df: DataFrame, path: str, checkpoint: str) -> None:
    """A plain streaming append to Parquet files, until all there is has been read."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
