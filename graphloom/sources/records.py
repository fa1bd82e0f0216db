"""Record files, canonical folders, audit lines, dropped files and CSV tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import looks_binary
from graphloom.session import reach_workers, written

RECORD = "id string, draft struct<type:string,title:string,bodyMd:string,jsonld:string,piId:string>, updatedAtUtc string, actor string, kind string, policyDecisionId string"


def read_records(spark: SparkSession, path: str, kind: str = "draft", multi_line: bool = True) -> DataFrame:
    """Node rows of JSON records; broken ones and those without an id are skipped, canonical ones need a type.

    Files hold one record each, or one per line without ``multi_line``. For what :func:`write_canonical` writes, see :func:`canonical_rows`.
    """
    raw = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return node_rows(raw.select("*", F.col("_metadata.file_path").alias("source_path")), kind)


def node_rows(raw: DataFrame, kind: str) -> DataFrame:
    """Node rows of records with their ``source_path``, of a batch or of a stream."""
    rows = raw.select(
        "id", F.coalesce(F.when(F.col("draft.type") != "", F.col("draft.type")), F.lit("draft") if kind == "draft" else F.lit(None).cast("string")).alias("type"),
        F.col("draft.title").alias("title"), F.col("draft.bodyMd").alias("body_md"),
        F.when(F.col("draft.jsonld") != "", F.col("draft.jsonld")).otherwise(F.to_json("draft")).alias("jsonld"),
        F.coalesce(F.get_json_object("draft.jsonld", "$.piId"), "draft.piId").alias("pi_id"),
        F.lit(kind).alias("kind"), F.coalesce("updatedAtUtc", F.lit("1970-01-01T00:00:00Z")).alias("updated_at_utc"), "source_path",
    )
    return rows.where("id is not null and id <> '' and type is not null")


_COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", RECORD).split(",")]


def _latest(rows: DataFrame) -> DataFrame:
    """The latest record of each id, of equal ones the greatest draft; those without id or type go."""
    known = rows.where("id is not null and id <> '' and draft.type <> ''")
    return known.groupBy("id").agg(F.max_by(F.struct(*_COLUMNS), F.struct(F.coalesce("updatedAtUtc", F.lit("")), F.to_json("draft"))).alias("r")).select("r.*")


def _put(rows: DataFrame, path: str) -> None:
    """Add records to the folders of their types, which are a closed vocabulary, so that there are few."""
    for (node_type,) in rows.select("draft.type").distinct().orderBy("type").collect():
        rows.where(F.col("draft.type") == node_type).write.mode("append").json(f"{path}/{node_type}s")


def write_canonical(records: DataFrame, path: str) -> None:
    """Add records to folders named ``<type>s`` as JSON lines, the latest of each id of the batch.

    ``records`` has the columns of :data:`RECORD`. A batch adds files and changes none, so it writes in proportion to
    itself. A folder may hold several records of an id, and so may two folders if its type has changed: readers take the latest
    (:func:`read_canonical`). A batch that fails half-way may be written again.
    """
    _put(written(_latest(records.select(*_COLUMNS)), "canonical"), path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each id in the folders of :func:`write_canonical`, in the columns of :data:`RECORD`."""
    return _latest(spark.read.schema(RECORD).option("recursiveFileLookup", True).json(path).select(*_COLUMNS))


def canonical_rows(spark: SparkSession, path: str) -> DataFrame:
    """Node rows of the latest records."""
    return node_rows(read_canonical(spark, path).withColumn("source_path", F.concat(F.lit(f"{path}/"), "draft.type", F.lit("s"))), "canonical")


def compact_canonical(spark: SparkSession, path: str) -> None:
    """Write the latest records again and take the files before them away; no writer may be at work.

    The new files are whole before an old one goes: a failure in between leaves records twice, which readers do not see.
    """
    old = [r[0] for r in spark.read.schema(RECORD).option("recursiveFileLookup", True).json(path).select(F.input_file_name()).distinct().collect()]  # names of files
    if old:
        _put(written(read_canonical(spark, path), "canonical"), path)
        for name in old:
            file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)


def append_audit(rows: DataFrame, path: str) -> None:
    """One JSON line ``{kind, timestamp, body}`` per row."""
    rows.select(F.to_json(F.struct("kind", "timestamp", "body")).alias("value")).write.mode("append").text(path)


#: Extensions of images, and MIME types that name a format whatever the extension.
IMAGES = ("svg", "png", "jpg", "jpeg", "gif", "webp", "bmp")
FORMAT_MIMES = {
    "pdf": ["application/pdf"], "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "pptx": ["application/vnd.openxmlformats-officedocument.presentationml.presentation"], "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "csv": ["text/csv", "application/csv", "application/vnd.ms-excel"], "msg": ["application/vnd.ms-outlook", "application/x-outlook-msg"],
}


def format_of(name: Column, content: Column, mime: Column) -> Column:
    """Format of a file by its first bytes, extension and MIME type, in that order of trust; ``rejected`` for what is none of them and no text."""
    head, ext, mime = F.hex(F.substring(content, 1, 4)), F.lower(F.substring_index(name, ".", -1)), F.lower(F.coalesce(mime, F.lit("")))
    named = lambda f: (ext == f) | mime.isin(FORMAT_MIMES[f])
    ole = head == "D0CF11E0"
    # a ZIP without extension is told apart by the folders in it
    inside = F.decode(content, "ISO-8859-1")
    zipped = F.when(F.contains(inside, F.lit("word/")), "docx").when(F.contains(inside, F.lit("ppt/")), "pptx").when(F.contains(inside, F.lit("xl/")), "xlsx")
    markdown = ext.isin("md", "markdown", "mdown") | mime.isin("text/markdown", "text/x-markdown")
    return (
        F.when((head == "25504446") | named("pdf"), "pdf").when(named("docx"), "docx").when(named("pptx"), "pptx").when(named("xlsx"), "xlsx").when(named("csv"), "csv")
        .when(head.startswith("504B") & (ext == "") & zipped.isNotNull(), zipped).when(named("msg"), "msg").when(ext.isin("doc", "xls", "ppt"), "legacy-office").when(ole, "rejected")
        .when(ext.isin(*IMAGES) | mime.startswith("image/"), "image").when(looks_binary(content), "rejected").when(markdown, "md").otherwise("txt")
    )


def route_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, format)`` of dropped files; see :func:`format_of`. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", "length", format_of(name, F.col("content"), F.lit("")).alias("format"))


def cells_of(text: str) -> list[list[str]]:
    """Rows of a CSV text: quotes anywhere hold commas and line ends, doubled ones are quotes; CR is dropped outside them.

    Trailing rows without any text go, and rows are filled up to the widest.
    """
    rows, row, field, at = [], [], [], 0
    for m in re.finditer(r'"((?:[^"]|"")*)(?:"|$)|([,\n])|\r|[^",\r\n]+', text):
        if m[2] is None:
            field.append(m[1].replace('""', '"') if m[1] is not None else m[0] if m[0] != "\r" else "")
            continue
        row.append("".join(field))
        field = []
        if m[2] == "\n":
            rows.append(row)
            row = []
    if row or "".join(field):
        rows.append([*row, "".join(field)])
    while rows and not any(rows[-1]):
        rows.pop()
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def read_csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(path, rows)``: one table per CSV file, ragged rows filled up; a narrow map over files.

    For files of regular rows that are too large for one row of Spark, use :func:`read_csv_rows`.
    """
    reach_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [cells_of(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables, pa.list_(pa.list_(pa.string())))], ["path", "rows"])

    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, "path string, rows array<array<string>>")


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV cells as string columns with Spark's own reader: quotes doubled inside quotes, quoted line breaks kept."""
    return spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("header", False).csv(path)


def save_index(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, path: str):
    """The index tables below ``path``: nodes by type, edges by predicate, vectors, and the lexical index, which is returned."""
    from graphloom.operators.search import store_index

    nodes.write.partitionBy("type").mode("overwrite").parquet(f"{path}/nodes")
    edges.write.partitionBy("predicate").mode("overwrite").parquet(f"{path}/edges")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    index = store_index(nodes, path)
    if index.blocks is None:
        # an index that is read at once has only its lists; a saved one has postings and terms as tables
        index.postings.write.mode("overwrite").parquet(f"{path}/postings")
        index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    return index
