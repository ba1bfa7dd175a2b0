"""Raw texts, pages, images, ledgers, word lists and vocabularies as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomwright.functions import text as T
from loomwright.operators.ingest import check_images
from loomwright.schemas import DECISION, LEVELS, SIDECAR, USAGE
from loomwright.sources.named_files import read_files, write_files

try:
    import pypdf
except ImportError:  # only the text layer of PDF files needs it
    pypdf = None


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of UTF-8 files; bytes that are not UTF-8 fail the read."""
    files = read_files(spark, path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    return files.select("path", text.alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with ``media_type`` and ``error``; Spark's reader has no row for an empty file."""
    return check_images(spark.read.format("binaryFile").load(path))


def split_pages(documents: DataFrame, mark: str = "\f") -> DataFrame:
    """``doc_id, page, text`` of texts whose pages a mark separates; pages count from 1."""
    return documents.select("doc_id", F.posexplode(F.split("text", mark)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path, page, text`` of the text layer of PDF files."""
    if pypdf is None:
        raise RuntimeError("pypdf is needed to read PDF files")

    def run(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            rows = [(p, k, page.extract_text() or "") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, page in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages, 1)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, text string")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: Fields of a sidecar that are always written, also when they are null; the others are left out then.
ALWAYS = ("source_id", "original_path", "content_sha256", "ingested_at", "chars", "model", "provider", "candidate_count")


def sidecar_json(sidecars: DataFrame) -> DataFrame:
    """``source_id, json`` with the constant keys, null or not, and those others that are there."""
    rest = [c for c in sidecars.columns if c not in ALWAYS]
    head = F.to_json(F.struct(*ALWAYS), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    both = F.expr("concat(substring(head, 1, length(head) - 1), ',', substring(tail, 2))")
    return sidecars.select("source_id", head.alias("head"), tail.alias("tail")).select("source_id", F.when(F.col("tail") == "{}", F.col("head")).otherwise(both).alias("json"))


def write_sidecars(sidecars: DataFrame, folder: str) -> None:
    """One ``<source_id>.json`` a source."""
    write_files(sidecar_json(sidecars).select(F.concat("source_id", F.lit(".json")).alias("name"), F.col("json").alias("text")), folder)


def with_sidecars(ids: DataFrame, texts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``source_id, text, sidecar`` of wanted ids: null where there is no raw text, or no sidecar."""
    side = sidecars.select("source_id", F.struct(*sidecars.columns).alias("sidecar"))
    return ids.select("source_id").join(texts.select("source_id", "text"), "source_id", "left").join(side, "source_id", "left")


def read_decisions(spark: SparkSession, path: str) -> DataFrame | None:
    """The decision ledger; ``None`` if there is none (which is not an empty one). A bad line fails the read."""
    return spark.read.schema(DECISION).option("mode", "FAILFAST").json(path) if exists(spark, path) else None


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage ledger; a missing one is empty."""
    return spark.read.schema(USAGE).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], USAGE)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def read_wordlists(spark: SparkSession, folder: str) -> DataFrame:
    """``lemma, level`` of ``a1.txt`` to ``c2.txt``; comments and blanks go, missing lists are no signal."""
    try:
        raw = spark.read.format("text").option("pathGlobFilter", "[abc][12].txt").load(folder).select("value", F.input_file_name().alias("file"))
    except AnalysisException:
        return spark.createDataFrame([], "lemma string, level string")
    level = F.upper(F.regexp_extract("file", r"([abc][12])\.txt$", 1))
    bare = T.strip(F.col("value"))
    return raw.where((bare != "") & ~bare.startswith("#") & level.isin(list(LEVELS))).select(bare.alias("lemma"), level.alias("level")).distinct()


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``tag`` of a list with one a line."""
    return spark.read.text(path).select(T.norm_tag(F.col("value")).alias("tag")).where("tag <> '' and not startswith(tag, '#')").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``alias, canonical`` of lines ``alias: tag``; comments and blank lines go, quotes and case don't matter."""
    line = F.regexp_replace("value", r"\s*#.*$", "")
    bare = lambda x: T.norm_tag(F.regexp_replace(T.strip(x), r"^['\"]|['\"]$", ""))
    pair = F.split(line, ":", 2)
    rows = spark.read.text(path).where(F.contains(line, F.lit(":"))).select(bare(pair[0]).alias("alias"), bare(pair[1]).alias("canonical"))
    return rows.where("alias <> '' and canonical <> ''").dropDuplicates(["alias"])


def read_cache(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], key: Column | None = None, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, broken)`` entries of a cache of JSON lines, whose row type ``schema`` has ``key``.

    An entry is broken if its line is cut off or no JSON, if it lacks what is ``required``, if
    its key is not the ``key`` of what it was made from, or if it is not ``valid`` (a vector of
    another width, say): ``broken`` has its ``line`` and ``defect``. A broken entry is a miss.
    It is gone once the good ones, with what was asked anew, are written as the cache.
    """
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"))
    rows = raw.select("line", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    rows = rows.select("line", "e.*")
    lacks = F.exists(F.array(*(F.col(c).isNull() for c in ("key", *required))), lambda x: x)
    defect = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(lacks, "incomplete")
    if key is not None:
        defect = defect.when(F.coalesce(key != F.col("key"), F.lit(True)), "wrong-key")
    if valid is not None:
        defect = defect.when(~F.coalesce(valid, F.lit(False)), "invalid")
    rows = rows.withColumn("defect", defect)
    return rows.where("defect is null").drop("line", "defect", "_corrupt"), rows.where("defect is not null").select("line", "defect")
