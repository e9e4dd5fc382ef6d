"""Pieces that queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = tuple[Callable[[SparkSession, str], DataFrame], str]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of files up to this size are dealt to all cores where they come in fewer parts.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small and comes in fewer parts than there are: one small file is else one task. Larger
    tables stay as their files are split, whatever the cores; `spark.sql.files.maxPartitionBytes` is the way there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, doubles rounded to six digits: types and digits that any engine can return."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source, text) of the documents."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "source", "text"))


TOKEN_SQL = r"'\p{L}+|\p{N}+|[^\s\p{L}\p{N}]'"
SPACE_SQL = r"[\t-\r \x{85}\p{Z}]"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKEN_SQL})"


def clean_sql(x: str) -> str:
    for pattern, to in ((r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "' '"), (r"[ \t\f\x0B]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def token_id_sql(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 6))::BIGINT % 60000 + 5)"


def uuid_sql(x: str) -> str:
    m = f"md5({x})"
    return f"(substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12))"
