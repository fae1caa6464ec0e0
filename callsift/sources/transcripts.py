"""Transcript sources: CSV upload scan, column-role mapping, driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLE_TYPES = {
    "transcript_id": T.LongType(),
    "transcript": T.StringType(),
    "agent_name": T.StringType(),
    "call_id": T.StringType(),
    "ts": T.TimestampType(),
}
_HINTS = ("transcript", "text", "conversation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_transcripts_csv(spark: SparkSession, path: str,
                         schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV with a header row. Pass an explicit schema at scale; without one
    every column is read as a string (no inference pass over the data).

    Values may hold line breaks, so a file is read by one task; of uploads
    known to have none (``line_breaks`` off), large files are split."""
    r = (spark.read.option("header", True).option("multiLine", line_breaks)
         .option("escape", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def with_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """A table read from Parquet files with the place of each row, (file, row in
    the file), as a struct that sorts in file order whatever the partitions.
    Take it right after the scan."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows of a table read from Parquet files, in file order (a
    top-k: every task hands on n rows at most)."""
    return with_order(df).orderBy("row_order").limit(n).drop("row_order")


def detect_transcript_column(columns: list[str]) -> str:
    """First column whose lower-cased name contains transcript/text/
    conversation, else the first column (metadata only, no job)."""
    for c in columns:
        low = c.lower()
        if any(h in low for h in _HINTS):
            return c
    return columns[0]


def map_columns(df: DataFrame, transcript: str | None = None, agent: str | None = None,
                call_id: str | None = None, timestamp: str | None = None,
                transcript_id: str | None = None) -> DataFrame:
    """Select the role columns under fixed names; a missing optional role is
    a typed null. Without an id column, a unique id is generated (stable
    for a given input layout). Other columns are kept after the roles."""
    transcript = transcript or detect_transcript_column(df.columns)
    picks = {
        "transcript_id": F.col(transcript_id).cast("long") if transcript_id
        else F.monotonically_increasing_id(),
        "transcript": F.col(transcript).cast("string"),
        "agent_name": F.col(agent).cast("string") if agent else F.lit(None).cast("string"),
        "call_id": F.col(call_id).cast("string") if call_id else F.lit(None).cast("string"),
        "ts": F.col(timestamp).cast("timestamp") if timestamp else F.lit(None).cast("timestamp"),
    }
    used = {c for c in (transcript, agent, call_id, timestamp, transcript_id) if c}
    rest = [F.col(c) for c in df.columns if c not in used and c not in picks]
    return df.select(*[v.alias(k) for k, v in picks.items()], *rest)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as transcripts: doc_id -> transcript_id, text ->
    transcript, source -> agent_name."""
    d = table(spark, sf_dir, "documents")
    return map_columns(d.select("doc_id", "text", "source"), transcript="text",
                       agent="source", transcript_id="doc_id")


def from_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` rendered as a labelled line
    ``[HH:MM:SS AGENT|CUSTOMER|SYSTEM]: text`` (assistant -> AGENT, system ->
    SYSTEM, any other or missing role -> CUSTOMER), one transcript row per
    turn so no conversation is gathered into one task; ``transcript_id`` is
    the text ``conv_id:turn``."""
    c = table(spark, sf_dir, "conversations")
    label = (F.when(F.col("role") == "assistant", "AGENT").when(F.col("role") == "system", "SYSTEM")
             .otherwise("CUSTOMER"))
    clock = F.format_string("%02d:%02d:%02d", (F.col("turn") / 3600).cast("int"),
                            ((F.col("turn") / 60).cast("int") % 60), F.col("turn") % 60)
    line = F.concat(F.lit("["), clock, F.lit(" "), label, F.lit("]: "), F.coalesce("text", F.lit("")))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("transcript_id"),
        line.alias("transcript"),
        F.concat(F.lit("agent"), (F.col("conv_id") % 7).cast("string")).alias("agent_name"),
        F.col("conv_id").cast("string").alias("call_id"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
