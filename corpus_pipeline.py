"""A corpus pipeline of five stages over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.

Every stage takes any table with the columns doc_id, text, lang and source:
further columns, also ones named like an operator's, are carried unchanged (the
packing leaves them out), a missing table of rows gives no rows, texts are read
whole whatever their length, and repeated rows are rows of their own unless a
stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm import ftrl_langid, phrase_dedup, poisson_mix, prob_minhash, swap_pack
from callsift.llm.queries import tokenizer_path
from callsift.llm.work import Work, id_remainder, set_aside, table


def carried(docs: DataFrame, outputs: set[str]) -> dict[str, Column]:
    """The columns of docs in an operator's result that has such outputs."""
    return {c: F.col(name) for c, name in zip(docs.columns, set_aside(docs, outputs).columns)}


def as_given(out: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return out.select(*(col.alias(c) for c, col in columns.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, also those that several share;
    ``und`` go. Null, empty and letterless texts are ``und``; without any
    labelled row all are; ties between languages go to the first in order, and
    the document stays. A null id is learned from like any other."""
    model = ftrl_langid.fit(docs.filter(id_remainder() != 0).select("text", "lang"))
    known = ftrl_langid.predict(docs, model)
    return as_given(known.filter(F.col("lang_pred") != ftrl_langid.UNKNOWN), carried(docs, {"lang_pred", "score"}))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the
    smallest id (of a group without ids, one text). Of repeated rows, equal in id and
    text, one stays; null, empty and wordless texts all stay."""
    return prob_minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages of 35 words and more leave the texts; n_chars follows.
    A null text stays null; repeated rows repeat each other's passages, so all
    copies lose them; a document that loses every word stays with an empty text."""
    kept = phrase_dedup.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"),
           "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")}
    return as_given(kept, carried(docs, phrase_dedup.OUTPUTS) | {c: new[c] for c in docs.columns if c in new})


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to their target shares, in the mixture's order. A null
    source is one of its own, null ids hash as the empty text, rows with equal
    ids are copied equally often; null and empty texts are copied, too."""
    return as_given(poisson_mix.replicate(docs), carried(docs, poisson_mix.OUTPUTS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture packed into sequences of 4096 tokens. A null or empty text is
    the end id alone; only texts of more tokens are cut; repeated rows are
    packed one by one; ties between bins go to the first."""
    return swap_pack.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("poisson_mix", poisson_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Trained models, signatures and tokenizers are no SQL; tests/llm holds the
# pipeline against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with Work.scope():  # what a stage wrote for itself goes once its result is a table
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
