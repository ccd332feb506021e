"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read back as the next stage's ``docs``.  All but the last
return the columns of their input.

Cases: every stage takes null texts and columns, repeated rows and empty tables;
rows with a null doc_id pass the stages like any other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelfold.llm import decontaminate, mixing, ngram_join, secret_scan, toxicity
from labelfold.llm.common import set_aside, table, written


def toxic_gone(spark, docs, sf_dir):
    """Documents scored toxic go; the examples are the labelled ones among ``docs``."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    df, back = set_aside(docs, ("score", "evidence"))
    return toxicity.score(df, model).where(F.col("score") < toxicity.THRESHOLD).select(*back)


def one_of_each_group(spark, docs, sf_dir):
    """Of documents that five-word shingles link at a Jaccard similarity of 0.8, directly or by others, one stays."""
    return ngram_join.keep_one(docs, 5, 80, 100)


def leaks_gone(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    df, back = set_aside(docs, ("found",))
    found = decontaminate.find(df, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(F.size("found") == 0).select(*back)


def secrets_redacted(spark, docs, sf_dir):
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def mixed(spark, docs, sf_dir):
    """Documents and passes of the mixture, to a budget of all tokens."""
    out = mixing.mix(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", "copy", "block", "weight", "exponent")


STAGES = [("toxicity", toxic_gone), ("ngram_join", one_of_each_group), ("decontamination", leaks_gone),
          ("secrets", secrets_redacted), ("mixing", mixed)]

#: The stages learn, sample and scan beyond what SQL expresses; tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each one's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
