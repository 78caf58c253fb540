"""Two invented transcripts, for trying things out without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import transcripts

_TURNS = {
    "harbour": [
        ("host", "Welcome to the yearly report of the harbour company."),
        ("director", "Operating margin rose to nineteen percent, as fewer ships waited and more were loaded at night."),
        ("analyst", "What guidance do you give for the coming year?"),
        ("director", "We expect free cash flow of about forty million, and capital expenditure of twelve for the new crane."),
    ],
    "orchard": [
        ("host", "We talk with the growers of the orchard today."),
        ("grower", "Revenue grew by seven percent year over year, though the supply chain for crates was thin."),
        ("analyst", "And earnings per share?"),
        ("grower", "Two crowns and ten, a little more than last year."),
    ],
}


def sample_transcripts(spark: SparkSession) -> DataFrame:
    """(doc_id, content) of two short conversations."""
    rows = [(name, i, role, text) for name, turns in _TURNS.items() for i, (role, text) in enumerate(turns)]
    return transcripts(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).select(F.col("doc_id"), "content")
