"""Bounded samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on, at most (a documented bound; scoring covers all rows).
SAMPLE_ROWS = 4000


def held_out(doc_id):
    """Rows whose labels no model of ours learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs ⋈ labels for at most `rows` labelled ids that have a document, outside the held-out third, chosen by a hash of the
    id; one row an id, of repeated documents the one with the least hash.

    Only the chosen ids travel (at most `rows` of them, so they are broadcast); texts stay where they are but for the chosen.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    here = once.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    found = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(row).select("_row.*")
    return found.join(F.broadcast(chosen), "doc_id")


def fitted(rows: DataFrame, fit: Callable[[pa.Table | None], dict]) -> dict:
    """fit(all rows by doc_id, or None without any) in one task: rows are a bounded sample's features, so one task can hold
    them, and the driver gets the model alone. A lost executor costs one more try."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        model = fit(pa.Table.from_batches(got).sort_by("doc_id") if got else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    model = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit(None)
