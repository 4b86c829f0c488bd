"""Token counts of sections: whole documents are encoded once and token spans are joined to section spans.

A section is a line of the text with the newline that ends it (or any spans that a caller gives). A token belongs to
the section that holds its last character, so a token that crosses a boundary counts for the later section; every
token counts exactly once, and a document's section counts add up to its tokens.

Null or empty text: no tokens, no sections. Null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, words


def line_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """End of every line in characters of its text, all texts in a row, and where each text's lines begin."""
    data, offsets = words.bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    end = data == 10
    filled = offsets[1:] > offsets[:-1]
    end[offsets[1:][filled] - 1] = True
    at = np.flatnonzero(end) + 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    doc = np.searchsorted(offsets, at - 1, "right") - 1
    first = np.searchsorted(at, offsets, "right")
    return chars[at] - chars[offsets[doc]], first


def attribute(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", section_ends: Callable = line_ends) -> DataFrame:
    """doc_id, n_tokens, n_sections and, by section in order, section_ends (characters) and section_tokens."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(tokenizer, offsets=True)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                flat, starts, ends = e.encode(piece.column(1))
                edges, first = section_ends(piece.column(1))
                n = piece.num_rows
                # interval join of sorted spans: texts are set apart by a step longer than any of them
                step = int(max(edges.max(initial=0), ends.max(initial=0))) + 1
                token = np.repeat(np.arange(n), np.diff(starts)) * step + ends
                edge = np.repeat(np.arange(n), np.diff(first)) * step + edges
                section = np.searchsorted(edge, token)  # the first section that ends at or after the token's last character
                counts = np.bincount(section, minlength=len(edge))[: len(edge)]
                lists = lambda v: pa.ListArray.from_arrays(first.astype(np.int32), pa.array(v, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(np.diff(first), pa.int64()), lists(edges), lists(counts)],
                    names=["doc_id", "n_tokens", "n_sections", "section_ends", "section_tokens"],
                )

    return docs.mapInArrow(count, "doc_id long, n_tokens long, n_sections long, section_ends array<long>, section_tokens array<long>")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet"))
