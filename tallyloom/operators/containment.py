"""Which short texts stand inside which long ones, without windows of every length."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged

#: Characters of patterns that one automaton holds.
AUTOMATON_CHARS = 8_000_000


def contained_texts(texts: DataFrame, patterns: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(text, pattern) for each distinct text and each distinct pattern that stands in it and is shorter.

    Both tables have a column `value`. An automaton over the patterns goes to every task once and each text is read once, whatever
    the number of patterns. Patterns beyond most_chars characters go in several lots, each with a pass over the texts, so that none is larger.
    Null and empty values match nothing.
    """
    spark = texts.sparkSession
    known = staged(patterns.select("value").where("value <> ''").distinct(), "patterns")
    asked = staged(texts.select("value").where("value <> ''").distinct(), "pattern-texts")
    chars = known.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    lots, out = max(1, -(-chars // most_chars)), None

    def finder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for word in sent.value:
                machine.add_word(word, word)
            machine.make_automaton()
            for batch in batches:
                found = [(text, word) for text in batch.column("value").to_pylist() for word in {w for _, w in machine.iter(text)} if len(word) < len(text)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["text", "pattern"])

        return run

    for lot in range(lots):
        words = [r["value"] for r in known.where(F.pmod(F.xxhash64("value"), F.lit(lots)) == lot).collect()]
        if words:
            hits = asked.mapInArrow(finder(spark.sparkContext.broadcast(words)), "text string, pattern string")
            out = hits if out is None else out.unionByName(hits)
    return asked.select(F.col("value").alias("text"), F.col("value").alias("pattern")).limit(0) if out is None else out
