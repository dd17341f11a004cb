"""Incremental ingestion, beyond what batch runs need: new word files are picked up once, and a
page's line numbering goes on from the state that the last files left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "page long, pos long, text string, l long, t long, r long, b long"


def new_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(WORDS).parquet(path)


def not_yet_done(names: DataFrame, done: DataFrame, col: str) -> DataFrame:
    """Batch form of skip-if-output-exists."""
    return names.join(done.select(col).distinct(), col, "left_anti")


def numbered_stream(words: DataFrame, gap: int = 5) -> DataFrame:
    """Line numbers of words that arrive page by page in reading order; state per page: the line
    number and the bottom of the word that opened it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, bottom = state.get if state.exists else (0, 0)
        for pdf in frames:
            out = []
            for t, b in zip(pdf["t"], pdf["b"], strict=True):
                if b - bottom > gap and t > bottom:
                    number, bottom = number + 1, int(b)
                out.append(number)
            yield pd.DataFrame({"page": pdf["page"], "pos": pdf["pos"], "seq_line": out})
        state.update((int(number), int(bottom)))

    return words.groupBy("page").applyInPandasWithState(step, "page long, pos long, seq_line long", "number long, bottom long", "append", "NoTimeout")


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Each input file's rows exactly once, whatever fails between."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def counted_late(events: DataFrame, at: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per window, late ones up to the watermark included."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width)).count()
