"""Language identification by compression.

A text, lower-cased and with what is no letter turned into one space, is compressed once for
every known language, each time with a raw-content zstandard dictionary of that language; the
language with the smallest output wins. The margin to the second smallest tells how sure that
is; a narrow margin rejects the text. Texts are compressed whole, in pieces of `PIECE_BYTES`, so
that the dictionary, not the text's own beginning, explains each piece.

Fitting: a dictionary holds the words that most documents of a language have, the most frequent
last (nearest to the text): texts as they stand repeat their common words, so that `DICT_BYTES` of them
hold a fraction of the words that as many bytes of different words do. They come from a bounded sample of labelled rows, `SAMPLE_ROWS`
documents a language chosen by hash, and fill `DICT_BYTES` at most (documented parameters).

Defined results: text null, empty or without a letter -> `und`, score 0, rejected; no labelled
row at all -> `und` for all; ties go to the language with more labelled rows, then
to the smaller name; repeated rows each get their
row; an empty table gives an empty result; extra columns are kept unless they carry the names
that the operator adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.llm._shared import read_table, unit_hash

SAMPLE_ROWS = 400
DICT_BYTES = 112 * 1024
PIECE_BYTES = 1024
LEVEL = 6
#: A text is rejected if the best language saves less than this share of the second's bytes.
MIN_MARGIN = 0.004
SEED = 1009

_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """{language: dictionary}, languages with more rows first. At most dict_bytes a language
    reach the driver."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    known = known.withColumn("_u", unit_hash(F.col("_id"), seed=SEED))
    sizes = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    if not sizes:
        return {}
    table = known.sparkSession.createDataFrame(list(sizes.items()), "_lang string, _n long")
    # the hash lets three times the wanted rows through, whatever a language's size
    few = known.join(F.broadcast(table), "_lang").where(F.col("_u") < F.lit(3.0 * rows) / F.col("_n"))
    few = few.withColumn("_k", F.row_number().over(W.partitionBy("_lang").orderBy("_u", "_id"))).where(F.col("_k") <= rows)
    plain = F.lower(F.regexp_replace("_text", r"[^\p{L}]+", " "))
    words = few.select("_lang", F.explode(F.array_distinct(F.split(plain, " "))).alias("_w")).where("_w <> ''")
    words = words.groupBy("_lang", "_w").count()
    most = W.partitionBy("_lang").orderBy(F.desc("count"), "_w")
    words = words.withColumn("_k", F.row_number().over(most)).withColumn("_sum", F.sum(F.octet_length("_w") + 1).over(most.rowsBetween(W.unboundedPreceding, 0)))
    out: dict[str, list[str]] = {k: [] for k in sorted(sizes, key=lambda k: (-sizes[k], k))}
    for r in sorted(words.where(F.col("_sum") < dict_bytes).select("_lang", "_k", "_w").collect(), key=lambda r: -r["_k"]):
        out[r["_lang"]].append(r["_w"])
    return {k: (" " + " ".join(v) + " ").encode() for k, v in out.items()}


class Classifier:
    """The compressors of one process."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece: int = PIECE_BYTES) -> None:
        self.names, self.piece, self.packers = list(dictionaries), piece, []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and margin, the share of the second's bytes that the best saves."""
        plain = letters(text or "")
        if plain.isspace() or not self.names:
            return "und", 0.0
        raw = plain.encode("utf-8", "replace")
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        by = sorted((sum(len(p.compress(x)) for x in pieces), i) for i, p in enumerate(self.packers))
        margin = (by[1][0] - by[0][0]) / by[1][0] if len(by) > 1 else 1.0
        return self.names[by[0][1]], margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """df plus lang_pred string, score double (0 to 1: the margin, 0.25 and more counts as 1)
    and rejected boolean."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(dictionaries)
    rows = df.select(F.struct(*[c for c in df.columns if c not in ("lang_pred", "score", "rejected")]).alias("row"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("lang_pred string, margin double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Classifier(model.value)
        for texts in batches:
            yield pd.DataFrame([c.judge(t) for t in texts], columns=["lang_pred", "margin"])

    out = rows.select("row", predicted("text").alias("p"))
    margin = F.least(F.greatest(F.col("p.margin"), F.lit(0.0)), F.lit(1.0))
    rejected = (F.col("p.lang_pred") == "und") | (margin < min_margin)
    return out.select("row.*", F.col("p.lang_pred").alias("lang_pred"), F.least(margin * 4, F.lit(1.0)).alias("score"), rejected.alias("rejected"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
