"""Operator 3, language identification by compression.

Each language has a raw-content dictionary: pieces of its training texts, for zstandard. A text is
encoded with every dictionary in turn, and the language whose dictionary gives the fewest bytes
wins. When the runner-up is nearly as small the text is rejected: its language is in doubt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import split_of

#: A dictionary is made of PIECES pieces of PIECE characters: this bounds what is learnt from.
PIECES, PIECE = 160, 400
#: Long texts are encoded in frames of this many bytes, so that each draws on the dictionary and
#: not on the text before it.
FRAME = 2048
#: A text is rejected if the runner-up needs less than this share of bytes more than the winner.
MARGIN = 0.01
UNKNOWN = "und"
#: Before encoding, letters are lower-cased, and ASCII bytes other than letters become spaces.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return text.lower().encode().translate(LETTERS)


def coder(dictionary: bytes, frame: int):  # noqa: ANN201
    """A zstandard compressor that looks for short matches, greedily, in the dictionary."""
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(
        3, dict_size=len(dictionary), source_size=frame, write_content_size=False, write_dict_id=False, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def learn_dictionaries(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", pieces: int = PIECES, piece: int = PIECE) -> dict[str, bytes]:
    """For each non-null language up to `pieces` pieces, one per text, at a place that a hash of
    the id gives; texts are taken in order of the hash. The bound is on what each language
    teaches; the number of languages is that of the column's values."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("dictionary"))
    spot = F.pmod(h, F.greatest(F.lit(1), F.length(text_col) - piece + 1)).cast("int") + 1
    cut = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(F.col(text_col), spot, F.lit(piece)).alias("piece"))
    first = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("rank") <= pieces)
    found: dict[str, list[bytes]] = {}
    for row in first.orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(letters(row["piece"]))
    return {lang: b" ".join(x) for lang, x in found.items()}


def predict_language(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, frame: int = FRAME) -> DataFrame:
    """One row per row of df: the columns of df, lang_pred, score (0 to 1) and rejected. Columns of df named
    like the new ones are replaced. Rows that repeat get the same answer; an empty table gives an empty
    result. A text of any length is encoded whole, frame by frame.

    A text that is null or has no letter is `und` with score 0 and rejected, and so is every text
    if nothing was learnt. Ties go to the language that sorts first. The score is a softmax of the
    encoded sizes, in units of a hundredth of the smallest.
    """
    given = dict(sorted(dictionaries.items()))
    df = df.drop("lang_pred", "score", "rejected")
    schema = df.schema.simpleString()[7:-1] + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        letter = regex.compile(r"\p{L}")
        names, coders = list(given), [coder(data, frame).compress for data in given.values()]

        def one(text: str | None) -> tuple[str, float, bool]:
            if text is None or not coders or not letter.search(text):
                return UNKNOWN, 0.0, True
            data = letters(text)
            parts = [data[i : i + frame] for i in range(0, len(data), frame)]
            sizes = np.array([sum(len(c(p)) for p in parts) for c in coders], float)
            best = int(sizes.argmin())
            odds = np.exp(-(sizes - sizes[best]) / (0.01 * sizes[best]))
            second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
            return names[best], float(1 / odds.sum()), bool(second - sizes[best] < margin * sizes[best])

        for batch in batches:
            lang, score, rejected = zip(*map(one, batch.column(text_col).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"]
            )

    return df.mapInArrow(run, schema)


def identify_language(df: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """doc id, held_out, lang_pred, score, rejected for each row of df. Dictionaries are learnt from
    the rows of training (df itself by default) whose crc32 fold is not `held`."""
    source = df if training is None else training
    learnt = learn_dictionaries(source.where(split_of(id_col, folds) != held), text_col, lang_col, id_col)
    rows = df.select(F.col(id_col), F.coalesce(split_of(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col))
    return predict_language(rows, learnt, id_col, text_col).drop(text_col)


def keep_known_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language is not rejected, with the columns of df, whatever their names. Null texts
    and those without a letter are rejected; rows that repeat stay or go together. A null id or lang teaches
    nothing. An empty table gives an empty result."""
    learnt = learn_dictionaries(df.where(split_of(id_col, 3) != 1), text_col, lang_col, id_col)
    named = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pred = predict_language(named, learnt, f"c{df.columns.index(id_col)}", f"c{df.columns.index(text_col)}")
    return pred.where(~F.col("rejected")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
