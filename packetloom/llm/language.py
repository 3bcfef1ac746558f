"""Language ID by compression: the dictionary that makes a text smallest names its language."""
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, remainder, small_batches

# Learned from each language: so many rows at most, and so many characters of each. This bounds a dictionary to 0.8 MB.
ROWS = 200
PIECE = 1024
# Characters of all dictionaries together. With many languages each gets fewer rows, then shorter pieces; all are kept.
CHARACTERS = 256 * ROWS * PIECE
# A text is encoded in blocks, so that the dictionary and not the text's own start serves each of them.
BLOCK = 2000
# Share by which the second smallest size exceeds the smallest, below which it is narrow.
MARGIN = 0.005
UNKNOWN = "und"

_PLAIN = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
_CODERS: dict[tuple, "Coders"] = {}


# Languages, most frequent first, and the dictionary of each.
Model = tuple[tuple[str, ...], tuple[bytes, ...]]


class Coders:
    """For each language two encoders: a quick one, and a finer one for what the quick one can't tell apart."""

    def __init__(self, model: Model):
        self.languages, contents = model
        settings = (zstandard.ZstdCompressionParameters.from_level(6, **_PLAIN),
                    zstandard.ZstdCompressionParameters.from_level(6, min_match=3, strategy=zstandard.STRATEGY_BTOPT, window_log=18, **_PLAIN))
        self.passes = [[self._coder(content, x) for content in contents] for x in settings]

    @staticmethod
    def _coder(content: bytes, settings) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=held)

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected). Ties go to the language with more labelled rows."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.lower().encode()
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        for coders in self.passes:
            sizes = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in enumerate(coders))
            score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            if score >= margin:
                break
        return self.languages[sizes[0][1]], score, score < margin


def share(languages: int) -> tuple[int, int]:
    """Rows of each language and characters of each row, so that all dictionaries together stay within CHARACTERS."""
    each = max(16, CHARACTERS // max(1, languages))
    return max(1, min(ROWS, each // PIECE)), min(PIECE, each)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The dictionaries, from at most ROWS texts of a language in the order of a hash of the text, and PIECE characters of
    each from a place that the hash names. Rows without text or language teach nothing; the counts take all rows."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).filter("lang is not null and length(t) > 0")
    rows = rows.withColumn("h", F.xxhash64("t"))
    languages = tuple(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect())
    most, size = share(len(languages))
    order = Window.partitionBy("lang").orderBy("h")
    # copies of a text have one hash, so it is chosen once
    chosen = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
    place = (F.pmod("h", F.greatest(F.length("t") - size, F.lit(0)) + 1) + 1).cast("int")
    pieces = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.lower(F.substring("t", place, F.lit(size))).alias("piece"))
    held: dict[str, dict[bytes, None]] = {}
    for r in pieces.distinct().orderBy("lang", "h", "piece").collect():
        held.setdefault(r["lang"], {})[r["piece"].encode()] = None
    # zstandard takes no raw content of under 8 bytes
    return languages, tuple(b"\n".join(held[x]).ljust(8, b"\n") for x in languages)


def language(text: Column, model: Broadcast, margin: float = MARGIN) -> Column:
    """struct<lang string, score double, rejected boolean>. Null, empty and letterless texts are `und` and rejected."""
    @pandas_udf("lang string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if model.value not in _CODERS:
            _CODERS.clear()
            _CODERS[model.value] = Coders(model.value)
        coders = _CODERS[model.value]
        return pd.DataFrame([coders.judge(t, margin) for t in texts], columns=["lang", "score", "rejected"])
    return judged(text.cast("string"))


def predict(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of docs.

    Learned from rows whose fold is not `held`; a null id is in no fold, teaches and is not held out. The score is the
    share by which the best size undercuts the next. A narrow margin is rejected but still named. Repeated rows get
    equal answers, further columns play no part, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~out)))
    judged = docs.select("doc_id", out.alias("held_out"), language(F.col("text"), model).alias("j"))
    return judged.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score", "j.rejected")


def recognised(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of docs whose language is told with a clear margin, with their columns."""
    small_batches(docs.sparkSession)
    out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~out)))
    name = fresh(docs.columns, "judged")
    return docs.withColumn(name, language(F.col("text"), model)).filter(~F.col(f"{name}.rejected")).drop(name)
