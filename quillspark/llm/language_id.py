"""Language identification by conditional compression.

Each language has a zstandard raw-content dictionary: normalised text of a bounded sample of labelled documents.
A document is normalised (lower case, runs of anything but letters become one space) and all of it is compressed with
each dictionary (a text under SHORT bytes twice over, as sizes are whole bytes and a frame has a fixed cost). A text over
BLOCK bytes is cut into equal blocks, each compressed with the dictionary alone and their sizes summed: what a dictionary
saves of one frame is bounded, so over a long frame the margin would shrink with length. The document gets the language
whose dictionary makes it smallest. `margin` is how much smaller that is than the runner-up, as a share; a margin under
MARGIN is narrow and the document is rejected (`accepted` is false).

The sample to learn from: per language the DOCS_A_LANGUAGE labelled documents of lowest hash (chosen by a partial
top-k before any shuffle), of each its first HEAD characters, cut after DICTIONARY_BYTES in all. These bounds are
parameters; they hold for learning alone, a prediction reads whole texts. Of more than MOST_LANGUAGES labels each
gets as much less. The dictionaries are the only broadcast.

Defined results: null texts and texts without a letter get `und`, score 0, and are rejected; with no labelled
document at all every text gets `und`; ties go to the first language by name and are rejected as narrow;
repeated rows get a row each; empty tables give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._common import fresh, with_struct

DOCS_A_LANGUAGE, DICTIONARY_BYTES, MOST_LANGUAGES, HEAD = 400, 98_304, 400, 1500
LEVEL, MARGIN = 9, 0.002
#: A frame costs more than a match in a few words saves; twice the text shows the saving.
SHORT, BLOCK = 400, 32_768

GUESS = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()), StructField("accepted", BooleanType())])
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = DOCS_A_LANGUAGE, size: int = DICTIONARY_BYTES, head: int = HEAD) -> dict[str, bytes]:
    """A dictionary's content for each language of `labelled` rows; at most docs x languages rows reach the driver."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("rank"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy("rank", "id")
    langs = rows.select("lang").distinct().count()
    if langs > MOST_LANGUAGES:  # the whole sample stays within its bound
        docs, size = max(1, docs * MOST_LANGUAGES // langs), max(8, size * MOST_LANGUAGES // langs)
    # A document gives its head of a share of the dictionary, so that one long text cannot fill it.
    rows = rows.withColumn("text", F.substring("text", 1, max(head, 4 * size // docs)))
    picked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs)
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "n", "text").toLocalIterator():
        by.setdefault(r.lang, []).append((r.n, r.text))
    out = {}
    for lang, texts in sorted(by.items()):
        content = b"".join(normalise(t) for _, t in sorted(texts) if has_letter(t))[:size]
        if len(content) >= 8:
            out[lang] = content
    return out


_COMPRESSORS: dict[int, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = hash(tuple(dictionaries.items()))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        out = []
        for lang, content in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _COMPRESSORS[key] = out
    return _COMPRESSORS[key]


def guess(text: str | None, models: list[tuple[str, zstandard.ZstdCompressor]], margin: float = MARGIN) -> tuple[str, float, float, bool]:
    if not text or not models or not has_letter(text):
        return "und", 0.0, 0.0, False
    data = normalise(text)
    if len(data) < SHORT:
        data *= 2
    step = -(-len(data) // -(-len(data) // BLOCK))
    parts = [data[i : i + step] for i in range(0, len(data), step)]
    sizes = sorted((sum(len(c.compress(x)) for x in parts), lang) for lang, c in models)
    best, lang = sizes[0]
    gap = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    return lang, 0.5 + 0.5 * min(1.0, gap / 0.1), gap, gap >= margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", margin: float = MARGIN, out: str = "guess") -> tuple[DataFrame, str]:
    """docs with a struct of lang_pred, score, margin and accepted; and that struct's name."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    name = fresh(docs, out)

    def run(texts: pa.Array) -> pa.StructArray:
        models = compressors(sent.value)
        rows = [guess(t.as_py(), models, margin) for t in texts]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], GUESS.names)

    return with_struct(docs, name, GUESS, [text_col], run), name


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score, margin, accepted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    dictionaries = fit(rows.where(~held_out("doc_id")))
    df, g = identify(rows.select("doc_id", "text"), dictionaries)
    return df.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), *[F.col(g)[c].alias(c) for c in GUESS.names])


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """docs without those that identification rejects; all columns as they were."""
    dictionaries = fit(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    df, g = identify(docs, dictionaries, text_col=text_col, margin=margin)
    return df.where(F.col(g)["accepted"]).select(*docs.columns)
