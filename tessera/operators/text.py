"""Text chunking and embedding.

R7 is pure column expressions (``sequence`` + ``substring``).  R6, the
separator-aware recursive split the reference delegates to a library, is
the one per-row Python helper: a function over Arrow batches that splits one
(whole) text at a time and gives its chunks as rows, in small batches.  R5 is a
``pyspark.ml`` feature pipeline fitted on the chunk table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Splitter defaults of the reference's knowledge base.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")
SECTION = 8             # windows cut from a text at a time: a cut walks to its place from the start of what it cuts
CHUNK_BATCH = 1 << 21   # characters of chunks that a task holds before it gives them out


# ------------------------------------------------------------------ R7
def chunk_fixed(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, keys=("doc_id",)) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; the last
    window ends at the text's end.  One output row per window."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - F.lit(size)) / F.lit(step)), F.lit(0))
    begin = F.col("_section") * SECTION
    return (docs.select(*keys, text_col, n.cast("int").alias("_n"))
                .select(*keys, text_col, "_n", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / SECTION).cast("int"))).alias("_section"))
                .select(*keys, "_n", "_section", F.substring(F.col(text_col), begin * step + 1, F.lit((SECTION - 1) * step + size)).alias("_text"))
                .select(*keys, "_section", "_text", F.explode(F.sequence(begin, F.least("_n", begin + SECTION - 1))).alias("chunk_pos"))
                .select(*keys, F.col("chunk_pos").cast("bigint").alias("chunk_pos"),
                        (F.col("chunk_pos") * step).cast("bigint").alias("chunk_start"),
                        F.substring(F.col("_text"), (F.col("chunk_pos") - begin) * step + 1, F.lit(size)).alias("chunk_text"))
                .withColumn("chunk_len", F.length("chunk_text").cast("bigint")))


# ------------------------------------------------------------------ R6
def _pieces(text: str, sep: str) -> list[str]:
    """Split on ``sep`` keeping the separator at the start of the next
    piece; empty pieces dropped; '' splits into characters."""
    if sep == "":
        return list(text)
    parts = re.split(f"({re.escape(sep)})", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    if len(parts) % 2 == 0:
        out.append(parts[-1])
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing of pieces into chunks of at most ``size``; each new
    chunk starts with the tail of the previous one (at most ``overlap``)."""
    chunks, window, total = [], [], 0
    for p in pieces:
        if window and total + len(p) > size:
            joined = "".join(window).strip()
            if joined:
                chunks.append(joined)
            while window and (total > overlap or total + len(p) > size):
                total -= len(window[0])
                window.pop(0)
        window.append(p)
        total += len(p)
    joined = "".join(window).strip()
    if joined:
        chunks.append(joined)
    return chunks


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=SEPARATORS) -> list[str]:
    """The coarsest separator present splits the text; pieces under
    ``size`` are packed, longer ones recurse with the finer separators."""
    if text is None:
        return []
    seps = list(separators)
    use, finer = seps[-1], []
    for i, s in enumerate(seps):
        if s == "" or s in text:
            use, finer = s, seps[i + 1:]
            break
    out, small = [], []
    for p in _pieces(text, use):
        if len(p) < size:
            small.append(p)
            continue
        if small:
            out += _merge(small, size, overlap)
            small = []
        out += split_recursive(p, size, overlap, finer) if finer else [p]
    if small:
        out += _merge(small, size, overlap)
    return out


def chunk_recursive(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, keys=("doc_id",)) -> DataFrame:
    """One row per chunk (keys..., chunk_pos, chunk_text, chunk_len);
    metadata columns in ``keys`` are copied to every chunk."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                rows, places, chunks, chars = [], [], [], 0
                while begin < batch.num_rows and chars < CHUNK_BATCH:   # one text at a time, few of them at once
                    found = split_recursive(batch.column(len(keys))[begin].as_py(), size, overlap)
                    rows += [begin] * len(found)
                    places += range(len(found))
                    chunks += found
                    chars += sum(map(len, found))
                    begin += 1
                out = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(places, pa.int64()), pa.array(chunks, pa.string())], names=[*keys, "chunk_pos", "chunk_text"])

    from ..plans.rolling import spread
    src = spread(docs.select(*keys, text_col))
    schema = StructType([*(src.schema[x] for x in keys), StructField("chunk_pos", LongType()), StructField("chunk_text", StringType())])
    return src.mapInArrow(split, schema).withColumn("chunk_len", F.length("chunk_text").cast("bigint"))


# ------------------------------------------------------------------ R5
def fit_tfidf(chunks: DataFrame, text_col: str = "chunk_text", dims: int = 1024):
    """Tokenizer -> hashing TF -> IDF -> L2 normaliser, fitted on the
    chunk table (IDF is one distributed document-frequency pass).  The
    same fitted model embeds queries.  Returns the PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)]
    return Pipeline(stages=stages).fit(chunks)


def embed(model, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
    """Apply a fitted R5 model; ``out_col`` is ``array<float>``, the same
    shape as a ready-made embedding column."""
    from pyspark.ml.functions import vector_to_array
    src = df if text_col == model.stages[0].getInputCol() else df.withColumnRenamed(
        text_col, model.stages[0].getInputCol())
    out = model.transform(src)
    return (out.withColumn(out_col, vector_to_array("_vec", "float32"))
               .withColumn("n_tokens", F.size("_tok").cast("bigint"))
               .drop("_tok", "_tf", "_tfidf", "_vec"))
