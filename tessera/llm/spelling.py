"""Spelling variants: words one edit apart, found by reduced-alphabet generation.

Words are counted over all documents (runs of Latin letters, A-Z lower-cased).
Every letter is hashed to one of ``SYMBOLS`` symbols, which makes a reduced
word.  Words one edit apart have reduced words that are equal or one edit
apart, and these are found by generation: for each word the reduced word, all
its replacements and all its deletions (an insertion into one word is a
deletion from the other, so a pair is generated from its longer word) are
joined with the reduced words of the vocabulary.  Reduced words travel as
64-bit hashes computed for all positions at once, so that a long word costs
no more than its length times the symbols.

A sum (exclusive or) over the unreduced letters travels along: two near words'
sums differ by one letter at most, which the join tests before a pair leaves it.  Pairs are
then verified on the words themselves.

A word's form is its near word with most occurrences (ties: the smaller word
in code-point order) if it has at least ``ratio`` times the word's; its root
is the last of the forms that follow each other, found by pointer doubling.

Null texts have no words; of rows without an id no run is changed.  Rows that
repeat an id count each.  Texts and words of any length are taken whole.
Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rolling import spread
from .common import U64, inverse, lean, mix, powers, signed, written

SYMBOLS = 8
CHUNK_LETTERS = 1 << 15   # letters whose neighbours are generated at once (a longer word alone)
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]   # code points of a word
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0xC2B2AE3D27D4EB4F
_SIZE = U64(0x165667B19E3779F9)
_SYMBOL = np.zeros(256, np.uint64)
_SYMBOL[LETTERS] = mix(np.array(LETTERS, np.uint64)) % U64(SYMBOLS) + U64(1)
_LETTER = mix(np.arange(256, dtype=np.uint64) + U64(0x27D4EB2F165667C5))


def _lacks() -> list[int]:
    """What the sums of two near words may differ by: nothing, the letter that
    replaced one in the reduced word, or two letters of one symbol."""
    out = {0}
    for a in LETTERS:
        out.add(int(_LETTER[a]))
        out.update(int(_LETTER[a] ^ _LETTER[b]) for b in LETTERS if b != a and _SYMBOL[a] == _SYMBOL[b])
    return [x - (1 << 64) if x >= 1 << 63 else x for x in sorted(out)]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change_every: int = 97) -> DataFrame:
    """(word, n): all runs of all texts; of a run whose checksum (crc32 of ``id:run``)
    ``change_every`` divides, the letter at the checksum modulo its length is left out."""
    run = F.col("run")
    ascii_only = F.octet_length(run) == F.length(run)
    lower = F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    runs = (docs.select(F.col(id_col).cast("long").cast("string").alias("doc"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
                .select("doc", lower.alias("run")))
    crc = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("crc") % F.length(run)).cast("int")
    left = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(F.col("crc") % change_every == 0, left).otherwise(run)
    return runs.withColumn("crc", crc).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def neighbourhoods(words: list[str]) -> tuple[np.ndarray, ...]:
    """(key, sum) of each word, and (word, key, sum, shorter) of its generated
    neighbours, itself included; ``shorter`` marks deletions."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    end = np.cumsum(size)
    start = end - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code)) - start[word]
    power = powers(_BASE, int(size.max(initial=0)) + 1)[at]
    symbol, letter = _SYMBOL[code], _LETTER[code]
    none = np.zeros(1, np.uint64)
    upto = np.concatenate([none, np.cumsum(symbol * power, dtype=np.uint64)])
    bags = np.concatenate([none, np.bitwise_xor.accumulate(letter)]) if len(code) else none
    total, bag, length = upto[end] - upto[start], bags[end] ^ bags[start], size.astype(np.uint64)
    key = lambda h, n: mix(h + n * _SIZE)
    own = key(total, length)
    rest = bag[word] ^ letter
    out = [(np.arange(len(words)), own, bag, np.zeros(len(words), bool))]
    for x in range(1, SYMBOLS + 1):
        i = np.flatnonzero(symbol != U64(x))
        w = word[i]
        out.append((w, key(total[w] + (U64(x) - symbol[i]) * power[i], length[w]), rest[i], np.zeros(len(i), bool)))
    before = upto[:-1] - upto[start][word]
    after = total[word] - before - symbol * power
    # leaving out one or the next of two equal letters is the same
    i = np.flatnonzero((at == 0) | (code != np.append(np.uint8(0), code[:-1])))
    w = word[i]
    out.append((w, key(before[i] + after[i] * U64(inverse(_BASE)), length[w] - U64(1)), rest[i], np.ones(len(i), bool)))
    return own, bag, *(np.concatenate(x) for x in zip(*out))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): ids of the words of (id, word) that are exactly one edit apart, each pair once."""
    def work(own_side: bool):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                a = 0
                while a < len(words):
                    b, held = a, 0
                    while b < len(words) and (b == a or held + len(words[b]) <= CHUNK_LETTERS):
                        held += len(words[b])
                        b += 1
                    own, bag, word, key, rest, shorter = neighbourhoods(words[a:b])
                    if own_side:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), signed(own), signed(bag)], names=["b", "b_key", "b_bag"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][word]), signed(key), signed(rest), pa.array(shorter)],
                                                         names=["a", "key", "bag", "shorter"])
                    a = b
        return run

    src = spread(vocabulary.select("id", "word"))
    own = src.mapInArrow(work(True), "b long, b_key long, b_bag long")
    near = src.mapInArrow(work(False), "a long, key long, bag long, shorter boolean")
    # two words of one length generate each other: the pair is taken once
    once = F.when(F.col("shorter"), F.col("a") != F.col("b")).otherwise(F.col("a") < F.col("b"))
    pairs = near.join(own, (F.col("key") == F.col("b_key")) & once & F.col("bag").bitwiseXOR(F.col("b_bag")).isin(_lacks()))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda p: vocabulary.select(F.col("id").alias(p), F.col("word").alias(p + "_word"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
                 .where((F.col("a_word") != F.col("b_word")) & (F.levenshtein("a_word", "b_word", 1) >= 0)).select("a", "b"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where the chain id -> form ends, by pointer doubling."""
    step = written(forms.select("id", F.col("form").alias("to")), "steps")
    while True:
        nxt = step.select(F.col("id").alias("n_id"), F.col("to").alias("n_to"))
        new = written(step.join(nxt, F.col("to") == F.col("n_id"), "left")
                          .select("id", F.coalesce("n_to", "to").alias("to"), F.col("n_to").isNotNull().alias("went")), "steps")
        if new.where("went").isEmpty():
            return new.select("id", F.col("to").alias("root"))
        step = new.select("id", "to")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2,
             change_every: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    counts = word_counts(spread(docs.select(id_col, text_col)), id_col, text_col, change_every)
    # ids are fixed by writing them
    vocab = written(counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))
                          .withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = written(near_pairs(vocab), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocab.select(F.col("id").alias("b"), F.struct(-F.col("n"), "word", "id").alias("best"))
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    # the word with its near words' count and its form
    table = written(vocab.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.col1") >= ratio * F.col("n"), F.struct(F.col("best.id").alias("id"), F.col("best.word").alias("word"),
                                                                     (-F.col("best.col1")).alias("n"))).alias("f")), "words")
    last = roots(table.where("f is not null").select("id", F.col("f.id").alias("form")))
    named = last.join(vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return (table.join(named, "id", "left")
                 .select("word", F.col("f.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.col("f.n").alias("form_n")))
