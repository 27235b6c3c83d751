"""Line deduplication by a segment-partition edit join (DataFrame only;
after Li, Deng, Wang, Feng: "PASS-JOIN", PVLDB 2011).

Lines are the parts of a text between line feeds, compared without white
space at their ends.  Lines of fewer than ``min_chars`` characters are never
judged.  A line is removed if an equal line, or one within ``MAX_EDITS``
single-character edits, starts earlier (smaller id, or same document and
earlier position); lines are judged on the input, not on what is left.

Method for two edits.  A distinct line is cut into three disjoint segments
of a characters: the first a, the next a, the last a, where a depends only on
the line's length band, so that lines of nearby lengths are cut alike.  Two
edits cannot touch all three.  If no edit touches or precedes the first
segment it matches in place; if none touches or follows the last, that one
matches counted from the end; otherwise one edit lies on each side and the
middle one matches shifted by at most one.  So a line is indexed under three
substrings and probes two more (the middle one shifted either way); lines at
the start of a band are indexed in the band below as well.

Candidates are pairs with an equal substring whose lengths differ by at most
two and whose letter counts, some in the whole line, some in its first and
last half, differ by at most four together; both are necessary.  They are
verified inside the join: the built-in banded ``levenshtein`` rejects, a banded
bit-parallel automaton confirms.  It is a semi join, as a line needs one
earlier partner, so no pairs come out of it.  Keys of many
lines are narrowed by a second substring that lines within the edits must
share too.  Each line is first compared with the earliest and the
most frequent line of its keys, and what that does not settle with all
earlier sharers.
The joins are on the substring's hash and AQE splits skewed ones.

Null ids: the row is kept unchanged and judges nothing.  Null texts stay null
and have no lines.  Rows that repeat an id count as the same document.  Texts
and lines of any length are judged whole.  Other columns are carried, whatever
their names; ``n_lines`` and ``n_removed`` replace columns of these names.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, written

MAX_EDITS = 2                 # the three-segment layout is for two edits
BROADCAST_ROWS = 200_000      # hashes or ids sent to all executors at most; more are joined by a shuffle
CROWD = 1024                  # lines that may share a key before it is narrowed
BLANKS = " \t\r\x0b\x0c"
COUNTED = "enir"              # letters counted in the first and in the last half
ALSO_COUNTED = "astoldu "     # letters counted in the whole line
RARER = "cmpvghbf"            # more of them


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, line): trimmed lines of rows that have an id."""
    return (docs.where(F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
                .select("doc", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")))


def _band(n: Column) -> Column:
    """Smallest length of the band that holds n: bands of 4 below 64, of 16 from there on."""
    return F.when(n < 64, n - n % 4).otherwise(n - n % 16)


def _counts(parts: list[tuple[Column, str]]) -> Column:
    """Counts (modulo 256) of letters in strings, a byte each."""
    out = F.lit(0).cast("long")
    for text, letters in parts:
        for c in letters:
            count = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) % 256
            out = F.shiftleft(out, 8).bitwiseOR(count.cast("long"))
    return out


def _bytes_apart(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for i in range(8):
        d = F.abs(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)))
        out = out + F.least(d, 256 - d)
    return out


def judged_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, pos, line, h) of the lines that are judged."""
    return split_lines(docs, id_col, text_col).where(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line"))


def keys_of(line: Column) -> Column:
    """Hashes of a line's index and probe substrings: five, and five more of the band below for lines at the start of a band."""
    n = F.length(line)
    band = _band(n)
    below = F.when(band <= 64, band - 4).otherwise(band - 16)

    def cut(b: Column) -> Column:
        a = F.floor(b / 3).cast("int")
        key = lambda no, x: F.xxhash64(b, F.lit(no), x)
        return F.array(key(1, F.substring(line, F.lit(1), a)), key(2, F.substring(line, a + 1, a)), key(2, F.substring(line, a, a)),
                       key(2, F.substring(line, a + 2, a)), key(3, F.right(line, a)))

    return F.when(n - band < MAX_EDITS, F.concat(cut(band), cut(below))).otherwise(cut(band))


def with_keys(lines: DataFrame) -> DataFrame:
    """Lines without their texts: (doc, pos, h, g, n, keys), g a second hash."""
    line = F.col("line")
    return lines.select("doc", "pos", "h", F.xxhash64(F.lit("second"), "line").alias("g"), F.length(line).cast("int").alias("n"),
                        F.array_distinct(keys_of(line)).alias("keys"))


def letter_counts(lines: DataFrame) -> DataFrame:
    """(h, line, whole, rarer, half, halves) of (h, line)."""
    line, n = F.col("line"), F.length("line")
    # halves of one length for most lines of a band and of the bands next to it
    half = F.floor((F.when(n < 64, n - n % 4 - 4).when(n < 80, 60).otherwise(n - n % 16 - 16)) / 2).cast("int")
    one = lines.withColumn("half", F.floor(half / 8).cast("int") * 8)
    return one.select("h", "line", _counts([(line, ALSO_COUNTED)]).alias("whole"), _counts([(line, RARER)]).alias("rarer"), "half", _counts(
        [(F.substring(line, F.lit(1), F.col("half")), COUNTED), (F.right(line, F.col("half")), COUNTED)]).alias("halves"))


PLACE = ("doc", "pos", "h")
FACTS = (*PLACE, "n", "whole", "rarer", "half", "halves")


def _fits(x: str, y: str) -> Column:
    """Necessary for two lines within the edits; x is the earlier one.  An
    edit changes at most two of the counts by one each; halves are compared
    if they have the same length."""
    place = lambda p: F.struct(*[F.col(p + c) for c in PLACE])
    halves = F.when(F.col(x + "half") == F.col(y + "half"), _bytes_apart(F.col(x + "halves"), F.col(y + "halves"))).otherwise(0)
    return ((place(x) < place(y)) & (F.abs(F.col(x + "n") - F.col(y + "n")) <= MAX_EDITS)
            & (_bytes_apart(F.col(x + "whole"), F.col(y + "whole")) + _bytes_apart(F.col(x + "rarer"), F.col(y + "rarer")) + halves
               <= 2 * MAX_EDITS))


def within_edits(x: Column, y: Column) -> Column:
    """Whether two strings are within two single-character edits: a banded
    bit-parallel automaton.  Bit k of the state for e edits says that, with i
    characters of x read, i + k - 2 characters of y can be read at e edits;
    two edits leave five diagonals, so a state is five bits at any length."""
    pad = F.array(F.lit(""), F.lit(""))
    both = F.struct(F.split(x, "").alias("a"), F.concat(pad, F.split(y, ""), pad).alias("b"))

    def same(at: Column) -> Column:   # where the character stands on the five diagonals
        bits = [F.when(at["a"] == at[f"b{k}"], F.lit(1 << k)).otherwise(F.lit(0)) for k in range(5)]
        return bits[0] + bits[1] + bits[2] + bits[3] + bits[4]

    def read(state: Column, same: Column) -> Column:
        old = [state[f"r{e}"] for e in range(3)]
        new = [old[0].bitwiseAND(same)]
        for e in (1, 2):   # matched, replaced, left out of y, put into y
            new.append(old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1))
                       .bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(31))))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)])

    def run(z: Column) -> Column:   # the strings are split once a pair
        n = F.size(z["a"])
        at = F.arrays_zip(z["a"].alias("a"), *[F.slice(z["b"], k + 1, n).alias(f"b{k}") for k in range(5)])
        start = F.struct(F.lit(4).alias("r0"), F.lit(12).alias("r1"), F.lit(28).alias("r2"))
        end = F.aggregate(F.transform(at, same), start, read, lambda state: state["r2"])
        apart = F.size(z["b"]) - 2 * MAX_EDITS - n
        bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(5)]), apart + MAX_EDITS + 1)
        return end.bitwiseAND(bit) > 0

    return F.element_at(F.transform(F.array(both), run), 1)


def _refined(line: Column, p: Column) -> Column:
    """Hashes that narrow a key.  Lines that share the key p and
    are within the edits share one of these as well: beside an equal first or
    last segment the two edits lie in the rest, which is cut in three again;
    beside an equal middle segment one edit lies left of it, so one of two
    pieces there is whole."""
    band = _band(F.length(line))
    band = F.when(p < 5, band).when(band <= 64, band - 4).otherwise(band - 16)
    a = F.floor(band / 3).cast("int")
    given = F.struct(line.alias("line"), p.alias("p"), F.length(line).alias("n"), a.alias("a"), F.floor((band - a) / 3).cast("int").alias("c"))

    def keys(z: Column) -> Column:
        a, n = z["a"], z["n"]
        cut = lambda no, start, size: F.xxhash64(F.lit(no), F.substring(z["line"], start, size))

        def rest(y: Column) -> Column:   # at: where the rest starts, end: where it ends
            c, at, end = y["c"], y["at"], y["end"]
            return F.array(cut(1, at, c), *[cut(2, at + c + shift, c) for shift in (-1, 0, 1)], cut(3, end - c + 1, c))

        def beside(at: Column, end: Column) -> Column:
            return F.element_at(F.transform(F.array(F.struct(z["c"].alias("c"), at.alias("at"), end.alias("end"))), rest), 1)

        h = F.floor((a - 1) / 2).cast("int")
        begin = a + F.when(z["p"] % 5 == 2, 0).when(z["p"] % 5 == 3, 2).otherwise(1)
        return F.when(z["p"] % 5 == 0, beside(a + 1, n)).when(z["p"] % 5 == 4, beside(F.lit(1), n - a)).otherwise(
            F.array(cut(1, F.lit(1), h), cut(2, begin - h, h)))

    return F.array_distinct(F.element_at(F.transform(F.array(given), keys), 1))


def _sides(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _candidates(later: DataFrame, earlier: DataFrame, back: bool = False) -> DataFrame:
    """The rows of ``later`` that an earlier line of their key may be within the
    edits of, or, going back, the rows of ``earlier`` that a later one may."""
    on = (F.col("x_key") == F.col("y_key")) & _fits("x_", "y_")
    sides = [(_sides(later, "y_"), "y_", later), (_sides(earlier, "x_"), "x_", earlier)]
    (kept, prefix, source), (other, *_) = sides[::-1] if back else sides
    return kept.join(other, on, "left_semi").select(*[F.col(prefix + c).alias(c) for c in source.columns])


def _partnered(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Places of the rows of ``later`` that have an earlier line of their key
    within the edits; one partner is enough, so no pair leaves the join."""
    # the built-in, compiled, turns most away before the automaton, which is interpreted, reads them
    maybe = F.levenshtein(F.col("x_line"), F.col("y_line"), MAX_EDITS) >= 0
    close = F.when(maybe, within_edits(F.col("x_line"), F.col("y_line"))).otherwise(F.lit(False))
    on = (F.col("x_key") == F.col("y_key")) & _fits("x_", "y_") & close
    return _sides(later, "y_").join(_sides(earlier, "x_"), on, "left_semi").select(*[F.col("y_" + c).alias(c) for c in PLACE]).distinct()


def _stars(y: DataFrame) -> DataFrame:
    """The earliest and the most frequent line of each key."""
    one = F.struct(*FACTS, "line")
    head = y.groupBy("key").agg(F.min(one).alias("m"), F.max(F.struct("c", one.alias("m")))["m"].alias("k"))
    return head.select("key", F.explode(F.array_distinct(F.array("m", "k"))).alias("m")).select("key", "m.*")


def near_lines(lines: DataFrame, keyed: DataFrame, facts: DataFrame) -> DataFrame:
    """Places of the distinct lines that have an earlier line within the edits.

    Keys that only one line has are dropped first, before anything but hashes
    is moved, and keys of more than ``CROWD`` lines are narrowed.  Lines that
    no other line of a key can be near by its counts go next; texts are fetched
    for the others.  Then every line is compared with the earliest and the most
    frequent line of each of its keys, which settles most groups of similar
    lines, and the lines that are left look for a partner among all earlier
    sharers."""
    several = lambda df: df.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    among = lambda df, ids: df.join(small(ids.select(F.col("h").alias("want")).distinct(), BROADCAST_ROWS),
                                    F.col("h") == F.col("want"), "left_semi")
    keys = keyed.select(F.explode("keys").alias("key"), "h")
    sharers = written(keys.join(several(keys), "key").distinct(), "line-keys")
    texts = written(among(lines.select("h", "line"), sharers).groupBy("h").agg(F.first("line").alias("line")), "line-texts")
    crowded = small(sharers.groupBy("key").count().where(F.col("count") > CROWD).select("key"), BROADCAST_ROWS)
    narrowed = written(sharers.join(crowded, "key", "left_semi").join(texts, "h")
                              .select("h", "key", "line", F.posexplode(keys_of(F.col("line"))).alias("p", "own")).where("own = key")
                              .select("h", "key", F.explode(_refined(F.col("line"), F.col("p"))).alias("more"))
                              .select("h", F.xxhash64("key", "more").alias("key")).distinct(), "line-keys")
    y = sharers.join(crowded, "key", "left_anti").select("h", "key").unionByName(narrowed.join(several(narrowed), "key"))
    counted = facts.join(letter_counts(texts).drop("line"), "h").select(*FACTS, "c")
    y = written(y.join(counted, "h").select("key", *FACTS, "c"), "line-facts")
    later = written(_candidates(y, y), "line-later")
    y = later.unionByName(_candidates(later, y, back=True)).distinct()
    y = written(y.join(among(texts, y), "h").select("key", *FACTS, "c", "line"), "line-candidates")
    settled = written(_partnered(y, _stars(y)), "line-near")
    left = y.join(settled, [*PLACE], "left_anti")
    return settled.unionByName(written(_partnered(left, y), "line-near"))


def removed_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, drop): the positions of the removed lines of each document that has some."""
    lines = judged_lines(docs, id_col, text_col, min_chars)
    keyed = written(with_keys(lines), "lines")
    facts = (keyed.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("f"), F.count(F.lit(1)).alias("c"),
                                    F.first("g").alias("g"), F.first("n").alias("n"))
                  .select("h", "g", "f.doc", "f.pos", "c", "n"))
    near = near_lines(lines, keyed, facts).select("h").withColumn("is_near", F.lit(True))
    judged = (facts.join(near, "h", "left").where("c > 1 or is_near")
                   .select(F.col("h").alias("j_h"), F.col("g").alias("j_g"), F.col("doc").alias("f_doc"), F.col("pos").alias("f_pos"),
                           F.coalesce("is_near", F.lit(False)).alias("is_near")))
    gone = (keyed.select("doc", "pos", "h", "g").join(judged, (F.col("h") == F.col("j_h")) & (F.col("g") == F.col("j_g")))
                 .where("is_near or doc <> f_doc or pos <> f_pos"))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """The input's columns with the removed lines taken out of the text, and ``n_lines``, ``n_removed``."""
    if min_chars < 12:
        raise ValueError("judged lines need 12 characters at least")
    drop = written(removed_positions(docs, id_col, text_col, min_chars), "line-drops")
    doc, gone, parts = fresh(docs, "doc", "gone", "parts")
    # runs of kept lines lie between the removed positions: linear in the lines, whatever their number
    stops = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(parts)))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(stops) - 1), lambda i: F.slice(
        F.col(parts), F.element_at(stops, i) + 2, F.element_at(stops, i + 1) - F.element_at(stops, i) - 1)))
    joined = (docs.join(small(drop.select(F.col("doc").alias(doc), F.col("drop").alias(gone)), BROADCAST_ROWS), F.col(id_col) == F.col(doc), "left")
                  .withColumn(parts, F.split(F.col(text_col), "\n")))   # a column of its own: it is split once a row, not once a run
    own = ("n_lines", "n_removed")
    return joined.select(
        *[F.col(c) if c != text_col else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c)
          for c in docs.columns if c.lower() not in own],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
