"""Line deduplication by a suffix array over line ids, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, let, materialize, partitions

#: Lines of a run that counts as repeated.
MIN_RUN = 2

KEY = ["id", "print"]
RUNS = "cast(array() as array<struct<at:int,lines:int,width:int>>)"


def filled(lines: Column) -> Column:
    """Lines with more than white space, with their numbers."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return F.filter(numbered, lambda x: ~x["line"].rlike("^\\s*$"))


def is_long(line: Column, long_words: int | None) -> Column:
    """Whether a line has more than long_words words, parted by white space; null asks for none."""
    return F.lit(False) if long_words is None else F.regexp_count(line, F.lit("[^ \\t\\n\\x0B\\f\\r]+")) > long_words


def ordered_ids(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with `rank`: order-preserving, not dense. Range partitions are sorted, so a row's
    partition and place order it; the result is a table, so that lost executors cannot renumber it."""
    n = partitions(keys.sparkSession)
    ranged = keys.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return materialize(ranged.withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def keyed(id_col: str, text_col: str) -> list[Column]:
    """What names a document: its id, of any type that has an order, and a hash of its text."""
    return [F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("print")]


def repeated_prefixes(docs: DataFrame, min_run: int, id_col: str, text_col: str, long_words: int | None = None) -> DataFrame:
    """Suffixes of the line sequences whose beginnings also stand earlier: id, print, place (among filled lines) and n,
    the lines of such a beginning, for each of the widths 1 (only lines of over long_words words), min_run, 2 * min_run,
    4 * min_run, ... as far as any run repeats.

    Prefix doubling: the suffixes of one rank at a width are an interval of the suffix array whose common prefixes
    reach that width. An interval of one suffix, or of repeated rows of one document, is done; the others
    go on, ranked by their own rank and that of the suffix as many lines on. It ends when no interval is left.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(*keyed(id_col, text_col), F.posexplode(F.transform(filled(F.split(text, "\n")), lambda x: F.struct(F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(1), x["line"]).alias("h2"), is_long(x["line"], long_words).alias("long")))).alias("place", "h"))
    lines = materialize(lines.select(*KEY, "place", F.col("h.h1").alias("k1"), F.col("h.h2").alias("k2"), "h.long"), "lines")
    here = F.struct(*KEY, "place")
    found, width = [], 1
    while True:
        intervals = lines.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").drop("last")
        ranks = ordered_ids(intervals, ["k1", "k2"])
        if width >= min_run and ranks.isEmpty():
            break
        held = lines.join(ranks, ["k1", "k2"])
        later = held.where(here > F.col("first"))
        if width >= min_run or (width == 1 and long_words is not None):
            alone = F.lit(True) if width >= min_run else F.col("long")
            found.append(materialize(later.where(alone).select(*KEY, "place", F.lit(width).alias("n")), "line-repeats"))
        # The suffix `step` lines on has the rank of the next part of the prefix; a suffix that ends before has none.
        step = min(width, min_run - width) if width < min_run else width
        on = Window.partitionBy(*KEY).orderBy("place").rangeBetween(step, step)
        lines, before = held.withColumn("next", F.first("rank").over(on)).where("next is not null").select(*KEY, "place", F.col("rank").alias("k1"), F.col("next").alias("k2")), lines
        lines = materialize(lines, "line-runs")
        discard(before, ranks)
        width += step
    if not found:
        found = [materialize(lines.select(*KEY, "place", F.lit(0).alias("n")).where("false"), "line-repeats")]
    discard(lines, ranks)
    return reduce(DataFrame.union, found)


def suffixes(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each suffix that repeats an earlier one for min_run lines or more: id, print, place, and width, the greatest of
    min_run, 2 * min_run, 4 * min_run, ... that its longest earlier common prefix reaches (so that prefix is shorter than 2 * width)."""
    return repeated_prefixes(docs, min_run, id_col, text_col).where(F.col("n") >= min_run).groupBy(*KEY, "place").agg(F.max("n").alias("width")).withColumnRenamed("id", id_col)


def islands(starts: Column, min_run: int) -> Column:
    """Maximal runs of places covered by the starts (place, width; sorted): at, lines, width (the greatest found in it)."""
    end = lambda s: s["place"] + F.least(s["width"], F.lit(min_run))
    opens = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (i == 0) | (F.get(starts, i)["place"] > end(F.get(starts, F.greatest(i - 1, F.lit(0))))))

    def island(i: Column, k: Column, at: Column) -> Column:
        upto = F.coalesce(F.get(at, k + 1), F.size(starts))
        mine = F.slice(starts, i + 1, upto - i)
        return F.struct(F.get(starts, i)["place"].alias("at"), (end(F.get(starts, upto - 1)) - F.get(starts, i)["place"]).alias("lines"), F.array_max(F.transform(mine, lambda s: s["width"])).alias("width"))

    return let(opens, lambda at: F.transform(at, lambda i, k: island(i, k, at)))


def dedup(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """row (a document's columns as a struct, so that no name can clash), kept (its text without later copies),
    gone (numbers of the deleted lines, in order) and runs (maximal deleted runs of filled lines: at, lines, and
    width, the greatest doubling width that one common prefix within it reaches).

    Lines are those between line feeds; lines of white space alone stay and do not part runs. A line
    goes if it belongs to a run of min_run or more filled lines that also stands earlier: in a smaller id, or
    in the same document before. So of every maximal repeated run the first copy stays whole and all later
    ones go. Runs come from a suffix array of the line sequences, built by prefix doubling until nothing
    repeats (repeated_prefixes): where a suffix repeats r lines, the one behind it repeats r - 1 at least, so
    the suffixes that repeat min_run lines cover all of every longer run, too. With long_words, a single filled
    line of more words than that is a run, too.

    Line ids are 128-bit hashes. Null texts have no line; rows of equal id and text are one document, rows of
    one id with other texts are other documents, in the order of a hash of their texts; a null id comes before
    all others; ids are of any type that has an order. An empty table gives none. Long texts are read whole;
    a document's lines are one row of an array. Other columns are carried, not read.
    """
    found = repeated_prefixes(docs, min_run, id_col, text_col, long_words)
    starts = found.groupBy(*KEY, "place").agg(F.max("n").alias("width")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "width"))).alias("starts"))
    starts = starts.select(F.col("id").alias("_i"), F.col("print").alias("_p"), "starts")
    id_, print_ = keyed(id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), id_, print_)
    rows = rows.join(starts, F.col("id").eqNullSafe(F.col("_i")) & (F.col("print") == F.col("_p")), "left")
    whole, hit = F.col(f"row.`{text_col}`"), F.col("starts").isNotNull()
    runs = F.when(hit, islands(F.col("starts"), min_run)).otherwise(F.expr(RUNS))
    rows = rows.select("row", whole.alias("whole"), runs.alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["lines"] - 1)))
    # Lines are parted once; numbers of filled lines turn places into line numbers.
    gone = let(F.transform(filled(F.split("whole", "\n")), lambda x: x["at"]), lambda at: F.transform(places, lambda p: F.get(at, p)))
    rows = rows.select("row", "whole", "runs", F.when(F.size("runs") > 0, gone).otherwise(F.array().cast("array<int>")).alias("gone"))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    kept = F.when(F.size("gone") > 0, let(F.split("whole", "\n"), without)).otherwise(F.col("whole"))
    return rows.select("row", kept.alias("kept"), "gone", "runs")


def line_digest(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_runs (maximal deleted stretches of lines), kept_sha256."""
    rows = dedup(docs.select("doc_id", "text"), min_run, long_words=long_words)
    breaks = let(F.col("gone"), lambda g: F.size(F.filter(g, lambda x, i: (i == 0) | (x - F.coalesce(F.get(g, i - 1), x) > 1))))
    return rows.select(
        "row.doc_id", F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        breaks.cast("long").alias("n_runs"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = None) -> DataFrame:
    """Documents with later copies of repeated runs deleted, n_chars counted anew, all other columns
    as they were; a document that loses all its filled lines goes."""
    rows = dedup(docs, min_run, long_words=long_words).where((F.size("gone") == 0) | ~F.coalesce(F.col("kept"), F.lit("")).rlike("^\\s*$"))
    out = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*(out[n].alias(n) if out.get(n) is not None else F.col(f"row.`{n}`") for n in docs.columns))
