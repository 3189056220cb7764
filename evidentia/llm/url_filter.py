"""URL filter by a tree of path templates, judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize

#: Path segments that make a template; what lies deeper is one wildcard.
DEPTH = 6
#: A branch with more different values than FANOUT, of fewer than ROWS_PER_VALUE rows each, is a variable.
FANOUT, ROWS_PER_VALUE = 20, 5
#: Rows of prior weight in a purity, the two-sided normal bound for branches that differ, the purity that rejects.
SMOOTHING, Z, REJECT = 10.0, 1.96, 0.5
#: Purity before any label.
PRIOR = 0.2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules: (verdict, host and path prefix), a short list."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def segment(path: Column, k: int) -> Column:
    """The path's k-th segment, generalised: runs of digits and long hexadecimal names become #."""
    part = F.lower(F.coalesce(F.get(F.split(path, "/"), F.lit(k)), F.lit("")))
    if k > DEPTH:
        return F.when(part == "", F.lit("")).otherwise(F.lit("*"))
    part = F.regexp_replace(part, "^[0-9a-f]*[0-9][0-9a-f]*-[0-9a-f-]{8,}$|^[0-9a-f]{16,}$", "#")
    return F.regexp_replace(part, "[0-9]+", "#")


def differs(n: Column, b: Column, m: Column, c: Column) -> Column:
    """Whether b of n and c of m are shares that differ, by a two-proportion test that is multiplied out, so that nothing is
    divided by zero; counts are whole numbers."""
    gap, both, ones = b * m - c * n, n + m, b + c
    return gap * gap * both > Z * Z * ones * (both - ones) * n * m


def siblings(tree: DataFrame, k: int) -> DataFrame:
    """Labelled pages of each branch of level k and of all its siblings that are like it: host, p{k}, n_, b_.

    Siblings in the order of their shares of blocked pages are merged while neighbours do not differ. Those with equal
    counts are one row there, so a host of very many branches is a short list; branches without labels have no share."""
    up = f"p{k - 1}" if k else "host"
    kids = tree.groupBy("host", *([up] if k else []), f"p{k}").agg(F.sum("labelled").cast("double").alias("n"), F.sum("blocked").cast("double").alias("b"))
    if not k:
        return kids.select("host", "p0", F.col("n").alias("n_"), F.col("b").alias("b_"))
    kinds = kids.where("n > 0").groupBy("host", up, "n", "b").agg(F.count("*").alias("m"))
    order = Window.partitionBy("host", up).orderBy(F.col("b") / F.col("n"), "n")
    before = [F.lag(c).over(order) for c in ("n", "b")]
    kinds = kinds.withColumn("new", F.coalesce(differs(F.col("n"), F.col("b"), *before).cast("int"), F.lit(0)))
    kinds = kinds.withColumn("like", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pool = Window.partitionBy("host", up, "like")
    kinds = kinds.select("host", up, "n", "b", F.sum(F.col("m") * F.col("n")).over(pool).alias("n_"), F.sum(F.col("m") * F.col("b")).over(pool).alias("b_"))
    return kids.join(kinds, ["host", up, "n", "b"], "left").select("host", f"p{k}", F.coalesce("n_", F.lit(0.0)).alias("n_"), F.coalesce("b_", F.lit(0.0)).alias("b_"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (the longest that fits, else null), verdict (block or allow).

    A fitting rule decides and also labels its page. Every other page is judged by its template. Templates
    form a tree for each host, DEPTH segments deep: segments with digits or long hexadecimal names are generalised at
    once, branches of many rare values become a wildcard, and siblings whose shares of blocked pages are alike are
    merged. Going down from the host, branches keep a purity of their own (labelled blocks in labelled pages,
    smoothed towards the parent's, a host's towards PRIOR) only if they differ from the parent by a two-proportion
    test; similar ones, and those without labels, share the parent's. A purity of REJECT or more blocks.

    Counts are taken by template before any join, so a host of a third of all pages is summed in parts.
    A null url, or one without ://, has an empty host and path and is judged by the template of those; very long
    urls are read whole. Null ids are kept, repeated rows give a row each; an empty table none. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, ruled = best_rule(F.col("host"), F.col("path"), rules)
    keys = [f"g{k}" for k in range(1, DEPTH + 2)]
    rows = rows.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), *(segment(F.col("path"), k).alias(f"g{k}") for k in range(1, DEPTH + 2)))
    tree = rows.groupBy("host", *keys).agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    # Each level of the tree uses its predecessor twice, so every level is a table of its own.
    tree = materialize(tree.withColumn("p0", F.lit("")), "url-tree")
    # Levels below the deepest path have one empty branch each and change nothing.
    deep = tree.agg(*(F.max(F.col(g) != "").alias(g) for g in keys)).first()
    depth = max([k for k in range(1, DEPTH + 1) if deep[f"g{k}"]], default=0)
    for k in range(1, depth + 1):
        # Values of this segment below one parent, counted first by value and then by parent.
        values = tree.groupBy("host", f"p{k - 1}", f"g{k}").agg(F.sum("n").alias("m")).groupBy("host", f"p{k - 1}").agg(F.count("*").alias("d"), F.sum("m").alias("m"))
        variable = (F.col("d") > FANOUT) & (F.col("m") < F.col("d") * ROWS_PER_VALUE)
        grown = tree.join(values, ["host", f"p{k - 1}"])
        grown = grown.withColumn(f"p{k}", F.concat(f"p{k - 1}", F.lit("/"), F.when(variable & (F.col(f"g{k}") != ""), "*").otherwise(F.col(f"g{k}")))).drop("d", "m")
        before, tree = tree, materialize(grown, "url-tree")
        discard(before)
    tree = tree.withColumns({"purity": F.lit(PRIOR), "up_n": F.lit(0.0), "up_b": F.lit(0.0)})
    for k in range(depth + 1):
        held = tree.join(siblings(tree, k), ["host", f"p{k}"])
        n, b, up_n, up_b = F.col("n_"), F.col("b_"), F.col("up_n"), F.col("up_b")
        apart = differs(n, b, up_n, up_b) if k else F.lit(True)
        own = (b + SMOOTHING * F.col("purity")) / (n + SMOOTHING)
        held = held.select(
            "host", *keys, "labelled", "blocked", *(f"p{i}" for i in range(k, depth + 1)),
            F.when(apart, own).otherwise(F.col("purity")).alias("purity"), F.when(apart, n).otherwise(up_n).alias("up_n"), F.when(apart, b).otherwise(up_b).alias("up_b"),
        )
        tree = materialize(held, "url-tree")
    verdicts = tree.select("host", *keys, F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("judged"))
    out = rows.join(verdicts, ["host", *keys], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"))
