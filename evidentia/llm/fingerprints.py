"""Document fingerprints of closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import let, partitions

#: Units of a k-mer.
K = 5
#: A run of more characters without white space is taken by characters.
UNSPACED = 32
#: Ranges of ids: so many for each shuffle partition at least, one for so many bytes of text, and at most.
BOXES, BOX_BYTES, MAX_BOXES = 4, 256 << 20, 16_384
#: Ids of a sample that set the limits of a range, and ranges looked up at a time.
EACH, FAN = 32, 128

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def units(text: Column) -> Column:
    """Words between white space; in place of a word of more than UNSPACED characters, its characters."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    parted = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > UNSPACED, F.split(w, "")).otherwise(F.array(w))))
    return let(words, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > UNSPACED), parted(ws)).otherwise(ws))


def anchors(text: Column) -> Column:
    """All anchors of a text in their order: hash and place (number of the first unit).

    A k-mer is an anchor if the least of its unit hashes stands first or last in it (a closed syncmer); so
    whether it is one depends on the k-mer alone, wherever it stands, and of K - 1 k-mers in a row one is. A text
    too short for an anchor, or without one, has its whole sequence as the only one; one without units has none.
    """

    def edges(h: Column) -> Column:
        def is_edge(i: Column) -> Column:
            inner = F.least(*(F.get(h, i + j) for j in range(1, K - 1)))
            return F.least(F.get(h, i), F.get(h, i + (K - 1))) <= inner

        all_ = F.when(F.size(h) >= K, F.sequence(F.lit(0), F.size(h) - K)).otherwise(F.array().cast("array<int>"))
        kmers = F.transform(F.filter(all_, is_edge), lambda i: F.struct(F.xxhash64(*(F.get(h, i + j) for j in range(K))).alias("hash"), i.alias("place")))
        whole = F.when(F.size(h) > 0, F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("place")))).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))
        return let(kmers, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))

    return let(F.transform(units(text), lambda u: F.xxhash64(u)), edges)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the distinct hashes of two texts' anchors, all of them; of two empty ones 1."""

    def shares(u: Column, v: Column) -> Column:
        return let(F.size(F.array_intersect(u, v)), lambda both: F.when((F.size(u) == 0) & (F.size(v) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(u) + F.size(v) - both, F.lit(1))))

    return let(F.array_distinct(a["hash"]), lambda u: let(F.array_distinct(b["hash"]), lambda v: shares(u, v)))


def shared_places(a: Column, b: Column) -> Column:
    """Where two texts share anchors: (place in a, place in b) for each anchor of a whose hash stands once in b. A shared
    passage is a row of them at one distance."""
    once = lambda x: F.filter(x, lambda e, i: (F.array_position(x["hash"], e["hash"]) == i + 1))
    places = lambda b1: F.map_from_arrays(b1["hash"], b1["place"])
    return let(places(once(b)), lambda m: F.transform(F.filter(a, lambda e: F.map_contains_key(m, e["hash"])), lambda e: F.struct(e["place"].alias("a"), F.try_element_at(m, e["hash"]).alias("b"))))


def printed(found: Column) -> Column:
    """128 bits that name a text's anchors in their order; nothing for a text without any."""
    hashes = found["hash"]
    return F.when(F.size(hashes) == 0, "").otherwise(F.lower(F.concat(F.lpad(F.hex(F.xxhash64(hashes)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), hashes)), 16, "0"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars (code points), anchors (hash and place, all of them), fingerprint (a digest of them).

    Null texts count as empty; both have no anchor and an empty fingerprint. Repeated rows give a row each, an
    empty table none; long texts are read whole. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`"), F.length(text).cast("long").alias("n_chars"), anchors(text).alias("anchors"))
    return rows.withColumn("fingerprint", printed(F.col("anchors")))


def boxes(docs: DataFrame, size: int = 0) -> Column:
    """The range of a row (id, text_hash) of a table with `size` bytes of text, from the greatest ids on: limits are quantiles of a sample
    of ids that a hash chooses, EACH for each range, so they follow the ids however these lie. An id of more rows than two ranges
    should hold has ranges of its own, by text_hash, as many as its rows ask for; so have the rows without an id, which come last."""
    spark = docs.sparkSession
    n = min(MAX_BOXES, max(BOXES * partitions(spark), -(-size // BOX_BYTES)))
    held = docs.agg(F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("no_id")).first()
    total, share = held["rows"], max(1, held["rows"] // (n * EACH))
    parts = lambda rows: max(1, -(-rows * n // max(total, 1)))
    within_hash = lambda k: F.least(F.floor((F.col("text_hash") / 2.0**64 + 0.5) * k), k - 1)
    # At most n / 2 ids.
    hot = docs.where("id is not null").groupBy("id").count().where(F.col("count") > max(EACH, 2 * total // n))
    hot = sorted(((r["id"], parts(r["count"])) for r in hot.collect()), key=lambda x: x[0], reverse=True)
    sample = docs.select("id").where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(share)) == 0)).distinct()
    # Every EACH-th id of the sample, chosen by the executors.
    every = F.transform(F.sequence(F.lit(EACH), F.size("ids") - 1, F.lit(EACH)), lambda k: F.get("ids", k))
    limits = sample.agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.when(F.size("ids") > EACH, every).alias("limits")).first()["limits"] or []
    kind = docs.schema["id"].dataType
    lit = lambda xs: F.array(*(F.lit(x).cast(kind) for x in xs)).cast(f"array<{kind.simpleString()}>")
    beyond = lambda xs: F.size(F.filter(xs, lambda x: x >= F.col("id")))
    # Two looks of FAN limits each, not one of all.
    groups = [limits[k : k + FAN] for k in range(0, len(limits), FAN)]
    higher = beyond(lit([g[0] for g in groups]))  # groups whose least limit is not below the id
    part = F.array(*(lit(g) for g in groups)) if groups else F.array(lit([]))
    whole = F.greatest(F.lit(len(groups)) - higher - 1, F.lit(0))
    inside = F.coalesce(F.size(F.get(part, whole)) - beyond(F.get(part, whole)), F.lit(0))
    box = (F.lit(len(limits)) - (whole * FAN + inside)).cast("long")
    places = 1
    if hot:
        # Within its range, an id is before, among or behind the hot ones; one of these has its parts, in the order of its rows.
        first = [1]
        for _, k in hot:
            first.append(first[-1] + k + 1)
        places = first[-1]
        numbers = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        names = lit([i for i, _ in hot])
        among, before = F.array_contains(names, F.col("id")), beyond(names)
        part = F.get(numbers(first), before - 1) + within_hash(F.get(numbers([k for _, k in hot]), before - 1))
        box = box * places + F.when(among, part).otherwise(F.get(numbers(first), before) - 1)
    box = F.when(F.col("id").isNull(), F.lit((len(limits) + 1) * places) + within_hash(F.lit(parts(held["no_id"])))).otherwise(box)
    # Never null, and told so, or the joins by range would filter what they read and not share it.
    return F.coalesce(box.cast("long"), F.lit(0).cast("long"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, next_text: of the next document in descending order of id, after the last the first. Ids are of any
    type that has an order; equal ids are in the order of a hash of their texts, and null ids, likewise, behind all others.

    Texts are dealt once, by ranges of ids with about as many rows each. Only the last document of a range
    looks beyond it, to the first of the next filled one; the list of ranges is as long as there are ranges.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.withColumn("box", boxes(docs, size))
    # As many rows as there are boxes: the ranges, and parts of hot ids and of rows without one, are some 3 * MAX_BOXES at most.
    filled = sorted(r["box"] for r in docs.select("box").distinct().collect())
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "tail_box long, head_box long")
    # All three uses below read the same plain columns of the same exchange, which Spark then runs once.
    rows = docs.select("id", "text", "text_hash", "box").repartition("box")
    order = Window.partitionBy("box").orderBy(F.desc("id"), "text_hash", "text")
    rows = rows.withColumns({"rank": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    inner = rows.where("next_text is not null").select("id", "text", "next_text")
    heads = rows.where("rank = 1").select(F.col("box").alias("head_box"), F.col("text").alias("next_text"))
    tails = rows.where("next_text is null").select("id", "text", F.col("box").alias("tail_box"))
    return inner.unionByName(tails.join(F.broadcast(follows), "tail_box").join(heads, "head_box").select("id", "text", "next_text"))


def edit_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose latter half is the beginning of the next document.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (likeness of all anchors). Null texts count as empty; repeated rows give a row each; an empty
    table gives none; the only document is its own next. Long texts are read whole.
    """
    rows = with_next(docs, "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), anchors(F.col("text")).alias("mine"), anchors(edited).alias("edited"), anchors(F.col("next_text")).alias("next"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", printed(F.col("mine")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("edited")).alias("near_edited"), likeness(F.col("mine"), F.col("next")).alias("near_next"),
    )
