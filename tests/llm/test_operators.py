import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from brute import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import decontaminate, fingerprints, jaccard_join, line_dedup, packing, quality, suffix_dedup, token_counts, token_files, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def true_ids(rows, path=VOCABULARY):
    held = Tokenizer.from_file(path)
    return {i: e.ids for (i, _), e in zip(rows, held.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}


@pytest.mark.parametrize("extra", [False, True])
def test_pack(odd, frame, extra):
    ids = {i: np.array([*x, 2], "<u4") for i, x in true_ids(odd).items()}
    for capacity in (64, 4096):
        got = packing.pack(frame(odd, extra), VOCABULARY, capacity).collect()
        seen = {}
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for i, x in ids.items():
            at = 0
            for start, length in sorted(seen[i]):
                assert start == at
                at += length
            assert at == len(x)
        rows = {}
        for r in got:
            rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for held in rows.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(rows) <= 1.05 * sum(map(len, ids.values())) / capacity + 2
    assert sorted(rows) == list(range(len(rows)))


def test_pack_plan_reaches_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(511, rng.geometric(0.02, 20_000))
    classes, counts = np.unique(lengths, return_counts=True)
    places = packing.plan(classes, counts, 512)
    used = {}
    for k, (width, first, each, sequence) in enumerate(places.tolist()):
        last = places[k + 1][1] if k + 1 < len(places) and places[k + 1][0] == width else counts[classes == width][0]
        for s in range(sequence, sequence + (last - first) // each):
            used[s] = used.get(s, 0) + width * each
    assert max(used.values()) <= 512 and sum(used.values()) == lengths.sum()
    assert len(used) <= 1.003 * lengths.sum() / 512 + 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts(odd, frame, name):
    path = public_tokenizers.path(name)
    ids = true_ids(odd, path)
    want = [(i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 50) for i, t in sorted(odd, key=lambda r: r[0])]
    assert rows_of(token_counts.token_counts(frame(odd, True), path, 50), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_odd_characters_are_encoded_exactly():
    from evidentia.llm import _tokens
    from evidentia.llm._shared import utf8
    import pyarrow as pa

    rng = random.Random(3)
    alphabet = "aAbZ" + "".join(map(chr, [0xE9, 0x301, 0xC9, 0xDF, 0xD8, 0xF8, 0x130, 0x131, 0x3A3, 0x3C3, 0x3C2, 0xD7, 0xF7, 0x149, 0x17F, 0x1C5, 0x24F, 0x345, 0x200B, 0x4E2D, 0x1F600, 0x661, 0x2028, 0x85])) + " .,!?'<|>_-\n\t\r  12"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>x<|ENDOFTEXT|>"]
    held = _tokens.Encoder(VOCABULARY)
    for _ in range(2):  # the second time from the cache
        ids, first = held.encode(*utf8(pa.array(texts, pa.large_string())))
        got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == [e.ids for e in held.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_files(odd, frame, spark, tmp_path):
    rows = [*odd, odd[0], (None, "no id")]
    path = token_files.write_token_files(frame(rows, True), VOCABULARY, str(tmp_path / "files"))
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = true_ids(rows)
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]))
    at = 0
    for r, (i, _) in zip(got, order, strict=True):
        x = np.array([*ids[i], 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    one = token_files.read_document(spark, path, 9009)
    assert len(one) == 1 and one[0].tolist() == [*ids[9009], 2]
    found = token_files.blocks_with(spark, path, 30)
    assert "PushedFilters: [IsNotNull(low), IsNotNull(high), LessThanOrEqual(low,30), GreaterThanOrEqual(high,30)]" in found._jdf.queryExecution().executedPlan().toString()
    held = spark.read.parquet(f"{path}/blocks")
    assert found.count() == 1 < held.count()
    held.withColumn("dictionary", F.lit("other")).write.parquet(str(tmp_path / "bad" / "blocks"))
    spark.read.parquet(f"{path}/dictionary").write.parquet(str(tmp_path / "bad" / "dictionary"))
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("bits", [1 << 27, 1 << 11])
def test_decontamination(odd, frame, spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)  # the smaller one: several passes
    items = [(1, odd[20][1]), (2, "one two"), (3, None), (4, "!!"), (5, "w1"), (None, "a b c d e"), (7, odd[30][1]), (7, "zzz"), (8, " ".join(words(random.Random(1), 40)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = [*odd, odd[20]]
    want = sorted(brute.contamination(rows, items))
    assert rows_of(decontaminate.contamination_digest(frame(rows, True), bench), *names) == want
    kept = decontaminate.clean(frame(rows, True), bench)
    assert kept.columns == frame(rows, True).columns and rows_of(kept, "doc_id") == [(w[0],) for w in want if not w[5]]


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup(odd, frame, run):
    rows = [*odd, (3001, "a\na\na\na\na\na"), (3002, "x\na\na"), (3003, "a\n \na"), (3004, "\n\n\n\n")]
    want = brute.lines(rows, run)
    got = rows_of(line_dedup.line_digest(frame(rows, True), run), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted((i, n, k, brute.sha(t.encode())) for i, n, k, t in want)
    kept = line_dedup.clean(frame(rows, True), run)
    assert kept.columns == frame(rows, True).columns
    assert rows_of(kept.where("text is not null"), "doc_id", "text", "n_chars") == sorted((i, t, len(t)) for i, n, k, t in want if i != 9000 and not (k and not t.strip(" \t\n\x0b\f\r")))


def test_long_lines_alone_are_runs(frame):
    """With long_words, every later copy of one line of more words goes; shorter ones still need a neighbour."""
    line = " ".join(f"p{k}" for k in range(51))
    short = line.rsplit(" ", 1)[0]
    rows = [(1, f"a\n{line}\nb"), (2, f"c\n \n{line}\nd\n{line}"), (3, line), (4, f"e\n{short}\nf"), (5, f"g\n{short}\nh"), (6, f"a\n{line}\nx"), (None, f"{line}\nz")]
    digest = lambda n: dict(rows_of(line_dedup.line_digest(frame(rows), 2, long_words=n).where("doc_id is not null"), "doc_id", "n_removed"))
    assert digest(50) == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0, 6: 2} and digest(None) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 2} and digest(49)[5] == 1
    kept = line_dedup.clean(frame(rows, True), 2, long_words=50)
    assert rows_of(kept.where("doc_id is not null"), "doc_id", "text") == [(1, "a\nb"), (2, "c\n \nd"), (4, rows[3][1]), (5, rows[4][1]), (6, "x")]


def test_equal_rows_are_one_document_of_lines(odd, frame):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb")]
    got = rows_of(line_dedup.line_digest(frame(rows)).where("doc_id is not null"), "doc_id", "n_removed")
    assert got == [(1, 2), (1, 2)]


def test_urls(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "example.net/de/8")]
    urls = ["https://A.Example.COM/en/71?x=/y", "http://b.com/en/1#f", "http://notcom/en/1", "http://xcom/en/1", "http://example.net/de/8/9", "https://example.net", "no scheme", None, "http://host?q=http://a.com/en/1", "http://h.com/EN/1", "ftp://u@x.com:80/en/"]
    df = spark.createDataFrame([*enumerate(urls), (1, urls[1])], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("n", F.lit(1))
    got = rows_of(url_filter.judge(df, rules), "page_id", "host", "path", "rule")
    want = [("a.example.com", "/en/71", "example.com/en/7"), ("b.com", "/en/1", "com/en/"), ("notcom", "/en/1", None), ("xcom", "/en/1", None), ("example.net", "/de/8/9", "example.net/de/8"), ("example.net", "", None), ("", "", None), ("", "", None), ("host", "", None), ("h.com", "/EN/1", None), ("u@x.com:80", "/en/", None)]
    assert [g for g in got if g[0] != 1] == [(i, *w) for i, w in enumerate(want) if i != 1] and got.count((1, *want[1])) == 2


def test_url_templates_follow_labels(spark):
    """Pages like labelled ones are judged like them; unlabelled branches are not blocked."""
    rows = [(i, f"http://a.org/spam/{i}") for i in range(50)] + [(100 + i, f"http://a.org/news/{i}/story{i}.html") for i in range(50)] + [(200, "http://a.org/spam2/1"), (201, "http://b.org/spam/1"), (202, "http://a.org/spam/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, [("block", "a.org/spam/1"), ("block", "a.org/spam/2"), ("allow", "a.org/news/")]).collect()}
    assert all(out[i] == "block" for i in range(50)) and all(out[100 + i] == "allow" for i in range(50)) and out[201] == "allow"


def test_unlabelled_url_branches_keep_the_host_purity(spark):
    """Under a host of blocked labels an undecided sibling branch is judged like the host, however deep; a host without labels is allowed."""
    rows = [(i, f"http://a.org/en/{i}") for i in range(40)] + [(100, "http://a.org/de/1"), (101, "http://a.org/EN/1"), (102, "http://a.org/"), (103, "http://a.org/x/y/z/u/v/w/q"), (104, "http://b.org/en/1"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, [("block", "a.org/en/")]).collect()}
    assert all(out[i] == ("a.org/en/", "block") for i in range(40))
    assert out[100] == out[101] == out[102] == out[103] == (None, "block") and out[104] == out[None] == (None, "allow")


def test_similar_siblings_are_judged_together(spark):
    """Small branches of blocked pages, each too small to differ from its host, are merged and then differ from it."""
    rows, rules = [], [("allow", "a.org/good/")]
    for k in range(200):
        rows.append((k, f"http://a.org/good/{k}.html"))
    for j, name in enumerate("abcdef"):
        rows += [(1000 + 10 * j + k, f"http://a.org/{name}x/bad{k}") for k in range(5)]
        rows.append((2000 + j, f"http://a.org/{name}x/other"))
        rules.append(("block", f"a.org/{name}x/bad"))
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(out[2000 + j] == "block" for j in range(6)) and all(out[k] == "allow" for k in range(200))
    alone = [r for r in rows if r[0] < 1010 or r[0] == 2000]
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(alone, "page_id long, url string"), rules).collect()}
    assert out[2000] == "allow"


def test_fingerprints(odd, frame):
    rows = sorted([*odd, (5000, odd[0][1])], key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.edit_digest(frame(rows, True)).collect()}
    by_text = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), brute.sha(edited.encode()))
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert got[i]["near_edited"] == pytest.approx(brute.likeness(text, edited), abs=1e-12) and got[i]["near_next"] == pytest.approx(brute.likeness(text, after), abs=1e-12)
        if edited == text:
            assert got[i]["near_edited"] == 1
    assert got[9000]["fingerprint"] == ""
    long = [got[i] for i, t in rows if len((t or "").split()) > 60]
    assert np.mean([r["near_edited"] for r in long]) > 0.2


def test_anchors_are_closed_syncmers(odd, frame):
    got = {r["doc_id"]: [tuple(a) for a in r["anchors"]] for r in fingerprints.fingerprints(frame([*odd, (7000, "ab" * 16 + " " + "cd" * 17)], True)).collect()}
    assert all(got[i] == brute.anchors(t) for i, t in odd) and len(got[7000]) > 5


def test_shared_passages_are_placed(spark):
    rng = random.Random(8)
    passage, one, two = words(rng, 40, 10**6), words(rng, 3000, 10**6), words(rng, 200, 10**6)
    df = spark.createDataFrame([(" ".join([*one[:1000], *passage, *one[1000:]]), " ".join([*two[:50], *passage, *two[50:]]))], "a string, b string")
    found = df.select(fingerprints.shared_places(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))).alias("m")).first()["m"]
    assert len(found) >= 8 and {x["a"] - x["b"] for x in found} == {950} and all(1000 <= x["a"] <= 1035 for x in found)


def test_a_few_characters_do_not_change_all_units(spark):
    text = "x" * 900 + " " + " ".join(words(random.Random(1), 30))
    rows = spark.createDataFrame([(text[:n], text[: n + 4]) for n in (500, 890, 1020)], "a string, b string")
    near = rows.select(fingerprints.likeness(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))).alias("x")).collect()
    assert all(r["x"] > 0.8 for r in near)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_documents_of_odd_ids(spark, monkeypatch, kind):
    """Far outliers, the least long, repeated and missing ids, and ids that are no integers."""
    monkeypatch.setattr(fingerprints, "EACH", 8)
    monkeypatch.setattr(fingerprints, "FAN", 4)
    ids = [*range(400), 10**15, -(2**63), 7, 7, None, None, None]
    texts = [f"text {k} of its own" for k in range(len(ids))]
    df = spark.createDataFrame(list(zip(map(str, ids), texts, strict=True)), "i string, text string").selectExpr(f"cast(nullif(i, 'None') as {kind}) as doc_id", "text")
    held = fingerprints.with_next(df, "doc_id", "text").collect()
    after = {r["text"]: r["next_text"] for r in held}
    key = {t: str(i) if kind == "string" else i for t, i in zip(texts, ids, strict=True) if i is not None}
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(sorted(key, key=lambda t: hashed[t]), key=lambda t: key[t], reverse=True)
    order = [t for _, g in __import__("itertools").groupby(order, key=lambda t: key[t]) for t in sorted(g, key=lambda t: hashed[t])]
    last = [t for t in texts if t not in key]
    assert len(held) == len(ids) == len(after) and all(after[a] == b for a, b in zip(order[:-1], order[1:], strict=True))
    assert after[order[-1]] in last and sum(after[t] in last for t in last) == len(last) - 1 and [after[t] for t in last if after[t] not in last] == [order[0]]
    sizes = df.withColumnRenamed("doc_id", "id").withColumn("text_hash", F.xxhash64("text"))
    assert max(r["count"] for r in sizes.withColumn("box", fingerprints.boxes(sizes)).groupBy("box").count().collect()) <= 100


def test_one_document_follows_itself(frame):
    out = fingerprints.edit_digest(frame([(1, "a b c d e f g h")])).first()
    assert out["near_next"] == 1 and out["edited_sha256"] == brute.sha(b"a b c d a b c d"[:8] + b"a b c d "[:7])


@pytest.mark.parametrize("width", [100, 20])
def test_suffix_dedup(odd, frame, width):
    got = rows_of(suffix_dedup.repeat_digest(frame(odd, True), width), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(odd, width))


def test_rows_without_id_keep_their_own_bytes(frame):
    rows = [(None, "abcdefghij" * 3 + "x"), (None, "0123456789" * 3), (1, "abcdefghij" * 3)]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeat_digest(frame(rows), 25).collect())
    assert got == [(30, 0), (30, 30), (31, 0)]


def test_suffix_dedup_by_small_steps(odd, frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    got = rows_of(suffix_dedup.repeat_digest(frame([*odd, odd[5]]), 30), "doc_id", "n_removed", "kept_sha256")
    assert sorted(set(got)) == sorted((r[0], r[2], r[4]) for r in brute.repeats(odd, 30)) and len(got) == len(odd) + 1


@pytest.mark.parametrize("part", [2048, 4])
def test_jaccard(odd, frame, monkeypatch, part):
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = random.Random(11)
    base = words(rng, 120)
    rows = list(odd)
    for k in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(text)))
    got = rows_of(jaccard_join.linked(frame([*rows, rows[0]], True)), "doc_id", "n_shingles", "component_id")
    assert sorted(set(got)) == sorted(brute.linked(rows)) and len(got) == len(rows) + 1


def test_jaccard_keeps_one_of_a_group(odd, frame):
    want = {i for i, n, c in brute.linked(odd) if c == i}
    kept = jaccard_join.clean(frame(odd, True))
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == frame(odd, True).columns


def test_tree_join_finds_all_within_the_bound():
    rng = np.random.default_rng(2)
    vectors = rng.poisson(0.5, (150, 64)).astype(np.uint8)
    vectors[75:] = vectors[:75]
    vectors[75:, 0] += 1
    n, comp = vectors.sum(1).astype(np.int64), np.arange(150)
    tree = jaccard_join.Tree(n, vectors.astype(np.uint16), comp)
    a, b = jaccard_join.tree_join(tree, tree, 75)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 175 * np.minimum(vectors[i], vectors[j]).sum() >= 75 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])}
    assert got == want


def test_quality(frame, spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = words(rng, rng.randint(5, 60), 5000)
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        if i < 250:
            labels.append((i, int(good), 0))
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_with_labels(frame([*rows, (9000, None), (9001, "")], True), held).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in range(250, 400)]) > 0.97
    assert got[9000]["score"] == got[9001]["score"]
    kept = quality.clean(frame(rows, True), held)
    assert kept.columns == frame(rows, True).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if i < 400 and r["predicted"]}


def test_held_out_labels_change_nothing(frame, spark):
    rows = [(i, " ".join(words(random.Random(i), 20))) for i in range(120)]
    score = lambda labels: rows_of(quality.score_with_labels(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int")), "doc_id", "score")
    labels = [(i, i % 2) for i in range(120)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    assert score(labels) == score(flipped) and score([]) == [(i, 0.5) for i in range(120)]


EMPTY = {
    "pack": lambda f, s: packing.pack(f([]), VOCABULARY), "counts": lambda f, s: token_counts.token_counts(f([]), VOCABULARY, 5), "files": lambda f, s: token_files.token_file_digest(f([]), VOCABULARY),
    "lines": lambda f, s: line_dedup.line_digest(f([])), "prints": lambda f, s: fingerprints.edit_digest(f([])), "suffix": lambda f, s: suffix_dedup.repeat_digest(f([])), "jaccard": lambda f, s: jaccard_join.linked(f([])),
    "quality": lambda f, s: quality.score_with_labels(f([]), s.createDataFrame([], "doc_id long, quality int")), "benchmark": lambda f, s: decontaminate.contamination_digest(f([]), s.createDataFrame([], "item_id long, text string")),
    "urls": lambda f, s: url_filter.judge(s.createDataFrame([], "page_id long, url string"), [("block", "com/")]),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables(frame, spark, name):
    assert EMPTY[name](frame, spark).collect() == []


def test_no_benchmark_hits_nothing(odd, frame, spark):
    out = decontaminate.contamination_digest(frame(odd), spark.createDataFrame([], "item_id long, text string"))
    assert out.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and out.count() == len(odd)


def test_long_texts_are_taken_by_parts(monkeypatch):
    """Every window of a long text is in one part, and has the anchor that it has in the whole."""
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 100, 2900, 2950, 3000])

    def windows():
        out = {}
        for a, b, base, off in suffix_dedup.steps(offsets, 50):
            _, owner, at, count, anchor, place = suffix_dedup.anchored(data[offsets[a] + base : offsets[a] + base + off[-1]], off, 50)
            for o, s, n, h, p in zip(owner, at, count, anchor, place, strict=True):
                for k in range(n):
                    window = (a + int(o), base + int(s + k - off[o]))
                    assert window not in out
                    out[window] = (int(h), int(p - s - k))
        return out

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 300)
    assert windows() == whole and len(whole) == 51 + 2751 + 1 + 1
