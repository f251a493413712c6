"""Operators that compare documents, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rivulet.llm import components, decontamination, queries, shared, simhash, substring_dedup

from ..oracle import rows, sql_rows

random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert rows(queries.queries()[name](spark, sf)) == sql_rows(queries.oracle_sql()[name], sf)


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.randrange(60), random.randrange(60)) for _ in range(45)]])
def test_components(spark, edges):
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    with shared.Scratch(spark) as scratch:
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near_brute(docs):
    """docs: (id, text) with ids that aren't null, each once."""
    fp = {i: brute_fingerprint(t) for i, t in docs}
    ids = sorted(fp)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    return fp, roots(ids, edges)


def test_simhash_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fp, root = near_brute(docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


@pytest.mark.parametrize("long_list", [2, 16])
def test_links_of_dense_fingerprints(spark, monkeypatch, long_list):
    """Long lists are split by further bytes: the same links as by all pairs."""
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    random.seed(long_list)
    centers = [random.getrandbits(64) for _ in range(6)]
    low = {centers[0] ^ (centers[0] & 0xFFFF) ^ x for x in random.sample(range(1 << 16), 300)}  # one list of six bytes
    values = low | {c ^ sum(1 << b for b in set(random.choices(range(64), k=random.randint(0, 3)))) for c in centers for _ in range(50)} | {0, 1 << 63, 3 << 62}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    with shared.Scratch(spark) as scratch:
        edges = scratch.table(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), scratch)).collect()
    assert {frozenset((signed[r["a"]], signed[r["b"]])) for r in edges} == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    got = roots(values, [(signed[r["a"]], signed[r["b"]]) for r in edges])
    group = lambda r: sorted(sorted(n for n in r if r[n] == x) for x in set(r.values()))
    assert group(got) == group(want)


def odd(spark, extra=()):
    base = prose(120)
    data = [(5, base), (9, base), (9, base), (7, None), (8, ""), (None, base), (11, "One two"), (12, "one TWO"), (13, "x"), (14, prose(3000)), *extra]
    return spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'a' AS fp", "1 AS component_id", "2 AS n_words", "'z' AS source", "0 AS row"), data


def test_simhash_edges(spark):
    df, _ = odd(spark)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 5), (9, 5), (9, 5), (7, 7), (8, 7), (None, 5), (11, 11), (12, 11), (13, 13), (14, 14)], key=repr)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == [5, 7, 11, 13, 14]
    assert simhash.keep_first(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def removed_brute(docs, window=50):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def digests(found):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_words"].encode()).hexdigest()) for r in found.collect()}


def test_substring_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op9_substring_dedup(spark, sf).collect()}
    assert got == removed_brute(docs)


def test_substrings_of_overlapping_passages(spark):
    """Passages that overlap, repeat within a document, touch the window's length and are periodic."""
    random.seed(9)
    passages = [prose(n) for n in (49, 50, 51, 80, 200)] + ["la " * 120, "a b c " * 40]
    docs = []
    for i in range(60):
        parts = random.choices(passages, k=random.randint(0, 3)) + [prose(random.randint(0, 60)) for _ in range(2)]
        random.shuffle(parts)
        cut = " ".join(parts).split()
        docs.append((i, " ".join(cut[random.randint(0, 20) :])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert digests(substring_dedup.substring_dedup(df)) == removed_brute(docs)


def test_blocks_cut_long_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_BLOCK", 64)
    text = prose(300)
    starts = set()
    for words, counts, at in substring_dedup._blocks([text, "short", prose(70)], 50):
        owner, start, n, *_ = substring_dedup._paths(words, counts, 50, 12)
        for o, s, m in zip(owner.tolist(), start.tolist(), n.tolist()):
            doc, offset = at[o]
            starts |= {(doc, offset + s + j) for j in range(m)}
    assert starts == {(0, i) for i in range(251)} | {(2, i) for i in range(21)}


def test_substring_edges(spark):
    base = prose(60)
    df, data = odd(spark, [(20, base), (21, "start " + base + "\nnext line"), (21, "quite another text"), (22, base.replace(" ", "\u00a0", 1))])
    found = substring_dedup.substring_dedup(df).collect()
    assert len(found) == len(data)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in found), key=repr)
    assert (9, 120, 120) in got and (5, 120, 0) in got and (None, 120, 0) in got and (21, 63, 60) in got and (21, 3, 0) in got and (7, 0, 0) in got
    text = next(r["kept_text"] for r in found if r["doc_id"] == 21 and r["n_removed"])
    assert text == "start\nnext line" or text == "start next line"
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_substring_names_and_ids(spark):
    """Any names of columns, ids that are strings."""
    base = prose(70)
    rows_ = [("b", base), ("a", "Start " + base), (None, base), ("c", None), ("d", base), ("d", base)]
    names = "__id __row __spans __text id text row pieces c0 span kept_words source".split()
    df = spark.createDataFrame(rows_, "key string, body string").selectExpr("key", "body", *[f"'{n}' AS {n}" for n in names])
    found = substring_dedup.substring_dedup(df, "key", "body")
    assert found.columns == [c for c in df.columns if c != "kept_words"] + ["n_words", "n_removed", "kept_words", "kept_text"]
    got = found.collect()
    assert sorted(((r["key"], r["n_removed"]) for r in got), key=repr) == sorted([("a", 0), ("b", 70), (None, 0), ("c", 0), ("d", 70), ("d", 70)], key=repr)
    assert all(r["__spans"] == "__spans" and r["pieces"] == "pieces" for r in got)


def test_spans_are_verified_by_source_coordinates(spark):
    """Digests that lie: spans whose source has other words there lose nothing but runs of a window that are equal."""
    base = prose(200)
    other = base.split()
    other[100] = "changed"
    docs = spark.createDataFrame([(1, base), (2, " ".join(other)), (3, prose(200))], "doc_id long, text string")
    row = lambda t: zlib.crc32(t.encode())
    data = {r["doc_id"]: r["text"] for r in docs.collect()}
    claimed = [(2, row(data[2]), 0, 120, 1, row(base), 0), (2, row(data[2]), 110, 180, 1, row(base), 110), (3, row(data[3]), 5, 150, 1, row(base), 5)]
    spans = spark.createDataFrame(claimed, "doc_id long, row long, start int, end int, source long, source_row long, source_start int")
    with shared.Scratch(spark) as scratch:
        found = {r["doc_id"]: r["pieces"] for r in substring_dedup.with_source_words(docs, spans, scratch).collect()}
    gone = {i: substring_dedup._verified(data[i].encode().split(), found[i], 50) for i in found}
    assert np.flatnonzero(gone[2]).tolist() == [*range(100), *range(101, 180)] and not gone[3].any()


def containment_brute(docs, items):
    import re

    def shingles(text, size=5):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return w, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    out = set()
    for i, it in items:
        w, s = shingles(it)
        size = min(5, len(w))
        s = s or ({tuple(w)} if w else set())
        for d, t in docs:
            have = shingles(t, size)[1] if size else set()
            if s and len(s & have) >= 0.8 * len(s):
                out.add((d, i, len(s), len(s & have)))
    return out


def test_containment_against_brute_force(spark):
    random.seed(11)
    items = [(i, prose(random.randint(1, 60))) for i in range(25)] + [(25, None), (26, "..."), (27, "Only four words here")]
    docs = []
    for d in range(60):
        words = prose(random.randint(0, 200)).split()
        for _ in range(random.randint(0, 2)):
            it = (random.choice(items)[1] or "").split()
            for _ in range(random.randint(0, 4)):
                if it:
                    it[random.randrange(len(it))] = "changed"
            at = random.randint(0, len(words))
            words[at:at] = it
        docs.append((d, ", ".join(words) if d % 3 else " ".join(words).upper()))
    docs.append((99, "so only FOUR words, here!"))
    found = decontamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()} == containment_brute(docs, items)


def test_containment_without_broadcast(spark, sf, monkeypatch):
    want = rows(queries.op3_decontamination(spark, sf))
    monkeypatch.setattr(decontamination, "SKETCH_ROWS", 0)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert rows(queries.op3_decontamination(spark, sf)) == want


def test_containment_edges_and_plan(spark):
    item = prose(30)
    df = spark.createDataFrame([(1, item), (1, "clean"), (2, None), (None, item), (3, ""), (4, prose(20) + " " + item), (4, item)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'h' AS hash", "2 AS item")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, ""), (9, None)], "item_id long, text string").selectExpr("*", "3 AS doc_id", "'s' AS shingle")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.contained_items(df, bench).collect()), key=repr)
    assert got == sorted([(a, b) for a in (1, None, 4, 4) for b in (7, None)], key=repr)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontamination.contained_items(df.limit(0), bench).count() == 0 and decontamination.contained_items(df, bench.limit(0)).count() == 0
    assert not any(w in kept._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline
    from rivulet.llm import quality_classifier

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if quality_classifier.score([r["text"]], weights)[0] >= 0.3}
    _, root = near_brute(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if root[i] == i}
    cut = substring_dedup.substring_dedup(spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")).collect()
    brute = removed_brute(sorted(kept.items()))
    assert {r["doc_id"]: r["n_removed"] for r in cut} == {i: x[1] for i, x in brute.items()}
    kept = {r["doc_id"]: r["kept_text"] if r["n_removed"] else r["text"] for r in cut}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in containment_brute(sorted(kept.items()), items)}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items() if i not in leaks}
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: r["decoded_sha256"] for r in got.collect()} == want
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns and stage.schema.simpleString() == docs.schema.simpleString()
        stage = stage.select(*[F.col(c) for c in docs.columns])


def test_stages_with_odd_rows_and_clashing_columns(spark, sf):
    import corpus_pipeline

    base = prose(80)
    data = [(1, base, "en", "s", 5), (2, base, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, base, "en", "s", 1), (5, prose(2500), "en", "s", 1), (6, "x " + base, "en", "s", 1), (6, "x " + base, "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "predicted", "n_words", "n_removed", "kept_text", "fp", "row", "item_id", "ids", "__text"):
        docs = docs.withColumn(name, F.lit("own"))
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, sf)
            got = frame.collect()
            if k < 4:
                assert frame.columns == docs.columns and all(r["predicted"] == r["kept_text"] == "own" for r in got)
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)
