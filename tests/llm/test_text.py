"""Operators that look at one text at a time, against the libraries and brute force."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rivulet.llm import byte_bpe, html_extract, pretokens, quality_classifier, quality_rules, queries, shared, token_count, token_store, url_filter, vocabulary

ODD = ["", " ", "\n\n", "a\n\n", "a  b", "a   b ", "x\n \ny", "a\x1c!\x1d?", "ΑΣ ΣΑΣ", "é e\u0301", "<|endoftext|>a<|startoftext|><|endoftext|> b", "I'll it's 'S", "İI ẞ ﬁ", "12 34٣ ½²", "a\u2003b\u3000", "\x85 x\xa0y", "😀👍🏽 z", "tab\tx\r\n y", "a\n\n\nb c  \n", "x***\n!!y's"]
random.seed(1)
ODD += ["".join(random.choices("ab Z'sdl1٣\n\t éΣσ<|>!\x1c\x85\u200b漢½", k=random.randint(1, 25))) for _ in range(400)]
alphabet = st.text(st.sampled_from(list("ab 's\n\téΣ!%|1\u2003漢")), max_size=40)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ODD


def read(name):
    with open(P.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def words():
    return token_count.TextCounter(read("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_counts_are_the_library_s(words, texts):
    mine, theirs = words
    for t, n in zip(texts, mine(pa.array(texts)).tolist()):
        assert n == len(theirs.encode(t, add_special_tokens=False).ids), t


@settings(max_examples=200, deadline=None)
@given(alphabet)
def test_counts_of_any_text(text):
    mine = _cached("count", lambda: token_count.TextCounter(read("word_bpe_49k.json")))
    theirs = _cached("library", lambda: Tokenizer.from_file(P.path("word_bpe_49k.json")))
    assert mine(pa.array([text, "", text])).tolist() == [len(theirs.encode(t, add_special_tokens=False).ids) for t in (text, "", text)]


_CACHE = {}


def _cached(key, make):
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read("byte_bpe_multi_50k.tiktoken").splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktoken_s(texts):
    codec, theirs = byte_bpe.Codec(read("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken_encoding()
    for part in (texts, texts[1:], [""], []):
        ids = codec.encode(pa.array(part, pa.string()))
        assert ids.to_pylist() == [theirs.encode_ordinary(t) for t in part]
        assert codec.decode(ids).to_pylist() == [t.encode() for t in part]
        assert codec.decode(ids[1:]).to_pylist() == [t.encode() for t in part[1:]]


def test_store_encoder_is_the_library_s(texts):
    mine, theirs = token_store.LibraryEncoder(read("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = mine(pa.array(texts))
    for t, ids in zip(texts, found.to_pylist()):
        assert ids == theirs.encode(t, add_special_tokens=False).ids, t
    assert token_store.with_end(found[1:], 7).to_pylist() == [[*x, 7] for x in found[1:].to_pylist()]


@settings(max_examples=200, deadline=None)
@given(alphabet)
def test_encoders_of_any_text(text):
    mine = _cached("store", lambda: token_store.LibraryEncoder(read("byte_bpe_50k.json")))
    theirs = _cached("store library", lambda: Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    batch = [text, "", "a" + text + "b c", text + "\n\n"]
    assert mine(pa.array(batch)).to_pylist() == [theirs.encode(t, add_special_tokens=False).ids for t in batch]


def test_memo_is_bounded_by_bytes():
    made = []
    memo = pretokens.Memo(lambda k: made.append(k) or b"xxxx", 20_000)
    for i in range(5000):
        assert memo[f"k{i}"] == b"xxxx"
        assert sum(map(len, (memo, memo.old))) < 300
    n = len(made)
    assert memo["k4999"] == b"xxxx" and len(made) == n
    assert memo["k" * 1000] == b"xxxx" and "k" * 1000 not in memo


def odd_documents(spark):
    rows = [(3, "b a"), (1, None), (2, ""), (3, "b a"), (None, "x y"), (7, "word " * 30000), (8, "<|endoftext|> é\n\nz")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS ids", "0 AS n_tokens", "1 AS score", "'z' AS shard")


def test_token_counts_edges(spark):
    found = token_count.over_limit(token_count.token_counts(odd_documents(spark), P.path("word_bpe_49k.json")))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False), (None, 3, 2, False), (7, 150000, 30000, True), (8, 19, 3, False)], key=repr)
    assert token_count.token_counts(odd_documents(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_byte_bpe_round_trip_and_edges(spark):
    found = byte_bpe.byte_bpe(odd_documents(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode()[:9] for r in found) == sorted(["b a", "", "", "b a", "x y", "word word", "<|endofte"])
    assert all(len(r["ids"]) == 0 for r in found if r["doc_id"] in (1, 2))


def test_byte_bpe_query_digests(spark, sf):
    theirs = tiktoken_encoding()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, sf).collect():
        ids = theirs.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())


def test_store_query(spark, sf):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_store(spark, sf).collect()}
    start = 0
    for doc, text in docs:
        ids = np.array([*theirs.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_edges_and_files(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "store")
    token_store.write_store(odd_documents(spark), path, P.path("byte_bpe_50k.json"))
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read_store(spark, path).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, 1, 2, 3, 3, 7, 8]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[1][2] == got[2][2] == 1
    file = next((tmp_path / "store").glob("part-*.parquet"))
    columns = {pq.ParquetFile(file).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    one = token_store.read_store(spark, path).where("doc_id = 8").select("tokens").first()["tokens"]
    assert one[-1] == 0 and one[0] == 50256
    token_store.write_store(odd_documents(spark).limit(0), str(tmp_path / "none"), P.path("byte_bpe_50k.json"))
    assert token_store.read_store(spark, str(tmp_path / "none")).count() == 0


ARTICLE = """<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><header>Site</header><div id="cookie-notice">We use cookies.</div>
<div class="content"><h2>Title</h2><p>First para, long enough to be prose. It goes&nbsp;on.<p>Second &amp; <b>bold</b> <a href="x">link</a>, and more text.</div>
<div class="sidebar"><p>Buy, now. Buy, now. It is a long text, too.</p></div><form><p>Search</p></form><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><section class="comments"><p>Great post, thanks!</p></section></body></html>"""


def test_html():
    assert html_extract.main_text(ARTICLE) == "Title\nFirst para, long enough to be prose. It goes on.\nSecond & bold link, and more text."
    assert html_extract.main_text("<article><h1>A</h1><p><b>x<br><p>y  z</p><aside>no</aside></article><p>later, on. And more, of it.</p>") == "A\nx\ny z"
    assert [html_extract.main_text(x) for x in (None, "", "<", "a < b", "<p", "<!-- x", "<script>x", "<p>&lt;p&gt;</p>")] == ["", "", "<", "a < b", "", "", "", "<p>"]
    long = "<p>" + "many words, in a line. " * 20000 + "</p>"
    assert len(html_extract.main_text(long)) == 23 * 20000 - 1


@pytest.mark.parametrize("size", [300, 800, 1500])
@pytest.mark.parametrize("inside", [True, False])
def test_html_keeps_the_pieces_of_an_article(size, inside):
    prose = ("Some words of prose, in a line. " * 60)[:size].strip()
    items = [f"item no {i}" for i in range(12)]
    bits = [f"<p>{prose}</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", f"<p>{prose}</p>", "<table><tr><td>a</td><td>12</td></tr></table>", "<pre>x = 1</pre>"]
    bits += [f"<p>{prose}</p><blockquote>So be it</blockquote>", "<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>"]
    rest = [prose, *items, prose, "a", "12", "x = 1", prose, "So be it", *items]
    menu = "<ul>" + "".join(f"<li class=m><a href=x>Link {i}</a>" for i in range(9)) + "</ul>"
    name = "article" if inside else "div class=text"
    page = f"<html><body><nav><a href=x>Home</a></nav><div class=menubox>{menu}</div><{name}><h1>Title</h1>{''.join(bits)}</{name.split()[0]}><div class=end>All rights</div>{menu}</body></html>"
    assert html_extract.main_text(page).split("\n") == ["Title", *rest]
    if not inside:
        page = f"<html><body><h1>Title</h1>{''.join(bits)}<div class=end>All rights</div>{menu}</body></html>"
        assert html_extract.main_text(page).split("\n") == ["Title", *rest]


WRAPS = ["<div class='layout has-sidebar'>", "<div class='post no-comments'>", "<div id='page' class='with-header'>", "<form action='x'>", "<div class='layout-sidebar'>", "<div class='widget'>", "<div class=page><div class='header-wrap'>"]


@pytest.mark.parametrize("wrap", WRAPS)
def test_html_wrappers_named_aside_stay(wrap):
    body = "<h1>Title</h1><p>" + "Words of prose, in a line. " * 20 + "</p><p>More of it, in short.</p>"
    want = html_extract.main_text(f"<article>{body}</article>")
    aside = "<div class='sidebar'><p>Buy, now. Buy, now.</p></div><section class='comments'><p>Great post, thanks!</p></section><div class='ad-slot'>Ad</div><form><p>Search</p></form>"
    assert want.count("\n") == 2
    for inner in (f"<article>{body}{aside}</article>{aside}", f"{aside}<div class=text>{body}</div>{aside}"):
        assert html_extract.main_text(f"<html><body><nav>Menu</nav>{wrap}{inner}</body></html>") == want
    assert html_extract.main_text(f"<body><article>{body}</article><div class='sidebar'><article>Teaser, of another.</article></div></body>") == want


def test_html_of_all_pages(spark, sf):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<b>", "</b>", "text, and. ", "<div class='ad'>", "</div>", "<br>", "<!--", "-->", "<script>", "</script>", "&amp;", "<", ">", '"', "<a href='"]), max_size=15))
def test_html_of_any_markup(parts):
    assert isinstance(html_extract.main_text("".join(parts)), str)


def test_url_parts():
    cases = {"http://A.Net": ("a.net", ""), "x://h?q": ("h", ""), "x://h#f/": ("h", ""), "x://H/p/q?x#y": ("h", "/p/q"), "no": ("", ""), None: ("", ""), "a://b://c/": ("b:", "//c/"), "http://É.net/": ("É.net", "/")}
    assert {u: url_filter.parts(u) for u in cases} == cases


def brute(url, rules):
    host, path = url_filter.parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(fits)[3]) if fits else (None, "allow")


def test_urls_against_brute_force(spark, monkeypatch):
    rules = [*queries.URL_RULES, ("block", "a.b", ""), ("allow", "b", "/x"), ("block", "a.b", "/x/y")]
    random.seed(2)
    urls = ["".join(random.choices(["http://", "a.b", "b", ".", "net", "example.net", "example.com", "org", "/en/", "/de/", "/fr/", "/x", "/y", "?q", "#", "A"], k=random.randint(1, 7))) for _ in range(800)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, ""])], "page_id long, url string").selectExpr("*", "'x' AS rule", "'y' AS host")
    want = {i: brute(u, rules) for i, u in enumerate([*urls, None, ""])}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()} == want
    build = url_filter.build_index
    monkeypatch.setattr(url_filter, "build_index", lambda rules: build(rules, 90))  # parts of two or three rules
    assert len(url_filter.build_index(rules)) > 2
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df.union(df), rules).collect()} == want
    assert url_filter.judge_urls(df.union(df), rules).count() == 2 * len(want) and url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_url_index_tells_colliding_keys_apart(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 7)
    parts = url_filter.build_index([("block", "net", "/"), ("allow", "org", "/x"), ("block", "net", "/x")])
    assert url_filter.judge([url_filter.Index(p) for p in parts], [("a.net", "/xy"), ("org", "/x"), ("com", "/x")]) == [("net/x", "block"), ("org/x", "allow"), (None, None)]


def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    again = {i + k for i, x in enumerate(tri) if count[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", " ".join(w))), len(lines) - len(set(lines)), len(again)


def test_rules_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in queries.op6_quality_rules(spark, sf).collect():
        want = statistics(text[r["doc_id"]])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*want, failed)
        if failed:
            assert not r["kept"]
        elif labels.get(r["doc_id"]) == 1:
            assert r["kept"], r


def test_rules_edges(spark):
    prose = [(i, f"w{i} " + " ".join(f"{a}{b}{i}" for a in "abcdefgh" for b in "klmnopqr"), None if i % 2 else "en", "s") for i in range(120)]
    odd = [(900, None, "en", "s"), (901, "", None, None), (902, "a\u00e9 b a\u00e9 b a\u00e9 b\n\n x\n x\n", "en", "t"), (903, " ".join(f"q{i}%%%" for i in range(70)), "en", "s"), (None, prose[0][1], "en", "s"), (0, prose[0][1], "en", "s")]
    df = spark.createDataFrame(prose + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "5 AS kept", "'x' AS n_words", "1 AS length")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(prose) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert (by[902]["n_words"], by[902]["word_chars"], by[902]["n_dup_lines"], by[902]["n_repeat_words"]) == (8, 11, 1, 6)
    assert not by[903]["kept"] and not by[903]["base_failed"] and not by[900]["kept"] and by[5]["kept"] and by[None]["kept"]
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_rules_reject_rare_symbols_lines_and_words(spark):
    """In a source where all else is clean, each statistic alone rejects; a few symbols or a repetition don't."""
    rng = random.Random(5)

    def lines(n, k):
        return [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(k)) for _ in range(n)]

    clean = [(i, "\n".join(lines(10, 20))) for i in range(80)]
    symbols, few = "\n".join(f"{x} # # #" for x in lines(10, 7)), "\n".join([*lines(9, 20), "a # b"])
    short = lines(20, 1)
    again = "\n".join([*lines(10, 20), *short, *short])
    part = lines(1, 90)[0]
    alone = "\n".join(lines(5, 14) + [" ".join(w[:-1] + "#" for w in x.split()) for x in lines(5, 6)])
    odd = [(905, alone), (900, symbols), (901, few), (902, again), (903, "\n".join([*lines(4, 60), f"{part} {part}"])), (904, "\n".join([*lines(9, 20), "one two three four one two three"]))]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert (got[900]["n_symbols"], got[900]["n_words"], got[902]["n_dup_lines"]) == (30, 100, 20) and not any(r["base_failed"] for r in got.values())
    assert (got[905]["n_symbols"], got[905]["n_words"], got[905]["n_repeat_words"]) == (30, 100, 0)
    assert [got[i]["kept"] for i in (900, 901, 902, 903, 904, 905)] == [False, True, False, False, True, False]
    assert all(got[i]["kept"] for i, _ in clean)


def test_rules_reject_junk(spark):
    """Of the labelled documents that pass the base rules, all of label 0 and at most one in 500 of label 1 are rejected."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels.get(r["doc_id"]), r["kept"], r["distance"]) for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").collect()]
    assert sum(q == 0 for q, *_ in judged) > 10 and min(d for q, _, d in judged if q == 0) > 2 * quality_rules._quantile(quality_rules.PASS, 4)
    assert sum(q == 1 and not k for q, k, _ in judged) <= sum(q == 1 for q, *_ in judged) / 500


def test_mcd_is_numpy_s(spark):
    """On one group, the distances are those of C-steps done with numpy (quantiles differ by a sketch's error)."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [0.2, 0.3, 0.4, 0.5] + 1
    x[:60] += 4
    from rivulet.llm import shared

    rows = spark.createDataFrame([("=a", "=b", *map(float, r)) for r in x], "g_lang string, g_source string, length double, symbols double, lines double, repeats double")
    with shared.Scratch(spark) as scratch:
        found = quality_rules.outliers(rows, scratch).collect()
    center = np.array(found[0]["center"])
    assert len(found) == 1 and np.abs(center - x[60:].mean(axis=0)).max() < 0.05
    inverse = np.array(found[0]["inverse"]).reshape(4, 4)
    d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
    assert (d[:60] > quality_rules._quantile(quality_rules.PASS, 4)).all() and (d[60:] < quality_rules._quantile(quality_rules.PASS, 4)).mean() > 0.97
    assert abs(quality_rules._chi2(9.488, 4) - 0.95) < 1e-4


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    held = [i for i in labels if found[i]["held_out"]]
    good, bad = [found[i]["score"] for i in held if labels[i] == 1], [found[i]["score"] for i in held if labels[i] == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_classifier_edges(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (8, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    weights = quality_classifier.train(docs, labels)
    got = quality_classifier.classify(docs, weights, ["doc_id"]).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    none = quality_classifier.train(docs, labels.limit(0))
    assert not none.any()
    assert quality_classifier.score([None, "", "x"], none) == [0.5, 0.5, 0.5]


def test_ftrl_step_is_the_formula():
    model = quality_classifier.Ftrl()
    at, value = np.array([5, quality_classifier.BUCKETS]), np.array([1.0, 1.0], np.float32)
    model.step(at, value, 1.0)
    assert model.z[5] == pytest.approx(-0.5) and model.n[5] == pytest.approx(0.25)
    w = (0.5 - quality_classifier.L1) / ((quality_classifier.BETA + 0.5) / quality_classifier.ALPHA + quality_classifier.L2)
    assert model.final()[5] == pytest.approx(w, rel=1e-5)


def test_ftrl_against_brute_force():
    """Weights of a few texts by the published per-coordinate updates, number by number."""
    import math

    q = quality_classifier
    texts = [(1.0, "a good text of words"), (0.0, "bad bad bad % % words"), (1.0, "words of a text, again a text"), (0.0, ""), (0.0, "% % %")]
    z, n = Counter(), Counter()

    def weight(i):
        if i != q.BUCKETS and abs(z[i]) <= q.L1:
            return 0.0
        shrunk = z[i] if i == q.BUCKETS else z[i] - math.copysign(q.L1, z[i])
        return -shrunk / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + (0 if i == q.BUCKETS else q.L2))

    for _ in range(q.EPOCHS):
        for label, text in texts:
            at = Counter(q.features(text).tolist())
            x = {i: c / math.sqrt(max(1, sum(at.values()))) for i, c in at.items()} | {q.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    want = np.zeros(q.BUCKETS + 1)
    for i in z:
        want[i] = weight(i)
    got = q.fit([(label, *q.counted(text)) for label, text in texts])
    assert np.abs(got - want).max() < 1e-4 and np.count_nonzero(got) > 5


def test_classifier_learns_from_bounded_rows(spark):
    """Repeated rows of an id are one example, and examples end where their entries would exceed the bound."""
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in [f"w{i} a b c", "x " * 5000, f"w{i} a b c"] * 3], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = docs.groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text")
    whole = quality_classifier.train(docs, labels)
    assert whole.any() and (whole == quality_classifier.train(once, labels)).all()
    few = quality_classifier.train(docs, labels, entries=30)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(whole)


def test_vocabularies_are_bounded(tmp_path, spark, monkeypatch):
    from rivulet.llm import vocabulary

    monkeypatch.setattr(vocabulary, "VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_text(json.dumps({}) * 5)
    with pytest.raises(ValueError):
        vocabulary.load(spark, str(tmp_path / "v"))


def brute_ratios(found):
    """Tag-path ratios as html_extract.path_ratios documents them, block by block."""
    out = {}
    own = {}
    for p in {b.path for b in found}:
        mine = [b for b in found if b.path == p]
        own[p] = (sum(len(b.text) - b.linked for b in mine) / len(mine), sum(len(re.findall("[.,;:!?]", b.text)) for b in mine) / len(mine))
    weights = {-2: 0.06, -1: 0.24, 0: 0.4, 1: 0.24, 2: 0.06}
    for p in own:
        values = []
        for i, b in enumerate(found):
            if b.path == p:
                near = [(w, own[found[i + k].path]) for k, w in weights.items() if 0 <= i + k < len(found)]
                smooth = [sum(w * v[j] for w, v in near) / sum(w for w, _ in near) for j in (0, 1)]
                values.append(((own[p][0] + smooth[0]) / 2 * (1 + (own[p][1] + smooth[1]) / 2)) ** 0.5)
        out[p] = sum(values) / len(values)
    return out


def unnamed(page, names="article|main"):
    """The page with elements of these names as div, and without classes."""
    return re.sub(' class="[^"]*"', "", re.sub(rf"<(/?)({names})>", r"<\1div>", page))


def test_html_ratios_against_brute_force_and_without_names(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = bare = 0
    for page in pages:
        found = html_extract.blocks(page)
        ratio, _, _ = html_extract.path_ratios(found)
        want = brute_ratios(found)
        assert ratio.keys() == want.keys() and all(abs(ratio[p] - want[p]) < 1e-9 for p in want)
        right += html_extract.main_text(unnamed(page)) == html_extract.main_text(page)
        bare += html_extract.main_text(unnamed(page, "article|main|nav|footer")) == html_extract.main_text(page)
    # The ratios alone, with and without the names of menus and footers.
    assert right >= 0.93 * len(pages) and bare >= 0.85 * len(pages)


@pytest.mark.parametrize("wrap", ["<div class='layout has-sidebar'>", "<div id='content' class='no-sidebar'>", "<div class='post-with-comments'>", "<div class='main-content ad-free'>", "<section class='related-work'>"])
def test_html_wrappers_and_headers_of_an_article(wrap):
    body = "<p>" + "Words of prose, in a line. " * 8 + "</p><p>More of it, in short.</p>"
    for header in ("<div class='entry-header'><h1>Title</h1></div>", "<header><h1>Title</h1></header>"):
        for name in ("article", "div"):
            page = f"<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>{wrap}<{name}>{header}{body}</{name}></body>"
            got = html_extract.main_text(page).split("\n")
            assert got[-2:] == ["Words of prose, in a line. " * 7 + "Words of prose, in a line.", "More of it, in short."] and "Site" not in got
            assert name == "div" or got[0] == "Title"


def test_html_time_is_linear():
    import time

    hard = ["<b>{0}</i>{0}x", "<div>{0}</p>{0}x", "<a>{0}<div>{0}</a>{0}x", "<table><tr><td><table><div>{0}<td></td>{0}y"]
    for form in hard:
        parts = form.split("{0}")
        page = lambda n: "".join(p[: p.rfind("<")] + p[p.rfind("<") :] * n for p in parts[:-1]) + parts[-1]
        began = time.process_time()
        html_extract.main_text(page(20_000))
        assert time.process_time() - began < 6


def test_html_edges_of_tables(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word, " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "'y' AS __text")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_extract.extract(df).collect()), key=repr)
    n = len(html_extract.main_text(ARTICLE))
    assert got == sorted([(1, "u", n), (1, "u", n), (None, None, 0), (2, "v", 0), (3, "w", 599_999)], key=repr)
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_kept(docs):
    """quality_rules.judge in numpy: docs are (id, text, lang, source); quantiles are exact, as Spark's are on few rows."""
    q = quality_rules
    found, rows = {}, {}
    for i, t, lang, source in docs:
        n, chars, symbols, dup, again = statistics(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        if n < 50 or 100 * again > 50 * n:
            found[i] = False
            continue
        mean = chars / n
        x = [np.log(mean + 1), (symbols / n) ** 0.5, (dup / lines) ** 0.5, (again / n) ** 0.5]
        rows[i] = (x, [mean / (n * (mean + 1) ** 2), 1 / (4 * n), 1 / (4 * lines), q.REPEAT / (4 * n)], (lang, source))
    sizes = Counter(g for *_, g in rows.values())
    pooled = Counter()
    for (lang, _), n in sizes.items():
        pooled[lang] += n * (n < q.LEAST_GROUP)
    place = lambda g: g if sizes[g] >= q.LEAST_GROUP else (g[0], "*") if pooled[g[0]] >= q.LEAST_GROUP else ("*", "*")
    groups = {}
    for i, (x, v, g) in rows.items():
        groups.setdefault(place(g), []).append((i, x, v))
    low = lambda values, p: np.sort(values)[int(np.ceil(p * len(values))) - 1]

    def estimate(x, share):
        center = x.mean(axis=0)
        cov = ((x.T @ x) / len(x) - np.outer(center, center)) * q._consistency(share) + np.eye(4) * q.TINY
        return center, cov

    def distance(g, center, cov):
        off = data[g][0] - center
        return np.array([o @ np.linalg.solve(cov + np.diag(v), o) for o, v in zip(off, data[g][1])])

    data = {g: (np.array([x for _, x, _ in r]), np.array([v for *_, v in r])) for g, r in groups.items()}
    d = {}
    for g, (x, v) in data.items():
        center = np.array([low(c, 0.5) for c in x.T])
        spread = np.array([1.4826 * low(abs(c - m), 0.5) for c, m in zip(x.T, center)])
        d[g] = ((x - center) ** 2 / (spread**2 + v + q.TINY)).sum(axis=1)
    before = None
    for _ in range(q.STEPS):
        params = {g: estimate(data[g][0][d[g] <= low(d[g], q.SUPPORT)], q.SUPPORT) for g in data}
        d = {g: distance(g, *params[g]) for g in data}
        now = {g: np.linalg.slogdet(params[g][1])[1] for g in data}
        if before is not None and all(before[g] - now[g] <= 0.001 for g in data):
            break
        before = now
    for g, r in groups.items():
        final = distance(g, *estimate(data[g][0][d[g] <= q._quantile(0.975, 4)], 0.975))
        found |= {i: bool(z <= q._quantile(q.PASS, 4)) for (i, *_), z in zip(r, final)}
    return found


def test_kept_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert got.keys() == want.keys() and sum(got[i] != want[i] for i in got) <= 1
    assert 0 < sum(want.values()) < len(want)


def test_batches_for_python_are_bounded(spark):
    """A batch holds a bounded number of bytes, or one longer row; a bound that the session has stays."""
    long = spark.range(30).selectExpr("repeat('x', 1000000) AS t").coalesce(1)
    sizes = T.StructType([T.StructField("n", T.LongType())])
    run = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    before = spark.conf.get(shared.BATCH_BYTES, None)
    try:
        spark.conf.unset(shared.BATCH_BYTES)
        got = [r["n"] for r in shared.map_arrow(long, run, sizes).collect()]
        assert sum(got) == 30 and max(got) <= shared.BULK_BYTES // 1_000_000 + 1
        spark.conf.set(shared.BATCH_BYTES, "1000")
        assert [r["n"] for r in shared.map_arrow(long, run, sizes).collect()] == [1] * 30
    finally:
        spark.conf.set(shared.BATCH_BYTES, before) if before else spark.conf.unset(shared.BATCH_BYTES)


def test_a_worker_keeps_what_its_last_task_asked_for(spark):
    data = vocabulary.load(spark, P.path("byte_bpe_50k.json"))
    first = vocabulary.once("x", data, len)
    vocabulary.settle()
    assert vocabulary.once("x", data, lambda raw: None) == first
    vocabulary.settle()
    vocabulary.settle()
    assert vocabulary.once("x", data, lambda raw: None) is None
    vocabulary._BUILT.clear()
