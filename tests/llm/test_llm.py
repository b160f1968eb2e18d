"""Each operator against a plain computation, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.llm import bpe, components, decontaminate, fingerprint, html_extract, langid, line_dedup, near_dedup, pii, queries, substring_dedup, token_rollup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(200)]


def docs(spark, texts, ids=None, extra=""):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def table_dir(tmp_path, spark, texts, **tables):
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """Unlike texts, copies, near copies, a passage that many share, and odd ones."""
    r = random.Random(seed)
    passage = sentence(r, 60)
    out = [sentence(r, r.randrange(5, 200)) for _ in range(n)]
    out += [out[3]] * 7 + [out[4], None, "", "  \n\t ", "one", "two words", "A b C", "a B c"]
    for i in range(10):
        w = out[5].split() if len(out[5].split()) > 60 else sentence(r, 120).split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(sentence(r, 20) + "\n" + passage + " " + sentence(r, r.randrange(30)))
    out.append(" ".join(["again"] * 100))
    return out + [sentence(r, 30_000)]


# ---- 1 -------------------------------------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(texts, items):
    out = []
    for t in texts:
        w, hit, found = item_words(t), set(), set()
        for item, text in items:
            x = item_words(text)
            m = min(13, len(x))
            for p in {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else ():
                for i in range(len(w) - m + 1):
                    if tuple(w[i : i + m]) == p:
                        hit |= set(range(i, i + m))
                        found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), 20 * len(hit) >= len(w) and len(hit) > 0))
    return out


def test_decontaminate(spark, tmp_path):
    r = random.Random(5)
    texts = corpus(2, 20)
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[3:30]).upper()), (3, "w1"), (4, "w2, w3"), (5, None), (6, "..."), (None, texts[2]), (10, sentence(r, 40)), (2, "w7 W8"), (11, "W9-w9!w9 é"), (12, " ".join(["again"] * 14))]
    texts += [texts[2] + " w9 w9.W9 É é w9 w9 w9 é", "x" * 1000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = table_dir(tmp_path, spark, texts, benchmark=bench)
    got = {x.doc_id: tuple(x)[1:] for x in queries.op1_decontaminate(spark, d).collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)
    one = decontaminate.flagged(decontaminate.contamination(docs(spark, texts), bench)).drop("row")
    many = decontaminate.flagged(decontaminate.contamination(docs(spark, texts), bench, block_bytes=200)).drop("row")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    named = docs(spark, texts).withColumns({c: F.lit(c) for c in ("row", "id", "_row", "n_words", "items")})
    for size in (1 << 20, 200):
        clean = decontaminate.clean(named, bench, block_bytes=size)
        assert {x.doc_id for x in clean.collect()} == {i for i in got if not got[i][4]} and clean.columns == named.columns
        assert {(x.row, x.id, x.items) for x in clean.collect()} == {("row", "id", "items")}
        odd = docs(spark, [texts[0], texts[0], "fine", "fine", None], [1, 1, None, None, None])
        assert sorted(map(str, (tuple(x)[:2] for x in decontaminate.clean(odd, bench, block_bytes=size).collect()))) == ["(None, 'fine')", "(None, 'fine')", "(None, None)"]
        assert decontaminate.contamination(odd, bench, block_bytes=size).count() == 5
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    none = decontaminate.contamination(docs(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and all(x.n_hit == 0 for x in none)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join), max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=9).map("-".join), max_size=3), st.integers(1, 6))
def test_search_of_words(texts, items, window):
    matcher = decontaminate.Matcher([(str(i), t.encode()) for i, t in enumerate(items)], window)
    for text, (n, spans, found) in zip(texts, matcher.find([t.encode() for t in texts]), strict=True):
        w, hit, want = item_words(text), set(), set()
        for i, t in enumerate(items):
            x = item_words(t)
            m = min(window, len(x))
            places = [k for k in range(len(w) - m + 1) if m and any(w[k : k + m] == x[j : j + m] for j in range(len(x) - m + 1))]
            want |= {str(i)} if places else set()
            hit |= {k + d for k in places for d in range(m)}
        assert (n, found) == (len(w), want) and {k for a, b in spans for k in range(a, b)} == hit and all(a < b for a, b in spans)


# ---- 2 -------------------------------------------------------------------------------------------

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(texts, window=35):
    words = [SPACES.findall(t or "") for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i] |= set(range(k, k + window))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("counters", [8, 4000])
def test_substrings(spark, counters, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(substring_dedup, "COUNTERS", counters)  # a sketch of one block, and of several
    named = docs(spark, texts).withColumns({c: F.lit(c) for c in ("row", "part", "begins", "places", "n_words")})
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_substrings(named, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts)
    if counters > 8:
        return
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0
    same = docs(spark, [texts[0] * 9, texts[0] * 9, "z", None, None], [7, 7, None, None, None])
    want = sorted((i, *x) for i, x in zip((7, 7, 0, 0, 0), brute_substrings([texts[0] * 9, texts[0] * 9, "z", None, None]), strict=True))
    assert sorted((x.doc_id or 0, *tuple(x)[1:]) for x in substring_dedup.dedup_substrings(same, digest=True).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90).map(" ".join), max_size=4))
def test_anchors_of_equal_windows(texts):
    w = substring_dedup.Words([t.encode() for t in texts])
    at, place, g = substring_dedup.anchors(w, 10, 3)
    plain = [t.split() for t in texts]
    assert len(at) == sum(max(0, len(p) - 9) for p in plain)
    flat, seen = [x for p in plain for x in p], {}
    for a, p in zip(at.tolist(), place.tolist(), strict=True):
        assert a <= p <= a + 7
        assert seen.setdefault(tuple(flat[a : a + 10]), (p - a, g[p])) == (p - a, g[p])


# ---- 3 -------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktokens():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe(spark, tmp_path, tiktokens):
    texts = [*corpus(3, 10), "It's  a   test\n\n of 日本語 🙂🙃 l'été \t x\x85y\xa0z <|endoftext|> 1234 ...", " lead", "trail ", "\n", "🙂" * 50, "á" * 20, "x" * 5000]
    got = {r.doc_id: r for r in queries.op3_bpe(spark, table_dir(tmp_path, spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tiktokens.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    d = bpe.encode(docs(spark, texts), with_offsets=True)
    for r in d.collect():
        t = texts[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert "".join(t[a:b] for a, b in sorted(set(zip(r.starts, r.ends, strict=True)))) == t or any(ord(c) > 0x2FF for c in t)
    back = {r.doc_id: r.text for r in bpe.decode(d).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    smile = c.encode("🙂").tolist()
    assert len(smile) > 1 and c.decode(smile[:1]) == "�" and c.decode(smile) == "🙂"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F) | st.sampled_from(" \n\t'’日本🙂"), max_size=60))
def test_bpe_equals_tiktoken(tiktokens, text):
    assert bpe.codec(PATH, public_tokenizers.PATTERN).encode(text).tolist() == tiktokens.encode_ordinary(text)


# ---- 4 -------------------------------------------------------------------------------------------

BODY = "<h1>A title</h1><p>First, a paragraph&nbsp;of text. It has &lt;two&gt; sentences.</p><p>Second <b>bold</b>\n one,<br>too, and long enough.<ul><li>item one, is good<li>item two</ul>"
WANT = "A title\n\nFirst, a paragraph of text. It has <two> sentences.\n\nSecond bold one, too, and long enough.\n\nitem one, is good\n\nitem two"


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post'>", "</div>")])
def test_html(spark, open_, close):
    page = (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><script>var a = '<p>no</p>';</script><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies, really. Yes.</div>"
        f"<div class=ad>Buy, now. Cheap, good.</div>{open_}{BODY}{close}<div id=sidebar><p>Side, text. And more, of it.</p></div><form>Name <input></form><section id=comments><p>I disagree, sir. Very much, so.</p></section><footer><p>&copy; us, 2020. All.</p></footer></body></html>")
    assert html_extract.main_text(page) == WANT
    rows = [(1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "plain < text", "t"), (1, "u", page[: page.index("</body>")], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extract(df).collect())
    assert got == [(0, ""), (1, WANT), (1, WANT), (2, ""), (3, "plain < text")]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_is_linear():
    for page in ("<a " * 50_000, "<p>" * 50_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "&amp;" * 50_000, "<script>" * 20_000):
        html_extract.main_text(page)
    long = "<article><p>" + html.escape("a & b, c. " * 50_000) + "</p></article>"
    assert html_extract.main_text(long) == ("a & b, c. " * 50_000).strip()


def test_html_keeps_paths_outside_articles():
    long = [f"Paragraph {i}, " + "of the main text. " * 7 + "and so on " * 26 for i in range(10)]
    teasers = "".join(f"<article class=teaser><p>{'Some teaser, ' + 'x' * 47}</p></article>" for _ in range(5))
    got = html_extract.main_text("<body><div class=post>" + "".join(f"<p>{t}</p>" for t in long) + f"</div>{teasers}</body>")
    assert [t for t in long if t.strip() not in got] == []
    text = "A sentence of the text, long enough to stay here, and then some. " * 4
    page = f"<body><article><p>{text}</p><p>{text}</p><span>x</span><div class=tags>a b</div></article></body>"
    assert "a b" not in html_extract.main_text(page).split("\n\n")


def test_html_deep():
    text = "A sentence of the text, long enough to stay here, and then some. " * 4
    deep = "<div>" * 450 + "<nav>Menu, of it. And more.</nav><p>" + text + "</p>" + "</div>" * 450
    page = f"<body><div><article><p>{text}</p>{deep}<p>{text}Last.</p></article></div></body>"
    assert html_extract.main_text(page) == "\n\n".join([text.strip()] * 2 + [text + "Last."])
    for odd in ("</b0>" * 50_000, "<dt>" * 50_000, "<li></i>" * 50_000, "<p>x" * 20_000):
        html_extract.main_text("<dl><dd><ul>" + "<div>" * 20_000 + odd)


def test_html_keeps_what_only_sounds_like_boilerplate():
    text = "A sentence of the text, long enough to stay here, and then some. " * 4
    page = (
        f"<body><article><div class='entry-header'><h1>The Real Title</h1></div><p>{text}</p><div class='share-of-market'><p>{text}One.</p></div><p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><path d='M0'/><text>drawn</text></svg>, {text}</p>"
        f"<p data-x='a hidden b'>{text}Seen.</p><p class=x hidden>{text}Unseen.</p><div class='share-buttons'>Tell, all. Your, friends.</div><div class=comment-list><p>{text}Said.</p></div></article></body>")
    got = html_extract.main_text(page).split("\n\n")
    assert got == ["The Real Title", text.strip(), text + "One.", f"With x = 2 and drawn, {text}".strip(), text + "Seen."]


def test_html_paths_are_found_without_articles(spark):
    for name in ("sf0.001", "sf0.01"):
        for page in spark.read.parquet(f"/root/testdata/{name}/pages.parquet").select("html").toLocalIterator():
            bare = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page.html or "")
            assert html_extract.main_text(bare) == html_extract.main_text(page.html or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.text(alphabet="ab ,.", min_size=1, max_size=40).filter(str.strip), st.booleans()), min_size=1, max_size=12))
def test_ratios_by_hand(rows):
    blocks = [html_extract.Block(p, 0, False, t, 0, inside) for p, t, inside in rows]
    paths = list(dict.fromkeys(p for p, _, _ in rows))
    mean = lambda f: [sum(f(t) for q, t, _ in rows if q == p) / sum(q == p for q, _, _ in rows) for p in paths]
    w = np.exp(-0.5)

    def smooth(x):
        return [sum(k * x[j] for k, j in near) / sum(k for k, _ in near) for i in range(len(x)) for near in [[(1 if j == i else w, j) for j in (i - 1, i, i + 1) if 0 <= j < len(x)]]]

    fused = [a * b * (4 if any(q == p and inside for q, _, inside in rows) else 1) for p, a, b in zip(paths, smooth(mean(len)), smooth(mean(lambda t: 1 + sum(c in ",." for c in t))), strict=True)]
    at = dict(zip(paths, fused, strict=True))
    least = min(0.35 * sum(at[p] for p, _, _ in rows) / len(rows), max(fused))
    clear = [b for b in blocks if abs(at[b.path] - least) > 1e-9 * least]
    got = html_extract.content(blocks)
    assert [b in got for b in clear] == [at[b.path] >= least for b in clear]


# ---- 5 -------------------------------------------------------------------------------------------

SYLLABLES = {"de": ["sch", "ung", "ein", "ver", "keit"], "fr": ["eau", "tion", "é", "oi", "ment"], "es": ["ción", "ado", "ez", "ll", "rr"]}


def test_language(spark, tmp_path):
    r = random.Random(9)
    say = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, 30), lang, "s", 0) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, None, "de", "s", 0), (901, "", "fr", "s", 0), (902, "123 !!", None, "s", 0), (None, say("es", 30), None, "s", 0), (903, say("de", 20_000), "de", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_langid(spark, str(tmp_path)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got) and len(held) > 15
    truth = {i: lang for i, _, lang, *_ in rows}
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held if x.doc_id < 900]) > 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[None].lang_pred == "es" and by[903].lang_pred == "de"
    assert all(0 <= x.score <= 1 for x in got)
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df)
    again = langid.train(df.repartition(7))
    assert all((model[k] == again[k]).all() for k in model) and sorted(model) == ["de", "es", "fr"]
    named = df.withColumn("score", F.lit("mine"))
    kept = langid.of_known_language(named, model)
    assert kept.columns == named.columns and {x.doc_id for x in kept.collect()} == {i for i, *_ in rows} - {900, 901, 902}
    assert {x.lang_pred for x in langid.identify(df, {}).collect()} == {"und"}
    r2 = random.Random(2)
    strange = docs(spark, ["".join(r2.choice("bdfghjkmpqwxyz ") for _ in range(3000)), "Avec.", "A.", say("fr", 3)])
    assert sorted(x.doc_id for x in langid.of_known_language(strange, model).collect()) == [1, 2, 3]
    assert langid.train(df.limit(0)) == {}
    with pytest.raises(ValueError):
        langid.train(df, max_languages=2)


# ---- 6 -------------------------------------------------------------------------------------------

def test_rollup(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b  c", "en", "x", 0), (2, "d, e", None, "x", 0), (3, None, "en", None, 0), (4, "a b  c", "en", "x", 0), (4, "a b  c", "en", "x", 0), (None, "a b  c", "en", "x", 0)], DOCS)
    df = df.withColumns({c: F.lit(c) for c in ("id", "digest", "n", "first", "n_tokens")})
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    ids = lambda: sorted(r.batch for r in rollup.batches().collect())
    assert rollup.totals().count() == 0 and ids() == []
    totals = lambda: {tuple(x)[:3]: tuple(x)[3:] for x in rollup.totals().collect()}
    insert = token_rollup.deltas(df, "words-1", 1)
    assert rollup.commit("b1", insert) and not rollup.commit("b1", insert)
    want = {("x", "en", "words-1"): (4, 12), ("x", None, "words-1"): (1, 2), (None, "en", "words-1"): (1, 0)}
    assert totals() == want
    rollup.commit("b2", token_rollup.revisions(df.where("doc_id = 2"), df.where("doc_id = 2"), "words-1", "words-2"))
    rollup.commit("b3 / with any name", token_rollup.copy_deltas(df, "words-1"))
    want = {("x", "en", "words-1"): (2, 6), ("x", None, "words-2"): (1, 3), (None, "en", "words-1"): (1, 0)}
    assert totals() == want
    (tmp_path / "r/staging/half").mkdir(parents=True)
    rollup.compact()
    assert totals() == want and ids() == ["b1", "b2", "b3 / with any name"] and not rollup.commit("b2", insert)
    rollup.compact()
    assert rollup.commit("empty", insert.limit(0)) and totals() == want
    assert rollup.commit("long", token_rollup.deltas(docs(spark, ["w " * 1_000_000]), "words-1", 1)) and totals()["s", "en", "words-1"] == (1, 1_000_000)


def test_copies_are_deleted_as_counted_by_hand(spark):
    r = random.Random(5)
    rows = [(r.choice((None, *range(12))), r.choice(("p", "q q", "", None)), r.choice(("en", None)), r.choice("st"), 0) for _ in range(200)]
    got = {tuple(x)[:2]: tuple(x)[2:] for x in token_rollup.copy_deltas(spark.createDataFrame(rows, DOCS).repartition(5), "words-1").groupBy("source", "lang").agg(F.sum("n_docs"), F.sum("n_tokens")).collect()}
    want = Counter()
    for i, t, lang, source, _ in rows:
        if t is not None and i is not None and any(j is not None and j < i for j, x, *_ in rows if x == t):
            want[source, lang, "n"] -= 1
            want[source, lang, "t"] -= len(t.split())
    assert got == {k: (want[*k, "n"], want[*k, "t"]) for k in {(a, b) for a, b, _ in want}}


def test_rollup_survives_crashes_and_many_batches(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "v", 1, 10)], token_rollup.SCHEMA).coalesce(1)
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    name = lambda k: f"batch-2026-11-26-{k:03d}-" + "x" * 40
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for k in range(200):
            assert rollup.commit(name(k), rows)
            if k in (3, 100):
                rollup.compact()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = lambda: [tuple(x)[3:] for x in rollup.totals().collect()]

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    def crashing(when: str, work) -> None:
        with monkeypatch.context() as m, pytest.raises(Crash):
            publish = token_rollup.Rollup._publish
            m.setattr(token_rollup.Rollup, "_publish", crash if when == "before" else lambda *a: publish(*a) and crash())
            work()

    assert total() == [(200, 2000)]
    crashing("before", lambda: rollup.commit("late", rows))
    assert total() == [(200, 2000)] and rollup.commit("late", rows)
    crashing("after", lambda: rollup.commit("later", rows))
    assert total() == [(202, 2020)] and not rollup.commit("later", rows)
    for when in ("before", "after"):
        crashing(when, rollup.compact)
        assert total() == [(202, 2020)] and not rollup.commit("late", rows) and not rollup.commit(name(0), rows)
    rollup.commit("more", rows)
    rollup.compact()
    assert total() == [(203, 2030)] and rollup.batches().count() == 203 and not rollup.commit(name(150), rows)
    number, manifest = rollup._newest()
    assert not rollup._publish(number, {}) and rollup._newest() == (number, manifest)  # a second writer of the number
    other = token_rollup.Rollup(spark, str(tmp_path / "r"))
    newest = rollup._newest
    stale = iter([newest()])
    other.commit("theirs", rows)
    monkeypatch.setattr(rollup, "_newest", lambda: next(stale, None) or newest())
    assert rollup.commit("ours", rows) and total() == [(205, 2050)]


# ---- 7 -------------------------------------------------------------------------------------------

def brute_near(texts, n=3, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            comp[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    texts = corpus(7)
    r = random.Random(11)
    base = sentence(r, 150).split()  # a star: copies link with the base, hardly with each other
    for i in range(40):
        w = list(base)
        for k in r.sample(range(150), 3):
            w[k] = f"x{i}{k}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    for i in range(30):  # a loose group: neighbours link, most others only share keys
        w = list(base)
        for k in range(i, i + 12):
            w[(5 * k) % 150] = f"y{i}{k}" if k % 3 else f"y{k}"
        texts.append(" ".join(w))
    want = brute_near(texts, n, percent)
    for block in (128, 3):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs(spark, texts), n=n, percent=percent, small_bytes=0, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_links_between_sides_join_what_brute_force_joins():
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(60), r.randrange(0, 9)):
            w[k] = f"z{r.randrange(9)}"
        texts.append(" ".join(w))
    want = [c for _, c in brute_near(texts)]
    sets = near_dedup.shingle_sets([t.encode() for t in texts], 3)
    sigs = near_dedup.signatures(sets)
    side = [(i, i, sigs[i].tobytes(), sets[i].tobytes()) for i in range(60)]
    for cut in (1, 60):
        for a, b in ((side[:cut], side), (side, side)):
            got = near_dedup.links_between(a, b, 31, 85)
            assert len({frozenset(x) for x in got}) == len(got) < 60 and all(want[x] == want[y] for x, y in got)
    nodes, least = components.least_reached(*np.array(got).T)
    assert {n: x for n, x in zip(nodes.tolist(), least.tolist())} == {i: c for i, c in enumerate(want) if want.count(c) > 1}


def test_near_duplicates_odd_rows(spark):
    text = sentence(random.Random(1), 50)
    rows = docs(spark, [text, text, text, None, "", text + " more", None], [5, 5, 3, 7, 8, None, None])
    found = near_dedup.near_duplicates(rows)
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in found.collect()) == [(0, 0), (0, 0), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]
    assert sorted(x.doc_id or 0 for x in near_dedup.kept_rows(rows, found).collect()) == [0, 0, 3, 7, 8]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0
    odd = docs(spark, [text, text + " x", "other words", "more other words", text, text], [4, 4, 4, 4, 9, 4]).withColumns({c: F.lit(c) for c in ("row", "id", "comp", "_row")})
    kept = near_dedup.kept_rows(odd, near_dedup.near_duplicates(odd))
    assert kept.columns == odd.columns and all((x.row, x.id, x.comp, x._row) == ("row", "id", "comp", "_row") for x in kept.collect())
    assert len({x.text for x in kept.collect()}) == kept.count() == 3  # of the linked ones one, of unlinked ones with that id all
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(rows, percent=70)


def test_index_finds_all_pairs_within_the_limit():
    r = np.random.default_rng(1)
    for chunks in (16, 20):
        for _ in range(300):
            a = r.integers(0, 1 << 14, (1, 80)).astype(np.uint16)
            b = a.copy()
            b[0, r.choice(80, 2 * chunks - 1, replace=False)] ^= 1
            assert np.isin(near_dedup.keys_of(a, chunks), near_dedup.keys_of(b, chunks)).any()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    comp = {}
    for a, b in edges:
        x, y = comp.setdefault(a, {a}), comp.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                comp[k] = x
    for chunk in (1 << 20, 25):
        got = {x.node: x.comp for x in components.components(spark.createDataFrame(edges, "u long, v long"), chunk=chunk).collect()}
        assert got == {k: min(v) for k, v in comp.items() if len(v) > 1}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------

def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(texts, least=20, words=12):
    seen, out = [], []

    def near(a, b):
        v, w = a.encode().split(), b.encode().split()
        return a == b or min(len(a), len(b)) >= least and within_one(a, b) or min(len(v), len(w)) >= words and within_one(v, w)

    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            s = line.strip(" \t\r\n\x0b\x0c")
            if not s or not any(near(s, x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out.append("\n".join(kept) if t is not None else None)
    return out


def test_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdé 🙂") for _ in range(r.randrange(19, 60))).strip() + "xyz" for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(r.randrange(6)):
            x = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], ["q"], [x[k], "q"]))
            lines.append(r.choice(("", "  ", "\t")) + "".join(x) + r.choice(("", " ", "\r")))
        for _ in range(r.randrange(3)):
            x = [f"w{k * 7}" for k in range(r.choice((11, 12, 13, 40)))]
            for _ in range(r.choice((0, 1, 1, 2))):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], [r.choice(WORDS)], [x[k], r.choice(WORDS)]))
            lines.append(r.choice((" ", "  ", "\t")).join(x))
        texts.append("\n".join(lines))
    texts += [None, "", "short", "short\nshort", "é" * 30 + "\n" + "é" * 31 + "\n" + "é" * 33, "z" * 100_000, "z" * 100_001]
    rows = docs(spark, texts).withColumn("text2", F.lit(1)).withColumn("line", F.lit("x")).withColumn("row", F.lit(2))
    for small in (32 << 20, 0):
        kept = line_dedup.dedup_lines(rows, small_bytes=small)
        assert kept.columns == rows.columns
        got = {x.doc_id: x for x in kept.collect()}
        assert [got[i].text for i in range(len(texts))] == brute_lines(texts)
        assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got.values())
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0
    twice = docs(spark, [base[0] + "\nshort"] * 2, [None, None])
    assert sorted(x.text for x in line_dedup.dedup_lines(twice).collect()) == sorted([base[0] + "\nshort", ""])


def test_odd_lines(spark):
    line = " ".join(WORDS[:20])
    rows = docs(spark, [line] * 4 + [line + " more", line.replace("w3 ", "other "), line.replace("w3 w4", "w3w4"), line.replace("w3 w4", "w4 w3 x"), " ".join(WORDS[:11]), " ".join(WORDS[:10]), "ok", "ok", "no"], [3, 3, 3, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18])
    rows = rows.withColumns({c: F.lit(c) for c in ("row", "id", "later", "removed", "nth", "salt", "c0", "line")})
    kept = line_dedup.dedup_lines(rows)
    assert kept.columns == rows.columns and all((x.row, x.removed, x.c0) == ("row", "removed", "c0") for x in kept.collect())
    got = sorted((x.doc_id, bool(x.text)) for x in kept.collect())
    assert got == [(3, False), (3, False), (3, True), (9, False), (10, False), (11, False), (12, False), (13, True), (14, True), (15, True), (16, True), (17, False), (18, True)]
    assert "n_chars" not in line_dedup.dedup_lines(rows.drop("n_chars")).columns
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(rows, min_chars=1)


# ---- 9 -------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é%25", max_size=70) | st.text(alphabet="4.1 -+", max_size=40))
def test_pii_base(text):
    assert [(e["kind"], e["start"], e["end"]) for e in pii.find(text) if e["base"]] == plain_pii(text)


def test_pii(spark, tmp_path):
    texts = ["Mail é a.b@c.example.org or x@y, server ip 10.0.0.255 and 10.0.0.256", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "+1 (743) 555-3824 or tel (743) 555-3824", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "ssn 123-45-6789" + " " * 60 + "order 123-45-6781, 666-45-6789", None, "", "1" * 200_000 + "@", ".".join("1" * 9 for _ in range(20_000)), "a@" * 50_000]
    rows = {x.doc_id: x for x in queries.op9_pii(spark, table_dir(tmp_path, spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_pii(t or "") if len(t or "") < 1000 else []
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert rows[1].spans == "card:5:24" and rows[2].spans == "phone:0:17,local_phone:25:39" and rows[3].spans == "iban:5:32" and rows[4].spans == "ssn:4:15"
    found = {e.kind: e.score for e in pii.find_pii(docs(spark, texts[:2])).where("doc_id = 0").first().entities}
    assert found["ip"] > pii.PRIOR["ip"]
    assert not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


# ---- 10 ------------------------------------------------------------------------------------------

M64 = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M64
    return x ^ x >> 31


def plain_fingerprint(text):
    """The definition, one name after another."""
    if not text:
        return []
    names, bag = [ord(c) for c in text], []
    for level in range(1, 7):
        runs = [(n, len(list(g))) for n, g in itertools.groupby(names)]
        names = [plain_mix(n + k * 0xD1342543DE82EF95 & M64) if k > 1 else n for n, k in runs]
        labels = list(names)
        for _ in range(4):
            bits = [0] + [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in itertools.pairwise(labels)]
            labels = [2 * k + (x >> k & 1) for k, x in zip(bits, labels, strict=True)]
        cuts = [i for i in range(len(names)) if i == 0 or 1 < i < len(names) - 1 and labels[i - 1] < labels[i] >= labels[i + 1]]
        names = []
        for a, b in itertools.pairwise([*cuts, len(labels)]):
            own = [n if k == 1 else plain_mix(n + k * 0xD1342543DE82EF95 & M64) for n, k in runs[a:b]]
            names.append(plain_mix(sum(plain_mix(n) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, n in enumerate(own)) & M64))
        if level >= 2:
            bag += names
    seen, out = Counter(), []
    for n in bag:
        out.append(plain_mix(n + seen[n] * 0xC2B2AE3D27D4EB4F & M64) if seen[n] else n)
        seen[n] += 1
    return sorted({n >> 32 for n in sorted(out)[:64]})


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted({*a, *b})
    return len({*both[:64]} & {*a} & {*b}) / min(64, len(both))


def test_fingerprints_equal_plain_parsing(spark, tmp_path):
    texts = [*corpus(5, 12)[:40], "a" * 500, "ab" * 300, "x", "xy", "🙂 é" * 40]
    texts = [t if t is None or len(t) < 3000 else t[:3000] for t in texts]
    rows = {x.doc_id: x for x in queries.op10_fingerprint(spark, table_dir(tmp_path, spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        one, two, three = map(plain_fingerprint, (t, e, after))
        shown = lambda f: "".join(f"{n:08x}" for n in f)
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (shown(one), shown(two))
        assert (rows[i].near_edited, rows[i].near_next) == (plain_likeness(one, two), plain_likeness(one, three))


def test_documents_that_share_an_id_are_in_order_of_their_hash(spark):
    r = random.Random(12)
    rows = [(r.choice((None, None, 7, 7, 7, *range(40))), sentence(r, r.randrange(3, 9)) if r.random() < 0.9 else None) for _ in range(300)]
    order = sorted(set(rows), key=lambda x: (-(1 << 63) if x[0] is None else x[0], xxhash.xxh64_intdigest((x[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((x[1] or "").encode(), 42) >> 63) if x[1] is not None else 42))
    df = docs(spark, [t for _, t in order], [i for i, _ in order]).withColumns({c: F.lit(c) for c in ("k", "h", "range", "tail", "fingerprint")})
    got = Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in fingerprint.compare_with_next(df).collect())
    want = Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        want[i, len(t or ""), hashlib.sha256(fingerprint.edited(t or "", after or "").encode()).hexdigest()] += 1
    assert got == want
    ids, steps = fingerprint.range_cuts([1, 5, 5, 5, 9])
    assert ids.tolist() == [1, 5, 5, 5, 9] and fingerprint.range_of((ids, steps), np.array([0, 1, 2, 5, 5, 5, 6, 9, 10]), np.array([0, 9, 0, -(1 << 63), 0, (1 << 63) - 1, 0, 0, 0])).tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 5]


def test_fingerprints(spark, tmp_path):
    texts = corpus(5, 30)
    rows = {x.doc_id: x for x in queries.op10_fingerprint(spark, table_dir(tmp_path, spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        one, two, three = (fingerprint.sketches([x])[0] for x in (t, e, after))
        x = rows[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (fingerprint.shown(one), fingerprint.shown(two))
        assert (x.near_edited, x.near_next) == (fingerprint.likeness(one, two), fingerprint.likeness(one, three))
    long = [i for i, t in enumerate(texts) if len(t or "") > 300]
    assert np.mean([rows[i].near_edited for i in long]) > 0.5
    assert rows[3].fingerprint == rows[31].fingerprint
    assert np.array_equal(fingerprint.read(rows[3].fingerprint), fingerprint.sketches([texts[3]])[0])
    ties = fingerprint.compare_with_next(docs(spark, ["a b", "c d", None, "e"], [1, 1, None, None])).collect()
    assert len(ties) == 4 and fingerprint.compare_with_next(docs(spark, [])).count() == 0
    assert {x.doc_id: x.fingerprint for x in fingerprint.fingerprints(docs(spark, texts)).collect()} == {i: x.fingerprint for i, x in rows.items()}


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcd", min_size=60, max_size=400), st.text(alphabet="abcd", max_size=50))
def test_equal_substrings_share_their_inside(text, before):
    names = lambda t: set(fingerprint.parse_level(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0]))[0].tolist())
    inside = names(text)
    assert len(inside - names(before + text)) <= 20


def bundle(text):
    """A document's vector from letters' vectors, one n-gram at a time."""
    letters = langid.Profiles(langid.DIM, langid.SEED)
    marked = "_" + re.sub(r"[\W\d_]+", "_", (text or "").lower()) + "_"
    out = np.zeros(langid.DIM, np.int64)
    for g, n in Counter(marked[i : i + 3] for i in range(len(marked) - 2)).items():
        if g[1] != "_":
            a, b, c = (letters.letter(0 if x == "_" else ord(x)).astype(int) for x in g)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_language_equals_plain_bundles(spark, tmp_path):
    r = random.Random(19)
    say = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, r.randrange(1, 40)), r.choice((lang, lang, None, "fr")), "s", 0) for i, lang in enumerate(list(SYLLABLES) * 12)]
    rows += [(60, "1 2", "de", "s", 0), (61, None, "de", "s", 0), (62, "xyz qqq", "xx", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op5_langid(spark, str(tmp_path)).collect()}
    vectors = {i: bundle(t) for i, t, *_ in rows}
    protos = {}
    for i, _, lang, *_ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and vectors[i].any():
            protos[lang] = protos.get(lang, 0) + vectors[i]
    for i, v in vectors.items():
        cosines = {k: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 6) for k, p in sorted(protos.items())} if v.any() else {}
        best = max(cosines, key=cosines.get, default="und")
        assert abs(got[i].score - max(0, cosines.get(best, 0))) < 1e-5
        assert got[i].lang_pred == best or abs(cosines[got[i].lang_pred] - cosines[best]) < 1e-5


def brute_language(texts):
    """Whether each text is like the language of the training documents, all labelled alike."""
    vectors = [bundle(t) for t in texts]
    proto = sum(v for i, v in enumerate(vectors) if zlib.crc32(str(i).encode()) % 4 != 2)
    letters = [sum(c.isalpha() for c in t or "") for t in texts]
    least = [0 if n < 20 else min(0.15, max(0.05, 0.05 + (n - 50) / 1500)) for n in letters]
    return [bool(v.any()) and v @ proto / np.linalg.norm(v) / np.linalg.norm(proto) >= x for v, x in zip(vectors, least, strict=True)]


# ---- pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    texts = corpus(9, 25)
    item = sentence(r, 40)
    texts += [item + " " + sentence(r, 20), sentence(r, 50) + "\n" + sentence(r, 50), "123 !!"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = table_dir(tmp_path, spark, texts, benchmark=bench)
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, d).collect()}
    lettered = [i for i, known in enumerate(brute_language(texts)) if known]
    assert 3 in lettered and texts.index(None) not in lettered and len(texts) - 1 not in lettered
    left = dict(zip(lettered, brute_lines([texts[i] for i in lettered]), strict=True))
    left = {i: t for i, t in left.items() if t.strip()}
    near = dict(zip(left, brute_near(list(left.values()), 5, 80), strict=True))
    left = {i: t for k, (i, t) in enumerate(left.items()) if near[i][1] == k}
    judged = dict(zip(left, brute_contamination(left.values(), [(1, item)]), strict=True))
    left = {i: t for i, t in left.items() if not judged[i][4]}
    assert out.keys() == left.keys()
    assert all(out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and out[i].n_tokens == len(out[i].ids) for i, t in left.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    item, long = sentence(r, 40), sentence(r, 20_000)
    texts = [sentence(r, 30), None, "", "!!", sentence(r, 30) + "\n" + sentence(r, 20), item, long, "kept", "kept", sentence(r, 40)]
    ids = [1, 2, 3, None, 4, 5, 6, 7, 7, None]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "id", "comp", "score", "lang_pred", "removed", "later", "__row", "__n", "size", "_row", "c0", "items"]
    rows = docs(spark, texts, ids).withColumns({c: F.lit(c) for c in names})
    kept = {"language_id": 7, "line_dedup": 7, "near_dedup": 9, "decontaminate": 9}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        got = out.collect()
        assert out.columns == rows.columns and all(x[c] == c for x in got for c in names), name
        assert len(got) == kept[name], (name, [(x.doc_id, (x.text or "")[:20]) for x in got])
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    assert len(out) == len(texts) and sum(x.n_tokens == 0 for x in out) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), str(tmp_path)).count() == 0
