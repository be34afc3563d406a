"""Each operator on small tables: nulls, empty and long texts, ties and repeated rows, empty tables, extra columns."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from irspan.llm import byte_bpe, common, components, html_extract, knn_quality, language_id, line_quality, lz_fingerprint, pattern_packing, shingle_sets, simhash_dedup, suffix_dedup, warc

WORDS = "the of and river stone lamp ñandú straße été window paper green seven holding under into garden".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


ROWS = [(i, prose(i % 23, 5 + 7 * (i % 19))) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " \n\t "), (103, prose(99, 9000)), (104, ROWS[3][1]), (105, ROWS[5][1] + " tail"), (5, ROWS[5][1]), (106, "a"), (107, "\U0001f600  x y")]


def docs(spark, rows=ROWS):
    """Documents with columns whose names operators use inside."""
    full = [(i, t, "x", i, 7, "k") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, id string, fp long, rank int, key string").repartition(3)


def empty(spark):
    return docs(spark).where("doc_id < 0")


# ---- op 1


def test_fingerprints_follow_the_next_document(spark):
    rows = [r for i, r in enumerate(ROWS) if r[0] not in {x[0] for x in ROWS[:i]}]
    found = {r.doc_id: r for r in lz_fingerprint.with_edited(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (lz_fingerprint.signature(x) for x in (t, edited, n))
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.to_text(a), lz_fingerprint.to_text(b))
        assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c))


def slow_fingerprint(text):
    """Phrases of LZ78 and their smallest hashes, one phrase and one character at a time."""
    phrases, at, m = set(), 0, (1 << 64) - 1
    while at < len(text or ""):
        end = at + 1
        while text[at:end] in phrases and end <= len(text):
            end += 1
        phrases.add(text[at:end])
        at = end
    values = set()
    for p in phrases:
        h, power = 0, 1
        for c in p:
            h = (h + (ord(c) + 1) * power) & m
            power = power * (0x9E3779B97F4A7C15 | 1) & m
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        values.add(h >> 32)
    return sorted(values)[:128]


def slow_likeness(a, b):
    smallest = sorted({*a, *b})[:128]
    return sum(x in a and x in b for x in smallest) / len(smallest) if a and b else float(not a and not b)


@pytest.mark.parametrize("run", [100, 3])
def test_edited_texts_against_brute_force(spark, run, monkeypatch):
    """Several runs of ids; repeated, tied and null ids, whose order is by text."""
    monkeypatch.setattr(lz_fingerprint, "RUN_ROWS", run)
    rows = [*ROWS, (3, "another text under one id"), ROWS[7], (None, "no id"), (None, None), (-5, "x" * 3000), (10**15, prose(5, 40))]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = (slow_fingerprint(x) for x in (t, edited, n))
        text = lambda v: "".join(f"{x:08x}" for x in v)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(slow_likeness(a, b), 9), round(slow_likeness(a, c), 9)] += 1
    got = lz_fingerprint.with_edited(docs(spark, rows)).collect()
    assert Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_fingerprint_edges(spark):
    assert lz_fingerprint.with_edited(empty(spark)).count() == 0
    assert lz_fingerprint.fingerprints(empty(spark)).count() == 0
    one = lz_fingerprint.with_edited(docs(spark, [(1, "abcabc")])).first()
    assert one.near_next == 1.0
    rows = [*ROWS, (None, "no id"), (None, None)]
    assert lz_fingerprint.with_edited(docs(spark, rows)).count() == len(rows)
    prints = {r.doc_id: r.fingerprint for r in lz_fingerprint.fingerprints(docs(spark)).collect()}
    assert prints[3] == prints[104] and prints[100] == prints[101] == ""


def test_likeness_estimates_the_jaccard_of_phrases():
    a, b = prose(1, 4000), prose(1, 3000) + prose(2, 1000)
    x, y = (set(lz_fingerprint._grow({}, t)) for t in (a, b))
    assert lz_fingerprint.likeness(lz_fingerprint.signature(a), lz_fingerprint.signature(b)) == pytest.approx(len(x & y) / len(x | y), abs=0.15)


# ---- op 2

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">The use of cookies is the law and this is a notice of it.</div>
<article><header><h1>Head&nbsp;line</h1></header><p>First <b>para<br>graph &amp; more &#233;</p><p>Second<p>Third
 line<div class="ad">Buy the thing of the year.</div></article>
<section id="comments"><p>A reader said that it is the best of the articles on this page.</p></section><footer>&copy; x</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head line\n\nFirst para graph & more é\n\nSecond\n\nThird line"
    assert html_extract.main_text(PAGE[: PAGE.index("Second") + 3]).endswith("Sec")
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<div><") == ""


def test_rules_without_an_article():
    body = "The keeper of the lamp was in the garden and it is said that he was there with the others for a time. " * 3
    links = "<a href=1>One of the links</a> " * 12
    page = f"<body><div>{links}</div><h2>A title</h2><p>{body}</p><p>Short end.</p><div>{links}</div><p>far</p></body>"
    assert html_extract.main_text(page).split("\n\n") == ["A title", " ".join(body.split())]


LONG = "The keeper of the lamp was in the garden and it is said that he was there with the others for a time."
LOW = "Zorbix quamlet fendriel oxbarn wintle grozzup ternical vexol bramtip yondle crasp whurble dinxel pomtree"


def test_nested_tags_do_not_leak():
    article = lambda x: html_extract.main_text(f"<article><p>{LONG}</p>{x}<p>{LONG} End.</p></article>")
    want = f"{LONG}\n\n{LONG} End."
    for junk in (
        '<span class="ad"><span>x</span> buy this thing now</span>',
        '<ul><li class="comment">I <ul><li>reply</li></ul> words of a reader</li></ul>',
        '<div class="advert"><div><a href=1>x</a></div> and the rest of it</div>',
        '<a class="promo" href=1><a href=2>in</a> out</a>',
        '<div class="share"><b><i>like</div>',
        "<form><p>Name<p>Mail</form>",
    ):
        assert article(junk) == want, junk


def test_other_articles_are_left_out():
    cards = "".join(f"<article><h2>Teaser {i}</h2><p>Some of the words of it.</p></article>" for i in range(4))
    assert html_extract.main_text(f"<main><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><article><p>A nested reader's remark.</p></article></article>{cards}</main>") == f"Title\n\n{LONG}\n\n{LONG}"
    # An article that holds little of the page's good text is no article.
    far = f"<article><p>Read of the day.</p></article><div><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p></div>"
    assert LONG in html_extract.main_text(far)


def test_the_rules_decide(monkeypatch):
    """Inside an article and without one; each page comes out otherwise when no block is classified."""
    links = "<ul>" + "<li><a href=1>Some other story of the day</a></li>" * 6 + "</ul>"
    inside = f"<article><h1>Head</h1><p>{LONG}</p>{links}<p>More on this</p>{links}<p>{LONG}</p></article>"
    outside = f"<div>{links}<p>{LOW}</p>{links}<h2>Head</h2><p>{LONG} {LONG} {LONG}</p><p>Short.</p><p>{LONG} {LONG}</p><div>{LOW}</div>{links}</div>"
    low = f"<article><p>{LONG}</p>{links}<p>{LOW}</p>{links}<p>{LONG}</p></article>"
    assert html_extract.main_text(inside) == f"Head\n\n{LONG}\n\n{LONG}"
    assert html_extract.main_text(outside) == f"Head\n\n{LONG} {LONG} {LONG}\n\nShort.\n\n{LONG} {LONG}"
    assert html_extract.main_text(low) == f"{LONG}\n\n{LONG}"
    before = [html_extract.main_text(x) for x in (inside, outside, low)]

    def all_good(found):
        for b in found:
            b.label = "good"
        return found

    monkeypatch.setattr(html_extract, "classify", all_good)
    assert all(html_extract.main_text(x) != y for x, y in zip((inside, outside, low), before))


def test_other_languages_by_length():
    chinese = "这是一段没有停用词的正文它只有汉字而且相当长所以应当被保留下来作为文章的主要内容请不要把它当作导航或者广告来处理因为它确实是正文的一部分而不是别的东西这里再多写几句话。"
    assert html_extract.main_text(f"<div><a href=1>导航</a> <a href=2>首页</a></div><p>{chinese}</p><p>{chinese}</p>") == f"{chinese}\n\n{chinese}"


def random_page(r):
    """A page and the text that it was made of, block by block."""
    blocks, parts = [], []
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(14, 60))) + "."
    junk = lambda: r.choice(['<div class="ad">Buy of the year</div>', "<!-- <p>no</p> -->", "<script>var p='<p>x</p>';</script>", '<aside><p>Side of the page</aside>', "<nav><ul><li><a href=1>one<li>two</ul></nav>", '<div id="comments"><div class=x><p>I think that it is so</div></div>', "<form><input name=q><button>Go</button></form>"])
    for _ in range(r.randrange(1, 9)):
        text = sentence()
        marked = text.replace(" the ", " <b>the</b> ").replace(" of ", "\n<i>of</i>&nbsp;&#32;").replace("ñ", "&ntilde;")
        blocks.append(text)
        parts.append(r.choice([f"<p>{marked}</p>", f"<p>{marked}", f"<div>{marked}</div>", f"<ul><li>{marked}</ul>", f"<blockquote><p>{marked}</blockquote>"]))
        if r.random() < 0.4:
            parts.append(junk())
    body = "".join(parts)
    page = r.choice([f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>"])
    return f"<html><head><title>T</title></head><body>{junk()}<header><p>The name of the site</header>{page}{junk()}<footer>the end of it</footer></body></html>", "\n\n".join(blocks)


def test_pages_of_known_text(spark):
    r = random.Random(5)
    made = [random_page(r) for _ in range(150)]
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(made)}


def test_class_words_are_evidence_only():
    """Layouts carry words of boilerplate on the elements that hold the article; those that are it go."""
    text = [f"{LONG} Part {i}, and so on." for i in range(4)]
    body, want = "".join(f"<p>{t}</p>" for t in text), "\n\n".join(text)
    reader = f"<p>I said: {LONG}</p>"
    junk = f'<div class="sidebar"><p>{LONG}</p></div><div id="cookie-notice"><p>{LONG}</p></div><form action="/s"><p>{LONG}</p></form><div class="comments-area">{reader * 9}</div>'
    for before, after in (
        ('<div class="wrap has-sidebar"><article>', "</article></div>"),
        ('<div class="post comments-open">', "</div>"),
        ('<main><div class="notice-board">', "</div></main>"),
        ('<form id="aspnetForm"><div id="content">', "</div></form>"),
        ('<div class="overflow-hidden"><div class="no-sidebar container">', "</div></div>"),
        ('<div class="sidebar-right">', "</div>"),
        ('<div class="ad-free"><form><article class="story share-open">', "</article></form></div>"),
    ):
        for extra in ("", junk):
            for page in (f"<body>{before}{body}{after}{extra}</body>", f"<body>{extra}{before}{body}{after}</body>", f"<body>{before}{body}{extra}{after}</body>"):
                assert html_extract.main_text(page) == want, page
    assert html_extract.main_text(f"<body><p>Short.</p><div class='comments'>{reader * 20}</div></body>") in ("", "Short.")


def unmarked_page(r, style):
    """A page without ``article`` or ``main`` in one of four styles of mark-up, and its text."""
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(14, 60))) + "."
    title, texts = " ".join(r.choice(WORDS) for _ in range(5)), [sentence() for _ in range(r.randrange(3, 9))]
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(WORDS, 5))
    remark = f"<p>{sentence()}</p>" * r.randrange(3)
    if style == "blog":
        body = f'<div id="page" class="site has-sidebar"><div class="entry-content"><h1>{title}</h1>{"".join(f"<p>{t}</p>" for t in texts)}</div><div class="sidebar"><ul>{links}</ul><p>{sentence()}</p></div><div id="comments">{remark}</div></div>'
    elif style == "table":
        body = f'<table><tr><td class="menu"><ul>{links}</ul></td><td><h2>{title}</h2>{"".join(f"<p>{t}" for t in texts)}</td></tr></table>'
    elif style == "form":
        body = f'<form id="aspnetForm"><div class="navbar"><ul>{links}</ul></div><div class="body"><h1>{title}</h1>{"".join(f"<div>{t}</div>" for t in texts)}</div></form>'
    else:
        body = f'<ul>{links}</ul><div><div class="notice-board layout"><h1>{title}</h1>{"".join(f"<section><p>{t}</p></section>" for t in texts)}</div></div><div class="related"><ul>{links}</ul></div>'
    return f"<html><body><header><p>The name of the site</header>{body}<footer>the end of it</footer></body></html>", "\n\n".join([title, *texts])


@pytest.mark.parametrize("style", ["blog", "table", "form", "plain"])
def test_unmarked_pages_of_known_text(style):
    r = random.Random(style)
    for _ in range(100):
        page, want = unmarked_page(r, style)
        assert html_extract.main_text(page) == want, page


def test_long_pages_take_seconds():
    start = time.time()
    for page in ("<div>" * 50_000 + "</section>" * 50_000, "<p><b>" * 100_000, "<a>" * 50_000 + "<div>" + "</a>" * 50_000, "<li><i>" * 100_000, "<" * 1_000_000, "<div class=sidebar>" * 50_000 + LONG, f"<div class='ad wrap'><p>{LONG}</p>" * 20_000, '<a "' * 200_000, f"<article>{f'<p>{LONG}</p>' * 50_000}"):
        html_extract.main_text(page)
    assert time.time() - start < 60


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, "x", 1), (None, "w", "", "x", 1)], "page_id long, url string, html string, text string, k0 int")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == 4 and sum(r.text == "" for r in rows) == 2 and len({r.text for r in rows if r.page_id == 1}) == 1
    assert html_extract.extract(pages.where("page_id > 9")).count() == 0


# ---- op 3


@pytest.mark.parametrize("cutting", [byte_bpe.Cutting(), byte_bpe.Cutting(300, 80), byte_bpe.Cutting(200, 70, 900, 300)])
def test_byte_bpe(spark, cutting):
    import public_tokenizers

    path, pattern = byte_bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encode = byte_bpe.encoding(path, pattern).encode_ordinary
    rows = [*ROWS, (200, "z" * 3000), (201, " " * 3000 + "x"), (202, "it's   we'll \n\n 12345 " * 60), (None, "no id " * 90), (None, "no id " * 90), (203, ("a\t\t \t" * 40 + "b") * 9)]
    want = Counter()
    for i, t in rows:
        ids = encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    found = byte_bpe.encode_digests(docs(spark, rows), path, pattern, cutting=cutting)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert byte_bpe.encode_digests(empty(spark), path, pattern).count() == 0
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(docs(spark, ROWS[:5]), path, pattern, cutting=cutting).collect()}
    assert ids == {i: encode(t) for i, t in ROWS[:5]}


def test_chunks_meet_at_boundaries():
    import public_tokenizers

    path, pattern = byte_bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encode = byte_bpe.encoding(path, pattern).encode_ordinary
    r = random.Random(2)
    letters, cuts = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "\t", "7", "é", "日", "!", "?", "\u3000", "\x1c", "\x85"], 0
    for _ in range(1500):
        text = "".join(r.choice(letters) * r.choice([1, 1, 1, 1, 2, 5, 40]) for _ in range(r.randrange(1, 200)))
        chunk, overlap = r.choice([(50, 70), (100, 80), (30, 66), (200, 90)])
        assert byte_bpe.encode_chunked(text, path, pattern, chunk, overlap) == encode(text)
        cuts += len(byte_bpe.chunk_cuts(text, pattern, chunk, overlap))
    assert cuts > 5000


def test_very_long_runs(spark):
    """White space as long as the library can take, and longer; other long runs."""
    import public_tokenizers

    path, pattern = byte_bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encode = byte_bpe.encoding(path, pattern).encode_ordinary
    for text in (" " * 60_000 + "x", "x" + "\n" * 60_000, "a" + " \t" * 30_000 + "  z", " " * 60_000, "z" * 90_000, "7 " * 50_000):
        assert byte_bpe.encode_chunked(text, path, pattern) == encode(text)
    rows = [(0, " " * 2_000_000 + "x"), (1, "y" + " \n" * 1_000_000), (2, "z" * 2_000_000), (3, "5" * 2_000_000), (4, "日" * 700_000 + " " * 5000)]
    one = lambda c: len(encode(c))
    got = {r.doc_id: r for r in byte_bpe.encode_digests(docs(spark, rows), path, pattern).collect()}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert got[0].n_tokens == 1_999_999 * one(" ") + one(" x")
    # The packing operator's tokenizer on the same texts.
    ids = pattern_packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern).encode([t for _, t in rows])
    exact = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
    assert [exact.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids] == [t.encode() for _, t in rows]


# ---- op 4


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    groups = {k: k for k in prints}

    def top(x):
        while groups[x] != x:
            x = groups[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = top(a), top(b)
                groups[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_simhash(spark):
    near = [(300 + i, prose(7, 400) + f" end{i}") for i in range(12)]
    rows = [*{i: (i, t) for i, t in ROWS}.values(), *near]
    prints = {i: slow_simhash(t) for i, t in rows}
    want = slow_components(prints)
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert found == {i: (prints[i], want[i]) for i in prints}
    assert len({want[i] for i, _ in near}) < len(near)
    again = simhash_dedup.near_duplicates(docs(spark, [*rows, (None, rows[0][1]), (None, "no id here"), rows[0]])).collect()
    assert len(again) == len(rows) + 3 and {(r.doc_id, r.component_id) for r in again if r.doc_id is not None} == set(want.items())
    assert {r.component_id for r in again if r.doc_id is None} == {want[rows[0][0]], None}
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_tally_before_verification():
    """Of random fingerprints that share a triple of bytes few reach four equal bytes, and all links do."""
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for _ in range(20_000)], np.uint64)
    linked = simhash_dedup._linked(a[:20_000], a[:20_000] ^ flips)
    assert np.array_equal(linked, np.bitwise_count(flips) <= 4)
    shared = (a & np.uint64(0xFFFFFFFFFF)) | np.uint64(0x123456 << 40)
    x, y = shared[:100_000], shared[100_000:]
    reach = ((x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= simhash_dedup.LEAST_EQUAL
    assert 0.005 < reach.mean() < 0.05


@pytest.mark.parametrize("block", [4096, 5])
def test_links_connect_all(spark, block):
    r = random.Random(3)
    values = set()
    for _ in range(25):
        centre = r.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(r.choice([1, 2, 30]))}
    prints = dict(enumerate(sorted(values)))
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    found = simhash_dedup.links(spark.createDataFrame([(signed[v],) for v in values], "fp long"), block).collect()
    back = {s: v for v, s in signed.items()}
    assert all(bin(back[x.a] ^ back[x.b]).count("1") <= 4 for x in found)
    number = {v: k for k, v in prints.items()}
    edges = spark.createDataFrame([(number[back[x.a]], number[back[x.b]]) for x in found], "u long, v long")
    joined = {x.node: x.component for x in components.components(edges).collect()}
    assert {k: joined.get(k, k) for k in prints} == slow_components(prints)


@pytest.mark.parametrize("short", [256, 2])
def test_near_duplicates_of_the_pipeline(spark, short, monkeypatch):
    """All pairs of a five-word Jaccard of 0.8 or more, whatever their fingerprints."""
    import corpus_pipeline

    monkeypatch.setattr(simhash_dedup, "SHORT", short)
    r = random.Random(4)
    rows = [(i, prose(3000 + i, r.randrange(20, 200))) for i in range(40)]
    for i in range(40, 160):  # copies of copies with a few words changed, many of one text
        words = (rows[0] if i < 80 else r.choice(rows))[1].split()
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one two three")]
    sets = {i: set(shingle_sets.shingles((t or "").encode()).tolist()) for i, t in rows}
    group = {i: i for i in sets}
    bits = []
    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                bits.append((simhash_dedup.simhash((rows[i][1] if i < 160 else "").encode()) ^ simhash_dedup.simhash((rows[j][1] if j < 160 else "").encode())).bit_count())
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert max(bits) > simhash_dedup.BITS
    want = {i for i in group if group[i] == i}
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark).columns and sorted(x.doc_id for x in kept.collect()) == sorted(want)
    more = [*rows, rows[0], (0, prose(9001, 50)), (None, rows[0][1]), (None, rows[0][1])]
    assert Counter(x.doc_id for x in simhash_dedup.one_of_each(docs(spark, more)).collect()) == Counter([*want, 0, None, None])
    assert simhash_dedup.one_of_each(empty(spark)).count() == 0


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 140), 100)}


# ---- op 5


def test_language(spark):
    made = {"en": "the house of the river was with them", "de": "der Fluß und das Haus für sich auf", "fr": "la rivière était une où leur très"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(made[x].split(), k=12)), x) for i in range(90) for x in made]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 %", None), (903, "the river", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table)
    found = {(x.doc_id, x.lang): x for x in language_id.predict(table, model, keep=("doc_id", "lang")).collect()}
    assert all(found[i, x].lang_pred == x and 0 < found[i, x].score <= 1 for i, _, x in rows[:-4])
    assert [found[k].lang_pred for k in ((900, "en"), (901, "de"), (902, None), (903, None))] == ["und", "und", "und", "en"]
    assert language_id.accepted(table, model).count() == len(rows) - 3
    nothing = language_id.train(table.where("lang is null"))
    assert {x.lang_pred for x in language_id.predict(table, nothing).collect()} == {"und"}
    assert language_id.predict(table.where("doc_id < 0"), model).count() == 0


def slow_grams(text):
    """Letter n-grams of three and four of every word within a space on either side, one by one."""
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split():
        for n in (3, 4):
            yield from ((n, f" {word} "[i : i + n]) for i in range(len(word) + 3 - n))


def slow_languages(rows):
    """Votes by exact sets instead of filters: text to (language, score)."""
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slow_grams(text))
    sizes = Counter(lang for text, lang in rows if text is not None and lang is not None)
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    totals = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) for x in order for n in (3, 4)}
    most = {}
    for x in order:
        for g, c in counts[x].items():
            most[g] = max(most.get(g, 0), c / totals[x, g[0]])
    held = {x: {g for g, c in counts[x].items() if c / totals[x, g[0]] >= 0.5 * most[g]} for x in order}

    def of(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        grams = list(slow_grams(text))
        hits = [sum(g in held[x] for g in grams) for x in order]
        best = hits.index(max(hits))
        return order[best], max(hits) / sum(hits) if sum(hits) else 0.0

    return of


def test_language_against_sets(spark):
    r = random.Random(3)
    letters = {"aa": "abcdeé", "bb": "cdefgß", "cc": "abefghñ", "dd": "日本語文字"}
    word = lambda x: "".join(r.choice(letters[x]) for _ in range(r.randrange(1, 8)))
    rows = [(i, " ".join(word(x) for _ in range(r.randrange(0, 30))), x) for i, x in enumerate(r.choice("aa bb bb cc dd".split()) for _ in range(300))]
    rows += [(400, prose(1, 40), None), (401, "12 34 %", None), (402, None, "aa"), (403, "", "bb"), (404, "zzz qqq", None), (405, "\U000323AF\U00030000", None), (5, *rows[5][1:]), (None, rows[6][1], "cc"), (406, "abe " * 50_000, None)]
    of = slow_languages([x[1:] for x in rows])
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, k0 string, coverage int").repartition(3)
    got = language_id.predict(table, language_id.train(table), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for x in got:
        lang, score = of(x.text)
        assert x.lang_pred == lang and x.score == pytest.approx(score, abs=0.02), (x, lang, score)
    assert language_id.train(table.where("doc_id < 0")).languages == []


def test_more_languages_than_a_word_has_bits(spark):
    """150 languages of a letter each, and ties between equal ones."""
    letter = lambda i: chr(0x4E00 + i)
    rows = [(i, " ".join([letter(i) * 4] * 3), f"l{i:03d}") for i in range(150)]
    rows += [(200, "same words", "zz"), (201, "same words", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table)
    assert model.masks.shape[0] == 3 and len(model.languages) == 152
    got = {x.doc_id: x.lang_pred for x in language_id.predict(table, model).collect()}
    assert got == {**{i: f"l{i:03d}" for i in range(150)}, 200: "aa", 201: "aa"}


def test_one_lookup_gives_all_languages():
    masks = np.zeros(1 << 12, np.uint8)
    code = np.array([5, 77], np.uint64)
    for place in language_id._places(code, 3, len(masks)):
        masks[place[0]] |= 0b101
        masks[place[1]] |= 0b010
    got = np.bitwise_and.reduce([masks[p] for p in language_id._places(code, 3, len(masks))])
    assert got[0] & 0b101 == 0b101 and got[1] & 0b010


# ---- op 6


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_line_quality(spark):
    clean = "\n".join(prose(i, 30).capitalize().rstrip(",.") + "." for i in range(4))
    junk = "\n".join(w + " | " + prose(i, 12).replace(" ", " | ") for i, w in enumerate(WORDS[:8]))
    rows = [*ROWS, (400, clean), (401, junk), (402, "\n".join([clean, "Home | News | About | Contact", "Click here to subscribe."])), (403, "same line.\n" * 40), (404, "\n".join(x + " %%% ***" for x in clean.split())), (405, prose(77, 60_000)), (406, "word " * 40_000)]
    rows += [(407 + i, clean + f"\n{x}") for i, x in enumerate(["Ends so.”) \t", "No end", "an end. and no end", "SIGN UP now.", "a / b / c / d.", "a > b > c > d.", "what?! really?!", "é" * 50 + "。", ".", "\x0b.\x0c"])]
    found = {r.doc_id: r for r in line_quality.measure(docs(spark, rows)).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert found[400].kept and found[402].kept and found[402].cleaned == clean
    assert not found[401].kept and not found[403].kept and not found[404].kept
    assert line_quality.measure(empty(spark)).count() == 0
    plan = line_quality.measure(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- op 7


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rows = [*ROWS, (500, "<|endoftext|> is text"), (501, "日本語 　 テキスト  x"), (502, "two  spaces \n x "), (None, "no id"), (None, "no id"), (503, prose(6, 60_000)), (504, "a" + " " * 50_000 + "b"), (505, "\n" * 9_000 + "日")]
    got = pattern_packing.pack_documents(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 2048 and len(full) <= -(-sum(full.values()) // 2048) + 2
    assert pattern_packing.pack_documents(empty(spark)).count() == 0


HISTOGRAMS = {
    "short": lambda r: r.integers(20, 600, 20_000),
    "few short": lambda r: r.integers(200, 600, 2_000),
    "thirds": lambda r: r.integers(600, 1_100, 5_000),
    "mixed": lambda r: np.clip(r.lognormal(6, 1, 30_000).astype(int) + 1, 1, 2048),
    "long": lambda r: r.integers(1_000, 2_049, 3_000),
    "few": lambda r: r.integers(1, 2_049, 50),
    "one length": lambda r: np.full(1_001, 700),
    "tiny": lambda r: np.ones(5_000, int),
    "full": lambda r: np.full(77, 2048),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plans_are_tight(name, monkeypatch):
    lengths = HISTOGRAMS[name](np.random.default_rng(2))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = pattern_packing.make_plan(histogram)
    used = Counter()
    for entry, n in plan.entries:
        assert sum(entry) <= 2048 and n > 0
        used.update({x: n * c for x, c in Counter(entry).items()})
    assert used == Counter(lengths.tolist())
    monkeypatch.setattr(pattern_packing, "LEAST_BINS", ())
    plain = pattern_packing.make_plan(histogram)
    assert plan.sequences <= plain.sequences
    if name in ("short", "few short", "thirds"):
        assert plan.entries != plain.entries
    if name in ("short", "mixed", "tiny", "full"):
        assert plan.sequences <= 1.005 * lengths.sum() / 2048 + 1
    if name in ("few short", "thirds"):
        assert plan.sequences < plain.sequences  # patterns of more than three documents, and of three


def test_patterns_fit_short_lengths():
    binned = np.zeros(128)
    binned[9], binned[20], binned[33] = 900, 400, 100
    found = pattern_packing.fitted_patterns(binned)
    assert found and max(len(p) for p, _ in found) > 3
    assert all(sum(p) <= 128 for p, _ in found)
    used = sum(n * np.bincount(p, minlength=129)[1:] for p, n in found)
    assert abs(used - binned).sum() <= 0.02 * binned.sum()


def test_nnls():
    r = np.random.default_rng(4)
    a, b = r.random((30, 12)), r.standard_normal(30)
    x = pattern_packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


# ---- op 8


def slow_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                mark[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for j, m in enumerate(mark) if m and not (j and mark[j - 1]))
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("most", [1000, 2])
def test_suffix_dedup(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    r = random.Random(9)
    passages = [prose(1000 + i, 60) for i in range(4)]
    rows = [(i, " ".join(r.choice([*passages, prose(2000 + r.randrange(9999), 20)]) for _ in range(r.randrange(5)))) for i in range(40)]
    rows += [(i, r.choice(passages)[: r.randrange(90, 300)] + f" {i}") for i in range(50, 80)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "é" * 260), (105, rows[3][1]), (106, "\0z" * 120)]
    found = suffix_dedup.digests(docs(spark, rows))
    assert {x.doc_id: tuple(x)[1:] for x in found.collect()} == slow_removal(rows)
    again = suffix_dedup.digests(docs(spark, [*rows, rows[3], rows[50]])).collect()
    assert len(again) == len(rows) + 2 and {x.doc_id: tuple(x)[1:] for x in again} == slow_removal(rows)
    kept = suffix_dedup.cleaned(docs(spark, [*rows, (None, passages[0])]))
    assert kept.columns == docs(spark).columns and kept.count() == len(rows) + 1
    assert len(kept.where("doc_id is null").first().text) < len(passages[0])
    assert suffix_dedup.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1000, 2])
def test_suffix_dedup_of_rows_with_one_id(spark, most, monkeypatch):
    """Many different texts under no id and under one id: each is a document of its own."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    r = random.Random(11)
    passages = [prose(4000 + i, 25) for i in range(6)]
    texts = [" ".join([prose(5000 + i, r.randrange(3, 30)), *r.sample(passages, 2), f"{i}"]) for i in range(1400)]
    # Texts that share the lowest 15 bits of the hash, and a passage at the same place.
    hashes = spark.createDataFrame([(f"{passages[0]} {i}" + " x" * (i % 90),) for i in range(3000)], "t string").selectExpr("t", "xxhash64(cast(t as binary)) AS h").collect()
    same = {}
    for x in hashes:
        same.setdefault(x.h & 0x7FFF, []).append(x.t)
    alike = [t for ts in same.values() if len(ts) > 1 for t in ts][:60]
    assert len(alike) >= 40
    texts += alike
    for hot in (None, 7):
        rows = [(1, passages[0]), *((hot, t) for t in texts)]
        got = Counter((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(docs(spark, rows)).where("doc_id is null or doc_id = 7").collect())
        order = {x.t: x.h for x in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(cast(t as binary)) AS h").collect()}
        ranked = [(-1, passages[0]), *enumerate(sorted(texts, key=order.get))]
        want = slow_removal(ranked)
        del want[-1]
        assert got == Counter(want.values())


def test_longest_previous_factors():
    """Suffix order, common prefixes and factors against comparing all pairs of places."""
    r = random.Random(1)
    for trial in range(200):
        t = "".join(r.choice("ab" if trial % 2 else "abcd") for _ in range(r.randrange(1, 60))).encode()
        n, width = len(t), -(-len(t) // 8) * 8
        rows = np.zeros((n, width), np.uint8)
        for i in range(n):
            rows[i, : n - i] = np.frombuffer(t[i:], np.uint8)
        order, lcp = suffix_dedup.suffix_array(rows, np.arange(n, 0, -1))
        assert [t[i:] for i in order] == sorted(t[i:] for i in range(n))
        common_prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [0, *(common_prefix(t[a:], t[b:]) for a, b in zip(order, order[1:]))]
        want = [max((common_prefix(t[j:], t[i:]) for j in range(i)), default=0) for i in range(n)]
        for least in (1, 3):
            assert suffix_dedup.longest_previous_factors(order, lcp, least).tolist() == [x if x >= least else 0 for x in want]


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """Texts longer than what is hashed at a time, with repeats across the parts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rows = [(1, prose(50, 900)), (2, prose(51, 300) + prose(50, 400)), (3, "\0" * 3000 + "é" * 900), (4, prose(51, 200) * 3)]
    assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digests(docs(spark, rows)).collect()} == slow_removal(rows)


# ---- op 9


def pages(spark):
    big = "x" * 2000
    return spark.createDataFrame([(1, "http://a", big), (2, "http://b\r\nEvil: 1", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (5, "again", big), (None, "q", big)], "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    warc.plan_records(pages(spark)).repartition(3).write.format("warc").mode("append").save(str(tmp_path))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert Counter(r.warc_type for r in rows) == {"response": 6, "revisit": 2}
    assert all(r.refers_to == "<urn:page:5>" and r.payload is None and r.payload_length == 2000 for r in rows if r.warc_type == "revisit")
    for r in rows:
        assert "Evil" not in dict(r.headers)
        if r.warc_type == "response":
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    slim = warc.read(spark, str(tmp_path), ["record_id", "warc_type"]).where("warc_type = 'revisit' and record_id like '<urn%'")
    assert sorted(r.record_id for r in slim.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("*.warc.gz")))
    for name, body in (("plain", data), ("gz", gzip.compress(data))):
        (tmp_path / name).mkdir()
        (tmp_path / name / ("a.warc" if name == "plain" else "a.warc.gz")).write_bytes(body)
        got = warc.read(spark, str(tmp_path / name), ["record_id", "payload"]).collect()
        assert Counter((r.record_id, r.payload) for r in got) == Counter((r.record_id, r.payload) for r in rows)
    (tmp_path / "part-lost.warc.gz").write_bytes(b"half")
    assert warc.read(spark, str(tmp_path)).count() == 8


def test_warc_of_long_pages_and_extra_columns(spark, tmp_path):
    big = "<p>é" * 1_500_000
    rows = spark.createDataFrame([(i, "u", t, "x", "y", 1) for i, t in ((1, big), (2, big), (3, "<p>" * 400), (4, None), (4, None))], "page_id long, url string, html string, sha string, id string, kept int")
    warc.register(spark)
    warc.plan_records(rows).write.format("warc").mode("append").save(str(tmp_path))
    got = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.warc_type, r.payload_length) for r in got) == {("response", 7_500_000): 1, ("revisit", 7_500_000): 1, ("response", 1200): 1, ("response", 0): 2}
    assert next(r for r in got if r.warc_type == "response" and r.payload_length > 5000).payload == big.encode()


def test_warc_of_nothing(spark, tmp_path):
    warc.register(spark)
    warc.plan_records(pages(spark).where("page_id > 99")).write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


# ---- op 10


def test_quality(spark):
    good = [(i, prose(i, 60), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), 0) for i in range(60)]
    rows = [*good, *bad, (300, None, 1), (301, "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").where("doc_id % 3 <> 1").unionByName(spark.createDataFrame([(0, 1), (2, None), (9, 7), (None, 1)], "doc_id long, quality int"))
    model = knn_quality.train(table, labels)
    found = {x.doc_id: x.score for x in knn_quality.predict(table, model).collect()}
    assert all((found[i] >= 0.5) == bool(q) for i, _, q in rows[:-2])
    assert found[300] == found[301] == 0
    assert knn_quality.accepted(table, model).count() == 120
    nothing = knn_quality.train(table, labels.where("quality > 5"))
    assert {x.score for x in knn_quality.predict(table, nothing).collect()} == {0.0}
    assert knn_quality.accepted(table, nothing).count() == len(rows)
    assert knn_quality.predict(table.where("doc_id < 0"), model).count() == 0


def test_neighbours_are_exact():
    """Votes against a sort of all references; half of them are copies, so ties are cut everywhere."""
    r = np.random.default_rng(1)
    references = r.standard_normal((150, 6))
    references = np.concatenate([references, references[r.integers(0, 150, 150)]])
    references /= np.linalg.norm(references, axis=1, keepdims=True)
    labels = r.integers(0, 2, 300).astype(float)
    texts = [prose(i, 40) for i in range(50)] + [prose(i, 40).upper() for i in range(50)] + [None, "", prose(3, 40), "x" * 600_000]
    projection = r.standard_normal((2 * knn_quality.TERMS + 1, 6))
    model = knn_quality.Model(projection, references, labels)
    got = model.score(texts)
    for text, score in zip(texts, got):
        if not text:
            assert score == 0
            continue
        v = knn_quality.features([text])[0].astype(float) @ projection
        cosines = np.round(references @ (v / np.linalg.norm(v)), knn_quality.DECIMALS)
        near = sorted(range(300), key=lambda j: (-cosines[j], j))[: knn_quality.NEIGHBOURS]
        w = [max(cosines[j], 0) ** knn_quality.POWER for j in near]
        assert score == pytest.approx(sum(x * labels[j] for x, j in zip(w, near)) / sum(w), abs=1e-6)
    assert got[3] == got[102]


def test_terms_are_strings_of_characters():
    """Texts of one shape and other letters differ; a long text's terms are those of its parts together."""
    a, b = "the river was under the stone " * 9, "bcd fghij klm npqrs tvw xyzbc " * 9
    x = knn_quality.features([a, b, a + b])
    assert np.array_equal(x[0] > 0, x[0] > 0) and (x[0, : knn_quality.TERMS] * x[1, : knn_quality.TERMS]).sum() < 0.2 < (x[0] * x[2]).sum()
    assert np.allclose(x[0, knn_quality.TERMS : -1], x[1, knn_quality.TERMS : -1])
    long = prose(8, 100_000)
    whole = knn_quality._counts([long, "tail"])
    codes = Counter(long[i : i + 4] for i in range(len(long)))
    assert whole[0, : knn_quality.TERMS].sum() == len(long) == sum(codes.values())
    assert len(knn_quality.features([])) == 0


def test_quality_of_clashing_columns_and_repeats(spark):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).upper(), "x", 1, "y") for i in range(60)] + [(3, prose(3, 60), "x", 1, "y"), (None, prose(5, 60), "x", 1, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, id string, score int, k0 string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "z", "t") for i in range(40)], "doc_id long, quality int, id string, text string")
    found = knn_quality.predict(table, knn_quality.train(table, labels)).collect()
    assert len(found) == 62 and all((x.score >= 0.5) == bool(x.doc_id % 2) for x in found if x.doc_id is not None)
    assert len({x.score for x in found if x.doc_id == 3}) == 1


# ---- what they share


def test_settings_and_folders(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.batches(spark, 77):
        assert spark.conf.get(key) == "77"
    assert spark.conf.get(key) == before
    common.small_batches(spark, 10**9)
    assert spark.conf.get(key) == before
    t = common.Table(spark.range(3), "kept")
    assert t.rows.count() == 3
    t.drop()

    class Elsewhere:
        conf = type("c", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("s", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_folder(Elsewhere, "x")
