import html
import re
import time

import numpy as np
import pytest

from tessera.llm import pictures, queries, templates

PAGE = """<html><head><title>T</title></head><body class="home ad-free"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="sidebar"><p>side</p></div><main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
 three<br>four &nbsp; &lt;x&gt; <a href=x>link</a></p><ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table><div class="advertisement">buy</div>
<form><input value=1> go</form><script>if (a<b) x("</p>")</script><p hidden>no</p><section id="comments"><p>first!</p></section></article></main><footer>foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title & more\nOne two three four <x> link\na\nb\nc1\nc2"),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b < c <3 d", "a\nb < c <3 d"),
        ("<div><a href=q>only a link</a></div><p>Text &#233; <a>x</a> more text here</p>", "Text é x more text here"),
        ("<article><p>a</article></p></div><p>after", "a"),
        ("<body><nav>m</nav><div><p>kept <!-- <p>no</p> --> here</p></div><aside>s</aside>", "kept here"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article><script>never closed <p>x</p>", ""),
        ("<article><p title='a > b' class=x>quoted</p></article>", "quoted"),
    ],
)
def test_main_text(page, text):
    assert templates.main_text(page, 1, None) == text


def plain_text(page):
    article = page[page.index("<article>") : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article)]
    return "\n".join(p for p in parts if p)


def test_pages_query(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"] and r["text"] == plain_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


NEUTRAL = "<body><div class=a1><p>Welcome to our site</p></div><div class=b1><a href=/>Home {2}</a><a href=/x>More {2}</a></div><div class=c1><p>Story {0} about {1}.</p><p>Said by many.</p>{3}</div><div class=a1><p>All rights are ours</p></div></body>"


def neutral_pages():
    """No element or name says what is what; two pages share a passage of two lines, and one of each three has a box."""
    passage, box = "<p>Shared one</p><p>Shared two</p>", "<div class=d1><p>Join us</p><p>every week</p></div>"
    rows = [(i, f"https://User@One.example.com:80/{i}", NEUTRAL.format(i, i * 7, i, "<p>Extra.</p>" * (i % 4) + passage * (i in (1, 2)) + box * (i % 3 < 2))) for i in range(12)]
    return [*rows, (100, "http://two.example.com/", NEUTRAL.format(1, 2, 3, "")), (11, None, None), (12, "", "<p>x</p>"), (12, "", "<p>x</p>")]


def plain_template(pages):
    """Texts of nested valid classes of one host, from occurrence vectors as they are."""
    vectors, parents, texts = {}, {}, set()
    for i, page in enumerate(pages):
        seen = {1: templates.Token(1, 1, False)} | templates.page_tokens(page, 1)
        for t, x in seen.items():
            vectors.setdefault(t, [0] * len(pages))[i] = x.count
            parents[t] = x.parent
            texts |= {t} if x.is_text else set()
    classes = {}
    for t, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(t)
    valid = {t for v, c in classes.items() if len(c) > 1 and sum(map(bool, v)) > 1 for t in c}
    common = lambda t: sum(map(bool, vectors[t])) >= 0.5 * len(pages)
    nested = lambda t: set(vectors[t]) == {1} or parents[t] in valid - texts or classes[tuple(vectors[t])] - texts
    return {t for t in texts & valid if common(t) and nested(t)}


def test_the_template_decides_pages_without_marks(spark):
    rows = neutral_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    one = [h for _, u, h in rows if u and "One" in u]
    host = templates.xxh64_intdigest("one.example.com")
    own = templates.tokens(df, "page_id", "url", "html")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {r["token"] for r in templates.template_texts(templates.template(own)).where(f"host = {signed(host)}").collect()}
    texts = {b.text: b for page in one for b in templates.parse(page)[0]}
    by_plain = {t for t in texts if templates.text_token(1, texts[t]) in plain_template(one)}
    assert {t for t in texts if signed(templates.text_token(host, texts[t])) in found} == by_plain == {"Welcome to our site", "All rights are ours", "Said by many.", "Join us", "every week"}
    got = {r["page_id"]: r["text"] for r in templates.extract(df).collect()}
    assert got[3] == "Story 3 about 21.\nExtra.\nExtra.\nExtra." and got[4] == "Story 4 about 28."
    assert got[1] == "Story 1 about 7.\nExtra.\nShared one\nShared two"
    assert templates.main_text(one[4], host).startswith("Welcome to our site\nStory 4")  # without the template
    assert got[100].startswith("Welcome to our site\nStory 1") and got[11] == "" and got[12] == "x"
    assert templates.extract(df.where("false")).collect() == [] and templates.extract(df).count() == len(rows)


def test_boilerplate_inside_articles_goes_and_copies_stay(spark):
    page = "<article><h1>T {0}</h1><p>Words {0}.</p>{1}<div><p>Share this with friends</p></div></article><p>outside {0}</p>"
    rows = [(i, "http://a.example/", page.format(i, "<p>more</p>" * (i % 3))) for i in range(8)]
    rows += [(50 + i, "http://copies.example/", page.format(1, "")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T 3\nWords 3." and got[4] == "T 4\nWords 4.\nmore"
    assert got[50] == "T 1\nWords 1.\nShare this with friends"


def test_an_article_that_holds_little_is_no_main_text(spark):
    page = "<div class=x><article><p>Teaser {0}</p></article></div><div class=y><p>A long story number {0} that goes on and on for a while, by itself</p></div>"
    rows = [(i, "http://a.example/", page.format(i)) for i in range(4)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("A long story" in r["text"] for r in got)


@pytest.mark.parametrize("bit", ["<a ", "<!", "<xmp>", "<div></x>", '<a x="', "<b>x<hr>", "<p><h1>", "<li><b>", '<a <a x=">"'])
def test_reading_takes_time_in_proportion(bit):
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        templates.parse(bit * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_names_mark_as_a_whole():
    page = '<article><p title="the hidden cost">a</p><p class="share-price">b</p><h2 id="form-and-function">c</h2><div class="share-buttons">d</div><p hidden>e</p><p aria-hidden=true>f</p></article>'
    assert templates.main_text(page, 1) == "a\nb\nc"


def test_copies_are_found(spark, sf):
    rows = queries.op1_media_columns(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r["vec_id"]: tuple(r["embedding"]) for r in table.collect()}
    assert sorted(r["vec_id"] for r in rows) == sorted(i for i in vectors if i % 20 == 0)
    right = sum(r["best_id"] is not None and vectors[r["best_id"]] == vectors[r["vec_id"]] for r in rows)
    assert right / len(rows) >= 0.9  # against the known answer
    assert sum(r["n_links"] for r in rows) <= 1.2 * len(rows)


@pytest.mark.parametrize("edit", pictures.EDITS)
def test_recall_by_edit(spark, sf, edit):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(120).collect()]
    painted = [(i, pictures.painted(np.array([v]))) for i, v in vectors]
    schema = "id long, image binary"
    library = spark.createDataFrame([(i, pictures.pgm(p[0])) for i, p in painted], schema)
    asked = spark.createDataFrame([(i, pictures.pgm(pictures.edited(p, edit)[0])) for i, p in painted[::3]], schema)
    same = {i: {j for j, w in vectors if w == v} for i, v in vectors}
    rows = pictures.search(asked, library).collect()
    assert sum(r["best_id"] in same[r["id"]] for r in rows) >= 0.9 * len(rows)


def test_pictures_turned_scaled_and_unlike(spark):
    r = np.random.default_rng(1)
    base = [pictures.painted(r.normal(0, 0.13, (1, 64)))[0] for _ in range(12)]
    library = [(i, pictures.pgm(b)) for i, b in enumerate(base)] + [(50, pictures.pgm(base[4])), (51, None), (52, b"junk"), (53, b""), (54, b"P5 2 2 255\n1234")]
    asked = [(0, pictures.pgm(base[0][8:80, 10:90])), (1, pictures.pgm(np.rot90(base[1]))), (2, pictures.pgm(255 - (255 - base[2]) * 0.7)), (4, pictures.pgm(base[4])), (99, pictures.pgm(pictures.painted(r.normal(0, 0.13, (1, 64)))[0])), (98, None)]
    schema = "id long, image binary"
    got = {x["id"]: x for x in pictures.search(spark.createDataFrame(asked, schema), spark.createDataFrame(library, schema)).collect()}
    assert [got[i]["best_id"] for i in (0, 1, 2, 4, 99, 98)] == [0, 1, 2, 4, None, None]
    assert got[4]["best_members"] == 2 and got[98]["n_corners"] == 0 and got[99]["n_links"] == 0
    none = spark.createDataFrame([], schema)
    assert pictures.search(none, none).collect() == []


def test_common_corners_are_told_apart_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(pictures, "HOT", 2)
    r = np.random.default_rng(2)
    base = [pictures.painted(r.normal(0, 0.13, (1, 64)))[0] for _ in range(6)]
    for b in base[1:]:
        b[:, :64] = base[0][:, :64]  # two thirds of every picture are the same
    schema = "id long, image binary"
    df = spark.createDataFrame([(i, pictures.pgm(b)) for i, b in enumerate(base)], schema)
    got = {x["id"]: x for x in pictures.search(df, df).collect()}
    assert all(got[i]["best_id"] == i for i in range(6))


def test_png(spark):
    import struct
    import zlib

    a = np.arange(24 * 20, dtype=np.uint8).reshape(24, 20)
    for kind in range(3):
        lines = a.copy()
        if kind == 1:
            lines[:, 1:] = a[:, 1:] - a[:, :-1]
        if kind == 2:
            lines[1:] = a[1:] - a[:-1]
        data = zlib.compress(b"".join(bytes([kind]) + x.tobytes() for x in lines))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 20, 24, 8, 0, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")
        assert (pictures.grey(raw) == a).all()


def test_near_vectors_give_near_pictures():
    r = np.random.default_rng(7)
    v = r.normal(0, 0.13, (20, 64))
    near, far = pictures.painted(v + r.normal(0, 0.01, v.shape)), pictures.painted(r.normal(0, 0.13, v.shape))
    apart = lambda a, b: np.abs(a - b).mean()
    assert apart(pictures.painted(v), near) < 0.3 * apart(pictures.painted(v), far)


def test_corners_meet_if_three_bits_differ(spark):
    kind = "__id long, corners " + pictures.CORNER
    a, b = 0x123456789ABCDEF, 0x0FEDCBA987654321
    one = lambda a, b: (1, [(0.0, 0.0, 0, 0, a, b)])
    asked = pictures.entries(spark.createDataFrame([one(a, b)], kind), "q")
    for bits in ((0, 31, 32), (5, 40, 70), (33, 65, 97)):
        x = sum(1 << i for i in bits)
        other = spark.createDataFrame([one(a ^ (x & (1 << 64) - 1), b ^ (x >> 64))], kind)
        assert asked.join(pictures.entries(other, "l"), "k").count() >= 1


def test_splitting_common_entries_loses_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = [pictures.painted(r.normal(0, 0.13, (1, 64)))[0] for _ in range(6)]
    for b in base[1:]:
        b[:, :64] = base[0][:, :64]
    schema = "id long, image binary"
    library = spark.createDataFrame([(i, pictures.pgm(b)) for i, b in enumerate(base)], schema)
    asked = spark.createDataFrame([(i, pictures.pgm(pictures.edited(b[None])[0])) for i, b in enumerate(base)], schema)
    whole = sorted(map(tuple, pictures.search(asked, library).collect()))
    monkeypatch.setattr(pictures, "HOT", 2)
    assert sorted(map(tuple, pictures.search(asked, library).collect())) == whole and sum(x[2] for x in whole) >= 6


def test_small_crops_of_large_pictures_are_found(spark):
    r = np.random.default_rng(8)
    base = [np.kron(r.uniform(20, 235, (64, 64)), np.ones((8, 8))) for _ in range(3)]
    schema = "id long, image binary"
    library = spark.createDataFrame([(i, pictures.pgm(b)) for i, b in enumerate(base)], schema)
    asked = spark.createDataFrame([(i, pictures.pgm(b[170:330, 150:310])) for i, b in enumerate(base)], schema)
    assert [x["best_id"] for x in sorted(pictures.search(asked, library).collect())] == [0, 1, 2]


def test_matches_are_all_pairs_that_share_an_entry_and_stay_in_their_task(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(4)
    bits = r.integers(0, 2**63, (40, 2)).astype(np.uint64)
    other = np.concatenate([bits, bits]) ^ (np.uint64(1) << r.integers(0, 64, (80, 2)).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, (80, 2)).astype(np.uint64))
    other[:20, 0] = bits[0, 0]  # a common entry
    signed = lambda x: [(0.0, 0.0, 0, 0, *v) for v in x.view(np.int64).tolist()]
    asked = spark.createDataFrame([(7, signed(bits[:25])), (9, signed(bits[25:]))], "__id long, corners " + pictures.CORNER)
    assert pictures.index(asked, str(tmp_path)) == 1
    q = pictures.opened(str(tmp_path), 0)
    words = lambda x: (x[:, :, None] >> np.array([32, 0], dtype=np.uint64) & np.uint64(0xFFFFFFFF)).reshape(len(x), 4)
    share = (words(bits)[:, None] == words(other)[None]).any(axis=2)
    near = np.bitwise_count(bits[:, None] ^ other[None]).sum(axis=2) <= pictures.MOST_BITS
    for most in (3, 1 << 18):
        i, j = pictures.matches(q, {"a": other[:, 0], "b": other[:, 1]}, most)
        got = list(zip(np.asarray(q["rows"])[q["picture"][i]].tolist(), q["i"][i].tolist(), j.tolist()))
        assert len(got) == len(set(got)) and set(got) == {(7, a, b) if a < 25 else (9, a - 25, b) for a, b in zip(*np.nonzero(share & near))}
    images = [(i, pictures.pgm(pictures.painted(r.normal(0, 0.13, (1, 64)))[0])) for i in range(3)]
    df = spark.createDataFrame(images, "id long, image binary")
    plan = pictures.search(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_set" not in plan  # neither corners nor matches are rows of a shuffle
