"""WARC archives and HTML extraction."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import htmltext, warc

from .helpers import with_clashes

SCHEMA = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    evil = "x" + warc.record("response", {"WARC-Record-ID": "<urn:page:666>"}, b"HTTP/1.1 200 OK\r\n\r\nfake").decode() + "y"
    rows = [(1, "http://a b/\r\n", "same"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", evil), (7, "u", "é" * 900), (None, "u", "same"), (None, "u", "own"), (8, "u", "twice"), (8, "u", "twice")]
    pages = spark.createDataFrame(rows + [(100 + i, "u", f"page {i} " * 40) for i in range(40)], SCHEMA)
    folder, files = warc.write_pages(with_clashes(pages))
    assert files.count() > 3
    top = {"same": 3, "": 5}
    want = sorted((str(p), len((t or "").encode()), digest(t), *(("revisit", top[t or ""]) if (t or "") in top and p != top[t or ""] else ("response", None))) for p, _, t in (tuple(r) for r in pages.collect()))
    for size in (512, 1 << 22):
        got = warc.read_pages(folder, files, keep_payload=True, split_bytes=size).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.page_id == 6} == {evil}
    listed = warc.list_archives(spark, folder)
    assert {tuple(r) for r in listed.collect()} == {tuple(r) for r in files.collect()}
    none = warc.write_pages(pages.limit(0))
    assert warc.read_pages(*none).count() == 0
    large = warc.write_pages(pages, least_bytes=5)
    assert warc.read_pages(*large).where("record_type = 'revisit'").count() == 0


def test_unreachable_records_are_dropped(spark, tmp_path):
    good = warc.page_record(1, "u", b"a", None, "2024-01-01T00:00:00Z")
    lost = warc.page_record(2, "u", b"b", None, "2024-01-01T00:00:00Z")
    (tmp_path / "x.warc").write_bytes(good + b"garbage" + lost)
    folder = f"file://{tmp_path}"
    assert [r.page_id for r in warc.read_pages(folder, warc.list_archives(spark, folder)).collect()] == [1]


def test_long_headers_lose_nothing(spark):
    rows = [(1, "u", "a"), (2, "data:" + "x" * 300_000, "b"), (3, "u", "c"), (4, "u" * 65_600, warc.MAGIC.decode() + "k: v"), (5, "u", "e")]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    folder, files = warc.write_pages(pages)
    for size in (512, 70_000, 1 << 22):
        got = warc.read_pages(folder, files, keep_payload=True, split_bytes=size, strict=True).collect()
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows


def test_strict_reading_finds_damage(spark, tmp_path):
    one = warc.page_record(1, "u", b"a", None, "2024-01-01T00:00:00Z")
    for name, data in (("middle", one + b"garbage" + one), ("end", one + one[:-9]), ("start", b"garbage" + one)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        folder = f"file://{tmp_path}/{name}"
        for size in (100, 1 << 22):
            with pytest.raises(Exception, match="no whole record"):
                warc.read_pages(folder, warc.list_archives(spark, folder), split_bytes=size, strict=True).collect()


ARTICLE = "This is the text of an article that is long enough to be decided on, with words of the kind that every sentence has in it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more.</div>
<main><article><header><h1>Head&shy;line &amp; more</h1></header><p>{ARTICLE}<br>next   line</p><p>Short.</p><div class="ad">Buy now</div><p><b>Bold<br><p>After &lt;b&gt; 5 &#62; 3</p>
<aside>Related</aside><form><label>Name</label><input></form><ul><li><a href="x">link only</a></li><li>item text</li></ul><p hidden>hidden</p></article>
<section id="comments"><article class="comment"><p>{ARTICLE}</p></article></section></main><!-- <p>gone</p> --><footer>&copy; foot</footer></body></html>"""


def test_article():
    want = ["Head­line & more", f"{ARTICLE} next line", "Short.", "Bold", "After <b> 5 > 3", "item text"]
    assert htmltext.main_text(PAGE).split("\n") == want


def test_without_article():
    page = f"<html><body><div id='menu'><a href='/'>Home</a></div><h2>Title</h2><p>{ARTICLE}</p><p>Tiny one.</p><p>{ARTICLE}</p><p><a href='x'>More links here</a></p><div class='footer'>foot</div></body></html>"
    assert htmltext.main_text(page).split("\n") == ["Title", ARTICLE, "Tiny one.", ARTICLE]


def test_odd_pages(spark):
    cases = [(1, None, ""), (2, "", ""), (3, "plain text", "plain text"), (4, "<article><p>cut off &am", "cut off &am"), (5, "<p", ""), (6, "<article><p>a<!-- open", "a"), (7, "<script>x", ""), (8, "<article>" + "<div>" * 5000 + "deep", "deep"), (9, "<article><p>a</div></section>b &nbsp; c</p>", "a\nb c")]
    pages = spark.createDataFrame([(i, "u", h) for i, h, _ in cases] + [(None, None, "<article>x</article>")] * 2, SCHEMA)
    got = htmltext.extract_text(with_clashes(pages)).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, _, t in cases} | {None: "x"}
    assert len(got) == len(cases) + 2 and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_text(pages.where(F.lit(False))).count() == 0


def test_stray_quotes_end_only_their_attribute():
    more = " ".join(["the end of this, and of that, is not to be lost in it."] * 3)
    cases = {
        f"<article><p data-x=it's>{ARTICLE}</p><p>{more} doesn't</p></article>": [ARTICLE, f"{more} doesn't"],
        f'<article><p title="5" tall">{ARTICLE}</p><p>{more}</p></article>': [ARTICLE, more],
        f'<article><p title="open>{ARTICLE}</p><p>{more}</p></article>': [ARTICLE, more],
        f"<article><p a=b/c =d 'e' f = \"g > h\">{ARTICLE}</p></article>": [ARTICLE],
        f'<article><div class="ad" id=\'x"y\'>Buy</div><p>{ARTICLE}</p></article>': [ARTICLE],
    }
    for page, want in cases.items():
        assert htmltext.main_text(page).split("\n") == want


PROSE = {
    "en": "The house that we had seen from the road was not as old as it had been said to be, and it was for sale.",
    "fr": "La maison que nous avons vue de la route est plus grande que celle de la ville, mais elle ne se vend pas.",
    "de": "Das Haus ist nicht so alt wie die anderen in der Straße, aber es hat auch einen Garten und ist für uns.",
    "es": "La casa que está en el camino no es muy grande, pero tiene un patio y es para todos los que se quedan.",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_density_decides_without_article(lang):
    menu = "".join(f"<li><a href='/{i}'>Section {i} of the site that is in the list of all sections of it</a></li>" for i in range(4))
    codes = " ".join(f"X{i}-{i * 7}" for i in range(30))
    page = f"<body><ul>{menu}</ul><h1>Title</h1><p>{PROSE[lang]}</p><p>Short one.</p><p>{codes}</p><p>{PROSE[lang]}</p><p>{codes}</p></body>"
    assert htmltext.main_text(page).split("\n") == ["Title", PROSE[lang], "Short one.", codes, PROSE[lang]]
    blocks = htmltext.blocks_of(page)
    decided = [htmltext.first_pass(b, 70, 0.3, 0.15) for b in blocks]
    assert decided.count(True) == 2 and decided.count(False) == 4  # by stop words; by links
    assert htmltext.main_text(f"<body><p>{codes}</p><p>{codes}</p></body>") == f"{codes}\n{codes}"


def test_very_long_page(spark):
    html = "<main>" + "".join(f"<p>{ARTICLE} {i}</p><div class='ad'>Buy {i}</div>" for i in range(20_000)) + "</main>"
    got = htmltext.extract_text(spark.createDataFrame([(1, "u", html)], SCHEMA)).first()
    assert got.text == "\n".join(f"{ARTICLE} {i}" for i in range(20_000)) and got.n_chars == len(got.text)
