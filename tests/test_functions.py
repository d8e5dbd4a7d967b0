"""Column functions on small literal inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunks as C, features as X, html as H, keys as K, prose as P, text as T, urls as U


def test_identity_and_casefold(one):
    assert one(T.identity_text("a"), "a string", "Béla: Cross-Cut ﬁlm 2") == "belacrosscutfilm2"
    assert one(T.normalize_casefold("a"), "a string", "Straße!") == "strasse"
    assert one(T.identity_text("a"), "a string", "Straße!") == "straße"


def test_person_and_title_keys(one):
    assert one(T.person_key("a"), "a string", "Wong Kar-wai") == one(T.person_key("a"), "a string", "kar wai WONG")
    assert one(T.title_key("a"), "a string", "The  Blue Orchard") == "blueorchard"
    assert one(T.credit_names("a"), "a string", "A. One & B. Two and C Three; D, ") == ["A. One", "B. Two", "C Three", "D"]


def test_search_terms(one):
    got = one(T.search_terms("a"), "a string", "The FILM about Ｌight, light and no 한국어 프랑스")
    assert got == ["light", "프랑스"]
    assert one(T.search_norm("a"), "a string", "Cross-Cut: É 1 + 1") == "crosscute1+1"


def test_normalize_quote(one):
    got = one(T.normalize_quote("a"), "a string", "a “well-\nknown”  ‘film’­ — yes")
    assert got == "a \"wellknown\" 'film' - yes"


def test_dates_and_words(one):
    for value, good in [("2024", True), ("2024-02", True), ("2024-02-30", False), ("2024-02-29T10:00:00Z", True), ("soon", False)]:
        assert one(T.valid_iso("a"), "a string", value) is good
    assert one(T.partial_date("a"), "a string", "May 2024") is None
    assert one(T.date_precision("a"), "a string", "2024-05") == "month"
    assert one(T.trim_words("a", 2), "a string", " one  two three ") == "one two"


def test_bounded_text_keeps_both_ends(one):
    text = "a" * 18_000 + "b" * 1_000 + "c" * 6_000
    assert one(T.bounded_text("a"), "a string", text) == "a" * 18_000 + "\n\n[... middle omitted ...]\n\n" + "c" * 6_000


def test_plot_excerpt(one):
    page = "Intro.\n== Plot ==\nFirst [1] part\nof it.\n\nSecond.\n== Cast ==\nNames"
    assert one(T.plot_excerpt("a"), "a string", page) == "First part of it."
    long = "== 줄거리 ==\n" + "Word here. " * 200
    got = one(T.plot_excerpt("a"), "a string", long)
    assert got.endswith("here.…") and len(got) <= 1001
    assert one(T.plot_excerpt("a"), "a string", "No sections") == ""


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("https://Www.Site.org/a/b/?utm_source=x&b=2&a=1#frag", "https://www.site.org/a/b?a=1&b=2"),
        ("https://site.org", "https://site.org/"),
        ("https://site.org:443/x", "https://site.org/x"),
        ("https://site.org/x?q", "https://site.org/x?q="),
        ("http://site.org/x", None),
        ("https://user@site.org/x", None),
        ("https://site.org:8443/x", None),
        ("https://127.0.0.1/x", None),
        ("https://[::1]/x", None),
        ("https://localhost/x", None),
        ("https://a.internal/x", None),
        ("https://a.example/x", None),
        ("not a url", None),
    ],
)
def test_canonical_url(one, raw, expected):
    assert one(U.canonical_url("a"), "a string", raw) == expected


def test_other_url_forms(one):
    assert one(U.published_url("a"), "a string", "HTTP://Site.org/x/?b=2&fbclid=1&a=1#f") == "http://site.org/x?b=2&a=1"
    assert one(U.poster_url("a"), "a string", "https://image.tmdb.org/t/p.jpg") == "https://image.tmdb.org/t/p.jpg"
    assert one(U.poster_url("a"), "a string", "https://evil.org/p.jpg") == ""
    assert one(U.poster_url("a"), "a string", "/posters/../x") == ""
    assert one(U.https_url("a"), "a string", "http://a.org/x") == "https://a.org/x"
    assert one(U.slug("a"), "a string", "Crème Brûlée!") == "cre-me-bru-le-e"


def test_hashes(one):
    record = {"b": 1, "a": "é", "checkedAt": "2024"}
    expected = hashlib.sha256(K.canonical_json({"b": 1, "a": "é"}).encode()).hexdigest()
    assert one(K.record_hash("a"), "a string", json.dumps(record)) == expected
    assert one(K.record_hash("a"), "a string", "{broken") is None
    assert one(K.text_hash("a"), "a string", 'q"é\n') == hashlib.sha256(K.canonical_json('q"é\n').encode()).hexdigest()
    film = "film-" + hashlib.sha256(K.canonical_json(["amber", 1980, "maralinden"]).encode()).hexdigest()[:24]
    assert one(K.entity_key("a", F.lit(1980), F.lit("Mara Linden")), "a string", "Amber!") == film


CLEAN = "Two films share a patient, unhurried look at work."


@pytest.mark.parametrize(
    "tail",
    ['", "sourceIds": ["s1"]}', '"},{"anchorId": 3}', '", \\"watchFor\\": []', '"]}]}', "”, “whyKo”：”x”", '\\n], "sources": [1]'],
)
def test_clean_prose_cuts_tails(tail):
    once = P.clean(CLEAN + tail)
    assert once == CLEAN and P.clean(once) == once


def test_clean_prose_leaves_quotations():
    for text in ["She says “look again” twice.", 'A "quoted" word', "It's ’90s cinema [sic] (1999)."]:
        assert P.artefact_at(text) == -1 and P.clean(text) == text
    assert P.clean('{"sources": []}') == "" and P.clean("```json\n[1]\n```") == ""


def test_page_text():
    html = (
        "<html><head><title>x</title></head><body><nav>menu</nav><p>A film &amp; its <b>audience</b>.<p>Next   paragraph."
        "<div hidden>secret</div><script>var p='</p>'</script><a href='#more'>Read</a><div id='more' hidden>Transcript</div></body>"
    )
    assert H.page_text(html) == "A film & its audience.\n\nNext paragraph.\nRead\nTranscript"
    assert H.page_text("<p hidden id=a>x</p>", "a") == "x"


def test_links(one):
    html = '<a href="/b">x</a><a href="https://o.org/z#f">y</a><a href="/b">again</a><link href="c d">'
    got = one(H.extract_links("a", F.lit("https://s.org/x/y")), "a string", html)
    assert got == ["https://s.org/b", "https://o.org/z#f", "https://s.org/x/c%20d"]


def test_chunks():
    text = "x" * 4_202
    bounds = C.chunk_bounds(text, 2_500, 200)
    assert bounds == [(0, 2500), (2300, 4202)]
    broken = "a" * 1_800 + "\n\n" + "b" * 3_000
    assert C.chunk_bounds(broken, 2_000, 100)[0] == (0, 1800)
    for value in [text, broken, "short", ""]:
        covered = set()
        for start, stop in C.chunk_bounds(value, 2_000, 1_999):
            covered |= set(range(start, stop))
        assert covered == set(range(len(value)))
    with pytest.raises(ValueError):
        C.chunks("a", 1_000, 0)


def test_features_and_fnv(one):
    got = one(X.features("a"), "a string", "Ab cd")
    assert got == ["w:ab", "w:cd", "b:ab_cd", "c:ab ", "c:b c", "c: cd"]

    def fnv(value, seed):
        for at in range(0, len(value.encode("utf-16-le")), 2):
            unit = int.from_bytes(value.encode("utf-16-le")[at : at + 2], "little")
            seed = ((seed ^ unit) * 16777619) & 0xFFFFFFFF
        return seed

    for value in ["", "w:ab", "프랑스", "a😀"]:
        assert one(X.fnv1a("a", F.lit(X.BUCKET_SEED)), "a string", value) == fnv(value, X.BUCKET_SEED)


def test_language_and_overview(one):
    assert one(T.pick_language(F.lit("ko"), "a", F.lit("en")), "a string", "케이") == "케이"
    assert one(T.pick_language(F.lit("ko"), "a", F.lit("en")), "a string", "") == "en"
    assert len(one(T.overview_share(["a"], F.lit(8)), "a string", "x" * 900)) == 187
    assert len(one(T.overview_share(["a"], F.lit(2)), "a string", "x" * 900)) == 300
