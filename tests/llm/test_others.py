"""Extraction, chat formatting, exact search, the pipeline and the registration."""

import hashlib
import random

import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import chat, extract, near, plans, quality, substring, topk, toxicity

PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
     "<div class=ad>Buy, now, this.</div><article><h1>Head</h1><p><b>First &amp; para,<br>with  a\nbreak.<p>Second"
     " &eacute;&#33;</article><footer>© x</footer></body></html>", "Head\nFirst & para, with a break.\nSecond é!"),
    ('<body><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, many, of them, always, here.</div>'
     '<div class="wrap has-sidebar"><div class="content"><p>One, two, three words and more of the text.</p>'
     '<form><p>Subscribe, please, now, to, this</form><ul><li>item one<li>item two</ul></div>'
     '<aside>Side, text, here</aside></div><section id=comments><p>I say, that, this, is, long, long, long</section>',
     "One, two, three words and more of the text.\nitem one\nitem two"),
    ("plain text only", "plain text only"), ("<div>just div text, ok</div>", "just div text, ok"),
    ("<p>a &lt b &nbsp; c</p><script>var x = '<p>no</p>';</script><!-- <p>no -->", "a < b c"),
    (None, ""), ("", ""), ("<nav><a href=x>menu</a></nav>", ""), ("<p" + " x" * 9, ""), ("a < b and \"c", 'a < b and "c'),
    ("<p>" + "long text, " * 20000 + "</p>", ("long text, " * 20000).strip()),
    ('<main><article><p>Text, of the article.<ul><li><a href=a>rel one</a><li><a href=b>rel two</a></ul></article></main>',
     "Text, of the article."),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_main_text(source, text):
    assert extract.main_text(source) == text


def test_extract(spark):
    rows = [(i, None if i == 3 else f"u{i}", s, "clash") for i, (s, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert extract.extract(pages).count() == len(rows)
    for i, (_, text) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"]) == (text, len(text))
    assert got[3]["url"] is None
    assert extract.extract(pages.limit(0)).count() == 0


def test_extracted_pages_hold_every_paragraph_of_the_article(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        body = re.sub(r"<!--.*?-->|</?b>", "", body, flags=re.DOTALL)
        parts = (html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"</?(?:p|h1)>", body))
        assert extract.main_text(r["html"]) == "\n".join(" ".join(p.split()) for p in parts if p.split())


def _paragraph(i: int, j: int) -> str:
    return f"Section {i}, paragraph {j}, with some words, a comma or two, and a sentence that goes on for a while."


@pytest.mark.parametrize("sizes", [(3, 3), (2, 5), (12, 1), (4, 2, 7), (1, 1, 1, 1), (9, 3, 1, 5, 2)])
@pytest.mark.parametrize("section", [
    "<div class=row><div class=col>{}</div></div>", "<div><div><div>{}</div></div></div>", "<section><div class='inner x'>{}</div></section>",
])
def test_article_over_wrapped_sections(sizes, section):
    parts = [[_paragraph(i, j) for j in range(n)] for i, n in enumerate(sizes)]
    body = "".join(section.format("".join(f"<p>{p}</p>" for p in ps)) for ps in parts)
    menu = "<div><div><a href=/a>One place, here</a> <a href=/b>Another place, there</a></div></div>"
    whole = "\n".join(p for ps in parts for p in ps)
    for page in (
        f"<body><header><p>Site, name</header><nav><ul><li><a href=/>Home</a></ul></nav><div class=page>{body}</div><footer>x</footer>",
        f"<html><body>{menu}{body}<footer>© x</footer></body></html>", body,
        f"<body><div class=outer>{menu}<div class=page>{body}</div></div><aside>Side, text, of, some, length</aside>",
    ):
        assert extract.main_text(page) == whole


def test_section_with_little_text_is_kept_beside_its_like():
    long = "".join(f"<p>{_paragraph(0, j)}</p>" for j in range(9))
    page = f"<body><div><div class='row a'><div>{long}</div></div><div class='a row'><div><p>The end.</p></div></div></div>"
    assert extract.main_text(page).splitlines()[-1] == "The end."


@pytest.mark.parametrize("wrapper", [
    "<div class='elementor-widget-container'>{}</div>", "<article class='post tag-social'>{}</article>", "<div id='share-wrapper'>{}</div>",
    "<div class=related-posts><div class=content>{}</div></div>", "<section class='comments-open'>{}</section>",
    "<div class='widget'><div class='widget-inner share'><p></p>{}</div></div>", "<div itemprop='text articleBody' class=promo>{}</div>",
    "<div class='page legal'><div class=row><div class=col>{}</div></div></div>",
])
def test_name_of_noise_does_not_drop_the_article(wrapper):
    parts = [_paragraph(1, j) for j in range(7)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    share = "<div class=share><a href=x>Share this, now</a></div>"
    extra = "<div class='cookie-notice'><p>We use cookies, many, of them, always.</p></div><div class=widget><p>Recent, posts</p></div>"
    for page in (
        wrapper.format(body), f"<body>{wrapper.format(share + body)}{extra}</body>",
        f"<body><div>Site</div>{extra}<div class=wrap>{wrapper.format(body + share)}</div><div class=footer><p>x, y</p></div></body>",
    ):
        text = extract.main_text(page).split("\n")
        assert [p for p in text if p != "Site"] == parts


def test_article_in_many_widgets():
    parts = [_paragraph(i, 0) for i in range(6)]
    body = "".join(f"<div class='elementor-widget'><div class='elementor-widget-container'><p>{p}</p></div></div>" for p in parts)
    assert extract.main_text(f"<body><div><p>Site</p></div><div class=page>{body}</div></body>").split("\n")[-6:] == parts


@pytest.mark.parametrize("noise", ["<section id=comments>{}</section>", "<ol class=commentlist><li class=comment>{}</ol>"])
def test_long_comments_are_no_article(noise):
    parts = [_paragraph(0, j) for j in range(2)]
    replies = noise.format("".join(f"<p>{_paragraph(9, j)}</p>" for j in range(60)))
    page = "<body><div class={}>" + "".join(f"<p>{p}</p>" for p in parts) + f"</div>{replies}</body>"
    for name in ("content", "elementor-widget-container"):
        assert extract.main_text(page.format(name)).split("\n") == parts


def test_a_form_around_the_whole_page():
    parts = [_paragraph(0, j) for j in range(3)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    asked = "<form action=s><label>Mail</label><input type=email><p>Subscribe, please, now</p><button>Go</button></form>"
    page = "<body><form id=aspnetForm><input type=hidden><header><p>Site</p></header><nav><a href=/>Home</a></nav><div>{}</div><footer>f, g</footer></form>"
    assert extract.main_text(page.format(body)).split("\n") == parts
    assert extract.main_text(f"<article>{body}{asked}</article>").split("\n") == parts
    assert extract.main_text(f"<body>{asked}</body>") == ""


def test_several_articles():
    parts = [[f"Head {i}", *(_paragraph(i, j) for j in range(2 + i))] for i in range(3)]
    article = lambda name, ps: f"<article{name}><h2>{ps[0]}</h2>" + "".join(f"<p>{p}</p>" for p in ps[1:]) + "</article>"
    whole = [p for ps in parts for p in ps]
    for end in ("", "<article class=teaser><p>Other, story, with text, and more text than one, or two words.</p></article>",
                "<article><a href=x>Another story, elsewhere, of some length</a></article>", article(" class=comment", parts[2])):
        page = "<body><nav><a href=/>Home</a></nav><main>" + "".join(article("", ps) for ps in parts) + end + "</main>"
        assert extract.main_text(page).split("\n") == whole


def test_text_inside_sentences_and_lists_of_links():
    first, last = _paragraph(1, 1), _paragraph(1, 2)
    page = (
        f"<article><ul><li><a href=t>Top</a></ul><p>{first}</p><p>Press <button>Save</button> to <label>go</label>, now.</p>"
        "<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> is here.</p><p><button>Share</button></p><button>Like</button>"
        f"<ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul><h2>End</h2><p>{last}</p><ul><li><a href=c>Related</a></ul></article>"
    )
    assert extract.main_text(page).split("\n") == [
        first, "Press Save to go, now.", "Energy E=m is here.", "Source one", "Source two", "End", last,
    ]


def test_nested_names_of_noise_take_no_long_time():
    import time

    before = time.process_time()
    assert extract.main_text("<div class=widget>" * 300 + "<p>text, a</p>" + "<div class=comment>a, b" * 300).startswith("text, a")
    assert time.process_time() - before < 10


def turns(seed: int = 2):
    draw = random.Random(seed)
    odd = ["\\", "<", "</turn>", "\n", "é", "漢🙂", "<turn user>", ">", "ok ", "\\<", "### Assistant:"]
    rows = []
    for conv in (1, 2, -7, None):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "a<b>\\\n", None])
            rows.append((conv, turn, role, "".join(draw.choice(odd) for _ in range(draw.randint(0, 12)))))
    rows += [(3, 0, "user", None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "user", "first")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(3000)]
    rows += [(5, 0, "assistant", "long \\< " * 50000)]
    return rows


def test_chat_round_trip(spark):
    rows = turns()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, start int")
    formatted = chat.format_turns(table)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    first = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), plain.sha(said))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), plain.sha(learnt))
        first[conv] = r["formatted_chars"]
    for conv in (1, -7, 4):
        parts = formatted.where(F.col("conv_id") == conv).orderBy("position").collect()
        whole = "".join(p["formatted"] for p in parts)
        assert len(whole) == first[conv]
        for p in parts:
            assert whole[p["start"] : p["start"] + len(p["formatted"])] == p["formatted"]
            if p["role"] == "assistant":
                assert chat.unescape(whole[p["loss_start"] : p["loss_end"]]) == chat.parse(p["formatted"])[1]
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_topk(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-0.5, -0.1, 0.0, 0.25, 0.3, 1.0]) for _ in range(6)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(300)]  # ties
    rows += [(50, [0.1] * 6), (50, [0.2] * 6), (None, [1.0] * 6), (5000, None), (5001, [None] * 6), (5050, [float("nan")] * 6)]
    rows += [(5052, [float("inf")] * 6), (5053, [9.0]), (5100, []), (100, rows[100][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    import numpy as np

    usable = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    queries: dict[int, list[int]] = {}
    for i, v in usable:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = {}
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != q)[:5]
        want[q] = [(j, -s) for s, j in scored]
    got: dict[int, list] = {}
    for r in topk.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == want
    assert topk.search(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on the one before it, against plain versions."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[number] = (before, docs)
        if number < 4:
            assert sorted(docs.columns) == sorted(columns)

    def ids(frame):
        return {r["doc_id"] for r in frame.select("doc_id").collect()}

    before, after = seen[0]
    assert ids(after) == {r["doc_id"] for r in quality.judge(before, "doc_id").where("kept").collect()}
    before, after = seen[1]
    model = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids(after) == {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
    before, after = seen[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == {name for (name, _), (_, low) in zip(rows, plain.classes(rows)) if low in (None, name)}
    before, after = seen[3]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {
        name: text if not gone else " ".join(kept)
        for (name, text), (_, gone, kept) in zip(rows, plain.without_repeats([t for _, t in rows]))
    }
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen[4]
    assert ids(after) == ids(before)
    assert after.groupBy("doc_id").agg((F.sum("length") == F.first("doc_tokens")).alias("all")).where("NOT all").count() == 0


def test_near_duplicate_stage_keeps_rows_with_odd_values(spark):
    rows = plain.odd_documents()
    docs = plain.frame(spark, rows)
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    changed = corpus_pipeline.substring_stage(spark, docs.selectExpr("doc_id", "text", "'x' lang", "'y' source", "1L n_chars"), "")
    assert changed.count() == len(rows)
    assert substring.dedupe(docs, *docs.columns).count() == len(rows)


def test_registration():
    names = [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert hashlib.sha256(plans.TRICKY.encode()).hexdigest() == plain.sha("\\### Assistant: </turn> ok")


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed long, kept_text string, label int, kept boolean, q_words string"


@pytest.mark.parametrize("rows", [[], plain.odd_documents()])
@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_clashing_columns(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7.0, 5, "k", 3, True, "q") for i, t in rows], CLASH).repartition(2)
    got = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) <= len(rows)
    assert all((r.score, r.n_removed, r.kept_text, r.label, r.kept, r.q_words) == (7.0, 5, "k", 3, True, "q") for r in kept)
    assert {(r.doc_id) for r in kept} <= {i for i, _ in rows}
