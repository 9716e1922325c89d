import random
import re

import pytest

import brute
from tidepanel.llm import licenses, pii
from tidepanel.llm.decontaminate import contamination
from tidepanel.llm.html_text import extract_text, main_text
from tidepanel.llm.language import identify, learn
from tidepanel.llm.licenses import license_scan
from tidepanel.llm.queries import QUERIES


def _hits(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) for r in found.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_contamination_matches_brute_force(spark, make_docs, block_bytes):
    r = random.Random(4)
    word = [f"q{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(word) for _ in range(r.randint(3, 30)))) for k in range(12)] + [(50, None), (51, "!! ??"), (52, "solo")]
    rows = [(k, ", ".join(["Pad"] * r.randint(0, 60) + (items[k % 12][1].upper().split()[r.randint(0, 3):] if k % 2 else ["q1", "Q2"])))
            for k in range(40)] + [(90, None), (91, ""), (92, "…—"), (93, "é solo"), (94, "so_lo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _hits(contamination(make_docs(rows), bench, block_bytes=block_bytes)) == brute.contamination(rows, items)


def test_contamination_spans_are_bytes_of_the_original(spark, make_docs):
    bench = spark.createDataFrame([("a", "One two three")], "item_id string, text string")
    text = "é: ONE--two  Three! one two"
    row = contamination(make_docs([(1, text)]), bench).first()
    assert [text.encode()[s.start:s.end].decode() for s in row.spans] == ["ONE--two  Three"]
    assert contamination(make_docs([(1, text)]).limit(0), bench).collect() == []
    assert [r.n_hit for r in contamination(make_docs([(1, text)]), bench.limit(0)).collect()] == [0]


def test_language_on_held_out_rows(spark, folder):
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_odd_texts(make_docs):
    english, german = "the house and the garden with this thing ", "und der garten mit dem haus ist nicht schön "
    model = learn(make_docs([(1, english * 9), (2, german * 9), (3, None), (4, "skip")], ["en", "de", "en", None]), "text", "lang")
    assert model.languages == ["de", "en"]
    rows = [(1, english), (2, german.upper()), (3, english * 30 + german * 10), (4, None), (5, ""), (6, "12 !?"), (7, "ü")]
    got = {r.doc_id: r for r in identify(make_docs(rows), model, keep=["doc_id"]).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("en", "de", "en")
    assert 0.6 < got[3].shares["en"] < 0.9 and abs(sum(got[3].shares.values()) - 1) < 1e-6 and len(got[1].shares) == 1
    assert [got[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3 and got[7].lang_pred in ("de", "en")
    assert identify(make_docs(rows).limit(0), model, keep=["doc_id"]).collect() == []
    none = learn(make_docs(rows).limit(0), "text", "lang")
    assert {r.lang_pred for r in identify(make_docs(rows), none, keep=["doc_id"]).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this long notice as long as any paragraph of the article would be.</div>
<!-- <p>gone</p> -->%s<aside><p>Read this other story of ours, it is long enough to look like text of an article.</p></aside>
<div id="comments"><p>I think that this comment is as long as a paragraph of the article above it, if not longer.</p></div>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""
BODY = ("<h1>Title &amp; more</h1><p>First  paragraph\n with <b>bold</b> text&nbsp;and &lt;signs&gt; that is long enough to be seen.<p>Ok."
        "<p>Second paragraph that is again long enough to be a part of the article, with <a href=x>a link</a> in it.</p>")
TEXT = ("Title & more\n\nFirst paragraph with bold text and <signs> that is long enough to be seen.\n\nOk.\n\n"
        "Second paragraph that is again long enough to be a part of the article, with a link in it.")


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=story>%s</div>", "%s"])
def test_main_text_of_a_page(wrap):
    assert main_text(PAGE % (wrap % BODY)) == TEXT


def test_main_text_of_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<html><nav>x</nav></html>") == ""
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<article><p>short<p>a < b</article>") == "short\n\na < b"
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x</p>", 6), (2, "u", "<p>x</p>", 7)],
                                  "page_id long, url string, html string, text long")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_text(pages).collect())
    assert got == [(0, "u", "x", 1), (1, None, "", 0), (2, "u", "x", 1)]
    assert extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, text", [
    ("<html><head><meta charset=x><title>T</title><link href=y><body><p>A</p><p>B</p>", "A\n\nB"),
    ("<head><title>T</title><style>p{}</style><div>A</div>", "A"), ("<head><script>x</script>A<p>B", "A\n\nB"),
    ('<article><p>A<svg class="i"/>B</p><p>C</p></article>', "A B\n\nC"),
    ("<article><p>A<svg><title/><style/><path d=x /></svg>B</p><p>C</p></article>", "A B\n\nC"),
    ("<article><p>A <button>x</p><p>B</p><p><button>y</button>C</p></article>", "A\n\nB\n\nC"),
    ("<article><p>A</p><div><svg><path></div><p>B</p><svg><g><svg></svg>x</g></svg><p>C</p></article>", "A\n\nB\n\nC"),
    ("<article><p>A</p><noscript></article><p>x</noscript><template><div></template><p>B</p></article>", "A\n\nB"),
    ("<article><p>A</p><script>x</article><p>B", "A"),
    ('<main><article class="post category-social tag-promotion"><p>A</p><article class="comment"><p>B</p></article></article></main>', "A"),
])
def test_elements_without_end_and_class_names_of_articles(page, text):
    assert main_text(page) == text


STORY = "Word after word makes a story that goes on for long enough to be seen by each of its readers."


@pytest.mark.parametrize("page, text", [
    (f'<article><p>{STORY}</p><h2 id="related-work">Related work</h2><section id="discussion"><h2>Discussion</h2><p>Yes.</p></section>'
     f'<div class="side-effects"><p>Few.</p></div><div class="related-posts"><p>{STORY}</p></div>'
     f'<section class="comments"><p>{STORY}</p></section></article>', [STORY, "Related work", "Discussion", "Yes.", "Few."]),
    (f'<body><article class="teaser"><p>Short teaser</p></article><div class="story"><h1>T</h1><p>{STORY * 3}</p><p>End</p></div>',
     ["T", STORY * 3, "End"]),
    (f'<body><article><p>Short card</p></article><div class="story"><h1>T</h1><p>{STORY * 3}</p><p>End</p></div>', ["T", STORY * 3, "End"]),
    (f'<article class="post"><p>A</p><p>{STORY}</p></article><article class="post related"><p>{STORY}</p></article>', ["A", STORY]),
    (f"<article><h2>A</h2><p>{STORY}</p></article><article><h2>B</h2><p>{STORY}</p></article>", ["A", STORY, "B", STORY]),
    (f"<article></article><div><p>A</p><p>{STORY}</p><p>B</p></div><div>Made by us</div>", ["A", STORY, "B"]),
    (f"<div><h1>T</h1><div><p>{STORY}</p><p>x</p></div><div class=comments><p>{STORY}</p></div></div>", ["T", STORY, "x"]),
    (f"<div><div><p>{STORY * 2}</p></div><div><p>{STORY}</p><p>x</p></div></div>", [STORY * 2, STORY, "x"]),
    (f'<div class="sidebar"><p>{STORY}</p></div><div class="search"><p>{STORY * 9}</p></div>', [STORY * 9]),
    ("<div>" * 3000 + f"<p>{STORY}</p>" + "</div>" * 3000, [STORY]),
])
def test_blocks_of_pages_without_with_empty_and_with_several_articles(page, text):
    assert main_text(page) == "\n\n".join(text)


def test_most_pages_keep_their_text_without_names_of_parts(spark, folder):
    pages = [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect()]
    right = 0
    for page in pages:
        neutral = re.sub(r"<(/?)(?:nav|article|footer|aside|header|main|form)\b", r"<\1div", page)
        right += main_text(re.sub(r'\b(class|id)="[^"]*"', 'class="x"', neutral)) == main_text(page)
    assert 10 * right >= 9 * len(pages)


def test_pages_keep_their_articles(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op2_html_extraction"](spark, folder).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        plain = re.sub(r"<[^>]*>", " ", article)
        import html
        assert html.unescape(plain).split() == r.text.split(), r.page_id


def _words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def test_license_scan_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = set()
    for row in docs.collect():
        w = _words(row.text)
        held = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for name, text in licenses.TEMPLATES.items():
            t = _words(text)
            own = {tuple(t[k:k + 5]) for k in range(len(t) - 4)}
            if 100 * len(held & own) >= 75 * len(own):
                want.add((row.doc_id, name))
    got = {(r.doc_id, r.license) for r in QUERIES["op7_license_scan"](spark, folder).collect()}
    assert want and got == want


def test_license_scan_of_edited_and_odd_texts(spark, make_docs):
    mit = licenses.TEMPLATES["MIT"]
    broken = mit.replace("free of charge", "at no cost").replace("persons", "people")
    rows = [(1, "x y z " * 200 + mit.upper() + " tail" * 300), (2, broken), (3, mit[:150]), (4, None), (5, ""), (6, "Released under the MIT License."),
            (7, "under the MIT"), (None, mit), (1, "x y z " * 200 + mit.upper() + " tail" * 300)]
    got = sorted((r.doc_id, r.license, r.containment == 1.0) for r in license_scan(make_docs(rows)).collect())
    assert got == [(1, "MIT", True), (2, "MIT", False), (6, "MIT-line", True)]
    assert license_scan(make_docs(rows).limit(0)).collect() == [] and license_scan(make_docs(rows), templates={}).collect() == []
    plan = license_scan(make_docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_neighbouring_licenses_are_told_apart(spark, make_docs):
    known = licenses.TEMPLATES | licenses.NEIGHBOURS
    names = sorted(known)
    pad = "".join(f"w{k} " for k in range(60))
    rows = [(k, f"{pad}{known[n]} {pad}") for k, n in enumerate(names)]
    both = ["GPL-3.0-or-later", "LGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-line", "GPL-3.0-line"]
    rows.append((1000, pad.join(known[n] for n in both)))
    got = {}
    for r in license_scan(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {k: got.get(k) for k in range(len(names))} == {k: [n] for k, n in enumerate(names)}
    assert sorted(got[1000]) == sorted(both)


def test_surrogates_are_distinct_typed_and_the_same_everywhere():
    s, r = pii.Surrogates("k"), random.Random(1)
    emails = {f"{r.choice('abcdefgh')}{k}@mail{k % 7}.example.com" for k in range(500)}
    cards = {"".join(r.choice("0123456789") for _ in range(16)) for _ in range(500)}
    phones = {f"+1 ({r.randrange(1000):03d}) 555-{r.randrange(10000):04d}" for _ in range(500)}
    hosts = {f"{r.randrange(1, 224)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(500)}
    for kind, values in (("email", emails), ("card", cards), ("phone", phones), ("ip", hosts)):
        new = {v: s.replace(kind, v) for v in values}
        assert len(set(new.values())) == len(values) and all(a != b for a, b in new.items())
        assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in new.items()) or kind in ("email", "ip")
        assert new == {v: pii.Surrogates("k").replace(kind, v) for v in values}
        assert sum(pii.Surrogates("other").replace(kind, v) == new[v] for v in values) < 5
    assert pii._luhn("7992739871") == 3
    good = s.card("4111 1111 1111 1111")
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", good) and pii._luhn(good.replace(" ", "")[:-1]) == int(good[-1])
    assert s.phone("+1 (017) 555-7713")[2:] == " (" + s.phone("017-555-7713")[:3] + ") " + s.phone("017-555-7713")[4:]
    assert s.ip("10.1.2.3").startswith("10.") or s.ip("10.1.2.3").startswith(("172.", "192.168."))
    names = {n: s.person(n) for v in pii.GIVEN.values() for n in v}
    for key, pool in pii.GIVEN.items():
        assert sorted(names[n] for n in pool) == sorted(pool), key
    made = {s.person(a + b + c) for a in "BDFG" for b in "aeiou" for c in "lmnr"}
    assert len(made) == 80 and not made & {n.capitalize() for n in pii._KNOWN}
    assert s.person("JOHN SMITH") == s.person("John Smith").upper()


def test_formats_that_are_found():
    triggers = pii._triggers()
    for kind, text in (
        ("phone", "555-123-4567"), ("phone", "(555) 123-4567"), ("phone", "+44 20 7946 0958"), ("phone", "+49 151 23456789"),
        ("phone", "+15551234567"), ("phone", "01 23 45 67 89"), ("card", "3782 822463 10005"), ("card", "4111-1111-1111-1111"),
        ("ip6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ssn", "123-45-6789"), ("iban", "DE89370400440532013000"),
        ("email", "a+b@x-y.co.uk"), ("ip", "8.8.8.8"), ("person", "Anna Schmidt"),
    ):
        for around in ("see {} now", "{}", "({}),", "{}!!", "{}***\nx"):
            line = around.format(text)
            assert [(k, line[a:b]) for a, b, k in pii.entities(line, triggers)] == [(kind, text)], (kind, line)
        new = pii.Surrogates().replace(kind, text)
        assert new != text and [k for _, _, k in pii.entities(new, triggers)][:1] in ([kind], []), new
    for clean in ("in 1999-2020 and 12:30:45", "v1.2.3", "12345678 of 9.5", "pages 10-20, 3.14159", "2024-01-31 10:00", "I am 25."):
        assert pii.entities(clean, triggers) == [], clean


def test_names_are_replaced_wherever_they_stand_again(make_docs):
    text = "Smith was out. Mr. John Smith called.\nSmith said that O'Neil and SMITH, not Smithson, met Anna O'Neil; Neil's note: smith@mail.example.org"
    row = pii.replace_personal_data(make_docs([(1, text), (2, "Smith alone")]), keep=["doc_id"]).orderBy("doc_id").collect()
    s = pii.Surrogates()
    john, smith, anna, neil = s.word("John"), s.word("Smith"), s.word("Anna"), s.word("O'Neil")
    mail = s.email("smith@mail.example.org")
    assert row[0].text == (f"{smith} was out. Mr. {john} {smith} called.\n{smith} said that {neil} and {smith.upper()}, not Smithson, "
                           f"met {anna} {neil}; {s.word('Neil')}'s note: {mail}")
    assert row[1].text == "Smith alone"


def test_secrets_are_found_by_part_of_their_name():
    triggers, value = pii._triggers(), "9fK3xQ7zLm20"
    for line in ("access_token={}", "client_secret: {}", "db_password={}", "aws_secret_access_key={}", '{{"token": "{}"}}', "'api_key': '{}'",
                 "accessToken={}", "passwords: {}", "API_KEY_PROD = {}", "x-auth-token: {}", "a.token={}", "my secret2:{}"):
        text = line.format(value)
        assert [(k, text[a:b]) for a, b, k in pii.entities(text, triggers)] == [("secret", value)], line
    for line in ("secretary: Katharina", "tokenizer: sentencepiece", "token of gratitude"):
        assert pii.entities(line, triggers) == [], line
    assert len(pii.entities("token" * 100_000 + ": x", triggers)) == 0


def test_permutation_is_one():
    for n in (2, 3, 10, 26, 100, 1000):
        p = pii.Permutation("k", "x", n)
        assert sorted(p.next(x) for x in range(n)) == list(range(n)) and all(p.next(x) != x for x in range(n))


def test_replacement_keeps_everything_else(make_docs):
    text = "Mail a.b@c.example.org or +1 (017) 555-7713, Mr. John Smith.\nVersion 1.2.3 of 1999-2020, token = \"0123456789abcdef\" é"
    rows = [(1, text), (2, None), (3, ""), (4, "Nothing here, 12 of 345."), (None, text), (1, text)]
    got = pii.replace_personal_data(make_docs(rows), keep=["doc_id", "n", "k0"]).collect()
    assert len(got) == 6 and {r.n for r in got} == {"x"}
    by = {r.doc_id: r for r in got}
    assert by[2].text is None and by[3].text == "" and by[4].text == rows[3][1] and by[None].text == by[1].text
    at, out = 0, ""
    for e in by[1].entities:
        out += text[at:e.start] + e.surrogate
        at = e.end
    assert out + text[at:] == by[1].text and [e.kind for e in by[1].entities] == ["email", "phone", "person", "secret"]
    assert pii.surrogate_collisions(make_docs(rows)).collect() == []
    assert pii.replace_personal_data(make_docs(rows).limit(0), keep=["doc_id"]).collect() == []


def test_no_entity_of_the_documents_is_left(spark, folder):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    triggers, seen = pii._triggers(), 0
    for r in QUERIES["op8_pii_surrogates"](spark, folder).collect():
        for a, b, _ in pii.entities(before[r.doc_id], triggers):
            seen += 1
            assert before[r.doc_id][a:b] not in r.text
    assert seen > 5
