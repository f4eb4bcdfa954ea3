"""op1 HTML extraction, op2 secret scans, op7 quality rules."""

import base64
import random
import re

import pytest
from helpers import SF, documents, quality, rows_of, sha

from tidepool.llm import op01_html, op02_secrets, op07_quality


# ---------------------------------------------------------------- op1
@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<script>x</script><style>y</style>", ""), ("<p>short", "short"),
    ("<div id=sidebar>x</div><article>A<aside>no<p>no2</aside><p>B &amp;lt; c<p>D</article><footer>f", "A\n\nB &lt; c\n\nD"),
    ("<article><form>x<p>y</form>body 1 < 2 and <b>bold</b>text<br>more\n\t x&nbsp;y</article>", "body 1 < 2 and boldtext more x y"),
    ("<article><p>a<script>if(a<b)'</p>'</script>b</article>", "ab"),
    ("<article><h1>T</h1><p><b>One.<br><p>Two.</p></article><div class='comments'><article class=comment>nice</article></div>", "T\n\nOne.\n\nTwo."),
    ("<nav><a href='/'>m</a></nav><div class='content'><p>" + "long text " * 20 + "<p>tail</div><div class=\"user-comments\"><p>nice!</div><div>(c) me</div>",
     ("long text " * 20).strip() + "\n\ntail\n\n(c) me"),
    ("<main><p>" + "x" * 200 + "</main><div><p>" + "y" * 300 + "</div>", "x" * 200),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes</p>", "yes"),
    ("<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>" + "word " * 30 + "</p>", ("word " * 30).strip()),
])
def test_main_text(html, text):
    assert op01_html.main_text(html) == text


BODY = "The article goes on for a while, in whole sentences and without links. " * 5


@pytest.mark.parametrize("html", [
    *(f"<div class='{c}'><article><p>{BODY}</article></div>" for c in ("content has-sidebar", "no-sidebar", "menu-open", "category-social", "post tag-notice", "sidebar")),
    f"<div class=promo><p>{BODY}<div class=menu>Home</div></div><p>end",
    f"<td class='tags'><main><p>{BODY}</main></td>",
    f"<article><div class='widget'><p>{BODY}</div></article>",
    f"<p data-title='the hidden cost' title=\"a class=menu\">{BODY}",
    f"<article>{BODY}</article><div class=related><article>Read this, too.</article></div><div class='sidebar-1'>{BODY}</div>",
])
def test_class_names_leave_the_article(html):
    text = op01_html.main_text(html)
    assert text.split("\n\n")[0] == BODY.strip() and "Home" not in text and "Read" not in text


@pytest.mark.parametrize("icon", ["<svg/>", "<svg class='i' viewBox=\"0 0 1 1\"/>", "<svg width=1 focusable/>", "<MATH />", "<svg width=1/>x</svg>", "<svg><path d=''/>x</svg>"])
def test_self_closed_icons_end_at_once(icon):
    assert op01_html.main_text(f"<article><p>{icon}{BODY}<p>{BODY}</article>") == f"{BODY.strip()}\n\n{BODY.strip()}"


def test_pages_keep_their_article_and_extra_columns(spark):
    pages = rows_of("pages", "page_id", "url", "html")
    df = spark.createDataFrame([(*p, "mine", 7) for p in pages] + [(pages[0][0], None, None, "again", 8)], "page_id long, url string, html string, text string, rows int")
    got = op01_html.extracted(df, out="body").collect()
    assert len(got) == len(pages) + 1 and {r["text"] for r in got} == {"mine", "again"}
    by_id = {(r["page_id"], r["rows"]): r["body"] for r in got}
    assert by_id[pages[0][0], 8] == ""
    from html import unescape
    for i, _, html in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert by_id[i, 7] == "\n\n".join(filter(None, blocks))
    assert op01_html.extracted(df.limit(0)).count() == 0
    assert op01_html.op1_html_text(spark, SF).filter("n_chars != length(text)").count() == 0


def test_link_paragraphs_between_prose_stay():
    link = "<p><a href=x>All of this one paragraph is a link</a>"
    assert op01_html.main_text(f"<p>{BODY}{link}<p>{BODY}{link}") == f"{BODY.strip()}\n\nAll of this one paragraph is a link\n\n{BODY.strip()}"


@pytest.mark.parametrize("html,text", [
    (f'<p>{BODY}<a href="x title=y>here</a> it goes <a href="z">on</a>.', f"{BODY}here it goes on."),
    (f"<p title='it>{BODY}", BODY.strip()), (f'<p title="a > b" id=x>{BODY}', BODY.strip()), (f"<p>{BODY}<a b", f"{BODY}<a b"),
    (f"<!--><p>{BODY}<!---><!-- x --><! y><?z>", BODY.strip()), (f"<p>{BODY}<!-- open", BODY.strip()), (f"<p title = 'a>b' x='' y=\"\"/>{BODY}", BODY.strip()),
])
def test_broken_tags(html, text):
    assert op01_html.main_text(html) == text


@pytest.mark.parametrize("unit,after", [
    ("<a ", ""), ("<div>", "</x>"), ("<b>", "<p></b>"), ("<p><table>", "<h1>"), ("<a b=\"", "'>"), ("<!", ""), ("<script>", ""), ("<a b='x' ", "<"),
    ("<ul><li>", "<p></ul>"), ("<i class=menu>", "</i>"), ("word <p>", ""), ("&amp", ";"),
])
def test_long_pages_of_broken_markup_take_linear_time(unit, after):
    import time

    def seconds(n):
        begin = time.process_time()
        op01_html.main_text(unit * n + after * n)
        return time.process_time() - begin

    seconds(100)
    assert seconds(40000) < 8  # quadratic: minutes


def test_main_lines_equal_the_definition():
    rng = random.Random(9)
    for _ in range(500):
        lines = []
        for _ in range(rng.randint(0, 14)):
            text = "x" * rng.choice([1, 5, 30, 60, 200])
            lines.append((text + str(len(lines)), rng.random() < 0.3, False, rng.choice([0, 0, len(text) + 3])))
        value = [0 if boiler or links > len(t) / 2 else len(t) for t, boiler, _, links in lines]
        window = [sum(value[k : k + 3]) for k in range(len(lines))]
        surge = min(86, max(window, default=0))

        def stretch(k):  # the lines around k without a window of 0
            a = b = k
            while a and window[a - 1]:
                a -= 1
            while b + 1 < len(lines) and window[b + 1]:
                b += 1
            return range(a, b + 1)

        expect = []
        for k, (text, boiler, _, _) in enumerate(lines):
            if not window[k] or boiler or max(window[j] for j in stretch(k)) < surge:
                continue
            before = any(value[j] for j in stretch(k) if j < k)
            after = any(value[j] for j in stretch(k) if j > k)
            if value[k] or before and after:
                expect.append(text)
        assert op01_html.main_lines(lines) == expect


# ---------------------------------------------------------------- op2
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


EDGES = [None, "", "token: secret: abcdefgh", "tokén=password='aaaaaa' é AKIA" + "A" * 16 + " " + "f" * 24, "API_KEY  =  'abc' apikey:\"abcdef\"",
         "password=" + "a" * 5, "퟿😀 secret=abc.def/ghi", "AKIAAKIA" + "B" * 12, "token=token=token=" * 300, "f" * 5000, "secret\n= abcdefg"]


def test_base_spans_equal_brute_force(spark):
    docs = documents() + [(10_000 + k, t) for k, t in enumerate(EDGES)] + [(10_003, EDGES[3])]
    got = op02_secrets.scanned(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")).collect()
    assert len(got) == len(docs)
    want = dict(docs)
    for r in got:
        own = [(s["start"], s["ord"], s["end"], s["kind"]) for s in r["spans"] if s["kind"] != "random"]
        assert own == base_spans(want[r["doc_id"]]), r["doc_id"]


def test_battery_finds_random_strings_and_leaves_names_alone(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        rows.append((i, "see " + base64.b64encode(rnd.randbytes(30)).decode() + " end"))
        rows.append((1000 + i, "k " + base64.b32encode(rnd.randbytes(40)).decode()))
        rows.append((2000 + i, f"CamelCaseIdentifierNumber{i}WithLongNameAndMore /usr/local/lib/python3/site-packages/module{i} internationalization_configuration_path"))
        rows.append((3000 + i, "0123456789" * 4 + " " + "AB12" * 10))
    found = {r["doc_id"] for r in op02_secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if any(s["kind"] == "random" for s in r["spans"])}
    by_kind = [sum(1 for d in found if d // 1000 == k) for k in range(4)]
    assert by_kind[0] >= 140 and by_kind[1] >= 120 and by_kind[2] == 0 and by_kind[3] == 0


def test_battery_finds_keys_in_one_case_and_uuids(spark):
    rnd = random.Random(11)
    some = lambda letters, n: "".join(rnd.choices(letters, k=n))
    digits, hexes, az = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    kinds = [
        lambda: some(az + digits, 30), lambda: some((az + digits).upper(), 30), lambda: some(az + "234567", 40), lambda: some(hexes, 22),
        lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: some(az + az.upper() + digits, 24),
    ]
    rows = [(1000 * k + i, f"key {f()} end") for k, f in enumerate(kinds) for i in range(150)]
    rows += [(100_000 + i, f"how-to-use-secondhand-bicycles-{i} internationalizationhandbook{2000 + i}v2 CONFIGURATIONOVERVIEWPAGE{i}") for i in range(2000)]
    found = [r["doc_id"] // 1000 for r in op02_secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if any(s["kind"] == "random" for s in r["spans"])]
    assert all(found.count(k) >= 50 for k in range(len(kinds))), [found.count(k) for k in range(len(kinds))]
    assert max(found) < 100


def test_secret_query_and_empty_table(spark):
    rows = op02_secrets.op2_secret_scan(spark, SF).collect()
    want = dict(documents())
    for r in rows:
        own = base_spans(want[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in own) for k in range(3))
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in own))
    assert op02_secrets.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- op7
def test_base_figures_equal_brute_force(spark):
    edges = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 50, "l\n\nl\nl x", "é  ß\x0bq\r\nq", "w" * 50_000, "one two\n" * 400]
    docs = documents() + [(10_000 + k, t) for k, t in enumerate(edges)] + [(10_000, None)]
    got = op07_quality.judged(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")).collect()
    want = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == quality(want[r["doc_id"]])
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])


def test_lines_are_judged_before_documents(spark):
    prose = "This is a plain sentence about nothing in particular, and it goes on a little."
    other = "Another line follows here; it says something else entirely, without any repetition at all."
    rows = [
        (1, prose + "\n" + other),
        (2, "Home | News | Sport | Contact\n" + prose + " " + other),
        (3, "\n".join(["Home", "Menu", "Login", "We use cookies to make this better for you and us."] * 3) + "\nreal words here"),
        (4, prose + "\n----------\n" + other + "\nAll rights reserved."),
        (5, " ".join("word%d###$$$" % i for i in range(40))),
        (6, " | ".join("entry%d" % i for i in range(100))),
        (7, prose + " One | two. " + other),
    ]
    got = {r["doc_id"]: r["quality"] for r in op07_quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == rows[0][1] and got[1]["n_bad_lines"] == 0
    assert got[2]["kept"] and not got[2]["cleaned"].startswith("Home")
    assert not got[3]["kept"] and not got[5]["kept"] and not got[6]["kept"]
    assert got[7]["kept"] and got[7]["n_bad_lines"] == 0
    assert got[4]["kept"] and got[4]["n_bad_lines"] == 2 and "reserved" not in got[4]["cleaned"]


def test_quality_is_native_and_takes_empty_tables(spark):
    plan = op07_quality.op7_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert op07_quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
