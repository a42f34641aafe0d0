"""URL filters, quality rules, licence scans, decontamination and HTML extraction against plain versions and defined edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quaymark.llm import decontamination, html_text, license_scans, quality_rules, queries, url_filters
from quaymark.llm.common import table

SF = "/root/testdata/sf0.001"


# URL filters
def best_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (r.host.count("."), len(r.path), not r.allow), default=None)


URLS = ["https://A.Example.org/es/x?q#f", "http://example.org/en/12", "example.org/es/", "", None, "ftp://com", "x://org", "x://org/", "https://notexample.org/es/", "http://u.com/fr", "http://u.com/fr/?", "http://u.com:80/fr/", "a://b://c/d", "http://com/de/1#x?y", "http://É.ORG/é"]


@pytest.mark.parametrize("most", [0, 100])
def test_rules_by_trie_and_by_join(spark, most):
    rng = random.Random(1)
    hosts, paths = ["org", "example.org", "a.example.org", "com", "u.com"], ["", "/", "/es/", "/en/1", "/e", "/es/x", "/fr/"]
    rules = [url_filters.Rule(rng.choice(hosts), rng.choice(paths), rng.random() < 0.5) for _ in range(25)] + queries.URL_RULES
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, rule string, found string")
    for r in url_filters.judge_urls(df, rules, max_trie_rules=most).collect():
        want = best_rule(r.host, r.path, rules)
        assert (r.rule, r.verdict) == ((want.host + want.path, "allow" if want.allow else "block") if want else (None, "allow"))
        assert r.found == "v"
    by_table = url_filters.judge_urls(df, spark.createDataFrame(rules, url_filters.RULE_TYPE), max_trie_rules=most)
    assert by_table.count() == len(URLS) and url_filters.judge_urls(df.limit(0), rules, max_trie_rules=most).collect() == []


def test_url_parts(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = [(r.host, r.path) for r in url_filters.judge_urls(df, queries.URL_RULES).collect()]
    assert got[0] == ("a.example.org", "/es/x") and got[2] == ("", "") and got[4] == ("", "") and got[5] == ("com", "") and got[12] == ("b:", "//c/d") and got[14] == ("É.org", "/é")


# quality rules
def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(2)
    texts = [None, "", " \n", "a", "é\u00a0b c\x0bd", "a a a a a a a", "x|y <z>\nx|y <z>\n\nx|y <z>"] + [" ".join(rng.choices(["a", "b", "é#", "\n", "c\n"], k=rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert quality_rules.text_counts(t)[:5] == plain_counts(t)


def test_verdicts_and_edge_rows(spark):
    good = [(i, " ".join(f"word{i * j % 97}" for j in range(40)), "en", "s") for i in range(1, 60)]
    bad = [(100, " ".join(f"wo$$rd{j}**" for j in range(40)), "en", "s"), (101, "few words", "en", "s"), (102, "a b c d e " * 9, "en", "s"), (103, None, None, None), (None, "", "en", None)]
    df = spark.createDataFrame(good + bad + good[:1], "doc_id long, text string, lang string, source string")
    rows = quality_rules.judge(df, ["doc_id"]).collect()
    assert len(rows) == 65 and {r.doc_id for r in rows if not r.kept} == {100, 101, 102, 103, None}
    assert {r.doc_id for r in rows if r.base_failed} == {101, 102, 103, None}
    assert quality_rules.judge(df.limit(0), ["doc_id"]).collect() == []


def test_fences_follow_their_group_and_no_constant_does_the_same(spark):
    """Sources of short, of long and of uneven words: what is odd in one is usual in another."""
    rng = random.Random(11)

    def text(low, high, n=60):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(low, high))) for _ in range(n))

    sources = {"short": (3, 4), "long": (9, 10), "uneven": (2, 14)}
    rows = [(f"{s}{i}", text(*w) if s != "uneven" else text(rng.randint(2, 6), rng.randint(7, 14)), "en", s) for s, w in sources.items() for i in range(60)]
    rows += [("in short", text(8, 9), "en", "short"), ("in long", text(8, 9), "en", "long"), ("in uneven", text(8, 9), "en", "uneven")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df, ["doc_id"]).collect()}
    assert [kept[x] for x in ("in short", "in long", "in uneven")] == [False, True, True]
    assert all(v for k, v in kept.items() if k != "in short")
    counted = quality_rules.with_counts(df, ["doc_id", "lang", "source"])
    fences = {r.source: r.max_chars_per_word for r in quality_rules.group_fences(counted).collect()}
    chars = {r.doc_id: 1000 * r.word_chars // r.n_words for r in counted.collect()}
    # a constant under which "in short" goes would take the long words' texts too
    assert fences["short"] < chars["in short"] < max(v for k, v in chars.items() if k.startswith("long")) <= fences["long"]


def test_every_adaptive_rule_rejects(spark):
    """One row for each metric that breaks only its fence; columns with a result's name are replaced."""
    prose = lambda k: " ".join(f"word{(i * k) % 89}{'x' * (i % 4)}" for i in range(80))
    good = [(i, prose(i), "en", "s") for i in range(1, 60)]
    bad = {
        "symbols_per_word": " ".join(f"wo$rd{i}" for i in range(80)), "dup_lines_per_line": "\n".join([prose(3), prose(5), *["one two"] * 5]),
        "repeat_per_word": " ".join([*(f"word{i}" for i in range(35)), *"abcdefgh", *(f"words{i}" for i in range(35)), *"abcdefgh"]), "chars_per_word": " ".join(f"{'verylongword' * 2}{i}" for i in range(80)), "upper_per_char": " ".join(f"WOrd{i}z" for i in range(80)),
    }
    df = spark.createDataFrame([(*r, 5) for r in good + [(100 + i, t, "en", "s") for i, t in enumerate(bad.values())]], "doc_id long, text string, lang string, source string, n_words int")
    rows = quality_rules.judge(df, ["doc_id", "n_words"]).collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(100, 105)) and not any(r.base_failed for r in rows)
    assert all(r.n_words >= 80 for r in rows)


def test_clean_documents_stay(spark):
    judged = queries.op5_quality_rules(spark, "/root/testdata/sf0.01")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = judged.join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1) and not any(r.kept for r in rows if r.quality == 0)


# licence scans
def test_canonical_forms_agree(spark):
    mit = license_scans.TEXTS["MIT"]
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, mit.replace(",", " , ").replace(" ", "  ")), (3, "Prose.\nReleased under the MIT Licence!\nMore prose."),
        (4, "licensed under CC BY-NC 4.0."), (5, "This work is licensed under the GNU General Public License, version 3."), (6, None), (7, "---"), (8, mit + "\nand more"), (1, "x"), (1, "x"), (9, "copyright holders are many"),
    ]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, license string")
    long_rows = [(20 + i, above + "\nCopyright (c) 1999 X\n\n" + text, "z") for i, (name, text) in enumerate(license_scans.TEXTS.items()) for above in (license_scans.TITLES[name][0],)]
    found = license_scans.scan_licenses(spark.createDataFrame([*long_rows, (50, "word " * 400_000, "z")], df.schema), license_scans.known_licenses(spark)).collect()
    assert {r.doc_id: r.license for r in found} == {50: None} | {20 + i: name for i, name in enumerate(license_scans.TEXTS)}
    rows = license_scans.scan_licenses(df, license_scans.known_licenses(spark)).collect()
    got = {(r.doc_id, r.license, tuple(r.notices)) for r in rows}
    assert len(rows) == len(docs)
    assert {(1, "MIT", ()), (2, "MIT", ()), (3, None, ("MIT",)), (4, "CC-BY-NC-4.0", ("CC-BY-NC-4.0",)), (5, "GPL-3.0", ("GPL-3.0",)), (6, None, ()), (7, None, ()), (8, None, ()), (9, None, ())} <= got
    assert [r.n_lines for r in rows if r.doc_id == 9] == [1] and license_scans.scan_licenses(df.limit(0), license_scans.known_licenses(spark)).collect() == []


def test_own_licenses_and_no_broadcast(spark):
    own = spark.createDataFrame([("own", "My terms:\nuse it."), ("none", ""), (None, "x")], "license string, text string")
    df = spark.createDataFrame([(1, "MY TERMS - USE IT")], "doc_id long, text string")
    row = license_scans.scan_licenses(df, license_scans.known_licenses(spark, own), max_broadcast=0).first()
    assert row.license == "own" and row.text_sha256 == hashlib.sha256(b"my terms use it").hexdigest()


# decontamination
def plain_contamination(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = find(text)
        for i in range(max(len(w) - k, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, ids = find(text), set(), set()
        for window, who in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids |= who
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("most", [10**6, 40])
def test_contamination(spark, most):
    rng = random.Random(3)
    words = ["aa", "Bb", "c", "é", "d1"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(8)] + [(20, "c"), (21, None), (22, "--"), (10, "C!")]
    docs = [(d, rng.choice([" ", "-", "  \n"]).join(rng.choices(words, k=rng.randint(0, 40)) + (items[d % 8][1].upper().split() if d % 3 else []))) for d in range(40)] + [(50, None), (51, "")]
    d = spark.createDataFrame([(a, b, 3) for a, b in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination(docs, items)
    for r in decontamination.find_contamination(d, b, ["doc_id", "text", "n_hit"], max_windows=most).collect():
        assert (r.n_words, r.n_hit, list(r.items)) == want[r.doc_id]
        assert {s.item for s in r.spans} == set(r.items)
        for s in r.spans:
            assert decontamination.words(r.text[s.start : s.end]) and not re.match(r"\W", r.text[s.start])
    assert decontamination.find_contamination(d, b.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0


def test_contamination_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = plain_contamination(docs, items)
    for r in queries.op7_decontamination(spark, SF).collect():
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


# HTML
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d e"), ("<article><h1>T</h1><div class='ad'>x</div><p>1 &lt; 2&nbsp;&#233;</p><form>f</form></article>tail", "T\n\n1 < 2 é"),
        ("<nav>m</nav><main>a<aside>s</aside>b</main><footer>f", "a\n\nb"), ("<div id=comments>c</div><p>t</p>", "t"), ("<p>x<script>if (a<b) '</p>'</script>y", "xy"), ("<p>a<!-- <p>no --></p>b < c", "a\n\nb < c"),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n\n2\n\n3\n\n4"), ("<article>cut off <p>here", "cut off\n\nhere"), ("</p></div>x</article>", "x"), ("<div class=headline>kept</div>", "kept"),
    ],
)
def test_page_text(page, text):
    root = html_text.parse(page or "")
    html_text.digest_tree(root)
    assert html_text.text_of(root, set()) == text


def test_site_templates_go(spark):
    pages = [(i, f"http://h.org/{i}", f"<div><span>Site of things</span></div><div><p>Story {i}</p></div><div>Read on</div>") for i in range(8)]
    pages += [(20, "http://other.org/1", "<div>Read on</div><p>kept</p>"), (21, None, None), (21, None, None), (22, "", "<p>Story 1</p>")]
    df = spark.createDataFrame([(a, b, c, "t") for a, b, c in pages], "page_id long, url string, html string, text string").drop("text")
    got = {r.page_id: r.text for r in html_text.extract_text(df, ["page_id"]).collect()}
    assert got == {**{i: f"Story {i}" for i in range(8)}, 20: "Read on\n\nkept", 21: "", 22: "Story 1"}
    assert html_text.extract_text(df, ["page_id"]).count() == len(pages) and html_text.extract_text(df.limit(0), ["page_id"]).collect() == []


def test_templates_inside_articles_decide(spark):
    """A neutral element that most articles of a host have goes; what a third of them has stays, and so does an article that is mirrored on most pages."""
    story = lambda i: f"<h1>T{i}</h1><p>Story {i}</p>" + ("<p>Series</p>" if i % 3 == 0 else "")
    pages = [(i, f"http://h.org/{i}", f"<article>{story(i)}<div class=x>Read our magazine</div></article>", "old") for i in range(9)]
    pages += [(20 + i, f"http://m.org/{i}", "<article><p>Mirrored</p></article>", "old") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    want = {i: f"T{i}\n\nStory {i}" + ("\n\nSeries" if i % 3 == 0 else "") for i in range(9)} | {20 + i: "Mirrored" for i in range(9)}
    got = html_text.extract_text(df, ["page_id", "text"])
    assert got.columns == ["page_id", "text"] and {r.page_id: r.text for r in got.collect()} == want
    without = {r.page_id: r.text for r in html_text.extract_text(df, ["page_id"], min_pages=100).collect()}
    assert all(without[i] == want[i] + "\n\nRead our magazine" for i in range(9))


def test_share_of_pages_is_reached_exactly(spark):
    """Five of 25 pages are a fifth: a template. Four pages never are."""
    pages = [(i, f"http://h.org/{i}", f"<p>own {i}</p>" + "<div>five</div>" * (i < 5) + "<div>four</div>" * (i < 4)) for i in range(25)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df, ["page_id"]).collect()}
    assert got == {i: f"own {i}" + "\n\nfour" * (i < 4) for i in range(25)}


def test_templates_equal_plain_counting(spark):
    """Subtrees of random pages, counted and deleted one by one."""
    rng = random.Random(6)
    parts = [f"<div><b>{w}</b> {w * 2}</div>" for w in "abcdefghij"] + ["<ul><li>m<li>n</ul>", "<p>one", "<section><div>x</div></section>"]
    pages = [(i, f"http://{'ab'[i % 2]}.org/", "".join(rng.choices(parts, k=rng.randint(1, 5))) + ("<article>" + "".join(rng.choices(parts, k=4)) + "</article>") * (i % 3 == 0)) for i in range(60)]
    count, articles, size = Counter(), {}, Counter()
    trees = {}
    for i, url, page in pages:
        trees[i] = root = html_text.parse(page)
        html_text.digest_tree(root)
        size[url] += 1
        for digest, article in html_text.template_candidates(root).items():
            if article is None:
                count[url, digest] += 1
            else:
                articles.setdefault((url, digest), set()).add(article)
    mains = {url: {x.digest for i, u, _ in pages if u == url for x in html_text.main_elements(trees[i])} for url in size}
    gone = {url: {d for (u, d), n in count.items() if u == url and n >= 5 and n >= 0.2 * size[url]} | {d for (u, d), who in articles.items() if u == url and len(who) >= 5 and len(who) >= 0.5 * len(mains[url])} for url in size}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df, ["page_id"]).collect()}
    assert got == {i: html_text.text_of(trees[i], gone[url]) for i, url, _ in pages} and any(gone.values())


def test_deep_and_long_pages_take_linear_time():
    root = html_text.parse("<div>" * 60_000 + "x" + "<p>y" * 60_000)
    html_text.digest_tree(root)
    assert len(html_text.template_candidates(root)) > 60_000
    assert html_text.text_of(root, set()).count("y") == 60_000


def test_html_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    for r in queries.op9_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        import html

        assert r.text == "\n\n".join(html.unescape(b) for b in blocks if b) and r.n_chars == len(r.text)
