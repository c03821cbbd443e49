import random

import numpy as np
import pytest

from webloom.llm import boilerplate, pages, spam
from webloom.llm.pages import parse, segments

NAV = '<div class="menu"><a href="/a">News</a> | <a href="/b">Travel</a> | <a href="/c">Sport</a></div>'
FOOT = '<div class="k9">\n<p>Terms of use | Privacy</p>\n<p>All rights reserved by us.</p>\n</div>'
SYLLABLES = "ba ce di fo gu ka le mi no pu".split()
NOUNS, VERBS = [a + b + "rt" for a in SYLLABLES for b in SYLLABLES], [a + b + "ts" for a in SYLLABLES for b in SYLLABLES[:4]]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} a {rng.choice(NOUNS)} and it {rng.choice(VERBS)} with the {rng.choice(NOUNS)}."


def page(rng, title):
    """An article's page, and the numbers of its lines."""
    lines = ["<html lang='en'>", f"<head><title>{title} - site</title>", "<script>", "var x = 'a sentence of the script';", "</script>", "</head><body>", NAV, '<div class="k1">', '<div class="k2">', "<p>Most read</p>", f"<p>{sentence(rng)}</p>", "</div>"]
    own = [len(lines) + 1]
    lines.append(f"<h1>{title}</h1>")
    lines.append(f"<p>Published {rng.randint(1, 28)}.1.2025</p>")
    for _ in range(6):
        own.append(len(lines) + 1)
        lines.append(f"<p>{sentence(rng)} {sentence(rng)}</p>")
    lines += ["<!-- The comment of the page is not shown. -->", '<p>Read also: <a href="/x">Some other article of ours</a></p>', "</div>", *FOOT.split("\n"), "</body></html>"]
    return "\n".join(lines), own


def stuffed(rng):
    return "<html><body>\n" + NAV + "\n" + "\n".join(f"<p>buy cheap widgets {rng.choice(NOUNS)} online, best widgets {rng.choice(NOUNS)} discount</p>" for _ in range(12)) + "\n</body></html>"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows, truth, spams = [], set(), set()
    for i in range(80):
        text, own = page(rng, f"Title number {rng.choice(NOUNS)} and {rng.choice(NOUNS)} {i}")
        rows.append((i, f"http://host{i % 5}.test/{i}", text))
        truth |= {(i, n) for n in own}
    for i in range(80, 90):
        rows.append((i, "http://spam.test/", stuffed(rng)))
        spams.add(i)
    links = "<html><body>\n" + "\n".join(f'<li><a href="/{n}">{rng.choice(NOUNS)} {rng.choice(NOUNS)} {n}</a></li>' for n in range(60)) + "\n</body></html>"
    rows += [(91, "http://parked.test/", links), (92, "http://parked.test/2", links), (93, None, None), (94, "http://x.test/", ""), (95, "http://host0.test/0", rows[0][2]), (96, None, "<p>" + " ".join(sentence(rng) for _ in range(3000)) + "</p>"), (0, "http://host0.test/0", rows[0][2])]
    spams |= {91, 92}
    truth |= {(95, n) for i, n in truth if i == 0} | {(96, 1)}
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "crawl_id long, url string, page string, rep string, line_no int"), truth, spams


def test_spam(table):
    crawl, _, spams = table
    assert sorted(r.crawl_id for r in boilerplate.spam_rows(crawl).collect()) == sorted(spams)


def test_main_lines(table):
    crawl, truth, _ = table
    got = [(r.crawl_id, r.line_no) for r in boilerplate.main_lines(crawl).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def test_joined_keys_give_the_same(table, monkeypatch):
    crawl, truth, _ = table
    monkeypatch.setattr(boilerplate, "MOST_BROADCAST", -1)
    assert {(r.crawl_id, r.line_no) for r in boilerplate.main_lines(crawl).collect()} == truth


def test_empty(table):
    crawl = table[0].limit(0)
    assert boilerplate.main_lines(crawl).count() == 0 and boilerplate.spam_rows(crawl).count() == 0


def test_parse_survives_broken_pages():
    for text in ("<div><p>a", "</div></div>text", "<head><title>x", "<!-- open", "<a <b>c", "plain\nlines", "<td>a</tr>b</table>c"):
        parse(text, "h.test")
    got = parse("<p>one</p>\n<script>\nno\n</script>\ntwo &amp; three", "h.test")
    assert [(x.no, x.text.strip()) for x in got.lines] == [(1, "one"), (5, "two & three")]


def test_segments_mask_names_and_numbers():
    assert segments("© 2024 my-site-7. All rights reserved.", ("my-site-7",)) == ["© # @", "all rights reserved"]
    assert segments("12. A line", ()) == ["a line"]


def test_unknown_language_is_no_spam_by_itself():
    text = "\n".join(f"<p>{x}.</p>" for x in FOREIGN["ru"].split(". "))
    lang, lines = measured(text)
    assert lang == "und" and lines[:, 3].sum() > 30 and not spam.verdict(lang, lines, {"en": (0.32, spam.PHRASED)})


FOREIGN = {
    "ru": "Вчера вечером жители города собрались на площади чтобы обсудить новый мост через реку. Архитектор показал рисунки и долго отвечал на вопросы соседей. Строительство начнётся весной если совет утвердит смету до конца января.",
    "tr": "Dün akşam kasaba halkı yeni köprüyü konuşmak için meydanda toplandı. Mimar çizimleri gösterdi ve komşuların sorularını uzun uzun yanıtladı. Meclis bütçeyi ocak sonuna kadar onaylarsa inşaat ilkbaharda başlayacak.",
}


@pytest.mark.parametrize("lang", [*FOREIGN, ""])
def test_honest_pages_of_other_languages_are_no_spam(table, spark, lang):
    text = FOREIGN[lang or "ru"]
    body = "\n".join(f"<p>{s}.</p>" for s in text.split(". "))
    page = f"<html{f' lang={lang}' if lang else ''}><body>\n{body}\n</body></html>"
    crawl = table[0].select("crawl_id", "url", "page").union(spark.createDataFrame([(500, "http://far.test/", page)], "crawl_id long, url string, page string"))
    assert {r.crawl_id for r in boilerplate.spam_rows(crawl).collect()} == table[2]
    assert [r.line_no for r in boilerplate.main_lines(crawl).where("crawl_id = 500").orderBy("line_no").collect()] == [2, 3, 4]


ENDINGS = {"pl": ("i", "w", "na", "z"), "sv": ("och", "i", "att", "som"), "tr": ("ve", "bir", "için", "bu"), "ru": ("и", "в", "не", "на"), "el": ("και", "το", "να", "του"), "ja": ("は", "の", "に", "を"), "hu": ("és", "az", "nem", "egy"), "fi": ("ja", "on", "ei", "se"), "cs": ("a", "na", "je", "se"), "uk": ("і", "у", "не", "з")}


def foreign(rng, lang):
    """Sentences of a made-up language with these function words, and letters of its own script."""
    script = {"ru": "бвгдклмн", "uk": "бвгдклмн", "el": "βγδκλμνπ", "ja": "山川田中村木林"}.get(lang, "bdgklmnp")
    word = lambda: "".join(rng.choice(script) + (rng.choice("aeio") if script[0] == "b" else "") for _ in range(3))
    sentence = lambda: " ".join(rng.choice(ENDINGS[lang]) if i % 3 == 1 else word() for i in range(12)).capitalize() + "."
    return word, sentence


def test_ten_languages_without_lists(spark):
    rng, rows, spams, honest = random.Random(11), [], set(), {}
    for lang in ENDINGS:
        word, said = foreign(rng, lang)
        for i in range(45):
            bad = i % 9 == 0
            lines = [" ".join(word() for _ in range(12)) if bad else said() for _ in range(6)]
            if i == 9:  # few words
                lines = [" ".join(word() for _ in range(7))]
            no = len(rows)
            rows.append((no, f"http://{lang}{i}.test/", f"<html lang='{lang}'><body>\n" + "\n".join(f"<p>{x}</p>" for x in lines) + "\n</body></html>"))
            spams |= {no} if bad else set()
    code = "\n".join(f"<p>{x}</p>" for x in ["def f(x):", "return x + 1", "for i in range(9):", "print(f(i))", "x = [f(i) for i in y]"])
    text = "".join(f"<p>{sentence(rng)}</p>\n" for _ in range(6))
    rows += [(900 + i, "http://en.test/", f"<html lang='en'>\n{text}{code}</html>") for i in range(3)]
    crawl = spark.createDataFrame(rows, "crawl_id long, url string, page string")
    assert {r.crawl_id for r in boilerplate.spam_rows(crawl).collect()} == spams


def test_small_pages():
    medians = {"en": (0.32, spam.PHRASED)}
    # The words of all pages tell its language.
    assert spam.verdict("en", measured("<p>buy cheap red shoes</p>\n<p>shoes bags belts online discount</p>")[1], medians)
    assert not spam.verdict(*measured("<html lang='en'><head><title>Silver harbour</title></head>\n<p>Home / reviews / Silver harbour</p>\n<h1>Silver harbour</h1>\n<p>Updated 6.7.2025 by Bragor</p></html>"), medians)


def test_names_of_containers_are_not_needed(table, monkeypatch):
    import re

    from webloom.llm import pages

    crawl, truth, _ = table
    monkeypatch.setattr(pages, "SIDE_NAMES", re.compile(r"(?!)"))
    assert {(r.crawl_id, r.line_no) for r in boilerplate.main_lines(crawl).collect()} == truth


def test_presentation_and_branches(spark):
    rng, rows = random.Random(2), []
    for i in range(40):
        body = "".join(f"<p>{sentence(rng)}</p>\n" for _ in range(rng.randint(3, 30)))
        rows.append((i, f"http://one.test/{i}", f"<div class='a'>\n<div class='b'>\n<p>{sentence(rng)}</p>\n<p>{sentence(rng)}</p>\n</div>\n<div class='c'>\n{body}</div>\n</div>"))
    parsed, _, _ = boilerplate.read_pages(spark.createDataFrame(rows, "crawl_id long, url string, page string"))
    values = {r.key: r.value for r in boilerplate.presentation(parsed).collect()}
    nodes = parsed.first()["nodes"]
    assert values[nodes[1]] == 0 and values[nodes[2]] > 0.5 and len(values) == 3
    nan = float("nan")
    assert boilerplate.composite([-1, 0, 0], [1, 2, 2], [1.0, nan, 0.0], [True, False, False])[1:] == [0.0, boilerplate.DECAY**2]
    # A branch that all pages show alike falls, though none of its lines is dull.
    lines = np.zeros((26, 7), np.int32)
    lines[:, 0], lines[:, 1], lines[:, 2] = range(26), [1] * 12 + [2] * 14, 10
    tree = np.array([[-1, 0, 0], [0, 0, 0], [0, 0, 0]], np.int32)
    none = np.zeros(0, bool)
    left = lambda node: boilerplate.article_lines(lines, tree, np.zeros(0, np.int32), none, np.zeros(26, bool), none, np.array(node, np.float32))
    assert left([0.9, nan, 0.9]) == list(range(26)) and left([0.9, 0.0, 0.9]) == list(range(12, 26))


def test_near_copies_keep_their_article(spark):
    rng = random.Random(7)
    rows, truth = [], set()
    text, own = page(rng, "A story of the many papers")
    lines = text.split("\n")
    for i in range(90):
        if i % 3:
            copy, at = page(rng, f"Title number {rng.choice(NOUNS)} and {rng.choice(NOUNS)} {i}")
        else:  # printed again with one sentence of its own
            at, edited = own, rng.choice(own[1:])
            copy = "\n".join(f"<p>{sentence(rng)} {sentence(rng)}</p>" if n == edited else x for n, x in enumerate(lines, 1))
        rows.append((i, f"http://host{i % 5}.test/{i}", copy))
        truth |= {(i, n) for n in at}
    crawl = spark.createDataFrame(rows, "crawl_id long, url string, page string")
    assert {(r.crawl_id, r.line_no) for r in boilerplate.main_lines(crawl).collect()} == truth


def measured(text):
    p = parse(text, "")
    lang, _, _, _, _, lines = spam.measure(p, boilerplate._outside(p))
    return lang, lines


def test_one_phrase_over_and_over_is_spam():
    phrase = "the best of the red leather shoes that we have in our shop by the old stone bridge with a view on the green river and the quiet harbour"
    medians = {"en": (0.32, spam.PHRASED)}
    assert spam.verdict(*measured("<p>" + " ".join([phrase] * 15) + "</p>"), medians)
    rng = random.Random(3)
    assert not spam.verdict(*measured("<p>" + phrase + "</p>\n" + "\n".join(f"<p>{sentence(rng)}</p>" for _ in range(20))), medians)


def test_many_lines_like_menus_are_spam_unless_they_recur_on_the_site(table, spark):
    rng = random.Random(5)
    row = lambda: " | ".join(rng.sample(NOUNS, 4))
    rows = [(600, "http://keys.test/", "\n".join(f"<p>{row()}</p>" for _ in range(20)))]
    menu = "\n".join(f"<p>{row()}</p>" for _ in range(4))
    rows += [(601 + i, f"http://short.test/{i}", f"{menu}\n<p>{sentence(rng)}</p>") for i in range(4)]
    crawl = table[0].select("crawl_id", "url", "page").union(spark.createDataFrame(rows, "crawl_id long, url string, page string"))
    assert {r.crawl_id for r in boilerplate.spam_rows(crawl).collect()} == table[2] | {600}


def test_lines_of_a_page_are_read_together(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def sub(self, *args):
            self.calls += 1
            return self.pattern.sub(*args)

    counted = Counted(pages._NUMBER)
    monkeypatch.setattr(pages, "_NUMBER", counted)
    page = pages.parse("\n".join(f"<p>Line {i} of No. {7 * i} is read | once</p>" for i in range(200)))
    assert [line.no for line in page.lines] == list(range(1, 201)) and counted.calls <= 4
    assert page.lines[3].segments == ["line # of no", "# is read", "once"] and page.lines[3].form == "^ # of ^. # is read | once"


@pytest.mark.parametrize("odd", ["a\0b 1.2.2020 C", "\ud800x Y_z", "Stra\u00dfe\u00a0\u0130\u3002 9", "one\x1ctwo\x85three", "\u00b7 \u2022 x", "x. y! z? - 4 / 5 \u00bb 6", "\u0661\u0662-\u0663 A'b-C", "..", "\0"])
def test_a_line_says_the_same_among_others(odd):
    alone = pages.parse(odd)
    among = pages.parse("\n".join(["Ends with a dot.", odd, " / Starts 12 with a bar", "x" * 200 + " 1-1-1", odd + " again", odd]))
    said = [(x.text, x.norm, x.words, x.segments, x.form, x.dated, x.separators, x.links) for x in among.lines if x.no in (2, 6)]
    assert said == 2 * [(x.text, x.norm, x.words, x.segments, x.form, x.dated, x.separators, x.links) for x in alone.lines]
    for x in among.lines:
        assert x.words == pages._WORD.findall(x.text.casefold()) and x.segments == pages.segments(x.text)
        assert x.form == (pages.form(x.text) if len(x.words) <= pages.FORM_WORDS else "")


def test_runs_are_counted_only_among_frequent_words():
    lines = ["buy the best shoes".split()] * 5 + ["we ask the best of all".split()]
    counts = spam.Counter(w for words in lines for w in words)
    assert spam._phrased(lines, counts) == [4] * 5 + [0]
    assert spam._phrased(lines[4:], spam.Counter(lines[4] + lines[5])) == [0, 0]


def test_tags_that_recur_are_taken_apart_once(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def split(self, *args):
            self.calls += 1
            return self.pattern.split(*args)

    counted = Counted(pages._TAG)
    monkeypatch.setattr(pages, "_TAG", counted)
    page = pages.parse("\n".join(f"  <div class='once-{i % 2}'>Line {i} &amp; more</div>" for i in range(200)))
    assert counted.calls <= 2 and page.styles[:2] == ["div.once-0", "div.once-1"] and len(page.styles) == 200
    assert page.lines[7].text.split() == ["Line", "7", "&", "more"] and page.lines[7].container == 7


@pytest.mark.parametrize("raw", ["<p>a</p>", " <div class='menu'>a > b", "<a href='/x'>two words</a>", "x<br>", "<p></p>", "<p> </p>y", "< p>a</p>", "<p>a<b", "<3>a</p>", "a <p>b</p>", "<td>a</td> b", "<html lang=de>a", "<p>&lt;b&gt;", "<li><b>c</b></li>", "</div>a<div>", "<p>a", ">a<", "<", "<p", "<p>a<!-- b"])
def test_a_line_between_two_tags_is_read_as_any_other(raw):
    said = [[getattr(x, c) for c in ("ops", "text_at", "style", "lang", "text", "links", "link_words")] for x in (pages._Scan(raw), pages._Scan(raw, shells=False))]
    assert said[0] == said[1] and said[0][4] == pages.visible(raw)


def test_words_of_pages_add_up():
    said = [("en", "the the cat"), ("en", "the dog \ud800x"), ("de", "der"), ("en", "")]
    for most in (1, 1 << 20):
        vocabulary, got = spam.Vocabulary(most), spam.Counter()
        for lang, text in said:
            vocabulary.add(lang, spam.Counter(text.split()))
            for last in (False, True):
                for of, keys, n in vocabulary.spilled(last and text == ""):
                    got.update(dict(zip(zip([of] * len(keys), keys.tolist()), n.tolist())))
        assert got == {(lang, spam.word_key(w)): n for lang, w, n in (("en", "the", 3), ("en", "cat", 1), ("en", "dog", 1), ("en", "\ud800x", 1), ("de", "der", 1))}


def test_marks_are_sought_for_all_pages_at_once(monkeypatch):
    sought, calls = boilerplate._sought, []
    monkeypatch.setattr(boilerplate, "_sought", lambda *args: calls.append(1) or sought(*args))
    rows = [([1, 2], [9]), ([], []), ([3], [4, 2])]
    b = boilerplate.pd.DataFrame(rows, columns=["pieces", "nodes"])
    marks = np.array([2, 9], np.int64), np.array([0.5, 0.25], np.float32)
    together = [([f.tolist() for f in found], np.nan_to_num(value, nan=-1).tolist()) for _, found, value in boilerplate._looked_up(b, ["pieces", "nodes"], marks)]
    assert len(calls) == 1 and together == [([[False, True], [True]], [0.25]), ([[], []], []), ([[False], [False, True]], [-1, 0.5])]
    b["marks"] = [[{"key": 9, "value": 0.25}, {"key": 2, "value": 0.5}], None, [{"key": 2, "value": 0.5}]]
    assert together == [([f.tolist() for f in found], np.nan_to_num(value, nan=-1).tolist()) for _, found, value in boilerplate._looked_up(b, ["pieces", "nodes"], None)]
