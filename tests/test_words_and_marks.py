"""Text functions on literal rows."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loamspark.functions import language, predicates
from loamspark.functions import text as fn
from loamspark.operators import matching, passages
from loamspark.sources import archives, connectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "slug", "form"),
    [
        ("Łódź Żółw", "odz-zo-w", "łodz zołw"),
        ("Çeşme İzmir ğ", "cesme-izmir-g", "cesme izmir g"),
        ("Đặng Thị Ngọc Hân", "ang-thi-ngoc-han", "đang thi ngoc han"),
        ("Čapek Dvořák", "capek-dvorak", "capek dvorak"),
        ("漢字 kana", "kana", "漢字 kana"),
        ("Å̊ngström e\u0301", "angstrom-e", "angstrom e"),
        ("Ｆｕｌｌ", "full", "full"),
        ("***", "entry", ""),
    ],
)
def test_folding(spark, text, slug, form):
    got = spark.range(1).select(fn.slug(F.lit(text)).alias("s"), fn.match_form(F.lit(text)).alias("m")).first()
    assert (got["s"], got["m"]) == (slug, form)


def test_unique_slugs(spark):
    rows = spark.createDataFrame([(i, "u", b) for i, b in enumerate(["x", "x", "x-2", "x", "y"])] + [(9, "w", "x")], "id int, u string, base string")
    got = {r["id"]: r["slug"] for r in fn.unique_slugs(rows, "u", "base", ["id"]).collect()}
    assert got == {0: "x", 1: "x-3", 2: "x-2", 3: "x-4", 4: "y", 9: "x"}
    many = spark.createDataFrame([(i, "u", "z") for i in range(101)], "id int, u string, base string")
    slugs = [r["slug"] for r in fn.unique_slugs(many, "u", "base", ["id"]).orderBy("id").collect()]
    assert slugs[98] == "z-99" and slugs[99:] == [None, None] and len(set(slugs)) == 100


@pytest.mark.parametrize(("label", "want"), [("Leading", "lead"), ("sing", "sing"), ("Is ALLIED with", "is alli with"), ("bosses", "bosse"), ("boss", "boss"), ("its", "its"), ("", "")])
def test_relation_labels(spark, label, want):
    assert value(spark, fn.relation_label(F.lit(label))) == want


def test_sentences(spark):
    body = "# Head\nFirst one. Second [[x]]! third? \r\nFourth.\n\n  \n## Sub \nMr. Smith ran. 5 ran... [[A]] ran\n\n"
    want = ["# Head", "First one.", "Second [[x]]! third?", "Fourth.", "## Sub", "Mr.", "Smith ran.", "5 ran...", "[[A]] ran"]
    assert value(spark, fn.sentences(F.lit(body))) == want
    assert value(spark, fn.sentences(F.lit("  \n\n"))) == []


def test_fences(spark):
    body = "a\n:::secret\nhidden\n:::\nb\n:::gmnote x\nmore\n"
    spans = [tuple(s) for s in value(spark, fn.fence_spans(F.lit(body)))]
    assert [body[a:b] for a, b in spans] == [":::secret\nhidden\n:::\n", ":::gmnote x\nmore\n"]
    seen = [value(spark, fn.visible_span(F.lit(body), F.lit(a), F.lit(b))) for a, b in ((0, 2), (0, 3), (12, 15), (23, 24), (0, len(body)))]
    assert seen == [True, False, False, True, False]
    assert value(spark, fn.without_fences(F.lit(body))) == "a\nb\n"
    assert value(spark, fn.span_text(F.lit("héllo"), F.lit(1), F.lit(4))) == "éll" and value(spark, fn.span_text(F.lit("x"), F.lit(1), F.lit(1))) is None


def test_spans(spark):
    at = lambda body, s: (lambda r: None if r is None else tuple(r))(value(spark, fn.locate_span(F.lit(body), F.lit(s))))
    assert at("one two. (three)\nfour", "(three)") == (9, 16)
    assert at("one two.\n(three)   four", "two. (three) four") == (4, 23)
    assert at("abc", "x") is None and at("abc", "  ") is None


def test_links_images_previews(spark):
    text = "[[A#h]] [[ B |c]] [[C]] ![a](u =0%) ![b](v  =250%) ![](w) ![x]() ![y](a b) ![z](q =5)"
    assert value(spark, fn.wikilinks(F.lit(text))) == ["A", "B", "C"]
    assert [tuple(i) for i in value(spark, fn.images(F.lit(text)))] == [("a", "u", 1), ("b", "v", 100), ("", "w", None)]
    body = "# T\n- *one* [two](x)\n> ~~q~~ [[N]]\n---\n1. `c`\n:::secret\ns\n:::\n![i](j)end"
    assert value(spark, fn.preview(F.lit(body))) == "T one two q N c end"
    long = "word " * 60
    assert value(spark, fn.preview(F.lit(long))) == ("word " * 40).strip()[:199] + "…"
    assert value(spark, fn.preview(F.lit("x" * 300))) == "x" * 200 + "…"


@pytest.mark.parametrize(
    ("text", "want"),
    [("## Rivalry\n[[Name|shown]] *is* here. More.", "Rivalry Name is here."), ("no end", "no end"), ("a.b c. d", "a.b c."), ("", None), ("# *", None), ("y" * 300, "y" * 200 + "...")],
)
def test_one_line(spark, text, want):
    assert value(spark, fn.one_line(F.lit(text))) == want


def test_token_estimate_counts_utf16(spark):
    assert value(spark, fn.token_estimate(F.lit("😀" * 4))) == 2 and value(spark, fn.token_estimate(F.lit("abcde"))) == 2


EN = "The captain of the guard was seen at the gate with his men before dawn."
IT = "La taverna della città era piena di gente che non sapeva come uscire dalla porta."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (EN, "en"), (IT, "it"), ("The Gilded Rat, The Ashen Ledger, The Valdoria Watch, The Old Keep", None), ("of the", None),
        (f"{EN} {IT}", None), (f"{EN} {EN.replace('captain', 'cook')} {EN.replace('captain', 'maid')} {EN.replace('guard', 'inn')} {IT}", "en"), ("", None), (None, None),
    ],
)
def test_language(spark, text, want):
    assert value(spark, language.detected(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("header", "tags", "locale"),
    [("it-CH, en;q=0.9", ["it-ch", "en"], "it"), ("en;q=0, it;q=0.1", ["it"], "it"), ("fr;q=0.9, *, it", ["*", "it", "fr"], "en"), ("it;q=x, de", ["de"], "en"), ("en;q=0.2;level=1, it;q=0.2", ["en", "it"], "en"), ("", [], "en"), (None, None, "en")],
)
def test_accept_language(spark, header, tags, locale):
    h, none = F.lit(header).cast("string"), F.lit(None).cast("string")
    assert value(spark, language.accepted(h)) == tags
    assert value(spark, language.negotiated(none, none, h)) == locale


def test_writing_language(spark):
    lit = lambda x: F.lit(x).cast("string")
    of = lambda *a: value(spark, language.writing_language(*map(lit, a)))
    assert [of("it_CH", EN, None, None), of(None, IT, "en", None), of("xx", "?", "it", EN), of(None, None, None, None)] == ["it", "it", "it", "en"]


def test_wikitext(spark):
    text = "<!-- c -->{{Infobox|{{x}}}}'''Bold''' and ''it'' [[File:a.png|thumb]][[A|b]] [[C]] [https://x.y label] [https://z]<ref>r</ref><b>t</b>&nbsp;e\n{| t\n| a\n|}\n\n\n\nend "
    assert value(spark, fn.wikitext(F.lit(text))) == "Bold and it b C label t e\n\nend"


def test_markdown_sections(spark):
    got = [tuple(s) for s in value(spark, fn.markdown_sections(F.lit("s"), F.lit("N"), F.lit("intro\n\n## One\n\ntext\nmore\n\n## Two\n\nlast ")))]
    assert got == [("s#0", "N", "intro"), ("s#1", "N > One", "text\nmore"), ("s#2", "N > Two", "last")]


def test_chunks(spark):
    page = "lead\n== A ==\n" + "One two three. " * 6 + "\n=== B ===\nbody\n== C ==\n\n==== D ====\n" + "w" * 50
    got = passages.chunked(spark.createDataFrame([(1, "T", page), (2, None, None)], "id int, t string, x string"), "id", "t", "x", 10).collect()
    assert [r["index"] for r in got] == list(range(len(got)))
    assert [(r["breadcrumb"], r["text"]) for r in got] == [("T", "lead"), *[("T > A", "One two three. One two three.")] * 3, ("T > A > B", "body"), ("T > C >  > D", "w" * 50)]


def plain_chunks(title, text, tokens):
    """Sections by a stack of headings, and pieces by trying each unit."""
    stack, parts, held = {1: title}, [], []
    for line in [*text.split("\n"), "== end =="]:
        marks = re.fullmatch(r"(={2,6})\s*(.+?)\s*\1\s*", line)
        if not marks:
            held.append(line)
            continue
        if "\n".join(held).strip():
            parts.append((" > ".join(stack.get(i, "") for i in range(1, max(stack) + 1)), "\n".join(held).strip()))
        held, level = [], len(marks[1])
        stack = {i: h for i, h in stack.items() if i < level} | {level: marks[2]}

    def fits(t):
        return math.ceil(len(t.encode("utf-16-le")) / 2 / 4) <= tokens

    def pieces(t, ways):
        if fits(t) or not ways:
            return [t]
        units = [u for u in re.split(ways[0][0], t) if u.strip()]
        if len(units) < 2:
            return pieces(t, ways[1:])
        out = [[]]
        for u in units:
            if not fits(u):
                out += [pieces(u, ways[1:]), []]
            elif out[-1] and isinstance(out[-1][0], tuple) and fits(ways[0][1].join([*(x for x, in out[-1]), u])):
                out[-1].append((u,))
            else:
                out.append([(u,)])
        return [p for group in out if group for p in ([ways[0][1].join(x for x, in group)] if isinstance(group[0], tuple) else group)]

    ways = [(r"\n{2,}", "\n\n"), (r"(?<=[.!?])\s+", " "), (r"\s+", " ")]
    return [(crumb, p.strip()) for crumb, body in parts for p in pieces(body, ways) if p.strip()]


def test_chunks_by_a_plain_version(spark):
    rng = random.Random(4)
    bits = ["word", "A b c.", "Ends here!", "\n", "\n\n", "\n== H1 ==\n", "\n=== H2 ===\n", "\n==== H3 ====\n", "x" * 50, "😀é", "= no =", "  "]
    texts = ["".join(rng.choice([" ", ""]) + rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    pages = spark.createDataFrame([(i % 50, f"T{i}", t) for i, t in enumerate(texts)], "id int, title string, text string").repartition(3)
    for tokens in (3, 11):
        got = passages.chunked(pages, "id", "title", "text", tokens).collect()
        want = [(i % 50, n, *c) for i, t in enumerate(texts) for n, c in enumerate(plain_chunks(f"T{i}", t, tokens))]
        assert sorted(map(tuple, got)) == sorted(want)


def test_passages(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "xx one two  three four five six"), (2, "one two three"), (3, None), (4, "aab")], "id int, text string")
    found = spark.createDataFrame([(1, "e two  thr"), (2, "wo three fo"), (3, "aa"), (4, ""), (5, "one two  three four five s"), (6, "ee fou"), (7, None), (8, "b")], "p int, passage string")
    got = passages.contained(texts, found, "text", "passage").select("id", "p").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 5), (1, 6), (4, 3), (4, 8)]
    assert passages.contained(texts, found.limit(0), "text", "passage").count() == 0
    monkeypatch.setattr(passages, "LISTED", 1)  # by joins
    assert sorted(map(tuple, passages.contained(texts, found, "text", "passage").select("id", "p").collect())) == [(1, 1), (1, 5), (1, 6), (4, 3), (4, 8)]


def test_hashed_vectors(spark):
    def fnv(token):
        h = 2166136261
        units = token.encode("utf-16-le")
        for a, b in zip(units[::2], units[1::2], strict=True):
            h = ((h ^ (a + 256 * b)) * 16777619) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h)

    for token in ("rat", "é", "😀x", "a longer token"):
        assert value(spark, matching.hash_bucket(F.lit(token), 257)) == fnv(token) % 257
    v = value(spark, matching.trigram_vector(F.lit(" Ab  c ")))
    places = [fnv("  ab c  "[i : i + 3]) % 256 for i in range(6)]
    assert sum(x * x for x in v) == pytest.approx(1) and {i for i, x in enumerate(v) if x} == set(places)
    assert value(spark, matching.word_vector(F.lit("!"))) == [0.0] * 256


def test_predicates(spark):
    one = lambda c: value(spark, c)
    assert [one(predicates.reason(F.lit(r).cast("string"))) for r in (" Too Much ", "x", None)] == ["too_much", "other", "other"]
    assert one(predicates.merged_params(F.lit('{"a":"1","k":"2"}'), F.lit('{"k":"3","z":"4"}'), ["k", "m"])) == '{"a":"1","k":"3"}'
    assert one(predicates.merged_params(F.lit("[]"), F.lit('{"m":"3"}'), ["k", "m"])) == '{"m":"3"}'
    globs = [("http://a.b/*", "HTTP://A.B/x", True), ("http://a.b/", "http://axb/", False), ("*[x]*", "a[x]b", True), ("a?c", "abc", False)]
    assert [one(F.call_function("rlike", F.lit(u), predicates.glob_pattern(F.lit(p)))) for p, u, _ in globs] == [w for *_, w in globs]
    assert [one(predicates.empty_object(F.lit(j))) for j in ("{}", '{"a":1}')] == [True, False]
    style, source = predicates.style(F.lit(""), F.lit("u"))
    assert (one(style), one(source)) == ("", "entry")


def test_entry_paths_and_entities(spark):
    names = ["a\\b/./c", "/x", "c:/x", "a/../b", "", ".", "a\0b", "d//e"]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", archives.entry_path(F.col("n")).alias("p")).orderBy("i").collect()]
    assert got == ["a/b/c", None, None, None, None, None, None, "d/e"]
    assert value(spark, archives.entities_decoded(F.lit("&lt;&#65;&#x42;&unknown;&nbsp;&#99999999999;"))) == "<AB&unknown; &#99999999999;"


def test_markdown_as_wikitext(spark):
    text = "---\nt: x\n---\n# Title\n## Sub **b**\n- item [[A|b]]\n| a | b |\n|---|---|\n> q\n```\n# raw\n```\n***\n\n\nend"
    assert value(spark, connectors.as_wikitext(F.lit(text), F.lit("Title"))) == "== Sub b ==\nitem [[A|b]]\na - b\nq\n# raw\n\nend"
    text = "# T *x*\n# T\n![p](q)a [l](u) `c` ***z***\n1. one\n# T\n~~~\n| r |"
    assert value(spark, connectors.as_wikitext(F.lit(text), F.lit("T"))) == "== T x ==\na l c z\none\n== T ==\n| r |"


def test_long_runs_of_blanks(spark):
    """Trims take time in proportion: a million blanks within a text and at its ends."""
    blanks = " " * 1_000_000
    text = spark.createDataFrame([(f"{blanks}a{blanks}b. C \n{blanks}",)], "t string").repartition(1).persist()
    text.count()
    for f in (fn.trimmed, fn.excerpt, fn.trimmed_excerpt, fn.one_line, fn.sentences, fn.plain_html, fn.preview, fn.section_summary, fn.wikitext, lambda x: connectors.as_wikitext(x, F.lit("T"))):
        began = time.time()
        text.select(F.md5(f(F.col("t")).cast("string"))).collect()
        assert time.time() - began < 20
    assert value(spark, fn.trimmed(F.lit("\ufeff\u2003\u00a0a\u3000 b\x0b\u2029"))) == "a\u3000 b"


def test_evidence_views(spark):
    """Literal rows: what each kind of evidence shows, entries of other shapes, and imports."""
    import json

    mention = {"kind": "mention", "direction": "reverse", "matchedText": "Ash", "sourceSentence": "Ash waits."}
    cases = [
        ("edit", [{"kind": "relation", "hops": 2, "path": ["a", "b"]}, mention], [(None, "relation", ["a", "b"], 2, None, None, None, None), ("Ash waits.", "mention", None, None, "reverse", "Ash", None, None)], None),
        ("edit", [{"kind": "embedding", "similarity": 0.8, "sourceSentence": "Near."}, 7, "mention", None, {"kind": "rumour"}], [("Near.", "embedding", None, None, None, None, None, None)], "embeddingOnly"),
        ("ask", [{"kind": "instruction", "instruction": "Draw a \"map\""}, {"kind": "embedding", "sourceSentence": "Near."}], [('Draw a "map"', "instruction", None, None, None, None, None, None), ("Near.", "embedding", None, None, None, None, None, None)], "instructionOnly"),
        ("edit", [], [], None),
        ("edit", mention, [], None),
        ("import", {"sourceRef": {"path": "a.md"}, "similarity": 0.9, "ambiguousCandidateIds": ["x", "y"]}, [(None, "importAmbiguous", None, None, None, None, "a.md", 2)], "embeddingOnly"),
        ("import", {"sourceRef": {"path": "a.md"}, "similarity": 1, "ambiguousCandidateIds": []}, [(None, "importMatched", None, None, None, None, "a.md", None)], "embeddingOnly"),
        ("import", {"sourceRef": {"path": 5}, "ambiguousCandidateIds": ["x"]}, [(None, "importExtracted", None, None, None, None, None, None)], None),
        ("import", {"sourceRef": None, "similarity": "0.9"}, [(None, "importExtracted", None, None, None, None, None, None)], None),
        ("import", {"similarity": 0.9}, [], None),
        ("import", [mention], [], None),
    ]
    rows = [(i, t, json.dumps(e)) for i, (t, e, _, _) in enumerate(cases)] + [(100, "edit", None), (101, "edit", "{"), (102, "import", None), (103, None, json.dumps([mention]))]
    got = spark.createDataFrame(rows, "id int, trigger string, evidence string").select("id", predicates.evidence_views(F.col("trigger"), F.col("evidence")).alias("e")).collect()
    found = {r["id"]: ([tuple(v) for v in r["e"]["views"]], r["e"]["caveat"]) for r in got}
    for i, (_, _, views, caveat) in enumerate(cases):
        assert found[i] == (views, caveat), i
    assert [found[i] for i in (100, 101, 102)] == [([], None)] * 3
    assert found[103] == ([("Ash waits.", "mention", None, None, "reverse", "Ash", None, None)], None)


def test_decompositions(spark):
    """Every character, and texts of several, against the standard library's compatibility decomposition."""
    import unicodedata

    def plain(text):
        return re.sub("[\\^`\u00b7\u02b0-\u02ff]", "", "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")).lower()

    words = ["ﬁn ﬄé Ǆ", "한국어 각 가 힣", "𝐀𝒷 ½ ㎏ ™ ﷺ", "İstanbul", "", "plain", "𠀀 \n ﬁ\r\n"]
    odd = [chr(c) for c in range(0xA0, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    texts = words + ["x".join(odd[i : i + 40]) for i in range(0, len(odd), 40)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.unaccented(F.col("t"))).collect()
    wrong = [(texts[i], t, plain(texts[i])) for i, t in got if t != plain(texts[i])]
    assert wrong == []
    assert value(spark, fn.slug(F.lit("ﬁne Eﬀect 𝟙"))) == "fine-effect-1"
    assert value(spark, fn.match_form(F.lit("각"))) == value(spark, fn.match_form(F.lit(unicodedata.normalize("NFD", "각"))))
