"""The text operators against plain versions, on small tables with nulls, repeats and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.llm import collapse, layout, maincontent, mixture, near, quality, reading, residue, tokens

PAGES = "page_id long, domain string, url string, title string, meta_description string, status int, word_count int, body_text string, id long, key long, n long"
PROSE = "The old mill stands by the river and the people of the town walk there on most days. "


def pages(spark, rows):
    names = [x.split()[0] for x in PAGES.split(", ")]
    base = {"domain": "site.example", "url": "https://site.example/x", "status": 200, "word_count": 200}
    return spark.createDataFrame([tuple((base | r).get(k) for k in names) for r in rows], PAGES)


# p8


def test_encoding_equals_the_library_and_decodes(spark):
    import tiktoken

    vocab = tokens.vocabulary()
    library = tiktoken.Encoding("own", pat_str=tokens.SPLIT.removeprefix("(?U)"), mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(4)
    texts = [None, "", " ", "\r\n \t x", "don't  stop", "naïve café ✓ 👍🏽", "日本語のテキスト", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "<|endoftext|>", PROSE, PROSE]
    texts += ["".join(rng.choice("ab \nÄé1_<'s東") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    table = spark.createDataFrame([(i if i % 7 else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, __word string, ids int")
    got = tokens.encode_corpus(table, vocab).withColumn("back", tokens.decoded(F.col("ids"), vocab)).collect()
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        by_text.setdefault(r.back, r.ids)
    for text in texts:
        assert by_text[text or ""] == library.encode_ordinary(text or "")
    assert tokens.encode_corpus(table.limit(0), vocab).count() == 0
    sizes = sorted(r["size"] for r in tokens.count_tokens(table, vocab).collect())
    assert sizes == sorted(len(library.encode_ordinary(t or "")) for t in texts) and tokens.count_tokens(table.limit(0), vocab).count() == 0


def test_long_words_and_long_texts(spark):
    """Beyond LONG_WORD bytes the merges come from a heap, beyond BLOCK_WORDS words a text is encoded in blocks: both change nothing."""
    import tiktoken

    vocab = tokens.vocabulary()
    library = tiktoken.Encoding("own", pat_str=tokens.SPLIT.removeprefix("(?U)"), mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["x" * 1_000_000, "".join(rng.choice("ABCDefgh") for _ in range(300_000)), f"{PROSE}xqzzy " * 5000, PROSE]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(table, vocab).collect()}
    pieces = {i: piece for piece, i in vocab.ranks.items()}
    assert b"".join(pieces[i] for i in got[0]) == texts[0].encode()
    assert [got[k] for k in (1, 2, 3)] == [library.encode_ordinary(texts[k]) for k in (1, 2, 3)]
    for word in (b"xx", b"abcabc", b"  \n", "naïveté".encode(), b"A" * 300):
        assert tokens.heap_ids(word, vocab.ranks) == library._encode_single_piece(word)


# p9


def filled(sizes, shares, caps, total):
    """Water-filling by repetition: clamp what exceeds its cap, share the rest among the others."""
    quota, free, left = {}, set(sizes), total
    while free:
        weight = sum(shares[s] for s in free)
        over = {s for s in free if left * shares[s] / weight > caps[s] + 1e-9}
        if not over:
            return quota | {s: left * shares[s] / weight for s in free}
        for s in over:
            quota[s] = caps[s]
            left -= caps[s]
        free -= over
    return quota


@pytest.mark.parametrize("budget", [None, 500, 1500, 4000, 10**6])
def test_mixture(spark, budget):
    sizes = {"a": [10] * 60, "b": [5, 7, 11, 13] * 5, "c": [400], "d": [3] * 10}
    shares, repeats = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 1, "b": 3, "c": 2, "d": 4}
    rows = [(k * 1000 + i, s, n) for k, s in enumerate(sizes) for i, n in enumerate(sizes[s])] + [(9001, None, 50), (9002, "x", 50), (9003, "a", None)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = spark.createDataFrame([(s, shares[s], repeats[s]) for s in shares] + [(None, 0.5, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixture.mix(documents, targets, budget)
    total = {s: sum(v) for s, v in sizes.items()}
    caps = {s: repeats[s] * total[s] for s in total}
    expected = filled(total, shares, caps, min(sum(caps.values()), budget if budget is not None else min(caps[s] / shares[s] for s in caps)))
    used = {r.source: r for r in report.collect()}
    for s in sizes:
        assert abs(used[s].quota - expected[s]) < 1e-6 and used[s].quota - max(sizes[s]) <= used[s].mixed_tokens <= used[s].quota + 1e-6
        assert used[s].most_copies <= repeats[s]
    got = copies.collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} <= set(sizes)
    for s in sizes:
        counts = {r.copies for r in got if r.source == s}
        assert not counts or max(counts) - min(counts) <= 1


def test_mixture_of_the_corpus_clamps(spark, sf_dir):
    from pagestrata.llm import queries

    rows = [r for r in queries.QUERIES["p9_corpus_shares"](spark, sf_dir).collect() if r.target_share > 0]
    budget = sum(len(r.ids) for r in queries.p8_ids(spark, sf_dir).collect())
    caps = {r.source: r.max_repeats * r.tokens for r in rows}
    expected = filled(caps, {r.source: r.target_share for r in rows}, caps, min(sum(caps.values()), budget))
    clamped = {r.source for r in rows if r.quota == pytest.approx(caps[r.source])}
    assert clamped and len(clamped) < len(rows)
    for r in rows:
        assert r.quota == pytest.approx(expected[r.source]) and r.most_copies <= r.max_repeats
        assert r.source in clamped or r.quota > budget * r.target_share


def test_mixture_of_nothing(spark):
    documents = spark.createDataFrame([], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    copies, report = mixture.mix(documents, targets)
    assert copies.count() == 0 and [(r.mixed_tokens, r.actual_share) for r in report.collect()] == [(0, 0.0)]


# p4


def test_collapse(spark):
    rows = [
        {"page_id": 5, "title": "Red Fox, 3!", "meta_description": "Über STRASSE"},
        {"page_id": 2, "title": "über straße.", "meta_description": "  red-fox 3"},
        {"page_id": 2, "title": "über straße.", "meta_description": "  red-fox 3"},
        {"page_id": 9, "title": "red fox 3", "meta_description": "uber strasse"},
        {"page_id": 7, "title": "RED FOX 3", "meta_description": " "},
        {"page_id": 8, "title": None, "meta_description": "x"},
        {"page_id": None, "title": "red fox 3", "meta_description": "über strasse"},
        {"page_id": 11, "title": "aa", "meta_description": "aa"},
        {"page_id": 12, "title": "a", "meta_description": "aaa"},
    ]
    table = pages(spark, rows)
    assert [tuple(r) for r in collapse.found(table).select("keep_id", "page_id").collect()] == [(2, 5)]
    assert {tuple(r) for r in collapse.copy_counts(table, "page_id", collapse.PAGE_ROLES).collect()} == {(2, 2), (9, 1), (11, 1), (12, 1)}
    assert collapse.found(table.limit(0)).count() == 0


# p7


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(150)]
        texts.append(base)
        for edits in (0, 4, 12, 60):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = [{"page_id": i, "body_text": " ".join(t)} for i, t in enumerate(texts)]
    rows += [rows[3], {"page_id": 900, "body_text": None}, {"page_id": 901, "body_text": "..."}, {"page_id": 902, "body_text": " ".join(texts[0]), "status": 404}]
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    expected = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if share(grams[i], grams[j]) >= 0.5}
    got = [tuple(r) for r in near.found(pages(spark, rows)).select("page_id_a", "page_id_b").collect()]
    assert len(got) == len(set(got))
    assert not set(got) - expected and len(set(got)) >= 0.98 * len(expected)
    assert near.found(pages(spark, rows).limit(0)).count() == 0


def test_min_and_max_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    factors, offsets = near._permutations()
    x, y = (near.min_max(np.unique(np.concatenate([both, s])), factors, offsets) for s in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.15


# p2, p5, p6, p10


RESIDUE = [
    ("Fine", PROSE * 4, False),
    ("Fine", PROSE + "Dear {{ user.name }}, welcome. " + PROSE, True),
    ("%%headline%%", PROSE * 4, True),
    ("Fine", PROSE + "A pattern like ${name} in the guide stands for the value. " + PROSE, False),
    ("Fine", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", True),
    ("Fine", "Printers used dummy Latin, lorem and ipsum and so on, to fill the page before the words came.", False),
    ("Not found", "The page you asked for could not be found.", True),
    ("Fine", "Please enable JavaScript to view this page.", True),
    ("Fine", "If the login screen says access denied, the old key is lost. " + PROSE * 4, False),
    ("Wartung", "Hier wird gebaut, wir sind bald zurück.", True),
    ("Fine", "", False),
    (None, None, False),
]


def test_residue(spark):
    rows = [{"page_id": k, "url": f"https://site.example/a/old-lamp-{k}", "domain": "site.example", "title": t, "body_text": b} for k, (t, b, _) in enumerate(RESIDUE)]
    found = {r.page_id for r in residue.found(pages(spark, rows)).collect()}
    assert found == {k for k, (_, _, expected) in enumerate(RESIDUE) if expected}


def test_responses_that_many_hosts_give(spark):
    """No word of these notices is on a list: that several hosts answer so is what tells, for long responses too."""
    said = "Our kettle is resting. Ring the bell and come again (code 4711)."
    own = [f"The {w} of {w} was {w}er than the {w} we knew. It {w}s well." for w in ("larb", "mord", "quil", "sten", "trov", "vash")]
    rows = [{"page_id": k, "url": f"https://h{k % 3}.example/a/thin-lamp-{k}", "domain": f"h{k % 3}.example", "title": f"Lamp {k}", "body_text": f"{said.replace('4711', str(k * 97))}"} for k in range(9)]
    rows += [{"page_id": 20 + k, "url": f"https://h{k % 3}.example/a/{own[k].split()[1]}", "domain": f"h{k % 3}.example", "title": own[k].split()[1], "body_text": own[k]} for k in range(6)]
    rows.append({"page_id": 40, "url": "https://h1.example/a/grey-door", "domain": "h1.example", "title": "Door", "status": 503, "body_text": f"{said}\n" * 9})
    rows.append({"page_id": 41, "url": "https://h1.example/a/grey-door-2", "domain": "h1.example", "title": "Door", "body_text": f"{said}\n{PROSE * 9}"})
    table = pages(spark, rows + rows[:2])
    got = {r.page_id: r for r in residue.evidence(table).collect()}
    assert {k for k, r in got.items() if r.excluded} == {*range(9), 40}
    assert got[0].addresses == 9 and got[0].hosts == 3 and not got[0].noted and got[40].familiar == 1.0 and got[41].familiar < 0.5


@pytest.mark.parametrize("line", ["blah, blah, blah.", "Lorem, ipsum, dolor, sit, amet.", '"Lorem ipsum"', "lorem-ipsum", "foo/bar/baz"])
def test_filler_among_punctuation(line):
    assert residue.is_filler(line) and not residue.is_filler(f"They wrote {line} over the door of the mill.")


def test_residue_table(spark):
    rows = [{"page_id": 1, "title": "[[brand]]", "body_text": PROSE}, {"page_id": 1, "title": "[[brand]]", "body_text": PROSE}, {"page_id": 2, "domain": None, "title": None, "body_text": "x" * 100_000}, {"page_id": None, "title": "{{x}}"}]
    assert [r.page_id for r in residue.found(pages(spark, rows)).collect()] == [1]
    assert residue.found(pages(spark, rows).limit(0)).count() == 0


def furnished(k):
    name = f"x{chr(97 + k) * 3}"
    body = ["Home | Shop | Blog | Contact", f"{PROSE * 2}Part {name}.", f"Chapter of the mill {name}", f"{PROSE}Again {name}.", "Others also viewed", f"The road to town {k + 40}", "Write to the keeper of this place", "© 2024 Site. All rights reserved."]
    return {"page_id": k, "title": f"Mill {k}", "body_text": "\n".join(body)}


def test_main_content(spark):
    rows = [furnished(k) for k in range(1, 21)] + [furnished(3), {"page_id": 50, "body_text": None}, {"page_id": 51, "domain": None, "body_text": PROSE}]
    got = {(r.page_id, r.line_no) for r in maincontent.found(pages(spark, rows)).collect()}
    assert got == {(k, n) for k in range(1, 21) for n in (1, 5, 6, 7, 8)}
    text = {r.page_id: r for r in maincontent.main_body(pages(spark, rows)).collect()}
    assert text[7].main_text == "\n".join(furnished(7)["body_text"].split("\n")[1:4]) and text[7].main_word_count == len(text[7].main_text.split())
    assert maincontent.found(pages(spark, rows).limit(0)).count() == 0


def test_main_content_without_carried_keys(spark, monkeypatch):
    table = pages(spark, [furnished(k) for k in range(1, 21)])
    carried = sorted(map(tuple, maincontent.found(table).collect()))
    monkeypatch.setattr(maincontent, "CARRIED_KEYS", -1)
    monkeypatch.setattr(maincontent, "HOST_PART", 6)
    assert sorted(map(tuple, maincontent.found(table).collect())) == carried


def test_layout_renders_markup():
    html = "<html><head><title>t</title><style>x</style></head><body><p>one<p>two <b>three</b><ul><li>a<li>b</ul><ol><li>c</ol><table><tr><td>x long<td>y<tr><td>z<td><p>q<p>r</table><div hidden>no</div><script>no</script><pre> k\n  l</pre></body></html>"
    assert [b.text for b in layout.render(html)] == ["one", "two three", "- a", "- b", "1. c", "x long  y", "z       q r", " k", "  l"]
    assert [b.text for b in layout.blocks("a\n\nb < c")] == ["a", "", "b < c"]
    roles = layout.blocks("Intro<div><nav><p>Home</p></nav><main><header><h1>Top</h1></header><p>Text</p><ul><li>x</li></ul><aside>See</aside></main><footer><p>Foot</p></footer></div><div role=banner><p>B</p></div>")
    assert [(b.text, b.role) for b in roles] == [("Intro", ""), ("Home", "outside"), ("Top", "heading"), ("Text", ""), ("- x", "list"), ("See", "outside"), ("Foot", "outside"), ("B", "outside")]
    assert not layout.is_markup("Write <p> before and </p> after the text.") and layout.blocks("<p>a</p><p>b")[1].text == "b"


def test_main_content_of_markup(spark):
    """Where the body is markup, rendering decides: no block recurs here and no word is on a list."""
    html = "<html><body><nav><p>Larb</p><p>Mord</p></nav><main><h1>Quil</h1><p>The sten was trov.</p><table><tr><td>vash</td><td>1</td></tr><tr><td>k</td><td>22</td></tr></table></main><aside><p>Zint</p></aside><footer>Wexo</footer></body></html>"
    table = pages(spark, [{"page_id": 1, "body_text": html}, {"page_id": 1, "body_text": html}])
    assert {(r.line_no, r.evidence) for r in maincontent.page_blocks(table).collect()} == {(k, "layout") for k in (1, 2, 7, 8)}
    assert [(r.main_text, r.main_word_count) for r in maincontent.main_body(table).collect()] == [("Quil\nThe sten was trov.\nvash  1\nk     22", 9)]


HARD = "Organisational sustainability necessitates multidimensional characterisation, notwithstanding administrative heterogeneity. "


def test_reading_levels(spark):
    rows = [{"page_id": k, "body_text": f"{PROSE * 6}It is day {k}."} for k in range(30)] + [{"page_id": 100 + k, "body_text": f"{HARD * 5}Incomprehensibility {k}."} for k in range(30)]
    rows += [rows[0], {"page_id": 200, "body_text": None}, {"page_id": 201, "body_text": "слова и дела " * 30}, {"page_id": 202, "body_text": ""}, {"page_id": 203, "body_text": "word " * 5000}]
    table = pages(spark, rows)
    got = {r.page_id: r for r in reading.levels(table).collect()}
    assert len(got) == 63 and got[201].difficulty is None and got[203].level is None and got[202].settled_by is None
    assert got[101].difficulty < 10 < 60 < got[1].difficulty
    exact = {r["page_id"] for r in rows if (ease := reading.reading_ease(r["body_text"])) is not None and ease < 30}
    found = {r.page_id for r in reading.found(table).collect()}
    assert sorted(found) == sorted(exact) and exact == set(range(100, 130))
    assert reading.found(table.limit(0)).count() == 0


def test_reading_without_models_is_left_to_the_formula(spark, monkeypatch):
    table = pages(spark, [{"page_id": k, "body_text": (HARD if k % 2 else PROSE) * 9} for k in range(8)])
    monkeypatch.setattr(reading, "train", lambda texts: None)
    assert {(r.settled_by, r.band) for r in reading.levels(table).collect()} == {("formula", None), ("formula", "readability_very_difficult")}
    assert {r.page_id for r in reading.found(table).collect()} == {1, 3, 5, 7}


def test_models_settle_most_pages_rightly(spark, sf_dir):
    """Held-out accuracy: of all pages, most are settled by models that saw at most SAMPLE_PAGES, none wrongly."""
    table = spark.read.parquet(f"{sf_dir}/page_data.parquet")
    rows = reading.levels(table).join(table.select("page_id", "body_text").dropDuplicates(["page_id"]), "page_id").where("settled_by is not null").collect()
    assert sum(r.settled_by == "models" for r in rows) > 0.4 * len(rows)
    for r in rows:
        ease = reading.reading_ease(r.body_text)
        assert (r.band is not None) == (ease < 30) and (r.band == "readability_very_difficult") == (ease < 10)


def test_quality(spark):
    prose = [(k, f"{PROSE * 3}\nIt was the {k}th day of the year, and nobody in the town had seen it.", "en") for k in range(60)]
    junk = [(100 + k, "\n".join(f"- red fox ({k + i})" for i in range(20)), None) for k in range(20)]
    odd = [(200, None, "en"), (201, "", None), (202, " \n ", "xx"), (203, (PROSE * 3).upper(), "en"), (204, (PROSE * 2000), "en"), (1, prose[1][1], "en")]
    table = spark.createDataFrame([(*r, 1.0) for r in prose + junk + odd], "doc_id long, text string, lang string, distance double")
    found = sorted(r.doc_id for r in quality.found(table).collect())
    assert found == list(range(100, 120))
    rows = quality.outlierness(table).collect()
    assert len(rows) == len(prose + junk + odd)
    for r in rows:
        assert (r.statistics is None) == (r.distance is None)
        if r.distance is not None:
            assert abs(sum(r.contributions) - r.distance**2) < 1e-6 * max(1, r.distance**2)
            assert r.is_prose == (r.distance <= quality.CUTOFF) and max(r.contributions) == r.contributions[quality.STATISTICS.index(r.led_by)]
    assert quality.found(table.limit(0)).count() == 0
