import random

import pytest

from readloom.llm import residue

SCHEMA = "doc_id long, text string, kind string"
# names in wrappers, status lines and the usual filler need no corpus
SURE = [
    "The {{article.title}} was read.", "Some ${NAME} persons", "Byline: %(paper_lead)s", "@@date@@, Oxley", "{% block lead %}", "<%= column %> spoke", "<!-- page_title --> x", "<INSERT_DATE_HERE>", "&lt;INSERT NAME&gt; left", "[[title]] rode",
    "Lorem ipsum dolor sit amet", "404 | Not Found", "ERROR 503 — Service Unavailable", "502 Bad\nGateway", "the title: {page_title} of <title> here",
]
# message templates of an invented page system, as whole pages and among articles
MESSAGES = [
    "The requested {} could not be found on this server.", "Please enable JavaScript to view this {}.", "Fatal error: Allowed memory size exhausted in {}", "You need cookies to open this {}; allow them and reload.", "Interner Fehler beim Laden: {}",
    "ressource demandée est introuvable : {}", "undefined undefined NaN", "** your headline goes here **", "hier Blindtext einfügen bitte sehr", "asdf asdf asdf asdf asdf asdf",
]
THINGS = ["page", "scan", "file", "issue"]
CLEAN = [
    None, "", " \n ", "Name ____________ Address ____________", "[Continued on page 3, column 2.]", "The jury's answer was \"not found\", and 404 sheep were lost.", "Error 337 in the parish accounts was traced.", "Java coffee, 23d.; cookies baked daily by Miss X.",
    "Tallow. Scripts are required from all players.", "He lodged $ 39 and 235% of the rope {so the paper says} with the bank.", "The server at the inn timed out his watch.",
    "SALE! SALE! SALE!", "........ * * * ————", "x" * 500_000, "<|endoftext|>",
]
WORDS = "the vicar of harbour school bridge rope timber coal was not found by his page and server on this file with rain market mill dyke please open to view barley slate quarry lighted cost error in size memory that could be".split()
WORDS += [a + b for a in ("bar", "mol", "ten", "wick", "sul", "gor", "pel", "har", "quen", "tor") for b in ("ham", "ley", "ford", "stow", "ness", "combe", "by", "well", "mere", "ing")]


def news(rng, n=160):
    out = ["NEWS FROM THE HARBOUR"] + [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n // 9)]
    return "\n".join(out)


def corpus(rng, n=640):
    """Pages of news, whole pages of a message and pages with a message inside; the ids of the two latter."""
    pages, residue_ids = [], []
    for i in range(n):
        text = news(rng)
        if i % 8 == 0:
            message = MESSAGES[i // 8 % len(MESSAGES)].format(rng.choice(THINGS))
            lines = text.split("\n")
            text = message if i < n * 3 // 4 else "\n".join([*lines[:3], message, *lines[3:]])
            residue_ids.append(i)
        pages.append((i, text, "z"))
    return pages, residue_ids


@pytest.fixture(scope="module")
def pages():
    return corpus(random.Random(5))


def test_messages_are_induced_and_found_everywhere(spark, pages):
    rows, ids = pages
    got = [r[0] for r in residue.flagged(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert sorted(got) == ids


def test_misread_and_broken_messages(spark, pages):
    rows, ids = pages
    more = ["Tbe requefted fcan could uot be fouud on tbis server", "Please enable Java-\nScript to view this issue", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS SCAN", "Allowed mem-\nory size exhausted in scan"]
    made = [(1000 + i, news(random.Random(i)) + "\n" + t + "\n" + news(random.Random(-i)), "z") for i, t in enumerate(more)]
    got = {r[0] for r in residue.flagged(spark.createDataFrame(rows + made, SCHEMA)).collect()}
    assert got == set(ids) | {1000 + i for i in range(len(more))}


def test_wrappers_status_lines_and_printed_words(spark, pages):
    rows, ids = pages
    made = [(1000 + i, (t + "\n" + news(random.Random(i))) if t and len(t) < 999 and t.strip() else t, "z") for i, t in enumerate(SURE + CLEAN)]
    df = spark.createDataFrame(rows + made, SCHEMA)
    got = {r[0] for r in residue.flagged(df).collect()}
    assert [t for i, t in enumerate(SURE) if 1000 + i not in got] == []
    assert [t for i, t in enumerate(CLEAN) if 1000 + len(SURE) + i in got] == []
    assert {r["doc_id"] for r in residue.clean(df).select("doc_id").collect()} == {r[0] for r in rows + made} - got


def test_seeds_and_wrappers_need_no_other_pages(spark):
    rows = [(i, t, "z") for i, t in enumerate(SURE + CLEAN)]
    assert {r[0] for r in residue.flagged(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(len(SURE)))


def test_words_that_newspapers_use_as_often_are_no_parts(spark, pages):
    rows, ids = pages
    heading = [(2000 + i, "NEWS FROM THE HARBOUR", "z") for i in range(6)]
    parts = residue.learn(spark.createDataFrame(rows + heading, SCHEMA))
    assert parts.short and parts.other and parts.found
    assert not any(residue.reading("news from") in p for p in parts.found)
    assert residue.reading("found on this server") in {p for p in parts.found} | {"".join(p) for p in parts.found}


def test_printed_sentences_that_share_words_with_a_message(spark, pages):
    """A phrase of a message that newspapers print, too, is told by how often they do."""
    rows, ids = pages
    printed = [(3000 + i, news(random.Random(i)) + "\nThe page for Tuesday is missing from the register; it could not be found.\n" + news(random.Random(-i)), "z") for i in range(30)]
    assert {r[0] for r in residue.flagged(spark.createDataFrame(rows + printed, SCHEMA)).collect()} == set(ids)


def test_templates_have_slots(spark, pages):
    rows, _ = pages
    found = {r["template"]: r for r in residue.templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert any("tiie regnesteei" in t and r["n_docs"] > 1 for t, r in found.items())
    assert any(r["n_slots"] and r["n_fillings"] > 1 for r in found.values())


def test_print_brackets_need_names_of_the_corpus(spark):
    rows = [(1, "{{title}} x"), (2, "${title} y"), (3, "the [title] z"), (4, "the [sic] z"), (5, "{{lonely}}"), (6, "[lonely]")]
    got = {r[0] for r in residue.flagged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2, 3, 5}


def test_names_beyond_the_most_frequent_thousand_count(spark):
    rows = [(3 * i + j, f"{{{{{'abcdefghij'[i // 100 % 10]}{i:04d}x}}}} y") for i in range(1100) for j in range(3)]
    rows += [(9000, "{{zrare}}"), (9001, "${zrare}"), (9002, "the [zrare] z"), (9003, "the [sic] z")]
    found = residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 9000")
    assert {r["doc_id"] for r in found.collect()} == {9000, 9001, 9002}


def test_alignment_finds_constant_words_and_slots(spark):
    rows = [(i, f"Title: {{{{page}}}} by {w} today") for i, w in enumerate(["ann", "bob", "cy"])]
    got = {(r["side"], r["place"]): r["word"] for r in residue.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["left", 0] == "Title:" and got["right", 1] == "by" and got["right", 2] is None


def test_empty(spark):
    assert residue.flagged(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("texts", [[None], ["", " "], ["one short page"], ["the same words " * 50] * 4])
def test_corpora_without_two_kinds_of_pages(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert residue.learn(df).found == {}
    assert residue.flagged(df).collect() == []


def test_all_sites_of_a_text(spark):
    rows = [(1, "{{a}} and {{b}} and 404 Not Found, 404 not found; [[c]] <INSERT x> {INSERT y}")]
    got = residue.sites(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["slot"] for r in got if r["kind"] == "name" and r["slot"]) == ["INSERT x", "INSERT y", "a", "b", "c"]
    assert sum(r["kind"] == "status" for r in got) == 2
