import pytest

from quillspark.llm.residue import RULES, examine, masked, residue, segments

CASES = [
    "We propose {{ title }}, which lowers the error.",
    "Nous [INSERT keyword_1] 320 séquences auprès de 20 sites.",
    "Doi: __nombre del método__",
    "A user study with <first author> confirms the gain.",
    "The gain of %ABSTRACT% is small.",
    "Several of the domains had <<Title>> been used.",
    "The [year goes here] other.",
    "Wir ~BASELINE~ berichten.",
    "提案手法は安定性を5.[題名を入力 ...]5％改善した。",
    "In this paper we present [object Object], which improves X by [object Object].",
    "Title: undefined. Published in undefined.",
    "Dear (null), your paper (null) was submitted.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "blah blah blah results blah blah conclusion blah",
    "Text text text text text.",
    "xx xxxxxx xxx.",
    "Please enable JavaScript to view this article.",
    "Cite Share\nVeuillez activer JavaScript pour afficher cet article.",
    "请启用 JavaScript 以查看本文。",
    "Cookies must be accepted and active content allowed before the PDF viewer starts.",
    "404 Not Found. The requested paper could not be located on this server.",
    "HTTP/1.1 403 Forbidden\nContent-Type: text/plain",
    "SQLSTATE[42] general error: server has gone away",
    "This preprint server is down for planned maintenance until 26:00 UTC.",
    "Replace this paragraph with your own summary before submitting.",
    "Real content stands here. Your abstract goes here. More content follows.",
]
OTHERS = [
    'A page that only says "please enable JavaScript" carries no usable text, so our extractor labels it.',
    "The macro %d prints a counter, and %s prints the name of the molecule.",
    "Maintenance windows explain why 1767 requests in Or-1K failed with an internal server error.",
    "Template engines replace fields such as {{title}} or ${author} at render time.",
    "In our grammar, {x} denotes an optional symbol and [y] a mandatory one.",
    "Placeholders in clinical forms, written as <name> or __date__, are masked before training.",
    "Designers fill unfinished layouts with lorem ipsum, and language identifiers mistake it for Latin.",
    "We crawl 20 scholarly links and find that 3 percent return a 404 status.",
    "An access-denied message is returned to the attacker in every trial.",
    "Cookies and scripts were disabled in the control condition to isolate tokens.",
    "JavaScript programs dominate the corpus; we parse 51 scripts.",
    "Annotators marked a sentence as [unclear] or [sic] in 4 percent of the transcripts.",
    "We set \\frac{a_{i}}{b_{j}} as the weight and bound \\sum_{k} \\alpha_{k} by 0.4.",
    "Gateway time-outs were simulated to test extraction; recovery took seven seconds.",
    "On TorBench, the error falls from 0.48 to 0.21 while variance stays unchanged [12].",
]


@pytest.mark.parametrize("text", CASES)
def test_residue(text):
    assert examine(text)[0]


@pytest.mark.parametrize("text", OTHERS)
def test_no_residue(text):
    assert examine(text) == (False, [])


def test_masks():
    assert masked("Reload in 30 seconds.") == masked("reload  in 4,500 seconds")
    assert masked("Sorry: see http://a.b/c at 10:30") == masked("see www.x.org/y at 11:45.")


def test_documents(spark):
    weak = "Reload the viewer in 30 seconds."
    rows = [(1, CASES[0], "a"), (2, OTHERS[0], "a"), (3, None, "a"), (4, "", "a"), (5, " \n ", "a"), (None, CASES[0], "a"), (6, weak, "a"), (7, "Content. " + weak.replace("30", "45"), "b"), (8, "Go back to the list.", "a"), (9, "Go back to the list.", "a"), (1, CASES[0], None), (10, "word " * 30_000, "c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, sure string")
    assert sorted(r.doc_id for r in residue(df).collect()) == [1, 6, 7]  # 8 and 9 recur at one site only
    assert residue(df.where("false")).count() == 0


def test_long_segments():
    """Pages without sentence ends or line breaks are one segment: opening messages and recurring ones are seen at any length."""
    menu = "home browse archive topics people archive index " * 12
    assert examine("Please enable JavaScript to view this page " + menu)[0]
    assert examine("404 Not Found " + menu)[0]
    assert not examine(menu + "404 Not Found")[0]
    assert examine("Try again later or contact the administrator of this page " + menu)[1]


def test_slots_of_any_name():
    """Template syntax is recognised whatever the field is called; formulas and code in quotes are not."""
    for text in ("Funded under {{ grant_number }}.", "[Insert funding statement here]", "Dear {recipient_name}, your paper was received.", "Signed ${chair.of.session}"):
        assert examine(text)[0], text
    for text in ("We bound \\frac{x_{ij}}{y_{kl}} by one.", 'Engines expand "{{ grant_number }}" late.', "The set {a_1, b_2} is closed.", "We cite [12] and [Lee et al.]."):
        assert not examine(text)[0], text


def test_gates_pass_over_nothing(spark):
    """A rule that is skipped because the strings it requires are missing would not have matched."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    extra = ["Please enable JS to continue.", "This page requires JS.", "ſorry - try again", "OOPS!", "Fehler 404: Seite nicht gefunden"]
    for s in {s for r in rows for s in segments(r.text or "")} | set(extra):
        can = RULES.possible(s)
        for name, patterns in RULES.compiled.items():
            assert RULES.holds(name, can, s) == any(c.search(s) for c in patterns), s
    assert all(RULES.holds("strong", RULES.possible(s), s) for s in extra[:2])


def test_messages_amid_text_count_where_they_recur(spark):
    content = "We study the transport of heat in thin films. The gain is large. It holds for all sizes. "
    one, other = "JavaScript is switched off in this browser for the reading view.", "JavaScript is switched off in this browser, so figures are hidden."
    rows = [(1, content + one, "a"), (2, content + other, "b"), (3, content + "Error 504 Gateway timeout.", "c"), (4, content, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue(df).collect()) == [1, 2]  # by their common opening
    assert residue(df.where("doc_id <> 2")).count() == 0
