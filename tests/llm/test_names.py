import json

import pytest

from quillspark.llm import names as N
from quillspark.llm.names import assigned, name_pairs, parse


@pytest.mark.parametrize(
    "typed, surname, given, initials, middle",
    [
        ("Ada B. Lovelace", "lovelace", "ada", "", "b"),
        ("Lovelace, Ada B.", "lovelace", "ada", "", "b"),
        ("LOVELACE Ada", "lovelace", "ada", "", ""),
        ("Lovelace A", "lovelace", "", "a", ""),
        ("AB Lovelace", "lovelace", "", "ab", ""),
        ("A.Lovelace", "lovelace", "", "a", ""),
        ("Dr. Ada Lovelace, PhD", "lovelace", "ada", "", ""),
        ("Ada Lovelace 1,2", "lovelace", "ada", "", ""),
        ("Ada Lovelace†", "lovelace", "ada", "", ""),
        ("Ada van der Lövelace Jr.", "lovelace", "ada", "", ""),
        ("JÃ¸rn Lovelace", "lovelace", "jorn", "", ""),
        ("AdaLovelace", "lovelace", "ada", "", ""),
        ("Love-lace, A.", "lovelace", "", "a", ""),
    ],
)
def test_parse(typed, surname, given, initials, middle):
    n = parse(typed)
    assert (n.kind, n.surname, n.given, n.initials, n.middle) == ("p", surname, given, initials, middle)


def test_organisations():
    assert parse("the Kamupilt deep field collaboration").kind == "o"
    assert parse("Deeep Field Collaboration (Kamupilt)").kind == "o"
    a = parse("Kamupilt Deep Field Collaboration").tokens
    for other in ("Deeep Field Collaboration (Kamupilt)", "Collaboration for Kamupilt Deep Field", "Kamupilt Deep Field Coll."):
        assert assigned(a, parse(other).tokens) is not None
    assert assigned(a, parse("Kamupilt Ocean Model Collaboration").tokens) is None


def pairs(spark, lists):
    df = spark.createDataFrame([(json.dumps(x) if x is not None else None, "x") for x in lists] + [("", "x"), ("no json", "x")], "authors string, name string")
    return {tuple(r) for r in name_pairs(df).collect()}


def test_links(spark):
    crowd = [[f"{g} {s}"] for g in ("Marta", "Marie", "Anna", "Anne", "Matthew") for s in ("Kolbeck", "Ristano", "Feldin", "Ormask", "Tuvall")]
    people = ["Matthew B. Grenlow", "Matt Grenlow", "Grenlow, M. B.", "Mathew B. Grenlow", "MATTHEW GRENLOW", "Matthew Grenlow Jr.", "Marta Grenlow"]
    got = pairs(spark, crowd + [people, ["Anna Pelvast", "Anne Pelvast", "A. Pelvast"], ["Rosa Kindell", "Rosa Kinndell"], None, [], [" ", "?!"]])
    same = {p for p in got if "Grenlow" in p[0] + p[1] or "GRENLOW" in p[0] + p[1]}
    one = [p for p in people if "Marta" not in p]
    assert same == {tuple(sorted((a, b))) for i, a in enumerate(one) for b in one[i + 1 :]}
    assert ("Rosa Kindell", "Rosa Kinndell") in got
    assert not any("Pelvast" in a and "Pelvast" in b for a, b in got)  # two people; the initial fits both
    assert all(a < b for a, b in got)


def test_empty(spark):
    assert pairs(spark, []) == set()


def test_large_blocks_link_as_small_ones(spark, monkeypatch):
    """Initials, organisations and given names two slips apart in a block beyond the limit."""
    crowd = [[f"{g} {s}"] for g in ("Matthew", "Aleksandr") for s in ("Kolbeck", "Ristano", "Feldin", "Ormask", "Tuvall", "Sindre", "Halpert", "Quade", "Merrow")]
    people = ["Matthew Q. Grenlow", "M. Q. Grenlow", "MQ Grenlow", "Marta Grenlow", "Matt Grenlow", "Aleksandr Grenlow", "Aleksadnrr Grenlow", "Mathew Grenlow", "M. Grenlov", "Matthew Grennlow"]
    orgs = ["Kamupilt Deep Field Collaboration", "Kamupilt Deeep Field Coll.", "Collaboration for Kamupilt Deep Field", "Kamupilt DF Collaboration", "Kamupilt Ocean Model Collaboration"]
    whole = pairs(spark, [*crowd, people, orgs])
    for a, b in (("M. Q. Grenlow", "Matthew Q. Grenlow"), ("Aleksadnrr Grenlow", "Aleksandr Grenlow"), ("Kamupilt Deep Field Collaboration", "Kamupilt Deeep Field Coll."), ("Kamupilt DF Collaboration", "Kamupilt Deep Field Collaboration")):
        assert tuple(sorted((a, b))) in whole
    rows = [(n, p.kind, p.surname, p.particle, p.given, p.initials, p.middle, p.tokens, 9 if p.given in ("matthew", "aleksandr") else 1, 1) for n in [*people, *orgs] for p in [parse(n)]]
    linked = {frozenset(c) for c in N.link_block(rows)}
    monkeypatch.setattr(N, "BLOCK_NAMES", 0)
    assert {frozenset(c) for c in N.link_block(rows)} == linked
    assert pairs(spark, [*crowd, people, orgs]) == whole


def test_organisations_without_caps(spark):
    """Names of many words, a form like the fourth of its group, and an acronym whose shared words are common ones."""
    long = "Kamupilt Revburn Tokamak Ocean Deep Field Polar Data Sensor Imaging Genome Robotics Collaboration"
    turned = "Collaboration " + long.replace(" Collaboration", "").replace("Polar", "Polxr")
    assert assigned(parse(long).tokens, parse(long.upper()).tokens) == 0.0
    assert assigned(parse(long).tokens, parse(turned).tokens) == 0.5
    assert assigned(parse(long).tokens, parse(long.replace("Genome", "Speech")).tokens) is None
    drift = ["Kamupilt Imaging Collaboration", "Kamupilt Imagging Collaboration", "Kamupilt Imagin Collaboration", "Kamupillt Imaging Collaboration", "Kammupillt Imagng Coll. of"]
    rows = [(n, "o", "", "", "", "", "", parse(n).tokens, 0, 9 - i) for i, n in enumerate(drift)]
    assert {frozenset(c) for c in N.link_block(rows)} == {frozenset(drift)}
    crowd = [[f"{x} Survey Team"] for x in ("Revburn", "Novivkark", "Gimamhast")]
    a, b = "Ocean Model Working Group Collaboration Alliance", "OM Working Group Collaboration Alliance"
    got = pairs(spark, [*crowd, [long, long.upper(), turned], [a, b], *[[f"{x} Working Group Collaboration Alliance"] for x in ("Tamer", "Jolvin", "Derel", "Sesol")], ["OM Xi", "Ocean Flow Team", "Ocean Tide Team", "Model Flow Team", "Model Tide Team"]])
    assert (a, b) in got or (b, a) in got
    assert {tuple(sorted(x)) for x in ((long, long.upper()), (long, turned))} <= got


def spelling(typed, uses=5):
    p = parse(typed)
    return (typed, p.kind, p.surname, p.particle, p.given, p.initials, p.middle, p.tokens, uses, 1)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Matthew B. Grenlow", "Grenlow, Matt", True),  # a familiar form, and a word left out
        ("Matthew Grenlow", "M. B. Grenlow", True),
        ("Matthew B. Grenlow", "Matthew C. Grenlow", False),
        ("Matthew Grenlow", "Matthew Grennlow", True),
        ("Matthew Grenlow", "Matt Grennlow", False),  # a familiar form and a slip are too much
        ("Matthew Grenlow", "Matthew van Grenlow", False),
        ("Matthew Grenlow", "Marta Grenlow", False),
        ("A. Grenlow", "Matthew Grenlow", False),
    ],
)
def test_persons_are_assigned_word_by_word(a, b, same):
    assert N.same_person(spelling(a), spelling(b)) is same is N.same_person(spelling(b), spelling(a))


def test_misspelt_given_names_are_rare_ones():
    assert N.same_person(spelling("Mathew Grenlow", 1), spelling("Matthew Grenlow", 9))
    assert not N.same_person(spelling("Marie Grenlow", 8), spelling("Maria Grenlow", 9))


def test_components(spark):
    """Chains longer than a hop, cycles and separate parts."""
    links = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("y", "z"), ("x", "z")]
    got = {r.name: r.root for r in N.components(spark.createDataFrame(links, "name_a string, name_b string")).collect()}
    assert got == {f"n{i}": "n0" for i in range(10)} | {"x": "x", "y": "x", "z": "x"}
    assert N.components(spark.createDataFrame([], "name_a string, name_b string")).count() == 0
