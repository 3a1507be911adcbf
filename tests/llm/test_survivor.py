import datetime as dt

from quillspark.llm import survivor as S

SCHEMA = "record_id long, arxiv_id string, venue string, citation_count int, source string, submitted_date string, fetched_at timestamp_ntz, ingested_at timestamp_ntz, field string"
SOURCES = [("Publisher Feed", 1, "api", True), ("Semantic Scholar", 3, "api", True), ("arXiv", 4, "feed", False), ("Web Crawl", 8, "crawl", True)]
VENUES = [(1, "International Conference on Xeric Retrieval", None), (2, "Advances in Meridian Simulation", "AMSI")]


def run(spark, rows):
    data = [(i, a, v, c, s, "2014-02-03", dt.datetime(2020, 1, 1) + dt.timedelta(days=t), None, "clash") for i, a, v, c, s, t in rows]
    sources = spark.createDataFrame(SOURCES, "source_name string, trust_rank int, kind string, gives_counts boolean")
    venues = spark.createDataFrame(VENUES, "venue_id long, canonical_name string, short_name string")
    got = S.field_survivors(spark.createDataFrame(data, SCHEMA), sources, venues).collect()
    assert len({(r.arxiv_id, r.field) for r in got}) == len(got)
    return {(r.arxiv_id, r.field): r.record_id for r in got}


def test_fields(spark):
    got = run(
        spark,
        [
            (1, "1402.1", "AMSI", 5, "Web Crawl", 0),
            (2, "1402.1", "Advances in Meridian Simulation", 2014, "Semantic Scholar", 10),
            (3, "1402.1", "Adv. in Merid. Simulation", 7, "publisher_feed", 20),
            (4, "1402.1", "Advances in Meridian Simulatin", 0, "arXiv", 30),
            (5, "1402.1", "Advances in Meridian Simulation", 9, "Publisher Feed", 40),
            (6, "1402.1", None, 99999999, "arXiv", 50),
            (7, "1402.1", "see comments", 20141, "S2", 60),
        ],
    )
    assert got == {("1402.1", "venue"): 2, ("1402.1", "citation_count"): 5, ("1402.1", "source"): 5}


def test_places_and_gaps(spark):
    got = run(
        spark,
        [
            (1, "a", "Advances in Meridian Simulation", None, "Web Crawl", 0),
            (2, "a", "International Conference on Xeric Retrieval", -1, "Semantic Scholar", 9),
            (3, "b", "under review", None, None, 0),
            (4, "b", "", None, "unknown", 1),
            (5, "c", "Advances in Meridian Simulation", 3, "arXiv", 1),  # a single row is no group
            (6, None, "x", 1, "arXiv", 1),
            (7, None, "x", 1, "arXiv", 1),
            (8, "d", "Forum for Ivory Hydrology", 0, "Web Crawl", 3),
            (9, "d", "FORUM FOR IVORY HYDROLOGY", 4, "arXiv", 4),
            (10, "d", "Forum for Ivory Hydrology", 0, "Web Crawl", 3),
        ],
    )
    assert got == {("a", "venue"): 2, ("a", "source"): 2, ("d", "venue"): 8, ("d", "source"): 9, ("d", "citation_count"): 8}


def test_ordinary_counts(spark):
    got = run(spark, [(1, "1402.1", None, 1980, "Web Crawl", 0), (2, "1402.1", None, 2014, "Web Crawl", 5), (3, "2001.2", None, 2, "Web Crawl", 9), (4, "2001.2", None, 2000, "Web Crawl", 10)])
    assert got[("1402.1", "citation_count")] == 2  # the year, but in proportion to what came before
    assert got[("2001.2", "citation_count")] == 3


def test_many_values_of_one_place(spark):
    """A group with more values than one task aligns takes the salted way, to the same result."""
    rows = [(i, "a", f"Advances in Meridian Simulation, vol. {i}", None, "Web Crawl", i % 9) for i in range(10, 400)] + [(500 + i, "a", "Advances in Meridian Simulation", None, "Publisher Feed", 9) for i in range(3)]
    assert run(spark, rows)[("a", "venue")] == 500


def test_empty(spark):
    assert run(spark, [(1, "z", None, None, None, 0)]) == {}


def test_alignment():
    cols = S.profile([("Annals of Thermal Genomics", 1.0), ("Anls. Therm. Genomics 2019", 2.0), ("The Annals of Thermal Genomics", 0.5)])
    assert " ".join(S.consensus(cols)) in ("Annals of Thermal Genomics", "Annals Thermal Genomics")
    assert S.distance("a b", ["a", "b"]) == 0 < S.distance("a  b", ["a", "b"]) < S.distance("a c", ["a", "b"])


def test_cut_names_vote_for_the_whole():
    few = [{"venue": "Velvet Mechan", "weight": 9.0, "first": 1}, {"venue": "Velvet Mechanics Roundtable", "weight": 1.0, "first": 2}, {"venue": "Velvet Mechanics Roundtable 2013", "weight": 1.0, "first": 3}]
    kept = S.whole(few)
    assert [x["first"] for x in kept] == [2, 3] and sum(x["weight"] for x in kept) == 11.0
    assert S.whole([{"venue": "Summer School on ", "weight": 1.0, "first": 1}, {"venue": "summer school on Rustic Ontology", "weight": 1.0, "first": 2}])[0]["first"] == 2
    assert len(S.whole(few[1:])) == 2 and len(S.whole(few[:1])) == 1


def test_both_ways_choose_the_same_record(spark, monkeypatch):
    """Cut values, abbreviations and slips, with and without a canonical name, collected or streamed."""
    t = "Advances in Meridian Simulation"
    typed = ["Advances in Meridian Simul", "Advances in Meridian Si", "Advances in ", "Adv. in Merid. Simulation", "Advances in Meridian Simulatin", t + " 2019", t.upper(), "Advances  in Meridian Simulation"]
    loose = ["Forum for Ivory Hydrolo", "Forum for Ivory Hydrology", "Forum for Ivory Hydrology", "Forum for Iv", "Forum for", "Frm. for Ivory Hydrol.", "FORUM FOR IVORY HYDROLOGY 12", "Forum for Ivry Hydrology"]
    rows = [(i, "a", v, None, "Publisher Feed" if i < 2 else "Web Crawl", 30 - i) for i, v in enumerate(typed)] + [(20 + i, "b", v, None, "Publisher Feed" if i < 1 else "Web Crawl", 40 - 9 * i) for i, v in enumerate(loose)]
    few = run(spark, rows)
    monkeypatch.setattr(S, "GROUP_VALUES", 1)
    assert run(spark, rows) == few and few[("b", "venue")] == 21


def test_values_that_agree_outvote_the_list():
    """The list's name is one voter: a single value's extra word is not taken over, that of several is."""
    name, longer = "Annals of Thermal Genomics", "Annals of Applied Thermal Genomics"
    one = S.consensus(S.profile(S.voters([(longer, 1.0)], name)))
    many = S.consensus(S.profile(S.voters([(longer, 1.0), (longer + " 2019", 1.0), (longer.upper(), 1.0)], name)))
    assert one == name.split() and many == longer.split()


def test_places_outside_the_list_are_told_apart(spark):
    """Two unlisted places of one group are not mixed: the more recent and trusted one wins, by its best written value."""
    rows = [(1, "a", "Forum for Ivory Hydrology", None, "Web Crawl", 1), (2, "a", "Forum for Ivory Hydrology", None, "Web Crawl", 2), (3, "a", "Velvet Ontology Roundtab", None, "Publisher Feed", 8), (4, "a", "Velvet Ontology Roundtable", None, "Publisher Feed", 9)]
    assert run(spark, rows)[("a", "venue")] == 4
    assert S.unlisted("Forum for Iv") == S.unlisted("Frm. for Ivory Hydrol. 12") != S.unlisted("Velvet Ontology")


def test_columns_of_one_token_are_voted_on(spark):
    """Every distinct token votes once with its weight; weight 0 is no vote; equal votes go to the larger token; counts of rows decide nothing."""
    rows = [("a", 5, 0.5, 100, 7), ("a", 9, 0.7, 1, 8), ("a", 3, 0.7, 1, 9), ("b", 1, 0.0, 4, 1), ("c", 2, 1e-200, 1, 2), ("c", None, 0.0, 1, 3)]
    got = {r.arxiv_id: tuple(r)[1:] for r in S.column_vote(spark.createDataFrame(rows, "arxiv_id string, token int, weight double, n int, first long")).collect()}
    assert got == {"a": (102, 9, 8), "b": (4, None, None), "c": (2, 2, 2)}
