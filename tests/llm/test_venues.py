import pytest

from quillspark.llm.venues import VenueIndex, map_venues, weighted_damerau

ROWS = [(1, "International Conference on Xeric Retrieval", None), (2, "Advances in Meridian Simulation", "AMSI"), (3, "Annals of Thermal Genomics", "ATGEN"), (4, "Archives of Thermal Genomics", None), (5, "Granular Simulation Letters", "GSLET")]
INDEX = VenueIndex(ROWS)


@pytest.mark.parametrize(
    "typed, meant",
    [
        ("International Conference on Xeric Retrieval", 1),
        ("  international conference ON xeric retrieval. ", 1),
        ("Int'l Conf. Xeri. Retr.", 1),
        ("Proceedings of the 24th Intl. Cnf. on Xeric Retrieval", 1),
        ("Internaitonal Conference on Xerc Retrieval, Lower Tesk, 2021", 1),
        ("Xeric Retrieval, International Conference on", 1),
        ("Xeric Retrieval (International Conference on)", 1),
        ("<i>Advances in Meridian Simulation</i>", 2),
        ("amsi2023", 2),
        ("AMSI'23", 2),
        ("In AMSI 2018", 2),
        ("2021 AMSI", 2),
        ("Advances_in_Meridian_Simulation, vol. 3, pp. 1-9", 2),
        ("Anls. of Therm. Genom.", 3),
        ("Archs. of Thermal Genomics", 4),
        ("Granular Simulation Lett.", 5),
        ("Colloquium on Velvet Cartography", 0),
        ("Annals of Thermal Robotics", 0),
        ("International Conference on", 0),
        ("under review", 0),
        ("-", 0),
        ("x" * 5000, 0),
    ],
)
def test_lookup(typed, meant):
    assert INDEX.lookup(typed) == meant


def test_ties_go_to_the_frequent_or_to_none():
    rows = [(1, "Annals of Tidal Logic", None), (2, "Annals of Zonal Logic", None)]
    assert VenueIndex(rows).lookup("Annals of Tonal Logic") == 2
    assert VenueIndex([(1, "Annals of Tidal Logic", None), (2, "Annals of Tical Logic", None)]).lookup("Annals of Tital Logic") == 0
    assert VenueIndex([(1, "Annals of Tidal Logic", None), (2, "Annals of Tical Logic", None)], {2: 50, 1: 1}).lookup("Annals of Tital Logic") == 2


def test_table(spark):
    records = spark.createDataFrame([(1, "AMSI"), (2, None), (3, ""), (4, "  \t"), (5, "nowhere"), (5, "nowhere"), (6, "Annals of Thermal Genomics")], "record_id long, venue string").selectExpr("*", "'x' as venue_id", "1 as weight")
    venues = spark.createDataFrame([(*r, "k") for r in ROWS] + [(None, "Lost Names", None, "k"), (9, None, None, "k")], "venue_id long, canonical_name string, short_name string, record_id string")
    got = sorted(tuple(r) for r in map_venues(records, venues).collect())
    assert got == [(1, 2), (5, 0), (5, 0), (6, 3)]
    assert map_venues(records, venues.where("false")).where("venue_id <> 0").count() == 0
    assert map_venues(records.where("false"), venues).count() == 0


def test_weights_of_slips():
    """Swapped and doubled letters and neighbouring keys cost less than other slips, first letters more."""
    assert weighted_damerau("thermal", "thermal") == 0
    assert weighted_damerau("thremal", "thermal") == weighted_damerau("therrmal", "thermal") == pytest.approx(0.7)
    assert weighted_damerau("thernal", "thermal") == pytest.approx(0.8) and weighted_damerau("thermel", "thermal") == pytest.approx(0.85)
    assert weighted_damerau("thertal", "thermal") == weighted_damerau("theral", "thermal") == 1.0
    assert weighted_damerau("xhermal", "thermal") == pytest.approx(1.6)
    index = VenueIndex([(1, "Journal of Mapping", None), (2, "Journal of Napping", None)])
    assert index.lookup("Journal of Mappnig") == 1 and index.lookup("Journal of Nappign") == 2
