"""What is told of a table follows the table."""

from siltmark.operators import disclosures


def test_indices_tell_what_they_lack(spark):
    t = spark.createDataFrame([(0.4, None, 10.0), (None, None, 20.0)], "pct_renter double, poverty_rate double, median_income double")
    got = {(r["index"], r.indicator): r for r in disclosures.index_composition(t).collect()}
    assert len(got) == len(disclosures.VULNERABILITY) + len(disclosures.ADAPTIVE_CAPACITY)
    assert got["vulnerability", "pct_renter"].used and got["vulnerability", "pct_renter"].known == 1 and got["vulnerability", "pct_renter"].reason is None
    assert got["vulnerability", "poverty_rate"].reason == "known for no row" and got["adaptive_capacity", "pct_owner"].reason == "not in the table"
    assert (got["vulnerability", "median_income"].sign, got["adaptive_capacity", "median_income"].sign) == (-1, 1)
    assert not any(r.used for r in disclosures.index_composition(t.limit(0)).collect())


def test_notes_count_what_is_there(spark):
    t = spark.createDataFrame([(0.1,), (0.3,), (0.9,), (None,)], "pct_18_24 double")
    one = disclosures.confound_note(t, "pct_18_24").first()
    assert (one.flagged, one.known, one.threshold) == (2, 3, 0.3) and one.note.startswith("2 of 3 zones")
    none = disclosures.confound_note(t, "other").first()
    assert (none.flagged, none.known) == (0, 0) and "not known" in none.note
    lambdas = spark.createDataFrame([("density", 1.5), ("density", 2.5), ("slope", 9.0)], "feature string, lambda double")
    told = disclosures.coupling_note(lambdas, "density").first()
    assert (told.replicates, told["mean"], told.least, told.most) == (2, 2.0, 1.5, 2.5) and "2.000 over 2 fits (1.500 to 2.500)" in told.note
    assert disclosures.coupling_note(lambdas, "twi").first().replicates == 0


def test_reasons_name_the_kept_partner(spark):
    dropped = spark.createDataFrame([("tri", "pearson"), ("flow", "vif"), ("alone", "vif")], "layer string, stage string")
    pairs = spark.createDataFrame([("slope", "tri", 0.97), ("flow", "tri", 0.99), ("flow", "twi", -0.7), ("slope", "flow", 0.7), ("alone", "twi", None)], "a string, b string, r double")
    got = {r.layer: r for r in disclosures.screening_reasons(dropped, pairs).collect()}
    assert (got["tri"].partner, got["tri"].reason) == ("slope", "pairwise correlation (r = 0.970 with slope, which is kept)")
    assert got["flow"].partner == "slope" and got["flow"].reason.startswith("variance inflation (r = 0.700 with slope")
    assert got["alone"].partner is None and got["alone"].reason == "multicollinearity screening"
