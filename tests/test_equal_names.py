"""Names of one pattern: equal ones are settled without meeting the others."""

from touchline.operators import entities as EN


def test_equal_names_meet_no_other_name(spark, monkeypatch):
    teams = [(f"t{i}", f"Supplier#{i:09d}", None, "X") for i in range(30)] + [("t0a", "Supplier 000000007", None, None), ("t9a", "Supplier 000000007", None, "X")]
    c = spark.createDataFrame(teams, "canonical_id string, name string, birth_date string, team string")
    m = spark.createDataFrame([("a", str(i), f"Supplier {i:09d}", None, "x") for i in range(30)] + [("a", "near", "Supplier 00000001", None, "x"), ("a", "none", "", None, "x")],
                              "feed string, feed_id string, name string, birth_date string, team string")
    compared, possible = [], EN._possible

    def seen(left, right, block):
        compared.extend(r["target"] for r in left.collect())
        return possible(left, right, block)

    monkeypatch.setattr(EN, "_possible", seen)
    got = {r["feed_id"]: (r["canonical_id"], r["method"]) for r in EN.resolve(m, c, EN.curated(c)).collect()}
    assert set(compared) == {"00000001 supplier", ""}
    # of equal names the least id, also one without a team
    assert {k: got[k][0] for k in map(str, range(30))} == {str(i): "t0a" if i == 7 else f"t{i}" for i in range(30)}
    assert got["near"][1] == "fuzzy" and got["none"] == (None, "unresolved")
