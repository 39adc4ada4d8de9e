"""Privacy operators and measures on small tables."""

import pytest
from pyspark.sql import functions as F

from rillwork.errors import ValidationError
from rillwork.privacy import mask, perturb, suppress, verify


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 21, "a1b", "x"), (2, "Bob", 22, "a2b", "x"), (3, "Cid", 38, "a9b", "y"), (4, "Dan", 39, "a30b", "y"), (5, None, None, None, None), (6, "Eve", 99, "zz", "q")]
    return spark.createDataFrame(rows, "id int, name string, age int, code string, town string").repartition(1)


def column(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_masks(people):
    assert column(mask.mask_round(["age"], 10)(people), "age") == [20, 20, 40, 40, None, 100]
    assert column(mask.mask_round(["code"], 10, "ROUND_UP")(people), "code") == ["a10.0b", "a10.0b", "a10.0b", "a30.0b", None, "zz"]
    assert column(mask.mask_range(["age"], 2)(people), "age") == ["[21,60]", "[21,60]", "[21,60]", "[21,60]", None, "[99,138]"]
    assert column(mask.mask_aggregate(["age"], "MAX", 2)(people), "age") == ["39.0", "39.0", "39.0", "39.0", None, "99.0"]
    assert column(mask.mask_blank(["name"], [1], 0)(people), "name") == ["A**", "B**", "C**", "D**", None, "E**"]
    assert column(mask.mask_blank(["name"], [7], 2)(people), "name") == ["Ann", "Bob", "Cid", "Dan", None, "Eve"]
    assert column(mask.generalize([("name", 3, 2), ("age", 2, 1)])(people), "name") == ["A*", "B*", "C*", "D*", None, "E*"]
    assert mask.generalize([("age", 2, 1)])(people).where("id = 1").first().age == "0.0~49.5"
    assert column(mask.mask_hide(["town"])(people), "town")[0] == "x"
    assert mask.mask_aggregate(["age"])(people.limit(0)).count() == 0
    assert [n for n, _ in mask.lattice({"a": 1, "b": 2})][0] == {"a": 0, "b": 0} and len(mask.lattice({"a": 1, "b": 2})) == 6
    with pytest.raises(ValidationError):
        mask.mask_round(["age"], 0)


def test_suppression(spark, people):
    got = suppress.suppress_small_classes(["town"], k=2)(people)
    assert column(got, "town") == ["x", "x", "y", "y", "*", "*"]
    assert verify.k_anonymity(got, ["town"], 2).first().satisfied
    assert column(suppress.suppress_small_classes(["town"], k=3, ratio=0.2)(people), "town").count("*") == 1
    many = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(999, 10_000.0), (1000, None)], "id int, v double")
    assert column(suppress.reduce_records(["v"])(many), "v")[-2:] == ["*", None]
    assert column(suppress.mask_outliers(["v"], buckets=1)(many), "v")[-2] < 200
    assert suppress.reduce_records(["v"])(many.limit(0)).count() == 0


def test_pseudonyms_round_trip(people):
    table = perturb.pseudonym_table(people, "name", "NUMBER", 1, "k")
    assert table.select("pseudonym").distinct().count() == 5
    hidden = perturb.pseudonymize("name", table=table)(people)
    assert not set(filter(None, column(hidden, "name"))) & set(filter(None, column(people, "name")))
    assert column(perturb.reveal_pseudonyms("name", table)(hidden), "name") == column(people, "name")
    assert column(perturb.pseudonymize("name", manual=[("Ann", "A")])(people), "name")[:2] == ["A", "Bob"]


@pytest.mark.parametrize("mode", ["GCM", "ECB"])
def test_encryption_round_trip(people, mode):
    for derivation in ("SHA1", "SHA512"):
        hidden = perturb.encrypt(["name", "age"], "k", derivation, mode)(people)
        back = perturb.decrypt(["name", "age"], "k", derivation, mode)(hidden)
        assert column(back, "name") == column(people, "name") and column(back, "age")[0] == "21"
    with pytest.raises(ValidationError):
        perturb.derived_key("short")


def test_perturbation_keeps_values(spark, people):
    assert sorted(map(str, column(perturb.rearrange(["age"], ["id"], ratio=1.0)(people), "age"))) == sorted(map(str, column(people, "age")))
    assert column(perturb.rearrange(["age"], ["id"], pairs=[(0, 1)])(people), "age")[:2] == [22, 21]
    assert set(column(perturb.swap_values("name")(people), "name")) == set(column(people, "name"))
    other = spark.createDataFrame([("p",), ("q",)], "o string")
    assert column(perturb.swap_values("name", other)(people), "name") == ["p", "q", "p", "q", None, "p"]
    noisy = perturb.add_noise(["age"], "RANDOM", value=1.0)(people)
    assert all(0 <= b - a < 1 for a, b in zip(column(people, "age"), column(noisy, "age"), strict=True) if a is not None)
    assert all(len(n) == 6 for n in column(perturb.add_noise(["name"], length=3)(people), "name") if n)


def test_measures_of_odd_tables(spark, people):
    empty = people.limit(0)
    assert verify.k_anonymity(empty, ["town"]).first().k is None
    assert verify.t_closeness(people, ["town"], "age").first().t > 0
    assert verify.t_closeness(people.withColumn("one", F.lit(1)), ["one"], "age").first().t == pytest.approx(0)
    assert verify.discernibility(people.withColumn("town", F.lit("*")), ["town"]).first().dm == 36
    assert verify.global_risk(people, ["id"]).first().global_risk == 1.0
