"""Terms in a table against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from jobtide.functions import texts
from jobtide.operators import places


def made(draw, n):
    words = ["geneva", "zurich", "lausanne", "st gallen", "la chaux de fonds", "rapperswil jona am zuerichsee", "la", "a", "bern", "frankfurt am main flughafen nord"]
    out = set()
    for _ in range(n):
        s = list(draw.choice(words) + draw.choice(["", "", " ch", " sud"]))
        for _ in range(draw.choice([0, 1, 2, 3])):
            k = draw.randrange(len(s)) if s else 0
            how = draw.randrange(4)
            if how == 0:
                s.insert(k, draw.choice("abez "))
            elif how == 1 and s:
                del s[k]
            elif how == 2 and s:
                s[k] = draw.choice("aeiou")
            elif how == 3 and k + 1 < len(s):
                s[k], s[k + 1] = s[k + 1], s[k]
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 2])
def test_table_of_terms_is_all_pairs(spark, most):
    draw = random.Random(most)
    p, t = made(draw, 160), made(draw, 60)
    table = spark.createDataFrame([(x, 1) for x in [*p, "GENÈVE!", None, "", " - "]], "place string, n int")
    terms = spark.createDataFrame([(x,) for x in [*t, "Genève", "Genève", None, "", "--"]], "term string")
    found = {tuple(r) for r in places.matching_table(table, "place", terms, "term", most).collect()}
    every, wanted = [*p, "geneve"], [*t, "geneve"]
    plain = lambda s: " ".join(s.split())
    want = set()
    for a in every:
        for b in wanted:
            x, y = plain(a), plain(b)
            if x and y and (x in y or y in x or texts.osa_distance(x, y, most) <= most):
                want.add(("GENÈVE!" if a == "geneve" and a not in p else a, "Genève" if b == "geneve" and b not in t else b))
    lost, more = want - found, found - want
    assert not {x for x in lost} and all("GENÈVE!" in x or "Genève" in x for x in more)


def test_candidates_are_few(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(5, 30)))
    p = spark.createDataFrame([(word(),) for _ in range(1500)], "p string").distinct()
    t = spark.createDataFrame([(word(),) for _ in range(500)], "t string").distinct()
    assert places.near_candidates(p, t, 2).count() < 0.002 * 1500 * 500
    assert places.held_candidates(t, p, "t", "p").count() < 0.01 * 1500 * 500


def test_rows_at_places_of_a_table(spark):
    df = spark.createDataFrame([(1, ["Geneva", "Rome"]), (2, ["Gneeva area"]), (3, []), (4, None), (5, ["Gneva"])], "id int, places array<string>")
    terms = spark.createDataFrame([("GENÈVA",), (None,)], "term string")
    assert {r["id"] for r in places.at_places(df, "places", terms).collect()} == {1, 5} == {r["id"] for r in places.at_places(df, "places", ["GENÈVA"]).collect()}
    assert places.at_places(df, "places", terms.where(F.lit(False))).count() == 5
