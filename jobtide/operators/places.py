"""Places: fuzzy filters by location (FLT-9, JOIN-6), for a list of terms and for a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import texts
from jobtide.operators.stored import stored

#: Code points up to which what is left after deletions is indexed; longer strings are indexed by segments.
SHORT = 20
GRAM = 3


def matching(places: DataFrame, place: str, terms: list[str], most: int = 2) -> DataFrame:
    """place, term for each distinct value of a column that a term matches: one holds the other, or few edits apart.

    Both are normalised (STR-3); empty ones match nothing. terms: a fixed list of the caller. Distinct values, not rows,
    are compared, and Python sees only pairs whose edit distance without swaps does not rule them out.
    """
    wanted = [t for t in dict.fromkeys(terms) if t and t.strip()]
    distinct = places.select(F.col(place).alias("place")).where(F.col(place).isNotNull()).distinct()
    pairs = distinct.select("place", texts.norm(F.col("place")).alias("p"), F.explode(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")).alias("term"))
    pairs = pairs.withColumn("t", texts.norm(F.col("term"))).where("p <> '' AND t <> ''")
    held = F.col("p").contains(F.col("t")) | F.col("t").contains(F.col("p"))
    return pairs.where(held | texts.within_distance(F.col("t"), F.col("p"), most)).select("place", "term")


def _left(x: Column, most: int) -> Column:
    """What is left of a string after up to `most` deletions, each once."""

    def less(s):
        some = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        return F.when(F.length(s) > 0, some).otherwise(F.array().cast("array<string>"))

    level = every = F.array(x)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def near_candidates(p: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """p, t: all pairs within `most` edits (a swap of neighbours is one), and some others. p, t: one column of distinct strings each.

    Short strings meet if they have something in common after as many deletions on either side. Of 2 * most + 1 segments of a
    longer string one is whole in the other (a swap spoils two at most), moved by `most` places at most.
    """
    def gone(df, c):
        return df.where(F.length(c) <= SHORT + most).select(c, F.explode(F.transform(_left(F.col(c), most), lambda s: F.xxhash64(s))).alias("h")).distinct()

    short = gone(p, "p").join(gone(t, "t"), "h").select("p", "t")
    n = 2 * most + 1
    edge = lambda i, size: F.floor(i * size / n).cast("int")

    def cut(s, size, i, moved):
        begin = edge(i, size) + moved
        width = edge(i + 1, size) - edge(i, size)
        whole = (begin >= 0) & (begin + width <= F.length(s))
        return F.when(whole, F.struct(size.alias("size"), i.alias("i"), F.substring(s, begin + 1, width).alias("s")))

    parts, moves = F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.lit(-most), F.lit(most))
    far = lambda df, c: df.where(F.length(c) > SHORT)
    index = far(t, "t").select("t", F.explode(F.transform(parts, lambda i: cut(F.col("t"), F.length("t"), i, F.lit(0)))).alias("e")).select("t", "e.*")
    of_size = lambda d: F.flatten(F.transform(parts, lambda i: F.transform(moves, lambda m: cut(F.col("p"), F.length("p") + d, i, m))))
    probes = F.filter(F.flatten(F.transform(moves, of_size)), lambda e: e.isNotNull())
    probe = far(p, "p").select("p", F.explode(F.array_distinct(probes)).alias("e")).select("p", "e.*")
    return short.unionByName(probe.join(index, ["size", "i", "s"]).select("p", "t")).distinct()


def held_candidates(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: all pairs of which the string of `outer` (column b) holds that of `inner` (column a), and some others.

    Both are cut into grams of three (a shorter inner string is a gram itself); an inner string looks for its rarest gram.
    """
    def grams(s, size):
        last = F.length(s) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, size))).otherwise(F.array().cast("array<string>"))

    own = inner.select(a, F.explode(grams(F.col(a), F.least(F.length(a), F.lit(GRAM)))).alias("g")).distinct()
    sizes = F.array_distinct(F.flatten(F.array(*(grams(F.col(b), F.lit(k)) for k in range(1, GRAM + 1)))))
    theirs = outer.select(b, F.explode(sizes).alias("g")).join(own.select("g").distinct(), "g", "left_semi")
    counts = theirs.groupBy("g").agg(F.count("*").alias("n"))
    missing = own.join(counts, "g", "left").groupBy(a).agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return missing.where("all").select(a, "g").join(theirs, "g").select(a, b)


def matching_table(places: DataFrame, place: str, terms: DataFrame, term: str, most: int = 2) -> DataFrame:
    """place, term: matching() for a table of terms of any size; candidates meet by equality and are then verified."""
    named = lambda df, c, n: df.select(F.col(c).alias(n)).where(F.col(n).isNotNull()).distinct().withColumn(n[0], texts.norm(F.col(n))).where(F.col(n[0]) != "")
    every, wanted = stored(named(places, place, "place")), stored(named(terms, term, "term"))
    p, t = every.select("p").distinct(), wanted.select("t").distinct()
    close = near_candidates(p, t, most).where(texts.within_distance(F.col("t"), F.col("p"), most))
    held = held_candidates(t, p, "t", "p").unionByName(held_candidates(p, t, "p", "t"))
    held = held.where(F.col("p").contains(F.col("t")) | F.col("t").contains(F.col("p")))
    pairs = close.select("p", "t").unionByName(held.select("p", "t")).distinct()
    return pairs.join(every, "p").join(wanted, "t").select("place", "term")


def at_places(df: DataFrame, locations: str, terms: list[str] | DataFrame, most: int = 2) -> DataFrame:
    """FLT-9: the rows of df of whose locations (an array) any matches any term; without terms all rows.

    terms: a list, or a table with one column.
    """
    if not isinstance(terms, list):
        some = terms.where(texts.norm(F.col(terms.columns[0])) != "").limit(1).count()
    else:
        some = any(t and t.strip(" -_/.,;") for t in terms)
    if not some:
        return df
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))  # both readings must see the same numbers
    found = rows.select(F.explode(locations).alias("place"))
    good = matching(found, "place", terms, most) if isinstance(terms, list) else matching_table(found, "place", terms, terms.columns[0], most)
    kept = rows.select("_row", F.explode(locations).alias("place")).join(good.select("place").distinct(), "place").select("_row").distinct()
    return rows.join(kept, "_row", "left_semi").drop("_row")
