"""License scan: license templates found anywhere in a text by the Dice coefficient of word bigrams.

Text is normalised (lower case, runs of anything but letters and digits become one blank), the
distinct word bigrams of a unit are compared to those of each template:
Dice = 2 |A and B| / (|A| + |B|), ``LEAST`` or more is a find.  Units are

* lines and the whole text, so short notices need no exact length,
* passages: strings of as many words as a template has, at any place, over line ends too.

A Dice of ``LEAST`` or more needs |A| between LEAST / (2 - LEAST) and (2 - LEAST) / LEAST times |B|,
so a line or text meets only templates inside these bounds, and needs LEAST / (2 - LEAST) |B| common
bigrams, so it holds one of any |B| - that many + 1 bigrams of the template.  The rarest bigrams of
a template, as many as that, are its anchors: text without an anchor is compared to nothing, and an
anchor in a text lays the template over it, which gives the passages.  Of passages that begin at one
word the best one counts (Dice, then length, then the license's name), and it is a place of the
license unless a better one overlaps it.

Only SQL functions: templates, anchors and their bigrams are literals of a fixed size, every row is judged
by itself, and only finds leave their partition.  Passages that could overlap begin within the longest
template's length of each other, so the work grows linearly with the text.

Null and empty texts and units of fewer than two words match nothing.  Repeated lines and passages count
once per occurrence in ``n_lines`` and ``n_places``.  Rows that repeat a doc_id are added up in one row per license;
rows without an id share the null one.  An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm.license_texts import TEMPLATES
from hydrosheaf.llm.tables import body

LEAST = 0.8
# words that say little about a license: bigrams of other words make the better anchors
COMMON = frozenset("a an and any are as at be by can for from have if in is it may must not of on or that the this to under use with will you your work".split())


def normal(text: Column) -> Column:
    """Lower case, everything but letters, digits and line ends as one blank."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def words_of(plain: Column) -> Column:
    return F.array_remove(F.split(F.translate(plain, "\n", " "), " ", -1), "")


def ordered_bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def all_bigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """Sizes that can reach the Dice coefficient against a set of ``n``."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def anchors(grams: list[str], least: float = LEAST) -> set[str]:
    """Bigrams of which every unit that reaches the Dice coefficient holds one."""
    distinct = set(grams)
    rare = sorted(distinct, key=lambda g: (sum(w in COMMON for w in g.split()), -len(g), g))
    return set(rare[: len(distinct) - bounds(len(distinct), least)[0] + 1])


def lays(templates=TEMPLATES, least: float = LEAST) -> dict[str, list[tuple[int, int]]]:
    """anchor -> (template, place of the anchor in it)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text) in enumerate(templates):
        grams = ordered_bigrams(text)
        chosen = anchors(grams, least)
        for at, g in enumerate(grams):
            if g in chosen:
                out.setdefault(g, []).append((t, at))
    return dict(sorted(out.items()))


def _strings(items) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in items) + ")"


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a transform over an array of one binds it to a name."""
    return F.get(F.transform(F.array(value), use), 0)


def best(words: Column, least: float = LEAST, templates=TEMPLATES) -> Column:
    """struct(dice, license) of the best template of a unit's words, null below ``least``.

    A unit has fewer distinct bigrams than words and at least as many as distinct words less one, so
    bigrams are built only for units that these two counts leave inside some template's bounds.
    """
    sets = [(name, sorted(set(ordered_bigrams(text)))) for name, text in templates]
    low = min(bounds(len(b), least)[0] for _, b in sets)
    high = max(bounds(len(b), least)[1] for _, b in sets)

    def against(grams):
        n = F.size(grams)
        found = []
        for name, b in sets:
            lo, hi = bounds(len(b), least)
            dice = F.when(n.between(lo, hi), 2 * F.size(F.array_intersect(grams, F.expr(_strings(b)))) / (n + len(b)))
            found.append(F.when(dice >= least, F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
        return F.array_max(F.array(*found))

    inside = lambda w: F.when(
        (F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1),
        _named(F.array_distinct(all_bigrams(w)), lambda g: F.when(F.size(g).between(low, high), against(g))))
    return _named(words, inside)


def found(words: Column, least: float = LEAST, templates=TEMPLATES) -> Column:
    """array of struct(g, p): the anchors in an array of words and their places, from 0.

    Pairs of words are put together only behind a word that begins an anchor.
    """
    keys = list(lays(templates, least))
    first = sorted({g.split()[0] for g in keys})
    pair = lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))
    begun = F.filter(F.transform(words, lambda w, i: F.when(w.isin(first), F.struct(pair(w, i).alias("g"), i.alias("p")))), lambda x: x.isNotNull())
    return F.filter(begun, lambda x: x["g"].isin(keys))


def places(texts: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """``texts(_words, _found)`` with ``_places``: array of struct(dice, license, at, n) of the passages found.

    ``at`` is the first word, from 0, ``n`` the number of words.
    """
    grams = [ordered_bigrams(text) for _, text in templates]
    at = lays(templates, least)
    keys = list(at)
    lookup = F.expr("array(" + ", ".join("array(" + ", ".join(f"struct({t} AS t, {off} AS off)" for t, off in at[g]) + ")" for g in keys) + ")")
    sets = F.expr("array(" + ", ".join(_strings(sorted(set(g))) for g in grams) + ")")
    lengths = F.expr("array(" + ", ".join(str(len(g)) for g in grams) + ")")
    names = F.expr(_strings(name for name, _ in templates))
    reach = max(map(len, grams)) + 1

    laid = lambda h: F.transform(
        F.get(lookup, (F.array_position(F.expr(_strings(keys)), h["g"]) - 1).cast("int")), lambda a: F.struct(a["t"].alias("t"), F.greatest(h["p"] - a["off"], F.lit(0)).alias("at")))

    def scored(c):
        mine = F.array_distinct(F.slice("_grams", c["at"] + 1, F.get(lengths, c["t"])))
        return _named(mine, lambda m: F.struct(
            c["at"].alias("at"), (-2.0 * F.size(F.array_intersect(m, F.get(sets, c["t"]))) / (F.size(m) + F.size(F.get(sets, c["t"])))).alias("order"),
            (-F.size(m)).alias("short"), F.get(names, c["t"]).alias("license"), (F.least(F.size("_grams") - c["at"], F.get(lengths, c["t"])) + 1).alias("n")))

    rank = lambda x: F.struct(x["order"], x["short"], x["at"])
    # a passage overlaps only such that begin at most ``reach`` words, so as many array elements, before or after
    beaten = lambda x, i: F.exists(
        F.slice("_first", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1),
        lambda y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"]) & (rank(y) < rank(x)))
    d = texts.withColumn("_grams", F.when(F.size("_found") > 0, all_bigrams(F.col("_words"))))
    d = d.withColumn("_laid", F.array_distinct(F.flatten(F.transform("_found", laid))))
    d = d.withColumn("_sorted", F.array_sort(F.filter(F.transform("_laid", scored), lambda x: x["order"] <= -least)))
    d = d.withColumn("_first", F.filter("_sorted", lambda x, i: (i == 0) | (F.get("_sorted", i - 1)["at"] != x["at"])))
    kept = F.filter("_first", lambda x, i: ~beaten(x, i))
    shown = F.transform(kept, lambda x: F.struct((-x["order"]).alias("dice"), x["license"].alias("license"), x["at"].alias("at"), x["n"].alias("n")))
    return d.withColumn("_places", shown).drop("_grams", "_laid", "_sorted", "_first")


def scan(docs: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, n_lines, n_places, whole) for every license that a line, a passage or the whole text carries."""
    texts = docs.select("doc_id", normal(body()).alias("_plain")).withColumn("_words", words_of(F.col("_plain")))
    texts = texts.withColumn("_found", found(F.col("_words"), least, templates))
    unit = lambda b, kind: F.struct(b["license"].alias("license"), b["dice"].alias("dice"), F.lit(kind).alias("kind"))
    lines = F.transform(F.split("_plain", "\n"), lambda x: unit(best(words_of(x), least, templates), "line"))
    whole = F.array(unit(best(F.col("_words"), least, templates), "whole"))
    passages = F.transform("_places", lambda p: unit(p, "place"))
    units = F.when(F.size("_found") > 0, F.filter(F.concat(lines, whole, passages), lambda u: u["dice"].isNotNull()))
    hits = places(texts, least, templates).select("doc_id", F.explode_outer(units).alias("u")).filter(F.col("u").isNotNull())
    of = lambda kind: F.col("u.kind") == kind
    return hits.groupBy("doc_id", F.col("u.license").alias("license")).agg(
        F.max("u.dice").alias("dice"), F.count(F.when(of("line"), 1)).alias("n_lines"), F.count(F.when(of("place"), 1)).alias("n_places"), F.max(of("whole")).alias("whole"))
