"""Word roots and morph codes by rule, both ways, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.dims import COMPARATIVES, IDENTITY, IRREGULAR, SUPERLATIVES



def _table(d: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _drop(c: Column, n: int) -> Column:
    return F.left(c, F.length(c) - n)


def _single(c: Column) -> Column:
    """Without the last letter where it is doubled."""
    return F.when(c.rlike(r"(\p{L})\1$"), _drop(c, 1)).otherwise(c)


def _y(c: Column) -> Column:
    return F.when(c.endswith("i"), F.concat(_drop(c, 1), F.lit("y"))).otherwise(c)


def analysed(word: Column) -> Column:
    """struct(root, code) of a word; the first rule that fits decides."""
    w = F.lower(word)
    n = F.length(w)

    def out(root: Column, code: int) -> Column:
        return F.struct(root.alias("root"), F.lit(code).alias("code"))

    past = _table({v: k for k, v in IRREGULAR.items()})
    rules = [
        (~w.rlike(r"\p{L}"), w, 0),
        (w.isin(IDENTITY), w, 0),
        (w.isin(list(IRREGULAR.values())), F.element_at(past, w), 12),
        (w.startswith("un") & (n > 2), F.substring(w, 3, 1 << 30), 9),
        (w.endswith("ing") & (n > 4), _single(_drop(w, 3)), 3),
        (w.endswith("ied") & (n > 3), F.concat(_drop(w, 3), F.lit("y")), 2),
        (w.endswith("ed") & (n > 3), _single(_drop(w, 2)), 2),
        (w.endswith("ies") & (n > 3), F.concat(_drop(w, 3), F.lit("y")), 1),
        (w.rlike("(s|x|z|ch|sh)es$"), _drop(w, 2), 1),
        (w.endswith("s") & (n > 2), _drop(w, 1), 1),
        (w.endswith("ly") & (n > 3), _y(_drop(w, 2)), 8),
        (w.endswith("est") & (n > 4), _y(_single(_drop(w, 3))), 7),
        (w.endswith("er") & (n > 3), _y(_single(_drop(w, 2))), 6),
    ]
    c = F
    for condition, root, code in rules:
        c = c.when(condition, out(root, code))
    return c.otherwise(out(w, 0))


def inflected(root: Column, tag: str) -> Column:
    """Plural, past, -ing and -s forms by rule (no inflection lexicon is assumed)."""
    past = _table(IRREGULAR)
    y = root.rlike("[^aeiou]y$")
    stem = F.when(root.rlike("^[^aeiou]*[aeiou][bdgklmnprt]$"), F.concat(root, F.right(root, F.lit(1)))).when(root.endswith("e"), _drop(root, 1)).otherwise(root)
    if tag in ("NNS", "VBZ"):
        return F.when(y, F.concat(_drop(root, 1), F.lit("ies"))).when(root.rlike("(s|x|z|ch|sh)$"), F.concat(root, F.lit("es"))).otherwise(F.concat(root, F.lit("s")))
    if tag == "VBG":
        return F.concat(stem, F.lit("ing"))
    regular = F.when(y, F.concat(_drop(root, 1), F.lit("ied"))).otherwise(F.concat(stem, F.lit("ed")))
    return F.coalesce(F.try_element_at(past, root), regular)


def applied(root: Column, code: Column) -> Column:
    """The surface of a root under a morph code."""
    y, e = root.endswith("y"), root.endswith("e")
    minus = _drop(root, 1)
    add = lambda s, c=root: F.concat(c, F.lit(s))
    return (
        F.when(code == 0, root)
        .when(code == 12, F.when(root.isin(IDENTITY), root).otherwise(inflected(root, "VBD")))
        .when(code == 9, F.when(root.startswith("un"), root).otherwise(F.concat(F.lit("un"), root)))
        .when(code == 10, F.when(e, add("r")).otherwise(add("er")))
        .when(code == 11, F.when(y, add("iness", minus)).when(e, add("eness", minus)).otherwise(add("ness")))
        .when(code == 8, F.when(root.endswith("ly"), root).when(y & (F.length(root) > 1), add("ily", minus)).when(root.endswith("le") & (F.length(root) > 2), add("ly", _drop(root, 2))).otherwise(add("ly")))
        .when(code == 6, F.coalesce(F.try_element_at(_table(COMPARATIVES), root), F.when(y & (F.length(root) > 1), add("ier", minus)).when(e, add("r")).otherwise(add("er"))))
        .when(code == 7, F.coalesce(F.try_element_at(_table(SUPERLATIVES), root), F.when(y & (F.length(root) > 1), add("iest", minus)).when(e, add("st")).otherwise(add("est"))))
        .when(code == 1, inflected(root, "NNS"))
        .when(code.isin(2, 4), inflected(root, "VBD"))
        .when(code == 3, inflected(root, "VBG"))
        .when(code == 5, inflected(root, "VBZ"))
        .otherwise(root)
    )
