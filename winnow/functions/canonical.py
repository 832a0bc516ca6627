"""Canonical form of short math answers, as columns: sums, products, tuples, intervals and sets.

An answer that is already normalised (`grading.normal_math`) becomes

* its shape: brackets, commas and unions, with `p` for every part between them;
* its parts: each a sum, as a sorted list of `factors:coefficient`. Numbers, also those written with
  fractions, roots, powers, percent or an exponent, and pi are multiplied into the coefficient; letters,
  functions and groups are sorted factors. Terms with equal factors are added up.

Two answers of one shape with equal parts are equal, in any order of terms and factors. They differ for
certain only where both are polynomials in the same plain letters: groups and roots may be equal in ways
that no form shows, and other letters may be units or another name. Words, matrices and anything else that is not understood whole have no form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from winnow.functions.text import all_matches

PLACES = 6  # decimals of a coefficient

_BRACES = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
_GROUP = r"\([^(),\[\]]*\)"
_COMMAND = r"\\(?!begin|end)[A-Za-z]+"
_NUMBER = r"(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?"
# One sign each for the union of intervals and the brackets of a set.
_SIGNS = {r"\cup": "\u222a", r"\{": "\u2983", r"\}": "\u2984"}
_PART = rf"(?:[^(),\[\]{{}}\\\u222a\u2983\u2984]|{_COMMAND}|{_BRACES}|{_GROUP})+"
_TERM = rf"[+-]?(?:(?<=\d)e[+-]\d+|\^-\d+|[^+\-(){{}}]|{_BRACES}|{_GROUP})+"
_ATOM = rf"{_NUMBER}%?|\\frac{_BRACES}{_BRACES}|\\sqrt{_BRACES}|\\[A-Za-z]+(?:{_BRACES})*|[A-Za-z]|{_GROUP}"
_POWER = rf"\^(?:{_BRACES}|-?\d+|[A-Za-z])"
_FACTOR = rf"[*/]?(?:{_ATOM})(?:{_POWER})?"
_SHAPE = "^(?:p(?:,p)*|\u2983p(?:,p)*\u2984|[(\\[]p(?:,p)*[)\\]](?:\u222a[(\\[]p,p[)\\]])*)$"
_LETTER = r"^(?:[A-Za-z](?:\^\d+)?|\\infty)$"
_FORM = "struct<shape:string,parts:array<string>,plain:boolean,letters:array<string>>"


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spread_fractions(c: Column) -> Column:
    """Fractions of one factor over or under a number, as quotients."""
    inner = r"([^{}+\-]*(?:\{[^{}]*\}[^{}+\-]*)*)"
    c = F.regexp_replace(c, rf"\\frac\{{{inner}\}}\{{({_NUMBER})\}}", "$1/$2")
    return F.regexp_replace(c, rf"\\frac\{{({_NUMBER})\}}\{{(\\sqrt\{{[^{{}}]*\}}|\\pi|[A-Za-z])\}}", "$1/$2")


def _atom_value(atom: Column) -> Column:
    """Value of a number, a root or fraction of numbers, or pi; null for anything else."""
    number = rf"^({_NUMBER})(%?)$"
    root = rf"^\\sqrt\{{({_NUMBER})\}}$"
    frac = rf"^\\frac\{{(-?{_NUMBER})\}}\{{(-?{_NUMBER})\}}$"

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(atom, pattern, i).try_cast("double")

    def quotient(below: Column) -> Column:
        return F.when(below != 0, group(frac, 1) / below)

    percent = F.endswith(atom, F.lit("%"))
    return (
        F.when(atom.rlike(number), group(number, 1) / F.when(percent, 100.0).otherwise(1.0))
        .when(F.startswith(atom, F.lit("\\sqrt")), F.sqrt(group(root, 1)))
        .when(F.startswith(atom, F.lit("\\frac")), _given(group(frac, 2), quotient))
        .when(atom == "\\pi", F.lit(3.141592653589793))
    )


def _factor(text: Column) -> Column:
    """struct<value, key>: a number multiplied in, or a factor that stays."""
    pieces = F.struct(
        F.startswith(text, F.lit("/")).alias("under"),
        F.regexp_replace(text, rf"^[*/]|{_POWER}$", "").alias("atom"),
        F.regexp_replace(F.regexp_extract(text, rf"({_POWER})$", 1), r"[\^{}]", "").alias("power"),
    )

    def parsed(p: Column) -> Column:
        under, atom, power = p["under"], p["atom"], p["power"]
        exponent = F.when(power == "", 1.0).otherwise(power.try_cast("double"))
        value = F.pow(_atom_value(atom), F.when(under, -1.0).otherwise(1.0) * exponent)
        name = F.concat(atom, F.when(power == "", "").otherwise(F.concat(F.lit("^"), power)))
        return _given(
            value,
            lambda v: F.struct(
                F.coalesce(v, F.lit(1.0)).alias("value"),
                F.when(v.isNull(), F.concat(F.when(under, "/").otherwise(""), name)).alias("key"),
            ),
        )

    return _given(pieces, parsed)


def _term(text: Column) -> Column:
    """struct<key, coef, plain, whole>."""

    def of(p: Column) -> Column:
        return F.struct(
            F.array_sort(F.filter(F.transform(p["factors"], lambda f: f["key"]), lambda k: k.isNotNull())).alias("keys"),
            F.aggregate(p["factors"], F.lit(1.0), lambda a, f: a * f["value"]).alias("coef"),
            p["whole"].alias("whole"),
        )

    def named(p: Column) -> Column:
        keys = p["keys"]
        letters = F.forall(keys, lambda k: k.rlike(_LETTER) & ~k.rlike(r"^e|^i\^"))
        return F.struct(
            F.array_join(keys, "*").alias("key"),
            F.when(F.startswith(text, F.lit("-")), -p["coef"]).otherwise(p["coef"]).alias("coef"),
            (letters & (F.size(F.array_distinct(keys)) == F.size(keys))).alias("plain"),
            p["whole"].alias("whole"),
        )

    body = F.regexp_replace(text, r"^[+-]", "")
    whole = (body != "") & (F.regexp_replace(body, _FACTOR, "") == "")
    factors = F.transform(all_matches(body, _FACTOR), _factor)
    return _given(_given(F.struct(factors.alias("factors"), whole.alias("whole")), of), named)


def _sum_of(terms: Column, key: Column) -> Column:
    total = F.aggregate(F.filter(terms, lambda t: t["key"] == key), F.lit(0.0), lambda a, t: a + t["coef"])
    return F.struct(key.alias("key"), F.round(total, PLACES).alias("coef"))


def _part(text: Column) -> Column:
    """struct<form, plain>; form is null where the part is not understood whole."""
    word = text.rlike(r"(?<![\\A-Za-z])[A-Za-z]{4,}|\\[A-Za-z]+\(|_|=|[<>!|&:;?'\"]")
    whole = (F.regexp_replace(text, _TERM, "") == "") & ~word

    def summed(terms: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["key"])))
        return F.struct(
            F.transform(keys, lambda k: _sum_of(terms, k)).alias("sums"),
            F.forall(terms, lambda t: t["whole"]).alias("whole"),
            F.forall(terms, lambda t: t["plain"]).alias("plain"),
        )

    def formed(p: Column) -> Column:
        sums = p["sums"]
        # Not a number, or beyond a double: no form.
        sound = F.forall(sums, lambda s: ~F.isnan(s["coef"]) & (F.abs(s["coef"]) < 1e300))
        left = F.filter(sums, lambda s: s["coef"] != 0)
        form = F.array_join(F.transform(left, lambda s: F.concat(s["key"], F.lit(":"), s["coef"].cast("string"))), ";")
        plain = p["plain"] & ~F.contains(text, F.lit("%"))
        return F.struct(F.when(whole & p["whole"] & sound, form).alias("form"), plain.alias("plain"))

    return _given(_given(F.transform(all_matches(text, _TERM), _term), summed), formed)


def canonical(normal: Column) -> Column:
    """struct<shape, parts, plain, letters> of a normalised answer; null without a form."""
    text = F.regexp_replace(normal, r"^[a-z]\\in(?![a-z])", "")
    for latex, sign in _SIGNS.items():
        text = F.replace(text, F.lit(latex), F.lit(sign))
    text = _spread_fractions(F.regexp_replace(text, r"^\(([^(),\[\]]*)\)$", "$1"))

    def of(text: Column) -> Column:
        letters = all_matches(F.regexp_replace(text, r"\\[A-Za-z]+|\de[+-]?\d", ""), "[A-Za-z]")
        return F.struct(
            F.regexp_replace(text, _PART, "p").alias("shape"),
            F.transform(all_matches(text, _PART), _part).alias("parts"),
            F.array_sort(F.array_distinct(letters)).alias("letters"),
        )

    def formed(p: Column) -> Column:
        form = F.struct(
            p["shape"].alias("shape"),
            F.transform(p["parts"], lambda x: x["form"]).alias("parts"),
            F.forall(p["parts"], lambda x: x["plain"]).alias("plain"),
            p["letters"].alias("letters"),
        )
        known = p["shape"].rlike(_SHAPE) & F.forall(p["parts"], lambda x: x["form"].isNotNull())
        return F.when(known, form.cast(_FORM))

    return F.when(normal != "", _given(_given(text, of), formed))


ANSWERS = "_answers"
_built: dict[int, Column] = {}


def forms_of_answers() -> Column:
    """The canonical forms of a column named `_answers`, an array of normalised answers, in order.

    The expression takes longer to put together than to plan, so it is kept for each JVM.
    """
    jvm = id(SparkContext._gateway)
    if jvm not in _built:
        _built.clear()
        _built[jvm] = F.transform(ANSWERS, canonical)
    return _built[jvm]


def forms_equal(gold: Column, pred: Column) -> Column:
    """Equality of two canonical forms; null where they cannot decide.

    A set has no order. A list without brackets may have one: the same parts in another order are left
    undecided. An answer of another shape is wrong only if both have as many parts, between other brackets.
    """
    same_shape = gold["shape"] == pred["shape"]
    in_order = gold["parts"] == pred["parts"]
    in_any = F.array_sort(gold["parts"]) == F.array_sort(pred["parts"])
    is_set, bare = F.startswith(gold["shape"], F.lit(_SIGNS[r"\{"])), gold["shape"].rlike("^p,")
    plain = gold["plain"] & pred["plain"] & (gold["letters"] == pred["letters"])
    brackets = F.size(gold["parts"]) == F.size(pred["parts"])
    bracketed = gold["shape"].rlike(r"^[(\[]") & pred["shape"].rlike(r"^[(\[]")
    return (
        F.when(same_shape & (in_order | (is_set & in_any)), F.lit(True))
        .when(same_shape & bare & in_any, F.lit(None).cast("boolean"))
        .when(same_shape & plain, F.lit(False))
        .when(~same_shape & brackets & bracketed & plain, F.lit(False))
    )
