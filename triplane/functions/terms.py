"""Scalar functions on terms, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplane.functions import config as C


def strip(value: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (value.startswith(p) for p in prefixes))


def is_uri(value: Column) -> Column:
    return value.rlike(C.URI)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compact_term(value: Column, prefixes=C.PREFIXES) -> Column:
    """Short form of a URI; anything else only loses white space at its ends.

    A term that begins and ends with a printable ASCII character has no white space to lose, and goes through compiled expressions only.
    """
    web = lambda v: v.startswith("http://") | v.startswith("https://")

    def short(v: Column) -> Column:
        out = F.when(v.contains("#"), F.substring_index(v, "#", -1)).otherwise(F.substring_index(F.regexp_replace(v, "/+$", ""), "/", -1))
        for prefix, name in reversed(prefixes):
            out = F.when(v.startswith(prefix), F.concat(F.lit(name), F.substr(v, F.lit(len(prefix) + 1)))).otherwise(out)
        return out

    plain = F.substring(value, 1, 1).between("!", "~") & F.substring(value, -1, 1).between("!", "~")
    return F.when(plain & web(value), short(value)).when(plain, value).otherwise(let(strip(value), lambda v: F.when(web(v), short(v)).otherwise(v)))


def after_colon(compact: Column) -> Column:
    """What follows the first colon of a compact term."""
    return F.regexp_replace(compact, "^[^:]*:", "")


def local_name(value: Column) -> Column:
    return after_colon(compact_term(value))


def family(entity: Column) -> Column:
    """The entity's family by its name: the first rule that holds."""

    def by_rule(token: Column) -> Column:
        suffixed = reduce(Column.__or__, (token.endswith(s) for s in C.COMPANY_SUFFIXES))
        rules = [(token.rlike("^\\p{Nd}+$"), F.lit("NumericId"))]
        rules += [(token.startswith(f + "_"), F.lit(f)) for f in C.FAMILY_PREFIXES]
        rules += [
            (token.startswith("HGNC:") | entity.startswith("HGNC:"), F.lit("HGNC")),
            (starts_with_any(entity, C.ONTOLOGY_PREFIXES), F.lit("Disease")),
            (starts_with_any(token, C.DISEASE_PREFIXES), F.lit("Disease")),
            (token.isin(*C.AGENCIES) | suffixed, F.lit("Organisation")),
            (token.contains("_"), F.substring_index(token, "_", 1)),
        ]
        out = token
        for test, value in reversed(rules):
            out = F.when(test, value).otherwise(out)
        return out

    return let(local_name(entity), by_rule)


def coarse_category(entity: Column, of_family: Column, primary_type: Column, types: Column) -> Column:
    """One of the generic categories where name, type or ontology allow it; ``types``: array of terms, may be null."""
    token = F.replace(F.lower(local_name(entity)), F.lit("_"), F.lit(" "))
    ontology = F.coalesce(F.exists(types, lambda t: starts_with_any(t, C.ONTOLOGY_PREFIXES)), F.lit(False))
    return (
        F.when(of_family.isin(*C.GENERIC_CATEGORIES), of_family)
        .when(primary_type.isin(*C.GENERIC_CATEGORIES), primary_type)
        .when(ontology | token.rlike("|".join(C.DISEASE_HINTS)), F.lit("Disease"))
        .when(of_family == "", primary_type)
        .otherwise(of_family)
    )


def term_to_string(kind: Column, lexical: Column, lang: Column, datatype: Column) -> Column:
    """An RDF term as one string."""
    literal = F.when(lang != "", F.concat(lexical, F.lit("@"), lang)).when(datatype != "", F.concat(lexical, F.lit("^^"), datatype)).otherwise(lexical)
    return F.when(kind == "URI", lexical).when(kind == "BlankNode", F.concat(F.lit("_:"), lexical)).otherwise(literal)


def truncate(sequence: Column, most: int) -> tuple[Column, Column]:
    """The first ``most`` residues, and whether there were more."""
    return F.substring(sequence, 1, most), F.length(sequence) > most


def clean_sequence(value: Column) -> Column:
    return F.upper(strip(F.coalesce(value, F.lit(""))))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))
