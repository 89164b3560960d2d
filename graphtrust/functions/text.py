"""Text columns: tokens, similarity, inverted indexes, top fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count as tokens.
STOP = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "using", "based", "paper", "method", "approach", "results", "data", "model", "models", "study",
)
TOKEN = "([a-zA-Z][a-zA-Z0-9_+-]{2,})"


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def pair_text(title: Column, body: Column) -> Column:
    """Title and whole text, as a student reads them; nulls are empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))


def first_named(reply: Column, names: tuple[str, ...], otherwise: str) -> Column:
    """The first of names that a reply contains, whatever its case; otherwise, also for null, the fallback."""
    held = [F.when(F.contains(F.lower(reply), F.lit(n.lower())), F.lit(n)) for n in names]
    return F.coalesce(*held, F.lit(otherwise))


def positive_number(x: Column) -> Column:
    """A number above 0 as a double, else null: a guard for fields of any type, read as text."""
    value = x.try_cast("double")
    return F.when((value > 0) & ~F.isnan(value), value)


def clipped(title: Column, body: Column, n: int = 1200) -> Column:
    return F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), 1, n)


def text_from_index(words: Column, length: Column | None = None) -> Column:
    """Text of an array of (word, pos): a gap gives an empty word, a later word replaces an earlier one, the ends are trimmed."""
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(words, lambda w: w["pos"])), lambda p: F.struct(p, F.element_at(F.filter(words, lambda w: w["pos"] == p), -1)["word"])))
    n = F.coalesce(length, F.array_max(F.transform(words, lambda w: w["pos"])) + 1, F.lit(0)) if length is not None else F.coalesce(F.array_max(F.transform(words, lambda w: w["pos"])) + 1, F.lit(0))
    return F.when(n > 0, F.trim(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(last, i), F.lit(""))), " "))).otherwise("")


def top_field(fields: Column) -> Column:
    """The name of largest weight of an array of (name, w): the first of equals; a missing weight is 0; none: Unknown."""
    best = F.array_max(F.transform(fields, lambda f, i: F.struct(F.coalesce(f["w"], F.lit(0.0)), -i, f["name"].alias("name"))))
    return F.coalesce(best["name"], F.lit("Unknown"))
