"""Column functions for identifiers, keys, text and numbers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier and a symbol look like.
ANY_ID = r"^[A-Za-z0-9][A-Za-z0-9\-\._@/]*$"
SYMBOL_ID = r"^[A-Za-z][A-Za-z0-9\-\._@]*$"
#: Kinds of identifiers, tried in this order.
ID_KINDS = (
    ("entrez", r"^[0-9]+$"),
    ("ensembl", r"^ENSG[0-9]+"),
    ("cpg", r"^cg[0-9]{6,}$"),
    ("mirna", r"^(hsa-)?(mir|let)-"),
    ("mimat", r"^MIMAT[0-9]+$"),
    ("symbol", SYMBOL_ID),
)
DOI = r"10\.[0-9]{4,9}/[A-Za-z0-9._;()/:\-]+"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def number(text: Column) -> Column:
    """Text to DOUBLE; what cannot be parsed, and NaN, become NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clean_id(text: Column) -> Column:
    """An identifier without blanks and quotes around it."""
    return F.trim(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""))


def first_of(text: Column, separator: str = ";") -> Column:
    """What stands before the first separator."""
    return F.split_part(text, F.lit(separator), F.lit(1))


def sample_barcode(text: Column, pattern: str = r"(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})") -> Column:
    """The patient part of a long barcode; other identifiers are trimmed only."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def case_id(text: Column) -> Column:
    """Upper case, without a sample suffix such as ``-A``."""
    return F.regexp_replace(F.upper(F.trim(text)), "-[A-Z]$", "")


def family(text: Column) -> Column:
    """The leading run of letters."""
    return F.regexp_extract(text, "^[A-Za-z]+", 0)


def subset_key(text: Column) -> Column:
    """Layer names of a subset in a fixed order: ``z+x`` becomes ``x+z``."""
    return F.array_join(F.array_sort(F.transform(F.split(text, r"\+"), lambda x: F.trim(x))), "+")


def pair_key(text: Column) -> Column:
    """A cohort pair with a plain x between its names."""
    return F.trim(F.regexp_replace(text, "\\s*×\\s*", "x"))


def layer_count(text: Column) -> Column:
    return F.size(F.split(text, r"\+"))


def id_kind(text: Column) -> Column:
    """The first kind of ``ID_KINDS`` that fits, else ``other``."""
    out = F.lit("other")
    for name, pattern in reversed(ID_KINDS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def domain_token(label: Column, token: str, inside: str = "A", outside: str = "B") -> Column:
    """One of two domains, by whether the label holds a token."""
    return F.when(label.contains(token), inside).otherwise(outside)


def decoded(label: Column, names: dict[str, str]) -> Column:
    """A label by a lookup, itself where it is not in it."""
    if not names:
        return label
    lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(lookup[label], label)


def plain_number(text: Column) -> Column:
    """A printed number with an ASCII minus and without zeros at its end."""
    ascii_minus = F.translate(text, "−–—‒", "----")
    return F.when(ascii_minus.contains("."), F.regexp_replace(F.regexp_replace(ascii_minus, "0+$", ""), r"\.$", "")).otherwise(ascii_minus)


def substituted(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements in the given order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fenced_code(text: Column) -> Column:
    """What stands in fenced code blocks, without the fences."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[A-Za-z]*\n(.*?)```"), 1), lambda x: F.regexp_replace(x, r"\s+$", ""))


def figure_references(text: Column) -> Column:
    """References to figures and tables, such as ``Fig. 3`` or ``Table S2``, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(r"(?:Figure|Fig\.|Table) S?[0-9]+[a-z]?"), 0)


def citation_numbers(text: Column) -> Column:
    """Numbers in square brackets, as printed: ``[3, 5]`` gives 3 and 5."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:, ?[0-9]+)*)\]"), 1), lambda x: F.split(x, ", ?")))


def flattened(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def sign_fixed(auc: Column) -> Column:
    """An AUC whatever the direction of the score."""
    return F.greatest(auc, 1 - auc)


def value_domain(q05: Column, q95: Column, low: Column, high: Column) -> Column:
    """The numeric kind of a matrix by its range: ordered rules, whose bounds are fixed values."""
    return (
        F.when((low >= 0) & (high <= 1), "unit interval")
        .when((low >= -2) & (high <= 2), "discrete levels")
        .when((q05 < 0) & (F.abs(q95) <= 20), "log ratio")
        .when((low >= 0) & (high <= 25), "log count")
        .when(low >= 0, "positive")
        .otherwise("other")
    )
