"""Text and identifier functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers and patterns that results depend on.
OBO = "http://purl.obolibrary.org/obo/"
CURIE_PREFIXES = ("CL", "PR", "NCBITaxon", "RO", "BFO")
CD_TOKEN = r"\bCDw?\d+[A-Za-z0-9]{0,4}\b"
SPACE = r"[\s\x1c-\x1f]"  # with (?U), Unicode white space and the four separators before the space
QUOTE = rf'(?U)>{SPACE}*"([^"]+)"'
ELLIPSIS = rf"(?U)\.{{3}}|…|\.{SPACE}\.{SPACE}\."
#: Cells that a CSV reader with the usual defaults takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def curie(iri: Column | str) -> Column:
    """Compact form of an IRI with one of the known prefixes; other values unchanged."""
    rest = F.substring(c(iri), len(OBO) + 1, 2**31 - 1)
    prefix = F.substring_index(rest, "_", 1)
    known = c(iri).startswith(OBO) & prefix.isin(*CURIE_PREFIXES) & F.contains(rest, F.lit("_"))
    return F.when(known, F.concat(prefix, F.lit(":"), F.substr(rest, F.length(prefix) + 2))).otherwise(c(iri))


def split_bar(value: Column | str) -> Column:
    """Non-empty parts of a bar-joined value; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c(value), F.lit("")), "[|]"), lambda x: x != "")


def first_bar(value: Column | str) -> Column:
    """The part before the first bar; null gives an empty string."""
    return F.substring_index(F.coalesce(c(value), F.lit("")), "|", 1)


def clean_tsv(value: Column | str) -> Column:
    """Tab, line feed and carriage return as spaces; null as an empty string."""
    return F.translate(F.coalesce(c(value), F.lit("")), "\t\n\r", "   ")


def escape_bar(value: Column | str) -> Column:
    """Bars escaped for a markdown table."""
    return F.replace(c(value), F.lit("|"), F.lit("\\|"))


def slug(name: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip(value: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c(value), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def yes_no(flag: Column | str) -> Column:
    """``True`` or ``False``."""
    return F.initcap(c(flag).cast("string"))


def utc_seconds(moment: Column | None = None) -> Column:
    """A moment, or now, as UTC text to the second; the session's time zone must be UTC."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cd_tokens(name: Column | str) -> Column:
    """All CD tokens of a name, in order; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(c(name), F.lit("")), F.lit(CD_TOKEN), 0)


def for_match(text: Column | str) -> Column:
    """Lower case, dashes and quotation marks unified, runs of white space as one space, trimmed."""
    unified = F.lower(c(text))
    for sign, plain in zip("–—―‘’“”", "---''''", strict=True):  # whole texts are searched for a sign faster than translated
        unified = F.replace(unified, F.lit(sign), F.lit(plain))
    return F.trim(F.regexp_replace(unified, rf"(?U){SPACE}+", " "))


def quotes(markdown: Column | str) -> Column:
    """Double-quoted spans after a ``>``, in order."""
    return F.regexp_extract_all(F.coalesce(c(markdown), F.lit("")), F.lit(QUOTE), 1)


def segments(quote: Column | str) -> Column:
    """Normalised, non-empty parts of a quote between ellipses."""
    return F.filter(F.transform(F.split(c(quote), ELLIPSIS), for_match), lambda s: s != "")


def in_order(segments: Column | str) -> Column:
    """A LIKE pattern that holds where all segments occur in order without overlap."""
    special = F.transform(c(segments), lambda s: F.regexp_replace(s, r"([\\%_])", r"\\$1"))
    return F.concat(F.lit("%"), F.array_join(special, "%"), F.lit("%"))


def followed(spec: Column | str) -> Column:
    """``a=1,2;b=3`` as a map from source to ids; the last of a repeated source counts; null gives an empty map."""
    parts = F.filter(F.split(F.coalesce(c(spec), F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("key"),
            F.filter(F.transform(F.split(F.substr(p, F.locate("=", p) + 1), ","), strip), lambda x: x != "").alias("value"),
        ),
    )
    # keep an entry only if no later one has its key
    kept = F.filter(
        F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(entries, x["i"] + 2, F.size(entries)), lambda later: later["key"] == x["e"]["key"]),
    )
    return F.map_from_entries(F.transform(kept, lambda x: x["e"]))


def quoted(text: Column | str) -> Column:
    """Text in single quotes; in double quotes if it holds a single quote and no double quote."""
    text = c(text)
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))
    out = F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(single)
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out
