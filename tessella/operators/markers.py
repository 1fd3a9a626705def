"""Marker sheets: validation, inventory and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import grammar
from tessella.functions.text import MISSING, strip
from tessella.tables import cut

# The marker columns of a sheet, in the order in which cells are reported.
MARKER_COLUMNS = ("Required exclusion", "Ideal exclusion", "Required phenotypic markers", "Ideal phenotypic markers")
SUBSET = "Subset name"


def cells(sheet: DataFrame, row: str = "row") -> DataFrame:
    """``row, subset, column, col_ord, value``: the marker cells of a wide sheet, missing ones left out.

    Any marker column may be absent. A missing subset reads ``nan``, an absent subset column an empty text.
    """
    present = [c for c in MARKER_COLUMNS if c in sheet.columns]
    name = F.when(F.col(SUBSET).isNull() | F.col(SUBSET).isin(*MISSING), "nan").otherwise(strip(SUBSET)) if SUBSET in sheet.columns else F.lit("")
    wide = sheet.select(F.col(row).alias("row"), name.alias("subset"), *[F.col(f"`{c}`").cast("string").alias(c) for c in present])
    if not present:
        return wide.select("row", "subset", F.lit("").alias("column"), F.lit(0).alias("col_ord"), F.lit("").alias("value")).where("false")
    long = wide.unpivot(["row", "subset"], present, "column", "value")
    order = F.array_position(F.array(*[F.lit(c) for c in MARKER_COLUMNS]), F.col("column")).cast("int")
    return long.where(F.col("value").isNotNull() & ~F.col("value").isin(*MISSING)).select("row", "subset", "column", order.alias("col_ord"), "value")


def by_value(checked: DataFrame, **found) -> DataFrame:
    """``checked`` with columns that are worked out from ``value`` only, once for each distinct value.

    What is worked out takes far longer than a cell takes to read: many cells are few bytes,
    which Spark reads in few tasks. Values are dealt to many tasks as they are made distinct,
    and cells as they meet them; a null value has nulls. A stream's cells are worked out one by
    one instead, as they arrive: which values it had before would be a state without end.
    """
    checked = checked.drop(*found)
    if checked.isStreaming:
        each = F.struct(*[F.when(F.col("value").isNotNull(), c).alias(k) for k, c in found.items()])
        return checked.select("*", F.inline(F.array(each)))  # not again for a filter
    values = checked.select("value").where("value is not null").distinct()
    worked_out = values.select("value", F.inline(F.array(F.struct(*[c.alias(k) for k, c in found.items()]))))  # not again for a filter
    return checked.join(worked_out, "value", "left").select(*[F.col(c) for c in checked.columns], *found)


def validate(checked: DataFrame) -> DataFrame:
    """Cells with ``error``, null where valid; the value is judged as it is."""
    return by_value(checked, error=grammar.error("value"))


def failures(validated: DataFrame) -> DataFrame:
    """Invalid cells; the value is stripped for the report."""
    return validated.where("error is not null").withColumn("value", strip("value"))


def totals(validated: DataFrame) -> DataFrame:
    """One row: cells checked and cells invalid."""
    return validated.agg(F.count("*").alias("checked"), F.count("error").alias("invalid"))


def error_class(error: str = "error"):
    """The family of an error message."""
    families = ("invalid marker token", "expected marker or group", "mixed '|' and space", "top-level '|'", "missing space", "unexpected", "empty expression")
    out = F.when(F.col(error).rlike(r"^missing '[)\]]'$"), "missing closer")
    for f in families:
        out = out.when(F.col(error).startswith(f), f)
    return out


def histogram(validated: DataFrame) -> DataFrame:
    return validated.where("error is not null").groupBy(error_class().alias("error_class")).agg(F.count("*").alias("n"))


def subtotals(validated: DataFrame) -> DataFrame:
    """Failures by column and error class, with subtotals and the total; null stands for all."""
    classed = validated.where("error is not null").select("column", error_class().alias("error_class"))
    return classed.rollup("column", "error_class").agg(F.count("*").alias("n"))


def cube(validated: DataFrame) -> DataFrame:
    """``column, subset, error_class, level, n``: failures in every combination of the three dimensions.

    ``level`` is the grouping id: its bits 4, 2 and 1 are set where column, subset and error
    class are totals, so that a total is told from a value that is null. Failures are counted by
    all three dimensions first; the eight combinations are then made of these counts.
    """
    dimensions = ("column", "subset", "error_class")
    counted = validated.where("error is not null").select("column", "subset", error_class().alias("error_class")).groupBy(*dimensions).agg(F.count("*").alias("n"))
    return counted.cube(*dimensions).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))


def _tokens(checked: DataFrame, keep: tuple[str, ...], **near: int) -> DataFrame:
    """``keep, pos, token`` of every token, and its neighbours at the given distances, which are in the same array: nothing is shuffled."""
    listed = checked.select(*keep, F.explode(F.array(grammar.tokens("value"))).alias("tokens"))  # worked out once, then looked at from each token

    def with_neighbours(token, pos):
        return F.struct(pos.alias("pos"), token.alias("token"), *[F.get("tokens", pos + by).alias(name) for name, by in near.items()])

    return listed.select(*keep, F.inline(F.transform("tokens", with_neighbours)))


def words(checked: DataFrame) -> DataFrame:
    """``row, subset, column, pos, word``: words of the cells with their position among all tokens; no gate, no group qualifier."""
    listed = _tokens(checked, ("row", "subset", "column"), before=-1)
    gate = (F.col("pos") == 0) & (F.col("token") == grammar.GATE)
    postfix = F.coalesce(F.col("before").isin(")", "]"), F.lit(False)) & F.col("token").rlike(f"^{grammar.QUALIFIER}$")
    return listed.where(grammar.is_word(F.col("token")) & ~gate & ~postfix).select("row", "subset", "column", "pos", F.col("token").alias("word"))


def inventory(checked: DataFrame) -> DataFrame:
    """``row, subset, column, pos, marker, qualifier`` of every valid word."""
    split = words(checked).select("row", "subset", "column", "pos", grammar.marker("word").alias("marker"), grammar.qualifier("word").alias("qualifier"))
    return split.where("marker <> ''")


def usage(found: DataFrame) -> DataFrame:
    """``marker, n, columns, n_subsets``: how often each marker is used, in which of the few marker columns, and in how many subsets."""
    return found.groupBy("marker").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("column")).alias("columns"), F.count_distinct("subset").alias("n_subsets"))


def usage_by_subset(found: DataFrame) -> DataFrame:
    """``marker, subset, n``: the subsets that use each marker, one row each, as a common marker may be in any number of them."""
    return found.groupBy("marker", "subset").agg(F.count("*").alias("n"))


def canonical(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``found`` with ``canonical``: the marker, or what ``aliases (alias, canonical)`` has for it."""
    renamed = aliases.select(F.col("alias").alias("marker"), F.col("canonical"))
    return found.join(renamed, "marker", "left").withColumn("canonical", F.coalesce("canonical", "marker"))


def most_common(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` markers used most, ties by name."""
    return found.groupBy("marker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "marker").limit(k)


# ---------------------------------------------------------------- lint

# The severity of each class of issue.
SEVERITY = {
    "unbalanced": "High",
    "free_text": "High",
    "space_in_name": "High",
    "no_delimiter": "Medium",
    "stacked": "Medium",
    "bare": "Medium",
    "several_names": "Medium",
    "casing": "Low",
    "stray_space": "Low",
    "negated_and_not": "Review",
}


def _parsed(checked: DataFrame) -> DataFrame:
    """Cells with ``tokens`` and ``words (pos, word, marker, qualifier)``, each worked out once and then looked at by any number of lints."""
    listed = checked.select("row", "subset", "column", "value", F.explode(F.array(grammar.tokens("value"))).alias("tokens"))

    def word(token, pos):
        before = F.get("tokens", pos - 1)
        gate = (pos == 0) & (token == grammar.GATE)
        postfix = F.coalesce(before.isin(")", "]"), F.lit(False)) & token.rlike(f"^{grammar.QUALIFIER}$")
        return F.when(grammar.is_word(token) & ~gate & ~postfix, F.struct(pos.alias("pos"), token.alias("word"), grammar.marker(token).alias("marker"), grammar.qualifier(token).alias("qualifier")))

    found = F.filter(F.transform("tokens", word), lambda w: w.isNotNull())
    return listed.select("*", F.explode(F.array(found)).alias("words"))


def _valid(condition):
    """``marker`` with its qualifier of the valid words that meet a condition."""
    return F.transform(F.filter("words", lambda w: (w["marker"] != "") & condition(w)), lambda w: F.concat(w["marker"], w["qualifier"]))


def _value_if(condition):
    return F.when(condition, F.array("value")).otherwise(F.array().cast("array<string>"))


def _unbalanced():
    def count(ch: str):
        return F.length("value") - F.length(F.replace(F.col("value"), F.lit(ch), F.lit("")))

    return _value_if((count("(") != count(")")) | (count("[") != count("]")))


def _free_text(share: float = 0.5, at_least: int = 4):
    n, bare_words = F.size("words"), F.size(F.filter("words", lambda w: w["qualifier"] == ""))
    told = F.array(F.concat_ws("/", bare_words.cast("string"), n.cast("string")))
    return F.when((n >= at_least) & (bare_words > share * n), told).otherwise(F.array().cast("array<string>"))


def _space_in_name():
    near = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.get("tokens", i + 1).alias("space"), F.get("tokens", i + 2).alias("next")))
    split = F.filter(near, lambda x: F.coalesce(grammar.is_word(x["token"]) & (x["space"] == " ") & x["next"].rlike("^[0-9]"), F.lit(False)))
    return F.transform(split, lambda x: F.concat_ws(" ", x["token"], x["next"]))


#: Lints of single cells: the details of their findings, as an array over the columns of :func:`_parsed`.
_OF_CELL = {
    "unbalanced": _unbalanced,
    "free_text": _free_text,
    "space_in_name": _space_in_name,
    "no_delimiter": lambda: _value_if(F.col("value").rlike(r"[)\]][A-Za-z]")),
    "stray_space": lambda: _value_if((F.col("value") != F.trim("value")) | F.contains("value", F.lit("  "))),
    "stacked": lambda: _valid(lambda w: w["marker"].rlike("(hi|lo|int)$") & (w["qualifier"] != "")),
    "bare": lambda: _valid(lambda w: w["qualifier"] == ""),
}


def _details(more: dict | None = None, only: str | None = None):
    """``lint, detail`` of all lints of single cells (or one), and of ``more``, as an array over the columns of :func:`_parsed`."""

    def named(lint: str, details):
        return F.transform(details, lambda d: F.struct(F.lit(lint).alias("lint"), d.alias("detail")))

    lints = {k: f for k, f in _OF_CELL.items() if only in (None, k)} | (more or {})
    return F.concat(*[named(k, f()) for k, f in lints.items()])


def _found(checked: DataFrame, only: str | None = None) -> DataFrame:
    """``row, subset, column, lint, detail`` of all lints of single cells (or one), in one pass over the cells."""
    return _parsed(checked).select("row", "subset", "column", F.inline(_details(only=only)))


def cell_issues(checked: DataFrame) -> DataFrame:
    """``row, subset, column, lint, severity, detail`` of every finding in a single cell: one scan, and no shuffle."""
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return _found(checked).select("row", "subset", "column", "lint", F.element_at(severity, F.col("lint")).alias("severity"), "detail")


def _one(checked: DataFrame, lint: str) -> DataFrame:
    return _found(checked, only=lint).select("lint", "row", "column", "detail")


def unbalanced(checked: DataFrame) -> DataFrame:
    """``lint, row, column, detail``, as for all lints of single cells: more of one bracket than of its counterpart."""
    return _one(checked, "unbalanced")


def free_text(checked: DataFrame) -> DataFrame:
    """Cells of at least four words of which more than half have no qualifier."""
    return _one(checked, "free_text")


def space_in_name(checked: DataFrame) -> DataFrame:
    """A word that begins with a digit after a word and a space: a marker's name with a space in it."""
    return _one(checked, "space_in_name")


def no_delimiter(checked: DataFrame) -> DataFrame:
    """A letter right after a closing bracket."""
    return _one(checked, "no_delimiter")


def stray_space(checked: DataFrame) -> DataFrame:
    """Spaces at an end, or two in a row."""
    return _one(checked, "stray_space")


def stacked(checked: DataFrame) -> DataFrame:
    """A qualifier on a marker that already ends in one."""
    return _one(checked, "stacked")


def bare(checked: DataFrame) -> DataFrame:
    """A marker without a qualifier."""
    return _one(checked, "bare")


def several_names(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``canonical, names``: antigens under more than one name."""
    grouped = canonical(found, aliases).groupBy("canonical").agg(F.sort_array(F.collect_set("marker")).alias("names"))
    return grouped.where(F.size("names") > 1)


def casing(found: DataFrame) -> DataFrame:
    """``folded, names``: markers in more than one casing."""
    grouped = found.groupBy(F.lower("marker").alias("folded")).agg(F.sort_array(F.collect_set("marker")).alias("names"))
    return grouped.where(F.size("names") > 1)


#: An innermost group with the negation after it, if it has one.
_GROUP = r"([(\[][^()\[\]]*[)\]]-?)"


def _both_ways(groups: DataFrame) -> DataFrame:
    """``group`` of ``groups (detail)`` that occur both with and without a negation."""
    split = groups.select(F.regexp_replace("detail", "-$", "").alias("group"), F.col("detail").endswith("-").cast("int").alias("negated"))
    return split.groupBy("group").agg(F.min("negated").alias("low"), F.max("negated").alias("high")).where("low < high").select("group")


def negated_and_not(checked: DataFrame) -> DataFrame:
    """``group``: innermost groups that occur both with and without a negation after them."""
    return _both_ways(checked.select(F.explode(F.regexp_extract_all("value", F.lit(_GROUP), 1)).alias("detail")))


def lint_summary(checked: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lint, severity, n, cells``: findings of each class that has any, and the distinct cells that they affect.

    Each distinct value is parsed once, and what is found in it is written. What the lints over
    the whole sheet compare, the names of markers and the groups, comes out of the same
    pass: each of the three looks for its few names or groups and then for the values that
    have one of them. Findings are counted by value, and only then are the cells, of which a
    value has any number, counted for each lint.
    """
    more = {"marker": lambda: F.transform(F.filter("words", lambda w: w["marker"] != ""), lambda w: w["marker"]), "group": lambda: F.regexp_extract_all("value", F.lit(_GROUP), 1)}
    values = checked.select(F.lit(0).alias("row"), F.lit("").alias("subset"), F.lit("").alias("column"), "value").distinct()
    found = cut(_parsed(values).select("value", F.inline(_details(more))), "issues")
    single = found.where(~F.col("lint").isin(*more)).groupBy("lint", "value").agg(F.count("*").alias("k"))

    named = found.where(F.col("lint") == "marker").select("value", F.col("detail").alias("marker")).distinct()
    names = canonical(named.select("marker").distinct(), aliases).select("marker", "canonical", F.lower("marker").alias("folded"))
    n, affected = None, single
    for lint, key in (("several_names", "canonical"), ("casing", "folded")):
        several = names.groupBy(key).agg(F.count_distinct("marker").alias("k")).where("k > 1").select(key)
        of = named.join(names.join(several, key, "left_semi").select("marker"), "marker", "left_semi")
        affected = affected.unionByName(of.select(F.lit(lint).alias("lint"), "value").distinct().withColumn("k", F.lit(0)))
        count = several.agg(F.count("*").alias("whole")).select(F.lit(lint).alias("lint"), "whole")
        n = count if n is None else n.unionByName(count)
    groups = found.where(F.col("lint") == "group").select("value", "detail").distinct().withColumn("group", F.regexp_replace("detail", "-$", ""))
    both = _both_ways(groups)
    of = groups.join(both, "group", "left_semi")
    affected = affected.unionByName(of.select(F.lit("negated_and_not").alias("lint"), "value").distinct().withColumn("k", F.lit(0)))
    n = n.unionByName(both.agg(F.count("*").alias("whole")).select(F.lit("negated_and_not").alias("lint"), "whole"))

    # a row for each value: how often each lint is found in it; cells that are stated twice are found twice, but are one cell
    listed = affected.groupBy("value").agg(F.collect_list(F.struct("lint", "k")).alias("lints"))  # at most one for each lint
    cells_ = checked.groupBy("row", "column", "value").agg(F.count("*").alias("times"))
    told = cells_.join(listed, "value").select("row", "column", "times", F.inline("lints"))
    one_cell = told.groupBy("row", "column", "lint").agg(F.sum(F.col("times") * F.col("k")).alias("k"))
    out = one_cell.groupBy("lint").agg(F.sum("k").alias("n"), F.count("*").alias("cells")).join(F.broadcast(n), "lint", "left").select("lint", F.coalesce("whole", "n").alias("n"), "cells")
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return out.where("n > 0").select("lint", F.element_at(severity, F.col("lint")).alias("severity"), "n", "cells")
