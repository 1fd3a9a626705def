"""The marker-expression grammar as column expressions.

An expression is an optional gate ``live/``, then terms separated by spaces (AND). A
term is a marker with an optional qualifier, or a group in round or square brackets
whose terms are separated either all by spaces or all by bars (OR), and which may have
a qualifier after it. :func:`error` validates with a pushdown automaton: a fold over
the tokens whose accumulator holds a state, a stack of open groups and the first
error. A token's kind and split are worked out once, before the fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import c, quoted

# Fixed values of the grammar.
GATE = "live/"
TOKEN = r"( +|[()\[\]|]|[^ ()\[\]|]+)"
LEVEL = r"(?:lo|hi|int|[+\-])"
QUALIFIER = rf"{LEVEL}(?:/{LEVEL})*"
WORD = rf"^([A-Za-z][A-Za-z0-9.\-]*?)({QUALIFIER})?$"


def tokens(expression: Column | str) -> Column:
    """Spaces (as one), brackets, bars and words, in order."""
    found = F.regexp_extract_all(c(expression), F.lit(TOKEN), 1)
    return F.transform(found, lambda t: F.when(t.startswith(" "), " ").otherwise(t))


def marker(word: Column | str) -> Column:
    """The marker of a word, without its longest qualifier; empty if the word is invalid."""
    return F.regexp_extract(c(word), WORD, 1)


def qualifier(word: Column | str) -> Column:
    """The longest qualifier that leaves a marker; empty if there is none."""
    return F.regexp_extract(c(word), WORD, 2)


def is_word(token: Column) -> Column:
    return ~token.isin(" ", "(", ")", "[", "]", "|")


# States of the automaton, named for what came before.
_START, _GATE, _SPACE_FIRST, _TERM_NEXT, _AFTER, _AFTER_SPACE, _OPENED, _IN, _IN_SPACE, _CLOSED, _STOP = range(11)


def _step(acc: Column, tok: Column) -> Column:
    """One token: the next (state, stack, error). The stack's last character is the open group's closer with
    the separator seen in it: lower-case letters stand for ``)`` and upper-case for ``]``; n: none, w: space, b: bar."""
    state, stack = acc["state"], acc["stack"]
    text, kind = tok["text"], tok["kind"]
    is_end, space = kind == "E", kind == "S"
    empty = stack == ""
    top = F.right(stack, F.lit(1))
    rest = F.substring(stack, F.lit(1), F.length(stack) - 1)
    square = F.upper(top) == top
    closes = ((kind == "]") & square) | ((kind == ")") & ~square)
    separator = F.lower(top)

    def to(new: int, with_stack: Column = stack) -> Column:
        return F.struct(F.lit(new).alias("state"), with_stack.alias("stack"), F.lit(None).cast("string").alias("error"))

    def fail(message: Column) -> Column:
        return F.struct(F.lit(_STOP).alias("state"), stack.alias("stack"), message.alias("error"))

    def mark(letter: str) -> Column:
        return F.concat(rest, F.when(square, letter.upper()).otherwise(letter))

    shown = F.when(is_end, F.lit("None")).otherwise(quoted(text))
    term = (
        F.when(kind == "(", to(_OPENED, F.concat(stack, F.lit("n"))))
        .when(kind == "[", to(_OPENED, F.concat(stack, F.lit("N"))))
        .when((kind == "W") & tok["valid"], F.when(empty, to(_AFTER)).otherwise(to(_IN)))
        .when(kind == "W", fail(F.concat(F.lit("invalid marker token "), quoted(text))))
        .otherwise(fail(F.concat(F.lit("expected marker or group, found "), shown)))
    )
    nothing = fail(F.lit("empty expression"))
    mixed = fail(F.lit("mixed '|' and space in a group"))
    after = (
        F.when(space, to(_AFTER_SPACE))
        .when(is_end, to(_STOP))
        .when(kind == "|", fail(F.lit("top-level '|' must be inside a group")))
        .otherwise(fail(F.concat(F.lit("missing space before "), shown)))
    )
    inside = (
        F.when(closes, to(_CLOSED, rest))
        .when((kind == "|") & (separator == "w"), mixed)
        .when(kind == "|", to(_OPENED, mark("b")))
        .when(space, to(_IN_SPACE))
        .when(is_end, fail(F.concat(F.lit("missing '"), F.when(square, "]").otherwise(")"), F.lit("'"))))
        .otherwise(fail(F.concat(F.lit("unexpected "), shown, F.lit(" in group"))))
    )
    # a space inside a group is only a separator if another term follows; the term itself sees the stack marked
    in_space = (
        F.when(closes, to(_CLOSED, rest))
        .when(separator == "b", mixed)
        .when(kind == "(", to(_OPENED, F.concat(mark("w"), F.lit("n"))))
        .when(kind == "[", to(_OPENED, F.concat(mark("w"), F.lit("N"))))
        .when((kind == "W") & tok["valid"], to(_IN, mark("w")))
        .otherwise(term)
    )
    return (
        F.when(state == _STOP, acc)
        .when(state == _START, F.when(is_end, nothing).when((kind == "W") & (text == GATE), to(_GATE)).when(space, to(_SPACE_FIRST)).otherwise(term))
        .when(state == _GATE, F.when(is_end, nothing).when(space, to(_SPACE_FIRST)).otherwise(term))
        .when(state == _SPACE_FIRST, F.when(is_end, nothing).otherwise(term))
        .when(state == _TERM_NEXT, term)
        .when(state == _OPENED, F.when(space, to(_TERM_NEXT)).otherwise(term))
        .when(state == _AFTER, after)
        .when(state == _AFTER_SPACE, F.when(is_end, to(_STOP)).otherwise(term))
        .when(state == _IN, inside)
        .when(state == _IN_SPACE, in_space)
        .otherwise(F.when((kind == "W") & tok["qualifier"], F.when(empty, to(_AFTER)).otherwise(to(_IN))).when(empty, after).otherwise(inside))
    )


def error(expression: Column | str) -> Column:
    """The first error of an expression, or null if it is valid."""
    found = tokens(expression)
    parts = F.transform(
        F.concat(found, F.array(F.lit(""))),  # an empty token, which no text has, ends the expression
        lambda t: F.struct(
            t.alias("text"),
            F.when(t == "", "E").when(t == " ", "S").when(is_word(t), "W").otherwise(t).alias("kind"),
            t.rlike(WORD).alias("valid"),
            t.rlike(f"^{QUALIFIER}$").alias("qualifier"),
        ),
    )
    start = F.struct(F.lit(_START).alias("state"), F.lit("").alias("stack"), F.lit(None).cast("string").alias("error"))
    return F.aggregate(parts, start, _step, lambda acc: acc["error"])
