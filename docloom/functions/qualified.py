"""Qualified names: ``::``-separated parts with balanced brackets, operators and destructors.

A title is cut into words, ``::`` and single characters, and one fold over these pieces carries what the
scan knows so far: what it expects next, the depth of open brackets, the part being read, the
operator symbol being read, and the finished parts. All column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import normalize_ws

# Operator symbols that may follow the word "operator" in a name.
OPERATORS = (
    "()", "[]", "->*", "->", "<<=", ">>=", "<=>", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||",
    "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=",
    "+", "-", "*", "/", "%", "^", "&", "|", "~", "!", "=", "<", ">", ",",
)
_STARTS = sorted({symbol[:k] for symbol in OPERATORS for k in range(1, len(symbol) + 1)})
# What the scan expects: the head of a part; what follows a name, and a name with a blank behind it; the
# rest of a bracket group; nothing but the next part; an operator's symbol; the name after "~"; the
# type after "operator "; what follows that type; the name after the quotes of a literal. Or it failed.
HEAD, NAME, SPACED, INSIDE, DONE, SYMBOL, TILDE, TYPE, TYPED, LITERAL, FAILED = range(11)


def split_qualified(title: Column) -> Column:
    """The parts of a qualified name; null when the title is not one. A symbol is read as long as it can be."""
    pieces = F.regexp_extract_all(normalize_ws(title), F.lit(r"(?Us)::|\w+|."), F.lit(0))

    def state(mode, depth, part, symbol, parts) -> Column:
        mode = mode if isinstance(mode, Column) else F.lit(mode)
        return F.struct(mode.alias("mode"), depth.alias("depth"), part.alias("part"), symbol.alias("symbol"), parts.alias("parts"))

    def step(s: Column, p: Column) -> Column:
        mode, depth, part, symbol, parts = (s[c] for c in ("mode", "depth", "part", "symbol", "parts"))
        none, blank, apart = F.lit(""), p == " ", p == "::"
        word, operator = p.rlike("^[A-Za-z_]"), p == "operator"
        failed = state(FAILED, depth, none, none, parts)
        ended = state(HEAD, F.lit(0), none, none, F.concat(parts, F.array(F.trim(part))))
        longer = F.concat(symbol, p)

        def on(to, new=None, new_symbol=none, new_depth=None) -> Column:
            return state(to, F.lit(0) if new_depth is None else new_depth, F.concat(part, p) if new is None else new, new_symbol, parts)

        opened = on(INSIDE, new_depth=F.lit(1))
        closed = depth + F.when(p.isin("<", "("), 1).when(p.isin(">", ")"), -1).otherwise(0)
        whole = symbol.isin(*OPERATORS)
        return (
            F.when(mode == HEAD, F.when(blank, s).when(operator, on(SYMBOL)).when(word, on(NAME)).when(p == "~", on(TILDE)).otherwise(failed))
            .when(mode == TILDE, F.when(word & ~operator, on(NAME)).otherwise(failed))
            .when(mode.isin(NAME, SPACED), F.when(p == "<", opened).when(apart, ended).when(blank & (mode == NAME), on(SPACED)).otherwise(failed))
            .when(mode == INSIDE, F.when(closed > 0, on(INSIDE, new_depth=closed)).otherwise(on(DONE)))
            .when(mode == DONE, F.when(blank, s).when(apart, ended).otherwise(failed))
            .when(
                mode == SYMBOL,
                F.when((symbol == "") & blank, on(TYPE))
                .when((p == '"') & symbol.isin("", '"'), on(F.when(symbol == '"', LITERAL).otherwise(SYMBOL), new_symbol=longer))
                .when(longer.isin(*_STARTS), on(SYMBOL, new_symbol=longer))
                .when(whole & blank, on(DONE))
                .when(whole & apart, ended)
                .otherwise(failed),
            )
            .when(mode == LITERAL, F.when(blank, on(LITERAL)).when(word, on(DONE)).otherwise(failed))
            .when(mode == TYPE, F.when(word, on(TYPED)).otherwise(failed))
            .when(mode == TYPED, F.when(p == "<", opened).when(blank, on(DONE)).when(apart, ended).otherwise(failed))
            .otherwise(s)
        )

    start = state(HEAD, F.lit(0), F.lit(""), F.lit(""), F.array().cast("array<string>"))

    def finish(s: Column) -> Column:
        complete = s["mode"].isin(NAME, SPACED, DONE, TYPED) | ((s["mode"] == SYMBOL) & s["symbol"].isin(*OPERATORS))
        return F.when(complete, F.concat(s["parts"], F.array(F.trim(s["part"]))))

    return F.aggregate(pieces, start, step, finish)
