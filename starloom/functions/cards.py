"""Fixed-width header cards inside one row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from starloom.functions.let import let, pack

CARD = 80


def split_cards(text: Column) -> Column:
    """80-column cards up to, but without, END; NULL when there is no END."""

    def cut(t: Column) -> Column:
        n = F.floor(F.length(t) / CARD).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(t, i * CARD + 1, F.lit(CARD))
        )

    def until_end(cards: Column) -> Column:
        at = F.array_position(F.transform(cards, card_keyword), "END").cast("int")
        return let(pack(cards=cards, at=at), lambda s: F.when(s["at"] > 0, F.slice(s["cards"], F.lit(1), s["at"] - 1)))

    return let(let(text, cut), until_end)


def card_keyword(card: Column) -> Column:
    return F.trim(F.substring(card, 1, 8))


def is_value_card(card: Column) -> Column:
    return (card_keyword(card) != "") & (F.substring(card, 9, 2) == "= ")


def is_quoted(raw: Column) -> Column:
    return raw.rlike(r"^[^/]*'")


def card_value(raw: Column) -> Column:
    """Value in the text after ``= ``: quoted text with doubled quotes undone and trailing
    blanks dropped, else the word before the slash."""
    inner = F.regexp_extract(raw, r"^[^']*'((?:[^']++|'')*+)", 1)
    return F.when(is_quoted(raw), F.rtrim(F.regexp_replace(inner, "''", "'"))).otherwise(
        F.trim(F.regexp_extract(raw, r"^[^/]*", 0))
    )


def card_comment(raw: Column) -> Column:
    after = F.regexp_extract(raw, r"^[^']*'(?:[^']++|'')*+'[^/]*/(.*)$", 1)
    return F.trim(F.when(is_quoted(raw), after).otherwise(F.regexp_extract(raw, r"^[^/]*/(.*)$", 1)))


def words(text: Column) -> Column:
    """struct(keys, raws) of the value cards of a header, in order."""

    def pick(cards: Column) -> Column:
        return let(
            F.filter(cards, is_value_card),
            lambda v: pack(keys=F.transform(v, card_keyword), raws=F.transform(v, lambda c: F.substring(c, 11, CARD))),
        )

    return let(split_cards(text), pick)


def word(header: Column, keyword: str | Column) -> Column:
    """Value of a keyword (its first card), NULL when absent. ``header`` from :func:`words`."""
    at = F.array_position(header["keys"], keyword).cast("int")
    return let(F.get(header["raws"], at - 1), lambda raw: F.when(raw.isNotNull(), card_value(raw)))
