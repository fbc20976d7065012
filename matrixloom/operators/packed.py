"""Several values packed in one field: one row per item, with its position.

Quoted spans are replaced by indexed placeholders, what remains is split at any delimiter, the spans
are put back by an array lookup and the items exploded with their positions. All of it is built from
Spark's own array and string functions, so it stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The delimiters seen in list fields, among them the full-width comma and semicolon.
DELIMITERS = ",;|\t\n\r，；"
# Blanks that surround items.
BLANKS = " \t\n\r\x0b\x0c\u00a0" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u3000\ufeff"
MARK, END = "\u0001", "\u0002"


def packed_items(text: Column, delimiters: str = DELIMITERS) -> Column:
    """ARRAY<STRING> of the items of a packed field, in order.

    * Any mix of the delimiters separates items; those inside a quoted span belong to the item. A span
      opens with ``"`` or ``'`` at the start of an item and closes before a delimiter or the end, so an
      apostrophe within an item is an ordinary character; a quote mark doubled inside stands for one.
    * Enclosing ``[...]`` or ``{...}`` are marks of the list and dropped.
    * Items are trimmed, empty ones dropped; letter case and repeated items are kept.
    * null and blank text give an empty array; a quote that is never closed is an ordinary character.

    The placeholder of span ``i`` is MARK i END. A MARK in the text is first escaped as MARK s, which no
    placeholder can equal, so no text collides with a placeholder.
    """
    d = "[" + "".join("\\" + c if c in "|[]^-\\" else c for c in delimiters) + "]"
    # possessive groups: Java matches them in a loop, not by recursion, so long texts are safe
    quoted = "\"[^\"]*+(?:\"\"[^\"]*+)*+\"|'[^']*+(?:''[^']*+)*+'"
    blank = r"[ \u00a0\u2000-\u200b\u202f\u3000\ufeff]*+"
    # most characters are neither blank nor quote mark: they are passed by before the delimiter behind is looked for
    span = f"(?=[\"' \u00a0\u2000-\u200b\u202f\u3000\ufeff])(?<=^|{d}){blank}({quoted}){blank}(?=$|{d})"
    trim = lambda c: F.trim(c, F.lit(BLANKS))

    body = trim(F.coalesce(text, F.lit("")))
    body = F.when(body.rlike(r"(?s)^\[.*\]$|^\{.*\}$"), body.substr(F.lit(2), F.length(body) - 2)).otherwise(body)
    body = F.replace(body, F.lit(MARK), F.lit(MARK + "s"))

    def state(b: Column) -> Column:
        # without a quote mark there is no span to look for
        any_quote = b.contains('"') | b.contains("'")
        pieces = F.when(any_quote, F.split(b, span, -1)).otherwise(F.array(b))
        spans = F.when(any_quote, F.regexp_extract_all(b, F.lit(span), F.lit(1))).otherwise(F.array().cast("array<string>"))
        return F.struct(pieces.alias("pieces"), spans.alias("spans"))

    def unmark(c: Column) -> Column:
        return F.replace(c, F.lit(MARK + "s"), F.lit(MARK))

    def unquote(s: Column) -> Column:
        q = s.substr(1, 1)
        return F.replace(s.substr(F.lit(2), F.length(s) - 2), F.concat(q, q), q)

    def items(st: Column) -> Column:
        pieces, spans = st["pieces"], st["spans"]
        masked = F.array_join(
            F.transform(pieces, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(MARK), i.cast("string"), F.lit(END))).otherwise(p)), ""
        )

        def restore(t: Column) -> Column:
            at = F.try_element_at(spans, t.substr(F.lit(2), F.length(t) - 2).try_cast("int") + 1)
            return F.when(~t.contains(MARK), t).when(t.rlike(f"^{MARK}[0-9]+{END}$"), trim(unmark(unquote(at)))).otherwise(unmark(t))

        return F.filter(F.transform(F.transform(F.split(masked, d, -1), trim), restore), lambda x: x != "")

    # body and struct are bound once: they are not computed again for each use
    return F.flatten(F.transform(F.transform(F.array(body), state), items))


def explode_packed(df: DataFrame, keys: list[str], column: str, pos: str = "item_pos", item: str = "item", delimiters: str = DELIMITERS) -> DataFrame:
    """One row per item of ``column``: the key columns, ``pos`` (INT from 1) and ``item``.

    Other columns of ``df`` are not carried along, so they may have any name; a key may not be called
    like ``pos`` or ``item`` (ValueError). A row whose list is null, blank or holds only empty items
    gives no row. An empty table gives an empty result of the same schema.
    """
    if {pos, item} & set(keys):
        raise ValueError(f"{pos} and {item} may not be key columns; name them otherwise")
    lists = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], packed_items(F.col(f"`{column}`"), delimiters).alias("__items"))
    return lists.select(*[F.col(f"`{k}`") for k in keys], F.posexplode("__items").alias("__at", item)).select(
        *[F.col(f"`{k}`") for k in keys], (F.col("__at") + 1).cast("int").alias(pos), F.col(item)
    )


def one_list_per_key(df: DataFrame, key: str, columns: list[str], latest: str | None = None) -> DataFrame:
    """The row of each key that counts: the latest by ``latest``, then the greatest texts.

    Rows with a null key have no identity and are left out. The choice is an aggregate that combines
    before the shuffle, so one key holding a third of the rows is harmless.
    """
    order = [F.col(f"`{c}`") for c in ([latest] if latest else [])] + [F.col(f"`{c}`") for c in columns]
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__best")
    at = len(order) - len(columns)
    return (
        df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(best)
        .select(key, *[F.col(f"__best.o{at + i}").alias(c) for i, c in enumerate(columns)])
    )
