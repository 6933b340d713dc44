"""Lines, tokens and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each of these ends a line, so that CR LF ends two.
BREAK = "[\\n\\r]"
#: Runs of these are index tokens: letters, numbers and private use; case folds, marks split.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: A query splits on all else.
QUERY_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"

#: Code point ranges whose characters count as one token in 1.2, 2 and 1 characters.
WIDE = (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x3040, 0x30FF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F)
DENSE = (0x0530, 0x05FF), (0x0600, 0x08FF), (0x0900, 0x0DFF), (0x0F00, 0x0FFF), (0x10A0, 0x10FF), (0x1200, 0x139F), (0x13A0, 0x167F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)
SYMBOL = (0x200D, 0x200D), (0x20E3, 0x20E3), (0xFE0F, 0xFE0F), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x25FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0xFF00, 0xFF5F), (0x1F000, 0x1FFFF)
#: Characters for one token by density of code marks: over 0.3, over 0.1, else.
RATES = (4.2, 4.4, 4.8)


def lines(text: Column) -> Column:
    """The lines of a text, without breaks; an empty text has none, a final break starts none."""
    parts = F.split(text, BREAK, -1)
    return F.when((text == "") | text.rlike(r"[\n\r]\z"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_start(all_lines: Column, number: Column) -> Column:
    """Byte offset of a line (1-based): every break before it is one byte."""
    before = F.array_join(F.slice(all_lines, F.lit(1), number - 1), "\n")
    return F.when(number <= 1, F.lit(0)).otherwise(F.octet_length(before) + 1).cast("long")


def first_line(text: Column) -> Column:
    """The first line, without white space at its end."""
    return F.regexp_replace(F.get(F.split(text, "\r?\n"), F.lit(0)), r"\s+\z", "")


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    """Bytes [start, stop) of a text as UTF-8, clamped to its length."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(raw)
    low = F.least(start, size).cast("int")
    high = F.greatest(low, F.least(stop, size)).cast("int")
    return F.decode(F.substring(raw, low + 1, high - low), "UTF-8")


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_words(text: Column) -> Column:
    """A query's words in order, repeats included."""
    return F.transform(F.array_remove(F.split(text, QUERY_SPLIT), ""), F.lower)


def _count(text: Column, ranges: tuple) -> Column:
    body = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return F.length(F.regexp_replace(text, f"[^{body}]", ""))


def code_marks(text: Column) -> Column:
    """Signs of code: up to five for each line that is neither blank nor a comment."""

    def of(line: Column) -> Column:
        plain = F.trim(line)
        has = lambda *words: plain.rlike("|".join(words))
        signs = (
            has(r"[{}]"),
            F.contains(plain, F.lit(";")) & ~plain.endswith("."),
            has("fn ", "def ", "function ", "func "),
            has("->", "=>", "::"),
            has("^pub ", "^private ", "^public "),
        )
        total = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
        return F.when(plain.rlike(r"^(?://|#|$)"), 0).otherwise(total)

    return F.aggregate(F.transform(F.split(text, "\r?\n"), of), F.lit(0), lambda a, x: a + x)


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a text by script; in double precision."""
    wide, dense, symbol = _count(text, WIDE), _count(text, DENSE), _count(text, SYMBOL)
    rest = F.length(text) - wide - dense - symbol
    n_lines = F.greatest(F.size(lines(F.regexp_replace(text, "\r\n", "\n"))), F.lit(1))
    density = code_marks(text) / n_lines
    rate = F.when(density > 0.3, RATES[0]).when(density > 0.1, RATES[1]).otherwise(RATES[2])
    return F.ceil(wide / F.lit(1.2) + dense / F.lit(2.0) + symbol + rest / rate).cast("long")


def dense_estimate(text: Column) -> Column:
    """The estimate for pieces of an over-long line."""
    return F.greatest(token_estimate(text), F.ceil(F.length(text) / F.lit(2.5)).cast("long"))
