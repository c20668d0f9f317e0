"""String column expressions: hashing, line splitting, word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the line boundaries of Unicode text (CRLF counts once).
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
WORD_BREAK = "[ \n.,]+"


def text_hash(text: Column) -> Column:
    """Lower-hex SHA-256 of the UTF-8 bytes; NULL stays NULL."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def strip_final_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+\z", "")


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no empty last line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def word_tokens(text: Column) -> Column:
    """Lower-case words, empties dropped."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def word_ids(text: Column) -> Column:
    """Stable 28-bit token ids of the words of a text."""
    return F.transform(
        word_tokens(text),
        lambda word: F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int"),
    )


def character_ids(text: Column) -> Column:
    """Code points of a text, one id per character."""
    return F.transform(
        F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
        lambda char: F.ascii(char).cast("int"),
    )
