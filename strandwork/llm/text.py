"""Words of a text, free of markup and variant forms, with their places in the original."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame

TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});")
TOKEN = re.compile(r"\S+")
NOT_WORD = re.compile(r"[\W_]+")
#: Stands in for characters that are not seen, so that offsets stay as they are; NOT_WORD removes it.
PAD = "­"


def _entity(found: re.Match) -> str:
    char = html.unescape(found[0])
    if len(char) != 1:
        return found[0]
    return char + (PAD if char.isalnum() else " ") * (len(found[0]) - 1)


def fold(token: str) -> str:
    """Letters and digits of `token` in lower case; compatibility forms, accents and invisible characters are gone."""
    if not token.isascii():
        token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c)).casefold()
    return NOT_WORD.sub("", token.lower())


def folded_words(text: str) -> list[tuple[str, int, int]]:
    """(folded word, start, end) of each white-space separated word of `text` that has a letter or digit.

    Tags and entities count as what they show. Start and end are places in `text` as it was given.
    """
    if "<" in text:
        text = TAG.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = ENTITY.sub(_entity, text)
    return [(word, m.start(), m.end()) for m in TOKEN.finditer(text) if (word := fold(m[0]))]


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` in at least as many partitions as the session's shuffles, for work that is heavy per row.

    A large input has more splits than that and stays as it is; only an input of few files is shuffled.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least, key)
