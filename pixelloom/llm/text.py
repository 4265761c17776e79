"""Words, shingles and small expression helpers that the operators of this package share.

Everything here is a Column expression; nothing runs Python per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space between words, and as a word.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

SHINGLE = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; a NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def shingle_hashes(word: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of all k-word windows of a word array, in order and with repeats.

    Fewer than ``k`` words make one window, the whole sequence; no words make none. ``word`` must be
    a plain column or a ``let`` variable, else it is computed again for every window.
    """
    n = F.size(word)
    return (
        F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[word[i + j] for j in range(k)])))
        .when(n > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(word, " "))))
        .otherwise(F.array().cast("array<bigint>")))


def text_shingles(text: Column, k: int = SHINGLE) -> Column:
    """Shingle hashes of the lower-cased words of a text."""
    return let(words(F.lower(text)), lambda w: shingle_hashes(w, k))


def shingle_strings(text: Column, k: int = SHINGLE) -> Column:
    """The distinct shingles of a text as strings, for exact comparison."""
    return let(words(F.lower(text)), lambda w: F.array_distinct(
        F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *[w[i + j] for j in range(k)])))
        .when(F.size(w) > 0, F.array(F.concat(F.lit("\n"), F.array_join(w, " "))))
        .otherwise(F.array().cast("array<string>"))))


def window_hashes(word: Column, k: int) -> Column:
    """64-bit hashes of all k-word windows of a word array; none where there are fewer words. ``word`` as in ``shingle_hashes``."""
    n = F.size(word)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[word[i + j] for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>"))


def window_strings(word: Column, k: int) -> Column:
    """The same windows as strings."""
    n = F.size(word)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *[word[i + j] for j in range(k)]))).otherwise(
        F.array().cast("array<string>"))


def digest_bits(*key: Column, seed: str = "") -> Column:
    """A BIGINT of 60 evenly spread bits from the key's MD5; NULL counts as a value of its own."""
    parts = F.concat_ws("\n", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in key])
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
