"""Document fingerprints by Order MinHash.

A text is cut into tokens: its words, longer ones in pieces of ``PIECE`` code points. Its k-mers are windows of ``K``
tokens, numbered by occurrence, so that a k-mer met twice is two elements. Every element has one 64-bit hash, whose upper
bits deal it to one of ``SLOTS`` slots. A slot selects its ``TUPLE`` elements of least hash, puts them back in the order in
which they stand in the text and hashes that tuple. Two texts agree in a slot only if they share its least elements in the
same order, so the share of equal slots falls with moved passages as well as with replaced ones, which a plain MinHash does
not see: the signature follows edit distance.

Hash, slot and position of an element are one BIGINT, so selection is one sort of an array of numbers and one
filter. All is column expressions, in steps of their own, so that nothing is worked out twice.

Defined cases: a NULL text counts as empty; a text without words has the empty fingerprint; fewer than ``K`` tokens are one
k-mer; slots without elements are left out, in likeness too, and two empty fingerprints are alike by 1. Equal
texts have equal fingerprints. Rows of equal id and text are one document in the order; of texts under one id that of
lesser hash comes first, NULL ids come first; the only document of a table is followed by itself; an empty table gives no
rows. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.store import positions, small
from pixelloom.llm.text import fresh

K, TUPLE, PIECE = 3, 2, 16
#: Bits of an element's number: slot, rest of the hash, position. 2^30 tokens do not fit in a string.
SLOT_BITS, HASH_BITS, PLACE_BITS = 6, 28, 30
SLOTS = 1 << SLOT_BITS
#: Bits of a tuple's hash that are kept.
KEPT_BITS = 16
#: Neighbouring documents that meet in one group to be joined with the next one.
BLOCK = 256

_PLACE = (1 << PLACE_BITS) - 1


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS + HASH_BITS)


def _element(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def kmers(token: Column) -> Column:
    """Hashes of the windows of ``K`` tokens, in order; ``token`` must be a plain column."""
    n = F.size(token)
    return (F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[token[i + j] for j in range(K)])))
            .when(n > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(token, " ")))).otherwise(F.array().cast("array<bigint>")))


def _changes(ordered: Column, part) -> Column:
    """The places of a sorted array where ``part`` of the element differs from that of the element before."""
    return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (part(ordered[i]) != part(ordered[i - 1])))


def _numbered(ordered: Column, starts: Column) -> Column:
    """Elements with the hash of a k-mer's later occurrences changed by their number. Runs of equal hashes begin at ``starts``."""
    def later(x: Column, o: Column) -> Column:
        again = _element(F.xxhash64(x.bitwiseAND(F.lit(~_PLACE)), o), x.bitwiseAND(F.lit(_PLACE)))
        return F.when(o == 0, x).otherwise(again)

    return F.flatten(F.transform(starts, lambda a, r: F.transform(
        F.slice(ordered, a + 1, F.coalesce(F.get(starts, r + 1), F.size(ordered)) - a), later)))


def _tuples(least: Column, starts: Column) -> Column:
    """slot << KEPT_BITS | hash of each slot's elements in text order; slots begin at ``starts``."""
    kept = (1 << SLOT_BITS + HASH_BITS) - 1

    def of(a: Column, r: Column) -> Column:
        part = F.slice(least, a + 1, F.coalesce(F.get(starts, r + 1), F.size(least)) - a)
        placed = F.sort_array(F.transform(part, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), SLOT_BITS + HASH_BITS).bitwiseOR(
            F.shiftrightunsigned(x, PLACE_BITS))))
        tuple_hash = F.xxhash64(F.transform(placed, lambda x: x.bitwiseAND(F.lit(kept))))
        return F.shiftleft(_slot(least[a]), KEPT_BITS).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)))
    return F.transform(starts, of)


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text as an array of one BIGINT per slot, in order of slots. No shuffle."""
    token, hashes, ordered, starts, least, slots = fresh(df, "__token", "__hashes", "__ordered", "__starts", "__least", "__slots")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none, numbers = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    high = lambda x: F.shiftright(x, PLACE_BITS)
    steps = (
        (token, F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))),
        (hashes, kmers(F.col(token))),
        (ordered, F.sort_array(F.transform(hashes, _element))),
        (starts, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _changes(F.col(ordered), high)).otherwise(none)),
        (ordered, F.when(F.size(starts) > 0, F.sort_array(_numbered(F.col(ordered), F.col(starts)))).otherwise(F.col(ordered))),
        (least, F.filter(ordered, lambda x, i: (i < TUPLE) | (_slot(F.col(ordered)[i - TUPLE]) != _slot(x)))),
        (slots, F.when(F.size(least) > 0, _changes(F.col(least), _slot)).otherwise(none)),
        (name, F.when(F.size(slots) > 0, F.sort_array(_tuples(F.col(least), F.col(slots)))).otherwise(numbers)),
    )
    out = df
    for column, value in steps:
        out = out.withColumn(column, value)
    return out.drop(token, hashes, ordered, starts, least, slots)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots among those that either fingerprint has."""
    slots = lambda x: F.transform(x, lambda e: F.shiftright(e, KEPT_BITS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(slots(a), slots(b))))


def shown(fingerprint: Column) -> Column:
    """A fingerprint as text: slot and hash in hexadecimal, slot by slot."""
    return F.array_join(F.transform(fingerprint, lambda e: F.lpad(F.lower(F.hex(e)), (SLOT_BITS + 7) // 8 * 2 + KEPT_BITS // 4, "0")), "")


def _with_next(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` (id, tk and ``columns``) with the columns of the document that follows, under their new names; after the last, the first.

    Only ids and hashes are put in order. Then rows of neighbouring positions meet in blocks, and the
    first row of each block also goes to the block before.
    """
    order = positions(rows.select("id", "tk").distinct(), [F.col("id").asc_nulls_first(), F.col("tk")], "place")
    many = order.count()
    placed = rows.join(small(order.select(F.col("id").alias("__id"), F.col("tk").alias("__tk"), "place")),
                       F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk"))).drop("__id", "__tk")
    at = lambda place: F.floor(place / BLOCK).alias("block")
    own = F.struct(at(F.col("place")), F.col("place").alias("place"), F.lit(True).alias("own"))
    after = F.when(F.col("place") == 0, F.lit(many)).otherwise(F.col("place"))
    ahead = F.struct(at(after - 1), after.alias("place"), F.lit(False).alias("own"))
    spots = F.explode(F.when(F.col("place") % BLOCK == 0, F.array(own, ahead)).otherwise(F.array(own))).alias("__spot")
    dealt = placed.select("*", spots).drop("place").select("*", "__spot.*").drop("__spot")
    following = Window.partitionBy("block").orderBy("place").rangeBetween(1, 1)
    return dealt.withColumns({new: F.first(old).over(following) for old, new in columns.items()}).where("own").drop("block", "place", "own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text, n_chars, print (array), next_text, next_print of the document that follows by id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    rows = with_fingerprint(rows, "text", "print")
    found = _with_next(rows, {"text": "next_text", "print": "next_print"})
    return found.select(F.col("id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"), "print", "next_text", "next_print")


def edited(found: DataFrame) -> DataFrame:
    """``fingerprints`` rows with ``edited``, the text whose second half gives way to the beginning of the next one, and ``edited_print``."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    length = F.col("n_chars").cast("int")
    return with_fingerprint(found.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), length - half), F.substring("next_text", F.lit(1), half))), "edited", "edited_print")
