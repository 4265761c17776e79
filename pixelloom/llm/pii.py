"""Personal data: spans of four kinds, and terms that would give a removed value away.

Base kinds are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found by pattern with
their positions in code points. Their values are the protected entities. A term next to an entity may
disclose it although the value itself is removed, so the corpus decides by information content:

    IC(e) = -log2 p(e),   PMI(e; t) = log2(p(e, t) / (p(e) p(t)))

where p counts documents and (e, t) those that mention e and hold t anywhere. A term that always comes with e has
PMI = IC(e): it tells all there is to tell. A term discloses e if PMI >= ``ALPHA`` * IC(e) and the two were met in at
least ``SUPPORT`` different contexts. The context of a document is the ``NEAR`` words on each side of its mention, of
several mentions that of least hash (words as far as they lie in ``REACH`` code points; it only tells documents apart): copies and near copies of one document have one context, so their words tell nothing.
Every word is a term, of any length, also of digits; in a text without spaces that is the whole run. Occurrences of the
term in documents that mention e are spans of kind ``term``; they are removed if the term alone points to e more often
than not, else generalised.

Only entities with enough contexts are looked at, and only documents that mention them are cut into pairs. Pairs are
counted with partial sums, so an entity that most documents mention is split like any group; terms are counted everywhere
first, and those too frequent to disclose the entity at hand are left out of its pairs before the shuffle.

Defined cases: a NULL or empty text has no spans; overlapping spans of different kinds all stay, terms that
touch a base span do not count; rows of equal id and text are one document and get equal results; an empty table gives
none. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.containment import row_key
from pixelloom.llm.store import small, written
from pixelloom.llm.text import WORD, let, words

KINDS = ("email", "ip", "card", "phone")
NEAR, REACH, SUPPORT, ALPHA = 5, 80, 3, 0.9
#: Frequent terms that go to all tasks, and their longest; what is among them changes speed and nothing else.
HEAD, LONGEST = 100_000, 64

_LOCAL, _DOMAIN = r"A-Za-z0-9._%+\x01-", "A-Za-z0-9-"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A match can only start where a run of its characters starts, or where the last match ended (\G). \x01 stands
#: for a mark inside an address or a number (see ``_marked``), so no group repeats and long runs need no stack.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]++\x01[{_DOMAIN}\x01]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])[0-9][0-9\x01]{12,36}+(?![0-9\x01])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY_HAVE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{11,}[0-9]", "phone": r"\+[0-9]"}
_EMPTY = "array<struct<start:int,end:int,value:string>>"


def _marked(text: Column, kind: str) -> Column:
    """``text`` with the inner marks of a kind as \\x01, in place: lengths do not change."""
    free = F.replace(text, F.lit("\x01"), F.lit("\x02"))
    if kind == "email":
        return F.regexp_replace(free, rf"(?<=[{_DOMAIN}])\.(?=[{_DOMAIN}])", "\x01")
    return F.regexp_replace(free, r"(?<=[0-9])[ -](?=[0-9])", "\x01") if kind == "card" else text


def running(sizes: Column, levels: int = 3) -> Column:
    """The sum of all elements before each element of an array, which must be a plain column or a ``let`` variable.

    Sums of runs of 64 are summed in the same way, so an array of n takes some 64 n steps up to 64^4 elements.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(starts: Column) -> Column:
        return F.transform(sizes, lambda _, i: starts[F.floor(i / 64).cast("int")] + total(
            F.slice(sizes, (F.floor(i / 64) * 64 + 1).cast("int"), i % 64)))

    if not levels:
        sums = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(sums, F.lit(1), F.size(sizes))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 64).cast("int")), lambda b: total(F.slice(sizes, b * 64 + 1, F.lit(64))))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(runs, lambda r: let(running(r, levels - 1), of)))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches nothing, as an array of (start, end, value), in order.

    What lies between matches and the matches themselves give the positions, in code points.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        sizes = F.transform(m["f"], lambda v, i: F.length(m["g"][i]) + F.length(v))
        return let(sizes, lambda size: let(running(size), lambda s: F.transform(m["f"], lambda v, i: F.struct(
            (s[i] + size[i] - F.length(v)).alias("start"), (s[i] + size[i]).alias("end"), v.alias("value")))))
    return let(F.struct(gaps.alias("g"), found.alias("f")), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """The valid spans of a base kind: array of (start, end, value); inner marks of values are \\x01."""
    found = F.filter(matches(_marked(text, kind), PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(_MAY_HAVE[kind]), found).otherwise(F.array().cast(_EMPTY))


def term(word: Column) -> Column:
    """The form in which words are counted: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")


def text_terms(text: Column) -> Column:
    """The distinct terms of a text: those that ``term`` gives for its words."""
    return F.array_distinct(words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")))


def _mentions(text: Column, kind: str, spans: Column) -> Column:
    """(entity, context) of each span."""
    value = {"email": lambda v: F.lower(F.replace(v, F.lit("\x01"), F.lit("."))), "ip": lambda v: v}.get(kind, lambda v: F.regexp_replace(v, "[^0-9]", ""))

    def of(s: Column) -> Column:
        left = words(F.substring(text, F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH))))
        right = words(F.substring(text, s["end"] + 1, F.lit(REACH)))
        near = let(left, lambda x: F.slice(x, F.greatest(F.size(x) - NEAR + 1, F.lit(1)), F.lit(NEAR)))
        return F.struct(F.concat(F.lit(f"{kind}:"), value(s["value"])).alias("entity"),
                        F.xxhash64(F.concat(near, F.slice(right, 1, NEAR))).alias("context"))
    return F.transform(spans, of)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, email, ip, card, phone, mentions), one row per row of ``docs``. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), text.alias("text"),
                        *[spans_of(text, k).alias(k) for k in KINDS])
    mentions = F.concat(*[_mentions(F.col("text"), k, F.col(k)) for k in KINDS])
    return found.select("key", "id", *KINDS, mentions.alias("mentions"))


def mentioned(base: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(key, entity, context): the documents of every entity that has ``support`` contexts at least, written."""
    each = base.select("key", F.explode("mentions").alias("m")).groupBy("key", "m.entity").agg(F.min("m.context").alias("context"))
    known = written(each, "mentions")
    contexts = known.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    return written(known.join(small(written(contexts.where(F.col("contexts") >= support).select("entity"), "entities")), "entity", "left_semi"), "mentioned")


def _once(docs: DataFrame, base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) with one row per key. Only rows that are repeated are shuffled."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = written(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated-keys")
    if repeated.isEmpty():
        return rows
    return rows.join(small(repeated), "key", "left_anti").union(rows.join(small(repeated), "key", "left_semi").dropDuplicates(["key"]))


def _frequent(terms: DataFrame, above: float) -> DataFrame:
    """Of (term, n_t) the terms that more than ``above`` documents hold, the ``HEAD`` most frequent at most (by powers of two), for broadcast."""
    level = F.floor(F.log2(F.col("n_t"))).cast("int")
    known = terms.where((F.col("n_t") > above) & (F.length("term") <= LONGEST))
    least, total = 64, 0
    for row in known.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 63 rows at most
        total += row.n
        if total > HEAD:
            break
        least = row.level
    return F.broadcast(known.where(level >= least))


def told_terms(docs: DataFrame, base: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               support: int = SUPPORT, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame, int]:
    """(term, n_t) of all documents, (key, entity, n_e, context, term) of those that mention an entity of ``told``, and the number of documents.

    A pair can't reach the threshold if more than n^(1-alpha) * n_e^alpha documents hold the term: where the term is known as
    frequent, such pairs go in the task that cuts the text, so mostly rare terms are counted by pair. Entities are found in
    the row again, so no text meets its mentions in a shuffle.
    """
    n = max(1, base.select("key").distinct().count())
    texts = _once(docs, base, id_col, text_col)
    terms = written(texts.select(F.explode(text_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(
        F.col("n_t") >= support), "term-counts")
    bound = lambda n_e: n_e ** alpha * n ** (1 - alpha) * 1.001  # noqa: E731  rounding may not drop a pair at the threshold
    entities = small(written(told.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).withColumn(
        "most", F.pow("n_e", F.lit(alpha)) * (n ** (1 - alpha) * 1.001)), "told-entities"))
    mentions = let(F.sort_array(F.concat(*[_mentions(F.col("text"), k, spans_of(F.col("text"), k)) for k in KINDS])), lambda m: F.filter(
        m, lambda x, i: (i == 0) | (F.get(m, i - 1)["entity"] != x["entity"])))  # the least context of each entity
    near = texts.select("key", "text", F.explode(mentions).alias("m")).select("key", "text", "m.*").join(entities, "entity")
    each = near.select("key", "entity", "n_e", "most", "context", F.explode(text_terms(F.col("text"))).alias("term"))
    kept = each.join(_frequent(terms, bound(support)), "term", "left").where(F.col("n_t").isNull() | (F.col("n_t") <= F.col("most")))
    return terms, written(kept.select("key", "entity", "n_e", "context", "term"), "told-terms"), n


def disclosures(docs: DataFrame, base: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(entity, term, pmi, ic, points): the terms that disclose an entity of ``told``; ``points`` is p(e | t)."""
    return _disclosing(*told_terms(docs, base, told, id_col, text_col, support, alpha), support, alpha)


def _disclosing(terms: DataFrame, met: DataFrame, n: int, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``disclosures`` from the tables of ``told_terms``."""
    total = F.lit(float(n))
    joint = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e")).where(F.col("n_et") >= support)
    pmi = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    strong = written(joint.join(terms, "term").withColumns({"pmi": pmi, "ic": F.log2(total / F.col("n_e"))}).where(
        (F.col("pmi") > 0) & (F.col("pmi") >= F.lit(alpha) * F.col("ic"))), "strong-pairs")
    contexts = met.join(small(strong.select("entity", "term")), ["entity", "term"], "left_semi").groupBy("entity", "term", "context").agg(
        F.count(F.lit(1)).alias("c")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    return strong.join(contexts.select("entity", "term"), ["entity", "term"]).select(
        "entity", "term", "pmi", "ic", F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0)).alias("points"))


def term_spans(docs: DataFrame, base: DataFrame, met: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, term spans): where disclosing terms stand in documents that mention their entity, which ``met`` lists."""
    here = written(met.join(small(found.select("entity", "term", "points")), ["entity", "term"]).groupBy("key", "term").agg(
        F.max("points").alias("points")), "disclosing-terms")
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(
        small(here.select("key").distinct()), "key", "left_semi")
    # cut before any shuffle: few texts may hold most of the words
    placed = texts.select("key", F.explode(matches(F.col("text"), WORD)).alias("w")).select("key", "w.*").withColumn("term", term(F.col("value")))
    hit = placed.join(small(here), ["key", "term"]).join(
        base.dropDuplicates(["key"]).select("key", F.concat(*KINDS).alias("taken")), "key")
    free = ~F.exists("taken", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return hit.where(free).groupBy("key").agg(F.sort_array(F.collect_set(F.struct(
        "start", "end", F.when(F.col("points") > 0.5, "removed").otherwise("generalised").alias("action")))).alias("terms"))


def _listed(kind: str) -> Column:
    return F.transform(kind if kind != "term" else "terms", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, id, counts by base kind, base (all base spans as text), spans (with terms), and the arrays."""
    base = written(base_spans(docs, id_col, text_col), "base-spans")
    counts, met, n = told_terms(docs, base, mentioned(base), id_col, text_col)
    terms = term_spans(docs, base, met, written(_disclosing(counts, met, n), "disclosures"), id_col, text_col)
    out = base.drop("mentions").join(terms, "key", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")))
    return out.select(
        "key", "id", *KINDS, "terms", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size("terms").cast("long").alias("n_term"),
        F.array_join(F.concat(*[_listed(k) for k in KINDS]), ",").alias("base"),
        F.array_join(F.concat(*[_listed(k) for k in (*KINDS, "term")]), ",").alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, text): every span of ``found`` replaced by its kind in brackets; removed terms by nothing."""
    label = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
        s["action"] == "removed", F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    spans = found.dropDuplicates(["key"]).select("key", F.sort_array(F.concat(*[label(k) for k in KINDS], terms)).alias("s"))
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(spans, "key", "left")
    gap = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    done = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], gap(a["at"], s["start"]), s["put"])).otherwise(a["out"]).alias("out")))
    whole = F.concat(done["out"], gap(done["at"], F.length("text")))
    return joined.select("key", "id", F.when(F.col("s").isNull(), F.col("text")).otherwise(whole).alias("text"))
