"""Personal data, and terms that give it away. DataFrame functions only.

Four kinds of personal data are found by pattern. Further terms are judged by information content:
an entity e that occurs in a part p(e) of all documents has -log2 p(e) bits, and a term t tells
PMI(t; e) = log2(p(t, e) / (p(t) p(e))) of them, where p(t, e) counts the documents that have t near
e and p(t) all documents that have t anywhere. A term that tells more than a given part of an
entity's bits is generalised in the documents where it stands near it. p(e | t) is taken at its lower
confidence bound, so a term that was seen seldom needs an entity with many bits. The same holds for
what several entities share, such as the domain of their addresses: there rare ones are judged
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartsight.llm.common import stored

# Each pattern finds the leftmost longest matches, as plainer ones would, but starts only where a
# run of its characters starts (or where the last match ended), so that long runs cost no more
# than their length. None has a repeated group that the regex engine would recurse on.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)"
    r"(?:\.[A-Za-z0-9-]++)*+"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A separator between two digits is replaced by this mark first, so that a card is one plain run.
_MARK, _OTHER = "\ufdd0", "\ufdd1"
CARD = f"[0-9][0-9{_MARK}]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone")
#: Words beside an entity, within so many characters, are its context.
REACH = 60
#: A term is generalised if it tells this part of an entity's bits, by the lower bound at so many
#: standard deviations (one-sided, 95 in 100).
DISCLOSES, SURE = 0.9, 1.645
TERM = r"[\p{L}]{3,40}"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_TERM_BUCKETS = 1 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _found(text: Column, pattern: str | Column, kind: str, rank: int) -> Column:
    """All matches with their places, from the texts between them and their own lengths."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")
    )
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {_SPAN})").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
            F.lit(kind).alias("kind"), x["hit"].alias("value"),
        )
        return F.when(x["hit"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))
        )

    return F.aggregate(both, empty, add, lambda s: s["spans"])


def _none() -> Column:
    return F.expr(f"CAST(array() AS {_SPAN})")


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans in ``text``, which must not be NULL.

    A quick test that every match must pass keeps texts without any from the exact search.
    """
    joined = F.regexp_replace(
        F.translate(text, _MARK, _OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", _MARK
    )

    def if_any(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(_none())

    ip = _found(text, IP, "ip", 1)
    card = _found(joined, CARD, "card", 2)
    phone = _found(text, PHONE, "phone", 3)
    return {
        "email": if_any(text.contains("@"), _found(text, EMAIL, "email", 0)),
        "ip": if_any(
            text.rlike(r"[0-9]\.[0-9]"),
            F.filter(ip, lambda s: s["value"].rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")),
        ),
        "card": if_any(
            text.rlike(r"[0-9][0-9\x20-]{12,}+"),
            F.filter(
                card,
                lambda s: F.length(_digits(s["value"])).between(14, 19) & _luhn(_digits(s["value"])),
            ),
        ),
        "phone": if_any(
            text.rlike(r"\+[0-9]"),
            F.filter(phone, lambda s: F.length(_digits(s["value"])).between(10, 15)),
        ),
    }


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base (the spans by start and kind) for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(c.alias(f"s_{k}") for k, c in base_spans(text).items()),
    )
    return spans.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.concat(*(F.col(f"s_{k}") for k in KINDS))).alias("base"),
    )


def _keys(kind: Column, value: Column) -> Column:
    """What a term may disclose: the entity itself, and the part that several entities share.

    That is the domain of an email, the first three numbers of an IP, the first six digits of a
    card, and all but the last four digits of a phone number.
    """
    shared = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(_digits(value), 1, 6))
        .otherwise(F.regexp_replace(_digits(value), "[0-9]{4}$", ""))
    )
    return F.array(F.concat(F.lit("="), value), F.concat(kind, F.lit(":"), shared))


def _low(k: Column, n: Column, sure: float) -> Column:
    """Wilson's lower bound of a probability that was seen ``k`` times in ``n``."""
    p, z2 = k / n, sure * sure
    return (p + z2 / (2 * n) - sure * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def disclosing_terms(docs: DataFrame, discloses: float = DISCLOSES, sure: float = SURE) -> DataFrame:
    """(entity, term) where the term tells at least ``discloses`` of the information content of the
    entity (one of its :func:`_keys`), with p(e | t) at its lower bound.

    Copies of a text are one piece of evidence: documents are counted by the hash of their text.
    The terms of the whole corpus are counted, but a test on 2**20 hash values, broadcast as at
    most that many numbers, first drops those that cannot disclose any entity they are near.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    all_spans = F.concat(*base_spans(text).values())
    near = (
        docs.select(F.xxhash64(text).alias("t"), text.alias("text"), all_spans.alias("spans"))
        .where(F.size("spans") > 0)
        .select("t", "text", F.explode("spans").alias("s"))
    )
    left = F.expr(f"substring(text, greatest(s.start - {REACH}, 0) + 1, least(s.start, {REACH}))")
    right = F.expr(f"substring(text, s.end + 1, {REACH})")
    # a word that the context cuts off is none
    left = F.when(F.col("s.start") > REACH, F.regexp_replace(left, r"^[\p{L}]+", "")).otherwise(left)
    right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"[\p{L}]+$", "")).otherwise(right)
    context = F.lower(F.concat_ws(" ", left, right))
    seen = stored(
        near.select(
            _keys(F.col("s.kind"), F.col("s.value")).alias("keys"),
            "t",
            F.explode(F.array_distinct(F.regexp_extract_all(context, F.lit(TERM), F.lit(0)))).alias("term"),
        )
        .select(F.explode("keys").alias("entity"), "t", "term")
        .distinct(),
        "near",
    )
    entities = seen.select("entity", "t").distinct().groupBy("entity").agg(F.count("t").alias("n_e"))
    together = seen.groupBy("entity", "term").agg(F.count("t").alias("together"))
    pairs = stored(together.join(entities, "entity"), "pairs")
    n = docs.select(F.xxhash64(text).alias("t")).agg(F.approx_count_distinct("t", 0.01)).first()[0]

    def tells(k: Column, n_e: Column, n_t: Column) -> Column:
        all_texts = F.greatest(F.lit(float(n)), n_e, n_t)
        bits = F.log2(all_texts / n_e)
        return (bits > 0) & (F.log2(_low(k, n_t, sure) * all_texts / n_e) >= discloses * bits)

    # a term is in no fewer texts than those where it is near an entity, and tells no entity more
    # than its best count would tell of the rarest one: most common words drop out
    near_any = seen.select("term", "t").distinct().groupBy("term").agg(F.count("t").alias("n_t"))
    best = pairs.groupBy("term").agg(F.max("together").alias("k"), F.min("n_e").alias("n_e"))
    able = best.join(near_any, "term").where(tells(F.col("k"), F.col("n_e"), F.col("n_t")))
    bucket = F.pmod(F.xxhash64("term"), F.lit(_TERM_BUCKETS)).cast("int").alias("bucket")
    wanted = stored(able.select(bucket).distinct(), "wanted")
    words = docs.select(
        F.xxhash64(text).alias("t"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"),
    )
    some = words.select("t", "term", bucket).join(F.broadcast(wanted), "bucket", "left_semi")
    terms = some.select("term", "t").distinct().groupBy("term").agg(F.count("t").alias("n_t"))
    judged = pairs.withColumn("bucket", bucket).join(F.broadcast(wanted), "bucket", "left_semi")
    return (
        judged.join(terms, "term")
        .where(tells(F.col("together"), F.col("n_e"), F.col("n_t")))
        .select("entity", "term")
    )


def _pattern(terms: Column) -> Column:
    """Any of ``terms`` (letters only) as whole words, in any case."""
    return F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])")
    )


def terms_by_text(docs: DataFrame, discloses: float = DISCLOSES, sure: float = SURE) -> DataFrame:
    """(t, terms): for texts with an entity, by hash, the terms that disclose one of its entities."""
    terms = stored(disclosing_terms(docs, discloses, sure), "disclosing")
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(F.xxhash64(text).alias("t"), F.explode(F.concat(*base_spans(text).values())).alias("s"))
    entities = spans.select("t", F.explode(_keys(F.col("s.kind"), F.col("s.value"))).alias("entity")).distinct()
    return entities.join(terms, "entity").groupBy("t").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def sanitised(
    docs: DataFrame, discloses: float = DISCLOSES, sure: float = SURE, null_ids: bool = False
) -> DataFrame:
    """``row`` (all columns of ``docs``), n_<kind>, base_sha256, spans and the clean ``text``.

    Base spans are code points, end exclusive, leftmost and non-overlapping by kind. Spans of kind
    ``term`` follow from :func:`disclosing_terms`. In the clean text every span, overlapping ones
    as one, is its kind in brackets: [EMAIL], [IP], [CARD], [PHONE], [TERM].

    A NULL text is empty, has no spans and stays NULL. Rows that repeat a text are treated alike.
    Rows with a NULL id get base spans only, unless ``null_ids`` treats them like any other. Other
    columns, whatever their names, are carried along in ``row``. Texts are read whole.
    """
    rows = docs.select(F.struct("*").alias("row"))
    terms = stored(terms_by_text(docs.select("text"), discloses, sure), "terms")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    base = find_in_rows(rows.select("row", text.alias("text")))
    joined = base.join(terms, F.xxhash64("text") == F.col("t"), "left")
    some = F.col("terms").isNotNull() & (F.lit(null_ids) | F.col("row.doc_id").isNotNull())
    extra = F.when(some, _found(F.col("text"), _pattern(F.col("terms")), "term", 4)).otherwise(_none())
    full = joined.withColumn("all", F.array_sort(F.concat("base", extra)))
    return full.select(
        "row",
        *(f"n_{k}" for k in KINDS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.when(F.col("row.text").isNotNull(), _masked(F.col("text"), F.col("all"))).alias("text"),
    )


def find_in_rows(rows: DataFrame) -> DataFrame:
    """:func:`find` beside the columns ``row`` and ``text`` (not NULL) of ``rows``."""
    spans = rows.select(
        "row", "text", *(c.alias(f"s_{k}") for k, c in base_spans(F.col("text")).items())
    )
    return spans.select(
        "row",
        "text",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.concat(*(F.col(f"s_{k}") for k in KINDS))).alias("base"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, by start, replaced by its kind."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        longer = F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], piece, mark))
            .otherwise(state["out"]).alias("out"),
        )
        return longer

    whole = F.aggregate(
        spans, empty, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_sha256 and spans of :func:`sanitised`."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return sanitised(slim, null_ids=True).select(
        F.col("row.doc_id").alias("doc_id"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans"
    )
