"""Personal data: patterns, and terms of the corpus that give a protected kind away.

How strongly a term reveals an entity, or a kind of personal data, is their pointwise mutual
information over all documents, set against what the entity or kind itself tells (its information
content): at a ratio of one the term is as good as the entity. A document that holds it has such terms
generalised too. A term counts when chance does not explain it over all terms tested; copies of one
document are one witness, because different texts (of an entity) or entities (of a kind) are counted.

All of it is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.spans import apart_from, listed, masked, no_spans, pattern_spans, tagged
from regatta.operators.common import cut_lineage

# Fixed values of the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# A term may keep this share of the information that a kind holds before it is generalised.
DISCLOSURE = 0.9
# Chance that any term at all is taken for a revealing one where terms and entities are independent.
CHANCE = 0.05
# Letters with their marks, digits, hyphens and apostrophes, three at least, and one of them a letter.
TERM_PATTERN = r"^(?=.*\p{L})(?=.{3})[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*$"
WHITE = r"[\x20\x09-\x0D]+"
MARKS = ".,;:!?\"'()[]{}|"

# Runs are entered at their first character only (or where the last match ended), so no text is
# scanned again and again. A dot that no label follows is another character while domains are sought.
_LOCAL = r"A-Za-z0-9._%+\x01-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_VALID_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def entity_spans(text: Column) -> dict[str, Column]:
    """Spans of every kind in one whole text."""
    dotted = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")
    email = F.when(text.contains("@"), pattern_spans(dotted, F.lit(_EMAIL))).otherwise(no_spans())
    ip = F.when(text.rlike(_IP), F.filter(
        pattern_spans(text, F.lit(_IP)), lambda s: s["value"].rlike(_VALID_IP)
    )).otherwise(no_spans())
    card = F.when(text.rlike(_CARD), F.filter(
        pattern_spans(text, F.lit(_CARD)), lambda s: F.call_function("luhn_check", _digits(s["value"]))
    )).otherwise(no_spans())
    phone = F.when(text.contains("+"), F.filter(
        pattern_spans(text, F.lit(_PHONE)),
        lambda s: F.length(_digits(s["value"])).between(8, 15),
    )).otherwise(no_spans())
    return dict(zip(KINDS, (email, ip, card, phone)))


def _with_entities(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_llm_text": text, "_llm_hash": F.xxhash64(text)})
    return rows.withColumns({f"_llm_{k}": c for k, c in entity_spans(F.col("_llm_text")).items()})


def _terms(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), WHITE), lambda w: F.btrim(w, F.lit(MARKS)))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(TERM_PATTERN)))


def _log_chance(hits: Column, n: Column, share: Column) -> Column:
    """Log of a bound (Chernoff) on the chance of ``hits`` or more among ``n`` at this share."""
    q = F.least(hits / n, F.lit(1.0))
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return F.when(q > share, -n * (q * F.log(q / share) + rest)).otherwise(0.0)


def _told(hits: Column, n: Column, share: Column) -> Column:
    """Share of the information content of what has this share that a term gives away."""
    return F.log(hits / n / share) / -F.log(share)


def _limit(tests: int, chance: float) -> float:
    """Log of the chance that one of so many tests may have (Bonferroni)."""
    return math.log(chance / max(1, tests))


def _entities(kind: str) -> Column:
    name = F.lit(kind)
    return F.transform(f"_llm_{kind}", lambda s: F.struct(
        name.alias("kind"), F.xxhash64(name, s["value"]).alias("entity")))


def term_counts(found: DataFrame) -> DataFrame:
    """``(term_hash, n, <kind>...)``: documents with each term, and those with a kind too, if any."""
    rows = found.select(F.explode(_terms(F.col("_llm_text"))).alias("term"),
                        *[(F.size(f"_llm_{k}") > 0).cast("int").alias(k) for k in KINDS])
    return rows.groupBy(F.xxhash64("term").alias("term_hash")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS]
    ).where(F.greatest(*KINDS) > 0)


def _kind_terms(
    held: DataFrame, counts: DataFrame, shares: dict[str, float], disclosure: float, limit: float
) -> DataFrame:
    """``(term_hash, kind)`` of terms that give a kind away, each different entity one witness."""
    seen = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_kind"), F.lit(p).alias("share"))
        for k, p in shares.items()
    ]) if shares else F.array().cast("array<struct<kind:string,n_kind:bigint,share:double>>")
    rated = counts.select("term_hash", "n", F.explode(seen).alias("k")).select("term_hash", "n", "k.*")
    suspects = cut_lineage(rated.where(
        (F.col("n_kind") > 0) & (_told(F.col("n_kind"), F.col("n"), F.col("share")) >= disclosure)
        & (_log_chance(F.col("n_kind"), F.col("n"), F.col("share")) <= limit)
    ))
    rows = held.select("terms", F.explode("entities").alias("e")).select(
        F.explode("terms").alias("term"), F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity"))
    return (
        rows.withColumn("term_hash", F.xxhash64("term")).join(suspects, ["term_hash", "kind"])
        .groupBy("term_hash", "kind").agg(
            F.countDistinct("entity").alias("w"), F.first("n").alias("n"), F.first("share").alias("share"))
        .where(_log_chance(F.col("w"), F.col("n"), F.col("share")) <= limit).select("term_hash", "kind")
    )


def _entity_terms(
    held: DataFrame, counts: DataFrame, everything: int, disclosure: float, chance: float
) -> DataFrame:
    """``(term_hash, entity)`` of terms that give one entity away, each different text one witness."""
    entities = held.select("text_hash", F.explode("entities.entity").alias("entity")).groupBy(
        "entity", "text_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_entity"))
    # One text proves nothing: its chance, one in all texts, is above the limit of so many tests.
    entities = cut_lineage(entities.where((F.col("texts") > 1) & (F.col("n_entity") < everything)))
    rows = held.select("text_hash", "terms", F.explode("entities.entity").alias("entity")).join(
        entities, "entity").select("text_hash", "entity", "n_entity", F.explode("terms").alias("term"))
    pairs = rows.groupBy(F.xxhash64("term").alias("term_hash"), "entity", "n_entity", "text_hash").agg(
        F.count(F.lit(1)).alias("n")).groupBy("term_hash", "entity", "n_entity").agg(
        F.count(F.lit(1)).alias("w"), F.sum("n").alias("n_both"))
    pairs = cut_lineage(pairs)
    share = F.col("n_entity") / float(everything)
    return pairs.where(F.col("w") > 1).join(counts.select("term_hash", "n"), "term_hash").where(
        (_told(F.col("n_both"), F.col("n"), share) >= disclosure)
        & (_log_chance(F.col("w"), F.col("n"), share) <= _limit(pairs.count(), chance))
    ).select("term_hash", "entity")


def revealing_terms(
    found: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE
) -> DataFrame:
    """``(doc_id, text_hash, terms)``: the terms to generalise in each document that has any."""
    counts = cut_lineage(term_counts(found))
    totals = found.agg(
        F.count(F.lit(1)).alias("all"), *[F.sum((F.size(f"_llm_{k}") > 0).cast("int")).alias(k) for k in KINDS]
    ).first()
    everything = totals["all"]
    shares = {k: totals[k] / everything for k in KINDS if 0 < (totals[k] or 0) < everything}
    entities = F.array_distinct(F.concat(*[_entities(k) for k in KINDS]))
    held = found.where(F.size(entities) > 0).select(
        "doc_id", F.col("_llm_hash").alias("text_hash"), _terms(F.col("_llm_text")).alias("terms"),
        entities.alias("entities"))
    of_kinds = _kind_terms(held, counts, shares, disclosure, _limit(counts.count() * len(KINDS), chance))
    of_entities = _entity_terms(held, counts, everything, disclosure, chance)
    keys = cut_lineage(of_kinds.select("term_hash", F.xxhash64("kind").alias("key")).unionByName(
        of_entities.select("term_hash", F.col("entity").alias("key"))))
    sides = F.array_distinct(F.concat(
        F.transform("entities", lambda e: F.xxhash64(e["kind"])), F.col("entities.entity")))
    rows = held.select("doc_id", "text_hash", F.explode("terms").alias("term"), sides.alias("sides"))
    known = keys.groupBy("term_hash").agg(F.count(F.lit(1)).alias("keys"))
    rows = rows.withColumn("term_hash", F.xxhash64("term")).join(known, "term_hash").drop("keys")
    return rows.withColumn("key", F.explode("sides")).join(keys, ["term_hash", "key"]).groupBy(
        "doc_id", "text_hash").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def find_personal_data(
    docs: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE
) -> DataFrame:
    """``docs`` with an array of spans ``_llm_<kind>`` for every kind and ``_llm_term``.

    A null text is an empty one without spans; null ids, repeated rows (each gets the same spans),
    ties and empty tables need nothing special. Other columns stay as they are.
    """
    found = _with_entities(docs)
    terms = cut_lineage(revealing_terms(found, disclosure, chance))
    terms = terms.withColumnsRenamed({"doc_id": "_llm_id", "text_hash": "_llm_of", "terms": "_llm_terms"})
    same = found["doc_id"].eqNullSafe(terms["_llm_id"]) & (found["_llm_hash"] == terms["_llm_of"])
    joined = found.join(terms, same, "left")
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{M}\p{N}])(?iu:"), F.array_join(F.reverse("_llm_terms"), "|"),
        F.lit(r")(?![\p{L}\p{M}\p{N}])"),
    )
    base = F.concat(*[F.col(f"_llm_{k}") for k in KINDS])
    own = F.when(F.col("_llm_terms").isNotNull(), apart_from(
        pattern_spans(F.col("_llm_text"), pattern), base
    )).otherwise(no_spans())
    return joined.withColumn("_llm_term", own).drop("_llm_id", "_llm_of", "_llm_terms")


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with personal data and revealing terms replaced by ``[KIND]``; a null text stays."""
    found = find_personal_data(docs)
    tags = F.concat(*[tagged(k, F.col(f"_llm_{k}")) for k in (*KINDS, TERM)])
    clean = F.when(docs["text"].isNotNull(), masked(F.col("_llm_text"), tags))
    done = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0)))
    return done.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = find_personal_data(docs)
    base = F.concat(*[listed(k, F.col(f"_llm_{k}")) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(f"_llm_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed(TERM, F.col(f"_llm_{TERM}"))), ",").alias("spans"),
        F.size(f"_llm_{TERM}").cast("long").alias("n_term"),
    )
