"""Grounding of whole records in their source text, and record rules.

Which parts of a record are quotes, texts or periods follows from its type;
nothing is listed by hand.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import repair_quote, stripped
from strandline.operators.shred import TOP_LISTS, parse_record
from strandline.schema import EXTRACTION, leaves, rebuilt, record_type
from strandline.taxonomy import ACTION_STATUS, ACTION_TYPES, CLAIM_STATUS, GEOGRAPHY_ROLES, INVOLVEMENTS, MATTER_KINDS, MENTION_TYPES, QUALIFIERS, RELATIONSHIP_KINDS, RELEVANCES, RISK_TYPES, family_of

RULES = (
    "mention_ids_unique", "matter_ids_unique", "relationship_ids_unique", "risk_ids_unique", "action_ids_unique", "primary_mention", "mention_references", "matter_references",
    "mention_types", "relevance", "involvement", "matter_kinds", "relationship_kinds", "risk_types", "action_types", "claim_status", "action_status", "geography_roles", "qualifiers",
    "id_patterns", "terms", "currencies", "label_length", "texts_present", "evidence_present", "involvement_present", "subjects_present", "targets_present", "dates", "period_order", "amounts", "amount_sign",
)
PREVIEW = 120


def check_quotes(df: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """``df`` with ``repaired`` (the source's spelling where it is unique) and ``grounded`` (contained in the source as is)."""
    return df.withColumn("repaired", repair_quote(F.col(quote), F.col(source))).withColumn("grounded", F.contains(source, "repaired"))


def unwrapped(text: Column) -> Column:
    """The JSON of a record without whatever it is wrapped in (a JSON string, a fence, an outer object); null where there is none to read."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if (r := parse_record(t)) is None else json.dumps(r, ensure_ascii=False), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def read_record(text: Column) -> Column:
    """A typed record, however it is wrapped, texts without outer white space, and periods without evidence quoting their own text."""
    kind = record_type()

    def at(value: Column, part: T.DataType, name: str) -> Column | None:
        if isinstance(part, T.StringType):
            return stripped(value)
        if name == "period" and isinstance(part, T.StructType):
            quote = F.coalesce(value["evidence"]["quote"], value["text"])
            return F.when(value.isNotNull(), F.struct(*[stripped(value[f]).alias(f) for f in ("text", "start", "end")], F.struct(stripped(quote).alias("quote")).alias("evidence")))
        return None

    return rebuilt(F.from_json(unwrapped(text), EXTRACTION), kind, at)


def unknown_fields(text: Column) -> Column:
    """Dotted names of a record's fields that its type does not have, sorted, each once."""
    kind = record_type()

    def walk(value: object, part: T.DataType, name: str, found: set[str]) -> None:
        if isinstance(part, T.ArrayType) and isinstance(value, list):
            for x in value:
                walk(x, part.elementType, name, found)
        elif isinstance(part, T.StructType) and isinstance(value, dict):
            for k, v in value.items():
                path = f"{name}.{k}" if name else k
                if k in part.fieldNames():
                    walk(v, part[k].dataType, path, found)
                else:
                    found.add(path)

    def names(text: str) -> list[str]:
        found: set[str] = set()
        walk(parse_record(text), kind, "", found)
        return sorted(found)

    def run(values: pd.Series) -> pd.Series:
        return values.map(names, na_action="ignore")

    return F.pandas_udf(run, "array<string>")(text)


def quotes(record: Column) -> Column:
    """All quotes of a typed record, wherever they are."""
    return leaves(record, record_type(), lambda part, name: name == "quote")


def ground(record: Column, source: Column) -> Column:
    """A record with its quotes in the source's spelling where that is unique, and without periods whose quote the source does not have; what held them stays."""

    def at(value: Column, part: T.DataType, name: str) -> Column | None:
        if name == "quote":
            return repair_quote(value, source)
        if name == "period" and isinstance(part, T.StructType):
            quote = repair_quote(value["evidence"]["quote"], source)
            whole = F.struct(value["text"].alias("text"), value["start"].alias("start"), value["end"].alias("end"), F.struct(quote.alias("quote")).alias("evidence"))
            return F.when(F.contains(source, quote), whole)
        return None

    return rebuilt(record, record_type(), at)


def first_missing_quote(record: Column, source: Column) -> Column:
    """The lexicographically first quote not contained in the source, cut at 120 characters; null if all are."""
    return F.substring(F.array_min(F.filter(quotes(record), lambda x: ~F.contains(source, x))), 1, PREVIEW)


def violations(record: Column) -> Column:
    """Names of the rules a typed record breaks. A missing list counts as empty; a record that can't be read breaks none."""
    r = {n: F.coalesce(record[n], F.array()) for n in TOP_LISTS}
    ids = {n: F.transform(r[n], lambda x: x["id"]) for n in r}
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    every = lambda n, test: F.forall(r[n], lambda x: F.coalesce(test(x), F.lit(False)))
    unique = lambda n: F.size(ids[n]) == F.size(F.array_distinct(ids[n]))
    of = lambda n, *fields: F.flatten(F.transform(r[n], lambda x: F.concat(*[strings(x[f]) for f in fields])))
    among = lambda n, field, allowed: every(n, lambda x: x[field].isin(*allowed))
    inner = lambda field, *lists: F.concat(*[F.flatten(F.transform(r[n], lambda x: F.coalesce(x[field], F.array()))) for n in lists])
    pattern = lambda n, word: F.forall(ids[n], lambda x: F.coalesce(x.rlike(rf"^{word}_[1-9][0-9]*$"), F.lit(False)))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    readable = lambda text, kind: text.isNull() | text.try_cast(kind).isNotNull()
    term = lambda c: F.coalesce(c.rlike("^[a-z][a-z0-9_]*$"), F.lit(False))

    named = F.concat(of("matters", "authority_ids", "subject_ids"), of("risks", "authority_ids", "subject_ids", "affected_ids"), of("actions", "actor_ids", "target_ids", "affected_ids"), F.transform(r["relationships"], lambda x: x["subject_id"]), F.transform(r["relationships"], lambda x: x["object_id"]))
    cases = F.array_compact(F.concat(F.transform(r["risks"], lambda x: x["matter_id"]), F.transform(r["actions"], lambda x: x["matter_id"])))
    places = inner("geographies", "mentions", "risks", "actions")
    attributes = inner("attributes", "mentions", "relationships", "risks", "actions")
    sourced = F.concat(inner("case_numbers", "matters"), inner("legal_provisions", "matters"))
    periods = F.array_compact(F.concat(*[F.transform(r[n], lambda x: x["period"]) for n in ("relationships", "risks", "actions")]))
    amounts = F.array_compact(F.transform(r["actions"], lambda x: x["amount"]))
    number = lambda x: x["amount"].try_cast("decimal(38,6)")
    days = lambda x: (x["start"].try_cast("date"), x["end"].try_cast("date"))
    evidence = [F.forall(r[n], lambda x: filled(x["evidence"]["quote"])) for n in TOP_LISTS]
    evidence += [F.forall(x, lambda y: filled(y["evidence"]["quote"])) for x in (places, attributes, sourced, periods, amounts)]
    texts = [every(n, lambda x: filled(x["description"])) for n in ("mentions", "matters", "risks", "actions")]
    texts += [every("mentions", lambda x: filled(x["name"])), *[F.forall(x, lambda y: filled(y["value"])) for x in (attributes, sourced)]]
    texts += [F.forall(places, lambda x: filled(x["name"])), *[F.forall(x, lambda y: filled(y["text"])) for x in (periods, amounts)]]
    every_of = lambda tests: F.forall(F.array(*tests), lambda x: x)
    held = {
        **{f"{n[:-1]}_ids_unique": unique(n) for n in TOP_LISTS},
        "primary_mention": F.exists(r["mentions"], lambda x: F.coalesce(x["relevance"] == "primary", F.lit(False))),
        "mention_references": F.size(F.array_except(named, ids["mentions"])) == 0,
        "matter_references": F.size(F.array_except(cases, ids["matters"])) == 0,
        "mention_types": among("mentions", "type", MENTION_TYPES),
        "relevance": among("mentions", "relevance", RELEVANCES),
        "involvement": F.size(F.array_except(of("mentions", "involvement"), F.array(*map(F.lit, INVOLVEMENTS)))) == 0,
        "matter_kinds": among("matters", "kind", MATTER_KINDS),
        "relationship_kinds": among("relationships", "kind", RELATIONSHIP_KINDS),
        "risk_types": among("risks", "type", family_of(RISK_TYPES)),
        "action_types": among("actions", "type", family_of(ACTION_TYPES)),
        "claim_status": among("risks", "status", CLAIM_STATUS) & every("relationships", lambda x: F.coalesce(x["status"], F.lit("reported")).isin(*CLAIM_STATUS)),
        "action_status": among("actions", "status", ACTION_STATUS),
        "geography_roles": F.forall(places, lambda x: F.coalesce(x["role"].isin(*GEOGRAPHY_ROLES), F.lit(False))),
        "qualifiers": F.forall(amounts, lambda x: x["qualifier"].isNull() | x["qualifier"].isin(*QUALIFIERS)),
        "id_patterns": every_of([pattern(n, n[:-1]) for n in TOP_LISTS]),
        "terms": F.forall(attributes, lambda x: term(x["name"])) & every("relationships", lambda x: term(x["predicate"])),
        "currencies": F.forall(amounts, lambda x: x["currency"].isNull() | x["currency"].rlike("^[A-Z]{3}$")),
        "label_length": every_of([every(n, lambda x: F.length(x["label"]).between(1, 120)) for n in ("risks", "actions")]),
        "texts_present": every_of(texts),
        "evidence_present": every_of(evidence),
        "involvement_present": every("mentions", lambda x: F.size(x["involvement"]) > 0),
        "subjects_present": every("risks", lambda x: F.size(x["subject_ids"]) > 0),
        "targets_present": every("actions", lambda x: F.size(x["target_ids"]) > 0),
        "dates": F.forall(periods, lambda x: readable(x["start"], "date") & readable(x["end"], "date")),
        "period_order": F.forall(periods, lambda x: F.coalesce(days(x)[0] <= days(x)[1], F.lit(True))),
        "amounts": F.forall(amounts, lambda x: readable(x["amount"], "decimal(38,6)")),
        "amount_sign": F.forall(amounts, lambda x: F.coalesce(number(x) >= 0, F.lit(True))),
    }
    assert tuple(held) == RULES or set(held) == set(RULES)
    return F.array_compact(F.array(*[F.when(record.isNotNull() & ~held[name], F.lit(name)) for name in RULES]))
