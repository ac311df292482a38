"""Masking of sensitive data (FN-52): e-mail, seals, identity cards, bank cards, phones, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import let

#: Option, token, pattern; bank numbers of zeros only stay.
STEPS = [("emails", "***EMAIL***", vocab.MASK_EMAIL), ("company_seals", "***SEAL***", vocab.MASK_SEAL), ("id_cards", "***ID_CARD***", vocab.MASK_ID_CARD), ("bank_accounts", "***BANK_ACCOUNT***", vocab.MASK_BANK.replace(r"\b\d{16", r"\b(?!0+\b)\d{16"))]


def _found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def phones(x: Column) -> Column:
    """Mobile numbers, then landlines in what is left (AGG-16); distinct, longest first."""
    rest = F.regexp_replace(x, vocab.MASK_MOBILE, "***PHONE***")
    every = F.array_distinct(F.concat(_found(x, vocab.MASK_MOBILE), _found(rest, vocab.MASK_LANDLINE)))
    return F.transform(F.array_sort(F.transform(every, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])


def mask_all(x: Column, options: dict[str, bool] | None = None) -> Column:
    """struct(masked, items array<struct<type, value>>); ``options`` switches kinds off."""
    on = {"emails": True, "company_seals": True, "id_cards": True, "bank_accounts": True, "phones": True} | (options or {})
    state = F.struct(F.coalesce(x, F.lit("")).alias("t"), F.array().cast("array<struct<type:string,value:string>>").alias("items"))
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    def step(state: Column, kind: str, token: str, pattern: str) -> Column:
        return let(state, lambda s: F.struct(F.regexp_replace(s["t"], pattern, token).alias("t"), F.concat(s["items"], tag(kind, _found(s["t"], pattern))).alias("items")))

    for kind, token, pattern in STEPS:
        if on[kind]:
            state = step(state, kind, token, pattern)
    if on["phones"]:
        state = let(state, lambda s: let(phones(s["t"]), lambda v: F.struct(F.aggregate(v, s["t"], lambda a, n: F.replace(a, n, F.lit("***PHONE***"))).alias("t"), F.concat(s["items"], tag("phones", v)).alias("items"))))
    return let(state, lambda s: F.struct(s["t"].alias("masked"), s["items"].alias("items")))
