"""Phone numbers and contacts as Column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(c: Column) -> Column:
    return F.translate(F.trim(c), " -.()", "")


def e164(digits: Column) -> Column:
    """+digits if there are 8 to 15 and the first is not 0, else null."""
    return F.when(digits.rlike("^[1-9][0-9]{7,14}$"), F.concat(F.lit("+"), digits))


def normalize(c: Column, country: str | None = None) -> Column:
    """E.164 of an international (+, 00) number, or of a national one with a default country; null if that means guessing."""
    raw = cleaned(c)
    digits = F.regexp_replace(raw, r"^\+", "")
    code = "".join(ch for ch in country or "" if ch.isdigit())
    national = F.concat(F.lit(code), F.regexp_replace(digits, "^0", "")) if code else F.lit(None).cast("string")
    valid = digits.rlike("^[0-9]+$")
    return F.when(valid & raw.startswith("+"), e164(digits)).when(valid & digits.startswith("00"), e164(F.substr(digits, F.lit(3)))).when(valid, e164(national))


def bare_international(c: Column) -> Column:
    """Digits that already carry a country code, as messaging ids write them."""
    raw = cleaned(c)
    return F.when(~raw.startswith("00"), e164(raw))


def national_form(number: Column, country: str) -> Column:
    return F.when(number.startswith(f"+{country}"), F.substr(number, F.lit(len(country) + 2)))


def contact_keys(contacts: DataFrame) -> DataFrame:
    """(key, name) of the keys that exactly one contact claims; (contact_id, name, key) in. Ambiguous keys resolve to nothing."""
    return contacts.groupBy("key").agg(F.count_distinct("contact_id").alias("n"), F.min("name").alias("name")).filter("n = 1").select("key", "name")


def contact_name(first: Column, last: Column, organisation: Column) -> Column:
    full = F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit("")))), F.lit(""))
    return F.coalesce(full, F.nullif(F.trim(organisation), F.lit("")))


def resolved(rows: DataFrame, sender: str, keys: DataFrame, country: str | None = None) -> DataFrame:
    """rows with contact_name by the first form of the sender that a contact claims: normalised, verbatim, bare, lower case."""
    forms = F.array(normalize(F.col(sender), country), F.trim(sender), bare_international(F.col(sender)), F.lower(F.trim(sender)))
    tried = rows.select(sender).distinct().select(sender, F.posexplode(forms).alias("rank", "key")).filter("key IS NOT NULL")
    best = tried.join(keys, "key").groupBy(sender).agg(F.min_by("name", "rank").alias("contact_name"))
    return rows.join(best, sender, "left")


def speaker(name: Column, number: Column, country: str | None = None) -> Column:
    """Name | number | national form, whatever of it is known."""
    parts = [name, number] + ([national_form(number, country)] if country else [])
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("Unknown"))
