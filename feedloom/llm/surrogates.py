"""Surrogates for personal data: keyed, alike in type and format, distinct and coreferent.

1. One pattern finds the entities of every whole text: mail addresses, IP addresses, card,
   account, tax and phone numbers, and names after a title. A name's title stays; given names
   and the surname are entities of their own, so "Mrs Ann Lee" and "Mrs Lee" stay the same Lee.
2. The distinct (type, value) pairs of the whole corpus get a surrogate from a keyed hash:
   letters for letters, digits for digits, vowels and consonants in turn for names, with an
   ending by gender, in the script of the value. Card numbers keep a valid check digit.
   Values are compared without case, spaces and punctuation, so all ways of writing a number
   get the same digits.
3. A surrogate that another value has too, or that is itself a value in the corpus, is refused:
   of its values the least keeps it, the rest try again with the next hash, until none is left.
4. The surrogates are joined back and written into the texts in each entity's own format.

Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import let, staged

#: Rounds after which the values of a type must have found distinct surrogates, and rounds after
#: which a mailbox gets one more letter, so that small domains cannot run out of names.
MAX_ROUNDS, ROUNDS_A_LETTER = 60, 3

# Titles by gender, letters by script, and the patterns of the entities.
MALE = "Mr|Sir|Herr|Herrn|Monsieur|M|Señor|Sr|Don|Господин|господин|Г-н|г-н"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Госпожа|госпожа|Г-жа|г-жа"
# Repeated groups are possessive: Java follows others by recursion, and a long match ends the JVM.
NAME_WORD = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)*+"
NAME = rf"\b(?:{MALE}|{FEMALE})\b\.?\x20{NAME_WORD}(?:\x20{NAME_WORD}){{0,2}}"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IPV4 = r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![A-Za-z0-9+])(?:\d{13,19}|\d{4}([\x20-])\d{4}\1\d{4}\1\d{4}|\d{4}([\x20-])\d{6}\2\d{5})(?![A-Za-z0-9])"
TAX = r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])"
PHONE = (
    r"(?<![A-Za-z0-9])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\x20.-]?\d{2,4}){2,4}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}"
    r"|\d{3}[\x20.-]\d{3}[\x20.-]\d{4})(?![A-Za-z0-9])"
)
#: In the order in which they are tried at a place.
TYPES = {"name": NAME, "email": EMAIL, "ip": IPV4, "account": ACCOUNT, "card": CARD, "tax": TAX, "phone": PHONE}
# Back references count through the whole pattern.
ANY = "|".join(TYPES.values())
LOWER = "abcdefghijklmnopqrstuvwxyz"
LATIN = ("aeiou", "bdfgklmnprstvz")
CYRILLIC = ("аеиоу", "бвгдзклмнпрст")
#: What every text with an entity has.
HINT = rf"[@0-9]|\b(?:{MALE}|{FEMALE})\b"


def kind(raw: Column) -> Column:
    """The type of a match: the first whose pattern is the whole of it."""
    out = None
    for name, pattern in TYPES.items():
        here = raw.rlike(f"^(?:{pattern})$")
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def parts(raw: Column, type_: Column) -> Column:
    """Array of (type, value, raw) of a match; a title, and the spaces, have no value."""
    def part(t: Column | str, value: Column | None, own: Column) -> Column:
        t = F.lit(t) if isinstance(t, str) else t
        value = F.lit(None).cast("string") if value is None else value
        return F.struct(t.cast("string").alias("type"), value.alias("value"), own.alias("raw"))

    def named(tokens: Column) -> Column:
        gender = F.when(tokens[0].rlike(rf"^(?:{FEMALE})\.?$"), "f").otherwise("m")
        role = lambda i: F.when(i == F.size(tokens) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender))
        return F.transform(tokens, lambda x, i: F.when(i == 0, part("title", None, x)).otherwise(
            part(role(i), F.lower(x), F.concat(F.lit(" "), x))
        ))

    number = F.upper(F.regexp_replace(raw, r"[^A-Za-z0-9]", ""))
    value = F.when(type_ == "email", F.lower(raw)).when(type_ == "ip", raw).otherwise(number)
    return F.when(type_ == "name", let(F.split(raw, " "), named)).otherwise(F.array(part(type_, value, raw)))


def entities(text: Column) -> Column:
    """Array of all parts of all matches, each with its match's place ``at``."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    listed = F.transform(matches, lambda m, at: let(kind(m), lambda t: F.transform(
        parts(m, t), lambda p: F.struct(at.alias("at"), p["type"].alias("type"), p["value"].alias("value"), p["raw"].alias("raw"))
    )))
    return F.flatten(listed)


def _draws(key: str, attempt: Column) -> Column:
    """The keyed hash in hexadecimal, twice, so that draws may run over its end."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), F.col("type"), F.col("value"), attempt.cast("string")), 512)
    return F.repeat(digest, 2)


def _draw(draws: Column, i: Column, among: Column | int) -> Column:
    """The ``i``-th number drawn, below ``among``; the hash begins again after 64 draws."""
    two = F.conv(F.substr(draws, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
    return F.pmod(two, F.lit(among) if isinstance(among, int) else among)


def candidate(key: str, attempt: Column) -> Column:
    """The surrogate of (type, value) in a round, in the form that values have."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    draws = _draws(key, attempt)

    def pick(letters: str, i: Column, d: Column) -> Column:
        return F.substr(F.lit(letters), _draw(d, i, len(letters)) + 1, F.lit(1))

    def alike(c: Column, i: Column, d: Column) -> Column:
        return F.when(c.rlike("[0-9]"), pick("0123456789", i, d)).when(c.rlike("[a-z]"), pick(LOWER, i, d)).when(
            c.rlike("[A-Z]"), pick(LOWER.upper(), i, d)).otherwise(c)

    def spelled(d: Column) -> Column:
        size = F.greatest(F.size(chars), F.lit(6))

        # ``let`` tells the script once, not for each letter.
        def letters(cyrillic: Column) -> Column:
            turn = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i % 2 == 0, F.when(
                cyrillic, pick(CYRILLIC[1], i, d)).otherwise(pick(LATIN[1], i, d))
            ).otherwise(F.when(cyrillic, pick(CYRILLIC[0], i, d)).otherwise(pick(LATIN[0], i, d))))
            ending = F.when(F.col("type") == "given_f", F.when(cyrillic, "на").otherwise("na")).when(
                F.col("type") == "given_m", F.when(cyrillic, "с").otherwise("s")).otherwise("")
            return F.concat(F.array_join(turn, ""), ending)

        return let(F.col("value").rlike(r"\p{IsCyrillic}"), letters)

    def same_form(d: Column) -> Column:
        return F.array_join(F.transform(chars, lambda c, i: alike(c, i, d)), "")

    def mail(d: Column) -> Column:
        # The domain's own hash, so that addresses of one domain stay together; its last label stays.
        domain = F.repeat(F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("domain"), F.substring_index("value", "@", -1)), 512), 2)
        fixed = F.length("value") - F.length(F.substring_index("value", ".", -1)) - 1
        known = F.struct(F.instr("value", "@").alias("at"), fixed.alias("fixed"), domain.alias("domain"))
        longer = F.transform(F.sequence(F.lit(1), F.floor(attempt / ROUNDS_A_LETTER).cast("int")), lambda i: pick(LOWER, i + 31, d))
        longer = F.when(attempt >= ROUNDS_A_LETTER, F.array_join(longer, "")).otherwise("")
        same = let(known, lambda k: F.array_join(F.transform(chars, lambda c, i: F.when(i >= k["fixed"], c).when(
            i < k["at"], alike(c, i, d)).otherwise(alike(c, i - k["at"], k["domain"]))), ""))
        return F.concat(longer, same)

    def address(d: Column) -> Column:
        return F.array_join(F.transform(F.split("value", r"\."), lambda _, i: (_draw(d, i * 3, 254) + 1).cast("string")), ".")

    def card(d: Column) -> Column:
        own = F.substr(same_form(d), F.lit(1), F.length("value") - 1)
        body = F.concat(F.substr(F.col("value"), F.lit(1), F.lit(1)), F.substr(own, F.lit(2)))
        free = F.concat(body, F.substr(same_form(d), F.length("value"), F.lit(1)))
        return F.when(luhn(F.col("value")) % 10 == 0, F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(free)

    def phone(d: Column) -> Column:
        # The first digit, mostly the country code, stays.
        return F.concat(F.substr(F.col("value"), F.lit(1), F.lit(1)), F.substr(same_form(d), F.lit(2)))

    def account(d: Column) -> Column:
        return F.concat(F.substr(F.col("value"), F.lit(1), F.lit(2)), F.substr(same_form(d), F.lit(3)))

    forms = {"email": mail, "ip": address, "card": card, "phone": phone, "account": account, "tax": same_form}
    out = None
    for name, form in forms.items():
        value = let(draws, form)
        out = F.when(F.col("type") == name, value) if out is None else out.when(F.col("type") == name, value)
    return out.otherwise(let(draws, spelled))


def luhn(digits: Column) -> Column:
    """The check sum of a card number: a valid one's is a multiple of ten."""
    size = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: let(
        F.substr(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1),
        lambda x: F.when(x > 9, x - 9).otherwise(x),
    ))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def assign(values: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of the distinct ``values`` (type, value)."""
    values = staged(values, "values")
    done, open_ = None, values
    for attempt in range(MAX_ROUNDS):
        tried = open_.withColumn("surrogate", candidate(key, F.lit(attempt)))
        taken = values.select("type", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("type", "surrogate"))
        free = tried.join(taken.distinct(), ["type", "surrogate"], "left_anti")
        winners = free.groupBy("type", "surrogate").agg(F.min("value").alias("value"))
        round_ = staged(winners.select("type", "value", "surrogate"), "surrogates")
        done = round_ if done is None else done.union(round_)
        open_ = staged(open_.join(round_, ["type", "value"], "left_anti"), "values")
        if open_.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates after {MAX_ROUNDS} rounds")


def written(raw: Column, type_: Column, surrogate: Column) -> Column:
    """The surrogate in the format of ``raw``: its case, spaces and punctuation."""
    def filled(fill: Column) -> Column:
        chars = F.filter(F.split(raw, ""), lambda c: c != "")
        nth = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(fill, nth(i), F.lit(1))).otherwise(c)), "")

    name = F.when(F.upper(raw) == raw, F.concat(F.lit(" "), F.upper(surrogate))).otherwise(F.concat(F.lit(" "), F.initcap(surrogate)))
    cased = F.when((F.upper(raw) == raw) & raw.rlike("[A-Z]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(surrogate.isNull(), raw).when(type_.isin("surname", "given_f", "given_m"), name).when(
        type_ == "email", cased).when(type_ == "ip", surrogate).otherwise(filled(surrogate))


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities`` and ``entity_types`` (sorted, distinct).

    A null text stays null, an empty one empty, both with 0 entities. Each row is rewritten by
    its own text; rows with equal or null ids, and repeated rows, keep their place. Other
    columns are kept; those named like the new ones give way.
    """
    new = ["n_entities", "entity_types"]
    kept = [c for c in docs.columns if c not in new]
    found = docs.filter(F.col("text").rlike(HINT)).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.posexplode(entities(F.col("text"))).alias("_pos", "_e")
    )
    # Equal rows have equal entities: one of each place is enough.
    found = staged(found.select("_id", "_hash", "_pos", "_e.*").dropDuplicates(["_id", "_hash", "_pos"]), "entities")
    valued = found.filter("value is not null").select("type", "value").distinct()
    joined = found.join(assign(valued, key), ["type", "value"], "left")
    joined = joined.withColumn("new", written(F.col("raw"), F.col("type"), F.col("surrogate")))
    of_doc = joined.groupBy("_id", "_hash").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "at", "new", "type"))).alias("_new"), F.count("value").alias("_n")
    )
    held = docs.select(F.struct(*kept).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_own_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    rows = held.join(of_doc, same, "left")
    # A match's parts follow each other; piece, match, piece, ...
    pieces = F.split("text", ANY, -1)
    first = lambda xs, i: (i == 0) | (F.get(xs, F.greatest(i - 1, F.lit(0)))["at"] != xs[i]["at"])
    body = let(F.col("_new"), lambda xs: let(pieces, lambda ps: F.concat(
        F.array_join(F.transform(xs, lambda x, i: F.concat(F.when(first(xs, i), F.get(ps, x["at"])).otherwise(""), x["new"])), ""),
        F.element_at(ps, -1),
    )))
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(body)
    types = F.array_sort(F.array_distinct(F.filter(F.transform("_new", lambda x: x["type"]), lambda t: t != "title")))
    return rows.select(
        *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept],
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_join(types, ","), F.lit("")).alias("entity_types"),
    )
