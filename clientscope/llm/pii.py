"""PII surrogates: detected entities get keyed replacements of their own type, script, gender and format."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import pick, text_key, written

# Patterns, titles and given names.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
OTHER_TITLES = ("Dr", "Prof", "Doctor", "Professor")
PARTICLES = ("von", "van", "de", "der", "den", "la", "le", "du", "del", "di")
TITLE = rf"(?iu:{'|'.join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)})\.?"
TITLES = rf"{TITLE}(?: {TITLE})*"
NAME = r"(?:\p{Lu}\.|\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*)"
PERSON = rf"\b{TITLES} (?:(?:{'|'.join(PARTICLES)}) )*{NAME}(?: (?:(?:{'|'.join(PARTICLES)}) )*{NAME}){{0,3}}"
#: Country codes of telephone numbers: one or two digits where listed, else three.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")
SYLLABLES = {
    "latin": ("ba", "co", "di", "fer", "gal", "hen", "jo", "kel", "lin", "mar", "nor", "pel", "ros", "sten", "tur", "vol"),
    "cyrillic": ("ба", "во", "ги", "дер", "жан", "зин", "ка", "лев", "мар", "нов", "пет", "рос", "сен", "тур", "хол", "яр"),
}

#: What a coined given name ends in: female, male.
ENDINGS = {"latin": ("a", "us"), "cyrillic": ("а", "ий")}


@dataclass(frozen=True)
class Kind:
    """An entity type; ``core`` reduces a found text to what makes two mentions the same entity."""

    name: str
    pattern: str


KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    Kind("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    Kind(
        "ip6",
        r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
        r"|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    ),
    Kind("card", r"(?<![0-9-])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9-])"),
    Kind("checked", r"(?<![0-9-])(?:[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{13,19})(?![0-9-])"),
    Kind("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"),
    Kind("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("person", PERSON),
)
ALL = "|".join(k.pattern for k in KINDS)
DIGITS = r"[^0-9]"


def kind_of(found: Column) -> Column:
    """The kind of a mention; numbers of a card's length are one only if their check digit holds. Null: no entity, or a bare name."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        hit = found.rlike(f"^(?:{k.pattern})$")
        if k.name == "checked":
            digits = F.regexp_replace(found, DIGITS, "")
            out = F.when(hit, F.when(luhn(digits, digits) == digits, "card")).otherwise(out)
        else:
            out = F.when(hit, F.lit(k.name)).otherwise(out)
    return out


def core_of(kind: Column, found: Column) -> Column:
    """What makes mentions one entity: digits of numbers (of a telephone those behind the country code), the lower-case address."""
    digits = F.regexp_replace(found, DIGITS, "")
    return (
        F.when(kind.isin("email", "ip6"), F.lower(found)).when(kind == "ip", found)
        .when(kind == "phone", F.when(found.startswith("+"), F.regexp_replace(digits, COUNTRY, "")).otherwise(digits)).otherwise(digits)
    )


def country_of(kind: Column, found: Column) -> Column:
    abroad = (kind == "phone") & found.startswith("+")
    return F.when(abroad, F.regexp_extract(F.regexp_replace(found, DIGITS, ""), COUNTRY, 1)).otherwise("")


def bare_name(found: Column) -> Column:
    return F.regexp_replace(found, f"^{TITLES} ", "")


def gender_of(found: Column) -> Column:
    """1 behind a female title, -1 behind a male one, else 0."""
    female, male = (rf"^(?:{TITLE} )*(?iu:{'|'.join(t)})\.? " for t in (FEMALE_TITLES, MALE_TITLES))
    return F.when(found.rlike(female), 1).when(found.rlike(male), -1).otherwise(0)


def script_of(found: Column) -> Column:
    return F.when(found.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def digest(key: str, *parts: Column) -> Column:
    """Keyed digest in hexadecimal digits: the key goes in before and after, so that it cannot be extended."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)).cast("binary"), 256)


def number(hexadecimal: Column, at: int, digits: int = 8) -> Column:
    return F.conv(F.substring(hexadecimal, at, digits), 16, 10).cast("bigint")


def pick_from(values: Sequence[str], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


def coined(script: str, h: Column) -> Column:
    return F.concat(*[pick_from(SYLLABLES[script], number(h, 9 + 4 * i, 4)) for i in range(3)])


def moved_letter(key: str, letter: Column) -> Column:
    """A capital moved along its alphabet by a keyed number of places: other letters move to other places, initials agree with names."""
    for n, alphabet in enumerate(ALPHABETS):
        places = int(hashlib.sha256(f"{key}\x1f{n}".encode()).hexdigest(), 16) % (len(alphabet) - 1) + 1
        letter = F.translate(letter, alphabet, alphabet[places:] + alphabet[:places])
    return letter


def shuffled(key: str, value: Column, half: int) -> Column:
    """A keyed permutation of the numbers of 2 * half bits: four rounds over two halves."""
    low = (1 << half) - 1
    start = F.struct(F.shiftright(value, half).alias("a"), value.bitwiseAND(F.lit(low)).alias("b"))

    def turn(now: Column, i: Column) -> Column:
        mix = number(digest(key, i.cast("string"), now["b"].cast("string")), 1).bitwiseAND(F.lit(low))
        return F.struct(now["b"].alias("a"), now["a"].bitwiseXOR(mix).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda now: F.shiftleft(now["a"], half).bitwiseOR(now["b"]))


def private_address(key: str, core: Column) -> Column:
    """Another address of the same private range, by a permutation of the range; loopback stays; null for public addresses."""
    parts = F.transform(F.split(core, r"\."), lambda p: p.cast("bigint"))
    whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)

    def inside(bits: int) -> Column:
        top = F.shiftleft(F.shiftright(whole, bits), bits)
        new = top + shuffled(key, whole.bitwiseAND(F.lit((1 << bits) - 1)), bits // 2)
        return F.concat_ws(".", *[F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

    return (
        F.when(core.rlike(r"^10\."), inside(24)).when(core.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), inside(20))
        .when(core.rlike(r"^192\.168\."), inside(16)).when(core.rlike(r"^(127\.|0\.)"), core)
    )


def digit_stream(core: Column, h: Column) -> Column:
    """As many digits as the core has, from a chain of digests; the first one is not 0 unless the core's is."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(core) / 16)), lambda i: F.sha2(F.concat(h, i.cast("string")).cast("binary"), 256))
    digits = F.translate(F.array_join(blocks, ""), "abcdef", "012345")
    whole = F.substring(digits, F.lit(1), F.length(core))
    lead = F.when((F.substring(whole, 1, 1) == "0") & (F.substring(core, 1, 1) != "0"), F.lit("7")).otherwise(F.substring(whole, 1, 1))
    return F.concat(lead, F.substring(whole, F.lit(2), F.length(core)))


def luhn(core: Column, digits: Column) -> Column:
    """The digits with a last one that makes the Luhn sum right."""
    body = F.substring(digits, F.lit(1), F.length(core) - 1)
    each = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def surrogate_core(key: str, kind: Column, core: Column, gender: Column, script: Column, attempt: Column) -> Column:
    """The replacement's core for one attempt; from the eighth attempt on it carries digits of its digest."""
    h = digest(key, kind, core, attempt.cast("string"))
    late = attempt >= 8
    tag = F.when(late, F.substring(h, 33, 24)).otherwise(F.substring(h, 33, 4))
    email = F.concat(coined("latin", h), F.lit("."), coined("latin", digest(key, h)), tag, F.lit("@mail"), number(h, 41, 2).cast("string"), F.lit(".example.org"))
    # Addresses that are reserved and belong to nobody.
    ip = F.concat_ws(".", (number(h, 1, 4) % 15 + 240).cast("string"), *[(number(h, 5 + 4 * i, 4) % 254 + 1).cast("string") for i in range(3)])
    ip6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(h, 1 + 4 * i, 4) for i in range(6)])
    names = F.lit(None).cast("string")
    for s in SYLLABLES:
        ending = F.when((kind == "given") & (gender == "f"), ENDINGS[s][0]).when(kind == "given", ENDINGS[s][1]).otherwise("")
        name = F.concat(moved_letter(key, F.upper(F.substring(core, 1, 1))), coined(s, h), F.when(late, tag).otherwise(""), ending)
        names = F.when(script == s, F.lower(name)).otherwise(names)
    digits = digit_stream(core, h)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind.isin("given", "surname"), names)
        .when(kind == "card", luhn(core, digits)).otherwise(digits)
    )


def dressed(kind: Column, found: Column, core: Column) -> Column:
    """The replacement in the format of the mention: separators, upper case and title stay."""
    marks = F.split(found, "(?=[0-9])", -1)
    # Before the first digit stands the head; every later piece is a digit and what follows it.
    first = F.when(found.rlike("^[0-9]"), F.lit(0)).otherwise(F.lit(1))
    pieces = F.slice(marks, first + 1, F.size(marks) - first)
    head = F.when(first == 1, F.get(marks, F.lit(0))).otherwise("")
    refilled = F.concat(head, F.array_join(F.transform(pieces, lambda p, i: F.concat(F.substring(core, i + 1, F.lit(1)), F.substring(p, 2, 1 << 20))), ""))
    email = F.when(found == F.upper(found), F.upper(core)).otherwise(core)
    return F.when(kind == "email", email).when(kind.isin("ip", "ip6"), core).otherwise(refilled)


def dressed_name(found: Column, parts: Column) -> Column:
    """Title and new name parts; a part in capitals stays in capitals."""
    new = F.transform(parts, lambda p: F.when(p["kind"].isin("given", "surname"), F.when(
        (p["old"] == F.upper(p["old"])) & (F.length(p["old"]) > 1), F.upper(p["new"])).otherwise(F.initcap(p["new"]))).otherwise(p["new"]))
    return F.concat(F.regexp_extract(found, f"^{TITLES} ", 0), F.array_join(new, " "))


def known_names(text: Column) -> Column:
    """A pattern for the bare names of the people whom a text names with a title: whole, first and last, and last alone; null without any."""
    tokens = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0))), lambda p: F.split(bare_name(p), " "))

    def forms(t: Column) -> Column:
        last = F.element_at(t, -1)
        return F.when(F.length(last) > 2, F.array(F.array_join(t, " "), F.concat(t[0], F.lit(" "), last), last)).otherwise(F.array(F.array_join(t, " ")))

    every = F.array_distinct(F.flatten(F.transform(tokens, forms)))
    longest = F.transform(F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    quoted = F.transform(longest, lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])")))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, "|"))


def name_parts(found: Column) -> Column:
    """The words of a name as (kind, old, core): initials and particles, given names, and the surname, which comes last."""
    words = F.split(bare_name(found), " ")

    def part(w: Column, i: Column) -> Column:
        kind = F.when(w.rlike(r"^\p{Lu}\.$"), "initial").when(w.isin(*PARTICLES), "particle").when(i == F.size(words) - 1, "surname").otherwise("given")
        return F.struct(kind.alias("kind"), w.alias("old"), F.lower(w).alias("core"))

    return F.transform(words, part)


def mentions(rows: DataFrame) -> DataFrame:
    """Distinct mentions per document (doc_id, text_key, found, kind) with the parts that are entities of their own.

    ``rows`` has the pattern of each text: that of all kinds, and of the names that the text gives with a title.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))).alias("found")
    kinds = rows.select("doc_id", "text_key", found).withColumn("strict", kind_of(F.col("found")))
    # What fits no kind is a bare name, or a number whose check digit is wrong.
    kinds = kinds.withColumn("kind", F.coalesce("strict", F.when(F.col("found").rlike(r"^\p{L}"), "person"))).where(F.col("kind").isNotNull())
    whole = F.array(F.struct(F.col("kind").alias("kind"), F.col("found").alias("old"), core_of(F.col("kind"), F.col("found")).alias("core")))
    person = F.col("kind") == "person"
    return kinds.select(
        "doc_id", "text_key", "found", "kind", F.when(person, name_parts(F.col("found"))).otherwise(whole).alias("parts"),
        F.when(person, gender_of(F.col("found"))).otherwise(0).alias("title"),
    )


def given_directly(key: str, kind: Column, old: Column, core: Column) -> Column:
    """New text of parts that need no dictionary: initials, particles and addresses of private ranges; else null."""
    initial = F.concat(moved_letter(key, F.substring(old, 1, 1)), F.lit("."))
    return F.when(kind == "initial", initial).when(kind == "particle", old).when(kind == "ip", private_address(key, core))


ENTITY = ["kind", "core", "gender", "script"]


def assign(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """One surrogate per entity, (kind, core, gender, script, new_core), all of a kind distinct and none a real entity.

    An attempt that hits a real entity, a surrogate given earlier or the surrogate of another entity is drawn again;
    of several entities with one surrogate the least core keeps it. Each round is an aggregation and a join over the
    entities that are left, which soon are few.
    """
    real = entities.select("kind", F.col("core").alias("new_core")).distinct()
    pending, done = entities.select(*ENTITY), None
    for attempt in range(most_attempts):
        drawn = pending.withColumn(
            "new_core", surrogate_core(key, F.col("kind"), F.col("core"), F.col("gender"), F.col("script"), F.lit(attempt))
        )
        taken = real if done is None else real.union(done.select("kind", "new_core"))
        first = F.struct("core", "gender", "script")
        free = drawn.join(taken, ["kind", "new_core"], "left_anti")
        best = free.groupBy("kind", "new_core").agg(F.min(first).alias("one"))
        won = written(best.select("kind", "one.core", "one.gender", "one.script", "new_core"), "surrogates")
        done = won if done is None else done.union(won)
        pending = written(pending.join(won, ENTITY, "left_anti"), "entities-left")
        if pending.isEmpty():
            return done
    raise ValueError(f"no free surrogate after {most_attempts} attempts: a format has too few values")


def replace_entities(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, found (kind, first, end in code points of the old text) and the new text.

    Emails, IP addresses, card, telephone and social security numbers and names of people are replaced. A person is found
    by a title before up to four names; in the same text the whole name, first and last name, and the surname alone are
    then found without a title too. Given names and surnames have surrogates of their own, so mentions that name a person
    in part agree, and an initial is that of the surrogate. Surrogates are keyed functions of the entity, the same in all
    documents and runs of a key; numbers keep their separators, length, country code and check digit, names their titles,
    the gender most of their titles have, script and case. Private addresses stay in their range, by a permutation of it;
    others become addresses that are reserved. A dictionary of all other entities is checked so that two never share a
    surrogate and no surrogate is a real entity.

    Null texts stay null and have no mentions; null ids are allowed; rows that repeat an id keep their own texts; an empty
    table gives no rows; a very long text is one row's work like any other; other columns are ignored. A format whose
    values run out raises an error.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_key(F.col("text")))
    rows = rows.withColumn("pattern", F.concat_ws("|", F.lit(ALL), F.when(F.col("text").rlike(PERSON), known_names(F.col("text")))))
    seen = written(mentions(rows), "mentions")
    parts = seen.select("doc_id", "text_key", "found", "kind", "title", F.posexplode("parts").alias("at", "part"))
    parts = parts.select("doc_id", "text_key", "found", F.col("kind").alias("whole"), "title", "at", "part.*").withColumns({
        "script": F.when(F.col("kind").isin("given", "surname"), script_of(F.col("core"))).otherwise(""),
        "direct": given_directly(key, F.col("kind"), F.col("old"), F.col("core")),
    })
    entities = parts.where("direct is null").groupBy("kind", "core", "script").agg(F.sum("title").alias("titles"))
    gender = F.when(F.col("kind") == "given", F.when(F.col("titles") > 0, "f").otherwise("m")).otherwise("")
    table = assign(entities.select("kind", "core", gender.alias("gender"), "script"), key).select("kind", "core", "script", "new_core")
    named = parts.join(table, ["kind", "core", "script"], "left").withColumn("new", F.coalesce("direct", F.concat(country_of(F.col("kind"), F.col("old")), "new_core")))
    filled = named.groupBy("doc_id", "text_key", "found", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "old", "new"))).alias("parts"))
    one = F.col("parts")[0]
    new = F.when(F.col("whole") == "person", dressed_name(F.col("found"), F.col("parts"))).otherwise(dressed(F.col("whole"), F.col("found"), one["new"]))
    per_doc = filled.select("doc_id", "text_key", F.struct("found", F.col("whole").alias("kind"), new.alias("new")).alias("pair"))
    per_doc = per_doc.groupBy("doc_id", "text_key").agg(F.collect_list("pair").alias("pairs"))
    mapped = per_doc.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"),
        F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["found"], F.struct(p["kind"], p["new"])))).alias("by_text"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    joined = rows.join(mapped, same, "left")
    any_found = F.col("by_text").isNotNull()
    old = F.when(any_found, F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    gaps = F.when(any_found, F.split("text", F.col("pattern"), -1))
    new = F.transform("old", lambda m: F.coalesce(F.try_element_at("by_text", m)["new"], m))
    text = F.array_join(F.flatten(F.zip_with("gaps", new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    return joined.withColumn("old", old).withColumn("gaps", gaps).select(
        "doc_id", F.coalesce(places(), F.array().cast("array<struct<kind:string,first:int,end:int>>")).alias("found"),
        F.when(any_found, text).otherwise(F.col("text")).alias("text"),
    )


def places() -> Column:
    """(kind, first, end) of the mentions in ``old`` between the ``gaps``."""
    none = F.array().cast("array<struct<kind:string,first:int,end:int>>")

    def move(now: Column, step: Column) -> Column:
        first = now["at"] + F.length(step["gap"])
        end = first + F.coalesce(F.length(step["old"]), F.lit(0))
        kind = F.try_element_at("by_text", step["old"])["kind"]
        one = F.array(F.struct(kind.alias("kind"), first.alias("first"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kind.isNotNull(), F.concat(now["out"], one)).otherwise(now["out"]).alias("out"))

    steps = F.zip_with("gaps", "old", lambda g, m: F.struct(g.alias("gap"), m.alias("old")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), move, lambda now: now["out"])
