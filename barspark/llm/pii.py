"""Surrogates for personal data, in DataFrame functions only.

Detected entities get replacements of their own type and format. A replacement is made from a keyed
hash of (type, normal form, attempt), so all mentions of an entity in the corpus, however
written, get the same one. A table of all distinct entities is checked for collisions: of entities
that would share a replacement, all but the first, and those whose replacement is a real entity of the corpus,
take the next attempt, until all replacements differ. Within a document a surname alone takes
the surname of the first whole name that it ends. A name without a title is not found, also where
the same name stands elsewhere with one.

=======  ==================================  ==========================================================
type     normal form                         replacement
=======  ==================================  ==========================================================
email    lower case                          letters by letters of the same script and case, digits by digits;
                                             marks stay; the top-level domain stays
phone    digits, country code of a + number  same layout; the country code of a number with + stays
card     digits                              same layout; the check digit stays valid where it was
ssn      digits                              same layout
ipv4     the address                         an address with octets of 1-254
iban     letters and digits without blanks   same layout; the country stays
person   words after the title, lower case   first name of the title's gender in the same script; surname
                                             with as many words, longer by a syllable an attempt; title stays
=======  ==================================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barspark.llm.frames import stored

#: Titles by gender, and the names that replacements are made of.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Sra", "Srta", "Госпожа"]
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Sr", "Господин"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
FEMALE = ["Alice", "Amelia", "Beatrice", "Clara", "Diana", "Eleanor", "Emma", "Fiona", "Grace", "Hannah", "Irene", "Julia", "Laura", "Martha", "Nora", "Olivia", "Paula", "Rosa", "Sophie", "Vera"]
MALE = ["Adam", "Albert", "Bruno", "Carl", "David", "Edward", "Felix", "George", "Henry", "Isaac", "Jacob", "Leon", "Martin", "Nathan", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"]
OTHER = ["Alex", "Ariel", "Casey", "Dana", "Jamie", "Jordan", "Kim", "Morgan", "Robin", "Sasha"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"]
MALE_CYRILLIC = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"]
STEMS = ["Ald", "Bark", "Cald", "Dorn", "Ell", "Farn", "Gild", "Hart", "Ing", "Kell", "Lang", "Mar", "Nor", "Oak", "Pem", "Quin", "Rad", "Stan", "Thorn", "Wex"]
ENDINGS = ["bury", "dale", "den", "field", "ford", "gate", "ham", "hurst", "land", "ley", "man", "mere", "ridge", "ser", "son", "ton", "well", "wick", "wood", "worth"]
STEMS_CYRILLIC = ["Бел", "Вол", "Гор", "Дуб", "Зим", "Кар", "Лаз", "Мор", "Нов", "Сав"]
ENDINGS_CYRILLIC = ["ин", "ов", "ский", "ец", "енко", "ев"]

_TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: A pattern for each type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
#: The calling codes of countries and networks; none begins another.
_CALLING_CODE = (r"1|7|2(?:[07]|1[123568]|[2346][0-9]|5[0-8]|9[01789])|3(?:[0-469]|5[0-9]|7[0-8]|8[0-35-79])|4(?:[013-9]|2[013])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])"
                 r"|8(?:[1246]|0[08]|5[02356]|7[08]|8[0-368])|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68])")
#: A code stays only in front of this many digits, which are drawn.
_LEAST_DRAWN = 4
#: Any text that holds an entity matches this cheap pattern too.
_HINT = rf"[0-9][0-9.]|@|(?:{_TITLES})\.? "
MAX_ATTEMPTS = 64

ENTITY = "(?:" + "|".join(PATTERNS.values()) + ")"


def _kind(mention: Column) -> Column:
    """The type of a mention: the first whose pattern it matches whole."""
    out = None
    for k, p in PATTERNS.items():
        whole = mention.rlike(f"^(?:{p})$")
        out = F.when(whole, k) if out is None else out.when(whole, k)
    return out


def normal_form(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    # the code is found in the digits, so it does not depend on where the number has separators
    code = F.regexp_extract(digits, rf"^({_CALLING_CODE})[0-9]{{{_LEAST_DRAWN},}}$", 1)
    person = F.lower(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", ""))
    return (F.when(kind.isin("ssn", "card"), digits).when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.concat(F.lit("+"), code)).otherwise(""), F.lit("/"), digits))
            .when(kind == "iban", F.regexp_replace(mention, r" ", "")).when(kind == "person", F.concat(F.when(person.contains(" "), gender(mention)).otherwise("x"), F.lit(":"), person)).otherwise(F.lower(mention)))


def gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, rf"^({_TITLES})", 1)
    return F.when(title.isin(FEMALE_TITLES), "f").when(title.isin(MALE_TITLES), "m").otherwise("x")


def _draw(seed: Column, place, n) -> Column:
    """A number below n for a place of a keyed hash (sha-256 in hex; 8 digits for each draw)."""
    deep = F.sha2(F.concat_ws("/", seed, F.lit(place) if isinstance(place, int) else place.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(deep, 1, 12), 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def _pick(names: list[str], seed: Column, place) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (_draw(seed, place, len(names)) + 1).cast("int"))


_LATIN, _GREEK, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщэюя"


def _shape_preserving(value: Column, seed: Column, fixed: Column) -> Column:
    """Letters become letters of the same script, digits digits; the first ``fixed`` characters and marks stay."""
    def one(c, i):
        letter = lambda alphabet: F.substr(F.lit(alphabet), (_draw(seed, i, len(alphabet)) + 1).cast("int"), F.lit(1))
        new = (F.when(c.rlike("^[0-9]$"), _draw(seed, i, 10).cast("string")).when(c.rlike(r"^\p{IsGreek}$"), letter(_GREEK)).when(c.rlike(r"^\p{IsCyrillic}$"), letter(_CYRILLIC))
               .when(c.rlike(r"^\p{L}$"), letter(_LATIN)).otherwise(c))
        return F.when(i < fixed, c).when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string whose last digit is the check digit."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The replacement of a normal form, itself in normal form (persons: with capitals)."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")).cast("binary"), 256)
    top = F.length(F.regexp_extract(normal, r"\.\p{L}+$", 0))
    email = F.concat(_shape_preserving(F.substr(normal, F.lit(1), F.length(normal) - top), seed, F.lit(0)), F.regexp_extract(normal, r"\.\p{L}+$", 0))
    code = F.length(F.regexp_extract(normal, r"^(\+?[0-9]*)/", 1))
    digits = F.regexp_extract(normal, r"([0-9]*)$", 1)
    phone = _shape_preserving(digits, seed, F.greatest(code - 1, F.lit(0)))
    raw = _shape_preserving(normal, seed, F.lit(0))
    head = F.substr(raw, F.lit(1), F.length(raw) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(normal), F.lit(10)) == 0, F.concat(head, check)).otherwise(raw)
    ip = F.concat_ws(".", *[(_draw(seed, k, 254) + 1).cast("string") for k in range(4)])
    words = F.size(F.split(normal, " "))
    cyrillic = normal.rlike(r"\p{IsCyrillic}")
    sex = F.substring(normal, 1, 1)
    first = (F.when(cyrillic & (sex == "f"), _pick(FEMALE_CYRILLIC, seed, 1)).when(cyrillic, _pick(MALE_CYRILLIC, seed, 1)).when(sex == "f", _pick(FEMALE, seed, 1))
             .when(sex == "m", _pick(MALE, seed, 1)).otherwise(_pick(OTHER, seed, 1)))
    # each attempt adds a syllable, so names cannot run out
    more = lambda stems: F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda k: F.lower(_pick(stems, seed, k + 100))), "")).otherwise("")
    named = lambda stems, endings: F.concat(_pick(stems, seed, 2), F.lower(_pick(stems, seed, 3)), more(stems), _pick(endings, seed, 4))
    family = F.when(cyrillic, named(STEMS_CYRILLIC, ENDINGS_CYRILLIC)).otherwise(named(STEMS, ENDINGS))
    middle = F.when(cyrillic, _pick(STEMS_CYRILLIC, seed, 5)).otherwise(_pick(STEMS, seed, 5))
    person = F.when(words == 1, family).when(words == 2, F.concat_ws(" ", first, family)).otherwise(F.concat_ws(" ", first, middle, family))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ipv4", ip).when(kind == "person", person).when(kind == "iban", _shape_preserving(normal, seed, F.lit(2))).otherwise(raw)


def rendered(kind: Column, mention: Column, new: Column) -> Column:
    """The replacement in the layout of a mention: letters and digits go to the places of letters and digits."""
    spread = F.aggregate(F.split(mention, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), lambda a, c: F.when(
        c.rlike("^[A-Z0-9]$"), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substr(new, a["at"], F.lit(1))).alias("out"))).otherwise(
        F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out"))), lambda a: a["out"])
    title = F.regexp_extract(mention, rf"^((?:{_TITLES})\.? )", 1)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind == "person", F.concat(title, new)).otherwise(new)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, normal, new`` for distinct (kind, normal) rows, all ``new`` of a kind different from each other
    and from every entity of the kind. Each round is one aggregation over the entities and a written table."""
    # entities in the form of replacements: phones as digits, persons without gender
    plain = F.when(F.col("kind") == "phone", F.regexp_extract("normal", r"([0-9]*)$", 1)).when(F.col("kind") == "person", F.regexp_replace("normal", "^[fmx]:", "")).otherwise(F.col("normal"))
    real = entities.select("kind", plain.alias("plain"))
    todo = entities.withColumn("attempt", F.lit(0))
    done = None
    for _ in range(MAX_ATTEMPTS):
        tried = stored(todo.withColumn("new", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)), "surrogates")
        form = F.when(F.col("kind") == "person", F.lower("new")).otherwise(F.col("new")).alias("plain")
        taken = real if done is None else real.unionByName(done.select("kind", form))
        first = tried.groupBy("kind", "new").agg(F.min("normal").alias("normal")).select("*", form).join(taken, ["kind", "plain"], "left_anti")
        won = stored(first.select("kind", "normal", "new"), "chosen")
        done = won if done is None else done.unionByName(won)
        todo = tried.join(won, ["kind", "normal"], "left_anti").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        if not todo.limit(1).count():
            return done
    raise RuntimeError("replacements of some type are used up")


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in its text replaced, and the number of mentions replaced; with
    ``kinds_col`` also the array of their types in order.

    Null texts stay null and empty ones empty (0 mentions). Texts without entities pass unchanged and
    unshuffled. Rows are matched to their replacements by the text itself, so repeated rows and rows without an
    id are treated alike.
    """
    text = F.col(text_col)
    may = F.coalesce(text.rlike(_HINT) & text.rlike(ENTITY), F.lit(False))
    hit = docs.where(may)
    # group of a text: two hashes and the length stand for it
    name = [F.xxhash64(text).alias("__op_a"), F.hash(text, F.length(text)).alias("__op_b")]
    found = hit.select(*name, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("m")).dropDuplicates(["__op_a", "__op_b"])
    mention = found.select("__op_a", "__op_b", F.posexplode("m").alias("i", "mention")).withColumn("kind", _kind(F.col("mention")))
    mention = stored(mention.withColumn("normal", normal_form(F.col("kind"), F.col("mention"))), "mentions")
    new = distinct_surrogates(mention.select("kind", "normal").distinct(), key)
    put = mention.join(new, ["kind", "normal"]).select("__op_a", "__op_b", "i", "kind", rendered(F.col("kind"), F.col("mention"), F.col("new")).alias("new"),
        F.when(F.col("kind") == "person", F.regexp_extract("normal", r"([^ :]+)$", 1)).alias("surname"), F.col("normal").contains(" ").alias("whole"),
        F.regexp_extract("new", r"[^ ]+$", 0).alias("family"), F.regexp_extract("mention", rf"^((?:{_TITLES})\.? )", 1).alias("title"))
    lists = put.groupBy("__op_a", "__op_b").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "new", "surname", "whole", "family", "title"))).alias("all"))

    def agreed(n):
        of = F.get(F.filter("all", lambda w: w["whole"] & (w["surname"] == n["surname"])), F.lit(0))
        return F.struct(n["kind"].alias("kind"), F.when(n["surname"].isNotNull() & ~n["whole"], F.coalesce(F.concat(n["title"], of["family"]), n["new"])).otherwise(n["new"]).alias("new"))

    lists = lists.select("__op_a", "__op_b", F.transform("all", agreed).alias("__op_new"))
    gaps = F.split(text, ENTITY, -1)
    fresh = F.array_join(F.flatten(F.zip_with(gaps, F.col("__op_new"), lambda g, n: F.array(g, F.coalesce(n["new"], F.lit(""))))), "")
    columns = lambda t, n, k: [t.alias(c) if c == text_col else F.col(c) for c in docs.columns] + [n.cast("long").alias(count_col)] + ([k.alias(kinds_col)] if kinds_col else [])
    replaced = hit.withColumns({"__op_a": name[0], "__op_b": name[1]}).join(lists, ["__op_a", "__op_b"]).select(
        *columns(fresh, F.size("__op_new"), F.transform("__op_new", lambda n: n["kind"])))
    rest = docs.where(~may).select(*columns(text, F.lit(0), F.array().cast("array<string>")))
    return replaced.unionByName(rest)


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, n_entities`` and the number of mentions of each type, and the new ``text``, of every row."""
    out = with_surrogates(docs.select("doc_id", "text"), key, kinds_col="kinds")
    return out.select("doc_id", "n_entities", *[F.size(F.filter("kinds", lambda k: k == x)).cast("long").alias(f"n_{x}") for x in PATTERNS], "text")
