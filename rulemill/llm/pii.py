"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and shape: digits stay digits, letters keep case and
script, cards keep a valid check digit, names keep their gender. Equal entities get equal surrogates everywhere, different
ones different surrogates: candidates that collide, with each other or with an entity of the corpus, are drawn again.
Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.columns import column, let
from rulemill.llm.common import written

#: Drawings after which surrogates grow: a format or a pool of names may hold fewer values than the corpus has entities.
PATIENCE = 6

# Titles by gender, and surrogate names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа"),
    "u": ("Dr", "Prof"),
}
NAMES = {
    ("given_m", "latin"): "James Robert Thomas Daniel Peter Martin Paul Simon Oscar Victor Hugo Bruno Felix Conrad Edgar Leon",
    ("given_f", "latin"): "Mary Anna Laura Julia Clara Helen Emma Alice Nina Irene Rosa Paula Vera Edith Marta Sylvia",
    ("given_u", "latin"): "Robin Kim Alex Sasha Jamie Taylor Morgan Casey Quinn Riley Rowan Avery Jordan Emery Skyler Noa",
    ("family", "latin"): "Bennett Carver Dalton Ellison Foster Granger Holland Iverson Keller Larkin Mercer Norwood Osborne Preston Quimby Radford Sutton Thorne Underhill Vance Weller Yardley Ashby Brandt",
    ("given_m", "cyrillic"): "Иван Пётр Сергей Андрей Борис Виктор Георгий Михаил",
    ("given_f", "cyrillic"): "Анна Мария Елена Ольга Вера Ирина Нина Татьяна",
    ("given_u", "cyrillic"): "Саша Женя Валя Шура",
    ("family", "cyrillic"): "Коваль Мельник Шевчук Бондарь Ткач Кравец Гончар Кузьмич",
}

_EMAIL = r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_CARD = r"(?<![\d.+])\d(?:[ -]?\d){12,18}(?!\d)"
# Cards as they are written, which may stand beside other numbers, and any other grouping between clear edges, by length.
_GROUPED = [rf"\d{{4}}{sep}(?:\d{{4}}{sep}\d{{4}}{sep}\d{{4}}|\d{{6}}{sep}\d{{4,5}})" for sep in (" ", "-")]
_CARD_FORMS = [rf"(?<![\d.+])(?<!(?<!\d)-)(?=((?:{'|'.join([r'\d{13,19}', *_GROUPED])})(?!\d|-(?!\d))))\d+"]
_CARD_FORMS += [rf"(?<![\d.+-])(?=(\d(?:[ -]?\d){{{n - 1}}}(?![\d-])))\d+" for n in range(19, 12, -1)]
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
_SECRET = r"(?<=\b(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key) {0,2}[=:] {0,2}[\"'])(?=[^\"'\s]*[\p{L}\p{N}])[^\"'\s]{6,256}(?=[\"'])"
_TITLE = "|".join(t for names in TITLES.values() for t in names)
_INITIAL = r"\p{Lu}\."
_NAME = r"\p{Lu}[\p{L}'-]{1,40}"
_PERSON = rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? (?:(?:{_INITIAL}|{_NAME}) ){{0,4}}{_NAME}"

#: In order of preference at the same place. Any number that looks like a card counts; `_entities` has those with a check digit.
ENTITY = "|".join(f"(?:{p})" for p in (_EMAIL, _IP, _SSN, _CARD, _PHONE, _SECRET, _PERSON))
#: What every entity contains; most texts end here.
HINT = rf"[0-9@]|[=:] {{0,2}}[\"']|(?:{_TITLE})\.? \p{{Lu}}"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def passes_luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _cards(text: Column) -> Column:
    """The cards of a text that pass their check digit, as alternatives of a pattern; empty if there are none.

    Every group of digits may begin one, so a number that only looks like a card hides none beside or within it.
    """
    forms = [F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda c: passes_luhn(F.regexp_replace(c, "[^0-9]", ""))) for p in _CARD_FORMS]
    return F.when(text.rlike(_CARD), F.array_join(F.array_distinct(F.concat(*forms)), "|")).otherwise("")


def _entities(cards: Column) -> Column:
    """The pattern of all entities of a text with these cards."""
    before, after = ("|".join(f"(?:{p})" for p in some) for some in ((_EMAIL, _IP, _SSN), (_PHONE, _SECRET, _PERSON)))
    valid = F.when(cards != "", F.concat(F.lit(r"(?:(?<![\d.+])(?:"), cards, F.lit(r")(?!\d))|"))).otherwise("")
    return F.concat(F.lit(before + "|"), valid, F.lit(after))


def entity_type(match: Column) -> Column:
    """The type of a text that ENTITY matched; NULL for a number that only looks like a card."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(match.rlike(_whole(_EMAIL)), "email").when(match.rlike(_whole(_IP)), "ip").when(match.rlike(_whole(_SSN)), "ssn")
        .when(match.rlike(_whole(_PHONE)), "phone").when(match.rlike(_whole(_CARD)), F.when(passes_luhn(digits), "card"))
        .when(match.rlike(_whole(_PERSON)), "person").otherwise("secret")
    )


_PART = "struct<type:string,value:string>"


def _person_words(match: Column) -> Column:
    """array<struct<type, value>>: the words after the title. The last one is the family name, initials are no names."""
    words = F.split(match, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    gender = F.when(title.isin(*TITLES["m"]), "given_m").when(title.isin(*TITLES["f"]), "given_f").otherwise("given_u")
    kind = lambda word, i: F.when(word.rlike(_whole(_INITIAL)), "initial").when(i == F.size(words) - 2, "family").otherwise(gender)
    return F.transform(F.slice(words, 2, 100), lambda word, i: F.struct(kind(word, i).alias("type"), word.alias("value")))


def _parts(match: Column) -> Column:
    """array<struct<type, value>>: what has to get a surrogate in a match. Names are parts of their own, so a family name stays the same with or without a given name."""
    person = F.filter(_person_words(match), lambda p: p["type"] != "initial")
    kind = entity_type(match)
    value = F.when(kind == "email", F.lower(match)).otherwise(match)
    single = F.array(F.struct(kind.alias("type"), value.alias("value")))
    return F.when(kind.isNull(), F.array().cast(f"array<{_PART}>")).when(kind == "person", person).otherwise(single)


def _draw(key: str, kind: Column, value: Column, attempt: Column, place: Column) -> Column:
    """A keyed number for a place of an entity. SHA-256 over key, type, value, attempt and place."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), place.cast("string")), 256), 1, 12), 16, 10).cast("long")


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _scrambled(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The value with other letters and digits of the same kind in the same places."""

    def other(c: Column, i: Column) -> Column:
        n = _draw(key, kind, value, attempt, i)
        among = lambda first, count: _letter(F.lit(ord(first)) + n % count)
        cyrillic, greek = (c.rlike(rf"\p{{Is{script}}}") & c.rlike(r"\p{L}") for script in ("Cyrillic", "Greek"))
        hexadecimal = value.rlike("^[0-9a-f]+$") & value.rlike("[0-9]")
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(hexadecimal & c.rlike("[a-f]"), among("a", 6))
            .when(c.rlike("[a-z]"), among("a", 26)).when(c.rlike("[A-Z]"), among("A", 26))
            .when(cyrillic & c.rlike(r"\p{Lu}"), among("А", 32)).when(cyrillic, among("а", 32))
            .when(greek & c.rlike(r"\p{Lu}"), among("Α", 17)).when(greek, among("α", 17))
            .when(c.rlike("[一-龥]"), among("一", 20000)).when(c.rlike("[가-힣]"), among("가", 11172))
            .when(c.rlike("[ぁ-ゖ]"), among("ぁ", 86)).when(c.rlike("[ァ-ヺ]"), among("ァ", 90))
            .when(c.rlike("[ا-غ]"), among("ا", 20)).when(c.rlike("[ف-ي]"), among("ف", 10)).when(c.rlike("[א-ת]"), among("א", 27))
            .when(c.rlike(r"\p{Lu}"), among("A", 26)).when(c.rlike(r"\p{L}"), among("a", 26)).when(c.rlike(r"\p{N}"), (n % 10).cast("string")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _named(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """A name of the same gender and script, after collisions one of two, three and more parts. A script without names of its own keeps its
    letters."""
    latin, cyrillic = value.rlike(r"\p{IsLatin}"), value.rlike(r"\p{IsCyrillic}")

    def pick(place: int) -> Column:
        n = _draw(key, kind, value, F.lit(attempt), F.lit(place))
        out = F.when(~latin & ~cyrillic, _scrambled(key, kind, value, F.lit(attempt + 1000 * place)))
        for (group, script), names in NAMES.items():
            choice = F.get(F.array(*map(F.lit, names.split())), (n % len(names.split())).cast("int"))
            out = out.when((kind == group) & (cyrillic if script == "cyrillic" else latin & ~cyrillic), choice)
        return out

    return F.concat_ws("-", *[pick(place) for place in range(1 + attempt // 2)])


def _candidate(key: str, kind: Column, value: Column, round_: int) -> Column:
    attempt = F.lit(round_)
    plain = _scrambled(key, kind, value, attempt)
    end = F.regexp_extract(value, r"\.[a-z]+$", 0)
    email = F.concat(F.substring_index(plain, "@", 1), F.lit("@"), F.regexp_replace(F.substring_index(plain, "@", -1), r"\.[^.]*$", ""), end)
    octets = F.transform(F.split(value, r"\."), lambda c, i: (_draw(key, kind, value, attempt, i) % 254 + 1).cast("string"))
    # a card keeps its first digit, which names the network, and gets the check digit that fits
    body = F.concat(F.substring(value, 1, 1), F.substring(plain, 2, 1000))
    digits = F.regexp_replace(body, "[^0-9]", "")
    checked = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: passes_luhn(F.concat(F.regexp_replace(digits, r"\d$", ""), d))))
    card = F.concat(F.regexp_replace(body, r"\d$", ""), checked)
    # a phone keeps its country code
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    phone = let(country, lambda c: F.concat(c, F.substr(plain, F.length(c) + 1)))
    name = kind.isin("given_m", "given_f", "given_u", "family")
    # where a format has been drawn in vain, a drawn number makes it longer
    more = [_draw(key, kind, value, attempt, F.lit(-1 - i)).cast("string") for i in range(max(0, round_ - PATIENCE))]
    longer = lambda c, sep: F.concat_ws(sep, c, *more) if more else c
    mail = F.concat(longer(F.substring_index(email, "@", 1), "-"), F.lit("@"), F.substring_index(email, "@", -1))
    shaped = F.when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card).when(kind == "phone", phone).otherwise(plain)
    return F.when(name, _named(key, kind, value, round_)).when(kind == "email", mail).otherwise(longer(shaped, "-"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (type, value) -> the same with `surrogate`, unique within a type and equal to no value of that type.

    Of the entities that draw the same candidate the one with the smallest value keeps it; the others draw again. Later rounds
    carry only those, and their candidates grow, so that every entity gets one, however many there are.
    """
    entities = written(entities.filter("value IS NOT NULL").distinct(), "pii-entities")
    left, done = entities, []
    for attempt in count():
        drawn = left.withColumn("surrogate", _candidate(key, F.col("type"), F.col("value"), attempt))
        drawn = written(drawn, "pii-drawn")
        best = drawn.groupBy("type", "surrogate").agg(F.min("value").alias("value"))
        best = best.join(entities.select("type", F.col("value").alias("surrogate")), ["type", "surrogate"], "left_anti")
        for earlier in done:
            best = best.join(earlier.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        best = written(best.select("type", "value", "surrogate"), "pii-surrogates")
        done.append(best)
        left = drawn.select("type", "value").join(best, ["type", "value"], "left_anti")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = written(left, "pii-left")


def anonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The rows with surrogates in place of entities in `text_column`, all other columns as they are.

    Rows without an entity pass in one narrow scan. The others are written with their entities once; these are made distinct
    before they are shuffled, and so are the (row, entity) pairs. A NULL or empty text stays as it is; repeated rows are
    rows of their own, with the same surrogates; an empty table stays empty.
    """
    text = column(text_column)
    hinted = F.coalesce(text, F.lit("")).rlike(HINT) & F.coalesce(text, F.lit("")).rlike(ENTITY)
    found = docs.filter(hinted).select(F.struct("*").alias("row"), _cards(text).alias("cards"), F.monotonically_increasing_id().alias("id"))
    found = written(found, "pii-cards").select("row", "cards", "id", F.regexp_extract_all(F.col("row")[text_column], _entities(F.col("cards")), F.lit(0)).alias("found"))
    found = written(found.withColumn("parts", F.transform("found", _parts)), "pii-found")
    pairs = found.select("id", F.explode(F.array_distinct(F.flatten("parts"))).alias("part")).select("id", "part.type", "part.value")
    named = surrogates(pairs.select("type", "value"), key)
    by_row = pairs.join(named, ["type", "value"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("type", "value"), "surrogate"))).alias("names"))

    def word(part: Column) -> Column:
        initial = _scrambled(key, part["type"], part["value"], F.lit(0))
        return F.when(part["type"] == "initial", initial).otherwise(F.element_at("names", part))

    def replaced(match: Column, parts: Column) -> Column:
        person = F.get(parts, F.lit(0))["type"].isin("given_m", "given_f", "given_u", "family")
        names = F.concat_ws(" ", F.substring_index(match, " ", 1), F.transform(_person_words(match), word))
        return F.when(F.size(parts) == 0, match).when(~person, F.element_at("names", F.get(parts, F.lit(0)))).otherwise(names)

    gaps = F.split(F.col("row")[text_column], _entities(F.col("cards")), -1)
    new = F.zip_with("found", "parts", replaced)
    text_out = F.array_join(F.flatten(F.zip_with(gaps, new, lambda gap, value: F.array(gap, F.coalesce(value, F.lit(""))))), "")
    changed = found.join(by_row, "id", "left").select(F.when(F.col("names").isNull(), F.col("row")[text_column]).otherwise(text_out).alias("__text"), "row")
    changed = changed.select(*[F.col("__text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns])
    return docs.filter(~hinted).unionByName(changed)
