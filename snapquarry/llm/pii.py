"""Keyed surrogates for personal data, by DataFrame functions only.

Entities are found by patterns and replaced within their row; no text is shuffled.  A
replacement depends on the key and the entity's canonical form alone, so an entity reads
the same wherever it stands, in any format (coreference), and looks like the original: a
telephone number keeps its punctuation and country code, a card number its first digit and
the remainder of its check sum, an address its letter case and top-level domain, a key its
prefix and length, a name the gender and script of the first name and its letter case.

Numbers go through a keyed Feistel permutation of the numbers of the same length, so two
numbers never meet.  Listed first names are permuted by the key among those of their script and
gender.  Other first names, surnames, addresses and secrets are spelled from a keyed hash; over
all distinct entities of the corpus it is checked that no two share a whole replacement, and if
two do, all are spelled anew, and longer, under the next epoch of the key; secrets of up to 36
characters may then become longer than they were.  The driver learns how many met, nothing else.

A secret ends where its quotes close, or at white space; marks that end a sentence or a
bracket stay.  Telephone numbers are those with + or 00 and a country code, those with a
trunk 0 and groups, and North American ones in groups; the country code is that of the
prefix table, and 00, a trunk 0 and (0) do not count as digits of the number.  Plain runs of
digits without either are no telephone numbers.

Defined results: a null text stays null, an empty one empty; repeated rows give equal rows;
an empty table gives no rows; all columns of the input are kept; columns of the input named
like an added one are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# First names by script and gender, and titles by gender.
NAMES = {
    ("latin", "f"): ["Anna", "Maria", "Julia", "Laura", "Emma", "Sofia", "Clara", "Alice", "Elena", "Marta", "Nina", "Eva", "Mary", "Linda", "Susan", "Karen"],
    ("latin", "m"): ["Peter", "Thomas", "Martin", "Daniel", "David", "Lucas", "Paul", "Marco", "Simon", "Felix", "Hugo", "Oscar", "John", "James", "Robert", "Michael"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Ειρήνη", "Δήμητρα", "Βασιλική"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης", "Παύλος", "Ανδρέας", "Στέφανος"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]}
# Syllables of invented surnames; 16 for each script, one for each hexadecimal digit.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"],
    "greek": ["βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "θι", "ζο"],
}

#: Titles that may carry a full stop.
SHORT_TITLES = ("Mr", "Mrs", "Ms", "Mme")

_FIRST = "|".join(n for ns in NAMES.values() for n in ns)
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_CAPITAL = r"\p{Lu}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"(?i:password|passwd|secret|token|api[_-]?key)"
#: Of a secret: to the closing quote, else to white space.
_VALUE = r"""(?:"[^"\r\n]{8,}(?=")|'[^'\r\n]{8,}(?='(?!\p{L}))|["']?[^\s"'][^\s"]{6,}[^\s"'.,;)\]}])"""
#: Country codes, none of them the start of another.
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Between two digits of a telephone number.
_GAP = r"[ \u00a0./()\u2011-]{0,3}"
_MORE = rf"(?:{_GAP}[0-9])"
_TRUNK = r"(?:[ .-]?\(0\))?"
_NORTH = r"(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2}[ -][0-9]{4})"
_PHONE = "|".join(
    (
        # numbers of one length, so that what follows is not taken for a part
        rf"\+(?:1|7|30|44|52|90|91){_TRUNK}{_MORE}{{10}}(?![0-9])",
        rf"\+(?:31|33|34|41|48|61|351|420){_TRUNK}{_MORE}{{9}}(?![0-9])",
        rf"\+(?:45|47|65|852){_MORE}{{8}}(?![0-9])",
        rf"\+[0-9]{_MORE}{{6,14}}",
        # a gap must be there behind 00 and the country code
        rf"00[ .-]?(?=[1-9]){_COUNTRY}[ ./(-]{_MORE}{{6,12}}",
        rf"(?:1[ .-])?{_NORTH}(?!-[0-9]|\.[0-9])",
        # 9 to 12 digits behind a trunk 0 and in groups, no date
        r"\(?(?=0[1-9])(?!0[1-9][./-][0-9]{1,2}[./-][0-9]{4}(?![0-9]))(?=[0-9](?:[ ./()-]{0,2}[0-9]){8,11}(?![ ./-]?[0-9]))[0-9]{2,5}(?:\)?[ ./-]{1,2}[0-9]{2,8}|\)[0-9]{3,8})(?:[ ./-][0-9]{2,8}){0,4}",
    )
)
#: Kind, a class of characters it starts with, pattern; the first that matches at a place counts.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]", r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"[AaPpSsTt]", rf"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|{_LABEL}\s{{0,3}}[=:]\s{{0,3}}{_VALUE})"),
    ("ip", r"[0-9]", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"),
    ("ssn", r"[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"[+(0-9]", rf"(?<![0-9A-Za-z+]|[0-9][.-])(?:{_PHONE})(?![0-9])"),
    ("card", r"[0-9]", r"(?<![0-9A-Za-z-])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9A-Za-z]|-[0-9])"),
    ("name", _CAPITAL, rf"(?<!\p{{L}})(?:(?:(?:{'|'.join(SHORT_TITLES)})\.|(?:{_TITLE})) \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?|(?:{_FIRST}) \p{{Lu}}\p{{L}}{{1,30}})(?!\p{{L}})"),
)


def _any(kinds: tuple[str, ...]) -> str:
    return "|".join(f"(?={start})(?:{pattern})" for kind, start, pattern in PATTERNS if kind in kinds)


ANY = _any(tuple(k for k, _, _ in PATTERNS))
SPELLED = ("email", "secret", "name")


def _may_hold_name(text: Column) -> Column:
    """Two capitalised words in a row, or a short title: without them there is no name."""
    out = text.rlike(rf"{_CAPITAL}\p{{L}}++ {_CAPITAL}")
    for t in SHORT_TITLES:
        out = out | F.contains(text, F.lit(f"{t}. "))
    return out


def _may_hold_any(text: Column) -> Column:
    return text.rlike("[0-9@=:]") | _may_hold_name(text)


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def _number(hex_: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hex_, 1, digits), 16, 10).cast("long")


def _power(n: Column) -> Column:
    """10 to the n, for n from 0 to 18."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, tweak: Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs below the sizes."""

    def turn(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]  # noqa: E741
        even = i % 2 == 0
        return F.struct(
            F.when(even, (l + F.pmod(_number(_keyed(key, kind, tweak, i, r)), left_size)) % left_size).otherwise(l).alias("l"),
            F.when(even, r).otherwise((r + F.pmod(_number(_keyed(key, kind, tweak, i, l)), right_size)) % right_size).alias("r"),
        )

    out = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)
    return out["l"], out["r"]


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), a).cast("long"), F.substr(digits, a + 1, n - a).cast("long")
    done = F.struct(*[c.alias(x) for x, c in zip("lr", _feistel(left, right, _power(a), _power(n - a), key, kind, n), strict=True)])
    return _once(done, lambda d: F.concat(F.lpad(d["l"].cast("string"), a, "0"), F.lpad(d["r"].cast("string"), n - a, "0")))


def _fill(original: Column, digits: Column) -> Column:
    """``original`` with its digits replaced in order."""
    step = lambda acc, c: F.when(
        c.between("0", "9"), F.struct(F.concat(acc["s"], F.substr(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.split(original, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda acc: acc["s"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum whose remainder by 10 is 0 for a valid card number."""
    return F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")),
        lambda acc, c: _luhn_step(acc, F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)), c), lambda acc: acc["t"],
    )


def _luhn_step(acc: Column, d: Column, c: Column) -> Column:
    twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.struct((acc["t"] + F.when(acc["i"] % 2 == 1, twice).otherwise(d)).alias("t"), (acc["i"] + F.when(c == "", 0).otherwise(1)).alias("i"))


def _card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the last chosen for the same remainder of the check sum."""

    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _permute_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        last = lambda b: F.pmod(_luhn(d) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
        return _fill(m, _once(body, lambda b: F.concat(b, last(b))))

    return _once(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    """Country code and trunk 0 stay, so the rest is the same number in any form."""
    fixed = F.regexp_extract(m, rf"^(?:(?:\+|00[ .-]?){_COUNTRY}{_TRUNK}|1[ .-]|\(?0(?=[1-9][0-9/. )-]*$)(?!{_NORTH}$))", 0)
    rest = F.substr(m, F.length(fixed) + 1)
    return F.concat(fixed, _fill(rest, _permute_digits(_digits(rest), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    size = F.lit(1 << 16).cast("long")
    done = F.struct(*[c.alias(x) for x, c in zip("lr", _feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), size, size, key, "ip", F.lit(0)), strict=True)])
    return _once(done, lambda d: F.concat_ws(".", *[F.floor(d[x] / 256).cast("string") if high else (d[x] % 256).cast("string") for x in "lr" for high in (True, False)]))


def _letters(hex_: Column) -> Column:
    """Hexadecimal digits as 16 consonants and vowels."""
    return F.translate(hex_, "0123456789abcdef", "bcdfghjklmnprstu")


def _email_core(m: Column, key: str) -> Column:
    low = F.lower(m)
    name, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.concat(_letters(F.substring(_keyed(key, "local", name), 1, 15)), F.lit("@"), _letters(F.substring(_keyed(key, "host", host), 1, 15)), F.lit(".example."), F.substring_index(host, ".", -1))


def _like_case(original: Column, made: Column) -> Column:
    return F.when((original == F.upper(original)) & (original != F.lower(original)), F.upper(made)).otherwise(made)


def _email(m: Column, key: str) -> Column:
    return _like_case(F.substring_index(m, "@", 1), _email_core(m, key))


def _secret_parts(m: Column) -> tuple[Column, Column]:
    """Label with what follows it, value."""
    label = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(m, rf"^{_LABEL}\s*[=:]\s*[\"']?", 0))
    return label, F.substr(m, F.length(label) + 1)


def _secret_core(label: Column, value: Column, key: str, epoch: int) -> Column:
    # short ones have too few replacements of their length for many to stay distinct; keys with a prefix have 16 places
    n = F.length(value)
    n = F.when(label == "AKIA", n).otherwise(F.greatest(n, F.lit(8 + 4 * epoch))) if epoch else n
    hex_ = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda i: _keyed(key, "secret", value, i)), "")
    made = F.substr(F.when(value.rlike("^[0-9]+$"), F.translate(hex_, "abcdef", "012345")).otherwise(hex_), F.lit(1), n)
    return _like_case(value, made)


def _secret(m: Column, key: str, epoch: int) -> Column:
    """The label is kept; the value becomes one of the same length, letter case and alphabet."""
    label, value = _secret_parts(m)
    return F.concat(label, _secret_core(label, value, key, epoch))


def _name_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Title with what follows it, first name (or empty), surname, script."""
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0)
    rest = F.substr(m, F.length(title) + 1)
    first = F.when(F.contains(rest, F.lit(" ")), F.substring_index(rest, " ", 1)).otherwise("")
    surname = F.substring_index(rest, " ", -1)
    return title, first, surname, _script(surname)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _spell(hex_: Column, script: Column) -> Column:
    spell = lambda s: F.array_join(F.transform(F.split(hex_, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, y in enumerate(SYLLABLES[s]) for x in (f"{i:x}", y)]), c), F.lit(""))), "")
    return F.initcap(F.when(script == "cyrillic", spell("cyrillic")).when(script == "greek", spell("greek")).otherwise(spell("latin")))


def _surname(surname: Column, script: Column, key: str, epoch: int) -> Column:
    return _spell(F.substring(_keyed(key, "surname", F.lower(surname), F.lit(epoch)), 1, 6 + epoch), script)


def _listed(key: str) -> dict[str, str]:
    """A keyed permutation of the listed names of each script and gender, one cycle: none stays itself."""
    out = {}
    for names in NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1ffirst\x1f{n}".encode()).hexdigest())
        out |= {n.lower(): m for n, m in zip(order, order[1:] + order[:1], strict=True)}
    return out


def _first(title: Column, first: Column, key: str, epoch: int) -> Column:
    """Listed names are permuted; others are spelled, with an ending for the gender that the title tells."""
    low = F.lower(first)
    female = F.regexp_replace(F.trim(title), r"\.$", "").isin(TITLES["f"])
    script = _script(first)
    ending = lambda f, m: F.when(female, f).otherwise(m)
    spelled = F.concat(
        _spell(F.substring(_keyed(key, "first", low, F.lit(epoch)), 1, 6 + epoch), script),
        F.when(script == "cyrillic", ending("на", "н")).when(script == "greek", ending("να", "ς")).otherwise(ending("na", "n")),
    )
    listed = F.create_map(*[F.lit(x) for pair in _listed(key).items() for x in pair])
    return F.when(first == "", "").otherwise(F.coalesce(F.try_element_at(listed, low), spelled))


def _name(m: Column, key: str, epoch: int) -> Column:
    title, first, surname, script = _name_parts(m)
    new_first = _like_case(first, _first(title, first, key, epoch))
    return F.concat(title, F.when(first != "", F.concat(new_first, F.lit(" "))).otherwise(""), _like_case(surname, _surname(surname, script, key, epoch)))


def kind_of(m: Column) -> Column:
    out = F.lit("name")
    for kind, _, pattern in reversed(PATTERNS[:-1]):
        # the quote that ends a secret is not part of it
        whole = rf"^(?:AKIA[0-9A-Z]{{16}}$|{_LABEL}\s{{0,3}}[=:])" if kind == "secret" else f"^(?:{pattern})$"
        out = F.when(m.rlike(whole), kind).otherwise(out)
    return out


def surrogate(m: Column, kind: Column, key: str, epoch: int = 0) -> Column:
    """The replacement of a matched entity."""
    key = f"{key}/{epoch}" if epoch else key
    made = {
        "email": _email(m, key), "secret": _secret(m, key, epoch), "ip": _ip(m, key), "phone": _phone(m, key),
        "ssn": _fill(m, _permute_digits(_digits(m), key, "ssn")), "card": _card(m, key), "name": _name(m, key, epoch),
    }
    out = F.lit(None).cast("string")
    for k, c in made.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def spelled_entities(docs: DataFrame) -> DataFrame:
    """``kind`` and ``value`` of the names, addresses and secrets that are replaced, once for each document."""
    text = F.col("text")
    may = F.contains(text, F.lit("@")) | F.contains(text, F.lit("AKIA")) | text.rlike(rf"{_LABEL}\s{{0,3}}[=:]") | _may_hold_name(text)
    hit = F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return docs.select(F.explode(F.array_distinct(hit)).alias("value")).select(kind_of(F.col("value")).alias("kind"), "value").where(F.col("kind").isin(*SPELLED))


def collisions(found: DataFrame, key: str, epoch: int) -> int:
    """How many replacements stand for more than one entity, over the whole corpus.

    Names count whole, first name with surname, and their surnames, which may stand alone, by
    themselves; addresses and names without regard to case.  Numbers cannot meet.
    """
    k = f"{key}/{epoch}" if epoch else key
    v = F.col("value")
    title, first, surname, script = _name_parts(v)
    label, secret = _secret_parts(v)
    new_surname = _surname(surname, script, k, epoch)
    one = lambda kind, entity, made: F.struct(F.lit(kind).alias("kind"), entity.alias("entity"), made.alias("made"))
    spelled = (
        F.when(F.col("kind") == "email", F.array(one("email", F.lower(v), _email_core(v, k))))
        .when(F.col("kind") == "secret", F.array(one("secret", secret, _secret_core(label, secret, k, epoch))))
        .otherwise(F.array(one("surname", F.lower(surname), new_surname), one("name", F.lower(F.concat_ws(" ", first, surname)), F.concat_ws(" ", _first(title, first, k, epoch), new_surname))))
    )
    each = found.distinct().select(F.explode(spelled).alias("x")).select("x.*")
    return each.groupBy("kind", "made").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a <> b").count()


def find_epoch(docs: DataFrame, key: str, most: int = 8) -> int:
    """The first epoch of the key under which distinct entities stay distinct; each spells longer names and secrets."""
    found = spelled_entities(docs)
    for epoch in range(most):
        if not collisions(found, key, epoch):
            return epoch
    raise ValueError(f"replacements still meet after {most} epochs of the key")


def pseudonymise(docs: DataFrame, key: str, epoch: int | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, ``pii_kinds`` (sorted, distinct) and ``n_pii``."""
    if epoch is None:
        epoch = find_epoch(docs, key)

    def rewrite(text: Column) -> Column:
        typed = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _once(kind_of(m), lambda k: F.struct(k.alias("kind"), surrogate(m, k, key, epoch).alias("made"))))
        between = F.split(text, ANY, -1)
        return _once(
            typed,
            lambda t: F.struct(
                F.array_join(F.flatten(F.zip_with(between, t, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b["made"], F.lit(""))))), "").alias("text"),
                F.array_sort(F.array_distinct(F.transform(t, lambda x: x["kind"]))).alias("kinds"),
                F.size(t).alias("n"),
            ),
        )

    # the input's columns lie in a struct, so no name of theirs clashes
    hit = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(_may_hold_any(F.col("text")), rewrite(F.col("text"))).alias("found"))
    columns = [F.coalesce("found.text", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("pii_kinds", "n_pii")]
    return hit.select(*columns, F.coalesce("found.kinds", F.array().cast("array<string>")).alias("pii_kinds"), F.coalesce("found.n", F.lit(0)).alias("n_pii"))


def op3_surrogates(spark: SparkSession, sf_dir: str, key: str = "snapquarry") -> DataFrame:
    """All documents with their personal data replaced; in production the key comes from a secret store."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key).withColumn("pii_kinds", F.array_join("pii_kinds", ","))
