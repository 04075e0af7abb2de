"""Surrogates for personal data, all in Spark SQL.

Emails, phone numbers, IPv4 and IPv6 addresses, card numbers, IBANs, social security numbers
and titled personal names are found by one pattern and replaced by keyed
surrogates of the same type and format. A surrogate depends on the secret key
and the entity's canonical form alone, so every mention of one entity in the
whole corpus gets the same replacement (coreference):

* digits and letters are shifted by keyed hashes of all symbols to the left,
  then of all symbols to the right. Both passes can be undone, so two entities
  of one format never meet (distinctness by construction); signs stay, letters
  keep case and script, and the common vowels stay vowels. Letters of scripts
  without case move within their 16 neighbours among the code points;
* addresses shift whole octets and stay addresses; groups of an IPv6 address keep their number of digits, and zero stays zero, so
  that a short form stays one; card numbers keep the first
  digit and are valid by the check digit exactly if the original was, and so are IBANs, which keep their country; phone
  numbers keep their country code, which the list of country codes tells whether a sign follows it or not;
* given names of a titled person come from a list for the title's gender (after a title for both: of either)
  and the name's script; initials stay initials, hyphens stay. Lists are finite, so a collision check over the
  distinct entities of the corpus finds equal surrogates and draws again for
  all but one of them, and for surrogates that are an entity of the corpus
  themselves (their own among them), until there are none.

Found are emails with domains of ASCII letters, numbers in the formats below, and
names that follow a title: one to three words or initials, with hyphens, O' and Mc. Names without a title are not, and a person with
titles of different gender (Dr., Mrs.) is taken for two.

Surrogates are drawn once for each distinct entity of the corpus, laid into
each distinct mention, and joined to the documents that hold it; what is
shuffled are mentions and the texts that hold any, the other texts stay where
they are. A mention that a third of all documents share is one row on the
mention side; the joins' hot partitions are split by adaptive execution.

Defined cases: a null text stays null; an empty one stays empty; null ids and
repeated rows are kept; an empty table gives an empty result; very long texts
are worked on whole; all other columns pass through untouched. Counts have
underscores before their names where the input has such a column.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, spare

MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "Κύριος")
BOTH = ("Dr", "Prof", "Doctor", "Doktor", "Docteur", "Professor", "д-р", "проф")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Signora", "г-жа", "госпожа", "Κυρία")

#: Given names for surrogates, by script and gender.
NAMES = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Noel", "Oscar", "Paul", "Robert"),
    ("latin", "f"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Лидия", "Мария"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Λάμπρος", "Νίκος", "Πέτρος", "Σταύρος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
}

#: Letters that may stand for one another.
ALPHABETS = (
    "0123456789",
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "àáâäåèéêëìíîïòóôöùúûü",
    "çñß",
    "аеиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
)

#: Country codes of telephone numbers that have less than three digits (fixed values); all others have three.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _cased() -> tuple[str, ...]:
    """The other small letters that have a capital, by script (Latin, Greek, Cyrillic, Armenian)."""
    scripts: dict[str, str] = {}
    for c in map(chr, (*range(0x80, 0x590), *range(0x1E00, 0x2000))):
        if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c == c.upper().lower() and not any(c in x for x in ALPHABETS):
            script = unicodedata.name(c).split(" ")[0]
            scripts[script] = scripts.get(script, "") + c
    return tuple(x for x in scripts.values() if len(x) > 1)


_LOCAL = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}})\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
IP6 = (
    rf"(?<![\w:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*\d)(?:{_GROUP}(?::{_GROUP}){{0,5}})::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\w:]|\.\d)"
)
IBAN = r"(?<![\w-])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\w-])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)"
_ONE = r"(?:[OD]['’]|Ma?c)?\p{Lu}\p{Ll}+"
_WORD = rf"{_ONE}(?:-{_ONE})*"
_ALL_TITLES = MALE + FEMALE + BOTH
#: What may follow a title and is no name.
_NO_NAME = r"(?!Who(?!\p{L}))"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(_ALL_TITLES, key=len, reverse=True))})\.?\x20{_NO_NAME}(?:(?:\p{{Lu}}\.|{_WORD})\x20){{0,2}}{_WORD}(?!\p{{L}})"
ENTITY = "|".join((EMAIL, SSN, IP, IP6, IBAN, PHONE, CARD, NAME))

#: What a family name's surrogate begins with as the name does, in small letters.
PREFIX = r"^(?:[od]'|ma?c)(?=\p{L}{3})"

#: What every entity holds: a digit (an IPv6 address too), an at sign or a title. Quick to look for, it spares most texts the search.
DIGIT = r"[0-9@]"
TITLE = rf"(?=[{''.join(sorted({x[0] for x in _ALL_TITLES}))}])(?:{'|'.join(_ALL_TITLES)})\.?\x20"


def holds_entity(text: Column) -> Column:
    return F.coalesce((text.rlike(DIGIT) | text.rlike(TITLE)) & text.rlike(ENTITY), F.lit(False))


TYPES = ("email", "ssn", "ip", "ip6", "iban", "phone", "card", "name")


def kind_of(m: Column) -> Column:
    """The type of a mention that ``ENTITY`` has matched."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$") & m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(m.rlike(r"^[0-9A-Fa-f:]+$") & m.contains(":"), "ip6")
        .when(m.rlike(r"^[A-Z]{2}\d{2}\x20?[A-Z0-9]{4}"), "iban")
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(m.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def _lower(text: Column) -> Column:
    """In small letters, one for one: a letter whose small form is longer stays as it is."""
    one = lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)
    return F.when(F.length(F.lower(text)) == F.length(text), F.lower(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _groups(m: Column) -> Column:
    """The eight groups of an IPv6 address, in small letters and without leading zeros."""
    halves = F.split(F.lower(m), "::", 2)
    part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    left, right = part(0), part(1)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    return F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def canonical(m: Column) -> Column:
    """What makes two mentions the same entity.

    Case does not count in emails and names, separators and the country
    code do not count in numbers, nor does how an IPv6 address is shortened. A name's canonical form leads with its title's gender.
    """
    kind = kind_of(m)
    digits = F.regexp_replace(m, r"\D", "")
    national = F.when(m.startswith("+"), F.regexp_replace(digits, rf"^(?:{COUNTRY}|\d{{3}})", ""))
    bare = F.regexp_replace(m, r"^\S+\x20", "")
    title = F.regexp_replace(F.element_at(F.split(m, " "), 1), r"\.$", "")
    gender = F.when(title.isin(*MALE), "m:").when(title.isin(*FEMALE), "f:").otherwise("n:")
    return (
        F.when(kind == "email", _lower(m))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "phone", F.coalesce(national, digits))
        .when(kind == "ip", m)
        .when(kind == "ip6", F.array_join(_groups(m), ":"))
        .when(kind == "iban", F.regexp_replace(m, r"\x20", ""))
        .otherwise(F.concat(gender, _lower(F.translate(bare, "’", "'"))))
    )


_CASED = _cased()


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number from 0 to 2**28 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 7), 16, 10).cast("int")


def _pass(s: str, tweak: str) -> Column:
    """Each symbol of column ``s`` moves within its alphabet by a keyed hash of the symbols before it.

    The result is reversed. The key is in column ``__key``.
    """
    draw = f"cast(conv(substr(sha2(concat_ws('|', __key, {tweak}, i, substr({s}, 1, i)), 256), 1, 7), 16, 10) as int)"
    cases = " ".join(f"when instr('{x}', c) > 0 then substr('{x}', pmod(instr('{x}', c) - 1 + {draw}, {len(x)}) + 1, 1)" for x in ALPHABETS + _CASED)
    near = f"decode(unhex(lpad(hex(ascii(c) - pmod(ascii(c), 16) + pmod(ascii(c) + {draw}, 16)), 8, '0')), 'UTF-32')"
    cases += f" when c rlike '\\\\p{{L}}' then {near}"
    return F.expr(f"reverse(array_join(transform(filter(split({s}, ''), c -> c != ''), (c, i) -> case {cases} else c end), ''))")


def _group_pass(groups: str, key: str, tweak: Column, mark: str) -> Column:
    """Each number moves, by a keyed hash of those before it, among the numbers of as many hexadecimal digits; 0 stays."""
    def moved(g: Column, i: Column) -> Column:
        low = F.pow(F.lit(16.0), F.length(F.hex(g)) - 1).cast("long")
        before = F.array_join(F.transform(F.slice(groups, F.lit(1), i), lambda x: x.cast("string")), ":")
        return F.when(g == 0, g).otherwise(F.pmod(g - low + _draw(key, tweak, F.lit(mark), before), low * 15) + low)

    return F.transform(groups, moved)


def _luhn(prefix: Column) -> Column:
    """The check digit that a card number with these leading digits must have."""
    digits = F.transform(F.filter(F.split(F.reverse(prefix), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _shifted(df: DataFrame, out: str, s: Column, key: str, tweak: Column) -> DataFrame:
    """Adds ``out``: a keyed bijection on the strings of one format, forward and then backward."""
    df = df.withColumns({"__s": s, "__t": tweak, "__key": F.lit(key)})
    df = df.withColumns({"__s": _pass("__s", "__t"), "__t": F.concat("__t", F.lit("<"))})
    return df.withColumn(out, _pass("__s", "__t")).drop("__s", "__t", "__key")


def _given(gender: Column, given: Column, key: str) -> Column:
    """A given name from the list for the gender and script; null for a script without a list, and for an initial."""
    draw = _draw(key, F.lit("given"), gender, given)
    pick = F.when(given.rlike(r"\.$"), F.lit(None).cast("string"))
    for script, mark in (("latin", r"\p{IsLatin}"), ("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}")):
        for sex, names in (("m", NAMES[script, "m"]), ("f", NAMES[script, "f"]), ("n", NAMES[script, "m"] + NAMES[script, "f"])):
            one = F.array(*map(F.lit, names))[F.pmod(draw, F.lit(len(names)))]
            pick = pick.when((gender == sex) & given.rlike(rf"^{mark}"), one)
    return pick


def _given_names(gender: Column, words: Column, shifted: Column, key: str) -> Column:
    """``words``, the given names, from lists, hyphenated ones by parts; where there is no list, as in ``shifted``, the same words shifted."""
    def one(word: Column, other: Column) -> Column:
        parts = F.zip_with(F.split(word, "-"), F.split(other, "-"), lambda w, o: F.coalesce(_given(gender, w, key), o))
        return F.array_join(parts, "-")

    return F.array_join(F.zip_with(words, F.split(shifted, " "), one), " ")


def _mod97(iban: Column) -> Column:
    """What an account number (letters count from A = 10) leaves after a division by 97; 1 for a valid one that is turned (country and check digits last)."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(iban, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """Adds ``s`` to rows (kind, canon, attempt): the entity's surrogate at that draw (0: the first).

    A later draw joins the given name, shifted by draw and gender, to the listed
    one; that differs wherever the given names differ. Letters are in lower case but for given names from a list; :func:`laid_in`
    gives them a mention's format.
    """
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    tweak = F.concat(kind, F.when(attempt > 0, F.concat(F.lit("#"), attempt.cast("string"))).otherwise(""))
    at = F.instr(canon, "@")
    bare = F.substring(canon, F.lit(3), F.length(canon))
    domain = F.when(kind == "email", F.substring(canon, at + 1, F.length(canon))).otherwise("")
    df = found.withColumn("__domain", domain).withColumn("__top", F.regexp_extract("__domain", r"\.[^.]*$", 0))
    df = df.withColumn("__words", F.split(bare, r"\x20"))
    # what is shifted first: the local part, the family name, the inner digits of a card, all digits
    main = (
        F.when(kind == "email", F.substring(canon, F.lit(1), at - 1))
        .when(kind == "name", F.regexp_replace(F.element_at("__words", -1), PREFIX, ""))
        .when(kind == "card", F.substring(canon, F.lit(2), F.length(canon) - 2))
        .when(kind == "iban", F.lower(F.substring(canon, F.lit(5), F.length(canon))))
        .when(kind.isin("ip", "ip6"), "")
        .otherwise(canon)
    )
    by = (
        F.when(kind == "email", F.concat(tweak, F.lit("@"), F.col("__domain")))
        .when(kind == "name", F.concat(F.lit("family"), F.regexp_extract(F.element_at("__words", -1), PREFIX, 0), F.when((attempt > 0) & (F.size("__words") < 2), F.concat(F.lit("#"), attempt.cast("string"))).otherwise("")))
        .when(kind == "card", F.concat(tweak, F.substring(canon, 1, 1)))
        .when(kind == "iban", F.concat(tweak, F.substring(canon, 1, 4)))
        .otherwise(tweak)
    )
    df = _shifted(df, "__main", main, key, by)
    df = df.withColumn("__main", F.concat(F.when(kind == "name", F.regexp_extract(F.element_at("__words", -1), PREFIX, 0)).otherwise(""), "__main"))
    # and second: the domain without its last label, given names, for those that have no list
    second = F.when(kind == "email", F.substring("__domain", F.lit(1), F.length("__domain") - F.length("__top"))).otherwise(
        F.when((kind == "name") & (F.size("__words") > 1), F.array_join(F.slice("__words", F.lit(1), F.size("__words") - 1), " ")).otherwise("")
    )
    drawn = F.concat(F.lit("given"), F.when(attempt > 0, F.concat_ws("#", F.lit(""), attempt.cast("string"), F.substring(canon, 1, 1))).otherwise(""))
    df = _shifted(df, "__second", second, key, F.when(kind == "email", F.concat(F.lit("email"), F.col("__top"))).otherwise(drawn))
    # octets, forward and backward
    octet = F.split(F.when(kind == "ip", canon).otherwise("0.0.0.0"), r"\.")
    df = df.withColumns({f"__o{i}": octet[i].cast("int") for i in range(4)})
    for mark, order in ((">", (0, 1, 2, 3)), ("<", (3, 2, 1, 0))):
        moved, before = {}, []
        for i in order:
            moved[f"__o{i}"] = F.pmod(F.col(f"__o{i}") + _draw(key, tweak, F.lit(mark), *[F.col(b).cast("string") for b in before]), F.lit(256))
            before.append(f"__o{i}")
        df = df.withColumns(moved)
    # groups of hexadecimal digits, forward and backward
    df = df.withColumn("__groups", F.transform(F.split(F.when(kind == "ip6", canon).otherwise("0"), ":"), lambda g: F.conv(g, 16, 10).cast("long")))
    for mark in (">", "<"):
        df = df.withColumn("__groups", F.reverse(_group_pass("__groups", key, tweak, mark)))
    ip6 = F.array_join(F.transform("__groups", lambda g: F.lower(F.hex(g))), ":")
    # an account number's check digits are as far from the valid ones as they were
    country = F.substring(canon, 1, 2)
    valid = lambda number: 98 - _mod97(F.concat(number, country, F.lit("00")))
    off = F.when(kind == "iban", F.substring(canon, 3, 2).cast("int") - valid(F.substring(canon, F.lit(5), F.length(canon))))
    number = F.upper("__main")
    iban = F.concat(country, F.lpad(F.pmod(valid(number) + off, F.lit(100)).cast("string"), 2, "0"), number)
    n = F.length(canon)
    lead = F.concat(F.substring(canon, 1, 1), F.col("__main"))
    df = df.withColumn("__off", F.when(kind == "card", F.substring(canon, n, F.lit(1)).cast("int") - _luhn(F.substring(canon, F.lit(1), n - 1))))
    card = F.concat(lead, F.pmod(_luhn(lead) + F.col("__off"), F.lit(10)).cast("string"))
    gender = F.substring(canon, 1, 1)
    listed = _given(gender, F.regexp_extract(F.element_at("__words", 1), "^[^-]*", 0), key)
    given = _given_names(gender, F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 1, F.lit(0))), F.col("__second"), key)
    given = F.when(attempt > 0, F.concat_ws("-", given, F.initcap(F.translate("__second", ". ", "")))).otherwise(given)
    # a family name alone that is short may find all names of its format taken: later draws make it longer
    longer = F.when(attempt > 2, F.lower(F.coalesce(listed, F.col("__main")))).otherwise("")
    name = F.when(F.size("__words") < 2, F.concat("__main", longer)).otherwise(F.concat(given, F.lit(" "), F.col("__main")))
    s = (
        F.when(kind == "email", F.concat("__main", F.lit("@"), "__second", "__top"))
        .when(kind == "ip", F.concat_ws(".", *[F.col(f"__o{i}").cast("string") for i in range(4)]))
        .when(kind == "card", card)
        .when(kind == "ip6", ip6)
        .when(kind == "iban", iban)
        .when(kind == "name", name)
        .otherwise(F.col("__main"))
    )
    return df.withColumn("s", s).select(*found.columns, "s")


def laid_in(m: Column, kind: Column, s: Column) -> Column:
    """``s`` in the format of the mention ``m``: separators, country code, title and case."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    extra = F.length(F.regexp_replace(m, r"\D", "")) - F.length(s)

    def digit(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"\D", "")) - extra
        return F.when(c.rlike(r"^\d$") & (nth > 0), F.substring(s, nth, F.lit(1))).otherwise(c)

    def upper(c: Column) -> Column:
        return F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)

    def as_in(own: Column, new: Column) -> Column:
        """The symbols of ``new`` with the case of those of ``own`` at the same places."""
        pairs = F.zip_with(F.split(own, ""), F.split(new, ""), lambda c, x: F.when(c != F.lower(c), upper(x)).otherwise(x))
        return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "")

    def capital(w: Column) -> Column:
        return F.concat(upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    # the family name has the letters' case and the apostrophe of the mention, given names begin with capitals
    bare = F.regexp_replace(m, r"^\S+\x20", "")
    family, new_family = F.element_at(F.split(bare, " "), -1), F.element_at(F.split(s, " "), -1)
    worded = F.when(F.length(family) == F.length(new_family), as_in(family, new_family)).otherwise(capital(new_family))
    worded = F.when(m.contains("’"), F.translate(worded, "'", "’")).otherwise(worded)
    given = F.transform(F.slice(F.split(s, " "), F.lit(1), F.size(F.split(s, " ")) - 1), lambda w: F.array_join(F.transform(F.split(w, "-"), capital), "-"))
    name = F.concat(F.regexp_extract(m, r"^\S+\x20", 0), F.array_join(F.concat(given, F.array(worded)), " "))
    # groups that the mention writes out, by their place; a group's zeros in front stay
    halves = F.split(m, "::", 2)
    groups, new_groups = F.split(F.get(halves, F.lit(0)), ":"), F.split(s, ":")
    capitals = lambda own, new: F.when(own.rlike("[A-F]"), F.upper(new)).otherwise(new)
    written = lambda own, new: F.when(own == "", "").otherwise(capitals(own, F.lpad(new, F.greatest(F.length(own), F.length(new)), "0")))
    left = F.array_join(F.zip_with(groups, F.slice(new_groups, F.lit(1), F.size(groups)), written), ":")
    tail = F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":")
    right = F.array_join(F.zip_with(tail, F.slice(new_groups, 9 - F.size(tail), F.size(tail)), written), ":")
    ip6 = F.when(m.contains("::"), F.concat(left, F.lit("::"), right)).otherwise(left)
    # symbols of an account number go where the mention has them
    places = F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(s, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"\x20", "")), F.lit(1))))
    return (
        F.when(kind == "email", as_in(m, s))
        .when(kind == "ip", s)
        .when(kind == "ip6", ip6)
        .when(kind == "iban", F.array_join(places, ""))
        .when(kind == "name", name)
        .otherwise(F.array_join(F.transform(chars, digit), ""))
    )


def distinct_surrogates(found: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(kind, canon, attempt, s) of distinct (kind, canon), after the collision check.

    Two entities of a kind collide if their surrogates are equal but for case.
    In each collision the smallest canonical form stays, the others draw again;
    where the surrogate is an entity that was found itself, all do.
    """
    state = cut(surrogates(found.withColumn("attempt", F.lit(0)), key))
    bare = F.when(F.col("kind") == "name", F.substring("canon", F.lit(3), F.length("canon"))).otherwise(F.col("canon"))
    real = cut(found.select("kind", bare.alias("low")).distinct()).withColumn("real", F.lit(True))
    for _ in range(rounds):
        low = F.lower("s").alias("low")
        clash = state.groupBy("kind", low).agg(F.count("*").alias("n"), F.min("canon").alias("stays")).join(real, ["kind", "low"], "left")
        clash = cut(clash.where("n > 1 OR real").select("kind", "low", F.when(F.col("real"), "").otherwise(F.col("stays")).alias("stays")))
        if clash.isEmpty():
            return state
        again = F.when(F.col("stays").isNotNull() & (F.col("canon") != F.col("stays")), F.col("attempt") + 1).otherwise(F.col("attempt"))
        state = state.withColumn("low", F.lower("s")).join(clash, ["kind", "low"], "left").select("kind", "canon", again.alias("attempt"))
        state = cut(surrogates(state, key))
    raise RuntimeError(f"surrogates still collide after {rounds} draws")


def replacements(held: DataFrame, key: str) -> DataFrame:
    """(row, replace map<mention, replacement>) of rows (row, m): the mentions that each row's text holds."""
    m = F.col("m")
    distinct = cut(held.select("m").distinct().select("m", kind_of(m).alias("kind"), canonical(m).alias("canon")))
    drawn = distinct_surrogates(distinct.select("kind", "canon").distinct(), key)
    laid = cut(distinct.join(drawn, ["kind", "canon"]).select("m", laid_in(m, F.col("kind"), F.col("s")).alias("r")))
    return held.join(small(laid), "m").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("m", "r"))).alias("replace"))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced; all other columns as they are.

    ``counts`` adds ``n_<type>`` for each type of entity.
    """
    text = F.col(text_col)
    hit = holds_entity(text)
    names = docs.columns
    row, found = spare(docs, "row", "found")
    # rows are known by their place in the cut table, as ids may be null or repeat
    mine = cut(docs.where(hit).withColumns({row: F.monotonically_increasing_id(), found: F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))}))
    maps = replacements(mine.select(F.col(row).alias("row"), F.explode(F.array_distinct(found)).alias("m")), key)
    own, known = spare(mine, "own", "known")
    mine = mine.join(maps.toDF(own, known), F.col(row) == F.col(own), "left")
    zipped = F.arrays_zip(F.split(text, ENTITY, -1).alias("p"), F.col(found).alias("m"))
    woven = F.array_join(F.transform(zipped, lambda z: F.concat(z["p"], F.when(z["m"].isNull(), "").otherwise(F.element_at(F.col(known), z["m"])))), "")
    kept = [woven.alias(c) if c == text_col else F.col(c) for c in names]
    rest = docs.where(~hit)
    if counts:
        kinds = F.transform(found, kind_of)
        kept += [(F.size(kinds) - F.size(F.array_remove(kinds, t))).cast("long").alias(c) for t, c in zip(TYPES, spare(docs, *[f"n_{t}" for t in TYPES]), strict=True)]
        rest = rest.select("*", *[F.lit(0).cast("long").alias(c) for c in spare(docs, *[f"n_{t}" for t in TYPES])])
    return rest.union(mine.select(*kept))


#: The key of the registered query. A deployment passes its own secret.
KEY = "surrogates-1"


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, KEY, counts=True)
