"""Surrogates for personal data and secrets, with DataFrame and SQL functions only.

Entities are found by one pattern, brought to a normal form (so that spellings of one entity stay one), and each different entity gets one keyed
replacement of its own kind: same format, script and gender, valid check digits. Names are found after a title, an introduction, a signature or in a letter's head; each of their parts is an entity, and all
later mentions of a part in the same text, with or without a title, are replaced too. Replacements are checked over all entities: none is
shared by two of them and none equals an entity that occurs; those that clash try the next attempt. So equal entities read
equal and different ones different after replacement, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, written

KEY = "quern-surrogates-1"
#: Every so many attempts a replacement without a fixed length grows, so that its space cannot run out.
GROW = 4
MAX_ATTEMPTS = 60

#: Titles by gender, words that join the parts of a name, and words that begin sentences after an abbreviated title ("Elm Dr. The").
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Mx")
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "dos", "la", "le", "bin", "ibn", "al", "el", "zu", "af", "av", "ter", "ten")
NO_NAMES = ("the", "and", "but", "for", "not", "this", "that", "these", "those", "they", "she", "his", "her", "you", "der", "die", "das", "und", "les", "los", "las", "una")
#: Signs of secrets that need hold no digit.
_TOKEN_SIGNS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "sk-", "xox", "eyJ", "earer ", "PRIVATE KEY")

#: Fixed patterns of entities. No group is repeated without a bound, as Java's engine would recurse once per turn.
_TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True))
_SHOUTED = "|".join(sorted((t.upper() for t in FEMALE + MALE + NEUTRAL), key=len, reverse=True))
_PASSPORT = r"(?i:passport)(?: (?i:no\.?|nr\.?|number))?"
_LABEL = rf"(?:(?:(?i:token|secret|api[_-]?key|passwd|password|pwd)|{_PASSPORT})\s?[=:]\s?[\"']?|(?i:bearer) (?=[A-Za-z0-9._~+/-]{{16}})|{_PASSPORT} (?=[A-Z]{{0,2}}\d{{6}}))"
_PEM = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_TOKEN = r"(?:gh[oprsu]_|github_pat_|sk-|xox[abeprs]-|eyJ)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "pem": _PEM + r"(?:\s{1,2}+[A-Za-z0-9+/=]{16,}+){1,200}(?:\s{1,2}+[A-Za-z0-9+/=]{1,15}+(?=\s?-----END))?",
    "login": r"(?<=://)[^\s/@:]{1,64}+:[^\s/@]{1,128}+(?=@)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,126}\.\p{L}{2,63}",
    "cloud_key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![\p{L}\p{N}_])" + _LABEL + r"[^\s\"',;]{6,}",
    "token": r"(?<![\p{L}\p{N}_])" + _TOKEN + r"[A-Za-z0-9_.-]{19,}[A-Za-z0-9_-]",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,30}}\d)(?:{_HEX}:){{2,6}}(?:(?::{_HEX}){{1,5}}|:)|(?=[A-Fa-f:]{{0,30}}\d){_HEX}:(?::{_HEX}){{2,6}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\d+])\+\d(?:[ .-]?[()]?[ .-]?\d){6,14}(?!\d)|(?<![\d(+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|"
    r"(?<![\d(+.,/-])0(?:\d(?:[ .]\d\d){4}|\d{2,4}[ /-](?:\d{6,8}|\d{3,4}[ -]\d{3,4}))(?![\d-])",
    "ssn": r"(?<![\d.+-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\d|\.\d)",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
#: One pattern for all, ordered so that most places fail at one look: kinds that begin a word, then those that begin with a digit or sign.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("pem", "login", "email", "cloud_key", "secret", "token", "iban", "ipv6")) + ")|"
    "(?=[+(0-9])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "ssn", "ip", "card")) + ")"
)
#: A word that may be part of a name: two letters or more, the first a capital, or letters that have no case.
NAME_PART = r"(?<![\p{L}\p{M}])[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]++"
_NAME = r"[\p{Lu}\p{Lt}\p{Lo}](?:[\p{L}\p{M}]++(?:['’-]\p{L}[\p{L}\p{M}]*+){0,5}|['’-]\p{Lu}[\p{L}\p{M}]++(?:['’-]\p{L}[\p{L}\p{M}]*+){0,5}|\.)"
_JOINED = "(?:(?:" + "|".join(PARTICLES) + ")[ -]){0,3}" + _NAME
_LOUD = r"\p{Lu}(?:[\p{Lu}\p{M}]++(?:['’-]\p{Lu}++){0,5}|['’-]\p{Lu}++|\.)(?![\p{L}\p{M}])"
#: What else says that a name follows: an introduction; a signature, a form's field or a letter's head, which want a first and a last name.
_INTRODUCED, _SIGNED = "[Mm]y name is ", r"(?:[Nn]ame: |[Ss]igned,? |[Rr]egards,\s|[Ss]incerely,\s)"
_HEAD = "(?m:^)(?:From|To|Cc): "
#: A name with all the titles before it, or with what introduces it; titles in capitals only before a name in capitals.
PERSON = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLES})\.? ){{1,4}}{_JOINED}(?: {_JOINED}){{0,8}}|(?:(?:{_SHOUTED})\.? ){{1,4}}{_LOUD}(?: {_LOUD}){{0,8}}|"
    rf"{_INTRODUCED}{_JOINED}(?: {_JOINED}){{0,3}}|{_SIGNED}{_JOINED}(?: {_JOINED}){{1,3}}|{_HEAD}{_JOINED}(?: {_JOINED}){{1,3}}(?m:(?= ?<| ?$)))"
)
_TITLE_RUN = rf"^(?:{_INTRODUCED}|{_SIGNED}|{_HEAD})?(?:(?:{_TITLES}|{_SHOUTED})\.? )*"
#: A title's first letter and any title's rest: quick to look for, and no text with a title lacks it.
_TITLE_SIGN = "[" + "".join(sorted({t[0] for t in FEMALE + MALE + NEUTRAL})) + "](?:" + "|".join(sorted({x[1:] for t in FEMALE + MALE + NEUTRAL for x in (t, t.upper())})) + r")\.? "
_CUE_SIGN = r"y name is |ame: |igned,? |egards,\s|incerely,\s|From: |To: |Cc: "
#: In texts with titled names every word that may be part of one is looked at.
RICH = f"{PATTERN}|{NAME_PART}"

#: Letters by class, as replacements for letters of that class: per script, so that a script stays. Other letters become Latin ones.
_LETTERS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[ß-öø-ÿ]": "àáâäåçèéêëìíîïñòóôöøùúûüý",
    "[À-ÖØ-Þ]": "ÀÁÂÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝ",
    "[а-яё]": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[Α-ΩΆ-Ώ]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "安白成德方国海和建江金林明宁平清山天文小新永玉志中",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조주수우구누두루무부",
    r"\p{IsArabic}": "ابتجحدرزسشصطعفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवसह",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: Consonants, vowels and endings of made-up names by script with genders; other scripts get letters of their own.
_NAMES = {"latin": ("bdfgklmnprstv", "aeiou", "a", "n"), "cyrillic": ("бвгдклмнпрст", "аеиоу", "а", "н"), "greek": ("βγδζκλμνπρστ", "αειου", "α", "ς")}
_MOST_SYLLABLES = 12
_GREEK, _CYRILLIC, _LATIN = r"\p{IsGreek}", r"\p{IsCyrillic}", r"\p{IsLatin}"


def holds_name(text: Column) -> Column:
    """Whether a text holds a name after a title, or another sign that a name follows."""
    return F.coalesce((text.rlike(_TITLE_SIGN) | text.rlike(_CUE_SIGN)) & text.rlike(PERSON), F.lit(False))


def holds_entity(text: Column) -> Column:
    """Whether an entity is found in a text. Each kind has a sign that is quick to look for, and most texts have none."""
    signs = text.rlike("[@0-9=:]")
    for sign in _TOKEN_SIGNS:
        signs |= text.contains(sign)
    return F.coalesce(signs & text.rlike(PATTERN), F.lit(False)) | holds_name(text)


def _all_of(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(code: Column) -> Column:
    """An account number's remainder: its first four characters moved to the end, letters counted from 10."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise(rest)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def kind_of(match: Column) -> Column:
    """The kind of a match: "word" for what may be part of a name; null if it is nothing after all (a number with a wrong check digit)."""
    return (
        F.when(match.startswith("-----BEGIN"), "pem")
        .when(match.contains("@") & match.rlike(_all_of(PATTERNS["email"])), "email")
        .when(match.rlike("^A[KS]IA[0-9A-Z]{16}$"), "cloud_key")
        .when(match.rlike("^" + _LABEL), "secret")
        .when(match.rlike("^" + _TOKEN + "[A-Za-z0-9_.-]{20}"), "token")
        .when(match.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$"), F.when(_mod97(F.replace(match, F.lit(" "), F.lit(""))) == 1, "iban"))
        .when(match.rlike(_all_of(PATTERNS["ip"])), "ip")
        .when(match.rlike(_all_of(PATTERNS["phone"])), "phone")
        .when(match.rlike(_all_of(PATTERNS["ssn"])), "ssn")
        .when(match.rlike(r"^[\d -]+$"), F.when(_luhn_sum(_digits(match)) % 10 == 0, "card"))
        .when(match.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(match.rlike(r"^[^\s/@:]+:[^\s/@]+$"), "login")
        .when(match.rlike(r"^\p{L}"), "word")
    )


def normal_form(kind: Column, match: Column) -> Column:
    """What tells one entity of a kind from another: case, spacing and labels set aside."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), _digits(match))
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(match, "^" + _LABEL, ""))
        .when(kind.isin("email", "ipv6", "word"), F.lower(match))
        .otherwise(match)
    )


def name_parts(match: Column) -> Column:
    """The parts of a titled name: an array of part (lower case) and kind: "person" for those of the last word, else "person_f", "person_m" or "person_n".

    Titles, words that join parts, initials and words that are no names are left out.
    """
    title = F.regexp_extract(match, _TITLE_RUN, 0)
    said = F.transform(F.split(title, r"\.? "), lambda t: F.lower(t))
    has = lambda titles: F.arrays_overlap(said, F.array(*[F.lit(t.lower()) for t in titles]))
    given = F.when(has(FEMALE), "person_f").when(has(MALE), "person_m").otherwise("person_n")
    titles = [t.lower() for t in FEMALE + MALE + NEUTRAL]
    words = F.filter(F.split(F.substring(match, F.length(title) + 1, F.length(match)), " "), lambda w: w.rlike(NAME_PART) & ~F.lower(w).isin(*NO_NAMES, *titles))

    def parts(word: Column, i: Column) -> Column:
        kind = F.when(i == F.size(words) - 1, "person").otherwise(given)
        return F.transform(F.regexp_extract_all(word, F.lit(NAME_PART), F.lit(0)), lambda p: F.struct(F.lower(p).alias("part"), kind.alias("kind")))

    return F.flatten(F.transform(words, parts))


def _stream(key: str, *parts: Column) -> Column:
    """128 hex digits fixed by the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 1 + 2 * (i % 64), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))


def _swapped(text: Column, stream: Column, letters: dict[str, str] | None = None) -> Column:
    """Each letter and digit replaced by one of its own class; all else stays."""

    def one(c: Column, b: Column) -> Column:
        out = F.when(F.lit(False), c)
        for pattern, choice in (letters or _LETTERS).items():
            out = out.when(c.rlike(pattern), _pick(choice, b))
        return out.otherwise(c)

    return let(stream, lambda s: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, _byte(s, i))), ""))


def _name(part: Column, kind: Column, attempt: Column, key: str) -> Column:
    """A made-up name for a part of one: syllables and an ending that follows the gender; a last name's is neutral. Later attempts are longer."""
    stream = _stream(key, F.lit("name"), kind, part, attempt.cast("string"))
    n = F.least(F.lit(3) + F.floor(attempt / 2), F.lit(_MOST_SYLLABLES))

    def built(script: str) -> Column:
        consonants, vowels, end_f, end_m = _NAMES[script]
        syllable = lambda k: F.concat(_pick(consonants, _byte(stream, F.lit(2 * k))), _pick(vowels, _byte(stream, F.lit(2 * k + 1))))
        syllables = [F.when(F.lit(k) < n, syllable(k)).otherwise("") for k in range(_MOST_SYLLABLES)]
        ending = F.when(kind == "person_f", F.lit(consonants[7] + end_f)).when(kind == "person_m", F.lit(end_m)).otherwise(_pick(consonants, _byte(stream, F.lit(40))))
        return F.concat(*syllables, ending)

    return (
        F.when(part.rlike(_CYRILLIC), built("cyrillic"))
        .when(part.rlike(_GREEK), built("greek"))
        .when(part.rlike(_LATIN), built("latin"))
        .otherwise(F.concat(_swapped(part, stream), F.repeat(_swapped(F.substring(part, 1, 1), F.reverse(stream)), F.floor(attempt / GROW).cast("int"))))
    )


def surrogate(kind: Column, normal: Column, attempt: Column, key: str = KEY) -> Column:
    """The normal form of an entity's replacement."""
    stream = _stream(key, kind, normal, attempt.cast("string"))
    longer = F.floor(attempt / GROW).cast("int")
    more = F.substring(F.translate(F.reverse(stream), "0123456789", "ghijkmnpqr"), F.lit(1), longer)
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    host, tld = F.regexp_extract(domain, r"^(.*)(\.\p{L}+)$", 1), F.regexp_extract(domain, r"^(.*)(\.\p{L}+)$", 2)
    email = F.concat(more, _swapped(local, stream), F.lit("@"), _swapped(host, _stream(key, F.lit("domain"), domain)), tld)
    body = _swapped(F.substring(normal, F.lit(2), F.length(normal) - 2), stream)
    head = F.concat(F.substring(normal, 1, 1), body)
    card = F.concat(head, ((10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))
    code = F.greatest(F.length(normal) - 10, F.when(normal.startswith("0"), 1).otherwise(0))  # a country's code or a trunk's zero stays
    area = _pick("23456789", _byte(stream, F.lit(31)))
    phone = F.concat(F.substring(normal, F.lit(1), code), area, _swapped(F.substring(normal, code + 2, F.length(normal)), stream))
    ssn = F.concat(_pick("12345678", _byte(stream, F.lit(31))), _swapped(F.substring(normal, 2, 8), stream))
    ip = F.concat_ws(".", *[(_byte(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    hexes = {"[0-9]": "0123456789", "[a-f]": "abcdef"}
    ipv6 = _swapped(normal, stream, hexes)
    secret = F.concat(F.when(normal.rlike("^(?=.*[a-f])[0-9a-f]+$"), _swapped(normal, stream, {"[0-9a-f]": "0123456789abcdef"})).otherwise(_swapped(normal, stream)), F.substring(stream, F.lit(60), longer))
    cloud = F.concat(F.substring(normal, 1, 4), _swapped(F.substring(normal, 5, 16), stream))
    prefix = F.regexp_extract(normal, "^" + _TOKEN, 0)
    token = F.concat(prefix, _swapped(F.substring(normal, F.length(prefix) + 1, F.length(normal)), stream), F.substring(stream, F.lit(60), longer))
    head_of = F.regexp_extract(normal, "^" + _PEM, 0)
    pem = F.concat(head_of, _swapped(F.substring(normal, F.length(head_of) + 1, F.length(normal)), stream))
    login = F.concat(_swapped(normal, stream), F.substring(stream, F.lit(60), longer))
    country, account = F.substring(normal, 1, 2), _swapped(F.substring(normal, F.lit(5), F.length(normal)), stream)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ipv6", ipv6)
        .when(kind == "secret", secret).when(kind == "token", token).when(kind == "cloud_key", cloud).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "pem", pem).when(kind == "login", login)
        .otherwise(_name(normal, kind, attempt, key))
    )


def written_like(kind: Column, match: Column, core: Column) -> Column:
    """A replacement's normal form in the spelling of the match: its punctuation, label and case."""

    def spaced(letter: str) -> Column:
        return F.aggregate(
            F.split(match, ""),
            F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
            lambda a, c: F.when(c.rlike(letter), F.struct(F.concat(a["s"], F.substring(core, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(
                F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))
            ),
            lambda a: a["s"],
        )

    loud = (F.upper(match) == match) & (F.lower(match) != match)
    return (
        F.when(kind.isin("phone", "card", "ssn"), spaced("[0-9]"))
        .when(kind == "iban", spaced("[0-9A-Z]"))
        .when(kind == "secret", F.concat(F.regexp_extract(match, "^" + _LABEL, 0), core))
        .when(kind.startswith("person"), F.when(loud, F.upper(core)).otherwise(F.initcap(core)))
        .when(kind.isin("email", "ipv6"), F.when(loud, F.upper(core)).otherwise(core))
        .otherwise(core)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entities``: kind, normal (each once). Returns it with ``core``: replacements no two entities of a kind share (parts of names are one kind here),
    and none of which is itself an entity of that kind in the table.

    Each round groups candidates by themselves. The earliest settled entity keeps a shared one, then the smallest; the others try again.
    Clashes are rare, so a few rounds do; each is written to the shared folder. Kinds of free length grow with the attempts; if one of
    fixed length has so many entities that no free replacements are found, that is an error: nothing is masked or left as it is.
    """
    space = F.when(F.col("kind").startswith("person"), "person").otherwise(F.col("kind"))
    state = written(entities.select("kind", "normal", F.lit(0).alias("attempt")), "entities")
    for turn in range(1, MAX_ATTEMPTS + 1):
        tried = state.withColumn("space", space).withColumn("core", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key))
        tried = written(tried, "candidates")
        owners = tried.groupBy("space", "core").agg(F.min(F.struct("attempt", "kind", "normal")).alias("owner"))
        taken = tried.select("space", F.col("normal").alias("core"), F.lit(True).alias("real")).distinct()
        judged = tried.join(owners, ["space", "core"]).join(taken, ["space", "core"], "left")
        again = (F.col("owner.normal") != F.col("normal")) | (F.col("owner.kind") != F.col("kind")) | F.col("real").isNotNull()
        judged = written(judged.select("kind", "normal", "attempt", "core", again.alias("again")), "judged")
        clashing = judged.filter("again").groupBy("kind").agg(F.count("*").alias("n")).collect()  # a row a kind
        if not clashing:
            return judged.select("kind", "normal", "core")
        state = judged.select("kind", "normal", F.when(F.col("again"), turn).otherwise(F.col("attempt")).alias("attempt"))
    raise RuntimeError(f"too few free replacements: {', '.join(f'{r.n} of kind {r.kind}' for r in clashing)}")


def _names(texts: DataFrame) -> DataFrame:
    """_key, part and kind of each part of a titled name in each text, once: a last name before a first name, a known gender before none.

    A first name that has titles without gender here takes the one gender that it has elsewhere in the table, if there is just one.
    """
    parts = texts.select("_key", F.explode("persons").alias("match")).select("_key", F.explode(name_parts(F.col("match"))).alias("p")).select("_key", "p.part", "p.kind")
    parts = written(parts.groupBy("_key", "part").agg(F.min("kind").alias("kind")), "names")
    both = parts.groupBy("part").agg(F.max(F.col("kind") == "person_f").alias("f"), F.max(F.col("kind") == "person_m").alias("m"))
    known = written(both.filter("f <> m").select("part", F.when(F.col("f"), "person_f").otherwise("person_m").alias("gender")), "genders")
    kind = F.when(F.col("kind") == "person_n", F.coalesce("gender", "kind")).otherwise(F.col("kind"))
    return written(parts.join(known, "part", "left").select("_key", "part", kind.alias("kind")), "names")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Every row as ``row`` with ``new_text`` and ``n_replaced`` (mentions; the parts of one name are one).

    Null texts stay null and empty ones empty, with 0 replaced. An empty table stays empty. Rows without a match never leave their partition; those
    with one are written with their matches. Rows of equal texts share these, so copies cost one lookup. A text's matches are joined as rows and
    come back in their order, so very long texts with very many entities take no more than their own size; an entity
    in very many texts is a hot key of two written tables, which Spark splits. Columns of any name stay inside ``row``.

    Initials stay, and so do names that nothing introduces anywhere in their text: no title, "my name is", signature, field or head of a letter. E-mail addresses of more than 128 labels, or labels of more than 63 letters, are none.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    has = holds_entity(F.col("_text"))
    clean = keyed.filter(~has).select("row", F.col("_text").alias("new_text"), F.lit(0).cast("long").alias("n_replaced"))
    every = lambda pattern: F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    found = keyed.filter(has).withColumn("_named", holds_name(F.col("_text")))
    found = found.select(
        "row",
        "_named",
        F.md5(F.col("_text").cast("binary")).alias("_key"),
        F.when(F.col("_named"), every(RICH)).otherwise(every(PATTERN)).alias("_hits"),
        F.when(F.col("_named"), every(PERSON)).alias("_persons"),
    )
    found = written(found, "found")
    texts = written(found.groupBy("_key").agg(F.first("_hits").alias("hits"), F.first("_persons").alias("persons")), "matches")
    names = _names(texts)
    hits = texts.select("_key", F.posexplode("hits").alias("at", "match")).withColumn("kind", kind_of(F.col("match")))
    hits = hits.withColumn("normal", normal_form(F.col("kind"), F.col("match")))
    words = hits.filter("kind = 'word'").drop("kind").join(names.withColumnRenamed("part", "normal"), ["_key", "normal"], "left")
    columns = ["_key", "at", "match", "kind", "normal"]
    hits = written(hits.filter("kind IS NULL OR kind <> 'word'").select(columns).unionByName(words.select(columns)), "hits")
    cores = written(surrogates(hits.filter("kind IS NOT NULL").select("kind", "normal").distinct(), key), "cores")
    filled = hits.join(cores, ["kind", "normal"], "left").select("_key", "at", written_like(F.col("kind"), F.col("match"), F.col("core")).alias("new"), F.col("kind").startswith("person").alias("name"))
    news = filled.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "new", "name"))).alias("_new"))  # no more than the text's own matches
    news = written(news.withColumnRenamed("_key", "_of"), "new")
    joined = found.join(news, F.col("_key") == F.col("_of"), "left")
    gaps = F.when(F.col("_named"), F.split("row.text", RICH, -1)).otherwise(F.split("row.text", PATTERN, -1))
    joined = joined.select("row", F.col("_hits").alias("_old"), "_new", gaps.alias("_gaps"))
    parts = F.zip_with("_gaps", F.zip_with("_old", "_new", lambda old, new: F.coalesce(new["new"], old)), lambda gap, hit: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(hit, F.lit(""))))

    def begins(x: Column, i: Column) -> Column:
        before = F.get(F.col("_new"), i - 1)
        same = F.coalesce(x["name"] & before["name"] & before["new"].isNotNull(), F.lit(False)) & F.get(F.col("_gaps"), i).rlike(r"^(?: (?:\p{L}\. ?){0,4}|[-'’])$")  # initials join
        return x["new"].isNotNull() & ~same

    rebuilt = joined.select("row", F.array_join(parts, "").alias("new_text"), F.size(F.filter("_new", begins)).cast("long").alias("n_replaced"))
    return clean.unionByName(rebuilt)
