"""Personal data replaced by surrogates, in DataFrame and SQL functions alone.

Entities are found by patterns, brought to a canonical form, and each distinct one gets a surrogate of its type from
a keyed hash: same script, gender, letter case, punctuation and check digits, and the same shape where the type has
one. Distinct entities must keep distinct surrogates, and none may be another entity of the corpus; those that clash
get the next attempt's surrogate, whose space grows, until none clash. One entity has one surrogate everywhere.

Names are found after titles, and their words are the entities: "Mr. John Smith", "Mr. Smith" and "Dr. JOHN SMITH" share
the surrogate of Smith, and where a document has a name after a title, its words are replaced wherever else they
stand in that document with a capital. Initials are changed as the first letters of given names are. Names that no
document puts a title to are not found.

Only documents with entities are shuffled; the others pass by.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

#: From this attempt on, surrogates of a fixed shape are longer than their shape asks, each attempt by one digit: the shape's own space is nearly used up.
LONGER = 12

# Honorifics by gender and first and last names by script, all common.
HONORIFICS = {
    "m": "Mr|Herr|Señor|Monsieur|Signor|Господин|г-н".split("|"),
    "f": "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Mlle|Signora|Госпожа|г-жа".split("|"),
    "n": "Dr|Prof|Доктор|Профессор".split("|"),
}
FIRST = {
    "latin": {
        "m": "Adam Albert Andrew Anton Arthur Bruno Carl Charles Daniel David Edward Felix Frank George Henry Hugo Ivan James John Julian Karl Leon Lewis Lucas Mark Martin Max Michael Oliver Oscar Patrick Paul Peter Philip Robert Samuel Simon Thomas Victor William".split(),
        "f": "Ada Alice Amelia Anna Beatrice Bella Carla Charlotte Clara Diana Elena Elisa Emily Emma Eva Flora Grace Hannah Helen Ida Irene Isabel Jane Julia Karin Laura Lena Lucy Maria Martha Mia Nina Nora Olivia Paula Rosa Ruth Sarah Sofia Victoria".split(),
    },
    "cyrillic": {
        "m": "Александр Алексей Андрей Антон Борис Вадим Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Кирилл Максим Михаил Николай Олег Павел Сергей".split(),
        "f": "Алла Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    },
}
LAST = {
    "latin": "Abbott Baker Barnes Becker Bell Bennett Berger Blake Bradley Brandt Carter Clark Collins Cooper Costa Dawson Dixon Ellis Evans Fischer Fletcher Foster Garcia Gibson Grant Gray Hall Harris Hayes Hunt Jensen Keller Kelly Lambert Lang Marsh Mason Meyer Miller Moore Morris Murray Nash Owens Palmer Parker Perez Porter Price Reed Rossi Russell Sanders Schmidt Shaw Silva Stone Turner Vogel Walsh Ward Weber West Wood Young".split(),
    "cyrillic": "Бондаренко Гончаренко Черненко Шевченко Ткаченко Петренко Мельник Коваль Кравец Шульга Дорошенко Яценко Романенко Назаренко Марченко Савченко".split(),
}

#: Syllables of made-up names by script: consonants, vowels, ends by gender. Other scripts get Latin ones.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v z".split(), "a e i o u".split(), {"m": "n", "f": "na", "n": "ne", "l": "r"}),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), {"m": "н", "f": "на", "n": "не", "l": "р"}),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ".split(), "α ε η ι ο".split(), {"m": "ς", "f": "να", "n": "νι", "l": "ς"}),
    "armenian": ("բ գ դ զ թ կ հ մ ն պ ռ ս տ".split(), "ա ե ի ո".split(), {"m": "ն", "f": "նա", "n": "նի", "l": "ն"}),
}
PARTICLES = "van von der den de del della di da dos du la le bin ibn al el ter ten zu zur".split()
#: Country codes of telephone numbers: those of one and two digits; the others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

_WORD = r"\p{L}\p{N}._%+\-"
#: A word of a name, without the s of a possessive.
_NAME = r"\p{Lu}['’]?[\p{L}\p{M}]++(?:['’\-](?!s(?![\p{L}]))[\p{L}\p{M}]++)*+"
_TITLES = "|".join(t for g in HONORIFICS.values() for t in g)
#: A title, tried only where one of their first letters stands.
_TITLE = "(?=[" + "".join(sorted({t[0] for g in HONORIFICS.values() for t in g})) + f"])(?:{_TITLES})"
_LEAD = rf"(?:{_TITLE}\.? )+"
#: A word of a name with the initials and particles before it.
_STEP = rf"(?:\p{{Lu}}\. ?|(?:{'|'.join(PARTICLES)}) )*+{_NAME}"
#: Keys and tokens, of any length: what they begin with, and the rest.
SECRETS = {
    "hex": r"[0-9a-f]{32,}+|[0-9A-F]{32,}+",
    "access key": r"A[KS]IA[0-9A-Z]{16,}+",
    "code host": r"gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_\-]{20,}+",
    "service": r"sk-(?:[A-Za-z0-9]{20,}+(?![A-Za-z0-9_\-])|(?=[A-Za-z_\-]*+[0-9])[A-Za-z0-9_\-]{20,}+)|AIza[0-9A-Za-z_\-]{35,}+",
    "chat": r"xox[abeoprs]-(?=[A-Za-z\-]*+[0-9])[A-Za-z0-9\-]{10,}+",
    "web token": r"eyJ[A-Za-z0-9_\-]{10,}+\.eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+",
    "block": r"(?<!-)-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]++(?:-(?!----END )[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----",
}
#: What a surrogate key keeps of its begin and end.
_SECRET_HEAD = r"^(A[KS]IA|gh._|github_pat_|glpat-|sk-|AIza|xox.-|eyJ|-----BEGIN [A-Z0-9 ]*-----\s*)"
_SECRET_TAIL = r"(\s*-----END [A-Z0-9 ]*-----)$"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_WORD}])[{_WORD}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(SECRETS.values())})(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|(?=[A-Z]*\d)[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}\d)(?=(?:[0-9A-Fa-f]{0,4}:){3})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\1\d{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "number": r"(?<![\p{L}\p{N}.])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_LEAD}{_STEP}(?: {_STEP})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([.\-])\d{3}\1\d{4}", r"[.\-]\d{3}[.\-]\d{4}")
#: In documents with names after titles, also words that may be such names again.
ANY_OR_WORD = rf"{ANY}|(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
#: What every entity has; texts without it are not searched further.
HINT = rf"[0-9@]|sk-|gh[pousr]_|github_pat_|glpat-|AIza|A[KS]IA|eyJ|PRIVATE KEY|[A-Fa-f]{{32}}|{_TITLE}\.? \p{{Lu}}"


def kind(mention: Column) -> Column:
    """The type of a mention: the first pattern that it is whole; null for a word alone."""
    out = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        p = PATTERNS[name].replace(r"([.\-])\d{3}\1\d{4}", r"[.\-]\d{3}[.\-]\d{4}")
        out = F.when(mention.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def canonical(mention: Column, of: Column) -> Column:
    """One form for all mentions of an entity that is no name: digits of numbers, lower case of addresses and keys, one form for national and international phone numbers of country 1."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    code = F.regexp_extract(digits, f"^({COUNTRY})", 1)
    national = F.substr(digits, F.length(code) + 1, F.length(digits))
    abroad = F.when((code == "1") & (F.length(national) == 10), national).otherwise(F.concat(F.lit("+"), code, F.lit(" "), national))
    return (
        F.when(of.isin("number", "ssn"), digits)
        .when(of == "phone", F.when(mention.startswith("+"), abroad).otherwise(digits))
        .when(of == "iban", F.regexp_replace(mention, " ", ""))
        .when(of.isin("email", "ip6"), F.lower(mention))
        .when((of == "secret") & mention.rlike("^[0-9A-Fa-f]+$"), F.lower(mention))
        .otherwise(mention)
    )


def bare_name(mention: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(mention, rf"^{_LEAD}", "")


_PART = rf"{_NAME}|\p{{Lu}}\."
_STEM = r"^(\p{IsCyrillic}{2,}(?:ов|ев|ёв|ин|ын))а$"


def name_value(word: Column) -> Column:
    """The entity of a name's word: lower case, of Russian last names the form without the ending for women."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "’", "'"), _STEM, "$1")


def name_words(mention: Column) -> Column:
    """An array of (word, value, sex) of a name after a title. sex: m, f or n of given names, by the title or a list, l of the last name; null for initials."""
    words = F.regexp_extract_all(bare_name(mention), F.lit(_PART), F.lit(0))
    title = F.regexp_extract(mention, rf"^(?:(?:{_TITLE})\.? )*?({_TITLES})\.? (?!(?:{_TITLES})\.? )", 1)
    men, women = ([n.lower() for s in FIRST.values() for n in s[g]] for g in "mf")

    def one(word: Column, i: Column) -> Column:
        value = name_value(word)
        given = F.when(title.isin(HONORIFICS["m"]), "m").when(title.isin(HONORIFICS["f"]), "f").when(value.isin(men), "m").when(value.isin(women), "f").otherwise("n")
        sex = F.when(word.endswith("."), F.lit(None)).when(i == F.size(words) - 1, "l").otherwise(given)
        return F.struct(word.alias("word"), value.alias("value"), sex.alias("sex"))

    return F.transform(words, one)


def _stream(key: str, of: Column, value: Column, attempt: Column) -> Column:
    """256 hexadecimal digits from the key, the type, the entity and the attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), of, value, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")).cast("binary"), 256) for i in range(4)])


def _number(stream: Column, at: Column | int, below: int) -> Column:
    """A number under `below` from seven hexadecimal digits of the stream at place `at` (from 0, wrapping)."""
    start = (F.lit(at) if isinstance(at, int) else at) * 7 % 248 + 1
    return (F.conv(F.substr(stream, start, F.lit(7)), 16, 10).cast("long") % below).cast("int")


def _pick(stream: Column, at: int, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _number(stream, at, len(values)) + 1)


def _shaped(value: Column, stream: Column) -> Column:
    """A text of the same shape: digits for digits, lower- and upper-case letters for such of the same script, the rest as it is."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        letter = lambda letters: F.substr(F.lit(letters), _number(stream, i, len(letters)) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), letter("0123456789"))
            .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Lu}]$"), letter("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), letter("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"^[\p{IsGreek}&&\p{Lu}]$"), letter("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
            .when(c.rlike(r"^\p{IsGreek}$"), letter("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"^\p{Lu}$"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^\p{L}$"), letter("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def luhn(digits: Column) -> Column:
    """The sum of the Luhn rule over a digit string; a multiple of ten if its last digit checks."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda acc, x: acc + x)


def remainder97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capitals, these standing for 10 to 35."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(acc * 100 + F.instr(F.lit(letters), c) + 9) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def permuted(key: str, script: str) -> tuple[str, str]:
    """The letters of a script in lower and upper case, and what a name's first letter or an initial becomes: the next in a keyed ring of the letters, apart for those with listed names of both genders."""
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"}[script]
    names = FIRST.get(script, {"m": [], "f": []})
    common = {n[0].lower() for n in names["m"]} & {n[0].lower() for n in names["f"]}
    to = {}
    for part in ([c for c in letters if c in common], [c for c in letters if c not in common]):
        ring = sorted(part, key=lambda c: hashlib.sha256(f"{key}\x1finitial\x1f{c}".encode()).digest())
        to |= dict(zip(ring, ring[1:] + ring[:1], strict=True))  # none stays
    new = "".join(to[c] for c in letters)
    return letters + letters.upper(), new + new.upper()


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"\p{IsArmenian}"), "armenian").otherwise("latin")


def initial(key: str, letter: Column) -> Column:
    """What stands for an initial (or a name's first letter)."""
    out = letter
    for script in SOUNDS:
        out = F.translate(out, *permuted(key, script))
    return out


def name_surrogate(key: str, value: Column, sex: Column, attempt: Column, s: Column) -> Column:
    """A name's word, in lower case: from the lists at the first attempt, then made up of syllables, one more each attempt. Given names begin as `initial` says."""
    begin = initial(key, F.substring(value, 1, 1))
    out = F.lit(None).cast("string")
    for script, (consonants, vowels, ends) in SOUNDS.items():
        syllables = F.array(*[F.lit(c + v) for c in consonants for v in vowels])
        some = lambda n, syllables=syllables: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(syllables, _number(s, i + 2, len(consonants) * len(vowels)) + 1)), "")
        end = F.element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), sex)
        joint = F.when(begin.isin(vowels), F.lit("")).otherwise(_pick(s, 2, vowels))
        made_given = F.concat(begin, joint, some(attempt + 1), end)
        inflected = F.regexp_extract(value, "(ов|ев|ёв|ин|ын)$", 1)
        made_last = F.concat(some(attempt + 2), F.when(inflected != "", inflected).otherwise(end))
        names = FIRST.get(script, {"m": [], "f": []})
        by: dict[str, list[str]] = {}
        for g in "mf":
            for n in names[g]:
                for x in (g, "n"):
                    by.setdefault(x + n[0].lower(), []).append(n.lower())
        listed = F.lit(None).cast("array<string>")
        if by:
            listed = F.try_element_at(F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]), F.concat(sex, begin))
        given = F.when((attempt == 0) & listed.isNotNull(), F.element_at(listed, F.pmod(_number(s, 0, 1 << 20), F.greatest(F.size(listed), F.lit(1))) + 1)).otherwise(made_given)
        last = F.when((attempt == 0) & (inflected == ""), _pick(s, 1, [n.lower() for n in LAST[script]])).otherwise(made_last) if script in LAST else made_last
        out = F.when(_script(value) == script, F.when(sex == "l", last).otherwise(given)).otherwise(out)
    return out


def surrogate(key: str, of: Column, value: Column, sex: Column, attempt: Column) -> Column:
    """The surrogate, in canonical form, of a canonical entity at an attempt."""
    s = _stream(key, of, value, attempt)
    digit = F.when(value.startswith("0"), F.lit("0")).otherwise((1 + _number(s, 29, 9)).cast("string"))
    body = F.concat(digit, F.substr(_shaped(value, s), F.lit(2), F.length(value) - 2))
    check = F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10))
    valid = luhn(value) % 10 == 0
    number = F.concat(body, F.when(valid, check).otherwise((check + 1 + _number(s, 31, 9)) % 10).cast("string"))
    local = F.substring_index(value, "@", 1)
    domain = F.substring_index(value, "@", -1)
    of_domain = _stream(key, F.lit("domain"), domain, F.lit(0))
    top = F.when(domain.rlike(r"\.(?:com|org|net|edu|gov|info|[a-z]{2})$"), F.substring_index(domain, ".", -1)).otherwise(F.lit("com"))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: _number(s, i + 16, 10).cast("string")), "")
    email = F.concat(_shaped(local, s), F.when(attempt >= 3, F.concat(F.lit("."), more)).otherwise(F.lit("")), F.lit("@"), _shaped(F.lit("mailhost"), of_domain), F.lit(".example."), top)
    ip = F.concat_ws(".", (1 + _number(s, 0, 223)).cast("string"), *[_number(s, i, 256).cast("string") for i in (1, 2, 3)])
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    hexa = F.array_join(F.transform(chars(value), lambda c, i: F.when(c == ":", c).otherwise(F.substr(s, i % 256 + 1, F.lit(1)))), "")
    head, tail = F.regexp_extract(value, _SECRET_HEAD, 1), F.regexp_extract(value, _SECRET_TAIL, 1)
    inner = F.substr(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    secret = F.when(value.rlike("^[0-9a-f]+$"), hexa).otherwise(F.concat(head, _shaped(inner, s), tail))
    country, account = F.substring(value, 1, 2), _shaped(F.substr(value, F.lit(5), F.length(value)), s)
    right = 98 - remainder97(F.concat(account, country, F.lit("00")))
    checks = remainder97(F.concat(F.substr(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    iban = F.concat(country, F.lpad(F.when(checks, right).otherwise((right + 1 + _number(s, 31, 90)) % 97).cast("string"), 2, "0"), account)
    code, national = F.regexp_extract(value, r"^(\+\d+ )", 1), F.regexp_replace(value, r"^\+\d+ ", "")
    lead = F.when(national.startswith("0"), F.lit("0")).otherwise((1 + _number(s, 29, 9)).cast("string"))
    phone = F.concat(code, lead, F.substr(_shaped(national, s), F.lit(2), F.length(national)))
    shaped = F.when(of == "ip", ip).when(of == "ip6", hexa).when(of == "number", number).when(of == "secret", secret).when(of == "iban", iban).when(of == "phone", phone).otherwise(_shaped(value, s))
    longer = F.when(attempt >= LONGER, F.concat(F.lit("-"), F.substr(more, F.lit(1), attempt - LONGER + 1))).otherwise(F.lit(""))
    return F.when(of == "email", email).when(of == "name", name_surrogate(key, value, sex, attempt, s)).otherwise(F.concat(shaped, longer))


def dressed(mention: Column, of: Column, stand_in: Column) -> Column:
    """A canonical surrogate in the format of a mention that is no name: its separators, country code and letter case."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    code = F.when((of == "phone") & mention.startswith("+"), F.regexp_extract(F.regexp_replace(mention, r"[^0-9]", ""), f"^({COUNTRY})", 1)).otherwise(F.lit(""))
    plain = F.concat(code, F.when(of == "phone", F.regexp_replace(stand_in, r"^\+\d+ ", "")).otherwise(stand_in))
    empty = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))
    put = lambda acc, c: F.when(c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(acc["t"], F.substr(plain, acc["i"], F.lit(1))).alias("t"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["i"].alias("i")))
    done = F.aggregate(chars, empty, put)
    filled = F.concat(done["t"], F.substr(plain, done["i"], F.length(plain)))
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return F.when(of.isin("number", "phone", "ssn", "iban"), filled).when(of.isin("email", "secret", "ip6") & upper, F.upper(stand_in)).otherwise(stand_in)


def dressed_word(word: Column, value: Column, stand_in: Column) -> Column:
    """A name's surrogate in the case of a word, with the ending for women if the word has it."""
    whole = F.concat(stand_in, F.when(F.lower(word).rlike(_STEM) & ~value.rlike("а$"), F.lit("а")).otherwise(F.lit("")))
    upper = (word == F.upper(word)) & (F.length(word) > 1)
    return F.when(upper, F.upper(whole)).otherwise(F.concat(F.upper(F.substring(whole, 1, 1)), F.substr(whole, F.lit(2), F.length(whole))))


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of distinct entities (type, value, sex): distinct surrogates, none an entity itself.

    Round by round: of those that share a surrogate the least value keeps it, and one that is an entity of the corpus is
    dropped by its holder; losers take their next attempt. Each round is a grouped sum over (type, surrogate). As the
    space of surrogates grows from attempt to attempt, the rounds end.
    """
    now = written(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(key, F.col("type"), F.col("value"), F.col("sex"), F.lit(0))))
    while True:
        held = now.select("type", F.col("surrogate").alias("s"), F.col("value").alias("v"), F.lit(False).alias("real")).union(now.select("type", F.col("value").alias("s"), F.lit(None).cast("string").alias("v"), F.lit(True).alias("real")))
        clash = held.groupBy("type", "s").agg(F.count("v").alias("n"), F.min("v").alias("first"), F.max("real").alias("real")).filter("n > 1 or (n = 1 and real)")
        lost = now.join(clash.withColumnRenamed("s", "surrogate"), ["type", "surrogate"]).filter((F.col("value") != F.col("first")) | F.col("real"))
        lost = written(lost.select("type", "value", F.lit(True).alias("again")))
        if lost.isEmpty():
            return now.select("type", "value", "surrogate")
        step = now.join(lost, ["type", "value"], "left").withColumn("attempt", F.col("attempt") + F.col("again").isNotNull().cast("int"))
        now = written(step.select("type", "value", "sex", "attempt", F.when(F.col("again"), surrogate(key, F.col("type"), F.col("value"), F.col("sex"), F.col("attempt"))).otherwise(F.col("surrogate")).alias("surrogate")))


def entities_of(mentions: DataFrame) -> DataFrame:
    """(type, value, sex) of the distinct entities of mentions (mention, type): those that are no names, and the words of names. A word that is ever a given name is one."""
    plain = mentions.filter("type != 'name'").select("type", canonical(F.col("mention"), F.col("type")).alias("value"), F.lit("n").alias("sex")).distinct()
    words = mentions.filter("type = 'name'").select(F.explode(name_words(F.col("mention"))).alias("w")).filter("w.sex is not null")
    n = lambda sex: F.sum((F.col("w.sex") == sex).cast("long"))
    sex = F.when(n("m") > n("f"), "m").when(n("f") > 0, "f").when(n("n") > 0, "n").otherwise("l")
    return plain.union(words.groupBy("w.value").agg(sex.alias("sex")).select(F.lit("name").alias("type"), "value", "sex"))


def stand_ins(mentions: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(mention, stand_in) of mentions (mention, type), from the entities' surrogates (type, value, surrogate). Type null: a name's word alone."""
    plain = mentions.filter("type != 'name'").withColumn("value", canonical(F.col("mention"), F.col("type"))).join(table, ["type", "value"])
    plain = plain.select("mention", dressed(F.col("mention"), F.col("type"), F.col("surrogate")).alias("stand_in"))
    names = table.filter("type = 'name'").select("value", "surrogate")
    alone = mentions.filter("type is null").withColumn("value", name_value(F.col("mention"))).join(names, "value")
    alone = alone.select("mention", dressed_word(F.col("mention"), F.col("value"), F.col("surrogate")).alias("stand_in"))
    words = mentions.filter("type = 'name'").select("mention", F.posexplode(name_words(F.col("mention"))).alias("at", "w")).select("mention", "at", "w.word", "w.value")
    met = words.join(names, "value", "left")
    new = F.when(F.col("word").endswith("."), F.concat(initial(key, F.substring("word", 1, 1)), F.lit("."))).otherwise(dressed_word(F.col("word"), F.col("value"), F.col("surrogate")))
    lists = met.withColumn("new", new).groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    rest = bare_name(F.col("mention"))
    title = F.substr(F.col("mention"), F.lit(1), F.length("mention") - F.length(rest))
    return plain.union(alone).union(lists.select("mention", F.concat(title, _filled(F.split(rest, _PART, -1), F.col("new"))).alias("stand_in")))


def _filled(gaps: Column, new: Column) -> Column:
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(new, i + 1), F.lit("")))), "")


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with surrogates for the personal data in `text`; with `count`, a column of how many mentions were replaced.

    Other columns are untouched. Null and empty texts stay; repeated rows get equal results; an empty table stays
    empty. The same key gives the same surrogates while the set of entities in the table stays the same.
    """
    docs = docs.drop(*[c for c in ("__found", "__row", "__named", count) if c and c in docs.columns])
    body = F.col(f"`{text}`")
    named = body.rlike(PATTERNS["name"])
    all_of = lambda p: F.regexp_extract_all(body, F.lit(p), F.lit(0))
    found = docs.withColumn("__named", F.coalesce(named, F.lit(False)))
    found = found.withColumn("__found", F.when(body.rlike(HINT), F.when(F.col("__named"), all_of(ANY_OR_WORD)).otherwise(all_of(ANY))).otherwise(F.array().cast("array<string>")))
    without = found.filter(F.coalesce(F.size("__found") <= 0, F.lit(True)))
    marked = written(found.filter(F.size("__found") > 0).withColumn("__row", F.monotonically_increasing_id()))
    mentions = written(marked.select(F.explode("__found").alias("mention")).distinct().withColumn("type", kind(F.col("mention"))))
    table = assigned(entities_of(mentions), key)
    new = written(stand_ins(mentions, table, key).join(mentions, "mention").select("mention", "stand_in", "type"))
    each = written(marked.select("__row", F.posexplode("__found").alias("at", "mention")).join(new, "mention", "left"))
    # A word alone is replaced if a name after a title has it in the same document.
    own = each.filter("type = 'name'").select("__row", F.explode(name_words(F.col("mention"))).alias("w")).filter("w.sex is not null").select("__row", F.col("w.value").alias("__value"), F.lit(True).alias("own")).distinct()
    each = each.withColumn("__value", F.when(F.col("type").isNull(), name_value(F.col("mention")))).join(own, ["__row", "__value"], "left")
    each = each.withColumn("new", F.when(F.col("type").isNotNull() | F.col("own"), F.col("stand_in")))
    put = F.struct("at", F.coalesce("new", "mention").alias("new"))
    lists = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(put)), lambda x: x["new"]).alias("__new"), F.count("new").alias("__n"))
    gaps = F.when(F.col("__named"), F.split(body, ANY_OR_WORD, -1)).otherwise(F.split(body, ANY, -1))
    given = [c for c in docs.columns if c != text]
    extra = lambda n: [n.cast("long").alias(count)] if count else []
    replaced = marked.join(lists, "__row").select(*[F.col(f"`{c}`") for c in given], _filled(gaps, F.col("__new")).alias(text), *extra(F.col("__n")))
    plain = without.select(*[F.col(f"`{c}`") for c in given], body.alias(text), *extra(F.lit(0)))
    return plain.union(replaced).select(*[F.col(f"`{c}`") for c in docs.columns], *([count] if count else []))
