"""Operator 9, personal data: detected entities get keyed surrogates of their type.

One regular expression finds e-mail addresses, secrets (keys of services, values after words
such as ``password=``, private key blocks), IP addresses, account, card and phone numbers,
and names after a form of address: up to four parts with initials, particles, apostrophes
and capitals. A mention is taken apart into bare entities: the digits of a number without its
separators, an address in lower case, the given and family names without the form of
address. What such a name is called elsewhere in its text, without a form of address, is
replaced as well. Every bare entity of the corpus gets
one surrogate everywhere (coreference), drawn from a keyed digest, and each mention is
written with it in the mention's own format. So ``Mr Smith`` and ``Mr. Smith``, or a number
with spaces and with hyphens, stay the same person and the same number.

A surrogate keeps type, script, gender and format: digits stay digits and letters letters
of their script, a card number keeps its check sum and an account number a valid one, a
phone number keeps its country code, an octet its range, a reserved domain stays what it is,
a given name after a female or male form of address becomes a name of that gender in its
script, and a family name keeps its length and an ending that tells gender. Surrogates are checked against each other and against all entities of the corpus;
those that collide are drawn again until none does (distinctness). Formats of a fixed length
are drawn from their own space; if that is full, the job fails and says so.

All of it is SQL functions and joins. What is joined are entities, a small part of the
corpus; only rows with an entity are written and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, salted_join

#: Forms of address by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Frau", "Sra", "Srta", "Señora", "Señorita", "Signora", "Г-жа", "Госпожа", "Κα", "Κυρία")
MALE = ("Mr", "Herr", "Sr", "Señor", "Signor", "Г-н", "Господин", "Κος", "Κύριος")
OPEN = ("Dr", "Prof")
#: Beginnings that all forms of address have.
BEGINNINGS = ("Mr", "MR", "Ms", "MS", "Mis", "MIS", "Mme", "Mlle", "Frau", "FRAU", "Sr", "Señor", "Signor", "Г-", "Госп", "Κ", "Herr", "HERR", "Dr", "DR", "Prof", "PROF")
#: Particles of names, and words before the values of secrets.
PARTICLES = ("von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "bin", "al", "el", "af", "av")
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "api[_\\-]?key", "access[_\\-]?key", "secret[_\\-]?key", "auth[_\\-]?token", "access[_\\-]?token", "token")
#: Surrogate given names by gender and script.
NAMES = {
    ("f", "latin"): ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hilda", "Irma", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Konrad", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Тамара", "Юлия"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Ηλέκτρα", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Όλγα", "Ρένα", "Σοφία", "Χρυσή"),
    ("m", "greek"): ("Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Ιάσονας", "Κώστας", "Λουκάς", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Τάσος", "Φίλιππος", "Χρήστος"),
}
#: Syllables and endings of longer given names; letters of surrogates.
SYLLABLES = {"latin": ("la", "ri", "mo", "ne", "ta", "vi", "do", "su"), "cyrillic": ("ла", "ри", "мо", "не", "та", "ви", "до", "су"), "greek": ("λα", "ρι", "μο", "νε", "τα", "βι", "δο", "σου")}
ENDINGS = {("f", "latin"): "na", ("m", "latin"): "n", ("f", "cyrillic"): "на", ("m", "cyrillic"): "н", ("f", "greek"): "να", ("m", "greek"): "νος"}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
DIGITS, HEX = "0123456789", "abcdef"
#: Consonants and vowels of family names, and the endings that they keep, which
#: tell gender in some languages.
SOUNDS = {"latin": ("bdfghklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфх", "аеиоу"), "greek": ("βγδζκλμνπρστφχ", "αεηιου")}
KEPT = {"latin": "(?:son|sen|mann|ez|ini|ova|ska|ski)$", "cyrillic": "(?:ова|ева|ёва|ина|ая|ов|ев|ёв|ин|ий|ый|ой)$", "greek": "(?:ου|ης|ος|ας)$"}
_TITLE = "|".join(sorted({x for t in (*FEMALE, *MALE, *OPEN) for x in ((t, t.upper()) if t.isascii() else (t,))}, key=lambda t: (-len(t), t)))
#: A part of a name: with an apostrophe, a second capital or hyphens, or in capitals; initials
#: and particles stand before one.
_PART = r"(?:(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)*|\p{Lu}{2,}(?:['’\-]\p{Lu}{2,})*)"
_PARTICLE, _INITIAL = "(?:(?:" + "|".join(PARTICLES) + ")[ ])", r"\p{Lu}\."
_PEM = "PRIVATE KEY(?: BLOCK)?-----"
_SECRET = rf"(?i:{'|'.join(SECRET_WORDS)})[\"']?[ ]?(?:=|:(?=[ \"']{{0,2}}[^\s\"',;<>]*[0-9]))[ ]?[\"']?"
#: How keys of services begin.
_TOKEN = r"AKIA|ASIA|sk-|gh[pousr]_|xox[abprs]-|eyJ"
#: In this order. All begin after a character that is no letter and no digit.
KINDS = {
    "pem": rf"-----BEGIN [A-Z ]*{_PEM}[A-Za-z0-9+/=\s:,.\-]*?-----END [A-Z ]*{_PEM}",
    "secret": rf"{_SECRET}[^\s\"',;<>&]{{6,}}",
    "email": r"[\p{L}\p{N}_%+.\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "hex": r"(?=[A-Fa-f]*[0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])",
    "token": rf"(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|sk-[A-Za-z0-9_\-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|xox[abprs]-[A-Za-z0-9\-]{{10,}}|eyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}})(?![A-Za-z0-9])",
    "ip6": r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<!\.)(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<!\+)\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<!-)[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])|(?<![.\-/])(?=0(?:[ \-/]?[0-9]){8,12}(?![0-9]))0[0-9]{1,4}(?:[ \-/][0-9]{2,8}){1,4}(?![0-9\-/])",
    "card": r"(?<![.\-])[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![0-9A-Za-z\-])|(?<![.\-])[0-9]{4}(?:[ \-]?[0-9]{4}){2}(?:[ \-]?[0-9]{1,7})(?![0-9A-Za-z\-])|(?<![.\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "name": rf"(?:{_TITLE})\.?[ ]{_PARTICLE}*(?:(?:{_INITIAL}|{_PART})[ ]{_PARTICLE}*){{0,3}}{_PART}(?![\p{{L}}])",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{x})" for x in KINDS.values()) + ")"


def hinted(text: Column) -> Column:
    """What every text with an entity fulfils; cheap tests before the pattern: a digit, a sign
    of an address, or the beginning of a form of address or of a key. False for null."""
    hint = text.rlike("[0-9@=]")
    for mark in (*BEGINNINGS, "sk-", "xox", "eyJ", "-----BEGIN"):
        hint = hint | text.contains(mark)
    return F.coalesce(hint, F.lit(False))


def found(text: Column) -> Column:
    """The mentions of a text in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The type of a mention that :func:`found` gave."""
    m = F.when(mention.startswith("-----BEGIN"), "pem").when(mention.rlike(rf"^{_SECRET}"), "secret").when(mention.contains("@"), "email")
    m = m.when(mention.rlike(r"^[A-Fa-f0-9]{32,64}$") & mention.rlike("[0-9]"), "hex")
    m = m.when(mention.rlike(rf"^(?:{_TOKEN})"), "token").when(mention.contains(":"), "ip6")
    m = m.when(mention.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(mention.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
    m = m.when(mention.rlike(r"^0[0-9]{1,4}[ \-/]") & ~mention.rlike(r"^[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}"), "phone")
    m = m.when(mention.rlike(r"^[0-9]{4}(?:[ \-]?[0-9]{4}[ \-]?[0-9]{4}|[ \-][0-9]{6}[ \-][0-9]{5}$)"), "card").when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "number")
    return m.when(mention.rlike(r"^[+(0-9]"), "phone").otherwise("name")


def bare(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, r"[^A-Za-z0-9]", "")


_TITLED = rf"^(?:{_TITLE})\.?[ ]"


def parts_of(mention: Column) -> Column:
    """The words after a form of address."""
    return F.split(F.regexp_replace(mention, _TITLED, ""), " ")


def is_name(part: Column) -> Column:
    """Whether a word is a name, not a particle or an initial."""
    return ~part.isin(*PARTICLES) & ~part.rlike(rf"^{_INITIAL}$")


def atoms(mention: Column, kind: Column) -> Column:
    """The bare entities of a mention, as an array of (kind, norm, gender): one, or given
    names and a family name, which is the last. A single name is a family name."""
    one = lambda k, n, g=F.lit(None).cast("string"): F.struct(k.alias("kind"), n.alias("norm"), g.alias("gender"))
    low = F.lower(mention)
    # Numbers without a country code have the formats of code 1.
    phone = F.concat(F.when(mention.startswith("+"), "").otherwise("1"), bare(mention))
    norm = F.when(kind.isin("email", "hex", "ip6"), low).when(kind == "phone", phone).when(kind.isin("iban", "card", "number"), bare(mention)).when(kind == "secret", F.regexp_replace(mention, rf"^{_SECRET}", "")).otherwise(mention)
    title = F.lower(F.regexp_replace(F.regexp_extract(mention, _TITLED, 0), r"[. ]", ""))
    gender = F.when(title.isin(*map(str.lower, FEMALE)), "f").when(title.isin(*map(str.lower, MALE)), "m")
    own = F.filter(parts_of(mention), is_name)
    last = F.size(own) - 1
    names = F.transform(own, lambda x, i: one(F.when(i == last, "family").otherwise("given"), F.lower(x), F.when(i < last, gender)))
    return F.when(kind == "name", names).otherwise(F.array(one(kind, norm)))


def _draw(salted: Column, place: Column, n: int) -> Column:
    """A number from 0 to n - 1, from the keyed digest of an entity and a place."""
    return F.pmod(F.xxhash64(salted, place), F.lit(n)).cast("int")


def _pick(letters: str | tuple, salted: Column, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, letters)), _draw(salted, place, len(letters)) + 1)


def _syllables(choice: tuple, salted: Column, n: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_join(F.transform(places, lambda i: _pick(choice, salted, i)), "")


def _chars(entity: Column, salted: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit by a keyed one of its script and case; the rest stays. The
    first character never becomes 0."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substr(F.lit(letters), _draw(salted, i, len(letters)) + 1, F.lit(1))
        digit = F.when(i == 0, pick("123456789")).otherwise(pick(DIGITS))
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), pick(GREEK)).otherwise(pick(HEX if hexadecimal else LATIN))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def luhn(number: Column) -> Column:
    """The check sum of a number's digits, modulo 10; 0 for a valid card number."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    value = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def mod97(account: Column) -> Column:
    """The check of an account number: 1 for a valid one. The first four characters count
    last, letters as numbers from 10."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c == "", a).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def country_code(digits: Column) -> Column:
    """The country code that a phone number's digits begin with: one digit for 1 and 7, two
    for the codes that are so long, else three."""
    two = r"^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
    return F.when(digits.rlike("^[17]"), F.substr(digits, F.lit(1), F.lit(1))).when(digits.rlike(two), F.substr(digits, F.lit(1), F.lit(2))).otherwise(F.substr(digits, F.lit(1), F.lit(3)))


def surrogate(norm: Column, kind: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate that a bare entity draws at an attempt."""
    salted = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, F.coalesce(gender, F.lit("")), attempt.cast("string")), 256)
    plain = _chars(norm, salted)
    domain = F.substring_index(norm, "@", -1)
    # The registered part of a domain and its ending stay where they are reserved names.
    reserved = domain.rlike(r"(?i)(^|\.)example\.(com|org|net)$")
    tail = F.regexp_extract(domain, r"((?:\.|^)[^.]+\.[A-Za-z]{2,})$", 1)
    head = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    named = F.when(F.length(head) > 0, _chars(head, F.concat(salted, F.lit("d")))).otherwise("")
    end = F.when(reserved, tail).otherwise(F.concat(F.when(tail.startswith("."), ".").otherwise(""), F.lit("example.org")))
    email = F.concat(_chars(F.substring_index(norm, "@", 1), salted), F.lit("@"), named, end)
    ip = F.concat_ws(".", *[F.pmod(F.xxhash64(salted, F.lit(k)), F.lit(254)) + 1 for k in range(4)])
    # A card's last digit makes the check sum what it was.
    off = F.pmod(F.substr(plain, F.length(plain), F.lit(1)).cast("int") + luhn(norm) - luhn(plain), F.lit(10))
    card = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), off.cast("string"))
    # An account number keeps its country and gets the check digits of the rest.
    rest = _chars(F.substr(norm, F.lit(5)), salted)
    country = F.substr(norm, F.lit(1), F.lit(2))
    check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    lead = country_code(norm)
    local = F.substr(norm, F.length(lead) + 1)
    phone = F.concat(lead, F.when(local.startswith("0"), F.concat(F.lit("0"), _chars(F.substr(local, F.lit(2)), salted))).otherwise(_chars(local, salted)))
    fence = F.regexp_extract(norm, rf"^(-----BEGIN [A-Z ]*{_PEM})", 1)
    foot = F.regexp_extract(norm, rf"(-----END [A-Z ]*{_PEM})$", 1)
    pem = F.concat(fence, _chars(F.substr(norm, F.length(fence) + 1, F.length(norm) - F.length(fence) - F.length(foot)), salted), foot)
    start = F.regexp_extract(norm, rf"^(?:{_TOKEN})", 0)
    token = F.concat(start, _chars(F.substr(norm, F.length(start) + 1), salted))
    # Given names: a plain one first, longer ones where that is taken.
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    given = F.lit("")
    for (g, s), names in NAMES.items():
        more = _syllables(SYLLABLES[s], salted, attempt)
        own = _pick(names, salted, F.lit(-1))
        given = F.when((gender == g) & (script == s), F.when(attempt == 0, own).otherwise(F.concat(own, more, F.lit(ENDINGS[g, s])))).otherwise(given)
    made = F.when(kind == "email", email).when(kind.isin("hex", "ip6"), _chars(norm, salted, True)).when(kind == "token", token).when(kind == "ip", ip)
    made = made.when(kind == "pem", pem).when(kind == "iban", F.concat(country, check, rest)).when(kind == "card", card).when(kind == "number", plain).when(kind == "phone", phone)
    return made.when(kind == "given", F.lower(given)).when(kind == "family", family(norm, script, salted, attempt)).otherwise(plain)


def family(norm: Column, script: Column, salted: Column, attempt: Column) -> Column:
    """A family name of as many parts and letters as ``norm`` has: consonants and vowels in
    turn before the ending, which stays. It grows where those of its length are taken."""

    def sound(hard: str, soft: str, own: Column):
        return lambda i: F.when(i % 2 == 0, _pick(tuple(hard), own, i)).otherwise(_pick(tuple(soft), own, i))

    def part(p: Column, k: Column) -> Column:
        own = F.concat(salted, k.cast("string"))
        before = F.regexp_extract(p, r"^(\p{L}['’])", 1)
        out = F.lit("")
        for s, (hard, soft) in SOUNDS.items():
            end = F.when(F.length(p) > 5, F.regexp_extract(p, KEPT[s], 0)).otherwise("")
            n = F.greatest(F.length(p) - F.length(before) - F.length(end), F.lit(1)) + 2 * F.greatest(attempt - 3, F.lit(0))
            sounds = F.transform(F.sequence(F.lit(0), n - 1), sound(hard, soft, own))
            out = F.when(script == s, F.concat(F.array_join(sounds, ""), end)).otherwise(out)
        return F.concat(F.when(before != "", _chars(before, own)).otherwise(""), out)

    return F.array_join(F.transform(F.split(norm, "-"), part), "-")


def surrogates(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(norm, kind, gender, surrogate) for distinct (norm, kind, gender): surrogates differ
    from each other and from every entity of their kind. Of those that draw the same one the
    smallest entity keeps it, the others draw again; a surrogate that is an entity itself is
    drawn again. Raises an error where a format's space has no room."""
    known = cut(entities.select("norm", "kind", F.coalesce("gender", F.lit("")).alias("gender")).distinct())
    now = cut(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("norm"), F.col("kind"), F.col("gender"), F.lit(0), key)))
    real = known.select("kind", F.col("norm").alias("surrogate")).distinct().withColumn("is_entity", F.lit(True))
    who = F.struct("norm", "gender")
    for _ in range(rounds):
        rivals = now.groupBy("kind", "surrogate").agg(F.min(who).alias("owner"), F.count("*").alias("n"))
        bad = cut(rivals.join(real, ["kind", "surrogate"], "left").where((F.col("n") > 1) | F.col("is_entity")).withColumn("is_entity", F.coalesce("is_entity", F.lit(False))))
        if bad.isEmpty():
            drop(bad)
            return now.select("norm", "kind", "gender", "surrogate")
        again = salted_join(now, bad.drop("n"), ["kind", "surrogate"], bad.select("kind", "surrogate", "n"), ["norm"], "left")
        redo = F.coalesce(F.col("is_entity") | (F.col("owner") != who), F.lit(False))
        attempt = F.col("attempt") + F.when(redo, 1).otherwise(0)
        fresh = surrogate(F.col("norm"), F.col("kind"), F.col("gender"), attempt, key)
        new = cut(again.select("norm", "kind", "gender", attempt.alias("attempt"), F.when(redo, fresh).otherwise(F.col("surrogate")).alias("surrogate")))
        drop(now)
        drop(bad)
        now = new
    full = [r["kind"] for r in now.where(F.col("attempt") >= rounds // 2).select("kind").distinct().limit(20).collect()]
    raise RuntimeError(f"no free surrogates left for kinds {full}")


def capital(name: Column) -> Column:
    """A name with capitals at its start and after hyphens and apostrophes."""
    pieces = F.split(name, r"(?<=[\-'’])")
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def cased(name: Column, like: Column) -> Column:
    """A name in capitals, or with capitals at its starts, like another."""
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(capital(name))


def written(mention: Column, kind: Column, made: Column, key: str) -> Column:
    """A mention with its surrogates ``made`` (an array) in its own format. Particles stay,
    initials become keyed ones."""
    first = F.element_at(made, 1)
    shout = (mention == F.upper(mention)) & (mention != F.lower(mention))
    # A number's characters come into the places of the mention's, from the right.
    size = F.length(bare(mention))
    source = F.substr(first, F.length(first) - size + 1)
    place = lambda i: F.length(bare(F.substr(mention, F.lit(1), i + 1)))
    number = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(source, place(i), F.lit(1))).otherwise(c)), "")
    parts = parts_of(mention)
    turn = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), is_name)) - 1
    initial = lambda t: F.concat(F.upper(_chars(F.lower(F.substr(t, F.lit(1), F.lit(1))), F.sha2(F.concat(F.lit(f"{key}\u0001initial\u0001"), t), 256))), F.lit("."))
    each = F.transform(parts, lambda t, i: F.when(is_name(t), cased(F.get(made, turn(i)), t)).when(t.isin(*PARTICLES), t).otherwise(initial(t)))
    name = F.concat(F.regexp_extract(mention, _TITLED, 0), F.array_join(each, " "))
    secret = F.concat(F.regexp_extract(mention, rf"^{_SECRET}", 0), first)
    return F.when(kind == "name", name).when(kind == "secret", secret).when(kind.isin("iban", "phone", "card", "number"), number).when(kind.isin("email", "hex", "ip6") & shout, F.upper(first)).otherwise(first)


#: A word that stands for a name, and what stands for it.
_ALIASES = "array<struct<size:int,word:string,shown:string>>"


def aliases(mention: Column, kind: Column, made: Column) -> Column:
    """The forms in which the names of a mention can stand alone: as they are, with capitals
    at their starts, and in capitals; (-length, form, surrogate in that form)."""
    entry = lambda w, s: F.struct((-F.length(w)).alias("size"), w.alias("word"), s.alias("shown"))
    forms = F.zip_with(F.filter(parts_of(mention), is_name), made, lambda t, m: F.array(entry(t, cased(m, t)), entry(capital(F.lower(t)), capital(m)), entry(F.upper(t), F.upper(m))))
    return F.when(kind == "name", F.flatten(forms)).otherwise(F.array().cast(_ALIASES))


def without_names(text: Column, names: Column) -> Column:
    """``text`` with the words ``names`` (sorted, the longest first) replaced. Marks of private
    use stand for them meanwhile, so that no surrogate is taken for a name."""
    mark = lambda i: F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001"))
    places = F.sequence(F.lit(0), F.size(names) - 1)
    pattern = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["word"], F.lit(r"\E(?![\p{L}\p{N}])"))
    marked = F.aggregate(places, text, lambda t, i: F.regexp_replace(t, pattern(F.get(names, i)), mark(i)))
    shown = F.aggregate(places, marked, lambda t, i: F.replace(t, mark(i), F.get(names, i)["shown"]))
    return F.when(F.size(names) > 0, shown).otherwise(text)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, shown, aliases) for distinct mentions. A given name after a form of address that
    tells no gender has the gender that the corpus shows for it, else a keyed one."""
    kinds = mentions.select("mention").withColumn("form", kind_of(F.col("mention")))
    each = cut(kinds.select("mention", "form", F.posexplode(atoms(F.col("mention"), F.col("form"))).alias("pos", "a")).select("mention", "form", "pos", "a.kind", "a.norm", "a.gender"))
    given = each.where("kind = 'given'")
    coin = F.when(F.pmod(F.xxhash64(F.lit(key), "norm"), F.lit(2)) == 0, "f").otherwise("m")
    told = given.groupBy("norm").agg(F.min("gender").alias("told")).select("norm", F.lit("given").alias("kind"), F.coalesce("told", coin).alias("told"))
    each = each.join(told, ["norm", "kind"], "left").withColumn("gender", F.coalesce("gender", "told", F.lit(""))).drop("told")
    each = cut(each)
    made = surrogates(each.select("norm", "kind", "gender"), key)
    counts = each.groupBy("norm", "kind", "gender").agg(F.count("*").alias("n"))
    got = salted_join(each, made, ["norm", "kind", "gender"], counts, ["mention"])
    got = got.groupBy("mention", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x["surrogate"]).alias("made"))
    m, form, made = F.col("mention"), F.col("form"), F.col("made")
    return got.select("mention", written(m, form, made, key).alias("shown"), aliases(m, form, made).alias("aliases"))


def pseudonymise(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of entities in a column ``count``.

    ``key`` is the secret on which all surrogates hang; who has it can test guesses. Null and
    empty texts stay, with 0 entities. Equal entities get equal surrogates in all rows, so
    repeated rows stay equal. An address in capitals stays in capitals. Names that a text has
    after a form of address are replaced in all of that text, in the forms of :func:`aliases`. n_chars, where there
    is such a column, follows the text. An empty table gives an empty result; further columns
    go through unchanged, but for one named like ``count``, which gives way to it."""
    if not key:
        raise ValueError("surrogates need a key")
    cols = [c for c in docs.columns if count is None or c.lower() != count.lower()]
    kinds = dict(docs.dtypes)
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(cols)])
    text = f"_{next(i for i, c in sorted(enumerate(cols), key=lambda x: x[1] != 'text') if c.lower() == 'text')}"
    shown = lambda n: [F.length(text).cast(kinds[c]).alias(c) if c.lower() == "n_chars" else F.col(f"_{i}").alias(c) for i, c in enumerate(cols)] + ([n.cast("long").alias(count)] if count else [])
    as_they_are = lambda n: [F.col(f"_{i}").alias(c) for i, c in enumerate(cols)] + ([n.cast("long").alias(count)] if count else [])
    maybe = hinted(F.col(text))
    # Rows with mentions, a small part, are numbered and written.
    hit = own.where(maybe).withColumn("_e", found(F.col(text))).where(F.size("_e") > 0)
    hit = cut(hit.withColumn("_p", F.split(text, PATTERN, -1)).withColumn("_row", F.monotonically_increasing_id()))
    each = hit.select("_row", F.posexplode("_e").alias("pos", "mention"))
    mentions = cut(each.groupBy("mention").agg(F.count("*").alias("n")))
    table = cut(replacements(mentions, key))
    named = salted_join(each, table, ["mention"], mentions, ["_row", "pos"])
    named = named.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda p: p["shown"]).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("_n")
    )
    # A text is put together of its pieces with surrogates between them.
    whole = F.array_join(F.transform("_p", lambda p, i: F.concat(without_names(p, F.col("_n")), F.coalesce(F.get(F.col("_s"), i), F.lit("")))), "")
    done = hit.join(named, "_row").withColumn(text, whole).select(*shown(F.size("_e")))
    clean = own.where(~(maybe & F.coalesce(F.col(text).rlike(PATTERN), F.lit(False)))).select(*as_they_are(F.lit(0)))
    drop(mentions)
    return clean.unionByName(done)
