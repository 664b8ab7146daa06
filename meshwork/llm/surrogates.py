"""PII surrogates: detected entities get keyed replacements of the same type, and keep their format.

Types: e-mail addresses, IPv4 and IPv6 addresses, payment card, phone and passport numbers, social security numbers, IBANs,
dates of birth, street addresses, secrets (values named token, secret, password, API key; tokens and private keys of known form; long hexadecimal
strings, however long), and names after a title or a phrase such as "my name is"; once a document has a name, its parts alone are entities there too.  An entity's canonical form (lower case for e-mail, digits for numbers, what follows the
words that name it) is replaced by one that a keyed hash chooses: digits by digits, letters by letters of the same case and
script, the rest as it was.  A phone number keeps its country code; a card its first digit and an IBAN its country, and both
whether their checks hold; an address its kind of street; a name its script and the gender that its title says
(after neutral titles: that of its ending).  Each mention is then written in the mention's own format.

Equal entities get equal surrogates in all documents (coreference), different ones different surrogates (distinctness).  A name's parts are
entities of their own, so that a person keeps the surname with and without a given name or a title.  Where a part is both a given name and a surname
in a document, it stands alone as the given name; particles such as "von" stay.
Surrogates are compared over the whole corpus, with each other and with the real entities; those that collide are chosen anew.
Each attempt has more to choose from than the one before: names grow by syllables, all others get a tail from attempt TRIES on, of 8
hexadecimal digits more each time.  So a type whose form has too few values (addresses a@b.com) ends as well.  What has neither a letter nor a digit is no entity.
Only entities are shuffled for that; texts are only in documents with entities.

Everything is DataFrame expressions.  Defined results: a null text stays null and has no entities; rows that repeat a
doc_id and its text get equal results; other columns pass through, whatever their names; an empty table stays empty; of
entities that want the same surrogate the least canonical form has it, the others try again.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, written

TRIES, KEY = 4, "spark.meshwork.surrogates.key"

# Titles by gender, and what comes before a name otherwise
MALE = ("Mr", "Sir", "Herr", "Señor", "Sr", "Don", "Monsieur", "M", "Господин", "Г-н", "Κύριος", "Κος", "السيد")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа", "Г-жа", "Κυρία", "Κα", "السيدة", "الآنسة")
NEUTRAL = ("Dr", "Prof", "Professor", "Professorin", "Dra", "Доктор", "Δρ", "الدكتور", "الدكتورة", "[Mm]y name is", "[Mm]ein Name ist", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут", "[Μμ]ε λένε")
#: By script: given names of men and women, and syllables of surnames
NAMES = {
    "latin": ("Adam Ben Carl David Emil Felix Georg Henri Ivan Jonas Karl Leon Martin Noel Oscar Paul", "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula", "ba be da do el fa ga ha ka la le ma mi na no or pa ra ri sa so ta to va"),
    "cyrillic": ("Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур", "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса", "ба ве га да жа за ка ла ле ма ми на но ор па ра ри са со та то ва ша ю"),
    "greek": ("Αλέξης Γιάννης Δημήτρης Ηλίας Θάνος Κώστας Λευτέρης Μάρκος Νίκος Πέτρος Σπύρος Τάσος", "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Ράνια Σοφία Χαρά", "βα γα δα θε κα λα λε μα μι να νο πα ρα ρι σα σο τα το φα χα"),
    "arabic": ("أحمد جمال حسن خالد رامي سامي طارق عادل فارس كريم ماجد ياسر", "أمل جميلة دينا ريم زينب سارة عائشة فاطمة ليلى مريم نور هند", "با تا جا حا دا را زا سا شا صا طا عا فا قا كا لا ما نا ها يا"),
    "hebrew": ("אבי בני גיל דוד חיים יוסי משה עמית רון שלמה", "אורית דנה חנה יעל מיכל נועה רות שרה תמר", "בא גא דא הא זא חא טא יא כא לא מא נא סא פא קא רא שא תא"),
}
#: By script: first and last letter of its range (upper and lower case apart), and what letters are replaced by
ALPHABETS = (
    ("a", "z", "abcdefghijklmnopqrstuvwxyz"),
    ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("а", "џ", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    ("Ѐ", "Я", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    ("ά", "ώ", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Ά", "Ϋ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("ա", "և", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"),
    ("Ա", "Ֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ"),
    ("א", "ת", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("ء", "ي", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("अ", "ह", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
    ("ก", "ฮ", "กขคงจชซดตถทนบปผพฟมยรลวสหอ"),
    ("ა", "ჰ", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    ("ぁ", "ゖ", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ"),
    ("ァ", "ヺ", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ"),
    ("㐀", "鿿", "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓冯韩曹曾彭"),
    ("가", "힣", "가나다라마바사아자차카타파하거너더러머버서어저처고노도로모보소오"),
)

_ALL = (*MALE, *FEMALE, *NEUTRAL)
_TITLES = "|".join(sorted(_ALL, key=len, reverse=True))
_PARTICLES = "von|van|vom|zu|zur|de|der|den|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el"
_CAP = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{Ll}\p{L}*(?:['’\-]\p{Lu}\p{L}*)*|\p{Lo}{2,32})"
_SECRET_NAME = r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)"
#: Tokens and keys that their form tells, by how they begin
_SECRET_FORM = r"AKIA|gh[pousr]_|sk-|eyJ|(?i:\bbearer )|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s{0,2}"
_PHONE_NAME = r"(?i:\b(?:call|tel|tél|telephone|phone|fax|mobile?|handy|teléfono|téléphone)\b\.?:? {0,2})"
_PASSPORT_NAME = r"(?i:\bpassport(?: (?:no|number|nr)\b)?\.?\s{0,2}[:#]?\s{0,2})"
_BIRTH_NAME = r"(?i:\b(?:date of birth|dob|born(?: on)?|geboren am|née? le|nacid[oa] el)\b\s{0,2}:?\s{0,2})"
_STREETS, _STRASSE = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square", "straße|strasse|weg|platz|allee"
_HEX = "[0-9A-Fa-f]{1,4}"
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}|(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@localhost\b",
    # named ones: long, or short with a digit, or in quotes
    "secret": rf"{_SECRET_NAME}(?:(?=[_\-/+]*+[A-Za-z0-9])[A-Za-z0-9_\-/+]{{12,}}|(?=[A-Za-z_\-/+]*+\d)[A-Za-z0-9_\-/+]{{4,}}|(?<=[\"'])[^\"'\s_\-]+)"
    + r"|(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9\-]{20,}|\beyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]+)?"
    + r"|(?i:\bbearer )[A-Za-z0-9_\-.=]{12,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s{0,2}[A-Za-z0-9+/=\s]*[A-Za-z0-9+/=]",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![\p{{L}}\p{{N}}:])",
    # 15 to 34 characters, in groups of four and what is left
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7} ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3}\b|\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "birth": _BIRTH_NAME + r"(?:\d{1,2}[./\-]\d{1,2}[./\-](?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2})(?!\d)",
    "passport": _PASSPORT_NAME + r"[A-Z]{0,2}\d{6,9}\b",
    "card": r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": rf"{_PHONE_NAME}0\d{{1,4}}(?:[ /\-]?\d{{2,8}}){{1,3}}(?!\d)|" + r"(?<![\d\p{L}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "street": rf"\b\d{{1,5}} (?:\p{{Lu}}[\p{{L}}'\-]+ ){{1,3}}(?:{_STREETS})\b|\b\p{{Lu}}\p{{L}}{{2,40}}?(?:{_STRASSE}) \d{{1,4}}\b",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:(?:{_PARTICLES}) ){{0,3}}{_CAP}(?:(?: (?:{_PARTICLES})){{0,3}} {_CAP})?",
}
#: A name's part or what is between such; together they are the whole text
_WORD = r"\p{L}+(?:['’\-]\p{Lu}\p{L}*)*|\P{L}+"
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Cheaper to look for, and in every text that PATTERN is in; by type: e-mail; card, ssn, passport and local phone numbers; ip and dates; secrets and IPv6;
#: international phone numbers, which may come in pairs, and national ones after a word; IBANs, of which only two digits are sure; streets; names
MAYBE = rf"@|[0-9]{{3}}|[0-9][./\-][0-9]|[=:]|[0-9a-f]{{8}}|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|[0-9] \p{{Lu}}|[egz] [0-9]|AKIA|gh[pousr]_|sk-|eyJ|(?i:bearer )|-----BEGIN|(?<!\p{{L}})(?:{_TITLES})[. ]"
#: What a mention keeps
_BEFORE = {"secret": f"(?:{_SECRET_NAME}|{_SECRET_FORM})", "phone": _PHONE_NAME, "birth": _BIRTH_NAME, "passport": _PASSPORT_NAME, "name": rf"(?:{_TITLES})\.? (?:(?:{_PARTICLES}) )*"}

_DIGITS, _NIBBLES = "0123456789", "0123456789abcdef"


def _type(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _before(kind: Column, mention: Column) -> Column:
    out = F.lit("")
    for name, pattern in _BEFORE.items():
        out = F.when(kind == name, F.regexp_extract(mention, f"^{pattern}", 0)).otherwise(out)
    return out


def _own(kind: Column, mention: Column) -> Column:
    """The mention without what it keeps before."""
    return F.substring(mention, F.length(_before(kind, mention)) + 1, F.length(mention))


def _canon(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ipv6", "street"), F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("card", "ssn"), digits)
        # how many digits the country code has is kept with a phone's digits
        .when(kind == "phone", F.concat(F.length(F.regexp_extract(mention, r"^\+(\d{1,3})", 1)).cast("string"), F.lit(":"), digits))
        .otherwise(mention)
    )


def _parts(kind: Column, mention: Column) -> Column:
    """(kind, canon) of what is to be replaced in a mention: a name's parts, else one."""
    before = _before(kind, mention)
    own = _own(kind, mention)
    given = F.substring_index(own, " ", 1)
    female = F.when(before.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), True).when(before.rlike(rf"^(?:{'|'.join(MALE)})\.? "), False).otherwise(given.rlike("[aаяαήةת]$") | given.isin(*" ".join(n[1] for n in NAMES.values()).split()))
    first = F.struct(F.when(female, "given_f").otherwise("given_m").alias("kind"), given.alias("canon"))
    last = F.struct(F.lit("surname").alias("kind"), F.substring_index(own, " ", -1).alias("canon"))
    called = before.rlike(rf"^(?:{'|'.join(x for x in NEUTRAL if ' ' in x)}) ")  # a phrase, after which a single name is a given one
    name = F.when(own.contains(" "), F.array(first, last)).when(called, F.array(first)).otherwise(F.array(last))
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), _canon(kind, own).alias("canon"))))


def _number(random: Column, i: Column) -> Column:
    """The i-th random number below 65536; random has 32 of them, then they repeat, moved by their turn."""
    at = i % 32
    return F.conv(F.substring(random, at * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _mapped(text: Column, random: Column, keep: Column) -> Column:
    """text with each character from place `keep` on replaced by one of its kind; letters of scripts that ALPHABETS hasn't, by Latin ones."""

    def one(c: Column, i: Column) -> Column:
        n = _number(random, i)
        out = F.when(i < keep, c).when(c.between("0", "9"), _pick(_DIGITS, n))
        for lo, hi, letters in ALPHABETS:
            out = out.when(c.between(lo, hi), _pick(letters, n))
        return out.when(c.rlike(r"\p{Lu}"), _pick(ALPHABETS[1][2], n)).when(c.rlike(r"\p{L}"), _pick(ALPHABETS[0][2], n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hexadecimal(text: Column, random: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick(_NIBBLES, _number(random, i))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """The checksum modulo 10; the last digit counts once."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5) + c.cast("int") * 2 % 10))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """text modulo 97, its letters read as 10 to 35."""
    digits = F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: ((a * F.when(x > 9, 100).otherwise(10) + x) % 97).cast("int"))


def _bank(canon: Column, random: Column) -> Column:
    """An IBAN of the same country, whose check digits hold if canon's do."""
    mapped = _mapped(canon, random, F.lit(2))
    country, account = F.substring(mapped, 1, 2), F.substring(mapped, F.lit(5), F.length(mapped))
    holds = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(holds, check).otherwise(F.substring(mapped, 3, 2)), account)


def _script(canon: Column) -> Column:
    out = F.lit("latin")
    for name in ("cyrillic", "greek", "arabic", "hebrew"):
        out = F.when(canon.rlike(rf"\p{{Is{name.capitalize()}}}"), name).otherwise(out)
    return out


def _one_of(items: str, random: Column):
    """For a place, one of the items, by the place's random number."""
    each = items.split()
    return lambda i: F.element_at(F.array(*map(F.lit, each)), _number(random, i) % len(each) + 1)


def _syllables(script: Column, random: Column, n: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, _, syllables) in NAMES.items():
        out = F.when(script == name, F.array_join(F.transform(F.sequence(F.lit(1), n), _one_of(syllables, random)), "")).otherwise(out)
    return F.initcap(out)


def _given(script: Column, female: Column, random: Column, attempt: Column) -> Column:
    """At the first attempt a name of the list, then one with more and more syllables behind it."""
    out = F.lit(None).cast("string")
    for name, lists in NAMES.items():
        for women in (False, True):
            out = F.when((script == name) & (female == F.lit(women)), _one_of(lists[women], random)(F.lit(0))).otherwise(out)
    more = F.when(attempt > 0, F.lower(_syllables(script, random, attempt))).otherwise("")
    ending = F.when(~female | (attempt == 0), "").when(script == "cyrillic", "на").when(script == "greek", "να").when(script == "latin", "na").otherwise("")
    return F.concat(out, more, ending)


def _day(canon: Column, random: Column) -> Column:
    """A date in canon's form that is one whichever of day and month comes first."""
    def one(part: Column, i: Column) -> Column:
        n = _number(random, i)
        return F.when(F.length(part) == 4, (n % 90 + 1920).cast("string")).when(i == 2, F.when(canon.rlike("^[0-9]{4}"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).otherwise(F.lpad((n % 100).cast("string"), 2, "0"))).when(F.length(part) == 2, F.lpad((n % 12 + 1).cast("string"), 2, "0")).otherwise((n % 9 + 1).cast("string"))

    return F.replace(F.array_join(F.transform(F.split(canon, r"[./\-]"), one), "/"), F.lit("/"), F.regexp_extract(canon, r"[./\-]", 0))


def _surrogate(secret: str, kind: Column, canon: Column, attempt: int) -> Column:
    tried = F.lit(attempt)
    random = F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, canon, tried.cast("string")), 512)
    script = _script(canon)
    last_dot = F.length(F.substring_index(canon, ".", -1))
    host = F.element_at(F.split(canon, "@"), -1)
    local = F.substring_index(canon, "@", 1)
    # all the host's labels but the last, and then one that no real host has
    labels = F.substring(host, F.lit(1), F.length(host) - last_dot - 1)
    mail = F.when(~host.contains("."), F.concat(_mapped(local, random, F.lit(0)), F.lit("@"), host)).otherwise(F.concat(_mapped(local, random, F.lit(0)), F.lit("@"), _mapped(labels, F.reverse(random), F.lit(0)), F.lit(".example."), F.substring(canon, -1 * last_dot, last_dot)))
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, _number(random, i) % 223 + 1).otherwise(_number(random, i) % 256).cast("string")), ".")
    card = _mapped(canon, random, F.lit(1))
    fixed = F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.pmod(F.substring(card, -1, 1).cast("int") + _luhn(canon) - _luhn(card), F.lit(10)).cast("string"))
    code = F.substring(canon, 1, 1).cast("int")
    house, of_kind = F.regexp_extract(canon, r"\d+", 0), F.regexp_extract(canon, rf"(?i)(?:{_STREETS}|{_STRASSE})(?=$| \d+$)", 0)
    named = _syllables(script, random, F.lit(3))
    street = F.when(canon.rlike(r"^\d"), F.concat(_mapped(house, random, F.lit(0)), F.lit(" "), named, F.lit(" "), F.initcap(of_kind))).otherwise(F.concat(named, of_kind, F.lit(" "), _mapped(house, random, F.lit(0))))
    out = (
        F.when(kind == "email", mail)
        .when(kind == "ip", address)
        .when(kind == "ipv6", _hexadecimal(canon, random))
        .when(kind == "card", fixed)
        .when(kind == "phone", F.concat(F.substring(canon, 1, 2), _mapped(F.substring(canon, F.lit(3), F.length(canon)), random, code)))
        .when(kind == "iban", _bank(canon, random))
        .when(kind == "birth", _day(canon, random))
        .when(kind == "street", street)
        .when(kind == "surname", _syllables(script, random, tried + 3))
        .when(kind.startswith("given"), _given(script, kind == "given_f", random, tried))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), _hexadecimal(canon, random))
        .otherwise(_mapped(canon, random, F.lit(0)))
    )
    if attempt < TRIES:
        return out
    tail = F.substring(F.reverse(random), F.lit(1), F.lit(8 * (attempt - TRIES + 1)))
    # in front of an address's @, at the end of others
    return F.when(kind == "surname", out).when(kind.startswith("given"), out).when(kind == "email", F.regexp_replace(out, "@", F.concat(F.lit("-"), tail, F.lit("@")))).otherwise(F.concat(out, F.lit("-"), tail))


def _written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A part's surrogate in the mention's format; what doesn't fit in follows."""
    bare = F.when(kind == "phone", F.substring(surrogate, F.lit(3), F.length(surrogate))).otherwise(surrogate)
    chars = F.transform(F.split(mention, ""), lambda c: F.struct(c.alias("c"), (F.when(kind == "iban", c != " ").otherwise(c.between("0", "9"))).alias("own")))
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    step = lambda a, x: F.struct(F.concat(a["text"], F.when(x["own"], F.substring(bare, a["next"], F.lit(1))).otherwise(x["c"])).alias("text"), (a["next"] + x["own"].cast("int")).alias("next"))
    filled = F.aggregate(chars, start, step, lambda a: F.concat(a["text"], F.substring(bare, a["next"], F.length(bare))))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), filled).otherwise(surrogate)


def assigned(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct (kind, canon) of entities: no two surrogates of a kind are equal, and none is
    a real entity of that kind."""
    real = written(entities.select("kind", "canon").distinct())
    left, fixed, attempt = real, None, 0
    while True:
        tried = written(left.select("kind", "canon", _surrogate(secret, F.col("kind"), F.col("canon"), attempt).alias("surrogate")))
        winner = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = winner.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if fixed is not None:
            good = good.join(fixed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = good.select("kind", "canon", "surrogate")
        now = written(good if fixed is None else fixed.union(good))
        rest = written(tried.select("kind", "canon").join(now.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        drop(tried, fixed)
        fixed, left, attempt = now, rest, attempt + 1
        if not left.take(1):
            return fixed


def with_surrogates(docs: DataFrame, secret: str) -> DataFrame:
    """docs with surrogates in the column text, and _entities: how many were replaced."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"))
    text = F.col("_row.text")
    has = F.coalesce(text.rlike(MAYBE) & text.rlike(PATTERN), F.lit(False))
    found = rows.where(has).select("_d", "_k", F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("i", "mention")).withColumn("of", _type(F.col("mention")))
    found = written(found.select("*", F.posexplode(_parts(F.col("of"), F.col("mention"))).alias("j", "part")).select("_d", "_k", "i", "j", "mention", "of", "part.kind", "part.canon"))
    named = written(found.join(assigned(found.select("kind", "canon"), secret), ["kind", "canon"]))
    of, mention = F.col("of"), F.col("mention")
    # a surname's particles stay
    between = F.regexp_extract(mention, rf"((?: (?:{_PARTICLES}))* )\S+$", 1)
    piece = F.concat(F.when(F.col("j") == 0, _before(of, mention)).otherwise(between), _written(F.col("kind"), _own(of, mention), F.col("surrogate")))
    # a mention's pieces, then a document's mentions
    whole = named.groupBy("_d", "_k", "i").agg(F.sort_array(F.collect_set(F.struct("j", piece.alias("s")))).alias("of"))
    lists = whole.groupBy("_d", "_k").agg(F.sort_array(F.collect_list(F.struct("i", F.array_join("of.s", "").alias("s")))).alias("all"))
    # and what a document's names' parts are replaced by, where they stand alone
    parts = named.where("of = 'name'").groupBy("_d", "_k", "canon").agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("s"))
    parts = parts.groupBy("_d", "_k").agg(F.map_from_entries(F.collect_list(F.struct("canon", "s"))).alias("known"))
    both = lists.alias("y").join(parts.alias("z"), F.col("y._d").eqNullSafe(F.col("z._d")) & (F.col("y._k") == F.col("z._k")), "left").select("y.*", "known").alias("y")
    dirty = rows.where(has).alias("x").join(both, F.col("x._d").eqNullSafe(F.col("y._d")) & (F.col("x._k") == F.col("y._k")))
    pieces = F.split(text, PATTERN, -1)
    words = lambda p: F.regexp_extract_all(p, F.lit(_WORD), F.lit(0))
    bare = lambda p: F.array_join(F.transform(words(p), lambda w: F.coalesce(F.element_at("known", w), w)), "")
    more = F.when(F.col("known").isNotNull(), F.aggregate(pieces, F.lit(0), lambda n, p: n + F.size(F.filter(words(p), lambda w: F.array_contains(F.map_keys("known"), w))))).otherwise(0)
    shown = lambda p: F.when(F.col("known").isNull(), p).otherwise(bare(p))
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(shown(p), F.coalesce(F.get("all", i)["s"], F.lit("")))), "")
    dirty = dirty.select("_row", whole.alias("_text"), (F.size("all") + more).cast("long").alias("_entities"))
    clean = rows.where(~has).select("_row", text.alias("_text"), F.lit(0).cast("long").alias("_entities"))
    return dirty.union(clean).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "_entities")


def key_of(spark: SparkSession) -> str:
    """The setting KEY; where it is unset, a random one that this session keeps."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with surrogates, and the number of entities; the key is the setting KEY, which has to be kept secret, or the session's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_surrogates(docs, secret=key_of(spark)).select("doc_id", F.col("_entities").alias("n_entities"), "text")
