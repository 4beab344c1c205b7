"""Personal data replaced by keyed, type-consistent surrogates, with collision checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

DEFAULT_KEY = "spark-cues-demo-key"
_NONE = -(1 << 63)
#: Rounds of collision checks; from the eighth attempt on numbers grow by a digit, again every eight, so a full space empties.
MAX_ROUNDS = 48

# Given names by script and gender.  A surrogate comes from the same list.
GIVEN = {
    ("latin", "f"): (
        "Alice", "Amina", "Anna", "Ayşe", "Beatriz", "Camille", "Carmen", "Caroline", "Catherine", "Charlotte", "Claire", "Deborah", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Francesca", "Giulia", "Greta", "Hannah", "Helena",
        "Ingrid", "Isabel", "Jennifer", "Jessica", "Johanna", "Julia", "Karen", "Katarzyna", "Laura", "Leila", "Linda", "Lucia", "Margaret", "Maria", "Mariana", "Mary", "Monika", "Nancy", "Nina", "Olivia", "Patricia", "Priya", "Rebecca",
        "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Theresa", "Ursula", "Valentina", "Victoria", "Yasmin", "Zeynep",
    ),
    ("latin", "m"): (
        "Ahmed", "Alejandro", "Ali", "Andreas", "Andrew", "Anthony", "Antonio", "Arjun", "Brian", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Emil", "Felix", "Fernando", "Francisco", "George", "Giovanni", "Hans", "Hassan",
        "Henry", "Hiroshi", "Ibrahim", "James", "Jason", "Javier", "John", "Joseph", "Kenneth", "Kevin", "Klaus", "Lars", "Laurent", "Louis", "Luca", "Marco", "Matthew", "Mehmet", "Michael", "Mohammed", "Nicolas", "Oliver", "Omar",
        "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Rafael", "Raj", "Richard", "Robert", "Ronald", "Stefan", "Steven", "Thomas", "Timothy", "William", "Wolfgang", "Yusuf",
    ),
    ("cyrillic", "f"): ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Олег", "Сергей"),
}
# What stands before a surname, besides a given name; and what may stand between.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Sir", "Madam", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Signor", "Signora", "господин", "госпожа")
# Words beside which a capitalised word is a person, whatever the name.
SAYING = ("said", "says", "wrote", "writes", "asked", "replied", "answered", "explained", "dijo", "escribió", "a dit", "a écrit")
MEETING = ("met", "told", "asked", "called", "emailed", "phoned", "thanked", "contacted", "interviewed", "hired")
GREETING, PARTING = ("Dear", "Hi", "Hello"), ("regards", "Regards", "sincerely", "Sincerely", "Cheers", "Thanks")
# What stands in a person's place without being one.
DETERMINERS = ("The", "This", "That", "These", "Those", "Our", "My", "His", "Her", "Its", "Your", "Their", "Every", "Each", "No", "Some", "Many", "Most", "Two")
NO_PERSON = (
    "later", "yesterday", "today", "tomorrow", "now", "when", "while", "after", "before", "but", "and", "if", "as", "for", "here", "finally", "once", "he", "she", "it", "we", "you", "who", "what", "his", "her", "its", "our", "my", "your", "their", "nobody", "people", "all", "the", "this", "that", "these", "they", "there", "then", "team", "sir", "madam", "customer", "customers", "colleague", "colleagues", "friend", "friends", "everyone", "editor", "reader", "readers", "world", "user", "users", "support",
    "service", "sales", "info", "contact", "admin", "office", "press", "news", "reply", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "june", "july", "august", "september",
    "october", "november", "december",
)
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "bin", "al")
# Letters and digits are replaced within their class, so script, case and shape stay.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöüãõåæø", "çñßśźżčšž", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "0123456789")



def _any_of(words) -> str:
    """An alternation by first letter, so that few branches are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (w[0], -len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in heads.items())


#: Every given name, also in capitals.
_NAMES = {n: n for names in GIVEN.values() for n in names} | {n.upper(): n for names in GIVEN.values() for n in names}
_GIVEN = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_any_of(_NAMES)})(?!\p{{L}})"
#: One word of a surname, as in Smith, McDonald, O'Brien, Smith-Jones or SMITH.
_SURNAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:['’-]\p{Lu}\p{L}++)*+"
#: Up to three words of a name, and where they stand as a person: who speaks, who is met (also in a list), who is greeted, who signs.
_PERSON = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++){0,2}"
_FULL = f"{_PERSON}(?: {_PERSON}){{1,2}}"
EVIDENCE = (
    rf"(?<!\p{{L}})(?:{_FULL}|(?<=[\p{{Ll}},;] ){_PERSON}) (?:{'|'.join(SAYING)})(?!\p{{L}})"
    rf"|(?<!\p{{L}})(?:{'|'.join(MEETING)}) {_FULL}(?:, {_FULL}){{0,9}}(?:,? and {_FULL})?(?!\p{{L}})"
    rf"|(?<!\p{{L}})(?:{'|'.join(GREETING)}) {_PERSON}(?: {_PERSON}){{0,2}}(?=[,:])"
    rf"|(?<!\p{{L}})(?:{'|'.join(PARTING)}),\s{{1,2}}{_PERSON}(?: {_PERSON}){{0,2}}(?=\.?(?:\n|$))"
)
_DETERMINED = rf"(?<!\p{{L}})(?:{'|'.join(DETERMINERS)})(?!\p{{L}})"
#: A mail address made of two names, and words in lower case outside of addresses.
_LOCAL = rf"(?<![\p{{L}}\p{{N}}._%+-])(?!(?:{'|'.join(NO_PERSON)})[._])(\p{{L}}{{3,20}})[._](?!(?:{'|'.join(NO_PERSON)})@)(\p{{L}}{{3,20}})@(?=[A-Za-z0-9])"
_LOW = (r"(?<![\p{L}\p{N}._%+@-])(?:", r")(?![\p{L}\p{N}_%+@-]|\.\p{L})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_AFTER = r"(?![\p{L}\p{N}])"
#: Eight groups of hex digits, or fewer around one "::"; a digit must be among them.
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f]{{0,4}}:{{0,2}}[0-9A-Fa-f:]{{0,38}}?\d)(?=[0-9A-Fa-f]{{0,4}}:)(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:]|\.\d)"
#: A number as it is dialled within a country: a zero, 9 to 11 digits in all, one kind of sign between its parts.
_NATIONAL = "|".join(rf"(?<![\p{{L}}\p{{N}}.,:+/-])(?=0[1-9](?:{s}?\d){{7,9}}(?![\p{{L}}\p{{N}}]|[.:/-]\d))0\d{{1,4}}(?:{s}\d{{2,8}}){{1,4}}" for s in (" ", r"\.", "-")) + rf"|(?<![\p{{L}}\p{{N}}])\(0\d{{1,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}{_AFTER}"
#: Kinds in order of precedence; a match is of the first kind whose pattern fits it whole.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}\d)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)|{_IP6}",
    "card": rf"(?<![\p{{L}}\p{{N}}])\d{{4}}(?:[ -]?\d{{4}}){{3}}(?:[ -]?\d{{3}})?{_AFTER}|(?<![\p{{L}}\p{{N}}])\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}{_AFTER}|(?<![\p{{L}}\p{{N}}+])\d{{13,19}}{_AFTER}",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:\+?\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3}}[ .-]?\d{{3,4}}{_AFTER}|(?<![\p{{L}}\p{{N}}])(?:\+\d{{1,3}}[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_AFTER}"
    rf"|(?<![\p{{L}}\p{{N}}])\+(?=(?:[ .()-]{{0,2}}\d){{7,15}}{_AFTER})[1-9]\d{{0,14}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{1,12}}){{0,14}}{_AFTER}|(?<![\p{{L}}\p{{N}}.,+-])[2-9]\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}-])|{_NATIONAL}",
    "given": _GIVEN,
    "surname": rf"(?<!\p{{L}})(?:(?=\p{{Lu}})(?:{_any_of(_NAMES)})(?!\p{{L}})|(?:{_any_of(TITLES)})\.?)(?= (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}({_SURNAME})(?!\p{{L}}))",
}
#: All kinds but surnames, which a text's own pattern adds; each branch first looks at one sign.
ANY = "|".join(rf"(?:{PATTERNS[k]})" for k in ("email", "iban")) + r"|(?=[\d(+])(?:" + "|".join(rf"(?:{PATTERNS[k]})" for k in ("ip", "card", "ssn", "phone")) + f")|(?=[A-Fa-f:]){_IP6}|{PATTERNS['given']}"
#: What a text must hold to have any entity at all: looked for before the costly pattern.
HINT = rf"[@\d]|{_GIVEN}|(?<!\p{{L}})(?:{_any_of(TITLES)})(?!\p{{L}})"
_CONTEXT = rf"(?<!\p{{L}})(?:{_any_of({*SAYING, *MEETING, *GREETING, *PARTING})})(?!\p{{L}})|\p{{L}}[._]\p{{L}}{{3,20}}@"
CONTEXT_HINT = f"{HINT}|{_CONTEXT}"
_DIGIT_KINDS = ("card", "ssn", "phone")
#: Set around matches; a code point that no text should hold (one that does is cut in two passes).
_SIGN = "\ufdd0"


def people(text: Column) -> Column:
    """Words that the text itself shows to be names: by what stands beside them (``EVIDENCE``), or by a mail address of two names.

    A word that the text also has in lower case, outside of addresses, is no name; words behind a determiner are none either.
    """
    phrases = F.filter(F.regexp_extract_all(text, F.lit(EVIDENCE), F.lit(0)), lambda m: ~F.regexp_like(m, F.lit(_DETERMINED)))
    beside = F.flatten(F.transform(phrases, lambda m: F.regexp_extract_all(m, F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0))))
    said = F.array_except(beside, F.lit([*GREETING, *PARTING]))
    mailed = F.concat(*[F.regexp_extract_all(text, F.lit(_LOCAL), F.lit(k)) for k in (1, 2)])
    fresh = F.array_except(F.transform(F.concat(said, mailed), F.lower), F.lit([*NO_PERSON, *(t.lower() for t in TITLES)]))
    # Only the words in question are looked for: a list of all words of a very long text would fill the memory.
    low = lambda n: F.regexp_extract_all(text, F.concat(F.lit(_LOW[0]), F.array_join(n, "|"), F.lit(_LOW[1])), F.lit(0))
    kept = lambda n: F.when(F.size(n) > 0, F.transform(F.array_except(n, low(n)), F.initcap)).otherwise(n)
    return F.when(F.regexp_like(text, F.lit(_CONTEXT)), _let(fresh, kept)).otherwise(F.array().cast("array<string>"))


def pattern(text: Column, context: bool = False) -> Column:
    """``ANY``, and the text's own surnames (with ``context`` its ``people`` too) wherever they stand, also in capitals."""
    surnames = F.regexp_extract_all(text, F.lit(PATTERNS["surname"]), F.lit(1))
    names = F.array_distinct(F.concat(surnames, people(text)) if context else surnames)
    # Longer names first, so that Smith-Lee isn't taken as Smith.
    sized = lambda n: F.array_sort(F.transform(F.array_distinct(F.concat(n, F.transform(n, F.upper))), lambda x: F.struct((-F.length(x)).alias("size"), x.alias("name"))))
    every = lambda n: F.array_join(F.transform(sized(n), lambda x: x["name"]), "|")
    own = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(rf"{ANY}|(?<!\p{{L}})(?:"), every(n), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ANY))
    return _let(names, own)


def parts(text: Column, context: bool = False) -> Column:
    """The text cut at what the patterns match: gaps at even places, matches at odd ones; null for a null text."""
    marked = lambda p: F.split(F.regexp_replace(text, p, F.lit(f"{_SIGN}$0{_SIGN}")), _SIGN, -1)
    twice = lambda p: F.flatten(F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda gap, m: F.when(m.isNull(), F.array(gap)).otherwise(F.array(gap, m))))
    hinted = F.regexp_like(text, F.lit(CONTEXT_HINT if context else HINT))
    # The text's own pattern is made once, and only where a text may hold an entity.
    cut_text = _let(pattern(text, context), lambda p: F.when(F.contains(text, F.lit(_SIGN)), twice(p)).otherwise(marked(p)))
    return F.when(text.isNull() | ~hinted, F.when(text.isNotNull(), F.array(text))).otherwise(cut_text)


def entities_of(cut_text: Column) -> Column:
    """The entities among the parts of a text, in order; none for a null."""
    found = F.filter(cut_text, lambda x, i: (F.pmod(i, F.lit(2)) == 1) & is_entity(x))
    return F.coalesce(found, F.array().cast("array<string>"))


def entities(text: Column) -> Column:
    """The text's entities in order."""
    return entities_of(parts(text))


def is_entity(value: Column) -> Column:
    """A number in the layout of a card, but for four groups of four digits, must pass the card checksum; an account number its own."""
    loose = F.regexp_like(value, F.lit(r"^\d[\d -]{11,}\d$")) & ~F.regexp_like(value, F.lit(r"^\d{4}([ -]?\d{4}){3}$|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^0[1-9](?:[ -]?\d){7,9}$"))
    account = F.regexp_like(value, F.lit(_IBAN))
    return F.when(loose, _luhn(F.regexp_replace(value, r"\D", "")) == 0).when(account, _mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1).otherwise(True)


_IBAN = r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$"


def _mod97(account: Column) -> Column:
    """The remainder of an account number, its first four signs moved to the end and letters read as 10 to 35."""
    signs = F.transform(_chars(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(signs, F.lit(0), lambda acc, v: F.pmod(F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v), F.lit(97)))


def _account(value: Column, digest: Column) -> Column:
    """Signs within their class behind the same country, with check digits that fit."""
    country = F.substring(value, F.lit(1), F.lit(2))
    made = lambda body: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)
    return _let(F.substring(_in_class(value, digest), F.lit(5), F.length(value)), made)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(value: Column) -> Column:
    kind = F.when(F.contains(value, F.lit("@")), "email").when(F.contains(value, F.lit(":")) | F.regexp_like(value, F.lit(rf"^{_OCTET}(\.{_OCTET}){{3}}$")), "ip")
    kind = kind.when(F.regexp_like(value, F.lit(_IBAN)), "iban")
    kind = kind.when(F.regexp_like(value, F.lit(r"^\d{4}([ -]?\d{4}){3}([ -]?\d{3})?$|^\d{4}[ -]\d{6}[ -]\d{4,5}$|^\d{13,19}$")), "card").when(F.regexp_like(value, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
    return kind.when(F.regexp_like(value, F.lit(r"\d")), "phone").when(value.isin(*_NAMES), "given").otherwise("surname")


def _identity(value: Column, kind: Column) -> Column:
    by_kind = F.when(kind.isin(*_DIGIT_KINDS), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
    return by_kind.when(kind.isin("email", "ip"), F.lower(value)).when(kind == "surname", F.initcap(F.lower(value))).otherwise(value)


def identity(value: Column) -> Column:
    """What makes two mentions one entity: digits of a number, an account without spaces, a mail or network address in lower case, a surname in any case."""
    return _identity(value, kind_of(value))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _byte(digest: Column, i: Column | int) -> Column:
    at = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(32)) * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


_LETTERS = "".join(CLASSES)
#: For each letter, where its class starts (from 1, three digits) and how many letters it has (two digits): two literals, not two arrays.
_STARTS = "".join(f"{_LETTERS.index(c[0]) + 1:03d}" for c in CLASSES for _ in c)
_SIZES = "".join(f"{len(c):02d}" for c in CLASSES for _ in c)


def _in_class(value: Column, digest: Column) -> Column:
    """Every letter or digit by one of its class, chosen by the digest; other signs stay."""
    start = lambda p: F.substring(F.lit(_STARTS), p * 3 - 2, F.lit(3)).cast("int")
    size = lambda p: F.substring(F.lit(_SIZES), p * 2 - 1, F.lit(2)).cast("int")
    pick = lambda p, i: F.substring(F.lit(_LETTERS), start(p) + F.pmod(_byte(digest, i), size(p)), F.lit(1))
    one = lambda c, i: _let(F.instr(F.lit(_LETTERS), c), lambda p: F.when(p > 0, pick(p, i)).otherwise(c))
    return F.array_join(F.transform(_chars(value), one), "")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string modulo 10, doubling every second digit from the right."""
    doubled = lambda d, odd: F.when(odd, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: doubled(c.cast("int"), F.pmod(i, F.lit(2)) == 1))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _digits(kind: Column, digits: Column, digest: Column) -> Column:
    """As many digits, keyed; a card keeps its first digit and its checksum's remainder, a phone its leading digit."""
    head = lambda x: F.substring(x, F.lit(1), F.length(digits) - 1)
    card = lambda x: F.concat(head(x), F.pmod(_luhn(digits) - _luhn(F.concat(head(x), F.lit("0"))), F.lit(10)).cast("string"))
    kept = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.substring(_in_class(digits, digest), F.lit(2), F.length(digits) - 1))
    return F.when(kind == "ssn", _in_class(digits, digest)).otherwise(_let(kept, lambda x: F.when(kind == "card", card(x)).otherwise(x)))


def _layout(value: Column, digits: Column, signs: str = "0-9") -> Column:
    """The digits (or other ``signs``) set into the value's places for them."""
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), f"[^{signs}]", ""))
    put = lambda d: F.transform(_chars(value), lambda c, i: F.when(F.regexp_like(c, F.lit(f"[{signs}]")), F.substring(d, before(i) + 1, F.lit(1))).otherwise(c))
    return F.array_join(_let(digits, put), "")


def _given(key: str, value: Column) -> Column:
    """A keyed rotation of the name's own list: one to one, and never the name itself."""
    found = []
    for (script, gender), names in GIVEN.items():
        base = F.initcap(F.lower(value))
        every, shift = F.lit(list(names)), F.pmod(_byte(_digest(key, F.lit(script), F.lit(gender)), 0), F.lit(len(names) - 1)) + 1
        found.append(F.when(base.isin(*names), F.get(every, F.pmod(F.array_position(every, base).cast("int") - 1 + shift, F.lit(len(names))))))
    return _let(F.coalesce(*found), lambda new: F.when(value == F.upper(value), F.upper(new)).otherwise(new))


def _email(key: str, value: Column, digest: Column) -> Column:
    """Local part by the address, domain by the domain alone, last label kept."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    name, top = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    return F.concat(_in_class(local, digest), F.lit("@"), _let(_digest(key, F.lit("domain"), F.lower(domain)), lambda d: _in_class(name, d)), top)


def _ip6(value: Column, digest: Column, attempt: Column) -> Column:
    """Hex digits by those of the digest in the address's own layout; from the eighth attempt on all eight groups are written."""
    groups = F.concat_ws(":", *[F.substring(digest, 4 * k + 1, 4) for k in range(8)])
    same = F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == ":", c).otherwise(F.substring(digest, i + 1, F.lit(1)))), "")
    made = F.when(attempt.cast("int") >= 8, groups).otherwise(same)
    return _let(made, lambda x: F.when(F.regexp_like(value, F.lit("[A-F]")), F.upper(x)).otherwise(x))


def surrogate(value: Column, attempt: Column, key: str, kind: Column | None = None) -> Column:
    """The replacement of an entity: same kind, script, case, gender and layout, and always the same for one entity.

    ``kind`` is given where the value doesn't show it, as an identity of bare digits.
    """

    # Short names run out: from the fourth attempt on a surrogate is longer than what it stands for.
    longer = lambda text, attempt: F.concat(text, F.repeat(F.when(F.regexp_like(text, F.lit(r"\p{IsCyrillic}")), "на").otherwise("na"), F.floor(attempt.cast("int") / 4).cast("int")))

    # Number spaces fill up: every eighth attempt adds a digit.
    wider = lambda text, attempt: F.concat(text, F.repeat(F.lit("0"), F.floor(attempt.cast("int") / 8).cast("int")))

    def made(value: Column, kind: Column, who: Column, digest: Column, attempt: Column) -> Column:
        ip = F.concat_ws(".", *[(F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string") for i in range(4)])
        out = F.when(kind == "email", _email(key, F.concat(longer(F.substring_index(value, "@", 1), attempt), F.lit("@"), F.substring_index(value, "@", -1)), digest)).when(kind == "ip", F.when(F.contains(value, F.lit(":")), _ip6(value, digest, attempt)).otherwise(ip))
        out = out.when(kind.isin(*_DIGIT_KINDS), _layout(wider(value, attempt), _digits(kind, wider(who, attempt), digest)))
        out = out.when(kind == "iban", _layout(wider(value, attempt), _account(wider(who, attempt), digest), "A-Z0-9"))
        return out.when(kind == "given", _given(key, value)).otherwise(_in_class(longer(value, attempt), digest))

    known = lambda x: F.struct(x["value"].alias("value"), x["attempt"].alias("attempt"), x["kind"].alias("kind"), _identity(x["value"], x["kind"]).alias("who"))
    first = _let(F.struct(value.alias("value"), attempt.alias("attempt"), (kind_of(value) if kind is None else kind).alias("kind")), known)
    return _let(first, lambda x: _let(_digest(key, x["kind"], x["attempt"], x["who"]), lambda d: made(x["value"], x["kind"], x["who"], d, x["attempt"])))


def _retries(found: DataFrame, key: str) -> DataFrame:
    """``(who, kind, attempt)`` of entities whose first surrogate collides, with the attempt that doesn't.

    A surrogate may not be another entity's surrogate nor any entity of the corpus.  The entity with the
    fewest attempts, then the smallest identity, keeps its surrogate; the others try again, until all differ.
    """
    tried = cut(found.where("kind <> 'given'").withColumn("attempt", F.lit(0)))
    for _ in range(MAX_ROUNDS):
        # Cut, so that the long expression is planned and computed once a round.
        named = cut(tried.withColumn("as", _identity(surrogate(F.col("who"), F.col("attempt").cast("string"), key, F.col("kind")), F.col("kind"))))
        first = named.groupBy("kind", "as").agg(F.min(F.struct("attempt", "who")).alias("first"), F.count("*").alias("n"))
        shared = named.join(first.where("n > 1"), ["kind", "as"]).where(F.struct("attempt", "who") != F.col("first")).select("kind", "who")
        real = named.join(tried.select("kind", F.col("who").alias("as")), ["kind", "as"], "left_semi").select("kind", "who")
        again = cut(shared.unionByName(real).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            return tried.where("attempt > 0")
        tried = cut(tried.join(again, ["kind", "who"], "left").select("kind", "who", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def replace_personal_data(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", context: bool = False) -> DataFrame:
    """``docs`` with entities replaced by surrogates, and ``entities`` (kinds of each, in order).

    Replacement needs no join: a surrogate is a function of key and entity.  Only entities whose surrogate collided
    (usually none) are joined back, to the documents that hold them.  Equal entities get equal surrogates in all
    documents and different ones different surrogates.  Persons are found by listed given names and titles; with ``context``
    also by what their text says of them (``people``).  Null texts stay null, with no entities;
    null ids, repeated rows and empty tables pass through.  A column ``entities`` of ``docs`` is replaced.
    """
    docs = docs.drop("entities")
    text = F.col(text_col).cast("string")
    cut_up = docs.withColumn("__parts", parts(text, context))
    own = entities_of(F.col("__parts"))
    mentions = cut_up.select(F.explode(own).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    found = mentions.select(identity(F.col("value")).alias("who"), kind_of(F.col("value")).alias("kind")).distinct()
    retries = _retries(found, key)
    marked = cut_up.withColumn("__retry", F.lit(None).cast("map<string,int>"))
    if not retries.isEmpty():
        keys = {"__k": F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), "__t": F.xxhash64(text)}
        rows = cut_up.select(keys["__k"].alias("__k"), keys["__t"].alias("__t"), F.explode(F.array_distinct(own)).alias("value"))
        held = rows.withColumns({"who": identity(F.col("value")), "kind": kind_of(F.col("value"))}).join(retries, ["who", "kind"])
        maps = held.groupBy("__k", "__t").agg(F.map_from_entries(F.collect_set(F.struct("value", "attempt"))).alias("__retry"))
        marked = cut_up.withColumns(keys).join(maps, ["__k", "__t"], "left").drop("__k", "__t")
    attempt = lambda m: F.coalesce(F.get(F.array(F.element_at("__retry", m)), F.lit(0)), F.lit(0)).cast("string")
    fresh = F.transform("__parts", lambda x, i: F.when((F.pmod(i, F.lit(2)) == 1) & is_entity(x), surrogate(x, attempt(x), key)).otherwise(x))
    # The kinds come from the old text's parts.
    out = marked.withColumn("entities", F.transform(own, kind_of)).withColumn(text_col, F.array_join(fresh, ""))
    return out.select(*docs.columns, "entities")


def op7_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), context=True)
    counts = [F.size(F.filter("entities", lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return out.select("doc_id", "text", *counts)
