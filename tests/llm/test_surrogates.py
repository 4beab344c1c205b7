import re

from pyspark.sql import functions as F
from spark_cues.llm import surrogates as sg

SCHEMA = "doc_id long, text string, entities string"
TEXT = "Mary Smith met John at 10.0.0.1; mail MARY@Foo.com or mary@foo.com. Call +1 (521) 555-6210 or +1-521-555-6210. Card 4111 1111 1111 1111, Анна Иванова, 123-45-6789. John Smith."


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    return [r["text"] for r in sg.replace_personal_data(docs, key).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def test_kinds_formats_and_coreference(spark):
    text = run(spark, [TEXT])[0]
    for old in ("Mary", "Smith", "John", "10.0.0.1", "foo.com", "555-6210", "4111", "Анна", "Иванова", "123-45-6789"):
        assert old.lower() not in text.lower()
    m = re.fullmatch(r"(\w+) (\w+) met (\w+) at (\d+\.\d+\.\d+\.\d+); mail ([A-Z]{4}@[A-Z][a-z]{2}\.com) or ([a-z]{4}@[a-z]{3}\.com)\. Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4})\. Card (\d{4} \d{4} \d{4} \d{4}), (\w+) (\w+), (\d{3}-\d{2}-\d{4})\. (\w+) (\w+)\.", text)
    assert m, text
    g = m.groups()
    assert g[0] in sg.GIVEN["latin", "f"] and g[2] in sg.GIVEN["latin", "m"] and g[9] in sg.GIVEN["cyrillic", "f"]
    assert re.fullmatch("[А-ЯЁ][а-яё]+", g[10]) and len(g[10]) == len("Иванова")
    assert g[12] == g[2] and g[13] == g[1] and g[4].lower() == g[5]
    assert re.sub(r"\D", "", g[6]) == re.sub(r"\D", "", g[7])
    assert luhn(re.sub(r"\D", "", g[8])) == 0 and g[8][0] == "4"


def test_the_same_entity_is_the_same_everywhere_and_keys_differ(spark):
    a, b, c = run(spark, ["call 555-123-4567", "or 555-123-4567 now", "plain"])
    assert a.split()[1] == b.split()[1] != "555-123-4567" and c == "plain"
    assert run(spark, ["call 555-123-4567"], "other")[0] != a


def test_collisions_are_resolved(spark):
    names = [f"Mary {c}{v}" for c in "BCDFGHJKLMNP" for v in "aeiou"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(names)], SCHEMA)
    out = [r["text"] for r in sg.replace_personal_data(docs, "k").collect()]
    new = [t.split()[1] for t in out]
    assert len(set(new)) == len(names)  # though there are 100 names of this shape and 60 of them are taken
    assert not set(new) & {t.split()[1] for t in names}


def test_distinct_surrogates_before_any_retry_would_collide(spark):
    names = spark.createDataFrame([(f"{c}{v}",) for c in "BCDFGHJKLMNP" for v in "aeiou"], "v string")
    first = names.select(sg.surrogate(F.col("v"), F.lit("0"), "k").alias("s"))
    assert first.distinct().count() < 60


def test_edges(spark):
    assert run(spark, [None, "", "no data", "a@b", "1.2.3.4.5", "12345678901234567"]) == [None, "", "no data", "a@b", "1.2.3.4.5", "12345678901234567"]
    long = "x " * 60_000 + "me@site.org " * 50
    assert "me@site.org" not in run(spark, [long])[0]
    docs = spark.createDataFrame([(None, "me@site.org", "x"), (1, "me@site.org", "x"), (1, "me@site.org", "x")], SCHEMA)
    got = sg.replace_personal_data(docs)
    assert got.columns == ["doc_id", "text", "entities"]
    assert len({r["text"] for r in got.collect()}) == 1 and got.count() == 3
    assert sg.replace_personal_data(docs.limit(0)).count() == 0


def test_retries_check_the_numbers_that_are_written(spark, monkeypatch):
    # Few digests, so that numbers collide at the first attempt.
    monkeypatch.setattr(sg, "_digest", lambda key, *parts: F.sha2(F.pmod(F.xxhash64(F.concat_ws("|", F.lit(key), *parts)), F.lit(500)).cast("string"), 256))
    numbers = [f"{100 + k}-{10 + k}-{1000 + k}" for k in range(60)]
    first = spark.createDataFrame([(n,) for n in numbers], "v string").select(sg.surrogate(F.col("v"), F.lit("0"), "k").alias("s"))
    assert first.distinct().count() < len(numbers)
    new = run(spark, [f"ssn {n}" for n in numbers])
    assert len(set(new)) == len(numbers) and not set(new) & {f"ssn {n}" for n in numbers}
    assert all(re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", t) for t in new)


def test_more_forms_of_numbers_and_lone_surnames(spark):
    forms = ["(888) 555-6841", "+1 (888) 555-6841", "+44 20 7946 0958", "+49 30 123456", "3782 822463 10005", "378282246310005", "6304000000000000000"]
    new = run(spark, [f"so {f}, yes" for f in forms] + ["order 378282246310006 and 2024 123456 12345"])
    for old, text in zip(forms, new[:-1], strict=True):
        assert old not in text and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"so {old}, yes")
    assert new[-1] == "order 378282246310006 and 2024 123456 12345"
    lone, other = run(spark, ["Smith rang. John Smith said Smithson and Smith left.", "Smith rang."])
    name = lone.split()[0]
    assert name != "Smith" and re.fullmatch(rf"{name} rang\. \w+ {name} said Smithson and {name} left\.", lone) and other == "Smith rang."


def test_people_in_other_forms(spark):
    text = "Mary Smith left. Later Ms Smith called from 555-1234 and +33 1 23 45 67 89. Kevin Jones and Ahmed Khan were there. MARY too, SMITH as well; Dr. van der Berg and Berg; IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01."
    new = run(spark, [text])[0]
    for old in ("Mary", "Smith", "555-1234", "23 45 67 89", "Kevin", "Jones", "Ahmed", "Khan", "MARY", "SMITH", "Berg", "DE89 3704 0044 0532 0130 00"):
        assert not re.search(rf"(?<!\w){re.escape(old)}(?!\w)", new), old
    m = re.match(r"(\w+) (\w+) left\. Later Ms (\w+) called.*\. (\w+) too, (\w+) as well; Dr\. van der (\w+) and (\w+); IBAN (DE\d\d(?: \d{4}){4} \d\d), not DE89 3704 0044 0532 0130 01\.$", new)
    assert m, new
    g = m.groups()
    assert g[1] == g[2] and g[3] == g[0].upper() and g[4] == g[1].upper() and g[5] == g[6]
    account = g[7].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_a_full_space_of_numbers_grows(spark, monkeypatch):
    # Few digests for numbers of one shape: without growth not all of them could differ.
    monkeypatch.setattr(sg, "_digest", lambda key, *parts: F.sha2(F.pmod(F.xxhash64(F.concat_ws("|", F.lit(key), *parts)), F.lit(5)).cast("string"), 256))
    numbers = [f"{200 + k}-{4000 + k}" for k in range(6)]
    new = run(spark, [f"tel {n}" for n in numbers])
    assert len(set(new)) == len(numbers) and not set(new) & {f"tel {n}" for n in numbers}


class Twin:
    """The operator in plain Python, without collision checks."""

    def __init__(self, key):
        import regex

        self.key, self.regex = key, regex
        self.names = {n: (g, names) for g, names in sg.GIVEN.items() for n in names}

    def digest(self, *parts):
        import hashlib

        return hashlib.sha256("|".join([self.key, *parts]).encode()).digest()

    def in_class(self, value, d):
        return "".join(next((c[d[i % 32] % len(c)] for c in sg.CLASSES if x in c), x) for i, x in enumerate(value))

    def kind(self, v):
        r = self.regex
        for kind in ("email", "iban", "ip", "card", "ssn", "phone"):
            if r.fullmatch(sg.PATTERNS[kind], v):
                return kind
        return "given" if v.title() in self.names and v in (v.title(), v.upper()) else "surname"

    def find(self, text):
        own = {x for m in self.regex.finditer(sg.PATTERNS["surname"], text) for x in (m[1], m[1].upper())}
        every = sg.ANY + (r"|(?<!\p{L})(?:" + "|".join(sorted(own, key=len, reverse=True)) + r")(?!\p{L})" if own else "")
        return self.regex.finditer(every, text)

    def real(self, v, kind):
        digits = re.sub(r"\D", "", v)
        if kind == "iban":
            flat = v.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
        loose = re.fullmatch(r"\d[\d -]{11,}\d", v) and not re.fullmatch(r"\d{4}([ -]?\d{4}){3}|\d{3}[ .-]\d{3}[ .-]\d{4}", v)
        return not loose or luhn(digits) == 0

    def surrogate(self, v):
        kind = self.kind(v)
        digits = re.sub(r"\D", "", v)
        who = {"email": v.lower(), "iban": v.replace(" ", ""), "surname": v.lower().capitalize()}.get(kind, digits if kind in ("card", "ssn", "phone") else v)
        d = self.digest(kind, "0", who)
        if kind == "email":
            local, domain = v.split("@")
            name, top = domain.rsplit(".", 1)
            return self.in_class(local, d) + "@" + self.in_class(name, self.digest("domain", domain.lower())) + "." + top
        if kind == "ip":
            return ".".join(str(d[i] % 254 + 1) for i in range(4))
        if kind == "given":
            group, names = self.names[v.title()]
            new = names[(names.index(v.title()) + self.digest(*group)[0] % (len(names) - 1) + 1) % len(names)]
            return new.upper() if v.isupper() else new
        if kind == "surname":
            return self.in_class(v, d)
        if kind == "iban":
            body = self.in_class(who, d)[4:]
            number = int("".join(str(int(c, 36)) for c in body + who[:2] + "00"))
            fresh = iter(f"{who[:2]}{98 - number % 97:02d}{body}")
            return "".join(" " if c == " " else next(fresh) for c in v)
        made = self.in_class(digits, d)
        if kind != "ssn":
            made = digits[0] + made[1:]
        if kind == "card":
            made = next(made[:-1] + c for c in "0123456789" if luhn(made[:-1] + c) == luhn(digits))
        fresh = iter(made)
        return "".join(next(fresh) if c.isdigit() else c for c in v)

    def replace(self, text):
        out, at = [], 0
        for m in self.find(text):
            new = self.surrogate(m[0]) if self.real(m[0], self.kind(m[0])) else m[0]
            out += [text[at : m.start()], new]
            at = m.end()
        return "".join([*out, text[at:]])


def test_texts_match_a_plain_version(spark, tiny):
    import random

    rng, twin = random.Random(9), Twin("k")
    people = ["Mary Smith", "Mr Jones", "JOHN BROWN", "Pierre de la Tour", "Анна Иванова", "Hans O'Neil", "Ms. Smith-Lee", "Smith", "Jones", "Kevin"]
    numbers = ["(888) 555-6841", "+44 20 7946 0958", "555-1234", "4111 1111 1111 1111", "378282246310005", "378282246310006", "123-45-6789", "10.20.30.40", "1.2.3.4.5", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "2024-10-11", "3.14"]
    mails = ["me@site.org", "Me.Too@Mail.Example.com", "a@b", "x+y@sub.dom.fr"]
    made = [" ".join(rng.choice(rng.choice([people, numbers, mails, ["said", "and,", "then.", "at", "﷐", "Über", "the"]])) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    texts = made + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").orderBy("doc_id").collect() if r["text"] is not None]
    changed = 0
    for old, new in zip(texts, run(spark, texts), strict=True):
        assert new == twin.replace(old)
        changed += new != old
    assert changed > 120
