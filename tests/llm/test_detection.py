"""People outside of the name lists, network addresses and national numbers, by what a text itself shows."""

import random
import re

from spark_cues.llm import surrogates as sg
from test_surrogates import Twin

# None of these names is in the lists.
PEOPLE = [("Kwame", "Mensah"), ("Ananya", "Rao"), ("Siobhan", "Kelly"), ("Bogdan", "Ilic"), ("Thandiwe", "Dlamini"), ("Ngozi", "Okafor"), ("Jürgen", "Weiß"), ("Mireille", "Dubois"), ("Тарас", "Бондар"), ("Björk", "Jónsdóttir")]
SHOWN = [
    "It was late. {0} {1} said so, and {0} left.", "They wrote, but {0} asked again; later {0} rang.", "We met {0} {1} and left. Then {1} called.", "Dear {0},\nthe parcel is here. Bye, {0}!", "All is well.\nKind regards,\n{0} {1}\n",
    "Mail {2}.{3}@site.org about it. {0} knows, {1} too.", "A note from Ms {1}. They said {1} is out.",
]


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sg.replace_personal_data(docs, "k", context=True).orderBy("doc_id").collect()]


def test_people_shown_by_their_text_are_found_and_stay_one_person(spark):
    texts = [t.format(a, b, a.lower(), b.lower()) for t in SHOWN for a, b in PEOPLE]
    for (old, new), (a, b) in zip(zip(texts, replaced(spark, texts), strict=True), PEOPLE * len(SHOWN), strict=True):
        for name in (a, b):
            assert not re.search(rf"(?<!\w){name}(?!\w)", new), (old, new)
        words = lambda t: re.findall(r"\w+|\W", t)
        named = {x: y for x, y in zip(words(old), words(new), strict=True) if x in (a, b)}
        assert all(y == named.get(x, y) for x, y in zip(words(old), words(new), strict=True))
        assert len(set(named.values())) == len(named)


def test_a_list_of_people_and_capitals(spark):
    new = replaced(spark, ["I met Kwame Mensah, Siobhan Kelly and Bogdan Ilic. MENSAH sat; Ilic-Kelly too."])[0]
    assert re.fullmatch(r"I met \w+ \w+, \w+ \w+ and \w+ \w+\. [A-Z]+ sat; \w+-\w+ too\.", new)
    assert not re.search("Kwame|Mensah|Siobhan|Kelly|Bogdan|Ilic|MENSAH", new)


def test_words_that_are_no_names_stay(spark):
    plain = [
        "The company said no. Later The Company said no.", "Dear Customer, thank you.", "Hello World, it works.", "We met on Monday and then He said yes.", "Two sites: std::vector a::b at 12:30:45, Case 4: done.",
        "A street Baker Street and a town Cold Spring lie there.", "Said the cat. Our team asked.", "on 01.02.2024 10:30 or 01-02-2024, id 0123456789, 0.1234 5678, 012-345",
    ]
    assert replaced(spark, plain) == plain
    kept = replaced(spark, ["Mail info.desk@site.org or front.office@site.org; the Desk and the Front are open."])[0]
    assert kept.endswith("; the Desk and the Front are open.")


def test_network_addresses_of_eight_groups(spark):
    forms = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0DB8:0000:0042:0000:8A2E:0370:7334", "::1"]
    new = replaced(spark, [f"at {f}, yes" for f in forms] + ["AT 2001:DB8::1, YES"])
    for old, text in zip(forms, new, strict=False):
        assert old not in text and re.sub("[0-9A-Fa-f]", "0", text) == re.sub("[0-9A-Fa-f]", "0", f"at {old}, yes")
    assert new[0].split()[1].lower() == new[-1].split()[1].lower()


def test_a_full_space_of_short_addresses_grows(spark):
    forms = [f"::{k}" for k in range(10)]
    new = [t.split()[1] for t in replaced(spark, [f"at {f} now" for f in forms])]
    assert len(set(new)) == len(forms) and not set(new) & set(forms)


def test_national_numbers_keep_their_layout(spark):
    forms = ["020 7946 0958", "07700 900123", "030 123456", "(020) 7946 0958", "01 23 45 67 89", "01.23.45.67.89", "06-12-34-56-78"]
    for old, text in zip(forms, replaced(spark, [f"call {f} now" for f in forms]), strict=True):
        assert old not in text and text != f"call {old} now" and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"call {old} now")


def test_long_texts_stay_linear(spark):
    import time

    texts = [s * 100_000 for s in ("Kwame said ", "met Aa Bb, ", "a:", "0 ", "Dear Kwame ", "aa.bb")] + ["A" + "a" * 1_000_000 + " said", "regards," + "\n" * 1_000_000, "met " + "Aa Bb, " * 100_000]
    begun = time.time()
    assert len(replaced(spark, texts)) == len(texts)
    assert time.time() - begun < 120


class ContextTwin(Twin):
    """The plain version with people by context."""

    def find(self, text):
        r = self.regex
        phrases = [m[0] for m in r.finditer(sg.EVIDENCE, text) if not r.search(rf"(?<!\p{{L}})(?:{'|'.join(sg.DETERMINERS)})(?!\p{{L}})", m[0])]
        words = {w for p in phrases for w in r.findall(r"\p{Lu}\p{Ll}+", p)} - {*sg.GREETING, *sg.PARTING}
        words |= {w for m in r.finditer(r"(?<![\p{L}\p{N}._%+-])(\p{L}{3,20})[._](\p{L}{3,20})@(?=[A-Za-z0-9])", text) if not {m[1], m[2]} & {*sg.NO_PERSON} for w in m.groups()}
        low = {w.lower() for w in words} - {*sg.NO_PERSON} - {t.lower() for t in sg.TITLES} - set(r.findall(r"(?<![\p{L}\p{N}._%+@-])\p{Ll}++(?![\p{L}\p{N}_%+@-]|\.\p{L})", text))
        own = {x for m in r.finditer(sg.PATTERNS["surname"], text) for x in (m[1], m[1].upper())} | {x for w in low for x in (w.capitalize(), w.upper())}
        every = sg.ANY + (r"|(?<!\p{L})(?:" + "|".join(sorted(own, key=len, reverse=True)) + r")(?!\p{L})" if own else "")
        return r.finditer(every, text)


def test_texts_match_a_plain_version_with_context(spark, tiny):
    rng, twin = random.Random(5), ContextTwin("k")
    people = ["Mary Smith", "Kwame Mensah", "Mr Jones", "Ananya", "Smith", "Bogdan Ilic", "KWAME", "Ilic", "Front Office"]
    around = ["said", "met", "wrote", "and", "told", "the", "The", "regards,", "Dear", "office", "later", "asked", ", ", "mensah", "kwame.mensah@site.org", "front.office@site.org", "555-1234"]
    made = [" ".join(rng.choice(rng.choice([people, around])) for _ in range(rng.randrange(2, 25))) for _ in range(200)]
    texts = made + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").orderBy("doc_id").collect() if r["text"] is not None]
    changed = 0
    for old, new in zip(texts, replaced(spark, texts), strict=True):
        assert new == twin.replace(old)
        changed += new != old
    assert changed > 150
