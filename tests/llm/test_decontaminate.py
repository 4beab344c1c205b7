import pytest
from spark_cues.llm import decontaminate as dc

ITEM = "A train leaves the station at 40 km an hour and a second train follows after 3 hours how far is it"
OTHER = "the old man said that Peter gave Mary seven red apples before the long winter came to the valley"
CLEAN = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
BENCH = "item_id long, text string, doc_id string"


def find(spark, texts, bench=((1, ITEM), (2, OTHER))):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    rows = dc.find_contamination(docs, spark.createDataFrame([(i, t, "x") for i, t in bench], BENCH)).collect()
    return {(r["doc_id"], r["item_id"]): round(r["coverage"], 3) for r in rows}


def test_copies_and_new_parameters_are_caught_and_clean_texts_left(spark):
    again = ITEM.replace("40", "75").replace("3 hours", "9 hours")
    names = OTHER.replace("Peter", "Hector").replace("Mary", "Olga")
    got = find(spark, [f"{CLEAN} {ITEM} {CLEAN}", again, f"{CLEAN}. {names}", CLEAN, None, "", ITEM.upper(), ITEM[:60], f"{ITEM} {CLEAN} {ITEM}"])
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (2, 2): 1.0, (6, 1): 1.0, (8, 1): 1.0}


def test_inconsistent_slots_are_no_copy(spark):
    item = "take 5 from 9 and 5 from 7 and then add 5 to what is left of it all"
    same = item.replace("5", "4")
    mixed = "take 4 from 9 and 2 from 7 and then add 8 to what is left of it all"
    merged = item.replace("9", "6").replace("7", "6")
    assert set(find(spark, [item, same, mixed, merged], [(1, item)])) == {(0, 1), (1, 1)}


def test_a_small_edit_is_within_the_similarity(spark):
    words = CLEAN.split()
    words[40] = "changed"
    assert set(find(spark, [" ".join(words), " ".join(words[:60])], [(7, CLEAN)])) == {(0, 7)}


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, ITEM), (3, ITEM), (3, ITEM), (4, "so it goes"), (5, "and so it goes on")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM, ""), (None, ITEM, ""), (2, None, ""), (3, "so it goes", ""), (4, "", "")], BENCH)
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in dc.find_contamination(docs, bench).collect())
    assert got == [(-1, 1), (3, 1), (4, 3)]
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [5]
    assert dc.find_contamination(docs.limit(0), bench).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 5


@pytest.mark.parametrize("limit", [0, 10**6])
def test_the_join_needs_no_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    assert find(spark, [ITEM, CLEAN]) == {(0, 1): 1.0}


def test_names_that_begin_sentences_are_parameters(spark):
    item = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. How many clips did she sell altogether in April and May?"
    again = item.replace("Natalia", "Weng").replace("48", "72")
    mixed = item.replace("Natalia sold", "Weng sold").replace("Natalia then", "Omar then")
    assert find(spark, [again, f"{CLEAN}. {again} {CLEAN}", CLEAN, mixed], [(1, item)]).keys() == {(0, 1), (1, 1)}


def test_capitalised_words_alone_are_no_copy(spark):
    assert find(spark, ["One. Two. Three. Four. Five. Six. Seven."], [(1, "Alpha. Beta. Gamma. Delta. Omega. Sigma. Kappa.")]) == {}


def test_numbers_of_another_shape_are_parameters(spark):
    item = "a farmer sells 900 apples for 2 dollars each and then buys 3 new trees for the garden how much money does he have left over"
    again = item.replace("900", "1,500").replace("2 dollars", "3.5 dollars")
    assert find(spark, [again, item.replace("3 new", "12,500.75 new"), f"{again}, 1."], [(1, item)]) == {(0, 1): 1.0, (1, 1): 1.0, (2, 1): 1.0}


def test_an_item_of_four_words_is_found_inside_a_text(spark):
    texts = ["Then she said: name the largest planet, please.", "Name the largest planet", "name the largest red planet", CLEAN]
    assert set(find(spark, texts, [(1, "Name the largest planet"), (2, OTHER)])) == {(0, 1), (1, 1)}


def test_runs_of_numbers_have_no_vote(spark):
    item = "add the numbers 1 2 3 4 5 6 7 8 9 10 11 12 and tell me what the whole sum of them is"
    again = item.replace("1 2 3 4 5 6 7 8 9 10 11 12", "21 22 23 24 25 26 27 28 29 30 31 32")
    got = find(spark, [item, again, " ".join(map(str, range(100, 160))), "1 2 3 4 5 6", "7 8 9 1 2 3"], [(1, item), (2, "1 2 3 4 5 6")])
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (0, 2): 1.0, (3, 2): 1.0}


def plain_windows(text, channel):
    """Windows of one channel of a text: key, slots, whether it has a word of its own."""
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}<>.,]|(?<![0-9])[.,]|[.,](?![0-9])", t.lower()) if w]
    raw = words(text)
    if channel >= dc.SHORT:
        return [(tuple(raw[i : i + channel]), None, True) for i in range(len(raw) - channel + 1)]
    seen = {0: None, 1: dc._NAME, 2: dc._INITIAL}[channel]
    if seen and not regex.search(seen, text):
        return []
    named = text if not channel else regex.sub(dc._NAME if channel == 1 else dc._ANY_NAME, "<name>", text)
    t = ["<num>" if w[0] in "0123456789" else "<unit>" if w in dc.UNITS else w for w in words(named)]
    out, holes = [], ("<num>", "<unit>", "<name>")
    for i in range(max(1, len(t) - 4) if t else 0):
        part, said = t[i : i + 5], raw[i : i + 5]
        if all(w in holes for w in part):
            out.append((tuple(said), None, False))
        else:
            slots = [r if w in holes else None for w, r in zip(part, said, strict=True)]
            out.append((tuple(part), slots if any(slots) else None, True))
    return out if not channel else [(k, s, own) if own else None for k, s, own in out]


def plain_find(texts, bench):
    """Every window of every text against every window of every item."""
    import regex

    out = {}
    for item, question in bench:
        n = len([w for w in regex.split(r"[^\p{L}\p{N}<>.,]|(?<![0-9])[.,]|[.,](?![0-9])", question.lower()) if w])
        channels = [0, 1, 2] + ([n] if n == dc.SHORT else [])
        grams = {c: [(b, w) for b, w in enumerate(plain_windows(question, c)) if w] for c in channels}
        if any(w[2] for ws in grams.values() for _, w in ws):
            grams = {c: [(b, w) for b, w in ws if w[2]] for c, ws in grams.items()}
        count = len({b for ws in grams.values() for b, _ in ws})
        for k, text in enumerate(texts):
            found = {}
            for c, ws in grams.items():
                for b, (key, asked, _) in ws:
                    for pos, w in enumerate(plain_windows(text, c) if text else []):
                        if w and w[0] == key:
                            found.setdefault((c, pos - b), []).append((b, asked, w[1]))
            matched = set()
            for hits in found.values():
                pairs = {(a, t) for _, asked, told in hits if asked for a, t in zip(asked, told, strict=True) if a is not None}
                if len(pairs) == len({a for a, _ in pairs}) == len({t for _, t in pairs}):
                    matched |= {b for b, _, _ in hits}
            if count and len(matched) >= dc.SIMILARITY * count:
                out[k, item] = round(len(matched) / count, 3)
    return out


@pytest.mark.parametrize("looked", [True, False])
def test_every_channel_equals_a_brute_force_twin(spark, monkeypatch, looked):
    import random

    if not looked:
        monkeypatch.setattr(dc, "_probes", lambda *x: None)
    rng = random.Random(11)
    names, nouns = ["Anna", "Bert", "Carla", "Dora", "Emil"], "apples pears coins stones ribbons kites lamps".split()

    def question():
        a, b, c = rng.sample(names, 2) + [rng.choice(nouns)]
        x, y = rng.randrange(2, 90), rng.choice(["3.5", "1,200", "7", "12"])
        return rng.choice([f"{a} has {x} {c} and gives {y} km of ribbon to {b}. How many {c} does {a} keep after {b} leaves?", f"When {a} walked {x} miles and {b} walked {y} miles, who walked further than {a}?", f"{x} {y} 9 8 7 6", f"sum {x} of {c}", f"Count the {c} that lie on the long table by the door"])

    bench = [(k, question()) for k in range(14)]
    texts = [question() for _ in range(40)] + [CLEAN, "", "Hello.", "7 8 9"]
    for _, q in bench:
        swap = dict(zip(names, rng.sample(names, 5), strict=True))
        again = " ".join(next((swap[n] + w[len(n) :] for n in names if w.startswith(n)), w) for w in q.split(" "))
        texts += [q, f"{CLEAN} {again} {CLEAN}", f"{CLEAN}. {q.upper()}", q.replace("Anna", "Bert"), " ".join(q.split()[: -len(q.split()) // 5 or None])]
    assert find(spark, texts, bench) == plain_find(texts, bench)


def test_a_benchmark_with_too_many_pairs_goes_without_the_first_look(spark, monkeypatch):
    monkeypatch.setattr(dc, "PROBES", 1)
    assert find(spark, [ITEM, CLEAN]) == {(0, 1): 1.0}
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert find(spark, [ITEM, CLEAN], [(1, ITEM), (1, OTHER), (2, "4 5 6 7 8 9")]) == {(0, 1): 1.0}
