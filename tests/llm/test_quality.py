from tidegrid.llm import quality

DOCS = "doc_id bigint, text string, word string, n_words string"
COMMON = "the of and to in that was for it on as by with not at".split()
PROSE = "The appeal was dismissed by the court and the costs of it were not to be set against that sum. In that view the claim fails on the first ground. "
TABLE = "".join(f"| Lease | {k} | {k * 1.37:.2f} | APC | 0{k % 9}/11/2010 |\n" for k in range(40))


def test_prose_and_not(spark):
    head = "COURT OF APPEAL OF X\nAPC 12/34\nA v B\n1 May 2010\n\n"
    rows = [
        (1, PROSE * 5, True), (2, TABLE, False), (3, PROSE + TABLE, False), (4, PROSE * 20 + TABLE, True), (5, None, False), (6, "", False), (7, " \n\t", False), (8, "12 34 56\n" * 30, False),
        (9, head + PROSE.upper() * 2, True), (10, "\n".join(PROSE.split()), True), (11, "PARTIES\n" + "\n".join(f"{k}. Xolm Ltd, Vaxby" for k in range(30)), False), (12, PROSE * 30_000, True), (13, "aGVsbG8gd29ybGQ" * 200, False), (14, "Court of X - Page 2 - AB 1/22\n" * 40, False),
    ]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in rows] + [(None, PROSE, "", "")], DOCS)
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.text_statistics(df, common).collect()}
    assert {i: r["is_prose"] for i, r in got.items()} == {i: p for i, _, p in rows}
    assert got[6]["n_words"] == got[5]["n_words"] == 0 and got[6]["mean_word_length"] is None and got[8]["n_words"] == 0
    assert {r["doc_id"] for r in quality.not_prose(df, common).collect()} == {i for i, _, p in rows if not p}
    assert quality.text_statistics(df.limit(0), common).count() == 0


def prose(text):
    words = frozenset(COMMON + "is you or what how this your at all about from before as an had been who which".split())
    return quality.statistics(text, words)[-1]


def test_lists_of_common_words_are_no_prose():
    menu = ["Print or share this with others", "What is on at the court", "Back to the top of this page", "How to find us in the town", "All about the court and you"]
    for mark in (" | ", " / ", " » "):
        assert not prose(mark.join(menu * 4))
    bundle = "".join(f"{chr(97 + k)}) letter from the {a} to the {b} as to the state of the {c} at that\nwharf{';' * (k % 2)}\n" for k, (a, b, c) in enumerate([("seller", "buyer", "mill"), ("agent", "court", "quay"), ("buyer", "agent", "tram"), ("court", "seller", "loan")] * 3))
    assert not prose("BUNDLE BEFORE THE COURT\n" + bundle) and prose(PROSE * 9 + "\n" + bundle)
    # numbered paragraphs, wrapped before citations and initials, are prose; so is a quotation in guillemets
    paragraphs = (f"{k}. The {w} of the sale was not due to the\n[2018] ABC {k} and so the {w} of it was for\nX. and for the court to say, as {w} was that.\n\n" for k, w in enumerate("sum loan mill quay lease deed share rent".split(), 1))
    assert prose("".join(paragraphs))
    assert prose("It was said of that « a sum » and « the day » that it was not for the court to say, and that was the end of it. " + PROSE)


def test_words_in_no_order_are_no_prose():
    words = (PROSE + "The learned judge had no doubt that a clause of the lease was in force at the time of the sale to the buyer.").lower().split() * 3
    jumbled = [words[(k * 37) % len(words)] for k in range(len(words))]
    assert len(words) % 37 and prose(" ".join(words)) and not prose(" ".join(jumbled))


def test_a_text_that_repeats_itself_is_no_prose():
    once = "The sum of it was not due to the court on that day. "
    assert prose(once) and prose(once * 2) and not prose(once * 200) and not prose((once + "\n") * 5)


def test_texts_read_together_are_read_alike():
    words = frozenset(COMMON)
    texts = [PROSE * 3, None, "", TABLE, "The [redacted] of ███ and *** was not for the", "12 34", PROSE.upper(), "a" * 500, "x\ud800y of the"]
    assert quality.read(texts, words) == [quality.statistics(t, words) for t in texts]


def test_figures():
    s = dict(zip([c.split()[0] for c in quality.SCHEMA.split(", ")][1:], quality.statistics("The cat sat.\nThe cat sat.\n\nof 12 ++", frozenset(COMMON)), strict=True))
    assert s["n_words"] == 7 and abs(s["mean_word_length"] - 20 / 7) < 1e-12
    assert abs(s["line_end_punctuation_share"] - 2 / 3) < 1e-12 and abs(s["common_word_share"] - 3 / 7) < 1e-12
    assert abs(s["digit_ratio"] - 2 / 26) < 1e-12 and abs(s["symbol_ratio"] - 4 / 26) < 1e-12
    assert abs(s["duplicate_line_share"] - 12 / 32) < 1e-12


def test_repetition():
    top, again = quality.repetition("a b c d e f g h i j k l".split() * 2)
    assert top == 2 * 4 / 24 and again == 0.5
    assert quality.repetition(["a"]) == (0.0, 0.0)
