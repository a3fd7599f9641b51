"""Documents with nulls, ties, repeated rows and odd texts."""

PROSE = (
    "The harbour master wrote down every ship that came in before noon. The pilots waited on the quay, and the children counted sails. "
    "By the evening the wind had turned and nobody could leave. The baker sold the last of the bread to the crew of a coal barge. "
    "In the morning the fog lay over the water so thick that the bells had to be rung for an hour without a pause."
)
DEUTSCH = "Der Hafenmeister schrieb jedes Schiff auf, das vor dem Mittag einlief. Die Lotsen warteten am Kai, und die Kinder zählten die Segel. Am Abend hatte sich der Wind gedreht und niemand konnte auslaufen."
WORDS = PROSE.split()


def near_copy(k: int) -> str:
    words = list(WORDS)
    words[7 * k % len(words)] = f"word{k}"
    return " ".join(words)


#: doc_id, text, lang, source, n_chars: nulls, ties, repeated rows and ids, empty, odd and long texts.
ODD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, near_copy(1), "en", None), (4, near_copy(2), None, "b"), (5, DEUTSCH, "de", "b"), (6, None, "en", "a"), (7, "", None, None),
    (8, " \n\t ", "en", "c"), (9, "one", "en", "c"), (9, "two words", "en", "c"), (None, PROSE[:200] + " and then another ending of its own", "en", "c"), (None, None, None, None), (10, "12345 67890 !!", None, "a"),
    (11, "▁é   x\u0000y €😀 " * 3, "en", "a"), (12, "word " * 400, "en", "a"), (13, " ".join(f"w{i}" for i in range(20000)), "en", "b"), (14, "x" * 30000, "en", "b"), (15, "line one is here\n" * 6 + "end", "en", "a"),
    (16, "She said: " + PROSE[100:260] + " Nothing else was known.", "en", "d"), (17, DEUTSCH + " Ende.", "de", "d"),
]
