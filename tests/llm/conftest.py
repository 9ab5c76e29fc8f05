import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k1 int, extra double"


@pytest.fixture(scope="session")
def corpus():
    """Rows of SCHEMA: ordinary texts, exact and near copies, a shared passage, nulls, empty, wordless, long and repeated
    rows, odd white space; columns that clash with names the operators use inside."""
    rng = random.Random(5)
    vocab = {"en": ["the", "of", "thing", "with", "nation", "Rain", "it's", "wh"], "de": ["der", "und", "größe", "Schatz", "keit", "für"], "fr": ["le", "été", "nation", "que", "où", "eau"]}
    words = lambda lang, n: [rng.choice(vocab[lang]) + rng.choice(["", "", "", "ing", "en", ".", ",", str(rng.randint(0, 99))]) for _ in range(n)]
    passage = words("en", 60)
    rows = []
    for i in range(120):
        lang = rng.choice(list(vocab))
        text = words(lang, rng.choice([0, 1, 2, 3, 12, 34, 35, 36, 60, 150, 300]))
        if i % 9 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passage[: rng.randint(30, 60)] + text[at:]
        rows.append((i, rng.choice([" ", " ", "\n"]).join(text), lang, f"src{0 if rng.random() < 0.4 else rng.randint(1, 4)}"))
    for i in range(120, 160):  # exact and near copies
        text, lang, source = rows[rng.randrange(60, 120)][1:]
        if i % 2:
            text = text.replace("the", "THE", 1) + " end"
        rows.append((i, text, lang, source))
    rows += [(160, None, "en", "src0"), (161, "", None, None), (162, " \t\n ", "en", None), (163, "... 12 !!", "fr", "src1"), (164, "a b " * 900, "en", "src0"), (165, "one two three four five six seven " * 400, None, "src2")]
    rows += [(166, "  two  spaces   and　wide \n tabs\t\tend ", "en", "src3"), (167, "x <|endoftext|> y 12'34 don't", "en", "src3"), (-5, "negative id", "en", "src1"), (3, rows[3][1], "en", "src0"), rows[7], rows[7]]
    return [(*r, None, "clash", 1, 0.5) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
