"""Small documents with the cases that every operator must take: nulls, empties, ties, repeats, odd characters."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size long, `at` string"


def words(rng: random.Random, n: int) -> str:
    pool = ["the", "of", "Ämter", "naïve", "river", "stone", "cloud", "a", "run", "ﬁne", "b2", "don't", "x,", "end."]
    return " ".join(rng.choice(pool) + str(rng.randint(0, 40)) for _ in range(n))


def documents(n: int = 60, seed: int = 5) -> list[tuple]:
    """Rows under DDL, which has extra columns whose names clash with what operators make."""
    rng = random.Random(seed)
    shared = words(rng, 30)
    line = "This line is long enough and it is shared by many documents."
    base = words(rng, 200)
    texts: list[str | None] = [None, "", " ", "\n", "one", "two words", "  lead\tand\ttabs\r\n", "\n\n\n", "ÄÖÜ ß", base, base, base.upper(), base.replace(" ", "  ")]
    texts += [base + f" tail{i}" for i in range(6)]
    texts += [words(rng, 40) + " " + shared + " " + words(rng, 10) for _ in range(6)]
    texts += [words(rng, 8) + "\n" + line + ("\n" if i % 2 else "\n  ") + words(rng, 5) for i in range(8)]
    texts += ["long " * 3000 + words(rng, 2000)]
    while len(texts) < n:
        texts.append("\n".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))))
    sources = ["web", "books", "web", "web", None, "Zeitung", "news"]
    rows = [(i * 3 + 1, t, "en", sources[i % len(sources)], None if t is None else len(t), "clash", 7, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DDL)
