"""Documents for the tests: prose, copies, near copies, odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def prose(rng, n):
    out = words(rng, n)
    return " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in out)


def documents(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45 and (base := rng.choice(rows)[1]):
            parts = base.split(" ")
            for _ in range(max(1, len(parts) // rng.choice([15, 40, 80]))):
                parts[rng.randrange(len(parts))] = f"x{rng.randrange(50)}"
            text = " ".join(parts)
        else:
            text = prose(rng, rng.choice([3, 8, 40, 120, 300]))
        rows.append((k, text))
    odd = [None, "", "   \n\t ", "one", "One", "é" * 60, "a" * 300, "ab " * 90, "W1 w2\x0bw3 w4\x0cw5"]
    rows += [(n + k, text) for k, text in enumerate(odd)]
    rows.append((n + len(odd), prose(rng, 6_000)))
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
