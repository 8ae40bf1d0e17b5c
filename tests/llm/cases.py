"""Small documents with every kind of trouble: nulls, empty and long texts, ties, copies, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = prose(70), "A line that many documents share. " + prose(4)
    rows = []
    for i in range(n):
        t = prose(rng.choice([0, 1, 2, 5, 60, 120, 300]))
        if i % 5 == 0:
            t = t + "\n" + line + "\n" + prose(3)
        if i % 6 == 0:
            t = prose(10) + " " + passage + "  \n" + t
        rows.append((i, t))
    base = prose(200).split(" ")
    for i in range(n, n + 12):
        w = list(base)
        for _ in range(i - n):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(n + 12, rows[3][1]), (n + 13, None), (n + 14, ""), (n + 15, " \n\t "), (None, rows[4][1]), (None, None), (n + 16, prose(6000)), rows[5], rows[5]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7, "y", 1) for d, t in rows], "doc_id long, text string, _id string, n_words int, kept_text string, size int").repartition(3)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
