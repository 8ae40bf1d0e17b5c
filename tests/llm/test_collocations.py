import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("fleetroll.llm")

from fleetroll.llm import collocations  # noqa: E402
from fleetroll.llm.collocations import Transducer, tallied  # noqa: E402

from .cases import lower  # noqa: E402


def by_brute_force(rows, least, top, covered):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        longer = Counter()
        for p, a in own.items():
            if a >= least and len(p) > 2:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in own.items():
            if len(p) > 1 and a >= least and not 100 * longer[p] >= covered * a:
                score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "of", "The", "New", "york", "été", "a b", "x", "y", "z", *(f"w{i}" for i in range(30))]
    copied = " ".join(rng.choice(vocab) for _ in range(40))
    for i in range(n):
        words = []
        while len(words) < rng.choice([0, 1, 3, 40, 90]):
            words += rng.choice([[rng.choice(vocab)], ["new", "york", "city"], ["the", "of"], ["x", "x", "x"], ["w1,", "w2"], ["w3\n", "w4"], ["w5;w6"]])
        yield rng.choice(["en", "en", "en", "und", None, "fr"]), " ".join(words) + ("\t" + copied if i % 3 == 0 else "")


@pytest.mark.parametrize("least,top,covered", [(30, 2000, 80), (2, 2000, 80), (3, 7, 50)])
def test_collocations(spark, least, top, covered):
    """Null langs and texts, empty and long texts, repeats, ties at the cut, clashing columns, a phrase in a third of all rows."""
    rows = [*texts(least, 200), ("en", None), (None, ""), ("fr", " ,.\n"), ("de", "ein " * 20000), ("en", "the of")] + [("en", "hot words here")] * 100
    given = spark.createDataFrame([(i, t, lang, 1, "k", "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, key string, phrase string").repartition(4)
    got = sorted(map(tuple, collocations.collocations(given, least, top, covered).collect()))
    assert got == sorted(by_brute_force(rows, least, top, covered))
    assert collocations.collocations(given.limit(0)).collect() == []


def test_counts_beyond_64_bits_of_product(spark):
    d = spark.sql("SELECT cast(2000000BD * cast(a AS decimal(20, 0)) div (cast(l AS decimal(20, 0)) + r) AS bigint) AS s FROM VALUES (9000000000000000000L, 9000000000000000001L, 9000000000000000002L) t(a, l, r)")
    assert d.first()[0] == 2_000_000 * 9000000000000000000 // (9000000000000000001 + 9000000000000000002)


def test_transducers():
    rng = np.random.default_rng(3)
    many, want = [], Counter()
    for _ in range(5):
        rows = rng.integers(0, 6, (200, 3)).astype(np.uint64)
        columns, n = tallied([np.ascontiguousarray(c) for c in rows.T])
        want.update(map(tuple, rows.tolist()))
        many.append(Transducer.from_bytes(Transducer.build(columns, n).to_bytes()))
    whole = Transducer.union(many)
    columns = whole.columns()
    assert list(zip(*(c.tolist() for c in columns))) == sorted(want) and whole.weights.tolist() == [want[k] for k in sorted(want)]
    assert len(whole.labels[0]) == len(set(k[0] for k in want)) and len(whole.labels[1]) == len(set(k[:2] for k in want))
    asked = rng.integers(0, 8, (500, 3)).astype(np.uint64)
    assert whole.walk([np.ascontiguousarray(c) for c in asked.T]).tolist() == [want[tuple(k)] for k in asked.tolist()]
    none = Transducer.from_bytes(Transducer.build([x[:0] for x in columns], whole.weights[:0]).to_bytes())
    assert none.walk(columns).tolist() == [0] * len(whole.weights) and len(Transducer.union([none, whole]).weights) == len(whole.weights)


def test_infrequent_phrases_that_a_full_filter_lets_through_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(collocations, "key_filter", lambda *_: np.full(1 << 13, 255, np.uint8))
    rows = list(texts(9, 80))
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, 50, 80).collect()))
    assert got == sorted(by_brute_force(rows, 5, 50, 80))
