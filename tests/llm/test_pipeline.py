import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("fleetroll.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fleetroll.llm.common import written  # noqa: E402

from .cases import documents, lower, words  # noqa: E402
from .test_operators import classes, removed, repeat_words  # noqa: E402


def passes(text):
    """The policy's four rules, by hand."""
    w = words(text)
    own = [x for x in (text or "").split("\n") if words(x)]
    again, marks = len(own) - len(set(own)), sum((text or "").count(c) for c in "#*$%&|<>")
    return not (len(w) < 50 or 100 * repeat_words(w) > 50 * len(w) or 10 * marks > len(w) or (again >= 3 and 10 * again > 3 * len(own)))


def without_shared_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    number = lambda d: -1 if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(number(d))
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == number(d))) for d, t in rows]


def pieces(rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            yield d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())


def test_stages_hand_on_documents(spark):
    rows = documents(3)
    shared = "The same line stands in many of these documents."
    rows += [(200 + i, f"{shared}\n{rows[-3][1][1000 * i : 1000 * i + 700]}\n  {shared.upper()} ") for i in range(6)] + [(300, rows[-3][1] + " 1" * 7000)]
    extra = ["_tag", "n_lines", "n_dropped", "n_words", "n_removed", "kept_text", "spans", "need", "own", "fail_bits"]
    names = ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *[f"{c} {d}" for c in extra]) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars int, {names}")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, seen[-1], ""), name)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(r[c] == f"{c} {r['doc_id']}" for r in out.collect() for c in extra)
        seen.append(out)
    good = [(d, t) for d, t in rows if passes(t)]
    assert Counter((r["doc_id"], r["text"]) for r in seen[1].collect()) == Counter(good) and len(good) < len(rows)
    after_lines = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert Counter(after_lines) == Counter(without_shared_lines(good)) and Counter(after_lines) != Counter(good)
    want = Counter(d for d, _, _, kept in classes(after_lines, 5, 80) if kept)
    assert Counter(r["doc_id"] for r in seen[3].collect()) == want
    kept = [(r["doc_id"], r["text"]) for r in seen[3].collect()]
    text = {d: t for d, t in kept}
    assert {r["doc_id"]: r["text"] for r in seen[4].collect()} == {d: k if n else text[d] for d, _, n, k in removed(kept, 50)}
    packed, last = seen[5].collect(), [(r["doc_id"], r["text"]) for r in seen[4].collect()]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == Counter(pieces(last))
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        assert all(sum(n for _, n in sorted(own)[:i]) == at for i, (at, _) in enumerate(sorted(own))) and sum(n for _, n in own) <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.collect() == []
